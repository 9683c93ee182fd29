"""Registered queries: each operator run on stand-ins made from the given tables,
with the same question as SQL where SQL can ask it."""

from secondlook.workload.registry import ORACLES, QUERIES  # noqa: F401
from secondlook.workload import models, relational, rows, studies, tables  # noqa: F401,E402
