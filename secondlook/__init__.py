"""Repeat-applicant and campaign-response analysis over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no copy of
# this package and the driver may run from any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
