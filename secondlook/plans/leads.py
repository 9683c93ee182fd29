"""Profile of repeated leads and the check of leads against card applications (Q2, Q3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secondlook.functions.predicates import known, not_loan
from secondlook.functions.scalars import records
from secondlook.operators.aggregates import metrics
from secondlook.operators.joins import left_join
from secondlook.operators.keyed import first_per_key, pair_with_first
from secondlook.operators.ordering import sort_keys

MONTH, SOURCE, PRODUCT = "Data_Mth", "AGENT_SOURCE_CODE", "Product_CC_PL_RL"


def with_id(lead: DataFrame) -> DataFrame:
    return lead.filter(known("ID"))


def lead_counts(lead: DataFrame) -> DataFrame:
    """Total, distinct and repeated leads. The IDs are counted per value first, so no
    task sees all rows of one ID."""
    per_id = with_id(lead).groupBy("ID").agg(F.count("*").alias("n"))
    return metrics(per_id, total=F.sum("n"), distinct=F.count("*"), repeats=F.sum(F.col("n") - 1))


def repeat_pairs(lead: DataFrame, **hot) -> DataFrame:
    """The first lead of each ID beside every later one."""
    narrow = with_id(lead).select("ID", MONTH, SOURCE, PRODUCT, "row_id")
    return pair_with_first(narrow, "ID", MONTH, row_id="row_id", **hot)


def same_flags(pairs: DataFrame) -> dict:
    return {"same_month": F.col(f"{MONTH}_x") == F.col(f"{MONTH}_y"),
            "same_source": F.col(f"{SOURCE}_x") == F.col(f"{SOURCE}_y"),
            "same_product": F.col(f"{PRODUCT}_x") == F.col(f"{PRODUCT}_y")}


def duplicate_profile(lead: DataFrame) -> DataFrame:
    """Counts of later leads by agreement with the first: month, source, product, and
    source x product. A comparison with a missing side is a group of its own.

    The same counts as from ``repeat_pairs``, without its join: leads are first counted
    by ID, month, source and product, which shrinks a hot ID to a few rows before it is
    shuffled. The first lead of an ID lies in the group with the earliest month and then
    the smallest row id; its own row is taken off that group.
    """
    compared = [MONTH, SOURCE, PRODUCT]
    groups = (with_id(lead).groupBy("ID", *compared)
              .agg(F.count("*").alias("n"), F.min("row_id").alias("row_id")))
    in_order = Window.partitionBy("ID").orderBy(*sort_keys(MONTH, "row_id"))
    first = F.first(F.struct(*compared)).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    beside = groups.select(
        *[F.col(c).alias(f"{c}_y") for c in compared], first.alias("first"),
        (F.col("n") - F.when(F.row_number().over(in_order) == 1, 1).otherwise(0)).alias("n"))
    later = beside.filter("n > 0").withColumns({f"{c}_x": F.col(f"first.{c}") for c in compared})
    cells = (later.groupBy(*[flag.alias(name) for name, flag in same_flags(later).items()])
             .agg(F.sum("n").alias("n")))  # at most 27 rows
    m, s, p = F.col("same_month"), F.col("same_source"), F.col("same_product")
    gone = F.lit(None).cast("boolean")
    views = records(["comparison", "first_flag", "second_flag"],
                    ("month", m, gone), ("source", s, gone), ("product", p, gone),
                    ("source_product", s, p))
    return (cells.select(F.inline(views), "n")
            .groupBy("comparison", "first_flag", "second_flag").agg(F.sum("n").alias("n")))


def card_leads(lead: DataFrame) -> DataFrame:
    """One lead per ID among those that are not loan leads, the first in file order."""
    return first_per_key(with_id(lead).filter(not_loan(PRODUCT)), "ID", "row_id")


def lead_card_check(lead: DataFrame, cards: DataFrame, **hot) -> DataFrame:
    """Card leads left-joined to their card application rows."""
    return left_join(card_leads(lead), cards, ["ID"], unique="left", **hot)


def match_rate(lead: DataFrame, cards: DataFrame) -> DataFrame:
    """Distinct IDs on both routes and how many card leads have an application."""
    left = with_id(lead).filter(not_loan(PRODUCT)).select("ID").distinct()
    right = cards.select("ID").distinct().withColumn("__hit", F.lit(1))
    both = (left.withColumn("__lead", F.lit(1)).join(right, "ID", "full"))
    return metrics(both, card_leads=F.count("__lead"), card_ids=F.count("__hit"),
                   matched=F.count_if(F.col("__lead").isNotNull() & F.col("__hit").isNotNull()))
