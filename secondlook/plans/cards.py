"""Modelling sets for card applications (Q1, Q4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.functions import scalars as S
from secondlook.functions.predicates import equals, known, strictly_between
from secondlook.operators.aggregates import union_by_name
from secondlook.operators.joins import left_join, lookup_join, natural_lookup
from secondlook.operators.keyed import earliest_per_key, latest_per_key, single_rows
from secondlook.operators.ordering import top_frequencies
from secondlook.operators.schema import apply_to, drop_names, drop_positions, rename

# Fixed values of the analysis.
OLD_YEAR = 2015
SALARY_LOW, SALARY_HIGH = 1000, 125000
REJECT_BRANCH = "REJ"
PREDICTORS = ["Old_Reason_Desc", "Old_Product", "Occupation_Code", "Doc_Waive", "AGE",
              "Appr", "Diff_Month", "Monthly_Salary"]
REDUCED = ["AGE", "Monthly_Salary", "Doc_Waive", "Old_Product", "Appr"]
DROPPED_POSITIONS = (3, 9)
DROPPED_AFTER_LOOKUP = [
    "Work_Place", "Spending_Range", "Spending60", "Occupation", "Income_Range", "QUEUE", "Channel",
    "Channel_Group", "Left2_Zipcode", "Province_Tha", "Region_Tha", "RefCode", "City_Type",
    "Province_Eng", "Region_Eng"]


def parsed_extract(extract: DataFrame) -> DataFrame:
    """Types, dates and derived columns of the text extract."""
    return (extract
            .withColumns({"Old_Date": S.month_start(OLD_YEAR, "Data_Mth"),
                          "Old_Product": S.product_family("Product_CC_PL_RL"),
                          "New_Date": S.compact_month_start("Month"),
                          "AGE": S.text_to_int("AGE"),
                          "Monthly_Salary": S.text_to_double("Monthly_Salary")})
            .withColumn("Diff_Month", S.months_apart("New_Date", "Old_Date")))


def modelling_set(extract: DataFrame, person: str = "Person") -> DataFrame:
    """Card applications of persons seen once, eight columns, salaries in range (Q1)."""
    cards = parsed_extract(extract).filter(equals("Product", S.CARD_CODE))
    needed = cards.select("row_id", person, *PREDICTORS)
    return (single_rows(needed, person).drop(person)
            .filter(strictly_between("Monthly_Salary", SALARY_LOW, SALARY_HIGH))
            .withColumns({"Doc_Waive": S.default_if_missing("Doc_Waive", S.WAIVER_DEFAULT),
                          "Appr": S.text_to_int("Appr")}))


def repeated_persons(extract: DataFrame, person: str = "Person") -> DataFrame:
    cards = extract.filter(equals("Product", S.CARD_CODE))
    return top_frequencies(cards, person)


def enriched(cards: DataFrame, occupation: DataFrame, province: DataFrame) -> DataFrame:
    """Occupation code by description and province by the first two zip characters."""
    coded = rename(lookup_join(cards, occupation, {"Occupation": "Description"}),
                   OccupationCode="Code")
    return natural_lookup(coded.withColumn("Left2_Zipcode", S.left_chars("Zipcode", 2)), province)


def _trimmed(df: DataFrame, expect: list[str] | None) -> DataFrame:
    return drop_names(drop_positions(df, DROPPED_POSITIONS, expect=expect), *DROPPED_AFTER_LOOKUP)


def before_after(cards_before: DataFrame, cards_after: DataFrame, occupation: DataFrame,
                 province: DataFrame, expect: list[str] | None = None) -> DataFrame:
    """Latest rejected application per ID (``_x``) against the earliest one of the first
    year (``_y``), with change features (Q4). ``expect`` names the columns that the dropped positions must hit."""
    rejected = union_by_name(cards_before, cards_after).filter(equals("Branch_Code", REJECT_BRANCH))
    latest = _trimmed(enriched(latest_per_key(rejected, "ID", "ApproveDate", "row_id"),
                               occupation, province), expect)
    earliest = _trimmed(enriched(earliest_per_key(cards_before, "ID", "ApproveDate", "row_id"),
                                 occupation, province), expect)
    both = left_join(latest, earliest, ["ID"], unique="both")
    both = apply_to(both, ["Appl_In_Date_x", "Appl_In_Date_y"], S.day_first_date)
    both = apply_to(both, ["ApproveDate_x", "ApproveDate_y", "DOB_x", "DOB_y"], S.to_date_only)
    return (both.filter(known("OccupationCode_x", "OccupationCode_y"))
            .withColumns({
                "Monthly_Salary_diff": S.difference("Monthly_Salary_x", "Monthly_Salary_y"),
                "OccupationCode_diff_flag": S.change_flag("OccupationCode_x", "OccupationCode_y"),
                "ZipCode_diff_flag": S.change_flag("Zipcode_x", "Zipcode_y"),
                "Doc_Waive_y_flag": S.present_flag("Doc_Waive_y")}))


def approval_features(pairs: DataFrame) -> DataFrame:
    """Age before, salary change and the approval flag, by row."""
    return pairs.select(F.col("row_id_x").alias("row_id"), "Age_y", "Monthly_Salary_diff",
                        S.approval_flag("Result_x").alias("Appr_flag"))
