"""Join, keyed-row, aggregate, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from secondlook.operators import aggregates as A
from secondlook.operators import joins as J
from secondlook.operators import keyed as K
from secondlook.operators import ordering as O
from secondlook.operators import ranking as R
from secondlook.plans import cards, leads, unified
from secondlook.workload import standins as I
from secondlook.workload.registry import query
from secondlook.workload.tables import CARDS_SQL, REJECTED_SQL, all_cards, rejected

LEAD_SQL = f"(SELECT * FROM {I.LEAD.sql} t WHERE ID IS NOT NULL)"
_RANKED = f"""(SELECT *, row_number() OVER (PARTITION BY ID ORDER BY Data_Mth ASC NULLS LAST, row_id) AS rn,
  count(*) OVER (PARTITION BY ID) AS copies FROM {LEAD_SQL} l)"""
PAIRS_SQL = f"""(SELECT a.ID, a.row_id AS row_id_x, b.row_id AS row_id_y, a.Data_Mth AS Data_Mth_x,
  b.Data_Mth AS Data_Mth_y, a.AGENT_SOURCE_CODE AS AGENT_SOURCE_CODE_x,
  b.AGENT_SOURCE_CODE AS AGENT_SOURCE_CODE_y, a.Product_CC_PL_RL AS Product_CC_PL_RL_x,
  b.Product_CC_PL_RL AS Product_CC_PL_RL_y
  FROM {_RANKED} a JOIN {_RANKED} b ON a.ID = b.ID AND a.rn = 1 AND b.rn > 1)"""

def lead(spark, sf):
    return I.LEAD.frame(spark, sf)


@query("jn1_left_join", f"""
  SELECT l.row_id AS lead_row, l.ID, c.row_id AS card_row, c.Result
  FROM {LEAD_SQL} l LEFT JOIN {I.CC15.sql} c ON l.ID IS NOT DISTINCT FROM c.ID""")
def jn1(spark, sf):
    left = leads.with_id(lead(spark, sf)).select(F.col("row_id").alias("lead_row"), "ID")
    right = I.CC15.frame(spark, sf).select("ID", F.col("row_id").alias("card_row"), "Result")
    return J.left_join(left, right, ["ID"])


@query("jn2_lookup", f"""
  SELECT c.row_id, c.Occupation, o.Code FROM {CARDS_SQL} c
  LEFT JOIN {I.OCCUPATION.sql} o ON c.Occupation IS NOT DISTINCT FROM o.Description""")
def jn2(spark, sf):
    df = all_cards(spark, sf).select("row_id", "Occupation")
    return J.lookup_join(df, I.OCCUPATION.frame(spark, sf), {"Occupation": "Description"})


@query("jn3_natural_lookup", f"""
  SELECT c.row_id, substr(c.Zipcode, 1, 2) AS Left2_Zipcode, p.Province_Eng, p.City_Type_Code
  FROM {CARDS_SQL} c LEFT JOIN {I.PROVINCE.sql} p ON substr(c.Zipcode, 1, 2) = p.Left2_Zipcode""")
def jn3(spark, sf):
    from secondlook.functions.scalars import left_chars
    df = all_cards(spark, sf).select("row_id", left_chars("Zipcode", 2).alias("Left2_Zipcode"))
    province = I.PROVINCE.frame(spark, sf).select("Left2_Zipcode", "Province_Eng", "City_Type_Code")
    return J.natural_lookup(df, province)


@query("jn4_first_with_later", f"SELECT * FROM {PAIRS_SQL} p")
def jn4(spark, sf):
    return leads.repeat_pairs(lead(spark, sf))


@query("jn5_semi_join", f"""
  SELECT row_id, ID FROM {REJECTED_SQL} t WHERE ID IN (
    SELECT ID FROM {REJECTED_SQL} u GROUP BY ID HAVING count(*) > 1)
  UNION ALL SELECT row_id, ID FROM {REJECTED_SQL} v WHERE ID IS NULL
    AND (SELECT count(*) FROM {REJECTED_SQL} w WHERE ID IS NULL) > 1""")
def jn5(spark, sf):
    return unified.repeated_applications(rejected(spark, sf).select("row_id", "ID"))


@query("jn6_complement", f"""
  SELECT row_id FROM {I.LEAD.sql} l WHERE row_id NOT IN (SELECT row_id FROM {LEAD_SQL} k)""")
def jn6(spark, sf):
    df = lead(spark, sf).select("row_id", "ID")
    return J.complement(df, leads.with_id(df), "row_id").select("row_id")


@query("jn7_matched_on_both", f"""
  SELECT a.row_id, a.Code AS Code_x, b.Code AS Code_y FROM
    (SELECT c.row_id, c.ID, o.Code FROM {I.CC15.sql} c LEFT JOIN {I.OCCUPATION.sql} o
       ON c.Occupation IS NOT DISTINCT FROM o.Description) a
    JOIN (SELECT c.ID, min(o.Code) AS Code FROM {I.CC16.sql} c LEFT JOIN {I.OCCUPATION.sql} o
       ON c.Occupation IS NOT DISTINCT FROM o.Description GROUP BY c.ID) b ON a.ID IS NOT DISTINCT FROM b.ID
  WHERE a.Code IS NOT NULL AND b.Code IS NOT NULL""")
def jn7(spark, sf):
    occupation = I.OCCUPATION.frame(spark, sf)

    def coded(frame):
        return J.lookup_join(frame.select("row_id", "ID", "Occupation"), occupation,
                             {"Occupation": "Description"})
    right = coded(I.CC16.frame(spark, sf)).groupBy("ID").agg(F.min("Code").alias("Code"))
    both = J.left_join(coded(I.CC15.frame(spark, sf)), right, ["ID"], unique="right")
    return both.filter("Code_x IS NOT NULL AND Code_y IS NOT NULL").select("row_id", "Code_x", "Code_y")


@query("agg1_row_count", f"SELECT count(*) AS n FROM {LEAD_SQL} l")
def agg1(spark, sf):
    return A.row_count(leads.with_id(lead(spark, sf)))


@query("agg2_distinct_with_missing", f"""
  SELECT (SELECT count(*) FROM (SELECT DISTINCT ID FROM {I.CC15.sql} t)) AS n""")
def agg2(spark, sf):
    return A.distinct_count(I.CC15.frame(spark, sf), "ID")


@query("agg3_group_size", f"SELECT ID, count(*) AS n FROM {REJECTED_SQL} t GROUP BY ID")
def agg3(spark, sf):
    return K.key_counts(rejected(spark, sf), "ID")


@query("agg4_count_by_condition", f"""
  SELECT CAST(AGENT_SOURCE_CODE_x = AGENT_SOURCE_CODE_y AS VARCHAR) AS same_source, count(*) AS n
  FROM {PAIRS_SQL} p GROUP BY 1""")
def agg4(spark, sf):
    pairs = leads.repeat_pairs(lead(spark, sf))
    return A.count_by(pairs, same_source=leads.same_flags(pairs)["same_source"].cast("string"))


@query("agg6_frequency", f"""
  SELECT l.Result, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (VALUES ('A'), ('D'), ('R'), ('X')) l(Result)
  LEFT JOIN (SELECT Result, count(*) AS n FROM {CARDS_SQL} t GROUP BY Result) c ON l.Result = c.Result""")
def agg6(spark, sf):
    return A.frequency(all_cards(spark, sf), "Result", ["A", "D", "R", "X"])


@query("agg6_frequency_of_found_levels", f"""
  SELECT Occupation, count(*) AS n FROM {CARDS_SQL} t WHERE Occupation IS NOT NULL GROUP BY Occupation""")
def agg6_found(spark, sf):
    return A.frequency(all_cards(spark, sf), "Occupation")


@query("agg7_contingency", f"""
  SELECT a.v AS called, b.v AS label, CAST(coalesce(n, 0) AS BIGINT) AS n
  FROM (VALUES (0), (1), (2)) a(v) CROSS JOIN (VALUES (0), (1), (2)) b(v)
  LEFT JOIN (SELECT called, label, count(*) AS n FROM {I.SCORED.sql} t GROUP BY 1, 2) c
    ON a.v = c.called AND b.v = c.label""")
def agg7(spark, sf):
    return A.contingency(I.SCORED.frame(spark, sf), "called", "label", [0, 1, 2])


@query("agg7_contingency_wide", f"""
  SELECT called, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS label_0,
         CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS label_1 FROM {I.SCORED.sql} t GROUP BY called""")
def agg7_wide(spark, sf):
    return A.contingency_wide(I.SCORED.frame(spark, sf), "called", "label", [0, 1])


@query("agg8_accuracy", f"""
  SELECT round(avg(CASE WHEN called = label THEN 1 ELSE 0 END), 9) AS accuracy FROM {I.SCORED.sql} t""")
def agg8(spark, sf):
    return A.share_equal(I.SCORED.frame(spark, sf), "called", "label").select(
        F.round("accuracy", 9).alias("accuracy"))


@query("win1_single_rows", f"""
  SELECT row_id, Person FROM (SELECT row_id, Person, count(*) OVER (PARTITION BY Person) AS n
  FROM {I.EXTRACT.sql} t) WHERE n = 1""")
def win1(spark, sf):
    return K.single_rows(I.EXTRACT.frame(spark, sf).select("row_id", "Person"), "Person")


@query("win1_single_texts", """
  SELECT doc_id, lang, source FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1""")
def win1_texts(spark, sf):
    docs = I.read(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return K.single_rows(docs, "text").drop("text")


@query("win2_first_per_key", f"""
  SELECT row_id, ID, Product_CC_PL_RL FROM (
    SELECT *, row_number() OVER (PARTITION BY ID ORDER BY row_id) AS rn FROM {LEAD_SQL} t
    WHERE Product_CC_PL_RL IS NULL OR NOT regexp_matches(Product_CC_PL_RL, '^[A-Z]{{2}}L')) WHERE rn = 1""")
def win2(spark, sf):
    return leads.card_leads(lead(spark, sf)).select("row_id", "ID", "Product_CC_PL_RL")


@query("win3_later_rows", f"SELECT row_id, ID, Data_Mth FROM {_RANKED} r WHERE rn > 1")
def win3(spark, sf):
    df = leads.with_id(lead(spark, sf)).select("row_id", "ID", "Data_Mth")
    return K.later_rows(df, "ID", "Data_Mth", row_id="row_id")


@query("win4_repeated_rows", f"""
  SELECT row_id, Person FROM (SELECT row_id, Person, count(*) OVER (PARTITION BY Person) AS n
  FROM {I.EXTRACT.sql} t) WHERE n > 1""")
def win4(spark, sf):
    return K.repeated_rows(I.EXTRACT.frame(spark, sf).select("row_id", "Person"), "Person")


_REJ_CARDS = f"(SELECT * FROM {CARDS_SQL} t WHERE Branch_Code = 'REJ')"


@query("win5_latest_per_key", f"""
  SELECT ID, row_id, Result FROM (SELECT *, row_number() OVER (
    PARTITION BY ID ORDER BY ApproveDate DESC NULLS LAST, row_id) AS rn FROM {_REJ_CARDS} c) WHERE rn = 1""")
def win5(spark, sf):
    df = all_cards(spark, sf).filter("Branch_Code = 'REJ'").select("ID", "row_id", "Result", "ApproveDate")
    return K.latest_per_key(df, "ID", "ApproveDate", "row_id").drop("ApproveDate")


@query("win6_earliest_per_key", f"""
  SELECT ID, row_id, Result FROM (SELECT *, row_number() OVER (
    PARTITION BY ID ORDER BY ApproveDate ASC NULLS LAST, row_id) AS rn FROM {I.CC15.sql} c) WHERE rn = 1""")
def win6(spark, sf):
    df = I.CC15.frame(spark, sf).select("ID", "row_id", "Result", "ApproveDate")
    return K.earliest_per_key(df, "ID", "ApproveDate", "row_id").drop("ApproveDate")


@query("srt1_first_in_order", f"""
  SELECT ID, Data_Mth, row_id FROM {I.LEAD.sql} t ORDER BY ID ASC NULLS LAST, Data_Mth ASC NULLS LAST, row_id LIMIT 6""")
def srt1(spark, sf):
    return O.head(lead(spark, sf).select("ID", "Data_Mth", "row_id"), "ID", "Data_Mth", "row_id")


@query("srt2_sorted", f"""
  SELECT ID, strftime(ApproveDate, '%Y-%m-%d') AS ApproveDate, row_id,
    row_number() OVER (ORDER BY ID ASC NULLS LAST, t.ApproveDate DESC NULLS LAST, row_id) AS position
  FROM {CARDS_SQL} t""")
def srt2(spark, sf):
    # Positions make the order part of what is compared.
    df = all_cards(spark, sf).select("ID", "ApproveDate", "row_id")
    return (R.global_row_number(df, "ID", "-ApproveDate", "row_id", name="position")
            .withColumn("ApproveDate", F.date_format("ApproveDate", "yyyy-MM-dd")))


@query("srt4_top_frequencies", f"""
  SELECT Person, count(*) AS n FROM {I.EXTRACT.sql} t WHERE Product = 'CC' GROUP BY Person
  ORDER BY n DESC, Person ASC NULLS LAST LIMIT 6""")
def srt4(spark, sf):
    return cards.repeated_persons(I.EXTRACT.frame(spark, sf))


@query("set1_union_by_name", f"""
  SELECT row_id, ID, spending, CAST(NULL AS DOUBLE) AS DrawDown FROM {CARDS_SQL} c
  UNION ALL SELECT row_id, ID, NULL, DrawDown FROM {I.PL15.sql} p
  UNION ALL SELECT row_id, ID, NULL, DrawDown FROM {I.PL16.sql} q""")
def set1(spark, sf):
    cc = [t.frame(spark, sf).select("row_id", "ID", "spending") for t in (I.CC15, I.CC16)]
    pl = [t.frame(spark, sf).select("row_id", "ID", "DrawDown") for t in (I.PL15, I.PL16)]
    return A.union_by_name(*cc, *pl)


@query("set4_distinct", f"SELECT DISTINCT ID FROM {CARDS_SQL} t")
def set4(spark, sf):
    return all_cards(spark, sf).select("ID").distinct()


@query("q2_duplicate_profile", f"""
  WITH cells AS (SELECT Data_Mth_x = Data_Mth_y AS m, AGENT_SOURCE_CODE_x = AGENT_SOURCE_CODE_y AS s,
    Product_CC_PL_RL_x = Product_CC_PL_RL_y AS p FROM {PAIRS_SQL} t)
  SELECT 'month' AS comparison, CAST(m AS VARCHAR) AS first_flag, CAST(NULL AS VARCHAR) AS second_flag,
    count(*) AS n FROM cells GROUP BY m
  UNION ALL SELECT 'source', CAST(s AS VARCHAR), NULL, count(*) FROM cells GROUP BY s
  UNION ALL SELECT 'product', CAST(p AS VARCHAR), NULL, count(*) FROM cells GROUP BY p
  UNION ALL SELECT 'source_product', CAST(s AS VARCHAR), CAST(p AS VARCHAR), count(*) FROM cells GROUP BY s, p""")
def q2(spark, sf):
    profile = leads.duplicate_profile(lead(spark, sf))
    return profile.withColumns({c: F.col(c).cast("string") for c in ("first_flag", "second_flag")})


_CARD_LEADS = f"""(SELECT DISTINCT ID FROM {LEAD_SQL} t
  WHERE Product_CC_PL_RL IS NULL OR NOT regexp_matches(Product_CC_PL_RL, '^[A-Z]{{2}}L'))"""
_CARD_IDS = f"(SELECT DISTINCT ID FROM {I.CC15.sql} t)"


@query("q3_lead_card_match", f"""
  SELECT 'card_leads' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {_CARD_LEADS} a
  UNION ALL SELECT 'card_ids', CAST(count(*) AS DOUBLE) FROM {_CARD_IDS} b
  UNION ALL SELECT 'matched', CAST(count(*) AS DOUBLE) FROM {_CARD_LEADS} a JOIN {_CARD_IDS} b ON a.ID = b.ID""")
def q3(spark, sf):
    return leads.match_rate(lead(spark, sf), I.CC15.frame(spark, sf))


@query("q3_lead_card_rows", f"""
  SELECT l.row_id AS lead_row, c.row_id AS card_row, c.Result FROM
    (SELECT ID, min(row_id) AS row_id FROM {LEAD_SQL} t
     WHERE Product_CC_PL_RL IS NULL OR NOT regexp_matches(Product_CC_PL_RL, '^[A-Z]{{2}}L') GROUP BY ID) l
  LEFT JOIN {I.CC15.sql} c ON l.ID = c.ID""")
def q3_rows(spark, sf):
    joined = leads.lead_card_check(lead(spark, sf), I.CC15.frame(spark, sf))
    return joined.select(F.col("row_id_x").alias("lead_row"), F.col("row_id_y").alias("card_row"), "Result")


