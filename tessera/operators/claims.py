"""Claims of answers held against the references that the answers cite (E14): support by terms, links by keys, faithfulness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(values: Column) -> Column:
    """The distinct values of an array that are more than white space; null gives none."""
    return F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(F.trim(v) != "", F.lit(False))))


def judged(claims: DataFrame, references: DataFrame) -> DataFrame:
    """(case_id, claim, must, worded, supported, linked, reasons) of each claim.

    claims: (case_id, claim, text, terms, required, keys, must); references: (case_id, key, text). A claim is supported if
    each of its terms is in the text of a reference of its case, in whatever case of letters, and, where it requires
    references, one of them is cited. It is linked if it names a cited key. A claim without terms lacks none, and ``must``
    is true where it is null. A case is one answer, so its claims meet its few references by an equi-join on the case.
    """
    rows = claims.select("case_id", "claim", F.coalesce(F.trim("text") != "", F.lit(False)).alias("worded"), F.coalesce("must", F.lit(True)).alias("must"), F.array_distinct(F.transform(filled(F.col("terms")), F.lower)).alias("terms"), filled(F.col("required")).alias("required"), F.transform(filled(F.col("keys")), lambda k: F.trim(k)).alias("keys"))
    texts = references.select("case_id", F.lower("text").alias("body"))
    cited = references.where("trim(key) <> ''").select("case_id", F.trim("key").alias("key")).distinct()
    terms = rows.select("case_id", "claim", F.explode("terms").alias("term")).join(texts, "case_id").where(F.contains("body", "term"))
    found = terms.groupBy("case_id", "claim").agg(F.count_distinct("term").alias("found"))
    met = lambda name: rows.select("case_id", "claim", F.explode(name).alias("key")).join(cited, ["case_id", "key"], "left_semi").select("case_id", "claim", F.lit(True).alias(f"{name}_met")).distinct()
    rows = rows.join(found, ["case_id", "claim"], "left").join(met("required"), ["case_id", "claim"], "left").join(met("keys"), ["case_id", "claim"], "left")
    lacking = F.coalesce("found", F.lit(0)) < F.size("terms")
    unmet = (F.size("required") > 0) & F.col("required_met").isNull()
    reasons = F.array_compact(F.array(F.when(lacking, F.lit("missing_support_terms")), F.when(unmet, F.lit("required_reference_key_missing"))))
    return rows.select("case_id", "claim", "must", "worded", (~lacking & ~unmet).alias("supported"), F.col("keys_met").isNotNull().alias("linked"), F.array_join(reasons, ",").alias("reasons"))


def scores(cases: DataFrame, claims: DataFrame, references: DataFrame) -> DataFrame:
    """Of each case how its claims hold (E14), not rounded.

    cases: (case_id, answerable, infra, abstained, manual, judge). faithfulness is the share of the claims that must be
    supported and are; without any it is a manual score (of five if above one, held between 0 and 1), else a judge's, else
    null, and ``status`` tells which. citation_linkage is the share of cited keys that a claim names, claim_linkage the
    share of worded claims that name a cited key. After failures of the infrastructure citation_linkage is null; where the
    answer abstains or should have, it is 1 if nothing is cited and else 0.
    """
    one = judged(claims, references).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if("must").alias("must"),
        F.count_if(F.col("must") & F.col("supported")).alias("supported"),
        F.count_if("worded").alias("worded"),
        F.count_if(F.col("worded") & F.col("linked")).alias("linked"),
    )
    cited = references.where("trim(key) <> ''").select("case_id", F.trim("key").alias("key")).distinct()
    named = claims.select("case_id", F.explode(filled(F.col("keys"))).alias("key")).select("case_id", F.trim("key").alias("key"), F.lit(True).alias("named")).distinct()
    used = cited.join(named, ["case_id", "key"], "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("cited"), F.count("named").alias("justified"))
    rows = cases.join(one, "case_id", "left").join(used, "case_id", "left").na.fill(0, ["claims", "must", "supported", "worded", "linked", "cited", "justified"])
    manual = F.when(F.col("manual").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("manual") / F.when(F.col("manual") > 1, 5.0).otherwise(1.0))))  # both functions pass over nulls
    faith = F.when(F.col("must") > 0, F.col("supported") / F.col("must")).otherwise(F.coalesce(manual, F.col("judge")))
    status = F.when(F.col("must") > 0, "scored").when(F.col("manual").isNotNull(), "manual").when(F.col("judge").isNotNull(), "llm_judge").otherwise("unsupported")
    none, silent = F.col("cited") == 0, ~F.col("answerable") | F.col("abstained")
    citation = F.when(F.col("infra"), F.lit(None).cast("double")).when(silent, F.when(none, 1.0).otherwise(0.0)).when(none, 0.0).otherwise(F.col("justified") / F.col("cited"))
    claim = F.when(F.col("worded") > 0, F.col("linked") / F.col("worded")).when(~none, 0.0)
    return rows.select("case_id", "claims", F.col("must").alias("must_claims"), "supported", (F.col("must") - F.col("supported")).alias("unsupported"), faith.alias("faithfulness"), status.alias("status"), citation.alias("citation_linkage"), claim.alias("claim_linkage"))
