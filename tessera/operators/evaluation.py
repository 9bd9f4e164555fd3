"""Evaluation of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log2(x: Column) -> Column:
    return F.log2(x)


def ranked_with_gain(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """Rankings without repeats or blanks, first seen kept, with each key's relevance."""
    clean = rankings.where("trim(key) <> ''").withColumn("key", F.trim("key"))
    first = F.row_number().over(Window.partitionBy("case_id", "retriever", "key").orderBy("rank"))
    closed = F.row_number().over(Window.partitionBy("case_id", "retriever").orderBy("rank", "key"))
    rows = clean.withColumn("n", first).where("n = 1").withColumn("rank", closed.cast("long"))
    return rows.join(qrels.select("case_id", "key", "relevance"), ["case_id", "key"], "left").select("case_id", "retriever", "rank", "key", F.coalesce("relevance", F.lit(0)).alias("relevance"))


def metrics(rankings: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """recall, precision, hit, MRR and nDCG at k (E2, E3). Precision divides by what was returned, no more than k;
    a case without relevant keys scores 0. Nothing is rounded: means are taken of these."""
    rows = ranked_with_gain(rankings, qrels).where(F.col("rank") <= k)
    per = rows.groupBy("case_id", "retriever").agg(
        F.count(F.lit(1)).alias("returned"),
        F.count_if(F.col("relevance") > 0).alias("hits"),
        F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"),
        F.sum((F.pow(F.lit(2.0), F.col("relevance")) - 1) / log2(F.col("rank") + 1)).alias("dcg"),
    )
    order = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("relevance"), "key"))
    best = qrels.where("relevance > 0").withColumn("n", order)
    ideal = best.groupBy("case_id").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("n") <= k, (F.pow(F.lit(2.0), F.col("relevance")) - 1) / log2(F.col("n") + 1))).alias("idcg"))
    rows = per.join(ideal, "case_id", "left")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.select(
        "case_id",
        "retriever",
        ratio(F.col("hits"), F.coalesce("relevant", F.lit(0))).alias("recall"),
        ratio(F.col("hits"), F.col("returned")).alias("precision"),
        (F.col("hits") > 0).alias("hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        ratio(F.col("dcg"), F.coalesce("idcg", F.lit(0.0))).alias("ndcg"),
    )


def shown(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Rows with their doubles rounded, for the last step."""
    return rows.select([F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


def percentiles(latency: DataFrame) -> DataFrame:
    """Nearest-rank and interpolated percentiles of each retriever's latency."""
    return latency.groupBy("retriever").agg(
        F.expr("percentile_disc(0.5) within group (order by ms)").alias("p50"),
        F.expr("percentile_disc(0.95) within group (order by ms)").alias("p95"),
        F.round(F.expr("percentile_cont(0.95) within group (order by ms)"), 6).alias("p95_interpolated"),
        F.count(F.lit(1)).alias("n"),
    )


Setting = tuple[int, int, float, float]


def grid(ks: list[int], weights: list[tuple[float, float]]) -> list[Setting]:
    """All settings of a grid, numbered: constant, weights of the vector and of the keyword list."""
    return [(i, k, a, b) for i, (k, (a, b)) in enumerate((k, w) for k in ks for w in weights)]


def simplicity(setting: Setting) -> int:
    """How near a setting is to the vector list alone and to the usual constant; ties go to the higher."""
    _, k, a, b = setting
    return round(a * 40 + (1 - min(b, 1.0)) * 20 + 10 / (1 + abs(k - 60)))


def grid_search(rankings: DataFrame, qrels: DataFrame, settings: list[Setting], k: int = 10) -> DataFrame:
    """Mean MRR, nDCG and recall at k of each fusion setting over all cases, and in how many cases its MRR is below that
    of the vector list alone (E7).

    The settings are a short stated list, so each hit carries them as an array; a hit's share under every setting
    is summed by key before anything is ranked.
    """
    options = F.array(*[F.struct(F.lit(i).alias("config"), F.lit(c).alias("c"), F.lit(a).alias("w0"), F.lit(b).alias("w1")) for i, c, a, b in settings])
    hits = rankings.select("case_id", "list_idx", "rank", "key").where("list_idx < 2")
    parts = hits.select("case_id", "key", "list_idx", "rank", F.explode(options).alias("o"))
    part = F.when(F.col("list_idx") == 0, F.col("o.w0")).otherwise(F.col("o.w1")) / (F.col("o.c") + F.col("rank"))
    fused = parts.groupBy("case_id", F.col("o.config").alias("config"), "key").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    order = F.row_number().over(Window.partitionBy("case_id", "config").orderBy(F.desc("score"), "key"))
    ranked = fused.withColumn("rank", order.cast("long")).where(F.col("rank") <= k).withColumn("retriever", F.col("config").cast("string"))
    per = metrics(ranked.select("case_id", "retriever", "rank", "key"), qrels, k)
    alone = metrics(rankings.where("list_idx = 0").select("case_id", F.lit("vector").alias("retriever"), "rank", "key"), qrels, k)
    per = per.join(alone.select("case_id", F.col("mrr").alias("vector_mrr")), "case_id", "left")
    means = [F.round(F.avg(m), 5).alias(m) for m in ("mrr", "ndcg", "recall")]
    worse = F.count_if(F.col("mrr") + 1e-9 < F.col("vector_mrr")).alias("regressions")
    return per.groupBy(F.col("retriever").cast("int").alias("config")).agg(*means, worse, F.count(F.lit(1)).alias("cases"))


def baseline(rankings: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Mean MRR and recall of the vector list alone, in one row."""
    alone = metrics(rankings.where("list_idx = 0").select("case_id", F.lit("vector").alias("retriever"), "rank", "key"), qrels, k)
    return alone.agg(F.round(F.avg("mrr"), 5).alias("b_mrr"), F.round(F.avg("recall"), 5).alias("b_recall"))


def chosen(scores: DataFrame, vector: DataFrame, settings: list[Setting], slack: float = 0.05, near: float = 0.01) -> DataFrame:
    """Settings with the reasons that speak against them, their place among those without, and the one selected.

    No setting without a keyword weight is one of a fusion. The best has the greatest MRR, then nDCG; among those that
    come near it in both, fewer regressions decide, then simplicity, a constant near 60, and the name. There may be
    none. The settings are a short stated list.
    """
    spark = scores.sparkSession
    rows = [(i, k, b, simplicity(s), f"rrf_k{k}_d{a:g}_kw{b:g}") for s in settings for i, k, a, b in [s]]
    known = spark.createDataFrame(rows, "config int, k int, w1 double, simple int, name string")
    rows = known.join(scores, "config", "left").join(F.broadcast(vector), F.lit(True))  # one row
    reasons = F.array_compact(
        F.array(
            F.when(F.col("w1") <= 0, "degenerate_keyword_weight_zero"),
            F.when(F.col("mrr").isNull() | F.col("recall").isNull(), "missing_metrics"),
            F.when(F.col("recall") + 1e-12 < F.col("b_recall") - slack, "recall@10_below_vector_gate"),
            F.when(F.col("mrr") + 1e-12 < F.col("b_mrr") - slack, "mrr@10_below_vector_gate"),
        )
    )
    rows = rows.withColumn("reasons", F.array_join(reasons, ",")).withColumn("open", F.col("reasons") == "")
    last = [F.asc("regressions"), F.desc("simple"), F.abs(F.col("k") - 60), F.asc("name")]
    groups = Window.partitionBy("open")
    rows = rows.withColumn("position", F.row_number().over(groups.orderBy(F.desc("mrr"), F.desc("ndcg"), *last)).cast("long"))
    best = lambda m: F.first(m).over(groups.orderBy("position"))
    close = (F.abs(F.col("mrr") - best("mrr")) <= near) & (F.abs(F.col("ndcg") - best("ndcg")) <= near)
    rows = rows.withColumn("close", close)
    first = F.row_number().over(Window.partitionBy("open", "close").orderBy(*last)) == 1
    selected = F.col("open") & F.col("close") & first
    return rows.select("config", "reasons", F.when(F.col("open"), F.col("position")).alias("position"), F.coalesce(selected, F.lit(False)).alias("selected"))


def failures(cases: DataFrame, per_case: DataFrame, hybrid: DataFrame, qrels: DataFrame, k: int = 10, slack: float = 1e-9) -> DataFrame:
    """Why a case fails, by ordered rules over three retrievers' results; null if it doesn't.

    cases: (case_id, comparable, answerable); hybrid: (case_id, rank, key), without repeats. A key's source is what
    stands before its first colon; the first graded hit should be of a source that has a most relevant key.
    """
    parts = [F.max(F.when(F.col("retriever") == r, F.col(m))).alias(f"{m}_{r}") for r in ("keyword", "vector", "hybrid") for m in ("hit", "mrr")]
    wide = per_case.groupBy("case_id").agg(*parts)
    source = lambda c: F.substring_index(c, ":", 1)
    top = qrels.withColumn("most", F.max("relevance").over(Window.partitionBy("case_id"))).where("relevance = most")
    top = top.groupBy("case_id").agg(F.collect_set(source("key")).alias("wanted"))
    graded = hybrid.where(F.col("rank") <= k).join(qrels.select("case_id", "key"), ["case_id", "key"])
    first = graded.groupBy("case_id").agg(F.min_by(source("key"), "rank").alias("found"))
    rows = cases.join(wide, "case_id", "left").join(top, "case_id", "left").join(first, "case_id", "left")
    words, dense, both = (F.coalesce(f"hit_{r}", F.lit(False)) for r in ("keyword", "vector", "hybrid"))
    mrr = lambda r: F.coalesce(f"mrr_{r}", F.lit(0.0))
    kind = (
        F.when(~F.col("comparable"), "unsupported_comparison")
        .when(~F.col("answerable"), None)
        .when(~both & ~words & ~dense, "all_retrievers_missed")
        .when(~both & words & ~dense, "keyword_only_hit")
        .when(~both & dense & ~words, "vector_only_hit")
        .when(~both, "fusion_regression")
        .when(mrr("hybrid") + slack < F.greatest(mrr("keyword"), mrr("vector")), "rank_regression")
        .when(F.col("found").isNotNull() & ~F.array_contains("wanted", F.col("found")), "wrong_source")
    )
    return rows.select("case_id", kind.alias("failure"))


def winners(per_case: DataFrame) -> DataFrame:
    """Each case's retrievers with the best MRR."""
    best = F.max("mrr").over(Window.partitionBy("case_id"))
    return per_case.withColumn("best", best).where(F.col("mrr") >= F.col("best") - 1e-12).select("case_id", "retriever", "mrr")


def winner(report: DataFrame) -> DataFrame:
    """Which retriever leads a layer by its mean MRR (E11): none if several do, nor if there is nothing to compare.

    report: (layer, retriever, denominator, mrr).
    """
    whole = report.groupBy("layer").agg(F.min("denominator").alias("least"), F.max("mrr").alias("best"), F.count_if(F.col("mrr").isNull()).alias("missing"))
    rows = report.join(whole, "layer").groupBy("layer").agg(
        F.first((F.col("least") > 0) & (F.col("missing") == 0)).alias("ok"),
        F.array_sort(F.collect_list(F.when(F.abs(F.col("mrr") - F.col("best")) < 1e-12, F.col("retriever")))).alias("leaders"),  # a few retrievers
    )
    known = F.coalesce("ok", F.lit(False))
    lead = F.when(known & (F.size("leaders") == 1), F.element_at("leaders", 1))
    return rows.select("layer", F.when(known, "ok").otherwise("unavailable").alias("status"), lead.alias("winner"), F.when(known, F.array_join("leaders", ",")).otherwise("").alias("leaders"))


def stable(runs: DataFrame, precision_floor: float = 0.70) -> DataFrame:
    """Whether all runs of a case are good enough (E15): found, covered, all of the gold matched, few others.

    runs: (case_id, run, recall, precision, covered, found, ok).
    """
    good = F.col("ok") & F.col("covered") & F.col("found") & (F.col("recall") >= 1.0) & (F.col("precision") >= precision_floor)
    return runs.groupBy("case_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("stable"), F.count_if(good).alias("good_runs"))


def agreement(runs: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of a case's runs, two empty runs alike (E15). runs: (case_id, run, keys)."""
    a, b = runs.alias("a"), runs.alias("b")
    pairs = a.join(b, (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.run") < F.col("b.run")))
    both = F.size(F.array_intersect("a.keys", "b.keys"))
    total = F.size(F.array_union("a.keys", "b.keys"))
    return pairs.select(F.col("a.case_id").alias("case_id"), F.when(total == 0, 1.0).otherwise(both / total).alias("j"), (F.size(F.array_except("a.keys", "b.keys")) + F.size(F.array_except("b.keys", "a.keys")) == 0).alias("same")).groupBy("case_id").agg(F.round(F.avg("j"), 6).alias("jaccard"), F.bool_and("same").alias("all_equal"))


def coverage(judged: DataFrame, asked: DataFrame) -> DataFrame:
    """Keys a judge left out, doubled or made up."""
    seen = judged.groupBy("case_id", "key").agg(F.count(F.lit(1)).alias("times"))
    rows = asked.select("case_id", "key", F.lit(True).alias("asked")).join(seen, ["case_id", "key"], "full")
    return rows.groupBy("case_id").agg(F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("asked").isNull()).alias("unknown"), F.count_if(F.col("times") > 1).alias("duplicates"))


def facet_support(scopes: DataFrame, needed: DataFrame) -> DataFrame:
    """Whether a scope holds all facets that a case needs, and which it lacks."""
    have = scopes.groupBy("case_id").agg(F.collect_set("facet").alias("have"))
    want = needed.groupBy("case_id").agg(F.collect_set("facet").alias("want"))
    rows = want.join(have, "case_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    lacks = F.array_sort(F.array_except("want", "have"))
    return rows.select("case_id", F.array_join(lacks, ",").alias("lacks"), (F.size(lacks) == 0).alias("supported"))


def batches(keys: DataFrame, size: int = 8) -> DataFrame:
    """Fixed-size batches of a case's keys in order."""
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("key"))
    return keys.withColumn("batch", F.floor((n - 1) / size).cast("long"))
