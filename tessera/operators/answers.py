"""Evidence, citations, budgets and scores of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.folds import folded


def topic(tokens: Column, dropped: list[str]) -> Column:
    """A canonical topic: tokens of two characters or more that are no operator words, sorted, by a bar."""
    kept = F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(*dropped))
    return F.array_join(F.array_sort(F.array_distinct(kept)), "|")


#: Stands for an occurrence of a term that can overlap itself, in a text where it stands for nothing else.
MARK = "\ue000"


def overlapping(term: str) -> bool:
    """Whether two occurrences of a term can share characters: its start is also its end."""
    return any(term.endswith(term[:n]) for n in range(1, len(term)))


def hit_windows(text: Column, terms: list[str] | Column, around: int = 180, most: int = 3) -> Column:
    """The text around places where terms occur, first ones first, as long as they don't overlap (R12). Without any
    place the text's opening; none of an empty text. Occurrences of one term don't overlap. Terms are in lower case, and
    the same for all rows or an array of each row's own.

    One fold goes from window to window with the next place of any term as its state; terms are values in it, so the
    plan doesn't grow with terms or windows, and a text is read no further than its last window asks for.
    """
    # What can overlap itself is marked first, so that looking from any place finds only whole, separate occurrences.
    own = isinstance(terms, Column)
    plain = [] if own else [t for t in terms if t and not overlapping(t)]
    marked = [] if own else [t for t in terms if t and overlapping(t)]
    pair = lambda hay, needle: F.struct(hay.alias("hay"), F.lit(needle).alias("needle"))
    low = lambda whole: F.translate(whole, MARK, " ")
    said = lambda whole: [pair(whole, t) for t in plain] + [pair(F.replace(low(whole), F.lit(t), F.lit(MARK + " " * (len(t) - 1))), MARK) for t in marked]
    opening = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(F.substring(text, 1, 2 * around)))
    if not own and not plain and not marked:
        return opening

    def found(hays: Column) -> Column:
        def next_place(start: Column) -> Column:
            """The first place at or after a place, counted from 0, or null."""
            return F.array_min(F.filter(F.transform(hays, lambda h: F.call_function("locate", h["needle"], h["hay"], (start + 1).cast("int"))), lambda p: p > 0)) - 1

        def step(at: Column, _: Column) -> Column:
            begin, end = F.greatest(at["place"] - around, F.lit(0)), F.least(at["place"] + around, F.length(text))
            window = F.array_append(at["windows"], F.substring(text, begin + 1, end - begin))
            return F.when(at["place"].isNull(), at).otherwise(F.struct(next_place(end + around).alias("place"), window.alias("windows")))

        start = F.struct(next_place(F.lit(0)).alias("place"), F.array().cast("array<string>").alias("windows"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda at: at["windows"])

    def hays(whole: Column) -> Column:
        if not own:
            return F.array(*said(whole))
        mark = lambda t: F.replace(low(whole), t, F.concat(F.lit(MARK), F.repeat(F.lit(" "), F.length(t) - 1)))
        return F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.struct(mark(t).alias("hay"), F.lit(MARK).alias("needle")))

    # Arrays of one element bind what they hold: the lower case and the marked texts are made once for each text.
    windows = F.element_at(F.transform(F.array(tx.lower(text)), lambda whole: F.element_at(F.transform(F.array(hays(whole)), found), 1)), 1)
    return F.element_at(F.transform(F.array(windows), lambda w: F.when(F.size(w) > 0, w).otherwise(opening)), 1)


def as_array(terms: list[str] | Column) -> Column:
    if isinstance(terms, Column):
        return F.coalesce(terms, F.array().cast("array<string>"))
    return F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")


def term_hits(low: Column, terms: list[str] | Column) -> Column:
    """How many of the terms occur in a text in lower case."""
    return F.size(F.filter(as_array(terms), lambda t: F.contains(low, t)))


def judge_evidence(rows: DataFrame, terms: list[str] | None, budget: int = 1400, whole: int = 400, opening: int = 160, most: int = 3, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """What a judge is shown of a candidate (R14), within a budget of 1200 to 1600 characters.

    A short text is shown whole. A long one that only a vector search found, with none of the terms, is shown in equal
    segments spread over it. Any other is shown by its opening and windows around the terms. rows: (id, title, text,
    dense). Terms of one character don't count. Without terms for all, each row has its own: terms, an array.
    """
    budget = min(1600, max(1200, budget))
    if terms is not None:
        terms = list(dict.fromkeys(t.strip().lower() for t in terms if len(t.strip()) > 1))
    else:
        clean = F.filter(F.transform(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: F.length(t) > 1)
        rows, terms = rows.withColumn("terms", F.array_distinct(clean)), F.col("terms")
    carried = ["terms"] if isinstance(terms, Column) else []
    bound = rows.select(*keep, *carried, "dense", tx.public_title(F.col("title")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    bound = bound.withColumn("both", F.concat_ws("\n", "title", "text")).withColumn("size", F.length("text"))
    bound = bound.withColumns({"low_title": F.lower("title"), "low_text": F.lower("text"), "low": F.lower("both")})
    bound = bound.withColumns({"title_hits": term_hits(F.col("low_title"), terms), "body_hits": term_hits(F.col("low_text"), terms)})
    counted = F.aggregate(as_array(terms), F.lit(0).cast("long"), lambda n, t: n + tx.occurrences(F.col("low"), t))
    mode = (
        F.when((F.col("size") > 0) & (F.col("size") <= whole), "short_full_body")
        .when((F.col("title_hits") + F.col("body_hits") == 0) & F.col("dense") & (F.col("size") > whole), "dense_stratified_segments")
        .otherwise("title_opening_windows")
    )
    starts = tx.anchors(F.col("text"), budget)
    length = tx.segment(budget)
    segments = F.array_join(F.transform(starts, lambda s: F.substring(F.col("text"), s.cast("int") + 1, F.lit(length))), " … ")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.concat(F.array(strip(F.substring("text", 1, opening))), F.transform(hit_windows(F.col("both"), terms, most=most), strip))
    joined = F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " … ")
    shown = F.when(F.col("mode") == "short_full_body", F.col("text")).when(F.col("mode") == "dense_stratified_segments", segments).otherwise(joined)
    rows = bound.withColumn("mode", mode).withColumn("shown", shown)
    part = F.least(F.length("evidence"), F.col("size")) / F.col("size")
    share = F.when((F.col("mode") == "short_full_body") | (F.col("size") == 0), 1.0).when(F.col("mode") == "dense_stratified_segments", tx.covered(starts, F.col("size"), length)).otherwise(F.round(part, 4))
    return rows.withColumn("evidence", F.substring("shown", 1, budget)).select(*keep, "mode", "title_hits", "body_hits", counted.cast("long").alias("term_hits"), share.alias("coverage"), F.col("evidence"))


def relevance_reason(title_hit: Column, body_hit: Column, hits: Column, coverage: Column) -> Column:
    """What a reader is told of why a candidate is relevant (F20). The wordings are fixed values."""
    return (
        F.when(title_hit, "标题直接命中检索主题")
        .when(body_hit & (hits >= 2), "正文多处涉及检索主题")
        .when(body_hit, "正文包含相关内容")
        .when(coverage >= 0.5, "内容较完整地覆盖检索主题")
        .otherwise("内容与检索主题相关")
    )


# Claims that a list is complete, what stands in for them, and what a filtered list says first.
EXHAUSTIVE = (
    "全部相关(的)?(记录|结果|内容|条目)?",
    "所有相关(的)?(记录|结果|内容|条目)?",
    "完整列出",
    "完整罗列",
    "列出全部",
    "列出所有",
    "全部列出",
    "所有列出",
    "无一遗漏",
    "完整清单",
    "全部(的)?(记录|结果|提示词|(?i:prompt))",
    "所有(的)?(记录|结果|提示词|(?i:prompt))",
)
SOME, PREFACE = "相关记录", "为你筛选到以下相关记录"


def scoped(answer: Column, intent: Column, scope: Column) -> Column:
    """An answer that doesn't call a list complete which a budget has cut."""
    text = tx.stripped(F.coalesce(answer, F.lit("")))
    plain = text
    for claim in EXHAUSTIVE:
        plain = F.regexp_replace(plain, claim, SOME)
    plain = F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), "^[ ，,。]+|[ ，,。]+$", "")
    said = F.when(F.contains(plain, F.lit(PREFACE)), plain).when(plain == "", PREFACE + "。").otherwise(F.concat(F.lit(PREFACE + "。\n"), plain))
    return F.when((intent == "lookup_all") & (scope == "budget_filtered"), said).otherwise(text)


def strength(title_hit: Column, hits: Column, coverage: Column) -> Column:
    """Orders candidates of one level: title hits, then term hits up to 32, then coverage."""
    return F.struct(title_hit.cast("int").alias("title"), F.least(hits, F.lit(32)).alias("hits"), coverage.alias("coverage"))


def body(header: Column, text: Column, chars: int = 4000) -> Column:
    return F.substring(F.concat_ws("\n", header, text), 1, chars)


def cascade(lists: DataFrame) -> DataFrame:
    """Of each query's channels only the first that found anything."""
    first = F.min("priority").over(Window.partitionBy("query_id"))
    return lists.withColumn("first", first).where("priority = first").drop("first")


def citations(answers: DataFrame, sources: Column) -> DataFrame:
    """Aliases in an answer, renumbered by first appearance; unknown ones and missing ones are errors."""
    used = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\[S([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int")))
    rows = answers.withColumn("used", used).withColumn("sources", sources)
    known = F.filter("used", lambda i: (i >= 1) & (i <= F.col("sources")))
    code = F.when(F.size("used") == 0, "missing").when(F.size(known) < F.size("used"), "unknown").otherwise("ok")
    return rows.select("query_id", F.array_join(F.transform(known, lambda i: i.cast("string")), ",").alias("cited"), F.size(known).cast("long").alias("n"), code.alias("code"), ((code == "ok") | (F.col("sources") == 0)).alias("grounded"))


def packed_groups(units: DataFrame, most: int = 6000, extra: int = 16) -> DataFrame:
    """Units in order, packed into groups that hold no more than a number of characters.

    A group takes units until the next would not fit; a unit too long for any is a group of its own.
    """

    def step(held: tuple[int, int], row: dict) -> tuple[tuple[int, int], dict]:
        group, used = held
        need = row["size"] + extra
        group, used = (group + 1, need) if used and used + need > most else (group, used + need)
        return (group, used), {"query_id": row["query_id"], "id": row["id"], "group": group}

    return folded(units.select("query_id", "rank", "id", "size"), ["query_id"], ["rank", "id"], lambda: (0, 0), step, "query_id long, id long, `group` long")


def skipping_budget(units: DataFrame, most: int = 16_000, count: int = 20) -> DataFrame:
    """Units in order while they fit; one that doesn't fit is skipped and later ones still get their chance.

    Reserved units come first, and the result keeps the input order.
    """

    def step(held: tuple[int, int], row: dict) -> tuple[tuple[int, int], dict | None]:
        n, used = held
        if n >= count or used + row["size"] > most:
            return held, None
        return (n + 1, used + row["size"]), {k: row[k] for k in ("query_id", "rank", "id", "size")}

    rows = units.select("query_id", "rank", "id", "size", (~F.col("reserved")).alias("later"))
    return folded(rows, ["query_id"], ["later", "rank", "id"], lambda: (0, 0), step, "query_id long, rank long, id long, size long")


def best_attempts(pairs: DataFrame) -> DataFrame:
    """Primary or fallback extraction (F9): eligible, then quality, then score, then confidence, then more characters;
    scores that differ by no more than 1e-9 tie, and a full tie keeps the primary.

    pairs: (id, p, f) with structs of eligible, quality, score, confidence, chars.
    """
    rank = lambda s: F.when(s["quality"] == "ok", 4).when(s["quality"] == "low", 2).when(s["quality"] == "unusable", 1).otherwise(0)
    p, f = F.col("p"), F.col("f")
    sure = lambda s: F.coalesce(s["confidence"], F.lit(-1.0))
    fallback = (
        F.when(p["eligible"] != f["eligible"], f["eligible"])
        .when(rank(p) != rank(f), rank(f) > rank(p))
        .when(F.abs(p["score"] - f["score"]) > 1e-9, f["score"] > p["score"])
        .when(sure(p) != sure(f), sure(f) > sure(p))
        .otherwise(f["chars"] > p["chars"])
    )
    return pairs.select("id", F.when(fallback, "fallback").otherwise("primary").alias("chosen"))


def image_rollup(chunks: DataFrame, version: str) -> DataFrame:
    """An attachment's state from its chunks (A17): succeeded if any text chunk did, else the last caption's status."""
    text = F.col("modality") == "ocr"
    status = F.when(F.bool_or(text & (F.col("status") == "succeeded")), "succeeded").otherwise(F.max_by(F.when(~text, F.col("status")), F.when(~text, F.col("chunk_index"))))
    rows = chunks.groupBy("attachment_id").agg(status.alias("status"), F.max_by("provider", "chunk_index").alias("provider"), F.bool_or(F.col("version") != version).alias("reindex_required"), F.array_sort(F.collect_list(F.struct("chunk_index", "method"))).alias("ms"))
    return rows.select("attachment_id", "status", "provider", "reindex_required", F.array_join(F.array_distinct(F.col("ms.method")), ",").alias("methods"))


def layer_metrics(layers: DataFrame, qrels: DataFrame) -> DataFrame:
    """Recall and precision of the keys that reach each layer, from retrieval to use."""
    got = layers.select("case_id", "layer", "key").distinct().join(qrels.select("case_id", "key", F.lit(1).alias("good")), ["case_id", "key"], "left")
    per = got.groupBy("case_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("hits"))
    whole = qrels.groupBy("case_id").agg(F.count(F.lit(1)).alias("relevant"))
    return per.join(whole, "case_id", "left").select("case_id", "layer", F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"), F.round(F.col("hits") / F.col("n"), 6).alias("precision"))


def case_scores(cases: DataFrame) -> DataFrame:
    """Citation precision and recall of a case (E14): nothing is known of infrastructure failures; a case without
    relevant keys has no recall, and precision 1 if it cites nothing. cases: (case_id, answerable, infra, cited, relevant, hits)."""
    none = F.lit(None).cast("double")
    precision = F.when(F.col("infra"), none).when((F.col("relevant") == 0) | ~F.col("answerable"), F.when(F.col("cited") == 0, 1.0).otherwise(0.0)).when(F.col("cited") == 0, 0.0).otherwise(F.col("hits") / F.col("cited"))
    recall = F.when(F.col("infra") | (F.col("relevant") == 0) | ~F.col("answerable"), none).otherwise(F.col("hits") / F.col("relevant"))
    code = F.when(F.col("infra"), "infra").when(~F.col("answerable") & (F.col("cited") > 0), "should_abstain").when(F.col("answerable") & (F.col("cited") == 0), "missing_citation").otherwise("")
    return cases.select("case_id", precision.alias("precision"), recall.alias("recall"), code.alias("failure"))


def report(scores: DataFrame) -> DataFrame:
    """Means without nulls, and how often each failure occurs."""
    return scores.groupBy("failure").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"))


def qrels_cleaned(qrels: DataFrame) -> DataFrame:
    """Judgments with a valid grade and a key of their type, the highest of each key."""
    ok = F.col("relevance").between(1, 3) & F.startswith("key", F.concat(F.col("source_type"), F.lit(":")))
    return qrels.where(ok).groupBy("case_id", "key").agg(F.max("relevance").alias("relevance"))
