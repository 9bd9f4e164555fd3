"""Answers rewritten around matches (F16, P16): citations get public numbers, internal fields and set phrases go.

A text is split into what a pattern matches and what lies between; matches are mapped on their own and both are put
together again, so nothing that was put in can be matched once more. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms of aliases and citations, what no answer may show, the word for "nothing found", and limits.
CITED = r"〔(S[1-9]\d*)〕"
BARE = r"(?U)\bS[1-9]\d*\b"
BARE_OUTSIDE = r"(?U)(?<!〔)\bS[1-9]\d*\b(?!〕)"
OTHER_BRACKETS = r"(?U)(?:\[|【|［)\s*(S[1-9]\d*)\s*(?:\]|】|］)"
LABEL = (r"(?Umd)^(\s*[-*]\s*)(?:\*\*)?", r"(?:\*\*)?\s*[：:]\s*")
INTERNAL = r"(?i)(?:reference_key|chunk_id|entry_id|attachment_id|source_id|todo_id|root_todo_id|family_root_todo_id|[a-z]:\\|/app/|/opt/|\\uploads\\|/uploads/)"
NOTHING = "__NO_RELEVANT_SOURCES__"
MOST_CHARS, MOST_CITED = 12_000, 40
# Internal fields in answers, and openings that tell of a search.
FIELD = r"(?Ui)\b(entry_id|chunk_id|source_type|source_id|reference_key|metadata|valid_references|invalid_references|valid_entry_ids|invalid_entry_ids|retrieval_method|relevance_score)\b"
ASSIGNED = r"(?Ui)\b(entry_id|chunk_id|source_type|source_id|reference_key)\s*=\s*\S+"
LABELLED = r"(?Ui)\b(entry_id|chunk_id|source_type|source_id|reference_key|valid_references|invalid_references)\b\s*[:=]?\s*"
FENCE = r"(?Ui)```(?:json|javascript|js|python)?\s*"
JSON_LINE = r'(?U)^\s*[\[{].*[\]}]\s*$|^\s*"[^"]+"\s*:\s*'
OPENINGS = (
    r"根据您的参考笔记[，,、]?\s*",
    r"根据你的参考笔记[，,、]?\s*",
    r"根据参考笔记[，,、]?\s*",
    r"根据检索结果[，,、]?\s*",
    r"根据您的检索结果[，,、]?\s*",
    r"根据工具结果[，,、]?\s*",
    r"基于以上参考笔记[，,、]?\s*",
    r"基于参考笔记[，,、]?\s*",
    r"基于检索结果[，,、]?\s*",
    r"我找到了\s*\d+\s*条(?:相关)?记录[，,、。]?\s*",
    r"我找到了以下几条记录[：:，,]?\s*",
    r"在您的参考笔记中[，,、]?\s*",
    r"从检索到的记录来看[，,、]?\s*",
    r"根据系统检索到的内容[，,、]?\s*",
)
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def around(text: Column, pattern: str, told: Callable[[Column], Column]) -> Column:
    """The text with each match replaced by what ``told`` makes of it. The pattern matches no empty string."""
    spans, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pieces = F.zip_with(between, spans, lambda b, s: F.concat(b, F.coalesce(told(s), F.lit(""))))
    return F.array_join(pieces, "")


def unfenced(text: Column) -> Column:
    """An answer without the code fence around the whole of it."""
    text = trimmed(text)
    lines = F.split(text, LINE_ENDS)
    lines = F.when((F.size(lines) >= 2) & F.startswith(trimmed(F.get(lines, F.lit(0))), F.lit("```")), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    lines = F.when((F.size(lines) > 0) & (trimmed(F.element_at(lines, -1)) == "```"), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    fenced = F.startswith(text, F.lit("```")) & F.endswith(text, F.lit("```"))
    return F.when(fenced, trimmed(F.array_join(lines, "\n"))).otherwise(text)


def renumbered(answers: DataFrame, chars: int = MOST_CHARS, most: int = MOST_CITED) -> DataFrame:
    """The rows with their answer's ``code``, and if that is 'ok' the ``public`` answer and the ``cited`` aliases (F16).

    answers: (answer, allowed array of aliases, ...). Citations in other brackets, labels of list items and aliases that
    stand alone are brought to one form first; aliases get numbers from 1 as they first appear. Codes, first that holds:
    'empty', 'too_long', 'internal_field', 'mixed' (nothing found, yet cited), 'unknown_alias', 'missing', 'over_limit',
    'alias_format', 'public_invalid'. An answer that nothing was found is 'ok' and empty. Null allows no alias.
    """
    allowed = F.coalesce(F.col("allowed"), F.array().cast("array<string>"))
    bare = lambda c: F.regexp_replace(c, CITED, "")
    rows = answers.withColumn("_text", unfenced(F.coalesce("answer", F.lit(""))))
    rows = rows.withColumn("_one", F.regexp_replace("_text", OTHER_BRACKETS, "〔$1〕"))
    rows = rows.withColumn("_one", F.aggregate(allowed, F.col("_one"), lambda text, a: F.regexp_replace(text, F.concat(F.lit(LABEL[0]), a, F.lit(LABEL[1])), F.lit("$1"))))
    rows = rows.withColumn("_one", around(F.col("_one"), BARE_OUTSIDE, lambda a: F.when(F.array_contains(allowed, a), F.concat(F.lit("〔"), a, F.lit("〕"))).otherwise(a)))
    rows = rows.withColumn("_cited", F.array_distinct(F.regexp_extract_all("_one", F.lit(CITED), F.lit(1))))
    number = lambda s: F.concat(F.lit("〔"), F.array_position(F.col("_cited"), F.regexp_extract(s, CITED, 1)).cast("string"), F.lit("〕"))
    rows = rows.withColumn("_public", trimmed(around(F.col("_one"), CITED, number)))
    nothing, rest = F.contains(F.col("_text"), F.lit(NOTHING)), F.replace(F.col("_text"), F.lit(NOTHING), F.lit(""))
    code = (
        F.when(F.col("_text") == "", "empty")
        .when(F.length("_text") > chars, "too_long")
        .when(F.col("_text").rlike(INTERNAL), "internal_field")
        .when(nothing & rest.rlike(BARE), "mixed")
        .when(nothing, "ok")
        .when(F.size(F.array_except("_cited", allowed)) > 0, "unknown_alias")
        .when(F.size("_cited") == 0, "missing")
        .when(F.size("_cited") > most, "over_limit")
        .when(bare(F.col("_one")).rlike(BARE), "alias_format")
        .when((F.col("_public") == "") | F.col("_public").rlike(INTERNAL), "public_invalid")
        .otherwise("ok")
    )
    rows = rows.withColumn("code", code).withColumn("_none", nothing)
    fine = F.col("code") == "ok"
    return rows.withColumn("public", F.when(fine & F.col("_none"), "").when(fine, F.col("_public"))).withColumn("cited", F.when(fine & F.col("_none"), F.array().cast("array<string>")).when(fine, F.col("_cited"))).drop("_text", "_one", "_cited", "_public", "_none")


def internal_line(line: Column) -> Column:
    """Whether a line tells of internal fields and nothing else."""
    bare = trimmed(line)
    marked = F.substring(bare, 1, 1).isin("-", "*", "{", "[") | F.contains(bare, F.lit(":")) | F.contains(bare, F.lit("=")) | bare.rlike(JSON_LINE)
    return bare.rlike(ASSIGNED) | (bare.rlike(FIELD) & marked)


def cleaned(text: Column) -> Column:
    """An answer without fences, internal fields and openings that tell of a search (P16); what would be empty stays. Null
    gives an empty text."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.replace(F.regexp_replace(whole, FENCE, ""), F.lit("```"), F.lit(""))
    plain = F.array_join(F.filter(F.split(plain, LINE_ENDS), lambda line: ~internal_line(line)), "\n")
    plain = F.regexp_replace(F.regexp_replace(plain, ASSIGNED, ""), LABELLED, "")
    for opening in OPENINGS:  # the first of each kind only
        plain = F.regexp_replace(plain, rf"(?Us)\A(.*?){opening}", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?U)\A[\s，,、：:。]+", ""), r"[ \t]{2,}", " ")
    plain = trimmed(F.regexp_replace(plain, r"\n{3,}", "\n\n"))
    return F.when(trimmed(whole) == "", whole).when(plain == "", trimmed(whole)).otherwise(plain)
