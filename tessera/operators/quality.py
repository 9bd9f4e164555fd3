"""Statistics, profile and verdict of extracted text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import bounded_batches

# Classes of characters and sequences that tell of wrongly decoded text. MOJIBAKE has the same matches as
# the longer list of two-character sequences that it stands for.
CODE_SYMBOLS = set("{}[]()<>=;*/|&@#%$_\\\"'`~+-")
NOISE, ALLOWED, BROKEN = {"Cc", "Cf", "Co", "Cs", "Cn"}, set("\t\n\r "), "\ufffd"
VOWELS = set("aeiouAEIOU")
MOJIBAKE = re.compile("Ã[\u0080-¿À-ÿ ]|â€|Â[\xa0 ]")
#: Classes of characters that are counted; a character may be in several.
CLASSES = ("cjk", "latin", "digits", "symbols", "noise", "vowels", "spaces")

# Thresholds of profiles, gates and scores.
RATIO_CHARS, STRUCTURE_CHARS = 20, 40
PRIMARY, MINOR = 0.45, 0.12
CODE_SYMBOLS_LEAST, CODE_ALNUM_LEAST, CODE_SIGNALS, CODE_LINES = 0.06, 0.30, 2, 2
PROFILE_LEAST, SCORE_LEAST, CONFIDENCE = 0.35, 0.55, 0.55
LEAST_PRINTABLE, MOST_NOISE = 0.85, 0.12
UNUSABLE_CONFIDENCE, LOW_CONFIDENCE = 0.20, 0.35
CJK_UNUSABLE, CJK_LEAST, CJK_LOW = 0.05, 3, 0.15
LATIN_UNUSABLE, LATIN_COVERAGE, MIXED_COVERAGE, CODE_COVERAGE = 0.35, 0.55, 0.50, 0.45
VOWELS_LEAST, SPACES_LEAST, LONGEST_TOKENS, UNIQUE_MOST = 0.18, 0.04, 18.0, 0.55
DIVERSITY_LEAST, DIVERSITY_TOKENS = 0.15, 8


def is_latin(c: str) -> bool:
    return unicodedata.category(c).startswith("L") and "LATIN" in unicodedata.name(c, "")


def classes_of(c: str) -> int:
    """The classes of a character, a bit for each."""
    latin = is_latin(c)
    held = (
        "一" <= c <= "鿿",
        latin,
        "0" <= c <= "9",
        c in CODE_SYMBOLS,
        c not in ALLOWED and (c == BROKEN or unicodedata.category(c) in NOISE),
        latin and unicodedata.normalize("NFD", c)[0] in VOWELS,
        c.isspace(),
    )
    return sum(has << i for i, has in enumerate(held))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, frozenset[str]]:
    """Classes of each code point, the classes that each number stands for, and the letters of the Latin script."""
    table = np.array([classes_of(chr(c)) for c in range(0x110000)], dtype=np.uint8)
    bits = np.arange(1 << len(CLASSES))[:, None] >> np.arange(len(CLASSES)) & 1
    return table, bits, frozenset(map(chr, np.flatnonzero(table & 2).tolist()))


# Signs of code and settings.
INDENTED = re.compile(r"(?m)^[ \t]+\S")
ASSIGNED = re.compile(r"==|!=|<=|>=|=>|\+=|-=|\*=|/=|:=|(?<![<>!=])=(?![=>])")
NUMBERED, NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\d|\d[A-Za-z_]"), re.compile(r"[A-Za-z_]{2,}")
KEYED = re.compile(r"(?m)^\s*[\"'A-Za-z_][^:\n]{0,40}:\s*")


def signals_of(text: str, lines: int, digits: int) -> int:
    has = lambda *marks: any(m in text for m in marks)
    return (
        (lines >= CODE_LINES or INDENTED.search(text) is not None)
        + any(a in text and b in text for a, b in ("()", "{}", "[]"))
        + (ASSIGNED.search(text) is not None)
        + (NUMBERED.search(text) is not None or (digits > 0 and NAME.search(text) is not None and has(*"{}[]()=")))
        + (has(";") or (has("{", "}") and KEYED.search(text) is not None))
    )


def measured(text: str) -> tuple:
    table, bits, latin = tables()
    held = np.bincount(table[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)], minlength=len(bits)) @ bits
    found = dict(zip(CLASSES, held.tolist(), strict=True))
    tokens = len(text.split())
    lines = max(1, text.count("\n") + (tokens > 0))
    counts = {
        "chars": len(text),
        **found,
        "broken": text.count(BROKEN),
        "lines": lines,
        "tokens": tokens,
        "distinct_tokens": len(set(text.lower().split())),
        "token_chars": len(text) - found["spaces"],
        "unique_latin": len({c.casefold() for c in latin.intersection(text)}),
        "signals": signals_of(text, lines, found["digits"]),
        "mojibake": MOJIBAKE.search(text) is not None,
        "disallowed": found["noise"] > 0,
    }
    return tuple(counts[name] for name in MEASURES)


#: What is measured of a text, in the order of the columns.
MEASURES = ("chars", "cjk", "latin", "digits", "symbols", "noise", "broken", "vowels", "spaces", "lines", "tokens", "distinct_tokens", "token_chars", "unique_latin", "mojibake", "signals", "disallowed")
FLAGS = ("mojibake", "disallowed")


def statistics(texts: DataFrame) -> DataFrame:
    """Counts of character classes and of tokens, and signs of structure (F5) of (id, text); a null text is empty.

    A text's code points are looked up in one table of classes and counted together; no text is too long for any count.
    """
    bounded_batches(texts.sparkSession)
    kinds = ", ".join(f"{m} {'boolean' if m in FLAGS else 'int' if m == 'signals' else 'long'}" for m in MEASURES)
    types = [pa.bool_() if m in FLAGS else pa.int32() if m == "signals" else pa.int64() for m in MEASURES]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(text or "") for text in batch.column("text").to_pylist()]
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *MEASURES])

    return texts.select("id", "text").mapInArrow(work, f"id {texts.schema['id'].dataType.simpleString()}, {kinds}")


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def garbage() -> Column:
    """Whether text in Latin letters lacks the structure of a language."""
    latin = F.greatest(F.col("latin"), F.lit(1))
    vowels, alone = share(F.col("vowels"), F.col("latin")), F.col("cjk") == 0
    unlike = (
        (vowels < VOWELS_LEAST)
        | ((share(F.col("spaces"), F.col("chars")) < SPACES_LEAST) & (F.col("lines") < 2))
        | (share(F.col("token_chars"), F.col("tokens")) > LONGEST_TOKENS)
        | ((F.col("tokens") >= DIVERSITY_TOKENS) & (share(F.col("distinct_tokens"), F.col("tokens")) < DIVERSITY_LEAST) & alone)
        | ((F.col("unique_latin") / latin >= UNIQUE_MOST) & (vowels < VOWELS_LEAST + 0.05) & alone)
    )
    return (F.col("latin") >= RATIO_CHARS) & (F.col("mojibake") | ((F.col("chars") >= STRUCTURE_CHARS) & unlike))


def verdicts(stats: DataFrame) -> DataFrame:
    """Profile, verdict and score by ordered gates (F6-F8): the first gate that a text fails names the reason and caps
    the score; only texts that pass them all may be searched.

    stats: as from statistics(), with confidence (0 to 1 or null) and run (succeeded, empty, failed, unavailable, disabled).
    """
    chars, meant = F.col("chars"), F.greatest(F.col("cjk") + F.col("latin") + F.col("digits") + F.col("symbols"), F.lit(1))
    of_meant = {c: F.col(c) / meant for c in ("cjk", "latin", "digits", "symbols")}
    of_all = {c: share(F.col(c), chars) for c in ("cjk", "latin", "digits", "symbols", "noise")}
    cjk, latin = of_meant["cjk"], of_meant["latin"]
    alnum = of_all["latin"] + of_all["digits"]
    code = (F.col("signals") >= CODE_SIGNALS) & (of_all["symbols"] >= CODE_SYMBOLS_LEAST) & (alnum >= CODE_ALNUM_LEAST) & (cjk < MINOR)
    told = lambda name, sure: F.struct(F.lit(name).alias("profile"), F.least(F.lit(1.0), sure).alias("sure"))
    kinds = (
        F.when(chars == 0, told("unknown", F.lit(0.0)))
        .when(code, told("code_like", 0.40 + 0.10 * F.col("signals") + of_all["symbols"] + 0.15 * F.least(F.lit(1.0), alnum)))
        .when((cjk >= PRIMARY) & (latin < MINOR), told("cjk_primary", 0.5 + cjk))
        .when((latin >= PRIMARY) & (cjk < MINOR) & garbage(), told("unknown", F.lit(0.25)))
        .when((latin >= PRIMARY) & (cjk < MINOR), told("latin_primary", 0.5 + latin))
        .when((cjk >= MINOR) & (latin >= MINOR), told("mixed", 0.4 + cjk + latin))
        .when(cjk >= MINOR, told("cjk_primary", 0.4 + cjk))
        .when((latin >= MINOR) & garbage(), told("unknown", F.lit(0.2)))
        .when(latin >= MINOR, told("latin_primary", 0.4 + latin))
        .when((of_meant["digits"] + of_meant["symbols"] >= 0.5) & (F.col("signals") >= CODE_SIGNALS), told("code_like", F.lit(0.4)))
        .otherwise(told("unknown", F.lit(0.15)))
    )
    rows = stats.withColumn("_kind", kinds).withColumns({"profile": F.col("_kind.profile"), "sure": F.col("_kind.sure"), "garbage": garbage()})
    profile, known = F.col("profile"), F.col("confidence")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(known, F.lit(CONFIDENCE))))
    coverage = F.col("cjk") + F.col("latin") + F.col("digits") + F.col("symbols")
    coverage = coverage / F.greatest(chars, F.lit(1))
    vowels, spaces = share(F.col("vowels"), F.col("latin")), share(F.col("spaces"), chars)
    structure = F.when(F.col("garbage"), 0.0).otherwise(0.5 * F.least(F.lit(1.0), vowels / 0.35) + 0.5 * F.least(F.lit(1.0), spaces / 0.12))
    base = (
        F.when(profile == "cjk_primary", 0.55 * of_all["cjk"] + 0.25 * sure + 0.20 * coverage)
        .when(profile == "latin_primary", 0.40 * of_all["latin"] + 0.25 * sure + 0.20 * structure + 0.15 * coverage)
        .when(profile == "mixed", 0.50 * (cjk + latin + of_meant["digits"]) + 0.30 * sure + 0.20 * coverage)
        .when(profile == "code_like", 0.35 * F.least(F.lit(1.0), of_all["symbols"] / 0.15) + 0.35 * (latin + of_meant["digits"]) + 0.20 * sure + 0.10 * F.least(F.lit(1.0), F.col("lines") / 4.0))
        .otherwise(0.25 * coverage + 0.25 * sure + 0.10 * F.when(chars > 0, 1 - of_all["noise"]).otherwise(0.0))
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * F.greatest(F.lit(0.0), 1 - 4 * of_all["noise"])))
    doubtful = F.coalesce(known < LOW_CONFIDENCE, F.lit(False))
    some, whole = chars >= RATIO_CHARS, chars >= STRUCTURE_CHARS
    of = lambda name: profile == name
    gates = [
        (F.col("run").isin("disabled", "unavailable", "failed"), F.concat(F.lit("runtime_"), F.col("run")), "unknown", 0.0),
        ((F.col("run") == "empty") | (chars == 0), "empty_text", "empty", 0.0),
        ((F.col("broken") > 0) | F.col("mojibake") | (F.col("noise") > 0), "mojibake_or_disallowed_unicode", "unusable", 0.15),
        ((1 - of_all["noise"] < LEAST_PRINTABLE) | (of_all["noise"] > MOST_NOISE), "high_noise_or_nonprintable", "unusable", 0.1),
        (F.coalesce(known < UNUSABLE_CONFIDENCE, F.lit(False)), "confidence_unusable", "unusable", 0.2),
        (of("cjk_primary") & whole & (of_all["cjk"] < CJK_UNUSABLE), "cjk_ratio_below_floor", "unusable", 0.15),
        (of("cjk_primary") & some & (F.col("cjk") < CJK_LEAST), "cjk_count_below_floor", "unusable", 0.15),
        (of("latin_primary") & F.col("garbage"), "latin_garbage_structure", "unusable", 0.12),
        (of("latin_primary") & some & (latin < LATIN_UNUSABLE), "latin_coverage_below_floor", "unusable", 0.15),
        (of("unknown") & (F.col("garbage") | ((of_all["latin"] > 0.5) & (F.col("cjk") == 0))), "unknown_latin_untrusted", "unusable", 0.15),
        (of("unknown") & doubtful, "unknown_low_confidence", "low_quality", 0.3),
        (doubtful, "confidence_below_threshold", "low_quality", 0.35),
        (of("cjk_primary") & whole & (of_all["cjk"] < CJK_LOW), "cjk_ratio_low", "low_quality", 0.35),
        (of("latin_primary") & whole & (latin < LATIN_COVERAGE), "latin_coverage_low", "low_quality", 0.4),
        (of("mixed") & some & (1 - of_meant["symbols"] < MIXED_COVERAGE), "mixed_coverage_low", "low_quality", 0.4),
        (of("code_like") & some & (1 - cjk < CODE_COVERAGE), "code_coverage_low", "low_quality", 0.4),
        (of("unknown") & (F.col("sure") < PROFILE_LEAST), "unknown_needs_review", "low_quality", 0.35),
    ]
    at = F.coalesce(*[F.when(failed, F.struct(F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"), F.lit(status).alias("status"), F.lit(cap).alias("cap"))) for failed, reason, status, cap in gates])
    ok = F.struct(F.lit("ok").alias("reason"), F.lit("ok").alias("status"), F.lit(1.0).alias("cap"))
    rows = rows.withColumn("_score", score).withColumn("_gate", F.coalesce(at, ok))
    passed = F.col("_gate.status") == "ok"
    final = F.when(passed, F.greatest("_score", F.lit(SCORE_LEAST))).otherwise(F.least("_score", F.col("_gate.cap")))
    shown = F.when(F.col("_gate.reason").isin("empty_text", "high_noise_or_nonprintable", "latin_garbage_structure"), "unknown").otherwise(profile)
    return rows.select("id", shown.alias("profile"), F.col("_gate.status").alias("status"), F.col("_gate.reason").alias("reason"), F.round(final, 4).alias("score"), passed.alias("search_eligible"))


def chunk_eligible(ocr: Column, flag: Column, searchable: Column, status: Column, text: Column) -> Column:
    """Whether a chunk may be searched (P11): one that was read from an image by its flags, the first that is known,
    else by its verdict; any other if it has text."""
    verdict = F.coalesce(flag, searchable, F.coalesce(F.nullif(F.trim(status), F.lit("")) == "ok", F.lit(False)))
    return F.when(ocr, verdict).otherwise(F.trim(F.coalesce(text, F.lit(""))) != "")
