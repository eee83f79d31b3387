"""Quality rules (operator 3, native): line-first cleaning.

Every line is judged by itself (symbols, navigation, shouting, boilerplate, missing punctuation, repetition); failing
lines go, and a document goes when too little of it remains. Everything stays inside a row: array functions over the
row's own words and lines, no join, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document stays when at least this percentage of its non-space characters lies in kept lines.
MIN_KEPT_PERCENT = 50
#: A line fails when more than this percentage of its characters are symbols.
MAX_LINE_SYMBOL_PERCENT = 8
#: Phrases that mark boilerplate lines, lower case.
BOILERPLATE = ("all rights reserved", "lorem ipsum", "javascript", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "read more", "sign in", "subscribe to", "powered by")
NAVIGATION_MARKS = "|»›>·•"
NAVIGATION = r"(^|\s)(\||»|›|>|·|•)(\s|$)"


def window_hashes(words: Column, n_words: Column) -> Column:
    """A 64-bit hash of every window of three words; none for fewer than four words (nothing can repeat)."""
    at = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(3)))
    return F.when(n_words >= 4, F.transform(F.sequence(F.lit(0), n_words - 3), at)).otherwise(F.array().cast("array<bigint>"))


def repeated_window_words(words: Column, n_words: Column, hashes: Column) -> Column:
    """Words that lie in a three-word window which occurs twice or more among the windows of the row.

    Rows whose windows all differ, the most, end at the count of distinct hashes. Else the windows are keyed by the
    upper bits of their hash with their position in the lower bits, so that one sort of a long array brings equal
    windows together; neighbours with equal keys count only if their words are equal.
    """
    bits = F.ceil(F.log2(F.greatest(n_words, F.lit(2)).cast("double"))).cast("int") + 1
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    cut = lambda x: F.call_function("shiftright", x, bits)
    keys = F.sort_array(F.transform(hashes, lambda h, i: F.call_function("shiftleft", cut(h), bits).bitwiseOR(i.cast("long"))))

    def same(x: Column, y: Column) -> Column:
        i, j = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
        equal = cut(x) == cut(y)
        for k in range(3):
            equal = equal & (F.get(words, i + k) == F.get(words, j + k))
        return F.coalesce(equal, F.lit(False))

    def covered(keys: Column) -> Column:
        twice = F.filter(keys, lambda x, k: same(x, F.get(keys, k - 1)) | same(x, F.get(keys, k + 1)))
        places = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask)))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        total = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")))
        return total["n"]

    # transform over a one-element array binds the sorted keys to a name, so that they are sorted once a row.
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(F.transform(F.array(keys), covered)[0])


def _share(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


def _count(line: Column, characters: str) -> Column:
    """How many of these ASCII characters there are. (Replacing whole bytes is far cheaper than translate().)"""
    rest = line
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(line) - F.octet_length(rest)


def _holds(line: Column, characters: str) -> Column:
    found = F.lit(False)
    for c in characters:
        found = found | line.contains(c)
    return found


def line_fails(bare: Column) -> Column:
    """True for a trimmed line that breaks one of the rules; empty lines never fail. Cheap tests guard dear ones."""
    size, low = F.length(bare), F.lower(bare)
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | low.contains(phrase)
    marks = _count(bare, "!")
    return (bare != "") & (
        _share(_count(bare, SYMBOLS), size, MAX_LINE_SYMBOL_PERCENT)
        | ((marks > 2) & _share(marks, size, 4))
        | ((size >= 8) & (bare == F.upper(bare)) & (bare != low))
        | (_holds(bare, NAVIGATION_MARKS) & (F.size(F.split(bare, NAVIGATION, -1)) > 3))
        | ((size < 200) & boiler)
        | ((size < 80) & ~bare.rlike(r"[.!?:;,…\"”’»)\]]$") & (F.size(F.split(bare, rows.GAP, -1)) < 3))
    )


def first_of_equals(lines: Column, exempt) -> Column:
    """The lines without those that equal an earlier one, but for exempt ones, which all stay.

    One sort brings equal lines together, in order of place; each then looks at its predecessor only.
    """
    spots = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.xxhash64(x).alias("h"), x.alias("x"), i.alias("i"))))

    def later(spots: Column) -> Column:
        again = F.filter(spots, lambda s, k: F.coalesce(F.get(spots, k - 1)["x"] == s["x"], F.lit(False)) & ~exempt(s["x"]))
        return F.transform(again, lambda s: s["i"])

    # transform over a one-element array binds the sorted spots to a name, so that they are sorted once a row.
    gone = F.transform(F.array(spots), later)[0]
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.when(F.size(lines) == 0, lines).otherwise(F.transform(left, lambda i: F.get(lines, i)))


def clean_lines(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Columns of df, then cleaned (the kept lines), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines, base_failed, kept.

    A line also fails when it repeats an earlier kept line of at least three words. kept is false for base_failed, and
    when the kept lines hold under MIN_KEPT_PERCENT of the non-space characters. Null and empty texts have no words,
    hence base_failed. Columns of df with one of these names are replaced. Rows are judged one by one, so null keys,
    ties and repeated rows need no rule; an empty table gives none.
    """
    new = ("cleaned", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "base_failed", "kept")
    work, own, back = rows.masked(df.drop(*(c for c in new if c != text)))
    base = work.withColumn("_t", F.coalesce(F.col(own(text)), F.lit("")))
    parts = base.withColumns({"_w": rows.words(F.col("_t")), "_l": F.split("_t", "\n", -1)})
    parts = parts.withColumns({"_h": window_hashes(F.col("_w"), F.size("_w")), "_b": F.transform("_l", lambda x: F.trim(x, F.lit(rows.SPACES)))})
    counts = parts.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": _count(F.col("_t"), SYMBOLS).cast("long"),
            "n_repeat_words": repeated_window_words(F.col("_w"), F.size("_w"), F.col("_h")),
            "_full": F.filter("_l", lambda x, i: F.get("_b", i) != ""),
            "_ok": F.filter("_l", lambda x, i: ~line_fails(F.get("_b", i))),
        }
    )
    counts = counts.withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"))
    # Repeats among kept lines: the later ones of equal lines with three words or more go.
    short = lambda x: F.size(F.split(F.trim(x, F.lit(rows.SPACES)), rows.GAP, -1)) < 3
    once = F.when(F.col("n_dup_lines") > 0, first_of_equals(F.col("_ok"), short)).otherwise(F.col("_ok"))
    out = counts.withColumn("_kept", once).withColumns(
        {
            "cleaned": F.array_join("_kept", "\n"),
            "n_lines": F.size("_full").cast("long"),
            "n_failed_lines": (F.size("_l") - F.size("_kept")).cast("long"),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
        }
    )
    left = F.length(F.regexp_replace("cleaned", rows.GAP, ""))
    verdict = ~F.col("base_failed") & ((F.col("n_failed_lines") == 0) | (left * 100 >= F.col("word_chars") * MIN_KEPT_PERCENT))
    return out.withColumn("kept", verdict).select(*back, *new)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(rows.documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines")
