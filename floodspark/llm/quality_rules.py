"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are maximal runs of other than white space (space, tab to carriage return). The base figures
are counted exactly over the whole text; ``n_repeat_words`` counts the words that lie in some window of
three words found twice or more in the same text. Windows are compared by a 64-bit hash within
one text, sorted with their positions, so the work grows with n log n of the words.

Everything is per row: no shuffle, and no state beyond one text.

Defined cases: a null text has no words and no lines, so it fails the base; an empty one likewise;
a line counts only if it has a word; rows are judged each on its own, so repeated rows get the same
verdict; a null doc_id stays null; extra columns are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
FEW = 24

# Common function words of English, Spanish, French and German.
STOP_WORDS = (
    "the of and to in a is that it for on with as was by this be are or an at from he "
    "el la de que y los las en un una se del por con no para es lo su al "
    "le les des et à il dans est pour qui au sur ne ce pas par plus "
    "der die das und zu von mit den ist nicht ein eine auf für im dem sich auch"
).split()

#: (rule, numerator, denominator, least ratio, greatest ratio): a text is kept within all of them.
THRESHOLDS = (
    ("mean word length", "word_chars", "n_words", 2.0, 14.0),
    ("symbols a word", "n_symbols", "n_words", 0.0, 0.25),
    ("stop words", "n_stop_words", "n_words", 0.01, 1.0),
    ("repeated lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    ("words in repeated windows", "n_repeat_words", "n_words", 0.0, 0.5),
)


def compile_thresholds(table=THRESHOLDS) -> Column:
    """True where each ratio lies within its bounds; a ratio of nothing is in bounds."""

    def rule(top: str, bottom: str, least: float, most: float) -> Column:
        ratio = F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom)), F.lit(least))
        return ratio.between(least, most)

    return reduce(lambda a, b: a & b, (rule(*row[1:]) for row in table), F.lit(True))


def _shifted(array: str) -> Column:
    """Pairs (a, b) of neighbours of an array column."""
    many = F.greatest(F.size(array) - 1, F.lit(0))
    return F.arrays_zip(F.slice(array, F.lit(1), many).alias("a"), F.slice(array, F.lit(2), many).alias("b"))


def _sorted_places(grams: str) -> Column:
    """Positions, in order, of the elements that occur twice or more, by sorting (value, position)."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    zipped = F.zip_with(
        pairs, F.slice(pairs, F.lit(2), F.size(grams)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    )
    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(zipped))))


def measure(documents: DataFrame) -> DataFrame:
    """``documents`` with one column for each base figure (and ``n_lines``, ``n_stop_words``)."""
    text = F.coalesce("text", F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    # Each step names arrays that the next uses more than once, so that none is computed twice.
    split = documents.select(
        "*",
        F.array_remove(F.split(text, SPACE + "+"), "").alias("__words"),
        F.filter(F.split(text, "\n"), has_word).alias("__lines"),
    )
    many = F.greatest(F.size("__words") - 2, F.lit(0))
    forms = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]
    counted = split.select(
        "*",
        F.slice(
            F.transform("__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))),
            F.lit(1),
            many,
        ).alias("__grams"),
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__words", lambda w: w.isin(forms))).cast("long").alias("n_stop_words"),
    )
    # Most texts repeat no window, and those that do repeat few different ones: only a text with many
    # repeated windows pays for sorting windows with their positions.
    longs = F.array().cast("array<bigint>")
    repeats = F.size(F.array_distinct("__grams")) < F.size("__grams")
    sorted_grams = counted.select("*", F.when(repeats, F.sort_array("__grams")).otherwise(longs).alias("__order"))
    twice = F.array_compact(F.transform("__order", lambda h, i: F.when(h == F.get("__order", i + 1), h)))
    doubled = sorted_grams.select("*", F.array_distinct(twice).alias("__twice"))
    placed = doubled.select(
        "*",
        F.when(F.size("__twice") == 0, F.array().cast("array<int>"))
        .when(
            F.size("__twice") <= FEW,
            F.array_compact(F.transform("__grams", lambda h, i: F.when(F.array_contains("__twice", h), i))),
        )
        .otherwise(_sorted_places("__grams"))
        .alias("__at"),
    )
    covered = F.aggregate(_shifted("__at"), F.lit(0), lambda total, z: total + F.least(F.lit(3), z["b"] - z["a"]))
    return placed.select(
        "*", F.when(F.size("__at") > 0, covered + 3).otherwise(0).cast("long").alias("n_repeat_words")
    ).drop("__words", "__lines", "__grams", "__order", "__twice", "__at")


def judge(documents: DataFrame, table=THRESHOLDS) -> DataFrame:
    """(doc_id, the base figures, base_failed, kept, n_lines, n_stop_words) of each row."""
    measured = measure(documents.select("doc_id", "text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & compile_thresholds(table)).alias("kept"),
        "n_lines",
        "n_stop_words",
    )


def keep(documents: DataFrame, table=THRESHOLDS) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with their own columns."""
    columns = documents.columns
    packed = documents.select(F.struct(*[documents[f"`{c}`"] for c in columns]).alias("__row"), "text")
    measured = measure(packed)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # The row number keeps the filter above the projections: pushed below them, the optimiser would
    # write out every figure again for each time that a later one refers to it.
    fenced = measured.select("__row", (~failed & compile_thresholds(table)).alias("__kept"), F.monotonically_increasing_id().alias("__at"))
    return fenced.where("__kept AND __at >= 0").select("__row.*")
