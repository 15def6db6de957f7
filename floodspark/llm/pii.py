"""Personal data: high-recall candidate generators, boosted trees, calibrated thresholds.

Regular-expression generators propose spans of four kinds, which may overlap. Spans of the base
patterns that pass their check (Luhn, byte range, digit count) are always redacted. Every other
candidate is scored by boosted trees over its format and its context, and selected if it reaches the
threshold of its kind, which is calibrated on labelled examples for precision.

Everything on the main path is a projection of built-in functions over one row: the text is split at
the matches, so positions and contexts come from the lengths of the pieces. The patterns are written so
that each position of a text is looked at a bounded number of times (possessive runs that start at
the beginning of a run only). The trees are fitted on the driver to a small table of labelled examples,
whose features come from the same projection, and compiled to a CASE expression.

Defined cases: a null text is empty; empty texts have no span (the digest is that of the empty string);
positions are code points, ends exclusive; ties of spans at one start go by the kind as listed, then
by the end; a null doc_id stays null; rows are handled one by one, so repeated rows repeat the result;
extra columns are ignored by ``find_spans`` and kept by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import cycle

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = r"[A-Za-z0-9._%+-]"
#: (kind, pattern, base): a run can only start where the previous character is not of it, or where
#: the previous match ended, which finds the same leftmost matches in linear time.
GENERATORS = (
    ("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", True),
    ("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True),
    ("email", rf"(?<!{_LOCAL}){_LOCAL}++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++", False),
    ("phone", r"(?<![0-9+().-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])", False),
)

#: Words that stand before personal data of a kind, and before other numbers.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|addr|host|server|login",
    "card": "card|visa|credit|debit|pay|pan",
    "phone": "phone|tel|call|fax|mobile|sms|contact",
}
OTHER_CONTEXT = "version|release|order|invoice|isbn|serial|ref|section|chapter|total|sum|part|model"
FEATURES = ("kind", "n_digits", "n_chars", "n_gaps", "checked", "cue", "other", "touches")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass Luhn's check."""
    reverse = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(reverse, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def _passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        byte = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{byte}(?:\.{byte}){{3}}$")
    if kind == "card":
        return _luhn(_digits(match))
    return F.length(_digits(match)).between(9, 15)


def _runs(array: Column) -> Column:
    """``array`` cut into runs of about the square root of its size.

    Spark copies an array for each element appended to it. Within runs, and over runs, few elements
    are copied, so that time grows with the power 1.5 of the size instead of the square.
    """
    n = F.size(array)
    run = F.ceil(F.sqrt(n)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), n - 1, F.greatest(run, F.lit(1))), lambda at: F.slice(array, at + 1, run))
    return F.when(n > 0, cuts).otherwise(F.slice(F.array(array), 2, 1))


def _starts(lengths: Column) -> Column:
    """The sum of all lengths before each."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(lengths, start, step, lambda s: s["out"])


def _found(pieces: str, matches: str, kind: str, base: bool) -> Column:
    """Array of candidates, with positions and features, from a text split at its matches."""
    n = F.size(matches)
    zipped = F.arrays_zip(
        F.slice(pieces, F.lit(1), n).alias("before"),
        F.col(matches).alias("match"),
        F.slice(pieces, F.lit(2), n).alias("after"),
    )
    candidate = "struct<start:int,end:int,match:string,before:string,after:string>"

    def step(state: Column, z: Column) -> Column:
        start = state["at"] + F.length(z["before"])
        end = start + F.length(z["match"])
        one = F.struct(
            start.alias("start"),
            end.alias("end"),
            z["match"].alias("match"),
            F.lower(F.right(z["before"], F.lit(24))).alias("before"),
            F.left(z["after"], F.lit(1)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def placed_run(run: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(f"array<{candidate}>").alias("out"))
        return F.aggregate(run, start, step, lambda s: s["out"])

    runs = _runs(zipped)
    lengths = F.transform(
        runs, lambda r: F.aggregate(r, F.lit(0), lambda t, z: t + F.length(z["before"]) + F.length(z["match"]))
    )
    placed = F.flatten(F.zip_with(runs, _starts(lengths), placed_run))

    def featured(c: Column) -> Column:
        match = c["match"]
        number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
        checked = _passes(kind, match)
        return F.struct(
            c["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("order"),
            c["end"].alias("end"),
            (checked if base else F.lit(False)).alias("base"),
            F.struct(
                F.lit(float(KINDS.index(kind))).alias("kind"),
                number(F.length(_digits(match))).alias("n_digits"),
                number(F.length(match)).alias("n_chars"),
                number(F.length(F.regexp_replace(match, "[A-Za-z0-9]", ""))).alias("n_gaps"),
                number(checked).alias("checked"),
                number(c["before"].rlike(CONTEXT[kind])).alias("cue"),
                number(c["before"].rlike(OTHER_CONTEXT)).alias("other"),
                number(F.right(c["before"], F.lit(1)).rlike("[a-z0-9/=_.#-]$") | c["after"].rlike("^[A-Za-z0-9/=_@]")).alias("touches"),
            ).alias("x"),
        )

    wanted = lambda c: F.lit(True)
    if kind == "card":  # runs too short to be anything need no features
        wanted = lambda c: F.length(c["match"]) >= 12
    return F.transform(F.filter(placed, wanted), featured)


def candidates(texts: DataFrame) -> DataFrame:
    """``texts`` with ``__found``: all candidates of all generators, in any order."""
    text = F.coalesce("text", F.lit(""))
    # A text without the sign that each pattern needs is not searched for it.
    has_at, has_digit = text.contains("@"), text.rlike("[0-9]")
    needs = (has_at, has_digit, has_digit, text.contains("+"), text.rlike(r"[(\[]at[)\]]"), has_digit)
    no_text = F.array().cast("array<string>")
    pieces, matches = [], []
    for i, ((_, pattern, _), need) in enumerate(zip(GENERATORS, needs)):
        pieces.append(F.when(need, F.split(text, pattern, -1)).otherwise(no_text).alias(f"__p{i}"))
        matches.append(F.when(need, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(no_text).alias(f"__m{i}"))
    split = texts.select("*", *pieces, *matches)
    found = F.concat(*[_found(f"__p{i}", f"__m{i}", kind, base) for i, (kind, _, base) in enumerate(GENERATORS)])
    return split.withColumn("__found", found).drop(*[f"__{c}{i}" for c in "pm" for i in range(len(GENERATORS))])


# --- the labelled examples and the trees -----------------------------------------------------

def _card(seed: int, valid: bool) -> str:
    body = [int(x) for x in str(4_000_000_000_000_000 + seed * 7_919_777_777 % 10**15)[:15]]
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(body))
    return "".join(map(str, body)) + str((-total + (0 if valid else 3)) % 10)


def labelled_examples(n: int = 24) -> list[tuple[int, str, str | None, str | None]]:
    """(number, text, kind, personal span or None): ``n`` of each template, made by a rule."""
    cues = cycle(("call", "phone", "tel", "mobile", "fax"))
    out: list[tuple[str, str | None, str | None]] = []
    for i in range(n):
        a, b, c = 200 + i * 37 % 700, 100 + i * 53 % 900, 1000 + i * 791 % 9000
        for span in (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"):
            out.append((f"you can {next(cues)} us: {span} today", "phone", span))
            out.append((f"the order {span} was sent", None, None))
            out.append((f"see part no {span}x in stock", None, None))
        span = f"user{i} (at) mail{i} (dot) example"
        out += [(f"please contact {span} for more", "email", span), (f"write to u{i}[at]host{i}.org now", "email", f"u{i}[at]host{i}.org")]
        out.append((f"the score was 3 (at) {i}.5 in total", None, None))
        card = _card(i, valid=False)
        spaced = " ".join(card[k : k + 4] for k in range(0, 16, 4))
        good = _card(i, valid=True)
        out += [(f"paid by card {good} then", "card", good), (f"my visa {good} here", "card", good)]
        out += [(f"serial {card} of the unit", None, None), (f"invoice {spaced} is open", None, None), (f"so {card} and", None, None)]
        out += [(f"version {i}.{a}.{b}.{c} is out", None, None), (f"the server ip 10.{i}.3.{a % 250} answered", "ip", f"10.{i}.3.{a % 250}")]
        phone = f"+{1 + i % 9} {a} {b} {c}"
        out += [(f"tel {phone} or", "phone", phone), (f"a sum of +{i} 3 {i} 2 is", None, None)]
        out += [(f"mail me at user{i}@example.org soon", "email", f"user{i}@example.org")]
    return [(k * n // len(out), *row) for k, row in enumerate(out)]


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 30, rate: float = 0.3) -> tuple[float, list[tuple]]:
    """Gradient boosting of two-level trees for logistic loss: (start, trees).

    A tree is (feature, cut, left, right), its sides either leaves or trees again.
    """
    prior = np.clip(y.mean(), 0.01, 0.99)
    start = float(np.log(prior / (1 - prior)))
    margin = np.full(len(y), start)

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
        leaf = float(round(rate * grad[rows].sum() / (hess[rows].sum() + 1.0), 6))
        if not depth:
            return leaf
        best = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                gain = sum(grad[s].sum() ** 2 / (hess[s].sum() + 1.0) for s in (left, right))
                if best is None or gain > best[0] + 1e-12:
                    best = gain, f, float(cut), left, right
        if best is None:
            return leaf
        _, f, cut, left, right = best
        return f, cut, grow(left, grad, hess, depth - 1), grow(right, grad, hess, depth - 1)

    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), 3)
        trees.append(tree)
        margin += np.array([tree_value(tree, row) for row in x])
    return start, trees


def tree_value(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def compile_trees(start: float, trees: list, x: Column) -> Column:
    """The summed margin of the trees as one expression over a struct of features."""

    def side(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        f, cut, left, right = tree
        return F.when(x[FEATURES[f]] <= cut, side(left)).otherwise(side(right))

    return reduce(lambda a, b: a + b, (side(t) for t in trees), F.lit(start))


def calibrate(margins: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float = 0.98) -> dict[int, float]:
    """For each kind the least margin from which on the examples reach ``precision``, half way to the next below."""
    out = {}
    for kind in range(len(KINDS)):
        own = kinds == kind
        out[kind] = float("inf")
        falling = sorted(set(margins[own].tolist()), reverse=True)
        for cut, below in zip(falling, [*falling[1:], None]):
            chosen = own & (margins >= cut)
            if y[chosen].mean() >= precision:
                out[kind] = cut - 1.0 if below is None else (cut + below) / 2
    return out


def fit_selector(spark: SparkSession) -> Callable[[Column], Column]:
    """A function from a candidate to whether it is selected, fitted to the labelled examples."""
    texts = spark.createDataFrame(labelled_examples(), "number int, text string, truth string, span string")
    flat = with_candidates(texts).select("number", "text", "truth", "span", F.explode("__more").alias("c"))
    got = flat.select(
        "number",
        (
            (F.col("span") == F.substr("text", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")))
            & (F.col("truth") == F.element_at(F.array(*map(F.lit, KINDS)), F.col("c.order") + 1))
        ).alias("label"),
        "c.x.*",
    ).collect()
    x = np.array([[r[f] for f in FEATURES] for r in got])
    y = np.array([float(bool(r["label"])) for r in got])
    # Trees and thresholds come from different examples, those of even and of odd number.
    fitted = np.array([r["number"] % 2 == 0 for r in got])
    start, trees = fit_trees(x[fitted], y[fitted])
    margins = start + np.array([sum(tree_value(t, row) for t in trees) for row in x[~fitted]])
    cuts = calibrate(margins, y[~fitted], x[~fitted, 0].astype(int))
    # A cut above every margin stands for a kind that nothing can be added to.
    limits = F.array(*[F.lit(min(cuts[k], 1e9)) for k in range(len(KINDS))])
    return lambda c: compile_trees(start, trees, c["x"]) >= F.get(limits, c["order"])


def with_candidates(documents: DataFrame) -> DataFrame:
    """``documents`` with ``__base``, the sorted base spans, and ``__more``, candidates that overlap none of them.

    Base spans are looked through by runs: only those of the few runs that reach over a candidate.
    """
    overlaps = lambda b, c: (b["start"] < c["end"]) & (c["start"] < b["end"])
    based = candidates(documents).withColumn("__base", F.sort_array(F.filter("__found", lambda c: c["base"])))
    based = based.withColumn(
        "__runs",
        F.transform(
            _runs(F.col("__base")),
            lambda r: F.struct(F.array_min(r["start"]).alias("start"), F.array_max(r["end"]).alias("end"), r.alias("spans")),
        ),
    )
    free = lambda c: ~F.exists("__runs", lambda r: overlaps(r, c) & F.exists(r["spans"], lambda b: overlaps(b, c)))
    more = F.when(F.size("__found") > F.size("__base"), F.filter("__found", lambda c: ~c["base"] & free(c)))
    return based.withColumn("__more", more).drop("__found", "__runs")


def with_spans(documents: DataFrame, select: Callable[[Column], Column]) -> DataFrame:
    """``documents`` with ``__base`` and ``__spans``, sorted arrays of (start, order, end, base, x)."""
    found = with_candidates(documents)
    spans = F.sort_array(F.concat("__base", F.filter("__more", select)))
    return found.withColumn("__spans", F.coalesce(spans, F.col("__base"))).drop("__more")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _of_kind(order: int) -> Column:
    return F.size(F.filter("__base", lambda s: s["order"] == order)).cast("long")


def find_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row."""
    select = fit_selector(documents.sparkSession)
    spans = with_spans(documents.select("doc_id", "text"), select)
    counts = [_of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(_listed("__base"), 256).alias("base_sha256"), _listed("__spans").alias("spans"))


def redact(documents: DataFrame, mask: str = "[redacted]") -> DataFrame:
    """``documents`` with every selected span of ``text`` replaced; overlapping spans merge."""
    columns = documents.columns
    packed = documents.select(F.struct(*[documents[f"`{c}`"] for c in columns]).alias("__row"), "text")
    spans = with_spans(packed, fit_selector(documents.sparkSession))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substr(state["part"], state["at"] - state["base"] + 1, s["start"] - state["at"])
        return F.struct(
            state["base"].alias("base"),
            state["part"].alias("part"),
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"]).alias("out"),
        )

    def masked(run: Column, at: Column) -> Column:
        part = F.substr("text", at + 1, F.greatest(at, F.array_max(run["end"])) - at)
        start = F.struct(at.alias("base"), part.alias("part"), at.alias("at"), F.lit("").alias("out"))
        return F.aggregate(run, start, step, lambda s: s["out"])

    runs = _runs(F.col("__spans"))
    # What a run ends before is the furthest end of all runs up to it.
    ends = F.transform(runs, lambda r: F.array_max(r["end"]))
    furthest = F.aggregate(
        ends, F.array(F.lit(0)), lambda out, end: F.concat(out, F.array(F.greatest(end, F.element_at(out, -1))))
    )
    clean = F.concat(
        F.array_join(F.zip_with(runs, F.slice(furthest, F.lit(1), F.size(runs)), masked), ""),
        F.substr("text", F.element_at(furthest, -1) + 1, F.length("text")),
    )
    text = F.when(F.size("__spans") > 0, clean).otherwise(F.col("text"))
    return spans.withColumn("__clean", text).select(
        *[(F.col("__clean") if c == "text" else F.col("__row").getField(c)).alias(c) for c in columns]
    )
