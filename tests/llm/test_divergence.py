"""The audit against a plain version in whole numbers, and the tournament's schedule."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from floodspark.llm import divergence


def brute(rows, min_docs=3, top=200):
    def terms(text):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]

    docs, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = terms(text)
        docs[lang or ""].update(set(found))
        n[lang or "", source or ""].update(found)
    out = []
    for lang, seen in docs.items():
        kept = [t for t in seen if seen[t] >= min_docs]
        groups = {s: n[g, s] for g, s in n if g == lang}
        everywhere = Counter()
        for c in groups.values():
            everywhere.update(c)

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(everywhere)
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            some = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", some, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def compared(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, rank int")
    got = sorted(tuple(r) for r in divergence.audit(df.repartition(3), **more).collect())
    assert got == brute(rows, top=more.get("top", 200))


@pytest.mark.parametrize("sources,seats,block_terms", [(1, 4, 4096), (9, 4, 8), (7, 3, 16), (5, 1, 4096)])
def test_random_words(spark, sources, seats, block_terms):
    rng = random.Random(sources)
    words = ["Haus", "haus", "été", "中文", "a_b", "x1y", "Ω", "ß", "tree"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(120):
        s = rng.randrange(sources)
        text = " ".join(rng.choice(words[: 5 + 4 * s] if rng.random() < 0.9 else words) for _ in range(rng.randint(0, 30)))
        rows.append((text, rng.choice(["en", "de", None]), f"s{s}"))
    compared(spark, rows, seats=seats, block_terms=block_terms, top=5)


def test_odd_groups(spark):
    rows = [(None, None, None), ("", "en", ""), ("one two", "xx", "a"), ("1 2 3", "xx", "b"), (None, "xx", "c")]
    rows += [("same same words", "en", "a")] * 4 + [("same other words", "en", "b")] * 3 + [("rare", "en", "b")]
    compared(spark, rows)
    compared(spark, [("same words", "en", "a")] * 5)


def test_a_long_text_and_an_empty_table(spark, monkeypatch):
    rows = [("again and again Again " * 40_000, "en", s) for s in "aab"]
    compared(spark, rows)
    assert list(divergence.terms_of(b"Aa bB-\xc3\x89")) == [b"aa", b"bb", b"\xc3\x89"]
    monkeypatch.setattr(divergence, "WHOLE_BYTES", 2)
    assert list(divergence.terms_of(b"Aa bB-\xc3\x89")) == [b"aa", b"bb", b"\xc3\x89"]
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


@pytest.mark.parametrize("even", [2, 4, 6, 10, 16])
def test_every_two_seats_meet_once(even):
    met = Counter()
    for turn in range(even - 1):
        for seat in range(even):
            other = divergence.opponent(seat, even - 1, turn)
            assert divergence.opponent(other, even - 1, turn) == seat != other
            sent = divergence._traveller(even, turn)((("en", 0, seat), []))
            if sent:
                assert sent[0][0] == ("en", 0, other)
                met[frozenset((seat, other))] += 1
    assert len(met) == even * (even - 1) // 2 and set(met.values()) == {1}


def test_shares_are_exact_and_vectors_come_back():
    rng = random.Random(1)
    for _ in range(500):
        total = rng.choice([1, 7, 10**6, 10**12, 9 * 10**15])
        count = rng.randrange(total)
        assert divergence.shares(np.array([count]), total)[0] == 1 + 10**9 * (count + 1) // total
    for places, counts in (([], []), ([5, 0, 3], [1, 70_000, 2]), ([100_000, 2], [1, 1])):
        got = divergence.unpack(divergence.pack(np.array(places, np.int64), np.array(counts, np.int64)))
        assert sorted(zip(places, counts)) == list(zip(*(x.tolist() for x in got)))
