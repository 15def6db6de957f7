"""Results against brute force, SQL and held-out labels."""

import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
import pytest

import corpus_pipeline
from compare import differences
from floodspark.llm import near_dedup, packing, pii, queries
from floodspark.llm.common import table

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_equals_sql(spark, name):
    assert differences(spark, SMALL, queries.QUERIES[name], queries.ORACLE_SQL[name]) == []


# --- classifiers ---------------------------------------------------------------------------------

def held_out(spark, query, label):
    got = query(spark, MIDDLE).join(table(spark, MIDDLE, "labels").select("doc_id", label), "doc_id").where("held_out")
    rows = got.select("score", "predicted", label).where(f"{label} is not null").collect()
    return tuple(np.array(column, float) for column in zip(*rows))


def auc(score, label):
    order = score.argsort(kind="stable").argsort() + 1
    for value in np.unique(score):
        order = np.where(score == value, order[score == value].mean(), order)
    good = label == 1
    return (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_toxicity_held_out(spark):
    score, predicted, label = held_out(spark, queries.op1_toxicity, "toxic")
    assert 0 <= score.min() and score.max() <= 1
    assert auc(score, label) > 0.9 and (predicted == label).mean() > 0.9


def test_quality_held_out(spark):
    score, predicted, label = held_out(spark, queries.op3_quality_classifier, "quality")
    assert 0 <= score.min() and score.max() <= 1
    assert auc(score, label) > 0.9 and (predicted == label).mean() > 0.85


def test_language_held_out(spark):
    got = queries.op8_language_id(spark, MIDDLE).join(table(spark, MIDDLE, "documents").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out and lang is not null and lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert np.mean([a == b for a, b in rows]) > 0.95


# --- personal data --------------------------------------------------------------------------------

def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return 12 <= len(digits) <= 19 and total % 10 == 0


#: The base patterns as the contract gives them.
BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base_spans(text):
    found = []
    for order, (kind, pattern, passes) in enumerate(BASE):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if passes(m[0])]
    return [(BASE[o][0], s) for _, o, s in sorted(found)]


TRICKY = [
    "a@b.c@d.e f%x@y-z.com.", "aaa@bbb@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 010.001.000.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (555) 010-9999 +12 3 +49.30.1234567-", "☃ x@y.zz 漢 +4412345678901 9.9.9.9", "1" * 5000, "a" * 5000 + "@", "+1 " * 300, None, "",
]


def check_pii(rows):
    for r in rows:
        wanted = base_spans(r["text"])
        listed = ",".join(s for _, s in wanted)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), r["text"]
        assert [r[f"n_{k}"] for k, *_ in BASE] == [sum(kind == k for kind, _ in wanted) for k, *_ in BASE]
        assert set(s for _, s in wanted) <= set(filter(None, r["spans"].split(",")))


def test_base_spans_by_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    check_pii(pii.find_spans(docs).join(docs.select("doc_id", "text"), "doc_id").collect())
    made = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    check_pii(pii.find_spans(made).join(made, "doc_id").collect())


def test_spans_beyond_the_base_and_redaction(spark):
    texts = ["call us: (415) 555-1234 today", "the order 415-555-1234 was sent", "please contact bob (at) mail (dot) org now", "mail a@b.org x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean == {0: "call us: [redacted] today", 1: texts[1], 2: "please contact [redacted] now", 3: "mail [redacted] x"}


# --- near duplicates --------------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(8) for _ in range(rng.randrange(1, 60))]
        b = [x for x in a if rng.random() > 0.1] if rng.random() < 0.7 else [rng.randrange(8) for _ in range(rng.randrange(1, 60))]
        for most in (0, 3, 12):
            true = distance(a, b)
            assert near_dedup.banded_distance(a, b, most) == (true if true <= most else None)
            assert near_dedup.growing_band(a, b, most) == (true <= most)
        assert near_dedup.similar(a, b) == (distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9))


def test_classes_by_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(14):
        first = rng.choices(vocabulary, k=rng.randrange(40, 120))
        texts += [first, list(first)]
        for share in (0.03, 0.06, 0.5):
            texts.append([rng.choice(vocabulary) if rng.random() < share else w for w in first])
    rng.shuffle(texts)
    label = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if label[i] != label[j] and distance(a, texts[j]) <= int(max(len(a), len(texts[j])) * 0.2 + 1e-9):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_a_long_chain_is_one_class(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["label"] for r in near_dedup.connected(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


# --- packing ----------------------------------------------------------------------------------------

def naive_cost(lengths, capacities, overhead):
    costs = []
    for preferred in capacities:
        bins = []
        for length in lengths:
            fits = [b for b in bins if b[0] - b[1] >= length]
            if fits:
                min(fits, key=lambda b: b[0] - b[1])[1] += length
            else:
                bins.append([max(preferred, capacities[bisect_left(capacities, length)]), length])
        costs.append(sum(capacities[bisect_left(capacities, fill)] + overhead for _, fill in bins))
    return min(costs)


def test_plan_costs_by_brute_force():
    rng = random.Random(3)
    capacities = (8, 16, 32)
    for _ in range(100):
        lengths = sorted((rng.randrange(1, 33) for _ in range(rng.randrange(1, 60))), reverse=True)
        bins, sizes = packing.pack_lengths(lengths, capacities, 2)
        fill = np.bincount(bins, weights=lengths)
        assert (fill <= sizes).all() and all(s == capacities[bisect_left(capacities, f)] for s, f in zip(sizes, fill))
        assert sum(sizes) + 2 * len(sizes) <= naive_cost(lengths, capacities, 2)


def check_packing(docs, packed):
    words = {}
    for r in docs.select("doc_id", "text").collect():
        words[r[0]] = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    pieces, bins = {}, {}
    for r in packed.collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        bins.setdefault((r["shard"], r["bin"], r["capacity"], r["fill"]), []).append((r["bin_start"], r["length"]))
    assert set(pieces) == {i for i, n in words.items() if n}
    for parts, total in ((sorted(v), words[i]) for i, v in pieces.items()):
        assert [s for s, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]]))[:-1] and sum(n for _, n in parts) == total
    for (_, _, capacity, fill), parts in bins.items():
        parts.sort()
        assert sum(n for _, n in parts) == fill <= capacity
        assert [s for s, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]]))[:-1]
    assert len({k[:2] for k in bins}) == len(bins)


def test_packing_is_an_exact_round_trip(spark):
    docs = table(spark, MIDDLE, "documents")
    check_packing(docs, packing.pack(docs))
    check_packing(docs, packing.pack(docs, pieces_per_shard=50))


# --- pipeline ---------------------------------------------------------------------------------------

def test_pipeline_is_its_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, docs.collect()))
