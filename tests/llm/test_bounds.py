"""What bounds rows and bytes does not change results; letters of all planes; sums of single documents."""

import random

import numpy as np
import pytest

from floodspark.llm import common, decontamination, language_id, near_dedup, toxicity
from floodspark.llm.hashed_terms import sample_features, sum_by_document
from floodspark.llm.textblocks import blocks


def test_letters_beyond_the_first_plane(spark):
    texts = ["\U00020000\U00020001 \U00020002", "\U00010400\U00010428", "123 \U0001F600"]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert (got[0], got[1], got[2]) == ("xx", "xx", "und")


def test_profiles_do_not_depend_on_what_is_bundled_at_once(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghäöüß", k=6)) for _ in range(50)) for _ in range(9)] + ["", None, "7"]
    whole, lettered = language_id.profiles(texts)
    monkeypatch.setattr(language_id, "GRAMS_AT_ONCE", 100)
    parts, again = language_id.profiles(texts)
    assert np.array_equal(whole, parts) and lettered.tolist() == again.tolist() == [True] * 9 + [False] * 3


def test_sums_do_not_depend_on_neighbours():
    rng = np.random.default_rng(4)
    values, bounds = rng.normal(size=60) * 10.0 ** rng.integers(-9, 9, 60), np.array([0, 0, 20, 20, 45, 60, 60])
    got = sum_by_document(values, bounds)
    assert got.tolist() == [sum_by_document(values[a:b], np.array([0, b - a]))[0] for a, b in zip(bounds, bounds[1:])]
    assert got[[0, 2, 5]].tolist() == [0, 0, 0]


def test_terms_of_the_sample_are_bounded(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20)), i % 2) for i in range(50)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    every, labels = sample_features(sample, toxicity.terms, blocks)
    some, _ = sample_features(sample, toxicity.terms, blocks, train_terms=400)
    assert len(every) == 50 and labels.tolist() == [i % 2 for i in range(50)]
    assert 5 <= len(some) <= 20 and sum(map(len, some)) <= 400


def test_repeated_ids_give_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None)], "doc_id long, toxic int")
    got = common.labelled_sample(docs, labels, "toxic", 5, 9, 100).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 1), (2, "c", 0)]


def test_factors_learn_an_interaction():
    """Two words that tell nothing by themselves: toxic is who has one of them alone."""
    rng = np.random.default_rng(6)
    n = 1500
    has = rng.random((n, 2)) < 0.5
    rows = [np.unique(np.concatenate([np.flatnonzero(h) + 7, rng.integers(100, 160, 8)])) for h in has]
    labels = (has[:, 0] != has[:, 1]).astype(float)
    model = toxicity.FactorizationMachine().fit(rows[:1000], labels[:1000])
    flat, bounds = np.concatenate(rows[1000:]), np.concatenate([[0], np.cumsum([len(r) for r in rows[1000:]])])
    assert ((model.score(flat, bounds) >= 0.5) == labels[1000:]).mean() >= 0.95


@pytest.mark.parametrize("bounds", [{"items_per_block": 3}, {"bytes_per_block": 150}])
def test_bounded_blocks_find_the_same_items(spark, bounds):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices(["a", "b", "c", "d", "e", "f"], k=rng.randrange(3, 40)))) for i in range(30)]
    docs = [(i, f"x y {t} z") for i, t in items[:10]] + [(99, "nothing")]
    items, docs = spark.createDataFrame(items * 2, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    once, parts = (decontamination.contaminated(docs, items, **b) for b in ({}, bounds))
    assert sorted(map(str, once.collect())) == sorted(map(str, parts.collect())) and once.count() >= 10


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        get = staticmethod(lambda name: None)

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: Conf)

    class Frame:
        class sparkSession:
            sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.cut_lineage(Frame)


def test_pairs_are_verified_in_bounded_runs():
    runs = list(near_dedup._runs(np.array([5, 5, 20, 1, 1, 1]), 10))
    assert runs == [(0, 2), (2, 3), (3, 6)]
