"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import pytest

import corpus_pipeline
from floodspark.llm import (
    decontamination,
    language_id,
    line_dedup,
    near_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    toxicity,
    url_filter,
)

#: Beside the columns of documents, some that operators could use as names of their own.
DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, class_id long, digest string, "
    "n_lines long, n_removed long, pos int, label int, bin long, `a.b` string, start long, words string, kept string"
)
LONG = " ".join(f"word{i % 9973}" for i in range(120_000))
TEXTS = [
    (1, None),
    (2, ""),
    (3, "word"),
    (3, "word"),
    (None, "a text without an id"),
    (4, LONG),
    (5, " \n\t\n "),
    (6, LONG),
    (7, "\n".join(f"this is line {i} of a short text" for i in range(9))),
    (8, "ünï ☃ 漢字 " * 20),
]
LABELS = [(1, None, 1), (None, 1, 0), (3, 1, 0), (3, 0, 1), (4, 0, 0), (7, 1, None)]


def documents(spark, texts):
    rest = (None, None, 1.5, 9, "d", 8, 7, 6, 5, 4, "dot", 3, "w", "k")
    rows = [(i, t, "en" if i and i % 2 else None, *rest[1:]) for i, t in texts]
    return spark.createDataFrame([r[:3] + (None,) + r[3:] for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, None), (2, ""), (3, "word"), (4, "word5 word6 word7 word8 word9 word10"), (None, "a text without an id")]
    return spark.createDataFrame(items, "item_id long, text string")


PER_ROW = {
    "toxicity": lambda d, y: toxicity.score(d, toxicity.fit(d, y)),
    "quality": lambda d, y: quality_classifier.score(d, quality_classifier.fit(d, y)),
    "rules": lambda d, y: quality_rules.judge(d),
    "pii": lambda d, y: pii.find_spans(d),
    "redact": lambda d, y: pii.redact(d),
    "lines": lambda d, y: line_dedup.dedup_lines(d),
    "near": lambda d, y: near_dedup.near_duplicates(d),
    "language": lambda d, y: language_id.predict(d, language_id.fit(d)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(docs, labels, name):
    got = PER_ROW[name](docs, labels).select("doc_id").collect()
    assert sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables(docs, labels, name):
    assert PER_ROW[name](docs.limit(0), labels.limit(0)).count() == 0
    assert PER_ROW[name](docs, labels.limit(0)).count() == len(TEXTS)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_scores_without_labels(docs, labels):
    none = labels.limit(0)
    assert {r["score"] for r in PER_ROW["quality"](docs, none).collect()} == {0.5}
    assert all(r["score"] < 1e-6 for r in PER_ROW["toxicity"](docs, none).collect())


def test_rules_of_texts_without_words(docs):
    got = by_id(quality_rules.judge(docs))
    assert all(got[i]["n_words"] == 0 and got[i]["base_failed"] and not got[i]["kept"] for i in (1, 2, 5))
    assert (got[4]["n_words"], got[3]["n_words"]) == (120_000, 1)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns


def test_language_of_texts_without_letters(docs):
    got = by_id(language_id.predict(docs, language_id.fit(docs)))
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1, 2, 5))


def test_line_dedup_cases(spark, docs):
    copies = documents(spark, [(2, "a\nb\nc\nd"), (1, "x\na\n\nb\nc"), (1, "x\na\n\nb\nc"), (None, None), (9, "")])
    out = line_dedup.dedup_lines(copies)
    assert out.columns == [*copies.columns, "n_lines_dedup", "n_removed_dedup"]
    got = {(r["doc_id"], r["text"], r["n_lines_dedup"], r["n_removed_dedup"]) for r in out.collect()}
    assert got == {(1, "x\na\n\nb\nc", 5, 0), (2, "d", 4, 3), (None, None, 0, 0), (9, "", 0, 0)}


def test_near_duplicate_cases(docs):
    got = by_id(near_dedup.near_duplicates(docs))
    assert got[6]["class_id"] == got[4]["class_id"] == 4
    assert all(got[i]["class_id"] == i for i in (1, 2, 3, 5, 7, 8)) and got[None]["class_id"] is None


def test_decontamination_cases(docs, benchmark):
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == {(3, 3), (4, 4), (6, 4), (None, None)}
    clean = decontamination.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 5, 7, 8]
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontamination.decontaminate(docs.limit(0), benchmark).count() == 0


def test_items_in_blocks_are_the_items_at_once(docs, benchmark):
    once, blocks = (decontamination.contaminated(docs, benchmark, items_per_block=n) for n in (20_000, 2))
    assert sorted(map(str, once.collect())) == sorted(map(str, blocks.collect()))


def test_packing_cases(docs):
    got = packing.pack(docs).collect()
    assert {r["doc_id"] for r in got} == {3, None, 4, 6, 7, 8}
    assert sum(r["length"] for r in got if r["doc_id"] == 4) == 120_000
    assert sum(r["doc_id"] == 3 for r in got) == 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_url_cases(spark):
    rows = [(1, None), (2, "no scheme"), (3, ""), (None, "http://A.ORG/x"), (4, "http://a.org/x"), (4, "http://a.org/x"), (5, "://"), (6, "http://h" + "/p" * 5000)]
    pages = spark.createDataFrame([(i, u, "s", 0.5) for i, u in rows], "page_id long, url string, host string, score double")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows) and {r["verdict"] for r in got} <= {"allow", "block"}
    assert [(r["host"], r["path"], r["rule"]) for r in got if r["page_id"] in (1, 2, 3, 5)] == [("", "", None)] * 4
    assert [(r["host"], r["rule"], r["verdict"]) for r in got if r["page_id"] is None] == [("a.org", "org/", "allow")]
    assert url_filter.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_documents(spark, docs, benchmark, tmp_path, name, stage):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        out = stage(spark, table, str(tmp_path))
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        assert out.count() >= 0
