"""Encoding and decoding against the library, and spans against the original bytes."""

import random

import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from floodspark.llm import queries, sentence_pieces as sp

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
LETTERS = "ab eT  \n\t\x00▁é中𐍈.#1９ﬁ①́　﻿"


def some_texts(n: int) -> list[str]:
    rng = random.Random(5)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*made, "", " ", "  ", "a" * 3000, " " * 3000, "▁", "word" * 500 + " end"]


def library_spans(text: str) -> list[tuple[int, int, int]]:
    pieces = (dict(sp._fields(v)) for f, v in sp._fields(LIBRARY.encode(text, out_type="serialized_proto")) if f == 2)
    return [(p.get(2, 0), p.get(4, 0), p.get(5, 0)) for p in pieces]


def test_spans_equal_the_librarys():
    vocabulary, known = sp._loaded(MODEL)
    for text in some_texts(800):
        ids, starts, ends = sp.encode_text(vocabulary, known, text, False)
        assert list(zip(ids.tolist(), starts.tolist(), ends.tolist())) == library_spans(text)


def test_spans_cover_the_text_in_order():
    vocabulary, known = sp._loaded(MODEL)
    for text in some_texts(300):
        raw = text.encode()
        ids, starts, ends = sp.encode_text(vocabulary, known, text, True)
        assert b"".join(raw[a:b] for a, b in zip(starts, ends)) == raw
        assert ids[-1] == vocabulary.end_id and starts[-1] == ends[-1] == len(raw)


def test_any_ids_are_decoded_as_the_library_does():
    vocabulary, _ = sp._loaded(MODEL)
    rng = random.Random(8)
    common = [0, 1, 2, LIBRARY.piece_to_id("▁"), LIBRARY.piece_to_id("▁▁"), 231, 187, 176]
    for _ in range(3000):
        ids = [rng.choice([*common, rng.randrange(3, 260), rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert sp.decode_ids(vocabulary, ids) == LIBRARY.decode(ids)
    assert sp.decode_ids(vocabulary, [5, 32000]) is None and sp.decode_ids(vocabulary, [-1]) is None


def test_many_lists_are_decoded_as_one_by_one():
    import numpy as np

    vocabulary, _ = sp._loaded(MODEL)
    rng = random.Random(10)
    common = [0, 1, 2, 2, LIBRARY.piece_to_id("▁"), 231, 187, 176]
    lists = [[rng.choice([*common, rng.randrange(32000)]) for _ in range(rng.randint(0, 6))] for _ in range(2000)]
    lists += [LIBRARY.encode(t, add_eos=True) for t in some_texts(200)] + [[]]
    got = sp.decode_lists(vocabulary, np.array(sum(lists, [])), np.cumsum([len(x) for x in lists]))
    assert got == [LIBRARY.decode(x) for x in lists]
    assert sp.decode_lists(vocabulary, np.zeros(0, np.int64), np.array([0, 0])) == ["", ""]
    assert sp.decode_lists(vocabulary, np.array([5, 99999, 5]), np.array([1, 2, 3])) == [LIBRARY.decode([5]), None, LIBRARY.decode([5])]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("strip", [False, True])
def test_normaliser_follows_a_compiled_map(rule, strip):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=strip)
    own = sp.Normaliser(library.serialized_normalizer_spec())
    for text in some_texts(800):
        normal, places = library.normalize(text, with_offsets=True)
        got, origin = own(text.encode())
        assert got.decode() == normal
        assert len(origin) == len(got) + 1 and (origin[1:] >= origin[:-1]).all()
        # The library counts characters: the place of each character of the result, and of the end.
        starts = [len(normal[:i].encode()) for i in range(len(normal) + 1)]
        assert [len(text.encode()[: origin[s]].decode()) for s in starts] == list(places) or not text


def test_every_document_equals_the_library(spark):
    folder = "/root/testdata/sf0.01"
    from hashlib import sha256

    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op13_sentence_pieces(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id], add_eos=True)
        want = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(LIBRARY.decode(ids).encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, 7, "x"), (1, "", 8, "y"), (None, "a b", 9, None), (None, "a b", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces int, `made.row` string")
    got = sp.encode(docs, MODEL, out="found")
    assert got.columns == [*docs.columns, "found"]
    found = [r.found.ids for r in got.collect()]
    assert found == [[2], [2], LIBRARY.encode("a b", add_eos=True), LIBRARY.encode("a b", add_eos=True)]
    lists = spark.createDataFrame([(None,), ([],), ([2],), ([99999],), ([2, None],)], "ids array<int>")
    assert [r.decoded for r in sp.decode(lists, MODEL).collect()] == ["", "", "", None, None]
    assert sp.decode(lists.limit(0), MODEL).count() == sp.encode(docs.limit(0), MODEL).count() == 0


def test_very_long_text_is_one_row(spark):
    text = "Ein langer Satz, 42 Wörter. " * 60_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = sp.encode(docs, MODEL).select(F.size("pieces.ids").alias("n"), F.element_at("pieces.ends", -1).alias("end")).first()
    assert row.n == len(LIBRARY.encode(text, add_eos=True)) and row.end == len(text.encode())


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        sp.Vocabulary(b"")
