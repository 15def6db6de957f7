"""Items of a few words in long documents are all found."""

import random

import pytest

from floodspark.llm import decontamination


@pytest.mark.parametrize("n_words", range(1, 13))
def test_short_items_in_long_documents(n_words):
    rng = random.Random(n_words)
    items = [(i, " ".join(f"i{i}w{w}" for w in range(n_words))) for i in range(150)]
    texts, wanted = [], set()
    for d in range(30):
        words = [f"d{rng.randrange(5000)}" for _ in range(3000)]
        for i in range(d * 5, d * 5 + 5):
            words.insert(rng.randrange(len(words)), items[i][1])
            wanted.add((d, i))
        texts.append(" ".join(words))
    indexes = decontamination.build_indexes(items, decontamination.K, decontamination.HASHES)
    found = {(d, i) for d, i, *_ in decontamination._found(texts_array(texts), indexes, 0.8)}
    # An item that was put into another one is found only where it is whole.
    whole = {(d, i) for d, i in wanted if f" {items[i][1]} " in f" {texts[d]} "}
    assert found == whole


def texts_array(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())
