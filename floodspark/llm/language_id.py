"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound from its letters' vectors,
each permuted (rolled) by its place; a text's profile bundles (sums) the vectors of all its
trigrams, word edges included. A language's prototype bundles the normalised profiles of its training
texts. A text gets the language whose prototype has the largest cosine with its profile.

Letters are lower-cased; 63 codes are shared by all letters of Unicode (a-z have their own). The
prototypes are fitted on at most ``train_rows`` documents outside the held-out fold, and have a fixed
size; every document is compared over its whole text, without a shuffle.

Defined cases: a null text and a text without a letter get ``und`` and 0, and are not learnt from; so
does every text if nothing could be learnt. Of equal cosines the language first in the alphabet counts.
A null doc_id stays null and counts as held out; repeated rows repeat the result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold

FOLDS, HELD_OUT, TRAIN_ROWS = 5, 0, 8_000
DIMENSIONS, CODES = 1024, 64
BLOCK_CHARS, BLOCK_TEXTS, GRAMS_AT_ONCE = 1 << 19, 512, 8_192


@cache
def _letter_codes() -> np.ndarray:
    """The code of each code point, 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            out[point] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (CODES - 27)
    return out


_LETTERS = (np.random.default_rng(29).integers(0, 2, (CODES, DIMENSIONS)) * 2 - 1).astype(np.float32)


def trigram_vectors(trigrams: np.ndarray) -> np.ndarray:
    a, b, c = trigrams >> 12, trigrams >> 6 & 63, trigrams & 63
    return np.roll(_LETTERS, 2, axis=1)[a] * np.roll(_LETTERS, 1, axis=1)[b] * _LETTERS[c]


def profiles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(profile, has a letter) of each text; ``GRAMS_AT_ONCE`` trigrams are bundled at a time."""
    joined = " ".join(f" {t} " if t else " " for t in texts) + "  "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letter_codes()[points].astype(np.int32)
    sizes = np.array([len(t) + 2 if t else 1 for t in texts]) + 1
    ends = np.cumsum(sizes)
    grams = codes[:-2] << 12 | codes[1:-1] << 6 | codes[2:]
    at = np.flatnonzero(codes[1:-1])
    doc = np.searchsorted(ends, at, "right")
    seen, place = np.unique(grams[at], return_inverse=True)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for first in range(0, len(seen), GRAMS_AT_ONCE):
        some = seen[first : first + GRAMS_AT_ONCE]
        inside = (place >= first) & (place < first + len(some)) if len(seen) > GRAMS_AT_ONCE else slice(None)
        counts = np.bincount(doc[inside] * len(some) + place[inside] - first, minlength=len(texts) * len(some))
        out += counts.reshape(len(texts), -1).astype(np.float32) @ trigram_vectors(some)
    return out, np.bincount(doc, minlength=len(texts)) > 0


def _parts(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """Blocks of whole texts, of about BLOCK_CHARS characters and BLOCK_TEXTS texts, and where they start."""
    first, size, part = 0, 0, []
    for i, text in enumerate(texts.to_pylist()):
        part.append(text)
        size += len(text or "")
        if size >= BLOCK_CHARS or len(part) >= BLOCK_TEXTS:
            yield first, part
            first, size, part = i + 1, 0, []
    if part:
        yield first, part


def normalised(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def fit(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages in order, their normalised prototypes)."""
    known = documents.select("doc_id", "text", "lang").where("text is not null and lang is not null and doc_id is not null")
    sample = bounded_sample(known.where(fold("doc_id", FOLDS) != HELD_OUT), "doc_id", train_rows)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for first, part in _parts(batch.column("text")):
                vectors, _ = profiles(part)
                langs = batch.column("lang").slice(first, len(part)).to_pylist()
                for lang, vector in zip(langs, normalised(vectors)):
                    total[lang] = total.get(lang, 0) + vector
        for lang, vector in total.items():
            rows = {"lang": [lang] * DIMENSIONS, "place": np.arange(DIMENSIONS, dtype=np.int32), "value": vector.astype(float)}
            yield pa.RecordBatch.from_pydict(rows)

    # Rounded sums do not depend on the order in which partitions are added.
    rows = (
        sample.mapInArrow(bundle, "lang string, place int, value double")
        .groupBy("lang", "place")
        .agg(F.round(F.sum("value"), 6).alias("value"))
        .toArrow()
        .sort_by([("lang", "ascending"), ("place", "ascending")])
    )
    languages = sorted(set(rows.column("lang").to_pylist()))
    return languages, normalised(rows.column("value").to_numpy().reshape(len(languages), DIMENSIONS)).astype(np.float32)


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prototypes = shared.value
        names = np.array([*languages, "und"], object)
        for batch in batches:
            for first, part in _parts(batch.column("text")):
                vectors, lettered = profiles(part)
                best, score = np.full(len(part), len(languages)), np.zeros(len(part))
                if languages:
                    cosines = normalised(vectors) @ prototypes.T
                    best = np.where(lettered, cosines.argmax(axis=1), len(languages))
                    score = np.where(lettered, np.clip(cosines.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(part)), pa.array(names[best]), pa.array(score.astype(float))],
                    names=["doc_id", "lang_pred", "score"],
                )

    return (
        documents.select("doc_id", "text")
        .mapInArrow(compared, "doc_id long, lang_pred string, score double")
        .select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
    )
