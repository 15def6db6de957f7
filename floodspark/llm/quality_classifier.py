"""Quality by logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Tokens are runs of letters and digits, or of symbols, in their own case; terms are single tokens and
pairs of neighbours, hashed to 2 ** 18 slots, and their shapes (all capitals; the third of a row of equal tokens). A text's score is the
sparse dot product of its distinct terms with the weights. The fit uses at most ``train_rows`` labelled
documents outside the held-out fold; every document is scored over its whole text, without a shuffle.

Defined cases: a null or empty text scores as the bias alone; null labels and ids are not learnt from;
with no labels the score is 0.5; a null doc_id stays null and is not held out; repeated rows repeat
the result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample
from .hashed_terms import Ftrl, active_terms, sample_features, sigmoid, slots, sum_by_document
from .textblocks import ALNUM_AND_SYMBOLS, U64, Block, blocks, mix, tokens

FOLDS, HELD_OUT, TRAIN_ROWS = 4, 2, 8_000
THRESHOLD, ALPHA, L1, EPOCHS = 0.7, 1.0, 4.0, 8


def terms(block: Block) -> tuple[np.ndarray, np.ndarray]:
    words = tokens(block, ALNUM_AND_SYMBOLS)
    h, n = words.hashes, len(words.hashes)
    upper = (block.data >= 65) & (block.data <= 90)
    raised = np.concatenate([[0], np.cumsum(upper)])
    length = words.ends - words.starts
    shouted = (raised[words.ends] - raised[words.starts] == length) & (length > 1)
    out = np.empty(3 * n, U64)
    out[0::3] = h
    # A pair reaches over the end of a document only as a repeat of its last single token.
    pair = np.empty(n, U64)
    if n:
        pair[:-1] = mix(h[:-1] * U64(0xC2B2AE3D27D4EB4F) + h[1:])
        last = words.bounds[1:][words.counts > 0] - 1
        pair[last] = h[last]
    out[1::3] = pair
    tripled = np.zeros(n, bool)
    if n > 2:
        tripled[2:] = (h[2:] == h[1:-1]) & (h[1:-1] == h[:-2])
    out[2::3] = mix(U64(0xA0761D6478BD642F) + shouted.astype(U64) + U64(2) * tripled.astype(U64))
    return slots(out), 3 * words.bounds


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[float, np.ndarray]:
    """(bias, weights), the weights at single precision."""
    sample = labelled_sample(documents, labels, "quality", FOLDS, HELD_OUT, train_rows)
    rows, y = sample_features(sample, terms, partial(blocks, lower=False))
    model = Ftrl(alpha=ALPHA, l1=L1).fit(rows, y, epochs=EPOCHS)
    return model.bias, model.weights().astype(np.float32)


def score(documents: DataFrame, model: tuple[float, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = shared.value
        active = weights != 0
        for batch in batches:
            for block in blocks(batch.column("text"), lower=False):
                own, edges = active_terms(active, *terms(block))
                values = sigmoid(bias + sum_by_document(weights[own].astype(float), edges))
                ids = batch.column("doc_id").slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(values)], names=["doc_id", "score"])

    return (
        documents.select("doc_id", "text")
        .mapInArrow(scored, "doc_id long, score double")
        .select(
            "doc_id",
            (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
            "score",
            (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        )
    )
