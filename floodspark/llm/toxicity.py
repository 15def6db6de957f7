"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their first four bytes, hashed to 2 ** 18 slots. A text scores
``sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)`` over its distinct terms; the factors ``v`` carry
interactions of two terms (an insult next to a group name) that no sum of weights can express.

Linear weights are trained with FTRL updates, whose L1 part keeps only terms that carry signal by
themselves. Factors are trained by AdaGrad on the same examples: in a first pass for all common terms,
strongly shrunk, so that those of terms without interactions stay small; then for the terms with a
weight or a grown factor only. The fit uses at most ``train_rows`` labelled documents outside the
held-out fold, and of these at most ``TRAIN_TERMS`` terms; every document is scored, over its whole
text, without a shuffle.

Defined cases: a null or empty text scores as the bias alone; null labels and ids are not learnt
from; with no labels (or of one class only) the score is the share of toxic labels, or 0; a null
doc_id stays null and counts as held out; repeated rows repeat the result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample
from .hashed_terms import BITS, Ftrl, active_terms, sample_features, sigmoid, slots, sum_by_document
from .textblocks import U64, Block, blocks, mix, tokens

FOLDS, HELD_OUT, TRAIN_ROWS = 5, 0, 8_000
#: Terms of fewer training documents are not learnt from; L1 is strong, as insults are few among many words.
MIN_DOCUMENTS, ALPHA, L1, EPOCHS = 4, 1.0, 8.0, 8
#: Terms of so many documents get factors in the first pass; those of this length or more have grown.
PAIR_DOCUMENTS, FIRST_EPOCHS, FIRST_L2, GROWN = 20, 4, 0.02, 0.3


def terms(block: Block) -> tuple[np.ndarray, np.ndarray]:
    words, stems = tokens(block), tokens(block, prefix=4)
    both = np.empty(2 * len(words.hashes), U64)
    both[0::2] = words.hashes
    both[1::2] = mix(stems.hashes ^ U64(0x5851F42D4C957F2D))
    return slots(both), 2 * words.bounds


class FactorizationMachine:
    def __init__(self, factors: int = 4, seed: int = 3, alpha: float = ALPHA, l1: float = L1) -> None:
        self.linear = Ftrl(alpha=alpha, l1=l1)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (1 << BITS, factors))
        self.active = np.zeros(1 << BITS, bool)
        self.bias, self.w = 0.0, np.zeros(1 << BITS)

    def fit(
        self,
        rows: list[np.ndarray],
        labels: np.ndarray,
        epochs: int = EPOCHS,
        min_documents: int = MIN_DOCUMENTS,
        rate: float = 0.05,
        l2: float = 1e-3,
    ) -> FactorizationMachine:
        if len(set(labels.tolist())) < 2:
            share = np.clip(labels.mean() if len(labels) else 0.0, 1e-9, 1 - 1e-9)
            self.bias = float(np.log(share / (1 - share)))
            return self
        frequency = np.bincount(np.concatenate(rows), minlength=1 << BITS)
        rows = [r[frequency[r] >= min_documents] for r in rows]
        self.linear.fit(rows, labels, epochs=epochs)
        weights, bias = self.linear.weights(), self.linear.bias
        self.w, self.bias = weights.copy(), bias
        common = (frequency >= PAIR_DOCUMENTS) | (weights != 0)
        self.descend([r[common[r]] for r in rows], labels, FIRST_EPOCHS, rate, FIRST_L2)
        self.active = (weights != 0) | (np.linalg.norm(self.v, axis=1) >= GROWN)
        self.w, self.bias, self.v[~self.active] = weights.copy(), bias, 0
        self.descend([r[self.active[r]] for r in rows], labels, epochs, rate, l2)
        return self

    def descend(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int, rate: float, l2: float) -> None:
        """AdaGrad steps of the factors, and small ones of the weights, one document at a time."""
        squares = np.full(self.v.shape, 1e-6)
        rng = np.random.default_rng(17)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                own = rows[i]
                if len(own) < 2:
                    continue
                v = self.v[own]
                total = v.sum(axis=0)
                margin = self.bias + self.w[own].sum() + 0.5 * ((total**2).sum() - (v**2).sum())
                error = float(sigmoid(margin)) - labels[i]
                gradient = error * (total - v) + l2 * v
                squares[own] += gradient**2
                self.v[own] = v - rate * gradient / np.sqrt(squares[own])
                self.w[own] -= rate * error / len(own)

    def score(self, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of each document; ``found`` may have any terms, repeated or not."""
        own, edges = active_terms(self.active, found, bounds)
        v = self.v[own]
        total = sum_by_document(v, edges)
        pairs = 0.5 * ((total**2).sum(axis=1) - sum_by_document((v**2).sum(axis=1), edges))
        return sigmoid(self.bias + sum_by_document(self.w[own], edges) + pairs)

    def compact(self) -> FactorizationMachine:
        """What scoring needs, at single precision, for the broadcast."""
        self.linear = None
        self.v = np.where(self.active[:, None], self.v, 0).astype(np.float32)
        return self


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> FactorizationMachine:
    sample = labelled_sample(documents, labels, "toxic", FOLDS, HELD_OUT, train_rows)
    return FactorizationMachine().fit(*sample_features(sample, terms, partial(blocks, lower=True))).compact()


def score(documents: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                values = shared.value.score(*terms(block))
                ids = batch.column("doc_id").slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(values)], names=["doc_id", "score"])

    return (
        documents.select("doc_id", "text")
        .mapInArrow(scored, "doc_id long, score double")
        .select(
            "doc_id",
            (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
            "score",
            (F.col("score") >= 0.5).cast("int").alias("predicted"),
        )
    )
