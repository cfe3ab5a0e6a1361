"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: words, and their first letters, which stand for stems. The
machine's score is linear in the terms plus an inner product for each pair of them, so that two
terms may mean together what neither means alone. It is fitted on a bounded sample of labelled
rows; every document is then scored where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, one_text_per_id
from .textblocks import U64, blocks, split_words

BITS = 18
#: Bytes of a word that stand for its stem.
STEMS = (4, 5)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def hashed_terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of texts, the distinct terms of each: ``first`` (per text) and ``terms``."""
    for _, data, offsets in blocks(column):
        words = split_words(_LOWER[data], offsets, ~_LETTER)
        drop = U64(64 - BITS)
        kinds = [words.hashes(1), *(words.hashes(n, n) for n in STEMS)]
        terms = (np.concatenate(kinds) >> drop).astype(np.int64)
        text = np.tile(words.texts(), len(kinds))
        keys = np.unique((text << BITS) | terms)
        yield np.searchsorted(keys >> BITS, np.arange(len(offsets))), keys & ((1 << BITS) - 1)


@dataclass
class Machine:
    """Weights of the terms: ``bias``, ``linear`` (per term) and ``factors`` (per term and factor)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, first: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Probability that each text is toxic."""
        z = np.full(len(first) - 1, self.bias, np.float64)
        z += _sums(self.linear[terms], first)
        for f in self.factors:
            v = f[terms]
            z += 0.5 * (_sums(v, first) ** 2 - _sums(v * v, first))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    totals = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return totals[first[1:]] - totals[first[:-1]]


def _trust(first: np.ndarray, terms: np.ndarray, labels: np.ndarray, full_z: float) -> np.ndarray:
    """How far each term's own weight may move: 1 where its shares in the two classes differ by
    ``full_z`` standard errors, smoothly less where chance explains the difference."""
    n, n1 = len(labels), int(labels.sum())
    both = np.bincount(terms, minlength=1 << BITS)
    toxic = np.bincount(terms, np.repeat(labels, np.diff(first)), 1 << BITS)
    share = both / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / (n - n1)))
    z = np.abs(toxic / n1 - (both - toxic) / (n - n1)) / error
    return np.minimum(1, z / full_z) ** 4


def fit_machine(
    first: np.ndarray,
    terms: np.ndarray,
    labels: np.ndarray,
    n_factors: int = 4,
    epochs: int = 20,
    batch: int = 256,
    rate: float = 0.15,
    decay: float = 0.1,
    least_texts: float = 5e-4,
    full_z: float = 4.5,
    seed: int = 8,
) -> Machine:
    """Fit by minibatches with per-weight rates; rows of the rarer class weigh more.

    All terms of at least a share ``least_texts`` of the sample, three texts at least, have weights
    and factors. Those that tell little alone have smaller steps for their linear weight, so that
    texts aren't learned by heart, but the same steps for their factors.
    """
    rng = np.random.default_rng(seed)
    known = np.flatnonzero(np.bincount(terms, minlength=1 << BITS) >= max(3, least_texts * len(labels)))
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    linear, factors = np.zeros(1 << BITS, np.float32), np.zeros((n_factors, 1 << BITS), np.float32)
    share = float(np.mean(labels)) if len(labels) else 0.0
    if not 0 < share < 1 or not len(known):
        return Machine(float(np.log((share * len(labels) + 0.5) / ((1 - share) * len(labels) + 0.5))), linear, factors)
    at = place[terms]
    keep = at >= 0
    starts = np.concatenate((np.zeros(1, np.int32), np.cumsum(keep, dtype=np.int32)))[first]
    at = at[keep]
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    m, bias, bias_g = len(known), 0.0, 1e-8
    w, v = np.zeros(m), rng.normal(0, 0.02, (n_factors, m))
    w_g, v_g = np.full(m, 1e-8), np.full((n_factors, m), 1e-1)
    trust = _trust(first, terms, labels, full_z)[known]
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for b in range(0, len(order), batch):
            rows = order[b : b + batch]
            sizes = starts[rows + 1] - starts[rows]
            row = np.repeat(np.arange(len(rows)), sizes)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            i = at[np.repeat(starts[rows], sizes) + inner]
            n = len(rows)
            vi = v[:, i]
            s = np.stack([np.bincount(row, x, n) for x in vi])
            sq = np.stack([np.bincount(row, x * x, n) for x in vi])
            z = bias + np.bincount(row, w[i], n) + 0.5 * (s * s - sq).sum(0)
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / n
            e = error[row]
            seen = np.unique(i)
            g = np.bincount(i, e, m)[seen] + decay * w[seen] / n
            w_g[seen] += g * g
            w[seen] -= rate * trust[seen] * g / np.sqrt(w_g[seen])
            for f in range(n_factors):
                g = np.bincount(i, e * (s[f][row] - vi[f]), m)[seen] + decay * v[f][seen] / n
                v_g[f][seen] += g * g
                v[f][seen] -= 0.3 * rate * g / np.sqrt(v_g[f][seen])
            g = error.sum()
            bias_g += g * g
            bias -= rate * g / np.sqrt(bias_g)
    linear[known], factors[:, known] = w, v
    return Machine(bias, linear, factors)


def _featurized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [t[a:b].astype(np.int32).tobytes() for first, t in hashed_terms(batch.column(1)) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["doc_id", "label", "terms"])


def _scorer(machine) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [machine.value.score(first, terms) for first, terms in hashed_terms(batch.column(1))]
            found = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return score


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 20_000,
    max_mb: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Machine:
    """Fit on the labelled rows, or on ``max_labelled`` of them, chosen by a hash of the id.

    An id with several texts is fitted by one of them. Should the terms of the chosen texts fill more than
    ``max_mb`` on the driver, which fits, the sample ends there.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("of_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("of_id"), "of_id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most max_labelled rows of two numbers: small enough for each task
    rows = one_text_per_id(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("of_id")).select(F.col("doc_id").cast("long"), "text", "label"))
    featured = checkpoint(rows.mapInArrow(_featurized, "doc_id long, label int, terms binary"))
    # at most max_labelled rows, so one task may order them
    so_far = F.sum(F.octet_length("terms")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    within = featured.select("doc_id", so_far.alias("bytes")).where(F.col("bytes") <= max_mb << 20).select("doc_id")
    sample = featured.join(F.broadcast(within), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    packed = sample["terms"].to_pylist()
    first = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)))
    return fit_machine(first, np.frombuffer(b"".join(packed), np.int32), sample["label"].to_numpy())


def score_toxicity(docs: DataFrame, machine: Machine, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, predicted``.

    A null or empty text has the score of no terms at all. Without labels of both kinds all texts
    have one score. Repeated rows stay. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(_scorer(sent), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
