"""Quality classifier by co-training.

Two views of a page are classified apart: its text content (its words, hashed to buckets, repeated
words, and which kinds of characters follow each other) and its metadata (language, source, and
layout such as lines and lengths). In each round, each view's classifier labels pool documents that
it is sure of, and these pseudo-labels join the other view's training rows. The pool is every
document outside the labelled sample; it stays in Spark. The views are calibrated on held-back
labels and combined to score all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, one_text_per_id
from .textblocks import blocks, split_words

#: Kinds of bytes: letter, capital, digit, space, line end, punctuation, other sign.
_KIND = np.full(256, 6, np.uint8)
_KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 0
_KIND[0x41:0x5B] = 1
_KIND[0x30:0x3A] = 2
_KIND[[0x20, 0x09]] = 3
_KIND[[0x0A, 0x0D]] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
KINDS = 7
#: Buckets that words are hashed to, A-Z lower-cased.
TERMS = 128
LANGS, SOURCES = 16, 32
#: Pieces that a sum over all tasks is added up in, each by one task.
CHUNKS = 16
CONTENT, META = KINDS * KINDS + 2 + TERMS, LANGS + SOURCES + 5


def _shares(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _by_text(codes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """How often each text has each code below ``size``."""
    return np.stack([np.bincount(codes[a:b], minlength=size) for a, b in zip(first[:-1], first[1:], strict=True)])


def page_views(text: pa.Array, lang: list[str | None], source: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of the two views, ``content`` and ``meta``, for each block of texts."""
    for row, data, offsets in blocks(text):
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        kind = _KIND[data]
        follows = np.zeros(len(data), np.uint8)
        follows[:-1] = kind[:-1] * KINDS + kind[1:]
        pairs = _by_text(follows, offsets, KINDS * KINDS)
        # a text's last byte is followed by none of its own
        ends = np.flatnonzero(sizes)
        np.subtract.at(pairs, (ends, follows[offsets[1:][ends] - 1]), 1)
        words = split_words(_LOWER[data], offsets)
        n_words, of = np.diff(words.first), words.texts()
        hashes = words.hashes()
        again = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        repeats = np.bincount(of[1:][again], minlength=n)
        # the text above 40 bits of the hash: sorted, equal words of a text are neighbours
        keys = np.unique((of.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        distinct = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=n)
        terms = _by_text((hashes % np.uint64(TERMS)).astype(np.uint8), words.first, TERMS)
        content = np.column_stack(
            (np.sqrt(_shares(pairs, sizes[:, None])), _shares(repeats, n_words), _shares(distinct, n_words), np.sqrt(_shares(terms, n_words[:, None])))
        )
        line_ends = np.concatenate(([0], np.cumsum(data == 0x0A)))
        lines = 1 + line_ends[offsets[1:]] - line_ends[offsets[:-1]]
        meta = np.zeros((n, META))
        for i in range(n):
            meta[i, crc32(("l" + (lang[row + i] or "")).encode()) % LANGS] = 1
            meta[i, LANGS + crc32(("s" + (source[row + i] or "")).encode()) % SOURCES] = 1
        meta[:, -5] = np.log1p(sizes)
        meta[:, -4] = np.log1p(lines)
        meta[:, -3] = np.log1p(sizes / lines)
        meta[:, -2] = np.log1p(n_words)
        meta[:, -1] = _shares(sizes, n_words).clip(0, 40)
        yield content, meta


@dataclass
class Logistic:
    """A logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
    """Newton's method with a ridge penalty; small dense inputs."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + penalty * w
        h = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


@dataclass
class CoTrained:
    """The two views' classifiers, their calibrations, and the calibration of their sum."""

    content: Logistic | None
    meta: Logistic | None
    calibrations: tuple[tuple[float, float], ...] = ()
    prior: float = 0.0
    n_pool: int = 0

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Calibrated probabilities that a document is good: content, meta, both."""
        if self.content is None:
            return np.ones((len(content), 3))
        (a1, b1), (a2, b2), (a, b) = self.calibrations
        z1, z2 = a1 * self.content.logit(content) + b1, a2 * self.meta.logit(meta) + b2
        z = a * (z1 + z2 - self.prior) + b
        return 1 / (1 + np.exp(-np.clip(np.column_stack((z1, z2, z)), -30, 30)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a score into a log-odds; smoothed targets, so perfect scores don't diverge."""
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    fit = fit_logistic(z[:, None], target, np.ones(len(z)), ridge=1e-2)
    slope = float(fit.weights[0] / fit.scale[0])
    return max(slope, 0.0), float(fit.bias - fit.weights[0] * fit.mean[0] / fit.scale[0])


@dataclass
class Rule:
    """What a view labelled in a round, for the other view's training: documents of a logit from ``good`` up and to ``bad`` down."""

    view: int
    model: Logistic
    good: float
    bad: float


def pseudo_labels(views: tuple[np.ndarray, np.ndarray], rules: list[Rule]) -> list[np.ndarray]:
    """Labels that the rules give documents for the training of each view; NaN for none. The first rule holds."""
    found = [np.full(len(views[0]), np.nan) for _ in views]
    for rule in rules:
        z, mine = rule.model.logit(views[rule.view]), found[1 - rule.view]
        free = np.isnan(mine)
        mine[free & (z >= rule.good)] = 1.0
        mine[free & (z <= rule.bad)] = 0.0
    return found


def _statistics(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float, model: Logistic) -> np.ndarray:
    """Gradient of the log-loss, then the matrix of a quadratic that touches it here and is nowhere below (Jaakkola, Jordan), so that no step overshoots."""
    z = np.column_stack(((x - model.mean) / model.scale, np.ones(len(x)))).astype(np.float32)
    t = np.clip(z @ np.append(model.weights, model.bias), -30, 30)
    p = 1 / (1 + np.exp(-t))
    curve = np.where(np.abs(t) < 1e-3, 0.25, np.tanh(t / 2) / (2 * np.where(np.abs(t) < 1e-3, 1.0, t)))
    # single precision for the quadratic, which only shapes the steps; the gradient in full
    h = (z * (weight * curve).astype(np.float32)[:, None]).T @ z
    return np.concatenate((z.T @ (weight * (p - y)), h.ravel().astype(np.float64)))


def _partial_sums(pool: DataFrame, per_block: Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray]) -> DataFrame:
    """``chunk, total``: the sum over the pool in CHUNKS pieces, each added up by one task from those of all tasks, in their order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, CONTENT + META)
            found = per_block((x[:, :CONTENT], x[:, CONTENT:]))
            total = found if total is None else total + found
        if total is not None:
            pieces = [c.tobytes() for c in np.array_split(total, CHUNKS)]
            at = pa.array([TaskContext.get().partitionId()] * CHUNKS, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), at, pa.array(pieces, pa.binary())], names=["chunk", "part", "total"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, piece in zip(batch.column("chunk").to_pylist(), batch.column("total").to_pylist(), strict=True):
                totals[chunk] = totals.get(chunk, 0.0) + np.frombuffer(piece, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["chunk", "total"])

    dealt = pool.select("views").mapInArrow(add, "chunk int, part int, total binary").repartition(CHUNKS, "chunk").sortWithinPartitions("chunk", "part")
    return dealt.select("chunk", "total").mapInArrow(merge, "chunk int, total binary")


def _summed(pool: DataFrame, per_block: Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray]) -> np.ndarray | float:
    """Sum over the pool, added up in Spark: the driver gets one sum, however many tasks there are."""
    pieces = dict(zip(*_partial_sums(pool, per_block).toArrow().to_pydict().values(), strict=True))
    return np.concatenate([np.frombuffer(pieces[k], np.float64) for k in sorted(pieces)]) if pieces else np.float64(0)


def _cut(counts: np.ndarray, most: int, edges: np.ndarray) -> float:
    """The least confident logit of the ``most`` surest documents; those in the same narrow bin as the last count too."""
    from_top = np.cumsum(counts[::-1])
    if not from_top[-1]:
        return np.inf
    return float(edges[len(counts) - 1 - min(int(np.searchsorted(from_top, most)), len(counts) - 1)])


def co_train(
    views: tuple[np.ndarray, np.ndarray],
    y: np.ndarray,
    pool: DataFrame,
    rounds: int = 4,
    sure: float = 0.97,
    share: float = 0.1,
    held_back: float = 0.25,
    pseudo_weight: float = 0.3,
    steps: int = 4,
    ridge: float = 1.0,
) -> CoTrained:
    """Fit on labelled ``views`` and an unlabelled ``pool`` of any size (``views``, packed), which stays in Spark.

    In each round a view may label about ``share`` of the pool, those it is ``sure`` of, in the
    classes' proportions. Confidence is counted in bins and the fits' statistics are summed in each
    task, so only sums come to the driver. ``held_back`` of the labelled rows, the last ones, only calibrate.
    """
    cut = max(4, int(len(y) * (1 - held_back)))
    good = float(y[:cut].mean())
    x = [v[:cut] for v in views]

    def moments(block: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.concatenate([[len(block[0])], *[m for v in block for m in (v.sum(0, dtype=np.float64), (v * v).sum(0, dtype=np.float64))]])

    all_rows = _summed(pool, moments)
    n_pool = int(all_rows[0]) if np.ndim(all_rows) else 0
    n, *parts = np.split(all_rows + moments(tuple(x)), np.cumsum([1, CONTENT, CONTENT, META]))
    models = []
    for total, squares in (parts[:2], parts[2:]):
        mean = total / n
        models.append(Logistic(mean, np.sqrt(np.maximum(squares / n - mean**2, 0)) + 1e-6, np.zeros(len(mean)), 0.0))
    least = float(np.log(sure / (1 - sure)))
    edges = np.linspace(least, 30, 4001)
    rules: list[Rule] = []
    sizes = [(v.shape[1] + 1) * (v.shape[1] + 2) for v in views]
    for turn in range(rounds + 1):
        for _ in range(steps if rules else 25):
            now, known = list(models), list(rules)

            def newton(block: tuple[np.ndarray, np.ndarray], now=now, known=known) -> np.ndarray:
                sums = []
                for v, label, model in zip(block, pseudo_labels(block, known), now, strict=True):
                    told = ~np.isnan(label)
                    sums.append(_statistics(v[told], label[told], pseudo_weight, model))
                return np.concatenate(sums)

            own = np.concatenate([_statistics(v, y[:cut], np.ones(cut), m) for v, m in zip(x, now, strict=True)])
            stats = np.split(own + (_summed(pool, newton) if rules else 0), [sizes[0]])
            moved = 0.0
            for k, m in enumerate(now):
                d = len(m.weights) + 1
                penalty, w = np.full(d, ridge), np.append(m.weights, m.bias)
                penalty[-1] = 1e-3
                step = np.linalg.solve(stats[k][d:].reshape(d, d) + np.diag(penalty), stats[k][:d] + penalty * w)
                models[k] = Logistic(m.mean, m.scale, (w - step)[:-1], float((w - step)[-1]))
                moved = max(moved, float(np.abs(step).max()))
            if moved < 1e-3:
                break
        if turn == rounds or not n_pool:
            break
        now, known = list(models), list(rules)

        def confidence(block: tuple[np.ndarray, np.ndarray], now=now, known=known) -> np.ndarray:
            free = [np.isnan(label) for label in pseudo_labels(block, known)]
            z = [m.logit(v)[free[1 - k]] for k, (m, v) in enumerate(zip(now, block, strict=True))]
            return np.concatenate([np.histogram(s * zk, edges)[0] for zk in z for s in (1, -1)]).astype(np.float64)

        counts = np.split(_summed(pool, confidence), 4)
        for k in (0, 1):
            most = [int(np.ceil(share * part * n_pool)) for part in (good, 1 - good)]
            rules.append(Rule(k, now[k], _cut(counts[2 * k], most[0], edges), -_cut(counts[2 * k + 1], most[1], edges)))
    back = slice(cut, None) if len(np.unique(y[cut:])) == 2 else slice(None)
    z = [m.logit(v[back]) for m, v in zip(models, views, strict=True)]
    calibrated = [_platt(zk, y[back]) for zk in z]
    prior = float(np.log(good / (1 - good)))
    both = sum(a * zk + b for (a, b), zk in zip(calibrated, z, strict=True)) - prior
    return CoTrained(models[0], models[1], (*calibrated, _platt(both, y[back])), prior, n_pool)


def _with_views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        both = [np.hstack(v) for v in page_views(batch.column(1), lang, source)]
        rows = [r.astype(np.float32).tobytes() for v in both for r in v]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(rows, pa.binary())], names=["doc_id", "label", "views"])


def _scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [model.value.score(c, m) for c, m in page_views(batch.column(0), lang, source)]
            p = np.concatenate(found) if found else np.zeros((0, 3))
            rest = [batch.column(i) for i in range(3, batch.num_columns)]
            names = [batch.schema.field(i).name for i in range(3, batch.num_columns)]
            scores = [pa.array(p[:, k], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*rest, *scores], names=[*names, "content_score", "meta_score", "score"])

    return score


def _string(docs: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 10_000,
    id_col: str = "doc_id",
    label_col: str = "quality",
) -> CoTrained:
    """Fit on ``max_labelled`` labelled documents, chosen by a hash of the id, and on all other
    documents as the unlabelled pool. Without enough labels of both kinds nothing is rejected later.
    An id with several texts is fitted by one of them, so the driver holds ``max_labelled`` feature rows at most."""
    key = F.xxhash64(F.lit(1), "of_id")
    labelled = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("of_id"))
        .agg(F.min(label_col).cast("int").alias("label"))
        .orderBy(key, "of_id")
        .limit(max_labelled)
    )
    texts = docs.select(
        F.col(id_col).alias("doc_id"), _string(docs, "text").alias("text"), _string(docs, "lang").alias("lang"), _string(docs, "source").alias("source")
    )
    labelled = checkpoint(labelled)
    same = F.col("doc_id") == F.col("of_id")
    rows = one_text_per_id(texts.join(F.broadcast(labelled), same).select(F.col("doc_id").cast("long"), "text", "lang", "source", "label"))
    found = rows.mapInArrow(_with_views, "doc_id long, label int, views binary").toArrow()
    x = np.frombuffer(b"".join(found["views"].to_pylist()), np.float32).reshape(-1, CONTENT + META).astype(np.float64)
    ids, y = found["doc_id"].to_numpy(), found["label"].to_pandas().to_numpy(dtype=np.float64)
    order = np.lexsort((*x.T[:3], ids, np.array([crc32(str(i).encode()) for i in ids])))
    x, y = x[order], y[order]
    cut = max(4, int(len(y) * 0.75))
    if len(y) < 8 or y.min() == y.max() or y[:cut].min() == y[:cut].max():
        return CoTrained(None, None)
    others = texts.join(F.broadcast(labelled), same, "left_anti").select(
        F.col("doc_id").cast("long"), "text", "lang", "source", F.lit(None).cast("int").alias("label")
    )
    pool = checkpoint(others.mapInArrow(_with_views, "doc_id long, label int, views binary").select("views"))
    return co_train((x[:, :CONTENT], x[:, CONTENT:]), y, pool)


def score_quality(docs: DataFrame, model: CoTrained, threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """Score every row: ``columns`` (by default ``doc_id``), ``content_score, meta_score, score, keep``.

    A row is kept when its combined probability of being good reaches ``threshold``. Null texts are
    empty ones; null or missing languages and sources are values of their own. Repeated rows stay.
    ``columns`` must not have the names of the four added ones; pack clashing ones in a struct.
    """
    columns = ["doc_id"] if columns is None else columns
    sent = docs.sparkSession.sparkContext.broadcast(model)
    views = docs.select(
        _string(docs, "text").alias("__text"), _string(docs, "lang").alias("__lang"), _string(docs, "source").alias("__source"), *columns
    )
    scores = [T.StructField(name, T.DoubleType()) for name in ("content_score", "meta_score", "score")]
    schema = T.StructType([*docs.select(*columns).schema.fields, *scores])
    return views.mapInArrow(_scorer(sent), schema).withColumn("keep", F.col("score") >= threshold)
