"""Token counts of whole texts: pieces are counted once per distinct pre-token.

A pre-token of the piece model is a run of spaces with what follows up to the next space. The model writes
spaces as U+2581, so it reads that sign in a text as a space. No piece of the model has a space after another
character, so merges never cross pre-tokens, and the tokens of a text are those of its pre-tokens. The text itself gets a space in front, as the model adds.
A pre-token is named by its text less the first space.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shared_folder
from .textblocks import BLOCK_BYTES, Words, blocks, distinct_words, spans, text_bytes


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Pre-tokens of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    space = data == 0x20
    new = space.copy()
    new[1:] &= ~space[:-1]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    new[begins] = False
    cuts = np.flatnonzero(new)
    start = np.sort(np.concatenate((begins, cuts + 1)))
    end = np.sort(np.concatenate((cuts, offsets[1:][offsets[1:] > offsets[:-1]])))
    words = spans(data, offsets, start, end)
    # a pre-token that is one last space starts where the next text does: count by the ends instead
    words.first = np.searchsorted(end, offsets, "right") if len(end) else np.zeros(len(offsets), np.int64)
    return words


def check_model(model_path: str) -> None:
    """The model must keep texts as they are and have no piece with a space inside."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    odd = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if re.search("[^▁]▁", p)]
    if odd or sp.encode("a  b ", out_type=str)[0] != "▁a" or sp.encode("Ａ", out_type=str)[0] == "▁A":
        raise ValueError(f"pre-tokens don't hold for {model_path}: {odd[:3]}")


def with_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space for each U+2581 (three bytes, E2 96 81)."""
    sign = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
    if not len(sign):
        return data, offsets
    kept = np.ones(len(data), bool)
    kept[sign + 1] = kept[sign + 2] = False
    data = data.copy()
    data[sign] = 0x20
    return data[kept], offsets - 2 * np.searchsorted(sign, offsets)


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of texts (first row, bytes, offsets), where a text beyond a block is cut between pre-tokens.

    A cut drops one space, as the start of a text does, so the parts have the pre-tokens of the whole.
    """
    for row, data, offsets in blocks(column):
        data, offsets = with_spaces(data, offsets)
        a = 0
        if len(data) > 2 * BLOCK_BYTES:
            raw = data.tobytes()
            while len(raw) - a > 2 * BLOCK_BYTES:
                c = raw.find(b" ", a + BLOCK_BYTES)
                while c > 0 and raw[c - 1] == 0x20:
                    c = raw.find(b" ", c + 1)
                if not 0 < c < len(raw) - 1:
                    break
                yield row, data[a:c], np.array([0, c - a])
                a = c + 1
        yield row, data[a:], (offsets if a == 0 else np.array([0, len(data) - a]))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pre-tokens of each part, with how often they occur."""
    for batch in batches:
        for _, data, offsets in _parts(batch.column(0)):
            words = pre_tokens(data, offsets)
            at, of = distinct_words(words)
            raw = data.tobytes()
            tokens = [raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
            n = np.bincount(of, minlength=len(at))
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["token", "n"])


def _piece_counter(model_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            # an empty name is a lone space, which the model would drop without a text
            pieces = [len(ids) if t else 1 for t, ids in zip(tokens, sp.encode(tokens, num_threads=1), strict=True)]
            data, offsets = text_bytes(batch.column(0))
            hashes = spans(data, offsets, offsets[:-1], offsets[1:]).hashes().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pieces, pa.int64()), pa.array(hashes, pa.int64())],
                names=["token", "n", "pieces", "hash"],
            )

    return count


def _document_counter(head) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    tail_type = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces = head.value
        for batch in batches:
            _, every = text_bytes(batch.column(1))
            sums = np.zeros(batch.num_rows, np.int64)
            tails: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, data, offsets in _parts(batch.column(1)):
                words = pre_tokens(data, offsets)
                n_texts = len(offsets) - 1
                at, of = distinct_words(words)
                hashes = words.hashes()[at]
                place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                found = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
                # frequencies: how often each text has each pre-token
                pairs, times = np.unique(words.texts() * max(1, len(at)) + of, return_counts=True)
                text, token = np.divmod(pairs, max(1, len(at)))
                worth = np.where(found, pieces[place] if len(known) else 0, 0)
                sums[row : row + n_texts] += np.bincount(text, times * worth[token], n_texts).astype(np.int64)
                for i in np.flatnonzero(~found[token]).tolist():
                    tails[row + text[i]].append({"token": words.word(at[token[i]]).decode(), "n": int(times[i])})
            whole = [pa.array(x, pa.int64()) for x in (np.diff(every), sums)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *whole, pa.array(tails, tail_type)], names=["doc_id", "text_hash", "n_bytes", "head", "tail"]
            )

    return count


def token_counts(
    docs: DataFrame,
    model_path: str,
    limit: int = 4096,
    head_size: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Distinct pre-tokens are gathered with their corpus frequency, merged in each task first by
    their bytes, and each is encoded once. Documents then meet the counts by their own pre-token
    frequencies: the most frequent pre-tokens, ``head_size`` at most (16 bytes each, whatever the
    corpus), are sent to every task as sorted hashes; all others are joined by shuffle on their
    text. A hash that two pre-tokens of the corpus share is left to the join too, so counts are
    exact. Token ids are never kept. A text of many megabytes is worked on in parts of about one.
    A null text is the empty one, with no tokens. Rows that repeat an id and a text return a row
    each. Other columns are ignored.
    """
    spark = docs.sparkSession
    check_model(model_path)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = texts.select("text").mapInArrow(_distinct, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    path = f"{shared_folder(spark)}/pieces-{uuid4().hex}"
    vocabulary.mapInArrow(_piece_counter(model_path), "token string, n long, pieces long, hash long").write.parquet(path)
    pieces = spark.read.parquet(path)
    sizes = pieces.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count(F.lit(1)).alias("tokens")).collect()
    least, held = 1001, 0
    for r in sorted(sizes, key=lambda r: -r["n"]):
        if held + r["tokens"] > head_size:
            break
        least, held = r["n"], held + r["tokens"]
    # over all pre-tokens, so that a rare one can't pass for a frequent one of the same hash
    alone = pieces.groupBy("hash").agg(F.max("pieces").alias("pieces"), F.max("n").alias("n"), F.count(F.lit(1)).alias("tokens"))
    sent = alone.where((F.col("tokens") == 1) & (F.col("n") >= least)).select("hash", "pieces").toArrow()
    hashes, counts = sent["hash"].to_numpy().view(np.uint64), sent["pieces"].to_numpy()
    order = np.argsort(hashes)
    counted = texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _document_counter(spark.sparkContext.broadcast((hashes[order], counts[order]))),
        "doc_id long, text_hash long, n_bytes long, head long, tail array<struct<token: string, n: long>>",
    )
    key = ["doc_id", "text_hash"]
    # one checkpoint feeds both sides: what is rare, and the rows it is added to
    counted = checkpoint(counted)
    rare = counted.where("size(tail) > 0").dropDuplicates(key).select(*key, F.explode("tail").alias("t"))
    rest = (
        rare.select(*key, F.col("t.token").alias("token"), F.col("t.n").alias("times"))
        .join(pieces.select("token", "pieces"), "token")
        .groupBy(*key)
        .agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
        .withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"})
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & F.col("text_hash").eqNullSafe(F.col("of_hash"))
    summed = counted.select(*key, "n_bytes", "head").join(rest, same, "left").withColumn("rest", F.coalesce("rest", F.lit(0)))
    n_tokens = F.col("head") + F.col("rest")
    return summed.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
