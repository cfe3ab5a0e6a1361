"""Near duplicates by SetSketch registers (Ertl, 2021), confirmed on whole sets.

A document is its set of shingles. A register of its sketch is the least of the exponentially distributed hash
values of all shingles, on an exponentially spaced scale, cut off at both ends. The sketch of a union is the larger
value of each register, so sketches of parts can be merged. Two registers agree with almost the probability of the
sets' similarity: rows of a band of registers that agree make a bucket of candidates. For a pair, the counts of
registers where one is larger, smaller or equal have a likelihood that is concave in the similarity; a pair goes on
unless its maximum lies well below the threshold. What goes on is compared by whole sets.

Only the connected groups are wanted, so no pair inside a group that is known to be connected is compared. First every
member of a bucket meets the bucket's leader, which joins most of a group of near copies, however large. Then
only buckets that still hold several groups are looked at: members outside the leader's group meet all others of the
bucket. Both steps work in cells of bounded size, and each gives a forest of links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, forget, join_by_hot_key, stored
from .components import components
from .near_duplicates import shingle_sets
from .textblocks import U64, mixed

#: Registers; those of a band; the base and rate of the scale, and its largest value.
REGISTERS, BAND = 256, 8
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Texts that are sketched at once. Weight (shingles, and 64 a sketch) of the members and of the ones they meet in a cell.
SIGNED, MEMBERS, OTHERS = 2048, 1 << 20, 1 << 18
_NO_ID = (1 << 63) - 1
_UNSET = np.iinfo(U64).max
_CELL = "a long, i int, j int, band int, role int, outer boolean, cls long, comp long, registers binary, shingles binary"


def set_sketches(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """REGISTERS registers of each set ``hashes[first[i]:first[i + 1]]``, none of which is empty.

    An element's values are drawn in order, one from each of as many equally likely strata of the exponential
    distribution as there are registers, and each goes to another register. Once all registers of a set are filled,
    later strata can't lower any, so a set of many elements stops after few draws.
    """
    n = len(first) - 1
    least = np.full(n * REGISTERS, _UNSET, U64)
    at = np.repeat(np.arange(n) * REGISTERS, np.diff(first))
    way = mixed(hashes ^ U64(0xA0761D6478BD642F))
    start, stride = way & U64(REGISTERS - 1), (way >> U64(32)) | U64(1)
    for turn in range(REGISTERS):
        value = mixed(hashes + U64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(12)
        slot = ((start + stride * U64(turn)) & U64(REGISTERS - 1)).astype(np.int64)
        np.minimum.at(least, at + slot, (U64(turn) << U64(52)) | value)
        if turn < 8 or turn % 16 == 0:
            left = (least.reshape(n, REGISTERS) == _UNSET).any(1)
            still = left[at // REGISTERS]
            if not still.all():
                at, hashes, start, stride = at[still], hashes[still], start[still], stride[still]
            if not len(at):
                break
    share = least.astype(np.float64) / float(1 << 52) / REGISTERS
    with np.errstate(divide="ignore"):
        scaled = np.floor(1 - np.log(-np.log1p(-share) / RATE) / np.log(BASE))
    return np.clip(scaled, 0, TOP).astype(np.uint16).reshape(n, REGISTERS)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def _score(similarity: np.ndarray | float, above: np.ndarray, below: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The derivative of the log-likelihood of a similarity, where ``above`` and ``below`` registers of the first set,
    which has a share ``u`` of both sets' sizes, are larger and smaller."""
    v, step = 1 - u, (BASE - 1) / BASE
    parts = []
    for x in (u - v * similarity, v - u * similarity):
        rest = 1 - np.maximum(x, 1e-12) * step
        parts.append((-np.log(rest) / np.log(BASE), step / (np.log(BASE) * rest)))
    (p, dp), (q, dq) = parts
    equal = REGISTERS - above - below
    return equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12) - above * v * dp / p - below * u * dq / q


def likely_similarity(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, by halving, as the likelihood is concave."""
    u = n / (n + m)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(40):
        middle = (low + high) / 2
        rising = _score(middle, above, below, u) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    return (low + high) / 2


def may_reach(similarity: float, above: np.ndarray, below: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Whether the similarity of greatest likelihood is at least this: the likelihood still rises here."""
    u = n / (n + m)
    return (similarity <= np.minimum(n, m) / np.maximum(n, m)) & (_score(similarity, above, below, u) >= 0)


def _binaries(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _sketches(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Registers of sets of which some may be empty, so many at once; those of an empty set are zeros."""
    n = len(first) - 1
    registers = np.zeros((n, REGISTERS), np.uint16)
    for a in range(0, n, SIGNED):
        part = first[a : a + SIGNED + 1]
        rows = np.flatnonzero(np.diff(part))
        if len(rows):
            registers[a + rows] = set_sketches(np.append(part[rows], part[-1]) - part[0], hashes[part[0] : part[-1]])
    return registers


def _sketcher(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's set as 128 bits and its sketch as a key for each band."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for first, hashes in shingle_sets(batch.column("text"), size, fold=True):
                n = np.diff(first)
                bands = np.full((len(n), REGISTERS // BAND), 0, U64) + np.arange(REGISTERS // BAND, dtype=U64)
                for eight in _sketches(first, hashes).reshape(len(n), -1, BAND).astype(U64).transpose(2, 0, 1):
                    bands = mixed(bands * U64(0xD6E8FEB86659FD93) + eight)
                sums = []
                for salt in (21, 22):
                    total = np.concatenate((np.zeros(1, U64), np.cumsum(mixed(hashes + U64(salt)), dtype=U64)))
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                columns = [batch.column(c).slice(row, len(n)) for c in ("doc_id", "text_hash")]
                ends = np.arange(len(n) + 1, dtype=np.int32) * bands.shape[1]
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1).view(np.int64)))
                columns += [pa.array(n, pa.int64()), *(pa.array(s, pa.int64()) for s in sums), listed]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "set1", "set2", "bands"])
                row += len(n)

    return sketch


def _packer(size: int, wanted: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Registers and shingles of the texts whose bit is set in ``wanted``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((wanted[bit >> 6] >> (bit & 63).astype(U64)) & U64(1) == U64(1)))
            row = 0
            for first, hashes in shingle_sets(batch.column("text"), size, fold=True):
                n = len(first) - 1
                sets = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                columns = [batch.column(c).slice(row, n) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*columns, _binaries(_sketches(first, hashes)), pa.array(sets, pa.binary())], names=["doc_id", "text_hash", "registers", "shingles"])
                row += n

    return pack


def _packed(rows: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """``cls, registers, shingles`` of the ``members``, whose texts are looked up by id and hash.

    A bit for each member, of at most 2 ** 27 bits in all, goes to every task, so that few of the other texts are packed
    and shuffled; the join decides.
    """
    n_bits = 1 << min(27, max(12, (32 * members.count()).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n_bits))
    word, place = F.shiftright(bit, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id, text_hash), {n_bits}L) % 64 as int))")
    words = members.groupBy(word.alias("word")).agg(F.bit_or(place).alias("bits")).toArrow()
    wanted = np.zeros(n_bits // 64, U64)
    wanted[words["word"].to_numpy()] = words["bits"].to_numpy().view(U64)
    texts = rows.select("doc_id", "text_hash", bit.alias("bit"), "text")
    packed = texts.mapInArrow(_packer(shingle, wanted), "doc_id long, text_hash long, registers binary, shingles binary")
    return checkpoint(packed.join(members, ["doc_id", "text_hash"]).dropDuplicates(["cls"]).select("cls", "registers", "shingles"))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sets, sorted, have ``percent`` in common."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def cell_links(cell: pa.Table, percent: int, margin: float) -> list[tuple[int, int]]:
    """A forest of the links that the rows of role 0 have to those of role 1, beyond the groups known before."""
    role, cls, comp, outer, band = (cell[c].to_numpy() for c in ("role", "cls", "comp", "outer", "band"))
    registers = np.array([np.frombuffer(r, np.uint16) for r in cell["registers"].to_pylist()])
    sets = [np.frombuffer(s, U64) for s in cell["shingles"].to_pylist()]
    n = np.array([len(s) for s in sets])
    _, group = np.unique(comp, return_inverse=True)
    inside = np.flatnonzero(role == 1)
    links = []
    for x in np.flatnonzero(role == 0):
        # a pair of two outer members comes twice
        near = inside[(group[inside] != group[x]) & ~(outer[inside] & (cls[inside] <= cls[x]))]
        if not len(near):
            continue
        equal = registers[near] == registers[x]
        if band[x] >= 0:
            # and one that shares several buckets is met in the first
            bands = equal.reshape(len(near), -1, BAND).all(2)
            mine = bands[:, band[x]] & ~bands[:, : band[x]].any(1)
            near, equal = near[mine], equal[mine]
        above = (registers[x] > registers[near]).sum(1)
        n_equal = equal.sum(1)
        may = may_reach(percent / 100 - margin, above, REGISTERS - n_equal - above, n[x], n[near])
        for y in near[may][np.argsort(-n_equal[may], kind="stable")]:
            if group[y] != group[x] and _linked(sets[x], sets[y], percent):
                links.append((int(cls[x]), int(cls[y])))
                group[group == group[y]] = group[x]
    return links


def _verifier(percent: int, margin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of the cells, whose rows come together."""

    def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        links = cell_links(pa.Table.from_batches(held), percent, margin)
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("a", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                key = tuple(keys[:, start])
                if held and key != last:
                    yield linked(held)
                    held = []
                last = key
                held.append(batch.slice(start, end - start))
        if held:
            yield linked(held)

    return verify


def _links(cells: DataFrame, sets: DataFrame, percent: int, margin: float) -> DataFrame:
    names = [c.split()[0] for c in _CELL.split(", ")]
    dealt = cells.join(sets, "cls").select(*names).repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")
    return checkpoint(dealt.mapInArrow(_verifier(percent, margin), "a long, b long"))


def _block(weight: str, most: int) -> Column:
    """Which of the blocks a class falls in, when all that meet weigh this much."""
    return F.pmod(F.xxhash64("cls"), F.ceil(F.col(weight) / most)).cast("int")


def _blocks(weight: str, most: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.ceil(F.col(weight) / most).cast("int") - 1))


def sketch_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, margin: float = 0.12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Words are split at ASCII spaces, A-Z as a-z. Documents whose sets of shingles have ``percent`` of their union
    in common are linked; ``component_id`` is the smallest id that links lead to, over any number of links, and ``kept``
    says whether it is the row's own. A text of fewer words than a shingle is one shingle; null and blank texts have none,
    are linked with nothing and kept. Rows that repeat an id are rows of their own. A null id counts as the largest, so
    ``component_id`` is null only where all that links lead to have none; such a row is kept if ``component_id`` is null. Other
    columns are ignored.

    Links found are exact, on 64-bit hashes of shingles. A link at the bare threshold is missed by all bands with a probability
    of 4e-5, and by the estimate, which keeps all pairs down to ``margin`` below it, in one of 10 million cases; a
    document has to lose all its links to leave its component. Rows of one set are merged in each task before they are
    shuffled, and a set is held once for all its rows.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sketches, path = stored(rows.mapInArrow(_sketcher(shingle), "doc_id long, text_hash long, n long, set1 long, set2 long, bands array<long>"))
    classes = checkpoint(
        sketches.where("n > 0")
        .groupBy("set1", "set2", "n")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
        .select("set1", "set2", "n", "rep", "copies", "bands", F.monotonically_increasing_id().alias("cls"))
    )
    sketches = checkpoint(sketches.drop("bands", "text_hash"))
    forget(docs.sparkSession, path)
    placed = classes.select("cls", (F.col("n") + 64).alias("weight"), F.posexplode("bands").alias("band", "node"))
    nodes = checkpoint(placed.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.min("cls").alias("leader")).where("rows > 1"))
    at = checkpoint(join_by_hot_key(placed, nodes, ["node"], "rows"))
    members = checkpoint(classes.select("rep.*", "cls").join(at.select("cls").distinct(), "cls", "left_semi"))
    sets = _packed(rows, members, shingle)

    # every member of a bucket meets its leader
    met = checkpoint(at.where("cls <> leader").select("leader", "cls", "weight").distinct())
    leaders = checkpoint(met.groupBy("leader").agg(F.sum("weight").alias("all"), F.count(F.lit(1)).alias("rows")))
    own = join_by_hot_key(met, leaders, ["leader"], "rows")
    plain = [F.lit(-1).alias("band"), F.lit(False).alias("outer"), "cls", F.col("cls").alias("comp")]
    cells = own.select(F.col("leader").alias("a"), F.lit(0).alias("i"), _block("all", MEMBERS).alias("j"), F.lit(1).alias("role"), *plain).unionByName(
        leaders.select(F.col("leader").alias("a"), F.lit(0).alias("i"), _blocks("all", MEMBERS).alias("j"), F.lit(0).alias("role"), F.col("leader").alias("cls")).select(
            "a", "i", "j", "role", *plain
        )
    )
    links = _links(cells, sets, percent, margin)

    # where a bucket still holds several groups, members outside its leader's meet all others
    found = components(links).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    grouped = checkpoint(at.join(found, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    mixed_nodes = grouped.groupBy("node").agg(
        F.min_by("comp", "cls").alias("major"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("rows_left")
    )
    mixed_nodes = checkpoint(mixed_nodes.where("low <> high and rows_left > 2").select("node", "major", "rows_left"))
    left = join_by_hot_key(grouped, mixed_nodes, ["node"], "rows_left").where("cls <> leader")
    left = checkpoint(left.select("node", "band", "cls", "comp", "weight", (F.col("comp") != F.col("major")).alias("outer")))
    of = checkpoint(left.groupBy("node").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("outer"), F.col("weight"))).alias("out"), F.count(F.lit(1)).alias("rows")))
    left = checkpoint(join_by_hot_key(left, of, ["node"], "rows"))
    common = ["band", "outer", "cls", "comp"]
    cells = left.select(F.col("node").alias("a"), _blocks("out", OTHERS).alias("i"), _block("all", MEMBERS).alias("j"), F.lit(1).alias("role"), *common).unionByName(
        left.where("outer").select(F.col("node").alias("a"), _block("out", OTHERS).alias("i"), _blocks("all", MEMBERS).alias("j"), F.lit(0).alias("role"), *common)
    )
    links = links.unionByName(_links(cells, sets, percent, margin))

    roots = components(links).withColumnRenamed("node", "cls")
    joined = checkpoint(roots.join(classes.select("cls", F.col("rep.doc_id").alias("least")), "cls"))
    first = checkpoint(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows")))
    named = join_by_hot_key(joined.select("cls", "root"), first, ["root"], "rows").select("cls", "component_id")
    told = classes.select("set1", "set2", "n", "copies", "cls", F.col("rep.doc_id").alias("own")).join(named, "cls", "left")
    told = checkpoint(told.select("set1", "set2", "n", "copies", F.coalesce("component_id", "own").alias("component_id")))
    known = join_by_hot_key(sketches.where("n > 0").select("doc_id", "n", "set1", "set2"), told, ["set1", "set2", "n"], "copies")
    blank = sketches.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    every = known.select("doc_id", "n", "component_id").unionByName(blank)
    named_id = [F.when(F.col(c) != _NO_ID, F.col(c)).alias(c) for c in ("doc_id", "component_id")]
    return every.select(named_id[0], F.col("n").alias("n_shingles"), named_id[1], (F.col("doc_id") == F.col("component_id")).alias("kept"))
