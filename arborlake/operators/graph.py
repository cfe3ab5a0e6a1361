"""Graph operators: components, density clusters, geodesic labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import near
from ..plans.lineage import checkpoint, forget, stored
from .neighbours import nearest_k_both_ways
from .tiles import coordinates, cut_tiles, dealt


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root`` for every node; the root is the smallest node of its component.

    Each round a node takes the least root among its neighbours, and then its root's root, so that
    long chains halve. Rounds end when no root changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpoint(both.where("a <> b").distinct())
    roots = checkpoint(nodes.select("node", F.col("node").alias("root")))
    while True:
        told = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("least"))
        hooked = roots.join(told, F.col("node") == F.col("a"), "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("least", "root")).alias("mid")
        )
        jump = hooked.select(F.col("node").alias("at"), F.col("mid").alias("further"))
        after = checkpoint(hooked.join(jump, F.col("mid") == F.col("at")).select("node", "old", F.col("further").alias("root")))
        changed = after.where("old <> root").limit(1).count()
        roots = after.select("node", "root")
        if not changed:
            return roots


#: Links between clusters of different tiles that the driver joins itself; beyond, they are joined in rounds.
_FEW_LINKS = 200_000


def joined_names(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, cluster, whole``: the least name of each cluster that is linked to others (``keys, a, b``)."""
    n = links.count()
    if n > _FEW_LINKS:
        ends = [F.struct(*keys, F.col(c).alias("name")).alias(c) for c in ("a", "b")]
        edges = checkpoint(links.select(*ends))
        nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        return components(nodes, edges).select(*[f"node.{k}" for k in keys], F.col("node.name").alias("cluster"), F.col("root.name").alias("whole"))
    table = links.toArrow()
    group = near.codes(table, keys)
    names, at = np.unique(np.column_stack([np.tile(group, 2), np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()])]), axis=0, return_inverse=True)
    at = at.reshape(-1)
    root = near.components(len(names), at[:n], at[n:])
    # names are sorted inside each group, so the first node of a component has its least name
    _, rows = np.unique(at, return_index=True)
    told = {k: table[k].take(pa.array(rows % max(1, n))) for k in keys}
    told = pa.table(told | {"cluster": pa.array(names[:, 1]), "whole": pa.array(names[root, 1])})
    shape = [*(f"`{k}` {links.schema[k].dataType.simpleString()}" for k in keys), "cluster long", "whole long"]
    return links.sparkSession.createDataFrame(told, schema=", ".join(shape))


def density_clusters(points: DataFrame, radius: float, least: int, id_col: str = "pid", keys: Sequence[str] = (), axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Density clusters inside each group of ``keys``: id, ``keys``, ``core``, ``cluster``.

    A point with ``least`` points within ``radius``, itself included, is a core point. Core points
    within the radius of each other form a cluster, named by its smallest core id; other points
    join the smallest adjacent cluster, or none.

    Points are dealt to tiles of about equal counts with halos of two radii, in which a tile's core points and those
    near it are told exactly. Clusters are found tile by tile; core points that two tiles know link their clusters there.
    """
    slim = checkpoint(points.select(F.col(id_col).cast("long").alias("__id"), *keys, *axes))
    halo = 2 * radius * (1 + 1e-6)
    tiles = cut_tiles(slim, axes, 2 * radius)
    kinds = [slim.schema[k].dataType.simpleString() for k in keys]

    def cluster(tile: pa.Table) -> pa.Table:
        at, ids, own = coordinates(tile, axes), tile["__id"].to_numpy(), tile["own"].to_numpy()
        group = near.codes(tile, keys)
        core, name, touching, touched = near.density_clusters(at, group, ids, radius, least, np.flatnonzero(own))
        named = np.full(len(at), -1)
        named[core] = name
        many = np.bincount(touching, minlength=len(at)) > 1
        alone = np.flatnonzero(own & ~core & (np.bincount(touching, minlength=len(at)) == 0))
        inside, _, _ = tiles.place(at, halo)
        shared = np.flatnonzero(core & (np.bincount(inside, minlength=len(at)) > 1))
        # own points with their cluster, one row for each cluster they touch, and the core points that other tiles know too
        rows = np.concatenate((np.flatnonzero(own & core), touching, alone, shared))
        clusters = np.concatenate((named[own & core], touched, np.full(len(alone), -1), named[shared]))
        links = np.arange(len(rows)) >= len(rows) - len(shared)
        out = tile.select(["__id", *keys]).take(pa.array(rows))
        out = out.append_column("core", pa.array(core[rows])).append_column("cluster", pa.array(clusters, mask=clusters < 0))
        return out.append_column("many", pa.array(many[rows])).append_column("shared", pa.array(links))

    shape = ", ".join(["__id long", *(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)), "core boolean, cluster long, many boolean, shared boolean"])
    found = checkpoint(dealt(slim, tiles, halo).groupBy("tile").applyInArrow(cluster, shape))
    own = found.where("not shared").select("__id", *keys, "core", "cluster", "many")
    if tiles.count > 1:
        known = found.where("shared").groupBy("__id", *keys).agg(F.collect_set("cluster").alias("names"))
        links = known.where("size(names) > 1").select(*keys, F.explode("names").alias("a"), F.array_min("names").alias("b"))
        whole = joined_names(checkpoint(links.where("a <> b").distinct()), keys)
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("cluster") == F.col("__cluster")]
        whole = whole.withColumnsRenamed({c: f"__{c}" for c in (*keys, "cluster")})
        own = own.join(whole, same, "left").withColumn("cluster", F.coalesce("whole", "cluster")).select("__id", *keys, "core", "cluster", "many")
    several = own.where("many").groupBy("__id", *keys).agg(F.first("core").alias("core"), F.min("cluster").alias("cluster"))
    every = own.where("not many").drop("many").unionByName(several)
    return every.withColumnRenamed("__id", id_col)


def growth_graph(nodes: DataFrame, k: int, longest: float, z_weight: float, id_col: str = "pid") -> DataFrame:
    """Symmetric edges ``a, b, w`` between near nodes, vertical distance counting less."""
    return nearest_k_both_ways(nodes, k, longest, id_col, scale=(1.0, 1.0, z_weight))


#: What a task tells of the nodes it knows: settled ones of its part, and offers to nodes of other parts (``sent``). Of settled
#: nodes, others may send offers to those on the ``border`` alone.
_TOLD = "part long, node long, dist double, label long, sent boolean, border boolean"


def _state(state: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance and label of each of ``ids``, sorted, and which of them are new."""
    dist, label, fresh = np.full(len(ids), np.inf), np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), bool)
    node, far, to, new = (state[c].to_numpy() for c in ("node", "dist", "label", "fresh"))
    at = np.searchsorted(ids, node)
    near.take_better(dist, label, at[~new], far[~new], to[~new])
    fresh[near.take_better(dist, label, at[new], far[new], to[new])] = True
    return dist, label, fresh


def _told(part: np.ndarray, node: np.ndarray, dist: np.ndarray, label: np.ndarray, sent: np.ndarray, border: np.ndarray) -> pa.Table:
    return pa.table({"part": part.astype(np.int64), "node": node, "dist": dist, "label": label, "sent": sent, "border": border})


def _spread_inside(edges: pa.Table, state: pa.Table) -> pa.Table:
    """Shortest paths inside one part, along its edges, from what changed in it."""
    a, b, w, part, to = (edges[c].to_numpy() for c in ("a", "b", "w", "part", "to"))
    ids = np.unique(np.concatenate((a, b, state["node"].to_numpy())))
    order = np.argsort(a, kind="stable")
    a, b, w = np.searchsorted(ids, a[order]), np.searchsorted(ids, b[order]), w[order]
    home = np.full(len(ids), state["part"][0].as_py() if state.num_rows else 0)
    home[b] = to[order]
    outside = np.zeros(len(ids), bool)
    outside[b] = (to != part)[order]
    begin = np.searchsorted(a, np.arange(len(ids) + 1))

    def leaving(front: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = begin[front + 1] - begin[front]
        e = np.arange(n.sum()) + np.repeat(begin[front] - (np.cumsum(n) - n), n)
        yield a[e], b[e], w[e]

    dist, label, fresh = _state(state, ids)
    at = np.flatnonzero(near.spread(dist, label, fresh, outside, float(w.mean()) if len(w) else 0.0, leaving))
    return _told(home[at], ids[at], dist[at], label[at], outside[at], np.ones(len(at), bool))


#: Folders that rows are dealt to at most, and tables of settled nodes that are kept side by side.
_FOLDERS, _TABLES = 4096, 4


def _rounds(rows: DataFrame, first: DataFrame, n_parts: int, spread: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """``node, label, dist`` from offers between parts, round by round, until none is better.

    ``rows`` is what a part's task needs (``part`` and more), ``first`` has ``part, node, label, dist``. Only parts with new offers work: a round
    reads their rows alone, which lie in folders by part, and writes what it changed. What is settled is merged to a row a node
    every few rounds, so that neither tables nor plans pile up. Offers are compared with settled nodes on borders alone.
    """
    spark = rows.sparkSession
    n_folders = max(1, min(_FOLDERS, n_parts // 4))
    folder = F.pmod(F.xxhash64("part"), F.lit(n_folders)).cast("int")
    held, _ = stored(rows.withColumn("folder", folder).repartition("folder"), by="folder")
    inbox, inbox_path = stored(first.select("part", "node", "label", "dist"))
    settled: list[tuple[DataFrame, str]] = []

    def best(tables: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, tables)
        return every.groupBy("part", "node").agg(F.min(F.struct("dist", "label")).alias("own"), F.max("border").alias("border"))

    while not inbox.isEmpty():
        # numbers of parts, far fewer than rows, so that rows of other parts are never shuffled
        active = F.broadcast(inbox.select(F.col("part").alias("at")).distinct())
        folders = [r[0] for r in inbox.select(folder).distinct().collect()]
        state = inbox.withColumn("fresh", F.lit(True))
        if settled:
            before = best([s.join(active, F.col("part") == F.col("at"), "left_semi") for s, _ in settled])
            state = state.unionByName(before.select("part", "node", "own.label", "own.dist", F.lit(False).alias("fresh")))
        working = held.where(F.col("folder").isin(folders)).drop("folder")
        if settled:
            working = working.join(active, F.col("part") == F.col("at"), "left_semi")
        found, found_path = stored(working.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(spread, _TOLD))
        settled.append((found.where("not sent").drop("sent"), found_path))
        offers = found.where("sent").groupBy("part", "node").agg(F.min(F.struct("dist", "label")).alias("offer"))
        known = best([s.where("border") for s, _ in settled]).select("part", "node", "own")
        better = offers.join(known, ["part", "node"], "left").where("own is null or offer < own")
        old = inbox_path
        inbox, inbox_path = stored(better.select("part", "node", "offer.label", "offer.dist"))
        forget(spark, old)
        if len(settled) > _TABLES:
            # one row for each settled node again
            whole, path = stored(best([s for s, _ in settled]).select("part", "node", "own.dist", "own.label", "border"))
            for _, passed in settled:
                forget(spark, passed)
            settled = [(whole, path)]
    if not settled:
        return inbox.select("node", "label", "dist")
    return best([s for s, _ in settled]).select("node", "own.label", "own.dist")


def geodesic_labels(edges: DataFrame, seeds: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Label each node with the seed nearest along edges: ``node, label, dist``; ties by label.

    ``seeds`` has ``node, label``. ``parts`` deals the nodes (``node, part``), best by where they are: paths are
    followed to their ends inside a part in one task, and offers cross to other parts between rounds,
    until none is better. Without ``parts`` nodes are dealt by hash. A node never reached has no row.
    """
    ends = edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("w").cast("double"))
    if parts is None:
        nodes = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).unionByName(seeds.select("node"))
        parts = nodes.distinct().withColumn("part", F.pmod(F.xxhash64("node"), F.lit(64)))
    parts = checkpoint(parts.select(F.col("node").cast("long"), F.col("part").cast("long")))
    of_a, of_b = (parts.select(F.col("node").alias(n), F.col("part").alias(p)) for n, p in (("a", "part"), ("b", "to")))
    placed = ends.join(of_a, "a").join(of_b, "b").select("part", "a", "b", "w", "to")
    first = seeds.groupBy("node").agg(F.min("label").cast("long").alias("label"))
    first = first.join(parts, "node").select("part", F.col("node").cast("long").alias("node"), "label", F.lit(0.0).alias("dist"))
    return _rounds(placed, first, parts.select("part").distinct().count(), _spread_inside)


#: Reaches that a tile sees around itself.
_AROUND = 4


def geodesic_labels_near(points: DataFrame, reach: float, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Label each point with the seed nearest along points that are at most ``reach`` apart on each axis: ``node, label, dist``; ties by label.

    A step is as long as the sum of its parts along the axes. ``points`` has ``node``, ``label``, which is null but for seeds, and ``axes``.
    No table of pairs is made: points are dealt to tiles with a halo, and each tile's task finds its pairs when paths come by. The
    halo is wider than the reach, and paths are followed in it too, so that those which cross a cut again and again take one round;
    the tiles that own its points take what is better there. A point never reached has no row.
    """
    kinds = [F.col("node").cast("long").alias("node"), F.col("label").cast("long").alias("label"), *[F.col(a).cast("double").alias(a) for a in axes]]
    slim = checkpoint(points.select(*kinds))
    halo = _AROUND * reach * (1 + 1e-6)
    tiles = cut_tiles(slim, axes, halo)

    def spread(tile: pa.Table, state: pa.Table) -> pa.Table:
        tile = tile.sort_by("node")
        ids, at, own = tile["node"].to_numpy(), coordinates(tile, axes), tile["own"].to_numpy()
        dist, label, fresh = _state(state, ids)
        cells = near.Cells(at, reach, box=True)
        # ranges of points that paths come by, each found once
        starts, ends = np.zeros((2, len(at), 3 ** (len(axes) - 1)), np.int64)
        found = np.zeros(len(at), bool)

        def leaving(front: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            new = front[~found[front]]
            starts[new], ends[new] = cells.ranges(at[new], np.zeros(len(new), np.int64))
            found[new] = True
            for i, j, _ in cells.inside(at, front, starts[front], ends[front]):
                yield i, j, np.abs(at[i] - at[j]).sum(1)

        changed = np.flatnonzero(near.spread(dist, label, fresh, np.zeros(len(at), bool), reach, leaving))
        _, home, _ = _in_order(tiles.place(at[changed], 0.0))
        inside, _, _ = tiles.place(at[changed], halo)
        border = np.bincount(inside, minlength=len(changed)) > 1
        return _told(home, ids[changed], dist[changed], label[changed], ~own[changed], border)

    placed = dealt(slim.drop("label"), tiles, halo).withColumnRenamed("tile", "part")
    seeds = dealt(slim.where("label is not null"), tiles, halo).groupBy(F.col("tile").alias("part"), "node").agg(F.min("label").alias("label"))
    return _rounds(placed, seeds.withColumn("dist", F.lit(0.0)), tiles.count, spread)


def _in_order(placed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """What ``Tiles.place`` gives, in the order of the points."""
    order = np.argsort(placed[0], kind="stable")
    return tuple(c[order] for c in placed)
