"""The registered queries and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SurveyConfig
from ..functions.geometry import lean_degrees
from ..operators import descriptors, graph, grid, growth, neighbours, raster, species, stand, stems, terrain, trees, validate, views
from ..sources import tables
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CFG = SurveyConfig()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, keep: Sequence[str] = ()) -> DataFrame:
    """Round the double columns; the SQL rounds the same ones."""
    return df.select([F.round(n, digits).alias(n) if t == "double" and n not in keep else F.col(n) for n, t in df.dtypes])


def _r(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names.split())


# Thresholds in the SQL below that are settings of the published method stand as such in config.py. Numbers have
# an exponent, without which DuckDB reads a decimal instead of a double.
C, S = f"WITH c AS {fx.CLOUD_SQL}", f"WITH s AS {fx.STEMS_SQL}"
VOX = "floor((x - x0) / {v}) AS vx, floor((y - y0) / {v}) AS vy, floor((z - z0) / {v}) AS vz"
KEYED = C + ", o AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM c), k AS (SELECT c.*, " + VOX + " FROM c, o)"
CELLS = C + ", o AS (SELECT min(x) AS x0, min(y) AS y0 FROM c), k AS (SELECT c.*, cast(floor((x - x0) / {v}) AS BIGINT) AS ix, cast(floor((y - y0) / {v}) AS BIGINT) AS iy FROM c, o)"


# grid ---------------------------------------------------------------------------------------


@query(f"""{C} SELECT count(*) AS n_points, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max,
 round((max(x) - min(x)) * (max(y) - min(y)) / 1e4, 6) AS area_ha,
 round(count(*) / greatest((max(x) - min(x)) * (max(y) - min(y)), 1), 6) AS points_m2 FROM c""")
def cloud_bounds_summary(spark, sf):
    return rounded(grid.bounds(fx.cloud(spark, sf)), keep=("x_min", "x_max", "y_min", "y_max", "z_min", "z_max"))


@query(KEYED.format(v="0.5e0") + " SELECT cast(vx AS BIGINT) AS vx, cast(vy AS BIGINT) AS vy, cast(vz AS BIGINT) AS vz, count(*) AS n FROM k GROUP BY ALL")
def voxel_counts(spark, sf):
    return grid.voxel_counts(fx.cloud(spark, sf), 0.5)


@query(KEYED.format(v="0.5e0") + " SELECT pid, x, y, z FROM (SELECT *, count(*) OVER (PARTITION BY vx, vy, vz) AS n FROM k) WHERE n >= 4")
def noise_filter(spark, sf):
    return grid.remove_isolated(fx.cloud(spark, sf).select("pid", "x", "y", "z"))


@query(KEYED.format(v="0.15e0") + " SELECT min(pid) AS pid, arg_min(x, pid) AS x, arg_min(y, pid) AS y, arg_min(z, pid) AS z FROM k GROUP BY vx, vy, vz")
def voxel_thin_first(spark, sf):
    return grid.thin(fx.cloud(spark, sf).select("pid", "x", "y", "z"), 0.15)


@query(CELLS.format(v="0.5e0") + " SELECT ix, iy, max(-z) AS v FROM k GROUP BY ALL")
def cell_lowest_surface(spark, sf):
    return grid.cell_surface(fx.cloud(spark, sf).withColumn("z", -F.col("z")), 0.5, "max")


@query(CELLS.format(v="0.25e0") + " SELECT ix, iy, list_sort(list(z))[cast(floor(count(*) / 2) AS BIGINT) + 1] AS v FROM k GROUP BY ALL")
def cell_upper_median(spark, sf):
    return grid.cell_surface(fx.cloud(spark, sf), 0.25, "median")


@query(CELLS.format(v="2e0") + " SELECT x0 + (ix + 0.5e0) * 2 AS x, y0 + (iy + 0.5e0) * 2 AS y, n FROM (SELECT ix, iy, count(*) AS n FROM k GROUP BY ALL ORDER BY n DESC, ix, iy LIMIT 1), o")
def scanner_cell(spark, sf):
    return grid.densest_cell(fx.cloud(spark, sf))


@query(
    CELLS.format(v="1e0")
    + """, m AS (SELECT ix, iy, cast(min(zi) AS DOUBLE) / 1e3 AS v FROM k GROUP BY ALL),
 e AS (SELECT min(ix) AS ox, max(ix) AS nx, min(iy) AS oy, max(iy) AS ny FROM m),
 f AS (SELECT pid, z, greatest(ox, least(nx, (x - x0) / 1e0)) AS fx, greatest(oy, least(ny, (y - y0) / 1e0)) AS fy, nx, ny FROM k, e, o),
 b AS (SELECT *, cast(least(floor(fx), nx - 1) AS BIGINT) AS cx0, cast(least(floor(fy), ny - 1) AS BIGINT) AS cy0 FROM f),
 w AS (SELECT pid, z, dx, dy, cx0 + dx AS ix, cy0 + dy AS iy, (CASE dx WHEN 1 THEN fx - cx0 ELSE 1 - (fx - cx0) END) * (CASE dy WHEN 1 THEN fy - cy0 ELSE 1 - (fy - cy0) END) AS w
       FROM b, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dx, dy)),
 j AS (SELECT pid, z, CASE WHEN w = 0 THEN 0 ELSE w * v END AS p FROM w LEFT JOIN m USING (ix, iy))
 SELECT pid, CASE WHEN count(p) = 4 THEN cast(round((z - sum(p)) * 1e9) AS BIGINT) / 1e9 END AS h FROM j GROUP BY pid, z"""
)
def raster_bilinear_height(spark, sf):
    """Millimetres times thousandths of a cell are whole billionths of a metre, in which both engines agree."""
    points = fx.cloud(spark, sf).select("pid", "x", "y", "z")
    cells = grid.cell_surface(points, 1.0, "min").withColumnRenamed("v", "low")
    origin = points.agg(F.min("x").alias("gx"), F.min("y").alias("gy"))
    on = grid.bilinear(points.join(F.broadcast(origin)), cells, 1.0, ["low"], F.col("gx"), F.col("gy"))
    return on.select("pid", (F.round((F.col("z") - F.col("low")) * 1e9).cast("long") / F.lit(1e9)).alias("h"))


@query(
    CELLS.format(v="1e0")
    + """, m AS (SELECT DISTINCT ix, iy FROM k),
 a AS (SELECT g.ix, g.iy, (m.ix IS NOT NULL)::INT AS seen FROM (SELECT unnest(range(0, (SELECT max(ix) + 1 FROM m))) AS ix) AS gx, (SELECT unnest(range(0, (SELECT max(iy) + 1 FROM m))) AS iy) AS gy,
       LATERAL (SELECT gx.ix, gy.iy) AS g LEFT JOIN m ON m.ix = g.ix AND m.iy = g.iy),
 p AS (SELECT ix, iy, sum(seen) OVER (PARTITION BY iy ORDER BY ix RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM a)
 SELECT ix, iy, round(sum(s) OVER (PARTITION BY ix ORDER BY iy RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 25e0, 6) AS mean FROM p"""
)
def raster_valid_density(spark, sf):
    cells = grid.with_cells(fx.cloud(spark, sf), 1.0).select("ix", "iy").distinct()
    size = cells.agg(F.max("ix").alias("nx"), F.max("iy").alias("ny"))
    every = size.select(F.explode(F.sequence(F.lit(0).cast("long"), "nx")).alias("ix"), "ny").select("ix", F.explode(F.sequence(F.lit(0).cast("long"), "ny")).alias("iy"))
    seen = every.join(cells.withColumn("s", F.lit(1)), ["ix", "iy"], "left").withColumn("seen", F.coalesce("s", F.lit(0)))
    return rounded(grid.moving_mean(seen, "seen", 5))


@query(
    CELLS.format(v="1e0")
    + """, m AS (SELECT ix, iy, max(z) AS v FROM k GROUP BY ALL),
 n AS (SELECT a.ix, a.iy, any_value(a.v) AS v, median(b.v) AS mid FROM m a JOIN m b ON b.ix BETWEEN a.ix - 1 AND a.ix + 1 AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 GROUP BY a.ix, a.iy)
 SELECT ix, iy, v FROM n WHERE v <= mid + 1"""
)
def raster_despike_once(spark, sf):
    """One pass of spike removal on a relational neighbourhood of 3 x 3 known cells."""
    cells = grid.cell_surface(fx.cloud(spark, sf), 1.0, "max")
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = cells.withColumn("d", F.explode(shifts)).select(
        (F.col("ix") + F.col("d.a")).alias("ix"), (F.col("iy") + F.col("d.b")).alias("iy"), "v"
    )
    mid = spread.groupBy("ix", "iy").agg(F.median("v").alias("mid"))
    return cells.join(mid, ["ix", "iy"]).where("v <= mid + 1").select("ix", "iy", "v")


@query(
    CELLS.format(v="1e0")
    + """, m AS (SELECT DISTINCT ix, iy, ix * 1000000 + iy AS n FROM k WHERE role = 'crown'),
 e AS (SELECT a.n AS a, b.n AS b FROM m a JOIN m b ON a.ix = b.ix AND abs(a.iy - b.iy) = 1 UNION ALL SELECT a.n, b.n FROM m a JOIN m b ON a.iy = b.iy AND abs(a.ix - b.ix) = 1),
 reach AS (WITH RECURSIVE r(a, root) USING KEY (a) AS (SELECT n, n FROM m UNION
   (SELECT e.b, min(r.root) FROM r JOIN e ON r.a = e.a JOIN recurring.r AS old ON old.a = e.b GROUP BY e.b HAVING min(r.root) < min(old.root))) SELECT * FROM r),
 parts AS (SELECT root, count(*) AS n FROM reach GROUP BY root)
 SELECT ix, iy, root AS part, (root = (SELECT arg_max(root, (n, -root)) FROM parts)) AS largest FROM reach JOIN m ON m.n = reach.a"""
)
def raster_components(spark, sf):
    """Parts of the cells that crowns cover, and the largest of them."""
    points = fx.cloud(spark, sf)
    cells = graph.checkpoint(grid.with_cells(points, 1.0).where("role = 'crown'").select("ix", "iy").distinct())
    parts = graph.checkpoint(terrain.cell_parts(cells))
    largest = terrain.largest_part(parts).withColumn("largest", F.lit(True))
    named = parts.join(largest, ["ix", "iy"], "left").withColumn("largest", F.coalesce("largest", F.lit(False)))
    return named.withColumn("part", F.floor(F.col("part") / (1 << 31)) * 1000000 + F.pmod("part", F.lit(1 << 31)))


LAYERS = C + """, l AS (SELECT c.*, cast(i AS INT) AS layer FROM c, range(0, 10) AS t(i) WHERE role = 'stem' AND h >= 0.6e0 + i * 0.2e0 AND h < 0.6e0 + i * 0.2e0 + 0.2e0)"""


@query(LAYERS + " SELECT pid, layer FROM (SELECT pid, layer, count(*) OVER (PARTITION BY layer) AS n FROM l) WHERE n >= 12")
def layer_explode(spark, sf):
    rows = grid.layers(fx.cloud(spark, sf).where("role = 'stem'"), 0.6, 2.6, 0.2, 0.2).select("pid", "layer")
    full = rows.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")
    return rows.join(full, "layer", "left_semi").select("pid", "layer")


@query(f"{C} SELECT least(199, cast(floor(h / (10e0 / 200)) AS BIGINT)) AS bin, count(*) AS n FROM c WHERE h BETWEEN 0 AND 10 GROUP BY ALL")
def layer_histogram_h(spark, sf):
    return grid.histogram(fx.cloud(spark, sf), "h", 0.0, 10.0, 200)


# circles and stems ----------------------------------------------------------------------------

KASA = """, o AS (SELECT {k}, avg(x) AS mx, avg(y) AS my FROM {t} GROUP BY {k}),
 q AS (SELECT {k}, mx, my, x - mx AS u, y - my AS v FROM {t} JOIN o USING ({k})),
 z AS (SELECT {k}, mx, my, count(*) AS n, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * (u * u + v * v)) AS uq, sum(v * (u * u + v * v)) AS vq, sum(u * u + v * v) AS q FROM q GROUP BY {k}, mx, my),
 ab AS (SELECT *, (uq * vv - vq * uv) / 2 / nullif(uu * vv - uv * uv, 0) AS a, (vq * uu - uq * uv) / 2 / nullif(uu * vv - uv * uv, 0) AS b FROM z),
 circle AS (SELECT {k}, mx + a AS cx, my + b AS cy, sqrt(a * a + b * b + q / n) AS r, n FROM ab)"""
CIRCLES = LAYERS + ", f AS (SELECT * FROM l QUALIFY count(*) OVER (PARTITION BY tree_id, layer) >= 4)" + KASA.format(k="tree_id, layer", t="f") + (
    ", g AS (SELECT tree_id * 100 + layer AS circle_id, cast(layer AS INT) AS layer, cx, cy, r, n FROM circle WHERE r BETWEEN 0.02e0 AND 0.75e0)"
)


def _circles(spark, sf) -> DataFrame:
    """Algebraic circles per known tree and layer, in the shape of fitted ones."""
    rows = grid.layers(fx.cloud(spark, sf).where("role = 'stem'"), 0.6, 2.6, 0.2, 0.2).select("pid", "tree_id", "layer", "x", "y")
    full = rows.groupBy("tree_id", "layer").agg(F.count(F.lit(1)).alias("m")).where("m >= 4")
    found = stems.algebraic_circles(rows.join(full, ["tree_id", "layer"], "left_semi"), ["tree_id", "layer"]).where("r between 0.02 and 0.75")
    return found.select((F.col("tree_id") * 100 + F.col("layer")).alias("circle_id"), "layer", "cx", "cy", "r", "n")


@query(CIRCLES + f" SELECT circle_id, layer, {_r('cx cy r')}, n FROM g")
def kasa_circle_per_tree_layer(spark, sf):
    return rounded(_circles(spark, sf))


@query(f"""{C} SELECT tree_id, round(count(DISTINCT cast(floor((atan2(yi - cast(floor(tree_id / 1e1) AS BIGINT) * 4000 + 0.1e0, xi - (tree_id % 10) * 4000 + 0.3e0) + pi()) / (2 * pi()) * 36) AS BIGINT) % 36) / 36e0, 6) AS arc
 FROM c WHERE role = 'stem' GROUP BY tree_id""")
def arc_coverage(spark, sf):
    """Directions in millimetres from an off-centre origin, away from the edges of bins."""
    points = fx.cloud(spark, sf).where("role = 'stem'")
    dx, dy = F.col("xi") - F.expr("(tree_id % 10) * 4000") + 0.3, F.col("yi") - F.expr("cast(floor(tree_id / 1e1) as bigint) * 4000") + 0.1
    return rounded(stems.arc_coverage(points, ["tree_id"], dx, dy))


LINKS = """, links AS (SELECT a.circle_id AS a, b.circle_id AS b FROM g a JOIN g b ON b.layer = a.layer + 1
 AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= (0.12e0 + 0.35e0 * a.r) * (0.12e0 + 0.35e0 * a.r) AND a.r / b.r BETWEEN 1 / 1.8e0 AND 1.8e0)"""
STACKS = LINKS + """, pairs2 AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 stacks AS (WITH RECURSIVE r(a, b) AS (SELECT circle_id, circle_id FROM g UNION SELECT r.a, pairs2.b FROM r JOIN pairs2 ON r.b = pairs2.a) SELECT a AS node, min(b) AS root FROM r GROUP BY a)"""
RMSE = ", gr AS (SELECT *, round(abs(r - 0.04e0), 6) AS rmse, cast(n AS DOUBLE) AS arc, 0.6e0 + layer * 0.2e0 + 0.1e0 AS h FROM g)"
CHAIN = STACKS + RMSE + """, chain AS (SELECT root AS stack, layer, circle_id, cx, cy, r, rmse, arc, h FROM gr JOIN stacks ON node = circle_id
 QUALIFY row_number() OVER (PARTITION BY root, layer ORDER BY rmse, circle_id) = 1)"""
INTERP = """, seg AS (SELECT *, lead(h) OVER w AS h2, {leads}, row_number() OVER w = 1 AS first FROM chain WINDOW w AS (PARTITION BY stack ORDER BY h)),
 here AS (SELECT *, CASE WHEN h >= 1.3e0 OR h2 IS NULL THEN 0 ELSE (1.3e0 - h) / (h2 - h) END AS s FROM seg WHERE (first AND h >= 1.3e0) OR (h <= 1.3e0 AND coalesce(h2, 1e9) > 1.3e0)),
 i AS (SELECT stack, {values} FROM here)""".format(
    leads=", ".join(f"lead({c}) OVER w AS {c}2" for c in ("r", "cx", "cy")), values=", ".join(f"{c} + s * coalesce({c}2 - {c}, 0) AS {c}" for c in ("r", "cx", "cy"))
)


@query(CIRCLES + LINKS + " SELECT a, b FROM links")
def circle_layer_links(spark, sf):
    return stems.link_circles(_circles(spark, sf), CFG)


def _stacks(spark, sf) -> tuple[DataFrame, DataFrame]:
    circles = graph.checkpoint(_circles(spark, sf))
    return circles, graph.components(circles.select(F.col("circle_id").alias("node")), stems.link_circles(circles, CFG))


@query(CIRCLES + STACKS + " SELECT node, root FROM stacks")
def stack_components(spark, sf):
    return _stacks(spark, sf)[1]


def _chain(spark, sf) -> DataFrame:
    circles, stacks = _stacks(spark, sf)
    ready = circles.withColumns(
        {"rmse": F.round(F.abs(F.col("r") - 0.04), 6), "arc": F.col("n").cast("double"), "h": 0.6 + F.col("layer") * F.lit(0.2) + 0.1}
    )
    return graph.checkpoint(stems.chains(ready.drop("n"), stacks))


@query(CIRCLES + CHAIN + " SELECT stack, layer, circle_id, rmse, count(*) OVER (PARTITION BY stack) AS n_layers FROM chain")
def best_circle_per_layer(spark, sf):
    chain = _chain(spark, sf)
    n = chain.groupBy("stack").agg(F.count_distinct("layer").alias("n_layers"))
    return chain.join(n, "stack").select("stack", "layer", "circle_id", "rmse", "n_layers")


@query(CIRCLES + CHAIN + INTERP + f" SELECT stack, {_r('r cx cy')} FROM i")
def chain_interpolate_130(spark, sf):
    return rounded(stems.interpolate_along(_chain(spark, sf), "stack", 1.3, ["r", "cx", "cy"]))


@query(
    CIRCLES
    + CHAIN
    + INTERP
    + """, st AS (SELECT stack, count(*) AS n, covar_pop(cx, cx) + covar_pop(cy, cy) AS side, covar_pop(h, h) AS up FROM chain GROUP BY stack)
 SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n < 4 THEN 'short' WHEN up < side THEN 'tilted' WHEN 2 * r NOT BETWEEN 0.04e0 AND 1.5e0 THEN 'size' ELSE 'ok' END AS reason FROM st JOIN i USING (stack)) GROUP BY reason"""
)
def stack_acceptance_reasons(spark, sf):
    return stems.stack_table(_chain(spark, sf), CFG).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


#: Stacks of two to eight circles on straight axes that lean by up to 1.2 m a metre, with radii up to 0.9 m.
STRAIGHT = S + """, l AS (SELECT tree_id AS stack, cast(i AS INT) AS layer, 0.7e0 + i * 0.2e0 AS h, x, y, (tree_id % 5) * 0.3e0 AS lean,
 0.005e0 + (tree_id % 11) * 0.09e0 AS r FROM s, range(0, 9) AS t(i) WHERE i < 2 + tree_id % 7)"""


@query(
    STRAIGHT
    + """ SELECT stack, cast(count(*) AS INT) AS n_layers, round(1 / sqrt(1 + any_value(lean) * any_value(lean)), 6) AS axis_z,
 CASE WHEN count(*) < 4 THEN 'short' WHEN 1 / sqrt(1 + any_value(lean) * any_value(lean)) < 0.8e0 THEN 'tilted'
      WHEN 2 * any_value(r) NOT BETWEEN 0.04e0 AND 1.5e0 THEN 'size' ELSE 'ok' END AS reason FROM l GROUP BY stack"""
)
def stack_rejections(spark, sf):
    """Each reason for which a stack isn't a stem; the axis of circles in line is known."""
    rows = fx.stems(spark, sf).selectExpr("tree_id as stack", "explode(sequence(0, cast(1 + tree_id % 7 as int))) as layer", "x", "y", "(tree_id % 5) * 0.3e0 as lean", "0.005e0 + (tree_id % 11) * 0.09e0 as r")
    chain = rows.selectExpr("stack", "layer", "0.7e0 + layer * 0.2e0 as h", "x + lean * (0.7e0 + layer * 0.2e0) as cx", "y as cy", "r", "0.01e0 as rmse", "1e0 as arc")
    return rounded(stems.stack_table(chain, CFG).select("stack", "n_layers", "axis_z", "reason"))


NEAR = S + ", p AS (SELECT tree_id, x + (tree_id % 3) * 1.3e0 AS x, y + (tree_id % 2) * 1.7e0 AS y, n_layers FROM s), pairs AS (SELECT a.tree_id AS a, b.tree_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM p a JOIN p b ON a.tree_id < b.tree_id)"


def _moved_stems(spark, sf) -> DataFrame:
    return fx.stems(spark, sf).selectExpr("tree_id", "x + (tree_id % 3) * 1.3e0 as x", "y + (tree_id % 2) * 1.7e0 as y", "n_layers")


@query(NEAR + " SELECT a, b, round(dist, 6) AS dist FROM pairs WHERE dist <= 3.2")
def seed_pairs_close(spark, sf):
    return rounded(neighbours.close_pairs(_moved_stems(spark, sf), 3.2, "tree_id"))


@query(
    NEAR
    + """, e AS (SELECT a, b FROM pairs WHERE dist <= 2.8 UNION SELECT b, a FROM pairs WHERE dist <= 2.8),
 g AS (WITH RECURSIVE r(a, b) AS (SELECT tree_id, tree_id FROM p UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS tree_id, min(b) AS root FROM r GROUP BY a)
 SELECT tree_id, n_layers, first_value(tree_id) OVER (PARTITION BY root ORDER BY n_layers DESC, tree_id) AS merged_into FROM g JOIN p USING (tree_id)"""
)
def seed_merge(spark, sf):
    return stems.merge_close(_moved_stems(spark, sf), 2.8, "tree_id").select("tree_id", "n_layers", "merged_into")


# neighbours and graphs --------------------------------------------------------------------------

PLANTS = C + ", p AS (SELECT pid, tree_id, x, y, z, h, cast(floor(hi / 1000) AS INT) AS band FROM c WHERE role <> 'ground')"
#: Pairs of rows within a distance, by way of cells of that size, so that the SQL reads the whole cloud too.
PAIRS = """, d3 AS (SELECT dx, dy, dz FROM (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy), (VALUES (-1), (0), (1)) AS c(dz)),
 {name}_l AS (SELECT {left_columns}, x, y, z, floor(x / {r}) + dx AS bx, floor(y / {r}) + dy AS b_y, floor(z / {r}) + dz AS bz FROM {left}, d3),
 {name}_r AS (SELECT {right_columns}, x, y, z, floor(x / {r}) AS bx, floor(y / {r}) AS b_y, floor(z / {r}) AS bz FROM {right}),
 {name} AS (SELECT * FROM (SELECT {out}, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist
   FROM {name}_l AS a JOIN {name}_r AS b ON a.bx = b.bx AND a.b_y = b.b_y AND a.bz = b.bz) WHERE dist <= {r})"""


def _vegetation(spark, sf) -> DataFrame:
    return fx.cloud(spark, sf).where("role <> 'ground'").select("pid", "tree_id", "x", "y", "z", "h", F.floor(F.col("hi") / 1000).cast("int").alias("band"))


@query(
    PLANTS
    + """, d2 AS (SELECT dx, dy FROM (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy)),
 l AS (SELECT band, pid, x, y, floor(x / 0.02e0) + dx AS bx, floor(y / 0.02e0) + dy AS b_y FROM p, d2),
 r AS (SELECT band, pid, x, y, floor(x / 0.02e0) AS bx, floor(y / 0.02e0) AS b_y FROM p),
 near AS (SELECT a.band, a.pid AS a, b.pid AS b FROM l AS a JOIN r AS b ON a.band = b.band AND a.bx = b.bx AND a.b_y = b.b_y WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02e0),
 core AS (SELECT band, a FROM near GROUP BY ALL HAVING count(*) >= 12),
 e AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
 g AS (WITH RECURSIVE q(a, root) USING KEY (a) AS (SELECT a, a FROM core UNION
   (SELECT e.b, min(q.root) FROM q JOIN e ON q.a = e.a JOIN recurring.q AS old ON old.a = e.b GROUP BY e.b HAVING min(q.root) < min(old.root))) SELECT * FROM q)
 SELECT p.pid, p.band, (min(own.root) IS NOT NULL) AS core, coalesce(min(own.root), min(g.root)) AS cluster
 FROM p LEFT JOIN near ON near.a = p.pid LEFT JOIN g ON g.a = near.b LEFT JOIN g AS own ON own.a = p.pid GROUP BY p.pid, p.band"""
)
def dbscan_layer(spark, sf):
    return graph.density_clusters(_vegetation(spark, sf), 0.02, 12, keys=["band"])


KNN = PLANTS + PAIRS.format(name="near", left="p", right="p", left_columns="pid", right_columns="pid", out="a.pid AS src, b.pid AS dst", r="0.4e0") + """,
 knn AS (SELECT * FROM near WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 10)"""


@query(KNN + " SELECT src, dst, round(dist, 6) AS dist FROM knn")
def knn_edges(spark, sf):
    return rounded(neighbours.nearest_k(_vegetation(spark, sf), 10, 0.4, "pid"))


EDGES = KNN + """, d AS (SELECT src AS a, dst AS b, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + ((p.z - q.z) * 0.35e0) * ((p.z - q.z) * 0.35e0)) AS w
 FROM knn JOIN p ON p.pid = src JOIN p AS q ON q.pid = dst), e AS (SELECT a, b, max(w) AS w FROM (SELECT a, b, w FROM d UNION ALL SELECT b, a, w FROM d) GROUP BY ALL)"""


@query(EDGES + " SELECT a, b, round(w, 6) AS w FROM e")
def weighted_symmetric_edges(spark, sf):
    return rounded(graph.growth_graph(_vegetation(spark, sf), 10, 0.4, 0.35))


SEEDS = PLANTS + """, v AS (SELECT *, floor(x / 0.15e0) AS vx, floor(y / 0.15e0) AS vy, floor(z / 0.15e0) AS vz FROM p),
 nodes AS (SELECT min(pid) AS nid, arg_min(x, pid) AS x, arg_min(y, pid) AS y, arg_min(z, pid) AS z FROM v GROUP BY vx, vy, vz),
 sp AS (SELECT pid, tree_id, x, y, z FROM p WHERE h < 1.4e0)""" + PAIRS.format(
    name="near", left="sp", right="nodes", left_columns="pid, tree_id", right_columns="nid", out="pid, tree_id, nid", r="0.26e0"
) + """, one AS (SELECT tree_id, nid FROM near QUALIFY row_number() OVER (PARTITION BY pid ORDER BY dist, nid) = 1)"""


def _nodes(points: DataFrame) -> DataFrame:
    keyed = points.withColumns({f"v{a}": F.floor(F.col(a) / 0.15) for a in "xyz"})
    return keyed.groupBy("vx", "vy", "vz").agg(F.min_by(F.struct("pid", "x", "y", "z"), "pid").alias("p")).select("p.*")


@query(SEEDS + " SELECT nid AS node, min(tree_id) AS label FROM one GROUP BY nid")
def seed_nodes(spark, sf):
    points = _vegetation(spark, sf)
    return growth.seed_nodes(_nodes(points), points.where("h < 1.4").select("pid", "x", "y", "z", "tree_id"), 0.26)


@query(
    PLANTS
    + ", lab AS (SELECT pid AS nid, tree_id, x, y, z FROM p WHERE h BETWEEN 1e0 AND 1.2e0)"
    + PAIRS.format(name="near", left="p", right="lab", left_columns="pid", right_columns="nid, tree_id", out="pid, nid, tree_id", r="0.45e0")
    + """, one AS (SELECT pid, nid, tree_id FROM near QUALIFY row_number() OVER (PARTITION BY pid ORDER BY dist, nid) = 1)
 SELECT p.pid, one.nid, one.tree_id FROM p LEFT JOIN one USING (pid)"""
)
def label_backprojection(spark, sf):
    """Labels of a slice of each stem, carried to all plants within reach."""
    points = _vegetation(spark, sf).select("pid", "x", "y", "z", "h", "tree_id")
    labelled = points.where("h between 1 and 1.2").withColumnRenamed("pid", "nid").drop("h")
    return neighbours.nearest_one(points.drop("tree_id", "h"), labelled, 0.45, "pid", "nid", carry=["tree_id"]).select("pid", "nid", "tree_id")


@query(
    C
    + """, p AS (SELECT pid, tree_id, xi, yi, hi FROM c WHERE role <> 'ground'),
 d3 AS (SELECT dx, dy, dz FROM (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy), (VALUES (-1), (0), (1)) AS c(dz)),
 l AS (SELECT p.*, floor(xi / 6e1) + dx AS bx, floor(yi / 6e1) + dy AS b_y, floor(hi / 6e1) + dz AS bz FROM p, d3),
 r AS (SELECT p.*, floor(xi / 6e1) AS bx, floor(yi / 6e1) AS b_y, floor(hi / 6e1) AS bz FROM p),
 e AS (SELECT a.pid AS a, b.pid AS b, abs(a.xi - b.xi) + abs(a.yi - b.yi) + abs(a.hi - b.hi) AS w FROM l AS a JOIN r AS b ON a.bx = b.bx AND a.b_y = b.b_y AND a.bz = b.bz
       WHERE a.pid <> b.pid AND abs(a.xi - b.xi) <= 60 AND abs(a.yi - b.yi) <= 60 AND abs(a.hi - b.hi) <= 60),
 seeds AS (SELECT pid AS node, tree_id AS label FROM p WHERE hi < 800),
 reach AS (WITH RECURSIVE q(node, label, dist) USING KEY (node, label) AS (SELECT node, label, 0::BIGINT FROM seeds
   UNION (SELECT e.b, q.label, min(q.dist + e.w)::BIGINT FROM q JOIN e ON q.node = e.a LEFT JOIN recurring.q AS old ON old.node = e.b AND old.label = q.label
          GROUP BY e.b, q.label HAVING min(q.dist + e.w) < coalesce(min(old.dist), 9e15))) SELECT * FROM q)
 SELECT node, arg_min(label, (dist, label)) AS label, min(dist) / 1e0 AS dist FROM reach GROUP BY node"""
)
def geodesic_labels(spark, sf):
    """Whole millimetres along axes, so that both engines add the same distances."""
    p = fx.cloud(spark, sf).where("role <> 'ground'")
    nodes = p.selectExpr("pid as node", "case when hi < 800 then tree_id end as label", "cast(xi as double) x", "cast(yi as double) y", "cast(hi as double) z")
    return graph.geodesic_labels_near(nodes, 60.0).select("node", "label", "dist")


# trees --------------------------------------------------------------------------------------------


@query(f"""{C} SELECT tree_id, count(*) AS n_points, CASE WHEN count(*) >= 20 THEN round(quantile_cont(h, 0.995e0), 6) END AS height_m,
 CASE WHEN count(*) >= 20 THEN max(h) END AS height_max_m FROM c WHERE role <> 'ground' GROUP BY tree_id""")
def tree_height_percentile(spark, sf):
    return rounded(trees.heights(fx.cloud(spark, sf).where("role <> 'ground'")), keep=("height_max_m",))


@query(
    KEYED.format(v="0.5e0")
    + """, f AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY vx, vy, vz) >= 4)
 SELECT tree_id, count(*) AS n_points, CASE WHEN count(*) >= 20 THEN round(quantile_cont(h, 0.995e0), 6) END AS height_m, CASE WHEN count(*) >= 20 THEN max(h) END AS height_max_m FROM f GROUP BY tree_id"""
)
def filtered_tree_heights(spark, sf):
    """The flagship: after isolated returns are dropped, how many points and what height has each tree?"""
    kept = grid.remove_isolated(fx.cloud(spark, sf).select("pid", "tree_id", "x", "y", "z", "h"))
    return rounded(trees.heights(kept), keep=("height_max_m",))


@query(f"{C} SELECT tree_id, role, count(*) AS n FROM c GROUP BY ALL")
def tree_counts_by_label(spark, sf):
    return fx.cloud(spark, sf).groupBy("tree_id", "role").agg(F.count(F.lit(1)).alias("n"))


def _axes(spark, sf) -> DataFrame:
    """Trees with a fixed axis, three in five by four in five upward."""
    return fx.stems(spark, sf).selectExpr("tree_id", "x as mid_x", "y as mid_y", "2e0 as mid_z", "0.6e0 as axis_x", "0e0 as axis_y", "0.8e0 as axis_z", "dbh_cm / 1e2 as stack_diameter")


@query(
    C
    + f""", s AS {fx.STEMS_SQL}, n AS (SELECT c.pid, c.tree_id, pos, c.x - s.x AS dx, c.y - s.y AS dy, c.z - 2e0 AS dz, greatest(0.25e0, 2.5e0 * dbh_cm / 1e2) AS lim
 FROM c JOIN s USING (tree_id), (VALUES (0, 1.3e0), (1, 1.5e0), (2, 1e0), (3, 1.7e0)) AS hs(pos, hz) WHERE c.role = 'stem' AND abs(c.h - hz) <= 0.06e0 + 1e-9),
 uv AS (SELECT pid, tree_id, pos, -dy AS u, 0.8e0 * dx - 0.6e0 * dz AS v, lim FROM n)
 SELECT pid, tree_id, pos, round(u, 6) AS u, round(v, 6) AS v FROM uv WHERE sqrt(u * u + v * v) < lim * 8"""
)
def slice_plane_projection(spark, sf):
    rows = trees.slice_plane(fx.cloud(spark, sf).where("role = 'stem'").select("pid", "tree_id", "x", "y", "z", "h"), _axes(spark, sf), (1.3, 1.5, 1.0, 1.7), 0.12 + 2e-9)
    near = F.hypot("u", "v") < 8 * F.greatest(F.lit(0.25), 2.5 * F.col("stack_diameter"))
    return rounded(rows.where(near).select("pid", "tree_id", "pos", "u", "v"))


CROWN = C + f""", s AS {fx.STEMS_SQL}, q AS (SELECT c.*, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS rad, greatest(0.75e0, 4 * dbh_cm / 100) AS out FROM c JOIN s USING (tree_id) WHERE role <> 'ground'),
 b AS (SELECT tree_id, floor((h - 1) / 0.5e0) AS part, count(*) AS n, quantile_cont(rad, 0.9e0) AS p90, any_value(out) AS out FROM q WHERE h >= 1 GROUP BY ALL),
 base AS (SELECT tree_id, 1 + 0.5e0 * min(part) AS crown_base_m FROM b JOIN (SELECT tree_id, max(h) AS top FROM q GROUP BY ALL) USING (tree_id) WHERE n >= 20 AND p90 > out AND 1 + 0.5e0 * part < top GROUP BY tree_id),
 w AS (SELECT tree_id, CASE WHEN count(*) >= 30 THEN 2 * quantile_cont(rad, 0.95e0) END AS crown_diameter_m FROM q LEFT JOIN base USING (tree_id) WHERE base.crown_base_m IS NULL OR h >= base.crown_base_m GROUP BY tree_id)"""


@query(CROWN + f" SELECT s.tree_id, base.crown_base_m, round(w.crown_diameter_m, 6) AS crown_diameter_m FROM s LEFT JOIN base USING (tree_id) LEFT JOIN w USING (tree_id)")
def crown_base_diameter(spark, sf):
    points = fx.cloud(spark, sf).where("role <> 'ground'")
    at = fx.stems(spark, sf).selectExpr("tree_id", "x as sx", "y as sy", "dbh_cm")
    based = at.join(trees.crown_base(points, at), "tree_id")
    return rounded(based.join(trees.crown_width(points, based), "tree_id").select("tree_id", "crown_base_m", "crown_diameter_m"))


@query(
    C
    + """, p AS (SELECT DISTINCT tree_id, xi, yi FROM c WHERE role = 'crown' AND tree_id IN (SELECT tree_id FROM c WHERE role = 'crown' GROUP BY tree_id HAVING count(*) >= 30)),
 e AS (SELECT a.tree_id, a.xi AS ax, a.yi AS ay, b.xi AS bx, b.yi AS b_y FROM p a JOIN p b ON a.tree_id = b.tree_id AND (a.xi, a.yi) <> (b.xi, b.yi)
   WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.tree_id = a.tree_id AND ((b.xi - a.xi) * (c.yi - a.yi) - (b.yi - a.yi) * (c.xi - a.xi) < 0
     OR ((b.xi - a.xi) * (c.yi - a.yi) = (b.yi - a.yi) * (c.xi - a.xi) AND ((c.xi - a.xi) * (c.xi - b.xi) + (c.yi - a.yi) * (c.yi - b.yi) > 0)))))
 SELECT tree_id, cast(sum(ax * b_y - bx * ay) AS BIGINT) / 2e6 AS crown_area_m2 FROM e GROUP BY tree_id"""
)
def crown_hull_area(spark, sf):
    points = fx.cloud(spark, sf).where("role = 'crown'")
    base = fx.stems(spark, sf).selectExpr("tree_id", "cast(null as double) as crown_base_m")
    # twice the area is whole square millimetres
    area = F.round(F.col("crown_area_m2") * 2e6).cast("long") / F.lit(2e6)
    return trees.crown_hulls(points, base).where("crown_area_m2 is not null").select("tree_id", area.alias("crown_area_m2"))


@query()
def crown_hull_volume(spark, sf):
    points = fx.cloud(spark, sf).where("role = 'crown'")
    base = fx.stems(spark, sf).selectExpr("tree_id", "cast(null as double) as crown_base_m")
    return trees.crown_hulls(points, base)


QUALITY = """CASE WHEN dbh_source = 'axis_fit' AND height_m >= 2 AND dbh_arc >= 0.6e0 AND dbh_rmse_cm <= 2 AND n_stem_layers >= 6 AND dbh_vs_stack BETWEEN 1 / 1.6e0 AND 1.6e0 THEN 'good'
 WHEN dbh_source = 'axis_fit' AND height_m >= 2 AND dbh_arc >= 0.35e0 AND dbh_rmse_cm <= 3 AND dbh_vs_stack BETWEEN 1 / 2.2e0 AND 2.2e0 THEN 'fair' ELSE 'poor' END"""
FULL = S + f""", t AS (SELECT *, {QUALITY} AS quality, pi() * (dbh_cm / 200) * (dbh_cm / 200) AS basal_area_m2, height_m / (dbh_cm / 100) AS h_d_ratio,
 sqrt((x - 10) * (x - 10) + (y - 10) * (y - 10)) AS dist_from_scan_centre_m FROM s)"""


def _measured(spark, sf) -> DataFrame:
    full = trees.derived_columns(fx.stems(spark, sf)).withColumn("quality", trees.quality())
    return full.withColumn("dist_from_scan_centre_m", F.hypot(F.col("x") - 10.0, F.col("y") - 10.0))


@query(FULL + " SELECT tree_id, quality FROM t")
def quality_flags(spark, sf):
    return _measured(spark, sf).select("tree_id", "quality")


@query(FULL + f" SELECT tree_id, {_r('basal_area_m2 h_d_ratio dist_from_scan_centre_m')}, round(degrees(acos(least(1, abs(0.8e0)))), 6) AS stem_lean_deg FROM t")
def derived_tree_columns(spark, sf):
    lean = lean_degrees(F.lit(0.8)).alias("stem_lean_deg")
    return rounded(_measured(spark, sf).select("tree_id", "basal_area_m2", "h_d_ratio", "dist_from_scan_centre_m", lean))


@query()
def ransac_dbh(spark, sf):
    points = fx.cloud(spark, sf).where("role = 'stem'").select("tree_id", "pid", "x", "y", "z", "h")
    seeds = fx.stems(spark, sf).selectExpr(
        "tree_id", "dbh_cm / 1e2 as stack_diameter", "0.01e0 as stack_rmse", "1e0 as stack_arc", "0e0 as axis_x", "0e0 as axis_y", "1e0 as axis_z", "x as mid_x", "y as mid_y", "1.3e0 as mid_z"
    )
    return trees.breast_height_diameters(points, seeds, CFG)


# descriptors ---------------------------------------------------------------------------------------

REL = C + f""", s AS {fx.STEMS_SQL}, q AS (SELECT c.*, greatest(0, least(1, h / height_m)) AS rel, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS rad, crown_base_m
 FROM c JOIN s USING (tree_id) WHERE role <> 'ground' AND height_m > 0), p AS (SELECT *, cast(least(9, floor(rel * 10)) AS INT) AS bin FROM q)"""


def _relative(spark, sf) -> DataFrame:
    points = fx.cloud(spark, sf).where("role <> 'ground'").select("pid", "tree_id", "x", "y", "z", "h")
    return descriptors.relative_heights(points, fx.stems(spark, sf).where("height_m > 0"))


@query(REL + " SELECT tree_id, " + ", ".join(f"round(quantile_cont(rel, {p}e-2), 6) AS relh_p{p}" for p in descriptors.PERCENTILES) + " FROM p GROUP BY tree_id")
def relheight_percentiles(spark, sf):
    return rounded(descriptors.height_percentiles(_relative(spark, sf)))


@query(
    REL
    + """, m AS (SELECT tree_id, avg(rel) AS mu FROM p GROUP BY tree_id),
 v AS (SELECT tree_id, mu, avg((rel - mu) * (rel - mu)) AS m2, avg((rel - mu) * (rel - mu) * (rel - mu)) AS m3, avg((rel - mu) * (rel - mu) * (rel - mu) * (rel - mu)) AS m4 FROM p JOIN m USING (tree_id) GROUP BY ALL)
 SELECT tree_id, round(mu, 6) AS relh_mean, round(sqrt(m2), 6) AS relh_std, round(m3 / (sqrt(m2) * sqrt(m2) * sqrt(m2) + 1e-9), 6) AS relh_skew, round(m4 / (m2 * m2 + 1e-9), 6) AS relh_kurt FROM v"""
)
def relheight_moments(spark, sf):
    return rounded(descriptors.height_moments(_relative(spark, sf)))


_BINS = range(descriptors.BINS)


@query(
    REL
    + """, a AS (SELECT tree_id, count(*) AS n_all, greatest(max(rad), 1e-6) AS r_all FROM p GROUP BY tree_id),
 b AS (SELECT tree_id, bin, count(*) / any_value(n_all) AS dens, CASE WHEN count(*) >= 5 THEN quantile_cont(rad, 0.9e0) / any_value(r_all) ELSE 0 END AS radius FROM p JOIN a USING (tree_id) GROUP BY tree_id, bin),
 w AS (SELECT tree_id, """
    + ", ".join(f"coalesce(max({v}) FILTER (bin = {i}), 0) AS {v}_{i}" for v in ("dens", "radius") for i in _BINS)
    + " FROM b GROUP BY tree_id), r AS (SELECT *, ["
    + ", ".join(f"radius_{i}" for i in _BINS)
    + "] AS radii FROM w) SELECT tree_id, "
    + ", ".join(f"round({v}_{i}, 6) AS {v}_{i}" for v in ("dens", "radius") for i in _BINS)
    + ", round((list_position(radii, list_max(radii)) - 1) / 9e0, 6) AS widest_rel_height, round(radius_9 / greatest(radius_5, 1e-6), 4) AS top_taper FROM r"
)
def density_radius_profile(spark, sf):
    found = descriptors.profiles(_relative(spark, sf))
    return rounded(found, keep=("top_taper",)).withColumn("top_taper", F.round("top_taper", 4))


@query(
    REL
    + """, k AS (SELECT tree_id, count(*) AS n, covar_samp(x, x) AS xx, covar_samp(y, y) AS yy, covar_samp(z, z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz FROM p GROUP BY tree_id),
 q3 AS (SELECT *, (xx + yy + zz) / 3 AS m FROM k),
 p2 AS (SELECT *, sqrt(((xx - m) * (xx - m) + (yy - m) * (yy - m) + (zz - m) * (zz - m) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q3),
 d AS (SELECT *, ((xx - m) * ((yy - m) * (zz - m) - yz * yz) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / (p * p * p) AS det FROM p2),
 ev AS (SELECT *, m + 2 * p * cos(acos(greatest(-1, least(1, det / 2))) / 3) AS big, m + 2 * p * cos(acos(greatest(-1, least(1, det / 2))) / 3 + 2 * pi() / 3) AS low FROM d),
 l AS (SELECT tree_id, n, greatest(big, 1e-12) AS l0, greatest(3 * m - big - low, 1e-12) AS l1, greatest(low, 1e-12) AS l2 FROM ev)
 SELECT tree_id, CASE WHEN n < 4 THEN 0 ELSE round((l0 - l1) / l0, 4) END AS pca_linearity, CASE WHEN n < 4 THEN 0 ELSE round((l1 - l2) / l0, 4) END AS pca_planarity, CASE WHEN n < 4 THEN 0 ELSE round(l2 / l0, 4) END AS pca_sphericity FROM l"""
)
def pca_shape(spark, sf):
    return rounded(descriptors.shape(_relative(spark, sf), "pca"), 4)


@query(
    FULL
    + """ SELECT tree_id, height_m, dbh_cm, round(h_d_ratio, 6) AS h_d_ratio, round(crown_base_m / height_m, 6) AS crown_base_rel, round(1 - crown_base_m / height_m, 6) AS crown_length_rel,
 round(crown_diameter_m / height_m, 6) AS crown_diam_rel, round(crown_diameter_m / greatest(dbh_cm / 100, 0.001e0), 6) AS crown_diam_dbh, crown_area_m2, crown_volume_m3,
 round(crown_volume_m3 / (pi() * (crown_diameter_m / 2) * (crown_diameter_m / 2) * (CASE WHEN height_m - crown_base_m < 0.001e0 THEN 0.001e0 ELSE height_m - crown_base_m END)), 6) AS crown_fill FROM t"""
)
def crown_ratios(spark, sf):
    return rounded(descriptors.crown_ratios(_measured(spark, sf)), keep=("height_m", "dbh_cm", "crown_area_m2", "crown_volume_m3"))


@query()
def tree_feature_table(spark, sf):
    full = _measured(spark, sf).withColumns({"stem_lean_deg": F.lit(0.0)})
    points = fx.cloud(spark, sf).where("role <> 'ground'").select("pid", "tree_id", "x", "y", "z", "h")
    return descriptors.feature_table(points, full)


# stand and groups -----------------------------------------------------------------------------------

HULL = FULL + """, u AS (SELECT * FROM t WHERE quality <> 'poor'), p AS (SELECT x, y FROM u UNION SELECT x, y FROM t WHERE (SELECT count(*) FROM u) < 3),
 e AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON (a.x, a.y) <> (b.x, b.y)
   WHERE NOT EXISTS (SELECT 1 FROM p c WHERE ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
     OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0)))),
 hull AS (SELECT sum(ax * b_y - bx * ay) / 2 AS area, sum(sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y))) AS around FROM e),
 ha AS (SELECT CASE WHEN area = 0 THEN (SELECT (max(x) - min(x)) * (max(y) - min(y)) / 1e4 FROM p) ELSE (area + around * (SELECT median(crown_diameter_m) / 4 FROM t) + pi() * (SELECT median(crown_diameter_m) / 4 FROM t) * (SELECT median(crown_diameter_m) / 4 FROM t)) / 1e4 END AS stand_area_ha FROM hull)"""


@query(HULL + " SELECT round(stand_area_ha, 6) AS stand_area_ha FROM ha")
def stand_area(spark, sf):
    area = stand.stand_area_ha(_measured(spark, sf))
    return spark.range(1).select(F.round(F.lit(area), 6).alias("stand_area_ha"))


@query(
    FULL
    + """ SELECT cast(NULL AS DOUBLE) AS dtm_area_ha, 2e0 AS stand_area_ha, count(*) AS n_trees, count(*) FILTER (quality = 'good') AS n_good, count(*) FILTER (quality = 'fair') AS n_fair, count(*) FILTER (quality = 'poor') AS n_poor,
 round(count(*) / 2e0, 6) AS stems_ha, round(count(*) FILTER (quality <> 'poor') / 2e0, 6) AS stems_usable_ha, round(avg(dbh_cm) FILTER (quality <> 'poor'), 6) AS dbh_mean_cm,
 round(median(dbh_cm) FILTER (quality <> 'poor'), 6) AS dbh_median_cm, round(avg(dbh_cm) FILTER (quality = 'good'), 6) AS dbh_good_mean_cm, round(avg(height_m) FILTER (quality <> 'poor'), 6) AS height_mean_m,
 round(median(height_m) FILTER (quality <> 'poor'), 6) AS height_median_m, round(sum(basal_area_m2) FILTER (quality <> 'poor') / 2e0, 6) AS basal_area_m2_ha,
 CASE WHEN count(height_m) > 3 THEN round(corr(dbh_cm, height_m) FILTER (height_m IS NOT NULL), 6) END AS height_dbh_corr,
 CASE WHEN count(height_m) FILTER (quality = 'good') > 3 THEN round(corr(dbh_cm, height_m) FILTER (quality = 'good' AND height_m IS NOT NULL), 6) END AS height_dbh_corr_good FROM t"""
)
def stand_summary(spark, sf):
    return rounded(stand.stand_summary(_measured(spark, sf), 2.0))


@query(FULL + " SELECT quality, count(*) AS n, round(median(dist_from_scan_centre_m), 6) AS median_range_m FROM t GROUP BY quality")
def range_by_quality(spark, sf):
    return rounded(stand.range_by_quality(_measured(spark, sf)))


@query(
    FULL
    + " SELECT structural_group, count(*) AS n, "
    + ", ".join(f"round(median({c}), 2) AS {c}" for c in ("dbh_cm", "height_m", "crown_diameter_m", "crown_base_m", "h_d_ratio"))
    + " FROM t WHERE structural_group IS NOT NULL GROUP BY structural_group"
)
def group_profile(spark, sf):
    return stand.group_profile(_measured(spark, sf))


@query()
def structural_groups(spark, sf):
    every = _measured(spark, sf)
    return stand.structural_groups(tree_feature_table(spark, sf), every.select("tree_id", "quality"))


def _species(spark, sf) -> species.SpeciesModel:
    labels = fx.stems(spark, sf).select("tree_id", F.concat(F.lit("s"), F.floor(F.col("dbh_cm") / 4).cast("string")).alias("species"))
    return species.species_model(tree_feature_table(spark, sf), labels)


@query()
def species_model(spark, sf):
    return _species(spark, sf).predicted


@query()
def species_importance(spark, sf):
    """The fifteen descriptors that tell species best."""
    return _species(spark, sf).importance.where("rank <= 15")


@query(
    S
    + """, p AS (SELECT concat('s', cast(floor(dbh_cm / 4) AS BIGINT)) AS species, concat('s', cast(floor((dbh_cm + tree_id % 3) / 4) AS BIGINT)) AS predicted FROM s),
 r AS (SELECT species, count(*) AS support, count(*) FILTER (WHERE species = predicted) AS hits FROM p GROUP BY species),
 t AS (SELECT predicted AS species, count(*) AS told FROM p GROUP BY predicted)
 SELECT species, round(coalesce(hits / nullif(told, 0), 0), 6) AS precision, round(coalesce(hits / nullif(support, 0), 0), 6) AS recall,
        round(coalesce(2 * hits / nullif(coalesce(told, 0) + coalesce(support, 0), 0), 0), 6) AS f1, coalesce(support, 0) AS support FROM r FULL JOIN t USING (species)"""
)
def species_report(spark, sf):
    """Precision, recall and f1 of species told from diameters that are off by up to two centimetres."""
    named = fx.stems(spark, sf).selectExpr("concat('s', floor(dbh_cm / 4)) as species", "concat('s', floor((dbh_cm + tree_id % 3) / 4)) as predicted")
    return rounded(species.class_report(named))


# validation -----------------------------------------------------------------------------------------

V = f"WITH f AS {fx.FOUND_SQL}, r AS {fx.SURVEY_SQL}, cand AS (SELECT f.id AS pred_id, r.id AS ref_id, sqrt((f.x - r.x) * (f.x - r.x) + (f.y - r.y) * (f.y - r.y)) AS dist FROM f JOIN r ON abs(f.x - r.x) <= 2 AND abs(f.y - r.y) <= 2)"


@query(V + " SELECT pred_id, ref_id, round(dist, 6) AS dist FROM cand WHERE dist <= 2")
def match_candidates(spark, sf):
    return rounded(validate.match_candidates(*fx.found_and_surveyed(spark, sf), 2.0))


@query(V + " SELECT pred_id, arg_min(ref_id, dist) AS ref_id, round(min(dist), 6) AS match_dist_m FROM cand WHERE dist <= 2 GROUP BY pred_id")
def match_assignment(spark, sf):
    """In this survey each component is one tree with one or two candidates, so the nearest is the optimum."""
    return rounded(validate.match_trees(*fx.found_and_surveyed(spark, sf), 2.0))


#: Pairs of trees a metre apart and a survey shifted by 0.9 m and more: the nearest survey tree of the second is the best of the first.
CHAINS = f"""WITH s AS {fx.STEMS_SQL}, f AS (SELECT tree_id AS id, (tree_id // 2) * 1e2 + (tree_id % 2) AS x, 0e0 AS y FROM s),
 r AS (SELECT tree_id AS id, (tree_id // 2) * 1e2 + (tree_id % 2) * 0.9e0 + 0.9e0 + ((tree_id // 2) % 4) * 0.02e0 AS x, 0e0 AS y FROM s)"""


@query(
    CHAINS
    + """, c AS (SELECT f.id AS pred_id, r.id AS ref_id, f.id // 2 AS g, abs(f.x - r.x) AS dist FROM f JOIN r ON f.id // 2 = r.id // 2 AND abs(f.x - r.x) <= 2),
 one AS (SELECT g, [{p: pred_id, r: ref_id, d: dist}] AS m, 1 AS n, dist AS total FROM c),
 two AS (SELECT a.g, [{p: a.pred_id, r: a.ref_id, d: a.dist}, {p: b.pred_id, r: b.ref_id, d: b.dist}] AS m, 2 AS n, a.dist + b.dist AS total
         FROM c AS a JOIN c AS b ON a.g = b.g AND a.pred_id < b.pred_id AND a.ref_id <> b.ref_id),
 best AS (SELECT g, arg_min(m, (-n, total)) AS m FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY g)
 SELECT u.p AS pred_id, u.r AS ref_id, round(u.d, 6) AS match_dist_m FROM (SELECT unnest(m) AS u FROM best)"""
)
def match_assignment_chains(spark, sf):
    """Where taking each tree's nearest would leave its neighbour a worse one."""
    trees_ = fx.stems(spark, sf)
    place = "floor(tree_id / 2) * 1e2 + (tree_id % 2)"
    found = trees_.selectExpr("tree_id as id", f"{place} as x", "0e0 as y")
    surveyed = trees_.selectExpr("tree_id as id", f"{place} * 1e0 - (tree_id % 2) * 0.1e0 + 0.9e0 + (floor(tree_id / 2) % 4) * 0.02e0 as x", "0e0 as y")
    return rounded(validate.match_trees(found, surveyed, 2.0))


PAIRED = V + ", m AS (SELECT pred_id, arg_min(ref_id, dist) AS ref_id, min(dist) AS match_dist_m FROM cand WHERE dist <= 2 GROUP BY pred_id)"


@query(
    PAIRED
    + """, n AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM f) AS np, (SELECT count(*) FROM r) AS nr),
 s AS (SELECT tp, np - tp AS fp, nr - tp AS fn, tp / greatest(np, 1) AS precision, tp / greatest(nr, 1) AS recall FROM n)
 SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / greatest(precision + recall, 1e-9), 6) AS f1, (SELECT round(avg(match_dist_m), 6) FROM m) AS mean_match_dist_m FROM s"""
)
def detection_stats(spark, sf):
    found, surveyed = fx.found_and_surveyed(spark, sf)
    return rounded(validate.detection_stats(validate.match_trees(found, surveyed, 2.0), found, surveyed))


@query(
    PAIRED
    + """, j AS (SELECT unnest([('dbh_cm', f.dbh_cm, r.dbh_cm), ('height_m', f.height_m, r.height_m)]) AS t FROM m JOIN f ON f.id = pred_id JOIN r ON r.id = ref_id),
 e AS (SELECT t[1] AS field, t[2] AS p, t[3] AS q, t[2] - t[3] AS d FROM j WHERE t[2] IS NOT NULL AND t[3] IS NOT NULL)
 SELECT field, count(*) AS n, round(avg(d), 6) AS bias, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, round(100 * sqrt(avg(d * d)) / avg(q), 6) AS rel_rmse_pct,
 CASE WHEN var_pop(q) > 0 THEN round(1 - sum(d * d) / (var_pop(q) * count(*)), 6) END AS r2 FROM e GROUP BY field"""
)
def error_stats(spark, sf):
    found, surveyed = fx.found_and_surveyed(spark, sf)
    pairs = validate.match_trees(found, surveyed, 2.0)
    return rounded(validate.error_stats(validate.joined_pairs(pairs, found, surveyed), ["dbh_cm", "height_m"]))


@query(PAIRED + " SELECT f.id AS id_pred, f.dbh_cm AS dbh_cm_pred, r.id AS id_ref, r.dbh_cm AS dbh_cm_ref, round(match_dist_m, 6) AS match_dist_m FROM m JOIN f ON f.id = pred_id JOIN r ON r.id = ref_id")
def column_map_suffix(spark, sf):
    found, surveyed = fx.found_and_surveyed(spark, sf)
    names = {"diameter": "dbh_cm"}
    listed = tables.renamed(surveyed.withColumnRenamed("dbh_cm", "diameter"), names)
    pairs = validate.match_trees(found, listed, 2.0)
    keep = ["id", "dbh_cm"]
    return rounded(validate.joined_pairs(pairs, found.select(keep), listed.select(keep)))


@query(V + " SELECT id, 'missed' AS kind FROM r WHERE id NOT IN (SELECT ref_id FROM cand WHERE dist <= 2) UNION ALL SELECT id, 'false' FROM f WHERE id NOT IN (SELECT pred_id FROM cand WHERE dist <= 2)")
def unmatched_trees(spark, sf):
    found, surveyed = fx.found_and_surveyed(spark, sf)
    near = validate.match_candidates(found, surveyed, 2.0)
    missed = surveyed.join(near.select(F.col("ref_id").alias("id")), "id", "left_anti").select("id", F.lit("missed").alias("kind"))
    return missed.unionByName(found.join(near.select(F.col("pred_id").alias("id")), "id", "left_anti").select("id", F.lit("false").alias("kind")))


# views ------------------------------------------------------------------------------------------------


@query(
    FULL
    + " SELECT tree_id, quality, dbh_cm, dbh_arc, height_m FROM t WHERE quality IN ('good', 'fair', 'poor') AND coalesce(dbh_cm, 0) BETWEEN 5 AND 9 AND coalesce(dbh_arc, 0) >= 0 ORDER BY height_m DESC NULLS LAST, tree_id LIMIT 500"
)
def table_filter_sort_limit(spark, sf):
    page = views.table_page(_measured(spark, sf), ("good", "fair", "poor"), (5.0, 9.0), 0.0, "height_m", descending=True)
    return page.select("tree_id", "quality", "dbh_cm", "dbh_arc", "height_m")


@query()
def sample_fixed_n(spark, sf):
    return views.fixed_sample(fx.cloud(spark, sf).select("pid", "x", "y", "z"), 1000)


@query(
    FULL
    + f""", c AS {fx.CLOUD_SQL}, p AS (SELECT pid, CASE WHEN role = 'ground' THEN NULL ELSE tree_id END AS tree_id FROM c)
 SELECT pid, p.tree_id, CASE WHEN p.tree_id IS NULL THEN 0 ELSE cast(p.tree_id % 20 + 1 AS INT) END AS tree_colour,
 CASE WHEN p.tree_id IS NULL THEN 0 WHEN quality = 'good' THEN 1 WHEN quality = 'fair' THEN 2 ELSE 3 END AS quality_colour FROM p LEFT JOIN t USING (tree_id)"""
)
def cloud_colour_codes(spark, sf):
    points = fx.cloud(spark, sf).select("pid", F.when(F.col("role") != "ground", F.col("tree_id")).alias("tree_id"))
    return views.colour_codes(points, _measured(spark, sf)).select("pid", "tree_id", "tree_colour", "quality_colour")


@query(C + f", s AS {fx.STEMS_SQL} SELECT pid, c.tree_id FROM c, s WHERE s.tree_id = 3 AND c.tree_id <> 3 AND abs(c.x - s.x) < 8 AND abs(c.y - s.y) < 8")
def neighbour_box(spark, sf):
    return views.neighbour_box(fx.cloud(spark, sf), fx.stems(spark, sf), 3).select("pid", "tree_id")


@query(f"{C} SELECT pid, x, z FROM c WHERE abs(y - 4) < 2")
def cross_section_band(spark, sf):
    return views.cross_section(fx.cloud(spark, sf), 4.0, 2.0).select("pid", "x", "z")


@query(S + " SELECT s.tree_id, s.dbh_cm, g.structural_group AS grp FROM s LEFT JOIN (SELECT tree_id, structural_group FROM s WHERE structural_group IS NOT NULL) AS g USING (tree_id)")
def left_join_groups(spark, sf):
    every = fx.stems(spark, sf)
    groups = every.where("structural_group is not null").select("tree_id", F.col("structural_group").alias("grp"))
    return every.select("tree_id", "dbh_cm").join(groups, "tree_id", "left")


@query(S + " SELECT s.tree_id, s.height_m, n_name AS species FROM s JOIN (SELECT s_suppkey AS tree_id, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0) USING (tree_id)")
def feature_label_inner(spark, sf):
    supplier, nation = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("supplier", "nation"))
    labels = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).where("s_acctbal > 0").select(F.col("s_suppkey").alias("tree_id"), F.col("n_name").alias("species"))
    return fx.stems(spark, sf).select("tree_id", "height_m").join(labels, "tree_id")


@query(PLANTS + " SELECT pid, min(tree_id) AS tree_id FROM (SELECT pid, tree_id FROM p WHERE h < 2 UNION ALL SELECT pid, tree_id + 1 FROM p WHERE h > 1) GROUP BY pid")
def union_seed_nodes(spark, sf):
    points = _vegetation(spark, sf)
    parts = points.where("h < 2").select("pid", "tree_id").unionByName(points.where("h > 1").select("pid", (F.col("tree_id") + 1).alias("tree_id")))
    return parts.groupBy("pid").agg(F.min("tree_id").alias("tree_id"))


@query(
    S
    + """, n AS (SELECT count(*) AS n FROM s), picks AS (SELECT DISTINCT cast(floor(i * (n - 1) / greatest(least(12, n) - 1, 1)) AS BIGINT) AS place FROM n, range(0, 12) AS t(i) WHERE i < n)
 SELECT tree_id, cast(place AS INT) AS place FROM (SELECT tree_id, row_number() OVER (ORDER BY dbh_cm, tree_id) - 1 AS place FROM s) JOIN picks USING (place)"""
)
def even_spaced_pick(spark, sf):
    return views.evenly_spaced(fx.stems(spark, sf).select("tree_id", "dbh_cm"), ["dbh_cm", "tree_id"], 12).select("tree_id", "place")


@query(S + " SELECT tree_id, dbh_source, cast((row_number() OVER (PARTITION BY dbh_source ORDER BY tree_id) - 1) % 5 AS INT) AS fold FROM s")
def stratified_folds(spark, sf):
    return views.stratified_folds(fx.stems(spark, sf).select("tree_id", "dbh_source"), "dbh_source", ["tree_id"])


@query(
    S
    + """ SELECT to_json({tree_id: tree_id, dbh_source: dbh_source, n_layers: n_layers}) AS json FROM s"""
)
def json_rows(spark, sf):
    return tables.json_rows(fx.stems(spark, sf).select("tree_id", "dbh_source", "n_layers"))


@query(FULL + " SELECT tree_id, x, y, round(greatest(5e0, least(45e0, dbh_cm)) * 0.55e0, 6) AS marker, cast(structural_group AS VARCHAR) AS colour FROM t WHERE structural_group IS NOT NULL")
def stem_map(spark, sf):
    return rounded(views.stem_map(_measured(spark, sf), "structural_group"))


@query(
    C
    + f""", s AS {fx.STEMS_SQL}, n AS (SELECT c.pid, c.tree_id, c.x - s.x AS dx, c.y - s.y AS dy, c.z - 2e0 AS dz, greatest(0.25e0, 2.5e0 * dbh_cm / 1e2) AS lim
 FROM c JOIN s USING (tree_id) WHERE c.role = 'stem' AND abs(c.h - CASE WHEN n_layers > 7 THEN 1.5e0 ELSE 1.3e0 END) <= 0.06e0 + 1e-9),
 uv AS (SELECT pid, tree_id, -dy AS u, 0.8e0 * dx - 0.6e0 * dz AS v, lim FROM n)
 SELECT pid, tree_id, round(u, 6) AS u, round(v, 6) AS v, sqrt(u * u + v * v) < lim AS near FROM uv"""
)
def diameter_slices(spark, sf):
    """The slices that diameters come from, at a height of their own where a tree has one."""
    used = fx.stems(spark, sf).selectExpr("tree_id", "case when n_layers > 7 then 1.5e0 end as dbh_height_used")
    points = fx.cloud(spark, sf).where("role = 'stem'")
    return rounded(trees.diameter_slices(points, _axes(spark, sf).join(used, "tree_id"), 1.3, 0.12 + 2e-9))


@query(
    CELLS.format(v="1e0")
    + """, m AS (SELECT ix, iy, min(z) AS v FROM k GROUP BY ALL), ends AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1 FROM c),
 e AS (SELECT min(ix) AS ox, max(ix) AS nx, min(iy) AS oy, max(iy) AS ny FROM m),
 line AS (SELECT cast(i AS INT) AS nth, x0 + i * (x1 - x0) / 399e0 AS x, x0, y0 FROM ends, range(0, 400) AS t(i)),
 f AS (SELECT nth, x, greatest(ox, least(nx, (x - x0) / 1e0)) AS fx, greatest(oy, least(ny, (2e0 - y0) / 1e0)) AS fy, nx, ny FROM line, e),
 b AS (SELECT *, cast(least(floor(fx), nx - 1) AS BIGINT) AS cx0, cast(least(floor(fy), ny - 1) AS BIGINT) AS cy0 FROM f),
 w AS (SELECT nth, x, cx0 + dx AS ix, cy0 + dy AS iy, (CASE dx WHEN 1 THEN fx - cx0 ELSE 1 - (fx - cx0) END) * (CASE dy WHEN 1 THEN fy - cy0 ELSE 1 - (fy - cy0) END) AS w
       FROM b, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dx, dy)),
 j AS (SELECT nth, x, CASE WHEN w = 0 THEN 0 ELSE w * v END AS p FROM w LEFT JOIN m USING (ix, iy))
 SELECT nth, round(x, 6) AS x, CASE WHEN count(p) = 4 THEN round(sum(p), 6) END AS ground FROM j GROUP BY nth, x"""
)
def ground_section(spark, sf):
    """The lowest surface along a line, in 400 samples."""
    points = fx.cloud(spark, sf)
    cells = grid.cell_surface(points, 1.0, "min").select("ix", "iy", F.col("v").alias("dtm"), F.lit(1.0).alias("valid"))
    ends = points.agg(F.min("x").alias("x_low"), F.max("x").alias("x_high"), F.min("x").alias("x0"), F.min("y").alias("y0"))
    return rounded(views.ground_section(cells, 2.0, ends, 1.0))


@query(
    FULL
    + """, ends AS (SELECT min(dbh_cm) AS d0, max(dbh_cm) AS d1, min(height_m) AS h0, max(height_m) AS h1 FROM t)
 SELECT field, quality, bin, count(*) AS n FROM (
 SELECT 'dbh_cm' AS field, NULL AS quality, least(29, cast(floor(coalesce((dbh_cm - d0) / nullif(d1 - d0, 0), 0) * 30) AS BIGINT)) AS bin FROM t, ends WHERE dbh_cm IS NOT NULL
 UNION ALL SELECT 'height_m', NULL, least(29, cast(floor(coalesce((height_m - h0) / nullif(h1 - h0, 0), 0) * 30) AS BIGINT)) FROM t, ends WHERE height_m IS NOT NULL
 UNION ALL SELECT 'dbh_arc', quality, least(24, cast(floor(dbh_arc * 25) AS BIGINT)) FROM t WHERE dbh_arc IS NOT NULL) GROUP BY ALL"""
)
def inventory_histograms(spark, sf):
    return views.inventory_histograms(_measured(spark, sf))


@query(
    C
    + """, m AS MATERIALIZED (SELECT cast(floor(xi / 5e2) AS BIGINT) AS ix, cast(floor(yi / 5e2) AS BIGINT) AS iy, min(zi) / 1e3 AS v FROM c WHERE role = 'stem' GROUP BY ALL),
 e AS (SELECT min(ix) - 9 AS x0, max(ix) + 9 AS x1, min(iy) - 9 AS y0, max(iy) + 9 AS y1 FROM m),
 g AS (SELECT ix, unnest(range(y0, y1 + 1)) AS iy FROM (SELECT unnest(range(x0, x1 + 1)) AS ix, y0, y1 FROM e)),
 d AS (SELECT g.ix, g.iy, v, (m.ix - g.ix) * (m.ix - g.ix) + (m.iy - g.iy) * (m.iy - g.iy) AS far, abs(m.iy - g.iy) AS dy, m.iy AS ky, m.ix AS kx FROM g, m)
 SELECT ix, iy, arg_min(v, (far, dy, ky, kx)) AS v, round(sqrt(min(far)), 6) AS far, min(far) = 0 AS seen FROM d GROUP BY ix, iy"""
)
def raster_nearest_fill(spark, sf):
    """Each cell's nearest cell with a stem return, and how far it is."""
    places = [F.floor(F.col(f"{a}i") / 500).cast("long").alias(f"i{a}") for a in "xy"]
    cells = fx.cloud(spark, sf).where("role = 'stem'").groupBy(*places).agg((F.min("zi") / 1e3).alias("v"))
    cells = graph.checkpoint(cells)
    return rounded(raster.nearest_fill(cells, raster.frame_of(cells, 9)), keep=("v",))


@query(
    CELLS.format(v="1e0")
    + """, m AS MATERIALIZED (SELECT ix, iy, max(z) AS v FROM k GROUP BY ALL), e AS (SELECT min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM m),
 g AS (SELECT ix, unnest(range(y0, y1 + 1)) AS iy FROM (SELECT unnest(range(x0, x1 + 1)) AS ix, y0, y1 FROM e)),
 d AS (SELECT g.ix, g.iy, v, (m.ix - g.ix) * (m.ix - g.ix) + (m.iy - g.iy) * (m.iy - g.iy) AS far, abs(m.iy - g.iy) AS dy, m.iy AS ky, m.ix AS kx FROM g, m),
 f AS MATERIALIZED (SELECT ix, iy, arg_min(v, (far, dy, ky, kx)) AS v FROM d GROUP BY ix, iy),
 near AS (SELECT m.ix, m.iy, m.v, greatest(x0, least(x1, m.ix + a.d)) AS nx, greatest(y0, least(y1, m.iy + b.d)) AS ny
          FROM m, e, (VALUES (-1), (0), (1)) AS a(d), (VALUES (-1), (0), (1)) AS b(d))
 SELECT near.ix, near.iy, near.v FROM near JOIN f ON f.ix = nx AND f.iy = ny GROUP BY near.ix, near.iy, near.v HAVING near.v <= median(f.v) + 1"""
)
def raster_without_spikes(spark, sf):
    """The spike filter of the terrain, one pass over 3 x 3 cells of 1 m."""
    cells = graph.checkpoint(grid.cell_surface(fx.cloud(spark, sf), 1.0, "max"))
    return terrain.without_spikes(cells, replace(CFG, dtm_res=1.0, dtm_despike_window=3.0, dtm_despike=1.0, dtm_despike_passes=1))


# terrain and the whole inventory ----------------------------------------------------------------------


@query()
def cloth_ground(spark, sf):
    return terrain.ground_points(graph.checkpoint(fx.cloud(spark, sf).select("pid", "x", "y", "z")), CFG)


@query()
def terrain_model(spark, sf):
    points = graph.checkpoint(fx.cloud(spark, sf).select("pid", "x", "y", "z"))
    return terrain.build_terrain(terrain.ground_points(points, CFG), points, CFG)


@query()
def stem_detection(spark, sf):
    return stems.detect_stems(fx.cloud(spark, sf).select("pid", "x", "y", "z", "h"), CFG)[0]


@query()
def tree_segmentation(spark, sf):
    points = graph.checkpoint(fx.cloud(spark, sf).where("role <> 'ground'").select("pid", "tree_id", "x", "y", "z", "h"))
    seeds = points.where("h between 0.6 and 2.6").select("pid", "x", "y", "z", F.col("tree_id").cast("int").alias("tree_id"))
    return growth.segment_trees(points.drop("tree_id"), seeds, CFG).select("pid", "tree_id")
