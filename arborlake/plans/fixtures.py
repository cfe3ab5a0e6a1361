"""A forest made from the driver's tables: each supplier is a tree, each line item a return.

Coordinates are whole millimetres, as a scanner stores them, so that any engine derives the same
forest. The expressions are read alike by Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
#: Steps of (name, expression), each on top of the one before.
_CLOUD_STEPS = (
    {
        "pid": f"l_orderkey * 101 + cast(row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as bigint) - 1",
        "tree_id": "cast(l_suppkey as bigint)",
        "flag": "l_returnflag",
    },
    {
        "pid": "pid",
        "tree_id": "tree_id",
        "role": "case when flag <> 'A' then 'stem' when pid % 2 = 0 then 'ground' else 'crown' end",
        "sx": "(tree_id % 10) * 4000",
        "sy": "cast(floor(tree_id / 1e1) as bigint) * 4000",
        "r": "25 + 5 * (tree_id % 5)",
        "th": "radians(cast((pid * 137) % 360 as double))",
    },
    {
        "pid": "pid",
        "tree_id": "tree_id",
        "role": "role",
        "xi": "case role when 'stem' then sx + cast(floor(r * cos(th) + 0.3e0) as bigint) when 'ground' then sx + (pid * 31) % 4000 - 2000 "
        "else sx + cast(floor(cast((pid * 31) % 1500 as double) * cos(th) + 0.3e0) as bigint) end",
        "yi": "case role when 'stem' then sy + cast(floor(r * sin(th) + 0.3e0) as bigint) when 'ground' then sy + (pid * 57) % 4000 - 2000 "
        "else sy + cast(floor(cast((pid * 31) % 1500 as double) * sin(th) + 0.3e0) as bigint) end",
        "hi": "case role when 'stem' then 600 + (pid * 7919) % 2000 when 'ground' then 0 else 3000 + (pid * 97) % 6000 end",
    },
    {
        "pid": "pid",
        "tree_id": "tree_id",
        "role": "role",
        "xi": "xi",
        "yi": "yi",
        "zi": "hi + cast(floor((2 * xi + yi) / 1e2) as bigint)",
        "hi": "hi",
    },
    {
        "pid": "pid",
        "tree_id": "tree_id",
        "role": "role",
        "x": "xi / 1e3",
        "y": "yi / 1e3",
        "z": "zi / 1e3",
        "h": "hi / 1e3",
        "xi": "xi",
        "yi": "yi",
        "zi": "zi",
        "hi": "hi",
    },
)
_STEM_STEPS = (
    {
        "tree_id": "cast(s_suppkey as bigint)",
        "x": "cast((s_suppkey % 10) * 4000 as double) / 1e3",
        "y": "floor(s_suppkey / 1e1) * 4000 / 1e3",
        "dbh_cm": "2 * (25 + 5 * (s_suppkey % 5)) / 1e1",
        "n_layers": "4 + cast(s_suppkey % 7 as int)",
    },
    {
        "tree_id": "tree_id",
        "x": "x",
        "y": "y",
        "dbh_cm": "dbh_cm",
        "n_layers": "n_layers",
        "n_stem_layers": "n_layers",
        "dbh_arc": "case when tree_id % 13 = 12 then null else cast((tree_id * 37) % 100 as double) / 1e2 end",
        "dbh_rmse_cm": "cast((tree_id * 29) % 40 as double) / 1e1",
        "dbh_vs_stack": "0.4e0 + cast((tree_id * 17) % 21 as double) / 1e1",
        "height_m": "case when tree_id % 13 = 5 then null else 1e0 + cast((tree_id * 53) % 250 as double) / 1e1 end",
        "crown_diameter_m": "case when tree_id % 13 = 7 then null else 1e0 + cast((tree_id * 7) % 60 as double) / 1e1 end",
        "crown_base_m": "case when tree_id % 13 = 3 then null else cast((tree_id * 5) % 8 as double) / 2e0 end",
        "crown_area_m2": "1e0 + cast((tree_id * 19) % 90 as double) / 1e1",
        "crown_volume_m3": "2e0 + cast((tree_id * 23) % 300 as double) / 1e1",
        "dbh_source": "case when tree_id % 11 = 4 then 'stack_interp' else 'axis_fit' end",
        "structural_group": "case when tree_id % 6 = 5 then null else cast(tree_id % 4 as int) end",
    },
)


def _frame(df: DataFrame, steps: tuple[dict[str, str], ...]) -> DataFrame:
    for step in steps:
        df = df.selectExpr(*[f"{e} as {n}" for n, e in step.items()])
    return df


def _sql(table: str, steps: tuple[dict[str, str], ...]) -> str:
    text = table
    for step in steps:
        text = f"(select {', '.join(f'{e} as {n}' for n, e in step.items())} from {text})"
    return text


CLOUD_SQL = _sql("lineitem", _CLOUD_STEPS)
STEMS_SQL = _sql("supplier", _STEM_STEPS)
#: A survey of the same trees: moved up to 1.2 m, every seventh missing, every eleventh twice.
SURVEY_SQL = f"""(select tree_id as id, x + (tree_id % 5) * 0.3e0 as x, y, dbh_cm + (tree_id % 3) * 0.5e0 as dbh_cm, height_m from {STEMS_SQL}
 where tree_id % 7 <> 0 union all
 select tree_id + 1000000 as id, x + (tree_id % 5) * 0.3e0 as x, y + 1e0 as y, dbh_cm, height_m from {STEMS_SQL} where tree_id % 7 <> 0 and tree_id % 11 = 0)"""
FOUND_SQL = f"(select tree_id as id, x, y, dbh_cm, height_m from {STEMS_SQL})"


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: ``pid, tree_id, role, x, y, z, h`` and whole millimetres ``xi, yi, zi, hi``."""
    return _frame(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _CLOUD_STEPS)


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees with made-up measures, some of them null."""
    return _frame(spark.read.parquet(f"{sf_dir}/supplier.parquet"), _STEM_STEPS)


def found_and_surveyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    trees = stems(spark, sf_dir)
    found = trees.selectExpr("tree_id as id", "x", "y", "dbh_cm", "height_m")
    moved = trees.where("tree_id % 7 <> 0").selectExpr("tree_id as id", "x + (tree_id % 5) * 0.3e0 as x", "y", "dbh_cm + (tree_id % 3) * 0.5e0 as dbh_cm", "height_m")
    twice = trees.where("tree_id % 7 <> 0 and tree_id % 11 = 0").selectExpr(
        "tree_id + 1000000 as id", "x + (tree_id % 5) * 0.3e0 as x", "y + 1e0 as y", "dbh_cm", "height_m"
    )
    return found, moved.unionByName(twice)
