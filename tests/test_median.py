"""Upper medians by counts of bins, against sorting."""

import random

import pytest

from arborlake.operators.grid import upper_medians


@pytest.mark.parametrize("bins", [1, 7, 1 << 16])
def test_against_sorting(spark, bins):
    """Ties, single values, even and odd counts, null values and keys, values far apart, a group that holds most rows."""
    rng = random.Random(bins)
    rows = [(rng.choice([None, 0, 1, 2]), rng.randrange(3), rng.choice([None, 0.0, 1.5, rng.gauss(0, 1), 1e12])) for _ in range(600)]
    rows += [(5, 5, rng.choice([2.0, rng.random()])) for _ in range(4000)] + [(6, 6, None), (7, 7, -3.25)]
    found = upper_medians(spark.createDataFrame(rows, "a int, b int, z double"), ["a", "b"], "z", bins)
    want = {}
    for a, b, z in rows:
        if z is not None:
            want.setdefault((a, b), []).append(z)
    got = [((r.a, r.b), r.v) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == {k: sorted(v)[len(v) // 2] for k, v in want.items()}


def test_one_value_and_none(spark):
    for rows, want in (([(1, 2.0)] * 4, [(1, 2.0)]), ([], []), ([(1, None)], [])):
        assert [tuple(r) for r in upper_medians(spark.createDataFrame(rows, "k int, z double"), ["k"], "z").collect()] == want


def test_no_group_is_gathered(spark):
    """Neither lists nor windows see a group's values: of a million rows of one cell, few reach a window."""
    cell = spark.range(1_000_000).selectExpr("0 as k", "cast(pmod(xxhash64(id), 1000003) as double) / 1e3 as z")
    plan = upper_medians(cell, ["k"], "z")
    assert "collect_" not in plan._jdf.queryExecution().toString()
    assert plan.first().v == cell.selectExpr("element_at(array_sort(collect_list(z)), 500001) as v").first().v
