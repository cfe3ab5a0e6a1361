"""Circles of crowded groups, in slices, against the same groups in one task, and planted circles."""

import numpy as np
import pandas as pd
import pytest

from arborlake.config import SurveyConfig
from arborlake.operators import circles

CFG = SurveyConfig()
#: Centre, radius, points on the circle and elsewhere.
PLANTED = [(0.0, 0.0, 0.3, 900, 300), (5.0, 1.0, 0.12, 4000, 2000), (2.0, -3.0, 0.05, 60, 5), (9.0, 9.0, 0.5, 400, 900)]


def scene():
    rng = np.random.default_rng(4)
    rows = []
    for k, (x, y, r, on, off) in enumerate(PLANTED):
        a = rng.uniform(0, 2 * np.pi, on)
        p = np.column_stack((x + r * np.cos(a), y + r * np.sin(a))) + rng.normal(0, 0.003, (on, 2))
        rows.append(np.column_stack((np.full(on + off, k), np.vstack((p, rng.uniform([x - 1, y - 1], [x + 1, y + 1], (off, 2)))))))
    line = np.linspace(0, 1, 3000)
    rows.append(np.column_stack((np.full(3000, 7), line, 0.5 * line)))
    every = np.vstack(rows)
    return pd.DataFrame({"pid": np.arange(len(every)), "g": every[:, 0].astype(int), "x": every[:, 1], "y": every[:, 2]})


@pytest.mark.parametrize("sent", [0, 10_000])
def test_slices_find_what_one_task_finds(spark, monkeypatch, sent):
    points = spark.createDataFrame(scene()).selectExpr("pid", "x", "y", "case when g = 2 then null else g end as g", "1 as layer")
    monkeypatch.setattr(circles, "_SENT", sent)
    got = {}
    for most in (1 << 16, 500):
        monkeypatch.setattr(circles, "CROWDED", most)
        found = circles.ransac_circles(points, ["g", "layer"], CFG, 0.75).toPandas()
        got[most] = found.assign(g=found["g"].fillna(-1)).sort_values("g", ignore_index=True)
    pd.testing.assert_frame_equal(got[500], got[1 << 16], check_exact=False, rtol=1e-6, atol=1e-8)
    for row in got[500].itertuples():
        x, y, r, on, off = PLANTED[2 if row.g < 0 else int(row.g)]
        assert abs(row.cx - x) < 0.005 and abs(row.cy - y) < 0.005 and abs(row.r - r) < 0.005
        assert row.n >= on * 0.99 and row.rmse < 0.012
        # sixty points at random don't reach all of 36 directions
        assert row.arc == 1.0 if on > 300 else row.arc > 0.7
    assert len(got[500]) == 4


def test_a_wall_is_many_tasks(spark):
    """A crowded group of 300,000 points: five slices, each a group of its own."""
    wall = spark.range(300_000).selectExpr(
        "id as pid", "1 as g", "0.4 * cos(id * 0.7) + 0.001 * (pmod(xxhash64(id), 9) - 4) as x", "case when id % 3 = 0 then pmod(xxhash64(id, 1), 1000) / 500D - 1 else 0.4 * sin(id * 0.7) end as y"
    )
    found = circles.ransac_circles(wall, ["g"], CFG, 0.75).collect()
    assert len(found) == 1 and abs(found[0].r - 0.4) < 0.004 and found[0].n > 190_000 and found[0].arc == 1.0


def test_members_lie_on_their_circle(spark):
    frame = scene()
    points = spark.createDataFrame(frame)
    fits = circles.ransac_circles(points, ["g"], CFG, 0.75).selectExpr("g", "cx", "cy", "r", "g + 100 as circle_id", "n")
    found = circles.circle_members(points, fits, ["g"], CFG.ransac_tol).groupBy("circle_id").count().toPandas().set_index("circle_id")["count"]
    assert found.to_dict() == {r.circle_id: r.n for r in fits.collect()}


def test_no_groups(spark):
    points = spark.createDataFrame([], "pid long, g int, x double, y double")
    assert circles.ransac_circles(points, ["g"], CFG, 0.75).count() == 0
