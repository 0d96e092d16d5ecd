"""Queries over the whole of their input, which have no SQL, by brute force."""

import numpy as np

import __spark_entry__ as entry
from tidewrack.plans.standins import Tables

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def test_anomaly_score_reads_all_entries(spark):
    rows = Tables(spark, FOLDER).v_frame.select("frame_id", "site", "px").collect()
    px, site = np.array([r.px for r in rows], dtype=float), np.array([r.site for r in rows])
    distance = {r.frame_id: r.distance for r in QUERIES["M2_mahalanobis_full"](spark, FOLDER).collect()}
    d, rec = np.array([distance[r.frame_id] for r in rows]), np.round((px * px).mean(axis=1), 9)
    cal = site >= 8
    rank = lambda v: (v[cal][None, :] < v[:, None]).mean(axis=1)
    got = {r.frame_id: r.score for r in QUERIES["M4_anomaly_score_full"](spark, FOLDER).collect()}
    assert np.allclose([got[r.frame_id] for r in rows], (rank(d) + rank(rec)) / 2, atol=1e-3) and px.shape[1] == 64


def test_tiles_under_every_box_are_positive(spark):
    t = Tables(spark, FOLDER)
    boxes = {}
    for b in t.v_manual.select("image_id", "y0", "x0", "y1", "x1").collect():
        boxes.setdefault(b.image_id // 200, []).append(b)
    want = 0
    for r in t.v_tile_score.select("frame_id", "grid_row", "grid_col", "offset_idx").collect():
        y, x = (r.grid_row * 2 + r.offset_idx) * 8, (r.grid_col * 2 + r.offset_idx) * 8
        want += any(b.y0 < y + 16 and b.y1 > y and b.x0 < x + 16 and b.x1 > x for b in boxes.get(r.frame_id, []))
    got = {name: {r.level: r.positives for r in QUERIES[name](spark, FOLDER).collect()}["tile"] for name in ("E9_multi_granularity_eval", "E9_multi_granularity_eval_full")}
    assert got["E9_multi_granularity_eval_full"] == want == got["E9_multi_granularity_eval"]


def test_sweep_tries_every_k(spark):
    rows = QUERIES["M6_kmeans_sweep_full"](spark, FOLDER).collect()
    assert [r.k for r in rows] == list(range(2, 50)) and sum(r.best for r in rows) == 1
