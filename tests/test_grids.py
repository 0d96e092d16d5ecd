"""Grids, regions, candidates, de-duplication and masks: traps and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidewrack.operators import grids as G
from tidewrack.operators.components import label_cells, label_runs, merge_runs, region_stats
from tidewrack.operators.joins import box_overlap, tile_mask_overlap
from tidewrack.sources.files import annotation_runs, shape_runs


def flood(cells, conn):
    left, comps = set(cells), []
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (conn == 8 or not (a and b))]
    while left:
        stack, comp = [left.pop()], set()
        while stack:
            r, c = stack.pop()
            comp.add((r, c))
            for a, b in near:
                if (r + a, c + b) in left:
                    left.remove((r + a, c + b))
                    stack.append((r + a, c + b))
        comps.append(frozenset(comp))
    return set(comps)


@pytest.mark.parametrize("conn", [4, 8])
@pytest.mark.parametrize("band", [64, 4, 1])
def test_components_equal_flood_fill_across_bands(spark, conn, band):
    rnd = random.Random(11)
    maps = {f: {(r, c) for r in range(30) for c in range(30) if rnd.random() < 0.45} for f in range(6)}
    rows = [(f, r, c) for f, cells in maps.items() for r, c in cells]
    out = label_cells(spark.createDataFrame(rows, "frame_id long, r long, c long"), ["frame_id"], connectivity=conn, band=band)
    got = {}
    for x in out.collect():
        got.setdefault((x.frame_id, x.region), set()).add((x.r, x.c))
    assert all(reg == (min(cells)[0] << 32) + min(cells)[1] for (_, reg), cells in got.items())
    for f, cells in maps.items():
        assert {frozenset(v) for (g, _), v in got.items() if g == f} == flood(cells, conn)


def test_many_frames_share_python_batches(spark):
    df = spark.range(3000).select(F.col("id").alias("frame_id"), F.explode(F.array(*[F.struct(F.lit(r).cast("long").alias("r"), F.lit(c).cast("long").alias("c")) for r, c in ((0, 0), (1, 1), (5, 5))])).alias("p"))
    out = label_cells(df.select("frame_id", "p.r", "p.c"), ["frame_id"])
    assert out.select("frame_id", "region").distinct().count() == 6000


def test_merge_runs_equals_pixel_union(spark):
    rnd = random.Random(2)
    rows = [(1, rnd.randint(0, 5), a, a + rnd.randint(0, 30)) for a in (rnd.randint(0, 100) for _ in range(200))]
    out = merge_runs(spark.createDataFrame(rows, "k long, y long, x0 long, x1 long"), ["k"], tile=16).collect()
    pixels = [(r.y, x) for r in out for x in range(r.x0, r.x1)]
    assert len(pixels) == len(set(pixels))
    assert set(pixels) == {(y, x) for _, y, a, b in rows for x in range(a, b)}


@pytest.mark.parametrize("band,tile", [(64, 4096), (4, 7)])
def test_rectangles_of_a_union_are_few_disjoint_and_whole(spark, band, tile):
    rnd = random.Random(5)
    rows = [(k, y, x, y + rnd.randint(0, 30), x + rnd.randint(0, 30)) for k in (1, None, 2) for y, x in ((rnd.randint(-20, 40), rnd.randint(-20, 40)) for _ in range(15))]
    boxes = spark.createDataFrame(rows, "k long, y0 long, x0 long, y1 long, x1 long")
    slabs = G.rect_slabs(boxes, ["k"], band=band, tile=tile).collect()
    got = [(r.k, y, x) for r in slabs for y in range(r.y0, r.y1) for x in range(r.x0, r.x1)]
    want = {(k, y, x) for k, y0, x0, y1, x1 in rows for y in range(y0, y1) for x in range(x0, x1)}
    assert len(got) == len(set(got)) and set(got) == want
    one = spark.createDataFrame([(1, 0, 0, 60, 50)] * 3, "k long, y0 long, x0 long, y1 long, x1 long")
    assert G.rect_slabs(one, ["k"]).count() == 1


def test_crowded_group_is_condensed_batch_by_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        boxes = spark.range(2000).selectExpr("id % 2 k", "id % 40 y0", "(id * 7) % 40 x0", "id % 40 + 3 y1", "(id * 7) % 40 + 3 x1")
        want = {(r.k, y, x) for r in boxes.collect() for y in range(r.y0, r.y1) for x in range(r.x0, r.x1)}
        got = [(r.k, y, x) for r in G.rect_slabs(boxes, ["k"]).collect() for y in range(r.y0, r.y1) for x in range(r.x0, r.x1)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("conn", [4, 8])
@pytest.mark.parametrize("band", [64, 4, 1])
def test_region_stats_equal_labelled_cells(spark, conn, band):
    rnd = random.Random(3)
    cells = [(f, y, x) for f in range(4) for y in range(20) for x in range(20) if rnd.random() < 0.5]
    runs = spark.createDataFrame([(f, y, x, x + 1) for f, y, x in cells], "f long, y long, x0 long, x1 long")
    want = label_runs(runs, ["f"], conn).groupBy("f", "region").agg(
        F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.min("x0").alias("x0"), (F.max("y") + 1).alias("y1"), F.max("x1").alias("x1"))
    got = region_stats(runs, ["f"], conn, band).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tiles_and_mask_meet_once(spark):
    rnd = random.Random(8)
    box = lambda n: [(k, i, y, x, y + rnd.randint(1, 25), x + rnd.randint(1, 25)) for k in (1, 2) for i, (y, x) in enumerate((rnd.randint(-5, 40), rnd.randint(-5, 40)) for _ in range(n))]
    tiles, boxes = box(20), box(6)
    s = "k long, id long, y0 int, x0 int, y1 int, x1 int"
    pixels = {(b[0], y, x) for b in boxes if b[0] == 1 for y in range(b[2], b[4]) for x in range(b[3], b[5])}
    want = {(t[0], t[1]): sum((t[0], y, x) in pixels for y in range(t[2], t[4]) for x in range(t[3], t[5])) for t in tiles}
    only = spark.createDataFrame([b for b in boxes if b[0] == 1], s)
    for mask in (G.rect_slabs(only, ["k"]), G.rect_runs(only, ["k"])):
        out = tile_mask_overlap(spark.createDataFrame(tiles, s), mask, "k", "id", band=10).collect()
        assert {(r.k, r.id): r.mask_px for r in out} == want and len(out) == 40


def frame(spark):
    return spark.createDataFrame([(1,)], "frame_id long")


def test_tile_conventions(spark):
    live, train = G.tile_grid(frame(spark)), G.tile_grid(frame(spark), "train")
    assert live.count() == 1280 and train.count() == 1156
    start = lambda d, i: d.filter(F.col("offset_row") == i).agg(F.min("y0")).first()[0]
    assert [start(live, i) for i in range(5)] == [0, 56, 112, 169, 225]
    assert [start(train, i) for i in range(5)] == [0, 56, 113, 169, 226]
    assert G.tile_grid(frame(spark), both_axes=True).count() == 25 * 256
    assert live.agg(F.max("y1")).first()[0] == 4512


def cells_of(spark, rows):
    return spark.createDataFrame([(1, r, c, v) for r, c, v in rows], "frame_id long, r long, c long, score double")


def test_peak_of_a_region_is_its_first_one_not_the_largest(spark):
    rows = [(0, 0, 0.6), (0, 1, 0.5), (1, 2, 0.5), (2, 3, 0.9), (3, 3, 0.5)]
    out = G.candidates(cells_of(spark, rows), 0.55, 0.4).collect()
    assert len(out) == 1 and out[0].peak_val == 0.6 and out[0].region_size_points == 5
    each = G.candidates_per_peak(cells_of(spark, rows), 0.55, 0.4, 0.1).collect()
    assert sorted(r.peak_val for r in each) == [0.6, 0.9]


def test_small_regions_and_low_peaks_drop_out(spark):
    assert G.candidates(cells_of(spark, [(0, 0, 0.9), (0, 1, 0.9), (1, 0, 0.9)]), 0.5, 0.4).isEmpty()
    low = cells_of(spark, [(r, c, 0.3) for r in (0, 1) for c in (0, 1)])
    assert G.candidates_per_peak(low, 0.2, 0.4, 0.0).isEmpty()


def test_mean_on_the_threshold_does_not_depend_on_the_order_of_cells(spark):
    rows = [(0, 0, 0.52), (0, 1, 0.52), (1, 0, 0.57), (1, 1, 0.59)]
    assert 0.52 + 0.52 + 0.57 + 0.59 < 2.2
    for order in (rows, rows[::-1], [(r, c, v) for (r, c, _), (_, _, v) in zip(rows, rows[::-1])]):
        out = G.candidates_per_peak(cells_of(spark, order), 0.4, 0.5, 0.55).collect()
        assert len(out) == 1 and out[0].mean_val == 0.55


def test_plateau_cells_are_all_peaks(spark):
    flat = cells_of(spark, [(r, c, 0.5) for r in range(3) for c in range(3)])
    assert G.local_maxima(flat, 0.5).count() == 9


def test_crop_is_moved_inside_the_image(spark):
    rows = [(r, c, 0.9) for r in (0, 1) for c in range(76, 80)]
    r = G.candidates(cells_of(spark, rows), 0.5, 0.4, padding=20).first()
    assert (r.crop_y0, r.crop_x1) == (0, 4512) and r.crop_y1 - r.crop_y0 == r.crop_x1 - r.crop_x0


def test_patch_map_clamps_and_fills(spark):
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 0.5), (1, 0.2, 0.0, 1.0), (1, 15.8, 15.8, 0.25)], "frame_id long, tile_row double, tile_col double, score double")
    m = {(r.r, r.c): (round(r.score, 6), r.coverage) for r in G.patch_map(tiles).collect()}
    assert len(m) == 6400 and m[(0, 0)] == (0.5, 1) and m[(1, 0)] == (0.75, 2) and m[(5, 4)] == (1.0, 1) and m[(79, 79)] == (0.25, 1) and m[(40, 40)] == (0.0, 0)


def brute_nms(rows, iou, cap):
    kept = []
    for row in sorted(rows, key=lambda r: (-r[2], r[1]))[:cap]:
        def overlap(q):
            h, w = min(row[5], q[5]) - max(row[3], q[3]), min(row[6], q[6]) - max(row[4], q[4])
            if h <= 0 or w <= 0:
                return 0
            area = lambda z: (z[5] - z[3]) * (z[6] - z[4])
            return h * w / (area(row) + area(q) - h * w)
        if all(overlap(q) <= iou for q in kept):
            kept.append(row)
    return {r[1] for r in kept}


@pytest.mark.parametrize("cap,limit", [(8, 2000), (None, 2000), (None, 10)])
def test_nms_paths_agree_with_loop(spark, cap, limit):
    rnd = random.Random(9)
    rows = []
    for f, n in ((1, 60), (2, 5), (3, 25)):
        for i in range(n):
            y, x = rnd.randint(0, 300), rnd.randint(0, 300)
            rows.append((f, i, rnd.randint(0, 20) / 20, y, x, y + rnd.randint(20, 90), x + rnd.randint(20, 90)))
    df = spark.createDataFrame(rows, "frame_id long, peak_order long, peak_val double, crop_y0 long, crop_x0 long, crop_y1 long, crop_x1 long")
    out = G.nms(df, 0.3, cap, list_limit=limit)
    assert out.columns == df.columns
    for f in (1, 2, 3):
        assert {r.peak_order for r in out.filter(F.col("frame_id") == f).collect()} == brute_nms([r for r in rows if r[0] == f], 0.3, cap)


def test_box_overlap_reports_each_pair_once(spark):
    rnd = random.Random(4)
    boxes = lambda n: [(1, i, y, x, y + rnd.randint(1, 200), x + rnd.randint(1, 200)) for i, (y, x) in enumerate((rnd.randint(0, 500), rnd.randint(0, 500)) for _ in range(n))]
    a, b = boxes(40), boxes(40)
    s = "image_id long, id long, y0 long, x0 long, y1 long, x1 long"
    out = box_overlap(spark.createDataFrame(a, s), spark.createDataFrame(b, s), a_id="id", b_id="id", cell=64).collect()
    want = {(p[1], q[1]) for p in a for q in b if p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]}
    assert len(out) == len(want) and {(r.a_id, r.b_id) for r in out} == want


def test_shape_rules():
    px = lambda runs: {(y, x) for y, a, b in runs for x in range(a, b)}
    assert len(px(shape_runs("rectangle", [[2, 3], [5, 4]], "crops"))) == 8
    assert px(shape_runs("polygon", [[0, 0], [4, 0], [4, 4], [0, 4]], "crops")) == {(y, x) for y in range(5) for x in range(5)}
    triangle = px(shape_runs("polygon", [[0, 0], [4, 0], [0, 4]], "crops"))
    assert triangle == {(y, x) for y in range(5) for x in range(5) if x + y <= 4}
    hook = [[0, 0], [6, 0], [6, 6], [3, 6], [3, 3], [0, 3]]
    assert px(shape_runs("linestrip", hook, "crops")) == px(shape_runs("polygon", hook, "tiles"))
    assert (5, 1) not in px(shape_runs("polygon", hook, "crops"))
    assert shape_runs("circle", [[5, 5], [8, 5]], "crops") == [] and shape_runs("point", [[5, 5]], "crops") == []
    assert px(shape_runs("circle", [[5, 5], [8, 5]], "tiles")) == {(y, x) for y in range(0, 11) for x in range(0, 11) if (y - 5) ** 2 + (x - 5) ** 2 <= 9}
    line = px(shape_runs("line", [[0, 5], [9, 5]], "tiles"))
    assert {y for y, _ in line} == {4, 5, 6}


def test_annotations_to_crops(spark):
    rows = [("a.json", "medusa", "rectangle", [[10.0, 10.0], [19.0, 14.0]]), ("a.json", "medusa", "polygon", [[20.0, 15.0], [24.0, 15.0], [24.0, 19.0], [20.0, 19.0]]),
            ("a.json", "medusa", "rectangle", [[80.0, 80.0], [120.0, 120.0]]), ("a.json", "other", "rectangle", [[0.0, 0.0], [3.0, 3.0]])]
    shapes = spark.createDataFrame(rows, "file string, label string, shape_type string, points array<array<double>>")
    runs = annotation_runs(shapes, "file", 100, 100, labels=["medusa"])
    crops = {r.region_size_pixels: r for r in G.mask_crops(runs, "file", 100, 100, padding=2).collect()}
    # the first two touch at a corner: one crop; the third is clipped at the border
    assert set(crops) == {50 + 25, 400}
    joined = crops[75]
    assert (joined.crop_y1 - joined.crop_y0) == (joined.crop_x1 - joined.crop_x0) == 19
    assert crops[400].crop_y1 == 100 and crops[400].crop_x1 == 100


def test_largest_blob_and_numbers(spark):
    runs = spark.createDataFrame([(1, y, x, x + w) for y, x, w in ((0, 0, 3), (1, 0, 3), (5, 5, 9), (9, 0, 2))], "image_id long, y long, x0 long, x1 long")
    assert G.largest_blob(runs, "image_id").first().area == 9
    blobs = G.blob_metrics(runs, "image_id", 3, 1, 20, 20).orderBy("crop_no").collect()
    assert [(b.crop_no, b.area, b.w, b.h) for b in blobs] == [(1, 6, 3, 2), (2, 9, 9, 1)]
    assert label_runs(runs, ["image_id"]).select("region").distinct().count() == 3


def test_index_lists(spark):
    df = spark.createDataFrame([(1, "1,3-5, 9 ,x,7-6")], "id long, s string")
    assert sorted(r["index"] for r in G.expand_index_list(df, "s").collect()) == [1, 3, 4, 5, 9]


def test_map_deals_tiles_not_cells(spark):
    """Tiles are dealt by frame before they are unfolded, so no cell travels and each cell is summed in one task."""
    tiles = spark.createDataFrame([(f, float(r), float(c), 0.25 * (r % 4)) for f in range(6) for r in range(4) for c in range(4)] + [(9, 1.5, 1.5, 0.5)] * 3,
                                  "frame_id long, tile_row double, tile_col double, score double")
    for fill in (True, False):
        cells = G.patch_map(tiles, 2, 8, fill=fill)
        plan = cells._jdf.queryExecution().executedPlan().toString()
        last = plan.index("Exchange hashpartitioning(frame_id")
        assert plan.index("Generate explode") < last and "hashpartitioning(frame_id, r" not in plan.replace("#", "").translate({ord(d): None for d in "0123456789L"})
        got = {(x.frame_id, x.r, x.c): (x.score, x.coverage) for x in cells.collect()}
        assert got[(9, 3, 3)] == (0.5, 3) and got[(2, 7, 0)] == (0.75, 1) and len(got) == (7 * 64 if fill else 6 * 64 + 4)
