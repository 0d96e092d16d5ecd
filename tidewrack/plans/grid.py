"""Queries on tile grids, score maps, boxes, masks and detections."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import columns as C
from tidewrack.operators import grids as G
from tidewrack.operators import joins as J
from tidewrack.plans.registry import query
from tidewrack.plans.standins import Tables

# the stand-in maps are 16 x 16 cells of 282 px
MAP = dict(n=2, size=16)
CUT = dict(peak=0.62, secondary=0.52)
UP = 282.0

# components of cells >= 0.52, spelled as a recursive reach: region = smallest linear cell number
REACH = """
hot AS (SELECT frame_id, r, c, score, r * 4294967296 + c AS lin FROM v_map WHERE score >= {level}),
edge AS (SELECT a.frame_id, a.lin AS a, b.lin AS b FROM hot a JOIN hot b
         ON a.frame_id = b.frame_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND {near}),
reach AS (SELECT frame_id, lin AS node, lin AS root FROM hot
          UNION SELECT e.frame_id, e.b, x.root FROM reach x JOIN edge e ON e.frame_id = x.frame_id AND e.a = x.node WHERE x.root < e.b),
reg AS (SELECT h.frame_id, h.r, h.c, h.score, h.lin, t.region FROM hot h
        JOIN (SELECT frame_id, node, MIN(root) AS region FROM reach GROUP BY frame_id, node) t
        ON t.frame_id = h.frame_id AND t.node = h.lin)"""
REACH8 = REACH.format(level=CUT["secondary"], near="1 = 1")
PEAKS = """
peaks AS (SELECT a.frame_id, a.r, a.c, MAX(a.score) AS score FROM v_map a JOIN v_map b
          ON a.frame_id = b.frame_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1
          WHERE a.score >= {peak} GROUP BY a.frame_id, a.r, a.c HAVING MAX(a.score) >= MAX(b.score))"""
PEAK = PEAKS.format(peak=CUT["peak"])


def square_sql(padding: int, source: str) -> str:
    """Pixel boxes of cell boxes: padding, squaring around the centre and the shift inside, step by step."""
    ax = lambda v, up: f"CAST(round_even({v} * {UP}, 0) AS BIGINT)"
    return f"""
px AS (SELECT *, greatest(0, {ax('r_min', 0)} - {padding}) AS py0, least(4512, {ax('(r_max + 1)', 1)} + {padding}) AS py1,
       greatest(0, {ax('c_min', 0)} - {padding}) AS px0, least(4512, {ax('(c_max + 1)', 1)} + {padding}) AS px1 FROM {source}),
sq AS (SELECT *, greatest(py1 - py0, px1 - px0) AS s FROM px),
ctr AS (SELECT *, (py0 + py1) // 2 - s // 2 AS sy, (px0 + px1) // 2 - s // 2 AS sx FROM sq),
sh AS (SELECT *, CASE WHEN sy < 0 THEN 0 ELSE sy END AS ty0, CASE WHEN sy < 0 THEN least(s, 4512) ELSE sy + s END AS ty1,
       CASE WHEN sx < 0 THEN 0 ELSE sx END AS tx0, CASE WHEN sx < 0 THEN least(s, 4512) ELSE sx + s END AS tx1 FROM ctr),
boxed AS (SELECT *, CASE WHEN ty1 > 4512 THEN greatest(0, 4512 - s) ELSE ty0 END AS crop_y0, least(ty1, 4512) AS crop_y1,
       CASE WHEN tx1 > 4512 THEN greatest(0, 4512 - s) ELSE tx0 END AS crop_x0, least(tx1, 4512) AS crop_x1 FROM sh)"""


CAND = f"""WITH RECURSIVE {REACH8}, {PEAK},
grp AS (SELECT g.frame_id, g.region, COUNT(*) AS region_size_points, AVG(g.score) AS mean_val, MIN(g.r) AS r_min, MAX(g.r) AS r_max,
        MIN(g.c) AS c_min, MAX(g.c) AS c_max, MIN(CASE WHEN p.score IS NOT NULL THEN g.lin END) AS peak_order,
        MIN_BY(p.score, g.lin) FILTER (WHERE p.score IS NOT NULL) AS peak_val
        FROM reg g LEFT JOIN peaks p ON p.frame_id = g.frame_id AND p.r = g.r AND p.c = g.c
        GROUP BY g.frame_id, g.region HAVING COUNT(p.score) > 0 AND COUNT(*) >= 4),
{square_sql(20, 'grp')}"""

NMS_SQL = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY peak_val DESC, peak_order) AS k FROM boxed),
walk AS (SELECT frame_id, 0 AS k, []::STRUCT(y0 BIGINT, x0 BIGINT, y1 BIGINT, x1 BIGINT, k BIGINT)[] AS acc FROM (SELECT DISTINCT frame_id FROM ranked)
  UNION ALL
  SELECT w.frame_id, w.k + 1, CASE WHEN len(list_filter(w.acc, lambda q:
        least(q.y1, r.crop_y1) > greatest(q.y0, r.crop_y0) AND least(q.x1, r.crop_x1) > greatest(q.x0, r.crop_x0) AND
        CAST((least(q.y1, r.crop_y1) - greatest(q.y0, r.crop_y0)) * (least(q.x1, r.crop_x1) - greatest(q.x0, r.crop_x0)) AS DOUBLE) /
        ((q.y1 - q.y0) * (q.x1 - q.x0) + (r.crop_y1 - r.crop_y0) * (r.crop_x1 - r.crop_x0)
         - (least(q.y1, r.crop_y1) - greatest(q.y0, r.crop_y0)) * (least(q.x1, r.crop_x1) - greatest(q.x0, r.crop_x0))) > {iou})) > 0
      THEN w.acc ELSE list_append(w.acc, {{'y0': r.crop_y0, 'x0': r.crop_x0, 'y1': r.crop_y1, 'x1': r.crop_x1, 'k': r.k}}) END
  FROM walk w JOIN ranked r ON r.frame_id = w.frame_id AND r.k = w.k + 1 WHERE w.k < {cap}),
kept AS (SELECT r.* FROM ranked r WHERE (r.frame_id, r.k) IN (
  SELECT (frame_id, u.k) FROM (SELECT frame_id, unnest(acc) AS u FROM walk w WHERE w.k = (SELECT MAX(k) FROM walk z WHERE z.frame_id = w.frame_id))))"""


def _mean_val():
    """Means of few decimals often end in an exact half; a nudge makes both engines round it the same way."""
    return F.round(F.col("mean_val") + 1e-10, 6)


def _cells(t: Tables) -> DataFrame:
    return G.patch_map(t.v_tile_score, **MAP)


@query("FLAG_detect", CAND + NMS_SQL.format(iou=0.3, cap=5) + """
SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY peak_val DESC, peak_order) - 1 AS crop_id,
       crop_y0, crop_x0, crop_y1, crop_x1, region_size_points, round(peak_val, 6) AS peak_val, round(mean_val + 1e-10, 6) AS mean_val,
       region_size_points * 282.0::DOUBLE * 282 AS region_size_pixels,
       round(region_size_points * 282.0::DOUBLE * 282 * (91.0::DOUBLE / 4512) * (91.0::DOUBLE / 4512), 4) AS region_size_mm2 FROM kept""")
def detect(t: Tables) -> DataFrame:
    found = G.detect(t.v_tile_score, **MAP, **CUT, upscale=UP)
    return found.withColumns({"peak_val": F.round("peak_val", 6), "mean_val": _mean_val(), "region_size_mm2": F.round("region_size_mm2", 4)})


@query("G1_tile_grid", """
WITH frames AS (SELECT DISTINCT frame_id FROM v_tile_score),
modes AS (SELECT * FROM (VALUES ('live', 0, 0), ('live', 1, 56), ('live', 2, 112), ('live', 3, 169), ('live', 4, 225),
  ('train', 0, 0), ('train', 1, 56), ('train', 2, 113), ('train', 3, 169), ('train', 4, 226),
  ('unlabeled', 0, 0), ('unlabeled', 1, 56), ('unlabeled', 2, 112), ('unlabeled', 3, 169), ('unlabeled', 4, 225)) m(mode, oi, px))
SELECT mode, frame_id, oi AS offset_row, CAST(round(gr + oi * 0.2, 6) AS DOUBLE) AS tile_row, CAST(round(gc + oi * 0.2, 6) AS DOUBLE) AS tile_col,
       px + gr * 282 AS y0, px + gc * 282 AS x0, least(px + gr * 282 + 282, 4512) AS y1, least(px + gc * 282 + 282, 4512) AS x1
FROM frames, modes, range(16) a(gr), range(16) b(gc)
WHERE mode = 'live' OR (px + gr * 282 + 282 <= 4512 AND px + gc * 282 + 282 <= 4512)""")
def tile_grid(t: Tables) -> DataFrame:
    frames = t.v_tile_score.select("frame_id").distinct()
    out = None
    for mode in ("live", "train", "unlabeled"):
        g = G.tile_grid(frames, mode).select(
            F.lit(mode).alias("mode"), "frame_id", "offset_row", F.round("tile_row", 6).alias("tile_row"), F.round("tile_col", 6).alias("tile_col"),
            "y0", "x0", "y1", "x1")
        out = g if out is None else out.unionByName(g)
    return out


@query("G2_full_offset_grid", """
WITH frames AS (SELECT DISTINCT frame_id FROM v_tile_score), o AS (SELECT * FROM (VALUES (0, 0), (1, 56), (2, 112), (3, 169), (4, 225)) o(i, px)),
full_grid AS (SELECT frame_id, count(*) AS tiles, sum((a.px + gr * 282) * 4512 + b.px + gc * 282) AS corner_sum,
  count(*) FILTER (WHERE a.px + gr * 282 + 282 > 4512 OR b.px + gc * 282 + 282 > 4512) AS over_edge
  FROM frames, o a, o b, range(16) r(gr), range(16) c(gc) GROUP BY frame_id),
sized AS (SELECT p_partkey, 500 + p_partkey % 700 AS h, 300 + p_size * 17 AS w FROM part)
SELECT 'offsets' AS kind, frame_id AS id, tiles, CAST(corner_sum AS BIGINT) AS corner_sum, over_edge FROM full_grid
UNION ALL
SELECT 'centred', p_partkey, count(*), CAST(sum(((h - (h // 282) * 282) // 2 + r * 282) * 4512 + (w - (w // 282) * 282) // 2 + c * 282) AS BIGINT), 0
FROM (SELECT *, unnest(range(h // 282)) AS r FROM sized) q, range(10) cc(c) WHERE c < w // 282 GROUP BY p_partkey""")
def full_offset_grid(t: Tables) -> DataFrame:
    frames = t.v_tile_score.select("frame_id").distinct()
    corner = F.sum(F.col("y0").cast("long") * 4512 + F.col("x0")).alias("corner_sum")
    full = G.tile_grid(frames, both_axes=True).groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("tiles"), corner, F.count_if((F.col("y0") + 282 > 4512) | (F.col("x0") + 282 > 4512)).alias("over_edge"))
    sized = t.part.select("p_partkey", (500 + F.col("p_partkey") % 700).alias("h"), (300 + F.col("p_size") * 17).alias("w"))
    split = G.centred_split(sized, "h", "w", 282).groupBy("p_partkey").agg(
        F.count(F.lit(1)).alias("tiles"), corner, F.lit(0).cast("long").alias("over_edge"))
    return full.select(F.lit("offsets").alias("kind"), F.col("frame_id").alias("id"), "tiles", "corner_sum", "over_edge").unionByName(
        split.select(F.lit("centred").alias("kind"), F.col("p_partkey").alias("id"), "tiles", "corner_sum", "over_edge"))


@query("G3_patch_map", """
WITH frames AS (SELECT DISTINCT frame_id FROM v_tile_score)
SELECT f.frame_id, y.r, x.c, round(coalesce(m.score, 0), 6) AS score, coalesce(m.coverage, 0) AS coverage
FROM frames f CROSS JOIN range(16) y(r) CROSS JOIN range(16) x(c) LEFT JOIN v_map m ON m.frame_id = f.frame_id AND m.r = y.r AND m.c = x.c""")
def patch_map(t: Tables) -> DataFrame:
    return _cells(t).withColumn("score", F.round("score", 6))


@query("G4_local_maxima", f"WITH {PEAK} SELECT frame_id, r, c, round(score, 6) AS score FROM peaks")
def local_maxima(t: Tables) -> DataFrame:
    return G.local_maxima(_cells(t), CUT["peak"]).withColumn("score", F.round("score", 6))


@query("G5_regions", f"WITH RECURSIVE {REACH8} SELECT frame_id, r, c, region FROM reg")
def regions(t: Tables) -> DataFrame:
    return G.regions(_cells(t), CUT["secondary"]).select("frame_id", "r", "c", "region")


@query("G5_regions_tall", """
WITH m AS (SELECT DISTINCT l_suppkey AS frame_id, l_partkey % 900 AS r FROM lineitem),
i AS (SELECT frame_id, r, r - row_number() OVER (PARTITION BY frame_id ORDER BY r) AS island FROM m)
SELECT frame_id, r, min(r) OVER (PARTITION BY frame_id, island) * 4294967296 + 3 AS region FROM i""")
def regions_tall(t: Tables) -> DataFrame:
    """One column of cells per supplier, 900 rows high: components run over the borders of row bands."""
    cells = t.lineitem.select(F.col("l_suppkey").alias("frame_id"), (F.col("l_partkey") % 900).alias("r"), F.lit(3).alias("c"), F.lit(1.0).alias("score")).distinct()
    return G.regions(cells, 0.5).select("frame_id", "r", "region")


BOX_OUT = "crop_y0, crop_x0, crop_y1, crop_x1, region_size_points, round(mean_val + 1e-10, 6) AS mean_val, round(peak_val, 6) AS peak_val"


def _box_out(df: DataFrame) -> DataFrame:
    return df.select("frame_id", "peak_order", "crop_y0", "crop_x0", "crop_y1", "crop_x1", "region_size_points",
                     _mean_val().alias("mean_val"), F.round("peak_val", 6).alias("peak_val"))


@query("G6_candidates", CAND + f" SELECT frame_id, peak_order, {BOX_OUT} FROM boxed")
def candidates(t: Tables) -> DataFrame:
    return _box_out(G.candidates(_cells(t), **CUT, upscale=UP))


@query("G6b_candidates_per_peak", f"""WITH RECURSIVE {REACH8}, {PEAKS.format(peak=0.4)},
stat AS (SELECT frame_id, region, COUNT(*) AS region_size_points, AVG(score) AS mean_val, MIN(r) AS r_min, MAX(r) AS r_max,
         MIN(c) AS c_min, MAX(c) AS c_max FROM reg GROUP BY frame_id, region HAVING COUNT(*) >= 4 AND AVG(score) >= 0.55),
grp AS (SELECT s.*, g.lin AS peak_order, p.score AS peak_val FROM peaks p JOIN reg g ON g.frame_id = p.frame_id AND g.r = p.r AND g.c = p.c
        JOIN stat s ON s.frame_id = g.frame_id AND s.region = g.region),
{square_sql(10, 'grp')}
SELECT frame_id, peak_order, {BOX_OUT} FROM boxed""")
def candidates_per_peak(t: Tables) -> DataFrame:
    return _box_out(G.candidates_per_peak(_cells(t), 0.4, CUT["secondary"], 0.55, upscale=UP))


@query("G7_robust_regions", f"""WITH RECURSIVE {REACH.format(level=0.5, near="abs(a.r - b.r) + abs(a.c - b.c) <= 1")}
SELECT frame_id, region, COUNT(*) AS region_size_points, round(AVG(score) + 1e-10, 6) AS mean_val, COUNT(*) FILTER (WHERE score >= 0.6) AS core_cells
FROM reg GROUP BY frame_id, region
HAVING MAX(score) >= 0.7 AND COUNT(*) >= 9 AND AVG(score) >= 0.55 AND COUNT(*) FILTER (WHERE score >= 0.6) >= 4""")
def robust_regions(t: Tables) -> DataFrame:
    out = G.robust_regions(_cells(t), peak=0.7, secondary=0.5, min_size=9, min_mean=0.55, core=0.6, min_core=4)
    return out.select("frame_id", "region", "region_size_points", _mean_val().alias("mean_val"), "core_cells")


PRED_BOXED = """WITH RECURSIVE boxed AS (SELECT image_id AS frame_id, crop_id AS peak_order, peak AS peak_val, y0 AS crop_y0, x0 AS crop_x0,
  y1 AS crop_y1, x1 AS crop_x1 FROM v_pred)"""


def _pred_boxes(t: Tables) -> DataFrame:
    return t.v_pred.select(F.col("image_id").alias("frame_id"), F.col("crop_id").alias("peak_order"), F.col("peak").alias("peak_val"),
                           *[F.col(c).alias(f"crop_{c}") for c in ("y0", "x0", "y1", "x1")])


@query("G8_nms_capped", PRED_BOXED + NMS_SQL.format(iou=0.3, cap=5) + " SELECT frame_id, peak_order, peak_val FROM kept")
def nms_capped(t: Tables) -> DataFrame:
    return G.nms(_pred_boxes(t), 0.3, 5).select("frame_id", "peak_order", "peak_val")


@query("G8_nms_all", PRED_BOXED + NMS_SQL.format(iou=0.5, cap=1000000) + " SELECT frame_id, peak_order, peak_val FROM kept")
def nms_all(t: Tables) -> DataFrame:
    return G.nms(_pred_boxes(t), 0.5, None).select("frame_id", "peak_order", "peak_val")


PAIRS = """
pairs AS (SELECT p.image_id, p.crop_id AS a_id, m.manual_id AS b_id,
  (least(p.y1, m.y1) - greatest(p.y0, m.y0)) * (least(p.x1, m.x1) - greatest(p.x0, m.x0)) AS inter_px,
  (p.y1 - p.y0) * (p.x1 - p.x0) AS a_area, (m.y1 - m.y0) * (m.x1 - m.x0) AS b_area
  FROM v_pred p JOIN v_manual m ON p.image_id = m.image_id AND p.y0 < m.y1 AND m.y0 < p.y1 AND p.x0 < m.x1 AND m.x0 < p.x1),
hit AS (SELECT * FROM pairs WHERE CAST(inter_px AS DOUBLE) / b_area >= CASE WHEN a_area > b_area THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END
  OR CAST(inter_px AS DOUBLE) / a_area >= CASE WHEN a_area > b_area THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END)"""


@query("J7_box_overlap", f"""WITH {PAIRS} SELECT image_id, a_id, b_id, inter_px, a_area + b_area - inter_px AS union_px,
  round(CAST(inter_px AS DOUBLE) / (a_area + b_area - inter_px), 6) AS iou, round(CAST(inter_px AS DOUBLE) / a_area, 6) AS a_covered,
  round(CAST(inter_px AS DOUBLE) / b_area, 6) AS b_covered FROM pairs""")
def box_overlap(t: Tables) -> DataFrame:
    out = J.box_overlap(t.v_pred, t.v_manual, cell=64)
    return out.select("image_id", "a_id", "b_id", "inter_px", "union_px", *[F.round(c, 6).alias(c) for c in ("iou", "a_covered", "b_covered")])


@query("G9_crops_overlap", f"WITH {PAIRS} SELECT image_id, a_id, b_id FROM hit")
def crops_overlap(t: Tables) -> DataFrame:
    return J.crop_matches(t.v_pred, t.v_manual).select("image_id", "a_id", "b_id")


MATCHED = f"""WITH {PAIRS},
pick AS (SELECT image_id, a_id, MIN(b_id) AS manual_id FROM hit GROUP BY image_id, a_id),
matched AS (SELECT p.image_id, 'predicted' AS source, p.crop_id AS item_id, p.y0, p.x0, p.y1, p.x1, p.peak, k.manual_id IS NOT NULL AS label_manual
  FROM v_pred p LEFT JOIN pick k ON k.image_id = p.image_id AND k.a_id = p.crop_id
  UNION ALL SELECT m.image_id, 'manual', m.manual_id, m.y0, m.x0, m.y1, m.x1, NULL, TRUE FROM v_manual m
  WHERE NOT EXISTS (SELECT 1 FROM pick k WHERE k.image_id = m.image_id AND k.manual_id = m.manual_id))"""


@query("G10_match_crops", MATCHED + " SELECT * FROM matched")
def match_crops(t: Tables) -> DataFrame:
    return G.match_crops(t.v_pred, t.v_manual)


@query("G11_outcome", MATCHED + """ SELECT image_id, source, item_id, CASE WHEN label_manual THEN CASE WHEN peak >= 0.5 THEN 'TP' ELSE 'FN' END
  ELSE CASE WHEN peak >= 0.5 THEN 'FP' ELSE 'TN' END END AS outcome FROM matched""")
def outcome(t: Tables) -> DataFrame:
    return G.match_crops(t.v_pred, t.v_manual).select("image_id", "source", "item_id", G.crop_outcome(threshold=0.5).alias("outcome"))


# manual boxes as a mask: pixels of the union, and groups of touching boxes (8-connected)
PIXELS = """
pix AS (SELECT DISTINCT image_id, y, x FROM (SELECT image_id, x0, x1, unnest(range(y0, y1)) AS y FROM v_manual) q, range(0, 140) xs(x) WHERE x >= x0 AND x < x1)"""
TOUCH = """
shape AS (SELECT DISTINCT image_id, y0, x0, y1, x1, y0 * 4294967296 + x0 AS lin FROM v_manual),
tedge AS (SELECT DISTINCT a.image_id, a.lin AS a, b.lin AS b FROM shape a JOIN shape b ON a.image_id = b.image_id
  AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
treach AS (SELECT image_id, lin AS node, lin AS root FROM shape
  UNION SELECT e.image_id, e.b, x.root FROM treach x JOIN tedge e ON e.image_id = x.image_id AND e.a = x.node),
comp AS (SELECT s.*, t.root FROM shape s JOIN (SELECT image_id, node, MIN(root) AS root FROM treach GROUP BY image_id, node) t
  ON t.image_id = s.image_id AND t.node = s.lin),
area AS (SELECT c.image_id, c.root, COUNT(DISTINCT p.y * 1000 + p.x) AS px FROM comp c JOIN pix p ON p.image_id = c.image_id
  AND p.y >= c.y0 AND p.y < c.y1 AND p.x >= c.x0 AND p.x < c.x1 GROUP BY c.image_id, c.root),
blob AS (SELECT c.image_id, c.root, MIN(c.y0) AS y0, MIN(c.x0) AS x0, MAX(c.y1) AS y1, MAX(c.x1) AS x1, MIN(a.px) AS px
  FROM comp c JOIN area a ON a.image_id = c.image_id AND a.root = c.root GROUP BY c.image_id, c.root)"""
CANVAS = dict(height=140, width=140)


def _runs(t: Tables) -> DataFrame:
    return G.rect_slabs(t.v_manual, ["image_id"])


def _quads(t: Tables, side: int = 35) -> DataFrame:
    """Four by four tiles of the canvas for every image with a mask."""
    span = F.sequence(F.lit(0), F.lit(3))
    rows = t.v_manual.select("image_id").distinct().withColumn("i", F.explode(span)).withColumn("j", F.explode(span))
    return rows.select("image_id", (F.col("i") * 4 + F.col("j")).alias("tile_id"), (F.col("i") * side).alias("y0"), (F.col("j") * side).alias("x0"),
                       (F.col("i") * side + side).alias("y1"), (F.col("j") * side + side).alias("x1"))


QUADS = """
quad AS (SELECT image_id, i * 4 + j AS tile_id, i * 35 AS y0, j * 35 AS x0 FROM (SELECT DISTINCT image_id FROM v_manual) m, range(4) a(i), range(4) b(j)),
filled AS (SELECT image_id, (y // 35) * 4 + x // 35 AS tile_id, COUNT(*) AS px FROM pix GROUP BY ALL)"""


@query("J8_tile_mask_overlap", f"""WITH {PIXELS}, {QUADS}
SELECT q.image_id, q.tile_id, coalesce(px, 0) AS mask_px, round(coalesce(px, 0) / 1225.0::DOUBLE, 6) AS mask_fraction,
       CASE WHEN coalesce(px, 0) > 0 THEN 'obs' ELSE 'no_obs' END AS label, CASE WHEN coalesce(px, 0) / 1225.0::DOUBLE >= 0.1::DOUBLE THEN 'obs' ELSE 'no_obs' END AS label_tenth
FROM quad q LEFT JOIN filled f ON f.image_id = q.image_id AND f.tile_id = q.tile_id""")
def tile_mask_overlap(t: Tables) -> DataFrame:
    out = J.tile_mask_overlap(_quads(t), _runs(t), "image_id", "tile_id", band=70)
    return out.select("image_id", "tile_id", "mask_px", F.round("mask_fraction", 6).alias("mask_fraction"), "label",
                      F.when(F.col("mask_fraction") >= 0.1, "obs").otherwise("no_obs").alias("label_tenth"))


@query("G12_manual_crops", f"""WITH RECURSIVE {PIXELS}, {TOUCH},
pad AS (SELECT *, greatest(0, y0 - 3) AS a, greatest(0, x0 - 3) AS b, least(140, y1 + 3) AS e, least(140, x1 + 3) AS f FROM blob),
sz AS (SELECT *, greatest(e - a, f - b) AS s FROM pad),
st AS (SELECT *, greatest(0, (a + e) // 2 - s // 2) AS ya, greatest(0, (b + f) // 2 - s // 2) AS xa FROM sz),
en AS (SELECT *, least(140, ya + s) AS ye, least(140, xa + s) AS xe FROM st)
SELECT image_id, greatest(0, ye - s) AS crop_y0, greatest(0, xe - s) AS crop_x0, ye AS crop_y1, xe AS crop_x1, px AS region_size_pixels,
       round(px * (91.0::DOUBLE / 4512) * (91.0::DOUBLE / 4512), 6) AS region_size_mm2 FROM en""")
def manual_crops(t: Tables) -> DataFrame:
    out = G.mask_crops(_runs(t), "image_id", padding=3, **CANVAS).drop("region")
    return out.withColumn("region_size_mm2", F.round("region_size_mm2", 6))


@query("G13_manual_scores", """
WITH box AS (SELECT DISTINCT CAST(floor(image_id / CAST(200 AS DOUBLE)) AS BIGINT) AS frame_id, manual_id * 1000000 + image_id AS manual_id, y0, x0, y1, x1 FROM v_manual)
SELECT b.frame_id, b.manual_id, round(MAX(m.score) + 1e-10, 6) AS peak_intensity, round(AVG(m.score) + 1e-10, 6) AS region_mean_intensity
FROM box b JOIN v_map m ON m.frame_id = b.frame_id AND m.r >= floor(b.y0 / 8.5::DOUBLE) AND m.r < floor(b.y1 / 8.5::DOUBLE)
 AND m.c >= floor(b.x0 / 8.5::DOUBLE) AND m.c < floor(b.x1 / 8.5::DOUBLE) GROUP BY b.frame_id, b.manual_id""")
def manual_scores(t: Tables) -> DataFrame:
    boxes = t.v_manual.select(F.floor(F.col("image_id") / 200).alias("frame_id"), (F.col("manual_id") * 1000000 + F.col("image_id")).alias("manual_id"),
                              "y0", "x0", "y1", "x1").distinct()
    out = G.manual_scores(boxes, G.patch_map(t.v_tile_score, fill=False, **MAP), 8.5)
    return out.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in ("peak_intensity", "region_mean_intensity")})


@query("G14_image_mask_summary", f"""WITH {PIXELS}, {QUADS},
cnt AS (SELECT q.image_id, COUNT(f.px) AS tiles_obs, 16 - COUNT(f.px) AS tiles_no_obs FROM quad q LEFT JOIN filled f ON f.image_id = q.image_id AND f.tile_id = q.tile_id GROUP BY q.image_id)
SELECT c.image_id, tiles_obs, tiles_no_obs, MIN(y) AS mask_y0, MIN(x) AS mask_x0, MAX(y) + 1 AS mask_y1, MAX(x) + 1 AS mask_x1, COUNT(*) AS area_px,
       round(COUNT(*) / 19600.0::DOUBLE, 6) AS area_fraction FROM cnt c JOIN pix p ON p.image_id = c.image_id GROUP BY c.image_id, tiles_obs, tiles_no_obs""")
def image_mask_summary(t: Tables) -> DataFrame:
    tiles = J.tile_mask_overlap(_quads(t), _runs(t), "image_id", "tile_id", band=70)
    return G.image_mask_summary(_runs(t), tiles, "image_id", **CANVAS).withColumn("area_fraction", F.round("area_fraction", 6))


@query("G15_blob_metrics", f"""WITH RECURSIVE {PIXELS}, {TOUCH}
SELECT image_id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h, px AS area,
       round(px / ((x1 - x0) * (y1 - y0) + 0.00001::DOUBLE), 6) AS compactness, round(2 * sqrt(px / pi()), 6) AS esd,
       greatest(0, x0 - 5) AS box_x0, greatest(0, y0 - 5) AS box_y0, least(140, x1 + 5) AS box_x1, least(140, y1 + 5) AS box_y1
FROM blob WHERE px >= 200""")
def blob_metrics(t: Tables) -> DataFrame:
    out = G.blob_metrics(_runs(t), "image_id", 200, 5, **CANVAS).drop("crop_no", "region")
    return out.withColumns({c: F.round(c, 6) for c in ("compactness", "esd")})


@query("G16_largest_blob", f"""WITH RECURSIVE {PIXELS}, {TOUCH}
SELECT image_id, MAX(px) AS area, COUNT(*) AS blobs FROM blob WHERE px >= 150 GROUP BY image_id""")
def largest_blob(t: Tables) -> DataFrame:
    return G.largest_blob(_runs(t), "image_id", min_size=150).select("image_id", "area", "blobs")


@query("G17_mark_selected_tiles", """
WITH sel AS (SELECT DISTINCT frame_id AS image_id, r, c FROM v_map WHERE score >= 0.62),
quad AS (SELECT image_id, i * 4 + j AS tile_id, i * 35 AS y0, j * 35 AS x0 FROM (SELECT DISTINCT frame_id AS image_id FROM v_tile_score) m, range(4) a(i), range(4) b(j))
SELECT q.image_id, q.tile_id, COUNT(s.r) AS selected_cells, CASE WHEN COUNT(s.r) > 0 THEN 'obs' ELSE 'no_obs' END AS label
FROM quad q LEFT JOIN sel s ON s.image_id = q.image_id AND s.r * 9 < q.y0 + 35 AND s.r * 9 + 9 > q.y0 AND s.c * 9 < q.x0 + 35 AND s.c * 9 + 9 > q.x0
GROUP BY q.image_id, q.tile_id""")
def mark_selected_tiles(t: Tables) -> DataFrame:
    span = F.sequence(F.lit(0), F.lit(3))
    rows = t.v_tile_score.select(F.col("frame_id").alias("image_id")).distinct().withColumn("i", F.explode(span)).withColumn("j", F.explode(span))
    tiles = rows.select("image_id", (F.col("i") * 4 + F.col("j")).alias("tile_id"), (F.col("i") * 35).alias("y0"), (F.col("j") * 35).alias("x0"),
                        (F.col("i") * 35 + 35).alias("y1"), (F.col("j") * 35 + 35).alias("x1"))
    chosen = _cells(t).filter(F.col("score") >= 0.62).withColumnRenamed("frame_id", "image_id")
    return G.mark_selected_tiles(tiles, chosen, "image_id", 9, "tile_id").select("image_id", "tile_id", "selected_cells", "label")


@query("G17_expand_index_list", """
SELECT o_orderkey, a + k AS index FROM (SELECT o_orderkey, o_custkey % 50 AS a, o_custkey % 50 + o_orderkey % 6 AS b FROM orders), range(6) t(k) WHERE a + k <= b
UNION ALL SELECT o_orderkey, 77 FROM orders""")
def expand_index_list(t: Tables) -> DataFrame:
    a = (F.col("o_custkey") % 50).cast("string")
    b = (F.col("o_custkey") % 50 + F.col("o_orderkey") % 6).cast("string")
    text = F.concat(a, F.lit("-"), b, F.lit(", 77 ,x,"))
    return G.expand_index_list(t.orders.select("o_orderkey", text.alias("picked")), "picked").select("o_orderkey", "index")


@query("P16_scale_boxes", """SELECT image_id, crop_id, CAST(floor(y0 * 0.37::DOUBLE) AS INT) AS y0, CAST(floor(x0 * 0.37::DOUBLE) AS INT) AS x0,
  CAST(floor(y1 * 0.37::DOUBLE) AS INT) AS y1, CAST(floor(x1 * 0.37::DOUBLE) AS INT) AS x1 FROM v_pred""")
def scale_boxes(t: Tables) -> DataFrame:
    return C.scale_boxes(t.v_pred.select("image_id", "crop_id", "y0", "x0", "y1", "x1"), 0.37)
