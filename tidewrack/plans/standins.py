"""Station-shaped views over the given tables.

The tables hold no images or telemetry, so each input shape is derived from
them by SQL that reads the same in Spark and in an ANSI engine. Every view
covers its whole source table. Text views build names and sensor lines from
table columns, broken ones included.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidewrack.session import prepare, read_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    # one row per telemetry sample
    "v_telemetry": """
SELECT event_id AS sample_id, user_id % 8 AS device_id, ts,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE 20 + CAST(event_id * 7 % 100 AS DOUBLE) / 10 END AS temp_c,
       30 + CAST(event_id * 13 % 500 AS DOUBLE) / 10 AS humidity_pct,
       980 + CAST(event_id * 29 % 700 AS DOUBLE) / 10 AS pressure_mbar,
       value AS depth_m,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_type = 'error' END AS leak
FROM events""",
    # age of a stage's heartbeat at each read
    "v_heartbeat": "SELECT event_id, event_type AS stage, ts, (event_id * 31 % 60) AS age_s FROM events",
    # crops seen, with the class a classifier gave them
    "v_crop_event": """
SELECT event_id AS crop_id, user_id % 8 AS station, ts, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END AS class_label,
       CAST(event_id * 37 % 100 AS DOUBLE) / 100 AS class_confidence, CAST(event_id * 11 % 900 AS DOUBLE) / 10 AS region_size_mm2
FROM events""",
    # evaluation scores: plenty of ties on purpose
    "v_scores": """
SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS row_id, l_orderkey AS image_id, l_linenumber,
       l_shipdate, l_linestatus AS site, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       (floor(l_quantity) * 2 + l_partkey % 5) / CAST(100 AS DOUBLE) AS score
FROM lineitem""",
    # predicted and manual boxes on a 128 px canvas, several per image
    "v_pred": """
SELECT l_orderkey AS image_id, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS crop_id,
       CAST(l_partkey * 37 % 80 AS BIGINT) AS y0, CAST(l_suppkey * 53 % 80 AS BIGINT) AS x0,
       CAST(l_partkey * 37 % 80 + 8 + CAST(floor(l_quantity) AS BIGINT) % 40 AS BIGINT) AS y1,
       CAST(l_suppkey * 53 % 80 + 8 + CAST(floor(l_quantity) AS BIGINT) % 40 AS BIGINT) AS x1,
       CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS peak
FROM lineitem""",
    "v_manual": """
SELECT image_id, crop_id AS manual_id, y0 + 3 AS y0, x0 + 2 AS x0, y1 + 1 AS y1, x1 + 4 AS x1
FROM v_pred WHERE (image_id + crop_id) % 3 = 0""",
    # tile scores on an 8x8 grid with 2 offsets (0, 0.5): a map of 16x16 cells per frame
    "v_tile_score": """
SELECT CAST(floor(l_orderkey / CAST(200 AS DOUBLE)) AS BIGINT) AS frame_id, l_partkey % 8 AS grid_row, l_suppkey % 8 AS grid_col,
       l_linenumber % 2 AS offset_idx, l_partkey % 8 + CAST(l_linenumber % 2 AS DOUBLE) / 2 AS tile_row,
       l_suppkey % 8 + CAST(l_linenumber % 2 AS DOUBLE) / 2 AS tile_col, round(AVG(l_discount) * 10, 9) AS score
FROM lineitem
GROUP BY CAST(floor(l_orderkey / CAST(200 AS DOUBLE)) AS BIGINT), l_partkey % 8, l_suppkey % 8, l_linenumber % 2""",
    # the score map of each frame (mean of the tiles over each cell)
    "v_map": """
SELECT frame_id, r, c, SUM(unit) / CAST(COUNT(*) AS DOUBLE) / 1000000000 AS score, COUNT(*) AS coverage
FROM (SELECT frame_id, CAST(grid_row * 2 + offset_idx + dy AS BIGINT) AS r, CAST(grid_col * 2 + offset_idx + dx AS BIGINT) AS c,
             CAST(round(score * 1000000000) AS BIGINT) AS unit
      FROM v_tile_score CROSS JOIN (SELECT 0 AS dy UNION ALL SELECT 1) ys CROSS JOIN (SELECT 0 AS dx UNION ALL SELECT 1) xs) parts
WHERE r < 16 AND c < 16 GROUP BY frame_id, r, c""",
    # multi-class predictions
    "v_pred_class": """
SELECT o_orderkey, o_orderpriority AS true_label,
       CASE WHEN o_custkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS pred_label,
       CAST(o_custkey % 100 AS DOUBLE) / 100 AS confidence
FROM orders""",
    # frames as vectors, in order, label = site
    "v_frame": "SELECT vec_id AS frame_id, label AS site, embedding AS px FROM embeddings",
    # files and the sidecars that exist for them
    "v_file": """
SELECT doc_id, source, lang AS folder, source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.png' AS path,
       CAST(doc_id AS STRING) || '.png' AS name, n_chars AS bytes
FROM documents""",
    "v_sidecar": "SELECT doc_id, quality, toxic FROM labels",
    # queue items
    "v_queue_item": """
SELECT o_orderkey AS stem, CASE o_orderstatus WHEN 'O' THEN 'incoming' WHEN 'P' THEN 'processing' ELSE 'failed' END AS state,
       o_orderdate AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_custkey % 55 AS upload_attempts,
       o_orderkey % 11 <> 0 AS has_image, o_orderkey % 13 <> 0 AS has_json
FROM orders""",
    # config snapshots (key, value) over turns
    "v_config": """
SELECT conv_id AS station, CAST(floor(turn / CAST(2 AS DOUBLE)) AS BIGINT) AS snapshot_no, role AS k, CAST(length(text) % 5 AS STRING) AS v FROM conversations""",
    # sensor lines, some with a missing key, a bad number or a repeated key
    "v_line": """
SELECT event_id,
       'p:' || CAST(90000 + event_id * 37 % 20000 AS STRING) || '.5,h:' || CAST(event_id * 13 % 100 AS STRING) || '.25'
       || CASE WHEN event_id % 11 = 0 THEN '' ELSE ',b:2' || CAST(event_id % 10 AS STRING) || '.5' END
       || ',P:1' || CAST(event_id * 7 % 100 + 100 AS STRING) || '.0,d:' || CASE WHEN event_id % 13 = 0 THEN '1x' ELSE '1.5' END
       || ',T:18.5,l:' || CAST(event_id % 2 AS STRING) || ',t:17.75'
       || CASE WHEN event_id % 7 = 0 THEN ',h: 42.5' ELSE '' END
       || CASE WHEN event_id % 5 = 0 THEN ',noise' ELSE '' END AS line
FROM events""",
    # capture stems and crop file names built from event times
    "v_stem": """
SELECT event_id, ts, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS STRING) AS ymd,
       lpad(CAST(hour(ts) * 10000 + minute(ts) * 100 + CAST(floor(second(ts)) AS INT) AS STRING), 6, '0') AS hms,
       CASE event_id % 4 WHEN 3 THEN 'img_' ELSE 'frame_' END
       || CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS STRING) || '_'
       || lpad(CAST(hour(ts) * 10000 + minute(ts) * 100 + CAST(floor(second(ts)) AS INT) AS STRING), 6, '0') || '_'
       || lpad(CAST(event_id AS STRING), 8, '0') AS frame_stem,
       event_id % 4 AS kind, event_id * 7 % 300 AS whole, event_id % 100 AS cents, event_type AS species
FROM events""",
    "v_name": """
SELECT event_id, ts, ymd, hms, frame_stem, kind, whole, cents, species,
       frame_stem || CASE kind WHEN 3 THEN '_' || species WHEN 2 THEN ''
                     ELSE '_crop_' || lpad(CAST(event_id % 5 AS STRING), 3, '0') || '_area_' || CAST(whole AS STRING)
                          || CASE WHEN kind = 1 THEN '.' || lpad(CAST(cents AS STRING), 2, '0') ELSE '' END END || '.png' AS name
FROM v_stem""",
    "v_tile_name": """
SELECT p_partkey, 'img_' || lpad(CAST(p_partkey AS STRING), 6, '0')
       || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '_r' || CAST(p_partkey % 16 AS STRING) || '_c' || CAST(p_size % 16 AS STRING)
       || '_o' || CAST(p_partkey % 5 * 20 AS STRING) END || '.png' AS name
FROM part""",
}

# the session's own views keep their names: ours carry a prefix
_SOURCE = re.compile(r"\bFROM (\w+)")
_NEEDS = re.compile(r"\bv_[a-z_]+\b")


def needed(sql: str) -> list[str]:
    """Views a query reads, in definition order, nested ones included."""
    found: set[str] = set()
    todo = set(_NEEDS.findall(sql)) & VIEWS.keys()
    while todo:
        name = todo.pop()
        found.add(name)
        todo |= (set(_NEEDS.findall(VIEWS[name])) & VIEWS.keys()) - found
    return [n for n in VIEWS if n in found]


class Tables:
    """The given tables and the derived views of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder
        self._ready: set[str] = set()

    def _register(self, name: str) -> None:
        if name in self._ready:
            return
        if name in VIEWS:
            for table in TABLES:
                if re.search(rf"\b{table}\b", VIEWS[name]):
                    self._register(table)
            for view in needed(VIEWS[name]):
                self._register(view)
            self.spark.sql(_SOURCE.sub(r"FROM tidewrack_\1", VIEWS[name])).createOrReplaceTempView(f"tidewrack_{name}")
        else:
            read_table(self.spark, self.folder, name).createOrReplaceTempView(f"tidewrack_{name}")
        self._ready.add(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        self._register(name)
        return self.spark.table(f"tidewrack_{name}")
