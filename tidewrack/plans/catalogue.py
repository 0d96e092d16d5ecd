"""Queries on the catalogue: metadata joins, pairing, plans, upserts, renames and counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators import joins as J
from tidewrack.operators import rollups as R
from tidewrack.operators import upkeep as U
from tidewrack.plans.registry import query
from tidewrack.plans.standins import Tables


@query("J1_attach_metadata", """
SELECT f.source, f.doc_id, s.quality, s.toxic, CASE WHEN s.doc_id IS NULL THEN TRUE END AS metadata_missing FROM v_file f LEFT JOIN v_sidecar s ON s.doc_id = f.doc_id""")
def attach_metadata(t: Tables) -> DataFrame:
    return J.attach_metadata(t.v_file, t.v_sidecar, ["doc_id"]).select("source", "doc_id", "quality", "toxic", "metadata_missing")


@query("J1_missing_per_source", """
SELECT f.source, COUNT(*) FILTER (WHERE s.doc_id IS NULL) AS missing FROM v_file f LEFT JOIN v_sidecar s ON s.doc_id = f.doc_id GROUP BY f.source""")
def missing_per_source(t: Tables) -> DataFrame:
    return J.attach_metadata(t.v_file, t.v_sidecar, ["doc_id"]).groupBy("source").agg(F.count_if(F.coalesce("metadata_missing", F.lit(False))).alias("missing"))


@query("J2_new_only", """
SELECT doc_id, path FROM v_file f WHERE NOT EXISTS (SELECT 1 FROM v_sidecar s WHERE s.doc_id = f.doc_id) AND NOT EXISTS (SELECT 1 FROM v_frame g WHERE g.frame_id = f.doc_id)""")
def new_only(t: Tables) -> DataFrame:
    seen = [t.v_sidecar, t.v_frame.select(F.col("frame_id").alias("doc_id"))]
    return J.new_only(t.v_file, seen, ["doc_id"]).select("doc_id", "path")


NOW_US = 996_624_000_000_000  # 2001-08-01T00:00:00Z, the newest item


@query("J3_pair_items", f"""
SELECT stem, CASE WHEN has_image AND has_json THEN 'complete' WHEN {NOW_US} - epoch_us(mtime) > 8640000000000 THEN 'failed' ELSE 'waiting' END AS outcome,
  CASE WHEN NOT has_image THEN 'image' WHEN NOT has_json THEN 'json' END AS missing FROM v_queue_item WHERE has_image OR has_json""")
def pair_items(t: Tables) -> DataFrame:
    q = t.v_queue_item
    return J.pair_items(q.filter("has_image"), q.filter("has_json"), NOW_US, grace_s=100 * 86_400)


@query("J4_find_originals", """
SELECT i.doc_id, MIN(c.class_label) AS species FROM v_crop_event c JOIN v_file i ON i.doc_id = c.crop_id // 10 WHERE i.folder = 'en' GROUP BY i.doc_id""")
def find_originals(t: Tables) -> DataFrame:
    crops = t.v_crop_event.select(F.concat(F.lit("img_"), F.floor(F.col("crop_id") / 10), F.lit("_crop_00123")).alias("stem"), F.col("class_label").alias("species"))
    originals = t.v_file.filter("folder = 'en'").select("doc_id", F.concat(F.lit("img_"), F.col("doc_id")).alias("original"))
    found = J.find_originals(crops, originals)
    return found.join(originals, "original").select("doc_id", "species")


@query("J5_transfer_plan", """
WITH remote AS (SELECT path, CASE WHEN doc_id % 10 = 0 THEN bytes + 1 ELSE bytes END AS bytes FROM v_file WHERE folder IN ('en', 'fr'))
SELECT f.source, COUNT(*) AS files, CAST(SUM(f.bytes) AS BIGINT) AS bytes, COUNT(*) FILTER (WHERE r.path IS NULL) AS missing, COUNT(*) FILTER (WHERE r.path IS NOT NULL) AS changed
FROM v_file f LEFT JOIN remote r ON r.path = f.path WHERE r.path IS NULL OR r.bytes <> f.bytes GROUP BY f.source""")
def transfer_plan(t: Tables) -> DataFrame:
    remote = t.v_file.filter("folder IN ('en', 'fr')").select("path", F.when(F.col("doc_id") % 10 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"))
    return J.transfer_plan(t.v_file, remote).groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("reason") == "missing").alias("missing"), F.count_if(F.col("reason") == "size").alias("changed"))


@query("J9_label_progress", """
WITH a AS (SELECT source, COUNT(*) AS n FROM v_file GROUP BY 1), b AS (SELECT f.source, COUNT(*) AS n FROM v_file f JOIN v_sidecar s ON s.doc_id = f.doc_id WHERE s.quality = 1 GROUP BY 1)
SELECT a.source, a.n AS total, coalesce(b.n, 0) AS labelled, greatest(a.n - coalesce(b.n, 0), 0) AS remaining FROM a LEFT JOIN b ON b.source = a.source""")
def label_progress(t: Tables) -> DataFrame:
    done = t.v_file.join(t.v_sidecar.filter("quality = 1"), "doc_id")
    return J.label_progress(t.v_file, done, "source")


@query("J10_background_for_tile", """
WITH p AS (SELECT frame_id, site, unnest(px) AS v, generate_subscripts(px, 1) - 1 AS i FROM v_frame), b AS (SELECT site, i, MAX(v) AS bg FROM p WHERE site < 6 GROUP BY site, i)
SELECT p.frame_id, p.i, round(CAST(CASE WHEN b.bg IS NULL THEN p.v ELSE p.v - b.bg END AS DOUBLE), 5) AS v FROM p LEFT JOIN b ON b.site = p.site AND b.i = p.i""")
def background_for_tile(t: Tables) -> DataFrame:
    px = t.v_frame.select("site", F.posexplode("px").alias("i", "v"))
    bg = px.filter("site < 6").groupBy("site", "i").agg(F.max("v").alias("v")).groupBy("site").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("bg"))
    out = J.background_for_tile(t.v_frame, bg, ["site"])
    return out.select("frame_id", F.posexplode("px").alias("i", "v")).withColumn("v", F.round(F.col("v").cast("double"), 5))


@query("A5_folder_counts", "SELECT source, folder, COUNT(*) AS files FROM v_file GROUP BY ROLLUP (source, folder)")
def folder_counts(t: Tables) -> DataFrame:
    return R.folder_counts(t.v_file, "source", "folder")


@query("A13_catalogue_summary", """
SELECT f.source, COUNT(*) AS total, COUNT(*) FILTER (WHERE s.doc_id IS NULL) AS missing, MIN(bytes) AS first_date, MAX(bytes) AS last_date
FROM v_file f LEFT JOIN v_sidecar s ON s.doc_id = f.doc_id GROUP BY ROLLUP (f.source)""")
def catalogue_summary(t: Tables) -> DataFrame:
    items = J.attach_metadata(t.v_file, t.v_sidecar, ["doc_id"]).withColumnRenamed("bytes", "date")
    return R.catalogue_summary(items)


@query("S6_invalid_files", "SELECT path FROM v_file EXCEPT SELECT path FROM v_file f JOIN v_sidecar s ON s.doc_id = f.doc_id WHERE s.quality = 1")
def invalid_files(t: Tables) -> DataFrame:
    return U.invalid_files(t.v_file, t.v_file.join(t.v_sidecar.filter("quality = 1"), "doc_id"))


@query("U1_replace_by_key", """
SELECT image_id, crop_id, peak, NULL AS label FROM v_pred WHERE image_id NOT IN (SELECT image_id FROM v_manual WHERE y0 > 60)
UNION ALL SELECT image_id, manual_id, NULL, 'manual' FROM v_manual WHERE y0 > 60""")
def replace_by_key(t: Tables) -> DataFrame:
    new = t.v_manual.filter("y0 > 60").select("image_id", F.col("manual_id").alias("crop_id"), F.lit("manual").alias("label"))
    return U.replace_by_key(t.v_pred.select("image_id", "crop_id", "peak"), new, ["image_id"])


@query("U2_append_log", "SELECT event_id, stage, age_s, NULL AS depth_m FROM v_heartbeat UNION ALL SELECT sample_id, NULL, NULL, depth_m FROM v_telemetry")
def append_log(t: Tables) -> DataFrame:
    return U.append_log(t.v_heartbeat.drop("ts"), t.v_telemetry.select(F.col("sample_id").alias("event_id"), "depth_m"))


@query("U3_rename_source", """
SELECT doc_id, CASE WHEN path LIKE 'src1/%' THEN 'src4' || substr(path, 5) ELSE path END AS path, CASE WHEN path LIKE 'src1/%' THEN 'fjord' ELSE source END AS source
FROM v_file WHERE path NOT LIKE 'src4/%'""")
def rename_source(t: Tables) -> DataFrame:
    return U.rename_source(t.v_file, "src1/", "src4", "fjord").select("doc_id", "path", "source")


@query("U3_rename_source_counts", "SELECT COUNT(*) FILTER (WHERE path LIKE 'src1/%') AS to_move, COUNT(*) FILTER (WHERE path LIKE 'src4/%') AS to_delete FROM v_file")
def rename_source_counts(t: Tables) -> DataFrame:
    return U.rename_source_counts(t.v_file, "src1", "src4")


@query("U4_backfill_source", """
SELECT doc_id, CASE WHEN folder = 'de' AND path LIKE 'src2%' THEN 'baltic' WHEN folder = 'de' THEN NULL ELSE source END AS source FROM v_file""")
def backfill_source(t: Tables) -> DataFrame:
    blank = t.v_file.withColumn("source", F.when(F.col("folder") != "de", F.col("source")))
    return U.backfill_source(blank, "src2", "baltic").select("doc_id", "source")


@query("U5_route_by_date", """
WITH d AS (SELECT crop_id, coalesce(class_label, 'none') || '.png' AS name, row_number() OVER (PARTITION BY coalesce(class_label, 'none') ORDER BY crop_id) AS n FROM v_crop_event
  WHERE date_trunc('day', ts) = DATE '2024-01-15')
SELECT crop_id, CASE WHEN n = 1 THEN name ELSE replace(name, '.png', '') || '_' || CAST(n - 1 AS STRING) || '.png' END AS target FROM d""")
def route_by_date(t: Tables) -> DataFrame:
    files = t.v_crop_event.withColumn("name", F.concat(F.coalesce("class_label", F.lit("none")), F.lit(".png")))
    return U.route_by_date(files, "ts", "2024-01-15", "name", "crop_id").select("crop_id", "target")


@query("U6_materialise_labels", """
SELECT f.name, f.folder || '/' || f.name AS target FROM v_file f WHERE f.folder <> 'de' AND NOT EXISTS (SELECT 1 FROM v_sidecar s WHERE s.doc_id = f.doc_id)""")
def materialise_labels(t: Tables) -> DataFrame:
    labels = t.v_file.select("name", F.when(F.col("folder") != "de", F.col("folder")).alias("label"))
    there = t.v_sidecar.select(F.concat(F.col("doc_id"), F.lit(".png")).alias("name"))
    return U.materialise_labels(labels, there, "label", "name").select("name", "target")


@query("U7_move_overflow", """
SELECT stem, bytes FROM (SELECT stem, bytes, row_number() OVER (ORDER BY mtime DESC, stem DESC) AS n FROM v_queue_item WHERE state = 'incoming' AND has_image AND has_json) q WHERE n > 100""")
def move_overflow(t: Tables) -> DataFrame:
    return U.move_overflow(t.v_queue_item, 100).select("stem", "bytes")


@query("U8_set_operations", """
SELECT 'only_files' AS part, doc_id FROM (SELECT doc_id FROM v_file EXCEPT SELECT doc_id FROM v_sidecar) a
UNION ALL SELECT 'in_both', doc_id FROM (SELECT doc_id FROM v_sidecar INTERSECT SELECT frame_id FROM v_frame) b""")
def set_operations(t: Tables) -> DataFrame:
    a = U.set_difference(t.v_file.select("doc_id"), t.v_sidecar.select("doc_id"))
    b = U.set_intersection(t.v_sidecar.select("doc_id"), t.v_frame.select(F.col("frame_id").alias("doc_id")))
    return a.select(F.lit("only_files").alias("part"), "doc_id").unionByName(b.select(F.lit("in_both").alias("part"), "doc_id"))
