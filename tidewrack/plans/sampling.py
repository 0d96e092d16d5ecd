"""Queries on top lists, evenly spaced picks, splits and balanced samples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators import sampling as P
from tidewrack.operators.grids import crop_outcome
from tidewrack.operators.ordering import with_scalars
from tidewrack.plans.registry import query
from tidewrack.plans.standins import Tables


@query("T1_recent_crops", """
WITH top AS (SELECT event_id, ymd, name FROM v_name WHERE kind IN (0, 1) ORDER BY ymd DESC, name DESC LIMIT 200)
SELECT t.ymd AS date, t.name, e.class_label FROM top t JOIN v_crop_event e ON e.crop_id = t.event_id WHERE e.class_label IS NOT NULL""")
def recent_crops(t: Tables) -> DataFrame:
    files = t.v_name.select(F.col("ymd").alias("date"), "name")
    side = t.v_name.join(t.v_crop_event.filter("class_label IS NOT NULL").select(F.col("crop_id").alias("event_id"), "class_label"), "event_id")
    return P.recent_crops(files, side.select(F.col("ymd").alias("date"), "name", "class_label"), 200).select("date", "name", "class_label")


@query("T2_select_uniform", """
WITH r AS (SELECT doc_id, path, row_number() OVER (ORDER BY path) - 1 AS j, COUNT(*) OVER () AS len FROM v_file), i AS (SELECT range AS i FROM range(37))
SELECT doc_id, path FROM r WHERE len <= 37 OR j IN (SELECT CAST(floor(i * len / 37.0::DOUBLE) AS BIGINT) FROM i, (SELECT DISTINCT len FROM r) l)""")
def select_uniform(t: Tables) -> DataFrame:
    return P.select_uniform(t.v_file, ["path"], 37).select("doc_id", "path")


@query("T3_select_linspace", """
WITH r AS (SELECT doc_id, path, row_number() OVER (ORDER BY path) - 1 AS j, COUNT(*) OVER () AS len FROM v_file)
SELECT doc_id, path FROM r WHERE len <= 31 OR j IN (SELECT CAST(round_even(i * ((len - 1) / 30.0::DOUBLE), 0) AS BIGINT) FROM range(31) i(i), (SELECT DISTINCT len FROM r) l)""")
def select_linspace(t: Tables) -> DataFrame:
    return P.select_linspace(t.v_file, ["path"], 31).select("doc_id", "path")


@query("T4_balanced_take", """
WITH f AS (SELECT path, folder = 'es' AS obs, row_number() OVER (PARTITION BY folder = 'es' ORDER BY path) AS rk FROM v_file)
SELECT path, obs FROM (SELECT *, CASE WHEN rk <= 150 THEN 0 WHEN obs THEN 1 ELSE 2 END AS p FROM f) q ORDER BY p, rk, obs DESC LIMIT 300""")
def balanced_take(t: Tables) -> DataFrame:
    files = t.v_file.select("path", (F.col("folder") == "es").alias("obs"))
    return P.balanced_take(files, "obs", ["path"], 300)


@query("T5_stratified_split", """
WITH r AS (SELECT o_orderkey, true_label, row_number() OVER (PARTITION BY true_label ORDER BY md5('42|' || CAST(o_orderkey AS STRING)), o_orderkey) AS n, COUNT(*) OVER (PARTITION BY true_label) AS len FROM v_pred_class)
SELECT o_orderkey, true_label, CASE WHEN n <= round_even(len * 0.7::DOUBLE, 0) THEN 'train' WHEN n <= round_even(len * 0.7::DOUBLE, 0) + round_even(len * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM r""")
def stratified_split(t: Tables) -> DataFrame:
    return P.stratified_split(t.v_pred_class, "true_label", ["o_orderkey"], ratios=(0.7, 0.2)).select("o_orderkey", "true_label", "split")


@query("T6_balanced_split", """
WITH c AS (SELECT station, class_label, crop_id FROM v_crop_event WHERE class_label IS NOT NULL), sz AS (SELECT class_label, COUNT(*) AS len FROM c GROUP BY 1 HAVING COUNT(*) >= 60),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.class_label ORDER BY md5('42|' || CAST(crop_id AS STRING)), crop_id) AS n, (SELECT MIN(len) FROM sz) AS m FROM c JOIN sz ON sz.class_label = c.class_label)
SELECT crop_id, class_label, CASE WHEN n <= floor(m * 0.7::DOUBLE) THEN 'train' WHEN n <= floor(m * 0.7::DOUBLE) + floor(m * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r
WHERE n <= floor(m * 0.7::DOUBLE) + floor(m * 0.15::DOUBLE) + floor(m * 0.15::DOUBLE)""")
def balanced_split(t: Tables) -> DataFrame:
    return P.balanced_split(t.v_crop_event, "class_label", ["crop_id"], 60).select("crop_id", "class_label", "split")


@query("T7_group_split", """
WITH g AS (SELECT DISTINCT image_id FROM v_scores), r AS (SELECT image_id, row_number() OVER (ORDER BY md5('42|' || CAST(image_id AS STRING)), image_id) AS n, COUNT(*) OVER () AS len FROM g),
k AS (SELECT image_id, CASE WHEN n <= floor(len * 0.7::DOUBLE) THEN 'train' WHEN n <= floor(len * 0.7::DOUBLE) + floor((len - floor(len * 0.7::DOUBLE)) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r)
SELECT s.row_id, s.image_id, k.split, 0 AS leaked FROM v_scores s JOIN k ON k.image_id = s.image_id""")
def group_split(t: Tables) -> DataFrame:
    split = P.group_split(t.v_scores, "image_id")
    leaked = P.leaked_groups(split, "image_id").agg(F.count(F.lit(1)).alias("leaked"))
    return with_scalars(split.select("row_id", "image_id", "split"), leaked)


@query("T8_random_split", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS STRING)), doc_id) AS n, COUNT(*) OVER () AS len FROM v_file)
SELECT doc_id, CASE WHEN n <= floor(len * 0.7::DOUBLE) THEN 'train' WHEN n <= floor(len * 0.7::DOUBLE) + floor(len * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""")
def random_split(t: Tables) -> DataFrame:
    return P.random_split(t.v_file, ["doc_id"]).select("doc_id", "split")


@query("T9_balance_classes", """
WITH x AS (SELECT row_id, image_id, site, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(row_id AS STRING)), row_id) AS n FROM v_scores)
SELECT row_id, label FROM x WHERE label = 1 OR n <= (SELECT COUNT(*) FROM v_scores WHERE label = 1)""")
def balance_classes(t: Tables) -> DataFrame:
    return P.balance_classes(t.v_scores, "label", ["row_id"]).select("row_id", "label")


@query("T10_mine_hard_negatives", """
WITH k AS (SELECT least(COUNT(*) FILTER (WHERE label = 1), COUNT(*) FILTER (WHERE label = 0)) AS k FROM v_scores),
neg AS (SELECT row_id, score, row_number() OVER (ORDER BY score DESC, row_id) AS n FROM v_scores WHERE label = 0),
easy AS (SELECT row_id, row_number() OVER (ORDER BY md5('42|' || CAST(row_id AS STRING)), row_id) AS n FROM neg WHERE n > (SELECT k FROM k))
SELECT row_id, 'positive' AS kind FROM v_scores WHERE label = 1 UNION ALL SELECT row_id, 'hard' FROM neg WHERE n <= (SELECT k FROM k) UNION ALL SELECT row_id, 'easy' FROM easy WHERE n <= (SELECT k FROM k)""")
def mine_hard_negatives(t: Tables) -> DataFrame:
    return P.mine_hard_negatives(t.v_scores, "label", "score", ["row_id"]).select("row_id", "kind")


@query("T11_filter_rare_classes", """
WITH c AS (SELECT source, COUNT(*) AS n FROM v_file WHERE source NOT IN ('src3', 'src5') GROUP BY source HAVING COUNT(*) >= 10), d AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS class_idx FROM c)
SELECT f.doc_id, f.source, d.class_idx FROM v_file f JOIN d ON d.source = f.source""")
def filter_rare_classes(t: Tables) -> DataFrame:
    return P.filter_rare_classes(t.v_file, "source", 10, ["src3", "src5"]).select("doc_id", "source", "class_idx")


@query("T12_label_queue", """
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN bytes + 1 ELSE bytes END AS bytes, CAST(doc_id * 31 % 255 AS DOUBLE) AS score FROM v_file WHERE folder <> 'en')
SELECT f.doc_id, coalesce(c.score, CASE WHEN f.doc_id % 9 <> 0 THEN CAST(f.doc_id * 17 % 255 AS DOUBLE) END, -1) AS score, c.score IS NOT NULL AS from_cache FROM v_file f
LEFT JOIN c ON c.doc_id = f.doc_id AND c.bytes = f.bytes WHERE f.doc_id NOT IN (SELECT doc_id FROM v_sidecar)""")
def label_queue(t: Tables) -> DataFrame:
    id_ = F.col("doc_id")
    items = t.v_file.withColumn("brightness", F.when(id_ % 9 != 0, (id_ * 17 % 255).cast("double")))
    cache = t.v_file.filter("folder <> 'en'").select("doc_id", F.when(id_ % 5 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), (id_ * 31 % 255).cast("double").alias("score"))
    return P.label_queue(items, t.v_sidecar, cache, "doc_id", ["path"], ["bytes"], "brightness").select("doc_id", "score", "from_cache")


@query("T13_most_borderline", """
WITH e AS (SELECT row_id, site, score, CASE WHEN label = 1 THEN CASE WHEN score >= 0.5::DOUBLE THEN 'TP' ELSE 'FN' END ELSE CASE WHEN score >= 0.5::DOUBLE THEN 'FP' ELSE 'TN' END END AS kind FROM v_scores),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(score - 0.5::DOUBLE), row_id) AS rank FROM e WHERE kind IN ('FP', 'FN')) SELECT row_id, kind, rank FROM r WHERE rank <= 25""")
def most_borderline(t: Tables) -> DataFrame:
    rows = t.v_scores.withColumn("hit", F.col("label") == 1)
    rows = rows.withColumn("kind", crop_outcome("hit", "score", 0.5))
    return P.most_borderline(rows, "kind", "score", 0.5, "row_id", 25).select("row_id", "kind", "rank")


@query("T14_newest_first", "SELECT event_id, ymd, name FROM v_name ORDER BY ymd DESC, name")
def newest_first(t: Tables) -> DataFrame:
    return P.newest_first(t.v_name.select("event_id", "ymd", "name"), "ymd", "name")


@query("T15_cluster_examples", """
SELECT frame_id, site FROM (SELECT frame_id, site, row_number() OVER (PARTITION BY site ORDER BY md5('42|' || CAST(frame_id AS STRING)), frame_id) AS n FROM v_frame) q WHERE n <= 10""")
def cluster_examples(t: Tables) -> DataFrame:
    return P.cluster_examples(t.v_frame, "site", "frame_id", 10).select("frame_id", "site")
