"""Readers and writers on small files of every kind, broken ones included."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from tidewrack.functions.columns import file_label
from tidewrack.operators.upkeep import replace_partitions
from tidewrack.sources import files as S


def png(path, rows):
    """8-bit grey PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b""))


def test_frames_are_tiled_and_bad_images_listed(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    png(tmp_path / "sub" / "a.png", [[x + 10 * y for x in range(5)] for y in range(3)])
    (tmp_path / "b.png").write_bytes(b"not an image")
    good, bad = S.read_frames(spark, str(tmp_path), tile=2)
    tiles = {(r.tile_row, r.tile_col): (r.height, r.width, r.px) for r in good.collect()}
    assert len(tiles) == 6 and tiles[(0, 0)] == (2, 2, [0, 1, 10, 11]) and tiles[(1, 2)] == (1, 1, [24])
    assert [r.file.endswith("b.png") for r in bad.collect()] == [True]


def test_file_index_ignores_case_and_sorts(spark, tmp_path):
    for n in ("d2/x.PNG", "d1/y.tif", "d1/notes.txt", "a.jpeg"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"12345")
    out = S.read_file_index(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in out] == ["a.jpeg", "y.tif", "x.PNG"] and out[0].bytes == 5


def test_torn_sidecars_are_set_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source_frame_id": 7, "peak_val": 0.5, "class_label": None}, indent=2))
    (tmp_path / "b.json").write_text('{"source_frame_id": 8, "peak')
    good, bad = S.read_sidecars(spark, str(tmp_path))
    assert [(r.source_frame_id, r.peak_val, r.class_label) for r in good.collect()] == [(7, 0.5, None)]
    assert [r.file.endswith("b.json") for r in bad.collect()] == [True] and bad.count() == 1


def test_labelme(spark, tmp_path):
    shapes = [{"label": "medusa", "shape_type": "rectangle", "points": [[1, 2], [3, 4]]}, {"label": "x", "points": [[0, 0]]}]
    (tmp_path / "a.json").write_text(json.dumps({"version": "5", "shapes": shapes}, indent=1))
    out = S.read_labelme(spark, str(tmp_path)).orderBy("shape_no").collect()
    assert [(r.label, r.shape_type) for r in out] == [("medusa", "rectangle"), ("x", "polygon")] and out[0].points == [[1.0, 2.0], [3.0, 4.0]]
    assert S.read_labelme(spark, str(tmp_path), ["medusa"]).count() == 1


def test_sensor_log_skips_bad_lines(spark, tmp_path):
    (tmp_path / "leak.csv").write_text(
        "iso_time,t_rel_s,p_int_pa,p_ext_pa,temp_int_c,humidity_pct,leak_flag\n"
        "2026-07-27T21:10:15,0.00,101119.4,101700.0,22.76,49.36,0.0\n"
        "2026-07-27T21:10:17,garbled\n"
        "2026-07-27T21:10:19,4.05,101120.1,101690.0,,49.4,1.0\n")
    log = S.read_sensor_log(spark, str(tmp_path))
    assert log.count() == 2 and log.agg(F.sum("leak_flag")).first()[0] == 1.0


def test_dated_sink_uses_stem_or_today(spark, tmp_path):
    df = spark.createDataFrame([("frame_20260812_132607_00049533_crop_000_area_15.53",), ("frame_20260811_000000_00000001_crop_001_area_2.00",)], "stem string")
    S.write_by_date(df, str(tmp_path), "crops")
    S.write_by_date(df, str(tmp_path), "live", today="20260901")
    assert sorted(p.name for p in (tmp_path / "crops").glob("date=*")) == ["date=20260811", "date=20260812"]
    assert [p.name for p in (tmp_path / "live").glob("date=*")] == ["date=20260901"]


def test_labels_from_folders(spark):
    paths = ["d/OBS/a.png", "d/no_obs/b.png", "d/other/c.png", "d/obs/._a.png", "d/obs/notes.txt", "lonely.png"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.l for r in df.withColumn("l", file_label("path")).collect()}
    assert got["d/OBS/a.png"] is True and got["d/no_obs/b.png"] is False and got["d/other/c.png"] is None and got["lonely.png"] is None
    assert sorted(r.path for r in S.label_files(df).collect()) == ["d/OBS/a.png", "d/no_obs/b.png", "d/other/c.png", "lonely.png"]


def test_replace_partitions_leaves_other_dates_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, d string"), path, "d")
    replace_partitions(spark.createDataFrame([(3, "b")], "v int, d string"), path, "d")
    assert sorted((r.v, r.d) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_annotation_documents_of_the_query_share_one_folder(spark, monkeypatch, tmp_path):
    from tidewrack.plans import stream
    from tidewrack.plans.standins import Tables

    monkeypatch.setattr(stream, "_dir", lambda t, name: str(tmp_path / name))
    images = {r.image_id for r in stream.read_labelme(Tables(spark, "/root/testdata/sf0.001")).collect()}
    files = [p for p in (tmp_path / "annotations").rglob("*.txt")]
    assert len(files) == len({i // 200 for i in images}) > 1 and all(p.parent == tmp_path / "annotations" for p in files)
