import struct
import zlib

import pytest

from gridlens.sources import export, files, images


def _png(path, width, height, rgb):
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    rows = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    )


def test_images(spark, tmp_path):
    _png(tmp_path / "ok.png", 4, 3, (10, 20, 60))
    (tmp_path / "broken.png").write_bytes(b"no image")
    rows = images.read_images(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and bytes(rows[0]["data"][:3]) == bytes((60, 20, 10))
    stats = images.image_stats(spark, str(tmp_path)).collect()
    assert len(stats) == 1
    assert (stats[0]["resolution"], stats[0]["mode"], stats[0]["brightness"]) == ("4×3", "RGB", 30.0)
    assert files.auto_load(spark, str(tmp_path / "ok.png"))[1] == "image"
    for name in ("photo.webp", "empty.JPG", "notes.txt", "bare"):
        (tmp_path / name).write_bytes(b"" if name == "empty.JPG" else b"x")
    report = {r["path"].rsplit("/", 1)[1]: (r["loaded"], r["reason"]) for r in images.load_report(spark, str(tmp_path)).collect()}
    assert report == {
        "ok.png": (True, None), "broken.png": (False, "does not decode"), "photo.webp": (False, "no decoder for webp"),
        "empty.JPG": (False, "empty file"), "notes.txt": (False, "no image suffix: txt"), "bare": (False, "no image suffix: "),
    }


@pytest.mark.parametrize(
    "name, kind",
    [("a.CSV", "csv"), ("b.xlsx", "excel"), ("c.xls", "excel"), ("d.json", "json"), ("e.txt", "text"),
     ("f.WebP", "image"), ("g.jpeg", "image"), ("h", "unknown"), (".csv", "unknown"), ("i.tar.gz", "unknown")],
)
def test_kinds(spark, name, kind):
    from pyspark.sql import functions as F

    assert files.detect_kind(f"/x.csv/{name}") == kind
    row = spark.createDataFrame([(f"/x.csv/{name}",)], "p string").select(files.kind_of(F.col("p"))).first()
    assert row[0] == kind


def test_catalog_and_loading(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x, y"\n2,\n')
    (tmp_path / "t.json").write_text('[{"a": 1, "c": [1, 2]}, {"a": null, "c": []}]')
    (tmp_path / "t.txt").write_text("line one\nline two é")
    (tmp_path / "t.bin").write_bytes(b"12345")
    listed = {r["path"].rsplit("/", 1)[-1]: (r["kind"], r["size"]) for r in files.file_catalog(spark, str(tmp_path)).collect()}
    assert listed["t.bin"] == ("unknown", 5) and listed["t.txt"][0] == "text" and len(listed) == 4
    rows, kind = files.auto_load(spark, str(tmp_path / "t.csv"))
    assert kind == "dataframe" and [tuple(r) for r in rows.collect()] == [(1, "x, y"), (2, None)]
    rows, kind = files.auto_load(spark, str(tmp_path / "t.json"))
    assert kind == "dataframe" and [r["a"] for r in rows.collect()] == [1, None]
    rows, kind = files.auto_load(spark, str(tmp_path / "t.txt"))
    assert kind == "text" and rows.first()["text"] == "line one\nline two é"
    with pytest.raises(ValueError):
        files.auto_load(spark, str(tmp_path / "t.bin"))
    (tmp_path / "t.dat").write_text("a,b\n1,x\n")
    rows, kind = files.auto_load(spark, str(tmp_path / "t.dat"), unknown_as="csv")
    assert kind == "dataframe" and [tuple(r) for r in rows.collect()] == [(1, "x")]


def test_exports(spark, tmp_path):
    out = export.Exporter(spark, str(tmp_path / "out"))
    df = spark.createDataFrame([(1, 'say "hi"', [1, 2]), (2, None, [])], "a int, s string, l array<int>")
    paths = out.export_all({"main": df})
    assert [p.rsplit(".", 1)[-1] for p in paths] == ["csv", "parquet"]
    back = files.read_csv(spark, paths[0], "a int, s string, l string").orderBy("a").collect()
    assert [tuple(r) for r in back] == [(1, 'say "hi"', "[1,2]"), (2, None, "[]")]
    out.export_all({"main": df}, include_parquet=False)
    assert [r["position"] for r in out.exported().orderBy("position").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        out.predictions(df)


def test_data_model_and_relationships(spark, tmp_path):
    out = export.Exporter(spark, str(tmp_path / "model"))
    tables = {"t": spark.range(3), "empty": spark.createDataFrame([], "k string, v double")}
    links = [{"from": "t.id", "to": "empty.k"}]
    rows = {(r["table_name"], r["column_name"]): r for r in out.data_model(tables, links).collect()}
    assert rows["t", "id"]["row_count"] == 3 and rows["t", "id"]["is_primary_key"]
    assert rows["empty", "v"]["row_count"] == 0 and not rows["empty", "v"]["is_primary_key"]
    back = spark.read.json(str(tmp_path / "model" / "data_model_relationships.json")).first()
    assert (back["from"], back["to"]) == ("t.id", "empty.k")


def test_analysis_results_defaults(spark):
    rows = export.analysis_results(spark, {"mse": 2.5}).collect()
    assert [(r["metric_name"], r["metric_value"], r["metric_value_num"]) for r in rows] == [
        ("mse", "2.5", 2.5), ("device", "unknown", None), ("row_count", "0", 0.0)]


def test_dashboard_tables(spark):
    metrics = spark.createDataFrame([("a", 1.0), ("report", None)], "metric string, value double")
    out = export.dashboard_tables({"metrics": metrics, "predictions": spark.range(2)})
    assert set(out) == {"metrics_summary", "predictions"} and out["metrics_summary"].count() == 1
