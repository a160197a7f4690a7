import io
import json
import struct
import zipfile
import zlib

from sievestone.operators import reporting
from sievestone.sources import files
from sievestone.streaming.ingest import event_windows, grade_arrivals


def png(path, array):
    h, w = len(array), len(array[0])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(row) for row in array)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_to_pixels(spark, tmp_path):
    png(tmp_path / "run_7.png", [[0, 10, 20], [30, 40, 250]])
    (tmp_path / "broken.png").write_bytes(b"no image")
    rows = files.pixels(files.images(spark, str(tmp_path))).orderBy("y", "x").collect()
    assert [(r.run_id, r.v) for r in rows] == [("run_7", v) for v in (0, 10, 20, 30, 40, 250)]
    assert {r.name: r.length > 0 for r in files.files(spark, str(tmp_path), "*.png").collect()} == {"run_7.png": True, "broken.png": True}


def test_exif():
    inner = struct.pack("<H", 2) + struct.pack("<HHII", 37386, 5, 1, 56) + struct.pack("<HHIHH", 41989, 3, 1, 26, 0) + struct.pack("<I", 0)
    body = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 26) + struct.pack("<I", 0) + inner
    body += struct.pack("<II", 43, 10)
    assert files.exif_of(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + body) == (4.3, 26.0)
    assert files.exif_of(b"\xff\xd8nothing") == files.exif_of(None) == (None, None)


def test_csv_json_and_calibration(spark, tmp_path):
    (tmp_path / "run_1_measurements.csv").write_text("label,area_px,length_mm\n1,2.5,\n2,3.5,\n")
    rows = files.measurements(spark, str(tmp_path / "run_1_measurements.csv"))
    assert dict(rows.dtypes) == {"label": "int", "area_px": "double", "length_mm": "double", "run_id": "string"} and rows.first().run_id == "run_1"
    assert files.load_calibration(spark, str(tmp_path / "none")).first().pixels_per_mm == 0.0
    files.save_calibration(spark.createDataFrame([("manual", 12.5)], "method string, pixels_per_mm double"), str(tmp_path / "cal"))
    assert files.load_calibration(spark, str(tmp_path / "cal")).first().pixels_per_mm == 12.5
    one = spark.createDataFrame([("r", float("nan"))], "run_id string, x double")
    documents = files.report_documents(one.select("run_id"), one, one, one, one, one, one)
    files.write_json(documents, str(tmp_path / "json"))
    (text,) = [p.read_text() for p in (tmp_path / "json").rglob("part-*") if p.suffix == ".json"]
    assert "NaN" not in text and json.loads(text)["metadata"] == {"run_id": "r"}
    assert files.properties(spark, {"a": 1.0, "b": -1.0}).count() == 1


def test_workbook(spark):
    data = files.workbook({"One": spark.createDataFrame([(1, "a & b", None)], "x int, y string, z double")})
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "<c><v>1</v></c>" in sheet and "a &amp; b" in sheet


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "run_id,label,length_px,width_px,area_px,aspect_ratio,circularity,solidity,eccentricity,orientation_angle\n"
    (tmp_path / "in" / "a.csv").write_text(head + "".join(f"r1,{k},100,50,5000,2,0.8,0.9,0.5,10\n" for k in range(4)))
    grade_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    (tmp_path / "in" / "b.csv").write_text(head + "r2,1,10,5,50,2,0.8,0.1,0.5,10\n")
    grade_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    got = {r.run_id: r.grade for r in spark.read.parquet(f"{tmp_path}/out/part=0", f"{tmp_path}/out/part=1").collect()}
    assert got == {"r1": "Premium", "r2": "Reject"}
    assert event_windows(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).count() > 0


def test_report_of_one_run_reads_its_partition(spark, tmp_path):
    rows = spark.createDataFrame([("run_1", 1.5), ("run_2", 2.5)], "run_id string, x double")
    store, shots = str(tmp_path / "store"), tmp_path / "shots"
    files.write_json(rows, store)
    one = files.report(spark, store, "../run_2")
    assert [(r.run_id, r.x) for r in one.collect()] == [("run_2", 2.5)] and files.report(spark, store, "run_9").count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "run_2" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert files.report(spark, store, "run_9", rows.schema).count() == 0
    shots.mkdir()
    (shots / "run_2_annotated.jpg").write_bytes(b"abc")
    (shots / "run_1_annotated.png").write_bytes(b"no")
    got = files.with_preview(files.reports(spark, store), files.annotated(spark, str(shots))).orderBy("run_id").collect()
    assert [r.annotated_preview for r in got] == [None, "data:image/jpeg;base64,YWJj"]
    assert files.annotated(spark, str(shots), "run_1").count() == 0 and files.annotated(spark, str(shots), "run_2").count() == 1


def test_later_sources_are_not_made(spark):
    full, empty = spark.range(3), spark.range(0)
    assert reporting.first_source(empty, lambda: full, lambda: 1 / 0).count() == 3
    assert reporting.first_source(empty, lambda: empty).count() == 0


def test_report_workbook(spark):
    grains = spark.createDataFrame([("r", 1, [1.0, 2.0]), ("r", 2, [3.0, 4.0])], "run_id string, label int, hu array<double>")
    classes = spark.createDataFrame([("r", 1, ["whole_grain"], "whole_grain")], "run_id string, label int, categories array<string>, primary_category string")
    one = spark.createDataFrame([("r", 5.0)], "run_id string, value double")
    with zipfile.ZipFile(io.BytesIO(files.report_workbook(grains, one, one, classes, one, {"hu": 2}))) as z:
        names, first = z.read("xl/workbook.xml").decode(), z.read("xl/worksheets/sheet1.xml").decode()
    assert all(f'name="{n}"' in names for n in ("Measurements", "Statistics", "Quality Metrics", "Grading"))
    assert "hu_1" in first and "primary_category" in first and "[&quot;whole_grain&quot;]" in first.replace('["whole_grain"]', "[&quot;whole_grain&quot;]") and first.count("<row>") == 3
