"""Reading and writing measurement files, images, reports and calibrations."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievestone.functions.expr import finite
from sievestone.operators import reporting

_PX = ("area_px", "hull_area_px", "perimeter_px", "hull_perimeter_px", "length_px", "width_px", "major_axis_px", "minor_axis_px")
#: Columns of a measurement file that are not doubles.
_INTS = ("label", "bbox_x", "bbox_y", "bbox_w_px", "bbox_h_px")
IMAGE_NAMES = "*.{jpg,jpeg,png,avif}"


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """Measurement CSVs with typed columns (an empty one stays a number) and run_id from the file name."""
    head = spark.read.option("header", True).csv(path)
    rows = head.select(*(F.expr(f"try_cast(`{c}` AS {'int' if c in _INTS else 'double'})").alias(c) for c in head.columns), F.col("_metadata.file_name").alias("_file"))
    return rows.withColumn("run_id", F.regexp_extract("_file", r"^(.*?)_measurements", 1)).drop("_file")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decodable images as a table: origin, height, width, channels, data (blue, green, red by rows)."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def pixels(image_rows: DataFrame) -> DataFrame:
    """Gray pixel table (run_id, y, x, v) of images; run_id is the file's name without its ending."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, h, w, c, data in batch.itertuples(index=False):
                a = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(float)
                v = np.rint(a[..., 0]) if c == 1 else np.rint(0.114 * a[..., 0] + 0.587 * a[..., 1] + 0.299 * a[..., 2])
                y, x = np.mgrid[:h, :w]
                yield pd.DataFrame({"run_id": name, "y": y.ravel(), "x": x.ravel(), "v": v.ravel().astype(np.int64)})

    name = F.regexp_extract("origin", r"([^/]+?)(\.[^./]*)?$", 1).alias("run_id")
    return image_rows.select(name, "height", "width", "channels", "data").mapInPandas(run, "run_id string, y long, x long, v long")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Names, sizes and times of files, without reading them, the last name first."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", F.col("modificationTime").alias("modified")).orderBy(F.desc("name"))


def exif_of(content: bytes | None) -> tuple[float | None, float | None]:
    """Focal length and its 35 mm equivalent from a JPEG's first Exif segment."""
    content = content or b""
    at = content.find(b"Exif\0\0")
    if content[:2] != b"\xff\xd8" or at < 0:
        return None, None
    body = content[at + 6 :]
    order = "<" if body[:2] == b"II" else ">"
    found: dict[int, float] = {}

    def walk(start: int, depth: int = 0) -> None:
        (n,) = struct.unpack_from(order + "H", body, start)
        for k in range(n):
            tag, kind, _, value = struct.unpack_from(order + "HHI4s", body, start + 2 + 12 * k)
            if tag == 0x8769 and depth < 2:
                walk(struct.unpack(order + "I", value)[0], depth + 1)
            elif tag == 37386 and kind == 5:
                a, b = struct.unpack_from(order + "II", body, struct.unpack(order + "I", value)[0])
                if b:
                    found[tag] = a / b
            elif tag == 41989:
                found[tag] = float(struct.unpack(order + "H", value[:2])[0])

    try:
        walk(struct.unpack_from(order + "I", body, 4)[0])
    except struct.error:
        pass
    return found.get(37386), found.get(41989)


def camera_data(spark: SparkSession, path: str) -> DataFrame:
    """path, focal and focal_35 of JPEG files; null where a file tells nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [exif_of(x) for x in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "focal": [a for a, _ in read], "focal_35": [b for _, b in read]}).astype({"focal": float, "focal_35": float})

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg}").load(path).select("path", "content")
    return rows.mapInPandas(run, "path string, focal double, focal_35 double").withColumns({c: finite(F.col(c)) for c in ("focal", "focal_35")})


def properties(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    """Camera properties as rows; -1 means that a camera has no such property."""
    return spark.createDataFrame(list(values.items()), "name string, value double").where("value != -1")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """All readable report documents; broken files are left out."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record") if "_corrupt_record" in rows.columns else rows


def report(spark: SparkSession, path: str, run_id: str, schema: StructType | None = None) -> DataFrame:
    """The report of one run in a store that ``write_json`` made; no row if there is none.

    Only the run's own folder is read.  Without a schema that of the run's report is found out first.
    """
    name = run_id.rsplit("/", 1)[-1]  # an id names a run, not a path
    if schema is None:
        try:
            schema = spark.read.option("basePath", path).json(f"{path}/run_id={name}").schema
        except AnalysisException:
            return spark.createDataFrame([], "run_id string")
    typed = StructType([f for f in schema if f.name != "run_id"]).add("run_id", "string")
    return spark.read.schema(typed).json(path).where(F.col("run_id") == name)


def annotated(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Annotated images (run_id, image as a data URL) of all runs or of one, whose file alone is then read."""
    glob = f"{run_id or '*'}_annotated.jpg"
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return rows.select(F.regexp_extract("path", r"([^/]+)_annotated\.jpg$", 1).alias("run_id"), data_url(F.col("content")).alias("annotated_preview"))


def with_preview(documents: DataFrame, previews: DataFrame) -> DataFrame:
    """Reports with ``annotated_preview``, null where a run has no image."""
    return documents.join(previews.groupBy("run_id").agg(F.first("annotated_preview", ignorenulls=True).alias("annotated_preview")), "run_id", "left")


def write_csv(rows: DataFrame, path: str) -> None:
    """Lists become one column for each place first (``reporting.flatten_lists``)."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_statistics(described: DataFrame, outliers: DataFrame, path: str) -> None:
    """One row per run and metric, outliers as JSON text."""
    both = described.join(outliers.select("run_id", "metric", F.to_json(F.struct("iqr_outliers", "zscore_outliers", "iqr_lower", "iqr_upper")).alias("outliers")), ["run_id", "metric"], "left")
    write_csv(both, path)


def report_documents(runs: DataFrame, measured: DataFrame, described: DataFrame, quality: DataFrame, classes: DataFrame, graded: DataFrame, counts: DataFrame) -> DataFrame:
    """One document per run: everything known of it, NaN as null."""

    def nested(df: DataFrame, name: str) -> DataFrame:
        inner = [finite(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes if c != "run_id"]
        return df.groupBy("run_id").agg(F.collect_list(F.struct(*inner)).alias(name))

    out = runs.select("run_id", F.struct(*runs.columns).alias("metadata"))
    for df, name in ((measured, "measurements"), (described, "statistics"), (classes, "classifications"), (counts, "category_counts")):
        out = out.join(nested(df, name), "run_id", "left")
    for df, name in ((quality, "quality"), (graded, "grading")):
        out = out.join(nested(df, name).select("run_id", F.col(name)[0].alias(name)), "run_id", "left")
    return out


def write_json(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").partitionBy("run_id").json(path)


def save_calibration(calibration: DataFrame, path: str) -> None:
    calibration.coalesce(1).write.mode("overwrite").json(path)


def load_calibration(spark: SparkSession, path: str) -> DataFrame:
    """The stored calibration; 0 pixels per millimetre if there is none to be read."""
    try:
        rows = spark.read.schema("method string, pixels_per_mm double").json(path).where("pixels_per_mm IS NOT NULL")
    except AnalysisException:
        rows = spark.createDataFrame([], "method string, pixels_per_mm double")
    return rows.agg(F.coalesce(F.first("pixels_per_mm"), F.lit(0.0)).alias("pixels_per_mm"), F.first("method").alias("method"))


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(sheets: dict[str, DataFrame], most_rows: int = 100_000) -> bytes:
    """A small .xlsx of report tables; larger ones belong in ``write_csv`` (``most_rows`` raises)."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (name, df) in enumerate(sheets.items(), 1):
            rows = df.limit(most_rows + 1).collect()
            if len(rows) > most_rows:
                raise ValueError(f"{name} has more than {most_rows} rows")
            lines = [df.columns, *rows]
            body = "".join("<row>" + "".join(_cell(v) for v in line) + "</row>" for line in lines)
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        n = range(1, len(sheets) + 1)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(s)[:31]}" sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(n, sheets)) + "</sheets></workbook>")
        kinds = "http://schemas.openxmlformats.org/package/2006"
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{kinds}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheet = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{sheet}.worksheet+xml"/>' for k in n) + "</Types>")
    return out.getvalue()


def report_workbook(measured: DataFrame, described: DataFrame, quality: DataFrame, classes: DataFrame, graded: DataFrame, lists: dict[str, int] | None = None, most_rows: int = 100_000) -> bytes:
    """The workbook of a run: measurements (lists by place, with the labels of ``classes``), statistics, quality and grade."""
    flat = reporting.flatten_lists(measured, lists or {})
    own = [c for c in classes.columns if c not in flat.columns]
    sheets = {"Measurements": flat.join(classes.select("run_id", "label", *own), ["run_id", "label"], "left").orderBy("run_id", "label"), "Statistics": described, "Quality Metrics": quality, "Grading": graded}
    # a cell holds one value: nested ones become JSON text
    return workbook({k: df.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes)) for k, df in sheets.items()}, most_rows)


def data_url(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))
