"""Uploaded files: names under which they land, types, data URLs, and the binary source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.sources.bindings import SECTIONS

#: Types by suffix, and labels of them.
TYPES = {
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp",
    "txt": "text/plain", "csv": "text/csv", "htm": "text/html", "html": "text/html", "json": "application/json", "xml": "text/xml", "zip": "application/zip",
}
UNKNOWN = "application/octet-stream"
#: Where a text for a language model is cut out, around each of these words.
WINDOWS = [
    "BULETIN ANALIZE MEDICALE", "Citomorfologie", "Hemograma simpla", "Hemograma simplă", "Sysmex", "WBC", "RBC", "HGB", "HCT", "PLT", "INTERVAL BIOLOGIC", "--- LINES ---", "--- TABLE", "--- PLAIN TEXT ---",
]
BEFORE, AFTER, MOST = 1200, 14000, 24000


def mime_type(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), suffix), F.lit(UNKNOWN))


def landing_name(name: Column, at: Column) -> Column:
    """Seconds of the upload's time, and the name with slashes as underscores."""
    plain = F.translate(F.coalesce(F.nullif(name, F.lit("")), F.lit("uploaded_document")), "/\\", "__")
    return F.concat(F.unix_timestamp(at).cast("string"), F.lit("_"), plain)


def accepted(uploads: DataFrame) -> DataFrame:
    """uploads (section, filename, at) that go to a known section, with stored_name and content_type."""
    return uploads.where(F.col("section").isin(*SECTIONS)).withColumns({"stored_name": landing_name(F.col("filename"), F.col("at")), "content_type": mime_type(F.col("filename"))})


def land(uploads: DataFrame, folder: str) -> None:
    """Append accepted uploads to the landing folder, by section; readers and streams read it from there."""
    accepted(uploads).write.mode("append").partitionBy("section").parquet(folder)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with name, content_type, size and content; a query that doesn't ask for content doesn't read it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content").withColumn("content_type", mime_type(F.col("name")))


def data_url(content: Column, name: Column) -> Column:
    return F.concat(F.lit("data:"), mime_type(name), F.lit(";base64,"), F.base64(content))


def size_label(size: Column) -> Column:
    """Bytes, KB or MB; one decimal from a megabyte on, a half rounded to the even one as C's printf does (Java's rounds it up)."""
    kb = lambda n: F.concat(F.round(n / 1024, 0).cast("long").cast("string"), F.lit(" KB"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, kb(size)).otherwise(F.format_string("%.1f MB", F.bround(size / F.lit(1048576.0), 1)))


def badge(name: Column) -> Column:
    """PDF, IMG or FILE."""
    kind = mime_type(name)
    return F.when(kind == "application/pdf", "PDF").when(kind.startswith("image/"), "IMG").otherwise("FILE")


def compact(text: Column, markers: list[str] = WINDOWS) -> Column:
    """What stands around the markers (1200 characters before to 14000 after each), or all of the text; 24000 characters at most."""
    t = F.coalesce(text, F.lit(""))
    start = lambda m: F.greatest(F.locate(m.lower(), F.lower(t)) - BEFORE, F.lit(1))
    end = lambda m: F.locate(m.lower(), F.lower(t)) + AFTER
    cuts = [F.when(F.locate(m.lower(), F.lower(t)) > 0, F.substr(t, start(m), end(m) - start(m))) for m in markers]
    joined = F.array_join(F.array_compact(F.array(*cuts)), "\n\n")
    return F.substring(F.when(joined != "", joined).otherwise(t), 1, MOST)
