"""Attachment intake: per-upload checks and storage paths.

An upload is all files sent together for one job.  Its verdict needs the
file count of each group, so the checks are one aggregate per upload (partial
aggregation keeps a huge upload from reaching one task as rows), joined back
to the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import ColumnOrName, _c
from .ingest import assign_ids


def check_uploads(files: DataFrame, upload_col: str = "upload_id", group_col: str = "group",
                  mime_col: str = "mime_type", size_col: str = "size_bytes",
                  max_bytes: int = S.UPLOAD_MAX_BYTES) -> DataFrame:
    """Files with ``accepted`` and ``reason`` (comma list of the broken rules
    of their upload: ``count:<group>``, ``group`` for an unknown one, ``mime`` for
    a type that is missing or not allowed, ``size``; empty when none)."""
    allowed = list(S.ALLOWED_MIME)
    g = F.col(f"`{group_col}`")
    per = files.groupBy(upload_col).agg(
        *[F.count_if(g == F.lit(name)).alias(f"__n_{name}") for name in S.ATTACHMENT_GROUPS],
        F.bool_or(~F.coalesce(g.isin(S.ATTACHMENT_GROUPS), F.lit(False))).alias("__bad_group"),
        F.bool_or(~F.coalesce(F.col(mime_col).isin(allowed), F.lit(False))).alias("__bad_mime"),
        F.bool_or(F.col(size_col) > F.lit(max_bytes)).alias("__too_big"),
    )
    parts = [F.when(F.col(f"__n_{name}") > F.lit(limit), F.lit(f"count:{name}"))
             for name, limit in S.ATTACHMENT_GROUP_LIMITS.items()]
    parts += [F.when(F.col("__bad_group"), F.lit("group")), F.when(F.col("__bad_mime"), F.lit("mime")), F.when(F.col("__too_big"), F.lit("size"))]
    verdict = per.select(upload_col, F.concat_ws(",", *parts).alias("reason"))
    of = verdict.withColumnRenamed(upload_col, "__upload")
    return (files.join(of, F.col(upload_col).eqNullSafe(F.col("__upload"))).drop("__upload")
            .withColumn("accepted", F.col("reason") == F.lit("")))


def extension(mime: ColumnOrName) -> Column:
    """File extension of a mime type, ``bin`` when unknown."""
    m = F.create_map(*[F.lit(x) for kv in S.ALLOWED_MIME.items() for x in kv])
    return F.coalesce(m[_c(mime)], F.lit(S.DEFAULT_EXTENSION))


def storage_path(job: ColumnOrName, when: ColumnOrName, mime: ColumnOrName, seed: ColumnOrName) -> Column:
    """'/uploads/yyyy-MM/{job}_{yyyyMMdd_HHmmss}_{12 hex}.{ext}'.  The hex part
    comes from a hash of ``seed`` instead of random bytes, so reruns agree."""
    return F.concat(F.lit("/uploads/"), F.date_format(_c(when), "yyyy-MM"), F.lit("/"),
                    _c(job).cast("string"), F.lit("_"), F.date_format(_c(when), "yyyyMMdd_HHmmss"), F.lit("_"),
                    F.substring(F.sha2(_c(seed).cast("string"), 256), 1, 12), F.lit("."), extension(mime))


def safe_relative(path: ColumnOrName) -> Column:
    """Stored path with '\\' as '/', relative to the upload root, or NULL when
    it is outside ``/uploads/``."""
    p = F.translate(_c(path), "\\", "/")
    return F.when(p.startswith("/uploads/"), F.substring(p, 10, 1 << 20))


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under ``path`` as rows (path, modificationTime, length) without
    reading their bytes; feeds :func:`check_uploads`."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").load(path)
            .select("path", "modificationTime", "length"))


#: ``<job id>/<group>/<file name>``, the end of an uploaded file's path; and the same in folders named by column.
PLAIN_PATH = r"([0-9]{1,18})/([^/]+)/([^/]+)$"
COLUMN_PATH = r"job_id=([0-9]{1,18})/group=([^/]+)/([^/]+)$"


def from_manifest(files: DataFrame, shape: str = PLAIN_PATH, mime: Column | None = None) -> DataFrame:
    """Manifest rows as upload rows.  A path ends in ``shape``; the
    type is ``mime``, or follows the file name's extension (NULL when unknown).  A path of another
    shape gets a NULL job and group, so :func:`check_uploads` refuses it."""
    placed = F.col("path").rlike(shape)

    def field(i: int) -> Column:
        return F.when(placed, F.regexp_extract("path", shape, i))

    mimes = F.create_map(*[F.lit(x) for mime, ext in S.ALLOWED_MIME.items() for x in (ext, mime)])
    return files.select(field(1).cast("bigint").alias("job_id"), field(2).alias("group"), field(3).alias("original_name"),
                        (mimes[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))] if mime is None else mime).alias("mime_type"),
                        F.col("length").alias("size_bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("uploaded_at"), "path")


# --- Fixed values: the first bytes of the allowed file types, in hexadecimal ---
JPEG_HEAD = "FFD8FF"
PNG_HEAD = "89504E470D0A1A0A"
WEBP_HEAD = "^52494646.{8}57454250"
PDF_HEAD = "255044462D"
# --- end of fixed values ---


def sniffed_mime(content: ColumnOrName) -> Column:
    """Type of a file by its first bytes, NULL when they are of none that is known."""
    head = F.hex(F.substring(_c(content), 1, 12))
    return (F.when(head.startswith(JPEG_HEAD), "image/jpeg").when(head.startswith(PNG_HEAD), "image/png")
            .when(head.rlike(WEBP_HEAD), "image/webp").when(head.startswith(PDF_HEAD), "application/pdf"))


def scan_uploads(spark: SparkSession, path: str, shape: str = PLAIN_PATH, pattern: str = "*",
                 max_bytes: int = S.UPLOAD_MAX_BYTES) -> DataFrame:
    """Files under ``path`` as upload rows whose type was read from their first bytes.

    The bytes of a file over ``max_bytes`` are not read (the bound reaches the
    source); it keeps the type of its name and is refused for its size."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(path))
    small = files.where(F.col("length") <= max_bytes)
    read = from_manifest(small.select("path", "modificationTime", "length", sniffed_mime("content").alias("__mime")), shape, F.col("__mime"))
    large = files.where(F.col("length") > max_bytes).select("path", "modificationTime", "length")
    return read.unionByName(from_manifest(large, shape))


def register_uploads(checked: DataFrame, existing: DataFrame) -> DataFrame:
    """New attachment rows of the accepted files: ids above the current maximum, by
    job, group in its fixed order and path; the storage path is derived from
    job, time, type and a hash of the given path."""
    place = F.array_position(F.array(*[F.lit(g) for g in S.ATTACHMENT_GROUPS]), F.col("group"))
    rows = checked.where("accepted").select(
        "job_id", "group", storage_path("job_id", "uploaded_at", "mime_type", "path").alias("file_path"),
        "original_name", "uploaded_at", place.alias("__place"), "path")
    base = existing.agg(F.max("id")).first()[0] or 0      # one scalar
    return assign_ids(rows, ["job_id", "__place", "path"], base).select(*[f.name for f in S.ATTACHMENT.fields])
