"""Schemas and the fixed values that are part of the semantics."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The names of columns.
JOB_FACTS = (
    "job_id string, operation string, accepted_at timestamp, started_at timestamp, finished_at timestamp, status string, "
    "file_count bigint, input_bytes bigint, result_bytes bigint, error_code string"
)
REJECTIONS = "occurred_at timestamp, operation string, file_count bigint, input_bytes bigint, error_code string"
EVENTS = (
    "job_id string, kind string, operation string, ts timestamp, seq bigint, file_count bigint, input_bytes bigint, "
    "result_bytes bigint, status string, error_code string"
)
FILES = "path string, original string, content_type string, size bigint"
PAGES = "doc_id bigint, page_no int, text string, width_pt double, height_pt double"
RECORD_FILES = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in FILES.split(', ')).replace(', ', ',')}>>"

#: Fixed values.
TERMINAL = ("succeeded", "failed", "cancelled")
AI_OPERATIONS = ("upscale", "remove-background")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".heic", ".heif", ".tif", ".tiff", ".bmp")
DOCUMENT_EXTENSIONS = (".doc", ".docx", ".odt", ".rtf", ".pdf")
FORMATS = {"jpeg": (".jpg", "JPEG"), "jpg": (".jpg", "JPEG"), "png": (".png", "PNG"), "webp": (".webp", "WEBP")}
MIME = {
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".zip": "application/zip",
}
MIB = 1 << 20
IMAGE_BYTES, DOCUMENT_BYTES, JOB_BYTES, RESULT_BYTES, CHUNK = 50 * MIB, 100 * MIB, 250 * MIB, 500 * MIB, MIB
MAX_FILES, MAX_PAGES, MAX_PIXELS, MAX_UPSCALED = 20, 250, 100_000_000, 420_000_000
RATE_WINDOW, RATE_AI, RATE_LOCAL = 3600, 20, 60
ACTIVE_JOBS, LEASE = 3, 2100
RESULT_TTL, RECORD_TTL, RETENTION_DAYS, HOURLY_DAYS = 3600, 7200, 365, 31
BEAT_TTL, WORKERS, FREE_BYTES = 90, 4, 250 * MIB


def utc(spark: SparkSession) -> SparkSession:
    """All time arithmetic here is in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
