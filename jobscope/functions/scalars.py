"""Column functions over names, records, options and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope.schema import AI_OPERATIONS, FORMATS, MIME, RECORD_FILES, RESULT_TTL


def iso(ts: Column) -> Column:
    """2026-07-11T10:00:00Z, with six digits of fraction only where there is one."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.000000Z$", "Z")


def floor_bucket(ts: Column, bucket: str) -> Column:
    """Start of the UTC hour, or of the day for any other bucket."""
    return F.date_trunc("hour" if bucket == "hour" else "day", ts)


def _basename(name: Column) -> Column:
    return F.regexp_extract(name, r"([^/]*)/*$", 1)


def clean_stem(name: Column) -> Column:
    """The name without its last suffix, runs of odd characters as _, trimmed of ._, 80 characters at most, result if nothing is left."""
    stem = F.regexp_replace(_basename(name), r"(?<=.)\.[^.]+$", "")
    stem = F.btrim(F.regexp_replace(stem, r"[^\p{L}\p{N}_.-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(F.substring(stem, 1, 80), F.lit("")), F.lit("result"))


def sanitize(name: Column, extension: Column) -> Column:
    """Each odd character of the base name as _, 150 characters at most; file and its extension if that is nothing; then trimmed."""
    fallback = F.concat(F.lit("file"), extension)
    base = _basename(F.coalesce(F.nullif(name, F.lit("")), fallback))
    safe = F.substring(F.regexp_replace(base, r"[^\p{L}\p{N} ._()-]", "_"), 1, 150)
    return F.regexp_replace(F.coalesce(F.nullif(safe, F.lit("")), fallback), r"^\s+|\s+$", "")


def extension(name: Column) -> Column:
    """Lower-cased last suffix with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(_basename(name), r"(?<=.)(\.[^.]+)$", 1))


def _lookup(pairs: dict[str, str], key: Column, default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def image_extension(fmt: Column) -> Column:
    return _lookup({k: x for k, (x, _) in FORMATS.items()}, fmt, ".png")


def image_format(fmt: Column) -> Column:
    return _lookup({k: x for k, (_, x) in FORMATS.items()}, fmt, "PNG")


def mime(suffix: Column) -> Column:
    return _lookup(MIME, suffix, "application/octet-stream")


def output_name(operation: Column, stem: Column, i: Column, ext: Column, first: Column, last: Column) -> Column:
    """File name of an output by its operation; i counts from 1, first and last are page numbers."""
    numbered = F.concat(stem, F.lit("_"), i.cast("string"), ext)
    return (
        F.when(operation == "upscale", F.concat(F.lit("upscaled_"), numbered))
        .when(operation == "remove-background", F.concat(F.lit("no-background_"), numbered))
        .when(operation == "pdf-split", F.concat(F.lit("pages-"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("_"), i.cast("string"), F.lit(".pdf")))
        .when(operation == "pdf-to-images", F.concat(F.lit("page-"), F.format_string("%03d", i.cast("int")), ext))
        .otherwise(numbered)
    )


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text column as hex, from sha2 alone."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def client_address(forwarded: Column, host: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.split_part(forwarded, F.lit(","), F.lit(1)), r"^\s+|\s+$", ""), F.lit("")), host, F.lit("unknown"))


def route(operation: Column) -> Column:
    return F.when(operation.isin(*AI_OPERATIONS), "ai").otherwise("local")


def eta(operation: Column, scale: Column, files: Column, pixels: Column) -> Column:
    """Estimated seconds of a job."""
    n = F.greatest(F.lit(1), files)
    mp = pixels / 1e6
    return (
        F.when((operation == "upscale") & (scale == 4), F.floor(n * 90 + mp * 30 + 0.5))
        .when(operation == "upscale", F.floor(n * 60 + mp * 12 + 0.5))
        .when(operation == "remove-background", n * 60)
        .when(operation == "document-convert", n * 45)
        .when(operation == "pdf-to-images", F.lit(75))
        .otherwise(F.greatest(F.lit(8), n * 8))
        .cast("long")
    )


def expires(created: Column, seconds: int = RESULT_TTL) -> Column:
    return created + F.expr(f"interval {seconds} seconds")


def record_view(record: Column) -> Column:
    """Typed struct of a job record (map of strings)."""

    def get(key: str) -> Column:
        return F.try_element_at(record, F.lit(key))

    details = F.when(F.coalesce(get("error_details"), F.lit("")) != "", get("error_details"))
    error = F.when(F.coalesce(get("error_code"), F.lit("")) != "", F.struct(get("error_code").alias("code"), F.coalesce(get("error_message"), F.lit("")).alias("message"), details.alias("details")))
    return F.struct(
        get("job_id").alias("job_id"), get("operation").alias("operation"), get("status").alias("status"),
        F.coalesce(get("progress").try_cast("int"), F.lit(0)).alias("progress"), F.coalesce(get("total").try_cast("int"), F.lit(0)).alias("total"),
        get("created_at").alias("created_at"), get("expires_at").alias("expires_at"), get("result_name").alias("result_name"), get("result_type").alias("result_type"), error.alias("error"),
    )


def record_files(files_json: Column) -> Column:
    return F.from_json(files_json, RECORD_FILES)


def options_valid(options: Column) -> Column:
    """Whether the text is a JSON object."""
    v = F.try_parse_json(options)
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def option_columns(options: Column, operation: Column) -> dict[str, Column]:
    """Options with the defaults and limits of the operation, and options_error, the code that they end the job with.

    A number that can't be read (a JSON null too) is an INTERNAL_ERROR where it is used, but for scale, which is checked before
    the job is queued. A quality is only used where an image is written anew: not for an upscaled or cut out image that
    stays a PNG. mode, pageSize and orientation are taken as written; any mode but each, or none, asks for ranges.
    """
    v = F.try_parse_json(options)

    def raw(key: str) -> Column:
        return F.try_variant_get(v, f"$.{key}", "variant")

    def text(key: str, default: Column) -> Column:
        return F.coalesce(F.when(F.is_variant_null(raw(key)), "None"), F.try_variant_get(v, f"$.{key}", "string"), default)

    def number(key: str, default: int) -> Column:
        return F.when(raw(key).isNotNull(), F.try_variant_get(v, f"$.{key}", "bigint")).otherwise(F.lit(default).cast("long"))

    def side(key: str) -> Column:
        nothing = F.is_variant_null(raw(key)) | (F.try_variant_get(v, f"$.{key}", "string") == "")
        return F.when(nothing, F.lit(0).cast("long")).otherwise(number(key, 0))

    def of(*names: str) -> Column:
        return operation.isin(*names)

    default = F.when(of("upscale"), "jpeg").when(of("remove-background", "pdf-to-images"), "png").otherwise(F.lit("webp"))
    fmt = F.lower(text("format", default))
    quality, scale, dpi, margin, width, height = number("quality", 100), number("scale", 2), number("dpi", 150), number("margin", 10), side("maxWidth"), side("maxHeight")
    unsupported, invalid, internal = F.lit("UNSUPPORTED_FORMAT"), F.lit("INVALID_FILE"), F.lit("INTERNAL_ERROR")
    image = fmt.isin(*FORMATS)
    error = (
        F.when(of("image-convert") & ~image, unsupported)
        .when(of("image-convert") & (quality.isNull() | width.isNull() | height.isNull()), internal)
        .when(of("upscale") & ~F.coalesce(scale.isin(2, 4), F.lit(False)), invalid)
        .when(of("upscale", "pdf-to-images") & ~image, unsupported)
        .when(of("upscale") & (fmt != "png") & quality.isNull(), internal)
        .when(of("remove-background") & ~fmt.isin("png", "webp"), unsupported)
        .when(of("remove-background") & (fmt == "webp") & quality.isNull(), internal)
        .when(of("images-to-pdf") & margin.isNull(), internal)
        .when(of("pdf-to-images") & dpi.isNull(), internal)
        .when(of("pdf-to-images") & ~dpi.isin(150, 300), invalid)
        .when(of("pdf-to-images") & quality.isNull(), internal)
    )
    return {
        "format": fmt,
        "quality": F.when(of("image-convert") & quality.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(100), quality))).otherwise(quality),
        "max_width": F.when(width.isNotNull(), F.greatest(F.lit(0), width)),
        "max_height": F.when(height.isNotNull(), F.greatest(F.lit(0), height)),
        "scale": scale,
        "dpi": dpi,
        "margin": F.when(margin.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(30), margin))),
        "mode": F.when(F.coalesce(F.try_variant_get(v, "$.mode", "string") == "each", F.lit(False)), "each").otherwise("ranges"),
        "page_size": text("pageSize", F.lit("a4")),
        "orientation": text("orientation", F.lit("auto")),
        "options_error": error,
    }


def page_ranges(asked: Column, page_count: Column) -> Column:
    """Array of (first, last) pairs counted from 0, in the order asked for; null if any part is bad or none is left."""
    parts = F.filter(F.transform(F.split(asked, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")

    def pair(x: Column) -> Column:
        first = F.regexp_extract(x, r"^(\d+)(?:-(\d+))?$", 1).try_cast("long")
        last = F.coalesce(F.regexp_extract(x, r"^(\d+)-(\d+)$", 2).try_cast("long"), first)
        return F.struct((first - 1).alias("first"), (last - 1).alias("last"))

    pairs = F.transform(parts, pair)
    good = F.forall(pairs, lambda p: F.coalesce((p["first"] >= 0) & (p["last"] >= p["first"]) & (p["last"] < page_count), F.lit(False)))
    return F.when(good & (F.size(parts) > 0), pairs)
