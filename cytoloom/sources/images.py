"""Image scans: listing, decoding to pixels, stage outputs, input checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.functions.naming import IMAGE_TYPES, extension, is_image, stem

# The eight name patterns of the multi-pattern scan.
PATTERNS = ("*.jpg", "*.jpeg", "*.tif", "*.tiff", "*.JPG", "*.JPEG", "*.TIF", "*.TIFF")

# Stage output patterns and the part that is not the stem.
ARTIFACTS = {
    "cell": r"^(cell_\d+)_extracted\.jpg$",
    "borders": r"^(.*)_whole_slide_binary_borders\.jpg$",
    "subcell": r"^(subcell_\d+)(?:_[a-z_]+)?\.jpg$",
}


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of a folder with name, size and time. File contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    named = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return named.where(is_image("name"))


def image_scan(names: DataFrame, name: str = "name") -> DataFrame:
    """Keep supported types, case-insensitively, sorted by name (a range-partitioned sort)."""
    return names.where(is_image(name)).orderBy(name)


def multi_glob_scan(names: DataFrame, patterns=PATTERNS, name: str = "name") -> DataFrame:
    """Names matching any of several patterns, each once; one pass instead of one scan per pattern."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.col(name).like(pattern.replace("_", r"\_").replace("*", "%"))
    return names.where(hit).dropDuplicates([name])


def split_names(names: DataFrame, name: str = "name") -> DataFrame:
    return names.withColumns({"stem": stem(name), "format": extension(name)})


def artifact_scan(names: DataFrame, name: str = "name") -> DataFrame:
    """Stage outputs with their kind and the stem they came from."""
    kind, origin = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, pattern in ARTIFACTS.items():
        kind = F.when(F.col(name).rlike(pattern), label).otherwise(kind)
        origin = F.when(F.col(name).rlike(pattern), F.regexp_extract(name, pattern, 1)).otherwise(origin)
    return names.withColumns({"kind": kind, "stem": origin}).where("kind is not null")


def read_images(spark: SparkSession, folder: str, skip_unreadable: bool = True) -> DataFrame:
    """Decoded images as one struct per file; unreadable ones are skipped, or fail the job."""
    images = spark.read.format("image").option("dropInvalid", str(skip_unreadable).lower()).load(folder)
    flat = images.select("image.*").withColumn("image_id", F.regexp_extract("origin", r"([^/]+)$", 1))
    if skip_unreadable:
        return flat
    # Guard the height: every use of an image's pixels needs it, so the check cannot be pruned away.
    broken = F.raise_error(F.concat(F.lit("unreadable image "), F.col("origin"))).cast("int")
    return flat.withColumn("height", F.when(F.col("nChannels") < 1, broken).otherwise(F.col("height")))


def pixel_scan(images: DataFrame) -> DataFrame:
    """One row per pixel from (image_id, height, width, nChannels, data); gray images fill all three channels.

    Rows are exploded first, then columns, and each image row keeps only its own bytes.
    """
    lines = images.selectExpr(
        "image_id", "cast(width as bigint) as width", "cast(height as bigint) as height", "cast(nChannels as bigint) as c", "data",
        "explode(sequence(0L, height - 1L)) as y",
    ).selectExpr(
        "image_id", "width", "height", "c", "y", "substring(data, cast(y * width * c + 1 as int), cast(width * c as int)) as line"
    )
    pixels = lines.selectExpr("*", "explode(sequence(0L, width - 1L)) as x")

    def channel(i: int) -> str:
        at = f"cast(x * c + case when c >= 3 then {i} else 0 end + 1 as int)"
        return f"cast(conv(hex(substring(line, {at}, 1)), 16, 10) as bigint)"

    return pixels.selectExpr(
        "image_id", "width", "height", "y", "x", *[f"{channel(i)} as {n}" for i, n in enumerate("bgr")]
    )


def input_guard(names: DataFrame, name: str = "name") -> DataFrame:
    """One row: how many inputs there are, how many are usable, and whether a run may start."""
    counts = names.agg(F.count(F.lit(1)).alias("n_inputs"), F.count_if(is_image(name)).alias("n_usable"))
    state = F.when(F.col("n_inputs") == 0, "no input").when(F.col("n_usable") == 0, "no image").otherwise("ready")
    return counts.withColumn("status", state)


def require_images(names: DataFrame, name: str = "name") -> DataFrame:
    usable = names.where(is_image(name))
    if usable.isEmpty():
        raise ValueError("no supported image among the inputs: " + ", ".join(IMAGE_TYPES))
    return usable
