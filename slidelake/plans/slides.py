"""From the pages of scanner files to slides, images, pyramid levels and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidelake.functions.formats import all_jpeg, detect, ndpi_role, role
from slidelake.functions.metadata import metadata
from slidelake.operators.tiles import with_tiled_size
from slidelake.sources.wsi import register

#: How the levels of a format are read where it isn't by stored tile.
STRATEGIES = {"philips": "sparse tiled", "argos": "sparse tiled", "trestle": "overlapping", "svs": "tiled with repair"}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all files, without pixel bytes."""
    register(spark)
    return spark.read.format("wsi").option("relation", "pages").load(path)


def slides(pages: DataFrame) -> DataFrame:
    """One row per file: format (null if not recognised) and metadata in the common schema; bounded state per file, no sort."""
    first = F.struct("description", "software", "make", "model", "tags", "is_tiled", "icc_profile", "x_resolution", "y_resolution", "resolution_unit")
    xmp = F.element_at("tags", F.lit(700))
    per = pages.groupBy("path").agg(
        F.max("length").alias("length"), F.max("error").alias("error"), F.max("pages").alias("pages"), F.min_by(first, "page_idx").alias("f"),
        all_jpeg().alias("all_jpeg"), F.min_by(xmp, F.when(F.contains(xmp, F.lit("<iScan")), F.col("page_idx"))).alias("xmp"),
    )
    f = lambda n: F.col(f"f.{n}")
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))
    # scan metadata count wherever in the file they are
    own = F.when(F.col("xmp").isNotNull(), F.create_map(F.lit(700), F.col("xmp"))).otherwise(none)
    tags = F.map_concat(F.map_filter(F.coalesce(f("tags"), none), lambda k, _: (k != 700) | F.col("xmp").isNull()), own)
    fmt = detect(f("description"), f("software"), tags, F.coalesce(f("is_tiled"), F.lit(False)), F.coalesce("all_jpeg", F.lit(False)))
    known = per.withColumn("format", fmt)
    meta = metadata(F.col("format"), f("description"), f("software"), f("make"), f("model"), tags, f("x_resolution"), f("y_resolution"), f("resolution_unit"))
    return known.withColumn("metadata", meta).select("path", "length", "error", "pages", "format", f("icc_profile").alias("icc_profile"), "metadata")


def strategy(fmt: Column, tiled: Column, compression: Column, frames: Column) -> Column:
    """How a page's tiles are come by."""
    by_format = F.element_at(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv]), fmt)
    ndpi = F.when(compression == "JPEGXR_NDPI", "jpeg xr").when(tiled, "stripes re-tiled").otherwise("one frame re-tiled")
    stored = F.when(tiled, F.coalesce(by_format, F.lit("tiled"))).when(frames == 1, "single frame").otherwise("striped")
    return F.when(fmt == "ndpi", ndpi).otherwise(stored)


def images(pages: DataFrame, slide_rows: DataFrame) -> DataFrame:
    """Every page of a recognised file with its role and reading strategy."""
    fmt = slide_rows.where("format is not null").select("path", "format", F.col("metadata.mpp_x").alias("base_mpp_x"), F.col("metadata.mpp_y").alias("base_mpp_y"))
    known = pages.join(fmt, "path")
    own = role(F.col("format"), F.coalesce("description", F.lit("")), F.col("page_idx"), F.col("pages"), F.coalesce("subfile", F.lit(0)), F.col("is_tiled"))
    # a page's part in another directory is a level of what that page is
    own = F.when(F.col("parent").isNotNull(), F.when(F.col("is_tiled"), F.lit("level"))).otherwise(own)
    # reduced images behind the first page are levels unless their own text says otherwise
    later = F.when(F.col("is_tiled") & F.col("format").isin("svs", "philips", "3dhistech", "huron", "mikroscan", "motic", "leica-scn"), F.coalesce(own, F.lit("level")))
    by_lens = F.when(F.col("format") == "ndpi", ndpi_role(F.element_at("tags", F.lit(65421))))
    return known.withColumn("role", F.when(F.col("format") == "ndpi", by_lens).otherwise(F.coalesce(later, own))).withColumn("strategy", strategy(F.col("format"), F.col("is_tiled"), F.col("compression"), F.size("offsets")))


def levels(image_rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Pyramid levels: widest first, planes of one size side by side; a level of no power-of-two scale ends the pyramid.

    ``level_idx, plane, scale, pyramid_index, mpp_x, mpp_y, spacing_x, spacing_y``, grid, bytes; windows hold one file's levels.
    """
    own = image_rows.where("role = 'level' and width > 0")
    sized = own.select(
        "path", "format", "page_idx", "strategy", F.col("width").alias("image_w"), F.col("height").alias("image_h"), "tile_w", "tile_h", "compression", "base_mpp_x", "base_mpp_y",
        (F.aggregate("bytecounts", F.lit(0).cast("bigint"), lambda a, n: a + n) + F.size("offsets") * F.coalesce(F.length("jpeg_tables"), F.lit(0))).alias("compressed_size"),
        F.size("offsets").alias("frames"), F.size(F.filter("bytecounts", lambda n: n == 0)).alias("missing"),
        "offsets", "bytecounts", "jpeg_tables", "header", "photometric", "bits", "samples",
    )
    file, size = Window.partitionBy("path"), ["path", "image_w", "image_h"]
    ordered = sized.withColumn("level_idx", F.dense_rank().over(file.orderBy(F.desc("image_w"), F.desc("image_h"))) - 1)
    ordered = ordered.withColumn("plane", F.row_number().over(Window.partitionBy(*size).orderBy("page_idx")) - 1)
    ordered = ordered.withColumn("scale", F.max("image_w").over(file) / F.col("image_w"))
    log = F.log2("scale")
    off = F.abs(log - F.rint(log)) > tolerance
    ended = F.max(F.when(off, 1).otherwise(0)).over(file.orderBy("level_idx").rangeBetween(Window.unboundedPreceding, 0)) == 1
    kept = ordered.withColumn("_ended", ended).where("not _ended").withColumn("pyramid_index", F.when(F.col("format") == "3dhistech", 0).otherwise(F.rint(log).cast("int")))
    spaced = kept.withColumns({"mpp_x": F.col("base_mpp_x") * F.col("scale"), "mpp_y": F.col("base_mpp_y") * F.col("scale")}).withColumns({"spacing_x": F.col("mpp_x") / 1000, "spacing_y": F.col("mpp_y") / 1000})
    return with_tiled_size(spaced.drop("_ended", "base_mpp_x", "base_mpp_y"))
