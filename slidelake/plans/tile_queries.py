"""Queries over tile grids, pyramids, ranged reads, re-tiling and de-overlap, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidelake.common import table
from slidelake.functions import formats as f
from slidelake.functions import geometry as g
from slidelake.operators import tiles as t
from slidelake.plans.registry import Registry

registry = Registry()
q = registry.add

LEVELS = "(SELECT DISTINCT * FROM levels)"


def levels(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Levels without their repeated rows."""
    df = table(spark, d, "levels")
    # repeated rows are equal in every column, so those asked for, the key among them, tell levels apart as well
    return (df.select(*columns) if columns else df).distinct()


@q(
    "contiguous_runs",
    f"""WITH r AS (SELECT slide_id, level_idx, compression, CAST(compressed_size AS BIGINT) AS bytecount,
      CAST(coalesce(sum(coalesce(compressed_size, 0)) OVER (PARTITION BY slide_id ORDER BY level_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM {LEVELS}),
    k AS (SELECT * FROM r WHERE compression IS NOT NULL AND bytecount > 0),
    n AS (SELECT *, CASE WHEN lag(start + bytecount) OVER (PARTITION BY slide_id ORDER BY start, bytecount) = start THEN 0 ELSE 1 END AS fresh FROM k),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY slide_id ORDER BY start, bytecount) AS run FROM n)
    SELECT slide_id, CAST(run AS BIGINT) AS run, CAST(min(start) AS BIGINT) AS start, CAST(max(start + bytecount) - min(start) AS BIGINT) AS length, count(*) AS ranges
    FROM i GROUP BY slide_id, run""",
)
def contiguous_runs(spark, d):
    """Levels stored one behind the other; those without codec aren't read; reads that touch become one."""
    stored = levels(spark, d, "slide_id", "level_idx", "compression", F.col("compressed_size").alias("bytecount"))
    ranges = t.byte_ranges(stored, "slide_id", "level_idx", "bytecount").where("compression is not null and bytecount > 0")
    return t.coalesce_runs(ranges, "slide_id")


@q(
    "frame_ranges",
    f"""SELECT slide_id, level_idx, CAST(coalesce(sum(coalesce(compressed_size, 0)) OVER w, 0) AS BIGINT) AS start_byte,
      CAST(coalesce(sum(coalesce(compressed_size, 0)) OVER w, 0) + coalesce(compressed_size, 0) AS BIGINT) AS end_byte
    FROM {LEVELS} WINDOW w AS (PARTITION BY slide_id ORDER BY level_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def frame_ranges(spark, d):
    """First byte and end of every level."""
    stored = levels(spark, d, "slide_id", "level_idx", F.coalesce("compressed_size", F.lit(0)).alias("n"))
    r = t.byte_ranges(stored, "slide_id", "level_idx", "n")
    return r.select("slide_id", "level_idx", F.col("offset").alias("start_byte"), (F.col("offset") + F.col("n")).alias("end_byte"))


@q(
    "compressed_size",
    f"""SELECT slide_id, CAST(sum(compressed_size + frame_count * CASE WHEN compression = 'JPEG' THEN 289 ELSE 0 END) AS BIGINT) AS total_bytes, CAST(sum(frame_count) AS BIGINT) AS frames
    FROM {LEVELS} WHERE compressed_size IS NOT NULL GROUP BY slide_id""",
)
def compressed_size(spark, d):
    """Bytes of a slide's levels with the shared header counted once per JPEG frame."""
    df = levels(spark, d).where("compressed_size is not null")
    header = F.when(F.col("compression") == "JPEG", 289).otherwise(0)
    return df.groupBy("slide_id").agg(F.sum(F.col("compressed_size") + F.col("frame_count") * header).alias("total_bytes"), F.sum("frame_count").alias("frames"))


@q(
    "compressed_size_all",
    f"""SELECT slide_id, CAST(sum(compressed_size + frame_count * CASE WHEN compression = 'JPEG' THEN 289 ELSE 0 END) AS BIGINT) AS total_bytes, CAST(sum(frame_count) AS BIGINT) AS frames
    FROM {LEVELS} GROUP BY slide_id""",
)
def compressed_size_all(spark, d):
    """``compressed_size`` with the frames of all levels; levels of unknown size add no bytes, a slide of such levels alone has null."""
    header = F.when(F.col("compression") == "JPEG", 289).otherwise(0)
    return levels(spark, d).groupBy("slide_id").agg(F.sum(F.col("compressed_size") + F.col("frame_count") * header).alias("total_bytes"), F.sum("frame_count").alias("frames"))


@q(
    "tiled_size",
    """SELECT slide_id, level_idx, tiled_w, tiled_h, tiled_w * tiled_h AS tiles, tiled_w * tiled_h = frame_count AS complete FROM (
      SELECT slide_id, level_idx, frame_count, CAST(ceil(image_w / tile_w) AS BIGINT) AS tiled_w, CAST(ceil(image_h / tile_h) AS BIGINT) AS tiled_h FROM (SELECT DISTINCT * FROM levels))""",
)
def tiled_size(spark, d):
    """Grid of every level, and whether it has a frame for each cell."""
    s = t.with_tiled_size(levels(spark, d))
    return s.select("slide_id", "level_idx", "tiled_w", "tiled_h", "tiles", (F.col("tiles") == F.col("frame_count")).alias("complete"))


def part_levels(spark: SparkSession, d: str) -> DataFrame:
    """One small image per part."""
    p = table(spark, d, "part")
    return p.select("p_partkey", (F.col("p_size") * 100 + 57).alias("image_w"), (F.col("p_size") * 60 + 31).alias("image_h"), F.lit(256).alias("tile_w"), F.lit(256).alias("tile_h"))


PART_LEVELS = "(SELECT p_partkey, p_size * 100 + 57 AS image_w, p_size * 60 + 31 AS image_h, 256 AS tile_w, 256 AS tile_h FROM part)"
PART_GRID = f"""(SELECT p_partkey, image_w, image_h, CAST(ceil(image_w / 256) AS BIGINT) AS tiled_w, CAST(ceil(image_h / 256) AS BIGINT) AS tiled_h, xs.x, ys.y FROM {PART_LEVELS} p,
  LATERAL (SELECT unnest(range(0, CAST(ceil(p.image_w / 256) AS BIGINT))) AS x) xs, LATERAL (SELECT unnest(range(0, CAST(ceil(p.image_h / 256) AS BIGINT))) AS y) ys)"""


@q(
    "grid_enumerate",
    f"""SELECT p_partkey, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(y * tiled_w + x AS BIGINT) AS frame_index, CAST(x * 256 AS INT) AS "left", CAST(y * 256 AS INT) AS top,
      CAST(least(256, image_w - x * 256) AS INT) AS width, CAST(least(256, image_h - y * 256) AS INT) AS height FROM {PART_GRID}""",
)
def grid_enumerate(spark, d):
    """Every tile of every image with its frame and pixel box."""
    return t.enumerate_tiles(part_levels(spark, d)).select("p_partkey", "x", "y", "frame_index", "left", "top", "width", "height")


@q(
    "edge_tile_padding",
    f"""SELECT p_partkey, CAST((256 - image_w % 256) % 256 AS INT) AS pad_right, CAST((256 - image_h % 256) % 256 AS INT) AS pad_bottom, CAST(ceil(image_w / 256) - 1 AS BIGINT) AS last_x, CAST(ceil(image_h / 256) - 1 AS BIGINT) AS last_y
    FROM {PART_LEVELS}""",
)
def edge_tile_padding(spark, d):
    """Pixels by which the last column and row are padded."""
    s = t.with_tiled_size(part_levels(spark, d))
    pad = lambda image, tile: ((F.col(tile) - F.col(image) % F.col(tile)) % F.col(tile)).cast("int")
    return s.select("p_partkey", pad("image_w", "tile_w").alias("pad_right"), pad("image_h", "tile_h").alias("pad_bottom"), (F.col("tiled_w") - 1).alias("last_x"), (F.col("tiled_h") - 1).alias("last_y"))


@q(
    "tile_inside",
    f"""SELECT l_partkey, count(*) AS requests, CAST(sum(CASE WHEN x >= 0 AND y >= 0 AND x < tiled_w AND y < tiled_h THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM (
      SELECT l_partkey, l_linenumber - 2 AS x, l_suppkey % 13 AS y, ceil(image_w / 256) AS tiled_w, ceil(image_h / 256) AS tiled_h FROM lineitem JOIN {PART_LEVELS} ON l_partkey = p_partkey) GROUP BY l_partkey""",
)
def tile_inside(spark, d):
    """Requested tiles that lie in their image's grid; coordinates below zero don't."""
    sized = t.with_tiled_size(part_levels(spark, d)).select("p_partkey", "tiled_w", "tiled_h")
    r = table(spark, d, "lineitem").select("l_partkey", (F.col("l_linenumber") - 2).alias("x"), (F.col("l_suppkey") % 13).alias("y"))
    ok = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("tiled_w")) & (F.col("y") < F.col("tiled_h"))
    return r.join(sized, r.l_partkey == sized.p_partkey).groupBy("l_partkey").agg(F.count("*").alias("requests"), F.count_if(ok).alias("inside"))


_BOX = "l_partkey % 97 AS x, l_suppkey % 53 AS y, CAST(l_quantity AS BIGINT) AS w, l_linenumber * 9 AS h"


@q(
    "region_crop",
    f"""SELECT l_orderkey, l_linenumber, CAST(greatest(x, 10) AS BIGINT) AS crop_x, CAST(greatest(y, 5) AS BIGINT) AS crop_y,
      CAST(greatest(least(x + w, 70) - greatest(x, 10), 0) AS BIGINT) AS crop_w, CAST(greatest(least(y + h, 45) - greatest(y, 5), 0) AS BIGINT) AS crop_h,
      x >= 10 AND y >= 5 AND x + w <= 70 AND y + h <= 45 AS inside FROM (SELECT l_orderkey, l_linenumber, {_BOX} FROM lineitem)""",
)
def region_crop(spark, d):
    """Part of each rectangle that lies in a fixed one."""
    c = F.col
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") % 97).alias("x"), (c("l_suppkey") % 53).alias("y"), c("l_quantity").cast("bigint").alias("w"), (c("l_linenumber") * 9).alias("h"))
    box = [c("x"), c("y"), c("w"), c("h"), F.lit(10), F.lit(5), F.lit(60), F.lit(40)]
    r = r.withColumns({"k": g.crop(*box), "inside": g.inside(*box)})
    return r.select("l_orderkey", "l_linenumber", *[c(f"k.{n}").cast("bigint").alias(f"crop_{n}") for n in "xywh"], "inside")


@q(
    "point_arith",
    """SELECT l_orderkey, l_linenumber, CAST(trunc(a / b) AS BIGINT) AS quotient, CAST(((a % b) + b) % b AS BIGINT) AS remainder, CAST(ceil(a / b) AS BIGINT) AS quotient_up, CAST(trunc(a * 0.75) AS BIGINT) AS scaled
    FROM (SELECT l_orderkey, l_linenumber, l_partkey - l_suppkey * 11 AS a, l_linenumber + 2 AS b FROM lineitem)""",
)
def point_arith(spark, d):
    """Quotients, remainders and products of points, negative ones included."""
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") - F.col("l_suppkey") * 11).alias("a"), (F.col("l_linenumber") + 2).alias("b"))
    a, b = F.col("a"), F.col("b")
    return r.select("l_orderkey", "l_linenumber", g.trunc_div(a, b).alias("quotient"), g.modulo(a, b).cast("bigint").alias("remainder"), g.ceil_div(a, b).cast("bigint").alias("quotient_up"), g.scale_trunc(a, 0.75).alias("scaled"))


@q(
    "size_extremes",
    """SELECT slide_id, max(image_w) AS widest, max(image_h) AS highest, min(image_w) AS narrowest, min(image_h) AS lowest, bool_or(compression IS NULL) AS any_unknown, bool_and(tile_w = tile_h) AS all_square
    FROM levels GROUP BY slide_id""",
)
def size_extremes(spark, d):
    """Element-wise extremes of a slide's sizes, and any/all tests over its levels."""
    return table(spark, d, "levels").groupBy("slide_id").agg(
        F.max("image_w").alias("widest"), F.max("image_h").alias("highest"), F.min("image_w").alias("narrowest"), F.min("image_h").alias("lowest"),
        F.bool_or(F.col("compression").isNull()).alias("any_unknown"), F.bool_and(F.col("tile_w") == F.col("tile_h")).alias("all_square"),
    )


@q(
    "pyramid_index",
    f"""WITH s AS (SELECT *, first_value(image_w) OVER (PARTITION BY slide_id ORDER BY level_idx) / image_w AS scale FROM {LEVELS}),
    o AS (SELECT *, abs(log2(scale) - round_even(log2(scale), 0)) > 0.01 AS off FROM s)
    SELECT slide_id, level_idx, CAST(round_even(log2(scale), 0) AS INT) AS pyramid_no, NOT off AS dyadic,
      max(CASE WHEN off THEN 1 ELSE 0 END) OVER (PARTITION BY slide_id ORDER BY level_idx) = 0 AS kept, round_even(log2(scale), 0) = pyramid_index AS as_recorded FROM o""",
)
def pyramid_index(spark, d):
    """Pyramid number of every level; what follows a level of no power of two is dropped."""
    return t.pyramid(levels(spark, d)).select("slide_id", "level_idx", "pyramid_no", "dyadic", "kept", (F.col("pyramid_no") == F.col("pyramid_index")).alias("as_recorded"))


@q(
    "pixel_spacing",
    f"""SELECT l.slide_id, level_idx, CAST(10.0 AS DOUBLE) / magnification * (first_value(image_w) OVER (PARTITION BY l.slide_id ORDER BY level_idx) / image_w) AS mpp,
      CAST(10.0 AS DOUBLE) / magnification * (first_value(image_w) OVER (PARTITION BY l.slide_id ORDER BY level_idx) / image_w) / 1000 AS spacing
    FROM {LEVELS} l JOIN slides s ON l.slide_id = s.slide_id WHERE magnification > 0""",
)
def pixel_spacing(spark, d):
    """Pixel size of every level from its slide's magnification and its scale."""
    s = table(spark, d, "slides").where("magnification > 0").select("slide_id", "magnification")
    lv = t.pyramid(levels(spark, d)).select("slide_id", "level_idx", "scale").join(s, "slide_id")
    mpp = F.lit(10.0) / F.col("magnification") * F.col("scale")
    return lv.select("slide_id", "level_idx", mpp.alias("mpp"), (mpp / 1000).alias("spacing"))


_STORED = "(SELECT DISTINCT l_partkey AS p_partkey, CAST(l_linenumber - 1 AS BIGINT) AS x, l_suppkey % 5 AS y, CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE 1 END AS n FROM lineitem)"


def stored_tiles(spark: SparkSession, d: str) -> DataFrame:
    """A tile per ordered line, some of them empty; the largest of a cell counts."""
    li = table(spark, d, "lineitem")
    cells = li.select(F.col("l_partkey").alias("p_partkey"), (F.col("l_linenumber") - 1).alias("x"), (F.col("l_suppkey") % 5).alias("y"), F.when(F.col("l_orderkey") % 7 == 0, 0).otherwise(1).alias("bytecount"))
    return cells.groupBy("p_partkey", "x", "y").agg(F.max("bytecount").alias("bytecount"))


@q(
    "sparse_fill",
    f"""SELECT g.p_partkey, CAST(count(*) AS BIGINT) AS tiles, CAST(sum(CASE WHEN s.n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS stored, CAST(sum(CASE WHEN s.n > 0 THEN 0 ELSE 1 END) AS BIGINT) AS blank
    FROM {PART_GRID} g LEFT JOIN (SELECT p_partkey, x, y, max(n) AS n FROM {_STORED} GROUP BY ALL) s ON g.p_partkey = s.p_partkey AND g.x = s.x AND g.y = s.y GROUP BY g.p_partkey""",
)
def sparse_fill(spark, d):
    """Stored and blank tiles of every image: those stored inside the grid, and the rest of it."""
    sized = t.with_tiled_size(part_levels(spark, d)).select("p_partkey", "tiled_w", "tiled_h", "tiles")
    held = stored_tiles(spark, d).where("bytecount > 0").join(sized, "p_partkey").where("x >= 0 and y >= 0 and x < tiled_w and y < tiled_h")
    counts = held.groupBy("p_partkey").agg(F.count("*").alias("stored"))
    n = F.coalesce("stored", F.lit(0))
    return sized.join(counts, "p_partkey", "left").where("tiles > 0").select("p_partkey", "tiles", n.alias("stored"), (F.col("tiles") - n).alias("blank"))


@q(
    "first_valid_frame",
    f"SELECT slide_id, min(level_idx) FILTER (WHERE compressed_size > 0) AS first_level, count(*) FILTER (WHERE compressed_size IS NULL) AS unknown FROM {LEVELS} GROUP BY slide_id",
)
def first_valid_frame(spark, d):
    """First level with bytes; null if there is none."""
    return levels(spark, d).groupBy("slide_id").agg(F.min(F.when(F.col("compressed_size") > 0, F.col("level_idx"))).alias("first_level"), F.count_if(F.col("compressed_size").isNull()).alias("unknown"))


@q(
    "corrupt_edges",
    f"""WITH f AS (SELECT g.p_partkey, g.x, g.y, tiled_w, tiled_h, coalesce(s.n, 1) AS n FROM {PART_GRID} g LEFT JOIN (SELECT p_partkey, x, y, max(n) AS n FROM {_STORED} GROUP BY ALL) s ON g.p_partkey = s.p_partkey AND g.x = s.x AND g.y = s.y),
    m AS (SELECT *, bool_or(n = 0 AND x = tiled_w - 1 AND y < tiled_h - 1) OVER (PARTITION BY p_partkey) AS r, bool_or(n = 0 AND y = tiled_h - 1 AND x < tiled_w - 1) OVER (PARTITION BY p_partkey) AS b FROM f)
    SELECT p_partkey, CAST(x AS INT) AS x, CAST(y AS INT) AS y, (x = tiled_w - 1 AND r) OR (y = tiled_h - 1 AND b) AS corrupt FROM m""",
)
def corrupt_edges(spark, d):
    """Tiles on damaged right and bottom edges."""
    full = t.enumerate_tiles(part_levels(spark, d)).select("p_partkey", "x", "y", "tiled_w", "tiled_h")
    held = full.join(stored_tiles(spark, d), ["p_partkey", "x", "y"], "left").withColumn("bytecount", F.coalesce("bytecount", F.lit(1)))
    return t.corrupt_edges(held, ["p_partkey"]).select("p_partkey", "x", "y", "corrupt")


@q(
    "parent_block",
    """SELECT x, y, f, CAST(x * f + dx.v AS BIGINT) AS parent_x, CAST(y * f + dy.v AS BIGINT) AS parent_y, count(*) AS n FROM (SELECT l_partkey % 40 AS x, l_suppkey % 30 AS y, CASE WHEN l_linenumber > 4 THEN 4 ELSE 2 END AS f FROM lineitem) l,
      LATERAL (SELECT unnest(range(0, l.f)) AS v) dx, LATERAL (SELECT unnest(range(0, l.f)) AS v) dy GROUP BY ALL""",
)
def parent_block(spark, d):
    """Tiles of the finer level under each tile."""
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 30).alias("y"), F.when(F.col("l_linenumber") > 4, 4).otherwise(2).alias("f"))
    return t.parent_block(li.groupBy("x", "y", "f").agg(F.count("*").alias("n")), F.col("f")).select("x", "y", "f", "parent_x", "parent_y", "n")


@q(
    "parent_chain",
    f"SELECT slide_id, level_idx, lag(level_idx) OVER w AS parent_level, CAST(lag(image_w) OVER w AS BIGINT) AS parent_w FROM {LEVELS} WINDOW w AS (PARTITION BY slide_id ORDER BY level_idx)",
)
def parent_chain(spark, d):
    """The next finer level of each."""
    p = t.parent_levels(levels(spark, d, "slide_id", "level_idx", "image_w"), "slide_id", "level_idx", "level_idx", "image_w")
    return p.select("slide_id", "level_idx", F.col("parent_level_idx").alias("parent_level"), F.col("parent_image_w").cast("bigint").alias("parent_w"))


@q(
    "downscale_2x",
    """SELECT vec_id, k.i AS cell, (CAST(embedding[1 + (k.i // 4) * 16 + (k.i % 4) * 2] AS DOUBLE) + CAST(embedding[2 + (k.i // 4) * 16 + (k.i % 4) * 2] AS DOUBLE)
      + CAST(embedding[9 + (k.i // 4) * 16 + (k.i % 4) * 2] AS DOUBLE) + CAST(embedding[10 + (k.i // 4) * 16 + (k.i % 4) * 2] AS DOUBLE)) / 4 AS v
    FROM embeddings, LATERAL (SELECT CAST(unnest(range(0, 16)) AS INT) AS i) k""",
)
def downscale_2x(spark, d):
    """8 x 8 tiles halved by the mean of four pixels."""
    e = F.col("embedding").cast("array<double>")
    at = lambda i, k: F.get(F.col("e"), ((i / 4).cast("int") * 16 + (i % 4) * 2 + k).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (at(i, 0) + at(i, 1) + at(i, 8) + at(i, 9)) / 4)
    return table(spark, d, "embeddings").select("vec_id", e.alias("e")).select("vec_id", F.posexplode(cells).alias("cell", "v"))


@q(
    "crop_pad_tile",
    """SELECT vec_id, k.i AS cell, CASE WHEN k.i % 8 < 5 AND k.i // 8 < 6 THEN CAST(embedding[1 + (k.i // 8 + 2) * 8 + k.i % 8 + 3] AS DOUBLE) ELSE 1.0 END AS v
    FROM embeddings, LATERAL (SELECT CAST(unnest(range(0, 64)) AS INT) AS i) k""",
)
def crop_pad_tile(spark, d):
    """The lower right 5 x 6 pixels of a tile, padded with the fill value to a whole tile."""
    held = lambda i: (i % 8 < 5) & ((i / 8).cast("int") < 6)
    pixel = lambda i: F.get(F.col("e"), ((i / 8).cast("int") + 2) * 8 + i % 8 + 3)
    cells = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(held(i), pixel(i)).otherwise(F.lit(1.0)))
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", F.posexplode(cells).alias("cell", "v"))


@q(
    "concat_strips",
    """SELECT label, count(*) AS strips, CAST(sum(h) AS BIGINT) AS image_h, arg_min(w, vec_id) AS image_w, CAST(max(top) AS BIGINT) AS last_top FROM (
      SELECT label, vec_id, 8 + vec_id % 3 AS h, 8 + vec_id % 5 AS w, coalesce(sum(8 + vec_id % 3) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM embeddings) GROUP BY label""",
)
def concat_strips(spark, d):
    """Strips of one image put together: height of all, width of the first, top of the last."""
    s = table(spark, d, "embeddings").select("label", "vec_id", (8 + F.col("vec_id") % 3).alias("h"), (8 + F.col("vec_id") % 5).alias("w"))
    tops = t.positions_along(s, ["label"], "vec_id", "h")
    return tops.groupBy("label").agg(F.count("*").alias("strips"), F.sum("h").alias("image_h"), F.min_by("w", "vec_id").alias("image_w"), F.max("position").alias("last_top"))


@q(
    "blank_dct_block",
    """SELECT vec_id, CAST(round_even((least(greatest(CAST(embedding[1] AS DOUBLE) + 0.5, 0.0), 1.0) * 2047 - 1024) / (8 + label), 0) AS BIGINT) AS dc, 63 AS zeros FROM embeddings""",
)
def blank_dct_block(spark, d):
    """Quantised DC coefficient of a constant block of each tile's first pixel; all others are zero."""
    luma = F.least(F.greatest(F.get("embedding", F.lit(0)).cast("double") + 0.5, F.lit(0.0)), F.lit(1.0))
    return table(spark, d, "embeddings").select("vec_id", g.round_half_even((luma * 2047 - 1024) / (8 + F.col("label"))).alias("dc"), F.lit(63).alias("zeros"))


@q(
    "adjust_tile_size",
    """SELECT p_partkey, CAST(pow(2, round_even(log2(greatest(r, s) / least(r, s)), 0)) * s AS BIGINT) AS tile_size FROM (SELECT p_partkey, 512 AS r, p_size * 8 AS s FROM part)""",
)
def adjust_tile_size(spark, d):
    """Tile size served for a request of 512 over stripes of different size."""
    return table(spark, d, "part").select("p_partkey", t.adjusted_tile_size(F.lit(512), F.col("p_size") * 8).alias("tile_size"))


@q("smallest_stripe", "SELECT p_brand, min(p_size * 8) FILTER (WHERE p_type <> 'ECONOMY') AS stripe FROM part GROUP BY p_brand")
def smallest_stripe(spark, d):
    """Smallest stripe over the tiled pages; null if none is tiled."""
    return t.smallest_stripe(table(spark, d, "part"), "p_brand", F.col("p_type") != "ECONOMY", F.col("p_size") * 8)


_REQUESTS = """(SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS request,
  l_linenumber AS x, l_suppkey % 12 AS y, CASE WHEN l_partkey % 2 = 0 THEN 2048 ELSE 4096 END AS fw FROM lineitem)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Tile requests per part, numbered, with the frame width of their level."""
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    li = table(spark, d, "lineitem")
    return li.select("l_partkey", F.row_number().over(w).alias("request"), F.col("l_linenumber").alias("x"), (F.col("l_suppkey") % 12).alias("y"), F.when(F.col("l_partkey") % 2 == 0, 2048).otherwise(4096).alias("fw"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Requests with frame and crop; tiles of 512, frames of 512 in height."""
    return requests(spark, d).withColumns(t.frame_of_tile(F.col("x"), F.col("y"), F.lit(512), F.col("fw"), F.lit(512)))


@q(
    "frame_jobs",
    f"""SELECT l_partkey, CAST(x // (fw // 512) * (fw // 512) AS BIGINT) AS frame_x, CAST(y AS BIGINT) AS frame_y, count(*) AS tiles, min(request) AS first_request, CAST(sum((x * 512) % fw) AS BIGINT) AS crop_sum,
      arg_min(CAST((x * 512) % fw AS BIGINT), request) AS first_left FROM {_REQUESTS} GROUP BY ALL""",
)
def frame_jobs(spark, d):
    """Requested tiles grouped by the frame they are cut from, first request first."""
    jobs = t.frame_jobs(placed(spark, d), "l_partkey")
    first = F.get("tiles", F.lit(0))
    total = F.aggregate("tiles", F.lit(0).cast("bigint"), lambda a, x: a + x.crop_left)
    return jobs.select("l_partkey", "frame_x", "frame_y", F.size("tiles").cast("bigint").alias("tiles"), F.col("first_request").cast("bigint").alias("first_request"), total.alias("crop_sum"), first.crop_left.cast("bigint").alias("first_left"))


@q(
    "stripe_union",
    f"""WITH j AS (SELECT DISTINCT l_partkey, fw, x // (fw // 512) * (fw // 512) AS fx, y AS fy FROM {_REQUESTS})
    SELECT l_partkey, count(*) AS stripes, CAST(min(s) AS BIGINT) AS first_stripe, CAST(max(s) AS BIGINT) AS last_stripe FROM (SELECT DISTINCT l_partkey, (fx * 512) // 2048 + i.v + ((fy * 512) // 8 + k.v) * 25 AS s
      FROM j, LATERAL (SELECT unnest(range(0, greatest(j.fw // 2048, 1))) AS v) i, LATERAL (SELECT unnest(range(0, 64)) AS v) k) GROUP BY l_partkey""",
)
def stripe_union(spark, d):
    """Distinct stripes that all jobs of a level need, each read once."""
    jobs = placed(spark, d).select("l_partkey", "fw", "frame_x", "frame_y").distinct()
    runs = t.stripe_runs(jobs, "l_partkey", F.lit(512), F.lit(2048), F.lit(8), F.col("fw"), F.lit(512))
    first, last = F.col("sx") + F.col("first_row") * 25, F.col("sx") + (F.col("end_row") - 1) * 25
    return runs.groupBy("l_partkey").agg(F.sum(F.col("end_row") - F.col("first_row")).alias("stripes"), F.min(first).alias("first_stripe"), F.max(last).alias("last_stripe"))


@q(
    "partial_frames",
    """SELECT p_partkey, CASE WHEN sw % 4 <> 0 THEN (sw % 4) * 2048 ELSE 8192 END AS last_frame_w, CASE WHEN sh % 64 <> 0 THEN (sh % 64) * 8 ELSE 512 END AS last_frame_h, ((p_size * 100) // 512 + 1) * 512 AS one_frame_w
    FROM (SELECT p_partkey, p_size, p_size % 9 + 1 AS sw, p_size * 3 AS sh FROM part)""",
)
def partial_frames(spark, d):
    """Frame sizes at the right and bottom edge, where fewer stripes are left than a tile takes."""
    p = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") % 9 + 1).alias("sw"), (F.col("p_size") * 3).alias("sh"))
    return p.select("p_partkey", t.edge_frame(F.col("sw"), 4, 2048).alias("last_frame_w"), t.edge_frame(F.col("sh"), 64, 8).alias("last_frame_h"), t.one_frame(F.col("p_size") * 100, 512).alias("one_frame_w"))


@q(
    "regular_overlap",
    f"""SELECT p_partkey, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(x * (256 - p_partkey % 33) AS BIGINT) AS place_x, CAST(y * (256 - p_partkey % 17) AS BIGINT) AS place_y,
      CAST(tiled_w * 256 - (tiled_w - 1) * (p_partkey % 33) AS BIGINT) AS composed_w, CAST(tiled_h * 256 - (tiled_h - 1) * (p_partkey % 17) AS BIGINT) AS composed_h FROM {PART_GRID}""",
)
def regular_overlap(spark, d):
    """Places of tiles that overlap by a fixed number of pixels, and the size of the composed image."""
    placed = t.regular_places(t.enumerate_tiles(part_levels(spark, d)), F.col("p_partkey") % 33, F.col("p_partkey") % 17)
    return placed.select("p_partkey", "x", "y", "place_x", "place_y", "composed_w", "composed_h")


@q(
    "joint_overlap_mean",
    """WITH j AS (SELECT l_suppkey AS area, l_linenumber - 1 AS boundary, CAST(l_quantity AS BIGINT) AS overlap FROM lineitem WHERE l_returnflag <> 'N' AND 80 + l_partkey % 21 >= 95),
    spine AS (SELECT s_suppkey AS area, b.v AS boundary FROM supplier, LATERAL (SELECT CAST(unnest(range(0, 5)) AS INT) AS v) b)
    SELECT s.area, s.boundary, round(coalesce((SELECT sum(overlap) FROM j WHERE j.area = s.area AND j.boundary = s.boundary) / (SELECT count(*) FROM j WHERE j.area = s.area AND j.boundary = s.boundary),
      (SELECT sum(overlap) FROM j WHERE j.area = s.area) / (SELECT count(*) FROM j WHERE j.area = s.area), 0.0), 9) AS overlap FROM spine s""",
)
def joint_overlap_mean(spark, d):
    """Mean overlap of each boundary of an area, from its trusted joints."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("area"), (F.col("l_linenumber") - 1).alias("boundary"), F.col("l_quantity").cast("bigint").alias("overlap"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("joined"), (80 + F.col("l_partkey") % 21).alias("confidence"))
    spine = table(spark, d, "supplier").select(F.col("s_suppkey").alias("area"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("boundary"))
    return t.boundary_overlap(li, "area", "boundary", spine).withColumn("overlap", F.round("overlap", 9))


@q(
    "serpentine",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN ((i - 1) // c) % 2 = 1 THEN c - 1 - (i - 1) % c ELSE (i - 1) % c END AS BIGINT) AS col, CAST(r - 1 - (i - 1) // c AS BIGINT) AS row
    FROM (SELECT l_orderkey, l_linenumber, l_partkey % 77 + 1 AS i, 11 AS c, 7 AS r FROM lineitem)""",
)
def serpentine(spark, d):
    """Grid cell of a scan index along a snake."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", g.serpentine(F.col("l_partkey") % 77 + 1, F.lit(11), F.lit(7)).alias("s"))
    return li.select("l_orderkey", "l_linenumber", F.col("s.col").cast("bigint").alias("col"), F.col("s.row").cast("bigint").alias("row"))


@q(
    "area_positions",
    """WITH o AS (SELECT l_suppkey AS area, l_linenumber AS i, CAST(avg(l_quantity) AS BIGINT) AS overlap FROM lineitem GROUP BY ALL),
    p AS (SELECT *, CAST(coalesce(sum(512 - overlap) OVER (PARTITION BY area ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (area % 10) * 1000 AS BIGINT) AS pos FROM o)
    SELECT area, i, pos - min(pos) OVER (PARTITION BY area % 4) AS pos, max(pos + 512) OVER (PARTITION BY area % 4) - min(pos) OVER (PARTITION BY area % 4) AS canvas FROM p""",
)
def area_positions(spark, d):
    """Running positions of an area's tiles, shifted by its origin onto the canvas of its slide."""
    o = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("area"), F.col("l_linenumber").alias("i")).agg(F.rint(F.avg("l_quantity")).cast("bigint").alias("overlap"))
    p = t.positions_along(o.withColumn("step", 512 - F.col("overlap")), ["area"], "i", "step").withColumn("at", F.col("position") + F.col("area") % 10 * 1000)
    return t.place_on_canvas(p, [F.col("area") % 4], "at", 512).select("area", "i", "pos", "canvas")


@q(
    "packed_downsample",
    """SELECT l_orderkey, l_linenumber, CAST(gx // 4 AS BIGINT) AS stored_x, CAST(gy // 4 AS BIGINT) AS stored_y, CAST((gx % 4) * 128 AS BIGINT) AS source_x, CAST((gy % 4) * 128 AS BIGINT) AS source_y, gx * 500 / 4 AS place_x, CAST(round_even(510 / 4, 0) AS BIGINT) AS piece
    FROM (SELECT l_orderkey, l_linenumber, l_partkey % 61 AS gx, l_suppkey % 41 AS gy FROM lineitem)""",
)
def packed_downsample(spark, d):
    """Where a tile of level 0 lies in the coarser stored tile that packs 4 x 4 of them."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 61).alias("gx"), (F.col("l_suppkey") % 41).alias("gy"))
    return li.withColumns(t.packed_tile(F.col("gx"), F.col("gy"), F.lit(4), F.lit(128))).select("l_orderkey", "l_linenumber", "stored_x", "stored_y", "source_x", "source_y", (F.col("gx") * 500 / 4).alias("place_x"), g.round_half_even(F.lit(510) / 4).alias("piece"))


@q(
    "scanned_areas",
    """SELECT o_custkey, area, doc_idx, origin FROM (SELECT o_custkey, o_orderkey AS area, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS doc_idx FROM orders) a
      LEFT JOIN (SELECT l_orderkey, CAST(min(l_quantity) AS BIGINT) AS origin FROM lineitem GROUP BY 1) s ON a.area = s.l_orderkey WHERE o_orderstatus <> 'O'""".replace("doc_idx, origin FROM", "doc_idx, coalesce(origin, 0) AS origin FROM"),
)
def scanned_areas(spark, d):
    """Scanned areas only, each under the index that it has among all areas; origin 0 where none is recorded."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    a = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("area"), "o_orderstatus", (F.row_number().over(w) - 1).alias("doc_idx")).where("o_orderstatus <> 'O'")
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").cast("bigint").alias("origin"))
    return a.join(o, a.area == o.l_orderkey, "left").select("o_custkey", "area", "doc_idx", F.coalesce("origin", F.lit(0)).alias("origin"))


@q(
    "last_placement",
    """SELECT l_partkey % 50 AS cx, l_suppkey % 20 AS cy, max(l_orderkey) AS area FROM lineitem GROUP BY ALL""",
)
def last_placement(spark, d):
    """Of several areas on one cell of the canvas the last."""
    p = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("cx"), (F.col("l_suppkey") % 20).alias("cy"), F.col("l_orderkey").alias("area"))
    return t.last_placement(p, ["cx", "cy"], "area")


@q("restart_markers", "SELECT slide_id, level_idx, CAST(208 + (row_number() OVER (PARTITION BY slide_id ORDER BY level_idx) - 1) % 8 AS INT) AS marker FROM (SELECT DISTINCT * FROM levels)")
def restart_markers(spark, d):
    """Restart marker behind each fragment, counted modulo 8."""
    return t.restart_markers(levels(spark, d, "slide_id", "level_idx"), "slide_id", "level_idx").select("slide_id", "level_idx", "marker")


@q(
    "unravel_index",
    """SELECT l_orderkey, l_linenumber, CAST((i // 15) % 4 AS BIGINT) AS z, CAST((i // 3) % 5 AS BIGINT) AS c, CAST(i % 3 AS BIGINT) AS t, ((i // 15) % 4) * 2.5 AS focal_plane FROM (SELECT l_orderkey, l_linenumber, l_partkey % 60 AS i FROM lineitem)""",
)
def unravel_index(spark, d):
    """Axis positions of a page index in row-major order, and the focal plane of its z."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", g.unravel(F.col("l_partkey") % 60, [F.lit(4), F.lit(5), F.lit(3)]).alias("p"))
    at = lambda i: F.get("p", F.lit(i)).cast("bigint")
    return li.select("l_orderkey", "l_linenumber", at(0).alias("z"), at(1).alias("c"), at(2).alias("t"), (at(0) * F.lit(2.5)).alias("focal_plane"))


@q(
    "focal_plane",
    """SELECT slide_id, level_idx, CASE WHEN format = 'ndpi' THEN level_idx * 1200 / 1000 WHEN format = 'argos' THEN (-2.0 + level_idx) * 8.0 WHEN format = 'ome-tiff' THEN level_idx * 2.0 ELSE 0.0 END AS focal_plane,
      CASE WHEN format = 'ome-tiff' THEN CAST(level_idx AS VARCHAR) WHEN format = 'qptiff' THEN CAST(level_idx + 1 AS VARCHAR) ELSE '1' END AS optical_path
    FROM (SELECT DISTINCT l.slide_id, level_idx, format FROM levels l JOIN slides s ON l.slide_id = s.slide_id)""",
)
def focal_plane(spark, d):
    """Focal plane and optical path of a page by format."""
    s = table(spark, d, "slides").select("slide_id", "format")
    lv = table(spark, d, "levels").select("slide_id", "level_idx").distinct().join(s, "slide_id")
    fmt, i = F.col("format"), F.col("level_idx")
    plane = f.focal_plane(fmt, i, i * 1200, F.lit(None).cast("double"), F.lit(-2.0), F.when(fmt == "argos", 8.0).otherwise(2.0))
    return lv.select("slide_id", "level_idx", plane.alias("focal_plane"), f.optical_path(fmt, i, i, F.lit(None).cast("string")).alias("optical_path"))


@q(
    "image_crops",
    f"""SELECT l.slide_id, level_idx, CASE format WHEN 'ndpi' THEN CAST(trunc(image_w * 0.3 / 16) AS BIGINT) * 16 WHEN 'argos' THEN image_w - CAST(trunc(image_w * 0.76 / 16) AS BIGINT) * 16 ELSE image_w END AS label_w,
      CASE format WHEN 'leica-scn' THEN CAST(trunc(image_h * 0.72) AS BIGINT) // tile_h ELSE 0 END AS first_row FROM {LEVELS} l JOIN slides s ON l.slide_id = s.slide_id""",
)
def image_crops(spark, d):
    """Size of the label cut out of the overview: left of ndpi, right of argos, bottom tile rows of leica."""
    s = table(spark, d, "slides").select("slide_id", "format")
    lv = levels(spark, d, "slide_id", "level_idx", "image_w", "image_h", "tile_h").join(s, "slide_id")
    crop = f.label_crop(F.col("format"), F.col("image_w"), F.col("image_h"), F.lit(16), F.col("tile_h"))
    return lv.select("slide_id", "level_idx", "tile_h", crop.alias("k")).select("slide_id", "level_idx", F.col("k.width").alias("label_w"), g.trunc_div(F.col("k.top"), F.col("tile_h")).alias("first_row"))


@q(
    "pixel_format",
    """WITH i AS (SELECT DISTINCT slide_id, level_idx, compression, CASE pyramid_index % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS bits, slide_id % 6 = 0 AS palette_grey, slide_id % 5 = 0 AS rgb, slide_id % 2 = 1 AS sampled, slide_id % 7 = 0 AS mct,
      CASE slide_id % 4 WHEN 0 THEN 'RGB' WHEN 1 THEN 'YCBCR' WHEN 2 THEN 'MINISBLACK' ELSE 'PALETTE' END AS tag FROM levels),
    p AS (SELECT *, CASE WHEN palette_grey AND tag = 'PALETTE' THEN 'MINISBLACK' WHEN palette_grey THEN tag WHEN compression = 'JPEG' AND rgb THEN 'RGB' WHEN compression = 'JPEG' AND sampled THEN 'YCBCR'
      WHEN compression IN ('JPEG2000', 'JPEG_2000_LOSSY', 'APERIO_JP2000_YCBC', 'APERIO_JP2000_RGB') AND (mct OR sampled OR compression = 'APERIO_JP2000_YCBC') THEN 'YCBCR' ELSE tag END AS photometric FROM i)
    SELECT slide_id, level_idx, photometric, CASE bits WHEN 8 THEN 'uint8' WHEN 16 THEN 'uint16' ELSE 'uint32' END AS dtype,
      CAST(CASE WHEN photometric IN ('RGB', 'YCBCR', 'MINISWHITE') THEN pow(2, bits) - 1 WHEN photometric = 'MINISBLACK' THEN 0 END AS BIGINT) AS fill, coalesce(compression NOT IN ('NONE', 'JPEGXR_NDPI'), false) AS encoded FROM p""",
)
def pixel_format(spark, d):
    """Colour model by codestream or tag, number type by bit depth, fill value by colour model, and whether tiles are served encoded."""
    n, comp = F.col("slide_id"), F.col("compression")
    bits = F.when(F.col("pyramid_index") % 3 == 0, 8).when(F.col("pyramid_index") % 3 == 1, 16).otherwise(32)
    tag = F.when(n % 4 == 0, "RGB").when(n % 4 == 1, "YCBCR").when(n % 4 == 2, "MINISBLACK").otherwise("PALETTE")
    model = f.photometric(F.when(n % 6 == 0, "3dhistech").otherwise("svs"), comp, tag, n % 5 == 0, (n % 2 + 1).cast("int"), F.lit(1), n % 7 == 0)
    lv = table(spark, d, "levels").select("slide_id", "level_idx", comp.alias("compression"), bits.alias("bits"), model.alias("photometric")).distinct()
    return lv.select("slide_id", "level_idx", "photometric", f.number_type(F.col("bits")).alias("dtype"), f.fill_value(F.col("bits"), F.col("photometric")).alias("fill"), f.encoded(comp).alias("encoded"))


@q(
    "chunk_hint",
    f"SELECT slide_id, level_idx, CASE WHEN tile_w > 0 THEN greatest(2048 // tile_w, 1) ELSE 1 END AS chunk, CAST(ceil(frame_count / greatest(2048 // tile_w, 1)) AS BIGINT) AS chunks FROM {LEVELS}",
)
def chunk_hint(spark, d):
    """Tiles worth asking for at once, and how many such batches a level has."""
    lv = levels(spark, d, "slide_id", "level_idx", "frame_count", "tile_w").withColumn("chunk", f.chunk_hint(F.lit("ndpi"), F.lit(2048), F.col("tile_w")))
    return lv.select("slide_id", "level_idx", "chunk", g.ceil_div(F.col("frame_count"), F.col("chunk")).cast("bigint").alias("chunks"))


@q(
    "raster_order",
    f"SELECT p_partkey, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY y, x) - 1 AS BIGINT) AS nth FROM {PART_GRID}",
)
def raster_order(spark, d):
    """Tiles of an image numbered row by row."""
    e = t.enumerate_tiles(part_levels(spark, d))
    return e.select("p_partkey", "x", "y", F.col("frame_index").alias("nth"))
