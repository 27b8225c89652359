"""Scanned areas of a slide out of its XML, with measured overlaps: from joints to places on one canvas.

One row per area, boundary or tile; windows and groups hold one area's rows. XML is read by pattern, so that a damaged
description gives no rows instead of failing a query.

Defined results
* areas not scanned are left out but keep their number, by which origins are found; a missing origin is 0, 0;
* joints count if they are joined with a confidence of at least 95; left is as right, down as up;
* a boundary without joints takes the area's mean of its axis, else 0; joints out of the grid count for that mean;
* of areas that cover one cell of the canvas the last one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidelake.functions.geometry import round_half_even, serpentine
from slidelake.functions.metadata import xml_attribute
from slidelake.operators.tiles import boundary_overlap, last_placement, positions_along

_BLOCK = r"(?s)(<ImageInfo\s[^>]*?(?:/>|>.*?</ImageInfo>))"


def _number(xml: Column, element: str, name: str, default: float, kind: str = "double") -> Column:
    return F.coalesce(xml_attribute(xml, element, name).try_cast(kind), F.lit(default).cast(kind))


def scanned_areas(slides: DataFrame, xmp: str) -> DataFrame:
    """``path, area, cols, rows, tile_w, tile_h, origin_col, origin_row, xml`` of every scanned area."""
    blocks = slides.select("path", F.col(xmp).alias("x"), F.posexplode(F.regexp_extract_all(xmp, F.lit(_BLOCK), F.lit(1))).alias("area", "xml"))
    n = lambda name, default, kind="double": _number(F.col("xml"), "ImageInfo", name, default, kind)
    known = blocks.where(_number(F.col("xml"), "ImageInfo", "AOIScanned", 1, "int") != 0)
    # the origin of area k is an attribute of element AOIk
    own = F.regexp_substr("x", F.concat(F.lit("<AOI"), F.col("area").cast("string"), F.lit(r"\s[^>]*>")))
    at = lambda name: F.coalesce(F.regexp_extract(own, rf"\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1).try_cast("double"), F.lit(0.0))
    sized = known.select("path", "area", "xml", n("NumCols", 0, "int").alias("cols"), n("NumRows", 0, "int").alias("rows"), n("Width", 1).alias("tile_w"), n("Height", 1).alias("tile_h"), at("OriginX").alias("ox"), at("OriginY").alias("oy"))
    cell = lambda o, size: F.coalesce(round_half_even(F.col(o) / F.nullif(size, F.lit(0.0))), F.lit(0))
    return sized.withColumns({"origin_col": cell("ox", "tile_w"), "origin_row": cell("oy", "tile_h")}).drop("ox", "oy")


def joints(areas: DataFrame) -> DataFrame:
    """``path, area, axis, boundary, overlap, joined, confidence`` of every joint; axis x or y, boundary the lower of its two cells."""
    each = areas.select("path", "area", "cols", "rows", F.explode(F.regexp_extract_all("xml", F.lit(r"(<TileJointInfo\s[^>]*>)"), F.lit(1))).alias("j")).where("cols > 0 and rows > 0")
    n = lambda name, default, kind: _number(F.col("j"), "TileJointInfo", name, default, kind)
    cells = each.withColumns({f"c{i}": serpentine(n(f"Tile{i}", 1, "int"), F.col("cols"), F.col("rows")) for i in (1, 2)})
    direction = xml_attribute(F.col("j"), "TileJointInfo", "Direction")
    axis = F.when(direction.isin("LEFT", "RIGHT"), "x").when(direction.isin("UP", "DOWN"), "y")
    across = axis == "x"
    return cells.select(
        "path", "area", axis.alias("axis"), F.when(across, F.least("c1.col", "c2.col")).otherwise(F.least("c1.row", "c2.row")).alias("boundary"),
        F.when(across, n("OverlapX", 0, "double")).otherwise(n("OverlapY", 0, "double")).alias("overlap"), n("FlagJoined", 0, "int").alias("joined"), n("Confidence", 0, "double").alias("confidence"),
    ).where("axis is not null")


def boundaries(areas: DataFrame) -> DataFrame:
    """``path, area, axis, boundary, overlap``: the overlap of every boundary inside every area's grid."""
    spine = areas.select("path", "area", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("n")) for a, c in (("x", "cols"), ("y", "rows"))]))).where("n > 1")
    grid = spine.select("path", "area", "axis", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("boundary"))
    key = F.concat_ws("\x1f", "path", F.col("area").cast("string"), "axis").alias("key")
    mean = boundary_overlap(joints(areas).select(key, F.col("boundary").cast("bigint").alias("boundary"), "overlap", "joined", "confidence"), "key", "boundary", grid.select(key, F.col("boundary").cast("bigint").alias("boundary")))
    part = F.split("key", "\x1f")
    return mean.select(F.get(part, F.lit(0)).alias("path"), F.get(part, F.lit(1)).cast("int").alias("area"), F.get(part, F.lit(2)).alias("axis"), "boundary", "overlap")


def placements(areas: DataFrame) -> DataFrame:
    """``path, area, grid_x, grid_y, x, y`` of every stored tile on the slide's canvas, whose least place is 0, 0.

    Along each axis a tile follows its neighbour by a tile less their overlap; an area is shifted by its origin, in tiles.
    """
    sizes = areas.select("path", "area", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("n"), F.col(t).alias("tile"), F.col(o).alias("origin")) for a, c, t, o in (("x", "cols", "tile_w", "origin_col"), ("y", "rows", "tile_h", "origin_row"))])))
    steps = sizes.where("n > 0").select("path", "area", "axis", "tile", "origin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("boundary"))
    stepped = steps.join(boundaries(areas), ["path", "area", "axis", "boundary"], "left").withColumn("step", F.col("tile") - F.coalesce("overlap", F.lit(0.0)))
    placed = positions_along(stepped, ["path", "area", "axis"], "boundary", "step").withColumn("at", F.col("position") + F.col("origin") * F.col("tile"))
    side = lambda a, cell, at: placed.where(F.col("axis") == a).select("path", "area", (F.col("boundary") + F.col("origin")).alias(cell), F.col("at").alias(at))
    cells = last_placement(side("x", "grid_x", "px").join(side("y", "grid_y", "py"), ["path", "area"]), ["path", "grid_x", "grid_y"], "area")
    slide = Window.partitionBy("path")
    return cells.select("path", "area", "grid_x", "grid_y", (F.col("px") - F.min("px").over(slide)).alias("x"), (F.col("py") - F.min("py").over(slide)).alias("y"))
