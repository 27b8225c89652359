"""Tile grids, ranged reads, pyramids, sparse and damaged levels, re-tiling and de-overlap as DataFrame operators.

All of them work per slide or per level key: windows are partitioned by a slide, level or file, whose rows are bounded by
what one file holds; nothing is collected or broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidelake.functions.geometry import ceil_div, grid, modulo, trunc_div


def with_tiled_size(levels: DataFrame) -> DataFrame:
    """``tiled_w, tiled_h, tiles`` of levels with ``image_w, image_h, tile_w, tile_h``; a zero tile means one tile."""
    whole = (F.col("tile_w") == 0) & (F.col("tile_h") == 0)
    size = lambda image, tile: F.when(whole, F.lit(1)).otherwise(ceil_div(F.col(image), F.col(tile))).cast("bigint")
    return levels.withColumns({"tiled_w": size("image_w", "tile_w"), "tiled_h": size("image_h", "tile_h")}).withColumn("tiles", F.col("tiled_w") * F.col("tiled_h"))


def enumerate_tiles(levels: DataFrame) -> DataFrame:
    """One row per tile: ``x, y``, stored frame, pixel box clipped to the image."""
    sized = with_tiled_size(levels)
    exploded = sized.select("*", F.inline(grid(F.col("tiled_w"), F.col("tiled_h"))))
    return exploded.withColumns({
        "frame_index": F.col("y") * F.col("tiled_w") + F.col("x"),
        "left": F.col("x") * F.col("tile_w"),
        "top": F.col("y") * F.col("tile_h"),
        "width": F.least(F.col("tile_w"), F.col("image_w") - F.col("x") * F.col("tile_w")),
        "height": F.least(F.col("tile_h"), F.col("image_h") - F.col("y") * F.col("tile_h")),
    })


def byte_ranges(frames: DataFrame, file: str, order: str, size: str) -> DataFrame:
    """``offset`` of frames stored one behind the other in a file, by their order; frames without size take no room."""
    before = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("offset", F.coalesce(F.sum(F.coalesce(F.col(size), F.lit(0))).over(before), F.lit(0)))


def coalesce_runs(ranges: DataFrame, file: str, offset: str = "offset", size: str = "bytecount") -> DataFrame:
    """Ranges that touch, joined to one read each: ``file, run, start, length, ranges``."""
    order = Window.partitionBy(file).orderBy(offset, size)
    end = F.lag(F.col(offset) + F.col(size)).over(order)
    starts = ranges.withColumn("_new", F.when(end == F.col(offset), 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("_new").over(order))
    return runs.groupBy(file, "run").agg(
        F.min(offset).alias("start"), (F.max(F.col(offset) + F.col(size)) - F.min(offset)).alias("length"), F.count("*").alias("ranges")
    )


def pyramid(levels: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``scale``, ``pyramid_index`` and ``kept``: a level whose scale is no power of two ends its slide's pyramid."""
    order = Window.partitionBy("slide_id").orderBy("level_idx")
    scale = F.first("image_w").over(order) / F.nullif("image_w", F.lit(0))
    log = F.log2(F.col("scale"))
    scaled = levels.withColumn("scale", scale).withColumn("pyramid_no", F.rint(log).cast("int"))
    off = F.abs(log - F.rint(log)) > F.greatest(F.lit(tolerance), 1e-9 * F.abs(log))
    return scaled.withColumn("dyadic", ~off).withColumn("kept", F.max(F.when(off, 1).otherwise(0)).over(order) == 0)


def fill_sparse(grid_rows: DataFrame, stored: DataFrame, keys: list[str], size: str = "bytecount") -> DataFrame:
    """Every grid cell with its status: stored where a frame with bytes exists, else blank."""
    held = stored.where(F.col(size) > 0).select(*keys, size)
    return grid_rows.join(held, keys, "left").withColumn("status", F.when(F.col(size).isNull(), "blank").otherwise("stored"))


def corrupt_edges(tiles: DataFrame, level: list[str], size: str = "bytecount") -> DataFrame:
    """Flags ``right_corrupt, bottom_corrupt`` of a level's last column and row, and ``corrupt`` of each tile.

    An edge with any empty frame is damaged as a whole; the corner isn't looked at, but is damaged if either edge is.
    """
    right, bottom = F.col("x") == F.col("tiled_w") - 1, F.col("y") == F.col("tiled_h") - 1
    over = Window.partitionBy(*level)
    finer = F.col("level_idx") > 0 if "level_idx" in tiles.columns else F.lit(True)
    marked = tiles.withColumns({
        "right_corrupt": F.bool_or(finer & right & ~bottom & (F.col(size) == 0)).over(over),
        "bottom_corrupt": F.bool_or(finer & bottom & ~right & (F.col(size) == 0)).over(over),
    })
    return marked.withColumn("corrupt", (right & F.col("right_corrupt")) | (bottom & F.col("bottom_corrupt")))


def parent_block(tiles: DataFrame, factor: Column) -> DataFrame:
    """The ``factor`` x ``factor`` tiles of a finer level that make up each tile: ``parent_x, parent_y``."""
    return tiles.withColumn("_f", factor).select("*", F.inline(grid(F.col("_f"), F.col("_f"))).alias("dx", "dy")).withColumns(
        {"parent_x": F.col("x") * F.col("_f") + F.col("dx"), "parent_y": F.col("y") * F.col("_f") + F.col("dy")}
    ).drop("_f")


def frame_of_tile(x: Column, y: Column, tile: Column, frame_w: Column, frame_h: Column) -> dict[str, Column]:
    """The stored frame that holds a served tile, and where the tile lies in it."""
    across, down = F.greatest(trunc_div(frame_w, tile), F.lit(1)), F.greatest(trunc_div(frame_h, tile), F.lit(1))
    return {
        "frame_x": trunc_div(x, across) * across,
        "frame_y": trunc_div(y, down) * down,
        "crop_left": modulo(x * tile, F.greatest(frame_w, tile)),
        "crop_top": modulo(y * tile, F.greatest(frame_h, tile)),
    }


def frame_jobs(requests: DataFrame, slide: str) -> DataFrame:
    """Requested tiles grouped by source frame, in order of request: ``tiles`` with their crops, ``first_request``."""
    jobs = requests.groupBy(slide, "frame_x", "frame_y").agg(
        F.sort_array(F.collect_list(F.struct("request", "x", "y", "crop_left", "crop_top"))).alias("tiles"), F.min("request").alias("first_request")
    )
    return jobs


def stripes_of(jobs: DataFrame, tile: Column, stripe_w: Column, stripe_h: Column, frame_w: Column, frame_h: Column, striped_w: Column) -> DataFrame:
    """One row per stripe that a job needs: ``stripe_index``."""
    ox, oy = trunc_div(F.col("frame_x") * tile, stripe_w), trunc_div(F.col("frame_y") * tile, stripe_h)
    nx, ny = F.greatest(trunc_div(frame_w, stripe_w), F.lit(1)), F.greatest(trunc_div(frame_h, stripe_h), F.lit(1))
    return jobs.select("*", F.inline(grid(nx, ny)).alias("sx", "sy")).withColumn("stripe_index", (ox + F.col("sx")) + (oy + F.col("sy")) * striped_w)


def stripe_runs(jobs: DataFrame, level: str, tile: Column, stripe_w: Column, stripe_h: Column, frame_w: Column, frame_h: Column) -> DataFrame:
    """The distinct stripes that all jobs of a level need, as runs down each column of stripes: ``sx, first_row, end_row``.

    A job's stripes are a rectangle; only its columns become rows, its rows stay an interval, and intervals that meet or overlap are one run.
    """
    ox, oy = trunc_div(F.col("frame_x") * tile, stripe_w), trunc_div(F.col("frame_y") * tile, stripe_h)
    nx, ny = F.greatest(trunc_div(frame_w, stripe_w), F.lit(1)), F.greatest(trunc_div(frame_h, stripe_h), F.lit(1))
    columns = jobs.select(level, F.explode(F.sequence(ox, ox + nx - 1)).alias("sx"), oy.alias("from"), (oy + ny).alias("to"))
    order = Window.partitionBy(level, "sx").orderBy("from", "to")
    reached = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = columns.withColumn("_new", F.when(F.col("from") <= reached, 0).otherwise(1))
    runs = starts.withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(level, "sx", "_run").agg(F.min("from").alias("first_row"), F.max("to").alias("end_row")).drop("_run")


def adjusted_tile_size(requested: Column, stripe: Column) -> Column:
    """Stripe size times the power of two nearest to the ratio of the two sizes; the request itself without stripes."""
    ratio = F.greatest(requested, stripe) / F.least(requested, stripe)
    return F.when(stripe.isNull(), requested).otherwise((F.pow(F.lit(2.0), F.rint(F.log2(ratio))) * stripe).cast("bigint"))


def positions_along(areas: DataFrame, area: list[str], order: str, step: str) -> DataFrame:
    """``position``: where each tile starts if all before it took ``step`` (tile less overlap)."""
    before = Window.partitionBy(*area).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return areas.withColumn("position", F.coalesce(F.sum(step).over(before), F.lit(0)))


def boundary_overlap(joints: DataFrame, area: str, boundary: str, boundaries: DataFrame) -> DataFrame:
    """Mean overlap of every boundary of ``boundaries`` over trusted joints, else the area's mean, else 0.

    Trusted joints are joined and of at least 95 confidence; those of boundaries out of range count for the area's mean.
    """
    good = joints.where((F.col("joined") != 0) & (F.col("confidence") >= 95))
    sums = lambda *k: good.groupBy(*k).agg(F.sum("overlap").alias("s"), F.count("*").alias("n"))
    own, whole = sums(area, boundary), sums(area).withColumnsRenamed({"s": "area_s", "n": "area_n"})
    joined = boundaries.join(own, [area, boundary], "left").join(whole, area, "left")
    return joined.select(area, boundary, F.coalesce(F.col("s") / F.col("n"), F.col("area_s") / F.col("area_n"), F.lit(0.0)).alias("overlap"))


def packed_tile(gx: Column, gy: Column, d: Column, sub: Column) -> dict[str, Column]:
    """Where a level-0 tile lies in a coarser stored tile that packs ``d`` x ``d`` of them, each of ``sub`` pixels."""
    return {
        "stored_x": trunc_div(gx, d), "stored_y": trunc_div(gy, d), "source_x": modulo(gx, d) * sub, "source_y": modulo(gy, d) * sub,
    }


def last_placement(placements: DataFrame, cell: list[str], area: str) -> DataFrame:
    """Of several placements on one cell that of the last area."""
    latest = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc(area)))
    return placements.withColumn("_n", latest).where("_n = 1").drop("_n")


def parent_levels(levels: DataFrame, slide: str, order: str, *columns: str) -> DataFrame:
    """``parent_…`` columns: what the next finer level of each level has; null for the finest."""
    finer = Window.partitionBy(slide).orderBy(order)
    return levels.withColumns({f"parent_{c}": F.lag(c).over(finer) for c in columns})


def edge_frame(stripes: Column, per_frame: int, size: int) -> Column:
    """Pixels of the last frame along an axis, where fewer stripes may be left than a whole frame takes."""
    return F.when(stripes % per_frame != 0, stripes % per_frame * size).otherwise(F.lit(per_frame * size))


def one_frame(image: Column, tile: int) -> Column:
    """Pixels read for a level that is one frame: the image and what is left to the next whole tile, or one tile more."""
    return ((F.floor(image / tile) + 1) * tile).cast("int")


def restart_markers(fragments: DataFrame, image: str, order: str) -> DataFrame:
    """``marker``: the restart marker behind each fragment of an image, counted modulo 8."""
    return fragments.withColumn("marker", (0xD0 + (F.row_number().over(Window.partitionBy(image).orderBy(order)) - 1) % 8))


def smallest_stripe(pages: DataFrame, file: str, tiled: Column, width: Column) -> DataFrame:
    """``stripe``: width of the smallest stripe of each file's striped pages; null if none is."""
    return pages.groupBy(file).agg(F.min(F.when(tiled, width)).alias("stripe"))


def regular_places(tiles: DataFrame, overlap_x: Column, overlap_y: Column) -> DataFrame:
    """``place_x, place_y`` of enumerated tiles that overlap by a fixed number of pixels, and ``composed_w, composed_h`` of the image."""
    place = lambda at, tile, overlap: F.col(at) * (F.col(tile) - overlap)
    whole = lambda n, tile, overlap: F.col(n) * F.col(tile) - (F.col(n) - 1) * overlap
    return tiles.withColumns({
        "place_x": place("x", "tile_w", overlap_x), "place_y": place("y", "tile_h", overlap_y),
        "composed_w": whole("tiled_w", "tile_w", overlap_x), "composed_h": whole("tiled_h", "tile_h", overlap_y),
    })


def main_image(images: DataFrame, slide: str, macro: Column, width: str, order: str, column: str) -> DataFrame:
    """``column`` of each slide's main image: the widest that isn't the macro image, the first of equally wide ones; the macro if there is no other."""
    rank = F.struct(F.when(macro, 0).otherwise(1), F.coalesce(width, F.lit(0)), -F.col(order))
    return images.groupBy(slide).agg(F.max_by(column, rank).alias(column))


def place_on_canvas(tiles: DataFrame, canvas: list[Column], at: str, size: int) -> DataFrame:
    """``pos``: places shifted so that each canvas begins at 0, and ``canvas``, its extent."""
    over = Window.partitionBy(*canvas)
    low = F.min(at).over(over)
    return tiles.withColumns({"pos": F.col(at) - low, "canvas": F.max(F.col(at) + size).over(over) - low})
