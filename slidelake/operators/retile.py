"""Served tiles out of stored stripes, without decoding to pixels.

Requests are grouped by the frame that they are cut from; each frame's stripes are joined once, put together behind the page's
header with restart markers, and all its tiles are cropped losslessly from it. The only rows with bytes that are
shuffled are the stripes, once per frame that needs them; a group holds one frame.

Defined results
* every request gives one row under its number, in whatever order, duplicates included; requests outside the grid give null;
* a frame with a missing or foreign stripe gives null for its tiles; parts of tiles beyond the image are white.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.functions.codestream import join_fragments, mcu_size, with_header
from slidelake.functions.jpeg_codec import crop_many
from slidelake.operators.tiles import frame_jobs, frame_of_tile, stripes_of


@dataclass(frozen=True)
class Layout:
    """A striped level: image and stripe size in pixels, stripes across and down, size of served tiles."""

    image_w: int
    image_h: int
    stripe_w: int
    stripe_h: int
    striped_w: int
    striped_h: int
    tile: int

    @property
    def frame(self) -> tuple[int, int]:
        """Pixels of a source frame: a tile or a stripe, whichever is larger."""
        return max(self.tile, self.stripe_w), max(self.tile, self.stripe_h)


def _cut(level: Layout, rows: dict) -> list[bytes | None]:
    """The tiles of one job."""
    asked, parts = rows["tiles"], sorted(rows["stripes"] or [], key=lambda p: (p["sy"], p["sx"]))
    fw, fh = level.frame
    across = min(fw // level.stripe_w, level.striped_w - rows["frame_x"] * level.tile // level.stripe_w)
    down = min(fh // level.stripe_h, level.striped_h - rows["frame_y"] * level.tile // level.stripe_h)
    try:
        if len(parts) != across * down or any(not p["data"] for p in parts) or not rows["header"]:
            return [None] * len(asked)
        unit_w, unit_h = mcu_size(rows["header"])
        if level.stripe_h != unit_h and across > 1:
            return [None] * len(asked)
        units = -(-level.stripe_w // unit_w) * -(-level.stripe_h // unit_h)
        head = with_header(rows["header"], across * level.stripe_w, down * level.stripe_h, units)
        whole = join_fragments(head, [p["data"] for p in parts])
        return crop_many(whole, [(t["crop_left"], t["crop_top"], level.tile, level.tile) for t in asked])
    except (ValueError, TypeError, KeyError, IndexError, struct.error):
        return [None] * len(asked)


def serve(requests: DataFrame, stripes: DataFrame, headers: DataFrame, level: Layout) -> DataFrame:
    """``path, request, x, y, data`` of every requested tile.

    ``requests``: ``path, request, x, y``; ``stripes``: ``path, frame_index, data``; ``headers``: ``path, header`` (up to the scan).
    """
    fw, fh = (F.lit(v) for v in level.frame)
    tile = F.lit(level.tile)
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") * level.tile < level.image_w) & (F.col("y") * level.tile < level.image_h)
    asked = requests.select("path", "request", "x", "y")
    jobs = frame_jobs(asked.where(inside).withColumns(frame_of_tile(F.col("x"), F.col("y"), tile, fw, fh)), "path")
    needed = stripes_of(jobs.select("path", "frame_x", "frame_y"), tile, F.lit(level.stripe_w), F.lit(level.stripe_h), fw, fh, F.lit(level.striped_w))
    column = (F.col("frame_x") * level.tile / level.stripe_w).cast("int") + F.col("sx")
    needed = needed.where((column < level.striped_w) & (F.col("stripe_index") < level.striped_w * level.striped_h))
    stored = stripes.select("path", F.col("frame_index").cast("bigint").alias("stripe_index"), "data")
    bytes_of = needed.join(stored, ["path", "stripe_index"], "left").groupBy("path", "frame_x", "frame_y").agg(F.collect_list(F.struct("sy", "sx", "data")).alias("stripes"))
    full = jobs.join(bytes_of, ["path", "frame_x", "frame_y"], "left").join(headers.select("path", "header"), "path", "left")
    full = full.select("path", "frame_x", "frame_y", "tiles", "stripes", "header")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                asked_here = row["tiles"]
                found = _cut(level, row)
                columns = [[row["path"]] * len(asked_here), *([t[k] for t in asked_here] for k in ("request", "x", "y")), found]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["path", "request", "x", "y", "data"])

    served = full.mapInArrow(run, "path string, request bigint, x bigint, y bigint, data binary")
    outside = asked.where(~inside).select("path", F.col("request").cast("bigint").alias("request"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), F.lit(None).cast("binary").alias("data"))
    return served.unionByName(outside)
