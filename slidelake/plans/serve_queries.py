"""Queries that serve tiles: levels made of table values go through jobs, serving and decoding like those of files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from slidelake.common import table
from slidelake.functions import codestream as c
from slidelake.functions import jpeg_codec as codec
from slidelake.operators.serving import decoded, serve, tile_jobs
from slidelake.plans.registry import Registry

registry = Registry()
q = registry.add


def _level(rows, strategy: str, image: tuple[int, int], tile: tuple[int, int]):
    """Columns of a level whose frames are at hand in ``blobs``."""
    sizes = {n: F.lit(v) for n, v in zip(("image_w", "image_h", "tile_w", "tile_h"), (*image, *tile))}
    held = {"offsets": F.transform("blobs", lambda _: F.lit(0).cast("bigint")), "bytecounts": F.transform("blobs", lambda b: F.coalesce(F.length(b), F.lit(0)).cast("bigint"))}
    return rows.withColumns({"strategy": F.lit(strategy), "level_idx": F.lit(0), "compression": F.lit("JPEG"), **sizes, **held})


def _hex(n, digits: int):
    return F.lpad(F.hex(n.cast("bigint")), digits, "0")


@q(
    "serve_tiles",
    """SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(x AS INT) AS x, 0 AS y, CASE WHEN x < 2 THEN 'stored' ELSE 'missing' END AS status,
      CASE WHEN x < 2 THEN 'FFD8' || CASE WHEN p_partkey % 2 = 0 THEN 'FFEE000E41646F626500648000000000' ELSE '' END || repeat(lpad(to_hex(p_size), 2, '0'), 3) || CASE x WHEN 0 THEN 'DD' ELSE 'EE' END || lpad(to_hex(p_partkey % 256), 2, '0') || 'FFD9' END AS whole
    FROM part, (SELECT unnest(range(0, 3)) AS x)""",
)
def serve_tiles(spark, d):
    """Abbreviated tiles served whole, with their page's tables and, for RGB, the Adobe segment in front; a tile without frame is missing."""
    p = table(spark, d, "part")
    tile = lambda mark: F.unhex(F.concat(F.lit("FFD8" + mark), _hex(F.col("p_partkey") % 256, 2), F.lit("FFD9")))
    tables = F.unhex(F.concat(F.lit("FFD8"), F.repeat(_hex(F.col("p_size"), 2), 3), F.lit("FFD9")))
    rows = p.select(F.col("p_partkey").cast("string").alias("path"), tables.alias("jpeg_tables"), F.when(F.col("p_partkey") % 2 == 0, "RGB").otherwise("YCBCR").alias("photometric"), F.array(tile("DD"), tile("EE")).alias("blobs"))
    served = serve(tile_jobs(_level(rows, "tiled", (48, 16), (16, 16))))
    return served.select("path", "x", "y", "status", F.hex("data").alias("whole"))


def _constant(values: np.ndarray) -> bytes:
    """A grey picture of constant 8 x 8 blocks, exact in its first coefficients."""
    return codec.encode(np.kron(values, np.ones((8, 8))).astype(np.uint8), 100)


def _constant_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = [[_constant(np.full((2, 2), v)), None, _constant(np.full((2, 2), 255 - v))] for v in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.list_(pa.binary()))], ["path", "blobs"])


@q(
    "serve_blank",
    """SELECT CAST(s_suppkey AS VARCHAR) AS path, CAST(x AS INT) AS x, CASE WHEN x IN (0, 2) THEN 'stored' ELSE 'blank' END AS status, 16 AS width, 16 AS height,
      CAST(CASE x WHEN 0 THEN s_suppkey % 256 WHEN 2 THEN 255 - s_suppkey % 256 ELSE 255 END AS INT) AS grey FROM supplier, (SELECT unnest(range(0, 4)) AS x)""",
)
def serve_blank(spark, d):
    """A sparse level, decoded: stored tiles as they are, missing ones white."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), (F.col("s_suppkey") % 256).cast("int").alias("v"))
    levels = _level(rows.mapInArrow(_constant_tiles, "path string, blobs array<binary>"), "sparse tiled", (64, 16), (16, 16)).withColumn("jpeg_tables", F.lit(None).cast("binary"))
    served = decoded(serve(tile_jobs(levels)))
    return served.select("path", "x", "status", "width", "height", F.conv(F.hex(F.substring("pixels", 1, 1)), 16, 10).cast("int").alias("grey"))


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 x 32 pixels as eight stripes of two blocks each, behind one header."""
    for b in batches:
        rows = []
        for v in b.column(1).to_pylist():
            values = (v + 13 * np.arange(8)) % 256
            data = codec.write(codec.read(_constant(np.repeat(values.reshape(4, 2), 2, 1))), 2)
            start = next(s for s in c.segments(data) if s.marker == c.SOS).end
            ends = [i for i in range(start + 2, len(data) + 1) if data[i - 2] == 0xFF and 0xD0 <= data[i - 1] <= 0xD9]
            rows.append((data[:start], [data[a:z] for a, z in zip([start, *ends], ends)]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["path", "header", "blobs"])


@q(
    "serve_stripes",
    """SELECT CAST(s_suppkey AS VARCHAR) AS path, CAST(x AS INT) AS x, CAST(y AS INT) AS y, 'cropped' AS status, 16 AS width, 16 AS height,
      CAST((s_suppkey % 256 + 13 * (4 * y + x)) % 256 AS INT) AS upper_grey, CAST((s_suppkey % 256 + 13 * (4 * y + 2 + x)) % 256 AS INT) AS lower_grey
    FROM supplier, (SELECT unnest(range(0, 2)) AS x), (SELECT unnest(range(0, 2)) AS y)""",
)
def serve_stripes(spark, d):
    """Tiles of 16 x 16 cropped out of stripes of 16 x 8: the grey of their first and last pixel."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), (F.col("s_suppkey") % 256).cast("int").alias("v"))
    levels = _level(rows.mapInArrow(_stripes, "path string, header binary, blobs array<binary>"), "stripes re-tiled", (32, 32), (16, 8)).withColumn("jpeg_tables", F.lit(None).cast("binary"))
    served = decoded(serve(tile_jobs(levels, 16)))
    grey = lambda at: F.conv(F.hex(F.substring("pixels", at, 1)), 16, 10).cast("int")
    return served.select("path", "x", "y", "status", "width", "height", grey(1).alias("upper_grey"), grey(256).alias("lower_grey"))
