"""Queries over encoded bytes: headers built from table values, read again by the codestream functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from slidelake.common import table
from slidelake.functions import codestream as c
from slidelake.functions import jpeg_codec as codec
from slidelake.plans.registry import Registry

registry = Registry()
q = registry.add

_RESULT = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("close", BooleanType()), StructField("same_after_crop", BooleanType())])


@F.pandas_udf(_RESULT)
def jpeg_round_trip(tiles: pd.Series) -> pd.DataFrame:
    """A grey 8 x 8 tile through the codec and back."""
    rows = []
    for t in tiles:
        image = np.array(t, np.uint8).reshape(8, 8)
        data = codec.encode(image, 100)
        back = codec.pixels(data)
        near = int(np.abs(back.astype(int) - image).max()) <= 32
        rows.append((back.shape[1], back.shape[0], near, bool(np.array_equal(codec.pixels(codec.crop_many(data, [(0, 0, 8, 8)])[0]), back))))
    return pd.DataFrame(rows, columns=_RESULT.names)


def _hex(n, digits: int):
    return F.lpad(F.hex(n.cast("bigint")), digits, "0")


def _jpeg(p):
    """A JPEG header per part: process, size and sampling from its values."""
    marker = F.element_at(F.array(*[F.lit(m) for m in ("C0", "C1", "C2", "C3")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    sampling = F.concat((F.col("p_partkey") % 2 + 1).cast("string"), F.lit("1"))
    text = F.concat(F.lit("FFD8FFDB00434400"), F.repeat(F.lit("01"), 63), F.lit("FF"), marker, F.lit("001108"), _hex(F.col("p_size") * 16, 4), _hex(F.col("p_size") * 24, 4), F.lit("0301"), sampling, F.lit("00021100031100FFDA000C03010002000300"), _hex(F.col("p_partkey") % 7, 2), F.lit("0000"))
    return p.select("p_partkey", F.unhex(text).alias("frame"))


@q(
    "jpeg_info",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'BASELINE' WHEN 1 THEN 'EXTENDED' WHEN 2 THEN 'PROGRESSIVE' ELSE 'LOSSLESS' END AS process, 8 AS bit_depth, 3 AS components, CAST(p_partkey % 2 + 1 AS INT) AS sampling_h, 1 AS sampling_v, false AS rgb,
      CASE WHEN p_partkey % 4 = 3 THEN CAST(p_partkey % 7 AS INT) END AS predictor, CAST(p_size * 24 AS INT) AS width, CAST(p_size * 16 AS INT) AS height FROM part""",
)
def jpeg_info(spark, d):
    """What JPEG headers say."""
    i = _jpeg(table(spark, d, "part")).select("p_partkey", c.jpeg_info_udf("frame").alias("i"))
    return i.select("p_partkey", "i.process", "i.bit_depth", "i.components", F.col("i.subsampling.h").alias("sampling_h"), F.col("i.subsampling.v").alias("sampling_v"), "i.rgb", "i.predictor", "i.width", "i.height")


@q(
    "jpeg2000_info",
    """SELECT p_partkey, p_partkey % 2 = 1 AS reversible, p_partkey % 3 = 1 AS uses_mct, 3 AS components, CAST(p_partkey % 2 + 1 AS INT) AS sampling_h, 1 AS sampling_v, CAST(p_size % 16 + 1 AS INT) AS bit_depth, p_partkey % 5 <> 0 AS extended FROM part""",
)
def jpeg2000_info(spark, d):
    """What JPEG 2000 codestreams say."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    depth, sub = _hex(F.col("p_size") % 16, 2), _hex(k % 2 + 1, 2)
    text = F.concat(F.lit("FF4FFF51002F"), _hex(k % 5, 4), F.lit("FF52" * 16), F.lit("0003"), depth, F.lit("0101"), depth, sub, F.lit("01"), depth, sub, F.lit("01"), F.lit("FF52000C00000001"), _hex(F.when(k % 3 == 1, 1).otherwise(0), 2), F.lit("05040400"), _hex(k % 2, 2))
    i = p.select("p_partkey", F.unhex(text).alias("code")).select("p_partkey", c.jpeg2000_info_udf("code").alias("i"))
    return i.select("p_partkey", "i.reversible", "i.uses_mct", "i.components", F.col("i.subsampling.h").alias("sampling_h"), F.col("i.subsampling.v").alias("sampling_v"), "i.bit_depth", "i.extended")


@q(
    "jpeg_prefix",
    """SELECT p_partkey, 'FFD8' || repeat(lpad(to_hex(p_size), 2, '0'), 3) || 'DD' || lpad(to_hex(p_partkey % 256), 2, '0') || 'FFD9' AS whole FROM part""",
)
def jpeg_prefix(spark, d):
    """Abbreviated tiles made whole with their page's tables."""
    p = table(spark, d, "part").select("p_partkey", F.unhex(F.concat(F.lit("FFD8"), F.repeat(_hex(F.col("p_size"), 2), 3), F.lit("FFD9"))).alias("tables"), F.unhex(F.concat(F.lit("FFD8DD"), _hex(F.col("p_partkey") % 256, 2), F.lit("FFD9"))).alias("tile"))
    return p.select("p_partkey", F.hex(c.complete_tile_udf("tile", "tables", F.lit(False))).alias("whole"))


@q("jpeg_tiles", "SELECT vec_id, 8 AS width, 8 AS height, true AS close, true AS same_after_crop FROM embeddings")
def jpeg_tiles(spark, d):
    """8 x 8 tiles encoded, decoded and cropped: size, nearness to the original, equality of the crop."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.least(F.greatest((v + 0.5) * 255, F.lit(0)), F.lit(255)).cast("int")).alias("tile"))
    i = e.select("vec_id", jpeg_round_trip("tile").alias("i"))
    return i.select("vec_id", "i.*")
