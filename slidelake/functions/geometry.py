"""Integer and rectangle arithmetic of tile grids as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_div(a: Column, b: Column) -> Column:
    """Quotient cut toward zero; null for a zero divisor."""
    divisor = F.nullif(b, F.lit(0))
    return ((a - a % divisor) / divisor).cast("bigint")


def ceil_div(a: Column, b: Column) -> Column:
    """Quotient rounded up, for ``b`` > 0; null for a zero divisor."""
    return F.ceil(a / F.nullif(b, F.lit(0)))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor, for ``b`` > 0."""
    return F.pmod(a, b)


def scale_trunc(v: Column, factor: Column | float) -> Column:
    """``v * factor`` cut toward zero."""
    return (v * factor).cast("bigint")


def grid(width: Column, height: Column) -> Column:
    """Array of ``struct<x, y>`` in raster order (rows outside, columns inside); empty if either size isn't positive."""
    rows = F.when((width > 0) & (height > 0), F.sequence(F.lit(0), height.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    line = F.when((width > 0) & (height > 0), F.sequence(F.lit(0), width.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(rows, lambda y: F.transform(line, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def crop(x: Column, y: Column, w: Column, h: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """``struct<x, y, w, h>``: the part of a rectangle that lies in another; sizes are never negative."""
    left, top = F.greatest(x, bx), F.greatest(y, by)
    right, bottom = F.least(x + w, bx + bw), F.least(y + h, by + bh)
    return F.struct(
        left.alias("x"), top.alias("y"), F.greatest(right - left, F.lit(0)).alias("w"), F.greatest(bottom - top, F.lit(0)).alias("h")
    )


def inside(x: Column, y: Column, w: Column, h: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Whether a rectangle lies in another, edges included."""
    return (x >= bx) & (y >= by) & (x + w <= bx + bw) & (y + h <= by + bh)


def frame_index(x: Column, y: Column, tiled_w: Column) -> Column:
    """Stored frame of a tile in raster order."""
    return y * tiled_w + x


def round_half_even(v: Column) -> Column:
    """Nearest integer, ties to the even one."""
    return F.rint(v).cast("bigint")


def unravel(index: Column, dims: list[Column]) -> Column:
    """Row-major position of an index in axes of the given sizes, slowest first, as an array."""
    out, stride = [], F.lit(1).cast("bigint")
    for d in reversed(dims):
        out.append(F.floor(index / stride) % d)
        stride = stride * d
    return F.array(*reversed(out))


def serpentine(index: Column, cols: Column, rows: Column) -> Column:
    """``struct<col, row>`` of a 1-based index along a snake that starts at the bottom; odd rows run backwards, rows are mirrored."""
    n = index - 1
    snake_row = F.floor(n / cols)
    along = n % cols
    return F.struct(F.when(snake_row % 2 == 1, cols - 1 - along).otherwise(along).alias("col"), (rows - 1 - snake_row).alias("row"))
