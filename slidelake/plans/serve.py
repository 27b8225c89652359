"""Tiles of scanner files by series, level, plane and position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.operators.serving import asked_jobs, decoded, serve, tile_jobs
from slidelake.plans.slides import images, levels, read_pages, slides


def level_jobs(spark: SparkSession, path: str, tile_size: int = 512) -> DataFrame:
    """Jobs of all levels of the recognised files below a path."""
    pages = read_pages(spark, path)
    return tile_jobs(levels(images(pages, slides(pages))), tile_size)


def serve_tiles(spark: SparkSession, path: str, requests: DataFrame | None = None, tile_size: int = 512, pixels: bool = False) -> DataFrame:
    """Every tile of every level below ``path``, or those that ``requests`` (``path, level_idx, plane, x, y, request``) ask for; decoded with ``pixels``."""
    jobs = level_jobs(spark, path, tile_size)
    served = serve(asked_jobs(jobs, requests) if requests is not None else jobs)
    return decoded(served) if pixels else served


def associated(spark: SparkSession, path: str) -> DataFrame:
    """Label, overview and thumbnail images of the recognised files, each as it is stored: strips joined, tiles apart."""
    pages = read_pages(spark, path)
    found = images(pages, slides(pages)).where("role in ('label', 'overview', 'thumbnail') and width > 0 and height > 0")
    kind = F.when(F.col("is_tiled") & ~F.col("strategy").contains("re-tiled"), "tiled").when(F.size("offsets") == 1, "single frame").otherwise("striped")
    renamed = found.withColumns({"strategy": kind, "level_idx": F.lit(0), "plane": F.lit(0)}).withColumnsRenamed({"width": "image_w", "height": "image_h"})
    return serve(tile_jobs(renamed))
