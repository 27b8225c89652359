"""``spark.read.format("wsi")``: scanner TIFF files as relations.

Option ``relation``: ``pages`` (directories without pixel bytes), ``frames`` (byte ranges), ``tiles`` (stored bytes of the frames).
Option ``page`` limits frames and tiles to one directory, ``box`` (``x0,y0,x1,y1``, half open, in tiles) tiles to a part of the
grid. Pruning is by options, each ``load`` apart. A partition holds ``files_per_task`` files, for tiles a part of one file of about
``bytes_per_task`` bytes, so that a large file is spread over executors. Directories are read where the rows are made, never on
the driver, which only lists files and their lengths. Option ``mode``: ``permissive`` gives a row with ``error`` for files that are no TIFF, ``failfast`` raises.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from slidelake.functions.formats import all_jpeg, detect
from slidelake.sources.tiff import TiffError, read_pages, read_ranges

PAGES = (
    "path string, length bigint, error string, page_idx int, pages int, subfile int, width int, height int, is_tiled boolean, tile_w int, tile_h int, compression string, "
    "photometric string, samples int, bits int, description string, software string, make string, model string, x_resolution double, y_resolution double, resolution_unit int, "
    "jpeg_tables binary, icc_profile binary, tags map<int,string>, offsets array<bigint>, bytecounts array<bigint>, parent int, header binary"
)
FRAMES = "path string, page_idx int, frame_index int, x int, y int, offset bigint, bytecount bigint"
SCHEMAS = {"pages": PAGES, "frames": FRAMES, "tiles": FRAMES + ", status string, data binary"}


@dataclass
class Task(InputPartition):
    """Files of a task, or one of equal parts of a file's frames."""

    paths: tuple[str, ...]
    part: int = 0
    parts: int = 1


def local_path(path: str) -> str:
    """A path without its ``file:`` scheme."""
    return path[5:].replace("//", "/", 1) if path.startswith("file:") else path


def list_files(path: str) -> list[str]:
    """Files of a path, folder or pattern, in order."""
    p = local_path(path)
    if os.path.isdir(p):
        return sorted(os.path.join(r, f) for r, _, fs in os.walk(p) for f in fs if not f.startswith((".", "_")))
    return sorted(glob.glob(p)) if any(c in p for c in "*?[") else [p]


class WsiReader(DataSourceReader):
    """Reads one relation of the files."""

    def __init__(self, options: dict[str, str]) -> None:
        self.relation = options.get("relation", "pages")
        if self.relation not in SCHEMAS:
            raise ValueError(f"relation must be one of {', '.join(SCHEMAS)}")
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path = options["path"]
        self.page = int(options["page"]) if "page" in options else None
        self.box = [int(v) for v in options["box"].split(",")] if "box" in options else None
        self.bytes_per_task = int(options.get("bytes_per_task", str(128 << 20)))
        self.files_per_task = int(options.get("files_per_task", "16"))
        self.permissive = options.get("mode", "permissive").lower() == "permissive"

    def partitions(self) -> list[Task]:
        """Tasks of whole files, several small ones together; for tiles, tasks of ``frames_per_task`` frames by a file's length alone.

        No directory is read here: a task finds its own frames, those past its page's end are none.
        """
        files = [(p, os.path.getsize(p) if os.path.exists(p) else 0) for p in list_files(self.path)]
        if self.relation != "tiles":
            return self._grouped(files) or [Task(())]
        tasks = []
        for p, size in files:
            parts = max(1, min(size // self.bytes_per_task, 10_000)) if self.box is None else 1
            tasks += [Task((p,), i, parts) for i in range(parts)]
        return tasks or [Task(())]

    def _grouped(self, files: list[tuple[str, int]]) -> list[Task]:
        groups = max(1, -(-len(files) // self.files_per_task))
        return [Task(tuple(p for p, _ in files[g::groups])) for g in range(groups)] if files else []

    def _pages(self, path: str) -> list:
        try:
            with open(path, "rb") as f:
                return read_pages(f)
        except (TiffError, OSError):
            if self.permissive:
                return []
            raise

    def read(self, task: Task) -> Iterator[tuple]:
        """Rows of a task."""
        for path in task.paths:
            yield from self._page_rows(path) if self.relation == "pages" else self._frame_rows(path, task)

    def _frame_rows(self, path: str, task: Task) -> Iterator[tuple]:
        for page in self._pages(path):
            if self.page is not None and page.index != self.page:
                continue
            r = page.row()
            across = max(-(-(r["width"] or 1) // (r["tile_w"] or 1)), 1)
            n = len(r["offsets"])
            places = [(i, i % across, i // across) for i in range(n * task.part // task.parts, n * (task.part + 1) // task.parts)]
            if self.box:
                x0, y0, x1, y1 = self.box
                places = [p for p in places if x0 <= p[1] < x1 and y0 <= p[2] < y1]
            size = lambda i, n=r["bytecounts"]: n[i] if i < len(n) else 0
            if self.relation == "frames":
                yield from ((path, page.index, i, x, y, r["offsets"][i], size(i)) for i, x, y in places)
                continue
            with open(path, "rb") as f:
                for at in range(0, len(places), 256):
                    part = places[at : at + 256]
                    blobs = read_ranges(f, [(r["offsets"][i], size(i)) for i, _, _ in part])
                    for (i, x, y), blob in zip(part, blobs):
                        yield path, page.index, i, x, y, r["offsets"][i], size(i), "stored" if size(i) else "blank", blob if size(i) else None

    def _page_rows(self, path: str) -> Iterator[tuple]:
        names = [c.strip().split(" ")[0] for c in PAGES.split(", ")]
        try:
            length = os.path.getsize(path)
            with open(path, "rb") as f:
                pages = read_pages(f)
        except (TiffError, OSError) as e:
            if not self.permissive:
                raise
            yield tuple({"path": path, "error": str(e)}.get(n) for n in names)
            return
        for page in pages:
            r = {**page.row(), "path": path, "length": length, "pages": len(pages)}
            yield tuple(r.get(n) for n in names)


class WsiSource(DataSource):
    """The data source; register it with :func:`register`."""

    @classmethod
    def name(cls) -> str:
        return "wsi"

    def schema(self) -> str:
        return SCHEMAS.get(self.options.get("relation", "pages"), PAGES)

    def reader(self, schema) -> WsiReader:
        return WsiReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(WsiSource)


def open_slides(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path, length, error, pages, format``; format null where none is recognised."""
    register(spark)
    pages = spark.read.format("wsi").option("relation", "pages").load(path)
    per = pages.groupBy("path").agg(
        F.max("length").alias("length"), F.max("error").alias("error"), F.max("pages").alias("pages"), all_jpeg().alias("all_jpeg"),
        F.min_by(F.struct("description", "software", "tags", "is_tiled", "icc_profile"), "page_idx").alias("first"),
    )
    fmt = detect(F.col("first.description"), F.col("first.software"), F.coalesce(F.col("first.tags"), F.create_map(F.lit(0), F.lit(""))), F.coalesce("first.is_tiled", F.lit(False)), F.coalesce("all_jpeg", F.lit(False)))
    return per.select("path", "length", "error", "pages", fmt.alias("format"), F.col("first.icc_profile").alias("icc_profile"))


def read_tiles(spark: SparkSession, path: str, page: int | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Stored tiles of a page, of a part of its grid if ``box`` is given; missing ones are blank."""
    register(spark)
    reader = spark.read.format("wsi").option("relation", "tiles")
    reader = reader.option("page", page) if page is not None else reader
    reader = reader.option("box", ",".join(map(str, box))) if box else reader
    return reader.load(path)
