"""Tiles served by position, whatever way a level is stored: the plan is relational, bytes are read where tiles are cut.

``tile_jobs`` makes jobs of levels: a run of tiles with the byte ranges that they are made of, nothing else. ``serve`` runs the jobs
in Arrow batches: each reads its ranges at once, and completes, fills, joins, crops or repairs. Only jobs are shuffled, never
bytes; a job holds at most ``BATCH`` stored tiles or the tiles of one source frame.

How a level is stored, and what its tiles are
* tiled: stored tiles with the page's tables in front; overlapping and JPEG XR tiles as well;
* sparse tiled: missing tiles are one blank frame made from the first stored one (or the fill value where nothing is encoded);
* tiled with repair: tiles of a damaged edge are made from the next finer level whose edges are sound;
* stripes, one frame: the stripes of a source frame joined behind the page's header, tiles cropped losslessly;
* striped: all strips joined to one image; single frame: the frame.

Defined results: one row per tile (per request, if requests are given: any order, duplicates included) with ``status``
``stored``, ``blank``, ``repaired``, ``cropped``, ``joined``; without data ``missing`` (no such frame, and the level isn't sparse),
``outside`` (no such tile or level), ``error: …`` (bytes that can't be read or put together).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidelake.functions import codestream as c
from slidelake.functions import jpeg_codec as codec
from slidelake.operators.tiles import adjusted_tile_size
from slidelake.sources import tiff

BATCH = 256
SERVED = "path string, role string, level_idx int, plane int, x int, y int, request bigint, status string, data binary"
_PICK = "struct<index:int,offset:bigint,size:bigint>"


def _grid_sizes(levels: DataFrame, tile_size: int) -> DataFrame:
    """``kind``, served tile and grid of each level; tiles cut out of stripes are a power of two times the file's smallest stripe."""
    cut = F.col("strategy").isin("stripes re-tiled", "one frame re-tiled")
    whole = F.col("strategy").isin("striped", "single frame")
    smallest = F.min(F.when(F.col("strategy") == "stripes re-tiled", F.col("tile_w"))).over(Window.partitionBy("path"))
    size = F.when(cut, adjusted_tile_size(F.lit(tile_size), smallest))
    served = levels.withColumns({
        "served_w": F.when(whole, F.col("image_w")).otherwise(F.coalesce(size, "tile_w")).cast("int"), "served_h": F.when(whole, F.col("image_h")).otherwise(F.coalesce(size, "tile_h")).cast("int"),
        "kind": F.when(cut, "cut").when(F.col("strategy") == "striped", "joined").otherwise("stored"),
    })
    up = lambda a, b: F.ceil(F.col(a) / F.col(b)).cast("int")
    return served.withColumns({"across": up("image_w", "served_w"), "down": up("image_h", "served_h"), "stored_across": up("image_w", "tile_w"), "stored_down": up("image_h", "tile_h")})


def _edges(levels: DataFrame) -> DataFrame:
    """``right_bad``, ``bottom_bad`` of levels with repair, and ``parent``: the next finer level with sound edges, for those with a bad one."""
    empty = lambda i: F.coalesce(F.get("bytecounts", i.cast("int")), F.lit(0)) == 0
    along = lambda n, at: F.when(n > 1, F.exists(F.sequence(F.lit(0), n - 2), lambda i: empty(at(i)))).otherwise(False)
    w, h = F.col("across"), F.col("down")
    finer = (F.col("strategy") == "tiled with repair") & (F.col("level_idx") > 0)
    flagged = levels.withColumns({"right_bad": finer & along(h, lambda i: i * w + w - 1), "bottom_bad": finer & along(w, lambda i: (h - 1) * w + i)})
    bad = F.col("right_bad") | F.col("bottom_bad")
    before = Window.partitionBy("path", "role", "plane").orderBy("level_idx").rowsBetween(Window.unboundedPreceding, -1)
    sound = F.last(F.when(~bad & (F.col("kind") == "stored"), F.struct("image_w", "across", "down", "offsets", "bytecounts", "jpeg_tables")), ignorenulls=True).over(before)
    return flagged.withColumn("parent", F.when(bad, sound))


def _picks(indices: Column) -> Column:
    return F.transform(indices, lambda i: F.struct(i.cast("int").alias("index"), F.get("offsets", i.cast("int")).alias("offset"), F.get("bytecounts", i.cast("int")).alias("size"))).cast(f"array<{_PICK}>")


def tile_jobs(levels: DataFrame, tile_size: int = 512, batch: int = BATCH) -> DataFrame:
    """Jobs of levels: ``job``, its place and size in tiles, and the ranges it reads. ``levels`` as ``plans.slides.levels`` gives, or with ``blobs`` (bytes of frames) in place of offsets in a file."""
    defaults = {"role": F.lit("level"), "blobs": F.lit(None).cast("array<binary>"), "header": F.lit(None).cast("binary"), "bits": F.lit(8), "photometric": F.lit(None).cast("string"), "plane": F.lit(0)}
    levels = levels.withColumns({k: v for k, v in defaults.items() if k not in levels.columns})
    sized = _edges(_grid_sizes(levels, tile_size).where("image_w > 0 and image_h > 0 and served_w > 0 and served_h > 0"))
    held = F.filter(_picks(F.sequence(F.lit(0), F.size("offsets") - 1)), lambda p: p.size > 0)
    sized = sized.withColumn("sample", F.when(F.col("strategy").contains("sparse") & (F.size("offsets") > 0), F.get(held, F.lit(0))))
    i, w = F.col("job"), F.col("across")
    stored = sized.where("kind = 'stored'").withColumn("job", F.explode(F.sequence(F.lit(0), F.floor((w * F.col("down") - 1) / batch).cast("int"))))
    last = F.least((i + 1) * batch, w * F.col("down"))
    stored = stored.withColumns({"first": i * batch, "count": last - i * batch, "job_w": F.lit(0), "picks": _picks(F.sequence(i * batch, last - 1))})
    # a source frame holds as many tiles as its larger side has, and as many stripes
    per = lambda big, small: F.greatest(F.floor(F.col(big) / F.col(small)), F.lit(1)).cast("int")
    one = F.col("strategy") == "one frame re-tiled"
    nx, ny = F.when(one, w).otherwise(per("tile_w", "served_w")), F.when(one, F.col("down")).otherwise(per("tile_h", "served_h"))
    cut = sized.where("kind = 'cut'").withColumns({"nx": nx, "ny": ny, "sx": F.when(one, 1).otherwise(per("served_w", "tile_w")), "sy": F.when(one, 1).otherwise(per("served_h", "tile_h"))})
    cut = cut.withColumn("frames_across", F.ceil(w / F.col("nx")).cast("int"))
    cut = cut.withColumn("job", F.explode(F.sequence(F.lit(0), F.col("frames_across") * F.ceil(F.col("down") / F.col("ny")).cast("int") - 1)))
    fx, fy = i % F.col("frames_across"), F.floor(i / F.col("frames_across")).cast("int")
    ox, oy = F.floor(fx * F.col("nx") * F.col("served_w") / F.col("tile_w")).cast("int"), F.floor(fy * F.col("ny") * F.col("served_h") / F.col("tile_h")).cast("int")
    cut = cut.withColumns({"fx": fx, "fy": fy, "ox": F.when(one, 0).otherwise(ox), "oy": F.when(one, 0).otherwise(oy)})
    end_x, end_y = F.least(F.col("ox") + F.col("sx"), "stored_across"), F.least(F.col("oy") + F.col("sy"), "stored_down")
    cut = cut.withColumns({"cols": end_x - F.col("ox"), "rows": end_y - F.col("oy")})
    needed = F.flatten(F.transform(F.sequence(F.col("oy"), end_y - 1), lambda r: F.transform(F.sequence(F.col("ox"), end_x - 1), lambda k: r * F.col("stored_across") + k)))
    cut = cut.withColumns({"first": F.col("fy") * F.col("ny") * w + F.col("fx") * F.col("nx"), "count": F.col("nx") * F.col("ny"), "job_w": F.col("nx"), "picks": _picks(F.when(one, F.array(F.lit(0))).otherwise(needed))})
    joined = sized.where("kind = 'joined'").withColumns({"job": F.lit(0), "first": F.lit(0), "count": F.lit(1), "job_w": F.lit(0), "picks": _picks(F.sequence(F.lit(0), F.size("offsets") - 1))})
    columns = ["path", "role", "level_idx", "plane", "kind", "strategy", "job", "first", "count", "job_w", "image_w", "image_h", "tile_w", "tile_h", "served_w", "served_h", "across", "down",
               "compression", "photometric", "bits", "jpeg_tables", "header", "right_bad", "bottom_bad", "parent", "sample", "picks", "blobs"]
    rest = [F.lit(None).cast("int").alias(n) for n in ("cols", "rows")]
    return stored.select(*columns, *rest).unionByName(joined.select(*columns, *rest)).unionByName(cut.select(*columns, "cols", "rows"))


def asked_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """The jobs that hold requested tiles, with ``asked`` (``request, x, y``); requests of no tile get a job of their own without bytes.

    ``requests``: ``path, level_idx, plane, x, y, request``.
    """
    keys = ["path", "level_idx", "plane"]
    shape = jobs.where("role = 'level'").groupBy(*keys).agg(F.first("across").alias("_w"), F.first("down").alias("_h"), F.first("kind").alias("_kind"), F.max("job_w").alias("_nx"), F.max(F.when(F.col("kind") == "cut", F.floor(F.col("count") / F.col("job_w")))).alias("_ny"), F.max("count").alias("_n"))
    placed = requests.select(*keys, F.struct(F.col("request").cast("bigint").alias("request"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).alias("a")).join(shape, keys, "left")
    inside = F.coalesce((F.col("a.x") >= 0) & (F.col("a.y") >= 0) & (F.col("a.x") < F.col("_w")) & (F.col("a.y") < F.col("_h")), F.lit(False))
    raster = F.col("a.y") * F.col("_w") + F.col("a.x")
    frame = F.floor(F.col("a.y") / F.col("_ny")) * F.ceil(F.col("_w") / F.col("_nx")) + F.floor(F.col("a.x") / F.col("_nx"))
    job = F.when(inside, F.when(F.col("_kind") == "cut", frame).when(F.col("_kind") == "joined", 0).otherwise(F.floor(raster / F.col("_n"))).cast("int"))
    grouped = placed.withColumn("job", job).groupBy(*keys, "job").agg(F.collect_list("a").alias("asked"))
    found = jobs.where("role = 'level'").join(grouped.where("job is not null"), [*keys, "job"])
    lost = grouped.where("job is null").select(*[F.col(k) if k in (*keys, "asked") else F.lit("level").alias(k) if k == "role" else F.lit("outside").alias(k) if k == "kind" else F.lit(None).cast(t).alias(k) for k, t in found.dtypes])
    return found.unionByName(lost)


class _Reader:
    """Byte ranges of the file that was asked for last, kept open; or of frames that are at hand."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def ranges(self, job: dict, picks: list[dict]) -> list[bytes]:
        if job["blobs"] is not None:
            held = job["blobs"]
            return [held[p["index"]] or b"" if p["index"] < len(held) else b"" for p in picks]
        if job["path"] != self.path:
            self.close()
            path = job["path"]
            self.file, self.path = open(path[5:].replace("//", "/", 1) if path.startswith("file:") else path, "rb"), path
        return tiff.read_ranges(self.file, [(p["offset"] or 0, p["size"] or 0) for p in picks])

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.path, self.file = None, None


Found = dict[tuple[int, int], tuple[str, bytes | None]]


def _completed(job: dict, tables: bytes | None) -> Callable[[bytes], bytes]:
    rgb = job["compression"] == "JPEG" and job["photometric"] == "RGB"
    return (lambda b: c.complete_tile(b, c.tables_prefix(tables, rgb))) if tables and job["compression"] == "JPEG" else (lambda b: b)


def _stored(job: dict, reader: _Reader) -> Found:
    """Stored tiles, completed; missing and damaged ones by strategy."""
    whole = _completed(job, job["jpeg_tables"])
    blobs, blank, out = reader.ranges(job, job["picks"]), None, {}
    for pick, blob in zip(job["picks"], blobs):
        x, y = pick["index"] % job["across"], pick["index"] // job["across"]
        if job["right_bad"] and x == job["across"] - 1 or job["bottom_bad"] and y == job["down"] - 1:
            out[x, y] = _repaired(job, x, y, reader)
        elif blob:
            out[x, y] = "stored", whole(blob)
        elif job["sample"] is not None:
            if blank is None:
                blank = _blank(job, whole(reader.ranges(job, [job["sample"]])[0]))
            out[x, y] = "blank", blank
        else:
            out[x, y] = "missing", None
    return out


def _blank(job: dict, sample: bytes) -> bytes:
    """A white frame like a stored one: in its own header where that has the codes, else with tables of its own; bare samples as fill."""
    if job["compression"] != "JPEG":
        return bytes([255 if job["photometric"] != "MINISBLACK" else 0]) * len(sample)
    try:
        return c.blank_frame(sample, 1.0)
    except ValueError:
        return codec.blank(sample, 1.0)


def _repaired(job: dict, x: int, y: int, reader: _Reader) -> tuple[str, bytes | None]:
    """A tile made from the tiles of the finer level that cover it."""
    parent = job["parent"]
    if parent is None or job["compression"] != "JPEG" or job["blobs"] is not None:  # frames at hand are this level's own
        return "missing", None
    n = round(parent["image_w"] / job["image_w"])
    if n < 2 or n & (n - 1):
        return "missing", None
    cells = [(x * n + k, y * n + r) for r in range(n) for k in range(n)]
    at = [r * parent["across"] + k if k < parent["across"] and r < parent["down"] else -1 for k, r in cells]
    held = lambda i: 0 <= i < len(parent["offsets"]) and i < len(parent["bytecounts"])
    picks = [{"index": i, "offset": parent["offsets"][i], "size": parent["bytecounts"][i]} if held(i) else {"index": 0, "offset": 0, "size": 0} for i in at]
    blobs = reader.ranges(job, picks)
    whole = _completed(job, parent["jpeg_tables"])
    tiles = [whole(b) if b and held(i) else None for b, i in zip(blobs, at)]
    return "repaired", codec.repaired([tiles[r * n : r * n + n] for r in range(n)], job["tile_w"], job["tile_h"])


def _cut(job: dict, reader: _Reader) -> Found:
    """Tiles cropped out of one frame: that of a page, or its stripes behind one header."""
    blobs = reader.ranges(job, job["picks"])
    w, h = job["served_w"], job["served_h"]
    x0, y0, nx = job["first"] % job["across"], job["first"] // job["across"], job["job_w"]
    places = [(x0 + i % nx, y0 + i // nx) for i in range(job["count"])]
    places = [p for p in places if p[0] < job["across"] and p[1] < job["down"]]
    if job["strategy"] == "one frame re-tiled":
        whole = _completed(job, job["jpeg_tables"])(blobs[0])
        unit = c.mcu_size(whole)
        if unit:  # the coded picture goes on to whole units
            whole = c.with_header(whole, -(-job["image_w"] // unit[0]) * unit[0], -(-job["image_h"] // unit[1]) * unit[1])
        boxes = [(x * w, y * h, w, h) for x, y in places]
    else:
        if not job["header"] or any(not b for b in blobs):
            return {p: ("missing", None) for p in places}
        unit = c.mcu_size(job["header"])
        if job["tile_h"] != unit[1] and job["cols"] > 1:
            raise ValueError("stripes higher than a coded unit, side by side")
        units = -(-job["tile_w"] // unit[0]) * -(-job["tile_h"] // unit[1])
        whole = c.join_fragments(c.with_header(job["header"], job["cols"] * job["tile_w"], job["rows"] * job["tile_h"], units), blobs)
        # a frame begins where its first stripe does
        left, top = x0 * w // job["tile_w"] * job["tile_w"], y0 * h // job["tile_h"] * job["tile_h"]
        boxes = [(x * w - left, y * h - top, w, h) for x, y in places]
    return {p: ("cropped", data) for p, data in zip(places, codec.crop_many(whole, boxes))}


def _joined(job: dict, reader: _Reader) -> Found:
    """All strips of a page as one image."""
    blobs = reader.ranges(job, job["picks"])
    if not blobs or any(not b for b in blobs):
        return {(0, 0): ("missing", None)}
    if job["compression"] == "JPEG":
        rgb = job["photometric"] == "RGB"
        return {(0, 0): ("joined", c.join_scans(blobs, job["jpeg_tables"], rgb) if len(blobs) > 1 else _completed(job, job["jpeg_tables"])(blobs[0]))}
    return {(0, 0): ("joined", b"".join(tiff.decode(b, job["compression"]) for b in blobs))}


_KINDS = {"stored": _stored, "cut": _cut, "joined": _joined}


def _serve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    try:
        for b in batches:
            for job in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                found, problem = {}, "outside"
                if job["kind"] != "outside":
                    try:
                        found = _KINDS[job["kind"]](job, reader)
                    except (ValueError, TypeError, KeyError, IndexError, OSError, struct.error) as e:
                        problem = f"error: {e}"
                asked = job["asked"]
                if asked is None:
                    places = list(found) or [((job["first"] + i) % job["across"], (job["first"] + i) // job["across"]) for i in range(job["count"])]
                    asked = [{"request": None, "x": x, "y": y} for x, y in places if x < job["across"] and y < job["down"]]
                rows = [(a["x"], a["y"], a["request"], *found.get((a["x"], a["y"]), (problem, None))) for a in asked]
                head = [[job[k]] * len(rows) for k in ("path", "role", "level_idx", "plane")]
                types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([*head, *([r[i] for r in rows] for i in range(5))], types)], [f.split()[0] for f in SERVED.split(", ")])
    finally:
        reader.close()


def serve(jobs: DataFrame) -> DataFrame:
    """``path, role, level_idx, plane, x, y, request, status, data`` of every tile of the jobs, or of the requests that they were asked for."""
    if "asked" not in jobs.columns:
        jobs = jobs.withColumn("asked", F.lit(None).cast("array<struct<request:bigint,x:int,y:int>>"))
    return jobs.mapInArrow(_serve_batches, SERVED)


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for data in b.column(b.schema.get_field_index("data")).to_pylist():
            try:
                image = codec.pixels(data) if data else None
            except (ValueError, KeyError, IndexError, struct.error):
                image = None
            out.append((None, None, None, None) if image is None else (image.shape[1], image.shape[0], 1 if image.ndim == 2 else image.shape[2], image.tobytes()))
        more = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "width", "height", "samples", "pixels"])


def decoded(served: DataFrame) -> DataFrame:
    """Served JPEG tiles with ``width, height, samples, pixels`` (rows of samples); null where there is no codec for them."""
    return served.mapInArrow(_decode_batches, ", ".join(f"`{n}` {t}" for n, t in served.dtypes) + ", width int, height int, samples int, pixels binary")
