"""Which format a file is of, and which role its images have, as Column expressions over page relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slidelake.functions.text import line

_has = lambda c, text: F.coalesce(F.contains(c, F.lit(text)), F.lit(False))
_starts = lambda c, text: F.coalesce(c.startswith(text), F.lit(False))


def detect(description: Column, software: Column, tags: Column, tiled: Column, all_jpeg: Column) -> Column:
    """The first format in order whose test holds for a file's first page, else null.

    ``tags``: map of tag number to text; ``all_jpeg``: all pages of the first image are JPEG (or JPEG XR for ndpi).
    """
    tag = lambda n: F.coalesce(F.element_at(tags, F.lit(n)), F.lit(""))
    tests = [
        ("ndpi", (tag(65420) != "") & all_jpeg),
        ("svs", _starts(description, "Aperio ")),
        ("philips", _starts(software, "Philips") & _has(description, "<DataObject") & all_jpeg),
        ("3dhistech", _has(description, "3dh_PixelSizeX")),
        ("ome-tiff", F.coalesce(F.rtrim(description).endswith("OME>"), F.lit(False))),
        ("trestle", _starts(software, "MedScan")),
        ("ventana", _has(tag(700), "<iScan")),
        ("huron", _has(description, "Image Dimensions =") & _has(description, "Resolution =")),
        ("mikroscan", _has(description, "Mikroscan Image Structure")),
        ("motic", _starts(description, "Motic ") & _has(description, "AppMag")),
        ("argos", tiled & _has(tag(65000), "Argos.Scan.Metadata")),
        ("leica-scn", _has(description, "<scn xmlns")),
        ("qptiff", _starts(software, "PerkinElmer-QPI")),
    ]
    return reduce(lambda c, t: F.when(t[1], t[0]).otherwise(c), reversed(tests), F.lit(None).cast("string"))


def all_jpeg() -> Column:
    """Aggregate over a file's pages: whether the images that a format is known by are JPEG (or JPEG XR).

    Those are the levels and the macro image of files with lens tags (65421; maps have other negative lenses), else the first page and all tiled ones.
    """
    lens = F.element_at("tags", F.lit(65421)).try_cast("double")
    counts = F.when(F.element_at("tags", F.lit(65420)).isNotNull(), F.coalesce(lens >= -1, F.lit(True))).otherwise(F.col("is_tiled") | (F.col("page_idx") == 0))
    return F.bool_and(F.when(counts, F.col("compression").isin("JPEG", "JPEGXR_NDPI")))


def role(fmt: Column, description: Column, position: Column, count: Column, subfile: Column, tiled: Column | None = None) -> Column:
    """``level``, ``label``, ``overview`` or ``thumbnail`` of an image by its format, its description, its place in the file and whether it is tiled.

    The text of reduced svs levels names the sizes before and after an arrow, as thumbnails' does; tiled ones are levels.
    """
    tiled = F.lit(False) if tiled is None else F.coalesce(tiled, F.lit(False))
    second = F.lower(line(description, 2))
    named = lambda word: F.coalesce(F.contains(F.lower(description), F.lit(word)), F.lit(False))
    by_line = F.when(position == 0, "level").when(second.startswith("label"), "label").when(second.startswith("macro"), "overview").when(F.contains(second, F.lit("->")), "thumbnail")
    by_word = F.when(position == 0, "level").when(named("label"), "label").when(named("macro"), "overview").when(named("thumbnail"), "thumbnail")
    by_type = lambda pattern: F.regexp_extract(description, pattern, 1)
    qptiff = by_type("<ImageType>(.*?)</ImageType>")
    return (
        F.when((fmt == "svs") & tiled & F.contains(second, F.lit("->")), F.lit("level"))
        .when(fmt.isin("mikroscan", "motic", "svs"), F.coalesce(by_line, F.when(subfile == 0, F.lit("level"))))
        .when(fmt.isin("philips", "huron"), F.coalesce(by_word, F.when(subfile == 0, F.lit("level"))))
        .when(fmt == "ome-tiff", F.when(named("label"), "label").when(named("macro"), "overview").when(named("thumbnail"), "thumbnail").otherwise("level"))
        .when(fmt == "argos", F.when(position == 0, "level").when(position == count - 1, F.when(count >= 3, "overview")).when(position == count - 2, "thumbnail").otherwise("level"))
        .when(fmt == "qptiff", F.when(qptiff == "FullResolution", "level").when(qptiff == "ReducedResolution", "level").when(qptiff == "Label", "label").when(qptiff == "Overview", "overview").when(qptiff == "Thumbnail", "thumbnail"))
        .when(fmt == "ventana", F.when(named("level="), "level").when(named("label image"), "label").when(named("label_image"), "overview").when(named("thumbnail"), "thumbnail"))
        .when(fmt == "trestle", F.when(subfile == 0, "level"))
        .otherwise(F.when(position == 0, "level"))
    )


def ndpi_role(lens: Column) -> Column:
    """Role of an ndpi page by its source lens: -1 is the macro image, other negative ones (maps) have none."""
    n = lens.try_cast("double")
    return F.when(n == -1, "overview").when(n < 0, F.lit(None).cast("string")).otherwise("level")


def last_of_role(roles: Column, wanted: str) -> Column:
    """Place of the last image of a role in an array of roles; null if there is none."""
    at = F.array_position(F.reverse(roles), wanted)
    return F.when(at > 0, F.size(roles) - at)


def resolution_mpp(fmt: Column, resolution: Column, unit: Column) -> Column:
    """Micrometres per pixel of a resolution tag (unit 2 inch, 3 centimetre); ndpi only in centimetres; null if unknown."""
    per = F.when(unit == 3, 10000.0).when((unit == 2) & (fmt != "ndpi"), 25400.0)
    return F.when(fmt == "trestle", resolution).otherwise(per / F.nullif(resolution, F.lit(0.0)))


def photometric(fmt: Column, compression: Column, tag: Column, rgb: Column, h: Column, v: Column, mct: Column) -> Column:
    """Colour model of an image: what its codestream signals, else the tag; 3DHistech palettes are grey.

    ``rgb``: RGB signalled by a JPEG; ``h, v``: largest sampling factors; ``mct``: a JPEG 2000 component transform.
    """
    sampled = F.coalesce((h > 1) | (v > 1), F.lit(False))
    jpeg = F.when(F.coalesce(rgb, F.lit(False)), "RGB").when(sampled, "YCBCR")
    j2k = F.when(F.coalesce(mct, F.lit(False)) | sampled | (compression == "APERIO_JP2000_YCBC"), "YCBCR")
    coded = F.when(compression == "JPEG", jpeg).when(compression.isin("JPEG2000", "JPEG_2000_LOSSY", "APERIO_JP2000_YCBC", "APERIO_JP2000_RGB"), j2k)
    return F.when((fmt == "3dhistech") & (tag == "PALETTE"), "MINISBLACK").when(fmt == "3dhistech", tag).otherwise(F.coalesce(coded, tag))


def number_type(bits: Column) -> Column:
    """Unsigned type that holds samples of so many bits; null past 32."""
    return F.when(bits <= 8, "uint8").when(bits <= 16, "uint16").when(bits <= 32, "uint32")


def fill_value(bits: Column, model: Column) -> Column:
    """Sample that empty places are filled with: all ones for colour models and white-is-zero, 0 for black-is-zero, null for others."""
    width = F.when(bits <= 8, 8).when(bits <= 16, 16).when(bits <= 32, 32)
    return F.when(model.isin("RGB", "YCBCR", "MINISWHITE"), F.pow(F.lit(2.0), width) - 1).when(model == "MINISBLACK", F.lit(0.0)).cast("bigint")


def served_compression(fmt: Column, image_role: Column, compression: Column) -> Column:
    """Compression of what is served: labels cut out of ndpi are JPEG only if stored so, LZW of qptiff comes decoded."""
    return F.when((fmt == "ndpi") & (image_role == "label") & (compression != "JPEG"), "NONE").when((fmt == "qptiff") & (compression == "LZW"), "NONE").otherwise(compression)


def encoded(compression: Column) -> Column:
    """Whether tiles are served encoded; false where the compression is unknown."""
    return F.coalesce(~compression.isin("NONE", "JPEGXR_NDPI"), F.lit(False))


def focal_plane(fmt: Column, plane: Column, z_offset_nm: Column, offset_z: Column, least_z: Column, step_z: Column) -> Column:
    """Micrometres of a page above the slide's centre: by tag for ndpi and svs, by plane and step for argos and ome-tiff, else 0."""
    by_tag = F.when(fmt == "ndpi", z_offset_nm / 1000).when(fmt == "svs", offset_z)
    return F.coalesce(by_tag, F.when(fmt == "argos", (F.coalesce(least_z, F.lit(0.0)) + plane) * step_z).when(fmt == "ome-tiff", plane * step_z), F.lit(0.0))


def optical_path(fmt: Column, channel: Column, page: Column, band: Column) -> Column:
    """Name of a page's optical path: channel number of ome-tiff, band of qptiff or else its number from 1, else ``1``."""
    return F.when(fmt == "ome-tiff", channel.cast("string")).when(fmt == "qptiff", F.coalesce(band, (page + 1).cast("string"))).otherwise("1")


def chunk_hint(fmt: Column, frame_w: Column, tile_w: Column) -> Column:
    """Tiles worth asking for at once: those of one stored frame where tiles are cut out of frames, else 1."""
    return F.when(fmt == "ndpi", F.greatest(F.floor(frame_w / F.nullif(tile_w, F.lit(0))), F.lit(1))).otherwise(F.lit(1)).cast("bigint")


#: Parts of the overview that show the label: left of ndpi, right of argos, bottom of leica-scn.
LABEL_FROM = {"ndpi": 0.3, "argos": 0.76, "leica-scn": 0.72}


def label_crop(fmt: Column, width: Column, height: Column, unit: Column, tile_h: Column) -> Column:
    """``struct<left, top, width, height>`` of the label in its overview, at coded units (leica-scn: rows of tiles); the whole image for other formats."""
    at = {f: (width * part / unit).cast("bigint") * unit for f, part in LABEL_FROM.items()}
    top = F.when(fmt == "leica-scn", F.floor((height * LABEL_FROM["leica-scn"]).cast("bigint") / F.nullif(tile_h, F.lit(0))) * tile_h).otherwise(F.lit(0)).cast("bigint")
    left = F.when(fmt == "argos", at["argos"]).otherwise(F.lit(0)).cast("bigint")
    across = F.when(fmt == "ndpi", at["ndpi"]).when(fmt == "argos", width - at["argos"]).otherwise(width).cast("bigint")
    return F.struct(left.alias("left"), top.alias("top"), across.alias("width"), (height - top).cast("bigint").alias("height"))


def level_overlap(listed: Column, level: Column) -> Column:
    """``struct<x, y>``: overlap of a level's tiles in a list of pairs parted by blanks; 0 for levels that it doesn't reach."""
    parts = F.filter(F.split(F.coalesce(listed, F.lit("")), r"\s+"), lambda p: p != "")
    at = lambda i: F.coalesce(F.get(parts, i.cast("int")).try_cast("int"), F.lit(0))
    return F.struct(at(2 * level).alias("x"), at(2 * level + 1).alias("y"))
