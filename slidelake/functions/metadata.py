"""Scanner metadata of all formats in one schema, from the first page of a file; all as JVM-side expressions.

Every format fills the same struct: ``magnification, manufacturer, model, software, serial, acquired, offset_minutes,
label_text, barcode, mpp_x, mpp_y, properties``. What a format doesn't know, and what can't be read, is null.
XML is read by pattern, not by a parser: descriptions come from outside, and a damaged one must not fail a query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slidelake.common import let
from slidelake.functions import text as t

TEXT = "string"
FIELDS = {
    "magnification": "double", "manufacturer": TEXT, "model": TEXT, "software": "array<string>", "serial": TEXT, "acquired": "timestamp_ntz",
    "offset_minutes": "int", "label_text": TEXT, "barcode": TEXT, "mpp_x": "double", "mpp_y": "double", "properties": "map<string,string>",
}
#: Elements and attributes that are kept as properties.
ARGOS = ["ObjectiveMagnification", "ObjectiveName", "AcquisitionDate", "AcquisitionTime", "ZRange", "MinZ", "MaxZ", "Barcode", "Scanner"]
QPTIFF = ["DescriptionVersion", "AcquisitionSoftware", "ImageType", "Identifier", "SlideID", "Barcode", "ComputerName", "IsUnmixedComponent", "ExposureTime", "SignalUnits", "Name", "Color", "Objective", "CameraName"]
PHILIPS = ["DICOM_PIXEL_SPACING", "DICOM_ACQUISITION_DATETIME", "DICOM_MANUFACTURER", "DICOM_SOFTWARE_VERSIONS", "DICOM_DEVICE_SERIAL_NUMBER", "PIM_DP_UFS_BARCODE", "DICOM_LOSSY_IMAGE_COMPRESSION_METHOD", "DICOM_LOSSY_IMAGE_COMPRESSION_RATIO", "DICOM_BITS_ALLOCATED", "DICOM_BITS_STORED", "DICOM_HIGH_BIT", "DICOM_PIXEL_REPRESENTATION"]


def unescape(s: Column) -> Column:
    """The five named entities of XML as characters."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")], s)


def xml_text(xml: Column, element: str) -> Column:
    """Text of the first element of a name, with or without a namespace prefix; null if blank or missing."""
    return F.nullif(F.btrim(unescape(F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{element}(?:\s[^>]*)?>([^<]*)</", 1)), F.lit(t.STRIP)), F.lit(""))


def xml_attribute(xml: Column, element: str, name: str) -> Column:
    """An attribute of the first element of a name; null if blank or missing."""
    inside = F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{element}(\s[^>]*)>", 1)
    return F.nullif(unescape(F.regexp_extract(inside, rf"\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)), F.lit(""))


def _map(entries: list[tuple[str, Column]]) -> Column:
    """Map of the entries whose value isn't null."""
    return F.map_filter(F.create_map(*[x for k, v in entries for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


def _one(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c))


def _when(date: Column, time: Column, *patterns: str) -> Column:
    joined = F.concat_ws(" ", date, time)
    return F.when(date.isNotNull(), F.coalesce(*[F.try_to_timestamp(joined, F.lit(p)).cast("timestamp_ntz") for p in patterns]))


def _pipe(description: Column) -> tuple[Column, Column]:
    return F.btrim(t.pipe_header(description)), t.pipe_properties(description)


def _svs_like(description: Column) -> dict[str, Column]:
    _, p = _pipe(description)
    mpp = t.decimal(F.element_at(p, "MPP"))
    return {"magnification": F.element_at(p, "AppMag").try_cast("double"), "mpp_x": mpp, "mpp_y": mpp, "properties": p}


def formats(description: Column, software: Column, make: Column, model: Column, tags: Column, x_resolution: Column, y_resolution: Column, unit: Column) -> dict[str, dict[str, Column]]:
    """What each format's first page says, by format and field."""
    tag = lambda n: t.clean(F.element_at(tags, F.lit(n)))
    header, props = _pipe(description)
    get = lambda m, k: F.element_at(m, k)
    cm = lambda r, scale: F.when(unit == 3, F.lit(scale) / F.nullif(r, F.lit(0.0)))
    out: dict[str, dict[str, Column]] = {}

    tag_time = F.try_to_timestamp(tag(306), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")
    comments = F.map_from_entries(F.flatten(F.transform(F.map_entries(t.sections(F.coalesce(tag(65449), F.lit("")))), lambda s: F.transform(F.map_entries(s.value), lambda e: F.struct(F.when(s.key == "", e.key).otherwise(F.concat(s.key, F.lit("/"), e.key)).alias("key"), e.value.alias("value"))))))
    out["ndpi"] = {
        "magnification": tag(65421).try_cast("double"), "manufacturer": t.clean(make), "model": t.clean(model), "software": _one(t.clean(software)), "serial": tag(65442),
        "acquired": tag_time, "label_text": tag(65427), "barcode": tag(65468), "mpp_x": cm(x_resolution, 10000.0), "mpp_y": cm(y_resolution, 10000.0),
        "properties": F.map_concat(F.map_filter(comments, lambda k, v: ~k.isin("x_offset_from_slide_center", "y_offset_from_slide_center", "z_offset_from_slide_center")), _map([(f"{a}_offset_from_slide_center", tag(n)) for a, n in (("x", 65422), ("y", 65423), ("z", 65424))])),
    }

    who = t.vendor(header, get(props, "ScanScope ID"), get(props, "ScannerType"))
    svs_mpp = t.mpp_of_header(get(props, "MPP"), F.coalesce(F.get(F.split(description, r"\|"), F.lit(0)), F.lit("")))
    out["svs"] = {
        "magnification": get(props, "AppMag").try_cast("double"), "manufacturer": who.manufacturer, "model": who.model, "software": t.software_list(F.get(F.split(description, r"\|"), F.lit(0))), "serial": get(props, "ScanScope ID"),
        "acquired": _when(get(props, "Date"), get(props, "Time"), "MM/dd/yyyy HH:mm:ss", "MM/dd/yy HH:mm:ss"), "offset_minutes": t.zone_minutes(get(props, "Time Zone")),
        "label_text": t.clean(get(props, "Title")), "barcode": t.clean(get(props, "Barcode")), "mpp_x": svs_mpp, "mpp_y": svs_mpp, "properties": props,
    }

    attribute = lambda n: F.nullif(unescape(F.regexp_extract(description, rf"(?s)<Attribute\s[^>]*Name=\"{n}\"[^>]*>([^<]+)</Attribute>", 1)), F.lit(""))
    spacing = t.quoted_numbers(attribute("DICOM_PIXEL_SPACING"))
    versions = F.filter(F.split(F.btrim(F.replace(attribute("DICOM_SOFTWARE_VERSIONS"), F.lit('"'), F.lit(""))), r"\s+"), lambda x: x != "")
    out["philips"] = {
        "manufacturer": attribute("DICOM_MANUFACTURER"), "software": versions, "serial": attribute("DICOM_DEVICE_SERIAL_NUMBER"),
        "acquired": F.try_to_timestamp(attribute("DICOM_ACQUISITION_DATETIME"), F.lit("yyyyMMddHHmmss.SSSSSS")).cast("timestamp_ntz"), "barcode": t.barcode(attribute("PIM_DP_UFS_BARCODE")),
        "mpp_x": F.get(spacing, F.lit(1)) * 1000, "mpp_y": F.get(spacing, F.lit(0)) * 1000, "properties": _map([(n, attribute(n)) for n in PHILIPS]),
    }

    out["3dhistech"] = _svs_like(description) | {"acquired": _when(get(props, "Date"), get(props, "Time"), "dd/MM/yyyy HH:mm:ss")}
    key = F.get(F.filter(F.map_entries(props), lambda e: e.key.endswith("SERIAL #")), F.lit(0))
    out["mikroscan"] = _svs_like(description) | {
        "manufacturer": F.lit("Mikroscan"), "model": t.clean(F.regexp_replace(key.key, "SERIAL #$", "")), "serial": t.clean(key.value), "acquired": _when(get(props, "Date"), get(props, "Time"), "MM/dd/yy HH:mm:ss"),
    }
    out["motic"] = _svs_like(description) | {"manufacturer": F.lit("Motic"), "software": _one(t.clean(F.regexp_replace(header, "^Motic", ""))), "barcode": t.clean(get(props, "Barcode"))}

    size = xml_attribute(description, "Pixels", "PhysicalSizeX"), xml_attribute(description, "Pixels", "PhysicalSizeY")
    micro = F.coalesce(xml_attribute(description, "Pixels", "PhysicalSizeXUnit"), F.lit("µm")) == "µm"
    out["ome-tiff"] = {"mpp_x": F.when(micro, size[0].try_cast("double")), "mpp_y": F.when(micro, size[1].try_cast("double"))}

    semi = t.semicolon_properties(description)
    out["trestle"] = {"magnification": get(semi, "Objective Power").try_cast("double"), "mpp_x": x_resolution, "mpp_y": y_resolution, "properties": semi}

    iscan = lambda n: xml_attribute(tag(700), "iScan", n)
    out["ventana"] = {
        "magnification": iscan("Magnification").try_cast("double"), "manufacturer": F.lit("Ventana Medical Systems, Inc."), "software": _one(iscan("BuildVersion")), "serial": iscan("UnitNumber"),
        "barcode": F.coalesce(t.clean(iscan("Barcode1D")), t.clean(iscan("Barcode2D"))), "mpp_x": iscan("ScanRes").try_cast("double"), "mpp_y": iscan("ScanRes").try_cast("double"),
        "properties": t.last_wins(F.transform(F.regexp_extract_all(F.regexp_extract(tag(700), r"(?s)<iScan(\s[^>]*)>", 1), F.lit(r"(\w+\s*=\s*\"[^\"]*\")"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("key"), unescape(F.regexp_extract(x, r"\"([^\"]*)\"", 1)).alias("value")))),
    }

    rows = t.line_properties(description)
    huron_mpp = F.get(F.split(get(rows, "Resolution"), " "), F.lit(0)).try_cast("double")
    out["huron"] = {
        "manufacturer": t.clean(make), "model": t.clean(model), "software": _one(t.clean(software)), "serial": t.clean(get(rows, "DeviceID")), "acquired": F.try_to_timestamp(get(rows, "Scan Started"), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz"),
        "barcode": t.barcode(get(rows, "Barcode")), "mpp_x": huron_mpp, "mpp_y": huron_mpp, "properties": rows,
    }

    argos = lambda n: xml_text(tag(65000), n)
    area = F.regexp_extract(tag(65000), r"(?s)<ScanArea>(.*?)</ScanArea>", 1)
    out["argos"] = {
        "magnification": argos("ObjectiveMagnification").try_cast("double"), "model": argos("Scanner"), "barcode": argos("Barcode"),
        "acquired": F.coalesce(_when(argos("AcquisitionDate"), argos("AcquisitionTime"), "MM.dd.yyyy HH:mm:ss"), F.when(argos("AcquisitionTime").isNull(), _when(argos("AcquisitionDate"), F.lit(None), "MM.dd.yyyy"))),
        "mpp_x": cm(x_resolution, 10000.0), "mpp_y": cm(y_resolution, 10000.0), "properties": _map([*((n, argos(n)) for n in ARGOS), *((f"ScanArea.{c}", xml_text(area, c)) for c in ("X1", "Y1", "X2", "Y2"))]),
    }

    # the widest image that isn't the macro (the one whose view is the whole collection), the first of equally wide ones
    images = F.regexp_extract_all(description, F.lit(r"(?s)(<image\s.*?</image>)"), F.lit(1))
    whole = [xml_attribute(description, "collection", n).try_cast("bigint") for n in ("sizeX", "sizeY")]
    number = lambda x, e, n: F.coalesce(xml_attribute(x, e, n).try_cast("bigint"), F.lit(0))
    is_macro = lambda x: (number(x, "view", "offsetX") == 0) & (number(x, "view", "offsetY") == 0) & (number(x, "view", "sizeX") == F.coalesce(whole[0], F.lit(-1))) & (number(x, "view", "sizeY") == F.coalesce(whole[1], F.lit(-1)))
    ranked = F.transform(images, lambda x, i: F.struct(is_macro(x).cast("int").alias("macro"), (-number(x, "pixels", "sizeX")).alias("w"), i.alias("i"), x.alias("xml")))
    main = F.array_min(ranked).xml
    view = lambda x, n: number(x, "view", n) / F.nullif(number(x, "pixels", n), F.lit(0)) / 1000
    created = xml_text(main, "creationDate")
    stamp = F.regexp_extract(created, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1)
    zone = F.regexp_extract(created, r"(Z|[+-]\d{2}:\d{2})$", 1)
    out["leica-scn"] = {
        "magnification": xml_text(main, "objective").try_cast("double"), "manufacturer": F.lit("Leica"), "model": t.clean(F.get(F.split(xml_attribute(main, "device", "model"), ";"), F.lit(0))),
        "software": let(F.filter(F.transform(F.split(xml_attribute(main, "device", "version"), ";"), lambda x: F.btrim(x)), lambda x: x != ""), lambda v: F.when(F.size(v) > 0, v)),
        "acquired": F.nullif(stamp, F.lit("")).try_cast("timestamp_ntz"), "offset_minutes": F.when(zone == "Z", 0).otherwise(t.zone_minutes(F.concat(F.lit("GMT"), zone))), "barcode": t.barcode(xml_text(description, "barcode")),
        "mpp_x": view(main, "sizeX"), "mpp_y": view(main, "sizeY"),
        "properties": _map([("objective", xml_text(main, "objective")), ("numerical_aperture", xml_text(main, "numericalAperture")), ("illumination_source", xml_text(main, "illuminationSource"))]),
    }

    named = t.name_and_version(xml_text(description, "AcquisitionSoftware"))
    out["qptiff"] = {
        "magnification": t.magnification(xml_text(description, "Objective")), "manufacturer": F.lit("PerkinElmer"), "model": named["name"], "software": _one(named.version), "acquired": tag_time,
        "barcode": xml_text(description, "Barcode"), "mpp_x": cm(x_resolution, 10000.0), "mpp_y": cm(y_resolution, 10000.0), "properties": _map([(n, xml_text(description, n)) for n in QPTIFF]),
    }
    return out


def metadata(fmt: Column, description: Column, software: Column, make: Column, model: Column, tags: Column, x_resolution: Column, y_resolution: Column, unit: Column) -> Column:
    """The common struct for the first page of a file of format ``fmt``."""
    known = formats(description, software, make, model, tags, x_resolution, y_resolution, unit)

    def struct(fields: dict[str, Column]) -> Column:
        return F.struct(*[fields.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in FIELDS.items()])

    return reduce(lambda c, kv: F.when(fmt == kv[0], struct(kv[1])).otherwise(c), known.items(), struct({}))
