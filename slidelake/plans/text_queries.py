"""Queries over scanner text (descriptions, XML, dates, barcodes, names, classification), each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.common import table
from slidelake.functions import formats as f
from slidelake.functions import text as x
from slidelake.operators import tiles as t
from slidelake.plans.registry import Registry

registry = Registry()
q = registry.add


def _slides(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "slides").select(*columns)


_DESC = """(SELECT slide_id, 'Aperio Image Library v' || slide_id % 13 || chr(10) || 'size' || '|AppMag = ' || coalesce(CAST(CAST(magnification AS INT) AS VARCHAR), '') || '|MPP = 0,' || (slide_id % 900 + 100) || '|Filename = ' || path
  || '|pad|AppMag = ' || (slide_id % 40) AS description FROM slides)"""


def described(spark: SparkSession, d: str) -> DataFrame:
    """A description per slide, parted by ``|``, with one key twice."""
    s = _slides(spark, d, "slide_id", "magnification", "path")
    mag = F.coalesce(F.col("magnification").cast("int").cast("string"), F.lit(""))
    return s.select("slide_id", F.concat(F.lit("Aperio Image Library v"), F.col("slide_id") % 13, F.lit("\nsize|AppMag = "), mag, F.lit("|MPP = 0,"), F.col("slide_id") % 900 + 100, F.lit("|Filename = "), "path", F.lit("|pad|AppMag = "), F.col("slide_id") % 40).alias("description"))


@q(
    "kv_pipe",
    f"""SELECT slide_id, trim(split_part(split_part(description, '|', 1), chr(10), 1)) AS header, (SELECT list_filter(string_split(description, '|'), lambda i: starts_with(i, 'AppMag = '))[-1])[10:] AS app_mag,
      (SELECT list_filter(string_split(description, '|'), lambda i: starts_with(i, 'Filename = '))[-1])[12:] AS filename, CAST(3 AS INT) AS properties FROM {_DESC}""",
)
def kv_pipe(spark, d):
    """Header and properties of a description; the last of equal keys counts."""
    p = described(spark, d).select("slide_id", F.btrim(x.pipe_header(F.col("description"))).alias("header"), x.pipe_properties(F.col("description")).alias("p"))
    return p.select("slide_id", "header", F.element_at("p", "AppMag").alias("app_mag"), F.element_at("p", "Filename").alias("filename"), F.size("p").alias("properties"))


@q("kv_semicolon", "SELECT p_partkey, trim(p_name) AS name, p_brand AS brand, CAST(p_size AS VARCHAR) || '=' AS size FROM part")
def kv_semicolon(spark, d):
    """Properties parted by semicolons; a value keeps later equal signs."""
    p = table(spark, d, "part")
    text = F.concat(F.lit("Name="), "p_name", F.lit(" ; Brand="), "p_brand", F.lit(";x;Size="), "p_size", F.lit("="))
    m = p.select("p_partkey", x.semicolon_properties(text).alias("m"))
    return m.select("p_partkey", F.element_at("m", "Name").alias("name"), F.element_at("m", "Brand").alias("brand"), F.element_at("m", "Size").alias("size"))


@q("kv_lines", "SELECT p_partkey, p_type AS type, CAST(p_size AS VARCHAR) || ' = ' || p_brand AS spec FROM part")
def kv_lines(spark, d):
    """Properties one per line, lines ended in any of three ways."""
    p = table(spark, d, "part")
    text = F.concat(F.lit("Type = "), "p_type", F.lit("\r\nSpec = "), "p_size", F.lit(" = "), "p_brand", F.lit("\rnote\n"))
    m = p.select("p_partkey", x.line_properties(text).alias("m"))
    return m.select("p_partkey", F.element_at("m", "Type").alias("type"), F.element_at("m", "Spec").alias("spec"))


@q("kv_sections", "SELECT p_partkey, p_name AS product, CAST(p_size AS VARCHAR) AS version, 'a=' || p_brand AS formula, CAST(3 AS INT) AS sections FROM part")
def kv_sections(spark, d):
    """Comments with named sections."""
    p = table(spark, d, "part")
    text = F.concat(F.lit("Product="), "p_name", F.lit("\r\n;NDP Shading Data\r;Version="), "p_size", F.lit("\r;ID=4\n;Other\n;Formula=a="), "p_brand")
    m = p.select("p_partkey", x.sections(text).alias("m"))
    at = lambda s, k: F.element_at(F.element_at("m", s), k)
    return m.select("p_partkey", at("", "Product").alias("product"), at("NDP Shading Data", "Version").alias("version"), at("Other", "Formula").alias("formula"), F.size("m").alias("sections"))


@q(
    "xml_scalar",
    """SELECT image_id, image_name AS name, nullif(trim(coalesce(objective, '')), '') AS objective, CAST(pixel_size_x AS VARCHAR) AS size_x FROM leica_images WHERE image_name IS NOT NULL""",
)
def xml_scalar(spark, d):
    """Scalars of an XML document: by pattern, and by path under any namespace."""
    i = table(spark, d, "leica_images").where("image_name is not null")
    xml = F.concat(F.lit('<scn xmlns="urn:x"><image><Name>'), "image_name", F.lit("</Name><objective> "), F.coalesce("objective", F.lit("")), F.lit('</objective><pixels sizeX="'), F.coalesce(F.col("pixel_size_x").cast("string"), F.lit("")), F.lit('"/></image></scn>'))
    s = i.select("image_id", xml.alias("xml"))
    return s.select("image_id", x.element_text(F.col("xml"), "Name").alias("name"), x.element_text(F.col("xml"), "objective").alias("objective"), F.nullif(F.xpath_string("xml", F.lit("//*[local-name()='pixels']/@sizeX")), F.lit("")).alias("size_x"))


@q(
    "barcode_base64",
    """SELECT attr_id, CASE WHEN regexp_full_match(v, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') AND v <> '' THEN decode(from_base64(v)) ELSE nullif(v, '') END AS barcode
    FROM (SELECT attr_id, trim(attr_value, ' ' || chr(9) || chr(10) || chr(13)) AS v FROM philips_attributes WHERE attr_name = 'PIM_DP_UFS_BARCODE')""",
)
def barcode_base64(spark, d):
    """Barcodes in base64, those that aren't as they are."""
    a = table(spark, d, "philips_attributes").where("attr_name = 'PIM_DP_UFS_BARCODE'")
    return a.select("attr_id", x.barcode(F.col("attr_value")).alias("barcode"))


@q(
    "clean_string",
    "SELECT slide_id, nullif(trim(label_text, ' ' || chr(9) || chr(10) || chr(13)), '') AS label, coalesce(nullif(trim(barcode, ' ' || chr(9) || chr(10) || chr(13)), ''), nullif(trim(label_text, ' ' || chr(9) || chr(10) || chr(13)), '')) AS best FROM slides",
)
def clean_string(spark, d):
    """Label stripped, blank as null; the first of barcode and label that isn't blank."""
    label, barcode = x.clean(F.col("label_text")), x.clean(F.col("barcode"))
    return _slides(spark, d, "slide_id", "label_text", "barcode").select("slide_id", label.alias("label"), F.coalesce(barcode, label).alias("best"))


@q(
    "parse_datetime",
    """SELECT meta_id, strftime(CASE
      WHEN f IN ('ndpi', 'qptiff', 'huron') AND regexp_full_match(v, '\\d{4}:\\d\\d:\\d\\d \\d\\d:\\d\\d:\\d\\d') THEN try_strptime(v, '%Y:%m:%d %H:%M:%S')
      WHEN f = 'philips' AND regexp_full_match(v, '\\d{14}\\.\\d{6}') THEN try_strptime(v, '%Y%m%d%H%M%S.%f')
      WHEN f = 'argos' AND regexp_full_match(v, '\\d\\d\\.\\d\\d\\.\\d{4} \\d\\d:\\d\\d:\\d\\d') THEN try_strptime(v, '%m.%d.%Y %H:%M:%S')
      WHEN f = 'argos' AND regexp_full_match(v, '\\d\\d\\.\\d\\d\\.\\d{4}') THEN try_strptime(v, '%m.%d.%Y')
      WHEN f = '3dhistech' AND regexp_full_match(v, '\\d\\d/\\d\\d/\\d{4} \\d\\d:\\d\\d:\\d\\d') THEN try_strptime(v, '%d/%m/%Y %H:%M:%S')
      WHEN f = 'mikroscan' AND regexp_full_match(v, '\\d\\d/\\d\\d/\\d\\d \\d\\d:\\d\\d:\\d\\d') THEN try_strptime(v, '%m/%d/%y %H:%M:%S')
      WHEN f = 'svs' AND regexp_full_match(v, '\\d\\d/\\d\\d/\\d{4} \\d\\d:\\d\\d:\\d\\d') THEN try_strptime(v, '%m/%d/%Y %H:%M:%S')
      WHEN f = 'svs' AND regexp_full_match(v, '\\d\\d/\\d\\d/\\d\\d \\d\\d:\\d\\d:\\d\\d') THEN try_strptime(v, '%m/%d/%y %H:%M:%S') END, '%Y-%m-%d %H:%M:%S.%f') AS taken
    FROM (SELECT meta_id, format AS f, trim(acquisition_datetime, ' ') AS v FROM slide_metadata)""",
)
def parse_datetime(spark, d):
    """Wall-clock time where the text is in the notation of its format's own parser."""
    m = table(spark, d, "slide_metadata").select("meta_id", x.acquisition_time(F.col("acquisition_datetime"), F.col("format")).alias("t"))
    return m.select("meta_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("taken"))


@q(
    "parse_timezone",
    """SELECT meta_id, CASE WHEN z <> '' THEN (CASE WHEN z[4] = '-' THEN -1 ELSE 1 END) * (CAST(z[5:6] AS INT) * 60 + CAST(z[-2:] AS INT)) END AS offset_minutes FROM (
      SELECT meta_id, regexp_extract(coalesce(acquisition_datetime, ''), ' (GMT[+-]\\d{2}:?\\d{2})$', 1) AS z FROM slide_metadata)""",
)
def parse_timezone(spark, d):
    """Minutes of a ``GMT`` offset at the end; null without one."""
    zone = F.regexp_extract(F.coalesce("acquisition_datetime", F.lit("")), r" (GMT[+-]\d{2}:?\d{2})$", 1)
    return table(spark, d, "slide_metadata").select("meta_id", x.zone_minutes(zone).alias("offset_minutes"))


@q(
    "decimal_comma",
    """SELECT meta_id, coalesce(TRY_CAST(replace(trim(mpp, ' '), ',', '.') AS DOUBLE), TRY_CAST(replace(nullif(regexp_extract(coalesce(scan_note, ''), 'Scan resolution\\s+([0-9.,]+)', 1), ''), ',', '.') AS DOUBLE)) AS mpp
    FROM slide_metadata WHERE regexp_full_match(mpp, '[ 0-9.,]+')""",
)
def decimal_comma(spark, d):
    """Pixel size with decimal point or comma, else from the header; null if neither is a number."""
    m = table(spark, d, "slide_metadata").where(F.col("mpp").rlike("^[ 0-9.,]+$"))
    return m.select("meta_id", x.mpp_of_header(F.col("mpp"), F.coalesce("scan_note", F.lit(""))).alias("mpp"))


@q(
    "decimal_comma_all",
    """SELECT meta_id, coalesce(CASE WHEN regexp_full_match(mpp, '[ 0-9.,]+') THEN TRY_CAST(replace(trim(mpp, ' '), ',', '.') AS DOUBLE) END, TRY_CAST(replace(nullif(regexp_extract(coalesce(scan_note, ''), 'Scan resolution\\s+([0-9.,]+)', 1), ''), ',', '.') AS DOUBLE)) AS mpp
    FROM slide_metadata""",
)
def decimal_comma_all(spark, d):
    """Pixel size of every row with decimal point or comma, else from the header; null if neither is digits and separators alone."""
    number = F.when(F.col("mpp").rlike(r"^[ 0-9.,]+$"), F.col("mpp"))
    return table(spark, d, "slide_metadata").select("meta_id", x.mpp_of_header(number, F.coalesce("scan_note", F.lit(""))).alias("mpp"))


@q(
    "version_split",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' beta' END AS name, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) || '.1b' END AS version FROM part""",
)
def version_split(spark, d):
    """Name and version of a software text."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" "), "p_size", F.lit(".1b"))).otherwise(F.concat("p_name", F.lit(" beta")))
    return table(spark, d, "part").select("p_partkey", x.name_and_version(text).alias("v")).select("p_partkey", "v.name", "v.version")


@q("objective", "SELECT image_id, TRY_CAST(rtrim(lower(trim(objective)), 'x') AS DOUBLE) AS magnification FROM leica_images")
def objective(spark, d):
    """Magnification of an objective such as ``20x``."""
    return table(spark, d, "leica_images").select("image_id", x.magnification(F.col("objective")).alias("magnification"))


@q(
    "vendor_model",
    """SELECT slide_id, CASE WHEN slide_id % 5 = 0 THEN 'Grundium' WHEN scanner_serial_number IS NOT NULL THEN 'Leica Biosystems' END AS manufacturer,
      CASE WHEN slide_id % 5 = 0 THEN 'Ocus20' WHEN scanner_serial_number IS NULL THEN NULL WHEN slide_id % 5 = 1 THEN 'GT450 DX' WHEN slide_id % 5 = 2 THEN 'GT450' ELSE 'Aperio' END AS model FROM slides""",
)
def vendor_model(spark, d):
    """Maker and model that a header and a serial number imply."""
    n = F.col("slide_id") % 5
    header = F.when(n == 0, "Aperio Image, Grundium Ocus20").when(n == 1, "Aperio Leica Biosystems GT450 DX v1").when(n == 2, "Aperio GT450 v2").otherwise("Aperio Image Library")
    s = _slides(spark, d, "slide_id", "scanner_serial_number").select("slide_id", x.vendor(header, F.col("scanner_serial_number"), F.lit(None).cast("string")).alias("v"))
    return s.select("slide_id", "v.manufacturer", "v.model")


@q("software_names", "SELECT p_partkey, [trim(p_name), 'v' || p_size] AS names FROM part")
def software_names(spark, d):
    """Software names of a header."""
    text = F.concat(F.lit(" "), "p_name", F.lit(" \nline two; ;v"), "p_size", F.lit("\n;"))
    return table(spark, d, "part").select("p_partkey", x.software_list(text).alias("names"))


@q(
    "quoted_list",
    """SELECT attr_id, attr_name, list_transform(list_filter(regexp_split_to_array(trim(replace(attr_value, '"', '')), '\\s+'), lambda i: i <> ''), lambda i: TRY_CAST(i AS DOUBLE)) AS numbers FROM philips_attributes
    WHERE attr_name IN ('DICOM_BITS_ALLOCATED', 'DICOM_HIGH_BIT', 'DICOM_LOSSY_IMAGE_COMPRESSION_RATIO') AND attr_value IS NOT NULL""",
)
def quoted_list(spark, d):
    """Numbers of quoted lists."""
    a = table(spark, d, "philips_attributes").where("attr_name in ('DICOM_BITS_ALLOCATED', 'DICOM_HIGH_BIT', 'DICOM_LOSSY_IMAGE_COMPRESSION_RATIO') and attr_value is not null")
    return a.select("attr_id", "attr_name", x.quoted_numbers(F.col("attr_value")).alias("numbers"))


@q(
    "slide_attributes",
    """SELECT slide_id, count(*) AS attributes, arg_min(attr_value, attr_id) FILTER (WHERE attr_name = 'DICOM_DEVICE_SERIAL_NUMBER' AND attr_value <> '') AS serial, CAST(arg_min(attr_value, attr_id) FILTER (WHERE attr_name = 'DICOM_HIGH_BIT' AND attr_value <> '') AS INT) AS high_bit
    FROM philips_attributes GROUP BY slide_id""",
)
def slide_attributes(spark, d):
    """First value that isn't empty of each wanted attribute of a slide."""
    first = lambda n: F.min_by("attr_value", F.when((F.col("attr_name") == n) & (F.col("attr_value") != ""), F.col("attr_id")))
    return table(spark, d, "philips_attributes").groupBy("slide_id").agg(F.count("*").alias("attributes"), first("DICOM_DEVICE_SERIAL_NUMBER").alias("serial"), first("DICOM_HIGH_BIT").cast("int").alias("high_bit"))


@q("remove_prefix", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN trim(' ' || p_name) ELSE p_name END AS model FROM part")
def remove_prefix(spark, d):
    """A model without the maker's name before it."""
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Motic "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.btrim(F.regexp_replace(text, "^Motic", "")).alias("model"))


@q("serial_suffix", "SELECT p_partkey, 'SL5' AS model, 'N' || p_size AS serial FROM part")
def serial_suffix(spark, d):
    """Model and serial number from the first key that ends in ``SERIAL #``."""
    text = F.concat(F.lit("h|AppMag = 20|SL5 SERIAL # = N"), "p_size", F.lit("|Z SERIAL # = no"))
    m = table(spark, d, "part").select("p_partkey", x.pipe_properties(text).alias("m"))
    hit = F.get(F.filter(F.map_entries("m"), lambda e: e.key.endswith("SERIAL #")), F.lit(0))
    return m.select("p_partkey", hit.alias("e")).select("p_partkey", F.btrim(F.regexp_replace("e.key", "SERIAL #$", "")).alias("model"), F.col("e.value").alias("serial"))


_SERIES = """(SELECT image_id, slide_id, image_idx, CASE WHEN image_idx = 0 THEN 'h' || chr(10) || 'macro 1x1' WHEN image_idx = 1 THEN 'h' WHEN image_idx = 2 THEN 'h' || chr(10) || 'label 2x2' WHEN image_idx IN (3, 4) THEN 'h' || chr(10) || '9x9 -> 3x3' ELSE '' END AS description FROM leica_images)"""


@q(
    "series_classify",
    f"""SELECT slide_id, max(image_idx) FILTER (WHERE role = 'level') AS level_idx, max(image_idx) FILTER (WHERE role = 'label') AS label_idx, max(image_idx) FILTER (WHERE role = 'overview') AS overview_idx, max(image_idx) FILTER (WHERE role = 'thumbnail') AS thumbnail_idx
    FROM (SELECT *, CASE WHEN starts_with(split_part(description, chr(10), 2), 'label') THEN 'label' WHEN starts_with(split_part(description, chr(10), 2), 'macro') THEN 'overview' WHEN contains(split_part(description, chr(10), 2), '->') AND image_idx <> 4 THEN 'thumbnail' ELSE 'level' END AS role FROM {_SERIES}) GROUP BY slide_id""",
)
def series_classify(spark, d):
    """Place of the last image of each role; a tiled page with an arrow in its text is a level, one that isn't tiled a thumbnail."""
    i = F.col("image_idx")
    text = F.when(i == 0, "h\nmacro 1x1").when(i == 1, "h").when(i == 2, "h\nlabel 2x2").when(i.isin(3, 4), "h\n9x9 -> 3x3").otherwise("")
    r = table(spark, d, "leica_images").select("slide_id", "image_idx", f.role(F.lit("svs"), text, i + 1, F.lit(9), F.lit(0), i == 4).alias("role"))
    last = lambda n: F.max(F.when(F.col("role") == n, F.col("image_idx"))).alias(f"{n}_idx")
    return r.groupBy("slide_id").agg(*[last(n) for n in ("level", "label", "overview", "thumbnail")])


@q(
    "format_detect",
    """SELECT slide_id, CASE WHEN slide_id % 4 = 0 AND slide_id % 3 <> 0 THEN 'ndpi' WHEN slide_id % 5 = 0 THEN 'svs' WHEN slide_id % 7 = 0 THEN 'trestle' WHEN slide_id % 6 = 1 THEN 'mikroscan' WHEN slide_id % 6 = 2 THEN 'leica-scn' END AS detected FROM slides""",
)
def format_detect(spark, d):
    """First format whose test holds, where several do."""
    n = F.col("slide_id")
    text = F.concat(F.when(n % 5 == 0, "Aperio Image Library ").otherwise(""), F.when(n % 6 == 1, "Mikroscan Image Structure").when(n % 6 == 2, '<?xml?><scn xmlns="x">').otherwise("other"))
    tags = F.when(n % 4 == 0, F.create_map(F.lit(65420), F.lit("1"))).otherwise(F.create_map(F.lit(256), F.lit("1")))
    return _slides(spark, d, "slide_id").select("slide_id", f.detect(text, F.when(n % 7 == 0, "MedScan 1").otherwise("x"), tags, F.lit(True), n % 3 != 0).alias("detected"))


@q(
    "main_image",
    """SELECT slide_id, arg_max(image_name, (CASE WHEN image_idx = 0 THEN 0 ELSE 1 END, coalesce(pixel_size_x, 0), -image_idx)) AS main_image FROM leica_images GROUP BY slide_id""",
)
def main_image(spark, d):
    """Widest image that isn't the macro image, the first of equally wide ones; the macro if there is no other."""
    i = table(spark, d, "leica_images")
    return t.main_image(i, "slide_id", F.col("image_idx") == 0, "pixel_size_x", "image_idx", "image_name").withColumnRenamed("image_name", "main_image")


@q(
    "roi_pyramids",
    """WITH m AS (SELECT slide_id, arg_max(image_id, (CASE WHEN image_idx = 0 THEN 0 ELSE 1 END, coalesce(pixel_size_x, 0), -image_idx)) AS main FROM leica_images GROUP BY slide_id)
    SELECT i.slide_id, image_id, CAST(view_offset_x / 1000000 AS DOUBLE) AS x_mm, CAST(view_offset_y / 1000000 AS DOUBLE) AS y_mm FROM leica_images i WHERE image_idx <> 0 AND image_id NOT IN (SELECT main FROM m)""",
)
def roi_pyramids(spark, d):
    """Further regions of a slide with their position in mm."""
    i = table(spark, d, "leica_images")
    main = t.main_image(i, "slide_id", F.col("image_idx") == 0, "pixel_size_x", "image_idx", "image_id").select("image_id")
    return i.where("image_idx <> 0").join(main, "image_id", "left_anti").select("slide_id", "image_id", (F.col("view_offset_x") / 1e6).alias("x_mm"), (F.col("view_offset_y") / 1e6).alias("y_mm"))


@q(
    "view_mpp",
    """SELECT image_id, TRY_CAST(view_size_x AS BIGINT) / nullif(pixel_size_x, 0) / 1000 AS mpp_x, image_idx = 0 AND view_offset_x = 0 AND view_offset_y = 0 AS is_macro FROM leica_images WHERE regexp_full_match(view_size_x, '\\d+') AND view_unit IS NULL""",
)
def view_mpp(spark, d):
    """Pixel size of an image from its view in nm, and the test for the macro image."""
    i = table(spark, d, "leica_images").where(F.col("view_size_x").rlike(r"^\d+$") & F.col("view_unit").isNull())
    macro = (F.col("image_idx") == 0) & (F.col("view_offset_x") == 0) & (F.col("view_offset_y") == 0)
    return i.select("image_id", (F.col("view_size_x").try_cast("bigint") / F.nullif("pixel_size_x", F.lit(0)) / 1000).alias("mpp_x"), macro.alias("is_macro"))


@q(
    "view_mpp_all",
    """SELECT image_id, CASE WHEN regexp_full_match(view_size_x, '\\d+') AND view_unit IS NULL THEN TRY_CAST(view_size_x AS BIGINT) / nullif(pixel_size_x, 0) / 1000 END AS mpp_x, image_idx = 0 AND view_offset_x = 0 AND view_offset_y = 0 AS is_macro FROM leica_images""",
)
def view_mpp_all(spark, d):
    """``view_mpp`` of every image; the size is null where the view is no plain number of nm (``p1_found`` reads other units)."""
    plain = F.col("view_size_x").rlike(r"^\d+$") & F.col("view_unit").isNull()
    macro = (F.col("image_idx") == 0) & (F.col("view_offset_x") == 0) & (F.col("view_offset_y") == 0)
    size = F.when(plain, F.col("view_size_x")).try_cast("bigint")
    return table(spark, d, "leica_images").select("image_id", (size / F.nullif("pixel_size_x", F.lit(0)) / 1000).alias("mpp_x"), macro.alias("is_macro"))


@q(
    "resolution_mpp",
    """SELECT slide_id, CASE WHEN format = 'trestle' THEN r WHEN u = 3 THEN 10000.0::DOUBLE / nullif(r, 0) WHEN u = 2 AND format <> 'ndpi' THEN 25400.0::DOUBLE / nullif(r, 0) END AS mpp
    FROM (SELECT slide_id, format, CAST(slide_id % 50000 AS DOUBLE) AS r, slide_id % 3 + 1 AS u FROM slides)""",
)
def resolution_mpp(spark, d):
    """Pixel size from resolution tags; null for unknown units and no resolution."""
    s = _slides(spark, d, "slide_id", "format")
    return s.select("slide_id", f.resolution_mpp(F.col("format"), (F.col("slide_id") % 50000).cast("double"), F.col("slide_id") % 3 + 1).alias("mpp"))


@q("overlap_list", "SELECT p_partkey, coalesce(TRY_CAST(list_extract(string_split('64 32 ' || p_size, ' '), 2 * (p_partkey % 3) + 1) AS INT), 0) AS overlap_x FROM part")
def overlap_list(spark, d):
    """Overlap of a level in a list of pairs; 0 for levels that it doesn't reach."""
    return table(spark, d, "part").select("p_partkey", f.level_overlap(F.concat(F.lit("64 32 "), "p_size"), F.col("p_partkey") % 3).x.alias("overlap_x"))


@q("pixelsize_text", "SELECT p_partkey, p_size / 1000 AS x, CAST(p_size + 1 AS DOUBLE) / 1000 AS y FROM part")
def pixelsize_text(spark, d):
    """Pixel size in mm out of running text."""
    text = F.concat(F.lit('a pixelsize=("'), "p_size", F.lit('","'), F.col("p_size") + 1, F.lit('") b'))
    return table(spark, d, "part").select("p_partkey", x.pixelsize(text).alias("s")).select("p_partkey", "s.x", "s.y")


@q(
    "role_lookup",
    """SELECT s.slide_id, l.level_idx, CAST(l.image_w AS BIGINT) AS image_w, i.image_name AS overview FROM slides s JOIN (SELECT DISTINCT slide_id, level_idx, image_w FROM levels) l ON s.slide_id = l.slide_id AND l.level_idx = s.slide_id % 4
      LEFT JOIN (SELECT slide_id, min(image_name) AS image_name FROM leica_images WHERE image_idx = 0 GROUP BY slide_id) i ON s.slide_id = i.slide_id""",
)
def role_lookup(spark, d):
    """One level of each slide by its number, with the overview where there is one."""
    lv = table(spark, d, "levels").select("slide_id", "level_idx", F.col("image_w").cast("bigint").alias("image_w")).distinct()
    o = table(spark, d, "leica_images").where("image_idx = 0").groupBy("slide_id").agg(F.min("image_name").alias("overview"))
    s = _slides(spark, d, "slide_id").select("slide_id", (F.col("slide_id") % 4).alias("level_idx"))
    return s.join(lv, ["slide_id", "level_idx"]).join(o, "slide_id", "left").select("slide_id", "level_idx", "image_w", "overview")


@q(
    "role_lookup_all",
    """SELECT s.slide_id, l.level_idx, CAST(l.image_w AS BIGINT) AS image_w, i.image_name AS overview FROM slides s JOIN (SELECT DISTINCT slide_id, level_idx, image_w FROM levels) l ON s.slide_id = l.slide_id
      LEFT JOIN (SELECT slide_id, min(image_name) AS image_name FROM leica_images WHERE image_idx = 0 GROUP BY slide_id) i ON s.slide_id = i.slide_id""",
)
def role_lookup_all(spark, d):
    """Every level of each slide, with the overview where there is one."""
    lv = table(spark, d, "levels").select("slide_id", "level_idx", F.col("image_w").cast("bigint").alias("image_w")).distinct()
    o = table(spark, d, "leica_images").where("image_idx = 0").groupBy("slide_id").agg(F.min("image_name").alias("overview"))
    return _slides(spark, d, "slide_id").join(lv, "slide_id").join(o, "slide_id", "left").select("slide_id", "level_idx", "image_w", "overview")


@q(
    "normalised_metadata",
    """SELECT m.slide_id, count(*) AS deliveries, bool_or(scanner_manufacturer IS NOT NULL) AS has_maker, min(s.magnification) AS magnification, arg_max(m.scanner_model, m.delivered_at) AS last_model FROM slide_metadata m LEFT JOIN slides s ON m.slide_id = s.slide_id GROUP BY m.slide_id HAVING count(*) = 1""",
)
def normalised_metadata(spark, d):
    """Metadata of slides delivered once, beside the slide's own."""
    m = table(spark, d, "slide_metadata").groupBy("slide_id").agg(F.count("*").alias("deliveries"), F.bool_or(F.col("scanner_manufacturer").isNotNull()).alias("has_maker"), F.max_by("scanner_model", "delivered_at").alias("last_model"))
    return m.where("deliveries = 1").join(_slides(spark, d, "slide_id", "magnification"), "slide_id", "left").select("slide_id", "deliveries", "has_maker", "magnification", "last_model")


@q(
    "normalised_metadata_all",
    """SELECT m.slide_id, count(*) AS deliveries, bool_or(scanner_manufacturer IS NOT NULL) AS has_maker, min(s.magnification) AS magnification, arg_max(m.scanner_model, (m.delivered_at, m.meta_id)) AS last_model FROM slide_metadata m LEFT JOIN slides s ON m.slide_id = s.slide_id GROUP BY m.slide_id""",
)
def normalised_metadata_all(spark, d):
    """Metadata of every slide that was delivered, however often, beside the slide's own; ``last_model`` is the last one written, of equal times the one with the greater ``meta_id``."""
    written = F.when(F.col("scanner_model").isNotNull(), F.struct("delivered_at", "meta_id"))
    m = table(spark, d, "slide_metadata").groupBy("slide_id").agg(F.count("*").alias("deliveries"), F.bool_or(F.col("scanner_manufacturer").isNotNull()).alias("has_maker"), F.max_by("scanner_model", written).alias("last_model"))
    return m.join(_slides(spark, d, "slide_id", "magnification"), "slide_id", "left").select("slide_id", "deliveries", "has_maker", "magnification", "last_model")


@q("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS k FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Events per hour and type: the batch form of the discovery stream's windows."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("events"), F.sum("k").alias("k"))


