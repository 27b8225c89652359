from datetime import datetime

from pyspark.sql import functions as F

from slidelake.functions import metadata as md
from slidelake.plans import slides as sl
from tests.tiff_builder import build, tiled

COLUMNS = "fmt string, d string, software string, make string, model string, tags map<int,string>, xr double, yr double, unit int"


def read(spark, fmt, description="", software=None, make=None, model=None, tags=None, xr=None, yr=None, unit=2):
    df = spark.createDataFrame([(fmt, description, software, make, model, tags or {}, xr, yr, unit)], COLUMNS)
    return df.select(md.metadata(*[F.col(c) for c in ("fmt", "d", "software", "make", "model", "tags", "xr", "yr", "unit")]).alias("m")).collect()[0].m


def test_svs(spark):
    m = read(spark, "svs", "Aperio Image Library v3.1\r\n900x700|AppMag = 63|ScanScope ID = KX77|Date = 02/28/17|Time = 23:05:41|Time Zone = GMT+09:30|MPP = 0,1725|Title = \0|Barcode = Z-9")
    assert (m.magnification, m.manufacturer, m.model, m.serial, m.barcode, m.label_text, m.mpp_x) == (63.0, "Leica Biosystems", "Aperio", "KX77", "Z-9", None, 0.1725)
    assert m.acquired == datetime(2017, 2, 28, 23, 5, 41) and m.offset_minutes == 570 and m.software == ["Aperio Image Library v3.1"]
    m = read(spark, "svs", "Aperio Image, Grundium Ocus\nScan resolution 0,25")
    assert (m.manufacturer, m.model, m.software, m.mpp_x) == ("Grundium", "Ocus", None, 0.25)


FORMATS = ["svs", "mikroscan", "motic", "3dhistech", "philips", "huron", "trestle", "ventana", "argos", "leica-scn", "qptiff", "ndpi", "ome-tiff", "none", None]


def test_degenerate_descriptions(spark):
    tags = {700: "<iScan", 65000: "x", 65449: ";\n=;"}
    rows = [(fmt, text, None, None, None, tags, None, None, 2) for fmt in FORMATS for text in ("", "\r\n", "|", "free < text", "<a><b", "x" * 100_000, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = df.select(md.metadata(*[F.col(c) for c in ("fmt", "d", "software", "make", "model", "tags", "xr", "yr", "unit")]).alias("m")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.m.magnification is None and r.m.acquired is None and r.m.barcode is None and r.m.mpp_x is None


def test_ndpi(spark):
    m = read(spark, "ndpi", None, "NDP.scan", "Hamamatsu", "C10730", {65421: "20.0", 65442: "N0077", 306: "2014:03:02 21:30:05", 65468: " \0", 65422: "5", 65449: "Product=C1\r;Shading\r;ID=4"}, 25000.0, 25000.0, 3)
    assert (m.magnification, m.manufacturer, m.software, m.serial, m.acquired, m.barcode) == (20.0, "Hamamatsu", ["NDP.scan"], "N0077", datetime(2014, 3, 2, 21, 30, 5), None)
    assert m.properties == {"Product": "C1", "Shading/ID": "4", "x_offset_from_slide_center": "5"} and m.mpp_x == 0.4


def test_philips(spark):
    a = lambda n, v: f'<Attribute Name="{n}" Group="0x1">{v}</Attribute>'
    m = read(spark, "philips", "<DataObject>" + a("DICOM_MANUFACTURER", "PHILIPS") + a("DICOM_SOFTWARE_VERSIONS", "&quot;1.6&quot; &quot;4.0.3&quot;") + a("PIM_DP_UFS_BARCODE", "VHJheSA0Mi9i") + a("DICOM_PIXEL_SPACING", "&quot;0.00025&quot; &quot;0.00026&quot;") + a("DICOM_ACQUISITION_DATETIME", "20190203040506.000000"))
    assert (m.manufacturer, m.software, m.barcode, round(m.mpp_x, 6), round(m.mpp_y, 6), m.acquired) == ("PHILIPS", ["1.6", "4.0.3"], "Tray 42/b", 0.26, 0.25, datetime(2019, 2, 3, 4, 5, 6))


def test_others(spark):
    m = read(spark, "3dhistech", "h|AppMag = 20|Date = 17/11/2018|Time = 08:01:59|MPP = 0.1625")
    assert (m.acquired, m.mpp_x) == (datetime(2018, 11, 17, 8, 1, 59), 0.1625)
    m = read(spark, "mikroscan", "Mikroscan Image Structure|QX2 SERIAL # = 88|Date = 07/04/21|Time = 16:20:00")
    assert (m.manufacturer, m.model, m.serial, m.acquired) == ("Mikroscan", "QX2", "88", datetime(2021, 7, 4, 16, 20))
    assert read(spark, "motic", "Motic V1.0.0|AppMag = 40|Barcode = x").software == ["V1.0.0"]
    m = read(spark, "huron", "Scan Size = 1x1 mm\nResolution = 0.40 um\nScan Started = 2022:01:31 06:07:08\nBarcode = VHJheSA0Mi9i\nDeviceID = D", "S", "Huron", "LE")
    assert (m.mpp_x, m.barcode, m.serial, m.acquired) == (0.4, "Tray 42/b", "D", datetime(2022, 1, 31, 6, 7, 8))
    m = read(spark, "trestle", "Objective Power=10;OverlapsXY=64 64", xr=0.9, yr=0.8)
    assert (m.magnification, m.mpp_y, m.properties["OverlapsXY"]) == (10.0, 0.8, "64 64")
    m = read(spark, "ventana", tags={700: '<X><iScan Magnification="20" ScanRes="0.46" UnitNumber="20" BuildVersion="3.3" Barcode1D=" " Barcode2D="two"/></X>'})
    assert (m.magnification, m.serial, m.software, m.barcode, m.mpp_x, m.properties["UnitNumber"]) == (20.0, "20", ["3.3"], "two", 0.46, "20")
    m = read(spark, "argos", tags={65000: "<Argos.Scan.Metadata><ObjectiveMagnification>20</ObjectiveMagnification><AcquisitionDate>05.06.2021</AcquisitionDate><AcquisitionTime>10:11:12</AcquisitionTime><ScanArea><X1>1</X1></ScanArea></Argos.Scan.Metadata>"}, xr=20000.0, yr=20000.0, unit=3)
    assert (m.magnification, m.acquired, m.properties["ScanArea.X1"], m.mpp_x) == (20.0, datetime(2021, 5, 6, 10, 11, 12), "1", 0.5)
    m = read(spark, "qptiff", "<P><AcquisitionSoftware>VectraPolaris 1.0.7</AcquisitionSoftware><Objective>20x</Objective></P>", tags={306: "2019:01:02 03:04:05"})
    assert (m.model, m.software, m.magnification, m.acquired) == ("VectraPolaris", ["1.0.7"], 20.0, datetime(2019, 1, 2, 3, 4, 5))


def test_leica_main_image(spark):
    image = lambda n, ox, vx, px, ob: f'<image name="{n}"><creationDate>2016-05-04T03:02:01.12+02:00</creationDate><device model="Leica SCN400;B" version="1.4; 2"/><pixels sizeX="{px}" sizeY="10"/><view sizeX="{vx}" sizeY="20" offsetX="{ox}" offsetY="0"/><scanSettings><objectiveSettings><objective>{ob}</objective></objectiveSettings></scanSettings></image>'
    m = read(spark, "leica-scn", f'<scn xmlns="x"><collection sizeX="900" sizeY="20"><barcode>VHJheSA0Mi9i</barcode>{image("macro", 0, 900, 5000, 1)}{image("a", 5, 100, 200, 20)}{image("b", 5, 100, 400, 40)}{image("c", 6, 100, 400, 63)}</collection></scn>')
    assert (m.magnification, m.model, m.software, m.barcode, m.offset_minutes) == (40.0, "Leica SCN400", ["1.4", "2"], "Tray 42/b", 120)
    assert m.mpp_x == 100 / 400 / 1000 and m.acquired == datetime(2016, 5, 4, 3, 2, 1, 120000)


def test_files_to_levels(spark, tmp_path):
    frame = [b"x" * 10]
    svs = [tiled(64, 32, 16, frame * 7 + [b""], "Aperio Image Library|AppMag = 20|MPP = 0.5"), tiled(32, 16, 16, frame * 2, "Aperio Image Library"), tiled(16, 8, 16, frame, "Aperio Image Library"), tiled(15, 9, 16, frame, "Aperio\nmacro 15x9"), tiled(10, 5, 16, frame, "Aperio Image Library"), tiled(8, 4, 16, frame, "Aperio Image Library")]
    (tmp_path / "a.svs").write_bytes(build(svs))
    (tmp_path / "b.txt").write_bytes(b"text")
    pages = sl.read_pages(spark, str(tmp_path))
    rows = sl.slides(pages)
    assert {(r.path[-5:], r.format, r.metadata.mpp_x) for r in rows.collect()} == {("a.svs", "svs", 0.5), ("b.txt", None, None)}
    found = sl.images(pages, rows)
    assert [r.role for r in found.orderBy("page_idx").collect()] == ["level", "level", "level", "overview", "level", "level"]
    got = [(r.level_idx, r.pyramid_index, r.mpp_x, r.tiled_w, r.tiled_h, r.missing, r.compressed_size) for r in sl.levels(found).orderBy("level_idx").collect()]
    assert got == [(0, 0, 0.5, 4, 2, 1, 70), (1, 1, 1.0, 2, 1, 0, 20), (2, 2, 2.0, 1, 1, 0, 10)]  # 10 wide is no power of two: it and all behind it are left out


def test_ndpi_roles_and_last_of_role(spark, tmp_path):
    from slidelake.functions import formats as f

    def page(lens, w, compression=7):
        return {256: ("I", [w]), 257: ("I", [8]), 259: ("H", [compression]), 278: ("I", [8]), 65420: ("I", [1]), 65421: ("s", lens)}, [b"x" * 4]

    (tmp_path / "a.ndpi").write_bytes(build([page("20.0", 64), page("10.0", 32), page("-1", 20), page("-2", 10)]))
    pages = sl.read_pages(spark, str(tmp_path))
    found = sl.images(pages, sl.slides(pages)).orderBy("page_idx").collect()
    assert [(r.role, r.strategy) for r in found] == [("level", "one frame re-tiled"), ("level", "one frame re-tiled"), ("overview", "one frame re-tiled"), (None, "one frame re-tiled")]
    df = spark.createDataFrame([(["level", "label", "level"],), ([],)], "roles array<string>")
    assert [tuple(r) for r in df.select(f.last_of_role(F.col("roles"), "level").alias("a"), f.last_of_role(F.col("roles"), "label").alias("b")).collect()] == [(2, 1), (None, None)]
