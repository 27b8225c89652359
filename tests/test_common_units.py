import pytest

from slidelake.operators import common_units as cu

META = "meta_id bigint, slide_id bigint, mpp string, mpp_unit string, pixel_spacing string, scan_note string, field string"
LEICA = "image_id bigint, slide_id bigint, image_name string, view_size_x string, view_size_y string, view_unit string, pixel_size_x int, pixel_size_y int"


@pytest.fixture(name="found")
def make_found(spark, tmp_path):
    def run(meta, leica=()):
        spark.createDataFrame([(i, s, *r, "extra") for i, (s, *r) in enumerate(meta, 1)], META).write.mode("overwrite").parquet(f"{tmp_path}/slide_metadata.parquet")
        spark.createDataFrame(list(leica), LEICA).write.mode("overwrite").parquet(f"{tmp_path}/leica_images.parquet")
        slides = [(s, "ndpi" if s < 1000 else "svs", s % 3) for s in {m[0] for m in meta} | {i[1] for i in leica}]
        spark.createDataFrame(slides, "slide_id bigint, format string, site_id int").write.mode("overwrite").parquet(f"{tmp_path}/slides.parquet")
        return sorted(tuple(r) for r in cu.units_found(spark, str(tmp_path)).collect())

    return run


MPP = [
    ("0,2500", None, None, None),
    ("510.7", "nm", None, 510700),
    ("0.0002564", "Millimeter", None, 256400),
    ("20000", "px/cm", None, 500000),
    ("50800", "dots per inch", None, 500000),
    ("5.0e-7 m", None, None, 500000),
    ("17.959,77011", None, "Auflösung in Pixel je cm", 556800),
    ("51,147.80507", None, "resolution given as dots per inch", 496600),
    ("20000.5 [pixels per cm]", None, None, 499988),
    ("0.5 microns per pixel", None, None, None),
    ("10035.12293", "CENTIMETER", None, 996500),
    ("1.023", None, None, None),
    ("-1", None, None, None),
    ("NaN", None, None, None),
    ("0", "nm", None, None),
    (None, "um", None, None),
    ("", None, None, None),
    ("x" * 10_000, None, "label reprinted at 300 dpi", None),
    ("2000", None, "label reprinted at 300 dpi", 2000000),
]


def test_mpp(found):
    got = found([(i, v, u, None, n) for i, (v, u, n, _) in enumerate(MPP)])
    assert {r[0] - 1: r[3] for r in got} == {i: e for i, (*_, e) in enumerate(MPP) if e is not None}


def test_spacing_rows_first_and_both_axes(found):
    got = found([(1, None, None, "0.0005\\0.0006", None), (2, None, None, "[500.5, 510] nm", None), (3, None, None, "0,25 / 0,26", None), (4, None, None, '"0.00005" "0.00006" cm', None), (5, None, None, "n/a", None)])
    assert got == [(2, "pixel_spacing", "x", 510000), (2, "pixel_spacing", "y", 500500), (3, "pixel_spacing", "x", 260000), (3, "pixel_spacing", "y", 250000), (4, "pixel_spacing", "x", 600000), (4, "pixel_spacing", "y", 500000)]


def test_views_and_links(found):
    leica = [
        (1, 1, "macro", "26355300", "74,910,700", None, 100, 100),
        (2, 1, "image", "26.3677", "74.9006", "mm.", 100, 100),
        (3, 1, "image", "3.5", "4.0", None, 7000, 8000),  # mm by the slide's pixel, not cm
        (4, 2, "image", "0.5", "1.0", None, 10, 10),
        (5, 3, "image", "unknown", "", None, None, None),
        (6, 3, "image", "26,312 µm", "13000µm", None, 0, None),
    ]
    got = found([(1, "0.5", "um", None, None)], leica)
    assert [r for r in got if r[0] in (2, 3, 6)] == [(2, "view_size", "x", 26367700000), (2, "view_size", "y", 74900600000), (3, "view_size", "x", 3500000000), (3, "view_size", "y", 4000000000), (6, "view_size", "x", 26312000000), (6, "view_size", "y", 13000000000)]
    assert not [r for r in got if r[0] in (1, 5)]


def test_unknown_spelling_is_learnt_from_links(found):
    meta = [(i, "0.5", "um", None, None) for i in range(12)] + [(i, "500.0", "milliwotsits", None, None) for i in range(12)]
    assert {r[3] for r in found(meta)} == {500000}


def test_knowledge_spreads_along_a_chain(found):
    # um - aa - bb - cc - dd, neighbours share slides; all but the first are pixels per mm, which read as nm are plausible too
    sizes = [1 + i / 10 for i in range(12)]
    written = {"um": lambda p: f"{p:.2f}"}
    chain = ["um", "wotsaa", "wotsbb", "wotscc", "wotsdd"]
    meta = [(100 * k + i, written.get(u, lambda p: f"{1000 / p:.2f}")(p), u, None, None) for k, pair in enumerate(zip(chain, chain[1:])) for u in pair for i, p in enumerate(sizes)]
    got = {r[0]: r[3] for r in found(meta)}
    for n, (_, v, u, *_) in enumerate(meta, 1):
        assert u == "um" or abs(got[n] - 1e9 / float(v)) < 1


def test_a_source_may_mix_conversions(found):
    """Bare numbers of one format and site, some per cm, some per inch: both snap; a lone number takes the commoner one that is open."""
    spacing = [(i, None, None, f"{s:.6f}\\{s:.6f}", None) for i, s in ((i, (0.5 + i / 100) / 1000) for i in range(20))]
    bare = [(i, f"{10000 / (0.5 + i / 100):.5f}" if i < 13 else f"{25400 / (0.5 + i / 100):.5f}", None, None, None) for i in range(20)]
    lone = [(500, "40000.5", None, None, None), (1500, "40000.5", None, None, None)]
    got = {r[0]: r[3] for r in found([*bare, *lone, *spacing]) if r[1] == "mpp"}
    assert all(abs(got[i + 1] - (500000 + 10000 * i)) < 5 for i in range(20))
    assert got[21] == got[22] == round(1e10 / 40000.5)  # the second by its field, as its own format never says


def test_empty(found):
    assert found([]) == []
