from slidelake.operators import areas as ar


def joint(a, b, direction, x, y, joined=1, confidence=99):
    return f'<TileJointInfo FlagJoined="{joined}" Confidence="{confidence}" Direction="{direction}" Tile1="{a}" Tile2="{b}" OverlapX="{x}" OverlapY="{y}"/>'


def xmp(right="RIGHT", up="UP"):
    first = joint(1, 2, right, 100, 0) + joint(2, 3, up, 0, 80) + joint(1, 4, up, 0, 999, joined=0) + joint(3, 4, right, 999, 0, confidence=10)
    second = joint(1, 2, right, 50, 0)
    return (
        f'<E><iScan/><SlideStitchInfo><ImageInfo AOIScanned="1" Width="1000" Height="500" NumCols="2" NumRows="2">{first}</ImageInfo>'
        f'<ImageInfo AOIScanned="0" Width="1000" Height="500" NumCols="9" NumRows="9"/><ImageInfo Width="1000" Height="500" NumCols="3" NumRows="1">{second}</ImageInfo>'
        '</SlideStitchInfo><AoiOrigin><AOI0 OriginX="4000" OriginY="1000"/><AOI2 OriginX="10000" OriginY="0"/></AoiOrigin></E>'
    )


def frame(spark, *texts):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, xmp string")


def test_areas_and_overlaps(spark):
    areas = ar.scanned_areas(frame(spark, xmp(), None, "", "<ImageInfo", "no xml"), "xmp")
    assert sorted((r.path, r.area, r.cols, r.rows, r.origin_col, r.origin_row) for r in areas.collect()) == [("p0", 0, 2, 2, 4, 2), ("p0", 2, 3, 1, 10, 0)]
    expected = [(0, "x", 0, 100.0), (0, "y", 0, 80.0), (2, "x", 0, 50.0), (2, "x", 1, 50.0)]
    assert sorted((r.area, r.axis, r.boundary, r.overlap) for r in ar.boundaries(areas).collect()) == expected
    turned = ar.scanned_areas(frame(spark, xmp("LEFT", "DOWN")), "xmp")
    assert sorted((r.area, r.axis, r.boundary, r.overlap) for r in ar.boundaries(turned).collect()) == expected


def test_placements(spark):
    got = sorted((r.area, r.grid_x, r.grid_y, r.x, r.y) for r in ar.placements(ar.scanned_areas(frame(spark, xmp()), "xmp")).collect())
    assert got == [(0, 4, 2, 0.0, 1000.0), (0, 4, 3, 0.0, 1420.0), (0, 5, 2, 900.0, 1000.0), (0, 5, 3, 900.0, 1420.0), (2, 10, 0, 6000.0, 0.0), (2, 11, 0, 6950.0, 0.0), (2, 12, 0, 7900.0, 0.0)]
    assert ar.placements(ar.scanned_areas(frame(spark, "x"), "xmp")).count() == 0
