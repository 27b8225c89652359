"""Queries over all rows of their tables, on rows that narrower queries leave out."""

import datetime

from slidelake.plans import catalogue


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_metadata_of_slides_delivered_more_than_once(spark, tmp_path):
    early, late = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)
    meta = [
        (1, 1, early, "Leica", "AT2"),
        (2, 2, late, None, "new"), (3, 2, early, "Leica", "old"),
        (5, 3, late, None, "greater id"), (4, 3, late, None, "lesser id"),
        (6, 4, early, None, "known"), (7, 4, late, None, None),
        (8, 5, early, None, None),
    ]
    write(spark, tmp_path, "slide_metadata", meta, "meta_id bigint, slide_id bigint, delivered_at timestamp_ntz, scanner_manufacturer string, scanner_model string")
    write(spark, tmp_path, "slides", [(i, 20.0) for i in (1, 2, 3, 4)], "slide_id bigint, magnification double")
    got = catalogue.QUERIES["normalised_metadata_all"](spark, str(tmp_path)).orderBy("slide_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, True, 20.0, "AT2"), (2, 2, True, 20.0, "new"), (3, 2, False, 20.0, "greater id"), (4, 2, False, 20.0, "known"), (5, 1, False, None, None)]


def test_every_level_is_looked_up(spark, tmp_path):
    write(spark, tmp_path, "slides", [(1,), (2,)], "slide_id bigint")
    levels = [(1, i, 1000 >> i) for i in range(6)]
    write(spark, tmp_path, "levels", [*levels, levels[0], (2, 0, 7)], "slide_id bigint, level_idx int, image_w int")
    write(spark, tmp_path, "leica_images", [(1, 0, "macro"), (1, 1, "image")], "slide_id bigint, image_idx int, image_name string")
    got = catalogue.QUERIES["role_lookup_all"](spark, str(tmp_path)).orderBy("slide_id", "level_idx").collect()
    assert [tuple(r) for r in got] == [*[(*r, "macro") for r in levels], (2, 0, 7, None)]


def test_rows_that_cannot_be_read_stay(spark, tmp_path):
    write(spark, tmp_path, "slide_metadata", [(1, "0,25", None), (2, None, "Scan resolution 0,5 um"), (3, "n/a", None), (4, " ", "Scan resolution 0.5")], "meta_id bigint, mpp string, scan_note string")
    write(spark, tmp_path, "leica_images", [(1, "5000", None, 10, 0), (2, "5", "mm", 10, 1), (3, None, None, 10, 0)], "image_id bigint, view_size_x string, view_unit string, pixel_size_x int, image_idx int")
    images = spark.read.parquet(f"{tmp_path}/leica_images.parquet").selectExpr("*", "0L AS view_offset_x", "0L AS view_offset_y")
    images.write.parquet(f"{tmp_path}/more/leica_images.parquet")
    write(spark, tmp_path, "levels", [(1, 0, 100, 2, "JPEG"), (1, 1, None, 3, "JPEG"), (2, 0, None, 4, None)], "slide_id bigint, level_idx int, compressed_size bigint, frame_count bigint, compression string")
    run = lambda name, folder=tmp_path: sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(folder)).collect())
    assert run("decimal_comma_all") == [(1, 0.25), (2, 0.5), (3, None), (4, 0.5)]
    assert run("view_mpp_all", tmp_path / "more") == [(1, 0.5, True), (2, None, False), (3, None, True)]
    assert run("compressed_size_all") == [(1, 678, 5), (2, None, 4)]
