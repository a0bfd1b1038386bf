import math

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import measures as ms
from shelfmark.functions import paths as pt
from shelfmark.functions import times as tm
from shelfmark.operators.geocode import preferred_names
from shelfmark.operators.origin import classify_origin


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.o for r in rows.select("k", make(F.col("v")).alias("o")).orderBy("k").collect()]


def test_segment_kinds(spark):
    names = ["Photos", "2019-07 July", "июнь 2020", "New folder", "Новая папка (3)", "Мая", "2021", "Trip 2020", "", "сентября 12"]
    assert column(spark, names, pt.segment_kind) == [0, 1, 1, 0, 0, 2, 1, 2, 0, 1]


def test_paths(spark):
    p = ["D:\\a\\b\\c.jpg", "/x/y.tar.gz", "name.zip", "\\\\nas\\share\\f.png"]
    assert column(spark, p, pt.path_segments) == [["a", "b"], ["x"], [], ["nas", "share"]]
    assert column(spark, p, pt.volume_of) == ["D:", "/", "/", "\\\\nas\\share"]
    assert column(spark, p, pt.archive_kind) == [None, "tar", "zip", None]
    assert column(spark, p, pt.media_kind) == ["image", "other", "other", "image"]
    assert column(spark, p, pt.folder_of) == ["D:\\a\\b", "/x", "", "\\\\nas\\share"]


def test_names(spark):
    assert column(spark, ["a<b>:c", "con", "NUL.txt", " x. ", "", "a" * 130], pt.sanitize_component) == ["a-b--c", "_con", "_NUL.txt", "x", "_", "a" * 120]
    assert column(spark, ["Щука", "Новосибирск", "Foça", "объезд"], pt.latinise) == ["Shchuka", "Novosibirsk", "Foça", "obezd"]
    assert column(spark, ["Академгородок (окрестности)", "Новосибирск 2021 "], pt.place_label) == ["Академгородок", "Новосибирск"]
    assert column(spark, [12, 1, 3, 8, 11], pt.season_of, "int") == ["Winter", "Winter", "Spring", "Summer", "Autumn"]


@pytest.mark.parametrize(
    "name,source,seconds",
    [
        ("20170416_145106.jpg", "filename", 1492354266),
        ("IMG_20170426_132143114.jpg", "filename", 1493212903),
        ("WhatsApp Image 2024-01-02 at 10.11.12.jpeg", "filename", 1704190272),
        ("IMG-20240101-WA0001.jpg", "filename_date", 1704110400),
        ("photo_5@10-11-2019.jpg", "filename_date", 1573387200),
        ("20171316_145106.jpg", "none", None),
        ("19700101_000000.jpg", "none", None),
        ("plain.jpg", "none", None),
    ],
)
def test_filename_times(spark, name, source, seconds):
    got = column(spark, [name], tm.filename_time)[0]
    assert got.time_source == source and got.taken_at == seconds


def test_measures(spark):
    assert column(spark, [3688, 368, 36880], lambda c: ms.jpeg_quality(c), "int") == [50, 95, 5]
    assert [ms.print_need(k) for k in ("A4", "A5", "10x15")] == [8.7, 4.34, 2.09]
    flat, edge = [[0.0] * 5] * 5, [[0.0, 0.0, 9.0, 0.0, 0.0]] * 5
    sharp = column(spark, [flat, edge], ms.laplacian_variance, "array<array<double>>")
    assert sharp[0] == 0 and math.isclose(sharp[1], 162.0)
    bits = column(spark, [[float(k) for k in range(63)]], ms.perceptual_bits, "array<double>")[0]
    assert bits == sum(1 << k for k in range(32, 63))


def test_origins(spark):
    rows = [
        ("D:/p/IMG-20210315-WA0007.jpg", None, None, None, "messenger", "high"),
        ("D:/Screenshots/a.jpg", 1080, 2400, None, "screenshot_phone", "medium"),
        ("D:/p/Screenshot_20190122-181354.jpg", None, None, "Canon", "screenshot_phone", "high"),
        ("D:/p/a.jpg", 4000, 3000, "Canon", "camera", "high"),
        ("D:/p/a.jpg", 4000, 3000, "CanoScan", "document_scan", "high"),
        ("D:/p/download (3).jpg", 1024, 768, None, "web_download", "medium"),
        ("D:/p/20190603_110020.jpg", 1080, 2340, None, "screenshot_phone", "medium"),
        ("D:/p/20200612_135531.jpg", 1080, 3289, None, "screenshot_phone", "low"),
        ("D:/p/DSC_1234.JPG", None, None, None, "camera", "medium"),
        ("D:/p/scan_12.jpg", 1240, 1754, None, "document_scan", "high"),
        ("D:/p/x.jpg", None, None, None, "unknown", "low"),
    ]
    frame = spark.createDataFrame(rows, "display_path string, width int, height int, exif_make string, want string, conf string")
    for r in classify_origin(frame).collect():
        assert (r.origin_class, r.origin_confidence) == (r.want, r.conf), r


def test_spellings(spark):
    rows = [("Paris", ["Париж", "Париж", "Парыж", "Парис"], "Париж"), ("Oslo", ["Oslo"], "Oslo"), ("Omsk", ["Омск", "Омськ"], "Омск"), ("Rome", None, "Rome"), ("X", [" Икс "], "Икс"), (None, [], None)]
    frame = spark.createDataFrame(rows, "name string, alternates array<string>, want string")
    assert [(r.name, r.shown_name) for r in preferred_names(frame).collect()] == [(n, w) for n, _, w in rows]
