"""Picture headers, built byte by byte."""

import struct

from shelfmark.operators.origin import classify_origin
from shelfmark.sources import headers as H


def tiff(order, make=b"Canon\0", taken=b"2019:07:14 12:30:05\0", offset=b"+05:00\0", lat=((55, 1), (45, 1), (0, 1)), lon=((37, 1), (30, 1), (36, 1)), refs=(b"N\0", b"W\0"), extra=()):
    """A directory with a camera, a capture time and a position."""
    pack = lambda f, *a: struct.pack(order + f, *a)
    heap, base = b"", 1000

    def data(raw):
        nonlocal heap
        heap += raw
        return base + len(heap) - len(raw)

    def ifd(entries):
        out = pack("H", len(entries))
        for tag, kind, count, value in entries:
            inline = value if isinstance(value, bytes) and len(value) <= 4 else pack("I", value if isinstance(value, int) else data(value))
            out += pack("HHI", tag, kind, count) + inline.ljust(4, b"\0")
        return out + pack("I", 0)

    rationals = lambda x: b"".join(pack("II", *p) for p in x)
    exif = data(ifd([(H.ORIGINAL, 2, len(taken), taken), (H.OFFSET_ORIGINAL, 2, len(offset), offset)]))
    gps = data(ifd([(1, 2, 2, refs[0]), (2, 5, 3, rationals(lat)), (3, 2, 2, refs[1]), (4, 5, 3, rationals(lon))]))
    first = ifd([(H.MAKE, 2, len(make), make), (H.EXIF_IFD, 4, 1, exif), (H.GPS_IFD, 4, 1, gps), *extra])
    head = (b"II" if order == "<" else b"MM") + pack("HI", 42, 8) + first
    return head.ljust(base, b"\0") + heap


def jpeg(exif=None, width=4000, height=3000):
    app1 = b"" if exif is None else b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif
    return b"\xff\xd8" + b"\xff\xe0\0\x10JFIF\0" + bytes(9) + app1 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, height, width) + bytes(20)


def test_camera_time_and_position_in_either_byte_order():
    for order in "<>":
        got = H.header(jpeg(tiff(order)))
        assert (got["image_format"], got["width"], got["height"], got["exif_make"]) == ("JPEG", 4000, 3000, "Canon")
        assert got["exif_taken_at"] == 1563107405.0 and got["exif_offset_minutes"] == 300 and got["has_gps"]
        assert abs(got["gps_latitude"] - 55.75) < 1e-9 and abs(got["gps_longitude"] + 37.51) < 1e-9


def test_dates_offsets_and_positions_that_are_none():
    zero, bad = ((0, 1),) * 3, ((1, 0), (0, 1), (0, 1))
    got = H.header(jpeg(tiff("<", taken=b"0000:00:00 00:00:00\0", offset=b"+99:00\0", lat=zero, lon=zero)))
    assert got["exif_taken_at"] is None and got["exif_offset_minutes"] is None and got["gps_latitude"] is None and got["has_gps"]
    assert H.header(jpeg(tiff("<", lat=bad)))["gps_latitude"] is None
    assert H.header(jpeg(tiff("<", lat=((91, 1), (0, 1), (0, 1)))))["gps_latitude"] is None
    assert H.capture_time(b"2019:02:30 10:00:00") is None and H.capture_time("2020-02-29T10:00:00") is not None and H.capture_time(None) is None
    assert H.clean_text(b"  A\x07B \0rest") == "AB" and H.clean_text(b"\0") is None
    assert H.offset_minutes("-03:30") == -210 and H.offset_minutes("Z") is None


def test_other_formats_and_broken_files():
    assert H.header(b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 640, 480)) == {"image_format": "PNG", "width": 640, "height": 480}
    assert H.header(b"GIF89a" + struct.pack("<HH", 10, 20))["height"] == 20
    assert H.header(b"BM" + bytes(16) + struct.pack("<ii", 7, -9)) == {"image_format": "BMP", "width": 7, "height": 9}
    webp = b"RIFF\0\0\0\0WEBPVP8X" + bytes(4) + bytes(4) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert H.header(webp) == {"image_format": "WEBP", "width": 100, "height": 50}
    got = H.header(tiff(">", extra=((H.WIDTH, 3, 1, struct.pack(">H", 12)), (H.HEIGHT, 3, 1, struct.pack(">H", 8)))))
    assert (got["image_format"], got["width"], got["height"], got["exif_make"]) == ("TIFF", 12, 8, "Canon")
    whole = jpeg(tiff("<"))
    for n in range(0, len(whole), 7):
        H.header(whole[:n])  # nothing raises
    assert H.header(b"") == {} and H.header(b"no picture") == {}
    assert H.header(jpeg(b"II*\0garbage"))["width"] == 4000


def test_headers_feed_the_origin_rules(spark):
    rows = [("D:/a/IMG_1.jpg", jpeg(tiff("<"))), ("D:/a/x.png", b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 1080, 1920)), ("D:/a/y.txt", b"text"), ("D:/a/z.jpg", None), ("D:/a/e.jpg", b"")]
    found = H.picture_headers(spark.createDataFrame(rows, "path string, content binary"))
    told = {r.display_path: r.origin_class for r in classify_origin(found.withColumnRenamed("path", "display_path")).collect()}
    assert len(told) == 5 and told["D:/a/IMG_1.jpg"] == "camera" and told["D:/a/z.jpg"] == told["D:/a/e.jpg"] == "unknown"
    assert H.picture_headers(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_members_hash_as_loose_files_do(spark, tmp_path):
    import zipfile

    from pyspark.sql import functions as F

    from shelfmark.operators import funnel
    from shelfmark.sources import files as src

    texts = {"a.bin": b"x" * 200_000 + b"end", "b.bin": b"", "c.bin": b"y" * 65_536}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, raw in texts.items():
            z.writestr(name, raw)
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    at = raw.index(b"c.bin") + 40
    raw[at] ^= 0xFF  # one member's bytes no longer have its checksum
    (tmp_path / "b.zip").write_bytes(bytes(raw))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    rows = spark.createDataFrame([(str(tmp_path / f"{n}.zip"), "zip") for n in "abc"], "path string, archive_kind string")
    got = {(r.archive_path[-5], r.member_name): r for r in src.member_hashes(rows).collect()}
    loose = spark.createDataFrame(list(texts.items()), "name string, content binary").withColumn("size", F.length("content").cast("long"))
    for r in loose.select("name", funnel.quick_hash(F.col("content"), F.col("size")).alias("q"), funnel.full_hash(F.col("content")).alias("f")).collect():
        assert (got["a", r.name].quick_hash, got["a", r.name].full_hash) == (r.q, r.f)
    assert got["b", "c.bin"].full_hash is None and got["b", "a.bin"].full_hash == got["a", "a.bin"].full_hash and got["c", None].full_hash is None
    stats = {r.archive_path[-5]: r for r in src.archive_stats(src.archive_members(rows), src.member_hashes(rows)).collect()}
    assert [(stats[n].opened, stats[n].members_unreadable) for n in "abc"] == [(True, 0), (True, 1), (False, 0)]
