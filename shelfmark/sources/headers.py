"""Picture headers without decoding: dimensions, camera data, capture time and position of JPEG, TIFF, PNG, GIF, WebP and BMP."""

from __future__ import annotations

import re
import struct
from calendar import timegm
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a file that are looked at: headers and their metadata stand first.
HEAD_BYTES = 1 << 20
# Tags of the metadata standard.
MAKE, MODEL, SOFTWARE, DATETIME, EXIF_IFD, GPS_IFD = 0x010F, 0x0110, 0x0131, 0x0132, 0x8769, 0x8825
ORIGINAL, DIGITIZED, OFFSET_ORIGINAL, WIDTH, HEIGHT = 0x9003, 0x9004, 0x9011, 0x0100, 0x0101
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
_TIME = re.compile(r"(\d{4})[:\-/](\d\d)[:\-/](\d\d)[ T](\d\d):(\d\d):(\d\d)")
_OFFSET = re.compile(r"([+-])(\d\d):?(\d\d)")
FIELDS = (
    ("path", pa.string()), ("image_format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("exif_make", pa.string()), ("exif_model", pa.string()), ("exif_software", pa.string()),
    ("exif_taken_at", pa.float64()), ("exif_offset_minutes", pa.int32()), ("has_gps", pa.bool_()), ("gps_latitude", pa.float64()), ("gps_longitude", pa.float64()),
)


def clean_text(value: object) -> str | None:
    """Printable text without zero bytes and space around; nothing left is no text."""
    if isinstance(value, bytes):
        value = value.decode("utf-8", "replace")
    text = "".join(c for c in str(value or "").split("\0")[0] if c.isprintable()).strip()
    return text or None


def capture_time(value: object) -> float | None:
    """Seconds of a wall clock; a date of zeros, or one that the calendar lacks, is none."""
    m = _TIME.match(clean_text(value) or "")
    if not m:
        return None
    y, mo, d, h, mi, s = map(int, m.groups())
    days = (31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    if not (y >= 1 and 1 <= mo <= 12 and 1 <= d <= days[mo - 1] and h < 24 and mi < 60 and s < 60):
        return None
    return float(timegm((y, mo, d, h, mi, s)))


def offset_minutes(value: object) -> int | None:
    m = _OFFSET.fullmatch(clean_text(value) or "")
    if not m or int(m[2]) > 14 or int(m[3]) > 59:
        return None
    return (1 if m[1] == "+" else -1) * (60 * int(m[2]) + int(m[3]))


def degrees(parts: object) -> float | None:
    """Degrees, minutes and seconds as one number; fewer parts count as zeros, a part without a value makes it unknown."""
    if not isinstance(parts, tuple) or not parts or any(p is None for p in parts):
        return None
    return sum(float(p) / 60**k for k, p in enumerate(parts[:3]))


class _Ifds:
    """Directories of tags, as TIFF lays them out."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.order = {b"II": "<", b"MM": ">"}[raw[:2]]
        if struct.unpack_from(self.order + "H", raw, 2)[0] != 42:
            raise ValueError("no TIFF header")
        self.first = self.read(struct.unpack_from(self.order + "I", raw, 4)[0])

    def read(self, at: int) -> dict[int, object]:
        found: dict[int, object] = {}
        try:
            (n,) = struct.unpack_from(self.order + "H", self.raw, at)
            for k in range(n):
                tag, kind, count = struct.unpack_from(self.order + "HHI", self.raw, at + 2 + 12 * k)
                size = _SIZES.get(kind, 0) * count
                if not size or size > len(self.raw):
                    continue
                place = at + 10 + 12 * k
                if size > 4:
                    (place,) = struct.unpack_from(self.order + "I", self.raw, place)
                if place + size <= len(self.raw):
                    found[tag] = self.value(kind, count, place)
        except struct.error:  # a directory that is cut off: what was read of it counts
            pass
        return found

    def value(self, kind: int, count: int, at: int) -> object:
        if kind in (1, 2, 6, 7):
            return self.raw[at : at + count]
        if kind in (5, 10):
            pairs = struct.unpack_from(self.order + ("II" if kind == 5 else "ii") * count, self.raw, at)
            return tuple(a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True))
        return struct.unpack_from(self.order + {3: "H", 4: "I", 8: "h", 9: "i"}[kind] * count, self.raw, at)

    def below(self, tag: int) -> dict[int, object]:
        at = self.first.get(tag)
        return self.read(at[0]) if isinstance(at, tuple) and at and isinstance(at[0], int) else {}


def _exif(raw: bytes) -> dict[str, object]:
    ifds = _Ifds(raw)
    first, exif, gps = ifds.first, ifds.below(EXIF_IFD), ifds.below(GPS_IFD)
    times = [t for t in map(capture_time, (exif.get(ORIGINAL), exif.get(DIGITIZED), first.get(DATETIME))) if t is not None]
    lat, lon = degrees(gps.get(2)), degrees(gps.get(4))
    if lat is not None and (clean_text(gps.get(1)) or "N").upper().startswith("S"):
        lat = -lat
    if lon is not None and (clean_text(gps.get(3)) or "E").upper().startswith("W"):
        lon = -lon
    if not lat and not lon:  # a stripped position is often left as zeros
        lat = lon = None
    return {
        "exif_make": clean_text(first.get(MAKE)), "exif_model": clean_text(first.get(MODEL)), "exif_software": clean_text(first.get(SOFTWARE)),
        "exif_taken_at": times[0] if times else None, "exif_offset_minutes": offset_minutes(exif.get(OFFSET_ORIGINAL)), "has_gps": bool(gps),
        "gps_latitude": lat if lat is not None and abs(lat) <= 90 else None, "gps_longitude": lon if lon is not None and abs(lon) <= 180 else None,
    }


def _jpeg(raw: bytes) -> dict[str, object]:
    found: dict[str, object] = {"image_format": "JPEG"}
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            try:
                found |= _exif(raw[at + 10 : at + 2 + size])
            except (KeyError, ValueError, struct.error):
                pass
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            found["height"], found["width"] = struct.unpack_from(">HH", raw, at + 5)
            break
        if marker == 0xDA:
            break
        at += 2 + size
    return found


def _webp(raw: bytes) -> dict[str, object]:
    found: dict[str, object] = {"image_format": "WEBP"}
    kind, body = raw[12:16], raw[20:30]
    if kind == b"VP8X":
        found["width"], found["height"] = (1 + int.from_bytes(body[k : k + 3], "little") for k in (4, 7))
    elif kind == b"VP8 ":
        found["width"], found["height"] = (x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
    elif kind == b"VP8L":
        bits = int.from_bytes(body[1:5], "little")
        found["width"], found["height"] = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return found


def header(raw: bytes) -> dict[str, object]:
    """What a file's first bytes say; an empty dictionary where they are no picture's, and what was read of a broken one."""
    try:
        if raw[:2] == b"\xff\xd8":
            return _jpeg(raw)
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return {"image_format": "PNG"} | dict(zip(("width", "height"), struct.unpack_from(">II", raw, 16), strict=True))
        if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            return _webp(raw)
        if raw[:6] in (b"GIF87a", b"GIF89a"):
            return {"image_format": "GIF"} | dict(zip(("width", "height"), struct.unpack_from("<HH", raw, 6), strict=True))
        if raw[:2] == b"BM":
            width, height = struct.unpack_from("<ii", raw, 18)
            return {"image_format": "BMP", "width": width, "height": abs(height)}
        if raw[:4] in (b"II*\0", b"MM\0*"):
            first = _Ifds(raw).first
            size = {name: first[tag][0] for name, tag in (("width", WIDTH), ("height", HEIGHT)) if isinstance(first.get(tag), tuple) and first[tag]}
            return {"image_format": "TIFF"} | _exif(raw) | size
    except (struct.error, ValueError, KeyError):
        pass
    return {}


def picture_headers(files: DataFrame) -> DataFrame:
    """One row per file of ``files`` (path, content): FIELDS. Nothing is decoded and nothing raises.

    Only the first HEAD_BYTES are looked at. A file that is no picture, null or empty content has nulls and no position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p, "has_gps": False} | header(c or b"") for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind) for n, kind in FIELDS], [n for n, _ in FIELDS])

    names = {pa.string(): "string", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean"}
    head = files.selectExpr("path", f"substring(content, 1, {HEAD_BYTES}) AS content")
    return head.mapInArrow(run, ", ".join(f"{n} {names[kind]}" for n, kind in FIELDS))
