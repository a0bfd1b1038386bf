"""Capture times: wall-clock seconds from names and from ranked sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.paths import stem_of

FIRST_YEAR, LAST_YEAR = 1990, 2035
NOON = 12 * 3600
# The shapes of dates in names.
NAME_DATETIME = r"(?<!\d)(20\d{2}|19\d{2})[-_.:]?(\d{2})[-_.:]?(\d{2})[ _tT\-]+(?:at[ ]+|в[ ]+)?(\d{2})[-_.:]?(\d{2})[-_.:]?(\d{2})(?:\d{1,3})?(?!\d)"
NAME_YMD = r"(?<!\d)(20\d{2}|19\d{2})[-_.:]?(\d{2})[-_.:]?(\d{2})(?!\d)"
NAME_DMY = r"(?<!\d)(\d{2})[-_.](\d{2})[-_.](20\d{2}|19\d{2})(?!\d)"
TIME_RANK = {"exif": 0, "sidecar": 1, "filename": 2, "filename_date": 3, "mtime": 4, "none": 5}


def _wall(year: Column, month: Column, day: Column, second_of_day: Column) -> Column:
    y = year.try_cast("int")
    date = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd"))
    return F.when(y.between(FIRST_YEAR, LAST_YEAR), F.unix_timestamp(date).cast("double") + second_of_day)


def filename_time(name: Column) -> Column:
    """struct(taken_at, time_source) of a name's date; noon where it has no time of day. Session time zone is UTC."""
    stem = stem_of(name)
    part = lambda p, k: F.regexp_extract(stem, p, k)
    h, m, s = (part(NAME_DATETIME, k).try_cast("int") for k in (4, 5, 6))
    clock = F.when((h < 24) & (m < 60), h * 3600 + m * 60 + F.least(s, F.lit(59)))
    full = _wall(part(NAME_DATETIME, 1), part(NAME_DATETIME, 2), part(NAME_DATETIME, 3), clock)
    ymd = _wall(part(NAME_YMD, 1), part(NAME_YMD, 2), part(NAME_YMD, 3), F.lit(NOON))
    dmy = _wall(part(NAME_DMY, 3), part(NAME_DMY, 2), part(NAME_DMY, 1), F.lit(NOON))
    source = F.when(full.isNotNull(), "filename").when(F.coalesce(ymd, dmy).isNotNull(), "filename_date").otherwise("none")
    return F.struct(F.coalesce(full, ymd, dmy).alias("taken_at"), source.alias("time_source"))


def best_moment(exif: Column, sidecar: Column, named: Column, mtime: Column, *, offset: float = 0.0, use_mtime: bool = False) -> Column:
    """struct(taken_at, time_source): the camera's time, a sidecar's, the name's, and on request the file's.

    ``named`` is filename_time's result. Sidecar and file times are epochs and get the declared offset.
    """
    late = mtime + offset if use_mtime else F.lit(None).cast("double")
    value = F.coalesce(exif, sidecar + offset, named["taken_at"], late)
    source = (
        F.when(exif.isNotNull(), "exif").when(sidecar.isNotNull(), "sidecar").when(named["taken_at"].isNotNull(), named["time_source"]).when(late.isNotNull(), "mtime").otherwise("none")
    )
    return F.struct(value.alias("taken_at"), source.alias("time_source"))
