"""Sources: folders of files, archive members, sidecars, gazetteers, journals and reports."""

from __future__ import annotations

import hashlib
import os
import tarfile
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.functions.paths import archive_kind, media_kind
from shelfmark.operators.funnel import SAMPLE_BYTES

# Folders that hold no files of a person.
PRUNED_FOLDERS = (".git", "__pycache__", "node_modules", "$RECYCLE.BIN", "System Volume Information")
FILE_SCHEMA = "path string, size long, mtime double"
MEMBER_SCHEMA = "archive_path string, member_name string, size long, mtime double, error string"
JOURNAL_SCHEMA = "op_id string, event string, ts double, group_hash string, original string, quarantined string, size long, kind string, error string"
GAZETTEER_SCHEMA = "name string, latitude double, longitude double, population long, country string"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _FolderReader(DataSourceReader):
    """One partition per first-level folder, so that roots are walked side by side."""

    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for root in self.roots:
            if os.path.isdir(root):
                out.append(_Folder(root, False))
                out += [_Folder(e.path, True) for e in sorted(os.scandir(root), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and e.name not in PRUNED_FOLDERS]
        return out or [_Folder("", False)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        for folder, inside, names in os.walk(partition.path):
            inside[:] = sorted(n for n in inside if n not in PRUNED_FOLDERS) if partition.deep else []
            for name in sorted(names):
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                except OSError:
                    continue
                yield path, stat.st_size, stat.st_mtime


class FolderSource(DataSource):
    """``spark.read.format("shelf_folders").option("roots", "a:b").load()``; empty and hidden files are there too.

    For mounts that every executor sees; a missing root gives no rows. Files in object stores are read with Spark's
    own binaryFile source (``binary_files``).
    """

    @classmethod
    def name(cls) -> str:
        return "shelf_folders"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader([r for r in self.options.get("roots", "").split(":") if r])


def read_folders(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, size, mtime, media_kind, archive_kind of every file under the roots."""
    spark.dataSource.register(FolderSource)
    rows = spark.read.format("shelf_folders").option("roots", ":".join(roots)).load()
    return rows.withColumns({"media_kind": media_kind(F.col("path")), "archive_kind": archive_kind(F.col("path"))})


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, mtime, content through Spark's readers. Spark leaves out empty and hidden files there."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").cast("double").alias("mtime"), "content")


def _list(path: str, kind: str) -> Iterator[tuple[str, int, float]]:
    if kind == "zip":
        with zipfile.ZipFile(path) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, i.file_size, datetime(*i.date_time, tzinfo=timezone.utc).timestamp()
    elif kind == "tar":
        with tarfile.open(path, "r:*") as t:
            for m in t:
                if m.isfile():
                    yield m.name, m.size, float(m.mtime)
    elif kind == "7z":
        import py7zr

        with py7zr.SevenZipFile(path) as z:
            for i in z.list():
                if not i.is_directory:
                    yield i.filename, i.uncompressed, i.creationtime.timestamp() if i.creationtime else 0.0
    else:
        import rarfile

        with rarfile.RarFile(path) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, i.file_size, 0.0


def archive_members(files: DataFrame) -> DataFrame:
    """Members of the archives among ``files`` (path, archive_kind); one that can't be opened is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind in zip(batch["path"], batch["archive_kind"], strict=True):
                rows: list[tuple] = []
                try:
                    for name, size, mtime in _list(path, kind):
                        rows.append((path, name, size, mtime, None))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=_MEMBERS)
                            rows = []
                except Exception as e:  # noqa: BLE001 - a broken archive is a finding, not a failure
                    rows.append((path, None, None, None, type(e).__name__))
                yield pd.DataFrame(rows, columns=_MEMBERS)

    return files.where("archive_kind is not null").select("path", "archive_kind").mapInPandas(run, MEMBER_SCHEMA)


_MEMBERS = ["archive_path", "member_name", "size", "mtime", "error"]


def archive_stats(members: DataFrame, hashed: DataFrame | None = None) -> DataFrame:
    """archive_path, opened, members_total (listed), members_unreadable.

    ``hashed`` (of member_hashes) tells which listed members could not be read; without it none counts as unreadable.
    """
    stats = members.groupBy("archive_path").agg(F.bool_and(F.col("error").isNull()).alias("opened"), F.count("member_name").alias("members_total"))
    if hashed is None:
        return stats.withColumn("members_unreadable", F.lit(0).cast("long"))
    listed = members.where("member_name is not null").select("archive_path", "member_name").distinct()
    read = hashed.where("full_hash is not null").select("archive_path", "member_name").distinct()
    lost = listed.join(read, ["archive_path", "member_name"], "left_anti").groupBy("archive_path").agg(F.count("*").alias("members_unreadable"))
    return stats.join(lost, "archive_path", "left").withColumn("members_unreadable", F.coalesce("members_unreadable", F.lit(0)))


def _opened(path: str, kind: str) -> Iterator[tuple[str, int, object]]:
    """(name, size, stream or the error) of every file in an archive, front to back."""
    if kind == "zip":
        with zipfile.ZipFile(path) as z:
            for i in z.infolist():
                if not i.is_dir():
                    try:
                        with z.open(i) as s:
                            yield i.filename, i.file_size, s
                    except (OSError, RuntimeError, zipfile.BadZipFile, NotImplementedError) as e:
                        yield i.filename, i.file_size, e
    elif kind == "tar":
        with tarfile.open(path, "r|*") as t:
            for m in t:
                if m.isfile():
                    yield m.name, m.size, t.extractfile(m)
    elif kind == "7z":
        import py7zr

        with py7zr.SevenZipFile(path) as z:
            for name, s in z.readall().items():
                yield name, len(s.getbuffer()), s
    else:
        import rarfile

        with rarfile.RarFile(path) as z:
            for i in z.infolist():
                if not i.is_dir():
                    with z.open(i) as s:
                        yield i.filename, i.file_size, s


def member_hashes(files: DataFrame) -> DataFrame:
    """archive_path, member_name, size, quick_hash, full_hash: every archive is read once, front to back, in one task.

    quick_hash is the digest of the size and the first and last 64 KiB, as for loose files. A member that can't be read has
    null hashes; an archive that can't be opened is one row without a member. 7z and rar need py7zr and rarfile; without
    them such an archive is one that can't be opened.
    """

    def digests(stream) -> tuple[int, str, str]:
        full, n, head, tail = hashlib.sha256(), 0, b"", b""
        while chunk := stream.read(1 << 20):
            full.update(chunk)
            n += len(chunk)
            if len(head) < SAMPLE_BYTES:
                head += chunk[: SAMPLE_BYTES - len(head)]
            tail = (tail + chunk)[-SAMPLE_BYTES:]
        quick = hashlib.md5(str(n).encode() + head + (tail if n > SAMPLE_BYTES else b""), usedforsecurity=False)
        return n, quick.hexdigest(), full.hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind in zip(batch["path"], batch["archive_kind"], strict=True):
                rows: list[tuple] = []
                try:
                    for name, size, stream in _opened(path, kind):
                        try:
                            if isinstance(stream, Exception):
                                raise stream
                            n, quick, full = digests(stream)
                            rows.append((path, name, n, quick, full))
                        except Exception:  # noqa: BLE001 - an unreadable member is a finding, not a failure
                            rows.append((path, name, size, None, None))
                except Exception:  # noqa: BLE001 - so is a broken archive
                    if not rows:
                        rows.append((path, None, None, None, None))
                yield pd.DataFrame(rows, columns=["archive_path", "member_name", "size", "quick_hash", "full_hash"])

    schema = "archive_path string, member_name string, size long, quick_hash string, full_hash string"
    return files.where("archive_kind is not null").select("path", "archive_kind").mapInPandas(run, schema)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """title, taken_at (epoch), lat, lon, origin_key of JSON sidecars; a position of 0, 0 is none; broken files are left out."""
    place = "struct<latitude: double, longitude: double>"
    stamp = "struct<timestamp: string>"
    schema = f"title string, photoTakenTime {stamp}, creationTime {stamp}, geoData {place}, geoDataExif {place}, googlePhotosOrigin map<string, string>"
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    j = raw.select(F.from_json("value", schema).alias("j")).where("j.title is not null").select("j.*")
    real = lambda c: (F.col(f"{c}.latitude") != 0) | (F.col(f"{c}.longitude") != 0)
    pick = lambda part: F.coalesce(*[F.when(real(c), F.col(f"{c}.{part}")) for c in ("geoData", "geoDataExif")])
    return j.select(
        "title", F.coalesce("photoTakenTime.timestamp", "creationTime.timestamp").try_cast("double").alias("taken_at"), pick("latitude").alias("lat"), pick("longitude").alias("lon"),
        F.get(F.map_keys("googlePhotosOrigin"), F.lit(0)).alias("origin_key"),
    )


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated places; malformed lines are left out, # begins a comment."""
    return spark.read.csv(path, sep="\t", comment="#", mode="DROPMALFORMED", schema=GAZETTEER_SCHEMA)


def write_gazetteer(places: DataFrame, path: str) -> None:
    places.select("name", "latitude", "longitude", "population", "country").write.csv(path, sep="\t")


def read_geonames(spark: SparkSession, path: str, min_population: int = 1000) -> DataFrame:
    """Places of a 19-column dump, with their alternates; lines that do not parse are left out."""
    f = F.split(F.col("value"), "\t")
    rows = spark.read.text(path).where(F.size(f) >= 15)
    out = rows.select(
        F.get(f, F.lit(1)).alias("name"), F.get(f, F.lit(4)).try_cast("double").alias("latitude"), F.get(f, F.lit(5)).try_cast("double").alias("longitude"),
        F.get(f, F.lit(14)).try_cast("long").alias("population"), F.get(f, F.lit(8)).alias("country"), F.split(F.get(f, F.lit(3)), ",").alias("alternates"),
    )
    return out.where((F.col("population") >= min_population) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a torn last line is dropped."""
    return spark.read.schema(JOURNAL_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def write_report(groups: DataFrame, path: str) -> None:
    groups.write.json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def exif_time(text: Column) -> Column:
    """Wall-clock seconds of ``2019:06:15 10:11:12``; null outside 1990 to 2035 or for no date."""
    t = F.try_to_timestamp(F.regexp_extract(text, r"(\d{4}:\d{2}:\d{2}[ T]\d{2}:\d{2}:\d{2})", 1), F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.when(F.year(t).between(1990, 2035), F.unix_timestamp(t).cast("double"))


def exif_degrees(parts: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds with a hemisphere letter."""
    value = F.get(parts, F.lit(0)) + F.coalesce(F.get(parts, F.lit(1)), F.lit(0.0)) / 60 + F.coalesce(F.get(parts, F.lit(2)), F.lit(0.0)) / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)
