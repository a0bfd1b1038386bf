import hashlib
import json
import os
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import archives, events, funnel, index, journal, library, persons, similar
from shelfmark.sources import files as src
from shelfmark.streaming.journal import journal_stream, live_status


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "sub" / ".git").mkdir(parents=True)
    (tmp_path / "a1.txt").write_text("same")
    (tmp_path / "sub" / "a2.txt").write_text("same")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "sub" / ".git" / "x").write_text("hidden")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("in/a.txt", "same")
        z.writestr("in/note.txt", "only here")
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as t:
        t.add(tmp_path / "a1.txt", "a1.txt")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    return tmp_path


def test_folders_and_archives(spark, tree):
    rows = src.read_folders(spark, [str(tree), str(tree / "missing")])
    assert {r.path.removeprefix(f"{tree}/") for r in rows.collect()} == {"a1.txt", "empty.txt", "b.zip", "c.tar.gz", "broken.zip", "sub/a2.txt"}
    members = src.archive_members(rows).collect()
    assert {(m.member_name, m.size) for m in members if m.error is None} == {("in/a.txt", 4), ("in/note.txt", 9), ("a1.txt", 4)}
    assert [m.error for m in members if m.error] == ["BadZipFile"]
    stats = src.archive_stats(src.archive_members(rows))
    hashed = src.member_hashes(rows).where("member_name is not null").select("archive_path", "member_name", "size", "full_hash", F.lit(True).alias("is_archive_member"), F.concat_ws("::", "archive_path", "member_name").alias("display_path"))
    loose = src.binary_files(spark, str(tree), "*.txt").select(F.lit(None).cast("string").alias("archive_path"), F.lit(None).cast("string").alias("member_name"), "size", F.sha2("content", 256).alias("full_hash"), F.lit(False).alias("is_archive_member"), F.col("path").alias("display_path"))
    got = {r.archive_path.rsplit("/", 1)[1]: r.verdict for r in archives.archive_verdicts(stats, archives.member_twins(hashed.unionByName(loose))).collect()}
    assert got == {"b.zip": "partially_redundant", "c.tar.gz": "fully_redundant", "broken.zip": "unread"}


def test_sidecars_and_gazetteer(spark, tmp_path):
    (tmp_path / "a.jpg.json").write_text(json.dumps({"title": "a.jpg", "photoTakenTime": {"timestamp": "100"}, "geoData": {"latitude": 0.0, "longitude": 0.0}, "geoDataExif": {"latitude": 5.0, "longitude": 6.0}, "googlePhotosOrigin": {"webUpload": {}}}))
    (tmp_path / "b.json").write_text("{broken")
    row = src.read_sidecars(spark, str(tmp_path)).collect()
    assert [(r.title, r.taken_at, r.lat, r.lon, r.origin_key) for r in row] == [("a.jpg", 100.0, 5.0, 6.0, "webUpload")]
    (tmp_path / "g.tsv").write_text("# note\nX\t1.5\t2.5\t100\tAA\nbad\tx\ty\tz\tBB\n")
    assert [r.name for r in src.read_gazetteer(spark, str(tmp_path / "g.tsv")).collect()] == ["X"]


def test_exif(spark):
    row = spark.range(1).select(src.exif_time(F.lit("2019:06:15 10:11:12")).alias("a"), src.exif_time(F.lit("0000:00:00 00:00:00")).alias("b"), src.exif_degrees(F.array(F.lit(10.0), F.lit(30.0), F.lit(0.0)), F.lit("S")).alias("c")).first()
    assert (row.a, row.b, row.c) == (1560593472.0, None, -10.5)


def test_journal_batch_and_stream(spark, tmp_path):
    lines = [{"op_id": "1", "event": "move_pending", "ts": 1.0, "size": 5}, {"op_id": "1", "event": "move_done", "ts": 2.0}, {"op_id": "2", "event": "move_pending", "ts": 3.0, "size": 7}, {"op_id": "1", "event": "restored", "ts": 4.0}]
    (tmp_path / "j.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"op_id": "3", "ev')
    want = {"1": "restored", "2": "pending"}
    assert {r.op_id: r.status for r in journal.operations(src.read_journal(spark, str(tmp_path))).collect()} == want
    query = live_status(journal_stream(spark, str(tmp_path))).writeStream.format("memory").queryName("live").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert {r.op_id: r.status for r in spark.sql("select * from live").collect()} == want
    finally:
        query.stop()


def test_upsert_keeps_what_is_fresh(spark):
    cols = "display_path string, size long, source_size long, source_mtime double, quick_hash string, full_hash string, hashed_source_size long, hashed_source_mtime double, last_scan_id string, seen_at double"
    old = spark.createDataFrame([("a", 1, 1, 1.0, "q", "f", 1, 1.0, "s1", 1.0), ("b", 1, 1, 1.0, "q", "f", 1, 1.0, "s1", 1.0), ("c", 1, 1, 1.0, None, None, None, None, "s1", 1.0)], cols)
    new = spark.createDataFrame([("a", 1, 1, 1.0), ("b", 2, 2, 1.0), ("d", 4, 4, 4.0)], "display_path string, size long, source_size long, source_mtime double")
    got = {r.display_path: r for r in index.upsert_files(old, new, "s2", 2.0).collect()}
    assert (got["a"].full_hash, got["b"].full_hash, got["d"].full_hash) == ("f", None, None)
    assert (got["c"].last_scan_id, got["a"].last_scan_id, got["b"].size) == ("s1", "s2", 2)
    kept = index.upsert(spark.createDataFrame([("a", 1.0)], "k string, m double"), spark.createDataFrame([("a", None), ("b", 2.0)], "k string, m double"), ["k"], ("m",))
    assert {r.k: r.m for r in kept.collect()} == {"a": 1.0, "b": 2.0}


def test_decision_axes_are_apart(spark):
    cols = "content_hash string, action string, applied_at double, album_state string, album_applied_at double"
    table = spark.createDataFrame([("a", "keep", 1.0, "print", 2.0)], cols)
    table = index.record_decisions(table, spark.createDataFrame([("a", "quarantine"), ("", "keep")], "content_hash string, action string"))
    assert [tuple(r) for r in table.collect()] == [("a", "quarantine", None, "print", 2.0)]
    cleared = index.clear_decisions(table, spark.createDataFrame([("a",)], "content_hash string"), "action")
    assert [tuple(r) for r in cleared.collect()] == [("a", None, None, "print", 2.0)]
    assert index.pending(table, table).count() == 1 and index.pending(index.mark_applied(table, table, 5.0), table).count() == 0


def test_boundary_rules(spark):
    h = 3600.0
    rows = [("a", 0.0, 10.0, 10.0), ("b", 9 * h, 10.0, 10.001), ("c", 9 * h + 1800, 10.0, 10.05), ("d", 19 * h, None, None), ("e", 19 * h + 10, 50.0, 50.0), ("f", 19 * h + 20, 10.0, 10.0)]
    frame = spark.createDataFrame([(1, *r) for r in rows], "u int, display_path string, taken_at double, lat double, lon double")
    got = {r.display_path: (r.rule, r.warning) for r in events.boundaries(frame, ["u"]).collect()}
    assert got == {"a": ("first", False), "b": (None, False), "c": ("place_change", False), "d": ("time_gap", False), "e": (None, False), "f": (None, True)}
    whole = events.cluster_events(frame, block_s=3600)
    assert {r.display_path: r.event_no for r in whole.collect()} == {r.display_path: r.event_no for r in events.sessions(frame, ["u"]).collect()}


def test_chain_is_one_scene(spark):
    e = spark.createDataFrame([("a", 0, 1.3), ("b", 0b111, 1.3), ("c", 0b111111, 1.3), ("d", 0, 0.7)], "content_hash string, bits long, aspect double")
    t = similar.SimilarThresholds(distance=3)
    members = similar.similar_groups(e, t)
    assert {r.content_hash for r in members.collect()} == {"a", "b", "c"}
    row = similar.group_spread(members, e, 3).first()
    assert (row["size"], row.spread, row.kind) == (3, 6, "scene")
    assert [similar.normalise_threshold(v) for v in (-1, 3, 16, 99)] == [0, 2, 16, 16]


def test_leaders(spark):
    rows = [(1, 9.0, [1.0, 0.0]), (2, 8.0, [0.9, 0.1]), (3, 7.0, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "face_id int, quality double, embedding array<double>")
    got = {r.face_id: r.cluster for r in persons.leader_clusters(frame).collect()}
    assert got == {1: "new-0", 2: "new-0", 3: "new-1"}
    known = spark.createDataFrame([(5, [0.0, 1.0])], "person_id int, centroid array<double>")
    assert {r.face_id: r.cluster for r in persons.leader_clusters(frame, existing=known).collect()}[3] == "5"


def test_names_are_claimed_in_order(spark):
    movers = spark.createDataFrame([("f", "b/x.jpg", "x.jpg", False), ("f", "a/X.jpg", "X.jpg", False), ("f", "c/x.jpg", "x.jpg", True)], "folder string, source string, basename string, in_place boolean")
    there = spark.createDataFrame([("f", "x.jpg"), ("f", "x__1.jpg")], "folder string, name string")
    got = {r.source: r.final_name for r in library.claim_names(movers, there).collect()}
    assert got == {"c/x.jpg": "x.jpg", "a/X.jpg": "X__2.jpg", "b/x.jpg": "x__3.jpg"}


def test_claims_of_families_equal_claims_of_whole_folders(spark):
    r = random.Random(5)
    names = ["x.jpg", "X.jpg", "x__1.jpg", "x__1__1.jpg", "x__2.JPG", ".bashrc", ".bashrc__1", "plain", "plain__1", "a.b.c", "a.b__1.c", "end.", "__1.jpg"]
    rows, there, want = [], [], {}
    for f in range(30):
        there += [(str(f), n) for n in r.sample(names, 3)]
        files = sorted({(r.choice(names), f"{f}/{r.randrange(99)}") for _ in range(12)})
        used = {n.lower() for g, n in there if g == str(f)}
        at_home = files[r.randrange(len(files))]
        used.add(at_home[0].lower())
        for name, source in files:
            final, k, (stem, tail) = name, 0, os.path.splitext(name) if name.rfind(".") > 0 else (name, "")
            while (name, source) != at_home and final.lower() in used:
                final, k = f"{stem}__{k + 1}{tail}", k + 1
            used.add(final.lower())
            want[str(f), name, source] = final
            rows.append((str(f), name, source, (name, source) == at_home))
    r.shuffle(rows)
    movers = spark.createDataFrame(rows, "folder string, basename string, source string, in_place boolean")
    got = library.claim_names(movers, spark.createDataFrame(there, "folder string, name string")).collect()
    assert {(x.folder, x.basename, x.source): x.final_name for x in got} == want and len(got) == len(rows)


def test_plan_fingerprint_is_the_digest_of_sorted_lines(spark):
    rows = [("b", "x"), ("a", "ü"), ("é", "y"), ("a", "b")]
    frame = spark.createDataFrame(rows, "source string, destination string").repartition(3)
    want = lambda some: hashlib.sha256("".join(sorted(f"{a}\0{b}\n" for a, b in some)).encode()).hexdigest()[:16]
    assert [tuple(x) for x in library.plan_fingerprint(frame).collect()] == [(want(rows),)]
    assert [tuple(x) for x in library.plan_fingerprint(frame.limit(0)).collect()] == [(want([]),)]


def test_album_folders(spark):
    day = 1_600_000_000
    rows = [(1, float(day), 50, "Lake"), (2, float(day + 60), 50, "Lake"), (3, float(day), 50, None), (4, float(day), 2, "Tiny")]
    got = {r.event_id: (r.folder, r.needs_human) for r in library.album_folders(spark.createDataFrame(rows, "event_id int, start_at double, size int, subject string").withColumn("confirmed", F.lit(False)), library.LibraryLayout("/l")).collect()}
    assert got == {1: ("2020/2020-09-13 Lake", False), 2: ("2020/2020-09-13 Lake (2)", True), 3: ("2020/2020-09-13", False), 4: ("2020/2020-09 Сентябрь", False)}


def test_empty_files_are_no_duplicates(spark):
    rows = spark.createDataFrame([("a", 0, b""), ("b", 0, b""), ("c", 1, b"x"), ("d", 1, b"x"), ("e", 1, b"y")], "display_path string, size long, content binary")
    got = funnel.duplicate_groups(funnel.funnel(rows)).collect()
    assert [(r.n, r.wasted_bytes, r.first_path) for r in got] == [(2, 1, "c")]
