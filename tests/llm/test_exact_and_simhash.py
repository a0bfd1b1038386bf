import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from shelfmark.llm import simhash as S
from shelfmark.llm.exact_dedup import exact_dedup
from shelfmark.operators.components import connected_components


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_dedup_equals_brute_force(docs, block):
    got = exact_dedup(docs, block_bytes=block).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    assert len(got) == len(rows)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = groups[text]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        assert sum(r.kept for r in got if r.text_sha256 == digest) == 1, ids


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup(no_docs).count() == 0


def plain_fingerprint(text, words):
    import xxhash

    parts = (text or "").encode().lower().split()
    runs = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_the_plain_definition():
    texts = [None, "", " \t ", "one", "Two WORDS", "a b c d e f g", "É é x y z w " * 50]
    got = S.fingerprints([S.shingle_hashes(t or "", 4) for t in texts], 2)[:, 0]
    assert [int(x) for x in got] == [plain_fingerprint(t, 4) for t in texts]


def test_long_texts_are_summed_in_pieces(monkeypatch):
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z", "", "one two three four five six"]
    whole = S.fingerprints([S.shingle_hashes(t, 4) for t in texts])
    monkeypatch.setattr(S, "_CHUNK", 5)
    assert (S.fingerprints([S.shingle_hashes(t, 4) for t in texts]) == whole).all()


@pytest.mark.parametrize("bits,block", [(4, 4096), (4, 20), (4, 2), (7, 4096), (7, 10)])
def test_hamming_links_lose_nothing(spark, monkeypatch, bits, block):
    monkeypatch.setattr(S, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(S, "LEAF_MEMBERS", 30)
    r = random.Random(bits + block)
    base = [r.getrandbits(64) for _ in range(150)]
    near = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, bits + 3))) for b in base for _ in range(3)}
    near |= {base[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}  # a dense ball
    values = sorted(near)
    points = spark.createDataFrame([(k, int(np.uint64(v).astype(np.int64))) for k, v in enumerate(values)], "node long, fp0 long")
    got = {row.node: row.component for row in connected_components(S.hamming_links(points, bits, leaf_members=30)).collect()}
    label = list(range(len(values)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    assert all(got.get(k, k) == root(k) for k in range(len(values)))


def test_simhash_on_awkward_rows(docs, no_docs):
    rows = S.simhash_groups(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == "0" * 16 and by[2].component_id == 1
    assert by[0].component_id == by[3].component_id == by[7].component_id == 0
    assert S.simhash_groups(no_docs).count() == 0
    kept = S.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 4, 5, 6]


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in (100, 101, 102)} == {100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_the_least_hashes_are_kept(spark):
    from pyspark.sql import functions as F

    from shelfmark.llm.common import least_hashes

    rows = spark.range(20_000)
    for most in (1, 100, 5000, 30_000):
        want = [r.id for r in rows.orderBy(F.xxhash64("id")).limit(most).collect()]
        kept = least_hashes(rows, "id", most, 20_000)
        assert [r.id for r in kept.orderBy(F.xxhash64("id")).limit(most).collect()] == want
        assert kept.count() <= max(2 * most, most + 600)
