"""The Hamming join is exact for narrow and wide distances, at sizes where blocks would be crowded."""

import random

import numpy as np
import pytest

from shelfmark.operators import similar as S


def fingerprints(n, near, flips, seed):
    r = np.random.default_rng(seed)
    # 31 of 63 bits each, as fingerprints above a median have
    order = np.argsort(r.random((n, 63)), axis=1)[:, :31]
    bits = (np.uint64(1) << order.astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    pick = random.Random(seed)
    copies = []
    for k in range(near):
        x = int(bits[k])
        ones, zeros = [b for b in range(63) if x >> b & 1], [b for b in range(63) if not x >> b & 1]
        for a, b in zip(pick.sample(ones, flips // 2), pick.sample(zeros, flips // 2), strict=True):
            x ^= 1 << a | 1 << b
        copies.append(x)
    return bits.tolist() + copies


@pytest.mark.parametrize("distance, parts", [(4, 16_384), (6, 16_384), (16, 16_384), (16, 64)])
def test_pairs_equal_brute_force(spark, monkeypatch, distance, parts):
    monkeypatch.setattr(S, "PART_ROWS", parts)
    bits = fingerprints(300, 60, distance, 3) + [0, 0, 0]
    aspects = [(1.0, 1.3, 0.6, None, 0.0)[k % 5] for k in range(len(bits))]
    frame = spark.createDataFrame([(f"{k:05d}", b, x) for k, (b, x) in enumerate(zip(bits, aspects, strict=True))] + [("null", None, 1.0)], "content_hash string, bits long, aspect double")
    import math

    close = lambda x, y: not x or not y or abs(math.log(x / y)) <= 0.35
    want = sorted(
        (f"{i:05d}", f"{j:05d}", (bits[i] ^ bits[j]).bit_count())
        for i in range(len(bits))
        for j in range(i + 1, len(bits))
        if (bits[i] ^ bits[j]).bit_count() <= distance and close(aspects[i], aspects[j])
    )
    assert sorted(tuple(r) for r in S.hamming_pairs(frame, S.SimilarThresholds(distance)).collect()) == want and len(want) >= 30


@pytest.mark.parametrize("distance", [6, 16])
def test_a_hundred_thousand_fingerprints_lose_no_planted_pair(spark, distance):
    n, near = 100_000, 300
    bits = fingerprints(n, near, distance, 5)
    import pandas as pd

    frame = spark.createDataFrame(pd.DataFrame({"content_hash": [f"{k:08d}" for k in range(len(bits))], "bits": np.array(bits, np.int64)}))
    got = {(r.a, r.b) for r in S.hamming_pairs(frame, S.SimilarThresholds(distance)).collect()}
    assert {(f"{k:08d}", f"{n + k:08d}") for k in range(near)} <= got


@pytest.mark.parametrize("part_rows", [16_384, 40])
def test_spread_of_groups_of_any_size_is_exact(spark, monkeypatch, part_rows):
    monkeypatch.setattr(S, "PART_ROWS", part_rows)
    wide, narrow = fingerprints(200, 0, 0, 7), [(1 << k) | (1 << 62) for k in range(30)] + [1 << 62] * 70
    sets = {"wide": wide, "narrow": narrow, "copies": [5] * 90, "pair": [0, 7], "one": [9], "unknown": [None, 3]}
    rows = [(g, f"{g}{k:03d}", b) for g, bits in sets.items() for k, b in enumerate(bits)]
    frame = spark.createDataFrame(rows, "group_id string, content_hash string, bits long")
    got = {r.group_id: (r["size"], r.spread, r.kind) for r in S.group_spread(frame.drop("bits"), frame.drop("group_id"), 4).collect()}
    far = max((a ^ b).bit_count() for a in wide for b in wide)
    assert got == {"wide": (200, far, "scene"), "narrow": (100, 2, "copies"), "copies": (90, 0, "copies"), "pair": (2, 3, "copies"), "one": (1, None, "scene"), "unknown": (2, None, "scene")}
