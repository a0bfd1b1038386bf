import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from shelfmark.llm import lines as L
from shelfmark.llm import packed
from shelfmark.llm.passages import repeated_spans, runs, without_spans
from shelfmark.llm.rolling import BASE


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        k = r.randrange(len(s) + 1)
        r.choice([lambda: s.insert(k, r.choice("abé😀")), lambda: s.pop(min(k, len(s) - 1)) if s else None, lambda: s.__setitem__(slice(k, k + 1), r.choice("abé😀"))])()
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3, 6])
def test_banded_distance(edits):
    r = random.Random(edits)
    pairs = []
    for _ in range(1500):
        a = "".join(r.choice("abc") for _ in range(r.randrange(0, 40)))
        pairs.append((a, edited(r, a, r.randrange(0, edits + 3))))
    want = [distance(a, b) <= edits for a, b in pairs]
    assert L.banded_within(pairs, edits).tolist() == L._banded(pairs, edits).tolist() == [L._banded_one(a, b, edits) for a, b in pairs] == want


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_segments_lose_no_pair(edits):
    r = random.Random(edits)
    for _ in range(600):
        a = "".join(r.choice("abc") for _ in range(r.randrange(edits + 1, 30)))
        b = edited(r, a, r.randrange(1, edits + 1))
        if a == b or len(b) <= edits:
            continue
        own, key, probe = L.segment_keys([a, b], edits)
        entries = {n: {int(k) for o, k, p in zip(own, key, probe, strict=True) if o == n and not p} for n in (0, 1)}
        probes = {n: {int(k) for o, k, p in zip(own, key, probe, strict=True) if o == n and p} for n in (0, 1)}
        assert entries[0] & probes[1] or entries[1] & probes[0] or entries[0] & entries[1], (a, b)
        x, y = L._parities([a, b]).tolist()
        assert (x ^ y).bit_count() <= 2 * edits


def some_lines(r, n):
    lines = []
    for _ in range(n):
        a = "".join(r.choice("ab") for _ in range(r.randrange(20, 45)))
        lines += [a, *(edited(r, a, r.randrange(0, 3)) for _ in range(3))]
    return [x for x in dict.fromkeys(lines) if len(x) >= 20]


def together(rows):
    of = defaultdict(set)
    for g, i, p in rows.tolist():
        of[g].add((i, p))
    return {tuple(sorted((x, y))) for own in of.values() for x, p in own for y, q in own if x != y and not (p and q)}


def test_meeting_brings_every_pair_of_a_key_together(monkeypatch):
    r = random.Random(6)
    lines = some_lines(r, 30)
    h = np.array([r.randrange(-(2**63), 2**63) for _ in lines])
    own, key, probe = L.segment_keys(lines, None)
    by_key, parity, ids = defaultdict(list), L._parities(lines).tolist(), L.short_id(h).tolist()
    for o, k, p in zip(own.tolist(), key.tolist(), probe.tolist(), strict=True):
        by_key[k].append((o, p))
    want = set()
    for met in by_key.values():
        for a, p in met:
            near = lambda b, a=a: b != a and (parity[a] ^ parity[b]).bit_count() <= 2 * int(L.allowed(np.array([len(lines[a])]), None)[0])
            want |= {tuple(sorted((ids[a], ids[b]))) for b, _ in met if not p and near(b)}
    packed = L.pack_entries(lines, h, None, 3)
    shares = [(s, np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, L.ENTRY)) for s, x in zip(packed.column(0).to_pylist(), packed.column(1), strict=True)]
    for pairs, block in ((L.PAIRS, 4096), (7, 4096), (1, 4096), (L.PAIRS, 2), (L.PAIRS, 5)):
        monkeypatch.setattr(L, "PAIRS", pairs)
        got = {x for s, e in shares for x in together(L.meeting(e, s, block))}
        assert want <= got  # an entry has a part of the key only, so others may meet besides
        halves = set()
        for s, e in shares:
            for part in (e[::2], e[1::2]):
                halves |= together(L.meeting(part, s, block))
            halves |= together(L.meeting(np.concatenate([e[::2], e[1::2]]), s, block, None, len(e[::2])))
        assert want <= halves


def test_earlier_near_equals_brute_force():
    r = random.Random(8)
    lines = some_lines(r, 12)
    group = np.array([r.randrange(4) for _ in lines])
    probe = np.array([r.random() < 0.3 for _ in lines])
    place = np.array(r.sample(range(1000), len(lines)))
    for edits in (None, 1, 2):
        most = L.allowed(np.array([len(x) for x in lines]), edits)
        want = [
            any(group[a] == group[b] and place[a] < place[b] and not (probe[a] and probe[b]) and distance(lines[a], lines[b]) <= min(most[a], most[b]) for a in range(len(lines)))
            for b in range(len(lines))
        ]
        assert L.earlier_near(group, probe, place, lines, edits).tolist() == want


def test_one_long_line_costs_its_own_length():
    pairs = [("x" * 30 + str(k), "x" * 30 + str(k + 1)) for k in range(100, 900)] + [("ab" * 500_000, "ab" * 500_000 + "c"), ("c" + "ab" * 60_000, "ab" * 60_000 + "c")]
    tracemalloc.start()
    near = L.banded_within(pairs, 3)
    assert near.all() and tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


@pytest.mark.parametrize("edits, chunk, block", [(1, L.CHUNK, L.BLOCK_LINES), (2, 40, L.BLOCK_LINES), (5, L.CHUNK, L.BLOCK_LINES), (2, L.CHUNK, 3)])
def test_repeated_lines_equal_brute_force(spark, monkeypatch, edits, chunk, block):
    monkeypatch.setattr(L, "CHUNK", chunk)
    monkeypatch.setattr(L, "BLOCK_LINES", block)
    r = random.Random(5)
    pool = ["".join(r.choice("abcdef ") for _ in range(r.randrange(15, 60))) for _ in range(25)]
    rows = [(i, "\n".join(edited(r, r.choice(pool), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randrange(0, 9)))) for i in range(60)]
    places = [(i, n, line) for i, t in rows for n, line in enumerate(t.split("\n")) if len(line) >= 20]
    first = {}
    for i, n, line in places:
        first.setdefault(line, (i, n))
    want = defaultdict(list)
    for i, n, line in places:
        if (i, n) != first[line] or any(first[o] < first[line] and o != line and abs(len(o) - len(line)) <= edits and distance(o, line) <= edits for o in first):
            want[i].append(n)
    got = {x.doc_id: x.removed for x in L.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), edits=edits).collect()}
    assert got == dict(want)


def test_lines_of_awkward_rows(docs, no_docs):
    kept = L.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    text = {r.doc_id: r.text for r in kept.collect()}
    assert text[0].startswith("A first line") and text[1] is None and text[2] == ""
    assert text[3] == "a FIRST line that is long enough to count.\nshort." and text[4] == "Another line, quite different from all the others." and text[7] == "Short."
    assert L.without_repeated_lines(no_docs).count() == 0


def mix(z, salt=0):
    z = (z + 0x9E3779B97F4A7C15 * (salt + 1)) % 2**64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
    return z ^ z >> 31


def plain_runs(text, words=37, window=4):
    """(the words of a run, start, end), by the definition."""
    places = [m.span() for m in re.finditer(r"\S+", text)]
    if not places:
        return []
    said = [text[a:b].lower() for a, b in places]
    gaps = [text[a[1] : b[0]] for a, b in zip(places, places[1:], strict=False)] + ["\n"]
    ends = [w[-1] in ".!?…" or "\n" in gap for w, gap in zip(said, gaps, strict=True)]
    rank = [(not end, mix((sum(mix(ord(c)) * BASE**k for k, c in enumerate(w)) + len(w)) % 2**64) >> 1) for w, end in zip(said, ends, strict=True)]
    cut = {k for k, end in enumerate(ends) if end}
    cut |= {min(range(a, a + window), key=lambda k: (rank[k], -k)) for a in range(len(said) - window + 1)}
    bounds = sorted({0} | {k + 1 for k in cut})
    out = []
    for a in bounds:
        if b := next((b for b in bounds if b >= a + words), None):
            out.append((tuple(said[a:b]), places[a][0], places[b - 1][1]))
    return out


def prose(r):
    word = lambda: "".join(r.choice("abcXYZéß梦") for _ in range(r.randrange(1, 5)))
    return "".join(word() + r.choice([" "] * 12 + [". ", "\n", "  ", "! ", ".\n\n", "… ", "\t"]) for _ in range(r.randrange(0, 120)))


def test_runs_equal_the_definition():
    r = random.Random(4)
    texts = [prose(r) for _ in range(300)] + ["", " ", "\n", "one", " one.\n", "w " * 400, "." * 50, "a. " * 30]
    r.shuffle(texts)
    own, h1, h2, start, end = runs(texts)
    got, by_hash = defaultdict(list), {}
    for k, x, y, a, b in zip(own.tolist(), h1.tolist(), h2.tolist(), start.tolist(), end.tolist(), strict=True):
        got[k].append((a, b))
        assert by_hash.setdefault((x, y), texts[k][a:b].lower().split()) == texts[k][a:b].lower().split()
    assert len({x for x, _ in by_hash}) == len({tuple(v) for v in by_hash.values()}) == len(by_hash)
    for k, t in enumerate(texts):
        assert got[k] == [(a, b) for _, a, b in plain_runs(t)], t


def test_repeated_spans_equal_brute_force(spark, monkeypatch):
    r = random.Random(9)
    said = [" ".join(r.choice("abcdefghij") * 3 for _ in range(r.randrange(3, 12))).capitalize() + "." for _ in range(40)]
    rows = [(i, " ".join(said[(s + k) % 40] for s in [r.randrange(40)] for k in range(r.randrange(0, 12)))) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = set(), defaultdict(set)
    for i, t in rows:
        for h, a, b in plain_runs(t):
            if h in seen:
                want[i] |= set(range(a, b))
            seen.add(h)
    # A filter that is full lets everything pass and loses nothing.
    for bits in (packed.FILTER_BITS, 2**15):
        monkeypatch.setattr(packed, "FILTER_BITS", bits)
        spans = repeated_spans(frame)
        got = defaultdict(set)
        for x in spans.collect():
            got[x.doc_id] |= set(range(x.start, x.end))
        assert got == want
    cut = {x.doc_id: x.text for x in without_spans(frame, spans).collect()}
    assert all(cut[i] == "".join(c for k, c in enumerate(t) if k not in want[i]) for i, t in rows)


def test_passages_of_awkward_rows(docs, no_docs):
    spans = repeated_spans(docs)
    assert {x.doc_id for x in spans.collect()} <= {3, 5, 7}
    out = without_spans(docs, spans)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert repeated_spans(no_docs).count() == 0
