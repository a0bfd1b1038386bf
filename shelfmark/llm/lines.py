"""Line dedup by a segment-partition edit join.

Lines within ``edits`` edits of each other are near copies; without a number, a line may have one edit in each 20 of
its characters, three at most (of two lines the shorter one counts). A line is split into edits + 1 segments, so a near
copy keeps one segment whole, at a place that lengths and the number of edits confine. Segments are indexed under
(length, segment number, hash); a line probes the index of its own and of the next shorter lengths with the substrings
that may be such a segment. Entries meet in a compact exchange, 16 bytes each: a part of the key, a part of the line's
hash, letter parities. Lines that meet, with parities close enough, become groups (a row for each line, not for each
pair), fetch their texts and are verified by a banded bit-parallel edit distance (the band is a word of bits for each
pair, and numpy works off many pairs at once). A line tries its partners from the earliest on and stops at the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import lean, pick, row_key, slices
from shelfmark.llm.packed import binary_rows, bit_filter, dealt, shares
from shelfmark.llm.rolling import Rolling, code_points, mixed
from shelfmark.session import checkpointed, read_table

LEAST_CHARS = 20
#: Edits that a line may have: one for so many of its characters, and so many at most.
CHARS_AN_EDIT, MOST_EDITS = 20, 3
#: Hashes of lines that a task remembers, so as to send a line's entries once.
SEEN = 250_000
#: Bytes of an entry: of the key, of the line's hash, the parities, and flags.
KEY, ID, PARITY = slice(0, 5), slice(5, 11), slice(11, 15)
ENTRY = 16
#: Entries of a share that are compared at once; larger shares are compared chunk against chunk, in tasks of their own.
CHUNK = 2_000_000
#: Lines of a group that are verified in one task, fewer where they have more than so many characters together.
BLOCK_LINES, BLOCK_CHARS = 4_096, 1 << 24
#: Pairs that are looked at together, and code points of lines that are compared side by side.
PAIRS, CELLS = 1_000_000, 4_000_000
#: Fewer pairs than these are compared one by one.
FEW = 16
_ONE = np.uint64(1)


def allowed(lengths: np.ndarray, edits: int | None) -> np.ndarray:
    """The edits that lines of these lengths may have."""
    return np.full(len(lengths), edits) if edits is not None else np.clip(lengths // CHARS_AN_EDIT, 1, MOST_EDITS)


def banded_within(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Which pairs are within ``edits`` (at most 31) insertions, deletions and substitutions.

    What two lines have in common at their ends is left aside. Pairs are worked off by length, as many at once as a bound
    of cells allows, so one long line costs its own length; a few are worked off one by one.
    """
    out = np.zeros(len(pairs), bool)
    pairs = [_apart(a, b) for a, b in pairs]
    order = sorted(range(len(pairs)), key=lambda k: max(map(len, pairs[k])))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * max(map(len, pairs[order[b]])) <= CELLS:
            b += 1
        own = np.array(order[a:b])
        if len(own) < FEW:
            out[own] = [_banded_one(*pairs[k], edits) for k in own]
        else:
            out[own] = _banded([pairs[k] for k in own], edits)
        a = b
    return out


def _shared(a: str, b: str) -> int:
    """The length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _apart(a: str, b: str) -> tuple[str, str]:
    n = _shared(a, b)
    a, b = a[n:], b[n:]
    n = _shared(a[::-1], b[::-1])
    return a[: len(a) - n], b[: len(b) - n]


def _banded_one(a: str, b: str, edits: int) -> bool:
    """The same band as below, for one pair, in Python's integers."""
    s, t = (a, b) if len(a) >= len(b) else (b, a)
    n, m = len(s), len(t)
    if n - m > edits:
        return False
    full, top = 2**64 - 1, 1 << 63
    bits = [(k, 1 << (63 - 2 * edits + k)) for k in range(2 * edits + 1)]
    s = "\0" * edits + s + "\0" * (2 * edits + 1)
    inside = range(edits, edits + n)
    vp, vn, score, low = full ^ ((1 << (63 - edits)) - 1), 0, edits, 1 << 62
    for i in range(m):
        c, match = t[i], 0
        for k, bit in bits:
            if s[i + k] == c and i + k in inside:
                match |= bit
        d0 = (((((match & vp) + vp) & full) ^ vp) | match | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if i < n - edits:
            score += not d0 & top
        else:
            score += bool(hp & low) - bool(hn & low)
            low >>= 1
        half = d0 >> 1
        vp, vn = (hn | ~(half | hp)) & full, half & hp
    return score <= edits


def _matrix(lines: list[str], before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in lines])
    full = np.zeros((before + int(lengths.max(initial=0)) + after, len(lines)), np.uint32)
    inside = np.arange(full.shape[0] - before - after)[None, :] < lengths[:, None]
    full.T[:, before : full.shape[0] - after][inside] = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32) + 1
    return full, lengths


def _banded(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    # The longer string runs down the band; bit 63 is the band's lowest row.
    longer = [max(p, key=len) for p in pairs]
    shorter = [min(p, key=len) if len(p[0]) != len(p[1]) else p[1] for p in pairs]
    longer = [p[0] if len(p[0]) == len(p[1]) else q for p, q in zip(pairs, longer, strict=True)]
    s, n = _matrix(longer, edits, 2 * edits + 1)
    t, m = _matrix(shorter, 0, 1)
    far = n - m > edits
    vp = np.full(len(pairs), (2**64 - 1) ^ ((1 << (63 - edits)) - 1), np.uint64)
    vn = np.zeros(len(pairs), np.uint64)
    score = np.full(len(pairs), edits, np.int64)
    low = np.full(len(pairs), np.uint64(1 << 62))
    shifts = [np.uint64(63 - 2 * edits + k) for k in range(2 * edits + 1)]
    with np.errstate(over="ignore"):
        for i in range(int(m.max(initial=0))):
            live = i < m
            match = np.zeros(len(pairs), np.uint64)
            for k, shift in enumerate(shifts):
                match |= (s[i + k] == t[i]).astype(np.uint64) << shift
            d0 = (((match & vp) + vp) ^ vp) | match | vn
            hp = vn | ~(d0 | vp)
            hn = d0 & vp
            diagonal = i < n - edits
            step = np.where(diagonal, ((d0 >> np.uint64(63)) == 0).astype(np.int64), ((hp & low) != 0).astype(np.int64) - ((hn & low) != 0).astype(np.int64))
            score += np.where(live, step, 0)
            low = np.where(live & ~diagonal, low >> _ONE, low)
            half = d0 >> _ONE
            vp, vn = np.where(live, hn | ~(half | hp), vp), np.where(live, half & hp, vn)
    return ~far & (score <= edits)


class _Prefix:
    """Hashes of substrings of many lines at once."""

    def __init__(self, lines: list[str]):
        codes = (code_points(lines).astype(np.uint64) + _ONE) * np.uint64(0xD6E8FEB86659FD93)
        self.rolling = Rolling(codes ^ (codes >> np.uint64(32)))
        self.lengths = np.array([len(x) for x in lines], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, own: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.rolling(self.starts[own] + start, size)


def _key(h: np.ndarray, length: np.ndarray, segment: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = h ^ (length.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(segment + 1) * np.uint64(0x94D049BB133111EB))
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(32))


def _segment(length: np.ndarray, segment: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of a segment: the later ones are one longer where the length does not divide evenly."""
    size, more = length // (edits + 1), length % (edits + 1)
    first_longer = edits + 1 - more
    return segment * size + np.maximum(0, segment - first_longer), size + (segment >= first_longer)


def segment_keys(lines: list[str], edits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line number, key, probe flag) of all index entries and probes; each line has more characters than edits.

    A line is indexed under the edits of its own length, and probes with those of each indexed length. A probe that is
    the line's own index entry is left out: lines that share an entry meet there.
    """
    prefix = _Prefix(lines)
    every, length = np.arange(len(lines)), prefix.lengths
    owners, keys, flags = [], [], []

    def add(own: np.ndarray, start: np.ndarray, size: np.ndarray, indexed: np.ndarray, segment: int, probe: bool) -> None:
        owners.append(own)
        keys.append(_key(prefix(own, start, size), indexed, segment))
        flags.append(np.full(len(own), probe))

    for e in [edits] if edits is not None else range(1, MOST_EDITS + 1):
        for i in range(e + 1):
            own = every[allowed(length, edits) == e]
            start, size = _segment(length[own], i, e)
            add(own, start, size, length[own], i, False)
            for delta in range(e + 1):
                indexed = length - delta
                start, size = _segment(indexed, i, e)
                # Of the i segments before, each had an edit if none of them matched; likewise behind.
                low, high = max(-i, delta - (e - i)), min(i, delta + (e - i))
                for shift in range(low, high + 1):
                    if delta == shift == 0:
                        continue
                    at = start + shift
                    ok = (indexed > e) & (allowed(indexed, edits) == e) & (at >= 0) & (at + size <= length)
                    add(every[ok], at[ok], size[ok], indexed[ok], i, True)
    return np.concatenate(owners), np.concatenate(keys).view(np.int64), np.concatenate(flags)


def _parities(lines: list[str]) -> np.ndarray:
    """31 bits: is the number of characters of a class odd? An edit changes two bits at most."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(x) for x in lines], np.int64)
    bits = (np.uint32(1) << (codes % np.uint32(31))).astype(np.uint32)
    return np.bitwise_xor.reduceat(bits, np.cumsum(lengths) - lengths).astype(np.int32)


def _occurrences(keyed: DataFrame, least: int, short: bool, passes=None) -> DataFrame:
    """A row per line of at least ``least`` characters, and with ``short`` per shorter one that is not blank: its hash and its place.

    With ``passes`` (a broadcast filter) only of lines whose first hash passes it.
    """

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            own, numbers, digests = [], [], []
            for k, text in enumerate(batch.column(3).to_pylist()):
                for number, line in enumerate((text or "").split("\n")):
                    if len(line) >= least or (short and line and not line.isspace()):
                        digests.append(xxhash.xxh3_128_digest(line))
                        own.append(k)
                        numbers.append(number)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = np.flatnonzero(passes.value.passes(h[:, 0])) if passes else np.arange(len(h))
            rows = pa.array(np.array(own, np.int32)[at])
            kept = [batch.column(k).take(rows) for k in range(3)]
            more = [pa.array(np.array(numbers, np.int32)[at]), pa.array(h[at, 0]), pa.array(h[at, 1])]
            yield pa.RecordBatch.from_arrays(kept + more, ["doc_id", "rk1", "rk2", "line_no", "h1", "h2"])

    return keyed.mapInArrow(emit, "doc_id long, rk1 long, rk2 long, line_no int, h1 long, h2 long").where("h1 is not null and h2 is not null")


def _lines(batches: Iterator[pa.RecordBatch], column: str, least: int, passes=None) -> Iterator[tuple[list[str], np.ndarray]]:
    """Lines that a task has not met before (as far as it remembers), with the two halves of their hashes."""
    seen: set[bytes] = set()
    for batch in slices(batches, column, 2_000_000):
        found: dict[bytes, str] = {}
        for text in batch.column(0).to_pylist():
            for line in (text or "").split("\n"):
                if len(line) >= least and (h := xxhash.xxh3_128_digest(line)) not in seen:
                    found[h] = line
                    seen.add(h)
        if len(seen) > SEEN:
            seen.clear()
        h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        lines = list(found.values())
        if passes:
            at = np.flatnonzero(passes.value.passes(short_id(h[:, 0])))
            h, lines = h[at], [lines[k] for k in at.tolist()]
        yield lines, h


def short_id(h: np.ndarray) -> np.ndarray:
    """The upper six bytes of a hash."""
    return (h.view(np.uint64) >> np.uint64(16)).astype(np.int64)


def _numbers(entries: np.ndarray, part: slice) -> np.ndarray:
    whole = np.zeros((len(entries), 8), np.uint8)
    whole[:, : part.stop - part.start] = entries[:, part]
    return whole.view(np.uint64).ravel()


def pack_entries(lines: list[str], h1: np.ndarray, edits: int | None, n: int) -> pa.RecordBatch:
    """The index entries and probes of lines, sorted by key and dealt to ``n`` shares."""
    own, key, probe = segment_keys(lines, edits)
    key = key.view(np.uint64)
    order = np.argsort(key)
    own, key, probe = own[order], key[order], probe[order]
    rows = np.zeros((len(own), ENTRY), np.uint8)
    rows[:, KEY] = key.view(np.uint8).reshape(-1, 8)[:, :5]
    rows[:, ID] = h1.view(np.uint8).reshape(-1, 8)[own, 2:]
    rows[:, PARITY] = _parities(lines).view(np.uint8).reshape(-1, 4)[own]
    length = np.array([len(x) for x in lines])
    rows[:, 15] = probe | (np.minimum(3, allowed(length, edits)) << 1)[own] | (np.minimum(31, np.log2(length).astype(int)) << 3)[own]
    found, ends = dealt(key, n)
    return pa.RecordBatch.from_arrays([pa.array(found), binary_rows(rows, ends)], ["share", "entries"])


def meeting(entries: np.ndarray, share: int, block: int, edits: int | None = None, boundary: int | None = None, salt: int = 0) -> np.ndarray:
    """Groups of lines that an index entry and other entries under its key, with close parities, bring together.

    One row per line of a group: group, short id, is it there as a probe. A row is written for each line, not for each
    pair; a group of more than ``block`` lines (fewer where lines are long) becomes groups of any two of its parts. With
    a ``boundary``, only an entry before it and one from it on meet.
    """
    key, flags = _numbers(entries, KEY), entries[:, 15]
    order = np.argsort(key << _ONE | (flags & 1), kind="stable")  # index entries of a key first
    key, flags = key[order], flags[order]
    side = order >= boundary if boundary is not None else None
    every = np.arange(len(key))
    last = np.searchsorted(key, key, "right")
    left = every[(flags & 1 == 0) & (last > every + 1)]
    none = np.empty((0, 3), np.int64)
    if not len(left):
        return none
    ids, parity = _numbers(entries, ID)[order].view(np.int64), _numbers(entries, PARITY)[order]
    bits = np.array([0, 2, 4, 6 if edits is None or edits <= 3 else 31])  # three in an entry stands for three or more
    hit = np.zeros(len(key), bool)
    size = last[left] - left - 1
    ends = np.cumsum(size)
    a = 0
    while a < len(left):
        # Of one entry with very many partners, a part at a time.
        base = ends[a] - size[a]
        b = max(a + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        for start in range(0, int(size[a]) if b == a + 1 else 1, PAIRS):
            if b == a + 1:
                j = np.arange(left[a] + 1 + start, min(left[a] + 1 + start + PAIRS, last[left[a]]))
                i = np.full(len(j), left[a])
            else:
                i = np.repeat(left[a:b], size[a:b])
                j = i + 1 + np.arange(len(i)) - np.repeat(ends[a:b] - size[a:b] - base, size[a:b])
            near = (np.bitwise_count(parity[i] ^ parity[j]) <= bits[flags[i] >> 1 & 3]) & (ids[i] != ids[j])
            if side is not None:
                near &= side[i] != side[j]
            hit[i[near]] = True
            hit[j[near]] = True
        a = b
    at = np.flatnonzero(hit)
    if not len(at):
        return none
    group = mixed(key[at] | np.uint64(share) << np.uint64(40), salt)
    found = np.unique(np.stack([group.view(np.int64), ids[at], flags[at].astype(np.int64)], axis=1), axis=0)
    first = np.flatnonzero(np.append(True, found[1:, 0] != found[:-1, 0]))
    size = np.diff(np.append(first, len(found)))
    most = np.maximum(2, np.minimum(block, BLOCK_CHARS >> (found[first, 2] >> 3)))
    out = [found[~np.repeat(size > most, size)]]
    for a, n, m in zip(first[size > most].tolist(), size[size > most].tolist(), most[size > most].tolist(), strict=True):
        # Rows of one line stay together, so each part holds a line with both its flags.
        own = found[a : a + n]
        part = (mixed(own[:, 1].view(np.uint64), 3) % np.uint64(-(-2 * n // m))).astype(np.int64)
        parts = range(int(part.max()) + 1)
        for x in parts:
            for y in parts[x + 1 :]:
                pair = own[(part == x) | (part == y)].copy()
                pair[:, 0] = mixed(pair[:, 0].view(np.uint64) + np.uint64(x * len(parts) + y), 4).view(np.int64)
                out.append(pair)
    rows = np.concatenate(out)
    rows[:, 2] &= 1
    return rows


def _groups(texts: DataFrame, text_col: str, edits: int | None, least: int) -> DataFrame:
    """Lines that may be near each other: group, id (short), probe."""
    n, most, block = shares(texts.sparkSession), CHUNK, BLOCK_LINES

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, h in _lines(batches, text_col, least):
            if lines:
                yield pack_entries(lines, np.ascontiguousarray(h[:, 0]), edits, n)

    def told(found: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)] + [pa.array(found[:, 2] > 0)]

    def rows(found: np.ndarray | None = None, share=None, chunk=None, entries=None) -> pa.RecordBatch:
        size = 1 if found is None else len(found)
        mine = told(found) if found is not None else [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.bool_())]
        sent = [pa.nulls(size, k) for k in (pa.int32(), pa.int32(), pa.binary())] if found is not None else [pa.array([share], pa.int32()), pa.array([chunk], pa.int32()), pa.array([entries.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(mine + sent, ["group", "id", "probe", "share", "chunk", "entries"])

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shares come one after the other: one that fits is compared here, of a larger one the chunks are sent on, too."""
        share, held, size, chunks = None, [], 0, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, chunks
            if not held:
                return
            entries = np.concatenate(held)
            held, size = [], 0
            yield rows(meeting(entries, share, block, edits))
            if chunks or not last:
                yield rows(share=share, chunk=chunks, entries=entries)
                chunks += 1

        for batch in batches:
            for own, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != share:
                    yield from flush(True)
                    share, chunks = own, 0
                part = np.frombuffer(packed.as_buffer(), np.uint8).reshape(-1, ENTRY)
                if held and size + len(part) > most:
                    yield from flush(False)
                held.append(part)
                size += len(part)
        yield from flush(True)

    @lean
    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share, chunk, other, left, right in zip(*batch.columns, strict=True):
                both = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, ENTRY) for x in (left, right)]
                found = meeting(np.concatenate(both), share.as_py(), block, edits, len(both[0]), (chunk.as_py() + 1) * 2**20 + other.as_py())
                yield pa.RecordBatch.from_arrays(told(found), ["group", "id", "probe"])

    packed = texts.select(text_col).mapInArrow(pack, "share int, entries binary")
    dealt_rows = packed.repartition("share").sortWithinPartitions("share")
    met = checkpointed(dealt_rows.mapInArrow(meet, "group long, id long, probe boolean, share int, chunk int, entries binary"))
    found = met.where("group is not null").select("group", "id", "probe")
    large = met.where("entries is not null").select("share", "chunk", "entries")
    if not large.isEmpty():
        other = large.select("share", F.col("chunk").alias("other"), F.col("entries").alias("others"))
        pairs = large.join(other.hint("merge"), "share").where("chunk < other")
        dealt_pairs = pairs.repartition(F.xxhash64("share", "chunk", "other")).select("share", "chunk", "other", "entries", "others")
        found = found.unionAll(dealt_pairs.mapInArrow(cross, "group long, id long, probe boolean"))
    return found


def earlier_near(group: np.ndarray, probe: np.ndarray, place: np.ndarray, lines: list[str], edits: int | None) -> np.ndarray:
    """Of rows of whole groups: which of them have a different line near, in their group, whose place is smaller.

    Each row tries its partners in the order of their places and stops at the first that is near.
    """
    order = np.lexsort([place, group])
    group, probe, place = group[order], probe[order], place[order]
    lines = [lines[k] for k in order.tolist()]
    length, parity = np.array([len(x) for x in lines], np.int64), _parities(lines).view(np.uint32)
    most = allowed(length, edits)
    first = np.searchsorted(group, group)
    found = np.zeros(len(group), bool)
    waiting, tried = np.arange(len(group)), first.copy()
    while len(waiting := waiting[tried[waiting] < waiting]):
        # For each row that waits, its next partner that may be near; a round passes over those that can't be.
        left = tried[waiting]
        bound = np.minimum(most[left], most[waiting])
        ok = ~(probe[left] & probe[waiting]) & (place[left] < place[waiting]) & (np.abs(length[left] - length[waiting]) <= bound)
        ok &= np.bitwise_count(parity[left] ^ parity[waiting]) <= 2 * bound
        a, b, bound = left[ok], waiting[ok], bound[ok]
        near = np.zeros(len(a), bool)
        for e in np.unique(bound):
            own = np.flatnonzero(bound == e)
            near[own] = banded_within([(lines[x], lines[y]) for x, y in zip(a[own].tolist(), b[own].tolist(), strict=True)], int(e))
        found[b[near]] = True
        tried[waiting] += 1
        waiting = waiting[~found[waiting]]
    out = np.zeros(len(order), bool)
    out[order] = found
    return out


def linked_lines(texts: DataFrame, firsts: DataFrame, text_col: str = "text", edits: int | None = None, least: int = LEAST_CHARS) -> DataFrame:
    """Lines that have a different line within ``edits`` edits (None: by their lengths) with an earlier first place: h1, h2.

    ``firsts``: h1, h2, and first, a struct that orders the lines' first places.
    """
    met = checkpointed(_groups(texts, text_col, edits, least).distinct())
    wanted = bit_filter(met, "id")

    @lean
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, h in _lines(batches, text_col, least, wanted):
            columns = [pa.array(short_id(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h1", "h2", "line"])

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a group come one after the other; several groups are compared together, none in parts."""
        held, size = [], 0

        def flush(whole: pa.Table) -> pa.RecordBatch:
            first = [whole.column(n).to_numpy(zero_copy_only=False) for n in ("line_no", "rk2", "rk1", "doc_id", "known")]
            rank = np.empty(whole.num_rows, np.int64)
            rank[np.lexsort(first)] = np.arange(whole.num_rows)
            probe = whole.column("probe").to_numpy(zero_copy_only=False).astype(bool)
            near = earlier_near(whole.column("group").to_numpy(), probe, rank, whole.column("line").to_pylist(), edits)
            out = whole.select(["h1", "h2"]).filter(pa.array(near)).combine_chunks()
            return pa.RecordBatch.from_arrays([out.column(k).combine_chunks() for k in range(2)], ["h1", "h2"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > 8 * CELLS // 4:
                whole = pa.Table.from_batches(held)
                group = whole.column("group").to_numpy()
                if (end := int(np.searchsorted(group, group[-1]))) > 0:  # the last group may go on
                    yield flush(whole.slice(0, end))
                    held = whole.slice(end).to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield flush(pa.Table.from_batches(held))

    told = texts.select(text_col).mapInArrow(fetch, "id long, h1 long, h2 long, line string").where("id is not null").dropDuplicates(["h1", "h2", "id", "line"])
    known = told.join(firsts.select("h1", "h2", "first").hint("merge"), ["h1", "h2"])
    known = known.select("id", "h1", "h2", "line", F.col("first.doc_id").isNotNull().alias("known"), F.coalesce("first.doc_id", F.lit(0)).alias("doc_id"), "first.rk1", "first.rk2", "first.line_no")
    rows = met.join(known.hint("merge"), "id").drop("id").repartition("group").sortWithinPartitions("group")
    return rows.mapInArrow(verify, "h1 long, h2 long").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int | None = None, least: int = LEAST_CHARS, short: bool = False) -> DataFrame:
    """One row per document that loses lines: doc_id, rk1, rk2, removed (line numbers from 0, ascending), n_links.

    A line of at least ``least`` characters goes where the same line, or one within ``edits`` edits of it, occurs
    earlier: in a row of a smaller doc_id (null ids first), or further up in the same row. n_links counts the removed
    lines that go for a different text. With ``short``, shorter lines that are not blank go where the same line occurs
    earlier. Rows that repeat both id and text are one document. Lines end at newlines.
    Null and empty texts have no lines to remove; an empty table gives an empty result.
    """
    keyed = pick(docs, id_col, text_col).select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    places = _occurrences(keyed, least, short)
    place = F.struct("doc_id", "rk1", "rk2", "line_no")
    firsts = places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    linked = linked_lines(keyed, firsts.where("n > 0"), "text", edits, least).withColumn("linked", F.lit(True))
    verdict = firsts.join(linked.hint("merge"), ["h1", "h2"], "left").where("n > 1 or linked")
    # Checkpointed, so that Spark can split the occurrences of a very common line over several tasks of the join.
    verdict = checkpointed(verdict.select("h1", "h2", "first", F.coalesce("linked", F.lit(False)).alias("linked")))
    places = _occurrences(keyed, least, short, bit_filter(verdict, "h1"))
    gone = places.join(verdict.hint("merge"), ["h1", "h2"]).where(F.col("linked") | (place != F.col("first")))
    lines = gone.groupBy("doc_id", "rk1", "rk2", "line_no").agg(F.max("linked").alias("linked"))
    return lines.groupBy("doc_id", "rk1", "rk2").agg(F.sort_array(F.collect_list("line_no")).alias("removed"), F.count_if("linked").alias("n_links"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int | None = None, least: int = LEAST_CHARS, short: bool = False) -> DataFrame:
    """``docs`` without the repeated lines; rows and other columns stay as they are, whatever they are called."""
    gone = repeated_lines(docs, id_col, text_col, edits, least, short).select(F.struct("rk1", "rk2").alias("own"), "removed")
    rows = docs.select(F.struct(*row_key(F.col(id_col).cast("long"), F.col(text_col))).alias("own"), F.struct("*").alias("row"))
    joined = rows.join(gone, "own", "left").select(*[F.col("row")[c].alias(f"c{k}") for k, c in enumerate(docs.columns)], "removed")
    names, place = docs.columns, docs.columns.index(text_col)

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place, 2_000_000):
            texts = batch.column(place).to_pylist()
            for k, removed in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if removed:
                    out = set(removed)
                    texts[k] = "\n".join([line for n, line in enumerate(texts[k].split("\n")) if n not in out])
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, T.StructType(docs.schema.fields))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_links, removed."""
    docs = read_table(spark, sf_dir, "documents")
    keyed = pick(docs, "doc_id", "text").select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    gone = repeated_lines(docs, short=True).drop("doc_id")
    joined = keyed.join(gone, ["rk1", "rk2"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"), removed.alias("removed"))
