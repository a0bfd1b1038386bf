"""SimHash near-duplicates: fingerprints, and exact Hamming links by forests of vantage-point trees.

With m = link_bits // 2 + 1 subspaces of the bits, two fingerprints within link_bits differ by one bit at most in some
subspace. Each subspace has a vantage-point tree, built on the driver from a bounded sample: a node holds a vantage
point and a radius, and a fingerprint goes inside or outside by its Hamming distance in the subspace. By the triangle
bound a ball of radius one crosses a node's border only at distance radius or radius + 1, so every other branch is
pruned. A fingerprint is a member of one leaf (shard) of each tree and visits those leaves that its ball overlaps;
members and visitors of a shard are compared with each other, bit-exactly, on all bits.

Where groups are asked for by similarity, the links are candidates only. Keys of least hashes of the runs of words add
those that the bits miss, and texts of one component of candidates are compared by the exact Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import lean, least_hashes, pick, row_key, slices
from shelfmark.llm.rolling import mixed
from shelfmark.operators.components import FEW_EDGES, connected_components
from shelfmark.session import checkpointed, read_table

SEED = 42
#: The trees are built from this many fingerprints at most (taken in hash order), whatever the table's size.
TREE_SAMPLE = 32_768
#: Members that a leaf is meant to have, and the most that one task compares with one block of visitors.
LEAF_MEMBERS, BLOCK_MEMBERS = 600, 4_096
_CHUNK = 1 << 18
#: Candidates by similarity: so many keys of so many least hashes each; of pairs with a similarity of 0.8 they miss 3 in 100 000.
KEYS, KEY_HASHES = 20, 4
#: Members, and characters of their texts, that one task compares exactly with as many visitors at once.
EXACT_MEMBERS, EXACT_CHARS = 4_096, 4_000_000


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash from the first (a finaliser of a multiplicative generator)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Unsigned XXH64 of each run of words; A-Z lower-cased; words are cut at ASCII white space."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[: len(parts) - words].tolist()]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprints(hashes: list[np.ndarray], lanes: int = 1) -> np.ndarray:
    """One row of ``lanes`` unsigned numbers for each text: a bit is set where over half of the hashes have it."""
    sums = np.zeros((len(hashes), 64 * lanes), np.int64)
    counts = np.array([len(h) for h in hashes])
    for lane in range(lanes):
        part = slice(64 * lane, 64 * (lane + 1))
        start = 0
        while start < len(hashes):
            end, held = start, 0
            while end < len(hashes) and (end == start or held + counts[end] <= _CHUNK):
                held += counts[end]
                end += 1
            if held > _CHUNK:
                pieces = [hashes[start][k : k + _CHUNK] for k in range(0, held, _CHUNK)]
                sums[start, part] = sum(_bits(p, lane).sum(0, dtype=np.int64) for p in pieces)
            elif held:
                full = np.flatnonzero(counts[start:end]) + start
                offsets = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                sums[full, part] = np.add.reduceat(_bits(np.concatenate([hashes[k] for k in full]), lane), offsets, axis=0, dtype=np.int32)
            start = end
    packed = np.packbits(sums * 2 > counts[:, None], axis=1, bitorder="little")
    return packed.view(np.uint64)


def _bits(h: np.ndarray, lane: int) -> np.ndarray:
    return np.unpackbits((_mix(h, lane) if lane else h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str, words: int, lanes: int, keys: bool = False) -> DataFrame:
    """doc_id, rk1, rk2 and the fingerprint's numbers fp0, fp1, ... (signed) of every row.

    With ``keys`` also set1 and set2, which stand for the set of runs of words, and keys (an empty set has none).
    """
    keyed = pick(docs, id_col, text_col).select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            hashes = [shingle_hashes(t or "", words) for t in batch.column(3).to_pylist()]
            found = fingerprints(hashes, lanes).view(np.int64)
            out = [*batch.columns[:3], *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(lanes))]
            if keys:
                sets = np.frombuffer(b"".join(xxhash.xxh3_128_digest(np.unique(h).tobytes()) for h in hashes), np.int64).reshape(-1, 2)
                full = [h for h in hashes if len(h)]
                ends = np.cumsum([0, *(KEYS * (len(h) > 0) for h in hashes)]).astype(np.int32)
                out += [*(pa.array(sets[:, k].copy()) for k in range(2)), pa.ListArray.from_arrays(pa.array(ends), pa.array(run_keys(full).ravel() if full else [], pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "rk1", "rk2", *(f"fp{k}" for k in range(lanes)), *(["set1", "set2", "keys"] if keys else [])]
    return keyed.mapInArrow(run, ", ".join(f"{n} {'array<long>' if n == 'keys' else 'long'}" for n in names))


class VantageTree:
    """A vantage-point tree over the bits of a mask; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, mask: int, leaves: int):
        self.mask = np.uint64(mask)
        self.nodes: list[tuple] = []  # (vantage, radius, inside, outside), or (leaf number,)
        self.leaves = 0
        self.least = max(2, len(sample) // max(1, leaves))
        self._grow(sample & self.mask)

    def _grow(self, points: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        best = None
        if len(points) > self.least:
            for vantage in points[:: max(1, len(points) // 4)][:4]:  # the vantage point whose split is evenest
                d = np.bitwise_count(points ^ vantage)
                for radius in np.unique(d)[:-1]:
                    off = abs(2 * int((d <= radius).sum()) - len(points))
                    if best is None or off < best[0]:
                        best = (off, vantage, radius, d <= radius)
        if best is None or best[0] > 0.9 * len(points):
            self.nodes[at] = (self.leaves,)
            self.leaves += 1
            return at
        _, vantage, radius, inside = best
        self.nodes[at] = (np.uint64(vantage), int(radius), self._grow(points[inside]), self._grow(points[~inside]))
        return at

    def route(self, points: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a ball of radius ``slack`` around a point overlaps."""
        rows, leaves = [], []
        todo = [(0, np.arange(len(points)))]
        masked = points & self.mask
        while todo:
            at, own = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                rows.append(own)
                leaves.append(np.full(len(own), node[0], np.int32))
                continue
            d = np.bitwise_count(masked[own] ^ node[0]).astype(np.int16)
            for child, chosen in ((node[2], d <= node[1] + slack), (node[3], d > node[1] - slack)):
                if chosen.any():
                    todo.append((child, own[chosen]))
        return np.concatenate(rows), np.concatenate(leaves)


def shards_of(tree: VantageTree, fps: np.ndarray, trees: int, t: int, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, is it a member) of every shard that a fingerprint belongs to or visits in tree number t.

    A shard is a leaf, numbered from 0. A leaf that is ``large`` has grown beyond the sample that made the tree; it is split
    further, down to the single values that its members have in the subspace (shards below 0): by the bound of one bit
    a fingerprint visits its own value and those a bit away.
    """
    home = np.zeros(len(fps), np.int64)
    row, leaf = tree.route(fps, 0)
    home[row] = leaf
    row, leaf = tree.route(fps, 1)
    shard = leaf.astype(np.int64) * trees + t
    member = home[row] == leaf
    whole = ~np.isin(shard, large)
    if whole.all():
        return row, shard, member
    near = np.unique(row[~whole])
    bits = np.array([0, *(1 << b for b in range(64) if int(tree.mask) >> b & 1)], np.uint64)
    value = ((fps[near] & tree.mask)[:, None] ^ bits).ravel()
    place, its_leaf = tree.route(value, 0)
    its_home = np.zeros(len(value), np.int64)
    its_home[place] = its_leaf
    fine = np.flatnonzero(np.isin(its_home * trees + t, large))
    below = -(mixed(value[fine], t) >> np.uint64(1)).astype(np.int64) - 1
    return np.concatenate([row[whole], near[fine // len(bits)]]), np.concatenate([shard[whole], below]), np.concatenate([member[whole], fine % len(bits) == 0])


def subspaces(link_bits: int) -> list[int]:
    """Masks of link_bits // 2 + 1 runs of bits, so that one of them has at most one of the differing bits."""
    m = link_bits // 2 + 1
    edges = [64 * k // m for k in range(m + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _forest(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least reachable row of each row."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            return label


def _compare(link_bits: int, confirm_bits: int, lanes: int, table: pa.Table) -> pa.Table:
    """Links in one block of one shard, as the edges of a forest over its rows: no more edges than rows."""
    rows = np.stack([table.column(f"fp{k}").to_numpy() for k in range(lanes)], axis=1).view(np.uint64)
    member = table.column("member").to_numpy(zero_copy_only=False).astype(bool)
    members = np.flatnonzero(member)
    every = np.arange(len(rows))
    label, lefts, rights, held = every, [], [], 0
    if len(members):
        step = max(1, _CHUNK // len(members))
        own = rows[members, 0]
        for start in range(0, len(rows), step):
            near = np.bitwise_count(rows[start : start + step, 0][:, None] ^ own[None, :]) <= link_bits
            a, b = np.nonzero(near)
            a, b = a + start, members[b]
            if lanes > 1:
                ok = np.bitwise_count(rows[a, 1:] ^ rows[b, 1:]).sum(axis=1, dtype=np.int64) <= confirm_bits
                a, b = a[ok], b[ok]
            ok = a != b
            lefts.append(a[ok])
            rights.append(b[ok])
            held += int(ok.sum())
            if held > _CHUNK:  # where all are near each other, the forest so far stands for their many links
                label, lefts, rights, held = _forest(len(rows), np.concatenate([*lefts, every]), np.concatenate([*rights, label])), [], [], 0
        label = _forest(len(rows), np.concatenate([*lefts, every]), np.concatenate([*rights, label]))
    linked = np.flatnonzero(label != np.arange(len(rows)))
    ids = table.column("node").to_numpy()
    return pa.table({"src": pa.array(ids[linked]), "dst": pa.array(ids[label[linked]])})


def hamming_links(points: DataFrame, link_bits: int, confirm_bits: int = 0, lanes: int = 1, leaf_members: int = LEAF_MEMBERS) -> DataFrame:
    """Edges (src, dst) that join, directly or through others, every two rows of ``points`` within link_bits.

    ``points``: node long, fp0 long (64 bits), and with more lanes fp1, ...: then a link also needs the other lanes
    to differ in confirm_bits at most. Rows are distinct fingerprints. Leaves larger than a block are split down to single
    values of the subspace, so a row has as many copies at most as the subspace has bits, whatever the table's size; and
    where very many fingerprints share a value, blocks of its members meet blocks of its visitors, so no task holds it whole.
    """
    spark = points.sparkSession
    count = points.count()
    some = least_hashes(points.select("fp0", F.xxhash64("fp0").alias("h")), "fp0", TREE_SAMPLE, count).limit(2 * TREE_SAMPLE)
    sample = np.array([r.fp0 for r in sorted(some.collect(), key=lambda r: (r.h, r.fp0))[:TREE_SAMPLE]], np.int64).view(np.uint64)
    trees = [VantageTree(sample, mask, max(1, min(count // leaf_members, len(sample) // 8))) for mask in subspaces(link_bits)]
    shared = spark.sparkContext.broadcast(trees)  # bounded by TREE_SAMPLE
    names = ["node", *(f"fp{k}" for k in range(lanes))]
    columns = ", ".join(f"{n} long" for n in names)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for t, tree in enumerate(shared.value):
                leaves, counts = np.unique(tree.route(fps, 0)[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(leaves.astype(np.int64) * len(shared.value) + t), "members": pa.array(counts.astype(np.int64))})

    # Sizes of leaves: as many rows as the trees have leaves, which the sample bounds.
    sizes = points.select("fp0").mapInArrow(homes, "shard long, members long").groupBy("shard").agg(F.sum("members").alias("n"))
    large = np.array(sorted(r.shard for r in sizes.where(F.col("n") > BLOCK_MEMBERS).collect()), np.int64)

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).to_numpy().view(np.uint64)
            for t, tree in enumerate(shared.value):
                row, shard, member = shards_of(tree, fps, len(shared.value), t, large)
                for a in range(0, len(row), 100_000):
                    part = pa.array(row[a : a + 100_000])
                    out = [batch.column(k).take(part) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(shard[a : a + 100_000]), pa.array(member[a : a + 100_000])], [*names, "shard", "member"])

    dealt = points.select(*names).mapInArrow(deal, f"{columns}, shard long, member boolean")
    block = F.lit(0)
    if len(large):
        members = dealt.where("member and shard < 0").groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("g"))
        over = checkpointed(members.where("g > 1"))
        if not over.isEmpty():
            # A member goes to its own block of members for all blocks of visitors, and as a visitor to one block for all.
            dealt = dealt.join(over.hint("merge"), "shard", "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
            parts = F.sequence(F.lit(0), F.col("g") - 1)
            as_member = F.transform(parts, lambda k: F.struct((F.col("i") * F.col("g") + k).alias("block"), F.lit(True).alias("member")))
            as_visitor = F.transform(parts, lambda k: F.struct((k * F.col("g") + F.col("i")).alias("block"), F.lit(False).alias("member")))
            told = F.when(F.col("member") & (F.col("g") > 1), F.concat(as_member, as_visitor)).when(F.col("member"), as_member).otherwise(as_visitor)
            dealt = dealt.select(*names, "shard", F.explode(told).alias("b")).select(*names, "shard", "b.member", "b.block")
            block = F.col("block")
    return dealt.withColumn("block", block).groupBy("shard", "block").applyInArrow(lambda part: _compare(link_bits, confirm_bits, lanes, part), "src long, dst long")


def run_keys(hashes: list[np.ndarray]) -> np.ndarray:
    """One row of KEYS signed numbers for each set of hashes (none of them empty): each joins KEY_HASHES least hashes."""
    rng = np.random.default_rng(SEED)
    offsets = np.cumsum([0, *map(len, hashes)])[:-1]
    flat = np.concatenate(hashes)
    out = np.zeros((len(hashes), KEYS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(KEYS):
            for _ in range(KEY_HASHES):
                flip, odd = rng.integers(0, 2**64, 2, np.uint64)
                out[:, k] = _mix(out[:, k] ^ np.minimum.reduceat((flat ^ flip) * (odd | np.uint64(1)), offsets), k + 1)
    return out.view(np.int64)


def _similar(sets: list[np.ndarray], members: np.ndarray, visitors: np.ndarray, least: float) -> np.ndarray:
    """The least reachable row of each row, over pairs of a member and a visitor whose sets (sorted, distinct) have a
    Jaccard similarity of ``least`` or more. Rows that are joined already are not compared again, so a group of near
    copies costs little more than its first member's comparisons."""
    size = np.array([len(x) for x in sets])
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    mark = np.zeros(len(names) and int(names.max()) + 1, bool)
    label = np.arange(len(sets))
    for m in members.tolist():
        # Sets of too different sizes can't be similar enough.
        other = visitors[(label[visitors] != label[m]) & (size[visitors] >= least * size[m] - 1e-9) & (size[visitors] * least <= size[m] + 1e-9)]
        if not len(other):
            continue
        own = names[ends[m] - size[m] : ends[m]]
        n = size[other]
        starts = np.cumsum(n) - n
        flat = names[np.repeat(ends[other] - n - starts, n) + np.arange(int(n.sum()))]
        mark[own] = True
        common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own] = False
        # The tolerance only keeps a quotient of exactly ``least`` from being lost to rounding.
        near = other[common >= least * (size[m] + n - common) - 1e-9]
        if len(near):
            joined = np.isin(label, np.append(label[near], label[m]))
            label[joined] = label[joined].min()
    return label


def _exact(words: int, least: float, table: pa.Table) -> pa.Table:
    """Links of one block of members and visitors by exact similarity, as the edges of a forest over its rows."""
    member = table.column("member").to_numpy(zero_copy_only=False).astype(bool)
    sets = [np.unique(shingle_hashes(t or "", words)) for t in table.column("text").to_pylist()]
    full = np.array([len(x) > 0 for x in sets])
    members, every = np.flatnonzero(member & full), np.flatnonzero(full)
    label = _similar(sets, members, every, least) if len(members) else np.arange(len(sets))
    linked = np.flatnonzero(label != np.arange(len(sets)))
    ids = table.column("node").to_numpy()
    return pa.table({"src": pa.array(ids[linked]), "dst": pa.array(ids[label[linked]])})


def key_links(points: DataFrame) -> DataFrame:
    """Edges (src, dst) from the first node of each key to the others that have it; ``points``: node long, keys array."""
    keys = checkpointed(points.select("node", F.explode("keys").alias("key")))
    firsts = checkpointed(keys.groupBy("key").agg(F.min("node").alias("src"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return keys.join(firsts.hint("merge"), "key").where("node <> src").select("src", F.col("node").alias("dst")).distinct()


def similar_links(texts: DataFrame, words: int, least: float) -> DataFrame:
    """Edges (src, dst) that join, directly or through others, every two nodes of a component whose runs of words have
    a Jaccard similarity of ``least`` or more; ``texts``: node long, component long, text.

    Components larger than a block are dealt out as blocks of members against blocks of visitors.
    """
    parts = F.greatest(F.ceil(F.count("*") / EXACT_MEMBERS), F.ceil(F.sum(F.length("text")) / EXACT_CHARS), F.lit(1))
    sizes = texts.groupBy("component").agg(F.least(parts, F.count("*")).cast("int").alias("g"))
    dealt = texts.join(sizes.hint("merge"), "component").withColumn("i", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    # Block (i, j) holds the members of part i and the visitors of part j; a pair needs it on one side of the diagonal only.
    parts = F.sequence(F.lit(0), F.col("g") - 1)
    as_member = F.transform(F.filter(parts, lambda j: j >= F.col("i")), lambda j: F.struct((F.col("i") * F.col("g") + j).alias("block"), F.lit(True).alias("member")))
    as_visitor = F.transform(F.filter(parts, lambda j: j < F.col("i")), lambda j: F.struct((j * F.col("g") + F.col("i")).alias("block"), F.lit(False).alias("member")))
    blocks = dealt.select("node", "text", "component", F.explode(F.concat(as_member, as_visitor)).alias("b")).select("node", "text", "component", "b.*")
    return blocks.groupBy("component", "block").applyInArrow(lambda part: _exact(words, least, part), "src long, dst long")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    link_bits: int = 4,
    lanes: int = 1,
    confirm_bits: int = 0,
    leaf_members: int = LEAF_MEMBERS,
    similarity: float | None = None,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, rk1, rk2, and keep1, keep2.

    keep1 and keep2 are the row key of the component's first row (by doc_id, null ids last).

    component_id is the smallest doc_id reachable over links (fingerprints that differ in link_bits at most), the
    row's own included; a row whose whole component has null ids gets null. A null or empty text has the fingerprint
    zero and is linked like any other. Rows that repeat are rows of the same component. An empty table gives an empty
    result. Equal fingerprints are one point, so copies cost no comparisons; no link between different ones is lost.

    With ``similarity``, a link is a pair of texts whose sets of runs of words have that Jaccard similarity or more; the
    links of bits and the pairs that share a key (see KEYS) are candidates for it, and equal words are one point.
    """
    fps = [f"fp{k}" for k in range(lanes)]
    point = fps if similarity is None else [*fps, "set1", "set2"]
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "rk1", "rk2")
    table = checkpointed(fingerprint_table(docs, id_col, text_col, words, lanes, similarity is not None))
    more = [] if similarity is None else [F.first("keys").alias("keys")]
    points = checkpointed(
        table.groupBy(*point).agg(F.min("doc_id").alias("least"), F.min(first).alias("first"), *more).sortWithinPartitions(*point).withColumn("node", F.monotonically_increasing_id())
    )
    edges = hamming_links(points, link_bits, confirm_bits, lanes, leaf_members)
    if similarity is not None:
        near = checkpointed(connected_components(checkpointed(edges.unionAll(key_links(points))), few=FEW_EDGES))
        chosen = points.join(near.hint("merge"), "node").select("node", "component", F.col("first.rk1").alias("rk1"), F.col("first.rk2").alias("rk2"))
        texts = pick(docs, id_col, text_col).select(*row_key(F.col("doc_id"), F.col("text")), "text").join(chosen.hint("merge"), ["rk1", "rk2"])
        edges = similar_links(texts, words, similarity)
    edges = checkpointed(edges)
    labels = connected_components(edges, few=FEW_EDGES).withColumnRenamed("component", "root")
    rooted = points.join(labels.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = checkpointed(rooted)
    least = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("keep")))
    named = rooted.join(least.hint("merge"), "root").select(*point, "component_id", F.col("keep.rk1").alias("keep1"), F.col("keep.rk2").alias("keep2"))
    # Copies of one text share a fingerprint and may be many: both sides come straight from an exchange, so Spark can
    # split a common fingerprint's rows over several tasks.
    named = checkpointed(named)
    return table.join(named.hint("merge"), point).select(
        "doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id", "rk1", "rk2", "keep1", "keep2"
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest doc_id; all columns stay, whatever they are called."""
    groups = simhash_groups(docs, id_col, text_col, **params)
    kept = groups.where("rk1 = keep1 and rk2 = keep2").select(F.struct("rk1", "rk2").alias("own")).distinct()
    rows = docs.select(F.struct(*row_key(F.col(id_col).cast("long"), F.col(text_col))).alias("own"), F.struct("*").alias("row"))
    return rows.join(kept, "own", "left_semi").dropDuplicates(["own"]).select("row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
