"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters see chunks of eight bytes, four bytes apart, so chunks overlap and cover the whole text. A filter's
response is the sum of one learned weight for each byte value and place of a chunk. The greatest response of each
filter over all chunks goes through a rectifier into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import labelled_sample, lean, pick, slices
from shelfmark.session import read_table

STEP, WIDTH, FILTERS = 4, 8, 16
#: Rows of each label that fitting uses at most, the longest text among them, and the characters of a label's texts in all.
SAMPLE_PER_CLASS, SAMPLE_CHARS, SAMPLE_TOTAL = 2_500, 50_000, 12_000_000
THRESHOLD = 0.3
_WINDOW = 1 << 16


class ByteConvNet:
    """table: place x byte x filter; head: a weight for each filter, and a bias."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.head = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.bias = np.float32(0)

    @staticmethod
    def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts as rows of four bytes, each text followed by zeros up to one whole row, and where each begins.

        An empty text has a row of zeros of its own, so its one chunk is zeros whatever comes next.
        """
        rows = np.array([max(1, -(-len(t) // STEP)) + 1 for t in texts], np.int64)
        ends = np.cumsum(rows)
        raw = b"".join(t.ljust(int(n) * STEP, b"\0") for t, n in zip(texts, rows, strict=True))
        return np.frombuffer(raw, np.uint8).reshape(-1, STEP), ends - rows

    def pooled(self, words: np.ndarray, starts: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The greatest response of each filter for each text, and with ``where`` the row of its chunk."""
        n = len(starts)
        best = np.full((n, FILTERS), -np.inf, np.float32)
        at = np.zeros((n, FILTERS), np.int64) if where else None
        last = np.append(starts[1:], len(words)) - 1  # the row of zeros; a text has one more at least
        for a in range(0, len(words) - 1, _WINDOW):
            part = words[a : a + _WINDOW + 1]
            r = self.table[0][part[:-1, 0]]
            for k in range(1, STEP):
                r += self.table[k][part[:-1, k]]
            for k in range(STEP):
                r += self.table[STEP + k][part[1:, k]]
            b = a + len(r)
            first, end = np.searchsorted(last, a), np.searchsorted(starts, b)
            own = np.arange(first, end)
            cut = last[(last >= a) & (last < b)]
            r[cut - a] = -np.inf  # a chunk may not reach into the next text
            lo = np.maximum(starts[own], a) - a
            found = np.maximum.reduceat(r, lo, axis=0)
            if where:
                for k, doc in enumerate(own):
                    piece = r[lo[k] : (lo[k + 1] if k + 1 < len(own) else len(r))]
                    hit = piece.argmax(axis=0)
                    better = found[k] > best[doc]
                    at[doc, better] = (hit + lo[k] + a)[better]
            best[own] = np.maximum(best[own], found)
        return best, at

    def scores(self, texts: list[bytes]) -> np.ndarray:
        words, starts = self.lay_out(texts)
        best, _ = self.pooled(words, starts)
        return 1 / (1 + np.exp(-(np.maximum(best, 0) @ self.head + self.bias).astype(np.float64)))

    def fit(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 11) -> None:
        """Adam; the gradient of a filter goes to the chunk that gave its greatest response."""
        rng = np.random.default_rng(seed)
        params = [self.table, self.head]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        fb = sb = 0.0
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                words, starts = self.lay_out([texts[k] for k in own])
                best, at = self.pooled(words, starts, True)
                act = np.maximum(best, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.head + self.bias, -30, 30)))
                g = ((p - y[own]) * weight[own] / len(own)).astype(np.float32)
                grad_head = act.T @ g + 1e-4 * self.head
                back = g[:, None] * self.head * (best > 0)
                grad_table = 1e-5 * self.table
                f = np.broadcast_to(np.arange(FILTERS), at.shape)
                for k in range(WIDTH):
                    rows = at if k < STEP else np.minimum(at + 1, len(words) - 1)
                    np.add.at(grad_table[k], (words[rows, k % STEP], f), back)
                t += 1
                for j, (value, grad) in enumerate(zip(params, (grad_table, grad_head), strict=True)):
                    first[j] += 0.1 * (grad - first[j])
                    second[j] += 0.001 * (grad * grad - second[j])
                    value -= rate * (first[j] / (1 - 0.9**t)) / (np.sqrt(second[j] / (1 - 0.999**t)) + 1e-8)
                gb = float(g.sum())
                fb += 0.1 * (gb - fb)
                sb += 0.001 * (gb * gb - sb)
                self.bias = np.float32(self.bias - rate * (fb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_chars: int = SAMPLE_CHARS, where=None) -> ByteConvNet:
    """Fit on a bounded sample of labelled rows; classes are weighted by their share of all labelled rows.

    With labels of one kind only, or none, the network answers with the share of label 1 (0.5 without any).
    """
    sample, counts = labelled_sample(docs, labels, "quality", per_class, most_chars, SAMPLE_TOTAL, where)
    net = ByteConvNet()
    y = np.array([v for _, v in sample], np.float32)
    if len(set(y.tolist())) < 2:
        net.head[:] = 0
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        net.bias = np.float32(np.log(share / (1 - share)))
        return net
    total = sum(counts.values())
    share = np.array([counts[0] / total / np.mean(y == 0), counts[1] / total / np.mean(y == 1)], np.float32)
    net.fit([t.encode() for t, _ in sample], y, share[y.astype(int)])
    return net


def quality_scores(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score. Null and empty texts score as one chunk of zero bytes; ids are no input."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed 0.1 MB

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            score = shared.value.scores([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def _remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = fit_quality(docs, read_table(spark, sf_dir, "labels"), where=_remainder() != 0)
    held_out = F.coalesce(_remainder() == 0, F.lit(False))
    return quality_scores(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
