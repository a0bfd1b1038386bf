"""SentencePiece encoding of merge-type vocabularies by a score-ordered agenda, and decoding.

A text is cut wherever no piece has the two characters side by side, so no merge can cross a cut. In a segment the
agenda holds every adjacent pair of symbols whose concatenation is a piece; the best score, then the leftmost place,
comes first, is merged, and its neighbours enter the agenda anew. The distinct short segments of a slice that a worker
does not remember are worked off side by side in numpy, one agenda entry of each segment at a time; long ones use a
heap. Every segment that a worker meets anew is checked with the library within its Arrow batch, inside the stretch
from space mark to space mark where it stands (no piece goes on after a space mark, so the library's ids of a text are
those of its stretches, too).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import lean, pick, slices
from shelfmark.session import read_table

SPACE = "▁"
SHORT = 48
#: Segments that a worker remembers, in compact arrays (some 60 bytes each); beyond that it begins anew.
MEMORY_SEGMENTS = 400_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 2_000_000
_NONE = 2**24
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ENCODERS: dict = {}


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + length], one after the other."""
    return flat[np.repeat(starts - _starts(lengths)[:-1], lengths) + np.arange(int(lengths.sum()))]


class _Memory:
    """Segments that were encoded before: sorted hashes, with the code points and the ids of each in flat arrays."""

    def __init__(self):
        self.hashes = np.empty(0, np.uint64)
        self.codes, self.ids = np.empty(0, np.uint32), np.empty(0, np.int32)
        self.code_at, self.code_n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.id_at, self.id_n = np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each segment, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add(self, hashes: np.ndarray, codes: np.ndarray, code_n: np.ndarray, ids: np.ndarray, id_n: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > MEMORY_SEGMENTS:
            self.__init__()
        code_at, id_at = _starts(code_n)[:-1] + len(self.codes), _starts(id_n)[:-1] + len(self.ids)
        self.codes, self.ids = np.concatenate([self.codes, codes]), np.concatenate([self.ids, ids])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.code_at, self.code_n = np.concatenate([self.code_at, code_at])[order], np.concatenate([self.code_n, code_n])[order]
        self.id_at, self.id_n = np.concatenate([self.id_at, id_at])[order], np.concatenate([self.id_n, id_n])[order]


class PieceEncoder:
    """Encodes as the library does: identity normalisation, a dummy space in front, byte fallback, no begin or end ids."""

    def __init__(self, model_file: str, verify: bool = True):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.verify = verify
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(a != SPACE and b == SPACE for i in plain for a, b in zip(pieces[i], pieces[i][1:], strict=False)):
            raise ValueError("a piece goes on after a space mark: segments would not be independent")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        ids = {pieces[i]: i for i in plain}
        # Characters that are no piece still take part in merges: they get symbols from n on.
        chars = sorted({c for p in ids for c in p} - ids.keys())
        self.extra = {c: n + k for k, c in enumerate(chars)}
        symbol = ids | self.extra
        self.text_of = {v: k for k, v in symbol.items()}
        best = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if (left := symbol.get(p[:k])) is not None and (right := symbol.get(p[k:])) is not None:
                    merges[left, right] = (best[sp.get_score(i)], i)
        self.merges = merges
        self.unknown = n + len(chars)
        self.char_symbol = np.full(0x110000, self.unknown, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char_symbol[ord(c)] = i
        self.width = np.int64(self.unknown + 1)
        # Where pieces share a score the rank alone does not say which piece is made: such merges are the heap's.
        shared = {r for r, k in Counter(best[sp.get_score(i)] for i in plain if len(pieces[i]) > 1).items() if k > 1}
        self.odd = {c for i in plain if best[sp.get_score(i)] in shared and len(pieces[i]) > 1 for c in pieces[i]}
        self.all_odd = re.compile("[" + re.escape("".join(sorted(self.odd))) + "]{2}") if self.odd else re.compile(r"(?!)")
        table = {a * int(self.width) + b: r for (a, b), (r, _) in merges.items() if r not in shared}
        self.keys = np.array([*sorted(table), 2**62], np.int64)
        self.rank = np.array([*(table[k] for k in self.keys[:-1].tolist()), _NONE], np.int32)
        self.made = np.zeros(len(best) + 1, np.int32)
        self.made[[r for r, _ in merges.values()]] = [i for _, i in merges.values()]
        self.n = n
        self.memory = _Memory()
        # Characters that stand side by side in some piece; any other two neighbours are a cut.
        joined = {pair for p in ids for pair in zip(p, p[1:], strict=False)}
        kinds = {c: k + 1 for k, c in enumerate(sorted({c for pair in joined for c in pair}))}
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in kinds]] = list(kinds.values())
        self.joins = np.zeros((len(kinds) + 1, len(kinds) + 1), bool)
        for left, right in joined:
            self.joins[kinds[left], kinds[right]] = True
        digits = [f"{i},".encode() for i in range(n)]
        self.digit_n = np.array([len(d) for d in digits], np.int64)
        self.digits = np.frombuffer(b"".join(d.ljust(int(self.digit_n.max()), b"\0") for d in digits), np.uint8).reshape(n, -1)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.width + right
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.rank[at], _NONE)

    def _together(self, segments: list[str]) -> list[list[int]]:
        """Ids of short segments of one length class: every round pops the first entry of each segment's agenda.

        A column is a segment. An agenda entry is rank * 64 + place, so the smallest is the best score, leftmost. The
        last row stands for "no neighbour".
        """
        rows, width = len(segments), max(map(len, segments))
        lengths = np.fromiter(map(len, segments), np.int64, rows)
        final = np.full((width, rows), -1, np.int32)
        codes = self.char_symbol[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        final.T[np.arange(width) < lengths[:, None]] = codes
        sym = np.vstack([final, np.full((1, rows), -1, np.int32)])
        place = np.arange(width + 1, dtype=np.int32)[:, None]
        nxt, prv = np.repeat(place + 1, rows, 1), np.repeat(place - 1, rows, 1)
        nxt[width], prv[0] = width, width
        agenda = np.full((width + 1, rows), _NONE * 64, np.int32)
        live = sym[1:] >= 0
        agenda[:-1][live] = self._look(sym[:-1][live], sym[1:][live])
        agenda[:-1][live] *= 64
        agenda += place
        own = np.arange(rows)
        while own.size:
            best = agenda.min(axis=0)
            going = best < _NONE * 64
            if going.sum() < 0.75 * own.size:
                final[:, own[~going]] = sym[:-1, ~going]
                own, best = own[going], best[going]
                sym, nxt, prv, agenda = (np.ascontiguousarray(x[:, going]) for x in (sym, nxt, prv, agenda))
                r = np.arange(own.size)
            else:
                r = np.flatnonzero(going)
                best = best[r]
            size = own.size
            at = best & 63
            here = at * size + r
            syms, nexts, prevs, entries = sym.ravel(), nxt.ravel(), prv.ravel(), agenda.ravel()
            right = nexts[here] * size + r
            after = nexts[right]
            then = after * size + r
            new = self.made[best >> 6]
            syms[here], syms[right], nexts[here], prevs[then] = new, -2, after, at
            entries[right] = _NONE * 64
            before = prevs[here]
            back = before * size + r
            syms[width * size :] = -1
            entries[here] = self._look(new, syms[then]) * 64 + at
            entries[back] = self._look(syms[back], new) * 64 + before
        out = np.ascontiguousarray(final.T)
        left = out >= 0
        flat, ends = out[left].tolist(), left.sum(axis=1).cumsum().tolist()
        found = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.flatnonzero((out >= self.n).any(axis=1)).tolist():
            found[k] = self._spelled(segments[k], found[k])
        return found

    def _spelled(self, segment: str, symbols: list[int]) -> list[int]:
        """Symbols that are no piece become the bytes of their characters."""
        out, at = [], 0
        for s in symbols:
            size = 1 if s >= self.n else len(self.text_of[s])
            out += [s] if s < self.n else [self.byte_ids[b] for b in segment[at].encode()]
            at += size
        return out

    def _heap(self, segment: str) -> list[int]:
        """A long segment: the agenda is a heap of (rank, place, symbols), stale entries are skipped."""
        sym = self.char_symbol[np.frombuffer(segment.encode("utf-32-le"), np.uint32)].tolist()
        size = len(sym)
        nxt, prv = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda = []

        def add(p: int) -> None:
            if p >= 0 and nxt[p] < size and (m := self.merges.get((sym[p], sym[nxt[p]]))):
                heapq.heappush(agenda, (m[0], p, sym[p], sym[nxt[p]], m[1]))

        for p in range(size):
            add(p)
        while agenda:
            _, p, a, b, whole = heapq.heappop(agenda)
            q = nxt[p] if sym[p] == a else size
            if q >= size or sym[q] != b:
                continue
            sym[p], sym[q], nxt[p] = whole, -2, nxt[q]
            if nxt[p] < size:
                prv[nxt[p]] = p
            add(p)
            add(prv[p])
        ids = [s for s in sym if s >= 0]
        return ids if max(ids) < self.n else self._spelled(segment, ids)

    def _learn(self, new: list[str]) -> list[list[int]]:
        """The ids of segments, none of them empty."""
        found: list[list[int]] = [[]] * len(new)
        rest = []
        for k, s in enumerate(new):
            if len(s) > SHORT or self.all_odd.search(s):
                found[k] = self._heap(s)
            else:
                rest.append(k)
        rest.sort(key=lambda k: len(new[k]))
        lengths = np.array([len(new[k]) for k in rest], np.int64)
        start = 0
        while start < len(rest):
            end = min(start + 20_000, int(np.searchsorted(lengths, lengths[start] + 2, "right")))
            for k, ids in zip(rest[start:end], self._together([new[k] for k in rest[start:end]]), strict=True):
                found[k] = ids
            start = end
        return found

    def _segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All code points with the dummy space in front of each text, starts and hashes of segments, and each text's first segment."""
        codes = np.frombuffer("".join([SPACE + t for t in texts]).encode("utf-32-le"), np.uint32).copy()
        codes[codes == 32] = ord(SPACE)
        begins = _starts(np.array([len(t) + 1 for t in texts], np.int64))[:-1]
        kind = self.kind[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.joins[kind[:-1], kind[1:]]
        cut[begins] = True
        starts = np.flatnonzero(cut)
        with np.errstate(over="ignore"):
            mixed = (codes.astype(np.uint64) + np.uint64(1)) * _ODD
            mixed ^= mixed >> np.uint64(29)
            place = (np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))).astype(np.uint64)
            mixed *= place * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
            hashes = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
        return codes, starts, hashes, np.searchsorted(starts, begins)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. An empty text has none."""
        full = [t for t in texts if t]
        if not full:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        codes, starts, hashes, firsts = self._segments(full)
        lengths = np.diff(np.append(starts, len(codes)))
        distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        known = self.memory.find(distinct)
        new = np.flatnonzero(known < 0)
        if len(new):
            own = one[new]
            flat = _spread(codes, starts[own], lengths[own])
            text, ends = flat.tobytes().decode("utf-32-le"), _starts(lengths[own]).tolist()
            found = self._learn([text[a:b] for a, b in zip(ends, ends[1:], strict=False)])
            id_n = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for f in found for i in f), np.int32, int(id_n.sum()))
            size = len(self.memory.hashes)
            self.memory.add(distinct[new], flat, lengths[own], ids, id_n)
            if len(self.memory.hashes) < size + len(new):  # it began anew: what this slice needs of the old is learnt again
                return self.encode_flat(texts) if len(distinct) <= MEMORY_SEGMENTS else self._halved(texts)
            known = self.memory.find(distinct)
            new = starts[own]
        m, seg = self.memory, known[which]
        # Equal hashes have to be equal segments.
        if (m.code_n[seg] != lengths).any() or (_spread(m.codes, m.code_at[seg], lengths) != codes).any():
            raise ValueError("two segments share a hash")
        per_segment = m.id_n[seg]
        counts = np.zeros(len(texts), np.int64)
        counts[[k for k, t in enumerate(texts) if t]] = np.add.reduceat(per_segment, firsts)
        flat = _spread(m.ids, m.id_at[seg], per_segment)
        if self.verify:
            self._check(codes, starts, firsts, per_segment, flat, new)
        return flat, counts

    def _check(self, codes: np.ndarray, starts: np.ndarray, firsts: np.ndarray, per_segment: np.ndarray, flat: np.ndarray, new: np.ndarray) -> None:
        """Compare with the library the stretches that hold the segments at the places ``new``."""
        if not len(new):
            return
        marked = codes == ord(SPACE)
        opens = marked & ~np.concatenate([[False], marked[:-1]])
        opens[starts[firsts]] = True
        begin = np.append(np.flatnonzero(opens), len(codes))
        own = np.unique(np.searchsorted(begin, new, "right") - 1)
        ends = _starts(per_segment)
        first_id, last_id = (ends[np.searchsorted(starts, begin[own + k])].tolist() for k in (0, 1))
        text, at = codes.tobytes(), (4 * begin).tolist()
        stretches = [text[at[k] : at[k + 1]].decode("utf-32-le") for k in own.tolist()]
        # The library puts the first mark itself; a stretch of that mark alone can only be asked for behind another.
        told = self.sp.encode([s[1:] if len(s) > 1 else SPACE + "x" + SPACE for s in stretches], num_threads=1)
        for s, a, b, ids in zip(stretches, first_id, last_id, told, strict=True):
            if flat[a:b].tolist() != (ids if len(s) > 1 else ids[-1:]):
                raise ValueError(f"the library encodes {s!r} otherwise")

    def _halved(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A slice with more segments than the memory holds: in halves, or a single text segment by segment."""
        if len(texts) > 1:
            parts = [self.encode_flat(texts[: len(texts) // 2]), self.encode_flat(texts[len(texts) // 2 :])]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        codes, starts, _, _ = self._segments(texts)
        text, ends = codes.tobytes().decode("utf-32-le"), [*starts.tolist(), len(codes)]
        found = self._learn([text[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        ids = np.array([i for f in found for i in f], np.int32)
        if self.verify:
            self._check(codes, starts, np.zeros(1, np.int64), np.array([len(f) for f in found]), ids, starts)
        return ids, np.array([len(ids)])

    def joined(self, ids: np.ndarray) -> bytes:
        """Decimal ids, joined by commas."""
        shown = self.digits[ids]
        return shown[np.arange(shown.shape[1]) < self.digit_n[ids][:, None]].tobytes()[:-1]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Of each text: its ids joined by commas, and the ids."""
        flat, counts = self.encode_flat(texts)
        ends = np.cumsum(counts)
        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            yield self.joined(flat[a:b]), flat[a:b]

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


def encoder(model_file: str, verify: bool) -> PieceEncoder:
    """One per Python worker."""
    key = (model_file, verify)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(model_file, verify)
    return _ENCODERS[key]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """The model's place on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_codes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, verify: bool = True, keep_ids: bool = False
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids.

    ``model`` is a path that every executor can read; the default is the installed public vocabulary. A null text
    counts as empty and has no ids. Repeated rows are encoded each; an empty table gives an empty result; a very long
    text is a slice of its own. ``verify`` compares each segment that a worker meets anew with the library and fails
    on a difference.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model or model_path(), verify)
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            named, back, all_ids = [], [], []
            for joined, ids in coder.encode_batch(texts):
                named.append(hashlib.sha256(joined).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                all_ids.append(ids)
            counts = np.array([len(ids) for ids in all_ids], np.int64)
            out = [batch.column(0), pa.array(counts), pa.array(named, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                flat = np.concatenate([np.empty(0, np.int32), *all_ids])
                out.append(pa.ListArray.from_arrays(pa.array(_starts(counts).astype(np.int32)), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    more = ", ids array<int>" if keep_ids else ""
    return pick(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return piece_codes(read_table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text")))
