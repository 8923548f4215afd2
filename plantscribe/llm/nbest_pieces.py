"""N-best segmentation over a public piece vocabulary.

A text's lattice has an arc for each vocabulary piece that spells a stretch of it; characters in no piece are spelt in
byte pieces. Forward Viterbi gives the best score to every node; used as the heuristic of a backward A* search it is exact,
so paths leave the agenda best first and the first n are the n best.

The vocabulary file is a merge-ordered one; an arc scores the log probability of its piece's rank under Zipf's law, minus
UNKNOWN_COST for each byte piece. Ties: the longer last piece.

No piece crosses a blank, a line feed or the step from a letter to one of ``.,!;`` (checked when the file is loaded; a
vocabulary that does isn't cut there), so a text's lattice is a chain of small ones. Each distinct stretch is solved once per
worker, many at a time: best path, and the score of the second best through forward and backward scores. The n best of a whole
text differ from its best path in the n - 1 stretches that lose least at most; those are searched by A*.

Null and empty texts have no ids. Stretches beyond VECTOR_LENGTH characters are searched one by one. Decoding gives the text back,
but for U+2581, which comes back as a blank; ``round_trip`` says so, each stretch being decoded as it is solved. Rows that repeat a
doc_id are encoded each, an empty table gives none, other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLANK, N_BEST, CACHE_STRETCHES, VECTOR_LENGTH, BATCH = "▁", 4, 400_000, 48, 20_000
ZIPF_SHIFT, UNKNOWN_COST = 10.0, 20.0
PRIME = np.uint64(0x100000001B3)
SLOTS = 20
CUT = rf"(?:{BLANK}+|[^{BLANK}\n])(?:[^{BLANK}\n.,!;]|(?<![^\W\d_])[.,!;])*|\n"
PLAIN_CUT = rf"(?:{BLANK}+|[^{BLANK}\n])[^{BLANK}\n]*|\n"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceLattice:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        plain = [k for k in range(len(names)) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        total = math.log(sum(1 / (r + ZIPF_SHIFT) for r in range(len(plain))))
        self.ids = {names[k]: k for k in plain}
        self.score = {names[k]: -math.log(r + ZIPF_SHIFT) - total for r, k in enumerate(plain)}
        self.bytes = {int(names[k][3:5], 16): k for k in range(len(names)) if model.is_byte(k)}
        self.spelling = {k: names[k].replace(BLANK, " ").encode() for k in plain} | {k: bytes([b]) for b, k in self.bytes.items()}
        self.spelling[0] = self.spelling.get(0, b" ")
        self.spelt_bytes = np.zeros(len(names), np.int64)
        self.spelt_bytes[list(self.spelling)] = [len(x) for x in self.spelling.values()]
        self.longest = max(map(len, self.ids))
        inner = [p[k : k + 2] for p in self.ids for k in range(len(p) - 1)]
        if any(b == BLANK != a or "\n" in (a, b) for a, b in inner):
            raise ValueError("pieces cross blanks or line feeds")
        self.cut = re.compile(PLAIN_CUT if any(re.match(r"[^\W\d_][.,!;]", x) for x in inner) else CUT).findall
        self.byte_cost = -min(self.score.values()) + UNKNOWN_COST
        self._hash_pieces()
        self.packed, self.number = [], {}
        self.best, self.loss, self.spelt = np.empty(0), np.empty(0), np.empty(0, bool)

    # --- the beginnings of the pieces as a hash table, to walk many stretches at once

    def _hash_pieces(self) -> None:
        keys: dict[int, str] = {}
        for p in self.ids:
            h = 0
            for k, c in enumerate(p):
                h = (h * int(PRIME) + ord(c) + 1) % (1 << 64)
                if keys.setdefault(h, p[: k + 1]) != p[: k + 1]:
                    raise ValueError("two beginnings share a hash")
        self.slot_key, self.slot_score, self.slot_id = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS), np.full(1 << SLOTS, -1, np.int32)
        for h, p in keys.items():
            at = (h * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - SLOTS)
            while self.slot_key[at]:
                at = (at + 1) % (1 << SLOTS)
            self.slot_key[at], self.slot_score[at], self.slot_id[at] = h, self.score.get(p, 0), self.ids.get(p, -1)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where no piece begins so."""
        at = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        here = self.slot_key[at]
        out = np.where(here == h, at, -1)
        todo = np.flatnonzero((here != h) & (here != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % (1 << SLOTS)
            here = self.slot_key[at[todo]]
            same = here == h[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same & (here != 0)]
        return out

    # --- one stretch

    def arcs(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each node the arcs that end there: start, score, ids; longest first."""
        out: list[list[tuple[int, float, tuple[int, ...]]]] = [[]]
        for e in range(1, len(text) + 1):
            own = [(s, self.score[p], (self.ids[p],)) for s in range(max(0, e - self.longest), e) if (p := text[s:e]) in self.ids]
            if text[e - 1] not in self.ids:
                spelt = tuple(self.bytes[b] for b in text[e - 1].encode("utf-8", "replace"))
                own.append((e - 1, -self.byte_cost * len(spelt), spelt))
            out.append(own)
        return out

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations: forward Viterbi, then A* from the end."""
        ending = self.arcs(text)
        forward = [0.0]
        for own in ending[1:]:
            forward.append(max(forward[s] + score for s, score, _ in own))
        agenda: list[tuple[float, int, int, float, tuple | None]] = [(-forward[-1], len(text), 0, 0.0, None)]  # of equal scores the one furthest on
        found, pushed = [], 0
        while agenda and len(found) < n:
            _, node, _, gone, path = heapq.heappop(agenda)
            if node == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((gone, tuple(ids)))
                continue
            for s, score, piece in ending[node]:
                pushed += 1
                heapq.heappush(agenda, (-round(forward[s] + score + gone, 7), s, pushed, score + gone, (piece, path)))
        return found

    # --- many stretches

    def _forget(self, keep: set[str] = frozenset()) -> None:
        """Drop all solutions but those of ``keep``."""
        old = [(x, self.number[x]) for x in keep if x in self.number]
        at = np.array([k for _, k in old], np.int64)
        self.packed: list[bytes] = [self.packed[k] for _, k in old]
        self.number: dict[str, int] = {x: k for k, (x, _) in enumerate(old)}
        self.best, self.loss, self.spelt = (x[at] for x in (self.best, self.loss, self.spelt))

    def learn(self, stretches: list[str]) -> None:
        """Best path of each, its score, what the second best loses, and whether it spells the stretch."""
        short = [x for x in stretches if len(x) <= VECTOR_LENGTH]
        parts = [self._solve(short[k : k + BATCH]) for k in range(0, len(short), BATCH)]
        long = [x for x in stretches if len(x) > VECTOR_LENGTH]
        if long:
            packed, best, second = zip(*map(self._solve_one, long), strict=True)
            parts.append((packed, np.array(best), np.array(second)))
        for own, (packed, best, second) in zip([short[k : k + BATCH] for k in range(0, len(short), BATCH)] + [long] * bool(long), parts, strict=True):
            self.number.update(zip(own, range(len(self.packed), len(self.packed) + len(own)), strict=True))
            self.packed.extend(packed)
            self.best, self.loss, self.spelt = np.append(self.best, best), np.append(self.loss, best - second), np.append(self.spelt, self._spells(own, packed))

    def _spells(self, own: list[str], packed: list[bytes]) -> np.ndarray:
        """Whether the ids of each stretch spell it; decoded all at once, one by one only if that differs."""
        want = [x.encode("utf-8", "replace") for x in "\0".join(own).replace(BLANK, " ").split("\0")]
        got = [b"".join(map(self.spelling.__getitem__, memoryview(b"".join(packed)).cast("I")))]
        if len(want) == len(own) and got[0] == b"".join(want):
            lengths = np.array([0, *(len(x) for x in packed)]).cumsum() // 4
            spelt = np.append(0, self.spelt_bytes[np.frombuffer(b"".join(packed), "<u4")].cumsum())[lengths]
            if (np.diff(spelt) == [len(x) for x in want]).all():
                return np.ones(len(own), bool)
        return np.array([self.decode(b"\0\0\0\0" + ids) == x.replace(BLANK, " ") for x, ids in zip(own, packed, strict=True)])

    def _solve_one(self, text: str) -> tuple[bytes, float, float]:
        two = self.n_best(text, 2)
        return np.array(two[0][1], "<u4").tobytes(), two[0][0], two[1][0] if len(two) > 1 else -math.inf

    def _arcs_of(self, own: list[str]) -> tuple[np.ndarray, ...]:
        """Start, length, score and piece of every arc, places counted over all stretches; the longer first."""
        length = np.fromiter(map(len, own), np.int64, len(own))
        chars = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        left = np.repeat(np.cumsum(length), length) - np.arange(len(chars))  # characters to the end of the stretch
        alive, h, found = np.arange(len(chars)), np.zeros(len(chars), np.uint64), []
        for n in range(1, self.longest + 1):
            h = h * PRIME + chars[alive + (n - 1)]
            slot = self._find(h)
            piece = np.where(slot >= 0, self.slot_id[slot], -1)
            whole = piece >= 0
            found.append((alive[whole], np.full(int(whole.sum()), n), self.slot_score[slot[whole]], piece[whole]))
            if n == 1:
                bare = alive[~whole]  # spelt in bytes
                code = chars[bare] - np.uint64(1)
                n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                n_bytes[(code >= 0xD800) & (code < 0xE000)] = 1  # a lone surrogate becomes a question mark
                found.append((bare, np.ones(len(bare), np.int64), -self.byte_cost * n_bytes, np.full(len(bare), -1)))
            go = (slot >= 0) & (left[alive] > n)
            alive, h = alive[go], h[go]
            if not len(alive):
                break
        return tuple(np.concatenate(x) for x in zip(*found[::-1], strict=True))

    def _solve(self, own: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        m, length = len(own), np.fromiter(map(len, own), np.int64, len(own))
        first = np.cumsum(length) - length
        row = np.repeat(np.arange(m), length)
        start, n, score, piece = self._arcs_of(own)
        place = start - first[row[start]]  # in its stretch
        a, b = start + row[start], start + row[start] + n  # nodes; a stretch has one more than characters
        ends, longest = np.cumsum(length) + np.arange(m), int(length.max())

        forward, via = np.full(int(length.sum()) + m, -np.inf), np.full(int(length.sum()) + m, -1)
        forward[first + np.arange(m)] = 0
        by_end = np.argsort((place + n).astype(np.int16), kind="stable")
        cuts = np.searchsorted((place + n)[by_end], np.arange(1, longest + 2))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            arc = by_end[x:y]
            total = forward[a[arc]] + score[arc]
            np.maximum.at(forward, b[arc], total)
            arc = arc[total == forward[b[arc]]][::-1]
            via[b[arc]] = arc  # written last, so kept: the longest
        backward = np.full(len(forward), -np.inf)
        backward[ends] = 0
        by_start = np.argsort((-place).astype(np.int16), kind="stable")
        cuts = np.searchsorted(-place[by_start], np.arange(-longest + 1, 2))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            arc = by_start[x:y]
            np.maximum.at(backward, a[arc], backward[b[arc]] + score[arc])

        on, node, passed = np.zeros(len(start), bool), ends, np.zeros(len(forward), bool)
        while len(node):
            arc = via[node]
            on[arc] = passed[node] = True
            node = a[arc[place[arc] > 0]]
        through = np.where(on, -np.inf, forward[a] + score + backward[b])
        second = np.full(m, -np.inf)
        np.maximum.at(second, row[start], through)
        path = via[passed]
        ids, bounds = piece[path], np.concatenate(([0], np.cumsum(np.bincount(row[start[path]], minlength=m)))).tolist()
        raw = ids.astype("<i4").tobytes()
        packed = [raw[4 * x : 4 * y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in np.unique(row[start[path[ids < 0]]]).tolist():
            x, y = bounds[k : k + 2]
            spelt = [[i] if i >= 0 else [self.bytes[c] for c in own[k][p].encode("utf-8", "replace")] for i, p in zip(ids[x:y].tolist(), place[path[x:y]].tolist(), strict=True)]
            packed[k] = np.array([i for own_ids in spelt for i in own_ids], "<u4").tobytes()
        return packed, forward[ends], second

    # --- texts

    def encode(self, texts: list[str | None], n: int = N_BEST) -> Iterator[tuple[bytes, list[tuple[float, bytes]], bool]]:
        """Of each text its best ids (little-endian unsigned 32-bit), the n best ``(score, ids)``, and whether the ids spell it."""
        for k in range(0, len(texts), 256):
            cuts = [self.cut(BLANK + x.replace(" ", BLANK)) if x else [] for x in texts[k : k + 256]]
            distinct = set().union(*cuts)
            if len(self.number) > CACHE_STRETCHES:
                self._forget(distinct)
            if new := distinct.difference(self.number):
                self.learn(list(new))
            for own in cuts:
                yield self._whole(own, n)

    def _whole(self, own: list[str], n: int) -> tuple[bytes, list[tuple[float, bytes]], bool]:
        at = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))
        parts = list(map(self.packed.__getitem__, at.tolist()))
        ids, best, loss = b"".join(parts), float(self.best[at].sum()), self.loss[at]
        least = np.lexsort((np.arange(len(own)), loss))[: n - 1] if len(own) <= 4 * n else np.argpartition(loss, n - 2)[: n - 1]
        combos: list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]] = [(0.0, ())]
        for k in sorted(least[np.isfinite(loss[least])].tolist()):
            choices = self._alternatives(own[k], n)
            combos = heapq.nlargest(n, ((s + c - choices[0][0], (*change, *([(k, alt)] if j else []))) for s, change in combos for j, (c, alt) in enumerate(choices)), key=lambda x: x[0])
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) if len(combos) > 1 else None
        out = []
        for s, change in combos:
            changed = ids
            for k, alt in reversed(change):
                changed = b"".join((changed[: int(ends[k]) - len(parts[k])], np.array(alt, "<u4").tobytes(), changed[int(ends[k]) :]))
            out.append((best + s, changed))
        return ids, out, bool(self.spelt[at].all())

    @lru_cache(maxsize=20_000)  # noqa: B019  one lattice per worker
    def _alternatives(self, stretch: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        return self.n_best(stretch, n)

    def decode(self, ids: bytes) -> str:
        """The text that the ids spell, without the leading blank of the encoding."""
        raw = b"".join(map(self.spelling.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def lattice(path: str) -> PieceLattice:
    return PieceLattice(path)


OUT = "doc_id long, n_ids long, best_score double, nbest_scores array<double>, nbest_crc32 array<long>, ids_crc32 long, round_trip boolean"


def _encode(vocabulary: str, n: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(1).to_pylist()
                rows = [(len(ids) // 4, nbest[0][0], [s for s, _ in nbest], [zlib.crc32(x) for _, x in nbest], zlib.crc32(ids), spelt, ids) for ids, nbest, spelt in own.encode(texts, n)]
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.int64(), pa.bool_())
                arrays = [pa.array(x, t) for x, t in zip(cols, kinds, strict=False)]
                names = ["doc_id", "n_ids", "best_score", "nbest_scores", "nbest_crc32", "ids_crc32", "round_trip"]
                if keep_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<i4") for x in cols[6]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names)

    return run


def encode(docs: DataFrame, n: int = N_BEST, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, text)`` -> OUT, and ``ids array<int>`` on request; no shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(vocabulary or default_vocabulary(), n, keep_ids), OUT + (", ids array<int>" if keep_ids else ""))


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` -> ``(doc_id, text)``."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else own.decode(np.array(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
