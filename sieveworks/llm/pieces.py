"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

A batch's distinct words (a space marker and what follows it; no piece spans
two) are laid end to end, ``INDEX_CHARS`` at a time. The text's suffixes are sorted by their first
characters, as many as the longest piece has; a binary search of every piece
gives the range of suffixes it begins, that is all its occurrences. These are
the edges of the words' segmentation graphs. Sorted by end position they are
relaxed from left to right, all words in step.

Which edge may follow which is where BPE differs from a best-score path: an
encoding is the merge procedure's result exactly if each two neighbouring
pieces are its result for the two alone, and then so is every prefix. So each
position keeps the last piece of the one valid encoding of the prefix, and an
edge relaxes a position if its piece is compatible with the piece kept where
it starts. Compatibility of two pieces is decided by undoing their merges from
the last to the first and looking for a merge across the border that would
have come earlier.

Characters without a piece become byte pieces; runs of spaces are merged by
themselves, after everything else. A word too long for a step-wise pass is
indexed in stretches, each with as many characters more as a piece can reach,
and its edges are relaxed one by one: the same ids by the same rule.

A model is read from its file in each task. Words keep their ids from batch to
batch in a cache of bounded bytes, which lets go of those not met lately.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix64, row_slices

MARK, END = "▁", "\U0010ffff"
_NEVER = np.int64(1) << 40
LONG_WORD = 256  # longer words are relaxed edge by edge, not in step
INDEX_CHARS = 1 << 18
SLICE = 1 << 20
CACHE_BYTES = 64 << 20  # of each of two generations
SLOTS = 1 << 20


class WordCache:
    """Ids by word. When the younger half is full it becomes the older one, and what was not met since then goes."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.young, self.old, self.size, self.limit = {}, {}, 0, limit

    def missing(self, words: set[str]) -> list[str]:
        """The words without ids here; the others move to the younger half."""
        todo = words - self.young.keys()
        self._add({w: self.old[w] for w in todo & self.old.keys()})
        return list(todo - self.old.keys())

    def add(self, words: list[str], ids: list[tuple[int, ...]]) -> None:
        self._add(dict(zip(words, ids, strict=True)))

    def _add(self, new: dict) -> None:
        self.young.update(new)
        self.size += 200 * len(new) + 4 * sum(map(len, new)) + 8 * sum(map(len, new.values()))

    def age(self) -> None:
        """To be called between batches, so that a batch's own words are all in the younger half."""
        if self.size > self.limit:
            self.young, self.old, self.size = {}, self.young, 0


def merge_by_score(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """The merge procedure itself: the best-ranked neighbouring pair first, the leftmost among equals."""
    symbols = list(symbols)
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in rank), default=None)
        if best is None:
            return symbols
        i = best[1]
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]


class PieceModel:
    """A BPE model's pieces, their derivations and the pairs that merge."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {names[i]: i for i in plain}
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        scores = sorted({-sp.get_score(i) for i in plain if len(names[i]) > 1})
        rank_of = {s: r for r, s in enumerate(scores)}
        self.merge_rank = {names[i]: rank_of[-sp.get_score(i)] for i in plain if len(names[i]) > 1}
        self.out_bytes = [b""] * n
        for i in plain:
            self.out_bytes[i] = names[i].replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self.out_bytes[i] = bytes([b])
        # Pieces of single words, with the last merge that makes them.
        self.rank, self.left, self.right = np.full(n + 1, -1, np.int64), np.arange(n + 1), np.arange(n + 1)
        words = []
        for name, i in self.id_of.items():
            if MARK in name[1:]:
                continue
            if len(name) > 1:
                two = self._last_merge(name)
                if two is None:  # no merge order leads to it
                    continue
                self.rank[i], self.left[i], self.right[i] = self.merge_rank[name], self.id_of[two[0]], self.id_of[two[1]]
            words.append((name, i))
        made = {name for name, _ in words}
        pairs = [(self.id_of[w[:k]] * n + self.id_of[w[k:]], self.merge_rank[w]) for w in self.merge_rank
                 for k in range(1, len(w)) if w[:k] in made and w[k:] in made]
        pairs.sort()
        self.pair_key = np.array([p[0] for p in pairs], np.int64)
        self.pair_rank = np.array([p[1] for p in pairs], np.int64)
        self.n, self.unknown = n, n  # ``unknown``: the id of a character without a piece
        alphabet = sorted({c for w, _ in words for c in w})
        # Codes: 0 ends a word, 1 is any other character, 65535 is above all.
        self.code_of = np.ones(0x110000, np.uint16)
        self.code_of[0] = 1
        self.code_of[[ord(c) for c in alphabet]] = np.arange(2, 2 + len(alphabet))
        self.width = max(len(w) for w, _ in words)
        coded = np.zeros((2, len(words), self.width), ">u2")
        coded[1] = 65535
        for k, (w, _) in enumerate(words):
            coded[:, k, :len(w)] = [self.code_of[ord(c)] for c in w]
        self.low, self.high = (np.ascontiguousarray(c).view(f"S{2 * self.width}").ravel() for c in coded)
        self.piece_ids = np.array([i for _, i in words], np.int32)
        self.piece_len = np.array([len(w) for w, _ in words], np.int32)
        order = np.argsort(self.low)  # neighbouring pieces search neighbouring places
        self.low, self.high, self.piece_ids, self.piece_len = (x[order] for x in (self.low, self.high, self.piece_ids, self.piece_len))
        self.spaces = {}
        # Compatibility of pairs already asked for, one to a slot.
        self.known, self.answer = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    def _last_merge(self, name: str) -> tuple[str, str] | None:
        symbols = list(name)
        while len(symbols) > 2:
            best = min(((self.merge_rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.merge_rank), default=None)
            if best is None:
                return None
            symbols[best[1]:best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
        return (symbols[0], symbols[1]) if all(s in self.id_of for s in symbols) else None

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b side by side stay as they are."""
        key = a.astype(np.int64) * (self.n + 1) + b
        slot = (mix64(key.astype(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)
        out = self.answer[slot]
        todo = np.flatnonzero(self.known[slot] != key)
        if len(todo):
            new, where = np.unique(key[todo], return_inverse=True)
            out[todo] = self._compatible(new // (self.n + 1), new % (self.n + 1))[where]
            # Two keys of one slot: the later takes it, in both arrays.
            self.known[slot[todo]], self.answer[slot[todo]] = key[todo], out[todo]
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a != self.unknown) & (b != self.unknown))
        a, b, limit = a[live], b[live], np.full(len(live), _NEVER)
        while len(live):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            across = np.where(self.pair_key[at] == key, self.pair_rank[at], _NEVER) < limit
            out[live[across]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~across & ((ra >= 0) | (rb >= 0))
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)[on]
            a, b, live = np.where(undo_a, self.right[a], a)[on], np.where(undo_a, b, self.left[b])[on], live[on]
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every occurrence of every piece in the coded text."""
        n, w = len(codes), self.width
        padded = np.concatenate([codes, np.zeros(w + 4, np.uint16)]).astype(np.uint64)
        four = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
        order = np.lexsort([four[k:k + n] for k in range(-(-w // 4) * 4 - 4, -1, -4)])
        heads = np.lib.stride_tricks.sliding_window_view(padded.astype(">u2"), w)[order]
        heads = np.ascontiguousarray(heads).view(f"S{2 * w}").ravel()
        lo, hi = np.searchsorted(heads, self.low, "left"), np.searchsorted(heads, self.high, "right")
        size = hi - lo
        piece = np.repeat(np.arange(len(lo)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[piece]
        return order[at].astype(np.int32), self.piece_len[piece], self.piece_ids[piece]

    def _codes(self, text: str) -> np.ndarray:
        return self.code_of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _all_edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``edges`` and one for each character without a piece."""
        start, length, piece = self.edges(codes)
        bare = np.flatnonzero(codes == 1).astype(np.int32)
        one, unknown = np.ones(len(bare), np.int32), np.full(len(bare), self.unknown, np.int32)
        return np.concatenate([start, bare]), np.concatenate([length, one]), np.concatenate([piece, unknown])

    def _spell(self, word: str, ids, starts) -> tuple[int, ...]:
        """Ids with byte pieces for the characters without a piece."""
        out = []
        for i, p in zip(ids, starts, strict=True):
            out += [i] if i != self.unknown else [self.byte_id[b] for b in word[p].encode("utf-8", "replace")]
        return tuple(out)

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each space marker and word; words hold no space."""
        out: list[tuple[int, ...]] = [()] * len(words)
        block, size = [], 0
        for i, w in enumerate(words):
            if len(w) >= LONG_WORD:
                out[i] = self._encode_long(MARK + w)
                continue
            block.append(i)
            size += len(w) + 2
            if size >= INDEX_CHARS:
                for k, ids in zip(block, self._encode_block([words[k] for k in block]), strict=True):
                    out[k] = ids
                block, size = [], 0
        if block:
            for k, ids in zip(block, self._encode_block([words[k] for k in block]), strict=True):
                out[k] = ids
        return out

    def _encode_block(self, words: list[str]) -> list[tuple[int, ...]]:
        """All words in step, by depth."""
        text = "".join([END + MARK + w.replace(END, "\U0010fffe") for w in words])[1:] + END
        codes = self._codes(text)
        breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == ord(END))
        codes[breaks] = 0
        start, length, piece = self._all_edges(codes)
        begin = np.concatenate([[0], breaks[:-1] + 1])
        depth = (np.arange(len(codes), dtype=np.int32) - np.repeat(begin, breaks + 1 - begin).astype(np.int32))[start]
        last = np.full(len(codes) + 1, -1, np.int32)  # by end position
        came = np.full(len(codes) + 1, -1, np.int32)
        order = np.argsort(depth.astype(np.int16), kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth[order])) + 1, [len(order)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            e = order[a:b]  # all that start at one depth; what ends there is settled
            if depth[e[0]]:
                e = e[last[start[e]] >= 0]
                e = e[self.compatible(last[start[e]], piece[e])]
            end = start[e] + length[e]
            last[end], came[end] = piece[e], start[e]
        pieces, owner, at, who = [], [], breaks.astype(np.int32), np.arange(len(words), dtype=np.int32)
        while len(who):
            pieces.append(np.stack([last[at], came[at]]))
            owner.append(who)
            at = came[at]
            on = at > begin[who]
            at, who = at[on], who[on]
        flat, own = np.concatenate(pieces, axis=1), np.concatenate(owner)
        order = np.lexsort((flat[1], own))
        ids, at, own = flat[0][order], flat[1][order], own[order]
        ends = np.searchsorted(own, np.arange(len(words) + 1)).tolist()
        listed = ids.tolist()
        out = [tuple(listed[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for k in set(own[ids == self.unknown].tolist()):
            out[k] = self._spell(MARK + words[k], out[k], (at[ends[k]:ends[k + 1]] - begin[k]).tolist())
        return out

    def _encode_long(self, word: str) -> tuple[int, ...]:
        """One word, edge by edge in the order of their starts."""
        n = len(word)
        last, came, ok = [-1] * (n + 1), [-1] * (n + 1), {}
        for a in range(0, n, INDEX_CHARS):
            codes = self._codes(word[a:a + INDEX_CHARS + self.width])
            start, length, piece = self._all_edges(codes)
            own = np.flatnonzero(start < INDEX_CHARS)
            own = own[np.argsort(start[own], kind="stable")]
            for s, size, p in zip((start[own] + a).tolist(), length[own].tolist(), piece[own].tolist(), strict=True):
                if s:
                    before = last[s]
                    if before < 0:
                        continue
                    may = ok.get((before, p))
                    if may is None:
                        may = ok[before, p] = bool(self.compatible(np.array([before]), np.array([p]))[0])
                    if not may:
                        continue
                last[s + size], came[s + size] = p, s
            if len(ok) > SLOTS:
                ok.clear()
        ids, starts, at = [], [], n
        while at > 0:
            ids.append(last[at])
            starts.append(came[at])
            at = came[at]
        return self._spell(word, ids[::-1], starts[::-1])

    def encode_spaces(self, n: int) -> tuple[int, ...]:
        """Ids of n markers that nothing else took."""
        if n not in self.spaces:
            full = max(len(p) for p in self.id_of if not p.strip(MARK))
            head = max(0, (n - 2 * full) // full)
            rest = merge_by_score([MARK] * (n - head * full), self.merge_rank)
            self.spaces[n] = (self.id_of[MARK * full],) * head + tuple(self.id_of[s] for s in rest)
        return self.spaces[n]

    def encode(self, texts: list[str | None], cache: WordCache) -> list[list[int]]:
        """Ids of each text; ``cache`` keeps the words' ids from batch to batch."""
        split = [t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        cache.age()
        new = cache.missing(set().union(*split) - {""})
        if new:
            cache.add(new, self.encode_words(new))
        cache = cache.young
        mark = self.id_of[MARK]
        out = []
        for ws in split:
            if "" not in ws:
                out.append(list(chain.from_iterable(map(cache.__getitem__, ws))))
                continue
            ids, run = [], 0
            for w in ws:
                run += 1
                if w:
                    own = cache[w]
                    if own[0] == mark:
                        ids += self.encode_spaces(run)
                        ids += own[1:]
                    else:
                        if run > 1:
                            ids += self.encode_spaces(run - 1)
                        ids += own
                    run = 0
            if run:
                ids += self.encode_spaces(run)
            out.append(ids)
        return out

    def decode(self, ids) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD, ids out of range nothing."""
        raw = b"".join([self.out_bytes[i] for i in ids if i is not None and 0 <= i < self.n])
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text, ids) of each row's whole text. Null: null ids; empty: none. Repeated rows are encoded alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = load(model_path), WordCache()
        for part in row_slices(batches, limit=SLICE):
            texts = part.column("text").to_pylist()
            ids = [None if t is None else i for t, i in zip(texts, model.encode(texts, cache), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("text"), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "text", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), "text")
    return rows.mapInArrow(run, f"{id_col} long, text string, ids array<int>")


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """``coded`` with the column ``decoded`` (replaced, if there) made from ``ids``; null ids give null."""
    from pyspark.sql import types as T

    coded = coded.drop("decoded")
    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                texts = [None if i is None else model.decode(i) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return coded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, n_ids, round_trip): ``encode``'s ids and whether they decode to the text (a literal space marker is a space), in one pass.

    A null text has null ids, n_ids -1 as ``size`` gives it, and round_trip true.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = load(model_path), WordCache()
        for part in row_slices(batches, limit=SLICE):
            texts = part.column("text").to_pylist()
            coded = model.encode(texts, cache)
            same = [t is None or model.decode(i) == t.replace(MARK, " ") for t, i in zip(texts, coded, strict=True)]
            ends = np.cumsum([0, *map(len, coded)])
            none = pa.array([t is None for t in texts], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(chain.from_iterable(coded)), pa.int32()), mask=none)
            counts = [-1 if t is None else len(i) for t, i in zip(texts, coded, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(id_col), ids, pa.array(counts, pa.int32()), pa.array(same)], names=[id_col, "ids", "n_ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), "text")
    return rows.mapInArrow(run, f"{id_col} long, ids array<int>, n_ids int, round_trip boolean")
