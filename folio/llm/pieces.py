"""SentencePiece merge-type vocabularies: an encoder with a score-ordered agenda, and a decoder.

Text is handled as the library does with an identity normaliser: a space before the text,
spaces as U+2581. No piece has U+2581 after another character, so the text falls into
segments (a run of U+2581 and what follows it) that can be encoded one by one; frequent
segments are kept encoded in a bounded cache of each Python worker.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folio.llm.common import mix64

SPACE = "▁"
#: Segments of texts with runs of spaces, or with U+2581 itself.
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
#: Bytes of segments and ids kept during a task, in two generations of half of them.
CACHE_BYTES = 64 << 20
#: Longer segments are not kept.
KEPT_CHARS = 64
#: Segments of up to so many characters go through their agendas many at a time, longer ones by a heap of their own.
SHORT = 40
_LOADED: dict = {}


class Kept(dict):
    """A cache of two generations: when the young one is full, the old one goes."""

    ENTRY = 200  # about what a short key, its value and their places take

    def __init__(self, limit: int = CACHE_BYTES):
        self.entries, self.old = limit // (2 * self.ENTRY), {}

    def lookup(self, keys: list[str], compute) -> list[bytes]:
        """The values of different keys; compute(keys) makes those that are not kept."""
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()
        out, new = list(map(self.get, keys)), []
        for i in [i for i, v in enumerate(out) if v is None]:
            out[i] = v = self.old.get(keys[i])
            if v is None:
                new.append(i)
            else:
                self[keys[i]] = v
        for i, v in zip(new, compute([keys[i] for i in new]) if new else ()):
            out[i] = v
            if len(keys[i]) <= KEPT_CHARS:
                self[keys[i]] = v
        return out


def joined(lists: pa.ListArray, values_of, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows end to end, and the n + 1 offsets of the rows, of a column of lists of words.
    values_of: bytes of numbers of this kind for each different word."""
    code, words, bounds = coded(lists)
    return gathered(values_of(words), code, bounds, kind)


def coded(lists: pa.ListArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Numbers of the words of all rows end to end, the different words, and the n + 1 offsets of the rows."""
    words = lists.flatten().dictionary_encode()
    return words.indices.to_numpy(), words.dictionary.to_pylist(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def gathered(values: list[bytes], code: np.ndarray, bounds: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows end to end, and the n + 1 offsets of the rows; values: bytes of those of each different word."""
    size = np.dtype(kind).itemsize
    length = np.fromiter(map(len, values), np.int64, len(values)) // size
    flat = np.frombuffer(b"".join(values), kind)
    begin, n = np.cumsum(length) - length, length[code]
    end = np.cumsum(n)
    at = np.repeat(begin[code] - (end - n), n) + np.arange(int(n.sum()))
    return flat[at], np.concatenate([[0], end])[bounds]


class Pieces:
    """A vocabulary read through the library, with our own encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.size = n
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.byte = [-1] * 256
        normal = {}
        for i, p in enumerate(self.text):
            if lib.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                normal[p] = (i, lib.get_score(i))
        self.normal = normal
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("the vocabulary has pieces that cross words")
        if any("\n" in p for p in normal):
            raise ValueError("the vocabulary has pieces that cross lines")
        self.is_byte = np.zeros(n, bool)
        self.is_byte[[i for i in self.byte if i >= 0]] = True
        self.decimal = [str(i) for i in range(n)]
        self.kind = "<u2" if n <= 1 << 16 else "<u4"
        self._pair_table()
        self.fresh()

    def fresh(self, limit: int = CACHE_BYTES) -> None:
        """Forgets what was kept: caches live as long as a task."""
        self.cache = Kept(limit)

    def agenda(self, segment: str) -> list[int]:
        """Merges adjacent symbols in order of score (ties: leftmost) until no pair is a piece."""
        return self._ids(self._long(list(segment)))

    def _pair_table(self) -> None:
        """A hash table of the pairs of symbols that are a piece together. A symbol's number is its piece's, or
        size + code point for a character that is no piece."""
        number = lambda s: self.normal[s][0] if s in self.normal else self.size + ord(s) if len(s) == 1 else -1
        found = [(number(p[:i]), number(p[i:]), got[0]) for p, got in self.normal.items() for i in range(1, len(p))]
        left, right, both = np.array(found or [(-1, -1, 0)], np.int64).T
        whole = (left >= 0) & (right >= 0)
        keys, both = left[whole] << 32 | right[whole], both[whole]
        self.slots = max(1 << 10, 1 << int(len(keys)).bit_length() + 1)
        self.pair, self.joint = np.full(self.slots, -1, np.int64), np.full(self.slots, self.size, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.pair[at] < 0
            self.pair[at[free]] = keys[free]
            here = self.pair[at] == keys
            self.joint[at[here]] = both[here]
            keys, both, at = keys[~here], both[~here], (at[~here] + 1) & (self.slots - 1)
        self.price = np.full(self.size + 1, np.inf)
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for p, (i, score) in self.normal.items():
            self.price[i] = -score
            if len(p) == 1:
                self.symbol[ord(p)] = i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) & np.uint64(self.slots - 1)).astype(np.int64)

    def _joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that these pairs of symbols are together; size where they are none."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        have, out = self.pair[at], self.joint[at]
        far = np.flatnonzero((have != keys) & (have >= 0))
        out[have < 0] = self.size
        while len(far):
            at[far] = (at[far] + 1) & (self.slots - 1)
            have = self.pair[at[far]]
            out[far] = np.where(have == keys[far], self.joint[at[far]], self.size)
            far = far[(have != keys[far]) & (have >= 0)]
        return out

    def _merged(self, sym: np.ndarray):
        """The agendas of many segments of equal length (rows of symbols) side by side: each step merges the best
        pair of every row, so that all rows lose one symbol; yields rows without a pair left, and their symbols."""
        who, width = np.arange(len(sym)), sym.shape[1]
        joint = self._joint(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(sym), width - 1)
        cost = self.price[joint]
        while width > 1 and len(who):
            best = cost.argmin(axis=1)
            go = cost[np.arange(len(who)), best] < np.inf
            if not go.all():
                yield who[~go], sym[~go]
                who, sym, joint, cost, best = who[go], sym[go], joint[go], cost[go], best[go]
            row, width = np.arange(len(who)), width - 1
            sym[row, best] = joint[row, best]
            stay = np.ones(sym.shape, bool)
            stay[row, best + 1] = False
            sym = sym[stay].reshape(len(who), width)
            stay = np.ones(joint.shape, bool)
            stay[row, best] = False
            joint, cost = (x[stay].reshape(len(who), width - 1) for x in (joint, cost))
            for at in (best - 1, best):  # the pairs that the new symbol is in
                r = np.flatnonzero((at >= 0) & (at < width - 1))
                a = at[r]
                joint[r, a] = new = self._joint(sym[r, a], sym[r, a + 1])
                cost[r, a] = self.price[new]
        if len(who):
            yield who, sym

    def _long(self, sym: list[str]) -> list[str]:
        """The agenda as a heap; pairs that have changed since are passed over."""
        normal, n = self.normal, len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            got = normal.get(sym[i] + sym[i + 1])
            if got:
                heap.append((-got[1], i, i + 1, len(sym[i]) + len(sym[i + 1])))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, j, size = pop(heap)
            a, b = sym[i], sym[j]
            if not a or not b or len(a) + len(b) != size or right[i] != j:
                continue
            sym[i], sym[j] = a + b, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                got = normal.get(sym[i] + sym[k])
                if got:
                    push(heap, (-got[1], i, k, size + len(sym[k])))
            k = left[i]
            if k >= 0:
                got = normal.get(sym[k] + sym[i])
                if got:
                    push(heap, (-got[1], k, i, size + len(sym[k])))
        return [s for s in sym if s]

    def _ids(self, sym: list[str]) -> list[int]:
        out, normal = [], self.normal
        for s in sym:
            got = normal.get(s)
            if got:
                out.append(got[0])
            else:
                out.extend(self.byte[b] for b in s.encode())
        return out

    def _segments(self, text: str) -> list[str]:
        return [s[1:] if s[0] == SPACE else s for s in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))] if text else []

    def split(self, texts: pa.Array) -> pa.ListArray:
        """Keys of the segments: what follows the first U+2581 of each, or a line break and what
        follows it (no piece has a line break, so that merges never cross one)."""
        out = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = out.offsets.to_numpy()
        odd = np.add.reduceat(np.append(pc.equal(out.flatten(), "").to_numpy(zero_copy_only=False), False), np.minimum(offsets[:-1] - offsets[0], offsets[-1] - offsets[0])) > 0 if len(out) else np.zeros(0, bool)
        odd |= pc.match_substring(texts, SPACE).to_numpy(zero_copy_only=False)
        if odd.any():  # runs of spaces, or U+2581 itself; empty texts have no segments
            lists = out.to_pylist()
            for i in np.flatnonzero(odd):
                lists[i] = self._segments(texts[i].as_py())
            out = pa.array(lists, pa.list_(pa.string()))
        return out

    def by_agenda(self, keys: list[str]) -> list[bytes]:
        """Our ids of these segments; those of equal length go through their agendas together, long ones one by one."""
        keys = [k if k[:1] == "\n" else SPACE + k for k in keys]
        length = np.fromiter(map(len, keys), np.int64, len(keys))
        code = self.symbol[np.frombuffer("".join(keys).encode("utf-32-le"), "<u4")]
        begin, n, done = np.cumsum(length) - length, np.zeros(len(keys), np.int64), []
        for width in np.unique(length[length <= SHORT]).tolist():
            rows = np.flatnonzero(length == width)
            for who, sym in self._merged(code[begin[rows, None] + np.arange(width)]):
                n[rows[who]] = sym.shape[1]
                done.append((rows[who], sym))
        ends = np.cumsum(n)
        flat = np.zeros(int(n.sum()), np.int32)
        for who, sym in done:
            flat[(ends - n)[who, None] + np.arange(sym.shape[1])] = sym
        raw, size = flat.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        out = [raw[a:b] for a, b in pairwise([0, *(ends * size).tolist()])]
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(flat >= self.size), "right"))  # these have characters that are no piece
        alone = [*odd.tolist(), *np.flatnonzero(length > SHORT).tolist()]
        for i, value in zip(alone, self._packed([self.agenda(keys[i]) for i in alone])):
            out[i] = value
        return out

    def by_library(self, keys: list[str]) -> list[bytes]:
        """The library's ids of these segments; it puts U+2581 before a line break too, which goes."""
        got = self.library.encode([k.replace(SPACE, " ") for k in keys], num_threads=1)
        # a segment of one bare U+2581 is nothing to the library by itself
        return self._packed([x[1:] if k[:1] == "\n" else x if k else self.agenda(SPACE) for k, x in zip(keys, got)])

    def _packed(self, lists: list[list[int]]) -> list[bytes]:
        """Bytes of each list of ids."""
        raw = np.fromiter(chain.from_iterable(lists), self.kind).tobytes()
        ends = np.cumsum([0, *map(len, lists)]) * np.dtype(self.kind).itemsize
        return [raw[a:b] for a, b in pairwise(ends.tolist())]

    def encode(self, texts: pa.Array, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and their offsets; own: by our agenda, else by the library."""
        compute = self.by_agenda if own else self.by_library
        return joined(self.split(pc.fill_null(texts, "")), lambda keys: self.cache.lookup(keys, compute), self.kind)


def load(path: str) -> Pieces:
    """The vocabulary at path, once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
