"""Packing documents into sequences of fixed capacity: cutting stock by column generation.

Only the histogram of lengths reaches the driver: at most capacity / GRAIN counts, however many
documents there are. A linear program over patterns (which lengths share a sequence) is
solved by column generation, a knapsack dynamic program pricing the columns; whole
multiples of the patterns are handed to documents by their rank within their length.
What rounding leaves is laid end to end and cut at the capacity.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import common

CAPACITY = 2048
#: Lengths are grouped by so many tokens in the linear program; a sequence may lack under so many for each piece.
GRAIN = 8
#: A cut document costs so much more than its share of a sequence: the padding that is worth a cut.
CUT_COST = 0.04
#: Column generation goes on to the optimum; only if so many rounds bring nothing (degenerate bases) does it
#: stop before. What is unsolved then is cut, so that no document is lost.
STALLED = 1000
#: Rests that rounding leaves and a sequence's end tears: up to so many (some 50 bytes each) are broadcast to
#: find their texts again, more are joined by a shuffle.
TORN = 200_000
#: Documents of a length are ranked in so many independent groups of about so many rows.
RANK_ROWS = 50_000

#: No token crosses white space, or the bounds of these parts of lower-case words. Texts of other characters
#: than _PLAIN, or with what may be a special token, go to the tokeniser whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")
#: The kinds that parts are made of: letters, single digits, other characters; and words that an apostrophe begins.
_BLANK, _LETTER, _DIGIT, _OTHER = range(4)
_SHORTENED = ("s", "t", "m", "d", "re", "ve", "ll")
#: Kinds of characters below U+0250; those of three bytes in _PLAIN are of the last kind.
_KIND = np.array([_BLANK if c in "\t\n\r " else _LETTER if c.isalpha() else _DIGIT if c.isdigit() or c in "¼½¾" else _OTHER for c in map(chr, range(0x250))], np.uint8)
_KIND_OF_BYTE = np.concatenate([_KIND[:128], np.full(128, _OTHER, np.uint8)])
#: Parts of up to 16 bytes are their own keys, as two numbers; masks for the bytes of a number that are a part's.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: In the place of a key's second number: the first one counts the longer parts. No UTF-8 has such a byte.
_LONG = np.uint64(2**64 - 1)
#: Slots of the table of parts that a task keeps (some 20 MB); it is emptied when half of them are taken, or when the
#: long parts have so many bytes.
SLOTS = 1 << 20
LONG_BYTES = 16 << 20
#: Parts that are looked up together.
BLOCK = 1 << 17
#: Parts that are new are given to the tokeniser in lines of so many.
LINE = 64
#: Bytes of texts that share the search for their different words.
CHUNK = 2 << 20
_LOADED: dict = {}


def beyond_words(texts: pa.Array) -> list[int]:
    """Rows whose texts the tokeniser must see whole: their ids need not be those of their words."""
    return [i for i, t in enumerate(texts.to_pylist()) if not _PLAIN.fullmatch(t) or "<|" in t]


def part_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where parts start and end in the bytes of _PLAIN text with A-Z in lower case; each text ends in white space."""
    kind = _KIND_OF_BYTE[data]
    tail, two = np.flatnonzero((data & 0xC0) == 0x80), np.flatnonzero((data >= 0xC0) & (data < 0xE0))
    kind[two] = _KIND[(data[two].astype(np.int64) & 0x1F) << 6 | data[two + 1] & 0x3F]
    for _ in range(2):  # characters have up to two bytes more
        kind[tail] = kind[tail - 1]
    edge = kind == _DIGIT
    edge[:1] = True
    edge[1:] |= kind[1:] != kind[:-1]
    edge[tail] = False
    mark = np.flatnonzero(edge & (data == ord("'")))
    for word in _SHORTENED:
        at = mark[: np.searchsorted(mark, len(data) - len(word))]
        for i, c in enumerate(word.encode()):
            at = at[data[at + 1 + i] == c]
        edge[at + 1] = False
        edge[at + 1 + len(word)] = True
    at = np.flatnonzero(edge)
    real = kind[at] != _BLANK
    return at[real], np.append(at[1:], len(data))[real]


class WordIds:
    """Ids of texts as little-endian 32-bit numbers, by the tokenizers library. Texts fall into parts that are looked up
    as arrays in a table of those that the task has met; only new ones are given to the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        lone = {t: i for t, i in vocabulary.items() if len(t.removesuffix("</w>")) == 1}
        self.is_byte = np.zeros(len(self.ends), bool)  # the vocabulary writes bytes beyond ASCII as characters beyond it
        self.is_byte[[i for t, i in lone.items() if ord(t[0]) > 126]] = True
        self.fresh()

    def fresh(self) -> None:
        """Forgets what was kept: tables live as long as a task."""
        self.first, self.second, self.entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.begin, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts end to end, and the number of each part's. Each part is one word of the vocabulary's: its last
        token, and no other, ends a word."""
        ids, n = [], []
        lines = [parts[i : i + LINE] for i in range(0, len(parts), LINE)]
        for line, got in zip(lines, self.whole([" ".join(x) for x in lines])):
            stop = np.flatnonzero(self.ends[got]) + 1
            if len(stop) != len(line) or stop[-1] != len(got):
                alone = self.whole(line)
                got, stop = np.concatenate(alone), np.cumsum([len(x) for x in alone])
            ids.append(got)
            n.append(np.diff(stop, prepend=0))
        return np.concatenate(ids), np.concatenate(n)

    def _places(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of keys, and which keys were entered now, one of each."""
        at = (common.mix64(first + common.mix64(second)) & np.uint64(SLOTS - 1)).astype(np.int64)
        todo, new = np.arange(len(at)), []
        while len(todo):
            free = todo[self.first[at[todo]] == 0]
            self.entry[at[free]] = free
            free = free[self.entry[at[free]] == free]  # of several keys one has the slot
            self.first[at[free]], self.second[at[free]] = first[free], second[free]
            new.append(free)
            todo = todo[(self.first[at[todo]] != first[todo]) | (self.second[at[todo]] != second[todo])]
            at[todo] = (at[todo] + 1) & (SLOTS - 1)
        return at, np.concatenate(new)

    def _block(self, raw: bytes, word: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts end to end, and the number of each part's. word: the eight bytes from each place on, as a number."""
        if len(self.begin) + len(start) > SLOTS // 2 or self.long_bytes > LONG_BYTES:
            self.fresh()
        size = end - start
        first, second = word[start] & _MASK[np.minimum(size, 8)], word[start + 8] & _MASK[np.clip(size - 8, 0, 8)]
        for i in np.flatnonzero(size > 16).tolist():
            part = raw[start[i] : end[i]]
            if part not in self.long:
                self.long[part] = len(self.long) + 1
                self.long_bytes += len(part)
            first[i], second[i] = self.long[part], _LONG
        at, new = self._places(first, second)
        if len(new):
            ids, n = self._of_parts([raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist())])
            self.entry[at[new]] = len(self.begin) + np.arange(len(new))
            self.begin = np.append(self.begin, len(self.ids) + np.cumsum(n) - n)
            self.length, self.ids = np.append(self.length, n), np.append(self.ids, ids)
        entry = self.entry[at]
        begin, n = self.begin[entry], self.length[entry]
        stop = np.cumsum(n)
        return self.ids[np.repeat(begin - (stop - n), n) + np.arange(int(n.sum()))], n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) end to end, and the n + 1 offsets of the texts."""
        texts = pc.fill_null(texts, "")
        whole = beyond_words(texts)
        plain = np.ones(len(texts), bool)
        plain[whole] = False
        data, offsets = common.byte_view(pc.binary_join_element_wise(pc.if_else(pa.array(plain), texts, ""), "", "\n"))
        data = common.LOWER[data]
        start, end = part_spans(data)
        raw = data.tobytes()
        padded = np.append(data, np.zeros(16, np.uint8))
        word = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
        blocks = [self._block(raw, word, start[i : i + BLOCK], end[i : i + BLOCK]) for i in range(0, len(start), BLOCK)]
        ids = np.concatenate([np.zeros(0, "<u4"), *(b[0] for b in blocks)])
        at = np.cumsum(np.concatenate([[0], *(b[1] for b in blocks)]))[np.searchsorted(start, offsets)]
        if whole:
            rows = np.split(ids, at[1:-1])
            for i, got in zip(whole, self.whole([texts[i].as_py() for i in whole])):
                rows[i] = got
            ids, at = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        return ids, at

    def __call__(self, texts: pa.Array) -> list[bytes]:
        ids, at = self.encode(texts)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in pairwise(at.tolist())]


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _lengths(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    @common.frugal
    def run(batches):
        ids_of = word_ids(path)
        ids_of.fresh()
        for whole in batches:
            for batch in common.pieces(whole, "text", CHUNK):
                raw = [b + end for b in ids_of(batch.column(2))]
                step = 4 * capacity
                sums = [[zlib.crc32(b[i : i + step]) for i in range(0, len(b), step)] for b in raw]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(b) // 4 for b in raw], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["id", "key", "doc_tokens", "crcs"]
                )
        ids_of.fresh()

    return run


def _recut(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    @common.frugal
    def run(batches):
        ids_of = word_ids(path)
        ids_of.fresh()
        for whole in batches:
            for batch in common.pieces(whole, "text", CHUNK):
                start, first, length = (batch.column(i).to_pylist() for i in range(1, 4))
                raw = [b + end for b in ids_of(batch.column(0))]
                sums = [[zlib.crc32(b[4 * s : 4 * (s + f)]), zlib.crc32(b[4 * (s + f) : 4 * (s + n)])] for b, s, f, n in zip(raw, start, first, length)]
                yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(sums, pa.list_(pa.int64()))], names=["at", "sums"])
        ids_of.fresh()

    return run


def best_pattern(value: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack: value[s] is what a piece of size s brings (index 0 unused); the best filling of room."""
    best, choice = np.zeros(room + 1), np.zeros(room + 1, int)
    for c in range(1, room + 1):
        got = best[c - 1 :: -1][:c] + value[1 : c + 1]
        s = int(got.argmax())
        if got[s] > best[c - 1] + 1e-12:
            best[c], choice[c] = got[s], s + 1
        else:
            best[c] = best[c - 1]
    found: dict[int, int] = {}
    c = room
    while c > 0:
        if choice[c]:
            found[int(choice[c])] = found.get(int(choice[c]), 0) + 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[room]), found


def column_generation(counts: dict[int, int], room: int, stalled: int = STALLED, cut_cost: float = CUT_COST) -> list[tuple[dict[int, int], int]]:
    """Patterns (size -> how many) and how often each is used, never beyond the counts.

    Minimises sequences plus cut documents by the revised simplex method; the first basis
    cuts everything. Sizes are 1..room.
    """
    sizes = sorted(s for s, n in counts.items() if n > 0)
    m = len(sizes)
    if not m:
        return []
    row = {s: i for i, s in enumerate(sizes)}
    need = np.array([counts[s] for s in sizes], float)
    cost = np.array([(1 + cut_cost) * s / room for s in sizes])
    inverse, x = np.eye(m), need.copy()
    basis: list[dict[int, int] | None] = [None] * m
    best, idle = np.inf, 0
    while idle < stalled:
        total = float(cost @ x)
        best, idle = (total, 0) if total < best - 1e-9 * max(1.0, abs(best) if np.isfinite(best) else 1.0) else (best, idle + 1)
        price = cost @ inverse
        value = np.full(room + 1, -1.0)
        value[sizes] = price
        gain, pattern = best_pattern(value, room)
        if gain <= 1 + 1e-6:
            break
        column = inverse[:, [row[s] for s in pattern]] @ np.array(list(pattern.values()), float)
        usable = column > 1e-9
        ratio = np.full(m, np.inf)
        ratio[usable] = x[usable] / column[usable]
        out = int(ratio.argmin())
        step = ratio[out]
        if not np.isfinite(step):
            break
        x -= step * column
        x[out] = step
        np.maximum(x, 0, out=x)
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
        basis[out], cost[out] = pattern, 1.0
    used = [(p, int(n + 1e-6)) for p, n in zip(basis, x) if p and n >= 1]
    left = dict(counts)
    whole = []
    for p, n in sorted(used, key=lambda u: -u[1]):  # rounding errors must never take more than there is
        n = min([n, *(left[s] // k for s, k in p.items())])
        if n:
            whole.append((p, n))
            for s, k in p.items():
                left[s] -= k * n
    return whole


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document has its ids and one end id; null and empty texts have the end id alone.
    Full stretches of a document fill sequences by themselves; its rest is placed by pattern,
    or, if rounding leaves it over, cut where a sequence ends. Rows with equal ids are packed
    each; other columns are not looked at; an empty table gives an empty result.
    """
    spark, path = docs.sparkSession, tokenizer or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    sized = common.cut(rows.mapInArrow(_lengths(path, capacity, end_id), "id long, key long, doc_tokens long, crcs array<long>"), "lengths")
    sized = sized.withColumns({"blocks": F.expr(f"doc_tokens div {capacity}"), "rest": F.expr(f"doc_tokens % {capacity}")}).withColumn("size", F.ceil(F.col("rest") / GRAIN))

    # at most capacity / GRAIN + 1 rows come to the driver
    histogram = sized.groupBy("size").agg(F.count("*").alias("n"), F.sum("blocks").alias("blocks")).collect()
    counts = {int(r["size"]): r["n"] for r in histogram if r["size"]}
    total, blocks = sum(r["n"] for r in histogram), sum(r["blocks"] for r in histogram)
    patterns = column_generation(counts, capacity // GRAIN)
    groups = max(64, total // RANK_ROWS)

    # ranks: within a group by a window, and the groups' sizes add up to where each begins
    ranked = sized.withColumn("group", F.expr(f"pmod(xxhash64(id, key, 7), {groups})"))
    order = [F.col("id"), F.col("key"), F.col("doc_tokens")]
    in_size = Window.partitionBy("size", "group")
    ranked = ranked.withColumn("rank", F.row_number().over(in_size.orderBy(*order)) - 1)
    sizes = ranked.groupBy("size", "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("size", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    ranked = ranked.join(starts, ["size", "group"]).withColumn("rank", F.col("rank") + F.col("begin")).drop("begin")

    # where the documents of each rank go; as many rows as the patterns have entries
    slots, sequence, taken = [], 0, {}
    for p, n in patterns:
        slot = 0
        for s, k in p.items():
            at = taken.get(s, 0)
            slots.append((s, at, at + k * n, k, sequence, slot))
            taken[s] = at + k * n
            slot += k
        sequence += n
    schema = "size long, first long, beyond long, each long, sequence long, slot long"
    slot_table = F.broadcast(spark.createDataFrame(slots, schema))
    ranked = ranked.join(slot_table.withColumnRenamed("size", "s"), F.expr("size = s and rank >= first and rank < beyond"), "left")
    placed = ranked.selectExpr("id", "key", "doc_tokens", "crcs", "blocks", "rest", "size", "group", "sequence + (rank - first) div each as seq", "slot + (rank - first) % each as slot")
    placed = common.cut(placed, "placed")

    piece = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # a: rests placed by pattern
    sofar = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    by_pattern = placed.where("seq is not null").selectExpr("*", "element_at(crcs, -1) as crc").drop("crcs").withColumn("offset", F.coalesce(F.sum("rest").over(sofar), F.lit(0)))
    by_pattern = by_pattern.selectExpr("id", f"blocks * {capacity} as start", "rest as length", "crc as ids_crc32", "doc_tokens", "seq as sequence_id", "offset")

    # b: full stretches, numbered through the groups; c: what is left over, end to end
    line = Window.partitionBy("group").orderBy("id", "key", "doc_tokens", "size").rowsBetween(Window.unboundedPreceding, -1)
    long = placed.where("blocks > 0").withColumn("b0", F.coalesce(F.sum("blocks").over(line), F.lit(0)))
    left = placed.where("seq is null and rest > 0").withColumn("r0", F.coalesce(F.sum("rest").over(line), F.lit(0)))
    sums = placed.groupBy("group").agg(F.sum("blocks").alias("b"), F.sum(F.when(F.col("seq").isNull(), F.col("rest")).otherwise(0)).alias("r"))
    everything = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    bases = sums.select("group", F.coalesce(F.sum("b").over(everything), F.lit(0)).alias("b1"), F.coalesce(F.sum("r").over(everything), F.lit(0)).alias("r1"))
    full = long.join(bases, "group").selectExpr("id", "doc_tokens", "b0 + b1 as base", "posexplode(slice(crcs, 1, int(blocks))) as (k, crc)")
    full = full.selectExpr("id", f"k * bigint({capacity}) as start", f"bigint({capacity}) as length", "crc as ids_crc32", "doc_tokens", f"{sequence} + base + k as sequence_id", "bigint(0) as offset")

    left = left.join(bases, "group").withColumn("at", F.col("r0") + F.col("r1")).withColumn("room", F.expr(f"{capacity} - at % {capacity}"))
    first_id = sequence + blocks
    uncut = left.where("rest <= room").selectExpr("id", f"blocks * {capacity} as start", "rest as length", "element_at(crcs, -1) as ids_crc32", "doc_tokens", f"{first_id} + at div {capacity} as sequence_id", f"at % {capacity} as offset")
    torn = left.where("rest > room").selectExpr("id", "key", f"blocks * {capacity} as start", "room", "rest", "at", "doc_tokens")
    torn = common.cut(torn, "torn")
    cuts = torn.select(F.col("id").alias("of"), F.col("key").alias("of_key"), "start", "room", "rest", "at")
    if torn.count() <= TORN:
        cuts = F.broadcast(cuts)
    again = rows.join(cuts, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))).select("text", "start", "room", "rest", "at")
    again = again.mapInArrow(_recut(path, end_id), "at long, sums array<long>").groupBy("at").agg(F.max("sums").alias("sums"))
    torn = torn.join(again, "at").selectExpr("id", "start", "room", "rest", "at", "doc_tokens", "posexplode(sums) as (k, crc)")
    torn = torn.selectExpr(
        "id", "start + if(k = 0, 0, room) as start", "if(k = 0, room, rest - room) as length", "crc as ids_crc32", "doc_tokens", f"{first_id} + at div {capacity} + k as sequence_id", f"if(k = 0, at % {capacity}, 0) as offset"
    )
    return by_pattern.select(piece).union(full.select(piece)).union(uncut.select(piece)).union(torn.select(piece))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.read_table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")
