"""Removal of repeated byte strings by suffix arrays and longest-previous-factor arrays.

Which texts can share a string is found by winnowing: in every window of LENGTH bytes the
least-hashed inner string of SEED bytes is its anchor, so equal windows have equal anchors.
The windows of one anchor form a cell. Cells that are equal as a whole are one kind, of which
the first place and one other stand for all; the kinds of an anchor that occurs twice or more
are brought together: there a suffix array is built, and from the previous and next smaller
positions in suffix order comes the longest earlier (and later) match of every window. What it says
of a kind's two places holds for all its places. An anchor with more than GROUP kinds is not
brought together, so that no task has to hold a group: its windows are kinds of their own, by two
hashes, and two places of each repeated one go through the suffix array in the same way.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common

LENGTH, SEED = 200, 32
#: Groups of more different cells than this (some 2 MB) go on window by window instead.
GROUP = 4000
#: Bytes of cells that a task sorts at once (plus one group).
SORT_BYTES = 1 << 16
#: A place and its number of windows (under PLACE) go as one number.
PLACE = 1024
#: A text is anchored in slices of so many bytes.
SLICE = 4 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Cells of the texts: row, start in the row, windows, hash of the anchor, hash of the cell."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = common.prefix_hash(data)
    back = common.powers(n)[1]
    grams = n - seed + 1
    gram = common.mix64((prefix[seed:] - prefix[:grams]) * back[:grams])
    key = (gram & np.uint64(0xFFFFFFFFFF000000)) | (np.arange(grams, dtype=np.uint64) & np.uint64(0xFFFFFF))
    width = length - seed + 1
    blocks = -(-grams // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:grams] = key
    grid = padded.reshape(blocks, width)
    fore = np.minimum.accumulate(grid, axis=1).ravel()
    aft = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    anchor = (np.minimum(aft[:windows], fore[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    valid = np.arange(windows) + length <= offsets[row + 1]
    edge = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]) & valid
    start = np.flatnonzero(edge)
    count = np.add.reduceat(valid.astype(np.int64), start) if len(start) else none
    at = anchor[start]
    cell = common.span_hash(prefix, start, start + count + length - 1) + common.mix64((at - start).astype(np.uint64))
    return row[start], start - offsets[row[start]], count, gram[at], common.mix64(cell)


def _anchored(length: int, seed: int):
    @common.frugal
    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "text"):
                data, offsets = common.byte_view(batch.column(2))
                ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                if len(data) <= SLICE:
                    parts = [(0, anchors(data, offsets, length, seed))]
                else:  # one long text; windows of neighbouring slices meet without overlap
                    step = SLICE - length + 1
                    parts = [(at, anchors(data[at : at + SLICE], np.array([0, min(SLICE, len(data) - at)]), length, seed)) for at in range(0, len(data), step)]
                    # its row is the only one with bytes
                for at, (row, pos, n, gram, cell) in parts:
                    if at or len(data) > SLICE:
                        row = np.full(len(row), int(np.argmax(np.diff(offsets))))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row]), pa.array(keys[row]), pa.array((pos + at) * PLACE + n), pa.array(gram.view(np.int64)), pa.array(cell.view(np.int64))],
                        names=["id", "key", "at", "gram", "cell"],
                    )

    return run


def _segments(length: int):
    """Bytes of the wanted cells, one piece a cell."""

    @common.frugal
    def run(batches):
        for batch in (piece for whole in batches for piece in common.pieces(whole, "text")):
            out, held = [[] for _ in _SEGMENT_NAMES], 0
            ids, keys, raw = (batch.column(i).to_pylist() for i in (0, 1, 2))
            for i, wanted in enumerate(batch.column(3).to_pylist()):
                text = raw[i].encode()
                for w in wanted:
                    piece = text[w["pos"] : w["pos"] + w["n"] + length - 1]
                    values = w["gram"], ids[i], keys[i], w["pos"], w["turn"], w["n"], w["cell"], w["mark"], piece
                    for column, value in zip(out, values):
                        column.append(value)
                    held += len(piece)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SEGMENT_TYPES)], names=_SEGMENT_NAMES)
                    out, held = [[] for _ in _SEGMENT_NAMES], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SEGMENT_TYPES)], names=_SEGMENT_NAMES)

    return run


def _windows(length: int):
    """The windows of the wanted cells: two hashes, where each stands, and its cell and place in it."""

    @common.frugal
    def run(batches):
        for batch in (piece for whole in batches for piece in common.pieces(whole, "text")):
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            for i, wanted in enumerate(batch.column(3).to_pylist()):
                for w in wanted:
                    data = np.frombuffer(raw[i], np.uint8, w["n"] + length - 1, w["pos"])
                    start = np.arange(w["n"])
                    one, two = (common.span_hash(common.prefix_hash(data, seed), start, start + length).view(np.int64) for seed in (1, 2))
                    same = [pa.array(np.full(w["n"], x)) for x in (ids[i], keys[i])]
                    of = [pa.array(np.full(w["n"], w[c], kind)) for c, kind in (("gram", np.int64), ("cell", np.int64), ("turn", np.int32), ("mark", np.int64))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array((w["pos"] + start) * PLACE + 1), pa.array(one), pa.array(two), *of, pa.array(start)], names=_WINDOW_NAMES)

    return run


_SEGMENT_NAMES = ["bucket", "id", "key", "pos", "turn", "n", "cell", "mark", "bytes"]
_SEGMENT_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
_SEGMENT_SCHEMA = "bucket long, id long, key int, pos int, turn int, n int, cell long, mark long, bytes binary"
_WINDOW_NAMES = ["id", "key", "at", "gram", "cell", "of_gram", "of_cell", "turn", "of_mark", "inner"]
_WINDOW_SCHEMA = "id long, key int, at long, gram long, cell long, of_gram long, of_cell long, turn int, of_mark long, inner long"


def suffix_array(data: np.ndarray, depth: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes (all, or those at starts) in the order of their first `depth` bytes and more, and the ranks of all by the
    first 8 and, below depth, by ever more bytes (equal rank: equal bytes). A round puts as many ranks together as a
    number of 64 bits holds, so that few rounds are needed; the last sorts the wanted suffixes alone."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    ranks, h, bits = {}, 8, max(n.bit_length(), 1)
    while True:
        if h >= depth and starts is not None:
            return starts[np.argsort(key[starts])], ranks
        order = np.argsort(key)
        ordered = key[order]
        rank = np.zeros(n, np.uint32)
        rank[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1], dtype=np.uint32)
        ranks[h] = rank
        if h >= depth:
            return order, ranks
        times = min(64 // bits, -(-depth // h))
        more = rank.astype(np.uint64) + np.uint64(1)
        key = more << np.uint64(bits * (times - 1))
        for j in range(1, times):  # beyond the end there is 0
            key[: max(n - j * h, 0)] |= more[j * h :] << np.uint64(bits * (times - 1 - j))
        h *= times


def same_prefix(ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether suffixes a and b agree in their first `length` bytes (a multiple of 8), which both have."""
    same, at = np.ones(len(a), bool), 0
    for h in sorted(ranks, reverse=True):
        while at + h <= length:
            same &= ranks[h][a + at] == ranks[h][b + at]
            at += h
    return same


def nearest_smaller(position: np.ndarray, link: np.ndarray, step: int) -> np.ndarray:
    """For each place in suffix order the nearest one before (step -1) or after (1) with a smaller
    position, as far as links reach (link[i]: places i and i + 1 match); -1 if there is none."""
    n = len(position)
    near = np.arange(n) + step
    joined = np.concatenate([[False], link]) if step < 0 else np.concatenate([link, [False]])
    near[~joined] = -1
    while True:
        high = np.flatnonzero((near >= 0) & (position[near] > position))
        if not len(high):
            return near
        near[high] = near[near[high]]


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int, first: bool) -> np.ndarray:
    """Which of the windows at these (rising) starts also stand elsewhere; first: earlier.

    The longest previous factor of a place is that with its previous or its next smaller
    position in suffix order; links say where factors reach the length. A window stands elsewhere
    if it has such a factor, or is one of a later place: of its previous or next larger position.
    """
    order, ranks = suffix_array(data, length, starts)  # the sparse suffix array of the windows
    link = same_prefix(ranks, order[:-1], order[1:], length) if len(order) > 1 else np.zeros(0, bool)
    earlier = (nearest_smaller(order, link, -1) >= 0) | (nearest_smaller(order, link, 1) >= 0)
    out = np.zeros(len(data), bool)
    out[order[earlier]] = True
    if not first:
        out[order[(nearest_smaller(-order, link, -1) >= 0) | (nearest_smaller(-order, link, 1) >= 0)]] = True
    return out[starts]


def _sorted_repeats(length: int, first: bool):
    """Rows come sorted by bucket, id, position, turn; whole buckets are sorted together. Says which windows of each
    piece stand elsewhere: ranges of bytes from the piece's start."""

    def judge(table: pa.Table):
        # rows that repeat an id and a text are one place
        place = [table.column(c).to_numpy() for c in ("bucket", "id", "key", "pos", "turn")]
        table = table.filter(pa.array(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in place], axis=0)])))
        n = table.column("n").to_numpy().astype(np.int64)
        data, offsets = common.byte_view(table.column("bytes").combine_chunks())
        total = int(n.sum())
        begin = np.repeat(np.cumsum(n) - n, n)
        inner = np.arange(total) - begin
        of = np.repeat(np.arange(len(n)), n)
        hit = repeated_windows(data, offsets[of] + inner, length, first)
        if not first:  # both places of a kind have the same windows elsewhere
            hit &= table.column("turn").to_numpy()[of] == 0
        edge = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & (inner > 0)))
        stop = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & np.concatenate([inner[1:] > 0, [False]])))
        who = pa.array(of[edge])
        said = [table.column(c).combine_chunks().take(who) for c in ("bucket", "cell", "turn", "mark")]
        return pa.RecordBatch.from_arrays([*said, pa.array(inner[edge]), pa.array(inner[stop] + length)], names=["gram", "cell", "turn", "mark", "start", "end"])

    @common.frugal
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for piece in common.pieces(batch, "bytes", SORT_BYTES // 4):
                held.append(pa.Table.from_batches([piece]))
                size += piece.column(8).nbytes
                if size < SORT_BYTES:
                    continue
                table = pa.concat_tables(held)
                bucket = table.column("bucket").to_numpy()
                cut = int(np.searchsorted(bucket == bucket[-1], True))  # the last bucket may go on
                if cut:
                    yield judge(table.slice(0, cut))
                    held = [table.slice(cut)]
                    size = int(held[0].column("bytes").nbytes)
        if held:
            yield judge(pa.concat_tables(held))

    return run


def _key(text_col: str):
    """Tells rows that repeat an id apart."""
    return F.hash(F.coalesce(text_col, F.lit("")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(common.row_id(id_col, text_col).alias("id"), _key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _mark(place: str = "") -> str:
    """Names a place in one number."""
    return f"xxhash64({', '.join(place + c for c in ('id', 'key', 'at', 'turn'))})"


def _kinds(places: DataFrame) -> DataFrame:
    """Each gram and cell, its first place f and its last place l, and how many it has."""
    place = F.struct("id", "key", "at", "turn")
    return places.groupBy("gram", "cell").agg(F.count("*").alias("copies"), F.min(place).alias("f"), F.max(place).alias("l"))


def _texts_of(rows: DataFrame, kinds: DataFrame, first: bool) -> DataFrame:
    """The texts that the first and another place of these kinds are in, with the list of those places."""
    place = lambda f, turn: F.struct(
        F.col(f"{f}.id").alias("id"), F.col(f"{f}.key").alias("key"), F.lit(turn).alias("turn"), F.expr(f"int({f}.at div {PLACE})").alias("pos"), F.expr(f"int({f}.at % {PLACE})").alias("n")
    )
    # of repeated rows one place is the other's copy only where none is kept
    other = F.expr("copies > 1" + (" and f <> l" if first else ""))
    both = F.when(other, F.array(place("f", 0), place("l", 1))).otherwise(F.array(place("f", 0)))
    wanted = kinds.select("gram", "cell", F.expr(_mark("f.")).alias("mark"), F.explode(both).alias("p"))
    lists = wanted.groupBy("p.id", "p.key").agg(F.collect_list(F.struct("gram", "cell", "mark", "p.turn", "p.pos", "p.n")).alias("wanted"))  # at most a text's own cells
    return rows.join(lists, ["id", "key"]).select("id", "key", "text", "wanted")


def _judged(rows: DataFrame, kinds: DataFrame, first: bool, length: int) -> DataFrame:
    """What the suffix array says of kinds: gram, cell, turn (0: of the first place, or of all if none is kept; 1: of all others),
    mark of the first place, start and end in the cell."""
    # written, so that the texts that were shuffled for them are gone when the pieces are shuffled
    pieces = common.cut(_texts_of(rows, kinds, first).mapInArrow(_segments(length), _SEGMENT_SCHEMA), "pieces")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = pieces.repartition(parts, "bucket").sortWithinPartitions("bucket", "id", "key", "pos", "turn")
    told = common.cut(spread.mapInArrow(_sorted_repeats(length, first), "gram long, cell long, turn int, mark long, start long, end long"), "verdicts")
    common.discard(pieces)
    return told


def _told(places: DataFrame, verdicts: DataFrame, first: bool) -> DataFrame:
    """places, each with the ranges (start, end, in the cell) that verdicts have for it."""
    met = places.join(verdicts.withColumnRenamed("turn", "whose"), ["gram", "cell"])
    return met.where(f"({_mark()} = mark) = (whose = 0)") if first else met


def repeats(rows: DataFrame, *, keep: str = "first", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """id, key and the byte ranges (start, end) that repeated windows cover; ranges may overlap.

    keep "first": windows that stand earlier in the order of id and position; "none": anywhere else.
    """
    first = keep == "first"
    cells = common.cut(rows.mapInArrow(_anchored(length, seed), "id long, key int, at long, gram long, cell long"), "cells")
    # written first, so that the join is free to split a gram that very many cells have
    again = common.cut(cells.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1").select("gram"), "grams")
    shared = common.cut(cells.join(again, "gram"), "shared")
    common.discard(cells)
    common.discard(again)
    shared = shared.withColumn("turn", F.lit(0))
    kinds = common.cut(_kinds(shared), "kinds")
    large = common.few(kinds.groupBy("gram").count().where(f"count > {GROUP}").select("gram"), "large")
    verdicts = _judged(rows, kinds.join(large, "gram", "left_anti"), first, length)
    if not large.isEmpty():
        windows = _texts_of(rows, kinds.join(large, "gram", "left_semi"), first).mapInArrow(_windows(length), _WINDOW_SCHEMA)
        windows = common.cut(windows, "windows")
        twice = common.cut(_kinds(windows).where("f <> l"), "twice")
        told = _told(windows, _judged(rows, twice, first, length), first)
        if not first:
            told = told.where("turn = 0")
        verdicts = verdicts.union(told.selectExpr("of_gram as gram", "of_cell as cell", "turn", "of_mark as mark", "inner as start", f"inner + {length} as end"))
        verdicts = common.cut(verdicts, "all")
        common.discard(windows)
        common.discard(twice)
    common.discard(kinds)
    found = _told(shared, verdicts, first).selectExpr("id", "key", f"at div {PLACE} + start as start", f"at div {PLACE} + end as end")
    found = common.cut(found, "ranges")
    common.discard(shared)
    return found


@common.frugal
def _stripped(batches):
    for whole in batches:
        for batch in common.pieces(whole, "text"):
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            out = [[], [], [], [], []]
            for b, starts, ends in zip(raw, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                spans = []
                for s, e in sorted(zip(starts or (), ends or ())):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                inner = []  # cut back to whole characters, for texts that must stay valid
                for s, e in spans:
                    while s < e and b[s] & 0xC0 == 0x80:
                        s += 1
                    while e < len(b) and e > s and b[e] & 0xC0 == 0x80:
                        e -= 1
                    inner.append((s, e))
                left = lambda cuts: b"".join(b[i:j] for i, j in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(b)]))  # noqa: E731, B023
                for column, value in zip(out, (len(b), sum(e - s for s, e in spans), len(spans), hashlib.sha256(left(spans)).hexdigest(), left(inner).decode())):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[4:], *(pa.array(c, t) for c, t in zip(out, types))], names=["id", *batch.schema.names[4:], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "first", length: int = LENGTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the carried columns, n_bytes, n_removed, n_spans, kept_sha256
    and kept, the text that is left (cut between whole characters).

    Null texts are empty. Texts shorter than `length` bytes stay. Rows with equal id and text are copies
    of each other (with keep "first" both are the first); rows without an id come after all others; an empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    spans = repeats(rows, keep=keep, length=length)
    spans = spans.groupBy("id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    full = docs.select(
        common.row_id(id_col, text_col).alias("id"), F.col(id_col).cast("long").alias("given"), _key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry]
    )
    met = full.join(spans, ["id", "key"], "left").select(F.col("given").alias("id"), "text", "starts", "ends", *[f"carried_{c}" for c in carry])
    types = "".join(f", carried_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    out = met.mapInArrow(_stripped, f"id long{types}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return out.withColumnsRenamed({f"carried_{c}": c for c in carry})


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read_table(spark, sf_dir, "documents", "doc_id", "text"), keep="none").drop("kept").withColumnRenamed("id", "doc_id")
