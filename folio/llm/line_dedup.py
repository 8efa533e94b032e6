"""Lines that many documents share, found with two Bloom filters.

Each task puts the hashes of its lines' keys into bits once seen and bits seen again; by segments of
the filter these meet, and a bit that two tasks have set has been seen again too. Only lines whose
bits are all seen again (suspected repeats) shuffle: grouped by the key itself they are counted and
the first place is chosen. A filter errs on one side only, so that no repeat is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common

#: Bits of the filter for each line; a line sets two of them.
BITS = 16
#: log2 of the bits of a segment, at least and at most.
SEGMENT = (20, 26)
#: The filter of what is seen again is broadcast with at most so many bytes; a larger one is folded: more lines are
#: then suspected, and the result is the same.
FILTER_BYTES = 64 << 20
#: Hashes that a task holds before it hands its bits on.
HELD = 1 << 20
#: Keys of repeated lines are broadcast if they have no more bytes than this; else they are joined.
KEY_BYTES = 32 << 20


def _lines(column: pa.Array):
    """Of a text column (null: empty): lower-cased bytes, and row, number, key's start and end, key's hash of every line."""
    data, offsets = common.byte_view(column)
    low = common.LOWER[data]
    ends = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, ends, "right") - 1
    first = np.sort(np.concatenate([offsets[:-1], ends + 1]), kind="stable")
    last = np.sort(np.concatenate([ends, offsets[1:]]), kind="stable")
    row = np.sort(np.concatenate([np.arange(len(offsets) - 1), row]), kind="stable")
    number = np.arange(len(row)) - np.searchsorted(row, np.arange(len(offsets) - 1))[row]
    start, end, _ = common.word_spans(data, offsets)
    a, b = np.searchsorted(start, first), np.searchsorted(start, last)
    inked = b > a
    begin, stop = first.copy(), first.copy()
    begin[inked], stop[inked] = start[a[inked]], end[b[inked] - 1]
    return low, row, number, begin, stop, common.span_hash(common.prefix_hash(low), begin, stop)


def _each_once(row: np.ndarray, key: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the first wanted line of each row and key."""
    at = np.flatnonzero(wanted)
    order = at[np.lexsort((at, key[at], row[at]))]
    new = np.ones(len(order), bool)
    new[1:] = (row[order[1:]] != row[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
    return order[new]


def _wanted(low, begin, stop, shortest: int) -> np.ndarray:
    """Lines whose keys have so many code points."""
    points = np.zeros(len(low) + 1, np.int64)
    np.cumsum((low & 0xC0) != 0x80, out=points[1:])
    return points[stop] - points[begin] >= shortest


def _positions(key: np.ndarray, bits: int, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and its two bits there (a column each)."""
    mask = np.uint64((1 << segment) - 1)
    own = (key >> np.uint64(64 - (bits - segment))).astype(np.int64) if bits > segment else np.zeros(len(key), np.int64)
    return own, np.stack([(key & mask), (common.mix64(key) & mask)], 1).astype(np.uint32)


def _marks(bits: int, segment: int, shortest: int):
    """A function from texts to rows of segment, bits seen, bits seen again."""

    def handed(keys):
        found, times = np.unique(np.concatenate(keys), return_counts=True)
        own, at = _positions(found, bits, segment)
        edges = np.flatnonzero(np.diff(own, prepend=-1))
        rows = []
        for i, j in zip(edges, np.append(edges[1:], len(own))):
            again = times[i:j] > 1
            rows.append((int(own[i]), np.unique(at[i:j]).tobytes(), np.unique(at[i:j][again]).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["segment", "seen", "again"])

    @common.frugal
    def run(batches):
        keys, held = [], 0
        for whole in batches:
            for batch in common.pieces(whole, "text"):
                low, row, _, begin, stop, key = _lines(batch.column("text"))
                once = _each_once(row, key, _wanted(low, begin, stop, shortest))
                if len(once):
                    keys.append(key[once])
                    held += len(once)
                if held > HELD:
                    yield handed(keys)
                    keys, held = [], 0
        if held:
            yield handed(keys)

    return run


def _merged(segment: int, folds: int):
    """A function from rows of segment, seen, again, in order of segments, to the packed bits seen again of each, folded."""

    def closed(own, again):
        for _ in range(folds):
            again = again[: len(again) // 2] | again[len(again) // 2 :]
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    def run(batches):
        own = None
        for batch in batches:
            for s, seen, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if s != own:
                    if own is not None:
                        yield closed(own, again)
                    own, once, again = s, np.zeros(1 << segment, bool), np.zeros(1 << segment, bool)
                at = np.frombuffer(seen, np.uint32)
                again[at[once[at]]] = True
                once[at] = True
                again[np.frombuffer(twice, np.uint32)] = True
        if own is not None:
            yield closed(own, again)

    return run


def _suspects(filtered, bits: int, segment: int, folds: int, shortest: int):
    """A function from id, text_hash, text to a row for each key of a document that may be in another one too."""
    room = 1 << (segment - folds)

    @common.frugal
    def run(batches):
        packed = np.frombuffer(filtered.value, np.uint8)
        for whole in batches:
            for batch in common.pieces(whole, "text"):
                low, row, number, begin, stop, key = _lines(batch.column("text"))
                once = _each_once(row, key, _wanted(low, begin, stop, shortest))
                own, at = _positions(key[once], bits, segment)
                place = own[:, None] * room + (at & np.uint32(room - 1))
                met = once[((packed[place >> 3] >> (place & 7)) & 1).all(1)]
                if not len(met):
                    continue
                # all lines of these rows and keys, in order
                order = np.lexsort((number, key, row))
                at = np.searchsorted(order_keys := _pairs(row[order], key[order]), pairs := _pairs(row[met], key[met]))
                upto = np.searchsorted(order_keys, pairs, "right")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(row[met])), batch.column("text_hash").take(pa.array(row[met])),
                        pa.array([low[a:b].tobytes().decode() for a, b in zip(begin[met], stop[met])], pa.string()),
                        pa.array([number[order[a:b]] for a, b in zip(at, upto)], pa.list_(pa.int32())),
                    ],
                    names=["id", "text_hash", "key", "numbers"],
                )

    return run


def _pairs(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Row and key as one value that sorts by both."""
    out = np.empty(len(row), [("row", np.int64), ("key", np.uint64)])
    out["row"], out["key"] = row, key
    return out


def suspected(rows: DataFrame, shortest: int = 1) -> DataFrame:
    """id, text_hash, key, numbers (of lines): a row for each key of a document that two documents may hold, from id, text_hash, text."""
    spark = rows.sparkSession
    n = rows.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1
    bits = max(SEGMENT[0], int(BITS * n - 1).bit_length())
    segment = min(SEGMENT[1], max(SEGMENT[0], bits - 10))
    folds = min(segment - 3, max(0, bits - (FILTER_BYTES * 8).bit_length() + 1))
    parts = rows.select("text").mapInArrow(_marks(bits, segment, shortest), "segment long, seen binary, again binary")
    dealt = parts.repartition("segment").sortWithinPartitions("segment")
    merged = dealt.mapInArrow(_merged(segment, folds), "segment long, bits binary")
    room = 1 << (segment - folds - 3)
    whole = bytearray(room << (bits - segment))
    for r in merged.collect():  # no more than FILTER_BYTES
        whole[r["segment"] * room : (r["segment"] + 1) * room] = r["bits"]
    return rows.mapInArrow(_suspects(spark.sparkContext.broadcast(bytes(whole)), bits, segment, folds, shortest), "id long, text_hash long, key string, numbers array<int>")


def _without(dropped: dict | None, keep: str):
    """A function from id, text_hash, text, gone (numbers of lines, or null) to id, n_lines, n_dropped, kept."""
    hashes = None

    def gone_by_key(batch):
        """Numbers of the lines that go, row by row, by the keys at hand."""
        nonlocal hashes
        if hashes is None:
            column = pa.array(list(dropped), pa.string())
            data, offsets = common.byte_view(column)
            hashes = np.sort(common.span_hash(common.prefix_hash(data), offsets[:-1], offsets[1:])) if len(column) else np.zeros(0, np.uint64)
        low, row, number, begin, stop, key = _lines(batch.column("text"))
        at = np.minimum(np.searchsorted(hashes, key), max(len(hashes) - 1, 0))
        met = np.flatnonzero(hashes[at] == key) if len(hashes) else ()
        ids, own, out, had = batch.column("id"), batch.column("text_hash"), {}, set()
        for i in met:
            line = low[begin[i] : stop[i]].tobytes().decode()
            if line in dropped:
                r = int(row[i])
                if keep == "first" and dropped[line] == (ids[r].as_py(), own[r].as_py()) and (r, line) not in had:
                    had.add((r, line))
                else:
                    out.setdefault(r, []).append(int(number[i]))
        return out

    @common.frugal
    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "text"):
                if dropped is not None:
                    gone = gone_by_key(batch)
                else:
                    gone = {i: x for i, x in enumerate(batch.column("gone").to_pylist()) if x}
                kept, lines = batch.column("text").to_pylist(), []
                for i, t in enumerate(kept):
                    lines.append(t.count("\n") + 1)
                    if i in gone:
                        out = set(gone[i])
                        kept[i] = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(lines, pa.int64()), pa.array([len(gone.get(i, ())) for i in range(len(lines))], pa.int64()), pa.array(kept, pa.string()), *batch.columns[4:]],
                    names=["id", "n_lines", "n_dropped", "kept", *batch.schema.names[4:]],
                )

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 10, shortest: int = 1, keep: str = "none", carry: tuple[str, ...] = (), key_bytes: int = KEY_BYTES) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, kept (the text without the dropped lines), and the carried columns
    (as carried_<name>).

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least `shortest` code points
    that at least `least` documents (rows, 2 or more) hold go: all their lines (keep="none"), or all but the first one of the document with
    the least id (keep="first"; rows without an id come last, equal ids follow a hash of the text, and rows that are
    equal in both are one place). Null and empty texts are one empty line, which has no code points. Texts and lines of any
    length are taken whole; repeated rows count and are returned each; other columns are not looked at; an empty table
    gives an empty result.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep!r}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    found = common.cut(suspected(rows.select("id", "text_hash", "text"), shortest), "suspects")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    counted = found.groupBy("key").agg(F.count("*").alias("n"), *([F.min(place).alias("place")] if keep == "first" else [])).where(F.col("n") >= max(2, least))
    repeated = common.cut(counted.drop("n"), "repeated")
    size = repeated.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    carried = "".join(f", carried_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"id long, n_lines long, n_dropped long, kept string{carried}"
    carried = [f"carried_{c}" for c in carry]
    if size <= key_bytes:
        dropped = {r["key"]: (r["place"]["id"], r["place"]["text_hash"]) if keep == "first" else None for r in repeated.collect()}
        out = rows.select("id", "text_hash", "text", F.lit(None).cast("array<int>").alias("gone"), *carried)
        return out.mapInArrow(_without(dropped, keep), schema)
    met = found.distinct().join(repeated, "key")  # equal rows are one place
    if keep == "first":
        own = F.col("place.id").eqNullSafe(F.col("id")) & (F.col("place.text_hash") == F.col("text_hash"))
        met = met.withColumn("numbers", F.when(own, F.slice("numbers", F.lit(2), F.size("numbers"))).otherwise(F.col("numbers")))
    gone = met.groupBy("id", "text_hash").agg(F.flatten(F.collect_list("numbers")).alias("gone"))
    r, g = rows.alias("r"), gone.alias("g")
    out = r.join(g, F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.text_hash") == F.col("g.text_hash")), "left")
    return out.select("r.id", "r.text_hash", "text", "gone", *carried).mapInArrow(_without(None, keep), schema)


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated r USING (k) GROUP BY doc_id
"""
