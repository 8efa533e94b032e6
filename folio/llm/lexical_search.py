"""Ranked lexical search by windowed bucket scoring.

Documents get running numbers task by task, and the index holds them in windows of WINDOW numbers:
for each term the documents of the window that hold it and how often. A search goes window by window. What a term
gives to each of its documents is worked out once; for each item these are scatter-added into an array of one
bucket a document, a bitset marks the occupied ones, and they are harvested into a heap of the item's best.
All numbers are integers, so that the result doesn't depend on how rows are dealt.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import common

#: Documents of a window at most (its scores, 64 KB, stay in a core's cache); one that holds WINDOW_BYTES of text is closed earlier.
WINDOW, WINDOW_BYTES = 8192, 16 << 20
#: Items are searched in blocks of about so many bytes of text; each block goes through all documents.
BLOCK_BYTES = 4 << 20
#: Best documents of one item are brought together in so many parts first.
PARTS = 64
#: Fixed values of the score.
LENGTH_SHARE, SATURATION, WEIGHT_UNIT, SCORE_UNIT = 90, 8, 1000, 1_000_000_000

INDEX_SCHEMA = "ids binary, no_id binary, lengths binary, terms binary, starts binary, docs binary, counts binary, n_docs long, n_terms long"


class Vocabulary(NamedTuple):
    """Terms of a block of items, sorted by hash: their hashes, their bytes end to end, where each begins."""

    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray


def _terms(column: pa.Array):
    """Lower-cased bytes of a text column (null: empty), and start, end, row of its terms."""
    data, offsets = common.byte_view(column)
    return common.LOWER[data], *common.word_spans(data, offsets, common.BETWEEN)


def terms_of(texts: list[str | None]) -> list[list[str]]:
    """The different terms of each text, sorted."""
    low, start, end, row = _terms(pa.array(texts, pa.string()))
    out: list[set[str]] = [set() for _ in texts]
    for a, b, r in zip(start, end, row):
        out[r].add(low[a:b].tobytes().decode())
    return [sorted(x) for x in out]


def _hashes(low, start, end) -> np.ndarray:
    return common.span_hash(common.prefix_hash(low), start, end)


def vocabulary(terms: list[str]) -> tuple[Vocabulary, dict[str, int]]:
    """Terms by hash, and the number of each. (Terms whose hashes are equal would be told apart by their bytes.)"""
    data, offsets = common.byte_view(pa.array(terms, pa.string()))
    own = _hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(own, kind="stable")
    raw = [terms[i].encode() for i in order]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return Vocabulary(own[order], np.frombuffer(b"".join(raw), np.uint8), starts), {terms[i]: k for k, i in enumerate(order)}


def _found(low, start, end, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that are terms of the vocabulary, and their numbers; bytes are compared, not hashes alone."""
    none = np.zeros(0, np.int64)
    if not len(words.hashes) or not len(start):
        return none, none
    key = _hashes(low, start, end)
    term = np.searchsorted(words.hashes, key)
    term[term == len(words.hashes)] = 0
    met = np.flatnonzero(words.hashes[term] == key)
    out, numbers = [none], [none]
    while len(met):
        own = term[met]
        size = end[met] - start[met]
        same = size == words.starts[own + 1] - words.starts[own]
        for width in np.unique(size[same]):
            at = np.flatnonzero(same & (size == width))
            span = np.arange(width)
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                same[part] = (low[start[met[part]][:, None] + span] == words.data[words.starts[own[part]][:, None] + span]).all(1)
        out.append(met[same])
        numbers.append(own[same])
        # the next term of an equal hash, should there be one
        rest = met[~same & (own + 1 < len(words.hashes))]
        rest = rest[words.hashes[term[rest] + 1] == key[rest]]
        term[rest] += 1
        met = rest
    return np.concatenate(out), np.concatenate(numbers)


def _windows(words, window: int):
    """A function from id, text to windows of the index."""

    def closed(rows):
        ids = pa.concat_arrays([r[0] for r in rows])
        lengths = np.concatenate([r[1] for r in rows])
        sizes = np.cumsum([0, *(len(r[1]) for r in rows)])
        doc = np.concatenate([r[2] + base for r, base in zip(rows, sizes)])
        term, count = (np.concatenate([r[k] for r in rows]) for k in (3, 4))
        order = np.argsort(term, kind="stable")  # documents of a term in order
        found, starts = np.unique(term[order], return_index=True)
        values = [
            ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), lengths, found.astype(np.int32),
            np.append(starts, len(order)).astype(np.int32), doc[order].astype(np.int32), count[order].astype(np.int64),
        ]
        numbers = [int((lengths > 0).sum()), int(lengths.sum())]
        names = [x.split(" ")[0] for x in INDEX_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([*(pa.array([v.tobytes()], pa.binary()) for v in values), *(pa.array([n], pa.int64()) for n in numbers)], names=names)

    @common.frugal
    def run(batches):
        rows, docs, held = [], 0, 0
        for whole in batches:
            for batch in common.pieces(whole, "text"):
                if docs and (docs + batch.num_rows > window or held > WINDOW_BYTES):
                    yield closed(rows)
                    rows, docs, held = [], 0, 0
                for at in range(0, batch.num_rows, window):
                    part = batch.slice(at, window)
                    if docs and docs + part.num_rows > window:
                        yield closed(rows)
                        rows, docs, held = [], 0, 0
                    low, start, end, row = _terms(part.column("text"))
                    at, term = _found(low, start, end, words.value)
                    pair, count = np.unique(row[at] * len(words.value.hashes) + term, return_counts=True)
                    size = max(len(words.value.hashes), 1)
                    rows.append((part.column("id"), np.bincount(row, minlength=part.num_rows).astype(np.int64), pair // size, pair % size, count))
                    docs += part.num_rows
                    held += len(low)
        if rows:
            yield closed(rows)

    return run


def _term_documents(batches):
    """Documents of each term, window by window."""
    for batch in batches:
        for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int32)), pa.array(np.diff(np.frombuffer(starts, np.int32)).astype(np.int64))], names=["term", "documents"])


def _best(items, weights, k: int, n: int, total: int):
    """A function from windows to the best k documents of each item among its task's."""
    length_factor = LENGTH_SHARE * n

    def run(batches):
        wanted, weight = items.value, weights.value
        heaps: list[list] = [[] for _ in wanted]
        for batch in batches:
            for w in batch.to_pylist():
                ids, lengths, counts = (np.frombuffer(w[c], np.int64) for c in ("ids", "lengths", "counts"))
                terms, starts, docs = (np.frombuffer(w[c], np.int32) for c in ("terms", "starts", "docs"))
                no_id = np.frombuffer(w["no_id"], np.uint8)
                size = 100 - LENGTH_SHARE + (length_factor * lengths) // max(total, 1)
                gives = (SCORE_UNIT * counts) // (WEIGHT_UNIT * counts + SATURATION * size[docs])
                buckets, occupied = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                for heap, own in zip(heaps, wanted):
                    at = np.searchsorted(terms, own)
                    there = at < len(terms)
                    at = at[there][terms[at[there]] == own[there]]
                    for t in at:
                        part = slice(starts[t], starts[t + 1])
                        buckets[docs[part]] += weight[terms[t]] * gives[part]
                        occupied[docs[part]] = True
                    met = np.flatnonzero(occupied)
                    score = buckets[met]
                    buckets[met], occupied[met] = 0, False
                    stay = score > 0 if len(heap) < k else score >= heap[0][0]
                    met, score = met[stay], score[stay]
                    if len(met) > k:  # all that are as good as the k-th
                        stay = score >= np.partition(score, len(score) - k)[len(score) - k]
                        met, score = met[stay], score[stay]
                    if len(met) > k:
                        order = np.lexsort((ids[met], no_id[met], -score))[:k]
                        met, score = met[order], score[order]
                    for d, s in zip(met, score):
                        # the least of a heap is the worst: lowest score, then no id, then the greatest id
                        entry = (int(s), -int(no_id[d]), -int(ids[d]))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        found = [(i, s, None if none else -d) for i, heap in enumerate(heaps) for s, none, d in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["item", "score", "id"])

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, k: int = 10, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, equal scores by rising id.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case; each of an item's terms counts
    once. Null and empty texts have no terms: such items give no rows, such documents don't count. Rows that repeat an
    item's id are items by themselves, rows that repeat a document's id are documents by themselves; documents
    without an id come after others of the same score. Texts of any length are taken whole; other columns are not looked
    at; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    if blocks > 1:  # the rows of a block are dealt by their text's hash
        asked = asked.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        own = (asked.where(F.col("block") == b) if blocks > 1 else asked).select("item_id", "text").collect()
        parts.append(_search_block(spark, rows, own, asked.schema["item_id"].dataType, k, window))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _search_block(spark, rows: DataFrame, items: list, item_type, k: int, window: int) -> DataFrame:
    found = terms_of([r["text"] for r in items])
    words, number = vocabulary(sorted(set().union(*found)) if found else [])
    sc = spark.sparkContext
    index = common.cut(rows.mapInArrow(_windows(sc.broadcast(words), window), INDEX_SCHEMA), "index")
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n, length = total["n"] or 0, total["l"] or 0
    # a row for each term of the block, however many documents there are
    df = index.select("terms", "starts").mapInArrow(_term_documents, "term int, documents long").groupBy("term").agg(F.sum("documents").alias("df")).collect()
    weights = np.zeros(len(number), np.int64)
    for r in df:
        weights[r["term"]] = math.floor(WEIGHT_UNIT * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    wanted = [np.sort(np.array([number[t] for t in x], np.int32)) for x in found]
    best = index.mapInArrow(_best(sc.broadcast(wanted), sc.broadcast(weights), k, n, length), "item long, score long, id long")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    best = best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    best = best.withColumn("turn", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("turn") <= k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], f"item long, item_id {item_type.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(common.read_table(spark, sf_dir, "documents", "doc_id", "text"), common.read_table(spark, sf_dir, "benchmark", "item_id", "text"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs),
m AS (SELECT doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM lengths, totals),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weights USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
