"""MinHash near-deduplication of multisets: BagMinHash signatures, bands, exact verification.

A text is a multiset of word shingles. An element of weight w owns the strip (0, w] of a
weight axis that is divided at 1, 2, 4, 8, ...; each division carries a Poisson process in
time whose points fall uniformly on it, halved step by step until the part inside (0, w]
is found. Every point goes to one slot of the signature, and each slot keeps its first
point. Two multisets agree in a slot with a probability equal to their weighted Jaccard
similarity. Points come in order of time, so that only about m ln m of a text are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 4
#: In buckets of at most so many different texts all pairs are looked at; in larger ones stars.
SMALL = 4
#: Star rounds, with another centre each; the last one compares the rest of a bucket exactly instead.
STARS = 2
#: What texts share with other classes is counted in so many parts.
PARTS = 64
#: Bytes of texts that are signed at once.
CHUNK = 1 << 20


def bags(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle hash and count of every different shingle; rows come in order.

    A text of fewer words than the width is one shingle of all its words."""
    start, end, row = common.word_spans(data, offsets)
    word = common.span_hash(common.prefix_hash(data), start, end)
    h = common.window_hash(word, row, width)
    at = np.flatnonzero(row[: len(h)] == row[width - 1 :]) if len(h) else np.zeros(0, np.int64)
    shingle, of = h[at], row[at]
    n = np.bincount(row, minlength=len(offsets) - 1)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = n[short] > j
            extra[has] = common.mix64(extra[has] * np.uint64(31) + word[first[has] + j])
        shingle, of = np.concatenate([shingle, extra]), np.concatenate([of, short])
    order = np.lexsort((shingle, of))
    shingle, of = shingle[order], of[order]
    if not len(of):
        return of, shingle, np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])]))
    return of[edge], shingle[edge], np.diff(np.append(edge, len(of)))


def bag_hash(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """A hash of each row's multiset; sums do not depend on order."""
    total = np.zeros(rows, np.uint64)
    np.add.at(total, row, common.mix64(common.mix64(shingle + np.uint64(0xC2B2AE3D27D4EB4F) * count.astype(np.uint64)) + np.uint64(salt)))
    return total.view(np.int64)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """rows x slots: bits of the first point's time in each slot; rows without elements are all infinite."""
    out = np.full((rows, slots), np.inf)
    weight = np.bincount(row, weights=count, minlength=rows)
    todo = weight > 0
    horizon = slots * (np.log(slots) + 2.5) / np.maximum(weight, 1)
    with np.errstate(over="ignore"):
        while todo.any():
            mine = todo[row]
            of, element, w = row[mine], shingle[mine], count[mine]
            level = 0
            while len(of):
                size = 1.0 if level == 0 else 2.0 ** (level - 1)
                low = 0.0 if level == 0 else 2.0 ** (level - 1)
                seed = common.mix64(element + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
                alive, time, step = np.arange(len(of)), np.zeros(len(of)), 0
                limit = horizon[of]
                while len(alive):
                    h = common.mix64(seed[alive] + np.uint64(0xD1342543DE82EF95) * np.uint64(step + 1))
                    time = time - np.log(_uniform(h)) / size
                    near = time <= limit[alive]
                    alive, time, h = alive[near], time[near], h[near]
                    inside = np.ones(len(alive), bool)
                    if level:  # where on the division the point falls
                        inside = low + size * _uniform(common.mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))) <= w[alive]
                    slot = (common.mix64(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(slots)).astype(np.int64)
                    np.minimum.at(out, (of[alive[inside]], slot[inside]), time[inside])
                    step += 1
                level += 1
                more = w > (1 if level == 1 else 2 ** (level - 1))
                of, element, w = of[more], element[more], w[more]
            todo &= np.isinf(out).any(axis=1)
            horizon[todo] *= 2
    return out.view(np.uint64)


def _signed(width: int, bands: int, rows: int):
    @common.frugal
    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "text", CHUNK):
                n = batch.num_rows
                row, shingle, count = bags(*common.byte_view(batch.column(1)), width)
                signature = signatures(row, shingle, count, n, bands * rows)
                band = np.zeros((n, bands), np.uint64)
                for j in range(rows):
                    band = common.mix64(band * np.uint64(0x9E3779B97F4A7C15) + signature[:, j::rows] + np.arange(bands, dtype=np.uint64)[None] * np.uint64(7919))
                hashes = [pa.array(bag_hash(row, shingle, count, n, salt)) for salt in (1, 2)]
                size = np.bincount(row, weights=count, minlength=n).astype(np.int64)
                values = pa.array(np.ascontiguousarray(band).view(np.int64).ravel())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), values)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *hashes, pa.array(size), listed], names=["id", "given", "text_hash", "bag1", "bag2", "size", "bands"])

    return run


def jaccard(a: pa.Array, b: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingle multisets of two columns, row by row."""
    n = len(a)
    parts = [bags(*common.byte_view(x), width) for x in (a, b)]
    sums = [np.bincount(r, weights=c, minlength=n) for r, _, c in parts]
    row = np.concatenate([parts[0][0], parts[1][0]])
    shingle = np.concatenate([parts[0][1], parts[1][1]])
    count = np.concatenate([parts[0][2], parts[1][2]])
    order = np.lexsort((shingle, row))
    row, shingle, count = row[order], shingle[order], count[order]
    both = np.flatnonzero((row[1:] == row[:-1]) & (shingle[1:] == shingle[:-1]))
    common_weight = np.bincount(row[both], weights=np.minimum(count[both], count[both + 1]), minlength=n)
    union = sums[0] + sums[1] - common_weight
    return np.where(union > 0, common_weight / np.maximum(union, 1), 0.0)


def _verified(width: int, similarity: float):
    @common.frugal
    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "a"):
                good = pa.array(jaccard(batch.column(2), batch.column(3), width) >= similarity - 1e-12)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), good], names=["u", "v", "linked"])

    return run


def _elements(width: int):
    """The elements of the texts of nodes."""

    @common.frugal
    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "text", CHUNK):
                row, shingle, count = bags(*common.byte_view(batch.column(2)), width)
                bag = batch.column(1).to_numpy()
                node = batch.column(0).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(bag[row]), pa.array(shingle.view(np.int64)), pa.array(count.astype(np.int64))], names=["node", "bag1", "shingle", "weight"])

    return run


def shared_sizes(elements: DataFrame, nodes: DataFrame, least: float = 0.0) -> DataFrame:
    """node, bag1, reach and parts of the nodes (node, class) with these elements: reach is the
    weight of the elements that a node of another class has too, parts the same by hash of the element;
    only those whose reach is at least this share of their weight.

    What two nodes of different classes have in common is at most the sum of the lesser parts,
    which rules pairs out exactly."""
    named = elements.join(nodes.distinct(), "node")
    held = named.groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.min(F.struct("node", "bag1", "weight")).alias("e")).where("lo = hi")
    once = held.where("n = 1").select("e.node", "e.bag1", "shingle", "e.weight")
    within = named.join(held.where("n > 1").select("shingle"), "shingle", "left_semi").select("node", "bag1", "shingle", "weight")
    count = lambda rows, sign: rows.select("node", "bag1", F.expr(f"cast(pmod(shingle, {PARTS}) as int)").alias("part"), F.col("weight").alias("size"), (F.col("weight") * sign).alias("reach"))
    both = count(named, 1).union(count(once.union(within), -1).withColumn("size", F.lit(0).cast("long")))
    parts = both.groupBy("node", "bag1", "part").agg(F.sum("size").alias("size"), F.sum("reach").alias("reach"))
    each = parts.groupBy("node", "bag1").agg(F.sum("size").alias("size"), F.sum("reach").alias("reach"), F.map_from_entries(F.collect_list(F.struct("part", "reach"))).alias("m"))  # PARTS entries at most
    return each.where(f"reach >= {least - 1e-9!r} * size").select("node", "bag1", "reach", F.expr(f"transform(sequence(0, {PARTS - 1}), p -> coalesce(m[p], 0L))").alias("parts"))


def components(edges: DataFrame) -> DataFrame:
    """node and class (its component's least node) of all nodes of the edges (u, v).

    Each round a node takes the least label around it and then its label's label."""
    links = common.cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = common.cut(links.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("class")), "labels")
    while True:
        around = links.join(labels.select(F.col("node").alias("v"), "class"), "v").groupBy("u").agg(F.min("class").alias("near"))
        lower = labels.join(around, labels["node"] == around["u"]).select("node", "class", F.least("class", "near").alias("low"))
        jumps = labels.select(F.col("node").alias("low"), F.col("class").alias("next"))
        moved = common.cut(lower.join(jumps, "low").select("node", F.col("class").alias("old"), F.least("low", "next").alias("class")), "labels")
        common.discard(labels)
        labels = moved.select("node", "class")
        if moved.where("old <> class").isEmpty():
            common.discard(links)
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id and class_id of every row: classes are the components of the links, texts whose
    weighted Jaccard similarity over shingles is at least `similarity`; class_id is the
    least id of the class.

    Texts with equal multisets are one node, whatever their ids, so copies are never expanded into pairs. Null,
    empty and wordless texts are alone. Texts of any length are taken whole; equal likeness needs no tie-break, since all links
    count. Each row that repeats an id has the class of its own text; other columns are
    not looked at; an empty table gives an empty result. Rows without an id keep the null; a class of none
    but such rows has a number from 2**62 up.
    """
    texts = docs.select(common.row_id(id_col, text_col).alias("id"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("given"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    signed = common.cut(texts.mapInArrow(_signed(width, bands, rows), "id long, given long, text_hash long, bag1 long, bag2 long, size long, bands array<long>"), "signatures")
    full = signed.where("size > 0")
    nodes = full.groupBy("bag1", "bag2").agg(F.min(F.struct("id", "text_hash")).alias("stands"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    # nodes are numbered as they are written; a node's text is that of its least id
    nodes = common.cut(nodes.select(F.monotonically_increasing_id().alias("node"), "bag1", "bag2", F.col("stands.id").alias("id"), F.col("stands.text_hash").alias("text_hash"), "size", "bands"), "nodes")
    members = nodes.select("node", "bag1", "size", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1")
    met = common.cut(members.join(sizes, "bucket"), "buckets")  # only what shares a bucket

    def texts_of(asked: DataFrame) -> DataFrame:
        """node, bag1, text of some nodes; rows that repeat id and text give it as often."""
        places = common.few(nodes.join(asked.select("node").distinct(), "node").select("node", "bag1", "id", "text_hash"), "asked")
        return texts.select("id", "text_hash", "text").join(places, ["id", "text_hash"]).select("node", "bag1", "text")

    def tested(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (u, v) the links."""
        pairs = common.cut(pairs.distinct(), "pairs")
        needed = common.cut(texts_of(pairs.select(F.explode(F.array("u", "v")).alias("node"))).select("node", "text"), "texts")  # only these texts travel
        first = pairs.join(needed.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
        second = first.join(needed.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
        return common.cut(second.select("u", "v", "a", "b").mapInArrow(_verified(width, similarity), "u long, v long, linked boolean").where("linked").select("u", "v"), "links")

    def met_in_bucket(left: DataFrame, right: DataFrame, condition: str) -> DataFrame:
        """Pairs of a bucket under a condition; what they can share at all rules many out."""
        least = f"{similarity / (1 + similarity) - 1e-9!r} * (a.size + b.size)"
        near = f"a.bucket = b.bucket and {condition} and least(a.reach, b.reach) >= {least}"
        if "parts" in left.columns:
            near += f" and aggregate(zip_with(a.parts, b.parts, (x, y) -> least(x, y)), 0L, (x, y) -> x + y) >= {least}"
        near = F.expr(near)
        return left.alias("a").join(right.alias("b"), near).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))

    met = met.withColumn("reach", F.col("size"))
    small = met.where(f"n <= {SMALL}")
    large = met.where(f"n > {SMALL}").select("bucket", "node", "bag1", "size", "reach")
    centre = large.groupBy("bucket").agg(F.min(F.struct("node", "size", "reach")).alias("c")).select("bucket", "c.*")
    links = tested(met_in_bucket(small, small, "a.node < b.node").union(met_in_bucket(large, centre, "a.node <> b.node")))
    classes = components(links)

    def still_open(large: DataFrame) -> DataFrame:
        """Members, with their class, of the buckets whose texts are not yet of one class."""
        named = large.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
        open_ = named.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("bucket")
        return common.cut(named.join(open_, "bucket"), "open")

    elements = None
    for turn in range(1, STARS + 1):
        large = still_open(large)
        if large.isEmpty():
            break
        asked = large.select("node", "class").distinct()
        if elements is None:
            # rows that repeat a node's text count once
            elements = common.cut(texts_of(asked).mapInArrow(_elements(width), "node long, bag1 long, shingle long, weight long").distinct(), "elements")
        # a text with too much that no other class has is linked to none of them
        reach = common.cut(shared_sizes(elements, asked, similarity), "reach")
        large = still_open(large.select("bucket", "node", "bag1", "size").distinct().join(reach, ["node", "bag1"]))
        if turn < STARS:  # another centre: first the member with the least of its own, then the one of least hash
            rank = F.struct((F.col("size") - F.col("reach")) / F.col("size"), "size") if turn == 1 else F.struct(F.xxhash64("node", F.lit(turn)))
            centre = large.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), "node", "size", "reach", "class", "parts")).alias("c"))
            other = centre.select("bucket", "c.node", "c.size", "c.reach", "c.class", "c.parts")
        else:  # those outside a bucket's largest class against all of other classes in it
            held = large.groupBy("bucket", "class").agg(F.count("*").alias("n"))
            most = held.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("m")).select("bucket", F.col("m.class").alias("main"))
            other = large.join(most, "bucket").where("class <> main").drop("main")
        found = tested(met_in_bucket(large, other, "a.class <> b.class"))
        large = large.drop("class")
        if not found.isEmpty():
            links = links.union(found)
            classes = components(links)
    least = classes.join(nodes.select("node", "id"), "node").groupBy("class").agg(F.min("id").alias("least"))
    named = nodes.join(classes.join(least, "class"), "node", "left").select("bag1", "bag2", F.coalesce("least", "id").alias("class_id"))
    out = full.select("given", "bag1", "bag2").join(named, ["bag1", "bag2"]).select(F.col("given").alias("id"), "class_id")
    return out.union(signed.where("size = 0").select(F.col("given").alias("id"), F.col("id").alias("class_id")))


def op5_bagminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")
