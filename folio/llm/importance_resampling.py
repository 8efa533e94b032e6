"""Importance resampling towards a target text: word runs in hashed buckets, a gain a bucket.

Long texts are cut at word boundaries into chunks, which tasks share. A chunk owns the words that begin in it, and
carries the next n - 1 words on, so that each run of up to n words is counted once, by the chunk where it begins.
What chunks count is summed by document. The sample adds Gumbel noise from the document's id, so that the highest
scores are a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import common

BUCKETS, RUN, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Texts of more bytes are cut into chunks of about so many.
CHUNK = 1 << 16
#: Words of at most so many bytes have their checksums worked out together, others one by one.
SHORT_WORD = 48


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reflected polynomial)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()


def _zero_tables(longest: int) -> np.ndarray:
    """[n, j, b]: what a register with byte b at place j is after n zero bytes; it is linear, so that places add by xor."""
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for j in range(4):
        out[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for n in range(longest):
        out[n + 1] = _TABLE[out[n] & 255] ^ (out[n] >> np.uint32(8))
    return out


_ZEROS = _zero_tables(SHORT_WORD)


def word_crc(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span."""
    size = end - start
    order = np.argsort(-np.minimum(size, SHORT_WORD + 1), kind="stable")
    s, n = start[order], size[order]
    crc = np.full(len(s), 0xFFFFFFFF, np.uint32)
    longer = int(np.searchsorted(-n, -SHORT_WORD, "left"))  # spans beyond SHORT_WORD come first
    upto = len(s)
    for j in range(int(n[longer]) if longer < len(n) else 0):
        upto = int(np.searchsorted(-n, -j, "left"))  # those of more than j bytes
        part = crc[longer:upto]
        crc[longer:upto] = _TABLE[(part ^ low[s[longer:upto] + j]) & 255] ^ (part >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(longer):
        crc[i] = zlib.crc32(low[s[i] : s[i] + n[i]].tobytes())
    out = np.empty(len(s), np.uint32)
    out[order] = crc
    return out


def joined_crc(crc: np.ndarray, next_crc: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of texts with these checksums followed by a space and the spans (with checksums next_crc)."""
    register = crc ^ np.uint32(0xFFFFFFFF)
    spaced = _TABLE[(register ^ np.uint32(32)) & 255] ^ (register >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
    size = end - start
    short = np.minimum(size, SHORT_WORD)
    out = next_crc.copy()
    for j in range(4):
        out ^= _ZEROS[short, j, (spaced >> np.uint32(8 * j)) & 255]
    for i in np.flatnonzero(size > SHORT_WORD):
        out[i] = zlib.crc32(low[start[i] : end[i]].tobytes(), int(spaced[i]))
    return out


def features(column: pa.Array, owned: np.ndarray | None = None, run: int = RUN, buckets: int = BUCKETS):
    """Row and bucket of every run of 1 to `run` words, and row of every word, of those that begin in the first owned bytes of
    their row (None: anywhere)."""
    data, offsets = common.byte_view(column)
    low = common.LOWER[data]
    start, end, row = common.word_spans(data, offsets, common.BETWEEN)
    mine = np.ones(len(start), bool) if owned is None else start - offsets[:-1][row] < owned[row]
    crc = word_crc(low, start, end)
    rows, found, whole = [row[mine]], [crc[mine] % buckets], crc
    for k in range(1, run):
        whole = joined_crc(whole[: len(start) - k], crc[k:], low, start[k:], end[k:])
        own = (row[k:] == row[: len(row) - k]) & mine[: len(row) - k] if len(row) > k else np.zeros(0, bool)
        whole = whole[: len(own)]
        rows.append(row[: len(own)][own])
        found.append(whole[own] % buckets)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), rows[0]


def _cut(text: bytes, chunk: int, run: int):
    """Chunks of a text with the bytes that each owns: cut where no word is, with the next run - 1 words carried on."""
    data = np.frombuffer(text, np.uint8)
    start, end, _ = common.word_spans(data, np.array([0, len(data)]), common.BETWEEN)
    begin = 0
    while begin < len(data):
        # the first word that begins a chunk's length on is the next chunk's first
        after = int(np.searchsorted(start, begin + chunk, "left"))
        upto = int(start[after]) if after < len(start) else len(data)
        last = min(after + run - 1, len(end)) - 1
        stop = max(upto, int(end[last])) if after < len(start) else len(data)
        yield text[begin:stop], upto - begin
        begin = upto


def _chunks(chunk: int, run: int):
    """A function from key, copy, text to key, copy, owned, text of chunks."""

    def go(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for text, owned in _cut(batch.column("text")[i].as_buffer().to_pybytes(), chunk, run):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("id", "text_hash")), pa.array([owned], pa.int64()), pa.array([text.decode()], pa.string())], names=["id", "text_hash", "owned", "text"])

    return go


def chunked(rows: DataFrame, chunk: int = CHUNK, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """Short rows as they are and the chunks of long ones, dealt out: id, text_hash, owned, text."""
    size = F.octet_length("text")
    long = rows.where(size > chunk).select("id", "text_hash", "text").mapInArrow(_chunks(chunk, run), "id long, text_hash long, owned long, text string")
    return rows.where(size <= chunk).withColumn("owned", F.octet_length("text").cast("long")), long.repartition(F.xxhash64("id", "text_hash", "text"))


def _counts(run: int, buckets: int):
    """A function from owned, text to bucket, n: a task's features in each bucket."""

    @common.frugal
    def go(batches):
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in common.pieces(whole, "text"):
                owned = batch.column("owned").to_numpy(zero_copy_only=False)
                total += np.bincount(features(batch.column("text"), owned, run, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return go


def bucket_counts(parts: list[DataFrame], run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket."""
    out = np.zeros(buckets, np.int64)
    both = [p.select("owned", "text").mapInArrow(_counts(run, buckets), "bucket int, n long") for p in parts]
    rows = both[0]
    for x in both[1:]:
        rows = rows.union(x)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many rows as buckets
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target."""
    b, t, s = len(target), int(target.sum()), int(source.sum())
    ratio = [((int(x) + 1) * (s + b)) / ((int(y) + 1) * (t + b)) for x, y in zip(target, source)]
    return np.floor(1000 * np.log(np.array(ratio))).astype(np.int64)


def _weighed(gain, run: int):
    """A function from id, text_hash, owned, text to id, text_hash, n_words, n_features, gain (their sum)."""

    @common.frugal
    def go(batches):
        gains = gain.value
        for whole in batches:
            for batch in common.pieces(whole, "text"):
                n = batch.num_rows
                row, bucket, words = features(batch.column("text"), batch.column("owned").to_numpy(zero_copy_only=False), run, len(gains))
                total = np.zeros(n, np.int64)
                np.add.at(total, row, gains[bucket])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("text_hash"), *(pa.array(x.astype(np.int64)) for x in (np.bincount(words, minlength=n), np.bincount(row, minlength=n), total))],
                    names=["id", "text_hash", "n_words", "n_features", "gain"],
                )

    return go


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the id (null: as the empty text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds place: 1, 2, 3... over all rows. They are dealt by range; each part numbers its own after what parts before it hold."""
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = common.cut(dealt, "ranked")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("own", own).join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("own")).drop("own", "before", "part")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", *, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: id, n_words, n_features, weight, score, rank (1, 2, 3... of the drawn rows; null of others).

    Features are the runs of 1 to `run` words; a feature's bucket is its CRC-32 modulo `buckets`. weight is the floored mean
    gain of a row's features (0 without any), score the weight plus noise from the id. Of the rows with at least `least_words`
    words, `percent` in a hundred are drawn: the highest scores, ties by rising id (rows without an id last, then by a hash of the
    text). Null and empty texts have no words and weight 0; very long texts are taken whole, in chunks; repeated
    rows count, score and are drawn each; other columns are not looked at; an empty table gives an empty result, an
    empty target counts as one without features.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    wanted = target.select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("text_hash"), F.coalesce(F.col(target_col), F.lit("")).alias("text"))
    short, long = chunked(rows, chunk, run)
    gain = gains(bucket_counts(list(chunked(wanted, chunk, run)), run, buckets), bucket_counts([short, long], run, buckets))
    weigh = _weighed(spark.sparkContext.broadcast(gain), run)
    schema = "id long, text_hash long, n_words long, n_features long, gain long"
    whole = short.select("id", "text_hash", "owned", "text").mapInArrow(weigh, schema)
    # chunks of rows that are equal in id and text are summed together, and dealt to so many rows again
    copies = rows.where(F.octet_length("text") > chunk).groupBy("id", "text_hash").agg(F.count("*").alias("copies"))
    sums = long.mapInArrow(weigh, schema).groupBy("id", "text_hash").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    c, s = copies.alias("c"), sums.alias("s")
    met = s.join(c, F.col("s.id").eqNullSafe(F.col("c.id")) & (F.col("s.text_hash") == F.col("c.text_hash")))
    each = met.select("s.id", "s.text_hash", *[F.expr(f"s.{x} div copies").alias(x) for x in ("n_words", "n_features", "gain")], F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("turn")).drop("turn")
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("gain") / F.col("n_features")).cast("long"))
    scored = whole.union(each).withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    # a number of each row, fixed by being written, so that equal rows can be dealt apart
    scored = common.cut(scored.withColumns({"fits": F.col("n_words") >= least_words, "line": F.monotonically_increasing_id()}), "scored")
    drawn = F.lit(percent) * scored.where("fits").count() / 100
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("text_hash"), F.col("line")]
    rank = F.when(F.col("fits") & (F.col("place") <= F.floor(drawn)), F.col("place").cast("long"))
    return ranked(scored, order).select("id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    out = resample(common.read_table(spark, sf_dir, "documents", "doc_id", "text"), common.read_table(spark, sf_dir, "benchmark", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def _crc_sql() -> str:
    """Tables bytes(b, crc) of single bytes, and crcs(f, bucket) of the features in fs(f)."""
    steps = "c0 AS (SELECT range AS b, range::BIGINT AS c FROM range(256)), "
    steps += "".join(f"c{k + 1} AS (SELECT b, {_STEP.format('c')} AS c FROM c{k}), " for k in range(8))
    steps += "crc_table AS (SELECT list(c ORDER BY b) AS t FROM c8), "
    folded = "list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)"
    return steps + f"crcs AS (SELECT f, xor({folded}, 4294967295) % {BUCKETS} AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM fs), crc_table)"


ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), q AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, unnest({_RUNS}) AS f FROM d), qf AS (SELECT unnest({_RUNS}) AS f FROM q),
fs AS (SELECT f FROM df UNION SELECT f FROM qf), {_crc_sql()},
s AS (SELECT bucket, count(*) AS n FROM df JOIN crcs USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM qf JOIN crcs USING (f) GROUP BY bucket),
gains AS (SELECT b AS bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT sum(n)::BIGINT FROM s) + {BUCKETS}))::DOUBLE / ((coalesce(s.n, 0) + 1) * (coalesce((SELECT sum(n)::BIGINT FROM t), 0) + {BUCKETS}))))::BIGINT AS gain
  FROM range({BUCKETS}) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
sums AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS gain FROM df JOIN crcs USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
noisy AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE floor(gain::DOUBLE / n_features)::BIGINT END AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN sums USING (doc_id)),
scored AS (SELECT *, weight + noise AS score, CASE WHEN n_words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY weight + noise DESC, doc_id) END AS place FROM noisy)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM d WHERE len(w) >= {LEAST_WORDS}) // 100 THEN place END AS rank FROM scored
"""
