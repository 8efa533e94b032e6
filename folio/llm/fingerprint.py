"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

Each word of a text is a term; its weight is how often it occurs times its length, so that long
words tell more than short ones. For each of SAMPLES samples a term draws r and c from a
gamma distribution and b from a uniform one, all from hashes of the term; with
t = floor(ln w / r + b) the term with the least c / exp(r (t - b) + r) is the sample. Two
texts agree in a sample with a probability equal to their generalised Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import common

SAMPLES = 32
#: About so many documents, at most, of neighbouring ids are ordered together.
BUCKET = 1024
#: The densest of so many equal shares of the ids says how wide a bucket is.
SHARES = 200
_SPACE = r"[\x20\x09-\x0D]+"


def sample_value(term: str, weight: str, k: int) -> Column:
    """ln of what the k-th sample minimises; term: its 64-bit hash, weight: ln of the weight."""
    half = 2.0**-32
    uniform = lambda h, high: f"(({f'shiftrightunsigned({h}, 32)' if high else f'({h} & 4294967295)'} + 0.5D) * {half!r}D)"
    a, c, b = (f"xxhash64({term}, {3 * k + j}L)" for j in range(3))
    r = f"(-ln({uniform(a, True)} * {uniform(a, False)}))"
    ln_c = f"ln(-ln({uniform(c, True)} * {uniform(c, False)}))"
    beta = uniform(b, True)
    return F.expr(f"{ln_c} - {r} * (floor({weight} / {r} + {beta}) - {beta}) - {r}")


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and signature array<double>, from rows of keys, term (a 64-bit hash) and ln_weight, a row per term."""
    lows = [F.min(sample_value("term", "ln_weight", k)).alias(f"s{k}") for k in range(samples)]
    return terms.groupBy(*keys).agg(*lows).select(*keys, F.array(*[f"s{k}" for k in range(samples)]).alias("signature"))


def printed(signature: Column) -> Column:
    """Eight hexadecimal digits a sample; of a text without words the empty string."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.substring(F.lpad(F.lower(F.hex(F.xxhash64(x))), 16, "0"), 1, 8)), ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in which two printed fingerprints agree; two empty ones are alike."""
    same = sum((F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(samples))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / F.lit(float(samples)))


def bucketed(rows: DataFrame) -> DataFrame:
    """Adds bucket, a quotient of the id; its divisor follows the densest ids, so that sparse ids have
    small buckets and none is large."""
    marks = [i / SHARES for i in range(SHARES + 1)]
    found = rows.agg(F.percentile_approx("id", marks, 10_000).alias("marks"), F.count("*").alias("n")).first()
    width = min((b - a for a, b in zip(found["marks"], found["marks"][1:]) if b > a), default=1) if found["marks"] else 1
    divisor = max(1, int(BUCKET * width * SHARES / max(found["n"], 1)), BUCKET if found["n"] <= SHARES else 1)
    return rows.withColumn("bucket", F.expr(f"id div {divisor} - if(id < 0, 1, 0)"))


def _next_bucket(rows: DataFrame) -> DataFrame:
    """bucket and the next lower bucket that has documents (of the lowest: the highest): buckets are dealt by
    range, and the last window has a row for each partition."""
    buckets = rows.select("bucket").distinct().repartitionByRange("bucket")
    buckets = common.cut(buckets.withColumn("part", F.spark_partition_id()), "buckets")
    ends = buckets.groupBy("part").agg(F.max("bucket").alias("top"))
    below = ends.select("part", F.lag("top").over(Window.orderBy("part")).alias("below"), F.max("top").over(Window.partitionBy(F.lit(1))).alias("highest"))
    inside = Window.partitionBy("part").orderBy(F.col("bucket").desc())
    return buckets.withColumn("lower", F.lead("bucket").over(inside)).join(F.broadcast(below), "part").select("bucket", F.coalesce("lower", "below", "highest").alias("next_bucket"))


def with_next(rows: DataFrame, column: str) -> DataFrame:
    """Adds next_<column>: that of the row that follows in descending order of id, then key (of the last: of the first);
    rows: bucket, id, key and the column. Rows that repeat id and key are one; copies says how many they are."""
    order = [F.col("id").desc(), F.col("key")]
    # the first row of each bucket, found where the rows lie; only these few travel
    first = rows.groupBy("bucket").agg(F.min_by(column, F.struct(-F.col("id"), "key")).alias("head"))
    heads = _next_bucket(rows).join(first.select(F.col("bucket").alias("next_bucket"), "head"), "next_bucket").select(F.col("bucket").alias("b"), "head")
    line = Window.partitionBy("bucket").orderBy(*order)
    place = {"place": F.row_number().over(line), "before": F.lag(F.struct("id", "key")).over(line), "size": F.count("*").over(Window.partitionBy("bucket"))}
    once = rows.withColumns(place).where("before is null or before.id <> id or before.key <> key")
    led = once.withColumns({"lead": F.lead(column).over(line), "then": F.lead("place").over(line)})
    joined = led.join(heads, (F.col("bucket") == F.col("b")) & F.col("then").isNull(), "left")
    copies = (F.coalesce("then", F.col("size") + 1) - F.col("place")).alias("copies")
    return joined.select(*rows.columns, copies, F.when(F.col("then").isNull(), F.col("head")).otherwise(F.col("lead")).alias(f"next_{column}"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, samples: int = SAMPLES) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by as much of the next document's beginning,
    in descending order of ids; rows that repeat an id follow by a hash of their text, rows without an id come first,
    and rows that repeat both share their results. Null texts are empty; a text without words has an empty
    fingerprint; other columns are not looked at; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bucketed(docs.select(common.row_id(id_col, text_col).alias("id"), F.xxhash64(text).alias("key"), F.col(id_col).cast("long").alias("given"), text.alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    pairs = with_next(rows, "text").withColumn("edited", edited)
    # all that both branches need goes along in both, so that texts are dealt out once
    place = ["bucket", "id", "key", "given"]
    facts = pairs.select(*place, "copies", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    words = pairs.select(*place, F.explode(kinds).alias("x")).select(*place, "x.kind", F.explode(F.split("x.t", _SPACE)).alias("word")).where("word <> ''")
    terms = words.select(*place, "kind", F.xxhash64("word").alias("term"), F.length("word").alias("size")).groupBy(*place, "kind", "term", "size").agg(F.count("*").alias("n"))
    signed = signatures(terms.withColumn("ln_weight", F.expr("ln(double(n * size))")), [*place, "kind"], samples)
    signed = signed.withColumn("f", printed(F.col("signature")))
    # put together by a union: a join would tell one branch that keys aren't null and deal the texts twice
    shown = {"copies": "long", "n_chars": "long", "edited_sha256": "string", "kind": "int", "f": "string"}
    column = lambda df, c, t: (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
    rowed = [df.select(*place, *[column(df, c, t) for c, t in shown.items()]) for df in (facts, signed)]
    one = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("f"))), F.lit(""))
    both = rowed[0].union(rowed[1]).groupBy(*place).agg(
        *[F.max(c).alias(c) for c in ("copies", "n_chars", "edited_sha256")], one(0).alias("fingerprint"), one(1).alias("edited_fingerprint")
    )
    both = common.cut(both, "fingerprints")
    a, b, c = (F.col(x) for x in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    out = with_next(both.withColumnRenamed("copies", "rows"), "fingerprint").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows").cast("long"))))
    return out.select(
        F.col("given").alias("id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(a, b, samples).alias("near_edited"), likeness(a, c, samples).alias("near_next")
    )


def op6_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint(common.read_table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")
