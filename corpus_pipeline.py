"""The corpus pipeline: rules, near copies, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bagminhash, common, packing, quality_rules, secret_scan, suffix_dedup
from folio.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents, and row_key, a hash of them all; ids may be null or repeated."""
    return docs.select(COLUMNS).withColumn("row_key", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in COLUMNS]))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts go; rows without an id, with a repeated
    one and repeated rows are judged one by one; an empty table stays empty."""
    ship_package(spark)
    judged = quality_rules.quality_rules(docs, carry=tuple(COLUMNS))
    return judged.where("kept").select(*[F.col(f"carried_{c}").alias(c) for c in COLUMNS])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays (one without an id if none has any); of rows that
    are equal in all columns one stays. Texts without words are no copies of each other; an empty table stays empty."""
    ship_package(spark)
    docs = _keyed(docs)
    classes = common.cut(bagminhash.near_duplicates(docs, "row_key").withColumnRenamed("id", "row_key"), "classes")
    ids = docs.select("row_key", "doc_id").join(classes.distinct(), "row_key")
    kept = ids.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("m")).select("m.row_key")
    gone = common.few(classes.select("row_key").distinct().join(kept, "row_key", "left_anti"), "gone")
    left = docs.join(gone, "row_key", "left_anti")
    twice = common.few(classes.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key"), "twice")
    once = left.join(twice, "row_key", "left_anti").select(COLUMNS)
    return once.union(left.join(twice, "row_key", "left_semi").select(COLUMNS).dropDuplicates(COLUMNS))


def passage_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that an earlier place has are cut out; the first stays. Null texts become empty;
    rows without an id come last; an empty table stays empty."""
    ship_package(spark)
    left = suffix_dedup.remove_repeats(docs, keep="first", carry=("lang", "source"))
    return left.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark. Null texts stay null; rows without an id, with a repeated one and repeated rows
    are each searched by themselves; an empty table stays empty."""
    ship_package(spark)
    docs = _keyed(docs)
    found = secret_scan.scan(docs, "row_key").where(F.size("spans") > 0).groupBy("id").agg(F.max("spans").alias("spans"))
    met = docs.join(common.few(found.withColumnRenamed("id", "row_key"), "found"), "row_key", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secret_scan.redact(F.col("text"), F.col("spans")))
    return met.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences; null and empty texts are their end id alone, rows without an id keep
    the null, repeated rows are packed each; an empty table gives no piece."""
    ship_package(spark)
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", passage_dedup_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]
#: Tokenisers, signatures and suffix arrays are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a written table, read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
