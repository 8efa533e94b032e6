"""Quality rules: word counts, repetition, and the fertility of two public vocabularies.

Fertility, of a piece vocabulary and of one of lower-case words: code points per token, share of
byte-fallback tokens (of the word vocabulary: of tokens that are a lone byte of a character) and
entropy of the tokens (bits, over the logarithm of their number). Each language (rows without one:
each script) has its own rejection bands, one for each doubling of the length, set by the quartiles
of all its different documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import common, packing, pieces

#: A band reaches so many times the distance of the quartiles beyond them ("far out" in a box plot),
SPREAD = 3
#: and at least this share of the median for code points per token, and this much for shares and entropies.
LEAST_RATIO, LEAST_SHARE, LEAST_ENTROPY = 0.05, 0.02, 0.05
#: Quartiles are exact on a grid of this step.
GRID = 0.001
#: Bytes of texts that share the search for their different words.
CHUNK = 1 << 20
#: Bands that may be broadcast: a few for each language or script.
MOST_BANDS = 100_000
#: What bands are set for: the least reach beyond the quartiles, whether low and whether high values fail.
MEASURES = {
    "chars_per_token": (f"{LEAST_RATIO} * mid_chars_per_token", True, True),
    "byte_share": (f"{LEAST_SHARE}", False, True),
    "entropy": (f"{LEAST_ENTROPY}", True, False),
    "word_chars_per_token": (f"{LEAST_RATIO} * mid_word_chars_per_token", True, True),
    "word_byte_share": (f"{LEAST_SHARE}", False, True),
    "word_entropy": (f"{LEAST_ENTROPY}", True, False),
}

SCHEMA = (
    "id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_tokens long, chars_per_token double, byte_share double, entropy double, n_word_tokens long, word_chars_per_token double,"
    " word_byte_share double, word_entropy double, script string"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Lead bytes of UTF-8 by the scripts they begin (coarse, but enough to choose a band).
_SCRIPTS = (("latin", range(0x41, 0x7B)), ("latin", range(0xC3, 0xCA)), ("greek", range(0xCD, 0xD0)), ("cyrillic", range(0xD0, 0xD4)), ("semitic", range(0xD6, 0xDC)), ("south asian", range(0xE0, 0xE1)), ("east asian", range(0xE3, 0xEE)))


def repeated_words(word: np.ndarray, row: np.ndarray, rows: int, width: int = 8) -> np.ndarray:
    """For each row, the words inside windows of `width` words that are found twice or more in the row."""
    h = common.window_hash(word, row, width)
    out = np.zeros(rows, np.int64)
    if not len(h):
        return out
    at = np.flatnonzero(row[: len(h)] == row[width - 1 :])
    key = common.mix64(h[at] ^ common.mix64(row[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(row[covered], minlength=rows)


def fertility(ids: np.ndarray, tokens: np.ndarray, chars: np.ndarray, fallback: np.ndarray) -> list[np.ndarray]:
    """Tokens, code points per token, share of fallback tokens and entropy of each row. ids: those of all rows end to
    end; tokens, chars: numbers of each row; fallback: whether an id is a byte's."""
    n, size = len(tokens), len(fallback)
    of = np.repeat(np.arange(n), tokens)
    lone = np.bincount(of[fallback[ids]], minlength=n)
    key = np.sort(of * size + ids)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(key))).astype(float)
    info = np.bincount(key[edge] // size, weights=count * np.log2(np.maximum(count, 1)), minlength=n)
    total = np.maximum(tokens, 1)
    entropy = np.where(tokens > 1, (np.log2(total) - info / total) / np.maximum(np.log2(np.maximum(tokens, 2)), 1e-9), 0.0)
    return [tokens, np.where(tokens > 0, chars / total, 0.0), np.where(tokens > 0, lone / total, 0.0), entropy]


class Both:
    """Ids of texts in both vocabularies; frequent words are kept."""

    def __init__(self, model: str, words: str):
        self.piece, self.word = pieces.load(model), packing.word_ids(words)
        self.fresh()

    def fresh(self) -> None:
        """Forgets what was kept: caches live as long as a task."""
        self.piece.fresh()
        self.word.fresh()

    def __call__(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vocabulary the ids of all texts end to end and the number of each text's."""
        found = (self.piece.encode(texts, own=False), self.word.encode(texts))
        return [(ids.astype(np.int64), np.diff(at)) for ids, at in found]


def _measure(model: str, words: str):
    """Measures of (id, lang, text); further columns stay as they are."""

    @common.frugal
    def run(batches):
        vocabularies = Both(model, words)
        for whole in batches:
            for batch in common.pieces(whole, "text", CHUNK):
                texts = [t or "" for t in batch.column(2).to_pylist()]
                data, offsets = common.byte_view(batch.column(2))
                n = len(texts)
                start, end, row = common.word_spans(data, offsets)
                points = (data & 0xC0) != 0x80
                chars = common.per_row(points, offsets)
                word = common.span_hash(common.prefix_hash(data), start, end)
                lines = [[x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")] if "\n" in t else () for t in texts]
                (first, n_first), (second, n_second) = vocabularies(batch.column(2))
                measures = fertility(first, n_first, chars, vocabularies.piece.is_byte) + fertility(second, n_second, chars, vocabularies.word.is_byte)
                leads = [(name, common.per_row((data >= r.start) & (data < r.stop), offsets)) for name, r in _SCRIPTS] if n else []
                best = np.argmax([c for _, c in leads], axis=0) if n else []
                script = [leads[b][0] if leads[b][1][i] else "none" for i, b in enumerate(best)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1),
                        pa.array(np.bincount(row, minlength=n), pa.int64()),
                        pa.array(common.per_row(points & ~common._WS[data], offsets), pa.int64()),
                        pa.array(common.per_row(_SYMBOL[data], offsets), pa.int64()),
                        pa.array([len(x) - len(set(x)) for x in lines], pa.int64()),
                        pa.array(repeated_words(word, row, n), pa.int64()),
                        *[pa.array(m, pa.int64() if m.dtype.kind == "i" else pa.float64()) for m in measures],
                        pa.array(script, pa.string()),
                        *batch.columns[3:],
                    ],
                    names=[*(x.strip().split(" ")[0] for x in SCHEMA.split(",")), *batch.schema.names[3:]],
                )
        vocabularies.fresh()

    return run


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, model: str | None = None, words: str | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: its measures, base_failed, its band, kept, and the carried columns (as carried_<name>).

    model and words: paths of the piece vocabulary and of the word vocabulary. base_failed: fewer than 20 words,
    or over 30 % of the words in 8-word windows that are found twice or more. kept: not base_failed, and inside the
    bands of its language (null language: of its script) and of its length (a band for each power of two of tokens)
    in all measures of both vocabularies. Bands come from the quartiles over all documents of the group, those of
    equal measures once, so that copies don't narrow them; ties at a band's edge are inside.
    Null and empty texts have no words and fail. Texts of any length are measured whole. Repeated rows are judged
    one by one; other columns are not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    schema = SCHEMA + "".join(f", carried_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    seen = common.cut(rows.mapInArrow(_measure(model or pieces.default_path(), words or packing.default_path()), schema), "fertility")
    length = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("string")
    seen = seen.withColumn("band", F.concat(F.coalesce("lang", F.concat(F.lit("script:"), "script")), F.lit(":"), length))
    judged = seen.join(common.few(quartiles(seen, "band", tuple(MEASURES)), "bands", MOST_BANDS), "band", "left")
    failed = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
    outside = []
    for c, (least, low, high) in MEASURES.items():
        reach = f"greatest({SPREAD} * (high_{c} - low_{c}), {least})"
        outside += [f"{c} < low_{c} - {reach}"] * low + [f"{c} > high_{c} + {reach}"] * high
    return judged.selectExpr("*", f"({failed}) as base_failed", f"not ({failed}) and (n_tokens = 0 or not ({' or '.join(outside)})) as kept")


def quartiles(seen: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """key and low_, mid_ and high_<column>: the lower quartile, median and upper quartile of columns over each key, of
    rows of equal columns one; exact on the grid, from counts of the grid's steps, so that they do not depend on how rows
    are dealt."""
    different = seen.where("n_tokens > 0").select(key, "n_tokens", *columns).distinct()
    steps = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.col(c) / GRID).cast("long").alias("step")) for c in columns]))
    counts = different.select(key, steps.alias("x")).groupBy(key, "x.column", "x.step").agg(F.count("*").alias("n"))
    line = Window.partitionBy(key, "column")
    run = counts.select(key, "column", "step", F.sum("n").over(line.orderBy("step")).alias("upto"), F.sum("n").over(line).alias("all"))
    at = {"low": F.expr("4 * upto >= all"), "mid": F.expr("2 * upto >= all"), "high": F.expr("4 * upto >= 3 * all")}
    found = run.groupBy(key, "column").agg(*[F.min(F.when(reached, F.col("step"))).alias(q) for q, reached in at.items()])
    return found.groupBy(key).agg(*[F.max(F.when(F.col("column") == c, F.col(q) * GRID)).alias(f"{q}_{c}") for c in columns for q in at])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, measures of both vocabularies and verdicts of all documents."""
    out = quality_rules(common.read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return out.selectExpr("id as doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "n_word_tokens", *MEASURES, "band")
