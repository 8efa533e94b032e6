"""SentencePiece encoding and decoding of a text column with a merge-type vocabulary."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common, pieces

#: Bytes of texts that share the search for their different segments, and bytes of segments that a task keeps.
CHUNK, CACHE_BYTES = 4 << 20, 192 << 20
#: Texts that are compared with the library at a time.
COMPARED = 64
SCHEMA = "id long, ids array<int>, decoded string, n_tokens long, ids_sha256 string, decoded_sha256 string, matches_library boolean"


def agrees(vocabulary: pieces.Pieces, texts: pa.Array, flat: np.ndarray, at: np.ndarray) -> list[bool]:
    """Whether the library encodes each whole text to its ids (flat[at[i]:at[i + 1]]); a few texts at a time, so that its
    arrays stay small."""
    out, given = [], pc.fill_null(texts, "")
    for i in range(0, len(given), COMPARED):
        got = vocabulary.library.encode_as_numpy(given.slice(i, COMPARED).to_pylist(), num_threads=1)
        out += [np.array_equal(x, flat[a:b]) for x, a, b in zip(got, at[i:], at[i + 1 :])]
    return out


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None, keep_ids: bool = True, check: bool = True) -> DataFrame:
    """Encodes every text with our score-ordered agenda and decodes the ids.

    Returns one row per input row: the id, ids, decoded text, their digests and
    matches_library: whether the library, given the whole text, has the same ids (null without check);
    the ids are ours in any case. keep_ids=False leaves ids and decoded null. Null and empty texts have no ids and decode to the empty text. Repeated rows stay;
    other columns are not looked at; an empty table gives an empty result.
    """
    model = model or pieces.default_path()

    @common.frugal
    def run(batches):
        vocabulary = pieces.load(model)
        vocabulary.fresh(CACHE_BYTES)
        decimal = vocabulary.decimal
        for whole in batches:
            for batch in common.pieces(whole, "text", CHUNK):
                flat, at = vocabulary.encode(batch.column(1), own=True)
                ids = [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
                good = agrees(vocabulary, batch.column(1), flat, at) if check else [None] * len(ids)
                text = vocabulary.library.decode(ids, num_threads=1) if ids else []
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(ids if keep_ids else [None] * len(ids), pa.list_(pa.int32())),
                        pa.array(text if keep_ids else [None] * len(ids), pa.string()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([sha(",".join([decimal[i] for i in x])) for x in ids], pa.string()),
                        pa.array([sha(t) for t in text], pa.string()),
                        pa.array(good, pa.bool_()),
                    ],
                    names=["id", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256", "matches_library"],
                )
        vocabulary.fresh()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded texts of all documents."""
    out = encode_decode(common.read_table(spark, sf_dir, "documents", "doc_id", "text"), keep_ids=False)
    return out.selectExpr("id as doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "matches_library")
