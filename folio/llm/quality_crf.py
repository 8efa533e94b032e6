"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are its own and those of the lines before and after;
a 2 x 2 table links neighbours. Forward-backward gives each line's marginal, and the mean
weighted by the lines' lengths is the document's score. Training sees documents' labels
only: all lines of a document carry its label, and the likelihood of that labelling is
maximised; then a logistic curve is fitted to the scores of the training documents. A text
without words is a chain of one bare line, so that its score is learned too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common

#: At most so many labelled documents train the model, so many of each label: a fixed, documented bound.
SAMPLE = 1500
#: In training a document of more lines is several chains, so that a step takes so many turns; scoring never cuts.
CHAIN_LINES = 256
EPOCHS, STEP, DECAY = 250, 0.08, 1e-3

_CODE = {"upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A)}


def _marks(*chars: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER, _LOWER, _DIGIT = (_marks(*r) for r in _CODE.values())
_SYMBOL, _PIPE, _LOUD = _marks(*b"#*$%&<>@\\^~=_{}[]"), _marks(*b"|"), _marks(*b"!?")
_STOP, _PAUSE = _marks(*b"."), _marks(*b",;:")
OWN = 15
FEATURES = 3 * OWN + 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, lengths (bytes) and rows of the lines that have a word; a row without such lines has one bare line."""
    rows = len(offsets) - 1
    if not rows:
        return np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(data):
        return _with_bare(np.zeros((0, OWN)), np.zeros(0, np.int64), np.zeros(0, np.int64), rows)
    start, end, word_row = common.word_spans(data, offsets)
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 0x0A) + 1]))
    line_of_word = np.searchsorted(cuts, start, "right") - 1
    words = np.bincount(line_of_word, minlength=len(cuts) - 1)
    word = common.span_hash(common.prefix_hash(data), start, end)

    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[cuts])
    high = (data >= 0x80) & (data <= 0x9E) & np.concatenate([[False], data[:-1] == 0xC3])  # capitals of Latin-1
    upper, lower = total(_UPPER[data] | high), total(_LOWER[data])
    chars = np.maximum(total(~common._WS[data] & ((data & 0xC0) != 0x80)), 1)
    by_line = lambda flags, at: np.bincount(at[flags], minlength=len(words))
    same = lambda lag: by_line((word[lag:] == word[:-lag]) & (word_row[lag:] == word_row[:-lag]), line_of_word[lag:])
    capital = (_UPPER[data[start]] | (data[start] == 0xC3) & high[np.minimum(start + 1, len(data) - 1)]) if len(start) else np.zeros(0, bool)

    def repeated(width: int) -> np.ndarray:
        """Words that begin a window found elsewhere in the same document."""
        h = common.window_hash(word, word_row, width)
        at = np.flatnonzero(word_row[: len(h)] == word_row[width - 1 :]) if len(h) else np.zeros(0, int)
        key = common.mix64(h[at] ^ common.mix64(word_row[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        equal = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        return np.bincount(line_of_word[at[twice]], minlength=len(words))

    n = np.maximum(words, 1)
    own = np.stack(
        [
            np.log1p(words) / 5, chars / n / 8, upper / np.maximum(upper + lower, 1), total(_DIGIT[data]) / chars, 4 * total(_SYMBOL[data]) / chars, 4 * total(_PIPE[data]) / n,
            4 * total(_LOUD[data]) / n, 4 * total(_STOP[data]) / n, 2 * total(_PAUSE[data]) / n, same(1) / n, same(2) / n, repeated(3) / n, repeated(8) / n, by_line(capital, line_of_word) / n, words < 4,
        ], axis=1
    )
    kept = np.flatnonzero(words)
    return _with_bare(own[kept], np.diff(cuts)[kept], np.searchsorted(offsets, cuts[kept], "right") - 1, rows)


def _with_bare(own: np.ndarray, length: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds the bare lines, then the features of the lines before and after."""
    bare = np.setdiff1d(np.arange(rows), row)
    if len(bare):
        blank = np.zeros((len(bare), OWN))
        blank[:, -1] = 1  # fewer than four words
        row = np.concatenate([row, bare])
        order = np.argsort(row, kind="stable")
        own, row = np.concatenate([own, blank])[order], row[order]
        length = np.concatenate([length, np.ones(len(bare), np.int64)])[order]
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = row[1:] == row[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1), length, row


def _layout(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each chain begins, and its length; rows come in order."""
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    return edge, np.diff(np.append(edge, len(row)))


def _logaddexp2(x: np.ndarray) -> np.ndarray:
    """log sum exp over the last axis of two states."""
    return np.logaddexp(x[..., 0], x[..., 1])


def chain(score: np.ndarray, link: np.ndarray, row: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward on all chains at once: marginals of each line and, if asked for, of each two neighbours."""
    edge, size = _layout(row)
    order = np.argsort(-size, kind="stable")
    edge, size = edge[order], size[order]
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left")  # chains longer than t
    forward[edge] = score[edge]
    for t in range(1, longest):
        at = edge[: alive[t]] + t
        forward[at] = score[at] + _logaddexp2((forward[at - 1][:, :, None] + link[None]).transpose(0, 2, 1))
    for t in range(longest - 2, -1, -1):
        at = edge[: alive[t + 1]] + t
        backward[at] = _logaddexp2(link[None] + (score[at + 1] + backward[at + 1])[:, None, :])
    log_z = _logaddexp2(forward[edge + size - 1])
    z = np.repeat(log_z[np.argsort(order)], np.diff(np.append(np.sort(edge), len(row)))) if len(edge) else np.zeros(0)
    marginal = np.exp(forward + backward - z[:, None])
    if not pairs:
        return marginal, None
    inner = np.flatnonzero(row[1:] == row[:-1])
    return marginal, np.exp(forward[inner][:, :, None] + link[None] + (score[inner + 1] + backward[inner + 1])[:, None, :] - z[inner][:, None, None])


class LineCrf:
    """Weights of the features for "good" against "bad", the links, and the curve from mean marginal to score."""

    def __init__(self):
        self.weight, self.link, self.curve = np.zeros(FEATURES), np.zeros((2, 2)), (1.0, 0.0)

    def _scores(self, x: np.ndarray) -> np.ndarray:
        half = x @ self.weight / 2
        return np.stack([-half, half], axis=1)

    def fit(self, x: np.ndarray, row: np.ndarray, length: np.ndarray, label: np.ndarray) -> "LineCrf":
        """label: of each row, 0 or 1; both classes weigh the same."""
        y = label[row].astype(int)
        edge, size = _layout(row)
        of_chain = label[row[edge]].astype(int)
        share = np.bincount(of_chain, minlength=2)
        if not share.all():  # one class only: a constant
            self.curve = (0.0, 6.0 if share[1] > share[0] else -6.0 if share[0] else 0.0)
            return self
        balance = len(of_chain) / 2 / share
        # a document counts once, however many lines it has
        w = np.repeat(balance[of_chain] / size / len(of_chain), size)
        place = np.arange(len(row)) - np.repeat(edge, size)
        part = np.cumsum(place % CHAIN_LINES == 0)  # numbers the chains
        m = [np.zeros(FEATURES), np.zeros((2, 2))]
        v = [np.zeros(FEATURES), np.zeros((2, 2))]
        inner = np.flatnonzero(part[1:] == part[:-1])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner], y[inner + 1]), w[inner])
        for epoch in range(1, EPOCHS + 1):
            marginal, near = chain(self._scores(x), self.link, part, pairs=True)
            slope = [((y - marginal[:, 1]) * w) @ x - DECAY * self.weight, seen - (near * w[inner][:, None, None]).sum(0) - DECAY * self.link]
            for k, target in enumerate((self.weight, self.link)):
                m[k] = 0.9 * m[k] + 0.1 * slope[k]
                v[k] = 0.99 * v[k] + 0.01 * slope[k] ** 2
                target += STEP * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-8)
        mean = np.clip(self.means(x, row, length, len(label)), 1e-4, 1 - 1e-4)
        logit, target = np.log(mean / (1 - mean)), label
        a, b = 1.0, 0.0
        each = balance[target.astype(int)]
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * logit + b)))
            a += 0.5 * float(np.mean(each * (target - p) * logit)) / (1 + float(np.mean(logit**2)))
            b += 0.5 * float(np.mean(each * (target - p)))
        self.curve = (max(a, 0.05), b)
        return self

    def means(self, x: np.ndarray, row: np.ndarray, length: np.ndarray, rows: int) -> np.ndarray:
        """Length-weighted mean marginal of "good" for each row; every row has lines."""
        marginal, _ = chain(self._scores(x), self.link, row)
        weight = np.bincount(row, weights=length, minlength=rows)
        return np.bincount(row, weights=length * marginal[:, 1], minlength=rows) / weight

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = common.byte_view(texts)
        x, length, row = line_features(data, offsets)
        mean = np.clip(self.means(x, row, length, len(texts)), 1e-4, 1 - 1e-4)
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * np.log(mean / (1 - mean)) + b)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE) -> LineCrf:
    """Fits on at most `sample` labelled documents of each label, those of the least hash of the id."""
    ranked = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropDuplicates(["id"])
    chosen = None
    for k in (0, 1):
        part = ranked.where(f"label = {k}").orderBy(F.xxhash64(F.col("id")), "id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = texts.join(F.broadcast(chosen), "id").orderBy("id", "text").select("text", "label").toArrow()  # at most 2 x sample rows
    data, offsets = common.byte_view(table.column(0))
    x, length, row = line_features(data, offsets)
    return LineCrf().fit(x, row, length, table.column(1).to_numpy().astype(float))


def score(docs: DataFrame, model: LineCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: better) of every row, from whole texts.

    Null, empty and wordless texts have the learned score of a bare line. Repeated rows stay; other columns are not looked
    at; an empty table gives an empty result.
    """

    @common.frugal
    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)), pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")


def op10_quality_crf(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = common.read_table(spark, sf_dir, "labels", "doc_id", "quality")
    fold = "crc32(encode(string(doc_id), 'UTF-8')) % 3"
    model = train(docs, labels.where(f"{fold} <> 1"))
    return score(docs, model).withColumnRenamed("id", "doc_id").selectExpr("doc_id", f"{fold} = 1 as held_out", "score", "int(score >= 0.5) as predicted")
