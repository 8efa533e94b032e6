"""Cutting texts into chunks of bounded size, by a table function that is joined laterally and gets its rows as Arrow batches.

The pieces of a text (its lines, and the sentences of lines that are too long) stand end to end with the spaces and newlines
that join them. A chunk is then a range of pieces, from a piece to the last one that ends within the bound, which a search
in the ends finds; a text of n characters takes O(n) and a search for each chunk.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 2000
#: Ends of sentences; of a long line the first kind that it has cuts it.
ENDS = (". ", "! ", "? ", "; ")


def pieces(text: str, most: int) -> Iterator[tuple[str, int, bool]]:
    """Pieces of a text, the blank lines before each, and whether it must begin a chunk."""
    blank = 0
    for line in map(str.strip, text.split("\n")):
        if not line:
            blank += 1
            continue
        end = next((e for e in ENDS if e in line), None) if len(line) > most else None
        parts = line.split(end) if end else [line]
        for i, part in enumerate(parts):
            yield part + end[0] if end and i < len(parts) - 1 else part, 0 if i else blank, i == 0 and len(line) > most
        blank = 0


def cuts(text: str, most: int = CHUNK_CHARS) -> list[str]:
    """Chunks of at most `most` characters, as far as sentences allow. A sentence that is longer stays whole; a text
    without words is its own chunk."""
    joined, starts, ends, fresh, at = [], [], [], [], 0
    for part, blank, begins in pieces(text, most):
        if starts:
            joined.append("\n" * blank + " ")
            at += blank + 1
        if begins:
            fresh.append(len(starts))
        starts.append(at)
        joined.append(part)
        at += len(part)
        ends.append(at)
    whole, out, first, turn = "".join(joined), [], 0, 0
    while first < len(starts):
        while turn < len(fresh) and fresh[turn] <= first:
            turn += 1
        last = bisect_right(ends, starts[first] + most, first + 1, fresh[turn] if turn < len(fresh) else len(ends)) - 1
        out.append(whole[starts[first] : ends[last]].strip())
        first = last + 1
    return out or [text]


class _Chunks:
    def eval(self, text: str | None, most: int) -> Iterator[tuple[int, int, str]]:
        found = cuts(text, most) if text is not None else []
        for i, chunk in enumerate(found):
            yield i, len(found), chunk


def chunked(rows: DataFrame, text: Column, most: int = CHUNK_CHARS) -> DataFrame:
    """Adds chunk_index (from 0), chunks (how many the text has) and chunk: a row for each chunk of each row. A null text has none."""
    function = F.udtf(_Chunks, returnType="chunk_index int, chunks int, chunk string", useArrow=True)
    held = rows.withColumn("_whole", text)
    return held.lateralJoin(function(F.col("_whole").outer(), F.lit(most))).drop("_whole")
