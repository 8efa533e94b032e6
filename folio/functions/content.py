"""Predicates that tell content from what surrounds it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import rules
from folio.functions.text import collapse, let, strip, word_count


def _any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def is_content(text: Column, title: Column | None = None, *, least_chars: int = 100, least_words: int = 30) -> Column:
    """Whether a text is a chapter: long enough, no title of front or back matter, not a list
    of short lines, of page references or of books, no colophon. Null texts are none."""
    titled = F.lit(False) if title is None else _any(F.lower(F.coalesce(title, F.lit(""))), rules.SKIPPED_TITLES)
    return let(strip(F.coalesce(text, F.lit(""))), lambda bare: _is_prose(bare, least_chars, least_words)) & ~titled


def _is_prose(bare: Column, least_chars: int, least_words: int) -> Column:
    lines = F.filter(F.transform(F.split(bare, "\n", -1), strip), lambda x: x != "")
    paged = lambda x: x.rlike(r"(?dU)\b\d{1,4}\s*$") | x.rlike(r"(?dU)\.\s*\.\s*\.\s*\d")
    cited = lambda x: x.rlike(r"(?dU)\b(19|20)\d{2}\b") & x.rlike(r"(?dU)[,;]\s") & (F.length(x) > 40)

    def listed(held: Column) -> Column:
        n = F.size(held)
        share = lambda test: F.size(F.filter(held, test)) / n
        short = share(lambda x: F.length(x) < 15)
        return ~((n > 10) & (short > 0.7)) & ~((n > 5) & (share(paged) > 0.4)) & ~((n > 5) & (share(cited) > 0.5))

    head = F.lower(F.substring(bare, 1, 500))
    signals = sum((F.contains(head, F.lit(s)).cast("int") for s in rules.COLOPHON), F.lit(0))
    return (
        (F.length(bare) >= least_chars)
        & (word_count(bare) >= least_words)
        & let(lines, listed)
        & (signals < 2)
    )


def is_front_file(name: Column) -> Column:
    """Whether a file name is that of a section without content."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(.)\.[^.]*$", "$1")
    key = F.translate(F.lower(stem), "-_", "")
    return key.isin(*rules.FILES_EXACT) | _any(key, rules.FILES_PART)


def has_skipped_property(properties: Column, skipped=rules.DROPPED_TYPES) -> Column:
    return F.coalesce(F.arrays_overlap(properties, F.array(*[F.lit(p) for p in skipped])), F.lit(False))


def has_skipped_type(html: Column, skipped=rules.DROPPED_TYPES) -> Column:
    """Whether one of the first 2,000 characters begins an epub:type that is skipped."""
    head = F.lower(F.substring(html, 1, 2000))
    return head.rlike('epub:type="(' + "|".join(sorted(skipped)) + ')[" ]') | head.rlike("epub:type='(" + "|".join(sorted(skipped)) + ")[' ]")


def is_book_file(path: Column, size: Column, most: int = 200 << 20) -> Column:
    return F.lower(path).rlike(r"\.(epub|txt)$") & (size <= most)


def titles_match(heading: Column, toc: Column) -> Column:
    """Rank of the match of two normal titles: 1 equal, 2 one holds the other, 3 at least 60 % of
    two or more words of the contents' title; null: none."""
    words = F.array_distinct(F.filter(F.split(collapse(toc), " "), lambda w: w != ""))
    own = F.split(collapse(heading), " ")
    shared = F.size(F.array_intersect(words, own)) / F.size(words)
    return (
        F.when((F.length(heading) < 3) | (toc == ""), F.lit(None).cast("int"))
        .when(heading == toc, 1)
        .when(F.contains(heading, toc) | F.contains(toc, heading), 2)
        .when((F.size(words) >= 2) & (shared >= 0.6), 3)
    )
