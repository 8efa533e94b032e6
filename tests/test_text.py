"""Text functions against plain Python on written cases."""

import re
import time
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from folio.functions import chunking, content, rules, text

CASES = [
    "", " ", "Plain words. More", "# Heading\nbody *bold* and **b**", "a [1] b {2} c [a] d", "[1] whole line goes\nstays", "see http://x.y/z now\nhttp://start.of line",
    "mail a@b.cc here", "a@b.cc first", "ISBN 978-1234567890 x", "pp. 12-34, and", "note (see p. 4) end", "Dr. Who and ecc. etc. op. cit. e.g. that",
    "Chapter IV begins", "company party", "wait…  what – ever — yes", "too   many\t\tspaces \n\n\n\n\n gaps", "end ,, ... !!!!", '""quoted"" ««x»»', "x\nab\nok.\nlong line",
    "back\\slash \\n kept", "<b>tag</b> &amp; &#12; C# ## x", "été 21°C ² • bullet", "a|b||c", "| starts with pipe", "é ñ​﻿.", "line one\r\nline two\x1c ",
]


def plain_clean(t):
    t = unicodedata.normalize("NFC", t)
    for old, new in rules.CHARACTERS.items():
        t = t.replace(old, new)
    for pattern, to, _ in rules.RESIDUE:
        t = re.sub(pattern, to.replace("$1", r"\1"), t)
    kept = []
    for line in t.split("\n"):
        for pattern, to, _ in rules.NOISE:
            if re.match(pattern, line):
                line = to or None
                break
            line = re.sub(pattern, to, line)
        if line is not None:
            kept.append(line)
    t = "\n".join(kept)
    for short in sorted(rules.ABBREVIATIONS, key=lambda s: -len(s)):
        t = re.sub(rf"(?<!\w){re.escape(short)}(?!\w)", rules.ABBREVIATIONS[short], t, flags=re.I)
    t = re.sub(rules.NUMERAL, r"\2 \1", t, flags=re.I)
    for pattern, to in ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{4,}", "\n\n\n"), (r"(\n\s*){3,}", "\n\n"), (r"\s+([.,;:!?])", r"\1"), (r"([.,;:!?]){3,}", r"\1\1"), (r'"{2,}', '"')):
        t = re.sub(pattern, to, t)
    t = "\n".join(x for x in t.split("\n") if not (x.strip() and len(x.strip()) < 3 and x.strip()[-1] not in ".!?:")).strip()
    return t + "." if t and t[-1] not in ".!?…" else t


def apply(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in rows.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_clean_text(spark):
    assert apply(spark, [*CASES, None], text.clean_text) == [*map(plain_clean, CASES), None]


def test_rules_hold_what_they_say():
    """A text that a rule changes holds the rule's sign."""
    for t in [*CASES, *(line for c in CASES for line in c.split("\n"))]:
        for pattern, to, sign in rules.RESIDUE:
            assert sign in t or not re.search(pattern, t), (pattern, t)
        for pattern, _, sign in rules.NOISE:
            assert re.search(sign, t) or not re.search(pattern, t), (pattern, t)


def test_other_tables(spark):
    assert apply(spark, ["a %% b", "no sign"], lambda c: text.strip_residue(c, [("%+", "percent", "%")])) == ["a percent b", "no sign"]
    assert apply(spark, ["x\nTODO this\ny TODO z"], lambda c: text.drop_noise(c, [("TODO", "", "TODO")])) == ["x\ny  z"]


def test_clean_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", text.clean_text(F.col("text")).alias("c")).limit(60).collect()
    assert all(r.c == plain_clean(r.text) for r in rows if r.text is not None)


def test_strip_and_words(spark):
    assert apply(spark, CASES, text.strip) == [t.strip() for t in CASES]
    assert apply(spark, CASES, text.word_count) == [len(t.split()) for t in CASES]


def plain_chunks(t, most):
    """The contract in words: lines fill a buffer; what would exceed it closes it; long lines go by sentences."""
    done, buffer = [], None
    for line in [x.strip() for x in t.split("\n")]:
        kinds = [e for e in (". ", "! ", "? ", "; ") if e in line] if len(line) > most else []
        units = re.split(f"(?<={re.escape(kinds[0][0])}) ", line) if kinds else [line] if line else []
        if not line and buffer is not None:
            buffer += "\n"
        for n, unit in enumerate(units):
            joined = unit if buffer is None else f"{buffer} {unit}"
            if buffer is not None and (len(joined) > most or (n == 0 and len(line) > most)):
                done.append(buffer)
                joined = unit
            buffer = joined
    done += [buffer] if buffer is not None else []
    return [x.strip() for x in done] or [t]


def chunks_of(spark, texts, most):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    found = chunking.chunked(rows, F.col("t"), most).collect()
    out = [[] for _ in texts]
    for r in sorted(found, key=lambda r: (r.i, r.chunk_index)):
        assert r.chunk_index == len(out[r.i])
        out[r.i].append(r.chunk)
        assert r.chunks == sum(x.i == r.i for x in found)
    return out


def test_chunks(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    texts += ["", " \n ", "a" * 50, "One. Two! Three? " * 9, "x; y; z\n\nq" * 8, "no end at all " * 10, "a.  b. " * 30, "x" * 40 + "\n" + "y" * 40, "x" * 19 + "\n\n" + "y" * 19, None, ". . . " * 20]
    for most in (40, 500):
        assert chunks_of(spark, texts, most) == [[] if t is None else plain_chunks(t, most) for t in texts]


def test_chunks_of_a_long_chapter_take_linear_time():
    text = "A sentence of a few words that ends here. " * 120_000
    began = time.process_time()
    found = chunking.cuts(text + "\n\n" + text.replace(". ", ".\n"))
    assert len(text) > 5_000_000 and time.process_time() - began < 5
    assert max(map(len, found)) <= 2000 and "".join("".join(found).split()) == "".join(text.split()) * 2


def test_chunks_lose_nothing(spark):
    (got,) = chunks_of(spark, ["One two. Three four!\n\nFive six; seven " * 30], 60)
    assert "".join("".join(got).split()) == "".join(("One two. Three four!\n\nFive six; seven " * 30).split())
    assert max(map(len, got)) <= 60


def plain_bare(t):
    while True:
        left = re.sub(r"\[[^\[\]]*\]", "", re.sub(r"\([^()]*\)", "", t))
        if left == t:
            return re.sub(r"\s+([,;:.!?])", r"\1", " ".join(t.split()))
        t = left


@pytest.mark.parametrize(
    "given, want",
    [("Chapter 3: The end", "Chapter 3. The end."), ("capitolo IV", "capitolo IV."), ("Part 2 - ", "Part 2."), ("Prologue", "Prologue."), ("Why?", "Why?"), ("", "")],
)
def test_headings(spark, given, want):
    assert apply(spark, [given], text.format_heading) == [want]


def test_names_times_and_addresses(spark):
    odd = ["a(b(c)d)e [x] , f", "(open", None, "", "( [ (x) ) ] y", "(a [x) y] b)", "[(] a )", "(" * 900 + "x" + ")" * 900 + " z", "(a)[b] " * 900 + "\x1c.", ")(", "((a) b", "[[(]])]"]
    assert apply(spark, odd, text.strip_parentheses) == [t if t is None else plain_bare(t) for t in odd]
    assert apply(spark, ['a<b>: "c" d'], text.safe_filename) == ["ab_c_d"]
    assert apply(spark, ["/x/My_book-one.txt", "/x/_.txt"], text.title_from_stem) == ["My book one", "Text"]
    assert apply(spark, ["it-IT-ElsaNeural"], text.voice_name) == ["Elsa"]
    assert apply(spark, [" A@b.co ", "a@b", "a b@c.de"], text.is_email) == [True, False, False]
    assert apply(spark, ["https://example.com/x", "é"], text.name_uuid) == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ("https://example.com/x", "é")]
    assert apply(spark, ["3725", "59"], text.clock) == ["01:02:05", "00:00:59"]
    assert apply(spark, ["0", "86000", "80000"], lambda c: text.remaining(c.cast("int"))) == ["~24h", "~6 min", "~1h 46min"]
    assert apply(spark, ["a\x00b​c\n\n\n\nd    e"], text.sanitise_chunk) == ["abc\n\nd e"]


def test_content(spark):
    good = "These are words of a story that goes on and on. " * 10
    cases = [(good, "One"), (good, "Table of Contents"), ("short", ""), (None, None), ("\n".join(f"Title {i} ... {i}" for i in range(40)), ""), (good + " ISBN 1. All rights reserved. ", ""), ("ISBN all rights reserved " + good, "")]
    rows = spark.createDataFrame(cases, "t string, n string").select(content.is_content(F.col("t"), F.col("n")).alias("o")).collect()
    assert [r.o for r in rows] == [True, False, False, False, False, True, False]


GUARDED = [
    "see op. cit. and cit. p. 3", "ad es. p.es. ES. es.x xes.", "ſig.ra Bianchi, İng. Bıanchi", "a\t b \n c\n\n\n\nd  .", "\"\" x", "p.[12]3 is gone", "p. ٣ ⁴†",
    "ISBN 978-0-00-000000-2", "http://a.b c", "capitolo iv PARTE x", " edge ", "", ".", "a\r\n\r\n\r\nb", "n.d.r.", "a.C. d.C. a.c.d.", "st.", "\\n \\q ## x",
]


def test_guards_change_nothing(spark):
    """A text is read by one pattern of all signs before its rules run."""
    assert apply(spark, GUARDED, text.clean_text) == [*map(plain_clean, GUARDED)]
    assert apply(spark, GUARDED, lambda c: text.expand_abbreviations(c, {"a b.": "x", "b.": "a"})) == GUARDED
    for t in [*CASES, *GUARDED]:
        for pattern, to, *signs in (*rules.SPACING, *rules.PUNCTUATION, (f"(?i){rules.NUMERAL}", "", *rules.NUMERAL_SIGNS)):
            assert not signs or any(s in t.lower() for s in signs) or re.sub(pattern, to.replace("$1", r"\1"), t) == t, (pattern, t)
    assert all(len(r) > 2 for r in rules.SPACING[:3]) and text._any_sign(s for _, _, s in rules.NOISE).count("|") <= 6
