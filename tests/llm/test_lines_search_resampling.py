"""op11, op12 and op13 against plain loops and SQL, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import importance_resampling, lexical_search, line_dedup, queries

EXTRA = "key string, text_hash long, numbers long, gone string, owned long, row long, part long, fits boolean, line long, item long"
ODD_LINES = ["  Same Line\t", "same line", "SAME LINE\r", "", " ", "other", "É line", "é line", "x", "long " * 3000]


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def odd_rows(n, seed):
    """doc_id, text: lines from a few, repeated rows, null and repeated ids, null and empty texts, a very long one."""
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice([*ODD_LINES, f"own {i} {rng.random()}"]) for _ in range(rng.randint(1, 9)))) for i in range(n)]
    return [*rows, rows[0], rows[0], (None, rows[1][1]), (None, "same line"), (None, "same line"), (2, "another text\nsame line"), (n, None), (n + 1, ""), (n + 2, "far word " * 60_000 + "\nSame line")]


def table(spark, rows, schema="doc_id long, text string"):
    """With more columns, whose names operators use themselves."""
    kinds = [x.split(" ") for x in EXTRA.split(", ")]
    return spark.createDataFrame(rows, schema).repartition(3).select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds])


def key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("least, shortest, key_bytes, folded", [(2, 1, 1 << 20, False), (3, 6, -1, False), (2, 1, -1, True)])
def test_line_dedup(spark, monkeypatch, keep, least, shortest, key_bytes, folded):
    if folded:  # a filter of so few bytes that nearly every line is suspected
        monkeypatch.setattr(line_dedup, "FILTER_BYTES", 64)
    rows = odd_rows(25, 3)
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= shortest)
    hashed = {(i, t): table.first()[0] for i, t in set(rows) for table in [spark.createDataFrame([(t or "",)], "t string").select(F.xxhash64("t"))]} if keep == "first" else {}
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashed.get(r, 0))):
        for k in {key(x) for x in (t or "").split("\n")}:
            first.setdefault(k, (i, t))
    want = []
    for i, t in rows:
        kept, had, lines = [], set(), (t or "").split("\n")
        for line in lines:
            k = key(line)
            if held[k] < least or len(k) < shortest or (keep == "first" and first[k] == (i, t) and k not in had):
                kept.append(line)
            had.add(k)
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.line_dedup(table(spark, rows), least=least, shortest=shortest, keep=keep, key_bytes=key_bytes, carry=("key",))
    assert got.columns == ["id", "n_lines", "n_dropped", "kept", "carried_key"]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:4]) for r in got.collect())


def test_filter_has_every_repeat(spark):
    rows = odd_rows(40, 5)
    seen = line_dedup.suspected(spark.createDataFrame([(i, n, t or "") for n, (i, t) in enumerate(rows)], "id long, text_hash long, text string").repartition(7))
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    suspected = Counter(r.key for r in seen.collect())
    assert all(suspected[k] == n for k, n in held.items() if n > 1)
    assert sum(k not in suspected for k, n in held.items() if n == 1) > 0.9 * sum(n == 1 for n in held.values())


def plain_search(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    counts = [(i, Counter(split(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(split(text)) if c[t])
            scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("window, block", [(8192, 1 << 22), (4, 40)])
def test_search(spark, window, block):
    docs = odd_rows(30, 7)
    items = [(1, "Same-line other"), (2, None), (3, ""), (4, "nowhere"), (5, "É é line, own 3 own"), (5, "far"), (None, "long word"), (6, "SAME same 7"), (7, "?!")]
    got = lexical_search.search(table(spark, docs), table(spark, items, "item_id long, text string"), k=4, window=window, block_bytes=block).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_search(docs, items, 4)


def test_terms_with_equal_hashes(spark, monkeypatch):
    """Where hashes fail to tell terms apart, bytes do."""
    monkeypatch.setattr(lexical_search, "_hashes", lambda low, start, end: (end - start).astype(np.uint64))
    words, number = lexical_search.vocabulary(["ab", "cd", "x", "ef"])
    low, start, end, row = lexical_search._terms(pa.array(["ef cd zz x", "y AB"]))
    at, term = lexical_search._found(low, start, end, words)
    assert {(low[start[a] : end[a]].tobytes().decode(), int(t)) for a, t in zip(at, term)} == {(w, number[w]) for w in ("ab", "cd", "x", "ef")}


def plain_resample(docs, target, run, percent=25, least=20, buckets=10_000, hashes=None):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in runs(split(x))), Counter(bucket(f) for x in target for f in runs(split(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (all_s + buckets)) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, x in docs:
        w = split(x)
        f = runs(w)
        weight = sum(map(gain, map(bucket, f))) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), hashes[x or ""]])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[5]))
    rank = defaultdict(list)
    for k, r in enumerate(fit):
        rank[repr(r)].append(k + 1 if k < percent * len(fit) // 100 else None)
    return sorted(repr((*r[:5], rank[repr(r)].pop() if rank[repr(r)] else None)) for r in rows)


@pytest.mark.parametrize("run, chunk, percent", [(2, 1 << 16, 25), (3, 20, 60), (1, 7, 100)])
def test_resample(spark, run, chunk, percent):
    docs = odd_rows(30, 9) + [(100 + i, f"word{i % 7} é " * (15 + i)) for i in range(20)]
    target = ["É é word3, same-line", None, "", "far word " * 50]
    texts = list({t or "" for _, t in docs})
    hashes = dict(zip(texts, (r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.xxhash64("t")).collect())))
    got = importance_resampling.resample(table(spark, docs), table(spark, [(t,) for t in target], "text string"), run=run, chunk=chunk, percent=percent).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_resample(docs, target, run, percent, hashes=hashes)


def test_checksums_of_long_words():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé0") for _ in range(rng.choice([1, 2, 30, 47, 48, 49, 50, 300]))) for _ in range(200)]
    row, bucket, _ = importance_resampling.features(pa.array([" ".join(words), None, "one"]))
    runs = [(0, w) for w in words] + [(0, f"{a} {b}") for a, b in zip(words, words[1:])] + [(2, "one")]
    assert sorted(zip(row.tolist(), bucket.tolist())) == sorted((i, zlib.crc32(f.encode()) % 10_000) for i, f in runs)


def test_empty_tables(spark):
    docs, items = table(spark, odd_rows(3, 1)), table(spark, [(1, "same line")], "item_id long, text string")
    none, no_items = docs.where("false"), items.where("false")
    assert line_dedup.line_dedup(none).count() == 0
    assert lexical_search.search(none, items).count() == 0 and lexical_search.search(docs, no_items).count() == 0
    assert importance_resampling.resample(none, items).count() == 0
    assert importance_resampling.resample(docs, no_items).count() == docs.count()


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_lexical_search", "op13_importance_resampling"])
def test_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    theirs = sorted((tuple(row[names.index(c)] for c in columns) for row in found.fetchall()), key=repr)
    assert theirs and sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == theirs
