"""Headings and contents against every pair, and files of many headings."""

import random
import re
import time


from folio.operators import chapters

HEADS = "book_id string, file string, pos int, heading string"
TOC = "book_id string, href_file string, pos int, title string"


def normal(t):
    return re.sub(r"[^\w\s]", "", " ".join(t.strip().lower().split()))


def plain(heads, toc):
    out = set()
    for b, f, p, h in heads:
        n = normal(h or "")
        ranks = []
        for tb, tf, tp, t in toc:
            m = normal(t or "")
            if (tb, tf) != (b, f) or len(n) < 3 or not m:
                continue
            words = set(m.split())
            rank = 1 if n == m else 2 if n in m or m in n else 3 if len(words) >= 2 and 10 * len(words & set(n.split())) >= 6 * len(words) else None
            if rank:
                ranks.append((rank, tp, t))
        if ranks:
            out.add((b, f, p, h, *min(ranks)[1:]))
    return out


def matched(spark, heads, toc):
    return {tuple(r) for r in chapters.match_headings(spark.createDataFrame(heads, HEADS).repartition(3), spark.createDataFrame(toc, TOC)).collect()}


def test_every_pair(spark):
    rng = random.Random(4)
    words = ["The", "sea", "hill", "é", "I", "of", "two", "river:", "night", "a"]
    title = lambda: rng.choice([None, "", "  ", "I", "ab", "…"]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
    heads = [(rng.choice("ab"), rng.choice("fg"), i, title()) for i in range(150)]
    toc = [(rng.choice("ab"), rng.choice("fg"), i, title()) for i in range(40)]
    want = plain(heads, toc)
    assert matched(spark, heads, toc) == want and len(want) > 50
    assert matched(spark, heads[:3], []) == set() == matched(spark, [], toc)


def test_ten_thousand_headings_of_one_file(spark):
    heads = [("b", "f", i, f"Chapter {i}: of {i * 7919 % 10007} things") for i in range(10_000)]
    heads += [("b", "f", 50_000 + i, f"Part {i * 3} of {i * 3 + 1} in all") for i in range(2_000)]  # which share three of five words with each of these
    toc = [("b", "f", 30_000 + i, f"part {i * 3 + 2} of {i * 3 + 20_000} in all") for i in range(2_000)] + [("b", "f", i, f"chapter {i} of {i * 7919 % 10007} things") for i in range(0, 10_000, 2)] + [("b", "f", 20_000 + i, f"{i * 7919 % 10007} things") for i in range(1, 10_000, 2)]
    began = time.time()
    found = chapters.match_headings(spark.createDataFrame(heads, HEADS), spark.createDataFrame(toc, TOC))
    got = {r.pos: r.toc_pos for r in found.select("pos", "toc_pos").collect()}
    took = time.time() - began
    assert len(got) == 12_000 and all(got[50_000 + i] == 30_000 for i in range(2_000)) and all(got[i] == i for i in range(0, 10_000, 2))
    sample = plain(heads[1:400:40], toc)
    assert {(p, tp) for _, _, p, _, tp, _ in sample} == {(i, got[i]) for i in range(1, 400, 40)}
    assert took < 120, took
