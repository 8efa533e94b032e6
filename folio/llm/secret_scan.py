"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: alternatives of
trigrams that all must be in the lower-cased text. Postings (trigram -> document) are kept
for the trigrams that rules ask for; intersecting them gives candidates, which the regular
expression verifies. Rules without mandatory trigrams scan all texts.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import common


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans; pattern: a regular expression that Java and Python read alike;
    group: the group whose length must reach `least` (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Base kinds come first, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # runs of 16 and more are those of [0-9a-f]+ that stay
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
#: Sets of exact strings are followed up to so many.
MOST_STRINGS = 64


def _exact(items) -> set[str] | None:
    """The strings that a parsed sequence can match, in lower case; None: too many to say."""
    out = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            got = {chr(arg).lower()}
        elif name == "IN":
            got = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    got.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                    got |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
        elif name == "SUBPATTERN":
            got = _exact(arg[-1])
        elif name == "BRANCH":
            parts = [_exact(b) for b in arg[1]]
            got = None if None in parts else set().union(*parts)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
            got = _exact(arg[2])
            got = None if got is None else got | ({""} if arg[0] == 0 else set())
        else:
            got = None
        if got is None or len(out) * len(got) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in got}
    return out


def trigram_query(pattern: str) -> list[set[str]]:
    """Alternatives of trigrams: a match needs all trigrams of one of them. Empty: none are mandatory."""
    best: list[set[str]] = []
    items = list(parser.parse(pattern))
    i = 0
    while i < len(items):
        j, known = i, {""}
        while j < len(items) and (more := _exact(items[i : j + 1])) is not None:
            known, j = more, j + 1
        if min(map(len, known)) >= 3:
            query = [{s[k : k + 3] for k in range(len(s) - 2)} for s in sorted(known)]
            query = [a for n, a in enumerate(query) if not any(b < a or b == a and m < n for m, b in enumerate(query))]
            if not best or min(map(len, query)) > min(map(len, best)):
                best = query
        i = max(j, i + 1)
    return best


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """(id, trigram) for each trigram that a rule asks for and the lower-cased text holds."""
    wanted = sorted({t for r in rules for alternative in trigram_query(r.pattern) for t in alternative})
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in wanted]))
    return docs.select("id", low.alias("low")).select("id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(id, kinds): the rules of which a document holds all trigrams of an alternative."""
    wanted = [(r.kind, n, len(a), t) for r in rules for n, a in enumerate(trigram_query(r.pattern)) for t in a]
    table = index.sparkSession.createDataFrame(wanted, "kind string, alternative int, need int, trigram string")
    met = index.join(F.broadcast(table), "trigram").groupBy("id", "kind", "alternative", "need").agg(F.count_distinct("trigram").alias("n"))
    return met.where("n = need").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _cuts(text: Column, rule: Rule, position: int) -> Column:
    """The texts before each match, and the matches, as an array in text order."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m)) if rule.group else found
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("found"), tested.alias("tested"))
    return F.transform(zipped, lambda z, i: F.struct(F.lit(position).alias("kind"), i.alias("at"), z["gap"].alias("gap"), z["found"].alias("found"), (z["tested"] >= rule.least).alias("good")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules=RULES) -> DataFrame:
    """One row per input row: id, row (a hash of the text), spans array<struct<start, kind, end>> in order.

    Matches of a rule are leftmost and do not overlap; those that are too short are dropped;
    start and end count code points, end exclusive, kind is the rule's position. Null texts
    are empty and have no spans; repeated rows and those without an id stay; other columns are not looked at; an empty
    table gives an empty result.
    """
    rows = docs.select(common.row_id(id_col, text_col).alias("id"), F.col(id_col).alias("given"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = candidates(postings(rows, rules), rules)
    full = [r.kind for r in rules if not trigram_query(r.pattern)]
    looked = rows.join(common.few(named, "candidates"), "id", "left")
    none = F.array().cast("array<struct<kind:int,at:int,gap:int,found:int,good:boolean>>")
    parts = []
    for k, r in enumerate(rules):
        asked = F.col("text").rlike(r.pattern) if r.kind in full else F.array_contains("kinds", r.kind)
        parts.append(F.when(asked, _cuts(F.col("text"), r, k)).otherwise(none))
    # equal rows have equal matches: they are counted, and one of them is followed
    matched = looked.select("id", "given", F.xxhash64("text").alias("row"), F.concat(*parts).alias("m"))
    once = matched.groupBy("id", "row").agg(F.first("given").alias("given"), F.first("m").alias("m"), F.count("*").alias("rows"))
    each = once.select("id", "row", "given", "rows", F.explode_outer("m").alias("m")).select("id", "row", "given", "rows", "m.*")
    line = Window.partitionBy("id", "row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("found", F.lit(0))).over(line)
    span = F.when(F.col("good"), F.struct((F.col("end") - F.col("found")).cast("int").alias("start"), "kind", F.col("end").cast("int").alias("end")))
    light = each.withColumn("end", end).groupBy("id", "row").agg(F.first("given").alias("given"), F.first("rows").alias("rows"), F.sort_array(F.collect_list(span)).alias("spans"))
    return light.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select(F.col("given").alias("id"), "row", "spans")


def described(spans: Column, rules=RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every stretch that spans cover (they may overlap) replaced by the mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("int").alias("at"))
    step = lambda a, s: F.when(
        s["end"] <= a["at"], a
    ).otherwise(
        F.struct(
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out"), s["end"].alias("at")
        )
    )
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(described(base), 256).alias("base_sha256"), described(F.col("spans")).alias("spans")
    )
