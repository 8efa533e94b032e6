"""Named queries over the test tables and their SQL twins (DuckDB).

Documents stand for plain-text books, conversations for books whose turns are chapters,
pages for spine pages and events for what jobs report.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import chunking, content, html, rules, text
from folio.operators import catalogue, chapters, sessions
from folio.session import cut, scratch, spread
from folio.sinks import books as sink
from folio.sources import epub, logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name, *columns):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# SQL pieces. \s of DuckDB is ASCII, which is all the white space that the tables hold.
def _strip(c):
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _words(c):
    return rf"CASE WHEN {_strip(c)} = '' THEN 0 ELSE len(regexp_split_to_array({_strip(c)}, '\s+')) END"


def _quoted(parts):
    return ", ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _content(c, title=None):
    lines = f"list_filter(list_transform(string_split({_strip(c)}, chr(10)), lambda l: {_strip('l')}), lambda l: l <> '')"
    share = lambda test: f"len(list_filter({lines}, lambda l: {test})) / len({lines})"
    titled = f"AND NOT list_bool_or(list_transform([{_quoted(rules.SKIPPED_TITLES)}], lambda t: contains(lower({title}), t)))" if title else ""
    signals = f"len(list_filter([{_quoted(rules.COLOPHON)}], lambda s: contains(lower(substr({_strip(c)}, 1, 500)), s)))"
    paged = r"regexp_matches(l, '\b\d{1,4}\s*$') OR regexp_matches(l, '\.\s*\.\s*\.\s*\d')"
    cited = r"regexp_matches(l, '\b(19|20)\d{2}\b') AND regexp_matches(l, '[,;]\s') AND length(l) > 40"
    return (
        f"(length({_strip(c)}) >= 100 AND {_words(c)} >= 30 {titled}"
        f" AND NOT (len({lines}) > 10 AND {share('length(l) < 15')} > 0.7) AND NOT (len({lines}) > 5 AND {share(paged)} > 0.4)"
        f" AND NOT (len({lines}) > 5 AND {share(cited)} > 0.5) AND {signals} < 2)"
    )


_CHAPTERS = (
    "WITH raw AS (SELECT conv_id AS book_id, turn, text, role AS title FROM conversations),"
    f" accepted AS (SELECT * FROM raw WHERE {_content('text', 'title')}),"
    " chapters AS (SELECT book_id, turn, row_number() OVER (PARTITION BY book_id ORDER BY turn) AS idx, title, text,"
    f" {_words('text')} AS word_count, length(text) AS char_count FROM accepted)"
)


def _documents(spark, sf_dir):
    """Documents for work on their texts."""
    return spread(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def _turns(spark, sf_dir):
    turns = spread(_table(spark, sf_dir, "conversations"))
    return turns.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("spine_pos"), F.lit(0).alias("section"), F.col("role").alias("title"), "text")


def _chapters(spark, sf_dir):
    return chapters.with_counts(chapters.number_chapters(_turns(spark, sf_dir)))


def _books(spark, sf_dir):
    one = _table(spark, sf_dir, "conversations", "conv_id").distinct()
    return one.select(F.col("conv_id").alias("book_id"), F.concat(F.lit("Book "), "conv_id").alias("title"), F.lit("unknown").alias("author"), F.lit("en").alias("language"))


@query(
    f"SELECT source, count(*) AS chapters, sum({_words('text')})::BIGINT AS total_words, sum(length(text))::BIGINT AS total_chars,"
    f" round(sum({_words('text')}) / 150.0, 1) AS minutes FROM documents WHERE {_content('text')} GROUP BY source"
)
def doc_stats_by_source(spark, sf_dir):
    """Content documents, words, characters and minutes of each source."""
    # exploded, so that the test stays behind the dealing out
    kept = _documents(spark, sf_dir).select("source", "text", F.explode(F.array(content.is_content(F.col("text")))).alias("good")).where("good")
    out = kept.groupBy("source").agg(F.count("*").alias("chapters"), F.sum(text.word_count(F.col("text"))).alias("total_words"), F.sum(text.char_count(F.col("text"))).alias("total_chars"))
    return out.withColumn("minutes", F.round(text.minutes(F.col("total_words")), 1))


@query(f"SELECT doc_id, {_content('text')} AS is_content FROM documents")
def content_filter(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", content.is_content(F.col("text")).alias("is_content"))


@query(f"SELECT doc_id, CAST({_words('text')} AS BIGINT) AS words, length(text) AS chars, round_even({_words('text')} / 150.0, 0) AS minutes FROM documents")
def doc_counts(spark, sf_dir):
    words = text.word_count(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", words.alias("words"), text.char_count(F.col("text")).alias("chars"), text.minutes(words, 0).alias("minutes"))


def _mapped_sql(c):
    for old, new in rules.CHARACTERS.items():
        c = f"replace({c}, chr({ord(old)}), '{new.replace(chr(39), chr(39) * 2)}')"
    return c


@query(f"SELECT doc_id, md5({_mapped_sql('nfc_normalize(text)')}) AS mapped FROM documents")
def clean_characters(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.map_characters(text.nfc("text"))).alias("mapped"))


_SPACED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{4,}', repeat(chr(10), 3), 'g'), '(\n\s*){3,}', repeat(chr(10), 2), 'g')"
_POINTED = r"""regexp_replace(regexp_replace(regexp_replace(text, '\s+([.,;:!?])', '\1', 'g'), '([.,;:!?]){3,}', '\1\1', 'g'), '"{2,}', '"', 'g')"""


@query(f"SELECT doc_id, md5({_SPACED}) AS spaced FROM documents")
def normalise_space(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.normalise_space(F.col("text"))).alias("spaced"))


@query(f"SELECT doc_id, md5({_POINTED}) AS pointed FROM documents")
def punctuation(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.punctuation(F.col("text"))).alias("pointed"))


_LINED = f"array_to_string(list_filter(string_split(text, chr(10)), lambda l: length({_strip('l')}) = 0 OR length({_strip('l')}) > 2 OR regexp_matches({_strip('l')}, '[.!?:]$')), chr(10))"


def _ended_sql(c):
    return f"CASE WHEN {_strip(c)} = '' OR regexp_matches({_strip(c)}, '[.!?…]$') THEN {_strip(c)} ELSE {_strip(c)} || '.' END"


@query(f"SELECT doc_id, md5({_LINED}) AS lines, md5({_ended_sql('text')}) AS ended FROM documents")
def short_lines_and_full_stops(spark, sf_dir):
    t = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.drop_short_lines(t)).alias("lines"), F.md5(text.full_stop(t)).alias("ended"))


@query(rf"SELECT doc_id, md5(regexp_replace(text, '{rules.NUMERAL}', '\2 \1', 'gi')) AS swapped FROM documents")
def chapter_numerals(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.chapter_numerals(F.col("text"))).alias("swapped"))


_EDGE = r"[^\p{L}\p{M}\p{N}_]"


def _sub_sql(c, pattern, to):
    """One rule in SQL. There are no lookarounds there: what they look at is matched and put back, in two rounds."""
    pattern, to, rounds = re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), pattern), re.sub(r"\$(\d)", r"\\\1", to), 1
    if pattern.startswith(r"(?<!\w)"):
        pattern, to, rounds = f"(^|{_EDGE}){pattern[7:].removesuffix(r'(?!\w)')}({_EDGE}|$)", rf"\1{to}\2", 2
    elif pattern.endswith((r"(?!\w)", "(?![nrt])")):
        bare, _, no = pattern[:-1].rpartition("(?!")
        pattern, to, rounds = f"{bare}({_EDGE if no == r'\w' else '[^nrt]'}|$)", r"\1", 2
    for _ in range(rounds):
        c = f"regexp_replace({c}, {_quoted([pattern])}, {_quoted([to])}, 'g')"
    return c


def _clean_sql(rows):
    """All cleaning steps of the texts of rows (doc_id, text)."""
    residue = noise = abbreviations = None
    for pattern, to, _ in rules.RESIDUE:
        residue = _sub_sql(residue or _mapped_sql("nfc_normalize(text)"), pattern, to)
    for pattern, to, _ in rules.NOISE:
        start = pattern.lstrip("^").replace(r"(?!\w)", f"(?:{_EDGE}|$)")
        noise = _sub_sql(_sub_sql(noise or "l", f"^(?:{start}).*", to or chr(0xE000)), pattern, to)
    for short in sorted(rules.ABBREVIATIONS, key=len, reverse=True):
        abbreviations = _sub_sql(abbreviations or "text", rf"(?<!\w)(?i:{re.escape(short)})(?!\w)", rules.ABBREVIATIONS[short])
    lines = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {noise}), lambda l: l <> chr(57344))"
    steps = (residue, f"array_to_string({lines}, chr(10))", abbreviations, f"regexp_replace(text, '{rules.NUMERAL}', '\\2 \\1', 'gi')", _SPACED, _POINTED, _LINED, _ended_sql("text"))
    chain = ", ".join(f"c{k + 1} AS (SELECT doc_id, {step} AS text FROM {f'c{k}' if k else 'rows'})" for k, step in enumerate(steps))
    return f"WITH rows AS ({rows}), {chain} SELECT doc_id, md5(text) AS cleaned, length(text) AS chars FROM c{len(steps)}"


@query(_clean_sql("SELECT doc_id, text FROM documents"))
def clean_text(spark, sf_dir):
    """All cleaning steps."""
    return _cleaned(_documents(spark, sf_dir))


#: Lines that the rules of cleaning change, one or more a rule.
_MARKED = (
    "## A heading # alone ##x a#b", "some *bold* and **bolder** words", "a __ rule ~~~ and `code`", "a | table | row", "C:\\dir \\new \\ end", "<b>bold</b> &amp; &#169; &nbsp;",
    "[12] goes as a line", "stays [12] here {3} and [b]", "a\u00b2 + b\u2074 = c\u2020 \u00a7 4", "https://example.com/a goes", "see https://example.com/a now", "write to someone@example.org today",
    "the book ISBN 978-0-00-000000-2 and doi: 10.1000/182", "as on pp. 12-14, 18 of it", "a rule (see page 4) or (Vedi sopra) or (cfr. sotto) [ ]", "etc. and ecc., ad es. Dr. Rossi vs. Mr. Smith",
    "SIG.RA Bianchi, op. cit. pag. 3; n.d.r. e.g. this, i.e. that", "presetc. stays, etc.x stays, cap. IV, Chapter XII", "ok", "a.", "  \t two\t\ttabs ....... !!!! \"\" x ,y", "Part  II of \u00ab it \u00bb \u2014 done",
)


@query(_clean_sql(f"SELECT doc_id, [{_quoted(_MARKED)}][doc_id % {len(_MARKED)} + 1] || chr(10) || text AS text FROM documents"))
def clean_marked_text(spark, sf_dir):
    """Documents that begin with a line which rules of cleaning change."""
    line = F.element_at(F.array(*map(F.lit, _MARKED)), (F.col("doc_id") % len(_MARKED) + 1).cast("int"))
    return _cleaned(_documents(spark, sf_dir).withColumn("text", F.concat(line, F.lit("\n"), "text")))


def _cleaned(rows):
    out = rows.select("doc_id", text.clean_text(F.col("text")).alias("text"))
    return out.select("doc_id", F.md5("text").alias("cleaned"), text.char_count(F.col("text")).alias("chars"))


#: The pages' first heading, in SQL.
_H1 = r"replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '^\s+|\s+$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"
_HEAD = f"(?i){rules.HEADING}"


@query(
    f"""WITH h AS (SELECT page_id, {_strip(_H1)} AS h FROM pages UNION ALL SELECT 1000000 + page_id, 'Chapter ' || page_id || ' - ' || {_strip(_H1)} FROM pages),
    p AS (SELECT *, regexp_extract(h, '{_HEAD}', 1) AS a, regexp_extract(h, '{_HEAD}', 2) AS b, regexp_replace(regexp_extract(h, '{_HEAD}', 3), '^[ .:—\\-]+|[ .:—\\-]+$', '', 'g') AS c FROM h)
    SELECT page_id, CASE WHEN regexp_matches(h, '{_HEAD}') THEN a || ' ' || b || CASE WHEN c = '' THEN '.' ELSE '. ' || c || '.' END
    WHEN h = '' OR regexp_matches(h, '[.!?]$') THEN h ELSE h || '.' END AS heading FROM p"""
)
def heading_format(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages", "page_id", "html")
    heads = pages.select("page_id", html.html_title("html").alias("h"))
    numbered = F.concat(F.lit("Chapter "), "page_id", F.lit(" - "), "h")
    both = heads.union(heads.select(F.col("page_id") + 1000000, numbered))
    return both.select("page_id", text.format_heading(F.col("h")).alias("heading"))


@query(
    rf"""WITH t AS (SELECT doc_id, text, regexp_replace(split_part(text, chr(10), 1), '\.+$', '') AS bare, regexp_replace(text, '^\s+', '') AS s FROM documents)
    SELECT doc_id, md5(CASE WHEN split_part(text, chr(10), 1) <> '' AND lower(substr(s, 1, length(bare))) = lower(bare) AND regexp_matches(substr(s, length(bare) + 1), '^\.?\s*\n')
    THEN regexp_replace(substr(s, length(bare) + 1), '^\.?\s*\n+', '') ELSE text END) AS body FROM t"""
)
def leading_title(spark, sf_dir):
    """The first line of a document as its title, taken from its text."""
    title = F.substring_index(F.col("text"), "\n", 1)
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.remove_leading_title(F.col("text"), title)).alias("body"))


#: A text followed by brackets nested as deep as its number says.
_NESTED = "text || repeat(' (a [b', CAST(doc_id % 30 AS INT)) || ' x ' || repeat('c] d)', CAST(doc_id % 30 AS INT)) || ' , end'"


def _bare_sql(rows, *keys):
    """Text without brackets of rows (keys, text), nested to any depth."""
    inner = r"regexp_replace(regexp_replace(t, '\([^()]*\)', '', 'g'), '\[[^\[\]]*\]', '', 'g')"
    keys, ends = ", ".join(keys), rf"regexp_replace(regexp_replace(arg_max(t, k), '\s+', ' ', 'g'), '\s+([,;:.!?])', '\1', 'g')"
    rounds = f"SELECT {keys}, text AS t, 0 AS k FROM ({rows}) UNION ALL SELECT {keys}, {inner}, k + 1 FROM rounds WHERE {inner} <> t"
    return f"rounds AS ({rounds}), bare AS (SELECT {keys}, {_strip(ends)} AS text FROM rounds GROUP BY {keys})"


@query(f"WITH RECURSIVE {_bare_sql(f'SELECT doc_id, {_NESTED} AS text FROM documents', 'doc_id')} SELECT doc_id, md5(text) AS bare FROM bare")
def strip_parentheses(spark, sf_dir):
    """Documents with nested brackets at their end, without what stands in brackets."""
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.strip_parentheses(F.expr(_NESTED))).alias("bare"))


def _chunks_sql(rows, *keys, most=chunking.CHUNK_CHARS):
    """Chunks (keys, chunk_index, chunks, chunk) of rows (keys, text), in the order of tables: lines, pieces with their places in
    the joined text, the piece that begins the chunk after one that begins with each piece, and the walk along these."""
    k, on = ", ".join(keys), " AND ".join(f"a.{x} = b.{x}" for x in keys)
    ends = "".join(f"WHEN contains(line, '{e}') THEN list_transform(string_split(line, '{e}'), lambda p, i: p || CASE WHEN i < len(string_split(line, '{e}')) THEN '{e[0]}' ELSE '' END) " for e in chunking.ENDS)
    return f"""lines AS (SELECT {k}, i AS n, {_strip('x')} AS line FROM (SELECT {k}, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ({rows}))),
    inked AS (SELECT *, n - coalesce(lag(n) OVER (PARTITION BY {k} ORDER BY n), 0) - 1 AS blank FROM lines WHERE line <> ''),
    listed AS (SELECT *, CASE WHEN length(line) <= {most} THEN [line] {ends} ELSE [line] END AS parts FROM inked),
    units AS (SELECT {k}, n, blank, unnest(parts) AS part, generate_subscripts(parts, 1) AS j, length(line) > {most} AS long FROM listed),
    spaced AS (SELECT {k}, row_number() OVER w AS i, j = 1 AND long AS fresh, CASE WHEN row_number() OVER w = 1 THEN part ELSE repeat(chr(10), CASE WHEN j = 1 THEN blank ELSE 0 END) || ' ' || part END AS unit, length(part) AS size FROM units WINDOW w AS (PARTITION BY {k} ORDER BY n, j)),
    placed AS (SELECT *, sum(length(unit)) OVER (PARTITION BY {k} ORDER BY i) AS e, sum(length(unit)) OVER (PARTITION BY {k} ORDER BY i) - size AS s FROM spaced),
    jumps AS (SELECT {', '.join(f'a.{x}' for x in keys)}, a.i, min(b.i) AS nxt FROM placed a LEFT JOIN placed b ON {on} AND b.i > a.i AND (b.fresh OR b.e > a.s + {most}) GROUP BY ALL),
    walk AS (SELECT {k}, i, nxt, 0 AS chunk_index FROM jumps WHERE i = 1 UNION ALL SELECT {', '.join(f'a.{x}' for x in keys)}, b.i, b.nxt, a.chunk_index + 1 FROM walk a JOIN jumps b ON {on} AND b.i = a.nxt),
    full_text AS (SELECT {k}, string_agg(unit, '' ORDER BY i) AS t FROM placed GROUP BY {k}),
    bounds AS (SELECT a.*, b.s, (SELECT max(c.e) FROM placed c WHERE {' AND '.join(f'c.{x} = a.{x}' for x in keys)} AND c.i < coalesce(a.nxt, 1000000000)) AS e FROM walk a JOIN placed b ON {on} AND a.i = b.i),
    found AS (SELECT {', '.join(f'a.{x}' for x in keys)}, chunk_index, {_strip('substr(b.t, (s + 1)::BIGINT, (e - s)::BIGINT)')} AS chunk FROM bounds a JOIN full_text b ON {on}),
    chunked AS (SELECT {k}, chunk_index, chunk FROM found UNION ALL SELECT {k}, 0, text FROM ({rows}) r WHERE {_strip('text')} = '')"""


@query(
    f"WITH RECURSIVE {_chunks_sql('SELECT doc_id, text FROM documents', 'doc_id', most=300)}"
    " SELECT doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunks, length(chunk) AS chars, md5(chunk) AS chunk FROM chunked"
)
def document_chunks(spark, sf_dir):
    """Chunks of 300 characters of whole documents."""
    rows = chunking.chunked(_documents(spark, sf_dir).select("doc_id", "text"), F.col("text"), 300)
    return rows.select("doc_id", "chunk_index", F.col("chunks").cast("long").alias("chunks"), F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("chunk"))


_PLANNED = (
    _CHAPTERS.replace("WITH ", "WITH RECURSIVE ", 1)
    + f", {_bare_sql('SELECT book_id, idx, title, text FROM chapters', 'book_id', 'idx', 'title')}, {_chunks_sql("SELECT book_id, idx, title || '.' || chr(10) || chr(10) || text AS text FROM bare", 'book_id', 'idx')}"
)


@query(_PLANNED + " SELECT book_id, idx AS chapter_index, chunk_index, count(*) OVER (PARTITION BY book_id, idx) AS chunks_in_chapter, length(chunk) AS chars, md5(chunk) AS chunk FROM chunked")
def chunk_plan(spark, sf_dir):
    """Chunks of every content turn."""
    plan = chapters.plan_chunks(_chapters(spark, sf_dir))
    return plan.select("book_id", "chapter_index", "chunk_index", F.col("chunks_in_chapter").cast("long").alias("chunks_in_chapter"), F.col("chars").cast("long").alias("chars"), F.md5("text").alias("chunk"))


@query(
    _PLANNED + """ SELECT book_id, idx AS chapter_index, chunk_index, coalesce(lag(idx) OVER w <> idx, false) AS starts_chapter, count(*) OVER w AS done_chunks, sum(length(chunk)) OVER w::BIGINT AS done_chars
    FROM chunked WINDOW w AS (PARTITION BY book_id ORDER BY idx, chunk_index)"""
)
def chunk_progress(spark, sf_dir):
    plan = chapters.plan_chunks(_chapters(spark, sf_dir).select("book_id", "idx", "title", "text"))
    return chapters.chunk_progress(plan).select("book_id", "chapter_index", "chunk_index", "starts_chapter", "done_chunks", "done_chars")


@query(_PLANNED + " SELECT book_id, count(*) AS total_chunks, sum(length(chunk))::BIGINT AS total_chars FROM chunked GROUP BY book_id")
def planned_totals(spark, sf_dir):
    """Chunks and characters of each book's plan."""
    return chapters.chunk_totals(chapters.plan_chunks(_chapters(spark, sf_dir)))


@query(
    r"""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), 1, 100) AS safe_name,
    printf('%03d_', page_id + 1) || substr(regexp_replace(regexp_replace(url, '[^\w\s-]', '', 'g'), '\s+', '_', 'g'), 1, 50) || '.txt' AS chapter_file,
    replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages"""
)
def file_names(spark, sf_dir):
    url = F.col("url")
    return _table(spark, sf_dir, "pages", "page_id", "url").select("page_id", text.safe_filename(url).alias("safe_name"), text.chapter_filename(F.col("page_id") + 1, url).alias("chapter_file"), text.escape_markup(url).alias("escaped"))


_TRIMMED = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_ENDS = f"'{rules.SENTENCE_END}'"


@query(
    rf"""WITH t AS (SELECT doc_id, {_TRIMMED} AS t FROM documents), w AS (SELECT *, substr(t, 201, 100) AS w FROM t),
    c AS (SELECT *, CASE WHEN regexp_matches(w, {_ENDS}) THEN 200 + strpos(w, regexp_extract(w, {_ENDS})) WHEN contains(w, ' ') THEN 300 - strpos(reverse(w), ' ') ELSE 300 END AS cut FROM w)
    SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE regexp_replace(substr(t, 1, cut), '\s+$', '') END AS preview FROM c"""
)
def previews(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.trim_preview(F.col("text")).alias("preview"))


@query(rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower({_H1}), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[^\w\s\p{{L}}\p{{N}}]', '', 'g') AS norm FROM pages")
def normal_titles(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.normal_title(html.html_title("html")).alias("norm"))


@query(rf"SELECT count(*) AS lines, count(*) FILTER (regexp_matches(lower(w), '{rules.EMAIL}')) AS emails FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)")
def email_words(spark, sf_dir):
    words = _documents(spark, sf_dir).select(F.explode(F.split("text", r"\s+", -1)).alias("w"))
    return words.agg(F.count("*").alias("lines"), F.count_if(text.is_email(F.col("w"))).alias("emails"))


@query(
    f"""SELECT page_id, coalesce(lower(regexp_replace(url, '^.*/', '')) IN ({_quoted(rules.FILES_EXACT)}), false) AS front_file, regexp_matches(lower(substr(html, 1, 2000)), 'epub:type="({"|".join(rules.DROPPED_TYPES)})[" ]') AS skipped_type FROM pages"""
)
def skipped_pages(spark, sf_dir):
    """Pages that a name or an epub:type rules out."""
    return _table(spark, sf_dir, "pages").select("page_id", content.is_front_file(F.col("url")).alias("front_file"), content.has_skipped_type(F.col("html")).alias("skipped_type"))


@query()
def html_text(spark, sf_dir):
    """Readable text of pages (a parser's work; tests compare with written cases)."""
    pages = spread(_table(spark, sf_dir, "pages", "page_id", "html"))
    out = pages.select("page_id", html.html_to_text(F.col("html")).alias("text"))
    return out.select("page_id", F.md5("text").alias("digest"), text.char_count(F.col("text")).alias("chars"))


def _page_lines_sql():
    """Lines of the pages' readable text. The pages hold no notes, lists outside navigation or tables; blocks are divided by tags."""
    c = "html"
    for pattern in ("<!--.*?-->", *(f"<{tag}\\b.*?</{tag}\\s*>" for tag in ("head", *rules.DROPPED_TAGS[:6]))):
        c = f"regexp_replace({c}, '{pattern}', '', 'gs')"
    c = f"regexp_replace({c}, '</?({'|'.join(rules.BLOCK_TAGS)})(\\s[^>]*)?/?>', chr(10), 'gi')"
    c = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("#39", "''"), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{sign}')"
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda l: {_strip('l')}), lambda l: l <> '')"


@query(f"WITH t AS (SELECT page_id, {_page_lines_sql()} AS lines FROM pages) SELECT page_id, len(lines) AS lines, md5(array_to_string(lines, chr(10))) AS digest FROM t")
def html_lines(spark, sf_dir):
    """Lines of the pages' readable text."""
    pages = spread(_table(spark, sf_dir, "pages", "page_id", "html"))
    bare = pages.select("page_id", html.html_to_text(F.col("html")).alias("text"))
    lines = bare.select("page_id", F.filter(F.transform(F.split("text", "\n"), text.strip), lambda line: line != "").alias("lines"))
    return lines.select("page_id", F.size("lines").cast("long").alias("lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query(f"SELECT page_id, {_H1} AS title FROM pages")
def html_titles(spark, sf_dir):
    return _table(spark, sf_dir, "pages", "page_id", "html").select("page_id", html.html_title("html").alias("title"))


@query(_CHAPTERS + " SELECT book_id, turn AS spine_pos, idx, title, word_count::BIGINT AS word_count, char_count FROM chapters")
def chapter_numbers(spark, sf_dir):
    return _chapters(spark, sf_dir).select("book_id", "spine_pos", "idx", "title", "word_count", "char_count")


@query(_CHAPTERS + " SELECT book_id, count(*) AS chapters, sum(word_count)::BIGINT AS total_words, sum(char_count)::BIGINT AS total_chars, sum(word_count) / 150.0 AS minutes FROM chapters GROUP BY book_id")
def book_totals(spark, sf_dir):
    return chapters.book_totals(_chapters(spark, sf_dir))


@query(_CHAPTERS + " SELECT book_id, count(*) AS chapters, sum(word_count)::BIGINT AS total_words FROM chapters WHERE idx % 2 = 1 GROUP BY book_id")
def selected_chapters(spark, sf_dir):
    """Totals of the chapters of a selection (here the odd ones)."""
    all_of = _chapters(spark, sf_dir)
    wanted = all_of.where("idx % 2 = 1").select("book_id", "idx")
    return chapters.book_totals(chapters.selected(all_of, wanted)).select("book_id", "chapters", "total_words")


@query(
    _CHAPTERS + f""", good AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY turn) AS n FROM chapters WHERE word_count >= 80),
    long AS (SELECT book_id, {_strip('text')} AS text, row_number() OVER (PARTITION BY book_id ORDER BY turn) AS n FROM raw WHERE length({_strip('text')}) >= 150),
    p AS (SELECT b.book_id, coalesce((SELECT {_strip('text')} FROM good g WHERE g.book_id = b.book_id AND n = 2), (SELECT {_strip('text')} FROM good g WHERE g.book_id = b.book_id AND n = 1), (SELECT text FROM long l WHERE l.book_id = b.book_id AND n = 1)) AS text FROM (SELECT DISTINCT book_id FROM raw) b),
    t AS (SELECT book_id, {_TRIMMED} AS t FROM p), w AS (SELECT *, substr(t, 201, 100) AS w FROM t),
    c AS (SELECT *, CASE WHEN regexp_matches(w, {_ENDS}) THEN 200 + strpos(w, regexp_extract(w, {_ENDS})) WHEN contains(w, ' ') THEN 300 - strpos(reverse(w), ' ') ELSE 300 END AS cut FROM w)
    SELECT book_id, coalesce(CASE WHEN length(t) <= 300 THEN t ELSE regexp_replace(substr(t, 1, cut), '\\s+$', '') END, '') AS preview FROM c"""
)
def book_previews(spark, sf_dir):
    turns = _turns(spark, sf_dir).withColumnRenamed("spine_pos", "idx")
    return chapters.preview(chapters.with_counts(turns))


@query(
    _CHAPTERS + """, parts AS (SELECT book_id, idx, CASE WHEN regexp_matches(title, '[.!?]$') THEN title ELSE title || '.' END || chr(10) || chr(10) || text AS part FROM chapters),
    bodies AS (SELECT book_id, string_agg(part, chr(10) || chr(10) || '...' || chr(10) || chr(10) ORDER BY idx) AS body FROM parts GROUP BY book_id)
    SELECT b.book_id, md5('Book ' || b.book_id || chr(10) || 'di unknown' || chr(10) || chr(10) || '...' || chr(10) || chr(10) || coalesce(body, '') || chr(10) || chr(10) || 'Fine.' || chr(10)) AS digest
    FROM (SELECT DISTINCT book_id FROM raw) b LEFT JOIN bodies USING (book_id)"""
)
def book_text(spark, sf_dir):
    return sink.book_text(_chapters(spark, sf_dir), _books(spark, sf_dir)).select("book_id", F.md5("text").alias("digest"))


@query(
    _CHAPTERS + """, rows AS (SELECT book_id, count(*) AS n, sum(word_count)::BIGINT AS words, list({'index': idx, 'title': title, 'file': printf('%03d_', idx) || title || '.txt', 'words': word_count, 'chars': char_count, 'estimated_minutes': round(word_count / 150.0, 1)} ORDER BY idx) AS chapters FROM chapters GROUP BY book_id)
    SELECT book_id, to_json({'title': 'Book ' || book_id, 'author': 'unknown', 'language': 'en', 'total_chapters': n, 'total_words': words, 'estimated_duration_minutes': round(words / 150.0, 1), 'chapters': chapters})::VARCHAR AS json FROM rows"""
)
def manifests(spark, sf_dir):
    return sink.manifest(_chapters(spark, sf_dir), _books(spark, sf_dir))


@query(_CHAPTERS + " SELECT book_id, printf('%03d_', idx) || title || '.txt' AS file, md5(CASE WHEN regexp_matches(title, '[.!?]$') THEN title ELSE title || '.' END || chr(10) || chr(10) || text || chr(10)) AS digest FROM chapters")
def chapter_files(spark, sf_dir):
    return sink.chapter_files(_chapters(spark, sf_dir)).select("book_id", "file", F.md5("text").alias("digest"))


_CODES = ", ".join(f"('{k}', '{v}')" for k, v in rules.LANGUAGES.items())
_FIRST = ", ".join(f"('{k}', {v})" for k, v in rules.LANGUAGE_PRIORITY.items())


@query(
    f"""WITH names(code, name) AS (VALUES {_CODES}), first(code, p) AS (VALUES {_FIRST})
    SELECT lang AS code, coalesce(any_value(n.name), lang) AS name, coalesce(any_value(f.p), 99) AS priority, count(*) AS documents
    FROM documents d LEFT JOIN names n ON n.code = d.lang LEFT JOIN first f ON f.code = d.lang GROUP BY lang"""
)
def language_catalogue(spark, sf_dir):
    counted = _table(spark, sf_dir, "documents", "lang").groupBy(F.col("lang").alias("code")).agg(F.count("*").alias("documents"))
    return counted.select("code", catalogue.language_name(F.col("code")).alias("name"), catalogue.language_priority(F.col("code")).alias("priority"), "documents")


@query(
    f"""WITH names(code, name) AS (VALUES {_CODES}), v AS (SELECT DISTINCT lang, source, doc_id % 2 AS g FROM documents),
    r AS (SELECT lang AS code, string_agg(CASE g WHEN 0 THEN 'Female' ELSE 'Male' END || ':' || source, ',' ORDER BY CASE g WHEN 0 THEN 'Female' ELSE 'Male' END, source) AS voices FROM v GROUP BY lang)
    SELECT r.code, coalesce(n.name, r.code) AS name, voices FROM r LEFT JOIN names n USING (code)"""
)
def voice_catalogue(spark, sf_dir):
    """Sources of each language as if they were its voices."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    voices = docs.select(F.concat("lang", F.lit("-XX-"), F.replace("source", F.lit("-"), F.lit("_")), F.lit("Neural")).alias("short_name"), F.concat("lang", F.lit("-XX")).alias("locale"), F.when(F.col("doc_id") % 2 == 0, "Female").otherwise("Male").alias("gender")).distinct()
    out = catalogue.voice_catalogue(voices)
    return out.select("code", "name", F.array_join(F.transform("voices", lambda v: F.concat_ws(":", v["gender"], v["name"])), ",").alias("voices"))


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
    SELECT user_id, arg_max(event_type, {'n': n, 'f': -first}) AS event_type FROM c GROUP BY user_id"""
)
def most_frequent(spark, sf_dir):
    """The most frequent kind of each user's events; ties: seen first."""
    rows = _table(spark, sf_dir, "events", "user_id", "event_id", "event_type").select(F.col("user_id").alias("book_id"), F.lit("f").alias("file"), F.col("event_type").alias("level"), F.col("event_id").alias("pos"))
    counts = rows.groupBy("book_id", "level").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counts.groupBy(F.col("book_id").alias("user_id")).agg(F.max_by("level", F.struct("n", -F.col("first"))).alias("event_type"))


@query("SELECT source AS book_id, arg_max(doc_id::VARCHAR || '.jpg', {'s': n_chars, 'p': -doc_id}) AS cover FROM documents WHERE n_chars > 5000 GROUP BY source")
def covers(spark, sf_dir):
    """The largest document above 5,000 characters of each source, chosen as covers are."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    entries = docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("pos"), F.concat(F.col("doc_id"), F.lit(".jpg")).alias("name"), F.col("n_chars").alias("file_size"), F.lit("").alias("media_type"), F.array().cast("array<string>").alias("properties"), F.lit(False).alias("is_meta_cover"))
    return catalogue.cover(entries)


@query(
    _CHAPTERS + """, f AS (SELECT book_id, printf('%03d_part.mp3', turn) AS name, octet_length(encode(text)) * 100 AS size, row_number() OVER (PARTITION BY book_id ORDER BY turn) AS episode, count(*) OVER (PARTITION BY book_id) AS n, turn FROM raw)
    SELECT f.book_id, episode::INTEGER AS episode, coalesce(c.title, 'Episode ' || episode) AS title, CASE WHEN c.title IS NULL THEN 'Episode ' || episode ELSE 'Chapter ' || f.turn || ': ' || c.title END AS description,
    printf('%02d:%02d:%02d', greatest(1, size * 8 // 48000) // 3600, greatest(1, size * 8 // 48000) % 3600 // 60, greatest(1, size * 8 // 48000) % 60) AS duration,
    strftime(TIMESTAMP '2026-03-01 12:00:00' - to_hours(CAST(n - episode AS INTEGER)), '%a, %d %b %Y %H:%M:%S +0000') AS pub_date FROM f LEFT JOIN chapters c ON c.book_id = f.book_id AND c.idx = f.turn"""
)
def feed_items(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    files = turns.select("book_id", F.format_string("%03d_part.mp3", "spine_pos").alias("name"), (F.octet_length("text") * 100).alias("file_size"))
    items = catalogue.feed_items(files, _chapters(spark, sf_dir), F.lit("2026-03-01 12:00:00").cast("timestamp"), "https://example.com")
    return items.select("book_id", "episode", "title", "description", "duration", "pub_date")


_ITEMS = ORACLE_SQL["feed_items"].replace("SELECT f.book_id, episode", "SELECT f.book_id, f.name, f.size, episode", 1)


def _uuid_sql(name):
    h = f"sha1(unhex('{text._URL_SPACE}') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query(
    f"""WITH items AS ({_ITEMS}), x AS (SELECT *, 'https://example.com/' || name AS url, {_uuid_sql("'https://example.com/' || name")} AS guid FROM items),
    one AS (SELECT book_id, episode, '<item><title>' || title || '</title><description>' || description || '</description><itunes:episode>' || episode || '</itunes:episode><itunes:duration>' || duration || '</itunes:duration><pubDate>' || pub_date
    || '</pubDate><link>' || url || '</link><guid isPermaLink="false">' || guid || '</guid><enclosure url="' || url || '" length="' || size || '" type="audio/mpeg"/></item>' AS xml FROM x)
    SELECT book_id, md5('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>Book ' || book_id || '</title><itunes:author>unknown</itunes:author>' || string_agg(xml, '' ORDER BY episode) || '</channel></rss>') AS rss
    FROM one GROUP BY book_id"""
)
def feeds(spark, sf_dir):
    """The text of each book's feed."""
    turns = _turns(spark, sf_dir)
    files = turns.select("book_id", F.format_string("%03d_part.mp3", "spine_pos").alias("name"), (F.octet_length("text") * 100).alias("file_size"))
    items = catalogue.feed_items(files, _chapters(spark, sf_dir), F.lit("2026-03-01 12:00:00").cast("timestamp"), "https://example.com")
    return catalogue.feed(items, _books(spark, sf_dir)).select("book_id", F.md5("rss").alias("rss"))


@query(
    f"""WITH h AS (SELECT page_id, sha1(unhex('{text._URL_SPACE}') || encode(url)) AS h FROM pages)
    SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS guid FROM h"""
)
def name_identifiers(spark, sf_dir):
    """Version 5 identifiers of page addresses (tests compare with the standard library)."""
    return _table(spark, sf_dir, "pages", "page_id", "url").select("page_id", text.name_uuid(F.col("url")).alias("guid"))


_SITE = ", ".join(f"('{c}', '{t}')" for c, t in rules.SITE_LANGUAGES.items())


@query(
    f"""WITH known(c, t) AS (VALUES {_SITE}), l AS (SELECT DISTINCT lang AS c, coalesce(t, lang) AS t FROM documents LEFT JOIN known ON c = lang WHERE lang IS NOT NULL),
    pages AS (SELECT 'https://example.com/' AS loc, 1.0::DOUBLE AS priority UNION ALL SELECT 'https://example.com/' || c || '/', 0.9 FROM l),
    o AS (SELECT t AS hreflang, 'https://example.com/' || c || '/' AS href FROM l UNION ALL SELECT 'x-default', 'https://example.com/') SELECT * FROM pages CROSS JOIN o"""
)
def site_map(spark, sf_dir):
    """The map of a site in the languages of the documents."""
    languages = _table(spark, sf_dir, "documents", F.col("lang").alias("code")).where("code is not null").distinct()
    return catalogue.site_map(spark, "https://example.com", languages).drop("place")


#: What the browser of a document's reader asks for.
_ASKED = "CASE doc_id % 5 WHEN 0 THEN lang || '-' || upper(lang) || ',' || lang || ';q=0.9,en;q=0.7' WHEN 1 THEN 'xx,' || lang || ';q=0.' || (doc_id % 9) || ',it;q=0.5' WHEN 2 THEN 'pt;q=0.8, ja' WHEN 3 THEN 'de;q=0.5,' || lang || ';q=0.5,zh-Hans-CN;q=.' ELSE '' END"


@query(
    f"""WITH h AS (SELECT doc_id, {_ASKED} AS header FROM documents),
    t AS (SELECT doc_id, unnest(regexp_extract_all(header, '{rules.ACCEPTED_LANGUAGE}', 1)) AS tag, unnest(regexp_extract_all(header, '{rules.ACCEPTED_LANGUAGE}', 2)) AS q, unnest(range(len(regexp_extract_all(header, '{rules.ACCEPTED_LANGUAGE}', 1)))) AS i FROM h),
    w AS (SELECT *, CASE WHEN regexp_matches(q, '^[0-9]*\\.?[0-9]+$') THEN q::DOUBLE ELSE 1.0 END AS w FROM t WHERE lower(tag) IN ({_quoted(rules.SITE_LANGUAGES)})),
    best AS (SELECT doc_id, arg_min(lower(tag), {{'w': -w, 'i': i}}) AS lang FROM w GROUP BY doc_id) SELECT h.doc_id, coalesce(lang, 'en') AS lang FROM h LEFT JOIN best USING (doc_id)"""
)
def preferred_languages(spark, sf_dir):
    """The language for each document's reader."""
    rows = _table(spark, sf_dir, "documents", "doc_id", "lang")
    return rows.select("doc_id", text.preferred_language(F.expr(_ASKED)).alias("lang"))


def _jobs(spark, sf_dir):
    return _table(spark, sf_dir, "events", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")


@query("SELECT upper(event_type) AS operation, count(*) AS n, count(DISTINCT user_id) AS sessions, strftime(min(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS first FROM events GROUP BY event_type")
def activity_log(spark, sf_dir):
    """Events written as log lines, read again and counted."""
    lines = _jobs(spark, sf_dir).select(logs.format_activity(F.col("job_id").cast("string"), F.col("ts"), F.concat(F.lit('a "b" # '), "event_id"), F.upper("event_type")).alias("line"))
    rows = lines.select(logs.parse_activity(F.col("line")).alias("a")).where("a is not null").select("a.*")
    return rows.groupBy("operation").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"))


@query(
    """WITH g AS (SELECT user_id AS job_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next_ts FROM events)
    SELECT job_id, count(*) AS gaps, max(epoch_us(next_ts) - epoch_us(ts)) AS longest_us FROM g WHERE epoch_us(next_ts) - epoch_us(ts) > 60000000 GROUP BY job_id"""
)
def heartbeat_gaps(spark, sf_dir):
    late = sessions.gaps(_jobs(spark, sf_dir))
    return late.groupBy("job_id").agg(F.count("*").alias("gaps"), F.max(F.unix_micros("next_ts") - F.unix_micros("ts")).alias("longest_us"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_digest(spark, sf_dir):
    out = sessions.digests(_jobs(spark, sf_dir))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:00").alias("hour"), "event_type", "n")


@query(
    """WITH RECURSIVE sent AS (SELECT user_id, min(ts) AS at, NULL::TIMESTAMP AS before FROM events GROUP BY user_id
    UNION ALL SELECT s.user_id, greatest(min(e.ts), s.at + INTERVAL 1 HOUR), s.at FROM sent s JOIN events e ON e.user_id = s.user_id AND e.ts > s.at GROUP BY s.user_id, s.at)
    SELECT s.user_id AS job_id, epoch_us(s.at) AS sent_us, count(*) AS events FROM sent s JOIN events e ON e.user_id = s.user_id AND e.ts <= s.at AND (s.before IS NULL OR e.ts > s.before) GROUP BY ALL"""
)
def throttled_digests(spark, sf_dir):
    """Digests of each job's events, an hour apart at least."""
    return sessions.throttled(_jobs(spark, sf_dir)).select(F.col("key").alias("job_id"), F.unix_micros("sent_at").alias("sent_us"), "events")


_NOW = "2024-01-30 00:00:00"
_STATUSES = ("analyzed", "generating", "done", "error", "cancelled")


def _states(spark, sf_dir):
    """One state per job from its events: the kind of the last one stands for the status."""
    last = _jobs(spark, sf_dir).groupBy("job_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("last_poll"), F.max_by("event_id", "event_id").alias("e"))
    when = lambda test: F.when(test, F.col("last_poll"))
    return last.select(
        "job_id", F.element_at(F.array(*map(F.lit, _STATUSES)), (F.col("e") % 5 + 1).cast("int")).alias("status"), (F.col("job_id") % 7 == 0).alias("email_registered"), "start_time", "last_poll",
        when(F.col("e") % 5 == 2).alias("completed_at"), when(F.col("job_id") % 3 == 0).alias("downloaded_at"), when((F.col("job_id") % 14) == 0).alias("email_sent_at"),
    )


_STATES = """WITH last AS (SELECT user_id AS job_id, min(ts) AS start_time, max(ts) AS last_poll, max(event_id) AS e FROM events GROUP BY user_id),
    s AS (SELECT job_id, ['analyzed', 'generating', 'done', 'error', 'cancelled'][e % 5 + 1] AS status, job_id % 7 = 0 AS email_registered, start_time, last_poll, CASE WHEN e % 5 = 2 THEN last_poll END AS completed_at,
    CASE WHEN job_id % 3 = 0 THEN last_poll END AS downloaded_at, CASE WHEN job_id % 14 = 0 THEN last_poll END AS email_sent_at FROM last),
    a AS (SELECT *, (epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch(last_poll))) / 60 AS idle, (epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch(start_time))) / 60 AS age FROM s)"""


@query(
    _STATES + """ SELECT job_id, status, CASE WHEN coalesce(CASE WHEN status = 'cancelled' THEN true WHEN email_registered AND status IN ('generating', 'analyzed') THEN false
    WHEN status = 'done' THEN CASE WHEN email_registered AND email_sent_at IS NOT NULL THEN idle > 1440 WHEN email_registered THEN false WHEN idle < 60 THEN false ELSE idle > 60 END
    WHEN status = 'error' THEN age > 60 WHEN status = 'analyzed' THEN idle > 5 ELSE false END, false) THEN 'remove' ELSE 'keep' END AS action,
    status = 'generating' AND NOT email_registered AND idle * 60 > 60 AS heartbeat_lost FROM a"""
)
def job_cleanup(spark, sf_dir):
    now = F.lit(_NOW).cast("timestamp")
    return _states(spark, sf_dir).select("job_id", "status", sessions.cleanup_action(now).alias("action"), sessions.heartbeat_lost(now).alias("heartbeat_lost"))


@query(_STATES + " SELECT job_id, status FROM a WHERE status IN ('generating', 'analyzed')")
def active_jobs(spark, sf_dir):
    return sessions.active(_states(spark, sf_dir)).select("job_id", "status")


@query("SELECT event_id AS token FROM events WHERE epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch(ts)) <= 86700 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def live_tokens(spark, sf_dir):
    """Tokens (events) that are not too old and whose job has a folder (a purchase)."""
    jobs = _jobs(spark, sf_dir)
    tokens = jobs.select(F.col("event_id").alias("token"), "job_id", F.col("ts").alias("created_at"))
    return logs.live_tokens(tokens, F.lit(_NOW).cast("timestamp"), jobs.where("event_type = 'purchase'").select("job_id")).select("token")


@query(
    """SELECT event_id, printf('%02d:%02d:%02d', event_id // 3600, event_id % 3600 // 60, event_id % 60) AS clock, strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') AS date,
    CASE WHEN l // 3600 > 0 THEN '~' || (l // 3600) || 'h' || CASE WHEN l % 3600 // 60 > 0 THEN ' ' || (l % 3600 // 60) || 'min' ELSE '' END ELSE '~' || (l % 3600 // 60) || ' min' END AS left_over
    FROM (SELECT *, greatest(60, 86400 - event_id * 37) AS l FROM events)"""
)
def times(spark, sf_dir):
    rows = _jobs(spark, sf_dir)
    return rows.select("event_id", text.clock(F.col("event_id")).alias("clock"), text.rfc2822(F.col("ts")).alias("date"), text.remaining(F.col("event_id") * 37).alias("left_over"))


@query(
    """WITH toc AS (SELECT doc_id // 4 AS book_id, 'f' || (doc_id % 3) AS file, doc_id AS pos, split_part(text, chr(10), 1) AS title FROM documents)
    SELECT book_id, file AS href_file, arg_max(title, pos) AS title, count(*) AS entries FROM toc GROUP BY book_id, file"""
)
def file_titles(spark, sf_dir):
    """First lines as entries of contents: the last one of a file names it."""
    toc = _documents(spark, sf_dir).select((F.col("doc_id") - F.col("doc_id") % 4).alias("b"), "doc_id", "text")
    toc = toc.select((F.col("b") / 4).cast("long").alias("book_id"), F.concat(F.lit("f"), F.col("doc_id") % 3).alias("href_file"), F.col("doc_id").alias("pos"), F.substring_index("text", "\n", 1).alias("title"))
    counts = toc.groupBy("book_id", "href_file").agg(F.count("*").alias("entries"))
    return chapters.file_titles(toc).join(counts, ["book_id", "href_file"])


@query(
    rf"""WITH h AS (SELECT page_id // 50 AS book_id, page_id AS pos, regexp_replace(lower({_H1}), '[^\w\s\p{{L}}\p{{N}}]', '', 'g') AS n FROM pages),
    w AS (SELECT *, regexp_replace(regexp_replace(n, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS norm FROM h),
    t AS (SELECT book_id, pos AS toc_pos, norm AS toc, list_filter(list_distinct(string_split(norm, ' ')), lambda x: x <> '') AS words FROM w),
    m AS (SELECT w.book_id, w.pos, toc_pos, CASE WHEN length(norm) < 3 OR toc = '' THEN NULL WHEN norm = toc THEN 1 WHEN contains(norm, toc) OR contains(toc, norm) THEN 2
    WHEN len(words) >= 2 AND len(list_intersect(words, string_split(norm, ' '))) / len(words) >= 0.6 THEN 3 END AS rank FROM w JOIN t ON w.book_id = t.book_id)
    SELECT pos, (min({{'r': rank, 'p': toc_pos}})).p AS toc_pos FROM m WHERE rank IS NOT NULL GROUP BY book_id, pos"""
)
def heading_matches(spark, sf_dir):
    """Headings of pages matched with those of their book (fifty pages each)."""
    pages = spread(_table(spark, sf_dir, "pages", "page_id", "html")).select(F.floor(F.col("page_id") / 50).alias("book_id"), F.lit("f").alias("file"), F.col("page_id").alias("pos"), html.html_title("html").alias("heading"))
    pages = cut(pages, "titles")
    toc = pages.select("book_id", F.col("file").alias("href_file"), "pos", F.col("heading").alias("title"))
    return chapters.match_headings(pages, toc).select("pos", "toc_pos")


_TOC = "WITH toc AS (SELECT doc_id // 4 AS book_id, 'f' || (doc_id % 3) AS file, doc_id AS pos, split_part(text, chr(10), 1) AS title FROM documents)"


@query(_TOC + " SELECT book_id, file AS href_file, count(*) AS entries, string_agg(title, '|' ORDER BY pos) AS titles FROM toc GROUP BY book_id, file HAVING count(*) >= 2")
def shared_files(spark, sf_dir):
    """Files with two or more entries of contents, and their titles in order."""
    toc = _documents(spark, sf_dir).select(F.expr("doc_id div 4").alias("book_id"), F.concat(F.lit("f"), F.col("doc_id") % 3).alias("href_file"), F.col("doc_id").alias("pos"), F.substring_index("text", "\n", 1).alias("title"))
    return chapters.shared_files(toc).select("book_id", "href_file", "entries", F.array_join("titles", "|").alias("titles"))


@query(
    """WITH r AS (SELECT user_id, event_type AS level, event_id AS pos, repeat(event_type || ' ', CAST(event_id % 40 AS BIGINT)) AS heading FROM events),
    c AS (SELECT user_id, level, count(*) AS n, min(pos) AS first FROM r GROUP BY ALL),
    b AS (SELECT user_id, arg_max(level, {'n': n, 'f': -first}) AS level FROM c GROUP BY user_id HAVING max(n) >= 2)
    SELECT r.user_id AS book_id, r.pos, r.level, CASE WHEN length(heading) < 150 THEN heading ELSE substr(heading, 1, 100) END AS title FROM r JOIN b ON r.user_id = b.user_id AND r.level = b.level"""
)
def level_headings(spark, sf_dir):
    """Events as headings of their user's book: those of the most frequent kind, long ones shortened."""
    rows = _table(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    heading = F.expr("repeat(event_type || ' ', int(event_id % 40))")
    found = chapters.level_headings(rows.select(F.col("user_id").alias("book_id"), F.lit("f").alias("file"), F.col("event_type").alias("level"), F.col("event_id").alias("pos"), heading.alias("heading")))
    return found.select("book_id", "pos", "level", "title")


@query(
    f"""WITH e AS (SELECT doc_id // 8 AS book_id, doc_id AS pos, CASE WHEN doc_id % 7 = 0 THEN 'OPS/Cover.JPG' WHEN doc_id % 3 = 0 THEN doc_id || '.svg' ELSE doc_id || '.png' END AS name, n_chars AS size,
    doc_id % 2 = 0 AS image, doc_id % 11 = 0 AS property, doc_id % 5 = 0 AS meta FROM documents),
    r AS (SELECT *, CASE WHEN image AND property THEN 0 WHEN image AND meta THEN 1 WHEN lower(regexp_replace(name, '^.*/', '')) IN ({_quoted(rules.COVER_NAMES)}) THEN 2 WHEN regexp_matches(lower(name), '[.](jpg|jpeg|png)$') AND size > 300 THEN 3 END AS rank FROM e)
    SELECT book_id, arg_min(name, {{'r': rank, 's': CASE WHEN rank = 3 THEN -size ELSE 0 END, 'p': pos}}) AS cover FROM r WHERE rank IS NOT NULL GROUP BY book_id"""
)
def cover_ranks(spark, sf_dir):
    """Documents as members of archives of eight: covers by property, metadata, name and size."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "n_chars")
    name = F.expr("CASE WHEN doc_id % 7 = 0 THEN 'OPS/Cover.JPG' WHEN doc_id % 3 = 0 THEN doc_id || '.svg' ELSE doc_id || '.png' END")
    entries = docs.select(
        F.expr("doc_id div 8").alias("book_id"), F.col("doc_id").alias("pos"), name.alias("name"), F.col("n_chars").alias("file_size"), F.expr("if(doc_id % 2 = 0, 'image/png', 'text/html')").alias("media_type"),
        F.expr("if(doc_id % 11 = 0, array('cover-image', 'svg'), null)").alias("properties"), F.expr("if(doc_id % 5 = 0, true, null)").alias("is_meta_cover"),
    )
    return catalogue.cover(entries, 300)


@query(
    r"""WITH w AS (SELECT page_id // 10 AS book_id, page_id, CASE page_id % 4 WHEN 0 THEN 'OPS/' || page_id || '.xhtml' WHEN 1 THEN 'OPS\' || page_id || '.xhtml' WHEN 2 THEN 'x/y/' || page_id || '.XHTML' ELSE 'OPS/none' || page_id END AS path FROM pages)
    SELECT book_id, path, 'OPS/' || page_id || '.xhtml' AS name FROM w WHERE page_id % 4 < 3"""
)
def archive_members(spark, sf_dir):
    """Members found by their path, by it with plain slashes, and by its last part in any case."""
    pages = _table(spark, sf_dir, "pages", "page_id").withColumn("book_id", F.expr("page_id div 10"))
    entries = pages.select("book_id", F.col("page_id").alias("pos"), F.format_string("OPS/%d.xhtml", "page_id").alias("name"))
    kinds = F.array(*[F.format_string(f, "page_id") for f in ("OPS/%d.xhtml", "OPS\\%d.xhtml", "x/y/%d.XHTML", "OPS/none%d")])
    wanted = pages.select("book_id", F.get(kinds, (F.col("page_id") % 4).cast("int")).alias("path"))
    return catalogue.find_member(entries, wanted)


@query(
    f"""WITH raw AS (SELECT conv_id AS book_id, turn, text, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE role END AS title FROM conversations),
    a AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY turn) AS idx FROM raw WHERE {_content("text", "coalesce(title, '')")})
    SELECT book_id, turn AS spine_pos, idx, CASE WHEN coalesce(title, '') = '' THEN 'Section ' || idx ELSE title END AS title FROM a"""
)
def fallback_titles(spark, sf_dir):
    """Chapters without a title are named by their number."""
    turns = _turns(spark, sf_dir)
    title = F.when(F.col("spine_pos") % 3 == 2, F.col("title")).when(F.col("spine_pos") % 3 == 1, "")
    return chapters.number_chapters(turns.withColumn("title", title)).select("book_id", "spine_pos", "idx", "title")


@query(
    """WITH b AS (SELECT conv_id AS book_id, turn AS pos, text, role = 'user' AS begins, substr(text, 1, 20) AS heading FROM conversations),
    n AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY book_id ORDER BY pos) AS section, count(*) FILTER (begins) OVER (PARTITION BY book_id) AS many FROM b)
    SELECT book_id, section, max(heading) FILTER (begins) AS title, coalesce(string_agg(text, '' ORDER BY pos) FILTER (NOT begins), '') AS text FROM n WHERE section > 0 AND many >= 2 GROUP BY book_id, section"""
)
def heading_sections(spark, sf_dir):
    """What users say as headings: the text from each to the next one."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.lit("f").alias("file"), F.col("turn").alias("pos"), F.lit(0).alias("level"), "text", "role")
    starts = turns.where("role = 'user'").select("book_id", "file", "pos", F.substring("text", 1, 20).alias("title"))
    return chapters.sections(turns.drop("role"), starts).select("book_id", "section", "title", "text")


_CHUNKS = "WITH c AS (SELECT conv_id AS book_id, turn // 3 AS chapter_index, turn AS chunk_index, length(text)::BIGINT AS chars FROM conversations)"


def _chunk_rows(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("book_id"), F.expr("turn div 3").alias("chapter_index"), F.col("turn").alias("chunk_index"), F.length("text").cast("long").alias("chars"))


@query(_CHUNKS + " SELECT book_id, count(*) AS total_chunks, sum(chars)::BIGINT AS total_chars FROM c GROUP BY book_id")
def chunk_totals(spark, sf_dir):
    """Chunks and characters of each book; turns stand for chunks."""
    return chapters.chunk_totals(_chunk_rows(spark, sf_dir))


@query(
    _CHUNKS + """ SELECT book_id, chunk_index, coalesce(lag(chapter_index) OVER w <> chapter_index, false) AS starts_chapter, count(*) OVER w AS done_chunks, sum(chars) OVER w::BIGINT AS done_chars
    FROM c WINDOW w AS (PARTITION BY book_id ORDER BY chapter_index, chunk_index)"""
)
def turn_progress(spark, sf_dir):
    """What is done after each chunk; turns stand for chunks."""
    return chapters.chunk_progress(_chunk_rows(spark, sf_dir)).select("book_id", "chunk_index", "starts_chapter", "done_chunks", "done_chars")


@query(
    _STATES + """, j AS (SELECT job_id, status, email_registered FROM a WHERE job_id % 2 = 0), t AS (SELECT job_id, 'kept' AS status, last_poll AS created_at FROM a WHERE job_id % 3 = 0)
    SELECT coalesce(j.job_id, t.job_id) AS job_id, coalesce(j.status, t.status) AS status, email_registered, strftime(date_trunc('second', created_at), '%Y-%m-%d %H:%M:%S') AS created FROM j FULL JOIN t ON j.job_id = t.job_id"""
)
def job_snapshots(spark, sf_dir):
    """Jobs that live, and those of which only the token's copy is left."""
    states = _states(spark, sf_dir)
    tokens = states.where("job_id % 3 = 0").select("job_id", F.lit("kept").alias("status"), F.col("last_poll").alias("created_at"))
    met = sessions.with_snapshot(states.where("job_id % 2 = 0").select("job_id", "status", "email_registered"), tokens)
    return met.select("job_id", "status", "email_registered", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


_TAGGED = "CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '-XX' WHEN 2 THEN 'IT-' || lang WHEN 3 THEN CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'ita' END END"


@query(f"SELECT doc_id, CASE WHEN coalesce({_TAGGED}, '') = '' OR lower({_TAGGED})[1:2] = '{rules.VOICE_LANGUAGE}' THEN '{rules.VOICE_OWN}' ELSE '{rules.VOICE_OTHER}' END AS voice FROM documents")
def default_voices(spark, sf_dir):
    """The voice of each document by its language."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "lang")
    return docs.select("doc_id", catalogue.default_voice(F.expr(_TAGGED)).alias("voice"))


@query("WITH w AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, CASE WHEN lang = 'fr' THEN 'Bonjour' ELSE 'Hello' END AS greeting FROM w")
def site_contents(spark, sf_dir):
    """Contents of a site in the languages of the documents, or in English."""
    wanted = _table(spark, sf_dir, "documents", "lang").groupBy("lang").agg(F.count("*").alias("n"))
    return catalogue.site_content(wanted, spark.createDataFrame([("en", "Hello"), ("fr", "Bonjour")], "lang string, greeting string"))


def _archived(spark, sf_dir):
    """Pages as EPUB books of fifty, written to the shared folder; where they are."""
    pages = _table(spark, sf_dir, "pages", "page_id", "html")
    path = scratch(spark, "epub")
    rows = pages.select(F.expr("page_id div 50").alias("book_id"), F.concat(F.lit("Pages & more of "), F.expr("page_id div 50")).alias("title"), F.col("page_id").alias("pos"), F.format_string("text/%d.xhtml", "page_id").alias("name"), "html")
    epub.write_epub(rows, path)
    return path


def _book():
    return F.regexp_extract("book_id", r"([^/]+)\.epub$", 1).cast("long").alias("book")


@query("SELECT page_id // 50 AS book, (row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1)::INTEGER AS pos, 'text/' || page_id || '.xhtml' AS name, md5(coalesce(html, '')) AS digest FROM pages")
def epub_spine(spark, sf_dir):
    """Pages written as EPUB books and read again, a row a page, in the order of the spine."""
    return epub.read_epub_rows(spark, _archived(spark, sf_dir)).select(_book(), "pos", "name", F.md5("html").alias("digest"))


@query("SELECT DISTINCT page_id // 50 AS book, 'Pages & more of ' || (page_id // 50) AS title, 'unknown' AS author, '' AS language FROM pages")
def epub_metadata(spark, sf_dir):
    """What such books say of themselves, with what stands for missing parts."""
    return epub.read_epub_rows(spark, _archived(spark, sf_dir), "books").where("error is null").select(_book(), "title", "author", "language")


@query(
    r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/' || page_id || '.xhtml' WHEN 1 THEN 'text\' || page_id || '.xhtml' WHEN 2 THEN 'x/y/' || page_id || '.XHTML' ELSE 'none' || page_id END AS path,
    CASE WHEN page_id % 4 < 3 THEN 'text/' || page_id || '.xhtml' END AS name, CASE WHEN page_id % 4 < 3 THEN md5(coalesce(html, '')) END AS digest FROM pages"""
)
def member_bytes(spark, sf_dir):
    """Bytes of archive members by their path, by it with plain slashes, by its last part in any case; and of none."""
    place = _archived(spark, sf_dir)
    kinds = F.array(*[F.format_string(f, "page_id") for f in ("text/%d.xhtml", "text\\%d.xhtml", "x/y/%d.XHTML", "none%d")])
    wanted = _table(spark, sf_dir, "pages", "page_id").select(F.concat(F.lit(f"{place}/"), F.expr("page_id div 50"), F.lit(".epub")).alias("book_id"), F.get(kinds, (F.col("page_id") % 4).cast("int")).alias("path"))
    number = F.regexp_extract("path", r"(\d+)[^\d]*$", 1).cast("long")
    return epub.read_members(wanted).select(number.alias("page_id"), "path", "name", F.md5("content").alias("digest"))


@query(ORACLE_SQL["chapter_files"].replace("SELECT book_id, printf", "SELECT book_id::VARCHAR AS folder, printf"))
def written_chapter_files(spark, sf_dir):
    """Chapters written as files NNN_title.txt in a folder for each book, and read again."""
    path = scratch(spark, "chapters")
    sink.write_chapter_files(_chapters(spark, sf_dir), path)
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    place = F.split(F.col("_metadata.file_path"), "/")
    return found.select(F.element_at(place, -2).alias("folder"), F.element_at(place, -1).alias("file"), F.md5("value").alias("digest"))
