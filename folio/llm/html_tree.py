"""HTML main-text extraction: a tree-structured graphical model over the DOM.

Every element is content or not. A node's potential comes from its tag, its class and id
words and its text; parent and child are linked by a table for each kind of child.
Sum-product messages go up and down the tree and give each element's marginal; blocks of
text whose element is content make up the page's text. The model is trained on labelled
pages that labelled_pages() writes out from layouts and made-up words.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common

_NAME, _UNQUOTED = re.compile(r"(/?)([a-zA-Z][^\s/>]*)"), re.compile(r"[^>\"']*")
#: Attributes one by one, each with its value, so that nothing inside a value is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: Their content is never text.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = RAW | frozenset("head form button select option svg audio video canvas map".split())
#: Of these the ones that stand within a line of text: they go with their content and neither divide a block nor weigh on it.
SKIPPED = DROPPED - {"head", "form"}
#: A start of these ends an open p.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: A start of the first ends an open one of the second, up to a list or table around them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
FENCES = frozenset("ul ol dl table menu html body".split())

#: All other elements are inline: they stand within a block and do not divide it.
BLOCKS = ENDS_P | {"head", "form"} | frozenset("html body li dt dd tr td th thead tbody tfoot caption legend optgroup".split())

TAGS = "html body div section article main header footer nav aside p h1 h2 h3 h4 ul ol li table td blockquote pre figure".split()
TAG_ID = {t: i for i, t in enumerate(TAGS)} | {"h5": TAGS.index("h4"), "h6": TAGS.index("h4"), "th": TAGS.index("td"), "dd": TAGS.index("li"), "dt": TAGS.index("li"), "dl": TAGS.index("ul"), "menu": TAGS.index("nav")}
#: Words of class, id and role, by what they say.
WORDS = (
    "ad ads advert advertisement adbox adslot banner promo promotion sponsor sponsored sponsors partner dfp",
    "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip links",
    "header masthead topbar hero branding logo contentinfo",
    "footer foot bottom copyright legal imprint",
    "sidebar side aside rail widget widgets complementary secondary",
    "cookie cookies consent gdpr notice alert notification popup modal overlay banner privacy disclaimer warning",
    "form search login signup signin subscribe subscription newsletter register contact",
    "share sharing social related recommended recommendations more popular trending tags teaser follow",
    "comment comments respond discussion disqus reply replies thread responses reviews",
    "article content main post entry story body text page blog news copy prose",
)
_MEANS: dict[str, int] = {}
for _n, _list in enumerate(WORDS):
    for _w in _list.split():
        _MEANS[_w] = _MEANS.get(_w, 0) | 1 << _n
_KINDS = len(WORDS)
FEATURES = len(TAGS) + 1 + _KINDS + 8
#: Kinds of children that have link tables of their own.
LINKS = 3
_BOX, _LEAF = frozenset("div section article main header footer nav aside body".split()), frozenset("p h1 h2 h3 h4 h5 h6 li td blockquote pre dd dt".split())

#: Labelled pages for training, rounds, step and weight decay.
PAGES, EPOCHS, STEP, DECAY = 700, 300, 0.15, 1e-5


def tags(source: str):
    """(start, end, "/" or "", name, attributes) of every tag, and of comments and declarations (no name), in
    one pass: a quote counts after "=" if it is closed; where a tag would reach the end of the page
    with its quotes, quotes no longer count."""
    at, size, quotes = 0, len(source), True
    last = {q: source.rfind(q) for q in "\"'"}
    while (low := source.find("<", at)) >= 0:
        if source.startswith("<!--", low):
            end = source.find("-->", low + 4)
            at = end + 3 if end >= 0 else size
            yield low, at, "", None, ""
            continue
        if source[low + 1 : low + 2] in ("!", "?"):
            end = source.find(">", low)
            at = end + 1 if end >= 0 else size
            yield low, at, "", None, ""
            continue
        name = _NAME.match(source, low + 1)
        if not name:
            at = low + 1
            continue
        end = pos = name.end()
        while quotes:
            end = _UNQUOTED.match(source, pos).end()
            if end == size:
                quotes = False
            elif source[end] == ">":
                break
            elif end < last[source[end]] and source[pos:end].rstrip().endswith("="):
                pos = source.find(source[end], end + 1) + 1
            else:
                pos = end + 1
        if not quotes:
            end = source.find(">", name.end())
        at = end + 1 if end >= 0 else size
        yield low, at, name[1], name[2].lower(), source[name.end() : at - 1 if end >= 0 else size]


class Page:
    """Elements of a page in document order, and its blocks of text."""

    __slots__ = ("tag", "parent", "flags", "dropped", "label", "blocks", "links")

    def __init__(self, source: str):
        self.tag, self.parent, self.flags, self.dropped, self.label = [], [], [], [], []
        self.blocks, self.links = [], []  # (element, text), characters of links of each block
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[int] = []
        places: dict[str, list[int]] = {}  # where on the stack each tag stands
        fences, boxes = [-1], [-1]  # and those that others don't close
        buffer: list[str] = []
        linked, in_link = 0, False
        skip_to = at = 0
        skipped, inside = "", {}  # the skipped element that is open, and how many of each name are open in it

        def flush():
            nonlocal linked
            if buffer:
                text = " ".join(entities.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    self.blocks.append((stack[-1] if stack else -1, text))
                    self.links.append(min(linked, len(text)))
            linked = 0

        def push(node: int, name: str):
            places.setdefault(name, []).append(len(stack))
            if name in FENCES:
                fences.append(len(stack))
            if name in FENCES or name in _BOX:
                boxes.append(len(stack))
            stack.append(node)

        def pop(k: int):
            while len(stack) > k:
                places[self.tag[stack.pop()]].pop()
            for marks in (fences, boxes):
                while marks[-1] >= k:
                    marks.pop()

        def top(name: str) -> int:
            return places[name][-1] if places.get(name) else -1

        for start, end, closing, name, attributes in tags(source):
            if start < skip_to:
                continue
            if start > at and not skipped:
                piece = source[at:start]
                buffer.append(piece)
                if in_link:
                    linked += len(piece)
            at = end
            if name is None:
                continue
            if skipped:
                if not closing:
                    if name in RAW:
                        skip_to = at = self._behind(source, name, at)
                    elif name not in VOID and not attributes.endswith("/"):
                        inside[name] = inside.get(name, 0) + 1
                    continue
                if inside.get(name):
                    inside[name] -= 1
                    if name == skipped and not inside[name]:
                        skipped = ""
                    continue
                if top(name) < 0:
                    continue
                skipped = ""  # it was not closed, and ends with what is around it
            if name in SKIPPED:
                if not closing and name in RAW:
                    skip_to = at = self._behind(source, name, at)
                elif not closing and not attributes.endswith("/"):
                    skipped, inside = name, {name: 1}
                continue
            if name == "br" or name in VOID and name != "hr":
                if not buffer or buffer[-1] != " ":
                    buffer.append(" ")
                continue
            if name not in BLOCKS:
                if name == "a":
                    in_link = not closing
                continue
            if closing:  # closes up to its start, if that is open
                k = top(name)
                if k >= 0 and (k >= fences[-1] or name in FENCES or name in ENDS_P):
                    flush()
                    in_link = False
                    pop(k)
                continue
            flush()
            in_link = False
            if name == "hr":
                continue
            if name in ENDS_P and top("p") > boxes[-1]:
                pop(top("p"))
            k = max((top(t) for t in ENDS.get(name, ())), default=-1)
            if k > fences[-1]:
                pop(k)
            if name == "body" and top("head") >= 0:
                pop(places["head"][0])
            node, up = len(self.tag), stack[-1] if stack else -1
            meaning, label = 0, self.label[up] if up >= 0 else 0
            for a in _ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key == "data-y":
                    label = 1 if value == "1" else 0
                elif key in ("class", "id", "role"):
                    for w in _WORD.findall(value):
                        meaning |= _MEANS.get(w, 0)
            self.tag.append(name)
            self.parent.append(up)
            self.flags.append(meaning)
            self.dropped.append(name in DROPPED or (up >= 0 and self.dropped[up]))
            self.label.append(label)
            push(node, name)
        if at < len(source) and not skipped:
            buffer.append(source[at:])
        flush()

    @staticmethod
    def _behind(source: str, name: str, at: int) -> int:
        """The place after the end tag of an element whose content is no markup."""
        end = re.compile(f"</{name}\\s*>", re.I).search(source, at)
        return end.end() if end else len(source)


class Forest:
    """The elements of some pages as arrays, level by level."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) + 1 for p in pages], np.int64)  # each page has a root over all
        first = np.concatenate([[0], np.cumsum(sizes)])
        n = int(first[-1])
        self.first, self.parent = first[:-1], np.full(n, -1, np.int64)
        tag, flags, self.dropped, self.label = np.full(n, len(TAGS), np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        self.kind = np.full(n, 2, np.int64)
        text, linked, blocks = (np.zeros(n) for _ in range(3))
        for p, f in zip(pages, first):
            k = len(p.tag)
            if k:
                self.parent[f + 1 : f + 1 + k] = np.array(p.parent) + f + 1
                tag[f + 1 : f + 1 + k] = [TAG_ID.get(t, len(TAGS)) for t in p.tag]
                flags[f + 1 : f + 1 + k] = p.flags
                self.dropped[f + 1 : f + 1 + k] = p.dropped
                self.label[f + 1 : f + 1 + k] = p.label
                self.kind[f + 1 : f + 1 + k] = [0 if t in _BOX else 1 if t in _LEAF else 2 for t in p.tag]
            for (owner, t), a in zip(p.blocks, p.links):
                text[f + 1 + owner] += len(t)
                linked[f + 1 + owner] += a
                blocks[f + 1 + owner] += 1
        self.bare = self.first[text[self.first] == 0]  # roots without text of their own are no content
        depth = np.zeros(n, np.int64)
        for i in range(n) if n else ():
            if self.parent[i] >= 0:
                depth[i] = depth[self.parent[i]] + 1
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if n else np.zeros(1, int)
        self.levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        under, under_links, under_blocks = text.copy(), linked.copy(), blocks.copy()
        for level in reversed(self.levels[1:]):
            for part in (under, under_links, under_blocks):
                np.add.at(part, self.parent[level], part[level])
        whole = np.repeat(under[self.first], sizes)
        x = np.zeros((n, FEATURES))
        x[np.arange(n), tag] = 1
        at = len(TAGS) + 1
        for k in range(_KINDS):
            x[:, at + k] = flags >> k & 1
        at += _KINDS
        safe = np.maximum(under, 1)
        x[:, at : at + 8] = np.stack(
            [np.log1p(np.minimum(text, 200)) / 5, np.log1p(np.minimum(under, 600)) / 6, under_links / safe, under / np.maximum(whole, 1), under < 40, np.minimum(under_blocks, 4) / 4, np.minimum(depth, 8) / 8, np.ones(n)], axis=1
        )
        self.x = x

    def marginals(self, weight: np.ndarray, link: np.ndarray, pairs: bool = False):
        """Sum-product, up and then down: the marginal of "content" of each element, and of linked states if asked for."""
        half = self.x @ weight / 2
        score = np.stack([-half, half], axis=1)
        score[self.dropped, 1] = -60.0
        score[self.bare, 1] = -60.0
        below, message = score.copy(), np.zeros_like(score)
        for level in reversed(self.levels[1:]):
            joint = link[self.kind[level]] + below[level][:, None, :]
            message[level] = np.logaddexp(joint[..., 0], joint[..., 1])
            np.add.at(below, self.parent[level], message[level])
        outside = np.zeros_like(score)
        pair = np.zeros((len(score), 2, 2)) if pairs else None
        for level in self.levels[1:]:
            rest = (outside[self.parent[level]] + below[self.parent[level]] - message[level])[:, :, None] + link[self.kind[level]]
            outside[level] = np.logaddexp(rest[:, 0], rest[:, 1])
            if pairs:
                joint = rest + below[level][:, None, :]
                joint -= joint.max((1, 2), keepdims=True)
                joint = np.exp(joint)
                pair[level] = joint / joint.sum((1, 2), keepdims=True)
        belief = below + outside
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


def labelled_pages(count: int = PAGES, seed: int = 7) -> list[str]:
    """Pages written out from layouts; data-y marks where content begins (1) and ends (0)."""
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)

    def words(low, high):
        return " ".join("".join(rng.choice(("an", "the", "or", "in", "st", "re", "ou", "ed", "ch", "lo", "mi", "ta")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def sentences(low, high):
        return " ".join(words(4, 18).capitalize() + some(".", ".", ".", ", " + words(2, 6) + ".") for _ in range(rng.randint(low, high)))

    def links(low, high, tag="li"):
        return "".join(f'<{tag}><a href="/{words(1, 1)}">{words(1, 3)}</a></{tag}>' for _ in range(rng.randint(low, high)))

    def boilerplate():
        kind = rng.randrange(14)
        long = some(1, 2, 3, 8)  # as long as paragraphs of content: length must not decide
        name = lambda *x: f' {some("class", "id")}="{some("", "", "site-", "page-", "c-")}{some(*x)}"'
        if kind == 0:
            return f"<nav{some('', name('menu', 'main-nav'))}><ul>{links(3, 9)}</ul></nav>"
        if kind == 1:
            return f"<div{name('nav', 'menu', 'navbar', 'breadcrumbs', 'pagination')}>{some(f'<ul>{links(2, 8)}</ul>', links(2, 6, 'span'))}</div>"
        if kind == 2:
            return f"<header{some('', name('header', 'masthead'))}><h1>{words(1, 4)}</h1>{some('', f'<p>{words(3, 9)}</p>', f'<ul>{links(2, 5)}</ul>')}</header>"
        if kind == 3:
            return f"<div{name('header', 'topbar', 'masthead')}><div>{words(1, 4)}</div><p>{sentences(0, long)}</p></div>"
        if kind == 4:
            return f"<footer{some('', name('footer'))}>{some('', '<p>')}&copy; {words(2, 5)} &middot; {sentences(1, long)}</footer>"
        if kind == 5:
            return f"<div{name('footer', 'copyright', 'bottom')}><p>{sentences(1, long)}</p>{some('', f'<ul>{links(2, 6)}</ul>')}</div>"
        if kind == 6:
            return f"<aside{some('', name('sidebar', 'rail'))}><h3>{words(1, 4)}</h3>{some(f'<ul>{links(3, 7)}</ul>', f'<p>{sentences(1, long)}</p>')}</aside>"
        if kind == 7:
            return f"<div{name('sidebar', 'widget', 'side')}><h4>{words(1, 3)}</h4>{some(f'<ul>{links(3, 7)}</ul>', f'<p>{sentences(1, long)}</p>', sentences(1, long))}</div>"
        if kind == 8:
            return f"<div{name('cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'popup')}>{some('<p>', '')}{sentences(1, long)}</div>"
        if kind == 9:
            return f"<{some('div', 'section', 'aside', 'p')}{name('ad', 'ads', 'advert', 'advertisement', 'banner', 'promo', 'sponsored')}>{some('', '<p>')}{sentences(1, long)}"
        if kind == 10:
            return f"<form action='/s'{some('', name('search', 'newsletter'))}><p>{words(2, 8)}</p><label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button></form>"
        if kind == 11:
            return f"<div{name('related', 'share', 'social', 'recommended', 'tags', 'popular')}><h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul></div>"
        if kind == 12:
            one = lambda: f"<{some('div', 'li', 'article')} class='comment{some('', '-body', ' reply')}'><p>{words(1, 2)}</p><p>{sentences(1, long)}</p>"
            inner = "".join(o + {"<d": "</div>", "<l": "</li>", "<a": "</article>"}[o[:2]] for o in (one() for _ in range(rng.randint(1, some(5, 5, 5, 40)))))
            return f"<{(t := some('section', 'div', 'ol'))}{name('comments', 'comment-list', 'discussion', 'responses')}>{inner}</{t}>"
        return f"<div{some('', name('newsletter', 'subscribe', 'login'))}><form><p>{sentences(1, long)}</p></form></div>"

    closed = lambda b: b if b.rstrip().endswith(("</nav>", "</div>", "</header>", "</footer>", "</aside>", "</form>", "</section>", "</ol>")) else b + f"</{re.match(r'<(\w+)', b)[1]}>"

    def block(short):
        if short:  # verse, dialogue, lists of names
            return f"<p>{words(1, 7)}</p>"
        kind = rng.randrange(18)
        if kind == 16:  # where an article lists its sources or parts
            return f"<p>{sentences(1, 3)}</p><{(t := some('ul', 'ul', 'ol'))}>{links(2, 7)}</{t}>"
        if kind == 17:
            return f"<p>{sentences(1, 2)} {some('<svg><path d=x /></svg>', '<button>go</button>', '<audio src=x></audio>')} {sentences(1, 2)}</p>"
        if kind < 9:
            return f"<p>{some('', '', '<b>')}{sentences(1, 7)}{some('</p>', '</p>', '<br>', '')}"
        if kind == 9:
            return f"<h2>{words(1, 6)}</h2><p>{sentences(1, 5)}</p>"
        if kind == 10:
            return f"<ul>{''.join(f'<li>{words(2, 12)}</li>' for _ in range(rng.randint(2, 5)))}</ul>"
        if kind == 11:
            return f"<blockquote>{some('', '<p>')}{sentences(1, 3)}</blockquote>"
        if kind == 12:
            return f"<p>{sentences(1, 3)} <a href='#'>{words(1, 4)}</a> {sentences(1, 2)}</p>"
        if kind == 13:
            return f"<pre>{words(4, 12)}</pre>"
        if kind == 14:
            return f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>"
        return f"<div>{sentences(1, 4)}</div>"

    def marked(b):
        return re.sub(r"^<(\w+)", r'<\1 data-y="0"', closed(b))

    pages = []
    for n in range(count):
        short = rng.random() < 0.2
        body = "".join(block(short) for _ in range(rng.randint(1, 2) if rng.random() < 0.4 else rng.randint(2, some(12, 12, 12, 12, 120))))
        inside = "".join(marked(boilerplate()) for _ in range(some(0, 0, 0, 1, 2)))
        head = some("<h1>{}</h1>", "<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "").format(words(3, 10))
        where = some("article", "article", "article", "article", "main", "section class='content'", "div class='post-content'", "div id='content'", "div class='entry'", "div class='article-body'", "div")
        core = f'<{where} data-y="1">{head}{body}{inside}</{where.split()[0]}>'
        if rng.random() < 0.3:
            core = f"<{(t := some('div', 'main', 'section'))}{some('', ' class=wrap', ' id=main', ' class=content')}>{''.join(marked(boilerplate()) for _ in range(some(0, 1)))}{core}</{t}>"
        before = "".join(marked(boilerplate()) for _ in range(rng.randint(0, 3)))
        behind = "".join(marked(boilerplate()) for _ in range(rng.randint(0, 3)))
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{before}{core}{behind}</body></html>")
    return pages


class TreeModel:
    def __init__(self):
        self.weight, self.link = np.zeros(FEATURES), np.zeros((LINKS, 2, 2))

    def fit(self, sources: list[str]) -> "TreeModel":
        """Maximises the likelihood of the labels (exact gradients by sum-product)."""
        forest = Forest([Page(s) for s in sources])
        y = np.where(forest.dropped, 0, forest.label)
        free = ~forest.dropped
        free[forest.first] = False
        child = np.flatnonzero(free)
        n = len(child)
        seen = np.zeros((LINKS, 2, 2))
        np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1 / n)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.weight, self.link)]
        for epoch in range(1, EPOCHS + 1):
            got, pair = forest.marginals(self.weight, self.link, pairs=True)
            expected = np.zeros((LINKS, 2, 2))
            np.add.at(expected, forest.kind[child], pair[child] / n)
            slopes = (((y - got)[child] / n) @ forest.x[child] - DECAY * self.weight, seen - expected - DECAY * self.link)
            for target, slope, s in zip((self.weight, self.link), slopes, state):
                s[0] = 0.9 * s[0] + 0.1 * slope
                s[1] = 0.99 * s[1] + 0.01 * slope**2
                target += STEP * (s[0] / (1 - 0.9**epoch)) / (np.sqrt(s[1] / (1 - 0.99**epoch)) + 1e-8)
        return self

    def texts(self, sources: list[str]) -> list[list[str]]:
        """The content blocks of each page, in page order."""
        pages = [Page(s) for s in sources]
        forest = Forest(pages)
        got, _ = forest.marginals(self.weight, self.link)
        return [[t for owner, t in p.blocks if (owner < 0 or not p.dropped[owner]) and got[f + 1 + owner] >= 0.5] for p, f in zip(pages, forest.first)]


_TRAINED: list[TreeModel] = []


def trained() -> TreeModel:
    """The model fitted to labelled_pages(), once in this process."""
    if not _TRAINED:
        _TRAINED.append(TreeModel().fit(labelled_pages()))
    return _TRAINED[0]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *, model: TreeModel | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the carried columns, text and n_chars of every page.

    Null and empty pages, and those without content, have the empty text; a page without tags is content. Pages of any length are
    read whole; there are no ties, since each block is judged by itself. Repeated rows stay; other columns are not looked at; an empty table gives an empty result.
    """
    model = model or trained()

    @common.frugal
    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "html"):
                texts = ["\n".join(t) for t in model.texts([h or "" for h in batch.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *batch.columns[2:]], names=["id", "text", "n_chars", *batch.schema.names[2:]]
                )

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    types = "".join(f", carried_{c} {pages.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"id long, text string, n_chars long{types}")


def op9_html_tree(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages; the url goes along in the same pass."""
    pages = common.read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract(pages, carry=("url",)).selectExpr("id as page_id", "carried_url as url", "text", "n_chars")
