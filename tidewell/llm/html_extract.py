"""Main text of HTML pages by the maximum-scoring subsequence of words and tags.

A page becomes a sequence of blocks.  Every word scores the log-odds of lying in an article, given the kind of its block (plain
text, a heading, an item, a table, a link) and the names of the elements around it (tags, roles, words of class and id names);
every block costs the (negative) log-odds of a tag, less where it stays in the container of the block before.  All weights are
counted on labelled pages, which ``labelled_pages`` lays out from the sections below.  One linear scan finds the contiguous run
of blocks of greatest sum, and that run is the article: nothing is added to it afterwards.  Blocks that their surroundings
make score below nothing (an advert between two paragraphs, a list of related links) weigh little in a run and are left out of its text.

What an inline element of such a name holds is left out by itself, and the rest of its paragraph stays; if it never closes, only what
is hidden is left out.  Hidden elements are no text at all.

Defined cases: a null or empty page, and one without any text, give an empty text; broken markup (unclosed or stray
tags, an end in the middle of a tag) is read as far as it goes; scripts, styles and comments that never close
run to the end of the page; ties go to the earliest run; null ids and repeated rows are kept; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._shared import bound_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>|<(?:/?[a-zA-Z][^>]*)?\Z|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "label"}
#: Elements whose class and id names say nothing of what they hold, and openings of names that tell a state.
KEEP = {"article", "main", "body", "html"}
STATES = {"has", "with", "no", "not", "without", "is", "js"}
LEAVES = {"p", "li", "ul", "ol", "blockquote", "table", "tbody", "thead", "tr", "td", "th", "pre", "figure", "figcaption", "dl", "dt", "dd"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PIECE = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


def _features(name: str, tag: str) -> tuple[list[str], bool]:
    """Features of an element (tag, role, words of class and id names), and whether it is hidden."""
    out, hidden = [f"<{name}>"], False
    if name in ("html", "body") or len(tag) <= len(name) + 2:
        return out, hidden
    for m in _ATTRIBUTE.finditer(tag, len(name) + 1):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" and value.lower() != "false" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif key == "role":
            out.append(f"role {value.lower()}")
        elif key in ("class", "id") and name not in KEEP:
            for token in value.split():
                words = [w.lower() for w in _PIECE.findall(token)]
                if words and words[0] not in STATES:
                    out += [w for w in words if w not in out]
    return out, hidden


class Block:
    """A run of text between block tags: its text, its words in links, its kind, its container and the features around it."""

    __slots__ = ("container", "kind", "linked", "path", "text", "words")

    def __init__(self, text: str, linked: int, kind: str, container: tuple, path: tuple):
        self.text, self.linked, self.kind, self.container, self.path = text, linked, kind, container, path
        self.words = len(text.split())


def blocks(page: str, names: Names | None = None) -> list[Block]:
    """Blocks of a page in order.  With ``names``, inline elements that they speak against are left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, int, int]] = []  # name, features, number, 2: hidden, 1: inline and left out, 0: neither
    parts: list[tuple[str, int]] = []  # a piece of text and the greatest mark of what is open around it
    linked = link = number = at = 0
    marks = [0, 0, 0]

    def mark() -> int:
        return 2 if marks[2] else 1 if marks[1] else 0

    def flush() -> None:
        nonlocal linked
        if parts:
            most = 2 if marks[1] else 1  # an inline element that is still open here was never closed
            text = " ".join("".join(x if m < most else " " for x, m in parts).split())
            if text:
                tags = [x[0] for x in stack]
                kind = "heading" if HEADINGS.intersection(tags[-3:]) else "item" if "li" in tags[-4:] else "table" if "td" in tags[-4:] or "th" in tags[-4:] else "text"
                own = [x for x in stack if x[0] not in INLINE and x[0] not in LEAVES and x[0] not in HEADINGS]
                titled = kind == "heading" and "article" in tags  # an article's own header holds its title
                path = tuple(x[1] for x in stack if x[3] != 1 and not (titled and x[0] == "header" and tags.index("article") < stack.index(x)))
                out.append(Block(text, linked, kind, tuple(x[2] for x in own), path))
            parts.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal link
        while len(stack) > to:
            name, _, _, m = stack.pop()
            marks[m] -= m > 0
            link -= name == "a"

    while at < len(page):
        m = _TOKEN.match(page, at)
        token = m[0]
        at = m.end()
        if token[0] != "<" or token == "<":
            text = html.unescape(token)
            parts.append((text, mark()))
            if link:
                linked += len(text.split())
            continue
        if token[1:2] in "!?" or not token.endswith(">"):
            continue
        name = _NAME.match(token)
        if not name:
            continue
        name, closing = name[1].lower(), token[1] == "/"
        inline = name in INLINE
        if name == "br" or name == "hr":
            parts.append((" ", 0))
            if name == "hr":
                flush()
            continue
        if not inline:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in ("article", "main", "section", "div", "td", "body", "nav", "aside", "footer", "header", "form") and (inline or name in ("p", "li")):
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*/?\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or token.endswith("/>") and name in ("path", "rect"):
            continue
        if not inline:  # an open paragraph, heading or item ends, with what is open in it
            own = {"li"} if name == "li" else {"dt", "dd"} if name in ("dt", "dd") else {"tr", "td", "th"} if name == "tr" else {"td", "th"} if name in ("td", "th") else {"p"}
            fence = {"ul", "ol"} if name == "li" else {"table"} if name in ("tr", "td", "th") else set()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in own:
                    close(i)
                    break
                if stack[i][0] not in INLINE and (stack[i][0] in fence or name not in ("li", "tr", "td", "th")):
                    break
        features, hidden = _features(name, token)
        own = 2 if hidden else 1 if inline and len(features) > 1 and names and names.of(features) <= INLINE_OUT else 0
        number += 1
        stack.append((name, tuple(features), number, own))
        marks[own] += own > 0
        link += name == "a"
    flush()
    return out


#: Sections of the labelled pages, by what they hold.  Fixed values: names that elements around articles have.
ARTICLE = "article post entry story content main body text prose chapter lead paragraph section copy".split()
#: Names that stand around parts of an article as well as beside it, and those that mostly stand beside it.
EITHER = "side foot alert legal register search tags popular rail note rating disclaimer".split()
SELDOM = "discussion reply".split()
BESIDE = """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus submenu
breadcrumb breadcrumbs crumbs pagination pager header masthead topbar toolbar footer colophon sidebar aside widget widgets related recommended
recommendations recirc trending cookie cookies consent gdpr notice notices notification popup modal overlay paywall newsletter subscribe subscription signup
login form comment comments commentlist disqus respond replies share sharing social copyright skip""".split()
TAGS_BESIDE = "nav header footer aside form head button select option dialog menu svg canvas object audio video map fieldset math".split()
ROLES_BESIDE = "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note doc-footnote status".split()


def _prose(n: int, start: int) -> str:
    words = "the river rose after three days of rain and people carried what they could to school where beds stood ready for night".split()
    return " ".join(words[(start + 7 * i) % len(words)] for i in range(n))


def labelled_pages() -> list[str]:
    """Pages of sections in turn; blocks marked ``data-label="1"`` are article, all others with text are not."""
    kinds = [("p", 1, 28), ("h2", 1, 5), ("p", 1, 45), ("ul", 1, 14), ("p", 1, 6), ("blockquote", 1, 18), ("p", 1, 33), ("table", 1, 9)]
    aside = [f'<div class="{x}">' for x in BESIDE + EITHER + 5 * SELDOM] + [f"<{x}>" for x in TAGS_BESIDE] + [f'<div role="{x}">' for x in ROLES_BESIDE] + ["<div>"] * 40
    frames = [f'<div class="{x}">' for x in ARTICLE] + ["<article>", "<main>", "<section>", "<div>", "<div>", "<div>"]
    parts = [f'<div class="{x}">' for x in EITHER + SELDOM]
    pages = []
    for n, around in enumerate(frames * 5 + parts):
        def block(k: int, label: bool) -> str:
            tag, _, size = kinds[k % len(kinds)]
            mark, text = ' data-label="1"' if label else "", _prose(size, n + k)
            if tag == "ul":
                return f"<ul><li{mark}>{text}</li><li{mark}>{text}</li></ul>"
            return f"<table><tr><td{mark}>{text}</td></tr></table>" if tag == "table" else f"<{tag}{mark}>{text}</{tag}>"

        def beside(k: int) -> str:
            start = aside[(5 * n + k) % len(aside)]
            links = " ".join(f'<a href="/{i}">{_prose(2, i)}</a>' for i in range(4))
            inside = f"<ul><li>{links}</li></ul>" if k % 3 else f"<p>{_prose(12, k)}</p><p>{links}</p>"
            more = (n + k) % 12  # a few sections have a heading, an item or a cell that is no link
            inside += f"<h3>{_prose(2, k)}</h3>" if more == 0 else f"<ul><li>{_prose(5, n)}</li></ul>" if more == 4 else f"<table><tr><td>{_prose(2, n)}</td></tr></table>" if more == 8 else ""
            return start + inside + "</" + re.match(r"<(\w+)", start)[1] + ">"

        close = "</" + re.match(r"<(\w+)", around)[1] + ">"
        before, after = "".join(beside(k) for k in range(2)), "".join(beside(k) for k in range(2, 5))
        pages.append(f"<body>{before}{around}{''.join(block(n + k, True) for k in range(6 if n < 5 * len(frames) else 4))}{close}{after}</body>")
    return pages


def _class(b: Block) -> str:
    return "link" if b.linked > 0.5 * b.words else b.kind


class Names(dict):
    """Log-odds of features of elements; those not met on the labelled pages say nothing."""

    #: How far one feature, and all around a block together, can speak against or for it.
    ONE, ALL = (-4.0, 1.5), (-8.0, 2.0)

    def of(self, features: tuple | list) -> float:
        return sum(self.get(f, 0.0) for f in features)

    def around(self, path: tuple) -> float:
        return min(max(sum(self.of(x) for x in path), self.ALL[0]), self.ALL[1])


def fit_weights(pages: list[str] | None = None) -> tuple[dict[str, float], Names]:
    """Log-odds of words by the kind of their block, of a block's tag ("tag"), and of words by each feature around them."""
    kinds, names = ({"tag": 0.5}, {"tag": 0.5}), ({}, {})
    for page in pages or labelled_pages():
        for b in blocks(re.sub(r'(<[^>]*data-label="1"[^>]*>)', "\\1\u0001", page)):
            side = "\u0001" not in b.text
            kinds[side][_class(b)] = kinds[side].get(_class(b), 0.5) + b.words
            kinds[side]["tag"] += 1 + b.linked
            for f in {f for x in b.path for f in x}:
                names[side][f] = names[side].get(f, 0.0) + b.words
    total = [sum(v for k, v in side.items() if k != "tag") for side in kinds]
    odds = lambda a, b: math.log((a / total[0]) / (b / total[1]))
    own = {k: odds(kinds[0].get(k, 0.5), kinds[1].get(k, 0.5)) for k in set(kinds[0]) | set(kinds[1])}
    own["tag"] = min(own["tag"], -0.5)
    lo, hi = Names.ONE
    few = 8.0  # words that a feature counts as met on either side
    got = {f: min(max(odds(names[0].get(f, 0.0) + few, names[1].get(f, 0.0) + few), lo), hi) for f in set(names[0]) | set(names[1])}
    return own, Names({f: w for f, w in got.items() if f in KNOWN})


#: Features that may tell; paragraphs and the like only carry kinds.
KNOWN = {*ARTICLE, *EITHER, *SELDOM, *BESIDE, *(f"<{x}>" for x in [*TAGS_BESIDE, "article", "main"]), *(f"role {x}" for x in ROLES_BESIDE)}
#: What a word that its surroundings speak against weighs, the most that one block of them takes from a run, and the
#: share of a tag's cost for a block in the container of the one before (else each container between costs a tag).
UNWANTED, MOST, SAME = -0.5, 12.0, 0.1
#: What the names of an inline element must weigh for it to be left out.
INLINE_OUT = -1.5
WEIGHTS, NAMES = fit_weights()


def scores(found: list[Block], weights: dict[str, float], names: Names) -> list[tuple[float, float, bool]]:
    """For each block what its words score, what it costs to go on to it from the block before, and whether it is text of the article."""
    out, last = [], ()
    for b in found:
        own = weights.get(_class(b), 0.0)
        around = names.around(b.path)
        if around < 0 and own + around < 0:
            out.append((max(UNWANTED * b.words, -MOST), 0.0, False))
            continue
        both = sum(1 for x, y in zip(b.container, last, strict=False) if x == y)
        tags = len(b.container) + len(last) - 2 * both  # containers that end or begin in between
        out.append((b.words * (own + around), weights["tag"] * (tags or SAME), True))
        last = b.container
    return out


def best_run(values: list[tuple[float, float]]) -> tuple[int, int]:
    """The contiguous run of greatest score (words, and costs between its blocks), the earliest of equal ones; (0, 0) if none is above 0."""
    best, at, run, begin = 0.0, (0, 0), 0.0, 0
    for i, (gain, cost) in enumerate(values):
        if run + cost <= 0:
            run, cost, begin = 0.0, 0.0, i
        run += cost + gain
        if run > best:
            best, at = run, (begin, i + 1)
    return at


def extract(page: str, weights: dict[str, float] = WEIGHTS, names: Names = NAMES) -> str:
    """The article's text: its blocks in order, joined by one space."""
    found = blocks(page, names)
    got = scores(found, weights, names)
    low, high = best_run([x[:2] for x in got])
    if low == high:  # nothing speaks for an article: what neither surroundings nor links speak against
        low, high = 0, len(found)
        got = [(*x[:2], x[2] and _class(b) != "link") for b, x in zip(found, got, strict=True)]
    return " ".join(b.text for b, x in zip(found[low:high], got[low:high], strict=True) if x[2])


SCHEMA = "page_id long, url string, text string, n_chars long"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(x.as_py() or "") for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its code points for every row."""
    bound_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_batches, SCHEMA)
