"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word's score depends on the
elements it stands in, a tag costs; a linear scan finds the contiguous region
of largest total score, and elements that are no article text (menus,
adverts, forms, comments, ...) are left out of it. The weights are learned
from pages that mark their article, with that mark hidden from the features;
where a page has it, it adds a fixed bonus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .toxicity import logistic

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?][^>]*+>""",
    re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME_PART = re.compile(r"[a-z]+")
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                     "pre section table ul figure details".split())
HIDDEN = frozenset((*RAW, "head", "select", "button", "option", "object", "nav", "footer", "aside", "form", "menu", "dialog"))
# Parts of class, id and role names of elements that hold no article text, and of those that do.
BESIDE = frozenset("ad ads advert adverts advertisement advertising banner promo sponsor sponsored nav navigation navbar menu "
                   "menubar sidebar aside footer masthead topbar breadcrumb breadcrumbs cookie cookies consent notice notices "
                   "alert popup modal subscribe newsletter signup login form search share sharing social related "
                   "recommended comment comments respond reply replies disqus pagination pager widget "
                   "complementary contentinfo".split())
CONTENT = frozenset("article main post entry story content body text".split())
# Parts that say so only as a name's last part or among parts of BESIDE, CONTENT and FILLER; form not even as the last.
AMBIGUOUS = frozenset("form search share sharing social notice notices alert login consent reply replies respond modal widget".split())
FILLER = frozenset("area bar block box button buttons container field group icon icons inner input item items label link links list "
                   "message outer overlay panel row section slot title unit wrap wrapper".split())
LAYOUT = frozenset("has no with without".split())  # the part after one of these is not what the element is
COMMENTS = frozenset("comment comments disqus".split())
# How firmly an element is left out. LOOSE: not where it is or holds an article. FIRM: not where it holds all the page's
# articles. THREAD: readers' comments, which may be articles themselves. Where one holds the main element it stays.
LOOSE, FIRM, THREAD = 1, 2, 3
FIRM_ELEMENTS = frozenset("nav footer aside".split())
MARKED = frozenset(("article", "main"))
MAX_SAMPLE = 2_000        # labelled pages used for fitting, at most about
PRIOR_WORDS = 40.0        # words that each hint counts as in the fit
WORD_LIMIT, TAG_LIMITS, MARK_BONUS = 4.0, (0.05, 1.0), 2.0


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    features: tuple[str, ...]
    hidden: bool
    marked: bool
    tags: tuple[str, ...]  # tags since the block before
    costly: tuple[str, ...]  # those of them that stand in no hidden element


@lru_cache(maxsize=20_000)
def _name(name: str) -> tuple[frozenset, int]:
    """Parts of one class, id or role that count as features, and how firmly it leaves its element out (0: not)."""
    parts = NAME_PART.findall(name)
    parts = [p for i, p in enumerate(parts) if not (p in LAYOUT or (i and parts[i - 1] in LAYOUT))]
    beside = BESIDE.intersection(parts)
    if not beside:
        return frozenset(parts), 0
    if beside & COMMENTS:
        return frozenset(parts), THREAD
    if beside - AMBIGUOUS:
        return frozenset(parts), FIRM
    if (parts[-1] in beside and parts[-1] != "form") or all(p in BESIDE or p in CONTENT or p in FILLER for p in parts):
        return frozenset(parts), LOOSE
    return frozenset(parts) - BESIDE, 0


def _names(attributes: str) -> tuple[frozenset, int, bool]:
    """Features of an element's names, how firmly they leave it out, and whether its role is main."""
    parts, rank, main = frozenset(), 0, False
    for m in ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            more, firm = _name(name)
            parts, rank = parts | more, max(rank, firm)
            main |= name == "main" and m[1].lower() == "role" and attributes[m.start() - 1:m.start()] != "-"
    return parts, rank, main


@dataclass(slots=True)
class _Element:
    name: str
    features: frozenset
    hidden: bool
    marked: bool
    nth: int
    rank: int
    mains: int      # main and article elements opened before it
    articles: int


class _Page:
    """Open elements while a page is read; each knows its features and whether it is hidden.

    ``never`` holds the numbers of elements that hide nothing.
    """

    def __init__(self, never: frozenset = frozenset()):
        self.never, self.n, self.mains, self.articles = never, 0, 0, 0
        self.holders: list[tuple[int, int, int, int]] = []
        self.places: dict[str, list[int]] = {}   # places in the stack of the open elements of each name
        self.stack = [_Element("", frozenset(), False, False, 0, 0, 0, 0)]

    def open(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self.close_to("p", ("button", "td", "th", "li"))
        if name in ("li", "tr", "td", "th", "dd", "dt", "option"):
            self.close_to(name, ("ul", "ol", "table", "dl", "select"))
        if name in VOID:
            return
        top = self.stack[-1]
        self.n += 1
        parts, rank, main = _names(attributes) if attributes and "=" in attributes else (frozenset(), 0, False)
        if name in HIDDEN or (name == "header" and not top.marked):
            rank = max(rank, FIRM if name in FIRM_ELEMENTS else LOOSE)
        own = {name}
        if name in ("html", "body") or self.n in self.never:
            parts, own, rank = parts - BESIDE, own - HIDDEN, 0
        main |= name == "main"
        mark = main or name in MARKED
        if mark:
            parts, own = parts - MARKED, own - MARKED
        own = own | {"." + p for p in parts}
        features = top.features if own <= top.features else top.features | own
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(_Element(name, features, top.hidden or rank > 0, top.marked or mark, self.n, rank, self.mains, self.articles))
        self.mains += main
        self.articles += mark and not main

    def close_to(self, name: str, limits: tuple[str, ...] = ()) -> None:
        """Close the innermost open ``name`` unless one of ``limits`` stands inside it; the cost does not grow with the depth."""
        own = self.places.get(name)
        if own and all(not p or p[-1] < own[-1] for p in map(self.places.get, limits)):
            self.close_from(own[-1])

    def close_from(self, k: int) -> None:
        for e in self.stack[k:]:
            self.places[e.name].pop()
            if e.rank and (self.mains, self.articles) != (e.mains, e.articles):
                self.holders.append((e.nth, e.rank, self.mains - e.mains, self.articles - e.articles))
        del self.stack[k:]

    def wrongly_hidden(self) -> frozenset:
        """Numbers of the elements that would have hidden the article, once the page is read."""
        self.close_from(1)
        return frozenset(nth for nth, rank, mains, articles in self.holders
                         if mains or rank == LOOSE or (rank == FIRM and articles == self.articles and not self.mains))


def blocks(html: str) -> list[Block]:
    """Blocks of a page in order; broken markup is read as browsers mostly do.

    A page whose article stands in an element that would hide it is read again without that.
    """
    page = _Page()
    out = _read(html, page)
    never = page.wrongly_hidden()
    return _read(html, _Page(never)) if never else out


def _read(html: str, page: _Page) -> list[Block]:
    out, held, tags, costly, at = [], [], [], [], 0
    state = page.stack[-1]

    def end():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(Block(text, tuple(sorted(state.features)), state.hidden, state.marked, tuple(tags), tuple(costly)))
            tags.clear()
            costly.clear()

    def say(part: str):
        nonlocal state
        if part:
            if not held or part.strip():
                top = page.stack[-1]
                if not any(h.strip() for h in held):
                    state = top
                elif top.hidden != state.hidden:       # an inline element that is hidden, or the end of one
                    end()
                    state = top
            held.append(unescape(part) if "&" in part else part)

    while m := TOKEN.search(html, at):
        say(html[at:m.start()])
        at = m.end()
        closing, name = m[1] or m[4], (m[2] or m[5] or "").lower()
        if not name:
            continue
        tags.append(name)
        if name not in INLINE:
            end()
        if closing:
            if not page.stack[-1].hidden:
                costly.append(name)
            page.close_to(name)
            continue
        page.open(name, m[3] or "")
        if not page.stack[-1].hidden:
            costly.append(name)
        if name in RAW and not m[0].endswith("/>"):
            stop = re.compile(f"</{name}", re.IGNORECASE).search(html, at)
            at = stop.start() if stop else len(html)
    say(html[at:])
    end()
    return out


@dataclass
class Model:
    bias: float
    features: dict[str, float]
    tags: dict[str, float]
    other_tag: float

    def extract(self, html: str | None) -> str:
        """Text of the best region, blocks joined by one space; hidden elements
        are left out of it and cost nothing, however long they are."""
        page = [b for b in blocks(html or "")]
        best, best_at, run, start = 0.0, (0, 0), 0.0, 0
        for i, b in enumerate(page):
            cost = sum(self.tags.get(t, self.other_tag) for t in b.costly)
            run += cost
            if run <= 0:
                run, start = 0.0, i
            run += 0.0 if b.hidden else self.word(b) * (b.text.count(" ") + 1)
            if run > best:
                best, best_at = run, (start, i + 1)
            if run <= 0:
                run, start = 0.0, i + 1
        return " ".join(b.text for b in page[slice(*best_at)] if not b.hidden)

    def word(self, b: Block) -> float:
        if not set(b.features) - {"html", "body"}:
            return 0.5  # text in no element that says anything counts a little
        z = self.bias + sum(self.features.get(f, 0.0) for f in b.features) + (MARK_BONUS if b.marked else 0.0)
        return max(-WORD_LIMIT, min(WORD_LIMIT, z))


def hints() -> Counter:
    """(features, inside) pattern weights that stand for what is known before any page is seen."""
    n = Counter()
    for name in HIDDEN:
        n[((name,), 0)] += PRIOR_WORDS
    for part in BESIDE:
        n[(("." + part,), 0)] += PRIOR_WORDS
    for name in ("p", "h1", "h2", "h3", "blockquote", "pre", "li"):
        n[((name,), 1)] += PRIOR_WORDS
    for part in CONTENT:
        n[(("." + part,), 1)] += PRIOR_WORDS
    n[(("a", "li"), 0)] += PRIOR_WORDS
    return n


def _patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts over marked pages: words by (features, inside), tags by (name, inside)."""
    for pdf in batches:
        words, tags = Counter(), Counter()
        for html in pdf["html"]:
            page = blocks(html)
            if not any(b.marked for b in page):
                continue
            for b in page:
                if "head" not in b.features:
                    words["\t".join(b.features), int(b.marked and not b.hidden)] += b.text.count(" ") + 1
                    for t in b.tags:
                        tags[t, int(b.marked and not b.hidden)] += 1
        rows = [("word", k, i, n) for (k, i), n in words.items()] + [("tag", k, i, n) for (k, i), n in tags.items()]
        yield pd.DataFrame({"kind": pd.Series([r[0] for r in rows], dtype=object), "name": pd.Series([r[1] for r in rows], dtype=object),
                            "inside": pd.Series([r[2] for r in rows], dtype="int32"), "n": pd.Series([r[3] for r in rows], dtype="int64")})


def fit(pages: DataFrame, html_col: str = "html", max_sample: int = MAX_SAMPLE) -> Model:
    """Weights from pages that mark their article (``article`` or ``main``).

    At most about ``max_sample`` pages are read for it, picked by a hash of
    their html; what is collected (patterns of element names) is bounded by
    that parameter. Without marked pages the hints alone give the weights.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(html_col).alias("html")).where(F.col("html").isNotNull())
    parts = max(1, -(-rows.count() // max_sample))
    rows = rows.where(F.pmod(F.xxhash64("html"), F.lit(parts)) == 0)
    seen = rows.mapInPandas(_patterns, "kind string, name string, inside int, n long") \
        .groupBy("kind", "name", "inside").agg(F.sum("n").alias("n")).collect()
    patterns = hints()
    total = sum(r.n for r in seen if r.kind == "word") or 1
    scale = 50 * PRIOR_WORDS / total   # the pages weigh as much as fifty hints, whatever their number
    for r in seen:
        if r.kind == "word":
            patterns[tuple(r.name.split("\t")) if r.name else (), r.inside] += r.n * max(scale, 1e-9)
    names = sorted({f for fs, _ in patterns for f in fs} - {"html", "body"})
    place = {f: i for i, f in enumerate(names)}
    x, y, w = [], [], []
    for (fs, inside), n in sorted(patterns.items()):
        row = np.zeros(len(names))
        row[[place[f] for f in fs if f in place]] = 1
        x.append(row)
        y.append(inside)
        w.append(n)
    weights = logistic(np.array(x), np.array(y, float), np.zeros(len(names)), ridge=0.5, weight=np.array(w))
    inside, outside = Counter(), Counter()
    for r in seen:
        if r.kind == "tag":
            (inside if r.inside else outside)[r.name] += r.n
    n_in, n_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    tags = {t: -float(np.clip(np.log((outside[t] + 0.5) / n_out) - np.log((inside[t] + 0.5) / n_in), *TAG_LIMITS))
            for t in inside | outside}
    return Model(float(weights[0]), dict(zip(names, weights[1:].tolist())), tags, -TAG_LIMITS[0])


def extract_pages(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every row of ``pages``.

    Null and empty html give an empty text; null ids and urls stay null;
    repeated rows are read alike; long pages are read whole; an empty table
    gives no rows; other columns are not read.
    """
    ship(pages.sparkSession)
    model = model or fit(pages, html_col)
    ids = pages.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [model.extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())],
                                             names=["page_id", "url", "text"])

    return pages.select("page_id", "url", html_col).mapInArrow(work, f"page_id {ids}, url string, text string")
