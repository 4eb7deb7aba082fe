"""HTML extraction by tag-path ratios.

A page's blocks are grouped by their path of tags from the root. For each path the text length and the
punctuation are added up and set against its number of tags; the fused ratios are smoothed over the paths
beside it in page order and with the ratio of the container around it, and lessened by the share of link text.
That gives a path up to 1. What its tags, roles and class names say moves the score by less: boilerplate by
element, role or name counts against all paths inside, half as much within an article; an article or main
element counts for its paths by its share of the page's text. The threshold comes from the page's scores: they
are split where the variance between the two sides is largest, if the sides lie clearly apart; else all is
content. So a name alone takes nothing away from a page whose other text is no better. The blocks of content
paths are returned whole and in page order.

Paths are interned as (parent path, name), so a page's memory grows with its size, not with its depth.
"""

from __future__ import annotations

import html
import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content is text up to the end tag; only xmp's is shown.
RAW = frozenset("script style textarea title iframe noembed noframes xmp annotation".split())
#: Never shown, or part of a form control.
DEAD = frozenset("head template select datalist option optgroup object audio video canvas defs metadata desc".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr "
    "math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mpadded mphantom menclose mtable mtr mtd semantics "
    "svg g path circle rect line polyline polygon ellipse use text tspan textpath symbol image marker lineargradient radialgradient stop".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("html body table td th ul ol dl article section main div aside nav form button".split())
BOILERPLATE = frozenset("nav header footer aside menu button dialog fieldset input search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody table pre blockquote figure figcaption html body article main".split())
# Words of class names and ids of adverts and notices, of other parts, of comments, and such as hardly say anything.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored sponsors promo promoted banner cookie cookies consent gdpr".split())
PARTS = frozenset("sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead notice notices popup modal overlay newsletter subscribe signup share sharing pagination pager login skip toolbar".split())
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
HINTS = frozenset("aside side header response responses reply related recommended social widget widgets search form copyright legal disclaimer tags hidden foot".split())
#: Names like page-with-sidebar are about the page's layout.
LAYOUT = frozenset("with has no without wrapper wrap layout page container main content".split())
CONTAINERS = frozenset("article main section div td body".split())

#: What counts against a path: parts by element, role or name; comments; weak names. What an article counts for it.
AGAINST, COMMENT, HINT, ARTICLE = 0.7, 0.9, 0.15, 0.5
#: The least distance of the two sides' means; what a part needs on its own, its ratio set against that of plain prose.
APART, ALONE, PROSE = 0.45, 0.2, math.log1p(100) + math.log1p(2)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))|(?<![^\s\"'])(hidden)(?=[\s/]|\Z)")
RUN = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")
#: Whether a code point is punctuation.
MARKS = np.fromiter((unicodedata.category(chr(c))[0] == "P" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def attributes(source: str) -> dict[str, str]:
    """Names in lower case with their values; of those without one only ``hidden`` matters."""
    return {(m[0] or m[4]).lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(source)} if source.strip(" /\n") else {}


def named(tag: str, names: str) -> float:
    """What an element's class names and id count against it."""
    worst = 0.0
    for name in names.lower().split():
        words = set(WORDS.findall(name))
        if words & LAYOUT:
            continue
        if words & COMMENTS and tag not in TEXTUAL - {"article"}:
            return COMMENT
        if words & ADVERTS or (words & PARTS and tag not in TEXTUAL):
            worst = AGAINST
        elif words & (HINTS | PARTS | COMMENTS):
            worst = max(worst, HINT)
    return worst


class Page:
    """The blocks of a page and, for each path of tags, its counts and features."""

    def __init__(self, page: str):
        #: (path, text, characters in links), in page order.
        self.blocks: list[tuple[int, str, int]] = []
        self.ids: dict[tuple[int, str], int] = {}
        self.parent, self.tags, self.tag = [-1], [0], [""]
        #: What counts against a path, the container around it, the nearest one with itself, the article around it (or -1), whether it is never shown, a form around it.
        self.against, self.container, self.inner, self.article, self.dead, self.form = [0.0], [0], [0], [-1], [False], [-1]
        self.read(page)

    def path(self, parent: int, tag: str, a: dict[str, str]) -> int:
        name = f"{tag}.{a.get('class', '')}#{a.get('id', '') if tag in CONTAINERS else ''}@{a.get('role', '')}{'!' if self.unseen(a) else ''}"
        k = self.ids.get((parent, name))
        if k is None:
            k = self.ids[parent, name] = len(self.parent)
            self.parent.append(parent)
            self.tags.append(0)
            self.tag.append(tag)
            inside = self.article[parent] >= 0
            role = a.get("role", "").lower()
            own = named(tag, f"{a.get('class', '')} {a.get('id', '')}") if tag not in ("html", "body", "article", "main") or inside else 0.0
            if own == AGAINST and inside:
                own /= 2
            if (tag in BOILERPLATE and not (tag == "header" and inside)) or role in ROLES:
                own = max(own, AGAINST if not inside or tag in ("nav", "footer", "aside") or role in ROLES else AGAINST / 2)
            # Weak hints add up, a strong one covers what is inside it.
            before = self.against[parent]
            self.against.append(max(before, own) if max(before, own) > 2 * HINT else min(2 * HINT, before + own))
            self.container.append(self.inner[parent])
            self.inner.append(k if tag in CONTAINERS else self.inner[parent])
            self.article.append(self.article[parent] if inside else k if tag in ("article", "main") or role in ("article", "main") else -1)
            self.dead.append(self.dead[parent] or tag in DEAD or self.unseen(a))
            self.form.append(self.form[parent] if self.form[parent] >= 0 else k if tag == "form" else -1)
        self.tags[k] += 1
        return k

    @staticmethod
    def unseen(a: dict[str, str]) -> bool:
        return "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*+:\s*+none", a.get("style", "")))

    def read(self, page: str) -> None:
        stack, tags = [0], [""]  # open paths and their tags
        places: dict[str, list[int]] = {}  # where in the stack each tag is open
        scopes = [0]
        held: list[str] = []
        linked, link, silent = 0, 0, False  # link: the stack's length where a link is open; silent: inside rp

        def flush():
            nonlocal linked
            if held:
                text = RUN.sub(" ", "".join(held)).strip()
                if text and not self.dead[stack[-1]]:
                    self.blocks.append((stack[-1], text, linked))
                held.clear()
            linked = 0

        def close(k: int):
            nonlocal link
            for tag in tags[k:]:
                places[tag].pop()
            del stack[k:], tags[k:]
            while scopes[-1] >= k:
                scopes.pop()
            if link > k:
                link = 0

        def close_any(ends) -> None:
            """Close open elements of ``ends``, each as far as no other scope is open inside it."""
            while True:
                k = max((places[t][-1] for t in ends if places.get(t)), default=0)
                if not k or scopes[-1] > k:
                    return
                close(k)

        at, end = 0, len(page)
        while at < end:
            m = TOKEN.match(page, at)
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                t = m[0]
                if (t[0] != "<" or t == "<") and not silent:
                    t = html.unescape(t)
                    held.append(t)
                    linked += len(t) if link else 0
                elif t.startswith("<![CDATA["):
                    held.append(t[9:-3] if t.endswith("]]>") else t[9:])
                continue
            closing, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
            silent = tag == "rp" and not closing
            if tag in RAW:
                if not closing and not rest.endswith("/"):
                    stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>|\Z", re.I).search(page, at)
                    if tag == "xmp":
                        flush()
                        held.append(page[at : stop.start()])
                        flush()
                    at = stop.end()
                continue
            if tag in INLINE:
                if tag == "a":
                    link = 0 if closing else len(stack)
                elif tag == "br":
                    held.append(" ")
                continue
            flush()
            if closing:
                if places.get(tag) and not (tag == "p" and scopes[-1] > places[tag][-1]):
                    close(places[tag][-1])
                continue
            if tag in CLOSES_OWN:
                close_any(CLOSES_OWN[tag])
            if tag in CLOSES_P:
                close_any(("p",))
            if tag in VOID or tag in ("html", "body", "head") and places.get(tag):
                continue
            if tag == "body" and places.get("head"):
                close(places["head"][-1])
            k = self.path(stack[-1], tag, attributes(rest))
            places.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append(k)
            tags.append(tag)
        flush()


def smoothed(x: np.ndarray) -> np.ndarray:
    """A Gaussian over three neighbours each way; the ends count as their own neighbours."""
    w = np.exp(-0.5 * np.arange(-3, 4) ** 2)
    return np.convolve(np.pad(x, 3, mode="edge"), w / w.sum(), "valid")


def fused(chars: np.ndarray, marks: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Text and punctuation for each tag."""
    tags = np.maximum(tags, 1)
    return np.log1p(chars / tags) + np.log1p(marks / tags)


def ratios(page: Page, paths: np.ndarray, chars: np.ndarray, links: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The smoothed and fused ratio of each path, 1 for what most of the page's text has."""
    tags = np.array(page.tags, float)
    own = fused(chars, marks, tags[paths])
    plain = chars - links
    top = max(1e-9, np.average(own, weights=plain) if plain.sum() else own.max())
    # Of the container around a path: all that stands in it, itself included.
    inner, sums = np.array(page.inner), np.zeros((3, len(tags)))
    np.add.at(sums[0], inner[paths], plain)
    np.add.at(sums[1], inner[paths], marks * plain / np.maximum(chars, 1))
    np.add.at(sums[2], inner, tags)
    for k in range(len(tags) - 1, 0, -1):  # what is in a container is in the one around it
        if inner[k] == k:
            sums[:, page.container[k]] += sums[:, k]
    around = fused(*sums)[np.array(page.container)[paths]]
    mixed = 0.5 * smoothed(np.minimum(own / top, 1)) + 0.5 * np.minimum(around / top, 1)
    return mixed * (1 - links / np.maximum(chars, 1))


def leaning(page: Page, paths: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What tags, roles and names say against each path, and for it: an article by its share of the text."""
    against, article, form = (np.array(x)[paths] for x in (page.against, page.article, page.form))
    inside = article >= 0
    total = max(1.0, chars.sum())
    # A form around most of the page is the page.
    for f in np.unique(form[form >= 0]).tolist():
        if chars[form == f].sum() < 0.5 * total:
            against = np.where(form == f, np.maximum(against, np.where(inside, AGAINST / 2, AGAINST)), against)
    free = against < AGAINST
    share = 4 * chars[free & inside].sum() / max(1.0, chars[free].sum())
    return against, np.where(inside, ARTICLE * min(1.0, share), 0.0)


def threshold(scores: np.ndarray, weights: np.ndarray) -> float:
    """Where the variance between what is above and below is largest; below all scores if the two are not clearly apart."""
    order = np.argsort(scores)
    x, w = scores[order], weights[order]
    below, sums = np.cumsum(w)[:-1], np.cumsum(w * x)[:-1]
    cuts = np.flatnonzero(np.diff(x) > 1e-9)
    if not len(cuts):
        return -np.inf
    low, high = sums[cuts] / below[cuts], ((w * x).sum() - sums[cuts]) / (w.sum() - below[cuts])
    best = int(np.argmax(below[cuts] * (w.sum() - below[cuts]) * (high - low) ** 2))
    return (x[cuts[best]] + x[cuts[best] + 1]) / 2 if high[best] - low[best] >= APART else -np.inf


def content(page: Page) -> set[int]:
    """The paths whose score reaches the threshold."""
    sums: dict[int, list[float]] = {}
    for k, text, linked in page.blocks:
        p = sums.setdefault(k, [0.0, 0.0, 0.0])
        p[0] += len(text)
        p[1] += linked
        p[2] += MARKS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].sum()
    if not sums:
        return set()
    paths = np.array(list(sums))
    chars, links, marks = np.array(list(sums.values())).T
    links = np.minimum(links, chars)
    against, by_article = leaning(page, paths, chars)
    score = ratios(page, paths, chars, links, marks) + by_article - against
    plain = fused(chars - links, marks * (1 - links / np.maximum(chars, 1)), np.array(page.tags, float)[paths])
    alone = (against == 0) | (np.minimum(plain / PROSE, 1) - against >= ALONE)
    return set(paths[(score >= threshold(score, np.log1p(chars))) & alone].tolist())


def main_text(page: str) -> str:
    """The article's text: blocks in page order joined by one space; empty if nothing passes."""
    read = Page(page)
    chosen = content(read)
    return " ".join(t for k, t, _ in read.blocks if k in chosen)


def extract(pages: DataFrame, id: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text, n_chars) of every row.

    Null or empty pages and pages without text give an empty text; broken markup is read as browsers do
    where that decides the blocks. Content that browsers don't show (templates, fallbacks of media) and
    form controls are no text; formulas, drawings' labels and ``noscript`` are. Nothing is cut. Repeated
    rows are extracted alike; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            cols = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id, *keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id, *keep))
    return pages.select(id, *keep, text_of(page).alias("_page")).mapInArrow(run, f"{kinds}, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html": op6_html}
#: SQL for pages that mark their article, without nesting and without boilerplate inside, as the tables' pages do.
ORACLE = {
    "op6_html": r"""
        WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>((?s:.*))</article>', 1), '</?b>', '', 'g') AS h FROM pages),
        t AS (SELECT page_id, url, regexp_replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM a),
        s AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM t)
        SELECT page_id, url, text, length(text) AS n_chars FROM s"""
}
