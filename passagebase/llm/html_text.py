"""Main text of web pages as a maximum-scoring subsequence.

A page becomes a row of tokens: words score positive, tags score negative. The weights come from labelled pages, pages
that mark their article themselves. A tag costs the more, the more often it stands outside the article rather than in it;
a tag that is usual inside costs next to nothing. An element of a kind (its name, or a word of its class, id or role)
that labelled pages have beside the article and not in it is a box: its tag costs what all its words score and BOX_COST
more, so no best stretch begins or ends with a box, and a box amid the article is passed over for next to nothing. A
linear scan finds the contiguous stretch of highest total score; its text without the boxes, block by block, is the
result. Words in links outside an article score by how usual links are in labelled articles and beside them, and nothing
without labelled links, so menus that are in no box do not begin or end a stretch either. Articles that follow one another
with no words between them are one region. Names that custom gives to adverts, notices, comments and the like count as seen PRIOR times beside an article,
so pages unlike the labelled ones have weights too; labelled pages overrule that. HTML's own elements for menus, asides
and forms are boxes wherever they stand. Scripts and styles are no text. An element that holds the page's first article, or on pages that mark none the main element or most of the words,
is never a box.

The fit reads a bounded sample of labelled pages (SAMPLE_PAGES, by a hash of the url and id); every page is read whole.

Defined results: a null or empty html, or a page without words, gives the empty text; without labelled pages the prior
kinds and the default weight of tags hold; of equally good stretches the first is taken, with its longest reach; a page
cut off within markup is read to its end; repeated rows get equal results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebase.llm.common import doc_slices

SAMPLE_PAGES = 1000
WORD_SCORE, DEFAULT_TAG, LEAST_TAG, MOST_TAG = 1.0, 0.1, 0.01, 100.0
#: Words that a tag costs for each unit of its log odds; what a box costs beyond its words.
WORDS_A_UNIT, BOX_COST = 10.0, 0.5
#: Times that a name known for boxes counts as seen beside an article, that HTML's own elements for menus, forms and the
#: like do; log odds from which an element is a box.
PRIOR, ALWAYS, BOX_ODDS = 3, 1 << 40, 1.1

# Kinds of elements of HTML.
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "canvas", "object", "audio", "video"))
NEVER = frozenset(("head", "nav", "footer", "aside", "form", "button", "select", "option", "datalist", "dialog", "menu", "fieldset"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
BOX_NAMES = frozenset(("ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "share", "sharing", "social", "comment", "comments", "commentlist", "disqus", "replies", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search", "footer", "pagination", "pager", "toolbar", "widget", "widgets", "skip", "reactions", "responses", "discussion"))
BOX_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
NAME = re.compile(r"[a-z]+")
#: Blocks of running text: a name known for boxes says nothing of them, as "notice" may be what a paragraph is about.
TEXT_BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption")) | INLINE
#: Class names that start so tell what else the page has or lacks, not what the element is.
ABOUT = re.compile(r"(?:has|have|no|not|with|without|is|js|hide|show)[-_]")
#: What stays a box even where it holds most of the words, unless it holds the article.
NEVER_MOST = NEVER - {"form", "fieldset"}
#: Elements whose name alone says nothing of their use.
NEUTRAL = frozenset(("html", "body", "main", "article", "div", "section", "p", "span", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "center", "hr", "br", "img")) | INLINE


def kinds(name: str, attributes: str, in_article: bool) -> list[tuple[str, int]]:
    """(kind, times it counts as seen beside articles) of an element by its name, its classes, id and role."""
    out = [] if name in NEUTRAL else [(name, ALWAYS * (name in NEVER or name == "header" and not in_article))]
    if not attributes or name in ("html", "body", "main", "article"):
        return out
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            out.append(("hidden", ALWAYS))
        elif key == "role":
            out.append((f"role={value}", PRIOR * (value in BOX_ROLES)))
        elif key in ("class", "id"):
            named = lambda x: x in BOX_NAMES or name not in TEXT_BLOCKS and not BOX_NAMES.isdisjoint(NAME.findall(x))
            out += [(f".{x}", PRIOR * (named(x) and not (in_article and name in TEXT_BLOCKS))) for x in value.split() if not ABOUT.match(x)]
    return out


class Weights:
    """Log odds of kinds and costs of tags, from counts inside of and beside labelled articles."""

    def __init__(self, of_kinds: dict[str, tuple[int, int]], of_tags: dict[str, tuple[int, int]]):
        self.of_kinds = of_kinds
        self.cost = {t: float(np.clip(WORDS_A_UNIT * self.odds(*n), LEAST_TAG, MOST_TAG)) for t, n in of_tags.items()}
        self.link_word = float(np.clip(-self.odds(*of_tags["a"]), -WORD_SCORE, WORD_SCORE)) if "a" in of_tags else 0.0

    @staticmethod
    def odds(inside: int, beside: int) -> float:
        return math.log((beside + 0.5) / (inside + 0.5))

    def is_box(self, found: list[tuple[str, int]]) -> bool:
        for kind, known in found:
            inside, beside = self.of_kinds.get(kind, (0, 0))
            if self.odds(inside, beside + known) > BOX_ODDS:
                return True
        return False


def walk(page: str) -> tuple[list[tuple[str, str, bool, str]], str]:
    """(text before, name, whether it closes, attributes) of each tag outside raw elements, and the text at the end."""
    out, at, before = [], 0, ""
    while m := TOKEN.search(page, at):
        before += page[at : m.start()]
        at = m.end()
        name, closing = (m[2] or "").lower(), bool(m[1])
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else (at if name not in ("script", "style") else len(page))
        elif name:
            out.append((before, name, closing, m[3] or ""))
            before = ""
    return out, before + page[at:]


class Holds:
    """Which elements hold the page's article, or else most of its words; such an element is no box."""

    def __init__(self, tags: list[tuple[str, str, bool, str]], rest: str):
        self.upto = np.cumsum([len(t[0].split()) for t in tags] + [len(rest.split())])
        self.end = np.full(len(tags), len(tags))
        stacks: dict[str, list[int]] = {}
        for i, (_, name, closing, _) in enumerate(tags):
            if not closing:
                stacks.setdefault(name, []).append(i)
            elif stacks.get(name):
                self.end[stacks[name].pop()] = i
        first = {n: next((i for i, t in enumerate(tags) if t[1] == n and not t[2]), None) for n in ("article", "main")}
        self.any_article = first["article"] is not None
        self.article = first["article"] if self.any_article else first["main"]

    def __call__(self, i: int, name: str) -> bool:
        end = int(self.end[i])
        if self.article is not None and i < self.article < end:
            return True
        return not self.any_article and name not in NEVER_MOST and 2 * (self.upto[end] - self.upto[i]) > self.upto[-1]


def tokens(page: str, weights: Weights) -> list[tuple[str, str, float]]:
    """(tag, text, score) in page order: a tag with its slash and no text, or no tag and a stretch of text.

    A box is one token without text: its words' score, less what its tag costs. Text still has its character references.
    """
    out: list[tuple[str, str, float]] = []
    tags, rest = walk(page)
    article, waiting, depth = 0, "", 0
    holds, last_close = None, {name: i for i, (_, name, closing, _) in enumerate(tags) if closing}
    link, last_article = False, None

    def words(text: str) -> None:
        plain = html.unescape(text)
        n = len(plain.split())
        out.append(("", plain, n * (weights.link_word if link and not article else WORD_SCORE)))

    for i, (text, name, closing, attributes) in enumerate(tags):
        if text and not waiting:
            words(text)
        if waiting:
            if name == waiting and name not in VOID:
                depth += -1 if closing else 1
                if not depth:
                    waiting = ""
            continue
        if name == "article":
            article = max(0, article + (-1 if closing else 1))
            between = out[last_article:] if last_article is not None and not closing else []
            if between and not any(text.split() for _, text, _ in between):
                # One article after another: what is between them, their own tags too, costs next to nothing.
                out[last_article:] = [(tag, text, -LEAST_TAG) for tag, text, _ in between]
                out.append((name, "", -LEAST_TAG))
                last_article = None
                continue
            last_article = len(out) if closing and not article else None
        elif name == "a":
            link = not closing
        if not closing and name not in VOID and not attributes.rstrip().endswith("/") and weights.is_box(kinds(name, attributes, article > 0)):
            holds = holds or Holds(tags, rest)
            # An element that is never closed is no box: it would hide the rest of the page.
            if last_close.get(name, -1) > i and not holds(i, name):
                waiting, depth = name, 1
                out.append(("/" + name if name not in INLINE else "", "", -BOX_COST))
                continue
        tag = ("/" if closing else "") + name
        out.append((tag, "", -weights.cost.get(tag, DEFAULT_TAG)))
    if rest and not waiting:
        words(rest)
    return out


def counted(page: str) -> Iterator[tuple[str, str, bool]]:
    """('kind' or 'tag', name, inside) of what a page that marks its article has inside of it and beside it.

    Beside are the outermost elements that don't hold the article; what is in them counts with them.
    """
    tags, rest = walk(page)
    holds = Holds(tags, rest)
    a = holds.article
    if not holds.any_article or holds.end[a] == len(tags):
        return
    inner, upto = range(a + 1, int(holds.end[a])), 0
    for i, (_, name, closing, attributes) in enumerate(tags):
        if i in inner:
            if not closing:
                yield from (("kind", k, True) for k, _ in kinds(name, attributes, True))
            yield "tag", ("/" if closing else "") + name, True
        elif i >= upto:
            closed = not closing and holds.end[i] < len(tags)
            if closed and not i <= a <= holds.end[i]:
                upto = int(holds.end[i]) + 1
                yield from (("kind", k, False) for k, _ in kinds(name, attributes, False))
            else:
                yield "tag", ("/" if closing else "") + name, False


def best_stretch(scores: np.ndarray) -> tuple[int, int]:
    """[start, end) of the maximum-scoring contiguous subsequence, by one scan over prefix sums."""
    if not len(scores):
        return 0, 0
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(upto)
    gain = upto[1:] - low[:-1]
    top = gain.max()
    if top <= 0:
        return 0, 0
    ends = np.flatnonzero(gain >= top - 1e-9)
    starts = [int(np.flatnonzero(upto[: e + 1] <= low[e] + 1e-9)[0]) for e in ends[:1]]
    # The first of equally good stretches, with its longest reach: later ends count while no lower start comes between.
    reach = ends[low[ends] >= low[ends[0]] - 1e-9]
    return starts[0], int(reach[-1]) + 1


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best stretch, white space folded, joined by line feeds."""
    row = tokens(page, weights)
    start, end = best_stretch(np.array([score for _, _, score in row]))
    blocks, block = [], []
    for tag, text, _ in row[start:end]:
        if not tag:
            block.append(text)
        elif tag == "br":
            block.append(" ")
        elif tag.lstrip("/") not in INLINE:
            blocks.append(block)
            block = []
    blocks.append(block)
    folded = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in folded if b)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", seed: int = 42) -> Weights:
    """Weights from a bounded sample of pages that mark their article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], list[int]] = {}
        for batch in doc_slices(batches, "html"):
            for page in batch.column("html").to_pylist():
                for what, name, inside in counted(page):
                    total.setdefault((what, name), [0, 0])[0 if inside else 1] += 1
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in total], pa.string()) for i in range(2)), *(pa.array([v[i] for v in total.values()], pa.int64()) for i in range(2))], names=["what", "name", "inside", "beside"])

    picked = pages.select(F.col(html_col).alias("html"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("o")).where(F.col("html").rlike("(?i)<article[\\s>]"))
    keys = picked.select("o").orderBy("o").limit(SAMPLE_PAGES)  # SAMPLE_PAGES rows at most
    sample = picked.join(F.broadcast(keys.distinct()), "o", "left_semi").select("html")
    rows = sample.mapInArrow(run, "what string, name string, inside long, beside long").groupBy("what", "name").agg(F.sum("inside"), F.sum("beside")).collect()  # names of the sample's tags
    of = {what: {r[1]: (int(r[2]), int(r[3])) for r in rows if r[0] == what} for what in ("kind", "tag")}
    return Weights(of["kind"], of["tag"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    weights = learn(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_slices(batches, "html"):
            texts = [main_text(p, weights) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
