"""Main-text extraction from HTML by a linear-chain conditional random field.

A page is cut into DOM leaf blocks: runs of text between block-level tags, each
with its open ancestors. A block has features of its ancestors' tags and class or
id words, and of its text. The chain has two labels, main text and rest; the
weights are trained on labelled pages by maximum likelihood with an L2 penalty
(forward-backward), and pages are decoded by Viterbi.

Labelled pages: the table has no labels, but its authors mark their articles up.
`labelled_pages` takes the blocks inside the marked article of at most
`train_pages` pages of at most `most_chars` characters as main text, all blocks of
a page, and sets them into page layouts with other wrappers and with menus,
sidebars, notices, forms, adverts and reader comments, so that the model learns to
do without that one mark. Pages are the distinct ones that yield labels, by the
least hashes; copies count once. If no page does, the layouts are built from
blocks of the first `most_chars` characters of any pages, the long ones as main
text. A layout holds `LAYOUT_BLOCKS` main blocks at most, and the first dozen words
of some others as boilerplate. Layouts of stock phrases are always among the
training pages, so that there is a model even for a table without any text. Whole
pages of any length are decoded; the bounds are on training only.

Inside a block character references are decoded and white space becomes one
space; main blocks are joined in page order by one space. Defined results: null or
empty html, or no main block: an empty text; a page is parsed in time that grows as its
length does, whatever its tags; of scripts, styles, drawings, frames and the like nothing is
text up to their end tags, but one that is closed at once or (scripts and styles aside) has no
end tag takes nothing else with it, and names that only begin so are other elements; a declaration
without an end is text; repeated rows each get the same text; an empty table
gives no rows; only the named columns are looked at.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import rows_udf

TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|(<[!?])|{TAG}|</?[a-zA-Z][^<>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|data-main)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

# HTML's elements by how they cut text.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME_CLOSES = frozenset("li dt dd tr td th option".split())
#: Elements without text of the page, to their end tags; the first two run to the end of the page if they have none.
SCRIPTS = ("script", "style")
RAW = frozenset((*SCRIPTS, *"noscript template svg iframe object".split()))
_ENDS = {k: re.compile(rf"</{k}(?=[\s/>])[^<>]*>", re.I) for k in RAW}

#: Words of class and id attributes, by what they say of a block.
CLUES = {
    "ad": r"\b(ads?|advert\w*|sponsor\w*|promo\w*|banner)\b",
    "comment": r"comment|\brepl(y|ies)\b|discuss|disqus|responses",
    "notice": r"cookie|consent|gdpr|notice|\balert\b|popup|modal|newsletter|subscribe|paywall",
    "side": r"sidebar|\bside\b|related|widget|recommend|trending|\btags?\b",
    "menu": r"\bmenu\b|\bnav\w*|breadcrumb|pagination|\btoc\b|\btabs?\b",
    "share": r"share|social|follow",
    "head": r"\bheader\b|masthead|\btop\b|logo",
    "foot": r"foot|copyright|legal",
    "form": r"form|search|login|signup",
    "main": r"content|article|\bpost\b|entry|story|\bmain\b|\bbody\b|\btext\b",
}
_CLUES = {k: re.compile(v) for k, v in CLUES.items()}
TAGS = "article main section nav header footer aside form button label ul ol li table title head h1 h2 h3 p div blockquote pre figure figcaption dl".split()
TEXT = ["bias", "links>0.3", "links>0.8", "words<4", "words<10", "words>=10", "words>=25", "stop", "copyright", "first", "last", "digits", "bar", "bare"]
FEATURES = [f"tag:{t}" for t in TAGS] + [f"clue:{c}" for c in CLUES] + TEXT
_AT = {f: i for i, f in enumerate(FEATURES)}


@dataclass
class Block:
    text: str
    tags: frozenset[str]  # of the open elements, those that are features
    clues: frozenset[str]
    links: float
    label: int
    bare: bool  # in no element but html and body


class _Open:
    """The open elements, with running counts of their tags and clues: every step takes constant time on average."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset[str], int]] = []
        self.tags: Counter[str] = Counter()
        self.clues: Counter[str] = Counter()
        self.labels = 0
        self.state: tuple[frozenset[str], frozenset[str]] | None = None

    def push(self, tag: str, clues: frozenset[str], label: int) -> None:
        self.stack.append((tag, clues, label))
        self.labels += label
        self._count(tag, clues, 1)

    def pop(self) -> str:
        tag, clues, label = self.stack.pop()
        self.labels -= label
        self._count(tag, clues, -1)
        return tag

    def _count(self, tag: str, clues: frozenset[str], by: int) -> None:
        """Forget the sets of what is open only where one of them changes."""
        edge = int(by > 0)
        self.tags[tag] += by
        if self.tags[tag] == edge:
            self.state = None
        for c in clues:
            self.clues[c] += by
            if self.clues[c] == edge:
                self.state = None

    def pop_to(self, tag: str) -> bool:
        """Close the innermost `tag` and all in it; nothing if none is open."""
        if not self.tags[tag]:
            return False
        while self.pop() != tag:
            pass
        return True

    def block(self, text: str, links: float) -> Block:
        if self.state is None:
            self.state = frozenset(t for t in TAGS if self.tags[t]), frozenset(c for c in CLUES if self.clues[c])
        return Block(text, *self.state, links, int(self.labels > 0), len(self.stack) <= self.tags["html"] + self.tags["body"])


def _tags(page: str) -> Iterator[tuple[int, int, tuple[str, str, str] | None]]:
    """Start and end of what is no text, with (slash, name, attributes) of tags; comments, declarations and whole raw
    elements have none. What is not there after some place is not looked for again, so time grows as the page does."""
    at, missing = 0, set()
    while m := TOKEN.search(page, at):
        at = m.end()
        if m[1]:  # a declaration; without an end it is text
            end = -1 if ">" in missing else page.find(">", at)
            if end < 0:
                missing.add(">")
                continue
            at = end + 1
        name = (m[3] or "").lower()
        if name in RAW and not m[2] and not m[4].endswith("/"):
            end = None if name in missing else _ENDS[name].search(page, at)
            if end:
                at = end.end()
            else:
                missing.add(name)
                if name in SCRIPTS:
                    at = len(page)
        yield m.start(), at, (m[2], name, m[4]) if name and name not in RAW else None


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, in time that grows as the page does."""
    out: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    linked = total = anchors = 0

    def flush():
        nonlocal linked, total
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(opened.block(text, linked / max(1, total)))
            parts.clear()
            linked = total = 0

    def said(raw: str):
        nonlocal linked, total
        if raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            size = len(raw.strip())
            total += size
            linked += size if anchors else 0

    at = 0
    page = page or ""
    for start, end, found in _tags(page):
        said(page[at:start])
        at = end
        if found is None:
            continue
        slash, tag, attributes = found
        if tag in INLINE:
            if tag == "a":
                anchors = 0 if slash else 1
            elif tag == "br":
                parts.append(" ")
            if tag != "label" or not opened.stack:
                continue
        flush()
        if slash:
            if opened.pop_to(tag):
                anchors = 0
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and any(t == "p" for t, _, _ in opened.stack[-3:]):
            opened.pop_to("p")
        elif tag in SAME_CLOSES and opened.stack and opened.stack[-1][0] == tag:
            opened.pop()
        clues, label = frozenset(), 0
        if "=" in attributes:
            for a in ATTRIBUTE.finditer(attributes):
                value = a[2].strip("\"'").lower().replace("-", " ").replace("_", " ")
                label |= a[1] == "data-main"
                clues |= {k for k, p in _CLUES.items() if p.search(value)}
        opened.push(tag, clues, int(label))
        if attributes.rstrip().endswith("/"):
            opened.pop()
    said(page[at:])
    flush()
    return out


def features_of(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)))
    for i, b in enumerate(blocks):
        row = x[i]
        for t in b.tags:
            if (k := _AT.get(f"tag:{t}")) is not None:
                row[k] = 1
        for c in b.clues:
            row[_AT[f"clue:{c}"]] = 1
        words = b.text.count(" ") + 1
        for name, on in (("bias", True), ("links>0.3", b.links > 0.3), ("links>0.8", b.links > 0.8), ("words<4", words < 4), ("words<10", words < 10), ("words>=10", words >= 10), ("words>=25", words >= 25), ("stop", b.text[-1] in ".!?…。"), ("copyright", "©" in b.text[:80]), ("first", i == 0), ("last", i == len(blocks) - 1), ("digits", sum(map(str.isdigit, b.text[:200])) * 5 > len(b.text[:200])), ("bar", " | " in b.text[:200]), ("bare", b.bare)):
            if on:
                row[_AT[name]] = 1
    return x


@dataclass
class Crf:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))  # score of "main" over "rest"
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def decode(self, x: np.ndarray) -> list[int]:
        """Viterbi; a tie goes to "rest"."""
        if not len(x):
            return []
        (t00, t01), (t10, t11) = self.transitions.tolist()
        back: list[tuple[int, int]] = []
        a, b = 0.0, None
        for s in (x @ self.weights).tolist():
            if b is None:
                b = s
                continue
            from0, from1 = a + t00 >= b + t10, a + t01 >= b + t11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + s
        path = [1 if b > a else 0]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = blocks_of(page)
        return " ".join(b.text for b, y in zip(blocks, self.decode(features_of(blocks)), strict=True) if y)


def train(pages: list[list[Block]], *, penalty: float = 0.05, steps: int = 250, rate: float = 0.1) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam on the whole set; deterministic."""
    pages = sorted((p for p in pages if p), key=len)
    if not pages:
        return Crf()
    n, d = len(pages), len(FEATURES)
    active = [np.nonzero(features_of(p)) for p in pages]
    counts = np.concatenate([np.bincount(r, minlength=len(p)) for (r, _), p in zip(active, pages, strict=True)])
    at = np.concatenate([c for _, c in active]).astype(np.int16)
    starts = np.cumsum(counts) - counts  # every block has the bias
    y = np.array([b.label for p in pages for b in p])
    gold = np.zeros((2, 2))
    for p in pages:
        for a, b in itertools.pairwise(p):
            gold[a.label, b.label] += 1
    observed = np.concatenate([np.bincount(at, weights=np.repeat(y, counts), minlength=d), gold.ravel()])
    groups = list(_grouped([len(p) for p in pages]))
    theta = np.zeros(d + 4)
    m = v = np.zeros_like(theta)
    for step in range(1, steps + 1):
        flat, trans = np.add.reduceat(theta[at], starts), theta[d:].reshape(2, 2)
        main, pairs = np.zeros(len(y)), np.zeros((2, 2))
        for a, b, on in groups:
            size, longest = on.sum(1), on.shape[1]
            score = np.zeros(on.shape)
            score[on] = flat[a:b]
            emit = np.stack([np.zeros_like(score), score], axis=2)
            forward, backward = np.zeros_like(emit), np.zeros_like(emit)
            forward[:, 0] = emit[:, 0]
            for t in range(1, longest):
                new = np.logaddexp(forward[:, t - 1, :1] + trans[0], forward[:, t - 1, 1:] + trans[1]) + emit[:, t]
                forward[:, t] = np.where(on[:, t, None], new, forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                nxt = emit[:, t + 1] + backward[:, t + 1]
                new = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
                backward[:, t] = np.where(on[:, t + 1, None], new, 0)
            norm = np.logaddexp.reduce(forward[np.arange(len(on)), size - 1], axis=1)
            main[a:b] = np.exp(forward + backward - norm[:, None, None])[:, :, 1][on]
            pair = forward[:, :-1, :, None] + trans + (emit + backward)[:, 1:, None, :] - norm[:, None, None, None]
            pairs += np.exp(np.where(on[:, 1:, None, None], pair, -np.inf)).sum((0, 1))
        expected = np.concatenate([np.bincount(at, weights=np.repeat(main, counts), minlength=d), pairs.ravel()])
        grad = (observed - expected) / n - penalty * theta / 10
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(theta[:d], theta[d:].reshape(2, 2))


def _grouped(sizes: list[int], most: int = 50_000):
    """(start, end, mask) over the blocks of pages of rising size; a mask of pages by places has about `most` cells."""
    a = first = 0
    while first < len(sizes):
        last = first + 1
        while last < len(sizes) and (last + 1 - first) * sizes[last] <= most:
            last += 1
        some = np.array(sizes[first:last])
        yield a, a + int(some.sum()), np.arange(some[-1]) < some[:, None]
        a, first = a + int(some.sum()), last


def _escaped(text: str) -> str:
    return entities.escape(text, quote=False)


def layouts(main: list[str], other: list[str], k: int) -> str:
    """A labelled page: `main` in the k-th kind of wrapper, amid boilerplate made of `other`; `data-main` marks the labels."""
    rng = np.random.default_rng(k)
    pick = lambda: _escaped(other[rng.integers(len(other))])
    menu = "".join(f'<li><a href="/{i}">{pick().split(" ")[0]}</a></li>' for i in range(rng.integers(3, 8)))
    before = [f"<nav><ul>{menu}</ul></nav>", f'<div class="menu"><ul>{menu}</ul></div>', f"<header><p>{pick()}</p></header>", f'<div class="cookie-notice"><p>{pick()}</p><button>{pick().split(" ")[0]}</button></div>', f'<div class="ad">{pick()}</div>', f'<div id="header">{pick()}</div>', f'<div class="breadcrumb"><a href="/">{pick()}</a></div>', f'<form action="/s"><label>{pick()}</label><input name="q"></form>']
    after = [f"<footer>&copy; {pick()}</footer>", f'<aside><h3>{pick()}</h3><p>{pick()}</p></aside>', f'<div class="sidebar"><ul>{menu}</ul></div>', f'<div class="related"><a href="/x">{pick()}</a></div>', f'<section class="comments"><h2>{pick()}</h2><div class="comment"><p>{pick()}</p></div><div class="comment"><p>{pick()} {pick()}</p></div></section>', f'<div id="footer"><p>{pick()}</p></div>', f'<div class="banner ads"><p>{pick()}</p></div>', f'<div class="share"><a href="/s">{pick()}</a></div>', f'<div class="newsletter"><form><p>{pick()}</p></form></div>']
    within = ["", "", f'<div class="ad">{pick()}</div>', f'<aside>{pick()}</aside>', f'<section id="comments"><p>{pick()}</p><p>{pick()} {pick()}</p></section>', f'<div class="share">{pick()}</div>', f'<ul class="comments"><li>{pick()}</li></ul>']
    body = [f"<h1 data-main=1>{_escaped(main[0])}</h1>"] if len(main) > 1 else []
    body += [f"<p data-main=1>{_escaped(p)}</p>" for p in main[len(body) :]]
    body.insert(int(rng.integers(1, len(body) + 1)) if rng.random() < 0.4 else len(body), within[rng.integers(len(within))])
    open_, close = [("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="article-body">', "</div>"), ('<section class="post">', "</section>"), ("<div>", "</div>"), ('<main><div class="entry">', "</div></main>")][k % 8]
    some = lambda of: "".join(of[i] for i in np.sort(rng.choice(len(of), rng.integers(1, 5), replace=False)))
    return f"<html><head><title>{_escaped(main[0])}</title></head><body>{some(before)}{open_}{''.join(body)}{close}{some(after)}</body></html>"


def labelled(page: str | None) -> tuple[list[Block], list[str], list[str]] | None:
    """The blocks of a page with labels, and the texts inside and outside its marked article; None unless it has both."""
    blocks = blocks_of(page)
    for b in blocks:
        b.label = int(bool({"article", "main"} & b.tags) and not {"nav", "aside", "footer", "form", "header"} & b.tags and not {"comment", "ad", "notice", "share"} & b.clues)
    main, other = [b.text for b in blocks if b.label], [b.text for b in blocks if not b.label]
    return (blocks, main, other) if main and other else None


def labelled_pages(htmls: list[str | None]) -> list[list[Block]]:
    """Labelled training pages from pages whose authors mark the article, each as it is and in two other layouts."""
    out = []
    for k, page in enumerate(htmls):
        if found := labelled(page):
            blocks, main, other = found
            out.append(blocks)
            short = other + [" ".join(t.split()[:12]) for t in main[:3]]
            out += [blocks_of(layouts(main[:LAYOUT_BLOCKS], short, 2 * k + j)) for j in (0, 1)]
    return out


LAYOUT_BLOCKS = 12

#: What the library brings of its own: main text and boilerplate for labelled layouts.
STOCK = (["This is a sentence of the main text, told in more than ten plain words.", "Another sentence follows it and says a little more about the same thing.", "The last one of them comes to an end here, as all such sentences do."], ["Home", "About us", "Contact", "Sign in", "Read more", "Terms of use", "All rights reserved", "Related pages"])


def unmarked_pages(htmls: list[str | None]) -> list[list[Block]]:
    """Labelled layouts from pages without a marked article: their blocks of ten words or more, few of them in links, are the main text."""
    out = []
    for k, page in enumerate(htmls or [None]):
        blocks = blocks_of(page)
        long = [b.text for b in blocks if b.text.count(" ") >= 9 and b.links <= 0.3]
        short = [b.text for b in blocks if b.text.count(" ") < 9 or b.links > 0.3]
        out += [blocks_of(layouts(long[:LAYOUT_BLOCKS] or STOCK[0], short or STOCK[1], 4 * k + j)) for j in range(4)]
    return out


def stock_pages() -> list[list[Block]]:
    """One labelled page of stock phrases for each kind of layout."""
    return [blocks_of(layouts(*STOCK, k)) for k in range(8)]


def _least(pages: DataFrame, count: int) -> list[str]:
    """The `count` distinct pages of the least hashes; pages(html, h)."""
    least = [r["h"] for r in pages.select("h").distinct().orderBy("h").limit(count).collect()]
    rows = pages.where(F.col("h").isin(least)).groupBy("h").agg(F.min("html").alias("html")).collect() if least else []
    return [r["html"] for r in sorted(rows, key=lambda r: r["h"])]


def fit(pages: DataFrame, *, html: str = "html", train_pages: int = 200, most_chars: int = 30_000) -> Crf:
    """Train on at most `train_pages` distinct pages of at most `most_chars` characters that yield labels, the first by a hash of the page."""
    rows = pages.select(F.col(html).alias("html")).where(F.col("html").isNotNull()).withColumn("h", F.xxhash64("html"))
    marked = rows.where((F.length("html") <= most_chars) & F.col("html").rlike("(?i)<(article|main)"))
    first = _least(marked, 2 * train_pages)
    some = [p for p in first if labelled(p)][:train_pages]
    if len(some) < train_pages and len(first) == 2 * train_pages:  # there may be more: ask every page
        usable = rows_udf(lambda: lambda t: (labelled(t) is not None,), "ok boolean")
        some = _least(marked.withColumn("ok", usable("html")["ok"]).where("ok").drop("ok"), train_pages)
    if some:
        return train(labelled_pages(some) + stock_pages())
    return train(unmarked_pages(_least(rows.select(F.substring("html", 1, most_chars).alias("html"), "h"), train_pages)) + stock_pages())


def main_text_column(page: Column, model: Crf) -> Column:
    def start():
        return lambda t: (model.main_text(t),)

    return rows_udf(start, "text string")(page)["text"]


def extract(pages: DataFrame, model: Crf | None = None, *, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and the main text of every page."""
    model = model or fit(pages, html=html)
    return pages.select(F.col(id), F.col(url), main_text_column(F.col(html), model).alias("text"))
