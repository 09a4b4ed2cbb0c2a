"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags. Each block is described by its word
count and link density, those of its neighbours, the kind of its tag and of the region in
which it lies, and whether an element around it is called by one of a few names of
boilerplate, as whole words of class, id or role; a decision tree, trained on the small
labelled table that `labelled_pages` lays out, keeps or drops it. On pages without an
article element and without such names, word counts and link densities decide. Character references are decoded, white
space inside a block becomes one space, kept blocks are joined by an empty line.

Null and empty html give an empty text. Broken markup is read as far as it goes: stray
end tags are ignored, an unfinished tag or comment ends the page, a head ends at what may
not lie in it, other opaque elements without an end tag are ignored unless their content is
raw. Pages are judged by themselves, so repeated rows get equal texts. All columns are kept; output names replace
input columns.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearfold.llm.common import fresh, slices, small_batches

TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>|<(?=/?[a-zA-Z])""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)

#: Elements whose content is never text.
OPAQUE = frozenset("script style template svg math iframe object select textarea title head canvas audio video noembed noframes".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
#: What may lie in a head besides void elements.
HEAD = frozenset("head html base basefont bgsound link meta title style script noscript noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag of the same kind closes.
CLOSES_ITSELF = frozenset("p li dt dd option tr td th".split())
BAD_TAGS = frozenset("nav footer aside form header menu dialog button label fieldset noscript".split())
#: Of these, those in which an article element is none.
CLOSED_TAGS = frozenset("nav footer aside menu button label".split())
GOOD_TAGS = frozenset(("article", "main"))
PARAGRAPHS = frozenset("p blockquote pre td dd figcaption".split())
NAME = re.compile(
    r"(?:[a-z0-9]+[-_]{1,2})?(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed|s)?|promos?|promotion|sidebar|nav|navbar|navigation|menu|footer|masthead|topbar|breadcrumbs?|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|recommended|comments?|commentlist|disqus|replies|login|signup|search|searchbox|widgets?|toolbar|pagination|pager|copyright|disclaimer|contentinfo|complementary)"
    r"(?:[-_]{1,2}(?:ads?|bar|banner|block|body|box|area|container|content|form|inner|item|links?|list|menu|notice|section|slot|text|unit|wrapper|[0-9]+))?",
    re.IGNORECASE,
)

#: Regions: a boilerplate tag, outside the page's article, a page without one, the article.
BOILERPLATE, OUTSIDE, ANY, ARTICLE = -1, 0, 1, 2

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "region", "named", "paragraph", "heading", "item")


def region_of(tag: str, above: int) -> int:
    if tag in GOOD_TAGS and above != BOILERPLATE - 1:
        return ARTICLE
    if tag in CLOSED_TAGS:
        return BOILERPLATE - 1  # no article below
    if tag in BAD_TAGS and (tag != "header" or above != ARTICLE):
        return min(BOILERPLATE, above)
    return above


def named(attributes: str) -> bool:
    """Whether an element is hidden or called by a name of boilerplate."""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden" or any(NAME.fullmatch(x) for x in (a or b or c).split()):
            return True
    return False


def element_end(page: str, tag: str, at: int, unclosed: set[str]) -> int | None:
    """Where the element whose start tag ends at `at` is over; None if nothing ends it.
    `unclosed` remembers tags whose end was sought in vain."""
    if tag not in unclosed:
        close = re.compile(rf"</{tag}[\s/>]" if tag in RAW else rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
        if close:
            closed = page.find(">", close.start())
            return len(page) if closed < 0 else closed + 1
        unclosed.add(tag)
    return len(page) if tag in RAW else None


def head_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where a head ends: after its end tag, or at the first text or tag that may not lie in it."""
    while m := TAG.search(page, at):
        if page[at : m.start()].strip() or m[0] == "<":
            return at
        if m[0] == "<!--":
            stop = page.find("-->", m.end())
            at = len(page) if stop < 0 else stop + 3
            continue
        tag = (m[2] or "").lower()
        if tag == "head" and m[1]:
            return m.end()
        if tag and not m[1] and tag not in HEAD or m[1] and tag in ("body", "html"):
            return m.start()
        at = m.end()
        if not m[1] and tag in ("title", "style", "script", "noscript", "noframes", "template"):
            at = element_end(page, tag, at, unclosed) or at
    return at


def blocks(page: str) -> list[tuple[str, int, int, int, int, int, int, int]]:
    """(text, words, words in links, region, named, paragraph, heading, item) of each flat
    block with text."""
    out: list[tuple] = []
    stack: list[tuple[str, int, bool]] = []  # tag, region, named
    opened: Counter[str] = Counter()  # tags in the stack
    parts: list[tuple[str, bool]] = []
    at, links, tag_pattern, end = 0, 0, TAG, len(page)
    unclosed: set[str] = set()

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = sum(len(p.split()) for p, link in parts if link)
                tag, region, name = stack[-1] if stack else ("", ANY, False)
                out.append((text, text.count(" ") + 1, linked, max(region, BOILERPLATE), int(name), int(tag in PARAGRAPHS), int(any(opened[h] for h in HEADINGS)), int(opened["li"] > 0)))
            parts.clear()

    def close(upto: int) -> None:
        for tag, _, _ in stack[upto:]:
            opened[tag] -= 1
        del stack[upto:]

    while at < end:
        m = tag_pattern.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            parts.append((entities.unescape(page[at:upto]), links > 0))
        if not m:
            break
        if m[0] == "<!--":
            stop = page.find("-->", m.end())
            at = end if stop < 0 else stop + 3
            continue
        if m[0] == "<":  # a quote that never ends: tags are read without quotes from here on
            tag_pattern = PLAIN_TAG
            if not PLAIN_TAG.match(page, m.start()):
                break
            at = m.start()
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            flush()
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append((" ", links > 0))
            elif tag == "a" and not m[3].endswith("/"):
                links = 1  # links do not nest
            if tag != "label":
                continue
        flush()
        if tag in OPAQUE and not m[3].endswith("/"):
            at = head_end(page, at, unclosed) if tag == "head" else element_end(page, tag, at, unclosed) or at
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_ITSELF:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] not in INLINE and stack[i][0] not in CLOSES_ITSELF:
                    break
        elif stack and stack[-1][0] == "p":
            close(len(stack) - 1)  # no block lies inside a paragraph
        links = 0 if tag not in INLINE else links
        _, above, name = stack[-1] if stack else ("", ANY, False)
        stack.append((tag, region_of(tag, above), name or tag not in ("html", "body") and named(m[3])))
        opened[tag] += 1
    flush()
    if any(b[3] == ARTICLE for b in out):
        out = [(*b[:3], OUTSIDE, *b[4:]) if b[3] == ANY else b for b in out]
    return out


def described(found: Sequence[tuple]) -> np.ndarray:
    """One row of FEATURES for each block."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([b[1] for b in found], float)
        density = np.minimum(1.0, np.array([b[2] for b in found], float) / words)
        x[:, 0], x[:, 1] = words, density
        x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
        x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
        x[:, 6:] = [b[3:] for b in found]
    return x


# --- The labelled table and the tree -------------------------------------------------------


def labelled_pages(seed: int = 5) -> list[list[tuple[int, str]]]:
    """Pages as lists of (is main text, html): layouts by rule, filled with random words."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(n))

    def boilerplate(kind: str, name: str, low: int, high: int) -> tuple[int, str]:
        """A menu, a teaser with a link, or plain words."""
        open_ = f'<div class="{name}">' if name else "<div>"
        if kind == "menu":
            return 0, f"{open_}<ul>{links(rng.randint(3, 8))}</ul></div>"
        if kind == "teaser":
            return 0, f'{open_}<a href="/t">{words(2, 9)}</a> {words(1, 5)}</div>'
        return 0, f"{open_}{words(low, high)}</div>" if rng.random() < 0.5 or not name else f"{open_}<h3>{words(1, 3)}</h3><p>{words(low, high)}</p></div>"

    def article() -> list[tuple[int, str]]:
        out = [(1, f"<h1>{words(2, 10)}</h1>")]
        for _ in range(rng.randint(1, 10)):
            low, high = rng.choice(((1, 3), (4, 12), (8, 30), (30, 120), (100, 260)))
            link = f' <a href="/y">{words(1, 2)}</a> ' if rng.random() < 0.2 and low > 7 else ""
            out.append((1, f"<p>{words(low, high)}{link}{words(low, high)}</p>"))
        if rng.random() < 0.3:
            out.insert(rng.randint(1, len(out)), (1, f"<ul><li>{words(4, 20)}</li><li>{words(4, 20)}</li></ul>"))
        if rng.random() < 0.3:
            out.insert(rng.randint(1, len(out)), (1, f"<h2>{words(1, 6)}</h2>"))
        if rng.random() < 0.4:  # a paragraph of many links
            out.insert(rng.randint(1, len(out)), (1, "<p>" + " ".join(f'{words(4, 12)} <a href="/y">{words(1, 6)}</a>' for _ in range(rng.randint(3, 6))) + "</p>"))
        if rng.random() < 0.15:
            out.insert(rng.randint(1, len(out)), (1, f'<h2><a href="/h">{words(2, 6)}</a></h2>'))
        return out

    def anywhere(into: list, *parts: tuple[int, str]) -> list:
        for part in parts:
            into.insert(rng.randint(0, len(into)), part)
        return into

    names = ("ad", "banner-ad", "cookie-notice", "promo", "comments", "sidebar", "share", "related", "newsletter")
    tags = ("nav", "aside", "footer", "form", "header")
    pages = []
    for i in range(240):
        main = article()
        if i % 3 == 0:  # no telling element: counts, densities and neighbours alone decide
            main = [m for m in main if len(m[1].split()) > 12 or m[1].startswith("<h1")]
            main = [(1, m[1].replace("<p>", "<div>").replace("</p>", "</div>")) if i % 2 else m for m in main]
            # Short words that belong to menus stand next to links, at either end of the page.
            top = [boilerplate("menu", "", 1, 4), *(boilerplate(rng.choice(("menu", "teaser", "words")), "", 1, 8) for _ in range(rng.randint(0, 2))), boilerplate(rng.choice(("menu", "teaser")), "", 1, 4)]
            bottom = (0, f'<div><a href="/">{words(1, 3)}</a> <a href="/">{words(1, 3)}</a></div>')
            end = [boilerplate(rng.choice(("menu", "teaser")), "", 1, 4), *anywhere([bottom], *(boilerplate("words", "", 1, 8) for _ in range(rng.randint(0, 2))))]
            top, end = (x if rng.random() < 0.8 else [] for x in (top, end))
            if i % 4 == 0:
                main.insert(len(main) // 2 + 1, boilerplate("menu", "", 1, 4))
            pages.append([*top, *main, *end])
            continue
        # Boilerplate of all lengths stands in front of paragraphs of all lengths.
        inside = [boilerplate(rng.choice(("menu", "teaser", "words", "words")), rng.choice(names), *rng.choice(((1, 6), (5, 30), (30, 90)))) for _ in range(rng.randint(0, 3))]
        inside += [(0, f"<{t}><p>{words(*rng.choice(((1, 6), (5, 40))))}</p></{t}>") for t in tags[:4] if rng.random() < 0.25]
        if rng.random() < 0.3:
            inside.append((0, f"<ul>{links(rng.randint(2, 6))}</ul>"))
        top = [(0, f"<{t}><p>{words(*rng.choice(((1, 6), (5, 40))))}</p><ul>{links(4)}</ul></{t}>") for t in tags if rng.random() < 0.5]
        end = [(0, f"<footer>{words(3, 20)}</footer>")]
        if rng.random() < 0.3:
            pages.append([(body[0][0], "<article>" + body[0][1]), *body[1:]] if (body := anywhere(article(), *inside)) else [])
            continue
        for part in (top, end):
            anywhere(part, *(boilerplate(rng.choice(("menu", "teaser", "words")), rng.choice(("", *names)), *rng.choice(((1, 6), (5, 30), (30, 90)))) for _ in range(rng.randint(0, 2))))
        open_, close = rng.choice((("<article>", "</article>"), ("<main>", "</main>"), ('<article class="post side-by-side">', "</article>")))
        body = anywhere(main, *inside)
        pages.append([*top, (body[0][0], open_ + body[0][1]), *body[1:], (1, close), *end])
    return pages


def labelled_table(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of every block of the labelled pages."""
    xs, ys = [], []
    for page in labelled_pages(seed):
        found = blocks("".join(part for _, part in page))
        # Every part closes what it opens but for the article, so it has its blocks by itself.
        labels = [label for label, part in page for _ in blocks(part)]
        xs.append(described(found))
        ys += labels
    return np.vstack(xs), np.array(ys, float)


Tree = float | tuple


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 3) -> Tree:
    """A classification tree by Gini impurity; a leaf is the share of main text."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best, cut = share * (1 - share) * len(y) - 1e-9, None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, s = x[order, j], np.cumsum(y[order])
        for i in np.flatnonzero(np.diff(v)):
            n, rest = i + 1, len(y) - i - 1
            if n < least or rest < least:
                continue
            p, q = s[i] / n, (s[-1] - s[i]) / rest
            impurity = p * (1 - p) * n + q * (1 - q) * rest
            if impurity < best:
                best, cut = impurity, (j, float((v[i] + v[i + 1]) / 2))
    if cut is None:
        return share
    low = x[:, cut[0]] < cut[1]
    return (*cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def score(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, cut, below, above = tree
    low = x[:, j] < cut
    out = np.empty(len(x))
    out[low], out[~low] = score(below, x[low]), score(above, x[~low])
    return out


@lru_cache(maxsize=4)
def trained(seed: int = 5) -> Tree:
    return grow(*labelled_table(seed))


def main_text(page: str | None, tree: Tree, least: float = 0.5) -> str:
    found = blocks(page or "")
    kept = score(tree, described(found)) >= least
    return "\n\n".join(b[0] for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", keep: Sequence[str] | None = None, tree: Tree | None = None) -> DataFrame:
    """pages (or the columns `keep` of it) with the main text and n_chars, its length."""
    small_batches(pages.sparkSession)
    tree = trained() if tree is None else tree
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in (out_col.lower(), "n_chars")]
    body = fresh("body", keep)
    source = pages.select(*[pages[c] for c in keep], pages[html_col].cast("string").alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, body):
            texts = [main_text(x, tree) for x in b.column(body).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, out_col, "n_chars"])

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in keep), T.StructField(out_col, T.StringType()), T.StructField("n_chars", T.LongType())]))
