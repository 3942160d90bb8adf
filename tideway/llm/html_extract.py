"""Main text of web pages: boosted trees over the features of DOM nodes, then hierarchical decoding.

A page becomes a tree of its block elements; runs of text belong to the nearest of them. Each node has features of its subtree (text, density, links,
punctuation), its tag and attribute tokens, its depth, its ancestors and how it compares with its siblings. Trees give each node's
log-odds of holding main text. Decoding then chooses the best labelling in which nothing below a rejected node is
kept and nothing kept lies below a rejected one: a dynamic programme over the tree.

The trees are trained here, on pages made by ``layouts``: articles among menus, headers, footers, sidebars, notices, adverts, forms and
comments, in many arrangements and namings, of meaningless words. What an attribute's token (a word of a class, id, role or itemprop) says is learned
there too, as the log-odds of main text in elements that bear it. Nothing is learned from the pages given.

Defined results: a null or empty page has an empty text; markup that is not closed is closed where its parent ends; scripts,
styles, comments, templates and the head are never text; an opening tag whose quotes never close ends at its first ">", and so do all tags
after it; very long pages are read whole, in time that grows with their length (also where they are broken); repeated rows give
repeated results; there are no ties to settle; an empty table gives an empty result; extra input columns are not read.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.boosting import BoostedTrees
from tideway.llm.runtime import columns, pieces

#: Comment, declaration, closing tag, opening tag with its quoted values, and any other opening tag. Names and values do not backtrack.
MARKUP = re.compile(
    r"(<!--)|<[!?][^>]*+>|</([a-zA-Z][^\s>/]*+)[^>]*+>|<([a-zA-Z][^\s>/]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s>/]*+)[^>]*+>"
)
#: The same where a quote stays open to the page's end: tags end at their first ">".
LOOSE_MARKUP = re.compile(r"(<!--)|<[!?][^>]*+>|</([a-zA-Z][^\s>/]*+)[^>]*+>|<([a-zA-Z][^\s>/]*+)([^>]*+)>|((?!))")
NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
PUNCTUATION = str.maketrans("", "", ".,;:!?")

# HTML's element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe svg object".split())
ENDING = {name: re.compile(rf"</{name}\b[^>]*+>", re.IGNORECASE) for name in HIDDEN}
BODY = re.compile(r"<body\b", re.IGNORECASE)
BLOCKS = frozenset(
    "html body article section div main nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
    "tfoot tr td th caption blockquote pre figure figcaption address details summary dialog menu button select option textarea label hgroup search center".split()
)
CLOSES_P = BLOCKS - {"label", "button", "select", "option", "textarea"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article section main aside nav header footer form body html select".split())

TAG_FLAGS = (
    {"article", "main"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside", "dialog"},
    {"form", "fieldset", "button", "select", "option", "textarea", "label", "search"}, {"ul", "ol", "li", "dl", "dt", "dd"},
    {"table", "tr", "td", "th", "tbody", "thead"}, {"div", "section"}, {"blockquote", "pre", "figure", "figcaption"},
)
FLAG_OF = {tag: i for i, tags in enumerate(TAG_FLAGS) for tag in tags}
OUTER_TAGS = frozenset("nav menu footer aside form dialog".split())


class Page:
    """Block elements in page order (parents come first) and the runs of text, each with the node it belongs to."""

    __slots__ = ("tags", "parents", "names", "runs", "links")

    def __init__(self, markup: str):
        self.tags, self.parents, self.names = ["html"], [-1], [""]
        self.runs: list[tuple[int, str]] = []
        self.links: list[int] = [0]  # characters inside links
        stack: list[tuple[str, int]] = [("html", 0)]
        depths: dict[str, list[int]] = defaultdict(list)  # of open elements, by tag
        scopes = [0]  # depths of open elements that hold their own list items and cells
        buffer: list[str] = []
        unclosed: set[str] = set()  # hidden elements whose closing tag does not come any more
        pattern = MARKUP
        node, in_link, at, end = 0, 0, 0, len(markup)
        last = markup.rfind(">") + 1  # no tag ends beyond

        def flush() -> None:
            if buffer:
                text = " ".join(html.unescape("".join(buffer)).split())
                if text:
                    self.runs.append((node, text))
                buffer.clear()

        def close_to(depth: int) -> None:
            nonlocal node, in_link
            flush()
            for tag, _ in stack[depth:]:
                depths[tag].pop()
            del stack[depth:]
            while scopes[-1] >= depth:
                scopes.pop()
            node = stack[-1][1]
            in_link = 0

        while at < end:
            match = pattern.search(markup, at, last)
            stop = match.start() if match else end
            if not match and (comment := markup.find("<!--", max(at, last))) >= 0:
                stop = comment  # never closed
            text = markup[at:stop]
            if text:
                buffer.append(text)
                if in_link:
                    self.links[node] += len(text.strip())
            if not match:
                break
            at = match.end()
            comment, closing, opening, attributes, odd = match.groups()
            if comment:
                close = markup.find("-->", at)
                at = close + 3 if close >= 0 else end
            elif closing:
                tag = closing.lower()
                if tag in BLOCKS:
                    if depths[tag]:
                        close_to(depths[tag][-1])
                elif tag == "a":
                    in_link = 0
            elif opening or odd:
                if odd:
                    pattern = LOOSE_MARKUP
                tag = (opening or odd).lower()
                if tag in BLOCKS:
                    if tag == "html" or (tag == "body" and depths["body"]):
                        continue
                    flush()
                    if tag in CLOSES_P and stack[-1][0] == "p":
                        close_to(len(stack) - 1)
                    if siblings := CLOSED_BY.get(tag):
                        nearest = max((depths[t][-1] for t in siblings if depths[t]), default=0)
                        if nearest > scopes[-1]:
                            close_to(nearest)
                    self.parents.append(node)
                    self.tags.append(tag)
                    self.links.append(0)
                    found = NAMES.findall(attributes) if attributes else ()
                    self.names.append(" ".join(found).lower() if found else "")
                    node = len(self.tags) - 1
                    in_link = 0
                    depths[tag].append(len(stack))
                    if tag in SCOPES:
                        scopes.append(len(stack))
                    stack.append((tag, node))
                elif tag in HIDDEN:
                    if attributes and attributes.endswith("/"):
                        continue
                    ending = None if tag in unclosed else ENDING[tag].search(markup, at, last)
                    if ending is None:
                        unclosed.add(tag)
                        body = BODY.search(markup, at) if tag == "head" else None
                        at = body.start() if body else end
                    else:
                        at = ending.end()
                elif tag == "br":
                    buffer.append(" ")
                elif tag == "a":
                    in_link = 1
        flush()


def node_features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """One row per node; see the module's first lines. ``odds`` are those of attribute tokens; unknown ones say nothing."""
    n = len(page.tags)
    parents, tags = page.parents, page.tags
    own, punctuation, start = [0] * n, [0] * n, [0] * n
    total = 0
    for node, text in page.runs:
        own[node] += len(text)
        punctuation[node] += len(text) - len(text.translate(PUNCTUATION))
        total += len(text)
    chars, marks, links, blocks, paragraphs = own[:], punctuation[:], page.links[:], [1] * n, [0] * n
    children, child_chars, items = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = parents[i]
        paragraphs[i] += tags[i] == "p"
        items[i] += tags[i] == "li"
        chars[p] += chars[i]
        marks[p] += marks[i]
        links[p] += links[i]
        blocks[p] += blocks[i]
        paragraphs[p] += paragraphs[i]
        items[p] += items[i]
        children[p] += 1
        child_chars[p] += chars[i]
    out = np.zeros((n, 24 + len(TAG_FLAGS)))
    depth, before, seen = [0] * n, 0, [0] * n
    poor, good, outer, inner = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    position = 0
    runs = iter([*page.runs, (n, "")])
    at, text = next(runs)
    log = math.log1p
    for i in range(n):
        while at < i:
            position += len(text)
            at, text = next(runs)
        p = parents[i]
        words = WORDS.findall(page.names[i]) if page.names[i] else ()
        said = [odds[w] for w in words if w in odds]
        bad, fine = -sum(x for x in said if x < 0), sum(x for x in said if x > 0)
        tag = tags[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            poor[i], good[i], outer[i], inner[i] = poor[p], good[p], outer[p], inner[p]
            place, number = seen[p], children[p]
            seen[p] += 1
            mean = (child_chars[p] - chars[i]) / (number - 1) if number > 1 else 0.0
            shared = chars[i] / (chars[p] or 1)
        else:
            place, number, mean, shared = 0, 1, 0.0, 1.0
        size = chars[i]
        out[i, :24] = (
            depth[i], log(size), log(own[i]), links[i] / (size or 1), log(size / blocks[i]), size / (total or 1), shared,
            position / (total or 1), place / number, log(number), log(children[i]), log(mean), log(size) - log(mean), marks[i] / (size or 1),
            log(paragraphs[i]), items[i] / blocks[i], bad, fine, poor[i], good[i], outer[i], inner[i], marks[i], paragraphs[i] / blocks[i],
        )
        flag = FLAG_OF.get(tag)
        if flag is not None:
            out[i, 24 + flag] = 1
        poor[i] += bad
        good[i] += fine
        outer[i] += tag in OUTER_TAGS or (tag == "header" and not inner[i])
        inner[i] += tag in ("article", "main")
    return out


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """The best labelling in which every kept node has a kept parent; the root is kept."""
    n = len(page.tags)
    odds = np.clip(odds, -6, 6).tolist()
    odds[0] = 0.0
    drop = [-x for x in odds]
    keep = odds[:]
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[page.parents[i]] and (page.tags[i] == "body" or keep[i] > drop[i])
    return kept


class Extractor(NamedTuple):
    """The trees, and the log-odds of attribute tokens that their features use."""

    trees: BoostedTrees
    odds: dict[str, float]


def extract(markups: list[str | None], model: Extractor) -> list[str]:
    """Main texts of pages: kept blocks in page order, one to a line."""
    pages = [Page(m or "") for m in markups]
    features = [node_features(p, model.odds) for p in pages]
    odds = model.trees.score(np.concatenate(features)) if features else np.zeros(0)
    texts, at = [], 0
    for page in pages:
        kept = decode(page, odds[at : at + len(page.tags)])
        at += len(page.tags)
        texts.append("\n".join(text for node, text in page.runs if kept[node]))
    return texts


# --- Training pages -------------------------------------------------------------------------------------------

MAIN = "\ue000"  # marks a block of main text in a training page


def layouts(number: int, seed: int = 5) -> Iterator[str]:
    """Pages of meaningless words in many arrangements; blocks of main text begin with ``MAIN``."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p
    syllables = [a + b for a in "bdfglmnprstv" for b in "aeiou"]

    def word() -> str:
        return "".join(pick(syllables) for _ in range(rng.choice((1, 1, 2, 2, 3))))

    def words(low: int, high: int, mark: str = "") -> str:
        out = [word() for _ in range(rng.randint(low, high))]
        out = [w + pick(",,,.;:!?") if chance(0.08) else w for w in out]
        odd = pick(("%%%", "&amp;&amp;&amp;", "$$$", "###")) if chance(0.03) else ""
        return mark + " ".join(w + odd for w in out).capitalize() + pick((".", ".", ".", "", "!"))

    def link() -> str:
        return f'<a href="/{word()}">{words(1, 3)}</a>'

    def named(tag: str, names: str, inner: str, quote: str = '"') -> str:
        attribute = pick(("class", "class", "id"))
        return f"<{tag} {attribute}={quote}{pick(names.split())}{quote}>{inner}</{tag}>"

    def menu() -> str:
        inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"
        return f"<nav>{inner}</nav>" if chance(0.6) else named(pick(("div", "ul", "nav")), "menu nav nav-bar navbar navigation breadcrumb breadcrumbs topbar toolbar toc pagination pager skip-links", inner)

    def advert() -> str:
        inner = words(3, 40) if chance(0.8) else f"<p>{words(5, 40)}</p>"
        return named(pick(("div", "div", "aside", "section")), "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner ad-slot", inner)

    def notice() -> str:
        inner = pick((f"<p>{words(8, 30)}</p>", words(8, 30))) + pick(("", f"<button>{words(1, 2)}</button>"))
        return named(pick(("div", "section", "aside", "dialog")), "cookie-notice cookies consent alert warning notice gdpr gdpr-banner newsletter subscribe paywall popup modal overlay", inner)

    def form() -> str:
        inner = "".join(f"<label>{words(1, 4)}</label><input name='x'>" for _ in range(rng.randint(1, 3)))
        inner += pick(("", f"<p>{words(4, 20)}</p>", f"<select><option>{word()}</option><option>{word()}</option></select>"))
        form = f"<form>{inner}<button>{words(1, 2)}</button></form>"
        return form if chance(0.6) else named("div", "signup newsletter subscribe search search-box login form contact-form", form)

    def sidebar() -> str:
        inner = pick((menu(), f"<h3>{words(1, 4)}</h3><p>{words(5, 40)}</p>", f"<h4>{words(1, 3)}</h4><ul>" + "".join(f"<li>{link()}</li>" for _ in range(5)) + "</ul>"))
        return f"<aside>{inner}</aside>" if chance(0.5) else named("div", "sidebar side side-column aside widget related recommended more complementary", inner)

    def comments() -> str:
        inner = pick(("", f"<h3>{words(1, 3)}</h3>"))
        for _ in range(rng.randint(1, 6)):
            one = "".join(f"<p>{words(3, 60)}</p>" for _ in range(rng.randint(1, 2)))
            inner += pick((named("div", "comment reply comment-body", one), named("li", "comment reply", one), f"<article class='comment'>{one}</article>", one))
        return named(pick(("section", "div", "div", "ol")), "comments replies discussion comment-list respond disqus", inner)

    def footer() -> str:
        inner = pick((f"&copy; {word()}.example &middot; {words(3, 30)}", f"<p>&copy; {words(3, 30)}</p>", f"<p>{words(3, 20)}</p>" + menu()))
        return f"<footer>{inner}</footer>" if chance(0.7) else named("div", "footer foot bottom copyright site-footer contentinfo", inner)

    def header() -> str:
        inner = pick((f"<div class='logo'>{words(1, 3)}</div>", words(1, 4), f"<h1>{words(1, 3)}</h1>", f"<p>{words(2, 9)}</p>"))
        inner += pick(("", menu(), menu()))
        return f"<header>{inner}</header>" if chance(0.6) else named("div", "header masthead logo site-header topbar", inner)

    def paragraph() -> str:
        low, high = pick(((1, 6), (1, 3), (10, 40), (30, 120), (80, 250)))
        text = words(low, high, MAIN)
        if chance(0.15):
            text += f" {link()} {words(1, 10)}"
        open_tags = chance(0.15)
        return f"<p><b>{text}<br>" if open_tags else pick((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p><em>{text}</em></p>", f"<div>{text}</div>"))

    def block() -> str:
        kind = rng.random()
        if kind < 0.8:
            return paragraph()
        if kind < 0.85:
            return f"<h{pick('234')}>{words(1, 8, MAIN)}</h2>".replace("</h2>", "")
        if kind < 0.91:
            return "<ul>" + "".join(f"<li>{words(2, 25, MAIN)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.95:
            return f"<blockquote><p>{words(5, 50, MAIN)}</p></blockquote>"
        if kind < 0.97:
            return "<table><tr>" + "".join(f"<td>{words(1, 8, MAIN)}</td>" for _ in range(4)) + "</tr></table>"
        return f"<pre>{words(4, 30, MAIN)}</pre>"

    def share() -> str:
        return named("div", "share sharing social tags follow", "".join(link() for _ in range(rng.randint(2, 5))))

    def article() -> str:
        parts = []
        title = f"<h1>{words(1, 14, MAIN)}</h1>"
        parts.append(f"<header>{title}</header>" if chance(0.1) else title if chance(0.85) else "")
        for _ in range(pick((1, 2, 3, 6, 10, 18, 30))):
            parts.append(block())
            if chance(0.03):
                parts.append(pick((advert, share, notice, form))())
        if chance(0.1):
            parts.append(share())
        inner = "".join(parts)
        kind = rng.random()
        if kind < 0.55:
            return f"<article>{inner}</article>"
        if kind < 0.65:
            return f"<main>{inner}</main>"
        if kind < 0.7:
            return f"<div>{inner}</div>"
        return named(pick(("div", "section", "article", "div")), "content article article-body articlebody post entry entry-content story text main-text page-content post-body prose read blog news", inner)

    for _ in range(number):
        before = [f() for f, p in ((header, 0.4), (menu, 0.7), (notice, 0.2), (advert, 0.6), (form, 0.1), (sidebar, 0.2)) if chance(p)]
        after = [f() for f, p in ((sidebar, 0.25), (advert, 0.2), (comments, 0.3), (form, 0.15), (share, 0.1), (footer, 0.85), (notice, 0.1)) if chance(p)]
        if chance(0.2):
            rng.shuffle(before)
        middle = article()
        if chance(0.25):
            inside = [x for x in (before.pop() if before and chance(0.5) else "", after.pop(0) if len(after) > 1 and chance(0.5) else "")]
            wrapped = inside[0] + middle + inside[1]
            middle = pick((f"<main>{wrapped}</main>", f"<div id='wrapper'>{wrapped}</div>", f"<div class='container'>{wrapped}</div>"))
        head = f"<head><title>{words(1, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        ending = "</body></html>" if chance(0.85) else ""
        yield f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{middle}{''.join(after)}{ending}"


def labelled_page(markup: str) -> tuple[Page, np.ndarray]:
    """A training page, and whether main text lies in each node or below."""
    page = Page(markup)
    label = np.zeros(len(page.tags))
    for node, text in page.runs:
        if MAIN in text:
            label[node] = 1
    for i in range(len(label) - 1, 0, -1):
        label[page.parents[i]] = max(label[page.parents[i]], label[i])
    page.runs = [(node, text.replace(MAIN, "")) for node, text in page.runs]
    return page, label


def token_odds(pages: list[tuple[Page, np.ndarray]], least: int = 3) -> dict[str, float]:
    """Log-odds of main text in elements that bear a token, for tokens that occur ``least`` times."""
    counts: dict[str, list[int]] = defaultdict(lambda: [1, 1])
    for page, label in pages:
        for names, kind in zip(page.names, label, strict=True):
            for word in set(WORDS.findall(names)):
                counts[word][int(kind)] += 1
    return {word: math.log(kept / dropped) for word, (dropped, kept) in counts.items() if kept + dropped >= least + 2}


TRAINING_PAGES = 800


@functools.lru_cache(maxsize=2)
def trained(number: int = TRAINING_PAGES, seed: int = 5) -> Extractor:
    pages = [labelled_page(markup) for markup in layouts(number, seed)]
    odds = token_odds(pages)
    features = np.concatenate([node_features(page, odds) for page, _ in pages])
    return Extractor(BoostedTrees().fit(features, np.concatenate([label for _, label in pages])), odds)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html", model: Extractor | None = None) -> DataFrame:
    """Every row of ``pages``: ``page_id, url, text, n_chars``."""
    kind = pages.schema[page_id].dataType.simpleString()
    model = model or trained()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 200):
            texts = extract(columns(batch, "html")[0], model)
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(markup).cast("string").alias("html"))
    return rows.mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")
