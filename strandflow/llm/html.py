"""Main text of web pages: flat text blocks, classified by a small decision tree from their own and their neighbours' shape."""

from __future__ import annotations

import functools
import random
import re
import sys
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select button object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
#: Elements that say of themselves that they aren't the article; header counts outside an article only.
ASIDE = frozenset("nav aside footer form dialog menu head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class and id that often name such containers.  They are hints: what a container holds decides with them.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notification alert popup modal overlay newsletter subscribe subscription signup login register search share sharing "
    "social breadcrumb breadcrumbs menu nav navbar navigation topnav footer foot header masthead topbar toolbar sidebar aside "
    "related recommended recommendations widget widgets pagination pager comment comments commentlist disqus respond reply "
    "replies discussion copyright legal disclaimer skip tags".split())
#: A tag with quoted values; possessive, so that broken pages cost no backtracking.
TAG = re.compile(r"""</?([a-zA-Z][^\s/><]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+)>""")
#: The same up to the next bracket, for pages with a quote that never ends.
BARE_TAG = re.compile(r"</?([a-zA-Z][^\s/><]*+)([^<>]*+)>")
ATTR = re.compile(r"""([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++))""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HEADING = re.compile(r"h[1-6]$")
#: What begins like a tag, or ends the page before it says what it begins.
OPENS = re.compile(r"</?(?:[a-zA-Z]|\Z)")


@dataclass
class Block:
    text: str
    linked: int
    element: int
    tag: str
    feats: dict = field(default_factory=dict)


def _flagged(name: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element says that it is no part of the article, and whether its class or id hints at that."""
    if name in ASIDE or (name == "header" and not in_article):
        return True, False
    if not attrs or name in ("html", "body"):
        return False, False
    hint = False
    for key, *values in ATTR.findall(attrs):
        value, key = next((v for v in values if v), ""), key.lower()
        if key == "role" and value.lower() in ROLES or key == "style" and re.search(r"display\s*:\s*none", value):
            return True, hint
        if key in ("class", "id"):
            words = {w.lower() for w in NAME.findall(value)}
            hint |= bool(words & HINTS) and not (in_article and words <= {"header", "post", "entry", "article"})
    return bool(re.search(r"\shidden(?=[\s/]|$)", attrs)), hint


def blocks(html: str) -> list[Block]:
    """Flat blocks of a page in order, white space made single, references decoded, each with its features.

    One pass over the page with a stack of open elements; wrong nesting closes what it encloses.  Only void elements have no
    content; a tag that the page's end cuts off is none of its text.  An element that encloses an article, main or h1 isn't hinted at,
    whatever its name says.
    """
    parent, flags, hints, encloses, names = [-1], [False], [False], [False], ["#"]
    stack, articles, opened, settled = [0], 0, Counter(), set()
    found: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            if joined := " ".join(unescape("".join(text)).split()):
                found.append(Block(joined, len(unescape("".join(linked)).split()), stack[-1], names[stack[-1]]))
            text, linked = [], []

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if links:
                linked.append(piece + " ")

    i, n, pattern, last = 0, len(html), TAG, html.rfind(">")
    while i < n:
        j = html.find("<", i)
        if j < 0:
            add(html[i:])
            break
        add(html[i:j])
        if j > last and OPENS.match(html, j):
            break
        if html.startswith("<!--", j):
            k = html.find("-->", j + 4)
            i = n if k < 0 else k + 3
            continue
        if html.startswith(("<!", "<?"), j):
            k = html.find(">", j)
            i = n if k < 0 else k + 1
            continue
        m = pattern.match(html, j)
        if not m and pattern is TAG and (m := BARE_TAG.match(html, j)):
            # Only an open quote makes the two differ: from here on quotes mean nothing.
            pattern = BARE_TAG
        if not m:
            add("<")
            i = j + 1
            continue
        i = m.end()
        name, attrs, closing = m[1].lower(), m[2], html[j + 1] == "/"
        if name in BLOCK:
            flush()
        elif name == "br":
            add(" ")
        if closing:
            if name == "a":
                links = max(0, links - 1)
            # Only what is open is closed, with all that it encloses.
            while opened[name]:
                inner = names[stack.pop()]
                opened[inner] -= 1
                articles -= inner in ("article", "main")
                if inner == name:
                    break
            continue
        if name in RAW:
            if not (name == "svg" and attrs.endswith("/")):
                end = re.compile(f"</{name}\\b[^>]*>?", re.I).search(html, i)
                i = end.end() if end else n
            continue
        if name == "a":
            links = 1
        if name in VOID or name not in BLOCK:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "body") or HEADING.match(name):
            close = {"body": "head"}.get(name, "p" if name not in ("li", "td", "th", "tr", "dt", "dd") else name)
            if names[stack[-1]] == close:
                opened[names[stack.pop()]] -= 1
        elif names[stack[-1]] == "p":
            opened[names[stack.pop()]] -= 1
        e = len(names)
        if name in ("article", "main", "h1"):
            for x in reversed(stack):
                if (name == "h1", x) in settled:
                    break
                settled.add((name == "h1", x))
                if name != "h1" or names[x] in ("div", "section", "form", "main", "article", "header"):
                    encloses[x] = True
        parent.append(stack[-1])
        flag, hint = _flagged(name, attrs, articles > 0)
        flags.append(flag)
        hints.append(hint)
        encloses.append(False)
        names.append(name)
        stack.append(e)
        opened[name] += 1
        articles += name in ("article", "main")
    flush()

    # By element: inside one that is no part of the article, inside an article, and the outermost one around it that is hinted at.
    out, inside, hinted = [False], [False], [0]
    for e in range(1, len(names)):
        out.append(out[parent[e]] or (flags[e] and not (encloses[e] and names[e] not in ("aside", "footer"))))
        inside.append(inside[parent[e]] or names[e] in ("article", "main"))
        hinted.append(hinted[parent[e]] or (e if hints[e] and not encloses[e] else 0))
    page_has = any(inside)
    words = [len(b.text.split()) for b in found]
    density = [b.linked / w for b, w in zip(found, words)]
    held, articles_held, plain, in_articles = Counter(), Counter(), 0, 0
    for k, b in enumerate(found):
        if not out[b.element]:
            free = words[k] - b.linked
            held[hinted[b.element]] += free
            plain += free
            articles_held[hinted[b.element]] += free * inside[b.element]
            in_articles += free * inside[b.element]
    for k, b in enumerate(found):
        around = hinted[b.element]
        b.feats = {
            "outside": float(out[b.element]), "hinted": float(around > 0), "hinted_share": held[around] / plain if around and plain else 0.0,
            "article_elsewhere": float(around > 0 and in_articles > articles_held[around]),
            "article": float(inside[b.element]), "page_has_article": float(page_has),
            "heading": float(bool(HEADING.match(b.tag))), "item": float(b.tag in ("li", "td", "th", "dt", "dd")),
            "words": float(words[k]), "density": density[k],
            "words_before": float(words[k - 1]) if k else 0.0, "density_before": density[k - 1] if k else 0.0,
            "words_after": float(words[k + 1]) if k + 1 < len(found) else 0.0,
            "density_after": density[k + 1] if k + 1 < len(found) else 0.0,
        }
    return found


FEATURES = ("outside", "hinted", "hinted_share", "article_elsewhere", "article", "page_has_article", "heading", "item", "words", "density",
            "words_before", "density_before", "words_after", "density_after")

#: Vocabulary of the labelled pages.
SAID = ("the river rose before noon and people carried chairs to an upper floor where nobody had slept for years while somebody else counted boats "
        "under a bridge that engineers had promised to repair after winter but money went into roads instead").split()
NAMED = {
    "advert": ("ad", "advert", "sponsored", "promo-box", "banner"), "notice": ("cookie-notice", "consent", "notice", "newsletter-signup", "popup"),
    "comments": ("comments", "comment-list", "discussion", "replies"), "related": ("related", "recommended", "widget", "share-buttons", "tags"),
    "menu": ("menu", "topnav", "breadcrumbs", "pagination", "sidebar"),
    "wrapper": ("related-work", "newsletter-archive", "post-comments-policy", "widget-design", "banner-history", "notice-board", "social-history", "menu-of-the-day"),
}


def labelled_pages(pages: int = 240, seed: int = 5) -> list[str]:
    """The labelled table: pages of our own making; blocks that start with + belong to the main text, those with - do not.

    Articles are in article or main, in containers with any name or with none, or have hinting names themselves; around and in
    them are menus, headers, adverts, notices, lists of links, comments longer and shorter than the article, forms and footers.
    """
    r = random.Random(seed)

    def prose(least: int, most: int, mark: str = "+") -> str:
        return f"{mark} {' '.join(r.choice(SAID) for _ in range(r.randint(least, most)))}."

    def link(mark: str) -> str:
        return f"<a href=/{r.randint(1, 99)}>{prose(1, 3, mark)}</a>"

    def box(kind: str, inner: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        tag = r.choice(tags)
        return f"<{tag} {r.choice(('class', 'id'))}={r.choice(NAMED[kind])}>{inner}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link('-')}</li>" for _ in range(n)) + "</ul>"

    def body(short: bool) -> str:
        parts = [f"<h{r.randint(1, 3)}>{prose(2, 8)}</h{r.randint(1, 3)}>"] if r.random() < 0.7 else []
        for _ in range(1 if short else r.randint(2, 7)):
            kind = r.random()
            if kind < 0.6:
                parts.append(f"<p>{prose(8, 70)}</p>")
            elif kind < 0.75:
                parts.append(f"<p>{prose(1, 6)}</p>")
            elif kind < 0.83:
                parts.append("<ul>" + "".join(f"<li>{prose(2, 12)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<p>{link('+')}</p>" if not short else f"<p>{prose(8, 30)}</p>")
            elif kind < 0.93:
                parts.append("<table><tr>" + "".join(f"<td>{prose(1, 5)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                parts.append(f"<blockquote>{prose(6, 40)}</blockquote>")
        return "".join(parts)

    def around() -> list[str]:
        return [box("advert", prose(3, 20, "-")), box("notice", f"<p>{prose(5, 25, '-')}</p>"), box("related", f"<h4>{prose(1, 3, '-')}</h4>{links(3)}"),
                box("related", prose(1, 5, "-")), f"<aside><h2>{prose(1, 3, '-')}</h2><p>{prose(8, 40, '-')}</p></aside>", box("menu", links(4)),
                f"<form><p>{prose(3, 9, '-')}</p></form>", f"<div role=complementary>{prose(5, 30, '-')}</div>"]

    def comments(most: int) -> str:
        return box("comments", "".join(f"<p>{prose(5, 45, '-')}</p>" for _ in range(r.randint(1, most))))

    out = []
    for k in range(pages):
        way = k % 6
        short = r.random() < 0.3
        top = r.choice((f"<nav>{links(r.randint(2, 6))}</nav>", f"<header>{link('-')} {prose(2, 6, '-')}</header>", f"<div>{link('-')} {link('-')}</div>" if way < 4 else "", ""))
        foot = r.choice((f"<footer>{prose(2, 12, '-')}</footer>", box("menu", links(2)), ""))
        extra = r.sample(around(), r.randint(0, 3))
        main = body(short)
        if way < 2:
            tag = r.choice(("article", "main"))
            inner = r.choice((box("advert", prose(3, 18, "-")), box("related", links(2)), comments(3), box("notice", prose(4, 20, "-")), "", ""))
            page = f"<{tag}>{main}{inner}</{tag}>" + r.choice((comments(8), "", ""))
        elif way == 2:
            page = f"<div {r.choice(('class=content', 'id=main-text', 'class=page', ''))}>{main}</div>" + (comments(2) if not short else "")
        elif way == 3:
            page = main
        elif way == 4:
            # The article's own container has a name that hints at something else.
            page, extra = box("wrapper", "".join(f"<p>{prose(12, 60)}</p>" for _ in range(1 if short else r.randint(2, 5)))), []
            foot = f"<footer>{prose(2, 8, '-')}</footer>" if foot else ""
        else:
            page = f"<article>{r.choice((f'<h2>{prose(1, 4)}</h2>', ''))}<p>{prose(1, 5)}</p></article>" + comments(6)
        r.shuffle(extra)
        at = r.randint(0, len(extra))
        out.append(top + "".join(extra[:at]) + page + "".join(extra[at:]) + foot)
    return out


@functools.cache
def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    found = [b for page in labelled_pages() for b in blocks(page)]
    return np.array([[b.feats[f] for f in FEATURES] for b in found]), np.array([b.text.startswith("+") for b in found])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 2):
    """A tree of (feature, threshold, left, right) with labels at its leaves; splits by Gini impurity, first best wins."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return bool(y.mean() >= 0.5)
    best = (1e-9, None)
    own = y.mean() * (1 - y.mean()) * len(y)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) < least:
                continue
            rest = sum(y[s].mean() * (1 - y[s].mean()) * s.sum() for s in (left, ~left))
            if own - rest > best[0] + 1e-12:
                best = (own - rest, (f, float(t)))
    if best[1] is None:
        return bool(y.mean() >= 0.5)
    f, t = best[1]
    left = x[:, f] <= t
    return f, t, grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


@functools.cache
def tree():
    return grow(*labelled_table())


def is_content(node, feats: list[float]) -> bool:
    while not isinstance(node, bool):
        f, t, low, high = node
        node = low if feats[f] <= t else high
    return node


def main_text(html: str | None) -> str:
    """The blocks that the tree takes for main text, joined by an empty line; an empty or null page has none."""
    node = tree()
    return "\n\n".join(b.text for b in blocks(html or "") if is_content(node, [b.feats[f] for f in FEATURES]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars, n_blocks, n_kept.

    Rows are independent of each other: null ids and urls pass through, null html is an empty page, repeated rows
    give repeated results, no rows give none.  Whole pages are read, whatever their length.
    """
    kinds, node = dict(pages.dtypes), tree()

    def run(batches):
        for batch in batches:
            texts, n_blocks, n_kept = [], [], []
            for html in batch.column(2):
                found = blocks(html.as_py() or "")
                kept = [b.text for b in found if is_content(node, [b.feats[f] for f in FEATURES])]
                texts.append("\n\n".join(kept))
                n_blocks.append(len(found))
                n_kept.append(len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(n_blocks, pa.int32()), pa.array(n_kept, pa.int32())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long, n_blocks int, n_kept int")
