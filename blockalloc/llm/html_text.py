"""Main text of web pages by gradient-boosted trees over DOM nodes."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.llm.labelled import sigmoid
from blockalloc.llm.tokens import strings
from blockalloc.session import shuffle_partitions, table

#: Pages that the trees are fitted on, at most.
TRAIN_PAGES = 800

#: What begins markup; any other "<" is text.
START = re.compile(r"<(?:!--|!\[CDATA\[|[!?/]|[a-zA-Z])")
#: A tag: no attempt reads a character twice, and quotes count only where a value begins.
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?>[\s/]++|=?[^\s/>=]++(?>\s*+=\s*+(?>\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)?+)?+|=)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "template", "textarea", "iframe", "title", "select"}
#: What never holds main text, whatever the trees say.
NEVER = {"head", "script", "style", "template", "textarea", "iframe", "title", "select", "button", "option", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Formulas and drawings stand in the text that holds them; only inside them does "/>" end an element.
FOREIGN = {"math", "svg"}
INLINE |= FOREIGN | {"mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mpadded", "mspace", "semantics", "g", "path", "tspan"}
#: A start tag in a set ends an open element of the set's key, unless one of the barriers stands between.
CLOSES = {
    "p": {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure", "details"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
}
BARRIER = {"p": {"button", "td", "th", "div", "article", "section"}, "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
OPEN_BY = {tag: tuple(k for k, v in CLOSES.items() if tag in v) for tag in set().union(*CLOSES.values())}


class Page:
    """Block elements of a page in order: parent, tag, tokens and depth; and pieces of text with the block that holds each."""

    __slots__ = ("parent", "tag", "tokens", "depth", "text", "links", "tags")

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens, self.depth = [-1], ["#"], [()], [0]
        self.text: list[tuple[int, str]] = []  # block, text
        self.links, self.tags = defaultdict(int), defaultdict(int)  # characters in links, inline tags
        stack: list[tuple[str, int]] = [("#", 0)]  # open elements and their block
        opened: Counter[str] = Counter()  # how many of each are open
        never, at, size = 0, 0, len(source)
        unended: set[str] = set()  # raw elements that no end tag follows

        def close(depth: int) -> None:
            nonlocal never
            for tag, _ in stack[depth:]:
                never -= tag in NEVER
                opened[tag] -= 1
            del stack[depth:]

        while at < size:
            m = START.search(source, at)
            stop = m.start() if m else size
            if stop > at and not never:
                self.say(stack[-1][1], source[at:stop], opened["a"])
            if not m:
                break
            tag = TAG.match(source, stop)
            if not tag:
                at = self.skip(source, m, None if never else stack[-1][1], opened["a"])
                continue
            at, name = tag.end(), tag[1].lower()
            if source[stop + 1] == "/":
                if opened[name]:
                    depth = len(stack) - 1
                    while stack[depth][0] != name:
                        depth -= 1
                    if any(t not in INLINE for t, _ in stack[depth:]):
                        self.text.append((stack[depth - 1][1], None))
                    close(depth)
                elif name == "p":
                    self.text.append((stack[-1][1], None))
                continue
            for key in OPEN_BY.get(name, ()):
                if opened[key]:
                    depth = len(stack) - 1
                    while depth > 0 and stack[depth][0] != key and stack[depth][0] not in BARRIER[key]:
                        depth -= 1
                    if depth > 0 and stack[depth][0] == key:
                        close(depth)
            block = stack[-1][1]
            if name in VOID:
                if name in ("br", "hr"):
                    self.text.append((block, " " if name == "br" else None))
                continue
            if source[at - 2] == "/" and (name in FOREIGN or any(opened[t] for t in FOREIGN)):
                continue
            if name in RAW and name not in unended:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                stop = source.find(">", end.end()) + 1 if end else 0
                if stop:
                    at = stop
                    continue
                unended.add(name)
            if name in ("script", "style"):
                break  # what follows is its text
            if name in INLINE:
                self.tags[block] += 1
                stack.append((name, block))
            else:
                if name not in ("html", "body"):
                    self.text.append((block, None))
                self.parent.append(block)
                self.tag.append(name)
                self.depth.append(self.depth[block] + 1)
                self.tokens.append(tokens_of(name, tag[2]))
                stack.append((name, len(self.tag) - 1))
            opened[name] += 1
            never += name in NEVER

    def skip(self, source: str, m: re.Match, block: int | None, links: int) -> int:
        """Where a comment, declaration or unfinished tag ends. The text of a CDATA section is said, unless it has no block."""
        if m[0] == "<!--":
            if source.startswith((">", "->"), m.end()):
                return source.index(">", m.end()) + 1
            end = re.compile("--!?>").search(source, m.end())
            return end.end() if end else len(source)
        if m[0] == "<![CDATA[":
            end = source.find("]]>", m.end())
            if block is not None:
                self.say(block, source[m.end() : end if end >= 0 else len(source)], links)
            return end + 3 if end >= 0 else len(source)
        if m[0][1] in "!?" or m[0] == "</" and not source[m.end() : m.end() + 1].isalpha():
            end = source.find(">", m.end())
            return end + 1 if end >= 0 else len(source)
        return len(source)  # a tag that nothing ends

    def say(self, block: int, text: str, links: int) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.text.append((block, text))
        if links:
            self.links[block] += len(text.strip())

    def segments(self) -> list[tuple[int, str]]:
        """Runs of text of one block between block boundaries, white space reduced."""
        out, run, of = [], [], None
        for block, text in [*self.text, (-1, None)]:
            if text is None or block != of:
                if run:
                    joined = SPACE.sub(" ", "".join(run)).strip()
                    if joined:
                        out.append((of, joined))
                run, of = [], block
            if text is not None:
                run.append(text)
        return out


def tokens_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of class, id and role."""
    out = [f"<{tag}>"]
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            if m[1].lower() in ("class", "id", "role", "itemprop"):
                out += NAME.findall((m[2] or m[3] or m[4] or "").lower())
    return tuple(out)


FEATURES = 26
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def features(page: Page, segments: list[tuple[int, str]], value: dict[str, float]) -> np.ndarray:
    """A row for each block element: its own and its subtree's text, tokens along its path, place, and siblings."""
    n = len(page.tag)
    own, words, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    place = np.full(n, np.inf)
    seen = 0
    for block, text in segments:
        own[block] += len(text)
        words[block] += text.count(" ") + 1
        stops[block] += text.count(".") + text.count(",")
        place[block] = min(place[block], seen)
        seen += len(text)
    parent = np.array(page.parent)
    chars, links, below, all_words, all_stops = own.copy(), np.zeros(n), np.ones(n), words.copy(), stops.copy()
    for b, k in page.links.items():
        links[b] += k
    inline = np.zeros(n)
    for b, k in page.tags.items():
        inline[b] = k
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        below[p] += below[i]
        all_words[p] += all_words[i]
        all_stops[p] += all_stops[i]
        place[p] = min(place[p], place[i])
    place[~np.isfinite(place)] = seen
    low, high, total = np.zeros(n), np.zeros(n), np.zeros(n)
    mine = np.array([min((value.get(t, 0.0) for t in ts), key=lambda v: -abs(v), default=0.0) for ts in page.tokens])
    for i in range(1, n):
        p = parent[i]
        low[i], high[i] = min(low[p], mine[i]), max(high[p], mine[i])
        total[i] = total[p] * 0.8 + mine[i]
    kids = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    kid_chars = np.bincount(parent[1:], chars[1:], n) if n > 1 else np.zeros(n)
    safe = np.maximum(parent, 0)
    index, last = np.zeros(n), defaultdict(int)
    same = np.zeros(n)
    for i in range(1, n):
        index[i] = last[parent[i]]
        last[parent[i]] += 1
        last[parent[i], page.tag[i]] += 1
    for i in range(1, n):
        same[i] = last[parent[i], page.tag[i]]
    tag = page.tag
    size = max(seen, 1)
    cols = [
        np.log1p(own), np.log1p(chars), np.log1p(all_words), links / np.maximum(chars, 1), all_stops / np.maximum(all_words, 1),
        chars / np.maximum(below, 1), chars / np.maximum(all_words, 1), np.log1p(below), np.array(page.depth), place / size, chars / size,
        low, high, total, mine, mine[safe], low[safe],
        kids[safe], same / np.maximum(kids[safe], 1), index / np.maximum(kids[safe], 1), np.log1p(kid_chars[safe] / np.maximum(kids[safe], 1)), chars / np.maximum(kid_chars[safe], 1),
        np.array([t == "p" for t in tag]), np.array([t in HEADS for t in tag]), np.array([t in ("li", "ul", "ol", "td", "tr", "table") for t in tag]), inline,
    ]
    return np.stack([np.asarray(c, np.float32) for c in cols], axis=1)


class Trees:
    """Gradient-boosted trees on binned features, logistic loss, grown level by level."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32):
        self.depth, self.trees = depth, []
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        width = bins + 1
        for _ in range(rounds):
            p = sigmoid(z)
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**depth, np.int64), np.full(2**depth, width)
            for level in range(depth):
                first, many = 2**level, 2**level
                best = np.full(many, 1e-3)
                gains = []
                for f in range(x.shape[1]):
                    key = node * width + b[:, f]
                    gl = np.bincount(key, g, many * width).reshape(many, width).cumsum(1)
                    hl = np.bincount(key, h, many * width).reshape(many, width).cumsum(1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < 1) | (ht - hl < 1)] = 0
                    gains.append(gain)
                    top = gain.argmax(1)
                    better = gain[np.arange(many), top] > best
                    best = np.where(better, gain[np.arange(many), top], best)
                    feature[first : first + many][better] = f
                    cut[first : first + many][better] = top[better]
                node = 2 * node + (b[np.arange(len(y)), feature[first + node]] > cut[first + node])
            leaf = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + 1)
            z = z + leaf[node]
            self.trees.append((feature, cut, leaf))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        z = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level + node
                node = 2 * node + (b[rows, feature[at]] > cut[at])
            z += leaf[node]
        return z


#: Names by which pages mark their main part, and parts that aren't it; they label the training pages.
MAIN_WORDS = ["article", "content", "post", "entry", "story", "main", "body", "text"]
OTHER_WORDS = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc"],
    "header": ["header", "masthead", "topbar", "branding", "banner"],
    "footer": ["footer", "copyright", "legal", "colophon"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "tags", "share", "social"],
    "div": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "cookie", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall"],
    "section": ["comment", "comments", "reply", "replies", "discussion", "respond", "disqus"],
    "form": ["form", "search", "login", "signup", "contact"],
}
OTHER_TAGS = {"nav", "header", "footer", "aside", "form"}
OTHER = {w for ws in OTHER_WORDS.values() for w in ws} - {"banner", "text", "content"}


def labels_of(page: Page, whole: bool = False) -> np.ndarray:
    """1 for blocks in the marked main part and in no marked other part, else 0; -1 where a page marks no main part. ``whole``: the page is the main part."""
    n = len(page.tag)
    state = np.zeros(n, np.int8)  # 0 outside, 1 main, 2 other
    state[0] = whole
    for i in range(1, n):
        own = set(page.tokens[i][1:])
        if state[page.parent[i]] == 2 or page.tag[i] in OTHER_TAGS or own & OTHER:
            state[i] = 2
        elif state[page.parent[i]] == 1 or page.tag[i] in ("article", "main") or "marked" in own:
            state[i] = 1
    return np.where((state == 1).any(), (state == 1).astype(float), -1.0) * np.ones(n)


def varied(source: str, seed: int) -> str:
    """A page with its main part under another name and other parts added, so that the trees don't rest on one layout."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    texts = [t for t in (SPACE.sub(" ", html.unescape(x)).strip() for x in re.findall(r">([^<>]{20,2000})<", source)) if t][:40] or ["Lorem ipsum dolor sit amet."]

    def sentence(most: int) -> str:
        w = pick(texts).split(" ")
        a = int(rng.integers(len(w)))
        return html.escape(" ".join(w[a : a + int(rng.integers(3, most))]))

    def part() -> str:
        kind = pick(list(OTHER_WORDS))
        name = pick(OTHER_WORDS[kind])
        tag = pick([kind, "div", "section"]) if kind not in ("div", "section") else pick(["div", "section", "aside"])
        mark = pick([f' class="{name}"', f' id="{name}"', f' class="site-{name}"', f' class="{name}-box wide"'])
        if kind == "nav":
            body = "<ul>" + "".join(f'<li><a href="#">{sentence(5)}</a></li>' for _ in range(rng.integers(3, 9))) + "</ul>"
        elif kind == "section":
            body = "".join(f'<div class="{pick(["comment", "reply"])}"><b>{sentence(4)}</b><p>{sentence(40)}</p></div>' for _ in range(rng.integers(1, 6)))
        elif kind == "form":
            body = f"<label>{sentence(5)}</label><input name=q><p>{sentence(12)}</p><button>Ok</button>"
        else:
            body = "".join(pick([f"<p>{sentence(30)}</p>", f'<h3>{sentence(6)}</h3>', f'<a href="#">{sentence(8)}</a>', sentence(25)]) for _ in range(rng.integers(1, 5)))
        return f"<{tag}{mark}>{body}</{tag}>"

    m = re.search(r"<article\b[^>]*>(.*)</article>", source, re.S | re.I)
    if not m:
        return source
    tag = pick(["div", "section", "main", "article", "div"])
    name = pick(MAIN_WORDS)
    inner = m[1]
    if rng.random() < 0.4:  # something foreign inside the main part
        cut = [x.end() for x in re.finditer(r"</p>", inner)]
        if cut:
            at = cut[int(rng.integers(len(cut)))]
            inner = inner[:at] + part() + inner[at:]
    if rng.random() < 0.3:
        inner += f"<{pick(['ul', 'ol'])}>" + "".join(f"<li>{sentence(20)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>"
    if rng.random() < 0.3:
        inner += f"<blockquote>{sentence(40)}</blockquote><h2>{sentence(8)}</h2><p>{sentence(60)}</p>"
    body = f'<{tag} class="marked {name}">{inner}</{tag}>'
    if rng.random() < 0.5:
        body = f"<div>{body}</div>"
    before = "".join(part() for _ in range(rng.integers(0, 3)))
    after = "".join(part() for _ in range(rng.integers(0, 4)))
    return source[: m.start()] + before + body + after + source[m.end() :]


#: Names of main and other parts in pages of other languages.
FOREIGN_MAIN = ["inhalt", "contenu", "contenido", "texto", "artikel", "beitrag", "corps", "cuerpo", "nota", "seite", "hauptteil", "articulo"]
FOREIGN_OTHER = ["kopf", "fuss", "leiste", "werbung", "pied", "entete", "barre", "publicite", "pie", "cabecera", "barra", "anuncio", "randspalte", "lateral", "cote", "verwandte"]


def rebuilt(source: str, seed: int) -> tuple[str, bool]:
    """The main part of a page in a layout that the given pages don't have; and whether it is the whole page.

    Straight in the body, as bare paragraphs or without any markup, in a cell of a table,
    under foreign or meaningless names, with line breaks or boxes for paragraphs, with
    menus and notices around it or without.
    """
    m = re.search(r"<(article|main)\b[^>]*>(.*)</\1>", source, re.S | re.I)
    if not m:
        return source, False
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    inner = re.sub(r"<(script|style|aside|nav|form)\b.*?</\1>", " ", m[2], flags=re.S | re.I)
    plain = [t for t in (SPACE.sub(" ", x).strip() for x in re.findall(r">([^<>]+)<", f">{inner}<")) if t] or ["Lorem ipsum dolor sit amet."]
    few = plain[: int(rng.integers(1, len(plain) + 1))]
    if rng.random() < 0.5:  # shorter texts of the same page
        inner = "".join(f"<p>{t}</p>" for t in few)
        if rng.random() < 0.4:
            inner = f"<{pick(['h1', 'h2'])}>{' '.join(few[0].split(' ')[:8])}</h1>" + inner
    shape = int(rng.integers(4))
    if shape == 1:
        inner = inner.replace("<p>", "<div>").replace("</p>", "</div>")
    elif shape == 2:
        inner = "<br><br>".join(few)
    words = " ".join(plain).split(" ")

    def some(n: int) -> str:
        at = int(rng.integers(len(words)))
        return " ".join(words[at : at + 1 + int(rng.integers(n))])

    def name() -> str:
        return pick([f' class="{pick(FOREIGN_OTHER)}"', f' id="{pick(FOREIGN_OTHER)}"', f' class="{pick("bcdfghk")}{pick("aeiou")}{pick("lmnrst")}{pick("aeiou")}"', ""])

    def links(tag: str) -> str:
        item = pick(["<li>{}</li>", "{} | ", "<div>{}</div>", "{} "])
        return f"<{tag}{name()}>" + "".join(item.format(f'<a href="#">{some(4)}</a>') for _ in range(rng.integers(3, 9))) + f"</{tag}>"

    def other(tag: str) -> str:
        kind = int(rng.integers(4))
        if kind < 2:
            return links(tag)
        if kind == 2:
            return f"<{tag}{name()}>&copy; {some(6)}</{tag}>"
        return f'<{tag} class="{pick(["ad", "notice", "cookie", "werbung", "anuncio", "publicite"])}">{some(14)} <a href="#">{some(3)}</a></{tag}>'

    if rng.random() < 0.35:
        listed = "".join(f"<li>{some(24)}</li>" for _ in range(rng.integers(2, 6)))
        inner += pick([f"<ul>{listed}</ul>", f"<ol>{listed}</ol>", f"<blockquote>{some(40)}</blockquote><ul>{listed}</ul>"])
    head = f"<html><head><title>{some(6)}</title></head>"
    layout = int(rng.integers(8))
    if layout == 0:
        return f'{head}<body class="marked">{inner}</body></html>', False
    if layout == 1:
        return inner, True
    if layout == 2:
        return " ".join(few) if rng.random() < 0.5 else "\n\n".join(few), True
    if layout == 3:
        around = [other("td") for _ in range(rng.integers(1, 3))]
        cells = [*around, f'<td{pick(["", " valign=top", " width=70%"])} class="marked">{inner}</td>']
        if rng.random() < 0.3:
            cells = cells[::-1]
        rows = pick(["<tr>" + "".join(cells) + "</tr>", "".join(f"<tr>{c}</tr>" for c in cells)])
        return f"{head}<body><table>{rows}</table></body></html>", False
    around = [other(pick(["div", "div", "section", "ul", "p"])) for _ in range(rng.integers(0, 5))]
    cut = int(rng.integers(len(around) + 1))
    if layout == 4:  # beside the main part's blocks, straight in the body
        body = re.sub(r"<(p|div|h[1-6]|ul|ol|blockquote|table|pre|figure)(?=[\s>])", r'<\1 data-x class="marked"', inner) if shape != 2 else f'<p class="marked">{inner}</p>'
        return f"{head}<body>{''.join(around[:cut])}{body}{''.join(around[cut:])}</body></html>", False
    label = pick([f' class="marked {pick(FOREIGN_MAIN)}"', f' class="marked" id="{pick(FOREIGN_MAIN)}"', ' class="marked"', f' class="marked {pick("bcdfghk")}{pick("aeiou")}{pick("lmnrst")}{pick("aeiou")}"'])
    main = f"<div{label}>{inner}</div>"
    if layout == 6:
        main = f"<div><div{name()}>{main}</div></div>"
    return f"{head}<body>{''.join(around[:cut])}{main}{''.join(around[cut:])}</body></html>", False


def hidden(page: Page) -> Page:
    """The page without the label that a varied one carries; some lose their other names too, so that shape counts."""
    page.tokens = [tuple(t for t in ts if t != "marked") for ts in page.tokens]
    return page


def variants(source: str) -> Iterator[tuple[Page, np.ndarray]]:
    """A training page as it is, varied, and twice rebuilt in another layout, each with the labels of its blocks."""
    seed = zlib.crc32(source.encode())
    made = [(source, False), (varied(source, seed + 1), False), rebuilt(source, seed + 2), rebuilt(source, seed + 3)]
    for text, whole in made:
        page = Page(text)
        y = labels_of(page, whole)
        if (y >= 0).all():
            yield hidden(page), y


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many main and other blocks of training pages have a token."""
    for b in batches:
        seen = Counter((t, bool(k)) for source in strings(b.column(0)) for page, y in variants(source) for k, own in zip(y > 0, page.tokens, strict=True) for t in set(own))
        cols = list(zip(*seen, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(seen.values(), pa.int64())], ["token", "main", "n"])


def training_blocks(value):
    """Features and labels of the blocks of training pages; one page in four, by its text, has no names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source in strings(b.column(0)):
                for k, (page, y) in enumerate(variants(source)):
                    x = features(page, page.segments(), {} if zlib.crc32(source.encode(), k) % 4 == 3 else value.value)
                    rows.append((zlib.crc32(source.encode(), k), x.tobytes(), y.astype(np.float32).tobytes()))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["page", "x", "y"])

    return run


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages that mark their main part."""
    for b in batches:
        yield b.filter(pa.array([bool((labels_of(Page(t)) >= 0).all()) for t in strings(b.column(0))], pa.bool_()))


def fit(pages: DataFrame, most: int = TRAIN_PAGES) -> tuple[dict[str, float], Trees | None]:
    """Token values and trees from at most ``most`` pages that mark their main part, chosen by a hash of the page's id and url.

    Only pages that name the mark and whose hash is low enough that some four times as
    many are left are parsed and enter the sort, so what it reads doesn't grow with the
    input. Where too few of them turn out to be marked, more are let in, up to all.
    """
    named = pages.where(F.col("html").rlike("(?i)<(article|main)")).select("html", F.xxhash64("page_id", "url").alias("_h"), "page_id")
    share = 4 * most / max(1, named.count())
    while True:
        low = named.where(F.col("_h") < F.lit(int(2**64 * share) - 2**63)) if share < 1 else named
        chosen = low.mapInArrow(marked, "html string, _h long, page_id long").orderBy("_h", "page_id").limit(most).select("html").repartition(shuffle_partitions(pages.sparkSession), "html").checkpoint()
        if share >= 1 or chosen.count() >= most:
            break
        share *= 8
    seen = chosen.mapInArrow(count_tokens, "token string, main boolean, n long").groupBy("token").agg(F.sum(F.when(F.col("main"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("main"), 0).otherwise(F.col("n"))).alias("b")).where("a + b >= 5").toPandas()
    value = {t: float(np.log((a + 1) / (b + 1))) for t, a, b in seen.sort_values("token").itertuples(index=False)}
    shipped = pages.sparkSession.sparkContext.broadcast(value)
    data = chosen.mapInArrow(training_blocks(shipped), "page long, x binary, y binary").toPandas().sort_values(["page", "x"])
    shipped.destroy()
    if not len(data):
        return value, None
    x = np.frombuffer(b"".join(data["x"]), np.float32).reshape(-1, FEATURES)
    y = np.frombuffer(b"".join(data["y"]), np.float32).astype(float)
    return value, Trees(x, y, 0.2 + np.minimum(x[:, 0], 5))


def decode(parent: list[int], logit: np.ndarray, own: np.ndarray, never: np.ndarray, price: float = 2.0) -> np.ndarray:
    """Which blocks are main text, so that the sum of decisions is largest and none contradicts an ancestor.

    A subtree is main throughout, other throughout, or mixed: then its children are
    decided by themselves, which costs ``price``. Blocks without text weigh nothing.
    """
    n = len(parent)
    gain = np.where(own > 0, logit * np.log1p(own), 0.0)
    gain[never] = -1e6
    all_main, mixed = gain.copy(), np.zeros(n)
    all_other = -gain
    for i in range(n - 1, 0, -1):
        best = max(all_main[i], all_other[i], mixed[i] + max(gain[i], -gain[i]) - price)
        all_main[parent[i]] += all_main[i]
        all_other[parent[i]] += all_other[i]
        mixed[parent[i]] += best
    keep, state = np.zeros(n, bool), np.zeros(n, np.int8)  # 0 mixed, 1 main, 2 other
    for i in range(n):
        if i and state[parent[i]]:
            state[i] = state[parent[i]]
        else:
            free = mixed[i] + max(gain[i], -gain[i]) - price
            if i and max(all_main[i], all_other[i]) >= free:
                state[i] = 1 if all_main[i] > all_other[i] else 2
        keep[i] = state[i] == 1 or (state[i] == 0 and gain[i] > 0)
    return keep


def texts_of_pages(sources: list[str], value: dict[str, float], trees: Trees | None) -> list[str]:
    pages = [Page(s) for s in sources]
    cut = [p.segments() for p in pages]
    if trees is None:
        return [" ".join(t for _, t in s) for s in cut]
    xs = [features(p, s, value) for p, s in zip(pages, cut, strict=True)]
    logit = trees.logit(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for page, segments, x in zip(pages, cut, xs, strict=True):
        never = np.array([t in NEVER for t in page.tag])
        own = np.expm1(x[:, 0].astype(float)).round()
        keep = decode(page.parent, logit[at : at + len(x)], own, never)
        at += len(x)
        out.append(" ".join(t for b, t in segments if keep[b]))
    return out


def main_text(pages: DataFrame, most: int = TRAIN_PAGES) -> DataFrame:
    """Main text of each page of ``pages(page_id, url, html, ...)``.

    Each block element of the DOM gets features of its own text, its subtree's density,
    the tag and attribute names on its path, depth, place and siblings; gradient-boosted
    trees score it, and a dynamic programme over the DOM keeps ancestors and descendants
    consistent. The trees are fitted on at most ``most`` pages, chosen among all that name
    their main part by <article> or <main>: as they are, rearranged under other names, and
    rebuilt in layouts that mark nothing (straight in the body, bare paragraphs, no markup,
    table cells, foreign names).

    Result per row: page_id, url, text (blocks in page order, white space reduced,
    joined by a space), n_chars. Null counts as empty; html without markup is a page whose
    root holds all its text; a page without main text gives an empty text. Without pages to learn from, all text
    outside scripts, styles and controls counts as main. Repeated rows each get a row;
    other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    model = pages.sparkSession.sparkContext.broadcast(fit(rows, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, trees = model.value
        for b in batches:
            sources, texts = list(strings(b.column(2))), []
            for lo in range(0, len(sources), 200):
                texts += texts_of_pages(sources[lo : lo + 200], value, trees)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
