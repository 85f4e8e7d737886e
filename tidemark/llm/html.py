"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

Each element gets features of its subtree (characters, words, links, tags, punctuation, their
densities), of its place (depth, order, siblings) and of its name and attribute tokens: its own,
its ancestors' and those below it. Boosted trees give the probability that the element's text is main text.
Decoding picks, for the whole tree at once, the best labelling in which what lies below a kept
element is kept and what lies below a dropped one is dropped; only an element that is mixed is
looked into. Second trees say how likely an element is to be mixed.

The trees are fitted on a bounded sample of the pages themselves. Main text is not labelled, so
the sample is taught by construction: the known article of a page is put, under varied markup,
between blocks of known boilerplate whose words come from the same pages. Where pages mark no
article, articles are made of the words of all their text.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames
from tidemark.llm.boost import BoostedTrees

# The most pages that are read for teaching.
TEACHING_PAGES = 240
# With fewer marked articles than this among them, made ones of their words fill up to the second number.
LEAST_ARTICLES, MADE_ARTICLES = 50, 120

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What holds no markup, and what holds some but no text of the page.
RAW = frozenset("script style iframe textarea title".split())
HIDDEN = frozenset("svg select template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded "
    "mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation "
    "annotation-xml".split()
)
# These stand within a line, too, but may hold blocks.
PHRASING = INLINE | {"object", "noscript"}
# Elements that end an open drawing, and those of a drawing that may hold them.
NOT_DRAWN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS_PAGE = frozenset(["foreignobject", "desc"])
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSES_ITSELF = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}
NAMES = (
    "p div span a li ul ol h1 h2 h3 h4 article main section nav header footer aside form table td blockquote pre b "
    "figure figcaption dl button label body"
).split()
# Words that pages use in class, id and role for parts of themselves.
TOKENS = (
    "ad ads advert advertisement sponsor sponsored promo banner cookie consent gdpr notice alert popup modal newsletter "
    "subscribe signup login search form menu nav navigation navbar breadcrumb sidebar widget aside rail related recommended "
    "popular share social comment comments reply discussion footer header masthead copyright legal pagination tags author "
    "meta article content post entry main story body text page container wrapper"
).split()
_NAME_AT = {n: k for k, n in enumerate(NAMES)}
_TOKEN_AT = {t: k for k, t in enumerate(TOKENS)}

# A quote opens a value only right after "="; a value that is never closed ends like one without quotes.
_VALUE = r"(?>\"[^\"]*\"|'[^']*'|[^\s>]*+)"
_NAMED = rf"[^\s/>][^\s/>=]*+(?>\s*+=\s*+{_VALUE})?+"
_ATTRIBUTE = re.compile(_NAMED)
_MARKUP = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[\s/]++|{_NAMED})*+)(?:>|\Z)", re.S
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LETTERS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_PART_NAMES = frozenset("article main section nav header footer aside form".split())
_PARTS = re.compile(rf"<(/?)(?:{'|'.join(sorted(_PART_NAMES))})\b")
_SAYS = re.compile(r' (?:class|id)="[^"]*"')


class Dom:
    """Elements, in page order, and the text pieces between tags."""

    def __init__(self, page: str):
        self.names, self.parents, self.marks = ["#page"], [-1], [""]
        self.texts: list[tuple[int, str]] = []  # (element, text)
        self.breaks: list[int] = []  # number of text pieces before each block edge
        self.hidden = [False]
        stack, at, unclosed = [("#page", 0)], 0, set()  # (name, element); what is hidden adds no elements
        while m := _MARKUP.search(page, at):
            if m.start() > at:
                self._text(stack[-1][1], page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if name not in PHRASING:
                self.breaks.append(len(self.texts))
            elif name == "br":
                self._text(stack[-1][1], " ")
            if m[1]:
                self._close(stack, name)
                continue
            raw = name in RAW and not _closed(m[3])
            if raw and name not in unclosed:
                end = _RAW_END[name].search(page, at)
                if end or name in ("script", "style"):
                    self._open(stack, name, m[3])
                    stack.pop()
                    at = end.start() if end else len(page)
                    continue
                unclosed.add(name)
            self._open(stack, name, m[3])
            if raw:
                # Without its end it is an element that ends with its parent.
                self.hidden[stack[-1][1]] = True
        if at < len(page):
            self._text(stack[-1][1], page[at:])

    def _text(self, element: int, text: str) -> None:
        if not self.hidden[element]:
            self.texts.append((element, entities.unescape(text)))

    def _close(self, stack: list[tuple[str, int]], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                del stack[k:]
                return
            # A stray inline end does not close a block.
            if name in INLINE and stack[k][0] not in INLINE:
                return

    def _open(self, stack: list[tuple[str, int]], name: str, attributes: str) -> None:
        if name in NOT_DRAWN and self.hidden[stack[-1][1]]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in HOLDS_PAGE or stack[k][0] in HIDDEN:
                    if stack[k][0] == "svg":
                        del stack[k:]
                    break
        if name not in PHRASING and name not in RAW and name not in HIDDEN:
            for k in range(len(stack) - 1, 0, -1):
                inner = stack[k][0]
                if inner in CLOSED_BY_BLOCK:
                    del stack[k:]
                    break
                if inner not in INLINE:
                    break
        if name in CLOSES_ITSELF:
            for k in range(len(stack) - 1, 0, -1):
                inner = stack[k][0]
                if inner in CLOSES_ITSELF[name]:
                    break
                if inner == name:
                    del stack[k:]
                    break
        element = stack[-1][1]
        if not self.hidden[element]:
            self.names.append(name)
            self.parents.append(element)
            self.marks.append(attributes if "=" in attributes else "")
            self.hidden.append(name in HIDDEN)
            element = len(self.names) - 1
        if name not in VOID and not _closed(attributes):
            stack.append((name, element))


def _closed(attributes: str) -> bool:
    """Whether a tag closes itself: its last slash is not the end of a value."""
    return attributes.endswith("/") and max((m.end() for m in _ATTRIBUTE.finditer(attributes)), default=0) < len(attributes)


def features(doms: list[Dom]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all elements of the pages, their parents, and the first element of each page."""
    sizes = np.array([len(d.names) for d in doms])
    first = np.append(0, np.cumsum(sizes))[:-1]
    n = int(sizes.sum())
    parent = np.concatenate([np.where(np.array(d.parents) < 0, -1, np.array(d.parents) + f) for d, f in zip(doms, first, strict=True)])
    name = np.zeros((n, len(NAMES)), np.float32)
    token = np.zeros((n, len(TOKENS)), np.float32)
    own = np.zeros((n, 5))  # characters, words, marks, link characters, tags
    own[:, 4] = 1
    link = np.zeros(n, bool)
    for d, f in zip(doms, first.tolist(), strict=True):
        for k, (what, marks) in enumerate(zip(d.names, d.marks, strict=True), f):
            at = _NAME_AT.get(what)
            if at is not None:
                name[k, at] = 1
            link[k] = what == "a"
            if marks:
                for mark in _MARKS.finditer(marks):
                    for word in _LETTERS.findall((mark[2] or mark[3] or mark[4] or "").lower()):
                        at = _TOKEN_AT.get(word)
                        if at is not None:
                            token[k, at] = 1
        for element, text in d.texts:
            row = own[f + element]
            row[0] += len(text) - text.count(" ")
            row[1] += len(text.split())
            row[2] += text.count(".") + text.count(",")
    depth, ends, children = [0] * n, list(range(1, n + 1)), [0] * n
    ups = parent.tolist()
    for k, p in enumerate(ups):
        if p >= 0:
            depth[k] = depth[p] + 1
            children[p] += 1
    for k in range(n - 1, -1, -1):
        if ups[k] >= 0:
            ends[ups[k]] = max(ends[ups[k]], ends[k])
    depth, ends, children = np.array(depth), np.array(ends), np.array(children)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    marks = np.concatenate([name[:, [_NAME_AT[x] for x in "a li article main nav header footer aside form".split()]], token], 1)
    above = marks.copy()
    for level in levels[1:]:
        above[level] = np.maximum(above[level], above[parent[level]])
        link[level] |= link[parent[level]]
    own[:, 3] = own[:, 0] * link
    # Elements are in page order, so what lies below one is a run.
    summed = np.concatenate([np.zeros((1, marks.shape[1]), np.float32), marks.cumsum(0)])
    below = (summed[ends] - summed[np.arange(1, n + 1)] > 0).astype(np.float32)
    summed = np.concatenate([np.zeros((1, own.shape[1])), own.cumsum(0)])
    sub = summed[ends] - summed[:-1]
    up = np.maximum(parent, 0)
    order = np.arange(n)
    page = np.repeat(first, sizes)
    total = np.maximum(sub[page, 0], 1)
    siblings = np.maximum(children[up], 1)
    rank = np.zeros(n)
    seen: dict[int, int] = {}
    for k, p in enumerate(parent.tolist()):
        rank[k] = seen[p] = seen.get(p, -1) + 1
    chars, count = np.maximum(sub[:, 0], 1), np.maximum(sub[:, 1], 1)
    numbers = np.stack(
        [
            np.log1p(sub[:, 0]),
            np.log1p(own[:, 0]),
            sub[:, 3] / chars,
            np.log1p(sub[:, 0] / sub[:, 4]),
            sub[:, 2] / count,
            chars / count,
            np.log1p(sub[:, 4]),
            sub[:, 0] / total,
            sub[:, 0] / np.maximum(sub[up, 0], 1),
            np.log1p(sub[up, 0] / siblings),
            sub[up, 3] / np.maximum(sub[up, 0], 1),
            depth,
            rank / siblings,
            siblings,
            (order - page) / sizes.repeat(sizes),
            children,
        ],
        axis=1,
    )
    return np.concatenate([numbers, name, token, above, below], 1).astype(np.float32), parent, first


def decode(main: np.ndarray, mixed: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Whether each element's own text is kept: the likeliest consistent labelling of each tree.

    ``main`` and ``mixed`` are probabilities. An element is kept whole, dropped whole, or
    mixed; then its own text follows ``main`` and its children are labelled on their own.
    """
    main = np.clip(main, 1e-4, 1 - 1e-4)
    has_child = np.zeros(len(main), bool)
    has_child[parent[parent >= 0]] = True
    mixed = np.where(has_child, np.clip(mixed, 1e-4, 1 - 1e-4), 0)
    pure = np.log(1 - mixed)
    keep, drop = pure + np.log(main), pure + np.log(1 - main)
    with np.errstate(divide="ignore"):
        split = np.log(mixed)
    best = np.empty(len(main))
    for k in range(len(main) - 1, -1, -1):
        best[k] = max(keep[k], drop[k], split[k])
        up = parent[k]
        if up >= 0:
            keep[up] += keep[k]
            drop[up] += drop[k]
            split[up] += best[k]
    out, settled = np.zeros(len(main), bool), np.zeros(len(main), bool)
    for k in range(len(main)):
        up = parent[k]
        if up >= 0 and settled[up]:
            out[k], settled[k] = out[up], True
        else:
            settled[k] = split[k] < max(keep[k], drop[k])
            out[k] = keep[k] >= drop[k] if settled[k] else main[k] >= 0.5
    return out


def block_text(dom: Dom, kept: np.ndarray) -> str:
    """Kept text pieces, joined within blocks, white space as one space, blocks on lines."""
    lines, part, edge = [], [], 0
    for k, (element, text) in enumerate(dom.texts):
        while edge < len(dom.breaks) and dom.breaks[edge] <= k:
            edge += 1
            if part:
                lines.append("".join(part))
                part = []
        if kept[element]:
            part.append(text)
    lines.append("".join(part))
    lines = [_SPACE.sub(" ", line).strip() for line in lines]
    return "\n".join(line for line in lines if line)


def _boilerplate(rng: random.Random, words: list[str]) -> str:
    """A block of a kind that is not main text, in one of the ways pages write it."""

    def some(low: int, high: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))

    def tag(names: str, marks: str, inner: str) -> str:
        name = rng.choice(names.split())
        mark = rng.choice(marks.split())
        how = rng.random()
        attribute = f' class="{mark}"' if how < 0.5 else f' id="{mark}"' if how < 0.7 else f' class="x-{mark} block"'
        plain = name not in ("div", "section", "ul", "p", "li", "article") and rng.random() < 0.5
        return f"<{name}{'' if plain else attribute}>{inner}</{name}>"

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{some(1, 3)}</a></li>' for k in range(n))

    def prose(low: int, high: int) -> str:
        return "".join(f"<p>{some(8, 40)}.</p>" for _ in range(rng.randint(low, high)))

    kind = rng.randrange(9)
    if kind == 0:
        return tag("nav div ul", "menu nav navigation navbar breadcrumb", f"<ul>{links(rng.randint(3, 9))}</ul>")
    if kind == 1:
        return tag("header div", "header masthead banner", f"<a href='/'>{some(1, 3)}</a><p>{some(2, 8)}</p>")
    if kind == 2:
        return tag("footer div", "footer copyright legal", f"&copy; {some(2, 12)}. {some(3, 12)}.")
    if kind == 3:
        inner = f"<h3>{some(1, 4)}</h3>" + (f"<ul>{links(rng.randint(2, 8))}</ul>" if rng.random() < 0.6 else prose(1, 2))
        return tag("aside div section", "sidebar widget rail related recommended popular aside", inner)
    if kind == 4:
        return tag("div section p", "cookie consent gdpr notice alert popup modal", some(6, 30) + ". <button>OK</button>")
    if kind == 5:
        return tag("div aside p", "ad ads advert advertisement sponsor sponsored promo banner", some(4, 30) + ".")
    if kind == 6:
        inner = f"<label>{some(1, 4)}</label><input name='q'><button>{some(1, 2)}</button>"
        return f"<form>{inner}</form>" if rng.random() < 0.5 else tag("form div", "form search login newsletter subscribe signup", inner)
    if kind == 7:
        inner = "".join(tag("div div li p article", "comment reply", f"<b>{some(1, 2)}</b> {prose(1, 2)}") for _ in range(rng.randint(1, 4)))
        return tag("div section ul", "comments discussion reply comment", f"<h3>{some(1, 2)}</h3>{inner}")
    return tag("div ul", "share social tags pagination author meta", "".join(f'<a href="#">{some(1, 1)}</a> ' for _ in range(rng.randint(2, 5))))


def _marked(dom: Dom) -> bool:
    """Whether a page says of any part, by name or attributes, what it is."""
    if not _PART_NAMES.isdisjoint(dom.names):
        return True
    said = (m[2] or m[3] or m[4] or "" for marks in dom.marks if marks for m in _MARKS.finditer(marks))
    return any(word in _TOKEN_AT for value in said for word in _LETTERS.findall(value.lower()))


def _article(rng: random.Random, words: list[str]) -> list[str]:
    """A made article: a title and paragraphs of sentences."""

    def sentence(low: int, high: int) -> str:
        some = [rng.choice(words) for _ in range(rng.randint(low, high))]
        return " ".join(w + "," if rng.random() < 0.06 else w for w in some)

    def paragraph() -> str:
        if rng.random() < 0.15:
            return sentence(1, 4) + "."
        return " ".join(sentence(2, 25) + "." for _ in range(rng.randint(1, 8)))

    return [sentence(2, 12), *(paragraph() for _ in range(rng.randint(1, 12)))]


def teaching_pages(pages: list[str], seed: int = 5) -> list[tuple[str, list[bool]]]:
    """Pages with known main text: element by element, whether its text is main."""
    rng = random.Random(seed)
    doms, taken = [Dom(page) for page in pages], []
    for dom in doms:
        for k, name in enumerate(dom.names):
            if name in ("article", "main"):
                inside = np.zeros(len(dom.names), bool)
                for j in range(k, len(dom.names)):
                    inside[j] = j == k or dom.parents[j] >= k and inside[dom.parents[j]]
                text = block_text(dom, inside)
                if text:
                    taken.append([entities.escape(line, quote=False) for line in text.split("\n")])
                break
    marked = len(taken)
    # As many made pages as of the given ones mark nothing by name, class or id.
    bare = sum(not _marked(d) for d in doms) / max(1, len(doms))
    if marked < LEAST_ARTICLES:
        # Words as they lie in the page, so that those of the longest texts are the most; without any, known ones.
        every = [entities.escape(w.strip(".,"), quote=False) for d in doms for _, text in d.texts for w in text.split()]
        every = [w for w in every if w] or list(TOKENS)
        made = random.Random(seed + 1)
        taken += [_article(made, every) for _ in range(MADE_ARTICLES - marked)]
    words = [w for lines in taken for line in lines for w in line.split()][:20_000]
    out = []
    for number, lines in enumerate(taken):
        for k in range(2):
            if k and rng.random() < 0.2:  # a page of two short lines
                lines = [line[: rng.randint(12, 45)].rsplit("&", 1)[0] or "x" for line in lines[:2]]
            head = rng.choice(["h1", "h1", "h2"])
            body = f"<{head}>{lines[0]}</{head}>"
            # Short articles, too, and those whose first line says the title again.
            rest = lines[1:] if rng.random() < 0.7 else lines[1 : rng.choice([1, 2, 2, 3])]
            if rng.random() < 0.25:
                rest = [line[: rng.randint(20, 120)].rsplit("&", 1)[0] for line in rest]
            for line in ([lines[0]] if rng.random() < 0.2 else []) + rest:
                style = rng.random()
                if style < 0.06:
                    body += "<ul>" + "".join(f"<li>{x}</li>" for x in line.split(". ")) + "</ul>"
                elif style < 0.12:
                    body += f"<blockquote>{line}</blockquote>"
                elif style < 0.2 and " " in line:
                    a, b = line.split(" ", 1)
                    body += f'<p><a href="#">{a}</a> {b}</p>'
                elif style < 0.3:
                    body += f"<p><b>{line}<br>"
                else:
                    body += f"<p>{line}</p>"
            inner = rng.random() < 0.2
            name = rng.choice(["article", "article", "main", "div", "div", "section"])
            mark = rng.choice(['', ' class="content"', ' id="main"', ' class="post entry"', ' class="article body"', ' class="story text"'])
            parts = [(0, _boilerplate(rng, words)) for _ in range(rng.randint(0, 3))]
            # What stands between marks is main; the marks are elements that no page has.
            parts += [(1, f"<{name}{mark}>{body}" + (f"<x-off>{_boilerplate(rng, words)}</x-off>" if inner else "") + f"</{name}>")]
            parts += [(0, _boilerplate(rng, words)) for _ in range(rng.randint(0, 4))]
            text = "".join(f"<x-on>{x}</x-on>" if main else x for main, x in parts)
            wrap = rng.random()
            if wrap < 0.4:
                text = f'<div class="{rng.choice(["page", "container", "wrapper"])}">{text}</div>'
            if number >= marked and rng.random() < bare:
                text = _SAYS.sub("", _PARTS.sub(r"<\1div", text))
            out.append(f"<html><head><title>{lines[0]}</title></head><body>{text}</body></html>")
    return out


def teach(pages: list[str]) -> tuple[BoostedTrees, BoostedTrees]:
    """Trees for main and for mixed elements, fitted on teaching pages."""
    taught = teaching_pages(pages)
    rows, labels, weights, mixes = [], [], [], []
    for at in range(0, len(taught), 50):
        doms, marks = [], []
        for page in taught[at : at + 50]:
            marked = Dom(page)
            main = []
            for name, parent in zip(marked.names, marked.parents, strict=True):
                main.append({"x-on": True, "x-off": False}.get(name, main[parent] if parent >= 0 else False))
            marks.append([x for x, name in zip(main, marked.names, strict=True) if not name.startswith("x-")])
            doms.append(Dom(re.sub(r"</?x-o[nf]f?>", "", page)))
        x, parent, first = features(doms)
        y = np.concatenate([np.array(m, bool) for m in marks])
        own = np.zeros(len(y))
        for d, f in zip(doms, first, strict=True):
            for element, text in d.texts:
                own[f + element] += len(text.strip())
        both = np.stack([own, own * y], 1)
        for k in range(len(y) - 1, 0, -1):
            if parent[k] >= 0:
                both[parent[k]] += both[k]
        # An element is main if most of the text below it is, and mixed if not all or none is.
        share = both[:, 1] / np.maximum(both[:, 0], 1)
        rows.append(x)
        labels.append(np.where(both[:, 0] > 0, share >= 0.5, y))
        mixes.append((share > 0) & (share < 1))
        weights.append(np.where(both[:, 0] > 0, 1.0, 0.05))
    x, y, weight = np.concatenate(rows), np.concatenate(labels).astype(float), np.concatenate(weights)
    return BoostedTrees().fit(x, y, weight), BoostedTrees().fit(x, np.concatenate(mixes).astype(float), weight)


def extract_texts(pages: list[str], model: tuple[BoostedTrees, BoostedTrees]) -> list[str]:
    doms = [Dom(page) for page in pages]
    if not doms:
        return []
    x, parent, first = features(doms)
    kept = decode(model[0].predict(x), model[1].predict(x), parent)
    ends = np.append(first[1:], len(parent))
    return [block_text(d, kept[a:b]) for d, a, b in zip(doms, first, ends, strict=True)]


def teaching_sample(pages: DataFrame) -> list[str]:
    """The pages of the ``TEACHING_PAGES`` smallest id hashes; ids are ranked first, then their pages are read.

    Without any id they are those of the smallest hashes of the pages themselves.
    """
    known = pages.where("html is not null and page_id is not null")
    ids = known.select("page_id").orderBy(F.xxhash64("page_id", F.lit(3)), "page_id").limit(TEACHING_PAGES).collect()
    if not ids:
        rest = pages.where("html is not null").select("html").orderBy(F.xxhash64("html"), "html")
        return [r.html for r in rest.limit(TEACHING_PAGES).collect()]
    wanted = known.where(F.col("page_id").isin([r.page_id for r in ids]))
    # An id may be repeated: which of its pages teach does not depend on the order of rows.
    rows = wanted.select("html").orderBy(F.xxhash64("html"), "html").limit(TEACHING_PAGES)
    return [r.html for r in rows.collect()]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html, ...)``.

    A null or empty page, and one without main text, has an empty text. Character references are
    decoded as HTML does, white space inside a block is one space, blocks are lines. Repeated
    rows and null ids are pages like others. Other columns are ignored. An empty table gives an
    empty result. The trees are fitted on ``TEACHING_PAGES`` pages, those of the smallest hash;
    if fewer than ``LEAST_ARTICLES`` of them have an ``article`` or ``main`` element with text,
    made articles of the words of all these pages teach, too.
    """
    model = teach(teaching_sample(pages))

    def run(batches):
        for batch in batches:
            for part in frames.text_slices(batch, "html", 1 << 20):
                texts = [x or "" for x in part.column("html").to_pylist()]
                texts = extract_texts(texts, model)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
