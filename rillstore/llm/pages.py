"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into leaf blocks: runs of text between block-level tags. A bidirectional LSTM, in numpy,
reads the blocks in page order, each as a hashed vector of its path of tags (with classes and ids), a
hashed vector of its words and a few figures, and gives the chance that the block belongs to the
article, in the light of the whole page. The labeller is trained here, once per process, on pages
made up from a seed (``training_pages``): articles among menus, headers, footers, sidebars, notices,
adverts, forms and comments, in many layouts.

Raw text (scripts, styles, text fields, titles) is no block; what browsers do not show (templates, choices of
a list, fallbacks for browsers without scripts or frames) is none either; all else is labelled, formulas and
drawings with text like their surroundings.

Defined results: a null or empty page gives an empty text; unclosed tags are closed by the end of what holds
them or the page's end, unclosed raw text too; unclosed comments and quotes end with the page or the tag;
repeated rows are labelled each on their own; an empty table gives no rows; a page of any length is one
sequence of blocks; extra columns are not read.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstore.cluster import ship_package
from rillstore.llm import words as W

RESULT = "page_id long, url string, text string, n_chars long"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>])*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z0-9]+")

# HTML's elements without content, of raw text, of content that is not shown, and those that do not part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
UNSEEN = frozenset("template noscript select datalist iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr "
    "area audio canvas embed map meter object output picture progress source track video "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover semantics annotation svg g text tspan textpath".split()
)
#: Blocks that end an open paragraph or item of the same kind.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements beyond which an open item is not closed.
_SCOPE = frozenset("ul ol dl table body article section div".split())


@functools.cache
def _end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I)


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in page order; character references decoded, white space joined."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # tag, and tag with its class and id words
    parts: list[str] = []
    linked = at = 0
    in_link = hidden = 0

    def close() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, tuple(x[1] for x in stack), min(linked, len(text))))
            parts.clear()
        linked = 0

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a and not hidden:
            own = page[a:b]
            parts.append(html.unescape(own) if "&" in own else own)
            if in_link:
                linked += b - a

    while (m := _TOKEN.search(page, at)) is not None:
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # a closing tag
            if tag not in INLINE:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            in_link = sum(x[0] == "a" for x in stack) if in_link else 0
            hidden = sum(x[0] in UNSEEN for x in stack) if hidden else 0
            continue
        if tag in RAW:
            close()
            if not m[3].rstrip().endswith("/"):
                end = _end(tag).search(page, at)
                if end is None and stack:  # not closed: up to the end of what holds it
                    end = _end(stack[-1][0]).search(page, at)
                    at = end.start() if end else len(page)
                else:
                    at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            close()
            if any(x[0] == "p" for x in stack):  # a block ends an open paragraph and what is open in it
                del stack[next(i for i, x in enumerate(stack) if x[0] == "p") :]
            for kind in _CLOSES.get(tag, ()):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == kind:
                        del stack[i:]
                        break
                    if stack[i][0] in _SCOPE:
                        break
            in_link = sum(x[0] == "a" for x in stack) if in_link else 0
            hidden = sum(x[0] in UNSEEN for x in stack) if hidden else 0
        elif tag == "br":
            parts.append(" ")
        if tag not in VOID and not m[3].endswith("/"):
            names = " ".join(w for v in _NAMES.findall(m[3]) for w in _WORDS.findall("".join(v).lower())) if m[3] else ""
            stack.append((tag, f"{tag} {names}" if names else tag))
            in_link += tag == "a"
            hidden += tag in UNSEEN
    text(at, len(page))
    close()
    return out


# --- what the labeller reads -------------------------------------------------------------------

PATH, WORD, FIGURES = 128, 64, 8
INPUT, HIDDEN = PATH + WORD + FIGURES, 24
_PUNCTUATION = re.compile(r"[.!?;:,]")


def _slot(word: str, n: int, kind: str) -> int:
    return zlib.crc32(f"{kind}{word}".encode()) % n


class Reader:
    """Block vectors; remembers the vectors of paths and the slots of words it has met."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        v = self.paths.get(path)
        if v is None:
            v = np.zeros(PATH, np.float32)
            for i, step in enumerate(reversed(path)):
                tag, *names = step.split()
                v[_slot(tag, PATH, "t")] += 1.0 if i else 2.0
                for w in names:
                    v[_slot(w.rstrip("0123456789") or "0", PATH, "n")] += 1.5
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = v = np.minimum(v, 3)
        return v

    def page(self, own: list[Block]) -> np.ndarray:
        x = np.zeros((len(own), INPUT), np.float32)
        known = self.words
        if len(known) > 200_000:
            known.clear()
        for i, b in enumerate(own):
            x[i, :PATH] = self.path(b.path)
            words = b.text.lower().split()
            for w in words:
                if w not in known:
                    known[w] = _slot(w, WORD, "w")
            count = np.bincount([known[w] for w in words], minlength=WORD)
            x[i, PATH : PATH + WORD] = np.log1p(count) / (1 + np.log1p(len(words)))
            n = len(b.text)
            x[i, PATH + WORD :] = (
                np.log1p(n) / 6, np.log1p(len(words)) / 4, b.linked / n, min(1.0, 12 * len(_PUNCTUATION.findall(b.text)) / n),
                b.text[-1] in ".!?\"'", sum(map(str.isdigit, b.text)) / n, "©" in b.text, len(b.path) / 8,
            )
        return x


# --- the labeller ------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], d: str, keep: bool = False):
    """One direction over (time, pages, input); a masked step leaves the state as it is."""
    t, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    into = x @ w[f"x{d}"] + w[f"b{d}"]
    hs, tape = np.zeros((t, n, HIDDEN), np.float32), []
    for k in range(t):
        z = into[k] + h @ w[f"h{d}"]
        gate = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        c2 = f * c + i * g
        y = np.tanh(c2)
        m = mask[k][:, None]
        if keep:
            tape.append((h, c, i, f, o, g, y, m))
        h, c = np.where(m, o * y, h), np.where(m, c2, c)
        hs[k] = h
    return hs, tape


def _backward(x: np.ndarray, dh_out: np.ndarray, tape: list, w: dict[str, np.ndarray], d: str, grad: dict[str, np.ndarray]) -> None:
    t, n, _ = x.shape
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dz = np.zeros((t, n, 4 * HIDDEN), np.float32)
    for k in range(t - 1, -1, -1):
        h, c, i, f, o, g, y, m = tape[k]
        dh = dh + dh_out[k]
        dy = dh * o * m
        dc2 = dc * m + dy * (1 - y * y)
        dz[k] = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dh * m * y * o * (1 - o), dc2 * i * (1 - g * g)], 1)
        dc = dc2 * f + dc * (1 - m)
        grad[f"h{d}"] += h.T @ dz[k]
        dh = dz[k] @ w[f"h{d}"].T + dh * (1 - m)
    flat = dz.reshape(t * n, -1)
    grad[f"x{d}"] += x.reshape(t * n, -1).T @ flat
    grad[f"b{d}"] += flat.sum(0)


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), INPUT), np.float32), np.zeros((t, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


def _logits(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], keep: bool = False):
    a, ta = _forward(x, mask, w, "f", keep)
    b, tb = _forward(x[::-1], mask[::-1], w, "r", keep)
    both = np.concatenate([a, b[::-1]], 2)
    return both @ w["out"] + w["bias"], both, ta, tb


def label(pages: list[np.ndarray], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The chance of each block to be main text. Pages of like length go together; none is cut."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        size = max(1, min(256, 12_000 // len(pages[order[min(at + 255, len(order) - 1)]])))
        own = order[at : at + size]
        at += len(own)
        x, mask = _batch([pages[i] for i in own])
        p = _sigmoid(_logits(x, mask, w)[0])
        for j, i in enumerate(own):
            out[i] = p[: len(pages[i]), j]
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 7, epochs: int = 6, size: int = 48, rate: float = 6e-3) -> dict[str, np.ndarray]:
    """Weights after some rounds of Adam on the pages' blocks and their labels."""
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fr":
        w[f"x{d}"] = rng.normal(0, 0.1, (INPUT, 4 * HIDDEN))
        w[f"h{d}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        w[f"b{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
    w["out"], w["bias"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(())
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    order = sorted((i for i in range(len(pages)) if len(pages[i][0])), key=lambda i: len(pages[i][0]))
    groups = [order[i : i + size] for i in range(0, len(order), size)]
    for _ in range(epochs):
        for j in rng.permutation(len(groups)):
            x, mask = _batch([pages[i][0] for i in groups[j]])
            y = np.zeros(mask.shape, np.float32)
            for n, i in enumerate(groups[j]):
                y[: len(pages[i][1]), n] = pages[i][1]
            z, both, ta, tb = _logits(x, mask, w, True)
            d = ((_sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["out"], grad["bias"] = np.tensordot(d, both, ((0, 1), (0, 1))), d.sum()
            dh = d[:, :, None] * w["out"]
            _backward(x, dh[:, :, :HIDDEN], ta, w, "f", grad)
            _backward(x[::-1], dh[::-1, :, HIDDEN:], tb, w, "r", grad)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


# --- pages to learn from -----------------------------------------------------------------------

#: Marks the text of main blocks in made-up pages.
_MAIN = ""


def _made_up(rng: np.random.Generator) -> str:
    """A page of invented words, in one of many layouts; main blocks begin with a mark."""
    parts = [rng.choice(["ka", "ron", "ti", "sel", "mo", "the", "an", "er", "ing", "qué", "sch", "ü", "la", "vi"], 8) for _ in range(40)]
    words = ["".join(rng.choice(parts[int(rng.integers(40))], int(rng.integers(1, 4)))) for _ in range(150)]
    junk = rng.random() < 0.15

    def say(a: int, b: int, dot: bool = True, mark: bool = False) -> str:
        own = list(rng.choice(words, int(rng.integers(a, b + 1))))
        own[0] = own[0].capitalize()
        for i in range(len(own)):
            if rng.random() < 0.12:
                own[i] += ","
            elif dot and rng.random() < 0.1:
                own[i] += "."
            if junk and rng.random() < 0.5:
                own[i] += str(rng.choice(["%%%", "***", "&amp;&amp;", "###", "$$$"]))
        return (_MAIN if mark else "") + " ".join(own) + ("." if dot else "")

    def pick(*names: str) -> str:
        return str(rng.choice(names))

    def named(tag: str, *names: str) -> str:
        if not names or rng.random() < 0.1:
            return f"<{tag}>"
        return f"<{tag} {pick('class', 'id')}=\"{pick(*names)}{pick('', '', '', '-1', ' wide', '-box')}\">"

    def links(n: int, bare: bool = False) -> str:
        if rng.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3, False)}</a></li>' for i in range(n)) + "</ul>"
        return "".join(f'<a href="/{i}">{say(1, 2, False)}</a>{pick(" ", " | ")}' for i in range(n)) if bare else "".join(f'<div><a href="/{i}">{say(1, 4, False)}</a></div>' for i in range(n))

    def menu() -> str:
        t = pick("nav", "nav", "div", "ul")
        return (f"<nav>{links(int(rng.integers(2, 9)))}</nav>" if t == "nav" else named("div", "menu", "nav", "navbar", "navigation", "breadcrumbs", "topbar") + links(int(rng.integers(2, 9)), True) + "</div>")

    def header() -> str:
        t = pick("header", "div")
        return (f"<{t}>" if t == "header" else named("div", "header", "masthead", "banner", "site-header")) + pick("", f"<h1>{say(1, 3, False)}</h1>", f"<p>{say(2, 8, rng.random() < .5)}</p>", f'<a href="/">{say(1, 2, False)}</a>') + pick("", menu()) + f"</{t}>"

    def footer() -> str:
        t = pick("footer", "footer", "div")
        body = pick(f"&copy; {say(1, 3, False)} &middot; {say(3, 9)}", f"<p>&copy; 20{int(rng.integers(10, 30))} {say(2, 6)}</p>", links(4, True), f"<p>{say(4, 25)}</p>" + links(3, True))
        return (f"<{t}>" if t == "footer" else named("div", "footer", "site-footer", "copyright", "legal")) + body + f"</{t}>"

    def side() -> str:
        t = pick("aside", "div", "section")
        return (f"<{t}>" if t == "aside" else named(t, "sidebar", "related", "widget", "recommended", "more", "popular", "trending")) + pick("", f"<h3>{say(1, 3, False)}</h3>", f"<h2>{say(1, 4, False)}</h2>") + pick(links(4), f"<p>{say(5, 40)}</p>", f"<p>{say(5, 25)}</p>" + links(3)) + f"</{t}>"

    def ad() -> str:
        t = pick("div", "div", "section", "p", "aside")
        return f'<{t} {pick("class", "class", "id")}="{pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot")}">' + pick(say(3, 12), f"<p>{say(4, 30)}</p>", f'<a href="#">{say(2, 6)}</a>') + f"</{t}>"

    def notice() -> str:
        return f'<div {pick("class", "id")}="{pick("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "newsletter", "popup", "modal", "subscribe")}">' + pick(f"<p>{say(5, 30)}</p>", say(5, 25)) + pick("", f"<button>{say(1, 2, False)}</button>") + "</div>"

    def form() -> str:
        return "<form>" + pick("", f"<p>{say(2, 15)}</p>", f"<legend>{say(1, 3, False)}</legend>") + f"<label>{say(1, 3, False)}</label><input type=text>" + f"<button>{say(1, 2, False)}</button></form>"

    def comments() -> str:
        t = pick("div", "section", "ol")
        inner = pick("div", "article", "li", "p")
        one = lambda: f'<{inner} class="{pick("comment", "comment", "reply", "user-comment")}">' + pick("", f"<b>{say(1, 2, False)}</b>", f"<h4>{say(1, 2, False)}</h4>") + pick(f"<p>{say(4, 60)}</p>", say(4, 40)) + f"</{inner}>"
        return f'<{t} {pick("class", "id")}="{pick("comments", "comments", "comment-list", "responses", "discussion")}">' + pick("", f"<h3>{say(1, 3, False)}</h3>") + "".join(one() for _ in range(int(rng.integers(1, 6)))) + f"</{t}>"

    def article() -> str:
        t = pick("article", "article", "article", "main", "div", "section", "body")
        title = say(2, 14, rng.random() < 0.5, True)
        out = [f"<h1>{title}</h1>" if rng.random() < 0.85 else ""]
        if rng.random() < 0.35:
            out.append(f"<p><b>{title}{pick('', ' ' + say(3, 20))}<br>")
        for _ in range(int(rng.integers(0, 14))):
            u = rng.random()
            if u < 0.8:
                close = "</p>" if rng.random() < 0.85 else ""
                out.append(f"<p>{say(1, 10 if rng.random() < 0.2 else 90, True, True)}{close}")
            elif u < 0.86:
                out.append(f"<h2>{say(1, 8, False, True)}</h2>")
            elif u < 0.9:
                out.append("<ul>" + "".join(f"<li>{say(2, 15, True, True)}</li>" for _ in range(3)) + "</ul>")
            elif u < 0.93:
                out.append(f"<blockquote>{say(5, 40, True, True)}</blockquote>")
            elif u < 0.95:
                out.append(f"<p><b>{say(1, 20, True, True)}<br>")
            elif u < 0.975:
                out.append(ad())
            else:
                out.append(f"<p>{say(3, 30, True, True)} <a href='/x'>{say(1, 3, False)}</a> {say(2, 30)}</p>")
        if t == "body":
            return "".join(out)
        head = f"<{t}>" if t in ("article", "main") else named(t, "content", "post", "entry", "story", "article", "article-body", "main", "text", "post-body")
        return head + "".join(out) + f"</{t}>"

    some = lambda f, p: f() if rng.random() < p else ""
    page = f'<!DOCTYPE html><html lang="x"><head><title>{say(2, 9, False)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
    page += some(notice, 0.15) + some(header, 0.3) + some(menu, 0.75) + some(form, 0.1) + "<!-- x -->" + some(ad, 0.5) + some(side, 0.15)
    page += article() + some(ad, 0.15) + some(side, 0.25) + some(comments, 0.3) + some(form, 0.15) + some(notice, 0.1) + some(footer, 0.8)
    return page + ("</body></html>" if rng.random() < 0.85 else "")


def training_pages(n: int = 1500, seed: int = 11) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks of made-up pages and which of them are main text."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        own = blocks(_made_up(rng))
        y = np.array([_MAIN in b.text for b in own], np.float32)
        for b in own:
            b.text = b.text.replace(_MAIN, "") or "."
        out.append((own, y))
    return out


@functools.cache
def weights() -> dict[str, np.ndarray]:
    """The trained labeller (once per process; about a dozen seconds)."""
    reader = Reader()
    return train([(reader.page(own), y) for own, y in training_pages()])


def _extractor(w: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rillstore.llm.words import slices

        reader = Reader()
        for b in slices(batches, "html"):
            own = [blocks(p) if p else [] for p in b.column("html").to_pylist()]
            chances = label([reader.page(x) for x in own], w)
            texts = ["\n".join(k.text for k, p in zip(x, c, strict=True) if p >= 0.5) for x, c in zip(own, chances, strict=True)]
            cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, w: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page (columns ``page_id, url, html``)."""
    ship_package(pages.sparkSession)
    d = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return d.mapInArrow(W.tidy(_extractor(w or weights())), RESULT)
