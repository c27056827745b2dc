"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text without a block-level boundary in between.
Each block has features of its ancestors (tag names, class, id and role names as wholes, and the first and
last part of compound ones), its text (length, share of link text, ending, cue words) and its place (under a heading
with a cue, before or after the first h1). The field labels blocks as article or not; it
is trained with exact gradients (forward-backward) on labelled pages, and decodes by
Viterbi. The labelled pages are made by ``labelled_pages``: article and boilerplate
blocks in many templates, with and without class names, and random words so that no vocabulary but the cues is learnt.

Scripts, styles and other raw text end at their end tag, whatever stands in them.

Defined results: null and empty html give an empty text; a page without a tag is one block of text; cut
off markup is dropped and what stands before it counts; an open head ends at the first text or element
that may not stand in it, another silent element without an end tag at the next block element; a raw element without an end
tag takes the rest if it is a script or style and nothing otherwise; html of any length is read whole; repeated rows are extracted
each; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicer.llm.session import bound_batches

#: Quotes matter only after an equals sign, as in browsers; a value that no quote ends is not a value.
TOKEN = re.compile(r"<!--+>|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*)(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template textarea select iframe svg title head button".split())
RAW = set("script style textarea title noscript iframe".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math annotation menclose merror mfenced mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements that an opening tag ends if they are the innermost block.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
IN_HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())
BLOCKS = ENDS_P | set("body dd dt li p td th tr".split())


@cache
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I)


def tokens(html: str) -> Iterator[tuple[re.Match, bool]]:
    """The markup and text of a page, without what stands in raw elements; whether a tag opens a raw element that ends."""
    at = 0
    while at < len(html):
        m = TOKEN.match(html, at)
        at, name = m.end(), (m.group(2) or "").lower()
        raw = name in RAW and not m.group(1) and (name in ("script", "style") or not m.group().endswith("/>"))
        if raw:
            end = _end_tag(name).search(html, at)
            raw = end is not None or name in ("script", "style")
            at = end.end() if end else len(html) if raw else at
            if end:  # the rest of the end tag
                close = html.find(">", at)
                at = close + 1 if close >= 0 else len(html)
        yield m, raw


def _unclosed(html: str) -> set[int]:
    """Where the silent elements start that no end tag closes."""
    opened: dict[str, list[int]] = {}
    for m, _ in tokens(html):
        name = (m.group(2) or "").lower()
        if not m.group(1):
            if name in SILENT and name not in RAW and not m.group().endswith("/>"):
                opened.setdefault(name, []).append(m.start())
        elif opened.get(name):
            opened[name].pop()
    return {at for starts in opened.values() for at in starts}


def names_of(attributes: str) -> str:
    """Class, id and role names: whole words as they are, of compound ones the first and the last part with a hyphen."""
    out = []
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        for name in (a or b or c).split():
            parts = [x.lower() for x in NAME.findall(name)]
            out += parts if len(parts) == 1 else [f"{parts[0]}-", f"-{parts[-1]}"] if parts else []
    return " ".join(out)


class Block:
    __slots__ = ("text", "path", "link")

    def __init__(self, text: str, path: tuple, link: int):
        self.text, self.path, self.link = text, path, link


def leaf_blocks(html: str) -> list[Block]:
    """The page's runs of text, white space made one space, character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # (tag, words of class, id and role)
    unclosed: set[int] | None = None
    loose: list[int] = []  # depths of the silent elements without an end tag
    parts: list[str] = []
    link = silent = 0

    def flush() -> None:
        nonlocal link
        text = SPACE.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(Block(text, tuple(stack), min(link, len(text))))
        link = 0

    def end(k: int) -> None:
        nonlocal silent
        silent -= sum(t in SILENT for t, _ in stack[k:])
        del stack[k:]

    for m, raw in tokens(html):
        token, name = m.group(), m.group(2)
        if name is None:
            if stack and stack[-1][0] == "head" and (token[0] != "<" or token == "<") and token.strip():
                end(len(stack) - 1)
            if token[0] != "<" or token == "<":
                if not silent:
                    parts.append(token)
                    if any(t == "a" for t, _ in stack[-4:]):
                        link += len(token.strip())
            continue
        name, closing = name.lower(), bool(m.group(1))
        if silent and not closing:
            while loose and (loose[-1] >= len(stack) or stack[loose[-1]][0] not in SILENT):
                loose.pop()
            if loose and name in BLOCKS:
                end(loose.pop())
            if stack and stack[-1][0] == "head" and name not in IN_HEAD:
                end(len(stack) - 1)
        if name not in INLINE:
            if name == "br":
                parts.append(" ")
                continue
            if not silent:
                flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    end(k)
                    break
            continue
        if raw or name in RAW or name in VOID:
            continue
        closes = CLOSES.get(name, {"p"} if name in ENDS_P else ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in closes:
                del stack[k:]
                break
            if stack[k][0] not in INLINE:
                break
        words = names_of(m.group(3)) if m.group(3) else ""
        if not token.endswith("/>"):
            if name in SILENT:
                silent += 1
                if name != "head":
                    unclosed = _unclosed(html) if unclosed is None else unclosed
                    if m.start() in unclosed:
                        loose.append(len(stack))
            stack.append((name, words))
    flush()
    return out


#: Names that page templates give to what is not the article, to what is, and to mere containers.
OTHER_NAMES = "ad ads advert advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related recommended trending share sharing social footer header masthead topbar cookie cookies consent notice alert popup modal newsletter subscribe signup login search form comment comments reply replies respond discussion disqus tags meta byline pagination copyright legal toolbar skip".split()
ARTICLE_NAMES = "article content post entry story body text main page-content post-body article-body entry-content".split()
NEUTRAL_NAMES = "container row col wrapper wrap page inner outer grid site app root layout section block box column".split()
OTHER, ARTICLE = frozenset(OTHER_NAMES), frozenset(ARTICLE_NAMES)


@lru_cache(1 << 14)
def path_features(path: tuple) -> tuple[str, ...]:
    found = {"bias"}
    for tag, words in path:
        found.add(f"<{tag}")
        for w in words.split():
            found.add(f".{w}")
            kind = "other" if w.strip("-") in OTHER else "article" if w.strip("-") in ARTICLE else None
            if kind:
                found.add(f"{kind} named, {'first part' if w[-1] == '-' else 'last part' if w[0] == '-' else 'whole'}")
    blocks = [t for t, _ in path if t not in INLINE]
    if blocks:
        found.add(f"in {blocks[-1]}")
    return tuple(sorted(found))


#: Words that short texts and headings around an article use, in a few languages.
CUES = frozenset("© copyright rights reserved comment comments kommentar kommentare commentaire commentaires comentario comentarios reply replies antworten répondre responder share teilen partager compartir subscribe newsletter abonnieren abonner suscribirse cookie cookies advertisement sponsored anzeige publicité publicidad related recommended trending verwandte login register anmelden menu menü menú navigation privacy datenschutz impressum terms imprint".split())
WORD = re.compile(r"©|[^\W\d_]+")
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


def features(blocks: list[Block]) -> list[tuple[str, ...]]:
    """The features of every block of a page."""
    out, cued = [], {}  # container of a heading: whether the last one there had a cue
    seen = "no h1" if not any(t == "h1" for b in blocks for t, _ in b.path) else "before h1"
    for b in blocks:
        n, share = len(b.text), b.link / max(1, len(b.text))
        cue = n < 300 and not CUES.isdisjoint(w.lower() for w in WORD.findall(b.text))
        own = [*path_features(b.path), f"size {min(5, n.bit_length() // 2)}", f"links {int(share * 2.99)}", "ends" if b.text[-1] in ".!?…:\"”»" else "open"]
        depth = next((k for k, (t, _) in enumerate(b.path) if t in HEADING), None)
        if depth is not None:
            if any(t == "h1" for t, _ in b.path):
                seen = "after h1"
            cued[b.path[:depth]] = cue and n < 80
        own += [seen, *(["cue"] if cue else []), *(["under cue"] if depth is None and any(cued.get(b.path[:k]) for k in range(len(b.path) + 1)) else [])]
        out.append(tuple(own))
    return out


# --- the field --------------------------------------------------------------------


class Field:
    """Weights of features for the label 'article' (1) against other (0), and of pairs of neighbours."""

    def __init__(self, weights: dict[str, float], pairs: list[list[float]]):
        self.weights, self.pairs = weights, pairs

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not blocks:
            return []
        get, (t00, t01), (t10, t11) = self.weights.get, *self.pairs
        back, zero, one = [], 0.0, 0.0
        for k, own in enumerate(features(blocks)):
            s = sum(get(f, 0.0) for f in own)
            if k:
                from0, from1 = zero + t01 > one + t11, zero + t00 >= one + t10
                back.append((0 if from1 else 1, 0 if from0 else 1))
                zero, one = max(zero + t00, one + t10), max(zero + t01, one + t11) + s
            else:
                one = s
        out = [int(one > zero)]
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]


def fit(pages: list[tuple[str, list[int]]], *, rounds: int = 150, rate: float = 0.3, ridge: float = 0.002) -> Field:
    """Maximum likelihood by gradient steps over all pages; all chains advance together."""
    chains = [(leaf_blocks(h), y) for h, y in pages]
    found = [features(blocks) for blocks, _ in chains]
    names = sorted({f for page in found for own in page for f in own})
    index, longest = {f: i for i, f in enumerate(names)}, max(len(b) for b, _ in chains)
    n = len(chains)
    where = [(c, t, index[f]) for c, page in enumerate(found) for t, own in enumerate(page) for f in own]
    c, t, f = (np.array(x) for x in zip(*where, strict=True))
    y, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for k, (_, labels) in enumerate(chains):
        y[k, : len(labels)], real[k, : len(labels)] = labels, True
    w, pairs = np.zeros(len(names)), np.zeros((2, 2))
    m, v = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    for step in range(1, rounds + 1):
        one = np.zeros((n, longest))
        np.add.at(one, (c, t), w[f])
        score = np.stack([np.zeros_like(one), one], 2)
        alpha, beta = score.copy(), np.zeros_like(score)
        for k in range(1, longest):
            alpha[:, k] = np.where(real[:, k, None], score[:, k] + np.logaddexp(alpha[:, k - 1, 0, None] + pairs[0], alpha[:, k - 1, 1, None] + pairs[1]), alpha[:, k - 1])
            j = longest - 1 - k
            ahead = score[:, j + 1] + beta[:, j + 1]
            beta[:, j] = np.where(real[:, j + 1, None], np.logaddexp(pairs[:, 0] + ahead[:, 0, None], pairs[:, 1] + ahead[:, 1, None]), 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha[..., 1] + beta[..., 1] - total[:, None]) * real
        g = np.bincount(f, (y - p)[c, t], minlength=len(names)) / n - ridge * w
        gp = np.zeros((2, 2))
        both = real[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                expect = np.exp(alpha[:, :-1, a] + pairs[a, b] + score[:, 1:, b] + beta[:, 1:, b] - total[:, None]) * both
                gp[a, b] = ((((y[:, :-1] == a) & (y[:, 1:] == b)) & both).sum() - expect.sum()) / n
        grad = np.concatenate([g, (gp - ridge * pairs).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, pairs = w + move[:-4], pairs + move[-4:].reshape(2, 2)
    return Field({k: float(x) for k, x in zip(names, w, strict=True) if abs(x) > 1e-3}, pairs.tolist())


def labelled_pages(count: int = 420, seed: int = 7, plain: float = 0.4) -> list[tuple[str, list[int]]]:
    """Pages in random templates, with the label (1: article) of every leaf block in order; a share ``plain`` names no part by its class."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9)))
    sentence = lambda: (" ".join(word() for _ in range(r.randrange(1, 22))).capitalize() + r.choice(["."] * 8 + ["!", "?", "", ","]))
    several = lambda n: " ".join(sentence() for _ in range(r.randrange(1, n)))
    neutral = lambda: r.choice(["", "", f' class="{r.choice(NEUTRAL_NAMES)}"', f' id="{word()}"', f' class="{r.choice(NEUTRAL_NAMES)}-{word()}"'])
    cued = lambda: " ".join(r.sample([word(), word(), r.choice(sorted(CUES)).capitalize(), str(r.randrange(9))], r.randrange(2, 4)) + [r.choice(sorted(CUES))])
    out = []
    for _ in range(count):
        html, labels, bare = [], [], r.random() < plain

        def put(tag: str, text: str, label: int, attr: str = "") -> None:
            html.append(f"<{tag}{attr}>{text}</{tag}>")  # noqa: B023
            labels.append(label)  # noqa: B023

        def link_list(attr: str) -> None:
            html.append(f"<ul{attr}>")  # noqa: B023
            for _ in range(r.randrange(2, 8)):
                put("li", f'<a href="/{word()}">{" ".join(word() for _ in range(r.randrange(1, 4)))}</a>', 0)
            html.append("</ul>")  # noqa: B023

        def other(deep: bool = True) -> None:
            name = r.choice(OTHER_NAMES)
            attr = r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {word()}"', f' class="{word()}-{name}"', f' class="{word()}-{name}"', f' class="{name}-{word()}"'])
            kind = r.randrange(8)
            if bare:  # noqa: B023
                attr = neutral()
                kind = r.choice([0, 3, 4, 8, 9, 10])
            if kind == 0:
                html.append(f"<nav{r.choice(['', attr])}>")  # noqa: B023
                link_list("")
                html.append("</nav>")  # noqa: B023
            elif kind in (1, 2):
                put("div", several(4), 0, attr)
            elif kind == 3:
                tag = r.choice(["aside", "footer", "header"])
                html.append(f"<{tag}{r.choice(['', attr])}>")  # noqa: B023
                for _ in range(r.randrange(1, 4)):
                    put(r.choice(["p", "div", "h3"]), sentence(), 0)
                html.append(f"</{tag}>")  # noqa: B023
            elif kind == 4:
                html.append(f"<form{r.choice(['', attr])}>")  # noqa: B023
                put("label", sentence(), 0)
                html.append('<input type="text"><button>Go</button></form>')  # noqa: B023
            elif kind == 5 and deep:
                html.append(f"<section{attr}>")  # noqa: B023
                for _ in range(r.randrange(1, 4)):
                    put(r.choice(["p", "div", "h3", "li", "span"]), several(5), 0)
                    html.append("<hr>")  # noqa: B023
                html.append("</section>")  # noqa: B023
            elif kind == 8:
                html.append(f"<div{attr}>")  # noqa: B023
                link_list(neutral())
                html.append("</div>")  # noqa: B023
            elif kind == 9:
                put(r.choice(["div", "p"]), cued() + r.choice(["", ".", f" {sentence()}"]), 0, attr)
            elif kind == 10 and deep:  # a heading with a cue and what stands under it
                html.append(f"<div{attr}>")  # noqa: B023
                put(r.choice(["h2", "h3", "h4"]), cued(), 0)
                for _ in range(r.randrange(1, 5)):
                    put(r.choice(["p", "div", "li"]), several(4), 0)
                html.append("</div>")  # noqa: B023
            else:
                if bare:  # noqa: B023
                    return
                html.append(f"<div{attr}>")  # noqa: B023
                for _ in range(r.randrange(1, 4)):
                    put("p", several(5), 0)
                html.append("</div>")  # noqa: B023

        outer = [f"div{neutral()}" for _ in range(r.choice([0, 0, 1, 2]))]
        html += [f"<{x}>" for x in outer]
        for _ in range(r.randrange(0, 4)):
            other()
        name = r.choice(ARTICLE_NAMES)
        tag = "div" if bare else r.choice(["article"] * 4 + ["main", "div", "section", "div"])
        odd = [f' class="{r.choice(OTHER_NAMES)}-{word()}"']  # a compound says what it is about, not what it is
        attr = neutral() if bare else r.choice(["", "", f' class="{name}"', f' id="{name}"', *odd]) if tag in ("article", "main") else r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {word()}"'])
        wraps = [f"div{neutral()}" for _ in range(r.choice([0, 0, 1, 2]))] if bare or r.random() < 0.3 else []
        if not (bare and r.random() < 0.2):  # straight in the body
            wraps.append(f"{tag}{attr}")
        html += [f"<{x}>" for x in wraps]
        if r.random() < 0.8:
            put(r.choice(["h1", "h1", "h2"]), sentence(), 1)
        for _ in range(r.randrange(1, 14)):
            x = r.random()
            if x < 0.72:
                put("p", r.choice(["", "", "", f'<a href="#">{word()}</a> ', f"<b>{word()}</b> "]) + several(6), 1)
            elif x < 0.78:
                put(r.choice(["h2", "h3", "h4"]), sentence(), 1)
            elif x < 0.84:
                html.append("<ul>")
                for _ in range(r.randrange(1, 4)):
                    put("li", sentence(), 1)
                html.append("</ul>")
            elif x < 0.88:
                put(r.choice(["blockquote", "pre", "td", "figcaption", "div", "dd"]), sentence(), 1)
            elif x < 0.94:
                if not bare:
                    other(False)
            else:
                put("p", sentence() + r.choice(["", "", f" {r.choice(sorted(CUES))} {sentence()}"]), 1)
        if r.random() < 0.3 and not bare:
            other()
        html += [f"</{x.split()[0]}>" for x in reversed(wraps)]
        for _ in range(r.randrange(0, 4)):
            other()
        if r.random() < 0.7:
            put("footer", f"&copy; {word()} &middot; {sentence()}", 0)
        html += ["</div>" for _ in outer]
        out.append(("".join(html), labels))
    return [(h, y) for h, y in out if len(leaf_blocks(h)) == len(y)]


@cache
def trained(seed: int = 7) -> Field:
    return fit(labelled_pages(seed=seed))


def main_text(html: str | None, field: Field) -> str:
    blocks = leaf_blocks(html or "")
    return " ".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y)


def _extract(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, field) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    bound_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract(field or trained()), "page_id bigint, url string, text string, n_chars bigint")
