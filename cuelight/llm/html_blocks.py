"""Main text of web pages: a linear-chain CRF over the leaf blocks of the DOM.

A page becomes its sequence of leaf blocks, each with the tags, classes and roles of its ancestors. The field reads features of the
ancestors and of the text and labels each block as article or not, by Viterbi. It is trained here on labelled pages: a bounded sample of
the pages whose markup names the article, as they are and with their parts dressed in other markup, so that the field does not hang on
one site's tags.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.crf import Crf, train
from cuelight.llm.tables import registered, table
from cuelight.llm.words import slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/a-zA-Z][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|data-label|style|hidden|href)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Elements whose content is no text, those of them that reach to the end of the page without an end tag, elements that end a
# block, elements without content.
RAW = frozenset("script style textarea title noscript template svg select iframe object canvas audio video head".split())
OPEN_ENDED = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                  "h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Parts of class, id and role names that tell what an element holds.
HINTS = {
    "menu": "nav menu breadcrumb crumb toolbar pagination pager tabs toc skip",
    "header": "header masthead banner topbar branding logo",
    "footer": "footer foot colophon copyright legal contentinfo",
    "side": "sidebar side aside widget related recommended complementary rail popular trending teaser",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promoted",
    "notice": "cookie cookies consent notice gdpr alert popup modal banner message newsletter subscribe signup paywall",
    "form": "form search login register contact input",
    "comment": "comment comments reply replies respond discuss discussion disqus reader responses",
    "share": "share sharing social follow tags meta byline author",
    "good": "article content post entry story main body text page",
}
HINT_OF: dict[str, list[int]] = {}
for _i, _names in enumerate(HINTS.values()):
    for _name in _names.split():
        HINT_OF.setdefault(_name, []).append(_i)
ANCESTORS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "figure", "dialog", "details", "blockquote")
OWN = ("p", "h1", "h2", "h3", "h4", "li", "td", "div", "label", "pre", "dd", "body")
WIDTH = len(ANCESTORS) + len(OWN) + len(HINTS) + 14


@lru_cache(maxsize=8192)
def _hints(attributes: str) -> tuple[frozenset[int], str | None, bool]:
    """Hints of an element's names; its label in a training page; whether it is hidden."""
    hints, label, hidden = set(), None, False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "aria-label"):
            for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()):
                hints.update(HINT_OF.get(word, ()))
        elif name == "data-label":
            label = value
        elif name == "hidden" and not value or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return frozenset(hints), label, hidden


class Block:
    __slots__ = ("text", "linked", "stack")

    def __init__(self, text, linked, stack):
        self.text, self.linked, self.stack = text, linked, stack


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: text without markup, characters of it inside links, open elements (tag, hints, label, hidden)."""
    out: list[Block] = []
    stack: list[tuple] = []
    text: list[str] = []
    linked = [0]
    links = 0

    def flush():
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, min(linked[0], len(joined)), tuple(stack)))
            text.clear()
            linked[0] = 0

    at = 0
    while True:
        found = TOKEN.search(page, at)
        piece = page[at : found.start()] if found else page[at:]
        if piece:
            text.append(piece)
            if links:
                linked[0] += len(piece)
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in ("button", "label"):
                flush()
            elif tag in BLOCK:
                flush()
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if depth is not None:
                    del stack[depth:]
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if not found[3].endswith("/"):
                at = end.end() if end else len(page) if tag in OPEN_ENDED else at
            continue
        if tag == "a":
            links += 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK:
            flush()
            links = 0
            if stack and stack[-1][0] == "p" or tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
                stack.pop()
            if tag not in VOID:
                stack.append((tag, *_hints(found[3])))
        elif tag in ("input", "img"):
            text.append(" ")
        elif tag in ("button", "label"):
            flush()
    flush()
    return out


def features(page: list[Block]) -> np.ndarray:
    """Features of each block: ancestors' tags and hints, its own tag, its text, its place."""
    x = np.zeros((len(page), WIDTH))
    for i, b in enumerate(page):
        row = x[i]
        tags = {s[0] for s in b.stack}
        for j, tag in enumerate(ANCESTORS):
            row[j] = tag in tags
        own = b.stack[-1][0] if b.stack else "body"
        if own in OWN:
            row[len(ANCESTORS) + OWN.index(own)] = 1
        at = len(ANCESTORS) + len(OWN)
        for s in b.stack:
            for hint in s[1]:
                row[at + hint] = 1
        at += len(HINTS)
        text = b.text
        words = text.split(" ")
        n = len(words)
        marks = sum(map(text.count, ".,;:?!"))
        row[at:] = (
            np.log1p(n), b.linked / len(text), text[-1] in ".?!:;\"'”»…", min(1.0, marks / n), sum(map(str.isdigit, text)) / len(text),
            "©" in text or "|" in text or "·" in text, n < 6, n >= 15, n >= 40, i / len(page), i == 0, i == len(page) - 1,
            any(s[3] for s in b.stack), text.isupper())
    return x


ARTICLE = re.compile(r"(<(article|main)\b[^>]*>)(.*?)(</\2>|<footer|\Z)", re.S | re.I)


def _dress(text: str, tag: str) -> str:
    """A text of an article in other markup; headings and list items are shorter."""
    words = text.split(" ")
    if tag == "h2":
        return f"<h2>{html.escape(' '.join(words[:5]))}</h2><p>{html.escape(' '.join(words[5:]))}</p>"
    if tag == "li":
        step = max(3, len(words) // 3)
        return "<ul>" + "".join(f"<li>{html.escape(' '.join(words[i : i + step]))}</li>" for i in range(0, len(words), step)) + "</ul>"
    if tag == "td":
        half = max(1, len(words) // 2)
        return f"<table><tr><td>{html.escape(' '.join(words[:half]))}</td><td>{html.escape(' '.join(words[half:]))}</td></tr></table>"
    return f"<{tag}>{html.escape(text)}</{tag}>"


def labelled(page: str, number: int) -> list[str]:
    """Training pages of one page whose markup names the article: parts carry ``data-label`` 1 (article) or 0."""
    found = ARTICLE.search(page)
    own = blocks(found[3]) if found else []
    if not own:
        return []
    before, body, after = page[: found.start()], found[3], page[found.end(3) :]
    before = re.sub(r"^.*?<body[^>]*>", "", before, flags=re.S | re.I)
    paragraphs = [b.text for b in own if len(b.text) > 40] or ["."]
    say = lambda k: html.escape(paragraphs[(number + k) % len(paragraphs)][: 60 + 90 * (k % 4)])
    rng = np.random.default_rng(number)
    pick = lambda *ways: ways[int(rng.integers(len(ways)))]
    out = [f'<body><div data-label="0">{before}</div>{found[1]}<div data-label="1">{body}</div></{found[2]}><div data-label="0">{after}</div>']
    for _ in range(3):
        side, talk, head = pick("aside", "div"), pick("section", "div"), pick("header", "div")
        extra = {
            "side": f'<{side} class="{pick("sidebar", "related", "widget", "c3")}"><h3>{say(1)[:20]}</h3><ul><li><a href="/a">{say(2)[:30]}</a></li>'
                    f'<li><a href="/b">{say(3)[:30]}</a></li></ul><p>{say(4)}</p></{side}>',
            "notice": f'<div class="{pick("cookie-notice", "consent", "alert notice", "newsletter")}"><p>{say(5)}</p><button>OK</button></div>',
            "advert": f'<div class="{pick("ad", "advert", "sponsored", "promo")}">{say(6)}</div>',
            "form": f"<form action='/s'><label>{say(7)[:15]}</label><input name=q><p>{say(8)}</p><button>{say(9)[:8]}</button></form>",
            "comment": f'<{talk} {pick("class", "id")}="{pick("comments", "comment-list", "replies", "discussion")}"><h3>{say(10)[:20]}</h3>'
                       f'<div class="comment"><p>{say(11)}</p></div><ul><li><p>{say(12)}</p></li></ul></{talk}>',
            "header": f'<{head} class="{pick("masthead", "site-header", "top")}"><p>{say(13)[:40]}</p><h1>{say(14)[:20]}</h1></{head}>',
        }
        on = [v for v in extra.values() if rng.random() < 0.6]
        cut = int(rng.integers(len(on) + 1))
        opened, closed = pick(("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
                              ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body">', "</div>"),
                              ('<section class="entry">', "</section>"), ("<div>", "</div>"), ('<div class="c1"><div class="c2">', "</div></div>"))
        inside = pick("", extra["advert"], extra["comment"], extra["side"], extra["notice"])
        parts = [f'<h1>{html.escape(own[0].text)}</h1>' if own[0].stack and own[0].stack[-1][0] in ("h1", "h2") else _dress(own[0].text, "p")]
        plain = pick("p", "p", "p", "div", "td")
        for b in own[1:]:
            parts.append(_dress(b.text, pick(plain, plain, plain, plain, "li", "td", "blockquote", "h2", "pre", "dd")))
        for k in sorted(rng.integers(1, len(parts) + 1, int(rng.integers(3))), reverse=True):
            parts.insert(int(k), f'<div data-label="0">{pick(extra["advert"], extra["form"], extra["notice"], extra["side"])}</div>')
        body = "".join(parts)
        top = before if rng.random() < 0.5 else re.sub(r"<(/?)(?:nav|header|aside)\b", r"<\1div", before)
        end = after if rng.random() < 0.5 else re.sub(r"<(/?)footer\b", rf'<\1div class="{pick("footer", "legal", "c9")}"', after)
        out.append(f'<body><div data-label="0">{top}{"".join(on[:cut])}</div>{opened}<div data-label="1">{body}</div><div data-label="0">{inside}</div>{closed}'
                   f'<div data-label="0">{"".join(on[cut:])}{end}</div>')
    return out


def fit(pages: DataFrame, max_pages: int = 400, max_blocks: int = 60, rounds: int = 200) -> Crf:
    """Train on at most ``max_pages`` pages that have an article element and at most ``max_blocks`` blocks, those of the least hashes of
    their ids."""
    named = pages.where(F.rlike("html", F.lit(r"(?i)<(article|main)\b"))).where("page_id is not null")
    sample = named.select("page_id", F.xxhash64("page_id").alias("h"), "html").orderBy("h", "page_id", "html").limit(max_pages)

    def rows(batches):
        for batch in slices(batches, "html"):
            xs, ys = [], []
            for number, page in zip(batch.column("h").to_pylist(), batch.column("html").to_pylist()):
                for variant in labelled(page, abs(number)):
                    known = [(b, y) for b in blocks(variant) if (y := next((s[2] for s in reversed(b.stack) if s[2]), None))]
                    if 0 < len(known) <= max_blocks:
                        xs.append(features([b for b, _ in known]).ravel())
                        ys.append([int(y) for _, y in known])
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.list_(pa.int32()))], ["x", "y"])

    got = sample.mapInArrow(rows, "x array<double>, y array<int>").toArrow()
    pairs = sorted(zip(got["x"].to_pylist(), got["y"].to_pylist()))
    if not pairs:
        return train([np.zeros((0, WIDTH))], [np.zeros(0)])
    return train([np.array(x).reshape(-1, WIDTH) for x, _ in pairs], [np.array(y) for _, y in pairs], rounds=rounds, ridge=1e-4)


def main_texts(model: Crf):
    """A function of the html column giving the main text."""

    @F.arrow_udf("string")
    def extract(page: pa.Array) -> pa.Array:
        out = []
        for batch in slices([pa.RecordBatch.from_arrays([page], ["html"])], "html"):
            parsed = [blocks(p) for p in batch.column(0).to_pylist()]
            lengths = np.array([len(p) for p in parsed])
            chosen = model.viterbi(np.concatenate([features(p) for p in parsed]), lengths)
            ends = np.cumsum(lengths)
            for p, end in zip(parsed, ends):
                out.append("\n\n".join(b.text for b, y in zip(p, chosen[end - len(p) : end]) if y))
        return pa.array(out, pa.string())

    return extract.asNondeterministic()


def extract_pages(pages: DataFrame, **bounds) -> DataFrame:
    """``(page_id, url, text)`` of every row of ``pages(page_id, url, html)``.

    A null, empty or markup-free page without a word has the empty text; a page without any markup is one block. Repeated rows give
    equal texts. Other columns are ignored. Without any page that names its article every block counts as article.
    """
    texts = main_texts(fit(pages, **bounds))
    return pages.select("page_id", "url", texts(F.col("html")).alias("text"))


@registered("op10_html_extraction")
def op10(spark, sf_dir):
    pages = extract_pages(table(spark, sf_dir, "pages"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))
