"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides each block by where it stands, its
link density, its length and its share of stop words, or leaves it open if it is short. The second pass
gives open blocks the label of the nearest decided block.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm.tables import slices

# Frequent words of the four languages that pages come in.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his are this or had at from but which have an they "
    "der die das und in zu den ist von nicht mit sich des auf für im dem ein eine als auch es an werden aus er hat dass "
    "le la les de des et en un une du que est pour qui dans par plus pas au sur ne se ce il sont avec ou "
    "el los las y que en un una por con no su para es al lo como más pero sus se del o este sí ya".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
CONTAINERS = BLOCK_TAGS - set("p hr br li dd dt option h1 h2 h3 h4 h5 h6 html body".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("head nav footer aside form menu dialog select button iframe object canvas svg audio video title".split())
RAW = "script|style|noscript|template|textarea|xmp|noframes|iframe"
# Words of class and id names that mark what is not the article.
HINTS = frozenset(
    "ad adbox ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup "
    "promo promoted promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget".split()
)
# Names with one of these are off topic whatever they hold; other names, headers and forms may wrap an article.
SURELY = frozenset("ad adbox ads advert adverts advertisement advertising adsense comment comments disqus replies reply".split())
STATES = frozenset("has no not with without hide hides show shows is".split())  # has-sidebar tells of another element
# What may follow the word that counts, as in ad-box.
GENERIC = frozenset(
    "area bar block body box button buttons column container content dialog icons inner item items links list outer panel posts section slot unit "
    "wrap wrapper".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
NOT_LETTER = re.compile(r"[\W\d_]+")

SHORT, LONG = 70, 200  # characters
LOW_STOP, HIGH_STOP = 0.10, 0.25  # share of stop words
MOST_LINKS, ALL_LINKS = 0.5, 0.9  # share of characters inside links: outside and inside an article


@dataclass
class Block:
    text: str
    linked: int  # characters of the text inside links
    inside: bool  # in an article or main element
    outside: bool  # in something that is not the article
    wrapped: bool  # in an article or main element that stands in something off topic by name only
    label: bool | None = None


def kinds(value: str) -> set[str]:
    """The listed words that the names in a class or id attribute stand for: the whole name, or its last part that says something."""
    out = set()
    for name in value.split():
        parts = PARTS.findall(CAMEL.sub(" ", name).lower())
        whole = len(parts) == 1
        while len(parts) > 1 and parts[-1] in GENERIC:
            parts.pop()
        # Page builders call any piece of a page some widget.
        if parts and parts[0] not in STATES and (whole or parts[-1] != "widget"):
            out.add(parts[-1])
    return out


def off_topic(tag: str, rest: str, inside: bool) -> int:
    """2 if an element holds something else than the article, 1 if so unless an article stands in it, else 0.

    A header inside an article may hold its title.
    """
    if tag in DROPPED or tag == "header" and not inside:
        return 1 if tag in ("form", "header") else 2
    if "=" not in rest and "hidden" not in rest.lower():
        return 0
    level = 0
    for name, *values in NAMED.findall(rest):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "role" and value.strip().lower() in ROLES:
            level = max(level, 1 if value.strip().lower() == "form" else 2)
        elif name in ("class", "id") and tag == "article":
            level = max(level, 2 * (not {"comment", "comments", "reply", "replies"}.isdisjoint(kinds(value))))
        elif name in ("class", "id") and tag not in ("html", "body", "main"):
            found = kinds(value)
            level = max(level, 2 * (not SURELY.isdisjoint(found)), 1 * (not HINTS.isdisjoint(found)))
    return level


def folded(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, with white space folded and character references decoded."""
    out: list[Block] = []
    parts: list[str] = []
    links: list[list[str]] = []  # what of the parts stands in each link
    stack: list[tuple[str, bool, int, bool]] = []  # tag, and inside, outside (as off_topic), wrapped before it
    in_link, inside, outside, wrapped = False, False, 0, False

    def end() -> None:
        nonlocal in_link
        if parts:
            text = folded(parts)
            if text:
                out.append(Block(text, sum(len(folded(x)) for x in links), inside, outside > 0, wrapped))
            parts.clear()
        links.clear()
        in_link = False

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            links[-1].append(text)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        closing = bool(m["close"])
        if tag == "br":
            add(" ")
        elif tag == "a":
            in_link = not closing and HREF.search(m["rest"]) is not None
            if in_link:
                links.append([])
        if tag in BLOCK_TAGS:
            end()
        if tag in VOID or tag not in CONTAINERS and tag not in DROPPED and (closing or not off_topic(tag, m["rest"], inside)):
            if closing and any(t == tag for t, *_ in stack):
                pass
            elif tag == "body" and not closing:  # whatever was left open in the head ends here
                stack.clear()
                inside, outside, wrapped = False, 0, False
                continue
            else:
                continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                end()
                _, inside, outside, wrapped = stack[depth]
                del stack[depth:]
        elif not m["rest"].endswith("/"):
            off = off_topic(tag, m["rest"], inside)
            if tag in ("article", "main") and not off:  # ends a menu or head that was never closed
                while stack and stack[-1][0] in ("nav", "head", "title", "header", "menu"):
                    _, inside, outside, wrapped = stack.pop()
            if off:
                end()
            stack.append((tag, inside, outside, wrapped))
            if tag in ("article", "main") and not off:
                inside = True
                if outside == 1:  # the name of a wrapper is a guess; an article tells more
                    outside, wrapped = 0, True
            outside = max(outside, off)
    if at < len(page):
        add(page[at:])
    end()
    return out


def size(text: str) -> int:
    """Characters, those that stand for half a word or so counted as three."""
    return len(text) + 2 * len(WIDE.findall(text))


def stop_share(text: str) -> float:
    words = [w for w in NOT_LETTER.split(text.lower()) if w]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(b: Block, known: bool = True) -> bool | None:
    """True for main text, False for anything else, None for a short block that cannot be told.

    Blocks of a page whose language is not known are told by length and links alone.
    """
    if b.outside:
        return False
    n, share = len(b.text), b.linked / len(b.text)
    if b.inside:  # an article may hold lists, tables or another language; only what is all links is not its text
        return True if share <= ALL_LINKS else False if n >= SHORT else None
    if share > MOST_LINKS:
        return False
    if not known:
        return True if size(b.text) >= LONG else None
    if n < SHORT:
        return None
    stop = stop_share(b.text)
    if n >= LONG:
        return stop >= LOW_STOP
    return True if stop >= HIGH_STOP else None if stop >= LOW_STOP else False


def main_blocks(page: str) -> list[str]:
    """Texts of the blocks that make up the article.

    An article in an element that only its name, a form or a header makes off topic counts if the page has no other.
    Where no block has the stop words of a known language, length and links decide alone.
    Open blocks take the label of the nearest decided block of the same region (article or not); at
    equal distance main text wins. In a region without a decided block they count as main text
    inside an article, and outside only if the page has no decided block at all.
    """
    found = blocks(page)
    if any(b.inside and not b.outside and not b.wrapped for b in found):  # teasers in a side bar are articles, too
        for b in found:
            b.outside = b.outside or b.wrapped
    if any(b.inside and not b.outside for b in found):  # with an article at hand, nothing outside it is main text
        for b in found:
            b.outside = b.outside or not b.inside
    found = [b for b in found if not b.outside]
    plain = [b for b in found if not b.inside and size(b.text) >= SHORT and b.linked <= MOST_LINKS * len(b.text)]
    known = any(stop_share(b.text) >= LOW_STOP for b in plain)
    for b in found:
        b.label = first_pass(b, known)
    if not known and not any(b.label for b in found):  # no long block: the longer ones among the short
        for b in plain:
            b.label = True
    undecided = all(b.label is None for b in found)
    n = len(found)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for seen, order, step in ((before, range(n), 1), (after, range(n - 1, -1, -1), -1)):
        near: tuple[int, bool] | None = None
        for i in order:
            seen[i] = near and (near[0] + 1, near[1])
            near = (0, found[i].label) if found[i].label is not None else seen[i]
    out = []
    for b, *sides in zip(found, before, after):
        if b.label is None:
            told = [s for s in sides if s]
            nearest = min((s[0] for s in told), default=0)
            keep = any(s[1] for s in told if s[0] == nearest) if told else b.inside or undecided
        else:
            keep = b.label
        if keep:
            out.append(b.text)
    return out


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url and ``text``, the article's blocks joined by blank lines.

    Null and empty pages, and pages without an article, give an empty text; repeated rows are done one
    by one; other columns are ignored. No shuffle.
    """
    kept = df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[html_col].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            texts = ["\n\n".join(main_blocks(h)) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"]
            )

    kinds = [kept.schema[c].dataType.simpleString() for c in ("id", "url")]
    out = kept.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
