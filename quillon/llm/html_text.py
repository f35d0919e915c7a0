"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: each block is good, bad, or short by its stop-word density, length
and link density; its place in the page sets how much of these is asked, and only furniture by tag or by a whole name, and blocks beside an
article that has running text, are out by place. Second pass: short blocks, which are ambiguous on their own,
take the label of the nearest decided neighbours. Pages are parsed where they are read; nothing is shuffled.

Stop words are of a few languages, and names of furniture may stand on an article's wrapper. So a page on which no block is running text is looked at once more: there names
that an article may bear count for nothing, and sentences of some length count as running text in any language.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices
from quillon.llm.quality import FUNCTION_WORDS

#: Elements of HTML by what they mean for the layout.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody template textarea tfoot thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript iframe noembed noframes textarea title xmp template svg math object canvas audio video".split())
SKIPPED_TAGS = RAW_TAGS | frozenset("head select button datalist".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Words of class and id attributes, or of roles, that name page furniture.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard sponsor sponsored promo promotion "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc sidebar sidebars aside rail widget widgets "
    "footer foot copyright masthead topbar toolbar comment comments commentlist respond reply replies disqus discussion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations popular trending tags search searchbox skip hidden complementary contentinfo".split()
)
#: Of these the names that an article's own wrapper may bear too, on a page about them.
SOFT_NAMES = frozenset("share sharing social related recommended recommendations popular trending tags search searchbox skip widget widgets".split())
MAIN_TAGS = frozenset(("article", "main"))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[^\W\d_]+")
_STOP = frozenset(FUNCTION_WORDS)
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_SENTENCE = re.compile(r"[.!?…؟।](?:\s|$)|[。！？]")

SHORT = 80
LONG = 200
STOP_LOW = 0.08
STOP_HIGH = 0.15
LINKS = 0.4


@dataclass
class Block:
    text: str
    link_chars: int
    furniture: bool
    main: bool
    heading: bool
    partly: bool = False  # furniture by a part of a compound name only
    softly: bool = False  # furniture by a name that an article may bear too
    sentences: bool = False  # length and ends of sentences speak for it, in place of stop words


#: What marks an element as furniture: nothing, a mere part of a compound name, a name that an article may bear too, or its tag, state or any other whole name.
NONE, PART, SOFT, WHOLE = 0, 1, 2, 3


def _furniture(tag: str, rest: str, in_main: bool) -> int:
    if tag in FURNITURE_TAGS or tag in SKIPPED_TAGS or (tag == "header" and not in_main):
        return WHOLE
    if not rest.strip() or tag in ("html", "body", *MAIN_TAGS):
        return NONE
    return _named(rest)


def _named(rest: str) -> int:
    """The strongest mark by attributes."""
    mark = NONE
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return WHOLE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return WHOLE
        if name in ("class", "id", "role"):
            whole = [part for part in value.split() if part in FURNITURE_NAMES]
            if any(part not in SOFT_NAMES for part in whole):
                return WHOLE
            if whole:
                mark = SOFT
            elif any(w in FURNITURE_NAMES for part in value.split() for w in re.split(r"[-_]", part)):
                mark = max(mark, PART)
    return mark


def blocks(page: str) -> list[Block]:
    """Blocks in page order. Character references are decoded, white space inside a block is one space."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, furniture, main; both are inherited
    parts: list[str] = []
    link_parts = 0
    in_link = heading = False

    def close() -> None:
        nonlocal link_parts
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            _, furniture, main = stack[-1] if stack else ("", NONE, False)
            out.append(Block(text, min(link_parts, len(text)), furniture >= SOFT, main, heading, furniture == PART, furniture == SOFT))
        parts.clear()
        link_parts = 0

    def add(text: str) -> None:
        nonlocal link_parts
        if text:
            parts.append(text)
            if in_link:
                link_parts += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing, rest = bool(m["close"] or m["close2"]), m["rest"] or m["rest2"] or ""
        if name in RAW_TAGS and not closing and not rest.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            if name in BLOCK_TAGS:
                close()
            at = end.end() if end else n
            continue
        if name == "a":
            in_link = not closing
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in ("td", "th"):
            parts.append(" ")
            continue
        if name not in BLOCK_TAGS and (name in VOID_TAGS or name not in ("button", "span", "datalist")):
            continue
        is_block = name in BLOCK_TAGS
        if is_block:
            close()
            heading = False
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if not is_block and max(x[1] for x in stack[i:]) != (stack[i - 1][1] if i else NONE):
                        close()
                    del stack[i:]
                    break
            if is_block:
                in_link = in_link and name in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "div")
        elif name != "hr":
            _, furniture, main = stack[-1] if stack else ("", NONE, False)
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()  # a paragraph ends where the next begins
                _, furniture, main = stack[-1] if stack else ("", NONE, False)
            if name == "li":
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ("ul", "ol", "menu"):
                        break
                    if stack[i][0] == "li":
                        del stack[i:]
                        _, furniture, main = stack[-1] if stack else ("", NONE, False)
                        break
            new = max(furniture, _furniture(name, rest, main))
            if new == PART and name in MAIN_TAGS and not main and _named(rest) == NONE:
                new = NONE  # a wrapper's compound name tells of the layout, not of the article in it
            if not is_block and new != furniture:
                close()
            stack.append((name, new, main or (name in MAIN_TAGS and not new)))
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
    close()
    return out


def _measures(b: Block) -> tuple[int, float, float]:
    """Length, share of stop words among the words, share of link text."""
    words = _WORDS.findall(b.text.lower())
    if b.sentences:
        # A character of Chinese or Japanese says about as much as three letters.
        length = len(b.text) + 2 * len(_DENSE.findall(b.text))
        return length, STOP_HIGH if length >= SHORT and _SENTENCE.search(b.text) else 0.0, b.link_chars / len(b.text)
    return len(b.text), sum(w in _STOP for w in words) / max(len(words), 1), b.link_chars / len(b.text)


#: Place: the least length and stop-word density of running text there, and the most link text. In an article little will do, in
#: an element with a part of a furniture word in its name more must speak for a block.
RUNNING = {"article": (SHORT, STOP_LOW / 2, LINKS), "page": (SHORT, STOP_HIGH, LINKS), "partly": (SHORT, STOP_HIGH, LINKS / 2)}


def _place(b: Block) -> str:
    return "furniture" if b.furniture else "partly" if b.partly else "article" if b.main else "page"


def _running(b: Block) -> bool:
    if b.furniture:
        return False
    (length, stop, links), (least, density, most) = _measures(b), RUNNING[_place(b)]
    return length >= least and stop >= density and links <= most


def first_pass(b: Block, in_article: bool) -> tuple[str, str]:
    """good, bad or short, and what decided: links, density or place. A short block is one whose own measures do not tell.
    ``in_article`` says that the page's article or main elements hold running text, so that none is looked for outside."""
    length, stop, links = _measures(b)
    if links > LINKS:
        return "bad", "links"
    place = _place(b)
    if place == "furniture" or (in_article and not b.main):
        return "bad", "place"
    if _running(b):
        return "good", "density"
    if place == "article":
        return "short", "density"
    if place == "partly":
        return "bad", "density"
    if length < SHORT:
        return ("short", "density") if links == 0 else ("bad", "links")
    if stop >= STOP_LOW:
        return ("good" if length > LONG else "short"), "density"
    return ("short" if length > LONG and links == 0 else "bad"), "density"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Short blocks inherit from the nearest decided neighbour; at equal distance one good neighbour decides for a heading
    or where both are good. Inside a main element only its own blocks are neighbours. Without any decided neighbour a
    page of short blocks is kept as it is."""
    n = len(found)
    before, after = [None] * n, [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: int | None = None
        for i in order:
            near[i] = last
            if labels[i] != "short" and not found[i].furniture and not (found[i].partly and labels[i] == "bad"):
                last = i
    out = []
    for i, label in enumerate(labels):
        if label != "short":
            out.append(label == "good")
            continue
        sides = [j for j in (before[i], after[i]) if j is not None and found[j].main == found[i].main]
        if not sides:
            out.append(True)
            continue
        distance = min(abs(i - j) for j in sides)
        near = [labels[j] == "good" for j in sides if abs(i - j) == distance]
        if found[i].heading and after[i] in sides:
            near = [labels[after[i]] == "good"]
        out.append(any(near) if found[i].main else all(near))
    return out


def _kept(found: list[Block]) -> tuple[list[bool], bool]:
    """Which blocks stay, and whether any of them is running text."""
    in_article = any(b.main and _running(b) for b in found) or not any(_running(b) for b in found) and any(b.main for b in found)
    labels = [first_pass(b, in_article)[0] for b in found]
    return second_pass(found, labels), "good" in labels


def main_text(page: str | None) -> str:
    """Main blocks joined by two line ends; empty if there are none."""
    found = blocks(page or "")
    kept, running = _kept(found)
    if not running:
        again, running = _kept([replace(b, furniture=b.furniture and not b.softly, sentences=True) for b in found])
        kept = again if running else kept
    return "\n\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Null html counts as empty and gives the empty text; null ids and urls pass. Repeated rows get equal texts; an empty
    table an empty result; other columns are not read.
    """
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 256):
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["__id", "__url", "text", "n_chars"],
                )

    narrow = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"), F.col(html_col).alias("__html"))
    out = narrow.mapInArrow(run, f"__id {id_type}, __url string, text string, n_chars long")
    return out.withColumnRenamed("__id", id_col).withColumnRenamed("__url", url_col)
