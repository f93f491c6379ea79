"""Main text of web pages by tree scoring: paragraphs pass points to ancestors, link density discounts them."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Names of elements by what they mean for a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noscript noembed noframes xmp template svg math select".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul hr".split()
)
CLOSES_P = BLOCK - set("td th tr tbody thead tfoot caption head html body summary legend dd dt li".split())
NEVER = set("head nav footer aside form button dialog menu object audio video canvas label fieldset".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
UNLIKELY = set(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer footnav comment comments disqus "
    "respond reply replies share sharing social related recommended recommendations widget toolbar pagination pager login search skip legal copyright".split()
)
#: Words that say nothing of their own beside one of those, as in "share-buttons".
COMPANIONS = set(
    "a area articles bar block bottom box buttons by card center class col column container content count feed form group holder icons id in inner item items js left "
    "letter level link links list main media module more nested news of on outer page pages panel popular post posts primary reader readers region right row secondary "
    "section site slot stories story sub tags text the thread title to top unit user users view wrap wrapper your zone".split()
)
LIKELY = set("article articlebody body content entry main post story text".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
TAG_POINTS = {"article": 25, "main": 15, "section": 5, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3, "form": -3, "li": -3, "th": -5}

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)(>|\Z)""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""(?i)(?<![^\s/"'])(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """Elements in page order: tag, parent and hints; pieces of text with their element and the number of their block."""

    def __init__(self, source: str):
        self.tags, self.parents, self.hints = ["#page"], [-1], [0]
        self.pieces: list[tuple[int, int, str]] = []
        self.block = 0
        open_now, at, end = [0], 0, len(source)
        while at < end:
            found = _TOKEN.search(source, at)
            self._text(open_now[-1], source[at : found.start() if found else end])
            if not found:
                break
            at = found.end()
            if found[1]:
                self._close(open_now, found[1].lower())
            elif found[2] and found[4]:
                tag = found[2].lower()
                if tag in ("svg", "math") and found[3].endswith("/"):
                    continue  # only foreign elements can close themselves; elsewhere the slash means nothing
                self._open(open_now, tag, found[3])
                if tag in RAW:
                    closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                    at = closing.end() if closing else end
                    open_now.pop()

    def _text(self, element: int, text: str) -> None:
        if text and not text.isspace():
            self.pieces.append((element, self.block, html.unescape(text) if "&" in text else text))
        elif text:
            self.pieces.append((element, self.block, " "))

    def _open(self, open_now: list[int], tag: str, attributes: str) -> None:
        if tag in ("html", "body") and any(self.tags[i] == tag for i in open_now):
            return
        if tag == "body":
            self._pop_to(open_now, {"head"}, set())
        if tag in CLOSES_P:
            self._pop_to(open_now, {"p"}, {"td", "th", "caption", "button", "object"})
        if tag in ITEMS:
            self._pop_to(open_now, set(ITEMS[tag]), SCOPES[tag])
        if tag in BLOCK:
            self.block += 1
        if tag == "br":
            self.pieces.append((open_now[-1], self.block, " "))
        if tag in VOID:
            return
        self.tags.append(tag)
        self.parents.append(open_now[-1])
        self.hints.append(_hint(tag, attributes))
        open_now.append(len(self.tags) - 1)

    def _close(self, open_now: list[int], tag: str) -> None:
        if tag in BLOCK:
            self.block += 1
        if tag not in ("html", "body"):
            self._pop_to(open_now, {tag}, set() if tag in BLOCK else BLOCK - {"p"})

    def _pop_to(self, open_now: list[int], tags: set[str], stop: set[str]) -> None:
        for k in range(len(open_now) - 1, 0, -1):
            tag = self.tags[open_now[k]]
            if tag in tags:
                del open_now[k:]
                return
            if tag in stop:
                return


def _hint(tag: str, attributes: str) -> int:
    """-2: not part of an article by its tag, role or name, -1: by one word of its name only, 1: likely its container, 0: none of these."""
    hint = -2 if tag in NEVER or tag in RAW else 0
    if not attributes or attributes.isspace():
        return hint
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return -2
        if name == "role":
            hint = -2 if value.lower() in ROLES else 1 if value.lower() in ("main", "article") else hint
        elif name in ("class", "id"):
            parts = {p.lower() for p in _NAME_PARTS.findall(value)}
            if parts & UNLIKELY and tag not in ("html", "body", "article", "main") or parts & {"comment", "comments"} and tag == "article":
                words = [{p.lower() for p in _NAME_PARTS.findall(word)} for word in value.split()]
                if any(w & UNLIKELY and w <= UNLIKELY | COMPANIONS for w in words):
                    return -2
                hint = min(hint, -1)
            elif parts & LIKELY and hint == 0:
                hint = 1
    return hint


def main_text(source: str) -> str:
    """The article's blocks, one a line."""
    page = Page(source)
    n = len(page.tags)
    owner = list(range(n))  # the nearest block element
    in_link, dropped, in_article = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up, tag = page.parents[i], page.tags[i]
        owner[i] = i if tag in BLOCK else owner[up]
        in_link[i] = in_link[up] or tag == "a"
        in_article[i] = in_article[up] or tag in ("article", "main") or page.hints[i] > 0
    whole, linked, length, commas = [0] * n, [0] * n, [0] * n, [0] * n
    for i, _, text in page.pieces:
        size = len(text)
        whole[i] += size
        linked[i] += size * in_link[i]
        length[owner[i]] += size
        commas[owner[i]] += text.count(",") + text.count("،") + text.count("，")
    for i in range(n - 1, 0, -1):
        whole[page.parents[i]] += whole[i]
        linked[page.parents[i]] += linked[i]
    plain = [w - l for w, l in zip(whole, linked)]
    alike = Counter((page.parents[i], page.tags[i], page.hints[i]) for i in range(1, n) if page.hints[i] == -1)
    for i in range(1, n):
        up, tag = page.parents[i], page.tags[i]
        # inside an article one word of a name isn't enough: its structure must be that of a list of links or of answers
        agrees = tag not in TEXT_BLOCKS and (linked[i] > 0.3 * max(whole[i], 1) or alike[up, tag, -1] > 1)
        bad = page.hints[i] < -1 or (page.hints[i] == -1 and (not in_article[up] or agrees)) or (tag == "header" and not in_article[up])
        wraps = page.tags[i] in ("form", "div", "fieldset", "object", "header", "section") and plain[i] > 0.8 * plain[0]
        dropped[i] = dropped[page.parents[i]] or (bad and not wraps)
    score = [0.0] * n
    for i in range(1, n):
        if length[i] < 25 or dropped[i]:
            continue
        points, up, depth = 1 + commas[i] + min(length[i] // 100, 3), page.parents[i], 0
        while up > 0 and depth < 5:
            score[up] += points / (1, 2, 6, 9, 12)[depth]
            up, depth = page.parents[up], depth + 1
    scored = [i for i in range(1, n) if score[i] > 0 and not dropped[i]]
    for i in scored:
        score[i] = (score[i] + TAG_POINTS.get(page.tags[i], 0) + 25 * (page.hints[i] > 0)) * (1 - linked[i] / max(whole[i], 1))
    best = max(scored, key=lambda i: score[i], default=0) or next((i for i in range(1, n) if page.tags[i] in ("article", "main") and not dropped[i]), 0)
    up = best
    while up > 0:  # an article's part stands for the whole of it
        if page.tags[up] in ("article", "main") or (page.hints[up] > 0 and page.tags[up] != "body"):
            best = up
            if page.tags[up] == "article":
                break
        up = page.parents[up]
    chosen = _chosen(page, best, score, dropped, whole, linked)
    blocks: dict[int, list[str]] = {}
    for i, block, text in page.pieces:
        if chosen[i]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _chosen(page: Page, best: int, score: list[float], dropped: list[bool], whole: list[int], linked: list[int]) -> list[bool]:
    """Elements whose text is kept: the best container and good siblings, without what is dropped or little but links."""
    n, siblings = len(page.tags), page.parents[best]
    least = max(10.0, 0.2 * score[best])
    chosen = [best == 0] + [False] * (n - 1)
    links = [0] * n
    for i in range(n - 1, 0, -1):
        links[i] += page.tags[i] == "a"
        links[page.parents[i]] += links[i]
    for i in range(1, n):
        up, tag = page.parents[i], page.tags[i]
        dense = linked[i] / max(whole[i], 1)
        if i == best:
            chosen[i] = True
        elif chosen[up] and up != siblings or best == 0 and up == 0:
            chosen[i] = not (links[i] > 1 and dense > 0.5 and tag in ("ul", "ol", "dl", "div", "section", "table"))
        elif up == siblings and best > 0:
            chosen[i] = score[i] >= least or (tag in TEXT_BLOCKS and dense < 0.25 and whole[i] > 0 and page.tags[best] not in ("article", "main"))
        chosen[i] = chosen[i] and not dropped[i]
    return chosen


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` and ``text``: the main text of every whole page, empty if there is none.

    Paragraph-like blocks of 25 characters or more give 1 point, 1 for each comma and up to 3 for their length to their parent, less to
    the next four ancestors; tags and names add or take points; a container's share of link text discounts its sum. The
    best container, widened to the article it is part of, and its good siblings are kept. Menus, page headers, footers, asides,
    forms, hidden and embedded elements, and elements with the names of adverts, notices or comments go, unless they wrap
    nearly all plain text. A name that holds such a word beside words of its own ("market-share") counts inside an
    article only if links or like neighbours agree, and never for a paragraph or heading there. Null and empty pages give the empty text, broken markup never fails; rows repeat as in the
    input; an empty table gives no rows; columns that aren't named are not read.
    """
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "") for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names)

    names = [*(f"kept_{i}" for i in range(len(keep))), "extracted"]
    rows = df.select(F.col(html_col).alias("page"), *(F.col(k).alias(f"kept_{i}") for i, k in enumerate(keep)))
    schema = ", ".join([*(f"kept_{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)), "extracted string"])
    return rows.mapInArrow(run, schema).select(*(F.col(f"kept_{i}").alias(k) for i, k in enumerate(keep)), F.col("extracted").alias("text"))
