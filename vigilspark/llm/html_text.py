"""Main text of web pages by two-pass block rules.

Pass 1 labels every block good, bad or ambiguous. Page furniture (menus, footers, forms, adverts, comments, by tag, class or
id) is bad. For all else link density, length and the density of stop words decide: mostly links is bad; long enough and
rich in stop words is good; short blocks, and long ones with few stop words, are ambiguous. A page whose words are known in
no list of stop words is decided by length and links alone; wide characters count three times in a length.

Pass 2 lets ambiguous blocks inherit from the nearest decided blocks before and after them in the same box (the innermost
div, section, list, ... around them); where these differ the nearer one decides, the earlier one on a tie, and a heading
goes with what follows it. Short blocks of a box without a decided one are first looked at together, as one block. If that
decides nothing they take the nearest decided blocks of the page, where an article or main element around them is one more
vote. Furniture is no neighbour; where nothing else is decided in a page, what is not furniture is its text.

One page is one row and is handled alone: nothing is shuffled. Cases: NULL or empty html and pages without text give
an empty string; markup that never closes ends with the page, and is passed over once; repeated rows and NULL ids or urls
pass through; columns of the table beyond page_id, url and html are not read.
"""

from __future__ import annotations

import html as refs
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import query, table

#: Fixed lists of frequent words.
STOP_WORDS = {
    "en": "the of and to in a is that it for on with as are was be by at this from or an not which have but his they you we has were will their can all one there",
    "fr": "le la les de des du un une et en est que qui dans pour sur pas au aux par avec il elle on ne se ce cette son sa ses plus ou nous vous leur mais",
    "de": "der die das und in zu den von mit ist des im für auf ein eine nicht sich dem es an auch als er sie werden aus bei nach wie oder hat wird sind",
    "es": "el la los las de del que y en un una es se no por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin",
}
STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())
LETTERS = re.compile(r"[^\W\d_]+")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile("[>\"']")
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
HINT = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*["']?true""", re.I)
#: Parts of class and id names that mark page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(ad|ads|adbox|advert\w*|adslot|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|rail|widget\w*|menu\w*|nav\w*|breadcrumb\w*|toolbar|"
    r"footer\w*|masthead|topbar|site-?header|page-?header|comment\w*|disqus\w*|replies|reply|respond|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay\w*|"
    r"newsletter\w*|subscri\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|pagination|pager|search\w*|copyright|legal|tags|navigation|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
RAW = frozenset("script style noscript template iframe textarea select svg math object canvas title head xmp noembed noframes audio video".split())
FRAME = frozenset("nav footer aside form button dialog menu label option datalist fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tags are tracked; the rest may stay open, as p and li often do.
TRACKED = frozenset("article aside blockquote body button details dialog div dl figure footer form header main menu nav ol pre section table ul fieldset label option datalist span".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, LINKS = 0.04, 0.12, 0.5
#: A page with so many words, of which no more than this share are stop words, is in a language without a list.
UNKNOWN_WORDS, UNKNOWN = 20, 0.01


class Block:
    """``bad``: page furniture; ``home``: inside an article or main element; ``box``: number of the element around it."""

    __slots__ = ("text", "linked", "tag", "bad", "home", "box")

    def __init__(self, text, linked, tag, bad, home, box):
        self.text, self.linked, self.tag, self.bad, self.home, self.box = text, linked, tag, bad, home, box


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place of the > that ends a tag, quoted values passed over, or -1; an open quote does not count as one.

    ``last`` holds the last place of >, \" and ' in the page, so that what never closes is known without a search.
    """
    if at > last[">"]:
        return -1
    k = at
    while (m := STOP.search(page, k)) and m[0] != ">":
        if m.start() >= last[m[0]]:
            return page.find(">", at)
        k = page.find(m[0], m.end()) + 1
    return m.start() if m else page.find(">", at)


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order; markup, scripts, styles and comments are left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, furniture here or around, inside an article or main element, box
    still_open: dict[str, int] = {}
    last = {c: page.rfind(c) for c in ">\"'"}
    parts: list[str] = []
    links, linked, tag, boxes, at = 0, 0, "body", 0, 0

    def flush():
        nonlocal linked
        text = " ".join(refs.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, bad, home, box = stack[-1] if stack else ("", False, False, 0)
            out.append(Block(text, linked, tag, bad or tag == "furniture", home, box))
        linked = 0

    def add(text):
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(" ".join(refs.unescape(text).split()))

    def close_from(k):
        for name, *_ in stack[k:]:
            still_open[name] -= 1
        del stack[k:]

    end = len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = NAME.match(page, lt)
        close = tag_end(page, m.end(), last) if m else -1
        if close < 0:
            add("<")
            at = lt + 1
            continue
        at = close + 1
        closing, name, attrs = m[1], m[2].lower(), page[m.end() : close]
        if name in RAW and not closing:
            if not attrs.endswith("/"):
                found = re.compile(rf"</{name}\s*>" + (r"|(?=<body[\s>])" if name == "head" else ""), re.I).search(page, at)
                at = end if not found else found.end()
            if name in BLOCK:
                flush()
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            tag = "body" if closing else name
        if name in TRACKED:
            if closing:
                if still_open.get(name):
                    k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
                    if name not in BLOCK and stack[-1][1]:
                        flush()
                    close_from(k)
            elif not attrs.endswith("/"):
                if name in ("article", "main"):
                    while stack and stack[-1][0] in ("nav", "header"):  # never closed
                        close_from(len(stack) - 1)
                _, around, home, box = stack[-1] if stack else ("", False, False, 0)
                home = home or name in ("article", "main")
                names = " ".join(x for g in HINT.findall(attrs) for x in g if x)
                bad = name in FRAME or (name == "header" and not home) or bool(HIDDEN.search(attrs)) or (name not in ("body", "article", "main") and bool(FURNITURE.search(names)))
                if name in BLOCK:
                    boxes += 1
                    box = boxes
                elif bad:
                    flush()
                stack.append((name, bad or around, home, box))
                still_open[name] = still_open.get(name, 0) + 1
        elif name in BLOCK and not closing and FURNITURE.search(" ".join(x for g in HINT.findall(attrs) for x in g if x)):
            tag = "furniture"
    flush()
    return out


def stop_words(text: str) -> tuple[int, int]:
    """(stop words, words) of a text."""
    w = LETTERS.findall(text.lower())
    return sum(x in STOPS for x in w), len(w)


def first_label(b: Block, known: bool = True) -> int:
    """1 good, -1 bad, 0 ambiguous. ``known``: the page is in a language with a list of stop words."""
    if b.bad:
        return -1
    size = len(b.text)
    if b.linked > LINKS * size and b.tag not in HEADING:
        return -1
    if size + 2 * len(WIDE.findall(b.text)) < SHORT:
        return 0
    if not known:
        return 1
    stops, n = stop_words(b.text)
    density = stops / max(1, n)
    return 1 if density >= STOP_HIGH or (density >= STOP_LOW and size >= LONG) else 0


def nearest(k: int, i: int | None, j: int | None, labels, heading: bool) -> int:
    """What block k inherits from the decided blocks i before and j after it; 0 without any."""
    if i is None or j is None:
        return labels[i] if j is None and i is not None else labels[j] if j is not None else 0
    if heading or labels[i] == labels[j]:
        return labels[j]
    return labels[i] if k - i <= j - k else labels[j]


def around(decided: list[bool], group: list) -> list[tuple[int | None, int | None]]:
    """For every block the nearest decided ones of its group, before and after it."""
    n = len(decided)
    out = [[None, None] for _ in range(n)]
    for side, order in ((0, range(n)), (1, range(n - 1, -1, -1))):
        seen: dict = {}
        for k in order:
            out[k][side] = seen.get(group[k])
            if decided[k]:
                seen[group[k]] = k
    return [tuple(x) for x in out]


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    counts = [stop_words(b.text) for b in found if not b.bad]
    total = sum(n for _, n in counts)
    known = total < UNKNOWN_WORDS or sum(s for s, _ in counts) > UNKNOWN * total
    labels = [first_label(b, known) for b in found]
    # furniture says nothing about the blocks beside it
    content = [x != 0 and not b.bad for b, x in zip(found, labels)]
    decided = {b.box for b, x in zip(found, content) if x}
    loose: dict[int, list[int]] = {}
    for k, b in enumerate(found):
        if labels[k] == 0 and b.box not in decided:
            loose.setdefault(b.box, []).append(k)
    for own in loose.values():
        whole = Block(" ".join(found[k].text for k in own), sum(found[k].linked for k in own), "p", False, False, 0)
        if first_label(whole, known):
            for k in own:
                labels[k], content[k] = first_label(whole, known), True
    boxed = around(content, [b.box for b in found])
    paged = around(content, [0] * len(found))
    final = list(labels)
    for k, b in enumerate(found):
        if labels[k] == 0:
            heading = b.tag in HEADING
            final[k] = nearest(k, *boxed[k], labels, heading)
            if final[k] == 0:
                i, j = paged[k]
                votes = sum(labels[x] for x in (i, j) if x is not None) + b.home
                final[k] = (votes > 0) - (votes < 0) or nearest(k, i, j, labels, heading) or 1
    return "\n".join(b.text for b, x in zip(found, final) if x > 0)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every page."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x) for x in b.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


@query("op9_html_extraction")
def op9_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
