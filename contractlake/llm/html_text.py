"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block element. A line's weight is its text length: more in an article
or main part, 0 for lines that are mostly link text. Menus, headers, footers and the like hold no lines;
where the page jumps over such a part outside of an article, empty lines stand in for it. The weights of
`window` lines from each line on are summed. A surge point is where that sum rises over the threshold and its
first line has text; the dive point is where it falls to nothing. In an article or main part the text goes from
its first surge point to its last dive point; elsewhere the lines between the points are the text, and with
them what else stands in the same container, on both sides of skipped parts.

A class name can tell of furniture or of a subject: its last word decides, layout words apart. A part that is
skipped for its class, or a form, comes back if without it no text is left, or if it holds so much of the text
that it can only be the page's own frame.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import short_batches, slices, text_column

# fixed values: element and attribute names of HTML
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "object", "svg", "canvas", "select")
SKIPPED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset"}
BLOCKS = set("address article aside blockquote body center dd details dir div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Elements that the next of their kind ends; a paragraph ends at any block.
IMPLIED = {"p", "li", "dd", "dt", "tr", "td", "th", "option"}
#: Elements that hold a text's blocks. Outside of them, the page between two skipped parts other than adverts is one container.
CONTAINERS = {"article", "main", "section", "div", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = HEADINGS | {"p", "blockquote", "pre", "dd", "dt"}
ADVERTS = set("ad ads adv advert adverts advertisement advertising adsense adslot promo promos promotion promoted sponsor sponsored sponsors newsletter subscribe subscription signup share sharing social related recommended recommendations".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "note"}
COMMENTS = set("comment comments commentlist replies reply respond disqus discussion".split())
NAMES = set(
    "toc ad ads adv advert adverts advertisement advertising adsense adslot banner banners breadcrumb breadcrumbs comment comments commentlist replies reply respond disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup promo promos promotion promoted sponsor sponsored sponsors share sharing social related recommended recommendations nav navbar navigation menu menubar topbar toolbar sidebar sidebars side rail widget widgets footer foot footnav header masthead copyright login search pagination pager skip hidden".split()
)

#: Words behind a name that tell of its layout only.
LAYOUT = set(
    "area areas article articles bar bars block blocks body bottom box boxes btn button buttons cell center col column columns component container content desktop div element fixed form group head icon icons image images inline inner item items label large layer left link links list lists main media mobile outer page panel posts post right row section slot small space stack top unit units view wrap wrapper zone".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<>]*(?:>|\Z))|</?\Z", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")
#: What a class says that a part has or lacks is not what the part is.
_STATE = re.compile(r"(?<![a-z0-9])(?:no|not|non|has|with|without)[-_]\S*")


@dataclass
class Line:
    """A block's text. part: the outermost article or main element it stands in (0: none), home: that one's container. gap: a skipped part lies before it. box: its container, tag: its element."""

    part: int
    gap: bool
    home: int = 0
    box: int = 0
    tag: str = ""
    texts: list[str] = field(default_factory=list)
    linked: int = 0
    length: int = 0
    text: str = ""


#: Why a part is skipped: for what it is, for a class name that adverts or comments bear, for another class name.
IS, BEARS, NAMED = 3, 2, 1
#: A line of an article or main part weighs so many times its length.
MARKED = 4
#: A named part with so many times the text of the rest is no furniture; within an article or main part, one of several paragraphs with as much.
MOST = 4


@dataclass
class Named:
    """A form or a part skipped for its class. held: how much text it has outside links and parts in it, blocks: how many headings and paragraphs, inside: whether it stands in an article or main part."""

    why: int
    inside: bool
    held: int = 0
    blocks: int = 0


def names(value: str) -> set[str]:
    """The words of class names that say what a part is: of each name the last one, words of layout and numbers apart, or if there are no others, the words of furniture among them."""
    out = set()
    for name in _STATE.sub(" ", value).split():
        words = [w for w in _NAME.split(name) if w and not _DIGITS.fullmatch(w)]
        told = [w for w in words if w not in LAYOUT]
        out |= {told[-1]} if told else NAMES.intersection(words)
    return out


def _boilerplate(name: str, attributes: str) -> int:
    if name in SKIPPED:
        return IS
    if not attributes or name in ("html", "body", "article", "main", "a", "p", "span", "b", "i", "em", "strong") and "hidden" not in attributes and "class" not in attributes and "role" not in attributes and "id" not in attributes:
        return 0
    named = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return IS
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return IS
        if key == "role" and value in ROLES:
            return IS
        if key in ("class", "id") and name not in ("html", "body", "main"):
            words = NAMES & names(value)
            if words:
                named = max(named, BEARS if words & (COMMENTS if name == "article" else ADVERTS | COMMENTS) else NAMED)
    return named


def lines(page: str, pardoned: frozenset[int] = frozenset()) -> tuple[list[Line], dict[int, Named]]:
    """The page's blocks with text outside skipped parts; and by their places the forms and the parts skipped for their class.

    pardoned: places of parts that are not skipped.
    """
    out: list[Line] = []
    named: dict[int, Named] = {}
    inner = 0  # depth of skipped parts in the skipped part
    now = Line(0, False)
    parts: list[tuple[str, int, int]] = []
    boxes: list[tuple[str, int]] = []
    skipping, depth, links, count, at, stretch, place = "", 0, 0, 0, 0, 0, -1

    def close(gap: bool = False) -> None:
        nonlocal now
        now.text = " ".join("".join(now.texts).split())
        if now.text:
            now.length = len(now.text)
            out.append(now)
        else:
            gap = gap or now.gap
        part, home = parts[-1][1:] if parts else (0, 0)
        now = Line(part, gap, home, boxes[-1][1] if boxes else stretch)

    def add(raw: str) -> None:
        if skipping:
            if place in named and not inner and not links:
                named[place].held += len(raw.strip())
        elif raw:
            text = html.unescape(raw)
            now.texts.append(text)
            if links:
                now.linked += len(text.strip())

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        closing, name, attributes = bool(m[1]), m[2].lower(), m[3].removesuffix(">")
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if skipping:
            if not closing and name in PROSE and place in named:
                named[place].blocks += 1
            if name == "a":
                links = 0 if closing else 1
            elif name not in VOID and name != skipping and (inner or not closing and _boilerplate(name, attributes)) and name in BLOCKS:
                inner = max(0, inner + (-1 if closing else 1))
            if not closing and name in ("article", "main") and not _boilerplate(name, attributes) and skipping not in ("aside", "article", "main"):
                skipping = ""  # a part that was never closed ends where the article begins
            elif skipping in IMPLIED and (not closing and name == skipping or skipping == "p" and name != "p" and name in BLOCKS):
                skipping = ""
                close(True)
            elif name == skipping:
                depth += -1 if closing else 1
                if depth == 0:
                    skipping = ""
                    close(True)
                continue
            else:
                continue
        why = 0 if closing or name in VOID or m.start() in pardoned else _boilerplate(name, attributes)
        if why:
            if not boxes and name != "aside" and why != BEARS:
                close(True)
                stretch -= 1
            close(True)
            skipping, depth, inner, links, place = name, 1, 0, 0, m.start()
            if why < IS or name == "form":
                named[place] = Named(why, bool(parts))
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br" or name in ("td", "th"):
            now.texts.append(" ")
        elif name in BLOCKS:
            links = 0
            close()
            if name in ("article", "main"):
                if closing:
                    if any(p[0] == name for p in parts):
                        while parts.pop()[0] != name:
                            pass
                else:
                    count += 1
                    parts.append((name, *parts[-1][1:]) if parts else (name, count, now.box))
            if name in CONTAINERS:
                if not closing:
                    count += 1
                    boxes.append((name, count))
                elif any(b[0] == name for b in boxes):
                    while boxes.pop()[0] != name:
                        pass
            if name in CONTAINERS:
                close()
            now.tag = "" if closing else name
    close()
    return out, named


def between(weights: list[int], window: int, surge: int) -> set[int]:
    """Places of the lines with weight from each surge point to the dive point after it."""
    sums = [sum(weights[k : k + window]) for k in range(len(weights))]
    kept: set[int] = set()
    inside = False
    for k, w in enumerate(weights):
        inside = sums[k] > 0 and (inside or (w > 0 and sums[k] >= surge))
        if inside and w:
            kept.add(k)
    return kept


def choose(found: list[Line], window: int, surge_chars: int, link_share: float) -> list[Line]:
    """The lines of the main text. See main_text."""
    weights: list[int] = []
    owners: list[int] = []
    for k, line in enumerate(found):
        # what is cut out of an article leaves no gap in it
        if line.gap and not (line.part and k and found[k - 1].part and found[k - 1].home == line.home):
            weights += [0] * window
            owners += [-1] * window
        weights.append(line.length * (MARKED if line.part else 1) if line.linked <= link_share * line.length else 0)
        owners.append(k)
    surging = {owners[k] for k in between(weights, window, surge_chars)}
    plain = {owners[k] for k in range(len(weights)) if weights[k]}
    of_home: dict[int, int] = {}
    of_box: dict[int, int] = {}
    for k in sorted(surging or plain):
        of, at = (of_home, found[k].home) if found[k].part else (of_box, found[k].box)
        of[at] = of.get(at, 0) + found[k].length
    if of_home and (surging or MARKED * max(of_home.values()) >= max([*of_box.values(), 0])):
        home = max(of_home, key=lambda h: (of_home[h], -h))
        own = [k for k, line in enumerate(found) if line.part and line.home == home]
        points = [at for at, k in enumerate(own) if k in surging]
        first, last = (points[0], points[-1]) if points else (0, len(own) - 1)
        # a heading in front belongs to what it heads; lines of links at the ends have no weight, the sums don't see them
        while first and (found[own[first - 1]].tag in HEADINGS or own[first - 1] not in plain and found[own[first - 1]].tag in PROSE):
            first -= 1
        while last + 1 < len(own) and own[last + 1] not in plain and found[own[last + 1]].tag in PROSE:
            last += 1
        text = set(own[first : last + 1])
        return [line for k, line in enumerate(found) if k in text or (not line.part and line.box == home and line.tag in HEADINGS)]
    held = {b for b, n in of_box.items() if n >= surge_chars} if surging else set(sorted(of_box, key=lambda b: -of_box[b])[:1])
    kept = set(surging)
    ends: dict[int, list[int]] = {}
    for k, line in enumerate(found):
        if line.box in held and (k in plain or line.tag in PROSE):
            kept.add(k)
            ends.setdefault(line.box, [k, k])[1] = k
    for k, line in enumerate(found):
        if line.box in ends and ends[line.box][0] < k < ends[line.box][1]:
            kept.add(k)
    return [found[k] for k in sorted(kept)]


def main_text(page: str, window: int = 3, surge_chars: int = 80, link_share: float = 0.5) -> str:
    """The page's main text, blocks joined by newlines; empty if there is none.

    Runs of lines must reach `surge_chars` within `window` lines; lines of an article or main part weigh
    MARKED times their length. If such lines surge, the text stands in the container of parts in which most
    surges, from the first surge point to the last dive point, with the headings beside it: lines elsewhere
    are not its text. Otherwise it is the containers of the runs, or, if nothing surges, the container with the
    most text. Lists of links count only between other lines. A part skipped for its class, or a form, is
    tried, the one with the most text first, if nothing else is left or if its text outweighs the rest MOST
    times (paragraphs within an article or main part: once); for the words of adverts and comments only the first holds.
    """
    pardoned: frozenset[int] = frozenset()
    found, named = lines(page)
    while True:
        kept = choose(found, window, surge_chars, link_share)
        rest = sum(line.length for line in found)
        rivals = [(n.held, -at) for at, n in named.items() if n.held and (not kept or (n.why != BEARS and n.held >= (1 if n.inside and n.blocks > 1 else MOST) * rest))]
        if not rivals:
            return "\n".join(line.text for line in kept)
        pardoned |= {-max(rivals)[1]}
        found, named = lines(page, pardoned)


def extract(pages: DataFrame, page: str = "html", keep: list[str] | None = None, window: int = 3, surge_chars: int = 80) -> DataFrame:
    """Kept columns (default page_id and url) with text string and n_chars long, of each whole page.

    A null or empty page has the empty text. Truncated pages, unclosed and crossing elements are read
    as far as they go; a tag that the page's end cuts is no text. A very long page is read whole.
    Repeated rows are answered each, an empty table gives no rows. Each page is read on its own;
    nothing is shuffled.
    """
    short_batches(pages.sparkSession)
    keep = ["page_id", "url"] if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    rows = pages.select(*[pages[c].alias(n) for c, n in zip(keep, names, strict=True)], text_column(pages[page]).alias("body"))
    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + ["text string, n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(p, window, surge_chars) for p in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[out[n].alias(c) for n, c in zip(names, keep, strict=True)], "text", "n_chars")
