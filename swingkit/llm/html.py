"""Main text of HTML pages by line-block distribution.

Markup is stripped to one line for each block of text; scripts, styles, forms, menus, page headers, footers, sidebars,
notices, adverts and reader comments, known by their tag, role, class or id, leave one empty line. A line weighs its
characters outside links. The weights of ``SPAN`` following lines are summed at every line: where a sum surges to
``SURGE`` (or to the greatest sum of a page that stays below) the main text begins, with the lines before it up to a gap
of ``SPAN`` weightless ones, and where the sums dive to nothing it ends; all lines between are kept, link-only ones too.
A heading that is all link right before the main text is its title, a paragraph that is all link right after it its last line, unless another of its kind stands beside it.

A page's own ``article`` or ``main`` part is a weight: its lines weigh ``SURGE`` more and count their links, lines
outside it weigh a sixteenth, and no sum crosses its border. So dense text outside a marked part of a few words still wins.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.llm.common import small_batches, table

SPAN, SURGE = 3, 80
#: A line outside a page's marked part weighs its characters divided by this.
OUTSIDE = 16
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r""">|=\s*["']""")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[a-z]+")
# Fixed values of HTML: elements without text of the page, elements that don't break a line, elements without an end tag.
_DROPPED = set("head script style noscript template textarea iframe svg math canvas object audio video select button datalist".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
_HEADINGS = set("h1 h2 h3".split())
_EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = set("nav header footer aside form dialog menu".split())
_MAIN = {"article", "main"}
#: Words of a class, id or role that mark what isn't the article, wherever it stands.
_NOISE = set(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promos promotion cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup paywall sidebar sidebars comment comments disqus reply replies respond nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer complementary contentinfo".split()
)
#: Words that mark it outside an article or main part; inside one, only where the element's text is mostly links.
_DOUBTFUL = set(
    "alert alerts popup modal overlay login widget widgets related recommended recommendations popular trending share sharing social pagination pager header masthead toolbar search".split()
)
#: Words that may stand beside one of those in a name, as in "site-header" or "comment-list"; beside others, as in "share-price", it says nothing.
_BESIDE = set(
    "site page top bottom left right primary secondary box bar list section container wrapper wrap area block inner outer item items user users reader readers google slot unit "
    "link links global mobile desktop sticky fixed group panel buttons button icons bottom row col column module region zone thread form holder div title text body content".split()
)


class Line(NamedTuple):
    """A block's text with single spaces, its characters in all and outside links, whether it lies in the main part, and its element."""

    text: str
    size: int
    plain: int
    main: bool
    element: str = ""


def _marks(value: str, words: set[str]) -> bool:
    """Whether a name among the values of a class, id or role consists of ``words`` and of those that may stand beside them."""
    for name in value.split():
        parts = set(_PARTS.findall(name))
        if parts & words and parts <= _NOISE | _DOUBTFUL | _BESIDE:
            return True
    return False


def _noise(name: str, attributes: str, in_main: bool) -> str:
    """"noise", "doubtful" (noise if mostly links) or "" for a start tag."""
    if name in _ASIDE and not (name == "header" and in_main):
        return "noise"
    if not attributes or name in _MAIN or name in ("html", "body"):
        return ""
    found = ""
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id", "role"):
            if _marks(value, _NOISE) or not in_main and _marks(value, _DOUBTFUL):
                return "noise"
            if _marks(value, _DOUBTFUL):
                found = "doubtful"
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return "noise"
    return found


class _Tags:
    """Finds the tags of a page in one pass, whatever its quotes."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.dead: set[int] = set()  # openings of values from which no tag ends

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; -1 if there is none.

        A quote after an equals sign holds to its like; if that leaves the tag open, it ends at the first ``>`` of all.
        """
        if self.last < at:
            return -1
        seen, now = [], at
        while (m := _STOP.search(self.page, now)) is not None:
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            now = -1 if m.start() in self.dead else self.page.find(m[0][-1], m.end()) + 1
            if now <= 0:
                break
        self.dead.update(seen)
        return self.page.find(">", at)

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """The text before each tag, and the tag's lower-case name, whether it closes, and its attributes; comments have no name."""
        page, n, text, at = self.page, len(self.page), 0, 0
        without_end: set[str] = set()
        while (at := page.find("<", at)) >= 0:
            name = _NAME.match(page, at + 1)
            if name is None and page[at + 1 : at + 2] not in ("!", "?"):
                at += 1
                continue
            if name is None:
                comment = page.startswith("<!--", at)
                end = page.find("-->", at + 4) if comment else page.find(">", at) if self.last > at else -1
                if end < 0 and not comment:
                    at += 1
                    continue
                yield page[text:at], "", False, ""
                text = at = n if end < 0 else end + (3 if comment else 1)
                continue
            end = self.end(name.end())
            if end < 0:
                at += 1
                continue
            closing, attributes, kind = page[at + 1] == "/", page[name.end() : end], name[1].lower()
            yield page[text:at], kind, closing, attributes
            text = at = end + 1
            if kind in _DROPPED and not closing and not attributes.endswith("/") and kind not in without_end:
                close = re.compile(rf"</{kind}\s*>", re.I).search(page, at)
                if close:
                    text = at = close.end()
                elif kind == "head":
                    without_end.add(kind)
                else:
                    text = at = n
        yield page[text:], "", False, ""


def lines_of(page: str) -> list[Line]:
    """A line for each block of text, and one empty line for noise."""
    out: list[Line] = []
    text: list[str] = []
    plain, links, main, element = 0, 0, 0, ""
    noise, depth = "", 0  # the element of noise that we are in, and how many of its name are open
    doubt, doubts, since = "", 0, 0  # the doubtful element that we are in, how many of its name are open, and its first line

    def end_line() -> None:
        nonlocal plain
        line = " ".join("".join(text).split())
        if line:
            out.append(Line(line, len(line), plain, main > 0, element))
        text.clear()
        plain = 0

    def empty_line() -> None:
        if not out or out[-1].text:
            out.append(Line("", 0, 0, main > 0))

    def end_doubt() -> None:
        nonlocal doubt
        own = out[since:]
        if sum(x.plain for x in own) * 2 < sum(x.size for x in own):
            del out[since:]
            empty_line()
        doubt = ""

    for raw, name, closing, attributes in _Tags(page):
        if raw and not noise:
            raw = entities.unescape(raw)
            text.append(raw)
            if not links:
                plain += sum(map(len, raw.split()))
        if not name or name in _DROPPED:
            continue
        kind = None
        if noise:
            if name == noise:
                depth += -1 if closing else 1
                if noise in ("p", "li") and not closing:
                    kind = _noise(name, attributes, main > 0)
                    depth = 1 if kind == "noise" else 0
            elif noise == "p" and name not in _INLINE and not closing or closing and name in ("body", "html", "article", "main"):
                depth = 0
            if depth:
                continue
            noise = ""
            if closing and name not in _MAIN:
                continue
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            text.append(" ")
        elif name not in _INLINE:
            end_line()
            links, element = 0, "" if closing else name
        if doubt and (name == doubt or closing and name in _MAIN or doubt == "p" and name not in _INLINE):
            doubts += -1 if closing else 1
            if doubts <= 0 or name in _MAIN or doubt in ("p", "li"):
                end_line()
                end_doubt()
        if name in _MAIN:
            main = max(0, main - 1) if closing else main + 1
        if closing or name in _EMPTY or attributes.endswith("/"):
            continue
        kind = kind or _noise(name, attributes, main > 0)
        if kind == "noise":
            end_line()
            empty_line()
            noise, depth = name, 1
        elif kind == "doubtful" and not doubt:
            end_line()
            doubt, doubts, since = name, 1, len(out)
    end_line()
    if doubt:
        end_doubt()
    return out


def weights_of(lines: list[Line], surge: int = SURGE) -> list[int]:
    """What each line weighs; a page's marked part lends its lines weight and takes it from the others."""
    if not any(x.main and x.text for x in lines):
        return [x.plain for x in lines]
    return [(x.size + surge if x.text else 0) if x.main else x.plain // OUTSIDE for x in lines]


def sums_of(weights: list[int], span: int = SPAN) -> list[int]:
    """The sum of every line and the ``span - 1`` after it."""
    return [sum(weights[i : i + span]) for i in range(len(weights))]


def runs_of(weights: list[int], least: int, span: int = SPAN) -> list[tuple[int, int]]:
    """First and last line of every run: from a surge of the sums to ``least``, back to a gap of ``span`` weightless lines, on to the dive to nothing."""
    sums, out, i, before = sums_of(weights, span), [], 0, 0
    while i < len(weights):
        if sums[i] < least or not weights[i]:
            i += 1
            continue
        first = last = i
        while ahead := [k for k in range(max(before, first - span), first) if weights[k]]:
            first = ahead[0]
        while behind := [k for k in range(last + 1, min(last + span + 1, len(weights))) if weights[k]]:
            last = behind[-1]
        out.append((first, last))
        i = before = last + 1
    return out


def with_linked_ends(lines: list[Line], first: int, last: int) -> tuple[int, int]:
    """A run with the heading right before it and the paragraph right after it, where these are nothing but links and stand alone."""

    def linked(k: int, elements: set[str]) -> bool:
        return 0 <= k < len(lines) and lines[k].element in elements and not lines[k].plain

    if linked(first - 1, _HEADINGS) and not linked(first - 2, _HEADINGS):
        first -= 1
    if linked(last + 1, {"p"}) and not linked(last + 2, {"p"}):
        last += 1
    return first, last


def main_text(page: str | None, span: int = SPAN, surge: int = SURGE) -> str:
    """The page's main text, its blocks joined by one line end; empty for a null or empty page, or one without text outside links."""
    lines = lines_of(page or "")
    weights, kept = weights_of(lines, surge), []
    parts = [[k for k, _ in part] for _, part in groupby(enumerate(lines), key=lambda x: x[1].main)]
    marked = any(x.main and x.text for x in lines)
    peak = max((max(sums_of([weights[k] for k in part], span)) for part in parts), default=0)
    if peak:
        for part in parts:
            for first, last in runs_of([weights[k] for k in part], min(surge, peak), span):
                if not marked:
                    first, last = with_linked_ends([lines[k] for k in part], first, last)
                kept += [lines[k].text for k in part[first : last + 1] if lines[k].text]
    return "\n".join(kept)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` plus the main text of every page's whole html."""
    small_batches(pages.sparkSession)

    def main_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return pages.withColumn(text, F.pandas_udf(main_texts, "string")(F.col(html)))


def op5_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
