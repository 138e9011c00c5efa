"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines, one a block of the page.  Lines that stand in menus,
headers, footers, sidebars, notices, adverts, forms or reader comments, by their
element or its class, id or role, weigh nothing; text of links weighs nothing
either.  Summed over a sliding window, the weights surge where the main text begins
and dive where it ends, and the lines between these points are kept.  Where a page
marks its article, that mark bounds the windows, and each line with text in it weighs
MARK more, so that a headline and short lines surge too; lists of links do not.  Where
the lines outside the marks hold more text, the marks are teasers and count for nothing.
Lines with text right before a surge, such as a headline, belong to what surges.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import only

#: Lines of a window, and the summed weight at which the main text surges.
WINDOW = 3
SURGE = 80
#: What a mark adds to a line with text: a window full of such lines surges.
MARK = -(-SURGE // WINDOW)

_BEGIN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>""")
#: A tag whose quotes are not closed.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_CLOSING = re.compile(r"</([a-zA-Z][^\s/>]*)\s*>")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav header footer aside form button dialog menu fieldset".split())
_LANDMARK = frozenset("article main".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar
    navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices alert popup modal overlay
    newsletter subscribe subscription signup share sharing social related recommended comment comments respond disqus
    discussion replies widget widgets toolbar pagination pager login search skip copyright legal gdpr complementary
    contentinfo navigation dialog""".split()
)
#: Names that no other word of a class takes back; with those of the other languages.
_ALWAYS = frozenset(
    """comment comments reply replies respond disqus sidebar cookie cookies consent gdpr footer nav navbar advert adverts
    advertisement advertising sponsor sponsored breadcrumb breadcrumbs fusszeile seitenleiste kommentar kommentare werbung
    anzeige brotkrumen commentaire commentaires publicite pied comentario comentarios publicidad anuncio anuncios pie""".split()
)
_KEEPERS = frozenset("article post entry content main body title headline story".split())
_WHITE = re.compile(r"\s+")


def _tokens(page: str, at: int, last: int, broken: list) -> tuple[int, int, re.Match | None, str]:
    """(where the next piece of markup begins and ends, its match if it is a tag, its text if it is CDATA); (-1, ...) if none follows.

    No place is read twice but for a constant number of times: where no '>' follows
    (``last`` is the last one) nothing is a tag, and once a tag's quotes turn out not to
    close before the end, ``broken`` holds and quotes count for nothing from there.
    """
    while (m := _BEGIN.search(page, at)) is not None:
        begin, what = m.start(), m[0]
        if what == "<!--":
            end = page.find("-->", m.end())
            return begin, (end + 3 if end >= 0 else len(page)), None, ""
        if what == "<![CDATA[":
            end = page.find("]]>", m.end())
            return begin, (end + 3 if end >= 0 else len(page)), None, page[m.end() : end if end >= 0 else None]
        if begin > last:
            break
        if what in ("<!", "<?"):
            return begin, page.find(">", begin) + 1, None, ""
        tag = None if broken else _TAG.match(page, begin)
        if tag is None:
            if not broken:
                broken.append(begin)
            tag = _LOOSE.match(page, begin)
        if tag is not None:
            return begin, tag.end(), tag, ""
        at = begin + 1
    return -1, -1, None, ""


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    if name in _DROPPED:
        return not (name == "header" and inside)
    if not attributes or name in _LANDMARK or name in ("body", "html"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role"):
            for one in value.split():
                words = [w for w in re.split(r"[^a-z]+", one) if w]
                # The last word says what it is, others what it belongs to: "main-menu", "post-share", but "menu-content".
                if set(words) & _ALWAYS:
                    return True
                if words and (words[-1] in _NAMES or set(words) & _NAMES and not set(words) & _KEEPERS):
                    return not (words[-1] == "header" and set(words) & _KEEPERS)
    return False


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, weight, unwanted, in the article) of each block."""
    out: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []
    links = at = depth = article = in_link = 0
    dropped = ""

    def close() -> None:
        nonlocal links
        if text:
            line = _WHITE.sub(" ", entities.unescape("".join(text))).strip()
            if line:
                out.append((line, max(0, len(line) - links), bool(dropped), article > 0))
            text.clear()
        links = 0

    def put(piece: str) -> None:
        nonlocal links
        if piece:
            text.append(piece)
            if in_link:
                links += len(piece)

    # Where each name is closed for the last time: what is left open needs no search.
    closed: dict[str, int] = {}
    for m in _CLOSING.finditer(page):
        closed[m[1].lower()] = m.start()
    last, broken = page.rfind(">"), []
    while (found := _tokens(page, at, last, broken))[0] >= 0:
        begin, end, m, data = found
        put(page[at:begin])
        at = end
        if m is None:
            put(data)
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in _RAW and not closing:
            close()
            whole = not m[3].endswith("/") and closed.get(name, -1) >= at
            if whole and (end := re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)):
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name not in _INLINE:
            close()
        if dropped:
            if name == dropped and name not in _VOID:
                depth += -1 if closing else 1
                if not depth:
                    dropped = ""
        elif name in _LANDMARK:
            article = max(0, article - 1) if closing else article + 1
        elif not closing and name not in _VOID and not m[3].endswith("/") and _unwanted(name, m[3], article > 0):
            # Left open, an element bounds nothing.
            if closed.get(name, -1) >= at:
                dropped, depth = name, 1
    tail = page[at:]
    put(tail if not re.match(r"<[a-zA-Z/!]", tail) else "")
    close()
    return out


def main_text(page: str) -> str:
    """The main text of one page; empty if it has none."""
    found = lines(page)
    weight = np.array([0 if bad else w for _, w, bad, _ in found], int)
    marked = np.array([mark for *_, mark in found], bool)
    if marked.any() and weight[marked].sum() >= weight[~marked].sum():
        found = [x for x in found if x[3]]
        weight = weight[marked] + MARK * (weight[marked] > 0)
    if not len(weight) or not weight.any():
        return ""
    sums = np.convolve(weight, np.ones(WINDOW, int))[WINDOW - 1 :]  # of each line and those after it
    behind = np.convolve(weight, np.ones(WINDOW, int))[: len(weight)]  # and of those before it
    level = min(SURGE, int(max(sums.max(), 1)))
    # Surges: a line with text whose window reaches the level; dives: where the windows on either side are empty.
    keep = np.zeros(len(weight), bool)
    inside = False
    for i in range(len(weight)):
        if not inside and weight[i] and sums[i] >= level:
            inside = True
            k = i - 1
            while k >= 0 and weight[k] and not keep[k]:
                keep[k], k = True, k - 1
        if inside and not sums[i] and not behind[i]:
            inside = False
        keep[i] = inside
    return " ".join(line for (line, _, bad, _), k in zip(found, keep) if k and not bad)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    ``pages`` has page_id, url and html; further columns are ignored, rows without a
    page_id dropped, repeated rows extracted each.  A null or empty html, and a page
    without text, gives an empty text.  n_chars counts code points.  A very long page is
    read whole, in time that grows with its length; rows that share a page_id come out
    each, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t) if t else "" for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
