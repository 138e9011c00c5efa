"""Text expressions: cleaning of lines and paragraphs, predicates, and quality metrics.

All are built-in functions and stay in the JVM, except NFKC, which Spark lacks, and
language detectors written in Python.
Patterns are Java's; ``(?U)`` makes classes follow Unicode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

# What decides which lines, characters and words count.
WHITE = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
PAGE_NUMBER = r"(?iU)^\s*(?:page\s+)?[\-–—]?\s*\d{1,4}\s*(?:of\s*\d{1,4})?\s*[\-–—]?\s*$"
ROMAN = r"(?i)^\s*[ivxlcdm]{1,6}\s*$"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
MARKUP_BLOCK = r"(?is)<(script|style|svg)\b[^>]*>.*?</\1>"
TAG = r"</?[a-zA-Z][a-zA-Z0-9:_-]*(?:\s+[^<>]*)?/?>"
XML_DECLARATION = r"(?i)<\?xml[^>]*\?>"
ENTITY = r"&(?:amp|lt|gt|quot|apos|nbsp|#\d+|#x[0-9a-fA-F]+);"
MARKUP_WORD = r"(?iU)^\s*(?:svg|html|xml)\s*$"
BOILERPLATE = (
    r"(?iU)^\s*(cookie policy|accept cookies|we use cookies|all rights reserved|click here|"
    r"share (this|on) (facebook|twitter|linkedin|reddit)?|subscribe to our newsletter|"
    r"terms of (service|use)|privacy policy|skip to (main )?content|"
    r"javascript:void\(0\)|advertisement|sponsored content|read more|back to top|"
    r"sign up|log in|menu|navigation)\s*$"
)
BARE_URL = r"(?iU)^\s*(?:https?://|www\.)\S+\s*$"
URL = r"https?://\S+|www\.\S+"
DOI = r"\b10\.\d{4,9}/\S+"
CITATION = (
    r"(?iU)\b(ibid\.?|op\.?\s*cit\.?|cf\.|et\s+al\.?|vol\.?\s*\d*|no\.?\s*\d+|"
    r"pp?\.?\s*\d|chap(?:ter)?\.?\s*\d*|fig\.?\s*\d*|footnote|see also|doi:|isbn)\b"
)
PAGE_REFERENCE = r"(?iU)\bp{1,2}\.?\s*\d{1,4}(?:[-–]\d{1,4})?\b"
NON_LATIN = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}"
    r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{0590}-\x{05FF}\x{0400}-\x{04FF}\x{0900}-\x{097F}\x{0E00}-\x{0E7F}"
)
USUAL = r"[a-zA-Z0-9\s\x1c-\x1f.,;:!?'\"()\-$%/&]"
UNUSUAL = r"(?U)[^\p{L}\p{N}\s\x1c-\x1f.,;:!?'\"()\-–—…$%/&]"
STOPWORDS = """
the a an and or but if of to in on for with as by at from is are was were
be been being this that these those it its he she they we you i his her
their our your not no do does did have has had will would can could should
may might must than then so such which who whom what when where why how
also into about between because after before while during each other some
any all most more less much many one two first second new used using use
between over under out up down near own such only just very both same
""".split()


#: All white space, character by character, as WHITE has it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


#: Other white space than single spaces, and a little more, in few ranges that Java compares fast.
ODD_WHITE = r"[\x00-\x1f\x7f-\xa0\x{1680}-\x{200a}\x{2028}-\x{205f}\x{3000}]"
#: Other line ends than line feeds, and what ``drop_garbage`` drops.
ODD_SIGNS = r"[\x00-\x08\x0b-\x1f\x7f-\x85\x{2028}-\x{2029}\x{fffd}]"


def holds(text: Column, *signs: str) -> Column:
    """Whether one of the signs is in the text: no pattern, so what gates a pattern costs little."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(s)) for s in signs))


def changed(text: Column, step: Callable[[Column], Column], *signs: str) -> Column:
    """``step(text)``, which does nothing without one of the signs; the text is read more than once, so it is a plain column."""
    return F.when(holds(text, *signs), step(text)).otherwise(text)


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def odd_white(text: Column) -> Column:
    """False for texts without other white space than spaces; true for a few of those as well."""
    return F.when(is_ascii(text), holds(text, *"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")).otherwise(text.rlike(ODD_WHITE))


def strip(text: Column) -> Column:
    """Without white space at either end, of any kind; only the ends are looked at."""
    return F.btrim(text, F.lit(SPACES))


def spaced(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)[{WHITE}&&[^ ]]", " ")


def split_words(text: Column, spaces: Callable[[Column], Column] = spaced) -> Column:
    # At single spaces Spark splits without a pattern.
    return F.array_remove(F.split(spaces(text), " "), "")


def lower_letters(text: Column) -> Column:
    """The text's ASCII letters, in lower case, and its white space."""
    return F.lower(F.regexp_replace(text, rf"(?U)[^A-Za-z{WHITE[1:]}+", ""))


def split_letters(text: Column) -> Column:
    """The ASCII letters of each word that has any, in lower case."""
    return split_words(lower_letters(text))


def _matches(text: Column, *patterns: str) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def keep_lines(text: Column, *drop: str, ends: Column | str = LINE_END) -> Column:
    """The text without lines that match a pattern; line ends become line feeds."""
    return F.array_join(F.filter(F.split(text, ends), lambda x: ~_matches(x, *drop)), "\n")


def strip_page_numbers(text: Column) -> Column:
    return keep_lines(text, PAGE_NUMBER, ROMAN)


def contains_markup(text: Column) -> Column:
    return text.rlike(TAG)


def strip_tags(text: Column) -> Column:
    """Blocks, declarations, tags and known entities become a space each."""
    for pattern in (MARKUP_BLOCK, XML_DECLARATION, TAG, ENTITY):
        text = F.regexp_replace(text, pattern, " ")
    return text


def strip_markup(text: Column) -> Column:
    """``strip_tags``, and lines that only say svg, html or xml go."""
    return keep_lines(strip_tags(text), MARKUP_WORD)


def strip_web_lines(text: Column) -> Column:
    return keep_lines(text, BOILERPLATE, BARE_URL)


def strip_markup_and_web_lines(text: Column, ends: Column | str = LINE_END) -> Column:
    """``strip_markup`` and then ``strip_web_lines``, by one cut into lines at ``ends``; ``text`` is a plain column."""
    return keep_lines(changed(text, strip_tags, "<", "&"), MARKUP_WORD, BOILERPLATE, BARE_URL, ends=ends)


def drop_garbage(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, CONTROL, ""), F.lit("�"), F.lit(""))


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")


def _solid(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def reflow(text: Column, ends: str = LINE_END) -> Column:
    """Lines of a paragraph joined by a space; blank lines stay between paragraphs."""
    blocks = F.transform(F.split(text, r"(?U)\n\s*\n"), lambda b: F.array_join(_solid(F.split(b, ends)), " "))
    return F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n")


def collapse(text: Column) -> Column:
    return apart(one_space(text))


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]{2,}|\t", " ")


def apart(text: Column) -> Column:
    # Of more line feeds than two what is left goes with a paragraph's ends.
    return F.array_join(_solid(F.split(text, "\n\n")), "\n\n")


#: Characters that composition leaves as they are and that never compose with each other.
STABLE = r"\x00-\x7f\u00c0-\u00ff\u2013\u2014\u2018\u2019\u201c\u201d"
#: Any other: a negated class of these ranges takes Java ten times as long on plain text.
UNSTABLE = rf"[\x{{80}}-\x{{10FFFF}}&&[^{STABLE}]]"


@F.pandas_udf(StringType())
def _nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition, by an Arrow function; of texts that it cannot change only a null goes there."""
    return F.coalesce(_nfkc(F.when(~is_ascii(text) & text.rlike(UNSTABLE), text)), text)


def paragraphs(text: Column) -> Column:
    return _solid(F.split(text, "\n\n"))


def count_of(text: Column, cls: str) -> Column:
    """How many characters are of a class; runs of them are taken out at once."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{cls}+", ""))


def count_unusual(text: Column) -> Column:
    """How many characters prose seldom has; ASCII's usual ones are taken out before, by a class that Java looks up in bits."""
    return count_of(F.regexp_replace(text, f"{USUAL}+", ""), UNUSUAL)


def non_latin_ratio(text: Column) -> Column:
    """Letters of other scripts among all letters; texts without any are only looked through."""
    ratio = count_of(text, rf"[\p{{L}}&&[{NON_LATIN}]]") / F.greatest(count_of(text, r"\p{L}"), F.lit(1))
    return F.when(text.rlike(rf"[\x{{0400}}-\x{{FAFF}}&&[{NON_LATIN}]]"), ratio).otherwise(0.0)


#: What a language detector may be: a function from a text column to a map of languages' shares, null where it fails.
Detector = Callable[[Column], Column]


def english_probability(text: Column, detector: Detector | None = None) -> Column:
    """1 for short texts, 0 where over a quarter of the letters are of other scripts, else what the detector says.

    Without a detector that is 1.  A detector's share of ``en`` counts; where English is
    not among its languages the value is 0.05, and where it fails 0.5.
    """
    rest = F.lit(1.0)
    if detector is not None:
        judged = detector(strip(text))
        rest = F.when(judged.isNull(), 0.5).otherwise(F.coalesce(judged["en"].cast("double"), F.lit(0.05)))
    return F.when(F.coalesce(F.length(strip(text)), F.lit(0)) < 20, 1.0).when(non_latin_ratio(strip(text)) > 0.25, 0.0).otherwise(rest)


def python_detector(shares_of: Callable[[str], dict[str, float]]) -> Detector:
    """A detector from a function of one text; an error of the function is a failure of the text, not of the job."""

    @F.pandas_udf(MapType(StringType(), DoubleType()))
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for text in part:
                try:
                    out.append(None if text is None else shares_of(text))
                except Exception:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return judged


def citation_hits(text: Column) -> Column:
    """Citation marks of all kinds; words that none begins with are told by their first letter."""
    marks = CITATION.replace(r"\b(", r"\b(?=[cdefinopsv])(", 1)
    return F.regexp_count(text, F.lit(marks)) + F.regexp_count(text, F.lit(PAGE_REFERENCE)) + F.regexp_count(text, F.lit(DOI))


def letters(word: Column) -> Column:
    """A word's ASCII letters."""
    return F.regexp_replace(word, "[^A-Za-z]", "")


def is_broken(letters: Column) -> Column:
    """Whether a word of these letters is long and has no vowel, six others in a row, or very many letters."""
    return (F.length(letters) >= 8) & (~letters.rlike("[aeiouAEIOU]") | letters.rlike(r"[^aeiouAEIOU]{6,}") | (F.length(letters) > 22))


def is_broken_word(word: Column) -> Column:
    return is_broken(letters(word))


def normalized(text: Column) -> Column:
    """The key of exact duplicates; ``text`` is a plain column."""
    lowered = F.lower(strip(text))
    return F.when(odd_white(text) | holds(text, "  "), F.regexp_replace(lowered, rf"(?U)[{WHITE}&&[^ ]]{WHITE}*| {WHITE}+", " ")).otherwise(lowered)
