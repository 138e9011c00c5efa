"""Secret scans: base patterns, and guess costs of values in a credential's context.

The cost of a value is the least sum, over all ways to cut it into spans, of the
decimal logarithms of the guesses that each span takes: a word of the dictionary (its
rank, its capitals and its substituted letters), a date, a repeated unit, a walk on the
keyboard, an alphabetic or numeric sequence, or brute force at a factor of ten a
character.  Walks, sequences and repeats are parts of three characters and more of such
stretches; of stretches longer than RUN the parts at their start or end.  Dynamic
programming over the end positions finds the least sum.  A value that takes at least ``least`` digits of guesses is reported as a secret.

Values that are addresses, calls, references or a few plain words are none, whatever they
cost.  Tokens of known issuers are costed without a name beside them, and blocks of
private keys count as they are.

The dictionary is the most common passwords, then the whole words of a public
vocabulary file by their ids; the file's name is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import only, spare

#: Least cost, in decimal digits of guesses, of a value that is reported.
LEAST = 10.0
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 32 and more is the same as a maximal run that is long enough.
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What names a credential.
_NAME = r"(?:pass(?:word|wort|wd|phrase|code)?|kennwort|mot[\x20_]de[\x20_]passe|contrase(?:ñ|n)a|clave|pwd|pin|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|auth(?:orization)?|credentials?|login)"
_VALUE = r"""["']?([^\s"'<>,;]{6,})"""
#: Such a name, alone or as a part of a longer one set off by a sign, before a value; wider than the base pattern.
_CONTEXT = re.compile(
    rf"""(?ai:(?<![a-z0-9_.-])(?:[a-z0-9.-]{{0,40}}[_.-])?{_NAME}(?:[_.-][a-z0-9_.-]{{0,40}})?)["']?[\x20\t]*(?:=>|[:=])[\x20\t]*(?:(?ai:bearer|basic|token)[\x20\t]+)?{_VALUE}"""
    rf"""|(?ai:(?<![a-z])bearer)[\x20\t]+{_VALUE}"""
)
#: Values that show what they are without a name: tokens of known issuers, and blocks of private keys.
_BARE = re.compile(r"(?<![A-Za-z0-9_-])((?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|npm_|hf_)[A-Za-z0-9_-]{16,})|-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[^-]|-(?!----END))*+(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?")
#: A superset of all of these for the JVM: other texts never go to Python.
_HINT = r"(?i)(pass|pwd|pin|secret|token|key|auth|credential|login|kennwort|contrase.a|clave)[a-z0-9_.-]*[\"']?[ \t]*[:=]|bearer[ \t]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|-----BEGIN |(gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|npm_|hf_)[a-z0-9_-]{16}"
#: Values that are something else: addresses, calls and references, markers.
_OTHER = re.compile(r"(?ai:[a-z][a-z0-9+.-]*://.*|[^@\s]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+\.?|[$%]?[({]+[^(){}]*[)}]*|[a-z_][\w.]*[(\[].*|-----begin.*)", re.S)
#: Words that an identifier is made of at most; more may be a passphrase.
_NAMED = 3

#: The vocabulary file whose words follow the passwords, and the longest stretch of which every part counts.
WORDS, RUN = "word_bpe_49k.json", 64
#: Common passwords and their parts by rank.
_WORDS = """password the love and you admin welcome monkey dragon master login
hello secret princess sunshine football baseball shadow superman letmein trust
michael jordan summer winter spring autumn test user root guest default change
changeme access server system pass word key token none null true false example
sample demo public private value string text your here insert enter placeholder
house water light night world money power green black white blue orange silver
happy freedom flower coffee computer internet network mobile phone office home
family friend brother sister mother father john david robert james mary london
paris berlin madrid monday tuesday friday sunday january march april june july
august october december correct horse battery staple""".split()
_LEET = str.maketrans("430157@$!", "aeoistasi")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_NEAR: dict[str, set[str]] = {}
for _r, _row in enumerate(_ROWS):
    for _c, _k in enumerate(_row):
        _NEAR[_k] = {_ROWS[a][b] for a, b in ((_r, _c - 1), (_r, _c + 1), (_r - 1, _c), (_r - 1, _c + 1), (_r + 1, _c - 1), (_r + 1, _c)) if 0 <= a < 4 and 0 <= b < len(_ROWS[a])}
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:[12]\d|3[01]|0?[1-9]))|(?:(?:[12]\d|3[01]|0?[1-9])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d)", re.A)
_YEAR = re.compile(r"(?:19|20)\d\d", re.A)


_ROWS_OF = {k: r for r, row in enumerate(_ROWS) for k in row}
_dictionaries: dict[str, tuple[dict[str, int], int]] = {}


def dictionary(path: str = WORDS) -> tuple[dict[str, int], int]:
    """Words of three letters and more with their ranks from 1, and the longest one's length."""
    if path not in _dictionaries:
        where = path
        if not os.path.isabs(path):
            import public_tokenizers

            where = public_tokenizers.path(path)
        with open(where, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        whole = [t[:-4] for t, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if t.endswith("</w>") and len(t) >= 7 and t[:-4].isascii() and t[:-4].isalpha()]
        rank = {w: i + 1 for i, w in reversed(list(enumerate(dict.fromkeys([*_WORDS, *whole]))))}
        _dictionaries[path] = rank, max(map(len, rank))
    return _dictionaries[path]


def _word_cost(own: str, rank: int, plain: str) -> float:
    lower = own.lower()
    capitals = 0.0 if own == lower else math.log10(2) if own[1:] == lower[1:] or own.isupper() else len(own) * math.log10(2)
    return math.log10(rank + 1) + capitals + (0.0 if plain == lower else math.log10(4))


def _turns(lower: str, s: int, e: int) -> int:
    return sum(_ROWS_OF[lower[k]] != _ROWS_OF[lower[k - 1]] for k in range(s + 1, e))


def _parts(lo: int, hi: int, least: int = 3) -> Iterator[tuple[int, int]]:
    """The parts of a stretch that count: all of ``least`` characters, or in one longer than RUN those at its start or end."""
    if hi - lo <= RUN:
        for s in range(lo, hi):
            for e in range(s + least, hi + 1):
                yield s, e
    else:
        for k in range(lo + least, hi + 1):
            yield lo, k
        for k in range(lo + 1, hi - least + 1):
            yield k, hi


def _stretches(n: int, goes_on) -> Iterator[tuple[int, int]]:
    """Maximal stretches in which each place goes on from the one before."""
    s = 0
    for i in range(1, n + 1):
        if i == n or not goes_on(i):
            yield s, i
            s = i


def _spans(value: str, path: str = WORDS) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of spans that may be easier than brute force."""
    ranks, longest = dictionary(path)
    n, lower = len(value), value.lower()
    if len(lower) != n:  # a letter whose lower case is longer: it is in no word
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = lower.translate(_LEET)
    for s in range(n):
        for e in range(s + 3, min(n, s + longest) + 1):
            if (rank := ranks.get(plain[s:e])) is not None:
                yield s, e, _word_cost(value[s:e], rank, plain[s:e])
        if value[s].isascii() and value[s].isdigit():
            if m := _DATE.match(value, s):
                yield s, m.end(), math.log10(365 * 100 if m.end() - s > 4 else 100)
            if _YEAR.match(value, s):
                yield s, s + 4, math.log10(100)
    for step in (1, -1):
        for lo, hi in _stretches(n, lambda i: value[i].isalnum() and value[i - 1].isalnum() and ord(value[i]) - ord(value[i - 1]) == step):
            for s, e in _parts(lo, hi):
                yield s, e, math.log10(26 * 2 * (e - s))
    for lo, hi in _stretches(n, lambda i: lower[i] in _NEAR.get(lower[i - 1], ())):
        for s, e in _parts(lo, hi):
            yield s, e, math.log10(47 * (e - s)) + _turns(lower, s, e) * math.log10(4.6)
    for unit in range(1, 9):
        for lo, hi in _stretches(max(0, n - unit), lambda i: value[i] == value[i + unit] and value[i - 1] == value[i - 1 + unit]):
            if value[lo] == value[lo + unit]:
                for s, e in _parts(lo, hi + unit, max(3, 2 * unit)):
                    yield s, e, unit + math.log10((e - s) / unit + 1)


def guess_cost(value: str, path: str = WORDS) -> float:
    """Decimal digits of guesses of the cheapest segmentation; linear in the value's length but for stretches up to RUN."""
    best, opening = [math.inf] * (len(value) + 1), [[] for _ in range(len(value) + 1)]
    for s, e, cost in _spans(value, path):
        opening[s].append((e, cost))
    best[0] = 0.0
    for s in range(len(value)):
        best[s + 1] = min(best[s + 1], best[s] + 1.0)
        for e, cost in opening[s]:
            best[e] = min(best[e], best[s] + cost)
    return best[-1]


def _wordlike(part: str, ranks: dict[str, int]) -> bool:
    """Whether letters are a word, short, or made of words for the most part."""
    return part in ranks or part.isalpha() and (len(part) <= 2 or part.removesuffix("s") in ranks or guess_cost(part) <= 0.7 * len(part))


def _plain(value: str, most: int = _NAMED, path: str = WORDS) -> bool:
    """Whether a value is an address, a call, a reference, or up to ``most`` words joined by signs."""
    if _OTHER.fullmatch(value):
        return True
    parts, ranks = re.split(r"[_.:/-]+", value.strip("_.:/-").lower()), dictionary(path)[0]
    return len(parts) <= most and all(_wordlike(p, ranks) for p in parts)


def find(text: str, least: float = LEAST) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: base ones, then values whose guesses are many and that no base span covers whole."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    base = list(out)
    for m in _CONTEXT.finditer(text):
        s, e = m.span(1) if m[1] is not None else m.span(2)
        if not any(a <= s and e <= b for _, a, b in base) and not _plain(text[s:e]) and guess_cost(text[s:e]) >= least:
            out.append(("guess", s, e))
    for m in _BARE.finditer(text):
        s, e = m.span()
        if not any(a <= s and e <= b for _, a, b in out) and (m[1] is None or guess_cost(m[1]) >= least and not _plain(m[1], len(m[1]))):
            out.append(("guess", s, e))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _hinted(docs: DataFrame) -> DataFrame:
    """Texts that may hold a secret; of the others only the id goes to Python."""
    return docs.select("doc_id", F.when(F.col("text").rlike(_HINT), F.col("text")).alias("text"))


def scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess) of every row.

    ``docs`` has doc_id and text; further columns are ignored, rows without a doc_id
    dropped, repeated rows scanned each.  A null or empty text has no spans: counts
    of 0, an empty ``spans`` and the digest of the empty string.  Spans are whole
    matches in code points, end exclusive, ordered by start, then kind, then end.  A very
    long text is scanned whole, in time that grows with its length.  An empty table gives
    an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = find(text, least) if text else []
                base = [s for s in spans if s[0] != "guess"]
                count = [sum(s[0] == k for s in spans) for k in KINDS]
                rows.append((*count[:3], hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), count[3]))
            columns = [list(c) for c in zip(*rows)] or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _hinted(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def redact(text: str, least: float = LEAST, mask: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, s, e in find(text, least):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with its secrets masked in ``text``; other rows and columns stay as they are, but n_chars follows the text."""
    name = spare(docs, "hint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            flag = batch.schema.get_field_index(name)
            hint = batch.column(flag).to_pylist()
            texts = batch.column(at)
            if any(hint):
                texts = pa.array([redact(t, least) if h else t for t, h in zip(texts.to_pylist(), hint)], texts.type)
            columns = [texts if i == at else c for i, c in enumerate(batch.columns) if i != flag]
            yield pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n != name])

    flagged = docs.withColumn(name, F.coalesce(F.col("text").rlike(_HINT), F.lit(False)))
    out = flagged.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
