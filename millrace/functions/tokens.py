"""Byte-pair tokens: a counter for chunks, counts as a column, and the coder behind both."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The vocabulary file that chunks are counted by, among the installed public ones; a path is taken as it is.
VOCABULARY = "byte_bpe_50k.json"
_loaded: dict = {}
_sized: dict = {}
#: Characters that are encoded at once, of one text at least: the coder holds some hundred bytes a token until it returns.
PIECE = 1 << 18


def tokenizer(path: str = VOCABULARY):
    """This process's tokenizer of a vocabulary file, loaded once."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        where = path
        if not os.path.isabs(path):
            import public_tokenizers

            where = public_tokenizers.path(path)
        _loaded[path] = Tokenizer.from_file(where)
    return _loaded[path]


def sliced(texts: list[str], limit: int = PIECE) -> Iterator[list[str]]:
    """The texts in their order, in lists of so many characters, or of one longer text."""
    some, held = [], 0
    for text in texts:
        if some and held + len(text) > limit:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text)
    if some:
        yield some


class WordSizes(dict):
    """How many ids a word has behind a space, or, as a key after a line feed, where a text opens; found when it is first asked for.

    Words of more than LONG characters are not kept, and of MOST words none is kept longer.
    Latin letters are one part to the coder and the signs after them another, so such a word goes to the model as it is.
    """

    LONG, MOST, ENDS = 64, 1 << 19, ".,;:!?"
    #: Bytes as a byte-level coder writes them, where it doesn't write Latin-1's sign.
    BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}

    def __init__(self, coder):
        self.coder, self.model = coder, coder.model
        self.added = tuple(t.content for t in coder.get_added_tokens_decoder().values())
        self.blank_line = self._size("\n\na") - self._size("a")

    @classmethod
    def of(cls, coder) -> WordSizes | None:
        """None unless a text's ids are those of its words: a byte-level coder that changes nothing before it cuts a text before white space."""
        cut = getattr(coder, "pre_tokenizer", None)
        if type(cut).__name__ != "ByteLevel" or not cut.use_regex or cut.add_prefix_space or coder.normalizer or coder.truncation or coder.padding:
            return None
        odd = (t.lstrip or t.rstrip or t.single_word or t.content.split() != [t.content] or t.content.rstrip(cls.ENDS).isalpha() for t in coder.get_added_tokens_decoder().values())
        return None if any(odd) else cls(coder)

    def _size(self, text: str) -> int:
        return len(self.coder.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> int:
        if word[0] == "\n":
            n = self._size(word[1:])
        elif (letters := word.rstrip(self.ENDS)).isalpha() and max(letters) < "\u0250":
            n = len(self.model.tokenize("\u0120" + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.BYTES))))
            n += self["\n" + word[len(letters) :]] if letters != word else 0
        else:
            n = self._size(f" {word}")
        if len(word) <= self.LONG:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = n
        return n

    def total(self, text: str) -> int | None:
        """The ids of words with a space between them, in paragraphs with a blank line between them; None where other white space stands."""
        n = -self.blank_line
        for k, paragraph in enumerate(text.split("\n\n")):
            words = paragraph.split()
            opened = (joined := " ".join(words)) == paragraph
            # Of a blank line before a special token the two line feeds are one part.
            if not words or k and paragraph.startswith(self.added) or not opened and (k or f" {joined}" != paragraph):
                return None
            n += self.blank_line + sum(map(self.__getitem__, words)) + (self["\n" + words[0]] - self[words[0]] if opened else 0)
        return n


def word_sizes(path: str = VOCABULARY) -> WordSizes | None:
    """This process's sizes of words by a vocabulary file, which its next tasks use again."""
    if path not in _sized:
        _sized[path] = WordSizes.of(tokenizer(path))
    return _sized[path]


def sizes(coder, texts: list[str], words: WordSizes | None = None) -> list[int]:
    """How many ids each text has; only what ``words`` can't add up is encoded."""
    found = [None if words is None else words.total(t) for t in texts]
    rest = [t for t, n in zip(texts, found) if n is None]
    more = (len(e.ids) for some in sliced(rest) for e in coder.encode_batch_fast(some, add_special_tokens=False))
    return [next(more) if n is None else n for n in found]


class BytePairTokens:
    """Encodes and decodes by a vocabulary file; names of special tokens in a text are special."""

    #: A space before a word belongs to it, and what stands before the space is encoded apart.
    ends_at_spaces = True
    words: WordSizes | None = None

    def __init__(self, path: str = VOCABULARY):
        self.coder = tokenizer(path)
        self.words = word_sizes(path)

    @property
    def blank_line(self) -> int | None:
        """What a blank line between two texts adds; None where that isn't known."""
        return None if self.words is None else self.words.blank_line

    @property
    def added(self) -> tuple[str, ...]:
        return self.words.added

    def counts(self, texts: list[str]) -> list[int]:
        return sizes(self.coder, texts, self.words)

    def encode(self, text: str) -> list[int]:
        return self.coder.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.coder.decode(ids, skip_special_tokens=False)


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """How many tokens a text has; 0 for a blank one, null for null."""

    @F.pandas_udf(LongType())
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = tokenizer(path)
        words = word_sizes(path)
        for part in parts:
            full = part.fillna("").map(lambda t: t if t.strip() else "")
            yield pd.Series(sizes(coder, full.tolist(), words), dtype="Int64").where(part.notna().reset_index(drop=True))

    return counted(text)
