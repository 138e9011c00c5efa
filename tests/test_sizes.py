"""What the engine's steps hold and how they are joined, however large their tables are."""

import random
import re
import unicodedata

import duckdb
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import tokens
from millrace.operators import chunking, cleaning, near_dedup, quality
from millrace.plans.queries import ORACLES, QUERIES
from millrace.sources import readers


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_keys_of_near_pairs_are_not_broadcast(spark):
    prints = spark.createDataFrame([(1, 0b1), (2, 0b11), (3, -1)], "doc_id long, _fp long")
    nodes = near_dedup.stored(prints.select("_fp", F.struct("doc_id").alias("_o")), "nodes")
    pairs = near_dedup._pairs(nodes, [], 3)
    assert "Broadcast" not in _plan(pairs)
    assert [(r["a"]["_a"], r["b"]["_a"]) for r in pairs.collect()] == [(1, 3)]


def test_plain_texts_are_looked_through_by_few_patterns(spark):
    plan = _plan(quality.score(cleaning.clean_text(spark.createDataFrame([("a",)], "text string"))))
    assert plan.count(f"RLIKE(text#") and f"[^{T.STABLE}]), " not in plan and T.UNSTABLE in plan
    lines = plan.split("ArrowEvalPython")[1]
    assert lines.count("split(") == 3  # lines once, paragraphs once, and the lines of a paragraph
    assert "transform(_words" not in plan and "regexp_replace(lambda" not in plan  # no pattern for each word


def test_metrics_of_odd_texts_follow_plain_python(spark):
    pool = ["the", "CAT", " ", "\n", "\x1c", "\x85", "\xa0", "\u2003", "ΟΔΟΣ", "ΣΑΣ.", "İst", "\u212a", "中文", "Жук", "é", "#", "~~", "€", "cf.", "p. 12", "ſee also", "rhythms", "Σ", "\u200b", "1", "²"]
    draw = random.Random(3)
    texts = ["", " \xa0", *("".join(draw.choice(pool) + draw.choice(["", " "]) for _ in range(draw.randint(1, 25))) for _ in range(400))]
    rows = quality.score(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    assert len(rows) == len(texts)
    white, usual = re.compile(r"[\s\x1c-\x1f]+"), set(".,;:!?'\"()-–—…$%/&")
    for r in rows:
        text = texts[r["i"]]
        words = [w for w in white.split(text) if w]
        alpha = [a for w in words if (a := re.sub("[^A-Za-z]", "", w))]
        odd = sum(not (c in usual or white.match(c) or unicodedata.category(c)[0] in "LN") for c in text)
        lowered = {w.lower() for w in words}
        assert (r["n_words"], r["n_alpha"]) == (len(words), len(alpha)), repr(text)
        assert r["unusual_char_ratio"] == odd / max(len(text), 1), repr(text)
        assert r["alphabetic_ratio"] == sum(unicodedata.category(c)[0] == "L" for c in text) / max(len(text), 1), repr(text)
        assert r["repeated_token_ratio"] == 1 - len(lowered) / max(len(words), 1), repr(text)
        assert r["stopword_ratio"] == (sum(a.lower() in T.STOPWORDS for a in alpha) / len(alpha) if alpha else 0), repr(text)


class Recorded:
    """A coder that notes how many characters it is given at once."""

    def __init__(self):
        self.most = 0

    def encode_batch_fast(self, texts, add_special_tokens=False):
        self.most = max(self.most, sum(map(len, texts)))
        return [type("E", (), {"ids": t.split()}) for t in texts]


def test_few_characters_are_encoded_at_once():
    coder, texts = tokens.BytePairTokens.__new__(tokens.BytePairTokens), ["a b " * 1000] * 300 + [""] + ["c " * tokens.PIECE]
    coder.coder = Recorded()
    assert coder.counts(texts) == [2000] * 300 + [0, tokens.PIECE]
    assert coder.coder.most == 2 * tokens.PIECE  # the one longer text, alone
    assert [len(s) for s in tokens.sliced(["x"] * 5, 2)] == [2, 2, 1] and list(tokens.sliced([])) == []


class Spaced(chunking.WhitespaceTokens):
    """Words, none of which reaches over a space; notes how many characters are counted."""

    ends_at_spaces, seen = True, 0

    def counts(self, texts):
        self.seen += sum(map(len, texts))
        return [len(t.split()) for t in texts]

    def encode(self, text):
        self.seen += len(text)
        return text.split()


def test_a_paragraph_is_encoded_once():
    text = " ".join(f"a{i} " + "b " * 8 + "c." for i in range(500))
    coder = Spaced()
    packed = chunking.pack(text, 100, 10, 5, coder)
    assert packed == chunking.pack(text, 100, 10, 5, chunking.WhitespaceTokens())
    assert coder.seen < 1.5 * len(text)
    assert chunking.pack("a b.  c d.\te", 3, 0, 0, Spaced()) == chunking.pack("a b.  c d.\te", 3, 0, 0)


def test_words_of_a_paragraph_are_counted_once(monkeypatch):
    seen = []

    class Text(str):
        def split(self, *a):
            seen.append(len(self))
            return str.split(self, *a)

    split = chunking.WhitespaceTokens.encode
    monkeypatch.setattr(chunking.WhitespaceTokens, "encode", lambda self, t: split(self, Text(t)))
    monkeypatch.setattr(chunking.WhitespaceTokens, "counts", lambda self, texts: [len(Text(t).split()) for t in texts], raising=False)
    text = " ".join(f"a{i} " + "b " * 8 + "c." for i in range(500))
    packed = chunking.pack(text, 100, 10, 5, chunking.WhitespaceTokens())
    assert packed == chunking.pack(text, 100, 10, 5, Spaced())
    assert packed[0] == (" ".join(text.split()[:100]), 100) and sum(seen) < 1.5 * len(text)


def test_blocks_are_cut_from_arrays_not_from_rows_of_tokens(spark):
    ids = list(range(100, 157))
    pieces = spark.createDataFrame([(0, ids[:3]), (3, []), (3, ids[3:40]), (40, ids[40:41]), (41, ids[41:])], "start long, ids array<int>")
    for block, segment in ((4, 8), (9, 4), (56, 8), (5, 100)):
        out = chunking.stream_blocks(pieces, block, segment)
        assert "posexplode" not in _plan(out)
        assert [(r["pos"], r["x"], r["y"]) for r in out.orderBy("pos").collect()] == [(i, ids[i : i + block], ids[i + 1 : i + 1 + block]) for i in range(57 - block)]


def test_rows_of_examples_are_chosen_before_they_are_scored(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "ab"[i % 2], f"t{i}") for i in range(20)], "doc_id int, lang string, text string")
    some = quality.first_rows(rows, ["lang"], ["doc_id"], 2)
    assert sorted(r["doc_id"] for r in some.collect()) == [0, 1, 2, 3, 4, 5]


def test_texts_without_a_trigram_have_no_language_as_in_sql(spark, tmp_path):
    rows = [(0, "es", "osra no ja de"), (1, "es", "osra la ja de"), (2, "en", "the cat sat on the mat"), (5, "en", " a\n"), (10, "en", None), (15, "en", "cat")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLES["languages_found"]).fetchall()
    assert sorted(map(tuple, QUERIES["languages_found"](spark, str(tmp_path)).collect())) == sorted(want) == [("en", "en", 1), ("es", "es", 1)]


def test_token_counts_are_added_up_from_words():
    coder = tokens.BytePairTokens()
    pool = ["the", "The", "naïve", "Straße.", "été,", "it's", "'s", "’s", "x1", "3.14", "...", "),", "—", "$%", "<|endoftext|>", "a<|endoftext|>b", "中文", "Жук", "é", "ẞ", "ŉ", "ª", "\xad", "᠎", "​", "\x1c", "\x85", "\xa0", "　", "\t", "\n", "\n\n", "  ", "a" * 70, "😀", "İ", "?!", "stat!?"]
    draw = random.Random(5)
    texts = ["", " ", "\n\n", " a", "a ", "a\n\n b", "a \n\nb", *("".join(draw.choice(pool) + draw.choice([" ", " ", " ", "", "\n\n"]) for _ in range(draw.randint(1, 30))) for _ in range(4000))]
    assert coder.counts(texts) == [len(coder.encode(t)) for t in texts] == coder.counts(texts)
    # A word that is known isn't encoded again; where the coder changes a text first, words don't add up.
    plain, coder.coder = ["the cat sat, the cat ran.\n\nthe dog", " the cat"] * 50, Recorded()
    want = [len(tokens.tokenizer().encode(t).ids) for t in plain]
    assert coder.counts(plain) == want and coder.coder.most == 0
    words = tokens.WordSizes(tokens.tokenizer())
    words.MOST = 3
    assert [words.total(t) for t in plain] == want and len(words) <= 3 and words.total("a" * 65) == len(tokens.tokenizer().encode("a" * 65).ids)
    assert tokens.WordSizes.of(Recorded()) is None


def test_sentences_end_where_the_pattern_with_a_look_back_says():
    draw = random.Random(8)
    for _ in range(2000):
        text = "".join(draw.choice("ab.!? \n\xa0") for _ in range(draw.randint(0, 25)))
        assert chunking._sentences(text) == re.split(r"(?<=[.!?])\s+", text)


def test_gates_of_patterns_change_nothing(spark):
    pool = ["the", "CAT.", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", " ", " ", " ", " ", " ", " ", "　", "�", "\x00", "-\n", "exam", "<b>", "</b>", "<", "&amp;", "&", "<!--", "svg", "menu", "www.a.example", "é", "ﬁ", "–", "İ", "中文", "​"]
    draw = random.Random(4)
    texts = [None, "", *("".join(draw.choice(pool) + draw.choice(["", "", " ", "\n"]) for _ in range(draw.randint(1, 14))) for _ in range(6000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    t = F.col("text")
    plain = T.collapse(T.nfkc(T.reflow(T.dehyphenate(T.drop_garbage(T.keep_lines(T.strip_tags(t), T.MARKUP_WORD, T.BOILERPLATE, T.BARE_URL))))))
    want = {r["i"]: r["x"] for r in rows.select("i", plain.alias("x")).collect()}
    got = cleaning.clean_text(rows).collect()
    assert len(got) == len(texts) and set(got[0].asDict()) == {"i", "text"}
    for r in got:
        assert r["text"] == want[r["i"]], repr(texts[r["i"]])
    key = F.regexp_replace(F.lower(T.strip(t)), rf"(?U)[{T.WHITE}&&[^ ]]{T.WHITE}*| {T.WHITE}+", " ")
    trimmed = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    assert rows.where(~T.normalized(t).eqNullSafe(key)).isEmpty() and rows.where(t.rlike(rf"(?U)[{T.WHITE}&&[^ ]]") & ~T.odd_white(t)).isEmpty()
    read = readers.read_table(rows.select("i", t.alias("body")), "body", ["i"])
    assert sorted((r["i"], r["text"]) for r in read.collect()) == sorted((r["i"], r["x"]) for r in rows.select("i", trimmed.alias("x")).where("x <> ''").collect())
    ordinary = spark.createDataFrame([("A plain text.\nIts second line.",)], "text string")
    assert ordinary.where(T.holds(t, "<", "&", "-\n", "  ", "\t") | t.rlike(T.ODD_SIGNS)).isEmpty() and ordinary.where(T.odd_white(F.replace(t, F.lit("\n"), F.lit(" ")))).isEmpty()


def test_tokens_of_a_chunk_are_those_of_its_parts(spark):
    coder = tokens.BytePairTokens()
    draw = random.Random(6)
    pool = ["the cat", "it's", " a", "b ", "été.", "<|endoftext|>", "<|endoftext|> c", "x<|endoftext|>", "\xa0d", "e\x1c", "3.14", "\n", "’s", "— f"]
    joined = [[draw.choice(pool) for _ in range(draw.randint(1, 6))] for _ in range(1500)] + [["a", "", "b"]]
    rows = [("\n\n".join(p), sum(coder.counts(p))) for p in joined]
    want = sum(coder.counts([t for t, _ in rows]))
    assert [n for (t, s), n in zip(rows, coder.counts([t for t, _ in rows])) if chunking._joined_size(t, s, coder) not in (None, n)] == []
    df = spark.createDataFrame([*rows, ("a b", None)], "text string, parts long")
    assert chunking.coded_sizes(df).agg(F.sum("n")).first()[0] == want + 2 == chunking.coded_sizes(df.select("text")).agg(F.sum("n")).first()[0]
    plain = [("the cat\n\nit's", sum(coder.counts(["the cat", "it's"])))] * 3
    assert [chunking._joined_size(t, n, coder) for t, n in plain] == coder.counts([t for t, _ in plain]) and chunking._joined_size("a", 1, Spaced()) == 1 and chunking._joined_size("a", 1, Recorded()) is None
