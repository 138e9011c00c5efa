"""Each stage of the corpus pipeline on its own input, and all of them against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from millrace.llm import pieces, quality_crf, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "The cat sat on the mat and looked at the river.\nIt was a fine day for all of them."
BAD = "BUY!! NOW!! $$$ ### CHEAP!!\n%%% *** $$$"


def table(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use themselves."""
    wide = [(i, t, "en", "s", None if t is None else len(t), f"c{k}", {"k": k}) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, score string, component_id map<string,int>").repartition(3)


def folder(spark, tmp_path, docs=None, labels=(), items=()):
    if docs is not None:
        docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_quality_stage(spark, tmp_path):
    rows = [(i, f"{BAD if i % 4 == 0 else GOOD} w{i}") for i in range(120)] + [(200, None), (201, ""), (202, GOOD), (202, GOOD), (None, GOOD)]
    docs = table(spark, rows)
    out = P.quality(spark, docs, folder(spark, tmp_path, labels=[(i, int(i % 4 != 0), 0) for i in range(120)]))
    assert out.schema == docs.schema
    assert sorted(r["doc_id"] for r in out.collect()) == [i for i in range(120) if i % 4] + [202, 202]
    assert P.quality(spark, docs.limit(0), str(tmp_path)).count() == 0


def shingles(text, width=5):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = WORD.findall((text or "").translate(fold))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def least(rows, width=5, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    out = {i: i for i in sets}
    ties = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = dict(out)
        for a, b in ties:
            out[a] = out[b] = min(out[a], out[b])
        if before == out:
            return out
    return out


def test_near_duplicates_stage(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    base = [list(rng.choice(words, n)) for n in (3, 30, 80, 200)]
    rows = [(10 * k, " ".join(b)) for k, b in enumerate(base)]
    rows += [(100 + k, " ".join(base[k % 4])) for k in range(8)] + [(200 + k, " ".join([*base[3][:k], "x", *base[3][k + 1 :]])) for k in range(0, 200, 20)]
    rows += [(900, None), (901, ""), (902, " \n")]
    docs = table(spark, [*rows, (None, "gone"), (10, "a smaller text")])
    out = P.near_duplicates(spark, docs, "")
    assert out.schema == docs.schema
    kept = {i for i, c in least(rows).items() if i == c}
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(got) == kept and out.count() == len(kept) and got[10] == max(dict(rows)[10], "a smaller text")
    assert P.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_decontamination_and_secret_stages(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(40))
    rows = [(1, f"before {item} after"), (2, "clean text of its own"), (3, None), (4, ""), (2, "clean text of its own"), (5, "token=abcdefgh12 " * 3)]
    docs = table(spark, rows)
    where = folder(spark, tmp_path, items=[(1, item), (2, None)])
    out = P.decontaminate(spark, docs, where)
    assert out.schema == docs.schema and sorted(r["doc_id"] for r in out.collect()) == [2, 2, 3, 4, 5]
    hidden = P.secrets(spark, out, where)
    got = {r["doc_id"]: r for r in hidden.collect()}
    assert hidden.columns == docs.columns and got[5]["text"] == "[SECRET] " * 3 and got[5]["n_chars"] == 27 and got[3]["text"] is None
    assert P.decontaminate(spark, docs.limit(0), where).count() == P.secrets(spark, docs.limit(0), where).count() == 0


def test_encoding_stage(spark):
    rows = [(1, "The cat"), (2, None), (3, ""), (1, "The cat"), (4, "x" * 100_000)]
    got = {r["doc_id"]: r for r in P.encode(spark, table(spark, rows), "").collect()}
    assert {i: r["decoded_sha256"] for i, r in got.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}
    assert got[2]["n_pieces"] == 0 and got[3]["ids_crc32"] == 0
    assert P.encode(spark, table(spark, rows).limit(0), "").count() == 0


def test_whole_pipeline_against_brute_force(spark):
    """All stages over sf0.001; the fitted field's scores are taken as they are."""
    sf = "/root/testdata/sf0.001"
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    good = {r["doc_id"] for r in quality_crf.quality(docs, labels).where("score >= 0.5").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    group = least(rows)
    first = [(i, t) for i, t in rows if group[i] == i]

    def grams(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    items = [Counter(grams(r["text"])) for r in bench.collect()]

    def leaks(text):
        g = grams(text)
        for own in items:
            n = own.total()
            if len(set(g) & set(own)) * 2 < n:
                continue
            for s in range(max(0, len(g) - n) + 1):
                w = Counter(g[s : s + n])
                if (w & own).total() >= 0.8 * (w | own).total():
                    return True
        return False

    want = {i: secrets.redact(t) for i, t in first if not leaks(t)}
    got = {r["doc_id"]: r for r in P.run(spark, sf).collect()}
    assert 0 < len(want) < len(first) < len(rows) < docs.count() and set(got) == set(want)
    m = pieces.model("piece_bpe_32k.model")
    for i, t in want.items():
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        ids = [x for w in pieces.words_of(t) for x in (m.fold(w) if w else m.spell(pieces.SPACE))]
        assert (got[i]["n_pieces"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_stages_are_named_in_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]
    assert P.ORACLE_SQL is None and list(P.queries()) == ["pipeline"] and P.oracle_sql() == {}
