"""The text-preparation engine against hand-derived expectations and plain-Python models."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import tokens
from millrace.operators import chunking, cleaning, near_dedup, quality
from millrace.plans import pipeline, reports
from millrace.plans.queries import QUERIES
from millrace.sources import readers, writers


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", column(F.col("t")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


@pytest.mark.parametrize(
    ("step", "given", "want"),
    [
        (T.strip_page_numbers, "Page 3 of 9\nmix\n1999\ntext 4", "text 4"),
        (T.strip_markup, "a<b>c</b><script>x</script>&amp;&copy;\nsvg", "a c   &copy;"),
        (T.strip_web_lines, "Menu\nhttp://x.y\nthe menu\nshare on facebook", "the menu"),
        (T.dehyphenate, "exam-\nple - \nx", "example - \nx"),
        (T.reflow, "a\n b\n\n \nc\r\nd", "a b\n\nc d"),
        (T.collapse, "a \t b\n\n\n\n c ", "a b\n\nc"),
        (T.drop_garbage, "a\x00b�\tc", "ab\tc"),
        (T.nfkc, "ﬁn x", "fin x"),
        (T.normalized, " A\t\n B ", "a b"),
        (T.non_latin_ratio, "abЖ一", 0.5),
        (T.english_probability, "Ж" * 30, 0.0),
        (T.citation_hits, "p. 1 cf.Smith", 3),
    ],
)
def test_text_functions(spark, step, given, want):
    assert one(spark, step, given) == [want]


def test_broken_words(spark):
    assert one(spark, T.is_broken_word, "rhythms", "bcdfghjk", "a" * 23, "wonderful") == [False, True, True, False]


def test_repeated_lines_and_cleaning(spark):
    pages = [("d", i, f"HEAD\nbody {i} text\n{i}") for i in range(4)] + [("e", 0, "HEAD\nyes")]
    df = spark.createDataFrame(pages, "doc_id string, page_no int, text string")
    assert [tuple(r) for r in cleaning.repeated_lines(df).collect()] == [("d", "HEAD")]
    out = {r["doc_id"]: r for r in cleaning.clean(df).collect()}
    assert out["d"]["text"] == "\n\n".join(f"body {i} text" for i in range(4)) and out["e"]["text"] == "HEAD yes"
    assert out["d"]["warnings"] == ["Removed 1 repeated header/footer line(s)."]


def test_reasons_and_stats(spark):
    texts = ["The cat sat on the mat and it was happy there.", "<b>x</b>", "Ж" * 40, "cf.Smith et al", "### ### ### a b c d e", "word", "the CAT sat on the mat and it was happy there."]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "doc_id int, para_no int, text string")
    scored = quality.classify(quality.score(df))
    assert [r["reason"] for r in scored.orderBy("para_no").collect()] == ["kept", "markup", "non_english", "citation_fragment", "unusual_characters", "low_quality", "kept"]
    kept = quality.exact_dedup(scored.where("reason = 'kept'"), ["para_no"], ["doc_id"])
    s = quality.stats(scored, kept, ["doc_id"]).first()
    assert (s["original_paragraphs"], s["remaining_paragraphs"], s["duplicates_removed"], s["removed_low_quality"]) == (7, 1, 1, 2)
    assert s["original_paragraphs"] == s["remaining_paragraphs"] + s["removed_non_english"] + s["removed_markup"] + s["removed_citations"] + s["removed_low_quality"] + s["duplicates_removed"]


def test_near_dedup_is_greedy_band_by_band(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(reversed(words)), "!!!", "???"]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "doc_id int, para_no int, text string")
    got = sorted(r["para_no"] for r in near_dedup.near_dedup(df, ["doc_id"]).collect())
    prints = [near_dedup.simhash_of(t) % 2**64 for t in texts]
    alive = list(range(len(texts)))
    for k in range(4):
        leaders, rest = {}, []
        for i in alive:
            band = leaders.setdefault(prints[i] >> 16 * k & 0xFFFF, [])
            if not any((prints[i] ^ p).bit_count() <= 3 for p in band):
                band.append(prints[i])
                rest.append(i)
        alive = rest
    assert got == alive and prints[3] == prints[4] == 0


def test_corpus_stats_count_near_duplicates(spark, tmp_path):
    words = [f"{a}{b}" for a in ("the", "river", "stone", "garden", "winter") for b in ("", "s", "ly", "er", "ing", "ed", "un", "ful", "ness", "al")]
    long = [" ".join(["the", *words[k:], *words[:k], *reversed(words)]) for k in (0, 17)]
    near = [f"{long[0]} {x}" for x in words[:12]]
    texts = [*long, *near, long[1].upper(), "word", "The cat sat on the mat and it was happy there."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    # In plain Python: all but "word" pass the rules; exact copies, then near ones band by band.
    first = {}
    for t in texts:
        if t != "word":
            first.setdefault(t.lower(), t)
    alive = [(t, near_dedup.simhash_of(t) % 2**64) for t in first.values()]
    exact = len(texts) - 1 - len(alive)
    for k in range(4):
        left = []
        for t, p in alive:
            if not any(p >> 16 * k & 0xFFFF == q >> 16 * k & 0xFFFF and (p ^ q).bit_count() <= 3 for _, q in left):
                left.append((t, p))
        alive = left
    got = QUERIES["corpus_stats"](spark, str(tmp_path)).first()
    assert exact == 1 and len(alive) < len(first) and got["removed_low_quality"] == 1
    assert got["duplicates_removed"] == len(texts) - 1 - len(alive) and got["removed_paragraphs"] == len(texts) - len(alive)
    assert got["remaining_paragraphs"] == len(alive) and got["clean_chars"] == len("\n\n".join(t for t, _ in alive))
    assert got["original_paragraphs"] == len(texts) and got["original_chars"] == len("\n\n".join(texts))


def test_packing():
    text = "\n\n".join(" ".join(f"p{i}w{j}" for j in range(4)) for i in range(5))
    out = chunking.pack(text, 10, 4, 2)
    assert [n for _, n in out] == [8, 8, 8, 8] and out[1][0].startswith("p1w0")
    assert [n for _, n in chunking.pack(text, 10, 0, 5)] == [8, 12]
    assert [n for _, n in chunking.pack("a b c d e. f g h", 3, 0, 0)] == [3, 2, 3]
    assert chunking.pack(" ") == []
    with pytest.raises(ValueError):
        chunking.pack("x", 10, 10, 1)


def test_blocks_and_batches(spark):
    tokens = spark.createDataFrame([(0, i, i * 10) for i in range(5)], "s int, pos int, tok int")
    assert [(r["pos"], r["x"], r["y"]) for r in chunking.token_blocks(tokens, 3, ["s"]).orderBy("pos").collect()] == [(0, [0, 10, 20], [10, 20, 30]), (1, [10, 20, 30], [20, 30, 40])]
    out = chunking.batches(spark.range(100).toDF("k"), ["k"], 30).groupBy("batch_no").count().collect()
    assert sorted(tuple(r) for r in out) == [(0, 30), (1, 30), (2, 30)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\xff")
    (tmp_path / "sub" / "b.TXT").write_text(" ")
    (tmp_path / "c.bin").write_text("no")
    (tmp_path / "d.jsonl").write_text('{"text": "one"}\n\nbad{\n{"text": "", "content": "two"}\n{"x": 1}\n5\n')
    pages = {r["path"].rsplit("/", 1)[-1]: r for r in readers.read_pages(spark, [str(tmp_path)]).collect()}
    assert set(pages) == {"a.txt", "b.TXT"} and pages["a.txt"]["text"] == "x\ny�" and pages["b.TXT"]["warning"]
    with pytest.raises(ValueError):
        readers.discover(spark, [str(tmp_path / "c.bin")])
    rows = readers.read_corpus(spark, [str(tmp_path / "d.jsonl"), str(tmp_path / "a.txt")]).collect()
    assert sorted(r["text"] for r in rows)[:3] == ["5", "one", "two"] and len(rows) == 4
    with pytest.raises(ValueError):
        readers.read_table(spark.range(1), "text")
    chunks = spark.createDataFrame([("aé",), ("",)], "text string")
    writers.write_jsonl(chunks, str(tmp_path / "out"), single_file=True)
    lines = [line for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"text": "aé"}]
    with pytest.raises(RuntimeError):
        writers.write_jsonl(chunks.where("text = 'none'"), str(tmp_path / "none"))
    assert writers.dataset_name("", "a/b") == "a__b.jsonl"


def test_pipeline_and_model_size(spark):
    pages = spark.createDataFrame([("d", 0, "The cat sat on the mat and it was happy there.\n\nword"), ("e", 0, "x")], "path string, page_no int, text string")
    docs, errors = pipeline.process_pages(pages)
    got = {r["path"]: r for r in docs.collect()}
    assert got["d"]["text"].startswith("The cat") and got["d"]["removed_paragraphs"] == 1 and got["e"]["text"] == "" and errors.count() == 0
    chunks, manifest = pipeline.build(docs, "path", 20, 2, 2)
    m = manifest.first()
    # Byte-pair tokens: the eleven words and the full stop.
    assert (m["example_count"], m["total_estimated_tokens"], m["skipped_documents"]) == (1, 12, 1)
    sizes = pipeline.parameter_count(spark.createDataFrame([(50257, 1536, 34, 1024, True)], "vocab int, n_embd int, n_layer int, block int, tied boolean")).first()
    assert sizes["n_params"] == 1042042368 and sizes["shown"] == "1.04B"


def test_entry_point_imports():
    import __spark_entry__

    assert len(__spark_entry__.queries()) >= 10 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nfkc_gate_is_safe(spark):
    import re
    import unicodedata

    stable = re.compile(f"[{T.STABLE}]")
    some = [chr(c) for c in range(0x3000) if stable.match(chr(c))]
    assert all(unicodedata.normalize("NFKC", c) == c for c in some)
    assert unicodedata.normalize("NFKC", "".join(some)) == "".join(some)
    assert one(spark, T.nfkc, "plain", "déjà – vu", "ﬁn…", "e\u0301", None) == ["plain", "déjà – vu", "fin...", "é", None]


def test_language_detectors(spark):
    def shares(text):
        if "fails" in text:
            raise ValueError
        return {"en": 0.9} if "English" in text else {"fr": 1.0}

    texts = ["short", "This is English text, long enough.", "Ceci est du texte en langue autre.", "this one fails in the detector", "Ж" * 30, None]
    assert one(spark, lambda t: T.english_probability(t, T.python_detector(shares)), *texts) == [1.0, 0.9, 0.05, 0.5, 0.0, 1.0]


def test_near_dedup_against_the_plain_greedy_pass(spark):
    import random

    r = random.Random(3)
    base = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for _ in range(120):
        w = list(r.choice(base))
        for _ in range(r.randrange(3)):
            w[r.randrange(60)] = f"v{r.randrange(5)}"
        texts.append(" ".join(w))
    texts += ["!!!", "???", "", "one"]
    rows = [(i % 2, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, para_no int, text string").repartition(3)

    def greedy(rows):
        alive = [(i, near_dedup.simhash_of(t) % 2**64) for i, t in rows]
        for k in range(4):
            kept, bands = [], {}
            for i, p in alive:
                band = bands.setdefault(p >> 16 * k & 0xFFFF, [])
                if not any((p ^ q).bit_count() <= 3 for q in band):
                    band.append(p)
                    kept.append((i, p))
            alive = kept
        return [i for i, _ in alive]

    want = sorted(greedy([(i, t) for d, i, t in rows if d == 0]) + greedy([(i, t) for d, i, t in rows if d == 1]))
    assert sorted(r["para_no"] for r in near_dedup.near_dedup(df, ["doc_id"]).collect()) == want and 10 < len(want) < 110
    for bound in (0, 1000):
        got = near_dedup.near_dedup(df, [], ["para_no"], broadcast_rows=bound)
        assert sorted(r["para_no"] for r in got.collect()) == greedy([(i, t) for _, i, t in rows])
    # A bit is set only where more shingles have it than not.
    import hashlib

    hashes = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in ("a b c d", "b c d e")]
    assert near_dedup.simhash_of("a b c d E") % 2**64 == hashes[0] & hashes[1]


def test_exact_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 0, "A b"), (0, 5, "a  B "), (0, 7, "a b"), (2, 0, "c"), (3, 0, None), (4, 0, None)], "d int, p int, text string")
    for bound in (0, 10):
        assert sorted((r["d"], r["p"]) for r in quality.exact_dedup(df, ["d", "p"], broadcast_rows=bound).collect() if r["text"]) == [(0, 5), (2, 0)]
    assert sorted((r["d"], r["p"]) for r in quality.exact_dedup(df, ["d", "p"], ["d"]).collect() if r["text"]) == [(0, 5), (1, 0), (2, 0)]


def test_byte_pair_tokens_and_streams(spark):
    coder = tokens.BytePairTokens()
    assert coder.decode(coder.encode("Hello, world!")) == "Hello, world!" and len(coder.encode("hello")) == 1
    texts = ["One text.", "  Two\n\nlines ", "three", "", "été 12345"]
    assert one(spark, tokens.token_count, *texts, " \n", None) == [len(coder.encode(t)) for t in texts] + [0, None]
    for given in (texts, ["a b", "c. d", "Ef"] * 7, ["\n\n\nx", "y"]):
        df = spark.createDataFrame(list(enumerate(given)), "k int, text string").repartition(3)
        rows = chunking.token_stream(df, ["k"]).orderBy("start", "part", "number").collect()
        ids = [i for r in rows for i in r["ids"]]
        assert ids == coder.encode("\n".join(given)), given
        assert [r["start"] for r in rows] == [sum(len(q["ids"]) for q in rows[:k]) for k in range(len(rows))]
    stream = chunking.token_stream(spark.createDataFrame(list(enumerate(["a b c d e", "f g h i j k"])), "k int, text string"), ["k"])
    flat = coder.encode("a b c d e\nf g h i j k")
    for segment in (1, 3, 4096):
        got = [(r["pos"], r["x"], r["y"]) for r in chunking.stream_blocks(stream, 4, segment).orderBy("pos").collect()]
        assert got == [(p, flat[p : p + 4], flat[p + 1 : p + 5]) for p in range(len(flat) - 4)]
    with pytest.raises(ValueError):
        chunking.stream_blocks(stream, len(flat))
    # An oversized word is cut between tokens and decoded again.
    long = "antidisestablishmentarianism" * 8
    out = chunking.pack(long, 10, 0, 0, coder)
    assert "".join(t for t, _ in out) == long and all(n <= 11 for _, n in out)


def test_sources_by_path(spark, tmp_path):
    (tmp_path / "v1.2").mkdir()
    (tmp_path / "v1.2" / "a.b.txt").write_text("one")
    (tmp_path / "plain").write_text("no suffix")
    folder = str(tmp_path / "v1.2")
    assert [r["text"] for r in readers.read_pages(spark, [folder, f"{folder}/a.b.txt", folder]).collect()] == ["one"]
    assert readers.discover_pdf_files(spark, [folder]).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.discover(spark, [str(tmp_path / "missing.txt")])
    with pytest.raises(ValueError):
        readers.read_pages(spark, [str(tmp_path / "plain")])
    assert readers.read_context(spark, f"{folder}/a.b.txt") == "one"
    readers.register_extractor(".pages", lambda data: data.decode().split("|"))
    (tmp_path / "v1.2" / "c.PAGES").write_text("p1|p2")
    (tmp_path / "v1.2" / "d.pages").write_bytes(b"\xff\xfe")
    rows = readers.read_pages(spark, [folder]).collect()
    assert sorted((r["page_no"], r["text"]) for r in rows if r["path"].endswith("PAGES")) == [(0, "p1"), (1, "p2")]
    assert [bool(r["error"]) for r in rows if r["path"].endswith("d.pages")] == [True]
    with pytest.raises(RuntimeError):
        readers.read_context(spark, f"{folder}/d.pages")
    # Without their libraries, PDF and image files are rows with an error.
    (tmp_path / "v1.2" / "e.pdf").write_bytes(b"%PDF-1.4")
    got = [r for r in readers.read_pages(spark, [f"{folder}/e.pdf"]).collect()]
    assert len(got) == 1 and got[0]["error"]
    del readers._EXTRACTORS[".pages"]
    assert {r["name"] for r in readers.presets(spark).collect()} >= {"Custom..."}
    assert [r["length"] for r in readers.list_datasets(spark, [folder]).collect()] == [3]


def test_runs_write_datasets_and_refuse_empty_ones(spark, tmp_path):
    good = "The cat sat on the mat and it was happy there with the dog."
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(f"{good}\n\nword\n\n{good}")
    (tmp_path / "in" / "b.txt").write_text("word")
    (tmp_path / "in" / "c.pdf").write_bytes(b"no")
    docs, errors = pipeline.process_sources(spark, [str(tmp_path / "in")], str(tmp_path / "txt"))
    got = {r["path"].rsplit("/", 1)[-1]: r for r in docs.collect()}
    assert set(got) == {"a.txt", "b.txt"} and got["a.txt"]["text"] == good and got["a.txt"]["duplicates_removed"] == 1
    assert got["a.txt"]["estimated_tokens"] == len(tokens.BytePairTokens().encode(good)) and errors.count() == 1
    assert got["a.txt"]["warnings"] == ["Quality filter removed 2 of 3 paragraph(s) (non-English: 0, markup: 0, citations: 0, low quality: 1, duplicates: 1)."]
    files = {f.parent.name: f.read_text() for f in (tmp_path / "txt").rglob("part-*.txt")}
    assert files == {"name=a.txt": good + "\n"}
    m = pipeline.build_dataset(docs, "path", str(tmp_path / "out"), "set", size=64, overlap=0, least=1).first()
    assert (m["example_count"], m["skipped_documents"], m["original_paragraphs"]) == (1, 1, 4) and m["jsonl_path"].endswith("out/set.jsonl") and m["sample_examples"] == [good]
    assert [json.loads(x)["text"] for f in (tmp_path / "out" / "set.jsonl").glob("part-*") for x in f.read_text().splitlines()] == [good]
    report = reports.document_report(docs).where("name = 'a.txt'").first()
    assert report["report"].startswith("Pages: 1\nCharacters: 59\nWords: 14\nEstimated tokens: 15\nWarnings: Quality") and "TXT saved to: a.txt" in report["report"] and report["preview"] == good
    assert reports.named_document(reports.document_report(docs), "b.txt").first()["report"].count("(not saved") == 1
    lines = [r["line"] for r in reports.status_lines(docs, errors).orderBy("part", "name", "line_no").collect()]
    assert lines[0] == "Processed 2 of 3 file(s):" and lines[1] == "  - a.txt: OK | pages=1 chars=59 words=14 est_tokens=15" and lines[2].startswith("      warning: Quality") and lines[3].startswith("  - b.txt: NO EXTRACTABLE TEXT") and lines[-1].startswith("  - c.pdf: ")
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate([good, good.upper(), "  ", None, f"{good} And more of it came."])], "id int, body string, text int")
    m = pipeline.table_to_dataset(table, "id", str(tmp_path / "out"), "a/b", "body", size=64, overlap=0, least=1).first()
    assert m["jsonl_path"].endswith("a__b.jsonl") and m["columns"] == ["id", "body", "text"] and m["duplicates_removed"] >= 1 and m["original_paragraphs"] == 3
    for wrong, kind in ((lambda: pipeline.build_dataset(docs.limit(0), "path", str(tmp_path), "x"), ValueError), (lambda: pipeline.build_dataset(docs, "path", str(tmp_path), " "), ValueError),
                        (lambda: pipeline.build_dataset(docs.where("text = ''"), "path", str(tmp_path), "x"), RuntimeError), (lambda: pipeline.table_to_dataset(table, "id", str(tmp_path), " ", "body"), ValueError),
                        (lambda: pipeline.table_to_dataset(table.where("id = 2"), "id", str(tmp_path), "x", "body"), RuntimeError), (lambda: pipeline.table_to_dataset(table.select("id", F.lit("word").alias("body")), "id", str(tmp_path), "x", "body"), RuntimeError),
                        (lambda: pipeline.table_to_dataset(table, "id", str(tmp_path), "x", "none"), ValueError), (lambda: pipeline.process_sources(spark, [str(tmp_path / "in" / "c.pdf")]), RuntimeError)):
        with pytest.raises(kind):
            wrong()


def test_reports_of_logs_and_files(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, 2.5), (2, 2, 2.25), (1, 3, 2.4)], "step int, logged int, loss double")
    assert sorted(tuple(r) for r in reports.loss_history(log).collect()) == [(1, 2.4, "Step 1 — loss 2.4000"), (2, 2.25, "Step 2 — loss 2.2500")]
    assert one(spark, reports.checkpoint_name, "my run/1", "default", "", "a.PT", None) == ["my_run_1.pt", None, None, "a.PT", None]
    (tmp_path / "b.pt").write_bytes(b"x" * 2**20)
    (tmp_path / "a.txt").write_bytes(b"x")
    assert [(r["length"], r["size_mb"]) for r in reports.list_files(spark, str(tmp_path), ".pt").collect()] == [(2**20, 1.0)]
    stats = spark.createDataFrame([(1234567, 10)], "original_chars long, clean_chars long").withColumns({c: F.lit(3) for c in pipeline.STATS[2:]})
    assert reports.with_stats_text(stats).first()["report"].startswith("Original characters: 1,234,567\nClean characters: 10\nOriginal paragraphs: 3\n")


def test_scores_of_a_stream(spark, tmp_path):
    from millrace.streaming.scoring import score_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("The cat sat on the mat and it was happy there.\nword\n")
    lines = spark.readStream.schema("value string").text(str(tmp_path / "in")).withColumnRenamed("value", "text")
    query = score_stream(lines).select("text", "reason").writeStream.format("memory").queryName("scored_lines").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(60)
    assert sorted(r["reason"] for r in spark.table("scored_lines").collect()) == ["kept", "low_quality"]
