"""Corpus-wide steps against plain passes: packing, ranks, near-duplicates in crowded bands, languages."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import language
from millrace.functions import text as T
from millrace.functions.tokens import BytePairTokens
from millrace.operators import block_store, chunking, epochs, near_dedup, packing, quality, ranks
from millrace.plans import pipeline, reports
from millrace.sources import readers, writers
from millrace.streaming.log import append_log, read_log

SF = "/root/testdata/sf0.001"


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranks_and_running_sums(spark, partitions):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i, rng.randrange(9)) for i in range(300)]
    for n in (1, 7):
        partitions(n)
        got = ranks.ranked(spark.createDataFrame(rows, "k int, i int, w int").repartition(3), ["k", "i"], "w").orderBy("_no").collect()
        at = 0
        for no, (want, row) in enumerate(zip(sorted(rows), got)):
            assert tuple(row) == (*want, no, at)
            at += want[2]
    assert ranks.ranked(spark.createDataFrame([], "k int"), ["k"]).collect() == []


@pytest.mark.parametrize(("size", "overlap", "least", "coder", "n", "spread"), [(10, 4, 3, chunking.WhitespaceTokens, 120, 1), (30, 0, 9, BytePairTokens, 40, 5), (25, 24, 25, chunking.WhitespaceTokens, 90, 16), (64, 20, 64, BytePairTokens, 1, 4)])
def test_a_corpus_is_packed_as_one_text(spark, partitions, size, overlap, least, coder, n, spread):
    rng = random.Random(size)
    paragraphs = [" ".join(f"w{rng.randrange(50)}" + rng.choice(["", "", "."]) for _ in range(rng.choice([1, 2, 3, 8, 20, 90]))) for _ in range(n)]
    paragraphs[len(paragraphs) // 2 :] += [" ", "", None, "antidisestablishmentarianism" * 9]
    want = chunking.pack("\n\n".join(p or "" for p in paragraphs), size, overlap, least, coder())
    partitions(spread)
    df = spark.createDataFrame(list(enumerate(paragraphs)), "k int, text string").withColumn("n", F.lit("x")).repartition(3)
    got = packing.chunk_corpus(df, ["k"], size, overlap, least, coder, span=64).orderBy("chunk_no").collect()
    assert [(r["chunk_no"], r["text"], r["token_count"]) for r in got] == [(i, *c) for i, c in enumerate(want)]


def test_packing_nothing(spark):
    assert packing.chunk_corpus(spark.createDataFrame([(1, " ")], "k int, text string"), ["k"]).collect() == []
    with pytest.raises(ValueError):
        packing.chunk_corpus(spark.createDataFrame([(1, "x")], "k int, text string"), ["k"], 10, 10)


def test_a_corpus_is_encoded_once(spark, tmp_path):
    log = str(tmp_path / "counted")

    class Told(chunking.WhitespaceTokens):
        ends_at_spaces = False

        def counts(self, texts):
            with open(log, "a") as out:
                out.writelines(f"{t}\n" for t in texts)
            return super().counts(texts)

    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "k int, text string").repartition(3)
    got = packing.chunk_corpus(df, ["k"], 10, 0, 0, Told).orderBy("chunk_no").collect()
    assert "\n\n".join(r["text"] for r in got).split("\n\n") == [f"text {i}" for i in range(40)]
    assert sorted(open(log).read().split("\n")[:-1]) == sorted(f"text {i}" for i in range(40))


def test_a_table_gives_the_same_dataset_for_any_partitions(spark, partitions, tmp_path):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for n in (1, 4, 16):
        partitions(n)
        m = pipeline.table_to_dataset(docs, "doc_id", str(tmp_path), f"s{n}", max_rows=None, size=128, overlap=20, least=16, make_coder=chunking.WhitespaceTokens).first().asDict(recursive=True)
        lines = sorted(r["value"] for r in spark.read.text(m.pop("jsonl_path")).collect())
        found.append((m, zlib.crc32("\n".join(lines).encode()), len(lines)))
        assert m["example_count"] == len(lines) and m["total_chars"] == m["clean_chars"] and len(m["quality_examples"]) == 60 and len(m["sample_examples"]) == 5
    assert found[0] == found[1] == found[2]


def greedy(prints):
    """Places that stay, band by band."""
    alive = list(enumerate(prints))
    for k in range(4):
        kept, bands = [], {}
        for i, p in alive:
            band = bands.setdefault(p >> 16 * k & 0xFFFF, [])
            if not any((p ^ q).bit_count() <= 3 for q in band):
                band.append(p)
                kept.append((i, p))
        alive = kept
    return [i for i, _ in alive]


def test_near_duplicates_of_one_crowded_band(spark, monkeypatch):
    """Fingerprints that all share a band: chains, balls and strangers."""
    rng = random.Random(5)
    band = 0xABCD << 16
    prints = [band | rng.getrandbits(64) & ~(0xFFFF << 16) for _ in range(400)]
    for p in prints[:40]:
        for _ in range(12):
            p ^= sum(1 << b for b in rng.sample([*range(16), *range(32, 64)], rng.randint(0, 3)))
            prints.append(p)
    rng.shuffle(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    monkeypatch.setattr(near_dedup, "simhash", lambda column, digest: column.cast("long"))
    df = spark.createDataFrame([(0, i, str(p)) for i, p in enumerate(signed)], "d int, i int, text string").repartition(3)
    for scope in ([], ["d"]):
        got = sorted(r["i"] for r in near_dedup.near_dedup(df, scope, ["i"]).collect())
        assert got == greedy(prints) and len(got) < len(prints)
    assert near_dedup.near_dedup(df.limit(0), [], ["i"]).collect() == []


def test_language_profiles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = docs.where("doc_id % 5 <> 0")
    profiles = language.train(learned)
    assert profiles.languages == ("de", "en", "es", "fr")
    # Counts in plain Python.
    texts = [r["text"].strip(T.SPACES) for r in learned.where("lang = 'de'").collect()]
    counts = np.zeros(language.BUCKETS)
    for t in texts:
        c = [ord(x.lower()) if x.isascii() else ord(x) for x in t]
        for a, b, d in zip(c, c[1:], c[2:]):
            counts[(a * 10007 + b * 101 + d) % language.BUCKETS] += 1
    assert np.allclose(profiles.logs[0], np.log((counts + 1) / (counts.sum() + language.BUCKETS)))
    held_out = docs.where("doc_id % 5 = 0 and length(text) >= 20").select("lang", language.identified(F.col("text"), profiles).alias("found")).collect()
    assert np.mean([r["lang"] == r["found"] for r in held_out]) >= 0.95
    # Pieces of a long text, nulls and short texts.
    text = "the river and the stone " * 40
    whole = language.shares(profiles, text)
    language.PIECE, before = 7, language.PIECE
    try:
        assert np.allclose(language.shares(profiles, text), whole)
    finally:
        language.PIECE = before
    rows = spark.createDataFrame([(0, None), (1, "ab"), (2, text)], "i int, text string").select("i", T.english_probability(F.col("text"), language.profile_detector(profiles)).alias("p"), language.identified(F.col("text"), profiles).alias("l"))
    assert [(r["p"], r["l"]) for r in rows.orderBy("i").collect()][:2] == [(1.0, None), (1.0, None)]
    with pytest.raises(ValueError):
        language.train(learned.limit(0))


def test_languages_decide_in_filters(spark):
    profiles = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    german = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'de' and n_chars > 200").select("doc_id", F.lit(0).alias("para_no"), "text").limit(3)
    reasons = {r["reason"] for r in quality.classify(quality.score(german, detector=language.profile_detector(profiles))).collect()}
    assert reasons == {"non_english"}


def test_token_streams_over_white_space(spark, partitions):
    coder, rng = BytePairTokens(), random.Random(1)
    for c in chunking.WHITE:  # before white space the tokenizer always splits
        for before in ("a", "!", "1", "'s"):
            assert coder.encode(f"{before}{c} b") == coder.encode(before) + coder.encode(f"{c} b")
    signs = ["a", "b", " ", "\n", "\t", "!", "'s", "\x1c", "\x85", "1", "é", " ", "\x0b", "<|endoftext|>"]
    cases = [["".join(rng.choices(signs, k=rng.choice([0, 1, 2, 5, 9]))) for _ in range(n)] for n in (1, 40)]
    cases += [["", " ", ""], [""], ["", "x", " ", "", "\n ", "", "y ", " "], [" \n"] * 12 + ["z"]]
    for texts, n in zip(cases, (1, 5, 4, 2, 11, 7)):
        partitions(n)
        rows = chunking.token_stream(spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, text string"), ["k"]).orderBy("start", "part", "number").collect()
        assert [i for r in rows for i in r["ids"]] == coder.encode("\n".join(texts)), texts
        assert [r["start"] for r in rows] == [sum(len(q["ids"]) for q in rows[:k]) for k in range(len(rows))]
    assert chunking.token_stream(spark.createDataFrame([], "k int, text string"), ["k"]).collect() == []


def test_empty_long_and_unreadable_files(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "empty.txt").write_bytes(b"")
    (tmp_path / "sub dir" / "none.pdf").write_bytes(b"")
    (tmp_path / "good.TXT").write_text("fine")
    (tmp_path / "long.txt").write_text("x" * 1000)
    (tmp_path / "other.bin").write_text("y" * 500)
    (tmp_path / "torn.txt").write_text("torn")
    (tmp_path / ".torn.txt.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x01\x02\x03\x04")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in readers.read_pages(spark, [str(tmp_path)], most=600).collect()}
    assert set(got) == {"empty.txt", "none.pdf", "good.TXT", "long.txt", "torn.txt"}
    assert (got["empty.txt"]["page_no"], got["empty.txt"]["text"], got["empty.txt"]["error"]) == (0, "", None) and got["empty.txt"]["warning"] == readers.NO_TEXT
    assert got["good.TXT"]["text"] == "fine" and got["none.pdf"]["error"] and "1000" in got["long.txt"]["error"] and got["torn.txt"]["error"]
    assert sorted((r["path"].rsplit("/", 1)[-1], r["length"]) for r in readers.discover(spark, [str(tmp_path)]).collect()) == [("empty.txt", 0), ("good.TXT", 4), ("long.txt", 1000), ("none.pdf", 0), ("torn.txt", 4)]
    assert readers.read_context(spark, str(tmp_path / "sub dir" / "empty.txt")) == ""
    docs, errors = pipeline.process_sources(spark, [str(tmp_path / "sub dir"), str(tmp_path / "good.TXT")])
    assert docs.where("path like '%empty.txt'").first()["text"] == "" and errors.count() == 1
    # Files without an extractor are not even opened.
    read = readers._files(spark, [str(tmp_path)])
    assert not any(p.endswith(".bin") for p in read.inputFiles())


def test_a_failing_line_leaves_the_old_dataset(spark, tmp_path):
    path, name = str(tmp_path / "set.jsonl"), lambda: sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith("."))
    chunks = spark.createDataFrame([(f"text {i}\n\"x\"",) for i in range(20)], "text string").repartition(4)
    writers.write_jsonl(chunks, path)
    before = sorted(r["value"] for r in spark.read.text(path).collect())
    for bad in (lambda: writers.write_jsonl(chunks, path, check=lambda line: ~line.contains("text 7")), lambda: writers.write_jsonl(chunks.limit(0), path), lambda: writers.write_jsonl(chunks.select(F.raise_error(F.lit("boom")).alias("text")), path)):
        with pytest.raises(Exception):
            bad()
        assert name() == ["set.jsonl"] and sorted(r["value"] for r in spark.read.text(path).collect()) == before
    writers.write_jsonl(chunks.orderBy("text").limit(5), path, single_file=True)
    parts = [p for p in (tmp_path / "set.jsonl").iterdir() if p.name.startswith("part-")]
    assert name() == ["set.jsonl"] and len(parts) == 1 and len(parts[0].read_text().splitlines()) == 5
    assert [r["text"] for r in spark.read.json(path).collect()] == [r["text"] for r in chunks.orderBy("text").limit(5).collect()]


def test_epochs_are_permutations(spark):
    for n in (1, 2, 3, 7, 64, 1000, 99_991):
        seen = set()
        for seed, epoch in ((0, 0), (0, 1), (5, 0)):
            out = epochs.permuted(np.arange(n), n, seed, epoch)
            assert sorted(out.tolist()) == list(range(n))
            seen.add(tuple(out.tolist()))
        assert len(seen) == 3 or n < 8
    # No batch is a run, and neighbours part.
    out = epochs.permuted(np.arange(100_000), 100_000, 3, 2)
    assert abs(np.corrcoef(np.arange(100_000), out)[0, 1]) < 0.02 and (np.abs(np.diff(out)) <= 2).mean() < 0.001
    assert len(epochs.permuted(np.arange(10**6), 10**15, 1, 1)) == len(set(epochs.permuted(np.arange(10**6), 10**15, 1, 1).tolist()))
    rows = epochs.batch_rows(spark, 1000, 64, 1, 4).collect()
    assert sorted((r["batch_no"], r["slot"]) for r in rows) == [(b, s) for b in range(15) for s in range(64)]
    some = epochs.batch_rows(spark, 1000, 64, 1, 4, batches=(3, 5)).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in rows if r["batch_no"] in (3, 4))
    assert epochs.batch_rows(spark, 10, 64).collect() == [] and epochs.epoch_batches(spark.range(0).toDF("k"), ["k"], 4).collect() == []
    df = spark.createDataFrame([(i * i, "x") for i in range(50)], "k long, slot_ string").repartition(3)
    out = epochs.epoch_batches(df, ["k"], 8, seed=2).collect()
    want = epochs.permuted(np.arange(48), 50, 2, 0)
    assert [r["k"] for r in sorted(out, key=lambda r: (r["batch_no"], r["slot"]))] == [int(i) ** 2 for i in want]


@pytest.mark.parametrize("segment", [1, 5, 64])
def test_blocks_are_read_from_a_store(spark, tmp_path, segment):
    rng = random.Random(segment)
    flat = [rng.randrange(1000) for _ in range(150)]
    pieces, at = [], 0
    while at < len(flat):
        n = min(rng.choice([0, 1, 2, 30]), len(flat) - at)
        pieces.append((at, flat[at : at + n]))
        at += n
    path = block_store.write_tokens(spark.createDataFrame(pieces, "start long, ids array<int>").repartition(4), str(tmp_path / "store"), segment)
    assert block_store.token_total(spark, path) == len(flat)
    asked = [-1, 0, 1, 7, 63, 64, 65, 100, 141, 142, 143, 149, 500, 7]
    got = {r["pos"]: (r["x"], r["y"]) for r in block_store.read_blocks(spark.createDataFrame([(p,) for p in asked], "pos long"), path, 8).collect()}
    assert got == {p: (flat[p : p + 8], flat[p + 1 : p + 9]) for p in asked if 0 <= p <= len(flat) - 9}
    nothing = block_store.write_tokens(spark.createDataFrame([], "start long, ids array<int>"), str(tmp_path / "none"), segment)
    assert block_store.token_total(spark, nothing) == 0 and block_store.read_blocks(spark.createDataFrame([(0,)], "pos long"), nothing, 8).collect() == []


def test_lines_keep_their_numbers_in_many_splits(spark, tmp_path):
    rng = random.Random(6)
    texts = {}
    for name in ("a.jsonl", "b.jsonl"):
        lines = [rng.choice(["", '{"text": "%s"}' % ("x" * rng.randrange(40)), "bad{", '{"content": "c"}']) for _ in range(200)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        texts[name] = lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        raw = readers.numbered_lines(spark, [str(tmp_path / n) for n in texts])
        assert raw.rdd.getNumPartitions() > 4
        got = sorted((r["path"].rsplit("/", 1)[-1], r["line_no"], r["value"]) for r in raw.collect())
        assert got == [(n, i, v) for n, lines in texts.items() for i, v in enumerate(lines)]
        rows = readers.read_corpus(spark, [str(tmp_path / n) for n in texts]).collect()
        assert all(r["text"] in texts[r["path"].rsplit("/", 1)[-1]][r["line_no"]] for r in rows) and rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_presets_lead_to_tables(spark, tmp_path):
    spark.createDataFrame([(1, " a "), (2, " ")], "id int, text string").write.parquet(str(tmp_path / "allenai/c4/en/train"))
    assert [r["text"] for r in readers.read_preset(spark, "C4 English, streamed subset (allenai/c4)", str(tmp_path)).collect()] == ["a"]
    for wrong in ("Custom...", "none"):
        with pytest.raises(ValueError):
            readers.preset(wrong)


def test_a_log_is_appended_once(spark, tmp_path):
    folder, inbox = str(tmp_path / "log"), tmp_path / "in"
    inbox.mkdir()
    stream = spark.readStream.schema("step int, loss double").json(str(inbox))

    def run(checkpoint):
        query = append_log(stream, folder, str(tmp_path / checkpoint))
        assert query.awaitTermination(60)

    (inbox / "a.json").write_text('{"step": 1, "loss": 2.5}\n{"step": 2, "loss": 2.25}\n')
    run("ck")
    (inbox / "b.json").write_text('{"step": 1, "loss": 2.0}\n')
    run("ck")
    want = [(1, 2.0, "Step 1 — loss 2.0000"), (2, 2.25, "Step 2 — loss 2.2500")]
    assert sorted(map(tuple, reports.loss_history(read_log(spark, folder)).collect())) == want and spark.read.parquet(folder).count() == 3
    # A batch that is tried again replaces itself.
    import shutil

    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    shutil.rmtree(tmp_path / "ck" / "commits" / f".{last.name}.crc", ignore_errors=True)
    (tmp_path / "ck" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run("ck")
    assert spark.read.parquet(folder).count() == 3 and sorted(map(tuple, reports.loss_history(read_log(spark, folder)).collect())) == want
