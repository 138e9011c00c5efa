"""Chosen collisions, broken markup, runs of one byte, texts over a bound."""

import time
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm import main_text, ngram_join, pieces, quality_crf, substring_dedup, suffix_dedup, token_ids


def colliding() -> tuple[str, str]:
    """Two words of 16 letters that have one hash without a key, solved for."""
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    state = lambda first: K.mix(K.mix(np.full(len(first), 16, np.uint64), 201) ^ first.view("<u8").ravel(), 202)
    while True:
        a, b, end = (letters[rng.integers(0, 26, (1 << 18, 8))] for _ in range(3))
        other = (end.view("<u8").ravel() ^ state(a) ^ state(b)).view(np.uint8).reshape(-1, 8)
        good = np.flatnonzero(((other >= 97) & (other <= 122)).all(axis=1))
        if len(good):
            i = good[0]
            return (a[i].tobytes() + end[i].tobytes()).decode(), (b[i].tobytes() + other[i].tobytes()).decode()


def hashed(words, *salt):
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return K.word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends, *salt)


def test_words_that_collide_without_a_key(spark):
    one, two = colliding()
    a, b = hashed([one, two])
    assert one != two and a == b
    a, b = hashed([one, two], K.drawn())
    assert a != b
    tail = [f"w{i}" for i in range(49)]
    texts = [(1, f"{one} b c d"), (2, f"{two} b c d"), (3, " ".join([one, *tail])), (4, " ".join([two, *tail])), (5, one), (6, two), (7, f"{one} {two}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert all(r["doc_id"] == r["component_id"] for r in ngram_join.ngram_jaccard_join(docs).where("doc_id in (1, 2, 5, 6)").collect())
    assert all(r["n_removed"] == 0 for r in substring_dedup.substring_dedup(docs).collect())
    got = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs)).collect()}
    assert got == dict(texts)
    coder = token_ids.encoder("word_bpe_49k.json")
    want = {i: coder.whole.encode(t, add_special_tokens=False).ids for i, t in texts}
    assert all(coder.encode(*packed([t]))[0].tolist() == want[i] for i, t in texts)


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@pytest.mark.parametrize("kinds", [1, 3])
def test_encoders_do_not_trust_hashes(monkeypatch, kinds):
    """With next to no different hashes they still encode each word as what it is."""
    rng = np.random.default_rng(0)
    words = ["alpha", "Beta", "gamma7", "delta's", "x", "été", "don't", "42", "Alpha", "▁mark", "<|", "longerword"]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(20)] + [""]
    real = K.word_hashes
    monkeypatch.setattr(K, "word_hashes", lambda *a: real(*a) % np.uint64(kinds))
    token = token_ids.Encoder(token_ids.encoder("word_bpe_49k.json") and __import__("public_tokenizers").path("word_bpe_49k.json"))
    model = pieces.model("piece_bpe_32k.model")
    for some in (texts, texts[::-1]):
        want = [i for t in some for i in token.whole.encode(t, add_special_tokens=False).ids]
        assert token.encode(*packed(some))[0].tolist() == want
        for known in (pieces.Known(()), pieces.Known((w, model.fold(w)) for w in ["▁alpha", "▁Beta", "▁x"])):
            ids, count = pieces.Encoder(model, known).texts(*packed(some))
            raw, upto = pieces.Decoder(model).raw(ids, count)
            assert [raw[a + 1 : b].decode() for a, b in zip(upto, upto[1:])] == some


@pytest.mark.parametrize("page", ["<a " * 20_000, "<a '>" * 20_001, "<a<" * 20_000 + ">", "</a" * 20_000, "<script/>" * 20_000 + "</script>", "<!" * 30_000, '<a class="x' * 20_000, "<a " * 20_000 + ">", "<![CDATA[" * 9000, "&" * 60_000])
def test_broken_markup_takes_time_that_grows_with_it(page):
    began = time.perf_counter()
    main_text.main_text(page)
    assert time.perf_counter() - began < 1


def test_main_text_of_odd_markup():
    long = "The story goes on and on in a long paragraph. " * 4
    assert main_text.main_text(f"<p title='a > b' class=\"x>y\">{long}</p><!-- <p>no</p> --><![CDATA[more]]>") == f"{long.strip()} more"
    assert main_text.main_text(f"<p>{long}</p><p title='open>{long}</p>") == f"{long}{long}".strip()
    assert main_text.main_text(f"<p>1 < 2 {long}</p>") == f"1 < 2 {long}".strip()
    for name in ("comment-body", "comment-content", "sidebar-content", "cookie-notice-content", "fusszeile", "main kommentare", "entry-comentarios"):
        assert main_text.main_text(f'<article><p>{long}</p><div class="{name}">Inner text.</div></article>') == long.strip(), name
        assert main_text.main_text(f'<p>{long}</p><div id="{name}"><p>{long}</p></div>') == long.strip(), name


def plain_bytes(texts, width=50):
    out, seen = [], set()
    for i, t in sorted(texts):
        raw = (t or "").encode()
        own = {raw[k : k + width] for k in range(len(raw) - width + 1)}
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - width + 1):
            if raw[k : k + width] in seen:
                gone[k : k + width] = True
        seen |= own
        heads = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
        out.append((i, len(raw), int(gone.sum()), heads, sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_runs_of_one_byte(spark, monkeypatch):
    texts = [(1, "x" + "0" * 120 + "y"), (2, "0" * 49 + " " * 300), (3, "0" * 51 + "z"), (4, "ab" * 90), (5, " " * 50), (6, "q" + "0" * 500 + "x" + "0" * 120 + "yy"), (7, "ba" * 40 + " " * 49), (8, "0" * 2000), (9, ""), (10, None), (11, "y" + " " * 51 + "0" * 50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect())) == plain_bytes(texts)
    # The scan sends one context for a run, however long.
    scan = suffix_dedup._scan(50, 16, 4, np.array([], "S16"), np.array([], "S16"))
    import pyarrow as pa

    rows = list(scan(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" " * 3_000_000])], ["doc_id", "text"])])))
    assert sum(len(r["b"]) + len(r["c"]) for b in rows for r in b.to_pylist()) < 1000


def test_stretches_of_a_text_have_each_string_once():
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"ab ", np.uint8), 4000, p=[0.48, 0.48, 0.04])
    data[1000:1400] = 32
    before, suffix_dedup.STRETCH = suffix_dedup.STRETCH, 130
    try:
        found = set()
        for base, part, edges in suffix_dedup.stretches(data, np.array([0, len(data)]), 50):
            doc, at, count, anchor = suffix_dedup.anchored(part, edges, 50, 16, once=True)
            assert (anchor >= at).all() and (anchor + 16 <= at + 50).all()
            found |= {int(base + a + k) for a, n in zip(at, count) for k in range(n)}
    finally:
        suffix_dedup.STRETCH = before
    strings = {data[k : k + 50].tobytes() for k in range(len(data) - 49)}
    assert {data[k : k + 50].tobytes() for k in found} == strings
    left = set(range(len(data) - 49)) - found
    assert all(len(set(data[k - 1 : k + 50].tolist())) == 1 for k in left)


def test_a_text_over_the_bound_shuts_out_no_other(spark):
    good, bad = "The river runs by the old stone bridge and the garden.", "buy now!!! $$$ click"
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    first = labels.where(~quality_crf.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").first()["doc_id"]
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat("text", 100)).otherwise(F.col("text")))
    model = quality_crf.train(docs, labels, most=3000)
    assert model.slope != 0
    scores = {r["doc_id"]: r["score"] for r in quality_crf.scored(docs, model).collect()}
    assert min(s for i, s in scores.items() if i % 2 and i != first) > 0.5 > max(s for i, s in scores.items() if not i % 2 and i != first)


def planted(rng):
    """(text, the secret in it or None): credentials of many forms, and plain code and prose that look like them."""
    import string

    signs, digits = string.ascii_letters + string.digits, "0123456789abcdef"
    draw = lambda n, of=signs: "".join(rng.choice(list(of), n))
    names = ["password", "db_password", "API_KEY", "client-secret", "access_token", "Passwort", "mot de passe", "contraseña", "kennwort", "auth", "PRIVATE_KEY"]
    for _ in range(30):
        for name in names:
            value = draw(int(rng.integers(12, 30)), signs + "!#$%&*+")
            yield rng.choice(["{} = '{}'", "{}: {}", '"{}": "{}"', "{}={}"]).format(name, value), value.rstrip("&,;")
        for value in ("ghp_" + draw(36), "xoxb-" + draw(30), "glpat-" + draw(20), "AKIA" + draw(16, string.ascii_uppercase), draw(40, digits)):
            yield f"see {value} there", value
    yield "private_key: -----BEGIN RSA PRIVATE KEY-----\nMIIEow\nABC=\n-----END RSA PRIVATE KEY----- done", "MIIEow"
    plain = [
        "login: administrator@example.com", "auth: Authenticated_users_only", 'x "key": "https://example.com/login/page"', "auth = get_token(request)", "key: ${SECRET_NAME}", "pass: {{ vault }}",
        "login = users.find_by_name(name)", "key = config['server']", "auth: required_for_all", "pin: something", "the pass: between mountains", "sk-and-some-other-words", "key: first.second.third", "credentials: include", "auth: none", "login: /users/login",
    ]
    for text in plain * 20:
        yield text, None


def test_secrets_planted_among_plain_code():
    from millrace.llm import secrets

    hits = misses = false = 0
    for text, value in planted(np.random.default_rng(4)):
        shown = secrets.redact(text)
        if value is None:
            false += shown != text
        elif value in shown:
            misses += 1
        else:
            hits += 1
    assert hits / (hits + misses) >= 0.98 and hits / (hits + false) >= 0.95, (hits, misses, false)


def test_what_the_jvm_lets_through_holds_all_secrets(spark):
    from millrace.llm import secrets

    texts = [t for t, _ in planted(np.random.default_rng(4))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert all(got[i] == secrets._join(secrets.find(t)) for i, t in enumerate(texts))
    began = time.perf_counter()
    for text in ("-----BEGIN PRIVATE KEY-----" * 4000, "sk-" * 40_000, "key=" * 20_000, "key=a(" * 10_000):
        secrets.find(text)
    assert time.perf_counter() - began < 20
