"""Vector codes, SimHash tiles and conversation repair against plain versions, and awkward tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import queries, simhash_tiles, turn_repair, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"
TEXTS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"



# vector codes


def plain_codes(vectors, rounds=4):
    """(vec_id, code, error) of clean (vec_id, vector) pairs."""
    x = np.floor(1024 * np.array([v for _, v in vectors], float)).astype(int)
    parts = x.reshape(len(x), 4, -1)
    books = parts[:256].transpose(1, 0, 2).copy()
    near = lambda p: ((parts[:, p, None] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p, d in [(p, near(p)) for p in range(4)]:
            for e in np.unique(d.argmin(axis=1)):
                own = parts[d.argmin(axis=1) == e, p]
                books[p, e] = own.sum(axis=0) // len(own)
    found = [near(p) for p in range(4)]
    codes = ["".join(f"{d[i].argmin():02x}" for d in found) for i in range(len(x))]
    return codes, [int(sum(d[i].min() for d in found)) for i in range(len(x))], vector_codes.digest(books)


def test_nearest_is_exact_for_all_magnitudes_and_ties():
    rng = np.random.default_rng(5)
    for k in range(60):
        top, wide = int(10 ** rng.uniform(0, 8)), int(rng.integers(1, 20))
        x, book = rng.integers(-top, top + 1, (70, wide)), rng.integers(-top, top + 1, (int(rng.integers(1, 257)), wide))
        if k % 3 == 0:  # ties
            x, book = np.sign(x), np.sign(book)
        index, least = vector_codes.nearest(x, book)
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


@pytest.mark.parametrize("n", [3, 300])
def test_vector_codes_equal_plain_ones_and_skip_broken_vectors(spark, n):
    rng = np.random.default_rng(n)
    good = [(i, [float(np.float32(v)) for v in rng.normal(0, 0.2, 8)], int(i % 3) if i % 5 else None) for i in range(0, 2 * n, 2)]
    good += [(good[1][0], good[1][1], 1)] * 2  # repeated rows
    broken = [(1, None, 1), (3, [1.0, None] + [0.0] * 6, 1), (5, [float("nan")] * 8, 0), (7, [float("inf")] + [0.0] * 7, 2), (9, [], 0), (11, [1.0] * 4, 0), (13, [1.0] * 7, 0), (None, [0.1] * 8, 0)]
    df = spark.createDataFrame([*good, *broken], VECTORS).withColumn("error", F.lit("clash")).withColumn("CODE", F.lit(1)).repartition(3)
    out = vector_codes.vector_codes(df).collect()
    good.sort(key=lambda g: (g[0], g[1]))
    codes, errors, digest = plain_codes([(i, v) for i, v, _ in good])
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in out) == sorted(zip([g[0] for g in good], codes, errors))
    assert {r["codebooks_sha256"] for r in out} == {digest}
    sums = {}
    for (_, _, label), e in zip(good, errors):
        sums[label] = sums.get(label, 0) + e
    assert sorted(r["label_error"] for r in out) == sorted(sums[g[2]] for g in good)


def test_vector_codes_of_nothing_and_of_huge_components(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, None)], VECTORS)).collect() == []
    out = vector_codes.vector_codes(spark.createDataFrame([(1, [3e38, -3e38, 0.0, 1.0], 1), (2, [0.0] * 4, 1), (3, [3e38, -3e38, 0.0, 1.0], 1)], VECTORS)).collect()
    assert len(out) == 3 and all(r["error"] == 0 for r in out)


# SimHash tiles


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=4):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if ids[i] == ids[j] or (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
                parent[b] = a
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def simhash_case(spark, data):
    out = simhash_tiles.simhash_near_dedup(spark.createDataFrame(data, TEXTS).withColumn("fp", F.lit(1)).withColumn("Cell", F.lit("x")).repartition(3))
    data = [d for d in data if d[0] is not None]
    prints = [plain_print(t) for _, t in data]
    want = sorted((d, f"{p:016x}", c) for (d, _), p, c in zip(data, prints, plain_components([d for d, _ in data], prints)))
    assert sorted(map(tuple, out.select("doc_id", "fingerprint", "component_id").collect())) == want
    return want


def test_simhash_equals_plain_version(spark):
    rng = random.Random(3)
    words = [f"W{i}é" if i % 3 else f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 120))) for _ in range(60)]
    for base in texts[:25]:
        w = base.split(" ")
        for _ in range(3):
            k = rng.randrange(len(w))
            texts.append(" ".join([*w[:k], rng.choice(words), *w[k + 1 :]]))
    texts += [None, "", " \t\n", "one", "ONE", "one two three", "A b\x0bc\x0cd\re", "a B C D E", "x\x85y\xa0z", "long " * 50_000]
    data = [(rng.randrange(10**12), t) for t in texts]
    data += [data[0], (data[1][0], "another text of a repeated id"), (None, "no id")]
    want = simhash_case(spark, data)
    assert len({c for _, _, c in want}) < len(want) - 10


def test_simhash_over_empty_and_single_rows(spark):
    assert simhash_tiles.simhash_near_dedup(spark.createDataFrame([], TEXTS)).collect() == []
    simhash_case(spark, [(7, None)])


def test_tiles_find_every_link_of_crowded_cells(spark, monkeypatch):
    """Tiles of 8: chains of one-bit steps, and random fingerprints around few centres."""
    monkeypatch.setattr(simhash_tiles, "TILE", 8)
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    prints = set(centres)
    for c in centres:
        for _ in range(60):
            p = c
            for b in rng.sample(range(64), rng.randint(0, 7)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    pairs = simhash_tiles.tile_pairs(spark.createDataFrame(signed, "doc_id long, fp long"))
    edges = pairs.mapInArrow(simhash_tiles._compared(4), "a long, b long").collect()
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in edges)
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert [find(i) for i in range(len(prints))] == plain_components(list(range(len(prints))), prints)


# conversation repair


def plain_repair(turns):
    """The contract's columns, row by row with a table of the four states."""
    out = []
    for conv in sorted({t[0] for t in turns if t[0] is not None}):
        kept = []
        for _, turn, role, text in (t for t in turns if t[0] == conv):
            role, text = (" " if role is None else role), (" " if text is None else text)
            dice = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if dice == 1 else "".join(c for c in text if c not in ".!?") if dice == 2 else text
            kept += [(turn, "user" if dice == 4 else role, text)] * (0 if dice == 0 else 2 if dice == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        spaces, seen, faults = " \t\n\x0b\x0c\r", set(), []
        for _, role, text in kept:
            body = text.rstrip(spaces)
            faults.append("b" if not body.strip(spaces) else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        # state: (cost, audit, lines); insertions are tried before and after each turn.
        states = {"": (0, "", ())}

        def offer(to, state, value):
            if state not in to or value[:2] < to[state][:2]:
                to[state] = value

        def inserted(states):
            states = dict(states)
            for _ in range(3):
                for s, (c, a, lines) in list(states.items()):
                    who = "assistant" if s == "u" else "user"
                    offer(states, who[0], (c + 5, a + "I", (*lines, f"{who}:")))
            return states

        states = inserted(states)
        for (_, role, text), fault in zip(kept, faults):
            after = {}
            for s, (c, a, lines) in states.items():
                offer(after, s, (c + 2, a + "D", lines))
                if fault in ("b", "d"):
                    continue
                c += 5 if fault else 0
                who = "assistant" if s == "u" else "user"
                offer(after, who[0], (c + 1, a + "R", (*lines, f"{who}:{text}")))
                if role[:1] == who[0] or (s == "" and role[:1] == "s"):
                    offer(after, role[0], (c, a + "K", (*lines, f"{role}:{text}")))
            states = inserted(after)
        cost, audit, lines = min(states[s] for s in ("", "a") if s in states)
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def repair_case(spark, turns, n=3):
    df = spark.createDataFrame(turns, TURNS).withColumn("fault", F.lit(1)).withColumn("Piece", F.lit("x")).repartition(n)
    out = sorted(map(tuple, turn_repair.turn_repair(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()))
    assert out == plain_repair(turns)
    return out


def some_turns(rng, convs, longest):
    texts = ["A b.", "Why?", "No end", " ", "", "x ", "Done! \t", "…", ".", None, "line\nline."]
    roles = ["user", "assistant", "system", "tool", "", None, "ux"]
    return [(c, rng.choice([t, t, t, rng.randrange(5), None]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(texts)) for c in convs for t in range(rng.randint(1, longest))]


def test_repair_equals_plain_version(spark):
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns = some_turns(random.Random(4), range(150), 9) + [(None, 0, "user", "No conversation."), (gone, 0, "user", "Dropped.")]
    out = repair_case(spark, turns)
    assert any("R" in r[7] for r in out) and any(r[7] == "" for r in out)


def test_repair_of_long_conversations_cut_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "FAN", 2)
    rng = random.Random(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        turns = [(5, t, rng.choice(["user", "assistant", "system"]), f"{rng.choice('abcde')}{rng.choice(['.', ''])}") for t in range(700)] + some_turns(rng, range(10, 16), 60)
        repair_case(spark, turns, 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repair_of_what_a_task_does_not_hold(spark, monkeypatch):
    # A conversation between two others, too long to be kept for its hash.
    monkeypatch.setattr(turn_repair, "HELD", 300)
    repair_case(spark, some_turns(random.Random(2), range(30), 8))


def test_repair_of_nothing(spark):
    assert turn_repair.turn_repair(spark.createDataFrame([], TURNS)).collect() == []


def test_products_are_associative_and_equal_a_scan():
    rng = random.Random(1)
    for _ in range(200):
        kinds = [rng.choice("sua?") + rng.choice("-bdt") for _ in range(rng.randint(0, 40))]
        whole = turn_repair.reduced("".join(kinds))
        step = turn_repair.CLOSURE
        for k in kinds:
            step = turn_repair.times(step, turn_repair.turn_matrix(k[0], k[1]))
        assert whole == step


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_turn_repair"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
