"""Each operator against a plain version, an exact round trip or held-out accuracy, and the cases of its docstring."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.llm import chat, common, components, fm_index, lines, minhash, mixing, neighbours, packing, pitman_yor, quality, rules, substrings
from quarrymill.llm.registry import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, clash=""):
    """Documents from (doc_id, text); clash: a further column with that name."""
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 4 else None, len(t or "")) for i, t in rows], DOCS)
    return df.withColumn(clash, F.lit("x")) if clash else df


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randrange(10**6)}{c}" for c in "abcdefghij" * 40]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, out = words(70), []
    for i in range(n):
        w = words(rng.choice([3, 20, 60, 150]))
        if i % 5 == 1:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randrange(5) :]
        if i % 7 == 3:
            w = out[rng.randrange(len(out))][1].split()
            if len(w) > 30 and i % 2:
                w[len(w) // 2] = "edit"
        out.append((i, " ".join(w) if i % 4 else "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "w " * 5000), (n + 4, "ÀB c"), (n + 5, "àb c"), (n + 6, "AB c d"), (n + 7, "ab c d"), (None, out[5][1])]


# --- 1 ------------------------------------------------------------------------------------------------------------


def plain_substrings(docs, width):
    words = {i: (t or "").encode().split() for i, t in docs}
    first = {}
    for i in sorted(x for x in words if x is not None):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [10**6, 2])
def test_substrings_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    docs = corpus()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_copied(make(spark, docs, "spans")).collect()}
    want = plain_substrings(docs, 50)
    assert got == want and sum(x[1] for x in want.values()) > 500
    assert substrings.remove_copied(make(spark, [(1, "x")]).limit(0)).count() == 0


def test_repeated_rows_lose_nothing_to_each_other(spark):
    text = " ".join(f"a{i}" for i in range(80))
    got = substrings.remove_copied(make(spark, [(3, text), (3, text), (9, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(3, 0), (3, 0), (9, 80)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=14), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=10), min_size=1, max_size=4))
def test_matching_statistics(texts, queries):
    flat = lambda x: (np.array([v for y in x for v in y], np.uint64), np.concatenate([[0], np.cumsum([len(y) for y in x])]))
    index = fm_index.FMIndex(*flat(texts), np.arange(len(texts)), 3)
    length, place = index.matching_statistics(*flat(queries))
    least = index.least_label(length, place)
    at = 0
    inside = lambda q, t: any(t[k : k + len(q)] == q for k in range(len(t) - len(q) + 1))
    for q in queries:
        for k in range(len(q)):
            want = max((n for n in range(len(q) - k + 1) if n == 0 or any(inside(q[k : k + n], t) for t in texts)), default=0)
            assert length[at] == want
            if want >= 3:
                assert least[at] == min(i for i, t in enumerate(texts) if inside(q[k : k + 3], t))
            at += 1


# --- 2 ------------------------------------------------------------------------------------------------------------


def plain_near(docs, similarity=85):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    up = {i: i for i in ids}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i) if i is not None else None) for i in sets}


def family(seed=2, n=120, words=150):
    """Copies of one text with a few words changed each: many share buckets and few are linked."""
    rng = random.Random(seed)
    base = [f"v{k}" for k in range(words)]
    out = []
    for i in range(n):
        w = base[:]
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(words)] = rng.choice(["the", "of", f"x{rng.randrange(10**6)}"])
        out.append((1000 + i, " ".join(w)))
    return out


def test_near_duplicates_equal_brute_force(spark):
    docs = corpus() + family()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(make(spark, docs, "n")).collect()}
    want = plain_near(docs)
    assert got == want and 3 < sum(i == c[1] for i, c in want.items() if i and i >= 1000) < 110
    assert minhash.near_duplicates(make(spark, docs).limit(0)).count() == 0
    kept = minhash.drop_near_duplicates(make(spark, docs, "_gone"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in want.items() if i is None or c[1] == i} and "_gone" in kept.columns


def test_large_buckets_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 3)
    monkeypatch.setattr(minhash, "RARE", 1)  # so that buckets stay open for the rounds of centres
    docs = family()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(make(spark, docs)).collect()}
    assert got == plain_near(docs)


def test_densified_signatures_agree_as_often_as_sets_do():
    scheme, rng = minhash.OnePermutation(32, 5), np.random.default_rng(1)
    for n, both in ((40, 0.8), (400, 0.6)):
        rates = []
        for _ in range(60):
            x = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            common_ = round(2 * both * n / (1 + both))
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:common_], x[n : 2 * n - common_]]))
            rates.append((scheme.signature(a) == scheme.signature(b)).mean())
        assert abs(np.mean(rates) - both) < 0.04


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (7, 8), (5, 5), *[(100 + i, 101 + i) for i in range(40)], *[(500, 501 + i) for i in range(50)]]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t")).collect()}
    assert {i: got[i] for i in (1, 2, 3, 9, 7, 8)} == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7}
    assert 5 not in got and got[140] == 100 and got[550] == 500


# --- 3 ------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    docs = corpus(3, 300)
    df = make(spark, docs, "size")
    rows = mixing.mix_sources(df, block=16).collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, mixing.mix_sources(df.repartition(7), block=16).collect()))
    size = collections.Counter()
    for i, t in docs:
        size[f"s{(i or 0) % 3}" if i != 4 else None] += len((t or "").split())
    names, total = sorted(x for x in size if x) + [None], sum(size.values())
    weight, full, share = dict(zip(names, [3, 1, 2, 3], strict=True)), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = 1.5 * total - sum(2 * size[s] for s in full)
        share = {s: 2 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        if not (over := {s for s in open_ if share[s] > 2 * size[s]}):
            break
        full |= over
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
    for s in names:
        assert any(abs(r["target"] - share[s]) < 1e-6 for r in rows if r["source_size"] == size[s])
        assert abs(taken[size[s]] - share[s]) <= max(40, 0.02 * share[s])
    texts = {r["doc_id"]: r["text"] for r in mixing.mix_texts(df, block=16).collect()}
    for r in rows:
        if r["taken"]:
            assert len(texts[r["doc_id"]].split()) == r["taken"]
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mix_texts(df.limit(0)).columns == df.columns


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=12), st.integers(0, 60))
def test_sainte_lague_equals_highest_quotients(votes, seats):
    # the range of quotients that is ranked always holds the winners
    seats = seats if any(votes) else 0
    party = [(v / (2 * k + 1), -i) for i, v in enumerate(votes) for k in range(seats) if v]
    won = collections.Counter(-i for _, i in sorted(party, reverse=True)[:seats])
    n, total = len(votes), sum(votes)
    for i, v in enumerate(votes):
        if seats and total:
            q = v * seats / total
            low = max(0, math.ceil(q * (1 - n / (2 * seats)) - 0.5) - 1)
            high = math.floor(q * (1 + n / (2 * seats)) + 0.5) + 1
            assert low <= won[i] <= high


def test_sainte_lague_query(spark):
    rows = spark.createDataFrame([("g", "a", 53, 7), ("g", "b", 24, 7), ("g", "c", 23, 7), ("h", "a", 0, 3), ("h", "b", 5, 3)], "g string, p string, v long, s long")
    got = {(r["g"], r["p"]): r["won"] for r in mixing.sainte_lague(rows, ["g"], "p", "v", "s", "won").collect()}
    assert got == {("g", "a"): 3, ("g", "b"): 2, ("g", "c"): 2, ("h", "a"): 0, ("h", "b"): 3}


# --- 4 ------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = [*corpus(5, 80), (900, "don't  <|endoftext|>x İ é, " * 900), (901, "A<|ENDOFTEXT|>"), (901, "A<|ENDOFTEXT|>")]
    rows = packing.pack(packing.tokenized_pieces(make(spark, docs, "length"), tokenizer_path())).collect()
    t = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            some = np.asarray(ids[at : at + 2048], "<u4")
            want[i, k, at, len(some), zlib.crc32(some.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 2048
    room = []
    for n in sorted((r["length"] for r in rows), reverse=True):  # first fit, longest first
        k = next((k for k, x in enumerate(room) if x >= n), None)
        if k is None:
            room.append(2048 - n)
        else:
            room[k] -= n
    assert len(places) <= len(room)
    assert packing.pack(packing.tokenized_pieces(make(spark, docs).limit(0), tokenizer_path())).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=20))
def test_patterns_hold_every_piece_once(histogram):
    sizes, demand = np.array(list(histogram)), np.array(list(histogram.values()))
    plan = packing.plan_patterns(sizes, demand, 60, 40)
    assert (sum(c * n for c, n in plan) == demand).all() and all((c * sizes).sum() <= 60 for c, _ in plan)
    covered = sum((c * a for c, a in packing.solve_configurations(sizes, demand, 60, 400)), np.zeros(len(sizes)))
    assert np.allclose(covered, demand)


# --- 5 ------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["stone", "river", "light", "paper", "north", "green"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["STONE!!", "river$$$", "x###", "PAPER!!"]) for _ in range(40))
    docs = [(i, bad() if i % 3 == 0 else good()) for i in range(600)] + [(9000, None), (9001, ""), (None, good())]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(600)] + [(5, None), (None, 1), (77777, 1)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    df = make(spark, docs, "score")
    fitted = quality.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, *fitted).collect()}
    assert len(got) == len(docs) and all(0 <= x <= 1 for x in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 3 != 0) for i in held]) > 0.98
    kept = quality.keep_good(df, *fitted)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in got.items() if x >= 0.3}
    assert {r["score"] for r in quality.score(df, *quality.fit(df, labels.limit(0))).collect()} == {0.5}
    assert quality.score(df.limit(0), *fitted).count() == 0


# --- 6 ------------------------------------------------------------------------------------------------------------


def recall(got, x, k=20):
    """Mean share of the true nearest k that were found; rows must carry exact scores, in order."""
    found = []
    for q, rows in got.items():
        s = neighbours.exact_products(x[q].astype(float), x)
        assert all(score == s[i] for i, score in rows) and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        best = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:k]
        assert len(rows) == len(best)
        found.append(len({i for i, _ in rows} & set(best)) / max(1, len(best)))
    return np.mean(found)


def collected(df):
    got = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[40:80] = x[40]  # ties, more of them than neighbours asked for
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1200, None), (1220, [0.0] * 8), (1240, [float("nan")] * 8), (1260, [None] * 8), (1280, [1.0]), (20, x[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = collected(neighbours.nearest(df, F.col("vec_id") % 20 == 0))
    assert set(got) == set(range(0, 400, 20)) and recall(got, x) >= 0.9
    copies = [i for i, _ in got[40] if 40 <= i < 80]
    assert len(copies) > 5 and copies == list(range(41, 41 + len(copies)))  # of equal vectors the smaller vec_ids
    few = collected(neighbours.nearest(df.where("vec_id < 12"), F.lit(True)))
    assert len(few) == 12 and recall(few, x[:12]) == 1 and all(len(r) == 11 for r in few.values())
    # one vec_id with two vectors: two candidates, and each asks
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(two, F.col("vec_id") == 1).collect()} == {(1, 0)}
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize(("n", "share"), [(500, 0.5), (2000, 0.4), (9000, 0.3)])
def test_recall_and_share_of_the_index(n, share):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = neighbours.CollisionIndex(x, 1.0).candidates(x[:40])
    found = [len(np.intersect1d(np.argsort(-(x @ x[i]))[1:21], c)) / 20 for i, c in enumerate(near)]
    assert np.mean(found) >= 0.9 and np.mean([len(c) for c in near]) < share * n


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(sf):
    import pyarrow.parquet as pq

    table = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    x = np.array([v for v in table.column("embedding").to_pylist() if v is not None and None not in v and np.isfinite(v).all() and any(v)], np.float64)
    built = neighbours.CollisionIndex(x, float(np.linalg.norm(x, axis=1).max()))
    near = built.candidates(x[::20])
    found = [len(np.intersect1d(np.argsort(-(x @ x[20 * i]), kind="stable")[:21], c)) / 21 for i, c in enumerate(near)]
    assert np.mean(found) >= 0.9 and np.mean([len(c) for c in near]) < 0.45 * len(x)


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 6500)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(18000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collected(neighbours.nearest(df, F.col("vec_id") % 360 == 0))
    assert set(got) == set(range(0, 18000, 360)) and recall(got, x) >= 0.9


def test_collisions_are_counted_over_all_lines():
    rng = np.random.default_rng(11)
    place, borders = rng.normal(size=(37, 333)), np.sort(rng.normal(size=(37, neighbours.STRETCHES + 1)), axis=1)
    borders[:, 0], borders[:, -1] = -9, 9
    low, high = np.sort(rng.integers(0, neighbours.STRETCHES + 1, (2, 37, 50)), axis=0)
    at = np.arange(37)
    for least in (1, 8, 12, 31, 37):
        got = neighbours.collisions(neighbours.CollisionIndex._below(place, borders), low, high, least)
        for q, found in enumerate(got):
            held = (place >= borders[at, low[:, q]][:, None]) & (place < borders[at, high[:, q]][:, None])
            assert found.tolist() == np.flatnonzero(held.sum(0) >= least).tolist()


def test_a_query_counts_fast():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(50_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    built = neighbours.CollisionIndex(x, 1.0)
    began = time.process_time()
    near = built.candidates(x[:300])
    assert time.process_time() - began < 3  # 6.5 when each vector's collisions were added up one by one
    found = [len(np.intersect1d(np.argsort(-(x @ x[i]))[1:21], near[i])) / 20 for i in range(0, 300, 3)]
    assert np.mean(found) >= 0.9 and np.mean([len(c) for c in near]) < 0.06 * len(x)


# --- 7 ------------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_automaton(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 14)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice([[], ["a"], ["é"]])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    for r in df.withColumn("w", lines.within(chars("a"), chars("b"), 2)).collect():
        assert r["w"] == (distance(r["a"], r["b"]) <= 2), r


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh éñ") for _ in range(rng.choice([10, 24, 31, 60]))).strip() or "x" for _ in range(25)]
    docs = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(line) + 1)
                line[k : k + rng.randrange(2)] = rng.choice([[], ["z"], ["é"]])
            text.append("".join(line))
        docs.append((i, "\n".join(text)))
    docs += [(70, None), (71, ""), (72, " \n\t\n"), (0, docs[0][1]), (None, docs[3][1])]
    occurrences = [(i, k, x) for i, t in docs if i is not None for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    texts = sorted({x for _, _, x in occurrences})
    up, degree = {x: x for x in texts}, collections.Counter()

    def top(x):
        return x if up[x] == x else top(up[x])

    for j, b in enumerate(texts):
        for a in texts[:j]:
            if min(len(a), len(b)) >= 24 and abs(len(a) - len(b)) < 3 and distance(a, b) <= 2:
                degree[a] += 1
                degree[b] += 1
                up[top(a)] = top(b)
    first = {}
    for i, k, x in occurrences:
        first[top(x)] = min(first.get(top(x), (i, k)), (i, k))
    want = collections.Counter((i, k, *first[top(x)], degree[x], (i, k) != first[top(x)]) for i, k, x in occurrences)
    df = make(spark, docs, "_gone")
    got = collections.Counter((r["doc_id"], r["line_no"], r["class_doc"], r["class_line"], r["n_links"], r["removed"]) for r in lines.duplicate_lines(df).collect())
    assert got == want and sum(degree.values()) > 20
    out = lines.drop_duplicate_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert lines.duplicate_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_crowded_segments_equal_brute_force(spark, crowd):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefé 0123") for _ in range(n))
    head, tail, texts_ = text(30), text(30), set()
    for _ in range(60):
        line = head + text(12) + (tail if rng.random() < 0.6 else text(20))
        texts_.add(line)
        for _ in range(3):
            k = rng.randrange(len(line))
            texts_.add(line[:k] + rng.choice(["", "q", "é"]) + line[k + rng.randrange(2) :])
    texts_ |= {head[:12] * 3 + x for x in ("", "a", "ab", "abc")} | {"z" * n for n in (24, 25, 26, 27, 40)}
    rows = list(enumerate(sorted(texts_)))
    df = spark.createDataFrame(rows, "id long, line string")
    got = {(r["a"], r["b"]) for r in lines.linked_lines(df, common.Scratch(spark, "t"), crowd=crowd).collect()}
    assert got == {(i, j) for i, a in rows for j, b in rows if i < j and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    assert len(got) > 100


def test_many_lines_with_a_common_beginning(spark):
    rng = random.Random(3)
    head = "the same beginning of every line in the table, " * 2
    rows = [(i, f"{head}{rng.getrandbits(200):060d}") for i in range(5000)]
    scratch, made = common.Scratch(spark, "t"), []
    table = scratch.table
    scratch.table = lambda df, *a: made.append(table(df, *a)) or made[-1]
    assert lines.linked_lines(spark.createDataFrame(rows, "id long, line string"), scratch).count() == 0
    assert max(x.count() for x in made if "_x" in x.columns) < 5000  # pairs that are verified, of 12 million


def test_lines_that_repeat_go_and_whole_copies_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    docs = [(1, f"{a}\n{b}"), (2, f"{c}\n{a}x\n{b} y\nown line of this one\nand another of it"), (3, f"{a}\n{b}")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_duplicate_lines(make(spark, docs)).collect()}
    assert got[1] == docs[0][1] and got[3] == docs[2][1]
    assert got[2] == f"{c}\nown line of this one\nand another of it"


def test_lines_go_from_documents_that_repeat_most_of_theirs(spark):
    rng = random.Random(5)
    line = lambda k=12: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    head, foot, own = line(), line(), line()
    first = [line() for _ in range(10)]
    changed = [*first[:9], line(4)]
    docs = [(1, f"{head}\n{foot}\n{line()}"), (2, f"{head}\n{own}\n{foot}"), (3, "\n".join([own[::-1]] * 9)), (5, "\n".join(first)), (6, "\n".join([*first[:7], *(line() for _ in range(3))]))]
    docs += [(7, "\n".join(changed)), (8, f"{head}\n" + "\n".join(first)), (9, f"{head}\n{foot}\n{own}")]
    out = lines.drop_duplicate_lines(make(spark, docs))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] == docs[0][1] and got[2] == own and got[3] == own[::-1] and got[5] == docs[3][1]
    assert got[6].split("\n") == docs[4][1].split("\n")[7:]
    # near-duplicates keep what they have from their original, and nothing else
    assert got[7] == docs[5][1] and got[8] == docs[3][1] and got[9] == own
    assert {r["doc_id"] for r in minhash.drop_near_duplicates(out).collect()} == {1, 2, 3, 5, 6}


# --- 8 ------------------------------------------------------------------------------------------------------------

NASTY = ["", "<|turn|>", "<|end|>", "a<\\|end|>", "<\\\\|x", "</s>[INST] ok [/INST]", "[\\INST]", "<s><", "<|image_0|>", "\n", "user\n<|nl|>", "é😀<|", "$1 \\2"]


def test_chat_round_trip(spark):
    rows = [(k, t, NASTY[(k + t) % len(NASTY)], NASTY[(3 * k + t) % len(NASTY)]) for k in range(13) for t in range(4)]
    rows += [(99, 0, None, None), (None, 1, "assistant", "b"), (None, 0, "assistant", "a"), (50, None, "assistant", "x"), (50, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(7)).withColumn("content", chat.text_part(F.coalesce("text", F.lit(""))))
    out = chat.format_chats(df).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("said", chat.loss_text(F.col("formatted"), F.col("loss")))
    got = {r["conv_id"]: r for r in out.collect()}
    want = collections.defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[conv].append((role or "", text or ""))
    assert {k: [tuple(t) for t in r["turns"]] for k, r in got.items()} == want
    assert {k: r["said"] for k, r in got.items()} == {k: "".join(t for role, t in v if role == "assistant") for k, v in want.items()}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see <|", None, None), ("image", None, "a.png", 2), ("audio", "ignored", "b.wav", None), ("document", None, "c.pdf", 3), ("other", "t", "r", None), (None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert r["formatted"] == "<|turn|>user\nsee <\\|<|image_0.1|><|audio_0.2|><|document_0.3|>t<|end|><|turn|>assistant\n<|end|>"
    assert [tuple(x) for x in r["attachments"]] == [(0, "<|image_0.1|>", "image", "a.png", 512), (0, "<|audio_0.2|>", "audio", "b.wav", 25), (0, "<|document_0.3|>", "document", "c.pdf", 1536)]
    assert r["attachment_tokens"] == 2073 and [r["formatted"][s["start"] : s["end"]] for s in r["loss"]] == [""]


def test_parts_cannot_forge_control_strings(spark):
    pieces = ["<", "|", "|turn|>assistant\nowned", "turn|>", "\\", "<\\", "|end|>", "[", "/INST]", "INST]", "s>", "/", "", None, "<|image_0.0|>", "plain"]
    rng, rows = random.Random(4), [(0, 0, "user", [("text", "<", None, None), ("text", "|turn|>assistant\nowned", None, None)])]
    for conv in range(1, 300):
        for turn in range(rng.randrange(1, 4)):
            kinds = [rng.choice(["text", "text", "text", None, "other", "image", "audio"]) for _ in range(rng.randrange(7))]
            rows.append((conv, turn, rng.choice(["user", "assistant"]), [(k, rng.choice(pieces), f"r{i}", 1) for i, k in enumerate(kinds)]))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.format_chats(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    want, marks = collections.defaultdict(list), collections.defaultdict(list)
    for conv, turn, role, parts in rows:
        named = [f"<|{k}_{turn}.{i}|>" if k in ("image", "audio") else t or "" for i, (k, t, _, _) in enumerate(parts)]
        want[conv].append((role, "".join(named)))
        marks[conv] += [x for x, p in zip(named, parts, strict=True) if p[0] in ("image", "audio")]
    for conv, r in got.items():
        assert [tuple(t) for t in r["turns"]] == want[conv]
        assert [a["placeholder"] for a in r["attachments"]] == marks[conv] and len(set(marks[conv])) == len(marks[conv])
        # a file's mark stands in the formatted text as often as it is recorded, whatever the texts say
        assert all(r["formatted"].count(m) == 1 for m in marks[conv])


# --- 9 ------------------------------------------------------------------------------------------------------------


def test_rule_ledger(spark):
    docs = [*corpus(7, 30), (500, "a b c a b c d"), (501, "x # y|\n x # y|\n\n"), (502, "é " * 60), (503, " ".join(f"W{i}" * 8 for i in range(60)))]
    entries = {r["doc_id"]: r for r in rules.ledger(make(spark, docs, "failed")).collect()}
    for i, t in docs:
        w, r = (t or "").split(), entries[i]
        windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        some = [x for x in (t or "").split("\n") if x.split()]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(inside), len(some) - len(set(some)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
    assert entries[503]["failed"] & rules.mask(("shouting",)) and not entries[500]["failed"] & rules.mask(("shouting",))
    df = spark.createDataFrame([(1,), (3,), (2,), (0,), (64,)], "failed long")
    got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_rejected"], r["n_rows"]) for r in rules.ablation(df, "base").collect()}
    assert got == {"too_few_words": (2, 1, 3, 5), "repeated_windows": (2, 1, 3, 5)}
    assert rules.ledger(make(spark, docs).limit(0)).count() == 0


# --- 10 -----------------------------------------------------------------------------------------------------------


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 700)
    monkeypatch.setattr(pitman_yor, "CELL_BYTES", 4000)
    docs = corpus(11, 200)
    df = make(spark, docs, "train")
    train = F.coalesce(F.col("doc_id") % 4 != 1, F.lit(False))
    got = {r["doc_id"]: r for r in pitman_yor.score(df, train).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs}
    counts = collections.Counter(w for i, x in tokens.items() if i is not None and i % 4 != 1 for w in x)
    n, v = sum(counts.values()), len(counts)
    for i, x in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(w in counts for w in x), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
        assert r["score"] < 0
    held = [r for i, r in got.items() if i is not None and i % 4 == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert [r["score"] for r in pitman_yor.score(df, train).orderBy("doc_id").collect()] == [got[i]["score"] for i in sorted(got, key=lambda x: (x is not None, x or 0))]
    assert pitman_yor.score(df.limit(0), train).count() == 0
    nothing = pitman_yor.score(df, F.lit(False)).first()
    assert nothing["train_tokens"] == 0 and nothing["score"] == 0


def messages(docs, train, bits=(0, 0)):
    """What blocks of these texts send, by cell."""
    known = common.WordHash()
    split = [[*x.lower().split(), pitman_yor.END] for x in docs]
    own = known.of([w for x in split for w in x])
    out = collections.defaultdict(list)
    for batch in pitman_yor.block_rows(7, own, np.array([len(x) for x in split]), np.arange(len(docs)), np.array(train), bits, True):
        for r in batch.to_pylist():
            out[r["key"]].append(r)
    return out, known


@pytest.mark.parametrize("bits", [(0, 0), (2, 1)])
def test_every_context_sums_to_one(bits):
    rng = random.Random(6)
    docs = [" ".join(rng.choice("abcdefghijkl") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(0, 90))).encode() for _ in range(40)]
    sent, known = messages(docs, [i % 5 > 0 for i in range(40)], bits)
    columns = [f.name for f in pitman_yor._SCHEMA]
    cells = {k: pitman_yor.Cell.of([r["a"] for r in v]) for k, v in sent.items() if k >= 0}
    world = pitman_yor.World(20, 9)
    for k in range(4):
        told = [dict(zip(columns, r, strict=True)) for key, c in cells.items() for r in c.rows(key, bits)]
        replies, totals = collections.defaultdict(list), np.zeros(6)
        for shard in {r["key"] for r in told if r["kind"] != pitman_yor.CELL}:
            some = [r for r in told if r["kind"] != pitman_yor.CELL and r["key"] == shard]
            for r in pitman_yor.shard_rows(some, world, k == 0, np.random.default_rng(k)):
                r = dict(zip(columns, r, strict=True))
                if r["kind"] == pitman_yor.TOTALS:
                    totals += r["s"]
                else:
                    replies[r["key"]].append(r)
        world.customers, world.tables, world.words, world.tokens = totals[:4]
        for key, c in cells.items():
            c.hear(sorted(replies[key], key=lambda r: (r["kind"], r["ref"])), world)
            if k < 3:
                c.sweep(world, k + 1, np.random.default_rng([k, key]))
                assert (c.tables >= 1).all() and (c.tables <= c.n).all()
    trained = [w for i, x in enumerate(docs) if i % 5 for w in [*x.lower().split(), pitman_yor.END]]
    assert world.tokens == len(trained) and world.words == len(set(trained))
    mass, back = collections.defaultdict(float), {}
    for c in cells.values():
        for j, context in enumerate(c.contexts.tolist()):
            seen = np.flatnonzero(c.word_counts > 0)
            mass[context] += c.probability(seen, np.full(len(seen), j), world).sum()
            back[context] = (pitman_yor.STRENGTH + world.discount * c.context_tables[j]) / (pitman_yor.STRENGTH + c.customers[j])
    unknown = world.parent(np.zeros(1))[0]
    for context, m in mass.items():
        rows = {_top for _top in pitman_yor._top(known.of(sorted(set(trained))), bits[0]).tolist()}
        if sum(context in c.contexts for c in cells.values()) == len(rows):  # cells hold a context where one of its pairs falls
            assert math.isclose(m + back[context] * unknown, 1, rel_tol=1e-5)
    assert any(m > 0.9 for m in mass.values())


def test_drawn_tables_follow_their_weights():
    rng = np.random.default_rng(8)
    for n, weight, d in ((2, 0.3, 0.7), (7, 2.0, 0.5), (40, 5.0, 0.8), (64, 0.01, 0.3)):
        logs = pitman_yor.log_stirling(n, d)[n, 1:] + np.log(weight) * np.arange(1, n + 1)
        p = np.exp(logs - logs.max())
        p /= p.sum()
        t = pitman_yor.draw_tables(np.full(40_000, n), np.full(40_000, weight), d, rng)
        assert np.abs(np.bincount(t, minlength=n + 1)[1:] / 40_000 - p).max() < 0.012
    # above, by the saddle point
    for n, weight, d in ((65, 0.02, 0.7), (300, 4.0, 0.7), (300, 60.0, 0.5), (400, 900.0, 0.8)):
        logs = pitman_yor.log_stirling(n, d)[n, 1:] + np.log(weight) * np.arange(1, n + 1)
        p = np.exp(logs - logs.max())
        p /= p.sum()
        mean = (p * np.arange(1, n + 1)).sum()
        t = pitman_yor.draw_tables(np.full(20_000, n), np.full(20_000, weight), d, rng)
        assert t.min() >= 1 and t.max() <= n and abs(t.mean() - mean) < 0.06 * mean + 0.15, (n, weight, d, t.mean(), mean)
    assert pitman_yor.draw_tables(np.array([0, 1, 10**9]), np.array([1.0, 1.0, 5.0]), 0.6, rng)[:2].tolist() == [0, 1]


def test_tables_make_further_tables_likelier():
    rng = np.random.default_rng(9)
    for n, weight, d, grows in ((3, 0.3, 0.7, (0.9, 4.0)), (12, 0.05, 0.5, (0.5, 30.0)), (50, 0.01, 0.8, (2.0, 9.0))):
        i = np.arange(n)
        logs = pitman_yor.log_stirling(n, d)[n, 1:] + np.cumsum(np.log(weight * (1 + grows[0] * i) * (1 + grows[1] * i)))
        p = np.exp(logs - logs.max())
        t = pitman_yor.draw_tables(np.full(40_000, n), np.full(40_000, weight), d, rng, grows=tuple(np.full(40_000, g) for g in grows))
        assert np.abs(np.bincount(t, minlength=n + 1)[1:] / 40_000 - p / p.sum()).max() < 0.012


def test_seatings_of_many_customers():
    for d in (0.1, 0.5, 0.8, 0.95):
        exact = pitman_yor.log_stirling(300, d)
        n, t = (x.ravel() for x in np.meshgrid([65, 130, 300], [1, 2, 4, 11, 30, 60]))
        assert np.abs(pitman_yor.log_big_stirling(n, t, d) - exact[n, t]).max() < 0.02
        some = np.array([1, 2, 9, 64]), np.array([1, 1, 4, 30])
        assert np.allclose(pitman_yor.log_dishes(*some, np.array([d])), exact[some].sum())
    assert np.allclose(pitman_yor.log_gamma(np.array([0.01, 0.5, 7, 900])), [math.lgamma(x) for x in (0.01, 0.5, 7, 900)])
    got = pitman_yor.log_restaurants(np.array([3, 1]), np.array([5, 2]), np.array([0.4]), np.array([2.0]))
    assert math.isclose(got[0, 0], math.log((2.4 * 2.8) / (3 * 4 * 5 * 6) / 3))


def test_discounts_and_strengths_are_drawn():
    """From tables that were opened with a known discount and strength, by a start far from them."""
    rng, d, strength = np.random.default_rng(10), 0.7, 3.0
    n, t, tables, customers = [], [], [], []
    for _ in range(300):
        sizes = []
        for _ in range(int(rng.integers(1, 150))):
            w = np.array([*[x - d for x in sizes], strength + d * len(sizes)])
            k = int(rng.choice(len(w), p=w / w.sum()))
            sizes[k : k + 1] = [sizes[k] + 1] if k < len(sizes) else [1]
        dish = rng.integers(0, 20, len(sizes))
        tables.append(len(sizes))
        customers.append(sum(sizes))
        for v in set(dish.tolist()):
            n.append(int(np.array(sizes)[dish == v].sum()))
            t.append(int((dish == v).sum()))
    n, t, tables, customers = (np.array(x) for x in (n, t, tables, customers))
    at, seen = (0.3, 0.5), []
    for _ in range(40):
        w = pitman_yor.Window(*at, rng)
        at = w.draw(pitman_yor.log_dishes(n, t, w.discounts)[:, None] + pitman_yor.log_restaurants(tables, customers, w.discounts, w.strengths), rng)
        seen.append(at)
    mean, spread = np.mean(seen[10:], axis=0), np.std(seen[10:], axis=0)
    assert abs(mean[0] - d) < 0.03 and abs(mean[1] - strength) < 1 and (spread > 0).all()


def test_predictions_are_averaged_over_sweeps():
    docs = [b"a b a c a b", b"b a b c", b"a b a b a c", b"c c a"] * 3
    sent, _ = messages(docs, [True] * 12)
    cell = pitman_yor.Cell.of([r["a"] for r in sent[0]])
    columns, world, each = [f.name for f in pitman_yor._SCHEMA], pitman_yor.World(3, 2), []
    words = np.arange(len(cell.words)).repeat(len(cell.contexts))
    contexts = np.tile(np.arange(len(cell.contexts)), len(cell.words))
    for k in range(3):
        told = [dict(zip(columns, r, strict=True)) for r in cell.rows(0, (0, 0))]
        cell = pitman_yor.Cell.load(told[0])
        said = [dict(zip(columns, r, strict=True)) for r in pitman_yor.shard_rows(told[1:], world, k == 0, np.random.default_rng(k))]
        world.customers, world.tables, world.words, world.tokens = next(r["s"] for r in said if r["kind"] == pitman_yor.TOTALS)[:4]
        cell.hear(sorted((r for r in said if r["kind"] != pitman_yor.TOTALS), key=lambda r: (r["kind"], r["ref"])), world)
        each.append(cell.probability(words, contexts, world))
        if k < 2:
            cell.keep()
            world.keep()
            cell.sweep(world, 1, np.random.default_rng(k))
            world.discount, world.strength = 0.4 + 0.1 * k, 1.0 + k
    assert np.abs(each[0] - each[2]).max() > 0.01
    assert np.allclose(cell.average(words, contexts, world), np.mean(each, axis=0), rtol=1e-5)


def discounted_bigram(train, held, d=0.75):
    """log10 of held-out texts under an interpolated bigram with absolute discounts, over continuation counts."""
    end, pairs, after, kinds, contexts = None, collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    tokens = lambda x: [*x.lower().split(), end]
    for x in train:
        last = end
        for w in tokens(x):
            pairs[last, w] += 1
            after[last] += 1
            last = w
    for u, w in pairs:
        kinds[u] += 1
        contexts[w] += 1
    n, v = len(pairs), len(contexts)
    total = 0.0
    for x in held:
        last = end
        for w in tokens(x):
            low = (max(contexts[w] - d, 0) + d * v / (v + 1)) / n
            total += math.log10((max(pairs[last, w] - d, 0) + d * kinds[last] * low) / after[last] if after[last] else low)
            last = w
    return total


def test_word_contexts_beat_a_plain_bigram(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    df = make(spark, docs)
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(df, quality.remainder(F.col("doc_id"), 7) != 2).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    plain = discounted_bigram([t for (_, t), h in zip(docs, held, strict=True) if not h], [t for (_, t), h in zip(docs, held, strict=True) if h])
    assert sum(got[i] for (i, _), h in zip(docs, held, strict=True) if h) > plain * 1.01
