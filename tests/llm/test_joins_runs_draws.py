"""Similarity join of vectors, periodic runs and importance resampling against plain versions and on awkward rows."""

import math
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from flowlark.llm import embedding, periodic, resample
from flowlark.llm.embedding import near_vectors
from flowlark.llm.order import in_order
from flowlark.llm.periodic import digested, lyndon_lengths, periodic_runs, planted, runs_of
from flowlark.llm.resample import importance_resample, kth_key
from tests.compare import checker, differences
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_epsilon_grid", "op12_periodic_runs", "op13_importance_resampling"])
def test_against_sql(spark, name):
    assert differences(entry.queries()[name](spark, FOLDER), checker(FOLDER), entry.oracle_sql()[name]) == []


def plain_links(rows, cosine):
    good = [(k, np.array(v, float)) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=1)
    x = np.zeros((len(good), width))
    for i, (_, v) in enumerate(good):
        x[i, : len(v)] = v / np.abs(v).max()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    root = list(range(len(good)))
    for _ in range(len(good)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))], key=lambda r: good[r][0]) for i in range(len(good))]
        if new == root:
            break
        root = new
    out = [(good[i][0], int(near[i].sum()), good[root[i]][0], good[i][0] == good[root[i]][0]) for i in range(len(good))]
    rest = list(rows)
    for k, v in good:
        rest.remove(next(r for r in rest if r[0] == k and r[1] is not None and len(r[1]) <= width and all(e is not None and math.isfinite(e) for e in r[1]) and any(r[1])))
    return sorted(out + [(k, 0, k, k is not None) for k, _ in rest], key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_links_of_clusters_and_copies(spark, monkeypatch):
    for name, small in (("SHORT", 8), ("LEAST_BLOCK", 16), ("CHUNK", 8), ("BLOCK_BYTES", 16 * 8 * 6)):
        monkeypatch.setattr(embedding, name, small)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    rows = []
    for i in range(400):
        v = centres[i % 12] + rng.normal(size=6) * rng.choice([0.0, 0.05, 0.4, 3.0])
        rows.append((int(i * 7 % 400), [float(np.float32(x)) for x in v * rng.choice([1, 100])]))
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(5, rows[3][1])]
    got = sorted((tuple(r) for r in near_vectors(vectors(spark, rows)).collect()), key=repr)
    assert got == plain_links(rows, 0.95)


def test_intervals_in_one_ball_are_counted_whole():
    rng = np.random.default_rng(1)
    x = np.array([1.0, 0, 0]) + rng.normal(size=(3000, 3)) * 0.001
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side, links, parent = embedding.Side(x, x[:, :2], np.full(3000, 2), 0), np.zeros(3000, np.int64), np.arange(3000)
    embedding.join_intervals(side, side, math.sqrt(0.1), 0.95, links, parent)
    assert (links == 2 * 2999).all() and (embedding.roots(parent, np.arange(3000)) == 0).all()
    assert len(side.known) == 1


def test_awkward_vectors(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0, 0.0]), (9, [1e-30, 0.0]), (9, [0.0, 1.0]), (10, [-1.0, 0.0])]
    got = sorted((tuple(r) for r in near_vectors(vectors(spark, rows)).collect()), key=repr)
    assert got == plain_links(rows, 0.95)
    assert (7, 2, 7, True) in got and (8, 2, 7, False) in got
    clash = vectors(spark, rows).selectExpr("*", "1 AS node", "2 AS weight", "3 AS x", "4 AS block", "5 AS component")
    assert sorted((tuple(r) for r in near_vectors(clash).collect()), key=repr) == got
    empty = near_vectors(vectors(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert near_vectors(vectors(spark, rows[:6])).where("n_links = 0 AND kept").count() == 6


def plain_runs(words, least=6, exponent=4):
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def repetitive(rng, size):
    alphabet, out = rng.choice([1, 2, 3, 6]), []
    while len(out) < size:
        word = [rng.randrange(alphabet) for _ in range(rng.randint(1, 7))]
        out += word * rng.choice([1, 1, 3, 4, 6]) + word[: rng.randint(0, len(word))]
    return out


def test_lyndon_lengths_and_runs():
    rng = random.Random(3)
    for _ in range(300):
        texts = [repetitive(rng, rng.choice([0, 1, 9, 60])) for _ in range(3)]
        firsts = np.r_[0, np.cumsum([len(t) for t in texts])]
        codes = np.array([c for t in texts for c in t], np.int64)
        heads = [i in set(firsts[:-1].tolist()) for i in range(len(codes))]
        want = []
        for t in texts:
            for i in range(len(t)):
                want.append(next((j - i for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t) - i))
        assert lyndon_lengths(codes.tolist(), heads)[0] == want
        got = list(zip(*(x.tolist() for x in runs_of(codes, firsts))))
        assert got == [(f + a, n, q) for f, t in zip(firsts.tolist(), texts) for a, n, q in plain_runs(t)]


def plain_row(doc, text):
    words = brute.words(text)
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return (doc, len(runs), *best, milli, brute.sha(lines.encode()), brute.sha(" ".join(kept).encode()))


def test_runs_of_awkward_texts(spark):
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a " * 9), (4, "a b " * 20000), (5, "x" * 50000), (5, "né né né né né né"), (5, "né né né né né né"), (6, "a b " * 8), (7, "p q p q p q p")]
    rows += [(100 + i, " \t".join(map(str, repetitive(rng, 50)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in digested(periodic_runs(docs)).collect()), key=repr)
    long = [r for r in rows if r[0] == 4][0]
    want = [plain_row(*r) for r in rows if r is not long] + [(4, 1, 0, 40000, 2, 20000000, brute.sha(b"0,40000,2\n"), brute.sha(b"a b"))]
    assert got == sorted(want, key=repr)
    clash = docs.selectExpr("*", "1 AS runs", "2 AS n_words", "3 AS kept_text")
    assert sorted((tuple(r) for r in digested(periodic_runs(clash)).collect()), key=repr) == got
    assert periodic_runs(docs.limit(0)).collect() == []
    assert {r.doc_id: r.kept_text for r in periodic_runs(docs, texts=True).collect()}[4] == "a b"
    with pytest.raises(ValueError):
        periodic_runs(docs, exponent=2)


def test_planted_repeats(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b")]
    want = {}
    for doc, text in rows:
        words, h = text.split(), zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            text = " ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])
        want[doc] = text
    assert {r.doc_id: r.text for r in planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def plain_draw(docs, target, run=1, buckets=10000, least=20, percent=10, seed=2024):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")
        words = [w for w in words if w]
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(words) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in features(text)[1]:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        n, own = features(text)
        weight = sum(gain[b] for b in own)
        h = int(brute.sha(f"{seed}:{doc}".encode())[:8], 16)
        rows.append((doc, len(own), weight, None if doc is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    k = percent * len(fit) // 100
    drawn = [(*r[:4], i + 1) for i, r in enumerate(fit[:k])]
    rest = [r for r in rows if r[4] < least or r[0] is None] + fit[k:]
    return sorted(drawn + [(*r[:4], None) for r in rest], key=repr)


@pytest.mark.parametrize("run", [1, 3])
def test_draw_on_awkward_rows(spark, run):
    rng = random.Random(run)
    words = ["Alpha", "beta", "x-1", "É", "ab'c", "99", " ", "Zz\x00q"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(None, "alpha beta " * 30), (400, None), (401, ""), (402, "beta " * 30000)] + [(7, "beta x " * 15)] * 40
    target = ["beta beta É", None, "", "99 alpha"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in importance_resample(docs, goal, run=run).collect()), key=repr)
    assert got == plain_draw(rows, target, run)
    clash = docs.selectExpr("*", "1 AS score", "2 AS rank", "3 AS worse", "4 AS place", "5 AS weight")
    assert sorted((tuple(r) for r in importance_resample(clash, goal, run=run).collect()), key=repr) == got


def test_draw_from_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance_resample(none, none.select("text")).collect() == []
    some = spark.createDataFrame([(i, "a b " * 15) for i in range(30)], "doc_id long, text string")
    assert importance_resample(some, none.select("text")).where("rank IS NOT NULL").count() == 3
    assert importance_resample(some, some.select("text"), percent=0).where("rank IS NOT NULL").count() == 0
    assert importance_resample(some, some.select("text"), percent=100).where("rank IS NULL").count() == 0


def test_kth_key_and_places(spark):
    rng = random.Random(2)
    rows = [(rng.randint(-3, 3), rng.randint(0, 40)) for _ in range(700)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    for k in (1, 2, 350, 699, 700):
        assert kth_key(df, ["a", "b"], k, pivots=3) == sorted(rows)[k - 1]
    placed = in_order(df, [df["a"], df["b"]]).collect()
    assert [(r.a, r.b) for r in sorted(placed, key=lambda r: r.position)] == sorted(rows)
    assert sorted(r.position for r in placed) == list(range(700))
