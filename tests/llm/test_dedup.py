"""Near-duplicates, substrings and vectors against brute force."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from memloom.llm import graph, minhash, substrings, vectors


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == roots(ids, [x for x in links if x[0] != x[1]])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k", (2, 5))
def test_near_duplicates(docs, none, rows, k):
    got = minhash.near_duplicates(docs, k=k).collect()
    sets = {i: shingle_set(t, k) for i, t, *_ in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert len(links) > 50
    assert minhash.near_duplicates(none).count() == 0


def test_large_clusters_in_blocks(spark, rows, monkeypatch):
    """Blocks of four: clusters larger than a block need the step across blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "SET_BLOCK", 4)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    own = [(i, t) for i, t, *_ in rows if i is not None and 10 <= i < 40]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, k=2).collect()}
    sets = {i: shingle_set(t, 2) for i, t in own}
    assert got == roots(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])


def test_superminhash_estimates():
    rng = np.random.default_rng(3)
    for n, share in ((5, 0.6), (60, 0.8), (3000, 0.5)):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)])) for _ in range(2))
            s = minhash.superminhash([a, b, a])
            assert (s[0] == s[2]).all()
            errors.append((s[0] == s[1]).mean() - len(both) / (2 * n - len(both)))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    assert (minhash.superminhash([np.zeros(0, np.uint64)]) == 0xFFFFFFFF).all()


def removed(rows, window):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    split = [(t or "").encode().split() for _, t, *_ in rows]
    for k in order:
        i = rows[k][0] if rows[k][0] is not None else substrings.LAST
        for p in range(len(split[k]) - window + 1):
            seen.setdefault(tuple(split[k][p : p + window]), (i, p))
    for k, w in enumerate(split):
        i = rows[k][0] if rows[k][0] is not None else substrings.LAST
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] < (i, p):
                gone.update(range(p, p + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((rows[k][0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window", (20, 6))
def test_substrings(docs, none, rows, window):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substrings.remove_repeats(docs, window).collect())
    assert got == removed(rows, window)
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_of_runs_and_small_alphabets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b"] if i % 2 else ["a", "a", "a", "c"]) for _ in range(rng.randrange(10, 400)))) for i in range(60)]
    rows += [(100 + i, "z " * (19 + i)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substrings.remove_repeats(docs, 20).collect())
    assert got == removed(rows, 20)


def test_substrings_keep_columns(docs):
    got = substrings.remove_repeats(docs, keep=("source", "data"), unchanged=True)
    assert got.columns == ["doc_id", "source", "data", "n_words", "n_removed", "kept_text"]
    assert got.where("doc_id = 3").first()["kept_text"] == " \t\n "


def brute_vectors(rows, least=0.95):
    unit = {i: u for (i, v), u in zip(rows, vectors.unit_vectors([v for _, v in rows])) if u is not None and i is not None}
    links = [(a, b) for a, b in itertools.combinations(sorted(unit), 2) if len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least]
    count = Counter(x for p in links for x in p)
    root = roots({i for i, _ in rows if i is not None}, links)
    return {i: (count[i], root[i]) for i in root}


@pytest.mark.parametrize("block", (512, 8))
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        centre = rng.normal(size=64)
        first = len(rows)
        rows += [(first + j, (centre + rng.normal(size=64) * rng.choice([0, 0.1, 0.25])).tolist()) for j in range(rng.integers(1, 25))]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 64), (n + 2, [float("nan")] * 64), (n + 3, [None, *[1.0] * 63]), (n + 4, [float("inf"), *[0.0] * 63]), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (n + 7, []), (n + 8, [1e200] * 64), (n + 9, [1e-200] * 64), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, unit string").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicate_vectors(df).collect()}
    assert got.pop(None) == (0, None)
    want = brute_vectors(rows)
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert true > 500 and found >= 0.99 * true
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert vectors.near_duplicate_vectors(df.where("n > 5")).count() == 0
    assert vectors.near_duplicate_vectors(df.union(df).where("vec_id < 20")).agg({"n_links": "sum"}).first()[0] == 2 * sum(brute_vectors(rows[:20])[i][0] for i in range(20))


def test_equal_vectors_count_each_other(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(5)] + [(9, [1.0, 2.0, 3.0001])] + [(20, [3.0, -1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (5, 0, i == 0) for i in range(5)}, 9: (5, 0, False), 20: (0, 20, True)}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(7, 16)).astype(np.float32)
    y = vectors.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), rtol=1e-5) and np.allclose(vectors.hadamard(y), x, atol=1e-5)
    assert defaultdict(int) == {}


def test_substrings_null_ids(spark):
    """Rows with a null id, and rows of several texts under one id, don't share what was found in another."""
    rng = random.Random(6)
    text = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(n)) for n in (60, 60, 300, 25, 40, 30)]
    passage = " ".join(text[4].split()[:30])
    rows = [(1, text[0]), (None, text[0]), (None, text[1]), (None, text[2] + " " + passage), (None, text[3]), (None, passage), (7, text[4])]
    rows += [(None, text[5]), (None, text[5]), (None, text[5] + " x " + text[5]), (None, None)]
    alone = {text[0]: 60, text[2] + " " + passage: 30, passage: 30, text[5] + " x " + text[5]: 30}
    want = Counter((i, len((t or "").split()), alone.get(t, 0) if i is None else 0) for i, t in rows)
    for parts in (1, 6):
        got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in got.collect()) == want
    both = spark.createDataFrame([(1, passage), (2, text[2] + " " + passage), (2, text[3]), (1 << 62, text[0]), (-5, text[0])], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(both).collect())
    assert got == Counter([(1, 30, 0), (2, 330, 30), (2, 25, 0), (1 << 62, 60, 60), (-5, 60, 0)])


@pytest.mark.parametrize("parts", (1, 5))
def test_substrings_of_repeated_ids(spark, parts):
    """Texts under one id have verdicts of their own, and only the start decides between them."""
    rng = random.Random(9)
    text = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(n)) for n in (60, 45, 80, 30)]
    rows = [(1, text[0]), (2, text[0]), (2, text[1]), (2, text[1]), (3, text[2] + " " + text[3]), (3, text[3]), (3, text[2]), (4, text[1] + " " + text[2]), (4, text[0] + " tail")]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect())
    # of document 3's two places of text[3], the earlier start is in the text that has nothing else
    assert got == Counter([(1, 60, 0), (2, 60, 60), (2, 45, 0), (2, 45, 0), (3, 110, 30), (3, 30, 0), (3, 80, 0), (4, 125, 125), (4, 61, 60)])
