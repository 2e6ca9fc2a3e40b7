"""Every query against its contract and a brute-force version, at more than one number of partitions."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from memloom.llm import langid, minhash, mixing, pitmanyor, queries, toxicity, vectors
from memloom.llm import textblocks as tb
from memloom.llm.shared import fold
from tests.llm.test_dedup import brute_vectors, removed, roots, shingle_set

DATA = "/root/testdata/sf0.001"


def held(i, n=5):
    return zlib.crc32(str(i).encode()) % n


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


def word_hash(word):
    return int(tb.span_hash(tb.running_hash(np.frombuffer(word, np.uint8)), np.array([0]), np.array([len(word)]))[0])


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.fixture(params=(4, 9))
def run(request, spark):
    """Runs a query with so many shuffle partitions."""
    had = spark.conf.get("spark.sql.shuffle.partitions")

    def go(name):
        spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
        return queries.QUERIES[name](spark, DATA).collect()

    yield go
    spark.conf.set("spark.sql.shuffle.partitions", had)


def test_op1_is_the_nearest_centroid(spark, run, documents):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs, fold("doc_id", 5) != 0)
    got = {r["doc_id"]: r for r in run("op1_language_id")}
    assert len(got) == len(documents) and sorted(set(model.langs)) == sorted({x for _, _, x, _ in documents if x})
    for i, text, _, _ in documents[::4]:
        letters = [c + 32 if 65 <= c <= 90 else c if langid.LETTERS[c] else 32 for c in text.encode()]
        for k in range(len(letters) - 1):
            if letters[k] == 0xC3 and 0x80 <= letters[k + 1] <= 0x9E and letters[k + 1] != 0x97:
                letters[k + 1] += 32
        count = Counter()
        for order in (2, 3):
            for k in range(len(letters) - order + 1):
                code = 0
                for x in letters[k : k + order]:
                    code = code * 257 + x
                count[(code * 2654435761 & 0xFFFFFFFF) >> 19] += 1
        v = np.zeros(langid.DIMS)
        for k, n in count.items():
            v[k] = math.sqrt(n) * model.idf[k]
        cos = model.centroids @ (v / max(np.linalg.norm(v), 1e-12))
        near = max(range(len(cos)), key=lambda j: cos[j])
        assert got[i]["held_out"] == (held(i) == 0) and abs(got[i]["score"] - cos[near]) < 1e-4
        assert got[i]["lang_pred"] == model.langs[near] or cos[near] - max(c for c, x in zip(cos, model.langs, strict=True) if x == got[i]["lang_pred"]) < 1e-5


def test_op2_stores_what_it_read(run, documents):
    got = {r["doc_id"]: r for r in run("op2_media_columns")}
    for i, text, _, _ in documents:
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["media_bytes"] == 44 + len(padded) and f"samples={len(padded)};" in r["feature"] and r["detected"] == "audio/wav" and r["corrected"]


def test_op3_removes_what_started_earlier(run, documents):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run("op3_recompression"))
    assert got == removed(documents, 20) and sum(x[2] > 0 for x in got) > 5


def test_op4_is_the_noisy_or_of_sentences(spark, run, documents):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    got = {r["doc_id"]: r for r in run("op4_toxicity")}
    for i, text, _, _ in documents[::4]:
        clean = 1.0
        for part in re.split(rb"[\n\r!.?]", text.encode().lower()):
            own = re.findall(rb"[a-z\x80-\xff]+", part)
            if own:
                z = model.bias
                for w in own:
                    for k, n in enumerate(toxicity.KINDS):
                        z += model.weights[int(tb.mix(np.array([word_hash(w[:n])], np.uint64), k)[0]) & (toxicity.DIMS - 1)]
                clean /= 1 + math.exp(max(-30, min(30, z)))
        want = model.base if model.base is not None else 1 - clean
        r = got[i]
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (held(i) == 0)


def test_op4_on_held_out_labels(spark):
    at = "/root/testdata/sf0.1"  # below that, half a dozen held-out rows are toxic
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = [r for r in queries.op4_toxicity(spark, at).collect() if r["held_out"] and r["doc_id"] in label]
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in got]) > 0.97
    bad = [r["predicted"] for r in got if label[r["doc_id"]]]
    assert len(bad) > 50 and np.mean(bad) > 0.8


def test_op5_is_what_tiktoken_says(run, documents):
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, *_ in documents:
        ids = reference.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:4] for r in run("op5_byte_bpe")) == want


def test_op6_numbers_all_ids(run, documents):
    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    got, start = {r["doc_id"]: r for r in run("op6_id_store")}, 0
    for i, text, *_ in sorted(documents):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op7_finds_every_component(run, documents):
    sets = {i: shingle_set(t, 2) for i, t, *_ in documents}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    assert links and {tuple(r) for r in run("op7_superminhash")} == {(i, len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_op8_is_the_sampled_model(run, documents):
    """Counts and base by hand; the score by the sampler in one task, with the same names and so the same draws."""
    split = {i: [*words((t or "").encode().lower().decode() if t else t), None] for i, t, *_ in documents}
    split = {i: [w.lower() if w else w for w in x] for i, x in split.items()}
    count = Counter(w for i, x in split.items() if held(i, 7) != 2 for w in x)
    n, v = sum(count.values()), len(count)
    number = {w: k for k, w in enumerate(dict.fromkeys(w for x in split.values() for w in x))}
    names = np.array([int(pitmanyor.END) if w is None else word_hash(w) for w in number], np.uint64)
    pairs = {i: list(zip(x, [None, *x[:-1]], strict=True)) for i, x in split.items()}
    seen = Counter(p for i, x in pairs.items() if held(i, 7) != 2 for p in x)
    keys = list(dict.fromkeys(p for x in pairs.values() for p in x))
    w, u, c = np.array([number[a] for a, _ in keys]), np.array([number[b] + 1 for _, b in keys]), np.array([seen[k] for k in keys], float)
    context_n = np.concatenate([[0], np.bincount(w, weights=c, minlength=len(number))])
    once, twice = (sum(x == k for x in count.values()) for k in (1, 2))
    discount = min(0.95, max(0.1, once / (once + 2 * twice)))
    mean, root_c, root_t, totals = pitmanyor.sample(w, u, c, len(number), context_n, v, discount, names=(names, np.concatenate([[np.uint64(0)], names])))
    parent = (root_c - discount * root_t + (1 + discount * totals[0]) / (v + 1)) / (1 + totals[-1])
    new = (1 + 0.75 * totals[:-1]) / (1 + context_n[:, None])
    p = dict(zip(keys, (c - 0.75 * mean) / (1 + context_n[u]) + (new[u] * parent[w]).mean(axis=1), strict=True))
    for r in run("op8_pitman_yor"):
        x = split[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"], 7) == 2, len(x), sum(count[y] > 0 for y in x), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[y] + 1) / (n + v + 1)) for y in x), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p[k]) for k in pairs[r["doc_id"]]), rel_tol=1e-6)


def test_op9_counts_every_link(spark, run):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = brute_vectors(rows)
    got = {r["vec_id"]: r for r in run("op9_cross_polytope")}
    found = sum(got[i]["n_links"] for i in want)
    assert found >= 0.99 * sum(x[0] for x in want.values()) and all(got[i]["n_links"] <= want[i][0] for i in want)
    assert np.mean([got[i]["component_id"] == want[i][1] for i in want]) > 0.99 and all(got[i]["kept"] == (got[i]["component_id"] == i) for i in want)


def test_op10_meets_the_targets(run, documents):
    got = {r["doc_id"]: r for r in run("op10_mix_sources")}
    size, total = {i: len(words(t)) for i, t, *_ in documents}, Counter()
    for i, _, _, s in documents:
        total[s] += size[i]
    target, taken, largest = mixing.targets(list(total.items())), Counter(), Counter()
    for i, _, _, s in documents:
        r = got[i]
        assert (r["size"], r["source_size"]) == (size[i], total[s]) and abs(r["target"] - target[s]) < 1e-6 and r["taken"] == r["copies"] * size[i] <= 3 * size[i]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], size[i])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in total) and abs(sum(target.values()) - sum(total.values())) < 1e-6


@pytest.mark.parametrize("name", ("op8_pitman_yor", "op10_mix_sources"))
def test_partitions_change_nothing(spark, name):
    had, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 9):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append(sorted(queries.QUERIES[name](spark, DATA).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert found[0] == found[1]


def test_pipeline_against_brute_force(spark, documents):
    """Each stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda d: [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in d.collect()]

    clean = stages["toxicity"](spark, docs, DATA)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), fold("doc_id", 5) != 0)).collect()}
    before = rows(clean)
    assert Counter(before) == Counter(d for d in documents if scores[d[0]] < 0.5)

    one = stages["near_dedup"](spark, clean, DATA)
    sets = {i: shingle_set(t, 5) for i, t, *_ in before}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root, after = roots(sets, links), rows(one)
    assert Counter(after) == Counter(d for d in before if root[d[0]] == d[0])

    kept = stages["substring_dedup"](spark, one, DATA)
    left, have = rows(kept), {d[0]: d for d in after}
    want = {i: (n, gone, sha) for i, n, gone, sha in removed(after, 20)}
    assert {d[0] for d in left} == {i for i, (n, gone, _) in want.items() if n == 0 or gone < n}
    for i, text, *_ in left:
        n, gone, sha = want[i]
        assert text == have[i][1] if not gone else hashlib.sha256(text.encode()).hexdigest() == sha

    mixed = stages["mix"](spark, kept, DATA)
    many, source = Counter(rows(mixed)), {d: d[3] for d in left}
    assert set(many) <= set(source) and max(many.values()) <= 3
    sizes = Counter()
    for d in left:
        sizes[d[3]] += len(words(d[1]))
    target, taken = mixing.targets(list(sizes.items())), Counter()
    for d, k in many.items():
        taken[d[3]] += k * len(words(d[1]))
    assert all(abs(taken[s] - target[s]) <= max(len(words(d[1])) for d in left if d[3] == s) for s in sizes)

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in stages["encode"](spark, mixed, DATA).collect())
    assert got == Counter({(i, tuple(t.encode(x, add_special_tokens=False).ids)): k for (i, x, *_), k in many.items()})


def test_taken_rows_keep_clashing_columns(spark, docs):
    got = mixing.taken_rows(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    clash = docs.select("doc_id", "text", "source", F.lit(1).alias("h1"), F.lit("x").alias("row"), F.lit(2).alias("times"), F.lit(3).alias("number"))
    assert mixing.taken_rows(clash).columns == clash.columns


def test_equal_rows_are_numbered(spark):
    """Most rows are empty texts without an id, and are spread over groups all the same."""
    rows = spark.range(100_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("some words "), "id")).otherwise("").alias("text"), F.lit("s").alias("source")).repartition(7)
    sized = mixing.word_counts(rows).cache()
    for parts in (sized, sized.repartition(3)):
        got = mixing.numbered(parts).where("doc_id is null").select("number").collect()
        assert sorted(r["number"] for r in got) == list(range(90_000))
    mixed = mixing.mix_sources(rows)
    assert mixed.count() == 100_000 and abs(mixed.agg(F.sum(F.col("copies") * F.col("size"))).first()[0] - 30_000) <= 3
    out = mixing.taken_rows(rows)
    assert out.where("text = ''").count() == mixed.where("size = 0").agg(F.sum("copies")).first()[0]
    near = minhash.near_duplicates(rows, k=5)
    assert near.count() == 100_000 and near.where("n_shingles = 0 and kept").count() == 90_000


def test_hot_keys_are_dealt_out(spark, monkeypatch, request):
    """One group holds most of all documents, and another most of all vectors: their keys are hot, and nothing is lost."""
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", had))
    monkeypatch.setattr(minhash, "BLOCK", 32)
    monkeypatch.setattr(minhash, "SET_BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(420):
        w = list(base) if i % 6 else [f"w{rng.randrange(500)}" for _ in range(150)]
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    table = minhash.signatures(docs, 2)
    assert len(tb.hot_keys(table, 32, "bands")) > 0
    sets = {i: shingle_set(t, 2) for i, t in rows}
    want = roots(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, k=2).collect()} == want
    monkeypatch.setattr(vectors, "BLOCK", 16)
    gen = np.random.default_rng(5)
    centre = gen.normal(size=32)
    own = [(i, (centre + gen.normal(size=32) * 0.12 if i % 5 else gen.normal(size=32)).tolist()) for i in range(300)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicate_vectors(spark.createDataFrame(own, "vec_id long, embedding array<double>").repartition(2)).collect()}
    true = brute_vectors(own)
    total = sum(x[0] for x in true.values())
    assert total > 20_000 and total >= sum(x[0] for x in got.values()) >= 0.99 * total and all(got[i][0] <= true[i][0] for i in true)
    assert np.mean([got[i][1] == true[i][1] for i in true]) > 0.97


def test_many_short_texts_are_few_rows_at_a_time():
    """10,000 one-letter texts make no matrix of 10,000 rows."""
    assert max(j - i for i, j in tb.blocks(np.arange(10_001), 1 << 20, langid.ROWS)) == langid.ROWS
    assert defaultdict(int) == {}
