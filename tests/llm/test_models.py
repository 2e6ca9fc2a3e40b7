"""Classifiers, the language model, media, mixing and the pipeline."""

import gzip
import hashlib
import io
import math
import random
import struct
import time
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memloom.llm import langid, media, mixing, pitmanyor, queries, toxicity
from memloom.llm.shared import fold

DATA = "/root/testdata/sf0.001"


def held(i, n=5):
    return zlib.crc32(str(i).encode()) % n


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_cases(spark, docs, none):
    model = langid.fit(docs, F.col("doc_id") != 0)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).where("doc_id is not null").collect()}
    assert len(got) == docs.where("doc_id is not null").select("doc_id").distinct().count()
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[60]["lang_pred"] == "fr" and got[10]["lang_pred"] == "en"
    digits = spark.createDataFrame([(1, "123 😀 !"), (2, "漢字")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(digits, model).orderBy("doc_id").collect()][0] == "und"
    assert langid.predict(digits, model, reject=True).where("doc_id = 2").first()["lang_pred"] == "und"
    assert langid.predict(none, model).count() == 0
    empty = langid.fit(none, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
    with_null = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert with_null.langs == []


def toxic_rows(n=900):
    rng, rows, labels = random.Random(8), [], []
    for i in range(n):
        sentences = [" ".join(f"w{rng.randrange(300)}" for _ in range(8)).capitalize() for _ in range(rng.randrange(1, 9))]
        bad = rng.random() < 0.2
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] += f" {rng.choice(['idiotic', 'idiots', 'moron', 'scum'])} ok"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_sentences(spark):
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, fold("doc_id", 5) != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    test = [i for i, _ in rows if held(i) == 0]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in test]) > 0.97
    for i in test:
        if labels[i][1] and got[i]["predicted"]:
            text = rows[i][1].encode()
            spans = [text[s["start"] : s["end"]].decode().lower() for s in got[i]["offending"]]
            assert any(w in x for x in spans for w in ("idiot", "moron", "scum")) and all(len(x) < len(text) or "." not in rows[i][1][:-1] for x in spans)
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(not r["predicted"] for r in got.values())


def test_toxicity_cases(spark, docs, none):
    labels = spark.createDataFrame([(10, 1), (10, 0), (11, 0), (None, 1), (12, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(docs, model).toPandas()
    assert got.score.between(0, 1).all() and got[got.doc_id.isin([1, 2, 3])].score.max() <= 0.5 and len(got) == docs.count()
    nothing = toxicity.fit(docs, labels.where("false"), F.lit(True))
    assert toxicity.score(docs, nothing).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(none, model).count() == 0 and toxicity.keep_clean(none, model).count() == 0
    assert toxicity.keep_clean(docs, nothing).columns == docs.columns


def test_language_model_counts(spark, docs, none, rows):
    got = defaultdict(list)
    for r in pitmanyor.score(docs, 2, 7).collect():
        got[r["doc_id"]].append(r)
    count = Counter()
    split = [(i, (t or "").encode().lower().split() + [None]) for i, t, *_ in rows]
    for i, w in split:
        if i is not None and held(i, 7) != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = Counter((i, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in split)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for x in got.values() for r in x) == want
    assert all(r["score"] < 0 and np.isfinite(r["score"]) and r["held_out"] == (i is not None and held(i, 7) == 2) for i, x in got.items() for r in x)
    assert pitmanyor.score(none).count() == 0


def test_language_model_is_a_distribution():
    """The predictive probabilities of all words and the unknown one add up, in a context and at the root."""
    rng = np.random.default_rng(1)
    words, contexts = 50, 3
    pairs = [(w, u) for w in range(words) for u in range(contexts + 1)]
    n = rng.poisson(3, len(pairs)).astype(float)
    pw, pu = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    context_n = np.concatenate([[0], [n[pu == u].sum() for u in range(1, contexts + 1)]])
    vocabulary = int((np.bincount(pw, weights=n) > 0).sum())
    mean, c, t, totals = pitmanyor.sample(pw, pu, n, words, context_n, vocabulary, 0.6, 3)
    root_t, root_n, base = totals[0], totals[-1], 1 / (vocabulary + 1)
    parent = (c - 0.6 * t) / (1 + root_n) + (1 + 0.6 * root_t) / (1 + root_n) * base
    seen = np.bincount(pw, weights=n) > 0
    unknown = (1 + 0.6 * root_t) / (1 + root_n) * base
    assert np.allclose(parent[seen].sum(axis=0) + unknown, 1)
    for u in range(1, contexts + 1):
        own = pu == u
        inside = (n[own] - 0.75 * mean[own]) / (1 + context_n[u])
        new = (1 + 0.75 * totals[u]) / (1 + context_n[u])
        p = inside + (new * parent[pw[own]]).mean(axis=1)
        assert math.isclose(p[seen[pw[own]]].sum() + (new * unknown).mean(), 1, rel_tol=1e-9)
    assert (mean <= n + 1e-9).all() and ((mean >= 1 - 1e-9) | (n == 0) | (pu == 0)).all()


def test_language_model_beats_the_base(spark):
    got = pitmanyor.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 2, 7).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_language_model_learns_every_context(spark, monkeypatch):
    """Words far too rare for a share of the corpus predict what follows; totals are the corpus's in any number of tasks."""
    rng = random.Random(3)
    texts = [" ".join(f"a{k} b{k}" for k in (rng.randrange(3000) for _ in range(10))) for _ in range(1400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).cache()
    number: dict = {}
    split = [[number.setdefault(w, len(number)) for w in [*t.split(), None]] for t in texts]
    end = number[None]
    pairs = [list(zip(w, [end, *w[:-1]], strict=True)) for w in split]
    count = Counter(p for i, x in enumerate(pairs) for p in x if held(i, 7) != 2)
    keys = sorted({p for x in pairs for p in x})
    pw, pu, n = np.array([w for w, _ in keys]), np.array([u + 1 for _, u in keys]), np.array([count[k] for k in keys], float)
    word_n = np.bincount(pw, weights=n, minlength=len(number))
    context_n, vocabulary = np.concatenate([[0], word_n]), int((word_n > 0).sum())
    once, twice = int((word_n == 1).sum()), int((word_n == 2).sum())
    discount = once / (once + 2 * twice)
    mean, c, t, totals = pitmanyor.sample(pw, pu, n, len(number), context_n, vocabulary, discount, 3)
    parent = (c - discount * t + (1 + discount * totals[0]) / (vocabulary + 1)) / (1 + totals[-1])
    new = (1 + 0.75 * totals[:-1]) / (1 + context_n[:, None])
    p = dict(zip(keys, (n - 0.75 * mean) / (1 + context_n[pu]) + (new[pu] * parent[pw]).mean(axis=1), strict=True))
    want = np.array([sum(math.log10(p[k]) for k in x) for x in pairs])
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        scores = []
        for k in (4, 9):
            monkeypatch.setattr(pitmanyor, "buckets_of", lambda rows, each, k=k: k)
            spark.conf.set("spark.sql.shuffle.partitions", str(13 - k))
            got = pitmanyor.score(docs, 2, 7).toPandas().sort_values("doc_id")
            scores.append(got.score.to_numpy())
            assert got[got.held_out].perplexity.median() < 300
            off = got.score.to_numpy() / want - 1
            assert abs(off.mean()) < 0.001 and np.abs(off).mean() < 0.003 and np.abs(off).max() < 0.05  # the sampler's noise
        assert (scores[0] == scores[1]).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def crc(data, table, bits):
    x = 0
    for b in data:
        x = (x << 8 & (1 << bits) - 1) ^ table[(x >> bits - 8) ^ b]
    return x.to_bytes(bits // 8, "big")


def flac_frame(number, size):
    rng = random.Random(number)
    head = b"\xff\xf8\xc9\x08" + bytes([number])
    body = head + crc(head, media.CRC8, 8) + bytes(rng.randrange(256) for _ in range(size))
    return body + crc(body, media.CRC16, 16)


def samples():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd" + b"\x12\xff\x00\x34" + b"\xff\xd9"
    mp4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 12, b"mdat") + b"data"
    ogg = b"OggS\0\x02" + bytes(20) + b"\x01\x05hello"
    flac = b"fLaC\x80\x00\x00\x22" + bytes(34) + flac_frame(0, 90) + flac_frame(1, 300) + flac_frame(2, 17)
    mp3 = b"ID3\x03\0\0\0\0\0\x04abcd" + 3 * (b"\xff\xfb\x90\0" + bytes(413)) + b"TAG" + bytes(125)
    pdf = b"%PDF-1.4\nstartxref\n0\n%%EOF\n1 0 obj\nstartxref\n9\n%%EOF"
    return {
        "image/png": png(), "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"text"), "image/bmp": bmp, "image/gif": gif, "image/jpeg": jpeg,
        "video/mp4": mp4, "audio/ogg": ogg, "audio/flac": flac, "audio/mpeg": mp3, "application/pdf": pdf, "audio/wav": media.wave(b"abc"),
    }


def test_sniffing(spark):
    rows = [(i, d, "text/plain" if i % 2 else t) for i, (t, d) in enumerate(samples().items())]
    got = {r["doc_id"]: r for r in media.sniff(spark.createDataFrame(rows, "doc_id long, media binary, declared string")).collect()}
    for i, (t, d) in enumerate(samples().items()):
        assert (got[i]["detected"], got[i]["corrected"]) == (t, bool(i % 2)), t
        assert [tuple(p) for p in got[i]["parts"]] == [(t, 0, len(d))], t


def test_carving_and_false_signatures():
    d = b"junk BM PK\x03\x04 RIFF1234WAVE " + png() + b"more" + media.wave(b"xy") + png()[:-1]
    assert [(t, d[s:e] in (png(), media.wave(b"xy"))) for t, s, e in media.find_media(d)] == [("image/png", True), ("audio/wav", True)]
    for t, x in samples().items():
        for broken in (x[: len(x) // 2], x[:9]):
            assert all(k != t or s > 0 or t in ("application/pdf", "audio/flac", "audio/mpeg") for k, s, _ in media.find_media(broken)), t
    assert media.find_media(b"") == []


def test_media_end_where_they_end():
    """What follows a stream without a length of its own is carved as well, and a lost tail isn't part of it."""
    for kind in ("audio/flac", "audio/mpeg", "application/pdf"):
        x = samples()[kind]
        assert media.find_media(b"-" + x + b"tail" + png() + x) == [(kind, 1, 1 + len(x)), ("image/png", 5 + len(x), 5 + len(x) + len(png())), (kind, 5 + len(x) + len(png()), 5 + 2 * len(x) + len(png()))]
    flac = samples()["audio/flac"]
    assert media.find_media(flac[:-3]) == [("audio/flac", 0, len(flac) - len(flac_frame(2, 17)))]
    assert media.find_media(flac[:60]) == [] and media.find_media(samples()["audio/mpeg"][:300]) == []
    began = time.process_time()
    assert media.find_media(b"%PDF-" * 40_000) == [] and media.find_media(b"PK\x03\x04" * 40_000) == []
    assert time.process_time() - began < 3


def test_media_columns(spark, docs, none, rows):
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.media_digest(docs).collect())
    want = Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert got == want
    assert media.media_digest(none).count() == 0
    nulls = spark.createDataFrame([(1, None, "x"), (2, b"", None)], "doc_id long, media binary, declared string")
    assert {(r["doc_id"], r["detected"]) for r in media.sniff(nulls).collect()} == {(1, None), (2, media.UNKNOWN)}
    stored = media.store_wave(docs.where("doc_id = 4")).first()["media"]
    assert media.wave_samples(stored, 0, len(stored)) == media.pad(b"one")


def test_targets():
    got = mixing.targets([("b", 100), ("a", 10), (None, 1000)])
    assert got["a"] == 30 and abs(sum(got.values()) - 1110) < 1e-9 and got["b"] == 300
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0}


@pytest.mark.parametrize("group", (2048, 3))
def test_mixing(docs, none, rows, group, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", group)
    first, again = (sorted(map(tuple, mixing.mix_sources(d).collect()), key=str) for d in (docs, docs.repartition(3)))
    assert first == again and len(first) == len(rows)
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len((t or "").encode().split())
    target = mixing.targets(list(size.items()))
    largest, taken = defaultdict(int), defaultdict(int)
    for _, s, n, total, want, copies in first:
        assert total == size[s] and abs(want - target[s]) < 1e-6 and 0 <= copies <= 3
        largest[s] = max(largest[s], n)
        taken[s] += n * copies
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    assert mixing.mix_sources(none).count() == 0


def test_pivot_keeps_the_mass():
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"part": np.full(500, 0.37), "size": rng.integers(0, 90, 500)})
    out = mixing._pivot(rows, 9)
    assert ((out.part > 0) & (out.part < 1)).sum() <= 1
    assert abs((out.part * out["size"]).sum() - 0.37 * rows["size"].sum()) < 1e-6


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    tox = docs
    for (name, stage), check in zip(corpus_pipeline.STAGES, ("toxicity", "near_dedup", "substring_dedup", "mix", "encode"), strict=True):
        assert name == check
        out = stage(spark, tox, DATA).cache()
        if name != "encode":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
            tox = out
    assert out.where("not round_trip").count() == 0 and out.count() == tox.count()
    ran = corpus_pipeline.run(spark, DATA)
    assert Counter(r["doc_id"] for r in ran.collect()) == Counter(r["doc_id"] for r in out.collect())


def test_pipeline_cases(spark, docs, none):
    for d in (docs, none):
        got = d
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, got, DATA)
            assert got.columns == d.columns
        assert corpus_pipeline.encode(spark, got, DATA).where("not round_trip").count() == 0
