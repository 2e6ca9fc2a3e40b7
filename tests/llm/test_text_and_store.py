"""Blocks of words, the packed shuffle, BPE and the id store."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memloom.llm import bpe, idstore
from memloom.llm import textblocks as tb
from memloom.llm.queries import tokenizer_path


def test_blocks_hold_whole_words():
    texts = ["", None, " a  bb\tccc ", "bb", "x" * 50, "\x0b\x0c", "ä ö"]
    for limit in (1, 8, 1 << 20):
        got = []
        for i, b in tb.word_blocks(pa.array(texts), limit=limit):
            h = b.hashes()
            for k in range(b.rows):
                s = slice(b.first[k], b.first[k + 1])
                got.append([(bytes(b.buf[x:y]), int(v)) for x, y, v in zip(b.start[s], b.end[s], h[s])])
        assert [[w for w, _ in d] for d in got] == [(t or "").encode().split() for t in texts]
        seen = {}
        for w, v in (x for d in got for x in d):
            assert seen.setdefault(w, v) == v
        assert len(set(seen.values())) == len(seen)


def test_every_bucket_has_its_task(spark):
    n = tb.parallelism(spark)
    rows = spark.range(0, 5 * n).select((F.col("id") - n).cast("int").alias("bucket"))
    got = tb.exchange(rows).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.collect_set(F.pmod("bucket", F.lit(n))).alias("b")).collect()
    assert len(got) == n and all(len(r["b"]) == 1 for r in got)


def test_pack_and_unpack():
    b = np.array([2, 0, 2, 1, 2])
    got = {k: [c.tolist() for c in tb.unpack(x, np.int64, np.uint16)] for k, x in tb.pack(b, 3, np.arange(5), np.arange(5, dtype=np.uint16))}
    assert got == {0: [[1], [1]], 1: [[3], [3]], 2: [[0, 2, 4], [0, 2, 4]]}


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(t=st.lists(st.sampled_from(list(" \n\t\r\x0b\x1c\x85\xa0 　﻿abcZé'ß9!.,我😀́д") + ["<|endoftext|>", "'ll"]), max_size=20).map("".join))
def test_pieces_encode_as_the_whole_does(reference, t):
    c = bpe.codec(tokenizer_path())
    ids = c.encode(t).tolist()
    assert ids == reference.encode_ordinary(t)
    assert c.decode(ids) == t


def test_offsets_and_split_characters():
    c = bpe.codec(tokenizer_path())
    ids, spans = c.encode_with_offsets("a 漢😀")
    assert ids == c.encode("a 漢😀").tolist() and spans[0] == (0, 1) and spans[-1][1] == 4
    assert c.decode(c.encode("😀").tolist()[:1]) == "�"


def test_round_trip(docs, none, rows, reference):
    got = Counter(map(tuple, bpe.round_trip(docs, tokenizer_path()).collect()))
    want = Counter()
    for i, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    enc = bpe.encode(docs, tokenizer_path())
    assert Counter(r["text"] for r in bpe.decode(enc, tokenizer_path()).collect()) == Counter(t or "" for _, t, *_ in rows)
    assert bpe.encode_checked(docs, tokenizer_path()).where("not round_trip").count() == 0
    assert bpe.round_trip(none, tokenizer_path()).count() == 0
    assert bpe.encode(docs.where("doc_id = 63"), tokenizer_path(), offsets=True).first()["ends"][-1] == len(next(t for i, t, *_ in rows if i == 63))


def test_id_store(spark, docs, none, rows, tmp_path):
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    at, unit = f"file://{tmp_path}/store", bpe.codec(tokenizer_path()).unit.str
    idstore.write_store(docs, at, tokenizer_path())
    got = idstore.document_digests(spark, at, unit).collect()
    assert len(got) == len(rows)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x, *_ in rows if i is not None}
    start = 0
    for r in sorted((r for r in got if r["doc_id"] is not None), key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert sorted(r["start"] for r in got if r["doc_id"] is None)[0] == start
    whole = {r["doc_id"]: r["ids"] for r in idstore.read_ids(spark, at, unit).collect()}
    assert all(whole[i] == x.tolist() for i, x in ids.items())
    chunks = idstore.objects_of(spark, at, "chunk")
    assert chunks.count() == chunks.select("digest").distinct().count()
    recipes = idstore.objects_of(spark, at, "recipe").agg(F.sum(F.length("digests") / 32)).first()[0]
    assert chunks.count() < recipes
    idstore.write_store(none, f"file://{tmp_path}/none", tokenizer_path())
    assert idstore.document_digests(spark, f"file://{tmp_path}/none", unit).count() == 0


@pytest.mark.parametrize("parts", (4, 16, 51))
def test_starts_of_many_documents(spark, parts):
    """More rows a partition than Spark samples for its borders, so that two samples differ; half of the rows are equal and without an id."""
    rows = spark.range(60_000).select(F.when(F.col("id") < 30_000, F.col("id") * 7 % 30_011).alias("doc_id"), F.when(F.col("id") < 30_000, F.col("id") % 50 + 1).otherwise(3).alias("n"), F.lit(b"").alias("digests"), F.sha2(F.when(F.col("id") < 30_000, F.col("id")).otherwise(0).cast("string"), 256).cast("binary").alias("root"))
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = idstore.in_order(rows.repartition(7)).select("part", "doc_id", "start", "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    got.sort(key=lambda r: r["start"])
    assert len(got) == 60_000 and [r["start"] for r in got] == [0, *np.cumsum([r["n"] for r in got])[:-1].tolist()]
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known) and all(r["doc_id"] is None for r in got[30_000:])
    assert [r["part"] for r in got] == sorted(r["part"] for r in got)
    assert max(Counter(r["part"] for r in got).values()) < 3 * 60_000 / parts


def test_damage_is_found(spark, docs, tmp_path):
    at, unit = f"file://{tmp_path}/store", bpe.codec(tokenizer_path()).unit.str
    idstore.write_store(docs.where("doc_id < 5"), at, tokenizer_path())
    idstore.objects_of(spark, at, "chunk").withColumn("payload", F.concat("payload", F.lit(b"\0\0"))).write.partitionBy("kind").parquet(f"file://{tmp_path}/bad/objects")
    with pytest.raises(Exception, match="differs from its address"):
        idstore.read_chunks(spark, f"file://{tmp_path}/bad", unit).collect()


@given(st.lists(st.integers(0, 60000), max_size=900), st.lists(st.integers(0, 60000), min_size=900, max_size=1500))
@settings(max_examples=30, deadline=None)
def test_chunks_follow_content(prefix, body):
    ids = np.array(prefix + body, np.uint16)
    ends, alone = idstore.cut_points(np.concatenate([ids, ids[:70], ids]), np.array([0, len(ids), len(ids) + 70, 2 * len(ids) + 70]))[::2]
    assert ends == alone == idstore.cut_points(ids, np.array([0, len(ids)]))[0]
    assert ends[-1] == len(ids) and all(a < b <= a + idstore.MOST for a, b in zip([0, *ends], ends)) and all(b - a >= idstore.LEAST for a, b in zip([0, *ends], ends[:-1]))
    a, b = b"spark", bytes(3000)
    assert idstore.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
