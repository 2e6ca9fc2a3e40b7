"""A content-addressed store of token ids.

A document's id stream is cut where a rolling hash of the last `WINDOW` ids meets a condition, so equal stretches give
equal chunks wherever they stand.  A chunk's address is the SHA-256 of its bytes; every different chunk is stored
once.  Layout of a store:

    objects/kind=chunk   digest, payload (little-endian ids), n; the files are zstd-compressed
    objects/kind=recipe  doc_id, n, digests (32 bytes a chunk, in order), and the Merkle root over them
    manifest/part=P      the recipes in ascending doc_id order with `start`, the number of ids of all documents before

Reading verifies every chunk against its address and every document against its Merkle root.

Defined cases: a null or empty text is the end id alone; rows that repeat an id are documents of their own, in an order
given by their content; a null id sorts last; an empty table gives an empty store.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from memloom.llm.bpe import ROWS, codec
from memloom.llm.shared import cut
from memloom.llm.textblocks import mix, parallelism, texts_of

WINDOW = 8
AVERAGE = 256  # ids a chunk
LEAST, MOST = 64, 2048
END_ID = 2
DIGEST = 32


@functools.cache
def _codes(size: int) -> np.ndarray:
    return mix(np.arange(size, dtype=np.uint64), 31)


def cut_points(ids: np.ndarray, edges: np.ndarray) -> list[list[int]]:
    """Chunk ends of each stream ids[edges[k]:edges[k + 1]], counted from its start.

    The hash at i covers the last `WINDOW` ids.  Nearer than that to its start a stream has no cut, as chunks are
    longer, so what stands before it doesn't matter.
    """
    n = len(ids)
    h = np.zeros(n, np.uint64)
    code = _codes(1 << max(16, int(ids.max(initial=0)).bit_length()))[ids]
    with np.errstate(over="ignore"):
        for k in range(min(WINDOW, n)):
            h[k:] += code[: n - k] << np.uint64(5 * k)
    wanted = np.flatnonzero(mix(h, 32) % np.uint64(AVERAGE) == 0) + 1
    at = np.searchsorted(wanted, edges, "right")
    return [_ends((wanted[i:j] - a).tolist(), b - a) for i, j, a, b in zip(at[:-1].tolist(), at[1:].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _ends(wanted: list[int], n: int) -> list[int]:
    """Cuts at the wanted places that leave chunks of `LEAST` to `MOST` ids, the last chunk being what remains."""
    ends, last = [], 0
    for e in [*wanted, n]:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e > last and (e == n or e - last >= LEAST):
            ends.append(e)
            last = e
    return ends


def merkle(digests: bytes) -> bytes:
    """The root over 32-byte leaves; an odd node moves up as it is."""
    level = [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


MANIFEST = "doc_id long, start long, n long, digests binary, root binary, part int"
OBJECTS = "kind string, digest binary, payload binary, n long, doc_id long, digests binary, root binary"


def write_store(docs: DataFrame, at: str, path: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, and writes the store to the folder `at`."""
    import pyarrow

    schema = pa.schema([("kind", pa.string()), ("digest", pa.binary()), ("payload", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64()), ("digests", pa.binary()), ("root", pa.binary())])

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sent: set[bytes] = set()
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                rows = []
                streams = c.encode_column(b.column(1).slice(i, ROWS))
                own = [] if end_id is None else [np.array([end_id], c.unit)]
                flat = np.concatenate([x for s in streams for x in (s, *own)] or [np.zeros(0, c.unit)])
                edges = np.concatenate([[0], np.cumsum([len(s) + len(own) for s in streams])]).astype(np.int64)
                for name, start, n, ends in zip(b.column(0).slice(i, ROWS).to_pylist(), edges[:-1].tolist(), np.diff(edges).tolist(), cut_points(flat, edges), strict=True):
                    last, recipe = 0, []
                    for e in ends:
                        data = flat[start + last : start + e].tobytes()
                        recipe.append(d := hashlib.sha256(data).digest())
                        if d not in sent:
                            sent.add(d)
                            rows.append(("chunk", d, data, e - last, None, None, None))
                        last = e
                    digests = b"".join(recipe)
                    rows.append(("recipe", None, None, n, name, digests, merkle(digests)))
                if len(sent) > 200_000:
                    sent.clear()
                yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    made = texts_of(docs, id_col, text_col).mapInArrow(objects, OBJECTS)
    # chunks meet by address and recipes are spread by content: one exchange, one write
    dealt = made.repartition(parallelism(docs.sparkSession), F.coalesce("digest", F.xxhash64("doc_id", "digests").cast("string").cast("binary")))

    def once(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            new = []
            for k, d in enumerate(b.column(1).to_pylist()):
                if d is None or d not in seen:
                    new.append(k)
                    if d is not None:
                        seen.add(d)
            yield b.take(pa.array(new, pa.int64()))

    dealt.mapInArrow(once, OBJECTS).write.partitionBy("kind").option("compression", "zstd").parquet(f"{at}/objects")
    recipes = objects_of(docs.sparkSession, at, "recipe").select("doc_id", "n", "digests", "root")
    in_order(recipes).write.partitionBy("part").parquet(f"{at}/manifest")


def objects_of(spark: SparkSession, at: str, kind: str) -> DataFrame:
    return spark.read.schema(OBJECTS).parquet(f"{at}/objects").where(F.col("kind") == kind)


def in_order(recipes: DataFrame) -> DataFrame:
    """Recipes by `part` and, inside it, by id, with `start`: range partitions, each one's sum added to those after it.

    The partitions are written before they are summed up: their borders are drawn from a sample, and sums of another
    sample's partitions would not fit them.  Equal rows are told apart by their place, so that they can be split.
    """
    spark = recipes.sparkSession
    order = [F.col("doc_id").asc_nulls_last(), F.col("root"), F.col("place")]
    ranged = recipes.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parallelism(spark), *order)
    ordered = cut(ranged.withColumn("part", F.spark_partition_id()), "manifest")
    sums = ordered.groupBy("part").agg(F.sum("n").alias("own"))
    # one row a partition
    before = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    out = ordered.withColumn("local", local).join(F.broadcast(before), F.col("part") == F.col("p"))
    return out.select("part", "doc_id", (F.col("before") + F.col("local")).cast("long").alias("start"), "n", "digests", "root")


def read_chunks(spark: SparkSession, at: str, unit: str) -> DataFrame:
    """digest, n, crc (of the ids as 32-bit little-endian), data (the ids' bytes), each verified against its address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(unit)
        for b in batches:
            data = b.column(1).to_pylist()
            for d, x in zip(b.column(0).to_pylist(), data, strict=True):
                if hashlib.sha256(x).digest() != d:
                    raise ValueError("a chunk differs from its address")
            crc = [zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in data]
            yield pa.record_batch([b.column(0), pa.array([len(x) // dtype.itemsize for x in data], pa.int64()), pa.array(crc, pa.int64()), pa.array(data, pa.binary())], names=["digest", "n", "crc", "data"])

    return objects_of(spark, at, "chunk").select("digest", "payload").mapInArrow(run, "digest binary, n long, crc long, data binary")


def _manifest_chunks(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, root, k, digest: one row a chunk of a document."""
    m = spark.read.schema(MANIFEST).parquet(f"{at}/manifest").select("doc_id", "start", "n", "root", "digests")
    pieces = F.transform(F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1), lambda k: F.substring("digests", k * DIGEST + 1, F.lit(DIGEST)))
    return m.select("doc_id", "start", "root", F.posexplode(pieces).alias("k", "digest"))


ZEROS = bytes(4 * MOST)


def crc_join(first: int, second: int, n: int) -> int:
    """CRC-32 of two byte strings one after the other; n: bytes of the second. A CRC is affine in the one before it."""
    zeros = ZEROS[:n] if n <= len(ZEROS) else bytes(n)
    return zlib.crc32(zeros, first) ^ zlib.crc32(zeros) ^ second


def document_digests(spark: SparkSession, at: str, unit: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the stored files: chunks are checksummed once each, and documents by joining those."""
    chunks = read_chunks(spark, at, unit).select("digest", "n", "crc")
    parts = _manifest_chunks(spark, at).join(chunks, "digest")

    @F.pandas_udf("struct<n: long, crc: long, ok: boolean>")
    def whole(rows: pd.Series, root: pd.Series) -> pd.DataFrame:
        out = []
        for parts, want in zip(rows, root, strict=True):
            parts = sorted(parts, key=lambda x: x["k"])
            n, crc = 0, 0
            for p in parts:
                crc = crc_join(crc, p["crc"], 4 * p["n"]) if n else p["crc"]
                n += p["n"]
            out.append((n, crc, merkle(b"".join(bytes(p["digest"]) for p in parts)) == bytes(want)))
        return pd.DataFrame(out, columns=["n", "crc", "ok"])

    docs = parts.groupBy("doc_id", "start", "root").agg(F.collect_list(F.struct("k", "n", "crc", "digest")).alias("rows")).withColumn("w", whole("rows", "root"))
    checked = F.when(F.col("w.ok"), F.col("w.n")).otherwise(F.raise_error(F.lit("a document differs from its Merkle root")).cast("long"))
    return docs.select("doc_id", "start", checked.alias("n_tokens"), F.col("w.crc").alias("ids_crc32"))


def read_ids(spark: SparkSession, at: str, unit: str) -> DataFrame:
    """doc_id, start, ids: every document's ids put together again from the chunks its recipe names."""
    parts = _manifest_chunks(spark, at).join(read_chunks(spark, at, unit).select("digest", "data"), "digest")
    joined = F.array_sort(F.collect_list(F.struct("k", "data")))
    rows = parts.groupBy("doc_id", "start").agg(F.transform(joined, lambda x: x["data"]).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x), unit).astype(np.int64) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, ids array<long>")
