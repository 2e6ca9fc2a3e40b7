"""The registered queries over the driver's tables, and their SQL.

`documents` are memory files (`memory/<doc_id>.md`): as whole chunks, as lines, or chunked.  `embeddings` are vectors of
the documents with the same number, `benchmark` is a batch of queries, `conversations` are sessions, `events` accesses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from memloom.functions import scores as sc
from memloom.functions import text as tx
from memloom.operators import index as ix
from memloom.operators import search as se
from memloom.operators import status as stt
from memloom.operators import sync as sy
from memloom.operators.chunkers import jsonl_chunked
from memloom.operators.vectors import nearest
from memloom.session import spread
from memloom.sources import sessions as ss
from memloom.sources.files import EXTENSIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUERY = "idiot clown worthless the"
NOW = 1_700_000_000_000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.format_string("memory/%d.md", "doc_id").alias("path"), F.lit("memory").alias("source"), (F.lit(1704067200000.0) + F.col("doc_id") * 60000).alias("mtime_ms"), F.length("text").cast("long").alias("size"), "text", *more)


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.when(F.col("doc_id") == 0, "MEMORY.md").otherwise(F.format_string("memory/%d.md", "doc_id"))
    return d.select(F.col("doc_id").cast("string").alias("id"), path.alias("path"), F.lit("memory").alias("source"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), tx.content_hash(F.col("text")).alias("hash"), "text", F.col("doc_id").alias("updated_at"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl_chunked(files(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id")).distinct()


def one_query(spark: SparkSession, text: str = QUERY) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id long, query string")


# parts of the SQL

WHOLE = """whole AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id = 0 THEN 'MEMORY.md' ELSE 'memory/' || doc_id || '.md' END AS path,
  1 AS start_line, 1 AS end_line, text, doc_id AS updated_at FROM documents)"""
LINES = r"""raw_lines AS (SELECT 'memory/' || doc_id || '.md' AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
lines AS (SELECT path, CAST(n AS INTEGER) AS start_line, CAST(n AS INTEGER) AS end_line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text FROM raw_lines WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''),
line_chunks AS (SELECT *, sha256(text) AS hash, sha256('memory:' || path || ':' || start_line || ':' || end_line || ':' || sha256(text)) AS id FROM lines)"""


def bm25_sql(chunks: str, queries: str) -> str:
    """CTEs up to `ranked`: query_id, id, rank."""
    return rf"""tok AS (SELECT id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+')) AS term FROM {chunks}),
tf AS (SELECT id, term, count(*) AS f FROM tok GROUP BY id, term), dl AS (SELECT c.id, count(t.term) AS dl FROM {chunks} c LEFT JOIN tok t ON c.id = t.id GROUP BY c.id),
tot AS (SELECT count(*) AS n_all, avg(dl) AS mean_dl FROM dl), df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
q AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS term FROM {queries}),
idf AS (SELECT term, CASE WHEN ln((n_all - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) > 0 THEN ln((n_all - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS w FROM df, tot),
ranked AS (SELECT query_id, tf.id, round(sum(w * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_dl))), 9) AS rank
  FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.id = tf.id, tot GROUP BY query_id, tf.id)"""


ONE = f"one AS (SELECT CAST(0 AS BIGINT) AS query_id, '{QUERY}' AS query)"
COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


# scans and chunks


@query("SELECT doc_id, sha256(text) AS hash, CAST(length(text) AS BIGINT) AS size FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("hash"), tx.utf16_length(F.col("text")).cast("long").alias("size"))


@query(f"WITH {LINES} SELECT path, start_line, end_line, hash, id FROM line_chunks")
def jsonl_line_chunks(spark, sf_dir):
    return line_chunks(spark, sf_dir).select("path", "start_line", "end_line", "hash", "id")


@query("SELECT 'memory/' || doc_id || '.md' AS path, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS lines FROM documents")
def range_read(spark, sf_dir):
    return files(spark, sf_dir).select("path", tx.line_range(F.col("text"), 2, 3).alias("lines"))


ENDINGS = ("", ".MD", ".txt", ".html", "/notes.jsonl", ".tar.yaml", "/.md", ".YmL", ".json/", ".jsonx")


@query(rf"""WITH p AS (SELECT page_id, url || list_extract([{', '.join(f"'{e}'" for e in ENDINGS)}], CAST(page_id % {len(ENDINGS)} + 1 AS INTEGER)) AS path FROM pages)
SELECT page_id, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS extension, lower(regexp_extract(path, '(\.[^./]*)$', 1)) IN ('.md', '.txt', '.json', '.jsonl', '.yaml', '.yml') AS known FROM p""")
def extension_whitelist(spark, sf_dir):
    """URLs with known and unknown endings, in both cases of letters, and without any."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    ext = tx.extension(F.concat("url", ending))
    return table(spark, sf_dir, "pages").select("page_id", ext.alias("extension"), ext.isin(*EXTENSIONS).alias("known"))


@query("""SELECT path, mtime_ms, size FROM (SELECT 'memory/' || doc_id || '.md' AS path, 1704067200000.0::DOUBLE + doc_id * 60000 AS mtime_ms, CAST(length(text) AS BIGINT) AS size FROM documents)
WHERE size > 0 AND mtime_ms >= 1704067800000 ORDER BY mtime_ms DESC, path LIMIT 25""")
def session_recency(spark, sf_dir):
    return ss.recent(files(spark, sf_dir).select("path", "mtime_ms", "size"), 1704067800000.0, 25)


@query("""WITH m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS message FROM conversations
  WHERE role IN ('user', 'assistant') AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND NOT (role = 'user' AND regexp_matches(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^(/|<command-|<local-command-)')))
SELECT 'sessions/' || conv_id || '.jsonl' AS path, sha256('Project: proj | Date: 2024-05-06' || chr(10) || string_agg(message, chr(10) ORDER BY turn)) AS hash, CAST(count(*) AS BIGINT) AS messages FROM m GROUP BY conv_id""")
def session_documents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("path", F.format_string("sessions/%d.jsonl", "conv_id"))
    record = F.to_json(F.struct(F.col("role").alias("type"), F.lit("2024-05-06T07:08:09Z").alias("timestamp"), F.lit("/home/me/proj").alias("cwd"), F.struct("role", F.col("text").alias("content")).alias("message")))
    rows = ss.messages(c.select("path", F.col("turn").alias("at"), record.alias("value")))
    counts = rows.groupBy("path").agg(F.count("message").alias("messages"))
    return ss.documents(rows).join(counts, "path").select("path", tx.content_hash(F.col("text")).alias("hash"), "messages")


# ranking


@query(f"WITH {LINES}, {bm25_sql('line_chunks', '(SELECT 0 AS query_id, 1 AS query WHERE false)').split('tot AS')[0].rstrip().rstrip(',')} SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(f) AS BIGINT) AS cf FROM tf GROUP BY term")
def postings_df(spark, sf_dir):
    return ix.term_counts(line_chunks(spark, sf_dir))


@query(f"WITH {LINES}, {ONE}, {bm25_sql('line_chunks', 'one')} SELECT path, start_line, end_line, round(rank, 6) AS score FROM ranked JOIN line_chunks USING (id) ORDER BY rank DESC, path, start_line, id LIMIT 10")
def bm25_topk(spark, sf_dir):
    chunks = line_chunks(spark, sf_dir)
    q = one_query(spark)
    index = se.Index.of(chunks, q)
    ranked = ix.leading(ix.bm25(q, index.postings, index.doc_stats), 10).join(chunks.select(*se.PLACE), "id")
    return ix.top_per_query(ranked, 10, "rank").select("path", "start_line", "end_line", F.round("rank", 6).alias("score"))


@query(f"""WITH {WHOLE}, qs AS (SELECT item_id AS query_id, text AS query FROM benchmark), {bm25_sql('whole', 'qs')},
top AS (SELECT query_id, path, start_line, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, path, start_line, id) AS place FROM ranked JOIN whole USING (id))
SELECT query_id, path, round(rank, 6) AS score, CAST(place AS INTEGER) AS place FROM top WHERE place <= 3""")
def bm25_batch(spark, sf_dir):
    chunks = whole_chunks(spark, sf_dir)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index = se.Index.of(chunks, queries)
    ranked = ix.leading(ix.bm25(queries, index.postings, index.doc_stats), 3).join(chunks.select(*se.PLACE), "id")
    return ix.top_per_query(ranked, 3, "rank").select("query_id", "path", F.round("rank", 6).alias("score"), "place")


@query(f"SELECT CAST(b.vec_id AS VARCHAR) AS id, round({COSINE}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY round({COSINE}, 9) DESC, CAST(b.vec_id AS VARCHAR) LIMIT 10")
def cosine_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = v.where("id = '0'").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    return nearest(q, v, 10).orderBy(F.round("score", 9).desc(), "id").limit(10).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, CAST(b.vec_id AS VARCHAR) AS id, {COSINE} AS c FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
t AS (SELECT query_id, id, c, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) AS place FROM s)
SELECT query_id, id, round(c, 6) AS score, CAST(place AS INTEGER) AS place FROM t WHERE place <= 5""")
def cosine_batch_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = v.where("cast(id as long) % 50 = 0").select(F.col("id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return nearest(q, v, 5).withColumn("place", place).where("place <= 5").select("query_id", "id", F.round("score", 6).alias("score"), "place")


HYBRID_LEGS = f"""{WHOLE}, {ONE}, {bm25_sql('whole', 'one')},
f30 AS (SELECT id, path, start_line, rank / (1 + rank) AS score FROM ranked JOIN whole USING (id) ORDER BY rank DESC, path, start_line, id LIMIT 30),
fts AS (SELECT * FROM f30 WHERE score >= 0.01),
vs AS (SELECT CAST(b.vec_id AS VARCHAR) AS id, {COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY score DESC, id LIMIT 30),
vec AS (SELECT id, path, start_line, score FROM vs JOIN whole USING (id) WHERE score >= 0.01)"""


def hybrid_sql(coverage: str) -> str:
    return f"""WITH {HYBRID_LEGS}, cov AS (SELECT {coverage} AS c), w AS (SELECT 0.5 / (0.5 + 0.5 * c) AS wf, 0.5 * c / (0.5 + 0.5 * c) AS wv FROM cov),
fn AS (SELECT *, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS s FROM fts),
vn AS (SELECT *, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS s FROM vec),
m AS (SELECT coalesce(fn.path, vn.path) AS path, coalesce(fn.start_line, vn.start_line) AS start_line, wf * coalesce(fn.s, 0) + wv * coalesce(vn.s, 0) AS score FROM w, fn FULL JOIN vn ON fn.path = vn.path AND fn.start_line = vn.start_line),
b AS (SELECT path, start_line, CASE WHEN path = 'MEMORY.md' AND count(*) OVER () > 1 THEN score * 1.3 ELSE score END AS score FROM m),
top AS (SELECT * FROM b ORDER BY score DESC, path, start_line LIMIT 10),
acc AS (SELECT 'memory/' || user_id || '.md' AS path, count(*) AS seen FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT path, start_line, round(CASE WHEN count(*) OVER () > 1 THEN 0.85 * score + 0.15 * least(1.0, log2(1 + coalesce(seen, 0) + 1) / 10) ELSE score END, 6) AS score FROM top LEFT JOIN acc USING (path)"""


def _hybrid(spark, sf_dir, own_vectors: DataFrame) -> DataFrame:
    access = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.format_string("memory/%d.md", "user_id").alias("path"), F.lit(1).alias("start_line"))
    index = se.Index.of(whole_chunks(spark, sf_dir), one_query(spark), vectors=own_vectors, access=access)
    vector = vectors(spark, sf_dir).where("id = '0'").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    queries = one_query(spark).join(vector, "query_id")
    return se.search(queries, index, se.SearchOptions(max_results=10)).select("path", "start_line", F.round("score", 6).alias("score"))


@query(hybrid_sql("(SELECT count(*) FROM whole WHERE id IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings))::DOUBLE / (SELECT count(*) FROM whole)"))
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir, vectors(spark, sf_dir))


@query(hybrid_sql("(SELECT count(*) FROM whole WHERE id IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)))::DOUBLE / (SELECT count(*) FROM whole)").replace("WHERE a.vec_id = 0", "WHERE a.vec_id = 0 AND b.vec_id IN (SELECT doc_id FROM labels)"))
def partial_coverage_hybrid(spark, sf_dir):
    """Only labelled documents have been embedded yet: the vector leg weighs less."""
    return _hybrid(spark, sf_dir, vectors(spark, sf_dir).join(labelled(spark, sf_dir), "id", "left_semi"))


@query(f"""WITH {WHOLE}, r AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, path, start_line, id) AS place FROM whole WHERE contains(lower(text), 'ing. th'))
SELECT path, start_line, round(1.0 / place, 6) AS score FROM r WHERE place <= 10""")
def like_fallback(spark, sf_dir):
    index = se.Index(whole_chunks(spark, sf_dir), None, None)
    return se.like_leg(one_query(spark, "ING. th"), index, se.SearchOptions(max_results=10)).select("path", "start_line", F.round("score", 6).alias("score"))


@query(f"""WITH {WHOLE}, {ONE}, {bm25_sql('whole', 'one')},
f30 AS (SELECT id, doc_id, path, start_line, rank / (1 + rank) AS score FROM ranked JOIN whole USING (id) ORDER BY rank DESC, path, start_line, id LIMIT 30)
SELECT path, start_line, round(score, 6) AS score FROM f30 WHERE score >= 0.01 AND doc_id BETWEEN 100 AND 700""")
def time_filtered_search(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") == 0, "MEMORY.md").otherwise(F.format_string("memory/%d.md", "doc_id")).alias("path"), (F.col("doc_id") * 60000.0).alias("mtime_ms"))
    index = se.Index.of(whole_chunks(spark, sf_dir), one_query(spark), files=known)
    options = se.SearchOptions(max_results=10, after="1970-01-01T01:40:00Z", before=700 * 60000.0)
    return se.fts_leg(one_query(spark), index, options).select("path", "start_line", F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT 'memory/' || user_id || '.md' AS path, count(*) AS seen FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT path, CAST(seen AS BIGINT) AS seen, round(0.85 * 0.5 + 0.15 * least(1.0, log2(1 + seen) / 10), 6) AS score FROM a""")
def access_boost(spark, sf_dir):
    counts = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.format_string("memory/%d.md", "user_id").alias("path")).agg(F.count("*").alias("seen"))
    return counts.select("path", "seen", F.round(sc.access_boosted(F.lit(0.5), F.col("seen"), F.lit(2)), 6).alias("score"))


ENTRY_SQL = r"^- (.+?)(?:\s+\[ref:.*?\])?(?:\s+_\(source:.*?\)_)?(?:\s+—\s+\d{4}.*)?$"
FACTS = rf"""facts AS (SELECT path, start_line, '- ' || text || CASE WHEN start_line % 2 = 0 THEN ' [ref:memory/evidence/x.md]' ELSE '' END || ' _(source: chat)_ — 2024-01-02 03:04:05 UTC' AS line FROM lines)"""


def _facts(spark, sf_dir) -> DataFrame:
    line = F.concat(F.lit("- "), "text", F.when(F.col("start_line") % 2 == 0, " [ref:memory/evidence/x.md]").otherwise(""), F.lit(" _(source: chat)_ — 2024-01-02 03:04:05 UTC"))
    return jsonl_chunked(spread(files(spark, sf_dir))).select("path", "start_line", line.alias("line"))


@query(f"WITH {LINES}, {FACTS} SELECT path, start_line, regexp_extract(line, '{ENTRY_SQL}', 1) AS fact, nullif(regexp_extract(line, '\\[ref:([^\\]]*)\\]', 1), '') AS ref FROM facts".replace("\\\\", "\\"))
def entry_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select("path", "start_line", tx.entry_fact(F.col("line")).alias("fact"), tx.entry_ref(F.col("line")).alias("ref"))


@query(f"""WITH {LINES}, {FACTS}, j AS (SELECT path, string_agg(line, chr(10) || chr(10) || chr(10) || chr(10) ORDER BY start_line) AS text FROM facts GROUP BY path),
u AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM j),
c AS (SELECT path, string_agg(CASE WHEN regexp_matches(line, '{ENTRY_SQL}') THEN regexp_extract(line, '{ENTRY_SQL}', 1) ELSE line END, chr(10) ORDER BY n) AS text FROM u GROUP BY path)
SELECT path, sha256(regexp_replace(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS hash FROM c""".replace("\\\\", "\\"))
def snippet_compaction(spark, sf_dir):
    rows = _facts(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n\n\n\n")
    return rows.select("path", tx.content_hash(tx.compact_snippet(text, F.lit("memory"))).alias("hash"))


WORDS_SQL = r"list_distinct([w FOR w IN string_split(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\x{{4e00}}-\x{{9fff}}\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' ') IF length(w) > 1])"


@query(f"""WITH {LINES}, w AS (SELECT path, start_line, {WORDS_SQL.format('text')} AS a FROM lines), p AS (SELECT *, lead(a) OVER (PARTITION BY path ORDER BY start_line) AS b FROM w)
SELECT path, start_line, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) ELSE 0 END, 6) AS overlap FROM p WHERE b IS NOT NULL""")
def entry_overlap(spark, sf_dir):
    """Word overlap of each line with the next one of its file."""
    words = line_chunks(spark, sf_dir).select("path", "start_line", tx.content_words(F.col("text")).alias("a"))
    pairs = words.withColumn("b", F.lead("a").over(Window.partitionBy("path").orderBy("start_line"))).where("b is not null")
    return pairs.select("path", "start_line", F.round(tx.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


# health and maintenance


@query(f"""WITH {LINES} SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM documents) AS memory_files, CAST(0 AS BIGINT) AS session_files, (SELECT count(*) FROM line_chunks) AS chunks,
(SELECT count(*) FROM line_chunks WHERE hash IN (SELECT hash FROM line_chunks JOIN (SELECT DISTINCT 'memory/' || doc_id || '.md' AS path FROM labels) USING (path))) AS embedded_chunks, (SELECT count(DISTINCT hash) FROM line_chunks JOIN (SELECT DISTINCT 'memory/' || doc_id || '.md' AS path FROM labels) USING (path)) AS embedding_cache""")
def status_counts(spark, sf_dir):
    chunks = line_chunks(spark, sf_dir)
    known = labelled(spark, sf_dir).select(F.concat(F.lit("memory/"), "id", F.lit(".md")).alias("path"))
    cache = chunks.join(known, "path", "left_semi").select("hash").distinct()
    return stt.counts(files(spark, sf_dir), chunks, chunks.join(cache, "hash", "left_semi").select("id"), cache)


@query(f"WITH {LINES}, u AS (SELECT DISTINCT hash, path FROM line_chunks) SELECT hash, count(*) AS file_count, string_agg(path, ',' ORDER BY path) AS paths FROM u GROUP BY hash HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    return stt.duplicate_content(line_chunks(spark, sf_dir), None)


@query(f"WITH {LINES} SELECT path, count(*) AS chunks FROM line_chunks GROUP BY path HAVING count(*) > 20")
def large_files(spark, sf_dir):
    return stt.large_files(line_chunks(spark, sf_dir), 20)


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, sf_dir):
    return sy.missing_vectors(whole_chunks(spark, sf_dir), vectors(spark, sf_dir)).select("id")


@query("SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_vectors(spark, sf_dir):
    return sy.orphan_vectors(whole_chunks(spark, sf_dir).join(labelled(spark, sf_dir), "id", "left_semi"), vectors(spark, sf_dir)).select("id")


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")
def cache_gc(spark, sf_dir):
    chunks = whole_chunks(spark, sf_dir)
    return sy.collect_cache(chunks.select("hash").distinct(), chunks.join(labelled(spark, sf_dir), "id", "left_semi"))


@query("""WITH v AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, sha256(d.text) AS hash FROM documents d), c AS (SELECT DISTINCT hash FROM v WHERE CAST(id AS BIGINT) IN (SELECT doc_id FROM labels))
SELECT id, CASE WHEN hash IN (SELECT hash FROM c) THEN 'cache' ELSE 'model' END AS origin FROM v""")
def embedding_backfill(spark, sf_dir):
    """Labelled texts' content is cached; the rest goes through the function."""
    chunks = whole_chunks(spark, sf_dir)
    cache = chunks.join(labelled(spark, sf_dir), "id", "left_semi").select("hash").distinct().select("hash", F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), F.lit(0).cast("long").alias("updated_at"))
    none = spark.createDataFrame([], "id string, embedding array<float>")
    done, _ = sy.backfill(chunks.select("id", "hash", "text"), none, cache, lambda texts: [[2.0] for _ in texts], NOW)
    return done.select("id", F.when(F.col("embedding")[0] == 1, "cache").otherwise("model").alias("origin"))


SYNC_SQL = """d AS (SELECT 'memory/' || doc_id || '.md' AS path, text, lang, doc_id * 1000.0 AS m, length(text) AS s, coalesce((SELECT max(quality) FROM labels l WHERE l.doc_id = documents.doc_id), -1) AS quality FROM documents),
old AS (SELECT path, sha256(text) AS hash, m, s FROM d WHERE quality <> 0),
new AS (SELECT path, CASE lang WHEN 'es' THEN NULL WHEN 'de' THEN text || '!' ELSE text END AS text, m + CASE WHEN lang = 'en' THEN 0 ELSE 7 END AS m, s + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS s FROM d WHERE quality <> 1),
plan AS (SELECT coalesce(old.path, new.path) AS path, CASE WHEN new.path IS NULL THEN 'delete' WHEN old.path IS NOT NULL AND abs(new.m - old.m) < 1 AND new.s = old.s THEN 'skip'
  WHEN new.text IS NULL THEN CASE WHEN old.path IS NULL THEN 'skip' ELSE 'keep' END WHEN old.hash = sha256(new.text) THEN 'touch' ELSE 'index' END AS action, old.hash AS old_hash, sha256(new.text) AS new_hash FROM old FULL JOIN new ON old.path = new.path)"""


def _sync_plan(spark, sf_dir) -> DataFrame:
    """Poor documents are new, good ones are gone; German ones changed, French ones were touched, Spanish ones can't be read."""
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").join(quality, "doc_id", "left").withColumn("path", F.format_string("memory/%d.md", "doc_id")).withColumn("quality", F.coalesce("quality", F.lit(-1)))
    lang, memory, m = F.col("lang"), F.lit("memory").alias("source"), F.col("doc_id") * 1000.0
    old = d.where("quality <> 0").select("path", memory, tx.content_hash(F.col("text")).alias("hash"), m.alias("mtime_ms"), F.length("text").cast("long").alias("size"))
    text = F.when(lang == "es", None).when(lang == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("quality <> 1").select("path", memory, (m + F.when(lang == "en", 0).otherwise(7)).alias("mtime_ms"), (F.length("text") + F.when(lang == "de", 1).otherwise(0)).cast("long").alias("size"), text.alias("text"))
    return sy.classify(new, old)


@query(f"WITH {SYNC_SQL} SELECT path, action FROM plan")
def sync_diff(spark, sf_dir):
    return _sync_plan(spark, sf_dir).select("path", "action")


@query(f"WITH {SYNC_SQL} SELECT count(*) FILTER (action = 'index') AS indexed, count(*) FILTER (action IN ('skip', 'touch', 'keep')) AS skipped, count(*) FILTER (action = 'delete') AS deleted FROM plan")
def sync_outcome(spark, sf_dir):
    return sy.outcome(_sync_plan(spark, sf_dir))


@query(f"WITH {SYNC_SQL} SELECT path, hash FROM (SELECT path, action, CASE WHEN action = 'index' THEN new_hash ELSE old_hash END AS hash FROM plan) WHERE action <> 'delete' AND hash IS NOT NULL")
def synced_files(spark, sf_dir):
    return sy.next_files(_sync_plan(spark, sf_dir)).select("path", "hash")


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'view'), o AS (SELECT c_custkey FROM customer)
SELECT CAST(user_id AS BIGINT) AS key, CAST(event_id AS BIGINT) AS updated_at FROM n WHERE r = 1 UNION ALL SELECT c_custkey, CAST(-1 AS BIGINT) FROM o WHERE c_custkey NOT IN (SELECT user_id FROM n)""")
def upsert_last_wins(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.lit(-1).cast("long").alias("updated_at"))
    new = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("updated_at"))
    return sy.last_wins(old, new, "key")


@query(f"WITH {LINES}, s AS (SELECT path, start_line, CAST(length(text) AS DOUBLE) AS score FROM line_chunks), m AS (SELECT *, min(score) OVER (PARTITION BY path) AS a, max(score) OVER (PARTITION BY path) AS b FROM s) SELECT path, start_line, round(CASE WHEN b > a THEN (score - a) / (b - a) ELSE 1 END, 6) AS score FROM m")
def normalized_scores(spark, sf_dir):
    """Min-max normalisation, with a file as the query."""
    rows = line_chunks(spark, sf_dir).select(F.col("path").alias("query_id"), "start_line", F.length("text").cast("double").alias("score"))
    return se.normalized_leg(rows).select(F.col("query_id").alias("path"), "start_line", F.round("score", 6).alias("score"))
