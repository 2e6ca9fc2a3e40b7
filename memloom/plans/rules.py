"""Queries of scoring rules, sessions, facts and maintenance, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memloom.functions import scores as sc
from memloom.functions import text as tx
from memloom.operators import facts as fc
from memloom.operators import index as ix
from memloom.operators import search as se
from memloom.operators import status as stt
from memloom.operators import sync as sy
from memloom.plans.catalogue import FACTS, LINES, ONE, QUERY, WHOLE, _facts, bm25_sql, files, labelled, line_chunks, one_query, query, table, vectors, whole_chunks
from memloom.sources import sessions as ss

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

# sessions


def _records(spark, sf_dir, record) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("path", F.format_string("sessions/%d.jsonl", "conv_id"))
    return ss.documents(ss.messages(c.select("path", F.col("turn").alias("at"), F.to_json(record).alias("value"))))


@query(rf"""WITH m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || {TRIM.format("text || chr(10) || role")} AS message FROM conversations
  WHERE role IN ('user', 'assistant') AND NOT (role = 'user' AND regexp_matches({TRIM.format('text')}, '^(/|<command-|<local-command-)')))
SELECT 'sessions/' || conv_id || '.jsonl' AS path, sha256(string_agg(message, chr(10) ORDER BY turn)) AS hash FROM m GROUP BY conv_id""")
def session_blocks(spark, sf_dir):
    """Messages whose content is an array: its text blocks count, others don't."""
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    content = F.array(block("text", F.col("text")), block("tool_use", F.lit("no")), block("text", F.col("role")))
    record = F.struct(F.col("role").alias("type"), F.struct("role", content.alias("content")).alias("message"))
    return _records(spark, sf_dir, record).select("path", tx.content_hash(F.col("text")).alias("hash"))


@query(rf"""WITH m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || {TRIM.format('text')} AS message FROM conversations
  WHERE role IN ('user', 'assistant') AND NOT (role = 'user' AND text LIKE '/%') AND {TRIM.format('text')} <> '')
SELECT 'sessions/' || conv_id || '.jsonl' AS path, sha256(string_agg(message, chr(10) ORDER BY turn)) AS hash FROM m GROUP BY conv_id""")
def event_sessions(spark, sf_dir):
    """Transcripts of the other kind: events with their content in `data`."""
    record = F.struct(F.concat("role", F.lit(".message")).alias("type"), F.struct(F.col("text").alias("content")).alias("data"))
    return _records(spark, sf_dir, record).select("path", tx.content_hash(F.col("text")).alias("hash"))


@query(r"""WITH p AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '/events.jsonl' WHEN 1 THEN '/a.b.jsonl' ELSE '' END AS place FROM pages)
SELECT page_id, 'sessions/' || CASE WHEN regexp_matches(place, '(^|/)events\.jsonl$') THEN regexp_extract(place, '([^/]*)/events\.jsonl$', 1) ELSE regexp_extract(place, '([^/]*?)(?:\.[^./]*)?$', 1) END || '.jsonl' AS path FROM p""")
def session_paths(spark, sf_dir):
    kind = F.col("page_id") % 3
    place = F.concat("url", F.when(kind == 0, "/events.jsonl").when(kind == 1, "/a.b.jsonl").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", ss.session_path_column(place).alias("path"))


# ranking

PHRASE = "the_the ci_n orre"


@query(rf"""WITH {LINES}, toks AS (SELECT id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+') AS t FROM line_chunks),
tot AS (SELECT count(*) AS n_all, avg(len(t)) AS mean_dl FROM toks), q(token, a, b) AS (VALUES (0, 'the', 'the'), (1, 'ci', 'n'), (2, 'orre', NULL)),
tf AS (SELECT token, id, len(t) AS dl, CASE WHEN b IS NULL THEN len(list_filter(t, lambda x: x = a)) ELSE len(list_filter(range(1, len(t)), lambda i: t[i] = a AND t[i + 1] = b)) END AS f FROM toks, q),
hit AS (SELECT *, count(*) OVER (PARTITION BY token) AS n FROM tf WHERE f > 0),
w AS (SELECT *, greatest(ln((n_all - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) AS w FROM hit, tot),
r AS (SELECT id, round(sum(w * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_dl))), 9) AS rank FROM w GROUP BY id)
SELECT path, start_line, round(rank, 6) AS score FROM r JOIN line_chunks USING (id) ORDER BY rank DESC, path, start_line, id LIMIT 40""")
def phrase_search(spark, sf_dir):
    """Two phrases and a word."""
    chunks, q = line_chunks(spark, sf_dir), one_query(spark, PHRASE)
    index = se.Index.of(chunks, q)
    ranked = ix.leading(ix.bm25(q, index.postings, index.doc_stats), 40).join(chunks.select(*se.PLACE), "id")
    return ix.top_per_query(ranked, 40, "rank").select("path", "start_line", F.round("rank", 6).alias("score"))


ENTRY_LINE = r"^- (.+?)(?:\s+\[ref:.*?\])?(?:\s+_\(source:.*?\)_)?(?:\s+—\s+\d{4}.*)?$"


@query(rf"""WITH {WHOLE}, {ONE}, {bm25_sql('whole', 'one')},
f AS (SELECT id, path, start_line, rank / (1 + rank) AS score FROM ranked JOIN whole USING (id) ORDER BY rank DESC, path, start_line, id LIMIT 51),
b AS (SELECT id, path, start_line, CASE WHEN path = 'MEMORY.md' AND count(*) OVER () > 1 THEN score * 1.3 ELSE score END AS score FROM f WHERE score >= 0.01),
top AS (SELECT * FROM b ORDER BY score DESC, path, start_line, id LIMIT 17),
lifted AS (SELECT id, path, start_line, CASE WHEN count(*) OVER () > 1 THEN 0.85 * score + 0.15 * 0.1 ELSE score END AS score FROM top),
s AS (SELECT id, unnest(string_split(substr(text, 1, 630), chr(10))) AS line, generate_subscripts(string_split(substr(text, 1, 630), chr(10)), 1) AS n FROM whole),
c AS (SELECT id, string_agg(CASE WHEN regexp_matches(line, '{ENTRY_LINE}') THEN regexp_extract(line, '{ENTRY_LINE}', 1) ELSE line END, chr(10) ORDER BY n) AS text FROM s GROUP BY id)
SELECT CAST(row_number() OVER (ORDER BY score DESC, path, start_line) AS INTEGER) AS rank, path, round(score, 6) AS score, sha256({TRIM.format(r"regexp_replace(c.text, '\n{3,}', chr(10) || chr(10), 'g')")}) AS snippet, false AS hint FROM lifted JOIN c USING (id)""")
def search_snippets(spark, sf_dir):
    """Search by text with the default number of results for its budget, which snippets share; a blank query finds nothing."""
    queries = spark.createDataFrame([(0, QUERY), (1, " \t ")], "query_id long, query string")
    found = se.search(queries, se.Index.of(whole_chunks(spark, sf_dir), queries))
    return found.select("rank", "path", F.round("score", 6).alias("score"), tx.content_hash(F.col("snippet")).alias("snippet"), F.coalesce("distill_hint", F.lit(False)).alias("hint"))


@query(f"""WITH {LINES}, a AS (SELECT path, start_line % 3 AS k, CAST(length(text) AS DOUBLE) AS s FROM line_chunks), v AS (SELECT path, start_line % 3 AS k, CAST(start_line AS DOUBLE) AS s FROM line_chunks WHERE start_line % 2 = 0),
two AS (SELECT DISTINCT path FROM v), rng AS (SELECT path, min(s) AS lo, max(s) AS hi FROM a GROUP BY path), rngv AS (SELECT path, min(s) AS lo, max(s) AS hi FROM v GROUP BY path),
f AS (SELECT path, k, min(CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1 END) AS s FROM a JOIN rng USING (path) GROUP BY path, k),
w AS (SELECT path, k, min(CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1 END) AS s FROM v JOIN rngv USING (path) GROUP BY path, k)
SELECT path, CAST(k AS INTEGER) AS start_line, round(0.25 * coalesce(f.s, 0) + 0.75 * coalesce(w.s, 0), 6) AS score FROM f FULL JOIN w USING (path, k) WHERE path IN (SELECT path FROM two)
UNION ALL SELECT path, CAST(k AS INTEGER), round(s, 6) FROM a WHERE path NOT IN (SELECT path FROM two)""")
def merged_legs(spark, sf_dir):
    """Legs in which a place occurs several times: of equal places the lowest score counts; files with one leg keep all rows."""
    rows = line_chunks(spark, sf_dir)
    leg = lambda r, score: r.select(F.col("path").alias("query_id"), "id", "path", F.lit("memory").alias("source"), (F.col("start_line") % 3).alias("start_line"), "end_line", score.cast("double").alias("score"))
    found = se.merged(leg(rows, F.length("text")), leg(rows.where("start_line % 2 = 0"), F.col("start_line")), (0.25, 0.75))
    return found.select("path", "start_line", F.round("score", 6).alias("score"))


@query("""SELECT vec_id, round(embedding[1]::DOUBLE / n, 6) AS first, round(embedding[len(embedding)]::DOUBLE / n, 6) AS last, 1.0::DOUBLE AS length
FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)""")
def unit_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", sc.l2_normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"), F.round(F.sqrt(sc.dot(F.col("v"), F.col("v"))), 6).alias("length"))


# facts

NORMAL = r"regexp_replace(regexp_replace(lower({}), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
ENTRIES = rf"{LINES}, {FACTS}, e AS (SELECT path, start_line, {NORMAL.format(f"regexp_extract(line, '{ENTRY_LINE}', 1)")} AS fact FROM facts)"


def _entries(spark, sf_dir) -> DataFrame:
    return _facts(spark, sf_dir).select("path", "start_line", tx.normalized(tx.entry_fact(F.col("line"))).alias("fact"))


@query(f"WITH {LINES} SELECT path, start_line, sha256({NORMAL.format('text')}) AS hash FROM line_chunks")
def normalized_text(spark, sf_dir):
    return line_chunks(spark, sf_dir).select("path", "start_line", tx.content_hash(tx.normalized(F.col("text"))).alias("hash"))


@query(f"WITH {ENTRIES} SELECT path, start_line, first_line FROM (SELECT path, start_line, min(start_line) OVER (PARTITION BY path, fact) AS first_line FROM e) WHERE start_line > first_line")
def exact_fact_duplicates(spark, sf_dir):
    return fc.exact_duplicates(_entries(spark, sf_dir)).select("path", "start_line", "first_line")


WANTED = """wanted AS (SELECT path, arg_min(fact, -start_line) AS wanted FROM e GROUP BY path)"""


@query(f"WITH {ENTRIES}, {WANTED} SELECT path, min(start_line) AS start_line FROM e JOIN wanted USING (path) WHERE contains(fact, wanted) OR contains(wanted, fact) GROUP BY path")
def fact_lookup(spark, sf_dir):
    """For each file the first entry that equals its last one's text, contains it or lies in it."""
    entries = _entries(spark, sf_dir)
    wanted = entries.groupBy("path").agg(F.max_by("fact", "start_line").alias("wanted"))
    return fc.first_matches(entries, wanted).select("path", "start_line")


@query(f"""WITH {ENTRIES}, w AS (SELECT path, list_distinct(string_split(arg_min(fact, -start_line), ' ')) AS words FROM e GROUP BY path),
n AS (SELECT path, start_line, len(list_filter(string_split(fact, ' '), lambda x: list_contains(words, x))) AS shared FROM e JOIN w USING (path) WHERE start_line <= 12)
SELECT path, CAST(shared AS INTEGER) AS shared, start_line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY shared DESC, start_line) AS r FROM n) WHERE r = 1""")
def best_entries(spark, sf_dir):
    """Of each file's entries in the first twelve lines the one that shares most words with its last entry."""
    entries = _entries(spark, sf_dir)
    wanted = entries.groupBy("path").agg(F.max_by("fact", "start_line").alias("wanted"))
    return fc.best_matches(entries.where("start_line <= 12"), wanted).select("path", "shared", "start_line")


# maintenance


@query("""WITH v AS (SELECT sha256(text) AS hash, doc_id FROM documents)
SELECT DISTINCT hash FROM v WHERE doc_id IN (SELECT vec_id FROM embeddings) OR hash IN (SELECT hash FROM v WHERE doc_id IN (SELECT doc_id FROM labels))""")
def salvaged_cache(spark, sf_dir):
    """The cache (of labelled texts) with what chunks' vectors know beside it."""
    chunks = whole_chunks(spark, sf_dir)
    old = vectors(spark, sf_dir).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    cache = chunks.join(labelled(spark, sf_dir), "id", "left_semi").select("hash").distinct().select("hash", F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), F.lit(1).cast("long").alias("updated_at"))
    return sy.salvaged(old, chunks, cache).select("hash")


@query("SELECT 'memory/' || user_id || '.md' AS path, CAST(count(*) AS BIGINT) AS seen FROM events JOIN documents ON doc_id = user_id WHERE doc_id > 0 AND event_id >= doc_id * 10 GROUP BY user_id")
def counted_accesses(spark, sf_dir):
    """Accesses from before a chunk's last indexing don't count."""
    chunks = whole_chunks(spark, sf_dir).withColumn("updated_at", F.col("updated_at") * 10)
    log = table(spark, sf_dir, "events").select(F.format_string("memory/%d.md", "user_id").alias("path"), F.lit(1).alias("start_line"), F.col("event_id").cast("long").alias("accessed_at"))
    return se.counted_accesses(chunks, log).groupBy("path").agg(F.count("*").alias("seen"))


@query(f"""WITH {LINES}, d AS (SELECT hash, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM line_chunks GROUP BY hash HAVING count(DISTINCT path) > 1 ORDER BY hash LIMIT 5),
big AS (SELECT path, count(*) AS n FROM line_chunks GROUP BY path HAVING count(*) > 500)
SELECT * FROM (SELECT count(*) || '{stt.MANY_FILES_TEXT[2:]}' AS warning FROM documents HAVING count(*) > 50
UNION ALL SELECT replace('{stt.DUPLICATES_TEXT.replace('({}', '(' + '@').replace(': {}', ': ')}', '@', CAST(count(*) AS VARCHAR)) || string_agg(paths, '; ' ORDER BY hash) FROM d HAVING count(*) > 0
UNION ALL SELECT '{stt.LARGE_FILES_TEXT.split('{}')[0]}' || string_agg(path || ' (' || n || ' chunks)', ', ' ORDER BY n DESC, path) || '{stt.LARGE_FILES_TEXT.split('{}')[1]}' FROM big HAVING count(*) > 0)""")
def health_warnings(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in stt.warnings(files(spark, sf_dir), line_chunks(spark, sf_dir))], "warning string")
