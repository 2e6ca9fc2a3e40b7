"""Queries of the chunkers and of the store's sync, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memloom.functions import text as tx
from memloom.operators.chunkers import chunked
from memloom.operators.store import Store
from memloom.plans.catalogue import files, query, table
from memloom.session import new_dir

PLACED = "path, start_line, end_line, sha256(text) AS hash, sha256('memory:' || path || ':' || start_line || ':' || end_line || ':' || sha256(text)) AS id"
COLUMNS = ("path", "start_line", "end_line", "hash", "id")
#: A line over `width` is cut so that the pieces overlap by an eighth, 64 units at least.
BLANK = r"^[\s\x{{a0}}\x{{feff}}]*$".replace("{{", "{").replace("}}", "}")


def cut_sql(lines: str, width: int) -> str:
    """A select of path, start_line, end_line, text over lines (path, n, line)."""
    step = width - max(64, width >> 3)
    return f"""SELECT DISTINCT path, CAST(n AS INTEGER) AS start_line, CAST(n AS INTEGER) AS end_line, text FROM (
  SELECT path, n, line AS text FROM {lines} WHERE length(line) <= {width}
  UNION ALL SELECT path, n, substring(line, CAST(pos + 1 AS BIGINT), {width}) FROM (SELECT path, n, line, unnest(range(0, length(line), {step})) AS pos FROM {lines} WHERE length(line) > {width}))
WHERE NOT regexp_matches(text, '{BLANK}')"""


def as_jsonl(rows: DataFrame) -> DataFrame:
    return rows.withColumn("path", F.regexp_replace("path", "\\.md$", ".jsonl"))


TRIMMED = r"""trimmed AS (SELECT path, n, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM
  (SELECT 'memory/' || doc_id || '.jsonl' AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {documents}))"""


@query(f"WITH {TRIMMED.format(documents='documents')}, c AS ({cut_sql('trimmed', 256)}) SELECT {PLACED} FROM c")
def oversized_line_chunks(spark, sf_dir):
    """JSON lines at the smallest chunk size: nearly every line is cut."""
    return chunked(as_jsonl(files(spark, sf_dir)), 64).select(*COLUMNS)


def _turns(spark, sf_dir) -> DataFrame:
    """Each conversation's turns in order as (role, hash of the text)."""
    turn = F.struct("turn", "role", tx.content_hash(F.col("text")).alias("h"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))


def _made(rows: DataFrame, ext: str, text) -> DataFrame:
    return rows.select(F.concat(F.lit("memory/"), F.col("conv_id").cast("string"), F.lit(ext)).alias("path"), F.lit("memory").alias("source"), text.alias("text"))


TURNS = """t AS (SELECT conv_id, role, sha256(text) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, sha256(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""


def one_or_parts(path: str, part: str, lines: int, first: int, instead: str) -> str:
    """Chunks of a file of two parts or more (`lines` lines each, after `first - 1` others), or `instead` for its only part."""
    return f"""SELECT {path} AS path, CAST((i - 1) * {lines} + {first} AS INTEGER) AS start_line, CAST(i * {lines} + {first} - 1 AS INTEGER) AS end_line, {part} AS text FROM t WHERE n > 1
  UNION ALL SELECT {path}, p.* FROM t, LATERAL ({instead}) p WHERE n = 1"""


YAML_PART = "'turn' || i || ':' || chr(10) || '  role: ' || role || chr(10) || '  hash: ' || h"
YAML_DOC = "'---' || chr(10) || 'role: ' || role || chr(10) || 'hash: ' || h"
KEYED = """'  "turn' || i || '": {"role": "' || role || '", "hash": "' || h || '"}'"""
ITEM = """'  {"role": "' || role || '",' || chr(10) || '   "hash": "' || h || '"}'"""


@query(f"WITH {TURNS}, c AS ({one_or_parts("'memory/' || conv_id || '.yaml'", YAML_PART, 3, 1, f'SELECT 1, 3, {YAML_PART}')}) SELECT {PLACED} FROM c")
def yaml_key_chunks(spark, sf_dir):
    part = lambda x, i: F.concat(F.lit("turn"), (i + 1).cast("string"), F.lit(":\n  role: "), x["role"], F.lit("\n  hash: "), x["h"])
    return chunked(_made(_turns(spark, sf_dir), ".yaml", F.array_join(F.transform("t", part), "\n"))).select(*COLUMNS)


#: A file with one separator only goes by its two top-level keys, and the separator before them belongs to no chunk.
TWO_KEYS = "SELECT 2, 2, 'role: ' || role UNION ALL SELECT 3, 3, 'hash: ' || h"


@query(f"WITH {TURNS}, c AS ({one_or_parts("'memory/' || conv_id || '.yml'", YAML_DOC, 3, 1, TWO_KEYS)}) SELECT {PLACED} FROM c")
def yaml_document_chunks(spark, sf_dir):
    part = lambda x: F.concat(F.lit("---\nrole: "), x["role"], F.lit("\nhash: "), x["h"])
    return chunked(_made(_turns(spark, sf_dir), ".yml", F.array_join(F.transform("t", part), "\n"))).select(*COLUMNS)


@query(f"""WITH {TURNS}, c AS (SELECT 'memory/' || conv_id || '.json' AS path, CAST(i + 1 AS INTEGER) AS start_line, CAST(i + 1 + CASE WHEN i = n THEN 1 ELSE 0 END AS INTEGER) AS end_line, {KEYED} || CASE WHEN i = n THEN chr(10) || '}}' ELSE '' END AS text FROM t)
SELECT {PLACED} FROM c""")
def json_object_chunks(spark, sf_dir):
    """By top-level keys; the closing bracket goes with the last one."""
    part = lambda x, i: F.concat(F.lit('  "turn'), (i + 1).cast("string"), F.lit('": {"role": "'), x["role"], F.lit('", "hash": "'), x["h"], F.lit('"}'))
    return chunked(_made(_turns(spark, sf_dir), ".json", F.concat(F.lit("{\n"), F.array_join(F.transform("t", part), ",\n"), F.lit("\n}")))).select(*COLUMNS)


@query(f"WITH {TURNS}, c AS ({one_or_parts("'memory/' || conv_id || '.json'", ITEM, 2, 2, f"SELECT 1, 4, '[' || chr(10) || {ITEM} || chr(10) || ']'")}) SELECT {PLACED} FROM c")
def json_array_chunks(spark, sf_dir):
    """By elements of two lines each; an array of one element is one chunk with its brackets."""
    part = lambda x: F.concat(F.lit('  {"role": "'), x["role"], F.lit('",\n   "hash": "'), x["h"], F.lit('"}'))
    return chunked(_made(_turns(spark, sf_dir), ".json", F.concat(F.lit("[\n"), F.array_join(F.transform("t", part), ",\n"), F.lit("\n]")))).select(*COLUMNS)


@query(f"""WITH {TURNS}, one AS (SELECT conv_id, '[' || string_agg(role || chr(10) || h, ',' || chr(10) ORDER BY i) AS text FROM t GROUP BY conv_id),
c AS (SELECT 'memory/' || conv_id || '.JSON' AS path, 1 AS start_line, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS end_line, text FROM one) SELECT {PLACED} FROM c""")
def broken_json_chunks(spark, sf_dir):
    """What isn't JSON is one chunk."""
    part = lambda x: F.concat(x["role"], F.lit("\n"), x["h"])
    return chunked(_made(_turns(spark, sf_dir), ".JSON", F.concat(F.lit("["), F.array_join(F.transform("t", part), ",\n"))), 4096).select(*COLUMNS)


#: Windows of lines of at most 256 units that repeat up to 32, new at headings; lines beyond that are cut.
MARKDOWN = rf"""WITH RECURSIVE u AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM u),
k AS (SELECT doc_id, n, line, length(line) + 1 AS cost, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS upto FROM l),
b AS (SELECT doc_id, list_prepend(CAST(0 AS BIGINT), list(upto ORDER BY n)) AS before, list(line ORDER BY n) AS lines FROM k GROUP BY doc_id),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, 0 AS s FROM b UNION ALL SELECT doc_id, len(lines) FROM b UNION ALL SELECT doc_id, n - 1 FROM k WHERE cost > 256 OR regexp_matches(line, '^#{{1,6}}\s') UNION ALL SELECT doc_id, n FROM k WHERE cost > 256)),
seg AS (SELECT doc_id, s AS a, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM s),
long AS (SELECT 'memory/' || k.doc_id || '.md' AS path, n, line FROM seg JOIN k ON k.doc_id = seg.doc_id AND k.n = seg.a + 1 WHERE seg.e IS NOT NULL AND cost > 256),
start AS (SELECT seg.doc_id, a, e FROM seg JOIN k ON k.doc_id = seg.doc_id AND k.n = seg.a + 1 WHERE seg.e IS NOT NULL AND cost <= 256),
w AS (SELECT doc_id, e, a AS pos, least(e, greatest(a + 1, len(list_filter(before, lambda x: x <= before[a + 1] + 256)) - 1)) AS stop FROM start JOIN b USING (doc_id)
  UNION ALL SELECT doc_id, e, pos, least(e, greatest(stop + 1, len(list_filter(before, lambda x: x <= before[pos + 1] + 256)) - 1)) FROM
    (SELECT w.doc_id, e, before, stop, greatest(pos, len(list_filter(before, lambda x: x <= before[stop + 1] - 32)) - 1) AS pos FROM w JOIN b USING (doc_id) WHERE stop < e)),
c AS (SELECT 'memory/' || doc_id || '.md' AS path, CAST(pos + 1 AS INTEGER) AS start_line, CAST(stop AS INTEGER) AS end_line, array_to_string(lines[pos + 1:stop], chr(10)) AS text FROM w JOIN b USING (doc_id)
  UNION ALL SELECT path, start_line, end_line, text FROM ({cut_sql('(SELECT path, n, line FROM long)', 256).replace('length(line) <= 256', 'length(line) < 256').replace('length(line) > 256', 'length(line) >= 256')}))
SELECT DISTINCT {PLACED} FROM c WHERE NOT regexp_matches(text, '{BLANK}')"""


@query(MARKDOWN)
def markdown_chunks(spark, sf_dir):
    return chunked(files(spark, sf_dir), 64).select(*COLUMNS)


@query(f"""WITH {TRIMMED.format(documents="(SELECT doc_id, CASE WHEN lang = 'de' THEN text || chr(10) || 'more' ELSE text END AS text FROM documents WHERE lang <> 'es' OR lang IS NULL)")},
c AS ({cut_sql('trimmed', 2048)}) SELECT {PLACED} FROM c""")
def store_sync(spark, sf_dir):
    """Chunks of a store after a second sync, for which German files have grown and Spanish ones are gone."""
    store = Store(spark, new_dir(spark, "store"))
    d = as_jsonl(files(spark, sf_dir, "lang"))
    store.sync(d.drop("lang"), now_ms=1)
    german = F.coalesce(F.col("lang") == "de", F.lit(False))
    after = d.where("lang <> 'es' or lang is null").withColumn("text", F.when(german, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text")))
    store.sync(after.withColumn("size", F.col("size") + german.cast("int")).drop("lang"), now_ms=2)
    return store.table("chunks").select(*COLUMNS)
