"""Registered queries of the library's operators on the driver's tables, each beside SQL that says the same.

Stand-ins: a document is a file and a chunk, its source, language and label are entities; an order is a paper and a chunk,
parts, suppliers and nations are entities, and line items mention them. Derived versions (an older manifest, other
spellings) are made by expressions over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import models
from quire.functions import text as t
from quire.functions import vectors as v
from quire.functions.chunking import chunk_files
from quire.operators import graph, pivots, resolve, search, select, traverse
from quire.plans import flows
from quire.settings import Settings
from quire.sources import files
from quire.sources.scratch import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

K = 5
ALLOWED = ["EVALUATED_ON", "INVOLVES"]
#: Items that a task of merge_dedup gets.
TASK_ROWS = 100_000
NOTHING, FAILED = "NO RELEVANT INFORMATION", "FAILED: "
#: Short names and what they stand for, in the stand-in of abbreviations.
SHORT = (("hh", "Household Goods"), ("mach", "Machinery"), ("auto", "AUTOMOBILE"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Vectors


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), "embedding", "vec_id")
    return rows.filter("vec_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"), rows.select("chunk_id", "embedding")


_DISTANCES = """
d AS (SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS s
      FROM embeddings q, {x} x WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id)::INTEGER AS rank FROM d)
"""


@query("WITH " + _DISTANCES.format(x="embeddings") + "SELECT query_id, vec_id, rank, round(s, 6) AS score FROM k WHERE rank <= 5")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.vector_topk(*_vectors(spark, sf), K)
    return hits.select(F.col("query_id").cast("long").alias("query_id"), F.col("chunk_id").cast("long").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query("WITH " + _DISTANCES.format(x="embeddings") + "SELECT query_id, vec_id, rank, round(s, 6) AS score FROM k WHERE rank <= 5")
def knn_pivots(spark: SparkSession, sf: str) -> DataFrame:
    """The same search with the queries as a table, whatever their number."""
    queries, vectors = _vectors(spark, sf)
    hits = pivots.build_index(vectors).search(queries, K)
    return hits.select(F.col("query_id").cast("long").alias("query_id"), F.col("chunk_id").cast("long").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query(
    "WITH j AS (SELECT e.* FROM embeddings e SEMI JOIN documents ON vec_id = doc_id), "
    + _DISTANCES.format(x="j")
    + "SELECT query_id, count(*) AS n, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM k JOIN documents ON vec_id = doc_id WHERE rank <= 5 GROUP BY query_id"
)
def knn_context(spark: SparkSession, sf: str) -> DataFrame:
    queries, vectors = _vectors(spark, sf)
    docs = _t(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"), "text")
    hits = search.vector_topk(queries, vectors.join(docs.select("chunk_id"), "chunk_id", "left_semi"), K)
    context = search.concat_context(hits.join(docs, "chunk_id"))
    return context.select(F.col("query_id").cast("long").alias("query_id"), "n", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query(
    """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    m AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s FROM n)
    SELECT vec_id, len(e)::INTEGER AS n_dim, round(s, 6) AS norm, round(list_sum(list_transform(e, lambda x: x / s)), 6) AS unit_sum, round(e[1] / s, 6) AS first_unit FROM m"""
)
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    unit = v.l2_normalize(F.col("embedding"))
    return _t(spark, sf, "embeddings").select(
        "vec_id", F.size("embedding").alias("n_dim"), F.round(v.norm(F.col("embedding")), 6).alias("norm"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"), F.round(unit[0], 6).alias("first_unit")
    )


# Files, manifest, chunks


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "documents")
    return rows.select("doc_id", F.concat(F.lit("d_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), t.content_hash(F.col("text")).alias("md5"), "text", "source", "lang")


def _manifest(rows: DataFrame) -> DataFrame:
    """The documents as an older manifest would have them: some not there yet, some since changed."""
    old = F.when(F.col("doc_id") % 7 == 3, F.md5(F.concat("md5", F.lit("old")).cast("binary"))).otherwise(F.col("md5"))
    return rows.filter("doc_id % 10 <> 3").select("filename", old.alias("md5"), (F.col("doc_id") % 4).cast("int").alias("chunk_count"))


_DIFF = """
d AS (SELECT doc_id, 'd_' || doc_id || '.md' AS filename, md5(text) AS h FROM documents),
o AS (SELECT filename, CASE WHEN doc_id % 7 = 3 THEN md5(h || 'old') ELSE h END AS old, (doc_id % 4)::INTEGER AS chunk_count FROM d WHERE doc_id % 10 <> 3),
n AS (SELECT filename, h FROM d WHERE doc_id % 10 <> 5),
x AS (SELECT filename, h AS md5, old AS old_md5, chunk_count,
             CASE WHEN old IS NULL THEN 'new' WHEN h IS NULL THEN 'removed' WHEN h <> old THEN 'modified' ELSE 'unchanged' END AS status FROM o FULL JOIN n USING (filename))
"""


@query("WITH " + _DIFF + "SELECT * FROM x")
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = _listing(spark, sf)
    return files.manifest_diff(_manifest(rows), rows.filter("doc_id % 10 <> 5"))


@query("WITH " + _DIFF + "SELECT filename, filename || '::' || unnest(range(chunk_count)) AS chunk_id FROM x WHERE status IN ('removed', 'modified') AND chunk_count > 0")
def deleted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _listing(spark, sf)
    return files.deleted_chunk_ids(files.manifest_diff(_manifest(rows), rows.filter("doc_id % 10 <> 5")))


@query("SELECT 'd_' || doc_id || '.md' AS filename, md5(text) AS text_md5 FROM documents WHERE doc_id % 6 = 1 OR doc_id % 5 = 2 OR doc_id % 9 = 4")
def cache_miss(spark: SparkSession, sf: str) -> DataFrame:
    rows = _listing(spark, sf)
    cache = rows.filter("doc_id % 6 <> 1").select(
        "filename", F.when(F.col("doc_id") % 5 == 2, F.lit("changed")).otherwise(F.col("md5")).alias("content_hash"), F.when(F.col("doc_id") % 9 == 4, 1).otherwise(2).alias("schema_version")
    )
    return files.cache_miss(rows.select("filename", F.col("md5").alias("text_md5")), cache, 2)


@query(
    r"""WITH d AS (SELECT doc_id, source || '_' || lang || '_' || doc_id || '.md' AS filename, (doc_id % 5)::INTEGER AS k, text FROM documents)
    SELECT doc_id, filename, replace(regexp_replace(filename, '\.md$', ''), '_', ' ') AS title, CASE WHEN k = 0 THEN filename ELSE 'T' END AS shown,
           filename || '::' || k AS chunk_id, filename AS back, left(replace(text, chr(10), ' '), 100) AS snippet FROM d"""
)
def title_chunk_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "documents").withColumn("filename", F.concat_ws("_", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))).withColumn("k", (F.col("doc_id") % 5).cast("int"))
    shown = t.title_or_filename(F.when(F.col("k") == 0, "").otherwise("T"), F.col("filename"))
    chunk = t.chunk_id(F.col("filename"), F.col("k"))
    return rows.select("doc_id", "filename", t.title_of(F.col("filename")).alias("title"), shown.alias("shown"), chunk.alias("chunk_id"), t.filename_of(chunk).alias("back"), t.snippet(F.col("text")).alias("snippet"))


@query(
    """SELECT doc_id, '# ' || source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '## ' || lang END AS prefix,
       md5('# ' || source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '## ' || lang END || chr(10) || text) AS chunk_md5 FROM documents"""
)
def header_prefix_chunk(spark: SparkSession, sf: str) -> DataFrame:
    headers = F.create_map(F.lit("Header 2"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.lit("Header 1"), F.col("source"))
    rows = _t(spark, sf, "documents").select("doc_id", "text", t.header_prefix(headers, Settings().headers()).alias("prefix"))
    return rows.select("doc_id", "prefix", t.content_hash(t.add_prefix(F.col("text"), F.col("prefix"))).alias("chunk_md5"))


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = _listing(spark, sf)
    return rows.select("filename", t.title_of(F.col("filename")).alias("title"), F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), "text").alias("text"))


@query()
def markdown_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_files(_markdown(spark, sf)).select("chunk_id", "filename", "index", F.to_json("headers").alias("headers"), "text")


@query()
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_files(_markdown(spark, sf)).groupBy("filename").agg(F.count(F.lit(1)).alias("chunk_count"))


@query("SELECT 'd_' || doc_id || '.md::0' AS chunk_id, coalesce(CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END, '?') AS source, length(text)::INTEGER AS n_chars, text FROM documents")
def index_dump(spark: SparkSession, sf: str) -> DataFrame:
    rows = _listing(spark, sf)
    return files.index_dump(rows.select(t.chunk_id(F.col("filename"), F.lit(0)).alias("chunk_id"), F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("source"), "text"))


# Names


def _key_sql(x: str) -> str:
    return rf"lower(trim(regexp_replace(replace(replace({x}, '_', ' '), '-', ' '), '\s+', ' ', 'g')))"


@query(f"SELECT p_partkey, {_key_sql(chr(39) + ' ' + chr(39) + ' || upper(p_name) || ' + chr(39) + '-_' + chr(39) + ' || p_type')} AS norm_key FROM part")
def norm_key(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit(" "), F.upper("p_name"), F.lit("-_"), "p_type")
    return _t(spark, sf, "part").select("p_partkey", t.norm_key(name).alias("norm_key"))


_CASES = "CASE c_custkey % 4 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) ELSE ' hh ' END"


def _spellings(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("c_mktsegment")
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.upper("c_mktsegment")).when(k == 1, low).when(k == 2, F.initcap(low)).otherwise(" hh ")
    return _t(spark, sf, "customer").select("c_custkey", t.strip(name).alias("name"), F.when(F.col("c_nationkey") % 2 == 0, "Method").otherwise("Task").alias("type"))


def _short(spark: SparkSession) -> DataFrame:
    return files.abbreviations(spark.createDataFrame([(k, *x) for k, x in enumerate(SHORT)], "place int, short string, full_name string"))


_SHORT_SQL = "s(k, full_name) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SHORT) + ")"
_FULL = f"f AS (SELECT *, coalesce(full_name, name) AS full FROM (SELECT c_custkey, trim({_CASES}) AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'Method' ELSE 'Task' END AS type FROM customer) LEFT JOIN s ON k = {_key_sql('name')})"


@query(f"WITH {_SHORT_SQL}, {_FULL} SELECT c_custkey, name, \"full\" FROM f")
def abbreviation_expand(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spellings(spark, sf)
    return rows.join(resolve.expand_abbreviations(rows.select("name").distinct(), _short(spark)), "name").select("c_custkey", "name", "full")


_COUNTED = f"""c AS (SELECT {_key_sql('"full"')} AS norm_key, type, "full" AS name, count(*) AS n, (regexp_matches("full", '[A-Z]') AND regexp_matches("full", '[a-z]'))::INTEGER AS proper FROM f GROUP BY ALL),
i AS (SELECT norm_key, type, arg_max(name, row(n, proper, name)) AS canonical FROM c GROUP BY ALL)"""


@query(f"WITH {_SHORT_SQL}, {_FULL}, {_COUNTED} SELECT * FROM i")
def canonical_entity(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.entity_index(_spellings(spark, sf), _short(spark))


@query(
    f"""WITH {_SHORT_SQL}, {_FULL}, {_COUNTED},
    r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN upper(x) WHEN 1 THEN lower(x) ELSE x END AS name, 'Method' AS type
          FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'MACHINERY' ELSE substr(o_orderpriority, 3) END AS x FROM orders)),
    w AS (SELECT {_key_sql('name')} AS norm_key, type, arg_min(name, o_orderkey) AS canonical FROM r GROUP BY ALL)
    SELECT * FROM i UNION ALL SELECT * FROM w WHERE NOT EXISTS (FROM i WHERE i.norm_key = w.norm_key AND i.type = w.type)"""
)
def fallback_entity(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = F.when(k % 5 == 0, "MACHINERY").otherwise(F.expr("substr(o_orderpriority, 3)"))
    named = _t(spark, sf, "orders").select(F.when(k % 3 == 0, F.upper(x)).when(k % 3 == 1, F.lower(x)).otherwise(x).alias("name"), F.lit("Method").alias("type"), resolve.place(F.lit("f"), 2, k, 0).alias("place"))
    first = named.groupBy("name", "type").agg(F.min("place").alias("place"))
    references = first.join(resolve.keyed_names(first, _short(spark)), "name").select("norm_key", "type", "full", "place")
    return resolve.add_fallbacks(resolve.entity_index(_spellings(spark, sf), _short(spark)), references)


@query(
    r"""SELECT event_id, raw, try_cast(nullif(regexp_extract(raw, '-?\d+(?:\.\d+)?', 0), '') AS DOUBLE) AS value_num
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN event_type || ' -' || (event_id % 90) || '.5%' WHEN 2 THEN event_type ELSE NULL END AS raw FROM events)"""
)
def parse_value(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.col("props")).when(k % 4 == 1, F.concat("event_type", F.lit(" -"), (k % 90).cast("string"), F.lit(".5%"))).when(k % 4 == 2, F.col("event_type"))
    return _t(spark, sf, "events").select("event_id", raw.alias("raw")).select("event_id", "raw", t.parse_value(F.col("raw")).alias("value_num"))


@query(
    """SELECT l_orderkey, l_linenumber, md5('o' || l_orderkey || '|P' || l_partkey || '|qty|' || l_quantity::BIGINT || '|' || l_returnflag || '|' || CASE WHEN l_linestatus = 'O' THEN 'S' || l_suppkey ELSE '' END) AS result_id
    FROM lineitem WHERE l_quantity > 1"""
)
def result_id(spark: SparkSession, sf: str) -> DataFrame:
    def tagged(tag: str, c: str) -> Column:
        return F.concat(F.lit(tag), F.col(c).cast("string"))

    rows = _t(spark, sf, "lineitem").withColumn("value", F.when(F.col("l_quantity") > 1, F.col("l_quantity").cast("long").cast("string")).otherwise(" ")).filter(t.strip(F.col("value")) != "")
    key = t.result_id(tagged("o", "l_orderkey"), tagged("P", "l_partkey"), F.lit("qty"), F.col("value"), F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", tagged("S", "l_suppkey")))
    return rows.select("l_orderkey", "l_linenumber", key.alias("result_id"))


# Extraction


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies as events would give them: valid ones, one of a wrong kind, one that is no JSON."""
    k = F.col("event_id")
    kind = F.when(k % 5 == 0, "Method").when(k % 5 == 1, "Task").when(k % 5 == 2, "Other").otherwise("Metric")
    entity = F.struct(F.concat(F.lit(" "), F.col("event_type")).alias("name"), kind.alias("type"))
    relation = F.struct(F.col("event_type").alias("head"), F.lit("USES").alias("relation"), (k % 13).cast("string").alias("tail"))
    whole = F.to_json(F.struct(F.array(entity).alias("entities"), F.array(relation).alias("relations")))
    raw = F.when(k % 17 == 0, "no json").otherwise(whole)
    return _t(spark, sf, "events").select(k.cast("string").alias("chunk_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("filename"), k.cast("int").alias("index"), raw.alias("raw"), F.lit(None).cast("string").alias("error"))


@query(
    """SELECT event_id::VARCHAR AS chunk_id, 'u' || user_id AS filename, CASE WHEN event_id % 17 = 0 OR event_id % 5 = 2 THEN 'invalid reply' END AS error,
    CASE WHEN event_id % 17 = 0 OR event_id % 5 = 2 THEN NULL ELSE ' ' || event_type END AS name FROM events"""
)
def extraction_json(spark: SparkSession, sf: str) -> DataFrame:
    return flows.parse_extractions(_replies(spark, sf)).select("chunk_id", "filename", "error", F.col("result.entities")[0]["name"].alias("name"))


_VALID = "v AS (SELECT *, 'u' || user_id AS filename, CASE event_id % 5 WHEN 0 THEN 'Method' WHEN 1 THEN 'Task' ELSE 'Metric' END AS type FROM events WHERE event_id % 17 <> 0 AND event_id % 5 <> 2)"


@query(
    f"""WITH {_VALID},
    e AS (SELECT filename, string_agg(type || ':' || event_type, ',' ORDER BY type, event_type) AS entities FROM (SELECT DISTINCT filename, type, event_type FROM v) GROUP BY filename),
    r AS (SELECT filename, string_agg(event_type || '>' || tail, ',' ORDER BY event_type, tail) AS relations FROM (SELECT DISTINCT filename, event_type, (event_id % 13)::VARCHAR AS tail FROM v) GROUP BY filename),
    m AS (SELECT filename, count(*)::INTEGER AS n_mentions, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS places FROM v GROUP BY filename)
    SELECT d.filename, coalesce(entities, '') AS entities, coalesce(relations, '') AS relations, coalesce(n_mentions, 0) AS n_mentions, coalesce(places, '') AS places
    FROM (SELECT DISTINCT 'u' || user_id AS filename FROM events) d LEFT JOIN e USING (filename) LEFT JOIN r USING (filename) LEFT JOIN m USING (filename)"""
)
def serialise_order(spark: SparkSession, sf: str) -> DataFrame:
    replies = _replies(spark, sf)
    listing = replies.select("filename").distinct().withColumn("text_md5", F.lit("h")).withColumn("title", F.col("filename"))
    papers = flows.papers_of(flows.parse_extractions(replies), listing, 2)

    def joined(name: str, f: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(name, f), ",").alias(name if name != "mentions" else "places")

    return papers.select(
        "filename",
        joined("entities", lambda x: F.concat(x["type"], F.lit(":"), x["name"])),
        joined("relations", lambda x: F.concat(x["head"], F.lit(">"), x["tail"])),
        F.size("mentions").alias("n_mentions"),
        joined("mentions", lambda x: x["chunk_index"].cast("string")),
    )


@query(
    """SELECT 'o' || l_orderkey AS filename, l_linenumber::INTEGER AS position, CASE l_linenumber WHEN 1 THEN 'USES' WHEN 2 THEN 'INVOLVES' WHEN 3 THEN 'TARGETS' END AS relation,
    CASE l_linenumber WHEN 2 THEN 'P' || l_partkey ELSE 'o' || l_orderkey END AS head, CASE l_linenumber WHEN 1 THEN 'Method' ELSE 'Task' END AS tail_type, 'S' || l_suppkey AS tail FROM lineitem WHERE l_linenumber <= 3"""
)
def relation_schema_filter(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    relation = F.when(n == 1, "USES").when(n == 2, "INVOLVES").when(n == 3, "TARGETS").otherwise("LIKES")
    rows = _t(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("filename"), n.cast("int").alias("position"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("head"), relation.alias("relation"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("tail")
    )
    head = F.when(F.col("head_type") == "Paper", F.col("filename")).otherwise(F.col("head"))
    return graph.relation_rows(rows).select("filename", "position", "relation", head.alias("head"), "tail_type", "tail")


# Graph


def _key(tag: str, c: str) -> Column:
    return F.concat(F.lit(tag), F.col(c).cast("string"))


def _star(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (src, rel_type, dst), entities (entity, name, type) and mentions (entity, chunk_id) of the star tables."""
    items = _t(spark, sf, "lineitem")
    suppliers = _t(spark, sf, "supplier")
    rel = F.when(F.col("l_quantity") > 48, "EVALUATED_ON").otherwise("HAS_RESULT")
    edges = items.select(_key("P", "l_partkey").alias("src"), rel.alias("rel_type"), _key("S", "l_suppkey").alias("dst"))
    edges = edges.unionByName(suppliers.select(_key("S", "s_suppkey").alias("src"), F.lit("INVOLVES").alias("rel_type"), _key("N", "s_nationkey").alias("dst")))
    entities = _t(spark, sf, "part").select(_key("P", "p_partkey").alias("entity"), F.col("p_name").alias("name"), F.lit("Method").alias("type"))
    entities = entities.unionByName(suppliers.select(_key("S", "s_suppkey").alias("entity"), F.col("s_name").alias("name"), F.lit("Dataset").alias("type")))
    entities = entities.unionByName(_t(spark, sf, "nation").select(_key("N", "n_nationkey").alias("entity"), F.col("n_name").alias("name"), F.lit("Task").alias("type")))
    named = F.explode(F.array(_key("P", "l_partkey"), _key("S", "l_suppkey")))
    mentions = items.select(named.alias("entity"), _key("o", "l_orderkey").alias("chunk_id"))
    return edges, entities, mentions  # edges and mentions may repeat, as every reader makes its own rows distinct


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    hits = _t(spark, sf, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("query_id"), _key("o", "o_orderkey").alias("chunk_id"))
    return traverse.seed_entities(hits, _star(spark, sf)[2])


_STAR = """
e AS (SELECT DISTINCT 'P' || l_partkey AS src, CASE WHEN l_quantity > 48 THEN 'EVALUATED_ON' ELSE 'HAS_RESULT' END AS rel_type, 'S' || l_suppkey AS dst FROM lineitem
      UNION ALL SELECT 'S' || s_suppkey, 'INVOLVES', 'N' || s_nationkey FROM supplier),
x AS (SELECT 'P' || p_partkey AS entity, p_name AS name, 'Method' AS type FROM part UNION ALL SELECT 'S' || s_suppkey, s_name, 'Dataset' FROM supplier
      UNION ALL SELECT 'N' || n_nationkey, n_name, 'Task' FROM nation),
m AS (SELECT DISTINCT unnest(['P' || l_partkey, 'S' || l_suppkey]) AS entity, 'o' || l_orderkey AS chunk_id FROM lineitem),
seed AS (SELECT DISTINCT o_orderkey AS query_id, entity FROM orders JOIN m ON chunk_id = 'o' || o_orderkey WHERE o_orderkey % 20 = 0),
near AS (SELECT src, dst FROM e WHERE rel_type IN ('EVALUATED_ON', 'INVOLVES') UNION SELECT dst, src FROM e WHERE rel_type IN ('EVALUATED_ON', 'INVOLVES')),
"""
_REACHED = """
one AS (SELECT DISTINCT query_id, entity AS seed, dst AS node, 1 AS hop FROM seed JOIN near ON entity = src),
two AS (SELECT DISTINCT query_id, seed, dst AS node, 2 AS hop FROM one JOIN near ON node = src WHERE dst <> seed)
"""
_STAR += _REACHED
_EXPANDED = """, g AS (SELECT query_id, node AS entity, min(hop)::INTEGER AS hop, count(DISTINCT seed) AS n_seeds FROM {reached} r
 WHERE NOT EXISTS (FROM seed s WHERE s.query_id = r.query_id AND s.entity = r.node) GROUP BY ALL),
ranked AS (SELECT query_id, entity, name, type, hop, n_seeds, row_number() OVER (PARTITION BY query_id ORDER BY hop, n_seeds DESC, name, type, entity)::INTEGER AS rank FROM g JOIN x USING (entity)),
top AS (SELECT * FROM ranked WHERE rank <= 40)
"""


@query("WITH " + _STAR + "SELECT * FROM seed")
def seed_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _seeds(spark, sf)


def _expanded(spark: SparkSession, sf: str, hops: int) -> DataFrame:
    edges, entities, _ = _star(spark, sf)
    return traverse.expand_entities(_seeds(spark, sf), edges, entities, hops, ALLOWED, 40)


@query("WITH " + _STAR + _EXPANDED.format(reached="one") + "SELECT * FROM top")
def expand_1hop(spark: SparkSession, sf: str) -> DataFrame:
    return _expanded(spark, sf, 1)


@query("WITH " + _STAR.replace("IN ('EVALUATED_ON', 'INVOLVES')", "IN ('EVALUATED_ON', 'HAS_RESULT', 'INVOLVES')") + _EXPANDED.format(reached="one") + "SELECT * FROM top")
def expand_1hop_all(spark: SparkSession, sf: str) -> DataFrame:
    """One hop over the edges of all line items, whatever their type."""
    edges, entities, _ = _star(spark, sf)
    return traverse.expand_entities(_seeds(spark, sf), edges, entities, 1, [*ALLOWED, "HAS_RESULT"], 40)


@query("WITH " + _STAR + _EXPANDED.format(reached="(FROM one UNION ALL FROM two)") + "SELECT * FROM top")
def expand_2hop(spark: SparkSession, sf: str) -> DataFrame:
    return _expanded(spark, sf, 2)


_MENTIONED = ", c AS (SELECT DISTINCT query_id, entity, rank, chunk_id FROM top JOIN m USING (entity))"
_CANDIDATES = "WITH RECURSIVE " + _STAR + _EXPANDED.format(reached="one") + _MENTIONED


@query(_CANDIDATES + " SELECT * FROM c")
def entity_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.entity_chunks(_expanded(spark, sf, 1), _star(spark, sf)[2])


def _chosen(spark: SparkSession, sf: str, hops: int) -> DataFrame:
    posted = materialise(traverse.postings(_star(spark, sf)[2], select.needed(3, 20)), "postings")
    return select.greedy(traverse.posted_chunks(materialise(_expanded(spark, sf, hops), "expanded"), posted, limits=(3, 20)), 3, 20)


@query("WITH " + _STAR.split("seed AS")[0].rstrip().rstrip(",") + " SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY chunk_id) AS place, chunk_id FROM m QUALIFY place <= 22")
def posting_lists(spark: SparkSession, sf: str) -> DataFrame:
    posted = traverse.postings(_star(spark, sf)[2], select.needed(3, 20))
    return posted.select("entity", F.posexplode("chunk_ids").alias("place", "chunk_id")).withColumn("place", (F.col("place") + 1).cast("long"))


_WALK = """,
kept AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY chunk_id) <= 22),
p AS (SELECT query_id, rank, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS step FROM kept),
walk AS (SELECT query_id, 0::BIGINT AS step, []::VARCHAR[] AS taken, []::INTEGER[] AS ranks FROM (SELECT DISTINCT query_id FROM p)
    UNION ALL
    SELECT w.query_id, w.step + 1, CASE WHEN ok THEN list_append(taken, chunk_id) ELSE taken END, CASE WHEN ok THEN list_append(ranks, rank) ELSE ranks END
    FROM (SELECT w.*, p.chunk_id, p.rank, NOT list_contains(taken, p.chunk_id) AND len(list_filter(ranks, lambda r: r = p.rank)) < 3 AS ok
          FROM walk w JOIN p ON p.query_id = w.query_id AND p.step = w.step + 1 WHERE len(taken) < 20) w),
done AS (SELECT query_id, arg_max(taken, step) AS taken, arg_max(ranks, step) AS ranks FROM walk GROUP BY query_id)
"""


@query(_CANDIDATES + _WALK + "SELECT query_id, unnest(ranks) AS rank, unnest(taken) AS chunk_id, unnest(range(len(taken)))::INTEGER AS position FROM done")
def quota_select(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf, 1)


@query(_CANDIDATES.replace(_EXPANDED.format(reached="one"), _EXPANDED.format(reached="(FROM one UNION ALL FROM two)")) + _WALK + "SELECT query_id, unnest(ranks) AS rank, unnest(taken) AS chunk_id, unnest(range(len(taken)))::INTEGER AS position FROM done")
def quota_select_2hop(spark: SparkSession, sf: str) -> DataFrame:
    """The choice over the default two hops."""
    return _chosen(spark, sf, 2)


@query(
    """WITH v AS (SELECT l_orderkey AS query_id, 'P' || l_partkey AS chunk_id, l_linenumber::INTEGER AS position FROM lineitem WHERE l_linenumber <= 3),
    g AS (SELECT l_orderkey AS query_id, 'P' || (l_partkey // 2) AS chunk_id, l_linenumber::INTEGER AS position FROM lineitem),
    a AS (SELECT *, 0 AS turn, 'vector' AS source FROM v UNION ALL SELECT *, 1, 'graph' FROM g),
    o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY turn, position) = 1),
    n AS (SELECT query_id, chunk_id, source, (row_number() OVER (PARTITION BY query_id ORDER BY turn, position) - 1)::INTEGER AS merged_pos FROM o),
    c AS (SELECT query_id, sum((turn = 0)::INTEGER)::BIGINT AS vector_count, sum(turn)::BIGINT AS graph_count FROM a GROUP BY query_id)
    SELECT query_id, source, count(*) AS n_rows, sum(merged_pos)::BIGINT AS positions, count(DISTINCT chunk_id) AS n_chunks, vector_count, graph_count FROM n JOIN c USING (query_id) GROUP BY ALL"""
)
def merge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    items = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), "l_partkey", F.col("l_linenumber").cast("int").alias("position"))
    # Dealt by query once, as numbers, for both sides, their counts and the join; a task has about TASK_ROWS whatever the table.
    rows = items.repartition(max(1, -(-items.count() // TASK_ROWS)), "query_id")
    vector = rows.filter("position <= 3").select("query_id", _key("P", "l_partkey").alias("chunk_id"), "position")
    half = rows.select("query_id", F.concat(F.lit("P"), F.floor(F.col("l_partkey") / 2).cast("string")).alias("chunk_id"), "position")
    merged = select.merge_dedup(vector, half).join(select.source_counts(vector, half), "query_id")
    return merged.groupBy("query_id", "source", "vector_count", "graph_count").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("merged_pos").alias("positions"), F.countDistinct("chunk_id").alias("n_chunks"))


def _upserted(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "customer").select(_key("c", "c_custkey").alias("filename"), "c_custkey", F.col("c_name").alias("title"))
    old, new = rows.filter("c_custkey % 3 <> 0"), rows.filter("c_custkey % 2 = 0").withColumn("title", F.upper("title"))
    return graph.upsert(old.select("filename", "title"), new.select("filename", "title"), ["filename"])


@query("SELECT 'c' || c_custkey AS filename, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS title FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def node_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _upserted(spark, sf)


def _paper_graph(spark: SparkSession, sf: str, no_order: int = 1, no_part: int = 2) -> graph.Graph:
    """Orders as papers, parts as entities; some parts and orders are left out, so that edges to them dangle."""
    orders, parts, items = (_t(spark, sf, n) for n in ("orders", "part", "lineitem"))
    papers = orders.filter(F.col("o_orderkey") % 10 != no_order).select(_key("o", "o_orderkey").alias("filename"), F.col("o_orderpriority").alias("title"))
    chunks = papers.select(F.concat("filename", F.lit("::0")).alias("chunk_id"), "filename", F.lit(0).alias("index"), F.col("title").alias("text"))
    entities = parts.filter(F.col("p_partkey") % 10 != no_part).select(_key("P", "p_partkey").alias("name"), F.lit("Method").alias("type"))
    results = spark.createDataFrame([], flows.GRAPH_SCHEMAS["results"])
    uses = items.select(F.lit("Paper").alias("src_label"), _key("o", "l_orderkey").alias("src_key"), F.lit("USES").alias("rel_type"), F.lit("Entity").alias("dst_label"), graph.entity_key(_key("P", "l_partkey"), F.lit("Method")).alias("dst_key"))
    named = chunks.select(F.lit("Chunk").alias("src_label"), F.col("chunk_id").alias("src_key"), F.lit("PART_OF").alias("rel_type"), F.lit("Paper").alias("dst_label"), F.col("filename").alias("dst_key"))
    return graph.Graph(papers, entities, chunks, results, uses.unionByName(named))


def _papers_sql(no_order: int = 1, no_part: int = 2, tag: str = "") -> str:
    return f"""
p{tag} AS (SELECT 'o' || o_orderkey AS filename FROM orders WHERE o_orderkey % 10 <> {no_order}),
n{tag} AS (SELECT 'P' || p_partkey AS name FROM part WHERE p_partkey % 10 <> {no_part}),
e{tag} AS (SELECT DISTINCT 'Paper' AS src_label, 'o' || l_orderkey AS src_key, 'USES' AS rel_type, 'Entity' AS dst_label, 'Method' || chr(31) || 'P' || l_partkey AS dst_key
      FROM lineitem WHERE 'o' || l_orderkey IN (FROM p{tag}) AND 'P' || l_partkey IN (FROM n{tag})
      UNION ALL SELECT 'Chunk', filename || '::0', 'PART_OF', 'Paper', filename FROM p{tag})
"""


_PAPERS = _papers_sql()


@query("WITH " + _papers_sql(1, 2, "1") + "," + _papers_sql(4, 5, "2") + "SELECT * FROM e1 UNION SELECT * FROM e2")
def edge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return graph.upsert_graph(_paper_graph(spark, sf), _paper_graph(spark, sf, 4, 5), dangling=True).edges


@query("WITH " + _PAPERS + "SELECT 'Paper' AS label, count(*) AS n FROM p UNION ALL SELECT 'Chunk', count(*) FROM p UNION ALL SELECT 'Entity', count(*) FROM n")
def graph_node_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.node_counts(graph.node_keys(_paper_graph(spark, sf)))


@query("WITH " + _PAPERS + "SELECT rel_type, count(*) AS n FROM e GROUP BY rel_type")
def graph_edge_counts(spark: SparkSession, sf: str) -> DataFrame:
    whole = _paper_graph(spark, sf)
    return graph.edge_counts(graph.connected(whole, whole.edges))


@query(
    f"""WITH {_VALID} SELECT d.filename, coalesce(n_entities, 0) AS n_entities, coalesce(n_relations, 0) AS n_relations, coalesce(n_mentions, 0) AS n_mentions, 0 AS n_performances
    FROM (SELECT DISTINCT 'u' || user_id AS filename FROM events) d LEFT JOIN
    (SELECT filename, count(DISTINCT type || ':' || event_type)::INTEGER AS n_entities, count(DISTINCT event_type || '>' || (event_id % 13))::INTEGER AS n_relations, count(*)::INTEGER AS n_mentions FROM v GROUP BY filename) USING (filename)"""
)
def build_summary(spark: SparkSession, sf: str) -> DataFrame:
    replies = _replies(spark, sf)
    listing = replies.select("filename").distinct().withColumn("text_md5", F.lit("h")).withColumn("title", F.col("filename"))
    return graph.build_summary(flows.papers_of(flows.parse_extractions(replies), listing, 2))


# The whole build


_TITLE = "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END"


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Extractions of the orders as papers: line items name parts in three spellings, suppliers in two, and results that may be blank."""
    raw = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    items = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(*raw)).alias("items"))

    def listed(x: Column) -> dict[str, Column]:
        """What a line item says; the items of an order are shuffled once, as they are."""
        n, q = x["l_linenumber"].cast("int"), x["l_quantity"]
        part = F.concat(F.lit("part-"), (x["l_partkey"] % 400).cast("string"))
        method = F.when(n % 3 == 0, F.upper(part)).when(n % 3 == 1, part).otherwise(F.initcap(part))
        supplier = F.concat(F.when(n % 2 == 0, "Supp_").otherwise("SUPP "), (x["l_suppkey"] % 30).cast("string"))
        scenario, task = F.concat(F.lit("scene "), (x["l_suppkey"] % 7).cast("string")), F.concat(F.lit("Task "), (x["l_partkey"] % 20).cast("string"))
        metric = F.when(x["l_returnflag"] == "A", "acc").when(x["l_returnflag"] == "N", " Accuracy").otherwise("F1")
        relation = F.element_at(F.array(*map(F.lit, ("USES", "EVALUATED_ON", "TARGETS", "APPLIES_TO", "ADDRESSES", "INVOLVES", "LIKES"))), n)
        head = F.when(n.isin(2, 4), method).when(n == 6, scenario).otherwise("this paper")
        tail = F.when(n == 1, method).when(n == 2, supplier).when(n.isin(4, 5), scenario).otherwise(task)
        value = F.when(q < 4, " ").otherwise(F.concat(q.cast("long").cast("string"), F.lit("%")))
        result = F.struct(n.alias("chunk_index"), F.when((n == 5) & (x["l_returnflag"] == "R"), "").otherwise(method).alias("method"), metric.alias("metric"), value.alias("value"), F.lit("").alias("condition"), F.when(x["l_linestatus"] == "O", supplier).otherwise(" ").alias("dataset"))
        made = {
            "e": F.when(n <= 4, F.struct(F.lit("Method").alias("type"), method.alias("name"))),
            "r": F.struct(head.alias("head"), relation.alias("relation"), tail.alias("tail")),
            "p": result,
            "m": F.struct(n.alias("chunk_index"), F.lit("Method").alias("type"), method.alias("name")),
        }
        return {name: F.struct(n.alias("n"), y.alias("x")) for name, y in made.items()}

    def sorted_list(name: str) -> Column:
        return F.sort_array(F.transform("items", lambda x: listed(x)[name])).alias(name)

    lists = items.select("o_orderkey", *map(sorted_list, "erpm"))

    def bare(name: str) -> Column:
        return F.filter(F.transform(F.coalesce(F.col(name), F.array()), lambda x: x["x"]), lambda x: x.isNotNull())

    papers = _t(spark, sf, "orders").select("o_orderkey", _key("o", "o_orderkey").alias("filename"), F.expr(_TITLE).alias("title")).join(lists, "o_orderkey", "left")
    return papers.select(
        "filename", F.lit("h").alias("content_hash"), "title", F.lit(2).alias("schema_version"), F.array_distinct(bare("e")).alias("entities"), bare("r").alias("relations"), bare("p").alias("performances"),
        bare("m").alias("mentions"), F.size(bare("m")).alias("n_mentions"), F.size(bare("p")).alias("n_performances"),
    )


def _build_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extractions, written once as a store has them, chunks and abbreviations. Chunks 0 to 3 of most orders; mentions in later ones, and in those of the others, dangle."""
    papers = _t(spark, sf, "orders").filter("o_orderkey % 10 <> 1").select(_key("o", "o_orderkey").alias("filename"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("index"))
    chunks = papers.select(t.chunk_id(F.col("filename"), F.col("index")).alias("chunk_id"), "filename", "index", F.concat(F.lit("text "), F.col("index").cast("string")).alias("text"))
    short = files.abbreviations(spark.createDataFrame([(0, "acc", "Accuracy")], "place int, short string, full_name string"))
    return materialise(_extracted(spark, sf), "extractions"), chunks, short


def _built(spark: SparkSession, sf: str) -> graph.Graph:
    return graph.build(*_build_inputs(spark, sf), lambda name, df: materialise(df, name))


_BUILT = f"""
l0 AS (SELECT 'o' || l_orderkey AS f, l_linenumber::INTEGER AS n, 'part-' || (l_partkey % 400) AS part, (l_suppkey % 30)::VARCHAR AS s, 'scene ' || (l_suppkey % 7) AS scenario, 'Task ' || (l_partkey % 20) AS task,
       CASE l_returnflag WHEN 'A' THEN 'Accuracy' WHEN 'N' THEN 'Accuracy' ELSE 'F1' END AS metric, l_returnflag, l_linestatus, l_quantity FROM lineitem),
l AS (SELECT *, CASE n % 3 WHEN 0 THEN upper(part) WHEN 1 THEN part ELSE 'P' || substr(part, 2) END AS method, CASE WHEN n % 2 = 0 THEN 'Supp_' ELSE 'SUPP ' END || s AS supplier FROM l0),
perf AS (SELECT f, n, CASE WHEN n = 5 AND l_returnflag = 'R' THEN '' ELSE method END AS method, metric, (l_quantity::BIGINT) || '%' AS value, CASE WHEN l_linestatus = 'O' THEN supplier ELSE '' END AS dataset FROM l WHERE l_quantity >= 4),
rel AS (SELECT f, n, CASE n WHEN 1 THEN 'USES' WHEN 2 THEN 'EVALUATED_ON' WHEN 3 THEN 'TARGETS' WHEN 4 THEN 'APPLIES_TO' WHEN 5 THEN 'ADDRESSES' ELSE 'INVOLVES' END AS relation,
        CASE WHEN n IN (2, 4) THEN method WHEN n = 6 THEN scenario END AS head, CASE WHEN n IN (2, 4) THEN 'Method' WHEN n = 6 THEN 'ProblemScenario' END AS head_type,
        CASE WHEN n = 1 THEN method WHEN n = 2 THEN supplier WHEN n IN (4, 5) THEN scenario ELSE task END AS tail,
        CASE n WHEN 1 THEN 'Method' WHEN 2 THEN 'Dataset' WHEN 4 THEN 'ProblemScenario' WHEN 5 THEN 'ProblemScenario' ELSE 'Task' END AS tail_type FROM l WHERE n <= 6),
listed AS (SELECT method AS name, 'Method' AS type, count(DISTINCT f) AS c FROM l WHERE n <= 4 GROUP BY ALL),
canon AS (SELECT {_key_sql("name")} AS k, type, arg_max(name, row(c, (regexp_matches(name, '[A-Z]') AND regexp_matches(name, '[a-z]'))::INTEGER, name)) AS canonical FROM listed GROUP BY ALL),
met AS (SELECT method AS name, 'Method' AS type, f, 0 AS phase, n, 0 AS slot FROM l
        UNION ALL SELECT method, 'Method', f, 1, n, 0 FROM perf UNION ALL SELECT metric, 'Metric', f, 1, n, 1 FROM perf UNION ALL SELECT dataset, 'Dataset', f, 1, n, 2 FROM perf WHERE dataset <> ''
        UNION ALL SELECT head, head_type, f, 2, n, 0 FROM rel WHERE head IS NOT NULL UNION ALL SELECT tail, tail_type, f, 2, n, 1 FROM rel),
back AS (SELECT {_key_sql("name")} AS k, type, arg_min(name, row(f, phase, n, slot)) AS canonical FROM met GROUP BY ALL),
entry AS (SELECT * FROM canon UNION ALL SELECT * FROM back WHERE NOT EXISTS (FROM canon c WHERE c.k = back.k AND c.type = back.type)),
named AS (SELECT name, x.type, canonical FROM (SELECT DISTINCT name, type, {_key_sql("name")} AS k FROM met) x JOIN entry USING (k) WHERE x.type = entry.type),
paper AS (SELECT 'o' || o_orderkey AS filename, coalesce(nullif({_TITLE}, ''), 'o' || o_orderkey) AS title FROM orders),
chunk AS (SELECT 'o' || o_orderkey || '::' || i AS chunk_id, 'o' || o_orderkey AS filename, i AS index FROM orders, range(4) r(i) WHERE o_orderkey % 10 <> 1),
result AS (SELECT f, a.canonical AS method, b.canonical AS metric, value, dataset, md5(f || '|' || a.canonical || '|' || b.canonical || '|' || value || '||' || dataset) AS result_id
           FROM perf JOIN named a ON a.name = perf.method AND a.type = 'Method' JOIN named b ON b.name = perf.metric AND b.type = 'Metric'),
"""


@query(
    "WITH "
    + _BUILT
    + """
edges AS (
    SELECT 'Chunk' AS src_label, chunk_id AS src_key, 'PART_OF' AS rel_type, 'Paper' AS dst_label, filename AS dst_key FROM chunk
    UNION SELECT 'Entity', 'Method' || chr(31) || canonical, 'MENTIONED_IN', 'Chunk', f || '::' || n FROM l JOIN named ON name = method AND type = 'Method' WHERE f || '::' || n IN (SELECT chunk_id FROM chunk)
    UNION SELECT 'Entity', 'Method' || chr(31) || method, 'REPORTED', 'PerformanceResult', result_id FROM result
    UNION SELECT 'PerformanceResult', result_id, 'OF_METRIC', 'Entity', 'Metric' || chr(31) || metric FROM result
    UNION SELECT 'PerformanceResult', result_id, 'ON_DATASET', 'Entity', 'Dataset' || chr(31) || canonical FROM result JOIN named ON name = dataset AND type = 'Dataset'
    UNION SELECT 'Paper', f, 'HAS_RESULT', 'PerformanceResult', result_id FROM result
    UNION SELECT 'Paper', f, relation, 'Entity', tail_type || chr(31) || canonical FROM rel JOIN named ON name = tail AND type = tail_type WHERE head IS NULL
    UNION SELECT 'Entity', head_type || chr(31) || a.canonical, relation, 'Entity', tail_type || chr(31) || b.canonical FROM rel JOIN named a ON a.name = head AND a.type = head_type JOIN named b ON b.name = tail AND b.type = tail_type)
SELECT * FROM edges"""
)
def graph_build(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of all eight kinds."""
    return _built(spark, sf).edges


@query(
    "WITH "
    + _BUILT
    + """
nodes AS (
    SELECT 'Paper' AS label, filename AS key, title AS detail FROM paper
    UNION ALL SELECT DISTINCT 'Entity', type || chr(31) || canonical, canonical FROM named
    UNION ALL SELECT 'Chunk', chunk_id, 'text ' || index FROM chunk
    UNION ALL SELECT DISTINCT 'PerformanceResult', result_id, metric || '|' || value || '|' || regexp_extract(value, '[0-9]+') || '.0|' || dataset FROM result)
SELECT * FROM nodes"""
)
def graph_build_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of all four labels with what they carry."""
    made = _built(spark, sf)
    result = F.concat_ws("|", "metric", "value", F.col("value_num").cast("string"), "dataset")
    rows = made.papers.select(F.lit("Paper").alias("label"), F.col("filename").alias("key"), F.col("title").alias("detail"))
    rows = rows.unionByName(made.entities.select(F.lit("Entity").alias("label"), graph.entity_key(F.col("name"), F.col("type")).alias("key"), F.col("name").alias("detail")))
    rows = rows.unionByName(made.chunks.select(F.lit("Chunk").alias("label"), F.col("chunk_id").alias("key"), F.col("text").alias("detail")))
    return rows.unionByName(made.results.select(F.lit("PerformanceResult").alias("label"), F.col("result_id").alias("key"), result.alias("detail")))


@query(
    "WITH "
    + _BUILT
    + """x AS (SELECT 1)
SELECT (SELECT count(*) FROM paper) AS papers, (SELECT count(*) FROM (SELECT DISTINCT type, canonical FROM named)) AS entities, (SELECT count(*) FROM chunk) AS chunks,
       (SELECT count(*) FROM l) AS mentions, (SELECT count(*) FROM rel) AS relations, (SELECT count(*) FROM perf) AS results"""
)
def build_totals(spark: SparkSession, sf: str) -> DataFrame:
    extractions, chunks, short = _build_inputs(spark, sf)
    return graph.build_totals(extractions, chunks, graph.build(extractions, chunks, short, lambda name, df: materialise(df, name)))


# Retrieval and answers


_FOUND = (
    "WITH RECURSIVE j AS (SELECT e.* FROM embeddings e SEMI JOIN documents ON vec_id = doc_id), "
    + _DISTANCES.format(x="j")
    + """,
hits AS (SELECT lpad(query_id::VARCHAR, 12, '0') AS query_id, lpad(vec_id::VARCHAR, 12, '0') AS chunk_id, rank, round(s, 6) AS score FROM k WHERE rank <= 5),
docs AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS chunk_id, source, lang, label FROM documents JOIN embeddings ON vec_id = doc_id),
linked AS (SELECT chunk_id, 'Method' AS type, source AS name FROM docs UNION ALL SELECT chunk_id, 'Task', lang FROM docs UNION ALL SELECT chunk_id, 'ProblemScenario', label::VARCHAR FROM docs),
m AS (SELECT type || chr(31) || name AS entity, chunk_id FROM linked),
x AS (SELECT DISTINCT type || chr(31) || name AS entity, name, type FROM linked),
seed AS (SELECT DISTINCT query_id, entity FROM hits JOIN m USING (chunk_id)),
near AS (SELECT chunk_id AS src, entity AS dst FROM m UNION SELECT entity, chunk_id FROM m),
"""
    + _REACHED
    + _EXPANDED.format(reached="(FROM one UNION ALL FROM two)")
    + _MENTIONED
    + _WALK
    + """,
chosen AS (SELECT query_id, unnest(ranks) AS rank, unnest(taken) AS chunk_id, unnest(range(len(taken)))::INTEGER AS position FROM done),
both_ways AS (SELECT query_id, chunk_id, rank AS position, score, NULL::INTEGER AS hop, NULL::BIGINT AS n_seeds, NULL::VARCHAR AS entity, 'vector' AS source, 0 AS turn FROM hits
    UNION ALL SELECT query_id, chunk_id, position, NULL, hop, n_seeds, name, 'graph', 1 FROM chosen JOIN top USING (query_id, rank)),
once AS (SELECT * FROM both_ways QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY turn, position) = 1)
SELECT query_id, chunk_id, source, (row_number() OVER (PARTITION BY query_id ORDER BY turn, position) - 1)::INTEGER AS merged_pos, score, hop, n_seeds, entity FROM once"""
)


@query(_FOUND)
def retrieve_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    queries, vectors = _vectors(spark, sf)
    docs = _t(spark, sf, "documents").join(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    chunk = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    rows = docs.select(chunk.alias("chunk_id"), F.explode(F.array(*[F.struct(F.lit(r).alias("rel_type"), F.lit(k).alias("type"), F.col(c).cast("string").alias("name")) for r, k, c in (("USES", "Method", "source"), ("TARGETS", "Task", "lang"), ("ADDRESSES", "ProblemScenario", "label"))])).alias("e"))
    linked = traverse.written("linked", rows.select("chunk_id", "e.*")).withColumn("entity", graph.entity_key(F.col("name"), F.col("type")))
    edges = linked.select(F.col("chunk_id").alias("src"), "rel_type", F.col("entity").alias("dst"))
    kept = vectors.join(docs.select(chunk.alias("chunk_id")), "chunk_id", "left_semi")
    found = flows.retrieve(queries, kept, edges, linked.select("entity", "name", "type").distinct(), linked.select("entity", "chunk_id"))
    return found.select("query_id", "chunk_id", "source", "merged_pos", F.round("score", 6).alias("score"), "hop", "n_seeds", "entity")


@query(
    r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> ''))  AS ws FROM documents),
    q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS qs FROM benchmark),
    t AS (SELECT item_id, qs, unnest(qs) AS word FROM q), d AS (SELECT doc_id, unnest(ws) AS word FROM w),
    s AS (SELECT item_id AS query_id, doc_id, count(*) / len(any_value(qs))::DOUBLE AS score FROM t JOIN d USING (word) GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 10"""
)
def rerank_topn(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the share of each benchmark text's words that they have: an inverted index of the queries in place of a join."""

    def words(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z]+"), lambda w: w != ""))

    wanted = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words(F.col("text")).alias("words"))
    had = _t(spark, sf, "documents").select(F.col("doc_id").alias("key"), words(F.col("text")).alias("words"))
    top = search.lexical_topk(wanted, had, 10)
    return top.select("query_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as compressed texts: every fifth is the marker, every seventh a failure."""
    rows = _t(spark, sf, "conversations")
    n = F.col("conv_id") + F.col("turn")
    text = F.when(n % 5 == 0, NOTHING + "。").when(n % 7 == 0, FAILED + "x").otherwise(F.col("text"))
    return rows.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("filename"), text.alias("text"))


_POINTS = "p AS (SELECT conv_id AS query_id, turn AS rank, role AS filename, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS number FROM conversations WHERE (conv_id + turn) % 5 <> 0 AND (conv_id + turn) % 7 <> 0)"


@query(f"WITH {_POINTS} SELECT query_id, rank, number, text FROM p")
def relevance_filter(spark: SparkSession, sf: str) -> DataFrame:
    return select.renumber(_points(spark, sf).filter(select.is_relevant(F.col("text"), NOTHING, FAILED))).select("query_id", "rank", "number", "text")


@query(f"WITH {_POINTS} SELECT query_id, string_agg('[' || number || '] source: ' || filename || chr(10) || text, chr(10) || chr(10) ORDER BY number) AS points FROM p GROUP BY query_id")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    return select.cited_points(select.renumber(_points(spark, sf).filter(select.is_relevant(F.col("text"), NOTHING, FAILED))))


@query()
def answer_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding, search, reranking, compression and answers with the offline models; the questions are the benchmark texts.

    Documents are read in chunks. One of short words may have more than the reranker's 512, so that it reads as far as the embedder.
    """
    # Dealt out, so that a task does not split and embed at a time, with a Python process for each.
    chunks = chunk_files(_listing(spark, sf).withColumn("title", F.col("filename"))).select("chunk_id", "filename", "text").repartition("chunk_id")
    vectors = chunks.select("chunk_id", models.embed(F.col("text"), models.HashEmbedder).alias("embedding"))
    questions = _t(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question"))
    queries = questions.select("query_id", models.embed(F.col("question"), models.HashEmbedder, True).alias("embedding"))
    hits = search.vector_topk(queries, vectors, K)
    found = hits.select("query_id", "chunk_id", (F.col("rank") - 1).alias("merged_pos"))
    points = flows.answer_points(questions, found, chunks, lambda: models.LexicalReranker(2048), lambda: models.ExtractiveGenerator(NOTHING), "{question} [{number}] {source}", NOTHING, FAILED)
    return flows.answers(questions, points, lambda: models.ExtractiveGenerator(NOTHING), "{question}", "no source", FAILED)
