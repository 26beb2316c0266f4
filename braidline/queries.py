"""The registry: a query for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import corpus, templates
from .functions import columns as C
from .operators import focus, graph, score, store, text
from .operators.analysis import analyze_sources, analyze_statements, edge_pairs
from .operators.pipelines import evaluate
from .sources.artefacts import artefacts, interfaces_of
from .sources.files import catalog_columns, columns_of
from .sources.records import decode_blobs, encode_blobs
from .sources.tables import column_graph, diagnostics, engine_graph, key_graph, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The graphs of ``sources.tables`` in SQL.
A = """a AS (SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS ord, 'SYN.T' || (l_suppkey % 40) || '.C' || l_linenumber AS source,
 'SYN.T' || (l_partkey % 40) || '.C' || (l_linenumber % 3) AS target,
 CASE l_returnflag WHEN 'A' THEN 'DIRECT' WHEN 'N' THEN 'TRANSFORM' ELSE 'INDIRECT_FILTER' END AS kind,
 'f' || (l_orderkey % 20) || '.sql' AS file, CAST(l_orderkey AS BIGINT) % 500 AS line FROM lineitem)"""
E = A + ", e AS (SELECT * FROM a WHERE (ord // 10) % 17 <> 0 UNION ALL SELECT ord, source || 'X', target, kind, file, line FROM a WHERE (ord // 10) % 23 = 0)"
K = """k AS (SELECT CAST(n_nationkey AS BIGINT) AS ord, 'REGION.' || n_regionkey AS source, 'NATION.' || n_nationkey AS target FROM nation
 UNION ALL SELECT c_custkey + 1000000000, 'NATION.' || c_nationkey, 'CUSTOMER.' || c_custkey FROM customer
 UNION ALL SELECT s_suppkey + 2000000000, 'NATION.' || s_nationkey, 'SUPPLIER.' || s_suppkey FROM supplier
 UNION ALL SELECT o_orderkey + 3000000000, 'CUSTOMER.' || o_custkey, 'ORDERS.' || o_orderkey FROM orders)"""
D = """d AS (SELECT 'f' || (user_id % 20) || '.sql' AS file, CAST(event_id % 500 AS BIGINT) AS line, 'warning' AS severity,
 CASE event_id % 5 WHEN 0 THEN 'PARSE_FAILED' WHEN 1 THEN 'DYNAMIC_SQL' WHEN 2 THEN 'DYNAMIC_SQL_PARTIAL' WHEN 3 THEN 'UNRESOLVED' ELSE 'SQL_NOT_ANALYZED' END AS code,
 'event ' || event_type AS message FROM events)"""
NODES = "n AS (SELECT upper(name) AS key, min(ord) AS ord FROM (SELECT ord, source AS name FROM a UNION ALL SELECT ord, target FROM a) GROUP BY 1)"
NORM = "CASE kind WHEN 'INDIRECT_FILTER' THEN 'FILTER' ELSE kind END"


def query(sql: str | None = None, name: str = ""):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# -- load and normalise ------------------------------------------------------------------------------------------


@query(f"WITH {A} SELECT file, kind, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM (SELECT file, {NORM} AS kind, source, target FROM a) GROUP BY ALL")
def assertions_load(spark: SparkSession, sf: str) -> DataFrame:
    return column_graph(spark, sf).withColumn("kind", C.kind(F.col("kind"))).groupBy("file", "kind").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets"))


@query(f"WITH {A} SELECT kind, {NORM} AS canonical, CASE WHEN kind = 'INDIRECT_FILTER' THEN 'FILTER' ELSE 'VALUE' END AS coarse, CASE WHEN kind = 'INDIRECT_FILTER' THEN 'filters' ELSE 'flows' END AS viewer, count(*) AS n FROM a GROUP BY ALL")
def kind_normalise(spark, sf):
    k = F.col("kind")
    return column_graph(spark, sf).groupBy("kind", C.kind(k).alias("canonical"), C.coarse(k).alias("coarse"), C.viewer_type(k).alias("viewer")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, p_brand || '.' || CASE WHEN p_size % 3 = 0 THEN '*' ELSE p_type END AS fqn FROM part")
def fqn_build(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.fqn(F.col("p_brand"), F.when(F.col("p_size") % 3 != 0, F.col("p_type"))).alias("fqn"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'L' || s_nationkey END AS link, 'SYN' AS schema_name FROM supplier")
def dblink_split(spark, sf):
    key = F.col("s_suppkey")
    spelled = F.concat(F.lit("SYN."), F.col("s_name"), F.when(key % 3 == 0, F.concat(F.lit("@L"), F.col("s_nationkey").cast("string"))).when(key % 3 == 1, F.lit("@A@B")).otherwise(""))
    return table(spark, sf, "supplier").select(key.alias("id"), spelled.alias("t")).select("id", C.link_of(F.col("t")).alias("link"), C.schema_of(F.col("t")).alias("schema_name"))


@query("SELECT s_suppkey AS id, lower('SYN.' || s_name) AS object_id FROM supplier")
def object_ids(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), C.object_id(F.concat(F.lit("SYN."), F.col("s_name"))).alias("object_id"))


@query(f"WITH {A} SELECT ord, file || ':' || line || ' PKG.' || kind AS place FROM a")
def span_text(spark, sf):
    return column_graph(spark, sf).select("ord", C.place(F.col("file"), F.col("line"), F.lit("PKG"), F.col("kind")).alias("place"))


@query("WITH x AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE lower(o_orderpriority) END AS name FROM orders) SELECT upper(name) AS key, arg_min(name, ord) AS display FROM x GROUP BY 1")
def display_first_seen(spark, sf):
    names = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("source"))
    return graph.nodes(names.withColumn("target", F.col("source"))).select("key", "display")


@query(f"WITH {A} SELECT source, target, {NORM} AS kind, min(ord) AS ord FROM a GROUP BY ALL")
def edge_dedup(spark, sf):
    return column_graph(spark, sf).groupBy("source", "target", C.kind(F.col("kind")).alias("kind")).agg(F.min("ord").alias("ord"))


@query("SELECT c_custkey AS id, lower(printf('%08x', h)) AS id_hash FROM (SELECT c_custkey, c_name FROM customer) t, LATERAL (SELECT list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(c_name) + 1), lambda i: CAST(ascii(c_name[i]) AS BIGINT))), lambda x, y: (xor(x, y) * 16777619) & 4294967295) AS h)")
def edge_hash(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), C.fnv1a(F.col("c_name")).alias("id_hash"))


@query("SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS n_lines, length(regexp_replace(trim(coalesce(text, '')), '[ \\n]+', ' ', 'g')) AS squeezed FROM documents")
def line_counts(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", C.line_count(text).cast("long").alias("n_lines"), F.length(F.regexp_replace(F.trim(text), "[ \n]+", " ")).cast("long").alias("squeezed"))


@query("SELECT p_partkey AS id, p_brand || '/' || p_type AS path_key FROM part")
def pipeline_path_keys(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.pipeline_key(F.concat(F.lit("/"), F.col("p_brand"), F.lit(";4;0;ns/"), F.col("p_type"), F.lit(";1;0"))).alias("path_key"))


@query("SELECT s_suppkey AS id, 'It''s ' || s_name AS said FROM supplier")
def string_literals(spark, sf):
    name, key = F.col("s_name"), F.col("s_suppkey")
    spelled = F.when(key % 2 == 0, F.concat(F.lit("'It''s "), name, F.lit("'"))).otherwise(F.concat(F.lit("q'[It's "), name, F.lit("]'")))
    return table(spark, sf, "supplier").select(key.alias("id"), C.oracle_literal(spelled).alias("said"))


# -- catalogue ----------------------------------------------------------------------------------------------------


def _ddl(spark, sf):
    n = F.col("n_nationkey").cast("string")
    return table(spark, sf, "nation").select(F.concat(F.lit("CREATE TABLE SYN.T"), n, F.lit(" (\n ID NUMBER(10,2) NOT NULL,\n NAME VARCHAR2(20), R"), F.col("n_regionkey").cast("string"), F.lit(" DATE,\n CONSTRAINT pk PRIMARY KEY (ID)\n);\n")).alias("text"))


@query("SELECT 'SYN.T' || n_nationkey AS \"table\", CAST(o AS BIGINT) AS ordinal, CASE o WHEN 0 THEN 'ID' WHEN 1 THEN 'NAME' ELSE 'R' || n_regionkey END AS \"column\" FROM nation, range(3) AS r(o)")
def catalog_load(spark, sf):
    return catalog_columns(_ddl(spark, sf))


@query("SELECT name, ordinal, c AS \"column\" FROM (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'syn.t' || n_nationkey WHEN 1 THEN 'T' || n_nationkey || '@L' ELSE 'NONE.X' || n_nationkey END AS name, n_nationkey % 3 AS m, CAST(o AS BIGINT) AS ordinal, CASE o WHEN 0 THEN 'ID' WHEN 1 THEN 'NAME' ELSE 'R' || n_regionkey END AS c FROM nation, range(3) AS r(o)) WHERE m < 2")
def catalog_lookup(spark, sf):
    n = F.col("n_nationkey")
    s = n.cast("string")
    names = table(spark, sf, "nation").select(F.when(n % 3 == 0, F.concat(F.lit("syn.t"), s)).when(n % 3 == 1, F.concat(F.lit("T"), s, F.lit("@L"))).otherwise(F.concat(F.lit("NONE.X"), s)).alias("name"))
    return columns_of(catalog_columns(_ddl(spark, sf)), names)


@query("SELECT 'SYN.T' || n_nationkey AS name FROM nation WHERE n_nationkey % 2 = 1")
def validation_unknown_tables(spark, sf):
    known = catalog_columns(_ddl(spark, sf)).select("table").distinct().where("cast(substring(table, 6) as int) % 2 = 0")
    return table(spark, sf, "nation").select(F.concat(F.lit("SYN.T"), F.col("n_nationkey").cast("string")).alias("name")).join(known, F.col("name") == F.col("table"), "left_anti")


# -- seeds ----------------------------------------------------------------------------------------------------------


def _seed(name: str, text: str, sql: str) -> None:
    query(f"WITH {A}, {NODES} {sql}", name)(lambda spark, sf: graph.resolve_seeds(graph.nodes(column_graph(spark, sf)), text))


_seed("seed_exact", "syn.t7.c1", "SELECT key, 'exact' AS how FROM n WHERE key = 'SYN.T7.C1'")
_seed("seed_suffix", "t7.c1", "SELECT key, 'suffix' AS how FROM n WHERE key = 'SYN.T7.C1'")
_seed("seed_ambiguous", "c5", "SELECT key, 'ambiguous' AS how FROM n WHERE key LIKE '%.C5'")


@query(f"WITH {A}, {NODES} SELECT key, score FROM (SELECT key, CAST(CASE WHEN split_part(key, '.', 3) = 'T1' OR key LIKE '%T1' THEN 0 WHEN contains(key, 'T1') THEN 1 END AS BIGINT) AS score FROM n) WHERE score IS NOT NULL ORDER BY score, key LIMIT 8")
def candidate_top8(spark, sf):
    return graph.candidates(graph.nodes(column_graph(spark, sf)), "t1")


@query(f"WITH {A}, {NODES} SELECT key, lower(key) AS id FROM n WHERE contains(lower(key), 't39') ORDER BY key LIMIT 40")
def node_search(spark, sf):
    known = graph.nodes(column_graph(spark, sf))
    return known.where(F.contains(F.lower("key"), F.lit("t39"))).orderBy("key").limit(40).select("key", C.object_id(F.col("key")).alias("id"))


# -- walks ----------------------------------------------------------------------------------------------------------


def _walk_sql(graph_sql: str, kinds: str, seed: str, depth: int, here: str, there: str) -> str:
    return f"WITH RECURSIVE {graph_sql}, s AS (SELECT DISTINCT {here} AS h, {there} AS t FROM a WHERE {kinds}), w(key, depth) AS (SELECT '{seed}', CAST(0 AS BIGINT) UNION SELECT t, depth + 1 FROM w JOIN s ON h = key WHERE depth < {depth}) SELECT key, min(depth) AS depth FROM w GROUP BY key"


def _walk(name: str, depth: int, downstream: bool, kinds: str) -> None:
    here, there = ("source", "target") if downstream else ("target", "source")
    test = "kind <> 'INDIRECT_FILTER'" if kinds == "value" else "true"

    def run(spark, sf):
        seeds = spark.createDataFrame([("SYN.T7.C1",)], "key string")
        return graph.walk(column_graph(spark, sf), seeds, depth, C.parse_kinds(kinds), downstream)

    query(_walk_sql(A, test, "SYN.T7.C1", depth, here, there), name)(run)


_walk("upstream_d1", 1, False, "value")
_walk("upstream_d2", 2, False, "all")
_walk("downstream_d3", 3, True, "value")


@query(f"WITH RECURSIVE {A}, s AS (SELECT DISTINCT target AS h, source AS t FROM (SELECT source, CASE WHEN kind = 'INDIRECT_FILTER' THEN regexp_replace(target, '[.][^.]*$', '.*') ELSE target END AS target FROM a)), w(key, depth) AS (SELECT k, CAST(0 AS BIGINT) FROM (VALUES ('SYN.T7.C1'), ('SYN.T7.*')) v(k) UNION SELECT t, depth + 1 FROM w JOIN s ON h = key WHERE depth < 1) SELECT key, min(depth) AS depth FROM w GROUP BY key")
def upstream_filter_star_seed(spark, sf):
    edges = column_graph(spark, sf).withColumn("target", F.when(C.kind(F.col("kind")) == "FILTER", F.concat(C.table_of(F.col("target")), F.lit(".*"))).otherwise(F.col("target")))
    return graph.walk(edges, spark.createDataFrame([("SYN.T7.C1",)], "key string"), 1, C.parse_kinds("value,filter"), table_seed=True)


@query(f"WITH {A}, u AS (SELECT source, target, CASE WHEN ord % 10 = 3 THEN 'DYNAMIC_SQL' ELSE kind END AS kind FROM a) SELECT key, min(depth) AS depth FROM (SELECT 'SYN.T7.C0' AS key, CAST(0 AS BIGINT) AS depth UNION ALL SELECT source, 1 FROM u WHERE target = 'SYN.T7.C0' AND kind IN ('DYNAMIC_SQL') UNION ALL SELECT 'SYN.T7.C0', 0) GROUP BY key")
def unresolved_at_seed(spark, sf):
    edges = column_graph(spark, sf).withColumn("kind", F.when(F.col("ord") % 10 == 3, "DYNAMIC_SQL").otherwise(F.col("kind")))
    return graph.walk(edges, spark.createDataFrame([("SYN.T7.C0",)], "key string"), 1, {"CALL"})


@query(f"WITH RECURSIVE {A}, s AS (SELECT DISTINCT source AS h, target AS t FROM a WHERE kind = 'DIRECT'), w(key) AS (SELECT 'SYN.T7.C1' UNION SELECT t FROM w JOIN s ON h = key) SELECT key FROM w")
def reachable_set(spark, sf):
    return graph.reachable(column_graph(spark, sf), spark.createDataFrame([("SYN.T7.C1",)], "key string"), {"DIRECT"})


@query(f"WITH {A}, s AS (SELECT DISTINCT source, target, kind FROM a WHERE target = 'SYN.T7.C1') SELECT a.source, a.target, a.kind, min(a.ord) AS ord FROM a JOIN s USING (source, target, kind) GROUP BY ALL")
def walk_assertions(spark, sf):
    edges, kinds = column_graph(spark, sf), C.parse_kinds("all")
    found = graph.walk(edges, spark.createDataFrame([("SYN.T7.C1",)], "key string"), 1, kinds)
    return graph.walked_edges(edges, found, 1, kinds)


@query(f"WITH RECURSIVE {K}, r AS (SELECT DISTINCT split_part(source, '.', 1) AS h, split_part(target, '.', 1) AS t FROM k), w(key, depth) AS (SELECT 'REGION', CAST(0 AS BIGINT) UNION SELECT t, depth + 1 FROM w JOIN r ON h = key WHERE depth < 3) SELECT key, min(depth) AS depth FROM w GROUP BY key")
def dataset_bfs(spark, sf):
    rolled = graph.datasets(key_graph(spark, sf))
    return graph.walk(rolled, spark.createDataFrame([("REGION",)], "key string"), 3, C.parse_kinds("value"), downstream=True)


# -- paths -----------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {K}, w(key, hops, path) AS (SELECT 'REGION.1', CAST(0 AS BIGINT), 'REGION.1' UNION ALL SELECT target, hops + 1, path || ' > ' || target FROM w JOIN k ON source = key WHERE hops < 3) SELECT key, min(hops) AS hops, min(path) AS path FROM w GROUP BY key")
def shortest_path_len(spark, sf):
    return graph.shortest_paths(key_graph(spark, sf), "REGION.1", 3, C.parse_kinds("value"))


@query(f"WITH {K} SELECT count(*) AS n FROM (SELECT 1 WHERE EXISTS (SELECT 1 FROM k WHERE source LIKE 'ORDERS.%'))")
def no_path(spark, sf):
    found = graph.shortest_paths(key_graph(spark, sf), "ORDERS.1", 2, C.parse_kinds("value"))
    return found.where("hops > 0").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {K}, w(head, tail, hops, path) AS (SELECT source, target, CAST(1 AS BIGINT), source || '>' || target FROM k WHERE source = 'REGION.2' UNION ALL SELECT head, target, hops + 1, path || '>' || target FROM w JOIN k ON source = tail WHERE hops < 3) SELECT * FROM w")
def all_simple_paths_bounded(spark, sf):
    return graph.simple_paths(key_graph(spark, sf), F.col("source") == "REGION.2", 3)


@query(f"WITH {K}, a AS (SELECT DISTINCT source, target FROM k) SELECT x.source AS deep, x.target AS mid, y.target AS tgt FROM a x JOIN a y ON x.target = y.source WHERE x.source <> y.target")
def two_hop_chains(spark, sf):
    return score.two_hops(key_graph(spark, sf))


@query(f"WITH RECURSIVE {K}, w(tail, hops) AS (SELECT target, CAST(1 AS BIGINT) FROM k UNION SELECT target, hops + 1 FROM w JOIN k ON source = tail) SELECT tail, max(hops) AS hops FROM w GROUP BY tail")
def longest_chain_hops(spark, sf):
    return graph.longest_chains(key_graph(spark, sf), 4)


@query("SELECT 'REGION.' || n_regionkey AS head, 'ORDERS.' || o_orderkey AS tail, CAST(3 AS BIGINT) AS hops FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def cross_layer_chains(spark, sf):
    return graph.simple_paths(key_graph(spark, sf), F.startswith("source", F.lit("REGION.")), 3, F.startswith("tail", F.lit("ORDERS."))).select("head", "tail", "hops")


# -- rollups ----------------------------------------------------------------------------------------------------------


@query(f"WITH {A} SELECT {NORM} AS kind, count(*) AS n, count(DISTINCT source || '>' || target) AS n_pairs FROM a GROUP BY 1")
def stats_kinds(spark, sf):
    return column_graph(spark, sf).groupBy(C.kind(F.col("kind")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("source", "target").alias("n_pairs"))


@query(f"WITH {D} SELECT code, count(*) AS n FROM d GROUP BY code")
def stats_diag_codes(spark, sf):
    return diagnostics(spark, sf).groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH {A}, {NODES} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT source, target, kind FROM a)) AS n_assertions")
def stats_totals(spark, sf):
    edges = column_graph(spark, sf)
    n = graph.nodes(edges).agg(F.count("*").alias("n_nodes"))
    return n.select("n_nodes", edges.select("source", "target", "kind").distinct().agg(F.count("*").alias("x")).scalar().alias("n_assertions"))


T = "regexp_replace({0}, '[.][^.]*$', '')"
@query(f"WITH {A}, b AS (SELECT {T.format('source')} AS s, {T.format('target')} AS t, source, target FROM a), c AS (SELECT dataset, count(DISTINCT node) AS n_columns FROM (SELECT s AS dataset, source AS node FROM b UNION ALL SELECT t, target FROM b) GROUP BY 1) SELECT dataset, n_columns, (SELECT count(*) FROM b WHERE t = dataset AND s <> t) AS n_in, (SELECT count(*) FROM b WHERE s = dataset AND s <> t) AS n_out FROM c")
def dataset_aggregate(spark, sf):
    return graph.dataset_summary(column_graph(spark, sf))


@query(f"WITH {A} SELECT {T.format('source')} AS source, {T.format('target')} AS target, count(*) AS n, min(ord) AS ord, min({NORM}) AS kind FROM a WHERE {T.format('source')} <> {T.format('target')} GROUP BY 1, 2")
def parallel_edge_groups(spark, sf):
    return graph.datasets(column_graph(spark, sf))


@query(f"WITH {A}, r AS (SELECT file, row_number() OVER (ORDER BY ord) AS k FROM a WHERE target = 'SYN.T7.C1') SELECT file, count(*) AS n FROM r WHERE k > 20 GROUP BY file")
def explain_overflow_by_file(spark, sf):
    mine = column_graph(spark, sf).where("target = 'SYN.T7.C1'")
    shown = mine.orderBy("ord").limit(20).select("ord")
    return mine.join(shown, "ord", "left_anti").groupBy("file").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, o_totalprice AS cost FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24")
def top_slow_statements(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(24).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("cost"))


@query(f"WITH {D} SELECT file, line, code, row_number() OVER (ORDER BY p, file, line, code) AS place FROM (SELECT DISTINCT file, line, code, CASE WHEN code LIKE 'DYNAMIC%' OR code = 'UNRESOLVED' THEN 0 WHEN code = 'PARSE_FAILED' THEN 1 ELSE 2 END AS p FROM d) ORDER BY place LIMIT 50")
def diagnose_order(spark, sf):
    p = F.when(F.startswith("code", F.lit("DYNAMIC")) | (F.col("code") == "UNRESOLVED"), 0).when(F.col("code") == "PARSE_FAILED", 1).otherwise(2)
    top = diagnostics(spark, sf).select("file", "line", "code", p.alias("p")).distinct().orderBy("p", "file", "line", "code").limit(50)
    return top.select("file", "line", "code", F.row_number().over(Window.orderBy("p", "file", "line", "code")).cast("long").alias("place"))


@query(f"WITH {A}, {D}, w AS (SELECT DISTINCT file FROM a WHERE target = 'SYN.T7.C1' AND kind = 'DIRECT') SELECT DISTINCT file, line, code FROM d WHERE file IN (SELECT file FROM w)")
def diagnostics_of_walk(spark, sf):
    files = column_graph(spark, sf).where("target = 'SYN.T7.C1' and kind = 'DIRECT'").select("file").distinct()
    return diagnostics(spark, sf).join(files, "file", "left_semi").select("file", "line", "code").dropDuplicates()


@query(f"WITH {D} SELECT file, line, code, running FROM (SELECT file, line, code, CAST(sum(length(message) + 1) OVER (PARTITION BY file ORDER BY line, code, message ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT DISTINCT file, line, code, message FROM d)) WHERE running <= 600")
def budget_cut(spark, sf):
    lines = diagnostics(spark, sf).select("file", "line", "code", "message").distinct()
    run = F.sum(F.length("message") + 1).over(Window.partitionBy("file").orderBy("line", "code", "message").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("running", run.cast("long")).where("running <= 600").select("file", "line", "code", "running")


@query(f"WITH {A} SELECT source, target, kind, at_seed FROM (SELECT source, target, kind, min(ord) AS ord, CAST(target = 'SYN.T7.C1' OR source = 'SYN.T7.C1' AS INT) AS at_seed FROM a GROUP BY source, target, kind) ORDER BY at_seed DESC, ord LIMIT 500")
def focus_edges(spark, sf):
    edges = column_graph(spark, sf).groupBy("source", "target", "kind").agg(F.min("ord").alias("ord"))
    at = ((F.col("source") == "SYN.T7.C1") | (F.col("target") == "SYN.T7.C1")).cast("int")
    return edges.withColumn("at_seed", at).orderBy(F.desc("at_seed"), "ord").limit(500).drop("ord")


# -- relations --------------------------------------------------------------------------------------------------------


def _relations(spark, sf):
    return column_graph(spark, sf).select(C.table_of(F.col("source")).alias("source"), C.table_of(F.col("target")).alias("target"), F.when(F.col("kind") == "DIRECT", "INSERT").when(F.col("kind") == "TRANSFORM", "MERGE").otherwise("DELETE").alias("operation"), "file", "line", "ord", "kind")


R = A + f", r AS (SELECT {T.format('source')} AS source, {T.format('target')} AS target, CASE kind WHEN 'DIRECT' THEN 'INSERT' WHEN 'TRANSFORM' THEN 'MERGE' ELSE 'DELETE' END AS operation, file, line FROM a)"


@query(f"WITH {R} SELECT DISTINCT source, target, operation, file, line FROM r")
def table_relations_distinct(spark, sf):
    return _relations(spark, sf).select("source", "target", "operation", "file", "line").distinct()


@query(f"WITH RECURSIVE {R}, s AS (SELECT DISTINCT source AS t, target AS h FROM r), w(key, depth) AS (SELECT 'SYN.T7', CAST(0 AS BIGINT) UNION SELECT t, depth + 1 FROM w JOIN s ON h = key WHERE depth < 2) SELECT key, min(depth) AS depth FROM w GROUP BY key")
def table_relation_walk(spark, sf):
    return graph.walk(_relations(spark, sf), spark.createDataFrame([("SYN.T7",)], "key string"), 2, C.parse_kinds("all"))


@query(f"WITH {R} SELECT operation, count(*) AS n, count(DISTINCT source || target) AS n_pairs FROM r GROUP BY operation")
def relations_by_operation(spark, sf):
    return _relations(spark, sf).groupBy("operation").agg(F.count("*").alias("n"), F.countDistinct("source", "target").alias("n_pairs"))


@query(f"WITH {R} SELECT DISTINCT source AS name FROM r WHERE contains(source, 'T1') ORDER BY 1 LIMIT 8")
def table_suggestions(spark, sf):
    return _relations(spark, sf).select(F.col("source").alias("name")).distinct().where(F.contains("name", F.lit("T1"))).orderBy("name").limit(8)


# -- scoring ----------------------------------------------------------------------------------------------------------

PRF = "tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (SELECT {by} count(*) FILTER (t = 1 AND e = 1) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (e IS NULL) AS fn FROM ({both}) GROUP BY ALL))"
BOTH = "SELECT * FROM (SELECT DISTINCT {k}, 1 AS t FROM a) FULL JOIN (SELECT DISTINCT {k}, 1 AS e FROM e) USING ({k})"


@query(f"WITH {E} SELECT {PRF.format(by='', both=BOTH.format(k='source, target'))}")
def score_prf(spark, sf):
    return score.rates(score.compared(score.pairs(column_graph(spark, sf)), score.pairs(engine_graph(spark, sf)), ["src", "tgt"]))


@query(f"WITH {E}, x AS (SELECT source, target, list(DISTINCT kind) AS k, list(DISTINCT CASE WHEN kind = 'INDIRECT_FILTER' THEN 'FILTER' ELSE 'VALUE' END) AS c FROM a GROUP BY 1, 2), y AS (SELECT source, target, list(DISTINCT kind) AS k, list(DISTINCT CASE WHEN kind = 'INDIRECT_FILTER' THEN 'FILTER' ELSE 'VALUE' END) AS c FROM e GROUP BY 1, 2) SELECT count(*) AS n, round(count(*) FILTER (list_has_any(x.k, y.k)) / count(*), 4) AS exact, round(count(*) FILTER (list_has_any(x.c, y.c)) / count(*), 4) AS coarse FROM x JOIN y USING (source, target)")
def score_kind_accuracy(spark, sf):
    return score.kind_accuracy(column_graph(spark, sf), engine_graph(spark, sf))


@query(f"WITH {E}, b AS (SELECT CAST(CASE WHEN f < 15 THEN f % 4 ELSE -1 END AS BIGINT) AS tier, t, e FROM (SELECT CAST(regexp_extract(file, '[0-9]+') AS INT) AS f, t, e FROM ({BOTH.format(k='file, source, target')}))) SELECT tier, {PRF.format(by='tier,', both='SELECT * FROM b')}")
def score_tier(spark, sf):
    manifest = spark.range(15).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".sql")).alias("file"), (F.col("id") % 4).alias("tier"))
    return score.tiers(column_graph(spark, sf), engine_graph(spark, sf), manifest)


@query(f"WITH {E}, p AS (SELECT DISTINCT source, target FROM a), q AS (SELECT DISTINCT source, target FROM e), c AS (SELECT x.source AS d, x.target AS m, y.target AS t FROM p x JOIN p y ON x.target = y.source WHERE x.source <> y.target) SELECT count(*) AS total, count(*) FILTER (u.source IS NOT NULL AND v.source IS NOT NULL) AS completed, round(count(*) FILTER (u.source IS NOT NULL AND v.source IS NOT NULL) / count(*), 4) AS rate FROM c LEFT JOIN q u ON u.source = d AND u.target = m LEFT JOIN q v ON v.source = m AND v.target = t")
def score_multihop(spark, sf):
    return score.multi_hop(column_graph(spark, sf), engine_graph(spark, sf))


@query(f"WITH {E} SELECT {PRF.format(by='', both=BOTH.format(k='source, target, file, line'))}")
def score_table_grain(spark, sf):
    keys = ["source", "target", "file", "line"]
    return score.rates(score.compared(column_graph(spark, sf), engine_graph(spark, sf), keys))


@query(f"WITH {A}, {D}, f AS (SELECT DISTINCT file FROM a), b AS (SELECT DISTINCT file FROM d WHERE code = 'PARSE_FAILED') SELECT count(*) AS files, count(b.file) AS failed, round((count(*) - count(b.file)) / count(*), 4) AS rate FROM f LEFT JOIN b USING (file)")
def score_parse_rate(spark, sf):
    return score.parse_rate(column_graph(spark, sf), diagnostics(spark, sf))


@query(f"WITH {A}, {D}, p AS (SELECT DISTINCT file, line FROM d WHERE code = 'DYNAMIC_SQL_PARTIAL'), l AS (SELECT DISTINCT file, line FROM a WHERE kind = 'TRANSFORM') SELECT bucket, count(*) AS n FROM (SELECT DISTINCT 'unresolved' AS bucket, file, line FROM d WHERE code = 'DYNAMIC_SQL' UNION ALL SELECT 'partial', file, line FROM p UNION ALL SELECT 'full', file, line FROM l ANTI JOIN p USING (file, line)) GROUP BY bucket")
def dynamic_sql_bucket(spark, sf):
    relations = column_graph(spark, sf).withColumn("method", F.when(F.col("kind") == "TRANSFORM", "dynamic-literal").otherwise("static"))
    return score.dynamic_buckets(diagnostics(spark, sf), relations)


@query(f"WITH {E} SELECT DISTINCT source, target FROM e WHERE (source, target) NOT IN (SELECT source, target FROM a)")
def score_fp_list(spark, sf):
    return score.missing(engine_graph(spark, sf), column_graph(spark, sf))


@query(f"WITH {E} SELECT source, target FROM a EXCEPT SELECT source, target FROM e")
def score_fn_list(spark, sf):
    return score.missing(column_graph(spark, sf), engine_graph(spark, sf))


@query(f"WITH {E} SELECT source, target, kind FROM a INTERSECT SELECT source, target, kind FROM e")
def score_common(spark, sf):
    return column_graph(spark, sf).select("source", "target", "kind").intersect(engine_graph(spark, sf).select("source", "target", "kind"))


@query("SELECT 'events' AS only_in, event_type AS kind FROM events GROUP BY event_type HAVING event_type NOT IN (SELECT DISTINCT o_orderpriority FROM orders) UNION ALL SELECT 'orders', o_orderpriority FROM orders GROUP BY o_orderpriority")
def kind_coverage(spark, sf):
    a, b = table(spark, sf, "events").select(F.col("event_type").alias("kind")).distinct(), table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind")).distinct()
    return a.subtract(b).select(F.lit("events").alias("only_in"), "kind").unionByName(b.subtract(a).select(F.lit("orders").alias("only_in"), "kind"))


# -- store ---------------------------------------------------------------------------------------------------------------

REFS = "SELECT DISTINCT name, 'SYN' AS schema_name, split_part(name, '.', 2) AS table_name, split_part(name, '.', 3) AS column_name FROM (SELECT source AS name FROM a UNION ALL SELECT target FROM a)"


@query(f"WITH {A} SELECT md5(schema_name || '|' || table_name || '|' || column_name) AS id, schema_name, table_name, column_name FROM ({REFS})")
def column_ref_ids(spark, sf):
    return store.column_refs(column_graph(spark, sf)).drop("name", "dblink")


@query(f"WITH {A} SELECT DISTINCT md5(target || '|' || sources || '|' || kind) AS id, target, sources, kind FROM (SELECT target, kind, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM a GROUP BY file, line, target, kind)")
def assertion_md5(spark, sf):
    return store.assertions(column_graph(spark, sf))


@query(f"WITH {A} SELECT DISTINCT md5('r1|' || file || '|' || file || ':' || line) AS id, 'r1' AS revision, file AS path, file || ':' || line AS body FROM a")
def evidence_md5(spark, sf):
    return store.evidence(column_graph(spark, sf), "r1")


@query(f"WITH {A} SELECT DISTINCT source AS from_name, target AS to_name, kind FROM a")
def edge_view(spark, sf):
    return store.edge_view(column_graph(spark, sf))


@query("SELECT DISTINCT '.T' || (l_suppkey % 5) || '.C' AS from_name, '.U.C' AS to_name, 'DIRECT' AS kind FROM lineitem")
def edge_view_no_schema(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("T"), (F.col("l_suppkey") % 5).cast("string"), F.lit(".C")).alias("source"), F.lit("U.C").alias("target"), F.lit("DIRECT").alias("kind"))
    return store.edge_view(edges)


@query(f"WITH {A} SELECT DISTINCT source AS from_name, kind FROM a WHERE target = 'SYN.T7.C1'")
def sources_for(spark, sf):
    return store.sources_for(store.edge_view(column_graph(spark, sf)), "SYN.T7.C1")


@query("SELECT 0 AS added")
def idempotent_reload(spark, sf):
    refs = store.column_refs(column_graph(spark, sf))
    return store.new_rows(refs, refs).agg(F.count("*").cast("int").alias("added"))


@query("SELECT c.c_custkey AS id, o.o_orderkey AS version FROM customer c JOIN (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS valid_to FROM orders) o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey <= 3000 AND (valid_to IS NULL OR valid_to > 3000)")
def scd2_valid_at(spark, sf):
    history = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"))
    valid = store.validity(history, ["id"], "version").where("version <= 3000 and (valid_to is null or valid_to > 3000)").select("id", "version")
    return valid.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id", "left_semi")


# -- export --------------------------------------------------------------------------------------------------------------


@query(f"WITH {A}, c AS (SELECT source AS name FROM a UNION SELECT target FROM a) SELECT lower(name) AS id, 'column' AS type, lower({T.format('name')}) AS parent FROM c UNION SELECT lower({T.format('name')}), 'table', 'syn' FROM c UNION SELECT 'syn', 'schema', NULL")
def viewer_objects(spark, sf):
    edges = column_graph(spark, sf)
    names = edges.select(F.col("source").alias("name")).unionByName(edges.select(F.col("target").alias("name"))).distinct()
    t = C.table_of(F.col("name"))
    column = names.select(C.object_id(F.col("name")).alias("id"), F.lit("column").alias("type"), C.object_id(t).alias("parent"))
    tables = names.select(C.object_id(t).alias("id"), F.lit("table").alias("type"), C.object_id(C.schema_of(t)).alias("parent"))
    schemas = names.select(C.object_id(C.schema_of(t)).alias("id"), F.lit("schema").alias("type"), F.lit(None).cast("string").alias("parent"))
    return column.unionByName(tables).unionByName(schemas).dropDuplicates(["id", "type"])


@query(f"WITH {A} SELECT CASE WHEN kind = 'INDIRECT_FILTER' THEN 'filters' ELSE 'flows' END AS type, lower(source) AS source, lower(target) AS target, count(*) AS n FROM a GROUP BY ALL")
def viewer_relationships(spark, sf):
    return column_graph(spark, sf).groupBy(C.viewer_type(F.col("kind")).alias("type"), C.object_id(F.col("source")).alias("source"), C.object_id(F.col("target")).alias("target")).agg(F.count("*").alias("n"))


@query(f"WITH {A} SELECT CASE WHEN kind = 'INDIRECT_FILTER' THEN 'filters' ELSE 'flows' END AS type, count(*) AS n FROM a GROUP BY 1")
def viewer_rel_types(spark, sf):
    return column_graph(spark, sf).groupBy(C.viewer_type(F.col("kind")).alias("type")).agg(F.count("*").alias("n"))


@query(f"WITH {A}, o AS (SELECT DISTINCT {T.format('target')} AS dataset FROM a), p AS (SELECT DISTINCT source AS name FROM a) SELECT name, dataset FROM p JOIN o ON {T.format('name')} = dataset")
def owning_dataset(spark, sf):
    """The dataset whose name is the longest prefix of a node's; names go by dots, so the join is on the part before the last."""
    edges = column_graph(spark, sf)
    owners = edges.select(C.table_of(F.col("target")).alias("dataset")).distinct()
    return edges.select(F.col("source").alias("name")).distinct().join(owners, C.table_of(F.col("name")) == F.col("dataset")).select("name", "dataset")


@query(f"WITH {A}, {NODES}, f AS (SELECT DISTINCT upper(o_orderpriority) AS key FROM orders UNION SELECT 'SYN.T7.C1') SELECT CAST(count(n.key) AS BIGINT) AS matched, CAST(count(*) - count(n.key) AS BIGINT) AS unmatched FROM f LEFT JOIN n USING (key)")
def focus_matching(spark, sf):
    asked = table(spark, sf, "orders").select(F.upper("o_orderpriority").alias("key")).unionByName(spark.createDataFrame([("SYN.T7.C1",)], "key string")).distinct()
    known = graph.nodes(column_graph(spark, sf)).select("key", F.lit(1).alias("known"))
    return asked.join(known, "key", "left").agg(F.count("known").alias("matched"), F.count_if(F.col("known").isNull()).alias("unmatched"))


def _answers(spark, sf):
    """An answer for each file about one column, as text; two more that say what went wrong."""
    edge = F.concat(F.lit("  "), "source", F.lit(" -> "), "target", F.lit(" ["), "kind", F.lit("]"))
    told = column_graph(spark, sf).where("target = 'SYN.T7.C1'").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", edge.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    wrong = spark.createDataFrame([("none", "No match: X"), ("blank", " ")], "file string, text string")
    return told.select("file", F.concat(F.lit("SYN.T7.C1: upstream, depth 1, some edges\n"), "body").alias("text")).unionByName(wrong)


@query(f"WITH {A} SELECT file, 'SYN.T7.C1' AS seed, count(*) AS n_edges, CAST(1 + count(DISTINCT nullif(source, 'SYN.T7.C1')) AS BIGINT) AS n_columns FROM a WHERE target = 'SYN.T7.C1' GROUP BY file")
def focus_parsed(spark, sf):
    """Answers read back: the column asked about, how many edges and names they show."""
    got = focus.focus(_answers(spark, sf), most=1 << 30)
    return got.select("file", "seed", F.size("edges").cast("long").alias("n_edges"), F.size("columns").cast("long").alias("n_columns"))


@query("SELECT o_orderkey AS id, NOT starts_with(o_comment, 'Ambiguous:') AS focusable FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Ambiguous: x' ELSE o_orderpriority END AS o_comment FROM orders)")
def projection_focusable(spark, sf):
    text = F.when(F.col("o_orderstatus") == "F", "Ambiguous: x").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), focus.focusable(text).alias("focusable"))


@query(f"WITH {A} SELECT ord, source, target, (SELECT count(*) FROM a WHERE target = 'SYN.T7.C1') > 200 AS truncated FROM a WHERE target = 'SYN.T7.C1' ORDER BY ord LIMIT 200")
def capped_detail(spark, sf):
    rows = column_graph(spark, sf).where("target = 'SYN.T7.C1'").select("ord", "source", "target")
    return focus.capped(rows, [F.col("ord")], 200)


@query(f"WITH {A}, {D}, w AS (SELECT DISTINCT file FROM a WHERE target = 'SYN.T7.C1' AND kind = 'DIRECT') SELECT DISTINCT file, line, code, message FROM d WHERE file IN (SELECT file FROM w)")
def table_diagnostics(spark, sf):
    return text.diagnostics_beside(diagnostics(spark, sf), column_graph(spark, sf).where("target = 'SYN.T7.C1' and kind = 'DIRECT'"))


@query(f"WITH {D} SELECT DISTINCT file, line, code, message FROM d WHERE code IN ('DYNAMIC_SQL', 'DYNAMIC_SQL_PARTIAL', 'PARSE_FAILED')")
def table_diagnostics_without_walk(spark, sf):
    return text.diagnostics_beside(diagnostics(spark, sf), column_graph(spark, sf).limit(0))


@query(f"WITH RECURSIVE {K}, w(head, tail, hops, path) AS (SELECT source, target, CAST(1 AS BIGINT), source || '>' || target FROM k UNION ALL SELECT head, target, hops + 1, path || '>' || target FROM w JOIN k ON source = tail WHERE hops < 3) SELECT head, tail, hops, max(path) AS path FROM w GROUP BY head, tail, hops ORDER BY hops DESC, path DESC LIMIT 8")
def top_chains(spark, sf):
    return graph.top_chains(key_graph(spark, sf), 3, 8)


@query(f"WITH {A}, r AS (SELECT DISTINCT regexp_replace(source, '\\.[^.]*$', '') AS s, regexp_replace(target, '\\.[^.]*$', '') AS t FROM a) SELECT DISTINCT s AS dataset, 'up' AS side FROM r WHERE t = 'SYN.T7' AND s <> t UNION SELECT t, 'down' FROM r WHERE s = 'SYN.T7' AND s <> t")
def direct_datasets(spark, sf):
    return graph.direct_datasets(column_graph(spark, sf), "syn.t7")


@query("SELECT item_id AS id, 'sha256:' || sha256(text) AS digest FROM benchmark WHERE text IS NOT NULL")
def file_digests(spark, sf):
    return table(spark, sf, "benchmark").where("text is not null").select(F.col("item_id").alias("id"), C.digest(F.col("text")).alias("digest"))


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def event_stamps(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), C.utc_stamp(F.col("ts")).alias("at"))


@query("SELECT s_suppkey AS id, 'a.K = b.N' || s_nationkey AS predicate FROM supplier")
def bare_clauses(spark, sf):
    labels = F.element_at(F.array(*(F.lit(x) for x in ("WHERE ", "JOIN ", "MERGE ON ", ""))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), C.bare_clause(F.concat(labels, F.lit("a.K = b.N"), F.col("s_nationkey").cast("string"), F.lit("(+)"))).alias("predicate"))


@query("SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def json_round_trip(spark, sf):
    packed = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))).alias("j"))
    return packed.select("id", F.from_json("j", "name string, region long").alias("r")).select("id", "r.name", "r.region")


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'VALUE' WHEN 'N' THEN 'FILTER' END AS kind, 'S' || l_suppkey || '.C' || l_linenumber AS source, 'T' || l_partkey || CASE WHEN l_linestatus = 'O' THEN '.*' ELSE '.X' END AS target FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL")
def flow_format_pairs(spark, sf):
    """Another engine's ids and relationship types."""
    kind = F.when(F.col("l_returnflag") == "A", "direct").when(F.col("l_returnflag") == "N", "indirect").otherwise("other")
    to = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("table.t"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("column.t"), F.col("l_partkey").cast("string"), F.lit(".x")))
    rows = table(spark, sf, "lineitem").select(kind.alias("type"), F.concat(F.lit("column.s"), F.col("l_suppkey").cast("string"), F.lit(".c"), F.col("l_linenumber").cast("string")).alias("source"), to.alias("target"))
    return score.flow_pairs(rows)


@query("SELECT 'IF' || n_regionkey AS interface, 'A' || n_nationkey AS adapter, 'C' || l AS \"column\" FROM nation, (VALUES (0), (1), (2)) v(l) WHERE l > n_nationkey % 3")
def adapter_columns(spark, sf):
    """Write edges to columns 0 to 2 against adapters that write the first one, two or three of them."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("IF"), F.col("n_regionkey").cast("string")).alias("interface"), F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("adapter"), (F.col("n_nationkey") % 3).cast("int").alias("k"))
    three = F.array(F.lit("C0"), F.lit("C1"), F.lit("C2"))
    return corpus.columns_beside_blobs(n.select("interface", "adapter", F.explode(three).alias("column")), n.select("interface", "adapter", F.slice(three, F.lit(1), F.col("k") + 1).alias("update_columns")))


# -- statements, sources and pipelines read from text -------------------------------------------------------------------


def _filled(text: str):
    return F.replace(F.replace(F.lit(text), F.lit("{n}"), F.col("n_nationkey").cast("string")), F.lit("{r}"), F.col("n_regionkey").cast("string"))


def _stated(rows: list[tuple], names: list[str]) -> str:
    fill = lambda x: "NULL" if x == "" else f"CAST({x} AS BIGINT)" if isinstance(x, int) else "replace(replace('" + x + "', '{n}', CAST(n_nationkey AS VARCHAR)), '{r}', CAST(n_regionkey AS VARCHAR))"
    return " UNION ".join(f"SELECT CAST(n_nationkey AS VARCHAR) AS id, {', '.join(f'{fill(x)} AS {n}' for x, n in zip(r, names, strict=True))} FROM nation" for r in rows)


CATALOG = {"SYN.ORIGIN": ["ID", "NAME"], "SYN.MIRROR": ["ID", "NAME"]}


def _statements(spark, sf, text: str) -> DataFrame:
    return table(spark, sf, "nation").repartition(4).select(F.col("n_nationkey").cast("string").alias("id"), _filled(text).alias("sql"))


def _flow(spark, sf, declared: str, body: str) -> DataFrame:
    files = table(spark, sf, "nation").repartition(4).select(F.col("n_nationkey").cast("string").alias("path"), F.concat(F.lit("PACKAGE BODY PKG IS PROCEDURE LOAD IS "), _filled(declared), F.lit(" BEGIN "), _filled(body), F.lit(" END LOAD; END PKG;")).alias("text"))
    return analyze_sources(files, CATALOG)


def _read() -> None:
    edges = lambda rows: edge_pairs(rows).select(F.col("file").alias("id"), "target", "source", "kind").distinct()
    for name, (text, rows) in templates.STATEMENTS.items():
        query(_stated(rows, ["target", "source", "kind"]), name)(lambda spark, sf, t=text: edges(analyze_statements(_statements(spark, sf, t), CATALOG)))
    for name, (declared, body, rows) in templates.FLOWS.items():
        query(_stated(rows, ["target", "source", "kind"]), name)(lambda spark, sf, d=declared, b=body: edges(_flow(spark, sf, d, b)))
    for name, (body, code) in templates.DIAGNOSED.items():
        query(_stated([(code,)], ["code"]), name)(lambda spark, sf, b=body: _flow(spark, sf, "", b).where("what = 'diagnostic'").select(F.col("file").alias("id"), "code").distinct())
    for name, (body, rows) in templates.RELATED.items():
        query(_stated(rows, ["source", "target", "operation"]), name)(lambda spark, sf, b=body: _flow(spark, sf, "", b).where("what = 'relation'").select(F.col("file").alias("id"), F.col("sources")[0]["table"].alias("source"), "target", F.col("kind").alias("operation")).distinct())
    for name, (steps, rows) in templates.PIPELINES.items():

        def run(spark, sf, t=steps):
            asked = table(spark, sf, "nation").repartition(4).select(F.col("n_nationkey").cast("string").alias("interface"), _filled(t).alias("steps"))
            return evaluate(asked).select(F.col("interface").alias("id"), "target", "source", "kind", "hops").distinct()

        def from_files(spark, sf, t=steps):
            """The same from the interface's files: written, read back, followed."""
            asked = table(spark, sf, "nation").repartition(4).select(F.col("n_nationkey").cast("string").alias("interface"), _filled(t).alias("steps"))
            return evaluate(interfaces_of(artefacts(asked))).select(F.col("interface").alias("id"), "target", "source", "kind", "hops").distinct()

        query(_stated(rows, ["target", "source", "kind", "hops"]), name)(run)
        query(_stated(rows, ["target", "source", "kind", "hops"]), f"artefact_{name}")(from_files)


_read()


@query(_stated([("SYN.T{n}.A", "SYN.A{r}.X", "DIRECT"), ("SYN.T{n}.A", "SYN.B{r}.Y", "DIRECT")], ["target", "source", "kind"]))
def set_operation_edges(spark, sf):
    found = analyze_statements(_statements(spark, sf, "INSERT INTO SYN.T{n} (A) SELECT X FROM SYN.A{r} UNION ALL SELECT Y FROM SYN.B{r}"), set_ops=True)
    return edge_pairs(found).select(F.col("file").alias("id"), "target", "source", "kind").distinct()


@query(_stated([("SYN.T{n}.B", "SYN.S{r}.Q", "AGGREGATE"), ("SYN.T{n}.*", "SYN.S{r}.H", "INDIRECT_FILTER")], ["target", "source", "kind"]))
def having_filters(spark, sf):
    found = analyze_statements(_statements(spark, sf, "INSERT INTO SYN.T{n} (B) SELECT SUM(s.Q) FROM SYN.S{r} s HAVING MAX(s.H) > 1"), having=True)
    return edge_pairs(found).select(F.col("file").alias("id"), "target", "source", "kind").distinct()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file, CAST(1 AS BIGINT) AS hops_direct, CAST(2 AS BIGINT) AS hops_select, CAST(4 AS BIGINT) AS hops_chain FROM nation")
def hops_counted(spark, sf):
    rows = _flow(spark, sf, "v_a NUMBER; v_b NUMBER; v_c NUMBER;", "SELECT a.X INTO v_a FROM SYN.A{r} a; v_b := v_a; v_c := v_b; INSERT INTO SYN.T{n} (C, S) VALUES (v_c, v_a); INSERT INTO SYN.T{n} (D) SELECT z.D FROM SYN.Z{r} z;")
    return rows.where("what = 'edge'").groupBy("file").agg(F.min("hops").alias("hops_direct"), F.max(F.when(F.col("column") == "S", F.col("hops"))).alias("hops_select"), F.max("hops").alias("hops_chain"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file, CAST(line AS BIGINT) AS line, kind FROM nation, (VALUES (4, 'dml'), (6, 'assignment'), (7, 'dynamic_sql')) v(line, kind)")
def statement_structure(spark, sf):
    text = "PACKAGE BODY PKG IS\n PROCEDURE P IS\n BEGIN\n  DELETE FROM SYN.T{n};\n  -- none; here\n  v_a := q'[;]' || 'x;';\n  EXECUTE IMMEDIATE v_a;\n END;\nEND;"
    files = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("path"), _filled(text).alias("text"))
    return analyze_sources(files).where("what = 'statement'").select("file", "line", "kind")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file, 'PARSE_FAILED' AS code FROM nation WHERE n_regionkey = 1")
def parse_failures(spark, sf):
    end = F.when(F.col("n_regionkey") == 1, "").otherwise("END; END;")
    files = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.concat(F.lit("PACKAGE BODY P IS PROCEDURE Q IS BEGIN NULL; "), end).alias("text"))
    return analyze_sources(files).where("what = 'diagnostic'").select("file", "code")


def statement_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: statements rendered from rows, their edges, and what lies two hops downstream of a region's source."""
    text = "INSERT INTO SYN.T{n} (A, B) SELECT s.X, SUM(s.Y) FROM SYN.S{r} s GROUP BY s.X"
    edges = edge_pairs(analyze_statements(_statements(spark, sf, text)))
    return graph.walk(edges, spark.createDataFrame([("SYN.S1.X",), ("SYN.S1.Y",)], "key string"), 2, C.parse_kinds("value"), downstream=True)


query("SELECT 'SYN.S1.' || c AS key, CAST(0 AS BIGINT) AS depth FROM (VALUES ('X'), ('Y')) v(c) UNION ALL SELECT 'SYN.T' || n_nationkey || '.' || c, 1 FROM nation, (VALUES ('A'), ('B')) v(c) WHERE n_regionkey = 1")(statement_edges)


@query("SELECT CAST(t AS BIGINT) AS tier, 1.0 AS precision, 1.0 AS recall, 1.0 AS f1 FROM range(4) AS r(t)")
def corpus_score(spark, sf):
    """Generated packages, analysed and scored: every tier is whole and nothing is invented."""
    return corpus.scored(corpus.packages(spark, 40)).select("tier", "precision", "recall", "f1")


@query("SELECT name AS check_name, CAST(0 AS BIGINT) AS failed FROM (VALUES ('source column stands in the text'), ('target table stands in the text'), ('BEGIN and END balance')) v(name)")
def corpus_checks(spark, sf):
    return corpus.checks(corpus.packages(spark, 20)).select("check_name", "failed")


@query("SELECT n_nationkey AS id, '{\"table\": \"T' || n_nationkey || '\", \"region\": ' || n_regionkey || ', \"columns\": [\"A\", null]}' AS record FROM nation")
def blob_records(spark, sf):
    """Adapter blobs written with the record codec, and read back."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    made = table(spark, sf, "nation").select(n.alias("id"), F.concat(F.lit('{"table": "T'), n.cast("string"), F.lit('", "region": '), r.cast("string"), F.lit(', "columns": ["A", null]}')).alias("json"))
    return decode_blobs(encode_blobs(made).drop("json")).where("error is null").select("id", "record")


# -- as-of, profiles, twins -----------------------------------------------------------------------------------------------


@query("SELECT event_id AS id, (SELECT max((c.ts, c.event_id)) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND (c.ts, c.event_id) < (e.ts, e.event_id))[2] AS click FROM events e WHERE event_type = 'purchase'")
def asof_last_binding(spark, sf):
    """For each purchase the user's latest click before it: what a name holds when a statement reads it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, sf, "events").withColumn("click", held).where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "click")


@query("SELECT lang, CAST(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) AS BIGINT) AS n_lines, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+'))) AS BIGINT) AS hits, round(1000.0 * sum(len(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+'))) / sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1), 4) AS per_1000 FROM documents GROUP BY lang")
def construct_rates(spark, sf):
    text = F.coalesce("text", F.lit(""))
    out = table(spark, sf, "documents").groupBy("lang").agg(F.sum(C.line_count(text)).cast("long").alias("n_lines"), F.sum(F.regexp_count(text, F.lit("[A-Z][a-z]+"))).cast("long").alias("hits"))
    return out.withColumn("per_1000", F.round(F.lit(1000.0) * F.col("hits") / F.col("n_lines"), 4))


@query("SELECT len(string_split(p_type, ' ')) AS depth, count(*) AS n FROM part GROUP BY 1")
def path_depth_histogram(spark, sf):
    return table(spark, sf, "part").groupBy(F.size(F.split("p_type", " ")).cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS phase, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 4) AS share FROM orders GROUP BY 1")
def phase_shares(spark, sf):
    orders = table(spark, sf, "orders")
    every = orders.agg(F.sum("o_totalprice")).scalar()
    return orders.groupBy(F.col("o_orderpriority").alias("phase")).agg(F.sum("o_totalprice").alias("t")).select("phase", F.round("t", 2).alias("total"), F.round(F.col("t") / every, 4).alias("share"))


@query(f"WITH {D} SELECT code AS check_name, count(*) AS total, count(*) FILTER (line % 3 = 0) AS failed FROM d GROUP BY code")
def validation_report(spark, sf):
    return diagnostics(spark, sf).groupBy(F.col("code").alias("check_name")).agg(F.count("*").alias("total"), F.count_if(F.col("line") % 3 == 0).alias("failed"))


@query("SELECT coalesce(t.id, s.id) AS id, CASE WHEN s.id IS NULL THEN t.v ELSE s.v END AS v FROM (SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'BUILDING') t FULL JOIN (SELECT c_custkey AS id, c_acctbal * 2 AS v FROM customer WHERE c_acctbal > 0) s ON t.id = s.id")
def twin_merge(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), "c_mktsegment")
    t, s = c.where("c_mktsegment <> 'BUILDING'").select("id", "v"), c.where("v > 0").select("id", (F.col("v") * 2).alias("w"))
    return t.join(s, "id", "full").select("id", F.when(F.col("w").isNull(), F.col("v")).otherwise(F.col("w")).alias("v"))


@query("SELECT l_returnflag AS flag, count(*) FILTER (l_linestatus = 'O') AS o_n, count(*) FILTER (l_linestatus = 'F') AS f_n FROM lineitem GROUP BY 1")
def twin_pivot(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).pivot("l_linestatus", ["O", "F"]).agg(F.count("l_orderkey")).na.fill(0).select("flag", F.col("O").alias("o_n"), F.col("F").alias("f_n"))


@query("SELECT p_partkey AS id, 'brand' AS col, p_brand AS val FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part")
def twin_unpivot(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return p.unpivot("id", ["brand", "type"], "col", "val")


@query(f"WITH RECURSIVE {K}, w(name, level) AS (SELECT DISTINCT source, CAST(1 AS BIGINT) FROM k WHERE source LIKE 'REGION.%' UNION ALL SELECT target, level + 1 FROM w JOIN k ON source = name) SELECT level, count(*) AS n FROM w GROUP BY level")
def twin_connect_by(spark, sf):
    return graph.levels(key_graph(spark, sf), F.startswith("source", F.lit("REGION.")))


@query("SELECT n_nationkey AS id, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def twin_outer_join(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal > 5000")
    return table(spark, sf, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("id")).agg(F.count("s_suppkey").alias("n"))


@query("SELECT c_custkey AS id, coalesce((SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 0) AS top FROM customer")
def twin_scalar_subquery(spark, sf):
    top = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("m"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(top, "id", "left").select("id", F.coalesce("m", F.lit(0.0)).alias("top"))


@query("SELECT l_suppkey AS id, rank() OVER (ORDER BY sum(l_quantity) DESC) AS place, sum(l_quantity) AS q FROM lineitem GROUP BY 1")
def twin_window_rank(spark, sf):
    summed = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("q"))
    return summed.select("id", F.rank().over(Window.orderBy(F.desc("q"))).cast("long").alias("place"), "q")


@query("WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT n, count(*) AS customers FROM c GROUP BY n")
def twin_cte_agg(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("customers"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'full' ELSE 'part' END AS said, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS big FROM orders")
def twin_decode_case(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS id", "decode(o_orderstatus, 'O', 'open', 'F', 'full', 'part') AS said", "CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS big")


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def twin_minus(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")))


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def twin_exists(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(table(spark, sf, "orders").where("o_totalprice > 200000"), F.col("id") == F.col("o_custkey"), "left_semi")
