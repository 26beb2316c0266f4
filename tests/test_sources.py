"""Files, engine results, the store, text answers, the stream."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from braidline.functions.columns import fnv1a, parse_kinds
from braidline import corpus
from braidline.functions.udtfs import register
from braidline.operators import focus, graph, score, store
from braidline.operators.analysis import analyze_sources, edge_pairs
from braidline.operators.export import read_viewer, write_viewer
from braidline.operators.pipelines import evaluate
from braidline.sources.artefacts import interfaces_of
from braidline.sources.records import blobs_of
from braidline.queries import QUERIES
from braidline.operators.text import cut_to_budget, diagnose_text, path_text, query_text, recommendations
from braidline.session import LineageSession
from braidline.sources.files import chain_sample, columns_of, catalog_columns, decoded, read_engine, sql_files, write_engine
from braidline.streaming.ingest import ingest, latest

PACKAGE = "PACKAGE BODY P IS PROCEDURE Q IS BEGIN INSERT INTO SYN.T (A) SELECT s.X FROM SYN.S s WHERE s.Y = '한글'; EXECUTE IMMEDIATE v; END; END;"


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "a.sql").write_bytes(PACKAGE.encode("utf-8"))
    (tmp_path / "b.sql").write_bytes(PACKAGE.encode("cp949"))
    (tmp_path / "c.sql").write_bytes(b"\xff\xfe\xfa\x81")
    (tmp_path / "catalog.sql").write_text("CREATE TABLE SYN.S (X NUMBER, Y DATE);")
    return tmp_path


def test_files_to_engine_json_and_back(spark, tree, tmp_path):
    text = decoded(sql_files(spark, f"file://{tree}"))
    assert {(r.path[-5:], r.encoding) for r in text.collect()} == {("a.sql", "utf-8"), ("b.sql", "cp949"), ("c.sql", None)}
    rows = analyze_sources(text).persist()
    assert {r.code for r in rows.where("what = 'diagnostic'").collect()} == {"DYNAMIC_SQL", "DECODE_FAILED"}
    write_engine(rows, str(tmp_path / "engine.json"))
    data = json.loads((tmp_path / "engine.json").read_text())
    assert len(data["edges"]) == 4 and len(data["relations"]) == 2
    back = read_engine(spark, f"file://{tmp_path}/engine.json")
    assert {(r.source, r.target) for r in back["edges"].collect()} == {("SYN.S.X", "SYN.T.A"), ("SYN.S.Y", "SYN.T.*")}
    (tmp_path / "none.json").write_text('{"relations": []}')
    with pytest.raises(ValueError):
        read_engine(spark, f"file://{tmp_path}/none.json")


def test_packages_go_first(spark, tree):
    (tree / "packages").mkdir()
    (tree / "packages" / "d.sql").write_text(PACKAGE)
    assert [r.path[-5:] for r in sql_files(spark, f"file://{tree}").collect()] == ["d.sql"]


def test_catalogue(spark):
    ddl = spark.createDataFrame([("create table A.T (\n X number(3,2), Y date,\n constraint c check (X > 0));\nCREATE TABLE B.T (Z INT);",)], "text string")
    catalog = catalog_columns(ddl)
    assert {(r.table, r.ordinal, r.column) for r in catalog.collect()} == {("A.T", 0, "X"), ("A.T", 1, "Y"), ("B.T", 0, "Z")}
    names = spark.createDataFrame([("a.t@L",), ("T",), ("U",)], "name string")
    assert {r.name for r in columns_of(catalog, names).collect()} == {"a.t@L"}


def test_store_loads_once(spark, tmp_path):
    edges = chain_sample(spark, 50).withColumn("file", F.lit("f")).withColumn("line", F.lit(1))
    refs = store.column_refs(edges)
    assert store.append(refs, f"file://{tmp_path}/refs") == 50 and store.append(refs, f"file://{tmp_path}/refs") == 0


def test_cyclic_and_long_graphs(spark):
    ring = spark.createDataFrame([(k, f"T.{k}", f"T.{(k + 1) % 6}", "DIRECT") for k in range(6)], "ord long, source string, target string, kind string")
    seeds = spark.createDataFrame([("T.0",)], "key string")
    assert graph.reachable(ring, seeds, {"DIRECT"}).count() == 6
    assert {(r.key, r.depth) for r in graph.walk(ring, seeds, 8, {"DIRECT"}, downstream=True).collect()} == {(f"T.{k}", k) for k in range(6)}
    assert {r.hops for r in graph.simple_paths(ring, F.col("source") == "T.0", 12).collect()} == {1, 2, 3, 4, 5}


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], "source string, target string")
    got = score.rates(score.compared(score.pairs(none), score.pairs(none), ["src", "tgt"])).first()
    assert (got.tp, got.precision, got.recall, got.f1) == (0, 0.0, 0.0, 0.0)


def test_text_answers(spark):
    edges = chain_sample(spark, 5).withColumn("source", F.upper("source"))
    said = query_text(edges, "t00003.c", depth=2)
    assert said.splitlines()[0] == "SYN.T00003.C: upstream, depth 2, 2 edges" and len(said.splitlines()) == 3
    assert path_text(edges, "T00000.C", "T00003.C") == "3 hops: SYN.T00000.C > SYN.T00001.C > SYN.T00002.C > SYN.T00003.C"
    assert path_text(edges, "T00003.C", "T00000.C").startswith("No path") and query_text(edges, "T0000").startswith("No match")
    assert query_text(edges, "c").startswith("Ambiguous")
    assert cut_to_budget(["head", "x" * 50, "y"], 10).splitlines() == ["head", "... 2 lines beyond the budget of 10"]
    found = spark.createDataFrame([("f", 1, "PARSE_FAILED", "m"), ("f", 2, "UNRESOLVED", "m")], "file string, line long, code string, message string")
    assert [x.split()[0] for x in diagnose_text(found).splitlines()[1:]] == ["UNRESOLVED", "PARSE_FAILED"]
    assert recommendations({"parse": 0.7}, {"PARSE_FAILED": 1, "DYNAMIC_SQL": 2}, 3)[0].startswith("parse")


def test_kinds_and_hash(spark):
    assert parse_kinds("value,filter") >= {"DIRECT", "FILTER"} and "FILTER" not in parse_kinds("value")
    with pytest.raises(ValueError):
        parse_kinds("nope")
    assert spark.range(1).select(fnv1a(F.lit("a"))).first()[0] == "e40c292c" and spark.range(1).select(fnv1a(F.lit(""))).first()[0] == "811c9dc5"


def test_stream_loads_the_store(spark, tree, tmp_path):
    (tree / "b.sql").unlink()
    (tree / "c.sql").unlink()
    (tree / "catalog.sql").unlink()
    place = f"file://{tmp_path}/store"
    for _ in range(2):
        ingest(spark, f"file://{tree}", place).awaitTermination()
    assert spark.read.parquet(f"{place}/assertion").count() == 2
    assert latest(spark.createDataFrame([(1, "a"), (3, "c"), (2, "b")], "seq long, event string")).first().event == "c"


def test_pairs_of_edges(spark):
    rows = analyze_sources(spark.createDataFrame([("x", PACKAGE)], "path string, text string"))
    assert {(r.source, r.kind, r.hops) for r in edge_pairs(rows).collect()} == {("SYN.S.X", "DIRECT", 1), ("SYN.S.Y", "INDIRECT_FILTER", 1)}


def test_viewer_form_and_back(spark, tmp_path):
    edges = analyze_sources(spark.createDataFrame([("x.sql", PACKAGE)], "path string, text string"))
    pairs = edge_pairs(edges).unionByName(spark.createDataFrame([("x.sql", 9, 9, None, "SYN.U.*", "UNRESOLVED", 1)], "file string, line long, ord long, source string, target string, kind string, hops long"))
    write_viewer(pairs, f"{tmp_path}/v.json")
    data = json.loads((tmp_path / "v.json").read_text())
    assert [o["id"] for o in data["objects"]] == ["syn", "syn.s", "syn.t", "syn.u", "syn.s.x", "syn.s.y", "syn.t.a", "dynamic:x.sql:9"]
    back = read_viewer(spark, f"file://{tmp_path}/v.json")
    assert back["edges"].count() == 1 and back["warnings"].count() == 2  # whole tables aren't objects of their own


def test_session(spark, tree, tmp_path):
    rows = analyze_sources(decoded(sql_files(spark, f"file://{tree}")))
    path = f"{tmp_path}/engine.json"
    write_engine(rows, path)
    session = LineageSession(spark)
    assert "SYN.S.X -> SYN.T.A [DIRECT]" in session.query(f"file://{path}", "t.a")
    assert "SYN.S.* -> SYN.T.*" in session.query(f"file://{path}", "SYN.T", grain="table")
    assert session.path(f"file://{path}", "SYN.S.X", "SYN.T.A").startswith("1 hops")
    assert session.stats(f"file://{path}")["kind DIRECT"] == 2 and "DYNAMIC_SQL" in session.diagnose(f"file://{path}")
    assert session.explain(f"file://{path}", "SYN.T.A").splitlines()[0] == "SYN.T.A: 2 edges shown"
    assert len(session.held) == 1


def test_table_functions(spark):
    register(spark)
    got = spark.sql("SELECT target, source FROM lineage_edges('INSERT INTO T (A) SELECT X FROM S')").collect()
    assert [tuple(r) for r in got] == [("T.A", "S.X")]
    assert spark.createDataFrame([(PACKAGE,)], "t string").createOrReplaceTempView("src") is None
    assert spark.sql("SELECT s.kind FROM src, LATERAL lineage_statements(t) s").count() == 2


def test_generated_interfaces(spark):
    made = corpus.interfaces(spark, 30)
    want = {(r.interface, t.target, t.source, t.kind, t.hops) for r in made.collect() for t in r.truth}
    assert {(r.interface, r.target, r.source, r.kind, r.hops) for r in evaluate(made).collect()} == want
    packages = corpus.packages(spark, 3, 5)
    assert {r.text for r in packages.collect()} == {r.text for r in packages.repartition(2).collect()}
    assert corpus.ceiling(packages).agg(F.sum("reachable")).first()[0] > 0


def test_traverse_stays_within_bounds(spark):
    rng = random.Random(4)
    pairs = [(f"N{rng.randrange(30)}", f"N{rng.randrange(30)}") for _ in range(70)]
    edges = spark.createDataFrame([(k, a, b, "DIRECT") for k, (a, b) in enumerate(pairs)], "ord long, source string, target string, kind string")
    for downstream in (True, False):
        for depth, nodes, most in ((12, 2000, 5000), (1, 2000, 5000), (12, 6, 5000), (12, 2000, 9)):
            found, rows, cut, queue, at = {"N1": 0}, [], False, ["N1"], 0
            while at < len(queue):
                here, at = queue[at], at + 1
                own = [(k, a, b) for k, (a, b) in enumerate(pairs) if (a if downstream else b) == here]
                if own and found[here] >= depth:
                    cut = True
                    continue
                for k, a, b in own:
                    if len(rows) >= most:
                        cut = True
                        break
                    there = b if downstream else a
                    if there not in found:
                        if len(found) >= nodes:
                            cut = True
                            continue
                        found[there] = found[here] + 1
                        queue.append(there)
                    rows.append(k)
            got, kept, truncated = graph.traverse(edges, "n1", downstream, depth, nodes, most)
            assert {r.key: r.depth for r in got.collect()} == found and {r.ord for r in kept.collect()} == set(rows) and truncated == cut
    assert graph.traverse(edges, "unknown")[0].count() == 0


def test_focus_of_answers(spark):
    from braidline.operators import focus

    texts = ["A.B: upstream, depth 1, 2 edges\n  x.Y -> A.B [DIRECT]\n  X.y -> a.b [FILTER]\n... 3 lines beyond the budget of 9", "Ambiguous: Q", "No edges at all", None, ""]
    got = focus.focus(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).orderBy("id").collect()
    assert [(r.id, r.seed, r.columns, len(r.edges), r.truncated) for r in got] == [(0, "A.B", ["A.B", "x.Y"], 2, True), (2, None, [], 0, False)]
    hub = focus.FocusHub()
    assert hub.publish({"seed": "A"}) == 1 and hub.snapshot() == (1, {"seed": "A"}) and hub.wait_after(1, 0.01) is None
    hub.clear()
    assert hub.wait_after(1, 1) == (2, None)


def test_walk_as_a_table_function(spark):
    register(spark)
    spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "C"), (None, "C")], "source string, target string").createOrReplaceTempView("walk_edges")
    got = spark.sql("SELECT key, depth FROM lineage_walk(TABLE(SELECT source, target FROM walk_edges) WITH SINGLE PARTITION, 'c', 2)").collect()
    assert {r.key: r.depth for r in got} == {"C": 0, "B": 1, "D": 1, "A": 2}


def test_catalogue_is_bounded(spark):
    from braidline.operators.analysis import catalog_map

    catalog = spark.createDataFrame([("SYN.A", 0, "X"), ("SYN.B", 0, "Y"), ("SYN.B", 1, "Z")], "table string, ordinal long, column string")
    files = spark.createDataFrame([("f", "insert into b select 1")], "path string, text string")
    assert catalog_map(catalog) == {"SYN.A": ["X"], "SYN.B": ["Y", "Z"]} and catalog_map(catalog, files, 2) == {"SYN.B": ["Y", "Z"]}
    with pytest.raises(ValueError):
        catalog_map(catalog, files, 1)


def test_truths_come_together(spark):
    got = corpus.every_truth(corpus.packages(spark, 2), corpus.interfaces(spark, 2))
    assert {r.origin for r in got.select("origin").distinct().collect()} == {"package", "interface"}
    assert got.where("origin = 'interface' and tier is not null").count() == 0


def test_interfaces_as_files(spark, tmp_path):
    made = corpus.interfaces(spark, 12)
    corpus.write_interfaces(made, f"file://{tmp_path}")
    manifest = spark.read.json(f"file://{tmp_path}/manifest").collect()
    assert len(manifest) == 12 and all("node.idf" in r.artefacts and "srvc/main/flow.xml" in r.artefacts and r.adapters >= 1 for r in manifest)
    files = spark.read.json(f"file://{tmp_path}/artefacts")
    back = {(r.interface, r.target, r.source, r.kind, r.hops) for r in evaluate(interfaces_of(files)).collect()}
    assert back == {(r.interface, r.target, r.source, r.kind, r.hops) for r in evaluate(made).collect()}
    blobs = blobs_of(files).count()
    assert blobs == sum(r.adapters for r in manifest)


def test_levels_count_every_way_whatever_the_row_limit_of_recursion(spark):
    pairs = [("R.1", "A"), ("R.1", "A"), ("R.2", "A"), ("A", "B"), ("A", "C"), ("B", "C"), ("C", None), ("X", "Y"), (None, "A")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    starts = F.startswith("source", F.lit("R."))
    assert [tuple(r) for r in graph.levels(edges, starts).orderBy("level").collect()] == [(1, 2), (2, 3), (3, 6), (4, 6), (5, 3)]
    assert graph.levels(edges, F.lit(False)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(spark.createDataFrame([("R.1", "A"), ("A", "R.1")], "source string, target string"), starts)
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, "10")
    try:
        assert QUERIES["twin_connect_by"](spark, "/root/testdata/sf0.001").count() == 4
    finally:
        spark.conf.unset(limit)


def test_names_of_a_long_answer_are_found_in_time(spark):
    edges = [f"  S{k}.a -> s{k % 50}.A [DIRECT]" for k in range(20_000)]
    answers = spark.createDataFrame([("T.X: upstream, depth 1, some edges\n" + "\n".join(edges),)], "text string")
    began = time.monotonic()
    got = focus.focus(answers, most=1 << 30).select("columns").first()[0]
    assert time.monotonic() - began < 60
    assert got[:4] == ["T.X", "S0.a", "S1.a", "S2.a"] and len(got) == 20_001
