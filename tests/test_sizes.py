"""What must not grow with the tables: files that are read as a whole, rows of one task, tables sent whole, graphs computed anew."""

import glob

from pyspark.sql import functions as F

from lexigraph.operators import isomorphism, paths, shapes, shacl
from lexigraph.plans import catalogue, lift, queries_ingest, queries_rules, tpch, written
from lexigraph.sinks import documents
from tests.oracle import connect, same_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_turtle_files_are_bounded(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(documents, "FILE_SUBJECTS", 20)
    monkeypatch.setattr(written, "shared_folder", lambda spark, name: str(tmp_path / name))
    assert written.turtle_round_trip(tpch.triples(spark, sf_dir)).count() > 0
    texts = [open(f).read() for f in glob.glob(f"{tmp_path}/turtle/part-*")]
    assert len([t for t in texts if t]) > 5 and all(t.count("@prefix rdf:") == 1 for t in texts if t)
    documents.write_turtle(tpch.triples(spark, sf_dir), str(tmp_path / "ordered"))
    assert len(glob.glob(f"{tmp_path}/ordered/part-*")) > 5


def test_models_are_dealt_over_files(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries_ingest, "FILE_MEMBERS", 3)
    nations, suppliers, customers = queries_ingest.models(spark, sf_dir)
    assert suppliers.select("file").union(customers.select("file")).distinct().count() > spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    for name in ("ingest_archi", "ingest_xmi"):
        same_rows(spark, sf_dir, connect(sf_dir), catalogue.QUERIES[name], catalogue.SQL[name])


def test_records_are_dealt_over_tasks(spark, sf_dir, monkeypatch):
    df = tpch.classes(spark, sf_dir)
    assert tpch.dealt(df, 100).rdd.getNumPartitions() == tpch.tasks(df, 100) > 2
    assert tpch.dealt(df, 100).count() == df.count()
    monkeypatch.setattr(queries_rules, "TASK_LINES", 500)
    for name in ("path_sequence", "path_alternative"):
        same_rows(spark, sf_dir, connect(sf_dir), catalogue.QUERIES[name], catalogue.SQL[name])


def test_pairs_of_paths_by_one_aggregation(spark):
    t = spark.createDataFrame([("x", "a", "1"), ("x", "a", "1"), ("x", "b", "1"), ("x", "b", "2"), ("y", "a", "3"), ("z", "a", "4")], "s string, p string, o string").withColumns(
        {c: F.lit(None).cast("string") for c in ("o_kind", "o_dt", "o_lang")}
    )
    focus = spark.createDataFrame([("x",), ("y",)], "s string")
    unequal, common = shapes.unequal_values(t, focus, "a", "b"), shapes.common_values(t, focus, "a", "b")
    assert sorted(map(tuple, unequal.collect())) == [("x", "2"), ("y", "3")] and [tuple(r) for r in common.collect()] == [("x", "1")]
    assert shapes.unequal_values(t, focus, "a", "a").count() == 0 and shapes.common_values(t, focus, "a", "a").count() == 2
    assert plan(unequal).count("Join") < 3


def test_repeated_paths_and_shapes_read_a_stored_graph(spark, monkeypatch):
    kept = []
    for module in (paths, shacl):
        monkeypatch.setattr(module, "stored", lambda df, keep=module.stored: kept.append(sorted(r[0] for r in df.select("p").distinct().collect())) or keep(df))
    rows = spark.createDataFrame([("a", "iri", p, o, "iri", None, None) for p, o in (("in", "b"), ("other", "c"), (shacl.N.TYPE, "K"))], "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")
    graph = paths.named(rows)
    assert paths.walk(graph, paths.nodes(rows.select("s")), paths.repeated(paths.predicate("in"))).count() == 2
    shape = shacl.Shape("r", path=paths.predicate("in"), targets=[("targetClass", shacl.Term("K"))], constraints=[shacl.Constraint("minCount", [shacl.Term("2")])])
    assert shacl.validate_shapes(rows, [shape]).count() == 1
    assert kept == [["in"], sorted(["in", shacl.N.TYPE])]
    closed = shacl.Shape("r", targets=shape.targets, constraints=[shacl.Constraint("closed", [shacl.Term("in")])])
    assert shacl.predicates_of([closed]) is None and shacl.validate_shapes(rows, [closed]).count() == 2


def test_nodes_are_not_sent_whole(spark):
    t = lift.told(spark.range(5), F.concat(F.lit("http://e/"), F.col("id").cast("string")), lift.fact("p", F.concat(F.lit("_:"), F.col("id").cast("string")), lift.BNODE))
    assert "BroadcastHashJoin" not in plan(isomorphism.canonical_blanks(t))


def test_json_is_read_once(spark, sf_dir, monkeypatch):
    calls = []
    monkeypatch.setattr(queries_ingest, "stored", lambda df, keep=queries_ingest.stored: calls.append(1) or keep(df))
    assert "MapInPandas" not in plan(catalogue.QUERIES["ingest_jsonld"](spark, sf_dir)) and calls == [1]


def test_lines_meet_orders_with_their_customers(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(tpch.relationships(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x for x in text.split("\n") if "Exchange hashpartitioning" in x]
    assert sum("l_partkey" in x or "l_orderkey" in x for x in lines) == 2 and not any("o_custkey" in x and "l_" in x for x in lines)
