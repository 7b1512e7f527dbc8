"""Shapes, reports, hierarchies, sources and streams on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.operators import graph as G
from lexigraph.operators import hierarchy as H
from lexigraph.operators import report as R
from lexigraph.operators import shapes as S
from lexigraph.plans import lift as L
from lexigraph.schema import RESULTS, TRIPLES
from lexigraph.sinks import documents as D
from lexigraph.sources import rdf

O = N.OFN


def rows(spark, *facts):
    return spark.createDataFrame([("g", s, "iri", p, o, "iri" if o.startswith("http") else "literal", None, None) for s, p, o in facts], TRIPLES)


def concept(s, *facts):
    return [(s, N.TYPE, O + N.CONCEPT), *[(s, p, o) for p, o in facts]]


def raised(df):
    keys = {r.iri: k for k, r in S.RULES.items()}
    return sorted((x["focusNodeUri"], keys[x["ruleName"]]) for x in df.collect())


PPDF, PROV = (N.DEFAULT_NS + N.PPDF, "true"), (N.DEFAULT_NS + N.PROVISION, "https://x.example/p")
TSP, PUB, NON = ((N.TYPE, O + k) for k in (N.SUBJECT_TYPE, N.PUBLIC, N.NON_PUBLIC))
BOTH = ["agenda-ais", "popis", "zdroj"]


@pytest.mark.parametrize("facts, want", [
    ([], BOTH), ([(N.SKOS + "definition", "d")], ["agenda-ais", "zdroj"]), ([TSP, PPDF], [*BOTH, "rpp-complete"]), ([TSP, NON, PPDF], [*BOTH, "non-public"]), ([TSP, NON, PPDF, PROV], [*BOTH, "rpp-complete"]),
    ([TSP, PUB], [*BOTH, "no-ppdf", "no-ppdf"]), ([(N.DEFAULT_NS + N.AGENDA, "https://a.example/1")], BOTH), ([TSP, (N.AGENDA_104 + N.PPDF_LONG, "true")], [*BOTH, "no-ppdf"]),
])
def test_rules(spark, facts, want):
    assert [k for _, k in raised(S.validate(rows(spark, *concept("https://n.example/1", *facts))))] == sorted(want)


def test_subclasses_are_targets(spark):
    t = rows(spark, ("https://n/1", N.TYPE, "https://k/low"), ("https://k/low", N.RDFS + "subClassOf", "https://k/mid"), ("https://k/mid", N.RDFS + "subClassOf", O + N.CONCEPT))
    assert [s for s, _ in raised(S.validate(t, ["popis"]))] == ["https://n/1"]


def test_empty_graph_and_no_rules(spark):
    t = rows(spark, ("x", "y", "z")).limit(0)
    assert S.validate(t).count() == 0 and S.validate(t, []).columns == RESULTS.names


def test_reports(spark):
    r = spark.createDataFrame([("ERROR", "m", "R1", "n1", None, "v"), ("ERROR", "m", "R1", "n3", None, None), ("ERROR", "f", None, "n2", None, None), ("WARNING", "w", "R2", "n1", None, None), ("INFO", "i", "R3", None, None, None)], RESULTS)
    assert [(x["severity"], x["count"], x["description"]) for x in R.severity_groups(r).collect()] == [("Chyba", 1, "f"), ("Chyba", 2, "m"), ("Varování", 1, "w"), ("Informace", 1, "i")]
    assert {(x["focusNodeUri"], x["ruleName"]) for x in R.by_concept(r).collect()} == {("n1", "r1"), ("n1", "r2"), ("n2", "unknown-rule"), ("n3", "r1")}
    assert not R.may_publish(r) and R.may_publish(r.where("severity <> 'ERROR'"))
    concepts = spark.createDataFrame([("n1",), ("n9",)], "s string")
    csv = R.csv_rows(r, concepts).collect()
    assert [x["Rule_Description"] for x in csv if x["Concept_IRI"] == "n9"] == ["No violations found"]
    assert {x["Violation_Message"] for x in csv if x["Rule_IRI"] == "r1"} == {"v", ""}
    assert R.csv_rows(r, compatible=False).where("Rule_IRI = 'r1'").first()["Violation_Message"] == "m"


def test_closure_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), (None, "x")], "child string, parent string")
    assert {r["node"] for r in H.in_cycles(e).collect()} == {"a", "b", "c"}
    assert H.closure(e).count() == 12
    assert H.closure(e.limit(0)).count() == 0


def test_filters_and_references(spark):
    lookup = spark.createDataFrame([("B", "id-b"), ("C", "id-c")], "name string, identifier string")
    r = spark.createDataFrame([("r1", "B", "x"), ("r2", "C", "x"), ("id-b", "C", "B")], "identifier string, domain string, super string")
    got = L.without_filtered(r, lookup, "id-b", references=("domain",), softened=("super",)).collect()
    assert [(x["identifier"], x["super"]) for x in got] == [("r2", "x")]


def test_turtle_round_trip(spark, tmp_path):
    t = rows(spark, ("https://a.example/ř", N.TYPE, O + N.CONCEPT)).unionByName(spark.createDataFrame([("g", "https://a.example/x", "iri", N.SKOS + "prefLabel", 'say "hi" \\ there\nnow; . , [x]', "literal", None, "cs"), ("g", "https://a.example/x", "iri", "https://p.example/n", "5", "literal", N.XSD + "integer", None)], TRIPLES))
    text = D.turtle_head() + "\n".join(r["block"] for r in D.turtle_blocks(t).collect())
    (tmp_path / "g.ttl").write_text(text)
    got = rdf.read_turtle(spark, str(tmp_path / "g.ttl")).drop("graph_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, t.drop("graph_id").collect()), key=str)


def joined(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_documents(spark, tmp_path):
    import json

    t = rows(spark, *concept("https://n/1", (N.SKOS + "prefLabel", "A"), (N.SKOS + "altLabel", "B")), *concept("https://n/2"))
    D.write_lines(D.jsonld_lines(t, "https://v", "V"), str(tmp_path / "j"))
    doc = json.loads(joined(tmp_path / "j"))
    assert doc["pojmy"] == [{"iri": "https://n/1", "typ": ["Pojem"], "název": {"cs": "A"}, "alternativní-název": {"cs": ["B"]}}, {"iri": "https://n/2", "typ": ["Pojem"]}]
    D.write_turtle(t, str(tmp_path / "t"))
    assert len(rdf.statements(joined(tmp_path / "t"), "g")) == t.count()


def test_api(spark, tmp_path):
    from lexigraph import api

    D.write_turtle(rows(spark, *concept("https://n/1", (N.SKOS + "prefLabel", "A"))), str(tmp_path / "t"))
    (tmp_path / "in.ttl").write_text(joined(tmp_path / "t"))
    got = api.convert(spark, str(tmp_path / "in.ttl"), "TURTLE")
    assert got.triples.count() == 2 and raised(got.results) == [("https://n/1", k) for k in BOTH]
    assert api.validate_text(spark, (tmp_path / "in.ttl").read_text()).count() == 3
    assert api.output_format("Turtle", None) == "turtle" and api.output_format(None, "text/turtle") == "turtle" and api.output_format("", "*/*") == "json"
    assert api.report_name("a", "csv", "2024-01-02T03:04:05") == "a_2024-01-02_03-04-05.csv"
    with pytest.raises(ValueError):
        api.convert(spark, "x", "PDF")
    with pytest.raises(ValueError):
        api.validate_text(spark, "  ")
    with pytest.raises(ValueError):
        api.fetchable("http://localhost/x")
    assert api.fetchable("https://data.example.org/x.ttl")


def test_stream(spark, tmp_path):
    from lexigraph.streaming import checks

    rows(spark, *concept("https://n/1")).write.parquet(str(tmp_path / "in"))
    seen = []
    q = checks.validate_arrivals(checks.events_as_stream(spark, str(tmp_path / "in"), TRIPLES), lambda df, epoch: seen.append(df.count()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == [3]


def test_optional_compatible(spark):
    left = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (2, "x"), (3, "z")], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in G.optional_compatible(left, right, "k", "v").collect()) == [(1, "a"), (2, "x"), (3, "y")]


def test_components(spark):
    t = rows(spark, ("a", "p", "1"), ("a", "p", "5"), ("b", "p", "9"))
    f = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    assert {(r["s"], r["value"]) for r in S.count_outside(t, f, "p", 1, 1).collect()} == {("a", "2"), ("c", "0")}
    assert {r["value"] for r in S.values_failing(t, f, "p", F.col("o").cast("int") < 6).collect()} == {"9"}
    c = S.conformance(f, one=S.count_outside(t, f, "p", 1, 1), small=S.values_failing(t, f, "p", F.col("o").cast("int") < 6))
    assert {(r["s"], r["one"], r["small"]) for r in c.collect()} == {("a", False, True), ("b", True, False), ("c", False, True)}
    assert {r["s"] for r in c.where(S.exactly_one_of("one", "small")).collect()} == {"a", "b", "c"} and c.where(S.all_of("one", "small")).count() == 0
    assert {r["s"] for r in S.missing_value(t, f, "p", "5").collect()} == {"b", "c"}


def test_domains_from_any_depth(spark, monkeypatch):
    """No number of levels ends the search; a cycle without a domain does."""
    from lexigraph.operators import hierarchy as H

    monkeypatch.setattr(H, "MAX_DEPTH", 2)
    properties = spark.createDataFrame([("p0", "d"), *[(f"p{i}", None) for i in range(1, 7)], ("x", None), ("y", " ")], "name string, domain string")
    links = spark.createDataFrame([*[(f"p{i}", f"p{i - 1}") for i in range(1, 7)], ("x", "y"), ("y", "x")], "subClass string, superClass string")
    got = {r["name"]: r["domain"] for r in H.inherited_domains(properties, links).collect()}
    assert got == {**{f"p{i}": "d" for i in range(7)}, "x": None, "y": None}


def test_optional_with_shared_variables(spark):
    """Against the definition, with and without a variable that is always bound."""
    left = [(1, "a", None), (1, None, "x"), (2, None, None), (3, "b", "y"), (3, "b", "y")]
    right = [(1, "a", "x", "p"), (1, "a", None, "q"), (1, "c", "x", "r"), (2, None, "z", "s"), (3, "c", "y", "t")]

    def brute(left, right):
        out = []
        for x in left:
            fits = [y for y in right if all(a is None or b is None or a == b for a, b in zip(x, y))]
            out += [(*(a if a is not None else b for a, b in zip(x, y)), y[-1]) for y in fits] or [(*x, None)]
        return sorted(map(str, out))

    l3, r3 = spark.createDataFrame(left, "k int, a string, b string"), spark.createDataFrame(right, "k int, a string, b string, x string")
    assert sorted(str(tuple(r)) for r in G.optional_shared(l3, r3, ["k"], ["a", "b"]).collect()) == brute(left, right)
    bound = [r[1:] for r in left if r[1] or r[2]]
    both = [(a, b, x) for _, a, b, x in right if a and b]
    l2, r2 = spark.createDataFrame(bound, "a string, b string"), spark.createDataFrame(both, "a string, b string, x string")
    assert sorted(str(tuple(r)) for r in G.optional_shared(l2, r2, [], ["a", "b"]).collect()) == brute(bound, both)
    with pytest.raises(ValueError):
        G.optional_shared(l2.union(spark.createDataFrame([(None, None)], "a string, b string")), r2, [], ["a", "b"])


def test_failed_validation_is_a_result(spark):
    from lexigraph.operators import report as R

    fails = lambda: spark.sql("SELECT raise_error('x') AS severity, '' AS message, '' AS ruleName, '' AS focusNodeUri, '' AS resultPathUri, '' AS value")
    row = R.results_or_error(fails, spark).first()
    assert (row["severity"], row["ruleName"]) == ("ERROR", "system-error")
    rows = spark.createDataFrame([(" é ", None)], "a string, b string")
    assert R.normalised(rows).first() == ("é", "")


def test_values_of_any_depth(spark):
    from lexigraph.functions import trees

    t = spark.createDataFrame([(1, '{"a": [{"b": [[], {"c": " "}]}, 0, false], "d": {"e": {"f": "x"}}}'), (2, '[{}, [null]]'), (3, "no json"), (4, None), (5, "7")], "k int, t string")
    assert [r[0] for r in t.orderBy("k").select(trees.pruned_json("t")).collect()] == ['{"a":[0,false],"d":{"e":{"f":"x"}}}', None, None, None, "7"]
    assert {(r["k"], r["path"], r["value"]) for r in trees.leaves(t, "k", "t").collect()} == {(1, "a[0].b[1].c", " "), (1, "a[1]", "0"), (1, "a[2]", "false"), (1, "d.e.f", "x"), (2, "[1][0]", None), (5, "", "7")}
