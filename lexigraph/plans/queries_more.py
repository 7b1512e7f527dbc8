"""Queries on optional patterns, the order of documents, nested values, what an export leads to, and the keys of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.functions import trees
from lexigraph.operators import concepts as C
from lexigraph.operators import graph as G
from lexigraph.operators import report as R
from lexigraph.plans import lift as L
from lexigraph.plans import tpch
from lexigraph.plans.queries_shapes import over_all, validated
from lexigraph.plans.registry import query
from lexigraph.plans.tpch import read
from lexigraph.plans.written import written
from lexigraph.sources import rdf


@query("""WITH l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS a, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS b FROM customer),
r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS a, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS b, 'one' AS x FROM customer WHERE c_custkey % 4 <> 3
      UNION ALL SELECT c_custkey, c_nationkey + 1, NULL, 'two' FROM customer)
SELECT l.k, coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, x FROM l LEFT JOIN r ON l.k = r.k AND (l.a IS NULL OR r.a IS NULL OR l.a = r.a) AND (l.b IS NULL OR r.b IS NULL OR l.b = r.b)""")
def graph_optional_two_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An optional pattern that uses two variables again, either of which may be unbound on either side."""
    c = read(spark, sf_dir, "customer")
    k, n, s = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    left = c.select(k.alias("k"), F.when(k % 2 == 0, n).alias("a"), F.when(k % 3 == 0, s).alias("b"))
    one = c.where(k % 4 != 3).select(k.alias("k"), F.when(k % 5 != 0, n).alias("a"), F.when(k % 7 != 0, s).alias("b"), F.lit("one").alias("x"))
    two = c.select(k.alias("k"), (n + 1).alias("a"), F.lit(None).cast("string").alias("b"), F.lit("two").alias("x"))
    return G.optional_shared(left, one.unionByName(two), ["k"], ["a", "b"])


REL = tpch.BASE + "relation-"


@query(f"""WITH s AS (SELECT s_suppkey AS k, '{REL}' || s_suppkey AS relationship, CASE WHEN s_suppkey % 2 = 0 THEN 'https://c/' || (s_suppkey % 10) END AS d, CASE WHEN s_suppkey % 3 = 0 THEN 'https://c/' || (s_suppkey % 7) END AS r FROM supplier),
x AS (SELECT k, 'https://c/' || (CASE WHEN k % 8 = 0 THEN k % 10 ELSE k % 6 END) AS v FROM s WHERE k % 4 < 2 UNION ALL SELECT k, 'https://c/99' FROM s WHERE k % 16 = 1),
y AS (SELECT k, 'https://c/' || (CASE WHEN k % 2 = 0 THEN k % 7 ELSE k % 5 END) AS v FROM s WHERE k % 3 < 2)
SELECT DISTINCT relationship, coalesce(d, x.v) AS domain, coalesce(r, y.v) AS range FROM s LEFT JOIN x ON s.k = x.k AND (d IS NULL OR d = x.v) LEFT JOIN y ON s.k = y.k AND (r IS NULL OR r = y.v)""")
def ssp_relationship_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains and ranges of relations from three sources in turn, restrictions among them."""
    k = F.col("s_suppkey")
    c = lambda n: F.concat(F.lit("https://c/"), n.cast("string"))
    node = lambda tag: F.concat(F.lit(f"_:{tag}"), k.cast("string"))

    def restriction(tag: str, test, end: str, kind):
        told = ((N.TYPE, F.lit(N.OWL + "Restriction")), (N.OWL + "onProperty", F.lit(C.ENDS[end])), (N.OWL + "onClass", kind))
        return [L.fact(N.RDFS + "subClassOf", F.when(test, node(tag)), L.BNODE), *[L.fact(p, F.when(test, o), L.IRI, s=node(tag)) for p, o in told]]

    facts = [
        L.fact(N.TYPE, F.lit(C.BASIC + "pojem/typ-vztahu"), L.IRI), L.fact(N.TYPE, F.when(k % 5 == 0, N.OWL + "ObjectProperty"), L.IRI), L.fact(N.RDFS + "domain", F.when(k % 2 == 0, c(k % 10)), L.IRI), L.fact(N.RDFS + "range", F.when(k % 3 == 0, c(k % 7)), L.IRI),
        *restriction("a", k % 4 < 2, "domain", F.when(k % 8 == 0, c(k % 10)).otherwise(c(k % 6))), *restriction("b", k % 16 == 1, "domain", F.lit("https://c/99")), *restriction("r", k % 3 < 2, "range", F.when(k % 2 == 0, c(k % 7)).otherwise(c(k % 5))),
    ]
    return C.relationship_ends(L.told(read(spark, sf_dir, "supplier"), F.concat(F.lit(REL), k.cast("string")), *facts), REL)


@query("SELECT 'https://s/' || s_suppkey AS s, 'zz ' || s_name AS first_label, 'aa ' || s_name AS label, 'b' || s_nationkey || '|a|b' || s_nationkey AS names FROM supplier")
def graph_fold_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last labels and all other names in the order of the Turtle files that they are in."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(F.lit("<https://s/"), k, F.lit(f'> <{N.SKOS}prefLabel> "zz '), "s_name", F.lit('", "aa '), "s_name", F.lit(f'" ; <{N.SKOS}altLabel> "b'), n, F.lit('", "a", "b'), n, F.lit('" .'))
    triples = rdf.read_turtle_in_order(spark, written(read(spark, sf_dir, "supplier").select(text.alias("text")), "ordered"))
    last = G.fold_ordered(triples, {"label": N.SKOS + "prefLabel"}, {"names": N.SKOS + "altLabel"})
    return G.also(last, G.first_values(triples, {"first_label": N.SKOS + "prefLabel"})).withColumn("names", F.array_join("names", "|"))


def _wrapped() -> Column:
    tail = F.when(F.col("event_id") % 2 == 0, "[]").otherwise('"x"')
    return F.concat(F.lit('{"a":{"b":{"c":'), "props", F.lit(',"d":"  "},"e":[null,{},["",{"f":[]}]]},"g":'), tail, F.lit("}"))


@query("""SELECT event_id, '{"a":{"b":{"c":' || replace(props, ' ', '') || '}}' || CASE WHEN event_id % 2 = 0 THEN '' ELSE ',"g":"x"' END || '}' AS tree FROM events""")
def fn_pruned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties wrapped in three levels with empty parts in each, which go."""
    return read(spark, sf_dir, "events").select("event_id", trees.pruned_json(_wrapped()).alias("tree"))


@query("""SELECT event_id, 'a.b.c.k' AS path, regexp_extract(props, '[0-9]+') AS value FROM events UNION ALL SELECT event_id, 'a.b.d', '  ' FROM events UNION ALL SELECT event_id, 'a.e[0]', NULL FROM events
  UNION ALL SELECT event_id, 'a.e[2][0]', '' FROM events UNION ALL SELECT event_id, 'g', 'x' FROM events WHERE event_id % 2 <> 0""")
def fn_tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost values of the wrapped properties, with their paths."""
    return trees.leaves(read(spark, sf_dir, "events").select("event_id", _wrapped().alias("tree")), "event_id", "tree")


OWN, OTHER = "https://own.example/", "https://other.example/"


@query(f"""WITH s AS (SELECT s_suppkey::VARCHAR AS k FROM supplier WHERE s_suppkey % 2 = 0)
SELECT '{OWN}' || k AS s, '{OWN}has' AS p, '_:a' || k AS o FROM s UNION ALL SELECT '_:a' || k, '{OWN}has', '_:b' || k FROM s UNION ALL SELECT '_:b' || k, '{OWN}has', '_:a' || k FROM s UNION ALL SELECT '_:b' || k, '{OWN}text', 'deep' FROM s
  UNION ALL SELECT '{OWN}' || k, '{N.RDFS}domain', '{OTHER}' || k FROM s UNION ALL SELECT '{OWN}' || k, '{OWN}definiční-obor', 'only a text' FROM s UNION ALL SELECT '{OWN}' || k, '{N.RDFS}range', '_:c' || k FROM s UNION ALL SELECT '_:c' || k, '{OWN}text', 'range' FROM s""")
def filter_orphan_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export with chains and circles of blank nodes: those of subjects outside the namespace and those that nothing leads to go; domains and ranges are the standard ones."""
    k = F.col("s_suppkey").cast("string")
    node = lambda tag: F.concat(F.lit(f"_:{tag}"), k)
    has, text = OWN + "has", OWN + "text"
    facts = [
        L.fact(has, node("a"), L.BNODE), L.fact(has, node("b"), L.BNODE, s=node("a")), L.fact(has, node("a"), L.BNODE, s=node("b")), L.fact(text, F.lit("deep"), s=node("b")), L.fact(text, F.lit("orphan"), s=node("z")), L.fact(has, node("a"), L.BNODE, s=node("y")),
        L.fact(OWN + "definiční-obor", F.concat(F.lit(OTHER), k), L.IRI), L.fact(OWN + "definiční-obor", F.lit("only a text")), L.fact(OWN + "obor-hodnot", node("c"), L.BNODE), L.fact(text, F.lit("range"), s=node("c")),
    ]
    iri = F.concat(F.when(F.col("s_suppkey") % 2 == 0, OWN).otherwise(OTHER), k)
    return L.export_triples(L.told(read(spark, sf_dir, "supplier"), iri, *facts), OWN).select("s", "p", "o")


@query(over_all("""SELECT "focusNodeUri", "ruleName", severity, CASE WHEN "ruleName" = 'unknown-rule' THEN 'violation-rule-' || row_number() OVER (PARTITION BY "focusNodeUri" ORDER BY "ruleName") ELSE "ruleName" END AS key
  FROM (SELECT DISTINCT focusNodeUri, CASE WHEN ends_with(ruleName, 'pojem-nemá-zdroj') THEN 'unknown-rule' ELSE lower(ruleName) END AS ruleName, severity FROM r)"""))
def report_violation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a detailed report: rules by name, results without a rule by their place."""
    rule = F.col("ruleName")
    return R.violation_keys(validated(spark, sf_dir).withColumn("ruleName", F.when(~rule.endswith("pojem-nemá-zdroj"), rule))).select("focusNodeUri", "ruleName", "severity", "key")
