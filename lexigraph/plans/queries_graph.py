"""Queries on graph patterns, joins, look-ups, hierarchies, sets and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.functions import terms as T
from lexigraph.operators import concepts as C
from lexigraph.operators import graph as G
from lexigraph.operators import hierarchy as H
from lexigraph.plans import lift as L
from lexigraph.plans import tpch
from lexigraph.plans.registry import query
from lexigraph.plans.tpch import read, with_graph

TY, O, D = N.TYPE, N.OFN, N.DEFAULT_NS
LAB, DESC = N.SKOS + "prefLabel", N.DCT + "description"
AG, AI, SRC, TITLE = D + N.AGENDA, D + N.AIS, D + N.DEFINING_OTHER, N.DCT + "title"


def _m(p: str, o: str = "o", s: str = "s") -> str:
    return f"(SELECT s AS {s}, o AS {o} FROM t WHERE p = '{p}')"


@query(with_graph(f"SELECT DISTINCT a.s AS concept, a.label, b.agenda FROM {_m(LAB, 'label')} a JOIN {_m(AG, 'agenda')} b USING (s) JOIN (SELECT s FROM t WHERE p = '{TY}' AND o = '{O}{N.CONCEPT}') k USING (s)"))
def graph_bgp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    both = G.also(G.also(G.match(t, "concept", LAB, "label"), G.match(t, "concept", AG, "agenda")), G.instances(t, O + N.CONCEPT, "concept"))
    return both.distinct()


@query(with_graph(f"SELECT a.s AS concept, a.label, b.agenda, c.ais FROM {_m(LAB, 'label')} a LEFT JOIN {_m(AG, 'agenda')} b USING (s) LEFT JOIN {_m(AI, 'ais')} c USING (s)"))
def graph_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    return G.optional(G.optional(G.match(t, "concept", LAB, "label"), G.match(t, "concept", AG, "agenda")), G.match(t, "concept", AI, "ais"))


@query("""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS n FROM customer), b AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer UNION ALL SELECT c_custkey, c_nationkey + 1 FROM customer)
  SELECT a.k, coalesce(a.n, b.n) AS n FROM a LEFT JOIN b ON a.k = b.k AND (a.n IS NULL OR a.n = b.n)""")
def graph_optional_shared_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    left = c.select("k", F.when(F.col("k") % 2 == 0, F.col("n")).alias("n"))
    return G.optional_compatible(left, c.union(c.select("k", F.col("n") + 1)), "k", "n")


@query(with_graph(f"SELECT a.s AS concept, a.label, EXISTS (SELECT 1 FROM t WHERE t.s = a.s AND t.p = '{AG}') AS owned FROM {_m(LAB, 'label')} a"))
def graph_bind_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    return G.bind_exists(G.match(t, "concept", LAB, "label"), G.match(t, "concept", AG), "owned")


@query(with_graph(f"SELECT s, o AS kind FROM t WHERE p = '{TY}' AND o IN ('{O}{N.PUBLIC}', '{O}{N.NON_PUBLIC}')"))
def graph_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.values(G.match(tpch.triples(spark, sf_dir), "s", TY, "kind"), "kind", O + N.PUBLIC, O + N.NON_PUBLIC)


@query(with_graph(f"SELECT s FROM t WHERE p = '{TY}' AND o = '{O}{N.OBJECT_TYPE}' UNION ALL SELECT s FROM t WHERE p = '{TY}' AND o = '{O}{N.PUBLIC}'"))
def graph_union_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    return G.union_bag(G.instances(t, O + N.OBJECT_TYPE), G.instances(t, O + N.PUBLIC))


@query(with_graph(f"SELECT s, o AS label FROM t x WHERE p = '{LAB}' AND (NOT EXISTS (SELECT 1 FROM t WHERE t.s = x.s AND t.p = '{AG}') OR NOT EXISTS (SELECT 1 FROM t WHERE t.s = x.s AND t.p = '{AI}'))"))
def graph_not_exists_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    x = G.bind_exists(G.bind_exists(G.match(t, "s", LAB, "label"), G.match(t, "s", AG), "a"), G.match(t, "s", AI), "b")
    return x.where(~F.col("a") | ~F.col("b")).select("s", "label")


@query(with_graph(f"SELECT s FROM t x WHERE p = '{LAB}' AND EXISTS (SELECT 1 FROM t WHERE t.s = x.s AND t.p = '{AG}') AND NOT EXISTS (SELECT 1 FROM t WHERE t.s = x.s AND t.p = '{AI}')"))
def graph_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    return G.where_not_exists(G.where_exists(G.match(t, "s", LAB), G.match(t, "s", AG)), G.match(t, "s", AI))


@query(with_graph(f"SELECT DISTINCT s FROM t WHERE contains(p, '{N.AIS}') UNION ALL SELECT DISTINCT s FROM t WHERE contains(p, '{N.PPDF}') AND o = 'true'"))
def graph_predicate_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    return G.union_bag(G.predicate_contains(t, N.AIS), G.predicate_contains(t, N.PPDF, value="true"))


@query(with_graph("SELECT s, o FROM t WHERE p = 'https://none.example/p'"))
def graph_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern on a predicate that the graph hasn't: no solutions."""
    return G.match(tpch.triples(spark, sf_dir), "s", "https://none.example/p", "o")


@query(with_graph("SELECT DISTINCT p, o_kind FROM t ORDER BY p, o_kind"))
def graph_distinct_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpch.triples(spark, sf_dir).select("p", "o_kind").distinct().orderBy("p", "o_kind")


@query("SELECT user_id AS concept, min(event_type) AS type, min(props) AS props, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def graph_fold_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("concept"), F.col("event_type").alias("type"), "props", F.col("event_type").alias("types"))
    return G.fold(e, "concept", ["type", "props"], ["types"]).withColumn("types", F.array_join("types", "|"))


@query(with_graph(f"SELECT DISTINCT s, p, o FROM t WHERE p <> '{TY}'"))
def graph_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    return G.difference(t, t.where(F.col("p") == TY).select("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")).select("s", "p", "o")


@query(with_graph(f"SELECT DISTINCT s, p, o FROM t WHERE p IN ('{TY}', '{LAB}')"))
def graph_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir).where(F.col("p").isin(TY, LAB))
    return G.graph(G.union_bag(t, t.where(F.col("p") == LAB))).select("s", "p", "o")


@query(with_graph(f"SELECT s, min(CASE WHEN p = '{LAB}' THEN o END) AS label, min(CASE WHEN p = '{DESC}' THEN o END) AS description, min(CASE WHEN p = '{AG}' THEN o END) AS agenda FROM t WHERE p IN ('{LAB}', '{DESC}', '{AG}') GROUP BY s"))
def graph_star_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.star(tpch.triples(spark, sf_dir), {"label": LAB, "description": DESC, "agenda": AG})


@query(with_graph(f"SELECT a.s, a.label, b.description, d.title FROM {_m(LAB, 'label')} a JOIN {_m(DESC, 'description')} b USING (s) LEFT JOIN (SELECT x.s, y.o AS title FROM t x JOIN t y ON x.o = y.s AND y.p = '{TITLE}' WHERE x.p = '{SRC}') d USING (s)"))
def graph_star_inner_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    source = G.also(G.match(t, "s", SRC, "doc"), G.match(t, "doc", TITLE, "title")).select("s", "title")
    return G.optional(G.also(G.match(t, "s", LAB, "label"), G.match(t, "s", DESC, "description")), source)


@query(with_graph(f"SELECT DISTINCT d.s FROM t d WHERE d.p = '{TY}' AND d.o = '{N.DIGITAL_OBJECT}' AND EXISTS (SELECT 1 FROM t WHERE t.o = d.s)"))
def graph_in_use_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    return G.where_exists(G.instances(t, N.DIGITAL_OBJECT), t.where(F.col("o_kind") != L.LITERAL).select(F.col("o").alias("s")))


@query(with_graph(f"SELECT s, coalesce(min(CASE WHEN p = 'https://other.example/{N.AGENDA}' THEN o END), min(CASE WHEN p = '{AG}' THEN o END)) AS agenda FROM t WHERE p = '{AG}' GROUP BY s"))
def graph_either_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.star(tpch.triples(spark, sf_dir), {"own": "https://other.example/" + N.AGENDA, "default": AG})
    return x.select("s", F.coalesce("own", "default").alias("agenda"))


def _concepts(t: DataFrame, namespace: str) -> DataFrame:
    return G.match(t, "s", LAB, "label").where(F.col("s").startswith(namespace))


PARTS = tpch.BASE + "part-"


@query(with_graph(f"SELECT DISTINCT s, o AS label FROM t WHERE p = '{LAB}' AND starts_with(s, '{PARTS}')"))
def ssp_simple_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _concepts(tpch.triples(spark, sf_dir), PARTS).distinct()


def thesaurus_sql(sql: str) -> str:
    return f"WITH {tpch.THESAURUS_SQL} {sql}"


_ABOUT = " ".join(f"LEFT JOIN (SELECT DISTINCT s, o FROM t WHERE p = '{p}') a{i} ON a{i}.s = c.s" for i, p in enumerate(C.ABOUT.values()))


@query(thesaurus_sql(f"""SELECT DISTINCT c.s AS concept, h.o AS thesaurus, {", ".join(f'a{i}.o AS "{v}"' for i, v in enumerate(C.ABOUT))}, m.o AS "modelType", u.o AS "subClassOf",
    EXISTS (SELECT 1 FROM t x JOIN t y ON x.o = y.s AND y.p = '{N.SKOS}member' WHERE x.p = '{N.DCT}hasPart' AND x.s = h.o AND y.o = c.s) AS "isOwned"
  FROM (SELECT s FROM t WHERE p = '{TY}' AND o = '{N.SKOS}Concept' AND starts_with(s, '{tpch.THESAURUS}')) c JOIN t h ON h.s = c.s AND h.p = '{N.SKOS}inScheme' {_ABOUT}
  LEFT JOIN t m ON m.s = c.s AND m.p = '{TY}' AND m.o IN ({", ".join(f"'{C.BASIC}{k}'" for k in C.KINDS)}) LEFT JOIN t u ON u.s = c.s AND u.p = '{N.RDFS}subClassOf'"""))  # fmt: skip
def ssp_comprehensive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is said of the concepts, with optional facts that multiply and a collection two steps away."""
    return C.comprehensive(tpch.thesaurus(spark, sf_dir), tpch.THESAURUS)


@query(thesaurus_sql(f"""SELECT c.s AS concept, c.o AS type, d.o AS domain, r.o AS range FROM t c LEFT JOIN t d ON d.s = c.s AND d.p = '{N.RDFS}domain' LEFT JOIN t r ON r.s = c.s AND r.p = '{N.RDFS}range'
  WHERE c.p = '{TY}' AND c.o IN ('{C.BASIC}typ-vlastnosti', '{C.BASIC}typ-vztahu') AND starts_with(c.s, '{tpch.THESAURUS}')"""))  # fmt: skip
def ssp_domain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.domains_and_ranges(tpch.thesaurus(spark, sf_dir), tpch.THESAURUS)


@query(thesaurus_sql(f"""SELECT DISTINCT c.s AS concept, u.o AS restriction, p.o AS property, k.o AS class FROM t c JOIN t u ON u.s = c.s AND u.p = '{N.RDFS}subClassOf' JOIN t r ON r.s = u.o AND r.p = '{TY}' AND r.o = '{N.OWL}Restriction'
  JOIN t p ON p.s = u.o AND p.p = '{N.OWL}onProperty' JOIN t k ON k.s = u.o AND k.p = '{N.OWL}onClass' WHERE c.p = '{TY}' AND c.o = '{C.BASIC}typ-vztahu'"""))  # fmt: skip
def ssp_restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.restrictions(tpch.thesaurus(spark, sf_dir), tpch.THESAURUS)


_ALL_KINDS = ", ".join(f"'{prefix}{k}'" for prefix in (C.BASIC, C.BASIC + "pojem/") for k in C.KINDS)


@query(thesaurus_sql(f"""SELECT c.s AS child, x.o AS "childLabel", c.o AS parent, y.o AS "parentLabel", k.o AS "elementType" FROM t c JOIN t k ON k.s = c.s AND k.p = '{TY}' AND k.o IN ({_ALL_KINDS})
  LEFT JOIN t x ON x.s = c.s AND x.p = '{LAB}' LEFT JOIN t y ON y.s = c.o AND y.p = '{LAB}'
  WHERE c.p = '{N.RDFS}subClassOf' AND NOT starts_with(c.o, '_:') AND (EXISTS (SELECT 1 FROM t e WHERE e.s = c.o AND e.p = '{TY}' AND e.o = k.o) OR starts_with(c.o, '{C.BASIC}pojem/'))"""))  # fmt: skip
def ssp_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specialisations below a parent of the same kind or a basic concept, with labels where there are some."""
    return C.specializations(tpch.thesaurus(spark, sf_dir), tpch.THESAURUS)


@query(with_graph(f"SELECT a.o AS label, b.o AS description, c.o AS agenda FROM t a LEFT JOIN t b ON a.s = b.s AND b.p = '{DESC}' LEFT JOIN t c ON a.s = c.s AND c.p = '{AG}' WHERE a.p = '{LAB}' AND a.s = '{PARTS}1'"))
def ssp_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir).where(F.col("s") == PARTS + "1")
    return G.optional(G.optional(G.match(t, "s", LAB, "label"), G.match(t, "s", DESC, "description")), G.match(t, "s", AG, "agenda")).drop("s")


_SUGGESTED = f"""CASE WHEN {" OR ".join([f"contains(n, '{x}')" for x in C.RELATION_PARTS] + [f"ends_with(n, '{x}')" for x in C.RELATION_ENDS])} THEN 'typ-vztahu'
  WHEN {" OR ".join([f"starts_with(n, '{x}')" for x in C.PROPERTY_STARTS] + [f"contains(n, '{x}')" for x in C.PROPERTY_PARTS])} OR list_has_any(regexp_split_to_array(n, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), {C.PROPERTY_WORDS}) THEN 'typ-vlastnosti' ELSE 'typ-objektu' END"""


@query(thesaurus_sql(f"""SELECT DISTINCT l.s AS concept, coalesce(k.o, '{C.BASIC}pojem/' || {_SUGGESTED}) AS type
  FROM (SELECT s, nfc_normalize(lower(o)) AS n FROM t WHERE p = '{LAB}') l LEFT JOIN t k ON k.s = l.s AND k.p = '{TY}' AND k.o IN ({_ALL_KINDS})"""))  # fmt: skip
def ssp_heuristic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the concepts, and of those without one the kind that words and endings of the name suggest."""
    return C.concept_types(tpch.thesaurus(spark, sf_dir), tpch.THESAURUS)


@query(with_graph(f"SELECT s, CASE o WHEN '{O}{N.SUBJECT_TYPE}' THEN 'Subjekt práva' ELSE 'Objekt práva' END AS type, 'class' AS record FROM t WHERE p = '{TY}' AND o IN ('{O}{N.SUBJECT_TYPE}', '{O}{N.OBJECT_TYPE}')"))
def ssp_type_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record kind that a concept's type leads to."""
    k = F.col("kind")
    record = F.when(k == O + N.RELATION, "relationship").when(k == O + N.PROPERTY, "property").when(k.isin(O + N.SUBJECT_TYPE, O + N.OBJECT_TYPE), "class")
    x = G.match(tpch.triples(spark, sf_dir), "s", TY, "kind").withColumn("record", record).where("record is not null")
    return x.select("s", F.when(k == O + N.SUBJECT_TYPE, "Subjekt práva").otherwise("Objekt práva").alias("type"), "record")


# Look-ups and joins.


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def lookup_id_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return li.join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select("l_orderkey", "l_linenumber", "p_name")


@query(f"SELECT name, iri FROM (SELECT name, iri, row_number() OVER (PARTITION BY name ORDER BY kind DESC, iri DESC) AS n FROM (SELECT n_name AS name, '{tpch.BASE}nation-' || n_nationkey AS iri, 1 AS kind FROM nation UNION ALL SELECT p_brand, '{tpch.BASE}part-' || p_partkey, 0 FROM part)) WHERE n = 1")
def lookup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.concat(F.lit(PARTS), F.col("p_partkey").cast("string")).alias("iri"))
    return L.last_wins(parts, tpch.properties(spark, sf_dir).select("name", "iri"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, r_name AS domain, r_regionkey AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def lookup_property_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region").groupBy(F.col("r_name").alias("domain")).agg(F.max("r_regionkey").alias("region"))
    return tpch.properties(spark, sf_dir).join(r, "domain", "left").select("id", "name", "domain", "region")


@query("SELECT o_orderkey, first_line FROM orders JOIN (SELECT l_orderkey, min_by(l_shipdate::DATE::VARCHAR, row(l_linenumber, l_shipdate)) AS first_line FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def lookup_first_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the elements that extend another one, the first in the document's order."""
    first = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by(F.col("l_shipdate").cast("date").cast("string"), F.struct("l_linenumber", "l_shipdate")).alias("first_line"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(first, "o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def lookup_both_ends_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").where("p_size < 20"), read(spark, sf_dir, "supplier").where("s_acctbal > 0")
    kept = li.join(p, li.l_partkey == p.p_partkey, "left_semi").join(s, li.l_suppkey == s.s_suppkey, "left_semi")
    return kept.select("l_orderkey", "l_linenumber")


@query("SELECT x.name, coalesce(a.iri, b.iri, 'made-' || lower(x.name)) AS iri FROM (SELECT DISTINCT p_brand AS name FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region) x LEFT JOIN (SELECT n_name AS name, 'n-' || n_nationkey AS iri FROM nation) a USING (name) LEFT JOIN (SELECT r_name AS name, 'r-' || r_regionkey AS iri FROM region) b USING (name)")
def lookup_fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, p = (read(spark, sf_dir, x) for x in ("nation", "region", "part"))
    wanted = p.select(F.col("p_brand").alias("name")).union(n.select("n_name")).union(r.select("r_name")).distinct()
    a = n.select(F.col("n_name").alias("name"), F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("a"))
    b = r.select(F.col("r_name").alias("name"), F.concat(F.lit("r-"), F.col("r_regionkey").cast("string")).alias("b"))
    return wanted.join(a, "name", "left").join(b, "name", "left").select("name", F.coalesce("a", "b", F.concat(F.lit("made-"), F.lower("name"))).alias("iri"))


# Fixed order of patterns: the first that matches takes the tag.
TAG_PATTERNS = ["STEEL", "^SMALL", "TIN|COPPER", "ED$", "."]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_type, '{x}') THEN {i}" for i, x in enumerate(TAG_PATTERNS)) + " END AS place FROM part")
def lookup_regex_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tag with the first pattern of the ordered list that it matches; the list is a constant of the plan."""
    p = read(spark, sf_dir, "part")
    tests = F.array(*[F.when(F.col("p_type").rlike(x), i) for i, x in enumerate(TAG_PATTERNS)])
    return p.select("p_partkey", F.array_min(tests).alias("place"))


@query("SELECT p_type, min(CASE WHEN lower(p_type) = h THEN '0' || h WHEN contains(lower(p_type), h) THEN '1' || h END)[2:] AS header FROM (SELECT DISTINCT p_type FROM part), (VALUES ('steel'), ('brass'), ('tin'), ('anodized'), ('small')) v(h) GROUP BY p_type")
def lookup_header_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header's column: the same name first, then the first name in order that it contains."""
    x = F.lower("p_type")
    found = F.array(*[F.when(x == h, "0" + h).when(x.contains(h), "1" + h) for h in ("steel", "brass", "tin", "anodized", "small")])
    return read(spark, sf_dir, "part").select("p_type").distinct().withColumn("header", F.substring(F.array_min(found), 2, 100))


@query("SELECT n_name AS name, r_name AS domain FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN (SELECT p_name FROM part)")
def check_references_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.missing_references(tpch.properties(spark, sf_dir), tpch.classes(spark, sf_dir)).select("name", "domain")


@query("""WITH RECURSIVE e AS (SELECT c_name AS child, n_name AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
  up AS (SELECT child, parent FROM e UNION SELECT up.child, e.parent FROM up JOIN e ON up.parent = e.child) SELECT child, parent FROM up""")
def hier_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.closure(tpch.hierarchies(spark, sf_dir), "subClass", "superClass")


@query("SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN n_nationkey % 3 = 0 THEN n_name ELSE r_name END AS domain FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def hier_domain_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the customers and a third of the nations have a domain of their own, the regions are theirs."""
    c, n, r = (read(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    props = G.union_bag(
        c.select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("domain")),
        n.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("domain")),
        r.select(F.col("r_name").alias("name"), F.col("r_name").alias("domain")),
    )
    return G.where_exists(H.inherited_domains(props, tpch.hierarchies(spark, sf_dir)), c.select(F.col("c_name").alias("name")))


@query("SELECT 'n' || n_nationkey AS node FROM nation WHERE n_nationkey < 5")
def hier_cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a ring of five; the others hang on the ring."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    name = lambda x: F.concat(F.lit("n"), x.cast("string"))
    return H.in_cycles(n.select(name(k).alias("child"), F.when(k < 5, name((k + 1) % 5)).otherwise(name(k % 5)).alias("parent")))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def limit_first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.min_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")).select("event_type", "x.*")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def window_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return read(spark, sf_dir, "events").withColumn("n", F.row_number().over(order)).where("n <= 3").select("event_type", "event_id")


@query(with_graph("SELECT s, p, o FROM (SELECT DISTINCT s, p, o FROM t) ORDER BY s, p, o LIMIT 50"))
def limit_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped exploratory listing: its first fifty rows in order."""
    return G.graph(tpch.triples(spark, sf_dir)).select("s", "p", "o").orderBy("s", "p", "o").limit(50)


HEADS = {"ARCHI_XML": '<?xml version="1.0"?><model xmlns="http://www.opengroup.org/xsd/archimate/3.0/">', "XMI": '<?xml version="1.0"?><xmi:XMI>', "TURTLE": "@prefix e: <http://e/> .", "XLSX": "PK", "HTML": "", "UNSUPPORTED": '<?xml version="1.0"?><other/>'}
_KINDS = list(HEADS)


@query("SELECT page_id, url, CASE WHEN octet_length(encode(html)) > 5242880 THEN 'TOO LARGE' ELSE (CASE page_id % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END) END AS format FROM pages")
def ingest_sniff_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format of each page, sent as a file of one of the formats by turns; one over the size limit is refused."""
    from lexigraph.sources.formats import MAX_BYTES, sniff

    turn = (F.col("page_id") % 6).cast("int")
    name = F.concat(F.lit("file-"), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit({"XLSX": ".xlsx", "TURTLE": ".ttl"}.get(k, "")) for k in _KINDS]), turn + 1))
    text = F.when(turn == _KINDS.index("HTML"), F.col("html")).otherwise(F.element_at(F.array(*[F.lit(v) for v in HEADS.values()]), turn + 1))
    return read(spark, sf_dir, "pages").select("page_id", "url", F.when(F.octet_length("html") > MAX_BYTES, "TOO LARGE").otherwise(sniff(name, F.lit(None).cast("string"), text)).alias("format"))


@query(with_graph("SELECT iri, name FROM c WHERE trim(coalesce(description, '')) <> '' AND NOT (agendaCode IS NOT NULL)"))
def filter_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.valid_rows(tpch.classes(spark, sf_dir), "name", "description").where(T.blank(F.col("agendaCode"))).select("iri", "name")
