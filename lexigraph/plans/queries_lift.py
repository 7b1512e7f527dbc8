"""Queries on the way from records to triples, on filters, and on the published form of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.functions import terms as T
from lexigraph.operators import graph as G
from lexigraph.plans import lift as L
from lexigraph.plans import tpch
from lexigraph.plans.registry import query
from lexigraph.plans.tpch import read, with_graph
from lexigraph.plans.written import NAMED, turtle_round_trip

TY, O, D = N.TYPE, N.OFN, N.DEFAULT_NS
LAB, DESC = N.SKOS + "prefLabel", N.DCT + "description"
SPO = ["s", "p", "o"]
CASE_TYPE = "CASE n_nationkey % 9 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(N.DATA_TYPES.values())) + " END"


@query(with_graph("SELECT s, p, o, o_kind, o_dt, o_lang FROM t WHERE s_kind = 'iri'"))
def lift_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpch.triples(spark, sf_dir).where("s_kind = 'iri'").select("s", "p", "o", "o_kind", "o_dt", "o_lang")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region")
    return r.select(F.col("r_name").alias("name"), F.concat(F.lit(tpch.BASE + "region-"), F.col("r_regionkey").cast("string")).alias("iri"))


@query(f"""WITH n AS (SELECT '{tpch.BASE}nation-' || n_nationkey AS s, n_name, '{tpch.BASE}region-' || r_regionkey AS dom, {CASE_TYPE} AS rng, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT s, '{N.RDFS}range' AS p, rng AS o FROM n UNION ALL SELECT s, '{N.RDFS}domain', dom FROM n UNION ALL SELECT s, '{LAB}', n_name FROM n
  UNION ALL SELECT s, '{D}{N.PPDF}', CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END FROM n
  UNION ALL SELECT s, '{TY}', unnest(['{O}{N.CONCEPT}', '{O}{N.PROPERTY}', '{N.OWL}DatatypeProperty']) FROM n""")
def lift_properties_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.property_triples(tpch.properties(spark, sf_dir), _regions(spark, sf_dir)).select(*SPO)


@query(f"""WITH x AS (SELECT '{tpch.BASE}line-' || l_orderkey || '-' || l_linenumber AS s, '{tpch.BASE}customer-' || o_custkey AS d, '{tpch.BASE}part-' || l_partkey AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
  k AS (SELECT p_name AS name, max('{tpch.BASE}part-' || p_partkey) AS iri FROM part GROUP BY p_name),
  q AS (SELECT x.s, x.d, k.iri AS r FROM x JOIN part ON x.r = '{tpch.BASE}part-' || p_partkey JOIN k ON k.name = p_name)
  SELECT s, '{N.RDFS}domain' AS p, d AS o FROM q UNION ALL SELECT s, '{N.RDFS}range', r FROM q""")
def lift_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines' domains and ranges, resolved by the customers' and parts' names."""
    lookup = L.last_wins(tpch.classes(spark, sf_dir))
    rows = L.relationship_triples(tpch.relationships(spark, sf_dir), lookup)
    return rows.where(F.col("p").isin(N.RDFS + "domain", N.RDFS + "range")).select(*SPO)


@query(f"""WITH e AS (SELECT '{tpch.BASE}customer-' || c_custkey AS s, '{tpch.BASE}nation-' || n_nationkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT s, '{N.RDFS}subClassOf' AS p, o FROM e UNION ALL SELECT s, '{D}nadřazená-třída', o FROM e""")
def lift_hierarchy_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = L.last_wins(tpch.classes(spark, sf_dir), tpch.properties(spark, sf_dir))
    return L.hierarchy_triples(tpch.hierarchies(spark, sf_dir), lookup).select(*SPO)


@query(with_graph("SELECT iri, kind FROM k WHERE kind IS NOT NULL"))
def lift_publicity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = T.public_kind(F.col("isPublic"), F.col("privacyProvision"))
    return tpch.classes(spark, sf_dir).select("iri", kind.alias("kind")).where("kind is not null")


@query(with_graph(f"SELECT s, p, o FROM t WHERE p IN ('{D}{N.AGENDA}', '{D}{N.AIS}', '{D}{N.PPDF}')"))
def lift_agenda_ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpch.triples(spark, sf_dir).where(F.col("p").isin(D + N.AGENDA, D + N.AIS, D + N.PPDF)).select(*SPO)


@query(f"""WITH c AS (SELECT 'part-' || p_partkey AS s, unnest(['x ' || p_brand, 'https://a.example/' || p_partkey, 'https://b.example/eli/cz/sb/' || p_size]) AS v FROM part)
  SELECT s, CASE WHEN contains(v, '/eli/cz/') THEN '{D}{N.DEFINING_LAW}' ELSE '{D}{N.DEFINING_OTHER}' END AS p,
         CASE WHEN contains(v, '/eli/cz/') THEN '{N.ELI_BASE}eli/cz/sb/' || regexp_extract(v, '([0-9]+)$', 1) ELSE '_:' || sha256(s || '|{N.DEFINING_OTHER}|' || v) END AS o FROM c
  UNION ALL SELECT '_:' || sha256(s || '|{N.DEFINING_OTHER}|' || v), '{TY}', '{N.DIGITAL_OBJECT}' FROM c WHERE NOT contains(v, '/eli/cz/')
  UNION ALL SELECT '_:' || sha256(s || '|{N.DEFINING_OTHER}|' || v), CASE WHEN v LIKE 'https%' THEN '{N.SCHEMA_URL}' ELSE '{N.DCT}title' END, v FROM c WHERE NOT contains(v, '/eli/cz/')""")
def lift_sources_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    p = read(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), k).alias("iri"), F.concat(F.lit("x "), "p_brand", F.lit("; https://a.example/"), k, F.lit(";;https://b.example/eli\\cz/sb/"), F.col("p_size").cast("string")).alias("source")
    )
    return L.source_triples(p, F.col("iri"), "source", N.DEFINING_LAW, N.DEFINING_OTHER).select(*SPO)


@query("SELECT 'part-' || p_partkey AS s, 'https://e.example/' || p_brand AS o FROM part WHERE NOT contains(p_brand, ' ') UNION ALL SELECT 'part-' || p_partkey, 'urn:x:' || p_size FROM part")
def lift_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("part-"), k).alias("iri"), F.concat(F.lit("https://e.example/"), "p_brand", F.lit("; n/a;urn:x:"), F.col("p_size").cast("string"), F.lit(";no iri")).alias("e"))
    return L.listed(p, F.col("iri"), N.SKOS + "exactMatch", F.filter(T.split_list(F.col("e")), T.is_iri), L.IRI).select("s", "o")


@query("SELECT 'part-' || p_partkey AS s, unnest(string_split(p_type, ' ')) AS o FROM part")
def lift_alt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("iri"), F.replace("p_type", F.lit(" "), F.lit(" ; ")).alias("names"))
    return L.listed(p, F.col("iri"), N.SKOS + "altLabel", T.split_list(F.col("names")), lang="cs").select("s", "o")


FIELDS = ["description", "source", "isPublic", "privacyProvision", "agendaCode", "agendaSystemCode", "sharedInPPDF", "definition", "alternativeName"]


@query(with_graph("SELECT field FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS n FROM c" for f in FIELDS[:7]) + ") WHERE n > 0"))
def lift_required_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.used_fields(tpch.classes(spark, sf_dir), *FIELDS)


@query(with_graph("SELECT bool_or(type = 'Subjekt práva') AS subject, bool_or(type = 'Objekt práva') AS object, bool_or(isPublic IN ('ano', 'true')) AS public, bool_or(isPublic = 'ne' OR privacyProvision IS NOT NULL) AS closed FROM c"))
def lift_required_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.used_kinds(tpch.classes(spark, sf_dir))


@query(with_graph("SELECT name, 'class' AS kind, description FROM c UNION ALL SELECT n_name, 'property', NULL FROM nation UNION ALL SELECT o_orderpriority, 'relationship', NULL FROM orders JOIN lineitem ON o_orderkey = l_orderkey"))
def lift_metadata_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.described_records(**{"class": tpch.classes(spark, sf_dir), "property": tpch.properties(spark, sf_dir), "relationship": tpch.relationships(spark, sf_dir)})


@query(f"""WITH v AS (SELECT 'e-' || event_id AS s, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS m FROM events),
  n AS (SELECT s, 'okamžik-vytvoření' AS p, d AS v FROM v UNION ALL SELECT s, 'okamžik-poslední-změny', m FROM v),
  i AS (SELECT s, p, v, s || '/časový-okamžik/' || substr(sha256(p || '|' || v), 1, 16) AS node FROM n)
  SELECT s, '{D}' || p AS p, node AS o FROM i UNION ALL SELECT node, '{TY}', '{N.TIME_NS}časový-okamžik' FROM i
  UNION ALL SELECT node, '{N.TIME_NS}' || CASE WHEN contains(v, 'T') THEN 'datum-a-čas' ELSE 'datum' END, v FROM i""")
def lift_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(
        F.concat(F.lit("e-"), F.col("event_id").cast("string")).alias("iri"), F.date_format("ts", "yyyy-MM-dd").alias("dateOfCreation"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("dateOfModification")
    )
    return L.temporal_triples(e, F.col("iri")).select(*SPO)


GOV = N.GOVERNANCE["sharingMethod"]


@query(f"SELECT 'c-' || c_custkey AS s, '{GOV[0]}' AS p, '{GOV[1]}' || CASE c_nationkey % 3 WHEN 0 THEN 'nesdílené' ELSE 'poskytované-na-žádost' END AS o FROM customer WHERE c_nationkey % 3 < 2")
def lift_governance_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey") % 3
    none = F.lit(None).cast("string")
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("iri"), F.when(n == 0, "Nesdílené").when(n == 1, "poskytované na žádost").otherwise(" vlastní ").alias("sharingMethod"), none.alias("acquisitionMethod"), none.alias("contentType"))
    return L.told(c, F.col("iri"), *L.governance_facts()).select(*SPO)


@query(with_graph(f"SELECT o AS s, '{N.OWL}Class' AS o FROM (SELECT DISTINCT o FROM t WHERE p = '{TY}' AND o IN ({', '.join(repr(x) for x in L.BASE_TERMS)})) UNION ALL SELECT DISTINCT p, CASE o_kind WHEN 'literal' THEN '{N.OWL}DatatypeProperty' ELSE '{N.OWL}ObjectProperty' END FROM t WHERE starts_with(p, '{D}')"))
def lift_base_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of the profile's classes and predicates that the graph uses."""
    return L.base_schema(tpch.triples(spark, sf_dir)).select("s", "o")


# Filters.


@query(with_graph("SELECT iri, name FROM c WHERE NOT regexp_full_match(iri, '.*/part-[0-9]*7')"))
def filter_concepts_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tpch.classes(spark, sf_dir)
    lookup = c.groupBy("name").agg(F.max("identifier").alias("identifier"))
    return L.without_filtered(c, lookup, ".*/part-[0-9]*7").select("iri", "name")


@query(f"""WITH k AS (SELECT n_name AS name, CASE WHEN regexp_full_match('{tpch.BASE}nation-' || n_nationkey, '.*-1[0-9]') THEN 1 ELSE 0 END AS bad, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT name, CASE WHEN r_name <> 'ASIA' THEN r_name END AS domain FROM k WHERE bad = 0""")
def filter_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tpch.properties(spark, sf_dir)
    lookup = read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.when(F.col("r_name") == "ASIA", "x-12").otherwise("x-2").alias("identifier"))
    return L.without_filtered(p, lookup, ".*-1[0-9]", softened=("domain",)).select("name", "domain")


@query(f"""WITH k AS (SELECT regexp_full_match('{tpch.BASE}nation-' || n_nationkey, '.*-1[0-9]') AS own, r_name = 'ASIA' AS a, r_name = 'AFRICA' AS b, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT 'identifier' AS reason, count(*) FILTER (own) AS n FROM k UNION ALL SELECT 'domain', count(*) FILTER (NOT own AND a) FROM k UNION ALL SELECT 'superProperty', count(*) FILTER (NOT own AND NOT a AND n_name LIKE '%A') FROM k""")
def filter_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many properties a filter drops, by reason, and how many references it empties."""
    p = tpch.properties(spark, sf_dir).withColumn("superProperty", F.when(F.col("name").endswith("A"), "x-19"))
    lookup = read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.when(F.col("r_name") == "ASIA", "x-12").otherwise("x-2").alias("identifier"))
    return L.filter_counts(p, lookup, ".*-1[0-9]", references=("domain",), softened=("superProperty",))


@query("SELECT CASE WHEN p_type LIKE '%BRASS' THEN 'VALID' WHEN p_type LIKE '%TIN' THEN 'EMPTY_TYPE' ELSE 'INVALID_TYPE' END AS status, count(*) AS n FROM part GROUP BY ALL")
def filter_class_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("p_type").endswith("BRASS"), "Objekt práva").when(F.col("p_type").endswith("TIN"), " ").otherwise(F.col("p_type"))
    return read(spark, sf_dir, "part").select(L.type_status(t).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


RENAMED = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.PUBLISHED.items()) + " ELSE p END"


@query(with_graph(f"SELECT s, {RENAMED} AS p, o, o_lang FROM t WHERE s_kind = 'bnode' OR starts_with(s, '{tpch.BASE}part-')"))
def filter_namespace_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.export_triples(tpch.triples(spark, sf_dir), tpch.BASE + "part-").select("s", "p", "o", "o_lang")


@query("SELECT record, id, field FROM (SELECT 'order' AS record, o_orderkey AS id, 'name' AS field FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 = 0 UNION ALL SELECT 'part', p_partkey, 'type' FROM part WHERE p_size % 3 = 0)")
def filter_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that lack a field they must have, as rows instead of an abort."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 5 == 0), " ").otherwise("x").alias("name"))
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("type"))
    return L.lacking(o, "order", "o_orderkey", "name").unionByName(L.lacking(p, "part", "p_partkey", "name", "type"))


@query("SELECT c_name AS \"subClass\", n_name AS \"superClass\" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 > 1")
def filter_hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to a blank parent, to itself or to an address are dropped."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    k = F.col("c_custkey") % 4
    h = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("subClass"), F.when(k == 0, F.col("c_name")).when(k == 1, "https://x.example/y").otherwise(F.col("n_name")).alias("superClass"))
    return L.sound_edges(h)


@query(with_graph(f"SELECT DISTINCT o AS term, o IN ({', '.join(map(repr, L.BASE_TERMS))}) AS base FROM t WHERE p = '{TY}'"))
def filter_base_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpch.triples(spark, sf_dir).where(F.col("p") == TY).select(F.col("o").alias("term")).distinct().withColumn("base", F.col("term").isin(*L.BASE_TERMS))


@query("SELECT c_custkey, c_nationkey % 3 < 2 AS allowed FROM customer")
def filter_governance_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey") % 3
    v = F.when(n == 0, "Nesdílené").when(n == 1, "VLASTNÍ").otherwise(" vlastní")
    return read(spark, sf_dir, "customer").select("c_custkey", F.lower(v).isin(*N.GOVERNANCE_VALUES).alias("allowed"))


@query(with_graph("SELECT iri, CASE WHEN isPublic IN ('ano', 'true') AND privacyProvision IS NOT NULL THEN 'public with provision' WHEN isPublic = 'ne' AND privacyProvision IS NULL THEN 'non-public without provision' END AS conflict FROM c WHERE (isPublic IN ('ano', 'true') AND privacyProvision IS NOT NULL) OR (isPublic = 'ne' AND privacyProvision IS NULL)"))
def filter_publicity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.publicity_conflicts(tpch.classes(spark, sf_dir)).select("iri", "conflict")


# The published form.


@query(with_graph(f"SELECT DISTINCT {RENAMED} AS p FROM t"))
def export_predicate_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.export_triples(tpch.triples(spark, sf_dir), tpch.BASE).select("p").distinct()


@query("SELECT source AS s, string_agg(lang || '=' || v, ',' ORDER BY lang) AS labels FROM (SELECT source, lang, max(doc_id::VARCHAR) AS v FROM documents GROUP BY source, lang) GROUP BY source")
def export_lang_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("s"), F.lit(LAB).alias("p"), F.col("doc_id").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.col("lang").alias("o_lang"))
    labels = F.transform(F.array_sort(F.map_entries("labels")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return G.language_map(d, LAB).select("s", F.array_join(labels, ",").alias("labels"))


LABEL_CASE = "CASE o " + " ".join(f"WHEN '{O}{k}' THEN '{v}'" for k, v in N.TYPE_LABELS.items()) + " END"
ORDER_CASE = "CASE o " + " ".join(f"WHEN '{O}{k}' THEN {i}" for i, k in enumerate(N.TYPE_LABELS)) + " END"


@query(with_graph(f"SELECT s, string_agg({LABEL_CASE}, '|' ORDER BY {ORDER_CASE}) AS types FROM t WHERE p = '{TY}' AND {LABEL_CASE} IS NOT NULL GROUP BY s"))
def export_type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigraph.sinks.documents import type_labels

    return type_labels(tpch.triples(spark, sf_dir)).select("s", F.array_join("types", "|").alias("types"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '{\"a\":\"' || c_mktsegment || '\"}' WHEN c_custkey % 3 = 1 THEN '{\"a\":\"' || c_mktsegment || '\",\"list\":[\"x\"]}' ELSE '{\"list\":[\"x\"]}' END AS doc FROM customer")
def export_prune_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigraph.sinks.documents import pruned

    k = F.col("c_custkey") % 3
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(k != 2, F.col("c_mktsegment")).otherwise("").alias("a"), F.when(k == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("x"), F.lit(""), F.lit(None))).alias("list"))
    return c.select("c_custkey", F.to_json(pruned(c, "a", "list")).alias("doc"))


@query(with_graph(f"SELECT s, string_agg(o, '|' ORDER BY o) AS vals FROM t WHERE p IN ('{TY}', '{LAB}') AND trim(o) <> '' GROUP BY s"))
def export_value_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir).where(F.col("p").isin(TY, LAB) & ~T.blank(F.col("o")))
    return t.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("o")), "|").alias("vals"))


@query(with_graph(f"SELECT s, coalesce(o_lang, 'cs') AS lang, max(o) AS label FROM t WHERE p = '{LAB}' GROUP BY ALL"))
def export_label_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.language_map(tpch.triples(spark, sf_dir), LAB)
    return m.select("s", F.explode("labels").alias("lang", "label"))


@query(with_graph(f"SELECT DISTINCT s, '{N.SKOS}inScheme' AS p, 'https://v' AS o FROM t WHERE p = '{TY}' AND o = '{O}{N.CONCEPT}' AND s NOT IN (SELECT s FROM t WHERE p = '{TY}' AND o = '{O}{N.OBJECT_TYPE}')"))
def export_inscheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts into the scheme, without those of one type."""
    return L.in_scheme(tpch.triples(spark, sf_dir), "https://v", O + N.OBJECT_TYPE).select(*SPO)


@query(f"""SELECT 'https://v/' || c_custkey AS s, unnest(['{TY}', '{TY}', '{LAB}', '{DESC}']) AS p, unnest(['{N.SKOS}ConceptScheme', '{O}slovník', c_name, c_mktsegment]) AS o FROM customer""")
def export_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary a customer as concept scheme."""
    from lexigraph.sinks.documents import scheme_triples

    v = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))
    return scheme_triples(v, F.concat(F.lit("https://v/"), F.col("c_custkey").cast("string"))).select(*SPO)


@query(with_graph(f"SELECT s AS iri, max(o) FILTER (p = '{LAB}') AS nazev, max(o) FILTER (p = '{DESC}') AS popis FROM t WHERE s IN (SELECT s FROM t WHERE p = '{TY}' AND o = '{O}{N.CONCEPT}') GROUP BY s"))
def export_concept_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the concepts' objects in the JSON document, read back from it."""
    from lexigraph.sinks.documents import concept_objects

    x = concept_objects(tpch.triples(spark, sf_dir))
    return x.select("iri", F.get_json_object("object", "$['název']['cs']").alias("nazev"), F.get_json_object("object", "$['popis']['cs']").alias("popis"))


@query(with_graph(f"SELECT count(*) AS concepts FROM t WHERE p = '{TY}' AND o = '{O}{N.CONCEPT}'"))
def export_field_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose fields stand in the fixed order: iri, typ, název, then the others."""
    from lexigraph.sinks.documents import concept_objects

    return concept_objects(tpch.triples(spark, sf_dir)).where(F.col("object").rlike(r'^\{"iri":.*"typ":\[.*\],"název":')).agg(F.count("*").alias("concepts"))


_ONE = " UNION ALL ".join(f"SELECT s, '{field}', o FROM t WHERE p = '{D}{path}'" for field, path in (("agenda", N.AGENDA), ("agendový-informační-systém", N.AIS), ("je-sdílen-v-ppdf", N.PPDF)))
_TEXTS = " UNION ALL ".join(f"""SELECT s, '{field}', '{{"cs":"' || o || '"}}' FROM t WHERE p = '{path}'""" for field, path in (("název", LAB), ("popis", DESC)))


@query(with_graph(f"""SELECT s AS iri, 'iri' AS field, s AS value FROM (SELECT DISTINCT s FROM t WHERE p = '{TY}' AND o = '{O}{N.CONCEPT}')
  UNION ALL SELECT s, 'typ', '["' || string_agg({LABEL_CASE}, '","' ORDER BY {ORDER_CASE}) || '"]' FROM t WHERE p = '{TY}' AND {LABEL_CASE} IS NOT NULL GROUP BY s
  UNION ALL {_TEXTS} UNION ALL {_ONE} UNION ALL SELECT s, 'ustanovení-dokládající-neveřejnost-údaje', '["' || o || '"]' FROM t WHERE p = '{D}{N.PROVISION}'
  UNION ALL SELECT x.s, 'definující-nelegislativní-zdroj', '[{{"typ":"Digitální objekt","název":{{"cs":"' || y.o || '"}}}}]' FROM t x JOIN t y ON x.o = y.s AND y.p = '{N.DCT}title' WHERE x.p = '{D}{N.DEFINING_OTHER}'"""))  # fmt: skip
def export_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts' objects of the JSON document, taken apart into their fields."""
    from lexigraph.sinks.documents import concept_objects

    return concept_objects(tpch.triples(spark, sf_dir)).select("iri", F.explode(F.from_json("object", "map<string,string>")).alias("field", "value"))


@query(with_graph(f"also u AS (SELECT s, s_kind, {RENAMED} AS p, o, o_kind, o_dt, o_lang FROM t), " + NAMED[4:].replace("FROM t", "FROM u")))
def export_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published form written as Turtle and read again."""
    return turtle_round_trip(L.export_triples(tpch.triples(spark, sf_dir), tpch.BASE))


@query("""SELECT c_name AS name, 'https://v/' || c_custkey AS iri, 'Datová sada' AS typ, c_name AS title_en, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Slovník ' || c_name END AS text_cs, 'https://v/' || c_custkey AS access,
  'https://www.iana.org/assignments/media-types/application/ld+json' AS media FROM customer""")
def export_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a catalogue record a customer, read back from its JSON."""
    from lexigraph.sinks.documents import catalog_record

    k = F.col("c_custkey")
    v = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("description"), F.concat(F.lit("https://v/"), k.cast("string")).alias("namespace"))
    paths = {"iri": "$.iri", "typ": "$.typ", "title_en": "$['název'].en", "text_cs": "$['popis'].cs", "access": "$.distribuce[0]['přístupové_url']", "media": "$.distribuce[0]['typ_média']"}
    return catalog_record(v).select("name", *[F.get_json_object("record", p).alias(c) for c, p in paths.items()])


@query("SELECT r_name AS name, r_name AS title_cs, CASE WHEN r_regionkey % 2 = 0 THEN 'Popis ' || r_name ELSE 'Slovník ' || r_name END AS description_cs FROM region")
def catalog_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigraph.sinks.documents import catalog_record

    v = read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("Popis "), "r_name")).alias("description"), F.concat(F.lit("https://x.example/"), "r_name").alias("namespace"))
    c = catalog_record(v)
    return c.select("name", F.get_json_object("record", "$['název'].cs").alias("title_cs"), F.get_json_object("record", "$['popis'].cs").alias("description_cs"))
