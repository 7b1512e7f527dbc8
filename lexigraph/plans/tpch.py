"""The driver's tables as record sets and as one graph, so that every operator has something to run on at any scale."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.operators import graph as G
from lexigraph.plans import lift as L
from lexigraph.schema import CLASSES, HIERARCHIES, PROPERTIES, RELATIONSHIPS

BASE = "https://data.example.org/tpch/pojem/"


def nothing() -> Column:
    return F.lit(None).cast("string")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Records a task turns into triples; a triple takes many times the room of what the tables hold for it.
TASK_RECORDS = 50_000


def tasks(df: DataFrame, rows: int = TASK_RECORDS) -> int:
    """How many tasks give each about ``rows`` rows."""
    return max(1, math.ceil(df.count() / rows))


def dealt(df: DataFrame, rows: int = TASK_RECORDS) -> DataFrame:
    """``df`` over as many tasks as give each about ``rows`` rows, however few files the rows come from."""
    parts = tasks(df, rows)
    return df if parts == 1 else df.repartition(parts)


def _filled(df: DataFrame, schema, **columns) -> DataFrame:
    return df.select(*[columns.get(f.name, nothing()).cast("string").alias(f.name) for f in schema], columns["iri"].alias("iri"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    text = k.cast("string")
    parts = _filled(
        read(spark, sf_dir, "part"), CLASSES, iri=F.concat(F.lit(BASE + "part-"), text), id=F.concat(F.lit("part-"), text), name=F.col("p_name"), type=F.lit("Objekt práva"),
        identifier=F.concat(F.lit(BASE + "part-"), text), description=F.when(size % 3 != 0, F.col("p_type")), source=F.when(size % 5 == 0, F.col("p_brand")),
        isPublic=F.when(size % 4 == 0, "ano").when(size % 4 == 1, "ne").when(size % 4 == 2, "true"), privacyProvision=F.when(size % 7 == 0, F.concat(F.lit("https://x.example/eli/cz/sb/"), text)),
    )

    def people(table: str, c: str) -> DataFrame:
        key, text = F.col(f"{c}_{'custkey' if c == 'c' else 'suppkey'}"), F.col(f"{c}_{'custkey' if c == 'c' else 'suppkey'}").cast("string")
        return _filled(
            read(spark, sf_dir, table), CLASSES, iri=F.concat(F.lit(BASE + table + "-"), text), id=F.concat(F.lit(table + "-"), text), name=F.col(f"{c}_name"), type=F.lit("Subjekt práva"),
            identifier=F.concat(F.lit(BASE + table + "-"), text), agendaCode=F.when(key % 2 == 0, F.col(f"{c}_nationkey").cast("string")), agendaSystemCode=F.when(key % 3 == 0, text),
            sharedInPPDF=F.when(F.col(f"{c}_acctbal") > 0, "ano").otherwise("ne"),
        )

    return G.union_bag(parts, people("supplier", "s"), people("customer", "c"))


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*map(F.lit, N.DATA_TYPES))
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return _filled(
        n.join(r, n.n_regionkey == r.r_regionkey), PROPERTIES, iri=F.concat(F.lit(BASE + "nation-"), key.cast("string")), id=key, name=F.col("n_name"), domain=F.col("r_name"),
        identifier=F.concat(F.lit(BASE + "nation-"), key.cast("string")), dataType=F.element_at(labels, (key % len(N.DATA_TYPES) + 1).cast("int")), sharedInPPDF=F.when(key % 2 == 0, "ano").otherwise("ne"),
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order and each of its lines: the customer's name relates to the part's name."""
    o, li, c, p = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "part"))
    orders = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderpriority", "c_name")
    rows = li.join(p, li.l_partkey == p.p_partkey).join(orders, li.l_orderkey == orders.o_orderkey)  # the lines, by far the most, are moved once a key
    ident = F.concat(F.lit(BASE + "line-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return _filled(rows, RELATIONSHIPS, iri=ident, identifier=ident, domain=F.col("c_name"), name=F.col("o_orderpriority"), range=F.col("p_name"), sharedInPPDF=F.when(F.col("l_returnflag") == "A", "ano"))


def hierarchies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    low = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("subClass"), F.col("n_name").alias("superClass"))
    high = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("subClass"), F.col("r_name").alias("superClass"))
    both = low.union(high)
    return both.select(*[F.col(f.name) if f.name in both.columns else nothing().alias(f.name) for f in HIERARCHIES])


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph of the class records, with the subjects' PPDF flags as asserted triples."""
    flag = F.when(F.col("sharedInPPDF") == "ano", "true").when(F.col("sharedInPPDF") == "ne", "false")
    return L.class_triples(dealt(classes(spark, sf_dir)), graph_id="tpch", more=[L.fact(N.DEFAULT_NS + N.PPDF, flag, L.LITERAL, N.XSD + "boolean")])


THESAURUS = "https://slovník.gov.cz/data/pojem/"
#: Names of every kind, by turns.
NAME_WORDS = ["kód ", "má ", "jed", "Název vozu ", "vozidlo ", "číslo-", "Vykonává ", "hodnoty ", "x", "čí", "datum", "Kódy "]


def thesaurus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as concepts of a thesaurus a nation: labels, notes, kinds, links, restrictions and collections, each for some of them."""
    k = F.col("s_suppkey")
    node = lambda n: F.concat(F.lit(THESAURUS + "s-"), n.cast("string"))
    scheme, basic = F.concat(F.lit("https://t/"), F.col("s_nationkey").cast("string")), "https://slovník.gov.cz/základní/"
    restriction = F.concat(F.lit("_:b"), k.cast("string"))
    text = lambda prefix, test: F.when(test, F.concat(F.lit(prefix), k.cast("string")))
    name = F.concat(F.element_at(F.array(*map(F.lit, NAME_WORDS)), (k % len(NAME_WORDS) + 1).cast("int")), F.when(k % 2 == 0, F.col("s_nationkey").cast("string")).otherwise(""))
    facts = [
        L.fact(N.TYPE, F.lit(N.SKOS + "Concept"), L.IRI), L.fact(N.SKOS + "inScheme", scheme, L.IRI), L.fact(N.SKOS + "prefLabel", F.when(k % 7 != 0, name)), L.fact(N.SKOS + "definition", text("def ", k % 3 == 0)),
        L.fact(N.SKOS + "altLabel", text("alt ", k % 5 == 0)), L.fact(N.SKOS + "altLabel", text("other ", k % 5 == 0)), L.fact(N.DCT + "source", text("src ", k % 4 == 1)), L.fact(N.SKOS + "scopeNote", text("note ", k % 6 == 0)),
        L.fact(N.SKOS + "broader", F.when(k % 8 == 1, node(k + 1)), L.IRI), L.fact(N.SKOS + "narrower", F.when(k % 9 == 0, node(k + 2)), L.IRI), L.fact(N.SKOS + "related", F.when(k % 8 == 0, node(k + 1)), L.IRI),
        L.fact(N.TYPE, F.when(k % 4 == 0, basic + "typ-objektu").when(k % 4 == 1, basic + "typ-vlastnosti").when(k % 4 == 2, basic + "pojem/typ-vztahu").when(k % 8 == 3, basic + "typ-vztahu"), L.IRI),
        L.fact(N.RDFS + "subClassOf", F.when(k % 8 == 0, node(k - 4)).when(k % 8 == 4, basic + "pojem/objekt").when(k % 8 == 1, node(k + 1)), L.IRI), L.fact(N.RDFS + "subClassOf", F.when(k % 8 == 3, restriction), L.BNODE),
        L.fact(N.RDFS + "domain", F.when(k % 4 == 1, node(k % 10)), L.IRI), L.fact(N.RDFS + "range", F.when(k % 8 == 1, node(k % 3)), L.IRI),
        *[L.fact(p, F.when(k % 8 == 3, o), L.IRI, s=restriction) for p, o in ((N.TYPE, F.lit(N.OWL + "Restriction")), (N.OWL + "onProperty", node(k % 5)), (N.OWL + "onClass", node(k % 6)))],
        L.fact(N.SKOS + "member", F.when(k % 2 == 0, node(k)), L.IRI, s=F.concat(F.lit("https://c/"), F.col("s_nationkey").cast("string"))),
    ]
    parts = L.told(read(spark, sf_dir, "nation"), F.concat(F.lit("https://t/"), F.col("n_nationkey").cast("string")), L.fact(N.DCT + "hasPart", F.concat(F.lit("https://c/"), F.col("n_nationkey").cast("string")), L.IRI))
    return L.told(read(spark, sf_dir, "supplier"), node(k), *facts).unionByName(parts)


def _thesaurus_sql() -> str:
    basic, node = "https://slovník.gov.cz/základní/", lambda n: f"'{THESAURUS}s-' || ({n})"
    words = "[" + ", ".join(f"'{w}'" for w in NAME_WORDS) + "]"
    facts = [
        ("TRUE", None, N.TYPE, f"'{N.SKOS}Concept'"), ("TRUE", None, N.SKOS + "inScheme", "'https://t/' || n"), ("k % 7 <> 0", None, N.SKOS + "prefLabel", f"{words}[k % {len(NAME_WORDS)} + 1] || CASE WHEN k % 2 = 0 THEN n::VARCHAR ELSE '' END"),
        ("k % 3 = 0", None, N.SKOS + "definition", "'def ' || k"), ("k % 5 = 0", None, N.SKOS + "altLabel", "'alt ' || k"), ("k % 5 = 0", None, N.SKOS + "altLabel", "'other ' || k"), ("k % 4 = 1", None, N.DCT + "source", "'src ' || k"),
        ("k % 6 = 0", None, N.SKOS + "scopeNote", "'note ' || k"), ("k % 8 = 1", None, N.SKOS + "broader", node("k + 1")), ("k % 9 = 0", None, N.SKOS + "narrower", node("k + 2")), ("k % 8 = 0", None, N.SKOS + "related", node("k + 1")),
        ("k % 4 <> 3", None, N.TYPE, f"'{basic}' || ['typ-objektu', 'typ-vlastnosti', 'pojem/typ-vztahu'][k % 4 + 1]"), ("k % 8 = 3", None, N.TYPE, f"'{basic}typ-vztahu'"), ("k % 8 = 0", None, N.RDFS + "subClassOf", node("k - 4")),
        ("k % 8 = 4", None, N.RDFS + "subClassOf", f"'{basic}pojem/objekt'"), ("k % 8 = 1", None, N.RDFS + "subClassOf", node("k + 1")), ("k % 8 = 3", None, N.RDFS + "subClassOf", "'_:b' || k"), ("k % 4 = 1", None, N.RDFS + "domain", node("k % 10")),
        ("k % 8 = 1", None, N.RDFS + "range", node("k % 3")), ("k % 8 = 3", "'_:b' || k", N.TYPE, f"'{N.OWL}Restriction'"), ("k % 8 = 3", "'_:b' || k", N.OWL + "onProperty", node("k % 5")), ("k % 8 = 3", "'_:b' || k", N.OWL + "onClass", node("k % 6")),
        ("k % 2 = 0", "'https://c/' || n", N.SKOS + "member", node("k")),
    ]
    rows = [f"SELECT {s or node('k')} AS s, '{p}' AS p, {o} AS o FROM x WHERE {test}" for test, s, p, o in facts]
    return "x AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),\nt AS (" + "\n UNION ALL ".join([*rows, f"SELECT 'https://t/' || n_nationkey, '{N.DCT}hasPart', 'https://c/' || n_nationkey FROM nation"]) + ")"


#: The thesaurus in SQL: WITH t.
THESAURUS_SQL = _thesaurus_sql()

#: The same class records and triples in SQL, for the comparisons: WITH c, t.
GRAPH_SQL = f"""
c AS (
  SELECT '{BASE}part-' || p_partkey AS iri, 'part-' || p_partkey AS id, p_name AS name, 'Objekt práva' AS type, CASE WHEN p_size % 3 <> 0 THEN p_type END AS description,
         CASE WHEN p_size % 5 = 0 THEN p_brand END AS source, CASE p_size % 4 WHEN 0 THEN 'ano' WHEN 1 THEN 'ne' WHEN 2 THEN 'true' END AS isPublic,
         CASE WHEN p_size % 7 = 0 THEN 'https://x.example/eli/cz/sb/' || p_partkey END AS privacyProvision, NULL::VARCHAR AS agendaCode, NULL::VARCHAR AS agendaSystemCode, NULL::VARCHAR AS sharedInPPDF
  FROM part
  UNION ALL SELECT '{BASE}supplier-' || s_suppkey, 'supplier-' || s_suppkey, s_name, 'Subjekt práva', NULL, NULL, NULL, NULL, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR END,
         CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::VARCHAR END, CASE WHEN s_acctbal > 0 THEN 'ano' ELSE 'ne' END FROM supplier
  UNION ALL SELECT '{BASE}customer-' || c_custkey, 'customer-' || c_custkey, c_name, 'Subjekt práva', NULL, NULL, NULL, NULL, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR END,
         CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR END, CASE WHEN c_acctbal > 0 THEN 'ano' ELSE 'ne' END FROM customer),
k AS (SELECT iri, CASE WHEN privacyProvision IS NOT NULL OR isPublic = 'ne' THEN '{N.NON_PUBLIC}' WHEN isPublic IN ('ano', 'true') THEN '{N.PUBLIC}' END AS kind FROM c),
t AS (
  SELECT iri AS s, 'iri' AS s_kind, '{N.TYPE}' AS p, '{N.OFN}{N.CONCEPT}' AS o, 'iri' AS o_kind, NULL::VARCHAR AS o_dt, NULL::VARCHAR AS o_lang FROM c
  UNION ALL SELECT iri, 'iri', '{N.TYPE}', '{N.OFN}{N.CLASS}', 'iri', NULL, NULL FROM c
  UNION ALL SELECT iri, 'iri', '{N.TYPE}', '{N.OFN}' || CASE type WHEN 'Subjekt práva' THEN '{N.SUBJECT_TYPE}' ELSE '{N.OBJECT_TYPE}' END, 'iri', NULL, NULL FROM c
  UNION ALL SELECT iri, 'iri', '{N.SKOS}prefLabel', name, 'literal', NULL, 'cs' FROM c
  UNION ALL SELECT iri, 'iri', '{N.DCT}description', description, 'literal', NULL, 'cs' FROM c WHERE description IS NOT NULL
  UNION ALL SELECT iri, 'iri', '{N.TYPE}', '{N.OFN}' || kind, 'iri', NULL, NULL FROM k WHERE kind IS NOT NULL
  UNION ALL SELECT iri, 'iri', '{N.DEFAULT_NS}{N.PROVISION}', '{N.ELI_BASE}' || substr(privacyProvision, strpos(privacyProvision, 'eli/cz/')), 'iri', NULL, NULL FROM c WHERE privacyProvision IS NOT NULL
  UNION ALL SELECT iri, 'iri', '{N.DEFAULT_NS}{N.AGENDA}', '{N.RPP}agenda/A' || agendaCode, 'iri', NULL, NULL FROM c WHERE agendaCode IS NOT NULL
  UNION ALL SELECT iri, 'iri', '{N.DEFAULT_NS}{N.AIS}', '{N.RPP}isvs/' || agendaSystemCode, 'iri', NULL, NULL FROM c WHERE agendaSystemCode IS NOT NULL
  UNION ALL SELECT iri, 'iri', '{N.DEFAULT_NS}{N.PPDF}', CASE sharedInPPDF WHEN 'ano' THEN 'true' ELSE 'false' END, 'literal', '{N.XSD}boolean', NULL FROM c WHERE sharedInPPDF IS NOT NULL
  UNION ALL SELECT iri, 'iri', '{N.DEFAULT_NS}{N.DEFINING_OTHER}', '_:' || sha256(iri || '|{N.DEFINING_OTHER}|' || source), 'bnode', NULL, NULL FROM c WHERE source IS NOT NULL
  UNION ALL SELECT '_:' || sha256(iri || '|{N.DEFINING_OTHER}|' || source), 'bnode', '{N.TYPE}', '{N.DIGITAL_OBJECT}', 'iri', NULL, NULL FROM c WHERE source IS NOT NULL
  UNION ALL SELECT '_:' || sha256(iri || '|{N.DEFINING_OTHER}|' || source), 'bnode', '{N.DCT}title', source, 'literal', NULL, 'cs' FROM c WHERE source IS NOT NULL)"""


def with_graph(sql: str) -> str:
    """``sql`` over c (class records) and t (triples)."""
    return f"WITH {GRAPH_SQL.strip()}{', ' if sql.lstrip()[:4].lower() == 'also' else ' '}{sql.lstrip()[4:] if sql.lstrip()[:4].lower() == 'also' else sql}"
