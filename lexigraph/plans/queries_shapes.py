"""Queries on shapes and reports, over the graph of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.operators import graph as G
from lexigraph.operators import report as R
from lexigraph.operators import shapes as S
from lexigraph.plans import lift as L
from lexigraph.plans import tpch
from lexigraph.plans.registry import query
from lexigraph.plans.tpch import with_graph

T, O, D = N.TYPE, N.OFN, N.DEFAULT_NS
FOCUS = f"f AS (SELECT DISTINCT s FROM t WHERE p = '{T}' AND o = '{O}{N.CONCEPT}')"


def _typed(kind: str) -> str:
    return f"SELECT f.s FROM f WHERE EXISTS (SELECT 1 FROM t WHERE t.s = f.s AND t.p = '{T}' AND t.o = '{O}{kind}')"


def _rule(key: str, where: str) -> str:
    r = S.RULES[key]
    return f"SELECT '{r.severity}' AS severity, '{r.message}' AS message, '{r.iri}' AS ruleName, s AS focusNodeUri, NULL::VARCHAR AS resultPathUri, s AS value FROM ({where})"


HAS = "EXISTS (SELECT 1 FROM t WHERE t.s = x.s AND {})"
PPDF = HAS.format(f"contains(t.p, '{N.PPDF}') AND t.o = 'true'")
PROV = HAS.format(f"contains(t.p, '{N.PROVISION_FRAGMENT}')")
CLOSED = HAS.format(f"t.p = '{T}' AND t.o = '{O}{N.NON_PUBLIC}'")
RULE_SQL = {
    "popis": _rule("popis", f"SELECT s FROM f x WHERE NOT {HAS.format(f"t.p IN ('{N.DCT}description', '{N.SKOS}definition', '{N.RDFS}comment')")}"),
    "zdroj": _rule("zdroj", f"SELECT s FROM f x WHERE NOT {HAS.format(f"t.p IN ('{N.DCT}source', '{N.DC}source')")}"),
    "rpp-complete": _rule("rpp-complete", f"SELECT s FROM ({_typed(N.SUBJECT_TYPE)} UNION ALL {_typed(N.OBJECT_TYPE)}) x WHERE {PPDF} AND (NOT {CLOSED} OR {PROV})"),
    "no-ppdf": _rule("no-ppdf", f"SELECT s FROM ({' UNION ALL '.join(map(_typed, (N.SUBJECT_TYPE, N.OBJECT_TYPE, N.PUBLIC, N.NON_PUBLIC)))}) x WHERE NOT {PPDF}"),
    "non-public": _rule("non-public", f"SELECT s FROM ({_typed(N.NON_PUBLIC)}) x WHERE NOT {PROV}"),
    "agenda-ais": _rule("agenda-ais", f"SELECT s FROM f x WHERE NOT {HAS.format(f"contains(t.p, '{N.AGENDA}')")} OR NOT {HAS.format(f"contains(t.p, '{N.AIS}')")}"),
}
ALL = f"r AS ({' UNION ALL '.join(RULE_SQL.values())})"


def _sql(key: str) -> str:
    return with_graph(f"also {FOCUS} {RULE_SQL[key]}")


def over_all(sql: str, more: str = "") -> str:
    return with_graph(f"also {FOCUS}, {ALL}{', ' if more else ''}{more} {sql}")


LABEL = "CASE severity WHEN 'ERROR' THEN 'Chyba' WHEN 'WARNING' THEN 'Varování' WHEN 'INFO' THEN 'Informace' ELSE 'Neznámá' END"
RANK = "CASE severity WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'INFO' THEN 3 ELSE 4 END"
LEVEL = "CASE severity WHEN 'ERROR' THEN 'Vysoká' WHEN 'WARNING' THEN 'Střední' WHEN 'INFO' THEN 'Nízká' ELSE 'Neznámá' END"
SHACL = "'http://www.w3.org/ns/shacl#' || CASE severity WHEN 'ERROR' THEN 'Violation' WHEN 'WARNING' THEN 'Warning' ELSE 'Info' END"
LAST = "coalesce(nullif(regexp_extract({0}, '([^/#]*)$', 1), ''), {0})"


def validated(spark: SparkSession, sf_dir: str, rules: list[str] | None = None, enabled: dict[str, bool] | None = None) -> DataFrame:
    """Results of the rules on the driver tables' graph, which has no subclasses."""
    return S.validate(tpch.triples(spark, sf_dir), rules, enabled, with_subclasses=False)


@query(over_all(f"SELECT {RANK} AS rank, {LABEL} AS severity, count(*) AS count, message AS description FROM r WHERE severity = 'WARNING' GROUP BY ALL"))
def shape_minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.severity_groups(validated(spark, sf_dir, ["popis", "zdroj"]))


def _one(key: str):
    return lambda spark, sf_dir: validated(spark, sf_dir, [key])


for name, key in (("shape_description", "popis"), ("shape_source", "zdroj"), ("shape_rpp_complete", "rpp-complete"), ("shape_no_ppdf_bag", "no-ppdf"), ("shape_nonpublic_no_provision", "non-public"), ("shape_agenda_or_ais_missing", "agenda-ais")):
    f = _one(key)
    f.__name__ = name
    query(_sql(key))(f)


@query(over_all("SELECT * FROM r WHERE ruleName NOT LIKE '%zdroj'"))
def shape_rule_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir, enabled={"zdroj": False})


@query("WITH n AS (SELECT c_name AS s, 'kind-' || n_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT DISTINCT s FROM n")
def shape_target_subclass_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as instances of their nation's kind, below their region's kind, below one kind of all."""
    n, r, c = (tpch.read(spark, sf_dir, x) for x in ("nation", "region", "customer"))
    kind = lambda x: F.concat(F.lit("kind-"), F.col(x))
    below = F.lit(N.RDFS + "subClassOf")
    rows = G.union_bag(
        n.join(r, n.n_regionkey == r.r_regionkey).select(kind("n_name").alias("s"), below.alias("p"), kind("r_name").alias("o")),
        r.select(kind("r_name").alias("s"), below.alias("p"), F.lit("kind-all").alias("o")),
        c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("s"), F.lit(T).alias("p"), kind("n_name").alias("o")),
    )
    return S.focus_nodes(rows, "kind-all")


DESC, LAB = N.DCT + "description", N.SKOS + "prefLabel"


@query(with_graph(f"""also {FOCUS}, n AS (SELECT f.s, count(t.o) AS n FROM f LEFT JOIN t ON t.s = f.s AND t.p = '{T}' GROUP BY f.s)
  SELECT s, n::VARCHAR AS value, 'types' AS path FROM n WHERE n > 3
  UNION ALL SELECT s, '0', 'description' FROM f x WHERE NOT {HAS.format(f"t.p = '{DESC}'")}"""))  # fmt: skip
def shape_core_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    f = G.instances(t, O + N.CONCEPT)
    return S.count_outside(t, f, T, most=3).withColumn("path", F.lit("types")).unionByName(S.count_outside(t, f, DESC, least=1).withColumn("path", F.lit("description")))


@query(with_graph(f"""also v AS (SELECT * FROM t WHERE s_kind = 'iri')
  SELECT 'pattern' AS component, s, o AS value FROM v WHERE p = '{DESC}' AND NOT regexp_matches(o, '(?i)^[a-e]')
  UNION ALL SELECT 'length', s, o FROM v WHERE p = '{LAB}' AND NOT (length(o) BETWEEN 10 AND 20)
  UNION ALL SELECT 'in', s, o FROM v WHERE p = '{D}{N.PPDF}' AND o <> 'true'
  UNION ALL SELECT 'languageIn', s, o FROM v WHERE p = '{LAB}' AND o_lang NOT IN ('en')
  UNION ALL SELECT 'range', s, o FROM v WHERE p = '{D}{N.AIS}' AND NOT (regexp_extract(o, '([0-9]+)$', 1)::DOUBLE <= 50)
  UNION ALL SELECT 'nodeKind', s, o FROM v WHERE p = '{D}{N.DEFINING_OTHER}' AND o_kind <> 'iri'
  UNION ALL SELECT 'datatype', s, o FROM v WHERE p = '{LAB}'"""))  # fmt: skip
def shape_core_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    f = G.instances(t, O + N.CONCEPT)
    o = F.col("o")
    parts = {
        "pattern": (DESC, o.rlike("(?i)^[a-e]")),
        "length": (LAB, F.length(o).between(10, 20)),
        "in": (D + N.PPDF, o.isin("true")),
        "languageIn": (LAB, F.col("o_lang").isin("en")),
        "range": (D + N.AIS, F.regexp_extract(o, "([0-9]+)$", 1).try_cast("double") <= 50),
        "nodeKind": (D + N.DEFINING_OTHER, F.col("o_kind") == "iri"),
        "datatype": (LAB, F.col("o_dt") == N.XSD + "string"),
    }
    return G.union_bag(*[S.values_failing(t, f, p, ok).select(F.lit(k).alias("component"), "s", "value") for k, (p, ok) in parts.items()])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tpch.dealt(tpch.read(spark, sf_dir, "part")).select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("s"), F.col("p_name").alias("a"), F.col("p_type").alias("b"), F.col("p_size").alias("n"), F.col("p_size").alias("x")
    )
    return L.told(p, F.col("s"), L.fact("a", F.col("a")), L.fact("b", F.col("b")), L.fact("n", F.col("n")), L.fact("m", (F.col("x") * 7) % 50)).select("s", "p", "o", "o_kind", "o_dt", "o_lang")


@query("""WITH p AS (SELECT 'part-' || p_partkey AS s, p_name AS a, p_type AS b, p_size AS n, (p_size * 7) % 50 AS m FROM part)
  SELECT 'equals' AS component, s, a AS value FROM p WHERE a <> b UNION ALL SELECT 'equals', s, b FROM p WHERE a <> b
  UNION ALL SELECT 'disjoint', s, n::VARCHAR FROM p WHERE n = m
  UNION ALL SELECT 'lessThan', s, n::VARCHAR FROM p WHERE NOT n < m
  UNION ALL SELECT 'lessThanOrEquals', s, n::VARCHAR FROM p WHERE NOT n <= m""")
def shape_core_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pairs(spark, sf_dir)
    f = t.select("s").distinct()
    parts = {"equals": S.unequal_values(t, f, "a", "b"), "disjoint": S.common_values(t, f, "n", "m"), "lessThan": S.not_less(t, f, "n", "m"), "lessThanOrEquals": S.not_less(t, f, "n", "m", True)}
    return G.union_bag(*[x.select(F.lit(k).alias("component"), "s", "value") for k, x in parts.items()])


@query(with_graph(f"""also {FOCUS}, g AS (SELECT s, {HAS.format(f"t.p = '{DESC}'")} AS described, {HAS.format(f"t.p = '{D}{N.AGENDA}'")} AS agenda, {HAS.format(f"t.p = '{D}{N.AIS}'")} AS ais FROM f x)
  SELECT s, described, agenda, ais, described AND agenda AS both, described OR agenda AS either, described::INT + agenda::INT + ais::INT = 1 AS one, NOT described AS none FROM g"""))  # fmt: skip
def shape_core_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    p = F.col("p")
    c = S.conformance_of(t, O + N.CONCEPT, described=p == DESC, agenda=p == D + N.AGENDA, ais=p == D + N.AIS)
    return c.withColumns({"both": S.all_of("described", "agenda"), "either": S.any_of("described", "agenda"), "one": S.exactly_one_of("described", "agenda", "ais"), "none": ~F.col("described")})


@query(with_graph(f"""also {FOCUS} SELECT t.s, t.p, t.o AS value FROM t JOIN f ON t.s = f.s WHERE t.p NOT IN ('{T}', '{LAB}', '{DESC}')"""))
def shape_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    return S.foreign_predicates(t, G.instances(t, O + N.CONCEPT), [T, LAB, DESC])


@query("SELECT 'source-' || source AS s, lang AS value FROM documents WHERE lang <> '' GROUP BY source, lang HAVING count(*) > 1")
def shape_unique_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tpch.read(spark, sf_dir, "documents").select(F.concat(F.lit("source-"), "source").alias("s"), F.lit(LAB).alias("p"), F.col("doc_id").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.col("lang").alias("o_lang"))
    return S.repeated_languages(d, d.select("s").distinct(), LAB)


@query(with_graph(f"""also {FOCUS}, n AS (SELECT f.s, count(t.o) AS n FROM f LEFT JOIN t ON t.s = f.s AND t.p = '{T}' AND contains(t.o, 'údaj') GROUP BY f.s) SELECT s, n::VARCHAR AS value FROM n WHERE n < 1"""))
def shape_qualified_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    return S.qualified_count_outside(t, G.instances(t, O + N.CONCEPT), T, F.col("o").contains("údaj"), least=1)


@query(with_graph(f"""also {FOCUS} SELECT s, NULL::VARCHAR AS value FROM f x WHERE NOT {HAS.format(f"t.p = '{T}' AND t.o = '{O}{N.PUBLIC}'")}"""))
def shape_has_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    return S.missing_value(t, G.instances(t, O + N.CONCEPT), T, O + N.PUBLIC)


@query("SELECT 'n-' || n_name AS s, CASE WHEN n_nationkey % 3 = 0 THEN 'x-' || n_name ELSE 'r-' || r_name END AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0")
def shape_value_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that point to something that isn't a region."""
    n, r = tpch.read(spark, sf_dir, "nation"), tpch.read(spark, sf_dir, "region")
    at = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("x-"), "n_name")).otherwise(F.concat(F.lit("r-"), "r_name"))
    t = G.union_bag(
        L.told(n.join(r, n.n_regionkey == r.r_regionkey), F.concat(F.lit("n-"), "n_name"), L.fact("in", at, L.IRI)), L.told(r, F.concat(F.lit("r-"), "r_name"), L.fact(T, F.lit("Region"), L.IRI))
    )
    return S.values_not_of_class(t, n.select(F.concat(F.lit("n-"), "n_name").alias("s")), "in", "Region")


@query(over_all(f"SELECT {RANK} AS rank, {LABEL} AS severity, count(*) AS count, message AS description FROM r GROUP BY ALL"))
def report_severity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.severity_groups(validated(spark, sf_dir))


FIRST = "q AS (SELECT focusNodeUri, lower(coalesce(ruleName, 'unknown-rule')) AS ruleName, severity, message, value, row_number() OVER (PARTITION BY focusNodeUri, lower(ruleName) ORDER BY message, value, severity) AS n FROM r WHERE focusNodeUri IS NOT NULL)"


@query(over_all("SELECT focusNodeUri, ruleName, severity, message, value FROM q WHERE n = 1", FIRST))
def report_by_concept_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_concept(validated(spark, sf_dir))


@query(over_all("SELECT ruleName, count(*) AS n, string_agg(DISTINCT message, '|' ORDER BY message) AS messages FROM r GROUP BY ruleName"))
def report_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grouped(validated(spark, sf_dir), "ruleName")


@query(over_all("SELECT focusNodeUri, count(*) AS n, string_agg(DISTINCT message, '|' ORDER BY message) AS messages FROM r GROUP BY focusNodeUri"))
def report_by_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grouped(validated(spark, sf_dir), "focusNodeUri")


@query(over_all("""SELECT count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS infos, count(*) AS total,
  'Validation completed: ' || count(*) FILTER (severity = 'ERROR') || ' errors, ' || count(*) FILTER (severity = 'WARNING') || ' warnings, ' || count(*) FILTER (severity = 'INFO') || ' info messages' AS summary FROM r"""))
def report_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.severity_counts(validated(spark, sf_dir))


@query(with_graph(f"also {FOCUS} {RULE_SQL['popis']} UNION ALL SELECT severity, '[GLOBAL] ' || message, ruleName, focusNodeUri, resultPathUri, value FROM ({RULE_SQL['zdroj']})"))
def report_combined_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch.triples(spark, sf_dir)
    return R.combined(S.validate(t, with_subclasses=False, rules=["popis"]), S.validate(t, with_subclasses=False, rules=["zdroj"]))


@query(over_all(f"""SELECT focusNodeUri AS "Concept_IRI", {LAST.format('focusNodeUri')} AS "Concept_Name", ruleName AS "Rule_IRI", {LAST.format('ruleName')} AS "Rule_Name", message AS "Rule_Description",
  {SHACL} AS "Severity", {LEVEL} AS "Level", value AS "Violation_Message", '' AS "Violating_Value" FROM q WHERE n = 1""", FIRST))
def report_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.csv_rows(validated(spark, sf_dir))


@query(over_all(f"SELECT DISTINCT severity, {LABEL} AS label, {LEVEL} AS level, {SHACL} AS iri, {RANK} AS rank FROM r"))
def report_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("severity")
    return validated(spark, sf_dir).select("severity", R.severity_label(c).alias("label"), R.severity_level(c).alias("level"), R.severity_iri(c).alias("iri"), R.severity_rank(c).alias("rank")).distinct()


@query("""SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'INFO' END AS severity, CASE WHEN event_id % 3 = 0 THEN 'Validation constraint violation' ELSE props END AS message,
  CASE WHEN event_id % 2 = 0 THEN 'https://slovník.gov.cz/shacl/lokální/r' ELSE 'https://slovník.gov.cz/shacl/globální/unknown-rule' END AS ruleName, user_id::VARCHAR AS focusNodeUri, NULL::VARCHAR AS resultPathUri, event_id::VARCHAR AS value FROM events""")
def report_result_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw result entries."""
    e, k = tpch.read(spark, sf_dir, "events"), F.col("event_type")
    raw = e.select(
        F.concat(F.lit("http://www.w3.org/ns/shacl#"), F.when(k == "error", "Violation").when(k == "view", "Warning").otherwise("Info")).alias("severity"),
        F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("message"), F.when(F.col("event_id") % 2 == 0, S.N.SHACL_LOCAL + "r").otherwise("http://other.example/r").alias("ruleName"),
        F.col("user_id").cast("string").alias("focusNodeUri"), F.lit(None).cast("string").alias("resultPathUri"), F.col("event_id").cast("string").alias("value"),
    )
    return S.convert_results(raw)


@query(with_graph("SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates FROM (SELECT DISTINCT * FROM t)"))
def report_rule_statement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph(tpch.triples(spark, sf_dir)).agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("p").alias("predicates"))
