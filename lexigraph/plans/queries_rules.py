"""Queries on rule files and property paths, over the orders as a graph of typed literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.operators import paths as P
from lexigraph.plans import lift as L
from lexigraph.plans.registry import query
from lexigraph.plans.tpch import dealt, read, tasks
from lexigraph.plans.written import written
from lexigraph.sources import rules

E, RULE = "https://orders.example/", "https://rules.example/"
DATE, WHOLE = N.XSD + "date", N.XSD + "integer"
#: Orders or lines a task turns into triples.
TASK_LINES = 400_000


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, orders, customers, nations and regions: dates, tagged notes, and quantities some of which aren't the whole numbers that they are said to be."""
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    iri = lambda kind, *keys: F.concat(F.lit(E + kind), *[x for k in keys for x in (F.lit("-"), F.col(k).cast("string"))])
    line, whole = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    parts, dates = tasks(li, TASK_LINES), o.select("o_orderkey", "o_orderdate")
    if parts > 1:
        li, dates = li.repartition(parts, "l_orderkey"), dates.repartition(parts, "o_orderkey")
    lines, o = li.join(dates, F.col("l_orderkey") == F.col("o_orderkey")), dealt(o, TASK_LINES)
    tongue = F.when(line % 4 == 0, "en").when(line % 4 == 1, "en-GB").when(line % 4 == 2, "cs").otherwise("english")
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    return (
        L.told(lines, iri("line", "l_orderkey", "l_linenumber"),
               L.fact(N.TYPE, F.lit(E + "Line"), L.IRI), L.fact(E + "of", iri("order", "l_orderkey"), L.IRI), L.fact(E + "ordered", date("o_orderdate"), dt=DATE), L.fact(E + "shipped", date("l_shipdate"), dt=DATE),
               L.fact(E + "quantity", F.when(line % 3 == 0, F.concat(whole, F.lit(".5"))).otherwise(whole), dt=WHOLE), L.fact(E + "note", F.col("l_returnflag"), lang=tongue))
        .unionByName(L.told(o, iri("order", "o_orderkey"), L.fact(N.TYPE, F.lit(E + "Order"), L.IRI), L.fact(E + "by", iri("customer", "o_custkey"), L.IRI), L.fact(E + "placed", date("o_orderdate"), dt=DATE), L.fact(E + "status", F.col("o_orderstatus"))))
        .unionByName(L.told(read(spark, sf_dir, "customer"), iri("customer", "c_custkey"), L.fact(N.TYPE, F.lit(E + "Customer"), L.IRI), L.fact(E + "within", iri("nation", "c_nationkey"), L.IRI)))
        .unionByName(L.told(n, iri("nation", "n_nationkey"), L.fact(E + "within", iri("region", "n_regionkey"), L.IRI), L.fact(E + "label", F.col("n_name"))))
        .unionByName(L.told(r, iri("region", "r_regionkey"), L.fact(E + "label", F.col("r_name"))))
    )


HEAD = f"@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <{N.XSD}> . @prefix e: <{E}> . @prefix r: <{RULE}> .\n"


def checked(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    held = rules.load_rules(spark, written(spark.createDataFrame([(HEAD + text,)], "text string"), "rules"))
    if held.skipped:
        raise ValueError(f"not taken over: {held.skipped}")
    return rules.validate_with(orders(spark, sf_dir), held)


def _found(rule: str, focus: str, path: str, value: str, rest: str, severity: str = "ERROR", message: str = "") -> str:
    return f"""SELECT '{severity}' AS severity, '{message}' AS message, '{RULE}{rule}' AS "ruleName", {focus} AS "focusNodeUri", {path} AS "resultPathUri", {value} AS value {rest}"""


LINE, CUSTOMER = f"'{E}line-' || l_orderkey || '-' || l_linenumber", f"'{E}customer-' || c_custkey"
SHIPPED, ORDERED = "strftime(l_shipdate, '%Y-%m-%d')", "strftime(o_orderdate, '%Y-%m-%d')"


@query("SELECT DISTINCT * FROM (" + " UNION ALL ".join([
    _found("span", LINE, f"'{E}shipped'", SHIPPED, "FROM lineitem WHERE l_shipdate::DATE < DATE '1993-01-01' OR l_shipdate::DATE >= DATE '1998-06-01'", "WARNING", "out of time"),
    _found("order", LINE, f"'{E}ordered'", ORDERED, "FROM lineitem x JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate::DATE >= (SELECT min(y.l_shipdate)::DATE FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber)"),
    _found("whole", LINE, f"'{E}quantity'", "l_quantity::INT || '.5'", "FROM lineitem WHERE l_linenumber % 3 = 0"),
    _found("note", LINE, f"'{E}note'", "l_returnflag", "FROM lineitem WHERE l_linenumber % 4 > 1"),
]) + ")")
def shape_typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a file on dates in a range, dates in order, ill-formed numbers and languages; one is a property shape with a target of its own."""
    return checked(spark, sf_dir, """
r:span a sh:NodeShape ; sh:targetClass e:Line ; sh:severity sh:Warning ; sh:message "out of time" ; sh:property [ sh:path e:shipped ; sh:minInclusive "1993-01-01"^^xsd:date ; sh:maxExclusive "1998-06-01"^^xsd:date ] .
r:order sh:targetClass e:Line ; sh:property [ sh:path e:ordered ; sh:lessThan e:shipped ] .
r:whole a sh:PropertyShape ; sh:targetSubjectsOf e:quantity ; sh:path e:quantity ; sh:datatype xsd:integer .
r:note sh:targetClass e:Line ; sh:property [ sh:path e:note ; sh:languageIn ( "en" ) ] .""")


@query(" UNION ALL ".join([
    _found("late", CUSTOMER, f"'^{E}by'", "count(*) FILTER (o_orderdate::DATE >= DATE '1997-01-01')::VARCHAR",
           "FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) FILTER (o_orderdate::DATE >= DATE '1997-01-01') < 2"),
    _found("closed", CUSTOMER, f"'^{E}by'", f"'{E}order-' || o_orderkey", "FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderdate::DATE < DATE '1993-01-01'"),
    _found("never", f"'{E}order-' || o_orderkey", "NULL", f"'{E}order-' || o_orderkey",
           "FROM orders WHERE o_orderstatus = 'P' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
]))
def shape_within_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that ask shapes of values: qualified counts, a named shape of each value, and a negated alternative; along inverse paths."""
    return checked(spark, sf_dir, """
r:recent sh:property [ sh:path e:placed ; sh:minInclusive "1997-01-01"^^xsd:date ] .
r:done sh:property [ sh:path e:status ; sh:in ( "F" "O" ) ] ; sh:property [ sh:path e:placed ; sh:minInclusive "1993-01-01"^^xsd:date ] .
r:late sh:targetClass e:Customer ; sh:property [ sh:path [ sh:inversePath e:by ] ; sh:qualifiedValueShape r:recent ; sh:qualifiedMinCount 2 ] .
r:closed sh:targetClass e:Customer ; sh:property [ sh:path [ sh:inversePath e:by ] ; sh:node r:done ] .
r:never sh:targetClass e:Order ; sh:not [ sh:or ( [ sh:path e:status ; sh:hasValue "P" ] [ sh:path ( [ sh:inversePath e:of ] e:note ) ; sh:qualifiedValueShape [ sh:pattern "^R$" ] ; sh:qualifiedMinCount 1 ] ) ] .""")


def _walked(spark: SparkSession, sf_dir: str, kind: str, path: P.Path) -> DataFrame:
    graph = P.named(orders(spark, sf_dir))
    begin = P.nodes(graph.where((F.col("p") == N.TYPE) & (F.col("v") == E + kind)).select("s"))
    return P.walk(graph, begin, path).select(F.col("f").alias("node"), F.col("o").alias("value"))


@query(f"SELECT {CUSTOMER} AS node, '{E}order-' || o_orderkey AS value FROM customer JOIN orders ON o_custkey = c_custkey")
def path_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From customers back to their orders."""
    return _walked(spark, sf_dir, "Customer", P.inverse(P.predicate(E + "by")))


@query(f"SELECT DISTINCT {CUSTOMER} AS node, l_returnflag AS value FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def path_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From customers over their orders and lines to the notes' texts; the same text in two languages is one row here."""
    path = P.sequence(P.inverse(P.sequence(P.predicate(E + "of"), P.predicate(E + "by"))), P.predicate(E + "note"))
    return _walked(spark, sf_dir, "Customer", path).distinct()


@query(f"SELECT DISTINCT '{E}line-' || l_orderkey || '-' || l_linenumber AS node, d AS value FROM (SELECT l_orderkey, l_linenumber, {SHIPPED} AS d FROM lineitem UNION SELECT l_orderkey, l_linenumber, {ORDERED} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def path_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lines to the days on which they were ordered or shipped, each once."""
    return _walked(spark, sf_dir, "Line", P.alternative(P.predicate(E + "ordered"), P.predicate(E + "shipped")))


@query(f"SELECT {CUSTOMER} AS node, unnest([{CUSTOMER}, '{E}nation-' || n_nationkey, '{E}region-' || n_regionkey]) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")
def path_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From customers to all places that they are within, themselves among them."""
    return _walked(spark, sf_dir, "Customer", P.repeated(P.predicate(E + "within")))


@query(f"SELECT {CUSTOMER} AS node, n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT {CUSTOMER}, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def path_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the places that customers are within: a repeated step and then a single one."""
    return _walked(spark, sf_dir, "Customer", P.sequence(P.repeated(P.predicate(E + "within"), 1), P.predicate(E + "label")))
