"""Constraint shapes over a triple table. A shape gives a results table (see schema.RESULTS), a row a violation.

Each constraint component is an expression over the focus nodes and one scan or aggregation of the triples, so that a
set of shapes costs a few joins, whatever the number of nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.operators import graph as G


def focus_nodes(triples: DataFrame, target: str) -> DataFrame:
    """Distinct instances of the target class and of all its subclasses in the graph."""
    below = triples.where(F.col("p") == N.RDFS + "subClassOf").select(F.col("o").alias("s"), F.col("s").alias("o"))
    if below.isEmpty():
        return G.instances(triples, target)
    own = triples.sparkSession.range(1).select(F.lit(target).alias("s"))
    kinds = G.reachable(below, own).select(F.col("node").alias("o")).union(own).distinct()
    return triples.where(F.col("p") == N.TYPE).select("s", "o").join(kinds, "o").select("s").distinct()


def results(nodes: DataFrame, severity: str, message: str, rule: str, path: Column | None = None, value: Column | None = None) -> DataFrame:
    """Violations at the nodes ``s``; the value is the node unless another is given."""
    nothing = F.lit(None).cast("string")
    return nodes.select(
        F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(rule).alias("ruleName"), F.col("s").alias("focusNodeUri"),
        (nothing if path is None else path).alias("resultPathUri"), (F.col("s") if value is None else value).alias("value"),
    )


@dataclass(frozen=True)
class Rule:
    """A named rule over the presence flags of a node: ``times`` tells how often it is raised."""

    tail: str
    severity: str
    message: str
    times: Callable[[], Column]

    @property
    def iri(self) -> str:
        return N.SHACL_LOCAL + self.tail


def _flags() -> dict[str, Column]:
    """What the rules ask of a node, each as a test on one triple."""
    p, o = F.col("p"), F.col("o")
    typed = lambda kind: (p == N.TYPE) & (o == N.OFN + kind)
    return {
        "described": p.isin(N.DCT + "description", N.SKOS + "definition", N.RDFS + "comment"),
        "sourced": p.isin(N.DCT + "source", N.DC + "source"),
        "shared": p.contains(N.PPDF) & (o == "true"),
        "subject": typed(N.SUBJECT_TYPE), "object": typed(N.OBJECT_TYPE), "public": typed(N.PUBLIC), "closed": typed(N.NON_PUBLIC),
        "told": p.contains(N.PROVISION_FRAGMENT), "agenda": p.contains(N.AGENDA), "ais": p.contains(N.AIS),
    }


def presence(triples: DataFrame, target: str, with_subclasses: bool = True) -> DataFrame:
    """One row a focus node with the flags: all rules share one scan and one aggregation of the triples.

    Without ``with_subclasses`` only direct instances of the target are focus nodes and the graph isn't searched for
    subclasses."""
    flags = triples.groupBy("s").agg(F.bool_or((F.col("p") == N.TYPE) & (F.col("o") == target)).alias("focus"), *[F.bool_or(test).alias(name) for name, test in _flags().items()])
    if with_subclasses and triples.where(F.col("p") == N.RDFS + "subClassOf").limit(1).count():
        return flags.join(focus_nodes(triples, target), "s", "left_semi").drop("focus")
    return flags.where("focus").drop("focus")


def _times(test: str, *branches: str) -> Callable[[], Column]:
    """1 if the test holds, or the number of the branches that hold then."""
    each = " + ".join(f"cast({b} as int)" for b in branches) or "1"
    return lambda: F.expr(f"if({test}, {each}, 0)")


#: The rules of the profile: name, severity and message are fixed values. A node in two branches of a union is raised twice.
RULES = {
    "popis": Rule("popis-a-definice-pojmu", "WARNING", "Pojem nemá vyplněný jeden nebo více z těchto údajů: popis, definice", _times("not described")),
    "zdroj": Rule("pojem-nemá-zdroj", "WARNING", "Pojem nemá vyplněný zdroj", _times("not sourced")),
    "rpp-complete": Rule("pojem-má-kompletní-údaje-charakteristiky-rpp", "INFO", "Pojem má kompletní charakteristiky pro RPP", _times("shared and (not closed or told)", "subject", "object")),
    "no-ppdf": Rule("pojem-nemá-sdílení-v-rpp", "INFO", "Pojem nemá sdílení v propojeném datovém fondu", _times("not shared", "subject", "object", "public", "closed")),
    "non-public": Rule("pojem-neveřejný-údaj-nemá-ustanovení-dokládající-neveřejnost", "INFO", "Pojem neveřejný údaj nemá ustanovení dokládající neveřejnost", _times("closed and not told")),
    "agenda-ais": Rule("pojem-nemá-vztah-k-agendě-nebo-ais", "INFO", "Pojem nemá vztah k agendě nebo AIS", _times("not agenda or not ais")),
}


def validate(triples: DataFrame, rules: Sequence[str] | None = None, enabled: dict[str, bool] | None = None, with_subclasses: bool = True, target: str = N.OFN + N.CONCEPT) -> DataFrame:
    """Results of the enabled rules (all, unless ``enabled`` says otherwise), or of the named ones only."""
    held = [r for k, r in RULES.items() if (rules is None or k in rules) and (enabled or {}).get(k, True)]
    if not held:
        return results(triples.select("s").limit(0), "INFO", "", "")
    raised = F.array(*[F.array_repeat(F.struct(F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), F.lit(r.iri).alias("ruleName")), r.times()) for r in held])
    rows = presence(triples, target, with_subclasses).select("s", F.inline(F.flatten(raised)))
    return rows.select("severity", "message", "ruleName", F.col("s").alias("focusNodeUri"), F.lit(None).cast("string").alias("resultPathUri"), F.col("s").alias("value"))


# Components on one path: each gives (s, value) of the violations, given the focus nodes.


def path_values(triples: DataFrame, path: str) -> DataFrame:
    return triples.where(F.col("p") == path).select("s", "o", "o_kind", "o_dt", "o_lang")


def count_outside(triples: DataFrame, focus: DataFrame, path: str, least: int = 0, most: int | None = None) -> DataFrame:
    """minCount and maxCount; value is the count."""
    n = focus.join(path_values(triples, path), "s", "left").groupBy("s").agg(F.count("o").alias("n"))
    return n.where((F.col("n") < least) | (F.col("n") > most if most is not None else F.lit(False))).select("s", F.col("n").cast("string").alias("value"))


def values_failing(triples: DataFrame, focus: DataFrame, path: str, ok: Column) -> DataFrame:
    """Components that look at a value by itself: datatype, nodeKind, in, pattern, lengths, ranges, languageIn. ``ok`` is over o, o_kind, o_dt, o_lang."""
    return focus.join(path_values(triples, path), "s").where(~F.coalesce(ok, F.lit(False))).select("s", F.col("o").alias("value"))


def components_failing(triples: DataFrame, focus: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """(component, s, value) of several value components in one scan: ``checks`` maps a name to its path and test."""
    failed = F.filter(F.array(*[F.when((F.col("p") == path) & ~F.coalesce(ok, F.lit(False)), name) for name, (path, ok) in checks.items()]), lambda x: x.isNotNull())
    return focus.join(triples.where(F.col("p").isin(*{path for path, _ in checks.values()})), "s").select(F.explode(failed).alias("component"), "s", F.col("o").alias("value"))


def missing_value(triples: DataFrame, focus: DataFrame, path: str, wanted: str) -> DataFrame:
    """hasValue."""
    return G.where_not_exists(focus, G.match(triples, "s", path, where=F.col("o") == wanted)).withColumn("value", F.lit(None).cast("string"))


def values_not_of_class(triples: DataFrame, focus: DataFrame, path: str, kind: str) -> DataFrame:
    """class: values that aren't instances of ``kind`` or a subclass."""
    held = focus.join(path_values(triples, path).select("s", F.col("o").alias("value")), "s")
    return held.join(focus_nodes(triples, kind).withColumnRenamed("s", "value"), "value", "left_anti").select("s", "value")


def repeated_languages(triples: DataFrame, focus: DataFrame, path: str) -> DataFrame:
    """uniqueLang; value is the language."""
    held = focus.join(path_values(triples, path).where(F.col("o_lang") != ""), "s")
    return held.groupBy("s", "o_lang").agg(F.count("*").alias("n")).where("n > 1").select("s", F.col("o_lang").alias("value"))


def _by_path(triples: DataFrame, focus: DataFrame, path: str, other: str) -> DataFrame:
    """(s, value, a, b): the values that the nodes have by either path, each once, and whether they have it by the one and by the other."""
    told = [path_values(triples, p).select("s", F.col("o").alias("value"), F.lit(p == path).alias("a"), F.lit(p == other).alias("b")) for p in dict.fromkeys((path, other))]
    held = reduce(DataFrame.unionByName, told).groupBy("s", "value").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return held.join(focus, "s", "left_semi")


def unequal_values(triples: DataFrame, focus: DataFrame, path: str, other: str) -> DataFrame:
    """equals: values of one path that the other lacks."""
    return _by_path(triples, focus, path, other).where("a <> b").select("s", "value")


def common_values(triples: DataFrame, focus: DataFrame, path: str, other: str) -> DataFrame:
    """disjoint: values that both paths have."""
    return _by_path(triples, focus, path, other).where("a AND b").select("s", "value")


def not_less(triples: DataFrame, focus: DataFrame, path: str, other: str, or_equal: bool = False) -> DataFrame:
    """lessThan and lessThanOrEquals, on numbers: values of ``path`` that aren't below all of ``other``."""
    low = focus.join(path_values(triples, path).select("s", "o"), "s")
    least = path_values(triples, other).groupBy("s").agg(F.min(F.col("o").try_cast("double")).alias("least"))
    x = F.col("o").try_cast("double")
    return low.join(least, "s").where(~F.coalesce(x <= F.col("least") if or_equal else x < F.col("least"), F.lit(False))).select("s", F.col("o").alias("value"))


def foreign_predicates(triples: DataFrame, focus: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """closed with ignoredProperties: (s, p, value) of predicates outside ``allowed``."""
    return focus.join(triples.where(~F.col("p").isin(*allowed)).select("s", "p", F.col("o").alias("value")), "s")


def conformance(focus: DataFrame, **failing: DataFrame) -> DataFrame:
    """``focus`` with a boolean column a named shape: whether the node conforms, i.e. isn't among its violations."""
    for name, bad in failing.items():
        focus = G.bind_exists(focus, bad.select("s"), f"__{name}").withColumn(name, ~F.col(f"__{name}")).drop(f"__{name}")
    return focus


def conformance_of(triples: DataFrame, target: str, **tests: Column) -> DataFrame:
    """Direct instances of the target with a boolean column a test: whether one of the node's triples passes it. One aggregation for all tests."""
    flags = triples.groupBy("s").agg(F.bool_or((F.col("p") == N.TYPE) & (F.col("o") == target)).alias("__focus"), *[F.bool_or(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()])
    return flags.where("__focus").drop("__focus")


def all_of(*shapes: str) -> Column:
    return reduce(lambda a, b: a & b, map(F.col, shapes))


def any_of(*shapes: str) -> Column:
    return reduce(lambda a, b: a | b, map(F.col, shapes))


def exactly_one_of(*shapes: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(x).cast("int") for x in shapes]) == 1


def qualified_count_outside(triples: DataFrame, focus: DataFrame, path: str, ok: Column, least: int = 0, most: int | None = None) -> DataFrame:
    """qualifiedValueShape: counts only the values for which ``ok`` holds."""
    held = triples.where((F.col("p") != path) | F.coalesce(ok, F.lit(False)))
    return count_outside(held, focus, path, least, most)


def convert_results(entries: DataFrame) -> DataFrame:
    """Raw entries (severity IRI, message, rule, focus, path, value) as results: the default message, known severities, rules outside the profile as unknown."""
    kind = F.regexp_extract("severity", r"([^#/]*)$", 1)
    return entries.select(
        F.when(kind == "Violation", "ERROR").when(kind == "Warning", "WARNING").otherwise("INFO").alias("severity"),
        F.coalesce(F.when(F.trim("message") != "", F.col("message")), F.lit("Validation constraint violation")).alias("message"),
        F.when(F.col("ruleName").startswith(N.DEFAULT_NS + "shacl/"), F.col("ruleName")).otherwise(N.SHACL_GLOBAL + "unknown-rule").alias("ruleName"),
        "focusNodeUri", "resultPathUri", "value",
    )
