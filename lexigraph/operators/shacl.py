"""Constraint shapes over nodes and paths, with shapes within shapes.

A shape asks something of each value of a node: the node itself, or what the shape's path leads to. Shapes that another
one refers to are asked of its values first, and the nodes that fail them are joined with the values. So each shape costs
a few joins and aggregations, whatever the number of nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.functions import values as V
from lexigraph.operators import paths as P
from lexigraph.operators import shapes as S
from lexigraph.operators.hierarchy import stored

SH = "http://www.w3.org/ns/shacl#"
KINDS = {SH + "IRI": ("iri",), SH + "BlankNode": ("bnode",), SH + "Literal": ("literal",), SH + "BlankNodeOrIRI": ("bnode", "iri"), SH + "IRIOrLiteral": ("iri", "literal"), SH + "BlankNodeOrLiteral": ("bnode", "literal")}


class Term(NamedTuple):
    o: str
    kind: str = "iri"
    dt: str | None = None
    lang: str | None = None

    @property
    def name(self) -> str:
        """As ``paths.name_of`` gives it."""
        return f'"{self.o}"^^{self.dt or ""}@{(self.lang or "").lower()}' if self.kind == "literal" else self.o

    def place(self) -> Column:
        return V.place(F.lit(self.o), F.lit(self.dt).cast("string"), F.lit(self.lang).cast("string"))


@dataclass
class Constraint:
    """A component with its terms or shapes."""

    component: str
    terms: list[Term] = field(default_factory=list)
    shapes: list[Shape] = field(default_factory=list)
    flags: str = ""
    least: int = 0  # of qualified values
    most: int | None = None
    apart: list[Shape] = field(default_factory=list)  # shapes that qualified values mustn't conform to


@dataclass
class Shape:
    iri: str
    severity: str = "ERROR"
    message: str = ""
    path: P.Path | None = None
    targets: list[tuple[str, Term]] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    rule: str | None = None  # key of a rule of the profile


def _range(low: bool, equal: bool):
    def ok(c: Constraint) -> Column:
        wanted = [1 if low else -1, *([0] if equal else [])]
        return (F.col("o_kind") == "literal") & V.compared(V.place(F.col("o"), F.col("o_dt"), F.col("o_lang")), c.terms[0].place()).isin(*wanted)

    return ok


def _pattern(c: Constraint) -> Column:
    flags = "".join(x for x in c.flags if x in "imsx")
    return (F.col("o_kind") != "bnode") & F.col("o").rlike(f"(?{flags}){c.terms[0].o}" if flags else c.terms[0].o)


def _datatype(c: Constraint) -> Column:
    own = V.datatype(F.col("o_dt"), F.col("o_lang"))
    return (F.col("o_kind") == "literal") & (own == c.terms[0].o) & V.allowed(F.col("o"), c.terms[0].o)


#: Components that look at a value by itself, as expressions over its term.
VALUE_TESTS = {
    "datatype": _datatype,
    "nodeKind": lambda c: F.col("o_kind").isin(*KINDS[c.terms[0].o]),
    "pattern": _pattern,
    "minLength": lambda c: (F.col("o_kind") != "bnode") & (F.length("o") >= int(c.terms[0].o)),
    "maxLength": lambda c: (F.col("o_kind") != "bnode") & (F.length("o") <= int(c.terms[0].o)),
    "in": lambda c: F.col("v").isin(*[t.name for t in c.terms]) if c.terms else F.lit(False),
    "languageIn": lambda c: (F.col("o_kind") == "literal") & (reduce(lambda a, b: a | b, [V.in_language(F.col("o_lang"), t.o) for t in c.terms]) if c.terms else F.lit(False)),
    "minInclusive": _range(True, True), "maxInclusive": _range(False, True), "minExclusive": _range(True, False), "maxExclusive": _range(False, False),
}
#: Components that compare the values of a path with those of another predicate, or among themselves; only with a path.
SET_COMPONENTS = ("minCount", "maxCount", "uniqueLang", "lessThan", "lessThanOrEquals")
FOUND = ["f", "focus", "path", "value", "severity", "message"]


def failing(triples: DataFrame, shape: Shape, values: DataFrame) -> DataFrame:
    """(v) of the values, nodes as by ``paths``, that don't conform to the shape."""
    begin = values.select(F.col("v").alias("f"), *P.TERM).dropDuplicates(["f"])
    return violations(triples, shape, begin).select(F.col("f").alias("v")).distinct()


def conforming(triples: DataFrame, shapes: Sequence[Shape], values: DataFrame) -> tuple[DataFrame, list[str]]:
    """``values`` with a boolean column a shape: whether the value conforms; and the columns' names."""
    names = []
    for i, s in enumerate(shapes):
        bad = failing(triples, s, values).withColumn(f"bad_{i}", F.lit(True))
        values = values.join(bad, "v", "left").withColumn(f"ok_{i}", F.col(f"bad_{i}").isNull()).drop(f"bad_{i}")
        names.append(f"ok_{i}")
    return values, names


def _counted(held: DataFrame, begin: DataFrame, least: int, most: int | None) -> DataFrame:
    """(f, o): nodes with fewer or more values, and how many."""
    n = held.groupBy("f").agg(F.count("*").alias("n"))
    n = begin.select("f").join(n, "f", "left").withColumn("n", F.coalesce("n", F.lit(0))) if least > 0 else n
    return n.where((F.col("n") < least) | (F.col("n") > most if most is not None else F.lit(False))).select("f", F.col("n").cast("string").alias("o"))


def _not_less(values: DataFrame, other: DataFrame, equal: bool) -> DataFrame:
    """Values that aren't less than all of the other ones: of these, the least of each family is enough."""
    place = V.place(F.col("o"), F.col("o_dt"), F.col("o_lang"))
    order = F.struct(F.col("at.x"), F.col("at.n"), F.col("at.at"), F.col("at.text"))
    kinds = other.select("f", place.alias("at")).groupBy("f", F.col("at.family").alias("family")).agg(F.min(order).alias("least"))
    least = F.struct("family", "least.x", "least.n", "least.at", "least.text")
    less = V.compared(place, least).isin(*([-1, 0] if equal else [-1]))
    return values.join(kinds, "f").where(~F.coalesce(less, F.lit(False))).select("f", "v", "o").distinct().select("f", "o")


def violations(triples: DataFrame, shape: Shape, begin: DataFrame) -> DataFrame:
    """(f, focus, path, value, severity, message) of the nodes ``begin`` that don't conform: f is the node asked, focus the one
    at which a property shape within was asked. ``triples`` are named ones (``paths.named``)."""
    values = begin.withColumn("v", F.col("f")).select("f", *P.TERM) if shape.path is None else P.walk(triples, begin.withColumn("v", F.col("f")), shape.path)
    path = F.lit(None).cast("string") if shape.path is None else F.lit(str(shape.path))
    out: list[DataFrame] = []

    def tell(held: DataFrame, path: Column = path) -> None:
        out.append(held.select("f", F.col("f").alias("focus"), path.alias("path"), F.col("o").alias("value"), F.lit(shape.severity).alias("severity"), F.lit(shape.message).alias("message")))

    tests = [VALUE_TESTS[c.component](c) for c in shape.constraints if c.component in VALUE_TESTS]
    if tests:
        broken = F.aggregate(F.array(*[F.when(F.coalesce(t, F.lit(False)), 0).otherwise(1) for t in tests]), F.lit(0), lambda a, b: a + b)
        tell(values.withColumn("times", broken).where("times > 0").select("f", "o", F.explode(F.array_repeat(F.lit(1), F.col("times")))))
    for c in shape.constraints:
        first = c.terms[0] if c.terms else None
        if c.component == "minCount":
            tell(_counted(values, begin, int(first.o), None))
        elif c.component == "maxCount":
            tell(_counted(values, begin, 0, int(first.o)))
        elif c.component == "hasValue":
            held = values.where(F.col("v") == first.name).select("f").distinct()
            tell(begin.join(held, "f", "left_anti").select("f", F.lit(None).cast("string").alias("o")))
        elif c.component == "class":
            kind = S.focus_nodes(triples, first.o).withColumnRenamed("s", "v")
            tell(values.join(kind, "v", "left_anti"))
        elif c.component == "uniqueLang" and first.o in ("true", "1"):
            tagged = values.where(F.coalesce("o_lang", F.lit("")) != "").groupBy("f", F.lower("o_lang").alias("o")).agg(F.count("*").alias("n"))
            tell(tagged.where("n > 1"))
        elif c.component in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
            other = P.walk(triples, begin.withColumn("v", F.col("f")), P.predicate(first.o))
            if c.component == "equals":
                tell(values.join(other.select("f", "v"), ["f", "v"], "left_anti").unionByName(other.join(values.select("f", "v"), ["f", "v"], "left_anti")))
            elif c.component == "disjoint":
                tell(values.join(other.select("f", "v"), ["f", "v"], "left_semi"))
            else:
                tell(_not_less(values, other, c.component == "lessThanOrEquals"))
        elif c.component == "closed":
            allowed = [t.o for t in c.terms]
            held = triples.where(~F.col("p").isin(*allowed)).select("s", "p", "o") if allowed else triples.select("s", "p", "o")
            tell(values.select("f", F.col("v").alias("s")).join(held, "s"), F.col("p"))
        elif c.component in ("node", "not", "and", "or", "xone"):
            held, names = conforming(triples, c.shapes, values)
            met = sum((F.col(n).cast("int") for n in names), F.lit(0))
            wrong = {"node": met < len(names), "and": met < len(names), "not": met > 0, "or": met == 0, "xone": met != 1}[c.component]
            tell(held.where(wrong))
        elif c.component == "qualified":
            held, names = conforming(triples, [*c.shapes, *c.apart], values)
            good = F.col(names[0]) & ~reduce(lambda a, b: a | b, [F.col(n) for n in names[1:]], F.lit(False))
            tell(_counted(held.where(good), begin, c.least, c.most))
        elif c.component == "property":
            within = violations(triples, c.shapes[0], values.select(F.col("v").alias("f"), *P.TERM).dropDuplicates(["f"]))
            out.append(within if shape.path is None else within.withColumnRenamed("f", "v").join(values.select("f", "v"), "v").select(*FOUND))
    if not out:
        tell(begin.limit(0))
    return reduce(DataFrame.unionByName, out)


def targets_of(triples: DataFrame, shape: Shape) -> DataFrame:
    """The nodes that the shape is asked of by itself."""

    def one(kind: str, value: Term) -> DataFrame:
        if kind == "targetClass":
            return P.nodes(S.focus_nodes(triples, value.o))
        if kind == "targetNode":
            given = [F.lit(x).cast("string").alias(n) for n, x in zip(("f", *P.TERM), (value.name, value.name, value.o, value.kind, value.dt, value.lang), strict=True)]
            return triples.sparkSession.range(1).select(*given)
        held = triples.where(F.col("p") == value.o)
        return P.nodes(held.select("s")) if kind == "targetSubjectsOf" else held.select(F.col("v").alias("f"), *P.TERM)

    parts = [one(k, v) for k, v in shape.targets]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["f"])


def predicates_of(shapes: Sequence[Shape]) -> set[str] | None:
    """The predicates that the shapes and those within them ask for; None for all, as closed shapes do."""
    out = {N.TYPE, N.RDFS + "subClassOf"}
    for s in shapes:
        out |= P.predicates(*([s.path] if s.path else [])) | {t.o for kind, t in s.targets if kind in ("targetSubjectsOf", "targetObjectsOf")}
        for c in s.constraints:
            within = predicates_of([*c.shapes, *c.apart])
            if c.component == "closed" or within is None:
                return None
            out |= within | ({c.terms[0].o} if c.component in ("equals", "disjoint", "lessThan", "lessThanOrEquals") else set())
    return out


def validate_shapes(triples: DataFrame, shapes: Sequence[Shape]) -> DataFrame:
    """Results (schema.RESULTS) of the shapes with targets, under the name of the shape that has them; and of the profile's rules among them.

    What the shapes ask for is stored once, as each target, path and comparison reads it."""
    own = [s for s in shapes if not s.rule]
    asked = predicates_of(own)
    graph = P.named(triples if asked is None else triples.where(F.col("p").isin(*sorted(asked))))
    graph = stored(graph) if own else graph
    parts = [S.validate(triples, [s.rule for s in shapes if s.rule])]
    for shape in own:
        found = violations(graph, shape, targets_of(graph, shape))
        parts.append(found.select("severity", "message", F.lit(shape.iri).alias("ruleName"), F.col("focus").alias("focusNodeUri"), F.col("path").alias("resultPathUri"), "value"))
    return reduce(DataFrame.unionByName, parts)


def implied_class(told: Sequence[Term]) -> bool:
    """Whether a shape of these types is a class as well, whose instances are its targets."""
    return any(t.o in (N.RDFS + "Class", N.OWL + "Class") for t in told)
