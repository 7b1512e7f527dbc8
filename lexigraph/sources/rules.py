"""Constraint shapes from Turtle files. The files are small and are read on the driver; what they ask is checked by joins
(``operators/shacl.py``).

Every subject with a target is a shape, with or without a type; a shape with sh:path is a property shape. Shapes whose
constraint is query text are taken over only where their IRI is that of a rule of the profile. A shape with anything that isn't
taken over, or that leads back to itself, is left out whole and named in ``skipped``, as half of a shape would give
other answers. A property shape or branch without a severity or message of its own has those of the shape around it.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexigraph.functions import names as N
from lexigraph.operators import paths as P
from lexigraph.operators import shapes as S
from lexigraph.operators.shacl import KINDS, SET_COMPONENTS, SH, VALUE_TESTS, Constraint, Shape, Term, implied_class, validate_shapes
from lexigraph.sources.rdf import read_turtle

#: Largest number of triples that rule files may have.
MAX_RULE_TRIPLES = 100_000
SEVERITIES = {SH + "Violation": "ERROR", SH + "Warning": "WARNING", SH + "Info": "INFO"}
TARGETS = ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf")
#: Components whose value is one term, and those whose value is a shape or a list of shapes.
TERMS = {*VALUE_TESTS, *SET_COMPONENTS, "hasValue", "class", "equals", "disjoint"}
WITHIN, LISTED = ("node", "not", "property"), ("and", "or", "xone")
QUALIFIED = ("qualifiedValueShape", "qualifiedMinCount", "qualifiedMaxCount", "qualifiedValueShapesDisjoint")
#: What a shape may hold besides components.
PLAIN = {"path", "flags", "severity", "message", "name", "description", "order", "group", "deactivated", "prefixes", "defaultValue", "closed", "ignoredProperties", *TARGETS, *QUALIFIED}


@dataclass
class RuleSet:
    shapes: list[Shape]
    skipped: list[str]


class NotTaken(ValueError):
    """What of a shape isn't taken over."""


class Reader:
    """The shapes of one set of triples."""

    def __init__(self, rows: list) -> None:
        self.told: dict[str, dict[str, list[Term]]] = defaultdict(lambda: defaultdict(list))
        for r in rows:
            self.told[r["s"]][r["p"]].append(Term(r["o"], r["o_kind"], r["o_dt"], r["o_lang"]))

    def held(self, node: str, name: str) -> list[Term]:
        return self.told[node].get(SH + name, []) if node in self.told else []

    def items(self, node: str) -> list[Term]:
        out, seen = [], set()
        while node != N.RDF + "nil":
            first, rest = (self.told[node].get(N.RDF + x, []) if node in self.told else [] for x in ("first", "rest"))
            if len(first) != 1 or len(rest) != 1 or node in seen:
                raise NotTaken("a list that isn't one")
            seen.add(node)
            out += first
            node = rest[0].o
        return out

    def path(self, node: Term, seen: frozenset[str] = frozenset()) -> P.Path:
        told = self.told.get(node.o, {})
        if node.kind == "iri":
            return P.predicate(node.o)
        if node.kind != "bnode" or node.o in seen:
            raise NotTaken("path")
        seen |= {node.o}
        if N.RDF + "first" in told:
            return P.sequence(*[self.path(x, seen) for x in self.items(node.o)])
        one = lambda name: self.path(told[SH + name][0], seen)
        if SH + "inversePath" in told:
            return P.inverse(one("inversePath"))
        if SH + "alternativePath" in told:
            return P.alternative(*[self.path(x, seen) for x in self.items(told[SH + "alternativePath"][0].o)])
        for name, make in (("zeroOrMorePath", P.repeated), ("oneOrMorePath", lambda p: P.repeated(p, 1)), ("zeroOrOnePath", P.at_most_once)):
            if SH + name in told:
                return make(one(name))
        raise NotTaken("path")

    def true(self, node: str, name: str) -> bool:
        return any(t.o in ("true", "1") for t in self.held(node, name))

    def shape(self, node: Term, severity: str = "ERROR", message: str = "", around: tuple[str, ...] = ()) -> Shape:
        """A shape with all that it refers to; NotTaken tells the first part that can't be taken over."""
        if node.kind == "literal":
            raise NotTaken("a literal instead of a shape")
        if node.o in around:
            raise NotTaken("recursion")
        inner, held = (*around, node.o), self.told.get(node.o, {})
        severity = SEVERITIES.get(next((t.o for t in self.held(node.o, "severity")), ""), severity)
        message = next(iter(sorted(t.o for t in self.held(node.o, "message"))), message)
        out = Shape(node.o, severity, message, targets=[(kind, t) for kind in TARGETS for t in self.held(node.o, kind)])
        if implied_class(held.get(N.TYPE, [])) and not node.o.startswith("_:"):
            out.targets.append(("targetClass", node))
        paths = self.held(node.o, "path")
        if len(paths) > 1:
            raise NotTaken("path")
        out.path = self.path(paths[0]) if paths else None
        if self.true(node.o, "deactivated"):
            return out
        sub = lambda t: self.shape(t, severity, message, inner)
        flags = "".join(t.o for t in self.held(node.o, "flags"))
        for p in sorted(held):
            name = p.removeprefix(SH)
            if not p.startswith(SH) or name in PLAIN:
                continue
            if name in ("minCount", "maxCount", *SET_COMPONENTS) and not paths:
                raise NotTaken(name)
            for t in held[p]:
                if name in ("in", "languageIn"):
                    out.constraints.append(Constraint(name, self.items(t.o)))
                elif name in TERMS:
                    out.constraints.append(Constraint(name, [self.checked(name, t)], flags=flags))
                elif name in WITHIN:
                    out.constraints.append(Constraint(name, shapes=[sub(t)]))
                elif name in LISTED:
                    out.constraints.append(Constraint(name, shapes=[sub(x) for x in self.items(t.o)]))
                else:
                    raise NotTaken(name)
        for t in self.held(node.o, "qualifiedValueShape"):
            least, most = (next((int(self.checked("minCount", x).o) for x in self.held(node.o, n)), None) for n in QUALIFIED[1:3])
            apart = [sub(x) for x in self.siblings(node.o) if x != t] if self.true(node.o, "qualifiedValueShapesDisjoint") else []
            out.constraints.append(Constraint("qualified", shapes=[sub(t)], least=least or 0, most=most, apart=apart))
        if self.true(node.o, "closed"):
            own = [path for p in self.held(node.o, "property") for path in self.held(p.o, "path") if path.kind == "iri"]
            out.constraints.append(Constraint("closed", own + [x for lst in self.held(node.o, "ignoredProperties") for x in self.items(lst.o)]))
        return out

    def checked(self, name: str, t: Term) -> Term:
        """A component's term, refused where the component can't be asked with it."""
        if name in ("minCount", "maxCount", "minLength", "maxLength") and not t.o.lstrip("+").isdigit() or name == "nodeKind" and t.o not in KINDS:
            raise NotTaken(name)
        return t

    def siblings(self, node: str) -> list[Term]:
        """Qualified shapes of the property shapes beside this one."""
        beside = [p.o for s in self.told for props in [self.held(s, "property")] if any(p.o == node for p in props) for p in props]
        return list(dict.fromkeys(t for p in beside for t in self.held(p, "qualifiedValueShape")))


def load_rules(spark: SparkSession, path: str) -> RuleSet:
    """The shapes with targets of the Turtle files at ``path``."""
    rows = read_turtle(spark, path).select("s", "p", "o", "o_kind", "o_dt", "o_lang").limit(MAX_RULE_TRIPLES + 1).collect()
    if len(rows) > MAX_RULE_TRIPLES:
        raise ValueError("these are too many triples for rules")
    reader, rules = Reader(rows), {r.iri: k for k, r in S.RULES.items()}
    shapes, skipped = [], []
    for s in sorted(reader.told):
        held = reader.told[s]
        typed = any(t.o in (SH + "NodeShape", SH + "PropertyShape") for t in held.get(N.TYPE, []))
        if not typed and not any(SH + kind in held for kind in TARGETS) or reader.true(s, "deactivated"):
            continue
        if SH + "sparql" in held or SH + "select" in held:
            if s in rules:
                shapes.append(Shape(s, rule=rules[s]))
            else:
                skipped.append(f"{s}: a query")
            continue
        try:
            shape = reader.shape(Term(s, "bnode" if s.startswith("_:") else "iri"))
        except NotTaken as e:
            skipped.append(f"{s}: {e}")
            continue
        if shape.targets:
            shapes.append(shape)
    return RuleSet(shapes, skipped)


def validate_with(triples: DataFrame, rules: RuleSet) -> DataFrame:
    """Results of loaded rules: a row a violating value, or a node where a count, a missing value or the logic over other shapes isn't met."""
    return validate_shapes(triples, rules.shapes)
