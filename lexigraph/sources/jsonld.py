"""JSON-LD documents as triples: terms are looked up in the document's contexts and the tree is laid flat.

A document is read by a small helper, a file at a time; documents that are written a node a line, as ``sinks/documents.py``
does, are read a line at a time. Nothing is fetched: contexts named by address are given by the caller (``CONTEXTS``)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.sinks import documents as D
from lexigraph.sources.rdf import CHECKED, Reader, read_checked

ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
#: Keywords of the format that are read; a document with others is refused.
KEYWORDS = {"@context", "@id", "@type", "@value", "@language", "@list", "@set", "@graph", "@reverse", "@index", "@vocab", "@base", "@container", "@none", "@version"}


@dataclass(frozen=True)
class Term:
    iri: str | None
    kind: str | None = None  # @id, @vocab or a datatype
    container: str | None = None
    language: str | None = None
    own_language: bool = False  # whether the term says its language, if only none
    reverse: bool = False
    within: object = None  # the context of what the term holds


@dataclass(frozen=True)
class Context:
    terms: dict[str, Term] = field(default_factory=dict)
    base: str = ""
    vocab: str | None = None
    language: str | None = None

    def address(self, value: str, as_term: bool = False) -> str | None:
        """The IRI or keyword that a name means, None if none."""
        if value in KEYWORDS or re.fullmatch("@[A-Za-z]+", value):
            return value
        if as_term and value in self.terms:
            return self.terms[value].iri
        prefix, colon, rest = value.partition(":")
        if colon:
            if prefix == "_" or rest.startswith("//"):
                return value
            return self.terms[prefix].iri + rest if prefix in self.terms and self.terms[prefix].iri else value
        if as_term:
            return self.vocab + value if self.vocab is not None else None
        return urljoin(self.base, value) if self.base else value

    def term(self, key: str) -> Term:
        return self.terms.get(key) or Term(self.address(key, True))


def with_context(active: Context, local: object, known: dict[str, object], seen: frozenset[str] = frozenset()) -> Context:
    """``active`` as a document's @context changes it."""
    if local is None:
        return Context(base=active.base)
    if isinstance(local, list):
        for part in local:
            active = with_context(active, part, known, seen)
        return active
    if isinstance(local, str):
        if local not in known or local in seen:
            raise ValueError(f"the context {local} isn't known")
        held = known[local]
        return with_context(active, held.get("@context", held) if isinstance(held, dict) else held, known, seen | {local})
    if not isinstance(local, dict):
        raise ValueError("a context is an address, an object or a list of them")
    out = replace(active, terms=dict(active.terms))
    if "@base" in local:
        out = replace(out, base=urljoin(out.base, local["@base"]) if local["@base"] else "")
    if "@vocab" in local:
        out = replace(out, vocab=out.address(local["@vocab"], True) if local["@vocab"] else None)
    if "@language" in local:
        out = replace(out, language=local["@language"])
    # A term may be defined by another one that comes later, so definitions are taken up until none changes.
    for _ in range(len(local) + 1):
        before = dict(out.terms)
        for key, told in local.items():
            if not key.startswith("@"):
                out.terms[key] = _defined(out, key, told)
        if out.terms == before:
            return out
    raise ValueError("terms that are defined by each other")


def _defined(context: Context, key: str, told: object) -> Term:
    if told is None:
        return Term(None)
    if isinstance(told, str):
        return Term(context.address(told, True) if told != key else _without(context, key))
    if not isinstance(told, dict) or told.keys() - {"@id", "@type", "@container", "@language", "@reverse", "@protected", "@index", "@context"}:
        raise ValueError(f"the definition of {key} isn't read")
    name = told.get("@reverse", told.get("@id", key))
    iri = None if name is None else context.address(name, True) if name != key else _without(context, key)
    container = [c for c in (told["@container"] if isinstance(told.get("@container"), list) else [told.get("@container")]) if c and c != "@set"]
    if len(container) > 1 or container and container[0] not in ("@list", "@language", "@index"):
        raise ValueError(f"the container of {key} isn't read")
    kind = told.get("@type")
    kind = context.address(kind, True) if kind and kind not in ("@id", "@vocab", "@none") else kind
    return Term(iri, kind, container[0] if container else None, told.get("@language"), "@language" in told, "@reverse" in told, told.get("@context"))


def _without(context: Context, key: str) -> str | None:
    """The IRI of a name that isn't looked up as a term itself."""
    return replace(context, terms={k: v for k, v in context.terms.items() if k != key}).address(key, True)


class Walk(Reader):
    """Rows of one document; blank nodes are named as the other readers do."""

    def __init__(self, graph: str, known: dict[str, object]):
        super().__init__("", graph)
        self.known = known

    def named(self, iri: str) -> tuple:
        return (self.blank(iri), "bnode", None, None) if iri.startswith("_:") else (iri, "iri", None, None)

    def node(self, value: dict, context: Context) -> tuple | None:
        """The term of a node object, whose facts become rows. A list or set within a set has none."""
        if "@context" in value:
            context = with_context(context, value["@context"], self.known)
        keys = {k: context.address(k, True) for k in value}
        if strange := [k for k in keys.values() if k and k.startswith("@") and k not in KEYWORDS]:
            raise ValueError(f"{strange[0]} isn't read")
        names = [v for k, v in value.items() if keys[k] == "@id"]
        if names and not isinstance(names[0], str):
            raise ValueError("an @id is a text")
        only_graph = set(keys.values()) - {"@context"} == {"@graph"}
        s = self.named(context.address(names[0])) if names else None if only_graph else (self.blank(), "bnode", None, None)
        for key, held in value.items():
            name = keys[key]
            if name == "@type":
                for kind in held if isinstance(held, list) else [held]:
                    if (iri := context.address(kind, True)) is not None:
                        self.add(s, N.TYPE, self.named(iri))
            elif name == "@graph":
                for x in held if isinstance(held, list) else [held]:
                    self.node(x, context)
            elif name == "@reverse":
                for back, nodes in held.items():
                    for x in nodes if isinstance(nodes, list) else [nodes]:
                        if (p := context.address(back, True)) and ABSOLUTE.match(p):
                            self.add(self.value(x, context, context.term(back)), p, s)
            elif name and not name.startswith("@") and ABSOLUTE.match(name):
                self.facts(s, name, held, context, context.term(key))
        return s

    def facts(self, s: tuple, p: str, held: object, context: Context, term: Term) -> None:
        if term.container == "@language" and isinstance(held, dict):
            for tag, texts in held.items():
                for text in texts if isinstance(texts, list) else [texts]:
                    if text is not None:
                        self.add(s, p, (text, "literal", None, None if tag == "@none" else tag))
            return
        if term.container == "@index" and isinstance(held, dict):
            held = [x for v in held.values() for x in (v if isinstance(v, list) else [v])]
        if term.container == "@list":
            held = {"@list": held["@list"] if isinstance(held, dict) and "@list" in held else held}
        for x in self.flat(held):
            o = self.value(x, context, term)
            if o is not None:
                self.add(o, p, s) if term.reverse else self.add(s, p, o)

    def flat(self, held: object) -> Iterator[object]:
        if isinstance(held, list):
            for x in held:
                yield from self.flat(x)
        elif isinstance(held, dict) and "@set" in held:
            yield from self.flat(held["@set"])
        elif held is not None:
            yield held

    def value(self, x: object, context: Context, term: Term) -> tuple | None:
        if isinstance(x, dict):
            context = with_context(context, term.within, self.known) if term.within is not None else context
            keys = {context.address(k, True): k for k in x}
            if "@list" in keys:
                items = [o for o in (self.value(i, context, term) for i in self.flat(x[keys["@list"]])) if o is not None]
                last = (N.RDF + "nil", "iri", None, None)
                for o in items[::-1]:
                    cell = (self.blank(), "bnode", None, None)
                    self.add(cell, N.RDF + "first", o)
                    self.add(cell, N.RDF + "rest", last)
                    last = cell
                return last
            if "@value" in keys:
                told = x[keys["@value"]]
                if told is None:
                    return None
                kind = x.get(keys.get("@type"))
                return self.literal(told, context.address(kind, True) if kind else None, x.get(keys.get("@language")))
            return self.node(x, context)
        if isinstance(x, str) and (term.reverse or term.kind in ("@id", "@vocab")):  # what a reverse term holds is a node
            return self.named(context.address(x, term.kind == "@vocab") or context.address(x))
        kind = term.kind if term.kind and not term.kind.startswith("@") else None
        language = term.language if term.own_language else context.language
        return self.literal(x, kind, None if kind or not isinstance(x, str) else language)

    def literal(self, x: object, kind: str | None, language: str | None) -> tuple:
        if isinstance(x, bool):
            return ("true" if x else "false", "literal", kind or N.XSD + "boolean", None)
        if isinstance(x, (int, float)):
            whole = float(x).is_integer() and abs(x) < 1e21 and kind != N.XSD + "double"
            text = str(int(x)) if whole else re.sub(r"(\.\d*?)0*E([+-])0*(\d+)", lambda m: (m[1] if len(m[1]) > 1 else m[1] + "0") + "E" + m[2].strip("+") + m[3], f"{float(x):.15E}")
            return (text, "literal", kind or N.XSD + ("integer" if whole else "double"), None)
        if not isinstance(x, str):
            raise ValueError("a value is a text, a number or true or false")
        return (x, "literal", kind, language)


def statements(text: str, graph: str, known: dict[str, object] | None = None, context: object = None, base: str = "") -> list[tuple]:
    """Rows of a JSON-LD text; ``known`` are contexts by address, ``context`` one that applies before the text's own. ValueError if it can't be read."""
    read = json.loads(text.removeprefix("﻿"))
    walk = Walk(graph, CONTEXTS | (known or {}))
    begin = Context(base=base)
    begin = with_context(begin, context, walk.known) if context is not None else begin
    for x in read if isinstance(read, list) else [read]:
        if not isinstance(x, dict):
            raise ValueError("a document is an object or a list of objects")
        walk.node(x, begin)
    return list(dict.fromkeys(walk.rows))


def export_context() -> dict[str, object]:
    """The context of the documents that ``sinks/documents.py`` writes: its fields as predicates."""
    link = lambda p: {"@id": p, "@type": "@id"}
    title = {"název": {"@id": N.DCT + "title", "@container": "@language"}}
    kinds = {label: N.OFN + kind for kind, label in N.TYPE_LABELS.items()}
    return {
        "iri": "@id", "typ": "@type", "pojmy": {"@reverse": N.SKOS + "inScheme"}, "Slovník": N.OFN + "slovník", "Tezaurus": N.SKOS + "ConceptScheme", "Konceptuální model": N.OWL + "Ontology", "Digitální objekt": N.DIGITAL_OBJECT,
        **kinds, **{k: {"@id": p, "@container": "@language"} for k, p in (D.TEXT_FIELDS | {D.ALT_NAME: N.SKOS + "altLabel"}).items()}, **{k: link(paths[0]) for k, (paths, _) in D.IRI_FIELDS.items()},
        D.PPDF_FIELD: {"@id": D.PPDF_PATHS[0], "@type": N.XSD + "boolean"}, **{k: {"@id": p, "@context": title} for k, p in D.OBJECT_FIELDS.items()}, "url": {"@id": N.SCHEMA_URL, "@type": N.XSD + "anyURI"},
    }


#: Contexts by address that documents may name.
CONTEXTS: dict[str, object] = {D.CONTEXT: export_context()}


def read_jsonld(spark: SparkSession, path: str, known: dict[str, object] | None = None) -> DataFrame:
    """Triples of JSON-LD files; each file is a graph by its path. A file that can't be read gives no rows here, but one of ``jsonld_errors``."""
    return read_checked(spark, path, lambda text, where: statements(text, where, known)).where("error IS NULL").drop("error")


def jsonld_errors(spark: SparkSession, path: str, known: dict[str, object] | None = None) -> DataFrame:
    """(path, error) for every JSON-LD file that can't be read."""
    return read_checked(spark, path, lambda text, where: statements(text, where, known)).where("error IS NOT NULL").select(F.col("graph_id").alias("path"), "error")


def read_objects(objects: DataFrame, column: str = "object", context: object = None) -> DataFrame:
    """Triples of a column of JSON-LD objects, a node a row, with ``context`` (by default that of the exports) and ``error`` where one can't be read.

    So a document of any size is read in as many tasks as its lines are in; blank nodes belong to their object."""
    context = context or export_context()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch[column]:
                try:
                    rows += [(*r, None) for r in statements(text, text, context=context)]
                except (ValueError, TypeError, AttributeError, KeyError, RecursionError) as e:
                    rows.append((text[:100], *[None] * 7, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=CHECKED.names, dtype=object)

    return objects.where(F.col(column).isNotNull()).select(column).mapInPandas(split, CHECKED)


def object_lines(spark: SparkSession, path: str) -> DataFrame:
    """(object): the concepts of a document that was written a concept a line (``documents.jsonld_lines``)."""
    line = F.regexp_replace("value", r"^,", "")
    return spark.read.text(path).where(F.col("value").startswith("{\"iri\"") | F.col("value").startswith(",{")).where(~F.col("value").startswith('{"@context"')).select(line.alias("object"))
