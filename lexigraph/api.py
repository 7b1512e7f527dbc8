"""From a file to a graph, its validation results and its documents: what a service would call, without the service."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.functions import terms as T
from lexigraph.operators import graph as G
from lexigraph.operators import report as R
from lexigraph.operators import shapes as S
from lexigraph.operators.hierarchy import cut, inherited_domains
from lexigraph.plans import lift as L
from lexigraph.schema import CLASSES, HIERARCHIES, PROPERTIES, RELATIONSHIPS, TRIPLES, VOCABULARY
from lexigraph.sinks import documents as D
from lexigraph.sources import archimate, formats, jsonld, rdf, xlsx, xmi
from lexigraph.sources import rules as rule_sets


@dataclass(frozen=True)
class Conversion:
    """A converted input: its triples, which are stored, the results of the rules on them, and what couldn't be read."""

    triples: DataFrame
    results: DataFrame
    errors: DataFrame

    namespace: str = N.DEFAULT_NS

    def groups(self) -> DataFrame:
        return R.severity_groups(self.results)

    def csv(self) -> DataFrame:
        return R.normalised(R.csv_rows(self.results, S.focus_nodes(self.triples, N.OFN + N.CONCEPT)))

    def published(self) -> DataFrame:
        """The published form of the graph: what the namespace says and leads to."""
        return L.export_triples(self.triples, self.namespace)

    def write_turtle(self, path: str) -> None:
        D.write_turtle(self.published(), path)

    def write_jsonld(self, path: str, name: str) -> None:
        D.write_lines(D.jsonld_lines(self.triples, self.namespace, name), path)

    def catalog(self) -> DataFrame:
        """(name, record): the catalogue records of the graph's vocabularies; none if there is an error."""
        records = D.catalog_record(D.vocabulary_metadata(self.triples))
        return records if self.may_publish() else records.limit(0)

    def may_publish(self) -> bool:
        return R.may_publish(self.results)


def _full(records: DataFrame, schema) -> DataFrame:
    more = ["model"] if "model" in records.columns else []
    return records.select(*more, *[F.col(f.name) if f.name in records.columns else F.lit(None).cast("string").alias(f.name) for f in schema])


def _in_vocabulary(records: DataFrame, about: DataFrame | None, namespace: str, vocabulary: str) -> DataFrame:
    """``records`` with the __namespace and __vocabulary of their model."""
    if about is None or "model" not in records.columns:
        return records.withColumns({"__namespace": F.lit(namespace), "__vocabulary": F.lit(vocabulary)})
    return records.join(about, "model", "left").withColumns({"__namespace": F.coalesce("__namespace", F.lit(namespace)), "__vocabulary": F.coalesce("__vocabulary", F.lit(vocabulary))})


def records_to_triples(records: dict[str, DataFrame], namespace: str = N.DEFAULT_NS, vocabulary: str = "slovník", graph_id: str = "g", without: str | None = None) -> DataFrame:
    """Triples of the record sets: every record gets its IRI, names are resolved among all kinds, later kinds first.

    Properties without a domain have that of their nearest super-property. Records whose identifier matches ``without`` go, and with
    them the relations that lead to them. The records of a kind are stored with their IRIs, as they are read several times. Records
    with a ``model`` are resolved among the records of their model, and get their IRIs by the namespace and name
    of its row in ``vocabulary``, if there is one; ``namespace`` and ``vocabulary`` serve the others."""
    keys = ("model",) if all("model" in r.columns for k, r in records.items() if k != "vocabulary") else ()
    if "hierarchies" in records and "properties" in records:
        records = records | {"properties": inherited_domains(records["properties"], records["hierarchies"], keys)}
    if without:
        held = [_full(records[k], schema).select(*keys, "name", "identifier") for k, schema in (("classes", CLASSES), ("properties", PROPERTIES)) if k in records]
        lookup = G.union_bag(*held).where("identifier is not null").dropDuplicates([*keys, "name"])
        gone = {"classes": {}, "properties": {"softened": ("domain",)}, "relationships": {"references": ("domain", "range")}, "hierarchies": {"own": "relationshipId", "references": ("subClass", "superClass")}}
        full = {"classes": CLASSES, "properties": PROPERTIES, "relationships": RELATIONSHIPS, "hierarchies": HIERARCHIES}
        records = records | {k: L.without_filtered(_full(records[k], full[k]).fillna("", ["relationshipId" if k == "hierarchies" else "identifier"]), lookup, without, keys=keys, **how) for k, how in gone.items() if k in records}
    about = None
    if "vocabulary" in records and "model" in records["vocabulary"].columns:
        told = _full(records["vocabulary"], VOCABULARY)
        about = told.select("model", T.effective_namespace(F.col("namespace")).alias("__namespace"), F.when(~T.blank(F.col("name")), F.col("name")).alias("__vocabulary")).dropDuplicates(["model"])
    named = {}
    for kind, schema in (("classes", CLASSES), ("properties", PROPERTIES), ("relationships", RELATIONSHIPS)):
        if kind in records:
            held = _in_vocabulary(L.valid_rows(_full(records[kind], schema), "name"), about, namespace, vocabulary)
            named[kind] = cut(held.withColumn("iri", T.concept_iri(F.col("__namespace"), F.col("__vocabulary"), F.col("name"), F.col("identifier"))))
    lookup = L.last_wins(*named.values())
    parts = [L.class_triples(named["classes"], graph_id=graph_id)]
    if "properties" in named:
        parts.append(L.property_triples(named["properties"], lookup, graph_id=graph_id))
    if "relationships" in named:
        parts.append(L.relationship_triples(named["relationships"], lookup, graph_id=graph_id))
    if "hierarchies" in records:
        parts.append(L.hierarchy_triples(records["hierarchies"], lookup, named.get("properties"), graph_id=graph_id))
    if about is not None:
        scheme = _in_vocabulary(_full(records["vocabulary"], VOCABULARY), about, namespace, vocabulary).withColumn("iri", T.vocabulary_iri(F.col("__namespace"), F.col("__vocabulary")))
        parts += [D.scheme_triples(scheme, F.col("iri"), graph_id=graph_id), L.temporal_triples(scheme, F.col("iri"), graph_id=graph_id)]
    return G.graph(G.union_bag(*parts))


READERS: dict[str, Callable[..., DataFrame]] = {
    "ARCHI_XML": lambda spark, path, without=None: records_to_triples(archimate.read_archimate(spark, path), without=without),
    "XMI": lambda spark, path, without=None: records_to_triples(xmi.read_xmi(spark, path), without=without),
    "XLSX": lambda spark, path, without=None: records_to_triples(xlsx.read_xlsx(spark, path), without=without),
    "TURTLE": lambda spark, path, without=None: rdf.read_turtle(spark, path),
    "N-TRIPLES": lambda spark, path, without=None: rdf.read_ntriples(spark, path),
    "RDF/XML": lambda spark, path, without=None: rdf.read_rdfxml(spark, path),
    "JSON-LD": lambda spark, path, without=None: jsonld.read_jsonld(spark, path),
}
#: What tells in rows (path, error) which inputs, or parts of them, couldn't be read.
ERRORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ARCHI_XML": formats.xml_errors, "XMI": formats.xml_errors, "XLSX": xlsx.workbook_errors, "TURTLE": rdf.turtle_errors, "N-TRIPLES": rdf.ntriples_errors, "RDF/XML": rdf.rdfxml_errors, "JSON-LD": jsonld.jsonld_errors,
}


def convert(
    spark: SparkSession, path: str, kind: str | None = None, rules: list[str] | None = None, rule_files: str | None = None, without: str | None = None, namespace: str = N.DEFAULT_NS, declare: bool = False
) -> Conversion:
    """Reads the files at ``path`` and validates their graph, with the profile's rules (or the named ones) or with those of Turtle files.

    ``kind`` is the files' format; without it each file's own is found out, and the folder may hold several. Files over the size limit,
    of no known format or that can't be read are told in ``errors``. Records whose identifier matches ``without`` are left out. With
    ``declare`` the profile's classes and predicates that the graph uses are declared in it, and its concepts put into the scheme ``namespace``."""
    if kind is not None and kind not in READERS:
        raise ValueError(f"no reader for {kind}: one of {', '.join(READERS)}")
    nothing = spark.createDataFrame([], "path string, error string")
    if kind is None:
        found = formats.inputs(spark, path).select("path", "format", "error").collect()
        refused = [(r["path"], r["error"] or f"no reader for the format {r['format']}") for r in found if r["format"] not in READERS]
        paths = {k: sorted(r["path"] for r in found if r["format"] == k) for k in READERS}
        errors = [spark.createDataFrame(refused, nothing.schema)] if refused else [nothing]
    else:
        paths, errors = {kind: [path]}, [nothing]
        if kind not in ("ARCHI_XML", "XMI"):  # these tell it themselves
            errors.append(formats.oversized(spark, path))
    parts = [READERS[k](spark, p if kind is None else path, without) for k, p in paths.items() if p]
    errors += [ERRORS[k](spark, p if kind is None else path) for k, p in paths.items() if p]
    triples = G.union_bag(*parts) if parts else spark.createDataFrame([], TRIPLES)
    if kind is not None and kind not in ("ARCHI_XML", "XMI"):
        triples = triples.join(errors[1].select(F.col("path").alias("graph_id")), "graph_id", "left_anti").select(*TRIPLES.names)
    if declare:
        triples = G.union_bag(triples, L.base_schema(triples), L.in_scheme(triples, namespace))
    triples = cut(triples)  # read by the rules and by every document
    make = lambda: rule_sets.validate_with(triples, rule_sets.load_rules(spark, rule_files)) if rule_files else S.validate(triples, rules)
    return Conversion(triples, make(), G.union_bag(*errors).distinct(), namespace)


def validate_text(spark: SparkSession, text: str) -> DataFrame:
    """Results of the rules on a Turtle text of at most the size limit."""
    if not text or not text.strip():
        raise ValueError("there is no content")
    if len(text.encode()) > 5_242_880:
        raise ValueError("the content is larger than 5 MB")
    return S.validate(spark.createDataFrame(rdf.statements(text, "text"), TRIPLES))


def output_format(wanted: str | None, accept: str | None) -> str:
    """The format asked for, else what the Accept header holds, else json."""
    return wanted.strip().lower() if wanted and wanted.strip() else "turtle" if accept and ("turtle" in accept or "ttl" in accept) else "json"


def report_name(base: str, extension: str, now: str | None = None) -> str:
    moment = datetime.fromisoformat(now) if now else datetime.now()
    return f"{base}_{moment:%Y-%m-%d_%H-%M-%S}.{extension}"


def fetchable(url: str) -> bool:
    """True for an https address of a public host; raises otherwise."""
    parts = urlparse(url)
    if parts.scheme != "https" or not parts.hostname or parts.hostname == "localhost" or (parts.port or 443) != 443:
        raise ValueError("only public https addresses can be fetched")
    try:
        address = ipaddress.ip_address(parts.hostname)
    except ValueError:  # a name
        return True
    if not address.is_global:
        raise ValueError("private addresses can't be fetched")
    return True


def rule_summary(enabled: dict[str, bool] | None = None) -> dict:
    held = [k for k in S.RULES if (enabled or {}).get(k, True)]
    return {"total": len(S.RULES), "enabled": len(held), "names": held}
