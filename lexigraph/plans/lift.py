"""From record sets (see schema) to triples. Every step is a projection and one explode over the records; names are
looked up by joins. Blank nodes are named by a hash of what they say, so that graphs compare as sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.functions import terms as T
from lexigraph.operators import graph as G

IRI, BNODE, LITERAL = "iri", "bnode", "literal"


def text(x: str | Column | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def fact(p: str | Column, o: Column, kind: str | Column = LITERAL, dt: str | Column | None = None, lang: str | Column | None = None, s: Column | None = None) -> Column:
    """A triple as struct, null where ``o`` is null or blank; ``s`` names another subject (a blank node) than the record."""
    row = F.struct(
        text(s).alias("s"), text(IRI if s is None else BNODE).alias("s_kind"), text(p).alias("p"), o.cast("string").alias("o"), text(kind).alias("o_kind"), text(dt).alias("o_dt"), text(lang).alias("o_lang")
    )
    return F.when(~T.blank(o.cast("string")), row)


def told(records: DataFrame, iri: Column, *facts: Column, lists: Sequence[Column] = (), graph_id: str = "g") -> DataFrame:
    """Triples of the records, in one pass: from the facts and from arrays of facts. Subjects without a name of their own are
    ``iri``; records with a ``model`` have it as their graph."""
    every = F.filter(F.concat(F.array(*facts), *lists) if facts else F.concat(*lists), lambda x: x.isNotNull())
    graph = F.col("model") if "model" in records.columns else F.lit(graph_id)
    rows = records.select(graph.alias("__graph"), iri.alias("__s"), F.explode(every).alias("f"))
    return rows.select(F.col("__graph").alias("graph_id"), F.coalesce("f.s", "__s").alias("s"), *[F.col(f"f.{c}").alias(c) for c in ("s_kind", "p", "o", "o_kind", "o_dt", "o_lang")])


def list_facts(p: str, parts: Column, kind: str = LITERAL, lang: str | None = None) -> Column:
    """A fact for each part of a list."""
    return F.transform(parts, lambda v: fact(p, v, kind, lang=lang))


def listed(records: DataFrame, iri: Column, p: str, parts: Column, kind: str = LITERAL, lang: str | None = None, graph_id: str = "g") -> DataFrame:
    return told(records, iri, lists=[list_facts(p, parts, kind, lang)], graph_id=graph_id)


def common_facts() -> list[Column]:
    return [
        fact(N.TYPE, F.lit(N.OFN + N.CONCEPT), IRI),
        fact(N.SKOS + "prefLabel", F.col("name"), lang="cs"),
        fact(N.DCT + "description", F.col("description"), lang="cs"),
        fact(N.SKOS + "definition", F.col("definition"), lang="cs"),
    ]


def public_facts(namespace: str = N.DEFAULT_NS) -> list[Column]:
    """Type by publicity and, for non-public data, the provision that says so (only addresses of laws)."""
    kind = T.public_kind(F.col("isPublic"), F.col("privacyProvision"))
    return [fact(N.TYPE, F.concat(F.lit(N.OFN), kind), IRI), fact(namespace + N.PROVISION, F.when(kind == N.NON_PUBLIC, T.eli_iri(F.trim("privacyProvision"))), IRI)]


def governance_facts() -> list[Column]:
    out = []
    for field, (predicate, codes) in N.GOVERNANCE.items():
        allowed = F.lower(F.col(field)).isin(*N.GOVERNANCE_VALUES)
        out.append(fact(predicate, F.when(allowed, F.concat(F.lit(codes), T.sanitize_iri(F.trim(field)))), IRI))
    return out


def source_facts(iri: Column, field: str, law: str, other: str, namespace: str = N.DEFAULT_NS) -> Column:
    """Facts on the sources of a ;-list: addresses of laws as IRIs; other sources as digital objects with an address or a title."""

    def one(v: Column) -> Column:
        doc, url = F.concat(F.lit("_:"), F.sha2(F.concat_ws("|", iri, F.lit(other), v), 256)), T.is_uri(v)
        about = fact(F.when(url, N.SCHEMA_URL).otherwise(N.DCT + "title"), v, LITERAL, F.when(url, N.XSD + "anyURI"), F.when(~url, "cs"), s=doc)
        named = T.eli_iri(v)
        return F.when(named.isNotNull(), F.array(fact(namespace + law, named, IRI))).otherwise(F.array(fact(namespace + other, doc, BNODE), fact(N.TYPE, F.lit(N.DIGITAL_OBJECT), IRI, s=doc), about))

    return F.flatten(F.transform(T.split_list(F.col(field)), one))


def source_triples(records: DataFrame, iri: Column, field: str, law: str, other: str, namespace: str = N.DEFAULT_NS, graph_id: str = "g") -> DataFrame:
    return told(records, iri, lists=[source_facts(iri, field, law, other, namespace)], graph_id=graph_id)


def shared_lists(iri: Column, namespace: str = N.DEFAULT_NS) -> list[Column]:
    """Facts on sources, alternative names and equivalents, which all kinds of concepts have."""
    return [
        source_facts(iri, "source", N.DEFINING_LAW, N.DEFINING_OTHER, namespace), source_facts(iri, "relatedSource", N.RELATED_LAW, N.RELATED_OTHER, namespace),
        list_facts(N.SKOS + "altLabel", T.split_list(F.col("alternativeName")), lang="cs"), list_facts(N.SKOS + "exactMatch", F.filter(T.split_list(F.col("equivalentConcept")), T.is_iri), IRI),
    ]


def class_triples(classes: DataFrame, iri: str = "iri", namespace: str = N.DEFAULT_NS, graph_id: str = "g", more: Sequence[Column] = ()) -> DataFrame:
    """Triples of the class records with their IRI in ``iri``, and of ``more`` facts on them."""
    s = F.col(iri)
    kind = F.when(F.col("type") == "Subjekt práva", N.SUBJECT_TYPE).when(F.col("type") == "Objekt práva", N.OBJECT_TYPE)
    facts = [
        *common_facts(), fact(N.TYPE, F.lit(N.OFN + N.CLASS), IRI), fact(N.TYPE, F.concat(F.lit(N.OFN), kind), IRI), *public_facts(namespace),
        fact(namespace + N.AGENDA, T.agenda_iri(F.col("agendaCode")), IRI), fact(namespace + N.AIS, T.ais_iri(F.col("agendaSystemCode")), IRI), *governance_facts(),
    ]
    return told(classes, s, *facts, *more, lists=shared_lists(s, namespace), graph_id=graph_id)


def property_triples(properties: DataFrame, lookup: DataFrame, iri: str = "iri", namespace: str = N.DEFAULT_NS, graph_id: str = "g") -> DataFrame:
    """Triples of the property records; ``lookup`` (name, iri) resolves the domains' names."""
    typed = resolved(properties, lookup, "domain", "domain_iri").withColumn("range", T.range_iri(F.col("dataType")))
    literal = F.col("range").startswith(N.XSD) | F.col("range").startswith(N.RDFS)
    facts = [
        *common_facts(), fact(N.TYPE, F.lit(N.OFN + N.PROPERTY), IRI), fact(N.TYPE, F.when(literal, N.OWL + "DatatypeProperty").otherwise(N.OWL + "ObjectProperty"), IRI),
        fact(N.RDFS + "domain", F.col("domain_iri"), IRI), fact(N.RDFS + "range", F.col("range"), IRI), *public_facts(namespace), *governance_facts(),
        fact(namespace + N.PPDF, T.boolean_word(F.col("sharedInPPDF")), LITERAL, F.lit(N.XSD + "boolean")),
    ]
    return told(typed, F.col(iri), *facts, lists=shared_lists(F.col(iri), namespace), graph_id=graph_id)


def relationship_triples(relationships: DataFrame, lookup: DataFrame, iri: str = "iri", namespace: str = N.DEFAULT_NS, graph_id: str = "g") -> DataFrame:
    both = resolved(resolved(relationships, lookup, "domain", "domain_iri"), lookup, "range", "range_iri")
    facts = [
        *common_facts(), fact(N.TYPE, F.lit(N.OFN + N.RELATION), IRI), fact(N.TYPE, F.lit(N.OWL + "ObjectProperty"), IRI), fact(N.RDFS + "domain", F.col("domain_iri"), IRI),
        fact(N.RDFS + "range", F.col("range_iri"), IRI), *public_facts(namespace), *governance_facts(), fact(namespace + N.PPDF, T.boolean_word(F.col("sharedInPPDF")), LITERAL, F.lit(N.XSD + "boolean")),
    ]
    return told(both, F.col(iri), *facts, lists=shared_lists(F.col(iri), namespace), graph_id=graph_id)


#: Names of the kinds of concepts, which no hierarchy is made of.
ROOTS = ["Subjekt", "Objekt", "Vlastnost"]


def sound_edges(hierarchies: DataFrame) -> DataFrame:
    """Edges with two different ends that aren't blank, no address as parent, and no kind of concept at either end."""
    child, parent = F.col("subClass"), F.col("superClass")
    return hierarchies.where(~T.blank(child) & ~T.blank(parent) & (child != parent) & ~parent.rlike("^https?://") & ~child.isin(*ROOTS) & ~parent.isin(*ROOTS))


def hierarchy_triples(hierarchies: DataFrame, lookup: DataFrame, property_names: DataFrame | None = None, graph_id: str = "g") -> DataFrame:
    """subClassOf (subPropertyOf where both ends are in ``property_names``) and the profile's own predicate for it.

    Edges must be sound and need a known IRI for either end."""
    held = sound_edges(hierarchies)
    keys = model_keys(hierarchies, lookup)
    known = lambda name, iri: lookup.select(*keys, F.col("name").alias(name), F.col("iri").alias(iri))
    ends = held.join(known("subClass", "child"), [*keys, "subClass"]).join(known("superClass", "parent"), [*keys, "superClass"])
    if property_names is None:
        ends = ends.withColumn("of_property", F.lit(False))
    else:
        ends = G.bind_exists(ends, property_names.select(*keys, F.col("name").alias("subClass")), "of_property")
    prop = F.col("of_property")
    return told(
        ends, F.col("child"),
        fact(F.when(prop, N.RDFS + "subPropertyOf").otherwise(N.RDFS + "subClassOf"), F.col("parent"), IRI),
        fact(F.when(prop, N.DEFAULT_NS + "nadřazená-vlastnost").otherwise(N.DEFAULT_NS + "nadřazená-třída"), F.col("parent"), IRI), graph_id=graph_id,
    )


def temporal_triples(vocabulary: DataFrame, iri: Column, graph_id: str = "g") -> DataFrame:
    """The vocabulary's times of creation and change as instants, dateTime where the text is one, else date."""
    parts = []
    for field, p in (("dateOfCreation", "okamžik-vytvoření"), ("dateOfModification", "okamžik-poslední-změny")):
        v = F.col(field)
        node = F.concat(iri, F.lit("/časový-okamžik/"), F.substring(F.sha2(F.concat_ws("|", F.lit(p), v), 256), 1, 16))
        held = vocabulary.where(~T.blank(v))
        stamp = T.is_datetime(v) | T.is_datetime_stamp(v)
        parts.append(told(held, iri, fact(N.DEFAULT_NS + p, node, IRI), graph_id=graph_id))
        parts.append(
            told(
                held, node, fact(N.TYPE, F.lit(N.TIME_NS + "časový-okamžik"), IRI),
                fact(F.when(stamp, N.TIME_NS + "datum-a-čas").otherwise(N.TIME_NS + "datum"), v, LITERAL, F.when(stamp, N.XSD + "dateTime").otherwise(N.XSD + "date")), graph_id=graph_id,
            )
        )
    return reduce(DataFrame.unionByName, parts)


def model_keys(*tables: DataFrame) -> list[str]:
    """The column that names mean something within, where all the tables have it."""
    return ["model"] if all("model" in t.columns for t in tables) else []


def last_wins(*kinds: DataFrame) -> DataFrame:
    """(name, iri) of several record kinds, in each model if they have one; a later kind, and in a kind the greatest IRI, takes a name."""
    keys = model_keys(*kinds)
    rows = G.union_bag(*[k.select(*keys, "name", "iri", F.lit(i).alias("kind")) for i, k in enumerate(kinds)])
    return rows.where(~T.blank(F.col("name"))).groupBy(*keys, "name").agg(F.max_by("iri", F.struct("kind", "iri")).alias("iri"))


def resolved(records: DataFrame, lookup: DataFrame, field: str, to: str, namespace: str = N.DEFAULT_NS, vocabulary: str = "slovník") -> DataFrame:
    """The IRI that a reference means: a URI itself, a known name's IRI, else an IRI made from the name and the records'
    ``__namespace`` and ``__vocabulary``, if they have them."""
    keys = model_keys(records, lookup)
    own = lambda c, default: F.col(c) if c in records.columns else F.lit(default)
    names = lookup.select(*keys, F.col("name").alias(field), F.col("iri").alias("__iri"))
    made = T.concept_iri(own("__namespace", namespace), own("__vocabulary", vocabulary), F.col(field), F.lit(None).cast("string"))
    return records.join(names, [*keys, field], "left").withColumn(to, F.when(~T.blank(F.col(field)), F.coalesce(F.when(T.is_uri(F.col(field)), F.col(field)), "__iri", made))).drop("__iri")


def valid_rows(records: DataFrame, *fields: str) -> DataFrame:
    return records.where(reduce(lambda a, b: a & b, [~T.blank(F.col(f)) for f in fields]))


def without_filtered(records: DataFrame, lookup: DataFrame, pattern: str, own: str = "identifier", references: tuple[str, ...] = (), softened: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """Drops records whose identifier matches ``pattern`` in full, or whose reference in ``references`` does; such
    references in ``softened`` become null. Names are resolved to identifiers by ``lookup`` (name, identifier) first, within the same ``keys``."""
    hit = lambda c: F.coalesce(c.rlike(f"^(?:{pattern})$"), F.lit(False))
    out = records.where(~hit(F.col(own)))
    for ref in (*references, *softened):
        out = out.join(lookup.select(*keys, F.col("name").alias(ref), F.col("identifier").alias("__id")), [*keys, ref], "left")
        bad = hit(F.coalesce("__id", ref))
        out = (out.where(~bad) if ref in references else out.withColumn(ref, F.when(~bad, F.col(ref)))).drop("__id")
    return out.select(*records.columns)


def filter_counts(records: DataFrame, lookup: DataFrame, pattern: str, own: str = "identifier", references: tuple[str, ...] = (), softened: tuple[str, ...] = ()) -> DataFrame:
    """(reason, n): how many records ``without_filtered`` drops for their identifier or else for a reference, and how many
    references of the others it empties, by the name of the field."""
    hit = lambda c: F.coalesce(c.rlike(f"^(?:{pattern})$"), F.lit(False))
    out, gone, counts = records, hit(F.col(own)), [F.count_if(hit(F.col(own))).alias(own)]
    for i, ref in enumerate((*references, *softened)):
        out = out.join(lookup.select(F.col("name").alias(ref), F.col("identifier").alias(f"__id{i}")), ref, "left")
        bad = hit(F.coalesce(f"__id{i}", ref))
        counts.append(F.count_if(~gone & bad).alias(ref))
        gone = gone | bad if ref in references else gone
    return out.agg(*counts).unpivot([], [own, *references, *softened], "reason", "n")


def missing_references(properties: DataFrame, classes: DataFrame, field: str = "domain") -> DataFrame:
    """Records whose domain isn't the name of a class."""
    return valid_rows(properties, field).join(classes.select(F.col("name").alias(field)), field, "left_anti")


def type_status(kind: Column) -> Column:
    """Whether a class record's type is VALID, EMPTY_TYPE or INVALID_TYPE."""
    return F.when(T.blank(kind), "EMPTY_TYPE").when(kind.isin("Objekt práva", "Subjekt práva"), "VALID").otherwise("INVALID_TYPE")


def lacking(records: DataFrame, record: str, key: str, *fields: str) -> DataFrame:
    """(record, id, field) for each of the ``fields`` that a record must have and lacks."""
    gaps = F.array_compact(F.array(*[F.when(T.blank(F.col(f)), F.lit(f)) for f in fields]))
    return records.select(F.lit(record).alias("record"), F.col(key).alias("id"), F.explode(gaps).alias("field"))


def publicity_conflicts(records: DataFrame) -> DataFrame:
    """``records`` whose flag and provision contradict each other, with ``conflict``."""
    flag, told = T.boolean_word(F.col("isPublic")), T.provision(F.col("privacyProvision")).isNotNull()
    conflict = F.when(flag & told, "public with provision").when(~flag & ~told, "non-public without provision")
    return records.withColumn("conflict", conflict).where("conflict is not null")


def used_kinds(classes: DataFrame) -> DataFrame:
    """One row: whether some class is a subject, an object, public and not public."""
    kind = T.public_kind(F.col("isPublic"), F.col("privacyProvision"))
    some = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    return classes.agg(some(F.col("type").contains("Subjekt"), "subject"), some(F.col("type").contains("Objekt"), "object"), some(T.boolean_word(F.col("isPublic")), "public"), some(kind == N.NON_PUBLIC, "closed"))


def described_records(**kinds: DataFrame) -> DataFrame:
    """(name, kind, description) of the records of all kinds, by the name of the kind."""
    return G.union_bag(*[k.select("name", F.lit(kind).alias("kind"), "description") for kind, k in kinds.items()])


def in_scheme(triples: DataFrame, scheme: str, but: str = N.OFN + N.PROPERTY) -> DataFrame:
    """Triples that put every concept into the scheme, without those of the type ``but``."""
    held = G.where_not_exists(G.instances(triples, N.OFN + N.CONCEPT), G.instances(triples, but))
    return told(held, F.col("s"), fact(N.SKOS + "inScheme", F.lit(scheme), IRI))


#: The profile's classes that a graph may use and must declare then.
BASE_TERMS = [N.OFN + x for x in (N.CONCEPT, N.CLASS, N.RELATION, N.PROPERTY, N.SUBJECT_TYPE, N.OBJECT_TYPE, N.PUBLIC, N.NON_PUBLIC)]


def base_schema(triples: DataFrame) -> DataFrame:
    """Declarations of the profile's classes that the graph uses, and of its own predicates."""
    kinds = triples.where((F.col("p") == N.TYPE) & F.col("o").isin(*BASE_TERMS)).select(F.col("o").alias("term"), F.lit(N.OWL + "Class").alias("kind"))
    predicates = triples.where(F.col("p").startswith(N.DEFAULT_NS)).select(F.col("p").alias("term"), F.when(F.col("o_kind") == LITERAL, N.OWL + "DatatypeProperty").otherwise(N.OWL + "ObjectProperty").alias("kind"))
    return told(kinds.union(predicates).distinct(), F.col("term"), fact(N.TYPE, F.col("kind"), IRI))


def used_fields(records: DataFrame, *fields: str) -> DataFrame:
    """(field) for each field that some record fills, in one pass."""
    flags = records.agg(*[F.coalesce(F.bool_or(~T.blank(F.col(f))), F.lit(False)).alias(f) for f in fields])
    return flags.unpivot([], list(fields), "field", "used").where("used").select("field")


def domain_and_range(triples: DataFrame, namespace: str) -> DataFrame:
    """``triples`` with a vocabulary's own predicates of domain and range as those of RDFS, where they lead to a resource."""
    p = F.col("p")
    standard = F.when(p == namespace + "definiční-obor", N.RDFS + "domain").when(p == namespace + "obor-hodnot", N.RDFS + "range")
    return triples.withColumn("p", F.when(F.col("o_kind") != LITERAL, F.coalesce(standard, p)).otherwise(p))


def export_triples(triples: DataFrame, namespace: str) -> DataFrame:
    """The published form: blank literals, subjects outside the namespace and the base schema go; blank nodes stay if what is kept leads to them.
    Predicates get their published names, the PPDF flag its published form, and literals without language labels in Czech."""
    told = triples.where(~((F.col("o_kind") == LITERAL) & T.blank(F.col("o"))))
    own = told.where((F.col("s_kind") != BNODE) & F.col("s").startswith(namespace) & ~F.col("s").isin(*BASE_TERMS))
    blank = told.where(F.col("s_kind") == BNODE)
    led_to = G.reachable(own.union(blank).where(F.col("o_kind") == BNODE), own)
    kept = domain_and_range(own.unionByName(blank.join(led_to.withColumnRenamed("node", "s"), "s", "left_semi").select(*own.columns)), namespace)
    renamed = F.create_map(*[F.lit(x) for pair in N.PUBLISHED.items() for x in pair])
    labels = F.col("p").isin(N.SKOS + "prefLabel", N.SKOS + "definition", N.SKOS + "altLabel", N.RDFS + "label")
    flag = F.col("p") == N.DEFAULT_NS + N.PPDF
    return kept.withColumns(
        {
            "o": F.when(flag, F.lower("o").isin("true", "ano").cast("string")).otherwise(F.col("o")),
            "o_lang": F.when(labels & (F.col("o_kind") == LITERAL), F.coalesce(F.nullif("o_lang", F.lit("")), F.lit("cs"))).otherwise(F.col("o_lang")),
            "p": F.when(F.col("p") == N.RDFS + "label", N.SKOS + "prefLabel").otherwise(F.coalesce(F.try_element_at(renamed, "p"), "p")),
        }
    )
