"""What is asked of a thesaurus: its concepts with all that is said of them, their kinds, specialisations and restrictions.

Every function takes a triple table and gives a table of solutions. What is asked of one subject is one aggregation over
its triples, whose sets are then laid out, instead of a join a predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.functions import terms as T
from lexigraph.operators import graph as G

# Namespaces, kinds of concepts and the words in names that tell of them.
BASIC = "https://slovník.gov.cz/základní/"
KINDS = ["typ-objektu", "typ-vlastnosti", "typ-vztahu", "typ-události"]
RELATION_PARTS = ["vykonává", "má", "je", "obsahuje", "patří", "souvisí"]
RELATION_ENDS = ["uje", "ává", "í"]
PROPERTY_STARTS, PROPERTY_PARTS = ["má-", "má "], ["hodnota", "vlastnost"]
PROPERTY_WORDS = ["číslo", "kód", "název", "datum", "hodnota"]
ABOUT = {
    "prefLabel": N.SKOS + "prefLabel", "definition": N.SKOS + "definition", "altLabel": N.SKOS + "altLabel", "source": N.DCT + "source", "scopeNote": N.SKOS + "scopeNote",
    "broader": N.SKOS + "broader", "narrower": N.SKOS + "narrower", "related": N.SKOS + "related",
}


def star_product(triples: DataFrame, s: str, required: dict[str, str], optional: dict[str, str], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Distinct solutions of several patterns on one subject: a row for each choice of an object of every predicate; where
    an optional one has none, its variable is null. ``allowed``: the objects that count for a variable."""
    every = required | optional
    held = triples.where(F.col("p").isin(*set(every.values())))
    wanted = lambda v, p: (F.col("p") == p) & (F.col("o").isin(*allowed[v]) if v in (allowed or {}) else F.lit(True))
    sets = held.groupBy(F.col("s").alias(s)).agg(*[F.collect_set(F.when(wanted(v, p), F.col("o"))).alias(v) for v, p in every.items()])
    for v in required:
        sets = sets.withColumn(v, F.explode(v))
    for v in optional:
        sets = sets.withColumn(v, F.explode_outer(v))
    return sets


def comprehensive(triples: DataFrame, namespace: str) -> DataFrame:
    """All that is said of the concepts of the namespace, by thesaurus, and whether the thesaurus has them in a collection of its own."""
    kinds = {"modelType": [BASIC + k for k in KINDS]}
    concepts = G.instances(triples, N.SKOS + "Concept", "concept").where(F.col("concept").startswith(namespace))
    told = star_product(triples, "concept", {"thesaurus": N.SKOS + "inScheme"}, ABOUT | {"modelType": N.TYPE, "subClassOf": N.RDFS + "subClassOf"}, kinds)
    members = G.also(G.match(triples, "thesaurus", N.DCT + "hasPart", "collection"), G.match(triples, "collection", N.SKOS + "member", "concept"))
    return G.bind_exists(G.where_exists(told, concepts), members.select("thesaurus", "concept"), "isOwned")


def domains_and_ranges(triples: DataFrame, namespace: str) -> DataFrame:
    """(concept, type, domain, range) of the namespace's properties and relations, with what they directly have."""
    told = star_product(triples, "concept", {"type": N.TYPE}, {"domain": N.RDFS + "domain", "range": N.RDFS + "range"}, {"type": [BASIC + KINDS[1], BASIC + KINDS[2]]})
    return told.where(F.col("concept").startswith(namespace))


def specializations(triples: DataFrame, namespace: str) -> DataFrame:
    """(child, childLabel, parent, parentLabel, elementType) of the namespace's concepts below a parent that has a name, and
    is of the same kind or one of the basic concepts."""
    kinds = [prefix + k for prefix in (BASIC, BASIC + "pojem/") for k in KINDS]
    below = triples.where((F.col("p") == N.RDFS + "subClassOf") & (F.col("o_kind") != "bnode") & F.col("s").startswith(namespace)).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    typed = lambda v: G.values(G.match(triples, v, N.TYPE, "elementType"), "elementType", *kinds)
    found = G.bind_exists(G.also(below, typed("child")), typed("parent"), "alike").where(F.col("alike") | F.col("parent").startswith(BASIC + "pojem/")).drop("alike")
    label = lambda v: G.match(triples, v, N.SKOS + "prefLabel", f"{v}Label")
    return G.optional(G.optional(found, label("child")), label("parent"))


def restrictions(triples: DataFrame, namespace: str, kind: str = "typ-vztahu") -> DataFrame:
    """(concept, restriction, property, class): the restrictions above the namespace's concepts of the kind."""
    concepts = G.instances(triples, BASIC + kind, "concept").where(F.col("concept").startswith(namespace))
    above = G.also(concepts, G.match(triples, "concept", N.RDFS + "subClassOf", "restriction"))
    told = star_product(triples, "restriction", {"property": N.OWL + "onProperty", "class": N.OWL + "onClass"}, {})
    return G.also(G.where_exists(above, G.instances(triples, N.OWL + "Restriction", "restriction")), told).distinct()


def kind_by_name(name: Column) -> Column:
    """The kind that a concept's name suggests: a relation's marks count before a property's, else it is an object."""
    n = T.nfc(F.lower(name))
    some = lambda tests: reduce(lambda a, b: a | b, tests)
    relation = some([n.contains(x) for x in RELATION_PARTS] + [n.endswith(x) for x in RELATION_ENDS])
    words = F.split(n, r"[^\p{L}\p{M}\p{N}_]+")
    is_property = some([n.startswith(x) for x in PROPERTY_STARTS] + [n.contains(x) for x in PROPERTY_PARTS] + [F.arrays_overlap(words, F.array(*map(F.lit, PROPERTY_WORDS)))])
    return F.concat(F.lit(BASIC + "pojem/"), F.when(relation, "typ-vztahu").when(is_property, "typ-vlastnosti").otherwise("typ-objektu"))


def concept_types(triples: DataFrame, namespace: str) -> DataFrame:
    """(concept, type) of the namespace's concepts: the kind that is told, else the one that the name suggests."""
    kinds = [prefix + k for prefix in (BASIC, BASIC + "pojem/") for k in KINDS]
    told = star_product(triples, "concept", {"label": N.SKOS + "prefLabel"}, {"type": N.TYPE}, {"type": kinds}).where(F.col("concept").startswith(namespace))
    return told.select("concept", F.coalesce("type", kind_by_name(F.col("label"))).alias("type")).distinct()


#: The properties whose restrictions name the ends of a relation.
ENDS = {"domain": BASIC + "pojem/má-vztažený-prvek-1", "range": BASIC + "pojem/má-vztažený-prvek-2"}


def relationship_ends(triples: DataFrame, namespace: str, kind: str = BASIC + "pojem/typ-vztahu") -> DataFrame:
    """(relationship, domain, range) of the namespace's relations: what they have themselves, then what object properties have,
    then the classes of restrictions on the two ends. Each source is optional and must agree with what is bound before it."""
    ends = ("domain", "range")
    rows = G.instances(triples, kind, "relationship").where(F.col("relationship").startswith(namespace))
    for end in ends:
        rows = G.optional(rows, G.match(triples, "relationship", N.RDFS + end, end))
    again = G.instances(triples, N.OWL + "ObjectProperty", "relationship")
    for end in ends:
        again = G.optional(again, G.match(triples, "relationship", N.RDFS + end, end))
    rows = G.optional_shared(rows, again, ["relationship"], ends)
    restricted = G.match(triples, "relationship", N.RDFS + "subClassOf", "restriction")
    told = star_product(triples, "restriction", {"property": N.OWL + "onProperty", "class": N.OWL + "onClass"}, {})
    told = G.where_exists(told, G.instances(triples, N.OWL + "Restriction", "restriction"))
    for end in ends:
        held = G.also(restricted, told.where(F.col("property") == ENDS[end]).select("restriction", F.col("class").alias(end))).drop("restriction")
        rows = G.optional_shared(rows, held.withColumn(end, F.col(end)), ["relationship"], [end])
    return rows.distinct()
