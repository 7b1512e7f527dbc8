"""The published documents: JSON objects of concepts, Turtle blocks and catalogue records, as rows that a writer stores."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.functions import terms as T
from lexigraph.plans import lift as L

#: The fields of a concept's object in order, with the predicates they come from.
TEXT_FIELDS = {"název": N.SKOS + "prefLabel", "popis": N.DCT + "description", "definice": N.SKOS + "definition"}
ALT_NAME, IDENT = "alternativní-název", "identifikátor"
#: Predicate (as built, as published) -> field, and whether it is a list.
IRI_FIELDS = {
    "ekvivalentní-pojem": ([N.SKOS + "exactMatch"], True),
    "definující-ustanovení-právního-předpisu": ([N.DEFAULT_NS + N.DEFINING_LAW, N.OFN + N.DEFINING_LAW], True),
    "související-ustanovení-právního-předpisu": ([N.DEFAULT_NS + N.RELATED_LAW, N.OFN + N.RELATED_LAW], True),
    "definiční-obor": ([N.RDFS + "domain"], False),
    "obor-hodnot": ([N.RDFS + "range"], False),
    "nadřazená-vlastnost": ([N.RDFS + "subPropertyOf"], True),
    "nadřazená-třída": ([N.RDFS + "subClassOf"], True),
    "způsob-sdílení-údaje": ([N.GOVERNANCE["sharingMethod"][0]], True),
    "způsob-získání-údaje": ([N.GOVERNANCE["acquisitionMethod"][0]], False),
    "typ-obsahu-údaje": ([N.GOVERNANCE["contentType"][0]], False),
    "agenda": ([N.DEFAULT_NS + N.AGENDA, N.AGENDA_104 + N.AGENDA_LONG], False),
    "agendový-informační-systém": ([N.DEFAULT_NS + N.AIS, N.AGENDA_104 + N.AIS_LONG], False),
    "ustanovení-dokládající-neveřejnost-údaje": ([N.DEFAULT_NS + N.PROVISION, N.LAW_111 + N.PROVISION_LONG], True),
}
PPDF_FIELD, PPDF_PATHS = "je-sdílen-v-ppdf", [N.DEFAULT_NS + N.PPDF, N.AGENDA_104 + N.PPDF_LONG]
#: Fields of sources that are digital objects, and their predicates.
OBJECT_FIELDS = {"definující-nelegislativní-zdroj": N.DEFAULT_NS + N.DEFINING_OTHER, "související-nelegislativní-zdroj": N.DEFAULT_NS + N.RELATED_OTHER}
PREFIXES = {"rdf": N.RDF, "rdfs": N.RDFS, "owl": N.OWL, "xsd": N.XSD, "skos": N.SKOS, "dct": N.DCT, "ofn": N.OFN, "čas": N.TIME_NS, "a104": N.AGENDA_104, "l111": N.LAW_111}


def pruned(df: DataFrame, *fields: str) -> Column:
    """A struct of the fields with blank texts, blank list items and lists without items as nulls, which JSON leaves out."""
    kinds = dict(df.dtypes)
    out = []
    for f in fields:
        c = F.col(f)
        if kinds[f].startswith("array"):
            items = F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != ""))
            c = F.when(F.size(items) > 0, items)
        elif kinds[f] == "string":
            c = F.when(~T.blank(c), c)
        out.append(c.alias(f))
    return F.struct(*out)


def type_labels(triples: DataFrame) -> DataFrame:
    """(s, types): the labels of a concept's types in their fixed order."""
    held = triples.where(F.col("p") == N.TYPE).groupBy("s").agg(F.collect_set("o").alias("kinds"))
    labels = F.filter(F.array(*[F.when(F.array_contains("kinds", N.OFN + k), v) for k, v in N.TYPE_LABELS.items()]), lambda x: x.isNotNull())
    return held.select("s", labels.alias("types")).where(F.size("types") > 0)


def concept_objects(triples: DataFrame) -> DataFrame:
    """(iri, object): each concept as JSON with its fields in the fixed order, empty ones left out, by one aggregation.

    Texts are maps from language to the greatest text; alternative names are lists by language; other fields are IRIs, of
    several the least, or sorted lists of them. Sources that are digital objects stand there with their title and address."""
    p, o = F.col("p"), F.col("o")
    lang = F.coalesce(F.nullif("o_lang", F.lit("")), F.lit("cs"))
    listed = lambda test, v: F.array_sort(F.collect_set(F.when(test, v)))
    types = listed(p == N.TYPE, o)
    rows = triples.groupBy("s").agg(
        types.alias("kinds"),
        *[listed((p == path) & (F.col("o_kind") == L.LITERAL) & ~T.blank(o), F.struct(lang.alias("lang"), o.alias("v"))).alias(k) for k, path in (TEXT_FIELDS | {ALT_NAME: N.SKOS + "altLabel"}).items()],
        *[listed(p.isin(*paths), o).alias(k) for k, (paths, _) in IRI_FIELDS.items()],
        F.bool_or(F.when(p.isin(*PPDF_PATHS), F.lower("o").isin("true", "ano"))).alias(PPDF_FIELD),
    )
    rows = rows.where(F.array_contains("kinds", N.OFN + N.CONCEPT))

    def by_language(c: Column) -> Column:
        langs = F.array_distinct(F.transform(c, lambda x: x["lang"]))
        last = F.transform(langs, lambda k: F.element_at(F.filter(c, lambda x: x["lang"] == k), -1)["v"])
        return F.when(F.size(c) > 0, F.map_from_arrays(langs, last))

    def lists(c: Column) -> Column:
        langs = F.array_distinct(F.transform(c, lambda x: x["lang"]))
        return F.when(F.size(c) > 0, F.map_from_arrays(langs, F.transform(langs, lambda k: F.transform(F.filter(c, lambda x: x["lang"] == k), lambda x: x["v"]))))

    labels = F.filter(F.array(*[F.when(F.array_contains("kinds", N.OFN + k), v) for k, v in N.TYPE_LABELS.items()]), lambda x: x.isNotNull())
    fields = [
        F.col("s").alias("iri"), labels.alias("typ"), by_language(F.col("název")).alias("název"), lists(F.col(ALT_NAME)).alias(ALT_NAME),
        *[by_language(F.col(k)).alias(k) for k in ("popis", "definice")], *[F.col(k) for k in OBJECT_FIELDS],
        *[(F.when(F.size(k) > 0, F.col(k)) if is_list else F.get(k, 0)).alias(k) for k, (_, is_list) in IRI_FIELDS.items()], F.col(PPDF_FIELD),
    ]
    rows = rows.join(digital_objects(triples), "s", "left")
    return rows.select(F.col("s").alias("iri"), F.to_json(F.struct(*fields)).alias("object"))


def digital_objects(triples: DataFrame) -> DataFrame:
    """(s, and a list a field of OBJECT_FIELDS): the digital objects that a concept names as sources."""
    p, o = F.col("p"), F.col("o")
    title, url = (F.max(F.when(p == path, o)) for path in (N.DCT + "title", N.SCHEMA_URL))
    told = triples.where(p.isin(N.DCT + "title", N.SCHEMA_URL)).groupBy(F.col("s").alias("o")).agg(title.alias("title"), url.alias("url"))
    about = F.struct(F.lit("Digitální objekt").alias("typ"), F.when(F.col("title").isNotNull(), F.create_map(F.lit("cs"), "title")).alias("název"), "url")
    named = triples.where(p.isin(*OBJECT_FIELDS.values())).select("s", "p", "o").join(told, "o").select("s", "p", F.struct(F.coalesce("title", "url").alias("by"), about.alias("about")).alias("x"))
    # Sorted by title or address; a map can't be compared.
    order = lambda a, b: F.when(a["by"] < b["by"], -1).when(a["by"] > b["by"], 1).otherwise(0)
    lists = [F.transform(F.array_sort(F.collect_list(F.when(p == path, F.col("x"))), order), lambda x: x["about"]).alias(k) for k, path in OBJECT_FIELDS.items()]
    out = named.groupBy("s").agg(*lists)
    return out.select("s", *[F.when(F.size(k) > 0, F.col(k)).alias(k) for k in OBJECT_FIELDS])


#: Fixed value: the context that the documents name.
CONTEXT = "https://ofn.gov.cz/slovníky/draft/kontexty/slovníky.jsonld"


def jsonld_lines(triples: DataFrame, iri: str, name: str, context: str = CONTEXT) -> DataFrame:
    """(place, iri, line): the lines of the whole document, a concept a line. Sorted by place and iri and written as text
    (see write_lines), the part files one after another are the document."""
    spark = triples.sparkSession
    objects = concept_objects(triples)
    first = objects.agg(F.min("iri")).first()[0]
    head = json.dumps({"@context": context, "iri": iri, "typ": ["Slovník", "Tezaurus", "Konceptuální model"], "název": {"cs": name}}, ensure_ascii=False)[:-1] + ', "pojmy": ['
    ends = spark.createDataFrame([(0, "", head), (2, "", "]}")], "place int, iri string, line string")
    return ends.unionByName(objects.select(F.lit(1).alias("place"), "iri", F.concat(F.when(F.col("iri") == F.lit(first), "").otherwise(","), "object").alias("line")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes (place, iri, line) in order, range by range."""
    lines.repartitionByRange("place", "iri").sortWithinPartitions("place", "iri").select("line").write.mode("overwrite").text(path)


#: Subjects a Turtle file holds about; a reader takes a file as a whole.
FILE_SUBJECTS = 5_000


def turtle_files(triples: DataFrame) -> int:
    """How many files the graph's subjects are dealt over, by about how many there are."""
    return max(1, math.ceil(triples.agg(F.approx_count_distinct("s")).first()[0] / FILE_SUBJECTS))


def headed(blocks: DataFrame) -> DataFrame:
    """(line): the blocks, with the prefixes before the first one of each partition."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            held = batch["block"].tolist()
            if first and held:
                held[0], first = turtle_head() + held[0], False
            yield pd.DataFrame({"line": held})

    return blocks.select("block").mapInPandas(lines, "line string")


def write_turtle(triples: DataFrame, path: str) -> None:
    """Writes the graph as Turtle: files of subjects in order, each beginning with the prefixes, so that every file can be read by itself.
    However large the graph, a file holds about ``FILE_SUBJECTS`` subjects and their blank nodes.

    Blank nodes stand with the subject that refers to them first, as their labels hold within a file only."""
    owners = triples.where("o_kind = 'bnode'").groupBy(F.col("o").alias("b")).agg(F.min("s").alias("owner"))
    owner = F.coalesce("owner", F.col("s"))
    blocks = turtle_blocks(triples).join(owners, F.col("s") == F.col("b"), "left").select(owner.alias("owner"), (F.col("b").isNotNull()).alias("blank"), "s", "block")

    headed(blocks.repartitionByRange(turtle_files(triples), "owner").sortWithinPartitions("owner", "blank", "s")).write.mode("overwrite").text(path)


def short(c: Column) -> Column:
    """An IRI as prefixed name where its local part is simple, else in angle brackets."""
    out = F.concat(F.lit("<"), c, F.lit(">"))
    for k, ns in PREFIXES.items():
        rest = F.substring(c, F.lit(len(ns) + 1), F.length(c))
        out = F.when(c.startswith(ns) & rest.rlike(r"^[\p{L}_][\p{L}\p{Nd}_-]*$"), F.concat(F.lit(k + ":"), rest)).otherwise(out)
    return out


def turtle_term(o: Column, kind: Column, dt: Column, lang: Column) -> Column:
    escaped = o
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(char), F.lit(code))
    text = F.concat(F.lit('"'), escaped, F.lit('"'))
    literal = F.when(F.coalesce(lang, F.lit("")) != "", F.concat(text, F.lit("@"), lang)).when(F.coalesce(dt, F.lit("")) != "", F.concat(text, F.lit("^^"), short(dt))).otherwise(text)
    return F.when(kind == L.IRI, short(o)).when(kind == L.BNODE, o).otherwise(literal)


def turtle_blocks(triples: DataFrame) -> DataFrame:
    """(s, block): the Turtle text of each subject, types first, predicates and objects in order. The prefixes are ``turtle_head()``."""
    line = F.concat(F.when(F.col("p") == N.TYPE, "a").otherwise(short(F.col("p"))), F.lit(" "), turtle_term(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")))
    rows = triples.groupBy("s", "s_kind").agg(F.array_sort(F.collect_set(F.struct((F.col("p") != N.TYPE).alias("k"), line.alias("line")))).alias("lines"))
    subject = F.when(F.col("s_kind") == L.IRI, short(F.col("s"))).otherwise(F.col("s"))
    return rows.select("s", F.concat(subject, F.lit(" "), F.array_join(F.transform("lines", lambda x: x["line"]), " ;\n    "), F.lit(" .")).alias("block"))


def turtle_head() -> str:
    return "".join(f"@prefix {k}: <{v}> .\n" for k, v in PREFIXES.items())


def scheme_triples(vocabulary: DataFrame, iri: Column, graph_id: str = "g") -> DataFrame:
    """The vocabulary as concept scheme with its label and description."""
    return L.told(
        vocabulary, iri, L.fact(N.TYPE, F.lit(N.SKOS + "ConceptScheme"), L.IRI), L.fact(N.TYPE, F.lit(N.OFN + "slovník"), L.IRI), L.fact(N.SKOS + "prefLabel", F.col("name"), lang="cs"),
        *([L.fact(N.DCT + "description", F.col("description"), lang="cs")] if "description" in vocabulary.columns else []), graph_id=graph_id,
    )


def vocabulary_metadata(triples: DataFrame) -> DataFrame:
    """(namespace, name, description, description_en) of the graph's vocabularies: subjects that are ontologies or concept schemes. Czech texts count before untagged ones, which stand for
    English too; a name may be a label or a preferred label."""
    p, o, lang = F.col("p"), F.col("o"), F.lower(F.coalesce("o_lang", F.lit("")))
    own = (p == N.TYPE) & o.isin(N.OWL + "Ontology", N.SKOS + "ConceptScheme")
    text = lambda test, tag: F.coalesce(F.max(F.when(test & (lang == tag), o)), F.max(F.when(test & (lang == ""), o)))
    named, told = p.isin(N.RDFS + "label", N.SKOS + "prefLabel"), p == N.DCT + "description"
    rows = triples.where(own | ((F.col("o_kind") == L.LITERAL) & (named | told))).groupBy(F.col("s").alias("namespace"))
    return rows.agg(F.bool_or(own).alias("own"), text(named, "cs").alias("name"), text(named, "en").alias("name_en"), text(told, "cs").alias("description"), text(told, "en").alias("description_en")).where("own").drop("own")


def catalog_record(vocabulary: DataFrame) -> DataFrame:
    """(name, record): the catalogue record of each vocabulary (name, description, namespace) as JSON; a missing description gets a default, a missing name the namespace's last part."""
    name = F.coalesce(F.when(~T.blank(F.col("name")), F.col("name")), T.local_name(F.rtrim("namespace", F.lit("/#"))))
    text = F.coalesce(F.when(~T.blank(F.col("description")), F.col("description")), F.concat(F.lit("Slovník "), name))
    english = lambda c: F.col(c) if c in vocabulary.columns else F.lit(None).cast("string")
    both = lambda c, en: F.create_map(F.lit("cs"), c, F.lit("en"), F.coalesce(english(en), c))
    record = F.struct(
        F.lit("https://ofn.gov.cz/rozhraní-katalogů-otevřených-dat/2021-01-11/kontexty/rozhraní-katalogů-otevřených-dat.jsonld").alias("@context"), F.col("namespace").alias("iri"), F.lit("Datová sada").alias("typ"),
        both(name, "name_en").alias("název"), both(text, "description_en").alias("popis"),
        F.array(F.struct(F.lit("Distribuce").alias("typ"), F.col("namespace").alias("přístupové_url"), F.lit("https://www.iana.org/assignments/media-types/application/ld+json").alias("typ_média"))).alias("distribuce"),
    )
    return vocabulary.select(name.alias("name"), F.to_json(record).alias("record"))
