"""ArchiMate exchange files as record sets: the engine's XML reader gives the elements, joins do the rest.

Every record has its file in ``model``; identifiers and names mean something within their file only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import terms as T
from lexigraph.operators.hierarchy import cut
from lexigraph.sources.formats import XmlFiles, xml_files

PROPERTY = "array<struct<_propertyDefinitionRef:string,value:string>>"
NAMES = "array<struct<_VALUE:string,`_xml:lang`:string>>"
MODEL = f"name {NAMES}, properties struct<property:{PROPERTY}>"
ELEMENT = f"_identifier string, name {NAMES}, properties struct<property:{PROPERTY}>"
RELATION = f"_identifier string, _source string, _target string, `_xsi:type` string, name {NAMES}, properties struct<property:{PROPERTY}>"
#: Parts of the definitions' names, in order, and the fields that they mean.
FIELDS = {
    "ekvivalentní pojem": "equivalentConcept", "související zdroj": "relatedSource", "ustanovení dokládající neveřejnost": "privacyProvision", "agendový informační systém": "agendaSystemCode",
    "je pojem sdílen v PPDF?": "sharedInPPDF", "je pojem veřejný?": "isPublic", "alternativní název": "alternativeName", "datový typ": "dataType", "způsob sdílení údaje": "sharingMethod",
    "způsob získání údaje": "acquisitionMethod", "typ obsahu údaje": "contentType", "adresa lokálního katalogu dat": "namespace", "zdroj": "source", "popis": "description", "definice": "definition",
    "identifikátor": "identifier", "agenda": "agendaCode", "typ": "type",
}
ROOTS = ("Subjekt", "Objekt", "Vlastnost")
VALUES = ["type", "description", "definition", "source", "identifier", "relatedSource", "alternativeName", "equivalentConcept", "dataType", "sharedInPPDF", "agendaCode", "agendaSystemCode", "isPublic", "privacyProvision", "sharingMethod", "acquisitionMethod", "contentType"]


def rows_of(files: XmlFiles, tag: str, schema: str) -> DataFrame:
    return files.rows(tag, schema).withColumnRenamed("__file", "model").drop("__place")


def _named(rows: DataFrame) -> DataFrame:
    """``name``, the Czech one or the one without language, else the first; the others by language in ``names``."""
    lang = lambda x: F.coalesce(x["_xml:lang"], F.lit("cs"))
    own = F.get(F.filter("name", lambda x: lang(x) == "cs"), 0)["_VALUE"]
    others = F.map_from_entries(F.array_distinct(F.transform(F.filter("name", lambda x: lang(x) != "cs"), lambda x: F.struct(F.concat(F.lit("lang="), lang(x)), x["_VALUE"]))))
    return rows.withColumns({"names": F.coalesce(others, F.create_map().cast("map<string,string>")), "name": F.coalesce(own, F.get("name", 0)["_VALUE"])})


def definitions(files: XmlFiles) -> DataFrame:
    """(model, ref, label, field): the first part in order that a definition's name holds, null if none."""
    d = rows_of(files, "propertyDefinition", f"_identifier string, name {NAMES}").withColumn("label", F.get("name", 0)["_VALUE"])
    field = reduce(lambda rest, kv: F.when(F.col("label").contains(kv[0]), kv[1]).otherwise(rest), reversed(FIELDS.items()), F.lit(None).cast("string"))
    return d.select("model", F.col("_identifier").alias("ref"), "label", field.alias("field"))


def told_values(rows: DataFrame, fields: DataFrame, *keys: str) -> DataFrame:
    """(model, keys, label, field, value) of the rows' properties; %-escapes are decoded where they are sound."""
    told = rows.select("model", *keys, F.explode("properties.property").alias("p")).select("model", *keys, F.col("p._propertyDefinitionRef").alias("ref"), F.col("p.value").alias("value"))
    return told.join(fields, ["model", "ref"]).withColumn("value", F.when(F.col("value").contains("%"), F.coalesce(F.try_url_decode("value"), "value")).otherwise(F.col("value")))


def with_values(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """``rows`` with a column a field; of several values the greatest counts."""
    told = told_values(rows, fields.where("field is not null"), "_identifier")
    wide = told.groupBy("model", "_identifier").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in VALUES])
    return rows.join(wide, ["model", "_identifier"], "left")


def vocabularies(files: XmlFiles, fields: DataFrame) -> DataFrame:
    """(model, name, description, namespace) of each model: its name, and of its own properties the description and the
    first valid address of a local catalogue."""
    models = _named(rows_of(files, "model", MODEL))
    label = F.lower("label")
    catalogue = label.contains("adresa") & label.contains("lokální") | (label == "adresa-lokálního-katalogu-dat-ve-kterém-bude-slovník-registrován")
    told = told_values(models, fields, "name").groupBy("model").agg(
        F.max(F.when(label == "popis", F.col("value"))).alias("description"), F.min(F.when(catalogue & T.is_uri(F.col("value")), F.col("value"))).alias("namespace")
    )
    return models.select("model", F.coalesce("name", F.lit("Untitled Model")).alias("name")).join(told, "model", "left")


def read_archimate(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The record sets ``vocabulary``, ``classes``, ``properties``, ``relationships`` and ``hierarchies`` of the models at ``path``; files that can't be read give none
    (``formats.xml_errors`` tells them)."""
    files = xml_files(spark, path)
    # Definitions, elements and relations are stored: each is read several times.
    fields = cut(definitions(files))
    elements = cut(with_values(_named(rows_of(files, "element", ELEMENT)), fields).where(F.col("name").isNotNull() & ~F.col("name").isin(*ROOTS)))
    links = cut(with_values(_named(rows_of(files, "relationship", RELATION)).withColumnRenamed("_xsi:type", "kind"), fields))
    end = lambda ref, name: elements.select("model", F.col("_identifier").alias(ref), F.col("name").alias(name))
    ends = links.join(end("_source", "from"), ["model", "_source"]).join(end("_target", "to"), ["model", "_target"])
    is_property = F.coalesce(F.lower("type").contains("vlastnost"), F.lit(False))
    domains = ends.where("kind = 'Composition'").groupBy("model", F.col("to").alias("name")).agg(F.max("from").alias("domain"))
    ident = F.when(T.is_iri(F.col("identifier")), F.col("identifier"))
    return {
        "vocabulary": vocabularies(files, fields),
        "classes": elements.where(~is_property).withColumns({"id": F.col("_identifier"), "type": T.class_type(F.col("type")), "identifier": ident}).drop("_identifier", "properties", "dataType"),
        "properties": elements.where(is_property).withColumns({"id": F.col("_identifier"), "identifier": ident}).drop("_identifier", "properties", "type").join(domains, ["model", "name"], "left"),
        "relationships": ends.where(F.col("name").isNotNull() & F.col("kind").isin("Association", "Composition", "Specialization")).select(
            "model", F.col("from").alias("domain"), "name", F.col("to").alias("range"), F.col("kind").alias("relationshipType"), *[v for v in VALUES if v not in ("type", "dataType")]
        ),
        "hierarchies": ends.where("kind = 'Specialization'").select("model", F.col("from").alias("subClass"), F.col("to").alias("superClass"), F.col("_identifier").alias("relationshipId"), F.col("name").alias("relationshipName")),
    }
