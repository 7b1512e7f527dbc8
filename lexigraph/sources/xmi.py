"""XMI files of UML models as record sets: packages, elements, tags and connectors as tables, joined by their ids.

Every record has its file in ``model``; ids and names mean something within their file only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.functions import terms as T
from lexigraph.operators.hierarchy import closure, cut
from lexigraph.sources.formats import xml_files

TAGS = "array<struct<_name:string,_value:string>>"
ELEMENT = f"`_xmi:idref` string, `_xmi:type` string, _name string, model struct<_package:string>, properties struct<_stereotype:string>, tags struct<tag:{TAGS}>"
CONNECTOR = f"`_xmi:idref` string, _name string, source struct<`_xmi:idref`:string>, target struct<`_xmi:idref`:string>, properties struct<_ea_type:string,_stereotype:string>, tags struct<tag:{TAGS}>"
CLASS_KINDS, PROPERTY_KIND, RELATION_KIND, PACKAGE_KIND = ("typObjektu", "typSubjektu"), "typVlastnosti", "typVztahu", "slovnikyPackage"
#: What tags are called, field by field, the closest name first. A name holds words that begin with each of the given
#: beginnings, and none that begins with one after a minus; = asks for the whole word.
TAG_NAMES = {
    "description": ["zaklad popis", "popis", "description"],
    "definition": ["zaklad definice", "definice", "definition"],
    "source": ["zaklad zdroj -souvis", "zdroj -souvis", "source -related"],
    "relatedSource": ["souvis zdroj", "related source"],
    "alternativeName": ["alternativ nazev", "alternative name"],
    "equivalentConcept": ["ekvivalent pojem", "equivalent concept"],
    "dataType": ["datovy typ", "data type"],
    "sharedInPPDF": ["sdilen ppdf", "shared ppdf"],
    "isPublic": ["verejny -never", "public"],
    "privacyProvision": ["dokladaj neverejnost", "privacy provision"],
    "identifier": ["identifikator", "identifier"],
    "agendaCode": ["agenda kod", "agenda -system"],
    "agendaSystemCode": ["agendov system", "ais="],
    "type": ["typ= -datov -obsah", "type= -data -content"],
    "sharingMethod": ["zpusob sdileni", "sharing method"],
    "acquisitionMethod": ["zpusob ziskani", "acquisition method"],
    "contentType": ["typ obsah", "content type"],
}
#: The same for the tags of a vocabulary's package.
PACKAGE_NAMES = {"description": ["popis slovnik", "popis"], "namespace": ["adresa katalog", "namespace"]}


def plain_names(tags: Column) -> Column:
    """The tags whose value isn't blank, as (name, value): the name's words in lower case without marks, between spaces."""
    held = lambda name: F.concat(F.lit(" "), F.regexp_replace(F.lower(T.transliterate(name)), "[^a-z0-9]+", " "), F.lit(" "))
    return F.filter(F.transform(tags, lambda t: F.struct(held(t["_name"]).alias("name"), T.clean_tag(t["_value"]).alias("value"))), lambda t: t["value"].isNotNull())


def called(held: Column, words: str) -> Column:
    """Whether a plain name holds the words."""
    tests = [~held.contains(f" {w[1:]}") if w[0] == "-" else held.contains(f" {w[:-1]} " if w[-1] == "=" else f" {w}") for w in words.split()]
    return reduce(lambda a, b: a & b, tests)


def with_tags(rows: DataFrame, tags: str = "tags", names: dict[str, list[str]] = TAG_NAMES) -> DataFrame:
    """``rows`` with a column a field instead of ``tags``: the first tag, by closeness of its name and then by place, whose value isn't blank."""
    first = lambda words: F.get(F.filter("__tags", lambda t: called(t["name"], words)), 0)["value"]
    return rows.withColumn("__tags", plain_names(F.col(tags))).withColumns({field: F.coalesce(*map(first, closest)) for field, closest in names.items()}).drop("__tags", tags)


def vocabulary_packages(packages: DataFrame) -> DataFrame:
    """(model, top): the first package with the vocabulary stereotype of each file, in document order."""
    tops = packages.where(F.col("stereotype") == PACKAGE_KIND)
    return tops.groupBy("model").agg(F.min_by("id", F.struct("place", "id")).alias("top"))


def read_xmi(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The record sets of each file's vocabulary package: the elements of the first package with the vocabulary stereotype
    and of the packages in it, without packages that are vocabularies themselves.

    Files are read in the charset that they declare or, where that fails, in the first fallback in which they are XML; those
    that can't be read give no records (``formats.xml_errors`` tells them)."""
    files = xml_files(spark, path)
    raw = files.rows("element", ELEMENT).where(F.col("`_xmi:idref`").isNotNull()).withColumnRenamed("__place", "place")
    rows = raw.select(
        F.col("__file").alias("model"), F.col("`_xmi:idref`").alias("id"), F.col("`_xmi:type`").alias("kind"), F.col("_name").alias("name"), F.col("model._package").alias("package"),
        F.col("properties._stereotype").alias("stereotype"), "place", F.col("tags.tag").alias("tags"),
    )
    # Elements and connectors are stored as records: each is read several times.
    rows = cut(with_tags(rows.withColumn("__all", F.col("tags")))).withColumnRenamed("__all", "tags")
    packages = rows.where("kind = 'uml:Package'").select("model", "id", "name", "package", "stereotype", "place", "tags")
    first = vocabulary_packages(packages)
    node = lambda c: F.concat_ws("|", "model", c)
    inner = packages.where(F.coalesce(F.col("stereotype") != PACKAGE_KIND, F.lit(True))).select(node("id").alias("child"), node("package").alias("parent"))
    top = first.select(node("top").alias("parent"))
    below = closure(inner).join(top, "parent", "left_semi").select(F.col("child").alias("__package"))
    held = rows.where("kind = 'uml:Class'").withColumn("__package", node("package")).join(below.union(top).distinct(), "__package", "left_semi").drop("__package", "tags", "place")
    says_property = F.coalesce(F.lower("type").contains("vlastnost"), F.lit(False))
    links = files.rows("connector", CONNECTOR).select(
        F.col("__file").alias("model"), F.col("__place").alias("place"), F.col("_name").alias("name"), F.col("source.`_xmi:idref`").alias("source_id"), F.col("target.`_xmi:idref`").alias("target_id"),
        F.coalesce(F.when(F.col("properties._ea_type") != "", F.col("properties._ea_type")), F.col("properties._stereotype")).alias("link"), F.col("properties._stereotype").alias("stereotype"), F.col("tags.tag").alias("tags"),
    )
    links = cut(with_tags(links))
    end = lambda ref, name: held.select("model", F.col("id").alias(ref), F.col("name").alias(name))
    ends = links.join(end("source_id", "from"), ["model", "source_id"]).join(end("target_id", "to"), ["model", "target_id"])
    domains = ends.where("link = 'Aggregation'").groupBy("model", F.col("from").alias("name")).agg(F.max_by("to", "place").alias("domain"))
    # Of several connectors between two classes the first tells what is said of their hierarchy.
    told = F.struct(F.col("name").alias("relationshipName"), "description", "definition", "source")
    above = ends.where("link = 'Generalization'").groupBy("model", F.col("from").alias("subClass"), F.col("to").alias("superClass")).agg(F.min_by(told, "place").alias("told"))
    about = packages.join(first, (packages["model"] == first["model"]) & (packages["id"] == first["top"]), "left_semi").select("model", "name", "tags")
    about = with_tags(about, names=PACKAGE_NAMES)
    return {
        "vocabulary": about.withColumn("namespace", F.coalesce("namespace", F.concat(F.lit(N.DEFAULT_NS), F.lower("name")))),
        "classes": held.where(F.col("stereotype").isin(*CLASS_KINDS) & ~says_property).withColumn("type", F.when(F.col("stereotype") == "typSubjektu", "Subjekt práva").otherwise("Objekt práva")).drop("kind", "package", "stereotype", "dataType"),
        "properties": held.where(F.col("stereotype") == PROPERTY_KIND).drop("kind", "package", "stereotype", "type").join(domains, ["model", "name"], "left"),
        "relationships": ends.where((F.col("link") == "Association") & (F.col("stereotype") == RELATION_KIND) & F.col("name").isNotNull()).select(
            "model", F.col("from").alias("domain"), "name", F.col("to").alias("range"), F.col("link").alias("relationshipType"), *[f for f in TAG_NAMES if f not in ("type", "dataType")]
        ),
        "hierarchies": above.select("model", "subClass", "superClass", "told.*"),
    }
