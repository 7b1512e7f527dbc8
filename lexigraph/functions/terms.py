"""Column functions on names, IRIs, codes, typed values and lists; all are built from the engine's own functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexigraph.functions import names as N

YES, NO = ("true", "ano", "yes"), ("false", "ne", "no")


def blank(c: Column) -> Column:
    """Null or nothing but spaces."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def or_null(c: Column) -> Column:
    return F.when(c != "", c)


def sanitize_iri(c: Column) -> Column:
    """A name as part of an IRI: lower case, other characters than letters, digits and marks as single hyphens."""
    x = F.regexp_replace(F.lower(c), r"^[^\p{L}\p{Nd}_:]+", "")
    x = F.regexp_replace(x, r"[^\p{L}\p{Nd}_\-.:·\x{300}-\x{36F}\x{203F}-\x{2040}]", "-")
    x = F.regexp_replace(F.regexp_replace(x, r"-+", "-"), r"-+$", "")
    return F.coalesce(or_null(x), F.lit("unnamed"))


def is_uri(c: Column) -> Column:
    """Whether a URI has a scheme and an (ASCII) host."""
    return F.try_parse_url(c, F.lit("HOST")).isNotNull() & F.try_parse_url(c, F.lit("PROTOCOL")).isNotNull()


def is_iri(c: Column) -> Column:
    """Whether a text passes as IRI: a scheme, no white space, none of the words for nothing, no forbidden sign after ://."""
    x = F.trim(c)
    void = F.lower(x).isin("invalid", "n/a", "tbd", "todo") | F.lower(x).startswith("ne-") | x.rlike(r"[ \t\n\r]")
    shape = x.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    slashes = x.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")
    return F.coalesce(~void & shape & (~slashes | x.rlike(r'^[a-zA-Z][a-zA-Z0-9+.-]*://[^<>"{}|\\^`]+$')), F.lit(False))


def local_name(c: Column) -> Column:
    """What follows the last / or #; the whole if nothing does."""
    return F.coalesce(or_null(F.regexp_extract(c, r"([^/#]*)$", 1)), c)


def with_delimiter(c: Column) -> Column:
    return F.when(c.rlike(r"[/#]$"), c).otherwise(F.concat(c, F.lit("/")))


def effective_namespace(c: Column) -> Column:
    return F.when(is_uri(c), with_delimiter(c)).otherwise(F.lit(N.DEFAULT_NS))


def concept_iri(namespace: Column, vocabulary: Column, name: Column, identifier: Column) -> Column:
    """A valid identifier with /pojem/ as it is; another valid one gives its last part; other identifiers and names are sanitised."""
    last = F.when(is_iri(identifier), local_name(identifier)).when(~blank(identifier), sanitize_iri(identifier)).otherwise(sanitize_iri(name))
    made = F.concat_ws("/", F.rtrim(namespace, F.lit("/")), sanitize_iri(vocabulary), F.lit("pojem"), last)
    return F.when(is_iri(identifier) & identifier.contains("/pojem/"), identifier).otherwise(made)


def vocabulary_iri(namespace: Column, name: Column) -> Column:
    """Address of a vocabulary: its namespace and its name as part of an IRI."""
    return F.concat_ws("/", F.rtrim(namespace, F.lit("/")), sanitize_iri(name))


def rule_iri(name: Column, is_global: bool = False) -> Column:
    kebab = F.lower(F.regexp_replace(name, r"([a-z])([A-Z])", "$1-$2"))
    return F.concat(F.lit(N.SHACL_GLOBAL if is_global else N.SHACL_LOCAL), kebab)


def is_boolean_word(c: Column, trimmed: bool = True) -> Column:
    return F.coalesce(F.lower(F.trim(c) if trimmed else c).isin(*YES, *NO), F.lit(False))


def boolean_word(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin(*YES), True).when(x.isin(*NO), False)


def provision(c: Column) -> Column:
    """A provision's text, null for blanks and words for none."""
    x = F.trim(c)
    return F.when((x != "") & ~F.lower(x).isin("null", "n/a", "není", "none"), x)


def agenda_iri(c: Column) -> Column:
    r"""Canonical IRI of \d+, A\d+ or an agenda's address; null for other values."""
    x = F.trim(c)
    code = F.coalesce(or_null(F.regexp_extract(x, r"^A?(\d+)$", 1)), or_null(F.regexp_extract(x, r"^https://.*?/agenda/A(\d+)$", 1)))
    return F.concat(F.lit(N.RPP + "agenda/A"), code)


def ais_iri(c: Column) -> Column:
    x = F.trim(c)
    return F.concat(F.lit(N.RPP + "isvs/"), F.coalesce(or_null(F.regexp_extract(x, r"^(\d+)$", 1)), or_null(F.regexp_extract(x, r"^https://.*?/isvs/(\d+)$", 1))))


def eli_iri(c: Column) -> Column:
    """Address of the law that a text with /eli/cz/ (either slash) points to, else null."""
    part = or_null(F.regexp_extract(c, r"[/\\](eli[/\\]cz[/\\].*)", 1))
    return F.concat(F.lit(N.ELI_BASE), F.translate(part, "\\", "/"))


def split_list(c: Column, separator: str = ";") -> Column:
    """Trimmed parts of a list without blanks; empty for null."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def is_plausible_source(c: Column) -> Column:
    return F.coalesce((F.length(F.trim(c)) >= 3) & c.rlike("[a-zA-Z0-9]"), F.lit(False))


def clean_sources(c: Column) -> Column:
    return or_null(F.array_join(F.filter(split_list(c), is_plausible_source), ";"))


def clean_tag(c: Column) -> Column:
    """A modelling tool's tag value: notes cut, character references decoded, trimmed, null if nothing is left."""
    x = F.substring_index(c, "#NOTES#", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#xA;", ""), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return or_null(F.trim(x))


def is_date(c: Column) -> Column:
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "dd.MM.yyyy"), F.try_to_date(c, "d.M.yyyy")).isNotNull()


def is_time(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?$"), F.lit(False))


def is_datetime(c: Column) -> Column:
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?$") & is_date(F.substring(c, 1, 10))
    czech = c.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4} ([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$") & is_date(F.substring_index(c, " ", 1))
    return F.coalesce(iso | czech, F.lit(False))


def is_datetime_stamp(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^.*T.*([+-]\d{2}:\d{2}|Z)$") | c.endswith("+02:00") | c.endswith("+01:00") | c.endswith("-00:00"), F.lit(False))


def type_by_name(name: Column) -> Column:
    """The data type that a property's name suggests, null if none."""
    x = F.lower(name)
    has = lambda *parts: reduce(lambda a, b: a | b, [x.contains(p) for p in parts])
    return (
        F.when(has("datum") & has("čas"), "xsd:dateTimeStamp")
        .when(has("datum", "date"), "xsd:date")
        .when(has("cas", "time"), "xsd:time")
        .when(has("okamžik", "timestamp"), "xsd:dateTimeStamp")
        .when(has("url", "uri", "odkaz", "link"), "xsd:anyURI")
        .when(has("boolean", "flag", "indicator", "is", "has"), "xsd:boolean")
        .when(has("count", "number", "integer", "quantity"), "xsd:integer")
    )


def literal_type(value: Column, name: Column, lang: Column | None = None) -> Column:
    """Data type of a literal from its text, then from its property's name; a language makes it rdf:langString."""
    found = (
        F.when(is_boolean_word(value, trimmed=False), "xsd:boolean")
        .when(is_uri(value), "xsd:anyURI")
        .when(is_datetime_stamp(value), "xsd:dateTimeStamp")
        .when(is_date(value), "xsd:date")
        .when(is_time(value), "xsd:time")
        .when(is_datetime(value), "xsd:dateTime")
        .when(value.rlike(r"^-?\d+$"), "xsd:integer")
        .when(value.rlike(r"^-?\d+(\.\d+)?$"), "xsd:double")
        .otherwise(F.coalesce(type_by_name(name), F.when(F.lower(name).contains("alternativní-název") | (F.lower(name) == "alternative-name"), "rdf:langString"), F.lit("xsd:string")))
    )
    return found if lang is None else F.when(lang.isNotNull(), "rdf:langString").otherwise(found)


def range_iri(value: Column) -> Column:
    """A property's range: blank gives rdfs:Literal, then xsd: names, full IRIs, Czech labels (in any case), else rdfs:Literal."""
    label = F.create_map(*[F.lit(x).alias("x") for k, v in N.DATA_TYPES.items() for x in (k.lower(), v)])
    x = F.trim(value)
    return (
        F.when(blank(value), N.RDFS + "Literal")
        .when(x.startswith("xsd:"), F.concat(F.lit(N.XSD), F.substring(x, F.lit(5), F.length(x))))
        .when(x.startswith(N.XSD) | is_uri(x), x)
        .otherwise(F.coalesce(F.try_element_at(label, F.lower(x)), F.lit(N.RDFS + "Literal")))
    )


def abbreviate_range(c: Column) -> Column:
    return F.when(c.startswith(N.XSD), F.concat(F.lit("xsd:"), F.substring(c, F.lit(len(N.XSD) + 1), F.length(c)))).otherwise(c)


def class_type(c: Column) -> Column:
    """Legal type of a modelling tool's class type."""
    x = F.lower(F.trim(c))
    return F.when(x.contains("subjekt"), "Subjekt práva").when(x.contains("objekt"), "Objekt práva").when(x.contains(N.PROPERTY), N.PROPERTY).otherwise(c)


def public_kind(is_public: Column, provision_text: Column) -> Column:
    """Type of a datum by publicity: a provision makes it non-public, else the flag decides; null if neither tells."""
    return F.when(provision(provision_text).isNotNull(), N.NON_PUBLIC).when(boolean_word(is_public), N.PUBLIC).when(~boolean_word(is_public), N.NON_PUBLIC)


def xml_name(c: Column) -> Column:
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9]", "")
    return F.when(x.rlike(r"^\d"), F.concat(F.lit("n"), x)).otherwise(x)


def looks_like_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^id-[0-9a-f]{8}.*$") | c.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def url_filename(c: Column) -> Column:
    return F.coalesce(or_null(F.regexp_extract(F.try_parse_url(c, F.lit("PATH")), r"([^/]+)$", 1)), F.lit("downloaded-file"))


def _decomposed() -> tuple[str, str]:
    """Latin letters that are a plain letter with marks, and the plain letters, by the rules of Unicode."""
    plain = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code):
            plain[chr(code)] = base
    return "".join(plain), "".join(plain.values())


MARKED, UNMARKED = _decomposed()
# Letters that are spelled out, and such as have no marks by Unicode's rules.
SPELLED = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d"}


def transliterate(c: Column) -> Column:
    """Plain letters for Latin letters with marks, in either case."""
    x = c
    for k, v in SPELLED.items():
        x = F.replace(x, F.lit(k), F.lit(v))
        if k != "ß":
            x = F.replace(x, F.lit(k.upper()), F.lit(v.capitalize()))
    return F.regexp_replace(F.translate(x, MARKED, UNMARKED), r"\p{Mn}+", "")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC, trimmed; empty for null. The engine has no normalisation of its own."""
    return texts.map(lambda x: unicodedata.normalize("NFC", x).strip() if isinstance(x, str) else "")
