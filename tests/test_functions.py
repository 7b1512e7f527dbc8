"""Column functions on fixed vectors."""

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.functions import terms as T


def results(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


CASES = [
    (T.sanitize_iri, {"Katastr nemovitostí": "katastr-nemovitostí", "  Osoba (fyzická)  ": "osoba-fyzická", "7. bod / část A": "7.-bod-část-a", "Ulice+číslo": "ulice-číslo", "?!": "unnamed", "   ": "unnamed", None: "unnamed"}),
    (T.is_uri, {"https://data.example.org/x": True, "http://10.0.0.5:81/a?b=c": True, "ftp://files.example.org/pub": True, "katastr": False, "https:/one-slash.example": False, "http://": False, "https://slovník.gov.cz/x": False, None: False}),
    (T.with_delimiter, {"https://d.example/voc": "https://d.example/voc/", "https://d.example/voc/": "https://d.example/voc/", "https://d.example/voc#": "https://d.example/voc#", "": "/"}),
    (T.looks_like_id, {"id-0a1b2c3d": True, "id-0a1b2c3d4e5f": True, "0f8fad5b-d9cb-469f-a165-70867728950e": True, "vozidlo": False, "Id-0a1b2c3d": False, "id-0a1b": False, None: False}),
    (T.xml_name, {"Road-Tax_rate": "RoadTaxrate", "4x!y": "n4xy", "ěšč": "", None: ""}),
    (lambda c: T.is_boolean_word(c, trimmed=False), {"ano": True, "NE": True, "Yes": True, "maybe": False, "1": False, "": False}),
    (T.is_date, {"2023-12-25": True, "25.12.2023": True, "1.1.2023": True, "not-a-date": False, "": False, "2023-13-01": False, "32.12.2023": False}),
    (T.is_time, {"14:30:00": True, "14:30": True, "09:05:15": True, "25:00:00": False, "14:60:00": False, "": False}),
    (T.is_datetime, {"2023-12-25T14:30:00": True, "25.12.2023 14:30:00": True, "2023-12-25": False, "14:30:00": False, "": False}),
    (T.type_by_name, {"datumNarozeni": "xsd:date", "birthDate": "xsd:date", "casOdchodu": "xsd:time", "departureTime": "xsd:time", "webUrl": "xsd:anyURI", "isActive": "xsd:boolean", None: None}),
    (T.clean_tag, {None: None, "": None, "  ": None, "text with #NOTES# extra info": "text with", "&lt;tag&gt;content&lt;/tag&gt;": "<tag>content</tag>", "&amp;escaped&amp;": "&escaped&", "&#xA;line break": "line break"}),
    (T.clean_sources, {None: None, " ": None, "https://a.example/x": "https://a.example/x", "abc; def ;-": "abc;def"}),
    (T.boolean_word, {" ano ": True, "NE": False, "x": None, None: None}),
    (T.agenda_iri, {"12": N.RPP + "agenda/A12", "A7": N.RPP + "agenda/A7", "https://x/agenda/A9": N.RPP + "agenda/A9", "B1": None, None: None}),
    (T.local_name, {"https://a/b#c": "c", "https://a/b/": "https://a/b/", "x": "x"}),
    (T.is_iri, {"urn:x:1": True, "https://slovník.gov.cz/a": True, "ne-x:1": False, "a b:c": False, "tbd": False, "http://a<b": False, None: False}),
    (T.nfc, {" é ": "é", None: ""}),
    (T.transliterate, {"Žluťoučký kůň": "Zlutoucky kun", "Größe": "Groesse", "": ""}),
]


@pytest.mark.parametrize("f, vectors", CASES)
def test_vectors(spark, f, vectors):
    assert results(spark, f, list(vectors)) == list(vectors.values())
