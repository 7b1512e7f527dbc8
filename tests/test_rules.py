"""Shapes from Turtle files."""

from lexigraph.functions import names as N
from lexigraph.schema import TRIPLES
from lexigraph.sources import rules
from lexigraph.sources.rdf import statements

TEXT = f"""
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
e:or a sh:NodeShape ; sh:targetClass e:K ; sh:severity sh:Warning ; sh:message "needs one"@cs ; sh:or ( [ sh:path e:a ; sh:minCount 1 ] [ sh:path e:b ; sh:minCount 1 ] ) .
e:props a sh:NodeShape ; sh:targetSubjectsOf e:a ; sh:message "bad" ;
  sh:property [ sh:path e:a ; sh:maxCount 1 ; sh:in ( "x" "y" ) ; sh:pattern "^X" ; sh:flags "i" ] ; sh:property [ sh:path e:n ; sh:minInclusive 3 ; sh:datatype xsd:integer ] .
<{N.SHACL_LOCAL}pojem-nemá-vztah-k-agendě-nebo-ais> a sh:NodeShape ; sh:sparql [ sh:select \"\"\"SELECT $this WHERE {{ }}\"\"\" ] .
e:query a sh:NodeShape ; sh:targetNode e:1 ; sh:sparql [ sh:select "SELECT" ] .
"""
DATA = f"""
@prefix e: <http://e/> . @prefix o: <{N.OFN}> .
e:1 a e:K ; e:a "x" ; e:n 2 . e:2 a e:K ; e:b "z" . e:3 a e:K . e:4 e:a "x", "z" . e:L <{N.RDFS}subClassOf> e:K . e:5 a e:L . e:6 a <{N.OFN}pojem> .
"""


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TEXT)
    loaded = rules.load_rules(spark, str(tmp_path))
    assert loaded.skipped == ["http://e/query: a query"] and [s.rule for s in loaded.shapes if s.rule] == ["agenda-ais"]
    t = spark.createDataFrame(statements(DATA, "g"), TRIPLES)
    got = sorted((r["severity"], r["focusNodeUri"][-1], (r["resultPathUri"] or "")[-1:], r["value"]) for r in rules.validate_with(t, loaded).collect())
    assert got == sorted([
        ("WARNING", "3", "", "http://e/3"), ("WARNING", "5", "", "http://e/5"), ("ERROR", "4", "a", "2"), ("ERROR", "4", "a", "z"), ("ERROR", "4", "a", "z"), ("ERROR", "1", "n", "2"), ("INFO", "6", "", "http://e/6"),
    ])


LOGIC = f"""
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
e:not a sh:NodeShape ; sh:targetNode e:1, e:2 ; sh:not [ sh:property [ sh:path e:a ; sh:minCount 1 ] ] .
e:xone a sh:NodeShape ; sh:targetNode e:1, e:2, e:3 ; sh:xone ( [ sh:path e:a ; sh:minCount 1 ] [ sh:path e:b ; sh:minCount 1 ] ) .
e:and a sh:NodeShape ; sh:targetNode e:1, e:3 ; sh:and ( [ sh:path e:a ; sh:minCount 1 ] [ sh:path e:b ; sh:minCount 1 ] ) .
e:node a sh:NodeShape ; sh:targetNode e:1, e:2 ; sh:node e:other . e:other sh:property [ sh:path e:a ; sh:maxLength 1 ] .
e:closed a sh:NodeShape ; sh:targetNode e:1, e:3 ; sh:closed true ; sh:ignoredProperties ( <{N.TYPE}> ) ; sh:property [ sh:path e:a ; sh:minLength 1 ; sh:severity sh:Info ; sh:message "own" ] .
e:off a sh:NodeShape ; sh:targetNode e:1 ; sh:deactivated true ; sh:property [ sh:path e:a ; sh:maxCount 0 ] .
e:more a sh:NodeShape ; sh:targetNode e:1 ; sh:property [ sh:path [ sh:inversePath e:a ] ; sh:minCount 1 ] ; sh:property [ sh:path e:a ; sh:qualifiedValueShape e:other ; sh:qualifiedMinCount 1 ; sh:maxCount 9 ] .
e:deep a sh:NodeShape ; sh:targetNode e:1, e:2 ; sh:not [ sh:property [ sh:path e:a ; sh:minCount 1 ; sh:expression e:x ] ] .
e:loop sh:targetNode e:1 ; sh:property [ sh:path e:a ; sh:node e:loop ] .
e:over sh:targetNode e:1 ; sh:or ( [ sh:path e:a ; sh:maxCount 0 ] [ sh:js e:x ] ) .
"""


def test_logic_and_what_is_skipped(spark, tmp_path):
    (tmp_path / "l.ttl").write_text(LOGIC)
    loaded = rules.load_rules(spark, str(tmp_path))
    assert loaded.skipped == ["http://e/deep: expression", "http://e/loop: recursion", "http://e/over: js"]
    t = spark.createDataFrame(statements("@prefix e: <http://e/> . e:1 a e:K ; e:a 'xx', '' . e:2 e:b 'y' . e:3 e:a 'x' ; e:b 'y' ; e:c 'z' .", "g"), TRIPLES)
    got = sorted((r["ruleName"][9:], r["focusNodeUri"][-1], r["severity"], r["message"]) for r in rules.validate_with(t, loaded).collect())
    assert got == [
        ("and", "1", "ERROR", ""), ("closed", "1", "INFO", "own"), ("closed", "3", "ERROR", ""), ("closed", "3", "ERROR", ""), ("more", "1", "ERROR", ""), ("node", "1", "ERROR", ""), ("not", "1", "ERROR", ""), ("xone", "3", "ERROR", ""),
    ]


def test_lists_and_empty_lists():
    got = {(p.split("#")[-1], o) for *_, p, o, _, _, _ in statements("@prefix e: <http://e/> . e:a e:p ( 1 e:b ) ; e:q () .", "g")}
    assert {("first", "1"), ("first", "http://e/b"), ("rest", N.RDF + "nil"), ("http://e/q", N.RDF + "nil")} <= got and len(got) == 6


def found(spark, tmp_path, shapes, data):
    """(shape, focus, path, value) of all results, with local names."""
    (tmp_path / "s.ttl").write_text("@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n" + shapes)
    t = spark.createDataFrame(statements("@prefix e: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n" + data, "g"), TRIPLES)
    loaded = rules.load_rules(spark, str(tmp_path))
    assert loaded.skipped == []
    short = lambda x: x and x.replace("http://e/", "")
    return sorted(((short(r["ruleName"]), short(r["focusNodeUri"]), short(r["resultPathUri"]), short(r["value"])) for r in rules.validate_with(t, loaded).collect()), key=str)


def test_typed_values(spark, tmp_path):
    shapes = """
e:text sh:targetSubjectsOf e:t ; sh:property [ sh:path e:t ; sh:datatype xsd:string ] .
e:whole sh:targetSubjectsOf e:i ; sh:property [ sh:path e:i ; sh:datatype xsd:integer ] .
e:tongue sh:targetSubjectsOf e:l ; sh:property [ sh:path e:l ; sh:languageIn ( "en" "cs" ) ] .
e:span sh:targetSubjectsOf e:d ; sh:property [ sh:path e:d ; sh:minInclusive "2024-02-01"^^xsd:date ; sh:maxExclusive "2024-03-01"^^xsd:date ] .
e:order sh:targetSubjectsOf e:from ; sh:property [ sh:path e:from ; sh:lessThan e:to ] .
e:big sh:targetSubjectsOf e:n ; sh:property [ sh:path e:n ; sh:minExclusive 9007199254740992 ] .
"""
    data = """
e:1 e:t "plain", "tagged"@en, 5 . e:1 e:i 7, "abc"^^xsd:integer, "300"^^xsd:byte, "-0"^^xsd:integer .
e:1 e:l "a"@en, "b"@en-GB, "c"@CS, "d"@english, "e" .
e:1 e:d "2024-02-01"^^xsd:date, "2024-02-29"^^xsd:date, "2024-03-01"^^xsd:date, "2024-02-30"^^xsd:date, "2024-02-10", "2024-02-10T00:00:00"^^xsd:dateTime .
e:2 e:from "2024-01-05"^^xsd:date ; e:to "2024-01-06"^^xsd:date, "2024-02-01"^^xsd:date .
e:3 e:from "2024-01-06"^^xsd:date ; e:to "2024-01-06"^^xsd:date . e:4 e:from "2024-01-01"^^xsd:date ; e:to "2024-01-02T00:00:00"^^xsd:dateTime . e:5 e:from 2 ; e:to 10, 3.5 . e:6 e:from "b" ; e:to "a" .
e:7 e:from "2024-01-01T10:00:00Z"^^xsd:dateTime ; e:to "2024-01-01T11:30:00+02:00"^^xsd:dateTime . e:8 e:from "2024-01-01T10:00:00"^^xsd:dateTime ; e:to "2024-01-01T11:30:00Z"^^xsd:dateTime .
e:9 e:n 9007199254740993, 9007199254740992, "1e400"^^xsd:decimal .
"""
    assert found(spark, tmp_path, shapes, data) == sorted([
        ("text", "1", "t", "tagged"), ("text", "1", "t", "5"), ("whole", "1", "i", "abc"), ("whole", "1", "i", "300"), ("tongue", "1", "l", "d"), ("tongue", "1", "l", "e"),
        ("span", "1", "d", "2024-03-01"), *[("span", "1", "d", "2024-02-30")] * 2, *[("span", "1", "d", "2024-02-10")] * 2, *[("span", "1", "d", "2024-02-10T00:00:00")] * 2,
        ("order", "3", "from", "2024-01-06"), ("order", "4", "from", "2024-01-01"), ("order", "6", "from", "b"), ("order", "7", "from", "2024-01-01T10:00:00Z"), ("order", "8", "from", "2024-01-01T10:00:00"),
        ("big", "9", "n", "9007199254740992"), ("big", "9", "n", "1e400"),
    ], key=str)


def test_paths_in_shapes(spark, tmp_path):
    shapes = """
e:back sh:targetClass e:K ; sh:property [ sh:path [ sh:inversePath e:p ] ; sh:minCount 1 ] .
e:two sh:targetNode e:1 ; sh:property [ sh:path ( e:p e:q ) ; sh:in ( e:3 ) ] .
e:either sh:targetNode e:1 ; sh:property [ sh:path [ sh:alternativePath ( e:p e:r ) ] ; sh:maxCount 1 ] .
e:all sh:targetNode e:1 ; sh:property [ sh:path [ sh:zeroOrMorePath e:next ] ; sh:nodeKind sh:IRI ; sh:class e:K ] .
e:some sh:targetNode e:1 ; sh:property [ sh:path [ sh:oneOrMorePath e:next ] ; sh:hasValue e:1 ] .
e:once sh:targetNode e:1 ; sh:property [ sh:path [ sh:zeroOrOnePath e:next ] ; sh:maxCount 1 ] .
e:round sh:targetNode e:5 ; sh:property [ sh:path [ sh:inversePath ( e:p [ sh:zeroOrMorePath e:next ] ) ] ; sh:minCount 9 ] .
"""
    data = """e:1 a e:K ; e:p e:2 ; e:r e:2, e:4 ; e:next e:5 . e:2 a e:K ; e:q e:3, e:4 . e:5 a e:K ; e:next e:6 . e:6 e:next e:5, "end" . e:7 e:p e:6 ."""
    assert found(spark, tmp_path, shapes, data) == sorted([
        ("back", "1", "^p", "0"), ("back", "5", "^p", "0"), ("two", "1", "p/q", "4"), ("either", "1", "p|r", "2"), ("all", "1", "next*", "end"), ("all", "1", "next*", "end"), ("all", "1", "next*", "6"),
        ("some", "1", "next+", None), ("once", "1", "next?", "2"), ("round", "5", "(next*)/^p".replace("(next*)", "((^next)*)").replace("((^next)*)", "(^next*)"), "1"),
    ], key=str)


def test_shapes_within_shapes(spark, tmp_path):
    shapes = """
e:person sh:property [ sh:path e:name ; sh:minCount 1 ; sh:datatype xsd:string ] .
e:team sh:targetSubjectsOf e:member ; sh:property [ sh:path e:member ; sh:node e:person ; sh:not [ sh:class e:Robot ] ] .
e:pair sh:targetSubjectsOf e:member ; sh:property [ sh:path e:member ; sh:qualifiedValueShape e:person ; sh:qualifiedMinCount 2 ] .
e:few sh:targetSubjectsOf e:member ; sh:property [ sh:path e:member ; sh:qualifiedValueShape [ sh:class e:Robot ] ; sh:qualifiedMaxCount 0 ] .
e:own a sh:PropertyShape ; sh:targetSubjectsOf e:name ; sh:path e:name ; sh:maxLength 3 .
e:deep sh:targetSubjectsOf e:member ; sh:property [ sh:path e:member ; sh:property [ sh:path e:age ; sh:or ( [ sh:datatype xsd:integer ] [ sh:in ( "old" ) ] ) ; sh:maxCount 1 ] ] .
"""
    data = """e:t e:member e:a, e:b, e:c . e:u e:member e:a . e:a e:name "Ann" ; e:age 4, "old" . e:b a e:Robot ; e:name "Robot" ; e:age "new" . e:c e:age 7 ."""
    assert found(spark, tmp_path, shapes, data) == sorted([
        ("team", "t", "member", "c"), ("team", "t", "member", "b"), ("pair", "u", "member", "1"), ("few", "t", "member", "1"), ("own", "b", "name", "Robot"),
        ("deep", "a", "age", "2"), ("deep", "a", "age", "2"), ("deep", "b", "age", "new"),
    ], key=str)
