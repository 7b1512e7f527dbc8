"""Readers: texts of RDF, models and workbooks, in several files and with faults."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexigraph import api
from lexigraph.functions import names as N
from lexigraph.schema import TRIPLES
from lexigraph.sinks import documents as D
from lexigraph.sources import archimate, formats, rdf, xlsx, xmi


def test_turtle_syntax():
    text = '@prefix e: <http://e/> . # note\n@base <http://b/> .\ne:a a e:K ; e:p "x"@cs, 3, true ; e:q [ e:r <y> ] .\n_:n e:p """long\n"text""" .'
    got = {(s, p, o) for _, s, _, p, o, *_ in rdf.statements(text, "g")}
    assert ("http://e/a", "http://e/p", "3") in got and ("http://e/a", N.TYPE, "http://e/K") in got
    assert any(s.startswith("_:") and (p, o) == ("http://e/p", 'long\n"text') for s, p, o in got)
    node = next(o for s, p, o in got if p == "http://e/q")
    assert (node, "http://e/r", "http://b/y") in got and len(got) == 7


@pytest.mark.parametrize("text, want", [
    ("PREFIX e: <http://e/> e:a e:p 'single' ; e:q 1.5e3 .", [("p", "single", None), ("q", "1.5e3", "double")]),
    ("@prefix e: <http://e/> . e:a.b e:p '''it's''', -.5, e:x.y .", [("p", "it's", None), ("p", "-.5", "decimal"), ("p", "http://e/x.y", None)]),
    ("BASE <http://e/f/>\nprefix : <#>\n<a> <../p> :q, <>, <b%20c> .", [("p", "http://e/f/#q", None), ("p", "http://e/f/", None), ("p", "http://e/f/b%20c", None)]),
    ('@prefix e: <http://e/> . [] e:p "\\u00e1\\t\\\\n"^^e:t .', [("p", "á\t\\n", "http://e/t")]),
])
def test_turtle_terms(text, want):
    assert [(p.split("/")[-1], o, dt and dt.split("#")[-1]) for _, _, _, p, o, _, dt, _ in rdf.statements(text, "g")] == want


@pytest.mark.parametrize("text", [
    "@prefix e: <http://e/> . e:a e:p", "e:a e:p 1 .", "@prefix e: <http://e/> . e:a e:p 'x' 'y' .", "@prefix e: <http://e/> . e:a e:p ? .", '@prefix e: <http://e/> . e:a e:p "open .',
    "@prefix e: <http://e/> . e:a .", "<http://a> <http://b> 'x\\q' .", "'text' <http://b> 1 .",
])
def test_broken_turtle_is_refused(text):
    with pytest.raises(ValueError):
        rdf.statements(text, "g")


def test_files_and_their_errors(spark, tmp_path):
    """Blank nodes belong to their file, and what can't be read is told."""
    for folder in ("t", "n"):
        (tmp_path / folder).mkdir()
    for name, text in {"a": "_:b1 <http://p> 1 .", "b": "_:b1 <http://p> 2 .", "c": "_:b1 <http://p> ", "d": "\ufeff# empty"}.items():
        (tmp_path / "t" / f"{name}.ttl").write_text(text)
    path = str(tmp_path / "t")
    rows = rdf.read_turtle(spark, path).collect()
    assert sorted(r["o"] for r in rows) == ["1", "2"] and len({r["s"] for r in rows}) == 2
    assert [r["path"].split("/")[-1] for r in rdf.turtle_errors(spark, path).collect()] == ["c.ttl"]
    lines = [
        r'<http://a> <http://p> "c:\\new \u00e1\"\t" . # comment', "# only", "", "<http://a> <http://p> bad .", "_:x <http://p> _:y.", '<http://a> <http://p> "v"@cs-CZ .', '<http://a> <http://p> "5"^^<http://t> .',
    ]
    (tmp_path / "n" / "a.nt").write_text("\n".join(lines))
    (tmp_path / "n" / "b.nt").write_text("_:x <http://p> _:y .")
    rows = rdf.read_ntriples(spark, str(tmp_path / "n")).collect()
    assert {(r["o"], r["o_lang"], r["o_dt"]) for r in rows if r["o_kind"] == "literal"} == {('c:\\new á"\t', None, None), ("v", "cs-CZ", None), ("5", None, "http://t")}
    assert len({r["s"] for r in rows if r["s_kind"] == "bnode"}) == len({r["o"] for r in rows if r["o_kind"] == "bnode"}) == 2
    assert [r["error"] for r in rdf.ntriples_errors(spark, str(tmp_path / "n")).collect()] == ["no triple: <http://a> <http://p> bad ."]


def test_rdf_xml(spark, tmp_path):
    """The same graph in RDF/XML and in Turtle."""
    (tmp_path / "g.rdf").write_text(
        f'<rdf:RDF xmlns:rdf="{N.RDF}" xmlns:e="http://e/" xml:base="http://b/"><e:K rdf:about="x" e:q="at" xml:lang="cs"><e:p>text</e:p><e:r rdf:resource="#y"/><e:n rdf:nodeID="k"/>'
        '<e:c rdf:parseType="Collection"><rdf:Description rdf:about="z"/><rdf:Description rdf:about="w"/></e:c><e:d rdf:datatype="http://t">5</e:d><e:m rdf:parseType="Resource"><e:p xml:lang="">in</e:p></e:m></e:K>'
        '<rdf:Description rdf:nodeID="k"><e:p xml:lang="en">node</e:p></rdf:Description></rdf:RDF>'
    )
    (tmp_path / "g.ttl").write_text('@prefix e: <http://e/> . @base <http://b/> . <x> a e:K ; e:q "at"@cs ; e:p "text"@cs ; e:r <#y> ; e:n _:k ; e:c ( <z> <w> ) ; e:d "5"^^<http://t> ; e:m [ e:p "in" ] . _:k e:p "node"@en .')
    (tmp_path / "bad.rdf").write_text("<rdf:RDF")
    x, y = (rdf.canonical_blanks(t).drop("graph_id").collect() for t in (rdf.read_rdfxml(spark, str(tmp_path / "*.rdf")), rdf.read_turtle(spark, str(tmp_path / "g.ttl"))))
    assert len(x) == 14 and sorted(map(str, x)) == sorted(map(str, y))
    assert rdf.rdfxml_errors(spark, str(tmp_path / "*.rdf")).count() == 1


def test_models_of_one_folder(spark, tmp_path):
    """Two files with the same identifiers and names but exchanged definitions stay apart, and each has its own namespace."""

    def model(a, b, text, more):
        value = lambda r, v: f'<property propertyDefinitionRef="{r}"><value>{v}</value></property>'
        return (
            f'<model xmlns="http://www.opengroup.org/xsd/archimate/3.0/"><name xml:lang="cs">Slovník {text}</name><properties>{value("n", f"https://{text}.example/")}</properties>'
            f'<propertyDefinition identifier="n"><name>adresa lokálního katalogu dat</name></propertyDefinition><propertyDefinition identifier="p1"><name>{a}</name></propertyDefinition>'
            f'<propertyDefinition identifier="p2"><name>{b}</name></propertyDefinition><elements><element identifier="e1"><name xml:lang="cs">Vozidlo</name><name xml:lang="en">Car</name>'
            f'<properties>{value("p1", f"first {text}")}{value("p2", f"second {text}")}</properties></element><element identifier="e2"><name>{more}</name></element></elements></model>'
        )

    (tmp_path / "a.xml").write_text(model("popis", "definice", "a", "Řidič"))
    (tmp_path / "b.xml").write_text(model("definice", "popis", "b", "Adresa"))
    got = archimate.read_archimate(spark, str(tmp_path))
    assert {(r["name"], r["description"], r["definition"]) for r in got["classes"].collect()} == {("Vozidlo", "first a", "second a"), ("Vozidlo", "second b", "first b"), ("Řidič", None, None), ("Adresa", None, None)}
    assert {r["names"].get("lang=en") for r in got["classes"].where("name = 'Vozidlo'").collect()} == {"Car"}
    t = api.convert(spark, str(tmp_path), "ARCHI_XML").triples
    labels = {(r["s"], r["o"]) for r in t.where(F.col("p") == N.SKOS + "prefLabel").collect()}
    assert labels == {
        ("https://a.example/slovník-a/pojem/vozidlo", "Vozidlo"), ("https://b.example/slovník-b/pojem/vozidlo", "Vozidlo"), ("https://a.example/slovník-a/pojem/řidič", "Řidič"),
        ("https://b.example/slovník-b/pojem/adresa", "Adresa"), ("https://a.example/slovník-a", "Slovník a"), ("https://b.example/slovník-b", "Slovník b"),
    }
    assert {r["o"] for r in t.where((F.col("p") == N.SKOS + "definition") & F.col("s").startswith("https://b")).collect()} == {"first b"} and t.select("graph_id").distinct().count() == 2


def test_tag_names(spark):
    names = [
        "Základ - popis", "POPIS", "Zdroj", "Související zdroj", "Typ", "Datový typ", "Typ obsahu údaje", "AIS", "Agendový informační systém", "Agenda (kód)", "Je pojem veřejný?",
        "Ustanovení dokládající neveřejnost pojmu", "Způsob sdílení údaje", "Detail", "related source",
    ]
    d = spark.createDataFrame([([(n, f"v{i}") for i, n in enumerate(names)],)], f"tags {xmi.TAGS}")
    got = xmi.with_tags(d).first().asDict()
    assert {k: names[int(v[1:])] for k, v in got.items() if v} == {
        "description": "Základ - popis", "source": "Zdroj", "relatedSource": "Související zdroj", "type": "Typ", "dataType": "Datový typ", "contentType": "Typ obsahu údaje",
        "agendaSystemCode": "Agendový informační systém", "agendaCode": "Agenda (kód)", "isPublic": "Je pojem veřejný?", "privacyProvision": "Ustanovení dokládající neveřejnost pojmu", "sharingMethod": "Způsob sdílení údaje",
    }


def workbook(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, grid in enumerate(sheets.values()):
            cells = "".join(f'<c r="{chr(65 + c)}{r + 1}" t="{"n" if isinstance(v, float) else "inlineStr"}">' + (f"<v>{v}</v>" if isinstance(v, float) else f"<is><t>{v}</t></is>") + "</c>" for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData><row>{cells}</row></sheetData></worksheet>")
    path.write_bytes(b.getvalue())


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {
        "Slovník": [["Název slovníku:", "Zkouška"], ["Adresa lokálního katalogu dat, ve kterém bude slovník registrován:", "https://zk.example/"]],
        "Subjekty a objekty práva": [["úvod"], ["Název", "Typ", "Popis pojmu", "Agenda", "Agendový informační systém", "Nadřazený pojem", "Alternativní název"], [" Řidič ", "Subjekt práva", 5.0, "A12", 7.0, "Účastník", "Šofér;Pilot"], [None, "x"], ["Účastník"]],
        "Vlastnosti": [["Název", "Subjekt nebo objekt práva", "Související zdroj", "Je pojem sdílen v PPDF?"], ["Jméno", "Řidič", "kniha", "ano"]],
        "Vztahy": [["Subjekt nebo objekt práva", "Název", None, "Zdroj"], ["Řidič", "řídí", "Vozidlo", "https://x.example/eli/cz/sb/1"]],
    })
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    workbook(tmp_path / "c.xlsx", {"Slovník": [["Název slovníku:", "x"]]})
    got = xlsx.read_xlsx(spark, str(tmp_path))
    assert [(r["name"], r["type"], r["description"], r["agendaCode"], r["agendaSystemCode"]) for r in got["classes"].orderBy("row").collect()] == [("Řidič", "Subjekt práva", "5", "A12", "7"), ("Účastník", None, None, None, None)]
    assert [(r["name"], r["domain"], r["relatedSource"], r["sharedInPPDF"]) for r in got["properties"].collect()] == [("Jméno", "Řidič", "kniha", "ano")]
    assert [(r["domain"], r["name"], r["range"]) for r in got["relationships"].collect()] == [("Řidič", "řídí", "Vozidlo")]
    assert [(r["name"], r["namespace"]) for r in got["vocabulary"].collect()] == [("Zkouška", "https://zk.example/")]
    assert sorted(r["path"].split("/")[-1] for r in xlsx.workbook_errors(spark, str(tmp_path)).collect()) == ["b.xlsx", "c.xlsx"]
    t = api.convert(spark, str(tmp_path / "a.xlsx"), "XLSX").triples
    facts = {(r["s"].split("/")[-1], r["p"].split("/")[-1].split("#")[-1], r["o"].split("/")[-1]) for r in t.where("s_kind = 'iri'").collect()}
    assert {("řidič", "subClassOf", "účastník"), ("řidič", "altLabel", "Šofér"), ("řidič", "altLabel", "Pilot"), ("jméno", "domain", "řidič"), ("řídí", "range", "vozidlo"), ("řídí", N.DEFINING_LAW, "1"), ("zkouška", "prefLabel", "Zkouška")} <= facts
    assert any(s == "jméno" and p == N.RELATED_OTHER for s, p, _ in facts)


def test_cell_texts():
    styles = (
        b'<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="d/m/yy"/><numFmt numFmtId="171" formatCode="0.0 &quot;dm&quot;"/></numFmts>'
        b'<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    )
    assert xlsx.date_styles(styles) == {1, 2} and xlsx.date_styles(None) == set()
    assert xlsx.cell_text("n", "45292", [], True) == "2024-01-01" and xlsx.cell_text(None, "45292.5", [], True) == "2024-01-01T12:00:00"
    assert xlsx.cell_text(None, "5.0", []) == "5" and xlsx.cell_text("b", "1", []) == "true" and xlsx.cell_text("s", "0", [" x "]) == "x"


def test_large_files_are_refused(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("# small")
    (tmp_path / "b.ttl").write_text("#" * (formats.MAX_BYTES + 1))
    got = {r["path"].split("/")[-1]: (r["format"], r["error"]) for r in formats.inputs(spark, str(tmp_path)).collect()}
    assert got["a.ttl"] == ("TURTLE", None) and got["b.ttl"][0] is None and "larger" in got["b.ttl"][1]


def test_charsets(spark, tmp_path):
    """Bytes tell their charset, and a model that declares another than UTF-8 is read in it."""
    name = "Řidič"
    text = (
        '<?xml version="1.0" encoding="CHARSET"?><xmi:XMI xmlns:xmi="http://schema.omg.org/spec/XMI/2.1"><element xmi:idref="p" xmi:type="uml:Package" name="V"><properties stereotype="slovnikyPackage"/></element>'
        f'<element xmi:idref="e" xmi:type="uml:Class" name="{name}"><model package="p"/><properties stereotype="typSubjektu"/></element></xmi:XMI>'
    )
    for folder, charset, written in (("u", "UTF-8", name), ("l", "ISO-8859-2", name + "\x8d"), ("w", "windows-1252", "café")):
        (tmp_path / folder).mkdir()
        path = str(tmp_path / folder)
        (tmp_path / folder / "m.xml").write_bytes(text.replace(name, written).replace("CHARSET", charset).encode(charset))
        assert [r["charset"] for r in formats.inputs(spark, path).collect()] == [charset]
        if folder != "l":  # its control character isn't allowed in XML
            assert [r["name"] for r in xmi.read_xmi(spark, path)["classes"].collect()] == [written]


def test_long_iris(spark, tmp_path):
    long = N.OFN + "x" * 12_000
    t = spark.createDataFrame([("g", "https://a.example/x", "iri", long, long, "iri", None, None)], TRIPLES)
    D.write_turtle(t, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert [(r[3], r[4]) for r in rdf.statements(text, "g")] == [(long, long)]


def graph_of(spark, text):
    return spark.createDataFrame(rdf.statements("@prefix e: <http://e/> . " + text, "g"), TRIPLES)


def test_graphs_compare_whatever_blank_nodes_are_called(spark):
    """Chains of five blank nodes that differ at their ends only, alike siblings, copies and a circle."""
    from lexigraph.operators.isomorphism import canonical_blanks, graph_difference

    chain = lambda x, end: f"e:{x} e:p _:{x}1 . " + " ".join(f"_:{x}{i} e:p _:{x}{i + 1} ." for i in range(1, 5)) + f" _:{x}5 e:p '{end}' . "
    free = lambda x, end: chain(x, end).replace(f"e:{x} e:p _:{x}1 . ", "")
    first = chain("a", "x") + chain("b", "x") + free("c", "x") + free("d", "y") + free("e", "y") + "e:t e:child [ e:n 1 ], [ e:n 1 ] . _:u e:p _:v . _:v e:p _:w . _:w e:p _:u ."
    renamed = "_:m e:p _:k . _:k e:p _:l . _:l e:p _:m . " + free("z", "x") + free("q", "y") + free("r", "y") + chain("b", "x").replace("_:b", "_:o") + chain("a", "x").replace("_:a", "_:bb") + "e:t e:child [ e:n 1 ], [ e:n 1 ] ."
    x = graph_of(spark, first)
    named = canonical_blanks(x).drop("graph_id").collect()
    again = canonical_blanks(graph_of(spark, renamed)).drop("graph_id").collect()
    assert sorted(map(str, named)) == sorted(map(str, again)) and len(set(named)) == len(named)
    assert len({r["s"] for r in named if r["s_kind"] == "bnode"}) == 25 + 2 + 3
    other = first.replace("_:b5 e:p 'x'", "_:b5 e:p 'z'").replace("[ e:n 1 ], [ e:n 1 ]", "[ e:n 1 ], [ e:n 1 ], [ e:n 1 ]").replace(free("e", "y"), "")
    found = [(r["side"], r["p"][-1]) for r in graph_difference(x, graph_of(spark, other)).collect()]
    # The chain b on both sides, the copy e on the left, a third sibling on the right.
    assert sorted(found).count(("left", "p")) == 6 + 5 and found.count(("right", "p")) == 6 and found.count(("right", "d")) == 1 and len(found) == 11 + 6 + 2


def test_surrogates_and_rdf_xml_forms(spark, tmp_path):
    for code in ("\\uD800", "\\uDFFF", "\\U00110000"):
        with pytest.raises(ValueError, match="no character"):
            rdf.statements(f'<http://a> <http://b> "{code}" .', "g")
    text = (
        f'<rdf:RDF xmlns:rdf="{N.RDF}" xmlns:e="http://e/" xml:base="http://b/"><rdf:Bag rdf:about="x"><rdf:li>1</rdf:li><e:p>p</e:p><rdf:li rdf:resource="y"/></rdf:Bag>'
        '<rdf:Description rdf:about="z"><e:p rdf:ID="st">v</e:p><e:q e:r="in"/></rdf:Description></rdf:RDF>'
    )
    want = (
        f'@prefix e: <http://e/> . @prefix rdf: <{N.RDF}> . @base <http://b/> . <x> a rdf:Bag ; rdf:_1 "1" ; e:p "p" ; rdf:_2 <y> . <z> e:p "v" ; e:q [ e:r "in" ] .'
        ' <#st> a rdf:Statement ; rdf:subject <z> ; rdf:predicate e:p ; rdf:object "v" .'
    )
    from lexigraph.operators.isomorphism import graph_difference

    assert graph_difference(spark.createDataFrame(rdf.xml_statements(text, "g"), TRIPLES), spark.createDataFrame(rdf.statements(want, "g"), TRIPLES)).count() == 0


XMI_TEXT = (
    '<?xml version="1.0" encoding="CHARSET"?><xmi:XMI xmlns:xmi="http://schema.omg.org/spec/XMI/2.1"><element xmi:idref="p" xmi:type="uml:Package" name="V"><properties stereotype="slovnikyPackage"/></element>'
    '<element xmi:idref="e" xmi:type="uml:Class" name="NAME"><model package="p"/><properties stereotype="typSubjektu"/></element></xmi:XMI>'
)


def test_models_in_other_charsets_and_broken_ones(spark, tmp_path):
    """Files whose bytes aren't in the charset that they declare are read in the first one in which they are XML; broken files are told, and give nothing."""
    assert formats.xml_charset("<a>é</a>".encode()) == (None, None) and formats.xml_charset("<a>é</a>".encode("windows-1252")) == ("windows-1252", None)
    assert formats.xml_charset('<?xml version="1.0" encoding="UTF-8"?><a>\x8d</a>'.encode("ISO-8859-2")) == ("ISO-8859-2", None) and formats.xml_charset(b"<a>")[1]
    model = lambda name, declared, charset: XMI_TEXT.replace("NAME", name).replace("CHARSET", declared).encode(charset)
    (tmp_path / "a.xml").write_bytes(model("Řidič", "UTF-8", "UTF-8"))
    (tmp_path / "b.xml").write_bytes(model("café", "UTF-8", "windows-1252"))
    (tmp_path / "c.xml").write_bytes(model("Ž\xadlut", "UTF-8", "ISO-8859-2") + b"<!-- \x8d -->")
    (tmp_path / "d.xml").write_bytes(model("x", "UTF-8", "UTF-8")[:-40])
    (tmp_path / "e.xml").write_bytes(model("déclaré", "ISO-8859-1", "ISO-8859-1"))
    (tmp_path / "f.xml").write_bytes(b"<a>" + b" " * formats.MAX_BYTES + b"</a>")
    got = api.convert(spark, str(tmp_path), "XMI")
    errors = {r["path"].split("/")[-1]: r["error"] for r in got.errors.collect()}
    assert sorted(errors) == ["d.xml", "f.xml"] and "larger" in errors["f.xml"]
    labels = {r["graph_id"].split("/")[-1]: r["o"] for r in got.triples.where((F.col("p") == N.SKOS + "prefLabel") & (F.col("o") != "V")).collect()}
    assert labels["a.xml"] == "Řidič" and labels["b.xml"] == "café" and labels["e.xml"] == "déclaré" and sorted(labels) == ["a.xml", "b.xml", "c.xml", "e.xml"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.xml").write_text('<model xmlns="http://www.opengroup.org/xsd/archimate/3.0/"><name>X</name><elements><element identifier="e"><name>N')
    broken = api.convert(spark, str(tmp_path / "m"), "ARCHI_XML")
    assert broken.triples.count() == 0 and broken.errors.count() == 1


JSONLD = """{"@context": [{"e": "http://e/", "name": {"@id": "e:name", "@container": "@language"}, "knows": {"@id": "e:knows", "@type": "@id"}, "born": {"@id": "e:born", "@type": "http://www.w3.org/2001/XMLSchema#date"},
  "steps": {"@id": "e:steps", "@container": "@list"}, "of": {"@reverse": "e:has"}, "plain": {"@id": "e:plain", "@language": null}, "id": "@id", "in": {"@id": "e:in", "@context": {"name": "e:title"}}}, {"@vocab": "http://v/", "@language": "cs", "@base": "http://b/x/"}],
 "@graph": [{"id": "a", "@type": ["e:K", "L"], "name": {"cs": "A", "en": ["B", "C"], "@none": "D"}, "knows": ["b", {"id": "_:n", "word": "in"}], "born": "2024-01-01", "steps": [1, 2.5, true], "of": "e:owner",
   "plain": "p", "free": ["text", {"@value": "t", "@language": "de"}, {"@value": "5", "@type": "e:t"}, null, {"@set": [1e30]}], "in": {"name": "T"}, "@unknown": 1}]}"""


def test_jsonld(spark, tmp_path):
    from lexigraph.operators.isomorphism import graph_difference
    from lexigraph.sources import jsonld

    good = JSONLD.replace(', "@unknown": 1', "")
    want = """@base <http://b/x/> . @prefix v: <http://v/> . @prefix x: <http://www.w3.org/2001/XMLSchema#> . <a> a e:K, v:L ; e:name "A"@cs, "B"@en, "C"@en, "D" ; e:knows <b>, _:m ; e:born "2024-01-01"^^x:date ;
      e:steps ( 1 "2.5E0"^^x:double true ) ; e:plain "p" ; v:free "text"@cs, "t"@de, "5"^^e:t, "1.0E30"^^x:double ; e:in [ e:title "T"@cs ] . _:m v:word "in"@cs . e:owner e:has <a> ."""
    files = {"a.jsonld": good, "b.jsonld": JSONLD, "c.jsonld": '{"@context": "https://nowhere.example/", "p": 1}', "d.jsonld": '{"a": ', "e.jsonld": "[1]"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = api.convert(spark, str(tmp_path), "JSON-LD")
    assert graph_difference(got.triples, graph_of(spark, want)).collect() == []
    assert sorted(r["path"][-8:] for r in got.errors.collect()) == ["b.jsonld", "c.jsonld", "d.jsonld", "e.jsonld"]
    known = {"https://nowhere.example/": {"@context": {"p": "http://e/p"}}}
    assert [(r[3], r[4]) for r in jsonld.statements(files["c.jsonld"], "g", known)] == [("http://e/p", "1")]


def test_a_folder_of_several_formats(spark, tmp_path):
    """Formats are found out, what can't be read is told, the graph is declared, filtered, published and read back."""
    good = JSONLD.replace(', "@unknown": 1', "")
    (tmp_path / "a.xml").write_text(XMI_TEXT.replace("NAME", "Řidič").replace("CHARSET", "UTF-8").replace("</xmi:XMI>", '<element xmi:idref="f" xmi:type="uml:Class" name="Auto"><model package="p"/><properties stereotype="typObjektu"/>'
        '<tags><tag name="identifikátor" value="https://slovník.gov.cz/x/pojem/auto-9"/></tags></element></xmi:XMI>'))  # fmt: skip
    (tmp_path / "b.jsonld").write_text(good)
    (tmp_path / "c.ttl").write_text(f'<https://slovník.gov.cz/x> a <{N.OWL}Ontology> ; <{N.RDFS}label> "plain", "Slovník"@cs ; <{N.DCT}description> "text"@en . <https://slovník.gov.cz/x/pojem/y> a <{N.OFN}pojem> ; <{N.SKOS}prefLabel> "Y" .')
    (tmp_path / "d.nt").write_text("<http://a> <http://p> bad .\n<http://a> <http://p> <http://b> .")
    (tmp_path / "e.txt").write_text("nothing")
    (tmp_path / "f.xml").write_text("<?xml version='1.0'?><xmi:XMI xmlns:xmi='http://schema.omg.org/spec/XMI/2.1'><element>")
    got = api.convert(spark, str(tmp_path), without=".*-9", declare=True)
    assert sorted(r["path"].split("/")[-1] for r in got.errors.collect()) == ["d.nt", "e.txt", "f.xml"]
    facts = {(r["s"].split("/")[-1], r["p"].split("#")[-1].split("/")[-1], r["o"].split("/")[-1]) for r in got.triples.collect()}
    assert {("řidič", "prefLabel", "Řidič"), ("y", "prefLabel", "Y"), ("a", "p", "b"), ("a", "plain", "p"), ("pojem", "type", "owl#Class")} <= {(s, p, o.split("/")[-1]) for s, p, o in facts} and not any(o == "Auto" for *_, o in facts)
    record = {r["name"]: r["record"] for r in got.catalog().collect()} if got.may_publish() else {}
    assert '"cs":"Slovník","en":"plain"' in record["Slovník"] and '"en":"text"' in record["Slovník"]
    got.write_turtle(str(tmp_path / "out"))
    back = rdf.read_turtle(spark, str(tmp_path / "out"))
    assert rdf.turtle_errors(spark, str(tmp_path / "out")).count() == 0 and sorted(r["o"] for r in back.where(F.col("p") == N.SKOS + "prefLabel").collect()) == ["Slovník", "V", "Y", "plain", "Řidič"]
