"""RDF text as triples. N-Triples lines are read by the engine; a Turtle, RDF/XML or JSON-LD document is read by a small
helper, a file at a time. Blank nodes belong to their file: equal labels in two files are two nodes.

What can't be read is told in rows: see ``turtle_errors`` and ``ntriples_errors``."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexigraph.functions import names as N
from lexigraph.operators.isomorphism import canonical_blanks  # noqa: F401
from lexigraph.schema import TRIPLES

LINE = r'^\s*(<[^<>\s]*>|_:[^\s<>"]+)\s*<([^<>\s]*)>\s*(?:<([^<>\s]*)>|(_:[^\s<>"]*[^\s<>".])|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>\s]*)>)?)\s*\.\s*(?:#.*)?$'
#: The letters of escapes and what they stand for.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


def escapes_decoded(c: Column) -> Column:
    r"""A text with \n, \" and the like, \uXXXX and \UXXXXXXXX as the characters that they stand for, from left to right."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))
    plain = F.create_map(*[F.lit(x) for k, v in ESCAPES.items() for x in ("\\" + k, v)])

    def char(x: Column) -> Column:
        code = F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
        return F.when(x.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), code).otherwise(F.coalesce(F.try_element_at(plain, x), x))

    return F.when(c.contains("\\"), F.array_join(F.transform(parts, char), "")).otherwise(c)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(~F.col("value").rlike(r"^\s*(#.*)?$"))


def scoped(path: Column, label: Column) -> Column:
    """Name of a file's blank node."""
    return F.concat(F.lit("_:"), F.substring(F.sha2(F.concat_ws("|", path, label), 256), 1, 32))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files, a line a triple; each file is a graph by its path."""
    x = _lines(spark, path).where(F.col("value").rlike(LINE))
    part = lambda i: F.regexp_extract("value", LINE, i)
    s, o_iri, o_node, lang, dt = part(1), part(3), part(4), part(6), part(7)
    is_iri, file = s.startswith("<"), F.col("path")
    return x.select(
        file.alias("graph_id"), F.when(is_iri, escapes_decoded(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(scoped(file, s)).alias("s"), F.when(is_iri, "iri").otherwise("bnode").alias("s_kind"),
        escapes_decoded(part(2)).alias("p"), F.when(o_iri != "", escapes_decoded(o_iri)).when(o_node != "", scoped(file, o_node)).otherwise(escapes_decoded(part(5))).alias("o"),
        F.when(o_iri != "", "iri").when(o_node != "", "bnode").otherwise("literal").alias("o_kind"), F.when(dt != "", escapes_decoded(dt)).alias("o_dt"), F.when(lang != "", lang).alias("o_lang"),
    )


def ntriples_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) for every line that is no triple, comment or blank."""
    return _lines(spark, path).where(~F.col("value").rlike(LINE)).select("path", F.concat(F.lit("no triple: "), "value").alias("error"))


# A Turtle text's tokens, by kind; a text must be made of them without gaps.
LOCAL = r"(?:[\w·‿⁀:-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?#@%])"
TOKENS = re.compile(
    "|".join(
        f"(?P<{kind}>{pattern})"
        for kind, pattern in {
            "gap": r"\s+|#[^\n]*",
            "iri": r"<[^<>\"{}|^`\s]*>",
            "text": r'"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n\r]|\\.)*"|\'(?:[^\'\\\n\r]|\\.)*\'',
            "node": r"_:\w(?:[\w.·-]*[\w·-])?",
            "name": rf"(?:[^\W\d_](?:[\w.·-]*[\w·-])?)?:(?:{LOCAL}(?:(?:{LOCAL}|\.)*{LOCAL})?)?",
            "number": r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)[eE][-+]?\d+|[-+]?\d*\.\d+|[-+]?\d+",
            "at": r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*",
            "type": r"\^\^",
            "word": r"[A-Za-z]+",
            "sign": r"[;,.\[\]()]",
        }.items()
    ),
    re.S,
)


def tokens_of(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKENS.match(text, at)
        if not m:
            raise ValueError(f"line {text.count(chr(10), 0, at) + 1} can't be read: {text[at : at + 40]!r}")
        if m.lastgroup != "gap":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


def unescaped(text: str) -> str:
    def char(m: re.Match) -> str:
        if m[3]:
            if m[3] not in ESCAPES:
                raise ValueError(f"there is no escape \\{m[3]}")
            return ESCAPES[m[3]]
        code = int(m[1] or m[2], 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            raise ValueError(f"there is no character {m[0]}")
        return chr(code)

    return ESCAPE.sub(char, text)


class Reader:
    """Rows of one Turtle text. Every method takes the place of a token and gives the place after what it has read."""

    def __init__(self, text: str, graph: str):
        self.tokens, self.graph, self.rows = [*tokens_of(text), ("end", "")], graph, []
        self.prefixes: dict[str, str] = {}
        self.base, self.made = "", 0

    def blank(self, label: str | None = None) -> str:
        self.made += label is None
        return "_:" + hashlib.sha256(f"{self.graph}|{label or self.made}".encode()).hexdigest()[:32]

    def add(self, s: tuple, p: str, o: tuple) -> None:
        self.rows.append((self.graph, s[0], s[1], p, *o))

    def expect(self, i: int, *wanted: str) -> int:
        if self.tokens[i][1] not in wanted:
            raise ValueError(f"{' or '.join(wanted)} is missing before {self.tokens[i][1] or 'the end'!r}")
        return i + 1

    def iri(self, i: int) -> tuple[str, int]:
        kind, text = self.tokens[i]
        if kind == "iri":
            x = unescaped(text[1:-1])
            return x if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", x) else self.resolved(x), i + 1
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"the prefix {prefix}: isn't declared")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), i + 1
        raise ValueError(f"an IRI is missing before {text or 'the end'!r}")

    def resolved(self, relative: str) -> str:
        from urllib.parse import urljoin

        if not relative or relative.startswith("#"):
            return self.base.split("#")[0] + relative
        return urljoin(self.base, relative) if self.base.startswith(("http", "file", "ftp")) else self.base + relative

    def term(self, i: int) -> tuple[tuple, int]:
        """(value, kind, type, language) of a subject or object."""
        kind, text = self.tokens[i]
        if kind == "text":
            size = 3 if text[:3] in ('"""', "'''") else 1
            value, (then, more) = unescaped(text[size:-size]), self.tokens[i + 1]
            if then == "at":
                return (value, "literal", None, more[1:]), i + 2
            if then == "type":
                dt, i = self.iri(i + 2)
                return (value, "literal", dt, None), i
            return (value, "literal", None, None), i + 1
        if kind == "number":
            return (text, "literal", N.XSD + ("double" if re.search("[eE]", text) else "decimal" if "." in text else "integer"), None), i + 1
        if kind == "word" and text in ("true", "false"):
            return (text, "literal", N.XSD + "boolean", None), i + 1
        if kind == "node":
            return (self.blank(text), "bnode", None, None), i + 1
        if text == "[":
            node = (self.blank(), "bnode", None, None)
            return node, self.expect(self.pairs(node, i + 1, "]"), "]")
        if text == "(":
            return self.listed(i + 1)
        value, i = self.iri(i)
        return (value, "iri", None, None), i

    def listed(self, i: int) -> tuple[tuple, int]:
        last = head = None
        while self.tokens[i][1] != ")":
            item, i = self.term(i)
            node = (self.blank(), "bnode", None, None)
            self.add(node, N.RDF + "first", item)
            if last:
                self.add(last, N.RDF + "rest", node)
            head, last = head or node, node
        nil = (N.RDF + "nil", "iri", None, None)
        if last:
            self.add(last, N.RDF + "rest", nil)
        return head or nil, i + 1

    def pairs(self, s: tuple, i: int, end: str) -> int:
        """Predicates and objects of a subject up to ``end``."""
        while self.tokens[i][1] != end:
            if self.tokens[i][1] == ";":
                i += 1
                continue
            p, i = (N.TYPE, i + 1) if self.tokens[i] == ("word", "a") else self.iri(i)
            o, i = self.term(i)
            self.add(s, p, o)
            while self.tokens[i][1] == ",":
                o, i = self.term(i + 1)
                self.add(s, p, o)
            if self.tokens[i][1] != end:
                self.expect(i, ";", end)
        return i

    def read(self) -> list[tuple]:
        i = 0
        while self.tokens[i][0] != "end":
            kind, text = self.tokens[i]
            directive = text.lower().lstrip("@") if kind in ("word", "at") else ""
            if directive == "prefix":
                if self.tokens[i + 1][0] != "name" or not self.tokens[i + 1][1].endswith(":"):
                    raise ValueError("a prefix is missing")
                self.prefixes[self.tokens[i + 1][1][:-1]], i = self.iri(i + 2)
            elif directive == "base":
                self.base, i = self.iri(i + 1)
            else:
                s, at = self.term(i)
                if s[1] == "literal":
                    raise ValueError(f"a literal can't be a subject: {s[0][:40]!r}")
                i = self.pairs(s, at, ".")
                if i == at and text != "[":
                    raise ValueError(f"{s[0]} has no predicate")
            if kind != "word" or not directive:
                i = self.expect(i, ".")
        return self.rows


def statements(text: str, graph: str) -> list[tuple]:
    """Rows of a Turtle text: directives in both forms, a, ; and , lists, [] nodes, () lists, literals with language or type.

    A text that isn't Turtle raises ValueError; nothing is passed over."""
    return Reader(text.removeprefix("﻿"), graph).read()


#: Triples with their place in their file, and the error of a file that has none.
CHECKED = StructType([*TRIPLES.fields, StructField("error", StringType())])
PLACED = StructType([*TRIPLES.fields, StructField("place", LongType())])


def read_checked(spark: SparkSession, path: str, parse: Callable[[str, str], list[tuple]]) -> DataFrame:
    """Triples of the documents at ``path``, each file a graph by its path, and for each file that can't be read one row with its ``error``."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows = [(*r, None) for r in parse(text, where)]
                except (ValueError, IndexError, KeyError, TypeError, AttributeError, RecursionError) as e:
                    rows = [(where, *[None] * 7, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=CHECKED.names, dtype=object)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.mapInPandas(split, CHECKED)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files; each file is a graph by its path. A file that can't be read gives no rows here, but one of ``turtle_errors``."""
    return read_checked(spark, path, statements).where("error IS NULL").drop("error")


def read_turtle_in_order(spark: SparkSession, path: str) -> DataFrame:
    """``read_turtle`` with ``place``, the number of the triple in its file, for what depends on the document's order
    (``graph.first_values``, ``graph.fold_ordered``). Joins and filters keep it."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows = statements(text, where)
                except (ValueError, IndexError, KeyError, RecursionError):
                    rows = []  # told by turtle_errors
                yield pd.DataFrame([(*r, i) for i, r in enumerate(rows)], columns=PLACED.names, dtype=object)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.mapInPandas(split, PLACED)


def turtle_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) for every Turtle file that can't be read."""
    return read_checked(spark, path, statements).where("error IS NOT NULL").select(F.col("graph_id").alias("path"), "error")


def xml_statements(text: str, graph: str) -> list[tuple]:
    """Rows of an RDF/XML text: typed nodes, property attributes, resource, nodeID, parseType Resource, Collection and Literal, xml:lang and xml:base."""
    from xml.etree import ElementTree

    rdf, xml = "{" + N.RDF + "}", "{http://www.w3.org/XML/1998/namespace}"
    ids, rows = Reader("", graph), []
    if "<!ENTITY" in text or "<!DOCTYPE" in text:
        raise ValueError("document types aren't read")
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise ValueError(str(e)) from e
    plain = lambda tag: tag[1:].replace("}", "") if tag.startswith("{") else tag

    def address(value: str, base: str) -> str:
        ids.base = base
        return value if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) else ids.resolved(value)

    def inherited(e: ElementTree.Element, lang: str | None, base: str) -> tuple[str | None, str]:
        return e.get(xml + "lang", lang) or None, e.get(xml + "base", base)

    def node(e: ElementTree.Element, lang: str | None, base: str) -> tuple:
        lang, base = inherited(e, lang, base)
        if (about := e.get(rdf + "about")) is not None:
            s = (address(about, base), "iri", None, None)
        elif (name := e.get(rdf + "ID")) is not None:
            s = (address("#" + name, base), "iri", None, None)
        else:
            label = e.get(rdf + "nodeID")
            s = (ids.blank(label and "_:" + label), "bnode", None, None)
        if e.tag != rdf + "Description":
            rows.append((graph, *s[:2], N.TYPE, plain(e.tag), "iri", None, None))
        facts(e, s, lang)
        contents(e, s, lang, base)
        return s

    def contents(e: ElementTree.Element, s: tuple, lang: str | None, base: str) -> None:
        items = 0
        for child in e:
            items += child.tag == rdf + "li"
            p = f"{N.RDF}_{items}" if child.tag == rdf + "li" else plain(child.tag)
            o = value(child, lang, base)
            rows.append((graph, *s[:2], p, *o))
            if (name := child.get(rdf + "ID")) is not None:  # the statement itself has a name
                statement = (address("#" + name, child.get(xml + "base", base)), "iri")
                told = ((N.TYPE, N.RDF + "Statement", "iri", None, None), (N.RDF + "subject", *s[:2], None, None), (N.RDF + "predicate", p, "iri", None, None), (N.RDF + "object", *o))
                rows.extend((graph, *statement, *t) for t in told)

    def facts(e: ElementTree.Element, s: tuple, lang: str | None) -> None:
        for k, v in e.attrib.items():
            if k == rdf + "type":
                rows.append((graph, *s[:2], N.TYPE, v, "iri", None, None))
            elif not k.startswith((rdf, xml)) and k.startswith("{"):
                rows.append((graph, *s[:2], plain(k), v, "literal", None, lang))

    def value(e: ElementTree.Element, lang: str | None, base: str) -> tuple:
        lang, base = inherited(e, lang, base)
        kind = e.get(rdf + "parseType")
        if (to := e.get(rdf + "resource")) is not None or (label := e.get(rdf + "nodeID")) is not None:
            o = (address(to, base), "iri", None, None) if to is not None else (ids.blank("_:" + label), "bnode", None, None)
            facts(e, o, lang)
            return o
        if kind == "Literal":
            return ((e.text or "") + "".join(ElementTree.tostring(x, encoding="unicode") for x in e), "literal", N.RDF + "XMLLiteral", None)
        if kind == "Resource":
            o = (ids.blank(), "bnode", None, None)
            contents(e, o, lang, base)
            return o
        if kind == "Collection":
            o = (N.RDF + "nil", "iri", None, None)
            for item in [node(x, lang, base) for x in e][::-1]:
                cell = (ids.blank(), "bnode", None, None)
                rows.extend([(graph, *cell[:2], N.RDF + "first", *item), (graph, *cell[:2], N.RDF + "rest", *o)])
                o = cell
            return o
        if len(e):
            return node(e[0], lang, base)
        if any(k.startswith("{") and not k.startswith((rdf, xml)) or k == rdf + "type" for k in e.attrib):
            o = (ids.blank(), "bnode", None, None)
            facts(e, o, lang)
            return o
        return (e.text or "", "literal", dt, None) if (dt := e.get(rdf + "datatype")) else (e.text or "", "literal", None, lang)

    lang, base = inherited(root, None, "")
    for e in root if root.tag == rdf + "RDF" else [root]:
        node(e, lang, base)
    return rows


def read_rdfxml(spark: SparkSession, path: str) -> DataFrame:
    """Triples of RDF/XML files, as read_turtle."""
    return read_checked(spark, path, xml_statements).where("error IS NULL").drop("error")


def rdfxml_errors(spark: SparkSession, path: str) -> DataFrame:
    return read_checked(spark, path, xml_statements).where("error IS NOT NULL").select(F.col("graph_id").alias("path"), "error")
