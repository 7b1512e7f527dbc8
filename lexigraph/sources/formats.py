"""Which format an input has, in which charset it is written, and whether it can be read."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.operators.hierarchy import cut, shared_dir

ARCHI = "opengroup.org/xsd/archimate"
XMI = ("http://schema.omg.org/spec/XMI", "http://www.omg.org/spec/XMI", "xmi:XMI", "xmlns:xmi")
#: Largest input in bytes.
MAX_BYTES = 5_242_880


def sniff(name: Column, content_type: Column, text: Column) -> Column:
    """XLSX by name, then ArchiMate and XMI by the first 4096 characters of an XML text, Turtle by type or name, N-Triples and JSON-LD by
    name, RDF/XML by its namespace, HTML by its doctype, else UNSUPPORTED."""
    head = F.substring(text, 1, 4096)
    xml = F.coalesce(content_type.contains("xml"), F.lit(False)) | head.startswith("<?xml")
    is_xmi = head.contains(XMI[0])
    for mark in XMI[1:]:
        is_xmi = is_xmi | head.contains(mark)
    return (
        F.when(F.lower(name).endswith(".xlsx"), "XLSX")
        .when(xml & head.contains(ARCHI), "ARCHI_XML")
        .when(xml & is_xmi, "XMI")
        .when((content_type == "text/turtle") | F.lower(name).endswith(".ttl"), "TURTLE")
        .when(F.lower(name).endswith(".nt"), "N-TRIPLES")
        .when(F.lower(name).endswith(".jsonld"), "JSON-LD")
        .when(xml & head.contains("http://www.w3.org/1999/02/22-rdf-syntax-ns#"), "RDF/XML")
        .when(F.lower(head).contains("<!doctype html"), "HTML")
        .otherwise("UNSUPPORTED")
    )


def charset_of(content: Column) -> Column:
    """The first of UTF-8, windows-1252 and ISO-8859-2 in which a file's bytes are all defined."""
    undefined = F.hex(content).rlike("^(?:..)*?(?:81|8D|8F|90|9D)")
    return F.when(F.is_valid_utf8(content.cast("string")), "UTF-8").when(~undefined, "windows-1252").otherwise("ISO-8859-2")


def inputs(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, charset, length, content, error) of the files below ``path``. A file over the size limit is refused: it has an
    error and no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > MAX_BYTES
    head = sniff(F.col("path"), F.lit(""), F.decode(F.expr("substring(content, 1, 4096)"), "ISO-8859-1"))
    return files.select("path", F.when(~large, head).alias("format"), F.when(~large, charset_of(F.col("content"))).alias("charset"), "length", F.when(~large, F.col("content")).alias("content"), F.when(large, F.lit(f"larger than {MAX_BYTES} bytes")).alias("error"))


#: Charsets that are tried in turn where a file can't be read as it declares itself.
FALLBACK = ("UTF-8", "windows-1252", "ISO-8859-2")
PROLOG = re.compile(r"\A\ufeff?\s*<\?xml[^>]*\?>")


def xml_charset(content: bytes) -> tuple[str | None, str | None]:
    """(charset, error): the charset to read a document in, None if as it declares itself; or why it can't be read in any."""

    def fault(data: bytes | str) -> str | None:
        try:
            expat.ParserCreate().Parse(data, True)
        except (expat.ExpatError, ValueError, LookupError) as e:
            return str(e)
        return None

    first = fault(content)
    if first is None:
        return None, None
    for charset in FALLBACK:
        try:
            text = content.decode(charset)
        except UnicodeDecodeError:
            continue
        if fault(PROLOG.sub("", text)) is None:
            return charset, None
    return None, first


@dataclass(frozen=True)
class XmlFiles:
    """XML files with what is known of each (model, charset, error), ``model`` being its path."""

    spark: SparkSession
    known: DataFrame
    plain: list[str]  # read as the files declare themselves
    decoded: str | None  # folder of the others' texts, a folder a file by the hash of its path

    def rows(self, tag: str, schema: str) -> DataFrame:
        """The elements called ``tag`` of the files that can be read, with their ``__file`` and ``__place`` in it."""

        def load(paths: str | list[str]) -> DataFrame:
            found = self.spark.read.format("xml").option("rowTag", tag).schema(schema).load(paths)
            return found.withColumns({"__file": F.col("_metadata.file_path"), "__place": F.monotonically_increasing_id()})

        parts = [load(self.plain)] if self.plain else []
        if self.decoded:
            names = self.known.where("charset is not null").select(F.sha2("model", 256).alias("__key"), F.col("model").alias("__path"))
            found = load(f"{self.decoded}/*").withColumn("__key", F.regexp_extract("__file", "key=([0-9a-f]+)", 1)).join(names, "__key")
            parts.append(found.withColumn("__file", F.col("__path")).drop("__key", "__path"))
        nothing = self.spark.createDataFrame([], f"{schema}, __file string, __place long")
        return reduce(DataFrame.unionByName, parts) if parts else nothing

    def errors(self) -> DataFrame:
        """(path, error) of the others."""
        return self.known.where("error is not null").select(F.col("model").alias("path"), "error")


def xml_files(spark: SparkSession, path: str) -> XmlFiles:
    """The XML files at ``path``, each parsed once to find its charset and faults; those over the size limit are refused unread."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [(None, f"larger than {MAX_BYTES} bytes") if size > MAX_BYTES else xml_charset(bytes(c)) for c, size in zip(batch["content"], batch["length"], strict=True)]
            yield pd.DataFrame({"model": batch["model"], "charset": [t[0] for t in told], "error": [t[1] for t in told]}, dtype=object)

    files = spark.read.format("binaryFile").load(path)
    content = F.when(F.col("length") <= MAX_BYTES, F.col("content")).otherwise(F.lit(b""))
    known = cut(files.select(F.col("_metadata.file_path").alias("model"), "length", content.alias("content")).mapInPandas(look, "model string, charset string, error string"))
    # The reader follows what a file declares, and fails on bytes that don't; so files that differ are written as they are meant, and the good ones named one by one.
    if known.where("charset is not null or error is not null").isEmpty():
        return XmlFiles(spark, known, [path], None)
    paths: dict[bool, list[str]] = {False: [], True: []}
    for r in known.where("error is null").select("model", F.col("charset").isNotNull().alias("other")).orderBy("model").toLocalIterator():
        paths[r["other"]].append(r["model"])
    return XmlFiles(spark, known, paths[False], decoded_texts(spark, paths[True], known) if paths[True] else None)


def decoded_texts(spark: SparkSession, paths: list[str], known: DataFrame) -> str:
    """A folder with the files' texts, decoded and without their prologs."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [PROLOG.sub("", bytes(c).decode(charset)) for c, charset in zip(batch["content"], batch["charset"], strict=True)]
            yield pd.DataFrame({"key": batch["key"], "text": texts})

    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("model"), "content").join(known.select("model", "charset"), "model")
    folder = f"{shared_dir(spark).rstrip('/')}/texts-{uuid.uuid4().hex}"
    files.select(F.sha2("model", 256).alias("key"), "content", "charset").mapInPandas(decode, "key string, text string").repartition("key").write.partitionBy("key").text(folder)
    return folder


def xml_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the XML files that can't be read."""
    return xml_files(spark, path).errors()


def oversized(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the files over the size limit; no content is read."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > MAX_BYTES)
    return files.select(F.col("_metadata.file_path").alias("path"), F.lit(f"larger than {MAX_BYTES} bytes").alias("error"))
