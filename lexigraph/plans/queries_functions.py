"""Queries on the column functions, over the driver's text and number columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.functions import terms as T
from lexigraph.plans.registry import query
from lexigraph.plans.tpch import read

# SQL fragments for the same functions.
SAN = r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^[^\p{{L}}\p{{Nd}}_:]+', ''), '[^\p{{L}}\p{{Nd}}_\-.:·\x{{300}}-\x{{36F}}\x{{203F}}-\x{{2040}}]', '-', 'g'), '-+', '-', 'g'), '-+$', ''), ''), 'unnamed')"
LAST = "coalesce(nullif(regexp_extract({0}, '([^/#]*)$', 1), ''), {0})"


def part(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("x"))


NAME = "'  ' || p_name || ' @ ' || p_brand || '!!'"


def name_text() -> Column:
    return F.concat(F.lit("  "), "p_name", F.lit(" @ "), "p_brand", F.lit("!!"))


@query(f"SELECT p_partkey, {SAN.format('x')} AS y FROM (SELECT p_partkey, {NAME} AS x FROM part)")
def fn_sanitize_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part(spark, sf_dir, name_text()).select("p_partkey", T.sanitize_iri(F.col("x")).alias("y"))


@query(f"SELECT page_id, {SAN.format('url')} AS y FROM pages")
def fn_sanitize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.sanitize_iri(F.col("url")).alias("y"))


@query(f"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'https://a.example/pojem/' || p_partkey WHEN 1 THEN 'https://v.example/slovník/pojem/b ' ELSE 'https://v.example/slovník/pojem/' || {SAN.format('p_name')} END AS iri
  FROM part WHERE p_size % 3 <> 1 UNION ALL SELECT p_partkey, 'https://v.example/slovník/pojem/' || p_partkey FROM part WHERE p_size % 3 = 1""")
def fn_concept_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey").cast("string"), F.col("p_size") % 3
    ident = F.when(n == 0, F.concat(F.lit("https://a.example/pojem/"), k)).when(n == 1, F.concat(F.lit("https://b.example/c#"), k))
    iri = T.concept_iri(F.lit("https://v.example//"), F.lit("Slovník"), F.col("p_name"), ident)
    return read(spark, sf_dir, "part").select("p_partkey", iri.alias("iri"))


@query("SELECT p_partkey, 'https://slovník.gov.cz/shacl/lokální/' || lower(regexp_replace(x, '([a-z])([A-Z])', '\\1-\\2', 'g')) AS y FROM (SELECT p_partkey, 'partName' || p_brand AS x FROM part)")
def fn_rule_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part(spark, sf_dir, F.concat(F.lit("partName"), "p_brand")).select("p_partkey", T.rule_iri(F.col("x")).alias("y"))


URL_OK = "regexp_full_match(url, '[a-zA-Z][a-zA-Z0-9+.-]*://[A-Za-z0-9.-]+([/?#:].*)?')"


@query(f"SELECT page_id, {URL_OK} AS uri, false AS bare, regexp_full_match(url, '[a-zA-Z][a-zA-Z0-9+.-]*:.*') AS iri FROM pages")
def fn_uri_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/]+)", 1)
    return read(spark, sf_dir, "pages").select("page_id", T.is_uri(F.col("url")).alias("uri"), T.is_uri(host).alias("bare"), T.is_iri(F.col("url")).alias("iri"))


@query(f"SELECT page_id, {LAST.format('url')} AS y FROM pages")
def fn_local_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.local_name(F.col("url")).alias("y"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(url, '[/#]$') THEN url ELSE url || '/' END AS y, '{N.DEFAULT_NS}' AS fallback FROM pages")
def fn_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.with_delimiter(F.col("url")).alias("y"), T.effective_namespace(F.lit("https://slovník.gov.cz/x")).alias("fallback"))


WORDS = ["ano", " Ne ", "YES", "no", "TRUE", "false", "maybe", "1"]


@query("SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false END AS flag, p_size % 8 < 6 AS word, p_size % 8 IN (0, 2, 3, 4, 5) AS plain FROM part")
def fn_boolean_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.get(F.array(*map(F.lit, WORDS)), (F.col("p_size") % 8).cast("int"))
    return part(spark, sf_dir, x).select("p_partkey", T.boolean_word(F.col("x")).alias("flag"), T.is_boolean_word(F.col("x")).alias("word"), T.is_boolean_word(F.col("x"), trimmed=False).alias("plain"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN p_brand END AS y FROM part")
def fn_provision_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 5
    x = F.when(n == 0, " ").when(n == 1, "N/A").when(n == 2, "není").when(n == 4, F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    return part(spark, sf_dir, x).select("p_partkey", T.provision(F.col("x")).alias("y"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN '{N.RPP}agenda/A' || c_custkey END AS agenda, CASE WHEN c_custkey % 4 IN (0, 3) THEN '{N.RPP}isvs/' || c_custkey END AS ais FROM customer")
def fn_agenda_ais_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    a = F.when(n == 0, k).when(n == 1, F.concat(F.lit("A"), k)).when(n == 2, F.concat(F.lit("https://x.example/agenda/A"), k)).otherwise(F.concat(F.lit("B"), k))
    i = F.when(n == 0, k).when(n == 1, F.concat(F.lit("A"), k)).when(n == 3, F.concat(F.lit("https://x.example/isvs/"), k)).otherwise("isvs")
    return read(spark, sf_dir, "customer").select("c_custkey", T.agenda_iri(a).alias("agenda"), T.ais_iri(i).alias("ais"))


@query(f"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '{N.ELI_BASE}eli/cz/sb/' || p_partkey WHEN 1 THEN '{N.ELI_BASE}eli/cz/' || p_brand END AS y FROM part")
def fn_eli(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey").cast("string"), F.col("p_size") % 3
    x = F.when(n == 0, F.concat(F.lit("https://x.example/eli/cz/sb/"), k)).when(n == 1, F.concat(F.lit("c:\\eli\\cz\\"), "p_brand")).otherwise("https://x.example/eli/de/1")
    return part(spark, sf_dir, x).select("p_partkey", T.eli_iri(F.col("x")).alias("y"))


@query("SELECT p_partkey, p_brand || '<b> & \"x\"' AS y FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 2 = 1")
def fn_tag_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" &#xA;"), "p_brand", F.lit("&lt;b&gt; &amp; &quot;x&quot; #NOTES# more"))).otherwise("  #NOTES#x")
    return part(spark, sf_dir, x).select("p_partkey", T.clean_tag(F.col("x")).alias("y"))


LITERALS = ["ano", "https://a.example/x", "2024-05-01T10:00:00Z", "1.5.2024", "14:30", "2024-05-01T10:00:00", "-12", "3.25", "text", "31.13.2024"]
KINDS = ["xsd:boolean", "xsd:anyURI", "xsd:dateTimeStamp", "xsd:date", "xsd:time", "xsd:dateTime", "xsd:integer", "xsd:double"]
BY_NAME = ["datumNarozeni", "časDatum", "departureTime", "webUrl", "isActive", "itemCount", "popis", "název"]
NAME_KINDS = ["xsd:date", "xsd:dateTimeStamp", "xsd:time", "xsd:anyURI", "xsd:boolean", "xsd:integer", "xsd:boolean", "xsd:string"]


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'rdf:langString' ELSE CASE p_size % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " ELSE CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(NAME_KINDS)) + " END END END AS kind FROM part")
def fn_typed_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("p_size") % len(xs)).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", T.literal_type(pick(LITERALS), pick(BY_NAME), F.when(F.col("p_size") % 3 == 2, "cs")).alias("kind"))


@query("SELECT event_id, event_id % 4 <> 3 AS is_date, event_id % 2 = 0 AS is_time, event_id % 3 <> 2 AS is_datetime FROM events")
def fn_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    d = F.when(n % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(n % 4 == 1, F.date_format("ts", "dd.MM.yyyy")).when(n % 4 == 2, F.date_format("ts", "d.M.yyyy")).otherwise(F.concat(F.date_format("ts", "yyyy"), F.lit("-13-01")))
    t = F.when(n % 2 == 0, F.date_format("ts", "HH:mm:ss")).otherwise(F.concat(F.lit("25:"), F.date_format("ts", "mm:ss")))
    dt = F.when(n % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(n % 3 == 1, F.date_format("ts", "dd.MM.yyyy HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return read(spark, sf_dir, "events").select("event_id", T.is_date(d).alias("is_date"), T.is_time(t).alias("is_time"), T.is_datetime(dt).alias("is_datetime"))


@query("SELECT p_partkey, p_brand || ';' || p_type AS y, false AS short FROM part")
def fn_source_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit(" "), "p_brand", F.lit(" ;; ab; ---- ;"), "p_type")
    return part(spark, sf_dir, x).select("p_partkey", T.clean_sources(F.col("x")).alias("y"), T.is_plausible_source(F.lit("ab")).alias("short"))


SPELLED_OUT = "text"
for _k, _v in T.SPELLED.items():
    SPELLED_OUT = f"replace({SPELLED_OUT}, '{_k}', '{_v}')" if _k == "ß" else f"replace(replace({SPELLED_OUT}, '{_k}', '{_v}'), '{_k.upper()}', '{_v.capitalize()}')"


@query(f"SELECT doc_id, strip_accents({SPELLED_OUT}) AS y FROM documents")
def fn_transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.transliterate(F.col("text")).alias("y"))


@query("SELECT doc_id, trim(nfc_normalize(coalesce(text, '')), chr(32) || chr(9) || chr(10) || chr(13)) AS y FROM documents")
def fn_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.nfc(F.col("text")).alias("y"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Subjekt práva' WHEN 1 THEN 'Objekt práva' WHEN 2 THEN 'vlastnost' ELSE p_type END AS y FROM part")
def fn_type_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 4
    return part(spark, sf_dir, F.when(n == 0, "typ Subjektu").when(n == 1, " OBJEKT ").when(n == 2, "typVlastnosti").otherwise(F.col("p_type"))).select("p_partkey", T.class_type(F.col("x")).alias("y"))


RANGES = ["Datum", "čas", "xsd:token", N.XSD + "long", "https://a.example/T", "", "cosi"]
RANGE_IRIS = [N.XSD + "date", N.XSD + "time", N.XSD + "token", N.XSD + "long", "https://a.example/T", N.RDFS + "Literal", N.RDFS + "Literal"]


@query("SELECT p_partkey, CASE p_size % 7 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(RANGE_IRIS)) + " END AS iri, CASE p_size % 7 " + " ".join(f"WHEN {i} THEN '{v.replace(N.XSD, 'xsd:')}'" for i, v in enumerate(RANGE_IRIS)) + " END AS short FROM part")
def fn_xsd_abbrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.range_iri(F.get(F.array(*map(F.lit, RANGES)), (F.col("p_size") % 7).cast("int")))
    return part(spark, sf_dir, x).select("p_partkey", F.col("x").alias("iri"), T.abbreviate_range(F.col("x")).alias("short"))


@query("SELECT p_partkey, 'n1' || regexp_replace(p_name || p_brand, '[^a-zA-Z0-9]', '', 'g') AS y, p_size % 2 = 0 AS id FROM part")
def fn_xml_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit("1_"), "p_name", "p_brand")
    i = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("id-"), F.substring(F.md5("p_name"), 1, 8))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", T.xml_name(x).alias("y"), T.looks_like_id(i).alias("id"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)$', 1), ''), 'downloaded-file') AS y, starts_with(url, 'https') AS secure FROM pages")
def fn_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.url_filename(F.col("url")).alias("y"), (F.try_parse_url("url", F.lit("PROTOCOL")) == "https").alias("secure"))


@query("SELECT event_id, (props->>'k')::INT AS k, json_array_length(json_keys(props)::JSON) AS n FROM events")
def fn_json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return read(spark, sf_dir, "events").select("event_id", m["k"].cast("int").alias("k"), F.size(m).cast("long").alias("n"))


@query("SELECT p_partkey, p_size % 3 = 0 AS says_yes, p_size % 3 = 1 AS says_no FROM part")
def fn_publicity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 3
    x = F.lower(F.when(n == 0, "spíše ANO").when(n == 1, "NE").otherwise("?"))
    return part(spark, sf_dir, x).select("p_partkey", F.col("x").contains("ano").alias("says_yes"), (F.col("x").contains("ne") & ~F.col("x").contains("ano")).alias("says_no"))


@query("SELECT p_partkey, string_agg(w, '|' ORDER BY i) AS y FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part) GROUP BY p_partkey")
def fn_split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit(" ;"), F.replace("p_type", F.lit(" "), F.lit(" ; ")), F.lit(";; "))
    return part(spark, sf_dir, x).select("p_partkey", F.array_join(T.split_list(F.col("x")), "|").alias("y"))


@query("SELECT user_id, coalesce(max(CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END), max(CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d') END)) AS instant FROM events GROUP BY user_id")
def fn_temporal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject's time: its latest dateTime, else its latest date."""
    stamp = F.max(F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    day = F.max(F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd")))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(stamp, day).alias("instant"))
