"""Benchmark decontamination by a distributed positional inverted index.

The training tokens are stored once as postings (term, document, position), however many benchmarks are looked up. A
benchmark window (ten consecutive words) is found from its rarest terms on: the lists of its two rarest terms are
shifted by the terms' offsets in the window and intersected, and the starts that remain are intersected with the lists
of all its other terms. The same postings give proximity matches: all terms of a window near its rarest one.

Tables of a benchmark's size are counted before they are sent to all tasks; larger ones are joined by a shuffle in which
the postings of a frequent term are dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.llm.common import is_small, salted_join, salted_semi, stored, table

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between tokens.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words around a window's rarest word that proximity matches look at, in the query.
SLOP = 20
#: Hashes by which postings are thinned before they are shuffled: what is sent to all tasks for it has as many numbers at most.
THIN = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens_of(text: Column) -> Column:
    """Words in lower case (A-Z only); null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, -1), "")


def token_index(docs: DataFrame) -> DataFrame:
    """Postings of all words of ``docs`` (__doc, text): (__doc, pos, term), stored, one row an occurrence.

    A document's postings lie together, and each task writes those of its own documents, so nothing is shuffled."""
    return stored(docs.select("__doc", F.posexplode(tokens_of(F.col("text"))).alias("pos", "term")), "postings")


def benchmark_windows(items: DataFrame, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """Distinct windows of the items (win, words) and the pairs (win, item) of a window and an item that holds it.

    An item of fewer words is one window; one without words has none. A null item_id counts as no item.
    """
    words = items.select(F.col("item_id").cast("string").alias("item"), tokens_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    held = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words"))
    held = stored(held.select(F.xxhash64(F.array_join("words", " ")).alias("win"), "words", "item").distinct(), "windows")
    return held.select("win", "words").distinct(), held.where(F.col("item").isNotNull()).select("win", "item")


def with_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the stored, distinct ``terms``."""
    if is_small(terms):
        return index.join(F.broadcast(terms), "term", "left_semi")
    return salted_semi(index, terms, ["term"], F.struct("__doc", "pos"))


def ranked_terms(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Each window's places by the number of their terms' postings: win, term, offset, rank (0 for the rarest) and width; stored.

    A window with a term that no document has can't occur and is left out.
    """
    at = windows.select("win", F.size("words").alias("width"), F.posexplode("words").alias("offset", "term"))
    counts = with_terms(index, stored(at.select("term").distinct(), "terms")).groupBy("term").agg(F.count("*").alias("n"))
    one = Window.partitionBy("win")
    ranked = at.join(counts, "term").withColumns({"there": F.count("*").over(one), "rank": F.row_number().over(one.orderBy("n", "offset")) - 1})
    return stored(ranked.where(F.col("there") == F.col("width")).drop("there", "n"), "ranked")


def anchor_postings(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """Postings of the windows' two rarest terms: __doc, win, rank, pos, ``start`` (pos less the term's offset) and width; stored."""
    rare = ranked.where("rank < 2")
    if is_small(ranked):
        found = index.join(F.broadcast(rare), "term")
    else:
        found = salted_join(index, rare, "term", F.struct("__doc", "pos")).where(F.col("win").isNotNull())
    return stored(found.select("__doc", "win", "rank", "pos", (F.col("pos") - F.col("offset")).alias("start"), "width"), "anchors")


def postings_of(index: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings that can meet ``docs`` (with __doc) and ``terms`` (with term).

    Documents are told apart by THIN hashes, so that the set sent to the tasks is bounded; postings that pass by a
    shared hash are dropped by the join that follows."""
    slot = F.pmod(F.xxhash64("__doc", F.lit("thin")), F.lit(THIN))
    slots = docs.select(slot.alias("__slot")).distinct()
    thinned = index.withColumn("__slot", slot).join(F.broadcast(slots), "__slot", "left_semi").drop("__slot")
    return with_terms(thinned, stored(terms.select("term").distinct(), "terms"))


def phrase_matches(index: DataFrame, ranked: DataFrame, anchors: DataFrame) -> DataFrame:
    """(__doc, win, start, width) of the exact matches: starts in the shifted lists of all terms of a window.

    The lists of the two rarest terms are intersected first; of the starts that remain, each other term's place is
    looked up in the index.
    """
    met = anchors.where("start >= 0").groupBy("__doc", "win", "start", "width").agg(F.count_distinct("rank").alias("ranks")).where(F.col("ranks") == F.least("width", F.lit(2))).drop("ranks")
    met = stored(met, "starts")
    wanted = salted_join(met.where("width > 2"), ranked.where("rank >= 2").groupBy("win").agg(F.collect_list(F.struct("term", "offset")).alias("others")), "win", F.xxhash64("__doc", "start"))
    wanted = wanted.select("__doc", "win", "start", "width", F.inline("others")).select("__doc", "win", "start", "width", "term", (F.col("start") + F.col("offset")).alias("pos"))
    there = postings_of(index, met, ranked.where("rank >= 2")).select("__doc", "pos", "term")
    full = wanted.hint("merge").join(there, ["__doc", "pos", "term"]).groupBy("__doc", "win", "start", "width").agg(F.count_distinct("pos").alias("n"))
    return full.where(F.col("n") == F.col("width") - 2).drop("n").union(met.where("width <= 2"))


def proximity_matches(index: DataFrame, ranked: DataFrame, anchors: DataFrame, slop: int) -> DataFrame:
    """(__doc, win) of the proximity matches: occurrences of a window's rarest word with all its other words within
    ``slop`` words of it, in any order.

    Places are compared by stretches of ``slop`` + 1 words, of which three can hold what is near.
    """
    near = Window.partitionBy("__doc", "win").orderBy("pos").rangeBetween(-slop, slop)
    both = anchors.withColumn("second", F.max("rank").over(near)).where("rank = 0 and second = least(width, 2) - 1").select("__doc", "win", "pos").distinct()
    both = stored(both, "near")
    others = ranked.where("rank >= 2").groupBy("win").agg(F.collect_set("term").alias("terms"))
    span = slop + 1
    wanted = salted_join(both, others, "win", F.xxhash64("__doc", "pos"))
    asked = wanted.where(F.col("terms").isNotNull()).select("__doc", "win", "pos", F.size("terms").alias("all"), F.explode("terms").alias("term"))
    asked = asked.withColumn("stretch", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: d + F.floor(F.col("pos") / span))))
    there = postings_of(index, both, ranked.where("rank >= 2")).select("__doc", "term", F.floor(F.col("pos") / span).alias("stretch"), F.col("pos").alias("at"))
    met = asked.hint("merge").join(there, ["__doc", "term", "stretch"]).where(F.abs(F.col("at") - F.col("pos")) <= slop)
    full = met.groupBy("__doc", "win", "pos", "all").agg(F.count_distinct("term").alias("n")).where(F.col("n") == F.col("all"))
    return full.select("__doc", "win").union(wanted.where(F.col("terms").isNull()).select("__doc", "win")).distinct()


def item_lists(matches: DataFrame, held: DataFrame, name: str) -> DataFrame:
    """(__doc, ``name``): the sorted items of each document's windows, from distinct ``matches`` (__doc, win)."""
    return matches.join(held, "win").select("__doc", "item").distinct().groupBy("__doc").agg(F.sort_array(F.collect_list("item")).alias(name))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, slop: int | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, item_ids, items_sha256, contaminated; with ``slop`` also near_items.

    n_hit counts the words inside any occurrence of a window of ``items`` (item_id, text); item_ids are the items with
    occurring windows, as sorted strings, and items_sha256 the digest of them joined by commas. near_items are items
    with a window whose rarest word has all the window's other words within ``slop`` words of it. A null or empty text
    has no words; an empty benchmark hits nothing; empty ``docs`` give an empty result. Texts of any length are indexed
    whole. Rows alike in id and text get the same result. Columns named like the new ones are replaced, others are kept.
    """
    new = ["n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated", "near_items"]
    keyed = docs.drop(*new).withColumn("__doc", F.xxhash64("doc_id", "text"))
    index = token_index(keyed.select("__doc", "text"))
    windows, held = benchmark_windows(items, width)
    ranked = ranked_terms(windows, index)
    anchors = anchor_postings(index, ranked)
    phrases = stored(phrase_matches(index, ranked, anchors), "phrases")
    grown = lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(x["end"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n"))
    hits = (
        phrases.groupBy("__doc")
        .agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("width")).alias("end")))).alias("spans"))
        .select("__doc", F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), grown)["n"].alias("__hit"))
    )
    sizes = index.groupBy("__doc").agg((F.max("pos") + 1).alias("__size"))
    facts = sizes.join(hits, "__doc", "left").join(item_lists(phrases.select("__doc", "win").distinct(), held, "__ids"), "__doc", "left")
    if slop is not None:
        facts = facts.join(item_lists(proximity_matches(index, ranked, anchors, slop), held, "__near"), "__doc", "left")
    none = F.array().cast("array<string>")
    out = (
        keyed.join(facts, "__doc", "left")
        .withColumn("n_words", F.coalesce("__size", F.lit(0)).cast("long"))
        .withColumn("n_hit", F.coalesce("__hit", F.lit(0)).cast("long"))
        .withColumn("item_ids", F.coalesce("__ids", none))
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )
    if slop is not None:
        out = out.withColumn("near_items", F.coalesce("__near", none))
    return out.drop("__doc", "__size", "__hit", "__ids", "__near")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.size("near_items").cast("long").alias("n_near"))


OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TOKEN}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TOKEN}') AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS win, list_slice(w, i, i + 9) AS ws
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
m AS (SELECT DISTINCT g.r, g.i, g.n, v.item FROM g JOIN v ON g.win = v.win AND g.n = v.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
k AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM m GROUP BY r),
p AS (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
c AS (SELECT term, count(*) AS n FROM p GROUP BY term),
a AS (SELECT win, term, row_number() OVER (PARTITION BY win ORDER BY n, o) AS rank
      FROM (SELECT win, unnest(ws) AS term, unnest(range(len(ws))) AS o FROM (SELECT DISTINCT win, ws FROM v)) JOIN c USING (term)),
q AS (SELECT p.r, a.win, p.pos FROM p JOIN a USING (term) WHERE rank = 1),
s AS (SELECT win, count(DISTINCT term) AS terms FROM (SELECT win, unnest(ws) AS term FROM v) GROUP BY win),
y AS (SELECT q.r, q.win, q.pos, count(DISTINCT p.term) AS terms
      FROM q JOIN (SELECT DISTINCT win, term FROM a) u USING (win) JOIN p ON p.r = q.r AND p.term = u.term AND p.pos BETWEEN q.pos - {SLOP} AND q.pos + {SLOP} GROUP BY ALL),
z AS (SELECT y.r, count(DISTINCT v.item) AS n_near FROM (SELECT DISTINCT r, win FROM y JOIN s USING (win) WHERE y.terms = s.terms) y JOIN v USING (win) GROUP BY y.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r) LEFT JOIN z USING (r)
"""
