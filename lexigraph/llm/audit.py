"""What filters remove in every order that they can be applied in.

A document is five bits, one a filter that it fails. For each of the 32 sets of bits and 120 orders a table made beforehand
says at which step the document goes. Tasks look their documents up and count (part, order, step) cells by label; the
counts are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.llm.common import salted_join, stored, table
from lexigraph.llm.substrings import text_chunks

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: At which step, from 0, a document with these bits is removed; STEPS if it passes all.
FIRST = np.array([[next((s for s, f in enumerate(order) if bits >> FILTERS.index(f) & 1), STEPS) for order in ORDERS] for bits in range(1 << STEPS)], dtype=np.int64)
#: Characters that filter D looks for.
MARKS = b"#$%&*|"
#: Limits of filters A, B and C.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
#: Parts whose counts a task holds at once.
HELD = 64


def text_facts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, bits, key) of each document: bits A to D that it fails, and a 128-bit hash of its text."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, keys = [np.zeros(0, dtype=np.int64)], []
            for first, last, data, at in text_chunks(batch.column("text")):
                sums = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[at])
                capitals, points, marked = sums((data >= 65) & (data <= 90)), sums((data & 0xC0) != 0x80), sums(np.isin(data, np.frombuffer(MARKS, dtype=np.uint8)))
                words, distinct = np.zeros(last - first, dtype=np.int64), np.zeros(last - first, dtype=np.int64)
                for i in range(last - first):
                    raw = data[at[i] : at[i + 1]].tobytes()
                    own = raw.split()
                    words[i], distinct[i] = len(own), len(set(own))
                    keys.append(xxhash.xxh3_128_digest(raw))
                failed = [words < MIN_WORDS, 100 * distinct < MIN_DISTINCT * words, 100 * capitals > MAX_CAPITALS * points, marked > 0]
                bits.append(sum(f.astype(np.int64) << i for i, f in enumerate(failed)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(np.concatenate(bits)), pa.array(keys, pa.binary())], names=["doc_id", "part", "bits", "key"])

    kept = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    return kept.mapInArrow(facts, f"doc_id {dict(docs.dtypes)['doc_id']}, part string, bits long, key binary")


def failed_filters(docs: DataFrame) -> DataFrame:
    """(doc_id, part, bits): all five bits. Of texts that many documents share only the least id is shuffled, and their rows are dealt over tasks."""
    facts = stored(text_facts(docs), "facts")
    first = facts.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return salted_join(facts, first, "key", F.col("doc_id")).select("doc_id", "part", F.when(later, F.col("bits") + 16).otherwise(F.col("bits")).alias("bits"))


CELLS = "part string, cell int, documents long, fails long, only long, removed long, good long, toxic long"


def counted(rows: DataFrame) -> DataFrame:
    """Partial counts by part, order and step of the rows (part, bits, good, toxic); each task sends 600 rows a part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for part, sums in held.items():
                columns = [pa.array([part] * sums.shape[1]), pa.array(np.arange(sums.shape[1], dtype=np.int32)), *[pa.array(x) for x in sums]]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "cell", "documents", "fails", "only", "removed", "good", "toxic"])
            held.clear()

        for batch in batches:
            parts, number = np.unique(batch.column("part").to_numpy(zero_copy_only=False), return_inverse=True)
            bits = batch.column("bits").to_numpy()
            labels = [None, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))]
            for p, part in enumerate(parts):
                own = np.flatnonzero(number == p)
                if part not in held and len(held) >= HELD:
                    yield from out()
                sums = held.setdefault(part, np.zeros((6, len(ORDERS) * STEPS), dtype=np.int64))
                fails = np.array([(bits[own] >> i & 1).sum() for i in range(STEPS)])
                only = np.array([(bits[own] == 1 << i).sum() for i in range(STEPS)])
                letter = np.array([FILTERS.index(f) for order in ORDERS for f in order])
                sums[:3] += np.stack([np.full(sums.shape[1], len(own)), fails[letter], only[letter]])
                for k, label in enumerate(labels):
                    of = own if label is None else own[label[own]]
                    for lo in range(0, len(of), 10_000):
                        step = FIRST[bits[of[lo : lo + 10_000]]]
                        cell = np.arange(len(ORDERS)) * (STEPS + 1) + step
                        sums[3 + k] += np.bincount(cell.ravel(), minlength=len(ORDERS) * (STEPS + 1)).reshape(-1, STEPS + 1)[:, :STEPS].ravel()
        yield from out()

    return rows.mapInArrow(count, CELLS)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part (language), order and step: filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is the empty one, a null language the empty string. A document without an id has no smaller ids and is none, so
    neither it nor a copy of it fails E; rows alike in id and text don't fail it by one another. A document with several labels is good (toxic) if one of them says so.
    A very long text is a chunk of its own. An empty table gives an empty result; extra columns are left out.
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = salted_join(failed_filters(docs).withColumnRenamed("doc_id", "labelled"), said, "labelled", F.rand(7))
    rows = rows.select("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    sums = counted(rows).groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in ("documents", "fails", "only", "removed", "good", "toxic")])
    order, step = F.element_at(F.array(*map(F.lit, ORDERS)), (F.col("cell") / STEPS).cast("int") + 1), (F.col("cell") % STEPS + 1).cast("int")
    cells = sums.withColumns({"filter_order": order, "step": step}).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    gone = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return cells.select(
        "part", "filter_order", "step", (F.col("documents") - gone).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), F.col("only").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, part, (len(w) < {MIN_WORDS})::int + 2 * (100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w))::int
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::int AS bits FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
r AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bs FROM f a, f b, f c, f d, f e
      WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, bs, unnest(range(1, 6)) AS step FROM o),
y AS (SELECT filter_order, step, bs[step] AS bit, coalesce(list_sum(bs[:step - 1]), 0)::BIGINT AS before FROM s),
x AS (SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (bits & (bit + before) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (bits & bit <> 0 AND bits & before = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (bits & bit <> 0 AND bits & before <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (bits = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (bits & bit <> 0 AND bits & before = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (bits & bit <> 0 AND bits & before = 0), 0)::BIGINT AS toxic_lost
      FROM r, y GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x
"""
