"""Near-duplicates by probability minwise hashing, banding and verification.

A text is the set of its five-word shingles, all of weight 1, as links are defined on sets. Each shingle sends arrivals of a Poisson process with its
weight as rate, each to one register; a register keeps the earliest arrival, and a shingle stops once it is later than
all registers. The chance that two texts agree in a register is the probability Jaccard similarity of their weighted
sets; with equal weights it is the Jaccard similarity. Registers are banded; texts that share a band are candidates; candidate classes are verified on the shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.common import salted_join, stored, table
from lexigraph.llm.components import connected_components

WORDS = re.compile(r"\w+")
SHINGLE = 5
#: Rows a band and bands: a pair with similarity 0.8 shares no band with a chance of 0.0002.
ROWS, BANDS = 7, 36
REGISTERS = ROWS * BANDS
#: Largest bucket whose texts are compared by their bits; a larger one is taken whole as one candidate class.
BUCKET = 2048
#: Texts in a block of verification; a larger candidate class is verified by pairs of blocks.
BLOCK = 256
CACHE = 100_000
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each number."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of a text with a word at least, and their counts; a text of fewer words is one shingle."""
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=U, count=len(words))
    n = max(len(h) - SHINGLE + 1, 1)
    out = np.zeros(n, dtype=U)
    for k in range(min(SHINGLE, len(h))):
        out = out * U(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mixed(out), return_counts=True)


def prob_min_hash(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Registers of each weighted set (hashes, weights), sets by REGISTERS."""
    size = np.fromiter((len(s) for s, _ in sets), dtype=np.int64, count=len(sets))
    item, weight, owner = np.concatenate([s for s, _ in sets]), np.concatenate([w for _, w in sets]), np.repeat(np.arange(len(sets)), size)
    earliest = np.full(len(sets) * REGISTERS, np.inf)
    kept = np.zeros(len(sets) * REGISTERS, dtype=U)
    at, turn = np.zeros(len(item)), 0
    while len(item):
        many = int(np.clip(8192 // len(item), 1, 64))  # arrivals of a shingle in this round
        draws = item[:, None] + (np.arange(turn, turn + many, dtype=U) * U(2) + U(1))[None, :] * U(0xD1342543DE82EF95)
        turn += many
        gap = mixed(draws)
        times = at[:, None] + np.cumsum(-np.log(((gap >> U(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / weight[:, None]
        where = (owner[:, None] * REGISTERS + (mixed(gap ^ U(0xA0761D6478BD642F)) % U(REGISTERS)).astype(np.int64)).ravel()
        flat = times.ravel()
        np.minimum.at(earliest, where, flat)
        won = flat == earliest[where]
        kept[where[won]] = np.repeat(item, many)[won]
        at = times[:, -1]
        more = at < earliest.reshape(len(sets), REGISTERS).max(axis=1)[owner]
        item, weight, owner, at = item[more], weight[more], owner[more], at[more]
    return kept.reshape(len(sets), REGISTERS)


def text_features(docs: DataFrame) -> DataFrame:
    """(doc_id, row, id, bands, bits_a, bits_b, shingles) of each document, by whole texts.

    row is a hash of the text as it stands. id is a 64-bit hash of the words in order, null for a text without words; at 1e10 distinct texts about three
    pairs share one. The features come with the first document of an id in a task and are null on its other ones.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        seen: set[int] = set()
        for batch in batches:
            rows: list[list] = []
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            places: list[int] = []

            def sign() -> None:
                if not waiting:
                    return
                kept = prob_min_hash([(s, np.ones(len(s))) for s, _ in waiting])
                bands = np.zeros((len(waiting), BANDS), dtype=U)
                for k in range(ROWS):
                    bands = bands * U(0x9E3779B97F4A7C15) + kept[:, k::ROWS]
                bands = mixed(bands + np.arange(1, BANDS + 1, dtype=U)[None, :] * U(0xE7037ED1A0B428DB)).view(np.int64)
                bits = np.packbits(((kept[:, :128] >> U(20)) & U(1)).astype(np.uint8), axis=1).view(np.int64)
                for i, (own, _) in enumerate(waiting):
                    rows[places[i]][3:] = bands[i], bits[i, 0], bits[i, 1], np.sort((own >> U(32)).astype(np.uint32)).tobytes()
                waiting.clear()
                places.clear()

            size = 0
            for doc, row, text in zip(batch["doc_id"], batch["row"], batch["text"], strict=True):
                words = WORDS.findall(text.lower()) if isinstance(text, str) else []
                if not words:
                    rows.append([doc, row, None, None, None, None, None])
                    continue
                key = xxhash.xxh3_64_intdigest(" ".join(words)) - 2**63
                rows.append([doc, row, key, None, None, None, None])
                if key in seen:
                    continue
                seen.add(key)
                if len(known) > CACHE:
                    known.clear()
                waiting.append(shingles(words, known))
                places.append(len(rows) - 1)
                size += len(waiting[-1][0]) + REGISTERS
                if size > 100_000:
                    sign()
                    size = 0
                if len(rows) >= 1000:
                    sign()
                    size = 0
                    yield framed(rows)
                    rows.clear()
            sign()
            if rows:
                yield framed(rows)
            if len(seen) > CACHE:
                seen.clear()

    def framed(rows: list[list]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "row", "id", "bands", "bits_a", "bits_b", "shingles"])
        return out.astype({c: "Int64" for c in ("doc_id", "row", "id", "bits_a", "bits_b")})

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").mapInPandas(features, "doc_id long, row long, id long, bands array<long>, bits_a long, bits_b long, shingles binary")


def in_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive groups of a partition sorted by ``keys``, across its batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), dtype=bool)
        for k in keys:
            v = batch[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = batch.iloc[i:j]
            if i == 0 and held and all(held[-1][k].iloc[-1] == part[k].iloc[0] for k in keys):
                held.append(part)
                continue
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held = [part]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def linked(ids: np.ndarray, near: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """(id, root) for the members of the components of more than one, where near(i) tells the neighbours of the i-th."""
    left, out = np.ones(len(ids), dtype=bool), []
    for first in range(len(ids)):
        if not left[first]:
            continue
        left[first] = False
        todo, members = [first], [first]
        while todo and left.any():
            new = np.flatnonzero(near(todo.pop()) & left)
            left[new] = False
            todo += new.tolist()
            members += new.tolist()
        if len(members) > 1:
            root = ids[members].min()
            out += [(int(i), int(root)) for i in ids[members] if i != root]
    return out


def candidate_links(texts: DataFrame) -> DataFrame:
    """(a, b) links whose components hold every pair that shares a band and isn't plainly apart by its bits.

    Buckets of one text are dropped by a join with the counts. Texts of a bucket are compared by 128 bits of their
    registers; a pair of similarity 0.8 agrees in 115 bits on average and is passed over below 96, over five standard
    deviations off. A bucket of more than BUCKET texts is linked whole, by the engine.
    """
    rows = texts.select("id", "bits_a", "bits_b", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1")
    met = rows.join(shared, "bucket")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links: list[tuple[int, int]] = []
        for group in in_groups(batches, ["bucket"]):
            ids = group["id"].to_numpy()
            bits = group[["bits_a", "bits_b"]].to_numpy().view(U)
            links += linked(ids, lambda i, bits=bits: np.bitwise_count(bits ^ bits[i]).sum(axis=1) <= 32)
            if len(links) > 50_000:
                yield pd.DataFrame(links, columns=["a", "b"])
                links = []
        yield pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    small = met.where(F.col("n") <= BUCKET).select("bucket", "id", "bits_a", "bits_b").repartition("bucket").sortWithinPartitions("bucket")
    whole = met.where(F.col("n") > BUCKET).select(F.col("id").alias("a"), F.col("low").alias("b"))
    return small.mapInPandas(compare, "a long, b long").union(whole).where("a <> b").distinct()


def verified_links(texts: DataFrame, classes: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b, n): links that join exactly the texts of each candidate class that chains of pairs with a Jaccard similarity of
    ``percent`` join, with n 0, and rows with a = b whose n add up to the number of texts of the class that are so similar
    to a. ``classes``: (id, root). Each task compares two blocks of BLOCK texts at a time."""
    size = classes.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = salted_join(classes, size, "root", F.col("id")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = (
        texts.select("id", "shingles")
        .join(blocks, "id")
        .select("id", "shingles", "root", "block", other)
        .select("id", "shingles", "root", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block")
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in in_groups(batches, ["root", "p", "q"]):
            ids, sets = group["id"].to_numpy(), [np.frombuffer(x, dtype=np.uint32) for x in group["shingles"]]
            common = intersections(sets)
            n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            close = 100 * common >= percent * (n[:, None] + n[None, :] - common)
            side = group["block"].to_numpy()
            counted = close & (side[:, None] != side[None, :]) if group["p"].iloc[0] < group["q"].iloc[0] else close & ~np.eye(len(ids), dtype=bool)
            degrees = counted.sum(axis=1)
            rows = [(a, b, 0) for a, b in linked(ids, lambda i, close=close: close[i])] + [(int(i), int(i), int(d)) for i, d in zip(ids, degrees, strict=True) if d]
            if rows:
                yield pd.DataFrame(rows, columns=["a", "b", "n"])

    return dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInPandas(verify, "a long, b long, n long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets (sorted, distinct numbers, or nearly so)."""
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.diag([len(s) for s in sets]).astype(np.float64)
    shared = times > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[place]
    owner, column = owner[column >= 0], column[column >= 0]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(column, [start, start + 4096])
        held = np.zeros((len(sets), 4096), dtype=np.float32)
        held[owner[i:j], column[i:j] - start] = 1
        both += held @ held.T
    np.fill_diagonal(both, 0)
    return (out + both).astype(np.int64)


def classed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, best, links) for every row of ``docs``: best is the (doc_id, row) with the least id in the row's class, null
    for a text without words and for a class without ids; links is the number of other texts that are as similar as asked."""
    found = stored(text_features(docs), "near_features")
    texts = found.where(F.col("bands").isNotNull()).dropDuplicates(["id"])
    classes = connected_components(candidate_links(texts))
    checked = stored(verified_links(texts, stored(classes, "near_candidates")), "near_links")
    roots = connected_components(checked.where("a <> b").select("a", "b").distinct())
    degrees = checked.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    this = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))
    ids = found.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(this).alias("least"))
    ids = ids.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = salted_join(ids.join(degrees, "id", "left"), ids.groupBy("root").agg(F.min("least").alias("best")), "root", F.col("id")).select("id", "best", "links")
    return salted_join(found.select("doc_id", "row", "id"), named, "id", F.col("doc_id")).select("doc_id", "row", "best", F.coalesce("links", F.lit(0)).alias("links"))


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs``: the least id of the document's class of near-duplicates, and how
    many other texts are similar to its own.

    Texts are compared as sets of five-word shingles (lower-case runs of letters, digits and underscores); texts of
    similarity 0.8 or more are linked, and classes are the components of the links. Texts alike in all words are one
    text. A text without words is a class of its own, and so is a null id, whose class is null unless its text has
    other documents. Repeated rows are in one class. Texts of any length are compared whole, other columns aren't read.
    An empty table gives an empty result. A member of a class needn't be similar to the class's least id itself.
    """
    return classed_rows(docs).select("doc_id", F.coalesce("best.doc_id", "doc_id").alias("class_id"), F.col("links").alias("n_links"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with the one row of each class that has the least id. Of rows alike in id and text one stays, of rows that
    share an id but not the class one of each class; rows with a null id stay, and so do texts without words."""
    kept = classed_rows(docs).where(F.coalesce((F.col("best.doc_id") == F.col("doc_id")) & (F.col("best.row") == F.col("row")), F.lit(True)))
    kept = kept.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("row").alias("__row")).distinct()
    keyed = docs.withColumn("__row", F.xxhash64("text"))
    one_each = keyed.join(kept, ["doc_id", "__row"], "left_semi").dropDuplicates(["doc_id", "__row"]).drop("__row")
    return one_each.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
