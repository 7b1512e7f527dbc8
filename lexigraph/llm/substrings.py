"""Removal of passages that stand earlier in the corpus, by windows of words whose length doubles.

A window of 20 words can only be repeated if the windows of 10 words within it are. So windows of 10 words come first,
and of these only the anchors: in every window of 20 words the one with the least hash, so that equal windows have equal
anchors. Anchors that occur once are done with; the others are extended to windows of twice their length, whose hashes
are made of the hashes of their halves. Windows repeated at that length are in turn extended to twice it, until a length
is reached or no candidates survive. Every exchange is combined before it: of the windows with one hash a chunk of
text sends only the earliest to the others, so that no task gets more than a row a chunk for any window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.llm.common import is_small, salted_join, stored, table

#: Words of an anchor; of the windows that are judged, twice as many.
BASE = 10
LENGTH = 2 * BASE
#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK = 2_000_000
#: Words of more bytes are hashed by xxhash instead of by sums.
LONG_WORD = 256
U = np.uint64
#: Odd base of the sums that hash words, and its inverse modulo 2^64.
ROOT = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(ROOT, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each number."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mixed(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last one, bytes, where each text begins) of consecutive texts of CHUNK bytes together; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        last = max(int(np.searchsorted(at, at[first] + CHUNK, side="right")) - 1, first + 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def hashed_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and the number of its text within the chunk."""
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True  # a text's last word ends where the next text begins
    before, after = np.ones(n + 1, dtype=bool), np.ones(n + 1, dtype=bool)
    before[1:], after[:n] = space, space
    begins = np.flatnonzero(~space & (before[:n] | edge[:n]))
    ends = np.flatnonzero(~before & (after | edge))
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum(BYTES[data] * powers(ROOT, n), out=sums[1:])
    h = mixed((sums[ends] - sums[begins]) * powers(INVERSE, n)[begins] + (ends - begins).astype(U) * U(0xE7037ED1A0B428DB)) if n else np.zeros(0, dtype=U)
    for i in np.flatnonzero(ends - begins > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[begins[i] : ends[i]].tobytes())
    return h, np.searchsorted(at, begins, side="right") - 1


def joined(left: np.ndarray, right: np.ndarray, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of windows from those of their halves."""
    return mixed(left * U(odd) + right)


def base_windows(h: np.ndarray) -> np.ndarray:
    """Hashes of all windows of BASE = 8 + 2 words."""
    two = joined(h[:-1], h[1:])
    four = joined(two[:-2], two[2:])
    eight = joined(four[:-4], four[4:])
    return joined(eight[:-2], two[8:], 0xD6E8FEB86659FD93)


def anchored(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of BASE words; the first words of all windows of LENGTH words within a text, and of their anchors."""
    if len(h) < LENGTH:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    small = base_windows(h)
    mask = U((1 << max(20, len(h).bit_length())) - 1)
    least = (small & ~mask) | np.arange(len(small), dtype=U)  # ties go to the leftmost, in all equal windows alike
    size = 1
    while size < BASE + 1:  # minimum over BASE + 1 neighbours
        step = min(size, BASE + 1 - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    starts = np.flatnonzero(doc[: len(h) - LENGTH + 1] == doc[LENGTH - 1 :])
    return small, starts, (least[starts] & mask).astype(np.int64)


def earliest(key: np.ndarray, second: np.ndarray, doc: np.ndarray, null: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by (key, second), document and position; in it, which rows are the earliest of their key, and how many rows the key has."""
    order = np.lexsort((pos, doc, null, second, key))
    k, s, d, z, p = key[order], second[order], doc[order], null[order], pos[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group]
    first = (d == d[head]) & (z == z[head]) & (p == p[head])
    return order, first, np.bincount(group)[group] if len(k) else group


WINDOWS = pa.schema([("key", pa.int64()), ("second", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("late", pa.bool_()), ("many", pa.bool_())])
WINDOW_ROWS = "key long, second long, doc long, row long, pos int, late boolean, many boolean"


def sent(key: np.ndarray, second: np.ndarray, doc: pa.Array, row: np.ndarray, at: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Windows (of the texts numbered ``at``) as rows: the earliest of a key go to it, the others, which are late, anywhere."""
    null, ids = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
    order, first, many = earliest(key, second, ids[at], null[at], pos)
    at, pos, key, second = at[order], pos[order], key[order], second[order]
    spread = mixed(key + mixed(row[at].view(U) + pos.astype(U)))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.where(first, key, spread).view(np.int64)), pa.array(second.view(np.int64)), doc.take(pa.array(at)), pa.array(row[at]), pa.array(pos.astype(np.int32)), pa.array(~first), pa.array(many > 1)], schema=WINDOWS)


def identified(docs: DataFrame) -> DataFrame:
    """(doc, row, text): the id, null for one that is no number, and a hash of id and text, which tells rows of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")


def same_row(a: str, b: str) -> Column:
    return (F.col(f"{a}.row") == F.col(f"{b}.row")) & F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc"))


def with_text(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of a stored table (doc, row, starts), with their texts. If the table is small, only these texts are shuffled."""
    if is_small(found):
        docs = docs.alias("d").join(F.broadcast(found.select("doc", "row").alias("f")), same_row("d", "f"), "left_semi")
    return docs.alias("d").join(found.alias("f"), same_row("d", "f")).select("d.doc", "d.row", "d.text", "f.starts")


def copies(docs: DataFrame) -> DataFrame:
    """(doc, row) of the documents whose whole text stands under a smaller id, nulls being the largest. Of hot texts only their least ids are shuffled."""
    ids = docs.where("text is not null").select("doc", "row", F.md5("text").alias("key"))
    order = F.struct(F.col("doc").isNull().alias("null"), F.coalesce("doc", F.lit(0)).alias("doc"))
    groups = ids.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return salted_join(ids.withColumn("own", order), groups, "key", F.col("row")).where("own > first").select("doc", "row").distinct()


def anchors(docs: DataFrame) -> DataFrame:
    """The anchors of all texts as windows of BASE words, combined by chunk."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for first, last, data, at in text_chunks(batch.column("text")):
                h, doc = hashed_words(data, at)
                small, _, chosen = anchored(h, doc)
                mark = np.zeros(len(small), dtype=bool)
                mark[chosen] = True
                where = np.flatnonzero(mark)
                if len(where):
                    begin = np.searchsorted(doc, np.arange(last - first))
                    yield sent(small[where], np.zeros(len(where), dtype=U), batch.column("doc").slice(first, last - first), rows[first:last], doc[where], where - begin[doc[where]])

    return docs.mapInArrow(found, WINDOW_ROWS)


def extended(texts: DataFrame) -> DataFrame:
    """The windows of LENGTH words of texts (doc, row, text, starts) whose anchor is one of ``starts``, combined by chunk."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts = batch.column("row").to_numpy(), batch.column("starts")
            for first, last, data, at in text_chunks(batch.column("text")):
                h, doc = hashed_words(data, at)
                small, where, chosen = anchored(h, doc)
                begin = np.searchsorted(doc, np.arange(last - first))
                own = starts.slice(first, last - first)
                repeated = np.zeros(len(small) + 1, dtype=bool)
                repeated[own.flatten().to_numpy() + np.repeat(begin, own.value_lengths().to_numpy())] = True
                where = where[repeated[chosen]]
                for lo in range(0, len(where), 500_000):
                    part = where[lo : lo + 500_000]
                    left, right = small[part], small[part + BASE]
                    yield sent(joined(left, right), joined(right, left, 0xD1342543DE82EF95), batch.column("doc").slice(first, last - first), rows[first:last], doc[part], part - begin[doc[part]])

    return texts.mapInArrow(found, WINDOW_ROWS)


def by_document(windows: DataFrame) -> DataFrame:
    """(doc, row, starts): where the windows of each document begin."""
    return windows.groupBy("doc", "row").agg(F.collect_list("pos").alias("starts"))


def earlier(windows: DataFrame) -> DataFrame:
    """``windows`` with whether an equal one starts in a smaller document (nulls last) or earlier in the same, and whether there is an equal one at all."""
    same = Window.partitionBy("key", "second")
    turn = F.rank().over(same.orderBy(F.col("doc").asc_nulls_last(), "pos"))
    return windows.withColumns({"turn": turn, "n": F.count("*").over(same)}).select(
        "*", (F.col("late") | (F.col("turn") > 1)).alias("removed"), (F.col("many") | (F.col("n") > 1)).alias("repeated"))


def candidates(docs: DataFrame, whole: DataFrame) -> DataFrame:
    """The texts (doc, row, text, starts) with anchors that occur more than once, without the copies ``whole``, a stored table."""
    own = docs.alias("d").join(F.broadcast(whole.alias("f")), same_row("d", "f"), "left_anti") if is_small(whole) else docs
    repeated = by_document(anchors(own).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("many or n > 1"))
    return with_text(docs, stored(repeated.alias("d").join(whole.alias("f"), same_row("d", "f"), "left_anti"), "anchors"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, n_removed) of every row of ``docs``, without the words of windows of LENGTH words that start
    earlier: in a document with a smaller id, or before in the same one.

    Words are split at ASCII white space and joined again by single spaces. Windows are judged on the texts as they came.
    Texts that are null or have no word give an empty text. Null ids are taken as one document larger than all others. Rows alike in
    id and text get the same result, as neither starts earlier; rows of one id with different texts are one document, whose
    windows are ordered by where they begin. A very long text is hashed as one chunk, its windows being rows of their own.
    An empty table gives an empty result; extra columns are left out.
    """
    rows, none = identified(docs), F.array().cast("array<int>")
    whole = stored(copies(rows), "copies")
    late = by_document(earlier(extended(candidates(rows, whole))).where("removed"))
    marked = stored(late.withColumn("copy", F.lit(False)).unionByName(whole.select("doc", "row", none.alias("starts"), F.lit(True).alias("copy"))), "late_windows")
    if is_small(marked):  # only the texts that lose words, but not all, are shuffled
        known = rows.alias("d").join(F.broadcast(marked.select("doc", "row", "copy").alias("f")), same_row("d", "f"), "left").select("d.*", "f.copy")
        partly = known.where("not copy").alias("d").join(marked.alias("f"), same_row("d", "f")).select("d.doc", "d.text", "f.starts", "f.copy")
        ready = known.where("copy is null or copy").select("doc", "text", none.alias("starts"), F.coalesce("copy", F.lit(False)).alias("copy")).union(partly)
    else:
        ready = rows.alias("d").join(marked.alias("f"), same_row("d", "f"), "left").select("d.doc", "d.text", F.coalesce("f.starts", none).alias("starts"), F.coalesce("f.copy", F.lit(False)).alias("copy"))
    return ready.mapInArrow(without_windows, "doc_id long, text string, n_words long, n_removed long")


def without_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their late windows; of a copy all windows are late."""
    for batch in batches:
        texts, words_in, gone = [], [], []
        for text, starts, copy in zip(batch.column("text"), batch.column("starts"), batch.column("copy"), strict=True):
            words = (text.as_py() or "").encode().split()
            covered = np.zeros(len(words) + 1, dtype=np.int64)
            if copy.as_py() and len(words) >= LENGTH:
                covered[0] = 1
            else:
                at = starts.values.to_numpy()
                np.add.at(covered, at, 1)
                np.add.at(covered, at + LENGTH, -1)
            keep = np.cumsum(covered)[:-1] == 0
            n = int(keep.sum())
            texts.append(b" ".join(words if n == len(words) else [words[i] for i in np.flatnonzero(keep)]).decode())
            words_in.append(len(words))
            gone.append(len(words) - n)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string()), pa.array(words_in, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])


def longest_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, longest) of the documents with a repeated window: the greatest of the lengths 20, 40, 80, ... at which one
    of its windows stands elsewhere too, in this document or another. Whole copies of a document with a smaller id aren't
    listed, nor do they count as elsewhere. A window is extended if the one behind it is repeated as well, and no text is read for that: its hash is that of
    its halves. Each level is stored; the search ends when no candidates survive."""

    def doubled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, length = batch.column("row").to_numpy(), batch.column("length").to_numpy()
            for i, found in enumerate(batch.column("windows")):
                pos, h = (found.values.field(c).to_numpy() for c in ("pos", "second"))
                order = np.argsort(pos)
                pos, h = pos[order].astype(np.int64), h[order].view(U)
                behind = np.minimum(np.searchsorted(pos, pos + length[i]), len(pos) - 1)
                ok = np.flatnonzero(pos[behind] == pos + length[i])
                if len(ok):
                    left, right = h[ok], h[behind[ok]]
                    yield sent(joined(left, right), joined(right, left, 0xD1342543DE82EF95), batch.column("doc").slice(i, 1), rows[i : i + 1], np.zeros(len(ok), dtype=np.int64), pos[ok])

    def survivors(windows: DataFrame, length: int) -> DataFrame:
        found = earlier(windows).where("repeated").groupBy("doc", "row").agg(F.collect_list(F.struct("pos", "second")).alias("windows"))
        return stored(found.withColumn("length", F.lit(length).cast("long")), "repeats")

    rows = identified(docs)
    levels, length = [], LENGTH
    level = survivors(extended(candidates(rows, stored(copies(rows), "copies"))), length)
    while level.limit(1).count():
        levels.append(level.select("doc", "row", "length"))
        length *= 2
        level = survivors(level.mapInArrow(doubled, WINDOW_ROWS), length)
    reached = reduce(DataFrame.union, levels, level.select("doc", "row", "length"))
    return reached.groupBy("doc", "row").agg(F.max("length").alias("longest")).select(F.col("doc").alias("doc_id"), "longest")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
s AS (SELECT r, doc_id, w, unnest(range(1, len(w) - {LENGTH} + 2)) AS p FROM d WHERE len(w) >= {LENGTH}),
h AS (SELECT r, p, rank() OVER (PARTITION BY array_to_string(w[p:p + {LENGTH} - 1], ' ') ORDER BY doc_id NULLS LAST, p) AS turn FROM s),
c AS (SELECT DISTINCT r, unnest(range(p, p + {LENGTH})) AS i FROM h WHERE turn > 1),
x AS (SELECT r, list(i) AS gone FROM c GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""
