"""Graphs compared whatever their blank nodes are called.

Blank nodes get names made of what is said of them, round by round, until no round tells more of them apart. Nodes that are
still alike are told apart one by one: within a set of linked blank nodes one of them is marked and the names are refined
again; sets that are alike as a whole are counted through. Tables of nodes are never sent whole to the tasks: joins on them are merges,
as their size is guessed too low from the packed tables that they come from. For graphs whose alike nodes can be exchanged (as copies and
siblings can) the names are the same for every way of calling the nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.operators.hierarchy import cut

#: Parts that the alike sets are dealt over, so that none is counted through by one task.
PARTS = 64


def _hashed(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]), 256)


def _name(hashes: Column) -> Column:
    return F.concat(F.lit("_:"), F.substring(F.sha2(F.array_join(F.array_sort(hashes), ","), 256), 1, 32))


def _refined(alone: DataFrame, links: DataFrame, names: DataFrame, linked: bool) -> DataFrame:
    """(b, name) after as many rounds as tell more nodes apart. ``alone`` (b, hs): hashes of facts without another blank node;
    ``links`` (s, p, o): facts between two; without any (``linked``) one round tells all."""
    known = names.select("name").distinct().count()
    while True:
        far = lambda c: names.select(F.col("b").alias(c), F.col("name").alias(f"{c}_name")).hint("shuffle_merge")
        told = links.join(far("s"), "s").join(far("o"), "o")
        forth = told.select(F.col("s").alias("b"), _hashed(F.lit(">"), "p", "o_name", F.lit("bnode"), F.lit(""), F.lit("")).alias("h"))
        back = told.select(F.col("o").alias("b"), _hashed(F.lit("<"), "p", "s_name", F.lit("bnode")).alias("h"))
        seen = forth.unionByName(back).groupBy("b").agg(F.collect_list("h").alias("more"))
        none = F.array().cast("array<string>")
        marks = F.when(F.col("mark") != "", F.array("mark")).otherwise(none)
        new = cut(names.select("b", "mark").join(alone.hint("shuffle_merge"), "b", "left").join(seen.hint("shuffle_merge"), "b", "left").select("b", "mark", _name(F.concat(F.coalesce("hs", none), F.coalesce("more", none), marks)).alias("name")))
        if not linked:
            return new
        apart = new.select("name").distinct().count()
        if apart <= known:
            return new
        names, known = new, apart


def _linked_sets(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(b, root): the least name among the blank nodes that a node is linked with, over any number of links."""
    both = cut(links.select(F.col("s").alias("a"), F.col("o").alias("b")).union(links.select("o", "s")).distinct())
    roots = nodes.select("b", F.col("b").alias("root"))
    while True:
        near = both.join(roots.select(F.col("b").alias("a"), "root").hint("shuffle_merge"), "a").groupBy("b").agg(F.min("root").alias("near"))
        up = roots.select(F.col("b").alias("root"), F.col("root").alias("over"))
        lower = roots.join(near.hint("shuffle_merge"), "b", "left").join(up.hint("shuffle_merge"), "root", "left").select("b", "root", F.least("root", "near", "over").alias("low"))
        moved = cut(lower.select("b", F.col("low").alias("root"), (F.col("low") < F.col("root")).alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        roots = moved.drop("moved")


def _counted(sets: DataFrame) -> DataFrame:
    """(root, turn) of sets (root, sign): a number from 1 among the sets of one sign, dealt over parts with the parts' counts added up."""
    dealt = sets.withColumn("part", F.pmod(F.xxhash64("root"), F.lit(PARTS)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sign").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy("sign", "part").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
    own = F.row_number().over(Window.partitionBy("sign", "part").orderBy("root"))
    return dealt.withColumn("own", own).join(counts, ["sign", "part"]).select("root", (F.col("own") + F.col("before")).alias("turn"))


def blank_names(triples: DataFrame) -> DataFrame:
    """(b, name) of all blank nodes."""
    s_blank, o_blank = F.col("s_kind") == "bnode", F.col("o_kind") == "bnode"
    held = cut(triples.where(s_blank | o_blank).select("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang").distinct())
    facts = held.where(s_blank & ~o_blank).select(F.col("s").alias("b"), _hashed(F.lit(">"), "p", "o", "o_kind", "o_dt", "o_lang").alias("h"))
    facts = facts.union(held.where(~s_blank & o_blank).select(F.col("o").alias("b"), _hashed(F.lit("<"), "p", "s", "s_kind").alias("h")))
    links = held.where(s_blank & o_blank).select("s", "p", "o")
    nodes = held.where(s_blank).select(F.col("s").alias("b")).union(held.where(o_blank).select(F.col("o").alias("b"))).distinct()
    alone = cut(facts.groupBy("b").agg(F.collect_list("h").alias("hs")))
    linked = not links.isEmpty()
    names = _refined(alone, links, nodes.select("b", F.lit("").alias("mark"), F.lit("").alias("name")), linked)
    if names.groupBy("name").count().where("count > 1").isEmpty():
        return names.select("b", "name")
    sets = _linked_sets(links, nodes)
    while True:
        tied = names.join(sets.hint("shuffle_merge"), "b").groupBy("root", "name").agg(F.count("*").alias("n"), F.min("b").alias("first")).where("n > 1")
        first = cut(tied.groupBy("root").agg(F.min_by("first", "name").alias("b")).select("b", F.lit(True).alias("chosen")))
        if first.isEmpty():
            break
        marked = names.join(first.hint("shuffle_merge"), "b", "left").withColumn("mark", F.when(F.col("chosen"), F.concat("mark", F.lit("+"))).otherwise(F.col("mark"))).withColumn("name", F.concat("name", "mark")).drop("chosen")
        names = _refined(alone, links, cut(marked), linked)
    alike = names.join(sets.hint("shuffle_merge"), "b").groupBy("root").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("name")), ","), 256).alias("sign"))
    turns = names.join(sets.hint("shuffle_merge"), "b").join(_counted(alike).hint("shuffle_merge"), "root")
    return cut(turns.select("b", F.when(F.col("turn") == 1, F.col("name")).otherwise(F.concat(F.lit("_:"), F.substring(F.sha2(F.concat_ws("|", "name", "turn"), 256), 1, 32))).alias("name")))


def canonical_blanks(triples: DataFrame) -> DataFrame:
    """``triples`` with blank nodes named as above, so that graphs from different texts compare as sets. Only triples with a blank node are joined."""
    s_blank, o_blank = F.col("s_kind") == "bnode", F.col("o_kind") == "bnode"
    names = blank_names(triples)
    far = lambda c: names.select(F.col("b").alias(c), F.col("name").alias(f"{c}_name")).hint("shuffle_merge")
    held = triples.where(s_blank | o_blank).join(far("s"), "s", "left").join(far("o"), "o", "left")
    named = held.withColumns({"s": F.when(s_blank, F.col("s_name")).otherwise(F.col("s")), "o": F.when(o_blank, F.col("o_name")).otherwise(F.col("o"))})
    return triples.where(~s_blank & ~o_blank).unionByName(named.select(*triples.columns))


def graph_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, triple...): what only one of two graphs says, under canonical names; no rows if the graphs are isomorphic."""
    columns = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]
    a, b = (canonical_blanks(g).select(*columns).distinct() for g in (left, right))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
