"""Graph patterns over a triple table as plain joins: each function takes and gives DataFrames of solutions.

A solution table has one column a variable. Patterns join on the variables they share.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.operators.hierarchy import cut


def graph(df: DataFrame) -> DataFrame:
    """A triple table as a set."""
    return df.dropDuplicates(["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"])


def match(triples: DataFrame, s: str, p: str | Sequence[str], o: str | None = None, where: Column | None = None, lang: str | None = None) -> DataFrame:
    """Solutions of one triple pattern. ``s``: name of the subject's variable; ``p``: one IRI or several; ``o``: name of
    the object's variable, or None where it isn't wanted; ``lang``: name of a variable for the language."""
    held = triples.where(F.col("p").isin(*([p] if isinstance(p, str) else p)))
    if where is not None:
        held = held.where(where)
    return held.select(F.col("s").alias(s), *([F.col("o").alias(o)] if o else []), *([F.col("o_lang").alias(lang)] if lang else []))


def instances(triples: DataFrame, kind: str, s: str = "s") -> DataFrame:
    """Distinct subjects of a type."""
    return triples.where((F.col("p") == N.TYPE) & (F.col("o") == kind)).select(F.col("s").alias(s)).distinct()


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def also(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both patterns: inner join on the shared variables."""
    return left.join(right, shared(left, right))


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """The second pattern where it matches; several matches multiply the solution."""
    return left.join(right, shared(left, right), "left")


def optional_compatible(left: DataFrame, right: DataFrame, key: str, var: str) -> DataFrame:
    """An optional pattern that uses ``var`` again: it matches where ``var`` is unbound or the same, and binds it if unbound."""
    other = right.select(F.col(key).alias("__key"), F.col(var).alias("__var"))
    joined = left.join(other, (F.col(key) == F.col("__key")) & (F.col(var).isNull() | (F.col(var) == F.col("__var"))), "left")
    return joined.withColumn(var, F.coalesce(var, "__var")).drop("__key", "__var")


def optional_shared(left: DataFrame, right: DataFrame, keys: Sequence[str], maybe: Sequence[str]) -> DataFrame:
    """An optional pattern that shares ``keys``, bound on both sides, and the variables ``maybe``, each of which may be unbound on either side.

    A solution of ``right`` fits where every variable that both sides bind is the same, and binds the others. With keys this is one
    join on them. Without, the solutions are split by the variables that they bind, so that each part is a join on what it has in
    common, and none a comparison of all with all; parts without anything in common are refused unless one is empty.
    """
    more = [c for c in right.columns if c not in left.columns]
    columns = [*left.columns, *more]
    if keys:
        other = right.select(*[F.col(c).alias(f"__{c}") for c in right.columns])
        fits = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col(v).isNull() | F.col(f"__{v}").isNull() | (F.col(v) == F.col(f"__{v}")) for v in maybe]
        joined = left.join(other, reduce(lambda a, b: a & b, fits), "left")
        return joined.select(*[F.coalesce(c, f"__{c}").alias(c) if c in maybe else F.col(f"__{c}").alias(c) if c in more else F.col(c) for c in columns])
    left, right = cut(left), cut(right)

    def bound(df: DataFrame, those: Sequence[str], of: Sequence[str]) -> DataFrame:
        return df.where(reduce(lambda a, b: a & b, [F.col(v).isNotNull() if v in those else F.col(v).isNull() for v in of], F.lit(True)))

    def subsets(of: Sequence[str]) -> list[list[str]]:
        return [[v for i, v in enumerate(of) if k >> i & 1] for k in range(1 << len(of))]

    parts = []
    for mine in subsets(maybe):
        rest = begin = bound(left, mine, maybe)
        for common in subsets(mine):
            other, on = bound(right, common, mine), [*keys, *common]
            if not on:
                if begin.isEmpty() or other.isEmpty():
                    continue
                raise ValueError("the patterns have no bound variable in common")
            renamed = other.select(*on, *more, *[F.col(v).alias(f"__{v}") for v in maybe if v not in on])
            found = begin.join(renamed, on)
            parts.append(found.select(*[F.coalesce(c, f"__{c}").alias(c) if c in maybe and c not in on else F.col(c) for c in columns]))
            rest = rest.join(other.select(*on).distinct(), on, "left_anti")
        parts.append(rest.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in more]).select(*columns))
    return union_bag(*parts)


def union_bag(*parts: DataFrame) -> DataFrame:
    """Alternatives; a solution of two of them comes twice."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def where_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, shared(left, right), "left_semi")


def where_not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, shared(left, right), "left_anti")


def bind_exists(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """``left`` with a boolean column: whether the pattern matches."""
    keys = shared(left, right)
    found = right.select(*keys).distinct().withColumn(name, F.lit(True))
    return left.join(found, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def values(left: DataFrame, var: str, *allowed: str) -> DataFrame:
    """Inline table of one variable."""
    return left.where(F.col(var).isin(*allowed))


def predicate_contains(triples: DataFrame, fragment: str, s: str = "s", value: str | None = None) -> DataFrame:
    """Distinct subjects with a triple whose predicate's IRI holds ``fragment`` (and whose object is ``value``)."""
    held = triples.where(F.col("p").contains(fragment))
    return (held if value is None else held.where(F.col("o") == value)).select(F.col("s").alias(s)).distinct()


def fold(solutions: DataFrame, key: str, scalars: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """One row a key: the least value of each scalar and the sorted distinct values of each list."""
    return solutions.groupBy(key).agg(*[F.min(c).alias(c) for c in scalars], *[F.array_sort(F.collect_set(c)).alias(c) for c in lists])


def star(triples: DataFrame, columns: dict[str, str], s: str = "s") -> DataFrame:
    """One row a subject with the least object of each predicate, by one aggregation."""
    held = triples.where(F.col("p").isin(*columns.values()))
    return held.groupBy(F.col("s").alias(s)).agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in columns.items()])


def language_map(triples: DataFrame, p: str) -> DataFrame:
    """(s, labels): a map from language to value, the greatest value of a language."""
    per = triples.where((F.col("p") == p) & (F.col("o_kind") == "literal")).groupBy("s", F.coalesce(F.nullif("o_lang", F.lit("")), F.lit("cs")).alias("lang")).agg(F.max("o").alias("v"))
    return per.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "v")))).alias("labels"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Triples of the first graph that the second doesn't have."""
    return graph(left).select(*right.columns).exceptAll(graph(right))


def reachable(links: DataFrame, begin: DataFrame) -> DataFrame:
    """(node) of all that ``links`` (s, o) lead to from the nodes of ``begin`` (s), over any number of them; round by round, each
    written to the checkpoint folder, so that only what is reached is read again."""
    edges = cut(links.select("s", "o").distinct())
    front = cut(edges.join(begin.select("s").distinct(), "s", "left_semi").select(F.col("o").alias("node")).distinct())
    known = front
    while not front.isEmpty():
        further = edges.join(front.withColumnRenamed("node", "s"), "s", "left_semi").select(F.col("o").alias("node")).distinct()
        front = cut(further.join(known, "node", "left_anti"))
        known = known.union(front)
    return known


def first_values(triples: DataFrame, columns: dict[str, str], order: str = "place", s: str = "s") -> DataFrame:
    """One row a subject with the object of each predicate that comes first in the document, by ``order``."""
    held = triples.where(F.col("p").isin(*columns.values()))
    return held.groupBy(F.col("s").alias(s)).agg(*[F.min_by("o", F.when(F.col("p") == p, F.struct(order, "o"))).alias(c) for c, p in columns.items()])


def fold_ordered(triples: DataFrame, last: dict[str, str], lists: dict[str, str], order: str = "place", s: str = "s") -> DataFrame:
    """One row a subject: of the predicates ``last`` the object that comes last in the document, of ``lists`` all objects in the document's order, repeated ones too."""
    place = F.struct(order, "o")
    held = triples.where(F.col("p").isin(*last.values(), *lists.values()))
    rows = held.groupBy(F.col("s").alias(s)).agg(
        *[F.max_by("o", F.when(F.col("p") == p, place)).alias(c) for c, p in last.items()], *[F.array_sort(F.collect_list(F.when(F.col("p") == p, place))).alias(c) for c, p in lists.items()]
    )
    return rows.select(s, *last, *[F.transform(c, lambda x: x["o"]).alias(c) for c in lists])
