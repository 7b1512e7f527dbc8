"""Property paths as joins, from given nodes outwards.

Nodes and values are rows (f, v, o, o_kind, o_dt, o_lang): f names where the walk began, v the term that it has come to, and
the rest is that term. A term's name is its IRI, its blank node or, quoted, its text with datatype and language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.operators.hierarchy import cut, stored

TERM = ["v", "o", "o_kind", "o_dt", "o_lang"]


@dataclass(frozen=True)
class Path:
    """One predicate (``kind`` iri), or inverse, sequence, alternative, star, plus or opt of other paths."""

    kind: str
    iri: str = ""
    parts: tuple[Path, ...] = ()

    def __str__(self) -> str:
        held = [str(p) if p.kind in ("iri", "inverse") else f"({p})" for p in self.parts]
        return {"iri": self.iri, "inverse": "^" + "".join(held), "sequence": "/".join(held), "alternative": "|".join(held)}.get(self.kind) or "".join(held) + {"star": "*", "plus": "+", "opt": "?"}[self.kind]


def predicate(iri: str) -> Path:
    return Path("iri", iri)


def inverse(path: Path) -> Path:
    """The path walked backwards; only single predicates are left inverse."""
    if path.kind == "iri":
        return Path("inverse", parts=(path,))
    if path.kind == "inverse":
        return path.parts[0]
    parts = tuple(inverse(p) for p in path.parts)
    return Path(path.kind, parts=parts[::-1] if path.kind == "sequence" else parts)


def sequence(*parts: Path) -> Path:
    return Path("sequence", parts=parts)


def alternative(*parts: Path) -> Path:
    return Path("alternative", parts=parts)


def repeated(path: Path, least: int = 0) -> Path:
    """The path any number of times, or once at least."""
    return Path("plus" if least else "star", parts=(path,))


def at_most_once(path: Path) -> Path:
    return Path("opt", parts=(path,))


def name_of(o: Column, kind: Column, dt: Column, lang: Column) -> Column:
    text = F.concat(F.lit('"'), o, F.lit('"^^'), F.coalesce(dt, F.lit("")), F.lit("@"), F.lower(F.coalesce(lang, F.lit(""))))
    return F.when(kind == "literal", text).otherwise(o)


def named(triples: DataFrame) -> DataFrame:
    """The triples with v, the object's name."""
    return triples.select("s", "s_kind", "p", name_of(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")).alias("v"), "o", "o_kind", "o_dt", "o_lang")


def nodes(subjects: DataFrame) -> DataFrame:
    """IRIs and blank nodes ``s`` as nodes to begin at."""
    s, nothing = F.col("s"), F.lit(None).cast("string")
    kind = F.when(s.startswith("_:"), "bnode").otherwise("iri")
    return subjects.select(s.alias("f"), s.alias("v"), s.alias("o"), kind.alias("o_kind"), nothing.alias("o_dt"), nothing.alias("o_lang")).distinct()


def predicates(*paths: Path) -> set[str]:
    """All predicates that the paths name."""
    return {iri for p in paths for iri in (p.iri, *predicates(*p.parts)) if iri}


def walk(triples: DataFrame, held: DataFrame, path: Path) -> DataFrame:
    """Where ``path`` leads to from ``held``, each value of a start once. ``triples`` are named ones.

    A repeated path is followed from these nodes, round by round until nothing new is reached, each round written to the
    checkpoint folder; so it reads as many rows as the walk meets, whatever else the graph holds, and ends in cycles. The triples
    of its predicates are stored first, as every round reads them."""
    if path.kind in ("plus", "star"):
        triples = stored(triples.where(F.col("p").isin(*sorted(predicates(path)))))
    if path.kind == "iri":
        step = triples.where(F.col("p") == path.iri).select("s", *TERM)
        return held.select("f", F.col("v").alias("s")).join(step, "s").select("f", *TERM).distinct()
    if path.kind == "inverse":
        nothing = F.lit(None).cast("string")
        step = triples.where(F.col("p") == path.parts[0].iri).select("v", "s", "s_kind")
        back = held.select("f", "v").join(step, "v")
        return back.select("f", F.col("s").alias("v"), F.col("s").alias("o"), F.col("s_kind").alias("o_kind"), nothing.alias("o_dt"), nothing.alias("o_lang")).distinct()
    if path.kind == "sequence":
        return reduce(lambda at, part: walk(triples, at, part), path.parts, held)
    if path.kind == "alternative":
        return reduce(DataFrame.unionByName, [walk(triples, held, p) for p in path.parts]).distinct()
    if path.kind == "opt":
        return held.select("f", *TERM).unionByName(walk(triples, held, path.parts[0])).distinct()
    if path.kind == "plus":
        held = walk(triples, held, path.parts[0])
    known = front = cut(held.select("f", *TERM).distinct())
    while True:
        front = cut(walk(triples, front, path.parts[0]).join(known.select("f", "v"), ["f", "v"], "left_anti"))
        if front.isEmpty():
            return known
        known = known.unionByName(front)
