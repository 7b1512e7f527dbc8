"""Literals as values: which texts a datatype allows, and how two literals compare.

A literal is (text, datatype, language). Literals are ordered within a family: numbers, dates, stamps, times, years,
truth values, plain texts. Moments with and without a zone aren't comparable, and neither are literals of two families or
of a datatype without an order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigraph.functions import names as N

X = N.XSD
LANG_STRING = N.RDF + "langString"
#: The ranges of the whole-number datatypes.
WHOLE = {
    "integer": (None, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127), "nonNegativeInteger": (0, None), "positiveInteger": (1, None),
    "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
NUMERAL = r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF)$"
NUMBERS = [X + n for n in (*WHOLE, "decimal", "double", "float")]
ZONE = r"(Z|[+-]\d\d:\d\d)?"
DAY, CLOCK = r"-?\d{4,}-\d\d-\d\d", r"\d\d:\d\d:\d\d(?:\.\d+)?"
#: Datatypes of moments: the text's form, and what makes a stamp of it.
MOMENTS = {
    X + "date": (DAY, "", "T00:00:00"), X + "dateTime": (f"{DAY}T{CLOCK}", "", ""), X + "dateTimeStamp": (f"{DAY}T{CLOCK}", "", ""), X + "time": (CLOCK, "1970-01-01T", ""), X + "gYear": (r"-?\d{4,}", "", "-01-01T00:00:00"),
    X + "gYearMonth": (r"-?\d{4,}-\d\d", "", "-01T00:00:00"),
}
#: Other forms of text by datatype.
FORMS = {
    X + "decimal": r"[+-]?(\d+(\.\d*)?|\.\d+)", X + "double": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN", X + "float": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN", X + "boolean": "true|false|1|0",
    X + "hexBinary": "([0-9A-Fa-f]{2})*", X + "duration": r"-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?", X + "language": "[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*",
    X + "gMonthDay": rf"--\d\d-\d\d{ZONE}", X + "gMonth": rf"--\d\d{ZONE}", X + "gDay": rf"---\d\d{ZONE}",
}


def datatype(dt: Column, lang: Column) -> Column:
    """The datatype that a literal has: plain texts are strings, tagged ones strings of a language."""
    return F.when(F.coalesce(lang, F.lit("")) != "", F.lit(LANG_STRING)).when(F.coalesce(dt, F.lit("")) == "", F.lit(X + "string")).otherwise(dt)


def _whole(text: Column, low: int | None, high: int | None) -> Column:
    value = F.regexp_replace(text, r"^\+", "").try_cast("decimal(38,0)")
    inside = [value >= F.lit(str(low)).cast("decimal(38,0)")] if low is not None else []
    inside += [value <= F.lit(str(high)).cast("decimal(38,0)")] if high is not None else []
    return text.rlike(r"^[+-]?\d+$") & reduce(lambda a, b: a & b, inside, F.lit(True))


def _stamp(text: Column, form: str, before: str, after: str) -> tuple[Column, Column]:
    """The moment (as if at zone zero, if it has none), and whether it has a zone."""
    zone = F.regexp_extract(text, f"{ZONE}$", 1)
    local = F.regexp_extract(text, f"^({form}){ZONE}$", 1)
    return F.concat(F.lit(before), local, F.lit(after), F.when(zone == "", "Z").otherwise(zone)).try_cast("timestamp"), zone != ""


def allowed(text: Column, name: str) -> Column:
    """Whether the datatype ``name`` allows the text; unknown datatypes, strings among them, allow any."""
    t, short = F.trim(text), name.removeprefix(X)
    if name.startswith(X) and short in WHOLE:
        return F.coalesce(_whole(t, *WHOLE[short]), F.lit(False))
    if name in FORMS:
        return t.rlike(f"^({FORMS[name]})$")
    if name in MOMENTS:
        stamp, zoned = _stamp(t, *MOMENTS[name])
        return stamp.isNotNull() & (zoned | F.lit(not name.endswith("Stamp")))
    return F.lit(True)


def valid(text: Column, dt: Column) -> Column:
    """``allowed`` for a column of datatypes, as by ``datatype``."""
    names = [*(X + n for n in WHOLE), *FORMS, *MOMENTS]
    return reduce(lambda chain, n: chain.when(dt == n, allowed(text, n)), names[1:], F.when(dt == names[0], allowed(text, names[0]))).otherwise(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


PLACE = "struct<family:string,x:double,n:decimal(38,12),at:timestamp,text:string>"


def place(text: Column, dt: Column, lang: Column) -> Column:
    """(family, x, n, at, text) of a literal, null for one without an order. Places of one family sort as the literals do."""
    nothing = F.lit(None)

    def made(own: Column) -> Column:
        t = F.trim(text)
        x = F.when(t.rlike("^[+]?INF$"), F.lit(float("inf"))).when(t == "-INF", F.lit(float("-inf"))).otherwise(t.try_cast("double"))
        form = F.when(own == X + "decimal", t.rlike(f"^({FORMS[X + 'decimal']})$")).when(own.isin(X + "double", X + "float"), t.rlike(NUMERAL)).otherwise(t.rlike(r"^[+-]?\d+$"))
        number = F.when(form, F.struct(F.lit("number"), x, F.regexp_replace(t, r"^\+", "").try_cast("decimal(38,12)"), nothing, nothing).cast(PLACE))
        truth = F.when(t.isin("true", "1", "false", "0"), F.struct(F.lit("boolean"), t.isin("true", "1").cast("double"), nothing, nothing, nothing).cast(PLACE))
        kinds = [(name.removeprefix(X).removesuffix("Stamp"), own == name, *how) for name, how in MOMENTS.items()]
        family = reduce(lambda c, k: c.when(k[1], k[0]), kinds[1:], F.when(kinds[0][1], kinds[0][0]))
        local = [F.concat(F.lit(before), F.nullif(F.regexp_extract(t, f"^({form}){ZONE}$", 1), F.lit("")), F.lit(after)) for _, _, form, before, after in kinds]
        stamp = reduce(lambda c, k: c.when(k[0], k[1]), [(k[1], v) for k, v in zip(kinds[1:], local[1:], strict=True)], F.when(kinds[0][1], local[0]))
        zone = F.regexp_extract(t, f"{ZONE}$", 1)
        moment = F.struct(F.concat(family, F.when(zone == "", "").otherwise(" with a zone")), nothing, nothing, F.concat(stamp, F.when(zone == "", "Z").otherwise(zone)).try_cast("timestamp"), nothing).cast(PLACE)
        told = let(moment, lambda m: F.when(m["at"].isNotNull(), m))
        plain = F.struct(F.lit("string"), nothing, nothing, nothing, text).cast(PLACE)
        return F.when(own.isin(*NUMBERS), number).when(own == X + "string", plain).when(own == X + "boolean", truth).when(own.isin(*MOMENTS), told)

    return let(datatype(dt, lang), made)


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the places of two literals; null if they aren't comparable."""
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).when(x == y, 0)
    exact = lambda p: p["a"]["n"].isNotNull() & p["b"]["n"].isNotNull()
    side = lambda p: F.coalesce(F.when(exact(p), sign(p["a"]["n"], p["b"]["n"])), sign(p["a"]["x"], p["b"]["x"]), sign(p["a"]["at"], p["b"]["at"]), sign(p["a"]["text"], p["b"]["text"]))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.when(p["a"]["family"] == p["b"]["family"], side(p)))


def in_language(lang: Column, wanted: str) -> Column:
    """Whether a tag is within a basic range: the same, or longer after a hyphen; * is any tag."""
    own = F.lower(F.coalesce(lang, F.lit("")))
    return own != "" if wanted == "*" else (own == wanted.lower()) | own.startswith(wanted.lower() + "-")
