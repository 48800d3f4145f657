"""Patterns written for a script dialect, translated for the JVM's regex engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def to_java(pattern: str, flags: str = "") -> str:
    r"""The same pattern for Java: ASCII ``\b``, Unicode ``\s``, literal ``[`` and ``&&`` in classes."""
    out, in_class, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        two = pattern[k : k + 2]
        k += 2 if c == "\\" else 1
        if two == r"\s":
            # printable ASCII is ruled out by one range before the many are tried
            out.append(_SPACES if in_class else rf"[\x00-\x20\x7f-\x{{10ffff}}&&[{_SPACES}]]")
        elif two == r"\S":
            out.append(f"[^{_SPACES}]")
        elif two == r"\b" and not in_class:
            out.append(_BOUNDARY)
        elif c == "\\":
            out.append(two)
        elif in_class and c in "[&":
            out.append("\\" + c)
        else:
            in_class = c == "[" or (in_class and c != "]")
            out.append(c)
    prefix = "".join(f for f in flags if f in "is")
    return (f"(?{prefix})" if prefix else "") + "".join(out)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Steps of a fold after which its array is handed on, so that copies stay in proportion to its length.
CHUNK = 256
_SPANS = "array<struct<value:string,start:int,end:int>>"


def spans(text: Column, pattern: str, most: int | None = None) -> Column:
    """Matches of a Java pattern: array of (value, start, end); code points, end exclusive."""
    empty = F.expr(f"cast(array() as {_SPANS})")
    between = F.split(text, pattern, -1)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(state["part"], F.array(F.struct(pair["value"].alias("value"), start.alias("start"), end.alias("end")))).alias("part"))

    def chunk(pairs: Column):
        def run(state: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(pairs, k * CHUNK + 1, CHUNK), F.struct(state["at"].alias("at"), empty.alias("part")), step)
            return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["out"], x["part"]).alias("out")))

        return run

    def folded(values: Column) -> Column:
        pairs = F.zip_with(values, F.slice(between, 1, F.size(values)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
        last = ((F.size(values) - 1) / CHUNK).cast("int")
        return let(pairs, lambda p: F.aggregate(F.sequence(F.lit(0), last), F.struct(F.lit(0).alias("at"), empty.alias("out")), chunk(p))["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # one search finds out whether there is anything to place
    return let(F.slice(found, 1, most) if most else found, lambda v: F.when(F.size(v) > 0, folded(v)).otherwise(empty))


def fold_spans(text: Column, pattern: str, zero: Column, step) -> Column:
    """``step(state, span)`` over all matches of a Java pattern in order; what ``step`` drops is not kept."""
    between = F.split(text, pattern, -1)

    def moved(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        span = F.struct(pair["value"].alias("value"), start.alias("start"), (start + F.length(pair["value"])).alias("end"))
        return let(span, lambda s: F.struct(s["end"].alias("at"), step(state["state"], s).alias("state")))

    def folded(values: Column) -> Column:
        pairs = F.zip_with(values, F.slice(between, 1, F.size(values)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), zero.alias("state")), moved)["state"]

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), folded)).otherwise(zero)
