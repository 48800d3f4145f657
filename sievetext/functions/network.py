"""IPv6 addresses as column expressions: parsing, full form and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievetext.functions.regexes import let

V4 = r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})$"
NOT_EMPTY = lambda x: x != ""


def _head(clean: Column, v4: Column) -> Column:
    """The part before an embedded IPv4 address, with its ``::`` whole."""
    cut = F.regexp_extract(clean, r"^(.*):[^:]*$", 1)
    shown = F.when(cut == "", "::").when(cut.endswith(":") & ~cut.endswith("::"), F.concat(cut, F.lit(":"))).otherwise(cut)
    return F.when(v4 == "", clean).otherwise(shown)


def _groups(head: Column, wanted: Column) -> Column:
    """The groups written out, ``::`` filled up with zeros; null if there is no room for it."""
    before = F.filter(F.split(F.regexp_extract(head, r"^(.*?)::", 1), ":"), NOT_EMPTY)
    after = F.filter(F.split(F.regexp_extract(head, r"::(.*)$", 1), ":"), NOT_EMPTY)
    missing = wanted - F.size(before) - F.size(after)
    filled = F.when(missing >= 0, F.concat(before, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), after))
    return F.when(head.contains("::"), filled).otherwise(F.split(head, ":"))


def parse_ipv6(address: Column) -> Column:
    """(valid, normalized, kind, private) of an address, with or without zone and brackets.

    Kinds: loopback (also the unspecified address), link_local, unique_local, documentation,
    other. A null or invalid address is not valid and has no other field.
    """
    none = F.struct(F.lit(False).alias("valid"), F.lit(None).cast("string").alias("normalized"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("boolean").alias("private"))

    def parsed(clean: Column) -> Column:
        v4 = F.regexp_extract(clean, V4, 1)
        wanted = F.when(v4 == "", 8).otherwise(6)

        def judged(parts: Column) -> Column:
            fits = parts.isNotNull() & (F.size(parts) == wanted) & F.forall(parts, lambda p: p.rlike("^[0-9a-fA-F]{0,4}$"))
            full = F.array_join(F.transform(parts, lambda p: F.lower(F.lpad(p, 4, "0"))), ":")
            first = F.coalesce(F.conv(parts[0], 16, 10).cast("int"), F.lit(0))
            kind = (
                F.when(clean.isin("::", "::1"), "loopback").when(first.between(0xFE80, 0xFEBF), "link_local").when(first.between(0xFC00, 0xFDFF), "unique_local")
                .when((parts[0] == "2001") & (F.lower(parts[1]) == "db8"), "documentation").otherwise("other")
            )
            whole = F.struct(F.lit(True).alias("valid"), F.when(v4 == "", full).otherwise(F.concat(full, F.lit(":"), v4)).alias("normalized"), kind.alias("kind"), kind.isin("loopback", "link_local", "unique_local").alias("private"))
            return F.when(fits, whole).otherwise(none)

        sound = clean.contains(":") & (F.regexp_count(clean, F.lit("::")) <= 1) & ~clean.contains(":::")
        return F.when(sound, let(_groups(_head(clean, v4), wanted), judged)).otherwise(none)

    clean = F.regexp_replace(F.substring_index(address, "%", 1), r"[\[\]]", "")
    return F.when(address.rlike(r"^[0-9a-zA-Z:.%\[\]]+$"), let(clean, parsed)).otherwise(none)
