"""Cookies, headers and secret URLs: parsing, allow lists and masks, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievetext.functions import text as T
from sievetext.functions.regexes import let

COOKIE, SET_COOKIE = r"(?i)^Cookie\s*:\s*", r"(?i)^Set-Cookie\s*:\s*"


def check_allowlist(names: Iterable[str]) -> None:
    """Names hold no line breaks or NULs, and a ``*`` only at the end."""
    for name in names:
        if any(c in name for c in "\0\n\r"):
            raise ValueError(f"control character in allowed name {name!r}")
        if "*" in name[:-1]:
            raise ValueError(f"wildcard before the end of allowed name {name!r}")


def is_allowed(name: Column, names: Iterable[str]) -> Column:
    """Whether a name is listed, in either case; a final ``*`` stands for any ending."""
    out, low = F.lit(False), F.lower(name)
    for n in names:
        out = out | (low == n.lower()) | (low.startswith(n[:-1].lower()) if n.endswith("*") else F.lit(False))
    return out


def pairs(text: Column) -> Column:
    """name=value items between semicolons, trimmed; items without a name are left out."""

    def pair(item: Column) -> Column:
        at = F.instr(item, "=")
        return F.struct(T.trim(F.substring(item, F.lit(1), at - 1)).alias("name"), T.trim(F.substring(item, at + 1, F.length(item))).alias("value"))

    items = F.transform(F.split(text, ";"), T.trim)
    return F.transform(F.filter(items, lambda x: F.instr(x, "=") > 1), pair)


def cookies(header: Column) -> Column:
    """Names and values of a Cookie header."""
    return pairs(F.regexp_replace(header, COOKIE, ""))


def set_cookie(header: Column) -> Column:
    """Name and value that a Set-Cookie header sets, or null."""
    return F.get(pairs(F.regexp_replace(header, SET_COOKIE, "")), F.lit(0))


def header(line: Column) -> Column:
    """(name, value) of a header line, or null if it has no name."""
    at = F.instr(line, ":")
    return F.when(at > 1, F.struct(T.trim(F.substring(line, F.lit(1), at - 1)).alias("name"), T.trim(F.substring(line, at + 1, F.length(line))).alias("value")))


def masked_cookies(line: Column, allowed: tuple[str, ...] = ()) -> Column:
    """A Cookie header with the middle of every value starred, but for allowed names."""
    one = lambda c: F.concat(c["name"], F.lit("="), F.when(is_allowed(c["name"], allowed), c["value"]).otherwise(T.mask_token(c["value"], 2, 2, 6)))
    return F.concat(F.lit("Cookie: "), F.array_join(F.transform(cookies(line), one), "; "))


def masked_set_cookie(line: Column, allowed: tuple[str, ...] = ()) -> Column:
    """A Set-Cookie header with the middle of its value starred, unless its name is allowed."""
    shape = r"(?is)^(Set-Cookie\s*:\s*[^=]+=)([^;]+)(.*)$"
    hidden = lambda c: F.concat(F.regexp_extract(line, shape, 1), T.mask_token(c["value"], 2, 2, 6), F.regexp_extract(line, shape, 3))
    return let(set_cookie(line), lambda c: F.when(c.isNull(), "[REDACTED:SET-COOKIE]").when(is_allowed(c["name"], allowed), line).otherwise(hidden(c)))


def masked_webhook(url: Column) -> Column:
    """Scheme, host and the first two path parts; of the others those of 8 characters or more starred."""
    path = F.split(F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)", 1), "/")
    star = lambda p, k: F.when((k <= 2) | (F.length(p) < 8), p).otherwise(F.repeat(F.lit("*"), F.least(F.lit(12), F.length(p))))
    shown = F.concat(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1), F.array_join(F.transform(path, star), "/"))
    return F.when(F.size(path) >= 3, shown).otherwise("[REDACTED:WEBHOOK-URL]")


def masked_signed(url: Column) -> Column:
    """A whole URL without its parameters; of a bare parameter list only a label."""
    base = F.regexp_extract(url, r"^(https?://[^?#]+)", 1)
    return F.when(base != "", F.concat(base, F.lit("?[REDACTED:SIGNED-PARAMS]"))).otherwise("[REDACTED:SIGNED-URL]")
