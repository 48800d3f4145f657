"""Scalar text functions: normalisation, checksums, masks and tokens; all JVM-side but NFKC."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievetext.functions.regexes import let, to_java

#: Characters up to U+0131 that compatibility composition leaves alone.
STABLE = r"^[\x00-\x{9F}\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}]*$"
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{2060}\x{feff}]"
_DASHES, _BLANKS = re.compile("[\u2212\u2010-\u2015\u30fc]"), re.compile("[ \t\u3000]+")
SPACE = to_java(r"\s")
#: The characters of SPACE, for functions that take a list.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~text.rlike(to_java(r"\S"))


def _replaced(text: Column, pattern: str, new: str, present: str | None = None) -> Column:
    """Replace where a cheaper search finds anything to replace."""
    return F.when(text.rlike(present or pattern), F.regexp_replace(text, pattern, new)).otherwise(text)



@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition; rows of stable Latin characters never reach Python."""
    plain = text.rlike(STABLE)
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


def normal(text: str) -> str:
    """One text composed, with one kind of dash and single blanks, trimmed unless blank."""
    out = _BLANKS.sub(" ", _DASHES.sub("-", unicodedata.normalize("NFKC", text)))
    return out.strip(SPACES) or out


@F.pandas_udf(StringType())
def _normal(text: pd.Series) -> pd.Series:
    return text.map(normal, na_action="ignore")


def normalize(text: Column) -> Column:
    """NFKC, one dash and one blank; printable ASCII without double blanks is left alone.

    Stable Latin texts, which hold no dashes but the plain one, are cleaned in the JVM.
    """
    untouched, plain = text.rlike(r"^ ?(?:[\x21-\x7E]++ ?)*+$"), text.rlike(STABLE)
    squeezed = _replaced(text, r"[ \t]+", " ", r"[ \t]{2}|\t")
    cleaned = F.when(text.rlike(to_java(r"\S")), trim(squeezed)).otherwise(squeezed)
    return F.when(untouched, text).when(plain, cleaned).otherwise(_normal(F.when(~plain, text)))


#: Fixed character references.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#x2F;", "/"), ("&#39;", "'"), ("&#47;", "/"), ("&amp;", "&"))


def normalize_encoding(text: Column) -> Column:
    """NFKC, eight character references in one pass, and a whole-string percent decoding."""
    out = nfkc(text)
    decoded = out
    for name, value in ENTITIES:
        decoded = F.replace(decoded, F.lit(name), F.lit(value))
    out = F.when(out.contains("&"), decoded).otherwise(out)
    return let(out, lambda t: F.when(t.contains("%"), F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)).otherwise(t))


def escape_unicode(text: Column) -> Column:
    """No zero-width characters; odd spaces become blanks."""
    return F.regexp_replace(F.regexp_replace(text, ZERO_WIDTH, ""), r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", " ")


def final_cleanup(text: Column) -> Column:
    """Single blanks, trimmed, no empty brackets, adjacent redaction marks joined."""
    out = F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")
    out = F.regexp_replace(out, rf"\[{SPACE}*\]", "")
    return F.regexp_replace(out, rf"(?:\[(?:REDACTED|NEUTRALIZED|REMOVED)[^\]]*\]{SPACE}*){{2,}}", "[MULTIPLE_REDACTIONS]")


def quote_dangerous(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the mod-10 check."""
    return F.coalesce(F.call_function("luhn_check", number), F.lit(False))


def my_number(number: Column) -> Column:
    """Twelve digits whose last is the weighted mod-11 check of the others."""
    weights = F.array(*[F.lit(w) for w in (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)])
    total = F.aggregate(F.zip_with(F.slice(F.split(number, ""), 1, 11), weights, lambda d, w: d.cast("int") * w), F.lit(0), lambda s, x: s + x)
    rest = total % 11
    check = F.when(rest <= 1, 0).otherwise(11 - rest)
    return number.rlike("^[0-9]{12}$") & ~number.rlike(r"^(\d)\1{11}$") & (check == F.substring(number, 12, 1).cast("int"))


def ssn(number: Column) -> Column:
    """Area, group and serial rules of a 3-2-4 number."""
    return number.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def prefilter(text: Column) -> Column:
    """Cheap flags: could the text hold an email, card, phone, IPv4 or MAC address?"""
    number = text.rlike("[0-9]")
    return F.struct(
        text.contains("@").alias("email"), number.alias("credit_card"), (number & text.rlike("[-+]")).alias("phone"), (number & text.contains(".")).alias("ipv4"), text.contains(":").alias("ipv6")
    )


def prefilter_regions(text: Column, size: int = 1000) -> Column:
    """(start, end, flags) of the pieces of a text that could hold any of what ``prefilter`` looks for."""
    pieces = F.transform(chunks(text, size), lambda c: F.struct(c["position"].alias("start"), (c["position"] + F.length(c["chunk"])).alias("end"), prefilter(c["chunk"]).alias("flags")))
    return F.filter(pieces, lambda p: p["flags"]["email"] | p["flags"]["credit_card"] | p["flags"]["ipv6"])


def quick_email(text: Column) -> Column:
    """Cheap form test: lengths of the local part, the domain and its last label."""
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    last = F.substring_index(domain, ".", -1)
    one = F.regexp_count(text, F.lit("@")) == 1
    return F.coalesce(one & F.length(local).between(1, 64) & F.length(domain).between(1, 253) & domain.contains(".") & F.length(last).between(2, 63), F.lit(False))


def quick_ip(text: Column) -> Column:
    """Cheap form test: four dotted parts, or two to seven colons."""
    colons = F.regexp_count(text, F.lit(":"))
    return F.coalesce((F.size(F.split(text, r"\.")) == 4) | colons.between(2, 7), F.lit(False))


def mask_token(token: Column, start: int = 4, end: int = 4, least: int = 8) -> Column:
    """Stars between a kept head and tail, each at most a third of the token."""
    size = F.length(token)
    head, tail = F.least(F.lit(start), F.floor(size / 3).cast("int")), F.least(F.lit(end), F.floor(size / 3).cast("int"))
    stars = F.greatest(F.lit(1), size - head - tail)
    return F.when(size <= least, F.repeat(F.lit("*"), size)).otherwise(F.concat(F.substring(token, F.lit(1), head), F.repeat(F.lit("*"), stars), F.substring(token, size - tail + 1, tail)))


def bullets(text: Column, what: str = "[0-9]") -> Column:
    return F.regexp_replace(text, what, "•")


def hmac_sha256(value: Column, key: str) -> Column:
    """Keyed digest as bytes, from two native SHA-256 passes."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))


def token_for(kind: Column, value: Column, key: str) -> Column:
    """``TKN_<KIND>_`` and the unpadded URL-safe digest of the value."""
    if len(key) < 32:
        raise ValueError("the HMAC key must have at least 32 characters")
    text = F.regexp_replace(F.translate(F.base64(hmac_sha256(value, key)), "+/", "-_"), "[=\r\n]", "")
    return F.concat(F.lit("TKN_"), F.upper(kind), F.lit("_"), text)


def chunks(text: Column, size: int = 1024) -> Column:
    """Consecutive pieces of ``size`` characters: array of (position, chunk)."""
    last = F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * size).alias("position"), F.substring(text, i * size + 1, F.lit(size)).alias("chunk")))
    return F.when(F.length(text) > 0, cut).otherwise(F.expr("cast(array() as array<struct<position:int,chunk:string>>)"))


def is_binary(data: Column) -> Column:
    """Whether the first 512 bytes look binary: NULs or many control characters."""
    head = F.hex(F.substring(data, 1, 512))
    size = F.length(head) / 2
    # each byte is two hex digits and a blank, so a byte's pattern can't straddle two bytes
    spaced = F.regexp_replace(head, "(..)", "$1 ")
    nul = F.regexp_count(spaced, F.lit("00 "))
    control = F.regexp_count(spaced, F.lit("(?:0[0-8BCEF]|1[0-9A-F]) "))
    return (size > 0) & ((nul >= 3) | (control >= 8) | (nul / size > 0.02) | (control / size > 0.05))
