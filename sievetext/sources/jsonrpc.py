"""JSON, NDJSON and JSON-RPC texts: validity, message type, redaction, typed values."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetext.functions import text as T
from sievetext.functions.regexes import let
from sievetext.operators import pii


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def part(value: Column, path: str) -> Column:
    """The JSON text below ``path``, or null."""
    return F.to_json(F.try_variant_get(value, path, "variant"))


def is_valid(text: Column) -> Column:
    """jsonrpc is "2.0" and a method string, a result or an error is there."""

    def judged(v: Column) -> Column:
        method = F.schema_of_variant(F.try_variant_get(v, "$.method", "variant")) == "STRING"
        known = (F.try_variant_get(v, "$.jsonrpc", "string") == "2.0") & (F.coalesce(method, F.lit(False)) | part(v, "$.result").isNotNull() | part(v, "$.error").isNotNull())
        return F.coalesce(known, F.lit(False))

    return let(parsed(text), judged)


def message_type(text: Column) -> Column:
    """error, request, notification or response; a request if nothing else fits."""
    has = lambda path: F.get_json_object(text, path).isNotNull()
    keys = F.coalesce(F.json_object_keys(text), F.expr("cast(array() as array<string>)"))
    identified = F.array_contains(keys, "id")
    method = has("$.method")
    return F.when(has("$.error"), "error").when(method & identified, "request").when(method, "notification").when(has("$.result") | F.array_contains(keys, "result"), "response").otherwise("request")


def method_name(text: Column) -> Column:
    """The message's method, or null."""
    return F.get_json_object(text, "$.method")


def looks_like_jsonrpc(text: Column) -> Column:
    """Whether a text holds the version key, without parsing it."""
    return text.contains('"jsonrpc"') & text.contains('"2.0"')


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """The valid messages of NDJSON texts: docs' columns, line number and message."""
    split = docs.select("*", F.posexplode(F.split(text, r"\r?\n")).alias("line", "message"))
    return split.where(is_valid(F.trim(F.col("message"))))


def sensitive_parts(text: Column) -> Column:
    """JSON texts of params, result and error.data that are there."""
    return let(parsed(text), lambda v: F.array_compact(F.array(part(v, "$.params"), part(v, "$.result"), part(v, "$.error.data"))))


def redact_messages(docs: DataFrame, policy: pii.Policy = pii.Policy(), text: str = "text", out: str = "redacted") -> DataFrame:
    """Messages with params, result and error.data redacted; other texts are left alone.

    A redacted part that is no JSON any more becomes a string.
    """
    v = docs.withColumn("__v", parsed(F.col(text)))
    paths = {"params": "$.params", "result": "$.result", "data": "$.error.data"}
    for name, path in paths.items():
        v = v.withColumn(f"__{name}", T.normalize(part(F.col("__v"), path)))
    for name in paths:
        clean = pii.rewrite(F.col(f"__{name}"), pii.detect(F.col(f"__{name}"), policy), policy)
        quoted = F.regexp_replace(F.to_json(F.array(clean)), r"^\[|\]$", "")
        v = v.withColumn(f"__{name}", F.when(F.col(f"__{name}").isNotNull(), F.when(parsed(clean).isNotNull(), clean).otherwise(quoted)))
    field = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value))
    whole = lambda name: part(F.col("__v"), f"$.{name}")
    error = F.concat(F.lit("{"), F.concat_ws(",", field("code", part(F.col("__v"), "$.error.code")), field("message", part(F.col("__v"), "$.error.message")), field("data", F.col("__data"))), F.lit("}"))
    message = F.concat(F.lit("{"), F.concat_ws(",", field("jsonrpc", whole("jsonrpc")), field("id", whole("id")), field("method", whole("method")), field("params", F.col("__params")), field("result", F.col("__result")), F.when(whole("error").isNotNull(), F.concat(F.lit('"error":'), error))), F.lit("}"))
    return v.withColumn(out, F.when(is_valid(F.col(text)), message).otherwise(F.col(text))).drop("__v", *[f"__{n}" for n in paths])


#: Fixed key names by type, and parts of names that decide otherwise.
KEY_TYPES = {
    "email": "email mail emailaddress email_address e_mail useremail user_email".split(),
    "phone": "phone tel telephone mobile phonenumber phone_number cell cellphone".split(),
    "credit_card": "card cardnumber card_number creditcard credit_card ccnumber cc_number pan".split(),
    "ssn": "ssn socialsecurity social_security socialsecuritynumber social_security_number".split(),
    "name": "name firstname first_name lastname last_name fullname full_name username user_name".split(),
    "address": "address street streetaddress street_address homeaddress home_address".split(),
    "postal": "zip zipcode zip_code postal postalcode postal_code".split(),
    "ip": "ip ipaddress ip_address clientip client_ip remoteaddr remote_addr".split(),
}
KEY_PARTS = (("email", "email"), ("mail", "email"), ("phone", "phone"), ("tel", "phone"), ("card", "credit_card"), ("credit", "credit_card"), ("address", "address"), ("addr", "address"))
RISKS = {"credit_card": "high", "ssn": "high", "email": "medium", "phone": "medium", "name": "medium"}
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_PHONE = re.compile(r"\+?[0-9][0-9 ().-]{8,}[0-9]")
DEPTH = 10
HITS = "array<struct<type:string,start:int,end:int,value:string,risk:string,confidence:double,path:string,key:string>>"


def key_type(key: str) -> str | None:
    low = key.lower()
    return next((t for t, names in KEY_TYPES.items() if low in names), None) or next((t for p, t in KEY_PARTS if p in low), None)


def walk(text: str | None) -> list[dict]:
    """Hits of string properties, by key and by content, to depth 10; one JSON value or NDJSON."""
    if not text:
        return []
    try:
        roots = [("$", json.loads(text))]
    except ValueError:
        roots = []
        for k, line in enumerate(text.split("\n")):
            try:
                roots.append((f"$.[{k}]", json.loads(line)))
            except ValueError:
                if line.strip():
                    return []
    out: list[dict] = []

    def add(kind: str, value: str, confidence: float, path: str, key: str) -> None:
        at = text.find(value)
        if at >= 0:
            out.append({"type": kind, "start": at, "end": at + len(value), "value": value, "risk": RISKS.get(kind, "low"), "confidence": confidence, "path": path, "key": key})

    todo = [(path, value, 0) for path, value in reversed(roots)]
    while todo:
        path, value, depth = todo.pop()
        if depth > DEPTH:
            continue
        if isinstance(value, list):
            todo += [(f"{path}.[{k}]", v, depth + 1) for k, v in reversed(list(enumerate(value))) if isinstance(v, (dict, list))]
        elif isinstance(value, dict):
            for key, v in value.items():
                if isinstance(v, str) and v:
                    if kind := key_type(key):
                        add(kind, v, 0.9, f"{path}.{key}", key)
                    elif _EMAIL.search(v):
                        add("email", v, 0.8, f"{path}.{key}", key)
                    elif _PHONE.search(v):
                        add("phone", v, 0.7, f"{path}.{key}", key)
            todo += [(f"{path}.{k}", v, depth + 1) for k, v in reversed(value.items()) if isinstance(v, (dict, list))]
    return out


def json_hits(docs: DataFrame, text: str = "text", out: str = "json_hits") -> DataFrame:
    """``docs`` with the hits of JSON texts; a walk of unknown depth has no built-in form."""

    @F.pandas_udf(HITS)
    def found(values: pd.Series) -> pd.Series:
        return values.map(walk)

    looks = F.col(text).rlike(r"^\s*[\[{]")
    return docs.withColumn(out, F.coalesce(F.when(looks, found(F.when(looks, F.col(text)))), F.expr(f"cast(array() as {HITS})")))
