"""Readers of ground truth, manifests and dictionaries, and a contained file loader."""

from __future__ import annotations

import hashlib
import time
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUND_TRUTH = "id string, text string, annotations array<struct<start:int,end:int,type:string,value:string,confidence:double>>, metadata struct<language:string,domain:string,created_at:bigint>"
MANIFEST = "struct<dicts:array<struct<id:string,url:string>>>"
DICTIONARY = "struct<entries:array<struct<pattern:string,type:string,risk:string,description:string,priority:int>>>"


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON arrays of labelled texts."""
    return spark.read.schema(GROUND_TRUTH).json(path, multiLine=True).where("id IS NOT NULL")


def export_ground_truth(entries: DataFrame) -> DataFrame:
    """One JSON text for each entry, in the form that can be read again."""
    return entries.select(F.to_json(F.struct("id", "text", "annotations", "metadata")).alias("value"))


def manifest_items(body: Column) -> Column:
    """(id, url) of a manifest text; malformed items are left out."""
    items = F.from_json(body, MANIFEST)["dicts"]
    return F.filter(items, lambda d: d["id"].isNotNull() & d["url"].isNotNull())


def dictionary_entries(sources: DataFrame, body: str = "body") -> DataFrame:
    """Rows (source columns, pattern, type, risk, description, priority) of dictionary texts."""
    return sources.select("*", F.inline(F.from_json(body, DICTIONARY)["entries"])).where("pattern IS NOT NULL AND type IS NOT NULL")


class Loaded(NamedTuple):
    status: int
    text: str | None
    etag: str
    modified: float | str


def load_file(path: str, base_dir: str, max_bytes: int = 10_000_000, etag: str | None = None, modified: float | None = None) -> Loaded:
    """A regular file below ``base_dir``; 304 without text if the tag or the time is known."""
    real, base = Path(path).resolve(strict=True), Path(base_dir).resolve(strict=True)
    if base not in real.parents:
        raise PermissionError(f"{path} is outside {base_dir}")
    if not real.is_file():
        raise ValueError(f"{path} is no regular file")
    stat = real.stat()
    if stat.st_size > max_bytes:
        raise ValueError(f"{path} has more than {max_bytes} bytes")
    data = real.read_bytes()
    tag = hashlib.sha256(data).hexdigest()
    if tag == etag or (modified is not None and stat.st_mtime == modified):
        return Loaded(304, None, tag, stat.st_mtime)
    return Loaded(200, data.decode("utf-8"), tag, stat.st_mtime)


def load_url(url: str, etag: str | None = None, modified: str | None = None, timeout: float = 10.0, force: bool = False, allowed=None, max_bytes: int = 10_000_000) -> Loaded:
    """A conditional GET on the driver: 304 without text if the server says nothing changed.

    ``allowed(url)`` may veto an address; ``force`` asks past caches.
    """
    from urllib.error import HTTPError
    from urllib.parse import urlsplit
    from urllib.request import Request, urlopen

    if urlsplit(url).scheme not in ("http", "https") or (allowed is not None and not allowed(url)):
        raise PermissionError(f"{url} may not be loaded")
    headers = {} if force else {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
    if force:
        url += ("&" if "?" in url else "?") + f"_bust={time.time_ns()}"
    try:
        with urlopen(Request(url, headers=headers), timeout=timeout) as answer:  # noqa: S310
            data = answer.read(max_bytes + 1)
            if len(data) > max_bytes:
                raise ValueError(f"{url} has more than {max_bytes} bytes")
            return Loaded(200, data.decode("utf-8"), answer.headers.get("ETag") or hashlib.sha256(data).hexdigest(), answer.headers.get("Last-Modified") or "")
    except HTTPError as e:
        if e.code == 304:
            return Loaded(304, None, etag or "", modified or "")
        raise
