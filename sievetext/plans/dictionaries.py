"""Dictionaries of patterns: compiling to detectors, and reloading between micro-batches."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetext.functions.regexes import to_java
from sievetext.operators.detectors import Detector
from sievetext.operators.pii import Policy
from sievetext.sources.tables import dictionary_entries

MOST_ENTRIES = 10_000
LOG = logging.getLogger(__name__)


def confidence(pattern: str, risk: str) -> float:
    """By how specific a pattern looks."""
    return min(0.99, 0.8 + 0.1 * (len(pattern) > 20) + 0.05 * (r"\d{" in pattern) + 0.05 * (len(pattern) >= 8) + {"high": 0.1, "low": -0.1}.get(risk, 0))


def compile_entries(rows: list) -> tuple[Detector, ...]:
    """Detectors of dictionary rows; patterns that don't compile are left out, all others kept."""
    out = []
    for r in rows:
        try:
            re.compile(r["pattern"])
        except re.error:
            continue
        risk = r["risk"] or "medium"
        out.append(Detector(r["type"], to_java(r["pattern"], "i"), risk, 0 if r["priority"] is None else r["priority"], confidence(r["pattern"], risk)))
    return tuple(out)


def compile_dictionary(entries: DataFrame) -> tuple[Detector, ...]:
    """Detectors of a dictionary table, which is small by contract and checked to be."""
    rows = entries.select("pattern", "type", "risk", "priority").orderBy("type", "pattern").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a dictionary may hold {MOST_ENTRIES} entries")
    return compile_entries(rows)


@dataclass
class DictionaryReloader:
    """Recompiles when the control table's newest version changes; bad loads keep the old set.

    The control table holds (source_id, version, body), body being dictionary JSON. A failed load
    is logged and counted; the next is tried after ``wait`` seconds, twice as long after each
    further failure, up to ``longest``. The first load must succeed.
    """

    read_control: Callable[[SparkSession], DataFrame]
    policy: Policy = field(default_factory=Policy)
    version: int | None = None
    loads: int = 0
    failures: int = 0
    wait: float = 1.0
    longest: float = 300.0
    clock: Callable[[], float] = time.monotonic
    _next: float = 0.0

    def current(self, spark: SparkSession) -> Policy:
        if self.failures and self.clock() < self._next:
            return self.policy
        try:
            control = self.read_control(spark)
            newest = control.agg(F.max("version")).first()[0]
            if newest != self.version:
                latest = control.withColumn("__n", F.max("version").over(_by_source())).where("version = __n").drop("__n")
                self.policy = replace(self.policy, detectors=compile_dictionary(dictionary_entries(latest)))
                self.version, self.loads = newest, self.loads + 1
            self.failures = 0
        except Exception:
            if self.version is None:
                raise
            self.failures += 1
            pause = min(self.longest, self.wait * 2 ** (self.failures - 1))
            self._next = self.clock() + pause
            LOG.warning("dictionary load failed, kept version %s, next try in %s s", self.version, pause, exc_info=True)
        return self.policy


def _by_source():
    from pyspark.sql import Window

    return Window.partitionBy("source_id")


def removed_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources of the old manifest that the new one lacks."""
    return old.join(new.select("source_id"), "source_id", "left_anti")
