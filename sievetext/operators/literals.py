"""Many literal words at once: every occurrence of every word of a large dictionary.

One automaton finds all words in one pass over a text, however many there are; it is built once
a task from the word list, which is broadcast up to ``MOST_BYTES`` (a longer one raises: split it).
Null texts have no hits. Words that lie inside others are found too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20
HITS = "array<struct<word:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("word", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def distinct_words(words: list[str]) -> list[str]:
    """In the order given, without blanks and repetitions."""
    return list(dict.fromkeys(w for w in words if w))


def find_literals(docs: DataFrame, words: list[str], keep: list[str], text: str = "text", ignore_case: bool = False) -> DataFrame:
    """``keep`` and ``hits`` (word, start, end; code points) of each text, by end, then longest first."""
    known = distinct_words([w.lower() for w in words] if ignore_case else words)
    if sum(len(w.encode()) for w in known) > MOST_BYTES:
        raise ValueError(f"the words have more than {MOST_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = [f"__kept{k}" for k in range(len(keep))]
    table = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in shared.value:
            automaton.add_word(w, w)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            rows = []
            for value in batch.column(len(names)):
                t = value.as_py()
                t = t.lower() if ignore_case and t else t
                found = automaton.iter(t) if t and len(automaton) else ()
                rows.append([{"word": w, "start": end + 1 - len(w), "end": end + 1} for end, w in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(rows, _ARROW)], [*names, "hits"])

    kinds = "".join(f"{n} {table.schema[n].dataType.simpleString()}, " for n in names)
    return table.mapInArrow(run, f"{kinds}hits {HITS}").toDF(*keep, "hits")


def top_matches(found: Column, k: int) -> Column:
    """The k guard matches of highest severity, then confidence."""
    rank = lambda m: F.when(m["severity"] == "critical", 4).when(m["severity"] == "high", 3).when(m["severity"] == "medium", 2).otherwise(1)
    order = lambda a, b: F.when(rank(a) != rank(b), rank(b) - rank(a)).when(a["confidence"] != b["confidence"], b["confidence"] - a["confidence"]).otherwise(a["index"] - b["index"])
    return F.slice(F.array_sort(found, order), 1, k)
