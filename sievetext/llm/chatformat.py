"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Nothing is known
of it but its outputs:

* successive prefixes of the turns are rendered, and consecutive outputs compared: what the
  new output adds is the turn's span; if the old output isn't a prefix of the new one, the
  template rewrites history and the turn is marked;
* within a turn, two probe texts tell which part of the span is the text and which the
  turn's frame (their common head and tail); where the frame differs with them or less than the
  text is there, two probes of its own length are tried, and a text that can't be placed whole
  is marked unlocated: its span is empty, and its turn is no part of the mask;
* for a conversation whose history was rewritten, spans are located in the full rendering by
  probing each turn in place.

The loss mask is the list of spans that assistant texts take in the full rendering.

``framed`` is the template of the query. It marks turns and escapes control strings inside
texts and roles with U+0010, reversibly; ``read_back`` parses its output alone.

A conversation's rows are ordered by turn (null first, ties by role and text); null roles and
texts count as empty. A row with a null conversation id is a conversation by itself. Rows stream
through sorted partitions, so a task holds one conversation at a time. By the method, a
conversation of n turns is rendered 3 n times, so its time grows with n times its length: with
``framed`` and turns of 40 characters, 2,000 turns take 0.5 s and 8,000 turns 13 s. Repeated rows
are turns of their own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
ESCAPE = "\x10"
#: Texts that differ at both ends, of characters that templates don't use.
PROBES = ("\ue000a\ue001", "\ue002b\ue003")
#: Fixed control strings of public chat templates; none may appear unescaped inside a text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL) + r"|<\|")
_ESCAPED = re.compile(f"{ESCAPE}({ESCAPE}?)")
START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean,rewrites:boolean,located:boolean>>"


def escape(text: str) -> str:
    """``text`` without control strings: each gets an escape after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Framed:
    """Each turn as a start mark, the role's length and the role, the text, and an end mark.

    The last two renderings are kept, as successive prefixes only add to them.
    """

    def __init__(self) -> None:
        self.kept: list[tuple[list[Turn], str]] = [([], "")] * 2

    def __call__(self, turns: list[Turn]) -> str:
        if not turns:
            return ""
        head = turns[:-1]
        known = next((out for prefix, out in self.kept if len(prefix) == len(head) and prefix == head), None)
        if known is None:
            return "".join(map(self._rendered, turns))
        out = known + self._rendered(turns[-1])
        if len(self.kept[1][0]) < len(turns) or self.kept[1][0][:-1] != head:
            self.kept = [(head, known), (list(turns), out)]
        return out

    def _rendered(self, turn: Turn) -> str:
        role = escape(turn[0])
        return f"{START}{len(role)}:{role}\n{escape(turn[1])}{END}"


framed = Framed()


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of ``framed``."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        colon = formatted.index(":", at)
        begin = colon + 1
        middle = begin + int(formatted[at + len(START) : colon])
        end = formatted.index(END, middle)
        turns.append((unescape(formatted[begin:middle]), unescape(formatted[middle + 1 : end])))
        at = end + len(END)
    return turns


def _common(a: str, b: str) -> int:
    """Length of the common head, by comparing whole slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _framed_by(render: Template, turns: list[Turn], k: int, whole: str, probes: tuple[str, str], known: str) -> tuple[int, int] | None:
    """Where turn k's text lies in ``whole``, if both probes in its place leave the same frame.

    ``whole`` begins with ``known``; if the probes' outputs do too, only the rest is compared.
    """
    kept = turns[k]
    outputs = []
    for probe in probes:
        turns[k] = (kept[0], probe)
        outputs.append(render(turns))
    turns[k] = kept
    skip = len(known) if all(x.startswith(known) for x in outputs) else 0
    one, two, rest = (x[skip:] for x in (*outputs, whole))
    head = _common(one, two)
    tail = _common(one[head:][::-1], two[head:][::-1])
    end = len(rest) - tail
    if head > end or one[head : len(one) - tail] != probes[0] or one[:head] != rest[:head] or one[len(one) - tail :] != rest[end:]:
        return None
    return skip + head, skip + end


def _probed(render: Template, turns: list[Turn], k: int, whole: str, known: str = "") -> tuple[int, int, bool]:
    """Where turn k's text lies in ``whole``, the rendering of ``turns``, and whether that is known."""
    size = len(turns[k][1])
    found = _framed_by(render, turns, k, whole, PROBES, known)
    if found is None and not size:
        return len(whole), len(whole), True
    if found is None or found[1] - found[0] < size:  # the frame varies, or the text is cut
        found = _framed_by(render, turns, k, whole, (PROBES[0][0] * size, PROBES[1][0] * size), known)
    return (*found, True) if found else (len(whole), len(whole), False)


def locate(render: Template, turns: list[Turn]) -> tuple[str, list[dict]]:
    """The full rendering, and for each turn its span, its text's span, and whether it rewrote and was located."""
    before, spans, prefix = render([]), [], []
    for role, text in turns:
        prefix.append((role, text))
        now = render(prefix)
        rewrites = not now.startswith(before)
        begin = _common(before, now) if rewrites else len(before)
        low, high, located = _probed(render, prefix, len(prefix) - 1, now, "" if rewrites else before)
        spans.append({"role": role, "start": begin, "end": len(now), "text_start": low, "text_end": high, "loss": role == "assistant" and located, "rewrites": rewrites, "located": located})
        before = now
    if any(s["rewrites"] for s in spans):
        for k, s in enumerate(spans):
            s["text_start"], s["text_end"], s["located"] = _probed(render, prefix, k, before)
            s["loss"] = s["role"] == "assistant" and s["located"]
            s["start"], s["end"] = min(s["start"], s["text_start"]), max(s["text_end"], min(s["end"], len(before)))
    return before, spans


def conversations_of(rows: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """The rows a formatter takes: one sorted run for each conversation in each partition."""
    conv = F.col(id_column).cast("long")
    lone = F.when(conv.isNull(), F.monotonically_increasing_id())
    columns = [conv.alias("conv_id"), lone.alias("lone"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string"), F.col("text").cast("string")]
    return rows.select(*columns).repartition("conv_id", "lone").sortWithinPartitions("conv_id", "lone", "turn", "role", "text")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    held: list[Turn] = []
    last: tuple | None = None
    for batch in batches:
        for conv, lone, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "lone", "role", "text"))):
            if held and (conv, lone) != last:
                yield last[0], held
                held = []
            held.append((role or "", text or ""))
            last = (conv, lone)
    if held:
        yield last[0], held


def format_conversations(rows: DataFrame, render: Template = framed, id_column: str = "conv_id") -> DataFrame:
    """conv_id, formatted, turns: each turn's span, its text's span, loss and rewrite marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int32()) for n in ("start", "end", "text_start", "text_end")), *((n, pa.bool_()) for n in ("loss", "rewrites", "located"))]))
        ids, texts, spans, size = [], [], [], 0
        for conv, turns in _runs(batches):
            text, found = locate(render, turns)
            ids.append(conv)
            texts.append(text)
            spans.append(found)
            size += len(text)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts), pa.array(spans, kind)], ["conv_id", "formatted", "turns"])
                ids, texts, spans, size = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts), pa.array(spans, kind)], ["conv_id", "formatted", "turns"])

    return conversations_of(rows, id_column).mapInArrow(run, f"conv_id long, formatted string, turns {TURNS}")


def verified(formatted: DataFrame) -> DataFrame:
    """Digests read back from outputs of ``framed``: turns from the text, loss from the mask."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "turns"))):
                turns = read_back(text)
                all_turns = hashlib.sha256()
                for role, said in turns:
                    all_turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["loss"])
                rows.append((conv, len(turns), all_turns.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text), sum(s["rewrites"] for s in spans), sum(not s["located"] for s in spans)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites", "n_unlocated"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long, n_unlocated long")


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, chr(16), chr(16) || chr(16))"
    for c in ("<|", *(c for c in CONTROL if not c.startswith("<|"))):
        out = f"replace({out}, '{c}', '{c[0]}' || chr(16) || '{c[1:]}')"
    return out


#: DuckDB SQL for the query over ``conversations`` and the conversation of control strings.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), parts AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    length({_escaped_sql("role")}) AS role_size, length({_escaped_sql("text")}) AS text_size
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length(CAST(role_size AS VARCHAR)) + role_size + text_size) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_rewrites, CAST(0 AS BIGINT) AS n_unlocated
FROM parts GROUP BY conv_id, lone
"""
