"""Secrets in whole texts: fixed patterns, and strings that their surroundings don't explain.

Base spans are leftmost non-overlapping matches of three patterns; a match that fails its
length test is dropped and its characters are not tried again.

The identifier dictionary is learned from the corpus: every identifier (words joined by
``_``, ``.`` or ``-``, or in camel case) of every whole text is counted, and those that save the
most (occurrences x length) fill ``DICTIONARY_BYTES`` beside a few fixed ones. Strings with
digits inside are no identifiers, so a secret that many documents repeat does not enter.

A string's novelty is the size of its zstandard frame, primed with that dictionary and with the
text around it (its own copies taken out), less that of an empty frame, for each character.
Identifiers and repeated prose are found in the dictionary and cost little; random strings cost
about a byte a character. It is the score of every span: of a base span's value, which stays
whatever its score, and of the spans of kind ``novel``. These are runs of at least ``SHORTEST``
token characters, with letters and with digits or changing case, within ``REACH`` characters
after a sensitive word, clear of base spans, from ``NOVEL`` bytes a character on. A run is cut
behind each ``=`` that is no padding, and its parts are candidates; for a part, a sensitive word
within the run before it counts too (``aws_secret_access_key=...``). If no part is reported, the
run is measured whole.

Null text counts as empty; an empty text has no spans. Repeated rows are each returned,
equal texts get equal spans, ties in start go by kind as listed. Extra columns are ignored,
whatever their names; an empty table gives an empty result. Time and memory are linear in the
text's length, which a task holds whole.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetext.llm.spans import Span, map_spans

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 32 or more are the same spans as all runs with the shorter ones dropped.
HEX = re.compile(r"[0-9a-f]{32,}")

CONTEXT_WORDS = ("access", "apikey", "api_key", "auth", "bearer", "credential", "passphrase", "passw", "private", "pwd", "secret", "signature", "token", "key")
CONTEXT = re.compile("|".join(CONTEXT_WORDS), re.IGNORECASE | re.ASCII)
SHORTEST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=~.-]{{{SHORTEST},}}")
#: Parts of a run; ``=`` stays where it is padding.
PART = re.compile(rf"[A-Za-z0-9+/_~.-]{{{SHORTEST},}}(?:=+$)?")
CASES = re.compile(r"[a-z][A-Z]")
REACH, AROUND, NOVEL = 48, 512, 0.75
LEVEL = 3
#: Words joined by separators, or camel case.
IDENTIFIER = r"(?<![A-Za-z0-9_])(?:[A-Za-z]{2,16}(?:[_.-][A-Za-z]{2,16})+|[a-z]{2,16}(?:[A-Z][a-z]{1,16})+)(?![A-Za-z0-9_])"
DICTIONARY_BYTES = 1 << 14
#: Fixed words that open the identifier dictionary.
IDENTIFIERS = (
    "access_token refresh_token authorization bearer client_id client_secret api_key apikey private_key public_key "
    "username password passphrase credential signature certificate configuration environment production development "
    "localhost example.com http https www database connection string integer boolean function return import export "
    "default application session request response header content-type timestamp identifier description version "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"
).encode()
_EMPTY = len(zstandard.ZstdCompressor(level=LEVEL).compress(b""))


def learned(docs: DataFrame, text: str = "text", most: int = DICTIONARY_BYTES) -> bytes:
    """Identifiers of all texts, the most saving ones last (nearest to what is compressed)."""
    found = docs.select(F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(IDENTIFIER), F.lit(0))).alias("word"))
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = counts.orderBy(F.desc(F.col("n") * F.length("word")), "word").limit(most // 6).collect()
    words, size = [], 0
    for r in top:
        size += len(r["word"]) + 1
        if size > most:
            break
        words.append(r["word"])
    return " ".join([*words[::-1], ""]).encode()


def novelty(candidate: str, around: str, dictionary: bytes = b"") -> float:
    """Marginal compressed bytes a character, given the dictionary and the surrounding text."""
    if not candidate:
        return 0.0
    context = IDENTIFIERS + b" " + dictionary + around.replace(candidate, " ").encode("utf-8", "surrogatepass")
    primed = zstandard.ZstdCompressionDict(context, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frame = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=True).compress(candidate.encode())
    return (len(frame) - _EMPTY) / len(candidate)


def _measured(text: str, begin: int, end: int, dictionary: bytes) -> float:
    return novelty(text[begin:end], text[max(0, begin - AROUND) : begin] + " " + text[end : end + AROUND], dictionary)


def base_spans(text: str, dictionary: bytes = b"") -> list[Span]:
    found: list[Span] = []
    low = text.lower()

    def add(kind: str, m: re.Match, group: int = 0) -> None:
        found.append((kind, m.start(), m.end(), True, _measured(text, *m.span(group), dictionary)))

    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                add("assign", m, 2)
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 16:
                add("access", m)
    for m in HEX.finditer(text):
        add("hex", m)
    return found


def novel_spans(text: str, base: list[Span], dictionary: bytes = b"") -> list[Span]:
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    ends = [m.end() for m in CONTEXT.finditer(text)]
    taken = sorted((s[1], s[2]) for s in base)
    found, k, t = [], 0, 0
    for m in CANDIDATE.finditer(text):
        run, run_end = m.span()
        while k < len(ends) and ends[k] <= run:
            k += 1
        while t < len(taken) and taken[t][1] <= run:
            t += 1
        places = [(run, run_end)]
        if "=" in m[0].rstrip("="):
            places = [(run + p.start(), run + p.end()) for p in PART.finditer(m[0])] + places
        word, base_span, known = k, t, len(found)
        for begin, end in places:
            if end - begin == run_end - run:  # the whole run
                if len(found) > known:
                    break
                word, base_span = k, t
            while word < len(ends) and ends[word] <= begin:
                word += 1
            if word == 0 or run - ends[word - 1] > REACH:
                continue
            while base_span < len(taken) and taken[base_span][1] <= begin:
                base_span += 1
            if base_span < len(taken) and taken[base_span][0] < end:
                continue
            value = text[begin:end]
            digits = any(c.isdigit() for c in value)
            if not any(c.isalpha() for c in value) or not (digits or len(CASES.findall(value)) > 2):
                continue
            score = _measured(text, begin, end, dictionary)
            if score >= NOVEL:
                found.append(("novel", begin, end, False, score))
    return found


def find_secrets(texts: list[str], dictionary: bytes = b"") -> list[list[Span]]:
    out = []
    for text in texts:
        base = base_spans(text, dictionary)
        out.append(sorted(base + novel_spans(text, base, dictionary), key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


def scan_secrets(docs: DataFrame, keep: list[str], text: str = "text", dictionary: bytes | None = None) -> DataFrame:
    """``keep`` and ``spans`` (kind, start, end, base, score) of each row, by start then kind.

    The dictionary is learned from ``docs`` unless one is given.
    """
    known = learned(docs, text) if dictionary is None else dictionary
    return map_spans(docs, lambda texts: find_secrets(texts, known), keep, text)
