"""Personal data in whole texts: fixed patterns and a skip-chain conditional random field.

Base spans (email, ip, card, phone) are leftmost non-overlapping matches of fixed patterns;
failing ones are dropped and not tried again. All scans are linear in the text's length.

The field labels the white-space tokens that hold a digit, ``@`` or a spelt-out ``(at)``; other
tokens enter as context features only (there are no labels from which names could be learned).
Potentials:

* unary: hashed shape, prefix, length and neighbour-word features;
* chain: neighbouring nodes at most ``CHAIN_REACH`` characters apart;
* skip: each node and the previous one with the same normalised value (digits only when it
  has seven or more, else lower-cased letters and digits);
* similar: each node and the previous one whose value ends in the same six digits, or begins
  with the same mail name, and that is not the same. A value repeated n times adds n - 1 edges
  of a kind, never all pairs.

Nodes inside base spans are clamped to their kind. Damped loopy sum-product over all edges of
a batch of documents (documents are not connected) gives marginals; a free node whose entity
label reaches ``REPORT`` is added as a span of that kind with its outer punctuation trimmed.

All weights are fitted together, by gradients of the log-likelihood whose expectations are the
beliefs of the same message passing. Labels are base spans, and spans that the patterns miss:
each text with base spans is seen again with them disguised (``(at)`` for ``@``, ``[.]`` in
addresses, other separators in card numbers, no plus before phone numbers), by itself and behind
the text as it is. Phone matches with too many digits have no label, as a number may have run
into them. The fit takes at most ``sample_rows`` documents (smallest hash of the id, so it does
not depend on partitioning).

Null text counts as empty; an empty text has no spans. Repeated rows are each returned, equal
texts get equal spans, spans of equal start go by kind as listed. Extra columns are ignored (by
``redact`` kept), whatever their names; an empty table gives an empty result. A very long text
is handled whole: its nodes and at most three edges for each lie in one task's memory.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetext.llm.arrow_tools import map_kept
from sievetext.llm.sampling import hashed_share
from sievetext.llm.spans import Span, map_spans

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
MARK = re.compile(r"[0-9@]+|[(\[]at[)\]]", re.IGNORECASE)
#: What any text with a node holds, for the fit's sample.
MARKED = r"(?i)[0-9@]|[(\[]at[)\]]"
SPELT_AT = re.compile(r"@|[(\[]at[)\]]")
TOKEN_END = re.compile(r"\S*")
PUNCTUATION = " \t\n\r\"'`.,;:!?()[]{}<>|*#&$%"

FEATURES = 1 << 12
CHAIN_REACH = 24
#: Characters between two added tokens of a kind that are reported as one span.
JOIN_REACH = 3
ROUNDS, DAMPING, REPORT = 12, 0.3, 0.6
#: Gradient steps of the fit, and message rounds in each.
STEPS, FIT_ROUNDS = 150, 4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` is tried once: its local part is the run before it, after the last match."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at)):
            found.append((begin, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Groups of a dotted run are taken four at a time, as leftmost matching does."""
    found = []
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, begin = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                found.append((begin, end))
            begin = end + 1
    return found


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed, then start."""
    out = [("email", a, b, True, 1.0) for a, b in emails(text)] if "@" in text else []
    if not MARK.search(text):
        return out
    out += [("ip", a, b, True, 1.0) for a, b in addresses(text)]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end(), True, 1.0))
    if "+" in text:
        out += [("phone", m.start(), m.end(), True, 1.0) for m in PLUS.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


@dataclass
class Node:
    doc: int
    begin: int
    end: int
    value: str
    features: list[int]
    #: Label of the span it lies in, or -1 (FREE).
    clamp: int
    key: str
    similar: str


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def _shape(value: str) -> str:
    out = []
    for c in value[:64]:
        kind = "9" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def _neighbours(text: str, begin: int, end: int) -> tuple[str, str]:
    before = text[max(0, begin - 32) : begin].split()
    after = text[end : end + 32].split()
    return (before[-1].lower() if before else "^"), (after[0].lower() if after else "$")


def nodes_of(doc: int, text: str, base: list[Span]) -> list[Node]:
    """The tokens of a text that hold a digit or ``@``."""
    out: list[Node] = []
    spans = sorted((s[1], s[2], KINDS.index(s[0]) + 1) for s in base)
    last, k = 0, 0
    for m in MARK.finditer(text):
        if m.start() < last:
            continue
        begin = m.start()
        while begin > last and not text[begin - 1].isspace():
            begin -= 1
        end = last = TOKEN_END.match(text, m.end()).end()
        value = text[begin:end].strip(PUNCTUATION)
        if not value:
            continue
        begin = text.index(value, begin)
        while k < len(spans) and spans[k][1] <= begin:
            k += 1
        hit = k < len(spans) and spans[k][0] < begin + len(value)
        before, after = _neighbours(text, begin, begin + len(value))
        digits = NOT_DIGIT.sub("", value)
        names = ("bias", f"s:{_shape(value)}", f"l:{min(len(value), 40)}", f"d:{min(len(digits), 24)}", f"at:{value.count('@')}", f"dot:{min(value.count('.'), 6)}", f"1:{value[0] if not value[0].isalnum() else 'x'}", f"b:{before}", f"a:{after}")
        key = digits if len(digits) >= 7 else "".join(c for c in value.lower() if c.isalnum())
        name = SPELT_AT.split(value.lower(), maxsplit=1)
        similar = name[0] if len(name) > 1 else digits[-6:] if len(digits) >= 6 else ""
        out.append(Node(doc, begin, begin + len(value), value, [_bucket(n) for n in names], spans[k][2] if hit else -1, key, similar))
    return out


def edges_of(nodes: list[Node]) -> list[np.ndarray]:
    """Chain, skip and similar edges between node positions; at most three for each node."""
    chain, skip, similar, seen = [], [], [], {}
    for k, node in enumerate(nodes):
        if k and nodes[k - 1].doc == node.doc and node.begin - nodes[k - 1].end <= CHAIN_REACH:
            chain.append((k - 1, k))
        linked = set(chain[-1:])
        for edges, key in ((skip, node.key), (similar, node.similar)):
            if len(key) >= 4:
                place = (node.doc, edges is skip, key)
                if (at := seen.get(place)) is not None and (at, k) not in linked:
                    edges.append((at, k))
                    linked.add((at, k))
                seen[place] = k
    return [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip, similar)]


def propagate(score: np.ndarray, edges: list[np.ndarray], tables: np.ndarray, rounds: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Loopy sum-product: node beliefs, and each edge kind's beliefs summed over its edges."""
    n, m = score.shape
    edge = np.concatenate(edges)
    kind = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
    source, target = np.r_[edge[:, 0], edge[:, 1]], np.r_[edge[:, 1], edge[:, 0]]
    pair = np.exp(tables)
    both = np.concatenate([pair[kind], pair[kind].transpose(0, 2, 1)])
    back = np.r_[np.arange(len(edge)) + len(edge), np.arange(len(edge))]
    message = np.zeros((len(source), m))

    def total() -> np.ndarray:
        return score + np.stack([np.bincount(target, message[:, k], n) for k in range(m)], 1) if len(edge) else score

    for _ in range(rounds if len(edge) else 0):
        out = total()[source] - message[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.matmul(out[:, None, :], both)[:, 0] + 1e-300)
        message = DAMPING * message + (1 - DAMPING) * (new - new.max(1, keepdims=True))
    belief = total()
    belief = np.exp(belief - belief.max(1, keepdims=True))
    belief /= belief.sum(1, keepdims=True)
    sums, cavity = [], None
    if len(edge):
        cavity = total()[source] - message[back]
        cavity = np.exp(cavity - cavity.max(1, keepdims=True))
    for k in range(len(edges)):
        mine = np.flatnonzero(kind == k)
        joint = cavity[mine][:, :, None] * pair[k] * cavity[mine + len(edge)][:, None, :] if len(mine) else np.zeros((0, m, m))
        sums.append((joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)).sum(0))
    return belief, sums


@dataclass
class SkipChainCrf:
    """Fitted log-potentials; every array is small and of fixed size."""

    unary: np.ndarray
    #: Of chain, skip and similar edges.
    tables: np.ndarray

    def marginals(self, nodes: list[Node], kinds: tuple[bool, bool, bool] = (True, True, True)) -> np.ndarray:
        """Sum-product beliefs (nodes x labels) over the edge kinds asked for; base nodes are clamped."""
        score = self.unary[np.array([x.features for x in nodes])].sum(1)
        clamp = np.array([x.clamp for x in nodes])
        fixed = clamp >= 0
        score[fixed] = -30.0
        score[fixed, clamp[fixed]] = 0.0
        edges = [e if used else e[:0] for e, used in zip(edges_of(nodes), kinds)]
        return propagate(score - score.max(1, keepdims=True), edges, self.tables, ROUNDS)[0]


def _disguised(kind: str, value: str) -> str:
    """The same value in a form that the patterns miss."""
    if kind == "email":
        return value.replace("@", "(at)")
    if kind == "ip":
        return value.replace(".", "[.]")
    if kind == "phone":
        return value.removeprefix("+")
    return re.sub("[ -]", ".", value) if re.search("[ -]", value) else ".".join(value[k : k + 4] for k in range(0, len(value), 4))


def disguise(text: str, base: list[Span]) -> tuple[str, list[Span]]:
    """``text`` with its base spans disguised, and where they are now."""
    out, spans, at, size = [], [], 0, 0
    for kind, begin, end, _, score in sorted(base, key=lambda s: s[1]):
        if begin < at:
            continue
        new = _disguised(kind, text[begin:end])
        out += [text[at:begin], new]
        size += begin - at
        spans.append((kind, size, size + len(new), True, score))
        size += len(new)
        at = end
    return "".join([*out, text[at:]]), spans


def _doubtful(text: str) -> list[tuple[int, int]]:
    """Matches of the phone pattern that hold more digits than a number has."""
    return [m.span() for m in PLUS.finditer(text) if len(NOT_DIGIT.sub("", m[0])) > 15] if "+" in text else []


def _examples(texts: list[str]) -> tuple[list[Node], np.ndarray]:
    """Nodes with their spans as labels, and which of them have one."""
    nodes: list[Node] = []
    known: list[bool] = []

    def add(text: str, spans: list[Span]) -> None:
        found = nodes_of(len(nodes), text, spans)
        places = _doubtful(text)
        nodes.extend(found)
        known.extend(x.clamp >= 0 or not any(a < x.end and x.begin < b for a, b in places) for x in found)

    for text in texts:
        base = base_spans(text)
        add(text, base)
        if base:
            other, spans = disguise(text, base)
            add(other, spans)
            shift = len(text) + 1
            add(f"{text}\n{other}", base + [(k, a + shift, b + shift, x, y) for k, a, b, x, y in spans])
    return nodes, np.array(known, bool)


def fit(texts: list[str], steps: int = STEPS) -> SkipChainCrf:
    """All weights together, by AdaGrad on the likelihood under loopy beliefs; with no node at all they are zero."""
    nodes, known = _examples(texts)
    m = len(LABELS)
    model = SkipChainCrf(np.zeros((FEATURES, m)), np.zeros((3, m, m)))
    if not nodes:
        return model
    label = np.array([max(0, x.clamp) for x in nodes], np.int64)
    features = np.array([x.features for x in nodes])
    goal, edges = np.eye(m)[label], [e[known[e].all(1)] for e in edges_of(nodes)]
    seen = np.zeros((3, m, m))
    for k, e in enumerate(edges):
        np.add.at(seen[k], (label[e[:, 0]], label[e[:, 1]]), 1)
    squares = [np.full_like(w, 1e-8) for w in (model.unary, model.tables)]
    for _ in range(steps):
        belief, pairs = propagate(model.unary[features].sum(1), edges, model.tables, FIT_ROUNDS)
        slope = np.stack([np.bincount(features.ravel(), np.repeat(np.where(known, (belief - goal)[:, k], 0), features.shape[1]), FEATURES) for k in range(m)], 1) / len(nodes)
        slopes = (slope + 1e-5 * model.unary, (np.array(pairs) - seen) / len(nodes) + 1e-4 * model.tables)
        for w, g, q in zip((model.unary, model.tables), slopes, squares):
            q += g**2
            w -= 0.3 * g / np.sqrt(q)
    return model


def added_spans(model: SkipChainCrf, texts: list[str], base: list[list[Span]], kinds: tuple[bool, bool, bool] = (True, True, True)) -> list[list[Span]]:
    """Spans that the field adds; they overlap no base span."""
    nodes: list[Node] = []
    for doc, text in enumerate(texts):
        nodes += nodes_of(doc, text, base[doc])
    out: list[list[Span]] = [[] for _ in texts]
    if nodes:
        belief = model.marginals(nodes, kinds)
        for node, p in zip(nodes, belief):
            best = int(p.argmax())
            if node.clamp < 0 and best and p[best] >= REPORT:
                _extend(out[node.doc], (LABELS[best], node.begin, node.end, False, float(p[best])), base[node.doc])
    return out


def _extend(found: list[Span], span: Span, base: list[Span]) -> None:
    """Append ``span``, or join it to the last one if that is of its kind and next to it."""
    if found and found[-1][0] == span[0] and span[1] - found[-1][2] <= JOIN_REACH and not any(b[1] < span[1] and b[2] > found[-1][2] for b in base):
        span = (span[0], found[-1][1], span[2], False, min(found[-1][4], span[4]))
        found.pop()
    found.append(span)


def _finder(model: SkipChainCrf):
    def find(texts: list[str]) -> list[list[Span]]:
        base = [base_spans(t) for t in texts]
        more = added_spans(model, texts, base)
        return [sorted(a + b, key=lambda s: (KINDS.index(s[0]), s[1])) for a, b in zip(base, more)]

    return find


def fit_on(docs: DataFrame, id_column: str = "doc_id", text: str = "text", sample_rows: int = 1000) -> SkipChainCrf:
    """Fit on at most ``sample_rows`` documents that have nodes, those whose ids hash lowest."""
    marked = hashed_share(docs, F.col(id_column), sample_rows).where(F.col(text).rlike(MARKED)).select(F.xxhash64(F.col(id_column)).alias("h"), F.col(text).cast("string").alias("t"))
    return fit([r["t"] for r in marked.orderBy("h", "t").limit(sample_rows).collect()])


def detect(docs: DataFrame, keep: list[str], id_column: str = "doc_id", text: str = "text", model: SkipChainCrf | None = None) -> DataFrame:
    """``keep`` and ``spans`` (kind, start, end, base, score) of each row, by kind then start."""
    return map_spans(docs, _finder(model or fit_on(docs, id_column, text)), keep, text)


def redact(docs: DataFrame, text: str = "text", model: SkipChainCrf | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[KIND]``; ``n_chars`` follows if there."""
    model = model or fit_on(docs, text=text)
    find = _finder(model)
    sized = "n_chars" in docs.columns

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(0).to_pylist()
        clean = [None if t is None else replaced(t, s) for t, s in zip(texts, find([t or "" for t in texts]))]
        out = [pa.array(clean, pa.string())]
        if sized:
            out.append(pa.array([n if a == b else len(b) for n, a, b in zip(batch.column(1).to_pylist(), texts, clean)], batch.column(1).type))
        return out

    other = [c for c in docs.columns if c != text and not (sized and c == "n_chars")]
    inputs, made = [F.col(text).cast("string")], ["__text string"]
    if sized:
        inputs.append(F.col("n_chars"))
        made.append(f"__n_chars {docs.schema['n_chars'].dataType.simpleString()}")
    found = map_kept(docs, other, inputs, work, ", ".join(made), 512)
    named = {text: "__text", "n_chars": "__n_chars"} if sized else {text: "__text"}
    return found.select(*[F.col(f"`{named.get(c, c)}`").alias(c) for c in docs.columns])


def replaced(text: str, spans: list[Span]) -> str:
    """``text`` with each span, of overlapping ones the first, replaced by its kind."""
    out, at = [], 0
    for kind, begin, end, _, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
