"""Prompt-injection guard: match, score, segment by trust, sanitise; all column expressions.

A null text is unsafe with risk 100; a blank one is safe with risk 0. Every match counts; a
caller who wants limits sets ``Guard.each`` and ``Guard.most``, and ``truncated`` then tells which
texts had more. The quick scan stops early by design: it counts up to ten matches a pattern.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetext.functions import text as T
from sievetext.functions.regexes import let, spans, to_java
from sievetext.operators.injection import MARKERS, PATTERNS, RULES, TRUST_FACTOR, TRUST_ORDER, Pattern, Rule, ordered

MATCH = "struct<pattern:string,index:int,match:string,severity:string,category:string,confidence:int>"
NO_MATCH = f"cast(array() as array<{MATCH}>)"
SEGMENT = "struct<content:string,trust:string,risk:int,source:string,original_trust:string>"
NO_SEGMENT = f"cast(array() as array<{SEGMENT}>)"
RISK_WEIGHT = {"low": 20, "medium": 45, "high": 85, "critical": 100}
QUICK_WEIGHT = {"low": 20, "medium": 45, "high": 75, "critical": 95}


@dataclass(frozen=True)
class Guard:
    """Patterns, rules and threshold of a scan; custom ones come before the built-in ones."""

    threshold: float = 60
    sanitize: bool = True
    separate: bool = True
    patterns: tuple[Pattern, ...] = PATTERNS
    custom_rules: tuple[Rule, ...] = ()
    #: Most matches a pattern, and matches after which no further pattern is tried; none given: all.
    each: int | None = None
    most: int | None = None


def _found(content: Column, low: Column, p: Pattern) -> Column:
    def shaped(m: Column) -> Column:
        return F.struct(
            F.lit(p.id).alias("pattern"), (F.instr(content, m) - 1).alias("index"), m.alias("match"), F.lit(p.severity).alias("severity"), F.lit(p.category).alias("category"), F.lit(p.weight).alias("confidence")
        )

    found = F.transform(F.regexp_extract_all(content, F.lit(p.java), F.lit(0)), shaped)
    if not p.needs:
        return found
    return F.when(reduce(or_, (low.contains(x) for x in p.needs)), found).otherwise(F.expr(NO_MATCH))


def matches(content: Column, patterns: tuple[Pattern, ...] = PATTERNS, severities: tuple[str, ...] | None = None, most: int | None = None, each: int | None = None, low: Column | None = None) -> Column:
    """Matches by pattern priority, at most ``each`` a pattern; no more patterns after ``most``.

    Equal match texts share the index of the first. The limit is tested between patterns, so a
    pattern's matches stay together. ``low`` is the text in lower case, where that is at hand.
    """

    def tried(low: Column) -> Column:
        groups = [_found(content, low, p) for p in ordered(patterns, severities)]
        if not groups:
            return F.expr(NO_MATCH)
        if each:
            groups = [F.slice(g, 1, each) for g in groups]
        if not most:
            return F.concat(*groups)
        return F.aggregate(F.array(*groups), F.expr(NO_MATCH), lambda kept, more: F.when(F.size(kept) >= most, kept).otherwise(F.concat(kept, more)))

    return let(F.lower(content), tried) if low is None else tried(low)


def _weight(table: dict[str, int], severity: Column) -> Column:
    out = F.lit(0)
    for name, value in table.items():
        out = F.when(severity == name, value).otherwise(out)
    return out


def risk(found: Column) -> Column:
    """Severity weights by confidence, a tenth more if there are several; 0 to 100."""
    total = F.aggregate(found, F.lit(0.0), lambda s, m: s + _weight(RISK_WEIGHT, m["severity"]) * (m["confidence"] / 100))
    return F.least(F.lit(100.0), F.when(F.size(found) > 1, total * 1.1).otherwise(total))


def trust_adjusted(value: Column, trust: str) -> Column:
    return F.least(F.lit(100.0), value * TRUST_FACTOR[trust])


def quick_risk(found: Column) -> Column:
    """The quick scan's score, not yet cut at 100."""

    def one(m: Column) -> Column:
        w = _weight(QUICK_WEIGHT, m["severity"]) * (m["confidence"] / 100)
        return F.when(m["severity"] == "high", F.greatest(w, F.lit(60.0))).when(m["severity"] == "critical", F.greatest(w, F.lit(80.0))).otherwise(w)

    total = F.aggregate(found, F.lit(0.0), lambda s, m: s + one(m))
    return F.when(F.size(found) > 1, total * F.least(F.lit(1.2), 1 + F.size(found) * 0.1)).otherwise(total)


def quick_scan(content: Column, guard: Guard = Guard()) -> Column:
    """(safe, risk): critical patterns, then high, then medium if the score is unclear."""
    t = guard.threshold

    def scored(found: Column) -> Column:
        return let(found, lambda f: F.struct(f.alias("m"), quick_risk(f).alias("r")))

    def run(c: Column, low: Column) -> Column:
        def more(s: Column, condition: Column, severity: str, most: int) -> Column:
            return F.when(condition, scored(F.concat(s["m"], matches(c, guard.patterns, (severity,), most, 10, low)))).otherwise(s)

        one = scored(F.slice(matches(c, guard.patterns, ("critical",), 5, 10, low), 1, 1))
        two = let(one, lambda s: more(s, (s["r"] < t) & ((F.size(s["m"]) == 0) | (s["r"] < t * 0.5)), "high", 10))
        three = let(two, lambda s: more(s, (s["r"] > t * 0.3) & (s["r"] < t * 0.8), "medium", 5))
        return let(three, lambda s: F.struct((s["r"] < t).alias("safe"), F.least(F.lit(100.0), s["r"]).alias("risk")))

    bad = F.struct(F.lit(False).alias("safe"), F.lit(100.0).alias("risk"))
    return F.when(content.isNull(), bad).otherwise(let(T.normalize_encoding(content), lambda c: let(F.lower(c), lambda low: run(c, low))))


def apply_rule(content: Column, rule: Rule) -> Column:
    """One sanitising rule on every match of its pattern."""
    if rule.action == "remove":
        return F.regexp_replace(content, rule.java, "")
    if rule.action == "replace":
        new = "[REDACTED]" if rule.replacement is None else rule.replacement
        return F.regexp_replace(content, rule.java, new.replace("\\", "\\\\").replace("$", "\\$"))
    if rule.action == "quote":
        return F.regexp_replace(content, rule.java, '"$0"')
    if rule.action != "neutralize":
        return content
    found, gaps = F.regexp_extract_all(content, F.lit(rule.java), F.lit(0)), F.split(content, rule.java, -1)
    label = lambda m: F.concat(F.lit("[NEUTRALIZED: "), F.substring(m, F.lit(1), F.lit(20)), F.when(F.length(m) > 20, "...").otherwise(""), F.lit("]"))
    return F.array_join(F.flatten(F.zip_with(gaps, found, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, label(m))))), "")


def sanitize(content: Column, found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """For each match the first rule of its category, then all rules in order, then cleanup."""

    def prepass(s: Column, m: Column) -> Column:
        out = s
        for category in dict.fromkeys(r.category for r in rules):
            rule = next(r for r in rules if r.category == category)
            out = F.when(m["category"] == category, apply_rule(s, rule)).otherwise(out)
        return out

    out = F.aggregate(found, content, prepass)

    def passes(c: Column) -> Column:
        for rule in rules:
            c = apply_rule(c, rule)
        return T.final_cleanup(c)

    return let(out, passes)


#: Visible labels of the three marker families, in order.
MARKER_LABELS = ("[SYSTEM_MARKER]", "[INSTRUCTION_MARKER]", "[CHAT_MARKER]")


def neutralize_markers(content: Column) -> Column:
    """Context markers as visible labels."""
    for rule, label in zip(RULES, MARKER_LABELS):
        content = F.regexp_replace(content, rule.java, label)
    return content


def remove_instructions(content: Column) -> Column:
    """Override requests and announced new instructions taken out."""
    announced = next(p for p in PATTERNS if p.id == "new_instruction")
    for pattern in [r.java for r in RULES[3:6]] + [announced.java]:
        content = F.regexp_replace(content, pattern, "[INSTRUCTION_REMOVED]")
    return content


def safe_preview(content: Column, most: int = 100) -> Column:
    """The sanitised text, cut at ``most`` characters with dots."""
    clean = sanitize(content, F.expr(NO_MATCH))
    return let(clean, lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(c))


def validate_sanitized(content: Column) -> Column:
    """(safe, issues): what a sanitised text must not hold any more."""
    groups = (("context markers remain", RULES[:3]), ("instruction overrides remain", RULES[3:6]), ("code execution requests remain", RULES[6:8]))
    issues = F.array_compact(F.array(*[F.when(reduce(or_, (content.rlike(r.java) for r in rules)), name) for name, rules in groups]))
    return F.struct((F.size(issues) == 0).alias("safe"), issues.alias("issues"))


def valid_segments(parts: Column) -> Column:
    """Every segment has content, a known trust and a risk in 0..100."""
    return F.forall(parts, lambda s: (F.length(s["content"]) > 0) & s["trust"].isin(*TRUST_ORDER) & s["risk"].between(0, 100))


def segments(content: Column, trust: str = "user") -> Column:
    """The text cut at trust markers; a marker is itself an untrusted segment of risk 80."""

    def marked(k: int, level: str):
        return lambda s: F.struct(s["start"].alias("index"), F.lit(k).alias("k"), F.length(s["value"]).alias("size"), F.lit(level).alias("trust"), s["value"].alias("marker"))

    marks = [F.transform(spans(content, to_java(pattern, flags)), marked(k, level)) for k, (pattern, flags, level) in enumerate(MARKERS)]
    order = F.array_sort(F.concat(*marks))

    def made(text: Column, level: Column, value: int, source: str, original: Column) -> Column:
        return F.struct(text.alias("content"), level.alias("trust"), F.lit(value).alias("risk"), F.lit(source).alias("source"), original.alias("original_trust"))

    none = F.lit(None).cast("string")

    def added(out: Column, text: Column, level: Column, source: str = "segmentation") -> Column:
        return let(T.trim(text), lambda t: F.when(t != "", F.concat(out, F.array(made(t, level, 0, source, none)))).otherwise(out))

    def step(s: Column, m: Column) -> Column:
        gap = F.when(m["index"] > s["at"], F.substring(content, s["at"] + 1, m["index"] - s["at"])).otherwise("")
        out = F.concat(added(s["out"], gap, s["trust"]), F.array(made(m["marker"], F.lit("untrusted"), 80, "context_marker", m["trust"])))
        return F.struct((m["index"] + m["size"]).alias("at"), m["trust"].alias("trust"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(trust).alias("trust"), F.expr(NO_SEGMENT).alias("out"))
    finish = lambda s: added(s["out"], F.substring(content, s["at"] + 1, F.length(content)), s["trust"])
    return F.when(F.size(order) == 0, added(F.expr(NO_SEGMENT), content, F.lit(trust), "single_segment")).otherwise(F.aggregate(order, start, step, finish))


def merge_segments(parts: Column) -> Column:
    """Neighbours of one trust and source with risk under 50 become one."""

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        same = (last["trust"] == s["trust"]) & (last["risk"] < 50) & (s["risk"] < 50) & (last["source"].eqNullSafe(s["source"]))
        joined = s.withField("content", F.concat_ws(" ", last["content"], s["content"])).withField("risk", F.greatest(last["risk"], s["risk"]))
        return F.when((F.size(kept) > 0) & same, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(joined))).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(parts, F.expr(NO_SEGMENT), step)


def trust_mixing(parts: Column) -> Column:
    """(suspicious, reasons, increase) of segments that mix levels of trust."""
    levels = F.transform(parts, lambda s: s["trust"])
    rank = F.transform(levels, lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in TRUST_ORDER.items() for v in kv]), x))
    up = F.exists(F.zip_with(rank, F.slice(rank, 2, F.greatest(F.size(rank) - 1, F.lit(0))), lambda a, b: b < a), lambda x: F.coalesce(x, F.lit(False)))
    checks = (
        (F.array_contains(levels, "system") & F.array_contains(levels, "untrusted"), "System and untrusted content mixed", 30),
        (F.size(F.array_distinct(levels)) > 3, "Too many trust levels in single input", 20),
        (F.exists(parts, lambda s: (s["source"] == "context_marker") & (s["risk"] > 50)), "Context markers detected", 40),
        ((F.size(parts) > 1) & up, "Trust escalation attempt detected", 25),
    )
    reasons = F.array_compact(F.array(*[F.when(c, why) for c, why, _ in checks]))
    increase = sum((F.when(c, n).otherwise(0) for c, _, n in checks), F.lit(0))
    return F.struct((F.size(reasons) > 0).alias("suspicious"), reasons.alias("reasons"), F.least(F.lit(100), increase).alias("risk_increase"))


def threat_level(value: Column) -> Column:
    return F.when(value > 80, "critical").when(value > 60, "high").when(value > 40, "medium").when(value > 20, "low").otherwise("none")


def scan(docs: DataFrame, guard: Guard = Guard(), trust: str = "user", text: str = "text") -> DataFrame:
    """``docs`` with matches, truncated, segments, risk, safe and sanitized."""
    blank = F.coalesce(T.is_blank(F.col(text)), F.lit(False))
    usable = F.col(text).isNotNull() & ~blank
    out = docs.withColumn("__c", F.when(usable, T.normalize_encoding(F.col(text))))
    rules = (*guard.custom_rules, *RULES)
    out = out.withColumn("__all", F.when(usable, matches(F.col("__c"), guard.patterns)).otherwise(F.expr(NO_MATCH)))
    if guard.each or guard.most:
        out = out.withColumn("matches", F.when(usable, matches(F.col("__c"), guard.patterns, None, guard.most, guard.each)).otherwise(F.expr(NO_MATCH)))
    else:
        out = out.withColumn("matches", F.col("__all"))
    out = out.withColumn("truncated", F.size("matches") < F.size("__all"))
    whole = F.array(F.struct(F.col("__c").alias("content"), F.lit(trust).alias("trust"), F.lit(0).alias("risk"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("original_trust")))
    out = out.withColumn("segments", F.when(usable, merge_segments(segments(F.col("__c"), trust)) if guard.separate else whole).otherwise(F.expr(NO_SEGMENT)))
    score = F.when(F.col(text).isNull(), 100.0).when(blank, 0.0).otherwise(trust_adjusted(risk(F.col("matches")), trust))
    out = out.withColumn("risk", score).withColumn("safe", F.col(text).isNotNull() & (F.col("risk") < guard.threshold))
    clean = sanitize(F.col("__c"), F.col("matches"), rules) if guard.sanitize else F.col("__c")
    return out.withColumn("sanitized", F.when(usable, clean).otherwise(F.col(text))).drop("__c", "__all")
