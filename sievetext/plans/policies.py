"""Guard policies: validation, merging, templates, JSON; and pattern builders."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from sievetext.operators.guard import Guard
from sievetext.operators.injection import PATTERNS, Pattern, Rule


@dataclass(frozen=True)
class GuardPolicy:
    name: str
    patterns: tuple[Pattern, ...] = ()
    rules: tuple[Rule, ...] = ()
    threshold: float = 60
    sanitize: bool = True
    description: str = ""
    tags: tuple[str, ...] = field(default=())

    def guard(self) -> Guard:
        return Guard(threshold=self.threshold, sanitize=self.sanitize, patterns=PATTERNS + self.patterns, custom_rules=self.rules)


def validate(policy: GuardPolicy) -> tuple[list[str], list[str]]:
    """(errors, warnings)."""
    errors, warnings = [], []
    if not policy.name.strip():
        errors.append("a policy needs a name")
    if not 0 <= policy.threshold <= 100:
        errors.append("the threshold must lie in 0..100")
    seen: set[str] = set()
    for p in policy.patterns:
        if not p.id:
            errors.append("a pattern needs an id")
        if p.id in seen:
            warnings.append(f"pattern id {p.id} repeats")
        seen.add(p.id)
        if not 0 <= p.weight <= 100:
            errors.append(f"pattern {p.id}: the weight must lie in 0..100")
        try:
            re.compile(p.pattern)
        except re.error as e:
            errors.append(f"pattern {p.id}: {e}")
    for r in policy.rules:
        if r.action == "replace" and r.replacement is None:
            warnings.append(f"rule {r.pattern!r} has no replacement")
    return errors, warnings


def merge(name: str, policies: list[GuardPolicy]) -> GuardPolicy:
    """Distinct patterns by id and rules by pattern and action, first wins; lowest threshold."""
    patterns = {p.id: p for q in reversed(policies) for p in reversed(q.patterns)}
    rules = {(r.pattern, r.action): r for q in reversed(policies) for r in reversed(q.rules)}
    order = list(dict.fromkeys(p.id for q in policies for p in q.patterns))
    rule_order = list(dict.fromkeys((r.pattern, r.action) for q in policies for r in q.rules))
    return GuardPolicy(name, tuple(patterns[i] for i in order), tuple(rules[k] for k in rule_order), min((q.threshold for q in policies), default=60), any(q.sanitize for q in policies))


def to_json(policy: GuardPolicy) -> str:
    body = asdict(policy)
    body["patterns"] = [p._asdict() for p in policy.patterns]
    body["rules"] = [r._asdict() for r in policy.rules]
    return json.dumps(body)


def from_json(text: str) -> GuardPolicy:
    body = json.loads(text)
    patterns = tuple(Pattern(**{"flags": "i", **p, "needs": tuple(p.get("needs", ()))}) for p in body.get("patterns", []))
    rules = tuple(Rule(**{"flags": "i", **r}) for r in body.get("rules", []))
    return GuardPolicy(body["name"], patterns, rules, body.get("threshold", 60), body.get("sanitize", True), body.get("description", ""), tuple(body.get("tags", ())))


@dataclass(frozen=True)
class PolicyStore:
    """An immutable set of policies, one of them active."""

    policies: tuple[GuardPolicy, ...] = ()
    active: str | None = None

    def add(self, policy: GuardPolicy) -> PolicyStore:
        return replace(self, policies=(*(p for p in self.policies if p.name != policy.name), policy))

    def remove(self, name: str) -> PolicyStore:
        return PolicyStore(tuple(p for p in self.policies if p.name != name), None if self.active == name else self.active)

    def activate(self, name: str) -> PolicyStore:
        if self.get(name) is None:
            raise KeyError(name)
        return replace(self, active=name)

    def get(self, name: str) -> GuardPolicy | None:
        return next((p for p in self.policies if p.name == name), None)


def keyword_patterns(words: list[str], category: str = "custom", weight: int = 60, severity: str = "medium") -> tuple[Pattern, ...]:
    """One whole-word pattern for each keyword."""
    return tuple(Pattern(f"keyword_{k}", rf"\b{re.escape(w)}\b", severity, category, weight) for k, w in enumerate(words))


def company_terms(words: list[str]) -> tuple[Pattern, ...]:
    return tuple(p._replace(id=f"company_{k}") for k, p in enumerate(keyword_patterns(words, "company", 75, "high")))


def removal(pattern: str, category: str = "custom") -> Rule:
    return Rule(pattern, "remove", category)


def replacement(pattern: str, new: str, category: str = "custom") -> Rule:
    return Rule(pattern, "replace", category, new)


def quoting(pattern: str, category: str = "custom") -> Rule:
    return Rule(pattern, "quote", category)


#: Personal data by type, as (pattern, flags, severity, replacement).
PERSONAL = {
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "i", "medium", "[EMAIL_REDACTED]"),
    "phone": (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "", "medium", "[PHONE_REDACTED]"),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "", "high", "[SSN_REDACTED]"),
    "ip": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "", "low", "[IP_REDACTED]"),
    "creditcard": (r"\b(?:\d[ -]?){12,18}\d\b", "", "critical", "[CREDIT_CARD_REDACTED]"),
}


def personal_patterns(*types: str) -> tuple[Pattern, ...]:
    """Patterns of the personal data named; unknown names are left out."""
    known = [t for t in types if t in PERSONAL]
    return tuple(Pattern(f"pii_{t}_{k}", PERSONAL[t][0], PERSONAL[t][2], "personal", 70, PERSONAL[t][1]) for k, t in enumerate(known))


def personal_rules(*types: str) -> tuple[Rule, ...]:
    """Rules that replace the personal data named."""
    return tuple(Rule(PERSONAL[t][0], "replace", "pii", PERSONAL[t][3], PERSONAL[t][1], 2) for t in types if t in PERSONAL)


#: Fixed values of the templates.
TEMPLATES = {
    "financial": GuardPolicy(
        "financial",
        (*personal_patterns("creditcard", "ssn"), Pattern("bank_account", r"\b\d{8,17}\b", "high", "financial", 75, ""), Pattern("routing_number", r"\b\d{9}\b", "high", "financial", 70, "")),
        (*personal_rules("creditcard", "ssn"), Rule(r"\b\d{8,17}\b", "replace", "financial", "[ACCOUNT_NUMBER]", "", 2)),
        40, description="Financial services security policy", tags=("finance", "pci", "sensitive"),
    ),
    "healthcare": GuardPolicy(
        "healthcare",
        (*personal_patterns("ssn", "phone", "email"), Pattern("medical_record", r"\bMRN[-\s]?\d{6,10}\b", "critical", "healthcare", 90), Pattern("patient_id", r"\bPID[-\s]?\d{8}\b", "critical", "healthcare", 90)),
        (*personal_rules("ssn", "phone", "email"), Rule(r"\bMRN[-\s]?\d{6,10}\b", "replace", "healthcare", "[MEDICAL_RECORD]", "i", 3), Rule(r"\bPID[-\s]?\d{8}\b", "replace", "healthcare", "[PATIENT_ID]", "i", 3)),
        30, description="HIPAA-compliant healthcare security policy", tags=("healthcare", "hipaa", "phi", "sensitive"),
    ),
    "government": GuardPolicy(
        "government",
        (*personal_patterns("ssn", "email"), Pattern("classified_marker", r"\b(TOP SECRET|SECRET|CONFIDENTIAL|CLASSIFIED)\b", "critical", "security", 100), Pattern("security_clearance", r"\b(TS\/SCI|SECRET|CONFIDENTIAL)\s+CLEARANCE\b", "high", "security", 85)),
        (*personal_rules("ssn", "email"), Rule(r"\b(TOP SECRET|SECRET|CONFIDENTIAL|CLASSIFIED)\b", "replace", "security", "[CLASSIFICATION_REDACTED]", "i", 5)),
        20, description="Government/Defense security policy", tags=("government", "defense", "classified", "sensitive"),
    ),
}


def from_template(name: str, base: str | None = None, patterns: tuple[Pattern, ...] = (), rules: tuple[Rule, ...] = (), **changes) -> GuardPolicy:
    """A policy of its own, on a template or on nothing, with further patterns and rules."""
    start = TEMPLATES[base] if base else GuardPolicy(name)
    named = {"description": f"Custom policy: {name}", "tags": ()} | changes
    return replace(start, name=name, patterns=start.patterns + patterns, rules=start.rules + rules, **named)
