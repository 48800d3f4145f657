"""Further guard packs and presets, as data. Patterns, weights and thresholds are fixed values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column

from sievetext.operators.guard import Guard
from sievetext.operators.injection import EXECUTE, HIJACK, OVERRIDE, PATTERNS, Pattern, Rule

CORE = (
    Pattern("ignore_previous_core", r"ignore\s+(?:all\s+)?(?:previous|above)\s+(?:instructions?|commands?)", "critical", OVERRIDE, 95),
    Pattern("override_safety_core", r"override\s+(?:all\s+)?(?:safety|restrictions?|guidelines?)", "critical", OVERRIDE, 95),
    Pattern("disregard_core", r"disregard\s+(?:all\s+|everything\s+)?(?:above|previous)", "critical", OVERRIDE, 95),
    Pattern("system_marker_core", r"#?\s*system\s*[:\]]", "critical", HIJACK, 95),
    Pattern("instruction_marker_core", r"\[(?:INST|instruction|system)\]", "critical", HIJACK, 95),
    Pattern("chat_marker_core", r"<\|(?:im_start|im_end|system|user|assistant)\|>", "critical", HIJACK, 95),
    Pattern("execute_code_core", r"(?:execute|run|eval)\s+(?:code|command|script)", "critical", EXECUTE, 95),
    Pattern("eval_function_core", r"eval\s*\(", "critical", EXECUTE, 95),
    Pattern("dangerous_commands_core", r"(?:sudo\s+)?rm\s+-rf|exec\(|system\(", "critical", EXECUTE, 95),
)
FINANCIAL = (
    Pattern("credit_card", r"\b(?:\d[ -]?){12,18}\d\b", "high", "financial", 95, ""),
    Pattern("bank_account", r"\b(?:account|acct)\s*[#:]?\s*(\d{8,17})\b", "high", "financial", 90),
    Pattern("routing_number", r"\b(?:routing|aba)\s*[#:]?\s*(\d{9})\b", "high", "financial", 90),
    Pattern("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,28}\b", "high", "financial", 90, ""),
    Pattern("swift_code", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", "medium", "financial", 70, ""),
)
FINANCIAL_RULES = (
    Rule(r"\b(?:\d[ -]?){12,18}\d\b", "replace", "financial", "[CARD_NUMBER]", ""),
    Rule(r"\b(?:account|acct)\s*[#:]?\s*(\d{8,17})\b", "replace", "financial", "account [ACCOUNT_NUMBER]"),
    Rule(r"\b(?:routing|aba)\s*[#:]?\s*(\d{9})\b", "replace", "financial", "routing [ROUTING_NUMBER]"),
)
_EMAIL = r"(?<![A-Z0-9._%+-/])([A-Z0-9._%+-]{1,64}@[A-Z0-9.-]{1,253}\.[A-Z]{2,63})(?![\w])"
_PHONE = r"\b(?:\+?1[-\s]?)?\(?([2-9]\d{2})\)?[-\s]?([2-9]\d{2})[-\s]?(\d{4})\b"
_BYTE = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
PERSONAL = (
    Pattern("email", _EMAIL, "medium", "personal", 75),
    Pattern("us_phone", _PHONE, "medium", "personal", 70, ""),
    Pattern("jp_phone", r"\b(?:0[6-9]0)-?\d{4}-?\d{4}\b", "medium", "personal", 70, ""),
    Pattern("us_ssn", r"\b\d{3}-\d{2}-\d{4}\b", "critical", "personal", 95, ""),
    Pattern("jp_mynumber", r"\b\d{4}\s*\d{4}\s*\d{4}\b", "critical", "personal", 95, ""),
    Pattern("ip_address", rf"\b(?:{_BYTE}\.){{3}}{_BYTE}\b", "low", "personal", 50, ""),
    Pattern("us_zip", r"\b\d{5}(?:-\d{4})?\b", "low", "personal", 40, ""),
    Pattern("jp_postal", r"\b\d{3}-\d{4}\b", "low", "personal", 40, ""),
)
PERSONAL_RULES = (
    Rule(_EMAIL, "replace", "personal", "[EMAIL]"),
    Rule(_PHONE, "replace", "personal", "[PHONE_NUMBER]", ""),
    Rule(r"\b\d{3}-\d{2}-\d{4}\b", "replace", "personal", "[SSN]", ""),
    Rule(r"\b\d{4}\s*\d{4}\s*\d{4}\b", "replace", "personal", "[MYNUMBER]", ""),
)
_JWT = r"\beyJ[A-Za-z0-9+/=._-]{10,}\.[A-Za-z0-9+/=._-]{10,}\.[A-Za-z0-9+/=._-]{8,}\b"
_KEY = r"\b(?:sk_|pk_|api_|key_)[A-Za-z0-9_]{8,}\b"
_GITHUB = r"\b(gh[opusa]_[A-Za-z0-9]{38})\b"
_AUTH = r"Authorization\s*:\s*((?:Bearer|Basic)\s+[A-Za-z0-9+/=._-]{8,})"
SECURITY = (
    Pattern("jwt_token", _JWT, "critical", "security", 95, ""),
    Pattern("api_key", _KEY, "critical", "security", 90, ""),
    Pattern("github_token", _GITHUB, "critical", "security", 95, ""),
    Pattern("aws_access_key", r"\b((?:AKIA|ASIA|AGPA|AIDA|ANPA|AROA|AIPA)[A-Z0-9]{16})\b", "critical", "security", 95, ""),
    Pattern("google_api_key", r"\b(AIza[0-9A-Za-z_-]{35})\b", "critical", "security", 95, ""),
    Pattern("stripe_api_key", r"\b((?:sk|pk)_(?:live|test)_[A-Za-z0-9]{24,})\b", "critical", "security", 95, ""),
    Pattern("openai_api_key", r"\b(sk-(?:proj-)?[A-Za-z0-9_-]{20,})\b", "critical", "security", 95, ""),
    Pattern("auth_header", _AUTH, "critical", "security", 90),
    Pattern("session_id", r"\b(?:session|sess|jsessionid|phpsessid)=([A-Za-z0-9+/=._-]{8,})\b", "high", "security", 85),
    Pattern("uuid_token", r"\b[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "medium", "security", 70),
)
SECURITY_RULES = (
    Rule(_JWT, "replace", "security", "[JWT_TOKEN]", ""),
    Rule(_KEY, "replace", "security", "[API_KEY]", ""),
    Rule(_GITHUB, "replace", "security", "[GITHUB_TOKEN]", ""),
    Rule(_AUTH, "replace", "security", "Authorization: [REDACTED]"),
)
#: (patterns, rules, risk threshold) by pack.
PACKS = {"core": (CORE, (), 70), "financial": (FINANCIAL, FINANCIAL_RULES, 60), "personal": (PERSONAL, PERSONAL_RULES, 70), "security": (SECURITY, SECURITY_RULES, 40)}
#: (packs, risk threshold, sanitise) by level.
LEVELS = {"strict": (("core", "financial", "personal", "security"), 30, True), "balanced": (("core", "security"), 60, True), "permissive": (("core",), 80, False)}


def guard_for(*packs: str, threshold: float | None = None, sanitize: bool = True) -> Guard:
    """The built-in patterns with the packs'; the lowest of their thresholds unless one is given."""
    patterns = PATTERNS + tuple(p for name in packs for p in PACKS[name][0])
    rules = tuple(r for name in packs for r in PACKS[name][1])
    return Guard(min(PACKS[n][2] for n in packs) if threshold is None else threshold, sanitize, True, patterns, rules)


def guard_at(level: str) -> Guard:
    packs, threshold, sanitize = LEVELS[level]
    return guard_for(*packs, threshold=threshold, sanitize=sanitize)


def is_unsafe(text: Column) -> Column:
    """Whether any pattern of the core pack is in the text."""
    return reduce(or_, (text.rlike(p.java) for p in CORE))
