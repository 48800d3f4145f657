"""Prompt-injection patterns and rules, as data. Patterns and weights are fixed values."""

from __future__ import annotations

from typing import NamedTuple

from sievetext.functions.regexes import to_java


class Pattern(NamedTuple):
    id: str
    pattern: str
    severity: str
    category: str
    weight: int
    flags: str = "i"
    #: Lower-case literals of which every match holds one; none given: always tried.
    needs: tuple[str, ...] = ()

    @property
    def java(self) -> str:
        return to_java(self.pattern, self.flags)


class Rule(NamedTuple):
    pattern: str
    action: str
    category: str
    replacement: str | None = None
    flags: str = "i"
    priority: int = 0

    @property
    def java(self) -> str:
        return to_java(self.pattern, self.flags)


SEVERITY_RANK = {"critical": 100, "high": 80, "medium": 60, "low": 40}
OVERRIDE, HIJACK, EXTRACT, EXECUTE, JAILBREAK, OBFUSCATE = "instruction_override", "context_hijack", "info_extraction", "code_execution", "jailbreak", "obfuscation"
PATTERNS = (
    Pattern("ignore_previous", r"ignore\s+(?:all\s+)?(?:previous\s+|prior\s+|above\s+|earlier\s+)?(?:instructions?|commands?|directives?|prompts?)", "high", OVERRIDE, 90),
    Pattern("ignore_everything_above", r"ignore\s+(?:everything\s+)?above", "high", OVERRIDE, 85),
    Pattern("ignore_guidelines", r"(?:will\s+)?ignore\s+(?:my\s+|your\s+|the\s+)?(?:guidelines?|rules?|restrictions?|safety\s+measures?)", "high", OVERRIDE, 85),
    Pattern("disregard_above", r"disregard\s+(?:all\s+|everything\s+)?(?:above|previous|prior|earlier)", "high", OVERRIDE, 90),
    Pattern("forget_instructions", r"forget\s+(?:all\s+|your\s+)?(?:previous\s+|prior\s+|above\s+|earlier\s+)?(?:instructions?|commands?|training|directives?)", "high", OVERRIDE, 85),
    Pattern("new_instruction", r"(?:new|updated?)\s+(?:instruction|command|directive|rule|prompt):", "medium", OVERRIDE, 70),
    Pattern("override_safety", r"override\s+(?:all\s+)?(?:safety\s+)?(?:measures?|protocols?|guidelines?|restrictions?)", "critical", OVERRIDE, 95),
    Pattern("system_marker", r"#?\s*system\s*[:\]]", "critical", HIJACK, 95),
    Pattern("instruction_marker", r"\[(?:INST|instruction|system)\]", "critical", HIJACK, 95),
    Pattern("chat_marker", r"<\|(?:im_start|im_end|system|user|assistant)\|>", "critical", HIJACK, 95),
    Pattern("role_play", r"(?:you\s+are\s+now|from\s+now\s+on\s+you\s+are|act\s+as\s+(?:if\s+)?you\s+are)\s+(?:a\s+)?(?:different|new|another)", "medium", HIJACK, 65),
    Pattern("reveal_system", r"(?:reveal|show|display|tell\s+me|what\s+is|what\s+are)\s+(?:your\s+)?(?:exact\s+)?(?:system\s+prompt|instructions?|training\s+data|initial\s+prompt|prompt\s+engineering\s+guidelines?)", "high", EXTRACT, 85),
    Pattern("extract_secrets", r"(?:what\s+are\s+your|tell\s+me\s+your|reveal\s+your|show\s+me\s+your)\s+(?:secrets?|hidden\s+(?:instructions?|commands?)|confidential\s+information)", "high", EXTRACT, 80),
    Pattern("show_configuration", r"(?:show|display|reveal)\s+(?:me\s+)?(?:your\s+)?(?:configuration|config|settings)", "medium", EXTRACT, 70),
    Pattern("debug_mode", r"(?:enter|enable|activate)\s+(?:debug|developer|admin|maintenance)\s+mode", "medium", EXTRACT, 70),
    Pattern("execute_code", r"(?:execute|run|eval)(?:\s+(?:this|the|malicious|dangerous|arbitrary))?(?:\s+\w+)*\s*(?:code|command|script|python|javascript)", "critical", EXECUTE, 95),
    Pattern("eval_function", r"eval\s*\(|eval\s+this|eval\s+malicious", "critical", EXECUTE, 95),
    Pattern("base64_decode", r"(?:decode|base64|atob)\s+(?:and\s+)?(?:execute|run|eval)", "high", EXECUTE, 85),
    Pattern("shell_command", r"(?:run|execute)\s+(?:shell|bash|cmd|powershell)\s+command", "critical", EXECUTE, 95),
    Pattern("dangerous_commands", r"(?:sudo\s+)?rm\s+-rf|Process\.start|exec\(|spawn\(|system\(", "critical", EXECUTE, 95),
    Pattern("dan_prompt", r"(?:do\s+anything\s+now|DAN\s+mode|jailbreak\s+mode)", "high", JAILBREAK, 90),
    Pattern("hypothetical", r"(?:hypothetically|in\s+a\s+hypothetical\s+scenario|imagine\s+if)\s+you\s+could\s+(?:ignore|bypass|override)", "medium", JAILBREAK, 60),
    Pattern("character_play", r"(?:pretend|roleplay|act\s+like|act\s+as)\s+(?:you\s+are\s+)?(?:an?\s+)?(?:evil|malicious|unrestricted|uncensored)", "medium", JAILBREAK, 65),
    Pattern("imagine_unrestricted", r"(?:imagine|suppose|assume)\s+(?:you\s+are|you\s+were|if\s+you\s+were)\s+(?:free|unrestricted|uncensored)", "medium", JAILBREAK, 60),
    Pattern("unicode_spoofing", r"[\x{200b}-\x{200f}\x{2060}\x{feff}]", "medium", OBFUSCATE, 70, ""),
    Pattern("leet_speak", r"1gn0r3|d1sr3g4rd|f0rg3t|3x3cut3|r3v34l", "low", OBFUSCATE, 40),
    Pattern("excessive_spacing", r"\s{10,}", "low", OBFUSCATE, 30, ""),
)
#: Literals by pattern, tested before the regex.
NEEDS = {
    "ignore_previous": "ignore", "ignore_everything_above": "ignore", "ignore_guidelines": "ignore", "disregard_above": "disregard", "forget_instructions": "forget",
    "new_instruction": "instruction: command: directive: rule: prompt:", "override_safety": "override", "system_marker": "system", "instruction_marker": "[inst [system", "chat_marker": "<|",
    "role_play": "different new another", "reveal_system": "prompt instruction training", "extract_secrets": "secret hidden confidential", "show_configuration": "config settings",
    "debug_mode": "debug developer admin maintenance", "execute_code": "code command script python", "eval_function": "eval", "base64_decode": "decode base64 atob", "shell_command": "command",
    "dangerous_commands": "-rf process.start exec( spawn( system(", "dan_prompt": "anything dan jailbreak", "hypothetical": "could", "character_play": "evil malicious unrestricted uncensored",
    "imagine_unrestricted": "free unrestricted uncensored", "leet_speak": "1gn0r3 d1sr3g4rd f0rg3t 3x3cut3 r3v34l",
}
PATTERNS = tuple(p._replace(needs=tuple(NEEDS.get(p.id, "").split())) for p in PATTERNS)

RULES = (
    Rule(r"#\s*system\s*[:\]]", "remove", "context_marker"),
    Rule(r"\[(?:INST|instruction|system)\]", "remove", "context_marker"),
    Rule(r"<\|(?:im_start|im_end|system|user|assistant)\|>", "remove", "context_marker"),
    Rule(r"ignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|commands?|directives?|prompts?)", "replace", OVERRIDE, "[REQUEST_TO_IGNORE_INSTRUCTIONS]"),
    Rule(r"disregard\s+(?:all\s+)?(?:above|previous|prior|earlier)\s+(?:instructions?|commands?|content)", "replace", OVERRIDE, "[REQUEST_TO_DISREGARD_CONTENT]"),
    Rule(r"forget\s+(?:all\s+)?(?:previous|prior|above|earlier|your)\s+(?:instructions?|commands?|training)", "replace", OVERRIDE, "[REQUEST_TO_FORGET_INSTRUCTIONS]"),
    Rule(r"(?:execute|run|eval)\s+(?:this\s+)?(?:code|command|script|python|javascript)", "quote", EXECUTE),
    Rule(r"(?:decode|base64|atob)\s+(?:and\s+)?(?:execute|run|eval)", "quote", EXECUTE),
    Rule(r"[\x{200b}-\x{200f}\x{2060}\x{feff}]", "remove", OBFUSCATE, flags=""),
    Rule(r"\s{3,}", "replace", OBFUSCATE, " ", flags=""),
)
#: Marker families that divide a text by trust.
MARKERS = (
    (r"#\s*system\s*[:\]]", "i", "system"),
    (r"\[(?:INST|instruction|system)\]", "i", "system"),
    (r"<\|(?:im_start|system)\|>", "i", "system"),
    (r"<\|(?:user|human)\|>", "i", "user"),
    (r"```[^`]*```", "s", "tool-output"),
    (r"\[tool_output\]", "i", "tool-output"),
)
TRUST_ORDER = {"system": 0, "user": 1, "tool-output": 2, "untrusted": 3}
TRUST_FACTOR = {"system": 0.1, "user": 1.0, "tool-output": 1.2, "untrusted": 2.0}

def ordered(patterns: tuple[Pattern, ...], severities: tuple[str, ...] | None = None) -> list[Pattern]:
    """By severity and weight, the given order among equals."""
    kept = [p for p in patterns if severities is None or p.severity in severities]
    return sorted(kept, key=lambda p: -(SEVERITY_RANK[p.severity] + p.weight))
