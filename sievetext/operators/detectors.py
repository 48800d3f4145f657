"""Detectors of personal data, network identifiers and credentials, as data.

A detector names its pattern and what must hold: context words anywhere in the text, and a
test of the match. Patterns, words and prefixes are fixed values, given in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievetext.functions import headers
from sievetext.functions import text as T
from sievetext.functions.regexes import to_java

Test = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Detector:
    """``test(value, start, src)`` keeps a match; ``trigger`` literals make the regex worthwhile."""

    type: str
    pattern: str
    risk: str
    priority: int
    confidence: float = 0.7
    context: tuple[str, ...] = ()
    trigger: tuple[str, ...] = ()
    test: Test | None = None
    group: int = 0
    #: Matches in one 500-character stretch are one hit, if there are at least so many.
    merge: int = 0
    #: Key of GATES: what any text with a match holds.
    gate: str = ""


#: Cheap searches shared by many detectors.
GATES = {"digit": "[0-9]", "secret": r"[_=:/]|eyJ|[A-Za-z0-9.-]{16}"}


def around(src: Column, start: Column, value: Column, reach: int) -> Column:
    """The match with up to ``reach`` characters on both sides."""
    low = F.greatest(start - reach, F.lit(0))
    return F.substring(src, low + 1, F.least(start + F.length(value) + reach, F.length(src)) - low)


def before(src: Column, start: Column, reach: int) -> Column:
    low = F.greatest(start - reach, F.lit(0))
    return F.substring(src, low + 1, start - low)


def _has(text: Column, words: str) -> Column:
    return text.rlike("|".join(words.split()))


# Patterns.
EMAIL = r"(?<![A-Z0-9._%+-/])[A-Z0-9._%+-]{1,64}@[A-Z0-9.-]{1,253}\.[A-Z]{2,63}(?![\w])"
#: Begins with the digit, so that other characters are passed over at once.
CARD = r"\d(?<![0-9A-Za-z_]\d)(?:[ -]?\d){12,18}(?![0-9A-Za-z_])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\b{OCTET}(?:\.{OCTET}){{3}}\b"
H = "[0-9A-Fa-f]{1,4}"
IPV6 = (
    rf"(?<![0-9A-Fa-f:])(?:(?:{H}:){{7}}{H}|(?:{H}:){{1,7}}:|(?:{H}:){{1,6}}:{H}|(?:{H}:){{1,5}}(?::{H}){{1,2}}|(?:{H}:){{1,4}}(?::{H}){{1,3}}"
    rf"|(?:{H}:){{1,3}}(?::{H}){{1,4}}|(?:{H}:){{1,2}}(?::{H}){{1,5}}|{H}:(?::{H}){{1,6}}|:(?::{H}){{1,7}}|::|::ffff:{OCTET}(?:\.{OCTET}){{3}})(?![0-9A-Fa-f:])"
)
MAC = r"\b[0-9A-F]{2}(?:[:-][0-9A-F]{2}){5}\b"
NO_MONEY, NO_MONEY_AFTER = r"(?<![¥$€£¢])", r"(?![¥$€£¢])"
DIGIT_BEFORE, DIGIT_AFTER = "(?<![0-9０-９])", "(?![0-9０-９])"


def _card(value: Column, start: Column, src: Column) -> Column:
    number = T.digits(value)
    return F.length(number).between(13, 19) & T.luhn(number)


def _ipv4(value: Column, start: Column, src: Column) -> Column:
    near = F.lower(around(src, start, value, 50))
    word = lambda words: near.rlike(to_java(rf"\b({words})\b"))
    odd = value.rlike(r"^[0-9]\.[0-9]\.[0-9]{1,2}\.[0-9]$")
    return ~value.isin("127.0.0.1", "0.0.0.0", "255.255.255.255") & ~odd & (word("ip|address|server|host|endpoint|url|api") | ~word(r"version|ver|v\d|release|build|date"))


def _mac(value: Column, start: Column, src: Column) -> Column:
    plain = F.lower(F.regexp_replace(value, "-", ":"))
    near = F.lower(around(src, start, value, 50))
    return ~plain.isin("ff:ff:ff:ff:ff:ff", "00:00:00:00:00:00") & ~near.rlike(to_java(r"\b(product|serial|model|part|sku)\b"))


def _postal(value: Column, start: Column, src: Column) -> Column:
    return ~value.rlike(r"^0\d") & ~_has(F.lower(before(src, start, 30)), "tel 電話 phone fax 携帯 mobile")


def _ipv6(value: Column, start: Column, src: Column) -> Column:
    """Eight groups, or fewer with one ``::``."""
    pieces = F.size(F.filter(F.split(value, ":"), lambda x: x != ""))
    short = value.contains("::")
    return F.when(short, ~F.regexp_replace(value, "::", "").contains("::") & (pieces <= 7)).otherwise(pieces == 8)


def _cookie(value: Column, start: Column, src: Column) -> Column:
    """Some cookie of the header has a value of eight characters or more."""
    return F.exists(headers.cookies(value), lambda c: F.length(c["value"]) >= 8)


def _set_cookie(value: Column, start: Column, src: Column) -> Column:
    return F.coalesce(F.length(headers.set_cookie(value)["value"]) >= 8, F.lit(False))


CORE = (
    Detector("email", to_java(EMAIL, "i"), "medium", 10, 0.7, trigger=("@",)),
    Detector("credit_card", to_java(CARD), "high", 10, 0.7, test=_card),
)
NETWORK = (
    Detector("ipv6", to_java(IPV6, "i"), "low", -1, 0.7, trigger=("::", ":"), test=_ipv6),
    Detector("ipv4", to_java(IPV4), "low", 0, 0.8, test=_ipv4),
    Detector("mac", to_java(MAC, "i"), "low", 0, 0.6, trigger=(":", "-"), test=_mac),
)
JP = (
    Detector("mynumber_jp", rf"{DIGIT_BEFORE}\d{{12}}{DIGIT_AFTER}", "high", -10, 0.6, context=("マイナンバー", "個人番号", "mynumber")),
    Detector("postal_jp", rf"(?<![0-9０-９¥$€£¢])\d{{3}}-?\d{{4}}{DIGIT_AFTER}", "low", 5, 0.4, test=_postal),
    Detector("phone_jp", rf"{DIGIT_BEFORE}0(?:60|70|80|90)-?\d{{4}}-?\d{{4}}{DIGIT_AFTER}", "medium", 10, 0.8),
    Detector("phone_jp", rf"{DIGIT_BEFORE}0[1-9]\d?-?\d{{3,4}}-?\d{{4}}{DIGIT_AFTER}", "low", 10, 0.5),
    Detector("phone_jp", to_java(rf"\+81[-.\s]?\d{{1,4}}[-.\s]?\d{{1,4}}[-.\s]?\d{{3,4}}{DIGIT_AFTER}"), "medium", 10, 0.9, trigger=("+81",)),
)
US = (
    Detector("ssn_us", to_java(r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"), "high", -10, 0.9, context=("ssn", "social", "security")),
    Detector("phone_us", to_java(r"\b(?:\+1[-.\s]?)?(?:\(?[2-9]\d{2}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"), "medium", 0, 0.65),
    Detector("zip_us", to_java(r"\b\d{5}(?:-\d{4})?\b"), "low", 0, 0.75, context=("zip", "postal", "address")),
)


def _secret(type_: str, body: str, priority: int, confidence: float, words: str = "", trigger: str = "", risk: str = "high", flags: str = "", bounded: bool = True, group: int = 0, merge: int = 0, test: Test | None = None) -> Detector:
    pattern = rf"{NO_MONEY}\b{body}\b{NO_MONEY_AFTER}" if bounded else body
    return Detector(type_, to_java(pattern, flags), risk, priority, confidence, tuple(words.lower().split()), tuple(trigger.split()), test, group, merge)


AUTH, SESSION, API_KEY, COOKIE = "Authorization Bearer Basic Auth Token", "session sess JSESSIONID PHPSESSID", "API-Key X-API-Key X-Auth-Token API_KEY", "Cookie Set-Cookie Session"
SECURITY = (
    _secret("sec_github_token", r"gh[opusa]_[A-Za-z0-9]{38}", -15, 0.95, "github gh_ pat personal access token", "gho_ ghp_ ghu_ ghs_ gha_"),
    _secret("sec_aws_access_key", r"(?:AKIA|ASIA|AGPA|AIDA|ANPA|AROA|AIPA)[A-Z0-9]{16}", -12, 0.92, "aws amazon akia asia access key id", "AKIA ASIA AGPA AIDA ANPA AROA AIPA"),
    _secret("sec_google_api_key", r"AIza[0-9A-Za-z_-]{35}", -11, 0.93, "google gcp firebase api key aiza", "AIza"),
    _secret("sec_jwt_token", r"eyJ[A-Za-z0-9+/=._-]{10,}\.[A-Za-z0-9+/=._-]{10,}\.[A-Za-z0-9+/=._-]{8,}", -10, 0.9, trigger="eyJ"),
    _secret("sec_stripe_api_key", r"(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{24,}", -10, 0.91, "stripe sk_ pk_ live test payment", "sk_ pk_"),
    _secret("sec_slack_token", r"(?:xox[abps]-\d{10,}-\d{10,}-[A-Za-z0-9]{24,48}|xapp-[A-Za-z0-9-]{20,})", -9, 0.89, "slack xox bot user app workspace", "xox xapp-"),
    _secret("sec_auth_header", r"Authorization\s*:\s*(?:Bearer|Basic)\s+(?![¥$€£¢])[A-Za-z0-9+/=._-]{8,}", -8, 0.9, AUTH, flags="i", bounded=False),
    _secret("sec_sendgrid_api_key", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", -8, 0.9, "sendgrid sg email mail api", "SG."),
    _secret("sec_openai_api_key", r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}", -7, 0.88, "openai gpt api sk- chat completion", "sk-"),
    _secret("sec_api_key", r"(?:X-API-Key|X-Auth-Token|X-Access-Token|API-Key|Auth-Token)\s*:\s*(?![¥$€£¢])[A-Za-z0-9+/=._-]{8,}(?![¥$€£¢])", -6, 0.88, API_KEY, flags="i", bounded=False),
    _secret("sec_google_oauth_token", r"(?:ya29\.[0-9A-Za-z_-]+|1//[0-9A-Za-z_-]+)", -6, 0.75, "oauth ya29 refresh access bearer", "ya29. 1//", "medium"),
    _secret("sec_api_key", r"(?:sk_|pk_|api_|key_)[A-Za-z0-9_]{8,}", -5, 0.9, trigger="sk_ pk_ api_ key_"),
    _secret("sec_azure_subscription_key", r"(?<![¥$€£¢A-Za-z0-9])\b[A-Za-z0-9]{32,44}\b(?![¥$€£¢A-Za-z0-9])", -5, 0.86, "azure ocp-apim subscription cognitive translator", bounded=False),
    _secret("sec_uuid_token", r"(?<![¥$€£¢0-9a-fA-F])\b[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b(?![¥$€£¢0-9a-fA-F])", 0, 0.7, f"{AUTH} {SESSION}", risk="medium", flags="i", bounded=False),
    _secret("sec_hex_token", r"(?<![¥$€£¢0-9a-fA-F])\b[0-9a-fA-F]{32,}\b(?![¥$€£¢0-9a-fA-F])", 0, 0.65, f"{SESSION} {AUTH}", risk="medium", bounded=False),
    _secret("sec_session_id", r"(?<![¥$€£¢])\b(?:session|sess|jsessionid|phpsessid)=[A-Za-z0-9+/=._-]{8,}(?![¥$€£¢])", 0, 0.85, flags="i", bounded=False),
    _secret("sec_client_secret", r"[?&](?:client_id|client_secret)=(?![¥$€£¢])[^&\s¥$€£¢]{8,}(?![¥$€£¢])", 0, 0.9, trigger="client_", flags="i", bounded=False),
    _secret("sec_url_token", r"[?&](?:token|access_token|client_secret|refresh_token|auth_token)=(?![¥$€£¢])[^&\s¥$€£¢]{8,}(?![¥$€£¢])", 0, 0.8, trigger="? &", flags="i", bounded=False),
    _secret("sec_url_token", r"[?&]api_key=(?![¥$€£¢])[^&\s¥$€£¢]{8,}(?![¥$€£¢])", 0, 0.65, trigger="? &", risk="medium", flags="i", bounded=False),
    _secret("sec_cookie", r"Cookie\s*:\s*[^;\r\n]+(?:;\s*[^;\r\n]+)*", 0, 0.7, COOKIE, risk="medium", flags="i", bounded=False, test=_cookie),
    _secret("sec_set_cookie", r"Set-Cookie\s*:\s*[^;\r\n]+(?:;\s*[^;\r\n]+)*", 0, 0.72, COOKIE, risk="medium", flags="i", bounded=False, test=_set_cookie),
    _secret("sec_webhook_url", r"https://hooks\.slack\.com/services/T[A-Z0-9]{8}/B[A-Z0-9]{8}/[A-Za-z0-9]{24,}", 0, 0.82, trigger="hooks.slack.com", bounded=False),
    _secret("sec_webhook_url", r"https://(?:discord|discordapp)\.com/api/webhooks/\d{16,32}/[A-Za-z0-9_-]{30,}", 0, 0.82, trigger="/api/webhooks/", bounded=False),
    _secret("sec_webhook_url", r"https://api\.github\.com/repos/[^/]+/[^/]+/hooks/\d+", 0, 0.82, trigger="api.github.com", bounded=False),
    _secret("sec_signed_url", r"[?&]X-Amz-(?:Credential|Signature|Expires|Algorithm)=[^&\s]+", 0, 0.82, trigger="X-Amz-", bounded=False, merge=2),
    _secret("sec_signed_url", r"[?&]X-Goog-(?:Algorithm|Credential|Signature|Expires)=[^&\s]+", 0, 0.82, trigger="X-Goog-", bounded=False, merge=2),
    _secret("sec_signed_url", r"[?&](?:sv|se|sr|sp|sig)=[^&\s]+", 0, 0.82, trigger="sv= se= sr= sp= sig=", bounded=False, merge=3),
)


def _gated(detectors: tuple[Detector, ...], gate: str, types: str = "") -> tuple[Detector, ...]:
    return tuple(replace(d, gate=gate) if not types or d.type in types.split() else d for d in detectors)


#: Detector sets by name.
PACKS = {
    "core": _gated(CORE, "digit", "credit_card"), "network": _gated(NETWORK, "digit", "ipv4"), "jp": _gated(JP, "digit"), "us": _gated(US, "digit"), "security": _gated(SECURITY, "secret"),
}
