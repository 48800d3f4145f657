"""Detection and redaction of personal data as one narrow projection for each text.

normalise -> match every detector -> resolve overlaps -> allow and deny lists -> confidence
-> threshold -> rewrite. Everything is a column expression; the only Python is normalisation,
for texts beyond stable Latin.

Every hit of every text counts. A caller who wants a limit sets ``Policy.most_hits``; then a text
keeps its first hits in push order, and ``truncated`` tells which texts had more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetext.functions import headers, network
from sievetext.functions import text as T
from sievetext.functions.regexes import CHUNK, fold_spans, let, spans, to_java
from sievetext.operators import validators
from sievetext.operators.detectors import GATES, PACKS, Detector, around

HIT = "struct<type:string,start:int,end:int,value:string,risk:string,priority:int,confidence:double,ord:int>"
NONE = f"cast(array() as array<{HIT}>)"
SPANS = "cast(array() as array<struct<value:string,start:int,end:int>>)"
RISK_RANK = {"low": 1, "medium": 2, "high": 3}
THRESHOLDS = {"strict": 0.5, "balanced": 0.7, "relaxed": 0.85}
#: Fixed local parts and domains that are no personal data.
ALLOWED_PREFIXES = ("noreply@", "no-reply@", "donotreply@", "do-not-reply@")
ALLOWED_DOMAINS = ("example.com", "example.net", "example.org", "example.edu", "localhost", "localhost.localdomain", "invalid", "test", "local")
TEST_CARDS = ("4242424242424242", "4111111111111111", "378282246310005", "6011111111111117")


@dataclass(frozen=True)
class Policy:
    """What to find and what to do with it. ``rules``: type -> mask, remove, tokenize or ignore."""

    packs: tuple[str, ...] = ("core",)
    default_action: str = "mask"
    rules: dict[str, str] = field(default_factory=dict)
    keep_last4: frozenset[str] = frozenset()
    hmac_key: str | None = None
    sensitivity: str | None = None
    threshold: float | None = None
    environment: str = "production"
    #: fast takes every match; balanced and strict validate cards and emails in their context.
    strictness: str = "fast"
    allow: dict[str, tuple[str, ...]] = field(default_factory=dict)
    deny: dict[str, tuple[str, ...]] = field(default_factory=dict)
    detectors: tuple[Detector, ...] = ()
    #: Hits of a text that are kept; none given: all.
    most_hits: int | None = None
    #: Whether string values of JSON texts are hits by their keys too, before the built-in detectors.
    json: bool = False
    #: Names of cookies that are no secrets; one final ``*`` stands for any ending.
    cookie_allow: tuple[str, ...] = ()
    #: Masks by type, in place of the built-in ones: value -> replacement.
    maskers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        actions = {"mask", "remove", "tokenize", "ignore"}
        if bad := [a for a in (self.default_action, *self.rules.values()) if a not in actions]:
            raise ValueError(f"unknown action {bad[0]!r}")
        if "tokenize" in (self.default_action, *self.rules.values()) and len(self.hmac_key or "") < 32:
            raise ValueError("tokenize needs an hmac_key of at least 32 characters")
        if self.strictness not in ("fast", "balanced", "strict"):
            raise ValueError(f"unknown strictness {self.strictness!r}")
        if self.most_hits is not None and self.most_hits < 1:
            raise ValueError("most_hits must be positive")
        headers.check_allowlist(self.cookie_allow)
        if self.sensitivity not in (None, *THRESHOLDS):
            raise ValueError(f"unknown sensitivity {self.sensitivity!r}")

    def all_detectors(self) -> list[Detector]:
        """In push order: core first, then the others by priority."""
        chosen = [d for p in self.packs for d in PACKS[p]] + list(self.detectors)
        core = [d for d in chosen if d in PACKS["core"]]
        return core + sorted((d for d in chosen if d not in core), key=lambda d: d.priority)


def _hits_of(d: Detector, k: int, src: Column, low: Column, strictness: str) -> Column:
    def shaped(s: Column) -> Column:
        return F.struct(
            F.lit(d.type).alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(d.risk).alias("risk"),
            F.lit(d.priority).alias("priority"), F.lit(d.confidence).alias("confidence"), F.lit(k).alias("ord"),
        )

    def accepted(s: Column) -> Column:
        tests = [d.test(s["value"], s["start"], src)] if d.test and not d.merge else []
        if strictness != "fast":
            tests.append(validators.is_valid(s["value"], F.lit(d.type), around(src, s["start"], s["value"], 48), strictness))
        return reduce(and_, tests) if tests else None

    if d.merge:
        kept = lambda s: d.test(s["value"], s["start"], src) if d.test else F.lit(True)
        found = _merged(src, d.pattern, d.merge, kept)
    else:
        found = spans(src, d.pattern)
    if (d.test and not d.merge) or strictness != "fast":
        found = F.filter(found, accepted)
    hits = F.transform(found, shaped)
    needed = []
    if d.trigger:
        needed.append(reduce(or_, (src.contains(t) for t in d.trigger)))
    if d.context:
        needed.append(reduce(or_, (low.contains(w.lower()) for w in d.context)))
    return F.when(reduce(and_, needed), hits).otherwise(F.expr(NONE)) if needed else hits


def _all_hits(detectors: list[Detector], text: Column, low: Column, strictness: str = "fast") -> Column:
    """Hits of every detector; detectors behind one gate are skipped together."""
    parts = []
    for gate in dict.fromkeys(d.gate for d in detectors):
        group = F.concat(*[_hits_of(d, k, text, low, strictness) for k, d in enumerate(detectors) if d.gate == gate])
        parts.append(F.when(text.rlike(GATES[gate]), group).otherwise(F.expr(NONE)) if gate else group)
    return F.concat(*parts)


def _first(hits: Column, most: int) -> Column:
    """The first hits in push order: by detector, then start."""
    key = lambda h: F.struct(h["ord"], h["start"])
    order = lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)
    return F.when(F.size(hits) > most, F.slice(F.array_sort(hits, order), 1, most)).otherwise(hits)


def _merged(src: Column, pattern: str, least: int, kept) -> Column:
    """One span for each 500-character stretch with at least so many matches."""
    zero = F.struct(F.lit(-1).cast("long").alias("key"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("n"), F.expr(SPANS).alias("out"))

    def closed(g: Column) -> Column:
        value = F.substring(src, g["start"] + 1, g["end"] - g["start"])
        return F.when(g["n"] >= least, F.concat(g["out"], F.array(F.struct(value.alias("value"), g["start"].alias("start"), g["end"].alias("end"))))).otherwise(g["out"])

    def step(g: Column, s: Column) -> Column:
        key = F.floor(s["start"] / 500)
        more = F.struct(key.alias("key"), g["start"].alias("start"), s["end"].alias("end"), (g["n"] + 1).alias("n"), g["out"].alias("out"))
        new = F.struct(key.alias("key"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1).alias("n"), closed(g).alias("out"))
        return F.when((s["start"] > 0) & kept(s), F.when(key == g["key"], more).otherwise(new)).otherwise(g)

    return let(fold_spans(src, pattern, zero, step), closed)


def _rank(risk: Column) -> Column:
    return F.when(risk == "high", 3).when(risk == "medium", 2).otherwise(1)


def resolve(hits: Column) -> Column:
    """Disjoint hits: an ordered fold that compares each hit with the last one accepted.

    A lower priority number wins; then higher risk, then length, then the earlier start. A
    displaced hit does not come back, and the bound may shrink with the new one.
    """
    key = lambda h: F.struct(h["start"], -(h["end"] - h["start"]), h["ord"])
    sorted_ = lambda x: F.array_sort(x, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))

    def step(s: Column, h: Column) -> Column:
        last = s["last"]
        size, was = h["end"] - h["start"], last["end"] - last["start"]
        ties = F.when(_rank(h["risk"]) != _rank(last["risk"]), _rank(h["risk"]) > _rank(last["risk"])).when(size != was, size > was).otherwise(h["start"] < last["start"])
        better = (h["priority"] < last["priority"]) | ((h["priority"] == last["priority"]) & ties)
        apart = last.isNull() | (h["start"] >= last["end"])
        part = F.when(apart & last.isNotNull(), F.concat(s["part"], F.array(last))).otherwise(s["part"])
        return F.struct(part.alias("part"), F.when(apart | better, h).otherwise(last).alias("last"))

    def chunk(all_: Column):
        def run(s: Column, k: Column) -> Column:
            start = F.struct(F.expr(NONE).alias("part"), s["last"].alias("last"))
            inner = F.aggregate(F.slice(all_, k * CHUNK + 1, CHUNK), start, step)
            return let(inner, lambda x: F.struct(F.concat(s["out"], x["part"]).alias("out"), x["last"].alias("last")))

        return run

    # the last hit accepted is kept apart, so that the array only grows
    def folded(all_: Column) -> Column:
        start = F.struct(F.expr(NONE).alias("out"), F.expr(f"cast(NULL as {HIT})").alias("last"))
        end = lambda s: F.concat(s["out"], F.array(s["last"]))
        return F.aggregate(F.sequence(F.lit(0), ((F.size(all_) - 1) / CHUNK).cast("int")), start, chunk(all_), end)

    return let(hits, lambda x: F.when(F.size(x) < 2, x).otherwise(let(sorted_(x), folded)))


def _matches(value: Column, pattern: str, type_: str) -> Column:
    if "/" in pattern:
        return value.startswith(".".join(pattern.split("/")[0].split(".")[:-1]))
    if pattern.endswith("@"):
        return value.startswith(pattern)
    if type_ == "email":
        domain = value.endswith("@" + pattern) | value.endswith("." + pattern)
        return (value == pattern.lower()) | (domain if "@" not in pattern else F.lit(False))
    return value.contains(pattern)


def in_comment(hit: Column, src: Column) -> Column:
    """Whether the hit's line, within 100 characters, is a comment or documentation."""
    context = around(src, hit["start"], hit["value"], 100)

    def judged(c: Column) -> Column:
        index = F.instr(c, hit["value"]) - 1
        head, tail = F.substring(c, F.lit(1), index), F.substring(c, index + F.length(hit["value"]) + 1, F.length(c))
        # the line keeps the line feed it starts with
        broken = F.instr(F.reverse(head), "\n")
        start = F.when(broken > 0, F.length(head) - broken).otherwise(0)
        cut = F.instr(tail, "\n")
        line = F.concat(F.substring(head, start + 1, F.length(head)), hit["value"], F.when(cut > 0, F.substring(tail, F.lit(1), cut - 1)).otherwise(tail))
        bare = F.regexp_replace(line, f"^{T.SPACE}+|{T.SPACE}+$", "")
        comment = bare.rlike(r'^//|//[^"]*$|^#|^<!--[\s\S]*?-->|^\*|^/\*[\s\S]*?\*/')
        words = line.rlike(to_java(r"\b(?:example|demo|sample|test|placeholder)\s*[:]\s*|\be\.g\.\s*|\bfor\s+example\b", "i"))
        ticks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("`"), F.lit("")))
        line_tail = F.when(cut > 0, F.substring(tail, F.lit(1), cut - 1)).otherwise(tail)
        code = (ticks(F.substring(head, start + 1, F.length(head))) % 2 == 1) & (ticks(line_tail) % 2 == 1)
        env = line.rlike(to_java(r"^\s*[A-Z_]+=")) & F.lower(line).rlike("test|demo|sample|example|fake")
        return comment | words | code | env

    return let(context, judged)


def allowed(hit: Column, src: Column, policy: Policy) -> Column:
    """Whether the hit is no personal data under the policy's lists and environment."""
    value = F.lower(F.trim(hit["value"]))
    test = policy.environment != "production"
    lists: dict[str, tuple[str, ...]] = {"email": ALLOWED_PREFIXES + (ALLOWED_DOMAINS if test else ())}
    if test:
        lists |= {"ipv4": ("127.0.0.1", "0.0.0.0", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"), "credit_card": (*TEST_CARDS, "5555555555554444")}
        lists["ipv6"] = ("::1", "::", "2001:db8::/32", "fc00::/7", "fd00::/8", "fe80::/10")
    types = {d.type for d in policy.all_detectors()}
    lists = {k: (*lists.get(k, ()), *policy.allow.get(k, ())) for k in sorted(types.intersection([*lists, *policy.allow]))}

    def listed(table: dict[str, tuple[str, ...]]) -> Column:
        found = F.lit(False)
        for type_, patterns in table.items():
            for p in patterns:
                found = found | ((hit["type"] == type_) & _matches(value, p, type_))
        return found

    ok = in_comment(hit, src) | listed(lists)
    if test:
        private = hit["value"].rlike(r"^(10|127)\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.")
        ok = ok | ((hit["type"] == "ipv4") & private)
        if "ipv6" in types:
            ok = ok | ((hit["type"] == "ipv6") & F.coalesce(network.parse_ipv6(hit["value"])["private"], F.lit(False)))
        ok = ok | ((hit["type"] == "email") & value.rlike("@example\\.(com|org|net)|noreply|no-reply"))
        ok = ok | ((hit["type"] == "credit_card") & T.digits(hit["value"]).isin(*TEST_CARDS))
    return ~listed(policy.deny) & ok


def confidence(hit: Column, src: Column) -> Column:
    """Score from type, length, surrounding words, code fences, comments and email shape."""
    near = F.lower(around(src, hit["start"], hit["value"], 50))
    head = F.substring(src, F.lit(1), hit["start"])
    fences = F.floor((F.length(head) - F.length(F.replace(head, F.lit("```"), F.lit("")))) / 3)
    line = F.concat(F.substring_index(head, "\n", -1), F.substring_index(F.substring(src, hit["start"] + 1, F.length(src)), "\n", 1))
    when = lambda c, v: F.when(c, v).otherwise(0.0)
    size, email = F.length(hit["value"]), F.lower(hit["value"])
    score = F.lit(0.5) + F.when(hit["type"] == "email", 0.6).when(hit["type"] == "credit_card", 0.7).otherwise(0.4)
    score += when(near.rlike("test|example|dummy|sample|demo|fake|mock"), -0.1) + when(near.rlike(r"example\.com|example\.org|localhost|invalid|placeholder"), -0.15)
    score += when(fences % 2 == 1, -0.2) + when(line.rlike(rf"^{T.SPACE}*(//|#)"), -0.2) + F.when(size > 20, 0.1).when(size < 5, -0.1).otherwise(0.0)
    shape = when(email.rlike(r"(example\.com|example\.org|test\.com|localhost)$"), -0.4) + when(email.rlike("^(noreply|no-reply)@"), -0.4)
    shape += when(email.rlike(r"\.[a-z]{2,6}$"), 0.2) + when(email.rlike("admin@|test@|user@"), -0.2)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), score + F.when(hit["type"] == "email", shape).otherwise(0.0)))


def detected(src: Column, policy: Policy = Policy(), more: Column | None = None) -> Column:
    """(hits, truncated) of an already normalised text, ``more`` being further hits to resolve with them; offsets count code points of that text."""

    def final(found: Column, text: Column) -> Column:
        kept = F.filter(resolve(found), lambda h: ~allowed(h, text, policy))
        scored = F.transform(kept, lambda h: h.withField("confidence", F.round(confidence(h, text), 6)))
        if policy.sensitivity:
            floor = THRESHOLDS[policy.sensitivity] if policy.threshold is None else policy.threshold
            scored = F.filter(scored, lambda h: h["confidence"] >= floor)
        return scored

    def of(text: Column) -> Column:
        found = let(F.lower(text), lambda low: _all_hits(policy.all_detectors(), text, low, policy.strictness))
        found = found if more is None else F.concat(more, found)
        none = F.struct(F.expr(NONE).alias("hits"), F.lit(False).alias("truncated"))
        if policy.most_hits is None:
            full = lambda f: F.struct(final(f, text).alias("hits"), F.lit(False).alias("truncated"))
        else:
            full = lambda f: F.struct(final(_first(f, policy.most_hits), text).alias("hits"), (F.size(f) > policy.most_hits).alias("truncated"))
        return let(found, lambda f: F.when(F.size(f) > 0, full(f)).otherwise(none))

    empty = F.struct(F.expr(NONE).alias("hits"), F.lit(False).alias("truncated"))
    return F.when(src.isNull() | (F.length(src) == 0), empty).otherwise(let(src, of))


def detect(src: Column, policy: Policy = Policy()) -> Column:
    """Final hits of an already normalised text."""
    return detected(src, policy)["hits"]


def mask(hit: Column, policy: Policy = Policy()) -> Column:
    """The mask of a hit: by type, else ``[REDACTED:type]``. Only types of the policy's detectors are told apart."""
    v, kind = hit["value"], hit["type"]
    types = {d.type for d in policy.all_detectors()}
    branches: list[tuple[tuple[str, ...], Callable[[], Column | str]]] = [((t,), lambda m=m: m(v)) for t, m in policy.maskers.items()]

    def prefix(pattern: str, least: int) -> Column:
        head = F.regexp_extract(v, pattern, 1)
        return F.concat(head, F.repeat(F.lit("*"), F.greatest(F.lit(least), F.length(v) - F.length(head))))

    def sendgrid() -> Column:
        stars = lambda k: F.repeat(F.lit("*"), F.greatest(F.lit(4), F.length(F.regexp_extract(v, r"^SG\.([^.]+)\.(.+)$", k))))
        return F.concat(F.lit("SG."), stars(1), F.lit("."), stars(2))

    branches += [
        (("postal_jp",), lambda: "•••-••••"),
        (("phone_jp", "phone_us", "phone_e164"), lambda: T.bullets(v)),
        (("mynumber_jp",), lambda: "[REDACTED:MYNUMBER]"),
        (("zip_us",), lambda: F.when(F.length(v) > 5, "•••••-••••").otherwise("•••••")),
        (("ssn_us",), lambda: F.concat(F.lit("***-**-"), F.right(T.digits(v), F.lit(4)))),
        (("ipv4",), lambda: "•••.•••.•••.•••"),
        (("ipv6",), lambda: F.when(v.isin("::", "::1"), v).otherwise(T.bullets(v, "[0-9A-Fa-f]"))),
        (("mac",), lambda: "••:••:••:••:••:••"),
        (("sec_jwt_token",), lambda: F.array_join(F.transform(F.split(v, r"\."), lambda p: T.mask_token(p, 3, 3, 6)), ".")),
        (("sec_api_key",), lambda: F.when(v.rlike("(?i)^[a-z]+_."), prefix("(?i)^([a-z]+_)", 4)).otherwise(T.mask_token(v))),
        (("sec_session_id",), lambda: F.concat(F.substring_index(v, "=", 1), F.lit("="), T.mask_token(F.regexp_replace(v, "^[^=]*=", ""), 3, 3, 6))),
        (("sec_github_token",), lambda: prefix("^(gh[opusa]_)", 8)),
        (("sec_aws_access_key",), lambda: prefix("^(AKIA|ASIA|AGPA|AIDA|ANPA|AROA|AIPA)", 6)),
        (("sec_google_api_key",), lambda: prefix("^(AIza)", 8)),
        (("sec_stripe_api_key",), lambda: prefix("^((?:sk|pk)_(?:live|test)_)", 8)),
        (("sec_slack_token",), lambda: prefix(r"^(xox[abps]-\d+-\d+-|xapp-)", 6)),
        (("sec_openai_api_key",), lambda: prefix("^(sk-(?:proj-)?)", 8)),
        (("sec_google_oauth_token",), lambda: prefix(r"^(ya29\.|1//)", 8)),
        (("sec_sendgrid_api_key",), sendgrid),
        (("sec_uuid_token", "sec_hex_token", "sec_azure_subscription_key"), lambda: T.mask_token(v)),
        (("sec_webhook_url",), lambda: headers.masked_webhook(v)),
        (("sec_signed_url",), lambda: headers.masked_signed(v)),
        (("sec_cookie",), lambda: headers.masked_cookies(v, policy.cookie_allow)),
        (("sec_set_cookie",), lambda: headers.masked_set_cookie(v, policy.cookie_allow)),
        (("sec_auth_header",), lambda: "[REDACTED:AUTH]"),
        (("sec_url_token",), lambda: "[REDACTED:URL-TOKEN]"),
        (("sec_client_secret",), lambda: "[REDACTED:CLIENT-SECRET]"),
    ]
    plain = F.concat(F.lit("[REDACTED:"), kind, F.lit("]"))
    if policy.keep_last4:
        last4 = F.when(kind == "credit_card", F.concat(F.lit("**** **** **** "), F.right(T.digits(v), F.lit(4)))).otherwise(F.concat(plain, F.right(v, F.lit(4))))
        plain = F.when(kind.isin(*policy.keep_last4), last4).otherwise(plain)
    out = None
    for kinds, value in branches:
        if types.intersection(kinds):
            out = (F if out is None else out).when(kind.isin(*kinds), value())
    return plain if out is None else out.otherwise(plain)


def replacement(hit: Column, policy: Policy) -> Column:
    action = F.lit(policy.default_action)
    for type_, a in policy.rules.items():
        action = F.when(hit["type"] == type_, a).otherwise(action)
    out = F.when(action == "remove", "").when(action == "ignore", hit["value"])
    if policy.hmac_key:
        out = out.when(action == "tokenize", T.token_for(hit["type"], hit["value"], policy.hmac_key))
    return out.otherwise(mask(hit, policy))


def rewrite(src: Column, hits: Column, policy: Policy = Policy()) -> Column:
    """``src`` with each hit replaced by what the policy says."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, h: Column) -> Column:
        gap = F.substring(src, s["at"] + 1, h["start"] - s["at"])
        return F.struct(h["end"].alias("at"), F.concat(s["out"], gap, replacement(h, policy)).alias("out"))

    end = lambda s: F.concat(s["out"], F.substring(src, s["at"] + 1, F.length(src)))
    return F.when(F.size(hits) > 0, F.aggregate(hits, start, step, end)).otherwise(src)


def with_hits(docs: DataFrame, policy: Policy = Policy(), text: str = "text", src: str = "src", hits: str = "hits", truncated: str = "truncated") -> DataFrame:
    """``docs`` with the normalised text, its hits, and whether a limit left any out."""
    found = docs.withColumn(src, T.normalize(F.col(text)))
    more = None
    if policy.json:
        from sievetext.sources.jsonrpc import json_hits

        found = json_hits(found, src, "__json")
        shaped = lambda h: F.struct(*[h[c].alias(c) for c in ("type", "start", "end", "value", "risk")], F.lit(-5).alias("priority"), h["confidence"].alias("confidence"), F.lit(-1).alias("ord"))
        more = F.transform("__json", shaped)
    found = found.withColumn("__found", detected(F.col(src), policy, more))
    return found.withColumns({hits: F.col("__found.hits"), truncated: F.col("__found.truncated")}).drop("__found", "__json")


def hit_rows(docs: DataFrame, policy: Policy = Policy(), text: str = "text") -> DataFrame:
    """One row for each hit: the other columns of ``docs``, then the hit's as ``h``."""
    found = with_hits(docs, policy, text, "__src", "__hits", "__truncated")
    # an outer explode, as a plain one would be given a filter that detects everything again
    rows = found.select(*[c for c in docs.columns if c != text], F.explode_outer("__hits").alias("h"))
    return rows.where("h IS NOT NULL")


def redact(docs: DataFrame, policy: Policy = Policy(), text: str = "text", out: str = "redacted", truncated: str | None = None) -> DataFrame:
    """``docs`` with the redacted text; a text without hits is only normalised.

    With ``truncated`` there is a column of that name: whether ``most_hits`` left hits in.
    """
    found = with_hits(docs, policy, text, "__src", "__hits", "__truncated")
    found = found.withColumn(out, rewrite(F.col("__src"), F.col("__hits"), policy))
    if truncated:
        found = found.withColumn(truncated, F.col("__truncated"))
    return found.drop("__src", "__hits", "__truncated")
