"""Strictness: validation of candidates by form and by the words around them.

Keywords and thresholds are fixed values.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievetext.functions import text as T
from sievetext.functions.regexes import let, to_java

POSITIVE = {
    "email": "email e-mail mail mailto from to cc bcc sender recipient address contact reach write send メール メールアドレス eメール 電子メール 電子郵便 送信者 受信者 宛先 アドレス 連絡先 問い合わせ先 送信 受信 返信 転送 配信 お知らせ 通知 件名 本文 添付 ファイル添付",
    "credit_card": "card credit debit visa mastercard amex discover jcb maestro cc payment billing charge transaction exp cvv cvc security code expiry expiration カード クレカ クレジットカード デビットカード デビカ クレジット 信用カード 決済 支払 支払い 料金 有効期限 期限 セキュリティコード セキュリティ番号 カード番号 カード情報 取引 会計 清算 精算 ビザ マスター アメックス JCB ジェーシービー ショッピング 購入 買い物 お支払い ご請求",
}
NEGATIVE = (
    "version ver v release rel build changelog history sample example demo test testing dummy fake mock placeholder template sandbox trial documentation docs spec specification tutorial guide readme license copyright author manual "
    "uuid guid hash checksum digest signature token key secret certificate fingerprint identifier id テスト サンプル 例 見本 デモ 試用 試験 ドキュメント 仕様 仕様書 ガイド ガイドライン マニュアル リリース バージョン 版 更新 アップデート 開発 開発用 開発環境 テスト環境 検証 実験 プレースホルダー プレースホルダ ダミー 偽 フェイク 仮 一時 仮データ テストデータ サンプルデータ"
)
#: (words, what they add to the score) by type.
TYPE_RULES = {
    "credit_card": (
        (r"\b(payment|transaction|purchase|billing|checkout|order)\b", 0.3), (r"\b(exp|expir|cvv|cvc|security\s+code)\b", 0.4), (r"\b(example|sample|demo|test|dummy)\b", -0.5),
        (r"\b(id|identifier|user|customer|account)\s*:?\s*\d+", -0.2), (r"\b(insert|update|select|database|log|debug)\b", -0.3), (r"\b(random|number|digits?|value|data|string)\b", -0.15),
    ),
    "ipv4": (
        (r"\b(connect|connection|server|client|endpoint|gateway|router)\b", 0.3), (r"\b(from|to|src|dst|source|destination)\b", 0.2), (r"\b(ping|traceroute|nslookup|dig|curl|wget|ssh|telnet|ftp)\b", 0.4),
        (r"\b(version|release|build|package)\b", -0.4), (r"\b(date|time|timestamp|year|month|day)\b", -0.3), (r"\b(config|conf|settings|properties|ini|yaml|json|xml)\b", 0.2),
    ),
    "email": (
        (r"\b(send|sent|receive|forward|reply|contact|reach)\b", 0.3), (r"\b(from|to|cc|bcc|subject|message|mail)\b", 0.4), (r"\b(noreply|no-reply|donotreply|system|daemon|automated)\b", -0.5),
        (r"\b(example|test|demo|placeholder)\b", -0.4), (r"\b(domain|dns|mx|record|zone)\b", -0.2),
    ),
    "phone_e164": (
        (r"\b(call|dial|ring|mobile|cell|landline|extension|ext)\b", 0.3), (r"\b(contact|reach|emergency|support|help|service)\b", 0.2), (r"\b(test|example|dummy|sample|fake)\b", -0.4), (r"\b(id|identifier|code|reference|serial)\b", -0.2),
    ),
    "mac": (
        (r"\b(ethernet|ether|nic|interface|adapter|card)\b", 0.4), (r"\b(ifconfig|arp|bridge|switch|router|gateway)\b", 0.3), (r"\b(uuid|guid|hash|checksum|signature|key)\b", -0.5),
    ),
}
TYPE_RULES["ipv6"] = TYPE_RULES["ipv4"]
#: Least context score by strictness and type.
NEEDED = {
    "fast": {"credit_card": 0.5, "phone_e164": 0.5, "mac": 0.4, "": 0.3},
    "balanced": {"credit_card": 1.1, "email": 0.8, "phone_e164": 0.8, "mac": 0.6, "": 0.5},
    "strict": {"credit_card": 1.5, "phone_e164": 1.2, "": 1.0},
}
#: Card brands: prefix and lengths.
BRANDS = (
    ("visa", "^4", (13, 16, 19)), ("mastercard", "^(5[1-5]|2[2-7])", (16,)), ("amex", "^3[47]", (15,)), ("discover", "^(6011|65|64[4-9])", (16, 19)),
    ("jcb", "^35(2[89]|[3-8][0-9])", (16, 17, 18, 19)), ("dinersclub", "^3[0689]", (14,)), ("maestro", "^(5018|5020|5038|6304|6759|676[1-3])", tuple(range(12, 20))),
)
TEST_CARDS = tuple(
    "4111111111111111 4012888888881881 4222222222222 4242424242424242 4000000000000002 4000000000000010 4000000000000028 4000000000000036 4000000000000044 4000000000000069 4000000000000101 4000000000000119 4000000000000127 4000000000000135 "
    "5555555555554444 5105105105105100 5200828282828210 5204230080000017 5204740009999999 5420923878724339 378282246310005 371449635398431 378734493671000 347000000000000 6011111111111117 6011000990139424 6011981111111113 "
    "3530111333300000 3566002020360505 30569309025904 38520000023237 6759649826438453 6799990100000000019".split()
)
EXAMPLE_DOMAINS = tuple(
    "example.com example.org example.net example.edu localhost localhost.localdomain invalid test local test.com test.net test.org testing.com demo.com sample.com fake.com dummy.com placeholder.com 10minutemail.com guerrillamail.com mailinator.com tempmail.org".split()
)
SERVICE_PREFIXES = tuple(
    "noreply no-reply donotreply do-not-reply admin administrator postmaster webmaster hostmaster info support help sales marketing contact abuse security privacy legal compliance billing accounts notifications alerts system daemon service robot bot automated".split()
)
_JAPANESE = re.compile("[぀-ヿ一-龯]")


def _count(near: Column, words: str) -> Column:
    """How many of the words occur: whole words, or anywhere for Japanese."""
    found = [near.contains(w.lower()) if _JAPANESE.search(w) else near.rlike(to_java(rf"\b{re.escape(w.lower())}\b")) for w in words.split()]
    return sum((f.cast("int") for f in found), F.lit(0))


def context_score(surrounding: Column, type_: str) -> Column:
    """1 plus 0.2 a positive word, less 0.4 a negative one, plus the type's rules; at least 0."""

    def scored(near: Column) -> Column:
        score = 1.0 + 0.2 * _count(near, POSITIVE.get(type_, "")) - 0.4 * _count(near, NEGATIVE)
        for pattern, value in TYPE_RULES.get(type_, ()):
            score = score + F.when(near.rlike(to_java(pattern)), value).otherwise(0.0)
        return F.greatest(F.lit(0.0), score)

    return let(F.lower(surrounding), scored)


#: Fixed patterns of form fields and of logs.
FORM_PATTERNS = (
    r"(?i)\b(input|field|form|label|placeholder|value)\b", r"(?i)\b(name|email|phone|address|card|number)\s*[:=]", r"(?i)<input[^>]*>", r"(?i)\btype\s*=\s*[\"']?(text|email|tel|number)",
)
LOG_PATTERNS = (
    r"(?i)\b(log|debug|trace|info|warn|error|fatal)\b", r"(?i)\b(console|print|echo|output)\b", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2}", r"(?i)\[(DEBUG|INFO|WARN|ERROR|TRACE)\]",
)


def setting_score(surrounding: Column) -> Column:
    """0.2 in structured data, 0.3 in a form field, -0.2 in a log, added up."""
    some = lambda patterns: reduce(or_, (surrounding.rlike(p) for p in patterns))
    structured = (surrounding.contains('"') & surrounding.contains(":")) | (surrounding.contains("<") & surrounding.contains(">")) | (F.size(F.split(surrounding, ",")) > 2)
    return F.when(structured, 0.2).otherwise(0.0) + F.when(some(FORM_PATTERNS), 0.3).otherwise(0.0) - F.when(some(LOG_PATTERNS), 0.2).otherwise(0.0)


def context_score_with_setting(surrounding: Column, type_: str) -> Column:
    return context_score(surrounding, type_) + setting_score(surrounding)


def complexity(value: Column) -> Column:
    """Kinds of characters, and a twentieth of the length up to two."""
    kinds = sum((value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")), F.lit(0))
    return kinds + F.least(F.length(value) / 20, F.lit(2.0))


def meets_threshold(score: Column, type_: str, strictness: str = "balanced") -> Column:
    return score >= NEEDED[strictness].get(type_, NEEDED[strictness][""])


def validate_card(value: Column, surrounding: Column, strictness: str = "balanced") -> Column:
    """The first reason against the card, or ``valid_<brand>``."""
    number = F.regexp_replace(value, r"[\s-]", "")
    size, careful = F.length(number), strictness != "fast"
    brand, fits = F.lit(None).cast("string"), F.lit(False)
    for name, prefix, lengths in reversed(BRANDS):
        brand = F.when(number.rlike(prefix), name).otherwise(brand)
        fits = F.when(number.rlike(prefix), size.isin(*lengths)).otherwise(fits)
    out = F.when(~size.between(13, 19), "invalid_length").when(~T.luhn(number), "luhn_failed")
    if careful:
        out = out.when(number.isin(*TEST_CARDS), "test_number").when(brand.isNull(), "unknown_brand").when(~fits, "invalid_brand_length")
    out = out.when(number.rlike(r"(\d)\1{3,}"), "repeated_digits").when(number.rlike("0123|1234|2345|3456|4567|5678|6789|9876|8765|7654|6543|5432|4321|3210"), "sequential_digits")
    if careful:
        bare = ~value.rlike(r"[\s-]") & (size == 16)
        out = out.when(bare & (context_score(surrounding, "credit_card") < (2.0 if strictness == "strict" else 1.2)), "bare_digits_weak_context")
        return out.otherwise(F.concat(F.lit("valid_"), brand))
    return out.otherwise("valid_unknown_brand")


def validate_email(value: Column, surrounding: Column, strictness: str = "balanced") -> Column:
    """(reason, confidence) of an email candidate."""
    local, domain = F.lower(F.substring_index(value, "@", 1)), F.lower(F.regexp_replace(value, "^[^@]*@", ""))
    tld = F.substring_index(domain, ".", -1)
    reason = F.when(~value.contains("@"), "no_at_symbol")
    if strictness != "fast":
        reason = reason.when(domain.isin(*EXAMPLE_DOMAINS), "example_domain")
    reason = reason.when(F.regexp_replace(local, "[.-]", "").isin(*SERVICE_PREFIXES), "non_pii_prefix").when(~domain.contains("."), "no_tld").when(~tld.rlike("^[a-z]{2,24}$"), "invalid_tld").otherwise("valid_email")
    score = F.least(F.lit(0.9), 0.6 + 0.15 * context_score(surrounding, "email"))
    return F.struct(reason.alias("reason"), F.when(reason == "valid_email", score).when(reason == "non_pii_prefix", 0.1).otherwise(0.0).alias("confidence"))


def is_valid(value: Column, type_: Column, surrounding: Column, strictness: str = "balanced") -> Column:
    """Cards and emails by their rules; other types and overlong candidates as they are."""
    known = F.when(type_ == "credit_card", validate_card(value, surrounding, strictness).startswith("valid_")).when(type_ == "email", validate_email(value, surrounding, strictness)["reason"] == "valid_email")
    return F.when(F.length(value) > 1000, False).otherwise(F.coalesce(known, F.lit(True)))
