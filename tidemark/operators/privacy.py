"""Personal data and credentials in text columns: folds of regular expressions. (L)

Order counts: each replacement is seen by the next. Patterns have no look-around
or back-references, and use ASCII classes; so do their word boundaries, see
:func:`ascii_words`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import column

#: Where a word of ASCII letters, digits and underscores begins or ends.
_EDGE = r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))"


def ascii_words(regex: str) -> str:
    """The pattern with boundaries of ASCII words for its ``\\b``, which before Java 19 takes letters of all scripts for parts of words, though ``\\w`` doesn't."""
    return re.sub(r"\\.", lambda m: _EDGE if m[0] == r"\b" else m[0], regex, flags=re.DOTALL)


def any_engine(regex: str) -> str:
    """The pattern as it was before :func:`ascii_words`, for engines whose ``\\b`` is of ASCII words and that have no look-around."""
    return regex.replace(_EDGE, r"\b")


# Patterns, replacements, levels and names.
PII = {
    "email": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone_us": r"(\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    "phone_international": r"\+[1-9]\d{1,14}",
    "ssn": r"\b\d{3}-?\d{2}-?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "ipv6_address": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "mac_address": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "aws_account": r"\b\d{12}\b",
    "uuid": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    "api_key": r"\b[A-Za-z0-9+/]{32,}={0,2}\b",
    "base64_token": r"\b[A-Za-z0-9+/]{20,}={0,2}\b",
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "aws_secret_key": r"\b[A-Za-z0-9/+=]{40}\b",
}
PII = {n: ascii_words(p) for n, p in PII.items()}
LEVELS = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class Rule:
    pattern: str
    replacement: str
    level: str = "medium"
    ignore_case: bool = True

    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case and not self.pattern.startswith("(?i)") else self.pattern


RULES = (
    Rule(PII["email"], "[EMAIL_REDACTED]", "high"), Rule(PII["phone_us"], "[PHONE_REDACTED]", "high"), Rule(PII["phone_international"], "[PHONE_REDACTED]", "high"), Rule(PII["ssn"], "[SSN_REDACTED]", "critical"),
    Rule(PII["credit_card"], "[CARD_REDACTED]", "critical"), Rule(PII["ip_address"], "[IP_REDACTED]", "medium"), Rule(PII["ipv6_address"], "[IPV6_REDACTED]", "medium"), Rule(PII["mac_address"], "[MAC_REDACTED]", "medium"),
    Rule(PII["aws_account"], "[ACCOUNT_REDACTED]", "high"), Rule(PII["uuid"], "[UUID_REDACTED]", "medium"), Rule(PII["api_key"], "[TOKEN_REDACTED]", "critical"), Rule(PII["aws_access_key"], "[AWS_ACCESS_KEY_REDACTED]", "critical"),
    Rule(PII["aws_secret_key"], "[AWS_SECRET_REDACTED]", "critical"), Rule(r"/home/[^/\s]+/[^\s]*", "[HOME_PATH_REDACTED]", "low"), Rule(r'password["\s]*[:=]["\s]*[^\s"]+', "password=[PASSWORD_REDACTED]", "critical"),
)
SENSITIVE = frozenset(
    "password passwd pwd token secret key auth credential private_notes internal_comments confidential personal_info contact_info phone email ssn social_security credit_card payment_info api_key access_token refresh_token session_id cookie authorization bearer private_key public_key".split()
)
ERROR_RULES = ((r"/[^\s]*/tidemark/[^\s]*", "[PATH_REDACTED]"), (r'File "[^"]*", line [0-9]+', 'File "[REDACTED]", line [REDACTED]'))
KEY_VALUE_RULES = tuple((rf'(?i){w}["\s]*[:=]["\s]*[^\s"]+', f"[{w.upper()}_REDACTED]") for w in ("password", "token", "secret", "key", "auth", "credential"))
LOG_RULES = tuple(
    (p, "[SENSITIVE_DATA_REDACTED]")
    for p in (
        r"(?i)(token|auth|credential|password|secret|key)\s*[:=]\s*[^\s]+", r"(?i)(api[_-]?key|access[_-]?token|bearer)\s*[:=]\s*[^\s]+", r"(?i)(session[_-]?id|cookie)\s*[:=]\s*[^\s]+",
        r"(?i)(connection[_-]?string|db[_-]?url)\s*[:=]\s*[^\s]+", r"/home/[^/\s]+/\.[^/\s]*", r"--(?:password|token|key|secret)\s+[^\s]+",
    )
)
_CRITICAL, _HIGH = ("ssn", "credit_card", "aws_secret_key", "api_key"), ("email", "phone_us", "phone_international", "aws_access_key")


#: Signs of which any match of a pattern has one: each is looked for once a text, whatever the number of patterns.
AT, PLUS, DIGITS, LINKED, LONG, SLASH, ASSIGNED = (1 << i for i in range(7))
#: Nine digits with few separators between; hexadecimal digits, one to four between two joiners; a run of 20 letters of tokens.
_DIGITS, _LINKED, _LONG = r"[0-9](?:[-.\s()]{0,3}[0-9]){8}", r"[0-9A-Fa-f][:.-][0-9A-Fa-f]{1,4}[:.-][0-9A-Fa-f]", r"[A-Za-z0-9+/=]{20}"
_NEEDS = {"email": AT, "phone_us": DIGITS, "phone_international": PLUS, "ssn": DIGITS, "credit_card": DIGITS, "ip_address": LINKED, "ipv6_address": LINKED, "mac_address": LINKED, "aws_account": DIGITS, "uuid": LINKED}
#: The sign that each fixed pattern needs; those that aren't here need a long run.
NEEDS = {PII[k]: _NEEDS.get(k, LONG) for k in PII} | {r.pattern: SLASH if r.pattern.startswith("/home") else ASSIGNED for r in RULES if r.pattern not in PII.values()}


def _needs(regex: str) -> int | None:
    return NEEDS.get(regex, NEEDS.get(regex.removeprefix("(?i)")))


def signs(t: Column) -> Column:
    """The bits of the signs that a text has."""
    has = lambda x: F.contains(t, F.lit(x))
    digit = reduce(lambda a, b: a | b, [has(x) for x in "0123456789"])
    # patterns only where a search for single bytes doesn't rule them out; addresses by dots alone have digits
    found = {AT: has("@"), PLUS: has("+"), DIGITS: digit & t.rlike(_DIGITS), LINKED: (digit | has(":") | has("-")) & t.rlike(_LINKED), LONG: t.rlike(_LONG), SLASH: has("/"), ASSIGNED: has("=") | has(":")}
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, bit).otherwise(0) for bit, c in found.items()])


def _bound(c: str | Column, of: Callable[[Column, Column], Column]) -> Column:
    """of(text, bits): the bits are found once a row, so that a pattern runs over texts only that have its sign."""
    once = F.array(F.struct(column(c).alias("text"), signs(column(c)).alias("bits")))
    return F.get(F.transform(once, lambda x: of(x["text"], x["bits"])), F.lit(0))


def _may(bits: Column, regex: str) -> Column:
    return bits.bitwiseAND(F.lit(_needs(regex))) != 0


def _guarded(t: Column, bits: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """As :func:`fold`, each of the fixed patterns where its sign is. What replaces a match has no sign of another pattern, and keeps apart what stood on its two sides."""
    step = lambda p, r: lambda x: F.when(_may(bits, p), F.regexp_replace(x, p, r)).otherwise(x)
    out = t
    for pattern, replacement in pairs:
        out = F.get(F.transform(F.array(out), step(pattern, replacement)), F.lit(0))  # bound, as the text is named twice
    return out


def fold(c: str | Column, pairs: Iterable[tuple[str, str]]) -> Column:
    out = column(c)
    for pattern, replacement in pairs:
        out = F.regexp_replace(out, ascii_words(pattern), replacement)
    return out


def detected(c: str | Column) -> Column:
    """Kinds of personal data in a text. (L1)"""
    return _bound(c, lambda t, bits: F.array_compact(F.array(*[F.when(_may(bits, p), F.when(t.rlike(p), F.lit(n))) for n, p in PII.items()])))


def counts(c: str | Column) -> dict[str, Column]:
    """Matches of each kind. (L2)"""
    return {n: _counted(c)[n] for n in PII}


def _counted(c: str | Column) -> Column:
    """Matches of each kind, as one struct."""
    return _bound(c, lambda t, bits: F.when(t.isNotNull(), F.struct(*[F.when(_may(bits, p), F.regexp_count(t, F.lit(p))).otherwise(0).alias(n) for n, p in PII.items()])))


def redact_pii(c: str | Column) -> Column:
    """(L3)"""
    return _bound(c, lambda t, bits: _guarded(t, bits, [(p, f"[{n.upper()}_REDACTED]") for n, p in PII.items()]))


def applied(rules: Sequence[Rule], threshold: str = "low", legacy: bool = False) -> list[Rule]:
    """Rules at or above a level; legacy compares the levels' names as text and skips those at or above. (L4)"""
    if legacy:
        return [r for r in rules if not r.level >= threshold]
    return [r for r in rules if LEVELS.index(r.level) >= LEVELS.index(threshold)]


def redact(c: str | Column, threshold: str = "low", extra: Sequence[Rule] = (), legacy: bool = False) -> Column:
    """By rules, custom ones last."""
    pairs = lambda rules: [(r.regex(), r.replacement) for r in applied(rules, threshold, legacy)]
    return fold(_bound(c, lambda t, bits: _guarded(t, bits, pairs(RULES))), pairs(extra))


def is_sensitive(name: str) -> bool:
    return name.lower() in SENSITIVE or any(s in name.lower() for s in SENSITIVE)


def redact_either(c: str | Column, threshold: str = "low") -> Column:
    """Personal data if there is any, else by rules."""
    pairs = [(p, f"[{n.upper()}_REDACTED]") for n, p in PII.items()]
    rules = [(r.regex(), r.replacement) for r in applied(RULES, threshold)]
    found = lambda t, bits: reduce(lambda a, b: a | b, [F.when(_may(bits, p), t.rlike(p)).otherwise(False) for p in PII.values()])
    return _bound(c, lambda t, bits: F.when(found(t, bits), _guarded(t, bits, pairs)).otherwise(_guarded(t, bits, rules)))


def _walk(c: Column, kind: T.DataType, text) -> Column:
    if isinstance(kind, T.StringType):
        return text(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _walk(x, kind.elementType, text))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        low = lambda k: F.lower(k)
        secret = lambda k: F.exists(F.array(*[F.lit(s) for s in sorted(SENSITIVE)]), lambda s: F.contains(low(k), s))
        gone = F.lit("[REDACTED]") if isinstance(kind.valueType, T.StringType) else F.lit(None).cast(kind.valueType)
        return F.transform_values(c, lambda k, v: F.when(secret(k), gone).otherwise(_walk(v, kind.valueType, text)))
    if isinstance(kind, T.StructType):
        out = c
        for f in kind.fields:
            new = _gone(f.dataType) if is_sensitive(f.name) else _walk(c[f.name], f.dataType, text)
            out = out.withField(f"`{f.name}`", new)
        return F.when(c.isNotNull(), out)
    return c


def _gone(kind: T.DataType) -> Column:
    return F.lit("[REDACTED]") if isinstance(kind, T.StringType) else F.lit(None).cast(kind)


def redact_records(df: DataFrame, threshold: str = "low", pii_first: bool = False) -> DataFrame:
    """Every text in every column, nested ones too; columns, fields and map keys with sensitive names lose their values."""
    text = (lambda c: redact_either(c, threshold)) if pii_first else (lambda c: redact(c, threshold))
    return df.select(*[(_gone(f.dataType) if is_sensitive(f.name) else _walk(F.col(f"`{f.name}`"), f.dataType, text)).alias(f.name) for f in df.schema])


def report(df: DataFrame, c: str) -> DataFrame:
    """Counts, rules hit, risk and recommendations of each row's text."""
    hits = lambda t, bits: sum((F.when(_may(bits, r.pattern), F.coalesce(t.rlike(r.regex()).cast("int"), F.lit(0))).otherwise(0) for r in RULES), F.lit(0))
    # one struct of counts a row, read by all that follows
    out = df.withColumns({"_n": _counted(c), "rules_hit": _bound(c, hits)})
    out = out.withColumns({f"n_{k}": F.col("_n")[k] for k in PII}).drop("_n")
    has = lambda *names: F.greatest(*[F.col(f"n_{k}") for k in names], F.lit(0)) > 0
    out = out.withColumn("n_pii", sum((F.col(f"n_{k}") for k in PII), F.lit(0)))
    risk = F.when(has(*_CRITICAL), "CRITICAL").when(has(*_HIGH), "HIGH").when(F.col("n_pii") > 0, "MEDIUM").otherwise("LOW")
    # fixed values: the sentences
    advice = [
        (has("ssn"), "Remove Social Security Numbers immediately"), (has("credit_card"), "Remove credit card numbers immediately"), (has("aws_secret_key", "api_key"), "Rotate compromised API keys/secrets"),
        (has("email", "phone_us", "phone_international"), "Consider masking contact information"),
    ]
    some = F.array_compact(F.array(*[F.when(x, F.lit(s)) for x, s in advice]))
    return out.withColumns({"risk": risk, "recommendations": F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("No critical PII detected, but continue monitoring")))})


def redact_error(c: str | Column) -> Column:
    """(L10)"""
    return fold(redact(c), ERROR_RULES)


def redact_log(c: str | Column, debug: bool = False) -> Column:
    """Credentials in log lines."""
    return fold(fold(c, KEY_VALUE_RULES), LOG_RULES) if debug else fold(c, KEY_VALUE_RULES)
