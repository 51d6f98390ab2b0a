"""Field formats, dangerous content, sanitising and verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import column
from tidemark.operators.privacy import ascii_words

# Lengths, formats and patterns.
LENGTHS = {"ticket_id": 50, "username": 100, "search_term": 500, "description": 10000, "title": 500, "status": 50, "tag": 100, "lucene_query": 1000, "assignee": 100, "resolver_group": 200}
FORMATS = {
    "ticket_id": r"(?i)^[A-Z]{1,10}-?\d{1,15}$",
    "username": r"^[a-zA-Z0-9._-]{1,100}$",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "datetime_iso": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?(?:Z|[+-]\d{2}:\d{2})?$",
    "status": r"^[a-zA-Z\s_-]{1,50}$",
    "tag": r"^[a-zA-Z0-9\s._-]{1,100}$",
    "safe_text": r"^[a-zA-Z0-9\s.,!?()_-]{1,500}$",
    "assignee": r"^[a-zA-Z0-9._-]{1,100}$",
    "resolver_group": r"^[a-zA-Z0-9\s._-]{1,200}$",
}
INJECTION = [
    r"('|(\\')|(;)|(\\;))",
    r"((\%27)|(\'))((\%6F)|o|(\%4F))((\%72)|r|(\%52))",
    r"(union(\s|\+)+select)",
    r"(drop(\s|\+)+table)",
    r"(insert(\s|\+)+into)",
    r"(delete(\s|\+)+from)",
    r"(exec(\s|\+)+(s|x)p\w+)",
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"on\w+\s*=",
    r"<iframe[^>]*>",
    r"<object[^>]*>",
    r"<embed[^>]*>",
    r"eval\s*\(",
    r"exec\s*\(",
    r"\$\{.*\}",
    r"\{\{.*\}\}",
    r"<%.*%>",
    r"[;&|`$]",
    r"\.\./.*",
    r"\\x[0-9a-fA-F]{2}",
    r"%[0-9a-fA-F]{2}",
]
DANGERS = {
    "Script tag injection": r"<script[^>]*>.*?</script>",
    "JavaScript URL injection": r"javascript:",
    "Event handler injection": r"on\w+\s*=",
    "Iframe injection": r"<iframe[^>]*>",
    "Object tag injection": r"<object[^>]*>",
    "Embed tag injection": r"<embed[^>]*>",
    "eval() function call": r"eval\s*\(",
    "exec() function call": r"exec\s*\(",
    "system() function call": r"system\s*\(",
    "shell_exec() function call": r"shell_exec\s*\(",
    "Template injection (${})": r"\$\{.*\}",
    "Template injection ({{}})": r"\{\{.*\}\}",
    "Template injection (<%%>)": r"<%.*%>",
    "SQL injection characters": r"('|(\\')|(;)|(\\;))",
    "SQL 'or injection": r"((\%27)|(\'))((\%6F)|o|(\%4F))((\%72)|r|(\%52))",
    "SQL UNION SELECT": r"union(\s|\+)+select",
    "SQL DROP TABLE": r"drop(\s|\+)+table",
    "SQL INSERT INTO": r"insert(\s|\+)+into",
    "SQL DELETE FROM": r"delete(\s|\+)+from",
    "SQL UPDATE SET": r"update(\s|\+)+.*set",
    "Command injection characters": r"[;&|`$]",
    "Command substitution": r"\$\(.*\)",
    "Backtick command execution": r"`.*`",
    "Path traversal (../)": r"\.\./",
    "Path traversal (..\\)": r"\.\.\\",
    "Encoded path traversal": r"%2e%2e%2f",
    "Encoded path traversal (backslash)": r"%2e%2e%5c",
    "LDAP injection characters": r"[()&|!]",
    "XML entity injection": r"<!ENTITY",
    "XML DOCTYPE injection": r"<!DOCTYPE",
    "NoSQL $where injection": r"\$where",
    "NoSQL $ne injection": r"\$ne",
    "NoSQL $gt injection": r"\$gt",
    "NoSQL $regex injection": r"\$regex",
}
#: What any match has: of INJECTION one of these characters, of DANGERS one of these or of the next; or, of both, the letters after the first of a word of SQL and what parts it from the next word.
_MARKS, _MORE_MARKS, _WORDS = r"['%;<:=({&|`$/\\]", r"['%;<:=({&|`$/\\)!]", r"(?i)[uide](?:nion|rop|nsert|elete|xec|pdate)[\s+]"
SUSPICIOUS = r"[<>{}$`\\;|&]"
VERDICTS = ("VALID", "SUSPICIOUS", "INVALID")
SQL_WORDS = "DROP|DELETE|INSERT|UPDATE|CREATE|ALTER|EXEC|EXECUTE|TRUNCATE|GRANT|REVOKE"


def matches(c: str | Column, patterns: Mapping[str, str] | Sequence[str]) -> Column:
    """Names of the patterns found, case left aside, lines taken together."""
    named = patterns.items() if isinstance(patterns, Mapping) else [(f"injection_{i + 1}", p) for i, p in enumerate(patterns)]
    return F.array_compact(F.array(*[F.when(column(c).rlike(f"(?is){p}"), F.lit(n)) for n, p in named]))


def _once(c: str | Column, of: Callable[[Column], Column]) -> Column:
    """of(text), with a text that is computed once a row however often it is named."""
    return F.get(F.transform(F.array(column(c)), of), F.lit(0))


def _any(t: Column, patterns: Iterable[str], marks: str) -> Column:
    """Whether a pattern is found, as :func:`matches` tells; they run over texts only that have what any match has."""
    found = reduce(lambda a, b: a | b, [t.rlike(f"(?is){p}") for p in patterns])
    return F.when(t.rlike(marks) | t.rlike(_WORDS), found).otherwise(False)


def field_errors(c: str | Column, kind: str) -> Column:
    """What is wrong with a field of a kind: empty, too long, badly formed, dangerous."""

    def errors(t: Column) -> Column:
        tests = [(F.trim(F.coalesce(t, F.lit(""))) == "", "empty"), (F.length(t) > LENGTHS.get(kind, 1000), "too_long")]
        if kind in FORMATS:
            tests.append((~F.coalesce(t, F.lit("")).rlike(FORMATS[kind]), "bad_format"))
        tests.append((_any(t, INJECTION, _MARKS), "dangerous"))
        return F.array_compact(F.array(*[F.when(x, F.lit(n)) for x, n in tests]))

    return _once(c, errors)


def raw_errors(iso: str = FORMATS["datetime_iso"]) -> Column:
    """What is wrong with a raw record, as field:error."""
    of = lambda name, errors: F.transform(errors, lambda e: F.concat(F.lit(f"{name}:"), e))
    parts = [of(f, field_errors(f, k)) for f, k in (("id", "ticket_id"), ("title", "title"), ("status", "status"))]
    given = lambda f: ~F.coalesce(F.col(f) == "", F.lit(True))
    none = F.array().cast("array<string>")
    parts.append(F.when(given("assignee"), of("assignee", field_errors("assignee", "assignee"))).otherwise(none))
    parts.append(F.when(F.length("description") > LENGTHS["description"], F.array(F.lit("description:too_long"))).otherwise(none))
    parts += [F.when(given(f) & ~F.col(f).rlike(iso) & ~F.col(f).rlike(FORMATS["date_iso"]), F.array(F.lit(f"{f}:bad_format"))).otherwise(none) for f in ("createDate", "lastUpdatedDate", "lastResolvedDate")]
    return F.concat(*parts)


def batches_valid(raw: DataFrame, batch: str) -> DataFrame:
    """Whether all records of each batch are valid."""
    return raw.groupBy(batch).agg(F.bool_and(F.size(raw_errors()) == 0).alias("all_valid"), F.count("*").alias("n"))


def missing_fields(c: Mapping[str, Column] | Sequence[str]) -> Column:
    """Required fields that a row lacks."""
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in c]))


def verdict(c: str | Column, kind: str = "search_term") -> Column:
    """VALID, SUSPICIOUS or INVALID by content."""
    odd = lambda t: t.rlike(SUSPICIOUS) if kind not in ("safe_text", "json_data") else F.lit(False)
    return _once(c, lambda t: F.when(_any(t, DANGERS.values(), _MORE_MARKS), "INVALID").when(odd(t), "SUSPICIOUS").otherwise("VALID"))


def ordinal(v: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS)), v)


def worst(*verdicts: Column) -> Column:
    """(D22)"""
    ranks = [ordinal(v) for v in verdicts]
    most = ranks[0] if len(ranks) == 1 else F.greatest(*ranks)
    return F.element_at(F.array(*map(F.lit, VERDICTS)), most.cast("int"))


def in_context(v: Column, source: Column) -> Column:
    """What comes from outside must not even be suspicious."""
    return F.when((source == "external_api") & (v == "SUSPICIOUS"), "INVALID").otherwise(v)


# What goes from a field of each kind, what replaces it in safe texts and file paths.
UNSAFE_AGGRESSIVE = r"[^\w\s.,!?()-]"
UNSAFE = {
    "search_term": (r"[<>{}$`\\;|&]",),
    "lucene_query": (r"(?is)<script[^>]*>.*?</script>", r"(?i)javascript:", r"(?i)\b(union|select|drop|insert|delete|exec)\b", r"[;&|`$]", r"[<>]"),
    "ticket_id": (r"[^a-zA-Z0-9._-]",),
    "username": (r"[^a-zA-Z0-9._-]",),
    "assignee": (r"[^a-zA-Z0-9._-]",),
    "safe_text": (r"[\x00-\x1f\x7f-\x9f]",),
    "file_path": (r"\.\./", r"\.\.\\"),
    "command": (r"[;&|`$()]", r"[\x00-\x1f\x7f-\x9f]"),
}
ESCAPED = {"safe_text": (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))}
TRIMMED = ("search_term", "safe_text", "file_path", "sql_query", "command")


def sanitized(c: str | Column, kind: str, aggressive: bool = False) -> Column:
    """A field made safe for its kind."""
    t = F.regexp_replace(F.trim(column(c)), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    t = F.regexp_replace(t, r"\s+", " ")
    for a, b in ESCAPED.get(kind, ()):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = _without(t, (UNSAFE_AGGRESSIVE,) if aggressive and kind == "search_term" else UNSAFE.get(kind, ()))
    if kind == "url":
        t = F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    elif kind == "file_path":
        t = F.replace(t, F.lit("\\"), F.lit("/"))
    elif kind == "sql_query":
        t = F.regexp_replace(t, ascii_words(rf"(?i)\b({SQL_WORDS})\b"), "[REDACTED]")
    return F.left(F.trim(t) if kind in TRIMMED else t, F.lit(LENGTHS.get(kind, 1000)))


def _without(t: Column, patterns: Sequence[str]) -> Column:
    for p in patterns:
        t = F.regexp_replace(t, ascii_words(p), "")
    return t


def report(df: DataFrame, c: str, kind: str = "search_term") -> DataFrame:
    """Counts by verdict."""
    return df.groupBy(verdict(c, kind).alias("verdict")).agg(F.count("*").alias("n"))


def danger_counts(df: DataFrame, c: str) -> DataFrame:
    """Counts by danger."""
    return df.select(F.explode(matches(c, DANGERS)).alias("danger")).groupBy("danger").agg(F.count("*").alias("n"))
