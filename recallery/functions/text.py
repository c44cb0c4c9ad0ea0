"""Text functions as column expressions (O-64..O-66, O-200..O-234)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the query normaliser and of the keyword index.
SENTENCE_BREAKS = r"[.\n!?]"
SEARCH_TOKEN = r"[A-Za-z0-9][A-Za-z0-9._:/#-]{1,}"


def words(text: Column) -> Column:
    """O-200: lower-case words between white space."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def alnum(text: Column) -> Column:
    """O-201: letters and digits only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def tokens3(text: Column) -> Column:
    """O-202: lower-case runs of letters and digits of three bytes or more."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 3)


def sentences(text: Column) -> Column:
    """O-203: trimmed sentences that are not empty."""
    parts = F.transform(F.split(text, SENTENCE_BREAKS), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.array_remove(parts, "")


def keywords(text: Column, longer_than: int = 3, most: int = 50) -> Column:
    """O-204: distinct alphanumeric words longer than a bound, sorted, the first ones."""
    cleaned = F.transform(words(text), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.slice(F.array_sort(F.array_distinct(F.filter(cleaned, lambda w: F.octet_length(w) > longer_than))), 1, most)


def summary(text: Column, most: int = 400, mark: str = "...") -> Column:
    """O-205: the first characters, with a mark if something is left out."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def token_savings(full: Column, short: Column) -> Column:
    """O-206: percentage of bytes saved; 0 where nothing is saved."""
    return F.when(F.octet_length(full) > F.octet_length(short), 100.0 * (F.octet_length(full) - F.octet_length(short)) / F.octet_length(full)).otherwise(F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    """O-213: share of common elements of two arrays; 0 if either is empty."""
    both = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / both)


def slug(text: Column) -> Column:
    """O-215: lower-case words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def estimate_tokens(text: Column) -> Column:
    """O-216: a quarter of the bytes, at least one."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("long")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    if not term:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def search_tokens(text: Column) -> Column:
    """O-64: query tokens, distinct without regard to case, the first spelling kept."""
    found = F.regexp_extract_all(text, F.lit(f"({SEARCH_TOKEN})"))
    return F.filter(found, lambda t, i: F.array_position(F.transform(found, F.lower), F.lower(t)) == i + 1)


def code_tokens(text: Column) -> Column:
    """O-65: parts of tokens between marks and at camel-case humps, lower-case, distinct, two characters or more."""
    humps = F.transform(search_tokens(text), lambda t: F.regexp_replace(t, r"([a-z])([A-Z])", "$1 $2"))
    parts = F.flatten(F.transform(humps, lambda t: F.split(F.lower(t), r"[^a-z0-9]+")))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) > 1))


def names_entity(token: Column) -> Column:
    """O-66: a digit, a hyphen, an underscore or a capital in it."""
    return token.rlike(r"[0-9A-Z_-]")


def query_entities(text: Column) -> Column:
    """O-66: tokens that name entities."""
    return F.filter(search_tokens(text), names_entity)


def stable_key(kind: str, *parts: Column) -> Column:
    """O-232: SHA-256 over the kind and the parts, each part after a zero byte."""
    return F.sha2(F.concat(F.lit(kind), *[F.concat(F.lit("\0"), p) for p in parts]), 256)


def entropy(text: Column) -> Column:
    """O-230: Shannon entropy of the characters in bits, for ASCII texts the entropy of the bytes."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(letters)
    share = lambda c: F.size(F.filter(letters, lambda d: d == c)) / n
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def bigrams(parts: Column) -> Column:
    """O-233: neighbouring elements joined by a space."""
    pairs = F.zip_with(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(parts) > 1, pairs).otherwise(F.array().cast("array<string>"))


#: What is redacted, in this order, and its replacement. Site-specific names come as parameters.
REDACTIONS = [
    (r"\b(192\.168\.\d{1,3}\.\d{1,3}|10\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", "[internal-host]"),
    (r"(?i)localhost:\d+", "[internal-service]"),
    (r"(?i)(api[_-]?key|token|password|secret|credential)[ \t]*[:=][ \t]*[a-zA-Z0-9_\-\.]{8,}", "[REDACTED]"),
    (r"(?i)\b(CVE-\d{4}-\d+)\b", "[vulnerability-patched]"),
]


def redact(text: Column, rules: list[tuple[str, str]] = REDACTIONS) -> Column:
    """O-214: ordered replacements."""
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, text)


def is_clean(text: Column, rules: list[tuple[str, str]] = REDACTIONS) -> Column:
    """O-214: no rule matches any more."""
    return ~reduce(lambda a, b: a | b, [text.rlike(r[0]) for r in rules])


#: Ordered patterns for training texts (O-288).
TRAINING_SECRETS = [
    (r"API_KEY[^:\n]{1,50}[a-zA-Z0-9\-_]{20,}", "[API_KEY_REDACTED]"),
    (r"tvly-dev-[a-zA-Z0-9]{20,}", "[TAVILY_KEY_REDACTED]"),
    (r"BSA[a-zA-Z0-9]{20,}", "[BRAVE_KEY_REDACTED]"),
    (r"password[\x22\s:]{1,3}[^\s,]{8,}", "[PASSWORD_REDACTED]"),
    (r"secret[\x22\s:]{1,3}[^\s,]{8,}", "[SECRET_REDACTED]"),
    (r"Bearer\s+[a-zA-Z0-9\-_]{20,}", "[TOKEN_REDACTED]"),
]


def parse_time(text: Column) -> Column:
    """O-220: RFC 3339 or a date; anything else is null."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def age_days(since: Column, as_of: Column) -> Column:
    """O-224: whole days, not negative."""
    return F.greatest(F.lit(0), F.floor((as_of.cast("double") - since.cast("double")) / 86400)).cast("long")
