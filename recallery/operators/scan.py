"""Text threat scanning (O-240..O-254): one array of findings for each row, in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallery.functions import text as tx

#: Phrases of the first layer, in lower case where they can match (texts are lower-cased first).
PHRASES = [
    "ignore all previous instructions", "ignore all prior instructions", "forget everything above", "forget all previous instructions", "disregard prior instructions",
    "disregard all instructions", "override your instructions", "new instructions:", "override system prompt",
    "you are now dan", "you are now jailbroken", "pretend you are", "switch to", "act as", "roleplay as", "you are now a", "you are now in", "enter developer mode", "developer mode activated",
    "do anything now", "without restrictions", "no restrictions", "bypass limitations", "ignore all rules",
    "reveal your instructions", "show your system prompt", "what are your guidelines", "what are your instructions", "repeat your system prompt", "print your instructions", "show hidden instructions",
    "forget your guidelines", "ignore your values", "disregard your rules", "your rules are suspended", "all bets are off",
    "let's play a game", "pretend we are", "imagine you are", "as an ai without", "as a language model without",
    "decrypt this", "decode this", "translate from", "{{", "}}", "{{.", "{%", "%}",
]
#: Patterns of the other layers.
ROLE_SWITCH = r"(?i)(^|\n)\s*(system|assistant|user)\s*:"
ESCALATION = [
    r"(?i)(give me|grant me|elevate to)\s*(admin|root|moderator)", r"(?i)(bypass|disable|turn off)\s*(security|filter|guard|protection)", r"(?i)(ignore|disregard)\s*(all\s+)?(rules|restrictions|safety)",
    r"(?i)(unlock|open)\s*(admin|root|dev)", r"(?i)sudo\s+", r"(?i)\.\.\.\s*admin\s*\.\.\.",
]
SOCIAL = [
    r"(?i)(you (must|have to|need to)|I (need|must|require)).*(urgent|immediately|asap)", r"(?i)(trust me|believe me|I'?m (your |a )?(friend|developer|admin))",
    r"(?i)(this is (safe|secure|okay)|don'?t worry|won'?t hurt)", r"(?i)(just|simply)\s+(do|run|execute)\s+(it|this|that)", r"(?i)(quick|fast|one second|just a minute)",
    r"(?i)(don'?t tell|no one needs to know|keep (this|it) (secret|quiet))", r"(?i)pretend\s+(you are|we are)",
]
APPROVAL = [
    r"(?i)(already approved|previously approved|authorized|pre-approved)", r"(?i)(clearance|permission|approval)\s+(granted|given|received)", r"(?i)verified\s+(by|with)\s+(admin|system|security)",
    r"(?i)(security|admin)\s+(verified|cleared|approved)",
]
TRAVERSAL, SEPARATORS = r"(?i)(\.\.[/\\]|%2e%2e|\\|/etc/passwd|C:\\Windows|C:\\boot)", r"[/\\]{2,}"
CANARIES = ["__CANARY__", "__VERIFIED__", "__TRUSTED__", "__SECURE__", "__AUTHORIZED__"]
LEAKS = [(r"(?i)from:\s*(codex|claude|gemini|gpt)", "agent_reference"), (r"(?i)session:\s*[a-zA-Z0-9-]{20,}", "session_leak"), (r"(?i)context_id:\s*[a-zA-Z0-9-]{20,}", "context_id_leak")]
HIJACKS = [r"(?i)use\s+(exec|run|shell)\s+as", r"(?i)alias\s+\w+\s*=\s*(exec|run|shell)", r"(?i)override\s+(exec|run|shell)", r"(?i)fake\s+(exec|run|shell)", r"(?i)inject\s+(exec|run|shell)"]
CONFIG = [r"(?i)(set|change|modify)\s+(env|variable|config)", r"(?i)(export|define)\s+\w+=", r"(?i)(disable|turn off)\s+\w+\s*(auth|security)", r"(?i)(override|replace)\s+(config|settings)", r"(?i)(inject|insert)\s+(config|env)"]
SECRET_KEYS = ["KEY", "SECRET", "TOKEN", "PASSWORD"]
SECRET_PATTERNS = [r"AKIA[0-9A-Z]{16}", r"ghp_[A-Za-z0-9]{36}", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", r"(?i)(?:api[_-]?key|token|secret|password)[ \t]*[:=][ \t]*[\"']?[A-Za-z0-9_\-]{16,}"]
FORBIDDEN_HOSTS = ["169.254.169.254", "metadata.google.internal", "localhost", "127.0.0.1", "0.0.0.0"]
TOOL_NAMES = [
    "exec", "run", "shell", "bash", "cmd", "powershell", "read", "write", "edit", "delete", "mkdir", "rmdir", "http", "fetch", "curl", "wget", "request", "sql", "query", "database", "db", "file",
    "path", "glob", "find", "git", "clone", "commit", "push", "pull", "ssh", "connect", "telnet", "ftp", "sudo", "su", "chmod", "chown", "env", "var", "config", "settings", "key", "secret", "token",
    "auth", "eval", "execute",
]
#: Latin letters and the Cyrillic ones that look like them.
LOOKALIKES = [("a", "а"), ("e", "е"), ("o", "о"), ("p", "р"), ("c", "с"), ("y", "у"), ("x", "х"), ("k", "к"), ("m", "м"), ("t", "т"), ("b", "в")]
_WINDOW = 40


def _finding(test: Column, layer: str, severity: float) -> Column:
    return F.when(test, F.struct(F.lit(layer).alias("layer"), F.lit(severity).alias("severity")))


def known_phrases(text: Column) -> Column:
    """O-240: how many of the phrases occur."""
    lower = F.lower(text)
    return reduce(lambda a, b: a + b, [lower.contains(p).cast("int") for p in PHRASES])


def decoded_views(text: Column) -> Column:
    """O-241: what runs of Base64 and hexadecimal digits and the URL-decoded text say; undecodable runs are left out."""
    runs64 = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9+/]{16,}={0,2})"))
    runs16 = F.regexp_extract_all(text, F.lit(r"\b((?:[0-9A-Fa-f]{2}){8,})\b"))
    even = lambda r: F.when(F.length(F.rtrim(r, F.lit("="))) % 4 == 1, None).otherwise(F.rpad(F.rtrim(r, F.lit("=")), (F.ceil(F.length(F.rtrim(r, F.lit("="))) / 4) * 4).cast("int"), F.lit("=")))
    plain = lambda b: F.try_validate_utf8(b.cast("string"))
    views = F.concat(F.transform(runs64, lambda r: plain(F.try_to_binary(even(r), F.lit("base64")))), F.transform(runs16, lambda r: plain(F.unhex(r))), F.array(F.try_url_decode(text)))
    return F.filter(views, lambda v: v.isNotNull())


def secret_findings(text: Column) -> Column:
    """O-242: number of matches of the secret patterns."""
    return reduce(lambda a, b: a + b, [F.size(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))) for p in SECRET_PATTERNS])


def secret_found(text: Column) -> Column:
    """O-242: whether any of the secret patterns matches."""
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in SECRET_PATTERNS])


def caps_ratio(text: Column) -> Column:
    """O-244: share of all-capital words; 0 for fewer than four words."""
    words = F.regexp_count(text, F.lit(r"(?<!\S)[^A-Za-z\s]*[A-Za-z]"))
    capital = F.regexp_count(text, F.lit(r"(?<!\S)[^a-z\s]*[A-Z][^a-z\s]*(?!\S)"))
    return F.when(words >= 4, capital / words).otherwise(F.lit(0.0))


def heuristics(text: Column) -> list[Column]:
    """O-244: shouting, double spaces, repeated marks, zero bytes, role switches."""
    return [
        _finding(caps_ratio(text) > 0.7, "caps", 0.4), _finding(text.contains("  "), "spacing", 0.2), _finding(text.rlike(r"[!?.]{4,}"), "punctuation", 0.3),
        _finding(text.contains("\0"), "null_byte", 0.8), _finding(text.rlike(ROLE_SWITCH), "role_switch", 0.7),
    ]


def entropy_regions(text: Column, threshold: float = 4.5, most: int = _WINDOW) -> Column:
    """O-243: runs of eight or more letters, digits and ``/+=`` of high entropy, up to forty characters (longer ones are keys)."""
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9/+=]{8,})"))
    # a run of n characters has at most log2(n) bits, so short ones are out before anything is counted
    return F.filter(F.filter(runs, lambda r: (F.length(r) <= most) & (F.length(r) >= 2**threshold)), lambda r: tx.entropy(r) >= threshold)


def lookalikes(text: Column) -> Column:
    """O-245: how many pairs of a Latin and a Cyrillic letter that look alike both occur, four times or more together."""
    low = F.lower(text)
    count = lambda c: F.length(low) - F.length(F.translate(low, c, ""))
    pair = lambda a, b: F.when(low.contains(b) & low.contains(a) & (count(a) + count(b) >= 4), 1).otherwise(0)
    return reduce(lambda a, b: a + b, [pair(a, b) for a, b in LOOKALIKES])


def not_composed(text: Column) -> Column:
    """O-245: combining marks that NFC would join with the letter before them."""
    return text.rlike("[A-Za-z\u00c0-\u024f][\u0300-\u0304\u0306-\u030c\u0323\u0327\u0328]") | text.rlike("[\u212a\u212b\u2126]")


def unicode_tricks(text: Column) -> list[Column]:
    """O-245: Latin with Cyrillic letters, marks for right-to-left text, zero-width characters, lookalikes, texts that are not composed."""
    return [
        _finding(text.rlike(r"[A-Za-z]") & text.rlike("[\u0410-\u044f]"), "mixed_script", 0.5),
        _finding(text.rlike("[\u202e\u202b]"), "bidi", 0.8), _finding(text.rlike("[\u200b-\u200d\ufeff\u180e\u2060]"), "zero_width", 0.5),
        _finding(lookalikes(text) > 0, "lookalike", 0.5), _finding(not_composed(text), "not_composed", 0.5),
    ]


def canaries(text: Column, extra: list[str] | None = None) -> list[Column]:
    """O-246: planted tokens, and marks of another agent's context."""
    planted = reduce(lambda a, b: a | b, [text.contains(c) for c in [*CANARIES, *(extra or [])]])
    return [_finding(planted, "canary", 1.0 if extra else 0.2), *[_finding(text.rlike(p), name, 0.2) for p, name in LEAKS]]


def path_traversal(text: Column) -> list[Column]:
    """O-247: climbing paths as they stand or URL-decoded, and doubled separators."""
    # what is no escape stays, as do plus signs
    decoded = F.try_url_decode(F.when(text.contains("%"), F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))))
    return [_finding(text.rlike(TRAVERSAL), "path_traversal", 0.9), _finding(F.coalesce((decoded != text) & decoded.rlike(TRAVERSAL), F.lit(False)), "encoded_traversal", 0.9), _finding(text.rlike(SEPARATORS), "separators", 0.2)]


def threat_categories(text: Column) -> list[Column]:
    """O-249: escalation, social engineering, false approval: a finding for each pattern."""
    return [*[_finding(text.rlike(p), "escalation", 0.9) for p in ESCALATION], *[_finding(text.rlike(p), "social_engineering", 0.5) for p in SOCIAL], *[_finding(text.rlike(p), "false_approval", 0.5) for p in APPROVAL]]


def config_anomalies(text: Column) -> Column:
    """O-250: how many patterns of tampering with a configuration match."""
    return reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in CONFIG])


def config_drift(snapshots: DataFrame, key: str, order: list[str]) -> DataFrame:
    """O-250: names whose value differs from the snapshot before: ``key, order.., name, before, now``.

    ``snapshots`` has a map ``settings``; values of names that sound secret are masked before they are compared, as specified.
    """
    secret = lambda k: reduce(lambda a, b: a | b, [k.contains(s) for s in SECRET_KEYS])
    masked = F.transform_values("settings", lambda k, v: F.when(secret(k), F.lit("***REDACTED***")).otherwise(v))
    before = F.lag("settings").over(Window.partitionBy(key).orderBy(*order))
    both = snapshots.withColumn("settings", masked).withColumn("before", before).where(F.col("before").isNotNull())
    each = both.select(key, *order, "settings", F.explode("before").alias("name", "before"))
    return each.withColumn("now", F.try_element_at("settings", F.col("name"))).where(~F.col("now").eqNullSafe(F.col("before"))).drop("settings")


def scan_text(df: DataFrame, canary_tokens: list[str] | None = None) -> DataFrame:
    """O-251, O-252: findings of all layers, the level, and whether the text is clean (any double space is not: as specified).

    Phrases are counted once for each row; runs are decoded only in rows without a phrase.
    """
    t = F.col("content")
    counted = df.withColumn("_phrases", known_phrases(t))
    decoded = F.when(F.col("_phrases") == 0, F.exists(decoded_views(t), lambda v: known_phrases(v) > 0)).otherwise(F.lit(False))
    layers = [
        _finding(F.col("_phrases") > 0, "phrase", 0.9), _finding(decoded, "encoded_phrase", 0.9), _finding(secret_found(t), "secret", 0.8), *heuristics(t), *unicode_tricks(t),
        *canaries(t, canary_tokens), *path_traversal(t), *threat_categories(t), *[_finding(t.rlike(p), "tool_hijack", 0.9) for p in HIJACKS], _finding(config_anomalies(t) > 0, "config", 0.5),
    ]
    out = counted.withColumn("threats", F.array_compact(F.array(*layers))).drop("_phrases")
    high = F.exists("threats", lambda x: x["severity"] >= 0.8)
    level = F.when(high | (F.size("threats") >= 2), "critical").when(F.size("threats") >= 1, "warning").otherwise("clean")
    return out.withColumn("level", level).withColumn("clean", F.size("threats") == 0)


def url_allowed(url: Column, allowed: list[str] | None = None) -> Column:
    """O-254: http or https, no metadata, local or link-local host, in the allow-list if there is one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    ok = url.rlike(r"^https?://") & host.isNotNull() & ~host.isin(FORBIDDEN_HOSTS) & ~host.rlike(r"^(169\.254\.|22[4-9]\.|23[0-9]\.)")
    return F.coalesce(ok & (host.isin(allowed) if allowed else F.lit(True)), F.lit(False))


def tool_aliases(df: DataFrame) -> DataFrame:
    """O-248: ``id, word, tool, distance`` of words of three bytes or more at a distance of one or two from a tool's name.

    Each different word of the whole table is compared once with the fixed names; documents then join their words.
    """
    cleaned = F.transform(F.split(F.lower("content"), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    longest = max(map(len, TOOL_NAMES)) + 2
    words = df.select("id", F.explode(F.array_distinct(cleaned)).alias("word")).where((F.octet_length("word") >= 3) & (F.length("word") <= longest))
    near = words.select("word").distinct().withColumn("tool", F.explode(F.array(*map(F.lit, TOOL_NAMES)))).where(F.abs(F.length("word") - F.length("tool")) <= 2)
    near = near.withColumn("distance", F.levenshtein("word", "tool", 2)).where("distance BETWEEN 1 AND 2")
    return words.join(near, "word").select("id", "word", "tool", "distance")
