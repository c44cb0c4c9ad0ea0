"""Injection guard and sanitiser (O-253, O-254)."""

from __future__ import annotations

from functools import reduce
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ends a repeated part in a parsed pattern
_END = "END"
#: Patterns of direct injection, of indirect injection, and of prompts that leak.
DIRECT = [
    r"(?i)(ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|rules?|context|prompt))", r"(?i)(ignore\s+(all\s+)?instructions?)",
    r"(?i)(forget\s+(everything|all|your)\s+(instructions?|rules?|training))", r"(?i)(forget\s+everything)",
    r"(?i)(you\s+are\s+(now|no\s+longer|not|never)\s+(a\s+)?(AI|assistant|model|bot|claude|gpt|gemini|llama))", r"(?i)(new\s+(system\s+)?instructions?:)",
    r"(?i)(override\s+(your\s+)?(safety|guidelines|rules))", r"(?i)(disregard\s+(all\s+)?(rules|guidelines|instructions))", r"(?i)(you\s+can\s+(now| safely)\s+ignore)",
    r"(?i)(system\s*:\s*\[)", r"(?i)(\[INST\]\s*\[/INST\])", r"(?i)(<\|system\|>)", r"(?i)(<\|user\|>)", r"(?i)(<\|assistant\|>)", r"(?i)(DAN\s+(do\s+anything\s+now|mode))",
    r"(?i)(developer\s+mode)", r"(?i)(jailbreak)", r"(?i)(roleplay\s+as\s+(a\s+)?(god|evil|hacker))", r"(?i)(pretend\s+(to\s+be|you\s+are))",
    r"(?i)(you\s+are\s+(a\s+)?helpful\s+assistant\s+that\s+always)", r"(?i)(respond\s+with\s+only)", r"(?i)(output\s+the\s+(following|exact)\s+(text|words))",
    r"(?i)(say\s+[\x22\x27]+\w+[\x22\x27]+\s+and\s+nothing\s+else)", r"(?i)(for\s+(the\s+)?(purposes?|sake|scope)\s+of\s+(this\s+)?(exercise|scenario|conversation|task|discussion))",
    r"(?i)(from\s+now\s+on\s*[,;]\s*(you\s+(are|will|must|can)))", r"(?i)(let['\u2019s]+\s+(pretend|say|imagine|assume|suppose)\s+(that\s+)?(you|we|i))",
    r"(?i)(hypothetical\s+(scenario|situation|context|setting))", r"(?i)(no\s+(restrictions?|limits?|boundaries?|filter|constraints?|rules\s+apply))",
    r"(?i)(without\s+(any\s+)?(restrictions?|limits?|filter|censorship|boundaries))", r"(?i)(unfiltered|uncensored|unconstrained|unlimited)",
    r"(?i)(you\s+must\s+(obey|comply\s+with|follow)\s+(all\s+)?(my|any|every|these))", r"(?i)(reprogram|reconfigure|redefine)\s+(yourself|your\s+(core|system|internal|own))",
    r"(?i)(bypass\s+(your\s+)?(safety|ethics?|ethical|filter|restrictions?|alignment|guidelines))", r"(?i)(ignore\s+(ethical|safety|security|boundar(y|ies)|content\s+policy|censorship))",
    r"(?i)(act\s+as\s+if\s+(you\s+)?(have\s+no|are\s+(not\s+bound|free|unconstrained|above)))", r"(?i)(do\s+(not|n['\u2019t]|not)\s+(refuse|decline|reject|filter|censor))",
    r"(?i)(you\s+(can|may)\s+(now\s+)?(say|tell|do|answer|output|respond\s+with)\s+anything)", r"(?i)(anti[\-\s]?(censorship|censor)\w*)",
    r"(?i)(no\s+(need\s+to\s+)?(worry|concern)\s+(about\s+)?(safety|guidelines|rules|restrictions))", r"(?i)(always\s+(say\s+)?yes\s+(to|and))",
    r"(?i)(you\s+(are|will\s+be)\s+(fully\s+)?(compliant|obedient|responsive)\s+(with|to)\s+(any|all|every))",
]
INDIRECT = [
    r"(?i)(\\\\.+\\\\.+\\\\.+\\\\.+\.txt)", r"(?i)(import\s+from\s+(file|external|remote))", r"(?i)(read\s+(the\s+)?(following|attached|file))",
    r"(?i)(the\s+(following|text|content)\s+is\s+(a\s+)?(supplemental|extra)\s+(prompt|instruction))", r"(?i)(\{\{.*\}\})", r"(?i)(\{\%.*\%\})", r"(?i)(\<\?php.*\?\>)", r"(?i)(<!\[CDATA\[)",
    r"(?i)(\[system\]\(.*\))", r"(?i)(\[system prompt\]:)", r"(?i)(https?://[^\s]+\?prompt=)", r"(?i)(https?://[^\s]+\?instruction=)",
    r"(?i)(visit\s+(this|the)\s+(link|url|page|site|website|resource))", r"(?i)(click\s+(on\s+)?(this|the|here|link|url))", r"(?i)(download\s+(this|the|from)\s+(link|url|file|attachment))",
    r"(?i)(check\s+(out\s+)?(this|the)\s+(link|url|page|site))", r"(?i)(go\s+(to|and\s+visit)\s+(this|the)\s+(link|url|page|site|website))", r"(?i)(data\s*:\s*text/\w+;\s*(base64|charset))",
    r"(?i)(data\s*:\s*(image|text|application|video|audio)/)", r"(?i)(file\s*:\/{2,3})", r"(?i)(!\[.*?\]\s*\(\s*https?://)",
    r"(?i)(\[.*?\]\s*\(\s*https?://[^)]+\?.*(?:prompt|instruction|cmd|exec)=)", r"(?i)(fetch|retrieve|get|load)\s+(content|data|info|text)\s+(from|at)\s+https?://",
    r"(\\x[0-9a-fA-F]{2}){3,}", r"[\uff01\uff03-\uff5e]", r"(&#[xX]?[0-9a-fA-F]{2,6};){3,}+", r"(%[0-9a-fA-F]{2}){3,}",
]
LEAKING = [
    r"(?i)(what\s+(are|is)\s+your\s+(system\s+)?(instructions?|prompt|guidelines))", r"(?i)(repeat\s+(after\s+me|your\s+instructions))", r"(?i)(show\s+(me\s+)?your\s+(system\s+)?prompt)",
    r"(?i)(what\s+(was|were)\s+your\s+(original|first|initial)\s+prompt)", r"(?i)(tell\s+me\s+(about\s+)?your\s+(rules|guidelines|instructions))",
    r"(?i)(output\s+(your|all)\s+(system\s+)?instructions)", r"(?i)(list\s+(all\s+)?your\s+(system\s+)?(rules|instructions))", r"(?i)(ignore\s+previous?\s+and\s+tell\s+me\s+your)",
    r"(?i)(forget\s+instructions?\s+and\s+tell\s+me)", r"(?i)(print\s+(your|all)\s+(system\s+)?prompt)", r"(?i)(<\|)", r"(?i)(\[\[INST\]\])", r"(?i)(BEGIN\s+SYSTEM\s+PROMPT)",
    r"(?i)(END\s+SYSTEM\s+PROMPT)",
]
#: What the sanitiser replaces, in this order.
SANITIZE = [
    (r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|rules?|context|prompt)", "[FILTERED]"), (r"(?i)ignore\s+(all\s+)?instructions?", "[FILTERED]"),
    (r"(?i)forget\s+(everything|all|your)\s+(instructions?|rules?|training)", "[FILTERED]"), (r"(?i)forget\s+everything", "[FILTERED]"),
    (r"(?i)new\s+(system\s+)?instructions?:", "[SYSTEM] "), (r"(?i)override\s+(your\s+)?(safety|guidelines|rules)", "[FILTERED]"),
    (r"(?i)disregard\s+(all\s+)?(rules|guidelines|instructions)", "[FILTERED]"), (r"(?i)<\|system\|>", "[TOKENS_FILTERED]"), (r"(?i)<\|user\|>", "[TOKENS_FILTERED]"),
    (r"(?i)<\|assistant\|>", "[TOKENS_FILTERED]"), (r"(?i)DAN\s+(do\s+anything\s+now|mode)", "[FILTERED]"), (r"(?i)developer\s+mode", "[FILTERED]"), (r"(?i)jailbreak", "[FILTERED]"),
    (r"(\{\{.*\}\})", "[TEMPLATE_FILTERED]"), (r"(\{\%.*\%\})", "[TEMPLATE_FILTERED]"), (r"[\u200b]", ""), (r"[\u200c]", ""), (r"[\u200d]", ""), (r"[\u2060]", ""), (r"[\ufeff]", ""),
    (r"(\$\{.*?\})", "[TEMPLATE_FILTERED]"), (r"(?i)<script", "[HTML_FILTERED]"), (r"(?i)onerror\s*=", "[EVENT_FILTERED]"), (r"(?i)onload\s*=", "[EVENT_FILTERED]"),
    (r"(?i)for\s+(the\s+)?(purposes?|sake|scope)\s+of\s+(this\s+)?(exercise|scenario|conversation)", "[FILTERED]"), (r"(?i)from\s+now\s+on[,;]\s+you\s+(are|will|must)", "[FILTERED]"),
    (r"(?i)hypothetical\s+(scenario|situation|context)", "[FILTERED]"), (r"(?i)https?://[^\s]+", "[URL_FILTERED]"), (r"(?i)file:///[^\s]+", "[URL_FILTERED]"),
    (r"(?i)data:\s*\w+/\w+;?\w*[^\s]*", "[URL_FILTERED]"), (r"(?i)no\s+(restrictions?|limits?|boundaries?|filter|constraints?)", "[FILTERED]"),
    (r"(?i)without\s+(any\s+)?(restrictions?|limits?|filter|censorship)", "[FILTERED]"), (r"(?i)(unfiltered|uncensored|unconstrained)", "[FILTERED]"),
    (r"(?i)bypass\s+(your\s+)?(safety|ethics?|ethical|filter|restrictions?)", "[FILTERED]"), (r"(?i)you\s+(can|may)\s+(now\s+)?(say|tell|do|answer|output)\s+anything", "[FILTERED]"),
    (r"(?i)reprogram\s+(yourself|your\s+(core|system))", "[FILTERED]"), (r"(?i)do\s+(not|n['\u2019t])\s+(refuse|decline|reject)", "[FILTERED]"),
    (r"(?i)always\s+(say\s+)?yes\s+(to|and)", "[FILTERED]"), (r"\\x[0-9a-fA-F]{2}", "[HEX_FILTERED]"), (r"(&#[xX]?[0-9a-fA-F]{2,6};)", "[ENTITY_FILTERED]"), (r"%[0-9a-fA-F]{2}", ""),
    (r"[\uff01\uff03-\uff5e]", ""),
]
#: Invisible and full-width characters. Unicode escapes and the possessive quantifier above are what Java's expressions need.
ZERO_WIDTH, FULL_WIDTH = "[\u200b\u200c\u200d\u2060\ufeff\u180e]", "[\uff01\uff03-\uff5e]"


def needed(pattern: str) -> str:
    """The longest run of literal characters, in lower case, that every match of a pattern holds; empty where there is none."""
    best, run = "", ""
    todo = list(_parser.parse(pattern))
    while todo:
        kind, what = todo.pop(0)
        name = str(kind)
        if name == "LITERAL":
            run += chr(what)
            continue
        if name == "SUBPATTERN":
            todo[:0] = list(what[-1])
            continue
        best, run = max(best, run, key=len), ""
        if name in ("MAX_REPEAT", "POSSESSIVE_REPEAT") and what[0] > 0:
            todo[:0] = [*list(what[2]), (_END, None)]
    return max(best, run, key=len).lower()


def injection_confidence(text: Column) -> Column:
    """O-253: for each pattern .5, .2 more from two matches and .1 more from three; zero-width characters .6; five full-width ones .55; the greatest.

    A pattern is only tried on texts that hold the literal it cannot do without, and counted once; the counts are scored together, which keeps the generated code
    small. Use the column once, in a projection of its own.
    """
    low = F.lower(text)
    count = lambda p: F.when(low.contains(needed(p)), F.regexp_count(text, F.lit(p))).otherwise(0) if len(needed(p)) > 1 else F.regexp_count(text, F.lit(p))
    most = F.array_max(F.array(*[count(p) for p in (*DIRECT, *INDIRECT, *LEAKING)]))
    scored = F.when(most > 2, 0.5 + 0.2 + 0.1).when(most > 1, 0.5 + 0.2).when(most > 0, 0.5).otherwise(0.0)
    return F.greatest(scored, F.when(text.rlike(ZERO_WIDTH), 0.6).otherwise(0.0), F.when(F.regexp_count(text, F.lit(FULL_WIDTH)) >= 5, 0.55).otherwise(0.0))


def flagged(text: Column) -> Column:
    """O-253: a confidence of .5 or more."""
    return injection_confidence(text) >= 0.5


def sanitize(text: Column) -> Column:
    """O-254: the ordered replacements."""
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), SANITIZE, text)
