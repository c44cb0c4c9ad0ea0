"""Speakers, quotations, facts and dates of dialogue texts (O-86, O-208..O-211, O-217, O-222, O-223), in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of speakers, and what is no name.
SPEAKER_PATTERNS = [r"(?m)^([^:\s]+):\s*", r"(?m)^\[([^]\s]+)\]", r"(?i)(?:Speaker|Person|Host|Guest|Interviewer|Interviewee|Moderator):\s*([A-Z][a-zA-Z]+)"]
QUERY_SPEAKER = r"(?i)\b(?:who|what|where|when|why|how|did|was|were)(?:\s+is|\s+did|\s+was|\s+were)?\s+([A-Z][a-zA-Z]+)"
NO_SPEAKERS = ["The", "This", "That", "They", "Then", "There", "Here", "Hello", "Thanks", "Please", "Sorry", "Who", "What", "When", "Where", "Why", "How", "Did", "Was", "Were", "Are", "She", "He", "It"]
FEMALE_NAMES = ["caroline", "alice", "sarah", "emma", "olivia", "sophia", "isabella", "mia", "charlotte", "amelia", "mary", "patricia", "jennifer", "linda", "elizabeth", "barbara", "susan", "jessica", "karen"]
MALE_NAMES = ["james", "robert", "john", "michael", "david", "william", "richard", "joseph", "thomas", "christopher", "charles", "daniel", "matthew", "anthony", "mark", "donald", "steven", "paul", "andrew", "joshua"]
#: What is cut from the ends of a fact's value.
VALUE_ENDS, VALUE_STARTS = [" lately", " recently", " currently", " these days", " right now"], ["and ", "to "]
#: Patterns and keywords of facts.
IDENTITY = r"(?i)\b(?:i am|i'm)\s+(?:a\s+)?(transgender woman|trans woman|woman|man|nonbinary|non-binary)\b"
STATUS = r"(?i)\b(?:i am|i'm)\s+(single|married|divorced|engaged|widowed)\b"
RESEARCH = r"(?i)\b(?:researched|researching)\s+([A-Za-z][A-Za-z\s'-]{2,80})"
ORIGIN = r"(?i)\bmoved from\s+([A-Z][a-zA-Z]+)\b"
DURATIONS = [(r"(?i)\b(\d+)\s+years?\s+ago\b", " years ago"), (r"(?i)\bfor\s+(\d+)\s+years?\b", " years"), (r"(?i)\b(\d+)\s+years?\b", " years")]
ACTIVITIES = ["pottery", "camping", "painting", "swimming", "running", "reading", "violin", "hiking"]
PLACES, PREFERENCES = ["beach", "mountains", "forest", "museum"], ["dinosaurs", "nature"]
#: Explicit dates, and the actions that a text tells of, the first that holds (all words of a group).
EXPLICIT_DATES = [r"(?i)\b\d{1,2}\s+[A-Za-z]+\s+\d{4}\b", r"(?i)\b[A-Za-z]+\s+\d{1,2},\s+\d{4}\b", r"\b(?:19|20)\d{2}\b"]
ACTIONS = [
    ([["support group"]], "went to the LGBTQ support group"), ([["school event"], ["talked about her transgender journey"]], "gave a speech at a school"),
    ([["friends, family, and mentors"]], "met up with her friends family and mentors"), ([["painted", "sunrise"]], "painted a sunrise"), ([["charity race"]], "ran a charity race"),
    ([["going camping"]], "is planning on going camping"), ([["went camping"], ["camping last week"]], "went camping"), ([["camping"]], "camping came up"),
]
_QUOTE = r"[\"']([^\"']+)[\"']"
_DIA = r"(?i)^([a-z]+\d+):0*([0-9]+)$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def likely_speaker(name: Column) -> Column:
    """O-208: two to twenty Latin letters, hyphens or apostrophes after a capital, and no common word."""
    return name.rlike(r"^[A-Z][A-Za-z'-]{1,19}$") & ~name.isin(NO_SPEAKERS)


def speakers(text: Column) -> Column:
    """O-208: names before colons, in brackets and after roles, distinct without regard to case, the first spelling kept."""
    names = F.filter(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in SPEAKER_PATTERNS]), likely_speaker)
    return F.filter(names, lambda n, i: F.array_position(F.transform(names, F.lower), F.lower(n)) == i + 1)


def primary_speaker(text: Column) -> Column:
    """O-208: what stands before the colon of the first line where that is a capital and then letters and spaces."""
    heads = F.transform(F.split(text, "\n"), lambda line: F.when(line.contains(":"), _stripped(F.substring_index(line, ":", 1))))
    return F.try_element_at(F.filter(heads, lambda h: h.rlike("^[A-Z][A-Za-z ]*$")), F.lit(1))


def resolve_pronouns(query: Column, names: Column) -> Column:
    """O-209: "she" and "he" give way to the only female or male name among the speakers."""
    out = query
    for pronoun, known in (("she", FEMALE_NAMES), ("he", MALE_NAMES)):
        one = F.array_intersect(F.transform(names, F.lower), F.array(*map(F.lit, known)))
        first = F.filter(names, lambda n: F.lower(n) == F.get(one, F.lit(0)))  # noqa: B023
        out = F.when(F.lower(query).contains(pronoun) & (F.size(one) == 1), F.regexp_replace(out, F.lit(rf"(?i)\b{pronoun}\b"), F.get(first, F.lit(0)))).otherwise(out)
    return out


def speaker_of_query(query: Column) -> Column:
    """O-209: the name that follows a question word, null for what is no name."""
    name = _found(query, QUERY_SPEAKER)
    return F.when(likely_speaker(name), name)


def trim_fact_value(value: Column) -> Column:
    """O-210: without marks at the end, quotes around, one closing adverb and one opening word."""
    cleaned = _stripped(F.regexp_replace(F.regexp_replace(_stripped(value), r"[.,;:!?]+$", ""), r'^"+|"+$', ""))
    cleaned = _stripped(F.regexp_replace(cleaned, rf"(?i)({'|'.join(VALUE_ENDS)})$", ""))
    return _stripped(F.regexp_replace(cleaned, rf"(?i)^({'|'.join(VALUE_STARTS)})", ""))


def sentence_case(value: Column) -> Column:
    """O-210: lower case with a capital first letter."""
    low = F.lower(_stripped(value))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))


def quoted_titles(text: Column) -> Column:
    """O-210: what stands in double quotes, trimmed, without empty ones."""
    return F.array_remove(F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"')), _stripped), "")


def duration_value(text: Column) -> Column:
    """O-210: years ago, for years, or years."""
    return F.coalesce(*[F.concat(_found(text, p), F.lit(after)) for p, after in DURATIONS])


def marked_quotes(text: Column) -> Column:
    """O-86: the n-th quotation becomes ``[QUOTEn: ..]``."""
    quotes = F.regexp_extract_all(text, F.lit(_QUOTE), F.lit(1))
    mark = lambda i: F.when(i < F.size(quotes), F.concat(F.lit("[QUOTE"), (i + 1).cast("string"), F.lit(": "), F.get(quotes, i), F.lit("]"))).otherwise("")
    return F.array_join(F.transform(F.split(text, _QUOTE), lambda part, i: F.concat(part, mark(i))), "")


def embedding_text(text: Column) -> Column:
    """O-86: a header of the speakers, if there are any, before the text with marked quotations."""
    names = F.transform(speakers(text), lambda n: F.concat(F.lit("["), n, F.lit("]")))
    header = F.concat(F.lit("Conversation between: "), F.array_join(names, ", "), F.lit(". \nQuote context: "), F.array_join(names, " said, "), F.lit("\n\n"))
    return F.concat(F.when(F.size(names) > 0, header).otherwise(""), marked_quotes(text))


def normalize_dialogue_id(value: Column) -> Column:
    """O-217: ``d1:007`` becomes ``D1:7``; anything else is null."""
    cleaned = _stripped(value)
    return F.when(cleaned.rlike(_DIA), F.concat(F.upper(F.regexp_extract(cleaned, _DIA, 1)), F.lit(":"), F.regexp_extract(cleaned, _DIA, 2).cast("decimal(38,0)").cast("string")))


def normalize_dialogue_path(path: Column) -> Column:
    """O-217: dialogue ids that fill a part of a path, up to a slash, a hash or the end, are normalised."""

    def part(p: Column, i: Column) -> Column:
        head = F.substring_index(p, "#", 1)
        return F.when(i > 0, F.concat(F.coalesce(normalize_dialogue_id(head), head), F.substring(p, F.length(head) + 1, F.lit(1 << 30)))).otherwise(p)

    return F.array_join(F.transform(F.split(path, "/"), part), "/")


def session_date(text: Column) -> Column:
    """O-222: the date after the last " on " of a session's time; null for other forms."""
    day = F.replace(_stripped(F.substring_index(text, " on ", -1)), F.lit("  "), F.lit(" "))
    return F.coalesce(*[F.try_to_timestamp(day, F.lit(f)).cast("date") for f in ("d MMMM, yyyy", "d MMMM yyyy", "MMMM d, yyyy")])


def temporal_value(text: Column, session_time: Column) -> Column:
    """O-222: an explicit date, or what a relative one means on the session's day ("last saturday" is the sunday before, as specified)."""
    low, day = F.lower(text), session_date(session_time)
    explicit = [_found(text, p, 0) for p in EXPLICIT_DATES]
    named = lambda d, form="d MMMM yyyy": F.date_format(d, form)
    before_sunday = F.date_sub(day, F.when(F.dayofweek(day) == 1, 7).otherwise(F.dayofweek(day) - 1))
    relative = (
        F.when(day.isNull(), None).when(low.contains("yesterday"), named(F.date_sub(day, 1))).when(low.contains("last year"), (F.year(day) - 1).cast("string"))
        .when(low.contains("last saturday"), F.concat(F.lit("The sunday before "), named(day))).when(low.contains("last friday"), F.concat(F.lit("The friday before "), named(day)))
        .when(low.contains("last week"), F.concat(F.lit("The week before "), named(day))).when(low.contains("next month"), named(F.add_months(F.trunc(day, "month"), 1), "MMMM yyyy"))
        .when(low.contains("last sunday") | low.contains("sunday before"), named(before_sunday))
    )
    return F.coalesce(*explicit, relative)


def value_granularity(value: Column) -> Column:
    """O-223: four digits are a year, two words a month, anything else a day."""
    return F.when(value.rlike(r"^\d{4}$"), "year").when(F.size(F.split(_stripped(value), r"\s+")) == 2, "month_year").otherwise("full_date")


def event_action(text: Column) -> Column:
    """O-211: the first action of the table that the text tells of."""
    low, rule = F.lower(text), None
    for groups, action in ACTIONS:
        test = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [low.contains(w) for w in words]) for words in groups])
        rule = F.when(test, action) if rule is None else rule.when(test, action)
    return rule.otherwise("had the event")


def derived_facts(df: DataFrame) -> DataFrame:
    """O-211: ``id, path, content, memory_kind, fact_type, value`` of the ten rules, for texts with a speaker.

    ``df``: ``id, path, content, speaker`` (null: the primary speaker of the text). Equal facts of a row come once.
    """
    text, low = F.col("content"), F.lower("content")
    captured = lambda p: _filled(trim_fact_value(_found(text, p)))
    present = lambda words: _filled(F.concat_ws(", ", *[F.when(low.contains(w), F.lit(w.capitalize())) for w in words]))
    counsel, mental, psych = (low.contains(w) for w in ("counseling", "mental health", "psychology"))
    career = (
        F.when(counsel & mental, "Psychology, counseling certification").when(psych & low.contains("counsel"), "Psychology, counseling").when(mental, "Counseling, mental health")
        .when(psych, "Psychology").when(counsel, "Counseling")
    )
    rules = [
        ("entity_state", "identity", F.coalesce(sentence_case(captured(IDENTITY)), F.when(low.contains("transgender") | low.contains("trans community"), "Transgender woman"))),
        ("entity_state", "relationship_status", F.coalesce(sentence_case(captured(STATUS)), F.when(low.contains("single parent"), "Single"))),
        ("fact_atom", "research_topic", sentence_case(captured(RESEARCH))), ("summary_fact", "career_interest", career), ("fact_atom", "duration", duration_value(text)),
        ("fact_atom", "origin_place", sentence_case(captured(ORIGIN))), ("summary_fact", "activities", present(ACTIVITIES)), ("summary_fact", "places", present(PLACES)),
        ("summary_fact", "preferences", present(PREFERENCES)), ("summary_fact", "books", _filled(F.array_join(quoted_titles(text), ", "))),
    ]
    each = [F.when(value.isNotNull(), F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("memory_kind"), F.lit(fact).alias("fact_type"), value.alias("value"))) for i, (kind, fact, value) in enumerate(rules)]
    told = df.withColumn("speaker", F.coalesce("speaker", primary_speaker(text))).where("speaker IS NOT NULL")
    out = told.select("id", "path", "speaker", F.inline(F.array_compact(F.array(*each))))
    verb = F.when(F.col("fact_type").isin("identity", "relationship_status"), " is ").when(F.col("fact_type") == "research_topic", " researched ").when(F.col("fact_type") == "career_interest", " would likely pursue ").otherwise(": ")
    sentence = F.concat("speaker", verb, "value", F.lit("."))
    place = F.concat("path", F.lit("#derived/"), "memory_kind", F.lit("/"), F.col("rule").cast("string"))
    return out.select("id", place.alias("path"), sentence.alias("content"), "speaker", "memory_kind", "fact_type", "value").dropDuplicates(["id", "content", "memory_kind", "value"])


def derived_events(df: DataFrame) -> DataFrame:
    """O-211: ``id, path, content, resolved_date, granularity`` of texts with a date; ``df`` also has ``session_time``."""
    value = temporal_value(F.col("content"), F.col("session_time"))
    dated = df.select("id", "path", F.coalesce("speaker", primary_speaker(F.col("content"))).alias("speaker"), event_action(F.col("content")).alias("action"), value.alias("resolved_date")).where("resolved_date IS NOT NULL")
    sentence = F.concat(F.coalesce(F.concat("speaker", F.lit(" ")), F.lit("")), "action", F.lit(" on "), "resolved_date", F.lit("."))
    return dated.select("id", F.concat("path", F.lit("#derived/temporal_event/0")).alias("path"), sentence.alias("content"), "resolved_date", value_granularity(F.col("resolved_date")).alias("granularity"))
