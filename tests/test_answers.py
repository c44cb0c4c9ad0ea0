"""Dialogue facts, answers, widened results and named entities on hand-worked rows."""

from recallery.operators import answers as an
from recallery.operators import expansion as ex
from recallery.operators import fusion, scan
from recallery.operators import graph as gr
from recallery.operators import speech as sp

from pyspark.sql import functions as F


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("x")).first()["x"]


def test_speakers_and_pronouns(spark):
    text = "Caroline: hi\n[Melanie] hello\nspeaker: Emma\nThe: no\ncaroline: again\nX: short\nO'Neil: yes"
    assert one(spark, text, sp.speakers) == ["Caroline", "O'Neil", "Melanie", "Emma"]
    assert one(spark, None, sp.speakers) is None and one(spark, "", sp.speakers) == []
    assert one(spark, "a line\nMary Ann: x", sp.primary_speaker) == "Mary Ann"
    names = F.array(F.lit("Caroline"), F.lit("James"))
    assert one(spark, "did she see that he ran", lambda c: sp.resolve_pronouns(c, names)) == "did Caroline see that James ran"
    both = F.array(F.lit("Caroline"), F.lit("Alice"))
    assert one(spark, "did she run", lambda c: sp.resolve_pronouns(c, both)) == "did she run"
    assert one(spark, "When did Melanie paint", sp.speaker_of_query) == "Melanie"
    assert one(spark, "what a day", sp.speaker_of_query) is None


def test_values_quotes_and_dates(spark):
    assert one(spark, ' "to swim lately". ', sp.trim_fact_value) == "swim"
    assert one(spark, "and hiking these days!", sp.trim_fact_value) == "hiking"
    assert one(spark, "HELLO there", sp.sentence_case) == "Hello there"
    assert one(spark, "for 3 years", sp.duration_value) == "3 years" and one(spark, "4 years ago", sp.duration_value) == "4 years ago"
    assert one(spark, 'he said "yes" and \'no\' twice', sp.marked_quotes) == "he said [QUOTE1: yes] and [QUOTE2: no] twice"
    assert one(spark, "Anna: \"hi\"", sp.embedding_text) == "Conversation between: [Anna]. \nQuote context: [Anna]\n\nAnna: [QUOTE1: hi]"
    assert one(spark, "a/d1:007/x#y", sp.normalize_dialogue_path) == "a/D1:7/x#y" and one(spark, " s12:000 ", sp.normalize_dialogue_id) == "S12:0"
    day = F.lit("1:56 pm on 8 May, 2023")
    when = lambda t: one(spark, t, lambda c: sp.temporal_value(c, day))
    assert [when(t) for t in ("yesterday", "last year", "last saturday", "last week", "next month", "last sunday", "on 7 May 2023 yes", "nothing")] == [
        "7 May 2023", "2022", "The sunday before 8 May 2023", "The week before 8 May 2023", "June 2023", "7 May 2023", "7 May 2023", None]


FOUR_FACTS = [
    (1, "f/1", "Caroline: I am single now, because my work needs me.", "Caroline", "relationship_status", "Single", "conversation"),
    (2, "f/2", "Melanie: pottery and camping with the kids.", "Melanie", "activities", "Pottery, Camping", "conversation"),
    (3, "f/3", "Melanie: we also went swimming.", "Melanie", "activities", "Swimming, Pottery", "observation"),
    (4, "f/4", "Caroline: I researched adoption agencies.", "Caroline", "research_topic", "Adoption agencies", None),
]


def test_answers_of_four_facts(spark):
    df = spark.createDataFrame(FOUR_FACTS, "id long, path string, content string, speaker string, fact_type string, normalized_value string, category string")
    fact = lambda q: [r.answer for r in an.structured_fact(df, q).collect()]
    assert fact("which activities does Melanie do") == ["Pottery, Camping, Swimming"]
    assert fact("is Caroline single") == ["Single"] and fact("did Caroline research it") == ["Adoption agencies"] and fact("tell me more") == []
    assert [r.clause for r in an.reason_answer(df, "why is she single").collect()] == ["my work needs me"]
    assert an.reason_answer(df, "is she single").collect() == []
    answer = lambda q: tuple(an.heuristic_answer(df, q).first())
    assert answer("which activities does Melanie partake in") == ("Pottery, Camping, Swimming", "fact")
    assert answer("what does Caroline research") == ("Single, Adoption agencies and Pottery, Camping", "description")
    assert answer("why did Caroline stay alone") == ("my work needs me.", "reason")
    assert tuple(an.heuristic_answer(df.limit(0), "tell me").first()) == (an.NOTHING, "nothing")
    best = an.category_answer(df, "tell of adoption agencies", "1").first()
    assert best.answer == "Adoption agencies" and best.told == 11


def test_derived_facts_of_a_line(spark):
    df = spark.createDataFrame([(1, "p", "Jon: I'm a man and single parent. We moved from Rome for 2 years", None), (2, "q", "no speaker here", None)], "id long, path string, content string, speaker string")
    rows = {r.fact_type: (r.content, r.path) for r in sp.derived_facts(df).collect()}
    assert rows == {
        "identity": ("Jon is Man.", "p#derived/entity_state/0"), "relationship_status": ("Jon is Single.", "p#derived/entity_state/1"),
        "duration": ("Jon: 2 years.", "p#derived/fact_atom/4"), "origin_place": ("Jon: Rome.", "p#derived/fact_atom/5"),
    }


def searches(spark, rows):
    df = spark.createDataFrame(rows, "id long, path string, content string")

    def search(text, n):
        score = sum((F.size(F.split(F.lower("content"), w)) - 1 for w in text.split()), F.lit(0)).cast("double")
        return df.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(n)

    plain = lambda text, n: sorted(((-sum(c.lower().count(w) for w in text.split()), i) for i, _, c in rows if any(w in c.lower() for w in text.split())))[:n]
    return df, search, plain


ROWS = [(1, "a", "cache cache wombat zebra"), (2, "b", "cache lemur"), (3, "c", "wombat wombat"), (4, "d", "zebra lemur"), (5, "e", "memoization wombat"), (6, "f", "nothing")]


def test_feedback_comes_in_behind_the_first(spark):
    df, search, _ = searches(spark, ROWS)
    found = [r.id for r in ex.feedback_search(search, df, "cache", 3).orderBy("place").collect()]
    # the best row's new words are wombat (3, 1) and zebra (1, 4); each is put behind the first row
    assert found == [1, 4, 3, 2]


def test_variants_and_hops_against_plain_python(spark):
    df, search, plain = searches(spark, ROWS)
    scores = {}
    for q, w in fusion.query_variants("the cache"):
        for rank, (_, i) in enumerate(plain(q, 3), 1):
            scores[i] = scores.get(i, 0) + w / (60 + rank)
    order = sorted(scores, key=lambda i: (-scores[i], dict((a, b) for a, b, _ in ROWS)[i]))[:2]
    for i in order:
        words = sorted({w for w in next(f"{c} {p}" for k, p, c in ROWS if k == i).split() if len(w) >= 4})[:4]
        for word in words:
            if word not in "cache":
                for rank, (_, j) in enumerate(plain(word, 2), 1):
                    scores[j] = scores.get(j, 0) + 0.45 / (60 + rank)
    found = {r.id: round(r.score, 9) for r in ex.optimized_search(search, df, "the cache", 3).collect()}
    assert found == {i: round(scores[i], 9) for i in sorted(scores, key=lambda i: (-scores[i], i))[:3]}


def test_named_entities(spark):
    rows = [(1, "Alice works at Acme Labs. See https://acme.org/x or a.b@acme.org"), (2, "GPT4 in Central Park"), (3, None), (4, "")]
    found = {(r.id, r.name, r.entity_type) for r in gr.named_entities(spark.createDataFrame(rows, "id long, content string")).collect()}
    assert {(1, "Alice", "person"), (1, "Acme Labs", "organization"), (1, "https://acme.org/x", "product"), (1, "a.b@acme.org", "concept"), (2, "GPT4", "organization"), (2, "Central Park", "location")} <= found


def test_config_drift_masks_secrets(spark):
    rows = [("a", 1, {"mode": "x", "API_KEY": "1"}), ("a", 2, {"mode": "y", "API_KEY": "2"}), ("a", 3, {"API_KEY": "2"})]
    out = scan.config_drift(spark.createDataFrame(rows, "k string, at int, settings map<string,string>"), "k", ["at"]).collect()
    assert [(r["at"], r["name"], r.before, r.now) for r in out] == [(2, "mode", "x", "y"), (3, "mode", "y", None)]


def test_paths_keep_one_row_a_node(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a")], "source string, target string")
    assert tuple(gr.shortest_path(edges, "a", "e", 5).first()) == ("a>b>d>e", 3)
    assert gr.shortest_path(edges, "a", "zz", 5).collect() == [] and gr.shortest_path(edges, "a", "e", 2).collect() == []


def test_symbol_ids_hash_the_line_as_bytes(spark):
    import hashlib

    got = spark.range(1).select(gr.symbol_id(F.lit("p"), F.lit("f.py"), F.lit("g"), F.lit("Function"), F.lit(258))).first()[0]
    assert got == hashlib.sha256(b"p|f.py|g|Function|" + (258).to_bytes(4, "little")).hexdigest()
