"""Merged entities, coherence, management, windows and layers against plain Python and hand-worked rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recallery.functions import components
from recallery.operators import care


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 20)
    monkeypatch.setattr(components, "HUBS", 10)
    rng = random.Random(3)
    for links in ([(0, i) for i in range(1, 200)] + [(500, i) for i in range(190, 300)], [(i, i + 1) for i in range(120)], [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)], [(1, 1)]):
        parent = {}

        def find(x, parent=parent):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            if a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        found = components.connected_components(spark.createDataFrame([(*x, "m") for x in links], "a long, b long, m string")).collect()
        assert {r.node: r.label for r in found} == {x: find(x) for x in parent} and len(found) == len(parent)


def test_merged_entities(spark):
    schema = "id string, name string, aliases array<string>, occurrences long, memories long, description string, last_seen date"
    entities = spark.sql("SELECT * FROM VALUES ('a', 'A', array('x'), 1L, 1L, NULL, date'2024-01-01'), ('b', 'B', array('x', 'y'), 2L, 0L, 'b told', date'2024-03-01'), ('c', 'C', array(), 4L, 5L, 'c told', date'2024-02-01'), ('d', 'D', NULL, 8L, 1L, NULL, NULL), ('p', 'P', array(), 1L, 1L, NULL, NULL), ('q', 'Q', array(), 1L, 1L, NULL, NULL) AS t(id, name, aliases, occurrences, memories, description, last_seen)").to(spark.createDataFrame([], schema).schema)
    edges = spark.createDataFrame([("a", "b"), ("c", "d"), ("d", "a"), ("p", "c"), ("b", "q")], "source string, target string")
    # a chain of merges, one of an entity that is gone already, and a circle
    merges = spark.createDataFrame([(1, "b", "c"), (2, "a", "b"), (3, "a", "c"), (4, "p", "q"), (5, "q", "p"), (6, "d", "d")], "seq int, primary string, secondary string")
    people, aliases, moved = care.merge_entities(entities, edges, merges)
    rows = {r.id: r for r in people.collect()}
    assert set(rows) == {"a", "d", "p"}
    assert (rows["a"].occurrences, rows["a"].memories, rows["a"].description, str(rows["a"].last_seen), rows["a"].merged_from, rows["a"].name) == (7, 6, "b told", "2024-03-01", 2, "A")
    assert (rows["d"].occurrences, rows["d"].merged_from) == (8, 0) and rows["p"].merged_from == 1
    assert sorted(map(tuple, aliases.collect())) == [("a", "B"), ("a", "C"), ("a", "x"), ("a", "y"), ("p", "Q")]
    assert sorted((r.source, r.target) for r in moved.collect()) == [("a", "d"), ("a", "p"), ("d", "a"), ("p", "a")]
    # of several that are never merged into another the latest merge's primary stays
    two = spark.createDataFrame([(1, "m", "x"), (2, "k", "x"), (3, "n", "y")], "seq int, primary string, secondary string")
    assert {(r.old, r.new) for r in care.merge_map(two).collect()} == {("x", "k"), ("m", "k"), ("y", "n")}
    assert care.merge_map(two.limit(0)).collect() == []


def test_a_third_of_all_entities_becomes_one(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 50)
    merges = spark.range(1, 3001).selectExpr("id AS seq", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS primary", "id AS secondary")
    found = care.merge_map(merges).groupBy("new").count().collect()
    assert [tuple(r) for r in found] == [(0, 1000)]


def test_temporal_pairs(spark):
    rows = [(i, "w" + str(i % 2), f"text {word}") for i, word in enumerate(["yesterday", "Tomorrow", "tomorrow", "today tomorrow", "yesterday tomorrow", "tomorrow", "none", "yesterday"])]
    found = care.temporal_pairs(spark.createDataFrame(rows, "id long, w string, content string"), "w").collect()
    assert {tuple(r) for r in found} == {("w0", 0, 2), ("w0", 2, 4), ("w1", 1, 7), ("w1", 5, 7)} and len(found) == 4


def test_drift_takes_the_first_change(spark):
    rows = [(1, "n", 1, 10, 0.5, "a b c d"), (2, "n", 2, 15, 0.9, "x"), (3, "n", 3, 11, 0.66, "x"), (4, "n", 4, 11, 0.6, "x y"), (5, "n", 5, 11, 0.6, "a b c e"), (6, "n", 6, 11, 0.6, None), (7, "o", 1, 31, 0.1, None), (8, "p", 1, 31, 0.1, None), (9, "n", 7, 500, 0.1, None)]
    table = spark.createDataFrame(rows, "id long, name string, seen_at int, occurrences long, trust double, description string")
    found = {(r.id, r.kind): round(r.severity, 6) for r in care.drift_alerts(table, spark.createDataFrame([(8,), (9,)], "entity_id long")).collect()}
    assert found == {(2, "occurrences"): 0.1, (3, "trust"): 0.16, (4, "description"): 1.0, (7, "orphan"): 0.6, (9, "occurrences"): 1.0}


def test_coherence_report(spark):
    issues = spark.createDataFrame([("factual", "1", 0.8, 1), ("duplicate", "2", 0.5, 1), ("temporal", "3", 0.0, 2), ("drift", "4", 0.6, 1)], "kind string, id string, severity double, issues long")
    row = care.coherence_report(issues).first()
    assert row.coherence == pytest.approx(1 - 0.15 * 1.3 - 0.1 - 0.06) and not row.passes
    empty = care.coherence_report(issues.limit(0)).first()
    assert empty.coherence == 1.0 and empty.passes


def managed(spark, rows):
    return spark.createDataFrame(rows, "id long, content string, kind string, priority string, access_count int, verified boolean, level string, metadata string, relevance double").withColumns(
        {"last_access": F.expr("timestamp'2024-01-01'"), "created_at": F.expr("timestamp'2024-01-01'")}
    )


def test_storage_limit_takes_the_worst_first(spark):
    rows = [(k, f"{k:03d}" * 10, "fact", "critical" if k % 4 == 0 else "medium", k % 11, k % 2 == 0, "belief", '{"kind": 1, "namespace": 1}', 1.0) for k in range(60)]
    table, now = managed(spark, [*rows, (100, "000" * 10, "fact", "critical", 0, True, "belief", "{}", 1.0)]), F.expr("timestamp'2024-01-05'")
    found = care.auto_manage(table, now, 1000).collect()
    assert {r.id for r in found if r.action == "consolidate"} == {100}
    assert {r.id for r in found if r.action == "decay"} >= {1, 2, 3}
    gone = {r.id for r in found if r.action == "evict"}
    quality = {r.id: round(r.overall, 9) for r in care.memory_quality(table, now).collect()}
    left, over = sorted((k for k in range(60) if k not in gone and k % 4), key=lambda k: (quality[k], -k)), set()
    while 30 * (60 - len(gone) - len(over)) > 1000 and len(over) < len(left):
        over.add(left[len(over)])
    assert over and {r.id for r in found if r.action == "limit"} == over
    assert not [r for r in care.auto_manage(table, now, 10**9).collect() if r.action == "limit"]
    assert {r.id for r in care.auto_manage(table, now, 1).collect() if r.action == "limit"} == set(left)
    assert care.auto_manage(table.limit(0), now, 1).collect() == []


def test_entropy_windows_by_hand(spark):
    rng = random.Random(6)
    texts = ["", "short", "x" * 32, "x" * 33, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(200)), "日本語é👍" * 30 + "abcdefghijklmnop", None, "word " * 50_000]
    found = care.entropy_windows(spark.createDataFrame(list(enumerate(texts)), "id long, content string"), 3.0, 20).collect()
    want = []
    for i, t in enumerate(texts):
        for s in range(0, max(0, len(t or "") - 32), 8):
            raw = t[s : s + 32].encode()
            entropy = -sum(c / len(raw) * math.log2(c / len(raw)) for c in Counter(raw).values())
            if entropy >= 3.0 and len(raw) >= 20:
                want.append((i, s, pytest.approx(entropy), t[s : s + 32]))
    assert len(want) > 20 and sorted(map(tuple, found)) == want


def test_layer_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = lambda x: F.array(*[F.lit(v) for v in x])
    assert one(care.episodic_layer_score("big cat", F.lit("a Cat"), lit(["the BIG cat", "big dog"]))) == pytest.approx(0.1 + 0.05 + 0.3 + 0.1 + 0.05)
    assert one(care.episodic_layer_score("big cat", F.lit("none"), lit(["x"]))) == 0
    score = lambda name, told, aliases: one(care.semantic_layer_score("big cat", F.lit(name), F.lit(name), F.lit(told).cast("string"), lit(aliases)))
    assert [score("Big Cat", None, ["x"]), score("a big cat", None, ["x"]), score("cat", None, ["x"]), score("dog", "my big cat", ["x"]), score("dog", "big", ["big cat"]), score("dog", None, ["The Big Cat"]), score("dog", None, ["x"])] == pytest.approx([0.5, 0.35, 0.35, 0.3, 0.05, 0.3, 0.0])


def test_layers_fused_by_rank(spark):
    working = spark.createDataFrame([("m1", "big cat"), ("m2", "big"), ("m3", "dog")], "id string, content string")
    sessions = spark.createDataFrame([("s1", "big", ["big cat"]), ("m1", "big cat", [])], "id string, summary string, events array<string>")
    things = spark.createDataFrame([("e1", "big cat", "big cat", None, ["x"])], "id string, name string, normalized_name string, description string, aliases array<string>")
    found = {r.id: (r.score, r.sources) for r in care.layered_search(working, sessions, things, "big cat", 0.0).collect()}
    assert found["m1"] == (pytest.approx(2 / 61), "episodic+working") and found["e1"] == (pytest.approx(1 / 61), "semantic") and set(found) == {"m1", "m2", "s1", "e1"}
