"""Entities and graphs (O-165..O-192). Traversals are rounds of joins with the visited set cut from the frontier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallery.functions.rounds import settled

#: Entity patterns and the relation that each stands for.
ENTITY_PATTERNS = [
    ("mention", "mentions", r"(@[\w.-]{2,})"), ("topic", "tags", r"(#[\w-]{2,})"), ("url", "references", r"(https?://[^\s)>\"]+)"),
    ("date", "dated_on", r"\b(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},\s+\d{4})\b"),
]
#: A side of a relation, what stands between two sides, and how sure each relation is. Without regard to case, so that any
#: words are a side, as specified.
SIDE = r"[A-Z][\w-]*(?:\s+[A-Z][\w-]*)*"
RELATION_PATTERNS = [
    ("works_at", 0.95, r"works?\s+at"), ("knows", 0.9, r"knows?"), ("uses", 0.85, r"uses?"), ("is_a", 0.8, r"is\s+a[n]?"), ("part_of", 0.9, r"part\s+of"), ("located_in", 0.9, r"located\s+in"), ("related_to", 0.7, r"related\s+to"),
]
#: a whole run of words; possessive, as Java's repeated groups take a stack frame for each word otherwise
_RUN = r"(?i)\b[A-Z][\w-]*+(?:\s++[A-Z][\w-]*+)*+"
#: Named entities: candidates, words that are none, and marks of organisations, places and products.
CANDIDATE = r"\b(?:[A-Z]{2,}(?:[A-Z0-9_-]*[A-Z0-9])?|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*\b)*+|[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]++\b)*+|[A-Za-z]+[0-9]+[A-Za-z0-9_-]*)\b"
EMAIL, URL = r"[\w.+-]+@[\w-]+\.[\w.-]+", r"https?://[^\s]+"
COMMON = ["the", "this", "that", "these", "those", "and", "or", "but", "for", "with", "from", "into", "onto", "your", "our", "their", "his", "her", "its", "in", "on", "at", "by", "to", "of"]
ORGANISATIONS = [" inc", " corp", " llc", " ltd", " company", " co", " labs", " lab", " systems", " studio", " platform", " foundation", " university", " institute", " agency", " team"]
LOCATIONS = [" city", " town", " village", " province", " state", " country", " park", " valley", " mountain", " river", " lake", " bay", " beach", " street", " avenue"]
PRODUCTS = ["model", "platform", "engine", "sdk", "api"]


def extract_entities(df: DataFrame) -> DataFrame:
    """O-165: ``id, value, entity_type, relation_type``, distinct without regard to case, in the first spelling."""

    def found(kind: str, relation: str, pattern: str) -> Column:
        values = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(kind).alias("entity_type"), F.lit(relation).alias("relation_type")))

    each = df.select("id", F.posexplode(F.concat(*[found(*p) for p in ENTITY_PATTERNS])).alias("at", "e")).select("id", "at", "e.*")
    first = each.groupBy("id", "entity_type", "relation_type", F.lower("value").alias("key")).agg(F.min_by("value", "at").alias("value"))
    return first.drop("key")


def extract_relations(df: DataFrame) -> DataFrame:
    """O-167: ``id, source, target, relation_type, confidence``.

    A side takes as many words as it can, so in a run of words the last connecting words part all that is before from all
    that is behind: each run gives one relation of a type at most.
    """
    runs = df.select("id", F.explode(F.regexp_extract_all("content", F.lit(f"({_RUN})"))).alias("run"))

    def found(relation: str, confidence: float, between: str) -> Column:
        pattern = rf"(?is)^(.+)\s+{between}\s+(.+)$"
        sides = [F.regexp_replace(F.regexp_extract("run", pattern, k), r"\s+$", "") for k in (1, 2)]
        return F.when(F.col("run").rlike(pattern), F.struct(sides[0].alias("source"), sides[1].alias("target"), F.lit(relation).alias("relation_type"), F.lit(confidence).alias("confidence")))

    return runs.select("id", F.explode(F.array_compact(F.array(*[found(r, c, b) for r, c, b in RELATION_PATTERNS]))).alias("r")).select("id", "r.*")


def named_entities(df: DataFrame) -> DataFrame:
    """O-166: ``id, name, entity_type``: addresses, links and capitalised or numbered names, typed by their marks.

    A name that is a side of a relation (O-167) is a person on its left and, if it looks like one, a place or an
    organisation on its right. Names are distinct by type without regard to case and marks, in the first spelling.
    """
    spans = lambda p: F.regexp_extract_all("content", F.lit(f"({p})"), F.lit(1))
    kinds = F.concat(
        F.transform(spans(EMAIL), lambda v: F.struct(v.alias("name"), F.lit("concept").alias("fixed"))), F.transform(spans(URL), lambda v: F.struct(v.alias("name"), F.lit("product").alias("fixed"))),
        F.transform(spans(CANDIDATE), lambda v: F.struct(F.regexp_replace(v, r"^[,.;:\"'()\[\]]+|[,.;:\"'()\[\]]+$", "").alias("name"), F.lit(None).cast("string").alias("fixed"))),
    )
    each = df.select("id", F.posexplode(kinds).alias("at", "e")).select("id", "at", "e.*").where(F.col("fixed").isNotNull() | ~F.lower("name").isin(COMMON)).withColumn("key", normalize_name(F.col("name")))
    told = extract_relations(df)
    people = told.select("id", normalize_name(F.col("source")).alias("key"), F.lit(True).alias("person")).distinct()
    low, name = F.col("key"), F.col("name")
    marked = lambda text, marks: reduce(lambda a, b: a | b, [text.contains(m) for m in marks])
    organisation = name.rlike("^[A-Z0-9_-]+$") | marked(F.lower(name), ORGANISATIONS)
    words = F.split(name, r"\s+")
    person = ((F.size(words) <= 3) & F.forall(words, lambda w: w.rlike("^[A-Z]"))) | (F.octet_length(name) <= 8)
    kind = F.coalesce("fixed", F.when(F.col("person"), "person").when(marked(low, LOCATIONS), "location").when(organisation, "organization").when(F.lower(name).rlike("[0-9]") | marked(F.lower(name), PRODUCTS), "product").when(person, "person").otherwise("concept"))
    typed = each.join(people, ["id", "key"], "left").withColumn("entity_type", kind)
    return typed.groupBy("id", "key", "entity_type").agg(F.min_by("name", "at").alias("name")).select("id", "name", "entity_type")


def normalize_name(name: Column) -> Column:
    """O-169: lower-case letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "))


def entity_rollup(links: DataFrame) -> DataFrame:
    """O-126: per normalised name and type: occurrences, memories, first and last seen, number of spellings, trust."""
    out = links.groupBy(normalize_name(F.col("value")).alias("name"), "entity_type").agg(
        F.count("*").alias("occurrences"), F.countDistinct("id").alias("memories"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.countDistinct("value").alias("aliases")
    )
    return out.withColumn("trust", trust_score(F.col("occurrences")))


def trust_score(n: Column) -> Column:
    """O-185: min(1, .3 + .3 log2(1 + n))."""
    return F.least(F.lit(1.0), 0.3 + 0.3 * F.log2(1.0 + n))




def cooccurrence_score(n: Column) -> Column:
    return F.when(n <= 1, 0.0).when(n == 2, 0.55).when(n == 3, 0.65).when(n == 4, 0.75).otherwise(0.85)


def cooccurrence_edges(links: DataFrame) -> DataFrame:
    """O-168, O-127: pairs of entities of one memory, both directions; weight at most 10, confidence always 1.

    A memory's own entities are few, so the pairs come from its sorted array and not from a join on a
    frequent entity.
    """
    sets = links.groupBy("id").agg(F.array_sort(F.collect_set("entity")).alias("names"))
    sets = sets.withColumn("score", cooccurrence_score(F.size("names"))).where(F.size("names") > 1)
    pairs = sets.select("id", "score", "names", F.explode("names").alias("source")).select("id", "score", "source", F.explode("names").alias("target")).where("source <> target")
    return pairs.groupBy("source", "target").agg(F.least(F.lit(10.0), F.sum("score")).alias("weight"), F.max("score").alias("cooccurrence"), F.count("*").alias("support"), F.lit(1.0).alias("confidence"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """O-47: nodes with in- and out-degree, 0 where there is none."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in_degree"))
    return nodes.join(out, "node", "left").join(into, "node", "left").na.fill(0, ["out_degree", "in_degree"])


def hub_nodes(edges: DataFrame, nodes: DataFrame, least: int, limit: int) -> DataFrame:
    """O-113."""
    total = degrees(edges, nodes).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    return total.where(F.col("degree") >= least).orderBy(F.desc("degree"), "node").limit(limit)


def hotspots(edges: DataFrame, nodes: DataFrame, least: float, limit: int) -> DataFrame:
    """O-114: complexity times (in-degree + 1)."""
    risk = degrees(edges, nodes).where(F.col("complexity") >= least).withColumn("risk", F.col("complexity") * (F.col("in_degree") + 1))
    return risk.orderBy(F.desc("risk"), F.desc("complexity"), "node").limit(limit)


def neighbours(edges: DataFrame, node: str, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """O-172."""
    e = edges if not types else edges.where(F.col("relation_type").isin(types))
    out = e.where(F.col("source") == node).select(F.col("target").alias("node"), "relation_type", F.lit("out").alias("direction"))
    into = e.where(F.col("target") == node).select(F.col("source").alias("node"), "relation_type", F.lit("in").alias("direction"))
    return out if direction == "out" else into if direction == "in" else out.union(into)


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """O-173, O-174, O-177, O-188: ``seed, node, depth``: least number of steps to each node; seeds are left out.

    ``seeds``: a column ``node``. Each round joins the frontier with the edges and drops what was met.
    """
    links = edges.select(F.col("source").alias("at"), F.col("target").alias("to")).distinct()
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for step in range(1, depth + 1):
        found = frontier.join(links, frontier.node == links["at"]).select("seed", F.col("to").alias("node")).distinct()
        # without this each round would hold the plans of all rounds before it twice
        frontier = settled(found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def k_hop_edges(edges: DataFrame, start: str, k: int) -> DataFrame:
    """O-180: distinct edges within k outward steps."""
    seeds = edges.sparkSession.createDataFrame([(start,)], "node string")
    nodes = reachable(edges, seeds, k - 1).select("node").union(seeds) if k > 1 else seeds
    return edges.join(nodes.distinct().withColumnRenamed("node", "source"), "source", "left_semi").select("source", "target").distinct()


def all_paths(edges: DataFrame, start: str, goal: str, depth: int) -> DataFrame:
    """O-181: simple paths (no node twice) of at most ``depth`` edges, as nodes joined by ``>``."""
    links = edges.select(F.col("source").alias("at"), F.col("target").alias("to")).distinct()
    paths = edges.sparkSession.createDataFrame([(start, [start])], "node string, path array<string>")
    done = None
    for _ in range(depth):
        step = paths.where(F.col("node") != goal).join(links, F.col("node") == F.col("at")).where(~F.array_contains("path", F.col("to")))
        paths = step.select(F.col("to").alias("node"), F.array_append("path", F.col("to")).alias("path"))
        hit = paths.where(F.col("node") == goal)
        done = hit if done is None else done.unionByName(hit)
    return done.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("edges"))


def shortest_path(edges: DataFrame, start: str, goal: str, depth: int) -> DataFrame:
    """O-179: fewest edges, ties by the path's text: ``path, edges``.

    Rounds of a frontier in which every node keeps only its least path: of paths of equal length to a node that with the smaller text
    stays the smaller one however it goes on, so nothing but one row a node is carried.
    """
    links = edges.select(F.col("source").alias("at"), F.col("target").alias("to")).distinct()
    frontier = edges.sparkSession.createDataFrame([(start, start)], "node string, path string")
    seen = frontier.select("node")
    for step in range(1, depth + 1):
        found = frontier.join(links, F.col("node") == F.col("at")).select(F.col("to").alias("node"), F.concat("path", F.lit(">"), "to").alias("path"))
        frontier = settled(found.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"))
        hit = frontier.where(F.col("node") == goal)
        if not hit.isEmpty() or frontier.isEmpty():
            return hit.select("path", F.lit(step).alias("edges"))
        seen = seen.unionByName(frontier.select("node"))
    return frontier.where(F.lit(False)).select("path", F.lit(0).alias("edges"))


def best_confidence(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """O-178: least sum of (1 - confidence) to each node, relaxed round by round (Bellman-Ford)."""
    links = edges.groupBy(F.col("source").alias("at"), F.col("target").alias("to")).agg(F.min(1.0 - F.col("confidence")).alias("step"))
    cost = edges.sparkSession.createDataFrame([(start, 0.0)], "node string, cost double")
    for _ in range(depth):
        further = cost.join(links, F.col("node") == F.col("at")).select(F.col("to").alias("node"), (F.col("cost") + F.col("step")).alias("cost"))
        # used twice in the next round: without this the plan doubles each time
        cost = settled(cost.unionByName(further).groupBy("node").agg(F.min("cost").alias("cost")))
    return cost.where(F.col("node") != start)


def graph_hops_sql(spark, edges_view: str, seeds: list[str], depth: int) -> DataFrame:
    """O-175, O-44: recursion in SQL; a target whose name is already part of the path's text is not entered."""
    names = ", ".join("'" + s.replace("'", "''") + "'" for s in seeds)
    return spark.sql(f"""
        WITH RECURSIVE hops(node, depth, path) AS (
            SELECT source, 0, CAST(source AS STRING) FROM {edges_view} WHERE source IN ({names}) GROUP BY source
            UNION ALL
            SELECT e.target, h.depth + 1, concat(h.path, '>', e.target) FROM hops h JOIN {edges_view} e ON e.source = h.node
            WHERE h.depth < {int(depth)} AND instr(h.path, e.target) = 0)
        SELECT node, depth, path FROM hops WHERE depth > 0""")  # noqa: S608


def contradictions(edges: DataFrame) -> DataFrame:
    """O-183: edges of a triple that an earlier edge of another provenance has; with that first edge."""
    w = Window.partitionBy("source", "target", "relation_type").orderBy("created_at", "id")
    first = edges.withColumns({"first_id": F.first("id").over(w), "first_provenance": F.first("provenance").over(w)})
    return first.where("id <> first_id AND provenance <> first_provenance").select("id", "first_id")


def belief_confidence(source: Column, length: Column) -> Column:
    """O-184: by the kind of source, and up to .05 for length."""
    base = F.when(source == "verified", 0.95).when(source == "user", 0.8).when(source == "system", 0.6).when(source == "inferred", 0.7).otherwise(0.5)
    return base + F.least(length / 100.0, F.lit(0.05))


def belief_search(edges: DataFrame, query: str) -> DataFrame:
    """O-176: words of three letters or more in source, target or relation; most confident first."""
    words = [w for w in query.lower().split() if len(w) > 2]
    text = F.lower(F.concat_ws(" ", "source", "target", "relation_type"))
    return edges.where(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w)) if words else F.lit(False)).orderBy(F.desc("confidence"), "id")


def works_at(text: Column) -> Column:
    """O-187: person and place around exactly one ' works at '."""
    parts = F.split(text, " works at ")
    return F.when(F.size(parts) == 2, F.struct(F.trim(parts[0]).alias("person"), F.trim(parts[1]).alias("place")))


def symbol_id(project: Column, path: Column, name: Column, kind: Column, line: Column) -> Column:
    """O-191: SHA-256 over the parts and the line as four bytes, the lowest first."""
    high_first = F.lpad(F.hex(line.cast("long")), 8, "0")
    low_first = F.concat(*[F.substring(high_first, k, 2) for k in (7, 5, 3, 1)])
    return F.sha2(F.concat(F.concat_ws("|", project, path, name, kind, F.lit("")).cast("binary"), F.unhex(low_first)), 256)
