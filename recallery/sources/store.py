"""Tables of memories and their changes (O-01..O-06), files and exports (O-07..O-11, O-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def scan_memories(spark: SparkSession, path: str, workspace: str | None = None) -> DataFrame:
    """O-01: one workspace's rows; with a table partitioned by workspace only its folder is read."""
    df = spark.read.parquet(path)
    return df if workspace is None else df.where(F.col("workspace_id") == workspace)


def write_memories(df: DataFrame, path: str) -> None:
    df.write.partitionBy("workspace_id").mode("overwrite").parquet(path)


def get_by_id_or_path(df: DataFrame, key: str) -> DataFrame:
    """O-02: the row of that id, else of that path."""
    hit = df.where((F.col("id").cast("string") == key) | (F.col("path") == key))
    return hit.orderBy((F.col("id").cast("string") != key).cast("int"), "id").limit(1)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", time: str = "updated_at") -> DataFrame:
    """O-03: the newest row of each key; on equal times the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(time), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def revise(old: DataFrame, new: DataFrame) -> DataFrame:
    """O-04: changed rows keep id and creation time, gain a revision and remember the text before."""
    n = new.select("id", F.col("content").alias("_content"), F.col("updated_at").alias("_at"))
    out = old.join(n, "id", "left")
    changed = F.col("_content").isNotNull() & (F.col("_content") != F.col("content"))
    past = F.struct("revision", F.col("updated_at").alias("recorded_at"), "content")
    return out.withColumns({
        "revisions": F.when(changed, F.concat("revisions", F.array(past))).otherwise(F.col("revisions")), "revision": F.when(changed, F.col("revision") + 1).otherwise(F.col("revision")),
        "content": F.when(changed, F.col("_content")).otherwise(F.col("content")), "updated_at": F.when(changed, F.col("_at")).otherwise(F.col("updated_at")),
    }).drop("_content", "_at")


def delete_cascade(memories: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-05, O-49: the rows of these ids, their children and what links to either go."""
    ids = gone.select("id")
    children = memories.join(ids.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id")
    every = ids.union(children).distinct()
    return memories.join(every, "id", "left_anti"), links.join(every.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti")


def live_tokens(tokens: DataFrame, as_of: Column) -> DataFrame:
    """O-06, O-265: what has not expired."""
    return tokens.where(F.col("expires_at") > as_of)


def scan_files(spark: SparkSession, root: str, glob: str = "*", exclude: list[str] = ()) -> DataFrame:
    """O-07, O-08: files below a folder, without paths that hold an excluded part; contents are read only if selected."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    for part in exclude:
        df = df.where(~F.col("path").contains(part))
    return df


#: Extensions of source files by language.
CODE_EXTENSIONS = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp"}


def scan_code(spark: SparkSession, root: str, ignored: list[str] = ()) -> DataFrame:
    """O-08: source files with their language and text; ``ignored`` are patterns as in ignore files (``*`` and ``?``, whole path parts)."""
    files = scan_files(spark, root)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    language = F.create_map(*[F.lit(x) for pair in CODE_EXTENSIONS.items() for x in pair])
    for pattern in ignored:
        part = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "_-" else f"[{c}]") for c in pattern.strip("/"))
        files = files.where(~F.col("path").rlike(f"/{part}(/|$)"))
    return files.withColumn("language", F.try_element_at(language, extension)).where("language IS NOT NULL").select("path", "language", F.col("content").cast("string").alias("content"))


def training_export(memories: DataFrame, categories: dict[str, list[str]], path: str) -> None:
    """O-15: a line of JSON for each memory: instruction, response and category, the first of ``categories`` with a keyword in path or text."""
    text = F.lower(F.concat_ws(" ", "path", "content"))
    rule = F.lit("general")
    for name, words in reversed(list(categories.items())):
        rule = F.when(text.rlike("|".join(w.lower() for w in words)), name).otherwise(rule)
    rows = memories.where(F.length(F.trim("content")) > 0).select(F.concat(F.lit("What do you know about "), "path", F.lit("?")).alias("instruction"), F.col("content").alias("response"), rule.alias("category"))
    rows.write.mode("overwrite").json(path)


def write_chunks(df: DataFrame, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """O-09, O-269: rows as compressed JSON lines named by the hash of their content; known hashes are not written again.

    Returns the manifest of what was written: ``hash, id``.
    """
    line = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    hashed = df.withColumn("hash", F.sha2(line, 256)).dropDuplicates(["hash"])
    if manifest is not None:
        hashed = hashed.join(manifest.select("hash").distinct(), "hash", "left_anti")
    hashed.write.mode("append").option("compression", "gzip").json(folder)
    return hashed.select("hash", "id")


def import_chunks(spark: SparkSession, folder: str, known: DataFrame, schema) -> DataFrame:
    """O-286: rows of all chunks whose id is not known yet, each once."""
    rows = spark.read.schema(schema).json(folder)
    return rows.join(known.select("id").distinct(), "id", "left_anti").dropDuplicates(["id"])


def import_markdown(files: DataFrame) -> DataFrame:
    """O-10: ``path, value`` (whole files): header lines between ``---`` as a map, kind from ``memory_type``, the body; empty bodies go."""
    head = F.regexp_extract("value", r"(?s)\A---\s*\n(.*?)\n---\s*\n?", 1)
    body = F.trim(F.regexp_replace("value", r"(?s)\A---\s*\n.*?\n---\s*\n?", ""))
    pairs = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    header = F.map_from_arrays(F.transform(pairs, lambda x: F.trim(F.substring_index(x, ":", 1))), F.transform(pairs, lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))
    kind = F.col("header")["memory_type"]
    mapped = F.when(kind == "analysis", "fact").when(kind.isin("task", "decision", "url"), kind).when(kind == "project", "content_project").otherwise("document")
    return files.withColumns({"header": header, "content": body}).where("content <> ''").withColumn("kind", mapped).drop("value")


def import_export(df: DataFrame) -> DataFrame:
    """O-11: rows with arrays ``sessions``, ``observations`` and ``user_prompts`` as one table ``id, kind, content``."""
    s = df.select(F.explode("sessions").alias("x")).select("x.id", F.lit("session_summary").alias("kind"), F.concat(F.lit("Session "), "x.title").alias("content"))
    kind = F.when(F.col("x.type").isin("decision", "task"), F.col("x.type")).when(F.col("x.type") == "discovery", "fact").otherwise("document")
    o = df.select(F.explode("observations").alias("x")).select("x.id", kind.alias("kind"), "x.content")
    p = df.select(F.explode("user_prompts").alias("x")).select("x.id", F.lit("user_prompt").alias("kind"), "x.content")
    return s.unionByName(o).unionByName(p)


#: fields that a chain's hash covers, in this order
CHAINED = ["sequence", "agent_id", "operation", "memory_id", "payload", "ts"]


def chained_text(df: DataFrame) -> Column:
    """O-136: the fields of an event as one text; absent ones are empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CHAINED if c in df.columns])


def hash_chain_valid(chain: DataFrame) -> DataFrame:
    """O-136: each row's ``prev_hash`` is the hash before it and its own hash is right: checked in parallel by ``lag``."""
    w = Window.partitionBy("workspace_id").orderBy("sequence")
    before = F.coalesce(F.lag("curr_hash").over(w), F.lit(""))
    return chain.withColumn("valid", (F.col("prev_hash") == before) & (F.col("curr_hash") == F.sha2(F.concat_ws("|", "prev_hash", chained_text(chain)), 256)))


def build_hash_chain(events: DataFrame) -> DataFrame:
    """O-136: hashes that each rest on the one before, per workspace; sequential within a workspace by nature.

    ``events``: ``workspace_id, sequence`` and any of ``CHAINED``. Rows come sorted and in Arrow batches, so a task holds a
    batch and the last hash, not a workspace.
    """
    import hashlib

    import pyarrow as pa

    at = events.columns.index("workspace_id")
    schema = StructType([*events.schema.fields, StructField("prev_hash", StringType()), StructField("curr_hash", StringType())])

    def chain(batches):
        last, prev = None, ""
        for batch in batches:
            before, after = [], []
            for workspace, text in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                prev = prev if workspace == last else ""
                last = workspace
                before.append(prev)
                prev = hashlib.sha256(f"{prev}|{text}".encode()).hexdigest()
                after.append(prev)
            columns = [*batch.columns[:-1], pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "prev_hash", "curr_hash"])

    dealt = events.withColumn("_text", chained_text(events)).repartition("workspace_id").sortWithinPartitions("workspace_id", "sequence")
    return dealt.mapInArrow(chain, schema)
