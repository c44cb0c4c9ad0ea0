"""Metadata resolution and filters (O-20..O-25): JSON once into flat columns, then plain predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import parse_time

NAMESPACE = ("org_id", "workspace_id", "user_id", "agent_id", "session_id", "project", "scope")
PROVENANCE = ("source_app", "source_type", "source_id", "file_path", "repo_url", "symbol")


def _value(metadata: Column, *paths: str) -> Column:
    """The first path with a value that is not blank."""
    found = [F.get_json_object(metadata, f"$.{p}") for p in paths]
    return F.coalesce(*[F.when(F.trim(v) != "", F.trim(v)) for v in found])


def kind_from_path(path: Column) -> Column:
    """Ordered: the first kind of place that the path names."""
    p, rule = F.lower(path), None
    for kind in ("repo", "branch", "symbol", "session", "task", "meeting", "url"):
        test = p.contains(kind)
        rule = F.when(test, kind) if rule is None else rule.when(test, kind)
    return rule.when(p.contains(".") | p.contains("/file") | p.startswith("file/"), "file")


def resolve_metadata(df: DataFrame) -> DataFrame:
    """O-20: ``metadata`` (JSON), ``path`` and ``workspace_id`` into ``kind``, ``evidence_kind``, ``ns_*``, ``prov_*``, times.

    Typed values come first, then top-level ones; the kind falls back to the path's and then to ``document``. Times
    that cannot be read are null.
    """
    m = F.col("metadata")
    fallback = {"project": ("project", "projects[0]"), "scope": ("scope", "gestalt_context")}
    columns = {f"ns_{n}": _value(m, f"namespace.{n}", *fallback.get(n, (n,))) for n in NAMESPACE}
    columns["ns_workspace_id"] = F.coalesce(columns["ns_workspace_id"], F.col("workspace_id"))
    more = {"source_type": ("source_type", "type"), "file_path": ("file_path", "source_path")}
    columns |= {f"prov_{n}": _value(m, f"provenance.{n}", *more.get(n, (n,))) for n in PROVENANCE}
    columns["prov_file_path"] = F.coalesce(columns["prov_file_path"], F.col("path"))
    columns["observed_at"] = parse_time(_value(m, "provenance.observed_at", "observed_at", "date"))
    columns["recorded_at"] = parse_time(_value(m, "provenance.recorded_at", "recorded_at"))
    columns["evidence_kind"] = _value(m, "evidence_kind", "provenance.evidence_kind")
    columns["kind"] = F.coalesce(_value(m, "kind", "memory_type", "type"), kind_from_path(F.col("path")), F.lit("document"))
    return df.withColumns(columns)


def normalize_metadata(df: DataFrame) -> DataFrame:
    """O-21: the resolved values written back as JSON (nulls left out)."""
    names = ["kind", "evidence_kind", *[f"ns_{n}" for n in NAMESPACE], *[f"prov_{n}" for n in PROVENANCE]]
    return resolve_metadata(df).withColumn("metadata", F.to_json(F.struct(*names)))


def matches_filters(
    kinds: list[str] | None = None, evidence: list[str] | None = None, equal: dict[str, str] | None = None, clusters: list[str] | None = None, levels: list[str] | None = None,
    observed: tuple[str | None, str | None] = (None, None), recorded: tuple[str | None, str | None] = (None, None),
) -> Column:
    """O-22: every given condition holds. Equality ignores ASCII case; a null never matches."""
    tests = [F.lit(True)]
    for name, values in (("kind", kinds), ("evidence_kind", evidence), ("cluster_id", clusters), ("level", levels)):
        if values:
            tests.append(F.coalesce(F.col(name).isin(values), F.lit(False)))
    for name, value in (equal or {}).items():
        tests.append(F.coalesce(F.lower(F.col(name)) == value.lower(), F.lit(False)))
    tests += [in_window(F.col("observed_at"), *observed), in_window(F.col("recorded_at"), *recorded)]
    return reduce(lambda a, b: a & b, tests)


def in_window(time: Column, after: str | None, before: str | None) -> Column:
    """O-23: both bounds count; without a time nothing matches, unless there is no bound."""
    if after is None and before is None:
        return F.lit(True)
    test = F.lit(True)
    if after is not None:
        test = test & (time >= F.lit(after).cast("timestamp"))
    if before is not None:
        test = test & (time <= F.lit(before).cast("timestamp"))
    return F.coalesce(test, F.lit(False))


def filter_records(df: DataFrame, needle: str, project: str | None = None) -> DataFrame:
    """O-24: the durable store's variant: case-sensitive substring of path, content or metadata."""
    out = df.where(F.col("path").contains(needle) | F.col("content").contains(needle) | F.col("metadata").contains(needle))
    return out if project is None else out.where(_value(F.col("metadata"), "namespace.project", "project") == project)


def primary_memories(df: DataFrame) -> DataFrame:
    """O-25: rows that are not derived from another."""
    return df.where(F.get_json_object("metadata", "$.source_path").isNull())


def merge_maps(mine: Column, other: Column) -> Column:
    """O-235: the entries of ``other`` whose keys ``mine`` lacks are added; null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    mine, other = F.coalesce(mine, empty), F.coalesce(other, empty)
    return F.map_concat(mine, F.map_filter(other, lambda k, _: ~F.map_contains_key(mine, k)))
