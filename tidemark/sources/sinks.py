"""Reports, manifests, query files, tables and stage settings."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    """A small summary as CSV with a header, in one file below `path`; null is empty."""
    rows.coalesce(1).write.mode("overwrite").option("header", "true").option("nullValue", "").csv(path)


def write_json(value: dict[str, Any], path: str | Path) -> None:
    """A manifest, its keys sorted, put in place at once."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    part.replace(path)


def write_lines(rows: DataFrame, column: str, order: str, path: str) -> None:
    """One text a line in order of `order`; line breaks inside a text become spaces, empty texts go."""
    line = F.btrim(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " "))
    rows.select(line.alias("value"), order).where("value <> ''").orderBy(order).select("value").write.mode("overwrite").text(path)


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and text of a file's lines in order, blank ones skipped; a file without lines is an error.

    A file is one row here, so a query file has to fit a task.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.filter(F.transform(F.split("value", "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")).alias("line", "text"))
    some = lines.agg(F.assert_true(F.count(F.lit(1)) > 0, F.lit("no queries")).alias("some"))
    return some.join(lines, F.col("some").isNull(), "left").select("line", "text")


def save_table(rows: DataFrame, name: str) -> None:
    rows.write.mode("overwrite").saveAsTable(name)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key."""
    return old.join(new, key, "left_anti").unionByName(new)


def table_text(rows: DataFrame, n: int = 100) -> str:
    """The first n rows as an aligned table, as a report prints them."""
    shown = [rows.columns, *[["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows.limit(n).collect()]]
    width = [max(len(r[k]) for r in shown) for k in range(len(rows.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in shown)


#: Settings that tell a stage's result from another's; a stage is run again when one differs.
STAGES = {
    "load": ["dataset", "n_docs", "n_queries", "min_doc_chars", "min_query_chars", "seed", "source", "doc_field", "query_field", "max_source_records"],
    "embed": ["dataset", "model", "revision", "dim", "normalised", "input_sha1"],
    "truth": ["dataset", "k", "metric", "input_sha1"],
    "table": ["dataset", "table", "index", "dim", "m", "ef_construction", "input_sha1"],
    "sweep": ["dataset", "k", "ef_grid", "repeats", "input_sha1", "table"],
}


def stage_key(stage: str, **settings: Any) -> dict[str, Any]:
    """The wanted manifest of a stage for corpora.cache_matches; unknown or missing settings are refused."""
    want = STAGES[stage]
    if set(settings) != set(want):
        raise ValueError(f"{stage}: settings differ in {sorted(set(settings) ^ set(want))}")
    return {"stage": stage, **{k: settings[k] for k in want}}


def run_stage(manifest: str | Path, wanted: dict[str, Any], run, force: bool = False) -> bool:
    """Run a stage unless its manifest meets `wanted`; run() may return more for the manifest. Whether it ran."""
    from tidemark.sources.corpora import cache_matches

    path = Path(manifest)
    if not force and path.exists() and cache_matches(json.loads(path.read_text()), wanted):
        return False
    write_json({**wanted, **(run() or {})}, path)
    return True


def table_name(dataset: str) -> str:
    return f"docs_{dataset}"


def index_name(dataset: str) -> str:
    return f"{table_name(dataset)}_embedding_idx"


def dataset_dir(root: str | Path, dataset: str, what: str) -> Path:
    return Path(root) / dataset / what


def of_dataset(rows: DataFrame, dataset: str) -> DataFrame:
    return rows.where(F.col("dataset") == dataset)
