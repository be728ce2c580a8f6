"""Configurations: canonical JSON and its digest, flattening to dotted paths, replacement in all strings, and their differences as tables."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces, so that equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def pretty(value: Any) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def digest(*values: Any) -> str:
    """SHA-256 of one value's canonical JSON; of several, of their digests one after the other."""
    if len(values) == 1:
        return hashlib.sha256(canonical(values[0]).encode()).hexdigest()
    return hashlib.sha256("".join(map(digest, values)).encode()).hexdigest()


def flat(value: Any, at: str = "") -> dict[str, Any]:
    """Leaves by dotted path; lists count as leaves, empty objects too."""
    if not isinstance(value, dict) or not value:
        return {at: value} if at else {}
    return {path: leaf for k, v in value.items() for path, leaf in flat(v, f"{at}.{k}" if at else str(k)).items()}


def replaced(value: Any, old: str, new: str) -> Any:
    """The value with ``old`` replaced in every string in it, keys left as they are."""
    if isinstance(value, str):
        return value.replace(old, new)
    if isinstance(value, dict):
        return {k: replaced(v, old, new) for k, v in value.items()}
    return [replaced(v, old, new) for v in value] if isinstance(value, list) else value


def load(path: str, prefix: str = "LEXMILL_") -> dict[str, Any]:
    """A JSON configuration; an environment variable PREFIX + PATH (dots as two underscores) overrides a leaf, read as JSON if it is any."""
    out = json.loads(Path(path).read_text(encoding="utf-8"))
    for name, text in os.environ.items():
        keys = name.removeprefix(prefix).lower().split("__")
        at = out
        for k in keys[:-1]:
            at = at.get(k) if isinstance(at, dict) else None
        if name.startswith(prefix) and isinstance(at, dict) and keys[-1] in at:
            try:
                at[keys[-1]] = json.loads(text)
            except ValueError:
                at[keys[-1]] = text
    return out


def paths(configs: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, value (canonical JSON) of every leaf of the JSON objects in a column; null or broken JSON has none."""
    kind = configs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, value in enumerate(batch.column(1).to_pylist()):
                try:
                    rows += [(i, p, canonical(v)) for p, v in flat(json.loads(value or "null")).items()]
                except ValueError:
                    continue
            at, path, leaf = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(path, pa.string()), pa.array(leaf, pa.string())], names=[key, "path", "value"])

    return configs.select(key, column).mapInArrow(run, f"{key} {kind}, path string, value string")


def differences(leaves: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """path, holders, values, missing, allowed: the paths on which configurations differ, or that some lack (``missing``)."""
    total = leaves.agg(F.count_distinct(key).alias("_all"))
    per = leaves.groupBy("path").agg(F.count_distinct(key).alias("holders"), F.count_distinct("value").alias("values"))
    rows = per.join(F.broadcast(total)).withColumn("missing", F.col("_all") - F.col("holders"))  # one row
    return rows.where("values > 1 or missing > 0").select("path", "holders", "values", "missing", F.col("path").isin(allowed).alias("allowed"))
