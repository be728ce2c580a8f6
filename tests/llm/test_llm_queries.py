"""The pN queries against their SQL, on dirtied tables, and on empty ones."""

import pytest
from pyspark.sql import functions as F
from test_queries import connect, rows

from lexmill.llm import queries, sql
from lexmill.session import table

QUERIES, SQL = queries.queries(), sql.oracle_sql()
TABLES = ["documents", "manifests", "token_counts", "near_edges", "benchmark_items", "source_settings", "mix_targets", "tokenizer_pieces"]
KEYS = {"documents": "doc_id", "manifests": "document_id", "token_counts": "document_id", "near_edges": "left_rowid", "benchmark_items": "item_id"}
CLASHES = ["id", "key", "n", "l", "r", "v", "a", "b", "h", "g", "rep", "bits", "feature", "label", "present", "component"]


@pytest.mark.parametrize("name", list(SQL))
def test_same_as_sql(spark, small, name):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(connect(small).execute(SQL[name]).df())


@pytest.fixture(scope="module")
def dirty(spark, small, tmp_path_factory):
    """Every row twice, a row of nulls for each key, a row of nulls in all, and extra columns with names that operators use."""
    root = str(tmp_path_factory.mktemp("dirty"))
    for name in TABLES:
        df = table(spark, small, name)
        out = df.unionByName(df) if name in KEYS else df
        if name in KEYS:
            bare = df.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
            out = out.unionByName(bare)
            if name in ("documents", "benchmark_items"):
                out = out.unionByName(bare.withColumn(KEYS[name], F.lit(-5).cast("bigint"))).unionByName(bare.withColumns({KEYS[name]: F.lit(-6).cast("bigint"), "text": F.lit("")}))
        out = out.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})
        out.write.parquet(f"{root}/{name}.parquet")
    return root


FOUND = ["p1_mix", "p2_found", "p2_splits", "p3_found", "p4_found", "p6_found", "p6_report", "p6_texts", "p6_overlaps", "p7_sample", "p9_found", "p10_found"]


@pytest.mark.parametrize("name", FOUND)
def test_dirt_changes_nothing(spark, small, dirty, name):
    assert rows(QUERIES[name](spark, dirty).toPandas()) == rows(QUERIES[name](spark, small).toPandas())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in FOUND])
def test_dirt_does_not_break(spark, dirty, name):
    assert QUERIES[name](spark, dirty).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty(spark, small, tmp_path, name):
    for t in TABLES:
        table(spark, small, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert not got or name in ("p8_fill", "p5_budget", "p2_check", "p8_check")
