"""Identities and ranks from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 2026
SPLITS = (("train", 900), ("validation", 950), ("test", 1000))
TOP = 18_446_744_073_709_551_616


def joined(*parts: Column) -> Column:
    return F.concat_ws("\0", *[p.cast("string") for p in parts])


def digest(*parts: Column) -> Column:
    return F.sha2(joined(*parts), 256)


def stable_int(*parts: Column) -> Column:
    """The first 64 bits of the digest, as decimal(20, 0)."""
    return F.conv(F.substring(digest(*parts), 1, 16), 16, 10).cast("decimal(20,0)")


def document_id(source: Column, text: Column) -> Column:
    return digest(source, text)


def raw_record_id(source: Column, shard: Column, row: Column) -> Column:
    return digest(source, shard, row)


def near_cluster_id(representative: Column) -> Column:
    return digest(F.lit("near"), representative)


def split_bucket(identifier: Column, seed: int = SEED) -> Column:
    return F.pmod(stable_int(identifier, F.lit(str(seed))), F.lit(1000)).cast("int")


def split_of(bucket: Column) -> Column:
    out = F.lit(SPLITS[-1][0])
    for name, upto in reversed(SPLITS[:-1]):
        out = F.when(bucket < upto, name).otherwise(out)
    return out


def sampling_rank(label: str, identifier: Column, seed: int = SEED) -> Column:
    return digest(F.lit(label), F.lit(str(seed)), identifier)


def name_seed(base: Column, name: Column) -> Column:
    return F.pmod(base.cast("bigint") * 1000003 + F.crc32(name), F.lit(2147483647))
