"""Sharding by a permutation-filled lookup table of prime size.

Every shard has a preference order over the slots, ``(offset + j * skip) mod size``.  Shards
take turns; at its turn a shard claims the first slot of its order that is still free.  A row
goes to the shard that holds slot ``hash(key) mod size``.  Adding or removing a shard moves few
rows, and the table's size depends on the shard list alone, never on the data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import column, fresh

#: A prime about 100 times the default shard count, that count, and rows in a file.
TABLE_SIZE = 6553
N_SHARDS = 64
ROWS_PER_FILE = 500_000


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index into ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime of at least the number of shards")
    orders = [preference(s, size) for s in shards]
    turn = [0] * len(shards)
    table, left = [-1] * size, size
    while left:
        for k, (offset, skip) in enumerate(orders):
            while table[slot := (offset + turn[k] * skip) % size] >= 0:
                turn[k] += 1
            table[slot], left = k, left - 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int) -> Column:
    """60 bits of the key's MD5, modulo the prime; a null key counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint") % F.lit(size)


def assign_shards(df: DataFrame, key: str, shards: list[str] | None = None, size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` plus ``slot_col`` (bigint) and ``shard_col`` (string).

    Native: the table is a literal array of ``size`` entries inside the plan, which reaches each
    executor once with the task and is indexed in constant time; there is no shuffle, and equal
    keys, even a third of all rows, need no meeting place.  Null keys go to one fixed shard,
    repeated rows to the same one, an empty input stays empty.  An input column with the
    name of an output column raises ``ValueError``: choose other names.
    """
    if taken := {slot_col.lower(), shard_col.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(taken)} are in the input already")
    shards = shards or [f"shard-{k:05d}" for k in range(N_SHARDS)]
    names = F.split(F.lit("\x00".join(shards[k] for k in lookup_table(shards, size))), "\x00")
    slot = slot_of(column(key), size)
    return df.withColumn(slot_col, slot).withColumn(shard_col, F.element_at(names, (F.col(slot_col) + 1).cast("int")))


def write_shards(df: DataFrame, key: str, path: str, shards: list[str] | None = None, size: int = TABLE_SIZE, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write one folder per shard, in files of about ``rows_per_file`` rows.

    Rows are counted by shard first (as many numbers as shards reach the driver), so that a shard with a hot key gets as many
    tasks as it needs.  Its rows are dealt by the hash of all columns (but maps) and of the input partition, so that rows repeated without end are spread as well.
    """
    names = shards or [f"shard-{k:05d}" for k in range(N_SHARDS)]
    slot, shard, salt = fresh(df.columns, "slot", "shard", "salt")
    out = assign_shards(df, key, names, size, slot, shard)
    files = {r[0]: -(-r[1] // rows_per_file) for r in out.groupBy(shard).agg(F.count("*")).collect()}
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in files.items() for x in kv]), F.col(shard)), F.lit(1)) if files else F.lit(1)
    mixed = F.xxhash64(*[column(c) for c, t in df.dtypes if "map<" not in t], F.spark_partition_id())
    dealt = out.withColumn(salt, F.pmod(mixed, most)).repartition(max(1, sum(files.values())), shard, salt)
    dealt.drop(slot, salt).write.partitionBy(shard).mode("overwrite").parquet(path)
