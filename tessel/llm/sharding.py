"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table (an offset and a step from its name's hash);
shards take turns claiming their first free slot. A key's slot is its hash modulo the table size, and the table, whose
size is fixed, is broadcast. Taking a shard away moves few keys besides its own. Native: DataFrame functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime well over a hundred times the number of shards, so that shares differ by about one in a hundred at most.
TABLE_SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The table: slot -> index of its shard."""
    if not shards or len(set(shards)) != len(shards) or not is_prime(size) or len(shards) > size:
        raise ValueError("shards must be distinct, and as many at most as a prime table has slots")
    hashed = [int(hashlib.md5(s.encode()).hexdigest(), 16) for s in shards]
    offset, step = [h % size for h in hashed], [(h >> 64) % (size - 1) + 1 for h in hashed]
    table, tried, left = [-1] * size, [0] * len(shards), size
    while left:
        for k in range(len(shards)):
            while table[slot := (offset[k] + tried[k] * step[k]) % size] >= 0:
                tried[k] += 1
            table[slot] = k
            tried[k] += 1
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot: the first 32 bits of the MD5 of its text, modulo the table size."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % size).cast("int")


def place(docs: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` added (columns of these names are replaced): one row for each row.

    Placement needs no shuffle and looks at nothing but the key. A null key counts as the empty text; rows with equal
    keys, repeated rows among them, share a shard (see ``place_hot`` for keys that a shard can't hold). Keys of any
    length count whole; other columns stay, whatever their names; an empty table gives an empty result.
    """
    return _with_table(docs.withColumn("slot", slot_of(F.col(key_col), size)), shards, size)


def _with_table(docs: DataFrame, shards: list[str], size: int) -> DataFrame:
    listed = F.split(F.lit(",".join(map(str, fill(shards, size)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    table = docs.sparkSession.range(1).select(F.posexplode(listed).alias("slot", "k")).select("slot", F.element_at(names, F.col("k").cast("int") + 1).alias("shard"))
    return docs.drop("shard").join(F.broadcast(table), "slot", "left")


def place_hot(docs: DataFrame, shards: list[str], key_col: str, spread_col: str, most: int, size: int = TABLE_SIZE) -> DataFrame:
    """As ``place``, but a key with over ``most`` rows is split over so many sub-keys that each should have fewer.

    Rows of a hot key are dealt by the hash of ``spread_col``; rows with equal keys and spread values stay together, and
    a null key is a key like others. Hot keys number fewer than rows / ``most``. Columns of any name stay, but ``slot``
    and ``shard`` are replaced; an empty table gives an empty result; keys of any length count whole.
    """
    own = "hot_" + hashlib.md5("\n".join(docs.columns).encode()).hexdigest()  # no column's name
    hot = docs.groupBy(F.col(key_col).alias(own)).agg(F.count(F.lit(1)).alias(own + "_n")).where(F.col(own + "_n") > most)
    joined = docs.join(hot, F.col(key_col).eqNullSafe(F.col(own)), "left")
    parts = F.ceil(F.coalesce(F.col(own + "_n"), F.lit(1)) / F.lit(most))
    salt = F.when(parts > 1, F.concat(F.lit("\x1f"), F.pmod(F.xxhash64(spread_col), parts).cast("string"))).otherwise(F.lit(""))
    key = F.concat(F.coalesce(F.col(key_col).cast("string"), F.lit("")), salt)
    return _with_table(joined.withColumn("slot", slot_of(key, size)).drop(own, own + "_n"), shards, size)


def sql(shards: list[str], size: int = TABLE_SIZE) -> str:
    table, names = ",".join(map(str, fill(shards, size))), ",".join(shards)
    return f"""
WITH t AS MATERIALIZED (SELECT CAST(unnest(range({size})) AS INTEGER) AS slot, CAST(unnest(string_split('{table}', ',')) AS INTEGER) AS k),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {size} AS INTEGER) AS slot FROM documents)
SELECT d.doc_id, d.slot, string_split('{names}', ',')[t.k + 1] AS shard FROM d JOIN t USING (slot)
"""
