"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size, from two hashes of its name. Shards take turns
claiming their next free slot, a shard of weight w that many times per turn, until the table is full. A row's key is hashed
to a slot, and the slot names the shard. Shares differ by a turn at most, and when a shard leaves or joins few slots change hands.

The table follows from the shard names alone and has at most MOST_SLOTS slots, whatever the data; it is filled on the
driver and broadcast. Rows are placed by one hash and one lookup, without a shuffle.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: a prime; the default size of the table.
SLOTS = 65_537
#: Fixed value: a prime; no table is larger, which bounds what is broadcast to a few MB.
MOST_SLOTS = 655_373


def slot_owners(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """The place in shards of each slot's owner."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must have distinct names, one at least")
    if slots > MOST_SLOTS or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    number = lambda name, salt: int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")
    at = [number(s, "offset") % slots for s in shards]
    step = [number(s, "step") % (slots - 1) + 1 for s in shards]
    turns = [max(1, (weights or {}).get(s, 1)) for s in shards]
    owners, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            for _ in range(min(turns[i], left)):
                while owners[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % slots
                owners[at[i]] = i
                left -= 1
    return owners


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, from the first 60 bits of its text's MD5; null keys share the slot of the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """The table: slot, shard."""
    owners = F.split(F.lit(",".join(map(str, slot_owners(shards, slots, weights)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1).select(F.posexplode(owners).alias("_slot", "owner")).select(
        F.col("_slot").cast("int").alias("_slot"), F.element_at(names, F.col("owner").cast("int") + 1).alias("_shard"))


def place(rows: DataFrame, key: Column, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """rows with slot (int) and shard (string); columns of these names are replaced.

    Null and empty keys go to one slot. Equal keys go to one shard, so rows of a hot key do; choose a key of many values,
    or a struct of it and another column, to split them. An empty table stays empty.
    """
    table = lookup(rows.sparkSession, shards, slots, weights)
    placed = rows.withColumn("_slot", slot_of(key, slots)).join(F.broadcast(table), "_slot")
    return placed.withColumns({"slot": F.col("_slot"), "shard": F.col("_shard")}).drop("_slot", "_shard")


def write_shards(placed: DataFrame, path: str, files: int = 1) -> None:
    """The placed rows, a folder per shard with about `files` files each."""
    salt = F.pmod(F.xxhash64("slot"), F.lit(files))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
