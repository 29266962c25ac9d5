"""Shards by a lookup table that the shards fill in turn.

Every shard has a permutation of the slots of a table of prime size: offset + j * skip.  Shards take turns;
on its turn a shard claims its next slot that is still free.  Their shares differ by one slot at most, and
when a shard comes or goes most slots keep their owner.  A document's slot is a hash of its key, and the
table, whose size is a parameter, goes to every task: placement needs no shuffle and time that is constant.

Null keys are placed as the empty key.  Rows with equal keys go to the same shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import number_of

SHARDS = tuple(f"shard-{n:02d}" for n in range(16))
SLOTS = 1601  # a prime, and at least a hundred slots a shard
NEAR = 32  # preferences that a turn looks at first


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def owners(shards: tuple[str, ...], slots: int) -> Column:
    """The table as an array: at each slot the number of its shard."""
    if not is_prime(slots) or slots < len(shards) or not shards:
        raise ValueError("the number of slots has to be a prime and at least that of the shards")
    n, size = len(shards), F.lit(slots)
    offsets = F.array(*(number_of(F.lit(f"{name}/offset")) % slots for name in shards))
    skips = F.array(*(number_of(F.lit(f"{name}/skip")) % (slots - 1) + 1 for name in shards))

    def slot(shard: Column, j: Column) -> Column:
        return ((F.get(offsets, shard) + j * F.get(skips, shard)) % size).cast("int")

    def turn(state: Column, k: Column) -> Column:
        shard = k % n
        first = F.get(state["next"], shard)

        def free(start: Column, stop: Column) -> Column:
            return F.get(F.filter(F.sequence(start, stop), lambda j: F.get(state["owner"], slot(shard, j)) < 0), F.lit(0))

        def claim(j: Column) -> Column:
            at = slot(shard, j)
            return F.struct(replaced(state["owner"], at, shard, slots).alias("owner"), replaced(state["next"], shard, j + 1, n).alias("next"))

        found = F.coalesce(free(first, F.least(first + NEAR, size - 1)), free(F.least(first, size - 1), size - 1))
        return F.get(F.transform(F.array(found), claim), F.lit(0))

    start = F.struct(F.array_repeat(F.lit(-1), slots).alias("owner"), F.array_repeat(F.lit(0), n).alias("next"))
    return F.aggregate(F.sequence(F.lit(0), size - 1), start, turn, lambda state: state["owner"])


def replaced(values: Column, at: Column, value: Column, length: int) -> Column:
    return F.concat(F.slice(values, F.lit(1), at), F.array(value.cast("int")), F.slice(values, at + 2, F.lit(length)))


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row per slot: slot, shard_no, shard."""
    table = spark.range(1).select(F.posexplode(owners(shards, slots)).alias("slot", "shard_no"))
    return table.withColumn("shard", F.get(F.array(*map(F.lit, shards)), F.col("shard_no")))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return (number_of(F.coalesce(key.cast("string"), F.lit(""))) % slots).cast("int")


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def place(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``, which replace columns of these names; all others stay, whatever their names.  The broadcast has ``slots`` rows."""
    number, name = _unused("_slot", docs.columns), _unused("_shard", docs.columns)
    table = lookup_table(docs.sparkSession, shards, slots).select(F.col("slot").alias(number), F.col("shard").alias(name))
    rows = docs.withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(table), rows["slot"] == table[number]).withColumn("shard", F.col(name)).drop(number, name)


def write_shards(placed: DataFrame, path: str, files: int = 8) -> None:
    """One folder per shard; each shard is spread over ``files`` tasks, however many rows it has."""
    part = F.pmod(F.xxhash64(*placed.columns), F.lit(files))
    placed.repartition("shard", part).write.partitionBy("shard").parquet(path)


SHARDS_SQL = f"""
with recursive names as (select i, 'shard-' || lpad(i::varchar, 2, '0') as shard from range({len(SHARDS)}) t(i)),
prefs as (
  select list(('0x' || substr(md5(shard || '/offset'), 1, 13))::bigint % {SLOTS} order by i) as offsets,
         list(('0x' || substr(md5(shard || '/skip'), 1, 13))::bigint % ({SLOTS} - 1) + 1 order by i) as skips from names),
filled(k, owner, next) as (
  select 0, list_transform(range({SLOTS}), lambda x: -1), list_transform(range({len(SHARDS)}), lambda x: 0) union all
  select k + 1, list_transform(owner, lambda o, s: case when s - 1 = place then k % {len(SHARDS)} else o end),
         list_transform(next, lambda j, i: case when i - 1 = k % {len(SHARDS)} then found + 1 else j end)
  from (
    select k, owner, next, found, (offsets[k % {len(SHARDS)} + 1] + found * skips[k % {len(SHARDS)} + 1]) % {SLOTS} as place from (
      select k, owner, next, offsets, skips, list_filter(range(next[k % {len(SHARDS)} + 1], {SLOTS}),
        lambda j: owner[((offsets[k % {len(SHARDS)} + 1] + j * skips[k % {len(SHARDS)} + 1]) % {SLOTS} + 1)::int] < 0)[1] as found
      from filled, prefs where k < {SLOTS}))),
lookup as (
  select unnest(range({SLOTS}))::int as slot, unnest(owner)::int as shard_no from filled where k = {SLOTS})
"""
OP6_SQL = (
    SHARDS_SQL
    + f"""
select d.doc_id, d.slot, n.shard
from (select doc_id, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint % {SLOTS})::int as slot from documents) d
join lookup l on d.slot = l.slot join names n on n.i = l.shard_no
"""
)
