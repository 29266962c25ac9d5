"""Mix sources to target weights by a low-discrepancy schedule of equal blocks of words.

Each source's documents are put in a shuffled order, which repeats, and that stream of words is cut into
blocks of equal size.  Slots of the mix are numbered; slot k has the point frac((k + 1/2) / golden ratio),
and the cumulative target shares map points to sources.  The slots of a source, ranked, take its blocks
one after another, until its target is reached.  Any prefix of the slots is thus close to the targets, with an
error of a few blocks.  The schedule has as many slots as there are blocks in the targets; blocks that are left when it
ends, a few per source, get closing slots after it, so that each source gives its whole target.  The last block of a
source is trimmed where its target ends.

Running sums go over buckets of a source and then within buckets, so that no task holds a whole source.
Null texts have no words, null sources are one source, rows without words take none, and rows with equal
ids are rows of their own.  Where nothing has a word, all targets are 0; an empty table gives no row.  Results
depend on ids and texts alone and not on partitions.  Of other columns ``mix`` reads none, and ``mixed_documents``
returns them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import number_of, text_of, word_count
from emberline.session import written

GOLDEN = 0.6180339887498949
BINS = 4096  # of points, for the join with the shares
BUCKETS = 4096  # of the shuffled order of a source
SLOTS = 131_072  # about as many slots in a mix
LEAST_BLOCK = 64


def running(df: DataFrame, group: str, bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before, per group in the order of bucket and ``order``."""
    up = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("_total"))
    totals = totals.select(group, bucket, F.coalesce(F.sum("_total").over(up), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(totals, [group, bucket]).withColumn(out, F.col(out) + F.col("_base")).drop("_base")


def shuffle_key(doc_id: Column, size: Column) -> Column:
    return number_of(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_no, source_size and target: ``share`` of all words by weight, at most ``most`` times a source.

    What a full source cannot take goes to the others by weight.  With the sources in the order of size per
    weight, the level at which the words are used up is the greatest of those at each source.  There is one
    row per source, and the window spans only these.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("source_no", F.lit(len(weights))) + 1)
    sources = sources.withColumn("weight", weight).withColumn("full", F.col("source_size") * most)
    order = Window.orderBy(F.col("full") / F.col("weight"), "source_no")
    before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - before) / rest
    sources = sources.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("level") * F.col("weight"), F.col("full").cast("double"))
    return sources.select("source", "source_no", "source_size", target.alias("target"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """The sources of ``slots`` slots: slot, source_no and rank of the slot in its source."""
    order = Window.orderBy("source_no")
    high = F.sum("target").over(order) / F.sum("target").over(Window.partitionBy())
    shares = sources.filter("target > 0").withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    last = F.least(F.floor(F.col("high") * BINS), F.lit(BINS - 1)).cast("long")
    shares = shares.select("source_no", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * BINS).cast("long"), last)).alias("bin"))
    point = (F.col("slot") + 0.5) * GOLDEN
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot")).withColumn("point", point - F.floor(point))
    points = points.withColumn("bin", F.floor(F.col("point") * BINS))
    found = points.join(shares, "bin").filter("point >= low and point < high").select("slot", "source_no")
    found = found.withColumn("stretch", F.floor(F.col("slot") / 1024))
    return running(found, "source_no", "stretch", ["slot"], F.lit(1), "rank").select("slot", "source_no", "rank")


def closing(sources: DataFrame, slots: DataFrame, block: int, n_slots: int) -> DataFrame:
    """``slots`` and, after the ``n_slots`` of them, a slot for each block of a target that none of them takes."""
    counted = slots.groupBy("source_no").agg(F.count("slot").alias("n"))
    n_sources = sources.count()
    left = sources.join(counted, "source_no", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    left = left.withColumn("blocks", F.ceil(F.floor("target") / block)).filter("blocks > n")
    left = left.select("source_no", "n", F.explode(F.sequence("n", F.col("blocks") - 1)).alias("rank"))
    slot = n_slots + (F.col("rank") - F.col("n")) * n_sources + F.col("source_no")
    return slots.unionByName(left.select(slot.alias("slot"), "source_no", "rank"))


def words_of_slots(sources: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """Adds n_slots, the slots of each source, and ends, the words that they take; one row per source."""
    counted = slots.groupBy("source_no").agg(F.count("slot").alias("n_slots"))
    sources = sources.join(counted, "source_no", "left").withColumn("n_slots", F.coalesce("n_slots", F.lit(0)))
    return sources.withColumn("ends", F.least(F.floor("target"), (F.col("n_slots") + 1) * block))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, the first slot that takes from it (null where none does;
    the order in which to write the mix), its place in the shuffled order of its source (``source_no``, ``key``), and
    how many epochs take its start (``epochs``)."""
    sizes = written(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size")), "sizes")
    sources = written(targets(sizes, weights, share, most), "sources")
    total = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    block = max(LEAST_BLOCK, int(total // SLOTS))
    n_slots = -int(-total // block)
    slots = written(schedule(sources, n_slots), "slots")
    slots = written(closing(sources, slots, block, n_slots), "all-slots")
    sources = written(words_of_slots(sources, slots, block), "source-words")
    sizes = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop("source")
    sizes = sizes.withColumn("key", shuffle_key(F.col("doc_id"), F.col("size"))).withColumn("bucket", F.pmod(F.shiftright("key", 40), F.lit(BUCKETS)))
    placed = running(sizes, "source_no", "bucket", ["key", "doc_id", "size"], F.col("size"), "at")
    inside = Window.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "size")
    placed = placed.withColumn("nth", F.row_number().over(inside))

    # the parts of a document in each block of each epoch, as far as the target goes
    epochs = placed.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("at") + e * F.col("source_size"))))
    stop = F.least(F.col("start") + F.col("size"), F.col("ends"))
    epochs = epochs.withColumn("taken", F.col("start") < F.col("ends")).withColumn("stop", stop)
    blocks = F.when(F.col("start") < F.col("stop"), F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)))
    parts = epochs.withColumn("nth_block", F.explode_outer(blocks))
    words = F.least("stop", (F.col("nth_block") + 1) * block) - F.greatest("start", F.col("nth_block") * block)
    parts = parts.withColumn("words", F.when(F.col("nth_block").isNull(), 0).otherwise(words).cast("long"))
    parts = parts.withColumnRenamed("nth_block", "rank").join(slots, ["source_no", "rank"], "left")
    row = ["doc_id", "size", "source_no", "source_size", "target", "key", "bucket", "nth", "at"]
    slot = F.when(F.col("words") > 0, F.col("slot"))
    return parts.groupBy(*row).agg(
        F.sum("words").alias("taken"), F.min(slot).alias("first_slot"), F.count_distinct(F.when(F.col("taken"), F.col("start"))).alias("epochs")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``, whole documents, each as often as an epoch takes its first word.

    Per source and epoch the taken documents are those up to one place in the shuffled order, so that a
    row of two places per source is joined with the documents, which do not move.
    """
    place = F.struct("key", "doc_id", "size")
    chosen, most = mix(docs, **options), options.get("most", 2)
    cut = [F.max(F.when(F.col("epochs") > e, place)).alias(f"cut{e}") for e in range(most)]
    cuts = chosen.groupBy("source_no").agg(F.array(*cut).alias("cuts"))
    names = docs.select(F.col("source").cast("string").alias("source_name")).distinct()
    number = F.row_number().over(Window.orderBy(F.col("source_name").isNull(), "source_name")) - 1
    cuts = written(names.withColumn("source_no", number).join(cuts, "source_no").drop("source_no"), "cuts")
    # all columns as one, so that theirs are the only names beside those below
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    n = word_count(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    here = F.struct(shuffle_key(F.col("row.doc_id"), n).alias("key"), F.col("row.doc_id").alias("doc_id"), n.alias("size"))
    rows = whole.withColumn("here", here)
    rows = rows.join(F.broadcast(cuts) if cuts.count() <= 100_000 else cuts, F.col("row.source").cast("string").eqNullSafe(F.col("source_name")))
    reached = F.filter("cuts", lambda c: F.coalesce(F.col("here") <= c, F.lit(False)))
    return rows.withColumn("time", F.explode(reached)).select("row.*")


OP9_SQL = """
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
keyed as (
  select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || size::varchar), 1, 13))::bigint as key from sizes),
totals as (select source, sum(size)::bigint as source_size from sizes group by source),
numbered as (select *, row_number() over (order by source is null, encode(source)) - 1 as source_no from totals),
weighed as (select *, case source_no % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 2 as fill from numbered),
levels as (
  select *, ((sum(source_size) over ())::double * 1.5
      - coalesce(sum(fill) over (order by fill::double / weight, source_no rows between unbounded preceding and 1 preceding), 0)::double)
      / (sum(weight) over (order by fill::double / weight, source_no rows between current row and unbounded following))::double as level
  from weighed),
aims as (select source, source_size, least((max(level) over ()) * weight, fill::double) as target from levels),
placed as (
  select k.doc_id, k.size, a.source_size, a.target, floor(a.target)::bigint as ends,
    coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0)::bigint as pos
  from keyed k join aims a on k.source is not distinct from a.source)
select doc_id, size, source_size, target,
  (greatest(0, least(pos + size, ends) - pos) + greatest(0, least(pos + source_size + size, ends) - pos - source_size))::bigint as taken
from placed
"""
