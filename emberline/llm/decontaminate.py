"""Benchmark passages in documents, also where their numbers, units and names were changed.

Words become a template: a number, the unit after a number, and a capitalised word inside a sentence are
slots of their type, other words are themselves in lower case.  Any other capitalised word, as at the start
of a sentence or after a quote, may be a name or not.  A word of the item and one of the document match if
both can be slots of one type, or if they are equal.  Windows are hashed in each reading of their words, as
slot or as word, so that they meet whenever their words match: windows of
``ANCHOR`` words of the benchmark at every place meet those of the documents at every ``STRIDE``-th place,
so that each common run of at least ``RUN`` = ANCHOR + STRIDE - 1 words holds one such window.  From there
the run is followed to both sides in the words that the window carries along.  A document is contaminated
by an item if they share a run of at least ``RUN`` words at one offset that is evidence:

* ``RUN`` words that are equal, whatever they are and whatever stands beside them;
* a whole run in which at least half of the words are equal and the slots are consistent, so that the same
  value in the item always stands for the same value in the document; also if this holds only for what
  is left between possible names that differ;
* of any other run the longest consistent parts, at least half of them equal, with more than ``RUN`` equal words.

Documents are not shuffled: the hashes of the benchmark's windows go to the tasks when a count has shown
that they are few, and only windows that hit are joined and grouped after that.  Beyond that number Spark
joins by shuffle, with the same result.

An item of less than ``RUN`` words counts where the document holds all of it, equal or with consistent slots
of which at most half differ.  Its first words, at most ``ANCHOR``, meet windows of that length at every
place of the documents; these windows are made only for lengths that such items have.  ``matches`` and
``contaminated`` look for short items if asked to, as the query and ``decontaminated`` do.

Null and empty texts match nothing.  Rows with equal id and text give one result row; ids may be null.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.binding import let
from emberline.llm.common import text_of
from emberline.session import written

ANCHOR, STRIDE = 6, 8
RUN = ANCHOR + STRIDE - 1
BROADCAST_ROWS = 4_000_000  # longs
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"  # mark slots in front of their value
MAYBE = "\ue003"  # marks words that are a name or a plain word
MARKS_END = "\ue004"  # marked words sort from NAME up to here, as UTF-8 bytes
UNITS = (
    "mm|cm|m|km|inch|inches|foot|feet|yards|mile|miles|mg|g|kg|oz|lb|lbs|pound|pounds|ton|tons|ml|l|litre|litres|liter|liters|gallons|"
    "second|seconds|minute|minutes|hour|hours|day|days|week|weeks|month|months|year|years|dollar|dollars|cents|euro|euros|percent|%|"
    "degrees|volts|watts|kw|mph|meter|meters|metre|metres|grams|kilograms|kilometers|kilometres"
)


def read_words(text: Column) -> Column:
    """Words in lower case without punctuation, slots and possible names with their mark in front.

    Every replacement leaves white space alone or turns punctuation into it, so that words stay whole.
    Patterns look at the character that comes next first, which rules most places out at once.
    """
    has_number = text.rlike(r"\p{N}")
    text = F.regexp_replace(text, f"[{NAME}-{MAYBE}]", " ")
    text = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll},;] )", NAME)
    numbers = F.regexp_replace(text, r"(?=\p{N})(?<![\p{L}\p{N}.,])", NUMBER)
    numbers = F.regexp_replace(numbers, rf"(?i)({NUMBER}\S+ )(?=(?:{UNITS})(?![\p{{L}}\p{{N}}]))", "$1" + UNIT)
    text = F.when(has_number, numbers).otherwise(text)
    text = F.regexp_replace(text, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}%{NAME}-{UNIT}])", MAYBE)
    text = F.regexp_replace(F.lower(text), rf"(?=[^a-z\s])(?:[^\p{{L}}\p{{N}}{NAME}-{MAYBE}\s.,%]|[.,](?!\p{{N}})|(?<!\p{{N}})[.,])+", " ")
    return F.array_remove(F.split(text, r"\s+"), "")


def marked_words(text: Column) -> Column:
    """The words with the marks of slots alone; possible names are plain words."""
    return F.transform(read_words(text), lambda w: F.when(w.startswith(MAYBE), F.substr(w, F.lit(2))).otherwise(w))


def template(word: Column) -> Column:
    """The mark of a slot, that of a name also for a possible name, or the plain word."""
    first = F.when(word >= MAYBE, NAME).otherwise(F.substring(word, 1, 1))
    return F.when(_marked(word), first).otherwise(word)


def _marked(word: Column) -> Column:
    return (word >= NAME) & (word < MARKS_END)


def _bare(word: Column) -> Column:
    return F.when(_marked(word), F.substr(word, F.lit(2))).otherwise(word)


def with_keys(rows: DataFrame, words: str) -> DataFrame:
    """Adds the hashes of the words, ``word_keys``, and of their templates, ``slot_keys``; both are equal where a word is no slot."""
    rows = rows.withColumn("word_keys", F.transform(words, lambda w: F.xxhash64(_bare(w))))
    return rows.withColumn("slot_keys", F.zip_with(words, "word_keys", lambda w, key: F.when(_marked(w), F.xxhash64(template(w))).otherwise(key)))


def readings(first: Column, length: int, kind: int = 0) -> Column:
    """Hashes of the window of ``length`` words from place ``first``, with each of its slots read as slot and as word: at most two to the power of its length.

    A window's hash starts with its kind and takes in the hash of one word after another.
    """
    word, slot = F.col("word_keys"), F.col("slot_keys")

    def with_word(found: Column, i: Column) -> Column:
        plain = F.transform(found, lambda r: F.xxhash64(r, F.get(word, i)))
        slots = F.transform(found, lambda r: F.xxhash64(r, F.get(slot, i)))
        return F.when(F.get(word, i) == F.get(slot, i), plain).otherwise(F.concat(plain, slots))

    start = F.lit(kind).cast("long")
    one = start
    for i in range(length):
        one = F.xxhash64(one, F.get(word, first + i))
    every = F.aggregate(F.sequence(first, first + length - 1), F.array(start), with_word)
    no_slot = F.slice(word, first + 1, length) == F.slice(slot, first + 1, length)
    return F.when(no_slot, F.array(one)).otherwise(every)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """hash, item_id, item_at and the item's words, for every reading of every window of every item of at least ``RUN`` words."""
    items = benchmark.select("item_id", read_words(text_of()).alias("item")).filter(F.size("item") >= RUN)
    places = F.sequence(F.lit(0), F.size("item") - ANCHOR)
    at = F.posexplode(F.transform(places, lambda p: readings(p, ANCHOR)))
    items = with_keys(items, "item")
    return items.select("item_id", "item", at.alias("item_at", "hashes")).select("item_id", "item", "item_at", F.explode("hashes").alias("hash"))


def short_items(benchmark: DataFrame) -> DataFrame:
    """As ``item_windows``, for the first words of items of less than ``RUN`` words; with the window's length."""
    items = benchmark.select("item_id", read_words(text_of()).alias("item")).filter(F.size("item").between(1, RUN - 1))
    items = with_keys(items, "item").withColumn("length", F.least(F.size("item"), F.lit(ANCHOR)))
    hashes = F.coalesce(*(F.when(F.col("length") == n, readings(F.lit(0), n, 1)) for n in range(1, ANCHOR + 1)))
    return items.select("item_id", "item", F.lit(0).alias("item_at"), F.explode(hashes).alias("hash"), "length")


def document_windows(docs: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """hash, place and surrounding words of every reading of every ``STRIDE``-th window; ``skip`` words of these stand before the window.

    With ``lengths`` (of short items) also windows of these at every place.
    """
    words = docs.select(F.col("doc_id"), F.xxhash64(text_of()).alias("text_hash"), read_words(text_of()).alias("words"))
    # texts with too few words have no places below; a filter here would read the words of each text twice
    words = with_keys(words, "words")

    def window(p: Column, length: int, before: int, kind: int) -> Column:
        first = F.greatest(p - before, F.lit(0))
        around = F.slice("words", first + 1, p - first + ANCHOR + STRIDE - 1)
        return F.struct(p.alias("at"), readings(p, length, kind).alias("hashes"), (p - first).alias("skip"), around.alias("around"))

    def windows(length: int, step: int, before: int, kind: int, least: int) -> DataFrame:
        places = F.when(F.size("words") >= least, F.sequence(F.lit(0), F.size("words") - length, F.lit(step)))
        return words.select("doc_id", "text_hash", F.explode(F.transform(places, lambda p: window(p, length, before, kind))).alias("w"))

    found = windows(ANCHOR, STRIDE, STRIDE - 1, 0, RUN)
    for n in lengths or []:
        found = found.unionByName(windows(n, 1, 0, 1, n))
    return found.select("doc_id", "text_hash", "w.*").withColumn("hash", F.explode("hashes")).drop("hashes")


def matches(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """One row per document, item and offset with a common run that is evidence: its words, slots, and slots that differ."""
    items, lengths = item_windows(benchmark), []
    if short:
        items = items.withColumn("length", F.lit(None).cast("int")).unionByName(short_items(benchmark))
    items = written(items, "benchmark-windows")
    if short:
        lengths = sorted(r["length"] for r in items.select("length").distinct().collect() if r["length"])
        items = items.drop("length")
    hashes = items.select("hash").distinct()
    hashes = F.broadcast(hashes) if items.count() <= BROADCAST_ROWS else hashes
    hits = document_windows(docs, lengths).join(hashes, "hash", "left_semi").join(items, "hash").drop("hash")
    # words of the document beside those of the item, as far as both go
    first = F.greatest(F.col("skip") - F.col("item_at"), F.lit(0))
    last = F.least(F.size("around"), F.size("item") - F.col("item_at") + F.col("skip")) - 1

    def pair(i: Column) -> Column:
        ours, theirs = F.get("around", i), F.get("item", F.col("item_at") + i - F.col("skip"))
        equal = _bare(ours) == _bare(theirs)
        same = (template(ours) == template(theirs)) | equal
        # an equal word is a slot only where neither side can be a plain word
        surely = ours.substr(1, 1).between(NAME, UNIT) & theirs.substr(1, 1).between(NAME, UNIT)
        slot = same & (~equal | surely)
        at = (F.col("item_at") + i - F.col("skip")).alias("at")
        return F.struct(at, same.alias("same"), equal.alias("equal"), slot.alias("slot"), surely.alias("surely"), _bare(theirs).alias("item"), _bare(ours).alias("doc"))

    pairs = hits.withColumn("first", first).withColumn("pairs", once(F.transform(F.sequence(first, last), pair)))
    left, right = F.reverse(F.slice("pairs", F.lit(1), F.col("skip") - F.col("first"))), F.slice("pairs", F.col("skip") - F.col("first") + 1, 1 << 20)

    def reach(side: Column) -> Column:
        stop = F.array_position(F.transform(side, lambda x: x["same"]), F.lit(False))
        return F.when(stop == 0, F.size(side)).otherwise(stop - 1).cast("int")

    runs = pairs.withColumn("need", F.least(F.lit(RUN), F.size("item"))).withColumn("before", reach(left)).withColumn("after", reach(right)).filter(F.col("before") + F.col("after") >= F.col("need"))
    run = F.slice("pairs", F.col("skip") - F.col("first") - F.col("before") + 1, F.col("before") + F.col("after"))
    runs = runs.select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("offset"), "need", run.alias("run"))
    # an item's words bound each group
    whole = runs.groupBy("doc_id", "text_hash", "item_id", "offset", "need").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("run")))).alias("run"))
    whole = whole.withColumn("evidence", once(evidence(F.col("run"), F.col("need")))).filter(F.size("evidence") > 0)
    kept = F.filter("run", lambda x, i: F.exists("evidence", lambda e: (e["first"] <= i) & (i <= e["last"])))
    whole = whole.withColumn("run", once(kept))
    n_slots, changed = F.size(F.filter("run", lambda x: x["slot"])), F.size(F.filter("run", lambda x: ~x["equal"]))
    return whole.select("doc_id", "text_hash", "item_id", "offset", F.size("run").alias("matched_words"), n_slots.alias("n_slots"), changed.alias("n_changed"))


def once(value: Column) -> Column:
    """The value, as a generator of one row: what uses it, filters too, reads it and does not compute it again."""
    return F.explode_outer(F.array(value))


def stretches(run: Column, ok: Callable[[Column], Column]) -> Column:
    """The first and last places of all longest stretches of neighbouring words that are ``ok``."""

    def borders(step: int) -> Column:
        def goes_on(x: Column, i: Column) -> Column:
            beside = F.get(run, i + step)
            return F.coalesce((beside["at"] == x["at"] + step) & ok(beside), F.lit(False))

        places = F.transform(run, lambda x, i: F.when(ok(x) & ~goes_on(x, i), i))
        return F.filter(places, lambda i: i.isNotNull())

    return F.zip_with(borders(-1), borders(1), lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def consistent_parts(run: Column, span: Column) -> Column:
    """The longest parts of a span in which each value of the item has one value of the document."""
    places = F.transform(run, lambda x, i: F.struct(i.alias("i"), x["slot"].alias("slot"), x["item"].alias("item"), x["doc"].alias("doc")))
    slots = F.filter(places, lambda x: x["slot"] & (span["first"] <= x["i"]) & (x["i"] <= span["last"]))

    def parts(slots: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            clash = F.array_max(F.transform(F.filter(slots, lambda y: (y["i"] < x["i"]) & (y["item"] == x["item"]) & (y["doc"] != x["doc"])), lambda y: y["i"]))
            ended = F.struct(state["first"].alias("first"), (x["i"] - 1).alias("last"))
            cut = F.struct((clash + 1).alias("first"), F.concat(state["parts"], F.array(ended)).alias("parts"))
            return F.when(clash >= state["first"], cut).otherwise(state)

        none = F.array().cast("array<struct<first:int,last:int>>")
        start = F.struct(span["first"].alias("first"), none.alias("parts"))
        return F.aggregate(slots, start, step, lambda state: F.concat(state["parts"], F.array(F.struct(state["first"].alias("first"), span["last"].alias("last")))))

    return let(slots, parts)


def evidence(run: Column, need: Column) -> Column:
    """The spans of a run that show a copy, by their first and last places in it.  ``need`` is ``RUN``, or the length of a shorter item."""

    def long(spans: Column) -> Column:
        return F.filter(spans, lambda e: e["last"] - e["first"] + 1 >= need)

    def words(e: Column) -> Column:
        return F.slice(run, e["first"] + 1, e["last"] - e["first"] + 1)

    def n_equal(e: Column) -> Column:
        return F.size(F.filter(words(e), lambda x: x["equal"]))

    def half(e: Column) -> Column:
        return 2 * n_equal(e) >= e["last"] - e["first"] + 1

    equal = long(stretches(run, lambda x: x["equal"]))
    spans = long(stretches(run, lambda x: F.lit(True)))
    surer = long(stretches(run, lambda x: x["equal"] | x["surely"]))
    parts = F.flatten(F.transform(spans, lambda e: consistent_parts(run, e)))
    whole = F.filter(F.concat(spans, surer), lambda e: half(e) & (F.size(consistent_parts(run, e)) == 1))
    return F.concat(equal, whole, F.filter(parts, lambda e: half(e) & (n_equal(e) > need)))


def contaminated(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """One row per contaminated document: its items' number, and its longest match."""
    best = F.max_by(F.struct("item_id", "matched_words", "n_slots", "n_changed"), F.struct("matched_words", -F.col("n_changed"), -F.col("item_id"), -F.col("offset")))
    found = matches(docs, benchmark, short).groupBy("doc_id", "text_hash").agg(F.count_distinct("item_id").alias("n_items"), best.alias("best"))
    return found.select("doc_id", "text_hash", "n_items", "best.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates.  The list of the others is written first, so that Spark
    knows its size, and sends it to the tasks only while it is small."""
    bad = written(contaminated(docs, benchmark, short=True).select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")), "contaminated")
    own = docs["doc_id"].eqNullSafe(bad["_doc_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == bad["_text_hash"])
    return docs.join(bad, own, "left_anti")
