"""Documents whose sets of word shingles have a Jaccard similarity of 0.75 or more, by signature trees.

A document's set is that of its distinct runs of five words.  Equal sets are one class.  Candidates meet in
buckets: linked sets share one of the first n - ceil(0.75 n) + 1 shingles under any one order of all
shingles, so that a bucket per such shingle misses no link.  The order puts shingles last that many
documents have; it is fitted on counts, and only speed depends on it.  Buckets with the same members are one.

In a bucket a tree is built over its classes in the order of size.  A node holds the OR of its members'
bitmaps and their range of sizes, and two trees are traversed together: a pair of nodes whose sizes or
largest possible overlap cannot reach the threshold is dropped with all its pairs.  What remains at the
leaves is plausible.  Large groups of near copies are all plausible pairs, so that only a spanning forest
of its plausible pairs is taken from each bucket, and verified on the exact sets.  The forests connect all
that is plausible; where all edges of such a group hold, nothing else can change components.  In the other
groups trees are traversed once more, over the exact sets of the group's classes and only across
components found so far; what links is joined at once, so that pairs are tried until two components meet.
Components are then those of all links, though not all links are listed.

Buckets of more bytes than a task should hold are cut in blocks, and pairs of blocks are traversed.
Documents without words, and null texts, have empty sets and are alone.  Rows with equal texts are linked,
also if their ids are equal or null; a component's id is its least id that is not null.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import text_of
from emberline.session import written

WORDS = 5
HEAVY_LOCAL, HEAVY_LIMIT = 8, 1_000_000  # documents of one flush that make a shingle heavy; shingles in the order's list
FLUSH = 3_000_000
LONG_RUN = 65_536  # members of a bucket that a task holds
BLOCK_BYTES = 16_000_000
FAN, LEAF = 8, 16
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space cuts
    if not words:
        return np.empty(0, "u8")
    # most distinct words of a corpus are rare: to hash a word anew costs less than to remember it
    codes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")
    if len(codes) < WORDS:
        return mixed((codes * ODD[: len(codes)]).sum(keepdims=True) + np.uint64(len(codes)))
    n = len(codes) - WORDS + 1
    total = np.zeros(n, "u8")
    for k in range(WORDS):
        total += codes[k : k + n] * ODD[k]
    found = np.sort(mixed(total))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def linked(overlap, a, b):
    """Jaccard of 0.75 or more, from the overlap and both sizes."""
    return 7 * overlap >= 3 * (a + b)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits of the shingles' low ends, two or more times as many as there are shingles, as 64-bit numbers."""
    size = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    flags = np.zeros(size, "u1")
    flags[shingles & np.uint64(size - 1)] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def halved(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[-1] // 2
    return bits[..., :half] | bits[..., half:]


def heavy_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents have, sorted, and their counts: at most ``HEAVY_LIMIT``, which bounds what goes to the tasks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, held = [], 0

        def often() -> pd.DataFrame:
            every = np.sort(np.concatenate(waiting))
            ends = every[HEAVY_LOCAL - 1 :]
            key = np.unique(ends[ends == every[: len(ends)]])
            n = np.searchsorted(every, key, "right") - np.searchsorted(every, key)
            return pd.DataFrame({"key": key.view("i8"), "n": n.astype("i8")})

        for batch in batches:
            for text in batch["text"]:
                waiting.append(shingles(text))
                held += len(waiting[-1])
                if held > FLUSH:
                    yield often()
                    waiting, held = [], 0
        if waiting:
            yield often()

    found = docs.select(text_of().alias("text")).mapInPandas(count, "key long, n long")
    top = found.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(HEAVY_LIMIT).toPandas()
    order = np.argsort(top["key"].to_numpy("i8").view("u8"))
    return top["key"].to_numpy("i8").view("u8")[order], top["n"].to_numpy("i8")[order]


MARKS = "doc_id long, text_hash long, n long, class long, check long, keys array<long>, bits binary"


def marks(docs: DataFrame) -> DataFrame:
    """Written once: per document its class, and for a class's first document in a task its prefix and bitmap."""
    heavy, often = heavy_shingles(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(text)
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8")
                keys = bits = None
                if len(found) and digest[0] not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(digest[0])
                    weight = np.zeros(len(found), "i8")
                    if len(heavy):
                        at = np.minimum(np.searchsorted(heavy, found), len(heavy) - 1)
                        weight = np.where(heavy[at] == found, often[at], 0)
                    keys = found[np.argsort(weight, kind="stable")[: prefix_length(len(found))]].view("i8")
                    bits = bitmap(found).tobytes()
                rows.append((len(found), digest[0], digest[1], keys, bits))
            yield pd.concat([batch[["doc_id", "text_hash"]], pd.DataFrame(rows, columns=["n", "class", "check", "keys", "bits"])], axis=1)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return written(rows.mapInPandas(run, MARKS), "marks")


def members(found: DataFrame) -> DataFrame:
    """bucket and class of all buckets with two classes or more; buckets of the same classes are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes, last, seen = np.empty(0, "i8"), np.empty(0, "i8"), None, set()

        def emit(keys: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(keys):
                return
            first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])])
            keys, classes = keys[first], classes[first]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            with np.errstate(over="ignore"):
                marks = mixed(np.add.reduceat(mixed(classes.view("u8")), starts) + sizes.astype("u8")).view("i8")
            live = sizes > 1
            for i in np.flatnonzero(live):
                if marks[i] in seen:
                    live[i] = False
                elif len(seen) < 1_000_000:
                    seen.add(marks[i])
            keep = np.repeat(live, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(marks, sizes)[keep]), pa.array(classes[keep])], ["bucket", "class"])

        def plain(keys: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(classes)], ["bucket", "class"])

        for batch in batches:
            more, of = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if last is not None:  # a run too long to hold is a bucket by its key
                stop = int(np.searchsorted(more, last, "right"))
                yield plain(more[:stop], of[:stop])
                more, of = more[stop:], of[stop:]
                if not len(more):
                    continue
                last = None
            keys, classes = np.concatenate([keys, more]), np.concatenate([classes, of])
            if len(keys):
                cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
                yield from emit(keys[:cut], classes[:cut])
                keys, classes = keys[cut:], classes[cut:]
                if len(keys) > LONG_RUN:
                    yield plain(keys, classes)
                    last, keys, classes = keys[0], keys[:0], classes[:0]
        yield from emit(keys, classes)

    entries = found.filter("keys is not null").select(F.explode("keys").alias("key"), "class")
    runs = entries.repartition("key").sortWithinPartitions("key", "class")
    return written(runs.mapInArrow(run, "bucket long, class long").distinct(), "buckets")


class Tree:
    """Nodes over members in the order of size: OR of bitmaps, range of sizes, and the largest number of shingles beyond set bits."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.surplus = sizes - np.bitwise_count(bits).sum(axis=1, dtype="i8")
        starts = np.arange(0, len(sizes), LEAF)
        ends = np.minimum(starts + LEAF, len(sizes))
        self.levels = []
        low, high, surplus = sizes[starts], sizes[ends - 1], np.maximum.reduceat(self.surplus, starts)
        union = np.bitwise_or.reduceat(bits, starts, axis=0)
        while True:
            self.levels.append((union, low, high, surplus))
            if len(low) == 1:
                break
            starts = np.arange(0, len(low), FAN)
            ends = np.minimum(starts + FAN, len(low))
            union, low, high, surplus = np.bitwise_or.reduceat(union, starts, axis=0), low[starts], high[ends - 1], np.maximum.reduceat(surplus, starts)


def possible(a, b, same: bool) -> np.ndarray:
    """Which pairs of two rows of nodes can hold a link.  Members are nodes of their own."""
    union_a, low_a, high_a, surplus_a = a
    union_b, low_b, high_b, surplus_b = b
    near = (4 * high_a[:, None] >= 3 * low_b[None, :]) & (4 * high_b[None, :] >= 3 * low_a[:, None])
    if same:
        near &= np.tri(len(low_a), dtype=bool).T
    i, j = np.nonzero(near)
    overlap = np.zeros(len(i), "i8")
    step = max(1, 4_000_000 // union_a.shape[1])
    for s in range(0, len(i), step):
        overlap[s : s + step] = np.bitwise_count(union_a[i[s : s + step]] & union_b[j[s : s + step]]).sum(axis=1, dtype="i8")
    overlap += np.minimum(surplus_a[i], surplus_b[j])
    keep = linked(overlap, low_a[i], low_b[j])
    return np.column_stack([i[keep], j[keep]])


def plausible(a: Tree, b: Tree) -> Iterator[np.ndarray]:
    """Pairs of members, in blocks, that a traversal of both trees does not rule out."""
    same = a is b
    while len(a.levels) != len(b.levels):  # the lower tree gets roots of its own
        low = a if len(a.levels) < len(b.levels) else b
        low.levels.append(low.levels[-1])

    def part(tree: Tree, level: int, node: int):
        """Children of a node as nodes, and the number of the first."""
        if level == 0:
            at = slice(node * LEAF, (node + 1) * LEAF)
            return (tree.bits[at], tree.sizes[at], tree.sizes[at], tree.surplus[at]), node * LEAF
        width = FAN if len(tree.levels[level - 1][1]) > 1 else 1
        at = slice(node * width, (node + 1) * width)
        return tuple(x[at] for x in tree.levels[level - 1]), node * width

    todo = [(len(a.levels) - 1, 0, 0)]
    while todo:
        level, i, j = todo.pop()
        (left, first), (right, second) = part(a, level, i), part(b, level, j)
        found = possible(left, right, same and i == j) + [first, second]
        if level == 0:
            if same:
                found = found[found[:, 0] != found[:, 1]]
            if len(found):
                yield found
        else:
            todo += [(level - 1, x, y) for x, y in found[::-1].tolist()]


def octaves(classes: np.ndarray, sizes: np.ndarray, bits: list[bytes]):
    """Members by length of their bitmaps: length to (members, tree, tree of half the length)."""
    order = np.lexsort((classes, sizes))
    lengths = np.array([len(bits[i]) for i in order])
    out = {}
    for length in np.unique(lengths):
        rows = order[lengths == length]
        matrix = np.frombuffer(b"".join(bits[i] for i in rows), "<u8").reshape(len(rows), -1)
        out[int(length)] = rows, Tree(sizes[rows], matrix), Tree(sizes[rows], halved(matrix)) if length > 8 else None
    return out


def bucket_pairs(classes: np.ndarray, sizes: np.ndarray, bits: list[bytes], labels: np.ndarray | None, sides: np.ndarray | None, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the plausible pairs or, with sets, of the links; members of equal labels count as connected.
    ``sides`` restricts pairs to those of a member of block 0 and one of block 1."""
    trees, pairs = octaves(classes, sizes, bits), []
    parent = list(range(len(classes)))
    if labels is not None:
        parent = np.unique(labels, return_index=True, return_inverse=True)
        parent = parent[1][parent[2]].tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for length, (rows, tree, _) in trees.items():
        joins = [(rows, tree, rows, tree)]
        if 2 * length in trees:
            joins.append((rows, tree, trees[2 * length][0], trees[2 * length][2]))
        for left, a, right, b in joins:
            for found in plausible(a, b):
                for x, y in zip(left[found[:, 0]].tolist(), right[found[:, 1]].tolist()):
                    if sides is not None and sides[x] == sides[y]:
                        continue
                    p, q = root(x), root(y)
                    if p == q or sets is not None and not linked(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), sizes[x], sizes[y]):
                        continue
                    parent[q] = p
                    pairs.append((min(classes[x], classes[y]), max(classes[x], classes[y])))
    return pairs


def tree_pairs(rows: DataFrame, shape: DataFrame, exact: bool) -> DataFrame:
    """Written: bucket, a and b of the pairs that the trees leave (see ``bucket_pairs``).

    ``rows`` has bucket, class, n and, for links on exact sets, label; ``shape`` has a class's bits or shingles,
    which join last: what large buckets are is known from their sizes.
    """
    carried = ["shingles", "label"] if exact else ["bits"]
    # a bitmap has at most as many bytes as its set has shingles
    sizes = rows.groupBy("bucket").agg(F.sum(F.greatest("n", F.lit(64)) * (8 if exact else 1)).alias("bytes"))
    large = written(sizes.select("bucket", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks")).filter("blocks > 1"), "large-buckets")
    rows = rows.join(large, "bucket", "left").join(shape, "class").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    rows = rows.withColumn("side", own).withColumn("pair", F.explode(pair)).select("bucket", "pair.i", "pair.j", "side", "class", "n", *carried)
    names = ("side", "class", "n", *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        now = None

        def finish() -> pa.RecordBatch:
            first = np.unique(np.array(held["class"]), return_index=True)[1]
            column = {name: [values[i] for i in first] for name, values in held.items()}
            sides = None if now[1] == now[2] else np.array(column["side"])
            sets = [x.view("u8") for x in column["shingles"]] if exact else None
            bits = [bitmap(x).tobytes() for x in sets] if exact else column["bits"]
            pairs = bucket_pairs(np.array(column["class"]), np.array(column["n"]), bits, np.array(column["label"]) if exact else None, sides, sets)
            a, b = ([p[k] for p in pairs] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(pairs), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["bucket", "a", "b"])

        for batch in batches:
            columns = {name: batch.column(batch.schema.get_field_index(name)) for name in ("bucket", "i", "j", *names)}
            columns = {name: [x.values.to_numpy() for x in c] if name == "shingles" else c.to_numpy(zero_copy_only=False).tolist() for name, c in columns.items()}
            groups = list(zip(columns["bucket"], columns["i"], columns["j"]))
            start = 0
            for stop in [*(k for k in range(1, len(groups)) if groups[k] != groups[k - 1]), len(groups)]:
                if start == stop:
                    continue
                if now != groups[start]:
                    if now is not None and len(held["class"]) > 1:
                        yield finish()
                    now, held = groups[start], {name: [] for name in names}
                for name in names:
                    held[name] += columns[name][start:stop]
                start = stop
        if now is not None and len(held["class"]) > 1:
            yield finish()

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return written(dealt.mapInArrow(run, "bucket long, a long, b long"), "tree-pairs")


def bloom(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``text_hash``, of at most 16 MB, that goes to the tasks."""
    n = hashes.count()
    size = 1 << min(27, max(10, (16 * n).bit_length()))
    at = F.pmod("text_hash", F.lit(size))
    bit = F.expr(f"shiftleft(1L, cast(pmod(text_hash, {size}) % 64 as int))")
    words = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    wanted = np.zeros(size // 64, "u8")
    wanted[words["word"].to_numpy("i8")] = words["bits"].to_numpy("i8").view("u8")
    return wanted


def in_bloom(wanted: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False for hashes that the filter was not made of, but for a few."""
    at = hashes.view("u8") & np.uint64(64 * len(wanted) - 1)
    return (wanted[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Written: class and its shingles, for the given classes, each with the hash of one of its texts.

    Only texts whose hashes pass a Bloom filter of these, which few others do, are cut in shingles.
    """
    wanted = bloom(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            rows = []
            for text in batch["text"][in_bloom(wanted, batch["text_hash"].to_numpy("i8"))]:
                found = shingles(text)
                name = int(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8")[0])
                if len(found) and name not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(name)
                    rows.append((name, found.view("i8")))
            yield pd.DataFrame(rows, columns=["class", "shingles"])

    texts = docs.select(F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    found = texts.mapInPandas(run, "class long, shingles array<long>").join(classes, "class", "left_semi")
    return written(found.dropDuplicates(["class"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Written: the pairs a, b with ``links``, whether their exact sets are similar enough."""
    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("class").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(one, "a").join(two, "b")
    links = linked(F.size(F.array_intersect("of_a", "of_b")), F.size("of_a"), F.size("of_b"))
    return written(both.select("a", "b", links.alias("links")), "verified")


def components(links: DataFrame) -> DataFrame:
    """class and label, the least class of its component, by rounds of stars.

    In a round every node gets the least of its neighbours as a neighbour; large neighbours go to it first,
    then the small ones.  Each round is written, so that no plan grows.
    """
    edges, state = written(links.select("a", "b").distinct(), "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a and b != m").select("b", "m").distinct()
        down = large.select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), "m").unionByName(small.select("a", "m")).filter("a != m").distinct()
        edges = written(small.select("a", F.col("m").alias("b")), "edges")
        before, state = state, edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)"))).first()
        if before == state:
            break
    # stars: every node but the least has one edge, to the least
    return edges.select(F.col("a").alias("class"), F.col("b").alias("label"))


def linked_classes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """class and label of all classes that are linked with another one."""
    sizes = found.filter("n > 0").groupBy("class").agg(F.first("n").alias("n"))
    shape = found.filter("bits is not null").select("class", "bits").dropDuplicates(["class"])
    pairs = tree_pairs(written(members(found).join(sizes, "class"), "members"), shape, exact=False).select("a", "b").distinct()
    candidates = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    texts = found.filter("n > 0").join(candidates, "class", "left_semi").groupBy("class").agg(F.min("text_hash").alias("text_hash"))
    sets = sets_of(docs, written(texts, "candidates"))
    links = verified(pairs, sets)
    labels = components(links.filter("links"))
    refuted = links.filter("not links").select(F.col("a").alias("class"))
    if refuted.isEmpty():
        return labels
    # the groups that the forests connect, where one of their edges failed; each class is in one of them
    groups = components(links).withColumnRenamed("label", "bucket")
    groups = groups.unionByName(groups.select(F.col("bucket").alias("class"), "bucket").distinct())
    groups = groups.join(groups.join(refuted, "class", "left_semi").select("bucket").distinct(), "bucket", "left_semi")
    rows = groups.join(sizes, "class").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    more = tree_pairs(written(rows, "members"), sets, exact=True).select("a", "b")
    return components(links.filter("links").select("a", "b").unionByName(more))


def per_row(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The marks' rows with the least row of their component, by id (null last) and text; null for empty sets."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = found.filter("n > 0").groupBy("class").agg(F.min(row).alias("least"))
    classes = classes.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = classes.groupBy("label").agg(F.min("least").alias("least"))
    of_class = written(classes.drop("least").join(least, "label").select("class", "least"), "components")
    rows = found.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"))
    return rows.join(of_class, "class", "left").drop("class")


def similar(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id."""
    found = marks(docs)
    rows = per_row(found, linked_classes(docs, found))
    component = F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a kept one: of each component one row stays, its least.

    The rows that go are written as ids and hashes of texts.  Rows that are repeated as a whole are told
    apart by nothing, so that only these, where there are any, are brought together to keep one.
    """
    found = marks(docs)
    rows = written(per_row(found, linked_classes(docs, found)).filter("n > 0"), "linked-rows")
    key = {"_doc_id": F.col("doc_id"), "_text_hash": F.col("text_hash")}
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    goes = written(rows.filter(~stays).select(*(c.alias(n) for n, c in key.items())).distinct(), "linked-away")
    repeats = rows.filter(stays).groupBy("doc_id", "text_hash").count().filter("count > 1")
    repeats = written(repeats.select(*(c.alias(n) for n, c in key.items())), "repeats")

    hashes = goes.unionByName(repeats).select(F.col("_text_hash").alias("text_hash"))
    wanted = bloom(hashes)

    @F.pandas_udf("boolean")
    def perhaps(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(wanted, hashes.to_numpy("i8")))

    def text_hash(df: DataFrame):
        return F.xxhash64(F.coalesce(df["text"].cast("string"), F.lit("")))

    def same(df: DataFrame, other: DataFrame):
        return df["doc_id"].cast("long").eqNullSafe(other["_doc_id"]) & (text_hash(df) == other["_text_hash"])

    # most rows pass by their text's hash alone and are not moved; the others are looked up
    stay, others = docs.filter(~perhaps(text_hash(docs))), docs.filter(perhaps(text_hash(docs)))
    kept = others.join(goes, same(others, goes), "left_anti")
    if not repeats.isEmpty():
        whole = kept.join(repeats, same(kept, repeats), "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeats, same(kept, repeats), "left_anti").unionByName(whole)
    return stay.unionByName(kept)
