"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A data file has a header of 8 bytes, a signature of 4 and the number of bytes of an id, and then a row of
frames, one per document, in ascending ``doc_id``:

    length of the data, 8 bytes | masked CRC of those, 4 | data: the ids | masked CRC of the data, 4

All numbers are little-endian.  Ids have 2 bytes where the vocabulary and the end id allow it, otherwise 4.  The mask keeps a checksum of data that itself holds checksums from
being weak.  The index beside it has one entry of fixed size per frame: document id, whether it is
null, offset of the frame and number of ids; a reader in shuffled order needs no scan of the data.

Spark sorts the documents by range, every task writes the files of its own range to the shared folder
under a name of that attempt, and the manifest, a table that is written once, names the files that
count.  What a lost or repeated attempt left behind is in no manifest.

Texts that are null or empty are documents that hold the end id only.  Rows with equal ids stay apart,
ordered by their text; null ids come first.  Other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import filesystem, text_of
from emberline.session import fresh_path, written

FRAME = struct.Struct("<QI")  # length of the data and its masked checksum
CHECK = struct.Struct("<I")
MASK = 0xA282EAD8  # added after rotating by 15 bits
ENTRY = np.dtype([("doc_id", "<i8"), ("is_null", "?"), ("offset", "<u8"), ("n_tokens", "<u4")])
MANIFEST = "file string, part long, n_docs long, n_tokens long"
MEMO = 1_000_000  # pieces whose ids a worker remembers
KEPT_IDS = 8_000_000  # and how many ids these have
JOINED = 1_000_000  # about as many characters are encoded at once
SLICE = 16_000_000  # bytes of text that a worker works on at once, or one text
CUT = re.compile(r"(?= \S)")
HEADER = struct.Struct("<4sI")
SIGNATURE = b"IDS1"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def header(kind: np.dtype) -> bytes:
    return HEADER.pack(SIGNATURE, kind.itemsize)


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return length + CHECK.pack(masked(length)) + data + CHECK.pack(masked(data))


def read_frame(stream) -> bytes:
    """The data of the next frame; an error where a checksum does not hold."""
    head = stream.read(FRAME.size)
    length, check = FRAME.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("the length of a record is damaged")
    data = stream.read(length)
    if masked(data) != CHECK.unpack(stream.read(CHECK.size))[0]:
        raise ValueError("the data of a record are damaged")
    return data


def pieces(text: str) -> list[str]:
    """Cut before each space that a word follows.

    A byte-level tokenizer that keeps the leading space in a word never joins across such a place, so
    that the ids of a text are those of its pieces, one after another.
    """
    return CUT.split(text)


class Encoder:
    """Ids of whole texts; pieces that come again are not encoded again.

    The ids of all known pieces lie in one array, and a batch of texts is gathered from it.  Both the pieces
    and their ids are bounded: beyond ``MEMO`` or ``KEPT_IDS`` the encoder starts anew with the next batch.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_ids = max(vocabulary.values(), default=0) + 1
        # a character of a byte-level piece is a byte of the text
        self.n_bytes = np.zeros(self.n_ids, "i8")
        self.n_bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        for number, added in self.tokenizer.get_added_tokens_decoder().items():
            self.n_bytes[number] = len(added.content.encode())
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.ends, self.n_known = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, "i8"), 0

    def numbers(self, some: list[str]) -> np.ndarray:
        """The numbers of pieces, which are encoded if they are new."""
        new = list(dict.fromkeys(piece for piece in some if piece not in self.memo))
        start = 0
        while start < len(new):
            stop, n = start, 0
            while stop < len(new) and (n < JOINED or stop == start):
                n += len(new[stop])
                stop += 1
            self.add(new[start:stop])
            start = stop
        return np.fromiter(map(self.memo.__getitem__, some), "i8", len(some))

    def add(self, new: list[str]) -> None:
        """Encode new pieces: those that start with a space and a word as one text, whose ids are cut by their bytes."""
        joined = [piece for piece in new if CUT.match(piece)]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, "<u4")
        at, ends = np.cumsum(self.n_bytes[ids]), np.cumsum([len(piece.encode()) for piece in joined], dtype="i8")
        places = np.minimum(np.searchsorted(at, ends), max(len(at) - 1, 0))
        if joined and len(at) and at[-1] == ends[-1] and (at[places] == ends).all():
            self.keep(joined, ids, places + 1)
            new = [] if len(joined) == len(new) else [piece for piece in new if not CUT.match(piece)]
        if new:
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.keep(new, np.concatenate(found), np.cumsum(list(map(len, found))))

    def keep(self, new: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n, used = self.n_known, int(self.ends[self.n_known])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(new) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(new)] = used + ends
        self.memo.update(zip(new, range(n, n + len(new))))
        self.n_known += len(new)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, which are not null, one after another, and where those of each text end."""
        if len(self.memo) > MEMO or self.ends[self.n_known] > KEPT_IDS:
            self.clear()
        cut = pc.split_pattern(texts, " ")
        first = np.asarray(cut.offsets)[:-1] - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        # texts with a space that no word follows are cut by the rule itself
        loose = np.fromiter((not word or word[0].isspace() for word in words), bool, len(words))[codes]
        loose[first] = False
        odd = np.logical_or.reduceat(loose, first)
        sizes = np.diff(np.append(first, len(codes)))
        plain, is_first = np.repeat(~odd, sizes), np.zeros(len(codes), bool)
        is_first[first] = True
        numbers = np.empty(len(codes), "i8")
        for space, rows in (("", plain & is_first), (" ", plain & ~is_first)):
            used = np.flatnonzero(np.bincount(codes[rows], minlength=len(words)))
            table = np.zeros(len(words), "i8")
            table[used] = self.numbers([space + words[i] for i in used])
            numbers[rows] = table[codes[rows]]
        by_rule = [pieces(texts[int(i)].as_py()) for i in np.flatnonzero(odd)]
        counts = sizes.copy()
        counts[odd] = list(map(len, by_rule))
        every = np.empty(int(counts.sum()), "i8")
        here = np.repeat(odd, counts)
        every[here], every[~here] = self.numbers([piece for text in by_rule for piece in text]), numbers[plain]
        starts, lengths = self.ends[every], self.ends[every + 1] - self.ends[every]
        stops = np.cumsum(lengths)
        ids = self.ids[np.repeat(starts - stops + lengths, lengths) + np.arange(int(lengths.sum()))]
        return ids, stops[np.cumsum(counts) - 1]


_encoders: dict[str, Encoder] = {}  # a worker process keeps them from task to task


def encoder_of(path: str) -> Encoder:
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``SLICE`` bytes of text, or of one row."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), dtype="i8")
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, store, n_tokens = encoder_of(tokenizer), None, 0
        kind = np.dtype("<u2" if max(encoder.n_ids, end_id + 1) <= 1 << 16 else "<u4")
        end, index = np.array([end_id], kind).tobytes(), []
        for batch in (some for batch in batches for some in slices(batch)):
            if store is None:
                store, base = filesystem(folder)
                store.create_dir(base, recursive=True)
                file = f"{base.rstrip('/')}/part-{part:07d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(file + ".rec")
                at = out.write(header(kind))
            entries = np.zeros(len(batch), ENTRY)
            entries["doc_id"], entries["is_null"] = batch["doc_id"].fill_null(0), batch["doc_id"].is_null()
            ids, stops = encoder.encode(batch["text"])
            data, stops = ids.astype(kind).tobytes(), stops * kind.itemsize
            records = [frame(data[a:b] + end) for a, b in zip([0, *stops], stops)]
            out.write(b"".join(records))
            lengths = np.array(list(map(len, records)), "i8")
            entries["offset"] = at + np.cumsum(lengths) - lengths
            entries["n_tokens"] = np.diff(stops, prepend=0) // kind.itemsize + 1
            at += int(lengths.sum())
            n_tokens += int(entries["n_tokens"].sum())
            index.append(entries)
        if store is not None:
            out.close()
            with store.open_output_stream(file + ".idx") as out:
                for entries in index:
                    out.write(entries.tobytes())
            row = {"file": f"{folder}/{os.path.basename(file)}", "part": part, "n_docs": sum(map(len, index)), "n_tokens": n_tokens}
            yield pa.RecordBatch.from_pylist([row])

    return write


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode every whole text and write it; returns the manifest, one row per pair of files in order."""
    folder = folder or fresh_path(docs.sparkSession, "records")
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    # rows of one id are split between tasks by how their texts begin; inputs of many splits need more ranges than the setting
    ranges = ["doc_id", F.substring("text", 1, 64)]
    splits = rows.rdd.getNumPartitions() // 2
    many = splits > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(splits, *ranges) if many else rows.repartitionByRange(*ranges)
    return written(rows.sortWithinPartitions("doc_id", "text").mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST), "manifest")


def _open_index(file: str):
    store, path = filesystem(file + ".idx")
    return store.open_input_stream(path)


def _open_records(file: str):
    """A data file behind its header, and the type of its ids."""
    store, path = filesystem(file + ".rec")
    stream = store.open_input_file(path)
    signature, width = HEADER.unpack(stream.read(HEADER.size))
    if signature != SIGNATURE or width not in (2, 4):
        raise ValueError("the header of a file is damaged")
    return stream, np.dtype(f"<u{width}")


def one_file_a_task(files: DataFrame) -> DataFrame:
    """Rows of a manifest are small, but their files are not: a stated number of ranges is not merged by size."""
    return files.repartitionByRange(max(1, files.count()), "part", "file")


def read_index(manifest: DataFrame) -> DataFrame:
    """All index entries: file, position in it, doc_id, offset, n_tokens."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file in (file for batch in batches for file in batch["file"]):
            with _open_index(file) as stream:
                entries = np.frombuffer(stream.read(), ENTRY)
            for start in range(0, len(entries), 10_000):
                some = entries[start : start + 10_000]
                ids = pd.Series(some["doc_id"], dtype="Int64").mask(some["is_null"])
                place = np.arange(start, start + len(some))
                yield pd.DataFrame({"file": file, "place": place, "doc_id": ids, "offset": some["offset"].astype("i8"), "n_tokens": some["n_tokens"].astype("i8")})

    return one_file_a_task(manifest).select("file").mapInPandas(read, "file string, place long, doc_id long, offset long, n_tokens long")


def read_at(entries: DataFrame, *keep: str) -> DataFrame:
    """The records of the given index entries in the order of the rows, as arrays of ids; ``keep`` names columns to carry."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: dict = {}
        for batch in batches:
            ids = []
            for file, offset in zip(batch["file"], batch["offset"]):
                if file not in files:
                    if len(files) >= 16:
                        files.pop(next(iter(files)))[0].close()
                    files[file] = _open_records(file)
                stream, kind = files[file]
                stream.seek(offset)
                ids.append(np.frombuffer(read_frame(stream), kind).astype("i4"))
            yield batch[["doc_id", *keep]].assign(ids=ids)

    kept = "".join(f", {name} {kind}" for name, kind in entries.dtypes if name in keep)
    return entries.select("file", "offset", "doc_id", *keep).mapInPandas(read, f"doc_id long{kept}, ids array<int>")


def shuffled(manifest: DataFrame, seed: int, shards: int) -> DataFrame:
    """All records in a random order that the seed fixes: ``shard``, ``rank`` (order in it), doc_id and ids.

    Only index entries are shuffled; each task then reads its records at their offsets.
    """
    entries = read_index(manifest).withColumn("rank", F.xxhash64(F.lit(seed), "file", "place")).withColumn("shard", F.pmod("rank", F.lit(shards)))
    return read_at(entries.repartition(shards, "shard").sortWithinPartitions("shard", "rank"), "shard", "rank")


def read_digests(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    Files are ordered by a running sum over the manifest, which has one row per file.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, start in ((f, b) for batch in batches for f, b in zip(batch["file"], batch["before"])):
            with _open_index(file) as stream:
                entries = np.frombuffer(stream.read(), ENTRY)
            stream, kind = _open_records(file)
            with stream:
                for first in range(0, len(entries), 10_000):
                    some = entries[first : first + 10_000]
                    n, crc = np.zeros(len(some), "i8"), np.zeros(len(some), "i8")
                    for i in range(len(some)):
                        ids = np.frombuffer(read_frame(stream), kind)
                        n[i], crc[i] = len(ids), zlib.crc32(ids.astype("<u4"))
                    starts = start + np.concatenate([[0], np.cumsum(n)[:-1]])
                    start += int(n.sum())
                    ids = pd.Series(some["doc_id"], dtype="Int64").mask(some["is_null"])
                    yield pd.DataFrame({"doc_id": ids, "start": starts, "n_tokens": n, "ids_crc32": crc})

    return one_file_a_task(files).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
