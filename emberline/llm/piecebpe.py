"""Sentencepiece BPE, encoded by merge rounds over flat arrays, and decoded by a gather of bytes.

The symbols of many words lie in one array.  A round finds the least pair rank of each word (a segmented
minimum), merges its places from left to right without overlap, and compacts the arrays; words without a
pair leave.  A round gives what merging one place after the other gives: where a merged symbol would make a
pair of the same or a lower rank with a neighbour, the word's merges of that round end with it.

A word ends where no piece of the vocabulary spans two characters.  Pairs are found in a sorted array of
all ways to cut a piece in two.  Characters without a piece become their bytes.

Null and empty texts have no ids.  Repeated rows are encoded each on their own, null ids stay, other columns
are not read, an empty table gives an empty one.  No row moves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import text_of

MARK = "▁"  # stands for a space
NONE = np.int64(2**40)  # rank of a pair that is no piece
MEMO, MEMO_CHARS = 300_000, 64  # words whose ids a worker remembers, and their greatest length
FLAT = 1_000_000  # symbols in one array, unless a single word has more


class Codec:
    """Vocabulary and merge table of a model, made from the bytes of its file.

    Models with a normaliser, user-defined or unused pieces, or without pieces for bytes are refused.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = range(m.get_piece_size())
        probe = "  a\tB ﬁ①  "
        if m.normalize(probe) != MARK + probe.replace(" ", MARK) or any(map(m.is_unused, kinds)):
            raise ValueError("only models without a normaliser and unused pieces are supported")
        self.byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], "i4")
        if not all(map(m.is_byte, self.byte_ids.tolist())):
            raise ValueError("the model has no pieces for bytes")
        plain = [i for i in kinds if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        pieces = {m.id_to_piece(i): i for i in plain}
        letters = sorted({c for p in pieces for c in p} - set(pieces))  # parts of pieces that are none themselves
        self.n_pieces = m.get_piece_size()
        symbols = pieces | {c: self.n_pieces + i for i, c in enumerate(letters)}
        self.first_free = self.n_pieces + len(letters)  # symbols from here on are code points without a piece
        self.letters = [ord(c) for c in letters]
        self.symbol_of = np.arange(0x110000, dtype="i8") + self.first_free
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        scores = np.array([m.get_score(i) for i in plain])
        ranks = dict(zip(plain, np.unique(-scores, return_inverse=True)[1].tolist()))
        cuts = sorted((symbols[p[:k]] << 32 | symbols[p[k:]], ranks[i], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.keys, self.ranks, self.merged = (np.array(x, "i8") for x in zip(*cuts))
        self.joint = np.array(sorted({ord(a) << 32 | ord(b) for p in pieces for a, b in zip(p, p[1:])}), "i8")
        self.bytes_of = [b""] * self.n_pieces
        for p, i in pieces.items():
            self.bytes_of[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes_of[i] = bytes([b])
        self.bytes_of[m.unk_id()] = " ⁇ ".encode()
        self.blank_start = {i for p, i in pieces.items() if p[0] == MARK}
        self.decimals = [str(i) for i in kinds]
        self.word = self._words(pieces)
        self.run = self._blank_run(pieces, ranks)
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def _words(pieces: dict[str, int]) -> re.Pattern | None:
        """A place between another character and a space, or beside a line feed, is never crossed in most vocabularies."""
        crossed = any(MARK in p.lstrip(MARK) or "\n" in p and len(p) > 1 for p in pieces)
        return None if crossed else re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    def _blank_run(self, pieces: dict[str, int], ranks: dict[int, int]) -> int:
        """Length of the longest piece of spaces, if runs of spaces are filled with it one after the other; otherwise 0.

        So it is where pieces of spaces rank last and alike: the leftmost pair then goes on to grow until
        it is the longest piece, whatever follows.  Runs of up to four such pieces are tried.
        """
        runs = {len(p): ranks[i] for p, i in pieces.items() if len(p) > 1 and not p.strip(MARK)}
        mixed = any(MARK * 2 in p and p.strip(MARK) for p in pieces)
        if not runs or mixed or set(runs.values()) != {max(ranks.values())}:
            return 0
        most = max(runs)
        tried = self._encode_flat([MARK * n for n in range(most, 4 * most + 1)])
        piece = tried[0]
        return most if len(piece) == 4 and all(tried[n + most] == piece + tried[n] for n in range(most, 2 * most + 1)) else 0

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), np.where(found, self.merged[at], -1)

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair remains; the symbols left, and the place each of them began at."""
        place = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, merged = np.full(len(symbols), NONE), np.full(len(symbols), -1)

        def fill(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(symbols) - 1)]
            inside = word[at] == word[at + 1]
            r, m = self._pairs(symbols[at], symbols[at + 1])
            rank[at], merged[at] = np.where(inside, r, NONE), np.where(inside, m, -1)

        fill(np.arange(len(symbols)))
        while len(symbols):
            new_word = np.r_[True, word[1:] != word[:-1]]
            starts = np.flatnonzero(new_word)
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            bound = np.repeat(least, lengths)
            if (ready := bound == NONE).any():
                done.append((symbols[ready], place[ready]))
                stay = ~ready
                symbols, word, place, rank, merged, bound = (x[stay] for x in (symbols, word, place, rank, merged, bound))
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == bound)
            count = np.arange(len(at))
            opens = np.r_[True, np.diff(at) != 1]
            at = at[(count - np.maximum.accumulate(np.where(opens, count, 0))) % 2 == 0]  # every other place of a row of neighbours
            piece, limit = merged[at], bound[at]
            # the neighbours as they are when the places before have been merged and those after have not
            follows = np.r_[False, np.diff(at) == 2]
            before = np.where(follows, np.r_[0, piece[:-1]], symbols[np.maximum(at - 1, 0)])
            has_before = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
            beyond = np.minimum(at + 2, len(symbols) - 1)
            has_after = (at + 2 < len(symbols)) & (word[beyond] == word[at])
            early = has_before & (self._pairs(before, piece)[0] <= limit) | has_after & (self._pairs(piece, symbols[beyond])[0] <= limit)
            ended = np.cumsum(early) - early
            first = np.r_[True, word[at][1:] != word[at][:-1]]
            keep = ended == np.maximum.accumulate(np.where(first, ended, 0))
            at = at[keep]
            symbols[at] = piece[keep]
            alive = np.ones(len(symbols), bool)
            alive[at + 1] = False
            at -= np.arange(len(at))  # one symbol is gone for each place before
            symbols, word, place, rank, merged = (x[alive] for x in (symbols, word, place, rank, merged))
            rank[at] = NONE
            fill(np.union1d(at, at - 1))
        if not done:
            return symbols, place
        symbols, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return symbols[order], place[order]

    def _encode_flat(self, words: list[str]) -> list[bytes]:
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype("i8")
        lengths = np.fromiter(map(len, words), "i8", len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        key = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.joint, key), len(self.joint) - 1)
        cut = (self.joint[at] != key) | (owner[1:] != owner[:-1])
        symbols, place = self._rounds(self.symbol_of[points], np.cumsum(np.r_[False, cut]))
        sizes, owners = np.ones(len(symbols), "i8"), owner[place]
        if (rare := np.flatnonzero(symbols >= self.n_pieces)).size:
            known = {s: chr(self.letters[s - self.n_pieces] if s < self.first_free else s - self.first_free).encode() for s in np.unique(symbols[rare]).tolist()}
            spelt = [known[s] for s in symbols[rare].tolist()]
            sizes[rare] = [len(s) for s in spelt]
            ids = np.repeat(symbols, sizes)
            ids[np.repeat(symbols >= self.n_pieces, sizes)] = self.byte_ids[np.frombuffer(b"".join(spelt), "u1")]
        else:
            ids = symbols
        ends = np.cumsum(np.bincount(owners, sizes, len(words)).astype("i8")) * 4
        data = ids.astype("<i4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        some: list[str] = []
        size = 0
        for word in words:
            if some and size + len(word) > FLAT:
                yield from self._encode_flat(some)
                some, size = [], 0
            some.append(word)
            size += len(word)
        if some:
            yield from self._encode_flat(some)

    def _cut(self, text: str) -> list[str]:
        """Words of a text; runs of spaces are cut after whole longest pieces."""
        text = MARK + text.replace(" ", MARK)
        words = self.word.findall(text) if self.word else [text]
        if self.run and MARK * (3 * self.run) in text:
            out = []
            for word in words:
                blanks = len(word) - len(word.lstrip(MARK))
                whole = max(0, blanks - 2 * self.run) // self.run
                out += [MARK * self.run] * whole + [word[whole * self.run :]]
            return out
        return words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; words of ordinary length that come again are not merged again."""
        cut = [self._cut(text) if text else [] for text in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list({word for words in cut for word in words if word not in self.memo})
        own = dict(zip(new, self._encode_words(new)))
        self.memo.update((word, ids) for word, ids in own.items() if len(word) <= MEMO_CHARS)
        long = {word: ids for word, ids in own.items() if len(word) > MEMO_CHARS}
        lookup = self.memo.__getitem__ if not long else lambda word: long.get(word) or self.memo[word]
        return [np.frombuffer(b"".join(map(lookup, words)), "<i4") for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes in a row, without the space that encoding puts before a text."""
        some = ids.tolist()
        data = b"".join(map(self.bytes_of.__getitem__, some))
        first = next((i for i in some if self.bytes_of[i]), None)
        if first in self.blank_start:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._mended(data)

    @staticmethod
    def _mended(data: bytes) -> str:
        """Each byte that begins no whole character becomes a mark of its own."""
        out, at = [], 0
        while at < len(data):
            size = 1 + (data[at] >= 0xC2) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
            try:
                out.append(data[at : at + size].decode())
                at += size
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


_codecs: dict[bytes, Codec] = {}  # a worker process keeps them from task to task


def codec_of(model: bytes) -> Codec:
    key = hashlib.sha256(model).digest()
    return _codecs.get(key) or _codecs.setdefault(key, Codec(model))


def read_model(path: str) -> bytes:
    """The bytes of a model file, which go to the tasks with the job (half a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and the ids of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id"]].assign(ids=codec_of(model).encode(batch["text"].tolist()))

    return _texts(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and the text of each row of ids (null ids: null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id"]].assign(text=[None if ids is None else codec_of(model).decode(np.asarray(ids)) for ids in batch["ids"]])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them, in one pass over the texts."""

    def sha(data: str) -> str:
        return hashlib.sha256(data.encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codec = codec_of(model)
            rows = codec.encode(batch["text"].tolist())
            yield batch[["doc_id"]].assign(
                n_tokens=[len(ids) for ids in rows],
                ids_sha256=[sha(",".join(map(codec.decimals.__getitem__, ids.tolist()))) for ids in rows],
                decoded_sha256=[sha(codec.decode(ids)) for ids in rows],
            )

    return _texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
