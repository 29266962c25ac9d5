"""Greedy word-piece lengths by an automaton that never builds a piece.

The vocabulary is a trie in two parts, one for pieces that begin a word and one for pieces that go on.
Every node has a failure link, and the number of pieces that are complete once it is taken: reading a
word needs one step per character and one addition per link, however long the word is.  The greedy
result is that of trying the longest piece first at each place.

A word that the pieces cannot cover counts as one unknown piece.  Words are runs without ASCII white
space; null and empty texts have none.  Rows are independent, so that no row moves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import text_of

MEMO = 1_000_000  # words whose length a task remembers
MARK = "▁"  # begins a word in sentencepiece vocabularies


def pieces_of(model: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that go on, from a sentencepiece model; special and byte pieces are left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    starts = sorted({p[1:] for p in plain if p.startswith(MARK) and p[1:] and MARK not in p[1:]})
    return starts, sorted({p for p in plain if MARK not in p})


class Automaton:
    """Trie nodes are numbers; node 0 begins a word, node 1 goes on after a piece."""

    def __init__(self, starts: Iterable[str], goes_on: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        depth, parent, letter, whole = [0, 0], [0, 0], ["", ""], [False, False]
        for root, words in ((0, starts), (1, goes_on)):
            for word in words:
                node = root
                for c in word:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        depth.append(depth[node] + 1)
                        parent.append(node)
                        letter.append(c)
                        whole.append(False)
                    node = self.next[node][c]
                whole[node] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        for node in sorted(range(2, len(self.next)), key=depth.__getitem__):  # links lead to nodes of less depth
            if whole[node]:
                self.fail[node], self.popped[node] = 1, 1
                continue
            link, popped = self.fail[parent[node]], self.popped[parent[node]]
            while link >= 0 and letter[node] not in self.next[link]:
                popped += self.popped[link]
                link = self.fail[link]
            if link >= 0:
                self.fail[node], self.popped[node] = self.next[link][letter[node]], popped

    def length(self, word: str) -> int:
        """Number of pieces; 0 where no cover exists."""
        node, popped = 0, 0
        for c in word:
            while c not in self.next[node]:
                popped += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return 0
            node = self.next[node][c]
        while node != 1:
            popped += self.popped[node]
            node = self.fail[node]
            if node < 0:
                return 0
        return popped


def token_counts(docs: DataFrame, starts: list[str], goes_on: list[str]) -> DataFrame:
    """doc_id, n_words, n_unknown and n_pieces (unknown words count 1) of every whole text.

    The vocabulary goes to the tasks; its size is that of the given lists and not of the corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, memo = Automaton(starts, goes_on), {}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = text.encode().split()
                if len(memo) > MEMO:
                    memo.clear()
                for word in words:
                    if word not in memo:
                        memo[word] = automaton.length(word.decode())
                lengths = list(map(memo.__getitem__, words))
                unknown = lengths.count(0)
                rows.append((len(words), unknown, sum(lengths) + unknown))
            yield pd.concat([batch[["doc_id"]], pd.DataFrame(rows, columns=["n_words", "n_unknown", "n_pieces"])], axis=1)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInPandas(count, "doc_id long, n_words long, n_unknown long, n_pieces long")
