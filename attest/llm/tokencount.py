"""Word-piece counts by a linear longest-match automaton, without building pieces.

The vocabulary is a trie of word-start pieces and one of continuation pieces. Every node has the result of what greedy
matching does when no edge fits: how many pieces it pops (a count worked out beforehand) and the failure link to the
node where the unread part of the word stands. So a word is read once, letter by letter; its count is the sum of the
pops. Words are the runs of ``[^\\x20\\x09-\\x0D]+``, lower-cased in A-Z; a word that greedy matching cannot finish
counts as one unknown piece. Each task keeps the counts of words that it has seen, up to a bound.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a task keeps, and the longest that it keeps.
KEPT_WORDS, KEPT_LENGTH = 300_000, 40
WORD_START = "▁"


class Automaton:
    """``count(word)`` is the number of greedy longest-match pieces, 0 if there is no complete match."""

    def __init__(self, starts: Iterable[str], continuations: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: start of a word; node 1: after a piece
        piece = [False, False]
        rest = [0, 0]  # letters of the node's string since its root
        for root, pieces in ((0, starts), (1, continuations)):
            for text in pieces:
                node = root
                for letter in text:
                    if letter not in self.next[node]:
                        self.next[node][letter] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                        rest.append(rest[node] + 1)
                    node = self.next[node][letter]
                if text:
                    piece[node] = True
        self.link = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        self._fail(piece)

    def _fail(self, piece: list[bool]) -> None:
        """Links by breadth-first order: a node that is a piece pops it whole; any other pops what its parent does,
        and then follows that node's links until its own letter fits."""
        waiting = deque((root, letter, child) for root in (0, 1) for letter, child in self.next[root].items())
        while waiting:
            parent, letter, node = waiting.popleft()
            if piece[node]:
                self.link[node], self.pops[node] = 1, 1
            else:
                at, pops = self.link[parent], self.pops[parent]
                while at >= 0 and letter not in self.next[at]:
                    pops += self.pops[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.pops[node] = self.next[at][letter], pops
            waiting.extend((node, x, child) for x, child in self.next[node].items())

    def count(self, word: str) -> int:
        node, total, edges, link, pops = 0, 0, self.next, self.link, self.pops
        for letter in word:
            while letter not in edges[node]:
                total += pops[node]
                node = link[node]
                if node < 0:
                    return 0
            node = edges[node][letter]
        while node > 1:  # what is left of the word
            total += pops[node]
            node = link[node]
        return total if node >= 0 else 0


class _Counts(dict):
    """Word (UTF-8) -> pieces, worked out at first sight; forgets all when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode("utf-8", "replace"))
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


def vocabulary(model_file: str) -> tuple[list[str], list[str]]:
    """Word-start and continuation pieces of a SentencePiece model, lower-cased in A-Z; special pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    starts, rest = set(), set()
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            text = model.id_to_piece(i).encode().lower().decode()
            body = text.removeprefix(WORD_START)
            if WORD_START not in body and body:
                (starts if text != body else rest).add(body)
    return sorted(starts), sorted(rest)


def token_counts(docs: DataFrame, starts: list[str], continuations: list[str], id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` for every row; unknown words count as one token each.

    Null, empty and blank texts have no words and no tokens. Repeated rows are counted alike; a null id stays null.
    An empty table gives no rows; other columns are not read.
    """
    vocabularies = docs.sparkSession.sparkContext.broadcast((starts, continuations))  # the vocabulary file's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Counts(Automaton(*vocabularies.value))
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1).to_pylist():
                counts = list(map(kept.__getitem__, (text or b"").lower().split()))
                lost = counts.count(0)
                words.append(len(counts))
                tokens.append(sum(counts) + lost)
                unknown.append(lost)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))],
                ["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
