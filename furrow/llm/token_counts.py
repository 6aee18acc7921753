"""Token counts by Viterbi over a unigram vocabulary, without making tokens.

A text is cut at spaces into words, each with its space mark before it. An Aho-Corasick automaton gives all
pieces of the vocabulary in a word by their ends; dynamic programming carries, for every place, the best score and
the number of pieces that reach it. Ties go, as in the tokenizers library's unigram model, to the piece that begins first; a
character that no piece covers alone costs the lowest score less UNKNOWN_PENALTY and counts as its UTF-8 bytes where the vocabulary has byte
pieces, and otherwise as one with the unknown characters beside it.

Defined results: null and empty texts have no tokens; rows with the same id are counted each for itself; an empty
table gives no rows; columns other than id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import whole_text

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words in each of two generations of a worker's memory, and the longest of them.
MAX_WORDS = 800_000
MAX_WORD = 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a SentencePiece model and their scores, by id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """count(text) for one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.bytes = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def word(self, text: str) -> int:
        """The number of pieces on the best path through one word."""
        n = len(text)
        best: list[float] = [0.0] + [float("-inf")] * n
        count = [0] * (n + 1)
        open_unknown = [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.automaton.iter(text):
            ends[last + 1].append((size, score))
        for at in range(1, n + 1):
            top, pieces, unknown, single = float("-inf"), 0, False, False
            for size, score in sorted(ends[at], reverse=True):  # the longest begins first
                reached = best[at - size] + score
                if reached > top:
                    top, pieces = reached, count[at - size] + 1
                single = single or size == 1
            if not single and (reached := best[at - 1] + self.unknown) > top:
                more = len(text[at - 1].encode()) if self.bytes else not open_unknown[at - 1]
                top, pieces, unknown = reached, count[at - 1] + more, True
            best[at], count[at], open_unknown[at] = top, pieces, unknown
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        words = (marked if marked[0] == SPACE else SPACE + marked).split(SPACE)[1:]
        counts = list(map(self.words.get, words))
        if None in counts:
            for i, known in enumerate(counts):
                if known is None:
                    counts[i] = self._learn(words[i])
        return sum(counts)

    def _learn(self, word: str) -> int:
        found = self.words.get(word, self.older.get(word))
        if found is None:
            found = self.word(SPACE + word)
        if len(word) <= MAX_WORD:
            if len(self.words) >= MAX_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found


@cache
def counter(path: str) -> Counter:
    """One counter for each file and Python worker."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for batch in batches:
            found = [(len(t), count(t)) for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(docs, text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
