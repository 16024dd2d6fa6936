"""Token counts under a unigram vocabulary without making the tokens.

Aho-Corasick enumerates the vocabulary pieces that end at each place of a word,
longest first; dynamic programming carries the best score, its number of pieces
and whether its last piece is unknown. This is the tokenizer's own recurrence,
so its tie rule holds: of equal scores, the piece that begins first. Signs that
no piece covers are unknown pieces at the least score less 10, and neighbours
among them count as one piece.

Words are runs of [^\\x20\\x09-\\x0D]+ with a word mark before them, and pieces do
not cross words, so each distinct word is counted once per worker; a text is a
sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuskit.llm.arrays import owners, span_hashes, sums, text_slices, words, worker_value

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_WORDS = 1_000_000  # distinct words kept per worker; then it starts afresh


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, by id, without control,
    unknown and byte pieces. Files whose scores are ranks (merges) give
    -log(rank + 2), Zipf's law for pieces that are ordered by frequency."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in usual]
    if all(s == int(s) for s in scores):
        scores = [-float(np.log(rank + 2)) for rank in range(len(usual))]
    return [(model.id_to_piece(i), float(s)) for i, s in zip(usual, scores)]


class Counter:
    """Counts the pieces of words; keeps the counts of the words seen."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in pieces)
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.counts = np.zeros((0, 2), np.int32)
        self.best = np.zeros(0)

    def count(self, word: str) -> tuple[int, int, float]:
        """(pieces, unknown pieces, score) of the best segmentation of a word. Only the
        states that the longest piece can reach back to are held."""
        size = self.longest + 1
        best, pieces, unknown, dark = [0.0] * size, [0] * size, [0] * size, [False] * size
        matches = self.automaton.iter(word)
        match = next(matches, None)
        at = 0
        for end in range(len(word)):
            top, start, known, single = None, 0, True, False
            while match is not None and match[0] == end:  # longest first
                length, score = match[1]
                value = score + best[(end + 1 - length) % size]
                if top is None or value > top:
                    top, start = value, (end + 1 - length) % size
                single = single or length == 1
                match = next(matches, None)
            if not single:
                value = self.unknown + best[at]
                if top is None or value > top:
                    top, start, known = value, at, False
            new = known or not dark[start]
            counts = pieces[start] + new, unknown[start] + (not known and new)
            at = (end + 1) % size
            best[at], dark[at] = top, not known
            pieces[at], unknown[at] = counts
        return pieces[at], unknown[at], best[at]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """([pieces, unknown pieces], scores) of UTF-8 texts cut at the offsets."""
        rows = len(offsets) - 1
        starts, ends = words(data, offsets)
        hashes = span_hashes(data, starts, ends)
        unique, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        found = np.zeros(len(unique), bool)
        inner = place < len(self.known)
        found[inner] = self.known[place[inner]] == unique[inner]
        new = np.flatnonzero(~found)
        if len(self.known) + len(new) > MAX_WORDS and len(self.known):
            self._forget()
            return self.texts(data, offsets)
        if len(new):
            body = data.tobytes()
            spelled = (MARK + body[a:b].decode("utf-8", "replace") for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist()))
            fresh = [self.count(w) for w in spelled]
            known = np.concatenate([self.known, unique[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.counts = np.concatenate([self.counts, np.array([f[:2] for f in fresh], np.int32)])[order]
            self.best = np.concatenate([self.best, [f[2] for f in fresh]])[order]
            place = np.searchsorted(self.known, unique)
        per_text = np.bincount(owners(starts, offsets), minlength=rows)
        use = place[which]
        score = np.concatenate([[0.0], np.cumsum(self.best[use])])
        ends_at = np.cumsum(per_text)
        return sums(self.counts[use].astype(np.int64), per_text), score[ends_at] - score[ends_at - per_text]


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_unknown, log_likelihood): a row per input row.

    A null, empty or blank text has no tokens. Repeated rows each get a row; other
    columns are dropped; an empty table gives none. The vocabulary, of bounded
    size, travels with the tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    name = f"pieces {hash(tuple(pieces))}"
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_value(name, lambda: Counter(shared.value))
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                counts, score = counter.texts(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(counts[:, 0]), pa.array(counts[:, 1]), pa.array(score)],
                    names=[id_col, "n_tokens", "n_unknown", "log_likelihood"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_unknown long, log_likelihood double")
