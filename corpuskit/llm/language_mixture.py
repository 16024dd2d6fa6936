"""Language identification of mixed texts.

Character n-grams of labelled texts give each language a model. A text's words
are taken as drawn from a mixture of languages: expectation-maximisation finds
the proportions from the words' n-gram likelihoods, and languages leave the set
while the penalised likelihood (BIC) gains by it. The prediction is the language
with the largest share.

Counts cover all labelled texts: every task adds up its own table of hashed
n-grams, and the tables are summed by n-gram. Their number is bounded by 2^BITS
for each language, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpuskit.llm.arrays import BYTE_VALUES, mix, owners, spans, sums, text_slices

BITS = 16
ORDER = 3
ROUNDS = 10
PRIOR = 0.5  # added to every n-gram's count
UNDETERMINED = "und"

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of hashed n-grams, [2^BITS, languages]."""

    languages: tuple[str, ...]
    logs: np.ndarray


def lowered(column) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def word_grams(data: np.ndarray, offsets: np.ndarray):
    """(hashed n-gram of each position, starts and ends of the words). Words are
    runs of ASCII letters and non-ASCII bytes of lower-cased UTF-8; the n-gram at
    a byte ends there and reaches back over the word's border as if it were one
    blank."""
    starts, ends = spans(LETTERS[data], offsets)
    inside = LETTERS[data]
    symbol = np.where(inside, BYTE_VALUES[data], np.uint64(1))
    begun = np.zeros(len(data), bool)
    begun[starts] = True
    grams = symbol.copy()
    blank, live = np.uint64(1), np.ones(len(data), bool)
    reach = symbol
    first = begun.copy()
    for step in range(1, ORDER):
        reach = np.roll(reach, 1)
        # Once the word's first byte is passed, only blanks follow.
        live &= ~first
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + np.where(live, reach, blank)
        first = np.roll(begun, step)
        first[:step] = True
    return (mix(grams) & np.uint64((1 << BITS) - 1)).astype(np.int64), starts, ends


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel | None:
    """A model of all rows that have a language and a text; None without any.
    Every language counts, however rare; their tables are the only thing sent to
    the driver (2^BITS numbers each)."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            which, spelled = names.indices.to_numpy(), names.dictionary.to_pylist()
            for first, last, data, offsets in text_slices(lowered(batch.column(1))):
                grams, starts, ends = word_grams(data, offsets)
                at = np.flatnonzero(LETTERS[data])
                lang = which[first:last][owners(at, offsets)]
                for i in np.unique(lang):
                    counts = np.bincount(grams[at[lang == i]], minlength=1 << BITS)
                    name = spelled[i]
                    tables[name] = tables[name] + counts if name in tables else counts
        for name, counts in tables.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used), pa.array(counts[used])], names=["lang", "gram", "n"])

    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted.column("lang").to_pylist()))
    if not languages:
        return None
    number = {name: i for i, name in enumerate(languages)}
    table = np.full((1 << BITS, len(languages)), PRIOR)
    lang = np.array([number[x] for x in counted.column("lang").to_pylist()])
    np.add.at(table, (counted.column("gram").to_numpy(), lang), counted.column("n").to_numpy())
    return LanguageModel(tuple(languages), np.log(table / table.sum(axis=0)).astype(np.float32))


def proportions(logs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages [documents, languages] and which are in the chosen
    set, from the log likelihoods of the words [words, languages] of consecutive
    documents."""
    docs, width = len(counts), logs.shape[1]
    top = logs.max(axis=1, keepdims=True)
    likely = np.exp(logs - top)
    owner = np.repeat(np.arange(docs), counts)

    sets = np.ones((docs, width), bool)
    share, fitted = _fit_some(likely, owner, counts, sets, np.arange(docs))
    open_ = (counts > 0) & (width > 1)
    while open_.any():
        # Try each open document without its smallest language.
        some = np.flatnonzero(open_)
        weakest = np.where(sets[some], share[some], np.inf).argmin(axis=1)
        fewer = sets.copy()
        fewer[some, weakest] = False
        less, worse = _fit_some(likely, owner, counts, fewer, some)
        gain = 0.5 * np.log(np.maximum(counts[some], 2)) - (fitted[some] - worse)
        better = gain > 0
        moved = some[better]
        sets[moved] = fewer[moved]
        share[moved], fitted[moved] = less[better], worse[better]
        open_[:] = False
        open_[moved] = sets[moved].sum(axis=1) > 1
    return share, sets


def _fit_some(likely, owner, counts, sets, some):
    """The mixture of documents `some` restricted to their sets."""
    keep = np.zeros(len(counts), bool)
    keep[some] = True
    words = keep[owner]
    own, sizes = likely[words], counts[some]
    place = np.repeat(np.arange(len(some)), sizes)
    share = sets[some] / np.maximum(sets[some].sum(axis=1, keepdims=True), 1)
    for _ in range(ROUNDS):
        joint = own * share[place]
        each = joint.sum(axis=1, keepdims=True)
        share = sums(joint / np.maximum(each, 1e-300), sizes) / np.maximum(sizes, 1)[:, None]
    return share, sums(np.log(np.maximum((own * share[place]).sum(axis=1), 1e-300)), sizes)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages, shares): the language with the largest
    share (the first by name in a tie), that share, and the chosen set with its
    shares, by name.

    A null text, a text without letters, or no model give `und` with score 0 and
    empty lists. Every row has one result, repeated ones too; other columns are
    dropped; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*shared.value) if shared.value else None
        names = np.array(model.languages if model else (), object)
        for batch in batches:
            for first, last, data, offsets in text_slices(lowered(batch.column(1))):
                n = last - first
                if model:
                    grams, starts, ends = word_grams(data, offsets)
                    lettered = _has_letters(data, starts, ends)
                    starts, ends = starts[lettered], ends[lettered]
                    at = np.flatnonzero(LETTERS[data])
                    # Words hold only such bytes, so their bytes are consecutive in `at`.
                    from_ = np.searchsorted(at, starts)
                    total = np.concatenate([np.zeros((1, len(names))), np.cumsum(model.logs[grams[at]], axis=0, dtype=np.float64)])
                    logs = total[from_ + ends - starts] - total[from_]
                    counts = np.bincount(owners(starts, offsets), minlength=n)
                    share, sets = proportions(logs, counts)
                else:
                    counts, share, sets = np.zeros(n, np.int64), np.zeros((n, 0)), np.zeros((n, 0), bool)
                some = counts > 0
                best = share.argmax(axis=1) if len(names) else np.zeros(n, np.int64)
                pred = np.where(some, names[best] if len(names) else UNDETERMINED, UNDETERMINED)
                score = np.where(some, np.clip(share[np.arange(n), best], 0, 1), 0.0) if len(names) else np.zeros(n)
                used = sets & some[:, None]
                borders = pa.array(np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32))
                doc, lang = np.nonzero(used)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n), pa.array(pred.tolist(), pa.string()), pa.array(score),
                        pa.ListArray.from_arrays(borders, pa.array(names[lang].tolist() if len(names) else [], pa.string())),
                        pa.ListArray.from_arrays(borders, pa.array(share[doc, lang] if len(names) else np.zeros(0))),
                    ],
                    names=[id_col, "lang_pred", "score", "languages", "shares"],
                )

    schema = f"`{id_col}` {kind}, lang_pred string, score double, languages array<string>, shares array<double>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _has_letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Runs with a letter: of non-ASCII signs only letters count."""
    ascii_letter = (data < 128) & LETTERS[data]
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[ends] > total[starts]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"))
    return out
