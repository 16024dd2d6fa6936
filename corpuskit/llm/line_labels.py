"""Quality rules by line labelling: a linear-chain conditional random field marks
every line of a document as content or boilerplate, and the share of words in
content lines decides whether the document is kept.

The two-state chain is trained on the driver from a bounded sample of labelled
documents (`TRAIN_DOCUMENTS` per label, of each `TRAIN_WINDOWS` windows of at most
`TRAIN_LINES` lines, anywhere in the text): the lines of a document take its label. Decoding covers every line of
every text and is a map over Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuskit.llm.arrays import gram_hashes, line_owners, lines as line_spans, mix, owners, repeated, span_hashes, sums, text_slices, words as word_spans

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words inside 3-word windows that occur again
MIN_CONTENT = 0.5
TRAIN_DOCUMENTS = 1500
TRAIN_LINES = 64
TRAIN_WINDOWS = 4
SYMBOLS = b"#*$%&|<>"

FEATURES = (
    "line", "no word", "1-2 words", "3-9 words", "10 words or more", "capitals over half", "capitals over a fifth",
    "a symbol", "symbols over 0.1 a word", "symbols over half a word", "exclamations over 0.3 a word", "digits over a fifth",
    "repeated words over 0.8", "repeated words over 0.3", "equal to an earlier line", "ends a sentence", "long words", "short words",
)
# Used where no labels are given or all are alike.
DEFAULT_WEIGHTS = (
    2.0, 0.5, 0.0, 0.3, 0.5, -4.0, 0.0, -0.5, -1.0, -4.0, -3.0, -1.0, -4.0, -1.0, -1.0, 0.5, -1.0, -0.5,
)


@dataclass(frozen=True)
class LineModel:
    """State 1 is content. emission[f] is added for content where feature f
    holds; transition[a][b] for a step from state a to b; start[b] at line one."""

    emission: tuple[float, ...] = DEFAULT_WEIGHTS
    transition: tuple[tuple[float, float], tuple[float, float]] = ((0.5, -0.5), (-0.5, 0.5))
    start: tuple[float, float] = (0.0, 0.0)


@dataclass
class Facts:
    """Counts of one slice: per line, and per document."""

    features: np.ndarray
    line_words: np.ndarray
    line_counts: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def facts(data: np.ndarray, offsets: np.ndarray) -> Facts:
    rows = len(offsets) - 1
    starts, ends = word_spans(data, offsets)
    owner = owners(starts, offsets)
    line_starts, line_ends = line_spans(data, offsets)
    line_owner = line_owners(data, offsets)

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[line_ends] - total[line_starts]

    hashes = span_hashes(data, starts, ends)
    windows = gram_hashes(hashes, 3)
    inside = np.flatnonzero(owner[: len(windows)] == owner[2:]) if len(windows) else np.zeros(0, np.int64)
    again = repeated(owner[inside], windows[inside])[1]
    covered = np.zeros(len(starts), bool)
    for step in range(3):
        covered[inside[again] + step] = True

    # Words never cross a line, so the words of a line are consecutive.
    word_line = np.searchsorted(line_starts, starts, side="right") - 1
    line_words = np.bincount(word_line, minlength=len(line_starts))
    line_repeats = np.bincount(word_line[covered], minlength=len(line_starts))
    with_word = np.flatnonzero(line_words)
    line_hashes = span_hashes(data, line_starts[with_word], line_ends[with_word])
    duplicate = np.zeros(len(line_starts), bool)
    duplicate[with_word] = repeated(line_owner[with_word], line_hashes)[0]

    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    symbol = table[data]
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 0xC0)
    digit = (data >= 48) & (data <= 57)
    space = np.isin(data, np.array([0x20, *range(0x09, 0x0E)], np.uint8))
    point = ((data & 0xC0) != 0x80) & ~space
    line_symbols, line_upper, line_letters = per_line(symbol), per_line(upper), per_line(letter)
    line_points, line_digits, line_calls = per_line(point), per_line(digit), per_line(data == 33)
    last = np.zeros(len(line_starts), bool)
    last_word = np.cumsum(line_words)[with_word] - 1
    last[with_word] = np.isin(data[ends[last_word] - 1], np.frombuffer(b".!?:", np.uint8))
    w, letters = np.maximum(line_words, 1), np.maximum(line_letters, 1)
    mean = line_points / w
    features = np.stack(
        [
            np.ones(len(line_starts), bool), line_words == 0, (line_words > 0) & (line_words < 3),
            (line_words >= 3) & (line_words < 10), line_words >= 10, 2 * line_upper > letters, 5 * line_upper > letters,
            line_symbols > 0, line_symbols > 0.1 * w, line_symbols > 0.5 * w, line_calls > 0.3 * w,
            5 * line_digits > np.maximum(line_points, 1), line_repeats > 0.8 * w, line_repeats > 0.3 * w, duplicate, last,
            mean > 12, (mean < 3) & (line_words > 0),
        ],
        axis=1,
    )
    line_counts = np.bincount(line_owner, minlength=rows)
    return Facts(
        features, line_words, line_counts,
        np.bincount(owner, minlength=rows), sums(line_points, line_counts), sums(line_symbols, line_counts),
        sums(duplicate.astype(np.int64), line_counts), sums(line_repeats, line_counts),
    )


def decode(scores: np.ndarray, counts: np.ndarray, model: LineModel) -> np.ndarray:
    """The best state of every line. `scores` are the content scores of the lines
    of consecutive documents; a tie goes to content. All documents advance
    together, one line at a time."""
    first = np.cumsum(counts) - counts
    by_length = np.argsort(-counts, kind="stable")
    longest = int(counts.max(initial=0))
    alive = np.searchsorted(-counts[by_length], -np.arange(longest), side="left")
    back = np.zeros((len(scores), 2), bool)
    step = np.asarray(model.transition, float)
    best = np.zeros((len(counts), 2))
    final = np.zeros(len(counts), bool)
    for t in range(longest):
        rows = by_length[: alive[t]]
        at = first[rows] + t
        if t == 0:
            best[rows] = np.asarray(model.start, float)
        else:
            old = best[rows]
            for b in (0, 1):
                stay, come = old[:, 0] + step[0, b], old[:, 1] + step[1, b]
                back[at, b] = come >= stay
                best[rows, b] = np.maximum(stay, come)
        best[rows, 1] += scores[at]
    final = best[:, 1] >= best[:, 0]
    states = np.zeros(len(scores), bool)
    state = final.copy()
    for t in range(longest - 1, -1, -1):
        rows = by_length[: alive[t]]
        at = first[rows] + t
        states[at] = state[rows]
        state[rows] = np.where(states[at], back[at, 1], back[at, 0])
    return states


def _failed(f: Facts) -> np.ndarray:
    return (f.n_words < MIN_WORDS) | (100 * f.n_repeat_words > MAX_REPEATED * f.n_words)


def _verdict(f: Facts, model: LineModel, weights: np.ndarray, min_content: float):
    """(content lines, content share, kept)."""
    content = decode(f.features @ weights, f.line_counts, model)
    content_words = sums(f.line_words * content, f.line_counts)
    share = np.where(f.n_words > 0, content_words / np.maximum(f.n_words, 1), 1.0)
    return content, share, ~_failed(f) & (share >= min_content)


def label_lines(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """One row per input row: id, the base counts, `base_failed`, `content_share`
    (of words; 1 without words), `boilerplate_lines` (numbers from 0) and `kept`.

    A null text is the empty text, which fails the base rules. Repeated rows each
    get their own row; other columns are dropped, whatever their names. An empty
    table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    weights = np.asarray(model.emission, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                f = facts(data, offsets)
                content, share, kept = _verdict(f, model, weights, min_content)
                inside = np.arange(len(content)) - np.repeat(np.cumsum(f.line_counts) - f.line_counts, f.line_counts)
                dropped = sums((~content).astype(np.int64), f.line_counts)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(dropped)]).astype(np.int32)), pa.array(inside[~content].astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        *(pa.array(x.astype(np.int64)) for x in (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words)),
                        pa.array(_failed(f)), pa.array(share), lists, pa.array(kept),
                    ],
                    names=names,
                )

    names = [
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share",
        "boilerplate_lines", "kept",
    ]
    schema = (
        f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, content_share double, boilerplate_lines array<int>, kept boolean"
    )
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, good: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = TRAIN_DOCUMENTS, per_text: int = TRAIN_WINDOWS) -> LineModel:
    """Fits the chain to the labelled rows of `docs`: in `labels`, `good` is 1 for
    content, 0 for junk, null for neither. The `per_label` ids with the smallest
    hash are taken for each label, so what is sent to the tasks that read the
    texts is bounded, and only line features of these texts come to the driver: of a
    text with more than `per_text` windows of lines those with the smallest hashes of
    id and window number, so they lie anywhere in it.
    Without rows of both labels the default weights serve.
    """
    chosen = [
        labels.where(F.col(good) == label).select(F.col(id_col).alias("_label_id"), F.col(good).cast("int").alias("_good"))
        .orderBy(F.xxhash64("_label_id"), "_label_id").limit(per_label)
        for label in (0, 1)
    ]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(chosen[0].unionAll(chosen[1])), F.col("_id") == F.col("_label_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goods = batch.column(0).to_numpy(zero_copy_only=False)
            seeds = mix(batch.column(1).to_numpy().view(np.uint64))
            for first, last, data, offsets in text_slices(batch.column(2)):
                f = facts(data, offsets)
                at = np.cumsum(f.line_counts) - f.line_counts
                packed, where = [], []
                for row in range(last - first):
                    windows = np.arange(at[row], at[row] + f.line_counts[row], TRAIN_LINES)
                    if len(windows) > per_text:
                        order = np.argsort(mix(seeds[first + row] + np.arange(len(windows), dtype=np.uint64)), kind="stable")
                        windows = windows[np.sort(order[:per_text])]
                    for a in windows:
                        b = min(a + TRAIN_LINES, at[row] + f.line_counts[row])
                        packed.append(np.packbits(f.features[a:b], axis=1).tobytes())
                        where.append(int(goods[first + row]))
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(packed, pa.binary())], names=["good", "features"])

    width = (len(FEATURES) + 7) // 8
    found = rows.select("_good", F.xxhash64("_id"), "_text").mapInArrow(run, "good int, features binary").collect()
    found.sort(key=lambda r: (r["good"], bytes(r["features"])))  # the same sums whatever the tasks' order
    sample = [(r["good"], np.unpackbits(np.frombuffer(r["features"], np.uint8).reshape(-1, width), axis=1)[:, : len(FEATURES)]) for r in found]
    if len({g for g, _ in sample}) < 2:
        return LineModel()
    return fit([x for _, x in sample], [g for g, _ in sample])


def fit(sequences: list[np.ndarray], goods: list[int], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> LineModel:
    """Gradient ascent on the conditional likelihood; both labels weigh alike."""
    n, longest, width = len(sequences), max(map(len, sequences)), sequences[0].shape[1]
    x = np.zeros((n, longest, width), np.float32)
    mask = np.zeros((n, longest), bool)
    for i, s in enumerate(sequences):
        x[i, : len(s)], mask[i, : len(s)] = s, True
    y = np.asarray(goods, int)
    share = np.bincount(y, minlength=2)
    weight = (n / (2.0 * np.maximum(share, 1)))[y] / n
    theta = np.zeros(width + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold_x = np.einsum("ntf,n->f", x * mask[..., None], weight * y)
    gold_t = np.zeros((2, 2))
    gold_s = np.zeros(2)
    lengths = mask.sum(1)
    for label in (0, 1):
        gold_t[label, label] = (weight * (lengths - 1))[y == label].sum()
        gold_s[label] = weight[y == label].sum()
    for k in range(1, rounds + 1):
        e, trans, start = theta[:width], theta[width : width + 4].reshape(2, 2), theta[width + 4 :]
        scores = x @ e.astype(np.float32)
        forward = np.zeros((n, longest, 2))
        forward[:, 0] = start
        forward[:, 0, 1] += scores[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(forward[:, t - 1, 0, None] + trans[0], forward[:, t - 1, 1, None] + trans[1])
            step[:, 1] += scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        backward = np.zeros((n, longest, 2))
        want_t = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            ahead = backward[:, t + 1].copy()
            ahead[:, 1] += scores[:, t + 1]
            step = np.logaddexp(trans[:, 0] + ahead[:, 0, None], trans[:, 1] + ahead[:, 1, None])
            live = mask[:, t + 1]
            pair = np.exp(forward[:, t, :, None] + trans + ahead[:, None, :] - norm[:, None, None])
            want_t += np.einsum("nab,n->ab", pair, weight * live)
            backward[:, t] = np.where(live[:, None], step, backward[:, t + 1])
        share1 = np.exp(forward[..., 1] + backward[..., 1] - norm[:, None]) * mask
        want_x = np.einsum("ntf,nt->f", x, share1 * weight[:, None])
        first = np.exp(forward[:, 0] + backward[:, 0] - norm[:, None])
        want_s = (first * weight[:, None]).sum(0)
        grad = np.concatenate([gold_x - want_x, (gold_t - want_t).ravel(), gold_s - want_s]) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    trans = theta[width : width + 4].reshape(2, 2)
    return LineModel(tuple(theta[:width].tolist()), tuple(map(tuple, trans.tolist())), tuple(theta[width + 4 :].tolist()))


def keep_content(docs: DataFrame, model: LineModel, text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of `docs` whose text is kept, as they are: the same verdict as
    `label_lines`, as a filter that moves no text to another task."""
    weights = np.asarray(model.emission, float)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(where)):
                yield batch.slice(first, last - first).filter(pa.array(_verdict(facts(data, offsets), model, weights, min_content)[2]))

    return docs.mapInArrow(run, docs.schema)
