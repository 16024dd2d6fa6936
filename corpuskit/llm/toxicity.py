"""Toxicity of texts that may hide their words.

Noisy channel: a writer spells a word and then disguises it with look-alike
signs, repeated letters, or letters set apart. Words that show such signs are
turned into a lattice of what each sign may stand for, and the likeliest spelling
under a character language model of the corpus is found by Viterbi decoding.
Letters set apart are divided into words again, by the counts of the corpus's
words. The restored text is scored by a logistic model of its words and word
beginnings.

The character and word counts are of all texts, in tables of fixed size; disguised
words and runs of letters may have any length. The classifier is fitted on the driver to
a bounded sample of labelled rows (`PER_LABEL` per label) and knows at most
`MAX_FEATURES` features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpuskit.llm.arrays import SpanHasher, mix, owners, span_hashes, spans, text_slices, words

PER_LABEL = 2000
MAX_FEATURES = 1 << 14
MIN_TEXTS = 4  # toxic sample texts that a feature must be in
BEGINNINGS = (3, 4, 5, 6, 7, 8)  # bytes
THRESHOLD = 0.7
MOST = 3.0
BITS = 18
CHANNEL = 4.0  # log odds against a sign standing for what it is not
WORD_BITS = 20  # slots of the word counts, of which there are two tables
KNOWN_LETTERS = 32  # longer words go by the character model alone

# Signs and the letters they are used for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
APART = ".-_*"
EDGES = ".,;:?\"'()[]{}<>-_*"  # not taken for a word's own signs at its ends

SIGN = np.zeros(256, bool)
SIGN[[ord(c) for c in LOOKALIKES if ord(c) < 128] + [0xE2]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(0xC3, 0xE0), *range(0xE3, 0xF5)]] = True
EDGE = np.zeros(256, bool)
EDGE[list(EDGES.encode() + b"!")] = True
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(97, 123), *range(128, 256)]] = True


def lowered(column) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


@dataclass(frozen=True)
class CharacterModel:
    """Hashed counts of byte triples and pairs in lower-cased words, and of the
    words, twice, each by other bits of the hash: the smaller count is nearer."""

    triples: np.ndarray
    pairs: np.ndarray
    words: np.ndarray

    def log(self, a: int, b: int, c: int) -> float:
        """log p(c | a b)."""
        triple, pair = ((a << 16 | b << 8 | c) * 0x9E3779B1 >> 7) & ((1 << BITS) - 1), a << 8 | b
        return float(np.log((self.triples[triple] + 0.1) / (self.pairs[pair] + 0.1 * 40)))

    def frequencies(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = word_slots(span_hashes(data, starts, ends))
        return np.minimum(self.words[one], self.words[two])


def word_slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << WORD_BITS) - 1)
    return (hashes & low).astype(np.int64), (hashes >> np.uint64(32) & low).astype(np.int64) + (1 << WORD_BITS)


def learn_characters(docs: DataFrame, text_col: str = "text") -> CharacterModel:
    """Counts over all texts; 2^BITS + 2^16 + 2^(WORD_BITS + 1) numbers come to the
    driver at most. A word is read with two blanks before it and one behind."""
    letters = (1 << BITS) + (1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(letters + (2 << WORD_BITS), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(lowered(batch.column(0))):
                starts, ends = spans(IN_WORD[data], offsets)
                inside = np.zeros(len(data) + 3, np.int64)
                at = np.flatnonzero(IN_WORD[data])
                inside[at + 2] = data[at]  # zero stands for a blank
                fresh = np.zeros(len(data) + 3, bool)
                fresh[starts + 2] = True
                last = np.zeros(len(data) + 3, bool)
                last[ends + 2] = True
                for where in (at + 2, ends + 2):
                    b = np.where(fresh[where], 0, inside[where - 1])
                    a = np.where(fresh[where] | fresh[where - 1], 0, inside[where - 2])
                    c = np.where(last[where], 0, inside[where]) if where is not at else inside[where]
                    c = np.where(fresh[where], inside[where], c)
                    triple = ((a << 16 | b << 8 | c) * 0x9E3779B1 >> 7) & ((1 << BITS) - 1)
                    counts[: 1 << BITS] += np.bincount(triple, minlength=1 << BITS)
                    counts[1 << BITS : letters] += np.bincount(a << 8 | b, minlength=1 << 16)
                for slot in word_slots(span_hashes(data, starts, ends)):
                    used, n = np.unique(slot, return_counts=True)
                    counts[letters + used] += n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["slot", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(letters + (2 << WORD_BITS))
    total[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    return CharacterModel(total[: 1 << BITS].astype(np.float32), total[1 << BITS : letters].astype(np.float32), total[letters:].astype(np.float32))


def set_apart(word: str) -> bool:
    return len(word) > 4 and len(set(word[1::2])) == 1 and word[1] in APART and all(c.isalpha() for c in word[::2])


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """What each run of equal signs of a lower-case word may stand for, with log
    weights. Single letters set apart by one sign are joined first."""
    if set_apart(word):
        word = word[::2]
    out = []
    for run in re.finditer(r"(.)\1*", word, re.S):
        sign, n = run[1], len(run[0])
        means = [(sign, 0.0 if sign.isalpha() else -CHANNEL), *((letter, -np.log(len(LOOKALIKES[sign]))) for letter in LOOKALIKES.get(sign, ""))]
        if n == 1:
            out.append(means)
        elif sign.isalpha() or sign in LOOKALIKES:
            once = -CHANNEL if n == 2 else 0.0  # a double letter is more often meant
            out.append([(m, w + once) for m, w in means] + [(m + m, w) for m, w in means])
        else:
            out.append([(sign * min(n, 2), 0.0)])
    return out


def decode(word: str, model: CharacterModel, breaks: bool = False) -> str:
    """The likeliest spelling behind a word. Ties go to the spelling that the
    lattice lists first. With `breaks` a word may end behind every sign; the
    spelling is given without the breaks."""
    scores: dict[tuple[int, int], float] = {(0, 0): 0.0}
    trail = []
    for means in [*lattice(word), [("\0", 0.0)]]:
        after: dict[tuple[int, int], float] = {}
        back: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (a, b), score in scores.items():
            for text, weight in means:
                x, y, value = a, b, score + weight
                for c in text.encode():
                    value += model.log(x, y, c)
                    x, y = y, c
                for state, reached in ((x, y), value), ((0, 0), value + model.log(x, y, 0) if breaks else -np.inf):
                    if reached > after.get(state, -np.inf):
                        after[state], back[state] = reached, ((a, b), text)
        trail.append(back)
        scores = after
    state, spelled = max(scores, key=scores.get), []
    for back in reversed(trail):
        state, text = back[state]
        spelled.append(text)
    return "".join(reversed(spelled)).rstrip("\0")


def divided(letters: str, model: CharacterModel) -> str:
    """Letters without blanks as the likeliest words. A word of the corpus has its
    share of all words; any other one, of any length, the share of a word seen once
    times its probability under the character model."""
    signs = [c.encode() for c in letters]
    cuts = np.concatenate([[0], np.cumsum([len(c) for c in signs])]).astype(np.int64)
    count, total = len(signs), max(float(model.words[: 1 << WORD_BITS].sum()), 1.0)
    first = np.repeat(np.arange(count), KNOWN_LETTERS)
    last = first + np.tile(np.arange(1, KNOWN_LETTERS + 1), count)
    first, last = first[last <= count], last[last <= count]
    often = model.frequencies(np.frombuffer(b"".join(signs), np.uint8), cuts[first], cuts[last])
    known: list[list[tuple[int, float]]] = [[] for _ in range(count + 1)]
    for i in np.flatnonzero(often).tolist():
        known[last[i]].append((int(first[i]), float(np.log(often[i] / total))))
    best, begin = [0.0] + [-np.inf] * count, [0] * (count + 1)
    inside: dict[tuple[int, int], tuple[float, int]] = {}  # of an unknown word: score, first letter
    for i, sign in enumerate(signs):
        after: dict[tuple[int, int], tuple[float, int]] = {}
        for (x, y), (value, start) in [*inside.items(), ((0, 0), (best[i] - np.log(total), i))]:
            for c in sign:
                value += model.log(x, y, c)
                x, y = y, c
            if (x, y) not in after or value > after[x, y][0]:
                after[x, y] = (value, start)
        inside = after
        ways = [(start, best[start] + share) for start, share in known[i + 1]]
        ways += [(start, value + model.log(x, y, 0)) for (x, y), (value, start) in inside.items()]
        begin[i + 1], best[i + 1] = max(ways, key=lambda w: w[1])
    out, end = [], count
    while end:
        out.append(letters[begin[end] : end])
        end = begin[end]
    return " ".join(reversed(out))


def suspects(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray):
    """(first word, last word + 1) of what looks disguised: a word with a sign
    before its last letter, with a letter three times running, or with letters
    set apart; and three or more words in a row that are one letter or sign, as one
    run, if a letter is among them. Punctuation may stand around a run."""
    letter, sign = LETTER[data], SIGN[data]
    n = len(data)
    last_letter = np.maximum.accumulate(np.where(letter, np.arange(n), -1))[ends - 1] if n else np.zeros(0, np.int64)
    signs = np.concatenate([[0], np.cumsum(sign)])
    has = last_letter >= starts
    leet = has & (signs[np.maximum(last_letter, starts)] > signs[starts])
    triple = np.zeros(n + 1, np.int64)
    if n > 2:
        run3 = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
        triple[3:] = np.cumsum(run3)
    longest = ends - starts
    repeat = np.where(longest > 2, triple[ends] - triple[np.minimum(starts + 2, ends)], 0) > 0
    mark = np.isin(data, np.frombuffer(APART.encode(), np.uint8))
    marks = np.concatenate([[0], np.cumsum(mark)])
    apart = (longest > 4) & (2 * (marks[ends] - marks[starts]) >= longest // 2) & has
    whole = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edges = np.concatenate([[0], np.cumsum(EDGE[data])])
    size = whole[ends] - whole[starts]
    euro = np.zeros(len(starts), bool)
    three = np.flatnonzero(longest == 3)
    euro[three] = (data[starts[three]] == 0xE2) & (data[starts[three] + 1] == 0x82) & (data[starts[three] + 2] == 0xAC)
    bare = size - (edges[ends] - edges[starts]) == 1
    head = (size > 1) & bare & has & EDGE[data[starts]] & (data[starts] != ord("!")) & ~EDGE[data[ends - 1]]
    odd = (leet | repeat | apart) & ~head
    own_letter = letter[starts] & ~odd
    single = (size == 1) & (own_letter | (sign[starts] & (longest == 1)) | euro)
    tail = (size > 1) & bare & own_letter
    # Runs of such words inside a text.
    texts = np.searchsorted(rows, np.arange(rows[-1] + 2 if len(rows) else 1))
    chain, stop = spans(single | tail | head, np.unique(np.concatenate([texts, np.flatnonzero(tail) + 1, np.flatnonzero(head)])))
    with_letter = np.concatenate([[0], np.cumsum(single & letter[starts] | tail | head)])
    long = (stop - chain >= 3) & (with_letter[stop] > with_letter[chain])
    first = np.concatenate([np.flatnonzero(odd), chain[long]])
    end = np.concatenate([np.flatnonzero(odd) + 1, stop[long]])
    order = np.argsort(first, kind="stable")
    return first[order], end[order]


def restore(data: np.ndarray, offsets: np.ndarray, model: CharacterModel, memory: dict) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lower-cased texts with their disguised words decoded."""
    starts, ends = words(data, offsets)
    rows = owners(starts, offsets)
    first, last = suspects(data, starts, ends, rows)
    if not len(first):
        return data, offsets
    body = data.tobytes()
    parts, at, grown = [], 0, np.zeros(len(offsets) - 1, np.int64)
    for a, b in zip(first.tolist(), last.tolist()):
        low, high = int(starts[a]), int(ends[b - 1])
        raw = body[low:high] if b == a + 1 else b"".join(body[starts[i] : ends[i]] for i in range(a, b))
        found = memory.get((b > a + 1, raw))
        if found is None:
            word = raw.decode("utf-8", "replace")
            core = word.lstrip(EDGES).rstrip(EDGES + "!")
            apart = set_apart(core)
            if b > a + 1 or apart:
                plain = divided(decode(core[::2] if apart else core, model, True), model)
            else:
                plain = decode(core, model)
            found = word.replace(core, plain, 1).encode() if core else raw
            if len(memory) > 200_000:
                memory.clear()
            if len(raw) < 64:
                memory[b > a + 1, raw] = found
        parts += [body[at:low], found]
        grown[rows[a]] += len(found) - (high - low)
        at = high
    parts.append(body[at:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets + np.concatenate([[0], np.cumsum(grown)])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the words and word beginnings of texts, repeats included."""
    starts, ends = spans(IN_WORD[data], offsets)
    rows = owners(starts, offsets)
    hasher = SpanHasher(data)
    found, owner = [mix(hasher(starts, ends) + np.uint64(1))], [rows]
    for n in BEGINNINGS:
        some = ends - starts > n
        found.append(hasher(starts[some], starts[some] + n))
        owner.append(rows[some])
    return np.concatenate(owner), np.concatenate(found)


def once(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


@dataclass(frozen=True)
class ToxicModel:
    characters: CharacterModel
    known: np.ndarray  # sorted features
    weights: np.ndarray
    bias: float
    bits: np.ndarray  # which low 16 bits a feature has

    def places(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place of the feature, value) of the known features, each once a
        row; the value grows with the logarithm of its count, up to MOST."""
        maybe = self.bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
        rows, hashes = rows[maybe], hashes[maybe]
        place = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        hit = self.known[place] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        both, n = np.unique(rows[hit] * max(len(self.known), 1) + place[hit], return_counts=True)
        return both // max(len(self.known), 1), both % max(len(self.known), 1), np.minimum(1 + np.log2(n), MOST)

    def scores(self, rows: np.ndarray, hashes: np.ndarray, count: int) -> np.ndarray:
        row, place, value = self.places(rows, hashes)
        total = np.bincount(row, weights=self.weights[place] * value, minlength=count) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _model(characters: CharacterModel, known: np.ndarray, weights: np.ndarray, bias: float) -> ToxicModel:
    bits = np.zeros(1 << 16, bool)
    bits[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    return ToxicModel(characters, known, weights, bias, bits)


def learn(docs: DataFrame, labels: DataFrame, characters: CharacterModel, toxic: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> ToxicModel:
    """Fits the classifier: `toxic` in `labels` is 1 or 0 (null: not labelled).
    Without rows of both labels every score is the share of toxic labels (0.5
    without any)."""
    shares = {r[0]: r[1] for r in labels.where(F.col(toxic).isin(0, 1)).groupBy(toxic).count().collect()}
    prior = np.log((shares.get(1, 0) + 0.5) / (shares.get(0, 0) + 0.5))
    chosen = [
        labels.where(F.col(toxic) == label).select(F.col(id_col).alias("_label_id"), F.col(toxic).cast("int").alias("_toxic"))
        .orderBy(F.xxhash64("_label_id"), "_label_id").limit(per_label)
        for label in (0, 1)
    ]
    # Bounded by 2 * per_label ids.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(chosen[0].unionAll(chosen[1])), F.col("_id") == F.col("_label_id")
    ).select("_toxic", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            toxic_row = batch.column(0).to_numpy() == 1
            for first, last, data, offsets in text_slices(lowered(batch.column(1))):
                row, found = once(*features(*restore(data, offsets, characters, memory)))
                is_toxic = toxic_row[first:last][row]
                values, where = np.unique(found, return_inverse=True)
                bad = np.bincount(where, weights=is_toxic, minlength=len(values)).astype(np.int64)
                good = np.bincount(where, weights=~is_toxic, minlength=len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(bad), pa.array(good)], names=["feature", "bad", "good"])

    counted = rows.mapInArrow(count, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sizes = {r[0]: r[1] for r in rows.groupBy("_toxic").count().collect()}
    bad_n, good_n = sizes.get(1, 0), sizes.get(0, 0)
    if not bad_n or not good_n:
        return _model(characters, np.zeros(0, np.uint64), np.zeros(0), float(prior))
    lift = F.log((F.col("bad") + 0.5) / (bad_n + 1.0)) - F.log((F.col("good") + 0.5) / (good_n + 1.0))
    chosen_features = (
        counted.where(F.col("bad") >= MIN_TEXTS).withColumn("gain", lift * F.sqrt("bad")).where("gain > 2")
        .orderBy(F.desc("gain"), "feature").limit(MAX_FEATURES).select("feature").toPandas()["feature"].to_numpy(np.int64)
    )
    known = np.sort(chosen_features.view(np.uint64))
    blank = _model(characters, known, np.zeros(len(known)), 0.0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            for first, last, data, offsets in text_slices(lowered(batch.column(1))):
                row, at, value = blank.places(*features(*restore(data, offsets, characters, memory)))
                borders = pa.array(np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(borders, pa.array(x)) for x in (at.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *lists], names=["toxic", "places", "given"])

    placed = rows.mapInArrow(place, "toxic int, places array<int>, given array<double>").collect()
    sample = sorted((r["toxic"], list(r["places"]), list(r["given"])) for r in placed)
    weights, bias = fit([p for _, p, _ in sample], [v for _, _, v in sample], np.array([t for t, _, _ in sample]), len(known))
    # The sample holds both labels alike; the corpus does not.
    return _model(characters, known, weights, bias + float(prior - np.log(bad_n / good_n)))


def fit(places: list[list[int]], values: list[list[float]], toxic: np.ndarray, width: int, rounds: int = 300, decay: float = 2e-3, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse features, weights not below zero."""
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    at = np.fromiter((x for p in places for x in p), np.int64, len(row))
    given = np.fromiter((x for v in values for x in v), float, len(row))
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    n = len(places)
    for k in range(1, rounds + 1):
        z = np.bincount(row, weights=theta[at] * given, minlength=n) + theta[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - toxic) / n
        grad = np.append(np.bincount(at, weights=miss[row] * given, minlength=width) + decay * theta[:-1] / max(width, 1), miss.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)
    return theta[:-1], float(theta[-1])


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted): a row per input row; `score` is the
    probability of a toxic label, `predicted` 1 from the threshold on.

    Null and empty texts get the score of a text without known features. Other
    columns are dropped; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            for first, last, data, offsets in text_slices(lowered(batch.column(1))):
                data, offsets = restore(data, offsets, model.characters, memory)
                value = model.scores(*features(data, offsets), last - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                    names=[id_col, "score", "predicted"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
