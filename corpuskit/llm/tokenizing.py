"""Token ids of whole texts by a tokenizer file whose words end in `</w>`.

The tokenizers library encodes each distinct word once per worker; texts are cut
into words with array operations and their ids are put together from the words'.
This holds for tokenizers that lower-case NFC text, split it into runs of
letters, single digits, runs of other signs and English contractions, and merge
inside a word only. Texts with other signs than the plain ones of `_plain` (rare
scripts, combining marks, odd blanks, special tokens) go to the library whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from corpuskit.llm.arrays import owners, span_hashes, sums, worker_value

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MAX_WORDS = 1_000_000  # words kept per worker; then it starts afresh
OTHER, LETTER, NUMBER, SPACE = range(4)


def _plain():
    """(class, lower case, is plain) of the code points below 2^16."""
    kind, lower, plain = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint16), np.zeros(1 << 16, bool)
    for a, b in ((0x21, 0x7F), (0xA1, 0x250), (0x370, 0x530), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20B0), (0x3041, 0x3097), (0x30A1, 0x30FF), (0x4E00, 0x9FD0), (0xAC00, 0xD7A4)):
        for point in range(a, b):
            c = chr(point)
            category, low = unicodedata.category(c), c.lower()
            if category[0] in "MC" or len(low) != 1 or unicodedata.normalize("NFC", c) != c or unicodedata.normalize("NFC", low) != low:
                continue
            plain[point] = True
            lower[point] = ord(low)
            kind[point] = {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)
    blanks = [0x20, *range(0x09, 0x0E)]
    plain[blanks], kind[blanks] = True, SPACE
    return kind, lower, plain


class Encoder:
    """Encodes slices of texts; keeps the ids of the words seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind, self.lower, self.plain = _plain()
        self.values = np.random.default_rng(11).integers(1, 1 << 63, size=1 << 16, dtype=np.uint64) | np.uint64(1)
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.by_words = _splits_words(self.library)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text) of UTF-8 bytes cut at the offsets."""
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = lead[offsets]
        rows = len(offsets) - 1
        odd = np.zeros(rows, bool)
        if self.by_words:
            small = np.minimum(points, 0xFFFF).astype(np.uint16)
            odd[owners(np.flatnonzero(~self.plain[small]), bounds)] = True
            for token in self.special:
                at = text.find(token)
                while at >= 0:
                    odd[owners(np.array([at]), bounds)] = True
                    at = text.find(token, at + 1)
        else:
            odd[:] = True
        if not odd.any():
            return self._words(small, bounds)
        parts: list = [None] * rows
        usual = np.flatnonzero(~odd)
        if len(usual):
            lengths = np.diff(bounds)[usual]
            chosen = np.concatenate([small[bounds[i] : bounds[i + 1]] for i in usual])
            ids, counts = self._words(chosen, np.concatenate([[0], np.cumsum(lengths)]))
            for i, own in zip(usual, np.split(ids, np.cumsum(counts)[:-1])):
                parts[i] = own
        for i in np.flatnonzero(odd):
            own = self.library.encode(text[bounds[i] : bounds[i + 1]], add_special_tokens=False).ids
            parts[i] = np.array(own, np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, rows)

    def _words(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(bounds) - 1
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        kind, low = self.kind[points], self.lower[points]
        inside = kind != SPACE
        border = np.zeros(len(points) + 1, bool)
        border[bounds] = True
        begins = np.ones(len(points), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        begins = (begins | border[:-1]) & inside
        self._contractions(begins, kind, low, border)
        stops = np.ones(len(points), bool)
        stops[:-1] = ~inside[1:] | begins[1:]
        stops = (stops | border[1:]) & inside
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        hashes = span_hashes(low, starts, ends, self.values)
        unique, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = self._learn(unique, low, starts[example], ends[example])
        at, size = self.at[place][which], self.size[place][which]
        total = np.cumsum(size)
        ids = self.pool[np.repeat(at - total + size, size) + np.arange(total[-1] if len(total) else 0)]
        return ids, sums(size, np.bincount(owners(starts, bounds), minlength=rows))

    def _contractions(self, begins, kind, low, border) -> None:
        """'s 't 'm 'd 're 've 'll are words of their own after a lone apostrophe."""
        n = len(low)
        quote = np.flatnonzero((low[:-1] == 39) & begins[:-1] & (kind[1:] == LETTER) & ~border[1:-1])
        if not len(quote):
            return
        first = low[quote + 1]
        second = np.where(quote + 2 < n, low[np.minimum(quote + 2, n - 1)], 0)
        same = (quote + 2 < n) & ~border[np.minimum(quote + 2, n)]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = same & (((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l"))))
        for found, taken in ((one, 1), (two, 2)):
            at = quote[found]
            begins[at + 1] = False
            rest = at + 1 + taken
            rest = rest[rest < n]
            begins[rest[(kind[rest] == LETTER) & ~border[rest]]] = True

    def _learn(self, unique, low, starts, ends) -> np.ndarray:
        """Places of the given words in the tables, after adding the new ones."""
        place = np.searchsorted(self.known, unique)
        found = np.zeros(len(unique), bool)
        inner = place < len(self.known)
        found[inner] = self.known[place[inner]] == unique[inner]
        new = np.flatnonzero(~found)
        if not len(new):
            return place
        if len(self.known) + len(new) > MAX_WORDS and len(self.known):
            self._forget()
            return self._learn(unique, low, starts, ends)
        spelled = low.astype("<u2").tobytes().decode("utf-16-le")
        words = [spelled[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]
        ids = np.concatenate([np.array(self.library.encode(" ".join(words[i : i + 2000]), add_special_tokens=False).ids, np.uint32) for i in range(0, len(words), 2000)])
        ends_of = np.flatnonzero(self.closes[ids]) + 1
        if len(ends_of) != len(words):
            raise ValueError("the tokenizer does not close every word with one id")
        at = np.concatenate([[0], ends_of[:-1]])
        known = np.concatenate([self.known, unique[new]])
        order = np.argsort(known, kind="stable")
        self.at = np.concatenate([self.at, at + len(self.pool)])[order]
        self.size = np.concatenate([self.size, ends_of - at])[order]
        self.known, self.pool = known[order], np.concatenate([self.pool, ids])
        return np.searchsorted(self.known, unique)


def _splits_words(library) -> bool:
    """Is this the kind of tokenizer that the array path stands for?"""
    import json

    spec = json.loads(library.to_str())
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return steps == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": SPLIT} and spec["model"].get("end_of_word_suffix") == "</w>"


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return worker_value(f"encoder {path}", lambda: Encoder(path))
