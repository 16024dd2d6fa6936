"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from corpuskit.llm import collocations, queries, tokenizer_alignment as alignment, vector_join


# -- token pairs -------------------------------------------------------------------

A, B = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")


def plain_alignment(texts):
    """Rows of n_a, n_b, n_groups, n_links, n_best, count_sum, digest by whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    sign = alignment.byte_of_sign()
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        whole = (" " + text).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(sign[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append(None)
            continue

        def ends(parts):
            out, at = {}, 0
            for n, part in enumerate(parts):
                at += len(part)
                out[at] = n
            return out

        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        groups, links, last = [], [], (0, 0)
        for at in sorted(set(ends_a) & set(ends_b)):
            now = ends_a[at] + 1, ends_b[at] + 1
            groups.append(",".join(map(str, ids_a[last[0] : now[0]])) + "|" + ",".join(map(str, ids_b[last[1] : now[1]])))
            links.append((ids_a[now[0] - 1], ids_b[now[1] - 1]))
            last = now
        found.append((len(ids_a), len(ids_b), groups, links))
    counts = Counter(pair for f in found if f for pair in f[3])
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        rows.append((
            f[0], f[1], len(f[2]), len(f[3]), sum(counts[p] == most[p[1]] for p in f[3]), sum(counts[p] for p in f[3]),
            hashlib.sha256(";".join(f[2]).encode()).hexdigest(),
        ))
    return rows, counts


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

TEXTS = [
    "The harbour lantern, the harbour lantern!", None, "", " ", "  two  blanks   and three ", "line one.\nline two\n\n  indented\ttabbed \n",
    "éàü ñ œuvre straße — ‘quoted’ “words” …", "中文 文字 混ぜる かな 한국어 hello", "emoji 🙂 🙂🙂 end🙂 x", "<|endoftext|> is plain <s> and </s> too",
    "a▁b is not spelled", "\x00 nul \x1c\x1d controls \x7f", "no-break blank and em blank 　wide", "don't we'll I'M they're 'quoted' it's",
    "x" * 700, "word " * 500, "1234567890 3.14159 0xDEADBEEF", "ﬁ ligature é combining", "﻿bom", "tail blank ", "tail break\n", "\nhead break", "हिन्दी शब्द यहाँ हैं", "Ünïcödé Ćwords ąre hére now",
]


@pytest.mark.parametrize("block", [1 << 23, 40])
def test_alignment_equals_encoding_whole_texts(docs, block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    frame = docs(list(enumerate(TEXTS + TEXTS[:3])))
    got = {r["id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(frame, A, B).collect()}
    want, _ = plain_alignment(TEXTS + TEXTS[:3])
    assert [got[i] for i in range(len(want))] == want


def test_pair_counts_add_up_over_texts(docs, prose):
    texts = [prose(i % 7, 120) for i in range(40)]
    encoded = alignment.encode(docs(list(enumerate(texts))).repartition(5), A, B)
    rows = {(r["a"], r["b"]): (r["texts"], r["links"]) for r in alignment.pair_counts(encoded).collect()}
    _, counts = plain_alignment(texts)
    assert {k: v[1] for k, v in rows.items()} == counts
    assert max(v[0] for v in rows.values()) == 40


def test_alignment_of_nothing_and_of_repeated_ids(docs):
    assert alignment.align(docs([]), A, B).count() == 0
    rows = alignment.align(docs([(None, "one text"), (None, "one text"), (3, "other")]), A, B).collect()
    assert len(rows) == 3 and {r["count_sum"] for r in rows if r["id"] is None} == {4}


def test_planes_hold_pairs_and_multiplicities():
    import numpy as np

    rng = random.Random(3)
    held = [(rng.randrange(6), rng.randrange(50)) for _ in range(900)]
    held += [(2, 7)] * 37
    links, texts = Counter(), defaultdict(set)
    pair, text = (np.array(x) for x in zip(*held))
    for plane, pairs, size, dense, bits in alignment.planes(pair, text, 50):
        for p, n, full, b in zip(pairs.tolist(), size.tolist(), dense, bits):
            at = alignment.texts_of(full, b).tolist()
            assert len(at) == n
            for t in at:
                links[p, t] += 1 << max(plane - 1, 0)
            if plane == 0:
                texts[p] |= set(at)
    assert links == Counter(held)
    assert {p: len(t) for p, t in texts.items()} == {p: len({t for q, t in held if q == p}) for p in texts}


# -- vectors -----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, id string, score string, rank string, vector string"


def plain_neighbours(rows, k):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}

    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    for i, v in good:
        if i % 50 == 0:
            near = sorted({(-dot(v, w) / (math.sqrt(dot(v, v)) * math.sqrt(dot(w, w))), j) for j, w in good if j != i})
            out[i] = [(j, -s) for s, j in near[:k]]
    return {q: n for q, n in out.items() if n}


def found_neighbours(spark, rows, k):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], VECTORS)
    out = defaultdict(list)
    for r in vector_join.nearest(frame.repartition(3), F.col("vec_id") % 50 == 0, k).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_neighbours_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "TILE_ROWS", 64)
    monkeypatch.setattr(vector_join, "QUERY_ROWS", 4)
    monkeypatch.setattr(vector_join, "GROUP_BYTES", 20_000)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(700)]
    for i in range(0, 700, 3):  # a third of all rows is one vector, another is near it
        rows[i] = (i, rows[0][1])
    for i in range(1, 200, 7):
        rows[i] = (i, [x + 1e-9 * (i % 3) for x in rows[0][1]])
    assert found_neighbours(spark, rows, 5) == plain_neighbours(rows, 5)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (200, [1.0, None]), (1, [2.0, 0.0]), (2, [inf, 1.0]), (3, [1.0, 1.0]),
            (3, [1.0, 1.0]), (4, []), (None, [1.0, 0.0]), (250, [2.0**-700, 2.0**-700]), (5, [-3.0, 0.0])]
    got = found_neighbours(spark, rows, 5)
    assert [j for j, _ in got[0]] == [1, 3, 250, 5] and got[0][0][1] == 1.0 and got[0][-1][1] == -1.0
    assert [j for j, _ in got[250]] == [3, 0, 1, 5]
    assert set(got) == {0, 250}
    assert found_neighbours(spark, [], 5) == {}


def test_error_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    for width in (1, 3, 64, 1500):
        v = rng.standard_normal((200, width)) * rng.choice([1e-6, 1, 1e6], (200, 1))
        v[::5, 0] *= 1e4
        r = vector_join.Rounded(np.arange(200), v)
        true = (v / r.lengths[:, None]) @ (v / r.lengths[:, None]).T
        about = vector_join.product(r.codes, r.codes) * r.scale[:, None] * r.scale
        assert (np.abs(true - about) <= r.lost[:, None] + r.lost * (1 + r.lost.max()) + vector_join.SLACK).all()


# -- phrases -----------------------------------------------------------------------


def plain_collocations(rows, top, longest, least):
    """rows: (lang, text)."""
    import re

    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    count[lang, tuple(words[i : i + size])] += 1
    cands = {k: n for k, n in count.items() if len(k[1]) > 1 and n >= least}
    out = []
    for (lang, w), a in cands.items():
        if any(x == lang and len(v) > len(w) and 100 * n >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), n in cands.items()):
            continue
        cut = min((1000 * a * total[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, count[lang, w[: cut[1]]], count[lang, w[cut[1] :]], total[lang], cut[0]))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen, ranked = Counter(), []
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return ranked


@pytest.mark.parametrize("block", [1 << 23, 300])
def test_collocations_equal_counting_all_windows(spark, block, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    monkeypatch.setattr(collocations, "SEGMENT_WORDS", 2)
    rng = random.Random(11)
    words = ["the", "The", "of", "été", "a", "b", "c", "x y", "-", "New", "York", "City"]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randrange(60)):
            parts.append(rng.choice(words) if rng.random() < 0.8 else "new york city hall station")
            parts.append(rng.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", " ; "]))
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und"]), "".join(parts)))
    rows += [("en", None), ("en", ""), ("de", "?!"), ("en", rows[0][1]), ("aa", "a a a a a a a a a a a a a a a a")]
    frame = spark.createDataFrame([(i, t, lang, "p", 3, "n") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n long, next string")
    got = [tuple(r) for r in collocations.collocations(frame.repartition(5), 40, min_count=6).orderBy("lang", "rank").collect()]
    assert got == plain_collocations(rows, 40, 5, 6)
    assert {r[0] for r in got} >= {"en", "und", "aa"}


def test_scores_pass_64_bits(spark):
    rows = [(1, "en", "", 10**13, 10**12, ["a", "b"], [10**12, 10**12]), (2, "en", "a", 10**12, 10**12, ["b"], [10**12]), (2, "en", "b", 10**12 + 7, 5, [], [])]
    frame = spark.createDataFrame(rows, "level int, lang string, prefix string, total long, largest long, next array<string>, n array<long>")
    got = collocations.scored(frame).collect()
    assert [(r["phrase"], r["a"], r["l"], r["r"], r["score"]) for r in got] == [("a b", 10**12, 10**12, 10**12 + 7, 1000 * 10**12 * 10**13 // (10**12 * (10**12 + 7)))]


def test_no_phrases_in_an_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(frame, 10).count() == 0
