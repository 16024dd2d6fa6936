"""Encoding, packing (3), plane files (4) and token counts (5)."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import curve_packing, plane_files, token_counts, tokenizing
from corpuskit.llm.arrays import text_slices

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts(count=600):
    rng = random.Random(1)
    signs = "ab'sSdDrRevVlLmt  \n\t019,.!<|ßéÀÉİıǅΣσς’“—漢あ \u0085é½²"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 60))) for _ in range(count)]
    return texts + ["it's I'll we've they're 'sabc ''s x's's 'RE don't!'s <|endoftext|> a", "", "   ", "<|startoftext|>x"]


def test_encoder_gives_the_librarys_ids():
    texts, own, plain = odd_texts(), tokenizing.Encoder(PATH), library()
    assert own.by_words
    for first, last, data, offsets in text_slices(pa.array(texts), 3000):
        ids, counts = own.encode(data, offsets)
        for text, got in zip(texts[first:last], np.split(ids, np.cumsum(counts)[:-1])):
            assert got.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokenizing, "MAX_WORDS", 5)
    own, plain = tokenizing.Encoder(PATH), library()
    for text in ["one two three four", "five six seven eight nine ten", "one five eleven"]:
        data = np.frombuffer(text.encode(), np.uint8)
        assert own.encode(data, np.array([0, len(data)]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_go_to_the_library():
    own = tokenizing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not own.by_words
    data = np.frombuffer(b"Some  text here", np.uint8)
    ids, counts = own.encode(data, np.array([0, 4, 15]))
    assert counts.tolist() == [len(own.library.encode("Some").ids), len(own.library.encode("  text here").ids)] and len(ids) == counts.sum()


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = curve_packing.hilbert_key(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def rows_for_packing(prose):
    texts = [None, "", *(prose(i, 5 + 37 * (i % 9)) for i in range(60)), "same words here " * 40, prose(99, 9000), *odd_texts(20)]
    return [*enumerate(texts), *[(1000 + i, "copy of this " * 30) for i in range(40)], (5, texts[5])]


def test_packing_is_whole(docs, prose):
    rows = rows_for_packing(prose)
    pieces = curve_packing.pack(docs(rows), PATH, size=256).collect()
    plain = library()
    whole, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        whole[p.doc_id].append(p)
    for i, text in {i: t for i, t in rows}.items():
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        times = sum(1 for j, _ in rows if j == i)
        seen = np.zeros(len(ids), int)
        for p in whole[i]:
            part = np.frombuffer(p.ids, "<u4").tolist()
            assert len(part) == p.length > 0 and p.doc_tokens == len(ids) and part == ids[p.start : p.start + p.length]
            seen[p.start : p.start + p.length] += 1
        assert (seen == times).all()
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256 and at & (at - 1) == 0  # full, or a power of two


def test_packing_limits(docs):
    assert curve_packing.pack(docs([]), PATH).collect() == []
    with pytest.raises(ValueError):
        curve_packing.pack(docs([(1, "a")]), PATH, size=100)


def test_like_documents_share_sequences(docs):
    a = [(i, "alpha beta gamma delta " * 20) for i in range(20)]
    b = [(100 + i, "uno dos tres cuatro cinco " * 20) for i in range(20)]
    pieces = curve_packing.pack(docs([x for pair in zip(a, b) for x in pair]), PATH, size=1024).collect()
    groups = defaultdict(set)
    for p in pieces:
        groups[p.sequence_id].add(p.doc_id >= 100)
    assert sum(len(g) == 2 for g in groups.values()) <= 2


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_plane_files_round_trip(docs, prose, planes, tmp_path):
    rows = rows_for_packing(prose)
    files = plane_files.write(docs(rows), PATH, planes=planes, block=100, folder=f"file://{tmp_path}/out")
    got = plane_files.read(files).collect()
    plain, at = library(), 0
    assert len(got) == len(rows)
    for r, (i, text) in zip(sorted(got, key=lambda r: r.start), sorted(rows, key=lambda r: r[0])):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    assert files.agg(F.sum("n_ids")).first()[0] == at
    path = files.first()["path"]
    system, place = plane_files.file_system(path)
    with system.open_input_file(place) as stream:
        reader = plane_files.Reader(stream, stream.size())
        every = reader.ids(0, reader.index["ids"])
        assert reader.ids(37, 250).tolist() == every[37:250].tolist() and reader.ids(5, 5).tolist() == []


def test_plane_files_of_nothing(docs):
    files = plane_files.write(docs([]), PATH)
    assert files.collect() == [] and plane_files.read(files).collect() == []


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (plane_files.from_planes(plane_files.to_planes(ids, kind), n, kind) == ids).all()


def test_token_counts_equal_the_tokenizers(docs):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    rng = random.Random(6)
    # Few scores make many ties.
    pieces = [("▁", -2.0), *((c, -2.0) for c in "abcé"), *(("".join(rng.choice("▁abcé" if k == 0 else "abcé") for k in range(rng.randrange(2, 5))), float(-rng.randrange(1, 5))) for _ in range(60))]
    pieces = list(dict(pieces).items())
    exact = Tokenizer(models.Unigram([("<unk>", -1.0), *pieces], unk_id=0, byte_fallback=False))
    exact.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[^\x20\x09-\x0D]+"), "removed", invert=True), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)])
    texts = ["".join(rng.choice("aabbccééxy漢 \n") for _ in range(rng.randrange(0, 80))) for _ in range(300)] + ["", " ", "xyx", "ab" * 50_000]
    rows = [*enumerate(texts), (0, texts[0]), (900, None)]
    got = token_counts.count_tokens(docs(rows), pieces).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = exact.encode(texts[r.doc_id] if r.doc_id != 900 else "", add_special_tokens=False).ids
        assert (r.n_tokens, r.n_unknown) == (len(ids), sum(i == 0 for i in ids))
    assert token_counts.count_tokens(docs([]), pieces).collect() == []


def test_vocabulary_file():
    pieces = dict(token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    assert len(pieces) > 30_000 and all(s < 0 for s in pieces.values()) and "▁the" in pieces


def test_crc_of_ids(spark):
    frame = spark.createDataFrame([(bytearray(b"\x01\x00\x00\x00"),)], "ids binary")
    assert frame.select(F.crc32("ids")).first()[0] == zlib.crc32(b"\x01\x00\x00\x00")


def test_a_word_of_any_length_needs_little_memory():
    counter = token_counts.Counter([("a", -1.0), ("aa", -1.5), ("b", -1.0)])
    word = "a" * 300_000 + "?" * 5 + "b"
    tracemalloc.start()
    pieces, unknown, score = counter.count(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (pieces, unknown) == (150_002, 1) and score == -150_000 * 1.5 - 5 * 11.5 - 1
    # The automaton copies the word, four bytes a sign; states add next to nothing.
    assert peak < 5 * len(word)
    assert counter.count("") == (0, 0, 0.0)


def test_ranges_follow_the_ids(docs, monkeypatch):
    rows = docs([(i, f"word{i % 50} " * 40) for i in range(400)])
    plain = curve_packing.pack(rows, PATH).agg(F.sum("length")).first()[0]
    monkeypatch.setattr(curve_packing, "RANGE_IDS", 2000)
    pieces = curve_packing.pack(rows, PATH).cache()
    assert pieces.agg(F.sum("length")).first()[0] == plain
    ranges = pieces.select(F.shiftright("sequence_id", curve_packing.SEQUENCE_BITS)).distinct().count()
    assert plain // 4000 <= ranges <= -(-plain // 2000)
