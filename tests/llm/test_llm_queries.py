"""The registered queries over the smallest given tables, against plain versions."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from corpuskit.llm import line_frequency, token_counts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def given(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    return {name: read(name) for name in ("documents", "benchmark", "labels")}


@pytest.fixture(scope="module")
def texts(given):
    return {r.doc_id: r.text or "" for r in given["documents"]}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def rows(spark, name):
    return contract.queries()[name](spark, SF).collect()


def crc_group(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_every_operator_and_the_pipeline_are_registered():
    names = contract.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_op1(spark, given):
    got = {r.doc_id: r for r in rows(spark, "op1_language_mixture")}
    assert len(got) == len(given["documents"])
    held = [(got[r.doc_id].lang_pred, r.lang) for r in given["documents"] if crc_group(r.doc_id, 4) == 2]
    assert all(r.held_out == (crc_group(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got.values())
    assert sum(a == b for a, b in held) > 0.95 * len(held)


def test_op2(spark, given, texts):
    got = {(r.doc_id, r.item_id): r.score for r in rows(spark, "op2_decontamination")}
    whole = {(d, b.item_id) for d, t in texts.items() for b in given["benchmark"] if b.text in t}
    assert whole and whole <= set(got) and all(got[k] == 1.0 for k in whole)


def test_op3(spark, texts, library):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op3_curve_packing"):
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0


def test_op4(spark, texts, library):
    want, at = set(), 0
    for i in sorted(texts):
        ids = np.array(library.encode(texts[i], add_special_tokens=False).ids + [1], "<u4")
        want.add((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert {tuple(r) for r in rows(spark, "op4_plane_files")} == want


def test_op5(spark, texts):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    exact = Tokenizer(models.Unigram([("<unk>", -1.0), *pieces], unk_id=0, byte_fallback=False))
    exact.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(WORD.pattern), "removed", invert=True), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)])
    got = rows(spark, "op5_token_counts")
    assert len(got) == len(texts)
    for r in got:
        ids = exact.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.n_unknown) == (len(ids), sum(i == 0 for i in ids))


def base(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    full = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered)


def test_op6(spark, given, texts):
    got = {r.doc_id: r for r in rows(spark, "op6_line_labels")}
    for i, text in texts.items():
        r, want = got[i], base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    judged = [(r.quality, got[r.doc_id].kept) for r in given["labels"] if not got[r.doc_id].base_failed]
    assert all(k for q, k in judged if q == 1) and not any(k for q, k in judged if q == 0)


def test_op7_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = db.execute(contract.oracle_sql()["op7_line_frequency"])
    names = [c[0] for c in found.description]
    want = sorted(map(str, ({n: row[names.index(n)] for n in sorted(names)} for row in found.fetchall())))
    got = sorted(str({n: r[n] for n in sorted(names)}) for r in rows(spark, "op7_line_frequency"))
    assert got == want


def test_op8(spark, texts):
    got = rows(spark, "op8_simhash")
    fps = np.array([int(r.fingerprint, 16) for r in got], np.uint64)
    ids = [r.doc_id for r in got]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    assert sorted(ids) == sorted(texts) and all(r.component_id == least[root(i)] for i, r in enumerate(got))


def test_op9(spark):
    # A model needs more texts than the other queries: the next larger tables.
    larger = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in contract.queries()["op9_domain_score"](spark, larger).collect()}
    assert len(got) == spark.read.parquet(f"{larger}/documents.parquet").count()
    labels = spark.read.parquet(f"{larger}/labels.parquet").collect()
    good = [got[r.doc_id].score for r in labels if r.quality == 1]
    bad = [got[r.doc_id].score for r in labels if r.quality == 0]
    assert sum(a > b for a in good for b in bad) > 0.8 * len(good) * len(bad)


def test_op10(spark, given, texts):
    got = {r.doc_id: r for r in rows(spark, "op10_toxicity")}
    assert len(got) == len(texts)
    assert all(r.held_out == (crc_group(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    clean = [got[r.doc_id].predicted for r in given["labels"] if not r.toxic]
    assert sum(clean) <= 0.02 * len(clean)


def test_pipeline_stages(spark, given, texts):
    """Each stage on what its predecessor kept, against what its operator reports."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = (docs, out)
        docs = out
    kept = {r.doc_id for r in rows(spark, "op6_line_labels") if r.kept}
    first = {r.doc_id: r.text for r in seen["quality"][1].collect()}
    assert first == {i: t for i, t in texts.items() if i in kept}

    hosts = {r.doc_id: r.source for r in given["documents"]}
    pages, on = defaultdict(set), defaultdict(set)
    for i, text in first.items():
        pages[hosts[i]].add(text)
        for line in text.split("\n"):
            if WORD.search(line):
                on[hosts[i], line].add(text)

    def freed(i, text):
        bad = lambda line: len(on[hosts[i], line]) >= line_frequency.MIN_PAGES and len(on[hosts[i], line]) / len(pages[hosts[i]]) > line_frequency.MAX_RATIO
        return "\n".join(line for line in text.split("\n") if not bad(line))

    second = {r.doc_id: r.text for r in seen["line_dedup"][1].collect()}
    assert second == {i: freed(i, t) for i, t in first.items()}

    from corpuskit.llm.simhash import fingerprint

    third = {r.doc_id for r in seen["near_dedup"][1].collect()}
    prints = {i: fingerprint(t.encode()) for i, t in second.items()}
    groups = {}
    for i in sorted(prints):
        near = {groups[j] for j in groups if (prints[i] ^ prints[j]).bit_count() <= 4}
        own = min(near, default=i)
        groups[i] = own
        groups = {j: own if g in near else g for j, g in groups.items()}
    assert third == {i for i, g in groups.items() if i == g}

    fourth = {r.doc_id for r in seen["decontamination"][1].collect()}
    copying = {i for i in third for b in given["benchmark"] if b.text in second[i]}
    assert fourth <= third and not (fourth & copying) and len(third - fourth) <= len(copying) + 3

    packed = seen["packing"][1].collect()
    assert {r.doc_id for r in packed} == fourth
    assert {(r.doc_id, r.doc_tokens) for r in packed} == {(i, n) for i, n in ((r.doc_id, sum(x.length for x in packed if x.doc_id == r.doc_id)) for r in packed)}


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
