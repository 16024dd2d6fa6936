"""Language mixtures (1), domain scores (9) and toxicity (10)."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from corpuskit.llm import domain_score, language_mixture, toxicity
from corpuskit.llm.arrays import text_slices

SYLLABLES = {"xa": ["tha", "ing", "er", "on", "st"], "yb": ["ón", "eza", "que", "los", "mi"], "zc": ["sch", "pf", "ung", "keit", "ü"]}


def speech(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(docs):
    frames = [docs([(k * 100 + i, speech(lang, i, 60)) for i in range(25)], lang=lang) for k, lang in enumerate(SYLLABLES)]
    frames.append(docs([(900, speech("xa", 1, 50)), (901, None)], lang=None))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return language_mixture.learn(out)


def test_languages_are_told_apart(docs, languages):
    assert languages.languages == tuple(SYLLABLES)
    rows = [(k * 10 + i, speech(lang, 500 + i, 20 + 60 * i)) for k, lang in enumerate(SYLLABLES) for i in range(5)]
    rows += [(100, speech("xa", 9, 300) + " " + speech("zc", 9, 100)), (101, None), (102, ""), (103, "12 34 !?"), (104, "—… “”"), (0, rows[0][1]), (105, speech("yb", 3, 60_000))]
    got = language_mixture.identify(docs(rows), languages).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, lang in enumerate(SYLLABLES):
        for i in range(5):
            assert by[k * 10 + i].lang_pred == lang and by[k * 10 + i].languages == [lang] and by[k * 10 + i].score == 1.0
    assert by[100].languages == ["xa", "zc"] and abs(by[100].score - 0.75) < 0.03 and by[105].lang_pred == "yb"
    for i in (101, 102, 103, 104):
        assert (by[i].lang_pred, by[i].score, by[i].languages) == ("und", 0.0, [])
    assert language_mixture.identify(docs([]), languages).collect() == []


def test_no_labels_no_language(docs):
    assert language_mixture.learn(docs([(1, "a")], lang=None)) is None
    got = language_mixture.identify(docs([(1, "a b"), (2, None)]), None).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2


def test_ngram_counts_equal_a_plain_count():
    texts = ["Abc déf", "", "aa  aa\nb", "x"]
    for first, last, data, offsets in text_slices(language_mixture.lowered(pa.array(texts))):
        grams, starts, ends = language_mixture.word_grams(data, offsets)
        again = {}
        for s, e in zip(starts, ends):
            for i in range(s, e):
                history = bytes(data[max(s, i - 2) : i + 1]).rjust(3)
                assert again.setdefault(history, grams[i]) == grams[i]
        assert len(set(again.values())) == len(again)


def test_mixture_reaches_the_best_proportions():
    rng = np.random.default_rng(8)
    logs = rng.normal(size=(60, 2))
    share, sets = language_mixture.proportions(logs, np.array([0, 60]))
    assert share[0].tolist() == [0, 0]

    def value(p):
        return sum(math.log(p * math.exp(a) + (1 - p) * math.exp(b)) for a, b in logs)

    if sets[1].all():
        assert value(share[1, 0]) > max(value(p) for p in np.linspace(0, 1, 101)) - 0.05
    else:
        assert value(float(sets[1, 0])) + 0.5 * math.log(60) > max(value(p) for p in np.linspace(0, 1, 101)) - 0.05


def test_domain_scores(spark, docs, prose):
    good = [(i, prose(i, 80)) for i in range(80)]
    other = [(100 + i, " ".join(w[::-1] for w in prose(i + 700, 80).split())) for i in range(80)]
    frame = docs(good + other + [(300, None), (301, ""), (0, good[0][1])])
    named = frame.where("doc_id < 40")
    got = {r.doc_id: r for r in domain_score.score(frame, named).collect()}
    fresh = [got[i].score for i in range(40, 80)]
    assert min(fresh) > max(got[100 + i].score for i in range(80))
    assert got[300].n_words == got[301].n_words == 0 and got[300].score == 0.0
    assert abs(got[1].score - (got[1].background_loss - got[1].target_loss)) < 1e-9
    assert domain_score.score(frame.where("false"), named).collect() == []
    assert len(domain_score.score(frame, named.where("false")).collect()) == 163


@pytest.fixture(scope="module")
def toxic_rows(prose):
    bad = ["idiot", "stupid", "moron", "scumbag"]
    rng = random.Random(4)

    def taint(text, words):
        parts = text.split()
        for w in words:
            parts.insert(rng.randrange(len(parts)), w)
        return " ".join(parts)

    toxic = [(i, taint(prose(i, 60), rng.sample(bad, 3))) for i in range(60)]
    clean = [(100 + i, prose(900 + i, 60)) for i in range(120)]
    return toxic, clean


@pytest.fixture(scope="module")
def toxic_model(spark, docs, toxic_rows):
    toxic, clean = toxic_rows
    labels = spark.createDataFrame([(i, 1) for i, _ in toxic[:40]] + [(i, 0) for i, _ in clean[:80]] + [(150, None)], "doc_id long, toxic int")
    frame = docs(toxic + clean)
    return toxicity.learn(frame, labels, toxicity.learn_characters(frame))


def test_disguised_words_are_restored(toxic_model):
    for word, want in [("1d10t", "idiot"), ("stup1d", "stupid"), ("mooooron", "moron"), ("s.t.u.p.i.d", "stupid"), ("$cumbag", "scumbag"), ("idiooot", "idiot")]:
        assert toxicity.decode(word, toxic_model.characters) == want
    text = "an 1D10T and s t u p i d m-o-r-o-n!! 12 a b"
    for _, _, data, offsets in text_slices(toxicity.lowered(pa.array([text, "", "q"]))):
        data, offsets = toxicity.restore(data, offsets, toxic_model.characters, {})
        assert data.tobytes() == b"an idiot and stupid moron!! 12 a bq"
        assert offsets.tolist() == [0, 34, 34, 35]


def test_decoding_is_the_best_spelling(toxic_model):
    model = toxic_model.characters
    for word in ["1d10t", "b00k", "loooser", "5t@ff"]:
        def value(path):
            total, a, b = 0.0, 0, 0
            for text, weight in path:
                total += weight
                for c in text.encode() or b"":
                    total += model.log(a, b, c)
                    a, b = b, c
            return total + model.log(a, b, 0)

        best = max(itertools.product(*toxicity.lattice(word)), key=value)
        assert "".join(t for t, _ in best) == toxicity.decode(word, model)


def test_toxic_texts_score_high(docs, toxic_rows, toxic_model):
    toxic, clean = toxic_rows
    hidden = [(500, toxic[50][1].replace("i", "1").replace("o", "0")), (501, None), (502, ""), (503, "x" * 100_000), (0, toxic[0][1])]
    got = toxicity.score(docs(toxic + clean + hidden), toxic_model).collect()
    assert len(got) == len(toxic) + len(clean) + len(hidden)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == 1 for i, _ in toxic) and all(by[i].predicted == 0 for i, _ in clean)
    assert by[500].predicted == 1 and by[501].score == by[502].score < 0.7
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.score(docs([]), toxic_model).collect() == []


def test_no_labels(spark, docs):
    frame = docs([(1, "some text"), (2, None)])
    model = toxicity.learn(frame, spark.createDataFrame([], "doc_id long, toxic int"), toxicity.learn_characters(frame))
    assert [r.score for r in toxicity.score(frame, model).collect()] == [0.5, 0.5]


@pytest.mark.parametrize("range_bytes", [50_000, 1 << 25])
def test_domain_scores_equal_a_plain_model_over_all_words(docs, range_bytes):
    """More words than 2^15 and many blocks: every word and pair has its own count."""
    from collections import Counter

    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(60_000)}" if rng.random() < 0.8 else rng.choice("abc") for _ in range(1000)) for _ in range(70)]
    texts += ["a b a b, a b", "w1", ""]
    pairs = [list(zip(["", *(w := t.replace(",", " ,").split())], w)) for t in texts]
    good = set(range(0, 73, 3))
    kinds = (lambda p: p, lambda p: p[1], lambda p: (p[0],))
    model = [[Counter(k(p) for i, ps in enumerate(pairs) if side == 0 or i in good for p in ps) for k in kinds] for side in (0, 1)]
    total = [sum(m[1].values()) for m in model]
    width = len(model[0][1]) + 1
    assert width > 35_000
    frame = docs(list(enumerate(texts)))
    got = {r.doc_id: r for r in domain_score.score(frame, frame.where("doc_id % 3 = 0"), block_bytes=20_000, range_bytes=range_bytes).collect()}
    assert len(got) == len(texts)
    for i, ps in enumerate(pairs):
        want = []
        for side in (0, 1):
            mine = [Counter(k(p) for p in ps) if side == 0 or i in good else Counter() for k in kinds]
            mass, loss = domain_score.MASS * (max(total[0] / total[1], 1) if side == 0 else 1), 0.0
            for p in ps:
                pair, word, before = (m[k(p)] - own[k(p)] for m, own, k in zip(model[side], mine, kinds))
                alone = (word + mass) / (max(total[side] - sum(mine[1].values()), 1) + mass * width)
                loss -= math.log((pair + mass * alone) / (max(before, pair) + mass))
            want.append(loss / max(len(ps), 1))
        assert got[i].n_words == len(ps)
        assert math.isclose(got[i].background_loss, want[0], abs_tol=1e-9) and math.isclose(got[i].target_loss, want[1], abs_tol=1e-9)


def test_domain_score_places_words_and_the_words_before_them_by_one_sort():
    data = np.frombuffer(b"a b a,a" + b"b a" + b"" + b"c", np.uint8)
    counts, _, words, history = domain_score.keyed(data, np.array([0, 7, 10, 10, 11]))
    assert counts.tolist() == [5, 2, 0, 1]
    known, place, before = domain_score._placed_words(words, history)
    assert known[0] == domain_score.START and (known[:-1] < known[1:]).all() and len(known) == 5
    assert (known[place] == words).all() and (known[before] == history).all()
    assert [len(x) for x in domain_score._placed_words(words[:0], history[:0])] == [0, 0, 0]


def restored(text, model):
    (_, _, data, offsets), = text_slices(toxicity.lowered(pa.array([text])))
    return toxicity.restore(data, offsets, model, {})[0].tobytes().decode()


@pytest.fixture(scope="module")
def spoken(docs, toxic_rows, prose):
    toxic, clean = toxic_rows
    more = [(3000 + i, f"you are a {prose(4000 + i, 3)} and y {prose(5000 + i, 3)} o") for i in range(60)]
    return toxicity.learn_characters(docs(toxic + clean + more))


def test_words_behind_one_letter_words_are_restored(spoken):
    for text, want in [
        ("You are a s t u p i d one", "you are a stupid one"), ("y o u i d i o t", "you idiot"), ("y o i d i o t", "y o idiot"),
        ("so 1 d 1 0 t.", "so idiot."), ("a $ t u p 1 d m o r o n!", "a stupid moron!"), ("(y o u a r e a m o r o n)", "(you are a moron)"),
        ("1 2 3 4", "1 2 3 4"), ("a\ns t u p i d", "a stupid"), ("a-s-t-u-p-i-d", "a stupid"),
    ]:
        assert restored(text, spoken) == want


def test_disguises_of_any_length_are_restored(spoken):
    assert restored("st" + "u" * 60 + "p1d", spoken) == "stupid"
    sentence = "you are a stupid moron and a scumbag you are y idiot and a moron " * 40
    assert restored(" ".join(sentence.replace(" ", "")), spoken) == sentence.strip()
    assert restored("x" * 200_000 + " 1d10t", spoken).endswith(" idiot")
