"""Line labels (6) and site-relative line frequency (7)."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpuskit.llm import line_frequency, line_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def odd_texts():
    rng = random.Random(3)
    signs = ["ab", "c", "é", "漢字", "#", "*x", "\n", "\n", " ", "\t", " ", "\x0b", "!", "7", " ", "A B"]
    return ["".join(rng.choice(signs) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 120))) for _ in range(150)]


def test_base_counts_equal_a_plain_count(docs):
    texts = [None, "", " ", "\n\n", "a b c a b c", *odd_texts(), "long " * 300_000 + "\nend"]
    rows = list(enumerate(texts)) + [(1, ""), (4, "a b c a b c")]
    got = line_labels.label_lines(docs(rows), line_labels.LineModel()).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(1)
    model = line_labels.LineModel(transition=((0.4, -0.7), (-0.2, 0.9)), start=(0.1, -0.3))
    counts = np.array([1, 5, 0, 8, 3])
    scores = rng.normal(size=counts.sum())
    got = line_labels.decode(scores, counts, model)
    at = 0
    for n in counts:
        own = scores[at : at + n]

        def value(path):
            total = model.start[path[0]] + path[0] * own[0]
            return total + sum(model.transition[a][b] + b * s for a, b, s in zip(path, path[1:], own[1:]))

        if n:
            assert value(tuple(got[at : at + n].astype(int))) == max(map(value, itertools.product((0, 1), repeat=int(n))))
        at += n


def test_trained_chain_parts_content_from_junk(spark, docs, prose):
    good = [(i, "\n".join(prose(i * 9 + k, 30) + "." for k in range(4))) for i in range(60)]
    junk = [(100 + i, "\n".join(" ".join(w + "###" for w in prose(i * 7 + k, 30).split()) for k in range(4))) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:40]] + [(i, 0) for i, _ in junk[:40]] + [(5, None)], "doc_id long, quality int")
    frame = docs(good + junk)
    model = line_labels.train(frame, labels)
    kept = {r.doc_id: r.kept for r in line_labels.label_lines(frame, model).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in junk)
    left = line_labels.keep_content(frame, model)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {i for i, _ in good}
    assert line_labels.train(frame, labels.where("false")) == line_labels.LineModel()


def test_empty_table(docs):
    assert line_labels.label_lines(docs([]), line_labels.LineModel()).collect() == []
    assert line_frequency.drop_boilerplate(docs([]), F.col("source")).collect() == []


def test_lines_on_many_pages_of_a_host_go(spark, docs):
    rows = [(i, f"menu\nbody {i}\n\n  \nmenu") for i in range(40)] + [(100, "menu"), (101, None), (102, ""), (0, "menu\nbody 0\n\n  \nmenu")]
    frame = docs(rows).unionByName(docs([(200 + i, f"menu\ntext {i}") for i in range(3)], source=None))
    got = line_frequency.drop_boilerplate(frame, F.col("source"), max_ratio=0.5, min_pages=5)
    assert got.columns == frame.columns + ["dropped_lines"]
    found = sorted((r.doc_id, r.text, tuple(r.dropped_lines)) for r in got.collect() if r.text is not None)
    want = [(i, f"body {i}\n\n  ", (0, 4)) for i in [0, *range(40)]] + [(100, "", (0,)), (102, "", ())] + [(200 + i, f"menu\ntext {i}", ()) for i in range(3)]
    assert found == sorted(want)
    assert got.where("text IS NULL").count() == 1


def test_copies_of_a_page_are_one_page(docs):
    rows = [(i, "same page\nwith two lines") for i in range(30)] + [(100 + i, f"other {i}") for i in range(30)]
    got = line_frequency.drop_boilerplate(docs(rows), F.col("source"), max_ratio=0.1, min_pages=2)
    assert all(r.dropped_lines == [] for r in got.collect())


def test_hosts():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    urls = [("https://www.Example.org:8080/a?b", "example.org"), ("http://u:p@news.example.org", "news.example.org"), ("//cdn.x/y", "cdn.x"), ("nothing", ""), (None, None)]
    got = [r[0] for r in spark.createDataFrame(urls, "url string, host string").select(line_frequency.url_host(F.col("url"))).collect()]
    assert got == [h for _, h in urls]


def test_training_reads_late_lines_too(spark, docs, prose):
    """Both labels begin alike for 300 lines; only later lines tell them apart."""
    def text(i, junk):
        late = "BUY $$$ NOW ### !!!" if junk else prose(7000 + i, 8) + "."
        return "\n".join([prose(i, 8) for i in range(300)] + [late] * (3000 if junk else 1) + [prose(8000 + 50 * i + k, 8) + "." for k in range(0 if junk else 3000)])

    frame = docs([(i, text(i, i % 2 == 1)) for i in range(6)])
    labels = frame.selectExpr("doc_id", "CAST(1 - doc_id % 2 AS INT) AS quality")
    model = line_labels.train(frame, labels)
    symbols = [model.emission[i] for i, name in enumerate(line_labels.FEATURES) if name == "symbols over 0.1 a word"]
    assert symbols[0] < -0.5


def test_a_text_of_very_many_lines(spark):
    lines = [f"own {i}" if i % 2 else f"menu {i}" for i in range(60_000)]
    rows = [(i, "\n".join([*lines, f"page {i}"])) for i in range(2)]
    rows += [(2 + i, "\n".join([*lines[::2], "", f"page {i}", ""])) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    started = time.monotonic()
    got = {r["doc_id"]: r for r in line_frequency.drop_boilerplate(docs, F.lit("h"), max_ratio=0.5).collect()}
    assert time.monotonic() - started < 60
    assert got[0]["text"] == "\n".join([*lines[1::2], "page 0"]) and got[0]["dropped_lines"] == list(range(0, 60_000, 2))
    assert got[5]["text"] == "\npage 3\n" and got[5]["dropped_lines"] == list(range(30_000))
