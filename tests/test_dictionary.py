"""Stems as column expressions, against the word-by-word form, and searches by them."""

from pyspark.sql import functions as F

from corpuskit.functions.analyzer import english
from corpuskit.functions.porter2 import stem
from corpuskit.operators import dictionary, inverted
from corpuskit.operators.lexical import lexical_top_k, matches, postings, with_tokens
from test_inverted import asked, corpus, rows

WORDS = """caresses ponies ties cries gas gaps kiwis cats feed agreed agreedly plastered bled motoring sing hopping hoping falling hissing failing filing conflated
troubled sized happy sky enjoy dying news inning proceed relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli
analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize
electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption
homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generous generically communities arsenal yes youth
boyish sayings by y ayy yy archaeology apologi geologi quickli fluently a is us ss s skis idly ugly early only exceed succeeds outings herrings été über straße
42nd x86 flies fly flying abilities knightly rapidity""".split()


def test_rules_give_the_same_stems_as_word_by_word(spark):
    words = [w for w in WORDS if w not in ("ayy", "yy")] + ["".join((a, b)) for a in ("relat", "hop", "happ", "y", "bey", "try") for b in ("ed", "ing", "ies", "s", "ational", "fulness", "ness", "ement", "li", "e", "ll")]
    frame = spark.createDataFrame([(w,) for w in words], "term string")
    assert {r["term"]: r["stem"] for r in dictionary.stems(frame).collect()} == {w: stem(w) for w in words}


def test_a_y_marks_one_sign(spark):
    got = dictionary.stems(spark.createDataFrame([("sayyid",), ("yes",)], "term string")).collect()
    assert {r["term"]: r["stem"] for r in got} == {"sayyid": "sayyid", "yes": "yes"}


def test_a_dictionary_grows_by_what_it_lacks(spark):
    def words(*names):
        return spark.createDataFrame([(n,) for n in names], "term string")

    path = dictionary.build(words("running", "flies"))
    dictionary.grow(path, words("flies", "runs", "running"))
    dictionary.grow(path, words())
    assert sorted((r["term"], r["stem"]) for r in spark.read.parquet(path).collect()) == [("flies", "fli"), ("running", "run"), ("runs", "run")]


def test_postings_of_stems(spark):
    chunks = corpus(spark)
    tokens = with_tokens(chunks)
    table = spark.read.parquet(dictionary.build(dictionary.terms_of(tokens)))
    got = dictionary.stemmed(postings(tokens), table)
    assert rows(got, "id", "term", "pos") == rows(postings(chunks, english), "id", "term", "pos")


def test_one_index_serves_plain_and_english_searches(spark, monkeypatch):
    monkeypatch.setattr(inverted, "FIRST_BLOCKS", 2)
    chunks, queries = corpus(spark), asked(spark)
    index = inverted.build(chunks, block_documents=40)
    table = spark.read.parquet(dictionary.build(inverted.words(index, spark)))
    stored = inverted.english_queries(index, queries, table)
    assert rows(inverted.matches(index, stored), "query_id", "id", "score") == rows(matches(chunks, queries, english), "query_id", "id", "score")
    assert rows(inverted.top_k(index, stored, 3), "query_id", "rank", "id") == rows(lexical_top_k(chunks, queries, 3, english), "query_id", "rank", "id")
    assert any(r["query_id"] == 60 for r in inverted.top_k(index, stored, 3).collect())
