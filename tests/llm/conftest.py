import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """documents(rows): rows of (doc_id, text) with the table's other columns, and
    extra ones whose names clash with those that operators use inside."""

    def make(rows, lang="en", source="a"):
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t in rows]
        frame = spark.createDataFrame(full, SCHEMA)
        for name in ("id", "key", "fp", "row", "line", "host", "score", "kept", "start", "words", "page", "pages", "slot", "target", "n"):
            frame = frame.selectExpr("*", f"'x' AS `{name}`")
        return frame

    return make


WORDS = (
    "harbour lantern meadow copper thistle window ribbon granite velvet orchard compass needle saddle timber willow anchor "
    "candle feather marble pocket river shadow silver summit tunnel valley wagon winter yellow zephyr basket bridge"
).split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words without repeated three-word windows."""
    import random

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) if rng.random() < 0.4 else rng.choice(WORDS) for _ in range(n))

    return make
