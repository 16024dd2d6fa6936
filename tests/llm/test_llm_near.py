"""SimHash (8), components and benchmark decontamination (2)."""

import random

import numpy as np
import pytest
import xxhash

from corpuskit.llm import components, decontamination, simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints(prose):
    for text in ["", " \n", "one", "One two THREE", "a b c d", "É b  c\td e", prose(1, 70), "x " * 70_000]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_links_find_what_all_pairs_find(spark):
    rng = random.Random(5)
    fps = {0}
    for _ in range(40):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(rng.choice([0, 1, 4, 40])):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))))
    fps = sorted(fps)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4]
    want = classes(near, fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    for count, block in ((len(fps), 8192), (10**5, 8), (10**9, 8192)):  # other plans, split meetings
        got = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(frame, count, block=block).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in got)
        assert classes(got, fps) == want


def test_every_plan_covers_the_distance():
    for count in (1, 10**4, 10**6, 10**8, 10**10):
        plan = simhash.segments(count)
        assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for _, _, r in plan) == simhash.DISTANCE + 1


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    want = classes(pairs, {x for p in pairs for x in p})
    rows = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {x: want[x] for p in pairs if p[0] != p[1] for x in p}
    assert len(rows) == len({r.node for r in rows})
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(docs, prose):
    long = prose(1, 400)
    rows = [(9, long), (4, long + " tail"), (7, long), (7, long), (3, None), (8, ""), (5, " \n"), (6, prose(2, 80)), (None, prose(3, 80))]
    got = simhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows}
    for r in got:
        assert int(r.fingerprint, 16) == plain_fingerprint(texts[r.doc_id]) and len(r.fingerprint) == 16
    found = {r.doc_id: r.component_id for r in got}
    assert found[3] == found[5] == found[8] == 3 and found[6] == 6 and found[None] is None
    near = (plain_fingerprint(long) ^ plain_fingerprint(long + " tail")).bit_count() <= 4
    assert found[9] == found[7] == (4 if near else 7)
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted({-1, 3, 6, found[7], found[4]})
    assert simhash.near_duplicates(docs([])).collect() == [] and simhash.keep_one(docs([])).collect() == []


def plain_alignment(a, b):
    best, h = 0, [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_scores():
    rng = np.random.default_rng(4)
    passages = [rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64) for _ in range(80)]
    items = [rng.integers(0, 6, rng.integers(0, 20)).astype(np.uint64) for _ in range(80)]
    score, start, stop = decontamination.align(passages, items)
    for a, b, s, x, y in zip(passages, items, score, start, stop):
        assert s == plain_alignment(a, b)
        assert plain_alignment(a[x:y], b) == s


def test_copies_of_items_are_found(spark, docs, prose):
    items = {i: prose(1000 + i, 30) for i in range(20)}
    items[50] = "so short"
    edited = items[3].split()
    for k in range(4, 30, 7):
        edited[k] = "changed"
    del edited[10]
    filler = [(i, prose(i, 200)) for i in range(60)]
    rows = filler + [
        (100, prose(7, 90) + " " + items[1] + " " + prose(8, 90)), (101, " ".join(edited)), (102, items[2].upper().replace(" ", " -- ")),
        (103, None), (104, ""), (105, (prose(9, 3000) + " " + items[5] + " ") * 3), (100, prose(7, 90) + " " + items[1] + " " + prose(8, 90)),
    ] + [(200 + i, items[6] + f" copy {i}") for i in range(80)]
    table = spark.createDataFrame([*items.items(), (51, None), (1, items[1])], "item_id long, text string")
    got = {(r.id, r.item_id): r for r in decontamination.matches(docs(rows), table).collect()}
    want = {(100, 1), (101, 3), (102, 2), (105, 5)} | {(200 + i, 6) for i in range(80)}
    assert set(got) == want
    assert got[100, 1].score == 1.0 and (got[100, 1].first_word, got[100, 1].last_word) == (90, 120)
    assert 0.5 < got[101, 3].score < 1
    left = decontamination.drop_contaminated(docs(rows), table)
    assert sorted(r.doc_id for r in left.collect()) == sorted([i for i, _ in filler] + [103, 104])
    assert left.columns == docs(rows).columns
    assert decontamination.matches(docs([]), table).collect() == [] and decontamination.matches(docs(rows), table.where("false")).collect() == []


@pytest.mark.parametrize("copies", [1, 30])
def test_edited_copies_are_found_whatever_their_number(spark, docs, prose, copies):
    """Edits may break most of an item's n-grams: those left are as common as the
    copies are."""
    items = {i: prose(2000 + i, 30) for i in range(4)}
    rows = [(i, prose(i, 60)) for i in range(20)]
    for edits in (5, 6, 7, 8):
        parts = items[edits - 5].split()
        for k in range(edits):
            parts[(k + 1) * 30 // (edits + 1)] = "changed"
        rows += [(1000 * edits + i, " ".join(parts)) for i in range(copies)]
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.id, r.item_id) for r in decontamination.matches(docs(rows), table).collect()}
    assert got == {(1000 * edits + i, edits - 5) for edits in (5, 6, 7, 8) for i in range(copies)}


def test_parts_of_long_items_and_short_items_are_found(spark, docs, prose):
    items = {1: prose(3001, 59), 2: prose(3002, 500), 3: "Zanzibar", 4: "quick zebras", 5: prose(3005, 59)}
    cut = {i: items[i].split() for i in (1, 2, 5)}
    rows = [(i, prose(i, 80)) for i in range(10)] + [
        (101, prose(51, 40) + " " + " ".join(cut[1][20:40]) + " " + prose(52, 40)), (102, prose(53, 40) + " " + " ".join(cut[2][100:300])),
        (103, "from zanzibar, by sea"), (104, prose(54, 9) + " Quick -- zebras!"), (105, "zebras quick"), (106, " ".join(cut[5][:10])),
    ]
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.id, r.item_id): r for r in decontamination.matches(docs(rows), table).collect()}
    assert set(got) == {(101, 1), (102, 2), (103, 3), (104, 4)}
    assert got[103, 3].score == got[104, 4].score == 1.0 and (got[104, 4].first_word, got[104, 4].last_word) == (9, 11)


def test_common_seeds_alone_do_not_align(spark, docs, monkeypatch):
    """Texts and items that share common n-grams are not aligned for them; the results
    are those of an alignment of all texts with all items that share an n-gram."""
    rng = random.Random(21)
    common = ["one of the", "as well as", "in order to", "the end of"]

    def words(n, tag):
        return " ".join(f"{tag}{rng.randrange(10**6)}" if i % 9 else rng.choice(common) for i in range(n))

    tests = [(i, " ".join(rng.choice(common) if j == 4 else f"t{i}x{j}" for j in range(20))) for i in range(500)]
    rows = [(i, f"{words(20, 'd')} {rng.choice(common)} {words(20, 'e')}") for i in range(2000)]
    for i in range(0, 400, 4):
        copy = tests[i][1].split()
        for at in (6, 12):
            copy[at] = "changed"
        rows.append((5000 + i, f"{words(15, 'f')} {' '.join(copy)} {words(9, 'g')}"))
    rows += [(9000 + i, f"so it is {tests[7][1].replace('t7x10', 'new').replace('t7x15', 'other')} {i}") for i in range(60)]
    table = spark.createDataFrame(tests, "item_id long, text string")
    seen, plain = [], decontamination.scored
    monkeypatch.setattr(decontamination, "scored", lambda pairs, *kinds: seen.append(pairs.count()) or plain(pairs, *kinds))
    got = {(r.id, r.item_id) for r in decontamination.matches(docs(rows), table).collect()}
    assert got == {(5000 + i, i) for i in range(0, 400, 4)} | {(9000 + i, 7) for i in range(60)}
    assert seen[0] < 1.2 * len(got)


def test_items_without_an_id_are_found(spark, docs, prose):
    table = spark.createDataFrame([(None, prose(3, 30)), (4, prose(4, 30))], "item_id long, text string")
    frame = docs([(1, prose(3, 30)), (2, prose(4, 30)), (3, prose(5, 30))])
    assert {(r.id, r.item_id) for r in decontamination.matches(frame, table).collect()} == {(1, None), (2, 4)}
    assert [r.doc_id for r in decontamination.drop_contaminated(frame, table).collect()] == [3]


def test_bit_maps_travel_compressed(spark):
    grams = spark.range(1000).selectExpr("xxhash64(id) AS gram")
    packed, bits = decontamination.bit_map(grams)
    assert len(packed) * 4 < (1 << bits) // 8
    held = np.array([r.gram for r in grams.collect()], np.int64).view(np.uint64)
    found = decontamination._unpacked(packed)
    assert len(found) == (1 << bits) // 8 and decontamination._in_map(held, found, bits).all()
    assert decontamination._in_map(held + np.uint64(1), found, bits).sum() < 20
