"""Near copies against all pairs."""

import random

import pytest
from lumenpage.llm import near_copies as N


def made(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(60, 160))]
        for c in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 14)):
                i = rng.randrange(len(t))
                rng.choice([lambda: t.insert(i, rng.choice(words)), lambda: t.pop(i), lambda: t.__setitem__(i, rng.choice(words))])()
            rows.append((len(rows), rng.choice(["Title", None, ""]), " ".join(t)))
    same = " ".join(words[:80])
    rows += [(1000 + i, None, same) for i in range(12)] + [(2000, "x", None), (2001, None, "short text"), (2002, None, "")]
    return rows


@pytest.fixture(scope="module")
def df(spark):
    rows = made()
    return spark.createDataFrame([(*r, "clash") for r in rows + rows[:20]], "doc_id long, title string, text string, symbols string")


def brute(rows, words, least, similarity):
    sets = {i: s for i, a, t in rows if (s := N.shingle_set(a, t, words, least, N._Hashes())) is not None}
    out = {}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j:
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                r = len(a & b) / len(a | b)
                if r >= similarity:
                    out[i, j] = r
    return out


def test_pairs(spark, df):
    want = brute(made(), 3, 50, 0.5)
    got = {(r.a, r.b) for r in N.similar_pairs(df, "doc_id", "title", "text", words=3, similarity=0.5, least_words=50).collect()}
    assert not got - set(want) and not {k for k, r in want.items() if r >= 0.6} - got and len(set(want) - got) <= 0.01 * len(want)


def test_groups(spark, df):
    rows = N.similar_groups(df, "doc_id", "title", "text", least_words=50).collect()
    want = brute(made(), 5, 50, 0.8)
    group = {r.doc_id: r.group_id for r in rows}
    assert len(group) == len(rows)
    label = {i: i for i in group}
    changed = True
    while changed:
        changed = False
        for i, j in want:
            m = min(label[i], label[j])
            if (label[i], label[j]) != (m, m):
                label[i] = label[j] = m
                changed = True
    assert group == label
    assert {r.class_id for r in rows if 1000 <= r.doc_id < 1012} == {1000}


def test_groups_hold_all_pairs(spark, sf_dir):
    """No pair that p2_found lists is parted by p2_groups."""
    from lumenpage.llm import queries as Q

    group = {r.doc_id: r.group_id for r in Q.p2_groups(spark, sf_dir).collect()}
    pairs = Q.p2_found(spark, "/root/testdata/sf0.001").collect()
    assert pairs and all(group[r.doc_id_a] == group[r.doc_id_b] for r in pairs)


def test_long_chain(spark):
    """300 revisions, each alike only to the next, under shuffled ids: one group."""
    words, ids = [f"c{i}" for i in range(3100)], random.Random(5).sample(range(10_000), 300)
    rows = [(n, None, " ".join(words[10 * i : 10 * i + 100])) for i, n in enumerate(ids)]
    got = N.similar_groups(spark.createDataFrame(rows, "doc_id long, title string, text string"), "doc_id", "title", "text").collect()
    assert sorted(r.n_links for r in got) == [1, 1] + [2] * 298
    assert {r.doc_id: r.group_id for r in got} == dict.fromkeys(ids, min(ids))


def test_empty(spark, df):
    assert N.similar_pairs(df.limit(0), "doc_id", "title", "text").count() == 0
    assert N.similar_groups(df.limit(0), "doc_id", "title", "text").count() == 0
