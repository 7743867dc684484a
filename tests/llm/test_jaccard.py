import random
from fractions import Fraction

import numpy as np
import pytest
from strayframe.llm import jaccard
from strayframe.llm.graph import components


def sets_of(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(texts, n, t):
    sets = [sets_of(x, n) for x in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * t.denominator >= len(sets[i] | sets[j]) * t.numerator:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i)) for i in range(len(sets))]


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(size)] for size in (4, 5, 6, 7, 9, 12, 20, 24, 25, 30, 60, 120, 300) for _ in range(3)]
    shared = [rng.choice(words) for _ in range(40)]
    texts = []
    for b in base:
        for k in range(5):
            x = list(b)
            for _ in range(rng.randrange(0, max(2, len(x) // 25 + k))):
                x[rng.randrange(len(x))] = rng.choice(words)
            texts.append(" ".join(x + (shared if rng.random() < 0.2 else [])))
    hot = [rng.choice(words) for _ in range(80)]
    texts += [" ".join(hot + [f"t{k % 9}"]) for k in range(40)] + ["Same  TEXT here\tnow", "same text here now"] + [None, "", "  ", "one", "ONE", "two words"]
    return texts


@pytest.mark.parametrize(("n", "t"), [(4, Fraction(85, 100)), (5, Fraction(8, 10))])
def test_components_against_all_pairs(docs_of, n, t):
    texts = corpus(n)
    rows = jaccard.near_copies(docs_of(texts, extra=True), n=n, similarity=t).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in rows] == brute(texts, n, t)


def group(seed, many, size, changes):
    """Near copies of one text, each with its own few changes, so that many pairs lie on either side of the threshold."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for k in range(many):
        x = list(base)
        for _ in range(rng.randrange(changes)):
            at, kind = rng.randrange(len(x)), rng.randrange(4)
            if kind == 0:
                x[at] = f"n{rng.randrange(10**6)}"
            elif kind == 1:
                x[at] = f"c{rng.randrange(3)}"  # a change that others make, too
            elif kind == 2:
                del x[at : at + rng.randrange(1, 4)]
            else:
                x += [f"a{rng.randrange(20)}"] * rng.randrange(1, 3)
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize(("n", "t", "short", "apart", "rounds"), [(4, Fraction(85, 100), 16, 64, 4), (4, Fraction(85, 100), 3, 4, 4), (5, Fraction(8, 10), 2, 2, 1)])
def test_long_lists_against_all_pairs(docs_of, monkeypatch, n, t, short, apart, rounds):
    for name, value in (("SHORT", short), ("SHORT_APART", apart), ("ROUNDS", rounds)):
        monkeypatch.setattr(jaccard, name, value)
    texts = group(n, 120, 90, 7) + group(n + 1, 60, 40, 4) + group(n + 2, 30, 200, 12)
    passage = " ".join(f"p{k}" for k in range(30))
    texts += [passage + " " + " ".join(f"u{k}x{j}" for j in range(4)) for k in range(40)]  # one list of unlike sets
    rows = jaccard.near_copies(docs_of(texts), n=n, similarity=t).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in rows] == brute(texts, n, t)


def test_long_lists_are_cut_by_size(spark):
    rows = [(-1, 5, c, size, 0, size, 2 * 17 * size, False, 0) for c, size in enumerate([20, 23, 24, 90, 100, 400, 1500, 6000, 25000] * 3)]
    entries = spark.createDataFrame(rows, "b long, s long, c long, size long, at int, r int, w long, core boolean, far int")
    short, long, _ = jaccard._short_and_long(entries, 16, 0, Fraction(85, 100))
    assert long is None  # 27 entries, at most 9 of which may link
    pairs = set()
    for part in short:
        met = part.alias("x").join(part.alias("y"), ["b", "s"]).select("x.c", "y.c").collect()
        pairs |= {(u, v) for u, v in met if u != v}
    sizes = {r[2]: r[3] for r in rows}
    assert {(u, v) for u in sizes for v in sizes if u != v and 85 * max(sizes[u], sizes[v]) <= 100 * min(sizes[u], sizes[v])} <= pairs


def test_signatures_never_differ_more_than_sets(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.choice([1, 20, 400, 510, 514, 1020, 1030, 3000])).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.1, 0.9, 1])], rng.integers(0, 1 << 62, rng.integers(0, 60)).astype(np.uint64)]))
        rows.append((jaccard.signature(a).tolist(), jaccard.signature(b).tolist()))
        want.append(len(np.setxor1d(a, b)))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<long>, b array<long>")
    got = [r.d for r in df.select("k", jaccard.bits_apart("a", "b").alias("d")).orderBy("k").collect()]
    assert all(d <= w for d, w in zip(got, want, strict=True))
    assert sum(d > w / 3 for d, w in zip(got, want, strict=True)) > 150


def test_one_of_each_keeps_the_first_and_all_wordless(docs_of):
    long = " ".join(f"w{k}" for k in range(100))
    texts = [long, long + " more", None, "", long, "another text altogether, with some words"]
    kept = jaccard.one_of_each(docs_of(texts, [5, 3, 7, 8, 3, 9], extra=True))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 9]
    assert kept.columns == docs_of([], extra=True).columns


def test_unlike_rows_of_one_doc_id_are_different_documents(docs_of):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    texts, ids = [a, b, a + " end", c, c, a, b + " x", None, c], [1, 1, 7, 7, 7, None, None, None, None]
    kept = jaccard.one_of_each(docs_of(texts, ids, extra=True)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (1, b), (7, c), (0, "")])
    found = jaccard.near_copies(docs_of(texts, ids)).collect()
    assert len(found) == 9
    assert {(r.doc_id, r.component_id) for r in found if r.n_shingles} == {(1, 1), (7, 1), (7, 7), (None, 1), (None, 7)}


def test_empty_table(docs_of):
    assert jaccard.near_copies(docs_of([])).collect() == []
    assert jaccard.one_of_each(docs_of([])).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}

