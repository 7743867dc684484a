import hashlib
import random
from math import log

import pytest
from strayframe.llm import mixing


def docs(docs_of, sizes, extra=False):
    texts, sources = [], []
    for name, (n, words) in sizes.items():
        texts += ["word " * words] * n
        sources += [name] * n
    return docs_of(texts, sources=sources, extra=extra)


def test_weights_reach_the_entropy_with_the_largest_exponent(spark):
    sizes = {"a": 600, "b": 300, "c": 90, "d": 10}
    rows = spark.createDataFrame(list(sizes.items()), "source string, tokens long")
    w = {r.source: r for r in mixing.source_weights(rows, entropy_share=0.9, budget=1000).collect()}
    assert sum(r.weight for r in w.values()) == pytest.approx(1)
    assert mixing.entropy([r.weight for r in w.values()]) == pytest.approx(0.9 * log(4), abs=1e-6)
    x = w["a"].exponent
    z = sum((n / 1000) ** x for n in sizes.values())
    assert all(r.weight == pytest.approx((sizes[k] / 1000) ** x / z) for k, r in w.items())


def test_the_repetition_limit_comes_before_the_entropy(spark):
    rows = spark.createDataFrame([("a", 990), ("b", 10)], "source string, tokens long")
    w = {r.source: r for r in mixing.source_weights(rows, entropy_share=1.0, max_repeats=3.0, budget=1000).collect()}
    assert w["b"].quota / 10 == pytest.approx(3.0, abs=0.11)


def test_budgets_and_passes(docs_of):
    d = docs(docs_of, {"big": (900, 10), "mid": (200, 10), "tiny": (40, 10), None: (30, 10), "none": (5, 0)}, extra=True)
    weights, _ = mixing.plan(d, entropy_share=0.95, max_repeats=4.0)
    w = {r.source: r for r in weights.collect()}
    rows = mixing.mixed(d, entropy_share=0.95, max_repeats=4.0).collect()
    assert {r.source for r in rows} == {"big", "mid", "tiny", None}
    for key, source in (("sbig", "big"), ("smid", "mid"), ("stiny", "tiny"), ("n", None)):
        own = [r for r in rows if r.source == source]
        drawn, passes = sum(r.n_tokens for r in own), w[key].quota // w[key].tokens
        last = {}
        for r in own:
            last[r.epoch, r.block] = last.get((r.epoch, r.block), 0) + r.n_tokens
        assert 0 <= drawn - w[key].quota <= max(last.values())
        for e in range(passes):
            assert sum(r.n_tokens for r in own if r.epoch == e) == w[key].tokens
        orders = [[b for b, _ in sorted({(r.block, r.position) for r in own if r.epoch == e}, key=lambda x: x[1])] for e in range(passes)]
        assert len(orders) < 2 or orders[0] != orders[1]


def test_mixture_keeps_every_document_without_a_budget(docs_of):
    d = docs(docs_of, {"big": (300, 10), "tiny": (20, 10)}, extra=True)
    out = mixing.mixture(d, entropy_share=0.98, max_repeats=1.25, budget_share=None)
    assert out.columns == d.columns
    ids = [r.doc_id for r in out.collect()]
    assert set(ids) == set(range(320)) and len(ids) <= 1.25 * 320 + 32


def test_single_and_empty(docs_of):
    assert {r.weight for r in mixing.mixed(docs(docs_of, {"a": (10, 5)})).collect()} == {1.0}
    assert mixing.mixed(docs_of([])).collect() == []
    assert mixing.mixed(docs_of([None, ""])).collect() == []


@pytest.mark.parametrize("sizes", [{"big": (300, 10), "tiny": (40, 10), "none": (5, 0)}, {"none": (5, 0)}])
def test_without_a_budget_wordless_documents_stay(docs_of, sizes):
    d = docs(docs_of, sizes)
    wordless = docs_of([None, "", " "] * 30, ids=range(1000, 1090), sources=["big", "tiny", "none"] * 30)
    d = d.unionByName(wordless)
    drawn = [r.doc_id for r in mixing.mixture(d, entropy_share=0.98, max_repeats=1.25, budget_share=None).collect()]
    assert set(drawn) == {r.doc_id for r in d.collect()}
    assert all(0 <= r.position <= 1 for r in mixing.mixed(d, entropy_share=0.98, max_repeats=1.25, budget_share=None).collect())


def by_hand(rows, seed=17, entropy_share=0.98, max_repeats=4.0, budget_share=1.0):
    """All that mixing draws, by plain loops. rows: (doc_id, source, tokens)."""
    uniform = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)
    rows = [(i, "n" if s is None else f"s{s}", n) for i, s, n in rows]
    size = {}
    for _, s, n in rows:
        size[s] = size.get(s, 0) + n
    total = sum(size.values())
    p = [n / total for n in size.values() if n]
    budget = None if budget_share is None else int(total * budget_share)

    def bisect(holds):
        if holds(1.0) or not holds(0.0):
            return float(holds(1.0))
        lo, hi = 0.0, 1.0
        for _ in range(60):
            lo, hi = ((lo + hi) / 2, hi) if holds((lo + hi) / 2) else (lo, (lo + hi) / 2)
        return (lo + hi) / 2

    weights = lambda m: [x**m / sum(y**m for y in p) for x in p]
    flat = bisect(lambda m: -sum(w * log(w) for w in weights(m)) >= entropy_share * log(len(p)) - 1e-12)
    share = lambda m: [w / x for w, x in zip(weights(m), p, strict=True)]  # noqa: E731  how often each is shown, up to a factor
    often = bisect(lambda m: (max(share(m)) * budget / total if budget is not None else max(share(m)) / min(share(m))) > max_repeats)
    m = max(flat, often)
    z = sum(x**m for x in p)
    whole = budget if budget is not None else total / min(share(m))
    blocks = {}
    for i, s, n in rows:
        k = uniform(seed, "doc", "null" if i is None else i) % max(64, -(-size[s] // (1 << 16)))
        blocks.setdefault(s, {}).setdefault(k, []).append((i, n))
    out = []
    for s, own in blocks.items():
        quota = int((size[s] / total) ** m / z * whole + 1e-6) if size[s] else 0
        for epoch in range(quota // size[s] + 1 if quota else int(budget is None)):
            before = 0
            for k in sorted(own, key=lambda k: (uniform(seed, epoch, s, k), k)):
                if before < quota - epoch * size[s] or (budget is None and epoch == 0):
                    out += [(i, epoch, k, n) for i, n in own[k]]
                before += sum(n for _, n in own[k])
    return sorted(out, key=str)


def test_all_that_is_drawn_against_plain_loops(docs_of):
    rng = random.Random(8)
    sources = [rng.choice(["big"] * 12 + ["mid"] * 4 + ["tiny", None]) for _ in range(700)] + ["none"] * 3
    texts = [" ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 90))) for _ in range(700)] + ["", " ", None]
    ids = [*range(690), *[5] * 10, 700, 701, None]
    rows = [(i, s, len((t or "").split())) for i, s, t in zip(ids, sources, texts, strict=True)]
    for options in ({}, {"budget_share": None, "max_repeats": 1.25}, {"entropy_share": 0.9, "max_repeats": 2.0, "budget_share": 2.5}):
        got = sorted(((r.doc_id, r.epoch, r.block, r.n_tokens) for r in mixing.mixed(docs_of(texts, ids, sources, extra=True), **options).collect()), key=str)
        assert got == by_hand(rows, **options)


def test_stored_token_counts_are_used(docs_of):
    from pyspark.sql import functions as F

    d = docs_of(["one"] * 40 + ["one two three"] * 40, sources=["a"] * 40 + ["b"] * 40).withColumn("n", F.when(F.col("source") == "a", 30).otherwise(10))
    weights, _ = mixing.plan(d, tokens="n")
    assert {r.source: r.tokens for r in weights.collect()} == {"sa": 1200, "sb": 400}
    assert {r.n_tokens for r in mixing.mixed(d, tokens="n").collect()} == {30, 10}
