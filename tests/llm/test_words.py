"""Periodic runs, piece encoding and spelling variants against plain loops and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from strayframe.llm import entries, pieces, runs, variants

ODD = [None, "", " ", "a", "A b\tc\n d", "a a a a a a", "ünïcödé ÄÖ ß", "日本語のテキスト", "<s> </s> <unk> x", "x" * 20_000, "  lead and  trail  ", "nul\x00byte", "😀 emoji", "▁ ▁▁a▁", "la " * 3000]


def plain_runs(s, least, power):
    """For each period the maximal stretches of words that are equal to the one a period on."""
    found = {}
    for q in range(1, len(s) // power + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, power * q):
                found.setdefault((i, size), q)  # the smallest period comes first
            i = max(i + 1, j)
    return sorted(((x, size, q) for (x, size), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(rng, count):
    for _ in range(count):
        k = rng.choice([1, 2, 2, 3, 5])
        s = [rng.randrange(k) for _ in range(rng.randrange(0, 50))]
        for _ in range(rng.randrange(3)):
            block = [rng.randrange(k) for _ in range(rng.randrange(1, 8))]
            a = rng.randrange(len(s) + 1)
            s[a:a] = (block * 12)[: rng.randrange(1, 12 * len(block))]
        yield s * rng.choice([1, 1, 1, 2, 5])


@pytest.mark.parametrize(("least", "power"), [(6, 4), (2, 2), (4, 3)])
def test_runs_of_numbers_against_a_loop(least, power):
    for s in sequences(random.Random(least), 1500):
        want = plain_runs(s, least, power)
        assert runs.runs_of(s, least, power) == want
        cuts = runs.repeating(np.array(s, dtype=np.int64), np.array([len(s)]), least, runs.gram_size(least, power)) if s else []
        assert sorted(((x + a, size, q) for a, z in cuts for x, size, q in runs.runs_of(s[a:z], least, power)), key=lambda r: (r[0], r[2])) == want


def test_factors_are_the_longest_earlier_prefixes():
    for s in sequences(random.Random(8), 300):
        at = 0
        for start, length, source in runs.factors(s):
            assert start == at
            at += length
            longest = max((n for b in range(start) for n in range(len(s) - start + 1) if s[b : b + n] == s[start : start + n]), default=0)
            assert length == max(1, longest)
            assert (source < 0) == (longest == 0) and (source < 0 or (source < start and s[source : source + length] == s[start : start + length]))
        assert at == len(s)


def want_runs(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, 6, 4)
    gone = {k for x, size, q in found for k in range(x + q, x + size)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    return (
        len(found), *best, best[1] * 1000 // best[2] if found else None,
        hashlib.sha256("".join(f"{x},{size},{q}\n" for x, size, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest(),
    )


def test_documents_runs_against_a_loop(docs_of):
    rng = random.Random(4)
    texts = list(ODD)
    for _ in range(250):
        words = [rng.choice(["a", "b", "cc", "É", "w,"]) if rng.random() < 0.4 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(len(words) + 1)
            words[a:a] = (words[a : a + rng.randrange(1, 9)] or ["z"]) * rng.randrange(1, 8)
        texts.append(" ".join(words).replace(" w", rng.choice([" w", "\n w", "\tw"])))
    texts += texts[-3:]
    ids = [*range(len(texts) - 4), 7, 7, None, None]
    got = sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in runs.run_digests(runs.periodic_runs(docs_of(texts, ids, extra=True), rewrite=runs.planted)).collect()), key=str)
    want = [(i, *want_runs(i, t)) for i, t in zip(ids, texts, strict=True)]
    assert sum(w[1] for w in want) > 100
    assert got == sorted(want, key=str)
    assert runs.periodic_runs(docs_of([])).collect() == []


def test_runs_over_a_table(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    want = sorted((r.doc_id, *want_runs(r.doc_id, r.text)) for r in table.collect())
    got = sorted((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in entries.op11_periodic_runs(spark, small).collect())
    assert str(got) == str(want)


MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return pieces.PieceModel(f.read())


def test_pieces_are_the_library_s(library, model):
    rng = random.Random(6)
    known = list(model.ids)
    texts = [t or "" for t in ODD] + ["a" * 1000, " " * 333, "aab" * 200]
    for _ in range(4000):
        alphabet = rng.choice([known, list("abcdefeinrst  ▁\n\té,."), list("aab "), ["🙂", "日", "ß", "xy", "\x00", "the", " the", "ing", "\x85", "　", "ꙮ", "no", ".", ".."]])
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))))
    for text in texts:
        ids = library.encode(text)
        assert model.encode(text) == ids, text
        assert model.decode([*ids, 2]) == library.decode([*ids, 2])


def test_compatible_pairs_are_those_that_stay_apart(model):
    rng = random.Random(9)
    known = [p for p in model.ids if p.isascii() and len(p) < 7]
    for _ in range(4000):
        a, b = rng.choice(known), rng.choice(known)
        assert model.fits(a, b) == (model._merged(a + b)[0] == [a, b]), (a, b)


def test_any_ids_decode_as_in_the_library(library, model):
    rng = random.Random(7)
    for _ in range(6000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(0, 3), 29871, rng.randrange(195, 230)]) for _ in range(rng.randrange(0, 9))]
        assert model.decode(ids) == library.decode(ids), ids


def test_encoding_of_documents(spark, docs_of, library, small):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def want(i, text):
        ids = library.encode(text or "", add_eos=True)
        return i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))

    ids = [*range(len(ODD) - 2), 5, None]
    found = pieces.encoded(docs_of(ODD, ids, extra=True), MODEL, end_id=2, decode=True)
    assert sorted((tuple(r) for r in pieces.piece_digests(found).collect()), key=str) == sorted((want(i, t) for i, t in zip(ids, ODD, strict=True)), key=str)
    again = pieces.decoded(found.select("doc_id", "ids"), MODEL)
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    assert pieces.encoded(docs_of([]), MODEL).collect() == []
    table = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(tuple(r) for r in entries.op12_piece_encoding(spark, small).collect()) == sorted(want(r.doc_id, r.text) for r in table.collect())


def test_another_kind_of_model_is_an_error():
    with pytest.raises(ValueError, match="merge-type"):
        pieces.PieceModel(b"")


def want_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(u, v):
        if len(u) == len(v):
            return sum(x != y for x, y in zip(u, v, strict=True)) == 1
        u, v = sorted((u, v), key=len)
        return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))

    form, out = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[v], v) for v in counts if abs(len(v) - len(w)) < 2 and v != w and near(w, v))
        form[w] = others[0][1] if others and -others[0][0] >= 5 * n else None
        out[w] = (n, len(others), form[w], counts[form[w]] if form[w] else None)
    root = lambda w: root(form[w]) if form[w] else w
    return sorted((w, *x, root(w)) for w, x in out.items())


def got_variants(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def test_variants_against_all_pairs(docs_of, monkeypatch):
    rng = random.Random(10)
    bases = ["bookkeeper", "aaaaaaa", "straße", "élégant", "international", "internationale", "zzzzzz", "abcabcabc", "ÀÉ×÷àéx"]
    words = Counter()
    for base in bases:
        for n in (1, 2, 40, 250):
            word = list(base)
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(word))
                word[k : k + rng.randrange(0, 2)] = rng.choice([[], ["a"], ["b"], ["é"], ["x"]])
            words["".join(word)] += n * 6
    for letters in ("abcdefghijklmnopqrstuvwxyzéèàü", "ab"):
        for _ in range(120):  # crowded blocks: many words that share all but a place or two
            word = list("commonstem")
            word[rng.choice([2, 2, 7, 8])] = rng.choice(letters)
            if rng.random() < 0.5:
                word.insert(rng.choice([5, 7, 10]), rng.choice(letters))
            words["".join(word)] += rng.choice([5, 7, 30, 200])
    listed = [w for w, n in words.items() for _ in range(n)]
    rng.shuffle(listed)
    texts = [*ODD, *(" ".join(x if rng.random() < 0.9 else x.upper() for x in listed[k : k + 40]) for k in range(0, len(listed), 40))]
    texts += [texts[-1], "-".join(["y" * 3000] * 6)]
    ids = [*range(len(texts) - 2), 3, None]
    want = want_variants(zip(ids, texts, strict=True))
    assert sum(w[3] is not None for w in want) > 20 and max(w[2] for w in want) > 25 and any(w[3] != w[5] and w[3] for w in want)
    for most in (variants.MOST, 2):  # with 2, nearly every block is divided
        monkeypatch.setattr(variants, "MOST", most)
        assert got_variants(variants.spelling_variants(docs_of(texts, ids, extra=True), change=variants.misspelt)) == want
    assert variants.spelling_variants(docs_of([None, "", "short"])).collect() == []


def test_variants_over_a_table(spark, small):
    want = want_variants((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    assert got_variants(entries.op13_spelling_variants(spark, small)) == want
