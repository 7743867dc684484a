"""Counts, decontamination, secrets, media and repeats against plain loops."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from strayframe.llm import automaton, counts, decontamination, matroska, secret_scan, suffixes

ODD = [None, "", " ", "a", "A b\tc\n d", "ünïcödé ÄÖ ß", "日本語のテキスト", "<s> </s> <unk> x", "x" * 20_000, "  lead and  trail  ", "nul\x00byte", "😀 emoji"]


def test_counts_are_the_library_s(docs_of, tmp_path):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + ["copy of a text"] * 30
    ids = [*range(len(ODD)), *[100 + k // 2 for k in range(29)], None]
    for cache in (None, str(tmp_path / "cache")):
        for _ in range(2):  # the second time all counts are stored
            got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counts.token_counts(docs_of(texts, ids, extra=True), path, limit=100, cache=cache).collect()), key=str)
            want = [len(library.encode(t or "")) for t in texts]
            assert got == sorted(((i, len((t or "").encode()), n, n > 100) for i, t, n in zip(ids, texts, want, strict=True)), key=str)
    assert counts.token_counts(docs_of([]), path).collect() == []


def test_each_text_is_encoded_once(docs_of, tmp_path, spark, monkeypatch):
    """Fifty equal rows, fifty of one text without ids and fifty with: three texts, three stored counts."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs_of(["one"] * 50 + ["two words"] * 50 + ["three"] * 50 + ["three"], [1] * 50 + [None] * 50 + list(range(50)) + [None])
    for keys in (counts.BROADCAST_KEYS, 0):
        monkeypatch.setattr(counts, "BROADCAST_KEYS", keys)
        for k in range(2):
            folder = str(tmp_path / f"cache{keys}")
            assert counts.token_counts(docs, path, cache=folder).count() == 151
            assert spark.read.parquet(folder).count() == 3
    seen = []
    monkeypatch.setattr(counts, "new_path", lambda spark, tag: seen.append(str(tmp_path / f"own{len(seen)}")) or seen[-1])
    assert counts.token_counts(docs, path).count() == 151
    assert spark.read.parquet(seen[0]).count() == 3


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items, n):
    w = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        iw = words(item)
        size = min(n, len(iw))
        windows = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        for i in range(len(w) - size + 1) if windows else ():
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_contamination_against_a_loop(spark, docs_of):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "日本"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(size))) for k, size in enumerate((1, 2, 5, 12, 13, 14, 30, 40))] + [(20, None), (21, ""), (22, "--"), (23, "w1 w2"), (23, "w1 w2")]
    texts = list(ODD)
    for k in range(120):
        x = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        source = items[3 + k % 5][1].split()
        a = rng.randrange(0, len(source))
        x[rng.randrange(0, len(x) + 1) :] += source[a : a + rng.randrange(5, 25)]
        texts.append("; ".join(x).upper() if k % 2 else " ".join(x))
    texts += [" ".join(["plain"] * 300 + items[5][1].split()), " ".join(["plain"] * 2000 + items[4][1].split())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(texts, extra=True)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(docs, bench).collect())
    want = [(i, *brute_hits(t, items, 13)) for i, t in enumerate(texts)]
    assert got == want
    kept = {r.doc_id for r in decontamination.without_contaminated(docs, bench).collect()}
    assert kept == {w[0] for w in want if not w[-1]}
    assert decontamination.contamination(docs_of([]), bench).collect() == []
    assert {r.n_hit for r in decontamination.contamination(docs, bench.limit(0)).collect()} == {0}


def test_spans_are_cut_out(spark, docs_of):
    item = " ".join(f"q{k}" for k in range(13))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontamination.without_spans(docs_of([f"Keep this, {item.upper()}! and that", "clean one", None]), bench).collect()}
    assert words(got[0]) == ["keep", "this", "and", "that"] and got[1] == "clean one" and got[2] == ""


def test_a_text_is_split_once_and_each_character_is_looked_up(spark, docs_of):
    bench = spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(13)))], "item_id long, text string")
    plan = decontamination.spans(docs_of(["some text"]), bench)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    assert "^" not in decontamination.WORD and not re.search("0-9|a-z|A-Z", decontamination.WORD)
    texts = [f"a{chr(c)}b" for c in [*range(0x300), 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF]]
    rows = docs_of(texts).select("doc_id", decontamination.words_of(F.col("text")).alias("words")).collect()
    assert all(r.words == words(texts[r.doc_id]) for r in rows)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def brute_added(text):
    out = [(m.start(), 3, m.end(), "forge") for m in re.finditer("gh[oprsu]_[A-Za-z0-9]+", text) if len(m[0]) >= 24]
    return out + [(m.start(), 4, m.end(), "key") for m in re.finditer("-----BEGIN [A-Z ]*PRIVATE KEY-----", text)]


def test_secrets_against_the_expressions(docs_of):
    rng = random.Random(5)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", "passwd", "=", ": ", " ", '"', "'", "\n", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "x", "é", "😀", "secretpassword", "Ab9+/_.=-Ab9+", "ſecret", "K", "gh", "ghp_abcdefghij0123456789XY", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN", " PRIVATE KEY-----", "-", " " * 700, "a" * 600]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(800)), "token=" + "a" * 50_000, "f" * 30_000]
    rows = {r.doc_id: r for r in secret_scan.secrets(docs_of(texts, extra=True)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        r = rows[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in want) for k in range(3)], t
        shown = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert r.spans == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(want + brute_added(t or "")))
    assert secret_scan.secrets(docs_of([])).collect() == []


def test_unbroken_megabytes_are_scanned_in_little_time():
    """Texts without a byte that ends what is under way, and heads that reach over thousands of lanes."""
    scanner = secret_scan.Scanner(secret_scan.BASE + secret_scan.ADDED)
    for text in ("aA1" * 400_000, "token" + " " * 1_000_000 + "=abcdefghijklmnop", "0123456789abcdef" * 70_000, "token=abcdefghijkl " * 50_000, "token=" * 200_000):
        began = time.process_time()
        assert scanner.spans([text])[0] == [(a, k, b) for a, k, b, _ in sorted(brute_spans(text) + brute_added(text))]
        assert time.process_time() - began < 20


def test_automaton_is_minimal_and_right():
    a = automaton.Automaton([("ab+c", False), ("x[0-9]{3}", False), ("ABC", True)])
    text = b"abbc..abc ABC x123 x12 aBc"
    found = dict(zip(*(x.tolist() for x in a.scan(np.frombuffer(text, np.uint8))), strict=True))
    ends = lambda p, flags=0: {m.end() - 1 for m in re.finditer(p, text, flags)}
    assert {k for k, v in found.items() if v & 1} == ends(b"ab+c")
    assert {k for k, v in found.items() if v & 2} == ends(rb"x\d{3}")
    assert {k for k, v in found.items() if v & 4} == ends(b"abc", re.I)
    rows = {(int(a.out[s]), tuple(a.table.reshape(a.states, -1)[s])) for s in range(a.states)}
    assert len(rows) == a.states


def test_media_round_trip(docs_of):
    texts = [*ODD, "y" * 192, "z" * 193, "long " * 40_000]
    media = matroska.media_column(docs_of(texts, extra=True))
    rows = {r.doc_id: r for r in matroska.media_features(media).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[0].media_sha256 == rows[1].media_sha256 and rows[0].feature == rows[1].feature
    packets = matroska.packet_table(media.where("doc_id = 14")).collect()
    assert len(packets) == -(-200_000 // 192) and {p["size"] for p in packets} == {192}
    assert [p.timestamp for p in packets if p.lace == 0] == sorted(p.timestamp for p in packets if p.lace == 0)
    assert matroska.media_features(matroska.media_column(docs_of([]))).collect() == []


@pytest.mark.parametrize("lacing", [matroska.XIPH, matroska.FIXED, matroska.EBML_LACE])
def test_lacing(lacing):
    rng = np.random.default_rng(2)
    frames = [rng.bytes(192 if lacing == matroska.FIXED else int(rng.integers(0, 700))) for _ in range(6)]
    media = matroska.Media()
    data = matroska.block(1, 5, frames, lacing)
    matroska._block(data, 0, len(data), 100, None, media)
    assert [data[at : at + size] for _, _, at, size, _, _ in media.packets] == frames
    assert {p[1] for p in media.packets} == {105}


def test_frames_have_their_own_times():
    """10 frames of 24 ms in two blocks; also where a block says how long it lasts instead of the track."""
    m = matroska.demux(matroska.mux(b"q" * 192 * 10))
    assert [(p[1], p[4]) for p in m.packets] == [(24 * k, k % 8) for k in range(10)]
    media = matroska.Media()
    group = matroska.element(matroska.BLOCK, matroska.block(1, 7, [b"a", b"bc", b"d"], matroska.XIPH)) + matroska.number(matroska.BLOCK_DURATION, 60)
    cluster = matroska.element(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 1000) + matroska.element(matroska.BLOCK_GROUP, group))
    media = matroska.demux(matroska.element(matroska.SEGMENT, cluster))
    assert [p[1] for p in media.packets] == [1007, 1027, 1047]


def test_a_file_takes_all_lacings_in_turn():
    payload = bytes(range(256)) * 3 * 192
    data = matroska.mux(payload)
    m = matroska.demux(data)
    assert matroska.read_back(data, m) == payload and [p[1] for p in m.packets] == [24 * k for k in range(len(payload) // 192)]
    assert all(matroska.mux(payload, (k,)) != data for k in matroska.LACINGS)


def test_null_ids_and_repeated_rows(docs_of):
    """Secrets, media and repeats: each row gets its result, null doc_id stays null."""
    texts, ids = ["token=abcdefghijklmnop", "token=abcdefghijklmnop", "x", None], [4, 4, None, None]
    found = secret_scan.secrets(docs_of(texts, ids)).collect()
    assert sorted((r.doc_id or 0, r.n_assign) for r in found) == [(0, 0), (0, 0), (4, 1), (4, 1)]
    media = matroska.media_features(matroska.media_column(docs_of(texts, ids))).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in media) == [(0, 0), (0, 1), (4, 22), (4, 22)]
    long = " ".join(f"w{k}" for k in range(80))
    spans = suffixes.repeats(docs_of([long, long, long, long], [1, 1, None, 2])).collect()
    assert sorted((r.doc_id or 0, r.start, r.stop) for r in spans) == [(0, 0, 80), (1, 0, 80), (2, 0, 80)]


def test_cues_unknown_sizes_and_broken_files():
    data = matroska.mux(b"q" * 192 * 300)
    m = matroska.demux(data)
    assert [c[2] for c in m.cues] == m.clusters and m.doc_type == "matroska" and m.tracks[1]["bits"] == 8
    at = data.index(matroska.SEGMENT.to_bytes(4, "big")) + 4
    width = 9 - data[at].bit_length()
    unknown = data[:at] + ((1 << 7 * width) - 1 | 1 << 7 * width).to_bytes(width, "big") + data[at + width :]
    assert matroska.demux(unknown).packets == m.packets
    with pytest.raises(ValueError):
        matroska.demux(data[:-3])
    with pytest.raises(ValueError):
        matroska.demux(b"\0\0\0\0")


def test_repeats_are_real_and_planted_ones_are_found(docs_of):
    rng = random.Random(11)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(n) for n in (51, 60, 80, 150, 400)]
    texts, planted = [], []
    for k in range(60):
        p = passages[k % 5]
        head, tail = fresh(rng.randrange(0, 90)), fresh(rng.randrange(0, 90))
        texts.append(" ".join(head + p + tail))
        planted.append((len(head), len(head) + len(p)))
    texts += [texts[0]] * 3 + [" ".join(fresh(500)), None, "", " ".join(fresh(20)), " ".join(passages[0][:30])]
    rows = suffixes.repeats(docs_of(texts, extra=True)).collect()
    split = [(t or "").lower().split() for t in texts]
    grams = {}
    for i, w in enumerate(split):
        for a in range(len(w) - 49):
            grams.setdefault(tuple(w[a : a + 50]), set()).add(i)
    real = [set() for _ in texts]
    for i, w in enumerate(split):
        for a in range(len(w) - 49):
            if len(grams[tuple(w[a : a + 50])]) > 1:
                real[i] |= set(range(a, a + 50))
    got = [set() for _ in texts]
    for r in rows:
        got[r.doc_id] |= set(range(r.start, r.stop))
        assert r.n_words == r.stop - r.start >= 50
    assert all(g <= w for g, w in zip(got, real, strict=True))
    for i, (a, b) in enumerate(planted):
        assert set(range(a, b)) <= got[i]
    assert got[60] == got[61] == got[62] == set(range(len(split[60])))
    assert not any(got[63:])
    assert suffixes.repeats(docs_of([])).collect() == []


def test_repeats_are_found_behind_frequent_tails(docs_of):
    """The one suffix of a passage of 50 words starts late, and many documents share the words from there on."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    while True:
        passage = [word() for _ in range(50)]
        at = suffixes.minimisers(suffixes.word_hashes(" ".join(passage)))[0]
        if len(at) == 1 and at[0] >= 15:
            break
    tail = passage[at[0] :]
    some = lambda n: [word() for _ in range(n)]
    texts = [" ".join(some(60) + passage + some(60)) for _ in range(2)] + [" ".join(some(60) + tail + some(60)) for _ in range(150)]
    found = {r.doc_id: r for r in suffixes.repeats(docs_of(texts)).collect()}
    assert {i: (r.start, r.stop, r.twin_id) for i, r in found.items()} == {0: (60, 110, 1), 1: (60, 110, 0)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_words_of_repeats_and_no_others_are_found(docs_of, seed):
    """Slices of common passages, some of them with a word changed, in every order: spans cover just the windows of 50 words that two
    documents have."""
    rng = random.Random(seed)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(n) for n in (70, 90, 160, 300)]
    split = []
    for _ in range(70):
        words_ = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 30)
            part = p[a : a + rng.randrange(30, 130)]
            if rng.random() < 0.4:
                part = [*part]
                part[rng.randrange(len(part))] = fresh(1)[0]
            words_ += part + fresh(rng.choice([0, 0, 3, 40]))
        split.append(words_)
    grams = {}
    for i, w in enumerate(split):
        for a in range(len(w) - 49):
            grams.setdefault(tuple(w[a : a + 50]), set()).add(i)
    real = [set() for _ in split]
    for i, w in enumerate(split):
        for a in range(len(w) - 49):
            if len(grams[tuple(w[a : a + 50])]) > 1:
                real[i] |= set(range(a, a + 50))
    got = [set() for _ in split]
    for r in suffixes.repeats(docs_of([" ".join(w) for w in split])).collect():
        got[r.doc_id] |= set(range(r.start, r.stop))
    assert got == real
