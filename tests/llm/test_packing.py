import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from strayframe.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = [
    None, "", " ", "\n", "a", "  two  spaces ", "it's we'll I'd 'tis", "x<|endoftext|>y <|endoftext|>. z", "tabs\t\tand\n\n lines\r\n", "1,234.5 3.14! naïve café… déjà?vu",
    "non\xa0breaking　wide line\x0bvt\x1fus", "日本語 中文, emoji 😀😀 👩‍👩‍👧", "a.b.c,d!e?f", "....!!!!,,,,", "word" * 3000, "a" * 5000 + " " * 300 + "b", "'s 't 're", " lead", "trail ", "İstanbul ǅ ß.",
]


def expected(texts, end_id=0):
    library = Tokenizer.from_file(PATH)
    return [library.encode(t or "", add_special_tokens=False).ids + [end_id] for t in texts]


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(7)
    parts = ["the", "Word", " ", "  ", "\n", ".", ",", "'s", "é", "日", "12", "😀", "\t", "-", "(", "\xa0", "<|endoftext|>", "!", "?", "_", "'", "ß", "x9"]
    texts = [x or "" for x in AWKWARD] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    encoder = packing.PieceEncoder(open(PATH, encoding="utf-8").read())
    for lo in range(0, len(texts), 100):
        got = encoder.encode(texts[lo : lo + 100])
        for text, ids, want in zip(texts[lo : lo + 100], got, expected(texts[lo : lo + 100]), strict=True):
            assert ids.tolist() == want[:-1], text


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 20, 32])
def test_pack_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    data = packing.pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8)
    for a, b in ((0, 1000), (3, 4), (17, 500), (999, 1000), (5, 5)):
        assert packing.unpack(data, bits, a, b).tolist() == ids[a:b].tolist()


def test_bits_of_a_vocabulary():
    assert [packing.min_bits(v) for v in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


def test_files_hold_the_ids(spark, docs_of, tmp_path):
    texts = AWKWARD + ["same text"] * 5
    ids = [i * 3 for i in range(len(AWKWARD))] + [1, 100, 200, 200, None]
    path = str(tmp_path / "tokens")
    packing.write_packed(docs_of(texts, ids, extra=True), path, PATH, vocabulary=50_257, block_ids=64)
    rows = packing.read_documents(spark, path).orderBy("start").collect()
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    want = expected([texts[i] for i in order])
    assert [r.doc_id for r in rows] == [ids[i] for i in order]
    assert [r.n_tokens for r in rows] == [len(x) for x in want]
    assert [r.start for r in rows] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in want]
    flat = [t for x in want for t in x]
    got = packing.read_range(spark, path, 40, 300).orderBy("position").collect()
    assert [r.id for r in got] == flat[40:300]


def test_empty_table(docs_of):
    assert packing.token_output(docs_of([]), PATH, vocabulary=50_257).collect() == []


def test_ids_that_do_not_fit_are_an_error():
    assert packing.unpack(packing.pack(np.array([65_535], np.uint32), 16), 16, 0, 1).tolist() == [65_535]
    for ids, bits in (([70_000], 16), ([8], 3), ([1 << 20, 1], 20)):
        with pytest.raises(ValueError, match="does not fit"):
            packing.pack(np.array(ids, np.uint32), bits)


def test_the_vocabulary_is_the_tokenizer_s():
    assert packing.vocabulary_of(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()) == 50_257
    assert packing.vocabulary_of('{"model": {"vocab": {"a": 0, "b": 4}}, "added_tokens": [{"id": 9}]}') == 10
