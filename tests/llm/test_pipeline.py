import zlib
from fractions import Fraction

import corpus_pipeline
import numpy as np
import public_tokenizers
from strayframe.llm import common, entries, toxicity
from tokenizers import Tokenizer

from test_jaccard import brute
from test_mixing import by_hand
from test_text_operators import brute_hits


def test_stages_in_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, small)
        out = corpus_pipeline.stored(out, name)
        assert out.columns == docs.columns
        before, after = {r.doc_id for r in at.select("doc_id").collect()}, [r.doc_id for r in out.select("doc_id").collect()]
        assert set(after) <= before
        if name == "mixing":
            assert set(after) == before
        else:
            assert len(after) <= at.count()
        at = out
    rows = corpus_pipeline.STAGES[-1][1](spark, at, small).collect()
    assert len(rows) == at.count()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_first_stage_drops_what_the_classifier_rejects(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.toxicity(docs, labels).where("rejected").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, small).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - rejected


def test_each_stage_against_brute_force(spark, small, docs_of):
    """Each stage's rows from its own input, worked out by plain loops over whole texts."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    at = corpus_pipeline.stored(docs, "brute")
    before = rows(at)
    for name, stage in corpus_pipeline.STAGES[1:]:  # the first is held against the classifier's rejections above
        at = corpus_pipeline.stored(stage(spark, at, small), name)
        if name == "ngram_jaccard":
            ordered = sorted(before)
            root = {i: c for i, _, c in brute([t for _, t, _ in ordered], 5, Fraction(8, 10))}
            want = [ordered[i] for i, c in root.items() if i == c]
        elif name == "decontamination":
            want = [r for r in before if not brute_hits(r[1], bench, 13)[-1]]
        elif name == "mixing":
            drawn = by_hand([(i, s, len((t or "").split())) for i, t, s in before], entropy_share=0.98, max_repeats=1.25, budget_share=None)
            text = {i: (i, t, s) for i, t, s in before}
            want = [text[i] for i, *_ in drawn]
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, _ in before]
            got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in at.collect())
            assert got == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
            starts = sorted((r.start, r.n_tokens) for r in at.collect())
            assert [a for a, _ in starts] == np.cumsum([0, *(n for _, n in starts[:-1])]).tolist()
            break
        after = rows(at)
        assert sorted(map(str, after)) == sorted(map(str, want)), name
        before = after


def test_stages_take_nulls_repeated_ids_and_clashing_columns(spark, docs_of, tmp_path):
    """Null doc_id and text, several texts of a doc_id, equal rows, empty and long texts: no stage fails, and what is like nothing stays."""
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    texts = [None, "", words("a", 60), words("a", 60), words("b", 60), words("c", 60), words("c", 60) + " end", words("long", 30_000), words("d", 70), None]
    ids = [None, 1, 2, 2, 2, None, 3, 4, None, 5]
    docs = docs_of(texts, ids, sources=["web", None, "web", "web", "books", None, "web", "books", "books", "none"], extra=True)
    spark.createDataFrame([(2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words("z", 20)), (None, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        at = corpus_pipeline.stored(stage(spark, at, str(tmp_path)), name)
        assert at.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in at.collect()}
    assert {t for _, t in kept} - {texts[5], texts[6]} == {None, "", texts[2], texts[4], texts[7], texts[8]}
    assert sum(t in (texts[5], texts[6]) for _, t in kept) == 1 and (None, None) in kept and (5, None) in kept
    scored = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert scored.columns == docs.columns and scored.count() <= docs.count()
    assert corpus_pipeline.write_tokens(spark, at, str(tmp_path)).count() == at.count()


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.collect() == []


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in entries.QUERIES) == list(range(1, 11))


def test_stored_tables_leave_no_freed_memory_in_the_driver(spark, monkeypatch):
    assert common.trim_driver(spark)
    calls = []
    monkeypatch.setattr(common, "trim_driver", lambda session: calls.append(session) or True)
    table = common.stored(spark.range(3), "few")
    assert table.count() == 3 and len(calls) == 1
    common.release(spark, table)
    assert len(calls) == 2
