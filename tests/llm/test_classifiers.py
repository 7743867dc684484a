import zlib

import numpy as np
import pytest
from strayframe.llm import quality, toxicity


def area(scores, truth):
    order = np.argsort(scores, kind="stable")
    s, t = np.array(scores)[order], np.array(truth)[order]
    ranks = np.array([(np.searchsorted(s, x, "left") + np.searchsorted(s, x, "right") + 1) / 2 for x in s])
    n1 = t.sum()
    return (ranks[t == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(t) - n1))


@pytest.mark.parametrize(("operator", "label", "cut", "least"), [(toxicity.toxicity, "toxic", 0.3, 0.85), (quality.quality, "quality", 0.7, 0.8)])
def test_held_out_accuracy(spark, operator, label, cut, least):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = {r.doc_id: r for r in operator(docs, labels).collect()}
    assert len(rows) == docs.count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    known = [(rows[x.doc_id].score, x[label]) for x in labels.collect() if rows[x.doc_id].held_out]
    assert area([s for s, _ in known], [t for _, t in known]) >= least
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, rows[i].score) == rows[i].score


def test_scores_are_those_of_a_plain_forward_pass():
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(40)] + ["vile", "hateful"]
    sample = [(" ".join(rng.choice(words, rng.integers(1, 60))), k) for k in range(160)]
    sample = [(t, int("vile" in t.split()), k) for t, k in sample]
    net = toxicity.train(sample)
    texts = [t for t, *_ in sample[:40]] + ["", "vile", "one two"]

    def plain(text):
        rows = [net.tables[toxicity.buckets([w])[0]].sum(axis=0) for w in toxicity.words_of(text)]
        rows += [np.zeros(net.tables.shape[1], np.float32)] * max(toxicity.WIDTHS)
        hidden, column = [], 0
        for w in toxicity.WIDTHS:
            places = [sum(rows[p + j][column + j * toxicity.FILTERS : column + (j + 1) * toxicity.FILTERS] for j in range(w)) for p in range(max(1, len(rows) - max(toxicity.WIDTHS) + 1))]
            column += w * toxicity.FILTERS
            hidden.append(np.max(places, axis=0))
        z = (np.maximum(np.concatenate(hidden) + net.offsets, 0) * net.weights).sum() + net.bias
        return 1 / (1 + np.exp(-z))

    assert toxicity._score(net, texts) == pytest.approx([plain(t) for t in texts], abs=1e-5)
    model = quality.train(sample)

    def mean(text):
        rows = quality.features(quality.words_of(text))[1]
        return 1 / (1 + np.exp(np.clip(-(model.amounts[rows].mean() if len(rows) else 0) - model.bias, -30, 30)))

    table = quality.WordTable(model.of_words)
    assert model.scores([quality.words_of(t) for t in texts], table) == pytest.approx([mean(t) for t in texts], abs=1e-9)


def test_wider_filters_tell_the_order_of_words(monkeypatch):
    """Both words are in each text and only their order tells: filters of one word are blind to it, wider ones are not."""
    rng = np.random.default_rng(4)

    def texts(n):
        out = []
        for k in range(n):
            w = [f"w{j}" for j in rng.integers(0, 12, 14)]
            at = rng.integers(0, 12)
            w[at : at + 2] = ["harm", "them"] if k % 2 else ["them", "harm"]
            out.append((" ".join(w), k % 2, k))
        return out

    sample, asked = texts(1600), texts(400)
    found = {}
    for widths in ((1, 2, 3), (1,)):
        monkeypatch.setattr(toxicity, "WIDTHS", widths)
        found[widths] = area(toxicity._score(toxicity.train(sample), [t for t, *_ in asked]), [y for _, y, _ in asked])
    assert found[1, 2, 3] > 0.9 and found[1,] < 0.65, found


def test_a_fit_reads_a_bounded_number_of_whole_texts(spark, docs_of, monkeypatch):
    from strayframe.llm import learning

    texts = ["plain words here " * 40, "vile hateful words " * 40] * 60
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    monkeypatch.setattr(learning, "SAMPLE_BYTES", 8000)
    size = learning.fitted_by(docs_of(texts), labels, "toxic", 100, lambda sample, stands: (sum(len(t) for t, *_ in sample), {len(t) for t, *_ in sample}, stands))
    assert 8000 <= size[0] < 8800 and size[1] <= {len(texts[0]), len(texts[1])} and min(size[2]) > 1


@pytest.mark.parametrize(("operator", "label"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_defined_cases(spark, docs_of, operator, label):
    texts = [None, "", " ", "good words here", "bad awful words", "x" * 50_000, "word " * 30_000] + ["good words here", "bad awful words"] * 40
    docs = docs_of(texts, [*range(len(texts) - 1), None], extra=True)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7, len(texts))] + [(None, 1), (3, None)], f"doc_id long, {label} int")
    rows = {r.doc_id: r for r in operator(docs, labels).collect()}
    assert len(rows) == len(texts) and rows[0].score == rows[1].score == rows[2].score
    assert not rows[None].held_out
    none = operator(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert operator(docs_of([]), labels).collect() == []


def test_the_filter_keeps_columns_and_clean_rows(spark, docs_of):
    texts = ["good words here today"] * 60 + ["vile awful hateful words"] * 60
    docs = docs_of(texts, extra=True)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(60))


def test_scores_refer_to_the_rate_of_all_labels_and_not_of_the_sample(spark, docs_of):
    """Nine texts of ten are clean and nothing in them tells which: scores are near 0.1, also where the sample is half toxic."""
    texts = [f"plain words {i % 7}" for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, toxic int")
    for rows in (200, 4000):
        scores = [r.score for r in toxicity.toxicity(docs_of(texts), labels, sample_rows=rows).collect()]
        assert abs(np.mean(scores) - 0.1) < 0.06, rows


def test_a_rare_language_gets_its_threshold_from_all_labelled_rows(spark):
    """xx has one row in twelve, so next to none in the sample; "mild" is toxic there and mostly clean in en."""
    rows = []
    for i in range(2400):
        lang, toxic = ("xx", i % 24 == 0) if i % 12 == 0 else ("en", i % 4 == 1)
        rows.append((i, ("mild tone" if lang == "xx" or i % 5 == 0 else "vile hate") if toxic else ("mild tone" if i % 3 == 2 else "good day"), lang, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    docs, labels = df.drop("toxic"), df.select("doc_id", "toxic")
    found = toxicity.toxicity(docs, labels, sample_rows=80).join(df, "doc_id").collect()
    by = {}
    for r in found:
        by.setdefault((r.lang, r.text), set()).add((r.rejected, r.threshold))
    assert {k: {x for x, _ in v} for k, v in by.items()} == {("en", "good day"): {False}, ("en", "mild tone"): {False}, ("en", "vile hate"): {True}, ("xx", "good day"): {False}, ("xx", "mild tone"): {True}}
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels, sample_rows=80).collect()}
    assert kept == {r.doc_id for r in found if not r.rejected}


def test_a_stage_drops_what_workers_kept(spark):
    """Word tables and pieces of a stage are gone when it ends, and do not stay beside the next one's."""
    from strayframe.llm import common, packing, toxicity

    assert {"toxicity", "packing"} <= set(common._KEPT)
    encoder = packing.PieceEncoder.__new__(packing.PieceEncoder)
    encoder.clear()
    encoder.number["word"]
    packing.PieceEncoder.held[-1], toxicity._tables[0] = encoder, (0.0, toxicity.WordTable(toxicity.buckets))
    common.drop_kept()
    del packing.PieceEncoder.held[-1]
    assert not toxicity._tables and not encoder.number
    docs = spark.createDataFrame([(k, "good day" if k % 2 else "bad word", "en") for k in range(80)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(80)], "doc_id bigint, toxic int")
    toxicity.toxicity(docs, labels).count()

    def sizes(batches):
        import pyarrow as pa
        from strayframe.llm import toxicity

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(toxicity._tables)] * batch.num_rows, pa.int64())], names=["id"])

    assert {r.id for r in spark.range(8).repartition(4).mapInArrow(sizes, "id bigint").collect()} == {0}
