"""The text dictionary encodes each text once; drawn pairs and directions against NumPy."""

import numpy as np
import pytest
from strayframe.operators import density, dictionary, knn
from strayframe.plans import catalog
from strayframe.sources.tables import frames


def test_texts_are_encoded_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red car"), (2, "hay bale"), (3, "red car"), (4, None), (5, "")], "i int, label string")
    for name in ("letters", "trigrams"):
        known = dictionary.TextDictionary(str(tmp_path / name), name)
        assert known.update(rows.where("i < 2"), "label") == 1
        assert known.update(rows, "label") == 2
        assert known.update(rows, "label") == 0
        assert dictionary.TextDictionary(known.path, name).update(rows, "label") == 0  # opened again
        got = {r.i: r.v for r in known.joined(rows, "label").collect()}
        embed, template = dictionary.ENCODERS[name].load(), dictionary.ENCODERS[name].template
        for r in rows.collect():
            if r.label is None:
                assert got[r.i] is None
            else:
                v = embed([template.format(r.label)])[0]
                assert got[r.i] == pytest.approx(v / max(np.linalg.norm(v), 1e-300))


def test_another_version_is_encoded_anew(spark, tmp_path):
    rows = spark.createDataFrame([("a b",), ("c",)], "label string")

    def load():
        return lambda texts: np.array([[float(len(t)), 0.0] for t in texts])

    dictionary.encoder("lengths", "1", unit=False)(load)
    known = dictionary.TextDictionary(str(tmp_path / "d"), "lengths")
    assert known.update(rows, "label") == 2 and known.update(rows, "label") == 0
    dictionary.encoder("lengths", "2", template="<{}>", unit=False)(load)
    assert known.update(rows, "label") == 2
    assert sorted(r.v[0] for r in known.joined(rows, "label").collect()) == [3.0, 5.0]
    with pytest.raises(ValueError, match="unknown encoder"):
        dictionary.encoder_of("nothing")


def test_spread_and_pairs_against_numpy(spark):
    folder = "/root/testdata/sf0.001"
    pool = knn.pool_of(knn.unit_frames(frames(spark, folder)), [0, 1, 2, 3, 4, 5])
    x = np.array([r.r for r in pool.orderBy("r_id").collect()])
    values = np.linalg.eigvalsh(np.cov(x.T))
    got = catalog.queries()["g26_top_directions"](spark, folder).first()
    assert got.participation == pytest.approx(values.sum() ** 2 / (values**2).sum(), rel=1e-5)
    assert got.top2 == pytest.approx(values[-2:].sum() / values.sum(), rel=1e-5)
    d = np.array([r.d for r in density.random_pairs(pool, 4000).collect()])
    i, j = np.triu_indices(len(x), 1)
    every = 1 - (x[i] * x[j]).sum(1)
    assert len(d) > 3900 and abs(np.median(d) - np.median(every)) < 0.02 and abs(d.mean() - every.mean()) < 0.02
