import numpy as np

from churnlens.llm import licenses
from tests.llm.helpers import documents


def test_packed_sums_are_those_of_the_rounded_weights():
    r = np.random.default_rng(3)
    for classes, scale in ((21, 1.0), (20, 9.0), (4, 0.0)):
        w = r.normal(0, 1, (classes, 64)) * scale
        steps, packed = licenses.packed_weights(w.tolist())
        for places in (r.integers(0, 64, licenses.SLICE), np.full(licenses.SLICE, np.abs(w).max(axis=0).argmax()), []):
            total = packed[:, np.array(places, int)].sum(axis=1)
            got = []
            for _ in range(3):
                low = ((total + licenses.HALF) & (2 * licenses.HALF - 1)) - licenses.HALF
                got.append(low)
                total = (total - low) >> licenses.LANE
            want = np.round(w * steps).astype(int)[:, np.array(places, int)].sum(axis=1)
            assert (np.stack(got, axis=1).ravel()[:classes] == want).all()


def test_a_line_longer_than_a_slice_is_scored_whole(spark):
    r = np.random.default_rng(5)
    k = len(licenses.FAMILIES)
    model = {"weights": (r.normal(0, 0.05, (k, licenses.BUCKETS))).tolist(), "shift": [0.0] * k}
    line = " ".join(f"w{i}" for i in range(700))
    got = licenses.scored(documents(spark, [(1, line), (2, "w1"), (3, None)]), model)
    rows = {x["doc_id"]: x for x in got.collect()}
    places = spark.createDataFrame([(line.split(),)], "w array<string>").selectExpr(f"{licenses._grams('w')} AS g").first()["g"]
    steps, _ = licenses.packed_weights(model["weights"])
    z = (np.round(np.array(model["weights"]) * steps) / steps)[:, places].sum(axis=1)
    odds = np.log(np.exp(z[:-1] - z[-1]).sum())
    assert (rows[1]["n_pieces"], len(rows[1]["found"])) == (1, int(odds >= 0))
    assert not rows[1]["found"] or abs(rows[1]["found"][0]["t"] - odds) < 1e-9
