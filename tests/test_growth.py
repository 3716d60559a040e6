"""What keeps time in proportion to the input and memory bounded: work done once a draw, blocks cut into pieces."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from covaria.operators import models, moments, spd, splits


def test_one_digest_a_draw(spark):
    rows = spark.range(300).select(F.when(F.col("id") != 7, F.col("id")).alias("id"), (F.col("id") * 2).alias("v"))
    drawn = splits.multiplicities(rows, "id", 40, 5, "v")
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    reached, term = [], 0.36787944117144233
    for k in range(12):
        reached.append(sum(reached[-1:]) + term)
        term /= k + 1
    want = {}
    for i in (i for i in range(300) if i != 7):
        for rep in range(40):
            u = int(hashlib.md5(f"{i}|5|{rep}".encode()).hexdigest()[:12], 16) / float(1 << 48)
            want[i, 2 * i, rep] = sum(u >= c for c in reached)
    assert drawn.columns == ["id", "v", "rep", "times"]
    assert {(r["id"], r["v"], r["rep"]): r["times"] for r in drawn.collect()} == {k: n for k, n in want.items() if n}
    assert max(want.values()) > 4


def _rows(spark, n):
    x = F.array(*[F.when(F.col("id") % 50 != 3, F.sin(F.col("id") * (k + 1))) for k in range(3)])
    return spark.range(0, n, 1, 1).select("id", F.when(F.col("id") % 50 != 3, x).alias("x"), F.array(F.cos("id"), F.col("id") / n).alias("y"), (F.col("id") % 3).alias("part"))


def test_mapped_in_pieces(spark):
    """No more rows are mapped at once than their wide results allow, whatever the batch; order and nulls stay."""
    n, most = 6000, moments.AT_ONCE // (8 * 700)
    got = moments.mapped(_rows(spark, n), "x", lambda b: np.hstack([np.full((len(b), 1), float(len(b))), np.repeat(b[:, :1], 699, axis=1)]), "z").select("id", F.get("z", F.lit(0)).alias("m"), F.get("z", F.lit(699)).alias("v")).collect()
    assert [r["id"] for r in got] == list(range(n)) and max(r["m"] or 0 for r in got) <= most
    assert all(r["m"] is None and r["v"] is None if r["id"] % 50 == 3 else np.isclose(r["v"], np.sin(r["id"])) for r in got)


def test_sums_of_features(spark):
    """Sums of features made where they are multiplied are those of features sent on, and are made in pieces too."""
    rows, d = _rows(spark, 6000), 400
    made = models.fourier(rows.where("x IS NOT NULL"), "x", d, 0.7)

    def f(block):
        if len(block) > moments.AT_ONCE // (8 * d):
            raise ValueError(f"{len(block)} rows at once")
        return made.f(block)

    got = moments.stats_by(rows, "x", "y", ["part"], features=moments.Features(3, d, f))
    want = moments.stats_by(models.fourier_features(rows.where("x IS NOT NULL"), "x", d, 0.7), "phi", "y", ["part"])
    i = np.array([k for k in range(6000) if k % 50 != 3 and k % 3 == 1])
    rng = np.random.default_rng(0)
    w, b = rng.standard_normal((3, d)) / 0.7, rng.uniform(0, 2 * np.pi, d)
    phi = np.cos(np.sin(np.outer(i, [1, 2, 3])) @ w + b) * (2 / d) ** 0.5
    assert got.keys() == want.keys() == {(0,), (1,), (2,)}
    assert np.allclose(got[1,].xx, phi.T @ phi) and np.allclose(got[1,].xy[:, 0], phi.T @ np.cos(i)) and got[1,].n == len(i)
    assert all(np.allclose(getattr(got[k], a), getattr(want[k], a)) for k in want for a in ("n", "sx", "sy", "xx", "xy", "yy"))


def test_matrices_in_pieces():
    n, lengths = 30_000, []

    def f(flat):
        lengths.append(len(flat))
        return flat * 2

    there = ~np.isin(np.arange(n), [5, 20_000])
    flat = np.arange((n - 2) * 49, dtype=float)
    ends = pa.array(np.concatenate([[0], np.cumsum(there * 49)]), pa.int32(), mask=np.append(~there, False))
    cells = pa.ListArray.from_arrays(ends, pa.array(flat))
    got = spd._by_pieces(f, cells)
    assert max(lengths) <= moments.AT_ONCE // (8 * 49) and sum(lengths) == n - 2
    assert not got[5].is_valid and not got[20_000].is_valid and got.null_count == 2
    assert np.array_equal(got.flatten().to_numpy(), 2 * flat)


def test_matrices_made_once(spark):
    """A mean of matrices that Python makes has them made once; null ones stay null and don't count."""
    cells = [[2.0, 0.3, 0.3, 1.0], [1.5, -0.2, -0.2, 0.8], None, [3.0, 0.0, 0.0, 2.0]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id long, c array<double>").select("id", spd.make_spd(F.col("c")).alias("m"))
    summed = moments.cross_product(rows.select(F.array(F.lit(1.0)).alias("one"), "m"), "one", "m")
    assert summed._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    full = [np.array(c).reshape(2, 2) for c in cells if c]
    logs = [(lambda w, v: (v * np.log(w)) @ v.T)(*np.linalg.eigh(m)) for m in full]
    w, v = np.linalg.eigh(sum(logs) / len(logs))
    assert np.allclose(spd.log_euclidean_mean(rows, "m"), (v * np.exp(w)) @ v.T)
    told = {r["id"]: r["d"] for r in rows.select("id", spd.distance(F.col("m"), F.lit([1.0, 0.0, 0.0, 1.0])).alias("d")).collect()}
    assert told[2] is None and np.isclose(told[3], np.sqrt(np.log(3) ** 2 + np.log(2) ** 2))
