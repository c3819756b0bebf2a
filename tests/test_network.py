import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorlens.operators import network as N


def table(spark, n=120, width=6, seed=0, parts=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 2, (n, width)) + 1
    y = (x[:, 0] + rng.normal(0, 0.5, n) > 2.5).astype(int)
    rows = [(f"u{i % 20}", i, x[i].tolist(), int(y[i]), i % 20 % 4) for i in range(n)]
    return spark.createDataFrame(rows, "user string, day int, x array<double>, label int, fold int").repartition(parts), x, y


def twin(keys, x, y, fold, k, training):
    """The same training in one place: a plain pass over all rows in NumPy."""
    use = (fold != k) | (k == -1)
    mean, std = x[use].mean(axis=0), x[use].std(axis=0) + 1e-8
    net = N.initial((x.shape[1], *training.hidden, 1), mean, std, training.seed)
    m = v = np.zeros(len(net.flat()))
    for step in range(training.epochs * training.batches):
        epoch, part = divmod(step, training.batches)
        mine = use & (N.mixed(keys, training.seed, epoch) % np.uint64(training.batches) == part)
        if not mine.any():
            continue
        _, slope = N.gradient(net, keys[mine], x[mine], y[mine], step, training)
        slope = slope / mine.sum()
        slope = slope * min(1, training.clip / np.linalg.norm(slope))
        t = step + 1
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        net = net.with_flat(net.flat() * (1 - training.rate * training.decay) - training.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
    return net


def test_weights_agree_with_numpy_whatever_the_partitions(spark):
    training = N.Training(hidden=(8, 4), epochs=6, batches=3, rate=1e-2, seed=3)
    found = {}
    for parts in (1, 20):
        df, x, y = table(spark, parts=parts)
        rows = N.keyed(df, F.col("x"), "user", "day", fold=F.col("fold"))
        found[parts] = N.fit(rows, training)
        keys = {r.day: r._key for r in rows.select("day", "_key").collect()}
    keys = np.array([keys[i] for i in range(len(y))], np.int64).view(np.uint64)
    fold = np.arange(len(y)) % 20 % 4
    assert sorted(found[1]) == [0, 1, 2, 3]
    for k in range(4):
        want = twin(keys, x, y, fold, k, training).flat()
        assert np.allclose(found[1][k].flat(), want, atol=1e-9) and np.allclose(found[20][k].flat(), want, atol=1e-9)


def test_scores_are_out_of_fold_and_learn(spark, tmp_path):
    df, x, y = table(spark, n=400)
    rows = N.keyed(df, F.col("x"), "user", "day", fold=F.col("fold"))
    nets = N.fit(rows, N.Training(hidden=(16,), epochs=40, batches=2, rate=1e-2, dropout=0.1))
    prob = np.zeros(len(y))
    for r in N.scores(rows, nets, "user", "day").collect():
        prob[r.day] = r.prob
    fold = np.arange(len(y)) % 20 % 4
    assert np.allclose(prob, [nets[fold[i]].probabilities(x[i : i + 1])[0] for i in range(len(y))])
    order = np.argsort(prob)
    ranks = np.empty(len(y))
    ranks[order] = np.arange(len(y))
    auc = (ranks[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.9
    nets[0].save(spark, str(tmp_path / "net"))
    assert (N.Network.load(spark, str(tmp_path / "net")).probabilities(x) == nets[0].probabilities(x)).all()


@pytest.mark.parametrize("alpha", [None, 0.75])
def test_gradient_is_the_slope_of_the_loss(alpha):
    training = N.Training(hidden=(5, 3), alpha=alpha, dropout=0.3)
    rng = np.random.default_rng(1)
    net = N.initial((4, 5, 3, 1), np.zeros(4), np.ones(4), 0)
    keys, x, y = rng.integers(0, 2**63, 12).astype(np.uint64), rng.normal(size=(12, 4)), rng.integers(0, 2, 12)
    _, slope = N.gradient(net, keys, x, y, 7, training)
    flat = net.flat()
    for i in range(len(flat)):
        ends = [N.gradient(net.with_flat(flat + d * (np.arange(len(flat)) == i)), keys, x, y, 7, training)[0] for d in (-1e-6, 1e-6)]
        assert slope[i] == pytest.approx((ends[1] - ends[0]) / 2e-6, abs=1e-5)


def test_focal_loss_equals_the_column(spark):
    from behaviorlens.operators.training import focal_loss

    p, y = np.linspace(0.01, 0.99, 30), np.arange(30) % 2
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    want = [r[0] for r in rows.select(focal_loss(F.col("p"), F.col("y"))).collect()]
    assert N.losses(p, y, 0.75, 2.0)[0] == pytest.approx(want)


def test_dropped_units_keep_the_sum():
    masks = N._masks(np.arange(2000, dtype=np.uint64), [64], 5, N.Training(dropout=0.4))[0]
    assert abs((masks == 0).mean() - 0.4) < 0.01 and abs(masks.mean() - 1) < 0.02
    again = N._masks(np.arange(2000, dtype=np.uint64)[::-1], [64], 5, N.Training(dropout=0.4))[0]
    assert (again[::-1] == masks).all()


def test_a_correction_lowers_its_score_and_moves_others_within_the_bound(spark):
    df, x, y = table(spark, n=300)
    rows = N.keyed(df, F.col("x"), "user", "day")
    net = N.fit(rows, N.Training(hidden=(16, 8), epochs=20, rate=1e-2))[-1]
    before = net.probabilities(x)
    worst = int(before.argmax())
    moved = N.corrected(net, rows.where(F.col("day") == worst).withColumn("label", F.lit(0)))
    after = moved.probabilities(x)
    assert after[worst] < before[worst]
    assert (np.abs(after - before) <= N.reach(net, moved, x) + 1e-12).all() and np.abs(after - before).max() < 0.05
    assert np.abs(moved.flat() - net.flat()).max() <= 3 * 1e-4 * 1.01
    same = N.corrected(net, rows.where("day < 0"))
    assert (same.flat() == net.flat()).all()


def test_no_rows(spark):
    df, _, _ = table(spark)
    with pytest.raises(ValueError):
        N.fit(N.keyed(df.limit(0), F.col("x"), "user", "day"))


def test_passes_take_blocks_and_all_cores(spark, tmp_path):
    from behaviorlens.operators import models as M

    df, x, y = table(spark, n=300)
    rows = N.keyed(df, F.col("x"), "user", "day")
    blocks = N.packed(rows.coalesce(1)).collect()
    assert len(blocks) == 1 and blocks[0].n == 300  # a task passes on one row for many
    got = sorted(map(tuple, np.frombuffer(blocks[0].x).reshape(300, -1).tolist()))
    assert got == sorted(map(tuple, x.tolist())) and np.frombuffer(blocks[0].label).sum() == y.sum()
    spark.range(0, 3 * M.PART_ROWS, 1, 4).write.parquet(str(tmp_path / "rows"))
    assert M.compact(spark.read.parquet(str(tmp_path / "rows"))).rdd.getNumPartitions() == 3
