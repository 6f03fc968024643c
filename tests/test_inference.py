"""Inference with missing evidence against the sum over all combinations of a whole network."""

import numpy as np
import pytest

from eventflow.operators import inference
from eventflow.operators.inference import Variable

N = 20


def random_network(seed):
    rng = np.random.default_rng(seed)
    net = {}
    for i in range(N):
        parents = tuple(f"v{p}" for p in sorted(rng.choice(i, size=min(i, int(rng.integers(0, 4))), replace=False).tolist()))
        first = rng.uniform(0.05, 0.95, [2] * len(parents))
        net[f"v{i}"] = Variable(f"v{i}", parents, (0, 1), np.stack([first, 1 - first], axis=-1))
    return net


def joint_of(net):
    joint = np.ones([2] * N)
    for i in range(N):
        v = net[f"v{i}"]
        axes = [int(p[1:]) for p in v.parents] + [i]
        shape = [2 if a in axes else 1 for a in range(N)]
        joint = joint * np.transpose(v.table, np.argsort(axes)).reshape(shape)
    return joint


def enumerated(joint, question, known):
    part = joint[tuple(known.get(f"v{i}", slice(None)) for i in range(N))]
    left = [f"v{i}" for i in range(N) if f"v{i}" not in known]
    sums = part.sum(axis=tuple(a for a, n in enumerate(left) if n != question))
    return sums / sums.sum()


def table(spark, net, name):
    v = net[name]
    rows = [(*map(int, at), float(p)) for at, p in np.ndenumerate(v.table) for at in [at]]
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in (*v.parents, name)) + ", p double")


@pytest.mark.parametrize("seed", [1, 2])
def test_twenty_variables(spark, seed):
    net = random_network(seed)
    joint = joint_of(net)
    rng = np.random.default_rng(seed)
    columns = [f"v{i}" for i in range(1, N, 2)]
    rows = [(i, *[None if rng.random() < 0.4 else int(rng.integers(2)) for _ in columns]) for i in range(80)]
    rows += [(1000, *[None] * len(columns)), (1001, *[1] * len(columns))] + [(2000 + i, *rows[0][1:]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} long" for c in columns))
    read = inference.network({name: (list(v.parents), table(spark, net, name)) for name, v in net.items()})
    got = {(r.id, r.value): r.p for r in inference.infer(df, read, "v0", columns).collect()}
    assert len(got) == 2 * len(rows)
    for i, *values in rows:
        want = enumerated(joint, "v0", {c: v for c, v in zip(columns, values) if v is not None})
        assert abs(got[i, 0] - want[0]) < 1e-9 and abs(got[i, 1] - want[1]) < 1e-9


def test_long_chain_stays_small():
    """Sixty variables in a row: with early sums no factor has more than two of them."""
    step = np.array([[0.9, 0.1], [0.2, 0.8]])
    net = {"v0": Variable("v0", (), (0, 1), np.array([0.3, 0.7]))}
    for i in range(1, 60):
        net[f"v{i}"] = Variable(f"v{i}", (f"v{i - 1}",), (0, 1), step)
    got = inference.posterior(net, "v0", {"v59": np.array([0, 1])})
    power = np.linalg.matrix_power(step, 59)
    want = np.array([0.3, 0.7])[:, None] * power
    assert np.allclose(got, (want / want.sum(axis=0)).T)
    assert inference.relevant(net, "v3", frozenset(["v5"])) == {f"v{i}" for i in range(6)}


def test_min_fill_prefers_what_links_least():
    star = [{"hub", f"leaf{i}"} for i in range(5)]
    assert inference.min_fill(star, {"hub", "leaf0", "leaf1"})[:2] == ["leaf0", "leaf1"]


def test_unknown_values_and_impossible_evidence(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "a string, p double")
    b = spark.createDataFrame([("x", True, 1.0), ("y", False, 1.0)], "a string, b boolean, p double")
    c = spark.createDataFrame([(True, 1, 1.0), (False, 2, 1.0)], "b boolean, c long, p double")
    net = inference.network({"a": ([], a), "b": (["a"], b), "c": (["b"], c)})
    rows = spark.createDataFrame([(1, True, None), (2, None, None), (3, True, 2), (4, None, 77)], "id int, b boolean, c long")
    got = sorted((r.id, r.value, r.p) for r in inference.infer(rows, net, "a", ["b", "c"]).collect() if r.value)
    assert got == [(1, "x", 1.0), (1, "y", 0.0), (2, "x", 0.5), (2, "y", 0.5)]
    assert inference.infer(rows, net, "a", ["b", "c"]).where("id > 2 AND value IS NULL AND p IS NULL").count() == 2
    assert inference.infer(rows.limit(0), net, "a", ["b", "c"]).count() == 0


def test_large_tables_are_refused(spark, monkeypatch):
    monkeypatch.setattr(inference, "MOST_CELLS", 3)
    with pytest.raises(ValueError):
        inference.network({"v": ([], spark.createDataFrame([(i, 0.1) for i in range(5)], "v long, p double"))})
