import random

import numpy as np

from ledgerloom.llm import consensus as co
from ledgerloom.plans.materialise import Cuts

SCHEMA = "judge string, item string, label string, at int"


def votes(seed=3, n=400):
    rng = random.Random(seed)
    truth, rows = {}, []
    skill = {"j1": 0.9, "j2": 0.85, "j3": 0.8, "j4": 0.75, "noise": 0.0, "invert": -1, "always": None}
    for i in range(n):
        z = truth[f"t{i}"] = rng.choices(["A", "B", "tie"], [45, 45, 10])[0]
        for j, s in skill.items():
            if rng.random() < 0.2:
                continue
            if s is None:
                v = "A"
            elif s < 0:
                v = {"A": "B", "B": "A"}.get(z, "tie") if rng.random() < 0.8 else rng.choice(["A", "B"])
            else:
                v = z if rng.random() < s else rng.choice(["A", "B", "tie"])
            rows.append((f" {j.upper()} " if i % 7 == 0 else j, f"t{i}", v.lower() + "\n" if i % 5 == 0 else v, i))
    return truth, rows


def test_accuracy_and_skills(spark):
    truth, rows = votes()
    per_item, judges = co.consensus(spark, spark.createDataFrame(rows, SCHEMA))
    got = {r.item: r.label for r in per_item.collect()}
    assert sum(got[t] == z for t, z in truth.items() if t in got) / len(got) > 0.93
    s = {r.judge: r.skill for r in judges.collect()}
    assert s["j1"] > 0.6 and abs(s["noise"]) < 0.2 and abs(s["always"]) < 0.2 and s["invert"] < -0.2
    assert set(s) == {"j1", "j2", "j3", "j4", "noise", "invert", "always"}


def test_edges(spark):
    rows = [("a", "t1", "A", 1), ("a", "t1", "B", 2), (None, "t1", "A", 3), ("b", None, "A", 1), ("b", "t2", "maybe", 1), ("b", "t2", None, 1), ("b", "t3", " TIE ", 1), ("c", "gone", "A", 1), ("d", "t4", "A", 5), ("d", "t4", "B", 5)]
    items = spark.createDataFrame([("t1",), ("t1",), ("t2",), ("t3",), ("t4",), (None,)], "item string")
    per_item, judges = co.consensus(spark, spark.createDataFrame(rows, SCHEMA), items)
    assert {r.item: (r.label, r.n_votes) for r in per_item.collect()} == {"t1": ("B", 1), "t3": ("tie", 1), "t4": ("B", 1)}
    assert {r.judge for r in judges.collect()} == {"a", "b", "d"}


def test_empty(spark):
    per_item, judges = co.consensus(spark, spark.createDataFrame([], SCHEMA))
    assert per_item.count() == 0 and judges.count() == 0


def test_leading_vectors(spark):
    """Against dense eigenvectors: one plain, one whose largest eigenvalue in size is negative, one of all zeros."""
    rng = np.random.default_rng(4)
    u = rng.random(9) + 0.2
    plain = np.outer(u, u) + 0.02 * rng.normal(size=(9, 9))
    negative = 0.3 * np.outer(u, u) - 5 * np.diag(np.arange(9) / 9.0)
    ms = {"A": (plain + plain.T) / 2, "B": negative, "tie": np.zeros((9, 9))}
    rows = [(z, f"j{i}", f"j{j}", float(m[i, j])) for z, m in ms.items() for i in range(9) for j in range(9)]
    judges = spark.createDataFrame([(z, f"j{i}") for z in ms for i in range(9)], "label string, judge string")
    out, _, left = co.leading_vectors(Cuts(spark, "t"), spark.createDataFrame(rows, "label string, i string, j string, x double"), judges)
    got = {(r.label, r.judge): r.v for r in out.collect()}
    assert not left
    for z in ("A", "B"):
        v = np.linalg.eigh(ms[z])[1][:, -1]
        mine = np.array([got[z, f"j{i}"] for i in range(9)])
        assert abs(abs(mine @ v) - 1) < 1e-4 and abs(np.linalg.norm(mine) - 1) < 1e-6


def test_no_skill_leaves_it_to_the_votes(spark):
    rows = [(f"j{j}", "t1", "tie" if j < 3 else "A", 1) for j in range(5)]
    per_item, _ = co.consensus(spark, spark.createDataFrame(rows, SCHEMA))
    assert per_item.first().label == "tie"
