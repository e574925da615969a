import math
import random

import pytest
from pyspark.sql import functions as F

from gridmeld.operators import fields, search


def brute(raw, target, most):
    """All (diff, dy, dx, n) by plain loops."""
    out = []
    for dy in range(most + 1):
        for dx in range(most + 1):
            met = [(raw[y + dy, x + dx], w) for (y, x), w in target.items() if (y + dy, x + dx) in raw]
            if met:
                lo, hi = min(v for v, _ in met), max(v for v, _ in met)
                out.append((sum(abs(((v - lo) / (hi - lo) if hi > lo else v) - w) for v, w in met) / len(met), dy, dx, len(met)))
    return out


def frame(spark, cells, key=None):
    rows = [(y, x, float(v)) for (y, x), v in cells.items()]
    df = spark.createDataFrame(rows, "y int, x int, value double")
    return df if key is None else df.withColumn("m", F.lit(key))


def test_pieces_cover_each_run_once(spark):
    target = {(y, x): y + x for y in range(3) for x in range(23) if (y, x) not in ((1, 4), (1, 11), (2, 0))}
    got = [r.asDict() for r in search.pieces(frame(spark, target)).collect()]
    covered = [(r["y"], r["x"] + i) for r in got for i in range(2 ** r["k"])]
    assert sorted(covered) == sorted(target) and all(r["n_want"] == 2 ** r["k"] for r in got)
    assert all(r["want"] == sum(target[r["y"], r["x"] + i] for i in range(2 ** r["k"])) for r in got)


def test_spans_are_ranges_and_sums(spark):
    rng = random.Random(1)
    raw = {(y, x): rng.random() for y in range(4) for x in range(20) if rng.random() < 0.7}
    got = {(r["k"], r["y"], r["x"]): r for r in search.spans(frame(spark, raw), 3).collect()}
    for k in range(4):
        for y in range(4):
            for x in range(-7, 20):
                part = [raw[y, c] for c in range(x, x + 2**k) if (y, c) in raw]
                if not part:
                    assert (k, y, x) not in got
                    continue
                r = got[k, y, x]
                assert (r["lo"], r["hi"], r["n"]) == (min(part), max(part), len(part)) and r["total"] == pytest.approx(sum(part))


@pytest.mark.parametrize("kind", ["smooth", "noise", "constant"])
def test_the_best_offset_is_that_of_all(spark, kind):
    """Gaps in both grids; a constant field has the same difference everywhere and the first offset wins."""
    rng = random.Random(7)
    value = {"smooth": lambda y, x: math.sin(y / 5) + math.cos(x / 7), "noise": lambda y, x: rng.randrange(100), "constant": lambda y, x: 3.0}[kind]
    raw = {(y, x): value(y, x) for y in range(24) for x in range(24) if rng.random() < 0.95}
    target = {(y, x): raw.get((y + 3, x + 6), 0.5) for y in range(14) for x in range(14) if rng.random() < 0.8}
    lo, hi = min(target.values()), max(target.values())
    target = {c: (v - lo) / (hi - lo) if hi > lo else 1.0 for c, v in target.items()}
    got = search.find_offset(frame(spark, raw), frame(spark, target), 8, 8, complete_only=False).collect()
    want = min((round(d, 9), dy, dx, n) for d, dy, dx, n in brute(raw, target, 8))
    assert [(round(r["diff"], 9), r["dy"], r["dx"], r["n_valid"]) for r in got] == [want]


def test_fewer_rows_than_cells_times_offsets(spark):
    """Two maps with a target each; the joins together give a fraction of the rows of the plain search."""
    bump = lambda y, x, s: math.sin((y + s) / 6) * 2 + math.cos((x - s) / 5) + (y * x % 7) / 40
    grids = {m: {(y, x): bump(y, x, s) for y in range(40) for x in range(40)} for m, s in (("a", 0), ("b", 3))}
    targets = {m: {(y, x): grids[m][y + dy, x + dx] for y in range(25) for x in range(25)} for m, dy, dx in (("a", 4, 9), ("b", 13, 2))}
    for m, t in targets.items():
        lo, hi = min(t.values()), max(t.values())
        targets[m] = {c: (v - lo) / (hi - lo) for c, v in t.items()}
    both = lambda g: frame(spark, g["a"], "a").unionByName(frame(spark, g["b"], "b"))
    rows = []
    best = search.find_offset(both(grids), both(targets), 15, 15, ["m"], trace=rows)
    got = {r["m"]: (r["dy"], r["dx"], r["n_valid"]) for r in best.collect()}
    assert got == {"a": (4, 9, 625), "b": (13, 2, 625)}
    assert sum(rows) < 0.4 * 2 * 625 * 256
    out = fields.align_fields(both(grids), both(targets), {}, both(grids).withColumnRenamed("value", "e0"), 15, 15, 25, 40, ["m"], best=best)
    assert out.where("abs(scaled) <= 1").count() == 2 * 625


def test_empty_and_incomplete_grids_have_no_offset(spark):
    raw = {(y, x): y * x for y in range(5) for x in range(5)}
    target = {(y, x): 1.0 for y in range(6) for x in range(6)}
    none = frame(spark, raw).where("y > 99")
    assert search.find_offset(frame(spark, raw), frame(spark, target), 1, 1).collect() == []
    assert search.find_offset(none, frame(spark, target), 1, 1).collect() == []
    assert search.find_offset(frame(spark, raw), none, 1, 1, complete_only=False).collect() == []


def test_bumps_within_reach_stay_within_the_error(spark, monkeypatch):
    """Reaches over several powers of two, repeated and unusable centres, bins with many cells and centres dealt."""
    monkeypatch.setattr(fields, "SMALL_MIXTURE", 20)
    monkeypatch.setattr(fields, "PER_BIN", 10)
    rng = random.Random(3)
    centres = [(rng.choice(["a", "b", None]), rng.uniform(-5, 25), rng.uniform(-5, 25), rng.choice([0.05, 0.4, 1.3, 6.0])) for _ in range(150)]
    centres += [("a", 3.0, 4.0, 0.5)] * 40 + [("far", 900.0, 900.0, 0.1)]
    bad = [("a", None, 1.0, 1.0), ("b", 1.0, 1.0, 0.0), ("b", 1.0, 1.0, -1.0), ("b", 1.0, 1.0, None)]
    cells = [(m, y, x) for m in ("p", "q") for y in range(20) for x in range(12)]
    df = spark.createDataFrame(cells, "m string, y int, x int")
    got = fields.mixture(df, spark.createDataFrame(centres + bad, "element string, mux double, muy double, sigma double"), ["m"], error=1e-6)
    got = {(r["m"], r["y"], r["x"], r["element"]): r["value"] for r in got.collect()}
    assert len(got) == len(cells) * 4
    for m, y, x in cells:
        for name in ("a", "b", None, "far"):
            want = sum(math.exp(-((x - a) ** 2 + (y - b) ** 2) / (2 * s * s)) for c, a, b, s in centres if c == name)
            assert -1e-9 < want - got[m, y, x, name] < 1e-6
