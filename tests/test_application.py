"""Searches among allowed partners, designs of blocks, and the run that goes on where it stopped."""

import math
import random
from pathlib import Path

from panelmill.operators import design, spatial
from panelmill.plans import application

DATA = "/root/testdata/sf0.001"


def brute(left, right):
    out = {}
    for k, i, x, y, tag in left:
        met = [(math.dist((x, y), (u, v)), j) for q, j, u, v, other in right if q == k and j != i and None not in (u, v) and (tag is None or other is None or tag != other)] if None not in (k, x, y) else []
        if met:
            h, j = min(met)
            out[k, i] = (j, round(h, 3))
    return out


def test_nearest_allowed(spark):
    rng = random.Random(4)
    kind = "k string, loc long, x double, y double, tag int, extra string"
    left = [(rng.choice("ab"), i, rng.uniform(0, 9), rng.uniform(0, 1), rng.choice([1, 2, None])) for i in range(60)]
    right = [(rng.choice("ab"), i + 40, rng.uniform(0, 9), rng.uniform(0, 1), rng.choice([1, 2, None])) for i in range(80)]
    left += [("c", 900, 1.0, 1.0, None), ("d", 901, 1.0, 1.0, 5), (None, 902, 1.0, 1.0, None), ("a", 903, None, 1.0, None), ("a", 904, 1.0, 1.0, 1), ("a", 904, 1.0, 1.0, 1)]
    right += [("d", 950, 2.0, 1.0, 5), ("a", 960, None, 1.0, None), ("a", 961, 1.0, 1.0, 2), ("a", 962, 1.0, 1.0, 2), ("e", 970, 5e3, 5e3, None)]
    frame = lambda rows: spark.createDataFrame([(*r, "z") for r in rows], kind)
    for width in (None, 0.01, 1e6):
        got = spatial.nearest_allowed(frame(left), frame(right), "k", width=width).collect()
        assert {(r["k"], r["loc"]): (r["nearest"], r["dist"]) for r in got} == brute(left, right) and len(got) == len(brute(left, right))
    assert spatial.nearest_allowed(frame(left), frame([]), "k").count() == 0
    assert spatial.nearest_allowed(frame([]), frame(right), "k").count() == 0


def test_pulse_columns(spark):
    times = spark.createDataFrame([(t, t * 7) for t in range(6)], "t int, day int")
    events = spark.createDataFrame([("a", 8), ("end", 35), ("never", 99)], "event string, day int")
    p = design.pulse_columns(times, events, ["a", "end", "never"])
    assert p.columns == ["t", "pulse_a", "pulse_a_next", "pulse_end"]
    rows = {r["t"]: tuple(r)[1:] for r in p.collect()}
    assert rows == {t: (float(t == 2), float(t == 3), float(t == 5)) for t in range(6)}


def test_block_design(spark):
    rows = [("p", t, t < 2, 10.0 * t, None if t == 4 else -1.0 * t) for t in range(7)] + [("q", t, False, 1.0, 2.0) for t in range(2)]
    cases = spark.createDataFrame(rows, "loc string, t int, presample boolean, u double, w double")
    d, blocks = design.block_design(cases, ["loc"], {"own": "u", "nb": "w", "none": "u"}, {"own": [1, 3], "nb": [2], "none": []}, ["u"])
    assert blocks == {"own": ["own_l1", "own_l3"], "nb": ["nb_l2"]}
    got = {r["t"]: (r["own_l1"], r["own_l3"], r["nb_l2"]) for r in d.collect()}
    assert got == {t: (10.0 * (t - 1), 10.0 * (t - 3), None if t == 6 else -1.0 * (t - 2)) for t in range(3, 7)}


def test_run_goes_on_where_it_stopped(spark, tmp_path):
    folder = str(tmp_path / "run")
    first = sorted(map(str, application.run(spark, DATA, folder).collect()))
    marks = {p.parent.name: p.stat().st_mtime_ns for p in Path(folder).glob("*/_SUCCESS")}
    assert {"stations", "prices", "pulses", "pairs", "completed", "cases", "tests"} <= set(marks)
    (Path(folder) / "cases" / "_SUCCESS").unlink()
    (Path(folder) / "tests" / "_SUCCESS").unlink()
    assert sorted(map(str, application.run(spark, DATA, folder).collect())) == first and first
    again = {p.parent.name: p.stat().st_mtime_ns for p in Path(folder).glob("*/_SUCCESS")}
    assert all((again[n] == marks[n]) == (n not in ("cases", "tests")) for n in ("stations", "prices", "pairs", "completed", "cases", "tests"))
    done = spark.read.parquet(f"{folder}/completed")
    assert done.where("filled IS NULL").isEmpty() and not done.where("rel IS NULL").isEmpty() and done.where("rel != filled").isEmpty()
