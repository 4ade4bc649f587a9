"""The matching rule against its plain loop, on both execution paths."""

import random

import pytest

from retroscope.operators import matching


def plain_loop(treated, control, caliper):
    free, pairs = set(range(len(control))), []
    for i, t in enumerate(treated):
        best = min(((abs(t - control[j]), j) for j in free), default=None)
        if best and best[0] <= caliper:
            pairs.append((i, best[1]))
            free.discard(best[1])
    return sorted(pairs)


def frame(spark, treated, control):
    rows = [(i, 1, s) for i, s in enumerate(treated)] + [(j, 0, s) for j, s in enumerate(control)]
    return spark.createDataFrame(rows, "i long, side int, s double")


def match(spark, treated, control, caliper, **kw):
    pairs = matching.match_nearest(frame(spark, treated, control), "i", "side", "s", caliper, **kw).collect()
    return sorted((p["treated_index"], p["control_index"]) for p in pairs)


def test_rule_alone_against_the_loop():
    import numpy as np
    rng = random.Random(0)
    for case in range(300):
        digits = rng.choice([1, 2, 6])
        treated = [round(rng.random(), digits) for _ in range(rng.randint(0, 25))]
        control = [round(rng.random(), digits) for _ in range(rng.randint(0, 25))]
        caliper = rng.choice([.02, .1, .5])
        got = matching._take_turns(np.arange(len(treated)), np.array(treated), np.arange(len(control)), np.array(control), caliper)
        assert sorted(got) == plain_loop(treated, control, caliper), case


@pytest.mark.parametrize("digits", [6, 1])
def test_components(spark, digits):
    rng = random.Random(4)
    treated = [round(rng.random(), digits) for _ in range(40)]
    control = [round(rng.random(), digits) for _ in range(60)]
    assert match(spark, treated, control, .01) == plain_loop(treated, control, .01)
    assert match(spark, treated, [], .01) == []


@pytest.mark.parametrize("seed,digits", [(1, 6), (2, 1)])
def test_deferred_acceptance_rounds(spark, seed, digits):
    rng = random.Random(seed)
    treated = [round(rng.random(), digits) for _ in range(12)]
    control = [round(rng.random(), digits) for _ in range(14)]
    assert match(spark, treated, control, .1, local_rows=0) == plain_loop(treated, control, .1)


def test_rounds_do_not_grow_with_ties(spark, monkeypatch):
    """Rows of one score ask for the same controls; a round settles a whole segment of them."""
    written, cut = [], matching.cut_lineage

    def counted(df):
        written.append(1)
        assert len(written) <= 25
        return cut(df)

    monkeypatch.setattr(matching, "cut_lineage", counted)
    rng = random.Random(7)
    treated = [rng.choice([.2, .25, .3]) for _ in range(70)]
    control = [rng.choice([.2, .24, .3]) for _ in range(60)]
    assert match(spark, treated, control, .06, local_rows=15) == plain_loop(treated, control, .06)


@pytest.mark.parametrize("digits", [6, 2, 1])
def test_segments_against_the_loop(digits):
    """Every cut of the line, without Spark: the rounds end at the rule's pairs."""
    import numpy as np
    rng = random.Random(digits)
    for case in range(60):
        treated = np.array([round(rng.random(), digits) for _ in range(rng.randint(1, 40))])
        control = np.array(sorted(round(rng.random(), digits) for _ in range(rng.randint(1, 40))))
        caliper, size = rng.choice([.02, .1, .5]), rng.choice([1, 3, 10])
        # quarters of the line; a score with more controls than ``size`` has segments of its own
        many = {x for x in control if (control == x).sum() > size}
        keys = [(int(x * 4), x, (j - int(np.searchsorted(control, x))) // size) if x in many
                else (int(x * 4), max([y for y in many if y < x], default=-1), 99) for j, x in enumerate(control)]
        seg = np.array([sorted(set(keys)).index(x) for x in keys])
        ids = np.arange(len(control))
        line = matching._Segments(*[np.array([f(control[seg == k]) for k in range(seg.max() + 1)]) for f in (np.min, np.max)])
        rows = matching._enter(np.arange(len(treated)), treated, line, caliper)
        while any(r[3] is None for r in rows):
            active = {r[2] for r in rows if r[3] is None}
            rows = [r for r in rows if r[2] not in active] + [x for k in active for x in matching._settle(
                k, ids[seg == k], control[seg == k], [r for r in rows if r[2] == k], line, caliper)]
        assert sorted((r[0], r[3]) for r in rows) == plain_loop(treated, control, caliper), case
