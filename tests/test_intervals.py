"""Windows, hysteresis and gap merging: literals, and random series against a plain loop."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from earmark.operators.intervals import activity_intervals, slice_for
from earmark.operators.windows import cadence_bounds, sliding_windows

SCHEMA = (
    "clip_id int, canonical_label string, window_idx long, start_s double, end_s double, score double, "
    "threshold double, release_ratio double, gap_s double, min_duration_s double, min_windows int"
)


def table(spark, series, rule):
    rows = [
        (clip, "x", i, float(a), float(b), float(s), *rule)
        for clip, windows in series.items()
        for i, (a, b, s) in enumerate(windows)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def loop(windows, threshold, ratio, gap, min_duration, min_windows):
    """Straightforward reference for one series."""
    on, ranges = False, []
    for _, (a, b, s) in sorted(enumerate(windows), key=lambda w: (w[1][0], w[0])):
        on = s >= threshold or (on and s >= threshold * ratio)
        if not on:
            continue
        if ranges and a <= ranges[-1][1] + gap:
            ranges[-1][1] = max(ranges[-1][1], b)
            ranges[-1][2].append(s)
        else:
            ranges.append([a, b, [s]])
    return [
        (a, b, max(x), sum(x) / len(x), len(x))
        for a, b, x in ranges
        if b - a >= min_duration and len(x) >= min_windows
    ]


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.clip_id, []).append((r.start_s, r.end_s, r.peak_score, r.confidence, r.n_windows))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("slice_rows", [None, 3.0])
def test_gap_of_two_seconds(spark, slice_rows):
    df = table(spark, {1: [(0, 2, 0.7), (2, 4, 0.8), (8, 10, 0.9)]}, (0.5, 1.0, 2.0, 0.0, 1))
    got = result(activity_intervals(df, slice_rows=slice_rows))[1]
    assert [x[:2] for x in got] == [(0.0, 4.0), (8.0, 10.0)]


@pytest.mark.parametrize("slice_rows", [None, 4.0])
def test_hysteresis_and_duration(spark, slice_rows):
    df = table(spark, {1: [(0, 10, 0.7), (5, 15, 0.55), (10, 20, 0.45), (20, 30, 0.2)]}, (0.6, 0.75, 1.0, 10.0, 1))
    (only,) = result(activity_intervals(df, slice_rows=slice_rows))[1]
    assert only[:2] == (0.0, 20.0) and 0.5 < only[3] < 0.7


window = st.tuples(
    st.integers(0, 40).map(lambda x: x / 2), st.sampled_from([0.5, 1.0, 3.0, 12.0]), st.integers(0, 10).map(lambda x: x / 10)
).map(lambda t: (t[0], t[0] + t[1], t[2]))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.lists(window, min_size=1, max_size=25), min_size=20, max_size=20),
    st.sampled_from([0.0, 0.5, 2.0]),
    st.sampled_from([1.0, 0.6]),
    st.sampled_from([0.5, 2.5, 7.0]),
)
def test_sliced_and_plain_equal_a_loop(spark, series, gap, ratio, slice_rows):
    rule = (0.6, ratio, gap, 1.0, 2)
    data = dict(enumerate(series))
    expected = {k: sorted(x) for k, v in data.items() if (x := loop(v, 0.6, ratio, gap, 1.0, 2))}
    df = table(spark, data, rule)
    for length in (None, slice_rows):
        got = result(activity_intervals(df, slice_rows=length))
        assert got.keys() == expected.keys()
        for k in expected:
            assert len(got[k]) == len(expected[k])
            for a, b in zip(got[k], expected[k]):
                assert a == pytest.approx(b)


def test_slices_only_for_oversized_keys(spark):
    df = table(spark, {1: [(i, i + 1, 0.7) for i in range(9)]}, (0.5, 1.0, 2.0, 0.0, 1))
    assert slice_for(df, ["clip_id"], limit=9) is None
    assert slice_for(df, ["clip_id"], limit=8) is not None


def test_short_clip_is_one_window(spark):
    clips = spark.createDataFrame([("a", 16000, 16000)], "clip_id string, n_samples int, sample_rate int")
    assert [tuple(r)[1:] for r in sliding_windows(clips, 10.0, 5.0).collect()] == [(0, 0.0, 1.0)]


def test_sliding_windows_equal_a_loop(spark):
    sizes = [1, 2, 9, 10, 11, 14, 15, 16, 40, 41]
    clips = spark.createDataFrame([(n, n, 10) for n in sizes], "clip_id int, n_samples int, sample_rate int")
    for window_s, hop_s in ((1.0, 0.5), (0.5, 1.0), (0.25, 0.1)):
        size, hop = max(1, round(window_s * 10)), max(1, round(hop_s * 10))
        expected = set()
        for n in sizes:
            for k, start in enumerate(range(0, n, hop)):
                end = min(start + size, n)
                expected.add((n, k, start / 10, end / 10))
                if end == n:
                    break
        assert {tuple(r) for r in sliding_windows(clips, window_s, hop_s).collect()} == expected
    with pytest.raises(ValueError):
        sliding_windows(clips, 0.0, 1.0)


def test_cadence(spark):
    df = spark.createDataFrame([(0, 2.5), (1, 2.5)], "window_idx int, duration_s double")
    got = [(round(r.start_s, 3), round(r.end_s, 3)) for r in cadence_bounds(df, 16000).orderBy("window_idx").collect()]
    assert got == [(0.0, 2.048), (0.992, 2.5)]
