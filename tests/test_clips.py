"""Clip reports on small hand-made frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomframe.operators import clips, quality

FRAME = "clip_id BIGINT, frame_idx BIGINT, width INT, height INT, duration_ms INT, rgba ARRAY<INT>"


def solid(r, g, b, n=16):
    return [r, g, b, 255] * n


@pytest.fixture(scope="module")
def frames(spark):
    rows = [
        (1, 0, 4, 4, 100, solid(0, 0, 0)),
        (1, 1, 4, 4, 200, solid(255, 0, 0)),
        (2, 0, 4, 4, 100, solid(9, 9, 9)),
        (2, 1, 4, 4, 200, solid(20, 9, 9)),
        (2, 2, 4, 4, 100, solid(30, 9, 9)),
        (3, 0, 4, 4, 100, solid(1, 2, 3)),
        (4, 0, 1, 2, 50, [10, 0, 0, 255, 13, 1, 0, 255]),
    ]
    return spark.createDataFrame(rows, FRAME)


def by_clip(df):
    return {r["clip_id"]: r for r in df.collect()}


def test_timing(frames):
    t = by_clip(clips.clip_timing(frames))
    assert (t[1].frame_count, t[1].total_ms) == (2, 300)
    assert t[1].effective_fps == pytest.approx(6.6666667)
    assert not t[2].timing_is_uniform and t[3].timing_is_uniform


def test_histogram(frames):
    h = by_clip(clips.duration_histogram(frames))
    assert [tuple(b) for b in h[2].duration_histogram] == [(100, 2), (200, 1)]


def test_motion_and_single_frame(frames):
    motion = clips.frame_motion(frames)
    assert {(r.clip_id, r.frame_idx): r.motion for r in motion.collect()}[(1, 1)] == 85.0
    stats = by_clip(clips.motion_stats(motion, clips.clip_timing(frames)))
    assert stats[3].motion_mean == 0.0 and stats[3].motion_p99 == 0.0


def test_motion_over_block_edges(spark, monkeypatch):
    monkeypatch.setattr(clips, "FRAME_BLOCK", 3)
    rows = [(7, i, 1, 1, 10, [i * i % 251, 0, 0, 255]) for i in range(20)]
    found = clips.frame_motion(spark.createDataFrame(rows, FRAME)).orderBy("frame_idx").collect()
    want = [abs(i * i % 251 - (i - 1) ** 2 % 251) / 3 for i in range(1, 20)]
    assert [r.motion for r in found] == pytest.approx(want)


def test_corner_color_repeats_corners_of_narrow_frames(frames):
    c = by_clip(clips.corner_color(frames))
    assert (c[3].corner_r, c[3].corner_g, c[3].corner_b) == (1, 2, 3)
    # (10 + 10 + 13 + 13) / 4 = 11.5 goes to the even 12, (0 + 0 + 1 + 1) / 4 = 0.5 to 0.
    assert (c[4].corner_r, c[4].corner_g) == (12, 0)


def test_first_last(frames):
    d = by_clip(clips.first_last_difference(frames))
    assert d[2].first_last_difference == 7.0 and d[3].first_last_difference == 0.0


def test_palette(frames):
    assert by_clip(clips.max_palette(frames))[4].max_palette_colors == 2


def test_temporal_gate(spark):
    values = [10] * 10 + [200] + [10] * 3
    rows = [(1, i, 1, 1, 10, [v, v, v, v]) for i, v in enumerate(values)]
    rows += [(2, i, 1, 1, 10, [5, 5, 5, 5]) for i in range(4)]
    gate = by_clip(clips.temporal_gate(spark.createDataFrame(rows, FRAME)))
    assert not gate[1].passed and gate[1].spike_index == 10
    assert gate[2].passed and gate[2].spike_index is None


@pytest.mark.parametrize(
    "limits, reason, frame",
    [
        (dict(max_frames=1), "frame_limit", 1),
        (dict(max_total_pixels=1), "pixel_budget", 0),
        (dict(max_canvas_pixels=1), "canvas_limit", None),
        (dict(max_input_bytes=10), "input_bytes", None),
        ({}, None, None),
    ],
)
def test_decode_budget(spark, frames, limits, reason, frame):
    files = spark.createDataFrame([(1, 64), (9, 64)], "clip_id BIGINT, size_bytes BIGINT")
    verdict = by_clip(clips.decode_budget(frames, files, clips.DecodeLimits(**limits)))
    assert (verdict[1].reason, verdict[1].breach_frame) == (reason, frame)
    assert verdict[9].reason in ("no_frames", "input_bytes")


def test_report_hides_figures_of_rejected_clips(spark, frames):
    files = spark.createDataFrame([(1, 64), (2, 10**9)], "clip_id BIGINT, size_bytes BIGINT")
    report = by_clip(clips.analyze_clips(frames, files))
    assert report[1].motion_max == 85.0 and report[1].reason is None
    assert report[2].reason == "input_bytes" and report[2].motion_max is None


def test_frame_timings(spark):
    plans = spark.createDataFrame([(1, 1.48, 25.0), (2, 0.01, 300.0)], "clip_id INT, total_s DOUBLE, fps DOUBLE")
    rows = clips.frame_timings(plans).collect()
    first = [r for r in rows if r.clip_id == 1]
    assert len(first) == 37 and {r.delay_cs for r in first} == {4}
    assert [r.reason for r in rows if r.clip_id == 2] == ["too_short"]


def test_alpha_bounds(spark):
    rows = [(1, 0, y, x, 0.5 if (x, y) in ((1, 2), (3, 1)) else 0.0) for y in range(4) for x in range(5)]
    rows += [(2, 0, 0, 0, 0.0)]
    px = spark.createDataFrame(rows, "clip_id INT, frame_idx INT, y INT, x INT, a DOUBLE")
    box = by_clip(clips.alpha_bounds(px))
    assert (box[1].x0, box[1].y0, box[1].x1, box[1].y1) == (1, 1, 4, 3)
    assert box[2].x0 is None


def test_packing_round_trip(frames):
    again = clips.to_frames(clips.to_pixels(frames)).select("clip_id", "frame_idx", "rgba")
    want = frames.select("clip_id", "frame_idx", "rgba")
    assert again.exceptAll(want).count() == 0 and want.exceptAll(again).count() == 0


def test_quality_gate_limits(spark):
    row = dict(
        exists=True, size_bytes=2_400_000, probe_error=None, has_video=True, width=320, height=320,
        rate="30/1", duration_s=6.0, frames=180,
    )
    cases = [
        (row, True),
        ({**row, "size_bytes": 2_400_001}, False),
        ({**row, "rate": "30/0"}, False),
        ({**row, "rate": "305/10"}, True),
        ({**row, "duration_s": 6.36}, False),
        ({**row, "frames": 0}, False),
        ({**row, "exists": False}, False),
    ]
    schema = (
        "exists BOOLEAN, size_bytes BIGINT, probe_error STRING, has_video BOOLEAN, width INT, "
        "height INT, rate STRING, duration_s DOUBLE, frames INT, no INT"
    )
    df = spark.createDataFrame([{**c, "no": i} for i, (c, _) in enumerate(cases)], schema)
    got = {r.no: r for r in quality.quality_gate(df).collect()}
    assert [got[i].valid for i in range(len(cases))] == [ok for _, ok in cases]
    assert got[1].checks == ["size"] and got[6].checks == ["missing"]


def test_aspect_class(spark):
    df = spark.createDataFrame([(1080, 1920), (640, 480), (500, 510), (300, 100)], "w INT, h INT")
    got = [r[0] for r in df.select(quality.aspect_class(F.col("w"), F.col("h"))).collect()]
    assert got == ["9:16", "4:3", "1:1", "other"]
