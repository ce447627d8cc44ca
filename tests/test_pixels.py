"""Spatial and colour operators against direct array computations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import color, easing
from loomframe.operators import blending, clips, geometry, masks, palette, pixels, tracks

RNG = np.random.default_rng(3)
H, W = 5, 7
IMAGE = RNG.integers(0, 256, (H, W, 4))
FRAME = "clip_id INT, frame_idx INT, width INT, height INT, rgba ARRAY<INT>"


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(1, 0, W, H, IMAGE.ravel().tolist())]
    return spark.createDataFrame(rows, FRAME)


def image(df):
    row = df.first()
    return np.array(row.rgba, dtype=float).reshape(row.height, row.width, 4)


def test_blur_mirrors_the_border(frames):
    kernel = np.array(geometry.gaussian_kernel(5))
    padded = np.pad(IMAGE.astype(float), ((2, 2), (2, 2), (0, 0)), mode="reflect")
    rows = sum(k * padded[:, i : i + W] for i, k in enumerate(kernel))
    want = np.rint(sum(k * rows[i : i + H] for i, k in enumerate(kernel)))
    assert np.array_equal(image(geometry.blur(frames, 4)), want)


def test_kernels_are_normalised():
    for size in (1, 3, 5, 7, 9, 31):
        assert sum(geometry.gaussian_kernel(size)) == pytest.approx(1.0)


def area(img, oh, ow):
    def weights(n, o):
        w = np.zeros((o, n))
        for i in range(o):
            lo, hi = i * n / o, (i + 1) * n / o
            for k in range(n):
                w[i, k] = max(0.0, min(hi, k + 1) - max(lo, k))
        return w / w.sum(axis=1, keepdims=True)

    return np.einsum("ai,bj,ijc->abc", weights(img.shape[0], oh), weights(img.shape[1], ow), img)


def test_area_resize(frames):
    got = image(geometry.resize(frames, F.lit(3), F.lit(2), "area"))
    assert np.allclose(got, area(IMAGE.astype(float), 2, 3))


def test_cubic_resize_keeps_constant_and_linear_parts(spark):
    ramp = np.repeat(np.arange(8.0)[None, :, None] * 10, 4, axis=0) * np.ones((1, 1, 4))
    rows = [(1, 0, 8, 4, ramp.astype(int).ravel().tolist())]
    got = image(geometry.resize(spark.createDataFrame(rows, FRAME), F.lit(16), F.lit(4), "cubic"))
    inner = (np.arange(16) + 0.5) / 2 - 0.5
    assert np.allclose(got[1, 4:12, 0], inner[4:12] * 10, atol=0.5)


def test_fit_pads_and_fill_crops(frames):
    fitted = image(geometry.frame_fit(frames, 4, 4))
    # Scale 4/7: 4 x 3 pixels, placed at row (4 - 3) // 2 = 0.
    assert np.allclose(fitted[:3], area(IMAGE.astype(float), 3, 4))
    assert not fitted[3].any()
    filled = image(geometry.frame_fill(frames, 2, 2, (1.0, 0.0)))
    # Scale 2/5: 3 x 2 pixels, the right two columns.
    assert np.allclose(filled, area(IMAGE.astype(float), 2, 3)[:, 1:])


def test_pixelate_blocks(frames):
    got = image(geometry.pixelate(frames, 3))
    small = np.rint(area(IMAGE.astype(float), 1, 2))
    assert np.array_equal(got, small[np.zeros(H, int)][:, (np.arange(W) * 2 // W)])


def test_identity_and_shift_warps(frames):
    same = frames.withColumn("matrix", F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)]))
    assert np.array_equal(image(geometry.warp(same)), IMAGE)
    moved = frames.withColumn("matrix", F.array(*[F.lit(v) for v in (1.0, 0.0, 2.0, 0.0, 1.0, -1.0)]))
    got = image(geometry.warp(moved))
    want = np.zeros_like(IMAGE)
    want[: H - 1, 2:] = IMAGE[1:, : W - 2]
    assert np.array_equal(got, want)
    assert np.array_equal(image(geometry.warp(same, method="cubic")), IMAGE)


def test_singular_matrix_gives_null(frames):
    flat = frames.withColumn("matrix", F.array(*[F.lit(v) for v in (1.0, 1.0, 0.0, 1.0, 1.0, 0.0)]))
    assert geometry.warp(flat).first().rgba is None


def test_perspective_of_a_pure_shift(frames):
    corners = [(0.0, 0.0), (6.0, 0.0), (6.0, 4.0), (0.0, 4.0)]
    target = [(x + 1, y) for x, y in corners]
    got = image(geometry.warp_perspective(frames, corners, target, W, H))
    assert np.array_equal(got[:, 1:], IMAGE[:, :-1]) and not got[:, 0].any()
    with pytest.raises(ValueError):
        geometry.homography([(0.0, 0.0)] * 4, corners)


def test_transform_state_turns_about_the_crop_centre(spark):
    rows = [(1, 0, 4, 4, IMAGE[:4, :4].ravel().tolist())]
    state = F.struct(
        F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("scale"),
        F.lit(0.0).alias("rotation"), F.array(*[F.lit(v) for v in (1, 0, 2, 3)]).alias("crop"),
    )
    df = spark.createDataFrame(rows, FRAME).withColumn("state", state)
    assert np.array_equal(image(geometry.apply_transform_state(df)), IMAGE[:3, 1:3])
    turned = df.withColumn("state", F.col("state").withField("rotation", F.lit(180.0)))
    # A half turn about (1, 1.5) maps (x, y) to (2 - x, 3 - y).
    got = image(geometry.apply_transform_state(turned))
    want = np.zeros((3, 2, 4))
    for y in range(3):
        for x in range(2):
            if 0 <= 2 - x < 2 and 0 <= 3 - y < 3:
                want[y, x] = IMAGE[3 - y, 1 + 2 - x]
    assert np.allclose(got, want)


def test_quarter_turns(frames):
    px = clips.to_pixels(frames)
    for turns in range(4):
        want = np.rot90(IMAGE, turns)
        got = pixels.rot90(px, W, H, turns).collect()
        assert all(r.r == want[r.y, r.x, 0] for r in got)


def test_srgb_round_trip(spark):
    codes = spark.range(256).select(F.col("id").cast("int").alias("c"))
    back = codes.select("c", color.encode_srgb(color.linearize(F.col("c") / 255.0)).alias("d"))
    assert all(abs(r.c - r.d) <= 1 for r in back.collect())


def test_tone_curve_goes_on_beyond_its_ends(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (2.0,)], "v DOUBLE")
    points = ((0.2, 0.1), (0.6, 0.5), (0.8, 0.9))
    got = [r[0] for r in df.select(color.piecewise(F.col("v"), points)).collect()]
    assert got == pytest.approx([-0.1, 0.4, 3.3])


def test_grade_default_is_identity(frames):
    px = clips.to_pixels(frames)
    assert pixels.color_grade(px) is px


def test_transparent_pixels_blend_to_zero(spark):
    cell = spark.createDataFrame(
        [(1, 0, 0, 0, 0.5, 0.5, 0.5, 0.0)], "clip_id INT, frame_idx INT, y INT, x INT, r DOUBLE, g DOUBLE, b DOUBLE, a DOUBLE"
    )
    row = blending.blend(blending.align(cell, cell), "screen").first()
    assert (row.r, row.a) == (0.0, 0.0)


def test_box_blur(spark):
    values = RNG.random((4, 6))
    rows = [(1, y, x, float(values[y, x])) for y in range(4) for x in range(6)]
    df = spark.createDataFrame(rows, "mask_id INT, y INT, x INT, m DOUBLE")
    for radius in (1.0, 2.3, 100.0):
        r = min(int(np.ceil(radius)), 5)
        padded = np.pad(values, r, mode="edge")
        want = sum(padded[r : r + 4, i : i + 6] for i in range(2 * r + 1)) / (2 * r + 1)
        padded = np.pad(want, r, mode="edge")
        want = sum(padded[i : i + 4, r : r + 6] for i in range(2 * r + 1)) / (2 * r + 1)
        got = masks.box_blur(df, F.lit(radius)).collect()
        assert all(r_.m == pytest.approx(want[r_.y, r_.x]) for r_ in got)


def test_median_cut_counts_and_errors(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 30, (200, 3)), rng.integers(200, 255, (200, 3))])
    rows = [(1, 0, i // 20, i % 20, *map(int, p)) for i, p in enumerate(points)]
    px = spark.createDataFrame(rows, "clip_id INT, frame_idx INT, y INT, x INT, r INT, g INT, b INT")
    two = palette.global_palette(px, 2).orderBy("idx").collect()
    assert len(two) == 2 and two[0].r < 30 and two[1].r > 200
    for k in (5, 16):
        assert palette.global_palette(px, k).count() <= k
    chosen = palette.global_palette(px, 16)
    mapped = palette.quantize(px, chosen).collect()
    table = {r.idx: (r.r, r.g, r.b) for r in chosen.collect()}
    far = [max(abs(a - b) for a, b in zip((r.r, r.g, r.b), table[r.palette_idx])) for r in mapped]
    assert np.mean(far) < 20


def test_rotation_modes(spark):
    keys = spark.createDataFrame([(1, 0.0, 350.0), (1, 1.0, 10.0)], "track_id INT, t DOUBLE, v DOUBLE")
    samples = spark.createDataFrame([(1, 0.5)], "track_id INT, t DOUBLE")
    at = lambda k, **a: tracks.sample_curve(samples, k, **a).first().value
    assert at(keys) == pytest.approx(0.0)
    flipped = keys.withColumn("v", F.lit(360.0) - F.col("v"))
    assert at(flipped) == pytest.approx(0.0)
    assert at(keys.withColumn("v", F.when(F.col("t") == 0, 10.0).otherwise(350.0)), rotation_mode="forward") == pytest.approx(180.0)
    zero = keys.withColumn("v", F.lit(0.0))
    assert at(zero, rotation_mode="preserve_turns", turns=2) == pytest.approx(360.0)


def test_segment_boundaries_take_the_earlier_segment(spark):
    keys = spark.createDataFrame(
        [(1, 0.0, 0.0), (1, 1.0, 10.0), (1, 2.0, 0.0)], "track_id INT, t DOUBLE, v DOUBLE"
    )
    samples = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 1.0, 1.5, 2.0, 9.0)], "track_id INT, t DOUBLE")
    found = tracks.segment_lookup(samples, keys, 0.7).orderBy("t").collect()
    assert [r.clamped for r in found] == [0.0, 0.0, None, None, 0.0, 0.0]
    assert found[2].before.t == 0.0 and found[2].u == 1.0 and found[3].u == 0.5


def test_bezier_ease(spark):
    def exact(t, x1, y1, x2, y2):
        lo, hi = 0.0, 1.0
        for _ in range(80):
            u = (lo + hi) / 2
            x = 3 * (1 - u) ** 2 * u * x1 + 3 * (1 - u) * u * u * x2 + u**3
            lo, hi = (u, hi) if x < t else (lo, u)
        return 3 * (1 - u) ** 2 * u * y1 + 3 * (1 - u) * u * u * y2 + u**3

    cases = [
        (t, *c)
        for t in np.linspace(0, 1, 101).tolist() + [1e-6, 1 - 1e-6]
        for c in [(0.25, 0.1, 0.25, 1.0), (0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 1.0), (1.0, 0.3, 1.0, 0.7)]
    ]
    df = spark.createDataFrame(cases, "t DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    eased = df.select("*", easing.bezier_ease(*[F.col(c) for c in ("t", "x1", "y1", "x2", "y2")]).alias("e"))
    for r in eased.collect():
        # Where x is flat (in the middle or at an end) no method gets closer.
        near = 1e-7 if r.x1 == 0.25 else 1e-4
        assert r.e == pytest.approx(exact(r.t, r.x1, r.y1, r.x2, r.y2), abs=near), r


def test_lookup_over_cut_tracks(spark):
    """One track with most rows, tracks without keys, borders at every place."""
    import random
    from bisect import bisect_left

    draw = random.Random(3)
    ids = ["hot"] * 8 + ["b", "c", "d"]
    keys = sorted({(draw.choice(ids), draw.randrange(0, 4_000) / 4) for _ in range(700)})
    keys += [("one", 5.0)]
    rows = [(draw.choice([*ids, "one", "none"]), draw.randrange(-40, 4_100) / 4, i) for i in range(5_000)]
    samples = spark.createDataFrame(rows, "track_id STRING, t DOUBLE, rn INT")
    table = spark.createDataFrame([(k, t, t * 3 + len(k)) for k, t in keys], "track_id STRING, t DOUBLE, v DOUBLE")
    by_track = {}
    for k, t in keys:
        by_track.setdefault(k, []).append(t)
    want = {}
    for k, t, i in rows:
        times = sorted(by_track.get(k, []))
        at = bisect_left(times, t)
        before, after = (times[at - 1] if at else None), (times[at] if at < len(times) else None)
        ends = None if not times else times[0] if before is None else times[-1] if after is None or t >= times[-1] else None
        u = None if before is None or after is None else (t - before) / (after - before)
        want[i] = (before, after, None if ends is None else ends * 3 + len(k), u)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        found = tracks.segment_lookup(samples, table)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r.rn: (r.before and r.before.t, r.after and r.after.t, r.clamped, r.u) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want
    assert plan.count("Exchange") <= 6


def test_blurs_of_one_large_mask(spark):
    """Two radii in one go, spread over lines; rows are dealt out by lines only."""
    values = RNG.random((40, 90))
    rows = [("m", y, x, float(values[y, x])) for y in range(40) for x in range(90)] + [("n", 0, 0, 0.5)]
    df = spark.createDataFrame(rows, "mask_id STRING, y INT, x INT, m DOUBLE")

    def blur(v, r):
        r = min(int(np.ceil(r)), 89)
        h, w = v.shape
        padded = np.pad(v, r, mode="edge")
        v = sum(padded[r : r + h, i : i + w] for i in range(2 * r + 1)) / (2 * r + 1)
        padded = np.pad(v, r, mode="edge")
        return sum(padded[i : i + h, r : r + w] for i in range(2 * r + 1)) / (2 * r + 1)

    done = masks.box_blur(df, F.lit(2.5), F.lit(70.0))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION") == 2 and "partitionBy" not in plan
    want = blur(blur(values, 2.5), 70.0)
    got = {(r.mask_id, r.y, r.x): r.m for r in done.collect()}
    assert got["n", 0, 0] == 0.5
    assert all(got["m", y, x] == pytest.approx(want[y, x]) for y in range(40) for x in range(90))


@pytest.mark.parametrize("size,block", [((5, 7), 2), ((8, 6), 2), ((7, 7), 3), ((3, 4), 5), ((9, 10), 4)])
def test_pixelate_by_pixels_equals_packed_frames(spark, size, block):
    h, w = size
    values = RNG.integers(0, 256, (2, h * w * 4))
    rows = [(1, i, w, h, 100, [int(v) for v in values[i]]) for i in range(2)]
    frames = spark.createDataFrame(rows, "clip_id long, frame_idx int, width int, height int, duration_ms int, rgba array<int>")
    key = lambda r: (r.frame_idx, r.y, r.x, r.r, r.g, r.b, r.a)
    want = sorted(map(key, clips.to_pixels(geometry.pixelate(frames, block)).collect()))
    got = sorted(map(key, pixels.pixelate(clips.to_pixels(frames), block).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    # Means that lie half-way may be rounded either way, as their parts are summed in another order.
    gaps = np.abs(np.array(got) - np.array(want))
    assert gaps.max() <= 1 and (gaps == 0).mean() > 0.8
