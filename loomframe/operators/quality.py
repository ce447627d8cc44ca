"""Quality gates over probed outputs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.numeric import clamp, first_reason, half_even, parse_rate, required, violations
from loomframe.operators.ordered import attach

# Frame-rate ladder, highest first.
FPS_LADDER = (30, 27, 24, 20, 18, 15)
CANVAS = 320


@dataclass(frozen=True)
class OutputSpec:
    max_bytes: int = 2_400_000
    width: int = CANVAS
    height: int = CANVAS
    fps: Sequence[int] = (30,)
    duration: float | None = 6.0
    tolerance: float = 0.35
    min_frames: int = 1
    max_frames: int | None = None
    max_colors: int = 256


def _near_any(value: Column, targets: Sequence[int]) -> Column:
    hit = F.lit(False)
    for target in targets:
        hit = hit | (F.abs(value - F.lit(float(target))) <= 0.5)
    return hit


def quality_gate(outputs: DataFrame, spec: OutputSpec = OutputSpec()) -> DataFrame:
    """Checks passed by each output and whether all of them hold; unknown facts fail.

    Input: ``exists, size_bytes, probe_error, has_video, width, height, rate, duration_s,
    frames``.
    """
    fps = parse_rate(F.col("rate"))
    absent = required(~F.col("exists"))
    early = (
        F.when(absent, F.array(F.lit("missing")))
        .when(
            required((F.col("size_bytes") <= 0) | (F.col("size_bytes") > spec.max_bytes)),
            F.array(F.lit("size")),
        )
        .when(
            F.col("probe_error").isNotNull(),
            F.array(F.concat(F.lit("probe:"), F.col("probe_error"))),
        )
        .when(required(~F.col("has_video")), F.array(F.lit("no_video")))
    )
    dimensions = (F.col("width") == spec.width) & (F.col("height") == spec.height)
    rate_ok = (fps > 0) & _near_any(fps, spec.fps)
    if spec.duration is None:
        duration_ok = F.lit(True)
    else:
        duration_ok = (F.col("duration_s") > 0) & (
            F.abs(F.col("duration_s") - spec.duration) <= spec.tolerance
        )
    frames_ok = F.col("frames") >= spec.min_frames
    passed = violations(
        size=F.lit(True),
        dimensions=dimensions,
        fps=rate_ok,
        duration=duration_ok,
        frames=frames_ok,
    )
    done = early.isNull()
    ratio = F.when(absent, F.lit(1.0)).otherwise(
        F.col("size_bytes") / F.lit(float(spec.max_bytes))
    )
    return outputs.withColumns(
        {
            "fps": F.when(done, fps).otherwise(F.lit(0.0)),
            "size_ratio": ratio,
            "checks": F.coalesce(early, passed),
            "valid": F.coalesce(
                done & dimensions & rate_ok & duration_ok & frames_ok, F.lit(False)
            ),
        }
    )


def validate_artifacts(probe: DataFrame, analysis: DataFrame, spec: OutputSpec) -> DataFrame:
    """Agreement of header facts, probe facts and the decoded analysis, per artifact.

    Unknown facts break their rules; without an analysis only its absence is reported.
    """
    a = analysis.select(
        "artifact_id",
        F.col("width").alias("a_width"),
        F.col("height").alias("a_height"),
        F.col("frame_count").alias("a_frames"),
        F.col("effective_fps").alias("a_fps"),
        F.col("total_ms").alias("a_ms"),
        F.col("max_palette_colors").alias("a_colors"),
    )
    fps = parse_rate(F.col("rate"))
    over = F.lit(False) if spec.max_frames is None else F.col("frames") > spec.max_frames
    analysed = lambda broken: F.col("a_frames").isNotNull() & required(broken)
    rules = {
        "basic": required(
            ~(F.col("signature_ok") & F.col("size_bytes").between(1, spec.max_bytes))
        ),
        "dimensions": required(
            (F.col("width") != spec.width) | (F.col("height") != spec.height)
        ),
        "frames": required((F.col("frames") < spec.min_frames) | over),
        "fps": required(~_near_any(fps, spec.fps)),
        "no_analysis": F.col("a_frames").isNull(),
        "analysis_dimensions": analysed(
            (F.col("a_width") != spec.width) | (F.col("a_height") != spec.height)
        ),
        "frame_count": analysed(F.col("a_frames") != F.col("frames")),
        "colors": analysed(F.col("a_colors") > spec.max_colors),
        "analysis_fps": analysed(~_near_any(F.col("a_fps"), spec.fps)),
    }
    if spec.duration is not None:
        wanted = F.lit(float(spec.duration))
        rules["duration"] = required(F.abs(F.col("duration_s") - wanted) > spec.tolerance)
        rules["analysis_duration"] = analysed(
            F.abs(F.col("a_ms") / 1000.0 - wanted) > spec.tolerance
        )
    # Many probes may share an artifact: they are spread, its facts are repeated.
    found = attach(probe, a, ["artifact_id"], F.struct(*probe.columns))
    return found.select(
        *probe.columns,
        violations(**rules).alias("failed"),
        first_reason(**rules).isNull().alias("valid"),
    )


def fps_ladder(jobs: DataFrame) -> DataFrame:
    """Frame rates to try: the preferred one, then every lower ladder step."""
    steps = F.filter(F.array(*[F.lit(f) for f in FPS_LADDER]), lambda f: f < F.col("fps"))
    return jobs.select(
        "*",
        F.posexplode(F.concat(F.array(F.col("fps").cast("int")), steps)).alias("rung", "try_fps"),
    )


def pick_attempt(attempts: DataFrame, keys: Sequence[str], max_bytes: int) -> DataFrame:
    """First attempt per job that fits; jobs where none fits have nulls."""
    fits = F.when(
        F.col("size_bytes") <= max_bytes, F.struct("rung", "try_fps", "size_bytes")
    )
    return (
        attempts.groupBy(*keys)
        .agg(F.min(fits).alias("_pick"), F.count("*").alias("attempts"))
        .select(
            *keys,
            "attempts",
            F.col("_pick.rung").alias("rung"),
            F.col("_pick.try_fps").alias("try_fps"),
            F.col("_pick.size_bytes").alias("size_bytes"),
        )
    )


def limit_verdict(
    probes: DataFrame, width: int = 3840, height: int = 2160, duration: float = 60.0
) -> DataFrame:
    """``accept``, or the limit that a clip breaks; unknown facts break theirs."""
    return probes.withColumn(
        "verdict",
        F.coalesce(
            first_reason(
                resolution=required((F.col("width") > width) | (F.col("height") > height)),
                duration=required(F.col("duration_s") > duration),
            ),
            F.lit("accept"),
        ),
    )


def memory_estimate(
    jobs: DataFrame, limit: int, channels: int = 4, intermediates: int = 8
) -> DataFrame:
    """Render memory per job: float32 layers plus float64 intermediates."""
    area = F.col("width").cast("bigint") * F.col("height") * channels
    need = area * 4 * (1 + F.col("layers")) + area * 8 * intermediates
    return jobs.withColumn("memory_bytes", need).withColumn(
        "over_limit", F.col("memory_bytes") > limit
    )


def aspect_class(width: Column, height: Column) -> Column:
    ratio = width / height
    near = lambda r: F.abs(ratio - F.lit(r)) <= 0.03
    return (
        F.when(near(9 / 16), "9:16")
        .when(near(4 / 3), "4:3")
        .when(near(1.0), "1:1")
        .otherwise("other")
    )


def square_layout(clips: DataFrame, anchor: str = "center") -> DataFrame:
    """Place media of any aspect on the square canvas.

    Input: ``width, height, focus_x, focus_y, density, shape``. Rows without positive
    dimensions get a ``reason`` and null figures.
    """
    # Fixed values below: aspect steps, size range and leans of the square layout.
    side = float(CANVAS)
    w, h = F.col("width"), F.col("height")
    ok = (w > 0) & (h > 0)
    aspect = F.when(ok, w / F.when(ok, h))
    ratio = (
        F.when(F.col("shape") == "circle", F.lit(1.0))
        .when(aspect >= 1.35, F.lit(1.08))
        .when(aspect <= 0.74, F.lit(0.82))
        .otherwise(clamp(aspect, 0.88, 1.12))
    )
    sized = clips.withColumns(
        {
            "reason": F.when(~ok, "dimensions"),
            "source_aspect": aspect,
            "_ratio": ratio,
            "_long": side * clamp(0.70 + clamp(F.col("density"), 0.0, 1.0) * 0.25, 0.70, 0.95),
            "_crop": F.when(ok, F.least(w, h)).cast("double"),
        }
    ).withColumns(
        {
            "_fw": F.when(F.col("_ratio") >= 1, F.col("_long")).otherwise(
                F.col("_long") * F.col("_ratio")
            ),
            "_fh": F.when(F.col("_ratio") >= 1, F.col("_long") / F.col("_ratio")).otherwise(
                F.col("_long")
            ),
        }
    )
    lean = {"top": -0.16, "bottom": 0.16}.get(anchor, 0.0)
    x = (side - F.col("_fw")) / 2
    free = side - F.col("_fh")
    y = free / 2 + free * lean if lean else free / 2
    short = F.least("_fw", "_fh")
    radius = (
        F.when(F.col("shape") == "circle", short / 2)
        .when(F.col("shape") == "rounded-rect", short * 0.1)
        .otherwise(F.lit(0.0))
    )

    def offset(focus: str, size: Column) -> Column:
        at = clamp(F.col(focus), 0.0, 1.0) * size - F.col("_crop") / 2
        return clamp(at, F.lit(0.0), size - F.col("_crop"))

    two = lambda c: F.when(ok, half_even(c, 2))
    return sized.select(
        *clips.columns,
        "reason",
        "source_aspect",
        F.when(ok, aspect_class(w, F.when(ok, h))).alias("aspect"),
        two(x).alias("bounds_x"),
        two(y).alias("bounds_y"),
        two(F.col("_fw")).alias("bounds_w"),
        two(F.col("_fh")).alias("bounds_h"),
        two(offset("focus_x", w)).alias("crop_x"),
        two(offset("focus_y", h)).alias("crop_y"),
        two(F.col("_crop")).alias("crop_size"),
        two(radius).alias("radius"),
        two(y).alias("room_top"),
        two(side - x - F.col("_fw")).alias("room_right"),
        two(side - y - F.col("_fh")).alias("room_bottom"),
        two(x).alias("room_left"),
    )


def center_window(clips: DataFrame, max_s: float) -> DataFrame:
    """Start and length of the centred cut of each clip."""
    length = F.least(F.col("total_s"), F.lit(float(max_s)))
    return clips.withColumns(
        {
            "cut_start": F.greatest(F.lit(0.0), (F.col("total_s") - length) / 2),
            "cut_length": length,
        }
    )
