"""Registered track and time queries and their cross-check SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import easing
from loomframe.operators import clips, tracks
from loomframe.plans.common import six
from loomframe.plans.pixel_plans import warp_sql
from loomframe.sources import benchdata as data
from loomframe.sources.benchdata import with_views

SPAN = 2_600_000.0


def segment_lookup(spark: SparkSession, folder: str) -> DataFrame:
    found = tracks.segment_lookup(
        data.track_samples(spark, folder), data.track_keys(spark, folder)
    )
    rows = found.select(
        "track_id",
        "rn",
        "t",
        F.col("before.t").alias("t0"),
        F.col("before.v").alias("v0"),
        F.col("after.t").alias("t1"),
        F.col("after.v").alias("v1"),
        "u",
        "clamped",
    )
    return six(rows, "t", "t0", "v0", "t1", "v1", "u", "clamped")


def _unit(df: DataFrame, span: float) -> DataFrame:
    return df.withColumn("t", F.col("t") / span)


def _angles(keys: DataFrame) -> DataFrame:
    return keys.withColumn("v", F.pmod(F.col("v") * 7.0, F.lit(360.0)))


def _curve(mode: str, interpolator: str, rotation: str, turns: float = 0.0):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        keys = _angles(_unit(data.track_keys(spark, folder), SPAN))
        samples = _unit(data.track_samples(spark, folder), 1_400_000.0)
        done = tracks.sample_curve(samples, keys, mode, interpolator, rotation, turns)
        return six(done.drop("t"), "value")

    return query


def bezier_curve(spark: SparkSession, folder: str) -> DataFrame:
    keys = _unit(data.track_keys(spark, folder), SPAN)
    keys = keys.withColumn(
        "controls",
        F.when(F.col("v") > 3, F.array(F.lit(0.42), F.lit(0.0), F.lit(0.58), F.lit(1.0))),
    )
    samples = _unit(data.track_samples(spark, folder), SPAN)
    done = tracks.sample_curve(samples, keys, "hold", "cubic_bezier", "preserve_turns")
    return six(done.drop("t"), "value")


def _vectors(keys: DataFrame) -> DataFrame:
    v = F.col("v")
    return keys.withColumn("v", F.array(v, v * 2, v - 5, v * v, F.lit(1.0), v / 3))


def _spread(df: DataFrame) -> DataFrame:
    rows = df.select("track_id", "rn", F.posexplode("value").alias("pos", "value"))
    return six(rows, "value")


def affine_tracks(spark: SparkSession, folder: str) -> DataFrame:
    return _spread(
        tracks.sample_affine(
            data.track_samples(spark, folder), _vectors(data.track_keys(spark, folder))
        )
    )


def motion_tracks(spark: SparkSession, folder: str) -> DataFrame:
    return _spread(
        tracks.sample_motion(
            data.track_samples(spark, folder), _vectors(data.track_keys(spark, folder))
        )
    )


def easing_values(spark: SparkSession, folder: str) -> DataFrame:
    e = data.table(spark, folder, "events")
    x = F.col("value") / 20.0 - 1.0
    rows = e.select(
        "event_id",
        easing.smoothstep(x).alias("smooth"),
        easing.harmonic(x).alias("harmonic"),
        *[easing.map_tau(x, m).alias(m) for m in ("loop", "ping_pong", "hold", "clamp")],
        easing.progress(x, F.lit(0.75)).alias("looped"),
        easing.progress(x, F.lit(0.75), loop=False).alias("stopped"),
    )
    return six(rows, *[c for c in rows.columns if c != "event_id"])


def rotation_deltas(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.pmod(F.col("value") * 31, F.lit(360.0)), F.pmod(F.col("value") * 17, F.lit(360.0))
    rows = data.table(spark, folder, "events").select(
        "event_id",
        easing.rotation_delta(a, b, "shortest").alias("shortest"),
        easing.rotation_delta(a, b, "forward").alias("forward"),
        easing.rotation_delta(a, b, "preserve_turns", 2).alias("turns"),
    )
    return six(rows, "shortest", "forward", "turns")


def bezier_easing(spark: SparkSession, folder: str) -> DataFrame:
    e = data.table(spark, folder, "events").select(
        "event_id", F.pmod(F.col("value"), F.lit(1.0)).alias("t")
    )
    eased = easing.bezier_ease(F.col("t"), F.lit(0.25), F.lit(0.1), F.lit(0.25), F.lit(1.0))
    return six(e.withColumn("eased", eased), "t", "eased")


def _motion_clips(spark: SparkSession, folder: str) -> DataFrame:
    plans = data.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("clip_id"),
        (F.lit(0.5) + (F.col("c_custkey") % 100) / 50.0).alias("total_s"),
        F.lit(8.0).alias("fps"),
    )
    return clips.frame_timings(plans).select(
        "clip_id",
        "frame_idx",
        F.col("timestamp_s").alias("t"),
        F.col("total_s").alias("duration_s"),
        (F.col("clip_id") % 64).alias("free_x"),
        (F.col("clip_id") % 48).alias("free_y"),
    )


def track_key_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as keys of a track per order; some times are missing or infinite."""
    part = F.col("l_partkey")
    time = F.when(part % 97 == 0, float("inf")).when(
        part % 89 != 0, (F.col("l_linenumber") % 5).cast("double")
    )
    keys = data.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("track_id"), time.alias("t")
    )
    return tracks.key_violations(keys)


def motion_paths(spark: SparkSession, folder: str) -> DataFrame:
    timed = _motion_clips(spark, folder)
    parts = [
        tracks.motion_path(timed, style, 24.0).withColumn("style", F.lit(style))
        for style in ("float", "pan", "none")
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return six(
        rows.select("clip_id", "frame_idx", "style", "offset_x", "offset_y"),
        "offset_x",
        "offset_y",
    )


def smooth_tracks(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.track_rows(spark, folder)
    points = rows.select(
        "track_id",
        "rn",
        (F.col("t") / 86_400.0).alias("t"),
        F.lit(640).alias("width"),
        F.lit(360).alias("height"),
        F.pmod(F.col("v") / 7.0, F.lit(1.2)).alias("center_x"),
        F.pmod(F.col("v") / 3.0, F.lit(1.0)).alias("center_y"),
        F.pmod(F.col("v") / 11.0, F.lit(1.0)).alias("confidence"),
        F.when(F.col("track_id") % 9 == 0, "center").otherwise("smart").alias("strategy"),
    )
    done = tracks.smooth_track(points, order=("t", "rn"))
    return six(
        done.select("track_id", "rn", "smooth_x", "smooth_y", "crop_x", "crop_y", "crop_side"),
        "smooth_x",
        "smooth_y",
    )


def moving_layers(spark: SparkSession, folder: str) -> DataFrame:
    frames = data.frames(spark, folder).withColumn(
        "rgba", F.transform("rgba", lambda v: v.cast("double") / 255.0)
    )
    layers = frames.select(
        ((F.col("clip_id") + 9) % 10).alias("clip_id"),
        "frame_idx",
        "width",
        "height",
        "rgba",
        F.lit(1).alias("z_index"),
        F.col("clip_id").alias("track_id"),
        (F.col("frame_idx") * 0.1).alias("t"),
        F.lit("screen").alias("mode"),
    )
    step = F.col("step").cast("double")
    keys = (
        frames.select(F.col("clip_id").alias("track_id"))
        .distinct()
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .select(
            "track_id",
            (step * 2.0).alias("t"),
            F.array(
                F.lit(1.0), step * 0.1, step - 1.0, step * -0.1, F.lit(1.0), step * 0.5
            ).alias("v"),
        )
    )
    done = tracks.composite_motion(frames, layers, keys)
    # Some exact results end in half of the last place; both engines lift them the same way.
    return six(done.withColumns({c: F.col(c) + 1e-9 for c in "rgba"}), *"rgba")


QUERIES = {
    "segment_lookup": segment_lookup,
    "curve_linear": _curve("loop", "linear", "shortest"),
    "curve_harmonic": _curve("ping_pong", "harmonic", "forward"),
    "curve_turns": _curve("hold", "linear", "preserve_turns", 2),
    "bezier_curve": bezier_curve,
    "affine_tracks": affine_tracks,
    "motion_tracks": motion_tracks,
    "easing_values": easing_values,
    "rotation_deltas": rotation_deltas,
    "bezier_easing": bezier_easing,
    "motion_paths": motion_paths,
    "track_key_violations": track_key_violations,
    "smooth_tracks": smooth_tracks,
    "moving_layers": moving_layers,
}


def _d(number: float) -> str:
    return f"CAST({number!r} AS DOUBLE)"


def _pmod(x: str, n: str) -> str:
    return f"((({x}) % {n} + {n}) % {n})"


def _neighbours(samples: str, keys: str) -> str:
    """Key strictly before and key at or after each sample, by as-of joins."""
    return f"""ends AS (SELECT track_id, max(t) AS last_t FROM {keys} GROUP BY 1),
    low AS (SELECT s.*, k.t AS t0, k.v AS v0 FROM {samples} s
            ASOF LEFT JOIN {keys} k ON s.track_id = k.track_id AND s.t > k.t),
    both_ AS (SELECT s.*, k.t AS t1, k.v AS v1 FROM low s
              ASOF LEFT JOIN {keys} k ON s.track_id = k.track_id AND s.t <= k.t),
    found AS (
        SELECT b.*, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0
                         WHEN t1 = last_t AND t = t1 THEN v1 END AS clamped,
               (t - t0) / (t1 - t0) AS u
        FROM both_ b LEFT JOIN ends USING (track_id))"""


def _curve_sql(tau: str, factor: str, delta: str, wrap: bool) -> str:
    value = f"v0 + ({factor}) * ({delta})"
    value = _pmod(value, "360") if wrap else value
    return (
        with_views("track_keys", "track_samples")
        + f""", keys AS (SELECT track_id, t / {_d(SPAN)} AS t, {_pmod('v * 7', '360')} AS v
                FROM track_keys),
        taus AS (SELECT track_id, rn, t / {_d(1_400_000.0)} AS tau FROM track_samples),
        samples AS (SELECT track_id, rn, {tau} AS t FROM taus),
        {_neighbours('samples', 'keys')}
        SELECT track_id, rn, round(coalesce(clamped, {value}), 6) + 0.0 AS value FROM found"""
    )


def _vector_sql(factor: str) -> str:
    parts = ["v", "v * 2", "v - 5", "v * v", "CAST(1 AS DOUBLE)", "v / 3"]
    rows = " UNION ALL ".join(
        f"SELECT track_id, rn, {i} AS pos, CASE WHEN clamped IS NOT NULL THEN "
        f"{p.replace('v', 'clamped') if 'CAST' not in p else p} ELSE "
        + (
            p
            if "CAST" in p
            else f"({p.replace('v', 'v0')}) + {factor} * (({p.replace('v', 'v1')}) - ({p.replace('v', 'v0')}))"
        )
        + " END AS value FROM found"
        for i, p in enumerate(parts)
    )
    return (
        with_views("track_keys", "track_samples")
        + f", {_neighbours('track_samples', 'track_keys')}, flat AS ({rows})"
        + " SELECT track_id, rn, pos, round(value, 6) + 0.0 AS value FROM flat"
    )


def _bezier(source: str, key: str, controls: tuple[float, float, float, float]) -> str:
    """Position on the curve by halving, one recursion step per bit."""
    x1, y1, x2, y2 = (_d(c) for c in controls)
    curve = lambda u, p, q: (
        f"(3 * (1 - {u}) * (1 - {u}) * {u} * {p} + 3 * (1 - {u}) * {u} * {u} * {q}"
        f" + {u} * {u} * {u})"
    )
    return f"""halves AS (
        SELECT {key}, t, 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi FROM {source}
        WHERE t IS NOT NULL
        UNION ALL
        SELECT {key}, t, step + 1,
               CASE WHEN {curve('m', x1, x2)} < t THEN m ELSE lo END,
               CASE WHEN {curve('m', x1, x2)} < t THEN hi ELSE m END
        FROM (SELECT *, (lo + hi) / 2 AS m FROM halves WHERE step < 48)),
    solved AS (SELECT {key}, t, {curve('((lo + hi) / 2)', y1, y2)} AS y FROM halves
               WHERE step = 48)"""


_X = f"(value / 20 - 1)"
_A, _B = _pmod("value * 31", "360"), _pmod("value * 17", "360")
_CLIP01 = "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {x}))"

ORACLES = {
    "segment_lookup": with_views("track_keys", "track_samples")
    + f", {_neighbours('track_samples', 'track_keys')} SELECT track_id, rn, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("t", "t0", "v0", "t1", "v1"))
    + ", round(u, 6) AS u, round(clamped, 6) AS clamped FROM found",
    "curve_linear": _curve_sql("tau % 1", "u", f"{_pmod('v1 - v0 + 180', '360')} - 180", True),
    "curve_harmonic": _curve_sql(
        "CASE WHEN tau % 2 <= 1 THEN tau % 2 ELSE 2 - tau % 2 END",
        f"0.5 - 0.5 * cos({_d(2 * math.pi)} * u)",
        f"CASE WHEN {_pmod('v1 - v0', '360')} = 0 THEN 360 ELSE {_pmod('v1 - v0', '360')} END",
        False,
    ),
    "curve_turns": _curve_sql(_CLIP01.format(x="tau"), "u", "v1 - v0 + 720", False),
    "affine_tracks": _vector_sql("u"),
    "motion_tracks": _vector_sql("(u * u * (3 - 2 * u))"),
    "easing_values": f"""WITH e AS (SELECT event_id, {_X} AS x FROM events)
        SELECT event_id,
               round({_CLIP01.format(x='x')} * {_CLIP01.format(x='x')}
                     * (3 - 2 * {_CLIP01.format(x='x')}), 6) AS smooth,
               round(0.5 - 0.5 * cos({_d(2 * math.pi)} * x), 6) + 0.0 AS harmonic,
               round({_pmod('x', '1')}, 6) + 0.0 AS loop,
               round(CASE WHEN {_pmod('x', '2')} <= 1 THEN {_pmod('x', '2')}
                     ELSE 2 - {_pmod('x', '2')} END, 6) + 0.0 AS ping_pong,
               round({_CLIP01.format(x='x')}, 6) + 0.0 AS hold,
               round({_CLIP01.format(x='x')}, 6) + 0.0 AS clamp,
               round({_pmod('x', _d(0.75))} / {_d(0.75)}, 6) + 0.0 AS looped,
               round({_CLIP01.format(x='x / ' + _d(0.75))}, 6) + 0.0 AS stopped
        FROM e""",
    "rotation_deltas": f"""SELECT event_id,
        round({_pmod(f'{_B} - {_A} + 180', '360')} - 180, 6) + 0.0 AS shortest,
        round(CASE WHEN {_pmod(f'{_B} - {_A}', '360')} = 0 THEN CAST(360 AS DOUBLE)
              ELSE {_pmod(f'{_B} - {_A}', '360')} END, 6) + 0.0 AS forward,
        round({_B} - {_A} + 720, 6) + 0.0 AS turns FROM events""",
    "track_key_violations": """WITH k AS (
        SELECT l_orderkey AS track_id, CASE WHEN l_partkey % 97 = 0 THEN 'inf'::DOUBLE
               WHEN l_partkey % 89 <> 0 THEN CAST(l_linenumber % 5 AS DOUBLE) END AS t FROM lineitem),
    p AS (SELECT track_id, t, count(*) AS n, count(*) FILTER (t IS NULL OR isinf(t)) AS bad
          FROM k GROUP BY ALL),
    v AS (SELECT track_id, sum(n) < 2 AS too_few, max(n) > 1 AS repeated_time, sum(bad) > 0 AS not_finite
          FROM p GROUP BY track_id)
    SELECT * FROM v WHERE too_few OR repeated_time OR not_finite""",
    "motion_paths": f"""WITH plans AS (
        SELECT c_custkey AS clip_id, {_d(0.5)} + CAST(c_custkey % 100 AS DOUBLE) / 50 AS total
        FROM customer),
    sized AS (SELECT *, CAST(greatest(1, round_even(total * 8, 0)) AS BIGINT) AS n FROM plans),
    timed AS (SELECT clip_id, total, n, unnest(range(n)) AS i, clip_id % 64 AS fx,
                     clip_id % 48 AS fy FROM sized),
    shares AS (SELECT *, (i * total / n) / greatest(total, {_d(0.1)}) AS s FROM timed),
    paths AS (
        SELECT clip_id, i, 'float' AS style,
               CAST(fx AS DOUBLE) / 2 + 24 * sin({_d(2 * math.pi)} * s) AS ox,
               CAST(fy AS DOUBLE) / 2 + 24 * cos({_d(2 * math.pi)} * s) AS oy FROM shares
        UNION ALL SELECT clip_id, i, 'pan', fx * s, fy * (1 - s) FROM shares
        UNION ALL SELECT clip_id, i, 'none', CAST(fx AS DOUBLE) / 2, CAST(fy AS DOUBLE) / 2
        FROM shares)
    SELECT clip_id, i AS frame_idx, style, round(ox, 6) + 0.0 AS offset_x,
           round(oy, 6) + 0.0 AS offset_y FROM paths""",
    "smooth_tracks": with_views("track_rows", recursive=True)
    + f""", pts AS (
        SELECT track_id, rn, t / 86400 AS t,
               {_pmod('v / 11', '1')} AS conf, {_pmod('v / 7', _d(1.2))} AS cx,
               {_pmod('v / 3', '1')} AS cy FROM track_rows),
    aims AS (
        SELECT track_id, rn, t,
               CASE WHEN track_id % 9 = 0 OR conf < {_d(0.2)} THEN CAST(0.5 AS DOUBLE)
                    ELSE least(CAST(1 AS DOUBLE), cx) END AS x,
               CASE WHEN track_id % 9 = 0 OR conf < {_d(0.2)} THEN CAST(0.5 AS DOUBLE)
                    ELSE least(CAST(1 AS DOUBLE), cy) END AS y FROM pts),
    fold AS (
        SELECT track_id, rn, t, x AS px, y AS py, CAST(0 AS DOUBLE) AS dx, CAST(0 AS DOUBLE) AS dy
        FROM aims WHERE rn = 1
        UNION ALL
        SELECT track_id, rn, t,
               px + ax / (ax + 1) * (x - px), py + ay / (ay + 1) * (y - py), ex, ey
        FROM (SELECT *, {_d(2 * math.pi)} * ({_d(0.5)} + {_d(0.05)} * abs(ex)) * dt AS ax,
                     {_d(2 * math.pi)} * ({_d(0.5)} + {_d(0.05)} * abs(ey)) * dt AS ay
              FROM (SELECT *, dx + r / (r + 1) * ((x - px) / dt - dx) AS ex,
                           dy + r / (r + 1) * ((y - py) / dt - dy) AS ey
                    FROM (SELECT a.track_id, a.rn, a.t, a.x, a.y, f.px, f.py, f.dx, f.dy,
                                 greatest({_d(1e-6)}, a.t - f.t) AS dt,
                                 {_d(2 * math.pi)} * greatest({_d(1e-6)}, a.t - f.t) AS r
                          FROM fold f JOIN aims a ON a.track_id = f.track_id
                              AND a.rn = f.rn + 1))))
    SELECT track_id, rn, round(px, 6) + 0.0 AS smooth_x, round(py, 6) + 0.0 AS smooth_y,
           CAST(round_even(greatest(0, least(280, px * 640 - 180)), 0) AS INTEGER) AS crop_x,
           CAST(round_even(greatest(0, least(0, py * 360 - 180)), 0) AS INTEGER) AS crop_y,
           360 AS crop_side
    FROM fold""",
    "bezier_easing": f"""WITH RECURSIVE e AS (
        SELECT event_id, {_pmod('value', '1')} AS t FROM events),
    {_bezier('e', 'event_id', (0.25, 0.1, 0.25, 1.0))}
    SELECT event_id, round(t, 6) + 0.0 AS t, round(y, 6) + 0.0 AS eased FROM solved""",
    "bezier_curve": with_views("track_keys", "track_samples", recursive=True)
    + f""", keys AS (SELECT track_id, t / {_d(SPAN)} AS t, v FROM track_keys),
    samples AS (SELECT track_id, rn, t / {_d(SPAN)} AS t FROM track_samples),
    {_neighbours('samples', 'keys')},
    us AS (SELECT track_id, rn, clamped, v0, v1, u AS t FROM found),
    {_bezier('us', 'track_id, rn', (0.42, 0.0, 0.58, 1.0))}
    SELECT track_id, rn, round(coalesce(us.clamped, us.v0 + CASE WHEN us.v0 > 3 THEN y ELSE us.t END
               * (us.v1 - us.v0)), 6) + 0.0 AS value
    FROM us LEFT JOIN solved USING (track_id, rn)""",
    "moving_layers": with_views("pixels")
    + ", moved AS (SELECT (clip_id + 9) % 10 AS clip_id, frame_idx, y, x, r, g, b, a FROM pixels), "
    + warp_sql(
        "moved",
        (
            _d(1.0),
            f"k * {_d(0.1)}",
            "k - 1",
            f"k * {_d(-0.1)}",
            _d(1.0),
            f"k * {_d(0.5)}",
        ),
        f"least(frame_idx * {_d(0.1)} / 2, CAST(3 AS DOUBLE))",
    )
    + """, base AS (SELECT * FROM pixels),
    pairs AS (
        SELECT clip_id, frame_idx, y, x, b.r AS dr, b.g AS dg, b.b AS db, b.a AS da,
               coalesce(w.r, 0) AS sr, coalesce(w.g, 0) AS sg, coalesce(w.b, 0) AS sb,
               coalesce(w.a, 0) AS sa, b.r IS NULL AS only_top, w.clip_id IS NULL AS only_base
        FROM base b FULL JOIN warped w USING (clip_id, frame_idx, y, x)),
    mixed AS (SELECT *, sa + da * (1 - sa) AS alpha FROM pairs)
    SELECT clip_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, """
    + ", ".join(
        f"round(CASE WHEN only_base THEN d{c} WHEN only_top THEN s{c} WHEN alpha > 0 THEN"
        f" ((1 - (1 - d{c}) * (1 - s{c})) * sa + d{c} * da * (1 - sa)) / alpha"
        f" ELSE 0 END + {_d(1e-9)}, 6) AS {c}"
        for c in "rgb"
    )
    + ", round(CASE WHEN only_base THEN da WHEN only_top THEN sa ELSE alpha END"
    + f" + {_d(1e-9)}, 6) AS a"
    " FROM mixed",
}
