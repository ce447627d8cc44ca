"""Registered clip queries and their cross-check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators import clips, quality
from loomframe.operators.ordered import attach
from loomframe.plans.common import six
from loomframe.sources import benchdata as data
from loomframe.sources.benchdata import with_views
from loomframe.sources.documents import clip_documents, write_reports
from loomframe.streaming.sinks import work_folder



def _files(frames: DataFrame) -> DataFrame:
    sizes = frames.groupBy("clip_id").agg((F.count("*") * 64).alias("size_bytes"))
    return sizes.withColumn("loop_count", (F.col("clip_id") % 3).cast("int"))


_FILES_SQL = "files AS (SELECT clip_id, count(*) * 64 AS size_bytes FROM frames GROUP BY clip_id)"

# Small enough that some of the generated clips break each of them.
LIMITS = clips.DecodeLimits(max_input_bytes=3_500, max_frames=52, max_total_pixels=16 * 50)


def frame_pixels(spark: SparkSession, folder: str) -> DataFrame:
    return clips.to_pixels(data.frames(spark, folder))


def repacked_frames(spark: SparkSession, folder: str) -> DataFrame:
    packed = clips.to_frames(clips.to_pixels(data.frames(spark, folder)))
    return packed.select(
        "clip_id", "frame_idx", "width", "height", F.concat_ws(",", "rgba").alias("rgba")
    )


def frame_motion(spark: SparkSession, folder: str) -> DataFrame:
    """Some frames are cut short and some have no pixels."""
    frames, at = data.frames(spark, folder), F.col("frame_idx")
    cut = F.when(at % 31 == 5, F.slice("rgba", 1, 60)).when(at % 37 != 7, F.col("rgba"))
    return six(clips.frame_motion(frames.withColumn("rgba", cut)), "motion")


def _odd_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames with gaps at block edges and, in some clips, without or with broken pixels."""
    frames, clip, at = data.frames(spark, folder), F.col("clip_id"), F.col("frame_idx")
    odd = F.when((clip % 5 == 1) & (at == 1), F.slice("rgba", 1, 3)).when(
        (clip % 5 == 2) & (at == 1), F.slice("rgba", 1, 0)
    )
    kept = frames.filter(~(at % 256).isin(0, 254, 255) | (at == 0))
    return kept.withColumn("rgba", F.coalesce(odd, "rgba"))


def gapped_motion(spark: SparkSession, folder: str) -> DataFrame:
    return six(clips.frame_motion(_odd_frames(spark, folder)), "motion")


def odd_clip_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of clips with broken frames and of files of unknown size."""
    frames = _odd_frames(spark, folder)
    known = F.when(F.col("clip_id") % 7 != 0, F.col("size_bytes"))
    report = clips.analyze_clips(frames, _files(frames).withColumn("size_bytes", known))
    return six(report, "motion_max").select("clip_id", "reason", "frame_count", "motion_max", "max_palette_colors")


def motion_stats(spark: SparkSession, folder: str) -> DataFrame:
    frames = data.frames(spark, folder)
    stats = clips.motion_stats(clips.frame_motion(frames), clips.clip_timing(frames))
    return six(stats, *[c for c in stats.columns if c != "clip_id"])


def clip_timing(spark: SparkSession, folder: str) -> DataFrame:
    return six(clips.clip_timing(data.frames(spark, folder)), "effective_fps")


def duration_histogram(spark: SparkSession, folder: str) -> DataFrame:
    arrays = clips.duration_histogram(data.frames(spark, folder))
    return arrays.select("clip_id", F.posexplode("duration_histogram")).select(
        "clip_id", "pos", F.col("col.ms").alias("ms"), F.col("col.n").alias("n")
    )


def first_last_difference(spark: SparkSession, folder: str) -> DataFrame:
    return six(clips.first_last_difference(data.frames(spark, folder)), "first_last_difference")


def corner_color(spark: SparkSession, folder: str) -> DataFrame:
    return clips.corner_color(data.frames(spark, folder))


def palette_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    return clips.palette_cardinality(data.frames(spark, folder))


def temporal_gate(spark: SparkSession, folder: str) -> DataFrame:
    gate = clips.temporal_gate(data.frames(spark, folder), factor=0.9)
    return six(gate, "max_diff", "median_diff")


def alpha_bounds(spark: SparkSession, folder: str) -> DataFrame:
    pixels = clips.to_linear(clips.to_pixels(data.frames(spark, folder)))
    return clips.alpha_bounds(pixels, 0.62)


def decode_budget(spark: SparkSession, folder: str) -> DataFrame:
    frames = data.frames(spark, folder)
    return clips.decode_budget(frames, _files(frames), LIMITS)


def clip_report(spark: SparkSession, folder: str) -> DataFrame:
    frames = data.frames(spark, folder)
    report = clips.analyze_clips(frames, _files(frames))
    doubles = [n for n, t in report.dtypes if t == "double"]
    bins = F.transform("duration_histogram", lambda b: F.concat_ws(":", b["ms"], b["n"]))
    millionths = F.transform("frame_motion", lambda m: F.round(m * 1e6).cast("bigint").cast("string"))
    colors = F.transform("frame_palette_colors", lambda n: n.cast("string"))
    kept = F.col("reason").isNull()
    return six(report, *doubles).withColumns(
        {
            "duration_histogram": F.concat_ws(",", bins),
            "frame_motion": F.when(kept, F.concat_ws(",", millionths)),
            "frame_palette_colors": F.when(kept, F.concat_ws(",", colors)),
        }
    )


def clip_report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The clip reports as the sink stores them, one canonical document per line."""
    frames = data.frames(spark, folder)
    report = clips.analyze_clips(frames, _files(frames))
    doubles = [n for n, t in report.dtypes if t == "double"]
    rounded = six(report, *doubles).withColumn("frame_motion", F.transform("frame_motion", lambda m: F.round(m, 6)))
    target = work_folder(spark)
    write_reports(clip_documents(rounded), f"{target}/reports")
    return spark.read.text(f"{target}/reports")


def frame_timings(spark: SparkSession, folder: str) -> DataFrame:
    plans = data.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("clip_id"),
        (F.lit(0.2) + (F.col("c_custkey") % 300) / 100.0).alias("total_s"),
        (F.lit(5.0) + (F.col("c_custkey") % 120)).alias("fps"),
    )
    rows = clips.frame_timings(plans)
    return six(rows, "total_s", "timestamp_s", "duration_s")


# --- gates -------------------------------------------------------------------------------


def _outputs(spark: SparkSession, folder: str) -> DataFrame:
    li = data.table(spark, folder, "lineitem")
    key = F.col("l_orderkey")
    return li.select(
        key.alias("job_id"),
        F.col("l_linenumber").alias("output_no"),
        F.when(key % 41 != 0, key % 13 != 0).alias("exists"),
        F.when(key % 43 != 0, F.floor(F.col("l_extendedprice") * 30).cast("bigint")).alias(
            "size_bytes"
        ),
        F.when(key % 17 == 0, "ProbeTimeoutError").alias("probe_error"),
        F.when(key % 47 != 0, key % 19 != 0).alias("has_video"),
        F.when(F.col("l_linenumber") % 7 == 0, 319).otherwise(320).alias("width"),
        F.lit(320).alias("height"),
        F.concat_ws(
            "/",
            (F.col("l_quantity").cast("bigint") * (F.col("l_suppkey") % 3)).cast("string"),
            (F.col("l_suppkey") % 3).cast("string"),
        ).alias("rate"),
        F.when(key % 53 != 0, F.lit(5.5) + F.col("l_discount") * 10).alias("duration_s"),
        F.when(key % 59 != 0, F.col("l_partkey") % 4).alias("frames"),
    )


_OUTPUTS_SQL = """outputs AS (
    SELECT l_orderkey AS job_id, l_linenumber AS output_no,
           CASE WHEN l_orderkey % 41 <> 0 THEN l_orderkey % 13 <> 0 END AS "exists",
           CASE WHEN l_orderkey % 43 <> 0 THEN CAST(floor(l_extendedprice * 30) AS BIGINT) END
               AS size_bytes,
           CASE WHEN l_orderkey % 17 = 0 THEN 'ProbeTimeoutError' END AS probe_error,
           CASE WHEN l_orderkey % 47 <> 0 THEN l_orderkey % 19 <> 0 END AS has_video,
           CASE WHEN l_linenumber % 7 = 0 THEN 319 ELSE 320 END AS width, 320 AS height,
           CASE WHEN l_suppkey % 3 = 0 THEN CAST(0 AS DOUBLE)
                ELSE CAST(CAST(l_quantity AS BIGINT) * (l_suppkey % 3) AS DOUBLE)
                     / (l_suppkey % 3) END AS fps,
           CASE WHEN l_orderkey % 53 <> 0 THEN CAST(5.5 AS DOUBLE) + l_discount * 10 END
               AS duration_s,
           CASE WHEN l_orderkey % 59 <> 0 THEN l_partkey % 4 END AS frames
    FROM lineitem)"""

_GATE = quality.OutputSpec(fps=(30, 24, 20, 10))


def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    gated = quality.quality_gate(_outputs(spark, folder), _GATE)
    return six(
        gated.select(
            "job_id",
            "output_no",
            "fps",
            "size_ratio",
            F.concat_ws(",", "checks").alias("checks"),
            "valid",
        ),
        "fps",
        "size_ratio",
    )


def artifact_validation(spark: SparkSession, folder: str) -> DataFrame:
    frames = data.frames(spark, folder)
    timing = clips.clip_timing(frames)
    analysis = (
        timing.join(clips.max_palette(frames), "clip_id")
        .withColumnRenamed("clip_id", "artifact_id")
        .withColumns({"width": F.lit(4), "height": F.lit(4)})
    )
    orders = data.table(spark, folder, "orders")
    probe = orders.select(
        F.col("o_orderkey").alias("probe_no"),
        (F.col("o_custkey") % 12).alias("artifact_id"),
        F.when(F.col("o_orderkey") % 29 != 0, F.col("o_orderkey") % 11 != 0).alias("signature_ok"),
        F.floor(F.col("o_totalprice") * 6).cast("bigint").alias("size_bytes"),
        F.lit(4).alias("width"),
        F.when(F.col("o_orderkey") % 7 == 0, 5).otherwise(4).alias("height"),
        F.when(F.col("o_orderkey") % 31 != 0, F.lit(40) + F.col("o_custkey") % 20).alias("frames"),
        F.concat(((F.col("o_custkey") % 9) + 24).cast("string"), F.lit("/1")).alias("rate"),
        F.when(
            F.col("o_orderkey") % 37 != 0, F.lit(1.5) + (F.col("o_custkey") % 10) / 10.0
        ).alias("duration_s"),
    )
    spec = quality.OutputSpec(
        width=4, height=4, fps=(28, 30), duration=1.9, tolerance=0.25, min_frames=42, max_frames=58
    )
    checked = quality.validate_artifacts(probe, analysis, spec)
    return checked.select(
        "probe_no", "artifact_id", F.concat_ws(",", "failed").alias("failed"), "valid"
    )


def fps_ladder(spark: SparkSession, folder: str) -> DataFrame:
    jobs = data.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        (F.col("o_custkey") % 30 + 1).cast("int").alias("fps"),
        (F.col("o_totalprice") * 12).alias("full_size"),
    )
    attempts = quality.fps_ladder(jobs).withColumn(
        "size_bytes",
        F.floor(F.col("full_size") * F.col("try_fps") / F.col("fps")).cast("bigint"),
    )
    return quality.pick_attempt(attempts, ["job_id"], 2_400_000)


def limit_verdict(spark: SparkSession, folder: str) -> DataFrame:
    probes = data.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.when(F.col("l_partkey") % 53 != 0, F.col("l_partkey") % 5000).alias("width"),
        (F.col("l_suppkey") % 80 * 40).alias("height"),
        F.when(F.col("l_orderkey") % 59 != 0, F.col("l_quantity") * 1.5).alias("duration_s"),
    )
    return quality.limit_verdict(probes)


def memory_estimate(spark: SparkSession, folder: str) -> DataFrame:
    jobs = data.table(spark, folder, "events").select(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).alias("hour"),
        F.lit(320).alias("width"),
        (F.col("user_id") % 320 + 1).alias("height"),
        (F.col("event_id") % 16).alias("layers"),
    )
    sized = quality.memory_estimate(jobs, 8_000_000)
    return sized.groupBy("hour").agg(
        F.count("*").alias("jobs"),
        F.sum("memory_bytes").alias("memory_bytes"),
        F.count_if("over_limit").alias("over_limit"),
    )


def square_layout(spark: SparkSession, folder: str) -> DataFrame:
    shapes = F.array(*[F.lit(s) for s in ("rounded-rect", "circle", "rect")])
    media = data.table(spark, folder, "part").select(
        F.col("p_partkey").alias("clip_id"),
        (F.col("p_partkey") * 7 % 1900).alias("width"),
        (F.col("p_size") * 32).cast("bigint").alias("height"),
        (F.col("p_partkey") % 11 / 10.0).alias("focus_x"),
        (F.col("p_partkey") % 7 / 5.0).alias("focus_y"),
        (F.col("p_partkey") % 5 / 4.0).alias("density"),
        F.get(shapes, (F.col("p_partkey") % 3).cast("int")).alias("shape"),
    )
    laid = quality.square_layout(media, "bottom")
    rounded = six(laid, *[n for n, t in laid.dtypes if t == "double"])
    return rounded.drop("focus_x", "focus_y", "density", "shape", "width", "height")


def center_window(spark: SparkSession, folder: str) -> DataFrame:
    frames = data.frames(spark, folder)
    starts = clips.running_sums(
        frames.select("clip_id", "frame_idx", "duration_ms"),
        ["clip_id"],
        ["frame_idx"],
        clips.id_block("frame_idx", 4096),
        {"end_ms": F.col("duration_ms").cast("bigint")},
    )
    cuts = quality.center_window(
        clips.clip_timing(frames).select("clip_id", (F.col("total_ms") / 1000.0).alias("total_s")),
        1.0,
    )
    placed = attach(starts, cuts, ["clip_id"], F.col("frame_idx"))
    begin = (F.col("end_ms") - F.col("duration_ms")) / 1000.0
    kept = placed.filter(
        (begin >= F.col("cut_start")) & (begin < F.col("cut_start") + F.col("cut_length"))
    )
    return six(
        kept.select("clip_id", "frame_idx", "cut_start", "cut_length"), "cut_start", "cut_length"
    )


QUERIES = {
    "frame_motion": frame_motion,
    "gapped_motion": gapped_motion,
    "odd_clip_reports": odd_clip_reports,
    "frame_pixels": frame_pixels,
    "repacked_frames": repacked_frames,
    "clip_timing": clip_timing,
    "duration_histogram": duration_histogram,
    "motion_stats": motion_stats,
    "first_last_difference": first_last_difference,
    "corner_color": corner_color,
    "palette_cardinality": palette_cardinality,
    "temporal_gate": temporal_gate,
    "alpha_bounds": alpha_bounds,
    "decode_budget": decode_budget,
    "clip_report": clip_report,
    "clip_report_lines": clip_report_lines,
    "frame_timings": frame_timings,
    "quality_gate": quality_gate,
    "artifact_validation": artifact_validation,
    "fps_ladder": fps_ladder,
    "limit_verdict": limit_verdict,
    "memory_estimate": memory_estimate,
    "square_layout": square_layout,
    "center_window": center_window,
}

_MOTION = """steps AS (
    SELECT clip_id, frame_idx, rgba, lag(rgba) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS p
    FROM frames),
motion AS (
    SELECT clip_id, frame_idx,
           list_sum(list_transform(range(64), lambda i: CASE WHEN i % 4 < 3
               THEN abs(rgba[i + 1] - p[i + 1]) ELSE 0 END)) / CAST(48 AS DOUBLE) AS motion,
           list_sum(list_transform(range(64), lambda i: abs(rgba[i + 1] - p[i + 1])))
               / CAST(64 AS DOUBLE) AS motion4
    FROM steps WHERE p IS NOT NULL)"""

_STATS = """stats AS (
    SELECT clip_id, coalesce(avg(motion), 0) AS motion_mean, coalesce(max(motion), 0) AS motion_max,
           coalesce(quantile_cont(motion, 0.25), 0) AS motion_p25,
           coalesce(quantile_cont(motion, 0.50), 0) AS motion_p50,
           coalesce(quantile_cont(motion, 0.75), 0) AS motion_p75,
           coalesce(quantile_cont(motion, 0.90), 0) AS motion_p90,
           coalesce(quantile_cont(motion, 0.95), 0) AS motion_p95,
           coalesce(quantile_cont(motion, 0.99), 0) AS motion_p99
    FROM (SELECT DISTINCT clip_id FROM frames) LEFT JOIN motion USING (clip_id)
    GROUP BY clip_id)"""

_TIMING = """timing AS (
    SELECT clip_id, count(*) AS frame_count, CAST(sum(duration_ms) AS BIGINT) AS total_ms,
           min(duration_ms) AS duration_min_ms, max(duration_ms) AS duration_max_ms,
           round(CAST(1000 AS DOUBLE) / (CAST(sum(duration_ms) AS DOUBLE) / count(*)), 6)
               AS effective_fps,
           min(duration_ms) = max(duration_ms) AS timing_is_uniform
    FROM frames GROUP BY clip_id)"""

_ENDS = """ends AS (
    SELECT f.clip_id, round(list_sum(list_transform(range(64), lambda i: CASE WHEN i % 4 < 3
               THEN abs(f.rgba[i + 1] - l.rgba[i + 1]) ELSE 0 END)) / CAST(48 AS DOUBLE), 6)
               AS first_last_difference
    FROM frames f JOIN (SELECT clip_id, arg_max(rgba, frame_idx) AS rgba FROM frames
                        GROUP BY clip_id) l USING (clip_id)
    WHERE f.frame_idx = 0)"""

_CORNER = """corners AS (
    SELECT clip_id,
           CAST(round_even(CAST(rgba[1] + rgba[13] + rgba[49] + rgba[61] AS DOUBLE) / 4, 0)
               AS INTEGER) AS corner_r,
           CAST(round_even(CAST(rgba[2] + rgba[14] + rgba[50] + rgba[62] AS DOUBLE) / 4, 0)
               AS INTEGER) AS corner_g,
           CAST(round_even(CAST(rgba[3] + rgba[15] + rgba[51] + rgba[63] AS DOUBLE) / 4, 0)
               AS INTEGER) AS corner_b
    FROM frames WHERE frame_idx = 0)"""

_PALETTE = """palettes AS (
    SELECT clip_id, frame_idx, count(DISTINCT (r, g, b)) AS palette_colors
    FROM pixels8 GROUP BY clip_id, frame_idx)"""

_BUDGET = """totals AS (
    SELECT clip_id, frame_idx, duration_ms, sum(width * height)
           OVER (PARTITION BY clip_id ORDER BY frame_idx) AS pixels FROM frames),
reasons AS (
    SELECT clip_id, frame_idx, CASE WHEN frame_idx >= 52 THEN 'frame_limit'
           WHEN duration_ms <= 0 THEN 'frame_duration'
           WHEN pixels > 800 THEN 'pixel_budget' END AS reason FROM totals),
breaches AS (
    SELECT clip_id, min(frame_idx) AS frame_idx, arg_min(reason, frame_idx) AS reason
    FROM reasons WHERE reason IS NOT NULL GROUP BY clip_id)"""

_ROUNDED_STATS = ", ".join(
    f"round({c}, 6) AS {c}" for c in ("motion_mean", "motion_max", *clips.MOTION_PERCENTILES)
)

_ODD = """kept AS (
    SELECT clip_id, frame_idx, duration_ms,
           CASE WHEN frame_idx = 1 AND clip_id % 5 IN (1, 2) THEN NULL ELSE rgba END AS rgba
    FROM frames WHERE frame_idx = 0 OR frame_idx % 256 NOT IN (0, 254, 255)),
steps AS (
    SELECT clip_id, frame_idx, rgba, lag(rgba) OVER w AS p, lag(1) OVER w AS follows
    FROM kept WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
motion AS (
    SELECT clip_id, frame_idx, follows, CASE WHEN rgba IS NOT NULL AND p IS NOT NULL THEN
           list_sum(list_transform(range(64), lambda i: CASE WHEN i % 4 < 3
               THEN abs(rgba[i + 1] - p[i + 1]) ELSE 0 END)) / CAST(48 AS DOUBLE) END AS motion
    FROM steps)"""

ORACLES = {
    "gapped_motion": with_views("frames")
    + f""", {_ODD}
        SELECT clip_id, frame_idx, round(motion, 6) AS motion,
               CASE WHEN motion IS NULL THEN 'frame_shape' END AS reason
        FROM motion WHERE follows = 1""",
    "odd_clip_reports": with_views("pixels8")
    + f""", {_ODD}, seen AS (
        SELECT clip_id, count(*) AS frame_count, min(CASE WHEN frame_idx >= 1000 THEN 1 END) AS over,
               min(CASE WHEN rgba IS NULL THEN 1 END) AS broken FROM kept GROUP BY clip_id),
    tops AS (
        SELECT clip_id, max(n) AS max_palette_colors FROM (
            SELECT clip_id, frame_idx, count(DISTINCT (r, g, b)) AS n FROM pixels8
            SEMI JOIN kept USING (clip_id, frame_idx) GROUP BY clip_id, frame_idx) GROUP BY clip_id),
    judged AS (
        SELECT clip_id, frame_count, CASE WHEN clip_id % 7 = 0 THEN 'empty_input'
               WHEN over = 1 THEN 'frame_limit' WHEN broken = 1 THEN 'frame_shape' END AS reason FROM seen),
    highest AS (SELECT clip_id, coalesce(max(motion), 0) AS motion_max FROM motion GROUP BY clip_id)
    SELECT clip_id, reason, CASE WHEN reason IS NULL THEN frame_count END AS frame_count,
           CASE WHEN reason IS NULL THEN round(motion_max, 6) END AS motion_max,
           CASE WHEN reason IS NULL THEN max_palette_colors END AS max_palette_colors
    FROM judged JOIN highest USING (clip_id) JOIN tops USING (clip_id)""",
    "frame_pixels": with_views("pixels8")
    + " SELECT clip_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, r, g, b, a"
    " FROM pixels8",
    "repacked_frames": with_views("frames")
    + " SELECT clip_id, frame_idx, width, height, array_to_string(rgba, ',') AS rgba FROM frames",
    "frame_motion": with_views("frames")
    + f""", {_MOTION}, marked AS (
        SELECT *, frame_idx % 31 IN (5, 6) OR frame_idx % 37 IN (7, 8) AS odd FROM motion)
    SELECT clip_id, frame_idx, CASE WHEN NOT odd THEN round(motion, 6) END AS motion,
           CASE WHEN odd THEN 'frame_shape' END AS reason FROM marked""",
    "motion_stats": with_views("frames")
    + f", {_MOTION}, {_STATS} SELECT clip_id, {_ROUNDED_STATS} FROM stats",
    "clip_timing": with_views("frames") + f", {_TIMING} SELECT * FROM timing",
    "duration_histogram": with_views("frames")
    + """ SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY duration_ms) - 1
              AS INTEGER) AS pos, duration_ms AS ms, count(*) AS n
          FROM frames GROUP BY clip_id, duration_ms""",
    "first_last_difference": with_views("frames") + f", {_ENDS} SELECT * FROM ends",
    "corner_color": with_views("frames") + f", {_CORNER} SELECT * FROM corners",
    "palette_cardinality": with_views("pixels8") + f", {_PALETTE} SELECT * FROM palettes",
    "temporal_gate": with_views("frames")
    + f""", {_MOTION}, gate AS (
        SELECT clip_id, max(motion4) AS mx, median(motion4) AS md FROM motion GROUP BY clip_id)
        SELECT clip_id, mx <= greatest(1, md * CAST(0.9 AS DOUBLE) + 8) AS passed,
               round(mx, 6) AS max_diff, round(md, 6) AS median_diff,
               CASE WHEN NOT mx <= greatest(1, md * CAST(0.9 AS DOUBLE) + 8) THEN
                   (SELECT min(frame_idx) FROM motion m WHERE m.clip_id = gate.clip_id
                    AND m.motion4 = gate.mx) END AS spike_index
        FROM gate""",
    "alpha_bounds": with_views("pixels")
    + """ SELECT clip_id, frame_idx,
               CAST(min(x) FILTER (a > CAST(0.62 AS DOUBLE)) AS INTEGER) AS x0,
               CAST(min(y) FILTER (a > CAST(0.62 AS DOUBLE)) AS INTEGER) AS y0,
               CAST(max(x) FILTER (a > CAST(0.62 AS DOUBLE)) + 1 AS INTEGER) AS x1,
               CAST(max(y) FILTER (a > CAST(0.62 AS DOUBLE)) + 1 AS INTEGER) AS y1
          FROM pixels GROUP BY clip_id, frame_idx""",
    "decode_budget": with_views("frames")
    + f""", {_FILES_SQL}, {_BUDGET}
        SELECT clip_id, CASE WHEN size_bytes > 3500 THEN 'input_bytes' ELSE reason END AS reason,
               CASE WHEN size_bytes <= 3500 THEN frame_idx END AS breach_frame
        FROM files LEFT JOIN breaches USING (clip_id)""",
    "clip_report_lines": with_views("pixels8")
    + f""", {_FILES_SQL}, {_TIMING}, {_MOTION}, {_STATS}, {_ENDS}, {_CORNER}, {_PALETTE},
        series AS (SELECT p.clip_id, max(palette_colors) AS top,
                string_agg(CAST(round(motion, 6) AS VARCHAR), ',' ORDER BY p.frame_idx) AS motions,
                string_agg(CAST(palette_colors AS VARCHAR), ',' ORDER BY p.frame_idx) AS colors
            FROM palettes p LEFT JOIN motion m USING (clip_id, frame_idx) GROUP BY p.clip_id),
        bins AS (SELECT clip_id, string_agg('[' || duration_ms || ',' || n || ']', ',' ORDER BY duration_ms) AS bins
                 FROM (SELECT clip_id, duration_ms, count(*) AS n FROM frames GROUP BY ALL) GROUP BY clip_id),
        shown AS (SELECT clip_id, {_ROUNDED_STATS} FROM stats)
        SELECT '{{"corner_color":[' || corner_r || ',' || corner_g || ',' || corner_b
               || '],"corner_color_is_heuristic":true,"duration_histogram":[' || bins
               || '],"duration_max_ms":' || duration_max_ms || ',"duration_min_ms":' || duration_min_ms
               || ',"duration_ms":' || total_ms || ',"effective_fps":' || effective_fps
               || ',"file_size_bytes":' || size_bytes || ',"first_last_difference":' || first_last_difference
               || ',"frame_count":' || frame_count || ',"frame_motion":[' || motions
               || '],"frame_palette_colors":[' || colors || '],"height":4,"loop_count":' || clip_id % 3
               || ',"max_palette_colors":' || top || ',"motion_max":' || motion_max || ',"motion_mean":' || motion_mean
               || ',"motion_p25":' || motion_p25 || ',"motion_p50":' || motion_p50 || ',"motion_p75":' || motion_p75
               || ',"motion_p90":' || motion_p90 || ',"motion_p95":' || motion_p95 || ',"motion_p99":' || motion_p99
               || ',"schema_version":1,"timing_is_uniform":' || timing_is_uniform || ',"width":4}}' AS value
        FROM files JOIN timing USING (clip_id) JOIN shown USING (clip_id) JOIN ends USING (clip_id)
        JOIN corners USING (clip_id) JOIN bins USING (clip_id) JOIN series USING (clip_id)
        WHERE frame_count <= 1000""",
    "clip_report": with_views("pixels8")
    + f""", {_FILES_SQL}, {_TIMING}, {_MOTION}, {_STATS}, {_ENDS}, {_CORNER}, {_PALETTE},
        tops AS (SELECT clip_id, max(palette_colors) AS max_palette_colors FROM palettes
                 GROUP BY clip_id),
        series AS (SELECT p.clip_id,
                string_agg(CAST(CAST(round(motion * 1000000) AS BIGINT) AS VARCHAR), ','
                           ORDER BY p.frame_idx) AS frame_motion,
                string_agg(CAST(palette_colors AS VARCHAR), ',' ORDER BY p.frame_idx)
                    AS frame_palette_colors
            FROM palettes p LEFT JOIN motion m USING (clip_id, frame_idx) GROUP BY p.clip_id),
        bins AS (SELECT clip_id, string_agg(duration_ms || ':' || n, ',' ORDER BY duration_ms)
                     AS duration_histogram
                 FROM (SELECT clip_id, duration_ms, count(*) AS n FROM frames GROUP BY ALL)
                 GROUP BY clip_id)
        SELECT clip_id, 1 AS schema_version, size_bytes,
               CASE WHEN frame_count > 1000 THEN 'frame_limit' END AS reason,
               CASE WHEN frame_count > 1000 THEN CAST(1000 AS BIGINT) END AS breach_frame,
               4 AS width, 4 AS height, frame_count, total_ms, effective_fps,
               CAST(clip_id % 3 AS INTEGER) AS loop_count, frame_motion, frame_palette_colors,
               {_ROUNDED_STATS},
               first_last_difference, corner_r, corner_g, corner_b, max_palette_colors,
               duration_min_ms, duration_max_ms, duration_histogram, timing_is_uniform,
               true AS corner_color_is_heuristic
        FROM files JOIN timing USING (clip_id) JOIN stats USING (clip_id)
        JOIN ends USING (clip_id) JOIN corners USING (clip_id) JOIN tops USING (clip_id)
        JOIN bins USING (clip_id) JOIN series USING (clip_id)""",
    "frame_timings": """WITH plans AS (
        SELECT c_custkey AS clip_id,
               CAST(0.2 AS DOUBLE) + CAST(c_custkey % 300 AS DOUBLE) / 100 AS total_s,
               CAST(5 + c_custkey % 120 AS DOUBLE) AS fps FROM customer),
    sized AS (SELECT *, CAST(greatest(1, round_even(total_s * fps, 0)) AS BIGINT) AS n,
                     CAST(round_even(total_s * 100, 0) AS BIGINT) AS cs FROM plans),
    spread AS (SELECT *, unnest(CASE WHEN cs < n THEN [NULL] ELSE range(n) END) AS i FROM sized),
    edges AS (SELECT *, CAST(round_even(CAST((i + 1) * cs AS DOUBLE) / n, 0)
                  - round_even(CAST(i * cs AS DOUBLE) / n, 0) AS BIGINT) AS d FROM spread)
    SELECT clip_id, round(total_s, 6) AS total_s, fps, i AS frame_idx,
           round(i * total_s / n, 6) AS timestamp_s, round(CAST(d AS DOUBLE) / 100, 6) AS duration_s,
           d AS delay_cs, CASE WHEN cs < n THEN 'too_short' END AS reason
    FROM edges""",
    "quality_gate": f"""WITH {_OUTPUTS_SQL}, flags AS (
        SELECT *, width = 320 AND height = 320 AS d,
               fps > 0 AND (abs(fps - 30) <= 0.5 OR abs(fps - 24) <= 0.5 OR abs(fps - 20) <= 0.5
                            OR abs(fps - 10) <= 0.5) AS f,
               duration_s > 0 AND abs(duration_s - 6) <= CAST(0.35 AS DOUBLE) AS t,
               frames >= 1 AS n,
               CASE WHEN "exists" IS NOT TRUE THEN 'missing'
                    WHEN coalesce(size_bytes <= 0 OR size_bytes > 2400000, TRUE) THEN 'size'
                    WHEN probe_error IS NOT NULL THEN 'probe:' || probe_error
                    WHEN has_video IS NOT TRUE THEN 'no_video' END AS early FROM outputs)
        SELECT job_id, output_no,
               CASE WHEN early IS NULL THEN round(fps, 6) ELSE CAST(0 AS DOUBLE) END AS fps,
               CASE WHEN "exists" THEN round(size_bytes / CAST(2400000 AS DOUBLE), 6)
                    ELSE CAST(1 AS DOUBLE) END AS size_ratio,
               coalesce(early, concat_ws(',', 'size', CASE WHEN d THEN 'dimensions' END,
                   CASE WHEN f THEN 'fps' END, CASE WHEN t THEN 'duration' END,
                   CASE WHEN n THEN 'frames' END)) AS checks,
               coalesce(early IS NULL AND d AND f AND t AND n, FALSE) AS valid
        FROM flags""",
    "artifact_validation": with_views("pixels8")
    + f""", {_TIMING}, {_PALETTE}, facts AS (
        SELECT t.clip_id AS artifact_id, frame_count, effective_fps, total_ms, c
        FROM timing t JOIN (SELECT clip_id, max(palette_colors) AS c FROM palettes
                            GROUP BY clip_id) USING (clip_id)),
    probe AS (
        SELECT o_orderkey AS probe_no, o_custkey % 12 AS artifact_id,
               o_orderkey % 29 <> 0 AND o_orderkey % 11 <> 0
                   AND floor(o_totalprice * 6) BETWEEN 1 AND 2400000 AS basic,
               o_orderkey % 7 = 0 AS bad_size,
               CASE WHEN o_orderkey % 31 <> 0 THEN 40 + o_custkey % 20 END AS frames,
               o_custkey % 9 + 24 AS fps,
               CASE WHEN o_orderkey % 37 <> 0
                    THEN CAST(1.5 AS DOUBLE) + CAST(o_custkey % 10 AS DOUBLE) / 10 END AS s
        FROM orders),
    failed AS (
        SELECT probe_no, artifact_id, concat_ws(',',
            CASE WHEN NOT basic THEN 'basic' END,
            CASE WHEN bad_size THEN 'dimensions' END,
            CASE WHEN frames IS NULL OR frames < 42 OR frames > 58 THEN 'frames' END,
            CASE WHEN fps NOT IN (28, 30) THEN 'fps' END,
            CASE WHEN frame_count IS NULL THEN 'no_analysis' END,
            CASE WHEN frame_count IS NOT NULL AND coalesce(frame_count <> frames, TRUE)
                 THEN 'frame_count' END,
            CASE WHEN c > 256 THEN 'colors' END,
            CASE WHEN NOT (abs(effective_fps - 28) <= 0.5 OR abs(effective_fps - 30) <= 0.5)
                 THEN 'analysis_fps' END,
            CASE WHEN s IS NULL OR abs(s - CAST(1.9 AS DOUBLE)) > 0.25 THEN 'duration' END,
            CASE WHEN abs(CAST(total_ms AS DOUBLE) / 1000 - CAST(1.9 AS DOUBLE)) > 0.25
                 THEN 'analysis_duration' END) AS failed
        FROM probe LEFT JOIN facts USING (artifact_id))
    SELECT *, failed = '' AS valid FROM failed""",
    "fps_ladder": """WITH jobs AS (
        SELECT o_orderkey AS job_id, CAST(o_custkey % 30 + 1 AS INTEGER) AS fps,
               o_totalprice * 12 AS full_size FROM orders),
    tries AS (
        SELECT job_id, fps, full_size, unnest(range(1 + len(s))) AS rung, list_concat([fps], s) AS l
        FROM (SELECT *, list_filter([30, 27, 24, 20, 18, 15], lambda f: f < fps) AS s FROM jobs)),
    sized AS (
        SELECT job_id, CAST(rung AS INTEGER) AS rung, l[rung + 1] AS try_fps,
               CAST(floor(full_size * l[rung + 1] / fps) AS BIGINT) AS size_bytes FROM tries)
    SELECT job_id, count(*) AS attempts,
           min(rung) FILTER (size_bytes <= 2400000) AS rung,
           arg_min(try_fps, rung) FILTER (size_bytes <= 2400000) AS try_fps,
           arg_min(size_bytes, rung) FILTER (size_bytes <= 2400000) AS size_bytes
    FROM sized GROUP BY job_id""",
    "limit_verdict": """WITH p AS (
        SELECT l_orderkey AS job_id,
               CASE WHEN l_partkey % 53 <> 0 THEN l_partkey % 5000 END AS width,
               l_suppkey % 80 * 40 AS height,
               CASE WHEN l_orderkey % 59 <> 0 THEN l_quantity * 1.5 END AS duration_s FROM lineitem)
    SELECT *, CASE WHEN coalesce(width > 3840 OR height > 2160, TRUE) THEN 'resolution'
                   WHEN coalesce(duration_s > 60, TRUE) THEN 'duration' ELSE 'accept' END AS verdict
    FROM p""",
    "memory_estimate": """WITH j AS (
        SELECT epoch_us(ts) // 3600000000 AS hour, 320 * (user_id % 320 + 1) * 4 AS area,
               event_id % 16 AS layers FROM events),
    m AS (SELECT hour, area * 4 * (1 + layers) + area * 64 AS bytes FROM j)
    SELECT hour, count(*) AS jobs, CAST(sum(bytes) AS BIGINT) AS memory_bytes,
           count(*) FILTER (bytes > 8000000) AS over_limit FROM m GROUP BY hour""",
    "square_layout": """WITH media AS (
        SELECT p_partkey AS clip_id, p_partkey * 7 % 1900 AS w, CAST(p_size * 32 AS BIGINT) AS h,
               CAST(p_partkey % 11 AS DOUBLE) / 10 AS fx,
               least(CAST(p_partkey % 7 AS DOUBLE) / 5, 1) AS fy,
               CAST(p_partkey % 5 AS DOUBLE) / 4 AS density,
               ['rounded-rect', 'circle', 'rect'][p_partkey % 3 + 1] AS shape FROM part),
    ratios AS (
        SELECT *, w > 0 AND h > 0 AS ok,
               CASE WHEN w > 0 AND h > 0 THEN CAST(w AS DOUBLE) / h END AS aspect FROM media),
    shaped AS (
        SELECT *, CAST(CASE WHEN shape = 'circle' THEN 1 WHEN aspect >= 1.35 THEN 1.08
               WHEN aspect <= 0.74 THEN 0.82
               ELSE greatest(0.88, least(1.12, aspect)) END AS DOUBLE) AS ratio,
               320 * greatest(CAST(0.7 AS DOUBLE), least(CAST(0.95 AS DOUBLE),
                   CAST(0.7 AS DOUBLE) + density * CAST(0.25 AS DOUBLE))) AS long,
               CAST(least(w, h) AS DOUBLE) AS crop FROM ratios),
    sized AS (
        SELECT *, CASE WHEN ratio >= 1 THEN long ELSE long * ratio END AS fw,
               CASE WHEN ratio >= 1 THEN long / ratio ELSE long END AS fh FROM shaped),
    placed AS (
        SELECT *, (320 - fw) / 2 AS x,
               (320 - fh) / 2 + (320 - fh) * CAST(0.16 AS DOUBLE) AS y FROM sized)
    SELECT clip_id, CASE WHEN NOT ok THEN 'dimensions' END AS reason,
           round(aspect, 6) AS source_aspect,
           CASE WHEN ok THEN CASE WHEN abs(aspect - 0.5625) <= 0.03 THEN '9:16'
                WHEN abs(aspect - CAST(4 AS DOUBLE) / 3) <= 0.03 THEN '4:3'
                WHEN abs(aspect - 1) <= 0.03 THEN '1:1' ELSE 'other' END END AS aspect,
           CASE WHEN ok THEN round_even(x, 2) END AS bounds_x,
           CASE WHEN ok THEN round_even(y, 2) END AS bounds_y,
           CASE WHEN ok THEN round_even(fw, 2) END AS bounds_w,
           CASE WHEN ok THEN round_even(fh, 2) END AS bounds_h,
           CASE WHEN ok THEN round_even(greatest(0, least(fx * w - crop / 2, w - crop)), 2) END
               AS crop_x,
           CASE WHEN ok THEN round_even(greatest(0, least(fy * h - crop / 2, h - crop)), 2) END
               AS crop_y,
           CASE WHEN ok THEN round_even(crop, 2) END AS crop_size,
           CASE WHEN ok THEN round_even(CASE shape WHEN 'circle' THEN least(fw, fh) / 2
                WHEN 'rounded-rect' THEN least(fw, fh) * CAST(0.1 AS DOUBLE) ELSE 0 END, 2) END
               AS radius,
           CASE WHEN ok THEN round_even(y, 2) END AS room_top,
           CASE WHEN ok THEN round_even(320 - x - fw, 2) END AS room_right,
           CASE WHEN ok THEN round_even(320 - y - fh, 2) END AS room_bottom,
           CASE WHEN ok THEN round_even(x, 2) END AS room_left
    FROM placed""",
    "center_window": with_views("frames")
    + """, ends AS (SELECT clip_id, frame_idx, (sum(duration_ms) OVER (PARTITION BY clip_id
            ORDER BY frame_idx) - duration_ms) / CAST(1000 AS DOUBLE) AS begin_s FROM frames),
    totals AS (SELECT clip_id, CAST(sum(duration_ms) AS DOUBLE) / 1000 AS total FROM frames
               GROUP BY clip_id),
    cuts AS (SELECT clip_id, least(total, CAST(1 AS DOUBLE)) AS len,
                    greatest(0, (total - least(total, CAST(1 AS DOUBLE))) / 2) AS start FROM totals)
    SELECT clip_id, frame_idx, round(start, 6) AS cut_start, round(len, 6) AS cut_length
    FROM ends JOIN cuts USING (clip_id) WHERE begin_s >= start AND begin_s < start + len""",
}
