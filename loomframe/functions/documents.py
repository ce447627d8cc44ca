"""Checks and identities of JSON documents."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    FloatType,
    IntegralType,
    MapType,
    StringType,
    StructType,
)

MAX_BYTES = 8 * 1024 * 1024
MAX_DEPTH = 128
# Fixed value: namespace of artifact ids.
ARTIFACT_NAMESPACE = "a1e2b3c4-d5e6-7890-abcd-ef1234567890"


def utf8_ok(binary: Column) -> Column:
    """Whether a binary value is strict UTF-8."""
    return F.is_valid_utf8(binary.cast("string"))


def is_hex_color(value: Column) -> Column:
    return value.rlike(r"\A#[0-9a-fA-F]{3}([0-9a-fA-F]{3})?\z")


def is_revision_id(value: Column) -> Column:
    return value.rlike(r"\A[0-9a-f]{64}\z")


def _nesting(text: Column, finish) -> Column:
    """Walk over the brackets outside of strings; ``finish`` reads the final state.

    State: ``now`` and ``top`` depth, ``bad`` when a bracket closes nothing, ``roots``
    the number of times the outermost bracket was closed.
    """
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    plain = F.regexp_replace(plain, r'"[^"]*("|\z)', "")
    # Runs of brackets of one direction are taken in one step, in their order.
    runs = F.regexp_extract_all(
        F.regexp_replace(plain, r"[^\[\]{}]", ""), F.lit(r"([\[{]+|[\]}]+)"), 1
    )

    def step(s: Column, run: Column) -> Column:
        opens = F.substring(run, 1, 1).isin("[", "{")
        now = s["now"] + F.when(opens, F.length(run)).otherwise(-F.length(run))
        return F.struct(
            now.alias("now"),
            F.greatest(s["top"], now).alias("top"),
            (s["bad"] | (now < 0)).alias("bad"),
            (s["roots"] + F.when(now == 0, 1).otherwise(0)).alias("roots"),
        )

    zero = F.lit(0)
    start = F.struct(
        zero.alias("now"), zero.alias("top"), F.lit(False).alias("bad"), zero.alias("roots")
    )
    return F.aggregate(runs, start, step, finish)


def json_depth(text: Column) -> Column:
    """Greatest nesting outside of strings; -1 when a bracket closes nothing."""
    return _nesting(text, lambda s: F.when(s["bad"], F.lit(-1)).otherwise(s["top"]))


def is_json_object(text: Column, parsed: Column | None = None) -> Column:
    """Whether a text is one JSON object and nothing else.

    The built-in parsers stop behind the first value, so what follows is checked here.
    ``parsed`` is the text as a variant, if that is at hand.
    """
    single = _nesting(text, lambda s: ~s["bad"] & (s["now"] == 0) & (s["roots"] == 1))
    return F.coalesce(
        (F.try_parse_json(text) if parsed is None else parsed).isNotNull()
        & F.json_object_keys(text).isNotNull()
        & text.rlike(r"}\s*\z")
        & single,
        F.lit(False),
    )


def json_bounds(text: Column, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH) -> Column:
    """Null, or the first broken bound: bytes, brackets or depth."""
    depth = json_depth(text)
    return (
        F.when(F.octet_length(text) > max_bytes, "bytes")
        .when(depth < 0, "brackets")
        .when(depth > max_depth, "depth")
    )


def json_text(value: Column) -> Column:
    """A string as a JSON string: shortest escapes, other characters as they are."""
    short = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    control = escaped
    for code in range(32):
        char = chr(code)
        control = F.replace(control, F.lit(char), F.lit(short.get(char, f"\\u{code:04x}")))
    safe = F.when(value.rlike(r"[\x00-\x1f]"), control).otherwise(escaped)
    return F.concat(F.lit('"'), safe, F.lit('"'))


def _scan(value: Any, depth: int) -> str | None:
    """First problem of a parsed value."""
    if depth > MAX_DEPTH:
        return "depth"
    if isinstance(value, dict):
        children = [*value.keys(), *value.values()]
    elif isinstance(value, list):
        children = value
    else:
        if isinstance(value, float) and not math.isfinite(value):
            return "not_finite"
        if isinstance(value, str) and any(0xD800 <= ord(c) <= 0xDFFF for c in value):
            return "surrogate"
        return None
    return next((p for p in (_scan(c, depth + 1) for c in children) if p), None)


class _Duplicate(ValueError):
    pass


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise _Duplicate
    return found


def _parsed(text: str) -> tuple[Any, str | None]:
    try:
        value = json.loads(text, object_pairs_hook=_unique)
    except _Duplicate:
        return None, "duplicate_key"
    except RecursionError:
        return None, "depth"
    except ValueError:
        return None, "malformed"
    return value, _scan(value, 0)


@F.pandas_udf(StringType())
def json_violation(texts: pd.Series) -> pd.Series:
    """Null for a sound document, else its first problem."""
    return texts.map(lambda t: None if t is None else _parsed(t)[1])


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Sorted keys, no blanks, characters as they are; null for unsound documents."""

    def rewrite(text: str | None) -> str | None:
        if text is None:
            return None
        value, problem = _parsed(text)
        if problem:
            return None
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return texts.map(rewrite)


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _decimal(value: Column) -> Column:
    """Significant digits of a positive double, and the power of ten of the first one."""
    parts = F.split(value.cast("string"), "E")
    mantissa, power = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(0))
    whole, rest = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    joined = F.concat(whole, rest)
    kept = F.regexp_replace(joined, "^0+", "")
    place = power + F.length(whole) - 1 - (F.length(joined) - F.length(kept))
    return F.struct(F.regexp_replace(kept, "0+$", "").alias("digits"), place.alias("place"))


def _shorter(value: Column, d: Column) -> Column:
    """One digit less, if that still is the same double; the engine may print one too many."""
    count = F.length(d["digits"])
    number = d["digits"].cast("bigint") + 5
    cut = F.regexp_replace((number - number % 10).cast("string"), "0$", "")
    back = F.concat(cut, F.lit("E"), (d["place"] - count + 2).cast("string")).cast("double")
    place = d["place"] + F.length(cut) - (count - 1)
    made = F.struct(F.regexp_replace(cut, "0+$", "").alias("digits"), place.alias("place"))
    return F.when((count >= 17) & (back == value), made).otherwise(d)


def number_text(value: Column) -> Column:
    """A double in the shortest form: plain from 1e-4 up to 1e16, else with an exponent.

    Null for values that JSON cannot hold. From 1e16 on and below 1e-10 several texts may mean
    the same double; there the last digit may be another one, or one more.
    """
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))

    def shown(d: Column) -> Column:
        digits, place, count = d["digits"], d["place"], F.length(d["digits"])
        rest = F.when(count > 1, F.concat(F.lit("."), digits.substr(F.lit(2), count))).otherwise(F.lit(""))
        power = F.abs(place).cast("string")
        sign = F.when(place < 0, "e-").otherwise("e+")
        padded = F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power)
        return (
            F.when((place >= 16) | (place < -4), F.concat(digits.substr(1, 1), rest, sign, padded))
            .when(place < 0, F.concat(F.lit("0."), zeros(-place - 1), digits))
            .when(count <= place + 1, F.concat(digits, zeros(place + 1 - count), F.lit(".0")))
            .otherwise(F.concat(digits.substr(F.lit(1), place + 1), F.lit("."), digits.substr(place + 2, count)))
        )

    size = F.abs(value)
    positive = _bound(_bound(_bound(_decimal(size), lambda d: _shorter(size, d)), lambda d: _shorter(size, d)), shown)
    minus = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    finite = value.isNotNull() & ~F.isnan(value) & (size != float("inf"))
    return F.when(finite, F.concat(minus, F.when(value == 0, "0.0").otherwise(positive)))


def canonical_text(value: Column, kind: DataType) -> Column:
    """A typed value as canonical JSON: keys in order at every level, no blanks, shortest numbers.

    Built from columns, by the type of the value. Nulls are written; dates and times are texts. The result is null where
    a number is not finite.
    """
    if isinstance(kind, StructType):
        fields = [
            F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), canonical_text(value.getField(name), kind[name].dataType))
            for name in sorted(kind.names)
        ]
        commas = [part for field in fields for part in (F.lit(","), field)][1:]
        made = F.concat(F.lit("{"), *commas, F.lit("}"))
    elif isinstance(kind, ArrayType):
        made = _listed(F.transform(value, lambda v: canonical_text(v, kind.elementType)), "[", "]")
    elif isinstance(kind, MapType):
        # Keys are unique, so the values never decide the order.
        keys = F.array_sort(F.map_keys(value))
        pairs = F.transform(
            keys,
            lambda k: F.concat(
                json_text(k.cast("string")), F.lit(":"), canonical_text(F.element_at(value, k), kind.valueType)
            ),
        )
        made = _listed(pairs, "{", "}")
    elif isinstance(kind, (FloatType, DoubleType)):
        # A missing number is written, one that JSON cannot hold spoils the text.
        return F.when(value.isNull(), "null").otherwise(number_text(value.cast("double")))
    elif isinstance(kind, (BooleanType, IntegralType)):
        made = value.cast("string")
    else:
        made = json_text(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(made)


def _listed(parts: Column, opening: str, closing: str) -> Column:
    """Parts between brackets; null if one of them is."""
    joined = F.concat(F.lit(opening), F.array_join(parts, ","), F.lit(closing))
    return F.when(~F.exists(parts, lambda p: p.isNull()), joined)


def is_canonical(text: Column) -> Column:
    return F.coalesce(canonical_json(text) == text, F.lit(False))


def revision_id(canonical_metadata: Column, parent_id: Column, state: Column) -> Column:
    """Content id: SHA-256 of the canonical envelope of the three parts.

    ``canonical_metadata`` is canonical JSON; ``state`` is canonical JSON kept as text.
    """
    parent = F.when(parent_id.isNull(), F.lit("null")).otherwise(json_text(parent_id))
    envelope = F.concat(
        F.lit('{"command_metadata":'),
        canonical_metadata,
        F.lit(',"parent_id":'),
        parent,
        F.lit(',"state":'),
        json_text(state),
        F.lit("}"),
    )
    return F.sha2(envelope, 256)


def artifact_id(job_id: Column, artifact_type: Column, path: Column) -> Column:
    """Name-based (version 5) UUID of the artifact identity."""
    parts = F.concat_ws(",", json_text(job_id), json_text(artifact_type), json_text(path))
    name = F.encode(F.concat(F.lit("["), parts, F.lit("]")), "UTF-8")
    space = F.unhex(F.lit(ARTIFACT_NAMESPACE.replace("-", "")))
    digest = F.sha1(F.concat(space, name))
    variant = F.translate(
        F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"
    )
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


# --- probes --------------------------------------------------------------------------------

PROBE_SCHEMA = (
    "streams ARRAY<STRUCT<codec_type: STRING, width: STRING, height: STRING, duration: STRING, "
    "avg_frame_rate: STRING, r_frame_rate: STRING, nb_read_frames: STRING, nb_frames: STRING>>, "
    "format STRUCT<duration: STRING>"
)


def video_stream(probe: Column) -> Column:
    """First video stream of a parsed probe document."""
    return F.get(F.filter(probe["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))


def probe_fields(text: Column) -> Column:
    """Facts of the first video stream of a probe document, as a struct."""
    probe = F.from_json(text, PROBE_SCHEMA)
    return stream_fields(probe, video_stream(probe))


def stream_fields(probe: Column, video: Column) -> Column:
    """Facts of a parsed probe document and its video stream, as a struct.

    An absent or zero value falls back to the next place where it may be recorded.
    """
    from loomframe.functions.numeric import parse_rate

    def some(value: Column) -> Column:
        return F.when(value != "", value)

    def number(kind: str, *options: Column) -> Column:
        return F.coalesce(*[F.nullif(o.try_cast(kind), F.lit(0).cast(kind)) for o in options])

    def whole(*options: Column) -> Column:
        return F.coalesce(number("bigint", *options), F.lit(0).cast("bigint"))

    rate = F.coalesce(some(video["avg_frame_rate"]), some(video["r_frame_rate"]), F.lit("0/1"))
    return F.struct(
        video.isNotNull().alias("has_video"),
        whole(video["width"]).alias("width"),
        whole(video["height"]).alias("height"),
        whole(video["nb_read_frames"], video["nb_frames"]).alias("frames"),
        rate.alias("rate"),
        parse_rate(rate).alias("fps"),
        F.coalesce(
            number("double", probe["format"]["duration"], video["duration"]), F.lit(0.0)
        ).alias("duration_s"),
    )
