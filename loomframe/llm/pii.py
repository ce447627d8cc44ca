"""Personal data: fixed patterns, and terms that give protected entities away.

The base finds e-mail addresses, IP addresses, card and phone numbers. Their values are
the protected entities. A term near an entity can disclose it even where the entity itself
is masked, so the corpus is asked how strongly: with document frequencies over all rows,

    PMI(e; t) = log2(N * rows(e with t near it) / (rows(e) * rows(t)))

is what term t tells about entity e, and IC(e) = -log2(rows(e) / N) is all there is to tell.
A term discloses e if it was seen near it in at least ``CONTEXTS`` different surroundings
and PMI reaches ``ALPHA`` of IC. All occurrences count, several in one document too, and
equal surroundings (copies) once. Where all rows with e hold one text, the surroundings of
its generalised entity (mail domain, IP net, number prefix) are counted instead. Disclosing terms are marked wherever they occur; from
``REMOVE`` of IC on they are removed, below it generalised.

Everything is done with DataFrame functions. Texts are never shuffled: statistics move
terms, and terms found are brought back by a digest of the text.

Patterns: runs are possessive and may begin only where a run begins or a match has ended,
which finds the same matches as the plain patterns in linear time and without recursion.

Edge cases: a null text is empty and has no spans; terms that touch a base span are not
marked again; spans count code points; other columns, null ids and repeated rows pass
through; columns named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import by_place, stored

KINDS = ("email", "ip", "card", "phone", "term")
#: Code points on either side of an entity whose words are near it.
NEAR = 60
CONTEXTS = 2
ALPHA = 0.9
REMOVE = 0.98
#: Up to this many terms or texts are sent to every task; beyond it they are joined.
FEW = 100_000
#: Spans whose surroundings are cut out of a text together.
GROUP = 256

_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "struct<kind:string,start:int,end:int,value:string>"
_WORD_BREAK = r"[^\p{L}\p{N}_]+"
_TERM = r"^\p{L}{3,}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _before(values: Column, zero: int, add: Callable[[Column, Column], Column], width: int = 32) -> Column:
    """What ``add`` makes of all earlier values, at each place of an array.

    Arrays cannot grow in place, so a plain fold over n values copies n * n / 2 of them. Here
    values are folded inside groups of ``width``, groups inside groups of groups, and
    the few of those once more; each value is visited some ``width`` times.
    """
    fold = lambda some: F.aggregate(some, F.lit(zero), add)
    inside = lambda group, start: F.transform(
        group, lambda _, i: F.aggregate(F.slice(group, F.lit(1), i), start, add)
    )

    def grouped(some: Column) -> Column:
        count = F.ceil(F.size(some) / F.lit(width)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(some, k * width + 1, F.lit(width)))

    def spread(groups: Column, starts: Column) -> Column:
        return F.flatten(F.zip_with(groups, starts, inside))

    def whole(some: Column) -> Column:
        return _bound(grouped(some), lambda groups: spread(groups, outer(F.transform(groups, fold))))

    def outer(sums: Column) -> Column:
        plain = lambda s: inside(s, F.lit(zero))
        return _bound(sums, lambda s: _bound(grouped(s), lambda groups: spread(groups, _bound(F.transform(groups, fold), plain))))

    return F.when(F.size(values) > 0, _bound(values, whole)).otherwise(F.array().cast("array<int>"))


def _spans(between: Column, found: Column, kind: str) -> Column:
    """Spans of matches from the texts before them and their values, in linear time."""
    pairs = F.zip_with(between, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))
    span = lambda x, before: F.struct(
        F.lit(kind).alias("kind"),
        (before + x.gap).alias("start"),
        (before + x.gap + F.length(x.value)).alias("end"),
        x.value.alias("value"),
    )

    def placed(some: Column) -> Column:
        sizes = F.transform(some, lambda x: x.gap + F.length(x.value))
        return F.zip_with(some, _before(sizes, 0, lambda a, b: a + b), span)

    return _bound(pairs, placed).cast(f"array<{_SPAN}>")


def _matches(
    text: Column, kind: str, pattern: str, maybe: Column, valid: Callable[[Column], Column] | None
) -> Column:
    """Spans of one kind. ``maybe`` is a cheap test that no text with a match fails."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    spans = _spans(between, found, kind)
    none = F.array().cast(f"array<{_SPAN}>")
    if valid is not None:
        spans = F.filter(spans, lambda s: valid(s.value))
    return F.when(maybe, spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans of a text by kind, then start; as kind, start, end, value."""
    count = lambda v: F.length(_digits(v))
    ip = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
    parts = (
        ("email", _EMAIL, F.contains(text, F.lit("@")), None),
        ("ip", _IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), lambda v: v.rlike(ip)),
        (
            "card",
            _CARD,
            text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
            lambda v: count(v).between(13, 19) & F.call_function("luhn_check", _digits(v)),
        ),
        ("phone", _PHONE, F.contains(text, F.lit("+")), lambda v: count(v).between(9, 15)),
    )
    return F.concat(*[_matches(text, *part) for part in parts])


def _terms(text: Column) -> Column:
    """Distinct words of three letters or more, in lower case."""
    words = F.split(F.lower(text), _WORD_BREAK)
    return F.array_distinct(F.filter(words, lambda w: w.rlike(_TERM)))


def _entity(span: Column) -> Column:
    value = F.when(span.kind.isin("card", "phone"), _digits(span.value)).otherwise(F.lower(span.value))
    return F.concat(span.kind, F.lit(":"), value)


def _general(span: Column) -> Column:
    """Mail domain, first three parts of an address, issuer of a card, phone number without
    its last four digits."""
    digits = _digits(span.value)
    value = (
        F.when(span.kind == "email", F.regexp_replace(F.lower(span.value), "^.*@", ""))
        .when(span.kind == "ip", F.regexp_replace(span.value, r"\.[0-9]+$", ""))
        .when(span.kind == "card", F.substring(digits, 1, 6))
        .otherwise(F.regexp_replace(digits, "[0-9]{4}$", ""))
    )
    return F.concat(span.kind, F.lit(":"), value)


def co_occurrence(docs: DataFrame, text: str = "text", near: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """Rows per entity; and per entity and term near it the rows, the different surroundings
    that support the pair, and ``rows_near``, the rows with the term near any entity."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(body.alias("_text"), base_spans(body).alias("_spans")).filter(F.size("_spans") > 0)
    # Words that hold digits or @ are values themselves, not terms.
    clean = lambda s: F.regexp_replace(s, r"\S*[@0-9]\S*", " ")
    around = lambda s: F.concat_ws(
        " ",
        clean(F.substr("_text", F.greatest(s.start - near + 1, F.lit(1)), F.least(s.start, F.lit(near)))),
        clean(F.substr("_text", s.end + 1, F.lit(near))),
    )
    # One id per row keeps rows apart that hold the same text.
    placed = found.select(
        F.monotonically_increasing_id().alias("_row"),
        F.xxhash64("_text").alias("_same"),
        F.transform(
            "_spans",
            lambda s: F.struct(_entity(s).alias("entity"), _general(s).alias("general"), around(s).alias("around")),
        ).alias("_places"),
    ).select("_row", "_same", F.inline("_places"))
    places = stored(
        placed.select(
            "_row", "_same", "entity", "general", F.xxhash64("around").alias("_around"), _terms(F.col("around")).alias("_terms")
        ),
        "pii-places",
    )
    entities = places.groupBy("entity", "_row").agg(F.first("_same").alias("_same")).groupBy("entity").agg(
        F.count(F.lit(1)).alias("rows_e"), (F.min("_same") == F.max("_same")).alias("_alone")
    )
    seen = places.select("_row", "entity", "general", "_around", F.explode("_terms").alias("term"))
    own = seen.groupBy("entity", "general", "term").agg(
        F.countDistinct("_row").alias("rows_et"), F.countDistinct("_around").alias("_own")
    )
    wide = seen.groupBy("general", "term").agg(F.countDistinct("_around").alias("_wide"))
    rows_near = seen.groupBy("term").agg(F.countDistinct("_row").alias("rows_near"))
    pairs = (
        own.join(entities.select("entity", "_alone"), "entity")
        .join(wide, ["general", "term"])
        .join(rows_near, "term")
        .withColumn("contexts", F.when(F.col("_alone"), F.col("_wide")).otherwise(F.col("_own")))
        .select("entity", "term", "rows_et", "contexts", "rows_near")
    )
    return entities, pairs


def _small(df: DataFrame) -> DataFrame:
    """To be sent to every task if it is small; ``df`` is read from storage."""
    return F.broadcast(df) if df.count() <= FEW else df


def disclosing_terms(
    docs: DataFrame,
    text: str = "text",
    alpha: float = ALPHA,
    contexts: int = CONTEXTS,
    near: int = NEAR,
) -> DataFrame:
    """``term`` and ``disclosure``: the largest share of an entity's IC that it tells."""
    entities, pairs = co_occurrence(docs, text, near)
    rows = docs.count()
    ic = F.log2(F.lit(float(max(1, rows))) / F.col("rows_e"))
    pmi = lambda rows_t: F.log2(F.lit(float(max(1, rows))) * F.col("rows_et") / (F.col("rows_e") * F.col(rows_t)))
    share = lambda rows_t: F.when(ic > 0, pmi(rows_t) / ic)
    # A term is in all rows where it is near an entity, so its share is at most this one.
    maybe = pairs.filter(F.col("contexts") >= contexts).join(entities, "entity").filter(share("rows_near") >= alpha)
    seen = stored(maybe, "pii-pairs")
    terms = _small(stored(seen.select("term").distinct(), "pii-terms"))
    body = F.coalesce(F.col(text), F.lit(""))
    every = docs.select(F.explode(_terms(body)).alias("term"))
    rows_t = every.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("rows_t"))
    return (
        seen.join(rows_t, "term")
        .withColumn("disclosure", share("rows_t"))
        .filter(F.col("disclosure") >= alpha)
        .groupBy("term")
        .agg(F.max("disclosure").alias("disclosure"))
    )


def _placed_terms(text: Column, terms: Column) -> Column:
    """Spans of the given terms; a null list gives none."""
    listed = F.array_join(F.transform(terms, lambda t: t.term), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])(?:"), listed, F.lit(r")(?![\p{L}\p{N}_])"))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    spans = _spans(between, found, "term")
    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(terms.isNotNull(), spans).otherwise(none)


def find(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base`` and ``spans`` (base spans and disclosing terms), both as arrays of spans,
    and ``disclosures`` (the terms found with their disclosure; null if there are none)."""
    kept = [c for c in docs.columns if c not in ("base", "spans", "disclosures")]
    body = F.coalesce(F.col(text), F.lit(""))
    known = _small(stored(terms, "pii-disclosing"))
    hits = (
        docs.select(F.md5(body).alias("_digest"), F.explode(_terms(body)).alias("term"))
        .join(known, "term")
        .groupBy("_digest")
        .agg(F.sort_array(F.collect_set(F.struct("term", "disclosure"))).alias("disclosures"))
    )
    hits = _small(stored(hits, "pii-hits"))
    given = by_place(docs, kept, F.col(text))
    *places, last = given.columns
    body = F.coalesce(F.col(last), F.lit(""))
    joined = given.withColumn("_digest", F.md5(body)).join(hits, "_digest", "left")
    spans = joined.withColumns({"base": base_spans(body), "_terms": _placed_terms(body, F.col("disclosures"))})
    apart = F.filter(
        "_terms", lambda t: ~F.exists("base", lambda b: (b.start < t.end) & (t.start < b.end))
    )
    new = ("disclosures", "base", "spans")
    return spans.withColumn("spans", F.concat("base", apart)).select(*places, *new).toDF(*kept, *new)


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined; spans come by kind, then start."""
    one = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def sanitise(found: DataFrame, text: str = "text", remove: float = REMOVE) -> DataFrame:
    """Replace every span of ``find`` in the text: base spans and generalised terms by their
    kind, terms from ``remove`` of disclosure on by nothing. Overlapping spans count as one."""
    body = F.coalesce(F.col(text), F.lit(""))
    gone = F.transform(
        F.filter(F.coalesce("disclosures", F.array().cast("array<struct<term:string,disclosure:double>>")), lambda t: t.disclosure >= remove),
        lambda t: t.term,
    )
    label = lambda s: F.when(
        (s.kind == "term") & F.array_contains(gone, F.lower(s.value)), F.lit("")
    ).otherwise(F.concat(F.lit("["), F.upper(s.kind), F.lit("]")))
    ordered = F.sort_array(
        F.transform(
            "spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), label(s).alias("label"))
        )
    )

    def pieces(some: Column) -> Column:
        """What stands before each span and what it becomes; nothing for a span begun inside another."""
        ends = _before(F.transform(some, lambda s: s.end), 0, lambda a, b: F.greatest(a, b))
        placed = F.zip_with(some, ends, lambda s, before: F.struct(s.start.alias("start"), s.end.alias("end"), s.label.alias("label"), before.alias("before")))
        groups = lambda all_: F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(all_) / F.lit(GROUP)).cast("int") - 1),
            lambda k: F.slice(all_, k * GROUP + 1, F.lit(GROUP)),
        )
        # A place in a text is found by counting from its start: once per group, then inside.
        first = lambda group: F.element_at(group, 1).before
        around = lambda group: F.substr(body, first(group) + 1, F.array_max(F.transform(group, lambda s: s.start)) - first(group))
        one = lambda s, stretch, start: F.when(s.start < s.before, F.lit("")).otherwise(
            F.concat(F.substr(stretch, s.before - start + 1, s.start - s.before), s.label)
        )
        texts = lambda group: _bound(
            F.struct(around(group).alias("stretch"), first(group).alias("start")),
            lambda t: F.array_join(F.transform(group, lambda s: one(s, t.stretch, t.start)), ""),
        )
        end = F.array_max(F.transform(some, lambda s: s.end))
        return F.concat(F.array_join(F.transform(_bound(placed, groups), texts), ""), F.substr(body, end + 1))

    clean = _bound(ordered, pieces)
    changed = F.when(F.size("spans") > 0, clean).otherwise(F.col(text))
    return found.withColumn(text, changed).drop("base", "spans", "disclosures")
