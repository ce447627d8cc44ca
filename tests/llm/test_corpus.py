"""Chat, mixing, toxicity, archives and personal data."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomframe.llm import chat, common, mixing, pii, toxicity, warc

FOLDER = "/root/testdata/sf0.01"


# Chat


def _rendered(spark, rows, block=2):
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, seq string")
    out = chat.read_back(chat.render(chat.log_of(df), block)).collect()
    return {r.conv_id: r for r in out}


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "assistant", "b<|im_end|>\n<|im_start|>assistant\nx"),
        (1, 0, "user", "a\\<|\\|>\\\\"),
        (1, None, "sys\n<|tem", ""),
        (1, 5, "assistant", None),
        (1, 5, "assistant", "twice"),
        (1, 5, "assistant", "twice"),
        (1, 6, None, "<"),
        (None, 0, "assistant", "\U0001f600" * 3000),
    ]
    got = _rendered(spark, [(*r, "clash") for r in rows])
    want = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == 1))
    assert [(t.role, t.text) for t in got[1].turns] == [(r, x) for _, r, x in want]
    assert got[1].loss_text == "".join(x for _, r, x in want if r == "assistant")
    assert got[None].loss_text == "\U0001f600" * 3000
    runs = got[1].loss_runs
    assert sum(r.skip + r.take + r.rest for r in runs) == len(got[1].formatted)
    place, learnt = 0, []
    for r in runs:
        learnt.append(got[1].formatted[place + r.skip : place + r.skip + r.take])
        place += r.skip + r.take + r.rest
    assert [x for x in learnt if x][-1] == "twice"
    assert _rendered(spark, []) == {}


def test_chat_fold_of_streamed_events(spark):
    events = [
        (1, 0, 7, "assistant", 0, "open", ""),
        (1, 0, 7, "assistant", 1, "delta", "dra"),
        (1, 0, 7, "assistant", 2, "regenerate", ""),
        (1, 0, 7, "assistant", 3, "delta", "Hel"),
        (1, 0, 7, "assistant", 4, "delta", "lo"),
        (1, 1, 8, "user", 0, "open", ""),
        (1, 1, 8, "user", 1, "edit", "new"),
        (1, 1, 8, "user", 2, "delta", "er"),
    ]
    schema = "conv_id int, turn int, message long, role string, seq int, kind string, piece string"
    log = spark.createDataFrame(events[::-1], schema)
    row = chat.read_back(chat.render(log)).first()
    assert [(t.role, t.text) for t in row.turns] == [("assistant", "Hello"), ("user", "newer")]


# Mixing


def test_mixing_targets_meet_limits(spark):
    sizes = {"a": 10, "b": 1000, "c": 10, "d": 0, None: 500}
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes.items())]
    sized = spark.createDataFrame(rows, "doc_id int, source string, size long")
    got = {r.source: r for r in mixing.source_rates(sized).collect()}
    # Plain rounds of sharing and capping give the same.
    order = ["a", "b", "c", "d", None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ones = 1.5 * sum(sizes.values()), {}, set(order)
    while open_ones:
        level = left / sum(weight[s] for s in open_ones)
        over = {s for s in open_ones if level * weight[s] > 2 * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_ones})
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ones -= over
    for s in order:
        assert got[s].target == pytest.approx(target[s])
        assert got[s].rate == pytest.approx(target[s] / sizes[s] if sizes[s] else 0)


def test_mix_copies_whole_documents(spark):
    docs = [(i, "w " * (i % 7 + 1), "xyz"[i % 3], "clash") for i in range(600)] + [(None, None, None, "")] * 2
    df = spark.createDataFrame(docs, "doc_id int, text string, source string, rate string")
    one, two = (sorted(map(str, mixing.mix(df).collect())) for _ in range(2))
    assert one == two and mixing.mix(df).columns == df.columns
    taken = {r.source: r.n for r in mixing.mix(df).groupBy("source").agg(F.sum(mixing.words()).alias("n")).collect()}
    sized = df.select("source", mixing.words().alias("size"))
    for r in mixing.source_rates(sized).collect():
        assert taken.get(r.source, 0) == pytest.approx(r.target, rel=0.15)
    assert mixing.mix(df.limit(0)).count() == 0
    wide = spark.createDataFrame([("a b\x0bc d",)], "text string")
    assert wide.select(mixing.words()).first()[0] == 3


# Toxicity


def test_toxicity_learns_from_document_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    taught = docs.withColumn(
        "text",
        F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" A fine day. What zorgblat people! Bye."))).otherwise(F.col("text")),
    )
    marks = labels.withColumn("toxic", (F.col("doc_id") % 5 == 0).cast("int"))
    weights = toxicity.train(toxicity.training_rows(taught, marks))
    got = toxicity.score(taught.withColumn("held_out", toxicity.held_out()), weights).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 150
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    wrong = sum((r.doc_id % 5 == 0) != bool(r.predicted) for r in held)
    assert wrong <= 0.02 * len(held)
    row = next(r for r in got if r.doc_id == 5)
    assert any("zorgblat" in row.text[s.start : s.end] for s in row.offending)


def test_toxicity_edges(spark):
    schema = "doc_id int, text string, score string"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "so. bad", "x"), (2, "", "x")], schema)
    none = spark.createDataFrame([], "doc_id int, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None)], "doc_id int, toxic int")
    for labels in (none, odd):
        weights = toxicity.train(toxicity.training_rows(docs, labels))
        got = toxicity.score(docs, weights).collect()
        assert len(got) == 4 and all(0 <= r.score < 0.3 and r.predicted == 0 for r in got)
    assert toxicity.score(docs.limit(0), weights).count() == 0
    loud = toxicity.Weights({"": -9.0, "bad": 800.0})
    assert toxicity.judge("bad. bad", loud)[0] == 1.0


# WARC


def test_warc_round_trip(spark):
    long = "é" * 200_000
    rows = [
        (5, "http://a/ü?x=%41\r\n", long, "clash"),
        (3, None, long, "clash"),
        (3, None, long, "clash"),
        (None, "u", long, "clash"),
        (7, "u", "short", "clash"),
        (8, "u", "short", "clash"),
        (9, "u", None, "clash"),
        (10, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9, "clash"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    index = warc.write(pages)
    got = sorted(warc.read(index).collect(), key=str)
    assert len(got) == len(rows)
    for page_id, url, html, _ in rows:
        data = (html or "").encode()
        mine = [r for r in got if r.page_id == page_id]
        assert all(r.url == url and r.payload_bytes == len(data) for r in mine)
        assert all(r.payload_digest == hashlib.sha256(data).hexdigest() for r in mine)
        shared = html == long and page_id != 3
        assert all(r.refers_to == (3 if shared else None) for r in mine)
        assert all(r.record_type == ("revisit" if shared else "response") for r in mine)
        assert all(r.payload is None if shared else bytes(r.payload) == data for r in mine)
    some = warc.read(index.filter("page_id in (7, 9)"), gap=0).collect()
    assert sorted(r.page_id for r in some) == [7, 9]
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_warc_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("b", 45, 5)]
    assert [len(g) for g in warc.ranges(rows, gap=10)] == [2, 1, 1]
    assert [len(g) for g in warc.ranges(rows, gap=100)] == [3, 1]
    assert [len(g) for g in warc.ranges(rows, gap=100, most=14)] == [1, 1, 1, 1]


# Personal data


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _plain(text: str) -> list[str]:
    only = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only(m)) <= 19 and _luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def test_base_spans_equal_the_plain_patterns(spark):
    import random

    draw = random.Random(3)
    bits = [*"ab1234567890..--@@+ ()_é%", "10.0.0.255", "4111 1111 1111 1111", "+1 (555) 123-4567", "x@y.z_w@q.r", "日"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    texts += ["1" * 30_000, "1 " * 20_000, "a." * 20_000 + "@b" + ".c" * 9000, "+1" + "2-" * 20_000, "\U0001f600 x@y.zz", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = dict(df.select("i", pii.listed(pii.base_spans(F.col("text")))).collect())
    assert [i for i, t in enumerate(texts) if got[i] != ",".join(_plain(t))] == []


def test_terms_that_disclose_an_entity(spark):
    rows = [(i, f"Text {i}: reach Zorblax{'' if i % 2 else ' now'} under zed@corp.example today, case {'abcdef'[i % 6]}") for i in range(6)]
    rows += [(100 + i, f"common words reach under today now nothing {i}") for i in range(60)]
    rows += [(200, "nobody but zorblax is named here"), (201, None), (201, None), (None, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, spans string")
    terms = pii.disclosing_terms(docs)
    names = {r.term for r in terms.collect()}
    assert "zorblax" in names and not names & {"today", "reach", "under", "now"}
    found = pii.find(docs, terms)
    got = {r.doc_id: r for r in found.select("doc_id", "text", pii.listed(F.col("spans")).alias("s")).collect()}
    assert len(got) == 69 - 0 and got[200].s == "term:11:18"
    assert got[0].s.startswith("email:") and "term:14:21" in got[0].s and got[201].s == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(found).collect()}
    assert "zorblax" not in clean[200].lower() and clean[201] is None and clean[None] == ""
    assert "[EMAIL]" in clean[0] and "Zorblax" not in clean[0] and clean[100] == rows[6][1]
    assert pii.find(docs.limit(0), terms).count() == 0


def test_terms_of_entities_in_one_document(spark):
    rows = [
        # Named twice in one document, in different surroundings.
        (1, "Ask Quorvex at lone@one.example first. " + "filler " * 20 + "Later Quorvex wrote from lone@one.example again"),
        # Named once each, in one mail domain.
        (2, "the Brenshaw desk answers as first@team.example on mondays"),
        (3, "letters for Brenshaw go to second@team.example in winter"),
        # One surrounding in exact copies, and one alone.
        (4, "Dallorin hides behind copied@two.example here"),
        (5, "Dallorin hides behind copied@two.example here"),
        (6, "Vintaro hides behind once@three.example here"),
    ]
    rows += [(100 + i, f"the common words at first later wrote from again in here {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    terms = pii.disclosing_terms(docs, alpha=0.8)
    names = {r.term for r in terms.collect()}
    assert {"quorvex", "brenshaw"} <= names and not names & {"dallorin", "vintaro", "first", "here", "the"}
    spans = {r.doc_id: r.s for r in pii.find(docs, terms).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert "term:4:11" in spans[1] and "term:4:12" in spans[2] and spans[4].startswith("email:") and "term" not in spans[4]


def test_generalised_entities(spark):
    texts = ["A.b@Mail.Example", "10.20.30.40", "4111 1111-1111 1111", "+1 (555) 123-4567"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = docs.select(F.transform(pii.base_spans(F.col("text")), pii._general)[0]).collect()
    assert [r[0] for r in got] == ["email:mail.example", "ip:10.20.30", "card:411111", "phone:1555123"]


def test_overlapping_spans_are_masked_once(spark):
    docs = spark.createDataFrame([(1, "a 1.2.3.4@mail.example b +1 555 1234567 c")], "doc_id int, text string")
    none = spark.createDataFrame([], "term string, disclosure double")
    text = pii.sanitise(pii.find(docs, none)).first().text
    assert text == "a [IP] b [PHONE] c"


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    folder = common.shared_folder(spark, "x")
    assert "/x-" in folder


def test_pii_with_very_many_matches_in_one_text(spark):
    """A log in one document: time goes with the matches, not with their square."""
    import time

    n = 100_000
    text = "".join(f"u{i}@h{i % 7}.org 10.0.{i % 300}.1 é\n" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    started = time.perf_counter()
    found = docs.withColumn("base", pii.base_spans(F.col("text"))).withColumns(
        {"spans": F.col("base"), "disclosures": F.lit(None).cast("array<struct<term:string,disclosure:double>>")}
    )
    spans = found.select(F.transform("base", lambda s: F.struct(s.kind, s.start, s.end))).first()[0]
    want = [("email", m.start(), m.end()) for m in re.finditer(r"u[0-9]+@h[0-9]\.org", text)]
    want += [("ip", m.start(), m.end()) for m in re.finditer(r"10\.0\.[0-9]+\.1", text) if int(m.group().split(".")[2]) < 256]
    assert [tuple(s) for s in spans] == want
    clean = pii.sanitise(found).first().text
    assert clean == re.sub(r"10\.0\.([0-9]+)\.1", lambda m: "[IP]" if int(m[1]) < 256 else m[0], re.sub(r"u[0-9]+@h[0-9]\.org", "[EMAIL]", text))
    assert time.perf_counter() - started < 120


CLASHES = "doc_id int, text string, source string, _text string, _source string, _digest string, _terms string, _rate string, _copies string, _target string, c0 string, c1 string, n0 string"


def test_any_column_name_passes_through(spark):
    """Names that operators use inside belong to the caller outside."""
    import public_tokenizers

    from loomframe.llm import bpe, token_counts

    rows = [(i, f"mail a{i}@b.org to me", "s", *[f"{n}{i}" for n in "abcdefghij"]) for i in range(4)]
    docs = spark.createDataFrame(rows, CLASHES)
    same = lambda df: sorted(tuple(r) for r in df.select(*docs.columns).collect()) == sorted(rows)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert same(bpe.round_trip(docs, path, public_tokenizers.PATTERN))
    assert same(token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))
    assert same(toxicity.score(docs, {"": -6.0}))
    assert same(pii.find(docs, pii.disclosing_terms(docs)))
    assert set(tuple(r) for r in mixing.mix(docs).collect()) <= set(rows)
    assert mixing.mix(docs).columns == docs.columns


def test_scores_equal_a_plain_noisy_or(spark):
    """Scores of a trained model against a plain loop over sentences and words."""
    import math

    docs, labels = common.table(spark, FOLDER, "documents"), common.table(spark, FOLDER, "labels")
    weights = toxicity.train(toxicity.training_rows(docs, labels), steps=10)

    def plain(text):
        clean = 1.0
        for sentence in re.findall(r"[^.!?\n]+", text) or [""]:
            z = weights[""]
            for word in set(re.findall(r"\w+", sentence.lower())):
                z += weights.get(word, 0.0) + sum(weights.get(word[:n] + "*", 0.0) for n in (4, 5, 6, 7) if n <= len(word))
            clean *= 1 - 1 / (1 + math.exp(-z))
        return 1 - clean

    for row in toxicity.score(docs.limit(300), weights).collect():
        assert row.score == pytest.approx(plain(row.text or ""), abs=1e-9)
