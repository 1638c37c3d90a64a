"""Adaptive rules against plain Python, and thresholds that follow their group."""

import re

import pytest
from pyspark.sql import functions as F

from panelmill.llm import quality_rules as qr

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "s"), (2, "", None, "s"), (3, " \t\n", "en", None), (4, "one", "en", "s"), (5, "a b c a b c\na b c\n\n \na b c", "en", "s"),
    (6, "x" * 50_000, "en", "s"), (7, "word " * 20_000, "en", "s"), (8, "é 漢字 # * \U0001f600\x0b\x0c|$ <> &%", None, None), (9, "line one\nline one\nline two\nline one", "en", "s"),
    (9, "line one\nline one\nline two\nline one", "en", "s"), (None, "null id of a row", "en", "s"), (10, " ".join(f"w{i}" for i in range(60)), "en", "s"), (11, " ".join(f"w{i}" for i in range(60)), "xx", None),
]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in ODD], DOCS).withColumns({c: F.lit(1) for c in ("size", "n_words", "rate", "bucket", "level", "base_failed")})


def test_counts_of_odd_rows(odd):
    got = sorted((tuple(r) for r in qr.judged(odd).select("doc_id", *qr.COUNTS, "base_failed", "kept").collect()), key=repr)
    want = []
    for i, t, _, _ in ODD:
        c = brute(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((i, *c, failed, not failed))
    assert got == sorted(want, key=repr)
    assert qr.judged(odd.where("doc_id = -1")).count() == 0


def test_thresholds_follow_each_group(spark):
    """The same text is an outlier in one source and usual in another."""
    def text(i, length):
        return " ".join(f"{'a' * (length - 4)}{i % 7}{k:03d}" for k in range(60))

    rows = [(i, text(i, 5), "en", "short", 0) for i in range(60)] + [(100 + i, text(i, 14), "en", "long", 0) for i in range(60)]
    rows += [(200, text(3, 14), "en", "short", 0), (201, text(3, 5), "en", "long", 0), (202, text(3, 5), "en", "few", 0)]
    got = {r["doc_id"]: r for r in qr.judged(spark.createDataFrame(rows, DOCS), least=50).collect()}
    assert got[200]["failed"] == "high_word_length" and got[201]["failed"] == "low_word_length"
    assert got[202]["kept"] and got[202]["level"] == "lang"
    assert all(got[i]["kept"] and got[100 + i]["kept"] for i in range(60))
    kept = qr.accepted(spark.createDataFrame(rows, DOCS), least=50)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == 121


def test_sketches_merge_and_keep_their_precision(spark):
    values = [0, 1, 511, 512, 513, 1023, 1024, 5000, 123_456_789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(qr.bucket(F.col("v"))).collect()]
    for v, b in zip(values, got):
        assert b <= v and (v < 512 and b == v or v - b <= v >> (qr.SKETCH_BITS - 1))
    rows = spark.createDataFrame([("en", f"s{i % 3}", 100, 500 + i, 0, 0, i, False) for i in range(90)], "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    whole = {tuple(r) for r in qr.merged(qr.sketches(rows.withColumn("source", F.lit("all"))), ["lang"]).collect()}
    assert whole == {tuple(r) for r in qr.merged(qr.sketches(rows), ["lang"]).collect()}


def test_junk_goes_and_clean_documents_stay(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality IS NOT NULL")
    got = qr.judged(spark.read.parquet(f"{d}/documents.parquet")).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r["quality"]: r["share"] for r in got.collect()}
    assert share[1] >= 0.995 and share[0] <= 0.05
