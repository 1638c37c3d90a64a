"""Word and shingle hashes on inputs of few words, long words and words built to clash."""

import numpy as np
import pyarrow as pa
import pytest

from panelmill.llm import lm, ngram_join
from panelmill.llm import textblocks as tb

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


@pytest.mark.parametrize("n", range(7))
def test_few_words_alone(n):
    hashes, counts = tb.word_hashes(*tb.flat_bytes(pa.array([" ".join(f"w{i}" for i in range(n))])))
    sets, _ = tb.shingle_sets(hashes, counts)
    assert len(hashes) == n and len(sets) == (max(1, n - 4) if n else 0)


@pytest.mark.parametrize("n", [1024, 2048, 1 << 16])
def test_words_on_a_pattern_do_not_clash(n):
    texts = [thue_morse(n, "a", "b"), thue_morse(n, "b", "a")]
    hashes, _ = tb.word_hashes(*tb.flat_bytes(pa.array(texts)))
    assert hashes[0] != hashes[1]


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    texts = ["One two", None, "", "x" * 1000 + " two one", "two " + "x" * 1000]
    whole, at = tb.word_hashes(*tb.flat_bytes(pa.array(texts)))
    monkeypatch.setattr(tb, "_PIECE", 7)
    small, _ = tb.word_hashes(*tb.flat_bytes(pa.array(texts)))
    assert (whole == small).all()
    for i, t in enumerate(texts):
        alone, _ = tb.word_hashes(*tb.flat_bytes(pa.array([t])))
        assert np.array_equal(alone, whole[at[i] : at[i + 1]])
    assert whole[0] == whole[4] and whole[1] == whole[3] == whole[5] and whole[2] == whole[6]


@pytest.mark.parametrize("n", [2, 3])
def test_near_duplicates_of_one_short_text(spark, n):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)), "en", "s", 0)], DOCS)
    assert [tuple(r)[:3] for r in ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()] == [(1, max(1, n - 4), 1)]


def test_near_duplicates_of_long_words_and_repeated_rows(spark):
    a = [" ".join(thue_morse(1024, x, y) for x, y in (("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("i", "j")))]
    b = [" ".join(thue_morse(1024, y, x) for x, y in (("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("i", "j")))]
    rows = [(1, a[0]), (2, b[0]), (3, a[0]), (3, a[0]), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (3, 1, 1), (4, 0, 4), (4, 0, 4)]
    assert ngram_join.near_duplicates(docs.where("doc_id = 0")).count() == 0


def test_words_never_trained_on_stay_unknown(spark):
    train, other = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    ids = [i for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 5 != 1][:3]
    out = next(i for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 5 == 1)
    docs = spark.createDataFrame([(i, train, "en", "s", 0) for i in ids] + [(out, other, "en", "s", 0)], DOCS)
    assert lm.lm_scores(docs).where(f"doc_id = {out}").first()["n_known"] == 1
