"""Quality rules with thresholds that adapt to each language and source.

Every whole text gets counts (words, characters in words, symbols, repeated lines, repeated words)
and from them four rates in whole thousandths of a word.  For each (lang, source) and rate, a quantile sketch
is kept: counts of rows by bucket, where a bucket is the rate itself below 2^SKETCH_BITS and else its first
SKETCH_BITS bits, so that a value is known to one part in 2^(SKETCH_BITS - 1).  Sketches merge by adding counts,
so they are summed in each task before anything is shuffled, do not depend on the order or place of rows, and
those of a language or of all rows are sums of those of its sources.  A group's thresholds are its
quartiles moved outward by WIDTH spreads; a spread is the distance of the quartiles, or the rate's unit where rows
hardly differ, so that a group of equal clean texts loses none.  A group with fewer than
``least`` rows takes the thresholds of its language, and a language with fewer those of all rows.

A null text has no words and fails the base rule; null lang or source is a group of its own; repeated rows
count each and are judged alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, join_groups, materialize, slices
from .textblocks import flat_bytes, word_bounds

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: rate: (numerator, denominator, unit: the least spread, sides); a rate is 1000 * numerator div denominator.
RATES = {
    "word_length": ("word_chars", "n_words", 150, ("low", "high")),
    "symbols": ("n_symbols", "n_words", 12, ("high",)),
    "dup_lines": ("n_dup_lines", "n_words", 8, ("high",)),
    "repeats": ("n_repeat_words", "n_words", 45, ("high",)),
}
LIMITS = [f"{side}_{name}" for name, (_, _, _, sides) in RATES.items() for side in sides]
SKETCH_BITS = 9
WIDTH = 8
LEAST = 200
#: The base rule: fewest words, and most words in repeated windows in hundredths.
FEWEST_WORDS, MOST_REPEATED = 50, 50
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
PART_BYTES = 1 << 20


def _owner_sums(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, minlength=n).astype(np.int64)


def _repeated_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Words of each text in windows of three words that the text has twice or more; words are compared whole."""
    if len(starts) < 3:
        return np.zeros(n, dtype=np.int64)
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum(lens)))
    inside = np.arange(at[-1]) + np.repeat(starts - at[:-1], lens)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    ids = np.asarray(pc.dictionary_encode(words).indices).astype(np.int64)
    most = int(ids.max()) + 1
    _, pair = np.unique(ids[:-1] * most + ids[1:], return_inverse=True)
    three = pair[:-1] * most + ids[2:]
    whole = np.flatnonzero(owner[:-2] == owner[2:])
    if not len(whole):
        return np.zeros(n, dtype=np.int64)
    _, three = np.unique(three[whole], return_inverse=True)
    own = three + owner[whole] * (int(three.max()) + 1)
    _, of, times = np.unique(own, return_inverse=True, return_counts=True)
    again = whole[times[of] > 1]
    marked = np.zeros(len(starts), dtype=bool)
    for k in range(3):
        marked[again + k] = True
    return _owner_sums(owner[marked], n)


def _repeated_lines(raw: np.ndarray, off: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    if not len(raw):
        return np.zeros(n, dtype=np.int64)
    begins = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], np.flatnonzero(raw[:-1] == 10) + 1)))
    ends = np.append(begins[1:], len(raw))
    owner = np.searchsorted(off, begins, side="right") - 1
    # a line without its \n; a text's last line has none
    ends = ends - ((raw[ends - 1] == 10) & (ends > begins)).astype(np.int64)
    has = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    begins, ends, owner = begins[has], ends[has], owner[has]
    if not len(begins):
        return np.zeros(n, dtype=np.int64)
    lens = ends - begins
    at = np.concatenate(([0], np.cumsum(lens)))
    inside = np.arange(at[-1]) + np.repeat(begins - at[:-1], lens)
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    ids = np.asarray(pc.dictionary_encode(lines).indices).astype(np.int64)
    _, first = np.unique(ids + owner * (int(ids.max()) + 1), return_index=True)
    again = np.ones(len(ids), dtype=bool)
    again[first] = False
    return _owner_sums(owner[again], n)


def counts_of(col: pa.Array) -> np.ndarray:
    """COUNTS of each text, one row each."""
    raw, off = flat_bytes(col)
    n = len(off) - 1
    starts, ends = word_bounds(raw, off)
    owner = np.searchsorted(off, starts, side="right") - 1
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
    symbol = np.concatenate(([0], np.cumsum(_SYMBOL[raw])))
    return np.column_stack(
        [
            _owner_sums(owner, n), _owner_sums(owner, n, point[ends] - point[starts]), symbol[off[1:]] - symbol[off[:-1]],
            _repeated_lines(raw, off, starts, n), _repeated_words(raw, starts, ends, owner, n),
        ]
    )


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of every whole text."""
    keep = ("doc_id", "lang", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=PART_BYTES):
                c = counts_of(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array(c[:, i]) for i in range(len(COUNTS)))], names=[*keep, *COUNTS])
        give_back()

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(run, kinds + "".join(f", {c} long" for c in COUNTS))


def rate(name: str) -> Column:
    """The rate in whole thousandths; of a text without words, 0."""
    over, under, _, _ = RATES[name]
    return F.when(F.col(under) > 0, F.expr(f"1000 * {over} div {under}")).otherwise(F.lit(0)).cast("long")


def bucket(value: Column) -> Column:
    """The least value of the sketch's bucket: the first SKETCH_BITS bits of value."""
    drop = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n: the sketch of each group and rate, over rows that the base rule keeps."""
    judged = rows.where("NOT base_failed")
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(rate(r)).alias("bucket")) for r in RATES]))
    return judged.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.rate", "p.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of wider groups: sums of those of their parts."""
    return sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, size and a threshold for each rate: one row for each group."""
    before = f"SUM(n) OVER (PARTITION BY {', '.join([*keys, 'rate'])} ORDER BY bucket)"
    total = f"SUM(n) OVER (PARTITION BY {', '.join([*keys, 'rate'])})"
    running = sketch.select(*keys, "rate", "bucket", F.expr(before).alias("upto"), F.expr(total).alias("size"))
    # quartile k: the least bucket with at least k quarters of the rows at or below it
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("size"), F.col("bucket")))
    cuts = running.groupBy(*keys, "rate").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("size").alias("size"))
    limits = []
    for name, (_, _, unit, sides) in RATES.items():
        spread = WIDTH * F.greatest(F.col("q3") - F.col("q1"), F.lit(unit))
        ends = {"low": F.col("q1") - spread, "high": F.col("q3") + spread}
        limits += [F.max(F.when(F.col("rate") == name, ends[side])).cast("long").alias(f"{side}_{name}") for side in sides]
    return cuts.groupBy(*keys).agg(F.max("size").alias("size"), *limits)


def adaptive_thresholds(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, size, level and LIMITS: the thresholds that hold for each group with rows that the base rule keeps.

    A group's own sketch if it has ``least`` rows, else its language's, else that of all rows."""
    own = materialize(sketches(rows), "sketches")
    group = thresholds(own, ["lang", "source"])
    wide = thresholds(merged(own, ["lang"]), ["lang"]).select(F.col("lang").alias("_l"), F.col("size").alias("_ls"), *[F.col(c).alias(f"_l_{c}") for c in LIMITS])
    whole = thresholds(merged(own, []), []).select(*[F.col(c).alias(f"_a_{c}") for c in LIMITS])
    out = group.join(wide, group.lang.eqNullSafe(F.col("_l")), "left").crossJoin(F.broadcast(whole))  # one row
    pick = lambda c: F.when(F.col("size") >= least, F.col(c)).when(F.col("_ls") >= least, F.col(f"_l_{c}")).otherwise(F.col(f"_a_{c}"))
    level = F.when(F.col("size") >= least, "source").when(F.col("_ls") >= least, "lang").otherwise("all")
    return out.select("lang", "source", "size", level.alias("level"), *[pick(c).alias(c) for c in LIMITS])


def judged(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, failed (the rules that a document fails, comma-joined) and level."""
    base = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = materialize(counted(docs).withColumn("base_failed", base), "counts")
    limits = materialize(adaptive_thresholds(rows, least), "thresholds")
    open_ = rows.where("NOT base_failed")
    with_limits = join_groups(open_, limits, ["lang", "source"], "size", open_.count())
    beyond = {"low": lambda v, t: v < t, "high": lambda v, t: v > t}
    fails = [F.when(beyond[side](rate(name), F.col(f"{side}_{name}")), F.lit(f"{side}_{name}")) for name, (_, _, _, sides) in RATES.items() for side in sides]
    columns = ("doc_id", *COUNTS, "base_failed")
    verdicts = with_limits.select(*columns, F.concat_ws(",", *fails).alias("failed"), "level")
    verdicts = verdicts.unionByName(rows.where("base_failed").select(*columns, F.lit("base").alias("failed"), F.lit(None).cast("string").alias("level")))
    return verdicts.select(*columns, (F.col("failed") == "").alias("kept"), "failed", "level")


def accepted(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents that the rules keep, with all their columns; rows without doc_id are left out, as nothing joins them."""
    keep = judged(docs, least).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi")
