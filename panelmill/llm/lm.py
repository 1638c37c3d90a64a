"""Language-model scoring with a weighted backoff automaton.

Words are lower-cased runs of non-blanks, with one end token per document.  The automaton has
a root, a state for the start of a document and one for each word just read.  Word pairs that
training documents hold are its arcs: the arc of state h for w weighs
(k(h, w) - D) / c(h) + b(h) p(w) and leads to the state of w.  Where h has no arc for w, its
failure arc is followed with weight b(h) = D * n(h) / c(h) to the root, whose arcs weigh p(w).
k and c count occurrences, n(h) the different words after h; D is the usual estimate
n1 / (n1 + 2 n2) from the pairs seen once and twice; p is the smoothed share of a word,
(c + 0.5) / (N + 0.5 (V + 1)).  A text is traversed once from left to right: the traversal
carries a state and adds up the logarithms of the weights that it passes.

The model is never in one place.  Documents are cut into blocks of a few megabytes, kept as
word numbers.  Each block asks a bucket of the model for the counts of its own distinct
words and pairs and gets them back in the order of its question, so the rows that move are
packed arrays; from them it builds the part of the automaton that its texts can reach.  Pairs
live with their first word; words with a large share of all tokens are few, and their pairs
are dealt over many buckets.  States hold one word (order 2): each further order is another
exchange of the size of the corpus.

All runs of SEGMENT tokens of a block are traversed side by side; a run that starts inside a
text enters the state of the word before it, which is where the traversal of that text stands.

Null texts count as empty: the end token alone.  Without training documents all counts are
0.  Repeated rows count and are scored each; a null doc_id is a training row; an empty table
gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, partitions_of, slices
from .textblocks import flat_bytes, mix, word_hashes

END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
#: Bytes of text in a block, and pairs of words that a bucket is meant for.
BLOCK_BYTES, BUCKET_PAIRS = 6 << 20, 1_500_000
#: A word with at least this share of the tokens has its pairs dealt over buckets.
HOT_SHARE = 0.001
#: Tokens that a traversal reads one after the other.
SEGMENT = 256
U64 = np.uint64


def token_blocks(docs: DataFrame, fold: int) -> DataFrame:
    """block, doc_ids, train (bytes), lens, words (sorted distinct hashes), tokens (numbers of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=BLOCK_BYTES):
                hashes, at = word_hashes(*flat_bytes(part.column("text")))
                lens = np.diff(at) + 1
                tokens = np.insert(hashes, at[1:], END)
                words, numbers = np.unique(tokens, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id")),
                        pa.array([np.asarray(part.column("train")).astype(np.uint8).tobytes()], pa.binary()),
                        pa.array([lens.astype(np.int32).tobytes()], pa.binary()),
                        pa.array([words.tobytes()], pa.binary()),
                        pa.array([numbers.astype(np.int32).tobytes()], pa.binary()),
                        pa.array([len(tokens)]),
                    ],
                    names=["doc_ids", "train", "lens", "words", "tokens", "n"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", (~held_out("doc_id", fold)).alias("train"))
    out = rows.mapInArrow(run, f"doc_ids array<{kind}>, train binary, lens binary, words binary, tokens binary, n long")
    return out.withColumn("block", F.monotonically_increasing_id())


class Block:
    """The arrays of one row of token_blocks."""

    def __init__(self, train: bytes, lens: bytes, words: bytes, tokens: bytes):
        self.lens = np.frombuffer(lens, dtype=np.int32).astype(np.int64)
        self.words = np.frombuffer(words, dtype=np.uint64)
        self.tokens = np.frombuffer(tokens, dtype=np.int32).astype(np.int64)
        self.train = np.repeat(np.frombuffer(train, dtype=np.uint8).astype(bool), self.lens)
        # state before each token: the word before it, or the start of a document
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        first = np.cumsum(self.lens) - self.lens
        self.before[first] = len(self.words)
        self.states = np.append(self.words, START)

    def questions(self, buckets: int, hot: np.ndarray):
        """Distinct states and pairs, each ordered by bucket, with counts in training documents."""
        n = len(self.states)
        code = self.before * n + self.tokens
        pairs, self.pair_of = np.unique(code, return_inverse=True)
        k = np.bincount(self.pair_of[self.train], minlength=len(pairs))
        head, tail = pairs // n, pairs % n
        c = np.bincount(self.tokens[self.train], minlength=n)
        c[-1] = np.bincount(self.before[self.train], minlength=n)[-1]
        home = (mix(self.states) % U64(buckets)).astype(np.int64)
        is_hot = np.isin(self.states, hot)[head]
        at = home[head]
        at[is_hot] = (mix(self.states[head[is_hot]] + mix(self.states[tail[is_hot]])) % U64(buckets)).astype(np.int64)
        state_order, pair_order = np.argsort(home, kind="stable"), np.argsort(at, kind="stable")
        limits = np.arange(buckets + 1)
        return {
            "head": head[pair_order], "tail": tail[pair_order], "k": k[pair_order], "pair_order": pair_order,
            "pair_at": np.searchsorted(at[pair_order], limits), "c": c[state_order], "state_order": state_order,
            "state_at": np.searchsorted(home[state_order], limits),
        }


class Automaton:
    """States 0 .. n - 1 of words and the start, and the root n; arcs by sorted state * n + word."""

    def __init__(self, arcs: np.ndarray, weights: np.ndarray, failure: np.ndarray, root: np.ndarray):
        self.n = len(failure)
        self.arcs, self.weights, self.failure, self.root = arcs, weights, failure, root

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading one word each, and the logarithms of the weights passed."""
        log = np.zeros(len(state))
        open_ = np.flatnonzero(state < self.n)
        key = state[open_] * self.n + word[open_]
        at = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
        has = self.arcs[at] == key if len(self.arcs) else np.zeros(len(key), dtype=bool)
        log[open_[has]] = self.weights[at[has]]
        fell = open_[~has]
        log[fell] = self.failure[state[fell]]  # the failure arc leads to the root
        at_root = np.concatenate((np.flatnonzero(state == self.n), fell))
        log[at_root] += self.root[word[at_root]]
        return word.copy(), log

    def traverse(self, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The logarithm of the weight passed at each token; ``before`` has the state before each."""
        out = np.zeros(len(tokens))
        starts = np.arange(0, len(tokens), SEGMENT)
        first, state = np.flatnonzero(before == self.n - 1), before[starts].copy()
        is_first = np.zeros(len(tokens), dtype=bool)
        is_first[first] = True
        for step in range(min(SEGMENT, len(tokens))):
            if starts[-1] + step >= len(tokens):  # the last segment may be shorter
                starts, state = starts[:-1], state[:-1]
                if not len(starts):
                    break
            at = starts + step
            state[is_first[at]] = self.n - 1  # a new document starts
            state, out[at] = self.read(state, tokens[at])
        return out


def questions(blocks: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """bucket, block and packed arrays: states with counts, pairs as (state, word) with counts."""
    shared = blocks.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["train"], row["lens"], row["words"], row["tokens"])
                q = b.questions(buckets, shared.value)
                out = []
                for i in np.flatnonzero(np.diff(q["state_at"]) + np.diff(q["pair_at"])).tolist():
                    s, p = slice(*q["state_at"][i : i + 2]), slice(*q["pair_at"][i : i + 2])
                    heads, sizes = _runs(q["head"][p])
                    out.append((i, row["block"], b.states[q["state_order"][s]].tobytes(), q["c"][s].astype(np.uint32).tobytes(), b.states[heads].tobytes(), sizes.astype(np.uint32).tobytes(), b.states[q["tail"][p]].tobytes(), q["k"][p].astype(np.uint32).tobytes()))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["bucket", "block", "states", "c", "heads", "sizes", "tails", "k"])

    return blocks.select("block", "train", "lens", "words", "tokens").mapInArrow(run, "bucket long, block long, states binary, c binary, heads binary, sizes binary, tails binary, k binary")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def answers(asked: DataFrame, hot: np.ndarray) -> DataFrame:
    """block, bucket, c and n of its states, k of its pairs; and rows with block -1 with
    sums of the bucket: tokens, words, pairs seen once and twice, and n of hot states."""
    shared = asked.sparkSession.sparkContext.broadcast(hot)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        read = lambda c, t: [np.frombuffer(x, dtype=t) for x in pdf[c]]
        states, c = read("states", np.uint64), read("c", np.uint32)
        heads, sizes, tails, k = read("heads", np.uint64), read("sizes", np.uint32), read("tails", np.uint64), read("k", np.uint32)
        head = np.concatenate([np.repeat(h, s) for h, s in zip(heads, sizes)])
        _, first, pair_of = np.unique(mix(head + mix(np.concatenate(tails) + U64(1))), return_index=True, return_inverse=True)
        sums = np.bincount(pair_of, np.concatenate(k), minlength=len(first)).astype(np.int64)
        of_head, after = np.unique(head[first][sums > 0], return_counts=True)
        names, state_of = np.unique(np.concatenate(states), return_inverse=True)
        count = np.bincount(state_of, np.concatenate(c), minlength=len(names)).astype(np.int64)
        n = np.zeros(len(names), dtype=np.int64)
        if len(names) and len(of_head):
            at = np.minimum(np.searchsorted(of_head, names), len(of_head) - 1)
            n = np.where(of_head[at] == names, after[at], 0)
        rows, i, j = [], 0, 0
        for block, s, t in zip(pdf["block"], states, tails):
            rows.append((block, count[state_of[i : i + len(s)]].tobytes(), n[state_of[i : i + len(s)]].tobytes(), sums[pair_of[j : j + len(t)]].astype(np.uint32).tobytes()))
            i, j = i + len(s), j + len(t)
        word = names != START
        own = np.isin(of_head, shared.value)
        stats = np.array([count[word].sum(), (count[word] > 0).sum(), (sums == 1).sum(), (sums == 2).sum()], dtype=np.int64)
        rows.append((-1, stats.tobytes(), of_head[own].tobytes(), after[own].astype(np.int64).tobytes()))
        out = pd.DataFrame(rows, columns=["block", "c", "n", "k"])
        out.insert(1, "bucket", int(pdf["bucket"].iloc[0]))
        return out

    return asked.groupBy("bucket").applyInPandas(run, "block long, bucket long, c binary, n binary, k binary")


def hot_words(blocks: DataFrame, total: int) -> np.ndarray:
    """Words with a share of at least HOT_SHARE of all tokens: 1 / HOT_SHARE at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, t in zip(batch.column("words"), batch.column("tokens")):
                n = np.bincount(np.frombuffer(t.as_buffer(), dtype=np.int32))
                at = np.flatnonzero(n >= HOT_SHARE / 4 * n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w.as_buffer(), dtype=np.int64)[at]), pa.array(n[at])], names=["word", "n"])

    found = blocks.select("words", "tokens").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_SHARE * total)
    return np.array([r["word"] for r in found.collect()] + [int(START.astype(np.int64))], dtype=np.int64).astype(np.uint64)


def lm_scores(docs: DataFrame, fold: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and
    gain, what score has over base_score for each token."""
    spark = docs.sparkSession
    blocks = materialize(token_blocks(docs, fold), "tokens")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    hot = hot_words(blocks, total)
    buckets = max(partitions_of(spark), int(total // BUCKET_PAIRS))
    replies = materialize(answers(questions(blocks, buckets, hot), hot), "counts")
    sums, hot_n = np.zeros(4, dtype=np.int64), {}
    for r in replies.where("block = -1").select("c", "n", "k").toLocalIterator():  # a small row for each bucket
        sums += np.frombuffer(r["c"], dtype=np.int64)
        for h, n in zip(np.frombuffer(r["n"], dtype=np.uint64).tolist(), np.frombuffer(r["k"], dtype=np.int64).tolist()):
            hot_n[h] = hot_n.get(h, 0) + n
    tokens, words, once, twice = (int(x) for x in sums)
    discount = once / (once + 2 * twice) if once and twice else 0.75
    known = spark.sparkContext.broadcast((hot, hot_n))
    base = tokens + 0.5 * (words + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_states, n_of = known.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("train", "lens", "words", "tokens", "replies")}
                b = Block(row["train"], row["lens"], row["words"], row["tokens"])
                q = b.questions(buckets, hot_states)
                got = sorted(row["replies"], key=lambda r: r["bucket"])
                c, n = np.zeros((2, len(b.states)), dtype=np.int64)
                c[q["state_order"]] = np.concatenate([np.frombuffer(r["c"], dtype=np.int64) for r in got])
                n[q["state_order"]] = np.concatenate([np.frombuffer(r["n"], dtype=np.int64) for r in got])
                k = np.zeros(len(q["pair_order"]), dtype=np.int64)
                k[q["pair_order"]] = np.concatenate([np.frombuffer(r["k"], dtype=np.uint32) for r in got])
                for s in np.flatnonzero(np.isin(b.states, hot_states)).tolist():
                    n[s] = n_of.get(int(b.states[s]), 0)
                p = np.log10((c + 0.5) / base)
                fail = np.where(c > 0, discount * n / np.maximum(c, 1), 1.0)
                seen = np.flatnonzero(k)
                pairs = np.sort(q["head"] * len(b.states) + q["tail"])[seen] if len(seen) else np.zeros(0, np.int64)
                head, tail = pairs // len(b.states), pairs % len(b.states)
                arcs = np.log10(np.maximum(k[seen] - discount, 0) / np.maximum(c[head], 1) + fail[head] * 10 ** p[tail])
                with np.errstate(divide="ignore"):
                    automaton = Automaton(pairs, arcs, np.log10(fail), p)
                log = automaton.traverse(b.tokens, b.before)
                first = np.cumsum(b.lens) - b.lens
                add = lambda x: np.add.reduceat(x, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(b.lens), pa.array(add((c[b.tokens] > 0).astype(np.int64))), pa.array(add(p[b.tokens])), pa.array(add(log))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = replies.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "c", "n", "k")).alias("replies"))
    joined = blocks.join(told, "block").select("doc_ids", "train", "lens", "words", "tokens", "replies")
    out = joined.mapInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out("doc_id", fold).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", ((F.col("score") - F.col("base_score")) / F.col("n_tokens")).alias("gain"))
