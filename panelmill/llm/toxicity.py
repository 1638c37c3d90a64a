"""Toxicity by a support vector machine on a subsequence string kernel with Nystrom landmarks.

The kernel of two words sums over all subsequences of ``ORDER`` characters that both have,
each weighted by DECAY to the length it spans in either word, and is normalised by the
words' own kernels, so a word with gaps or inserted characters stays close to the word it
hides.  Landmarks are the words, and beginnings of words, of labelled training texts that go
most with label 1, and common words.  A word is close to a landmark if their kernel is at least CLOSE; a text is
described by its closest word to each landmark and by the sum of the closeness of all its
words.  Both are mapped by the inverse root of the landmarks' kernel matrix (Nystrom), and a
linear machine with squared hinge loss is trained on them; a logistic curve turns margins
into scores.

Kernels below CLOSE are not computed where a bound shows them: with R the letters that the
word and the landmark share, the kernel is at most the root of the share of the landmark's own
kernel that lies on subsequences of R (Cauchy-Schwarz over the subsequences both can have).

Words are lower-cased and bared of signs; digits and signs that stand for letters are read
as such; letters that stand alone in a row are joined.  The parts between a word's signs are
words too, and so is a word without its stretches of one letter.  Words longer than WINDOW
characters are taken in overlapping windows.  A word of more than LONGER times a landmark's
length, of which the landmark can be a part only, is as close as its closest window, of the
landmark's length or of LONGER times it.  A word of one letter has no subsequence.

The machine is fitted on at most ``sample`` labelled rows (a parameter); everything else
covers all texts.  Null and empty texts get the score of a text without words.  Labels count
once per row of ``labels``, null ones not at all.  With a class missing, every score is 0.5
below or above by that class.  Repeated rows give repeated results; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, slices
from .quality import scored
from .textblocks import flat_bytes, word_bounds, word_hashes

ORDER, DECAY, WINDOW = 3, 0.6, 24
#: The kernel from which a word counts as close to a landmark.
CLOSE = 0.55
TOXIC_LANDMARKS, COMMON_LANDMARKS = 40, 4
#: A word more than this many times as long as a landmark is compared with it by windows.
LONGER = 2.5
#: Words ranked for landmarks, and the kernel from which a word is too close to a landmark to be another.
RANKED, TOO_CLOSE = 400, 0.8
#: Letters of the beginnings of words that may be landmarks, and the least letters of a common one.
HEADS, COMMON_LETTERS = (5, 6, 7, 8), 5
#: Stands before each word, so that subsequences know its start.
BEGIN = "^"
SAMPLE = 30_000
THRESHOLD = 0.5
SLICE_BYTES = 4 << 20
#: Tokens without a close landmark that a task remembers.
KEPT_TOKENS = 300_000
#: Letters of a landmark that the bound tells apart; others count as shared, which keeps it a bound.
BOUND_LETTERS = 10
#: Signs and digits that stand for letters.
STANDS_FOR = str.maketrans("013457@$", "oieastas")
_MARK = re.compile(r"[\W_]+")
_STRETCH = re.compile(r"(\w)\1{2,}")


def spellings(token: str) -> list[str]:
    """The words that a token may stand for; the first is the token without its signs."""
    low = token.lower()
    if low.isalpha() and ORDER - 1 <= len(low) < WINDOW and not _STRETCH.search(low):
        return [BEGIN + low]
    found = [low]
    if not low.isalpha():
        found = [_MARK.sub("", low)]
        read = [low]
        if any(c in "013457@$" for c in low) and any(c.isalpha() for c in low):
            read.append(low.translate(STANDS_FOR))
            found.append(_MARK.sub("", read[1]))
        for r in read:
            found += _MARK.split(r)
    for w in list(found):
        if _STRETCH.search(w):
            found += [_STRETCH.sub(r"\1", w), _STRETCH.sub(r"\1\1", w)]
    return [BEGIN + w for x in dict.fromkeys(found) for w in windows(x)]


def windows(word: str) -> list[str]:
    size = WINDOW - 1
    if len(word) <= size:
        return [word] if len(word) >= ORDER - 1 else []
    return [word[i : i + size] for i in range(0, len(word) - size // 2, size // 2)]


def _codes(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each word as numbers, padded with 0, and the lengths."""
    flat = np.array(words, dtype=f"<U{width}") if words else np.zeros(0, f"<U{width}")
    return flat.view(np.uint32).reshape(len(words), width).astype(np.int32), np.char.str_len(flat)


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of paired rows of s and t (padded with 0).

    ``open_[i, j]`` holds the weighted common subsequences of one order less within the first
    i and j characters, with the decay up to there; what lies behind a word's end is never
    matched and so never read."""
    n, m = s.shape[1], t.shape[1]
    match = np.empty((n, m, len(s)), dtype=np.float32)
    for i in range(n):
        for j in range(m):
            np.multiply((s[:, i] == t[:, j]) & (s[:, i] != 0), DECAY**2, out=match[i, j], casting="unsafe")
    decay = np.float32(DECAY)
    open_ = None
    for _ in range(1, ORDER):
        grown = np.zeros((n + 1, m + 1, len(s)), dtype=np.float32)
        for i in range(1, n):
            row = np.zeros(len(s), dtype=np.float32)
            for j in range(1, m):
                row *= decay
                row += match[i - 1, j - 1] if open_ is None else match[i - 1, j - 1] * open_[i - 1, j - 1]
                np.multiply(grown[i - 1, j], decay, out=grown[i, j])
                grown[i, j] += row
        open_ = grown
    return np.einsum("ijk,ijk->k", match, open_[:n, :m]) if open_ is not None else match.sum(axis=(0, 1))


def own_kernel(s: np.ndarray) -> np.ndarray:
    return kernel(s, s)


@dataclass
class Landmarks:
    """Landmark words, their codes and kernels, and the bounds of kernels by shared letters."""

    words: list[str]
    codes: np.ndarray = field(init=False)
    norms: np.ndarray = field(init=False)

    def __post_init__(self):
        self.width = max([ORDER, *map(len, self.words)])
        self.codes, self.lens = _codes(self.words, self.width)
        self.norms = np.sqrt(own_kernel(self.codes))
        tally = Counter(ord(c) for w in self.words for c in set(w) if c != BEGIN)
        self.letters = sorted(sorted(tally, key=lambda c: (-tally[c], c))[:62])  # bits of a word; others count as shared
        self.tables: list = []

    def with_bounds(self) -> Landmarks:
        """These landmarks, able to rule words out by their letters."""
        self.tables = [self._bounds(row, norm) for row, norm in zip(self.codes, self.norms)]
        return self

    def _bounds(self, row: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """Columns of a landmark's letters, and by the bits of those shared the largest kernel."""
        own = [c for c in dict.fromkeys(row[row > 0].tolist()) if c in self.letters]
        lost = own_kernel(np.array([np.where(row == c, 0, row) for c in own], dtype=np.int32).reshape(len(own), len(row)))
        use = [own[k] for k in np.argsort(lost, kind="stable")[:BOUND_LETTERS]]
        shared = np.arange(1 << len(use))
        masked = np.tile(row, (len(shared), 1))
        for k, c in enumerate(use):
            masked[np.ix_(shared >> k & 1 == 0, row == c)] = 0
        most = np.sqrt(own_kernel(masked)) / max(float(norm), 1e-9)
        return np.array([self.letters.index(c) for c in use], dtype=np.int64), most

    def able(self, has: np.ndarray, j: int) -> np.ndarray:
        """Whether words with these letters (a bit each) can be close to landmark j."""
        columns, most = self.tables[j]
        key = np.zeros(has.shape, dtype=np.int64)
        for k, c in enumerate(columns.tolist()):
            key |= (has >> c & 1) << k
        return most[key] >= CLOSE

    def similarities(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised kernels of at least CLOSE as (word, landmark, value)."""
        codes, lens = _codes(words, WINDOW)
        if not len(codes) or not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        has = np.zeros(len(codes), dtype=np.int64)
        for k, c in enumerate(self.letters):
            has |= (codes == c).any(axis=1).astype(np.int64) << k
        kinds, kind = np.unique(has, return_inverse=True)
        part_codes, part_lens, part_of, part_to = self.parts(codes, lens)
        at, to = [], []
        for j in range(len(self.words)):
            i = np.flatnonzero((lens <= LONGER * self.lens[j]) & self.able(kinds, j)[kind])
            at.append(i)
            to.append(np.full(len(i), j))
        words_of = np.concatenate((np.arange(len(codes)), part_of))
        at.append(len(codes) + np.arange(len(part_of)))
        to.append(part_to)
        codes, lens = np.concatenate((codes, part_codes)), np.concatenate((lens, part_lens))
        i, j = np.concatenate(at), np.concatenate(to)
        value = self.kernels(codes, lens, i, j)
        pairs, back = np.unique(words_of[i] * len(self.words) + j, return_inverse=True)
        best = np.zeros(len(pairs), dtype=np.float32)
        np.maximum.at(best, back, value)
        near = best >= CLOSE
        return pairs[near] // len(self.words), pairs[near] % len(self.words), best[near]

    def kernels(self, codes: np.ndarray, lens: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Normalised kernels of the words i and the landmarks j, a bounded number at a time."""
        value = np.zeros(len(i), dtype=np.float32)
        some, back = np.unique(i, return_inverse=True)
        norm = np.zeros(len(some), dtype=np.float32)
        order = np.argsort(lens[some], kind="stable")
        for k in range(0, len(some), 4096):
            p = order[k : k + 4096]
            norm[p] = np.sqrt(own_kernel(codes[some[p], : lens[some[p]].max()]))
        by = np.argsort(lens[i], kind="stable")
        for k in range(0, len(by), 4096):
            p = by[k : k + 4096]
            value[p] = kernel(codes[i[p], : lens[i[p]].max()], self.codes[j[p], : self.lens[j[p]].max()])
        return value / np.maximum(norm[back] * self.norms[j], 1e-9)

    def gram(self) -> np.ndarray:
        """Kernels of all pairs of landmarks."""
        n = len(self.words)
        i, j = (g.ravel() for g in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
        return self.kernels(self.codes, self.lens, i, j).astype(float).reshape(n, n)

    def parts(self, codes: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of words that are long for a landmark, with their lengths, words and landmarks.

        Those of the landmark's own length start at each letter, those of LONGER times it at
        every half of their length and at the end; all get the sign of a start."""
        out, sizes, of, to = [np.zeros((0, WINDOW), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        every = np.flatnonzero(lens > LONGER * self.lens.min())
        for at in range(0, len(every), 8192):
            long = every[at : at + 8192]
            body, letters = codes[long, 1:], lens[long] - 1
            counts = np.stack([np.concatenate((np.zeros((len(long), 1), np.int8), np.cumsum(body == c, axis=1, dtype=np.int8)), axis=1) for c in self.letters], axis=2)
            for size in sorted({s for n in self.lens.tolist() for s in (n - 1, int(LONGER * n) - 1) if s <= body.shape[1]}):
                start = np.arange(body.shape[1] - size + 1)
                has = ((counts[:, size:] > counts[:, : len(start)]).astype(np.int64) << np.arange(len(self.letters))).sum(axis=2)
                last = letters - size
                for j, length in enumerate(self.lens.tolist()):
                    if size not in (length - 1, int(LONGER * length) - 1):
                        continue
                    use = self.able(has, j) & (start <= last[:, None]) & (lens[long] > LONGER * length)[:, None]
                    if size >= length:
                        use &= (start % (size // 2) == 0) | (start == last[:, None])
                    row, first = np.nonzero(use)
                    piece = np.zeros((len(row), WINDOW), np.int32)
                    piece[:, 0] = ord(BEGIN)
                    piece[:, 1 : size + 1] = body[row[:, None], first[:, None] + np.arange(size)]
                    out.append(piece)
                    sizes.append(np.full(len(row), size + 1))
                    of.append(long[row])
                    to.append(np.full(len(row), j))
        return np.concatenate(out), np.concatenate(sizes), np.concatenate(of), np.concatenate(to)


def tokens_of(col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens of a batch of texts, and for every occurrence its text and token.

    Runs of three and more tokens of one letter each are further tokens, joined."""
    raw, off = flat_bytes(col)
    starts, ends = word_bounds(raw, off)
    hashes, at = word_hashes(raw, off)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    body = raw.tobytes()
    tokens = [body[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    letter = np.fromiter((len(_MARK.sub("", t)) == 1 for t in tokens), dtype=bool, count=len(tokens))[number] if len(tokens) else np.zeros(0, bool)
    more_owner, more_token = [], []
    if letter.any():
        edge = np.flatnonzero(np.concatenate(([True], (letter[1:] != letter[:-1]) | (owner[1:] != owner[:-1]), [True])))
        for a, b in zip(edge.tolist(), edge[1:].tolist()):
            if letter[a] and b - a >= ORDER:
                more_owner.append(int(owner[a]))
                more_token.append(len(tokens))
                tokens.append("".join(_MARK.sub("", tokens[n]) for n in number[a:b].tolist()))
    return tokens, np.concatenate((owner, np.array(more_owner, dtype=np.int64))), np.concatenate((number, np.array(more_token, dtype=np.int64)))


def described(col: pa.Array, marks: Landmarks, known: set[str]) -> np.ndarray:
    """For each text and landmark the closest word, then the damped sum of the closeness of all words.

    ``known`` remembers tokens that are close to no landmark."""
    tokens, owner, number = tokens_of(col)
    n = len(marks.words)
    out = np.zeros((len(col), 2 * n), dtype=np.float32)
    if len(known) > KEPT_TOKENS:
        known.clear()
    fresh = [i for i, t in enumerate(tokens) if t not in known]
    words, of = [], []
    for i in fresh:
        for w in spellings(tokens[i]):
            words.append(w)
            of.append(i)
    w, j, value = marks.similarities(words)
    token = np.array(of, dtype=np.int64)[w] if len(w) else w
    near = np.zeros(len(tokens), dtype=bool)
    near[token] = True
    known.update(tokens[i] for i in fresh if not near[i] and len(tokens[i]) <= WINDOW)
    if len(w):
        rows, back = np.unique(token, return_inverse=True)
        dense = np.zeros((len(rows), n), dtype=np.float32)
        np.maximum.at(dense, (back, j), value)
        pick = near[number]
        pairs, times = np.unique(owner[pick] * len(tokens) + number[pick], return_counts=True)
        close = dense[np.searchsorted(rows, pairs % len(tokens))]
        np.maximum.at(out[:, :n], pairs // len(tokens), close)
        np.add.at(out[:, n:], pairs // len(tokens), close * times[:, None].astype(np.float32))
        out[:, n:] = np.log1p(out[:, n:])
    return out


@dataclass
class Machine:
    """Landmarks, and the linear weights with the Nystrom map folded in."""

    marks: Landmarks
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, z: np.ndarray) -> np.ndarray:
        return z @ self.weights + self.bias

    def scores(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(z) + self.shift, -500, 500)))

    @staticmethod
    def fit(marks: Landmarks, z: np.ndarray, y: np.ndarray, cost: float = 5.0) -> Machine | float:
        if not len(y) or y.min() == y.max():
            return 0.5 if not len(y) else 0.499 if y[0] == 0 else 0.501
        vals, vecs = np.linalg.eigh(marks.gram())
        root = vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 1e-2))) @ vecs.T
        n = len(marks.words)
        x = np.column_stack((z[:, :n].astype(float) @ root, z[:, n:].astype(float) @ root, np.ones(len(z))))
        side = np.where(y == 1, 1.0, -1.0)
        weight = np.full(len(y), cost)
        w = np.zeros(x.shape[1])
        ridge = np.full(len(w), 1.0)
        ridge[-1] = 1e-6
        for _ in range(50):  # Newton steps of the squared hinge loss
            slack = 1 - side * (x @ w)
            on = slack > 0
            grad = ridge * w - 2 * ((weight * side * slack)[on] @ x[on])
            step = np.linalg.solve(np.diag(ridge) + 2 * (x[on] * weight[on, None]).T @ x[on], grad)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        slope, shift = _logistic(x @ w, y)
        return Machine(marks, np.concatenate((root @ w[:n], root @ w[n : 2 * n])), float(w[-1]), slope, shift)


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the scores' curve, by Newton steps with smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.array([1.0, 0.0])
    x = np.column_stack((margin, np.ones(len(margin))))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        a -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def training_texts(docs: DataFrame, labels: DataFrame, label: str, fold: int, sample: int) -> DataFrame:
    """text, label of at most about ``sample`` labelled rows, chosen by a hash of doc_id.

    The chosen labels are bounded by the parameter and so are broadcast."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", fold))
    n = known.count()
    if n > sample:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label")


def landmarks(texts: DataFrame) -> Landmarks:
    """The words that go most with label 1, and the most common ones, by texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                tokens, owner, number = tokens_of(part.column("text"))
                forms = [{*(spelt := spellings(t)), *(w[: n + 1] for w in spelt for n in HEADS if len(w) > n + 1)} for t in tokens]
                by = np.argsort(owner, kind="stable")
                number, at = number[by], np.searchsorted(owner[by], np.arange(part.num_rows + 1))
                n1: Counter = Counter()
                n: Counter = Counter()
                for k, y in enumerate(part.column("label").to_pylist()):
                    own = set().union(*(forms[i] for i in set(number[at[k] : at[k + 1]].tolist())))
                    n.update(own)
                    if y == 1:
                        n1.update(own)
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([n1[w] for w in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["word", "n1", "n"])

    share = texts.agg(F.avg("label")).first()[0] or 0.0
    words = texts.mapInArrow(run, "word string, n1 long, n long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    words = materialize(words.where("n >= 3"), "words").withColumn("z", (F.col("n1") - share * F.col("n")) / F.sqrt(F.col("n")))
    toxic = words.where("n1 >= 3").orderBy(F.desc("z"), "word").limit(RANKED).collect()
    common = words.where((F.col("n1") <= 1.5 * share * F.col("n")) & (F.length("word") > COMMON_LETTERS)).orderBy(F.desc("n"), "word").limit(COMMON_LANDMARKS).collect()
    return Landmarks(list(dict.fromkeys([*apart([r["word"] for r in toxic], TOXIC_LANDMARKS), *(r["word"] for r in common)]))).with_bounds()


def apart(ranked: list[str], most: int) -> list[str]:
    """The first words of a ranking that are not too close to one before."""
    if not ranked:
        return []
    close = Landmarks(ranked).gram() >= TOO_CLOSE
    chosen: list[int] = []
    for k in range(len(ranked)):
        if len(chosen) < most and not (close[k, chosen].any() or close[chosen, k].any()):
            chosen.append(k)
    return [ranked[k] for k in chosen]


def descriptions(docs: DataFrame, marks: Landmarks, keep: str) -> DataFrame:
    """keep and x array<double>: the closeness of each text to each landmark."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    n = 2 * len(marks.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                z = described(part.column("text"), shared.value, known)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * n), pa.array(z.ravel().astype(np.float64)))
                yield pa.RecordBatch.from_arrays([part.column(keep), rows], names=[keep, "x"])

    kind = docs.schema[keep].dataType.simpleString()
    return docs.select(keep, "text").mapInArrow(run, f"{keep} {kind}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, fold: int = 0, sample: int = SAMPLE) -> Machine | float:
    texts = materialize(training_texts(docs, labels, "toxic", fold, sample), "texts")
    marks = landmarks(texts)
    rows = descriptions(texts, marks, "label").toPandas()  # at most ``sample`` rows
    if not len(rows) or not marks.words:
        return Machine.fit(marks, np.zeros((len(rows), 0)), rows["label"].to_numpy()) if len(set(rows["label"])) < 2 else 0.499
    return Machine.fit(marks, np.vstack(rows["x"]), rows["label"].to_numpy())


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, fold, sample)
    marks = model.marks if isinstance(model, Machine) else Landmarks([])
    return scored(descriptions(docs, marks, "doc_id"), model, threshold, fold)
