"""BPE encoding and decoding by speculation and verification.

Each distinct word is first cut greedily into the longest vocabulary tokens.  A cut is
the true BPE result exactly when every two neighbouring tokens are compatible, that is,
when merging their joint characters gives back the two tokens; this is tested for all
neighbours of all new words at once by undoing merges from the latest to the earliest
(``compatible``).  Only words with an incompatible pair are merged step by step.

A vocabulary file of the ``tokenizers`` library with an end-of-word suffix is read; its
normaliser (NFC, white space, lower case; for texts with marks or characters that tables
of Unicode may place otherwise, the library's own normaliser and word pattern), word pattern, byte alphabet and special
tokens are followed.  Its decoding, without a decoder, joins tokens by a blank.

Null texts count as empty, and an empty text has no ids and decodes to the empty text.
Texts of any length are encoded whole.  An empty table gives an empty result; columns
besides doc_id and text are ignored, repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from .common import slices

#: The word pattern of the vocabulary file, and the same for texts without odd characters.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
EXACT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
PLAIN = re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\w\s]|_)+")
ODD = re.compile("[^\x00-\x1b\x20-\x7f\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-˿]")


def unsettled() -> re.Pattern:
    """Characters that tables of Unicode may place otherwise: marks, code points without a character yet, and all beyond U+FFFF."""
    ranges, first = [], None
    for c in range(0x300, 0x10001):
        on = c < 0x10000 and unicodedata.category(chr(c)) in ("Cn", "Mn", "Mc", "Me")
        if on and first is None:
            first = c
        elif not on and first is not None:
            ranges.append(f"{chr(first)}-{chr(c - 1)}")
            first = None
    return re.compile("[" + "".join(ranges) + "\U00010000-\U0010ffff]")


UNSETTLED = unsettled()
#: Words of a worker's cache; a full cache is emptied but for the words at hand, which changes no result.
CACHE_WORDS = 400_000
#: Stands for the end of a word in the matcher; no token has it.
LAST = "\x01"
#: Cells of the matrix in which words are merged together.
MERGE_CELLS = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


#: Classes of the characters that texts without odd characters have, by PLAIN.
SPACE, LETTER, DIGIT, OTHER = range(4)
CLASSES = np.array([SPACE if c.isspace() else DIGIT if re.match(r"\d", c) else LETTER if re.match(r"[^\W_]", c) else OTHER for c in map(chr, range(0x300))], dtype=np.uint8)


def plain_words(texts: list[str]) -> tuple[list[str], pa.Array, np.ndarray]:
    """The words that PLAIN finds in lower-case texts without odd characters: the distinct ones,
    which of them each word is, and how many words there are up to the end of each text.

    A word ends where the class of characters changes; a digit stands alone, and an apostrophe that
    begins a word takes the ending after it."""
    codes = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-16-le"), dtype="<u2")
    if not len(codes):
        return [], pa.array([], pa.int32()), np.zeros(0, np.int64)
    kind = CLASSES[codes]
    begins = np.empty(len(kind), dtype=bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    # an apostrophe that begins a word; the line feed after each text leaves a place behind any ending
    quote = np.flatnonzero(codes == ord("'"))
    quote = quote[begins[quote]]
    for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
        here = quote[np.all([codes[np.minimum(quote + 1 + k, len(codes) - 1)] == ord(c) for k, c in enumerate(ending)], axis=0)]
        begins[here + 1] = False
        begins[here + 1 + len(ending)] = True
    begins |= kind == DIGIT
    filled = kind != SPACE
    begins &= filled
    spans = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    upto = np.searchsorted(np.flatnonzero(begins), spans)
    # without the white space, each word ends where the next one begins
    kept = codes[filled]
    starts = np.append(np.flatnonzero(begins[filled]), len(kept)) * 2
    each = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(kept)]).dictionary_encode()
    _, ends, known = each.dictionary.buffers()
    ends, known = (np.frombuffer(ends, dtype=np.int64)[: len(each.dictionary) + 1] // 2).tolist(), str(known, "utf-16-le")
    return [known[a:b] for a, b in zip(ends, ends[1:])], each.indices, upto


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        alphabet = byte_alphabet()
        # no word has a line feed, so it stands for the end of a word
        self.alphabet = np.array([ord(LAST) if b == 10 else ord(c) for b, c in enumerate(alphabet)], dtype="<u2")
        n = max(self.tokens) + 1
        self.n = n
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank = np.full(n, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[i, j] = (r, k)
            self.left[k], self.right[k], self.rank[k] = i, j, r
            keys.append(i * n + j)
            ranks.append(r)
        self.never = len(ranks)
        self.made = np.array([self.merges[divmod(k, n)][1] for k in keys])
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys)[order], np.array(ranks)[order]
        # leftmost-longest matcher of all tokens, with one character for the end of a word
        self.matcher = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            self.matcher.add_word(t[: -len(self.suffix)] + LAST if self.suffix and t.endswith(self.suffix) else t, i)
        self.matcher.make_automaton()
        self.is_last = np.zeros(n, dtype=bool)
        self.is_last[[i for t, i in self.vocab.items() if self.suffix and t.endswith(self.suffix)]] = True
        # characters that a token takes of a word and its end, and the tokens of single characters
        self.span = np.zeros(n, dtype=np.int64)
        for t, i in self.vocab.items():
            self.span[i] = len(t) - len(self.suffix) + 1 if self.is_last[i] else len(t)
        self.letter, self.ending = np.full(512, -1, np.int64), np.full(512, -1, np.int64)
        for c in alphabet:
            self.letter[ord(c)], self.ending[ord(c)] = self.vocab[c], self.vocab[c + self.suffix]
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = Split(Regex(WORDS), behavior="removed", invert=True)
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, bytes] = {}

    # words of a text

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if self.split_special is not None and any(t in text for t in self.special):
            out: list[str] = []
            for part in self.split_special.split(text):
                out += [part] if part in self.special else self._words(part)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        low = self.lowered(text)
        if low is None:  # classes and orders of the library's own tables
            return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return (EXACT if ODD.search(low) else PLAIN).findall(low)

    def lowered(self, text: str) -> str | None:
        """The text in NFC and lower case; None if it has unsettled characters."""
        if text.isascii():
            return text.lower()
        if UNSETTLED.search(text):
            return None
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    # encoding of words

    def spelled(self, words: list[str]) -> tuple[str, np.ndarray]:
        """The words in the byte alphabet, each with its end behind it, and where each ends."""
        codes = self.alphabet[np.frombuffer("".join([w + "\n" for w in words]).encode("utf-8"), dtype=np.uint8)]
        return str(codes.tobytes(), "utf-16-le"), np.flatnonzero(codes == ord(LAST)) + 1

    def greedy(self, letters: str, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest tokens from the left of all words, and the word of each; right only if they cover the word and its end."""
        found = np.fromiter(chain.from_iterable(self.matcher.iter_long(letters)), dtype=np.int64).reshape(-1, 2)
        return found[:, 1], np.searchsorted(behind, found[:, 0], side="right")

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair (a, b) of tokens as it is.

        Undo the later of the merges inside a and b that touch their border; before that
        merge, a merge across the border would have had to be of lower rank to be taken.
        """
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            keys = x * self.n + y
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            across = (self.pair_keys[at] == keys) & (self.pair_ranks[at] < limit)
            ok[live[across]] = False
            undo_left = self.rank[x] > self.rank[y]
            done = (self.rank[x] < 0) & (self.rank[y] < 0)
            limit = np.where(undo_left, self.rank[x], self.rank[y] + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
            go = ~across & ~done
            live, x, y, limit = live[go], x[go], y[go], limit[go]
        return ok

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Place of the pairs among the sorted pairs that merge, or a number beyond all."""
        keys = x * self.n + y
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (x >= 0) & (y >= 0), self.pair_ranks[at], self.never)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each the lowest rank first, the leftmost of equals.

        Gives the ids of all words in their order, and the word of each."""
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lens, kind="stable")
        ids, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(order):  # words of like length together, of a bounded number of characters
            widest = int(lens[order[at]]) + 8
            part = order[at : at + max(1, MERGE_CELLS // widest)]
            part = part[lens[part] <= widest]
            at += len(part)
            for got, owner in self._merge([words[i] for i in part.tolist()]):
                ids.append(got)
                owners.append(part[owner])
        flat, owner = np.concatenate(ids), np.concatenate(owners)
        by = np.argsort(owner, kind="stable")
        return flat[by], owner[by]

    def _merge(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = int(lens.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        letters, last = self.letter[codes], np.cumsum(lens) - 1
        letters[last] = self.ending[codes[last]]
        columns = np.arange(width)
        ids = np.full((len(words), width + 1), -1, dtype=np.int64)
        ids[:, :-1][columns[None, :] < lens[:, None]] = letters
        ranks = self.pair_rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(words))
        while len(live):
            best = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(live)), best]
            done = lowest == self.never
            if done.any():
                ended = ids[done]
                has = ended >= 0
                yield ended[has], np.repeat(live[done], has.sum(axis=1))
                go = ~done
                live, ids, ranks, best, lowest = live[go], ids[go], ranks[go], best[go], lowest[go]
                if not len(live):
                    break
            row = np.arange(len(live))
            # close the gap that each merge leaves, then look up the two pairs around it
            source = columns[None, :] + (columns[None, :] > best[:, None])
            ids[:, :-1] = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            ids[row, best] = self.made[lowest]
            ranks = np.take_along_axis(np.column_stack((ranks, np.full(len(live), self.never))), source, axis=1)
            ranks[row, best] = self.pair_rank(ids[row, best], ids[row, best + 1])
            before = best > 0
            r, b = row[before], best[before]
            ranks[r, b - 1] = self.pair_rank(ids[r, b - 1], ids[r, b])

    def learn(self, words: set[str]) -> None:
        """Put the encodings of new words into the cache."""
        plain = [w for w in words if w not in self.special]
        if plain:
            letters, behind = self.spelled(plain)
            flat, owner = self.greedy(letters, behind)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, back = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
            good = self.compatible(pairs // self.n, pairs % self.n)[back]
            wrong = np.bincount(owner, weights=self.span[flat], minlength=len(plain)) != np.diff(behind, prepend=0)
            wrong[owner[inner[~good]]] = True
            again = np.flatnonzero(wrong)
            right = ~wrong[owner]
            merged, of = self.merge([letters[a : b - 1] for a, b in zip(np.concatenate(([0], behind))[again].tolist(), behind[again].tolist())])
            flat, owner = np.concatenate((flat[right], merged)), np.concatenate((owner[right], again[of]))
            by = np.argsort(owner, kind="stable")
            body = flat[by].astype("<u4").tobytes()
            end = (4 * np.cumsum(np.bincount(owner, minlength=len(plain)))).tolist()
            self.ids_of.update(zip(plain, [body[a:b] for a, b in zip([0, *end], end)]))
        for w in words:
            if w in self.special:
                self.ids_of[w] = np.array([self.special[w]], dtype="<u4").tobytes()

    def word_text(self, word: str) -> bytes:
        """The decoded tokens of a word of the cache."""
        found = self.text_of.get(word)
        if found is None:
            tokens = self.tokens
            found = " ".join([tokens[t] for t in np.frombuffer(self.ids_of[word], dtype="<u4").tolist()]).encode("utf-8")
            self.text_of[word] = found
        return found

    def encode_words(self, docs: list[list[str]], known: Iterable[str] = ()) -> None:
        """Make sure that the cache has all words of these documents; of known words it keeps those that it has."""
        distinct: set[str] = set()
        for words in docs:
            distinct.update(words)
        new = distinct.difference(self.ids_of)
        if new and len(self.ids_of) > CACHE_WORDS:
            self.ids_of = {w: self.ids_of[w] for w in distinct.union(known) if w in self.ids_of}
            self.text_of.clear()
        if new:
            self.learn(new)

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers.

        Plain texts are cut into words together (``plain_words``), and each distinct word is looked up
        once; texts with odd characters or special tokens are cut one by one."""
        out, by_word, at, plain = [b""] * len(texts), [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            low = None if any(t in text for t in self.special) else self.lowered(text)
            if low is None or ODD.search(low):
                by_word.append((i, self.words(text)))
            else:
                at.append(i)
                plain.append(low)
        distinct, nth, upto = plain_words(plain)
        found = list(map(self.ids_of.get, distinct))
        new = [w for w, x in zip(distinct, found) if x is None]
        self.encode_words([new, *(words for _, words in by_word)], distinct)
        ids_of = self.ids_of.__getitem__
        if new:
            found = [ids_of(w) if x is None else x for w, x in zip(distinct, found)]
        _, ends, ids = pa.array(found, pa.large_binary()).take(nth).buffers()
        ends, ids = np.frombuffer(ends, dtype=np.int64)[upto].tolist(), memoryview(ids or b"")
        for i, a, b in zip(at, [0, *ends], ends):
            out[i] = bytes(ids[a:b])
        for i, words in by_word:
            out[i] = b"".join(map(ids_of, words))
        return out

    def encode(self, text: str | None) -> np.ndarray:
        words = self.words(text or "")
        self.encode_words([words])
        return np.frombuffer(b"".join([self.ids_of[w] for w in words]), dtype="<u4")

    def decode(self, ids) -> str:
        return " ".join(self.tokens[int(i)] for i in ids)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, one for each Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def forget(path: str) -> None:
    """Free the codec of a vocabulary file."""
    _CODECS.pop(path, None)


def encoded(batch: pa.RecordBatch, path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[str]]]]:
    """Runs of a batch's rows, the ids of each text as little-endian 32-bit integers, and its words."""
    c = codec(path)
    for part in slices(batch):
        docs = [c.words(t) if t else [] for t in part.column("text").to_pylist()]
        c.encode_words(docs)
        get = c.ids_of.__getitem__
        yield part, [b"".join(map(get, words)) for words in docs], docs


def encoded_ids(batch: pa.RecordBatch, path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of a batch's rows and the ids of each text as little-endian 32-bit integers."""
    c = codec(path)
    for part in slices(batch):
        yield part, c.encode_texts(part.column("text").to_pylist())


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, words in encoded(batch, path):
                text = codec(path).word_text
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(b" ".join(map(text, w))).hexdigest() for w in words], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids array<int> of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, _ in encoded(batch, path):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")
