"""Words of texts with marks, unassigned and rare characters against the tokenizers library."""

import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelmill.llm.bpe import PLAIN, UNSETTLED, Codec, plain_words


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return Codec(path), library


def differing(both, texts):
    codec, library = both
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    return [t for t, ids in zip(texts, want) if codec.encode(t).tolist() != ids]


def test_single_characters(both):
    rare = ["՘", "Ᲊ", "Ɤ", "İ", "ﬁ", *map(chr, (0x10940, 0x16EA0, 0x18E00, 0x1F600, 0x10FFFF))]
    every = [chr(c) for c in range(0, 0x3500, 5) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xA000, 0x20000, 61) if not 0xD800 <= c < 0xE000]
    assert differing(both, [f"a{c}b 9{c}" for c in rare + every]) == []
    assert not UNSETTLED.search("plain text, éßЖ中 ’—") and all(UNSETTLED.search(c) for c in ("՘", "́", "\U0001f600"))


def test_orders_of_marks_and_mixtures(both):
    rng = random.Random(7)
    marks = [chr(c) for c in range(0x20000) if unicodedata.combining(chr(c))]
    assert differing(both, ["e" + rng.choice(marks) + rng.choice(marks) + "x" for _ in range(4000)]) == []
    pool = [chr(c) for c in range(0x700)] * 2 + [chr(c) for c in range(0x2000, 0x2100)] + marks
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    assert differing(both, texts + ["<|endoftext|>é̖<|startoftext|>", "́", "́" * 5000]) == []


def test_texts_by_chunks(both, monkeypatch):
    codec, library = Codec(public_tokenizers.path("word_bpe_49k.json")), both[1]
    rng = random.Random(11)
    pool = [*"abcdefghijklmnopqrstuvwxyzéÉçÀß.,;:!?'\"-_()#0189", *"   \n\t", "\xa0", "\x1f", "\x85", "½", "²", "’", "Σ", "́", "'s", "'LL", "the", "tion", "<|endoftext|>", "\x01", "\U0001f600"]
    texts = [None, "", " ", "\n\n"] + ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(3000)] + ["ab" * 3000 + ", " + "x" * 5000]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    monkeypatch.setattr("panelmill.llm.bpe.CACHE_WORDS", 500)  # emptied between and within runs
    monkeypatch.setattr("panelmill.llm.bpe.MERGE_CELLS", 1 << 8)
    for k in (1, 7, 400, len(texts)):
        got = [b for i in range(0, len(texts), k) for b in codec.encode_texts(texts[i : i + k])]
        assert [np.frombuffer(b, dtype="<u4").tolist() for b in got] == want


def test_words_of_texts_together():
    rng = random.Random(5)
    pool = [*"abzéßÿœ''''''stmdrevl.,_-01 \n\t\xa0", "'s", "'re", "'ll", "'ve", "\x01", "ª", "×", "˂"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(3000)] + ["'", "x'", "'r", "'re", "'s's", ".'s", "5'd", " ", "\n"]
    for part in (texts, [], [""], [" \n", ""], ["'l"], ["the"]):
        distinct, nth, upto = plain_words(part)
        assert len(set(distinct)) == len(distinct)
        found, at = [distinct[i] for i in nth.to_pylist()], [0, *upto.tolist()]
        assert [found[a:b] for a, b in zip(at, at[1:])] == [PLAIN.findall(t) for t in part]


def test_full_cache_learns_no_word_at_hand_again(monkeypatch):
    codec, learned = Codec(public_tokenizers.path("word_bpe_49k.json")), []
    learn = codec.learn
    monkeypatch.setattr(codec, "learn", lambda words: (learned.append(sorted(words)), learn(words)))
    monkeypatch.setattr("panelmill.llm.bpe.CACHE_WORDS", 2)
    first = codec.encode_texts(["alpha beta gamma"])[0]
    both = codec.encode_texts(["alpha beta gamma delta", "alpha beta gamma"])
    assert learned == [["alpha", "beta", "gamma"], ["delta"]]
    assert both[1] == first and both[0].startswith(first) and len(codec.ids_of) == 4
