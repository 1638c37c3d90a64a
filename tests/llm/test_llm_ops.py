"""The training-data operators against brute force, on small hand-made tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pii_brute import base
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "One  two\tthree four"), (7, "a b c d e f g h i j"), (8, "a b c d e f g h i j k"), (9, "A B C D E F G H I J"),
    (10, "x" * 50_000), (11, "word " * 20_000), (12, "é ñ 漢字 \U0001f600 ß Σ ς İ"), (13, "mail a.b@c.de, +1 (017) 555-7713 or 10.0.0.255; 4111 1111 1111 1111"), (14, "<|endoftext|> it's 'S \x1c\x85 ²½"),
    (15, "a b c d e f g h i j"), (16, "idiot"), (None, "null id"), (17, "tail\x0b\x0cwords"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in ODD], DOCS).withColumns({c: F.lit(1) for c in ("score", "size", "entity", "row", "x", "at", "block", "train", "base")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(n=60, seed=5):
    rng = np.random.default_rng(seed)
    pool = [f"w{i}" for i in range(400)]
    text = list(rng.choice(pool, 120))
    out = []
    for i in range(n):
        t = list(text)
        for k in rng.choice(120, rng.integers(0, 9), replace=False):
            t[k] = str(rng.choice(pool))
        out.append((1000 + i, " ".join(t)))
    shared = " ".join(rng.choice(pool, 30))
    out += [(2000 + i, shared + " " + " ".join(rng.choice(pool, int(rng.integers(3, 25))))) for i in range(n)]
    return out


def test_ngram_join(spark, odd):
    from panelmill.llm.ngram_join import near_duplicates, representatives

    rows = [(i, t) for i, t in ODD if i is not None] + near_copies()
    df = odd.where("doc_id IS NOT NULL").select("doc_id", "text").union(spark.createDataFrame(near_copies(), "doc_id long, text string")).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == components(rows)
    assert near_duplicates(odd).count() == len(ODD)
    stay = {r.doc_id for r in representatives(odd).collect()}
    assert stay == {c for _, c in components([(i, t) for i, t in ODD if i is not None]).values()} | {None}


def test_ngram_join_in_parts(spark, monkeypatch):
    """Large blocks dealt into parts, and all blocks as large ones, give the same components."""
    from panelmill.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    monkeypatch.setattr(ngram_join, "SMALL", 1)
    rows = near_copies(seed=6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


@pytest.mark.parametrize("small", [32, 1])
def test_ngram_join_clashes_and_sizes(spark, monkeypatch, small):
    """Clashing names of sets, many buckets and tasks, hot blocks by broadcast and blocks dealt by their shingles."""
    from panelmill.llm import ngram_join

    for name, value in {"BUCKET_TOKENS": 16, "TASK_TOKENS": 512, "TASK_ROWS": 8, "TASK_SHINGLES": 256, "CHUNK_SHINGLES": 512, "HOT_BLOCK": 4, "SMALL": small}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(seed=7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), name_bits=5).collect()}
    assert got == components(rows)


def test_quality(docs, labels, odd, empty):
    from panelmill.llm.quality import accepted, quality_scores

    s = quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = s[s.held_out]
    assert ((held.predicted == held.quality).mean() > 0.9) and s.score.between(0, 1).all()
    assert (s.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in s.doc_id]).all()
    assert quality_scores(odd, labels).where("score IS NOT NULL AND NOT isnan(score)").count() == len(ODD)
    assert quality_scores(odd, labels.where("quality = 1")).select("score").distinct().first().score in (0.5, 1.0)
    assert quality_scores(empty, labels).count() == 0
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality_scores(docs, labels).where("predicted = 1").count()


def test_topk(spark, monkeypatch):
    """Against brute force: repeated ids and rows, short, null and non-finite vectors, ties, several blocks."""
    from panelmill.llm import topk

    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 20))
    v[7], v[9] = v[3], v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(650, [1.0]), (3, v[3].tolist()), (3, (2 * v[3]).tolist()), (50, (3 * v[3]).tolist()), (50, v[50].tolist()), (700, [])]
    extra = [(500, None), (550, [1.0, None]), (600, [float("nan")] * 20), (None, [1.0] * 20), (800, [float("inf")])]
    df = spark.createDataFrame([(*x, 1) for x in rows + extra], "vec_id long, embedding array<double>, rank int").repartition(3)
    whole = [(i, np.floor(256 * np.pad(np.array(x, dtype=float), (0, 20 - len(x))))) for i, x in rows]
    want = []
    for a, (q, x) in enumerate(whole):
        if q % 50 == 0:
            best = sorted(((int(x @ y), c) for b, (c, y) in enumerate(whole) if a != b), key=lambda t: (-t[0], t[1]))[:5]
            want += [(q, r, c, s) for r, (s, c) in enumerate(best, 1)]
    for bytes_, tile, probes in ((1 << 24, 256, 2048), (160 * 4, 3, 2)):
        monkeypatch.setattr(topk, "QUERY_BYTES", bytes_)
        monkeypatch.setattr(topk, "TILE", tile)
        monkeypatch.setattr(topk, "PROBES", probes)
        assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    few = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).orderBy("rank").collect()] == [(50, 1, 1, 131072), (50, 2, 1, 65536), (50, 3, 2, 32768)]
    huge = [(0, [2.0**40, 1.0]), (1, [2.0**40, 3.0]), (2, [2.0**20, 5.0]), (3, [-(2.0**60), 0.0]), (4, [2.0**20, 6.0])]
    got = topk.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), k=4).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, 2**63 - 1), (4, 2**63 - 1), (3, -(2**63))]
    assert topk.top_k(few.limit(0)).count() == 0


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    from panelmill.llm.packing import pack

    tok = Tokenizer.from_file(vocabulary())
    for df in (docs, odd):
        rows = pack(df, vocabulary()).collect()
        texts = [(r.doc_id, r.text or "") for r in df.collect()]
        by = defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
        total = 0
        for i, t in texts:
            ids = tok.encode(t, add_special_tokens=False).ids + [0]
            total += len(ids)
            for r in sorted(by[i], key=lambda r: r.piece):
                part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
                assert r.start == 2048 * r.piece and r.ids_crc32 == zlib.crc32(part.tobytes())
            assert sum(r.length for r in by[i]) == len(ids)
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
        for s in sequences.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= 2048
        assert len(sequences) <= math.ceil(total / 2048) + 1
    assert pack(empty, vocabulary()).count() == 0


def test_plan_uses_up_counts():
    from panelmill.llm.packing import plan

    rng = np.random.default_rng(4)
    for _ in range(5):
        counts = np.bincount(rng.integers(1, 129, 300), minlength=129)
        used = Counter()
        for chosen, times in plan(counts, 128):
            assert sum(chosen) <= 128
            for n in chosen:
                used[n] += times
        assert [used[n] for n in range(129)] == counts.tolist()


@pytest.mark.parametrize("segment", [256, 3])
def test_lm(docs, odd, empty, monkeypatch, segment):
    from panelmill.llm import lm
    from panelmill.llm.lm import lm_scores

    monkeypatch.setattr(lm, "SEGMENT", segment)

    for df in (docs, odd) if segment > 3 else (odd.union(odd),):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        uni, bi, after = Counter(), Counter(), Counter()
        for i, t in rows:
            if not held(i):
                w = [*words(t), None]
                uni.update(w)
                bi.update(zip(["<s>", *w[:-1]], w))
        n, v = sum(uni.values()), len(uni)
        after.update(h for h, _ in bi)
        state = Counter(uni)
        state["<s>"] = sum(not held(i) for i, _ in rows)
        once, twice = (sum(c == k for c in bi.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.75
        got = defaultdict(list)
        for r in lm_scores(df).collect():
            got[r.doc_id].append(r)
        for i, t in rows:
            w = [*words(t), None]
            p = [(uni[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
            score = 0.0
            for h, x, q in zip(["<s>", *w[:-1]], w, p):
                score += math.log10((max(bi[h, x] - d, 0) + d * after[h] * q) / state[h] if state[h] else q)
            r = next(r for r in got[i] if r.n_tokens == len(w))
            assert (r.held_out, r.n_known, r.train_tokens) == (held(i), sum(uni[x] > 0 for x in w), n)
            assert math.isclose(r.base_score, sum(map(math.log10, p)), rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    assert lm_scores(empty).count() == 0


def test_string_kernel():
    from panelmill.llm.toxicity import DECAY, ORDER, _codes, kernel, windows

    def slow(s, t):
        from itertools import combinations

        def weights(x):
            out = defaultdict(float)
            for at in combinations(range(len(x)), ORDER):
                out["".join(x[i] for i in at)] += DECAY ** (at[-1] - at[0] + 1)
            return out

        a, b = weights(s), weights(t)
        return sum(v * b[k] for k, v in a.items())

    pairs = [("^idiot", "^idiot"), ("^i-d-iot", "^idiot"), ("^abc", "^cba"), ("^aaaa", "^aa"), ("^trash", "^thrash")]
    s, t = _codes([p[0] for p in pairs], 12)[0], _codes([p[1] for p in pairs], 9)[0]
    assert np.allclose(kernel(s, t), [slow(*p) for p in pairs], rtol=1e-5)
    assert windows("a") == [] and windows("ab") == ["ab"] and "".join(dict.fromkeys("".join(windows("x" * 100)))) == "x"


def test_toxicity(spark, labels, odd, empty):
    from panelmill.llm.toxicity import toxicity_scores

    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    s = toxicity_scores(big, known).join(known, "doc_id").toPandas()
    held = s[s.held_out]  # some 5 % of the labels 1 are on texts without any insult
    assert (held.predicted[held.toxic == 1] == 1).mean() > 0.85 and (held.toxic[held.predicted == 1] == 1).mean() > 0.9
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = ["The lyea idiot thonst", "The lyea i d i o t thonst", "The lyea id.iot thonst", "The lyea thonst"]
    more = big.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.doc_id - 10**6: r.predicted for r in toxicity_scores(more, known).where("doc_id >= 1000000").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0}
    assert toxicity_scores(odd, labels).where("score >= 0 AND score <= 1").count() == len(ODD)
    assert toxicity_scores(odd, labels.where("toxic = 0")).where("predicted = 0").count() == len(ODD)
    assert toxicity_scores(empty, labels).count() == 0


def test_bpe(docs, odd, empty):
    from tokenizers import Tokenizer

    from panelmill.llm.bpe import bpe_digest, encode_column

    tok = Tokenizer.from_file(vocabulary())
    for df in (docs, odd):
        got = {r.doc_id: r for r in bpe_digest(df, vocabulary()).collect()}
        raw = {r.doc_id: r.ids for r in encode_column(df, vocabulary()).collect()}
        for r in df.collect():
            ids = tok.encode(r.text or "", add_special_tokens=False).ids
            g = got[r.doc_id]
            assert raw[r.doc_id] == ids
            assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            assert g.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_digest(empty, vocabulary()).count() == 0


def test_sharding(spark, docs, odd, empty):
    from panelmill.llm.sharding import permuted, shard

    for df in (docs, odd):
        rows = shard(df).collect()
        n = df.count()
        assert sorted(r.row_number for r in rows) == list(range(n))
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        sizes = [len(by[k]) for k in range(40)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
        texts = defaultdict(list)
        for r in df.collect():
            texts[r.doc_id].append((r.text or "").encode())
        assert all((r.size, r.text_crc32) in [(len(t) + 16, zlib.crc32(t)) for t in texts[r.doc_id]] for r in rows)
        assert sorted(map(str, rows)) == sorted(map(str, shard(df.repartition(7)).collect()))
    for n in (1, 2, 3, 7, 40, 257, 1009):
        orders = [tuple(r.v for r in spark.range(n).select(permuted(F.col("id"), n, seed).alias("v")).orderBy("id").collect()) for seed in (0, 1)]
        assert all(sorted(o) == list(range(n)) for o in orders) and (n < 40 or orders[0] != orders[1])
    assert shard(odd.union(odd)).count() == 2 * len(ODD)
    assert shard(empty).count() == 0


def test_pii(odd, empty):
    from panelmill.llm.pii import pii_spans, redact

    for r in pii_spans(odd).collect():
        spans = base(next(t for i, t in ODD if i == r.doc_id))
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[3] for x in spans) for k in ("email", "ip", "card", "phone")]
    assert pii_spans(empty).count() == 0
    out = {r.doc_id: r.text for r in redact(odd).collect()}
    assert out[13] == "mail [EMAIL], [PHONE] or [IP]; [CARD]" and out[1] is None and out[10] == "x" * 50_000
    assert redact(odd).columns == odd.columns


def test_pii_base_spans_on_documents(docs, odd):
    """Base spans of all documents against the brute force, with rows twice."""
    from panelmill.llm.pii import pii_spans

    twice = docs.select("doc_id", "text").union(docs.select("doc_id", "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pii_spans(twice).collect()
    assert len(got) == 2 * len(texts) and sum(r.n_private > 0 for r in got) > 4
    for r in got:
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


#: Texts and the spans in them that no base pattern has, by hand; a bar stands at both ends of each.
WRITTEN = [
    ("Please e-mail |jane.doe (at) mail (dot) com| today.", "email"), ("contact |max at firma dot de|, thanks", "email"), ("write to |ann @ uni.edu| please", "email"), ("mail |bob @mail7.example| soon", "email"),
    ("the server |10[.]0[.]0[.]12| is down", "ip"), ("host |192 dot 168 dot 1 dot 7| here", "ip"), ("card |4111.1111.1111.1111| on file", "card"), ("visa |5500/0000/0000/0004| paid", "card"),
    ("call |(555) 123-4567| now", "phone"), ("phone |555.123.4567| now", "phone"), ("tel |0049 (89) 123-4567| ok", "phone"), ("reach me at |212-555-0187|.", "phone"),
    ("meet at noon dot the end", None), ("version 10.20.30 of 2024", None), ("figure 4111.1111.1111.1112 shows", None), ("number 1234567890123456 here", None), ("page 300 dot 400 dot 500 dot 600", None),
]


def test_pii_adds_written_forms(spark):
    """Precision and recall of the added spans on a table labelled by hand."""
    from panelmill.llm.pii import pii_spans, redact

    plain = [f"mail user{i}@mail{i}.example or call +1 (212) 555-0{100 + i}, host 10.1.2.{i}, card 4111 1111 1111 1111" for i in range(20)]
    rows = [(i, t.replace("|", "")) for i, (t, _) in enumerate(WRITTEN)] + [(100 + i, t) for i, t in enumerate(plain)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii_spans(df).where("doc_id < 100").collect()}
    want = {}
    for i, (t, kind) in enumerate(WRITTEN):
        a = t.find("|")
        want[i] = "" if kind is None else f"{kind}:{a}:{t.find('|', a + 1) - 1}"
    right = sum(got[i] == w for i, w in want.items() if w)
    assert right >= 0.9 * sum(map(bool, want.values())), (got, want)
    assert sum(bool(got[i]) for i, w in want.items() if not w) == 0, got
    assert redact(df).where("doc_id = 0").first().text == "Please e-mail [EMAIL] today."


def test_pii_long_texts_take_time_in_proportion(spark):
    import time

    from panelmill.llm.pii import pii_spans, redact

    text = "é a@b.de, " * 60_000
    df = spark.createDataFrame([(1, text), (2, "1" * 300_000), (3, "a.b" * 200_000), (4, "+1 " * 100_000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii_spans(df).collect()}
    out = {r.doc_id: r.text for r in redact(df).collect()}
    assert got[1].n_email == 60_000 and out[1] == "é [EMAIL], " * 60_000 and out[2] == "1" * 300_000
    assert time.time() - began < 40


def test_pii_learning():
    from panelmill.llm.pii import FEATURES, reliabilities, train_classifier

    yes, no = (1, 1, 1, 1, 0, 1), (-1, -1, 0, -1, -1, -1)
    model, prob = reliabilities([("phone", yes, 80), ("phone", no, 20)])
    assert prob["phone", yes] > 0.9 and prob["phone", no] < 0.1
    w = train_classifier([((1,) * len(FEATURES), 0.99, 80.0), ((0,) * len(FEATURES), 0.01, 20.0)])
    assert w[0] < 0 < sum(w)


@pytest.mark.parametrize("moduli", [None, ((7, 3), (5, 2))])
def test_exact_dedup(docs, odd, empty, moduli):
    """Small moduli make fingerprints clash; the groups stay exact."""
    from panelmill.llm.exact_dedup import MODULI, distinct_documents, exact_dedup

    for df in (docs, odd, odd.union(odd)):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        keep, size = {}, Counter(t for _, t in rows)
        for i, t in rows:
            if t not in keep or (i is not None and (keep[t] is None or i > keep[t])):
                keep[t] = i
        got = exact_dedup(df, moduli or MODULI).collect()
        texts = {(i, hashlib.sha256(t.encode()).hexdigest()): t for i, t in rows}
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(keep)
        for r in got:
            t = texts[r.doc_id, r.text_sha256]
            assert (r.keep_id, r.group_size) == (keep[t], size[t]) and (not r.kept or r.doc_id == keep[t])
    stay = distinct_documents(odd.union(odd))
    assert stay.count() == len({t or "" for _, t in ODD}) and stay.columns == odd.columns
    assert exact_dedup(empty).count() == 0


def test_huge_texts_are_hashed_in_segments(spark, monkeypatch):
    from panelmill.llm import exact_dedup

    rows = [(i, ("ab" * 90 + "é" * (i % 3)) * (1 + i % 2)) for i in range(12)] + [(20, None), (21, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {tuple(r) for r in exact_dedup.fingerprinted(df).collect()}
    monkeypatch.setattr(exact_dedup, "SEGMENT", 100)
    assert {tuple(r) for r in exact_dedup.fingerprinted(df).collect()} == whole and len(whole) == 14


def test_fingerprints_compose():
    from panelmill.llm.exact_dedup import CHUNK, MODULI, combine, fingerprints

    raw = np.random.default_rng(1).integers(0, 256, 3 * CHUNK + 77, dtype=np.uint8)
    for m in MODULI:
        whole = int(fingerprints(raw, np.array([0, len(raw)]), m, {})[0])
        for cut in (0, 1, CHUNK, 2 * CHUNK + 5, len(raw)):
            a, b = (int(fingerprints(x, np.array([0, len(x)]), m, {})[0]) for x in (raw[:cut], raw[cut:]))
            assert combine(a, cut, b, m) == whole


def test_components(spark):
    from panelmill.llm.components import components as distributed

    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for e in links if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in distributed(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert distributed(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    from panelmill.llm.quality import quality_scores

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r.doc_id for r in quality_scores(docs, labels).where("predicted = 1").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    last = {}
    for i, t in rows.items():
        last[t] = max(i, last.get(t, i))
    distinct = [(i, t) for t, i in last.items()]
    stay = {c for _, c in components(distinct).values()}
    packed = p.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == stay


def test_pipeline_stages_on_odd_rows(spark, odd):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table in every stage."""
    import corpus_pipeline as p

    twice = odd.union(odd)
    texts = {t or "" for _, t in ODD}
    kept = {}
    for name, stage in p.STAGES:
        rows = stage(spark, twice, DATA).collect()
        kept[name] = rows
        if name != "best-fit packing":
            assert set(rows[0].asDict() if rows else p.COLUMNS) == set(p.COLUMNS)
    assert len(kept["exact dedup"]) == len(texts) and len(kept["PII"]) == 2 * len(ODD)
    assert {r.text for r in kept["PII"] if r.doc_id == 1} == {None}
    assert len({r.doc_id for r in kept["best-fit packing"]}) == len(ODD)
    for name, stage in p.STAGES[:2] + p.STAGES[3:]:
        assert stage(spark, odd.where("doc_id = -1"), DATA).count() == 0


@pytest.mark.parametrize("moduli", [None, ((7, 3), (5, 2))])
def test_exact_dedup_keeps_one_row_when_files_are_split_anew(spark, monkeypatch, moduli):
    """Copies with one doc_id, and other splits of the files in the job after the groups'."""
    from panelmill.llm import exact_dedup

    write, max_bytes = exact_dedup.materialize, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(max_bytes)

    def split_anew(df, name):
        out = write(df, name)
        if name == "groups":
            spark.conf.set(max_bytes, "256")
        return out

    monkeypatch.setattr(exact_dedup, "materialize", split_anew)
    df = spark.createDataFrame([(i // 3, f"text {i // 3} " * 9) for i in range(600)], "doc_id long, text string").repartition(3)
    try:
        got = exact_dedup.exact_dedup(df, moduli or exact_dedup.MODULI).collect()
    finally:
        spark.conf.set(max_bytes, before)
    kept = [r.doc_id for r in got if r.kept]
    assert len(got) == 600 and sorted(kept) == list(range(200))


def test_toxicity_bound_loses_no_close_word():
    """The bound by shared letters against all kernels."""
    from panelmill.llm import toxicity as T

    rng = np.random.default_rng(3)
    marks = T.Landmarks(["^idiot", "^worthless", "^réeux"]).with_bounds()
    words = ["^" + "".join(rng.choice(list("idotworhlesréux"), rng.integers(2, 8))) for _ in range(3000)] + ["^idiot", "^idot", "^wortless", "^réeuxment"]
    codes, lens = T._codes(words, T.WINDOW)
    every = np.repeat(np.arange(len(words)), 3)
    value = marks.kernels(codes, lens, every, np.tile(np.arange(3), len(words))).reshape(-1, 3)
    got = np.zeros_like(value)
    i, j, v = marks.similarities(words)
    got[i, j] = v
    short = lens[:, None] <= T.LONGER * marks.lens
    assert np.allclose(got[short], np.where(value >= T.CLOSE, value, 0)[short], atol=1e-6) and (value >= T.CLOSE).sum() > 3


def test_toxicity_finds_stretched_and_joined_insults(spark):
    from panelmill.llm.toxicity import Landmarks, spellings, toxicity_scores

    marks = Landmarks(["^idiot", "^trash", "^scum"]).with_bounds()
    for token, at in (("idiooooooooooooooooooooooooot", 0), ("you/stupid-idiot-trash", 1), ("the_scum/of_all_things_here", 2), ("thelyeathonstidiotlyeathonstthe", 0), ("qwertyuioplkjhgfdstrash", 1)):
        _, j, value = marks.similarities(spellings(token))
        assert value[j == at].max() > 0.99
    assert not len(marks.similarities(["^bbbbbbbbbbbbbbbbbbbbbbb"])[0])
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = ["The lyea idiooooooooooooooot thonst", "The lyea you/stupid-idiot-trash thonst", "The lyea thonstlyeathonstidiotlyea thonst", "The lyea thonst"]
    more = big.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.doc_id - 10**6: r.predicted for r in toxicity_scores(more, known).where("doc_id >= 1000000").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0}
