"""Near-duplicate documents by a Jaccard join of word shingles with signature trees.

A document's set holds its distinct shingles of ``width`` words; two documents link
when 100 * intersection >= threshold * union.  Steps, all over whole texts:

1. Documents with equal sets are one entity, named by a 64-bit hash of the set.  A second hash
   tells sets apart whose names clash; such names are replaced by a hash of both.
2. Shingles get one global order: rare ones first (by a fixed-size table of counts of hash
   values; any order gives the same links), then by hash.  Two sets that link share
   a shingle among the first ``n - ceil(t * n) + 1`` of both, so entities that share one
   form a block.  Equal blocks are kept once, with the number of their shingles.
3. In a first round, each entity is compared with the block neighbours that it shares
   most blocks with, and the links found give first components.
4. Blocks whose entities are all in one component need no more work.  Small blocks give
   for each pair of different components the number of first shingles that both have; if
   it is too small for the sets to link, the pair is out, and what is left of an entity's
   partners is one group.  For each group and each large block a signature tree is built:
   leaves hold the bitmap of an entity's shingles and its size, inner nodes the OR of their
   bitmaps and the range of sizes and components.
   A dual traversal prunes node pairs whose largest possible overlap is too small, whose
   sizes can't fit, or which lie in one component.
5. The pairs that are left are verified on their whole shingle sets.

The first round gives most links between copies of one text; all other links, and the proof
that none is missing, come from the trees.  The count of shared first shingles in small blocks
only spares the trees pairs that cannot link.

Only links that join components are sought, so a group of copies needs no expansion into
pairs.  A null or empty text has no shingles and links with nothing; a text with fewer
words than ``width`` has its whole sequence as its one shingle.  Repeated rows give
repeated results; a row without doc_id takes the smallest doc_id of its component, null if no
other row has one; an empty table gives
an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, few_files, give_back, join_groups, materialize, partitions_of, slices, sorted_out
from .components import components
from .textblocks import flat_bytes, mix, shingle_sets, word_hashes

#: Counters of the table of frequent shingles: its size is fixed.
SKETCH = 1 << 20
#: Bits of the filter of wanted documents: its size is fixed, false positives only cost work.
FILTER_BITS = 1 << 23
#: Children of a node, and entities of a block that one task takes at a time.
FANOUT, CHUNK = 8, 4096
#: Bits of a node's bitmap, neighbours compared in the first round, and the overlap beyond
#: the needed one from which a pair is taken to link until it is verified.
COARSE, NEIGHBOURS, SLACK = 2048, 2, 3
#: Entities of a block whose pairs are counted over all blocks before their trees are built.
SMALL = 32
#: Rows of small blocks that share a task's group, and shingles of all its rows.
TASK_ROWS, TASK_SHINGLES = 20_000, 1 << 23
#: Shingles of the entities of a block that one task takes at a time.
CHUNK_SHINGLES = 1 << 22
#: First shingles of a bucket and of a task, in the mean, when blocks are formed.
BUCKET_TOKENS, TASK_TOKENS = 1 << 20, 1 << 23
#: Rows from which a block may be joined by broadcast (at most 1 / HOT_SHARE blocks are).
HOT_BLOCK = 256
U64 = np.uint64


def needed(n, threshold: int):
    """Least overlap of a set of n with any set that it links with: ceil(t * n)."""
    return -(-threshold * n // 100)


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many shingles of all documents fall on each of SKETCH hash values.

    Each task sums its texts into one table of fixed size and hands it on in parts."""
    parts = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                sets, _ = shingle_sets(*word_hashes(*flat_bytes(part.column("text"))), width)
                table += np.bincount((sets >> U64(44)).astype(np.int64), minlength=SKETCH)
        give_back()
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in np.split(table, parts)], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # one row of counts at a time is added
        for batch in batches:
            for k, x in zip(batch.column("part").to_pylist(), batch.column("counts")):
                total[k] = total.get(k, 0) + np.frombuffer(x.as_buffer(), dtype=np.uint32).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

    sums = docs.select("text").mapInArrow(count, "part long, counts binary").repartition(parts, "part").mapInArrow(add, "part long, counts binary")
    out = np.zeros((parts, SKETCH // parts), dtype=np.int64)
    for part, numbers in sums.toPandas().itertuples(index=False):  # SKETCH numbers, in one job
        out[part] = np.frombuffer(numbers, dtype=np.int64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def signature_width(n: int) -> int:
    """Values of a leaf's signature: 2^16, or for sets above 4096 the power of two from 16 n."""
    return max(1 << 16, 1 << int(16 * n - 1).bit_length())


def signature(sets: np.ndarray) -> bytes:
    """The set bits of a leaf's bitmap, sorted: two bytes each, or four for wide bitmaps."""
    width = signature_width(len(sets))
    return np.unique(sets & U64(width - 1)).astype(np.uint16 if width == 1 << 16 else np.uint32).tobytes()


def read_signature(n: int, bits: bytes) -> np.ndarray:
    return np.frombuffer(bits, dtype=np.uint16 if signature_width(n) == 1 << 16 else np.uint32).astype(np.int64)


def entities(docs: DataFrame, width: int, threshold: int, counts: np.ndarray, name_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, entity, second (another hash of the set), prefix (ordered first shingles), bits."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, off = shingle_sets(*word_hashes(*flat_bytes(part.column("text"))), width)
                (names, second), firsts, maps = entity_names(sets, off, name_bits), [], []
                order = shared.value[(sets >> U64(44)).astype(np.int64)]
                for i in range(len(off) - 1):
                    own = sets[off[i] : off[i + 1]]
                    n = len(own)
                    keep = n - needed(n, threshold) + 1 if n else 0
                    by = np.argsort(order[off[i] : off[i + 1]], kind="stable")[:keep]
                    firsts.append(own[by])
                    maps.append(signature(own) if n else b"")
                at = np.concatenate(([0], np.cumsum([len(f) for f in firsts])))
                flat = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(off)), pa.array(names), pa.array(second), cut(flat, at), pa.array(maps, pa.binary())],
                    names=["doc_id", "n_shingles", "entity", "second", "prefix", "bits"],
                )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, entity long, second long, prefix binary, bits binary")


def entity_names(sets: np.ndarray, off: np.ndarray, name_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, from sums of different hashes of its shingles; the first has ``name_bits`` bits."""

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([U64(0)], np.cumsum(mix(values), dtype=np.uint64)))
        return mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64))

    return (sums(sets) >> U64(64 - name_bits)).astype(np.int64), sums(~sets).astype(np.int64)


def apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """rows without ``second``, where entities in ``clashes`` are renamed by both hashes of their set.

    Of n different sets about n^2 / 2^65 pairs clash, so the table of clashes is broadcast: for 10^11
    sets it has some 300 rows."""
    if clashes is not None:
        rows = rows.join(F.broadcast(clashes.withColumn("clash", F.lit(True))), "entity", "left")
        rows = rows.withColumn("entity", F.when(F.col("clash"), F.xxhash64("entity", "second")).otherwise(F.col("entity"))).drop("clash")
    return rows.drop("second")


def blocks(rows: DataFrame, threshold: int) -> DataFrame:
    """block, entity, next (its neighbour in the block), weight (shingles with this block).

    Shingles are dealt into buckets, and buckets to tasks, whose numbers grow with the first
    shingles of all documents."""
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * threshold / 100) + 1
    n_tokens = int(rows.where("n_shingles > 0").agg(F.sum(first)).first()[0] or 0)
    partitions = partitions_of(rows.sparkSession)
    n_tasks = max(partitions, n_tokens // TASK_TOKENS)
    n_buckets = max(2 * partitions, n_tokens // BUCKET_TOKENS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(batch.column("entity").to_numpy(), return_index=True)
            batch = batch.take(pa.array(first))
            raw, off = flat_bytes(batch.column("prefix"))
            tokens = np.frombuffer(raw.tobytes(), dtype=np.uint64)
            owner = np.repeat(batch.column("entity").to_numpy(), np.diff(off) // 8)
            bucket = (mix(tokens) % U64(n_buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            has, at = np.unique(bucket[by], return_index=True)
            at = np.append(at, len(by))
            yield pa.RecordBatch.from_arrays([pa.array(has), cut(tokens[by], at), cut(owner[by], at)], names=["bucket", "tokens", "owners"])

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in pdf["tokens"]])
        owners = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pdf["owners"]])
        by = np.lexsort((owners, tokens))
        tokens, owners = tokens[by], owners[by]
        new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])))
        tokens, owners = tokens[new], owners[new]
        start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        size = np.diff(np.append(start, len(tokens)))
        keep = np.repeat(size > 1, size)
        owners, size = owners[keep], size[size > 1]
        if not len(size):
            return pd.DataFrame({"block": [], "entity": [], "next": [], "weight": []}).astype("int64")
        start = np.cumsum(size) - size
        names = mix(np.add.reduceat(mix(owners.astype(np.uint64)), start) + size.astype(np.uint64))
        _, first, weight = np.unique(names, return_index=True, return_counts=True)
        pick = np.zeros(len(size), dtype=np.int64)
        pick[first] = weight
        chosen = np.repeat(pick, size)
        after = np.append(owners[1:], owners[:1])
        after[start + size - 1] = owners[start]
        sel = chosen > 0
        return pd.DataFrame({"block": np.repeat(names, size)[sel].astype(np.int64), "entity": owners[sel], "next": after[sel], "weight": chosen[sel]})

    packed = rows.where("n_shingles > 0").select("entity", "prefix").mapInArrow(pack, "bucket long, tokens binary, owners binary")
    packed = packed.repartition(n_tasks, "bucket") if n_tasks > partitions else packed
    grouped = packed.groupBy("bucket").applyInPandas(group, "block long, entity long, next long, weight long")
    return grouped.groupBy("block", "entity", "next").agg(F.sum("weight").alias("weight"))


def neighbour_pairs(block_rows: DataFrame) -> DataFrame:
    """a, b: each entity and the block neighbours with which it shares most blocks."""
    both = block_rows.select("entity", "next", "weight").unionByName(block_rows.select(F.col("next").alias("entity"), F.col("entity").alias("next"), "weight"))
    shared = both.where("entity != next").groupBy("entity", "next").agg(F.sum("weight").alias("weight"))
    nth = F.row_number().over(W.Window.partitionBy("entity").orderBy(F.desc("weight"), "next"))
    best = shared.withColumn("nth", nth).where(F.col("nth") <= NEIGHBOURS)
    return best.select(F.least("entity", "next").alias("a"), F.greatest("entity", "next").alias("b")).distinct()


# the signature tree


class SignatureTree:
    """Levels of nodes over leaves sorted by size.

    A leaf has a fine bitmap, kept as its set bits; all nodes have the OR of their leaves'
    bitmaps folded to COARSE bits, and the largest number of shingles that a leaf has beyond
    its coarse bits ("spare"), the range of sizes and the range of components."""

    def __init__(self, entity: np.ndarray, size: np.ndarray, label: np.ndarray, bits: list[bytes]):
        by = np.lexsort((label, size))
        self.entity, self.size, self.label = entity[by], size[by], label[by]
        self.fine = [read_signature(int(size[i]), bits[i]) for i in by]
        flags = np.zeros((len(by), COARSE), dtype=bool)
        for i, f in enumerate(self.fine):
            flags[i, f & (COARSE - 1)] = True
        maps = np.packbits(flags, axis=1).view(np.uint64)
        spare = self.size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [{"maps": maps, "lo": self.size, "hi": self.size, "spare": spare, "first": self.label, "last": self.label}]
        while len(self.levels[-1]["lo"]) > FANOUT:
            down = self.levels[-1]
            at = np.arange(0, len(down["lo"]), FANOUT)
            merge = (("maps", np.bitwise_or), ("lo", np.minimum), ("hi", np.maximum), ("spare", np.maximum), ("first", np.minimum), ("last", np.maximum))
            self.levels.append({k: f.reduceat(down[k], at, axis=0) for k, f in merge})

    def candidates(self, other: SignatureTree, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaf pairs that the nodes above can't rule out, from a dual traversal level by level."""
        depth = max(len(self.levels), len(other.levels)) - 1
        x, y = (g.ravel() for g in np.meshgrid(np.arange(len(self.levels[-1]["lo"])), np.arange(len(other.levels[-1]["lo"])), indexing="ij"))
        while True:
            a, b = self.levels[min(depth, len(self.levels) - 1)], other.levels[min(depth, len(other.levels) - 1)]
            ok = (100 * b["hi"][y] >= threshold * a["lo"][x]) & (100 * a["hi"][x] >= threshold * b["lo"][y])
            ok &= ~((a["first"][x] == a["last"][x]) & (b["first"][y] == b["last"][y]) & (a["first"][x] == b["first"][y]))
            if self is other:
                ok &= (x <= y) if depth else (x < y)
            x, y = x[ok], y[ok]
            keep = [np.zeros(0, bool)]
            for k in range(0, len(x), 1 << 14):
                i, j = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
                most = np.bitwise_count(a["maps"][i] & b["maps"][j]).sum(axis=1) + np.minimum(a["spare"][i], b["spare"][j])
                keep.append(most >= least_overlap(a["lo"][i] + b["lo"][j], threshold))
            x, y = x[np.concatenate(keep)], y[np.concatenate(keep)]
            if not depth:
                return x, y
            depth -= 1
            x, y = _children(x, y, depth < len(self.levels) - 1, depth < len(other.levels) - 1, len(self.levels[min(depth, len(self.levels) - 1)]["lo"]), len(other.levels[min(depth, len(other.levels) - 1)]["lo"]))

    def pairs(self, other: SignatureTree, threshold: int, slack: int) -> list[tuple[int, int, bool]]:
        """(entity, entity, sure): pairs of different components whose fine bitmaps let them link.

        A pair with a likely overlap of ``slack`` more than the needed one is taken to link, and of pairs
        between two components joined so far only the first such one is given; the caller
        verifies it.  Closer calls are all given."""
        x, y = self.candidates(other, threshold)
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                root[v] = root.get(root[v], root[v])
                v = root[v]
            return v

        out = []
        at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else [0]
        for lo, hi in zip(at[:-1], at[1:]):
            i = int(x[lo])
            mine = find(int(self.label[i]))
            js = [j for j in y[lo:hi].tolist() if find(int(other.label[j])) != mine]
            if not js:
                continue
            most, likely = fine_overlaps(self.fine[i], int(self.size[i]), [other.fine[j] for j in js], other.size[js])
            need = least_overlap(self.size[i] + other.size[js], threshold)
            for k in np.flatnonzero(most >= need).tolist():
                theirs, sure = find(int(other.label[js[k]])), bool(likely[k] >= need[k] + slack)
                if theirs == mine:
                    continue
                out.append((int(self.entity[i]), int(other.entity[js[k]]), sure))
                if sure:
                    root[max(mine, theirs)] = min(mine, theirs)
                    mine = min(mine, theirs)
        return out


def least_overlap(sizes, threshold: int):
    """Least intersection of two sets with this sum of sizes: ceil(t / (1 + t) * sum)."""
    return -(-threshold * sizes // (100 + threshold))


def fine_overlaps(one: np.ndarray, n: int, many: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intersections of one set with many, at the width of the smaller bitmap of each pair: the
    largest possible ones, common bits plus spare shingles, and likely ones, common bits less
    twice the bits that differing shingles share by chance."""
    out, likely = np.zeros(len(many), dtype=np.int64), np.zeros(len(many), dtype=np.int64)
    own = signature_width(n)
    widths = np.array([min(own, signature_width(int(s))) for s in sizes])
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        flags = np.zeros(width, dtype=bool)
        mine = one & (width - 1)
        flags[mine] = True
        spare = n - int(flags.sum())
        theirs = [m if signature_width(int(sizes[k])) == width else np.unique(m & (width - 1)) for k, m in ((k, many[k]) for k in at.tolist())]
        lens = np.array([len(m) for m in theirs])
        common = np.add.reduceat(flags[np.concatenate(theirs)].astype(np.int64), np.cumsum(lens) - lens)
        out[at] = common + np.minimum(spare, sizes[at] - lens)
        likely[at] = common - 2 * (np.maximum(n - common, 0) * np.maximum(sizes[at] - common, 0) // width)
    return out, likely


def _children(x, y, down_x: bool, down_y: bool, n_x: int, n_y: int):
    step = np.arange(FANOUT)
    xs = x[:, None] * FANOUT + step if down_x else x[:, None]
    ys = y[:, None] * FANOUT + step if down_y else y[:, None]
    cx = np.repeat(xs, ys.shape[1], axis=1).ravel()
    cy = np.tile(ys, (1, xs.shape[1])).ravel()
    ok = (cx < n_x) & (cy < n_y)
    return cx[ok], cy[ok]


def tree_pairs(block_rows: DataFrame, known: DataFrame, labels: DataFrame, threshold: int, slack: int) -> DataFrame:
    """a, b, sure: pairs of entities of different components that the trees can't rule out."""
    spark = block_rows.sparkSession
    labelled = block_rows.select("block", "entity", "weight").join(labels.withColumnRenamed("node", "entity"), "entity", "left").join(known.select("entity", "n_shingles"), "entity")
    labelled = materialize(labelled.withColumn("label", F.coalesce("root", "entity")).drop("root"), "labelled")
    open_ = labelled.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("mass"))
    n_rows = labelled.count()
    open_ = materialize(few_files(open_.where("lo != hi").select("block", "n", "mass"), n_rows), "open_blocks")
    rows = materialize(join_groups(labelled, open_, ["block"], "n", n_rows, HOT_BLOCK).where("n IS NOT NULL"), "open")
    # small blocks: partners by the number of first shingles that two entities share
    small = rows.where(F.col("n") <= SMALL).select("block", "entity", "label", "n_shingles", "weight")
    other = small.select("block", F.col("entity").alias("b"), F.col("label").alias("label_b"), F.col("n_shingles").alias("n_b"))
    sides = small.toDF("block", "a", "label_a", "n_a", "weight").join(other, "block")
    most = F.greatest("n_a", "n_b")
    sides = sides.where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & (100 * F.least("n_a", "n_b") >= threshold * most))
    shared = sides.groupBy("a", "b", "label_a", "label_b", "n_a", "n_b").agg(F.sum("weight").alias("k"))
    later = F.ceil(most * threshold / 100) - 1  # shingles behind the first ones
    sized = materialize(shared.where((F.col("k") + later) * (100 + threshold) >= threshold * (F.col("n_a") + F.col("n_b"))), "counted")
    ends = sized.select(F.col("a").alias("block"), F.lit(1).alias("own"), F.col("b").alias("entity"), F.col("label_b").alias("label"))
    ends = ends.unionByName(sized.select(F.col("a").alias("block"), F.lit(0).alias("own"), F.col("a").alias("entity"), F.col("label_a").alias("label")).distinct())
    # groups of a task follow the rows and the shingles that are left
    groups = lambda n, mass: max(partitions_of(spark), int(n or 0) // TASK_ROWS, int(mass or 0) // TASK_SHINGLES)
    few = groups(*sized.agg(F.count(F.lit(1)), F.sum(F.col("n_a") + F.col("n_b"))).first())
    many = groups(*rows.where(F.col("n") > SMALL).agg(F.count(F.lit(1)), F.sum("n_shingles")).first())
    stars = ends.select(F.pmod("block", F.lit(few)).alias("bucket"), F.lit(0).alias("i"), F.lit(1).alias("j"), "block", "own", "entity", "label")
    # a block of more than CHUNK entities or CHUNK_SHINGLES shingles is dealt into parts, and each pair of parts is a group
    parts = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("mass") / CHUNK_SHINGLES)).cast("int")
    large = rows.where(F.col("n") > SMALL).select("block", "entity", "label", parts.alias("parts"))
    large = large.withColumn("own", F.pmod(F.xxhash64("entity"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = large.select(
        F.when(F.col("parts") == 1, F.pmod("block", F.lit(many))).otherwise(F.col("block")).alias("bucket"),
        F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "block", "own", "entity", "label",
    )
    rows = stars.withColumn("star", F.lit(True)).unionByName(large.withColumn("star", F.lit(False))).join(known, "entity")

    def traverse(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[2]), int(key[3])
        by = np.argsort(pdf["block"].to_numpy(), kind="stable")
        block, own_part = pdf["block"].to_numpy()[by], pdf["own"].to_numpy()[by]
        entity, size, label = (pdf[c].to_numpy()[by] for c in ("entity", "n_shingles", "label"))
        maps = pdf["bits"].to_numpy()[by]
        at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        found: dict[tuple[int, int], bool] = {}
        for lo, hi in zip(at.tolist(), at[1:].tolist()):
            make = lambda k: SignatureTree(entity[k], size[k], label[k], list(maps[k]))
            k = np.arange(lo, hi)
            if i == j:
                tree = make(k)
                new = tree.pairs(tree, threshold, slack)
            else:
                left, right = k[own_part[k] == i], k[own_part[k] == j]
                new = make(left).pairs(make(right), threshold, slack) if len(left) and len(right) else []
            for a, b, sure in new:
                found[min(a, b), max(a, b)] = sure
        ends = np.array(list(found), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1], "sure": np.array(list(found.values()), dtype=bool)})

    return rows.groupBy("star", "bucket", "i", "j").applyInPandas(traverse, "a long, b long, sure boolean").distinct()


def fitting_pairs(pairs: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """Pairs that the bitmaps of the two leaves can't rule out."""
    size, bits = known.select("entity", "n_shingles"), known.select("entity", "bits")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            keep = [
                fine_overlaps(read_signature(p, u), p, [read_signature(q, v)], np.array([q]))[0][0] >= least_overlap(p + q, threshold)
                for p, u, q, v in zip(d["n_a"].tolist(), d["bits_a"], d["n_b"].tolist(), d["bits_b"])
            ]
            yield d.loc[keep, ["a", "b"]]

    sized = pairs.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b").where(f"100 * n_a >= {threshold} * n_b and 100 * n_b >= {threshold} * n_a")
    sized = sized.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
    return sized.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, first_doc: DataFrame, width: int, threshold: int, name_bits: int = 64, clashes: DataFrame | None = None) -> DataFrame:
    """The pairs that link, by their whole sets.

    Sets are made again, from one document of each entity that occurs in a pair; a filter
    of fixed size picks these documents before their texts are cut.
    """
    spark = docs.sparkSession
    wanted = pairs.select(F.col("a").alias("entity")).unionByName(pairs.select(F.col("b").alias("entity"))).distinct().join(first_doc, "entity")
    where = F.shiftrightunsigned(F.xxhash64(F.col("doc_id")), 64 - FILTER_BITS.bit_length() + 1)
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    per_byte = wanted.select(F.floor(where / 8).alias("byte"), F.pow(F.lit(2), where % 8).cast("int").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bit"))
    found = per_byte.toPandas()  # at most FILTER_BITS / 8 rows of two numbers, in one job
    bits[found["byte"].to_numpy(dtype=np.int64)] = found["bit"].to_numpy(dtype=np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for part in slices(batch):
                sets, off = shingle_sets(*word_hashes(*flat_bytes(part.column("text"))), width)
                names, second = entity_names(sets, off, name_bits)
                _, first = np.unique(np.column_stack((names, second)), axis=0, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[first]), pa.array(second[first]), cut(sets, off).take(pa.array(first))], names=["entity", "second", "shingles"])
        give_back()

    made = docs.select("text", where.alias("at")).mapInArrow(make, "entity long, second long, shingles binary")
    sets = materialize(apart(made, clashes).join(wanted.select("entity"), "entity", "left_semi").dropDuplicates(["entity"]), "sets")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                u, v = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common = len(u) + len(v) - len(np.unique(np.concatenate((u, v))))
                keep.append(100 * common >= threshold * (len(u) + len(v) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sided = pairs.join(sets.select(F.col("entity").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("entity").alias("b"), F.col("shingles").alias("set_b")), "b")
    return sided.select("a", "b", "set_a", "set_b").mapInArrow(test, "a long, b long")


def joined_labels(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels after further links: components of the links between the components so far."""
    end = lambda c: F.coalesce(F.col(f"root_{c}"), F.col(c))
    known = lambda c: labels.toDF(c, f"root_{c}")
    between = more.join(known("a"), "a", "left").join(known("b"), "b", "left").select(end("a").alias("a"), end("b").alias("b"))
    over = components(materialize(few_files(between, more.count()), "between"))
    moved = labels.join(over.toDF("root", "new"), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return materialize(few_files(moved.unionByName(over.join(labels.select("node"), "node", "left_anti")), labels.count() + over.count()), "labels")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 75, name_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.  Fewer ``name_bits`` give more clashes of
    names, which are resolved, and the same result."""
    docs = docs.select("doc_id", "text")

    def per_entity(rows: DataFrame, *more) -> DataFrame:
        return materialize(rows.where("n_shingles > 0").groupBy("entity").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *more), "entity_docs")

    rows = materialize(entities(docs, width, threshold, shingle_counts(docs, width), name_bits), "entities")
    one = per_entity(rows, F.min("second").alias("lo"), F.max("second").alias("hi"))
    clashes = one.where("lo != hi").select("entity")
    clashes = None if clashes.isEmpty() else materialize(clashes, "clashes")
    if clashes is not None:
        rows = materialize(apart(rows, clashes), "entities")
        one = per_entity(rows)
    one = one.select("entity", "doc_id", "copies")
    block_rows = materialize(blocks(rows, threshold), "blocks")
    first_doc = one.select("entity", "doc_id")
    in_blocks = block_rows.select("entity").distinct()
    known = materialize(rows.select("entity", "n_shingles", "bits").join(in_blocks, "entity", "left_semi").groupBy("entity").agg(F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits")), "bitmaps")

    near = materialize(fitting_pairs(neighbour_pairs(block_rows), known, threshold), "near")
    links = materialize(verified(near, docs, first_doc, width, threshold, name_bits, clashes), "links")
    labels = components(links)
    slack = SLACK
    while True:
        rest = materialize(tree_pairs(block_rows, known, labels, threshold, slack), "pairs")
        if rest.isEmpty():
            break
        more = materialize(verified(rest.select("a", "b").distinct(), docs, first_doc, width, threshold, name_bits, clashes), "links")
        labels = joined_labels(labels, more)
        if rest.where("sure").join(more, ["a", "b"], "left_anti").isEmpty():
            break
        slack *= 4  # a pair taken to link did not: give more pairs for verification

    # the smallest doc_id of each component, by entity; entities without links stand alone
    groups = one.join(labels.withColumnRenamed("node", "entity"), "entity", "left").withColumn("root", F.coalesce("root", "entity"))
    least = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = groups.join(least, "root").select("entity", "component_id", "copies")
    linked = named.where("copies > 1").unionByName(named.where("copies = 1").join(labels.select(F.col("node").alias("entity")), "entity", "left_semi"))
    out = join_groups(rows.select("doc_id", "n_shingles", "entity"), linked, ["entity"], "copies", rows.count())
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, width: int = 5, threshold: int = 75) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component, with all their columns;
    of rows with one doc_id all stay or go, and those without doc_id stay."""
    gone = near_duplicates(docs, width, threshold).where("component_id != doc_id").select(F.col("doc_id").alias("_id")).distinct()
    gone = materialize(gone, "gone")
    sure, maybe = sorted_out(docs, [F.col("doc_id")], gone)
    return sure.unionByName(maybe.join(gone, F.col("doc_id") == F.col("_id"), "left_anti"))
