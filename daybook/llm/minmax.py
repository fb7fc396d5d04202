"""MinHash near-duplicates by min-max hashing: smallest and largest hash under each permutation, banding, exact sets, components.

A document's set holds its distinct shingles of `WORDS` words (A-Z lower-cased, words between ASCII white space; a text of fewer words is one
shingle) as 64-bit hashes. Each of `PERMUTATIONS` gives two signature values from one evaluation, the minimum and the maximum, both of which
agree with the probability of the sets' similarity. Signatures are cut into bands of `BAND` values; sets that agree in a band are candidates. At
the similarity of 0.85 a pair is missed with probability (1 - 0.85**5)**30, below 3 in a hundred million. Every link is confirmed on full sets.

Equal sets are one class from the start, so copies cost nothing later. In a band's bucket each class is first compared with one of them only.
What that leaves apart is compared within the bucket, in blocks of bounded size and without emitting pairs: a block sends on the classes with a
possible partner, then, with their sets, a spanning forest of the confirmed links between components. Each pair is compared under the first band
in which it agrees. So no link is lost, and a large group of near copies yields rows in proportion to its size.

Null texts, empty ones and those without words have an empty set and link with nothing. Rows with a null id belong to components but never name
one, and are not kept. Equal rows are equal in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.batches import identity, slices
from daybook.llm.graph import components
from daybook.runtime import durable, scratch

WORDS, SHARE = 3, 85
PERMUTATIONS, BAND = 75, 5
BANDS = 2 * PERMUTATIONS // BAND
#: Of the signature's bytes, so many agree in a linked pair but for one pair in a billion (six deviations below the mean).
AGREE = 100
#: Classes and hashes in one block of a bucket; word hashes that a task remembers; buckets of the broadcast set that thins texts out.
LIST, BLOCK_HASHES, REMEMBERED, FETCH_BUCKETS = 1024, 1 << 20, 1 << 20, 1 << 20

ODD = np.array([xxhash.xxh3_64_intdigest(f"permutation {i}") | 1 for i in range(PERMUTATIONS)], np.uint64)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of a word, remembered; forgets all once it holds very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    made = np.full(len(own) - k + 1, k, np.uint64)
    for i in range(k):
        made = mixed(made + own[i : len(own) - k + 1 + i])
    return np.unique(made)


def signature(shingles: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Minimum and maximum of the set under each permutation: all minima, then all maxima."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), columns):
        moved = ODD[:, None] * shingles[None, at : at + columns]
        np.minimum(low, moved.min(axis=1), out=low)
        np.maximum(high, moved.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key per band; the band's number is part of it."""
    parts = values.reshape(BANDS, BAND)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(BAND):
        key = mixed(key + parts[:, i])
    return key.view(np.int64)


def sketch(values: np.ndarray) -> bytes:
    """One byte of each signature value."""
    return (mixed(values) >> np.uint64(56)).astype(np.uint8).tobytes()


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            done = 0
            for texts in slices(batch.column(2)):
                rows = []
                for text in texts:
                    own = shingle_set(text, hashes, width)
                    if len(own):
                        values = signature(own)
                        rows.append((xxhash.xxh3_128_digest(own.tobytes()), len(own), band_keys(values), sketch(values)))
                    else:
                        rows.append((None, 0, None, None))
                cls, size, bands, bytes_ = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(texts)), batch.column(1).slice(done, len(texts)), pa.array(cls, pa.binary()), pa.array(size, pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_, pa.binary()),
                    ],
                    ["id", "print", "cls", "size", "bands", "sketch"],
                )
                done += len(texts)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1)):
                sets = [shingle_set(t, hashes, width).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(sets, pa.binary())], ["cls", "set"])
                done += len(texts)

    return run


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows from a table written in the shared folder; compressed, unlike a checkpoint."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- confirming pairs -----------------------------------------------------------------------------


def alike(a: int, b: int, shared: int, share: int) -> bool:
    return 100 * shared >= share * (a + b - shared)


def _numbers(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted arrays of distinct numbers."""
    both = np.concatenate([a, b])
    both.sort(kind="mergesort")
    return int((both[1:] == both[:-1]).sum())


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, a_sketch, b_sketch), the pairs whose sketches agree often enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS) for k in (2, 3))
        keep = pa.array((a == b).sum(axis=1) >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)


def _confirmed(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _numbers(a.as_py()), _numbers(b.as_py())
                keep.append(alike(len(x), len(y), _shared(x, y), share))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with a column of either class."""
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("cls").alias(side), F.col(column).alias(f"{side}_{column}")), side)
    return pairs.select("a", "b", f"a_{column}", f"b_{column}")


class Block:
    """The classes of one block, or of two blocks of which only pairs across count."""

    def __init__(self, key: int, own: list[dict], other: list[dict] | None):
        self.key, self.classes, self.cut = key, own + (other or []), len(own) if other else None
        self.size = np.array([c["size"] for c in self.classes], np.int64)
        self.bands = np.array([c["bands"] for c in self.classes], np.int64)
        self.bytes = np.frombuffer(b"".join(c["sketch"] for c in self.classes), np.uint8).reshape(len(self.classes), -1)
        self.names, self.root = np.unique([c["root"] for c in self.classes], return_inverse=True)

    def possible(self, share: int, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers (a, b) of classes of different components that may link and have this bucket's band as their first common one; their agreement."""
        n = len(self.classes)
        for at in range(0, self.cut or n, rows):
            upto = min(at + rows, self.cut or n)
            first = self.cut or at
            agree = (self.bytes[at:upto, None] == self.bytes[None, first:]).sum(axis=2, dtype=np.int32)
            low, high = np.minimum.outer(self.size[at:upto], self.size[first:]), np.maximum.outer(self.size[at:upto], self.size[first:])
            apart = self.root[at:upto, None] != self.root[None, first:]
            a, b = np.nonzero((agree >= AGREE) & (100 * low >= share * high) & apart)
            a, b, agree = a + at, b + first, agree[a, b]
            later = a < b
            a, b, agree = a[later], b[later], agree[later]
            met = self.bands[a] == self.bands[b]
            here = self.bands[a, met.argmax(axis=1)] == self.key
            yield a[here], b[here], agree[here]


def _flagged(share: int):
    """Classes of a bucket that have a possible partner in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own, other = (batch.column(k) for k in range(3))
            for k in range(batch.num_rows):
                block = Block(keys[k].as_py(), own[k].as_py(), other[k].as_py())
                found = np.unique(np.concatenate([np.concatenate([a, b]) for a, b, _ in block.possible(share)] or [np.zeros(0, np.int64)]))
                if len(found):
                    at = [block.classes[i] for i in found.tolist()]
                    yield pa.RecordBatch.from_pydict({"key": pa.array([block.key] * len(at), pa.int64()), "cls": pa.array([c["cls"] for c in at], pa.binary())})

    return run


def _joined(share: int):
    """Confirmed links between components of a bucket's classes: a spanning forest, likely links first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own, other = (batch.column(k) for k in range(3))
            for k in range(batch.num_rows):
                block = Block(keys[k].as_py(), own[k].as_py(), other[k].as_py())
                sets = [_numbers(c["set"]) for c in block.classes]
                found = list(block.possible(share))
                if not found:
                    continue
                a, b, agree = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(-agree, kind="stable")
                head = list(range(len(block.names)))

                def find(x: int, head=head) -> int:
                    while head[x] != x:
                        head[x] = head[head[x]]
                        x = head[x]
                    return x

                links = []
                for i, j in zip(a[order].tolist(), b[order].tolist()):
                    u, v = find(int(block.root[i])), find(int(block.root[j]))
                    if u != v and alike(len(sets[i]), len(sets[j]), _shared(sets[i], sets[j]), share):
                        head[u] = v
                        links.append((block.classes[i]["cls"], block.classes[j]["cls"]))
                if links:
                    left, right = zip(*links)
                    yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return run


def _blocks(rows: DataFrame, columns: list[str], weight: int | None = None) -> DataFrame:
    """(key, own, other): the classes of each bucket in blocks, alone and, where a bucket has several, with each later block."""
    need = F.ceil(F.count("*") / LIST)
    if weight:
        need = F.greatest(need, F.ceil(F.sum("size") / weight))
    blocks = durable(rows.groupBy("key").agg(need.alias("blocks"), F.count("*").alias("n")).where("n > 1").select("key", "blocks"))
    at = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    lists = at.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct(*columns)).alias("own"))
    lists = stored(lists, "blocks")
    none = F.lit(None).cast(lists.schema["own"].dataType)
    far = lists.where("blocks > 1").select(F.col("key").alias("_key"), F.col("block").alias("_block"), F.col("own").alias("other"))
    across = lists.where("blocks > 1").join(far, (F.col("key") == F.col("_key")) & (F.col("block") < F.col("_block"))).select("key", "own", "other")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Blocks are few rows with much work each.
    return lists.where(F.size("own") > 1).select("key", "own", none.alias("other")).unionByName(across).repartition(parts, F.rand(7))


# -- the operator -----------------------------------------------------------------------------------


def class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int = WORDS) -> DataFrame:
    """(cls, set) of the wanted classes, from one document each. `docs` has key, print and text; only texts of wanted documents are shuffled."""
    chosen = durable(classes.join(wanted, "cls", "left_semi").select("cls", F.col("rep.key").alias("key"), F.col("rep.print").alias("print")))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FETCH_BUCKETS))
    # Numbers of hash buckets, a million at most whatever the data; the exact join follows.
    few = F.broadcast(chosen.select(bucket("print").alias("_bucket")).distinct())
    texts = docs.join(few, bucket("print") == F.col("_bucket"), "left_semi")
    texts = texts.groupBy("key", "print").agg(F.first("text").alias("text"))
    return texts.join(chosen, ["key", "print"]).select("cls", "text").mapInArrow(_sets(width), "cls binary, set binary")


def class_roots(docs: DataFrame, classes: DataFrame, share: int = SHARE, width: int = WORDS) -> DataFrame:
    """(cls, root) for every class that links with another: components share the root."""
    spark = docs.sparkSession
    banded = classes.select("cls", "size", F.explode("bands").alias("key"))
    pivots = banded.groupBy("key").agg(F.min(F.struct("cls", "size")).alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = stored(banded.join(stored(pivots, "pivots"), "key"), "met")
    # First round: every class of a bucket against the bucket's first one.
    far = F.greatest("size", "pivot.size") * share <= F.least("size", "pivot.size") * 100
    pairs = met.where((F.col("cls") != F.col("pivot.cls")) & far).select(F.col("cls").alias("a"), F.col("pivot.cls").alias("b")).distinct()
    pairs = durable(_with(pairs, classes, "sketch").mapInArrow(_near, "a binary, b binary"))
    sets = stored(class_sets(docs, classes, met.select("cls").distinct(), width), "sets")
    links = stored(_with(pairs, sets, "set").mapInArrow(_confirmed(share), "a binary, b binary"), "links")
    roots = durable(components(links))
    # Second round: buckets whose classes are not all in one component.
    tied = met.select("key", "cls", "size").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    tied = stored(tied, "tied")
    several = tied.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    rows = tied.join(several, "key", "left_semi").join(classes.select("cls", "bands", "sketch"), "cls")
    columns = ["cls", "root", "size", "bands", "sketch"]
    flags = durable(_blocks(rows, columns).mapInArrow(_flagged(share), "key long, cls binary").distinct())
    if flags.isEmpty():
        return roots.withColumnRenamed("node", "cls")
    rows = tied.join(flags, ["key", "cls"], "left_semi").join(classes.select("cls", "bands", "sketch"), "cls").join(sets, "cls")
    more = _blocks(rows, [*columns, "set"], BLOCK_HASHES).mapInArrow(_joined(share), "a binary, b binary").distinct()
    more = stored(more, "more")
    if not more.isEmpty():
        # Components of the first round stand for their classes.
        roots = durable(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    return roots.withColumnRenamed("node", "cls")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, width: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id that it reaches), kept."""
    if not 80 <= share <= 100:
        raise ValueError("share must be 80 to 100; the bands are laid out for that")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_signed(width), f"id {kind}, print long, cls binary, size long, bands array<long>, sketch binary")
    signed = stored(made, "signed")
    rep = F.struct(identity("id").alias("key"), "print")
    facts = [F.min("id").alias("least"), F.min(rep).alias("rep"), *(F.first(c).alias(c) for c in ("size", "bands", "sketch"))]
    classes = stored(signed.where("cls IS NOT NULL").groupBy("cls").agg(*facts), "classes")
    texts = rows.select(identity("id").alias("key"), "print", "text")
    roots = class_roots(texts, classes, share, width)
    tied = stored(classes.select("cls", "least").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "tied")
    names = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    names = stored(tied.join(names, "root").select("cls", "component_id"), "names")
    out = signed.select("id", "cls", "size").join(names, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )
