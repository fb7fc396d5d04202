"""SimHash near-duplicates: an inverted index on positional bytes, count filtering, exact verification, components.

Two 64-bit fingerprints within `distance` bits agree in at least 8 - `distance` of their bytes. The index is keyed by sets of byte positions
chosen so that any such agreement contains one of the sets; the wider the sets, the shorter the lists. Within a list the shared
positional bytes of every pair are tallied, pairs below the guaranteed minimum are dropped, and the rest are verified bit by bit.
Equal fingerprints are one entry from the start. Lists longer than `LIST` are cut into blocks, and each pair of blocks is one piece of
work; a piece returns a spanning forest of its links, not all pairs. No pair is left out.
Null and empty texts have fingerprint zero and link like any other. Rows with a null id belong to components but never name one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.batches import columns_of, fresh, identity, struct_column
from daybook.llm.graph import components
from daybook.runtime import durable

WORDS, DISTANCE, SEED = 4, 4, 42
#: Fingerprints in one block of a posting list.
LIST = 1024


def fingerprint(text: str | None, width: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text (A-Z lower-cased, words between ASCII white space), repeats included."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    view, hash_of = memoryview(joined), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(width, len(words))
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    hashes = np.array([hash_of(view[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashed = struct_column(lambda: lambda texts: [(signed(fingerprint(t)),) for t in texts], "fp long")
    return docs.select(F.col(id_col).alias("doc_id"), hashed(F.col(text_col)).alias("h")).select("doc_id", "h.fp")


def position_sets(width: int, distance: int = DISTANCE) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions such that every set of 8 - `distance` positions contains one of them.

    Either all sets inside a few groups of positions (one group must hold `width` of them), or a greedy cover if that is smaller.
    """
    least = 8 - distance
    if not 1 <= width <= least:
        raise ValueError(f"width {width} is not between 1 and {least}")
    if width == 1:
        return [(p,) for p in range(distance + 1)]
    n_groups = (least - 1) // (width - 1)
    grouped = [x for i in range(n_groups) for x in combinations(range(i, 8, n_groups), width)]
    open_sets, chosen = {frozenset(x) for x in combinations(range(8), least)}, []
    while open_sets:
        best = max(combinations(range(8), width), key=lambda x: sum(set(x) <= y for y in open_sets))
        chosen.append(best)
        open_sets = {y for y in open_sets if not set(best) <= y}
    return min(grouped, chosen, key=len)


def best_width(n: int, distance: int = DISTANCE) -> int:
    """Index width with the least expected work for n fingerprints: index rows, plus tallies at a hundredth of a row's price."""
    return min(range(1, 9 - distance), key=lambda w: len(position_sets(w, distance)) * n * (1 + n / 256**w / 100))


def _links(own: np.ndarray, distance: int, rows: int = 256) -> np.ndarray:
    """Adjacency of fingerprints: bytes tallied, the guaranteed minimum kept, bits verified."""
    near = np.zeros((len(own), len(own)), bool)
    for i in range(0, len(own), rows):
        mixed = own[i : i + rows, None] ^ own[None, :]
        shared = (mixed.view(np.uint8).reshape(*mixed.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
        at = np.nonzero(shared >= 8 - distance)
        near[i + at[0], at[1]] = np.bitwise_count(mixed[at]) <= distance
    return near


def _forest(own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smaller node of its component) among the linked fingerprints of one piece of work."""
    near = _links(own, distance)
    if int(near.sum()) == len(own):
        return own[:0], own[:0]
    label = np.arange(len(own))
    while True:
        lower = np.array([label[row].min() for row in near])
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    tied = label != np.arange(len(own))
    return own[tied], own[label[tied]]


def _linked(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for k in range(batch.num_rows):
                own = np.array(batch.column(0)[k].as_py() + (batch.column(1)[k].as_py() or []), np.int64).view(np.uint64)
                a, b = _forest(own, distance)
                left.append(a)
                right.append(b)
            if left:
                flat = [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)]
                yield pa.RecordBatch.from_arrays(flat, ["a", "b"])

    return run


def links(prints: DataFrame, distance: int = DISTANCE, width: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of `prints.fp` within `distance` bits of each other."""
    prints = prints.select("fp").distinct()
    sets = position_sets(width or best_width(prints.count(), distance), distance)
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = []
    for i, chosen in enumerate(sets):
        value = F.lit(i).cast("long")
        for p in chosen:
            value = value * 256 + byte(p)
        keys.append(value)
    index = prints.select(F.explode(F.array(*keys)).alias("key"), "fp")
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = durable(sizes.select("key", F.ceil(F.col("n") / LIST).alias("blocks")))
    listed = index.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    listed = listed.groupBy("key", "block", "blocks").agg(F.sort_array(F.collect_list("fp")).alias("list"))
    one = listed.where((F.col("blocks") == 1) & (F.size("list") > 1)).select("list", F.lit(None).cast("array<long>").alias("other"))
    long = durable(listed.where("blocks > 1"))
    far = long.select(F.col("key").alias("k"), F.col("block").alias("b"), F.col("list").alias("other"))
    met = long.join(far, (F.col("key") == F.col("k")) & (F.col("block") < F.col("b"))).select("list", "other")
    work = one.unionByName(met).unionByName(long.select("list", F.lit(None).cast("array<long>").alias("other")))
    return work.mapInArrow(_linked(distance), "a long, b long").distinct()


def rooted(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) for each distinct fingerprint of `rows`: components share the root."""
    roots = components(links(rows, distance))
    prints = rows.select("fp").distinct()
    return prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id that it reaches)."""
    rows = durable(fingerprints(docs, id_col, text_col))
    tied = durable(rooted(rows, distance))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    names = tied.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    names = durable(tied.join(names, "root").select(F.col("fp").alias("_fp"), "component_id"))
    return rows.join(names, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One document of each component, with all its columns: the one with the lowest id (a null id comes last).

    Rows that share id and text are one document; of several texts under the lowest id, that with the lowest digest stays.
    """
    key, mark, number = (fresh(docs.columns, x) for x in ("_id", "_mark", "_number"))
    text = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))
    signed = fingerprints(docs.withColumn(mark, F.struct(F.col(id_col).alias("id"), text.alias("mark"))), mark, text_col)
    rows = durable(signed.select("doc_id.*", "fp"))
    tied = durable(rooted(rows, distance))
    best = F.min(F.struct(F.isnull("id").alias("none"), "id", "mark"))
    first = rows.groupBy("fp").agg(best.alias("best")).join(tied, "fp").groupBy("root").agg(F.min("best").alias("best"))
    first = durable(first.select(F.col("best.id").alias("id"), F.col("best.mark").alias(mark)).select(identity("id").alias(key), mark))
    # Join and row number use the same two columns, so the texts are shuffled once.
    kept = docs.withColumns({key: identity(id_col), mark: text}).join(first, [key, mark], "left_semi")
    same = Window.partitionBy(key, mark).orderBy(mark)
    return kept.withColumn(number, F.row_number().over(same)).where(F.col(number) == 1).select(*columns_of(docs))
