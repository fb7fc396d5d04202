"""Benchmark decontamination with suffix arrays over the training texts.

Documents are read in shards (runs of an Arrow batch). The word sequence of a shard gets a suffix array; every suffix of every benchmark item is
looked up by binary search, which gives the places where its window stands verbatim. Places and the items found there are then sorted
together once more, which gives the longest match. A place of the shard whose word is in no item cannot be part of a match, so only stretches of
benchmark words enter the array.

Items of equal words are merged before anything else. A block of items is one flat array of word numbers with offsets, so its memory
grows with its words, however long an item is. Items travel to the documents in blocks of bounded size. With one block the verdict is a column
and documents are not shuffled; with more, each block is one pass that writes the texts it hits, keyed by a digest, and blocks follow one
another, so that one block at a time is in memory. Null texts have no words; an item without words matches nothing; equal items are searched
once and all named. A null item id is named `null`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.batches import columns_of, fresh, struct_column
from daybook.runtime import durable, scratch

WINDOW = 13
#: Bytes of benchmark text in one block, which the driver holds and every worker receives. A longer item is a block of its own.
BLOCK_BYTES = 16 << 20
#: Windows that are searched together.
SEARCH = 1 << 16

# Bytes that belong to words are digits, letters (A-Z as a-z) and everything beyond ASCII; others separate.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TABLE).split()


class _Known(dict):
    """Numbers of benchmark words; other words are 0."""

    def __missing__(self, key):
        return 0


def _doubled(rank: np.ndarray, reach: int) -> np.ndarray:
    """Ranks over twice `reach` values from the ranks over `reach`."""
    ahead = np.zeros(len(rank), np.int64)
    ahead[: max(0, len(rank) - reach)] = rank[reach:] + 1
    return np.unique(rank.astype(np.int64) * (len(rank) + 2) + ahead, return_inverse=True)[1]


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of their suffixes, compared over at least `depth` values (prefix doubling)."""
    _, rank = np.unique(ids, return_inverse=True)
    reach = 1
    while reach < depth and rank.max(initial=0) + 1 < len(rank):
        rank = _doubled(rank, reach)
        reach *= 2
    return np.argsort(rank, kind="stable")


def longest_matches(part: np.ndarray, places: np.ndarray, items: np.ndarray) -> np.ndarray:
    """For each place of `part` the longest run of values from there on that stands in `items`; zeros match nothing.

    Both sequences are sorted together. The item suffixes next to a place in that order share the most with it; ranks over 1, 2, 4, ...
    values tell how much.
    """
    both = np.concatenate([part, [0], items, [0]])
    ends = both == 0
    both = np.where(ends, -np.cumsum(ends), both)  # no end equals another, so nothing matches across it
    levels = [np.unique(both, return_inverse=True)[1]]
    while levels[-1].max() + 1 < len(both):
        levels.append(_doubled(levels[-1], 1 << (len(levels) - 1)))
    order = np.argsort(levels[-1])
    at = levels[-1][places]
    own = order > len(part)
    slots = np.arange(len(order))
    before = np.maximum.accumulate(np.where(own, slots, -1))[at]
    behind = np.minimum.accumulate(np.where(own, slots, len(order))[::-1])[::-1][at]
    best = np.zeros(len(places), np.int64)
    for other, there in ((before, before >= 0), (behind, behind < len(order))):
        a, b = places.copy(), order[np.clip(other, 0, len(order) - 1)]
        shared = np.zeros(len(places), np.int64)
        for step in range(len(levels) - 1, -1, -1):
            same = levels[step][a] == levels[step][b]
            shared += same * (1 << step)
            a, b = (np.minimum(x + same * (1 << step), len(both) - 1) for x in (a, b))
        best = np.maximum(best, np.where(there, shared, 0))
    return best


class Items:
    """Benchmark items of one block, each with its names, ready to be searched for.

    `flat` holds the word numbers of all items with a zero behind each. Per width of window: start of each distinct window in `flat`, and
    the items that hold it.
    """

    def __init__(self, items: list[tuple[list[str], str]], window: int = WINDOW):
        self.window = window
        self.names = [names for names, _ in items]
        self.known = _Known()
        sizes, numbers = [], []
        for _, text in items:
            words = words_of(text)
            for w in words:
                self.known.setdefault(w, len(self.known) + 1)
            sizes.append(len(words))
            numbers.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
            numbers.append(np.zeros(1, np.int64))
        self.sizes = np.array(sizes, np.int64)
        self.flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.shortest = int(min(self.sizes.min(), window)) if len(self.sizes) else 0
        # Windows by width: start in flat, and the items of each in slices of one array.
        self.tests: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in np.unique(self.sizes[self.sizes < window]).tolist():
            which = np.nonzero(self.sizes == width)[0]  # an item of fewer words is a window itself
            self.tests[width] = (self.starts[which], np.arange(len(which) + 1), which)
        long = np.nonzero(self.sizes >= window)[0]
        if len(long):
            self.tests[window] = self.windows(long)

    def windows(self, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows of the items: two overlapping runs of a power of two words, ranked, name one exactly."""
        counts = self.sizes[long] - self.window + 1
        item = np.repeat(long, counts)
        start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.starts[long], counts)
        rank, reach = np.unique(self.flat, return_inverse=True)[1], 1
        while 2 * reach <= self.window:
            rank, reach = _doubled(rank, reach), 2 * reach
        pair = rank[start].astype(np.int64) * (len(rank) + 1) + rank[start + self.window - reach]
        _, first, number = np.unique(pair, return_index=True, return_inverse=True)
        held = np.unique(np.stack([number, item]), axis=1) if len(long) > 1 else np.stack([np.arange(len(first)), np.repeat(long, len(first))])
        return start[first], np.searchsorted(held[0], np.arange(len(first) + 1)), held[1]

    def shard(self, texts: list) -> list[tuple]:
        """(words, disjoint hit spans, names of items, words of the longest match, its place) for each text."""
        own = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        starts = np.cumsum(sizes + 1) - sizes - 1
        out = [(int(n), [], [], 0, None) for n in sizes]
        if not self.tests or not sizes.any():
            return out
        ids = np.zeros(int(sizes.sum()) + len(own), np.int64)
        for at, words in zip(starts.tolist(), own, strict=True):
            ids[at : at + len(words)] = list(map(self.known.__getitem__, words))
        # Stretches of known words that are long enough, each with the unknown word (or text end) behind it.
        known = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
        turn = np.diff(known)
        begin, end = np.nonzero(turn == 1)[0], np.nonzero(turn == -1)[0]
        use = end - begin >= self.shortest
        begin, end = begin[use], end[use]
        if not len(begin):
            return out
        lengths = end - begin + 1
        tails = np.cumsum(lengths) - 1
        place = np.arange(int(lengths.sum())) + np.repeat(begin - (tails + 1 - lengths), lengths)
        part = ids[np.minimum(place, len(ids) - 1)]
        part[tails] = 0
        order = suffix_array(part, self.window)
        at, width, window = self.search(part, order)
        if not len(at):
            return out
        length = width.copy()
        full = width == self.window
        if full.any():
            length[full] = self.extend(part, tails, at[full], window[full])
        text = np.searchsorted(starts, place[at], side="right") - 1
        local = place[at] - starts[text]
        by_text = np.lexsort((local, text))
        cuts = np.nonzero(np.diff(text[by_text]))[0] + 1
        for rows in np.split(by_text, cuts):
            t = int(text[rows[0]])
            low, high = local[rows], np.maximum.accumulate(local[rows] + width[rows])
            new = np.concatenate([[True], low[1:] > high[:-1]])
            last = np.concatenate([new[1:], [True]])
            spans = [{"low": a, "high": b} for a, b in zip(low[new].tolist(), high[last].tolist(), strict=True)]
            best = rows[np.argmax(length[rows])]
            out[t] = (int(sizes[t]), spans, self.named(width[rows], window[rows]), int(length[best]), int(local[best]))
        return out

    def search(self, part: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of `part` where a window stands, with its width and number; a place has one window of a width at most."""
        found = [(np.zeros(0, np.int64),) * 3]
        for width, (begin, _, _) in self.tests.items():
            for base in range(0, len(begin), SEARCH):
                tests = self.flat[begin[base : base + SEARCH, None] + np.arange(width)]
                low, high = self.bound(part, order, tests, False), self.bound(part, order, tests, True)
                rows = np.nonzero(high > low)[0]
                count = (high - low)[rows]
                slots = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[rows], count)
                found.append((order[slots], np.full(len(slots), width), np.repeat(rows + base, count)))
        at, width, window = map(np.concatenate, zip(*found, strict=True))
        return at, width, window

    def extend(self, part: np.ndarray, tails: np.ndarray, at: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Words of the longest match at each place where a full window stands; only the stretches and items found take part."""
        stretch = np.searchsorted(tails, at)
        used = np.unique(stretch)
        begin = np.concatenate([[0], tails[:-1] + 1])[used]
        size = tails[used] - begin + 1
        shift = begin - (np.cumsum(size) - size)
        near = part[np.arange(int(size.sum())) + np.repeat(shift, size)]
        _, offsets, holders = self.tests[self.window]
        items = np.unique(np.concatenate([holders[offsets[w] : offsets[w + 1]] for w in np.unique(window)]))
        texts = np.concatenate([self.flat[self.starts[k] : self.starts[k] + self.sizes[k] + 1] for k in items])
        return longest_matches(near, at - shift[np.searchsorted(used, stretch)], texts)

    def named(self, width: np.ndarray, window: np.ndarray) -> list[str]:
        names = set()
        for w in np.unique(width).tolist():
            _, offsets, holders = self.tests[w]
            held = [holders[offsets[x] : offsets[x + 1]] for x in np.unique(window[width == w])]
            for k in np.unique(np.concatenate(held)):
                names.update(self.names[k])
        return sorted(names)

    @staticmethod
    def bound(part: np.ndarray, order: np.ndarray, tests: np.ndarray, above: bool) -> np.ndarray:
        """For each test the first place in the suffix order that is not below it (or, `above`, that is above it)."""
        width = tests.shape[1]
        padded = np.concatenate([part, np.zeros(width, np.int64)])
        low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(order), np.int64)
        while (open_rows := low < high).any():
            middle = (low + high) // 2
            at = order[np.minimum(middle, len(order) - 1)]
            there = padded[at[:, None] + np.arange(width)]
            differ = there != tests
            first = differ.argmax(axis=1)
            rows = np.arange(len(tests))
            below = np.where(differ.any(axis=1), there[rows, first] < tests[rows, first], above)
            low = np.where(open_rows & below, middle + 1, low)
            high = np.where(open_rows & ~below, middle, high)
        return low


FOUND = "n_words long, spans array<struct<low:long,high:long>>, items array<string>, longest long, place long"


def distinct_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """One row per sequence of words: names (sorted), words (lower case, one space between). Items without words are left out."""
    upper, lower = (bytes(range(first, first + 26)).decode() for first in (0x41, 0x61))
    words = F.trim(F.regexp_replace(F.translate(F.col(text_col), upper, lower), SEPARATORS, " "))
    name = F.coalesce(F.col(item_col).cast("string"), F.lit("null"))
    named = benchmark.select(words.alias("words"), name.alias("name")).where("words <> ''")
    return named.groupBy("words").agg(F.array_sort(F.collect_set("name")).alias("names"))


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[list[str], str]]]]:
    """How many blocks there are, and the items of one after another; a block is about `block_bytes` bytes or one longer item."""
    rows = durable(distinct_items(benchmark, item_col, text_col))
    total = rows.agg(F.sum(F.octet_length("words") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))

    def read():
        for k in range(n):
            part = rows.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k) if n > 1 else rows
            yield [(r.names, r.words) for r in part.collect()]

    return n, read()


def verdict(n_words: Column, spans: Column, items: Column, longest: Column) -> dict[str, Column]:
    """Columns n_words, n_hit, n_items, items_sha256, contaminated, longest from what all blocks found."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    added = F.aggregate(
        F.array_sort(spans), start,
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["high"]).alias("end"),
            (acc["hit"] + F.greatest(F.lit(0).cast("long"), x["high"] - F.greatest(acc["end"], x["low"]))).alias("hit"),
        ),
        lambda acc: acc["hit"],
    )
    names = F.array_sort(F.array_distinct(items))
    return {
        "n_words": n_words, "n_hit": added, "n_items": F.size(names).cast("long"), "items_sha256": F.sha2(F.array_join(names, ","), 256),
        "contaminated": (added > 0) & (20 * added >= n_words), "longest": longest,
    }


def judged(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, dict[str, Column]]:
    """The documents with a struct column of what the blocks found, and the verdict's columns over it."""
    context = docs.sparkSession.sparkContext
    n, parts = blocks(benchmark, item_col, item_text_col, block_bytes)
    text, found = F.col(f"`{text_col}`"), fresh(docs.columns, "_found")
    part_of = lambda name: F.col(f"{found}.{name}")
    if n == 1:
        shared = context.broadcast(Items(next(parts), window))
        rows = docs.withColumn(found, struct_column(lambda: shared.value.shard, FOUND)(text))
        return rows, verdict(part_of("n_words"), part_of("spans"), part_of("items"), part_of("longest"))
    key = F.md5(text)
    folder = scratch(docs.sparkSession, "benchmark-hits")
    for k, items in enumerate(parts):
        shared = context.broadcast(Items(items, window))
        hits = docs.select(text.alias("text")).withColumn("found", struct_column(lambda shared=shared: shared.value.shard, FOUND)(F.col("text")))
        hits = hits.where(F.size("found.spans") > 0).select(F.md5("text").alias("key"), "found.spans", "found.items", "found.longest")
        hits.dropDuplicates(["key"]).write.parquet(f"{folder}/block={k}")
        shared.destroy()
    own = fresh(docs.columns, "_key")
    merged = docs.sparkSession.read.parquet(folder).groupBy(F.col("key").alias(own)).agg(
        F.struct(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.max("longest").alias("longest")).alias(found)
    )
    rows = docs.join(merged, key == F.col(own), "left").drop(own)
    n_words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    none = [F.array().cast(kind) for kind in ("array<struct<low:long,high:long>>", "array<string>")]
    return rows, verdict(
        n_words, F.coalesce(part_of("spans"), none[0]), F.coalesce(part_of("items"), none[1]), F.coalesce(part_of("longest"), F.lit(0).cast("long"))
    )


def check_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: counts of words, hit words and items, their digest, the verdict, the longest match."""
    rows, columns = judged(docs, benchmark, **options)
    return rows.select(F.col(id_col).alias("doc_id"), *(c.alias(n) for n, c in columns.items()))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, all columns as they were."""
    rows, columns = judged(docs, benchmark, **options)
    return rows.where(~columns["contaminated"]).select(*columns_of(docs))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS MATERIALIZED (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS MATERIALIZED (SELECT item_id, n, p AS s, array_to_string(ws[p:p + n - 1], ' ') AS win
       FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, sizes WHERE len(ws) >= n)),
hit AS MATERIALIZED (SELECT doc_id, item_id, p, s, dw.n FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id),
-- Windows that follow each other in the document and in the item make one longer match.
runs AS (SELECT doc_id, n, p - row_number() OVER (PARTITION BY doc_id, item_id, n, p - s ORDER BY p) AS run, item_id, p - s AS diagonal FROM hit),
ext AS (SELECT doc_id, max(longest) AS longest FROM (SELECT doc_id, count(*) + n - 1 AS longest FROM runs GROUP BY doc_id, item_id, n, diagonal, run) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
       coalesce(longest, 0)::BIGINT AS longest
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN ext USING (doc_id)
"""
