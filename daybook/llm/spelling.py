"""Spelling variant groups: words one edit apart, found by scanning sorted word lists with reused rows of banded edit matrices.

A list of words is sorted by code points. A query's edit matrix against a list word has one row per character of that word; neighbours in the
list share the rows of their common prefix, so a scan keeps a stack of rows and goes back to the depth of the adjacent LCP. Only three cells
around the diagonal matter for one edit. Where all three exceed one edit, every word with that prefix is skipped in one step.

So that no task needs the whole vocabulary, words are dealt to lists by what an edit leaves alone. The edit between two words stands at the
position of their first difference; if that lies in the window [lo, hi) of positions of the shorter word, both share the `lo` characters before
and those behind. A word goes to the lists of its own length and, as the longer one, of one character less, first for two windows. A list of more
than `LIST` words is dealt again with its windows halved, down to windows of one position, which hold few words by their nature (at most a for
one length and a * a for the other, in an alphabet of a letters). Every pair belongs to exactly one list, so lists send counts and their best
partner per word, never pairs.

Words are runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased. Null and empty texts have none; a null id reads as `null` in the rule
that drops a character from some occurrences. Rows that share an id count each on their own. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.batches import slices
from daybook.runtime import durable, scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, DROP = 5, 3, 97
#: A word's form is at least so many times as frequent.
RATIO = 2
#: Words of one list that a query scans; distinct words that a task counts before it sends them on.
LIST, HELD = 128, 200_000
LAST = "\U0010ffff"


# -- words and their counts -----------------------------------------------------------------------


def words_of(key: str, text: str | None, drop: int = DROP) -> Counter:
    """Words of one text with their counts. If `drop` divides crc32 of key:run, the run loses its character number crc32 % length."""
    found = Counter(RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    start, out = zlib.crc32(f"{key}:".encode()), Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode("utf-8"), start)
        if h % drop == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def _counted(least_length: int, drop: int):
    def sent(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for texts in slices(batch.column(1)):
                for text in texts:
                    for word, n in words_of(next(keys), text, drop).items():
                        if len(word) >= least_length:
                            held[word] += n
                    if len(held) >= HELD:
                        yield sent(held)
                        held = Counter()
        yield sent(held)

    return run


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop: int = DROP
) -> DataFrame:
    """(word, n): words long and frequent enough. Tasks count their own words before anything is shuffled."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    parts = docs.select(key.alias("key"), F.col(text_col).alias("text")).mapInArrow(_counted(least_length, drop), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- scanning one sorted list -----------------------------------------------------------------------


def near_words(query: str, words: list[str], lcps: list[int]) -> Iterator[int]:
    """Numbers of the words exactly one edit from the query, by a scan of the sorted list; lcps[j] is the prefix that words j - 1 and j share.

    rows[d] holds the matrix cells of the first d characters against the query's first d - 1, d and d + 1, with 2 standing for more than one.
    """
    n, rows, j, depth = len(query), [(2, 0, 1)], 0, 0
    while j < len(words):
        word = words[j]
        depth = min(depth, lcps[j]) if j else 0
        del rows[depth + 1 :]
        alive = True
        for d in range(depth, len(word)):
            left, here, right = rows[d]
            c = word[d]
            # Cells of row d + 1 stand under the query's columns d, d + 1 and d + 2.
            below = min(left + (d < 1 or d > n or query[d - 1] != c), here + 1) if d else 1
            level = min(here + (d >= n or query[d] != c), right + 1, below + 1)
            ahead = min(right + (d + 1 >= n or query[d + 1] != c), level + 1)
            rows.append((min(below, 2), min(level, 2), min(ahead, 2)))
            if below > 1 and level > 1 and ahead > 1:
                # No word that goes on from this prefix is near; the sorted list holds them side by side.
                j = bisect_left(words, word[: d + 1] + LAST, j + 1)
                depth, alive = d + 1, False
                break
        if alive:
            depth = len(word)
            side = n - depth + 1
            if 0 <= side <= 2 and rows[depth][side] == 1:
                yield j
            j += 1


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def scan_list(words: list[str], counts: list[int], length: int, low: int, high: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, largest count among them, that word) for pairs of this list: one word of `length`, first difference in [low, high)."""
    order = sorted(range(len(words)), key=words.__getitem__)
    words, counts = [words[i] for i in order], [counts[i] for i in order]
    lcps = [0, *(common(a, b) for a, b in zip(words, words[1:]))]
    number, best = [0] * len(words), [(0, "")] * len(words)

    def add(at: int, other: int) -> None:
        number[at] += 1
        best[at] = min(best[at], (-counts[other], words[other]))

    for i, query in enumerate(words):
        if len(query) != length:
            continue
        for j in near_words(query, words, lcps):
            # A pair of equal lengths is met from both ends, one of different lengths from the shorter.
            if low <= common(query, words[j]) < high:
                add(i, j)
                if len(words[j]) != length:
                    add(j, i)
    return ((w, k, -b[0], b[1]) for w, k, b in zip(words, number, best) if k)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, low, high, lists = (batch.column(k).to_pylist() for k in range(4))
        rows = list(chain.from_iterable(
            scan_list([x["word"] for x in one], [x["n"] for x in one], length[k], low[k], high[k]) for k, one in enumerate(lists)
        ))
        if rows:
            word, near, form_n, form = zip(*rows)
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(word, pa.string()), "near": pa.array(near, pa.int64()), "m": pa.array(form_n, pa.int64()), "form": pa.array(form, pa.string())}
            )


# -- dealing words to lists ---------------------------------------------------------------------------


def _listed(words: DataFrame, windows: Column) -> DataFrame:
    """(length, low, high, key, word, n) for each of the windows of a word: key digests what stands outside the window."""
    rows = words.select("word", "n", F.explode(windows).alias("w")).select("word", "n", "w.*")
    behind = F.greatest(F.lit(0), F.col("length") - F.col("high"))
    before = F.substring("word", F.lit(1), F.col("low"))
    after = F.substring("word", F.length("word") - behind + 1, behind)
    return rows.select("length", "low", "high", F.xxhash64("length", "low", "high", before, after).alias("key"), "word", "n")


def _window(length: Column, low: Column, high: Column) -> Column:
    return F.struct(length.cast("int").alias("length"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def dealt(words: DataFrame, most: int = LIST) -> DataFrame:
    """All words in lists of at most about `most` words; see above. Positions run from 0 to the length, where a character may be added."""
    spark, n = words.sparkSession, F.length("word")
    halves = lambda m: (_window(m, F.lit(0), F.floor(m / 2)), _window(m, F.floor(m / 2), m + 1))
    rows, done = _listed(words, F.array(*halves(n), *halves(n - 1))).where("length > 0 AND high > low"), None
    lists = ["length", "low", "high", "key"]
    while True:
        path = scratch(spark, "lists")
        rows.write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
        large = durable(rows.groupBy(*lists).agg(F.count("*").alias("_size")).where((F.col("_size") > most) & (F.col("high") - F.col("low") > 1)).drop("_size"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, lists, "left_anti")
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        parts = F.array(_window(F.col("length"), F.col("low"), middle), _window(F.col("length"), middle, F.col("high")))
        split = rows.join(large, lists, "left_semi").select("word", "n", parts.alias("_parts"))
        rows = _listed(split, F.col("_parts"))


def near_counts(words: DataFrame, most: int = LIST) -> DataFrame:
    """(word, n_near, form_n, form): how many words are one edit away, and the most frequent of them (ties: the first in code-point order)."""
    # Lists are short in bytes and long in work: a number of tasks that Spark does not cut down to a few.
    parts, lists = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["length", "low", "high", "key"]
    lists = dealt(words, most).repartition(parts, *lists).groupBy(*lists).agg(F.collect_list(F.struct("word", "n")).alias("list")).where(F.size("list") > 1)
    found = lists.select("length", "low", "high", "list").mapInArrow(_scanned, "word string, near long, m long, form string")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where a chain of `forms` (word, form) ends. Each round doubles the steps taken; counts grow along a chain, so it is short."""
    at = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        moved = at.join(on, F.col("root") == F.col("_word"), "left")
        moved = durable(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if moved.where("_moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    ratio: int = RATIO, most: int = LIST,
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    path = scratch(docs.sparkSession, "vocabulary")
    vocabulary(docs, id_col, text_col, least_length, least_count).write.parquet(path)
    words = docs.sparkSession.read.schema("word string, n long").parquet(path)
    near = near_counts(words, most).select(F.col("word").alias("_word"), "n_near", "form_n", "form")
    facts = words.join(near, F.col("word") == F.col("_word"), "left")
    strong = F.col("form_n") >= ratio * F.col("n")
    facts = durable(facts.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")
    ))
    roots = last_forms(facts.where("form IS NOT NULL")).select(F.col("word").alias("_word"), "root")
    out = facts.join(roots, F.col("word") == F.col("_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# crc32 from its definition, folded over the bytes of each key and run. Words are near if dropping one character from either or both, at the
# same place, gives equal strings.
ORACLE = r"""
WITH RECURSIVE t(n, k, c) AS (SELECT range, 0, range::UBIGINT FROM range(256) UNION ALL
    SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY n) AS w FROM t WHERE k = 8),
r AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS key,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
d AS MATERIALIZED (SELECT key, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(key || ':' || run)), '..'), lambda x: ('0x' || x)::UBIGINT)),
                 lambda a, v: xor(a >> 8, w[(xor(a, v) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS h FROM d, tab),
v AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
k AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM k)),
p AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT x.word, k.word, k.n FROM x JOIN k ON k.word = x.rest
      UNION SELECT k.word, x.word, x.n FROM x JOIN k ON k.word = x.rest),
b AS (SELECT word, count(*) AS n_near, max(m) AS m, min({'m': -m, 'w': other}).w AS other FROM p GROUP BY word),
f AS MATERIALIZED (SELECT k.word, k.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * k.n THEN other END AS form, CASE WHEN m >= 2 * k.n THEN m END AS form_n
      FROM k LEFT JOIN b ON b.word = k.word),
c(word, tip, form) AS (SELECT word, word, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.form)
SELECT f.word, f.form, c.tip AS root, f.n, n_near, form_n FROM f JOIN c ON c.word = f.word AND c.form IS NULL
"""
