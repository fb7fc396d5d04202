"""Edit join of lines: segment partition, length-aware substring index, banded bit-parallel edit distance.

A line is the text between line feeds, trimmed of blanks; empty ones are left out. Two different lines link if at most `edits` insertions, deletions or
substitutions of characters lead from one to the other and that is at most a fifth of the longer line (so a line needs
five characters for each edit). A line is cut into `edits` + 1 even segments; at least one of them stands unchanged in any line that it links
with, shifted by no more than the edits allow. Segments are indexed by line length and ordinal; every line probes the indexes of its own and slightly
smaller lengths; its own segments serve as probes of equal length. Equal lines are one class from the start, so copies cost nothing here. Native: DataFrame functions only.
Null texts have no lines. A line of any length is compared whole.

Texts are not shuffled: lines travel as digests, and only lines of candidate pairs are fetched. Where a set decides which lines to look at, it is
broadcast as numbers of hash buckets, so it has at most a million rows whatever the data; the exact decision follows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.runtime import durable, stored

EDITS = 2
BLANKS = " \t\x0b\x0c\r"
#: Characters counted for the cheap lower bound of the distance.
COUNTED = "etaoinshrdlu "
#: The characters whose counts travel with segments that very many lines share, eight to a long.
PACKED = ("etaoinsh", "rdlu cmg")
#: Lines with more copies than this are brought together before they are cut up; buckets of the two broadcast sets.
COPIES, HOT_BUCKETS, FETCH_BUCKETS = 2, 1 << 20, 1 << 20
#: A segment of more lines than this is shared by many; numbers of key buckets.
SHARED, KEY_BUCKETS = 16, 1 << 20


def trimmed(line: Column) -> Column:
    """A line without blanks at its ends. Trimming goes through all characters, so only lines that have some there are trimmed."""
    ends = (F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c)) for c in BLANKS)
    return F.when(reduce(lambda x, y: x | y, ends), F.btrim(line, F.lit(BLANKS))).otherwise(line)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line_no (from 0, empty lines counted), line."""
    split = F.posexplode(F.split(F.col(text_col), "\n", -1))
    rows = docs.select(F.col(id_col).alias("doc_id"), split.alias("line_no", "line"))
    return rows.select("doc_id", "line_no", trimmed(F.col("line")).alias("line")).where("line <> ''")


def mark(line: Column) -> Column:
    """Sixteen bytes that stand for a line."""
    return F.unhex(F.md5(line))


def bucket(line: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(line), F.lit(n))


def in_buckets(lines: DataFrame, chosen: DataFrame, n: int, how: str) -> DataFrame:
    """Lines whose bucket is (`left_semi`) or is not (`left_anti`) among `chosen.bucket`, a set of at most n small numbers."""
    return lines.join(F.broadcast(chosen.select(F.col("bucket").alias("_bucket")).distinct()), bucket(F.col("line"), n) == F.col("_bucket"), how)


def _segment(length: Column, k: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment k of an even partition; the later segments are the longer ones."""
    small = F.floor(length / parts).cast("int")
    first_long = parts - (length - small * parts)
    return small * k + F.greatest(F.lit(0), k - first_long), small + (k >= first_long).cast("int")


def cut_out(line: str, n: str, start: Column, size: Column) -> Column:
    """UTF-8 bytes of `size` characters of a line from `start` (from 0) on; `n` names its length. If all its characters are single bytes, none have to be counted."""
    plain = F.octet_length(line) == F.col(n)
    return F.when(plain, F.substring(F.col(line).cast("binary"), start + 1, size)).otherwise(F.substring(line, start + 1, size).cast("binary"))


def indexed(lines: DataFrame, edits: int) -> DataFrame:
    """(key, h1, line) for each segment of each line."""
    parts = edits + 1
    start, size = _segment(F.col("n"), F.col("k"), parts)
    key = F.xxhash64("n", "k", cut_out("line", "n", start, size))
    return lines.select("h1", "n", "line", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("k")).select(key.alias("key"), "h1", "line")


def probed(edits: int) -> list[tuple[int, int, int]]:
    """(difference in length, segment, shift) of all substrings of a line that can be a segment of an equally long or shorter line.

    Segment k may be shifted by at most k edits before it, and by so few that the edits behind it suffice for the rest of
    the difference in length. Between equally long lines the unshifted substrings are the lines' own segments, and up to three edits hold
    one insertion and one deletion at most; either line may probe the other, and for one of the two the insertion comes first, so no shift is below zero.
    """
    return [
        (less, k, shift)
        for less in range(edits + 1)
        for k in range(edits + 1)
        for shift in range(max(-k, less - (edits - k)) if less else 1, min(k, less + (edits - k)) + 1)
    ]


def probes(lines: DataFrame, edits: int) -> DataFrame:
    """(key, h1, line) for each substring of a line, its own segments aside, that can be a segment of a line as long or up to `edits` shorter."""
    ways = F.array(*(F.struct(F.lit(a).alias("less"), F.lit(k).alias("k"), F.lit(x).alias("shift")) for a, k, x in probed(edits)))
    rows = lines.select("h1", "n", "line", F.explode(ways).alias("w")).select("h1", "n", "line", (F.col("n") - F.col("w.less")).alias("other"), "w.k", "w.shift")
    start, size = _segment(F.col("other"), F.col("k"), edits + 1)
    at = start + F.col("shift")
    rows = rows.where((F.col("other") > 0) & (at >= 0) & (at + size <= F.col("n")))
    return rows.select(F.xxhash64("other", "k", cut_out("line", "n", at, size)).alias("key"), "h1", "line")


def packed_letters(line: Column) -> Column:
    """Counts of a few characters, modulo 256, in the bytes of longs."""
    count = lambda c: (F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(255)).cast("long")
    word = lambda chars: reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(count(c), 8 * i) for i, c in enumerate(chars)))
    return F.struct(*(word(chars).alias(f"w{i}") for i, chars in enumerate(PACKED)))


def packed_near(a: Column, b: Column, most: int) -> Column:
    """Whether packed counts differ by `most` at most; an edit changes them by two, and turning over 255 only makes a difference smaller.

    The first long alone drops most pairs, so it is weighed first.
    """
    byte = lambda x, i: F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))
    apart = lambda w, i: (byte(a[f"w{w}"], i) - byte(b[f"w{w}"], i)).bitwiseAND(F.lit(255))
    gap = lambda words: reduce(lambda x, y: x + y, (F.least(apart(w, i), 256 - apart(w, i)) for w in words for i in range(len(PACKED[w]))))
    return (gap([0]) <= most) & (gap(range(len(PACKED))) <= most)


def keyed(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, h1, letters): letters are counted only where the key's bucket holds a segment that many lines share."""
    many = F.broadcast(shared.select(F.col("bucket").alias("_bucket")))
    met = rows.join(many, F.pmod("key", F.lit(KEY_BUCKETS)) == F.col("_bucket"), "left")
    return met.select("key", "h1", F.when(F.col("_bucket").isNotNull(), packed_letters(F.col("line"))).alias("letters"))


def letters(line: Column) -> Column:
    """How often a few characters stand in a line."""
    return F.array(*(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED))


def letter_gap(a: Column, b: Column) -> Column:
    """Half the summed difference of two letter counts, rounded up: no distance is smaller."""
    return F.ceil(reduce(lambda x, y: x + y, (F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(len(COUNTED)))) / 2)


def _let(value: Column, use) -> Column:
    """Evaluate `value` once and use it several times inside a higher-order function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def band_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two character arrays if it is at most `edits`, else some larger number.

    Asks for edits < size(a) <= size(b) <= size(a) + edits. The band of 2 * `edits` + 1 cells around the main diagonal is held in the
    bits of one long: bit i of column j stands for row j + i - edits. A column adds the word of its matches; vertical differences (VP up, VN
    down) move along with the band. The score follows the band's lowest diagonal, then the last row.
    """
    width = 2 * edits + 1
    n = F.size(a)
    mask, zero = F.lit((1 << width) - 1), F.lit(0).cast("long")
    bit = lambda word, i: F.call_function("shiftrightunsigned", word, F.lit(i)).bitwiseAND(F.lit(1))
    inverse = lambda word: word.bitwiseXOR(mask)

    def matches(char: Column, j: Column) -> Column:
        return reduce(
            lambda x, y: x + y, (F.when(F.get(a, j + (i - edits)) == char, F.lit(1 << i).cast("long")).otherwise(zero) for i in range(width))
        )

    def column(acc: Column, x: Column) -> Column:
        vp, vn, j = acc["vp"], acc["vn"], acc["j"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(mask)

        def move(w: Column) -> Column:
            d, hp, hn = w["d0"], w["hp"], w["hn"]
            right = F.shiftrightunsigned(d, 1)
            row = (n - 1 - j + edits).cast("int")
            score = F.when(j + edits < n, 1 - bit(d, width - 1)).otherwise(bit(hp, row) - bit(hn, row))
            return F.struct(
                hn.bitwiseOR(inverse(right.bitwiseOR(hp))).alias("vp"), right.bitwiseAND(hp).alias("vn"),
                (acc["score"] + score).cast("long").alias("score"), (j + 1).alias("j"),
            )

        words = lambda d: F.struct(d.alias("d0"), vn.bitwiseOR(inverse(d.bitwiseOR(vp))).alias("hp"), d.bitwiseAND(vp).alias("hn"))
        # The last row can take back one per column, 2 * edits at most; beyond that nothing changes the verdict.
        return F.when(acc["score"] > 3 * edits, acc).otherwise(_let(_let(d0, words), move))

    start = F.struct(
        F.lit(((1 << width) - 1) ^ ((1 << edits) - 1)).cast("long").alias("vp"), zero.alias("vn"), F.lit(edits).cast("long").alias("score"), F.lit(0).alias("j")
    )
    return F.aggregate(F.transform(b, matches), start, column, lambda acc: acc["score"])


def allowed(longer: Column, edits: int) -> Column:
    """Edits that a pair may need: a fifth of the longer line, `edits` at most."""
    return F.least(F.lit(edits), F.floor(longer / 5))


def candidates(lines: DataFrame, classes: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of line hashes that share a segment, each once, a < b.

    A line with many copies is brought down to one before it is cut; lines of a bucket that holds such a line take the same way.
    Under a segment that many lines share, only lines whose letter counts lie near enough meet, so such a group does not yield all its pairs.
    """
    hot = classes.where(F.col("n_copies") > COPIES).select("bucket")
    hot = durable(hot.distinct())
    several = in_buckets(lines, hot, HOT_BUCKETS, "left_semi").select("line").distinct()
    long_enough = in_buckets(lines, hot, HOT_BUCKETS, "left_anti").select("line").unionByName(several)
    # A line of 4 characters can link with one of 5; shorter ones link with none.
    cut = stored(long_enough.select("line").where(F.length("line") >= 4), "cut")
    cut = cut.select(F.xxhash64("line").alias("h1"), F.length("line").alias("n"), "line")
    index = indexed(cut, edits)
    shared = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SHARED).select(F.pmod("key", F.lit(KEY_BUCKETS)).alias("bucket"))
    shared = durable(shared.distinct())
    probe = keyed(probes(cut, edits), shared).select("key", F.col("h1").alias("b"), F.col("letters").alias("_letters"))
    near = lambda x, y: F.coalesce(packed_near(F.col(x), F.col(y), 2 * edits), F.lit(True))
    keys = keyed(index, shared)
    found = keys.join(probe, "key").where((F.col("h1") != F.col("b")) & near("letters", "_letters"))
    found = found.select(F.least("h1", "b").alias("a"), F.greatest("h1", "b").alias("b"))
    # Own segments meet among themselves: the shuffled index is used twice.
    alike = keys.alias("x").join(keys.alias("y"), "key").where((F.col("x.h1") < F.col("y.h1")) & near("x.letters", "y.letters"))
    return found.unionByName(alike.select(F.col("x.h1").alias("a"), F.col("y.h1").alias("b"))).distinct()


def line_links(lines: DataFrame, classes: DataFrame, edits: int = EDITS) -> DataFrame:
    """Pairs of different lines that link: (a_mark, b_mark, distance)."""
    if edits not in (1, 2, 3):
        raise ValueError("edits must be 1, 2 or 3")
    pairs = durable(candidates(lines, classes, edits))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct()
    wanted = durable(ids.select(F.pmod("h1", F.lit(FETCH_BUCKETS)).alias("bucket")).distinct())
    near = in_buckets(lines, wanted, FETCH_BUCKETS, "left_semi").select(F.xxhash64("line").alias("h1"), "line")
    near = near.join(ids, "h1").select("h1", "line").distinct().withColumn("mark", mark(F.col("line")))
    near = stored(near.withColumn("n", F.length("line")).withColumn("letters", letters(F.col("line"))), "lines")
    # Lengths and letters drop most pairs before any text is joined to them.
    small = lambda h: near.select(F.col("h1").alias(h), *(F.col(c).alias(f"{h}_{c}") for c in ("mark", "n", "letters")))
    limit = allowed(F.greatest("a_n", "b_n"), edits)
    met = pairs.join(small("a"), "a").join(small("b"), "b").where(
        (F.abs(F.col("a_n") - F.col("b_n")) <= limit) & (F.col("a_mark") != F.col("b_mark")) & (letter_gap(F.col("a_letters"), F.col("b_letters")) <= limit)
    )
    met = durable(met.select("a_mark", "b_mark", "a_n", "b_n"))
    text = lambda h: near.select(F.col("mark").alias(f"{h}_mark"), F.col("line").alias(f"{h}_line"))
    met = met.join(text("a"), "a_mark").join(text("b"), "b_mark")
    # The rows of the matrix are the shorter line's characters. The arrays are columns of their own: an expression inside the
    # column-by-column function would be computed again for every character.
    chars = lambda first: F.split(F.when((F.col("a_n") <= F.col("b_n")) == F.lit(first), F.col("a_line")).otherwise(F.col("b_line")), "")
    met = met.select("a_mark", "b_mark", limit.alias("limit"), chars(True).alias("short"), chars(False).alias("long"))
    # For the same reason the verdict is a filter over kept rows: pushed below, it would bring the expressions back in.
    met = durable(met.select("a_mark", "b_mark", "limit", band_distance(F.col("short"), F.col("long"), edits).alias("distance")))
    return met.where(F.col("distance") <= F.col("limit")).select("a_mark", "b_mark", "distance")


def join_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """One row per line: doc_id, line_no, class_id, n_copies, n_links, kept.

    `class_id` is the MD5 of the line, so equal lines share it; `n_links` counts the other lines that link with it. A line is kept if it is
    the first of its class in the order of (doc_id, line_no) and links with no class that comes earlier.
    """
    lines = lines_of(docs, id_col, text_col)
    place = F.struct("doc_id", "line_no")
    marked = stored(lines.select("doc_id", "line_no", mark(F.col("line")).alias("mark"), bucket(F.col("line"), HOT_BUCKETS).alias("bucket")), "marks")
    classes = stored(marked.groupBy("mark").agg(F.min(place).alias("first"), F.count("*").alias("n_copies"), F.min("bucket").alias("bucket")), "classes")
    pairs = durable(line_links(lines, classes, edits))
    ends = pairs.select(F.col("a_mark").alias("mark"), F.col("b_mark").alias("other"))
    ends = ends.unionByName(pairs.select(F.col("b_mark").alias("mark"), F.col("a_mark").alias("other")))
    firsts = classes.select(F.col("mark").alias("other"), F.col("first").alias("other_first"))
    linked = ends.join(firsts, "other").groupBy("mark").agg(F.count("*").alias("n_links"), F.min("other_first").alias("earliest"))
    facts = classes.join(linked, "mark", "left").select(
        "mark", "first", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("earliest") < F.col("first"), F.lit(False)).alias("late")
    )
    facts = stored(facts, "facts")
    return marked.drop("bucket").join(facts, "mark").select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.lower(F.hex("mark")).alias("class_id"), "n_copies", "n_links",
        (place.eqNullSafe(F.col("first")) & ~F.col("late")).alias("kept"),
    )


# DuckDB's levenshtein counts bytes, so the accented letters of the given tables become single control characters first.
ORACLE = r"""
WITH l AS MATERIALIZED (SELECT doc_id, (i - 1)::BIGINT AS line_no, trim(ls[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
k AS MATERIALIZED (SELECT * FROM l WHERE line <> ''),
c AS MATERIALIZED (SELECT line, min({'d': doc_id, 'n': line_no}) AS first, count(*) AS n_copies, length(line) AS n,
        translate(line, 'ÄÇÈÉÊÍÑÓÖÜßáâäçèéêíîñóöúü', (SELECT string_agg(chr(x::INT), '' ORDER BY x) FROM (SELECT unnest(range(1, 9)) AS x UNION ALL SELECT unnest(range(14, 31))))) AS plain,
        list_transform(string_split('e t a o i n s h r d l u', ' '), lambda z: length(line) - length(replace(line, z, ''))) AS counts FROM k GROUP BY line),
p AS (SELECT a.line AS x, b.line AS y, a.first AS fx, b.first AS fy, greatest(a.n, b.n) AS longer, a.plain AS px, b.plain AS py
      FROM (SELECT *, unnest([n - 2, n - 1, n, n + 1, n + 2]) AS m FROM c) a JOIN c b ON a.m = b.n
      WHERE a.line <> b.line AND list_sum(list_transform(list_zip(a.counts, b.counts), lambda z: abs(z[1] - z[2]))) <= 4),
e AS (SELECT x, count(*) AS n_links, min(fy) AS earliest FROM p WHERE levenshtein(px, py) <= least(2, longer // 5) GROUP BY x)
SELECT k.doc_id, k.line_no, md5(k.line) AS class_id, c.n_copies, coalesce(n_links, 0)::BIGINT AS n_links,
       {'d': k.doc_id, 'n': k.line_no} = c.first AND NOT coalesce(earliest < c.first, false) AS kept
FROM k JOIN c ON c.line = k.line LEFT JOIN e ON e.x = k.line
"""
