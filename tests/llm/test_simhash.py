import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from daybook.llm import simhash as H
from tests.llm.cases import docs, rows


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """(id, fp) -> component by comparing all pairs; ids may be null and repeat."""
    n = len(prints)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 4:
                root[find(a)] = find(b)
    out = []
    for a in range(n):
        ids = [prints[b][0] for b in range(n) if find(b) == find(a) and prints[b][0] is not None]
        out.append((prints[a][0], f"{prints[a][1]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def test_every_agreement_contains_a_set():
    for distance in (2, 4):
        for width in range(1, 9 - distance):
            sets = H.position_sets(width, distance)
            assert all(any(set(s) <= set(a) for s in sets) for a in combinations(range(8), 8 - distance))
    assert [len(H.position_sets(w)) for w in (1, 2)] == [5, 7]


def test_documents_equal_brute_force(spark):
    given = rows()
    got = sorted(map(tuple, H.near_duplicates(docs(spark, given)).collect()), key=repr)
    assert got == brute([(i, plain_fingerprint(t)) for i, t, *_ in given])
    assert H.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_links_join_all_near_fingerprints(spark, monkeypatch, width):
    monkeypatch.setattr(H, "LIST", 16)  # long lists are cut into blocks
    rng = random.Random(width)
    prints = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    centre = rng.getrandbits(64)
    for _ in range(140):  # one dense group and some chains
        flipped = centre
        for b in rng.sample(range(64), rng.randint(1, 3)):
            flipped ^= 1 << b
        prints.append(flipped)
    for _ in range(40):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(3, 6)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints))
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    tied = df.join(H.components(H.links(df, width=width)), F.col("fp") == F.col("node"), "left").select("doc_id", F.coalesce("root", "fp").alias("r"))
    groups = {}
    for r in tied.collect():
        groups.setdefault(r.r, set()).add(r.doc_id)
    want = {}
    for i, _, c in brute(list(enumerate(prints))):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keep_one_of_each_component(spark):
    given = rows()
    table = docs(spark, given)
    out = H.keep_one(table)
    assert out.columns == table.columns
    parts = brute([(i, plain_fingerprint(t)) for i, t, *_ in given])
    kept = [r.doc_id for r in out.collect()]
    assert sorted(kept, key=repr) == sorted({c for _, _, c in parts}, key=repr)


def test_width_follows_the_number_of_fingerprints():
    assert H.best_width(10) <= H.best_width(10**6) <= H.best_width(10**9) <= H.best_width(10**12) <= 4
    assert H.fingerprint("a b") != 0 and H.fingerprint(None) == H.fingerprint(" \n") == 0
    assert np.bitwise_count(np.uint64(H.fingerprint("A b c d e") ^ H.fingerprint("a B c d e"))) == 0
