import hashlib
import random

import numpy as np

from daybook.llm import decontaminate as D
from tests.llm.cases import docs, rows, same_as_sql, values


def test_suffix_array_orders_suffixes():
    rng = random.Random(1)
    for _ in range(60):
        ids = [rng.randrange(4) for _ in range(rng.randint(1, 60))]
        got = D.suffix_array(np.array(ids), len(ids) + 1).tolist()
        assert got == sorted(range(len(ids)), key=lambda i: ids[i:])


def test_longest_matches_against_all_pairs():
    rng = random.Random(2)
    for _ in range(60):
        part, items = ([rng.randrange(4) for _ in range(rng.randint(1, 50))] for _ in range(2))

        def common(p, s, part=part, items=items):
            n = 0
            while p + n < len(part) and s + n < len(items) and part[p + n] == items[s + n] != 0:
                n += 1
            return n

        places = np.array([i for i, x in enumerate(part) if x] or [0])
        want = [max(common(p, s) for s in range(len(items))) for p in places]
        assert D.longest_matches(np.array(part), places, np.array(items)).tolist() == want


def test_very_long_and_periodic_items():
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(100_000)]
    items = D.Items([(["1"], " ".join(words)), (["2"], "na " * 50_000)])
    assert items.flat.nbytes < 2_000_000 and len(items.tests[13][0]) == 100_000 - 12 + 1
    text = "x " + " ".join(words[500:90_500]) + " y " + "na " * 70_000
    (n, spans, names, longest, place), none = items.shard([text, "w1 w2 unknown"])
    assert n == 160_002 and names == ["1", "2"] and (longest, place) == (90_000, 1)
    assert spans == [{"low": 1, "high": 90_001}, {"low": 90_002, "high": 160_002}] and none[1] == []


def test_copies_of_one_item_are_searched_once(spark):
    copies = [(i, "One  two, three FOUR five six" + " " * (i % 3)) for i in range(3000)]
    bench = spark.createDataFrame(copies, "item_id long, text string")
    assert D.distinct_items(bench, "item_id", "text").count() == 1
    (row,) = D.check_documents(docs(spark, [(1, "a one two three four five six b", None, None, 0)]), bench).collect()
    names = ",".join(sorted(str(i) for i in range(3000)))
    assert row.n_items == 3000 and row.n_hit == 6 and row.items_sha256 == hashlib.sha256(names.encode()).hexdigest()


def fixture():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, say(40)), (2, say(13)), (3, "Short item é9"), (4, None), (5, "?!"), (6, say(20)), (10, "short ITEM é9"), (11, "one")]
    given = [r for r in rows() if r[0] is not None][:30]
    given += [(100 + i, f"x {say(5)} {items[0][1][i * 7:]} y. {items[5][1].upper()}!! {say(9)}", "en", "a", 0) for i in range(6)]
    given += [(200, items[0][1] + " " + items[0][1], "en", "a", 0), (201, items[1][1], "en", "a", 0), (202, "a short-item,é9 b " + "z " * 90, "en", "a", 0)]
    given += [(203, " ".join(items[5][1].split()[:12]), "en", "a", 0), (204, "one", "en", "a", 0), (205, items[1][1] + " q" * 300, "en", "a", 0)]
    return given, items


def test_equals_sql_with_one_and_many_blocks(spark):
    given, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 64):
        same_as_sql(D.check_documents(docs(spark, given), bench, block_bytes=size), D.ORACLE, given, items)


def test_defined_results(spark):
    given, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.check_documents(docs(spark, given), bench).collect()}
    assert got[202].items_sha256 == hashlib.sha256(b"10,3").hexdigest() and got[202].n_hit == 3 and not got[202].contaminated
    assert got[200].n_hit == 80 and got[200].longest == 40 and got[205].longest == 13
    assert got[203].n_hit == 0 and got[204].contaminated
    assert got[14].n_words == 0 and got[14].items_sha256 == hashlib.sha256(b"").hexdigest()
    none = D.check_documents(docs(spark, given), bench.limit(0)).collect()
    assert {(r.n_hit, r.n_items, r.contaminated) for r in none} == {(0, 0, False)}
    assert D.check_documents(docs(spark, []), bench).count() == 0
    null_id = spark.createDataFrame([(None, "one")], "item_id long, text string")
    assert values(D.check_documents(docs(spark, [(1, "one", None, None, 0)]), null_id), "items_sha256") == [(hashlib.sha256(b"null").hexdigest(),)]


def test_clean_keeps_columns(spark):
    given, items = fixture()
    table = docs(spark, given).withColumnRenamed("fp", "_found0")
    out = D.clean(table, spark.createDataFrame(items, "item_id long, text string"))
    many = D.clean(table, spark.createDataFrame(items, "item_id long, text string"), block_bytes=64)
    assert out.columns == table.columns == many.columns and sorted(map(repr, out.collect())) == sorted(map(repr, many.collect()))
    assert 200 not in {r.doc_id for r in out.collect()} and 202 in {r.doc_id for r in out.collect()}
