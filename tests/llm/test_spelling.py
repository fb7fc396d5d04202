import random
import zlib
from collections import Counter

import pytest

from daybook.llm import spelling as S
from tests.llm.cases import docs, rows, same_as_sql, values

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(given):
    n = Counter()
    for i, text, *_ in given:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "[" else c
            elif run:
                h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += 1
                run = ""
    return grouped({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})


def grouped(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def spelt(seed=5):
    """Documents whose words come in families of slips, with frequencies far apart."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(25)]
    words = list(base)
    for w in base:
        for _ in range(6):
            at, c = rng.randrange(len(w) + 1), rng.choice("abcdeÿ")
            words += [w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]]
    return [(i, " ".join(rng.choice(words[: 10 + 30 * i % 500]).capitalize() for _ in range(300)), "en", "a", 0) for i in range(40)]


@pytest.mark.parametrize("most", [4, 512])
def test_equals_brute_force(spark, most):
    given = [*rows(), *spelt(), (901, "word× wörd÷ straße STRASSE ÀÉ " * 3, "en", "a", 0), (902, "long" * 5000 + " " + "long" * 5000 + "e " + "long" * 5000, "en", "a", 0)]
    given += [given[-1], given[-1]]
    out = S.variants(docs(spark, given), most=most)
    assert sorted(out.columns) == sorted(COLUMNS)
    want = brute(given)
    assert values(out, *COLUMNS) == want
    assert any(r[1] != r[2] and r[1] for r in want) and any(r[5] for r in want)  # chains of forms exist


def test_equals_sql(spark):
    given = [*rows(), *spelt(9)]
    same_as_sql(S.variants(docs(spark, given)), S.ORACLE, given)


def test_edges(spark):
    for given in ([], [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, None, None, None, 0)]):
        assert S.variants(docs(spark, given)).collect() == []
    assert values(S.variants(docs(spark, [(None, "apple apple apple", None, None, 0)])), *COLUMNS) == [("apple", None, "apple", 3, 0, None)]


def test_scan_equals_all_pairs():
    rng = random.Random(2)
    for alphabet, longest in (("ab", 7), ("abcd", 4), ("aàz", 5)):
        words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(120)})
        lcps = [0, *(S.common(a, b) for a, b in zip(words, words[1:]))]
        for q in words:
            assert [words[j] for j in S.near_words(q, words, lcps)] == [w for w in words if one_edit(q, w)]


def test_every_pair_belongs_to_one_list(spark):
    """A hot stem: all words share most characters, so lists are dealt again until they are short."""
    rng = random.Random(4)
    n = {}
    for _ in range(500):
        tail = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 3)))
        n["commonstem" + tail] = rng.randint(3, 60)
        n[tail + "commonstem"] = rng.randint(3, 60)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    lists = S.dealt(words, 16).groupBy("length", "low", "high", "key").count().collect()
    assert max(r["count"] for r in lists if r.high - r.low > 1) <= 16
    got = {(r.word, r.n_near, r.form_n, r.form) for r in S.near_counts(words, 16).collect()}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    assert got == {(w, len(near[w]), n[b], b) for w, b in best.items()}
