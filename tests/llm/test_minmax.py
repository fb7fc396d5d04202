import random

import numpy as np
import pytest

from daybook.llm import minmax as M
from tests.llm.cases import docs, rows, values

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(given):
    sets, n = [plain_set(t) for _, t, *_ in given], len(given)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for a in range(n):
        ids = [given[b][0] for b in range(n) if find(b) == find(a) and given[b][0] is not None] if sets[a] else [given[a][0]]
        least = min(ids, default=None)
        out.append((given[a][0], len(sets[a]), least, given[a][0] is not None and given[a][0] == least))
    return sorted(out, key=repr)


def family(rng, first, copies, edits, words=120):
    """Copies of one text with some words changed: many pairs lie near the threshold, on either side."""
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(words)]
    out = []
    for i in range(copies):
        own = list(base)
        for at in rng.sample(range(words), rng.randint(0, edits)):
            own[at] = f"new{rng.randint(0, 10**9)}"
        out.append((first + i, " ".join(own), "en", "a", 0))
    return out


def given_rows(seed=3):
    rng = random.Random(seed)
    given = [*rows(), *family(rng, 1000, 60, 8), *family(rng, 2000, 40, 14), *family(rng, 3000, 8, 1, 4)]
    given += [(4000, "Two words", "en", "a", 0), (4001, "two\twords", "en", "a", 0), (4002, "word", "en", "a", 0), (4003, "two words more", "en", "a", 0)]
    return given + [(None, given[50][1], "en", "a", 0), given[60], given[60]]


def test_equals_brute_force(spark):
    given = given_rows()
    out = M.near_duplicates(docs(spark, given))
    assert out.columns == COLUMNS
    assert values(out, *COLUMNS) == brute(given)


@pytest.mark.parametrize("seed", [1, 2])
def test_second_round_alone_finds_every_link(spark, monkeypatch, seed):
    """With the first round's pairs thrown away, blocks of few classes join all components."""
    monkeypatch.setattr(M, "LIST", 8)
    monkeypatch.setattr(M, "BLOCK_HASHES", 600)
    real, calls = M._with, []

    def none_at_first(pairs, facts, column):
        calls.append(column)
        return real(pairs.limit(0) if column == "sketch" else pairs, facts, column)

    monkeypatch.setattr(M, "_with", none_at_first)
    given = given_rows(seed)
    assert values(M.near_duplicates(docs(spark, given)), *COLUMNS) == brute(given)
    assert calls == ["sketch", "set"]


def test_edges(spark):
    assert M.near_duplicates(docs(spark, [])).collect() == []
    given = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \n", "en", "a", 0), (None, None, None, None, 0), (None, "x y z", "en", "a", 0)]
    got = values(M.near_duplicates(docs(spark, given)), *COLUMNS)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, False), (None, 1, None, False)], key=repr)


def test_signature_is_unbiased():
    rng = np.random.default_rng(5)
    shares = []
    for _ in range(40):
        both, a, b = (rng.integers(0, 2**64, n, np.uint64) for n in (170, 15, 15))
        x, y = M.signature(np.concatenate([both, a])), M.signature(np.concatenate([both, b]))
        shares.append((x == y).mean())
    # 170 of 200 shared: 0.85, over 40 * 150 values a deviation of 0.0046.
    assert abs(np.mean(shares) - 0.85) < 0.02
    assert np.std(shares) < 0.05


def test_sets_and_signatures_take_long_texts_in_parts():
    hashes = M.WordHashes()
    text = " ".join(f"w{i}" for i in range(30_000))
    own = M.shingle_set(text, hashes)
    assert len(own) == 29_998
    moved = M.ODD[:, None] * own[None, :]
    assert (M.signature(own) == np.concatenate([moved.min(axis=1), moved.max(axis=1)])).all()
    assert len(M.shingle_set("a b " * 1000, hashes)) == 2


def test_a_pair_is_compared_under_its_first_common_band():
    rng = random.Random(8)
    group = family(rng, 0, 90, 10)
    sets = [M.shingle_set(t, M.WordHashes()) for _, t, *_ in group]
    facts = []
    for i, s in enumerate(sets):
        v = M.signature(s)
        facts.append({"cls": bytes([i]), "root": bytes([i]), "size": len(s), "bands": M.band_keys(v).tolist(), "sketch": M.sketch(v), "set": s.tobytes()})
    for band in range(M.BANDS):
        for key in {f["bands"][band] for f in facts}:
            own = [f for f in facts if f["bands"][band] == key]
            if len(own) > 1:
                block = M.Block(key, own, None)
                for a, b, _ in block.possible(85):
                    firsts = [next(k for k in range(M.BANDS) if own[i]["bands"][k] == own[j]["bands"][k]) for i, j in zip(a, b)]
                    assert set(firsts) <= {band}
