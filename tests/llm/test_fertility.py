from collections import Counter

import pytest

from daybook.llm import fertility as Q
from tests.llm.cases import docs, rows

ASCII_BLANK = " \t\n\x0b\x0c\r"


def base(text):
    """The base counts as their definition reads."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in ASCII_BLANK:
            words += [word] if word else []
            word = ""
        else:
            word += c
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, hit = Counter(runs), set()
    for i, run in enumerate(runs):
        hit |= set(range(i, i + 5)) if often[run] > 1 else set()
    lines = [x for x in text.split("\n") if x.strip(ASCII_BLANK)]
    n = len(words)
    failed = n < 10 or 100 * len(hit) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_base_counts_and_defined_results(spark):
    given = rows() + [(100, "a b c d e\n" * 4, "en", "a", 0), (101, "x y # z", "en", "a", 0), (102, "é" * 5000, None, "a", 0)]
    got = Q.fertility_rule(docs(spark, given)).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r.doc_id is None, r.doc_id or 0, *(r[f] for f in fields)) for r in got) == sorted(
        (i is None, i or 0, *base(t)) for i, t, *_ in given
    )
    assert not any(r.kept for r in got if r.base_failed)
    assert Q.fertility_rule(docs(spark, [])).count() == 0


def test_bands_reject_what_the_group_does_not_hold(spark):
    import random

    rng = random.Random(3)
    known = "the water level of this river rises every spring because snow melts in mountains far away from here".split()
    plain = [" ".join(rng.choice(known) for _ in range(160)) for _ in range(60)]
    noise = ["".join(rng.choice("qxzjkvw0123456789") for _ in range(900)) + " " + " ".join("qz" + str(i) for i in range(90)) for _ in range(3)]
    given = [(i, t, "en", "a", 0) for i, t in enumerate(plain + noise)]
    got = {r.doc_id: r for r in Q.fertility_rule(docs(spark, given, extra=False)).collect()}
    assert all(got[i].kept for i in range(60))
    assert not any(got[i].kept for i in range(60, 63))


@pytest.mark.parametrize("text, script", [("abc", "latin"), ("über é", "latin"), ("жук", "cyrillic"), ("12 !", "none"), ("漢字", "han"), ("", "none")])
def test_script(text, script):
    assert Q.script_of(text) == script


def test_vocabulary_forgets_and_measures_alike():
    measure = Q.measure_texts(f"{Q.VOCAB_DIR}/{Q.VOCABULARY}")
    texts = ["some words " * 40, "y" * 6000, None, "snow 亜龘"]
    first = measure(texts)
    assert repr(measure(texts)) == repr(first)
    assert repr([measure([t])[0] for t in texts]) == repr(first)
    assert first[3][8] > 0
