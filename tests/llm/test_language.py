import os
import zlib

import numpy as np
import pytest

from daybook.llm import language as L
from tests.llm.cases import docs

FOLDER = "/root/testdata/sf0.001"
WORDS = {"x": "aba bab abba baba", "y": "cdc dcd cddc dcdc"}


def labelled(n=60):
    out = []
    for i in range(n):
        lang = "xy"[i % 2]
        own = WORDS[lang].split()
        out.append((i, " ".join(own[(i * k) % 4] for k in range(1, 12)), lang, "s", 0))
    return out


def kernel(a, b):
    grams = lambda t: {(n, t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    x, y = grams(a.lower()), grams(b.lower())
    return len(x & y) / (len(x) * len(y)) ** 0.5


def test_kernel_is_the_blended_presence_kernel():
    texts = ["Hello there", "other HELLO", "zzz", "é\U0001f600a", "a"]
    model = L.StringKernelModel([L.ngrams(t) for t in texts], ["p", "q", "p", "q", "p"], [0, 1, 2, 3, 4])
    want = np.array([[kernel(a, b) for b in texts] for a in texts])
    assert np.allclose(model.kernel([L.ngrams(t) for t in texts]), want, atol=1e-5)


def test_learns_only_from_allowed_rows_and_defines_awkward_ones(spark):
    given = labelled() + [(900, None, "x", "s", 0), (901, "12 !?", "x", "s", 0), (902, "", "y", "s", 0), (903, "ABA bab", None, "s", 0), (None, "cdc dcdc", "y", "s", 0)]
    poison = [(i, " ".join(WORDS["y"].split()), "x", "s", 0) for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    table = docs(spark, given + poison)
    got = {r.doc_id: r for r in L.identify(table, L.fit(table)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in labelled())
    assert all(got[i].lang_pred == "y" and got[i].held_out for i, *_ in poison)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "x", "y"]
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[None].held_out


def test_without_labels_or_rows(spark):
    table = docs(spark, [(1, "abc", None, "s", 3)])
    assert [tuple(r)[2:4] for r in L.identify(table, L.fit(table)).collect()] == [("und", 0.0)]
    empty = docs(spark, [])
    assert L.identify(empty, L.fit(empty)).count() == 0


def test_sample_is_bounded_per_language(spark):
    table = docs(spark, labelled(400))
    counts = dict(L.learning_sample(table, "doc_id", "text", "lang", 20).groupBy("lang").count().collect())
    assert counts == {"x": 20, "y": 20}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = L.identify(table, L.fit(table)).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


FOREIGN = {
    "Turkish": "Türkiye'nin en kalabalık şehri olan İstanbul, tarih boyunca birçok medeniyete ev sahipliği yapmıştır ve bugün de önemli bir merkezdir.",
    "Finnish": "Suomen kieli kuuluu uralilaisiin kieliin ja sitä puhuu äidinkielenään noin viisi miljoonaa ihmistä, joista suurin osa asuu Suomessa.",
    "Dutch": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten.",
    "Russian": "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "Greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "Korean": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다.",
    "Chinese": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
    "keys": "asdf jkl qwer uiop zxcv lkjh asdfg poiu mnbv qwe rty asd fgh jkl zxc vbn",
    "noise": "kqzv wxptm rbdfj hqxz vvkpt zzgw nqjx bwqk xjhv pzqm ktgx wqvb jzzx",
    "short": "xq zzkp",
    "digests": "b64b244acde2e3b0 7f1e99ac",
}


def test_unlearned_languages_and_noise_are_not_learned(spark):
    import corpus_pipeline as C

    foreign = [(5000 + i, x, None, "s", 0) for i, x in enumerate(["ефг ефф ггф", "zqx xqz qqzx zxq", "人人生而自由", "b64b 7f1e"])]
    both = (6000, " ".join(["aba bab abba baba"] * 40 + ["cdc dcd cddc dcdc"] * 40), None, "s", 0)
    kept = {r.doc_id for r in C.language_stage(spark, docs(spark, labelled() + foreign + [both]), "").collect()}
    assert kept == {r[0] for r in labelled()} | {6000}


def test_language_with_few_samples_is_not_rejected(spark):
    import corpus_pipeline as C

    few = [(7001, "ефг ефф ггф", "z", "s", 0), (7003, "ефг фге егг", "z", "s", 0), (7004, "ггф ефг гге", None, "s", 0)]
    kept = {r.doc_id for r in C.language_stage(spark, docs(spark, labelled() + few), "").collect()}
    assert kept == {r[0] for r in labelled() + few}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="given tables are absent")
def test_given_languages_stay_and_planted_ones_go(spark):
    import corpus_pipeline as C

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = [(10**9 + i, x, None, "s", 0) for i, x in enumerate(FOREIGN.values())]
    more = docs(spark, planted, extra=False).select(*table.columns)
    kept = {r.doc_id for r in C.language_stage(spark, table.unionByName(more), "").select("doc_id").collect()}
    assert not kept & {r[0] for r in planted}
    spoken = table.where("text rlike '[a-z]{3}'").count()
    assert len(kept) >= 0.995 * spoken
