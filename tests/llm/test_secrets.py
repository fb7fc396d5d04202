import hashlib

from daybook.llm import secrets as S
from tests.llm.cases import docs, rows


def test_base_spans_and_digest(spark):
    texts = {
        1: 'é token = "abcdef" and PASSWORD:short12 secret=abc api-key=zzzzzzzz apiKey = zzzzzzzz',
        2: "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " " + "0123456789abcdef" * 2 + "Z" + "a" * 23,
        3: None,
        4: "",
        5: "nothing here " * 20000,
    }
    got = {r.doc_id: r for r in S.find_secrets(docs(spark, [(i, t, None, None, 0) for i, t in texts.items()])).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (3, 0, 0)
    assert got[1].spans.split(",")[0] == "assign:2:17" and texts[1][2:17] == 'token = "abcdef'
    assert (got[2].n_access, got[2].n_hex) == (1, 1) and got[2].spans == "access:0:20,hex:41:73"
    empty = hashlib.sha256(b"").hexdigest()
    assert all(got[i].base_sha256 == empty and got[i].spans == "" for i in (3, 4, 5))
    assert got[2].base_sha256 == hashlib.sha256(got[2].spans.encode()).hexdigest()


def test_order_within_one_start():
    text = "token=" + "a" * 30
    assert S.scan(text, 10.0)[4] == "assign:0:36,hex:6:36"
    assert S.scan("secret:AKIA" + "0" * 20, 10.0)[:3] == (1, 1, 0)


def test_unicode_case_is_no_ascii_case():
    assert S.scan("paſſword=abcdefgh toKen=abcdefgh", 10.0)[0] == 0


def test_method_adds_spans_in_credential_context():
    text = "db_pass = Xk9!vQ2mLp7 and passphrase: qwerty2019 pin: 12 pwd=ordinarywordless"
    out = S.scan(text, 10.0)
    kinds = [s.split(":") for s in out[4].split(",")]
    assert {text[int(a) : int(b)] for k, a, b in kinds if k == "guess"} >= {"Xk9!vQ2mLp7", "qwerty2019"}
    assert out[3] == hashlib.sha256(b"").hexdigest()


def brute(value, own):
    """The cheapest segmentation by trying all cut points, with the same prices for single segments."""
    n = len(value)
    best = [0.0] + [float("inf")] * n
    single = {}
    for i in range(n):
        for j in range(i + 1, n + 1):
            single[i, j] = segment(value, i, j, own)
    for j in range(1, n + 1):
        best[j] = min(best[i] + single[i, j] + (0.3 if i else 0) for i in range(j))
    return best[n]


def segment(value, i, j, own):
    import math

    part, low = value[i:j], value[i:j].lower()
    costs = [len(part) * math.log10(S._alphabet(value))]
    rank = S.WORD_RANK.get(low) or own.get(low)
    if len(part) >= 3 and rank:
        shape = 0 if part == low else 0.3 if part in (low.capitalize(), low.upper()) else 1.0
        costs.append(math.log10(rank + 1) + shape)
    return min(costs)


def test_guess_cost_against_all_segmentations():
    own = {"river": 90, "stone": 91}
    for value in ("riverstone", "Password", "xKpassWORDriver", "stoneq", "zqjxkv", "adminRIVER"):
        assert abs(S.guess_cost(value, own)[0] - brute(value, own)) < 1e-9


def test_guess_cost_orders_secrets():
    cost = lambda v: S.guess_cost(v)[0]
    assert cost("password") < cost("Passw0rd") < cost("Passw0rd19840712") < cost("04dbebab91ab85687d33eeaaf9ac699e")
    assert cost("aaaaaaaaaaaa") < cost("asdfghjkl;") < cost("k3vQz9xT1p")
    assert cost("abcabcabcabc") < cost("abqzrtmvnwex")
    assert S.guess_cost("1999-12-31")[1] == "date"
    assert S.guess_cost("") == (0.0, "")
    assert S.guess_cost("x" * 20000)[0] < 10


def test_awkward_rows(spark):
    assert S.find_secrets(docs(spark)).count() == len(rows())
    assert S.find_secrets(docs(spark, [])).count() == 0


def guesses(text):
    return {text[int(a) : int(b)] for k, a, b in (x.split(":") for x in S.scan(text, 10.0)[4].split(",") if x) if k == "guess"}


def test_a_value_is_no_word_of_its_own_text():
    for value in ("kqzvxwptmrbd", "aGhTyRwQzPk12", "KqzvXwptMrbd"):
        for head in ("pwd=", "auth: ", "login: "):
            text = f"Some words here. {head}{value} and more, {head}{value} once more"
            assert guesses(text) == {value}
            assert S.scan(text, 10.0)[6] >= 10 and S.scan(text, 10.0)[8] == 0
    # A value of the base pattern is no word either; a word that stands elsewhere too is one.
    assert S.scan("password=kqzvxwptmrbd", 10.0)[6:] == (round(12 * S.math.log10(26), 6),) * 2 + (0,)
    assert S.scan("the riverbank, password=riverbank", 10.0)[8] == 1
    assert not guesses("the passengers wait. login: passengers")


def test_password_material_beside_short_brute_spans():
    text = "pwd=dragonzq pwd: qwerty2019x login: Summer7! pin: 1987kq"
    assert guesses(text) == {"dragonzq", "qwerty2019x", "Summer7", "1987kq"}
    assert not guesses("login: testing, pin is passes and auth: well-tested; the well")


def test_repeats_of_any_length_take_linear_time():
    import time

    for unit in ("a", "ab", "abcdefgh", "xY3"):
        # A repeat is one segment: its unit and the number of turns.
        for turns in (9, 50):
            cost, kinds = S.guess_cost(unit * turns)
            assert kinds == "repeat" and cost < S.guess_cost(unit * turns + "q7")[0]
        begin = time.process_time()
        S.guess_cost(unit * (40_000 // len(unit)))
        assert time.process_time() - begin < 8
