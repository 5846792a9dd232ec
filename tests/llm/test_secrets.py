import functools
import math
import random

import pytest

from eventide.llm import secrets as S


def brute(s):
    """The least cost over all segmentations, each piece by every kind that it can be."""
    n = len(s)
    kinds = {}
    for i, j, kind, bits in S.segments(s):
        if bits is None:
            unit = s[i : i + int(kind[6:])]
            bits = min(S.brute_bits(unit), S.word_bits(unit) or math.inf) + math.log2((j - i) / len(unit)) + 1
        kinds[(i, j)] = min(bits, kinds.get((i, j), math.inf))

    @functools.cache
    def best(i, after_brute):
        if i == n:
            return 0.0
        out = math.inf
        for j in range(i + 1, n + 1):
            if (i, j) in kinds:
                out = min(out, S.SEGMENT_BITS + kinds[(i, j)] + best(j, False))
            if not after_brute:
                out = min(out, S.SEGMENT_BITS + S.brute_bits(s[i:j]) + best(j, True))
        return out

    return best(0, False)


@pytest.mark.parametrize("seed", range(40))
def test_guess_cost_brute_force(seed):
    rng = random.Random(seed)
    pieces = ["password", "P@ssw0rd", "qwerty", "asdf", "2019", "12-05-1999", "20240131", "aaa", "abab", "xyzxyz", "Secret", "x", "9", "_", "$", "é", "token", "1q", "zxcvbnm", "QWERTY"]
    s = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))[:22]
    cost, parts = S.guess_bits(s)
    assert abs(cost - brute(s)) < 1e-9 and "".join(p for p, _ in parts) == s


def test_costs_rank_as_they_should():
    cost = lambda s: S.guess_bits(s)[0]
    assert cost("password") < cost("P@ssw0rd") < cost("Passw0rd1987!") < cost("b7db7aa4a5fcc78305") < cost("1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae")
    assert cost("aaaaaaaaaaaa") < 14 and cost("qwertyuiop") < 14 and cost("2024-01-05") < 20 and cost("") == 0
    assert [k for _, k in S.guess_bits("qwerty2019aaaa")[1]] == ["word", "date", "repeat"]


def test_runs_in_order_and_long_repeats():
    cost = lambda s: S.guess_bits(s)[0]
    assert cost("abcdefghijkl") < 14 and cost("ZYXWVUT") < 16 and cost("987654321") < 14 and cost("mnopqr") < cost("mnoqpr")
    unit = "k3Qz9vR1xW7pL"
    assert cost(unit * 3) < cost(unit) + 6


def brute_scan(rows, most):
    """All of it in plain Python: words counted, contexts found, values scored."""
    import re
    from collections import Counter

    n = Counter(w for _, t in rows if t and not any(p in t.lower() for p in S.PARTS) for w in re.findall(r"\w+", t.lower()) if w.isalpha() and 3 <= len(w) <= 24)
    ranks = dict(S.RANKS)
    for w in [w for w in sorted(n, key=lambda w: (-n[w], w)) if n[w] >= 3][:most]:
        ranks.setdefault(w, len(ranks) + 1)
    out = []
    for d, t in rows:
        for key, at, v in S.credential_values(t or ""):
            bits, parts = S.guess_bits(v, ranks)
            out.append((d, key, at, len(v), round(bits, 6), " ".join(k for _, k in parts), bits >= 48))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "most"), [(1, 50_000), (2, 3), (3, 0)])
def test_scan_brute_force(spark, seed, most):
    """The JVM's choice of texts and Python's contexts agree, whatever white space stands around the sign."""
    rng = random.Random(seed)
    blank = [" ", "\t", "\u00a0", "\u2003", "\u3000", "\x0b", "\x1c", "\x85", "\n", "\r\n"]
    words = ["elephant", "umbrella", "coffee", "wolke", "straße", "configuration", "production", "value", "été", "x9"]

    def text():
        if rng.random() < 0.4:
            return " ".join(rng.choice(words) for _ in range(12))
        gap = lambda: "".join(rng.choice(blank) for _ in range(rng.choice([0, 0, 1, 2, 9, 40])))
        name = rng.choice(["password", "dbPassword", "ſecret", "to\u212aen", "API_KEY", "x.token", "credentials", "compass", "tokens", "é" + "pwd", "passphrase2"])
        value = rng.choice(["elephantumbrellacoffee", "configuration.production.value", "Zk3v9QpX7wLm2Rt8Aq", "'a b", '"c d"', "5", "été", "abcdefgh1234"])
        return rng.choice(["", "so ", "é", "-", '"']) + name + rng.choice(["", '"']) + gap() + rng.choice(["=", ":", "=>", ":=", ""]) + gap() + value + rng.choice(["", " x", "\n y"])

    rows = [(k, text()) for k in range(400)] + [(400, None), (401, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in S.scan_secrets(df, learned=most).collect()), key=repr)
    assert len(got) > 100 and got == brute_scan(rows, most)
    if most > 100:
        score = {t: S.guess_bits(t, S.learned_ranks(df))[0] for t in ("elephantumbrellacoffee", "configuration.production.value")}
        assert max(score.values()) < 48 < S.guess_bits("elephantumbrellacoffee")[0]


def test_copies_of_a_secret_are_not_learned(spark):
    rows = [(k, "the token = qwvzkjxhplmnbdrt here") for k in range(200)] + [(999, "a plain word and a plain word and a plain word")]
    got = S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 200 and all(r["is_secret"] for r in got)
    assert "qwvzkjxhplmnbdrt" not in S.learned_ranks(spark.createDataFrame(rows, "doc_id long, text string"))


def test_texts_with_key_words_are_counted(spark):
    """All words of such a text but those near the key word, where a secret may stand."""
    far = "filler " * (S.NEAR + 5) + "zebrafish"
    rows = [(k, f"{far} {'x ' * S.NEAR} a monkey, qwvzkjxhplmnbdrt {far}") for k in range(3)] + [(9, None), (10, "")]
    ranks = S.learned_ranks(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "zebrafish" in ranks and "filler" in ranks and ranks["filler"] < ranks["zebrafish"] and "qwvzkjxhplmnbdrt" not in ranks
    assert S.far_words(" ".join(["the token"] * 50_000)) == [] and S.far_words("keys " + "a " * S.NEAR + "word x9 straße") == ["word", "straße"]


def test_contexts():
    found = lambda t: [(k, t[at : at + len(v)] == v, v) for k, at, v in S.credential_values(t)]
    assert found('x password=b7db7aa. token = "xx yy" API_KEY: abc, secret => \'q\'') == [("password", True, "b7db7aa"), ("token", True, "xx yy"), ("api_key", True, "abc"), ("secret", True, "q")]
    assert found("the password is good; compass: north; tokens = 5") == []
    assert found('{"client_secret": "z"}') == [("client_secret", True, "z")]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('password            = "x9"', [("password", "x9")]), ("password =            x9", [("password", "x9")]), ("password:\n            x9", [("password", "x9")]), ("token\u00a0=\u00a0x9", [("token", "x9")]),
        ("dbPassword = x9", [("password", "x9")]), ("accessToken: x9", [("token", "x9")]), ("myAPIKey=x9", [("apikey", "x9")]), ("dbpassword=x9", [("password", "x9")]),
        ("aws_access_key_id=x9", [("access_key", "x9")]), ("api_key_v2=x9", [("api_key", "x9")]), ("passwordHash: x9", [("password", "x9")]), ("password2: x9", [("password", "x9")]), ("db.password.value=x9", [("password", "x9")]),
        ("credentials: x9", [("credential", "x9")]), ("API_KEYS=x9", [("api_key", "x9")]), ("tokens = 'x9'", [("token", "x9")]), ("secret_key=x9", [("secret_key", "x9")]), ("PASSWORDS=x9", [("password", "x9")]),
        ('password = "x9 y  \nnext"', [("password", "x9 y")]), ("password = 'x9", [("password", "x9")]), ('password = ""', []),
        ("credentials:\n  password: x9", [("credential", "password"), ("password", "x9")]), ('"credentials": "password=x9"', [("credential", "password=x9"), ("password", "x9")]),
        ("bypass: a; COMPASS: b; tokenizer = c; passenger: d; SECRETARY: e", []),
    ],
)
def test_contexts_are_whole(text, found):
    import re

    got = list(S.credential_values(text))
    assert [(k, v) for k, _, v in got] == found and all(text[at : at + len(v)] == v for _, at, v in got)
    assert not found or re.search(S.HINT, text)


def test_long_names_take_time_in_proportion(spark):
    texts = ["token_" * 200_000, "token " + " " * 1_000_000, "token_" * 100_000 + "=x9"]
    assert [list(S.credential_values(t)) for t in texts] == [[], [], [("token", 600_001, "x9")]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "dbPassword\u00a0=            'x9"])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["key"]) for r in S.scan_secrets(df).collect()) == [(2, "token"), (3, "password")]


def test_scan(spark, odd_docs, no_docs):
    rows = [(1, "a token = 'Zk3v9QpX7wLm2Rt8' and password=changeme!"), (1, "a token = 'Zk3v9QpX7wLm2Rt8' and password=changeme!"), (2, None), (3, ""), (None, "pwd: hunter2 " + "x " * 50_000 + "secret=" + "ab" * 20_000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, position int, key string")
    got = sorted(((r["doc_id"], r["key"], r["position"], r["length"], r["is_secret"]) for r in S.scan_secrets(df).collect()), key=repr)
    one = [(1, "password", 42, 8, False), (1, "token", 11, 16, True)]
    assert got == sorted([*one, *one, (None, "pwd", 5, 7, False), (None, "secret", 100020, 40_000, False)], key=repr)
    assert S.scan_secrets(odd_docs).collect() == [] and S.scan_secrets(no_docs).collect() == []


def test_the_hint_lets_every_context_through():
    import re

    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice(["pass", "word", "pwd", "secret", "_key", "api", "-", "_", "token", "Auth", "client", "access", "private", "key", "credential", "code", "=", ":", "=>", ":=", " ", '"', "'", "v1", "phrase"]) for _ in range(8))
        if S.CONTEXT.search(t):
            assert re.search(S.HINT, t), t
