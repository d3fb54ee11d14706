import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import tables as T
from corpusmill.operators import redact as R
from corpusmill.operators import tokens as N

UUID = "123e4567-e89b-12d3-a456-426614174000"
BLOB = "dGhpcyBpcyBhIHZlcnkgbG9uZyBzZWNyZXQga2V5IQ0KZz8"


def test_known_shapes(mapped):
    hexa = "0123456789abcdef" * 3
    cases = {
        "id AK" + "IA" + "ABCDEFGHIJ012345 x": "id [AWS_KEY_REDACTED] x",
        "sk" + "_live_" + hexa[:24]: "[STRIPE_KEY_REDACTED]",
        "sk" + "-proj-" + hexa[:32]: "[AI_API_KEY_REDACTED]",
        "gh" + "p_" + hexa[:36]: "[GH_TOKEN_REDACTED]",
        "a ey" + "Jabc.ey" + "Jdef.ghi b": "a [JWT_REDACTED] b",
        "-----BEGIN RSA PRIV" + "ATE KEY-----\nx\n-----END RSA PRIV" + "ATE KEY-----": "[PRIVATE_KEY_REDACTED]",
        "AWS_SECRET" + "_ACCESS_KEY = " + "a1B2" * 10: "[AWS_SECRET_REDACTED]",
        "plain text": "plain text",
        "": "",
    }
    assert mapped(R.redact_known, *cases) == list(cases.values())


def test_user_patterns_add_and_replace(mapped):
    out = mapped(lambda t: R.redact_known(t, {"[TICKET]": r"T-\d+"}), "see T-12 and T-3")
    assert out == ["see [TICKET] and [TICKET]"]


def test_addresses_by_context(mapped):
    cases = {
        "python 3.10.2.1 on 10.0.0.1": "python 3.10.2.1 on [IP_REDACTED]",
        "version 1.2.3.4 v 1.2.3.4": "version 1.2.3.4 v 1.2.3.4",
        "999.1.2.3.4": "999.1.2.3.4",
        "127.0.0.1, 256.1.1.1": "[IP_REDACTED], 256.1.1.1",
        # the window of 30 characters cuts 'xpython' so that only 'python' is seen
        "x" + "python" + " " * 24 + "1.2.3.4": "xpython" + " " * 24 + "1.2.3.4",
    }
    assert mapped(R.redact_ips, *cases) == list(cases.values())


def test_uuids_by_context(mapped):
    tag = "[UUID_REDACTED]"
    cases = {
        f"https://x.org/api/{UUID}": f"https://x.org/api/{UUID}",
        f"correlation_id: {UUID}": f"correlation_id: {UUID}",
        f"the password {UUID}": f"the password {tag}",
        f"secret {UUID} {UUID}": f"secret {tag} {tag}",
        f"alone {UUID}": f"alone {UUID}",
        f"secret {'x' * 81}{' '}{UUID}": f"secret {'x' * 81}{' '}{UUID}",
    }
    assert mapped(R.redact_uuids, *cases) == list(cases.values())


def test_entropy_rule(mapped):
    cases = {
        f"a ({BLOB}) b": "a ([SECRET_REDACTED]) b",
        "thequickbrownfoxjumpsoverthelazydog": "thequickbrownfoxjumpsoverthelazydog",
        f"{BLOB}.x": f"{BLOB}.x",
        "0123456789abcdef" * 3: "0123456789abcdef" * 3,
    }
    assert mapped(R.redact_high_entropy, *cases) == list(cases.values())


def test_second_pass_sees_a_new_secret_word(mapped):
    text = f"x {BLOB} then {UUID}"
    once = mapped(R.redact, text)[0]
    twice = mapped(R.redact, once)[0]
    assert UUID in once and "[UUID_REDACTED]" in twice


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abcDEF0123+/=", min_size=1, max_size=60), min_size=30, max_size=30))
def test_entropy_equals_counting(tokens):
    from corpusmill.session import local_session

    spark = local_session(8)
    rows = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = {r.t: r.b for r in rows.select("t", R.shannon_bits(F.col("t")).alias("b")).collect()}
    for t in tokens:
        want = -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())
        assert abs(got[t] - want) < 1e-9


def test_token_count_is_words_times_factor(mapped):
    cases = ["", "  \n\t ", "one", "a b c", "x " * 10, "a\u00a0b\u2003c\x1cd", None]
    want = [int(len((t or "").split()) * 1.3) for t in cases]
    assert mapped(N.count_tokens, *cases) == want


def test_cost_and_windows(spark):
    row = spark.range(1).select(
        N.context_warning(F.lit(96_000)).alias("tie"),
        N.context_warning(F.lit(1000)).alias("none"),
        N.context_warning(F.lit(100), windows={"tiny": 100}).alias("user"),
        N.cost_cents(F.lit(1_000_000), F.lit(2.5)).alias("cents"),
        N.context_band(F.lit(74.99)).alias("band"),
    ).first()
    assert tuple(row.tie) == ("GPT-4o", 75.0)
    assert row.none is None and tuple(row.user) == ("tiny", 100.0)
    assert row.cents == 250.0 and row.band == "warn"


def test_cost_format(spark):
    values = [0.0, 0.0025, 0.01, 0.25, 1.0, 12.5, 1234.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    out = [r.s for r in df.orderBy("i").select(N.format_cost(F.col("v")).alias("s")).collect()]
    assert out == ["0.0000 ¢", "0.0025 ¢", "0.010 ¢", "0.250 ¢", "1.00 ¢", "12.50 ¢", "1234.50 ¢"]


def test_cut_to_budget(mapped):
    text = "abcd " * 20
    assert mapped(lambda t: N.cut_to_budget(t, F.lit(100)), text)[0] == (text, 26)
    cut = mapped(lambda t: N.cut_to_budget(t, F.lit(13)), text)[0]
    assert cut == (text[: int(len(text) * (13 / 26))], 13)
    assert mapped(lambda t: N.cut_to_budget(t, F.lit(0)), text)[0] == ("", 0)


def test_tokenizer_argument(mapped):
    assert mapped(lambda t: N.count_tokens(t, tokenizer=F.length), "abc") == [3]


def test_user_overrides_merge(spark):
    got = {r.key: r.value for r in N.dimension_table(spark, {"a": 1.0, "b": 2.0}, {"b": 3.0, "c": 4.0}).collect()}
    assert got == {"a": 1.0, "b": 3.0, "c": 4.0}


def test_signs_spare_no_secret(mapped):
    """With every sign gone each pattern runs on every text; the results are the same."""
    h = "0123456789abcdef" * 3
    texts = [
        "AK" + "IA" + "A1" * 8, "xAK" + "IA" + "A1" * 8, "Aws_Secret" + "_Access_Key = " + h[:40],
        "sk" + "_live-" + h[:20], "task" + "-live_" + h[:20], "sk" + "-proj-" + h[:20], "desk-" + h[:30], "gh" + "p_" + h[:36],
        "ey" + "J" + "a.ey" + "Jb.c", "-----BEGIN PRIV" + "ATE KEY-----x-----END PRIV" + "ATE KEY-----",
        "at 1.2.3.4, 1.2.3, version 1.2.3.4", "1.2.3.4.5", "secret " + "12345678-1234-1234-1234-123456789abc", "no secret",
    ]
    plain = {tag: pattern for tag, _, pattern in T.SECRET_PATTERNS}
    assert mapped(R.redact_known, *texts) == mapped(lambda t: R.redact_known(t, plain), *texts)
    for sign, pattern in ((R.IPV4_SIGN, T.IPV4), (R.UUID_SIGN, T.UUID)):
        both = mapped(lambda t: F.struct(t.rlike(sign).alias("a"), t.rlike(pattern).alias("b")), *texts)
        assert all(r.a or not r.b for r in both) and any(r.b for r in both)


def test_long_words_at_any_place(mapped):
    token = "aB3dE6gH9jK2mN5pQ8sT1vW4"
    gaps = ["", " ", "\n", "\t\t", "\x0b", " ", "\xa0"]
    texts = [a + token + b + token + c for a in gaps for b in gaps[1:] for c in gaps] + ["x" * 19 + " " + "y" * 30]
    whole = lambda t: R.replace_matches(
        t, R.LONG_WORD, lambda w, i, s: R.replace_matches(
            w, R.long_token(), lambda h, j, z: F.when(R.is_secret_token(h), F.lit(T.ENTROPY_TAG)).otherwise(h)
        )
    )
    assert mapped(R.redact_high_entropy, *texts) == mapped(whole, *texts)
