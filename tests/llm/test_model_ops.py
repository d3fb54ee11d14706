"""Language, URLs, pseudonyms, rollups: learned and keyed operators."""

import datetime as dt
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import prose, row
from pyspark.sql import functions as F

from corpusmill.llm import catalog, language, rollup, urls
from corpusmill.llm import pseudonyms as P

SF = "/root/testdata/sf0.01"
VOCAB = f"{catalog.TOKENIZERS}/byte_bpe_50k.tiktoken"


KEY = b"a key for the tests only"


# ------------------------------------------------------------------ language


def test_codewords_differ_widely():
    for n in (1, 2, 3, 4, 7, 8, 40):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n
        if n > 2:
            far = min((code[a] != code[b]).mean() for a in range(n) for b in range(a))
            assert far > 0.2
            assert (np.abs(code.sum(0)) < n).all()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    out = [r for r in got if r.held_out and r.n_chars > 40]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98


def test_language_prediction_reads_text_only(frame):
    texts = [("en", "the quick brown fox and the dog "), ("de", "der schnelle braune fuchs und der hund ")]
    train = [row(k, texts[k % 2][1] * 5, texts[k % 2][0]) for k in range(40)]
    held = next(k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 4 == 2)
    probe = [row(held, texts[0][1], "de"), row(held, texts[1][1], None), row(held, "12 34", "en"), row(held, None, "en")]
    got = [r for r in language.identify(frame(train + probe)).collect() if r.doc_id == held]
    assert Counter(r.lang_pred for r in got) == {"en": 1, "de": 1, "und": 2}
    assert all(r.score == 0 and r.ambiguous for r in got if r.lang_pred == "und")


def test_language_odd_rows(frame, odd, monkeypatch):
    docs = frame(odd)
    got = language.identify(docs).collect()
    assert len(got) == len(odd)
    for r, o in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(odd, key=lambda r: str(r[0])), strict=True):
        if r.doc_id not in (None, 9):
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in o[1] or ""))
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and all(any(c.isalpha() for c in r.text) for r in kept.collect())
    assert language.identify(docs.limit(0)).collect() == [] and language.accepted(docs.limit(0)).collect() == []
    whole = sorted(map(str, got))
    monkeypatch.setattr(language, "BLOCK", 1000)
    data = np.frombuffer(odd[9][1].encode(), np.uint8)
    ends = np.array([0, len(data)])
    parts = [language.grams(p, c, 64, s)[0] for _, _, p, c, s in language.pieces(data, ends)]
    assert len(parts) > 10
    assert sorted(np.concatenate(parts)) == sorted(language.grams(data, ends, 64)[0])
    assert len(whole) == len(odd)


def plain_grams(text, buckets):
    b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in text.encode()]
    out = Counter()
    for i in range(len(b)):
        key = 0
        for n in range(1, min(5, len(b) - i + 1)):
            key = (key * 0x01000193 % 2**32) ^ b[i + n - 1]
            if b[i] != 32 or b[i + n - 1] != 32:
                out[(key * 0x9E3779B1 % 2**32 >> 7) % buckets] += 1
    return out


def plain_prediction(docs, buckets):
    """Counts, bits and decoding of the documents (id, text, lang), without arrays."""
    taught = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 != 2 and d[1] is not None and d[2] is not None]
    names = sorted({d[2] for d in taught})
    share = []
    for name in names:
        n = sum((plain_grams(d[1], buckets) for d in taught if d[2] == name), Counter())
        share.append([(n[b] + 0.5) / (n.total() + 0.5 * buckets) for b in range(buckets)])
    code = language.codewords(len(names)).tolist()
    bits = range(len(code[0]))
    mean = lambda rows, b: sum(r[b] for r in rows) / len(rows)
    weights, trust = [], []
    for k in bits:
        sides = [[s for s, c in zip(share, code) if c[k] == side] for side in (1, -1)]
        weights.append([math.log(mean(sides[0], b)) - math.log(mean(sides[1], b)) for b in range(buckets)])
        trust.append(max(min(sum(x * y for x, y in zip(s, weights[k])) * c[k] for s, c in zip(share, code)), 1e-3))
    out = {}
    for i, text, _ in docs:
        grams = plain_grams(text or "", buckets)
        if not any(c.isalpha() for c in text or ""):
            out[i] = ("und", 0.0, True)
            continue
        mean_bits = [sum(weights[k][b] * n for b, n in grams.items()) / grams.total() for k in bits]
        loss = [
            sum(t * math.log1p(math.exp(-8 * m * c)) for t, m, c in zip(trust, mean_bits, word)) / sum(trust) for word in code
        ]
        best = min(range(len(names)), key=lambda x: loss[x])
        lead = sorted(loss)[1] - sorted(loss)[0]
        out[i] = (names[best], 1 / sum(math.exp(-4 * (x - min(loss))) for x in loss), lead < language.LEAD * math.log(2))
    return out


def test_language_equals_a_plain_model(spark):
    """All predictions of the table's first language samples, and odd texts, against loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 600").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()][:120] + [(9001, None, "en"), (9002, "12 .", "de"), (9003, "Ü", None), (9004, "", "fr")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    buckets = 256
    model = language.train(frame.where(~language.held_out()), "lang", "text", buckets)
    got = {r.doc_id: r for r in language.predict(frame, ["doc_id"], "text", model).collect()}
    want = plain_prediction(rows, buckets)
    assert len({w[0] for w in want.values()}) >= 4
    for k, (name, score, unsure) in want.items():
        assert got[k].lang_pred == name and got[k].ambiguous == unsure
        assert got[k].score == pytest.approx(score, abs=1e-6)


def test_language_with_more_labels_than_a_model_has(frame, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    rows = [row(k, f"{'abc'[k % 3] * 4} " * 5, "xyz"[k % 3]) for k in range(60)]
    rows += [row(100 + k, "dirty label here", f"label {k}") for k in range(40)]
    got = language.identify(frame(rows)).collect()
    assert len(got) == 100 and {r.lang_pred for r in got} <= {"x", "y", "z"}
    assert all(r.lang_pred == "xyz"[r.doc_id % 3] for r in got if r.doc_id < 60)
    assert language.accepted(frame(rows)).count() >= 60


def test_language_nothing_learned(frame):
    docs = frame([row(1, "abc", None), row(2, "12", None)])
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"und"}
    assert [r.doc_id for r in language.accepted(docs).collect()] == [1]


# ---------------------------------------------------------------------- urls


def plain_verdict(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or ("", ""), (rule, verdict), key=lambda x: len(x[0]))
    return host, path, best


def test_urls_against_python(spark):
    odd = [
        None, "", "no scheme/net/", "http://", "http://a.NET", "http://a.NET/", "https://x.example.net/en/1?q=/fr/",
        "http://example.net/en", "http://notexample.net/en/1", "http://ÄB.example.COM/de/1#x", "ftp://org/fr/?a#b",
        "http://forg/fr/", "a://b://c.net/x", "http://a.org/fr/" + "x" * 100_000, "http://a.net?x=/", "http://a.net#/",
    ]
    pages = spark.createDataFrame([(k, u, "h", "x", 1) for k, u in enumerate(odd)], "page_id bigint, url string, host string, rule string, score int")
    got = urls.url_verdicts(pages).collect()
    assert len(got) == len(odd)
    for r in got:
        host, path, best = plain_verdict(odd[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best[0] if best else None)
        assert r.verdict == (best[1] if best else "block" if r.score >= 0.5 else "allow")
    assert urls.url_verdicts(pages.limit(0)).collect() == []
    assert urls.url_verdicts(pages.unionByName(pages)).count() == 2 * len(odd)


def test_urls_model_holds_out():
    """Trained on four fifths of the table, the model tells most of the rest."""
    hit = n = 0
    for fold in range(5):
        w = urls.fit([x for k, x in enumerate(urls.TABLE) if k % 5 != fold])
        for k, (u, label) in enumerate(urls.TABLE):
            if k % 5 == fold:
                h, _, p = u.partition("/")
                at = urls.features(h, "/" + p)
                hit += (w[at].sum() / np.sqrt(len(at)) + w[-1] > 0) == bool(label)
                n += 1
    assert hit / n > 0.75


def test_urls_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in catalog.op7_url_filters(spark, SF).collect()}
    for p in pages.collect():
        host, path, best = plain_verdict(p.url)
        assert (got[p.page_id].host, got[p.page_id].path, got[p.page_id].rule) == (host, path, best and best[0])
    bad = [r for r in got.values() if re.search("casino|adult|bets|spam|ads-|pills", r.host) and not r.rule]
    good = [r for r in got.values() if not re.search("casino|adult|bets|spam|ads-|pills", r.host) and not r.rule]
    assert all(r.verdict == "block" for r in bad) and all(r.verdict == "allow" for r in good)


# ---------------------------------------------------------------- pseudonyms


def test_permutation_is_one_to_one():
    for size in (1, 2, 7, 100, 1000):
        assert sorted(P.permuted(x, size, KEY, "t") for x in range(size)) == list(range(size))
    assert [P.permuted(x, 50, b"k1", "t") for x in range(50)] != [P.permuted(x, 50, b"k2", "t") for x in range(50)]


VALUES = {
    "card": ["4785380592391139", "4785-3805-9239-1139", "4785 3805 9239 1139", "378282246310005"],
    "iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "ssn": ["123-45-6789"],
    "ip": ["152.143.123.131", "8.8.8.8"],
    "date": ["1999-02-28", "28.02.1999", "02/28/1999"],
    "phone": ["+1 (743) 555-3824", "+49 30 12345678", "743-555-3824", "(743) 555-3824"],
    "email": ["hein.19@mail5.example.com", "a.b+c@x-y.org"],
    "secret": ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "api_key: AKx9Zq81mmPq77"],
}


@pytest.mark.parametrize("kind", sorted(VALUES))
def test_values_are_replaced_in_format(kind):
    for value in VALUES[kind]:
        for text in (value, f"see {value}, again {value}.", f"({value})", f"x {value}### y"):
            out, counts = P.hidden(text, KEY)
            assert counts == {kind: text.count(value)} and value not in out and len(out) >= len(text) - 8
            again, c2 = P.hidden(out, KEY)
            assert c2 == counts, "a pseudonym passes the check of its kind"


def test_equal_values_stay_linked():
    plain = lambda t: re.sub(r"\D", "", P.hidden(t, KEY)[0])
    assert plain("4785380592391139") == plain("4785-3805-9239-1139")
    iban = [P.hidden(t, KEY)[0].replace(" ", "") for t in VALUES["iban"][:2]]
    assert iban[0] == iban[1]
    read = lambda t, f: dt.datetime.strptime(P.hidden(t, KEY)[0], f).date()
    assert read("1999-02-28", "%Y-%m-%d") == read("28.02.1999", "%d.%m.%Y") == read("02/28/1999", "%m/%d/%Y")


def test_what_fails_its_check_stays():
    text = (
        "2123465659789240 1.2.3 V2.0. 999.1.1.1 1999-02-30 000-12-3456 DE88370400440532013000 a@b @x 12345 "
        "1.2.3.4.5 token = none 1111111111111111 BY-NC 4.0."
    )
    assert P.hidden(text, KEY) == (text, {})


LEFT_BEFORE = [
    ("root@10.0.0.1", "10.0.0.1", "ip"),
    ("ssh root@10.0.0.1:22", "10.0.0.1", "ip"),
    ("joe@example.com.2", "joe@example.com", "email"),
    ("joe@example.com-x", "joe@example.com", "email"),
    ("joe@example.com_x", "joe@example.com", "email"),
    ("joe@example.com..", "joe@example.com", "email"),
    ("at 2024-01-31T10:00:00 on", "2024-01-31", "date"),
    ("2024-01-31Z", "2024-01-31", "date"),
    ("_joe@example.com", "joe@example", "email"),
    (".joe@example.com", "joe@example", "email"),
    ("müller@example.com", "ller@example", "email"),
    ("дима@example.com", "дима", "email"),
    ("joe@müller.de", "joe@m", "email"),
    ("DE89 3704 0044 0532 0130 00 THIS", "DE89 3704 0044 0532 0130 00", "iban"),
    ("ZZ99 4785 3805 9239 1139", "4785 3805 9239 1139", "card"),
    ("password: 743-555-3824", "743-555-3824", "phone"),
]


@pytest.mark.parametrize("text, value, kind", LEFT_BEFORE)
def test_values_inside_or_beside_what_fails(text, value, kind):
    for around in ("{}", "see {} and", "({})"):
        whole = around.format(text)
        out, counts = P.hidden(whole, KEY)
        assert value not in out and counts == {kind: 1}
        assert P.hidden(out, KEY)[1] == counts


def test_values_linked_whatever_follows_them():
    stamp = lambda t: P.hidden(t, KEY)[0]
    assert stamp("2024-01-31T10:00:00") == stamp("2024-01-31") + "T10:00:00"
    assert stamp("joe@example.com.2") == stamp("joe@example.com") + ".2"
    assert stamp("root@10.0.0.1") == "root@" + stamp("10.0.0.1")
    many = [f"{c}@x.org" for c in "дёüñé中"] + [f"a{k}ü@x.org" for k in range(200)]
    assert len({stamp(t) for t in many}) == len(many)


def test_pseudonyms_over_rows(frame, odd):
    rows = [*odd, row(50, "mail a.b@c.org"), row(51, "to a.b@c.org. " + "x" * 300_000 + " 8.8.8.8")]
    got = {(r.doc_id, r.text is None): r for r in P.pseudonymised(frame(rows), KEY).collect()}
    assert P.pseudonymised(frame(rows), KEY).count() == len(rows)
    assert got[3, True].n_found == 0 and got[1, False].text == odd[0][1]
    assert got[50, False].text[5:] in got[51, False].text and got[51, False].n_ip == 1
    assert P.pseudonymised(frame(rows).limit(0), KEY).collect() == []


def test_planted_values_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in P.pseudonymised(docs, KEY).collect()}
    find = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|\+1 \(\d{3}\) \d{3}-\d{4}")
    n = 0
    for d in docs.collect():
        for value in find.findall(d.text):
            n += 1
            assert value not in got[d.doc_id].text
        if not find.search(d.text) and not re.search(r"\d{13}|token", d.text):
            assert got[d.doc_id].text == d.text
    assert n > 30


# ------------------------------------------------------------------- rollups


CHANGE = "doc_id bigint, op string, source string, lang string, tokenizer_version string, n_tokens bigint, seq bigint"


def test_rollup_against_python(spark, tmp_path):
    state = str(tmp_path / "state")
    batches = {
        1: [(1, "insert", "a", "en", "v1", 10, 0), (2, "insert", "a", None, "v1", 5, 0), (3, "insert", None, "en", "v1", 7, 0),
            (4, "insert", "b", "en", "v1", None, 0), (None, "insert", "b", "en", "v1", 2, 0), (None, "insert", "b", "en", "v1", 2, 0)],
        2: [(1, "revise", "a", "en", "v2", 12, 0), (2, "delete", None, None, None, None, 0), (9, "delete", None, None, None, None, 0),
            (3, "revise", None, "en", "v1", 1, 0), (3, "revise", None, "en", "v1", 8, 5), (None, "delete", "b", "en", "v1", 2, 0)],
        5: [(2, "insert", "a", "fr", "v2", 4, 0), (1, "insert", "b", "en", "v2", 1, None), (1, "insert", "b", "en", "v2", 1, None)],
    }
    live, alone = {}, []
    for b, rows in batches.items():
        df = spark.createDataFrame(rows, CHANGE)
        assert rollup.commit(spark, state, b, df)
        for r in sorted(rows, key=lambda r: -1 if r[6] is None else r[6]):
            if r[0] is None:
                alone += [r] if r[1] == "insert" else []
            elif r[1] == "delete":
                live.pop(r[0], None)
            else:
                live[r[0]] = r
        for again in [x for x in batches if x <= b]:
            assert not rollup.commit(spark, state, again, spark.createDataFrame(batches[again], CHANGE))
        want = {}
        for r in [*live.values(), *alone]:
            n, t = want.get(r[2:5], (0, 0))
            want[r[2:5]] = (n + 1, t + (r[5] or 0))
        assert {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals(spark, state).collect()} == want
    with pytest.raises(ValueError):
        rollup.commit(spark, state, 3, spark.createDataFrame([], CHANGE))
    assert rollup.committed(spark, state) == [1, 2, 5]


def test_a_batch_that_died_is_written_again(spark, tmp_path):
    state = str(tmp_path / "state")
    one = spark.createDataFrame([(1, "insert", "a", "en", "v", 3, 0)], CHANGE)
    one.write.parquet(f"{state}/ledger/1")
    one.select("source", "lang", "tokenizer_version").write.parquet(f"{state}/rollup/1")
    assert rollup.totals(spark, state).collect() == []
    assert rollup.commit(spark, state, 1, one)
    assert rollup.totals(spark, state).first().n_tokens == 3
    rollup.removed(spark, state)
    assert rollup.committed(spark, state) == []


def test_tokens_of_parts_equal_the_whole(frame, odd):
    vocab = rollup.vocabulary(VOCAB)
    enc = rollup.encoder(vocab)
    text = "The cat's 12 hats,  and\n more été zz9 _x y " * 200
    for most in (1, 7, 50, 1000):
        assert sum(len(enc.encode_ordinary(p)) for p in rollup.spans(text, most)) == len(enc.encode_ordinary(text))
    got = rollup.with_tokens(frame(odd), "text", vocab, ["doc_id", "text"]).collect()
    assert all(r.n_tokens == len(enc.encode_ordinary(r.text or "")) for r in got) and len(got) == len(odd)


def test_token_counts_query(spark):
    enc = rollup.encoder(rollup.vocabulary(VOCAB))
    want = {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        k = (d.source, d.lang, catalog.BPE_VERSION)
        n, t = want.get(k, (0, 0))
        want[k] = (n + 1, t + len(enc.encode_ordinary(d.text or "")))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in catalog.op8_token_counts(spark, SF).collect()} == want


def test_token_counts_cover_short_and_null_documents(spark, frame, odd, tmp_path):
    docs = frame([*odd, row(11, "two words", "en", "z"), row(11, prose(4), "en", "z")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    enc = rollup.encoder(rollup.vocabulary(VOCAB))
    got = catalog.op8_token_counts(spark, str(tmp_path)).collect()
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    assert sum(r.n_docs for r in got) == ids + docs.where("doc_id IS NULL").count()
    assert [tuple(r)[2:] for r in got if r.source == "z"] == [(catalog.BPE_VERSION, 1, len(enc.encode_ordinary(prose(4))))]
