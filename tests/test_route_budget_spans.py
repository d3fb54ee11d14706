import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import budget as B
from corpusmill.operators import delta as V
from corpusmill.operators import route as Q
from corpusmill.operators import shape as K
from corpusmill.operators import spans as X


def test_numbers(mapped):
    cases = {
        "4532 1234 5678 9012": "4532123456789012",
        "DE89 3704 0044 0532 0130 00": "DE89370400440532013000",
        "+49 176 123 456 78": "+4917612345678",
        "11.04.2026": "11042026",
        "A1B2-C3D4-E5F6": None,
        "Hello World": None,
        "12 34\n56": None,
        "123456": None,
        "": None,
    }
    assert mapped(Q.compact_number, *cases) == list(cases.values())


def test_terms(mapped):
    cases = {
        "myFunctionName": {"my", "function", "name"},
        "XMLParser load_config": {"xml", "parser", "load", "config"},
        "path/to/file.py": {"path", "to", "file", "py"},
        "a B getS": {"get"},
    }
    assert [set(x) for x in mapped(Q.split_terms, *cases)] == list(cases.values())


def test_relevance(mapped):
    score = lambda q, **k: mapped(lambda t: Q.relevance(t, q, **k), "loadConfig file", "x" * 3000 + " config")
    assert score("config loader") == [0.5, 0.5]
    assert score("config loader", head_chars=2000) == [0.5, 0.0]
    assert score("") == [1.0, 1.0] and score("a ?") == [1.0, 1.0]


def test_intents_change_steps(spark):
    code = "def run(a):\n    x = 1\n    return x\n" * 3
    df = spark.createDataFrame([(1, "m.py", code), (2, "d.json", '{"a": [1,2,3,4], "s": "%s"}' % ("x" * 60))],
                               "doc_id int, name string, text string")
    by = lambda intent: {r.doc_id: r.routed for r in Q.smart_route(df, intent=intent).collect()}
    review, data = by("code_review"), by("extract_data")
    assert "skeleton" not in review[1].strategy_used and review[1].confidence == 0.99
    assert data[1].text == "\n".join(["def run(a):"] * 3) and data[1].confidence == 0.90
    shrunk = json.loads(data[2].text)
    assert shrunk["a"] == [1, 2, "...(2 more items)"] and shrunk["s"].endswith("...(20 more chars)")
    assert by("nonsense")[1] == by("understand")[1]


def test_original_tokens_are_counted_before_anything(spark):
    df = spark.createDataFrame([(1, None, "the the the the word")], "doc_id int, name string, text string")
    r = Q.smart_route(df).first().routed
    assert (r.original_tokens, r.compressed_tokens) == (6, 1)


def test_explain_recommends_best_safe_intent(spark):
    code = "def run(a):\n    x = 1\n    return x\n" * 3
    df = spark.createDataFrame([(1, "m.py", code), (2, None, "the plain words")], "doc_id int, name string, text string")
    got = {r.doc_id: r.explained for r in Q.explain_compression(df).collect()}
    best = max((i for i in got[1].per_intent if i.confidence >= 0.85), key=lambda i: i.saved_percent)
    assert got[1].recommended_intent == best.intent == "understand"
    for i in got[1].per_intent:
        want = Q.smart_route(df.where("doc_id = 1"), intent=i.intent).first().routed
        assert (i.result_tokens, i.saved_percent, i.confidence) == (
            want.compressed_tokens, want.saved_percent, want.confidence)
    assert got[2].content_type == "prose"


def test_variants(texts):
    rows = Q.build_variants(texts("the cat is the best", "4532 1234", "cat")).orderBy("doc_id").collect()
    labels = [[v.label for v in r.variants] for r in rows]
    assert labels == [["Original", "Compressed"], ["Original", "Compact"], ["Original"]]


def model_allocation(docs, budget):
    """(key, weight) of one group -> {key: share}, by the rule."""
    total = sum(w for _, w in docs) or 1
    shares = {k: budget * w // total for k, w in docs}
    kept = {k: s for k, s in shares.items() if s >= 200}
    if kept:
        return kept
    equal = budget // len(docs)
    if equal >= 200:
        return {k: equal for k, _ in docs}
    return {max(docs, key=lambda d: (d[1], -d[0]))[0]: budget}


def test_allocation_equals_rule(spark):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        n = rng.choice([1, 2, 5, 30, 200])
        rows += [(g, k, rng.choice([0, 0, 1, 2, 9]) if g % 5 else 0) for k in range(n)]
    df = spark.createDataFrame(rows, "g int, k int, weight bigint")
    for budget in (200, 1000, 10000):
        got = {}
        for r in B.allocate_budget(df, budget, "g", "k").collect():
            got.setdefault(r.g, {})[r.k] = r.allocated
        want = {g: model_allocation([(k, w) for x, k, w in rows if x == g], budget) for g in range(40)}
        assert got == want


def test_pack(spark):
    rows = [(1, "s", "main.py", "def load_config():\n    return 1\n"),
            (2, "s", "README.md", "# Config\nHow to load the config file\n"),
            (3, "s", "server.log", "\n".join(f"2025-01-{d:02d} INFO event {d}" for d in range(1, 31)))]
    df = spark.createDataFrame(rows, "doc_id int, source string, name string, text string")
    pack = B.context_pack(df, "load config", 1000).first()
    assert pack.files_included == 2 and pack.files_skipped == 1
    assert pack.packed_context.startswith("--- main.py ---\n") and "--- README.md ---" in pack.packed_context
    assert pack.tokens_used <= 1000
    with pytest.raises(ValueError):
        B.context_pack(df, "load config", 199)


def test_recent_and_structure(mapped):
    log = "\n".join(f"2025-01-{d:02d} INFO Event {d}" for d in range(1, 51))
    tail = mapped(lambda t: B.recent_lines(t, 20), log)[0].split("\n")
    assert tail == log.split("\n")[-4:]  # 16 words are 20 tokens
    assert mapped(lambda t: B.recent_lines(t, 0), log) == [""]
    doc = "intro\n# A\nfirst\nsecond\n\nthird\n## B\n### C\nlast\nmore"
    assert mapped(B.structure_lines, doc, "only text") == ["# A\nfirst\n\n## B\n### C\nlast", "only text"]


def test_budget_priorities(spark):
    log = "\n".join(f"2025-01-{d:02d} INFO Event {d}" for d in range(1, 51))
    code = "class A:\n    def f(self):\n        return 1\n" * 40
    rows = [(1, "a.log", log), (2, "a.py", code), (3, "a.txt", "short")]
    df = spark.createDataFrame(rows, "doc_id int, name string, text string")
    got = {r.doc_id: r.loaded for r in B.budget_load(df, 40).collect()}
    assert got[1].priority_used == "recent" and got[1].text.endswith("Event 50") and got[1].result_tokens <= 40
    assert got[2].priority_used == "signatures" and "return" not in got[2].text
    assert got[3].is_complete and got[3].text == "short"


def test_spans_round_trip(mapped, texts):
    text = (
        "Use `a` here\n```py\nx = `no`\n```\n    y = f(1)\n    if y:\n        return y\nplain\n"
        "| a | b |\n| 1 | 2 |\nYou must NEVER stop `b`\n    not code\n    at all\n    here\nend"
    )
    df = X.placeholder_text(texts(text))
    row = df.select("lifted", X.reinsert(F.col("lifted.text"), F.col("lifted")).alias("back")).first()
    assert row.lifted.code == ["```py\nx = `no`\n```", "    y = f(1)\n    if y:\n        return y\n"]
    assert row.lifted.tables == ["| a | b |\n| 1 | 2 |\n"]
    assert row.lifted.refs == ["`a`", "`b`"]
    assert row.lifted.rules == ["You must NEVER stop ⟨REF_1⟩"]
    assert row.back == text


def test_long_blocks_do_not_overflow(mapped):
    code = "\n".join(f"    x{i} = f({i})" for i in range(20000))
    table = "\n".join(f"| {i} | a |" for i in range(20000)) + "\n"
    assert len(mapped(X.lift_code, code)[0].spans) == 1
    assert mapped(X.lift_tables, "t\n" + table + "end")[0].text == "t\n⟨TABLE_0⟩\nend"


def test_lost_values(spark):
    raw = "On 12.04.2026 (Monday) TODO v1.2.3 until 5, 07 and 42 or 1234"
    df = spark.createDataFrame([(raw, "On Monday until"), (raw, raw)], "a string, b string")
    lost, none = [r.l for r in df.select(X.lost_values(F.col("a"), F.col("b")).alias("l")).collect()]
    got = {k.kind: (k.lost, k.samples) for k in lost}
    assert got["numbers"] == (4, ["12", "1234", "2026", "42"])
    assert got["dates"] == (1, ["12.04.2026"]) and got["todos"] == (1, ["TODO"])
    assert "weekdays" not in got and "deadlines" not in got
    assert got["versions"][1][0] == "04.2026" or "v1.2.3" in got["versions"][1]
    assert none == []


def test_requests_hide_secrets_and_bad_rewrites_are_rejected(spark, texts):
    key = "gh" + "p_" + "0123456789abcdef" * 2 + "abcd"
    df = texts(f"Token {key} in `code` and the long rest of the text 2026", "few words", " ")
    requests = X.prompt_requests(df)
    sent = {r.doc_id: json.loads(r.request) for r in requests.collect()}
    assert set(sent) == {0, 1}
    user = sent[0]["messages"][1]["content"]
    assert key not in user and "⟨REF_0⟩" in user and sent[0]["max_tokens"] == 4000
    responses = spark.createDataFrame([(0, "Token ⟨REF_0⟩ rest"), (1, "not any shorter at all")], "doc_id bigint, response string")
    out = {r.doc_id: r for r in X.accept_shorter(requests, responses).collect()}
    assert out[0].compressed_text == "Token `code` rest" and out[0].error is None
    assert out[0].warnings == ["[numbers] lost 1: 2026"]
    assert out[1].compressed_text == "few words" and out[1].error and out[1].saved_percent == 0.0


def test_delta_modes(spark):
    old = spark.createDataFrame([(1, "a\nb\nc"), (2, "x"), (3, "gone"), (4, "l\n" * 50)], "doc_id int, text string")
    new = spark.createDataFrame([(1, "a\nb\nc"), (2, "y"), (5, "new"), (4, "l\n" * 50 + "m")], "doc_id int, text string")
    got = {r.doc_id: r for r in V.delta_mode(old, new, "doc_id").collect()}
    assert (got[1].mode, got[1].saved_percent) == ("unchanged", 100.0)
    assert (got[2].mode, got[2].change_type) == ("full", "modified")
    assert (got[4].mode, got[4].change_type, got[4].lines_added) == ("delta", "added", 1)
    assert (got[5].mode, got[5].change_type) == ("full", "full") and 3 not in got
    status = {r.doc_id: r.status for r in V.changed_docs(old, new, "doc_id").collect()}
    assert status == {1: "same", 2: "changed", 3: "gone", 4: "changed", 5: "new"}
    diff = V.delta_text(V.snapshot_pairs(old, new, "doc_id"), "doc_id").collect()
    assert {r.doc_id for r in diff} == {2, 4} and all(r.changes.startswith("---") for r in diff)


def test_recent_versions_cap_and_refresh(spark):
    rows = [(i, f"text {i}") for i in range(150)] + [(200, "text 0")]
    stores = spark.createDataFrame(rows, "ts int, text string")
    kept = V.keep_recent_versions(stores, "ts").collect()
    assert len(kept) == 100 and max(r.stored_at for r in kept) == 200
    assert {r.stores for r in kept} == {1, 2}


def test_json_shapes(spark):
    rows = [(1, '{"a": {"b": [1, "%s", 3, 4]}, "e": [], "n": null}' % ("x" * 50)), (2, "no json")]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {(r.id, r.path): (r.type, r.value) for r in K.json_leaves(df, "id", "j").collect()}
    assert got[(1, "$.a.b[0]")] == ("bigint", "1")
    assert got[(1, "$.a.b[1]")] == ("string", "x" * 40 + "...(10 more chars)")
    assert got[(1, "$.a.b[]")] == ("omitted", "...(2 more items)")
    assert got[(1, "$.n")][0] == "void" and got[(2, "$")] == ("invalid", "no json")


def test_outlines(mapped):
    py = "import os\n@cached\nclass A(B):\n    x = 1\n    async def f(self):\n        return 1\ndef g(): pass"
    assert mapped(K.python_outline, py) == ["@cached\nclass A(B):\n    async def f(self):\ndef g(): pass"]
    js = "import a from 'b'\nlet q = 1\nfunction f(a) {\n  if (a) {\n  static x = 1\nconst g = (a) => {\n}"
    assert mapped(K.script_outline, js)[0].split("\n")[:2] == ["import a from 'b'", "function f(a) { /* stripped */ }"]


def test_relevant_documents_equal_a_full_comparison(spark):
    rng = random.Random(6)
    words = [f"w{k:02d}" for k in range(40)] + ["theTerm", "of", "and"]
    text = lambda n, weights: " ".join(rng.choices(words, weights, k=n))
    skew = [1] * 40 + [5, 60, 60]
    docs = [(k, text(rng.randint(0, 30), skew)) for k in range(400)] + [(400, None), (401, ""), (1, "w01 w02")]
    asked = [(k, text(rng.randint(1, 9), [2] * 40 + [1, 6, 6])) for k in range(15)] + [(50, None), (51, "unknown term"), (3, "w39 w38")]
    terms = lambda t: {x for x in re.split(r"[\W_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", t or "").lower()) if len(x) >= 2}
    held, wanted = {}, {}
    for k, t in docs:
        held.setdefault(k, set()).update(terms(t))
    for k, t in asked:
        wanted.setdefault(k, set()).update(terms(t))
    want = set()
    for q, ts in wanted.items():
        hits = sorted((-len(ts & h), d) for d, h in held.items() if ts & h)
        want |= {(q, d, -n, len(ts), r + 1) for r, (n, d) in enumerate(hits[:7])}
    d = spark.createDataFrame(docs, "doc_id int, text string")
    b = spark.createDataFrame(asked, "item_id int, text string")
    for seeds in (1, 40, 5000):
        got = Q.relevant_documents(d, b, 7, seeds=seeds)
        assert {tuple(r) for r in got.collect()} == want
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    assert Q.relevant_documents(d.limit(0), b).collect() == [] and Q.relevant_documents(d, b.limit(0)).collect() == []
