"""Queries without SQL against plain models of what they put together."""

import hashlib

from pyspark.sql import functions as F

from corpusmill.functions import tables as T
from corpusmill.operators import compress as C
from corpusmill.operators import detect as D
from corpusmill.operators import redact as R
from corpusmill.operators import route as Q
from corpusmill.operators import shape as K
from corpusmill.operators.tokens import count_tokens
from corpusmill.plans import catalog
from corpusmill.plans.seeded import seeded_corpus

SF = "/root/testdata/sf0.001"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def phases(df):
    """Every phase of the rewrite as a step of its own; no phase knows words from another."""
    f = F.col
    steps = {
        "red": R.redact(f("text")),
        "n": count_tokens(f("red")),
        "safe": C.protect_blocks(f("red")),
        "kind": D.detect_type(f("safe.text")),
        "fill": C.drop_fillers(C.normalize_prose(f("safe.text"))),
        "syn": C.synonyms(C.drop_stop_words(f("fill.text"))),
        "refs": C.shorten_refs(f("syn.text")),
        "tele": C.telegraphic(f("refs.text")),
        "form": C.structural(f("tele.text")),
        "body": F.when(f("kind").startswith("code_"), C.normalize_code(f("safe.text"))).otherwise(f("form.text")),
        "uniq": C.dedup_lines(f("body")),
        "tidy": C.finalize(f("uniq.text"), f("kind").startswith("code_")),
        "out": C.restore_blocks(f("tidy"), f("safe.blocks")),
        "new": count_tokens(f("out")),
    }
    for name, column in steps.items():
        df = df.withColumn(name, column)
        if name in ("safe", "fill", "refs", "form"):
            df = df.checkpoint()
    return df.collect()


def techniques(r):
    if r.n == 0:
        return [], []
    count = lambda label, n: [f"{label}:{n}"] if n > 0 else []
    code = r.kind.startswith("code_")
    done = [f"detect:{r.kind}", "normalize"]
    if code:
        done += ["code_safe_mode"]
    else:
        done += ["filler_trim", *count("synonyms", r.syn.n), *count("urls", r.refs.urls), *count("paths", r.refs.paths)]
        done += [*count("telegraphic", r.tele.n), "extra_stop", *r.form.done]
    removed = ([] if code else [f"Filler: '{x}'" for x in r.fill.found]) + list(r.uniq.removed)
    return done + list(r.uniq.done), removed[:5]


def share(n, new):
    return int((n - new) / n * 100.0 * 10.0 + 0.5) // 1 / 10.0 if n else 0.0


def test_minify_techniques_query(spark):
    from corpusmill.session import prepare_checkpoints

    prepare_checkpoints(spark)
    got = {r.doc_id: r for r in catalog.QUERIES["minify_techniques"](spark, SF).collect()}
    rows = phases(seeded_corpus(spark, SF).select("doc_id", "text"))
    assert len(got) == len(rows) > 100
    for r in rows:
        done, removed = techniques(r)
        g = got[r.doc_id]
        assert (g.techniques, g.removed) == (",".join(done), "; ".join(removed))
        assert g.text_md5 == md5(r.out if r.n else r.red)
        assert (g.original_tokens, g.compressed_tokens) == (r.n, r.new if r.n else 0)


def test_smart_route_strategies_query(spark):
    from corpusmill.session import prepare_checkpoints

    prepare_checkpoints(spark)
    got = {r.doc_id: r for r in catalog.QUERIES["smart_route_strategies"](spark, SF).collect()}
    docs = seeded_corpus(spark, SF)
    typed = docs.withColumn("type", D.route_type(F.col("text"), F.col("name"))).withColumn("red", R.redact(F.col("text")))
    typed = typed.withColumn("cat", D.category(F.col("type"))).checkpoint()
    steps = {c: s for (c, i), (s, _) in T.STRATEGIES.items() if i == "code_review"}
    cut = [c for c, s in steps.items() if "skeleton" in s]
    shaped = K.with_skeleton(typed, "red", F.when(F.col("cat").isin(cut), K.outline_kind(F.col("type"), F.col("name"))), "skel")
    counts = [count_tokens(F.col(c)).alias(f"n_{c}") for c in ("text", "red", "skel")]
    shaped = shaped.select("*", *counts).checkpoint()
    made = {r.doc_id: r for r in phases(shaped.select("doc_id", F.col("skel").alias("text")))}
    for r in shaped.collect():
        g, m = got[r.doc_id], made[r.doc_id]
        plan = steps[r.cat]
        done, removed = [], []
        if r.red != r.text:
            done, removed = ["secret_redaction"], ["Secrets redacted"]
        lost = r.n_red - r.n_skel
        if "skeleton" in plan and lost > 0:
            done.append(f"skeleton:{r.type}")
            removed.append(f"Skeleton stripped {lost} tokens ({lost / r.n_red * 100:.0f}% of structure)")
        text = r.skel
        if "compress" in plan:
            own = techniques(m)
            done, removed, text = done + own[0], removed + own[1], m.out if m.n else m.red
        assert (g.strategy_used, g.content_type) == (" → ".join(done) or "passthrough", r.type)
        assert g.text_md5 == md5(text) and g.original_tokens == r.n_text
        assert g.removed == "; ".join(removed[:5])


def test_history_dedup_payloads_query(spark):
    from test_history_streams_files import model_history

    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect()
    want = model_history([(r.event_id, r.ts, r.user_id, r.props) for r in rows if (r.props or "").strip()], 10, 50)
    got = catalog.QUERIES["history_dedup_payloads"](spark, SF).collect()
    assert {(r.user_id, r.recency): (r.props, r.created_at, r.touched_at, r.touches, r.last_seq) for r in got} == want
