"""All registered queries, each next to its oracle SQL where there is one.

Every query reads the given tables (or the corpus derived from them) whole.
Queries without SQL have rules that SQL cannot state in reasonable time; they
are tested against brute force in tests/.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import tables as T
from corpusmill.functions.text import lines, text_of, unfold, word_count
from corpusmill.operators import budget as B
from corpusmill.operators import compress as C
from corpusmill.operators import delta as V
from corpusmill.operators import detect as D
from corpusmill.operators import history as H
from corpusmill.operators import redact as R
from corpusmill.operators import route as Q
from corpusmill.operators import shape as K
from corpusmill.operators import spans as X
from corpusmill.operators import tokens as N
from corpusmill.plans import sql as S
from corpusmill.plans.seeded import new_version, seeded_corpus
from corpusmill.session import checkpoint_dir
from corpusmill.sources.files import read_corpus, write_compressed
from corpusmill.sources.tables import as_corpus, load, spread
from corpusmill.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUESTION = "Which documents contain the thention of requestHandler and configuration?"
BUDGET = 10000
USER_PRICES = {"o3 mini": 2.0, "in-house": 0.05}
GAP = 1800.0
NOW = "2024-02-01 00:00:00"
c = F.col


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "documents"))


# ------------------------------------------------------------------ sources


@query(
    "corpus_tables",
    """
    SELECT 'documents' AS tbl, count(*) AS docs, sum(len(text))::BIGINT AS chars FROM documents WHERE regexp_matches(text, '\\S')
    UNION ALL SELECT 'pages', count(*), sum(len(html))::BIGINT FROM pages WHERE regexp_matches(html, '\\S')
    UNION ALL SELECT 'conversations', count(*), sum(len(text))::BIGINT FROM conversations WHERE regexp_matches(text, '\\S')
    UNION ALL SELECT 'benchmark', count(*), sum(len(text))::BIGINT FROM benchmark WHERE regexp_matches(text, '\\S')
    """,
)
def corpus_tables(spark, sf):
    parts = {
        "documents": as_corpus(documents(spark, sf), "doc_id", "text", None, "source"),
        "pages": as_corpus(spread(load(spark, sf, "pages")), "page_id", "html", "url"),
        "conversations": as_corpus(spread(load(spark, sf, "conversations")), "conv_id", "text", None, "role"),
        "benchmark": as_corpus(load(spark, sf, "benchmark"), "item_id", "text"),
    }
    counted = [
        df.agg(
            F.lit(name).alias("tbl"),
            F.count("*").alias("docs"),
            F.sum(F.length("text")).alias("chars"),
        )
        for name, df in parts.items()
    ]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/corpusmill-{uuid.uuid4().hex}"


@query(
    "text_files_scan",
    f"SELECT sum(len({S.words('text')}))::BIGINT AS words FROM documents",
)
def text_files_scan(spark, sf):
    folder = scratch(spark) + "/files"
    docs = documents(spark, sf).select("text")
    docs.write.option("maxRecordsPerFile", 500).text(folder)
    files = read_corpus(spark, folder, extensions=[".txt"])
    return files.agg(F.sum(word_count(c("text"))).alias("words"))


@query(
    "compressed_by_type_files",
    S.recursive(
        S.with_seeded(
            "SELECT kind AS content_type, count(*) AS docs, sum(n1)::BIGINT AS tokens FROM mm GROUP BY kind",
            "src AS (SELECT doc_id, text AS t FROM seeded)",
            *S.minify_ctes("src", "mm"),
        )
    ),
)
def compressed_by_type_files(spark, sf):
    folder = scratch(spark) + "/compressed"
    write_compressed(C.minify(seeded_corpus(spark, sf)), folder)
    return (
        spark.read.parquet(folder)
        .groupBy("content_type")
        .agg(F.count("*").alias("docs"), F.sum("compressed.compressed_tokens").alias("tokens"))
    )


@query(
    "pack_first_files",
    """
    WITH r AS (SELECT source, text, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n
               FROM documents WHERE regexp_matches(text, '\\S'))
    SELECT source, count(*) FILTER (n <= 20) AS files, count(*) FILTER (n > 20) AS files_skipped,
      md5(string_agg('--- doc_' || doc_id || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY n)
          FILTER (n <= 20)) AS block_md5
    FROM r GROUP BY source
    """,
)
def pack_first_files(spark, sf):
    docs = documents(spark, sf).withColumn(
        "name", F.concat(F.lit("doc_"), c("doc_id").cast("string"))
    )
    return B.pack_block(docs, "source", "doc_id", max_files=B.FIRST_FILES).select(
        "source", "files", "files_skipped", F.md5("block").alias("block_md5")
    )


@query(
    "pin_entries",
    """
    WITH pinned AS (SELECT conv_id, text, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY ALL),
    fresh AS (SELECT conv_id, text, min(turn) AS turn FROM conversations GROUP BY ALL),
    together AS (SELECT * FROM pinned UNION ALL
      SELECT f.* FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM pinned p WHERE p.conv_id = f.conv_id AND p.text = f.text))
    SELECT conv_id, turn, md5(text) AS text_md5 FROM together
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) <= 10
    """,
)
def pin_entries(spark, sf):
    turns = spread(load(spark, sf, "conversations"))
    pinned = turns.where(c("role") == "user").groupBy("conv_id", "text").agg(F.min("turn").alias("turn"))
    out = H.pin_entries(pinned, turns.select("conv_id", "text", "turn"), "conv_id", "text", "turn")
    return out.select("conv_id", "turn", F.md5("text").alias("text_md5"))


# ------------------------------------------------------ filters, projections


@query("min_length", "SELECT event_id, event_type FROM events WHERE len(trim(event_type)) >= 5")
def min_length(spark, sf):
    return H.min_length(load(spark, sf, "events"), 5, "event_type").select("event_id", "event_type")


@query(
    "search_history",
    """SELECT conv_id, turn, (SELECT count(*) FROM conversations) AS history_size
       FROM conversations WHERE contains(lower(text), 'then')""",
)
def search_history(spark, sf):
    return H.search_history(spread(load(spark, sf, "conversations")), "Then").select(
        "conv_id", "turn", "history_size"
    )


@query(
    "search_with_variants",
    """
    WITH h AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN role END AS compact FROM conversations),
    b AS (SELECT *, 'pinned' AS kind FROM h WHERE turn = 0 UNION ALL SELECT *, 'history' FROM h)
    SELECT kind, CASE kind WHEN 'history' THEN 1 ELSE 0 END AS listed, conv_id, turn FROM b
    WHERE contains(lower(text || ' ' || coalesce(compact, '')), 'user')
    """,
)
def search_with_variants(spark, sf):
    turns = spread(load(spark, sf, "conversations")).withColumn(
        "compact", F.when(c("turn") % 2 == 0, c("role"))
    )
    out = H.search_with_variants(turns.where("turn = 0"), turns, " User ", "text", "compact")
    return out.select("kind", "listed", "conv_id", "turn")


@query(
    "previews",
    """SELECT conv_id, turn, CASE WHEN len(text) > 40 THEN left(text, 37) || '...' ELSE text END AS label,
       left(text, 100) AS history_label, trim(replace(text, chr(10), ' ')) AS one_line FROM conversations""",
)
def previews(spark, sf):
    return spread(load(spark, sf, "conversations")).select(
        "conv_id",
        "turn",
        H.preview(c("text")).alias("label"),
        H.history_preview(c("text")).alias("history_label"),
        H.one_line(c("text")).alias("one_line"),
    )


def _compact_sql(x: str) -> str:
    s = S.strip(x)
    z = S.sub(s, r"[\s\-./]+")
    digits = f"len({S.sub(z, '[^0-9+]')})"
    return (
        f"CASE WHEN NOT contains({x}, chr(10)) AND {z} <> '' AND {z} <> {s} AND regexp_matches({s}, '[ \\-./]') "
        f"AND {digits}::DOUBLE / nullif(len({z}), 0) >= 0.6 THEN {z} END"
    )


@query(
    "compact_numbers",
    S.with_seeded(
        f"""SELECT 'order' AS src, o_orderkey AS id, 0 AS pos, {_compact_sql("strftime(o_orderdate, '%d.%m.%Y')")} AS compact FROM orders
        UNION ALL SELECT * FROM (SELECT 'line', doc_id, pos - 1, {_compact_sql('line')} AS compact
          FROM (SELECT doc_id, unnest({S.lines('text')}) AS line, generate_subscripts({S.lines('text')}, 1) AS pos FROM seeded))
        WHERE compact IS NOT NULL"""
    ),
)
def compact_numbers(spark, sf):
    dates = load(spark, sf, "orders").select(
        F.lit("order").alias("src"),
        c("o_orderkey").alias("id"),
        F.lit(0).alias("pos"),
        Q.compact_number(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("compact"),
    )
    docs = unfold(seeded_corpus(spark, sf), ["doc_id"], lines(c("text")), "pos", "line")
    found = docs.select(
        F.lit("line").alias("src"),
        c("doc_id").alias("id"),
        "pos",
        Q.compact_number(c("line")).alias("compact"),
    ).where("compact IS NOT NULL")
    return dates.unionByName(found)


@query(
    "event_ages",
    f"""
    WITH a AS (SELECT event_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000000.0::DOUBLE AS s,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS r FROM events)
    SELECT event_id, CASE WHEN s < 10 THEN 'now' WHEN s < 60 THEN floor(s)::BIGINT || 's'
      WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || 'h'
      ELSE floor(s / 86400)::BIGINT || 'd' END AS age,
      CASE WHEN r <= 1 THEN 'full' WHEN r <= 3 THEN 'dark' WHEN r <= 6 THEN 'medium' ELSE 'light' END AS freshness
    FROM a
    """,
)
def event_ages(spark, sf):
    events = load(spark, sf, "events")
    newest = H.bounded_history(events, "user_id", ["ts", "event_id"], 7).select("event_id", "recency")
    now = F.unix_micros(F.lit(NOW).cast("timestamp_ntz").cast("timestamp"))
    return events.join(newest, "event_id", "left").select(
        "event_id",
        H.age_label((now - F.unix_micros(c("ts").cast("timestamp"))) / F.lit(1e6)).alias("age"),
        F.coalesce(H.freshness(c("recency") - 1), F.lit("light")).alias("freshness"),
    )


# ---------------------------------------------------------------- redaction


def _redact_query(name: str, fn, sql: str):
    def run(spark, sf):
        docs = seeded_corpus(spark, sf)
        return docs.select("doc_id", fn(c("text")).alias("t")).select(
            "doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("chars")
        )

    query(name, sql)(run)


_RESULT = "SELECT doc_id, md5(t) AS text_md5, len(t) AS chars FROM "
_SRC = "src AS (SELECT doc_id, text AS t FROM seeded)"
_redact_query("redact_known", R.redact_known, S.with_seeded(f"SELECT doc_id, md5({S.known('t')}) AS text_md5, len({S.known('t')}) AS chars FROM src", _SRC))
_redact_query("redact_ips", R.redact_ips, S.with_seeded(_RESULT + f"({S.stage('src', T.IPV4, S.IP_PUT)})", _SRC))
_redact_query("redact_uuids", R.redact_uuids, S.with_seeded(_RESULT + f"({S.stage('src', T.UUID, S.UUID_PUT)})", _SRC))
_redact_query("redact_high_entropy", R.redact_high_entropy, S.with_seeded(_RESULT + f"({S.stage('src', S.LONG_TOKEN, S.SECRET_PUT)})", _SRC))
_redact_query("redact", R.redact, S.with_seeded(_RESULT + "redacted", _SRC, *S.redaction_ctes("src")))


def _times(x: str, tag: str) -> str:
    return f"((len({x}) - len(replace({x}, {S.q(tag)}, ''))) // {len(tag)})"


@query(
    "redaction_report",
    S.with_seeded(
        "SELECT source, tag, sum(n)::BIGINT AS findings, count(*) AS documents FROM ("
        + " UNION ALL ".join(
            f"SELECT source, {S.q(t)} AS tag, {_times('t', t)} - {_times('raw', t)} AS n FROM redacted" for t in R.TAGS
        )
        + ") WHERE n > 0 GROUP BY ALL",
        "src AS (SELECT doc_id, source, text AS raw, text AS t FROM seeded)",
        *S.redaction_ctes("src"),
    ),
)
def redaction_report(spark, sf):
    return R.redaction_report(seeded_corpus(spark, sf))


@query(
    "entropy_profile",
    S.with_seeded(
        f"""SELECT doc_id, token, len(token) AS token_length, floor({S.bits('token')} * 1000 + 0.5)::BIGINT AS millibits,
        {S.secret('token')} AS is_secret, count(*) AS times
        FROM (SELECT doc_id, unnest({S.hits('text', S.LONG_TOKEN)}) AS token FROM seeded) GROUP BY ALL"""
    ),
)
def entropy_profile(spark, sf):
    p = R.entropy_profile(seeded_corpus(spark, sf))
    return p.groupBy(
        "doc_id",
        "token",
        "token_length",
        F.floor(c("bits") * 1000 + 0.5).cast("bigint").alias("millibits"),
        "is_secret",
    ).agg(F.count("*").alias("times"))


# ------------------------------------------------------------------- tokens


def docs_with_tokens(spark, sf):
    return documents(spark, sf).select(
        "doc_id", "source", N.count_tokens(c("text")).alias("tokens")
    )


TOKENS_SQL = f"SELECT doc_id, source, {S.tok('text')} AS tokens FROM documents"
PER_SOURCE_SQL = f"SELECT source, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM ({TOKENS_SQL}) GROUP BY source"


def source_tokens(spark, sf):
    return (
        docs_with_tokens(spark, sf)
        .groupBy("source")
        .agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    )


query("token_counts", f"SELECT doc_id, tokens FROM ({TOKENS_SQL})")(
    lambda spark, sf: docs_with_tokens(spark, sf).select("doc_id", "tokens")
)
query("token_count_by_source", PER_SOURCE_SQL)(source_tokens)


@query(
    "encoding_mix",
    f"""SELECT source, model,
      CASE WHEN contains(model, 'GPT-4o') OR contains(model, 'o1') OR contains(model, 'o3')
        THEN 'o200k_base' ELSE 'cl100k_base' END AS encoding, tokens
      FROM ({PER_SOURCE_SQL}), {S.model_rows(T.PRICES, 'DOUBLE')}""",
)
def encoding_mix(spark, sf):
    return N.with_costs(source_tokens(spark, sf)).select(
        "source", "model", N.model_encoding(c("model")).alias("encoding"), "tokens"
    )


COST = S.rnd("tokens::DOUBLE * v / 1000000::DOUBLE * 100::DOUBLE", 6)


@query(
    "cost_by_model",
    f"SELECT source, model, tokens, {COST} AS cost_cents FROM ({PER_SOURCE_SQL}), {S.model_rows(T.PRICES, 'DOUBLE')}",
)
def cost_by_model(spark, sf):
    return N.with_costs(source_tokens(spark, sf)).select("source", "model", "tokens", "cost_cents")


@query(
    "cost_with_user_prices",
    f"SELECT source, model, {COST} AS cost_cents FROM ({PER_SOURCE_SQL}), "
    + S.model_rows({**T.PRICES, **USER_PRICES}, "DOUBLE"),
)
def cost_with_user_prices(spark, sf):
    prices = N.dimension_table(spark, T.PRICES, USER_PRICES)
    totals = source_tokens(spark, sf)
    rows = totals.withColumn("model", F.explode(F.array(*[F.lit(m) for m in {**T.PRICES, **USER_PRICES}])))
    return rows.join(F.broadcast(prices), rows["model"] == prices["key"]).select(
        "source", "model", N.cost_cents(c("tokens"), c("value")).alias("cost_cents")
    )


USAGE = S.rnd("tokens::DOUBLE / v::DOUBLE * 100::DOUBLE", 2)
USAGE_SQL = (
    f"SELECT doc_id, source, model, model_ord, {USAGE} AS usage_pct "
    f"FROM ({TOKENS_SQL}), {S.model_rows(T.CONTEXT_WINDOWS, 'BIGINT')}"
)


@query("context_usage", f"SELECT doc_id, model, usage_pct FROM ({USAGE_SQL})")
def context_usage(spark, sf):
    return N.with_usage(docs_with_tokens(spark, sf)).select("doc_id", "model", "usage_pct")


@query(
    "context_warning",
    f"""SELECT doc_id, model, usage_pct FROM ({USAGE_SQL}) WHERE usage_pct >= 0.5
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY usage_pct DESC, model_ord) = 1""",
)
def context_warning(spark, sf):
    warned = docs_with_tokens(spark, sf).withColumn("w", N.context_warning(c("tokens"), 0.5))
    return warned.where("w IS NOT NULL").select("doc_id", "w.model", "w.usage_pct")


@query(
    "context_band_mix",
    f"""SELECT model, CASE WHEN u >= 75 THEN 'danger' WHEN u >= 50 THEN 'warn' ELSE 'safe' END AS band,
        count(*) AS sources FROM (SELECT *, {USAGE} AS u FROM ({PER_SOURCE_SQL}), {S.model_rows(T.CONTEXT_WINDOWS, 'BIGINT')})
        GROUP BY ALL""",
)
def context_band_mix(spark, sf):
    return (
        N.with_usage(source_tokens(spark, sf))
        .groupBy("model", N.context_band(c("usage_pct")).alias("band"))
        .agg(F.count("*").alias("sources"))
    )


def _cost_text(x: str) -> str:
    return (
        f"(CASE WHEN {x} < 0.01 THEN printf('%.4f', {x}) WHEN {x} < 1.0 THEN printf('%.3f', {x}) "
        f"ELSE printf('%.2f', {x}) END || ' ¢')"
    )


@query(
    "format_cost",
    f"SELECT doc_id, model, {_cost_text('x')} AS cost FROM (SELECT doc_id, model, {COST} AS x "
    f"FROM ({TOKENS_SQL}), {S.model_rows(T.PRICES, 'DOUBLE')})",
)
def format_cost(spark, sf):
    return N.with_costs(docs_with_tokens(spark, sf)).select(
        "doc_id", "model", N.format_cost(c("cost_cents")).alias("cost")
    )


_CUT = "CAST(floor(len(text)::DOUBLE * (200::DOUBLE / tokens::DOUBLE)) AS INT)"


@query(
    "truncate_to_budget",
    f"""SELECT doc_id, CASE WHEN tokens <= 200 THEN tokens ELSE 200 END AS tokens,
      md5(CASE WHEN tokens <= 200 THEN text ELSE left(text, {_CUT}) END) AS text_md5
      FROM (SELECT doc_id, text, {S.tok('text')} AS tokens FROM documents)""",
)
def truncate_to_budget(spark, sf):
    cut = N.cut_to_budget(c("text"), F.lit(200))
    return (
        documents(spark, sf)
        .select("doc_id", cut.alias("cut"))
        .select("doc_id", "cut.tokens", F.md5("cut.text").alias("text_md5"))
    )


_RAW, _NEW = S.tok("s.text"), S.tok("n.text")


@query(
    "token_stats",
    S.with_seeded(
        f"""SELECT doc_id, a AS original_tokens, b AS compressed_tokens, a - b AS tokens_saved,
        {S.pct('a - b', 'a')} AS saved_percent,
        a || ' → ' || b || ' tokens (' || printf('%.1f', {S.pct('a - b', 'a')}) || '% saved)' AS summary
        FROM (SELECT s.doc_id, {_RAW} AS a, {_NEW} AS b FROM seeded s JOIN newer n USING (doc_id))""",
        S.NEW_CTE,
    ),
)
def token_stats(spark, sf):
    old = seeded_corpus(spark, sf)
    a = old.select("doc_id", N.count_tokens(c("text")).alias("a"))
    b = new_version(old).select("doc_id", N.count_tokens(c("text")).alias("b"))
    return a.join(b, "doc_id").select("doc_id", N.token_stats(c("a"), c("b")).alias("s")).select(
        "doc_id", "s.*"
    )


_TOKEN_COSTS = " || '  |  ' || ".join(
    f"'{m}: ' || "
    + _cost_text(S.rnd(f"tokens::DOUBLE * {v}::DOUBLE / 1000000::DOUBLE * 100::DOUBLE", 6))
    + (" || ' (~est)'" if "Claude" in m else "")
    for m, v in T.PRICES.items()
)


@query(
    "token_report",
    f"""SELECT doc_id, tokens, chars, coalesce({S.rnd('chars::DOUBLE / nullif(tokens, 0)', 1)}, 0::DOUBLE) AS chars_per_token,
      {_TOKEN_COSTS} AS cost_summary FROM (SELECT doc_id, {S.tok('text')} AS tokens, len(text) AS chars FROM documents WHERE text <> '')""",
)
def token_report(spark, sf):
    return N.token_report(documents(spark, sf)).drop("cost_cents")


_WS = S.words("text")


@query(
    "token_length_classes",
    f"""SELECT doc_id, len(list_filter({_WS}, lambda x: len(x) <= 1)) AS expensive,
      len(list_filter({_WS}, lambda x: len(x) BETWEEN 2 AND 3)) AS medium,
      len(list_filter({_WS}, lambda x: len(x) > 3)) AS cheap FROM documents""",
)
def token_length_classes(spark, sf):
    return (
        documents(spark, sf)
        .select("doc_id", N.token_length_classes(c("text")).alias("k"))
        .select("doc_id", "k.*")
    )


@query(
    "token_length_totals",
    f"""SELECT source, sum(len(list_filter({_WS}, lambda x: len(x) <= 1)))::BIGINT AS expensive,
      sum(len(list_filter({_WS}, lambda x: len(x) BETWEEN 2 AND 3)))::BIGINT AS medium,
      sum(len(list_filter({_WS}, lambda x: len(x) > 3)))::BIGINT AS cheap FROM documents GROUP BY source""",
)
def token_length_totals(spark, sf):
    return (
        documents(spark, sf)
        .select("source", N.token_length_classes(c("text")).alias("k"))
        .groupBy("source")
        .agg(*[F.sum(f"k.{n}").alias(n) for n in ("expensive", "medium", "cheap")])
    )


# ---------------------------------------------------------------- detection


@query("detect_type", S.with_seeded(f"SELECT doc_id, {S.detect('text')} AS content_type FROM seeded"))
def detect_type(spark, sf):
    return seeded_corpus(spark, sf).select("doc_id", D.detect_type(c("text")).alias("content_type"))


@query("detect_raw_code", S.with_seeded(f"SELECT doc_id, {S.raw_code('text')} AS code_type FROM seeded"))
def detect_raw_code(spark, sf):
    return seeded_corpus(spark, sf).select("doc_id", D.detect_raw_code(c("text")).alias("code_type"))


ROUTED_CTE = (
    f"routed AS MATERIALIZED (SELECT doc_id, source, text, {S.routed_type('text', 'name')} AS content_type FROM seeded)"
)


@query(
    "route_type",
    S.with_seeded(
        f"""SELECT 'documents' AS tbl, doc_id AS id, content_type FROM routed
        UNION ALL SELECT 'unnamed', doc_id, {S.routed_type('text')} FROM seeded
        UNION ALL SELECT 'pages', page_id, {S.routed_type('html')} FROM pages""",
        ROUTED_CTE,
    ),
)
def route_type(spark, sf):
    docs, pages = seeded_corpus(spark, sf), spread(load(spark, sf, "pages"))
    row = lambda df, tbl, key, kind: df.select(
        F.lit(tbl).alias("tbl"), c(key).alias("id"), kind.alias("content_type")
    )
    return (
        row(docs, "documents", "doc_id", D.route_type(c("text"), c("name")))
        .unionByName(row(docs, "unnamed", "doc_id", D.route_type(c("text"))))
        .unionByName(row(pages, "pages", "page_id", D.route_type(c("html"))))
    )


@query(
    "category",
    S.with_seeded(
        f"SELECT source, {S.category('content_type')} AS category, count(*) AS docs FROM routed GROUP BY ALL",
        ROUTED_CTE,
    ),
)
def category(spark, sf):
    kind = D.category(D.route_type(c("text"), c("name")))
    return (
        seeded_corpus(spark, sf).groupBy("source", kind.alias("category")).agg(F.count("*").alias("docs"))
    )


@query(
    "type_mix",
    S.with_seeded(
        """SELECT source, is_total, content_type, docs, tokens,
        tokens::DOUBLE / sum(tokens) OVER (PARTITION BY source, is_total)::DOUBLE AS token_share FROM mix""",
        ROUTED_CTE,
        f"""mix AS (SELECT source, grouping(source) = 1 AS is_total, content_type, count(*) AS docs, sum({S.tok('text')})::BIGINT AS tokens
            FROM routed GROUP BY GROUPING SETS ((source, content_type), (content_type)))""",
    ),
)
def type_mix(spark, sf):
    return D.type_mix(seeded_corpus(spark, sf))


_CODE_LINE = (
    f"(regexp_matches(l, {S.q(D.CODE_WORDS)}) OR regexp_matches({S.strip('l')}, '[{{}};]$') "
    "OR regexp_matches(l, '^\\s*(?:if|for|while|try|except|catch)\\b'))"
)
_COMMAND_LINE = f"regexp_matches(l, {S.q(D.COMMAND_LINE)})"


@query(
    "real_code_blocks",
    S.with_seeded(
        f"""SELECT doc_id, pos, CASE WHEN n = 0 OR len(list_filter(ls, lambda l: regexp_matches(l, '[├└│─]'))) >= 2 OR n <= 3 THEN FALSE
          WHEN len(list_filter(ls, lambda l: {_CODE_LINE})) >= 2 THEN TRUE
          WHEN len(list_filter(ls, lambda l: {_COMMAND_LINE})) >= n * 0.7 THEN FALSE ELSE n > 5 END AS is_code
        FROM (SELECT doc_id, pos, ls, len(ls) AS n FROM (
          SELECT doc_id, pos, list_filter({S.lines("regexp_replace(block, '^```[^\\n]*\\n|```$', '', 'g')")}, lambda l: trim(l) <> '') AS ls
          FROM (SELECT doc_id, unnest({S.hits('text', T.FENCED_BLOCK)}) AS block,
            generate_subscripts({S.hits('text', T.FENCED_BLOCK)}, 1) - 1 AS pos FROM seeded)))"""
    ),
)
def real_code_blocks(spark, sf):
    found = F.regexp_extract_all("text", F.lit(T.FENCED_BLOCK), F.lit(0))
    blocks = unfold(seeded_corpus(spark, sf), ["doc_id"], found, "pos", "block")
    inner = F.regexp_replace("block", r"^```[^\n]*\n|```$", "")
    return blocks.select("doc_id", "pos", D.is_real_code_block(inner).alias("is_code"))


# -------------------------------------------------------------- compression


def _phase_query(name: str, fn, sql: str | None):
    def run(spark, sf):
        out = seeded_corpus(spark, sf).select("doc_id", fn(c("text")).alias("t"))
        return out.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("chars"))

    query(name, sql and S.with_seeded(_RESULT + f"(SELECT doc_id, {sql} AS t FROM seeded)"))(run)


_phase_query("normalize", C.normalize_prose, S.normalized("text"))
_phase_query("drop_fillers", lambda t: C.drop_fillers(t)["text"], S.without_fillers("text"))
_phase_query("drop_stop_words", C.drop_stop_words, S.without_stop_words("text"))
_phase_query("synonyms", lambda t: C.synonyms(t)["text"], S.with_synonyms("text"))
_phase_query("shorten_refs", lambda t: C.shorten_refs(t)["text"], S.with_short_refs("text"))
_phase_query("telegraphic", lambda t: C.telegraphic(t)["text"], S.telegraphic("text"))
_phase_query("structural", lambda t: C.structural(t)["text"], S.structured("text"))
_phase_query("finalize", lambda t: C.finalize(t, F.lit(False)), S.finalized("text"))
_phase_query(
    "ocr_text_repair",
    C.repair_ocr_text,
    S.sub(
        S.sub(
            S.sub(
                "translate("
                + S.unlines(
                    f"list_filter(list_transform({S.lines('text')}, lambda l: {S.strip('l')}), lambda l: l <> '')"
                )
                + ", 'øØ', '00')",
                r"(\d)e(\d)",
                r"\10\2",
            ),
            r"(\d)e(\d)",
            r"\10\2",
        ),
        r"^[•·\-|*>]\s*",
    ),
)


@query(
    "dedup_lines",
    S.recursive(S.with_seeded(_RESULT + "dd", _SRC, *S.dedup_ctes("src", "dd"))),
)
def dedup_lines(spark, sf):
    out = seeded_corpus(spark, sf).select("doc_id", C.dedup_lines(c("text"))["text"].alias("t"))
    return out.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("chars"))


@query(
    "protect_blocks",
    S.with_seeded(
        "SELECT doc_id, len(kept) AS kept_blocks, md5(t) AS text_md5 FROM pr", _SRC, *S.protect_ctes("src", "pr")
    ),
)
def protect_blocks(spark, sf):
    p = seeded_corpus(spark, sf).select("doc_id", C.protect_blocks(c("text")).alias("p"))
    return p.select(
        "doc_id",
        F.size("p.blocks").cast("bigint").alias("kept_blocks"),
        F.md5("p.text").alias("text_md5"),
    )


@query(
    "minify",
    S.recursive(
        S.with_seeded(
            f"""SELECT doc_id, md5(t) AS text_md5, n0 AS original_tokens, n1 AS compressed_tokens,
            {S.pct('n0 - n1', 'n0')} AS saved_percent, kind AS content_type FROM mm""",
            _SRC,
            *S.minify_ctes("src", "mm"),
        )
    ),
)
def minify(spark, sf):
    return C.minify(seeded_corpus(spark, sf)).select(
        "doc_id",
        F.md5("compressed.text").alias("text_md5"),
        "compressed.original_tokens",
        "compressed.compressed_tokens",
        "compressed.saved_percent",
        "compressed.content_type",
    )


@query("minify_techniques")
def minify_techniques(spark, sf):
    return C.minify(seeded_corpus(spark, sf)).select(
        "doc_id",
        F.md5("compressed.text").alias("text_md5"),
        "compressed.original_tokens",
        "compressed.compressed_tokens",
        "compressed.saved_percent",
        "compressed.content_type",
        F.array_join("compressed.techniques_applied", ",").alias("techniques"),
        F.array_join("compressed.what_was_removed", "; ").alias("removed"),
    )


@query(
    "compression_rollup",
    S.recursive(
        S.with_seeded(
            f"""SELECT source, is_total, docs, a AS original_tokens, b AS compressed_tokens, a - b AS tokens_saved, {S.pct('a - b', 'a')} AS saved_percent
            FROM (SELECT source, grouping(source) = 1 AS is_total, count(*) AS docs, sum({S.tok('raw')})::BIGINT AS a, sum(n1)::BIGINT AS b
              FROM mm GROUP BY GROUPING SETS ((source), ()))""",
            "src AS (SELECT doc_id, source, text AS raw, text AS t FROM seeded)",
            *S.minify_ctes("src", "mm"),
        )
    ),
)
def compression_rollup(spark, sf):
    return C.compression_rollup(seeded_corpus(spark, sf))


@query(
    "boilerplate_lines",
    f"""SELECT line, count(*) AS occurrences, count(DISTINCT doc_id) AS documents
        FROM (SELECT doc_id, {S.strip('unnest(' + S.lines('text') + ')')} AS line FROM documents)
        WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 2""",
)
def boilerplate_lines(spark, sf):
    return C.boilerplate_lines(documents(spark, sf))


# --------------------------------------------------------- routing, budgets


ROUTE_SRC = "src AS (SELECT doc_id, source, name, text AS t FROM seeded)"


@query(
    "smart_route",
    S.recursive(
        S.with_seeded(
            f"""SELECT doc_id, md5(t) AS text_md5, rkind AS content_type, rn0 AS original_tokens, rn1 AS compressed_tokens,
            {S.pct('rn0 - rn1', 'rn0')} AS saved_percent FROM rt""",
            ROUTE_SRC,
            *S.route_ctes("src", "rt"),
        )
    ),
)
def smart_route(spark, sf):
    return Q.smart_route(seeded_corpus(spark, sf)).select(
        "doc_id",
        F.md5("routed.text").alias("text_md5"),
        "routed.content_type",
        "routed.original_tokens",
        "routed.compressed_tokens",
        "routed.saved_percent",
    )


@query("smart_route_strategies")
def smart_route_strategies(spark, sf):
    r = Q.smart_route(seeded_corpus(spark, sf), intent="code_review")
    return r.select(
        "doc_id",
        F.md5("routed.text").alias("text_md5"),
        "routed.strategy_used",
        "routed.content_type",
        "routed.confidence",
        "routed.original_tokens",
        "routed.compressed_tokens",
        "routed.saved_percent",
        F.array_join("routed.what_was_removed", "; ").alias("removed"),
    )


def _explained_sql() -> str:
    """Tokens per intent from the two rewrites and the skeleton of a document."""
    pick = []
    for o, intent in enumerate(T.INTENTS):
        whens = " ".join(
            f"WHEN '{cat}' THEN "
            + ("no" if "compress" in steps and "skeleton" in steps else "ns" if "skeleton" in steps else "np")
            for (cat, i), (steps, _) in T.STRATEGIES.items()
            if i == intent
        )
        sure = " ".join(
            f"WHEN '{cat}' THEN {s}::DOUBLE" for (cat, i), (_, s) in T.STRATEGIES.items() if i == intent
        )
        pick.append(
            f"SELECT doc_id, rkind, rn0, {o} AS o, '{intent}' AS intent, CASE cat {whens} END AS n, "
            f"CASE cat {sure} END AS confidence FROM every"
        )
    return f"""SELECT doc_id, rkind AS content_type, rn0 AS original_tokens, coalesce(best, 'understand') AS recommended_intent,
      intent, n AS result_tokens, p AS saved_percent, confidence
    FROM (SELECT *, first_value(CASE WHEN confidence >= 0.85 THEN intent END) OVER (PARTITION BY doc_id
        ORDER BY confidence >= 0.85 DESC, p DESC, o) AS best
      FROM (SELECT *, {S.pct('rn0 - n', 'rn0')} AS p FROM ({' UNION ALL '.join(pick)})))"""


@query(
    "explain_compression",
    S.recursive(
        S.with_seeded(
            _explained_sql(),
            ROUTE_SRC,
            *S.route_ctes("src", "rt"),
            "plain AS (SELECT doc_id, t FROM rtq)",
            *S.minify_ctes("plain", "pm"),
            f"""every AS MATERIALIZED (SELECT rt.doc_id, rt.rkind, rt.cat, rt.rn0, pm.n1 AS np, rt.rn1 AS no, {S.tok('rtc.t')} AS ns
                FROM rt JOIN pm USING (doc_id) JOIN rtc USING (doc_id))""",
        )
    ),
)
def explain_compression(spark, sf):
    return (
        Q.explain_compression(seeded_corpus(spark, sf))
        .select("doc_id", "explained.*")
        .transform(
            unfold, ["doc_id", "content_type", "original_tokens", "recommended_intent"], c("per_intent"), "i"
        )
        .select("doc_id", "content_type", "original_tokens", "recommended_intent", "i.*")
    )


@query(
    "build_variants",
    S.recursive(
        S.with_seeded(
            f"""SELECT doc_id, CASE WHEN saved OR z IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS variants,
            CASE WHEN saved THEN 'Compressed' WHEN z IS NOT NULL THEN 'Compact' ELSE 'Original' END AS active_label,
            CASE WHEN saved THEN p WHEN z IS NOT NULL THEN {S.pct('len(text) - len(z)', 'len(text)')} ELSE 0::DOUBLE END AS active_saved_percent,
            md5(CASE WHEN saved THEN t WHEN z IS NOT NULL THEN z ELSE text END) AS active_md5
            FROM (SELECT *, t <> '' AND t <> text AND p > 0 AS saved FROM (
              SELECT doc_id, text, t, {_compact_sql('text')} AS z, {S.pct('rn0 - rn1', 'rn0')} AS p FROM rt))""",
            "src AS (SELECT doc_id, NULL::VARCHAR AS name, text, text AS t FROM seeded)",
            *S.route_ctes("src", "rt"),
        )
    ),
)
def build_variants(spark, sf):
    v = Q.build_variants(seeded_corpus(spark, sf).select("doc_id", "text"))
    best = Q.best_variant(c("variants"))
    return v.select(
        "doc_id",
        F.size("variants").cast("bigint").alias("variants"),
        best["label"].alias("active_label"),
        best["saved_percent"].alias("active_saved_percent"),
        F.md5(best["text"]).alias("active_md5"),
    )


QUESTION_TERMS = S.terms(S.q(QUESTION))


@query(
    "split_terms",
    f"SELECT doc_id, term FROM (SELECT doc_id, unnest({S.terms('text')}) AS term FROM documents)",
)
def split_terms(spark, sf):
    return unfold(documents(spark, sf), ["doc_id"], Q.split_terms(c("text")), "term")


def _relevance_sql(x: str) -> str:
    return (
        f"len(list_intersect({QUESTION_TERMS}, {S.terms(x)}))::DOUBLE / len({QUESTION_TERMS})"
    )


@query("relevance", S.with_seeded(f"SELECT doc_id, {_relevance_sql('text')} AS score FROM seeded"))
def relevance(spark, sf):
    return seeded_corpus(spark, sf).select("doc_id", Q.relevance(c("text"), QUESTION).alias("score"))


@query(
    "relevance_per_question",
    f"""SELECT d.doc_id, b.item_id, len(list_intersect(b.q, d.t))::BIGINT AS hits, len(b.q) AS terms
        FROM (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item, {S.terms('text')} AS t FROM documents) d
        JOIN (SELECT item_id, {S.terms('text')} AS q FROM benchmark) b ON b.item_id = d.item""",
)
def relevance_per_question(spark, sf):
    questions = load(spark, sf, "benchmark").select("item_id", c("text").alias("question"))
    docs = documents(spark, sf).select("doc_id", "text")
    n = questions.agg(F.count("*")).scalar()
    asked = docs.withColumn("item_id", F.pmod(c("doc_id"), n))
    return asked.join(questions, "item_id").select(
        "doc_id", "item_id", Q.question_hits(c("text"), c("question")).alias("h")
    ).select("doc_id", "item_id", "h.hits", "h.terms")


@query(
    "relevant_documents",
    f"""SELECT item_id, doc_id, hits, terms, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id)::INT AS rank FROM (
            SELECT b.item_id, d.doc_id, len(list_intersect(b.q, d.t))::BIGINT AS hits, len(b.q) AS terms
            FROM (SELECT doc_id, {S.terms('text')} AS t FROM documents) d, (SELECT item_id, {S.terms('text')} AS q FROM benchmark) b)
          WHERE hits > 0) WHERE rank <= 50""",
)
def relevant_documents(spark, sf):
    return Q.relevant_documents(documents(spark, sf), load(spark, sf, "benchmark"))


def _alloc_sql(src: str, budget: int) -> str:
    return f"""
    st AS (SELECT source, CASE WHEN sum(weight) = 0 THEN 1 ELSE sum(weight) END::BIGINT AS total, count(*) AS docs FROM {src} GROUP BY source),
    al AS (SELECT x.*, docs, ({budget} * weight) // total AS own, {budget} // docs AS equal,
      row_number() OVER (PARTITION BY source ORDER BY weight DESC, doc_id) AS place FROM {src} x JOIN st USING (source)),
    sh AS (SELECT *, max(own) OVER (PARTITION BY source) >= 200 AS shared FROM al),
    chosen AS (SELECT *, CASE WHEN shared THEN own WHEN equal >= 200 THEN equal ELSE {budget} END::BIGINT AS allocated FROM sh
      WHERE CASE WHEN shared THEN own >= 200 WHEN equal >= 200 THEN TRUE ELSE place = 1 END)"""


WEIGHTED = f"weighted AS (SELECT source, doc_id, len(list_intersect({QUESTION_TERMS}, {S.terms('text')}))::BIGINT AS weight FROM documents)"


def _allocation(budget: int):
    def run(spark, sf):
        scored = documents(spark, sf).select(
            "source", "doc_id", Q.question_hits(c("text"), F.lit(QUESTION))["hits"].alias("weight")
        )
        return B.allocate_budget(B.settled(scored), budget, "source", "doc_id").select(
            "source", "doc_id", "weight", "allocated", c("rank").cast("bigint").alias("rank")
        )

    return run


for _b in (1000, 10000, 100000):
    query(
        f"budget_allocation_{_b}",
        f"""WITH {WEIGHTED}, {_alloc_sql('weighted', _b)} SELECT source, doc_id, weight, allocated,
        row_number() OVER (PARTITION BY source ORDER BY weight DESC, doc_id) AS rank FROM chosen""",
    )(_allocation(_b))


_PACK_CTES = [
    "src AS (SELECT doc_id, source, name, t FROM packed0)",
    f"""weighted AS MATERIALIZED (SELECT source, doc_id, {S.tok('t')} AS doc_tokens,
        len(list_intersect({QUESTION_TERMS}, {S.terms('t')}))::BIGINT AS weight FROM src)""",
    _alloc_sql("weighted", BUDGET),
    "picked AS MATERIALIZED (SELECT doc_id, name, s.t FROM src s JOIN chosen USING (doc_id))",
    *S.route_ctes("picked", "rt"),
    f"""parts AS (SELECT c.source, doc_id, r.name, doc_tokens, docs, allocated, weight,
        row_number() OVER (PARTITION BY c.source ORDER BY weight DESC, doc_id) AS rank,
        CASE WHEN rn1 <= allocated THEN r.t ELSE left(r.t, CAST(floor(len(r.t)::DOUBLE * (allocated::DOUBLE / rn1::DOUBLE)) AS INT)) END AS t,
        CASE WHEN rn1 <= allocated THEN rn1 ELSE allocated END AS actual
        FROM chosen c JOIN rt r USING (doc_id))""",
]


@query(
    "context_pack",
    S.recursive(
        S.with_seeded(
            f"""SELECT source, string_agg('--- ' || name || ' ---' || chr(10) || t, chr(10) || chr(10) ORDER BY rank) AS packed_context,
            count(*) AS files_included, any_value(docs) - count(*) AS files_skipped, sum(actual)::BIGINT AS tokens_used,
            sum(doc_tokens)::BIGINT AS total_original_tokens, sum(doc_tokens - actual)::BIGINT AS tokens_saved,
            {S.pct('sum(doc_tokens - actual)', 'sum(doc_tokens)')} AS saved_percent FROM parts GROUP BY source""",
            "pack_src AS (SELECT doc_id, source, name, text AS t FROM seeded)",
            *S.redaction_ctes("pack_src", "packed0"),
            *_PACK_CTES,
        )
    ),
)
def context_pack(spark, sf):
    return B.context_pack(seeded_corpus(spark, sf), QUESTION, BUDGET)


@query(
    "context_pack_details",
    S.recursive(
        S.with_seeded(
            f"""SELECT source, doc_id, name, rank, docs AS group_docs, doc_tokens AS original_tokens, allocated AS allocated_budget,
            actual AS actual_tokens, {S.rnd(f'weight::DOUBLE / len({QUESTION_TERMS})::DOUBLE', 2)} AS relevance_score,
            doc_tokens <= allocated AS is_complete, md5(t) AS text_md5 FROM parts""",
            "pack_src AS (SELECT doc_id, source, name, text AS t FROM seeded)",
            *S.redaction_ctes("pack_src", "packed0"),
            *_PACK_CTES,
        )
    ),
)
def context_pack_details(spark, sf):
    d = B.pack_details(seeded_corpus(spark, sf), QUESTION, BUDGET)
    return d.withColumn("rank", c("rank").cast("bigint")).withColumn("text_md5", F.md5("text")).drop("text", "strategy")


RECENT = 300
_LINE_WORDS = f"list_transform({S.lines('text')}, lambda l: len({S.words('l')}))"


@query(
    "budget_recent",
    S.with_seeded(
        f"""SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos), '')) AS text_md5, count(line) AS kept_lines FROM (
        SELECT d.doc_id, CASE WHEN floor(sum(n) OVER (PARTITION BY d.doc_id ORDER BY pos DESC) * 1.3::DOUBLE) <= {RECENT} THEN line END AS line, pos
        FROM (SELECT doc_id, pos, line, len({S.words('line')}) AS n FROM (
          SELECT doc_id, unnest({S.lines('text')}) AS line, generate_subscripts({S.lines('text')}, 1) AS pos FROM seeded)) d)
        GROUP BY doc_id"""
    ),
)
def budget_recent(spark, sf):
    r = seeded_corpus(spark, sf).select("doc_id", "text", B.recent_lines(c("text"), RECENT).alias("t"))
    n = F.when(c("t") == "", F.lit(0)).otherwise(F.size(lines(c("t"))))
    return r.select("doc_id", F.md5("t").alias("text_md5"), n.cast("bigint").alias("kept_lines"))


@query(
    "budget_structure",
    S.with_seeded(
        """SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), any_value(text))) AS text_md5 FROM (
        SELECT doc_id, text, pos, line, trim(line) = '' OR left(trim(line), 1) = '#'
          OR coalesce(left(trim(lag(line) OVER (PARTITION BY doc_id ORDER BY pos)), 1) = '#', FALSE) AS kept
        FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM seeded))
        GROUP BY doc_id"""
    ),
)
def budget_structure(spark, sf):
    return seeded_corpus(spark, sf).select("doc_id", F.md5(B.structure_lines(c("text"))).alias("text_md5"))


_PY = S.unlines(
    f"list_filter({S.lines('t')}, lambda l: regexp_matches(l, '^\\s*(?:@\\w|class\\s+\\w|(?:async\\s+)?def\\s+\\w)'))"
)


@query(
    "budget_load",
    S.with_seeded(
        f"""SELECT doc_id, n <= 300 AS is_complete, how AS priority_used, n AS original_tokens, {S.tok('r')} AS result_tokens,
        n - {S.tok('r')} AS tokens_saved, md5(r) AS text_md5 FROM final""",
        "src AS (SELECT doc_id, name, text AS t FROM seeded)",
        *S.redaction_ctes("src"),
        f"typed AS MATERIALIZED (SELECT *, {S.tok('t')} AS n, {S.routed_type('t', 'name')} AS kind FROM redacted)",
        """planned AS (SELECT *, CASE WHEN starts_with(kind, 'code_') THEN 'signatures' WHEN starts_with(kind, 'data_') THEN 'schema'
            WHEN kind = 'log' THEN 'recent' ELSE 'structure' END AS how FROM typed)""",
        f"""picked AS MATERIALIZED (SELECT *, CASE WHEN n <= 300 THEN t WHEN how = 'signatures' AND ends_with(lower(name), '.py') THEN {_PY}
            WHEN how = 'recent' THEN {S.recent('t', 300)} WHEN how = 'structure' THEN {S.structure('t')} ELSE t END AS c FROM planned)""",
        f"final AS MATERIALIZED (SELECT *, CASE WHEN n <= 300 THEN t ELSE {S.cut('c', 300)} END AS r FROM picked)",
    ),
)
def budget_load(spark, sf):
    return (
        B.budget_load(seeded_corpus(spark, sf), 300)
        .select("doc_id", "loaded.*")
        .withColumn("text_md5", F.md5("text"))
        .drop("text")
    )


# ------------------------------------------------------------------ versions


@query(
    "version_ids",
    S.with_seeded("SELECT doc_id, left(sha256(text), 16) AS version_id FROM seeded"),
)
def version_ids(spark, sf):
    return seeded_corpus(spark, sf).select("doc_id", V.version_id(c("text")).alias("version_id"))


@query(
    "recent_versions",
    """SELECT left(sha256(event_type || props), 16) AS version_id, max(ts) AS stored_at, count(*) AS stores
       FROM events GROUP BY 1 ORDER BY stored_at DESC, version_id LIMIT 100""",
)
def recent_versions(spark, sf):
    stores = load(spark, sf, "events").withColumn("text", F.concat("event_type", "props"))
    return V.keep_recent_versions(stores, "ts")


_PAIRS = "pairs AS (SELECT doc_id, s.text AS old_text, n.text AS new_text FROM seeded s FULL JOIN newer n USING (doc_id))"
_OLD_LINES = "SELECT doc_id, unnest(string_split(old_text, chr(10))) AS line, 1 AS o, 0 AS n FROM pairs WHERE old_text IS DISTINCT FROM new_text AND coalesce(old_text, '') <> ''"
_NEW_LINES = "SELECT doc_id, unnest(string_split(new_text, chr(10))) AS line, 0 AS o, 1 AS n FROM pairs WHERE old_text IS DISTINCT FROM new_text AND coalesce(new_text, '') <> ''"
_DELTA = f"""delta AS (SELECT doc_id, sum(greatest(n - o, 0))::BIGINT AS lines_added, sum(greatest(o - n, 0))::BIGINT AS lines_removed,
  CAST(floor(sum(abs(n - o) * len({S.words("CASE WHEN n > o THEN '+' ELSE '-' END || line")})) * 1.3::DOUBLE) AS BIGINT) AS delta_tokens
  FROM (SELECT doc_id, line, sum(o) AS o, sum(n) AS n FROM ({_OLD_LINES} UNION ALL {_NEW_LINES}) GROUP BY ALL) WHERE n <> o GROUP BY doc_id)"""


@query("line_delta", S.with_seeded("SELECT * FROM delta", S.NEW_CTE, _PAIRS, _DELTA))
def line_delta(spark, sf):
    old = seeded_corpus(spark, sf)
    return V.line_delta(V.snapshot_pairs(old, new_version(old), "doc_id"), "doc_id")


@query(
    "delta_mode",
    S.with_seeded(
        f"""SELECT doc_id, mode, CASE WHEN old_text IS NULL THEN 'full' WHEN a > 0 AND r > 0 THEN 'modified' WHEN a > 0 THEN 'added'
          WHEN r > 0 THEN 'removed' ELSE 'unchanged' END AS change_type, version_id, a AS lines_added, r AS lines_removed, sent AS sent_tokens,
          f AS full_tokens, f - sent AS tokens_saved, CASE WHEN mode = 'unchanged' THEN 100::DOUBLE ELSE {S.pct('f - sent', 'f')} END AS saved_percent
        FROM (SELECT *, CASE WHEN mode = 'full' THEN f ELSE t END AS sent FROM (
          SELECT *, CASE WHEN old_text IS NULL THEN 'full' WHEN a = 0 AND r = 0 THEN 'unchanged' WHEN t >= f THEN 'full' ELSE 'delta' END AS mode FROM (
            SELECT p.doc_id, old_text, left(sha256(new_text), 16) AS version_id, {S.tok('new_text')} AS f,
              CASE WHEN old_text IS NULL THEN 0 ELSE coalesce(lines_added, 0) END AS a,
              CASE WHEN old_text IS NULL THEN 0 ELSE coalesce(lines_removed, 0) END AS r,
              CASE WHEN old_text IS NULL THEN 0 ELSE coalesce(delta_tokens, 0) END AS t
            FROM pairs p LEFT JOIN delta USING (doc_id) WHERE new_text IS NOT NULL)))""",
        S.NEW_CTE,
        _PAIRS,
        _DELTA,
    ),
)
def delta_mode(spark, sf):
    old = seeded_corpus(spark, sf)
    return V.delta_mode(old, new_version(old), "doc_id")


@query("ordered_delta")
def ordered_delta(spark, sf):
    old = seeded_corpus(spark, sf)
    lines = V.ordered_delta(V.changed_pairs(old, new_version(old), "doc_id"), "doc_id")
    count = lambda op: F.count_if(c("op") == op)
    return lines.groupBy("doc_id").agg(
        count("+").alias("added"), count("-").alias("removed"), count(" ").alias("same"), F.count_if("moved").alias("moved")
    )


@query("delta_text")
def delta_text(spark, sf):
    old = seeded_corpus(spark, sf)
    d = V.delta_text(V.changed_pairs(old, new_version(old), "doc_id"), "doc_id")
    return d.select("doc_id", F.md5("changes").alias("changes_md5"), N.count_tokens(c("changes")).alias("tokens"))


@query(
    "changed_docs",
    S.with_seeded(
        """SELECT doc_id, left(sha256(old_text), 16) AS old_id, left(sha256(new_text), 16) AS new_id,
        CASE WHEN old_text IS NULL THEN 'new' WHEN new_text IS NULL THEN 'gone' WHEN old_text = new_text THEN 'same' ELSE 'changed' END AS status
        FROM pairs""",
        S.NEW_CTE,
        _PAIRS,
    ),
)
def changed_docs(spark, sf):
    old = seeded_corpus(spark, sf)
    return V.changed_docs(old, new_version(old), "doc_id")


# --------------------------------------------------------------------- spans

FENCED = T.FENCED_BLOCK
_SIGNALS = " + ".join(f"contains(h, {S.q(s)})::INT" for s in T.CODE_SIGNALS)
_INDENTED = r"(?m)(?:^(?:    |\t).+\n?){3,}"
_REST = S.sub("text", FENCED, "<code>")
CODE_SPANS = (
    f"list_concat({S.hits('text', FENCED)}, list_filter({S.hits(_REST, _INDENTED)}, lambda h: {_SIGNALS} >= 2))"
)
TABLE_SPANS = S.hits("text", r"(?m)(?:^\|.+\|[ \t]*\n)+")
REF_SPANS = S.hits("text", T.INLINE_REF)
RULE_SPANS = f"list_filter({S.hits('text', '(?im)' + T.RULE_LINE)}, lambda h: NOT contains(h, '⟨CODE_BLOCK_') AND NOT contains(h, '⟨RULE_'))"
SPANS = {"code": CODE_SPANS, "table": TABLE_SPANS, "ref": REF_SPANS, "rule": RULE_SPANS}


def _span_query(kind: str, sql: str):
    body = f"""SELECT doc_id, pos, span FROM (SELECT doc_id, unnest(s) AS span, generate_subscripts(s, 1) - 1 AS pos
               FROM (SELECT doc_id, {sql} AS s FROM seeded))"""
    query(f"extract_{kind}_spans", S.with_seeded(body))(
        lambda spark, sf: X.explode_spans(seeded_corpus(spark, sf), kind)
    )


for _kind, _sql in SPANS.items():
    _span_query(_kind, _sql)


@query(
    "placeholder_round_trip",
    S.with_seeded(
        """SELECT doc_id, len(code) AS code, len(tables) AS tables, len(refs) AS refs, len(rules) AS rules,
        md5(t) AS lifted_md5, md5(raw) AS restored_md5 FROM li""",
        "src AS (SELECT doc_id, text AS raw, text AS t FROM seeded)",
        *S.lift_ctes("src", "li"),
    ),
)
def placeholder_round_trip(spark, sf):
    d = X.placeholder_text(seeded_corpus(spark, sf))
    back = X.reinsert(c("lifted.text"), c("lifted"))
    count = lambda k: F.size(f"lifted.{k}").cast("bigint").alias(k)
    return d.select(
        "doc_id",
        count("code"),
        count("tables"),
        count("refs"),
        count("rules"),
        F.md5("lifted.text").alias("lifted_md5"),
        F.md5(back).alias("restored_md5"),
    )


@query(
    "span_inventory",
    S.with_seeded(
        "SELECT source, kind, sum(n)::BIGINT AS spans, count(*) AS documents FROM ("
        + " UNION ALL ".join(
            f"SELECT source, '{k}' AS kind, len({s}) AS n FROM seeded" for k, s in SPANS.items()
        )
        + ") WHERE n > 0 GROUP BY ALL"
    ),
)
def span_inventory(spark, sf):
    return X.span_inventory(seeded_corpus(spark, sf))


def _lost_sql(kind: str, lost: str) -> str:
    return (
        f"SELECT s.doc_id, '{kind}' AS kind, len({lost}) AS lost, "
        f"array_to_string(list_sort({lost})[1:5], ', ') AS samples FROM seeded s JOIN newer n USING (doc_id)"
    )


@query(
    "validate_loss",
    S.with_seeded(
        "SELECT * FROM ("
        + " UNION ALL ".join(_lost_sql(k, l) for k, l in S.lost_lists("s.text", "n.text").items())
        + ") WHERE lost > 0",
        S.NEW_CTE,
    ),
)
def validate_loss(spark, sf):
    old = seeded_corpus(spark, sf).select("doc_id", "text")
    new = new_version(old).select("doc_id", c("text").alias("new_text"))
    lost = unfold(old.join(new, "doc_id"), ["doc_id"], X.lost_values(c("text"), c("new_text")), "k")
    return lost.select("doc_id", "k.kind", "k.lost", F.array_join("k.samples", ", ").alias("samples"))


_REQUESTS = [
    "src AS (SELECT doc_id, text AS t FROM seeded)",
    *S.redaction_ctes("src"),
    f"req AS MATERIALIZED (SELECT doc_id, t AS raw, t, {S.tok('t')} AS n, {S.routed_type('t')} AS kind FROM redacted)",
    *S.lift_ctes("req", "li"),
]


@query(
    "prompt_requests",
    S.with_seeded(
        f"""SELECT doc_id, kind AS content_type, n AS original_tokens, greatest(n, 4000)::BIGINT AS max_output_tokens, md5(t) AS user_md5,
        md5({S.looked_up('kind', T.CONTENT_HINTS)} || chr(10) || chr(10) || {S.q(X.PROFILES['compress']['system_prompt'])}) AS system_md5 FROM li""",
        *_REQUESTS,
    ),
)
def prompt_requests(spark, sf):
    content = lambda i: F.md5(F.get_json_object("request", f"$.messages[{i}].content"))
    return X.prompt_requests(seeded_corpus(spark, sf)).select(
        "doc_id",
        "content_type",
        "original_tokens",
        "max_output_tokens",
        content(1).alias("user_md5"),
        content(0).alias("system_md5"),
    )


@query(
    "accept_shorter",
    S.with_seeded(
        f"""SELECT doc_id, n AS original_tokens, CASE WHEN m < n THEN m ELSE n END AS compressed_tokens,
        CASE WHEN m < n THEN {S.pct('n - m', 'n')} ELSE 0::DOUBLE END AS saved_percent,
        CASE WHEN m >= n THEN 'rewrite was not shorter than input' END AS error,
        md5(CASE WHEN m < n THEN t ELSE raw END) AS text_md5,
        CASE WHEN m < n THEN {S.warnings('raw', 't')} ELSE '' END AS warnings
        FROM (SELECT *, {S.tok('t')} AS m FROM back)""",
        *_REQUESTS,
        f"""resp AS MATERIALIZED (SELECT * EXCLUDE (t), {S.strip("CASE WHEN doc_id % 3 = 0 THEN raw || ' and more' ELSE " + S.without_stop_words('t') + " END")} AS t FROM li)""",
        *S.put_back_ctes("resp", "back"),
    ),
)
def accept_shorter(spark, sf):
    requests = X.prompt_requests(seeded_corpus(spark, sf))
    responses = requests.select(
        "doc_id",
        F.when(c("doc_id") % 3 == 0, F.concat("original_text", F.lit(" and more")))
        .otherwise(C.drop_stop_words(c("lifted.text")))
        .alias("response"),
    )
    return X.accept_shorter(requests, responses).select(
        "doc_id",
        "original_tokens",
        "compressed_tokens",
        "saved_percent",
        "error",
        F.md5("compressed_text").alias("text_md5"),
        F.array_join("warnings", "; ").alias("warnings"),
    )


# -------------------------------------------------------------------- shapes

_EVENT_JSON = (
    "'{\"id\":' || CAST(event_id AS STRING) || ',\"vals\":[' || CAST(user_id AS STRING) || ',1,2.5,null],\"p\":' || props "
    "|| ',\"note\":\"' || repeat(event_type, 12) || '\",\"ok\":true}'"
)
_LEAVES_SQL = f"""
SELECT event_id, '$.id' AS path, 'bigint' AS type, CAST(event_id AS STRING) AS value FROM events
UNION ALL SELECT event_id, '$.vals[0]', 'bigint', CAST(user_id AS STRING) FROM events
UNION ALL SELECT event_id, '$.vals[1]', 'bigint', '1' FROM events
UNION ALL SELECT event_id, '$.vals[]', 'omitted', '...(2 more items)' FROM events
UNION ALL SELECT event_id, '$.p.k', 'bigint', json_extract_string(props, '$.k') FROM events
UNION ALL SELECT event_id, '$.ok', 'boolean', 'true' FROM events
UNION ALL SELECT event_id, '$.note', 'string', CASE WHEN len(n) > 40 THEN left(n, 40) || '...(' || (len(n) - 40) || ' more chars)' ELSE n END
  FROM (SELECT event_id, repeat(event_type, 12) AS n FROM events)
"""


def events_json(spark, sf):
    return spread(load(spark, sf, "events")).select("event_id", F.expr(_EVENT_JSON).alias("payload"))


@query("json_leaves", _LEAVES_SQL)
def json_leaves(spark, sf):
    return K.json_leaves(events_json(spark, sf), "event_id", "payload")


@query(
    "json_shape_profile",
    """SELECT path, type, count(*) * n AS occurrences FROM events, (VALUES ('$.id', 'bigint', 1), ('$.vals[]', 'bigint', 2),
       ('$.vals[]', 'decimal(2,1)', 1), ('$.vals[]', 'void', 1), ('$.p.k', 'bigint', 1), ('$.note', 'string', 1), ('$.ok', 'boolean', 1)) AS t(path, type, n)
       GROUP BY path, type, n""",
)
def json_shape_profile(spark, sf):
    return K.json_shape_profile(events_json(spark, sf), "event_id", "payload")


@query(
    "json_schema",
    """
    WITH f AS (SELECT DISTINCT j.key AS k, CASE WHEN j.type IN ('UBIGINT', 'BIGINT') THEN 'BIGINT'
                 WHEN j.type = 'VARCHAR' THEN 'STRING' ELSE j.type END AS t FROM events, json_each(props) AS j)
    SELECT 'OBJECT<' || string_agg(k || ': ' || t, ', ' ORDER BY k) || '>' AS schema FROM f
    """,
)
def json_schema(spark, sf):
    return K.json_schema(load(spark, sf, "events"), "props")


_ANY_DECLARATION = "(?:" + "|".join(
    f"(?:{p})" for p in T.SCRIPT_DECLARATIONS[:-1]
) + ")"
_SHORTHAND = r"^\s+(\w+)\s*\([^)]*\)\s*\{?"


@query(
    "python_outline",
    S.with_seeded(
        f"""SELECT doc_id, md5({S.unlines(f"list_filter({S.lines('text')}, lambda l: regexp_matches(l, '^\\s*(?:@\\w|class\\s+\\w|(?:async\\s+)?def\\s+\\w)'))")}) AS text_md5 FROM seeded"""
    ),
)
def python_outline(spark, sf):
    return seeded_corpus(spark, sf).select("doc_id", F.md5(K.python_outline(c("text"))).alias("text_md5"))


_SCRIPT_LINE = (
    f"(regexp_matches(l, {S.q(_ANY_DECLARATION)}) OR (regexp_matches(l, {S.q(_SHORTHAND)}) AND NOT list_contains("
    "['if','else','for','while','switch','return','case','throw','try','catch','finally'], regexp_extract(l, "
    f"{S.q(_SHORTHAND)}, 1))))"
)


@query(
    "script_outline",
    S.with_seeded(
        f"""SELECT doc_id, md5({S.unlines(f"list_transform(list_filter({S.lines('text')}, lambda l: {_SCRIPT_LINE}), lambda l: " + S.sub('l', '[{]\\s*$', '{ /* stripped */ }') + ")")}) AS text_md5 FROM seeded"""
    ),
)
def script_outline(spark, sf):
    return seeded_corpus(spark, sf).select("doc_id", F.md5(K.script_outline(c("text"))).alias("text_md5"))


@query(
    "xml_skeleton",
    """SELECT page_id, md5(regexp_replace(html, '(>\\s*)([^<>\\s][^<>]{59})[^<>]+', '\\1\\2…', 'g')) AS html_md5
       FROM pages""",
)
def xml_skeleton(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.md5(K.xml_skeleton(c("html"))).alias("html_md5"))


_SCALAR = r"^( *(?:- )?(?:[^\s:#][^:]*: +)?)(.*)$"


@query(
    "yaml_skeleton",
    f"""
    WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE NOT contains(text, chr(13))),
    i AS (SELECT doc_id, source, len(ls) AS n, list_transform(ls[1:2], lambda l: '- ' || l) AS items FROM d),
    s AS (SELECT *, list_transform(items, lambda l: regexp_extract(l, {S.q(_SCALAR)}, 2)) AS vs FROM i)
    SELECT doc_id, md5('doc_id: ' || doc_id || chr(10) || 'source: ' || source || chr(10) || 'text:' || chr(10) ||
      array_to_string(list_transform(range(1, len(items) + 1), lambda k: CASE WHEN len(vs[k]) > 40
        THEN left(items[k], len(items[k]) - len(vs[k])) || left(vs[k], 40) || '...(' || (len(vs[k]) - 40) || ' more chars)'
        ELSE items[k] END), chr(10)) ||
      CASE WHEN n > 2 THEN chr(10) || '- ...(' || (n - 2) || ' more items)' ELSE '' END) AS yaml_md5 FROM s
    """,
)
def yaml_skeleton(spark, sf):
    # The SQL covers texts without CR and nulls; tests/test_skeletons.py covers the others.
    listed = F.transform(F.split(text_of("text"), "\r\n?|\n"), lambda l: F.concat(F.lit("- "), l))
    ident, source = text_of(c("doc_id").cast("string")), text_of("source")
    head = F.concat(F.lit("doc_id: "), ident, F.lit("\nsource: "), source, F.lit("\ntext:\n"))
    body = F.concat(head, F.array_join(listed, "\n"))
    return load(spark, sf, "documents").select("doc_id", F.md5(K.yaml_skeleton(body)).alias("yaml_md5"))


# ------------------------------------------------------------------- history

ORDER = ["ts", "event_id"]


@query(
    "history_dedup",
    """SELECT user_id, event_type, min(ts) AS created_at, max(ts) AS touched_at, arg_max(event_id, ts) AS last_seq, count(*) AS touches,
       row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC)::INT AS recency FROM events GROUP BY user_id, event_type""",
)
def history_dedup(spark, sf):
    return H.history_dedup(load(spark, sf, "events"), "user_id", "ts", "event_id", "event_type")


@query("history_dedup_payloads")
def history_dedup_payloads(spark, sf):
    return H.history_dedup(load(spark, sf, "events"), "user_id", "ts", "event_id", "props")


@query(
    "bounded_history",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS recency
       FROM events QUALIFY recency <= 50""",
)
def bounded_history(spark, sf):
    return H.bounded_history(load(spark, sf, "events"), "user_id", ORDER).select(
        "user_id", "event_id", "recency"
    )


@query(
    "adjacent_dedup",
    """SELECT event_id, user_id, event_type FROM events
       QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type""",
)
def adjacent_dedup(spark, sf):
    return H.adjacent_dedup(load(spark, sf, "events"), "user_id", ORDER, "event_type").select(
        "event_id", "user_id", "event_type"
    )


_QUIET = f"""coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) >= {int(GAP * 1e6)}, TRUE)"""
_DEBOUNCED = f"SELECT event_id, user_id, event_type FROM events QUALIFY {_QUIET}"


@query("debounce_events", _DEBOUNCED)
def debounce_events(spark, sf):
    return H.debounce(load(spark, sf, "events"), "user_id", ORDER, GAP).select(
        "event_id", "user_id", "event_type"
    )


@query(
    "burst_stats",
    f"""SELECT user_id, min(ts) AS burst_start, max(ts) AS burst_end, count(*) AS events,
          (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS seconds
        FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
          SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < {int(GAP * 1e6)} THEN 0 ELSE 1 END AS s FROM events))
        GROUP BY user_id, burst""",
)
def burst_stats(spark, sf):
    return H.burst_stats(load(spark, sf, "events"), "user_id", ORDER, GAP)


@query(
    "neighbour_entry",
    """SELECT user_id, event_id, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY recency) AS neighbour
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events) WHERE recency <= 50
    """,
)
def neighbour_entry(spark, sf):
    newest = H.bounded_history(load(spark, sf, "events"), "user_id", ORDER)
    return H.neighbour_entry(newest, "user_id", "event_id", 2).select("user_id", "event_id", "neighbour")


# ------------------------------------------------------------------- streams

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string"


def event_folder(spark, sf, text=None, name: str = "event_type") -> str:
    """The events as files of a stream, closed by one event far in the future."""
    folder = scratch(spark) + "/events"
    text = c("event_type") if text is None else text
    rows = load(spark, sf, "events").select(
        "event_id", c("ts").cast("timestamp").alias("ts"), "user_id", text.alias(name)
    )
    rows.write.parquet(folder)
    last = rows.agg(
        F.lit(-1).cast("bigint").alias("event_id"),
        (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
        F.lit(-1).cast("bigint").alias("user_id"),
        F.lit("the end").alias(name),
    )
    last.write.mode("append").parquet(folder)
    return folder


def run_to_parquet(spark, stream: DataFrame, mode: str) -> DataFrame:
    base = scratch(spark)
    out = base + "/out"
    E.write_batches(stream, E.batch_folder(out), base + "/state", True, mode).awaitTermination()
    return E.written_batches(spark, out, stream.schema).drop("batch")


@query("debounce_stream", _DEBOUNCED)
def debounce_stream(spark, sf):
    events = E.read_event_stream(spark, EVENT_SCHEMA, event_folder(spark, sf), "event_type")
    out = E.debounce_stream(events, "user_id", "ts", GAP, seq="event_id")
    done = run_to_parquet(spark, out, "append")
    return done.where("user_id >= 0").select("event_id", "user_id", "event_type")


@query(
    "crunch_stream",
    S.recursive(
        S.with_seeded(
            f"""SELECT conv_id, turn, CASE WHEN saved THEN 'Compressed' WHEN z IS NOT NULL THEN 'Compact' ELSE 'Original' END AS label,
            CASE WHEN saved THEN p WHEN z IS NOT NULL THEN {S.pct('len(text) - len(z)', 'len(text)')} ELSE 0::DOUBLE END AS saved_percent,
            md5(nullif(CASE WHEN saved THEN t WHEN z IS NOT NULL THEN z ELSE text END, text)) AS write_back_md5
            FROM (SELECT *, t <> '' AND t <> text AND p > 0 AS saved FROM (
              SELECT conv_id, turn, text, t, {_compact_sql('text')} AS z, {S.pct('rn0 - rn1', 'rn0')} AS p FROM rt))""",
            f"""src AS (SELECT conv_id, turn, conv_id * 1000000 + turn AS doc_id, NULL::VARCHAR AS name, text, text AS t
               FROM conversations WHERE len({S.strip('text')}) >= 5)""",
            *S.route_ctes("src", "rt"),
        )
    ),
)
def crunch_stream(spark, sf):
    turns = E.read_event_stream(
        spark, "conv_id bigint, turn bigint, role string, text string", f"{sf}/conversations*.parquet"
    )
    out = E.crunch_stream(turns).select(
        "conv_id", "turn", "active.label", "active.saved_percent", F.md5("write_back").alias("write_back_md5")
    )
    return run_to_parquet(spark, out, "append")


@query("crunch_history_stream")
def crunch_history_stream(spark, sf):
    """The history of each user after bursts, guard and variants, all in one stream."""
    schema = EVENT_SCHEMA.replace("event_type string", "text string")
    source = E.read_event_stream(spark, schema, event_folder(spark, sf, F.concat_ws(" ", "event_type", "props"), "text"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", E.STATE_STORE)
    out = E.crunch_history_stream(source, "user_id", "ts", "event_id", delay_seconds=GAP)
    done = run_to_parquet(spark, out, "append").where("user_id >= 0")
    return E.latest_entries(done, "user_id")
