"""A corpus derived from `documents` in which every rule has something to do.

Each whole document gets a suffix chosen by its id. The suffix is one SQL
expression that Spark and other engines read alike (only concat, md5, substr,
upper, reverse, base64, unhex, chr, %), so no secret-shaped literal is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.tables import load, spread

H = "md5(CAST(doc_id AS STRING))"
UUID = (
    f"substr({H}, 1, 8) || '-' || substr({H}, 9, 4) || '-' || substr({H}, 13, 4) || '-' || "
    f"substr({H}, 17, 4) || '-' || substr({H}, 21, 12)"
)


def _text(*lines: str) -> str:
    return " || chr(10) || ".join(lines)


SUFFIXES = [
    _text(
        f"'key ' || 'AK' || 'IA' || upper(substr({H}, 1, 16)) || ' end'",
        f"'aws_secret' || '_access_key = ' || base64(unhex({H} || substr({H}, 1, 28)))",
    ),
    _text(
        f"'token gh' || 'p_' || {H} || substr({H}, 1, 4)",
        f"'pay sk' || '_live_' || {H} || ' and sk' || '-proj-' || {H}",
    ),
    _text(
        f"'auth ey' || 'J' || {H} || '.ey' || 'J' || reverse({H}) || '.' || {H}",
        "'-----BEGIN RSA PRIV' || 'ATE KEY-----'",
        H,
        "'-----END RSA PRIV' || 'ATE KEY-----'",
    ),
    _text(
        "'host 10.20.' || CAST(doc_id % 256 AS STRING) || '.7 up, python 3.10.2.1 ok'",
        "'bad 999.1.2.3.4 and version 1.2.3.4 next to 192.168.0.1.'",
    ),
    _text(
        f"'see https://example.org/api/' || {UUID}",
        f"'id: ' || {UUID}",
        f"'the secret value ' || {UUID} || ' and ' || {UUID}",
        "'a line of more than eighty plain characters that keeps the earlier words out of the window'",
        f"'plain ' || {UUID}",
    ),
    _text(f"'blob ' || base64(unhex({H} || reverse({H}))) || ' done'", f"'hash ' || {H}"),
    _text(
        "'# Overview of the application'",
        "'The **main** part is in [the guide](https://example.org/guide).'",
        "'## Requirements'",
        "'* first item'",
        "'+ second item'",
        "'---'",
        "'| name  | value |  |'",
        "'|-------|-------|--|'",
        "'| alpha | ' || CAST(doc_id AS STRING) || ' |  |'",
        "'after the table'",
    ),
    _text(
        "'2025-01-02 10:00:01 INFO service started'",
        "'2025-01-02 10:00:02 WARN slow request'",
        "'2025-01-02 10:00:03 ERROR failed ' || CAST(doc_id AS STRING)",
        "'[2025-01-02] DEBUG retry'",
        "'[2025-01-02] DEBUG retry'",
    ),
    _text(
        "'Use `main.py` and `load_config` here.'",
        "'```python'",
        "'def run(a):'",
        "'    return a  +  1'",
        "'```'",
        "'    total = compute(a)'",
        "'    if total:'",
        "'        return total'",
        "'Done with `x`.'",
        "'```'",
        "'# comment'",
        "'make build'",
        "'```'",
    ),
    _text(
        "'It is important to note that the configuration should be ready, in order to run basically'",
        "'The implementation is able to handle requests!!! Additionally it contains information however'",
        "'Please make sure to take into account a large number of objects because the function is there only'",
        "'Mail to john.doe@example.org or see https://example.org/a?utm_source=x&b=1 for the docs'",
        "'Path /usr/local/lib/python/site.py and www.example.org/p?utm_medium=y'",
        "'Zu dem Zweck ist es sehr wichtig, und im Rahmen von Tests'",
    ),
    _text(
        "'You must NEVER delete the file'",
        "'ALWAYS keep backups'",
        "'Der Nutzer darf nicht raten'",
        "'TODO check the version v1.2.3 until Monday 12.04.2026'",
        "'They MUST NOT guess; do not retry, it is FORBIDDEN and critical'",
    ),
    "'no special content'",
]
EXTENSIONS = [".md", ".py", ".json", ".log", ".txt", ""]

SUFFIX = "CASE CAST(doc_id % 12 AS INT) " + " ".join(
    f"WHEN {i} THEN {s}" for i, s in enumerate(SUFFIXES)
) + " END"
NAME = (
    "CASE CAST(doc_id % 6 AS INT) "
    + " ".join(
        f"WHEN {i} THEN 'doc_' || CAST(doc_id AS STRING) || '{e}'" for i, e in enumerate(EXTENSIONS[:5])
    )
    + " ELSE 'set_' || CAST(doc_id AS STRING) || '/AGENTS.md' END"
)
TEXT = f"text || chr(10) || ({SUFFIX})"

# The oracle's form of the same corpus, to be used as a CTE.
SEEDED_SQL = f"SELECT doc_id, {NAME} AS name, {TEXT} AS text, source FROM documents"


def seeded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name, text, source over all of `documents`."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select(
        "doc_id", F.expr(NAME).alias("name"), F.expr(TEXT).alias("text"), "source"
    )


# A second version of the corpus: lines gone, lines added, documents gone and new.


def new_version(old: DataFrame) -> DataFrame:
    """Every tenth document gone, every seventh untouched, ids beyond 10^9 new."""
    lines = F.filter(F.split("text", "\n"), lambda l, i: i % 7 != 3)
    edited = F.concat(
        F.array_join(lines, "\n"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\nappended "), F.col("doc_id").cast("string"))).otherwise(
            F.lit("")
        ),
    )
    text = F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(edited)
    kept = old.where(F.col("doc_id") % 10 != 9).withColumn("text", text)
    added = old.where(F.col("doc_id") % 10 == 9).withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    return kept.unionByName(added)


NEW_SQL = """
SELECT doc_id, name, source,
  CASE WHEN doc_id % 7 = 0 THEN text ELSE
    array_to_string(list_filter(string_split(text, chr(10)), lambda l, i: (i - 1) % 7 <> 3), chr(10))
    || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'appended ' || CAST(doc_id AS STRING) ELSE '' END
  END AS text
FROM seeded WHERE doc_id % 10 <> 9
UNION ALL
SELECT doc_id + 1000000000, name, source, text FROM seeded WHERE doc_id % 10 = 9
"""
