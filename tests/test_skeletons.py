"""XML and YAML skeletons, and placeholders put back in one pass."""

import hashlib
import re

from pyspark.sql import functions as F

from corpusmill.operators import shape as K
from corpusmill.operators import spans as X
from corpusmill.plans.catalog import QUERIES

YAML = """name: demo
long: aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa
items:
  - one
  - two
  - three
  - four

nested:
- a: 1
  sub:
    - x
    - y
    - z
- b: 2
- c: 3
  sub2:
    - p
    - q
    - r
end: 1"""

SHORT = """name: demo
long: aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa...(20 more chars)
items:
  - one
  - two
  - ...(2 more items)
nested:
- a: 1
  sub:
    - x
    - y
    - ...(1 more items)
- b: 2
- ...(1 more items)
end: 1"""


def test_yaml_keeps_keys_and_two_items(mapped):
    assert mapped(K.yaml_skeleton, YAML, "a: 1", "", "- a\n- b\n- c") == [SHORT, "a: 1", "", "- a\n- b\n- ...(1 more items)"]


def test_yaml_query_covers_carriage_returns_and_nulls(spark, tmp_path):
    long = "w" * 50
    texts = ["a\r\nb\r\nc", f"{long}\rk: {long}", "a\n\rb\r", f"x\u2028{long}\r\n{long}\u0085", "\r\n", None, "", "one\ntwo\nthree"]
    rows = [(k, t, None if k == 1 else "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def item(line):
        m = re.match(r"(?s)( *(?:- )?(?:[^\s:#][^:]*: +)?)(.*)\Z", f"- {line}")
        return m[0] if len(m[2]) <= 40 else f"{m[1]}{m[2][:40]}...({len(m[2]) - 40} more chars)"

    want = {}
    for k, t, source in rows:
        items = re.split(r"\r\n|\r|\n", t or "")
        out = [f"doc_id: {k}", f"source: {source or ''}", "text:", *map(item, items[:2])]
        out += [f"- ...({len(items) - 2} more items)"] if len(items) > 2 else []
        want[k] = hashlib.md5("\n".join(out).encode()).hexdigest()
    assert {r.doc_id: r.yaml_md5 for r in QUERIES["yaml_skeleton"](spark, str(tmp_path)).collect()} == want


def test_xml_keeps_tags_and_attributes(mapped):
    xml = '<a b="1"><c>short</c><d>\n  ' + "t" * 80 + "</d></a>"
    want = '<a b="1"><c>short</c><d>\n  ' + "t" * 60 + "…</d></a>"
    assert mapped(K.xml_skeleton, xml, "<a/>", "no markup") == [want, "<a/>", "no markup"]


def test_markup_and_yaml_reach_their_skeletons(spark):
    df = spark.createDataFrame([(YAML, "x.yml"), ("<a>" + "t" * 80 + "</a>", "y.xml")], "text string, name string")
    kind = K.outline_kind(F.lit("data_yaml"), F.col("name"))
    got = [r.skeleton for r in K.with_skeleton(df, "text", kind).collect()]
    assert got == [SHORT, "<a>" + "t" * 60 + "…</a>"]


def test_very_many_references_come_back(spark):
    text = " ".join(f"`ref_{k}.py`" for k in range(50_000))
    lifted = X.placeholder_text(spark.createDataFrame([(1, text)], "id int, text string"))
    (r,) = lifted.select(X.reinsert(F.col("lifted.text"), F.col("lifted")).alias("t"), F.size("lifted.refs").alias("n")).collect()
    assert r.n == 50_000 and r.t == text
