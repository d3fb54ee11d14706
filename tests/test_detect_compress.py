import random

from pyspark.sql import functions as F

from corpusmill.functions import lexicons as L
from corpusmill.functions.text import ANY_CASE, split_lines, strip
from corpusmill.operators import compress as C
from corpusmill.operators import detect as D


def test_types_by_text(mapped):
    cases = {
        "": "prose",
        "[1] INFO a\n2025 ERROR b\n3 warn c": "log",
        "From: a\nSubject: b": "email",
        "Skip to content\ncookie\nsign in": "web_scrape",
        "# A\ntext\n## B": "markdown",
        "def f(a):\n    return a": "code_python",
        "The def of a word": "prose",
        "const a = 1;\nlet b = 2;": "code_js",
        "  if (a) {\n  x();\n  }\n  y();": "code_generic",
        "\n" * 40 + "# A\n## B": "markdown",
        "x\n" * 31 + "# A\n## B": "markdown",
    }
    assert mapped(D.detect_type, *cases) == list(cases.values())
    head = lambda t: D.detect_type(t, D.HEAD_LINES)
    assert mapped(head, *cases) == [*list(cases.values())[:-1], "prose"]


def test_types_by_name_and_rules(spark):
    rules = "NEVER a. ALWAYS b. MUST NOT c. do not d. forbidden e."
    cases = [
        ("x", "src/A.PY", "code_python"),
        ("x", "dir/CLAUDE.md", "agent_config"),
        ("x", "dir\\.cursorrules", "agent_config"),
        ("x", "a.unknown", "prose"),
        ('{"a": 1}', "", "data_json"),
        ("<a></a>", None, "data_xml"),
        (rules, "", "agent_config"),
        ("y" * 5000 + " " + rules, "", "agent_config"),
        ("def f():\n  pass", "", "prose"),
        ('{"l": 1} INFO', "", "prose"),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, t string, n string, w string")
    rows = df.select("i", "w", D.route_type(F.col("t"), F.col("n")).alias("k")).collect()
    assert [(r.i, r.k) for r in rows] == [(r.i, r.w) for r in rows]
    head = df.where("i = 7").select(D.route_type(F.col("t"), F.col("n"), None, D.HEAD_LINES, D.HEAD_CHARS).alias("k"))
    assert head.first().k == "prose"


def test_fenced_blocks_kept_or_shortened(mapped):
    text = (
        "a\n```python\nx = 1\n```\nb\n```\n├── a  # note\n│   └── b\n```\n```bash\n# hi\n\n  ls\n```\n"
        "```c```\n```\ndo it\n```"
    )
    p = mapped(C.protect_blocks, text)[0]
    assert p.blocks == ["```python\nx = 1\n```", "```\ndo it\n```"]
    assert p.text == (
        "a\n__PROTECTED_0__\nb\n```\n a\n b\n```\n```\nls\n```\n```c```\n__PROTECTED_1__"
    )


def test_restore_with_many_blocks(mapped):
    text = "\n".join(f"```py\nv{i}\n```" for i in range(12))
    fn = lambda t: C.restore_blocks(C.protect_blocks(t)["text"], C.protect_blocks(t)["blocks"])
    assert mapped(fn, text) == [text]


def model_dedup(text):
    """Lines not among the three kept before; one blank line at a time."""
    out, recent = [], []
    rows = text.split("\n")
    if len(rows) <= 5:
        return text
    for row in rows:
        bare = row.strip()
        if bare in recent or (not bare and out and not out[-1].strip()):
            continue
        out.append(row)
        recent = (recent + [bare])[-3:] if bare else recent
    return "\n".join(out)


def test_dedup_equals_model(mapped):
    rng = random.Random(7)
    cases = ["\n".join(rng.choice(["a", "b ", " c", "d", "", " ", "e"]) for _ in range(n)) for n in range(1, 60)]
    cases.append("\n".join(rng.choice("abcdef") for _ in range(3000)))
    assert mapped(lambda t: C.dedup_lines(t)["text"], *cases) == [model_dedup(t) for t in cases]


def test_stop_words_and_skipped_lines(mapped):
    cases = {
        "The cat, is on a mat": "cat, on mat",
        "# The title is": "# The title is",
        "the deadline is the day": "the deadline is the day",
        "| the | a |": "| the | a |",
        "Der Hund und die Katze sind sehr müde": "Hund und Katze sind müde",
        "This is v1.2.3 of it": "This is v1.2.3 of it",
    }
    assert mapped(C.drop_stop_words, *cases) == list(cases.values())


def test_fillers_longest_first(mapped):
    out = mapped(C.drop_fillers, "Due to the fact that x, basically y as well as z")[0]
    assert out.text == " x,  y  z" and out.n == 3
    assert out.found == ["Due to the fact that", "as well as", "basically"]


def test_synonyms_in_order(mapped):
    cases = {
        "Implementation of functions": ("impl of fns", 2),
        "it requires to be done, must be": ("it → done, →", 3),
        "the specific, unfortunately late": ("the ,  late", 2),
        "functional": ("functional", 0),
    }
    assert [tuple(r) for r in mapped(C.synonyms, *cases)] == list(cases.values())


def test_references_and_paths(mapped):
    cases = {
        "go https://a.b/c?utm_source=x now": ("go [URL] now", 1, 0),
        "a.b/c?utm_source=x&b=1": ("a.b/c&b=1", 0, 0),
        "mail a.b@c.org": ("mail [EMAIL]", 0, 0),
        "/usr/local/lib/x.py /a/b": (".../lib/x.py /a/b", 0, 1),
        "C:\\Users\\me\\f.txt": (".../Users/mef.txt", 0, 1),
    }
    assert [tuple(r) for r in mapped(C.shorten_refs, *cases)] == list(cases.values())


def test_telegraphic_only_thins_long_lines(mapped):
    cases = {
        "some such thing": "some such thing",
        "we carry out every one of the tests here and there for you": "we run one of the tests and for you",
        "Please note that x  is": "x is",
        "so as far as the data is concerned ok": "so about ok",
    }
    assert [r.text for r in mapped(C.telegraphic, *cases)] == list(cases.values())


def test_structure_and_tables(mapped):
    cases = {
        "## Title  \n- **a** `b`\n---\n*i* [t](u)": "Title:\na b\n\ni t",
        "| a | b |\n|---|---|\n| 1 |  |\nx": "|a|b|\n|1|\nx",
        "x\n| a |\n|---|": "x\n|a|",
        "||\n|  |  |": "||\n||",
        "--": "",
    }
    assert [r.text for r in mapped(C.structural, *cases)] == list(cases.values())


def test_minify_prose_saves_and_code_survives(spark, texts):
    prose = (
        "It is important to note that the application is basically able to process a large number of "
        "requests. In order to do this, the configuration should be available in the environment, and "
        "the documentation provides the necessary information for the administrator."
    )
    code = "import os\n\ndef run(a, the):\n\tx  =  a   # is the\n\treturn x\n"
    rows = C.minify(texts(prose, code, "", "   ")).orderBy("doc_id").collect()
    p, k, e, blank = [r.compressed for r in rows]
    assert p.saved_percent > 10 and p.content_type == "prose"
    assert p.techniques_applied[:3] == ["detect:prose", "normalize", "filler_trim"]
    assert k.content_type == "code_python" and "code_safe_mode" in k.techniques_applied
    compile(k.text, "code", "exec")
    assert k.text == "import os\ndef run(a, the):\n  x = a # is the\n  return x"
    assert e.content_type == "empty" and blank.content_type == "empty" and blank.text == "   "


def test_minify_wraps(texts):
    assert C.minify(texts("plain words"), wrap_tag="context").first().compressed.text == (
        "<context>\nplain words\n</context>"
    )


def test_ocr_repair(mapped):
    out = mapped(C.repair_ocr_text, "• 2e26 \n\n Ø1 e5", "- a\n- b")
    assert out == ["2026\n01 e5", "a\n- b"]


def test_critical_lines_agree_with_the_whole_pattern(mapped):
    texts = [
        "plain\nat 12:30\nv1.2\n1.2.3-rc\n1:2\n12-04-2026\na1.2\n3/4/99x",
        "residue\ndues\nDUE now\nUnTil\nbis zum\nbis  zum\nFÄLLIG\nfällig",
        "monday\ntoday\nSamſtag\nTagung\nſunday\nhacK\nsonntags\n Freitag \n",
        "٣.٤\n٣:٤٥\nxv2.0\nV2.0\nv 2.0\n1.2́",
        "no sign at all\n\nnone",
        "",
    ]
    whole = lambda t: F.transform(F.split(t, "\n"), lambda l: strip(l).rlike(ANY_CASE + L.CRITICAL_LINE))
    got, wanted = mapped(C.critical_lines, *texts), mapped(whole, *texts)
    assert [g if g is not None else [False] * len(w) for g, w in zip(got, wanted)] == wanted
    assert got[-2:] == [None, None]


def test_lines_end_at_every_line_end(mapped):
    texts = ["a\nb\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd", "a\x85b c ", "", "\n", "a b"]
    assert mapped(split_lines, *texts) == [t.splitlines() for t in texts]


def test_types_are_told_without_taking_the_lines_apart(mapped):
    cases = {
        "From: a\rSubject: b": "email",
        "x from:\nDATE: y": "email",
        "from: only": "prose",
        "# a\r\n## b\r\n": "markdown",
        "# a\n#b": "prose",
        "\x0b# a\x0c# b\x0c": "markdown",
        " \r\n ": "prose",
        "[1] INFO\r2 WARN 3 error": "log",
    }
    assert mapped(D.detect_type, *cases) == list(cases.values())
    assert mapped(lambda t: D.detect_type(t, 1), "# a\n# b", "# a") == ["prose", "prose"]
