"""Building blocks of the oracle SQL, written from the rules for another engine.

The other engine's regexes know no look-around and no back-reference, so rules
that need them are put in other words here.
"""

from __future__ import annotations

from corpusmill.functions import lexicons as L
from corpusmill.functions import tables as T
from corpusmill.plans.seeded import NEW_SQL, SEEDED_SQL

NL = "chr(10)"


def q(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def with_seeded(body: str, *ctes: str) -> str:
    return ", ".join([f"WITH seeded AS ({SEEDED_SQL})", *ctes]) + " " + body


NEW_CTE = f"newer AS ({NEW_SQL})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def tok(x: str) -> str:
    return f"CAST(floor(len({words(x)}) * 1.3::DOUBLE) AS BIGINT)"


def rnd(x: str, digits: int) -> str:
    scale = f"{float(10 ** digits)}::DOUBLE"
    return f"(floor(({x}) * {scale} + 0.5::DOUBLE) / {scale})"


def pct(part: str, whole: str, digits: int = 1) -> str:
    ratio = f"(({part})::DOUBLE / nullif(({whole})::DOUBLE, 0::DOUBLE) * 100::DOUBLE)"
    return f"coalesce({rnd(ratio, digits)}, 0::DOUBLE)"


def sub(x: str, pattern: str, put: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(put)}, 'g')"


def hits(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {q(pattern)})"


def lines(x: str) -> str:
    return f"string_split({x}, {NL})"


def unlines(x: str) -> str:
    return f"array_to_string({x}, {NL})"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def model_rows(table: dict, value: str) -> str:
    rows = ", ".join(f"({i}, {q(m)}, {v}::{value})" for i, (m, v) in enumerate(table.items()))
    return f"(VALUES {rows}) AS m(model_ord, model, v)"


# ----------------------------------------------------------------- redaction


def known(x: str) -> str:
    for tag, _, pattern in T.SECRET_PATTERNS:
        x = sub(x, pattern, tag)
    return x


def pieces(x: str, pattern: str) -> str:
    """A struct of the gaps and the hits of a pattern in a text."""
    return f"{{'g': string_split_regex({x}, {q(pattern)}), 'h': {hits(x, pattern)}}}"


def rebuilt(p: str, put: str) -> str:
    """Gaps and replaced hits, where `put` sees the hit as h and its index as i."""
    body = f"list_transform({p}.h, lambda h, i: {p}.g[i] || ({put}))"
    return f"(array_to_string({body}, '') || {p}.g[-1])"


def before(p: str, chars: int) -> str:
    all_before = (
        f"array_to_string(list_transform(range(1, i + 1), "
        f"lambda j: {p}.g[j] || CASE WHEN j < i THEN {p}.h[j] ELSE '' END), '')"
    )
    return f"right({all_before}, {chars})"


IP_PUT = (
    "CASE WHEN len(list_filter(string_split(h, '.'), lambda o: CAST(o AS INT) > 255)) > 0 "
    f"OR regexp_matches(right(p.g[i], {T.VERSION_LOOK_BACK}), {q('(?i)' + T.VERSION_WORD)}) "
    f"THEN h ELSE {q(T.IP_TAG)} END"
)
_UUID_BEFORE = before("p", T.UUID_LOOK_BACK)
UUID_PUT = (
    f"CASE WHEN regexp_matches({_UUID_BEFORE}, {q('(?i)' + T.URL_BEFORE)}) "
    f"OR regexp_matches({_UUID_BEFORE}, {q('(?i)' + T.ID_KEY_BEFORE)}) THEN h "
    f"WHEN regexp_matches({_UUID_BEFORE}, {q('(?i)' + T.SECRET_WORD)}) "
    f"THEN {q(T.UUID_TAG)} ELSE h END"
)
LONG_TOKEN = r"""[^\s"'`(){}\[\],;:]{20,}"""


def bits(token: str) -> str:
    """Entropy in bits per character, from character counts."""
    return f"list_aggregate(string_split({token}, ''), 'entropy')"


def secret(token: str) -> str:
    return (
        f"(NOT contains({token}, '.') AND regexp_matches({token}, '[\\p{{Lu}}\\p{{Nd}}+/=_\\-]') "
        f"AND len(regexp_extract_all({token}, '[A-Za-z0-9+/=_\\-]')) >= 0.85::DOUBLE * len({token}) "
        f"AND {bits(token)} >= 4.5)"
    )


SECRET_PUT = f"CASE WHEN {secret('h')} THEN {q(T.ENTROPY_TAG)} ELSE h END"


def stage(src: str, pattern: str, put: str) -> str:
    """A CTE body that replaces context-dependent hits in `src`.t."""
    return (
        f"SELECT * EXCLUDE (p, t), {rebuilt('p', put)} AS t "
        f"FROM (SELECT *, {pieces('t', pattern)} AS p FROM {src})"
    )


def redaction_ctes(src: str, out: str = "redacted") -> list[str]:
    """CTEs from `src`(..., t) to `out`(..., t), in the four steps of the rule."""
    return [
        f"{out}1 AS (SELECT * EXCLUDE (t), {known('t')} AS t FROM {src})",
        f"{out}2 AS ({stage(out + '1', T.IPV4, IP_PUT)})",
        f"{out}3 AS ({stage(out + '2', T.UUID, UUID_PUT)})",
        f"{out} AS MATERIALIZED ({stage(out + '3', LONG_TOKEN, SECRET_PUT)})",
    ]


# --------------------------------------------------------------- detection


def head(x: str) -> str:
    return lines(strip(x))


def detect(x: str) -> str:
    sample = f"lower({unlines(head(x))})"
    present = lambda marks: " + ".join(f"contains({sample}, {q(m)})::INT" for m in marks)
    matching = lambda pattern: (
        f"len(list_filter({head(x)}, lambda l: regexp_matches(l, {q(pattern)})))"
    )
    return (
        f"CASE WHEN {strip(x)} = '' THEN 'prose' "
        f"WHEN {matching('(?i)' + T.LOG_LINE)} >= 3 THEN 'log' "
        f"WHEN {present(T.EMAIL_MARKERS)} >= 2 THEN 'email' "
        f"WHEN {present(T.WEB_MARKERS)} >= 3 THEN 'web_scrape' "
        f"WHEN {matching('^#{1,6}\\s')} >= 2 THEN 'markdown' "
        f"WHEN {raw_code(x)} <> '' THEN {raw_code(x)} ELSE 'prose' END"
    )


def raw_code(x: str) -> str:
    n = lambda pattern: f"len({hits(x, '(?m)' + pattern)})"
    has = lambda pattern: f"regexp_matches({x}, {q('(?m)' + pattern)})"
    indented = has(r"^[ \t]{2,}\S")
    py, js = n(T.PYTHON_SIGNAL), n(T.SCRIPT_SIGNAL)
    return (
        f"CASE WHEN {py} >= 1 AND {py} >= {js} AND ({py} >= 2 OR {indented} OR {has(':\\s*$')}) "
        f"THEN 'code_python' "
        f"WHEN {js} >= 1 AND ({js} >= 2 OR {has('[;{}]\\s*$')}) THEN 'code_js' "
        f"WHEN {n(T.GENERIC_SIGNAL)} >= 3 AND {indented} THEN 'code_generic' ELSE '' END"
    )


def looked_up(x: str, table: dict[str, str]) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def named_type(name: str) -> str:
    base = f"lower(regexp_extract({name}, '([^/\\\\]*)$', 1))"
    ext = f"'.' || lower(regexp_extract({name}, '\\.([^.]*)$', 1))"
    return (
        f"CASE WHEN list_contains({listed(T.AGENT_CONFIG_NAMES)}, {base}) THEN 'agent_config' "
        f"WHEN contains({name}, '.') THEN {looked_up('(' + ext + ')', T.TYPE_BY_EXTENSION)} END"
    )


def routed_type(x: str, name: str | None = None) -> str:
    keywords = f"len({hits(x, '(?i)' + T.AGENT_CONFIG_KEYWORDS)})"
    s = strip(x)
    shape = (
        f"CASE WHEN left({s}, 1) IN ('{{', '[') AND right({s}, 1) IN ('}}', ']') THEN 'data_json' "
        f"WHEN left({s}, 1) = '<' AND right({s}, 1) = '>' THEN 'data_xml' ELSE 'prose' END"
    )
    by_text = (
        f"CASE WHEN {keywords} >= 5 THEN 'agent_config' "
        f"WHEN ({detect(x)}) IN ('log', 'email', 'web_scrape', 'markdown') THEN {detect(x)} "
        f"ELSE {shape} END"
    )
    return f"coalesce({named_type(name)}, {by_text})" if name else by_text


def category(kind: str) -> str:
    return f"coalesce({looked_up(kind, T.CATEGORY_BY_TYPE)}, 'prose')"


# -------------------------------------------------------------- compression


def normalized(x: str) -> str:
    for fancy, plain in L.SMART_PUNCTUATION:
        x = f"replace({x}, {q(fancy)}, {q(plain)})"
    x = sub(x, f"(?m)^[ \\t]*[{L.FANCY_BULLETS}]", "- ")
    x = f"replace({x}, chr(9), '  ')"
    x = sub(x, r"(?m)[ \t]+$")
    x = sub(x, r"([^\n])[ \t]{2,}", r"\1 ")
    for mark in ("!", r"\?", r"\."):
        x = sub(x, mark + "{3,}", mark[-1])
    return x


def without_fillers(x: str) -> str:
    for phrase in sorted(L.FILLER_PHRASES, key=len, reverse=True):
        x = sub(x, r"(?i)\b" + phrase + r"\b")
    return x


def _bare(w: str) -> str:
    return f"lower({sub(w, '[.,!?();:]')})"


def _critical(l: str) -> str:
    return f"regexp_matches({l}, {q('(?i)' + L.CRITICAL_LINE)})"


def without_stop_words(x: str) -> str:
    kept = (
        f"array_to_string(list_filter(string_split_regex(l, '\\s+'), "
        f"lambda w: w <> '' AND NOT list_contains({listed(L.STOP_WORDS)}, {_bare('w')})), ' ')"
    )
    skip = f"regexp_matches({strip('l')}, '^(__PROTECTED_|#|//|/\\*|\\*|\\|)')"
    body = f"CASE WHEN {skip} OR {_critical('l')} THEN l ELSE {kept} END"
    return unlines(f"list_transform({lines(x)}, lambda l: {body})")


def with_synonyms(x: str) -> str:
    for word, put in L.SYNONYMS.items():
        if put:
            x = sub(x, r"(?i)\b" + word + r"\b", put)
    for word, put in L.SYNONYMS.items():
        if not put:
            x = sub(x, r"(?i)\b" + word + r"\b")
    return x


URL = r"https?://\S+"
TRACKING = r"[?&](?:utm_\w+|ref|source|campaign|medium|content|fbclid|gclid)=[^&\s]*"
EMAIL = r"\b[\w.\-]+@[\w.\-]+\.\w+\b"


def with_short_refs(x: str) -> str:
    x = sub(sub(sub(x, URL, "[URL]"), TRACKING), EMAIL, "[EMAIL]")
    x = sub(x, r"[A-Z]:\\(?:[\w.\-]+\\)*([\w.\-]+)\\([\w.\-]+)\\", r".../\1/\2")
    return sub(x, r"(?:/[\w.\-]+)+/([\w.\-]+)/([\w.\-]+)", r".../\1/\2")


def telegraphic(x: str) -> str:
    for pattern, put in sorted(L.VERBOSE_PATTERNS, key=lambda r: len(r[0]), reverse=True):
        x = sub(x, "(?im)" + pattern, put)
    ws = words("l")
    kept = (
        f"array_to_string(list_filter({ws}, lambda v: len(v) <= 1 OR "
        f"NOT list_contains({listed(L.EXTRA_STOP_WORDS)}, {_bare('v')})), ' ')"
    )
    skip = f"({strip('l')} = '' OR regexp_matches({strip('l')}, '^(__PROTECTED_|\\||```)'))"
    body = f"CASE WHEN {skip} OR {_critical('l')} OR len({ws}) <= 8 THEN l ELSE {kept} END"
    x = unlines(f"list_transform({lines(x)}, lambda l: {body})")
    return sub(sub(x, " {2,}", " "), "(?m)^ +| +$")


ITALIC = r"(^|[^*])\*([^*]+)\*($|[^*])"
SEPARATOR = r"^\|?[ \t]*[-:]+[-| :]*$"


def structured(x: str) -> str:
    x = sub(x, r"(?m)^[ \t]*[-*_]{3,}[ \t]*$")
    x = sub(x, r"`([^`\n]+)`", r"\1")
    x = sub(x, r"\[([^\]]+)\]\([^\)]+\)", r"\1")
    x = sub(x, r"\*\*(.+?)\*\*", r"\1")
    x = sub(sub(x, ITALIC, r"\1\2\3"), ITALIC, r"\1\2\3")
    x = sub(x, r"(?m)^#{1,6}\s+(.*\S)[^\S\n]*$", r"\1:")
    x = sub(x, r"(?m)^[ \t]*[-*+][ \t]+")
    return tables_compacted(x)


def tables_compacted(x: str) -> str:
    s = strip("l")
    member = f"((left({s}, 1) = '|' AND right({s}, 1) = '|') OR regexp_matches({s}, {q(SEPARATOR)}))"
    cells = "array_to_string(list_transform(string_split(l, '|'), lambda c: trim(c)), '|')"
    edged = f"regexp_replace('|' || {cells} || '|', '\\|{{2,}}', '|', 'g')"
    only_pipes = f"regexp_matches({cells}, '^\\|+$')"
    row = (
        f"CASE WHEN NOT {member} OR NOT contains(l, '|') THEN l "
        f"WHEN {only_pipes} THEN CASE WHEN len({cells}) = 1 THEN '|' ELSE '||' END ELSE {edged} END"
    )
    kept = f"list_filter({lines(x)}, lambda l: NOT ({member} AND regexp_matches(l, {q(SEPARATOR)})))"
    return unlines(f"list_transform({kept}, lambda l: {row})")


def finalized(x: str) -> str:
    return strip(sub(sub(x, r"[ \t]{2,}", " "), r"\n[ \t]*\n+", "\n"))


def terms(x: str) -> str:
    spaced = sub(sub(x, "([a-z])([A-Z])", r"\1 \2"), "([A-Z]+)([A-Z][a-z])", r"\1 \2")
    return (
        f"list_distinct(list_filter(string_split_regex(lower({spaced}), '[^a-z0-9]+'), "
        "lambda w: len(w) >= 2))"
    )


# ------------------------------------------------- the whole rewrite, staged


def tail_stripped(x: str) -> str:
    return f"regexp_replace({x}, '\\s+$', '')"


def real_code(ls: str) -> str:
    """Verdict on the non-blank lines of a fenced block."""
    having = lambda test: f"len(list_filter({ls}, lambda l: {test}))"
    matches = lambda x, pattern: f"regexp_matches({x}, {q(pattern)})"
    code = (
        f"({matches('l', 'def |class |import |from .+ import |function |const |let |var |return ')} "
        f"OR {matches(strip('l'), '[{};]$')} OR {matches('l', r'^\s*(?:if|for|while|try|except|catch)\b')})"
    )
    return (
        f"CASE WHEN len({ls}) <= 3 OR {having(matches('l', '[├└│─]'))} >= 2 THEN FALSE "
        f"WHEN {having(code)} >= 2 THEN TRUE "
        f"WHEN {having(matches('l', r'^\s*(?:#|[$>]|\w+\s)'))} >= len({ls}) * 0.7 THEN FALSE "
        f"ELSE len({ls}) > 5 END"
    )


FENCE_BODY = tail_stripped("regexp_replace(h, '^[^\\n]*\\n|```$', '', 'g')")
FENCE_HINT = "lower(trim(regexp_extract(h, '^```([^\\n]*)\\n', 1)))"


def block_text() -> str:
    """The text that replaces block h, or NULL where the block is kept."""
    ls = lines(FENCE_BODY)
    commands = unlines(
        f"list_filter(list_transform({ls}, lambda l: {strip('l')}), "
        "lambda l: l <> '' AND (left(l, 1) <> '#' OR left(l, 2) = '#!'))"
    )
    bare = sub(sub(sub("l", "[├└│]"), r"──\s*", " "), r"\s{2,}#\s+.*$")
    tree = unlines(
        f"list_filter(list_transform({ls}, lambda l: {tail_stripped(sub(bare, '^[ \\t]+', ' '))}), "
        "lambda l: trim(l) <> '')"
    )
    fenced = lambda body: f"'```' || {NL} || {body} || {NL} || '```'"
    tree_lines = f"len(list_filter({ls}, lambda l: regexp_matches(l, '[├└│]')))"
    full = f"list_filter({lines(strip(FENCE_BODY))}, lambda l: trim(l) <> '')"
    return (
        f"CASE WHEN NOT contains(h, {NL}) THEN h "
        f"WHEN list_contains({listed(L.CODE_HINTS)}, {FENCE_HINT}) THEN NULL "
        f"WHEN {tree_lines} >= 2 THEN {fenced(tree)} "
        f"WHEN list_contains({listed(L.SHELL_HINTS)}, {FENCE_HINT}) THEN {fenced(commands)} "
        f"WHEN {real_code(full)} THEN NULL "
        f"WHEN {commands} <> {FENCE_BODY} THEN {fenced(commands)} ELSE NULL END"
    )


def protect_ctes(src: str, out: str) -> list[str]:
    """From `src`(..., t) to `out`(..., t, kept): keys in, code blocks out."""
    number = "len(list_filter(d[1:i], lambda x: x IS NULL)) - 1"
    put = f"coalesce(d[i], '__PROTECTED_' || ({number}) || '__')"
    return [
        f"{out}1 AS (SELECT * EXCLUDE (t), {pieces('t', '```(?s:.)*?```')} AS p FROM {src})",
        f"{out}2 AS (SELECT *, list_transform(p.h, lambda h: {block_text()}) AS d FROM {out}1)",
        f"{out} AS (SELECT * EXCLUDE (p, d), list_filter(p.h, lambda h, i: d[i] IS NULL) AS kept, "
        f"{rebuilt('p', put)} AS t FROM {out}2)",
    ]


def dedup_ctes(src: str, out: str, key: str = "doc_id") -> list[str]:
    """From `src`(key, ..., t) to `out`: a walk over the lines, one at a time."""
    s = strip("line")
    return [
        f"{out}ls AS MATERIALIZED (SELECT {key}, unnest({lines('t')}) AS line, generate_subscripts({lines('t')}, 1) AS pos "
        f"FROM {src} WHERE len({lines('t')}) > 5)",
        f"{out}walk AS (SELECT DISTINCT {key}, 0::BIGINT AS pos, ''::VARCHAR AS line, []::VARCHAR[] AS win, "
        f"FALSE AS blank, FALSE AS keep FROM {out}ls UNION ALL "
        f"SELECT w.{key}, l.pos, l.line, "
        f"CASE WHEN {s.replace('line', 'l.line')} = '' OR list_contains(w.win, {s.replace('line', 'l.line')}) THEN w.win "
        f"ELSE list_append(w.win, {s.replace('line', 'l.line')})[-3:] END, "
        f"CASE WHEN {s.replace('line', 'l.line')} = '' THEN TRUE "
        f"WHEN list_contains(w.win, {s.replace('line', 'l.line')}) THEN w.blank ELSE FALSE END, "
        f"CASE WHEN {s.replace('line', 'l.line')} = '' THEN NOT w.blank "
        f"ELSE NOT list_contains(w.win, {s.replace('line', 'l.line')}) END "
        f"FROM {out}walk w JOIN {out}ls l ON l.{key} = w.{key} AND l.pos = w.pos + 1)",
        f"{out}kept AS (SELECT {key}, coalesce(string_agg(line, {NL} ORDER BY pos) FILTER (keep), '') AS kt "
        f"FROM {out}walk WHERE pos > 0 GROUP BY {key})",
        f"{out} AS (SELECT x.* EXCLUDE (t), coalesce(kt, t) AS t FROM {src} x LEFT JOIN {out}kept USING ({key}))",
    ]


def minify_ctes(src: str, out: str, key: str = "doc_id") -> list[str]:
    """From `src`(key, ..., t) to `out`(..., t, n0, n1, kind)."""
    code = sub(sub("replace(t, chr(9), '  ')", r"(?m)[ \t]+$"), r"(\S)[ \t]{2,}", r"\1 ")
    is_code = "starts_with(kind, 'code_')"
    ctes = [
        *redaction_ctes(src, f"{out}r"),
        f"{out}n AS (SELECT *, {tok('t')} AS n0 FROM {out}r)",
        *protect_ctes(f"{out}n", f"{out}p"),
        f"{out}k AS MATERIALIZED (SELECT *, {detect('t')} AS kind FROM {out}p)",
    ]
    last = f"{out}k"
    steps = [
        normalized, without_fillers, without_stop_words, with_synonyms, with_short_refs,
        telegraphic, structured,
    ]
    for i, step in enumerate(steps):
        old = code if i == 0 else "t"
        ctes.append(
            f"{out}s{i} AS MATERIALIZED (SELECT * EXCLUDE (t), CASE WHEN {is_code} THEN {old} ELSE {step('t')} END AS t FROM {last})"
        )
        last = f"{out}s{i}"
    ctes += dedup_ctes(last, f"{out}d", key)
    tidy_code = strip(sub(sub("t", r"(\S) {2,}", r"\1 "), r"\n[ \t]*\n+", "\n"))
    put = "kept[CAST(regexp_extract(h, '[0-9]+') AS INT) + 1]"
    ctes += [
        f"{out}f AS (SELECT * EXCLUDE (t), CASE WHEN {is_code} THEN {tidy_code} ELSE {finalized('t')} END AS t FROM {out}d)",
        f"{out}b AS ({stage(out + 'f', '__PROTECTED_[0-9]+__', put)})",
        f"{out} AS MATERIALIZED (SELECT * EXCLUDE (kept), {tok('t')} AS n1 FROM {out}b)",
    ]
    return ctes


def route_ctes(src: str, out: str, key: str = "doc_id") -> list[str]:
    """From `src`(key, name, t) to `out`(..., t, n0, n1, kind), to understand.

    Code gets its outline and is compressed; data gets its skeleton, which for
    texts that are no JSON is the text; everything else is compressed.
    """
    py = unlines(
        f"list_filter({lines('t')}, lambda l: regexp_matches(l, '^\\s*(?:@\\w|class\\s+\\w|(?:async\\s+)?def\\s+\\w)'))"
    )
    cat = category("rkind")
    return [
        f"{out}t AS MATERIALIZED (SELECT *, {routed_type('t', 'name')} AS rkind, {tok('t')} AS rn0 FROM {src})",
        *redaction_ctes(f"{out}t", f"{out}q"),
        f"{out}c AS MATERIALIZED (SELECT * EXCLUDE (t), {cat} AS cat, "
        f"CASE WHEN ends_with(lower(name), '.py') THEN {py} ELSE t END AS t FROM {out}q)",
        f"{out}x AS (SELECT * FROM {out}c WHERE cat <> 'data')",
        *minify_ctes(f"{out}x", f"{out}m", key),
        f"{out}u AS (SELECT {key}, t FROM {out}m UNION ALL SELECT {key}, t FROM {out}c WHERE cat = 'data')",
        f"{out} AS (SELECT c.* EXCLUDE (t), u.t, {tok('u.t')} AS rn1 FROM {out}c c JOIN {out}u u USING ({key}))",
    ]


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


# ---------------------------------------------------- lifted spans, budgets

INDENTED = r"(?m)(?:^(?:    |\t).+\n?){3,}"
TABLE = r"(?m)(?:^\|.+\|[ \t]*\n)+"
RULE = "(?im)" + T.RULE_LINE
_CODE_LIKE = " + ".join(f"contains(h, {q(s)})::INT" for s in T.CODE_SIGNALS) + " >= 2"
_FREE_RULE = "NOT contains(h, '⟨CODE_BLOCK_') AND NOT contains(h, '⟨RULE_')"


def _lift(src: str, out: str, name: str, pattern: str, mark: str, accept: str, first: str = "0", tail: str = "''"):
    """Accepted hits of `src`.t go to the list `name`, numbered marks in."""
    number = f"({first} + len(list_filter(p.h[1:i], lambda h: {accept})) - 1)"
    before, after = mark.split("%s")
    put = f"CASE WHEN {accept} THEN {q(before)} || {number} || {q(after)} || {tail} ELSE h END"
    return (
        f"{out} AS MATERIALIZED (SELECT * EXCLUDE (p, t), list_filter(p.h, lambda h: {accept}) AS {name}, "
        f"{rebuilt('p', put)} AS t FROM (SELECT *, {pieces('t', pattern)} AS p FROM {src}))"
    )


def lift_ctes(src: str, out: str) -> list[str]:
    """From `src`(..., t) to `out`(..., t, code, tables, refs, rules)."""
    return [
        _lift(src, f"{out}1", "fenced", T.FENCED_BLOCK, T.CODE_PLACEHOLDER, "TRUE"),
        _lift(f"{out}1", f"{out}2", "indented", INDENTED, T.CODE_PLACEHOLDER, _CODE_LIKE, "len(fenced)"),
        f"{out}3 AS (SELECT * EXCLUDE (fenced, indented), list_concat(fenced, indented) AS code FROM {out}2)",
        _lift(f"{out}3", f"{out}4", "tables", TABLE, T.TABLE_PLACEHOLDER, "TRUE", tail=NL),
        _lift(f"{out}4", f"{out}5", "refs", T.INLINE_REF, T.REF_PLACEHOLDER, "TRUE"),
        _lift(f"{out}5", out, "rules", RULE, T.RULE_PLACEHOLDER, _FREE_RULE),
    ]


def put_back_ctes(src: str, out: str) -> list[str]:
    """From `src`(..., t, code, tables, refs, rules) to `out` with the spans in t."""
    ctes, last = [], src
    for i, (name, mark) in enumerate(
        [("rules", T.RULE_PLACEHOLDER), ("refs", T.REF_PLACEHOLDER),
         ("tables", T.TABLE_PLACEHOLDER), ("code", T.CODE_PLACEHOLDER)]
    ):
        span = f"{name}[CAST(regexp_extract(h, '[0-9]+') AS INT) + 1]"
        put = f"coalesce({tail_stripped(span) if name == 'tables' else span}, h)"
        ctes.append(f"{out}{i} AS ({stage(last, mark.replace('%s', '[0-9]+'), put)})")
        last = f"{out}{i}"
    return [*ctes, f"{out} AS MATERIALIZED (SELECT * FROM {last})"]


def lost_lists(raw: str, new: str) -> dict[str, str]:
    """Per kind, the distinct values of `raw` that `new` no longer has."""
    out = {}
    for kind, (pattern, any_case) in T.LOSS_PATTERNS.items():
        rx = ("(?i)" if any_case else "") + pattern
        keep = " AND (len(x) >= 3 OR left(x, 1) <> '0')" if kind == "numbers" else ""
        out[kind] = (
            f"list_filter(list_distinct({hits(raw, rx)}), "
            f"lambda x: NOT list_contains({hits(new, rx)}, x){keep})"
        )
    return out


def warnings(raw: str, new: str) -> str:
    one = [
        f"CASE WHEN len({l}) > 0 THEN '[{k}] lost ' || len({l}) || ': ' || "
        f"array_to_string(list_sort({l})[1:5], ', ') END"
        for k, l in lost_lists(raw, new).items()
    ]
    return f"array_to_string(list_filter([{', '.join(one)}], lambda x: x IS NOT NULL), '; ')"


def cut(x: str, budget: int) -> str:
    n = tok(x)
    at = f"CAST(floor(len({x})::DOUBLE * ({budget}::DOUBLE / {n}::DOUBLE)) AS INT)"
    return f"CASE WHEN {n} <= {budget} THEN {x} ELSE left({x}, {at}) END"


def recent(x: str, budget: int) -> str:
    ls = lines(x)
    words_of_last = f"coalesce(list_sum(list_transform({ls}[len({ls}) - k + 1:], lambda l: len({words('l')}))), 0)"
    fits = f"floor((CASE WHEN k = 0 THEN 0 ELSE {words_of_last} END) * 1.3::DOUBLE) <= {budget}"
    best = f"list_max(list_filter(range(0, len({ls}) + 1), lambda k: {fits}))"
    return f"CASE WHEN {best} = 0 THEN '' ELSE {unlines(f'{ls}[len({ls}) - {best} + 1:]')} END"


def structure(x: str) -> str:
    ls = lines(x)
    head = lambda l: f"left(trim({l}), 1) = '#'"
    kept = f"list_filter({ls}, lambda l, i: trim(l) = '' OR {head('l')} OR (i > 1 AND {head(f'{ls}[i - 1]')}))"
    return f"CASE WHEN len({kept}) = 0 THEN {x} ELSE {unlines(kept)} END"
