"""What changed between two snapshots of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import let, percent, split_lines, text_of, unfold
from corpusmill.operators.tokens import count_tokens
from corpusmill.session import written

MAX_VERSIONS = 100
CONTEXT = 3
#: Where a line ends, its end being part of it.
LINE_END = r"(?<=[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"
OLD, NEW = 0, 1


def version_id(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def keep_recent_versions(
    stores: DataFrame, ts: str, text: str = "text", n: int = MAX_VERSIONS, key: str | None = None
) -> DataFrame:
    """The n versions stored last (per key, if given); storing again refreshes.

    Only ids and times are ranked: the aggregate combines on the map side and
    the top n is taken per task first.
    """
    keys = [key] if key else []
    latest = (
        stores.select(*keys, version_id(text_of(text)).alias("version_id"), ts)
        .groupBy(*keys, "version_id")
        .agg(F.max(ts).alias("stored_at"), F.count("*").alias("stores"))
    )
    newest = [F.col("stored_at").desc(), F.col("version_id")]
    if not key:
        return latest.orderBy(*newest).limit(n)
    ranked = Window.partitionBy(key).orderBy(*newest)
    return latest.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= n).drop("_r")


def snapshot_pairs(old: DataFrame, new: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, old_text, new_text, old_id, new_id; keys are unique per snapshot.

    One shuffle of each snapshot. Grouping the union keeps the partitioning by
    key, which a full outer join would lose, for the aggregations that follow. A
    NULL text is an empty one; a text or id is NULL where a snapshot lacks the key.
    """
    none = F.lit(None).cast("string")
    both = old.select(key, text_of(text).alias("old_text"), none.alias("new_text")).unionByName(
        new.select(key, none.alias("old_text"), text_of(text).alias("new_text"))
    )
    pairs = both.groupBy(key).agg(
        F.max("old_text").alias("old_text"), F.max("new_text").alias("new_text")
    )
    return pairs.withColumn("old_id", version_id(F.col("old_text"))).withColumn(
        "new_id", version_id(F.col("new_text"))
    )


def as_one(key: str) -> Column:
    """The key as a struct, for joins in which NULL is a key too; they keep its partitioning."""
    return F.struct(F.col(key).alias("key")).alias("_one")


def snapshot_ids(old: DataFrame, new: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, old_id, new_id, full_tokens of the new text: hashes travel, no texts."""
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    own = version_id(text_of(text))
    both = old.select(key, own.alias("old_id"), none.alias("new_id"), nothing.alias("full_tokens")).unionByName(
        new.select(key, none.alias("old_id"), own.alias("new_id"), count_tokens(text_of(text)).alias("full_tokens"))
    )
    return both.groupBy(key).agg(*[F.max(c).alias(c) for c in ("old_id", "new_id", "full_tokens")])


def changed_pairs(
    old: DataFrame, new: DataFrame, key: str, text: str = "text", ids: DataFrame | None = None
) -> DataFrame:
    """snapshot_pairs of the documents that both snapshots hold with other texts.

    They are told by their ids first, which are written once; only the texts of
    those are paired, and travel once: joins and grouping share one partitioning. ids:
    the snapshot_ids, where they are there already. The marks of their lines
    (old_marks, new_marks) are made before the pairing: who takes only those moves
    no text. _one is the key as that partitioning has it.
    """
    ids = written(snapshot_ids(old, new, key, text).select(key, "old_id", "new_id")) if ids is None else ids
    changed = ids.where(F.col("old_id") != F.col("new_id")).select(as_one(key), "old_id", "new_id")

    def of(df: DataFrame, side: str) -> DataFrame:
        own = text_of(text)
        marks, by = line_marks(own).alias(f"{side}_marks"), F.xxhash64(own).alias(f"{side}_by")
        return df.select(as_one(key), own.alias(f"{side}_text"), marks, by)

    both = changed.join(of(old, "old"), "_one").join(of(new, "new"), "_one")
    # Should a key come twice, text and marks are of the same row.
    kept = [F.max_by(f"{p}_{c}", f"{p}_by").alias(f"{p}_{c}") for c in ("text", "marks") for p in ("old", "new")]
    pairs = both.groupBy("_one").agg(*kept, *[F.max(c).alias(c) for c in ("old_id", "new_id")])
    return pairs.select(
        F.col("_one.key").alias(key), "old_text", "new_text", "old_id", "new_id", "_one", "old_marks", "new_marks"
    )


def line_delta(pairs: DataFrame, key: str) -> DataFrame:
    """Lines and tokens added and removed per changed document.

    Multiset difference: each line weighs +1 in the new and -1 in the old text.
    Both aggregations use the partitioning by key that the pairing made, so no
    further shuffle; unchanged documents never unfold.
    """
    weigh = lambda text, sign: F.transform(
        split_lines(text_of(text)), lambda l: F.struct(l.alias("line"), F.lit(sign).alias("w"))
    )
    changed = pairs.where(~F.col("old_id").eqNullSafe(F.col("new_id")))
    both = F.concat(weigh("new_text", 1), weigh("old_text", -1))
    per_line = (
        unfold(changed, [key], both, "x")
        .groupBy(key, F.col("x.line").alias("line"))
        .agg(F.sum("x.w").alias("w"))
        .where(F.col("w") != 0)
    )
    sign = F.when(F.col("w") > 0, F.lit("+")).otherwise(F.lit("-"))
    marked = F.size(
        F.filter(F.split(F.concat(sign, F.col("line")), r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")
    ).cast("bigint")
    return per_line.groupBy(key).agg(
        F.sum(F.greatest("w", F.lit(0))).alias("lines_added"),
        F.sum(F.greatest(-F.col("w"), F.lit(0))).alias("lines_removed"),
        F.floor(F.sum(marked * F.abs("w")) * F.lit(1.3)).cast("bigint").alias("delta_tokens"),
    )


def change_type(added: Column, removed: Column) -> Column:
    return (
        F.when((added > 0) & (removed > 0), F.lit("modified"))
        .when(added > 0, F.lit("added"))
        .when(removed > 0, F.lit("removed"))
        .otherwise(F.lit("unchanged"))
    )


def delta_mode(old: DataFrame, new: DataFrame, key: str, text: str = "text") -> DataFrame:
    """How to hand over each new document: full, unchanged or delta.

    The delta is worth it only if it costs fewer tokens than the full text.
    """
    ids = written(snapshot_ids(old, new, key, text))
    delta = line_delta(changed_pairs(old, new, key, text, ids), key).withColumnRenamed(key, "_key")
    f = F.col
    zero = F.lit(0).cast("bigint")
    d = (
        ids.where(f("new_id").isNotNull())
        .join(delta, f(key).eqNullSafe(f("_key")), "left")
        .drop("_key")
        .withColumn("added", F.coalesce("lines_added", zero))
        .withColumn("removed", F.coalesce("lines_removed", zero))
        .withColumn("_d", F.coalesce("delta_tokens", zero))
    )
    mode = (
        F.when(f("old_id").isNull(), F.lit("full"))
        .when((f("added") == 0) & (f("removed") == 0), F.lit("unchanged"))
        .when(f("_d") >= f("full_tokens"), F.lit("full"))
        .otherwise(F.lit("delta"))
    )
    d = d.withColumn("mode", mode)
    sent = F.when(f("mode") == "full", f("full_tokens")).otherwise(f("_d"))
    saved = f("full_tokens") - sent
    return d.select(
        key,
        "mode",
        F.when(f("old_id").isNull(), F.lit("full"))
        .otherwise(change_type(f("added"), f("removed")))
        .alias("change_type"),
        f("new_id").alias("version_id"),
        f("added").alias("lines_added"),
        f("removed").alias("lines_removed"),
        sent.alias("sent_tokens"),
        "full_tokens",
        saved.alias("tokens_saved"),
        F.when(f("mode") == "unchanged", F.lit(100.0))
        .otherwise(percent(saved, f("full_tokens")))
        .alias("saved_percent"),
    )


def full_lines(text: Column) -> Column:
    """The lines of a text with their ends."""
    return F.filter(F.split(text_of(text), LINE_END, -1), lambda l: l != "")


def heaviest_chain(blocks: Column) -> Column:
    """Of blocks (i, j, n) in order of i, those of the heaviest chain that rises in j."""
    state = "array<struct<i:int,j:int,n:int,best:int,prev:int>>"

    def step(acc: Column, b: Column) -> Column:
        below = F.filter(
            F.transform(acc, lambda a, k: F.struct(a["best"].alias("best"), (-k).alias("k"), a["j"].alias("j"))),
            lambda a: a["j"] < b["j"],
        )

        def entry(top: Column) -> Column:
            best = (F.coalesce(top["best"], F.lit(0)) + b["n"]).alias("best")
            prev = F.coalesce(-top["k"], F.lit(-1)).alias("prev")
            own = F.struct(b["i"].alias("i"), b["j"].alias("j"), b["n"].alias("n"), best, prev)
            return F.concat(acc, F.array(own))

        return let(F.array_max(below), entry)

    def back(table: Column) -> Column:
        best = F.array_max(F.transform(table, lambda a, k: F.struct(a["best"].alias("best"), (-k).alias("k"))))
        start = F.struct((-best["k"]).alias("at"), F.array().cast("array<int>").alias("kept"))

        def follow(acc: Column, k: Column) -> Column:
            on = F.struct(F.get(table, k)["prev"].alias("at"), F.concat(acc["kept"], F.array(k)).alias("kept"))
            return F.when(acc["at"] == k, on).otherwise(acc)

        down = F.sequence(F.size(table) - 1, F.lit(0), F.lit(-1))
        kept = F.aggregate(down, start, follow, lambda acc: acc["kept"])
        return F.transform(kept, lambda k: F.get(blocks, k))

    return let(F.aggregate(blocks, F.array().cast(state), step), back)


def _chosen(cand: DataFrame, key: str) -> DataFrame:
    """key, i, j of the candidates (key, gap, i, j) that keep the order of lines.

    Neighbours in both texts are one block. A block that crosses no other is kept;
    only the others, between two such, are weighed against each other.
    """
    at = Window.partitionBy(key, "gap").orderBy("i")
    runs_on = (F.col("i") == F.lag("i").over(at) + 1) & (F.col("j") == F.lag("j").over(at) + 1)
    starts = (~F.coalesce(runs_on, F.lit(False))).cast("int")
    runs = cand.withColumn("run", F.sum(starts).over(at))
    blocks = runs.groupBy(key, "gap", "run").agg(
        F.min("i").alias("i"), F.min("j").alias("j"), F.count("*").cast("int").alias("n")
    )
    before = F.max("j").over(at.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("j").over(at.rowsBetween(1, Window.unboundedFollowing))
    free = F.coalesce(before < F.col("j"), F.lit(True)) & F.coalesce(after > F.col("j"), F.lit(True))
    blocks = blocks.withColumn("free", free)
    blocks = blocks.withColumn("part", F.sum(F.col("free").cast("int")).over(at))
    one = F.struct("i", "j", "n")
    parts = blocks.groupBy(key, "gap", "part").agg(
        F.collect_list(F.when(F.col("free"), one)).alias("alone"),
        F.sort_array(F.collect_list(F.when(~F.col("free"), one))).alias("all"),
    )
    chain = F.when(F.size("all") > 1, heaviest_chain(F.col("all"))).otherwise(F.col("all"))
    kept = unfold(parts, [key], F.concat("alone", chain), "b")
    step = F.explode(F.expr("sequence(0, b.n - 1)")).alias("k")
    return kept.select(key, "b", step).select(key, F.expr("b.i + k").alias("i"), F.expr("b.j + k").alias("j"))


def line_mark(line: Column) -> Column:
    """A line as at most 16 bytes: short lines as they are, others by their MD5."""
    return F.when(F.octet_length(line) < 16, line.cast("binary")).otherwise(F.unhex(F.md5(line)))


def line_marks(text: Column) -> Column:
    return F.transform(full_lines(text), line_mark)


def matches_of(found: DataFrame) -> DataFrame:
    """_one and _of, the matches of a document in order."""
    return found.groupBy("_one").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("_of"))


def told(of: Column, own: str, other: str) -> Column:
    """By place up to the last match: struct(mate, gap), gap being the number of matches up to it."""

    def upto(m: Column, k: Column) -> Column:
        lone = F.struct(F.lit(None).cast("int").alias("mate"), k.alias("gap"))
        before = F.coalesce(F.get(of, k - 1)[own], F.lit(-1))
        mated = F.struct(m[other].alias("mate"), (k + 1).alias("gap"))
        return F.concat(F.array_repeat(lone, m[own] - before - 1), F.array(mated))

    return F.flatten(F.transform(of, upto))


def placed_items(content: str, old: Column, new: Column) -> Column:
    """side, pos, content, mate and gap of every item of the arrays old and new, by the matches _of."""
    known = F.coalesce("_of", F.array().cast("array<struct<i:int,j:int>>"))

    def side(items: Column, which: int, of: Column, own: str, other: str) -> Column:
        def row(told: Column, x: Column, pos: Column) -> Column:
            at = F.get(told, pos)
            gap = F.coalesce(at["gap"], F.size(of)).cast("bigint")
            return F.struct(
                F.lit(which).alias("side"), pos.alias("pos"), x.alias(content), at["mate"].alias("mate"), gap.alias("gap")
            )

        return let(told(of, own, other), lambda t: F.transform(items, lambda x, pos: row(t, x, pos)))

    rows = lambda of: F.concat(side(old, OLD, of, "i", "j"), side(new, NEW, of, "j", "i"))
    return let(known, rows)


def matches(pairs: DataFrame) -> DataFrame:
    """_one, i, j: which line of the old text is which line of the new one.

    pairs: _one, old_marks and new_marks, partitioned by _one. A patience diff. Lines that
    both texts hold exactly once are matched first, as far as they keep their order; then,
    pass by pass, lines within the gaps between matches, the k-th occurrence with the k-th,
    until no gap has a line in common. gap tells the match before a line. Only marks of 16
    bytes travel: the first matches meet them once, in the row of a document, and later
    passes move those alone that have no match in gaps of both texts. A pass shuffles by
    document and its rows outlive it in the checkpoint folder.
    """
    marks = pairs.select("_one", "old_marks", "new_marks")
    side = lambda name, which: F.transform(
        F.col(name), lambda m, pos: F.struct(F.lit(which).alias("side"), pos.alias("pos"), m.alias("mark"))
    )
    lines = unfold(marks, ["_one"], F.concat(side("old_marks", OLD), side("new_marks", NEW)), "x")
    place = lambda which: F.max(F.when(F.col("side") == which, F.col("pos")))
    times = lambda which: F.count_if(F.col("side") == which)
    nth = F.row_number().over(Window.partitionBy("_one", "gap", "side", "mark").orderBy("pos"))
    order = Window.partitionBy("_one", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = Window.partitionBy("_one", "gap")
    two = F.min("side").over(within) < F.max("side").over(within)
    none = F.lit(None)

    def chosen_in(rows: DataFrame, label: Column) -> DataFrame:
        cand = rows.withColumn("label", label).groupBy("_one", "gap", "mark", "label")
        cand = cand.agg(place(OLD).alias("i"), place(NEW).alias("j"), times(OLD).alias("olds"), times(NEW).alias("news"))
        return _chosen(cand.where("olds = 1 AND news = 1").select("_one", "gap", "i", "j"), "_one")

    def still_open(rows: DataFrame) -> DataFrame:
        return written(rows.withColumn("two", two).where("two").select("_one", "gap", "side", "pos", "mark"))

    # One job: the marks of a document stay where they are, for its first matches to meet them.
    first = chosen_in(lines.select("_one", F.lit(-1).alias("gap"), "x.*"), F.lit(0))
    met = marks.join(matches_of(first), "_one", "left")
    rest = F.filter(placed_items("mark", F.col("old_marks"), F.col("new_marks")), lambda x: x["mate"].isNull())
    first = written(met.select("_one", "_of", rest.alias("_rest")))
    out = unfold(first, ["_one"], F.col("_of"), "x").select("_one", "x.*")
    open_ = still_open(unfold(first, ["_one"], F.col("_rest"), "x").select("_one", "x.*").repartition("_one"))
    # Gaps are numbers of matches at first; where one splits, its parts follow the old places.
    open_ = open_.withColumn("gap", F.struct("gap", F.lit(-1).alias("at")))
    while not open_.isEmpty():
        open_ = open_.repartition("_one")
        found = written(chosen_in(open_, nth))
        if found.isEmpty():
            break
        out = out.unionByName(found)
        ends = F.array(*[
            F.struct(F.lit(x).alias("side"), F.col(own).alias("pos"), F.col("i").alias("at")) for x, own in ((OLD, "i"), (NEW, "j"))
        ])
        ends = found.select("_one", F.explode(ends).alias("x")).select(
            "_one", none.cast(open_.schema["gap"].dataType).alias("gap"), "x.side", "x.pos", none.cast("binary").alias("mark"), "x.at"
        )
        rows = open_.withColumn("at", none.cast("int")).unionByName(ends).repartition("_one")
        rows = rows.groupBy("_one", "side", "pos").agg(*[F.max(c).alias(c) for c in ("gap", "mark", "at")])
        rows = rows.withColumn("last", F.max("at").over(order)).where("at IS NULL")
        last = F.greatest(F.col("gap.at"), F.col("last"))
        open_ = still_open(rows.withColumn("gap", F.struct(F.col("gap.gap").alias("gap"), last.alias("at"))))
    return out


def matched_lines(pairs: DataFrame, key: str) -> DataFrame:
    """Every line of both texts: key, side, pos, line, mate, gap, and the key as a struct.

    mate is the place in the other text, gap the number of matches up to the line. The
    matches of a document meet its two texts in one join; its rows stay where they meet.
    Of changed_pairs, whose marks are there without them, texts are paired only for it.
    """
    if "_one" not in pairs.columns:
        own = [line_marks(F.col(f"{p}_text")).alias(f"{p}_marks") for p in ("old", "new")]
        pairs = written(pairs).select("*", as_one(key), *own).repartition("_one")
    both = pairs.select(key, "_one", "old_text", "new_text").join(matches_of(matches(pairs)), "_one", "left")
    lines = placed_items("line", full_lines(F.col("old_text")), full_lines(F.col("new_text")))
    return unfold(both, [key, "_one"], lines, "x").select(key, "_one", "x.*")


def ordered_delta(pairs: DataFrame, key: str) -> DataFrame:
    """The lines of every changed document in order: key, seq, op, old_pos, new_pos, moved, line.

    op is ' ', '-' or '+', positions count from 1. A line that goes in one place and
    comes in another of the same document is moved: so are as many removals of a line
    as there are additions of it. Only documents in both snapshots are compared; a
    text that lost or gained all its lines is all removals or additions.
    """
    changed = pairs.where(F.expr("old_id IS NOT NULL AND new_id IS NOT NULL AND old_id <> new_id"))
    paired = ["_one", "old_marks", "new_marks"] if "_one" in pairs.columns else []
    rows = matched_lines(changed.select(key, "old_text", "new_text", *paired), key)
    lone = F.col("mate").isNull()
    rows = rows.where(lone | (F.col("side") == NEW)).withColumn("_lone", F.when(lone, line_mark(F.col("line"))))
    per_line = Window.partitionBy("_one", "_lone")
    nth = F.row_number().over(Window.partitionBy("_one", "_lone", "side").orderBy("pos"))
    both = F.least(*[F.sum((F.col("side") == x).cast("int")).over(per_line) for x in (OLD, NEW)])
    op = F.when(~lone, F.lit(" ")).when(F.col("side") == OLD, F.lit("-")).otherwise(F.lit("+"))
    rows = rows.withColumn("moved", lone & (nth <= both)).withColumn("op", op)
    turn = F.when(F.col("op") == " ", 0).when(F.col("op") == "-", 1).otherwise(2)
    seq = F.row_number().over(Window.partitionBy("_one").orderBy("gap", turn, "pos"))
    old = F.when(F.col("op") == " ", F.col("mate")).when(F.col("op") == "-", F.col("pos"))
    new = F.when(F.col("op") != "-", F.col("pos"))
    return rows.select(
        key, seq.alias("seq"), "op", (old + 1).alias("old_pos"), (new + 1).alias("new_pos"), "moved", "line"
    )


def delta_hunks(delta: DataFrame, key: str, context: int = CONTEXT) -> DataFrame:
    """Changes of an ordered delta with their context: key, hunk, the four numbers, moved, text.

    Changes at most 2 x context lines apart are one hunk. The text is that of a
    unified diff. moved counts the lines that only changed their place.
    """
    at = Window.partitionBy(key).orderBy("seq")
    upto, since = at.rowsBetween(Window.unboundedPreceding, 0), at.rowsBetween(0, Window.unboundedFollowing)
    change = F.when(F.col("op") != " ", F.col("seq"))
    near = delta.withColumns(
        {
            "last": F.max(change).over(upto),
            "next": F.min(change).over(since),
            "olds": F.sum((F.col("op") != "+").cast("int")).over(upto),
            "news": F.sum((F.col("op") != "-").cast("int")).over(upto),
        }
    )
    near = near.where((F.col("seq") - F.col("last") <= context) | (F.col("next") - F.col("seq") <= context))
    apart = F.coalesce(F.col("seq") - F.lag("seq").over(at) > 1, F.lit(True)).cast("int")
    near = near.withColumn("apart", apart).withColumn("hunk", F.sum("apart").over(upto).cast("int"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "op", "line"))), lambda x: F.concat(x["op"], x["line"])), "")
    count = lambda other: F.count_if(F.col("op") != other)
    hunks = near.groupBy(key, "hunk").agg(
        # Lines before the hunk: those up to its first line, less that one.
        F.min(F.col("olds") - (F.col("op") != "+").cast("int")).alias("old_before"),
        F.min(F.col("news") - (F.col("op") != "-").cast("int")).alias("new_before"),
        count("+").cast("int").alias("old_lines"),
        count("-").cast("int").alias("new_lines"),
        F.count_if("moved").alias("moved"),
        text.alias("body"),
    )

    def span(before: str, lines: str) -> Column:
        start = F.when(F.col(lines) > 0, F.col(before) + 1).otherwise(F.col(before)).cast("string")
        return F.when(F.col(lines) == 1, start).otherwise(F.concat_ws(",", start, F.col(lines).cast("string")))

    head = F.concat(F.lit("@@ -"), span("old_before", "old_lines"), F.lit(" +"), span("new_before", "new_lines"), F.lit(" @@\n"))
    numbers = ["old_before", "old_lines", "new_before", "new_lines", "moved"]
    return hunks.select(key, "hunk", *numbers, F.concat(head, "body").alias("text"))


def delta_text(pairs: DataFrame, key: str, context: int = CONTEXT) -> DataFrame:
    """The unified diff of every changed document, made from its hunks: key, changes."""
    hunks = delta_hunks(ordered_delta(pairs, key), key, context)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("hunk", "text"))), lambda x: x["text"])
    whole = F.concat(F.lit("--- \n+++ \n"), F.array_join(in_order, ""))
    return hunks.groupBy(key).agg(whole.alias("changes"))


def changed_docs(old: DataFrame, new: DataFrame, key: str, text: str = "text") -> DataFrame:
    """new, gone, changed or same per document; joins ids, never texts.

    A NULL text is an empty one.
    """
    side = lambda df, p: df.select(key, version_id(text_of(text)).alias(f"{p}_id"))
    joined = side(old, "old").join(side(new, "new"), key, "full_outer")
    status = (
        F.when(F.col("old_id").isNull(), F.lit("new"))
        .when(F.col("new_id").isNull(), F.lit("gone"))
        .when(F.col("old_id") == F.col("new_id"), F.lit("same"))
        .otherwise(F.lit("changed"))
    )
    return joined.select(key, "old_id", "new_id", status.alias("status"))
