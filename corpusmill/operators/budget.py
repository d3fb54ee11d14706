"""Token budgets: per-document cuts and packs of several documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import (
    is_blank, let, percent, shielded, split_lines, strip, text_of, unlines, word_count,
)
from corpusmill.operators.detect import route_type
from corpusmill.operators.redact import redact
from corpusmill.operators.route import question_hits, shown_score, smart_route
from corpusmill.operators.shape import outline_kind, with_skeleton
from corpusmill.session import prepare_checkpoints
from corpusmill.operators.tokens import TOKENS_PER_WORD, count_tokens, cut_to_budget

MIN_SHARE = 200
#: A common bound for the files of one block.
FIRST_FILES = 20


def recent_lines(text: Column, budget: int) -> Column:
    """The longest tail of whole lines that fits the budget.

    Token counts only grow with more lines, so one running sum from the end,
    inside the row, finds the cut.
    """

    def cut(ls: Column) -> Column:
        counts = F.reverse(F.transform(ls, word_count))
        zero = F.struct(
            F.lit(0).cast("bigint").alias("words"), F.lit(0).alias("n"), F.lit(True).alias("open")
        )

        def step(acc: Column, w: Column) -> Column:
            fits = acc["open"] & (
                F.floor((acc["words"] + w) * F.lit(TOKENS_PER_WORD)) <= F.lit(budget)
            )
            return F.struct(
                (acc["words"] + w).alias("words"),
                F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
                fits.alias("open"),
            )

        kept = F.aggregate(counts, zero, step, lambda acc: acc["n"])
        return let(kept, lambda n: unlines(F.slice(ls, F.size(ls) - n + 1, n)))

    return let(split_lines(text_of(text)), lambda ls: F.when(F.size(ls) == 0, F.lit("")).otherwise(cut(ls)))


def structure_lines(text: Column) -> Column:
    """Headings, blank lines and the line after a heading; all if none is kept."""

    def select(ls: Column) -> Column:
        heading = lambda l: strip(l).startswith("#")
        kept = F.filter(
            ls,
            lambda l, i: heading(l)
            | is_blank(l)
            | F.coalesce(heading(F.get(ls, i - 1)), F.lit(False)),
        )
        return let(kept, lambda k: F.when(F.size(k) == 0, F.lit(None)).otherwise(unlines(k)))

    return let(
        text_of(text), lambda t: F.coalesce(let(split_lines(t), select), t)
    )


@shielded("_")
def budget_load(
    df: DataFrame,
    budget: int = 4000,
    priority: str = "auto",
    text: str = "text",
    name: str | None = "name",
) -> DataFrame:
    """Adds each document cut to the budget in the way its type suggests."""
    n = F.col(name) if name else None
    f = F.col
    d = (
        df.withColumn("_red", redact(F.col(text)))
        .withColumn("_n", count_tokens(f("_red")))
        .withColumn("_type", route_type(f("_red"), n))
    )
    auto = (
        F.when(f("_type").startswith("code_"), F.lit("signatures"))
        .when(f("_type").startswith("data_"), F.lit("schema"))
        .when(f("_type") == "log", F.lit("recent"))
        .otherwise(F.lit("structure"))
    )
    d = d.withColumn("_how", auto if priority == "auto" else F.lit(priority))
    over = f("_n") > budget
    wants_shape = over & f("_how").isin("signatures", "schema")
    d = with_skeleton(d, "_red", F.when(wants_shape, outline_kind(f("_type"), n)), "_skel")
    picked = (
        F.when(~over, f("_red"))
        .when(wants_shape, f("_skel"))
        .when(f("_how") == "recent", recent_lines(f("_red"), budget))
        .when(f("_how") == "structure", structure_lines(f("_red")))
        .otherwise(f("_red"))
    )
    d = (
        d.withColumn("_picked", picked)
        .withColumn("_cut", cut_to_budget(f("_picked"), F.lit(budget)))
        .withColumn("_text", F.when(over, f("_cut.text")).otherwise(f("_red")))
        .withColumn("_new", count_tokens(f("_text")))
    )
    return d.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.struct(
            f("_text").alias("text"),
            (~over).alias("is_complete"),
            f("_how").alias("priority_used"),
            f("_n").alias("original_tokens"),
            f("_new").alias("result_tokens"),
            (f("_n") - f("_new")).alias("tokens_saved"),
        ).alias("loaded"),
    )


def settled(scored: DataFrame) -> DataFrame:
    """Narrow scored rows, written once: ranking reads them twice.

    Scoring reads every text; without this it would run for both readings.
    """
    prepare_checkpoints(scored.sparkSession)
    return scored.checkpoint()


def whole_share(budget: int, part: Column, total: Column) -> Column:
    """budget * part / total, rounded down, in integers only."""
    big = F.lit(budget).cast("bigint") * part
    return ((big - F.pmod(big, total)) / total).cast("bigint")


@shielded("_")
def allocate_budget(
    df: DataFrame,
    budget: int,
    group: str,
    order: str,
    weight: str = "weight",
    min_share: int = MIN_SHARE,
) -> DataFrame:
    """The documents of each group that get a share, with `allocated`, `rank`.

    Shares follow the integer weights; shares under `min_share` are dropped. If
    none is left, all get an equal share, or the best one gets everything.

    At most budget / min_share documents per group survive, so the ranking
    window is bounded for any group size; everything before it is one map-side
    combined aggregate per group, joined back (broadcast only if it is small).
    NULL is a group of its own.
    """
    w = F.col(weight).cast("bigint")
    stats = df.groupBy(group).agg(
        F.sum(w).alias("_sum"),
        F.max(w).alias("_max"),
        F.count("*").alias("_docs"),
        F.min(F.struct((-w).alias("w"), F.col(order).alias("o"))).alias("_top"),
    )
    total = F.when(F.col("_sum") == 0, F.lit(1).cast("bigint")).otherwise(F.col("_sum"))
    stats = stats.select(
        F.col(group).alias("_group"),
        total.alias("_total"),
        F.col("_docs"),
        F.col("_top.o").alias("_best"),
        (whole_share(budget, F.col("_max"), total) >= min_share).alias("_shared"),
        whole_share(budget, F.lit(1), F.col("_docs")).alias("_equal"),
    )
    own = whole_share(budget, w, F.col("_total"))
    allocated = (
        F.when(F.col("_shared"), F.when(own >= min_share, own))
        .when(F.col("_equal") >= min_share, F.col("_equal"))
        .when(F.col(order).eqNullSafe(F.col("_best")), F.lit(budget).cast("bigint"))
    )
    ranked = Window.partitionBy(group).orderBy(w.desc(), F.col(order))
    return (
        df.join(stats, F.col(group).eqNullSafe(F.col("_group")))
        .withColumn("allocated", allocated)
        .where(F.col("allocated").isNotNull())
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("group_docs", F.col("_docs"))
        .drop("_group", "_total", "_docs", "_best", "_shared", "_equal")
    )


@shielded("_")
def pack_block(
    df: DataFrame,
    group: str,
    order: str,
    name: str = "name",
    text: str = "text",
    max_files: int | None = None,
) -> DataFrame:
    """One block per group: '--- name ---' and text of its first files, in order.

    All files of a group by default, so its block is as large as the group; max_files
    bounds it, and files_skipped says how many files with text it leaves out. The limit
    is applied per task before the shuffle, on narrow rows. NULL is a group of its own.
    """
    listed = df.where(~is_blank(text_of(text))).select(F.col(group).alias("_g"), F.col(order).alias("_o"))
    first = Window.partitionBy("_g").orderBy("_o")
    chosen = listed.withColumn("_ord", F.row_number().over(first))
    chosen = chosen if max_files is None else chosen.where(F.col("_ord") <= max_files)
    all_files = listed.groupBy("_g").agg(F.count("*").alias("_all"))
    part = F.concat(F.lit("--- "), F.col(name), F.lit(" ---\n"), text_of(text))
    return (
        df.join(chosen, F.col(group).eqNullSafe(F.col("_g")) & F.col(order).eqNullSafe(F.col("_o")))
        .drop("_g", "_o")
        .groupBy(group)
        .agg(
            F.array_sort(F.collect_list(F.struct("_ord", part.alias("part")))).alias("_parts"),
            F.count("*").alias("files"),
        )
        .join(all_files, F.col(group).eqNullSafe(F.col("_g")))
        .select(
            group,
            "files",
            (F.col("_all") - F.col("files")).alias("files_skipped"),
            F.array_join(F.transform("_parts", lambda p: p["part"]), "\n\n").alias("block"),
        )
    )


@shielded("_")
def pack_details(
    df: DataFrame,
    question: str,
    budget: int = 10000,
    group: str = "source",
    key: str = "doc_id",
    text: str = "text",
    name: str = "name",
) -> DataFrame:
    """The chosen documents of each group, compressed and cut to their share.

    Ranking works on narrow rows (group, key, weight, tokens); only the few
    survivors of each group are read again with their text and compressed.
    """
    if budget < MIN_SHARE:
        raise ValueError(f"token budget too small (min: {MIN_SHARE})")
    readable = df.where(~is_blank(text_of(text)))
    scored = (
        readable.select(group, key, redact(F.col(text)).alias("_red"))
        .withColumn("_hits", question_hits(F.col("_red"), F.lit(question)))
        .select(
            group,
            key,
            count_tokens(F.col("_red")).alias("doc_tokens"),
            F.when(F.col("_hits.terms") == 0, F.lit(1).cast("bigint"))
            .otherwise(F.col("_hits.hits"))
            .alias("weight"),
            F.greatest(F.col("_hits.terms"), F.lit(1).cast("bigint")).alias("terms"),
        )
    )
    chosen = allocate_budget(settled(scored), budget, group, key)
    texts = readable.select(key, F.col(name).alias("name"), F.col(text).alias("_text"))
    routed = smart_route(
        texts.join(chosen, key).withColumn("_red", redact(F.col("_text"))), "_red", "name", out="_r"
    )
    return routed.withColumn("_cut", cut_to_budget(F.col("_r.text"), F.col("allocated"))).select(
        group,
        key,
        "name",
        "rank",
        "group_docs",
        F.col("doc_tokens").alias("original_tokens"),
        F.col("allocated").alias("allocated_budget"),
        F.col("_cut.tokens").alias("actual_tokens"),
        shown_score(F.col("weight").cast("double") / F.col("terms").cast("double")).alias("relevance_score"),
        F.col("_r.strategy_used").alias("strategy"),
        (F.col("doc_tokens") <= F.col("allocated")).alias("is_complete"),
        F.col("_cut.text").alias("text"),
    )


def context_pack(
    df: DataFrame,
    question: str,
    budget: int = 10000,
    group: str = "source",
    key: str = "doc_id",
    text: str = "text",
    name: str = "name",
) -> DataFrame:
    """One ready block per group within the token budget, with its totals.

    A block collects at most budget / 200 texts that together fit the budget.
    """
    parts = pack_details(df, question, budget, group, key, text, name)
    part = F.concat(F.lit("--- "), F.col("name"), F.lit(" ---\n"), F.col("text"))
    used, original = F.col("tokens_used"), F.col("total_original_tokens")
    return (
        parts.groupBy(group)
        .agg(
            F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("_parts"),
            F.count("*").alias("files_included"),
            F.max("group_docs").alias("_docs"),
            F.sum("actual_tokens").alias("tokens_used"),
            F.sum("original_tokens").alias("total_original_tokens"),
        )
        .select(
            group,
            F.array_join(F.transform("_parts", lambda p: p["part"]), "\n\n").alias("packed_context"),
            "files_included",
            (F.col("_docs") - F.col("files_included")).alias("files_skipped"),
            "tokens_used",
            "total_original_tokens",
            (original - used).alias("tokens_saved"),
            percent(original - used, original).alias("saved_percent"),
        )
    )
