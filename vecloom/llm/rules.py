"""Quality rules whose cutoffs come with a guarantee: how many good documents they may reject in each stratum.

The labelled documents are cut in two by a hash of their key.  One half designs: for every stratum and rule it gives a cutoff
at each of a few shares of good documents beyond it, from lenient to strict, and drops rules that find no bad ones.  The other
half is the holdout: going from lenient to strict, the number of good holdout documents any rule rejects is tested against
the allowed share with the exact binomial distribution, and the first level that fails ends the sequence, so the levels need no
correction among themselves; the strata share the error by Bonferroni.  Among the levels that hold, the one that best tells bad
from good in the design half decides.  SQL functions only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions.text import bind
from vecloom.llm.base import in_fold
from vecloom.session import written

SPACES = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
# Shares of good documents beyond a cutoff in the design half, lenient first.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02)
# Each stratum's rules together reject at most this share of good documents, in all strata at once with this confidence.
FALSE_REJECTION = 0.02
ERROR = 0.05
# A rule takes part if its strictest cutoff finds this much more of the bad documents than of the good ones.
GAIN = 0.01

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def statistics(text: Column) -> Column:
    """Counts of a text, as a struct of longs (``STATISTICS``); a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NO_SPACE))

    def of_words(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.length(F.array_join(found, "")).cast("long").alias("word_chars"),
            repeated_words(found).cast("long").alias("n_repeat_words"),
        )

    def of_lines(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines")
        )

    symbols = F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols")
    upper = F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper")
    parts = F.struct(bind(words, of_words).alias("w"), bind(lines, of_lines).alias("l"), symbols, upper)
    return bind(
        parts,
        lambda p: F.struct(
            p["w"]["n_words"], p["w"]["word_chars"], p["n_symbols"], p["l"]["n_dup_lines"], p["w"]["n_repeat_words"], p["l"]["n_lines"], p["n_upper"]
        ).cast("struct<" + ",".join(f"{name}:bigint" for name in STATISTICS) + ">"),
    )


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more.

    Windows are compared by 64-bit hashes.  Only a text that has a hash twice is looked at more closely: hashes are sorted with
    their positions, equal neighbours are marked, and what the marked windows cover is added up from left to right.
    """
    n = F.size(words)

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))

    def marked(sorted_: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(sorted_, i)["hash"] == F.get(sorted_, j)["hash"], F.lit(False))

        twice = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(twice, lambda i: F.get(sorted_, i)["at"]))

    def covered(at: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(at) - 1)
        return F.aggregate(
            steps, F.lit(0), lambda sum_, i: sum_ + F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - F.get(at, i), F.lit(width)))
        )

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bind(bind(pairs, marked), covered))

    return F.when(n < width, 0).otherwise(bind(bind(F.transform(words, lambda w: F.xxhash64(w)), windows), count))


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.floor(1000 * F.try_divide(F.col(part), F.col(whole))), F.lit(0)).cast("int")


def _size(value: Column) -> Column:
    return F.coalesce(F.floor(64 * F.log2(value + 1)), F.lit(0)).cast("int")


def rule_cells() -> dict[str, Column]:
    """The rules: whole numbers, more is worse.  Shares count in thousandths, sizes in 64 steps for each doubling."""
    length = F.try_divide(F.col("word_chars"), F.col("n_words"))
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "upper": _share("n_upper", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "long_words": _size(length),
        "short_words": -_size(length),
        "few_words": -_size(F.col("n_words")),
    }


def measure(docs: DataFrame, *, keep: Sequence[str], text: str = "text", least_words: int = 10, most_repeats: int = 20) -> DataFrame:
    """``keep`` columns, ``STATISTICS``, and ``base_failed``: too few words, or too large a percentage of repeated ones.

    Null and empty texts have no words and fail; repeated rows stay.  A kept column must not be named like a new one.
    """
    clash = set(keep) & {*STATISTICS, "base_failed", "kept", "failed_rules", "_stratum", "_cutoffs"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be lost: rename them")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    found = docs.select(kept, statistics(F.col(f"`{text}`")).alias("counts")).select("kept.*", "counts.*")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X with ``n`` trials: the chance of so few rejections were the true share ``p``.

    Exact up to rounding for k up to the mean; beyond it the chance is near a half or more and 1 is given.  The largest term comes
    from the logarithms of the ratios of neighbouring terms, the sum is taken relative to it.
    """
    odds = p / (1.0 - p)
    start = F.struct((n * F.lit(math.log1p(-p))).alias("log"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        ratio = (n - i + 1) / i * odds
        return F.struct((acc["log"] + F.log(ratio)).alias("log"), (1.0 + acc["sum"] / ratio).alias("sum"))

    # ``sequence(1, 0)`` would count down.
    below = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step, lambda acc: F.exp(acc["log"]) * acc["sum"])
    return F.when(k > p * n, 1.0).when(k == 0, F.exp(start["log"])).otherwise(below)


def fit_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    stratum: str = "lang",
    rules: Mapping[str, Column] | None = None,
    false_rejection: float = FALSE_REJECTION,
    error: float = ERROR,
) -> DataFrame:
    """One row per stratum with a certified level: ``stratum, level, cutoffs`` (rule to the largest cell that passes), ``n_good``,
    ``n_rejected`` (good ones of the holdout) and ``p_value``.

    ``measured``: see ``measure``; ``labels``: ``key, label`` (1 good, 0 bad), one row per key.  Documents that the base rule rejects have no
    say.  A null stratum is a stratum.  Without enough good holdout documents, or without bad ones to find, a stratum has no row and
    its documents pass.  All labelled documents count.  Groups are cut down to histograms before they are shuffled.
    """
    rules = rules or rule_cells()
    cells = [F.coalesce(cell, F.lit(0)).alias(name) for name, cell in rules.items()]
    known = measured.where(F.col(f"`{key}`").isNotNull() & ~F.col("base_failed")).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{stratum}`").alias("stratum"), *cells
    )
    good = F.col("label") == 1
    rows = written(
        known.join(labels.select(F.col(f"`{key}`").alias("key"), "label"), "key")
        .where("label in (0, 1)")
        .select("stratum", good.alias("good"), in_fold(F.col("key"), 2, 1).alias("holdout"), *rules),
        "rules-labelled",
    )
    levels = _design(rows.where("not holdout"), list(rules))
    # What each level would reject, in both halves: one row per stratum and half.
    tried = rows.join(levels, F.col("stratum").eqNullSafe(F.col("of_stratum")))
    beyond = [
        F.exists("levels", lambda r: F.coalesce(F.element_at(F.create_map(*_pairs(rules)), r["rule"]) > r["cuts"][j], F.lit(False))) for j in range(len(LEVELS))
    ]
    counts = tried.groupBy("of_stratum", "holdout").agg(
        F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"),
        F.array(*[F.count_if(F.col("good") & b) for b in beyond]).alias("good_out"),
        F.array(*[F.count_if(~F.col("good") & b) for b in beyond]).alias("bad_out"),
    )
    halves = counts.groupBy("of_stratum").agg(
        *[F.max(F.when(F.col("holdout") == held, F.col(c))).alias(f"{side}_{c}") for held, side in ((True, "h"), (False, "d")) for c in ("n_good", "n_bad", "good_out", "bad_out")]
    )
    halves = written(halves.where("h_n_good > 0"), "rules-counts")
    strata = max(1, halves.count())
    each = halves.select("*", F.posexplode("h_good_out").alias("level", "n_rejected")).withColumn(
        "p_value", binomial_tail(F.col("n_rejected"), F.col("h_n_good"), false_rejection)
    )
    gain = F.try_divide(F.get("d_bad_out", "level"), F.col("d_n_bad")) - F.try_divide(F.get("d_good_out", "level"), F.col("d_n_good"))
    # The counts do not fall from level to level, so neither do the chances: those that hold are the first ones.
    held = each.where(F.col("p_value") <= error / strata).withColumn("gain", gain).where("gain > 0")
    best = held.groupBy("of_stratum").agg(F.max_by(F.struct("level", "h_n_good", "n_rejected", "p_value"), F.struct("gain", -F.col("level"))).alias("b"))
    chosen = best.join(levels.withColumnRenamed("of_stratum", "s"), F.col("of_stratum").eqNullSafe(F.col("s")))
    cutoffs = F.map_from_entries(F.transform("levels", lambda r: F.struct(r["rule"], F.get(r["cuts"], F.col("b.level")))))
    return written(
        chosen.select(
            F.col("of_stratum").alias("stratum"), "b.level", cutoffs.alias("cutoffs"), F.col("b.h_n_good").alias("n_good"), "b.n_rejected", "b.p_value"
        ),
        "rules-cutoffs",
    )


def _pairs(rules: Iterable[str]) -> list[Column]:
    return [x for name in rules for x in (F.lit(name), F.col(f"`{name}`"))]


def _design(rows: DataFrame, rules: Sequence[str]) -> DataFrame:
    """``of_stratum, levels``: for each rule that finds bad documents, its cutoff at each of ``LEVELS``.

    A cutoff is the smallest cell with at most the level's share of good documents beyond it.  Cells are whole numbers of
    bounded range, so the histograms are small and the result does not depend on the order of rows.
    """
    each = rows.select("stratum", "good", F.explode(F.create_map(*_pairs(rules))).alias("rule", "cell"))
    cells = each.groupBy("stratum", "rule", "cell").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    group = W.partitionBy("stratum", "rule")
    above = group.orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, -1)
    beyond = cells.select(
        "stratum", "rule", "cell",
        F.coalesce(F.sum("good").over(above), F.lit(0)).alias("good_beyond"), F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("bad_beyond"),
        F.sum("good").over(group).alias("n_good"), F.sum("bad").over(group).alias("n_bad"),
    )
    passing = [F.when(F.col("good_beyond") <= level * F.col("n_good"), F.col("cell")) for level in LEVELS]
    strictest = F.when(F.col("good_beyond") <= LEVELS[-1] * F.col("n_good"), F.struct(-F.col("cell"), F.col("good_beyond"), F.col("bad_beyond")))
    cuts = beyond.where("n_good > 0 and n_bad > 0").groupBy("stratum", "rule").agg(
        F.array(*[F.min(p) for p in passing]).alias("cuts"), F.max(strictest).alias("at"), F.max("n_good").alias("n_good"), F.max("n_bad").alias("n_bad")
    )
    useful = F.col("at.bad_beyond") / F.col("n_bad") >= F.col("at.good_beyond") / F.col("n_good") + GAIN
    found = cuts.where(useful).groupBy(F.col("stratum").alias("of_stratum"))
    return written(found.agg(F.sort_array(F.collect_list(F.struct("rule", "cuts"))).alias("levels")), "rules-levels")


def apply_cutoffs(measured: DataFrame, cutoffs: DataFrame, *, stratum: str = "lang", rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Add ``failed_rules`` (those of the stratum a document is beyond) and ``kept``: neither they nor the base rule reject it.

    ``cutoffs`` has one row per stratum and is a written table, so Spark knows whether it is small enough to be sent around.
    """
    rules = rules or rule_cells()
    cells = F.create_map(*[x for name, cell in rules.items() for x in (F.lit(name), F.coalesce(cell, F.lit(0)))])
    own = cutoffs.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs"))
    joined = measured.join(own, F.col(f"`{stratum}`").eqNullSafe(F.col("_stratum")), "left")
    failed = F.map_keys(F.map_filter("_cutoffs", lambda rule, cut: F.coalesce(F.element_at(cells, rule) > cut, F.lit(False))))
    failed = F.when(~F.col("base_failed"), F.array_sort(F.coalesce(failed, F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    found = joined.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return found.drop("_stratum", "_cutoffs")
