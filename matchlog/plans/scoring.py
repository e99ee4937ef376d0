"""Splits, metrics and error analysis on scored games, as exact SQL-style aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlog.operators import ordered
from matchlog.session import materialize


def split_number(key: Column, seed: int = 1, parts: int = 100) -> Column:
    """A number from 0 to ``parts`` - 1 that depends only on key and seed."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(parts)).cast("int")


def stable_split(games: DataFrame, test_share: int = 20, valid_share: int = 40) -> DataFrame:
    """A nested split: ``test_share`` percent test, then ``valid_share`` percent of the
    rest for validation. It depends on the ids alone, so reruns agree."""
    outer, inner = split_number(F.col("game_id"), 1), split_number(F.col("game_id"), 2)
    return games.withColumn(
        "part",
        F.when(outer < test_share, "test").when(inner < valid_share, "valid").otherwise("train"),
    )


def contiguous_folds(games: DataFrame, folds: int = 5) -> DataFrame:
    """0-based folds of consecutive ids; the first folds take the remainder."""
    ranked = ordered.exact_rank(games, [], [F.col("game_id")], "position", "_games")
    at, n = F.col("position") - 1, F.col("_games")
    size, bigger = F.floor(n / folds), n % folds
    cut = bigger * (size + 1)
    fold = F.when(at < cut, F.floor(at / (size + 1))).otherwise(
        bigger + F.floor((at - cut) / F.greatest(size, F.lit(1)))
    )
    return ranked.withColumn("fold", fold.cast("int")).drop("_games")


def ordered_bits(score: Column) -> Column:
    """A long that orders as the double does: its bit pattern, turned round if negative.

    Both zeros are one value; NaN is above infinity, as in Spark's own order.
    """
    pattern = F.reflect(
        F.lit("java.lang.Double"), F.lit("doubleToLongBits"), score.cast("double") + F.lit(0.0)
    ).cast("bigint")
    return pattern.bitwiseXOR(F.shiftright(pattern, 63).bitwiseAND(F.lit((1 << 63) - 1)))


# A score's 64 bits fall into digits of 22, 21 and 21 bits; (shift, mask) of each.
_DIGITS = ((42, -1), (21, (1 << 21) - 1), (0, (1 << 21) - 1))


def auc(
    scored: DataFrame, score: str = "score", label: str = "label", by: tuple[str, ...] = ()
) -> DataFrame:
    """Exact ROC AUC of any real scores, for each group of ``by`` or over all rows: the
    chance that a positive outscores a negative, ties half.

    Rows are counted per distinct score first. Distinct scores are told apart by the digits
    of their bit pattern: the negatives below a score are those in lower groups at the first
    digit, below it in its group at the second, and at the third. So no group that is put in
    order has more than 2^22 rows, however many scores there are and however close they lie.
    Counts are multiplied as decimals, hence exact. Rows without a score are left out.
    """
    names = [f"_d{i}" for i in range(len(_DIGITS))]
    counted = (
        scored.where(F.col(score).isNotNull())
        .groupBy(*by, (F.col(score).cast("double") + F.lit(0.0)).alias("_s"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
        .select(*by, "pos", "neg", ordered_bits(F.col("_s")).alias("_bits"))
    )
    level = counted.select(
        *by,
        "pos",
        "neg",
        *[
            F.shiftright("_bits", shift).bitwiseAND(F.lit(mask)).alias(n)
            for n, (shift, mask) in zip(names, _DIGITS)
        ],
    ).repartition(*by, *names[:-1])
    wins = []
    for last in reversed(range(len(names))):
        group = Window.partitionBy(*by, *names[:last]).orderBy(names[last])
        lower = F.coalesce(
            F.sum("neg").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        whole = last == len(names) - 1
        twice = 2 * lower + (F.col("neg") if whole else F.lit(0))
        wins.append(
            level.select(
                *by,
                (F.col("pos").cast("decimal(18,0)") * twice.cast("decimal(19,0)")).alias("wins"),
                *[(F.col(c) if whole else F.lit(0).cast("bigint")).alias(c) for c in ("pos", "neg")],
            )
        )
        level = level.groupBy(*by, *names[:last]).agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
        )
    total = reduce(DataFrame.unionByName, wins).groupBy(*by).agg(
        F.sum("wins").alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    pairs = 2 * F.col("pos").cast("double") * F.col("neg").cast("double")
    return total.select(*by, F.try_divide(F.col("wins").cast("double"), pairs).alias("auc"), "pos", "neg")


def running_margins(rows: DataFrame, steps: str = "steps", kept: tuple[str, ...] = ()) -> DataFrame:
    """One row per round with the sum of the row's steps so far, rounds from 1.

    Sums are made inside the row, in one pass over its array.
    """
    sums = F.aggregate(
        steps,
        F.expr("cast(array() as array<double>)"),
        lambda so_far, step: F.concat(
            so_far, F.array(F.coalesce(F.try_element_at(so_far, F.lit(-1)), F.lit(0.0)) + step)
        ),
    )
    return rows.select(*kept, F.posexplode(sums).alias("_at", "margin")).select(
        *kept, (F.col("_at") + 1).alias("round"), "margin"
    )


def fold_curve(rows: DataFrame, steps: str = "steps", label: str = "label") -> DataFrame:
    """AUC of every (fold, round) of rows with a fold, a label and the steps of their margin."""
    return auc(running_margins(rows, steps, ("fold", label)), "margin", label, ("fold", "round"))


def curve_summary(curve: DataFrame) -> DataFrame:
    """Mean and sample deviation of the folds' AUC in each round, with the best round."""
    rounds = curve.groupBy("round").agg(
        F.count("auc").alias("folds"),
        F.avg("auc").alias("mean_auc"),
        F.stddev_samp("auc").alias("std_auc"),
    )
    rounds = rounds.withColumn("mean_auc", F.round("mean_auc", 12))
    best = best_round(rounds, "round", "mean_auc").select("best_round").scalar()
    return rounds.withColumn("is_best", F.col("round") == best)


def accuracy_f1(
    scored: DataFrame, score: str = "score", label: str = "label", cut: float = 0.5
) -> DataFrame:
    """Accuracy and F1 of the scores cut at ``cut``."""
    said = F.col(score) > cut
    truth = F.col(label) == 1
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(said & truth).alias("tp"),
        F.count_if(said & ~truth).alias("fp"),
        F.count_if(~said & truth).alias("fn"),
        F.count_if(~said & ~truth).alias("tn"),
    ).select(
        "n",
        F.try_divide(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def wrong_games(
    scored: DataFrame, score: str = "score", label: str = "label", off: float = 0.5
) -> DataFrame:
    """Games whose score is more than ``off`` away from the result."""
    return scored.where(F.abs(F.col(label) - F.col(score)) > off)


def error_frequency(games: DataFrame, wrong: DataFrame, *by: str) -> DataFrame:
    """Wrong games per group, most frequent first."""
    missed = games.join(wrong.select("game_id"), "game_id", "left_semi")
    return (
        missed.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("wrong"))
        .orderBy(F.desc("wrong"), *[F.asc(b) for b in by])
    )


def histogram(scored: DataFrame, score: str = "score", bins: int = 10) -> DataFrame:
    """Counts in equal bins from the lowest to the highest score, empty bins left out.

    The range is a one-row scalar subquery over the scores, which are kept for it.
    """
    scored = materialize(scored.select(score))
    low = scored.select(F.min(score)).scalar()
    high = scored.select(F.max(score)).scalar()
    width = (high - low) / bins
    at = F.when(width == 0, 0).otherwise(
        F.least(F.floor((F.col(score) - low) / width), F.lit(bins - 1))
    )
    return (
        scored.where(F.col(score).isNotNull())
        .groupBy(at.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def best_round(series: DataFrame, round_: str, metric: str) -> DataFrame:
    """First round with the highest and with the lowest metric."""
    order = F.struct(F.col(metric), -F.col(round_))
    reverse = F.struct(F.col(metric), F.col(round_))
    return series.agg(
        F.max_by(round_, order).alias("best_round"),
        F.max(metric).alias("best_metric"),
        F.min_by(round_, reverse).alias("worst_round"),
        F.min(metric).alias("worst_metric"),
    )
