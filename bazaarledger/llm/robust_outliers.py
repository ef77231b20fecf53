"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Base statistics of every text give two hard rules. The texts that pass them form, per language and source, a cloud of
transformed statistic vectors. Its centre and scatter are minimum-covariance-determinant estimates: from a start by medians and
median absolute deviations, concentration steps take the share ``SUBSET`` of the group with the smallest distances and fit mean and covariance to
it, until no group's determinant changes any more. Texts whose squared Mahalanobis distance lies beyond a chi-square quantile are rejected.

Every step is a join of a table of one row per group to the narrow statistics table and one aggregation, combined map-side; a
group of any size is never brought together. The statistics table is computed once and stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarledger.llm.frames import stored

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words

#: Transformed statistics and the least standard deviation each is credited with: so small that each statistic can reject by itself.
LEAST_SPREAD = {"log_words": 0.25, "log_word_length": 0.04, "root_symbols": 0.03, "root_dup_lines": 0.1, "root_repeats": 0.1}
DIMENSIONS = list(LEAST_SPREAD)
#: Share of a group in the subset. Its consistency factor for five dimensions is 0.75 / P(chi2(7) <= the 0.75 quantile of chi2(5)).
SUBSET, CONSISTENCY = 0.75, 1.41
#: The 0.999 quantile of chi2(5).
CUTOFF = 20.515
#: Steps end when no group's log determinant falls by more than this. It can't fall for ever, as every statistic has a least spread.
CONVERGED = 1e-6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def _covered(sorted_windows: Column) -> Column:
    """Words covered by windows that have an equal, from (hash, position) structs in order."""
    def twin(x: Column, k: Column) -> Column:
        return (x["hash"] == F.get(sorted_windows, k - 1)["hash"]) | (x["hash"] == F.get(sorted_windows, k + 1)["hash"])

    at = F.array_sort(F.transform(F.filter(sorted_windows, lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["at"]))
    return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))


def repeated_words(found: Column) -> Column:
    """Words of the text that lie in a window of WINDOW words met twice or more in it."""
    windows = F.transform(F.sequence(F.lit(1), F.size(found) - (WINDOW - 1)), lambda k: F.xxhash64(F.slice(found, k, WINDOW)))
    in_order = lambda w: F.array_sort(F.transform(w, lambda h, k: F.struct(h.alias("hash"), k.alias("at"))))
    counted = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(in_order(w), _covered)))
    return F.when(F.size(found) > WINDOW, counted).otherwise(F.lit(0)).cast("long")


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. NULL counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.length(F.translate(line, WHITE, "")) > 0)
    measured = let(words(whole), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    out = df.withColumns({
        "measured_words": measured,
        "word_chars": F.length(F.translate(whole, WHITE, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_lines": let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct"))),
    })
    out = out.withColumns({
        "n_words": F.col("measured_words.n_words"), "n_repeat_words": F.col("measured_words.n_repeat_words"),
        "n_dup_lines": (F.col("n_lines.all") - F.col("n_lines.distinct")).cast("long"), "n_lines": F.col("n_lines.all").cast("long"),
    }).drop("measured_words", text)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _vector() -> dict[str, Column]:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "log_words": F.log(n), "log_word_length": F.log(chars / n), "root_symbols": F.sqrt(F.col("n_symbols") / chars),
        "root_dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), "root_repeats": F.sqrt(F.col("n_repeat_words") / n),
    }


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMENSIONS)) for j in range(i + 1)]


def _cholesky(groups: DataFrame) -> DataFrame:
    """From covariances c_i_j the lower factors f_i_j, column by column; log_det is the log of the determinant."""
    for i, j in _pairs():
        rest = F.col(f"c_{i}_{j}") - sum((F.col(f"f_{i}_{k}") * F.col(f"f_{j}_{k}") for k in range(j)), F.lit(0.0))
        least = LEAST_SPREAD[DIMENSIONS[i]] ** 2 / 4  # rounding must not make a pivot vanish
        groups = groups.withColumn(f"f_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(least))) if i == j else rest / F.col(f"f_{j}_{j}"))
    return groups.withColumn("log_det", sum((2 * F.log(f"f_{i}_{i}") for i in range(len(DIMENSIONS))), F.lit(0.0)))


def _estimates() -> list[Column]:
    """Means and covariances of the rows at hand, the spread each dimension is credited with added to its variance."""
    means = [F.avg(d).alias(f"m_{i}") for i, d in enumerate(DIMENSIONS)]
    spread = lambda i, j: LEAST_SPREAD[DIMENSIONS[i]] ** 2 if i == j else 0.0
    return means + [(F.coalesce(F.covar_pop(DIMENSIONS[i], DIMENSIONS[j]), F.lit(0.0)) + spread(i, j)).alias(f"c_{i}_{j}") for i, j in _pairs()]


def _distances(rows: DataFrame, groups: DataFrame, keys: list[str], out: str) -> DataFrame:
    """rows with the squared Mahalanobis distance to their group, by forward substitution."""
    names = [f"m_{i}" for i in range(len(DIMENSIONS))] + [f"f_{i}_{j}" for i, j in _pairs()]
    own = groups.select(*(F.col(k).alias(f"group_{k}") for k in keys), *names)
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"group_{k}"))
        match = same if match is None else match & same
    joined = rows.join(own, match, "left")
    for i, d in enumerate(DIMENSIONS):
        rest = F.col(d) - F.col(f"m_{i}") - sum((F.col(f"f_{i}_{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))
        joined = joined.withColumn(f"y_{i}", rest / F.col(f"f_{i}_{i}"))
    return joined.withColumn(out, sum((F.col(f"y_{i}") ** 2 for i in range(len(DIMENSIONS))), F.lit(0.0))).select(*rows.columns, out)


def group_estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: means m_i and Cholesky factors f_i_j of the minimum-covariance-determinant scatter."""
    middle = rows.groupBy(*keys).agg(*(F.percentile_approx(d, 0.5).alias(f"m_{i}") for i, d in enumerate(DIMENSIONS)))
    match = [F.col(k).eqNullSafe(F.col(f"group_{k}")) for k in keys]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    centred = rows.join(middle.select(*(F.col(k).alias(f"group_{k}") for k in keys), *(f"m_{i}" for i in range(len(DIMENSIONS)))), condition)
    spread = centred.groupBy(*keys).agg(
        *(F.first(f"m_{i}").alias(f"m_{i}") for i in range(len(DIMENSIONS))),
        *(F.percentile_approx(F.abs(F.col(d) - F.col(f"m_{i}")), 0.5).alias(f"s_{i}") for i, d in enumerate(DIMENSIONS)),
    )
    for i, j in _pairs():
        value = (1.4826 * F.col(f"s_{i}")) ** 2 + LEAST_SPREAD[DIMENSIONS[i]] ** 2 if i == j else F.lit(0.0)
        spread = spread.withColumn(f"c_{i}_{j}", value)
    columns = [*keys, *(f"m_{i}" for i in range(len(DIMENSIONS))), *(f"f_{i}_{j}" for i, j in _pairs()), "log_det"]
    groups, started = stored(_cholesky(spread).select(*columns)), False
    while True:
        far = stored(_distances(rows, groups, keys, "distance"))
        limit = far.groupBy(*keys).agg(F.percentile_approx("distance", SUBSET).alias("limit"))
        limit = limit.select(*(F.col(k).alias(f"group_{k}") for k in keys), "limit")
        subset = far.join(limit, condition).where("distance <= limit")
        before = groups.select(*(F.col(k).alias(f"group_{k}") for k in keys), F.col("log_det").alias("before"))
        after = _cholesky(subset.groupBy(*keys).agg(*_estimates())).select(*columns)
        if not started:  # the start is no estimate of a subset yet
            groups, started = stored(after), True
            continue
        # exact quantiles would never raise a determinant; where approximate ones do, the group keeps the estimates it had
        best = groups.unionByName(after).groupBy(*keys).agg(F.min_by(F.struct(*columns), "log_det").alias("best"))
        groups = stored(best.select("best.*"))
        fall = groups.join(before, condition).agg(F.max(F.col("before") - F.col("log_det"))).first()[0]
        if fall is None or fall < CONVERGED:
            return groups


def quality_verdicts(df: DataFrame, text: str = "text", id: str = "doc_id", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per input row: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance).

    ``kept`` is false for texts that fail a hard rule (under 20 words, or over 30 % of the words in repeated windows of eight) or whose
    robust distance is beyond the cut-off; ``distance`` is the squared Mahalanobis distance (NULL where a hard rule failed).
    NULL and empty texts fail. NULL keys form groups of their own; repeated rows count as often as they come; a group without spread, or of one
    row, is judged by the least spreads alone. Extra columns are ignored. An empty table gives an empty table.
    """
    names = [f"key_{k}" for k in range(len(keys))]
    narrow = df.select(F.col(id).alias("row_id"), *(F.col(k).cast("string").alias(n) for k, n in zip(keys, names, strict=True)), F.col(text).alias("body"))
    table = stored(base_statistics(narrow, "body").withColumns(_vector()))
    passed = table.where(~F.col("base_failed"))
    groups = group_estimates(passed.select(*names, *DIMENSIONS), names)
    judged = _distances(table, groups, names, "distance")
    distance = F.when(~F.col("base_failed"), F.col("distance") / CONSISTENCY)
    kept = ~F.col("base_failed") & (distance <= CUTOFF)
    return judged.select(F.col("row_id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), distance.alias("distance"))
