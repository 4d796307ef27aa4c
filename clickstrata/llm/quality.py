"""Quality rules: base statistics of a text, and robust multivariate outliers per language and source.

Method: each text's statistics are transformed to a vector. For each language and source the minimum-covariance-
determinant estimate is sought: the mean and covariance of those rows, a share ``COVERAGE`` of the group, whose
covariance has the least determinant. Several starts (medians, all rows, spatial signs, the core of the scaled rows,
random subsets) each take ``TRIAL_STEPS`` concentration steps: the rows with the least Mahalanobis distances give the
next mean and covariance. Groups of under ``LEAST_ROWS`` rows, where steps end in many minima, have more random starts. A
group's start with the least determinant goes on until its determinant falls no more; groups that have settled take no
part in the steps of the others. Rows beyond the chi-square ``CUTOFF`` are rejected. DataFrame functions only; each step
is two partially aggregated passes over the narrow statistics. The rows of a core are counted by approximate percentiles
(exact in groups of up to ``ACCURACY`` rows), and a covariance is regularised by ``FLOORS``.

Null texts have no words and fail the base rule. Null languages and sources count as empty strings; null ids are kept. A
group of fewer than ``LEAST_ROWS`` rows that pass the base rule, ten for each dimension, is judged by the estimate over
all rows. Tied distances lie in the core together. Empty tables give no rows. Repeated rows are judged each. A very long
text is one row: its words and their window hashes, some 30 bytes a word, are in one task's memory at once. Other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickstrata.llm.common import BLANKS, let, written

SYMBOLS = "[#*$%&|<>]"
#: Words of a repeated window, fewest words, and the largest share of repeated words in per cent.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Share of rows that shape the estimate, rows below which a group has no estimate of its own, accepted probability.
COVERAGE, LEAST_ROWS, ACCEPTED = 0.6, 60, 0.9999
#: Steps of each start, steps at most, the fall of the determinant's logarithm that ends them, rows that percentiles count exactly.
TRIAL_STEPS, MOST_STEPS, TOLERANCE, ACCURACY = 2, 40, 1e-6, 1000
#: Random starts, rows of each, about, and random starts of a group of under ``LEAST_ROWS`` rows.
RANDOM_STARTS, SUBSET, SMALL_STARTS = 4, 12, 64
#: Groups whose estimates (some 300 bytes each) are broadcast, and salts of the keys beyond that.
BROADCAST_GROUPS, SALTS = 20_000, 64
#: The vector, and the standard deviation that is added to each part: shares are zero in most texts, where a
#: covariance would have no inverse and a single repeated line would be infinitely far.
FLOORS = {"word_length": 0.08, "symbols": 0.04, "dup_lines": 0.2, "repeats": 0.2, "stutter": 0.06, "capitals": 0.05}
VECTOR = tuple(FLOORS)


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")


def _pairs(items: Column, gap: int, join) -> Column:
    """join(items[i], items[i + gap]) for each i that has both."""
    n = F.size(items) - gap
    return F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.slice(items, F.lit(1), F.greatest(n, F.lit(0))), F.slice(items, F.lit(gap + 1), F.greatest(n, F.lit(0))), join))


def window_hashes(words: Column, size: int = WINDOW) -> Column:
    """64-bit hashes of each window of ``size`` (a power of two) words, by doubling."""

    def double(hashes: Column, width: int) -> Column:
        if width == size:
            return hashes
        return let(hashes, lambda h: double(_pairs(h, width, lambda a, b: F.xxhash64(a, b)), 2 * width))

    return double(F.transform(words, lambda w: F.xxhash64(w)), 1)


def repeated_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more: the sorted hashes that have an equal beside them, by position."""

    def covered(places: Column) -> Column:
        n = F.size(places)
        steps = F.zip_with(F.slice(places, F.lit(1), n - 1), F.slice(places, F.lit(2), n - 1), lambda a, b: F.least(b - a, F.lit(size)))
        return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(size), lambda s, x: s + x))

    def twins(ordered: Column) -> Column:
        n = F.size(ordered)
        same = lambda a, b: a["h"] == b["h"]
        ahead = F.zip_with(F.slice(ordered, F.lit(1), n - 1), F.slice(ordered, F.lit(2), n - 1), lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return let(F.sort_array(F.array_distinct(F.flatten(ahead))), covered)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, twins)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, grouping columns, the base statistics, base_failed and the vector of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    of_words = let(
        split_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(window_hashes(w), repeated_words).alias("n_repeat_words"),
            F.size(F.filter(_pairs(w, 1, lambda a, b: (a == b).cast("long")), lambda x: x == 1)).cast("long").alias("n_stutter"),
        ),
    )
    of_lines = let(worded, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    held = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("g_lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("g_source"), of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_capitals"))
    held = written(held, "statistics").select("doc_id", "g_lang", "g_source", "w.*", "l.*", "n_symbols", "n_capitals")
    share = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0)))))
    return held.withColumns(
        {
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
            "word_length": F.coalesce(F.ln(F.try_divide(F.col("word_chars"), F.col("n_words"))), F.lit(0.0)),
            "symbols": share("n_symbols", "word_chars"),
            "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"),
            "stutter": share("n_stutter", "n_words"),
            "capitals": share("n_capitals", "word_chars"),
        }
    )


def chi_square(x: float, k: int) -> float:
    """Probability that a chi-square variable of k degrees is at most x."""
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > total * 1e-15:
        term *= y / (a + n)
        total += term
        n += 1
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a)) if y > 0 else 0.0


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < p else (low, mid)
    return (low + high) / 2


GROUP = ["g_lang", "g_source"]


def _whitening(moments: DataFrame, keys: list[str]) -> DataFrame:
    """From means m_x and covariances c_x_y (y up to x) the rows of the inverse Cholesky factor, i_x_y, and ``log_det``, the
    logarithm of the covariance's determinant."""
    names = VECTOR
    held = moments
    for j, b in enumerate(names):
        held = held.withColumn(f"l_{b}_{b}", F.sqrt(F.col(f"c_{b}_{b}") - sum((F.col(f"l_{b}_{x}") ** 2 for x in names[:j]), F.lit(0.0))))
        held = held.withColumns({f"l_{a}_{b}": (F.col(f"c_{a}_{b}") - sum((F.col(f"l_{a}_{x}") * F.col(f"l_{b}_{x}") for x in names[:j]), F.lit(0.0))) / F.col(f"l_{b}_{b}") for a in names[j + 1 :]})
    for i, a in enumerate(names):
        held = held.withColumn(f"i_{a}_{a}", 1 / F.col(f"l_{a}_{a}"))
        held = held.withColumns({f"i_{a}_{b}": -sum((F.col(f"l_{a}_{x}") * F.col(f"i_{x}_{b}") for x in names[j:i]), F.lit(0.0)) / F.col(f"l_{a}_{a}") for j, b in enumerate(names[:i])})
    log_det = sum((2 * F.ln(F.col(f"l_{a}_{a}")) for a in names), F.lit(0.0))
    return held.select(*keys, *[f"m_{a}" for a in names], *[f"i_{a}_{b}" for i, a in enumerate(names) for b in names[: i + 1]], log_det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance."""
    return sum((sum((F.col(f"i_{a}_{b}") * (F.col(b) - F.col(f"m_{b}")) for b in VECTOR[: i + 1]), F.lit(0.0)) ** 2 for i, a in enumerate(VECTOR)), F.lit(0.0))


def _joined(rows: DataFrame, groups: DataFrame, n_groups: int, how: str = "inner", keys: list[str] = GROUP) -> DataFrame:  # noqa: B006
    """rows with their group's columns: the groups are broadcast while they are few, else dealt to salted keys, so that a
    group of a third of all rows is no task's alone."""
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), keys, how)
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"], how).drop("__salt")


def _covariances(scale: float) -> list[Column]:
    """Aggregates: means, and covariances times ``scale``, regularised."""
    return [*[F.avg(x).alias(f"m_{x}") for x in VECTOR], *[(F.covar_pop(a, b) * scale + F.lit(FLOORS[a] ** 2 if a == b else 0.0)).alias(f"c_{a}_{b}") for i, a in enumerate(VECTOR) for b in VECTOR[: i + 1]]]


def starts(sample: DataFrame, n_groups: int) -> DataFrame:
    """Each group's first estimates: GROUP, start, and what ``_whitening`` gives."""
    middle = written(sample.groupBy(*GROUP).agg(*[F.percentile_approx(x, 0.5, ACCURACY).alias(f"m_{x}") for x in VECTOR], F.count("*").alias("n")), "medians")
    spread = written(_joined(sample, middle, n_groups).groupBy(*GROUP).agg(*[F.first(c).alias(c) for c in middle.columns[2:]], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, ACCURACY).alias(f"d_{x}") for x in VECTOR]), "spreads")
    scale = {x: F.sqrt((F.col(f"d_{x}") * 1.4826) ** 2 + FLOORS[x] ** 2) for x in VECTOR}
    spread = spread.withColumns({f"s_{x}": scale[x] for x in VECTOR})
    norm = sum((((F.col(x) - F.col(f"m_{x}")) / F.col(f"s_{x}")) ** 2 for x in VECTOR), F.lit(0.0))
    scaled = _joined(sample, spread, n_groups).withColumn("norm", norm)
    inner = written(scaled.groupBy(*GROUP).agg(F.percentile_approx("norm", 0.5, ACCURACY).alias("inner")), "norms")
    # at most half of a group: nearly all its rows would be the start "all" once more
    share = F.least(SUBSET / F.col("n"), F.lit(0.5))
    drawn = lambda k: F.pmod(F.xxhash64(k, *VECTOR), F.lit(1 << 30)) < share * (1 << 30)
    chosen = F.array_compact(F.array(F.lit("all"), F.when(F.col("norm") <= F.col("inner"), "core"), *[F.when(drawn(F.lit(k)), f"random {k}") for k in range(RANDOM_STARTS)]))
    further = F.transform(F.filter(F.sequence(F.lit(RANDOM_STARTS), F.lit(SMALL_STARTS - 1)), drawn), lambda k: F.concat(F.lit("random "), k.cast("string")))
    chosen = F.when(F.col("n") < LEAST_ROWS, F.concat(chosen, further)).otherwise(chosen)
    subsets = _joined(scaled, inner, n_groups).select(*GROUP, *VECTOR, F.explode(chosen).alias("start")).groupBy(*GROUP, "start").agg(*_covariances(1.0))
    # the diagonal of the medians' deviations, and the covariance of the scaled rows' directions, in the scale of the rows
    unit = {x: F.coalesce(F.try_divide(F.col(x) - F.col(f"m_{x}"), F.col(f"s_{x}") * F.sqrt("norm")), F.lit(0.0)) for x in VECTOR}
    turned = scaled.groupBy(*GROUP).agg(*[F.first(f"{k}_{x}").alias(f"{k}_{x}") for x in VECTOR for k in "ms"], *[F.avg(unit[a] * unit[b]).alias(f"u_{a}_{b}") for i, a in enumerate(VECTOR) for b in VECTOR[: i + 1]])
    turned = written(turned, "directions")
    pairs = [(a, b) for i, a in enumerate(VECTOR) for b in VECTOR[: i + 1]]
    centre = [*GROUP, *[f"m_{x}" for x in VECTOR]]
    medians = turned.select(*centre, *[(F.col(f"s_{a}") ** 2 if a == b else F.lit(0.0)).alias(f"c_{a}_{b}") for a, b in pairs], F.lit("medians").alias("start"))
    signs = turned.select(*centre, *[(len(VECTOR) * F.col(f"s_{a}") * F.col(f"s_{b}") * F.col(f"u_{a}_{b}") + F.lit(FLOORS[a] ** 2 if a == b else 0.0)).alias(f"c_{a}_{b}") for a, b in pairs], F.lit("signs").alias("start"))
    return written(_whitening(subsets.unionByName(medians).unionByName(signs), [*GROUP, "start"]), "starts")


def concentrated(sample: DataFrame, estimate: DataFrame, n_groups: int, keys: list[str]) -> DataFrame:
    """The next estimate by each of ``keys``: of the rows, a share ``COVERAGE``, with the least distances."""
    p = len(VECTOR)
    consistent = COVERAGE / chi_square(chi_square_quantile(COVERAGE, p), p + 2)
    far = _joined(sample, estimate, n_groups).select(*keys, *VECTOR, _distance().alias("distance"))
    edge = written(far.groupBy(*keys).agg(F.percentile_approx("distance", COVERAGE, ACCURACY).alias("edge")), "edges-of-cores")
    core = _joined(far, edge, n_groups, keys=keys).where("distance <= edge")
    return written(_whitening(core.groupBy(*keys).agg(*_covariances(consistent)), keys), "estimate")


def least_determinant(sample: DataFrame, n_groups: int) -> DataFrame:
    """The estimate (GROUP, m_x, i_x_y, log_det) of each group of sample (GROUP and VECTOR): the best start, to its end."""
    trial = starts(sample, n_groups)
    n_starts = trial.count()
    for _ in range(TRIAL_STEPS):
        trial = concentrated(sample, trial, n_starts, [*GROUP, "start"])
    columns = [c for c in trial.columns if c not in (*GROUP, "start")]
    least = lambda df: df.groupBy(*GROUP).agg(F.min_by(F.struct(*columns), F.struct("log_det", *columns)).alias("e")).select(*GROUP, "e.*")
    best = moving = written(least(trial), "best-start")
    for _ in range(MOST_STEPS):
        # only groups whose determinant still falls: the join leaves the rows of the others out
        after = concentrated(sample, moving, n_groups, GROUP)
        best = written(least(best.unionByName(after)), "best")
        before = moving.select(*GROUP, F.col("log_det").alias("before"))
        moving = written(after.join(before, GROUP).where(F.col("before") - F.col("log_det") > TOLERANCE).select(*after.columns), "moving")
        if moving.isEmpty():
            break
    return best


def judged(stats: DataFrame) -> DataFrame:
    """stats with ``distance`` (squared Mahalanobis, null where no estimate exists) and ``kept``."""
    counts = stats.where(~F.col("base_failed")).groupBy(*GROUP).agg(F.count("*").alias("__n"))
    large = written(counts.where(F.col("__n") >= LEAST_ROWS).select(*GROUP, F.lit(True).alias("__own")), "groups")
    n_groups = large.count() + 1
    own = _joined(stats, large, n_groups, "left").withColumns({k: F.when(F.col("__own"), F.col(k)).otherwise("*") for k in GROUP}).drop("__own")
    table = written(own, "vectors")
    sound = table.where(~F.col("base_failed"))
    # the group "*" stands for all rows
    sample = sound.select(*GROUP, *VECTOR).where("g_lang <> '*'").unionByName(sound.select(F.lit("*").alias("g_lang"), F.lit("*").alias("g_source"), *VECTOR))
    estimate = least_determinant(sample, n_groups)
    cut = chi_square_quantile(ACCEPTED, len(VECTOR))
    return _joined(table, estimate, n_groups, "left").withColumn("distance", _distance()).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut))


def quality(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance of every row."""
    return judged(statistics(docs, **columns)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
