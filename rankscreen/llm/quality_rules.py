"""Quality rules: base statistics of every text, then robust outliers per language and source.

The statistics are computed inside the row by array functions, so a text is never exploded into words. Transformed
statistics are integers (1/4096), their sums are decimals: estimates do not depend on the order of rows.

Minimum covariance determinant: for each (language, source) two deterministic starts (medians with inner-quartile and with
outer-decile scales) are refined by concentration steps: distances from the present estimate, the three quarters of the
rows that lie nearest (by a histogram of log distance, which needs no sort), mean and covariance of those. The start
with the smaller determinant stays; distances are scaled, up or down, so that their median is that of a chi-square. A document
is rejected when its squared Mahalanobis distance passes its group's cut: the upper fence of the log distances (third
quartile plus FENCE times the quartiles' difference), and no less than the 0.999 quantile of the chi-square. Lengths and
repeats have longer tails than a normal, and the fence follows the tail that the group itself shows. FLOORS are the least
deviations that count: most texts repeat no line, and one line more than none is no outlier.

Groups with fewer than MIN_ROWS usable documents are pooled per language, languages with too few are pooled once more;
if even that pool is too small its documents have no verdict of the method and are kept unless the base rules fail.

Defined results: a null or empty text has zero counts and fails the base; null language or source is a group of its own;
repeated rows count each; a constant statistic has the floor variance; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from .common import WORD, let

UNIT = 4096
BINS_PER_OCTAVE = 32
COVERAGE = 0.75
STEPS = 3
MIN_ROWS = 50
#: Quartile differences beyond the third quartile of the log distances.
FENCE = 1.0
#: 0.999 quantile of a chi-square with five degrees of freedom, the least cut.
LEAST_CUT = 20.515
#: Median of a chi-square with five degrees of freedom.
MEDIAN_CHI2 = 4.351
#: Least standard deviation of each transformed statistic.
FLOORS = (0.3, 0.05, 0.3, 0.5, 0.5)
P = len(FLOORS)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more; ``words`` must be a cheap reference.

    Windows are compared by a 64-bit hash of their three words. A word counts once however many windows hold it:
    sorted starts of repeated windows each add the distance to the next start, at most three.
    """
    window = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    again = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    starts = let(F.sort_array(window), lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"])))
    steps = lambda r: F.transform(r, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(r, k + 1) - x, F.lit(3))))
    total = let(starts, lambda r: F.aggregate(steps(r), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(words) >= 3, total).otherwise(0).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               source_col: str = "source") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    from_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    found = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), from_words).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), dup.alias("n_dup_lines"))
    n, again = F.col("w.n_words"), F.col("w.n_repeat_words")
    return found.select("doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                        again.alias("n_repeat_words"), ((n < 50) | (100 * again > 50 * n)).alias("base_failed"))


def transformed() -> list[Column]:
    """Integer units of: log length, log mean word length, log symbol, repeated-line and repeated-word shares."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    raw = [F.log(n), F.log(chars / n), F.log1p(100 * F.col("n_symbols") / chars), F.log1p(100 * F.col("n_dup_lines") / n),
           F.log1p(100 * F.col("n_repeat_words") / n)]
    return [F.round(x * UNIT).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns m* and w* (inverse Cholesky factor, lower triangle)."""
    centred = [F.col(f"x{j}") / UNIT - F.col(f"m{j}") for j in range(P)]
    rows = [sum((F.col(f"w{i}{j}") * centred[j] for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((r * r for r in rows), F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + F.lit(1e-6)) * BINS_PER_OCTAVE)


def _from_moments(moments: DataFrame) -> DataFrame:
    """grp, start, m*, w*, logdet from counts, sums and sums of products: covariance, Cholesky factor and its inverse."""
    n = F.col("n").cast("double")
    out = moments.withColumns({f"m{i}": F.col(f"s{i}").cast("double") / n / UNIT for i in range(P)})
    floor = [F.lit(f * f) if i == j else F.lit(0.0) for i, f in enumerate(FLOORS) for j in range(P)]
    out = out.withColumns({f"c{i}{j}": F.col(f"q{i}{j}").cast("double") / n / UNIT**2 - F.col(f"m{i}") * F.col(f"m{j}") + floor[i * P + j]
                           for i in range(P) for j in range(i + 1)})
    for j in range(P):
        rest = F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))))
        out = out.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)))
                               / F.col(f"l{j}{j}") for i in range(j + 1, P)} or {"_": F.lit(0)})
    for i in range(P):
        for j in range(i + 1):
            s = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"w{i}{j}", 1 / F.col(f"l{i}{i}") if i == j else -s / F.col(f"l{i}{i}"))
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    return out.withColumn("logdet", 2 * logdet).select("grp", "start", *_MODEL)


_MODEL = [f"m{i}" for i in range(P)] + [f"w{i}{j}" for i in range(P) for j in range(i + 1)] + ["logdet"]


def _starts(rows: DataFrame) -> DataFrame:
    """Per group two diagonal estimates, from a histogram of each statistic with bins of 1/128."""
    step = UNIT // 128
    long = rows.select("grp", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") / step) for i in range(P)])).alias("i", "bin"))
    hist = long.groupBy("grp", "i", "bin").agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy("grp", "i").orderBy("bin")
    hist = hist.withColumn("upto", F.sum("c").over(run)).withColumn("all", F.sum("c").over(Window.partitionBy("grp", "i")))
    at = {q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * step / UNIT for q in (0.1, 0.25, 0.5, 0.75, 0.9)}
    wide = hist.groupBy("grp", "i").agg(at[0.5].alias("m"), ((at[0.75] - at[0.25]) / 1.349).alias("a"), ((at[0.9] - at[0.1]) / 2.563).alias("b"))
    wide = wide.withColumn("floor", F.element_at(F.array(*[F.lit(f) for f in FLOORS]), F.col("i") + 1))
    wide = wide.select("grp", "i", "m", F.explode(F.array(F.struct(F.lit(0).alias("start"), F.greatest("a", "floor").alias("s")),
                                                         F.struct(F.lit(1).alias("start"), F.greatest("b", "floor").alias("s")))).alias("e"))
    one = wide.groupBy("grp", F.col("e.start").alias("start"))
    pick = lambda c, i: F.max(F.when(F.col("i") == i, c))
    return one.agg(*[pick(F.col("m"), i).alias(f"m{i}") for i in range(P)],
                   *[(pick(1 / F.col("e.s"), i) if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i in range(P) for j in range(i + 1)],
                   (2 * F.sum(F.log(F.col("e.s")))).alias("logdet"))


def _bins_at(placed: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The first bins by which each share of each grp is reached, a column per share."""
    hist = placed.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("c"))
    one = Window.partitionBy("grp")
    hist = hist.withColumn("upto", F.sum("c").over(one.orderBy("bin"))).withColumn("all", F.sum("c").over(one))
    return hist.groupBy("grp").agg(*[F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))).alias(name) for name, q in shares.items()])


def estimates(rows: DataFrame, fence: float = FENCE) -> DataFrame:
    """The estimate of each group of ``rows`` (grp, x*): centre, inverse factor, the factor of the distances and their cut."""
    model = scratch.table(_starts(rows), "mcd-start")
    for step in range(STEPS):
        # Sums per bin in one pass over the rows; where the nearest rows end is read from the bins, a bounded table.
        placed = rows.join(model, "grp").withColumn("bin", _bin(_distance()))
        exact = lambda c: F.sum(c.cast("decimal(20,0)"))
        binned = placed.groupBy("grp", "start", "bin").agg(
            F.count(F.lit(1)).alias("n"), *[exact(F.col(f"x{i}")).alias(f"s{i}") for i in range(P)],
            *[exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)])
        one = Window.partitionBy("grp", "start")
        before = F.sum("n").over(one.orderBy("bin")) - F.col("n")
        binned = binned.withColumn("inner", before < COVERAGE * F.sum("n").over(one)).filter("inner")
        sums = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i in range(P) for j in range(i + 1)]]
        moments = binned.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in sums])
        model = scratch.table(_from_moments(moments), f"mcd-step{step}")
    best = model.groupBy("grp").agg(F.min_by(F.struct("start", *_MODEL), F.struct("logdet", "start")).alias("b")).select("grp", "b.*")
    placed = rows.join(best, "grp").withColumn("bin", _bin(_distance()))
    quartiles = _bins_at(placed, {"low": 0.25, "middle": 0.5, "high": 0.75})
    of_bin = lambda b: F.pow(F.lit(2.0), (b + 1) / BINS_PER_OCTAVE)
    factor = MEDIAN_CHI2 / of_bin(F.col("middle"))
    last = of_bin(F.col("high") + fence * (F.col("high") - F.col("low")))
    return best.join(quartiles.select("grp", factor.alias("factor"), F.greatest(F.lit(LEAST_CUT), factor * last).alias("cut")), "grp")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source", min_rows: int = MIN_ROWS, fence: float = FENCE) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, cut``."""
    stats = scratch.table(statistics(docs, id_col, text_col, lang_col, source_col).select("*", *transformed()), "quality-stats")
    usable = stats.filter(~F.col("base_failed"))
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("?"))
    fine, lang = F.concat(tag("lang"), F.lit("\u0001"), tag("source")), tag("lang")
    counts = usable.groupBy(fine.alias("fine"), lang.alias("l")).agg(F.count(F.lit(1)).alias("n"))
    pool = F.sum(F.when(F.col("n") < min_rows, F.col("n")).otherwise(0)).over(Window.partitionBy("l"))
    grp = F.when(F.col("n") >= min_rows, F.col("fine")).when(pool >= min_rows, F.concat(F.col("l"), F.lit("\u0001*"))).otherwise("*")
    groups = scratch.table(counts.select("fine", grp.alias("grp")), "quality-groups")
    rows = usable.select("*", fine.alias("fine")).join(groups, "fine")
    enough = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_rows)
    rows = scratch.table(rows.join(enough.select("grp"), "grp", "left_semi").select("grp", *[f"x{i}" for i in range(P)]), "quality-rows")
    model = scratch.table(estimates(rows, fence), "quality-model")
    judged = (stats.withColumn("fine", fine).join(groups, "fine", "left").join(model, "grp", "left")
              .withColumn("distance", _distance() * F.col("factor")))
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= F.col("cut")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         kept.alias("kept"), *[F.when(~F.col("base_failed"), F.col(c)).alias(c) for c in ("distance", "cut")])
