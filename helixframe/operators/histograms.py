"""Fixed-width histograms in long form (keys, bin, n), their statistics, and evaluation curves.

Bin i of a histogram (least, most, width) is centred on least + i * width: values are clamped to
[least, most] and rounded to the nearest bin.  Statistics use midpoints least + (i + 1/2) * width.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bins:
    least: float
    most: float
    width: float

    @property
    def count(self) -> int:
        return -int(-(self.most - self.least) // self.width) + 1

    def of(self, value) -> Column:
        v = F.greatest(F.least(value.cast("double"), F.lit(float(self.most))), F.lit(float(self.least)))
        return F.round((v - F.lit(float(self.least))) / F.lit(float(self.width))).cast("long")

    def low(self, i: Column) -> Column:
        return F.lit(float(self.least)) + i * F.lit(float(self.width))

    def middle(self, i: Column) -> Column:
        return F.lit(float(self.least)) + (i + 0.5) * F.lit(float(self.width))


def _by(keys) -> tuple:
    return Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)


def build(values: DataFrame, bins: Bins, *keys: str, value: str = "value") -> DataFrame:
    return values.filter(F.col(value).isNotNull()).groupBy(*keys, bins.of(F.col(value)).alias("bin")).agg(F.count("*").alias("n"))


def dense(hist: DataFrame, bins: Bins, *keys: str) -> DataFrame:
    """All bins of each group, zeros included."""
    grid = hist.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins.count - 1)).cast("array<bigint>")))
    return grid.join(hist, [*keys, "bin"], "left").fillna(0, ["n"])


def trim(hist: DataFrame, bins: Bins, *keys: str) -> DataFrame:
    """(keys, n_bins, most): length and upper value after empty bins at the end are dropped."""
    last = F.coalesce(F.max(F.when(F.col("n") > 0, F.col("bin"))), F.lit(0).cast("long"))
    return hist.groupBy(*keys).agg(last.alias("_b")).select(*keys, (F.col("_b") + 1).alias("n_bins"), bins.low(F.col("_b")).alias("most"))


def cdf(hist: DataFrame, *keys: str) -> DataFrame:
    whole, running = _by(keys)
    return hist.withColumn("cdf", F.sum("n").over(running) / F.sum("n").over(whole))


def inverse_cdf(hist: DataFrame, bins: Bins, probabilities: list[float], *keys: str) -> DataFrame:
    """(keys, p, value): value of the first bin whose cumulative share reaches p."""
    steps = cdf(hist, *keys).select(*keys, "bin", "cdf", F.explode(F.array(*[F.lit(p) for p in probabilities])).alias("p"))
    return steps.filter("cdf >= p").groupBy(*keys, "p").agg(F.min("bin").alias("_b")).select(*keys, "p", bins.low(F.col("_b")).alias("value"))


def percentile(hist: DataFrame, bins: Bins, percents: list[float], *keys: str) -> DataFrame:
    """(keys, p, value): linear within the bin where the rank falls; null for p outside 0..100."""
    whole, running = _by(keys)
    d = hist.withColumns({"_c": F.sum("n").over(running), "_t": F.sum("n").over(whole)})
    d = d.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percents]))).withColumn("_r", F.col("p") / 100 * F.col("_t"))
    inside = bins.low(F.col("bin")) + (F.col("_r") - F.col("_c") + F.col("n")) / F.col("n") * bins.width
    value = F.min_by(F.when(F.col("p").between(0, 100), F.when(F.col("n") > 0, inside).otherwise(bins.low(F.col("bin")))), "bin")
    return d.filter((F.col("_c") >= F.col("_r")) | ~F.col("p").between(0, 100)).groupBy(*keys, "p").agg(value.alias("value"))


def stats(hist: DataFrame, bins: Bins, *keys: str) -> DataFrame:
    """Total, mean, deviations (of all and of a sample), mode (last of ties), observed range."""
    mid, n = bins.middle(F.col("bin")), F.col("n")
    d = hist.filter("n > 0").groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum(n * mid).alias("_s"), F.sum(n * mid * mid).alias("_q"),
        F.max_by("bin", F.struct("n", "bin")).alias("_m"), F.min("bin").alias("_lo"), F.max("bin").alias("_hi"),
    )
    around = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.col("total"), F.lit(0.0))
    return d.select(
        *keys, "total", (F.col("_s") / F.col("total")).alias("mean"), F.sqrt(around / F.col("total")).alias("stdev"),
        F.when(F.col("total") > 1, F.sqrt(around / (F.col("total") - 1))).alias("sample_stdev"), bins.middle(F.col("_m")).alias("mode"),
        bins.low(F.col("_lo")).alias("observed_least"), (bins.low(F.col("_hi")) + bins.width).alias("observed_most"),
    )


def threshold_counts(hist: DataFrame, bins: Bins, thresholds: list[float], *keys: str) -> DataFrame:
    """(keys, threshold, n): entries in bins from the threshold's on; below the range all, above none."""
    d = hist.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    at = F.round((F.col("threshold") - bins.least) / bins.width)
    return d.groupBy(*keys, "threshold").agg(F.sum(F.when(F.col("bin") >= at, F.col("n")).otherwise(0)).alias("n"))


def grid_counts(hist: DataFrame, bins: Bins, pool: str = "pool") -> DataFrame:
    """(grid, tp, fp, cross) of histograms of the pools tp, control and cross on one grid."""
    of = lambda *p: F.sum(F.when(F.col(pool).isin(*p), F.col("n")).otherwise(0))
    return hist.filter("n > 0").groupBy(F.round(bins.low(F.col("bin")) / bins.width).cast("long").alias("grid")).agg(of("tp").alias("tp"), of("control", "cross").alias("fp"), of("cross").alias("cross"))


def _swept(grid: DataFrame, positives: int, negatives: int) -> DataFrame:
    """Rates from the highest score down; the grid has as many rows as a histogram has bins."""
    down = Window.orderBy(F.desc("grid")).rowsBetween(Window.unboundedPreceding, 0)
    all_n = F.greatest(F.lit(2 * negatives) + F.sum("cross").over(Window.partitionBy()), F.lit(1)).cast("double")
    d = grid.select("grid", F.sum("tp").over(down).alias("_t"), F.sum("fp").over(down).alias("_f"), all_n.alias("_n"))
    p = float(max(2 * positives, 1))
    return d.select("grid", "_n", (F.col("_f") / F.col("_n")).alias("fpr"), (F.col("_t") / F.lit(p)).alias("tpr"), F.when(F.col("_t") + F.col("_f") > 0, F.col("_t") / (F.col("_t") + F.col("_f"))).otherwise(1.0).alias("precision"))


def curve(grid: DataFrame, positives: int, negatives: int) -> DataFrame:
    """(step, fpr, tpr, precision) from the start (0, 0) to the anchor (1, 1), in order of steps."""
    d = _swept(grid, positives, negatives)
    w = Window.orderBy(F.desc("grid"))
    inner = d.select(F.row_number().over(w).cast("long").alias("step"), "fpr", "tpr", "precision", "_n")
    p = float(max(2 * positives, 1))
    first = d.agg(F.max("_n").alias("_n"), F.max("fpr").alias("f"), F.max("tpr").alias("t"), F.count("*").alias("c"))
    start = first.select(F.lit(0).cast("long").alias("step"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(1.0).alias("precision"))
    end = first.filter("f < 1 OR t < 1").select((F.col("c") + 1).alias("step"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"), (F.lit(p) / (F.lit(p) + F.col("_n"))).alias("precision"))
    return start.unionByName(inner.drop("_n")).unionByName(end)


def areas(points: DataFrame) -> DataFrame:
    """(roc_auc, pr_auc) by trapezoids over a curve."""
    w = Window.orderBy("step")
    d = points.select(*[F.col(c) for c in ("fpr", "tpr", "precision")], *[F.lag(c).over(w).alias(f"_{c}") for c in ("fpr", "tpr", "precision")])
    area = lambda x, y: F.sum((F.col(x) - F.col(f"_{x}")) * (F.col(y) + F.col(f"_{y}")) / 2)
    return d.agg(area("fpr", "tpr").alias("roc_auc"), area("tpr", "precision").alias("pr_auc"))


def confusion(hist: DataFrame, bins: Bins, thresholds: list[float], positives: int, negatives: int, pool: str = "pool") -> DataFrame:
    """Counts and rates at each threshold; precision and predictive value are 1 where undefined."""
    counts = threshold_counts(hist, bins, thresholds, pool)
    of = lambda *p: F.sum(F.when(F.col(pool).isin(*p), F.col("n")).otherwise(0))
    cross = hist.filter(F.col(pool) == "cross").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_x"))  # one row
    d = counts.groupBy("threshold").agg(of("tp").alias("tp"), of("control", "cross").alias("fp")).join(F.broadcast(cross))
    p = F.lit(2 * positives).cast("long")
    d = d.withColumns({"fn": p - F.col("tp"), "tn": F.lit(2 * negatives) + F.col("_x") - F.col("fp")}).drop("_x")
    ratio = lambda a, b, empty=None: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(empty).cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return d.select(
        "threshold", "tp", "fp", "fn", "tn", ratio(tp, tp + fp, 1.0).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr"),
        ratio(tn, fp + tn).alias("specificity"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tn, tn + fn, 1.0).alias("npv"),
        ratio(tp + fn, tp + fp + fn + tn).alias("prevalence"), ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
    )


def even_curve(hist: DataFrame, bins: Bins, positives: int, negatives: int, steps: int = 100, pool: str = "pool") -> DataFrame:
    """(kind, step, x, y): ROC and precision-recall points at even thresholds from the least to the greatest
    value of the bins, anchored at (1, 1) and (0, 0), and at (0, 1) for precision."""
    thresholds = [bins.least + (bins.most - bins.least) * (i / steps) for i in range(steps + 1)]
    d = confusion(hist, bins, thresholds, positives, negatives, pool)
    order = Window.orderBy("threshold")
    points = d.select(F.row_number().over(order).cast("long").alias("step"), F.coalesce("fpr", F.lit(0.0)).alias("fpr"), F.coalesce("recall", F.lit(0.0)).alias("tpr"), "precision")
    ends = points.agg(F.min_by(F.struct("fpr", "tpr"), "step").alias("a"), F.max_by(F.struct("fpr", "tpr"), "step").alias("z"))  # one row
    at = lambda kind, step, x, y: F.struct(F.lit(kind).alias("kind"), F.lit(step).cast("long").alias("step"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    anchors = F.array_compact(F.array(
        F.when((F.col("a.fpr") < 1) | (F.col("a.tpr") < 1), at("roc", 0, 1.0, 1.0)),
        F.when((F.col("z.fpr") > 0) | (F.col("z.tpr") > 0), at("roc", steps + 2, 0.0, 0.0)),
        F.when(F.col("z.tpr") > 0, at("pr", steps + 2, 0.0, 1.0)),
    ))
    inner = points.select(F.lit("roc").alias("kind"), "step", F.col("fpr").alias("x"), F.col("tpr").alias("y")).unionByName(points.select(F.lit("pr").alias("kind"), "step", F.col("tpr").alias("x"), F.col("precision").alias("y")))
    return inner.unionByName(ends.select(F.explode(anchors).alias("p")).select("p.*"))


def even_areas(points: DataFrame) -> DataFrame:
    """(kind, area) by trapezoids over even_curve, whichever way it runs."""
    w = Window.partitionBy("kind").orderBy("step")
    d = points.select("kind", F.abs(F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") + F.lag("y").over(w)).alias("sum"))
    return d.groupBy("kind").agg(F.coalesce(F.sum(F.col("dx") * F.col("sum") / 2), F.lit(0.0)).alias("area"))
