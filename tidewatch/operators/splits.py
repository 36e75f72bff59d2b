"""Walk-forward folds, calibration cut, scaling and class weighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.ranks import attach
from tidewatch.operators.windows import multiplicity

KEY = ["asset", "window_end"]
#: Mean copies of one part of a resampled row; exp of minus this is far from vanishing.
PART_RATE = 500


def fold_role(fold: dict, embargo: int = S.EMBARGO_DAYS) -> Column:
    """train / test / embargoed / NULL for a window under one fold.

    A window trains only if its label resolves before the test period minus the embargo.
    """
    start = F.lit(fold["test_start"]).cast("date")
    in_test = (F.col("window_start") >= start) & (F.col("window_start") <= F.lit(fold["test_end"]).cast("date"))
    candidate = F.col("window_start") <= F.lit(fold["train_end"]).cast("date")
    clear = F.col("label_end") < F.date_sub(start, embargo)
    return (F.when(in_test, "test").when(candidate & clear, "train").when(candidate, "embargoed"))


def walk_forward(meta: DataFrame, folds: list[dict], embargo: int = S.EMBARGO_DAYS) -> DataFrame:
    """Every (window, fold) with its role. Folds are a short literal list, so this is a narrow expansion."""
    roles = F.array(*[F.struct(F.lit(f["fold"]).alias("fold"), fold_role(f, embargo).alias("role")) for f in folds])
    return (meta.withColumn("_f", F.explode(F.filter(roles, lambda r: r["role"].isNotNull())))
            .select(*meta.columns, "_f.fold", "_f.role"))


def usable_folds(roles: DataFrame) -> DataFrame:
    """Counts per fold; a fold lacking train or test rows is skipped."""
    n = {r: F.sum((F.col("role") == r).cast("long")) for r in ("train", "test", "embargoed")}
    return (roles.groupBy("fold").agg(*[c.alias(f"n_{r}") for r, c in n.items()])
            .filter("n_train > 0 AND n_test > 0"))


def split_overlap(roles: DataFrame) -> DataFrame:
    """Per fold: last training label, first test window, whether they are apart, and shared windows."""
    train, test = F.col("role") == "train", F.col("role") == "test"
    shared = (roles.filter("role <> 'embargoed'").groupBy("fold", *KEY)
              .agg(F.max(train.cast("int")).alias("_a"), F.max(test.cast("int")).alias("_b"),
                   F.max(F.when(train, F.col("label_end"))).alias("_l"),
                   F.min(F.when(test, F.col("window_start"))).alias("_s")))
    return shared.groupBy("fold").agg(
        F.max("_l").alias("last_train_label"), F.min("_s").alias("first_test_window"),
        F.sum(F.col("_a") * F.col("_b")).alias("shared"),
        ).withColumn("apart", F.col("last_train_label") < F.col("first_test_window"))


def calibration(roles: DataFrame, embargo: int = S.EMBARGO_DAYS, fraction: float = 0.20,
                min_fit: int = 50) -> DataFrame:
    """Training windows cut in time into ``fit`` and ``calibrate`` (the last fifth) per fold.

    Windows are counted per start date first, so finding the cut date needs a
    running sum over dates, not a ranking of all windows in one task. Ties on the
    cut date are ordered by asset.
    """
    train = roles.filter("role = 'train'")
    per_day = train.groupBy("fold", "window_start").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("fold").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("fold")
    per_day = per_day.withColumns({"run": F.sum("n").over(upto), "total": F.sum("n").over(total)})
    cut = F.floor(F.col("total") * (1.0 - fraction))
    cuts = (per_day.withColumn("cut", cut).filter("cut > 0 AND run > cut AND run - n <= cut")
            .select("fold", F.col("window_start").alias("boundary"), (F.col("cut") - (F.col("run") - F.col("n"))).alias("skip")))
    by_asset = Window.partitionBy("fold", "window_start").orderBy("asset")
    marked = (train.join(cuts, "fold", "left")
              .withColumn("_pos", F.row_number().over(by_asset) - 1)
              .withColumn("_cal", (F.col("window_start") > F.col("boundary"))
                          | ((F.col("window_start") == F.col("boundary")) & (F.col("_pos") >= F.col("skip"))))
              .withColumn("_fit", F.col("label_end") < F.date_sub("boundary", embargo)))
    fits = marked.groupBy("fold").agg(F.sum(F.col("_fit").cast("long")).alias("_n_fit"))
    enough = F.coalesce(F.col("_n_fit") >= min_fit, F.lit(False))
    part = F.when(~enough, "fit").when(F.col("_cal"), "calibrate").when(F.col("_fit"), "fit")
    return (marked.join(fits, "fold").withColumn("part", part)
            .filter(F.col("part").isNotNull()).drop("_pos", "_cal", "_fit", "_n_fit", "skip", "role"))


def deploy_mask(meta: DataFrame, last_test_start: str, embargo: int = S.EMBARGO_DAYS) -> DataFrame:
    """Windows whose label resolves before the last test period minus the embargo."""
    return meta.filter(F.col("label_end") < F.date_sub(F.lit(last_test_start).cast("date"), embargo))


def fit_scaler(marked: DataFrame, folds: list[dict], features: list[str], embargo: int = S.EMBARGO_DAYS) -> DataFrame:
    """Mean and population deviation per (fold, feature) over all rows of all training windows.

    Windows overlap, so each panel row is weighted by the number of training
    windows that contain it instead of being repeated. Sums are taken of what is
    above the feature's mean over the fold's own rows, so neither large levels nor
    other folds' values cancel the spread: a feature constant in a fold has scale 1.
    """
    weighted = marked.withColumns({
        f"_m{i}": multiplicity(marked, fold_role(f, embargo) == "train") for i, f in enumerate(folds)})
    pivots = weighted.agg(F.array(*[F.array(*[F.coalesce(F.avg(F.when(F.col(f"_m{i}") > 0, F.col(f).cast("double"))), F.lit(0.0)) for f in features])
                                    for i in range(len(folds))])).scalar()
    weighted = weighted.withColumn("_pivots", pivots)
    sizes = F.array(*[F.struct(F.lit(f["fold"]).alias("fold"), F.col(f"_m{i}").alias("copies"),
                               (F.col("emit") & (fold_role(f, embargo) == "train")).cast("long").alias("own"), F.col("_pivots")[i].alias("pivots"))
                      for i, f in enumerate(folds)])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    long = (weighted.select(F.explode(F.filter(sizes, lambda s: s["copies"] > 0)).alias("s"), cells.alias("c"))
            .select("s.fold", "s.copies", "s.own", "s.pivots", F.posexplode("c").alias("at", "c"))
            .select("fold", "copies", "own", "c.feature", (F.col("c.x") - F.get("pivots", F.col("at"))).alias("x"), F.get("pivots", F.col("at")).alias("pivot")))
    w, x = F.col("copies"), F.col("x")
    stats = long.groupBy("fold", "feature").agg(
        F.sum("own").alias("n_windows"), F.sum(w).alias("_w"), F.sum(w * x).alias("_s"), F.sum(w * x * x).alias("_q"),
        F.first("pivot").alias("_p"))
    above = F.col("_s") / F.col("_w")
    spread = F.sqrt(F.greatest(F.col("_q") / F.col("_w") - above * above, F.lit(0.0)))
    return stats.select("fold", "feature", "n_windows", (F.col("_p") + above).alias("mean"),
                        F.when(spread > 1e-12, spread).otherwise(F.lit(1.0)).alias("scale"))


def scale_arrays(stats: DataFrame, features: list[str]) -> DataFrame:
    """Means and scales as arrays in feature order, one row per fold."""
    order = F.array(*[F.lit(f) for f in features])
    packed = stats.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale")))).alias("m"))
    return packed.select("fold", F.transform(order, lambda f: F.element_at("m", f)["mean"]).alias("means"),
                         F.transform(order, lambda f: F.element_at("m", f)["scale"]).alias("scales"))


def scale_windows(tensor: DataFrame, arrays: DataFrame) -> DataFrame:
    """(x - mean) / scale on every row of ``feats``; refuses a fold without fitted statistics."""
    def one(row, means, scales):
        return F.zip_with(F.zip_with(row, means, lambda x, m: x - m), scales, lambda d, s: d / s)
    joined = tensor.join(F.broadcast(arrays), "fold", "left").withColumn(      # one row per fold
        "means", F.when(F.col("means").isNotNull(), F.col("means"))
        .otherwise(F.raise_error(F.lit("scaler not fitted for this fold")).cast("array<double>")))
    return (joined.withColumn("feats", F.transform("feats", lambda r: one(r, F.col("means"), F.col("scales"))))
            .drop("means", "scales"))


def class_weights(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Weight n / (2 n_class) per key and class; 1 where a key has one class only."""
    counts = df.groupBy(*keys).agg(F.count(label).alias("_n"), F.sum(label).alias("_p"))
    pos, neg = F.col("_p"), F.col("_n") - F.col("_p")
    alone = (pos == 0) | (neg == 0)
    return counts.select(*keys, F.when(alone, 1.0).otherwise(F.col("_n") / (2.0 * F.nullif(neg, F.lit(0)))).alias("weight_0"),
                         F.when(alone, 1.0).otherwise(F.col("_n") / (2.0 * F.nullif(pos, F.lit(0)))).alias("weight_1"))


def with_class_weight(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    return (attach(df, class_weights(df, keys, label), keys)
            .withColumn("weight", F.when(F.col(label) == 1, F.col("weight_1")).otherwise(F.col("weight_0")))
            .drop("weight_0", "weight_1"))


def weighted_resample(df: DataFrame, keys: list[str], ids: list[str], weight: str = "weight", seed: int = 42) -> DataFrame:
    """Rows drawn with replacement in proportion to their weight, as many as there are rows, in expectation.

    A row's number of copies is Poisson with mean n * weight / total: the limit of
    drawing n times, and independent per row. The uniform behind it is a hash of
    the row's id and the seed, so the draw does not depend on partitioning. A large
    mean is a sum of independent parts of ``PART_RATE`` at most, each with a hash of
    its own, so that no part's first probability vanishes.
    """
    totals = df.groupBy(*keys).agg(F.sum(weight).alias("_t"), F.count(F.lit(1)).alias("_n"))
    parts = F.greatest(F.ceil(F.col("_n") * F.col(weight) / F.col("_t") / PART_RATE), F.lit(1))
    rate = F.col("_n") * F.col(weight) / F.col("_t") / F.col("_parts")
    # inverse CDF: count the steps k whose cumulative probability stays below u
    steps = F.sequence(F.lit(0), F.ceil(F.col("_rate") + 12 * F.sqrt("_rate") + 20).cast("int"))
    def drawn_in(part):
        plain = F.xxhash64(F.lit(seed), *ids)
        mixed = F.when(part == 0, plain).otherwise(F.xxhash64(plain, part))
        u = (F.pmod(mixed, F.lit(2 ** 40)).cast("double") + 0.5) / 2.0 ** 40
        state = F.struct(F.exp(-F.col("_rate")).alias("p"), F.lit(0.0).alias("cum"), F.lit(0).alias("copies"), u.alias("u"))
        def advance(s, k):
            cum = s["cum"] + s["p"]
            return F.struct((s["p"] * F.col("_rate") / (k + 1)).alias("p"), cum.alias("cum"),
                            (s["copies"] + (cum <= s["u"]).cast("int")).alias("copies"), s["u"].alias("u"))
        return F.aggregate(steps, state, advance, lambda s: s["copies"])
    copies = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), F.lit(0), lambda n, part: n + drawn_in(part))
    drawn = attach(df, totals, keys).withColumn("_parts", parts).withColumn("_rate", rate).withColumn("copies", copies)
    return (drawn.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .drop("_t", "_n", "_parts", "_rate", "copies"))


def weighted_log_loss(df: DataFrame, keys: list[str], y: str, p: str, weight: str | None = None,
                      eps: float = 1e-12) -> DataFrame:
    """Mean (weighted) log-loss with clipped probabilities."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1.0 - eps))
    loss = -(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1.0 - q))
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(*keys).agg((F.sum(loss * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("log_loss"))
