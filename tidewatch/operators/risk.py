"""Evidence components, their combination and the decision, set-wise over (asset, date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.canon import fixed, percent
from tidewatch.functions.frames import clip, expanding, ordered, trailing
from tidewatch.functions.ranks import expanding_rank
from tidewatch.operators.panel import unpivot

POINT = ["asset", "date"]
ELEVATED, EXTREME, CALM = 0.80, 0.95, 0.20
DISAGREEMENT = 0.20
MAX_PENALTY = 0.60
MIN_CONFIDENCE = 0.25
EVIDENCE = "array<struct<name:string,value:double,direction:int,weight:double,detail:string>>"


def percentiles(panel: DataFrame, features: list[str]) -> DataFrame:
    """As-of percentile of every value in its own history: (asset, date, feature, value, percentile, ...)."""
    ranked = expanding_rank(unpivot(panel, features), ["asset", "feature"], "date", "value")
    return ranked.withColumn("percentile", F.col("rank_le") / F.col("rank_n"))


def percentiles_at(panel: DataFrame, features: list[str], points: DataFrame) -> DataFrame:
    """The same for the rows at a few ``points (asset, date)`` only: each is compared with its own asset's history by one
    pass of counts over all features. Work is points times days of an asset; for every row use :func:`percentiles`."""
    now = panel.join(points.select(*POINT).distinct(), POINT).select(*POINT, *[F.col(f).cast("double").alias(f"_now_{f}") for f in features])
    past = panel.select("asset", F.col("date").alias("_then"), *[F.col(f).cast("double").alias(f) for f in features])
    pairs = past.join(now, "asset").filter("_then <= date")
    counts = [F.struct(F.lit(f).alias("feature"), F.max(f"_now_{f}").alias("value"),
                       F.sum((F.col(f) <= F.col(f"_now_{f}")).cast("long")).alias("rank_le"),
                       F.sum((F.col(f) < F.col(f"_now_{f}")).cast("long")).alias("rank_lt"), F.count(f).alias("rank_n")) for f in features]
    rows = pairs.groupBy(*POINT).agg(F.array(*counts).alias("_all")).select(*POINT, F.explode("_all").alias("_f")).select(*POINT, "_f.*")
    return rows.filter(F.col("value").isNotNull()).withColumn("percentile", F.col("rank_le") / F.col("rank_n"))


def band(score: Column | str, bands: dict[str, float] = S.BANDS) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return (F.when(score.isNull(), "INSUFFICIENT_EVIDENCE").when(score >= bands["critical"], "CRITICAL")
            .when(score >= bands["high"], "HIGH").when(score >= bands["moderate"], "MODERATE").otherwise("LOW"))


def _evidence(name, value, direction, weight, detail) -> Column:
    return F.struct(name.alias("name"), value.cast("double").alias("value"), F.lit(direction).cast("int").alias("direction"),
                    weight.cast("double").alias("weight"), detail.alias("detail"))


def top_evidence(evidence: Column | str, k: int) -> Column:
    """The k heaviest items; equal weights keep name order."""
    keyed = F.transform(evidence, lambda e: F.struct((-F.abs(e["weight"])).alias("w"), e["name"].alias("n"), e.alias("e")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["e"])


def _component(panel_keys: DataFrame, pct: DataFrame, name: str, signals, words: dict[str, str]) -> DataFrame:
    """Shared part of the three signal components: risk percentiles, evidence, mean and dispersion."""
    known = {f: (d, label) for f, d, label in signals}
    label = F.coalesce(*[F.when(F.col("feature") == f, F.lit(v[1])) for f, v in known.items()])
    falls = [f for f, (d, _) in known.items() if d < 0]
    risk = F.when(F.col("feature").isin(falls), 1.0 - F.col("percentile")).otherwise(F.col("percentile"))
    mark = F.when(F.col("feature").isin(list(S.PROXY_FEATURES)), F.lit(" (proxy)")).otherwise(F.lit("")) if words.get("proxy") else F.lit("")
    strong = F.when(F.col("_risk") >= EXTREME, F.lit(words["extreme"])).otherwise(F.lit(words["elevated"]))
    raised = F.concat(label, mark, F.lit(" is "), strong, F.lit(": "), fixed("value", 4), F.lit(", "),
                      percent("_risk"), F.lit(" of its trailing history"))
    calm = F.concat(label, F.lit(f" is {words['calm']}: "), fixed("value", 4), F.lit(", "), percent("_risk"),
                    F.lit(" of its trailing history"))
    item = (F.when(F.col("_risk") >= ELEVATED, _evidence(F.col("feature"), F.col("value"), 1, F.col("_risk"), raised))
            .when(F.col("_risk") <= CALM, _evidence(F.col("feature"), F.col("value"), -1, 1.0 - F.col("_risk"), calm)))
    used = (pct.filter(F.col("feature").isin(list(known))).withColumn("_risk", risk).withColumn("_item", item)
            .groupBy(*POINT).agg(F.avg("_risk").alias("_mean"), F.stddev_pop("_risk").alias("_std"),
                                 F.count(F.lit(1)).alias("n_used"), F.collect_list("_item").alias("evidence")))
    return (panel_keys.select(*POINT).join(used, POINT, "left")
            .withColumns({"component": F.lit(name), "n_used": F.coalesce("n_used", F.lit(0)),
                          "score": 100.0 * F.col("_mean"), "coverage": F.coalesce("n_used", F.lit(0)) / float(len(known)),
                          "evidence": F.coalesce(F.array_sort("evidence"), F.array().cast(EVIDENCE))}))


def _report(df: DataFrame, confidence: Column, status: Column) -> DataFrame:
    seen = F.col("n_used") > 0
    return df.select("component", *POINT, "score", F.when(seen, confidence).otherwise(0.0).alias("confidence"),
                     F.when(seen, status).otherwise("UNAVAILABLE").alias("status"), band("score").alias("risk"),
                     F.col("n_used").cast("long").alias("n_used"), "evidence")


def market(keys: DataFrame, pct: DataFrame) -> DataFrame:
    """Confidence is coverage times agreement of the signals."""
    df = _component(keys, pct, "market", S.MARKET_SIGNALS,
                    {"extreme": "extreme", "elevated": "elevated", "calm": "calm"})
    agreement = F.when(F.col("n_used") < 2, 0.5).otherwise(clip(1.0 - 2.0 * F.col("_std"), 0.0, 1.0))
    return _report(df, F.col("coverage") * agreement, F.when(F.col("coverage") >= 0.8, "OK").otherwise("DEGRADED"))


def flow(keys: DataFrame, pct: DataFrame) -> DataFrame:
    """Mostly stand-in signals: with three or more of them confidence is cut and the status degraded."""
    df = _component(keys, pct, "flow", S.FLOW_SIGNALS,
                    {"extreme": "sharply elevated", "elevated": "elevated", "calm": "benign", "proxy": "yes"})
    many = sum(f in S.PROXY_FEATURES for f, _, _ in S.FLOW_SIGNALS) >= 3
    status = F.when((F.col("coverage") < 0.8) | F.lit(many), "DEGRADED").otherwise("OK")
    return _report(df, F.col("coverage") * (0.75 if many else 1.0), status)


def sentiment(keys: DataFrame, pct: DataFrame) -> DataFrame:
    """Level only: confidence is capped and the status always degraded."""
    df = _component(keys, pct, "sentiment", S.SENTIMENT_SIGNALS,
                    {"extreme": "stressed", "elevated": "stressed", "calm": "constructive"})
    return _report(df, F.least(F.lit(0.55), F.col("coverage")), F.lit("DEGRADED"))


def models(keys: DataFrame, predictions: DataFrame) -> DataFrame:
    """Mean model probability; the spread between models lowers the confidence."""
    item = _evidence(F.concat(F.lit("model:"), "model"), F.col("probability"), 1, F.col("probability"),
                     F.concat(F.upper("model"), F.lit(" estimates "), percent("probability"), F.lit(" crash probability")))
    p = (predictions.filter("probability IS NOT NULL").withColumn("_item", item).groupBy(*POINT).agg(
        F.avg("probability").alias("_mean"), (F.max("probability") - F.min("probability")).alias("spread"),
        F.min_by("model", F.struct("probability", "model")).alias("lowest"),
        F.max_by("model", F.struct("probability", "model")).alias("highest"),
        F.count(F.lit(1)).alias("n_used"), F.array_sort(F.collect_list("_item")).alias("evidence")))
    df = keys.select(*POINT).join(p, POINT, "left").withColumns({
        "component": F.lit("models"), "score": 100.0 * F.col("_mean"), "n_used": F.coalesce("n_used", F.lit(0)),
        "evidence": F.coalesce("evidence", F.array().cast(EVIDENCE))})
    seen = F.col("n_used") > 0
    status = F.when(F.col("spread") >= DISAGREEMENT, "DEGRADED").otherwise("OK")
    return df.select("component", *POINT, "score",
                     F.when(seen, clip(1.0 - F.col("spread"), 0.0, 1.0)).otherwise(0.0).alias("confidence"),
                     F.when(seen, status).otherwise("UNAVAILABLE").alias("status"), band("score").alias("risk"),
                     F.col("n_used").cast("long").alias("n_used"), "evidence", "spread", "lowest", "highest")


def severity(panel: DataFrame, horizon: int = S.HORIZON_DAYS, min_rows: int = 60) -> DataFrame:
    """Median and 90th percentile of an asset's past horizon-row declines."""
    change = F.col("close") / F.lag("close", horizon).over(ordered()) - 1.0
    df = panel.select("asset", "date", "close").withColumn("_c", change)
    fall = F.when(F.col("_c") < 0, -F.col("_c"))
    return df.groupBy("asset").agg(
        F.count("close").alias("n_rows"), F.count(fall).alias("n_declines"),
        F.percentile(fall, F.array(F.lit(0.5), F.lit(0.9))).alias("_q")).select(
        "asset", "n_declines", *[F.when((F.col("n_rows") >= min_rows) & (F.col("n_declines") > 0), F.col("_q")[i]).alias(n)
                                 for i, n in enumerate(("decline_low", "decline_high"))])


def orchestrate(reports: DataFrame, weights: dict[str, float] = S.COMPONENT_WEIGHTS) -> DataFrame:
    """Weighted mean of the usable components; disagreement halves the confidence at most."""
    base = F.coalesce(*[F.when(F.col("component") == c, F.lit(w)) for c, w in weights.items()], F.lit(S.DEFAULT_COMPONENT_WEIGHT))
    usable = F.col("status").isin("OK", "DEGRADED") & F.col("score").isNotNull()
    voice = F.when(usable, F.struct("component", "score", "confidence", "risk", (base * F.greatest("confidence", F.lit(0.05))).alias("w")))
    df = reports.groupBy(*POINT).agg(F.array_sort(F.collect_list(voice)).alias("v"), F.count(F.lit(1)).alias("n_components"))
    def total(term):
        return F.aggregate(F.transform("v", term), F.lit(0.0), lambda a, x: a + x)
    df = df.withColumns({"n_usable": F.size("v").cast("long"), "_w": total(lambda v: v["w"])})
    enough = F.col("n_usable") >= 2
    df = df.withColumn("score", F.when(enough, total(lambda v: v["score"] * v["w"]) / F.col("_w")))
    df = df.withColumns({
        "spread": F.when(enough, F.array_max("v.score") - F.array_min("v.score")),
        "dispersion": F.when(enough, F.sqrt(total(lambda v: v["w"] * F.pow(v["score"] - F.col("score"), F.lit(2.0))) / F.col("_w"))),
        "_conf": F.when(enough, total(lambda v: v["w"] * v["confidence"]) / F.col("_w"))})
    df = df.withColumn("consensus", clip(1.0 - F.col("dispersion") / 50.0, 0.0, 1.0))
    item = lambda v: F.struct(
        v["component"].alias("name"), v["score"].alias("value"), F.when(v["score"] >= 50, 1).otherwise(-1).alias("direction"),
        (v["w"] / F.col("_w")).alias("weight"),
        F.concat(v["component"], F.lit(": "), v["risk"], F.lit(" at "), fixed(v["score"], 0), F.lit("/100")).alias("detail"))
    status = F.when(~enough, "UNAVAILABLE").when(F.col("n_usable") >= 3, "OK").otherwise("DEGRADED")
    return df.select(*POINT, "score", F.coalesce((0.5 + 0.5 * F.col("consensus")) * F.col("_conf"), F.lit(0.0)).alias("confidence"),
                     status.alias("status"), band("score").alias("risk"), "spread", "dispersion", "consensus", "n_usable",
                     F.col("n_components").cast("long").alias("n_components"), F.transform("v", item).alias("evidence"))


def context(panel: DataFrame, pct: DataFrame, long_rows: int = 120, min_history: int = 100) -> DataFrame:
    """What the sceptic looks at per (asset, date): trend, flows and whether volatility is unheard of.

    A value exceeds the interpolated 99th percentile of its history exactly when
    more than floor(0.99 (n-1)) earlier values lie strictly below it, so the
    expanding quantile needs no more than the rank.
    """
    w = trailing(long_rows)
    mean = F.when(F.count(F.lit(1)).over(w) == long_rows, F.avg("close").over(w))
    novel = (F.col("rank_n") >= min_history) & (F.col("rank_lt") > F.floor(0.99 * (F.col("rank_n") - 1)))
    vol = pct.filter("feature = 'realized_vol_30'").select(*POINT, F.col("value").alias("vol"), novel.alias("novel"))
    return (panel.select(*POINT, "close", mean.alias("long_mean"), F.col("exchange_netflow_7").alias("netflow"),
                         F.col("stablecoin_netflow").alias("supply_change")).join(vol, POINT, "left"))


def skeptic(preliminary: DataFrame, reports: DataFrame, ctx: DataFrame, analogues: DataFrame | None = None) -> DataFrame:
    """Counter-evidence: seven checks with fixed weights, their sum capped.

    ``analogues`` brings ``best_similarity`` per (asset, date); without it that check stays silent.
    """
    blind = reports.groupBy(*POINT).agg(
        F.sum((F.col("status") == "UNAVAILABLE").cast("long")).alias("n_blind"),
        F.max(F.when(F.col("component") == "models", F.col("spread"))).alias("model_spread"))
    df = (preliminary.select(*POINT, F.col("score").alias("_s"), F.col("spread").alias("_spread"))
          .join(ctx, POINT, "left").join(blind, POINT, "left"))
    if analogues is not None:
        df = df.join(analogues.select(*POINT, "best_similarity"), POINT, "left")
    else:
        df = df.withColumn("best_similarity", F.lit(None).cast("double"))
    warned = F.col("_s") >= 60
    above = F.col("close") / F.col("long_mean") - 1.0
    n = F.col("n_blind").cast("double")
    checks = [
        ("long_term_trend", warned & (F.col("close") > F.col("long_mean") * 1.10), above, F.lit(0.15),
         F.concat(F.lit("price is "), percent(above, 1), F.lit(" above its long mean; the trend contradicts the warning"))),
        ("conflicting_flow", warned & (F.col("netflow") > 0) & (F.col("supply_change") > 0.01), F.col("supply_change"), F.lit(0.12),
         F.concat(F.lit("supply grows by "), percent("supply_change", 2), F.lit(" while the warning rests on selling"))),
        ("model_disagreement", F.col("model_spread") >= DISAGREEMENT, F.col("model_spread"),
         F.least(0.05 + F.col("model_spread") * 0.5, F.lit(0.20)),
         F.concat(F.lit("the models disagree by "), percent("model_spread"))),
        ("data_quality", F.col("n_blind") > 0, n, F.least(0.10 * n, F.lit(0.25)),
         F.concat(fixed(n, 0), F.lit(" component(s) saw no data"))),
        ("agent_divergence", F.col("_spread") >= 40.0, F.col("_spread"), F.least(F.col("_spread") / 400.0, F.lit(0.15)),
         F.concat(F.lit("the components span "), fixed("_spread", 0), F.lit(" points"))),
        ("regime_novelty", F.col("novel"), F.col("vol"), F.lit(0.12),
         F.concat(F.lit("volatility "), fixed("vol", 3), F.lit(" exceeds the 99th percentile of its history"))),
        ("weak_analogue", F.col("best_similarity") < 0.60, F.col("best_similarity"), F.lit(0.10),
         F.concat(F.lit("the closest precedent has similarity "), fixed("best_similarity", 2))),
    ]
    raised = F.array_compact(F.array(*[F.when(c, _evidence(F.lit(name), v, -1, w, d)) for name, c, v, w, d in checks]))
    total = F.aggregate("evidence", F.lit(0.0), lambda a, e: a + e["weight"])
    return (df.withColumn("evidence", raised).withColumn("penalty", F.least(total, F.lit(MAX_PENALTY)))
            .select(*POINT, "penalty", F.size("evidence").cast("long").alias("challenges"), "evidence"))


def decide(preliminary: DataFrame, doubt: DataFrame, bands: dict[str, float] = S.BANDS) -> DataFrame:
    """Doubt lowers the confidence fully and the score by half; too little confidence means no level."""
    df = preliminary.select(*POINT, "score", "confidence", "status").join(doubt.select(*POINT, "penalty", "challenges"), POINT)
    formed = (F.col("status") != "UNAVAILABLE") & F.col("score").isNotNull()
    penalty = F.coalesce("penalty", F.lit(0.0))
    df = df.withColumns({
        "final_confidence": F.when(formed, clip(F.col("confidence") * (1.0 - penalty), 0.0, 1.0)).otherwise(0.0),
        "final_score": F.when(formed, F.col("score") * (1.0 - 0.5 * penalty))})
    stated = formed & (F.col("final_confidence") >= MIN_CONFIDENCE)
    df = df.withColumn("risk", F.when(stated, band("final_score", bands)).otherwise("INSUFFICIENT_EVIDENCE"))
    verdict = (F.when(~stated, "ABSTAIN").when(F.col("risk").isin(*S.ALERT_BANDS), "ALERT").otherwise("NO_ALERT"))
    reason = F.when(~formed, "no usable evidence").when(~stated, "confidence below floor")
    return df.select(*POINT, F.col("score").alias("raw_score"), "final_score", "final_confidence", "penalty", "challenges",
                     "risk", verdict.alias("decision"), reason.alias("reason"))


def drivers(reports: DataFrame) -> DataFrame:
    """Risk-raising evidence by name: summed weight, share of the total, rank."""
    items = (reports.select(*POINT, F.explode("evidence").alias("e")).filter("e.direction > 0")
             .groupBy(*POINT, F.col("e.name").alias("driver")).agg(F.sum(F.abs("e.weight")).alias("contribution")))
    per = Window.partitionBy(*POINT)
    total = F.sum("contribution").over(per)
    return (items.withColumn("share", F.coalesce(F.col("contribution") / F.nullif(total, F.lit(0.0)), F.lit(0.0)))
            .withColumn("rank", F.row_number().over(per.orderBy(F.desc("contribution"), "driver"))))


def recommendation(penalty: Column, challenges: Column) -> Column:
    """What the sceptic advises, from the size of its penalty."""
    n, share = challenges.cast("string"), percent(penalty)
    return (F.when(challenges == 0, "No material counter-evidence found; the assessment stands as issued.")
            .when(penalty >= 0.40, F.concat(F.lit("Reduce confidence substantially: "), n, F.lit(" independent challenges totalling a "), share, F.lit(" reduction.")))
            .when(penalty >= 0.20, F.concat(F.lit("Reduce confidence: "), n, F.lit(" challenge(s), "), share, F.lit(" reduction.")))
            .otherwise(F.concat(F.lit("Minor caveats only: "), n, F.lit(" challenge(s), "), share, F.lit(" reduction."))))


def narrative(decisions: DataFrame, ranked: DataFrame, reports: DataFrame, doubt: DataFrame, precedents: DataFrame | None = None) -> DataFrame:
    """One deterministic sentence group per decision, from its numbers only, and the sceptic's recommendation.

    ``precedents`` brings a ``summary`` per (asset, date) for the sentence on the nearest earlier window.
    """
    top = (ranked.filter("rank <= 5").groupBy(*POINT).agg(F.array_sort(F.collect_list(F.struct("rank", "driver", "share"))).alias("t")))
    listed = F.array_join(F.transform("t", lambda d: F.concat(d["driver"], F.lit(" ("), percent(d["share"]), F.lit(")"))), ", ")
    each = F.array_join(F.transform("evidence", lambda e: F.concat(F.regexp_replace(e["name"], "^model:", ""), F.lit(" "), percent(e["value"]))), ", ")
    quant = reports.filter("component = 'models' AND score IS NOT NULL").select(*POINT, (F.col("score") / 100.0).alias("_q"), each.alias("_each"))
    against = doubt.select(*POINT, F.array_join(F.transform(top_evidence("evidence", 2), lambda e: e["detail"]), "; ").alias("_c"))
    df = decisions.join(top, POINT, "left").join(quant, POINT, "left").join(against, POINT, "left")
    df = df.join(precedents.select(*POINT, F.col("summary").alias("_p")), POINT, "left") if precedents is not None else df.withColumn("_p", F.lit(None).cast("string"))
    day = F.date_format("date", "yyyy-MM-dd")
    declined = F.concat(F.lit("The system declines to state a risk level for "), "asset", F.lit(" as of "), day, F.lit("."), F.coalesce(F.concat(F.lit(" "), "reason", F.lit(".")), F.lit("")))
    full = F.concat_ws(
        " ",
        F.concat("asset", F.lit(" is assessed at "), "risk", F.lit(" risk ("), fixed("final_score", 0), F.lit("/100) as of "), day, F.lit(".")),
        F.concat(F.lit("The primary drivers are "), listed, F.lit(".")),
        F.concat(F.lit("The models estimate a "), percent("_q"), F.lit(" probability of a severe decline ("), "_each", F.lit(").")),
        F.when(F.col("_c") != "", F.concat(F.lit("Counter-evidence: "), "_c", F.lit("."))),
        F.concat(F.lit("Nearest historical analogue: "), "_p", F.lit(".")),
        F.concat(F.lit("Confidence: "), percent("final_confidence"), F.lit(".")))
    return df.select(*POINT, "risk", F.when(F.col("risk") == "INSUFFICIENT_EVIDENCE", declined).otherwise(full).alias("text"),
                     recommendation(F.coalesce("penalty", F.lit(0.0)), F.coalesce("challenges", F.lit(0))).alias("recommendation"))
