"""Class weights, prototypes, prototype scores, sampling quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import metrics


def class_weights(rows: DataFrame, label: str, beta: float = 0.999) -> DataFrame:
    """Count, prior, log prior and the four weights (none, inverse, inverse root, effective), of mean 1 each."""
    every = Window.partitionBy()
    n = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    n = n.withColumn("prior", F.col("n") / F.sum("n").over(every))
    raw = {"w_inv": 1 / F.col("n"), "w_sqrt": 1 / F.sqrt("n"), "w_eff": (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))}
    return n.select("label", "n", "prior", F.log("prior").alias("log_prior"), F.lit(1.0).alias("w_none"), *[(w / F.avg(w).over(every)).alias(k) for k, w in raw.items()])


def prototypes(vectors: DataFrame) -> DataFrame:
    """A13 over vectors(id, label, vec): (label, pos, val), each class's mean vector with length 1."""
    long = vectors.select("label", F.posexplode("vec").alias("pos", "x"))
    mean = long.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))
    return mean.select("label", "pos", F.when(norm > 0, F.col("m") / norm).otherwise(F.lit(0.0)).alias("val"))


def boosted(weights: DataFrame, weight: str, boosts: dict) -> DataFrame:
    """weights(label, ...) with the column `weight` multiplied for the labels in boosts, of mean 1 again."""
    factor = F.coalesce(*[F.when(F.col("label") == k, F.lit(float(v))) for k, v in boosts.items()], F.lit(1.0))
    return weights.withColumn(weight, F.col(weight) * factor).withColumn(weight, F.col(weight) / F.avg(weight).over(Window.partitionBy()))


def prototype_scores(vectors: DataFrame, protos: DataFrame, tau: float = 0.1, reduce: str = "max", most: int = 1_000_000) -> DataFrame:
    """(id, y, label, logit, p): cosine to each prototype over tau, and the softmax of it.

    protos(label, pos, val) or, with several of a class, (label, centre, pos, val): reduce joins these by max or logsumexp.
    The prototypes are gathered to one row and sent to all tasks; their numbers are counted first, at most `most`.
    """
    key = ["label", "centre"] if "centre" in protos.columns else ["label"]
    if protos.count() > most:
        raise ValueError(f"the prototypes hold more than {most} numbers")
    per = protos.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "val"))), lambda x: x["val"]).alias("proto"))
    rows = vectors.select("id", F.col("label").alias("y"), F.transform("vec", lambda x: x.cast("double")).alias("vec"), F.lit(1).alias("one"))
    sent = per.agg(F.collect_list(F.struct("label", "proto")).alias("protos"), F.lit(1).alias("one"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.zip_with("vec", "x.proto", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    met = rows.join(F.broadcast(sent), "one").withColumn("norm", norm).select("id", "y", "vec", "norm", F.explode("protos").alias("x"))
    logit = met.select("id", "y", "x.label", (F.when(F.col("norm") > 0, dot / F.col("norm")).otherwise(0.0) / tau).alias("logit"))
    own = Window.partitionBy("id")
    if len(key) > 1:
        top = F.max("logit").over(Window.partitionBy("id", "y", "label"))
        joined = F.max("logit") if reduce == "max" else F.max("top") + F.log(F.sum(F.exp(F.col("logit") - F.col("top"))))
        logit = logit.withColumn("top", top).groupBy("id", "y", "label").agg(joined.alias("logit"))
    e = F.exp(F.col("logit") - F.max("logit").over(own))
    return logit.withColumn("_e", e).select("id", "y", "label", "logit", (F.col("_e") / F.sum("_e").over(own)).alias("p"))


def adjusted(scores: DataFrame, priors: DataFrame, strength: float) -> DataFrame:
    """scores(id, y, label, logit) with strength times the label's log prior added to the logit, and p again."""
    own = Window.partitionBy("id")
    rows = scores.join(F.broadcast(priors.select("label", "log_prior")), "label").withColumn("logit", F.col("logit") + strength * F.col("log_prior"))
    e = F.exp(F.col("logit") - F.max("logit").over(own))
    return rows.withColumn("_e", e).select("id", "y", "label", "logit", (F.col("_e") / F.sum("_e").over(own)).alias("p"))


def moved_prototypes(old: DataFrame, new: DataFrame, keep: float = 0.9) -> DataFrame:
    """(label, pos, val): keep * old + (1 - keep) * new, of length 1; a label of one table only stays as it is there."""
    both = old.withColumnRenamed("val", "a").join(new.withColumnRenamed("val", "b"), ["label", "pos"], "full")
    val = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(keep * F.col("a") + (1 - keep) * F.col("b"))
    both = both.withColumn("val", val)
    norm = F.sqrt(F.sum(F.col("val") * F.col("val")).over(Window.partitionBy("label")))
    return both.select("label", "pos", F.when(norm > 0, F.col("val") / norm).otherwise(0.0).alias("val"))


def quota_alloc(weights: DataFrame, weight: str, total: int, floors: dict | None = None, per_class: int = 0, size: str | None = None) -> DataFrame:
    """(label, quota), by floor(share * total) and at least the class's floor; what is missing goes to the largest
    remainders, one each and round again; what is too much is taken from the largest quota down to its floor, then from the
    next. Ties: the smaller label. One row a label.

    per_class is every class's floor if total allows that for all classes; floors has floors of single labels, of which one
    over total lifts no quota. size names the column with a class's rows: a class without any has no share, floor or quota.
    Null and negative weights count as 0; if all are 0, classes share alike. Floors that exceed total together stay.
    """
    every = Window.partitionBy()
    own = F.coalesce(*[F.when(F.col("label") == k, F.lit(int(v))) for k, v in (floors or {}).items()], F.lit(0)).cast("long")
    rows = weights.withColumn("there", F.coalesce(F.col(size) > 0, F.lit(False)) if size else F.lit(True)).filter("there")
    rows = rows.withColumn("w", F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))).withColumns({"classes": F.count("*").over(every), "all_w": F.sum("w").over(every)})
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(1 / F.col("classes"))
    common = F.when(F.col("classes") * per_class <= total, F.lit(per_class)).otherwise(0).cast("long")
    rows = rows.withColumns({"x": share * total, "low": F.greatest(common, own), "lift": F.greatest(common, F.when(own <= total, own).otherwise(0))})
    rows = rows.withColumn("q", F.greatest(F.floor("x"), F.col("lift")).cast("long")).withColumn("need", F.lit(total) - F.sum("q").over(every))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("x") - F.floor("x")), "label"))
    more = F.floor(F.col("need") / F.col("classes")) + (rank <= F.pmod("need", "classes")).cast("long")
    room = F.greatest(F.col("q") - F.col("low"), F.lit(0))
    before = F.coalesce(F.sum(room).over(Window.orderBy(F.desc("q"), "label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gone = F.least(room, F.greatest(-F.col("need") - before, F.lit(0)))
    return rows.select("label", F.when(F.col("need") >= 0, F.col("q") + more).otherwise(F.col("q") - gone).cast("long").alias("quota"))


def draw(rows: DataFrame, label: str, ident: str, quotas: DataFrame, seed: int) -> DataFrame:
    """Rows with `draw`, quota rows of each label by the hash of seed and id; where the quota is larger than the class,
    its rows come again in the same order (with replacement)."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), ident), ident)) - 1
    pool = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n")).join(quotas.withColumnRenamed("label", "_label"), "_label")
    told = rows.withColumn("_place", place).join(F.broadcast(pool), F.col(label) == F.col("_label")).filter(F.col("_place") < F.col("quota"))
    times = F.floor((F.col("quota") - 1 - F.col("_place")) / F.col("_n"))
    return told.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), times))).drop("_label", "_n", "quota", "_place")


def anomaly_export(preds: DataFrame, tau: float, benign: int = 0) -> DataFrame:
    """Predictions with is_anomaly (the score is at least tau)."""
    return preds.withColumn("is_anomaly", F.col("anomaly") >= tau)


def anomaly_metrics(export: DataFrame, benign: int = 0) -> DataFrame:
    """Precision, recall and F1 of is_anomaly against y not benign, and the average precision of the anomaly score; 0 where
    undefined."""
    hit, real = F.col("is_anomaly"), F.col("y") != benign
    n = export.agg(F.count_if(hit & real).alias("tp"), F.count_if(hit).alias("said"), F.count_if(real).alias("pos"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.expr(f"nullif({b}, 0)"), F.lit(0.0))
    ap = metrics.average_precision(export.select(F.lit(0).alias("label"), F.col("anomaly").alias("score"), real.cast("int").alias("hit")))
    n = n.withColumn("label", F.lit(0)).join(ap, "label", "left")  # one row each
    return n.select(ratio("tp", "said").alias("precision"), ratio("tp", "pos").alias("recall"), F.coalesce(2 * F.col("tp") / F.expr("nullif(said + pos, 0)"), F.lit(0.0)).alias("f1"), F.coalesce("ap", F.lit(0.0)).alias("ap"))


def best_epoch(log: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """The row of the metric log with the largest value, the earliest epoch on ties."""
    return log.orderBy(F.desc(metric), "epoch").limit(1)


def predictions(scores: DataFrame, k: int = 3, benign: int = 0) -> DataFrame:
    """Prediction, top-k labels (ties: smaller label), anomaly score and type of every id."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("logit")).alias("l"), "label", "p")))
    by = scores.groupBy("id", "y").agg(pairs.alias("all"))
    p0 = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.when(x["label"] == benign, x["p"]).otherwise(0.0))
    kind = F.get(F.filter("all", lambda x: x["label"] != benign), F.lit(0))["label"]
    return by.select("id", "y", F.get("all", F.lit(0))["label"].alias("pred"), F.slice(F.transform("all", lambda x: x["label"]), 1, k).alias("top"), (1 - p0).alias("anomaly"), kind.alias("anomaly_type"))


def prediction_export(scores: DataFrame, tau: float, k: int = 3, benign: int = 0) -> DataFrame:
    """K2, G20 over scores(id, y, label, logit, p): (id, y, pred, anomaly, is_anomaly, anomaly_type, top, top_p, p), a row an id.

    anomaly is what the benign class's probability lacks to 1 (all of it without such a class), anomaly_type the best other
    class as text, 'None' under tau. top and top_p are the k best classes and their probabilities (ties: the smaller label), p
    the probabilities of all classes in order of labels.
    """
    by = scores.groupBy("id", "y").agg(F.array_sort(F.collect_list(F.struct((-F.col("logit")).alias("l"), "label", "p"))).alias("all"))
    p0 = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.when(x["label"] == benign, x["p"]).otherwise(0.0))
    other = F.get(F.filter("all", lambda x: x["label"] != benign), F.lit(0))["label"].cast("string")
    first = F.slice("all", 1, k)
    every = F.transform(F.array_sort(F.transform("all", lambda x: F.struct(x["label"].alias("label"), x["p"].alias("p")))), lambda x: x["p"])
    rows = by.withColumn("anomaly", 1 - p0).withColumn("is_anomaly", F.col("anomaly") >= tau)
    return rows.select(
        "id", "y", F.get("all", F.lit(0))["label"].alias("pred"), "anomaly", "is_anomaly", F.when(F.col("is_anomaly"), other).otherwise("None").alias("anomaly_type"),
        F.transform(first, lambda x: x["label"]).alias("top"), F.transform(first, lambda x: x["p"]).alias("top_p"), every.alias("p"),
    )


def fill(rows: DataFrame, ident: str, drawn: DataFrame, total: int, seed: int) -> DataFrame:
    """G17's rest: drawn(ident, draw, ...) with rows of any class, by the hash of seed and id, until there are `total`; they may
    have been drawn before. If more are missing than there are rows, all rows come again and again. `draw` counts on from 1000000
    for them, so that they can be told."""
    need = max(0, total - drawn.count())
    have = rows.count()
    if not need or not have:
        return drawn
    every = rows.withColumn("_all", F.lit(0))
    rest = quota_sample(every, "_all", ident, need % have, seed).withColumn("draw", F.lit(1_000_000).cast("long")) if need % have else None
    rounds = every.withColumn("draw", F.explode(F.sequence(F.lit(1_000_001).cast("long"), F.lit(1_000_000 + need // have).cast("long")))) if need >= have else None
    more = rest.union(rounds) if rest is not None and rounds is not None else rest if rest is not None else rounds
    return drawn.select(ident, "draw").union(more.select(ident, "draw"))


def sample_key(ident: str, seed: int) -> Column:
    """The hash of seed and id, by which samples are drawn."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string")).cast("binary"))


def quota_sample(rows: DataFrame, label: str, ident: str, quota: int, seed: int) -> DataFrame:
    """G17 without replacement: `quota` rows of each class, by the hash of seed and id.

    Counts by the hash's first digits tell below which of them all rows of a class are taken, so only the rows of that
    step and below are ranked: about the quota, whatever the class's size.
    """
    marked = rows.withColumn("_key", sample_key(ident, seed)).withColumn("_step", F.substring("_key", 1, 4))
    before = Window.partitionBy(label).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = marked.groupBy(label, "_step").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    last = steps.filter(F.col("_before") < quota).groupBy(F.col(label).alias("_label")).agg(F.max("_step").alias("_last"))
    near = marked.join(last, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_step") <= F.col("_last")))
    order = Window.partitionBy(label).orderBy("_key", ident)
    return near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= quota).select(*rows.columns)
