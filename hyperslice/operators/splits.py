"""Train, validation and test splits."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules


def stratum_key(label: str, strength: str | None = None, default: str = "unknown") -> Column:
    """P20: the label, or label|strength; blank labels are UNK, blank strengths `default`."""
    text = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other))
    return text(label, "UNK") if strength is None else F.concat(text(label, "UNK"), F.lit("|"), text(strength, default))


def quota_targets(rows: DataFrame, stratum: str, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """A4, A5: rows of each stratum and its quotas; three or more rows leave at least one for val and test. Shares are exact
    decimals, so that halves round to even (45 * 0.7 is 31.5, but less than that in doubles)."""
    n = rows.groupBy(F.coalesce(F.expr(f"nullif({stratum}, '')"), F.lit("UNK")).alias("stratum")).agg(F.count("*").alias("n"))
    share = lambda x: F.bround(F.col("n") * F.lit(Decimal(str(x)))).cast("long")
    n = n.withColumns({"a": share(train), "b": share(val)})
    b = F.when((F.col("n") >= 3) & (F.col("b") < 1), 1).otherwise(F.col("b"))
    n = n.withColumn("b2", b).withColumn("a2", F.least("a", F.col("n") - F.col("b2")))
    short = (F.col("n") >= 3) & (F.col("n") - F.col("a2") - F.col("b2") < 1)
    n = n.withColumn("n_train", F.when(short, F.col("n") - F.col("b2") - 1).otherwise(F.col("a2"))).withColumn("n_val", F.col("b2"))
    return n.select("stratum", "n", "n_train", "n_val", (F.col("n") - F.col("n_train") - F.col("n_val")).alias("n_test"))


#: The bucket that a row takes instead where the one that its hash prefers is full.
INSTEAD = {0: 1, 1: 0, 2: 0}
NAMES = ("train", "val", "test")


def quota_split(rows: DataFrame, stratum: str, ident: str, block: Column, order: list[str], seed: int = 42) -> DataFrame:
    """Rows with stratum, u and split. In the given order, each row goes to the bucket that its id's stable hash u
    prefers (under 1/3 train, under 2/3 val, else test), or to the next one in its list of preferences that has room.

    Buckets fill twice at most before one is left: up to the first fill all rows get what they prefer; then those that
    prefer the full one go to its substitute; after the second fill all go to the last. Both fill points follow from
    running counts of the preferences: those within a block of the order (block: a coarse step of it) by a window, those
    before it from one small table of counts per block, so that no task goes through a whole stratum.
    """
    keyed = rows.withColumn("stratum", F.coalesce(F.expr(f"nullif({stratum}, '')"), F.lit("UNK"))).withColumn("u", rules.stable_unit(F.col(ident).cast("string"), seed))
    keyed = keyed.withColumns({"_pref": F.when(F.col("u") < 1 / 3, 0).when(F.col("u") < 2 / 3, 1).otherwise(2), "_block": block})
    sizes = keyed.groupBy("stratum", "_block").agg(*[F.count_if(F.col("_pref") == b).alias(f"_n{b}") for b in range(3)])
    running = Window.partitionBy("stratum").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("stratum", "_block", *[F.coalesce(F.sum(f"_n{b}").over(running), F.lit(0)).alias(f"_b{b}") for b in range(3)])
    within = Window.partitionBy("stratum", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = keyed.withColumns({f"_c{b}": F.sum((F.col("_pref") == b).cast("long")).over(within) for b in range(3)}).join(before, ["stratum", "_block"])
    quotas = quota_targets(rows, stratum).select("stratum", *[F.col(f"n_{n}").alias(f"_q{b}") for b, n in enumerate(NAMES)])
    told = told.select("*", *[(F.col(f"_c{b}") + F.col(f"_b{b}")).alias(f"_k{b}") for b in range(3)]).join(quotas, "stratum")
    place = F.struct(F.lit(1).alias("row"), F.col("_block").alias("block"), *order)
    start = F.struct(F.lit(0).alias("row"), F.lit(None).cast(keyed.schema["_block"].dataType).alias("block"), *[F.lit(None).cast(keyed.schema[c].dataType).alias(c) for c in order])

    def fill(count: dict[int, Column], open_: dict[int, Column]) -> Column:
        """The first place where one of the open buckets is full, and which; a quota of zero is full at the start."""
        full = [F.when(open_[b] & (count[b] >= F.col(f"_q{b}")), F.struct(F.when(F.col(f"_q{b}") == 0, start).otherwise(place).alias("at"), F.lit(b).alias("b"))) for b in range(3)]
        return F.min(F.least(*full))

    first = told.groupBy("stratum").agg(fill({b: F.col(f"_k{b}") for b in range(3)}, {b: F.lit(True) for b in range(3)}).alias("_f1"))
    told = told.join(first, "stratum")
    gone = F.col("_f1.b")
    over = F.when(gone == 0, F.col("_k0") - F.col("_q0")).when(gone == 1, F.col("_k1") - F.col("_q1")).otherwise(F.col("_k2") - F.col("_q2"))
    to = F.when(gone == 0, INSTEAD[0]).when(gone == 1, INSTEAD[1]).otherwise(INSTEAD[2])
    count = {b: F.col(f"_k{b}") + F.when(to == b, over).otherwise(0) for b in range(3)}
    late = place > F.col("_f1.at")
    second = told.groupBy("stratum").agg(fill(count, {b: (gone != b) & (late | (F.col(f"_q{b}") == 0)) for b in range(3)}).alias("_f2"))
    told = told.join(second, "stratum")
    last = F.lit(3) - gone - F.col("_f2.b")
    bucket = F.when(~late, F.col("_pref")).when(F.col("_f2").isNotNull() & (place > F.col("_f2.at")), last).otherwise(F.when(F.col("_pref") == gone, to).otherwise(F.col("_pref")))
    names = F.array(*[F.lit(n) for n in NAMES])
    return told.select(*rows.columns, "stratum", "u", F.get(names, bucket.cast("int")).alias("split"))


def split_report(rows: DataFrame, label: str) -> DataFrame:
    """A6, E3 over rows(label, split): (split, label, n) for every split and every label of any split; n is 0 where a label is missing."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(*[F.count_if(F.col("split") == n).alias(n) for n in NAMES])
    return counts.select("label", F.explode(F.create_map(*[x for n in NAMES for x in (F.lit(n), F.col(n))])).alias("split", "n"))


def unknown_labels(rows: DataFrame, label: str) -> DataFrame:
    """J7 over rows(label, split): the labels of val or test that train doesn't have; none, if the split can be used."""
    own = lambda which: rows.filter(which).select(F.col(label).alias("label")).distinct()
    return own(F.col("split") != "train").join(own(F.col("split") == "train"), "label", "left_anti")


def split_overlap(rows: DataFrame, ident: str) -> DataFrame:
    """J8 over rows(ident, split): (a, b, n), the number of different ids that two splits share."""
    by = rows.groupBy(F.col(ident).alias("id")).agg(*[F.max(F.col("split") == n).alias(n) for n in NAMES])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    one = by.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a} {b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a} {b}").alias("n")) for a, b in pairs])).alias("x")).select("x.*")


def time_split(rows: DataFrame, bucket: Column, order: list[str], train: float = 0.7, val: float = 0.1) -> DataFrame:
    """By position in the total order: the first int(n train) rows, the next int(n val), the rest.

    bucket is a coarse step of the order (such as its day): a row's position is the number of rows in the buckets before
    its own, from one small table of counts, plus its place in its bucket, so that no task sorts all rows.
    """
    marked = rows.withColumn("_bucket", bucket)
    sizes = marked.groupBy("_bucket").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_bucket", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    told = marked.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1).join(before, "_bucket")
    at, a, b = F.col("_place") + F.col("_before"), F.floor(F.col("_total") * train), F.floor(F.col("_total") * val)
    return told.withColumn("split", F.when(at < a, "train").when(at < a + b, "val").otherwise("test")).drop("_bucket", "_place", "_before", "_total")
