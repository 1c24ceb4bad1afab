"""Word vectors of slice tokens, and labels by the nearest prototype."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

#: Seed tokens of the traffic prototypes.
TRAFFIC_SEEDS = {
    "Discovery": ("FLOW", "HAS_PEER", "SVC_DNS", "PORT_WELLKNOWN", "BYTES_L", "PKT_L"),
    "LateralMovement": ("FLOW", "HAS_PEER", "SVC_SMB", "SVC_RDP", "SVC_SSH", "PORT_WELLKNOWN"),
    "CommandAndControl": ("FLOW", "HAS_PEER", "SVC_HTTPS", "SVC_HTTP", "BYTES_L", "PKT_L"),
    "Exfiltration": ("FLOW", "HAS_PEER", "SVC_HTTPS", "SVC_HTTP", "BYTES_H", "PKT_H"),
    "Benign": ("HOST", "FLOW", "SVC_DHCP", "BYTES_L", "PKT_L"),
}


def sentences(tokens: DataFrame, steps: int = 200) -> DataFrame:
    """Token lists of at most `steps` steps of a slice, so that no slice is gathered whole."""
    by = tokens.groupBy("stream", "slice_id", F.floor(F.col("step") / steps).alias("part")).agg(F.array_sort(F.collect_list(F.struct("step", "tokens"))).alias("t"))
    return by.select("stream", "slice_id", F.flatten(F.transform("t", lambda x: x["tokens"])).alias("tokens"))


def train_vectors(tokens: DataFrame, size: int = 64, iterations: int = 10, seed: int = 42, per_task: int = 10_000) -> Word2VecModel:
    """Skip-gram vectors, window 5, all tokens kept; one task for each `per_task` token lists."""
    lists = sentences(tokens)
    partitions = max(1, -(-lists.count() // per_task))
    return Word2Vec(vectorSize=size, windowSize=5, minCount=1, maxIter=iterations, seed=seed, numPartitions=partitions, inputCol="tokens", outputCol="vector").fit(lists)


def slice_vectors(tokens: DataFrame, model: Word2VecModel) -> DataFrame:
    """(stream, slice_id, vec), the mean of the known tokens' vectors, zeros where none is known."""
    long = tokens.select("stream", "slice_id", F.explode("tokens").alias("word")).groupBy("stream", "slice_id", "word").agg(F.count("*").cast("double").alias("n"))
    joined = long.join(model.getVectors(), "word")
    means = joined.groupBy("stream", "slice_id").agg(vector_to_array(Summarizer.mean(F.col("vector"), F.col("n"))).alias("vec"))
    every = tokens.select("stream", "slice_id").distinct()
    zeros = F.array_repeat(F.lit(0.0), model.getVectorSize())
    return every.join(means, ["stream", "slice_id"], "left").withColumn("vec", F.coalesce("vec", zeros))


def seed_prototypes(model: Word2VecModel, seeds: dict[str, tuple[str, ...]]) -> dict[str, list[float]]:
    """The mean vector of each label's known seeds, zeros if none: labels x vector size numbers."""
    words = sorted({w for s in seeds.values() for w in s})
    size = model.getVectorSize()
    known = {r["word"]: r["vector"].toArray() for r in model.getVectors().filter(F.col("word").isin(words)).collect()}
    return {label: (sum(known[w] for w in s if w in known) / max(1, sum(w in known for w in s)) + [0.0] * size).tolist() if any(w in known for w in s) else [0.0] * size for label, s in seeds.items()}


def _cosine(vec: Column, other: list[float]) -> Column:
    dot = F.aggregate(F.zip_with(vec, F.lit(other), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x)) * sum(x * x for x in other) ** 0.5
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def nearest_label(vectors: DataFrame, prototypes: dict[str, list[float]], tau: float | None = None) -> DataFrame:
    """semantic_label and semantic_score by the largest cosine, the earlier label on ties; under tau: UNK."""
    sims = F.array(*[F.struct(_cosine(F.col("vec"), v).alias("sim"), F.lit(-i).alias("place"), F.lit(label).alias("label")) for i, (label, v) in enumerate(prototypes.items())])
    rows = vectors.withColumn("_best", F.array_max(sims))
    label = F.col("_best.label") if tau is None else F.when(F.col("_best.sim") < tau, "UNK").otherwise(F.col("_best.label"))
    return rows.withColumns({"semantic_label": label, "semantic_score": F.col("_best.sim")}).drop("_best", "vec")


def dense(values: Column) -> Column:
    return array_to_vector(F.transform(values, lambda x: x.cast("double")))
