"""Evidence packs: one row a slice with chain, motifs, techniques, label, score and sentence, ready for the hypergraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules
from . import evidence, flowslices, ordered, slicing

KEY = ["stream", "slice_id"]


def bag_labels(tokens: DataFrame, seeds: dict[str, tuple[str, ...]], tau: float | None = None) -> DataFrame:
    """C9 without trained vectors: (stream, slice_id, semantic_label, semantic_score, sims) of tokens(stream, slice_id, word, n).

    A slice is the vector of its token counts, a label the vector of ones at its seeds; the label is the one of the largest
    cosine, the earlier on ties (of 12 decimals), UNK under tau. sims has every label's cosine. Every slice of tokens has a row.
    """
    spark = tokens.sparkSession
    rows = [(w, label, i, len(set(s)) ** -0.5) for i, (label, s) in enumerate(seeds.items()) for w in dict.fromkeys(s)]
    marks = F.broadcast(spark.createDataFrame(rows, "word string, label string, place int, share double"))  # the given seeds
    counts = tokens.groupBy(*KEY, "word").agg(F.sum("n").cast("double").alias("n"))
    norms = counts.groupBy(*KEY).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dots = counts.join(marks, "word").groupBy(*KEY, "label", "place").agg(F.sum(F.col("n") * F.col("share")).alias("dot"))
    found = dots.join(norms, KEY).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("label", F.round(F.col("dot") / F.col("norm"), 12)))).alias("held"))
    every = norms.select(*KEY).join(found, KEY, "left")
    sims = [F.struct(F.coalesce(F.col("held")[label], F.lit(0.0)).alias("sim"), F.lit(-i).alias("place"), F.lit(label).alias("label")) for i, label in enumerate(seeds)]
    best = F.array_max(F.array(*sims))
    label = best["label"] if tau is None else F.when(best["sim"] < tau, "UNK").otherwise(best["label"])
    table = F.map_from_arrays(F.array(*[F.lit(x) for x in seeds]), F.array(*[s["sim"] for s in sims]))
    return every.select(*KEY, label.alias("semantic_label"), best["sim"].alias("semantic_score"), table.alias("sims"))


def _motifs(rows: DataFrame, order: str, **fields: Column) -> DataFrame:
    """The motif rows of each slice as one array of structs in order."""
    motif = F.struct(F.col(order).alias("at"), F.struct(*[v.alias(k) for k, v in fields.items()]).alias("m"))
    by = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(motif)).alias("x"))
    return by.select(*KEY, F.transform("x", lambda x: x["m"]).alias("motifs"))


def host_packs(chains: DataFrame, labels: DataFrame, key: bytes) -> DataFrame:
    """C10 of host chains(stream, slice_id, chain) and labels(stream, slice_id, semantic_label, semantic_score): (stream,
    slice_id, t_start, semantic_label, semantic_score, ttp, motifs, evidence_sentence, chain).

    Motifs are the runs of equal events of the chain's steps, with hashed entities and the techniques named in a run; ttp is the
    first technique. Slices without label have none.
    """
    steps = chains.select(*KEY, F.posexplode("chain").alias("pos", "c")).select(*KEY, (F.col("pos") + 1).alias("step"), F.col("c.etype").alias("names"), rules.keyed_token(F.col("c.entity"), key).alias("entity"), F.col("c.ttp").alias("ttp"))
    runs = slicing.run_motifs(steps.select(F.struct(*KEY).alias("key"), F.col("step").alias("pos"), F.col("names").alias("name"), "entity", "ttp"))
    motifs = _motifs(runs.select("key.*", "run", "name", "n", "entities", "techniques"), "run", event_type=F.col("name"), count=F.col("n"), entities=F.col("entities"), techniques=F.col("techniques"))
    told = evidence.host_sentences(steps, labels)
    heads = chains.select(*KEY, F.get("chain", F.lit(0))["t_ns"].alias("t_start"), rules.kept_technique(F.col("chain")).alias("ttp"), "chain")
    return heads.join(labels.select(*KEY, "semantic_label", "semantic_score"), KEY, "left").join(motifs, KEY, "left").join(told, KEY, "left").select(*KEY, "t_start", "semantic_label", "semantic_score", "ttp", "motifs", "evidence_sentence", "chain")


def flow_packs(sliced: DataFrame, steps: DataFrame, labels: DataFrame, tactics: DataFrame, salt: str, least: int = 3) -> DataFrame:
    """C10 of flow slices (flowslices.flow_slices' rows), their chains' steps, labels and A2's tactics(stream, slice_id, tactic):
    (stream, slice_id, t_start, semantic_label, semantic_score, ttp, motifs, evidence_sentence, chain_len), slices with chains
    of at least `least` steps. The slice's tactic is its technique, in every motif."""
    slices = sliced.groupBy(*KEY).agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))
    length = steps.groupBy(*KEY).agg(F.count("*").alias("chain_len")).filter(F.col("chain_len") >= least)
    found = ordered.written(flowslices.flow_motifs(steps, salt))
    motifs = _motifs(found.join(tactics, KEY), "first", event_type=F.col("event_type"), count=F.col("n"), entities=F.col("entities"), techniques=F.array(F.col("tactic")))
    rows = slices.join(length, KEY).join(labels.select(*KEY, "semantic_label", "semantic_score"), KEY)
    told = evidence.flow_sentences(rows, found)
    return rows.join(told, KEY).join(tactics, KEY, "left").join(motifs, KEY, "left").select(*KEY, "t_start", "semantic_label", "semantic_score", F.col("tactic").alias("ttp"), "motifs", "evidence_sentence", "chain_len")


def event_packs(sliced: DataFrame, seeds: dict[str, tuple[str, ...]]) -> DataFrame:
    """Packs of whole event slices(stream, slice_id, t_ns, seq, etype, o, ttp), labelled by their event and technique counts:
    (stream, slice_id, t_start, semantic_label, semantic_score, ttp, motifs). Motifs are runs of equal events."""
    has = F.coalesce(F.col("ttp"), F.lit("")) != ""
    words = sliced.select(*KEY, F.explode(F.array_compact(F.array(F.col("etype"), F.when(has, F.concat(F.lit("TTP_"), "ttp"))))).alias("word"))
    labels = bag_labels(words.groupBy(*KEY, "word").agg(F.count("*").alias("n")), seeds)
    steps = sliced.select(F.struct(*KEY).alias("key"), F.struct("t_ns", "seq").alias("pos"), F.col("etype").alias("name"), F.col("o").alias("entity"), "ttp")
    runs = slicing.run_motifs(steps).select("key.*", "run", "name", "n", "entities", "techniques")
    motifs = _motifs(runs, "run", event_type=F.col("name"), count=F.col("n"), entities=F.col("entities"), techniques=F.col("techniques"))
    first = sliced.groupBy(*KEY).agg(F.min("t_ns").alias("t_start"), F.min_by(F.when(has, F.col("ttp")), F.when(has, F.struct("t_ns", "seq"))).alias("ttp"))
    return first.join(labels.drop("sims"), KEY).join(motifs, KEY).select(*KEY, "t_start", "semantic_label", F.round("semantic_score", 6).alias("semantic_score"), F.coalesce("ttp", F.lit("")).alias("ttp"), "motifs")
