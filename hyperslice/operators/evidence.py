"""Tokens and one-sentence evidence of slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The sentences, tactic phrases, event phrases and technique phrases of the evidence text.
FLOW_SENTENCE = "该切片在 %.2fs 内触发 %d 类网络事件（%s），涉及 %d 个对端实体，语义映射为 %s。"
HOST_SENTENCE = "进程 %s 通过 %s，在%s对进程 %s 执行了%s。"
NO_EVENTS = "网络通信事件"
TACTIC_PHRASES = {"Execution": "执行阶段", "DefenseEvasion": "防御规避阶段", "Discovery": "信息发现阶段", "CredentialAccess": "凭据访问阶段", "InitialAccess": "初始访问阶段", "Persistence": "持久化阶段", "Unknown": "未知阶段"}
EVENT_PHRASES = {"EVENT_CREATE_THREAD": "线程创建行为", "EVENT_FORK": "进程派生行为", "EVENT_EXECUTE": "进程执行行为"}
TECHNIQUE_PHRASES = {"T1055": "进程注入相关行为", "T1059.001": "PowerShell 执行行为", "T1059.003": "命令行脚本执行行为", "T1003": "凭据转储行为"}
OTHER_TECHNIQUE = " 相关行为"


def _phrase(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def host_tokens(steps: DataFrame) -> DataFrame:
    """C4 over steps(stream, slice_id, step, names, ttp): name, role, and technique tokens of every step."""
    last = F.max("step").over(Window.partitionBy("stream", "slice_id"))
    role = F.when(F.col("step") == 1, "ROLE_SUBJ").when(F.col("step") == last, "ROLE_OBJ").otherwise("ROLE_PROC")
    has = F.coalesce(F.col("ttp"), F.lit("")) != ""
    parts = F.array(F.when(F.col("names") != "", F.col("names")), role, F.when(has, "HAS_TTP"), F.when(has, F.concat(F.lit("TTP_"), "ttp")))
    return steps.select("stream", "slice_id", "step", F.array_compact(parts).alias("tokens"))


def flow_sentences(slices: DataFrame, motifs: DataFrame) -> DataFrame:
    """slices(stream, slice_id, t_start, t_end, semantic_label) and A3's motifs -> evidence_sentence per slice."""
    kinds = motifs.groupBy("stream", "slice_id").agg(F.count("*").alias("kinds"), F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("events"))
    peers = motifs.select("stream", "slice_id", F.explode("entities").alias("e")).filter(F.col("e").startswith("PEER_"))
    peers = peers.groupBy("stream", "slice_id").agg(F.count_distinct("e").alias("peers"))
    rows = slices.join(kinds, ["stream", "slice_id"], "left").join(peers, ["stream", "slice_id"], "left")
    named = F.coalesce(F.array_join(F.slice(F.transform("events", lambda x: x["event_type"]), 1, 3), "、"), F.lit(NO_EVENTS))
    lasts = F.greatest(F.lit(0.0), F.col("t_end") - F.col("t_start"))
    text = F.format_string(FLOW_SENTENCE, lasts, F.coalesce("kinds", F.lit(0)), named, F.coalesce("peers", F.lit(0)), "semantic_label")
    return rows.select("stream", "slice_id", text.alias("evidence_sentence"))


def host_sentences(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """steps(stream, slice_id, step, names, entity, ttp) and labels(stream, slice_id, semantic_label).

    The method is the first technique in order of names, else the most frequent event (ties: the one seen first).
    Only counts per (slice, name) and each slice's first and last step are gathered.
    """
    key = ["stream", "slice_id"]
    names = steps.groupBy(*key, "names").agg(F.count("*").alias("n"), F.min("step").alias("first"))
    common = names.groupBy(*key).agg(F.max_by("names", F.struct("n", -F.col("first"))).alias("common"))
    ends = steps.groupBy(*key).agg(F.min_by("entity", "step").alias("subject"), F.max_by("entity", "step").alias("object"), F.min(F.when(F.col("ttp") != "", F.col("ttp"))).alias("ttp"))
    technique = F.coalesce(_phrase(TECHNIQUE_PHRASES, F.col("ttp")), F.concat("ttp", F.lit(OTHER_TECHNIQUE)))
    method = F.coalesce(technique, _phrase(EVENT_PHRASES, F.col("common")), F.col("common"))
    tactic = F.coalesce(_phrase(TACTIC_PHRASES, F.col("semantic_label")), F.lit(TACTIC_PHRASES["Unknown"]))
    rows = ends.join(common, key).join(labels, key, "left")
    return rows.select(*key, F.format_string(HOST_SENTENCE, "subject", method, tactic, "object", method).alias("evidence_sentence"))
