"""Processes are told from the events as they are; slicing them first would be done again for each side of the join."""

from hyperslice.operators import slicing
from hyperslice.plans import evidence_queries, queries

D = "/root/testdata/sf0.001"


def test_processes_come_from_events_without_slices(spark, monkeypatch):
    seen, real = [], slicing.process_set
    monkeypatch.setattr(slicing, "process_set", lambda events, *a: seen.append(events.columns) or real(events, *a))
    queries.slice_chains(spark, D)
    evidence_queries.host_evidence(spark, D)
    assert len(seen) == 2 and not any("slice_id" in columns for columns in seen)
    sliced = slicing.slice_events(evidence_queries.ad.events(spark, D), evidence_queries.ad.GAP_NS)
    assert sorted(real(sliced).collect()) == sorted(real(evidence_queries.ad.events(spark, D)).collect())
