"""Named queries against their SQL on the smallest tables, and the stated counts at sf0.01."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from sightline import catalog

SMALL = "/root/testdata/sf0.001"

CHECKED = [
    "join_declared_observed", "agg_abstentions", "tri_queue", "win_witness", "pair_decide",
    "scd2_resolve", "dq_undeclared_kind", "dq_line_shape", "eval_report", "rob_mask_capability",
    "gen_subnet_hosts", "agg_occupancy", "b_device_grouping", "b_presence", "stream_late",
    "b_device_parted", "b_device_bearers", "b_range_cidrs", "b_static_in_span", "b_retention_rollup",
    "rob_order_free", "b_lattice", "b_lattice_outcomes", "b_address_history", "b_decision_history",
    "b_full_record", "src_source_view", "doc_refusals_blind", "src_stream_lines",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, name):
    got = differences(duck(SMALL), spark, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert got[0] is None, got[0]


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_status_per_field(spark):
    rows = entry.queries()["join_declared_observed"](spark, "/root/testdata/sf0.01")
    got = rows.where("entity_id < 160 and attr_key <> 'serial'").groupBy("attr_key", "status").count()
    assert {(r.attr_key, r.status): r["count"] for r in got.collect()} == {
        ("ipv4", "clear"): 120, ("ipv4", "NoObservedValue"): 40,
        ("hostname", "clear"): 89, ("hostname", "gap"): 18,
        ("hostname", "ConflictingObservations"): 13, ("hostname", "NoObservedValue"): 40,
        ("mac", "clear"): 55, ("mac", "gap"): 8, ("mac", "ConflictingObservations"): 27,
        ("mac", "NoObservedValue"): 30,
    }
