"""Queries against their SQL on tables with the ids and depths that only larger tables have."""

import os

import duckdb
import pytest
from compare import TABLES, differences, duck

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """Users and customers on both sides of number 65,536, where no address is left; a chain of 40 steps from s1."""
    folder = tmp_path_factory.mktemp("larger")
    con = duckdb.connect()
    made = {
        "events": f"""select event_id, ts, if(event_id % 2 = 0, user_id, user_id + 65530) as user_id,
            event_type, value, props from '{SMALL}/events.parquet'""",
        "customer": f"""select * replace (if(c_custkey % 2 = 0, c_custkey, c_custkey + 65530) as c_custkey)
            from '{SMALL}/customer.parquet'""",
        "orders": f"""select o.* replace (n as o_orderkey, n as o_custkey)
            from (select * from '{SMALL}/orders.parquet' limit 1) o, range(1, 21) r(n)""",
        "lineitem": f"""select l.* replace (n as l_orderkey, n + i as l_suppkey, if(i = 0, 1, 50) as l_quantity,
              if(i = 0, 'N', 'R') as l_returnflag)
            from (select * from '{SMALL}/lineitem.parquet' limit 1) l, range(1, 21) r(n), range(2) s(i)""",
    }
    for name in TABLES:
        path = folder / f"{name}.parquet"
        if name in made:
            con.execute(f"copy ({made[name]}) to '{path}' (format parquet)")
        else:
            os.symlink(f"{SMALL}/{name}.parquet", path)
    return str(folder)


@pytest.mark.parametrize("name", [
    "b_impact_bfs", "b_ip_conflict", "b_range_cidrs", "b_static_in_span", "dq_line_shape", "gen_subnet_hosts",
    "stream_ingest_resolve",
])
def test_query_matches_its_sql(spark, larger, name):
    got = differences(duck(larger), spark, entry.queries()[name], entry.oracle_sql()[name], larger)
    assert got[0] is None, got[0]
    assert got[1] > 0


def test_subjects_are_dealt_before_they_are_grouped(spark):
    for name in ("doc_adopt", "doc_refusals", "doc_refusals_blind"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and "Window" not in plan, plan


def test_items_are_dealt_before_they_are_counted(spark):
    from sightline.operators import robust

    rows = lambda *r: spark.createDataFrame(r, "obs_id int, claim string")
    extra = robust.unaccounted(rows((1, "a"), (1, "a"), (1, "a"), (2, None), (3, "c")), rows((1, "a"), (2, None), (9, "z")))
    plan = extra._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("Exchange"), plan
    assert sorted(tuple(r) for r in extra.collect()) == [(1, "a"), (1, "a"), (3, "c")]


def test_many_short_files_are_kept_in_few(spark, monkeypatch, tmp_path):
    from sightline.catalog import feeds

    monkeypatch.setattr(feeds, "LINES_PER_FILE", 10)
    monkeypatch.setattr(feeds, "scratch_path", lambda spark, name: str(tmp_path / name))
    sql = entry.oracle_sql()["src_stream_lines"].replace("// 1000", "// 10")
    got = differences(duck(SMALL), spark, entry.queries()["src_stream_lines"], sql, SMALL)
    assert got[0] is None, got[0]
    # 500 files of five streams; a text file per stream and task.
    assert 0 < len(list(tmp_path.rglob("*.txt"))) <= 5 * 8


def test_hosted_brands_are_met_without_broadcasts(spark, monkeypatch):
    from sightline.catalog import devices

    monkeypatch.setattr(devices, "_history", lambda spark, sf_dir: spark.range(1))
    monkeypatch.setattr(devices.H, "records", lambda history, terms, hosted: hosted)
    hosted = entry.queries()["b_full_record"](spark, SMALL)
    plan = hosted._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan, plan
    sql = entry.oracle_sql()["b_full_record"]
    body = "select mac, count(distinct p_brand)::bigint as instances from declared_wide"
    views = sql[: sql.index("declared as (")].rstrip().rstrip(",")
    want = duck(SMALL).execute(
        f"{views} {body} join orders on o_custkey = entity_id join lineitem on l_orderkey = o_orderkey "
        "join part on p_partkey = l_partkey where mac is not null group by 1"
    ).fetchall()
    assert sorted(map(tuple, hosted.collect())) == sorted(want) and want
