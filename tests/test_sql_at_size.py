"""SQL over so many sessions that an engine's windows and groups span its blocks: shifted copies of the events must give shifted copies of the rows."""

import duckdb
import pytest

from loomlake.jobs import registry

ROWS, STEP = 6_000_000, 1_000_000


@pytest.mark.parametrize("name", ["e5_p5_copilot_round_trip", "e6_p6_vibe_round_trip"])
def test_copies_of_sessions_have_equal_rows(name, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE TABLE one AS SELECT * FROM '{sf_dir}/events.parquet'")
    copies = ROWS // c.sql("SELECT count(*) FROM one").fetchall()[0][0]
    c.execute(f"CREATE TABLE events AS SELECT * REPLACE (event_id + i * {STEP} AS event_id, user_id + i * {STEP} AS user_id) FROM one, range({copies}) AS r(i)")
    c.execute(f"CREATE TABLE found AS {registry.ORACLE_SQL[name]}")
    back = f"list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: CAST(x AS BIGINT) % {STEP})"
    n, distinct = c.sql(f"SELECT count(*), count(DISTINCT hash(CAST(session_key AS BIGINT) % {STEP}, pos, kind, role, {back}, tool_name, image_url, is_error)) FROM found").fetchall()[0]
    assert n == copies * distinct
