"""Every query against its SQL twin on the smallest tables."""

import pytest
from tests.oracle import DATA, connected, difference
from textguard.plans.oracles import ORACLES as SCANNER_SQL
from textguard.plans.queries import QUERIES as SCANNER
from textguard.plans.service import QUERIES as SERVICE
from textguard.plans.service_sql import ORACLES as SERVICE_SQL

QUERIES, ORACLES = SCANNER | SERVICE, SCANNER_SQL | SERVICE_SQL


@pytest.fixture(scope="module")
def con():
    return connected()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLES[name]) == ""


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"rate_limit", "safe_replace", "payload_ids", "semantic_narrow", "semantic_scan", "word_pieces"}


def test_rate_limit_against_a_loop(spark):
    rows = QUERIES["rate_limit"](spark, DATA).collect()
    log, expected = {}, {}
    for r in sorted(rows, key=lambda r: r["at_ms"]):
        own = log[r["client"]] = [t for t in log.get(r["client"], []) if r["at_ms"] - t < 3_600_000]
        expected[r["event_id"]] = len(own) < 3
        if len(own) < 3:
            own.append(r["at_ms"])
    assert {r["event_id"]: r["accepted"] for r in rows} == expected
