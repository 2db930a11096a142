"""The list of the query names reported pages of any host, not spam hosts alone."""

import hashlib

import duckdb

from pulsegrid.llm import registry
from tests.llm.test_url_filter import plain

PATH = "/root/testdata/sf0.1"


def test_reported_pages_are_listed_and_blocked(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{PATH}/pages.parquet").select("page_id", "url").collect()]
    reported = {i for i, u in pages if plain(u) and hashlib.md5(plain(u).encode()).hexdigest()[0] == "0"}
    got = registry.op2_url_filter(spark, PATH).collect()
    listed = {r.page_id for r in got if r.rule is None and r.verdict == "block"}
    assert {r.page_id for r in got if r.rule is None} & reported <= listed
    assert len(listed & reported) > 50
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{PATH}/pages.parquet'")
    assert sorted(map(tuple, got), key=repr) == sorted(con.sql(registry.OP2_SQL).fetchall(), key=repr)
