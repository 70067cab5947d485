"""Term boundaries beside characters off ASCII: query and SQL follow one rule."""

import duckdb

from matloom.llm import url_filter
from matloom.llm.queries import ORACLES

URLS = [
    "http://é.com/épillsé", "http://x.org/пwinп-free", "http://x.org/epillse", "http://x.org/9spam", "http://x.org/spam", "http://x.org/SPAMé",
    "http://x.org/win-win", "http://x.org/win_free", "http://xn--win.org/free", "", None, "pills", "http://ж.net/", "中spam中",
]


def test_terms_end_at_all_but_ascii_letters_and_digits(spark):
    rows = list(enumerate(URLS))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(tuple(r) for r in url_filter.judge(pages).select("page_id", "verdict", "n_strict", "n_soft").collect())
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert got == sorted(db.sql(ORACLES["op9_url_filter"]).select("page_id", "verdict", "n_strict", "n_soft").fetchall())
    assert [r[2] for r in got[:5]] == [1, 0, 0, 0, 1]
