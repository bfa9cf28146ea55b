"""How standing_among_earlier() deals its rows: by their number, whatever adaptive execution would join."""

import re

from ledgerline.operators import events


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(events, "TASK_ROWS", 50)
    df = spark.createDataFrame([(i, i % 20, i % 7, i % 5) for i in range(501)], "id int, c int, d int, v int")
    got = events.standing_among_earlier(df, ["c"], "d", "v")
    assert re.search(r"RepartitionByExpression \[c#\d+\], 11\b", got._jdf.queryExecution().optimizedPlan().toString())
    rows = [(i % 20, i % 7, i % 5) for i in range(501)]
    for r in got.collect():
        before = [v for c, d, v in rows if c == r.c and d < r.d]
        assert (r.n, r.lower, r.equal) == (len(before), sum(v < r.v for v in before), before.count(r.v))
