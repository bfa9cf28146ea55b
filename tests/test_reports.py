"""Reports, rules over texts, amounts and numbers in texts, standings among earlier rows on small cases."""

import csv
import glob
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.operators import events, reports, rules


def test_cells_and_csv(spark, tmp_path):
    rows = [("a, b", "x", 1234.5678)] * 4 + [('q"', "x", 5.0)] * 3 + [("few", "x", 7.0)] * 2 + [(None, None, None)] * 5
    df = spark.createDataFrame(rows, "g string, h string, v double")
    m = [reports.Measure("n", F.count("*")), reports.Measure("mean, of v", F.avg("v"), F.count("v"), 4, 2), reports.Measure("whole", F.avg("v"), F.count("*"), 0, 2)]
    cells = reports.report([reports.section(df, 1, [F.col("g"), F.col("h")], [], m), reports.section(df, 2, [F.col("g")], [F.count("*")], m[:1])])
    got = {(r.section, r.row, r.column): (r.line, r.place, r.value, r.n, r.text) for r in cells.collect()}
    assert got[1, "a, b / x", "mean, of v"] == (2, 2, 1234.57, 4, "1,234.57") and got[1, 'q" / x', "mean, of v"] == (4, 2, None, 3, None)
    assert got[1, "few / x", "n"] == (3, 1, None, 2, None) and got[1, "- / -", "whole"] == (1, 3, None, 5, None) and got[1, 'q" / x', "whole"][4] == "5"
    assert [k for _, k in sorted((v[0], k[1]) for k, v in got.items() if k[0] == 2)] == ["few", 'q"', "a, b", "-"]
    assert {r.section: (r.cells, r.blank) for r in reports.blanks(cells).collect()} == {1: (12, 6), 2: (4, 1)}
    reports.write_csv(cells, str(tmp_path / "out"))
    (file,) = glob.glob(f"{tmp_path}/out/section=1/*.txt")
    assert list(csv.reader(open(file))) == [["row", "n", "mean, of v", "whole"], ["- / -", "5", "", ""], ["a, b / x", "4", "1234.57", "1234.57"], ["few / x", "", "", ""], ['q" / x', "3", "", "5"]]


def test_top_within_top_and_latest(spark):
    rows = [("a", "p")] * 3 + [("a", "q")] * 3 + [("a", "r")] + [("b", "z")] * 7 + [("c", None)] * 9 + [(None, "p")] * 20 + [("d", "p")]
    got = reports.top_within_top(spark.createDataFrame(rows, "g string, p string"), "g", "p", 3, 2, {"most": F.max("p")}).orderBy("place").collect()
    assert [(r.place, r.g, r.n, r.parts, r.most) for r in got] == [(1, "c", 9, None, None), (2, "a", 7, ["p", "q"], "r"), (3, "b", 7, ["z"], "z")]
    m = spark.createDataFrame([("a", 10, 1.0), ("a", 11, None), ("a", 13, 9.0), ("b", 7, 1.0), ("c", 8, 2.0)], "g string, m int, v double")
    assert sorted(map(tuple, reports.latest_point(m, ["g"], "m", "v", 12, 4).collect())) == [("a", 10, 1.0), ("c", 8, 2.0)]


@pytest.mark.parametrize("given, want", [
    ("6조5천470억원 순매수", "6,547,000,000,000원 순매수"), ("가계대출은 1천865조8천억원", "가계대출은 1,865,800,000,000,000원"), ("3개월 만에 12조9천억원 증가", "3개월 만에 12,900,000,000,000원 증가"),
    ("공시가 14억5000만원 주택", "공시가 1,450,000,000원 주택"), ("약 209만원", "약 2,090,000원"), ("2026년 세제개편안", "2026년 세제개편안"), ("분양가의 25%만 먼저 낸다", "분양가의 25%만 먼저 낸다"),
    ("8월 둘째주", "8월 둘째주"), ("순매수 1, 2위", "순매수 1, 2위"), ("3억 5000", "300,000,000 5000"), ("2백5만과 3십만", "2,050,000과 300,000"), ("1.5만", "15,000"), ("", ""), (None, None), ("억", "억")])
def test_amounts_in_text(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(text.normalised_amounts(F.col("t"))).first()[0] == want


def test_unverified_numbers(spark):
    df = spark.createDataFrame([("3.5% and 1,200 of 7", "1,200 x 17"), (None, "1"), ("12", None), ("no", "no")], "s string, t string")
    assert [r[0] for r in df.select(text.unverified_numbers(F.col("s"), F.col("t"))).collect()] == [["3.5"], [], ["12"], []]


def test_rules_in_order(spark):
    own = [rules.Rule("first", "신고가", signal="아파트", without="주식", title_without=r"\d%"), rules.Rule("second", "해제", scoped=False), rules.Rule("third", "입주")]
    names = ["강남", "노원"]
    rows = [(1, "t", "강남 아파트 신고가 해제 입주"), (2, "5%", "강남 아파트 신고가 해제"), (3, "t", "강남 노원 아파트 신고가 서울"), (4, "t", "강남 노원 아파트 신고가"), (5, "t", "부산 강남 아파트 신고가 입주 해제"), (6, None, "강남 아파트 신고가 주식"), (7, "t", None), (8, None, "노원 아파트 신고가")]
    df = spark.createDataFrame(rows, "id int, title string, text string")
    got = df.withColumn("hits", rules.hits(F.col("title"), F.col("text"), own, rules.scope(F.col("text"), names, "서울", "부산")))
    hits = {r.id: [tuple(h) for h in r.hits] for r in got.collect()}
    assert hits == {1: [("first", "강남"), ("second", None)], 2: [("second", None)], 3: [("first", "서울")], 4: [], 5: [("second", None)], 6: [], 7: [], 8: [("first", "노원")]}
    answers = spark.createDataFrame([("first", "강남", 9), ("first", "서울", None), ("second", None, 4)], "rule string, scope string, value int")
    assert sorted((r.id, r.rule, r.value) for r in rules.answered(got.select("id", "hits"), "hits", answers).collect()) == [(1, "first", 9), (1, "second", 4), (2, "second", 4), (5, "second", 4)]
    (r,) = rules.hit_rates(got.withColumn("g", F.lit(1)), ["g"], "hits", "title").collect()
    assert (r.texts, r.hit, r.rate, r.titles, r.titles_hit) == (8, 5, 63, 2, 2)
    assert {r.rule: (r.texts, r.titles) for r in rules.by_rule(got, "hits", "title").collect()} == {"first": (3, 1), "second": (3, 2)}


def test_standing_among_earlier(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 30), rng.choice([None, *range(9)])) for _ in range(300)] + [("one", 1, 5)] + [("a", 3, 3)] * 2
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, c string, d int, v int").repartition(4)
    got = {r.id: (r.n, r.lower, r.equal) for r in events.standing_among_earlier(df, ["c"], "d", "v").collect()}
    for k, (c, d, v) in enumerate(rows):
        before = [x[2] for x in rows if x[0] == c and x[1] < d and x[2] is not None]
        assert got[k] == ((None,) * 3 if v is None else (len(before), sum(x < v for x in before), sum(x == v for x in before)))


def test_nested_cells_in_a_band(spark):
    rows = [("g", {"a": {1: (3, 5.0), 2: (9, 7.0)}, "b": {1: (3, 4.0), 3: None}, "c": {}}), ("h", {}), (None, {"z": {1: (1, 4.0)}})]
    df = spark.createDataFrame(rows, "g string, m map<string,map<int,struct<n:int,middle:double>>>")
    got = reports.in_band(df, "g", "m", ["name", "size"], 4.0, 7.0).collect()
    assert sorted(map(tuple, got), key=repr) == [("g", "a", 1, 3, 5.0, 2), ("g", "b", 1, 3, 4.0, 1), (None, "z", 1, 1, 4.0, 1)]


def test_terms_are_parsed_once_a_text(spark):
    """lease_expiry counts leases by the text of their term first: no row's term is parsed, by filters neither."""
    from ledgerline.plans.products import lease_expiry

    lines = lease_expiry(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    counted = max(k for k, line in enumerate(lines) if "Aggregate" in line)  # rows flow upward, so this is the first count
    assert any("(~.*)" in line for line in lines[:counted + 1]) and not any("(~.*)" in line for line in lines[counted + 1:])
