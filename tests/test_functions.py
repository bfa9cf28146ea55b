from datetime import date

from pyspark.sql import functions as F

from ledgerline.functions import dates, finance, numbers, stats, text


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_numbers(spark):
    assert one(spark, numbers.money(F.lit("275,000")), numbers.money(F.lit(" ")), numbers.money(F.lit("x")), numbers.money(F.lit(" "), None)) == (275000, 0, None, None)
    assert one(spark, numbers.half_up(F.lit(-2.5)), numbers.half_up(F.lit(2.5)), numbers.half_up(F.lit(1.25), 1)) == (-2, 3, 1.3)
    assert one(spark, numbers.short_date(F.lit("26.08.18")), numbers.short_date(F.lit("26.02.31")), numbers.short_date(F.lit(""))) == (date(2026, 8, 18), None, None)
    assert one(spark, numbers.rolled_date(F.lit(2026), F.lit(2), F.lit(31))) == (date(2026, 3, 3),)
    assert one(spark, numbers.band_floor(F.lit(34999), 10000, 30000, 300000), numbers.band_floor(F.lit(10), 10000, 30000, 300000), numbers.band_floor(F.lit(900000), 10000, 30000, 300000)) == (30000, 0, 300000)
    assert one(spark, numbers.band(F.lit(10), [10, 20]), numbers.band(F.lit(10), [10, 20], "right")) == (1, 0)


def test_dates(spark):
    terms = [dates.expiry_month(F.lit(x)) for x in ("25.02~27.02", "~27.03", "27.02~27.02", "27.13~28.13")]
    assert one(spark, *terms) == (202702, 202703, None, None)
    now = F.to_date(F.lit("2026-08-26"))
    assert one(spark, dates.month_closed(F.to_date(F.lit("2026-07-05")), now), dates.month_closed(F.to_date(F.lit("2026-06-05")), now)) == (False, True)
    assert one(spark, dates.shift_month(F.lit(202601), -1), dates.shift_month(F.lit(202612), 1)) == (202512, 202701)
    assert one(spark, dates.week_start(F.to_date(F.lit("2026-11-29")))) == (date(2026, 11, 23),)
    assert one(spark, dates.half_year(F.lit(2026), F.lit(0))) == ("2026?",)


def test_text(spark):
    assert one(spark, text.strip_tags(F.lit("<p>a &amp;lt; b</p><script>x</script>  c"))) == ("a &lt; b c",)
    assert one(spark, text.dedup_form(F.lit("[A] Big (x) News!"))) == ("bignews",)
    assert one(spark, text.dice(text.bigrams(F.lit("night")), text.bigrams(F.lit("nacht")))) == (0.25,)
    assert one(spark, text.lot_number(F.lit("0012-0003")), text.lot_number(F.lit("12-0")), text.lot_number(F.lit("x"))) == ("12-3", "12", None)
    assert one(spark, text.final_consonant(F.lit("강")), text.final_consonant(F.lit("나")), text.final_consonant(F.lit("a"))) == (True, False, None)
    assert one(spark, text.eok(F.lit("3.5억")), text.eok(F.lit("3억 5,000")), text.eok(F.lit("x"))) == (35000.0, 35000.0, None)


def test_finance(spark):
    lit = F.lit
    assert one(spark, finance.conversion_rate(lit(50000), lit(20000), lit(125))) == (5.0,)
    cost = finance.monthly_cost
    assert round(one(spark, cost(lit(20000), lit(0), lit(30000), lit(4.0), lit(3.8)))[0], 1) == -26.8
    assert one(spark, cost(lit(50000), lit(0), lit(20000), lit(4.0), lit(3.8))) == (100.0,)
    assert one(spark, cost(lit(20000), lit(125), lit(20000), lit(4.0), lit(3.8)) - cost(lit(50000), lit(0), lit(20000), lit(4.0), lit(3.8))) == (25.0,)


def test_stats(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")
    assert df.agg(F.median("x"), stats.quantile_disc("x", 0.5), stats.median_whole(F.col("x"))).first() == (2.5, 2, 3)
    assert stats.quantile_floor(df, [], "x", {"lo": 0.5, "all": 1.0}).first()["lo"] == 3
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert one(spark, low, high) == (None, None)
    a, b = stats.newcombe(F.lit(8), F.lit(10), F.lit(2), F.lit(10))
    low, high = one(spark, a, b)
    assert 0 < low < 0.6 < high < 1


def test_contract_rows_compute_each_text_once(spark):
    """The planner repeats no raw text in filters and later columns: each stands once in the plan."""
    from ledgerline.functions import contracts
    from ledgerline.plans.contracts import raw_rows

    raw = raw_rows(spark, "/root/testdata/sf0.001")
    for rows, amount in ((contracts.sale_rows(raw), "amount10k"), (contracts.rent_rows(raw), "deposit10k"), (contracts.market_rows(raw), "amount10k")):
        plan = rows.select("apt", "sqm", "date", "floor", "built", amount)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("n/a") == 1, plan
