"""Names in texts, tiers of matching, gapless numbers: against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import entities, lookup, matching, ranks


def brute_mentions(text, names):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text, own = (text or "").translate(low), {}
    for e, n in names:
        if n and e is not None:
            n = n.translate(low)
            own[n] = min(e, own.get(n, e))
    at, out = 0, []
    while at < len(text):
        best = max((n for n in own if text.startswith(n, at)), key=len, default=None)
        if best:
            out.append((at, at + len(best), own[best]))
        at += len(best) if best else 1
    return out


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 8])
def test_mentions_with_overlapping_names(spark, chunk_bytes):
    rng = random.Random(chunk_bytes)
    names = [(1, "ab"), (2, "abc"), (3, "bcd"), (4, "AB"), (5, ""), (6, None), (None, "zz"), (7, "가구"), (8, "🙂a"), (9, "b"), (9, "cda"), (10, "cd a")]
    texts = [None, "", "abcd", "xABCDab", "가구가", "🙂abcd", "zz"] + ["".join(rng.choice("abcd 가구🙂") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(k % 50, x, "mine") for k, x in enumerate(texts)], "id long, text string, mentions string").withColumn("entity", F.lit("mine"))
    table = spark.createDataFrame(names, "entity long, name string")
    got = entities.mentions(docs, table, out_col="found", chunk_bytes=chunk_bytes).collect()
    want = sorted((k % 50, x, brute_mentions(x, names)) for k, x in enumerate(texts) if x is not None)
    assert sorted((r.id, r.text, [tuple(m) for m in r.found]) for r in got if r.text is not None) == want
    assert len(got) == len(texts) and all(r.mentions == r.entity == "mine" for r in got) and [r.found for r in got if r.text is None] == [[]]
    assert entities.mentions(docs, table.limit(0)).where(F.size("mentions") > 0).count() == 0
    assert entities.mentions(docs.limit(0), table).count() == 0


def test_short_forms_and_scope(spark):
    table = spark.createDataFrame([(1, "강남구"), (2, "중구"), (3, "부산")], "entity long, name string")
    forms = entities.with_short_forms(table, "entity", "name", "구")
    assert sorted((r.entity, r.name) for r in forms.collect()) == [(1, "강남"), (1, "강남구"), (2, "중구"), (3, "부산")]
    texts = ["강남 강남구 아파트", "강남과 중구", "부산", "중구", "없음"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = entities.mentions(docs, forms).select("id", entities.scope(F.col("mentions"), F.array(F.lit(3).cast("long"))).alias("about")).collect()
    assert {r.id: r.about for r in got} == {0: 1, 1: None, 2: None, 3: 2, 4: None}


def plain_match(left, right, tiers):
    out, left, right = {}, dict(left), dict(right)
    for t in tiers:
        blocks = {}
        for side, rows in enumerate((left, right)):
            for i in sorted(rows):
                key = tuple(rows[i][k] for k in t.keys)
                if all(v is not None and str(v).strip() for v in key):
                    blocks.setdefault(key, ([], []))[side].append(i)
        for a, b in blocks.values():
            if not t.only or len(a) == len(b) == 1:
                for x, y in zip(a, b):
                    out[x] = (y, t.name)
                    del left[x], right[y]
    return out


def test_match_in_tiers(spark):
    rng = random.Random(2)
    pick = lambda: {"g": rng.choice(["a", "a", "a", "b", None]), "lot": rng.choice(["1", "2", " ", None]), "name": rng.choice("pqrstu")}
    left, right = {k: pick() for k in range(300)}, {1000 + k: pick() for k in range(250)}
    tiers = [matching.Tier("all", ("g", "lot", "name")), matching.Tier("lot", ("g", "lot")), matching.Tier("once", ("lot", "name"), only=True), matching.Tier("name", ("name",))]
    frame = lambda rows, i: spark.createDataFrame([(k, v["g"], v["lot"], v["name"]) for k, v in rows.items()], f"{i} long, g string, lot string, name string").repartition(5)
    a, b = frame(left, "l"), frame(right, "r")
    pairs = matching.match(a, b, "l", "r", tiers)
    want = plain_match(left, right, tiers)
    assert {r.l: (r.r, r.tier) for r in pairs.collect()} == want and pairs.count() == len(want)
    rates = {r.tier: r.rows for r in matching.match_rates(a, pairs, "l", tiers).collect()}
    assert sum(rates.values()) == 300 and all(n == sum(t == tier for _, t in want.values()) for tier, n in rates.items() if tier != "none")
    assert matching.match(a.limit(0), b, "l", "r", tiers).count() == 0


def test_gapless_equals_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["x", None]), rng.choice([None, *range(50)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(7)
    order = [F.desc_nulls_last("v"), F.col("id")]
    whole = ranks.gapless(ranks.gapless(df, [], order, "all"), ["g"], order, "within").collect()
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2])
    assert [r.id for r in sorted(whole, key=lambda r: r.all)] == [r[2] for r in sorted(rows, key=key)] and sorted(r.all for r in whole) == list(range(1, 3001))
    for g in ("hot", "x", None):
        own = sorted((r for r in whole if r.g == g), key=lambda r: r.within)
        assert [r.within for r in own] == list(range(1, len(own) + 1)) and [r.id for r in own] == [r[2] for r in sorted((r for r in rows if r[0] == g), key=key)]
    assert ranks.gapless(df.limit(0), ["g"], order).count() == 0


def test_seeded_ranks_resume(spark):
    df = spark.range(20_000).select((F.col("id") * 7).alias("id")).repartition(5)
    got = ranks.seeded_ranks(df, ["id"], 3)
    rows = {r.id: r["rank"] for r in got.collect()}
    assert sorted(rows.values()) == list(range(1, 20_001))
    assert {r.id: r["rank"] for r in ranks.seeded_ranks(df.repartition(2), ["id"], 3).collect()} == rows != {r.id: r["rank"] for r in ranks.seeded_ranks(df, ["id"], 4).collect()}
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64(F.lit(3), "id").alias("h")).collect()}
    assert sorted(rows, key=rows.get) == sorted(hashes, key=lambda i: (hashes[i], i))
    parts = [ranks.rank_range(df, ["id"], 3, a, 700) for a in (1, 701)]
    assert [sorted(r["rank"] for r in p.collect()) for p in parts] == [list(range(1, 701)), list(range(701, 1401))]
    assert ranks.seeded_ranks(df.limit(0), ["id"], 3).count() == 0


def test_nearest_others_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "a", "b", None]), rng.randint(0, 8), rng.choice([None, 1.0, 2.0, 2.5, float(rng.randint(0, 30))])) for k in range(250)] + [(900, "lone", 3, 1.0)]
    got = {}
    for r in lookup.nearest_k(spark.createDataFrame(rows, "id int, g string, s int, v double").repartition(4), ["g"], "s", 2, "v", "id", 3).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    whole = [r for r in rows if None not in r]
    for k, g, s, v in whole:
        want = sorted((abs(v - w), j) for j, h, u, w in whole if j != k and h == g and abs(u - s) <= 2)[:3]
        assert [j for _, j in sorted(got.get(k, []))] == [j for _, j in want]
    assert got.keys() <= {r[0] for r in whole}


def test_nearest_k_joins_no_numbers(spark):
    """A list is carried along its values: a row per item and list, and no join of k + 1 rows for each."""
    rows = spark.range(50).select("id", F.lit("a").alias("g"), F.lit(1).alias("s"), (F.col("id") % 7).cast("double").alias("v"))
    got = lookup.nearest_k(rows, ["g"], "s", 1, "v", "id", 3)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.other for r in got.where("id = 0").orderBy("rank").collect()] == [7, 14, 21]
