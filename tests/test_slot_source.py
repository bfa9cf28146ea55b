"""The slot source: states, pruning, commits, first-seen days, plans."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

from ledgerline.sources import slot_source as slots

ROWS = "kind string, district string, yearMonth string, item map<string,string>"


def rows_of(spark, n=200, changed=()):
    rows = [("sale" if k % 2 else "rent", str(11110 + k % 5), f"20240{1 + k % 4}", {"id": str(k), "cdealType": "O" if k % 7 == 0 else "", "price": "2" if k in changed else "1"}) for k in range(n)]
    return spark.createDataFrame(rows, ROWS)


@pytest.fixture
def root(spark, tmp_path):
    slots.write_slots(rows_of(spark).repartition(7), str(tmp_path), "2024-05-01T00:00:00")
    return str(tmp_path)


def items(spark, root):
    return sorted((r.kind, r.district, r.yearMonth, sorted(r.item.items())) for r in slots.read_items(spark, root).collect())


def test_round_trip_and_counts(spark, root):
    want = sorted((r.kind, r.district, r.yearMonth, sorted(r.item.items())) for r in rows_of(spark).collect())
    assert items(spark, root) == want
    got = {(r.kind, r.district, r.yearMonth): (r.state, r["count"], r.cancelled) for r in slots.read_catalogue(spark, root).collect()}
    for key in {w[:3] for w in want}:
        own = [dict(w[3]) for w in want if w[:3] == key]
        assert got.pop(key) == ("ok", len(own), sum(x["cdealType"] == "O" for x in own))
    assert not got


def test_filters_prune_files(spark, root):
    reader = slots.SlotReader({"path": root, "partitionbytes": "1"})
    rest = list(reader.pushFilters([EqualTo(("kind",), "sale"), GreaterThanOrEqual(("yearMonth",), "202403"), In(("district",), ("11110", "11111")), EqualTo(("state",), "ok")]))
    assert [f.attribute for f in rest] == [("state",)]
    planned = [f for p in reader.partitions() for f in p.files]
    assert len(reader.partitions()) == len(planned) > 0
    assert all(k == "sale" and d in ("11110", "11111") and m >= "202403" for k, d, m, _ in planned)
    whole = slots.SlotReader({"path": root})
    assert [f[:3] for f in planned] == [f[:3] for p in whole.partitions() for f in p.files if f[0] == "sale" and f[1] in ("11110", "11111") and f[2] >= "202403"]
    df = slots.read_items(spark, root).where("kind = 'sale' AND yearMonth >= '202403' AND district IN ('11110', '11111')")
    assert "PushedFilters: [EqualTo(kind,sale)" in df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert df.count() == rows_of(spark).where("kind = 'sale' AND yearMonth >= '202403' AND district IN ('11110', '11111')").count()


def test_order_of_slots(spark, root):
    order = [f[:3] for p in slots.SlotReader({"path": root}).partitions() for f in p.files]
    assert order == sorted(order, key=lambda x: (-int(x[2]), x[1], x[0]))


def test_broken_failed_and_partial_files(spark, root):
    for name, text in (("sale/11110-202312.json", "{no json"), ("sale/11111-202312.json", ""), ("rent/11110-202312.json", json.dumps({"ok": False, "count": 0, "totalCount": 0, "items": []})),
                       ("rent/11111-202312.json", json.dumps({"ok": True, "count": 1, "totalCount": 3, "items": [{"a": 1.50, "b": None, "c": [1]}]})), ("rent/notes.txt", "x"), ("rent/11112-2023.json", "{}")):
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    got = {(r.kind, r.district): r.state for r in slots.read_catalogue(spark, root).where("yearMonth = '202312'").collect()}
    assert got == {("sale", "11110"): "broken", ("sale", "11111"): "broken", ("rent", "11110"): "failed", ("rent", "11111"): "partial"}
    seen = slots.read_items(spark, root).where("yearMonth = '202312'").collect()
    assert sorted((r.state, r.item) for r in seen if r.state != "partial") == [("broken", None)] * 2
    assert [r.item for r in seen if r.state == "partial"] == [{"a": "1.5", "b": None, "c": '["1"]'}]


def test_only_changed_slots_are_written(spark, root):
    files = {f: os.stat(f"{root}/{f}").st_mtime_ns for k in ("sale", "rent") for f in [f"{k}/{n}" for n in os.listdir(f"{root}/{k}")]}
    slots.write_slots(rows_of(spark, changed={3, 8}), root, "2024-06-01T00:00:00")
    changed = {f for f, at in files.items() if os.stat(f"{root}/{f}").st_mtime_ns != at}
    assert changed == {"sale/11113-202404.json", "rent/11113-202401.json"}
    got = [r for r in slots.read_items(spark, root).collect() if r.arrived]
    assert sorted((r.item["id"], r.arrived) for r in got) == [("3", "2024-06-01"), ("8", "2024-06-01")]
    # seen rows keep their day, and a row that goes and comes back is new again only while its slot forgot it
    slots.write_slots(rows_of(spark, changed={3, 8, 23}), root, "2024-07-01T00:00:00")
    days = {r.item["id"]: r.arrived for r in slots.read_items(spark, root).collect() if r.arrived}
    assert days == {"3": "2024-06-01", "8": "2024-06-01", "23": "2024-07-01"}


def test_lost_and_repeated_attempts_leave_no_slot_twice(spark, tmp_path):
    rows = [r.asDict() for r in rows_of(spark).orderBy("kind", "district", "yearMonth").collect()]
    writer = slots.SlotWriter({"path": str(tmp_path), "observedat": "2024-05-01"})
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    assert slots.read_items(spark, str(tmp_path)).count() == 0  # nothing counts before the commit
    writer.commit([kept])
    assert len(items(spark, str(tmp_path))) == 200
    writer.abort([lost])
    assert len(items(spark, str(tmp_path))) == 200 and not [f for _, _, names in os.walk(f"{tmp_path}/_attempts") for f in names]
    a, b = writer.write(iter(dict(r, item={"id": "new"}) for r in rows[:3])), writer.write(iter(dict(r, item={"id": "other"}) for r in rows[:3]))
    with pytest.raises(ValueError, match="more than one task"):
        writer.commit([a, b])
    assert len(items(spark, str(tmp_path))) == 200


def test_refusals_and_empty(spark, tmp_path):
    with pytest.raises(Exception, match="no slot"):
        slots.write_slots(spark.createDataFrame([("sale", None, "202401", {"a": "b"})], ROWS), str(tmp_path), "2024-05-01")
    slots.write_slots(rows_of(spark).limit(0), f"{tmp_path}/none", "2024-05-01")
    assert slots.read_items(spark, f"{tmp_path}/none").count() == 0 and slots.read_catalogue(spark, f"{tmp_path}/none").count() == 0


def test_plan_and_expiry(spark, root):
    with open(f"{root}/sale/11110-202402.json", "w") as f:
        f.write("?")
    wanted = spark.createDataFrame([("sale", "11110"), ("sale", "11111")], "kind string, district string")
    now = F.lit("2024-04-02").cast("date")
    got = {(r.district, r.yearMonth): r.state for r in slots.plan(slots.read_catalogue(spark, root).where("kind = 'sale'"), wanted, now, 3).collect()}
    have = {tuple(f[:3]) for f in slots.SlotReader({"path": root}).files()}
    for d in ("11110", "11111"):
        for k, m in enumerate(("202404", "202403", "202402")):
            want = "missing" if ("sale", d, m) not in have else "broken" if (d, m) == ("11110", "202402") else "stale"
            assert got[d, m] == want
    late = {(r.district, r.yearMonth): r.state for r in slots.plan(slots.read_catalogue(spark, root).where("kind = 'sale'"), wanted, F.lit("2024-04-20").cast("date"), 3).collect()}
    assert {late["11111", m] for m in ("202402",)} <= {"frozen", "missing"}
    gone = [("sale", d, m) for (d, m), s in got.items() if s == "expired"]
    assert gone and slots.expire(root, gone) == len(gone) and slots.expire(root, gone) == 0


def test_rows_are_encoded_once_and_read_in_batches(spark, tmp_path, monkeypatch):
    """A writer makes each row's line once; a reader gives a slot in bounded batches with the rows' keys."""
    import pyarrow as pa

    items = [{"key": f"{k} \"q\" \\ é\n\x01", "none": None, "b": "x"} for k in range(700)]
    assert [slots.line_of(x) for x in items] == [json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for x in items]
    assert slots.line_of({"b": 1, "a": [None]}) == '{"a":[null],"b":1}'
    made, own = [], slots.line_of
    monkeypatch.setattr(slots, "line_of", lambda x: made.append(1) or own(x))
    kinds = pa.schema([("kind", pa.string()), ("district", pa.string()), ("yearMonth", pa.string()), ("item", pa.map_(pa.string(), pa.string()))])
    batch = pa.RecordBatch.from_pylist([{"kind": "a", "district": "d", "yearMonth": "200001", "item": list(x.items())} for x in items], schema=kinds)
    writer = slots.SlotWriter({"path": str(tmp_path), "observedAt": "2001-01-01T00:00:00"})
    writer.commit([writer.write(iter([batch.slice(0, 300), batch.slice(300)]))])
    assert len(made) == 700
    monkeypatch.setattr(slots, "BATCH_ROWS", 256)
    reader = slots.SlotReader({"path": str(tmp_path)})
    out = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.num_rows for b in out] == [256, 256, 188]
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["ord"] for r in rows] == list(range(700)) and sorted(own(dict(r["item"])) for r in rows) == sorted(map(own, items))
    assert all(r["key"] == slots.key_of(dict(r["item"])) and r["state"] == "ok" and not r["cancelled"] for r in rows)


def test_lines_are_made_by_spark(spark, tmp_path, monkeypatch):
    """write_slots() hands the writer lines instead of maps; they are those of line_of(), whatever the texts."""
    import pyarrow as pa

    signs = "".join(map(chr, (*range(1, 48), 92, 127, 160, 233, 0x2028, 0xFFFF, 0x1F600)))
    items = [{"b": signs, "a": None, "\x1fc\"": ""}, {}, {"z": "\\u001f", "Z": "/", "é": "\\"}, {"k": " {", "a": "\x0b"}, {"a": "1", "B": "2"}, {"a": "1", "B": "2"}]
    rows = spark.createDataFrame([("a", "d", "200001", x) for x in items], ROWS)
    made = [r.line for r in rows.select(slots.line_column(F.col("item")).alias("line")).collect()]
    assert made[1:3] + made[4:] == [slots.line_of(items[k]) for k in (1, 2, 4, 5)]
    used, own = [], slots.line_column
    monkeypatch.setattr(slots, "line_column", lambda item: used.append(item) or own(item))
    slots.write_slots(rows, str(tmp_path), "2001-01-01")
    assert len(used) == 1
    with open(f"{tmp_path}/a/d-200001.json") as f:
        assert f.read().partition('"items":[\n')[2] == ",\n".join(sorted(map(slots.line_of, items))) + "\n]}\n"
    monkeypatch.setattr(slots, "line_of", None)  # the writer takes such lines as they are
    assert slots._lines(pa.record_batch({"line": ['{"a":"b"}', '{"a":null}']})) == ['{"a":"b"}', '{"a":null}']


def test_odd_maps_and_totals(spark, tmp_path):
    """A null map is refused; maps of numbers are written as before; a key twice in a map stands once, with its last value; totals count."""
    with pytest.raises(Exception, match="no item"):
        slots.write_slots(spark.createDataFrame([("a", "d", "200001", {"a": "b"}), ("a", "d", "200001", None)], ROWS), f"{tmp_path}/null", "2001-01-01")
    slots.write_slots(spark.createDataFrame([("a", "d", "200001", {"b": 1, "a": None})], ROWS.replace("map<string,string>", "map<string,int>")), f"{tmp_path}/int", "2001-01-01")
    with open(f"{tmp_path}/int/a/d-200001.json") as f:
        assert '"items":[\n{"a":null,"b":1}\n]' in f.read()
    twice = spark.sql("SELECT 'a' kind, 'd' district, '200001' yearMonth, from_json('{\"b\":\"2\",\"a\":\"1\",\"b\":\"1\"}', 'map<string,string>') item, 3L totalCount")
    assert twice.selectExpr("size(item)").first()[0] == 3
    slots.write_slots(twice, f"{tmp_path}/twice", "2001-01-01")
    got = slots.read_items(spark, f"{tmp_path}/twice").collect()
    assert [(r.item, r.state, r.key) for r in got] == [({"a": "1", "b": "1"}, "partial", slots.key_of({"a": "1", "b": "1"}))]


def test_reader_makes_the_columns_asked_for(spark, root, monkeypatch):
    """Batches go on over slots, broken ones among them; other columns are not made, and those made are the same."""
    with open(f"{root}/sale/11111-202402.json", "w") as f:
        f.write("{no json")
    slots.write_slots(rows_of(spark, changed={3, 9}), root, "2024-06-01T00:00:00")
    with open(f"{root}/rent/11111-202401.json", "w") as f:
        f.write("{no json")
    reader = slots.SlotReader({"path": root})
    whole = [r for p in reader.partitions() for f in p.files for b in reader.read(slots.SlotFiles([f])) for r in b.to_pylist()]
    assert [r for r in whole if r["state"] == "broken"] == [{c: {"kind": "rent", "district": "11111", "yearMonth": "202401", "state": "broken"}.get(c) for c in whole[0]}]
    assert {r["arrived"] for r in whole} == {None, "2024-06-01"} and {r["cancelled"] for r in whole} == {None, True, False}
    monkeypatch.setattr(slots, "BATCH_ROWS", 64)
    for columns in [*([c] for c in whole[0]), list(whole[0])[::-1]]:
        reader = slots.SlotReader({"path": root}, columns)
        with monkeypatch.context() as m:
            if not {"key", "arrived"} & {*columns}:
                m.setattr(slots, "key_of", None)
            out = [b for p in reader.partitions() for b in reader.read(p)]
        assert [b.num_rows for b in out] == [64] * (len(whole) // 64) + [len(whole) % 64]
        assert [r for b in out for r in b.to_pylist()] == [{c: r[c] for c in columns} for r in whole]
    assert slots.read_items(spark, root, ("ord", "item")).columns == ["ord", "item"] and slots.read_items(spark, root).columns == list(whole[0])
    assert slots.read_items(spark, root, ("yearMonth", "item")).where("yearMonth = '202403'").count() == sum(r["yearMonth"] == "202403" for r in whole)


def test_catalogue_makes_the_columns_asked_for(spark, root, monkeypatch):
    """A batch has the rows of many slots; rows are looked through for cancelled ones only if that is asked."""
    odd = [{"ok": True, "count": 4, "totalCount": 4, "items": [{"cdealType": False}, {"cdealDay": 1}, {"cdealType": [" "], "b": {"c": 1}}, {"cdealDay": " ", "cdealType": None}]}, {"ok": True, "count": 0, "totalCount": 0, "items": []},
           {"ok": True, "count": 1, "totalCount": 1, "items": [["a"]]}, {"ok": True, "count": 1, "totalCount": 1, "items": ["a"]}, {"ok": True, "count": 1, "totalCount": 1, "items": None}, {"count": 1, "totalCount": "x", "items": []}, []]
    for k, x in enumerate(odd):
        with open(f"{root}/rent/1000{k}-202401.json", "w") as f:
            json.dump(x, f)
    reader = slots.SlotReader({"path": root, "what": "slots"})
    whole = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    of = {r["district"]: (r["state"], r["count"], r["cancelled"]) for r in whole if r["district"] < "1001"}
    assert of == {"10000": ("ok", 4, 3), "10001": ("ok", 0, 0)} | {f"1000{k}": ("broken", None, None) for k in range(2, 7)}
    items = [r.item for r in slots.read_items(spark, root).where("district = '10000'").orderBy("ord").collect()]
    assert items == [{"cdealType": "false"}, {"cdealDay": "1"}, {"cdealType": '[" "]', "b": '{"c": "1"}'}, {"cdealDay": " ", "cdealType": None}]
    monkeypatch.setattr(slots, "BATCH_ROWS", 8)
    monkeypatch.setattr(slots, "is_cancelled", None)
    for columns in (["kind", "district", "yearMonth", "state"], ["totalCount"], ["observedAt", "count"]):
        reader = slots.SlotReader({"path": root, "what": "slots"}, columns)
        out = [b for p in reader.partitions() for b in reader.read(p)]
        assert [b.num_rows for b in out] == [8] * (len(whole) // 8) + [len(whole) % 8] * (len(whole) % 8 > 0)
        assert [r for b in out for r in b.to_pylist()] == [{c: r[c] for c in columns} for r in whole]
    assert slots.read_catalogue(spark, root, ("state", "district")).columns == ["district", "state"] and slots.read_catalogue(spark, root).columns == list(whole[0])
