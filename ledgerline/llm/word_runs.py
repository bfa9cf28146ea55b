"""Periodic runs of words: maximal stretches that repeat with a smallest period, found in linear time.

A text's words become ranks of their sorted order. For both orders, the given one and its reverse, one pass from left to
right finds every suffix's next smaller suffix, that is the longest Lyndon word that begins there, together with how far the
two suffixes agree. No suffix structure and no hash of words is used: suffixes are compared word by word, and

* a suffix is compared along the chain of its previous smaller suffixes; how far two chain members agree says, without looking at
  words, how the next one compares, unless it agrees exactly as far as the last one, where matching goes on;
* the furthest match (a, b) up to word `reach` is kept: what lies in [b, reach) is a copy of what began at a, so its chain and
  agreements are those of the copy, up to the first that meets `reach`, where matching goes on.

Matching thus only ever moves `reach` to the right, and all else is a pop from a chain: linear time. A run of period q and length of
at least 3 q holds, for one of the two orders, Lyndon words of length q at least twice; the agreement of the first of them gives
its end, and fewer than q words to its left its start.

Words that a text holds less often than the least exponent lie in no run and part the text before the passes.

Cases: null and empty texts have no words and no runs; a text of one word repeated is one run of period 1; words that differ in
case differ; very long texts take memory in proportion; repeated rows have their runs each; columns beside the text
pass through, except ones named like the new ones, which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table, utf8

MIN_LENGTH, MIN_EXPONENT = 24, 3
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def next_smaller(x: list[int]) -> tuple[list[int], list[int]]:
    """(the next smaller suffix of each suffix, how many places the two agree); no smaller one is len(x), agreeing in none."""
    n = len(x)
    nxt, agree = [n] * n, [0] * n
    before, shared = [-1] * n, [0] * n  # the previous smaller suffix, and how many places it agrees
    a = b = reach = 0  # x[a:a + reach - b] == x[b:reach], a < b
    for i in range(1, n):
        j, known = i - 1, 0
        if i < reach:
            period = b - a
            twin = a + (i - b) % period or a
            if twin == a:
                twin = b  # i begins a further period: what was popped at b is popped here
            shift, left = i - twin, reach - i
            met = False
            while True:
                copy = j - shift
                known = agree[copy] if nxt[copy] == twin else shared[twin] if copy == before[twin] else left
                if known >= left:
                    met = True
                    break
                if nxt[copy] != twin:
                    break  # the copy stopped here as well
                nxt[j], agree[j] = i, known
                j = before[j]
            if not met:
                before[i], shared[i] = j, known
                continue
            known = left
        # the suffixes at j and i agree in at least `known` places, and i + known == reach or is not reached yet
        while True:
            at = i + known
            k = j + known
            while at < n and x[k] == x[at]:
                k += 1
                at += 1
            known = at - i
            if at >= reach:
                a, b, reach = j, i, at
            if at < n and x[k] < x[at]:
                break
            # suffix j is larger: along the chain as far as agreements decide
            nxt[j], agree[j] = i, known
            up = before[j]
            while up >= 0 and shared[j] > known:
                j = up
                nxt[j], agree[j] = i, known
                up = before[j]
            if up < 0:
                j, known = -1, 0
                break
            if shared[j] < known:
                j, known = up, shared[j]
                break
            j = up
        before[i], shared[i] = j, known
    return nxt, agree


def _stretches(code: np.ndarray, least: int, length: int) -> list[tuple[int, int]]:
    """Maximal [from, to) of at least `length` places, each value of which occurs `least` times within; exact: others hold no run."""
    todo, out = [(0, len(code))], []
    while todo:
        a, b = todo.pop()
        if b - a < length:
            continue
        _, inverse, counts = np.unique(code[a:b], return_inverse=True, return_counts=True)
        often = counts[inverse] >= least
        if often.all():
            out.append((a, b))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], often.astype(np.int8), [0]))))
        todo += [(a + int(p), a + int(q)) for p, q in zip(edge[::2], edge[1::2])]
    return sorted(out)


def runs_of(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of words, by start and then period; min_exponent is 3 at least."""
    if min_exponent < 3:
        raise ValueError("runs below three periods need not hold two Lyndon words of one order")
    if len(words) < max(min_length, min_exponent):
        return []
    code = np.unique(np.array(words, dtype=object), return_inverse=True)[1]
    found: set[tuple[int, int, int]] = set()
    for a, b in _stretches(code, min_exponent, max(min_length, min_exponent)):
        part = code[a:b]
        for ordered in (part, part.max() - part):
            nxt, agree = (np.array(v) for v in next_smaller(ordered.tolist()))
            at = np.arange(len(part))
            period = nxt - at
            # from the first of the Lyndon words, at most period - 1 words lie before it
            could = np.flatnonzero((agree > period) & (2 * period + agree > min_length))
            seen: set[tuple[int, int]] = set()
            for k in could.tolist():
                q, end = int(period[k]), int(nxt[k] + agree[k])
                if (end, q) in seen:
                    continue
                seen.add((end, q))
                start = k
                while start and part[start - 1] == part[start - 1 + q]:
                    start -= 1
                if end - start >= max(min_length, min_exponent * q):
                    found.add((a + start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, [s + q for s, _, q in runs], 1)
    np.add.at(change, [s + n for s, n, _ in runs], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact exponent; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, collapsed_col: str | None = None) -> DataFrame:
    """docs with `runs` (by start, then period), `top_run` (of the greatest exponent, null without runs) and, if named,
    collapsed_col: the kept words with one space between. Nothing is shuffled."""
    one = "struct<start: bigint, length: bigint, period: bigint>"
    new = {"runs": F.lit(None).cast(RUNS), "top_run": F.lit(None).cast(one)} | ({collapsed_col: F.lit("")} if collapsed_col else {})
    base = docs.drop(*new)
    schema = base.withColumns(new).schema
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def named(r):
        return r and dict(zip(("start", "length", "period"), r))

    def run(batches):
        for batch in batches:
            rows, tops, kept = [], [], []
            for data in batch.column("__ll_text"):
                words = data.as_py().split()
                found = runs_of(words, min_length, min_exponent)
                rows.append([named(r) for r in found])
                tops.append(named(highest(found)))
                if collapsed_col:
                    kept.append(b" ".join(kept_words(words, found)).decode("utf-8", "replace"))
            keep = [batch.column(k) for k, n in enumerate(batch.schema.names) if n != "__ll_text"]
            cols = [*keep, pa.array(rows, pa.list_(kind)), pa.array(tops, kind), *([pa.array(kept, pa.string())] if collapsed_col else [])]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return base.withColumn("__ll_text", utf8(text_col)).mapInArrow(run, schema)


def collapse(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with every run cut to its first period; texts without runs stay as they are."""
    cols = docs.columns
    found = find_runs(docs.select(F.struct("*").alias("__ll_row"), F.col(text_col).alias("text")), collapsed_col="collapsed", **options)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == text_col else F.col(f"__ll_row.`{c}`").alias(c) for c in cols])


def planted(text: Column, doc_id: Column) -> Column:
    """The text in which, for ids whose crc32 ends in the digit 0, the words from place a on repeat with period p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = F.try_mod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    rest = n - a
    period = F.slice(words, a + 1, p)
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    moved = F.concat(F.slice(words, F.lit(1), a), repeated)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(moved, " ")).otherwise(text)


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find_runs(docs.withColumn("text", planted(F.col("text"), F.col("doc_id"))), collapsed_col="collapsed")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = F.col("top_run")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr("top_run.length * 1000 div top_run.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


#: Runs by islands of equal words at each distance; of stretches alike in extent the smallest distance is the period.
ORACLE = """
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY k) AS crc FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)) AS c FROM (SELECT unnest(range(256)) AS k))),
d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda v, c: xor(v >> 8, crc[(xor(v, c) & 255) + 1]))) AS h FROM documents, bits),
w AS (SELECT doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS o FROM d),
a AS (SELECT *, len(o) AS n, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN g % len(o) END AS a FROM w),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS ws FROM p),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS i FROM t),
e AS (SELECT u.doc_id, u.i, v.i - u.i AS q FROM x u JOIN x v ON u.doc_id = v.doc_id AND u.word = v.word AND u.i < v.i),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM r),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
  (b.length * 1000 // b.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM t LEFT JOIN l USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
