"""Runs of words, BPE with word ends and the Merkle manifest: brute force, the library, odd rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_small_cases import LOW, ODD, clashing, docs_of
from tokenizers import Tokenizer

from ledgerline.llm import merkle, queries, word_bpe, word_runs
from ledgerline.llm.common import table

SF = "/root/testdata/sf0.001"
PATH = P.path("word_bpe_49k.json")
EXTRA = ["a b " * 40, "x " * 5_000, "abcdefgh" * 2_000, "don't 'sun ''ll !'s " * 30, "it's<|endoftext|>fine <|startoftext|>", "é" * 700 + " ½Ⅷ" * 50, None, ""]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# runs


def brute_runs(w, least, exponent=3):
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, exponent * q):
                out.setdefault((s, i + q - s), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def words_of_runs(rng):
    out = []
    while len(out) < 60:
        base = [rng.randint(0, 3) for _ in range(rng.randint(1, 6))]
        out += base * rng.randint(1, 6)
    return out


def test_next_smaller_suffixes():
    rng = random.Random(1)
    for _ in range(3_000):
        x = words_of_runs(rng)[:rng.randint(0, 60)]
        nxt, agree = word_runs.next_smaller(x)
        for i in range(len(x)):
            j = next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x))
            assert nxt[i] == j
            k = agree[i]
            assert x[i:i + k] == x[j:j + k] and (j + k == len(x) or x[i + k] != x[j + k] or j == len(x))


@pytest.mark.parametrize("least", [1, 5, 24])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    for _ in range(2_000):
        x = [b"%d" % v for v in words_of_runs(rng)]
        assert word_runs.runs_of(x, least) == brute_runs(x, least)


def test_linear_on_hard_texts():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 100_000:
        fib.append(fib[-1] + fib[-2])
    for x in ([1] * 100_000, fib[-1], list(range(100_000)), [k % 777 for k in range(100_000)]):
        word_runs.next_smaller(x)


def test_runs_on_odd_rows(spark):
    texts = [*ODD, *EXTRA]
    got = {r.doc_id: r for r in word_runs.find_runs(clashing(docs_of(spark, texts)), collapsed_col="collapsed").collect()}
    assert len(got) == len(texts)
    for k, text in docs_of(spark, texts).select("doc_id", "text").collect():
        w = (text or "").encode().split()
        want = brute_runs(w, 24)
        assert [tuple(r) for r in got[k].runs] == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert got[k].collapsed == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        assert (got[k].top_run is None) == (not want)
    assert word_runs.find_runs(docs_of(spark, texts).limit(0)).count() == 0
    whole = word_runs.collapse(clashing(docs_of(spark, texts)))
    assert whole.columns == clashing(docs_of(spark, texts)).columns and "x" in [r.text for r in whole.collect()]


def test_op11(spark):
    rows = queries.queries()["op11_word_runs"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        w = texts[r.doc_id].encode().split()
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w, 24)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.collapsed_sha256 == sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


# BPE with word ends


@pytest.mark.parametrize("leaf, window", [(3, 1), (16, 2)])
def test_tree_against_the_library(leaf, window):
    own, lib, rng = word_bpe.WordBpe(PATH, leaf, window), Tokenizer.from_file(PATH), random.Random(leaf)
    parts = ["a", "ing", "'s", "'ll", "'", " ", "\n", "1", "23", "!", "é", "Ω", "İ", "中文", "🙂", "👩‍👧", "́", "xxxx", "hello", "<|endoftext|>", "</w>", "Ⅷ", "\x1c", "가"]
    for _ in range(1_500):
        few = rng.sample(parts, rng.randint(1, 6))
        s = "".join(rng.choice(few) for _ in range(rng.randint(0, 60)))
        ids = lib.encode(s, add_special_tokens=False).ids
        got = own.encode(s)
        assert got.tolist() == ids, s
        assert own.decode(got) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("part_chars", [50, 1 << 16])
def test_encode_on_odd_rows(spark, part_chars):
    lib, texts = Tokenizer.from_file(PATH), [*ODD, *EXTRA]
    got = word_bpe.encode(clashing(docs_of(spark, texts)), PATH, decoded_col="decoded", part_chars=part_chars)
    again = word_bpe.decode(got.select("doc_id", "token_ids"), PATH)
    rows, back = got.collect(), {r.doc_id: r.decoded for r in again.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, dtype="<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == back[r.doc_id] == lib.decode(ids, skip_special_tokens=False)
    assert word_bpe.encode(docs_of(spark, texts).limit(0), PATH).count() == 0


def test_op12(spark):
    lib = Tokenizer.from_file(PATH)
    rows = {r.doc_id: r for r in queries.queries()["op12_word_bpe"](spark, SF).collect()}
    texts = table(spark, SF, "documents").collect()
    assert len(rows) == len(texts)
    for d in texts:
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        want = len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False))
        assert tuple(rows[d.doc_id])[1:] == want


# Merkle manifest


def brute_manifest(rows, fanout=8):
    """(id, leaf, subroot, root, proof, folded root, verified) of rows (id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, [*r[:4], text])))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k:k + fanout])) for k in range(0, len(out[-1]), fanout)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            a = i // fanout * fanout
            run = nodes[a:a + fanout]
            yield i - a, run[:i - a] + run[i - a + 1:]
            i //= fanout

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = [*path(trees[g], i), *path(top, n)]
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = text.translate(LOW)
            acc = leaf(r, text)
            for place, siblings in steps:
                acc = sha("".join([*siblings[:place], acc, *siblings[place:]]))
            out.append((r[0], own, trees[g][-1][0], top[-1][0], sha("".join(s for _, x in steps for s in x)), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def run_manifest(spark, rows, folder):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    df.write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in queries.queries()["op13_merkle_manifest"](spark, str(folder)).collect()), key=repr)


def odd_rows(n):
    rng = random.Random(n)
    rows = [(k, rng.choice(["s", None]), rng.choice(["en", "de", "é", None, "en"]), k, rng.choice(["Text", "", None, "É A b"])) for k in range(n)]
    return [*rows, (None, None, None, None, None), (None, "x", "en", 1, "A"), *[rows[0]] * 3, (1, "other", rows[-1][2], 5, "one id twice")] if n else []


@pytest.mark.parametrize("n", [0, 1, 9, 700])
def test_manifest_on_odd_rows(spark, tmp_path, n):
    rows = odd_rows(n)
    got = run_manifest(spark, rows, tmp_path)
    assert got == (brute_manifest(rows) if rows else [])


@pytest.mark.parametrize("fanout, levels", [(2, 1), (3, 2)])
def test_many_rounds_of_superblocks(spark, fanout, levels):
    rows = odd_rows(120)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], fanout=fanout, levels=levels).withColumn("ok", merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"))
    found = [(r.doc_id, r.leaf, r.subroot, r.root, sha("".join(s for p in r.path for s in p.siblings)), r.ok) for r in got.collect()]
    assert sorted(found, key=repr) == sorted((r[:5] + (True,) for r in brute_manifest(rows, fanout)), key=repr)


def test_op13(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = queries.queries()["op13_merkle_manifest"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows)
