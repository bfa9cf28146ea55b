"""Registered queries and the pipeline's stages, every row of the smallest tables against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from test_small_cases import LOW, brute_groups, brute_hits, brute_lines

import corpus_pipeline
from ledgerline.llm import byte_bpe, kd_shards, labelled, quality, queries, toxicity
from ledgerline.llm.common import table
from ledgerline.llm.labelled import fold

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


def test_op1(spark, texts):
    encode = byte_bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encoding.encode_ordinary
    want = {(i, len(ids := encode(x or "")), byte_bpe.sha256_of_ids(ids), hashlib.sha256((x or "").encode()).hexdigest()) for i, x in texts.items()}
    got = run(spark, "op1_byte_bpe")
    assert len(got) == len(texts) and {tuple(r) for r in got} == want


def test_op2(spark, texts):
    want = {(i, n, c, i == c) for i, (n, c) in brute_groups(texts.items(), 2, 80).items()}
    got = run(spark, "op2_near_dedup")
    assert len(got) == len(texts) and {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == want


def plain_vector(text, idf):
    """TF-IDF over three-byte pieces of words as a dict of unit length."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    tf = Counter(piece for w in words for b in [f" {w} ".encode()] for piece in (b[k:k + 3] for k in range(len(b) - 2)))
    v = {t: n ** toxicity.TF * idf[t] for t, n in tf.items() if t in idf}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / size for t, x in v.items()}


def test_op3(spark, texts):
    learn = fold("doc_id", 4) != 2
    known = table(spark, SF, "labels").where(learn & F.col("toxic").isNotNull())
    label = {r.doc_id: r.toxic for r in known.collect() if texts.get(r.doc_id) is not None}
    assert max(Counter(label.values()).values()) < labelled.PER_CLASS
    df = Counter(t for v in ({t for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[i].translate(LOW)) for b in [f" {w} ".encode()] for t in (b[k:k + 3] for k in range(len(b) - 2))} for i in label) for t in v)
    idf = {t: math.log(1 + len(label) / (n + 0.5)) ** toxicity.IDF for t, n in df.items()}
    examples = [(plain_vector(texts[i], idf), y) for i, y in label.items()]
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), learn)
    got = run(spark, "op3_toxicity")
    assert len(got) == len(texts)
    for r in got:
        v = plain_vector(texts[r.doc_id], idf)
        near = sorted(((sum(x * e[t] for t, x in v.items() if t in e), y) for e, y in examples), reverse=True)
        near = [(s, y) for s, y in near if s > 0][:toxicity.NEIGHBOURS]
        assert [round(e.similarity, 7) for e in r.evidence] == [round(s, 7) for s, _ in near]
        if len({round(s, 7) for s, _ in near}) == len(near):  # no ties
            vote = (sum(s * s * y for s, y in near) + toxicity.PRIOR * model.share) / (sum(s * s for s, _ in near) + toxicity.PRIOR)
            assert abs(r.score - 1 / (1 + math.exp(-4 * model.slope * vote - model.offset))) < 1e-6
        assert bool(near) == bool(v) and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_op5(spark, texts):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted(run(spark, "op5_token_files"), key=lambda r: r.start)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    start = 0
    for r in got:
        ids = np.array(tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op7(spark, texts):
    import zstandard

    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), fold("doc_id", 5) != 0)
    packed = lambda text, words: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_checksum=False, write_dict_id=False).compress(text))
    got = run(spark, "op7_quality")
    assert len(got) == len(texts)
    for r in got:
        text = (texts[r.doc_id] or "").encode()
        x = (packed(text, model.bad) - packed(text, model.good)) / (len(text) + 1) if text else 0.0
        assert abs(r.score - 1 / (1 + math.exp(-model.slope * x / model.scale - model.offset))) < 1e-9
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def plain_tree(rows, dims, depth):
    """Halves of rows by the weighted median of their widest dimension, one node after the other."""
    if not depth or not rows:
        return [rows] * (depth == 0) or [[]] * (1 << depth)
    span = [max(r[f"d{n}"] for r in rows) - min(r[f"d{n}"] for r in rows) for n in range(dims)]
    own = f"d{span.index(max(span))}"
    key = lambda r: (r[own] << kd_shards.TIE_BITS) + r.tie
    weight, upto, bound = sum(r["size"] for r in rows), 0, None
    sums = Counter()
    for r in rows:
        sums[key(r)] += r["size"]
    for k in sorted(sums):
        upto += sums[k]
        if 2 * upto >= weight:
            bound = k + (2 * upto - weight <= weight - 2 * (upto - sums[k]))
            break
    return plain_tree([r for r in rows if key(r) < bound], dims, depth - 1) + plain_tree([r for r in rows if key(r) >= bound], dims, depth - 1)


def test_op9_is_the_tree(spark):
    light = kd_shards.light_rows(table(spark, SF, "documents"))
    rows = kd_shards.coordinates(light, light.agg(F.sum("size")).first()[0], 16, 2).collect()
    want = {r.id: shard for shard, leaf in enumerate(plain_tree(rows, 4, 4)) for r in leaf}
    assert {r.doc_id: r.shard for r in run(spark, "op9_kd_shards")} == want


#: Columns of the caller, named like what operators make.
CALLERS = ("lang", "source", "evidence", "id", "n_lines", "n_dropped", "hit_from", "hit_to", "hit_items", "cut_from", "cut_to", "n_words", "n", "bands", "score", "component_id")


def test_stages_on_odd_documents(spark):
    long = "word " * 5 + " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (1, None), (2, ""), (None, long), (None, None), (3, long), (3, long), (4, long), (5, "\n \t\n"), (6, long.upper() + "\n" * 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in CALLERS}).withColumn("n_chars", F.char_length("text").cast("long"))
    for docs, least in ((odd, 5), (odd.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.staged(stage(spark, docs, SF), f"odd-{name}")
            if name != "byte_bpe":
                assert docs.schema.simpleString() == odd.schema.simpleString()
                assert all(r[c] == c for r in docs.select(*CALLERS).collect() for c in CALLERS), name
        kept = docs.collect()
        assert len(kept) >= least and all(r.n_tokens == 0 for r in kept if r.doc_id in (1, 2))
        # one id of each group of copies is left, with all its rows; rows without an id stay
        assert sorted({r.doc_id for r in kept if r.doc_id}) == ([1, 2, 3, 5] if least else []) and (not least or sum(r.doc_id is None for r in kept) == 2)


def test_op9(spark, texts):
    got = run(spark, "op9_kd_shards")
    data = {i: (x or "").encode() for i, x in texts.items()}
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == [(i, len(x) + 1, zlib.crc32(x), "bytes", None) for i, x in sorted(data.items())]
    slots, sizes = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # equal texts stay together, and shards differ by no more than the heaviest group of them on each of four cuts
    groups, where = Counter(), {}
    for r in got:
        groups[data[r.doc_id]] += r["size"]
        where.setdefault(data[r.doc_id], set()).add(r.shard)
    share, heaviest = sum(sizes.values()) / 16, max(groups.values())
    assert all(len(s) == 1 for x, s in where.items() if groups[x] <= share)
    assert all(abs(n - share) <= 2 * heaviest for n in sizes.values())


def test_op10(spark, texts, items):
    want = set()
    for i, x in texts.items():
        n, hit, found = brute_hits(x, items)
        want.add((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    got = run(spark, "op10_decontaminate")
    assert len(got) == len(texts) and {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want


def without_hits(text, items, window=10):
    """The text without the spans of words that items have; None where they are more than half of it."""
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))]
    words = [(text or "").translate(LOW)[a:b] for a, b in places]
    hit = set()
    for _, x in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))
        n = min(window, len(own))
        grams = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        hit |= {k for i in range(len(words) - n + 1) if n and tuple(words[i:i + n]) in grams for k in range(i, i + n)}
    if 2 * len(hit) > len(words):
        return None
    out, at = "", 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out += text[at:places[k][0]]
        at = places[k][1]
    return out + (text or "")[at:]


def test_pipeline(spark, texts, items):
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), fold("doc_id", 4) != 2)
    left = {i: x for i, x in texts.items() if model.score((x or "").encode()) < toxicity.THRESHOLD}
    left = {i: x for i, (_, _, x) in brute_lines(left.items()).items()}
    left = {i: left[i] for i, (_, c) in brute_groups(left.items(), 5, 80).items() if i == c}
    left = {i: y for i, x in left.items() if (y := without_hits(x, items)) is not None}
    encode = byte_bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encoding.encode_ordinary
    want = {(i, len(ids := encode(x)), byte_bpe.sha256_of_ids(ids), hashlib.sha256(x.encode()).hexdigest()) for i, x in left.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(left) and {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_only_the_last_table_of_the_pipeline_stays(spark):
    import os

    from ledgerline.session import checkpoint_dir

    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    # checkpoints aside, which Spark keeps in a folder per application
    left = [n for n in set(os.listdir(folder)) - before if "-" in n and not n.count("-") == 4]
    assert len(left) == 1 and left[0].startswith("pipeline-byte_bpe") and out.count() > 0
