"""The corpus operators on small cases with nulls, empties, ties, repeats, clashing columns, against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from ledgerline.llm import byte_bpe, decontaminate, exact_topk, kd_shards, labelled, line_dedup, near_dedup, quality, token_files, toxicity, warc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n", "a", "\x00", "é ", "words " * 3000, "x" * 40000, "漢字" * 3000]


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def clashing(df):
    """df with extra columns named like what operators make."""
    names = ["n_tokens", "n_lines", "n_dropped", "token_ids", "score", "kept", "component_id", "hit_from", "k1", "doc", "pos", "node", "slot", "id", "n"]
    return df.withColumns({n: F.lit("x") for n in names})


# --- byte-level BPE ---

@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.mark.parametrize("seed", range(4))
def test_bpe_joins_are_exact(codec, seed):
    rnd = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", " \n ", "'", "'s", "'re", "1", "12", "!", "--", "é", "漢字", "🙂", "re", "=", "\t"]
    for _ in range(300):
        codec.leaf, codec.window = rnd.choice([1, 3, 8, 17]), rnd.choice([1, 4, 256])
        s = "".join(rnd.choices(parts, k=rnd.randint(0, 60)))
        assert codec.encode(s).tolist() == codec.encoding.encode_ordinary(s)
    for alphabet in ("abcdefghij", "!?.-=_'", "漢字日本語", " ", "\n ", "0123"):
        codec.leaf, codec.window = 300, 256
        s = "".join(rnd.choices(alphabet, k=4000))
        ids = codec.encode(s)
        assert ids.tolist() == codec.encoding.encode_ordinary(s)
        assert codec.decode(ids) == s.encode()


def test_bpe_documents(spark, codec):
    got = byte_bpe.round_trip(clashing(docs_of(spark, ODD)), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {"kept", "doc", "text"} <= set(got.columns)
    for r in got.collect():
        text = ODD[r.doc_id] or ""
        ids = codec.encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), byte_bpe.sha256_of_ids(ids), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe.encode(docs_of(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# --- near-dedup ---

def brute_groups(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("words", [2, 5])
def test_near_groups_against_all_pairs(spark, words):
    rnd = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    base = rnd.choices(vocabulary, k=60)
    for i in range(60):  # a chain of edits and a cloud around one text
        if i % 2:
            base = list(base)
            base[rnd.randrange(60)] = rnd.choice(vocabulary)
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(60)] = rnd.choice(vocabulary)
        texts.append(" ".join(copy).upper() if i % 5 == 0 else "\t".join(copy))
    texts += [" ".join(rnd.choices(vocabulary, k=30)) for _ in range(10)] + ["same"] * 4 + ["Same"] * 2
    got = near_dedup.near_groups(clashing(docs_of(spark, texts)), words=words, percent=80)
    assert {r.id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_groups(enumerate(texts), words, 80)


def test_near_groups_rounds_and_null_ids(spark):
    rnd = random.Random(3)
    base = [f"v{i}" for i in range(80)]
    texts = []
    for _ in range(160):  # many edits: far from all pairs link, so several pivots are needed
        copy = list(base)
        for _ in range(rnd.randint(1, 5)):
            copy[rnd.randrange(80)] = f"x{rnd.random()}"
        texts.append(" ".join(copy))
    df = docs_of(spark, texts).unionByName(spark.createDataFrame([(None, texts[0]), (None, None)], "doc_id long, text string"))
    got = near_dedup.near_groups(df, words=2, percent=80).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got if r.id is not None} == brute_groups(enumerate(texts), 2, 80)
    assert [r.component_id for r in got if r.id is None] == [None, None]
    assert near_dedup.near_groups(docs_of(spark, [])).count() == 0


def test_near_rounds_leave_closed_buckets(spark, monkeypatch):
    """Members of a bucket that one component fills are not seen again in the rounds that follow."""
    copies = [" ".join(f"c{j}" for j in range(60)) + f" x{i}" for i in range(30)]  # all linked in the first round
    chain = [" ".join(f"w{j}" for j in range(i * 4, i * 4 + 60)) for i in range(60)]
    seen, own = [], near_dedup.staged

    def noted(df, name, *more):
        out = own(df, name, *more)
        if name == "near-open":
            seen.append({r.id for r in out.select("id").distinct().collect()})
        return out

    monkeypatch.setattr(near_dedup, "staged", noted)
    near_dedup.near_groups(docs_of(spark, copies + chain), words=2, percent=80).collect()
    assert set(range(30)) <= seen[0] and len(seen) > 1
    assert all(later < earlier for earlier, later in zip(seen, seen[1:])) and not seen[-1] & set(range(30))


# --- lines ---

def brute_lines(rows, least=40, docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held.setdefault(key(x), set()).add(d)
    gone = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), d) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_against_loop(spark):
    rnd = random.Random(1)
    pool = [("Line %d é " % i) * 5 for i in range(8)] + ["short", "", " \t"]
    texts = list(ODD)
    for _ in range(60):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 6))]
        texts.append("\n".join(rnd.choice(["", " ", "\t\x0b"]) + (x.upper() if rnd.random() < 0.3 else x) + rnd.choice(["", "\r"]) for x in lines))
    rows = list(enumerate(texts))
    # É is no A-Z: only ASCII is folded
    for batches in (1, 5):
        got = line_dedup.line_dedup(clashing(docs_of(spark, texts)), batches=batches)
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in got.collect()} == brute_lines(rows)
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0


def test_line_dedup_by_ids_that_are_strings(spark):
    line = "a line that many documents have, of over forty characters"
    docs = spark.createDataFrame([(f"d{k}", f"{line}\nown {k}") for k in range(6)] + [(None, line)], "doc_id string, text string")
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, counts=("lines", "dropped")).collect()}
    assert got == {f"d{k}": f"own {k}" for k in range(5)} | {"d5": f"{line}\nown 5", None: line}


def test_rows_of_one_id_lose_their_own_lines(spark):
    line = "a line that stands in many documents, long enough"
    rows = [(i, line) for i in range(6)] + [(3, f"keep me\n{line}"), (3, line), (None, line), (None, None)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in got if r.doc_id == 3) == [(3, "", 1), (3, "", 1), (3, "keep me", 1)]
    assert sorted(((r.text or ""), r.n_dropped) for r in got if r.doc_id is None) == [("", 0), (line, 0)]
    assert [r.text for r in got if r.doc_id == 5] == [line] and len(got) == len(rows)


def test_runs_compact_and_keep_the_first_holder(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    lines = lambda rows: spark.createDataFrame(rows, "doc long, pos int, k1 long, k2 long")
    for b in range(3, -1, -1):
        runs.add(lines([(b, 0, 1, 1), (b, 0, 2 + b, 0)]))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert sorted((r.k1, r.n_docs, r.last_doc) for r in runs.merged().collect()) == [(1, 4, 3), (2, 1, 0), (3, 1, 1), (4, 1, 2), (5, 1, 3)]
    runs.add(lines([(-1, 0, 1, 1), (-1, 0, 9, 9)]))
    own = spark.read.parquet(runs.levels[0][0]).collect()
    assert sorted((r.k1, r.n_docs, r.last_doc, r.fresh) for r in own) == [(1, 1, None, False), (9, 1, -1, True)]


# --- decontamination ---

def brute_hits(text, items, window=10):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(LOW))
    w, hit, found = words(text), set(), set()
    for k, x in items:
        own = words(x)
        n = min(window, len(own))
        grams = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(k)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("chunk", [1_000_000, 40])
def test_hits_against_windows(spark, chunk):
    rnd = random.Random(chunk)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 4, 9, 10, 11, 25])))) for i in range(12)] + [(50, ""), (51, None), (52, "...")]
    items.append((60, items[3][1]))
    texts = ODD + [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 40))) for _ in range(40)]
    texts += [f"Start {x.upper()}, end" for _, x in items if x]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_hits(clashing(docs_of(spark, texts)), bench, chunk_words=chunk).collect()
    for r in got:
        assert (r.n_words, sum(b - a for a, b in zip(r.hit_from, r.hit_to)), r.hit_items) == brute_hits(texts[r.doc_id], items), texts[r.doc_id][:80]


def test_repeated_benchmark_rows_stay_in_bounds(spark):
    rows = [(1, "a b c d")] * 200 + [(i, f"x{i} y{i}") for i in range(2, 40)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    chunks = list(decontaminate._chunks(bench, "item_id", "text", 50))
    assert sorted(i for ids, _ in chunks for i in ids) == list(range(1, 40))
    assert max(sum(map(len, words)) for _, words in chunks) <= 100


def test_spans_go_and_the_rest_stays(spark):
    item = " ".join(f"q{i}" for i in range(12))
    texts = [f"Before, {item}. after and more words to keep here so that most stays, really {'x ' * 20}", item, "clean", None]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs_of(spark, texts), bench).collect()}
    assert set(got) == {0, 2, 3} and got[0].startswith("Before, . after") and got[2] == "clean" and got[3] is None
    assert decontaminate.find_hits(docs_of(spark, ["a b"]), bench.limit(0)).first().hit_items == []


# --- token files ---

def test_packing_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1000):
        ranks = (rnd.integers(0, 2**32, n) >> rnd.integers(0, 32, n).astype(np.int64)).astype(np.uint32)
        assert token_files.unpack(*token_files.pack(ranks), n).tolist() == ranks.tolist()


def test_word_encoder_is_the_tokenizer():
    rnd = random.Random(3)
    own = token_files.encoder(P.path("word_bpe_49k.json"))
    parts = ["a", "The", " ", "\n", "'s", "’", "é", "É", "Σ", "İ", "ß", "1", "²", "漢", "\x85", "\xa0", "\x1c", "é", "́", "_", "-", "🙂", "​", "<|endoftext|>", "<|ENDOFTEXT|>", "\x00", " "]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(2000)]
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for s, ids in zip(texts, own.encode_batch(pa.array([t.encode() for t in texts], pa.binary()))):
        assert np.frombuffer(ids, dtype=own.dtype).tolist() == plain.encode(s, add_special_tokens=False).ids
    assert np.frombuffer(own.encode("hello <|endoftext|> world"), dtype=own.dtype).tolist()[1] == 49407


def test_token_files_read_back(spark):
    df = docs_of(spark, ODD).unionByName(spark.createDataFrame([(None, "null id"), (3, "again"), (3, "again")], "doc_id long, text string"))
    path = P.path("word_bpe_49k.json")
    manifest, ranks = token_files.token_files(clashing(df), path, 2)
    got = token_files.read_files(manifest, ranks, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, 3, 4, 5, 6, 7, 8, 9]
    tokenizer, start = token_files.encoder(path).tokenizer, 0
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(bytes(r.ids)))
        if r.doc_id not in (None, 3):
            assert ids == tokenizer.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids + [2]
        start += len(ids)
    manifest, ranks = token_files.token_files(docs_of(spark, []), path, 2)
    assert token_files.read_files(manifest, ranks).count() == 0


# --- WARC ---

def test_warc_records_and_lookup(spark):
    body = "é" * 60
    rows = [(5, "http://a.b.c/x?y#z", body), (2, "http://a.b.c/x?y", body), (3, None, None), (4, "http://é.b/ü\n", "short"), (6, "nohost", "short"), (None, "http://a.b.c/x?y", body), (9, "https://u@www.x.org:80/p", "z" * 100), (9, "https://u@www.x.org:80/p", "z" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("key", "digest", "payload", "n", "type")})
    archive = warc.write(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(archive).collect()), key=repr)
    assert got == sorted([(5, 120, "revisit", 2), (2, 120, "response", None), (3, 0, "response", None), (4, 5, "response", None), (6, 5, "response", None), (None, 120, "response", None), (9, 100, "response", None), (9, 100, "response", None)], key=repr)
    assert {r.payload_digest for r in warc.read(archive).where("page_id = 5").collect()} == {hashlib.sha256(body.encode()).hexdigest()}
    found = warc.lookup(archive, "http://a.b.c/x?y")
    assert [(r["page_id"], r["record_type"]) for r in found] == [(None, "response"), (2, "response"), (5, "revisit")] and found[1]["payload"] == body.encode()
    assert warc.lookup(archive, "http://a.b.c/none") == []
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_records_of_repeated_page_ids(spark):
    a, b = "a" * 120, "b" * 120
    rows = [(1, "u://h/1", a), (2, "u://h/2", b), (5, "u://h/5 ü", a), (5, "u://h/5", b), (2, "u://h/2", "c" * 120)]
    archive = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.read(archive).collect()
    digest = {x: hashlib.sha256(x.encode()).hexdigest() for x in (a, b, "c" * 120)}
    want = [(1, "u://h/1", 120, digest[a], "response", None), (2, "u://h/2", 120, digest[b], "response", None), (5, "u://h/5 ü", 120, digest[a], "revisit", 1), (5, "u://h/5", 120, digest[b], "revisit", 2), (2, "u://h/2", 120, digest["c" * 120], "response", None)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    found = warc.resolve(archive, spark.createDataFrame([("h)/1", 1), ("h)/2", 2), ("h)/5", 5), ("x)/", 1)], "key string, page_id long")).collect()
    assert sorted(r.page_id for r in found) == [1, 2, 2]


def test_index_blocks_are_searched(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", f"<p>{i}</p>") for i in range(1200)], "page_id long, url string, html string")
    archive = warc.write(pages)
    assert archive.directory.count() >= 4
    for i in (0, 257, 1199):
        assert [r["page_id"] for r in warc.lookup(archive, f"http://h{i % 7}.org/{i}")] == [i]
    every = warc.index_lines(archive).select("key", "page_id", "file", "offset", "length")
    assert sorted(every.collect()) == sorted(warc.resolve(archive, every).collect())
    same = warc.write(spark.createDataFrame([(i % 2, "http://h.org/", f"<p>{i}</p>") for i in range(900)], "page_id long, url string, html string"))
    assert len(warc.lookup(same, "http://h.org/")) == 900


# --- exact top-k ---

def brute_topk(rows, k):
    good = {i: np.floor(np.array(v, dtype=float) * 256).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in good:
        if q % 50 == 0:
            a = good[q]
            score = sorted((-int((a[:min(len(a), len(b))] * b[:min(len(a), len(b))]).sum()), i) for i, b in good.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(score[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [16384, 3])
def test_topk_against_products(spark, chunk):
    rnd = np.random.default_rng(chunk)
    rows = [(i, (rnd.normal(size=8) * rnd.choice([0.01, 1, 5])).astype("f4").tolist()) for i in range(400)]
    rows += [(i + 400, rows[7][1]) for i in range(100)] + [(600, [0.0] * 8), (601, None), (602, [None] * 8), (650, [float("nan")] * 8), (603, []), (604, [1.0]), (None, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "vec", "score", "rank")}).repartition(5)
    got = exact_topk.exact_topk(df, F.col("vec_id") % 50 == 0, chunk=chunk)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(rows, 5)


def test_topk_prunes_by_coordinate(spark):
    rnd = np.random.default_rng(5)
    near = np.ones(8) / 8**0.5
    rows = [(i, (near + rnd.normal(size=8) * 0.02 if i < 60 else rnd.normal(size=8) * 0.3).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in exact_topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect()) == brute_topk(rows, 5)
    assert exact_topk.exact_topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- shards ---

def test_shards_are_even_whole_and_gapless(spark):
    rnd = random.Random(2)
    texts = ODD + ["copy " * 20] * 400 + ["pair " * 20] * 30 + ["".join(rnd.choices("abc é", k=rnd.randint(0, 400))) for _ in range(700)]
    df = clashing(docs_of(spark, texts).withColumns({"lang": F.when(F.col("doc_id") % 3 == 0, "a"), "source": F.lit("hot")}))
    got = kd_shards.kd_shards(df, shards=8).collect()
    assert sorted(r.id for r in got) == list(range(len(texts)))
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    for r in got:
        text = (texts[r.id] or "").encode()
        assert (r["size"], r.crc) == (len(text) + 1, zlib.crc32(text))
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    # a group below a shard's share stays whole, one above it does not fit
    assert len({r.shard for r in got if texts[r.id] == "pair " * 20}) == 1
    assert 400 * 101 > sum(sizes) / 8 > 30 * 101
    assert max(sizes) - min(sizes) <= 2 * max(len((t or "").encode()) + 1 for t in texts)
    small = ["x" * rnd.randint(1, 50) + str(i) for i in range(2000)]
    even = kd_shards.kd_shards(docs_of(spark, small).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")}), target_bytes=4000).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert max(r.b for r in even) <= 4000 * 1.1 and max(r.b for r in even) - min(r.b for r in even) <= 250
    empty = docs_of(spark, []).withColumns({"lang": F.lit("a"), "source": F.lit("s")})
    assert kd_shards.kd_shards(empty, shards=4).count() == 0


# --- classifiers ---

def test_nearest_examples_are_exact():
    rnd = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        t = np.sort(rnd.choice(50, rnd.integers(0, 6), replace=False))
        w = rnd.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    index = toxicity.BlockMaxIndex(vectors, 50, block=16, dense=0.06)
    assert 0 < len(index.dense) < 50
    dense = np.zeros((700, 50))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in [v for v in vectors if len(v[0])][:200]:
        score = dense[:, t] @ w
        want = sorted((-round(s, 12), i) for i, s in enumerate(score) if s > 0)[:15]
        assert [(-round(s, 12), i) for s, i in index.nearest(t, w, 15)] == want


def test_toxicity_sample_is_bounded_and_whole(spark):
    df = docs_of(spark, ["x" * 10, None, "y" * (1 << 19), "z"]).unionByName(docs_of(spark, ["again"] * 1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    rows = labelled.picked(df, labels, "toxic", F.lit(True), per_class=2, longest=None).collect()
    assert sorted((r.id, r.label, len(r.text)) for r in rows) == [("0", 0, 5), ("0", 0, 10), ("2", 0, 1 << 19), ("3", 1, 1)]
    assert len(labelled.picked(df, labels, "toxic", F.lit(True), per_class=1).collect()) == 2


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_tables(spark, module, label):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choices(["calm", "river", "stone", "house", "light"], k=30))
    bad = lambda: " ".join(rnd.choices(["calm", "river", "grrr###", "zap&&&", "argh$$$"], k=30))
    texts = [bad() if i % 3 == 0 else good() for i in range(300)] + ODD
    df = clashing(docs_of(spark, texts))
    y = lambda i: int(i % 3 == 0) if label == "toxic" else int(i % 3 != 0)
    labels = spark.createDataFrame([(i, y(i)) for i in range(300)] + [(None, 1), (1, None), (2, 7), (5, y(5)), (5, y(5))], f"doc_id long, {label} int")
    model = module.fit(df, labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality.with_scores(df, model).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    hit = [got[i] for i in range(300) if y(i)]
    miss = [got[i] for i in range(300) if not y(i)]
    assert np.mean(hit) - np.mean(miss) > 0.5
    none = module.fit(df, labels.limit(0), F.lit(True))
    assert {round(r.score, 3) for r in quality.with_scores(df, none).collect()} == {0.0 if label == "toxic" else 0.5}
    assert quality.with_scores(docs_of(spark, []), model).count() == 0


def test_evidence(spark):
    df = docs_of(spark, ["vile words here"] * 4 + ["nice words there"] * 4 + ["vile", None])
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(8)], "doc_id long, toxic int")
    got = {r.doc_id: r.evidence for r in toxicity.toxicity(df, toxicity.fit(df, labels, F.lit(True))).collect()}
    assert got[9] == [] and all(0 < e.similarity <= 1 + 1e-9 for e in got[8])
    assert [(e.example in {"0", "1", "2", "3"}, e.label) for e in got[8]] == [(True, 1)] * 4
    assert {e.example for e in got[5]} >= {"4", "5", "6", "7"}
