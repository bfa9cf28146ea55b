"""Near-duplicate documents by min-max hashing.

A document's set holds 64-bit hashes of its distinct word shingles. Each permutation of the hashes gives two signature
values, its minimum and its maximum, so BANDS * ROWS values take half as many permutations. Documents that agree in all
values of a band are candidates; with 42 bands of 5 a pair at similarity 0.8 is missed with probability 6e-8.
Every link is confirmed on the full sets.

Equal sets form a class; only class representatives (smallest ids) go on. Links are found without listing the pairs
of a bucket: in each round every document that shares an open bucket (one with more than one component) is tested
against pivots of its buckets' largest components, one in the first round and four times as many in each that follows,
and confirmed links are joined to components. When the pairs between components that remain in open buckets are no
more than a round may test, all of them are tested, each in the first bucket that both share; so rounds grow with the
logarithm of a bucket's size. Texts are joined with the ids of candidates once; after that only sets of candidates are
shuffled.

Each candidate has a parity bitmap: bit h mod m is set if an odd number of its hashes h fall on it. The bits in which two
bitmaps differ are a lower bound of the hashes that only one of the sets has, so a pair beyond the bound of the wanted
similarity cannot link: that filter loses nothing, and the sets of such pairs are never joined. Comparisons of bitmaps
within a bucket can still grow with the square of a group of near copies that do not link; rows made do not.

Cases: null texts and texts without words have an empty set and link with nothing, not even each other; a text with
fewer words than a shingle has one shingle, the whole sequence; rows with one id are one document; rows with a null id
have n_shingles but no component; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import checkpointed as cut

from .common import space_words, spread, staged, table, trimmed, utf8

BANDS, ROWS = 42, 5
#: Entries of a Python worker's cache of word hashes; it is emptied when full.
CACHED_WORDS = 100_000
#: Bits of the largest parity bitmap.
MOST_BITS = 4096
#: Words of the bitmap of candidates' ids: 16,777,216 bits.
MARKS = 262_144
#: Hashes permuted at once, which bounds a task's memory for long texts.
AT_ONCE = 4096
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def _mix(x: np.ndarray) -> np.ndarray:
    a, b, s = _MIX
    x = (x ^ (x >> s)) * a
    x = (x ^ (x >> s)) * b
    return x ^ (x >> s)


class Signer:
    """Shingle sets, signatures and band keys of texts."""

    def __init__(self, words: int, bands: int, rows: int):
        draw = np.random.default_rng(20240601)
        n = -(-bands * rows // 2)
        self.words, self.bands, self.rows = words, bands, rows
        self.a = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        self.c = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[bytes, int] = {}

    def shingles(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingle hashes of a whole text."""
        import xxhash

        words, known = space_words(text), self.known
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        w = np.array([known[x] for x in words], dtype=np.uint64)
        k = min(self.words, len(w))
        out = np.full(len(w) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - k + 1 + i])
        return np.unique(out)

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        n = len(self.a)
        low, high = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        for at in range(0, len(hashes), AT_ONCE):
            part = hashes[at:at + AT_ONCE]
            for p in range(n):
                x = part * self.a[p] + self.b[p]
                low[p] = min(low[p], x.min())
                high[p] = max(high[p], x.max())
        values = np.concatenate((low, high))[:self.bands * self.rows]
        keyed = _mix(values * self.c).reshape(self.bands, self.rows).sum(axis=1, dtype=np.uint64)
        return _mix(keyed + np.arange(self.bands, dtype=np.uint64))


@lru_cache(maxsize=2)
def signer(words: int, bands: int, rows: int) -> Signer:
    return Signer(words, bands, rows)


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, f1, f2, n, bands) of (id, text): a fingerprint of the set, its size, its band keys (null if empty)."""
    def run(batches):
        import xxhash

        own = signer(words, bands, rows)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                h = own.shingles(text)
                f = xxhash.xxh3_128_digest(h.tobytes())
                keys = own.band_keys(h).view(np.int64) if len(h) else None
                out.append((int.from_bytes(f[:8], "little", signed=True), int.from_bytes(f[8:], "little", signed=True), len(h), keys))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64()))], names=["id", "f1", "f2", "n", "bands"])

    return docs.mapInArrow(trimmed(run), "id long, f1 long, f2 long, n long, bands array<long>")


def parity(hashes: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set in 64-bit words: two to four bits a hash, MOST_BITS at most."""
    m = min(MOST_BITS, max(64, 1 << (2 * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, set, bits) of (id, text)."""
    def run(batches):
        own = signer(words, BANDS, ROWS)
        for batch in batches:
            h = [own.shingles(t) for t in batch.column("text").to_pylist()]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in h], pa.int64()), pa.array([x.view(np.int64) for x in h], longs), pa.array([parity(x) for x in h], longs)], names=["id", "n", "set", "bits"])

    return docs.mapInArrow(trimmed(run), "id long, n long, set array<long>, bits array<long>")


def may_link(bits: str, bits_y: str, n: Column, n_y: Column, percent: int) -> Column:
    """False only where the bitmaps prove that the sets cannot be linked. The larger bitmap is folded to the smaller's
    size, of which it is twice; sets whose bitmaps differ more are not judged here."""
    a, b = F.col(bits), F.col(bits_y)

    def folded(x: Column, k: Column) -> Column:
        return F.when(F.size(x) > k, F.zip_with(F.slice(x, F.lit(1), k), F.slice(x, k + 1, k), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    apart = F.aggregate(F.zip_with(folded(a, F.size(b)), folded(b, F.size(a)), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, c: acc + c)
    # |x - y| + |y - x| of a link is at most (n + n_y) * (100 - percent) / (100 + percent)
    return (F.greatest(F.size(a), F.size(b)) > 2 * F.least(F.size(a), F.size(b))) | ((100 + percent) * apart <= (100 - percent) * (n + n_y))


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that the bitmaps don't exclude."""
    for c in "yx":
        pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    return pairs.where(may_link("bits_x", "bits_y", F.col("n_x"), F.col("n_y"), percent)).select("x", "y")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y), a staged table, whose full sets have 100 * intersection >= percent * union."""
    # few pairs are broadcast by their table's size; else a pivot with very many partners is split by adaptive execution
    both = pairs.join(sets.select(F.col("id").alias("y"), F.col("n").alias("n_y"), F.col("set").alias("set_y")), "y")
    asked = sets.join(pairs.select(F.col("x").alias("id")).distinct(), "id", "left_semi")
    both = both.join(asked.select(F.col("id").alias("x"), F.col("n").alias("n_x"), F.col("set").alias("set_x")).hint("merge"), "x")
    common = F.size(F.array_intersect("set_x", "set_y")).cast("long")
    return both.where(100 * common >= percent * (F.col("n_x") + F.col("n_y") - common)).select("x", "y")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (x, y) reaches. Labels spread and double their reach."""
    both = cut(edges.select(F.col("x").alias("u"), F.col("y").alias("v")).union(edges.select("y", "x")).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        to = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        after = cut(moved.join(to, F.col("label") == F.col("at")).select("node", "old", F.least("label", "beyond").alias("label")))
        if after.where("label <> old").isEmpty():
            return after.select("node", F.col("label").alias("root"))
        labels = after.select("node", "label")


def _fits(n: str, n_y: str, percent: int) -> Column:
    """Whether sets of these sizes can be linked."""
    return 100 * F.least(n, n_y) >= percent * F.greatest(n, n_y)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, comp) after joining the components that links (x, y) connect."""
    x = links.join(labels.select(F.col("id").alias("x"), F.col("comp").alias("a")), "x").join(labels.select(F.col("id").alias("y"), F.col("comp").alias("b")), "y")
    roots = components(x.where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct())
    return cut(labels.join(roots, F.col("comp") == F.col("node"), "left").select("id", F.coalesce("root", "comp").alias("comp")))


def _linked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, comp) of the ids in members (id, n, buckets): components of all confirmed links between bucket mates.

    A bucket that is closed stays so, as components only grow: a round sees open buckets and their members alone.
    """
    labels = cut(members.groupBy("id").agg(F.min("id").alias("comp")))
    tested, turn = None, 0
    while True:
        named = members.join(labels, "id").select("id", "n", "comp", F.explode("buckets").alias("bucket"))
        shares = named.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.min_by(F.struct("id", "n"), F.xxhash64("id", F.lit(turn))).alias("pivot"))
        most = F.max_by(F.struct("comp", "pivot"), F.struct("c", -F.col("comp")))
        open_ = cut(shares.groupBy("bucket").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("k"), most.alias("m")).where("k > 1"))
        left, n = open_.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.sum("s")).first()
        if not left:
            return labels
        rows = staged(named.join(open_.select("bucket", F.col("m.comp").alias("big"), F.col("m.pivot").alias("pivot")), "bucket"), "near-open")
        last = left <= (4 * n) << (2 * turn)
        if last:
            # the open buckets of an id are as many as bands at most; a pair is made in the least that both share, so
            # each row has the lesser ones of its id (32 bits each) beside its bitmap
            met = rows.groupBy("id", "n", "comp").agg(F.array_sort(F.collect_set(F.struct("bucket", "big"))).alias("met"))
            met = met.join(sets.select("id", "bits"), "id").select("id", "n", "comp", "bits", F.transform("met", lambda s: F.shiftright(s["bucket"], 32).cast("int")).alias("lesser"), F.posexplode("met").alias("at", "s"))
            met = met.select("s.bucket", "s.big", "id", "n", "comp", "bits", F.slice("lesser", F.lit(1), F.col("at")).alias("lesser"))
            other = met.select("bucket", F.col("id").alias("y"), F.col("n").alias("n_y"), F.col("comp").alias("comp_y"), F.col("bits").alias("bits_y"), F.col("lesser").alias("lesser_y"))
            meet = (F.col("comp") != F.col("comp_y")) & ((F.col("comp_y") == F.col("big")) | (F.col("id") < F.col("y"))) & _fits("n", "n_y", percent)
            meet &= ~F.arrays_overlap("lesser", "lesser_y")
            both = met.where("comp <> big").withColumnRenamed("bucket", "own").join(other.hint("merge"), (F.col("own") == F.col("bucket")) & meet & may_link("bits", "bits_y", F.col("n"), F.col("n_y"), percent))
            pairs = both.select(F.col("id").alias("x"), "y").distinct()
        else:  # members outside the largest component of their bucket, against at most as many pivots as bands
            members = rows.groupBy("id", "n").agg(F.collect_list("bucket").alias("buckets"))
            pairs = rows.where("comp <> big").where(_fits("n", "pivot.n", percent)).select(F.col("id").alias("x"), F.col("pivot.id").alias("y")).distinct()
            dealt = F.array_sort(F.collect_list(F.struct(F.xxhash64("y", F.lit(turn)).alias("h"), "y")))
            pairs = pairs.groupBy("x").agg(dealt.alias("ys")).select("x", F.explode(F.slice("ys", 1, 4 ** turn)["y"]).alias("y"))
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        made = pairs = staged(pairs, "near-pairs")
        if not last:
            pairs = staged(_possible(pairs, sets, percent), "near-pairs")
        links = cut(confirmed(pairs, sets, percent))
        if not links.isEmpty():
            labels = _merged(labels, links)
        if last:
            return labels
        tested = made if tested is None else tested.union(made)
        turn += 1


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, ...) whose id may be in ids (id), all that are among them: a bitmap of hashed ids, MARKS words of 64 bits
    at most whatever the table, goes to all tasks, so that few other rows are shuffled."""
    h = lambda: F.xxhash64("id")
    bit = F.expr("shiftright(xxhash64(id), 40) & 63")
    word = F.pmod(h(), F.lit(MARKS))
    marks = ids.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, cast(__bit AS INT))")).alias("__marks"))
    own = rows.withColumns({"__at": word, "__own": bit}).join(F.broadcast(cut(marks)), F.col("__at") == F.col("__word"))
    return own.where("(shiftright(__marks, cast(__own AS INT)) & 1) = 1").select(*rows.columns)


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id) of each row: the smallest id reachable over links of at least percent / 100."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    signs = staged(signed(spread(texts), words, bands, rows), "near-signs")
    classes = signs.where("n > 0 AND id IS NOT NULL").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = staged(classes, "near-classes")
    spots = classes.select("id", "n", F.explode("bands").alias("bucket"))
    crowded = spots.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    members = staged(spots.join(crowded, "bucket").groupBy("id", "n").agg(F.collect_set("bucket").alias("buckets")), "near-members")
    candidates = members.select("id").distinct()
    sets = staged(sets_of(_marked(texts, candidates).join(candidates, "id"), words), "near-sets")
    labels = _linked(members, sets, percent)
    named = classes.select("f1", "f2", "id").join(labels, "id", "left").select("f1", "f2", F.coalesce("comp", "id").alias("component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return signs.select("id", "f1", "f2", "n").join(named, ["f1", "f2"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose id is not the smallest of its group; rows with a null id stay."""
    groups = near_groups(docs, id_col=id_col, **options)
    gone = staged(groups.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("__ll_id")), "near-gone")
    return docs.join(gone, docs[id_col] == gone["__ll_id"], "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
