"""N-gram Jaccard self-join with Bayesian candidate pruning.

A document is the set of its 5-word shingles (64-bit hashes; a text of one to four words is one
shingle). Texts with equal sets form a class; one representative of each goes on. MinHash bands find
candidates: BANDS bands of ROWS values miss a pair at 0.8 with probability (1 - 0.8^6)^48 = 5e-7.
Pairs of representatives that share a bucket are candidates. Their
MinHash values are compared CHUNK at a time; a pair is dropped once the posterior probability
(uniform prior, binomial likelihood) that its similarity reaches the threshold falls below TOLERANCE.
Every pair left is verified on the exact shingle sets in integers.

Links are counted, not listed: a group of m near copies costs its comparisons but emits one row per
document and block pair, with its number of links and the smallest document it is joined to there.
Result per document: class_id (smallest document of its linked group), copy_class (smallest document
with the same shingle set), n_links (other documents at or above the threshold, copies included) and
n_text_links (other classes at or above it).

Defined cases: a null or empty text has no shingle and links to nothing, not to other empty texts;
repeated rows are copies of each other and each gets its row; an id is taken to name one text; a row
without an id is not compared and has no links; an empty table gives an empty result; other columns
are ignored.

Scale: sketches (400 bytes a document) are one narrow pass. Each bucket has a leader, its smallest
representative, and each leader a weight, the rows of the buckets that it leads; a representative goes
to the heaviest leader among its buckets. A leader's followers are dealt into units of about BLOCK
documents and BLOCK_SHINGLES shingles. Two units meet only if a bucket holds members of both, so texts
that merely hang together in a chain never meet, and a task holds two units at most. Members of a bucket
of m rows follow leaders of weight m or more, of which 48 N / m exist: a bucket has at most sqrt(48 N)
leaders besides the units that a large following is dealt into. Nothing is capped.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, id_and_text, slices
from tessera.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 48, 6
CHUNK, TOLERANCE = 32, 1e-9
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
PARTNERS = 4_096
_R = np.random.default_rng(20_011)
_MULT = _R.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    lists = [t.encode("utf-8", "replace").split() for t in texts]
    flat = [w for x in lists for w in x]
    distinct = list(dict.fromkeys(flat))
    index = dict(zip(distinct, range(len(distinct))))
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)
    h = word[np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))]
    n = len(h) - SHINGLE + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        grams = _mix(grams + h[k:k + n])
    out, at = [], 0
    for x in lists:
        if len(x) >= SHINGLE:
            out.append(np.unique(grams[at:at + len(x) - SHINGLE + 1]))
        elif x:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\n".join(x), seed=len(x))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(x)
    return out


def minhash(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS 32-bit MinHash values of a non-empty set."""
    best = np.full(len(_MULT), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(s), 2048):
        part = (_MULT[:, None] * s[None, lo:lo + 2048] + _ADD[:, None]) >> np.uint64(32)
        best = np.minimum(best, part.min(1).astype(np.uint32))
    return best


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def band_values(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band, for MinHash values in rows of BANDS * ROWS."""
    x = sig.reshape(-1, BANDS, ROWS)
    v = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, (len(x), 1))
    for k in range(ROWS):
        v = _mix(v + x[:, :, k])
    return v


def _sketch_batches(batches):
    for b in slices(batches):
        sets = shingle_sets(b.column("text").to_pylist())
        keys, bands = [], []
        for s in sets:
            keys.append(set_key(s) if len(s) else None)
            if len(s):
                bands.append(band_values(minhash(s))[0].view(np.int64))
            else:
                bands.append(np.zeros(0, np.int64))
        yield pa.record_batch([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                               pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "bands"])


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """values compared -> fewest matches with which a pair stays: with a uniform prior the posterior
    probability of a similarity of at least t after m matches of n is P(Binomial(n + 1, t) <= m)."""
    out = {}
    for n in range(CHUNK, BANDS * ROWS + 1, CHUNK):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance or m == n:
                break
            m += 1
        out[n] = m
    return out


def _likely(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Places of the pairs (a, b) that survive the incremental comparison."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, m in least.items():
        cols = slice(n - CHUNK, n)
        matches = matches + (sig[a[alive], cols] == sig[b[alive], cols]).sum(1, dtype=np.int32)
        stay = matches >= m
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs (a, b)."""
    used = np.unique(np.concatenate([a, b]))
    if len(a) <= 8 * len(used):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    place = np.zeros(used[-1] + 1, np.int64)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[x]) for x in used])
    _, ids, times = np.unique(np.concatenate([sets[x] for x in used]), return_inverse=True, return_counts=True)
    shared = times[ids] > 1
    _, ids = np.unique(ids[shared], return_inverse=True)
    owner = owner[shared]
    total = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    step = 4096
    for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, step):
        x, y = np.searchsorted(ids, [lo, lo + step])
        m = np.zeros((len(used), step), np.float32)
        m[owner[x:y], ids[x:y] - lo] = 1
        total += m @ m.T  # whole numbers below 2^24: exact
    return total[place[a], place[b]].astype(np.int64)


def sharing_pairs(bands: np.ndarray, side: np.ndarray, one_block: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a < b) of one block, or between its sides 0 and 1, that share a bucket; all its pairs
    where they are fewer than the meetings in buckets."""
    n, ones = len(bands), int(side.sum())
    every = n * (n - 1) // 2 if one_block else ones * (n - ones)
    flat = bands.reshape(-1)
    order = np.argsort(flat, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], flat[order[1:]] != flat[order[:-1]], [True]]))
    size = np.diff(start)
    later = np.repeat(start[1:], size) - np.arange(len(flat)) - 1
    if later.sum() >= every:
        if one_block:
            return np.triu_indices(n, 1)
        return tuple(x.reshape(-1) for x in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
    left = np.repeat(np.arange(len(flat)), later)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
    row = order // BANDS
    a, b = np.minimum(row[left], row[right]), np.maximum(row[left], row[right])
    pairs = np.unique((a * n + b)[(a < b) if one_block else (side[a] != side[b])])
    return pairs // n, pairs % n


def block_links(rep: np.ndarray, side: np.ndarray, one_block: bool, sig: np.ndarray, sets: list[np.ndarray],
                least: dict[int, int], threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (places) of one block, or between its sides 0 and 1."""
    size = np.array([len(s) for s in sets])
    left, right = sharing_pairs(band_values(sig), side, one_block)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(left), 65_536):
        a, b = left[lo:lo + 65_536], right[lo:lo + 65_536]
        keep = _likely(sig, a, b, least)
        found_a.append(a[keep])
        found_b.append(b[keep])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if not len(a):
        return a, b
    common = _common(sets, a, b)
    ok = common * threshold.denominator >= threshold.numerator * (size[a] + size[b] - common)
    return a[ok], b[ok]


def _smallest(n: int, a: np.ndarray, b: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The smallest representative that each place is joined to through the links."""
    label = rep.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def _grouped(batches, keys: list[str]):
    """Consecutive rows with equal keys, as one table each."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        k = [b.column(c).to_numpy(zero_copy_only=False) for c in keys]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
        edges = [0, *change.tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            part = b.slice(lo, hi - lo)
            if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_sketch_batches, "doc_id long, key binary, n long, bands array<long>")


def _units(classes: DataFrame) -> DataFrame:
    """rep, key, copies, unit, partners: the units that each representative's unit meets, itself included.
    Partners come in rows of at most about PARTNERS."""
    flat = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = flat.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("rows")).where("leader < last")
    shared = checkpoint(shared.select("bucket", "leader", "rows"))
    weights = shared.groupBy("leader").agg(F.sum("rows").alias("weight"))
    led = checkpoint(flat.join(shared.select("bucket", "leader").join(weights, "leader"), "bucket"))
    heaviest = F.max(F.struct("weight", (-F.col("leader")).alias("minus"))).alias("top")
    follows = led.groupBy("rep").agg(heaviest).select("rep", (-F.col("top.minus")).alias("leader"))
    members = classes.select("rep", "key", "n", "copies").join(follows, "rep")
    sizes = members.groupBy("leader").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("n_units"))
    unit = F.xxhash64("leader", F.pmod(F.xxhash64("rep", "key"), F.col("n_units")))
    members = checkpoint(members.join(sizes, "leader").select("rep", "key", "copies", unit.alias("unit")))
    inside = led.select("rep", "bucket").join(members.select("rep", "unit"), "rep").groupBy("bucket", "unit").agg(F.count(F.lit(1)).alias("rows"))
    inside = checkpoint(inside)
    mixed = inside.groupBy("bucket").agg(F.min("unit").alias("low"), F.max("unit").alias("high")).where("low < high").select("bucket")
    several = inside.select("bucket", "unit").join(mixed, "bucket")
    meet = several.withColumnRenamed("unit", "i").join(several.withColumnRenamed("unit", "j"), "bucket").where("i < j").select("i", "j").distinct()
    meet = checkpoint(meet.unionByName(inside.where("rows > 1").select(F.col("unit").alias("i"), F.col("unit").alias("j")).distinct()))
    both = meet.select(F.col("i").alias("unit"), F.col("j").alias("partner")).unionByName(
        meet.where("i < j").select(F.col("j").alias("unit"), F.col("i").alias("partner")))
    parts = both.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("n_parts"))
    lists = both.join(parts, "unit").withColumn("part", F.pmod(F.xxhash64("partner"), F.col("n_parts"))).groupBy("unit", "part").agg(
        F.collect_list("partner").alias("partners"))
    return members.join(lists.select("unit", "partners"), "unit")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, copy_class, n_links, n_text_links: one row per row of ``docs``."""
    sketched = checkpoint(sketches(docs, id_col, text_col))
    has_key = F.col("key").isNotNull() & F.col("doc_id").isNotNull()
    keyed = sketched.where(has_key)
    classes = checkpoint(keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    members = _units(classes)
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = rows.join(members, rows["doc_id"] == members["rep"]).select("rep", "key", "copies", "unit", "partners", "text")

    def payload(batches):
        for b in slices(batches):
            sets = shingle_sets(b.column("text").to_pylist())
            keep = [i for i, (s, k) in enumerate(zip(sets, b.column("key").to_pylist())) if len(s) and set_key(s) == k]
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([part.column(c) for c in ("rep", "copies", "unit", "partners", "key")]
                                  + [pa.array([minhash(sets[i]).tobytes() for i in keep], pa.binary()), pa.array([sets[i].tobytes() for i in keep], pa.binary())],
                                  names=["rep", "copies", "unit", "partners", "key", "sig", "shingles"])

    packed = texts.mapInArrow(payload, "rep long, copies long, unit long, partners array<long>, key binary, sig binary, shingles binary")
    dealt = packed.withColumn("other", F.explode("partners")).select(
        F.least("unit", "other").alias("i"), F.greatest("unit", "other").alias("j"), "unit", "rep", "copies", "key", "sig", "shingles")
    least, limit = least_matches(threshold), Fraction(threshold).limit_denominator(1_000_000)

    def compare(batches):
        for t in _grouped(batches, ["i", "j"]):
            keys = t.column("key").to_pylist()
            first = [k for k, x in enumerate(keys) if x not in keys[:k]] if len(keys) < 3 else sorted({x: k for k, x in reversed(list(enumerate(keys)))}.values())
            if len(first) < 2:
                continue
            t = t.take(pa.array(first, pa.int64()))
            rep, copies, side = (t.column(c).to_numpy() for c in ("rep", "copies", "unit"))
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            sig = np.stack([np.frombuffer(x, np.uint32) for x in t.column("sig").to_pylist()])
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            a, b = block_links(rep, (side == j).astype(int), i == j, sig, sets, least, limit)
            if not len(a):
                continue
            n = len(rep)
            texts_linked = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            docs_linked = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            label = _smallest(n, a, b, rep)
            use = np.flatnonzero(texts_linked)
            yield pa.record_batch([pa.array([t.column("key")[int(k)].as_py() for k in use], pa.binary()), pa.array(rep[use]), pa.array(label[use]), pa.array(texts_linked[use].astype(np.int64)), pa.array(docs_linked[use].astype(np.int64))],
                                  names=["key", "rep", "label", "texts", "docs"])

    found = checkpoint(dealt.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(
        compare, "key binary, rep long, label long, texts long, docs long"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    totals = found.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    per_class = classes.select("key", "rep", "copies").join(totals, "key", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("key").alias("ckey"), F.col("rep").alias("copy_class"), F.coalesce("root", "rep").alias("class_id"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    linked = keyed.select("doc_id", "key").join(per_class, F.col("key") == F.col("ckey")).select(
        "doc_id", "class_id", "copy_class", F.col("n_links").cast("long").alias("n_links"), F.col("n_text_links").cast("long").alias("n_text_links"))
    alone = sketched.where(~has_key).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_class"),
                                            F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of every linked group: the one with the smallest id, once if its row
    repeats. Rows without an id are not compared and stay."""
    marked = checkpoint(links(docs, threshold=threshold))
    away = marked.where("class_id <> doc_id").select(F.col("doc_id").alias("away_id")).distinct()
    again = marked.where("class_id = doc_id").groupBy(F.col("doc_id").alias("away_id")).count().where("count > 1").select("away_id")
    out = away.unionByName(again)
    kept = docs.join(out, docs["doc_id"] == out["away_id"], "left_anti")
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(again, docs["doc_id"] == again["away_id"], "left_semi").dropDuplicates(["doc_id"]))
