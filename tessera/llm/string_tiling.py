"""Benchmark decontamination by greedy string tiling.

Shared seeds (MIN_MATCH equal tokens in a row) join documents with benchmark items; a pair whose
seeds could cover enough of the item goes to greedy string tiling: running Karp-Rabin finds the
matches of a search length, the longest non-overlapping ones are marked as tiles, and the length is
lowered until MIN_MATCH. Tiles may stand in any order, so reordered passages count. A document is
contaminated by an item if its tiles cover at least ``threshold`` of the item's tokens.

Tokens are lower-cased runs between white space and ASCII punctuation. Both steps see whole texts.

Defined cases: null or empty texts have no tokens and match nothing; an item of fewer than MIN_MATCH
tokens can't be told from chance and matches nothing; repeated documents are reported one by one,
repeated items each under its own id; with equal lengths the earlier place is marked first; an empty
benchmark or table gives an empty result (as a filter: all rows). Other columns are ignored.

Tokens and seeds are compared as 64-bit hashes; different tokens of equal hash are expected once in
some 10^19 pairs.

Scale: the benchmark stays a table of any size. Tasks know it by two bitmaps of fixed size (FILTER_BITS):
the seeds of all items, and the selective ones. An item's selective seeds are those left when its seeds
that most items share go, as long as the ones gone could not reach ``threshold`` together: a
contaminated document holds a selective seed for certain, and a phrase that opens every item brings no
pairs. One scan of the documents cuts those with a selective seed down to the stretches that seeds cover;
these meet the items in hash joins, on seeds and then on the pairs found, and each pair is tiled as one
row. Equal items and repeated documents are tiled once. False hits of the bitmaps go in the joins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, id_and_text, slices

MIN_MATCH = 5
THRESHOLD = 0.5
#: Bits of each bitmap of seeds: 4 MB, whatever the benchmark.
FILTER_BITS = 1 << 25
_BUCKET = 32_768  # bits of one aggregate of Spark's bitmap functions
FIRST_LENGTH = 20
#: Keys of 32 bytes that a filter may broadcast: 8 MB.
BROADCAST_KEYS = 1 << 18
_PUNCT = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x1c\x1d\x1e\x1f" else i for i in range(256))
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_PUNCT).split()


class _Hashes:
    """Karp-Rabin hashes of all windows of a token list, from running sums."""

    def __init__(self, seq: list[int]):
        self.sums = [0]
        for t in seq:
            self.sums.append((self.sums[-1] * _BASE + t + 7) % _PRIME)

    def of(self, k: int, n: int, lead: int) -> int:
        return (self.sums[k + n] - self.sums[k] * lead) % _PRIME


def _runs(free: list[bool]) -> list[int]:
    """How many tokens from each place on are free."""
    out, n = [0] * len(free), 0
    for k in range(len(free) - 1, -1, -1):
        n = n + 1 if free[k] else 0
        out[k] = n
    return out


def _scan(doc, item, dhash, ihash, dfree, ifree, s: int, power) -> list[tuple[int, int, int]]:
    """Maximal matches (length, doc place, item place) of at least ``s`` unmarked tokens, found by
    Karp-Rabin: every free doc window of ``s`` tokens is hashed, every free item window looked up.

    A match starts where the tokens on its left differ, so places are kept by the token on their left and
    only those with another one are met; its end is found by halving on hashes. Runs of equal tokens so
    cost no more than others."""
    druns, iruns, lead = _runs(dfree), _runs(ifree), power(s)
    left = lambda seq, free, k: seq[k - 1] if k and free[k - 1] else None
    places: dict[int, dict[int | None, list[int]]] = {}
    for k in range(len(doc) - s + 1):
        if druns[k] >= s:
            places.setdefault(dhash.of(k, s, lead), {}).setdefault(left(doc, dfree, k), []).append(k)
    found = []
    for j in range(len(item) - s + 1):
        if iruns[j] < s:
            continue
        own = left(item, ifree, j)
        for before, at in places.get(ihash.of(j, s, lead), {}).items():
            if before is not None and before == own:
                continue  # part of a match that starts earlier
            for i in at:
                sure, most = s, min(druns[i], iruns[j])
                while sure < most:  # the longest prefix with equal hashes
                    n = (sure + most + 1) // 2
                    if dhash.of(i, n, power(n)) == ihash.of(j, n, power(n)):
                        sure = n
                    else:
                        most = n - 1
                found.append((sure, i, j))
    return found


def tiles(doc: list[int], item: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc place, item place, length) of the tiles. Negative tokens match nothing."""
    dfree, ifree = [t >= 0 for t in doc], [t >= 0 for t in item]
    dhash, ihash, leads = _Hashes(doc), _Hashes(item), {}

    def power(n: int) -> int:
        if n not in leads:
            leads[n] = pow(_BASE, n, _PRIME)
        return leads[n]

    s, out = max(min_match, FIRST_LENGTH), []
    while True:
        found = _scan(doc, item, dhash, ihash, dfree, ifree, s, power)
        longest = max((x[0] for x in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        marked = False
        for n, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            # equal hashes are confirmed on the tokens before a tile is marked
            if dfree[i] and ifree[j] and dfree[i + n - 1] and ifree[j + n - 1] and all(dfree[i:i + n]) and all(ifree[j:j + n]) and doc[i:i + n] == item[j:j + n]:
                dfree[i:i + n] = [False] * n
                ifree[j:j + n] = [False] * n
                out.append((i, j, n))
                marked = True
        if marked:
            continue  # what a tile has cut may still hold matches of this length
        if s <= min_match:
            return sorted(out)
        s = max(min_match, s // 2)


def hashed_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed tokens of all texts in a row, and where each text begins in it (one more at the end)."""
    lists = [tokens(t) for t in texts]
    flat = [w for x in lists for w in x]
    distinct = dict.fromkeys(flat)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)
    for n, w in enumerate(distinct):
        distinct[w] = n
    words = hashes[np.fromiter(map(distinct.__getitem__, flat), np.int64, len(flat))]
    return words, np.cumsum([0, *map(len, lists)])


def seeds_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k tokens."""
    n = max(len(words) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(k if n else 0):
        h = (h ^ words[i:i + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def spread(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places the windows of k places at ``at`` cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + k, -1)
    return np.cumsum(change[:-1]) > 0


def selective(seeds: np.ndarray, shared_by: dict[int, int], k: int, threshold: float) -> np.ndarray:
    """The distinct seeds of an item left when the most shared ones go while they cover less than
    ``threshold`` of its tokens. ``shared_by``: seed -> items that hold it."""
    n = len(seeds) + k - 1
    distinct, first = np.unique(seeds, return_inverse=True)
    order = np.lexsort((distinct, -np.array([shared_by[int(x)] for x in distinct.view(np.int64)])))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    of_place = rank[first]  # of each window: when its seed goes
    none, all_gone = 0, len(order)
    while all_gone - none > 1:  # the most seeds that may go: covering grows with them
        mid = (none + all_gone) // 2
        if spread(np.flatnonzero(of_place < mid), k, n).sum() / n < threshold:
            none = mid
        else:
            all_gone = mid
    return distinct[order[none:]]


def tile_pair(places: np.ndarray, words: np.ndarray, item: np.ndarray, k: int, threshold: float) -> tuple[float, list] | None:
    """Coverage and tiles of an item by the kept stretches of a document (hashed tokens and their places),
    None below ``threshold``."""
    own, wanted = seeds_of(words, k), seeds_of(item, k)
    own_ok = places[k - 1:] - places[:len(own)] == k - 1  # windows inside one stretch
    shared = own_ok & np.isin(own, wanted)
    if spread(np.flatnonzero(np.isin(wanted, own[shared])), k, len(item)).sum() / len(item) < threshold:
        return None  # tiles are made of shared seeds
    keep = np.flatnonzero(spread(np.flatnonzero(shared), k, len(words)))
    vocab, numbered = np.unique(item, return_inverse=True)
    doc, at, before = [], [], None
    for p, t in zip(places[keep].tolist(), np.searchsorted(vocab, words[keep]).tolist()):
        if before is not None and p != before + 1:
            doc.append(-1)  # other tokens in between: no tile crosses them
            at.append(-1)
        doc.append(t)
        at.append(p)
        before = p
    found = [(at[i], j, m) for i, j, m in tiles(doc, numbered.tolist(), k)]
    covered = sum(m for _, _, m in found) / len(item)
    return (covered, found) if covered >= threshold else None


def bitmap(seeds: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those at the seeds' hashes set: at most FILTER_BITS / 32768 rows of 4 kB to the driver."""
    at = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    rows = seeds.select(at.alias("at")).groupBy(F.floor(F.col("at") / _BUCKET).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("at") % _BUCKET).alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[r.bucket * _BUCKET // 8:(r.bucket + 1) * _BUCKET // 8] = r.bits
    return np.frombuffer(bytes(out), np.uint8)


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _items(benchmark: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """item_id, content, words: the hashed tokens of items long enough, equal ones with equal ``content``."""
    def read(batches):
        for b in slices(batches):
            words, start = hashed_tokens(b.column("text").to_pylist())
            long = np.flatnonzero(np.diff(start) >= k)
            parts = [words[start[i]:start[i + 1]].tobytes() for i in long]
            yield pa.record_batch([b.column("doc_id").take(pa.array(long)), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in parts], pa.binary()),
                                   pa.array(parts, pa.binary())], names=["item_id", "content", "words"])
    rows = id_and_text(benchmark, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(read, "item_id long, content binary, words binary")


def _selective(contents: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(seed, content) of all seeds of the distinct items, and of the selective ones."""
    def all_seeds(batches):
        for b in batches:
            for content, words in zip(b.column("content"), b.column("words").to_pylist()):
                h = np.unique(seeds_of(np.frombuffer(words, np.uint64), k)).view(np.int64)
                yield pa.record_batch([pa.array(h), pa.array([content.as_py()] * len(h), pa.binary())], names=["seed", "content"])

    def choose(batches):
        for b in batches:
            for content, words, seeds, times in zip(*(b.column(c).to_pylist() for c in ("content", "words", "seeds", "times"))):
                h = selective(seeds_of(np.frombuffer(words, np.uint64), k), dict(zip(seeds, times)), k, threshold).view(np.int64)
                yield pa.record_batch([pa.array(h), pa.array([content] * len(h), pa.binary())], names=["seed", "content"])

    every = checkpoint(contents.mapInArrow(all_seeds, "seed long, content binary"))
    times = every.groupBy("seed").agg(F.count(F.lit(1)).alias("times"))
    of_item = every.join(times, "seed").groupBy("content").agg(F.collect_list(F.struct("seed", "times")).alias("held"))  # an item's own seeds
    known = contents.join(of_item, "content").select("content", "words", F.col("held.seed").alias("seeds"), F.col("held.times").alias("times"))
    return every, checkpoint(known.mapInArrow(choose, "seed long, content binary"))


def _row_key() -> Column:
    """256 bits that name a row's id and text."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))), 256))


def _touched(docs: DataFrame, every: np.ndarray, chosen: np.ndarray, k: int) -> DataFrame:
    """key, doc_id, places, words, seeds of the documents with a selective seed: the tokens that seeds of
    items cover, and the selective seeds."""
    def touch(batches):
        for b in slices(batches):
            words, start = hashed_tokens(b.column("text").to_pylist())
            h = seeds_of(words, k)
            row = np.repeat(np.arange(b.num_rows), np.diff(start))
            hit = np.flatnonzero(_holds(every, h))
            hit = hit[row[hit] == row[hit + k - 1]]
            good = hit[_holds(chosen, h[hit])]
            use = np.unique(row[good])
            if not len(use):
                continue
            at = np.flatnonzero(spread(hit, k, len(words)))
            cut = lambda x, r: x[np.searchsorted(row[x], r):np.searchsorted(row[x], r, "right")]
            own = [cut(at, r) for r in use]
            yield pa.record_batch([*(b.column(c).take(pa.array(use)) for c in ("key", "doc_id")),
                                   pa.array([(x - start[r]).tobytes() for x, r in zip(own, use)], pa.binary()),
                                   pa.array([words[x].tobytes() for x in own], pa.binary()),
                                   pa.array([np.unique(h[cut(good, r)]).view(np.int64) for r in use], pa.list_(pa.int64()))],
                                  names=["key", "doc_id", "places", "words", "seeds"])
    rows = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("key", _row_key())
    return rows.mapInArrow(touch, "key binary, doc_id long, places binary, words binary, seeds array<long>")


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The touched documents, the items, and key, content, coverage, n_tiles, tiles of the contaminated pairs."""
    items = checkpoint(_items(benchmark, "item_id", "text", k))
    contents = items.groupBy("content").agg(F.first("words").alias("words"))
    every, chosen = _selective(contents, k, threshold)
    touched = checkpoint(_touched(docs, bitmap(every), bitmap(chosen), k))
    single = touched.groupBy("key").agg(F.first("places").alias("places"), F.first("words").alias("doc_words"), F.first("seeds").alias("seeds"))
    pairs = touched.select("key", F.explode("seeds").alias("seed")).distinct().join(chosen, "seed").select("key", "content").distinct()
    rows = pairs.join(single.drop("seeds"), "key").join(contents, "content")

    def tile(batches):
        for b in batches:
            out = []
            for key, content, places, words, item in zip(*(b.column(c) for c in ("key", "content", "places", "doc_words", "words"))):
                hit = tile_pair(np.frombuffer(places.as_py(), np.int64), np.frombuffer(words.as_py(), np.uint64), np.frombuffer(item.as_py(), np.uint64), k, threshold)
                if hit:
                    out.append((key.as_py(), content.as_py(), hit[0], len(hit[1]), ",".join(f"{i}:{j}:{n}" for i, j, n in hit[1])))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.float64(), pa.int64(), pa.string()))],
                                      names=["key", "content", "coverage", "n_tiles", "tiles"])

    return touched, items, checkpoint(rows.mapInArrow(tile, "key binary, content binary, coverage double, n_tiles long, tiles string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH) -> DataFrame:
    """One row per document and item that contaminates it: coverage of the item and the tiles as
    doc place:item place:tokens, by doc place."""
    touched, items, found = _found(docs, benchmark, threshold, min_match)
    return touched.select("key", "doc_id").join(found, "key").join(items.select("item_id", "content"), "content").select(
        "doc_id", "item_id", "coverage", "n_tiles", "tiles")


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH) -> DataFrame:
    """The rows of ``docs`` that no item contaminates; columns as they were. The keys of the others are
    broadcast if a count finds at most BROADCAST_KEYS of them, else the rows meet them in a shuffle."""
    bad = _found(docs, benchmark, threshold, min_match)[2].select(F.col("key").alias("bad_key")).distinct()
    few = bad.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(bad) if few else bad, _row_key() == bad["bad_key"], "left_anti")
