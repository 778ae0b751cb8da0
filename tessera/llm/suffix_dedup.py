"""Removal of repeated byte strings with suffix arrays.

A byte goes if some MIN_LENGTH-byte string over it also starts earlier (smaller doc_id, or earlier in
the same document); matches stay inside documents and overlaps count. Steps:

1. Shards of about SHARD_BYTES bytes: the suffix array of a shard comes from Larsson-Sadakane
   refinement (sort by a few bytes, then sort again only inside groups of equal prefixes by the rank
   h bytes on, doubling h), common prefixes of neighbours from Kasai's rule. Of every set of equal
   strings in a shard all but the first are repeats.
2. Strings that are left meet across shards at anchors: of the grams of GRAM bytes in a string the one
   with the least hash, so that equal strings have equal anchors. Neighbouring strings with one
   anchor are one context, a row. Sorted by anchor, equal contexts of several shards are repeats but
   for the first, anchors of one context are done, and contexts that differ go to step 3.
3. The strings of differing contexts of one anchor are merged: each one's hash is looked up, by binary
   search, among those of the contexts before it. Where an anchor has more than MANY contexts (the
   edges of a passage that many documents share), its strings are dealt out by their own hashes.
4. The spans of all steps meet the text again, which is cut.

Strings are compared by 64-bit polynomial hashes over random byte values in steps 2 and 3, by bytes in
step 1.

Defined cases: a null text is the empty text; texts under MIN_LENGTH bytes keep all; repeated rows of
an id are one document (each row gets the same result, an id is taken to name one text); a row
without an id is neither cut nor looked at; an empty table gives an empty result; other columns are
ignored.

Scale: a document longer than a shard is cut into segments that overlap by MIN_LENGTH - 1 bytes, so a
shard is bounded. About one row in 40 bytes that no shard has resolved is shuffled; a passage that
many documents share sends one row per shard and anchor, not one per document. Steps 2 and 3 stream
over sorted rows; what a task holds is bounded by its batch and MANY contexts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_BYTES, checkpoint, id_and_text, slices

MIN_LENGTH = 100
SHARD_BYTES = (1 << 20) - 1
GRAM = 20
#: Contexts of one anchor up to which they are merged in one task; the strings of more are dealt by hash.
MANY = 500
_R = np.random.default_rng(4_099)
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = _POWERS.get(int(base))
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _POWERS[int(base)] = p = np.cumprod(p)
    return p[:n]


class Hashes:
    """Polynomial hashes of any stretch of ``text``."""

    def __init__(self, text: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[text] * _powers(_BASE, len(text)))])
        self.back = _powers(_INVERSE, len(text) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffix array sorted by at least ``depth`` bytes, its places whose suffix shares ``h`` bytes with
    the one before, h), for texts under 2^20 bytes. Suffixes equal to that depth stand by place."""
    n = len(text)
    values = np.flatnonzero(np.bincount(text, minlength=256))
    bits = max(1, int(len(values)).bit_length())
    h = max(1, min(43 // bits, depth))
    low = np.uint64(20)
    mask = np.uint64((1 << 20) - 1)
    code = np.zeros(256, np.uint64)
    code[values] = np.arange(1, len(values) + 1)
    # h bytes at every place as one number, from 1, 2, 4 .. bytes
    of, size = {1: np.concatenate([code[text], np.zeros(h, np.uint64)])}, 1
    while size * 2 <= h:
        of[size * 2] = (of[size][:-size] << np.uint64(bits * size)) | of[size][size:]
        size *= 2
    key, done = of[size][:n], size
    while done < h:
        size = 1 << ((h - done).bit_length() - 1)
        key, done = (key << np.uint64(bits * size)) | of[size][done:done + n], done + size
    del of
    key = (key << low) | np.arange(n, dtype=np.uint64)
    key.sort()
    sa = (key & mask).astype(np.int64)
    key >>= low
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(n + 1, np.int64)
    place = np.flatnonzero(new)
    rank[sa] = np.repeat(place, np.diff(np.append(place, n))) + 1  # 0: past the end
    open_at = np.flatnonzero(~(new & np.append(new[1:], True)))
    close = np.flatnonzero(~new)
    shared = h
    while h < depth and len(open_at):
        shared, close = h, open_at[~new[open_at]]
        at = sa[open_at]
        key = (((rank[at] - 1).astype(np.uint64) << np.uint64(41)) | (rank[np.minimum(at + h, n)].astype(np.uint64) << low) | at.astype(np.uint64))
        key.sort()
        at = (key & mask).astype(np.int64)
        sa[open_at] = at
        key >>= low
        first = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(first)
        rank[at] = np.repeat(open_at[starts], np.diff(np.append(starts, len(at)))) + 1
        new[open_at] = first
        open_at = open_at[~(first & np.append(first[1:], True))]
        h *= 2
    return sa, close, shared


def common_prefixes(text: np.ndarray, sa: np.ndarray, places: np.ndarray, shared: int, depth: int) -> np.ndarray:
    """Common prefix, up to ``depth`` bytes, of the suffixes at ``places`` of the array with those
    before them, all at least ``shared``. Kasai's rule: where both suffixes of a pair are one byte on
    from those of the pair before, the common prefix is one byte less (the array is not sorted beyond
    some depth, so other pairs start at ``shared``); stretches of text are walked in step."""
    if not len(places):
        return np.zeros(0, np.int64)
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + depth + 8, 8), (1, 1))
    words = np.ascontiguousarray(words).view(np.uint64).reshape(-1)
    order = np.argsort(sa[places], kind="stable")
    here, there = sa[places][order], sa[places - 1][order]
    run = np.cumsum(np.concatenate([[True], np.diff(here) != 1])) - 1
    begin = np.flatnonzero(np.concatenate([[True], np.diff(run) != 0]))
    step = (np.arange(len(here)) - begin[run]) % 32
    lane_start = np.flatnonzero(step == 0)
    lane_len = np.diff(np.append(lane_start, len(here)))
    out = np.zeros(len(here), np.int64)
    lanes, value = np.arange(len(lane_start)), np.full(len(lane_start), shared, np.int64)
    for s in range(int(lane_len.max())):
        lanes = lanes[lane_len[lanes] > s]
        at = lane_start[lanes] + s
        i, j = here[at], there[at]
        v = np.where((there[at - 1] + 1 == j) & (s > 0), np.maximum(value[lanes] - 1, shared), shared)
        todo = np.flatnonzero(v < depth)
        while len(todo):
            diff = words[i[todo] + v[todo]] ^ words[j[todo] + v[todo]]
            equal = np.zeros(len(todo), np.int64)
            for k in range(1, 9):
                equal += (diff << np.uint64(64 - 8 * k)) == 0
            v[todo] += equal
            v[todo] = np.minimum(v[todo], np.minimum(depth, n - np.maximum(i[todo], j[todo])))
            todo = todo[(equal == 8) & (v[todo] < depth) & (v[todo] < n - np.maximum(i[todo], j[todo]))]
        value[lanes] = v
        out[at] = v
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back]


def repeats_in_shard(text: np.ndarray, valid: np.ndarray, owner: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """Marks the starts in ``valid`` whose string of ``depth`` bytes also starts earlier (owner, place)."""
    sa, places, shared = suffix_array(text, depth)
    places = places[common_prefixes(text, sa, places, shared, depth) >= depth]
    out = np.zeros(len(text), bool)
    if not len(places):
        return out
    joined = np.zeros(len(sa) + 1, bool)
    joined[places] = True
    member = joined[:-1] | joined[1:]
    group = np.cumsum(~joined[:-1])[member]
    start = sa[member]
    keep = valid[start]
    group, start = group[keep], start[keep]
    if not len(start):
        return out
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    first = np.repeat(np.minimum.reduceat(start, edge), np.diff(np.append(edge, len(start))))
    out[start[(owner[start] != owner[first]) | (place[start] != place[first])]] = True
    return out


def anchors(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash at each place, place of the least gram of the string that starts there)."""
    n, width = len(text), depth - GRAM + 1
    h, size = [_BYTE[text]], 1
    while size * 2 <= GRAM:
        last = h[-1]
        h.append(last[:-size] * np.uint64(pow(int(_BASE), size, 1 << 64)) + last[size:] if len(last) > size else last[:0])
        size *= 2
    grams, done = h[-1], size
    for k in range(len(h) - 2, -1, -1):
        part = 1 << k
        if GRAM - done >= part:
            m = max(0, n - done - part + 1)
            grams = grams[:m] * np.uint64(pow(int(_BASE), part, 1 << 64)) + h[k][done:done + m]
            done += part
    grams = _mix(grams)
    low = np.uint64((1 << 20) - 1)
    least, size = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:]) if len(least) > size else least[:0]
        size *= 2
    rest = width - size
    if rest:
        least = np.minimum(least[:-rest], least[rest:]) if len(least) > rest else least[:0]
    return grams, (least & low).astype(np.int64)


def _shards(batches, depth: int):
    """Lists of (doc_id, first byte, bytes) of at most SHARD_BYTES bytes."""
    held, size = [], 0
    for b in slices(batches):
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            t = text.encode("utf-8", "replace")
            if len(t) < depth:
                continue
            step = SHARD_BYTES // 2
            for base in range(0, len(t) - depth + 1, step):
                part = t[base:base + step + depth - 1]
                if size + len(part) > SHARD_BYTES:
                    yield held
                    held, size = [], 0
                held.append((doc_id, base, part))
                size += len(part)
    if held:
        yield held


def _runs(marked: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the runs of neighbouring marked places with equal values in ``same``."""
    at = np.flatnonzero(marked)
    if not len(at):
        return at, at
    cut = np.diff(at) != 1
    for x in same:
        cut |= x[at][1:] != x[at][:-1]
    first = np.flatnonzero(np.concatenate([[True], cut]))
    return at[first], np.diff(np.append(first, len(at)))


ROWS = "gram long, ctx long, doc_id long, start long, shape int"


def _shard_rows(depth: int):
    """Rows of a shard: runs of repeated starts (shape: minus their number) and the contexts of the rest
    (shape: number of strings * 128 + distance of the anchor from the first)."""
    def work(batches):
        for shard in _shards(batches, depth):
            shard.sort(key=lambda x: (x[0], x[1]))
            text = np.frombuffer(b"".join(t for _, _, t in shard), np.uint8)
            lens = np.array([len(t) for _, _, t in shard])
            begin = np.cumsum(lens) - lens
            ids, base = np.array([x[0] for x in shard], np.int64), np.array([x[1] for x in shard], np.int64)
            seg = np.repeat(np.arange(len(shard)), lens)
            place = np.arange(len(text)) - begin[seg] + base[seg]
            owner = ids[seg]
            valid = np.arange(len(text)) <= (begin + lens - depth)[seg]
            again = repeats_in_shard(text, valid, owner, place, depth)
            first, number = _runs(again, seg)
            k = len(first)
            parts = [(owner[first] ^ place[first], np.zeros(k, np.int64), owner[first], place[first], -number)]
            grams, anchor = anchors(text, depth)
            rest = (valid & ~again)[:len(anchor)]
            first, number = _runs(rest, seg[:len(anchor)], anchor)
            if len(first):
                q = anchor[first]
                shape = number * 128 + q - first
                ctx = Hashes(text).of(first, first + number - 1 + depth) ^ _mix(shape.astype(np.uint64))
                parts.append((grams[q].view(np.int64), ctx.view(np.int64), owner[first], place[first], shape))
            cols = [np.concatenate(c) for c in zip(*parts)]
            yield pa.record_batch([pa.array(c) for c in cols[:4]] + [pa.array(cols[4].astype(np.int32))], names=["gram", "ctx", "doc_id", "start", "shape"])
    return work


def _across(batches):
    """Over rows sorted by gram, ctx, doc_id, start: repeats (as runs of starts) and, for grams with
    several contexts, the first row of each context."""
    gram = ctx = first = head = None
    for b in batches:
        if not b.num_rows:
            continue
        g, c, d, s, shape = (b.column(x).to_numpy() for x in ("gram", "ctx", "doc_id", "start", "shape"))
        local = shape < 0
        out = [(g[local], d[local], s[local], shape[local])]
        g, c, d, s, shape = (x[~local] for x in (g, c, d, s, shape))
        if len(g):
            if gram is not None:  # the row before, so that it is compared like any other
                g, c, d, s, shape = (np.concatenate([[x], y]) for x, y in ((gram, g), (ctx, c), (first[0], d), (first[1], s), (first[2], shape)))
            new_g = np.concatenate([[True], g[1:] != g[:-1]])
            new_c = new_g | np.concatenate([[True], c[1:] != c[:-1]])
            at, k = np.arange(len(g)), 1 if gram is not None else 0
            of_ctx, of_gram = np.maximum.accumulate(np.where(new_c, at, 0)), np.maximum.accumulate(np.where(new_g, at, 0))
            again = (d != d[of_ctx]) | (s != s[of_ctx])
            again[:k] = False
            out.append((g[again], d[again], s[again], -(shape[again] // 128)))
            other = new_c & ~new_g
            out.append((g[other], d[other], s[other], shape[other]))
            heads = np.unique(of_gram[other])
            if k and len(heads) and heads[0] == 0:  # the first context of the gram may stand before this batch
                heads = heads[1:]
                if head is not None:
                    out.append(tuple(np.array([x]) for x in (gram, *head)))
                    head = None
            out.append((g[heads], d[heads], s[heads], shape[heads]))
            last = of_gram[-1]
            if new_g[last] and (last or not k):
                head = None if last in heads else (d[last], s[last], shape[last])
            gram, ctx, f = g[-1], c[-1], of_ctx[-1]
            first = (d[f], s[f], shape[f])
        cols = [np.concatenate(x) for x in zip(*out)]
        if len(cols[0]):
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in cols[:3]] + [pa.array(cols[3].astype(np.int32))], names=["gram", "doc_id", "start", "shape"])


def _packed(batches):
    """(doc_id, compressed text): what the joins by document shuffle."""
    z = zstandard.ZstdCompressor(level=3)
    for b in slices(batches):
        yield pa.record_batch([b.column("doc_id"), pa.array([z.compress(t.encode("utf-8", "replace")) for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "packed"])


def _unpack(column) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in column.to_pylist()]


def packed_texts(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(_packed, "doc_id long, packed binary")


def _string_keys(grams: np.ndarray, shape: np.ndarray, raw: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place in the row) of every string of the contexts given: equal strings of one anchor
    have it at equal distance, so gram, distance and bytes go into the hash."""
    lens = np.array([len(x) for x in raw])
    hashes, begin = Hashes(np.frombuffer(b"".join(raw), np.uint8)), np.cumsum(lens) - lens
    number, back = shape // 128, shape % 128
    row = np.repeat(np.arange(len(raw)), number)
    k = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    return _mix(hashes.of(begin[row] + k, begin[row] + k + depth) + _mix(grams[row].view(np.uint64) + (back[row] - k).astype(np.uint64))), row, k


CONTEXTS = "part long, doc_id long, start long, shape int, bytes binary"


def _context_bytes(depth: int):
    """Rows of the contexts asked for: one with its bytes (part: the gram) or, of an anchor with many,
    one for each of its strings (part: the string's hash; shape 0)."""
    def work(batches):
        for b in slices(batches, "packed", SLICE_BYTES // 2):
            few, many = [], []
            for doc_id, t, asked in zip(b.column("doc_id").to_pylist(), _unpack(b.column("packed")), b.column("asked").to_pylist()):
                for x in asked:
                    (many if x["many"] else few).append((x["gram"], doc_id, x["start"], x["shape"], t[x["start"]:x["start"] + x["shape"] // 128 - 1 + depth]))
            names = ["part", "doc_id", "start", "shape", "bytes"]
            if few:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*few), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=names)
            for lo in range(0, len(many), 20_000):
                g, d, s, shape, raw = zip(*many[lo:lo + 20_000])
                key, row, k = _string_keys(np.array(g, np.int64), np.array(shape, np.int64), list(raw), depth)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.array(d, np.int64)[row]), pa.array(np.array(s, np.int64)[row] + k),
                                       pa.array(np.zeros(len(row), np.int32)), pa.array([b""] * len(row), pa.binary())], names=names)
    return work


def _merge(depth: int):
    """Over contexts sorted by part, doc_id, start: the starts whose string an earlier context has.
    Of single strings all but the first of each hash go; contexts are looked up in those before."""
    def work(batches):
        string = None  # the hash that single strings last had, with its first place
        gram, known = None, np.zeros(0, np.uint64)  # strings seen of the gram that goes on, sorted
        known_at = np.zeros((0, 2), np.int64)
        for b in batches:
            single = b.filter(pc.equal(b.column("shape"), 0))
            if single.num_rows:
                g, d, s = (single.column(x).to_numpy() for x in ("part", "doc_id", "start"))
                if string is not None:
                    g, d, s = (np.concatenate([[x], y]) for x, y in zip(string, (g, d, s)))
                at = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), np.arange(len(g)), 0))
                again = (d != d[at]) | (s != s[at])
                if again.any():
                    yield pa.record_batch([pa.array(d[again]), pa.array(s[again]), pa.array(np.ones(int(again.sum()), np.int64))], names=["doc_id", "start", "number"])
                string = (g[-1], d[at[-1]], s[at[-1]])
            b = b.filter(pc.greater(b.column("shape"), 0))
            if not b.num_rows:
                continue
            g, d, s, shape = (b.column(x).to_numpy() for x in ("part", "doc_id", "start", "shape"))
            key, row, k = _string_keys(g, shape, b.column("bytes").to_pylist(), depth)
            owner, start = d[row], s[row] + k
            if gram is None or g[0] != gram:
                known, known_at = known[:0], known_at[:0]
            # binary search of every string among the merged ones before this batch, then among this batch's own
            distinct, at = np.unique(key, return_index=True)  # rows are in order, so the first index is the earliest
            hit = np.searchsorted(distinct, key)
            first_owner, first_start = owner[at][hit], start[at][hit]
            if len(known):
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                old = known[place] == key
                first_owner, first_start = np.where(old, known_at[place, 0], first_owner), np.where(old, known_at[place, 1], first_start)
            again = (owner != first_owner) | (start != first_start)
            first, n = _runs(again, row)
            # neighbouring marked strings of one row are neighbouring starts
            if len(first):
                yield pa.record_batch([pa.array(owner[first]), pa.array(start[first]), pa.array(n.astype(np.int64))], names=["doc_id", "start", "number"])
            if gram is None or g[-1] != gram:
                known, known_at = known[:0], known_at[:0]
            gram = g[-1]
            mine = np.flatnonzero((g[row[at]] == gram))
            fresh = mine if not len(known) else mine[known[np.minimum(np.searchsorted(known, distinct[mine]), len(known) - 1)] != distinct[mine]]
            merged = np.concatenate([known, distinct[fresh]])
            order = np.argsort(merged, kind="stable")
            known, known_at = merged[order], np.concatenate([known_at, np.stack([owner[at[fresh]], start[at[fresh]]], 1)])[order]
    return work


def repeated_spans(docs: DataFrame, min_length: int = MIN_LENGTH, packed: DataFrame | None = None) -> DataFrame:
    """doc_id, start, number: runs of starts (byte offsets) whose string of ``min_length`` bytes also
    starts earlier. ``docs`` has doc_id and text; ``packed`` its ``packed_texts``, if a caller has them."""
    if not GRAM <= min_length <= GRAM + 100:
        raise ValueError(f"min_length must be {GRAM} to {GRAM + 100}")
    named = docs.where(F.col("doc_id").isNotNull())
    rows = named.mapInArrow(_shard_rows(min_length), ROWS)
    found = checkpoint(rows.repartition("gram").sortWithinPartitions("gram", "ctx", "doc_id", "start").mapInArrow(
        _across, "gram long, doc_id long, start long, shape int"))
    differ = found.where("shape > 0")
    many = differ.groupBy(F.col("gram").alias("many_gram")).count().where(F.col("count") > MANY).select("many_gram", F.lit(True).alias("many"))
    flagged = differ.join(many, F.col("gram") == F.col("many_gram"), "left").withColumn("many", F.coalesce("many", F.lit(False)))
    asked = flagged.groupBy(F.col("doc_id").alias("asked_id")).agg(F.collect_list(F.struct("gram", "start", "shape", "many")).alias("asked"))
    packed = packed_texts(named) if packed is None else packed
    one_row = packed.join(asked, F.col("doc_id") == F.col("asked_id")).select("doc_id", "packed", "asked")
    contexts = one_row.mapInArrow(_context_bytes(min_length), CONTEXTS)
    merged = contexts.repartition("part").sortWithinPartitions("part", "doc_id", "start").mapInArrow(_merge(min_length), "doc_id long, start long, number long")
    return found.where("shape < 0").select("doc_id", "start", (-F.col("shape")).cast("long").alias("number")).unionByName(merged)


def cut_text(text: bytes, spans: list[tuple[int, int]], min_length: int) -> tuple[bytes, int]:
    """What is left of ``text`` without the bytes under the runs of starts, and how many stretches went."""
    if not spans:
        return text, 0
    kept, end, n = [], 0, 0
    stretch = None
    for start, number in sorted(spans):
        stop = start + number - 1 + min_length
        if stretch is None or start > stretch:
            kept.append(text[end:start])
            n += 1
            stretch = stop
        else:
            stretch = max(stretch, stop)
        end = stretch
    return b"".join([*kept, text[end:]]), n


def remove_repeats(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_bytes``, kept: one row per row of ``docs``.

    The compressed texts of the rows with an id go to both joins by document from one shuffle; rows
    without an id are whole."""
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    packed = packed_texts(rows.where(F.col("doc_id").isNotNull())).where(F.col("doc_id").isNotNull())
    spans = repeated_spans(rows, min_length, packed).groupBy(F.col("doc_id").alias("cut_id")).agg(F.collect_list(F.struct("start", "number")).alias("spans"))
    nothing = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    joined = packed.join(spans, F.col("doc_id") == F.col("cut_id"), "left").select("doc_id", "packed", "spans").unionByName(
        packed_texts(rows.where(F.col("doc_id").isNull())).select("doc_id", "packed", nothing))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")

    def cut(batches):
        for b in slices(batches, "packed", SLICE_BYTES // 2):
            out = []
            for doc_id, t, found in zip(b.column("doc_id").to_pylist(), _unpack(b.column("packed")), b.column("spans").to_pylist()):
                kept, n = cut_text(t, [(x["start"], x["number"]) for x in found or ()], min_length)
                out.append((doc_id, len(t), len(t) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.record_batch(cols if with_bytes else cols[:-1], names=names if with_bytes else names[:-1])
    return joined.mapInArrow(cut, schema)


def digest(result: DataFrame) -> DataFrame:
    return result.drop("kept")
