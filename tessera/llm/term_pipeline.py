"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners by their weight, the rarest to the first. The bundle of an item travels
through the owners' stages: it carries sparse accumulators (documents and their scores so far), each
stage cogroups the bundles with the posting lists that its owner holds and adds integer
contributions, and the last stage selects the best documents. So that no term and no item is one
task's work, lists and bundles are cut by document shard and bundles by block of items: the key of
every cogroup is (block, shard).

An accumulator goes as soon as it cannot win: if k others in its shard already have more than its
score and all that later owners could add, the document is not among the best k. This is exact.

Defined cases: every row of ``docs`` is a document and every row of ``items`` an item, repeated rows
and null ids included; null texts have no terms; equal scores go by ascending doc_id, null ids last;
items without terms, or without a document that scores above 0, have no rows; empty tables give an
empty result; other columns of the inputs stay outside.

Scale: documents are read once. A task turns them into shards of at most SHARD_DOCS documents or
about SHARD_POSTINGS postings, and keeps only terms of the items: it knows them by a bitmap of fixed
size (FILTER_BITS), whose false hits the join on terms removes. Posting lists, so cut, are a written
table, as are the lists of each owner; a hot term is one row a shard, and the join on terms is split
by AQE where it is skewed. A group of a cogroup holds one shard's lists and the accumulators of one
block of at most 2^BLOCK_BITS items, both bounded. The driver sees the bitmap and two counts.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import slices
from tessera.session import scratch_path

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 50
OWNERS = 4
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20
BLOCK_BITS = 8
FILTER_BITS = 1 << 22
#: Bits of one aggregate of Spark's bitmap functions.
_BUCKET = 1 << 15
#: Terms whose verdict a task keeps at a time, and bytes of text cut into terms together.
_KNOWN, _STRIDE = 1 << 20, 1 << 20
#: Any byte that ends a term becomes a blank; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_INDEX = ("shard long, term string, n long, top long, docs binary, tfs binary, lens binary, ids array<{}>")
_BUNDLE = "block long, shard long, item long, docs binary, scores binary"
_HITS = "block long, shard long, items array<long>, docs array<int>, scores array<long>"


def count_terms(text: bytes) -> Counter:
    """How often each term occurs; long texts are cut at blanks, a piece at a time."""
    folded, found, at = text.translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + _STRIDE)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end + 1
    return found


class _Shard:
    """Documents of one shard while they are gathered, as term numbers and frequencies."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.docs: list[tuple] = []
        self.postings = 0

    def add(self, doc_id, length: int, terms: dict[bytes, int]) -> None:
        numbers = self.numbers
        self.docs.append((doc_id, length, array("i", [numbers.setdefault(t, len(numbers)) for t in terms]), array("q", terms.values())))
        self.postings += len(terms)

    def rows(self, shard: int, id_type: pa.DataType) -> pa.RecordBatch:
        """A row for the shard itself (its ids, in order), then one for each term."""
        docs = sorted(self.docs, key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0))
        held = np.array([len(d[2]) for d in docs], dtype=np.int64)
        lens = np.array([d[1] for d in docs], dtype=np.int64)
        of = np.concatenate([np.frombuffer(d[2], dtype=np.int32) for d in docs] + [np.empty(0, np.int32)])
        tfs = np.concatenate([np.frombuffer(d[3], dtype=np.int64) for d in docs] + [np.empty(0, np.int64)])
        by = np.argsort(of, kind="stable")
        where, tfs = np.repeat(np.arange(len(docs), dtype=np.int32), held)[by], tfs[by]
        size = np.bincount(of, minlength=len(self.numbers))
        edge = np.concatenate([[0], np.cumsum(size)])
        top = np.maximum.reduceat(tfs, edge[:-1]) if len(tfs) else np.empty(0, np.int64)
        long = lens[where]
        cut = lambda a: [None, *[a[lo:hi].tobytes() for lo, hi in zip(edge[:-1], edge[1:])]]
        n = len(self.numbers) + 1
        return pa.RecordBatch.from_arrays([
            pa.array([shard] * n, pa.int64()), pa.array([None, *[t.decode("utf-8", "replace") for t in self.numbers]], pa.string()),
            pa.array([int(np.count_nonzero(lens)), *size.tolist()], pa.int64()), pa.array([int(lens.sum()), *top.tolist()], pa.int64()),
            pa.array(cut(where), pa.binary()), pa.array(cut(tfs), pa.binary()), pa.array(cut(long), pa.binary()),
            pa.array([[d[0] for d in docs], *[None] * (n - 1)], pa.list_(id_type))],
            ["shard", "term", "n", "top", "docs", "tfs", "lens", "ids"])


def inverted_lists(docs: DataFrame, wanted: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Posting lists by (shard, term), and for each shard a row without a term that holds its ids.

    A list has the places of its documents in the shard (docs), their term frequencies and their
    lengths; n and top are the number of documents and the largest frequency. In the shard's own row
    they are the documents with a term and all their terms. ``wanted`` is a bitmap of term hashes.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    mask = FILTER_BITS - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, known, id_type = TaskContext.get().partitionId() << 32, _Shard(), {}, None
        for b in slices(batches):
            id_type = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                terms = count_terms(text)
                length = terms.total()
                if wanted is not None:
                    if len(known) > _KNOWN:
                        known.clear()
                    for t in [t for t in terms if t not in known]:
                        h = xxhash.xxh64_intdigest(t, seed=42) & mask
                        known[t] = wanted[h >> 3] >> (h & 7) & 1
                    terms = {t: n for t, n in terms.items() if known[t]}
                shard.add(doc_id, length, terms)
                if len(shard.docs) >= SHARD_DOCS or shard.postings >= SHARD_POSTINGS:
                    yield shard.rows(number, id_type)
                    number, shard = number + 1, _Shard()
        if shard.docs:
            yield shard.rows(number, id_type)

    return rows.mapInArrow(run, _INDEX.format(rows.schema["doc_id"].dataType.simpleString()))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a number), block, item_id, term: the distinct terms of each item."""
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").alias("item_id"),
                            F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("terms"))
    return numbered.select("item", F.shiftright("item", BLOCK_BITS).alias("block"), "item_id", F.explode("terms").alias("term"))


def bitmap(terms: DataFrame) -> bytes:
    """FILTER_BITS bits, those at the terms' hashes set: at most 128 rows of 4 kB to the driver."""
    at = F.xxhash64("term").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    rows = terms.select(at.alias("at")).distinct().groupBy((F.col("at") / _BUCKET).cast("int").alias("bucket")).agg(
        F.bitmap_construct_agg((F.col("at") % _BUCKET)).alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[r.bucket * _BUCKET // 8:(r.bucket + 1) * _BUCKET // 8] = r.bits
    return bytes(out)


def contributions(tfs: np.ndarray, lens: np.ndarray, w: int, n: int, total: int) -> np.ndarray:
    """What a term of weight ``w`` adds to each document of its list, in 64-bit integers."""
    if 50 * n * int(lens.max(initial=0)) < 1 << 63:
        m = 50 + (50 * lens * n) // total
    else:
        m = np.array([50 + (50 * x * n) // total for x in lens.tolist()], dtype=np.int64)
    return w * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))


def _stage(n: int, total: int, k: int, last: bool):
    """One owner's step for the bundles of a block in a shard."""

    def step(key: tuple, bundles: pa.Table, lists: pa.Table) -> pa.Table:
        block, shard = (x.as_py() for x in key)
        added: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        rest: dict[int, int] = {}
        for r in lists.select(["w", "asked", "docs", "tfs", "lens"]).to_batches():
            for w, asked, docs, tfs, lens in zip(*(c.to_pylist() for c in r.columns)):
                what = np.frombuffer(docs, np.int32), contributions(np.frombuffer(tfs, np.int64), np.frombuffer(lens, np.int64), w, n, total)
                for a in asked:
                    added.setdefault(a["item"], []).append(what)
                    rest[a["item"]] = a["rest"]
        for r in bundles.select(["item", "docs", "scores"]).to_batches():
            for item, docs, scores in zip(*(c.to_pylist() for c in r.columns)):
                added.setdefault(item, []).append((np.frombuffer(docs, np.int32), np.frombuffer(scores, np.int64)))
        items, places, sums = [], [], []
        score = np.zeros(SHARD_DOCS, dtype=np.int64)
        for item in sorted(added):
            for docs, what in added[item]:
                score[docs] += what  # a document is at most once in each list
            docs = np.flatnonzero(score)
            got = score[docs]
            score[docs] = 0
            if last:
                best = np.lexsort((docs, -got))[:k]
                docs, got = docs[best], got[best]
            elif len(docs) > k and item in rest:
                safe = got + rest[item] >= np.partition(got, len(got) - k)[len(got) - k]
                docs, got = docs[safe], got[safe]
            if len(docs):
                items.append(item)
                places.append(docs.astype(np.int32))
                sums.append(got)
        if last:
            flat = [np.concatenate([np.full(len(d), i, np.int64) for i, d in zip(items, places)] + [np.empty(0, np.int64)]),
                    np.concatenate([*places, np.empty(0, np.int32)]), np.concatenate([*sums, np.empty(0, np.int64)])]
            return pa.table({"block": [block], "shard": [shard], "items": pa.array([flat[0]], pa.list_(pa.int64())),
                             "docs": pa.array([flat[1]], pa.list_(pa.int32())), "scores": pa.array([flat[2]], pa.list_(pa.int64()))})
        return pa.table({"block": pa.array([block] * len(items), pa.int64()), "shard": pa.array([shard] * len(items), pa.int64()),
                         "item": pa.array(items, pa.int64()), "docs": pa.array([d.tobytes() for d in places], pa.binary()),
                         "scores": pa.array([s.tobytes() for s in sums], pa.binary())})

    return step


def search(docs: DataFrame, items: DataFrame, k: int = TOP, owners: int = OWNERS, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    folder = scratch_path(spark, f"search-{uuid.uuid4().hex}")
    item_terms(items, item_col, item_text_col).write.parquet(f"{folder}/items")
    asked = spark.read.parquet(f"{folder}/items")
    inverted_lists(docs, bitmap(asked), id_col, text_col).write.parquet(f"{folder}/lists")
    lists = spark.read.parquet(f"{folder}/lists")
    n, total = lists.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("top"), F.lit(0))).first()

    # weights, owners by weight, and what the owners after a stage can add to an item at most
    w = F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (2 * F.col("df") + 1)))
    most = int(np.floor(1000 * np.log((2.0 * n + 2) / 3))) + 1 if n else 1
    stats = lists.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top")).select("term", "top", w.alias("w"))
    weighed = asked.join(stats, "term").select(
        "item", "block", "term", "w", F.greatest(F.lit(0), F.least(F.lit(owners - 1), F.floor(owners - owners * F.col("w") / most))).cast("int").alias("owner"),
        (F.col("w") * F.expr("(1000000000 * top) div (1000 * top + 1000)")).alias("bound"))
    later = Window.partitionBy("item").orderBy(F.desc("owner")).rangeBetween(Window.unboundedPreceding, -1)
    asks = weighed.select("item", "block", "term", "w", "owner", F.coalesce(F.sum("bound").over(later), F.lit(0)).alias("rest")).groupBy(
        "owner", "block", "term", "w").agg(F.collect_list(F.struct("item", "rest")).alias("asked"))  # a block has few items
    asks.write.parquet(f"{folder}/asks")
    lists.where("term IS NOT NULL").join(spark.read.parquet(f"{folder}/asks"), "term").select(
        "owner", "block", "shard", "w", "asked", "docs", "tfs", "lens").write.partitionBy("owner").parquet(f"{folder}/owned")
    owned = spark.read.schema("block long, shard long, w long, asked array<struct<item: long, rest: long>>, docs binary, tfs binary, "
                              "lens binary, owner int").parquet(f"{folder}/owned")

    bundles = spark.createDataFrame([], _BUNDLE)
    for s in range(owners):
        last = s == owners - 1
        held = owned.where(F.col("owner") == s).drop("owner")
        bundles = bundles.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInArrow(
            _stage(n, total, k, last), _HITS if last else _BUNDLE)

    ids = lists.where("term IS NULL").select("shard", "ids")
    hits = bundles.join(ids, "shard").select(F.inline(F.expr(
        "transform(arrays_zip(items, docs, scores), x -> struct(x.items as item, get(ids, x.docs) as doc_id, x.scores as score))")))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


#: DuckDB: the same scores, term by term.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT iid, item_id, unnest(list_distinct(w)) AS term FROM (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
g AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
t AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, n_docs),
m AS (SELECT rid, doc_id, 100 - 50 + ((50 * CAST(len(w) AS BIGINT) * n_docs) // n_terms) AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT iid, item_id, rid, doc_id, CAST(sum(t.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY iid, item_id, rid, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""
