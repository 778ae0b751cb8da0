"""Best-two-fit packing of documents into token sequences.

Texts are encoded by a public tokenizer (its file is a parameter) and get an end id; only a document
longer than a sequence is cut. The plan is made on the histogram of piece lengths: a sequence is
filled greedily with the longest piece that still fits; then its smallest piece gives way to two
unpacked pieces, if two exist that fill the gap so widened more tightly. The same filling is used
as often as the counts allow, so planning needs one row per length, whatever the number of pieces.
Each piece then takes its place by its rank among the pieces of its length.

Defined cases: a null or empty text is one piece with the end id alone; the strings of special tokens
in a text are encoded as the tokenizer itself does; repeated rows are pieces of their own; ties in
rank are broken by place in the partition, so equal rows get different places; an empty table gives
an empty result; other columns are ignored.

Scale: one pass encodes the text; pieces (a few numbers each) are checkpointed. The driver sees the
histogram only (at most SEQUENCE rows). Ranks come from counts by (length, salt), with about
SALT_ROWS pieces a salt, so a length that most pieces share is dealt over many tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, id_and_text, slices

SEQUENCE = 2048
END_ID = 0
SALT_ROWS = 100_000
CACHE = 600_000
_LETTERS = "a-zß-öø-ÿā-ſ"
#: The tokenizer's own splitting rule, for texts of the characters below only.
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
#: Characters outside plain Latin text (and those whose class or lower case is special): such texts go to the tokenizer whole.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ſ]")
_LATIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Token ids of texts. A text of plain Latin characters is split into words here, by the
    tokenizer's own rule, and each distinct word is encoded once by the tokenizer's model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_word = self._split_known(spec)
        if self.by_word:
            words = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
                {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
            self.words = Tokenizer.from_str(json.dumps(words))
            size = max(spec["model"]["vocab"].values()) + 1
            self.kind = np.uint16 if size <= 1 << 16 else np.uint32
            self._forget()
            self.ends = np.zeros(size, bool)
            for token, i in spec["model"]["vocab"].items():
                self.ends[i] = token.endswith("</w>")

    @staticmethod
    def _split_known(spec: dict) -> bool:
        """Whether the file's normaliser and splitter are those that the word path follows."""
        try:
            parts = [n["type"] for n in spec["normalizer"]["normalizers"]]
            split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            return parts == ["NFC", "Replace", "Lowercase"] and split == _LATIN_SPLIT and spec["model"]["end_of_word_suffix"] == "</w>"
        except (KeyError, TypeError, IndexError):
            return False

    def _forget(self) -> None:
        """The known chunks: their place in one array of all their ids."""
        self.index: dict[str, int] = {}
        self.flat, self.begin = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Encode distinct chunks (text between white space) that are not yet known."""
        new = chunks
        split = [_PRE.findall(c) for c in new]
        words = list(dict.fromkeys(w for x in split for w in x))
        place = dict(zip(words, range(len(words))))
        parts = []
        for lo in range(0, len(words), 1000):
            parts.append(np.array(self.words.encode(" ".join(words[lo:lo + 1000]), add_special_tokens=False).ids, dtype=self.kind))
        flat, begin = np.concatenate(parts), None
        begin = np.concatenate([[0], np.flatnonzero(self.ends[flat]) + 1])
        at = np.fromiter((place[w] for x in split for w in x), np.int64)
        of = np.repeat(np.arange(len(new)), [len(x) for x in split])
        n = np.bincount(of, np.diff(begin)[at], len(new)).astype(np.int64)
        self.index.update(zip(new, range(len(self.begin) - 1, len(self.begin) - 1 + len(new))))
        self.flat = np.concatenate([self.flat, _stretches(flat, begin, at)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(n)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.by_word and not _OTHER.search(t) and not any(s in t for s in self.special)]
        if plain and len(self.index) > CACHE:  # what is held: CACHE chunks and a slice's, about 200 bytes each
            self._forget()
        get, places, missing, unknown = self.index.get, [], [], []
        for i in plain:  # one text at a time: its chunks are still in the processor's cache when they are looked up
            x = texts[i].lower().split()
            at = np.array([get(c, -1) for c in x], np.int64)
            new = np.flatnonzero(at < 0)
            missing.append(new)
            unknown += [x[k] for k in new.tolist()]
            places.append(at)
        if unknown:
            self._learn(list(dict.fromkeys(unknown)))
        found = np.fromiter(map(self.index.__getitem__, unknown), np.int64, len(unknown))
        done = 0
        for i, at, new in zip(plain, places, missing):
            at[new] = found[done:done + len(new)]
            done += len(new)
            out[i] = _stretches(self.flat, self.begin, at).astype(np.uint32)
        for i in set(range(len(texts))) - set(plain):
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out


def _stretches(flat: np.ndarray, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches flat[begin[k]:begin[k + 1]] for k in ``at``, one after the other."""
    n = begin[at + 1] - begin[at]
    total = int(n.sum())
    if not total:
        return flat[:0]
    return flat[np.repeat(begin[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids if wanted): the documents, cut where longer."""
    def cut(batches):
        encoder = _encoder(tokenizer or default_tokenizer())
        for b in slices(batches):
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), sequence)):
                    part = ids[start:start + sequence]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
            names, cols = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"], list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)][:6 if with_ids else 5], names=names[:6 if with_ids else 5])

    rows = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def _best_pair(lengths: np.ndarray, single: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two available lengths with the largest sum within ``room``; ``single`` marks lengths of
    which one piece is left. Among equal sums the pair with the longest piece."""
    small = lengths[lengths <= room // 2]
    if not len(small):
        return None
    at = np.searchsorted(lengths, room - small, "right") - 1
    same = (lengths[at] == small) & single[:len(small)]
    at = np.where(same, at - 1, at)  # the next shorter one instead of a second piece that isn't there
    ok = at >= 0
    if not ok.any():
        return None
    total = np.where(ok, small + lengths[at], -1)
    best = total.max()
    k = int(np.flatnonzero(total == best)[0])
    return int(small[k]), int(lengths[at[k]])


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """(piece lengths of a sequence, how many such sequences) by best-two-fit on the histogram."""
    left = {k: v for k, v in histogram.items() if v > 0}
    lengths, out = sorted(left), []

    def take(x):
        left[x] -= 1
        if not left[x]:
            lengths.pop(bisect_right(lengths, x) - 1)

    def give(x):
        if not left[x]:
            insort(lengths, x)
        left[x] += 1

    while lengths:
        fill, gap = [], sequence
        while (k := bisect_right(lengths, gap) - 1) >= 0:
            fill.append(lengths[k])
            gap -= lengths[k]
            take(fill[-1])
        if gap and len(fill) > 1:
            smallest = min(fill)
            a = np.array(lengths, np.int64)
            pair = _best_pair(a, np.array([left[x] == 1 for x in lengths]), gap + smallest) if len(a) else None
            if pair and sum(pair) > smallest:
                fill.remove(smallest)
                give(smallest)
                for x in pair:
                    take(x)
                fill += pair
        use = {x: fill.count(x) for x in fill}
        times = 1 + min(left[x] // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= n * (times - 1)
            if not left[x] and (k := bisect_right(lengths, x) - 1) >= 0 and lengths[k] == x:
                lengths.pop(k)
        out.append((sorted(fill, reverse=True), times))
    return out


def _intervals(fills: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By key (length, first rank): the sequence of that rank and the offset in it. A slot of a
    filling used n times takes n consecutive ranks of its length."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for fill, times in fills:
        at = 0
        for x in fill:
            rows.append((x, used.get(x, 0), first, at))
            used[x] = used.get(x, 0) + times
            at += x
        first += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return (a[:, 0] << 48) + a[:, 1], a[:, 1], a[:, 2], a[:, 3]


def pack(cut: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``cut`` with sequence_id and offset."""
    cut, names = checkpoint(cut), list(cut.columns)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    key, rank0, first, offset = _intervals(plan(counts, sequence))
    salts = max(1, -(-sum(counts.values()) // SALT_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    each = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = each.select(F.col("length").alias("l"), F.col("salt").alias("s"), (F.sum("n").over(
        Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    rest = [c for c in names if c not in ("doc_id", "piece")]  # rows equal in all columns may change places
    order = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", *rest))
    ranked = salted.withColumn("r", order).join(before, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).select(
        *cut.columns, (F.col("before") + F.col("r") - 1).alias("rank"))

    def place(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(first[at] + rank - rank0[at]), pa.array(offset[at])],
                                  names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(pieces(docs, tokenizer, sequence), sequence)
