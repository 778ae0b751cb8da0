"""Language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are words (ASCII letters lower-cased) and an end token per text. The model predicts a token's
class from the two classes before it: every frequent word and the end are classes of their own, all
other words share classes by their ending; inside a class a word has its smoothed share of the
class's training count, one share being kept for unseen words. Log-bilinear means that the context
vector is a sum of linear maps of the context classes' vectors, and a class's logit its product with
the class's vector plus a bias. So logits are a sum of two class-by-class tables, the normaliser of
every context comes from one matrix product, and each token has an exactly normalised probability.

Training is noise-contrastive (noise: class frequencies, samples shared in a batch), one pass of
AdaGrad over all training tokens: each task trains on its partition from the same start and the
parameters are averaged, weighted by tokens. Starting vectors come from a fixed seed.

Defined cases: a null text is the empty text, which is scored as one end token; null ids never train
and count as held out; without training tokens every count is 0 and the class model is uniform;
repeated rows are scored one by one; an empty table gives an empty result.

Scale: the counts of all training words are one aggregate by 64-bit word hash (a collision is
expected once in about 10^9 pairs of 10^5-word vocabularies). Counts of the TOP_WORDS most frequent
words, 16 bytes each, go to every task (the size bound: 6.4 MB); every other word's occurrences meet
their count in a join by hash, after counting inside each document, and are summed by document.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, id_and_text, slices

ENDINGS = 128
FREQUENT = 895
CLASSES = 1 + FREQUENT + ENDINGS
TOP_WORDS = 400_000
DIM, NOISE, BATCH, RATE = 24, 32, 2048, 0.15
FLUSH = 500_000
END = 0


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 1; a null id never trains, so it counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(True))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """64-bit hashes, less 2^63 so that they are signed."""
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws)) ^ np.uint64(1 << 63)).view(np.int64)


class _Endings(dict):
    """Last two bytes -> ending class; each pair is hashed once."""

    def __missing__(self, end: bytes) -> int:
        self[end] = value = 1 + FREQUENT + zlib.crc32(end) % ENDINGS
        return value


_ENDINGS = _Endings()


def ending_classes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter([_ENDINGS[w[-2:]] for w in ws], np.int32, len(ws))


def _indexed(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, index of each word in text order, words per text)"""
    lists = [words(t) for t in texts]
    flat = [w for x in lists for w in x]
    distinct = list(dict.fromkeys(flat))
    index = dict(zip(distinct, range(len(distinct))))
    return distinct, np.fromiter(map(index.__getitem__, flat), np.int64, len(flat)), np.array([len(x) for x in lists], np.int64)


def _count_batches(batches):
    """(word hash, ending class, count), summed inside the task as far as FLUSH distinct words allow."""
    held: Counter[bytes] = Counter()

    def rows():
        keys = list(held)
        return pa.record_batch([pa.array(word_hashes(keys)), pa.array(ending_classes(keys)), pa.array(list(held.values()), pa.int64())],
                               names=["h", "ending", "n"])
    for b in slices(batches):
        for text in b.column("text").to_pylist():
            held.update(words(text))
        if len(held) > FLUSH:
            yield rows()
            held.clear()
    if held:
        yield rows()


def count_words(training: DataFrame) -> DataFrame:
    return training.mapInArrow(_count_batches, "h long, ending int, n long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def top_words(counts: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, count and ending class of at most ``most`` (TOP_WORDS) words, the most frequent first. The
    least count that goes in comes from a histogram of counts in steps of 1/32 octave (at most 2,000
    rows), so that no task or driver ever sorts or holds more than that many words."""
    step = F.floor(F.log2("n") * 32)
    room, least = TOP_WORDS if most is None else most, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    t = counts.where(step >= least if least is not None else F.lit(False)).select("h", "n", "ending").toArrow()
    h, n, endings = (t.column(c).to_numpy() for c in ("h", "n", "ending"))
    order = np.lexsort((h, -n))
    return h[order], n[order], endings[order]


def _sums(classes: np.ndarray, rows: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The classes that occur, ascending, with the sums of their rows (and of ``more``): classes are small
    numbers, so their sort is a radix sort, and the sums take as long as the rows are many."""
    order = np.argsort(classes.astype(np.int16), kind="stable")
    sorted_ = classes[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[first], np.add.reduceat(rows[order], first, axis=0), None if more is None else np.add.reduceat(more[order], first)


class Model:
    """Class vectors, context maps and biases, with the counts that the class shares need."""

    def __init__(self, class_counts: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        self.noise = (class_counts + 0.5) / (class_counts + 0.5).sum()
        self.p = {"r": r.normal(0, 0.3, (CLASSES, DIM)), "q": r.normal(0, 0.1, (CLASSES, DIM)), "c1": np.eye(DIM), "c2": 0.5 * np.eye(DIM), "b": np.log(self.noise)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in sorted(self.p)]).astype(np.float64)

    def set_vector(self, v: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = v[at:at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A, B, log Z): log p(w | i, j) = A[i, w] + B[j, w] - log Z[i, j], i the class just before, j
        the one before that; the biases are in A."""
        p = {k: v.astype(np.float64) for k, v in self.p.items()}
        a, b = p["r"] @ p["c1"].T @ p["q"].T + p["b"], p["r"] @ p["c2"].T @ p["q"].T
        ma, mb = a.max(1, keepdims=True), b.max(1, keepdims=True)
        return a, b, np.log(np.exp(a - ma) @ np.exp(b - mb).T) + ma + mb.T

    def train(self, context1: np.ndarray, context2: np.ndarray, target: np.ndarray, state: dict, rng) -> None:
        """Noise-contrastive AdaGrad over the tokens given, in batches; ``state`` keeps the squares."""
        p, log_kn = self.p, np.log(NOISE * self.noise).astype(np.float32)
        cum = np.cumsum(self.noise)
        for lo in range(0, len(target), BATCH):
            i, j, w = context1[lo:lo + BATCH], context2[lo:lo + BATCH], target[lo:lo + BATCH]
            n = np.minimum(np.searchsorted(cum, rng.random(NOISE)), CLASSES - 1)
            r1, r2 = p["r"][i], p["r"][j]
            ctx = r1 @ p["c1"].T + r2 @ p["c2"].T
            qw, qn = p["q"][w], p["q"][n]
            up = 1 / (1 + np.exp(np.einsum("bd,bd->b", ctx, qw) + p["b"][w] - log_kn[w]))  # 1 - P(data)
            down = -1 / (1 + np.exp(-(ctx @ qn.T + p["b"][n] - log_kn[n])))  # -P(data) of the noise
            m = len(w)
            dctx = up[:, None] * qw + down @ qn
            g = {"c1": dctx.T @ r1 / m, "c2": dctx.T @ r2 / m}
            # the noise classes are few and any may repeat; a data class gets the sum of its own rows
            rows, dq, db = _sums(w, up[:, None] * ctx, up)
            some, back = np.unique(n, return_inverse=True)
            dn, bn = np.zeros((len(some), DIM), np.float32), np.zeros(len(some), np.float32)
            np.add.at(dn, back, down.T @ ctx)
            np.add.at(bn, back, down.sum(0))
            at = np.minimum(np.searchsorted(rows, some), len(rows) - 1)
            both = rows[at] == some
            dq[at[both]] += dn[both]
            db[at[both]] += bn[both]
            for r, q, bias in ((rows, dq, db), (some[~both], dn[~both], bn[~both])):
                self._move("q", r, q / m, state)
                self._move("b", r, bias / m, state)
            rows, dr, _ = _sums(np.concatenate([i, j]), np.concatenate([dctx @ p["c1"], dctx @ p["c2"]]))
            self._move("r", rows, dr / m, state)
            for k in ("c1", "c2"):
                self._move(k, slice(None), g[k], state)

    def _move(self, name: str, rows, grad: np.ndarray, state: dict) -> None:
        s = state.setdefault(name, np.full(self.p[name].shape, 1e-6, np.float32))
        s[rows] += grad ** 2
        self.p[name][rows] += (RATE if name in "rq" else 0.3 * RATE) * grad / np.sqrt(s[rows])


class Lexicon:
    """What tasks know of words: hashes and counts of the most frequent, the first FREQUENT of which
    have classes of their own, and the totals behind the shares of the other classes."""

    def __init__(self, h: np.ndarray, n: np.ndarray, ending_totals: dict[int, tuple[int, int]], tokens: int, types: int, ends: int):
        """h, n: hashes and counts of the top words, the most frequent first."""
        self.tokens, self.types, self.ends = tokens, types, ends
        own = np.where(np.arange(len(h)) < FREQUENT, np.arange(len(h)) + 1, 0).astype(np.int32)
        order = np.argsort(h)
        self.h, self.n, self.own = h[order], n[order], own[order]
        class_counts = np.zeros(CLASSES)
        class_counts[END] = ends
        class_counts[1:1 + min(FREQUENT, len(h))] = n[:FREQUENT]
        share = np.full(CLASSES, 0.0)
        for c in range(1 + FREQUENT, CLASSES):
            total, distinct = ending_totals.get(c, (0, 0))
            class_counts[c] = total
            share[c] = np.log10(total + 0.5 * (distinct + 1))
        self.class_counts, self.log_share = class_counts, share

    def look_up(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """hash, class, count (-1: not among the top words), and whether the class is the word's own."""
        h = word_hashes(distinct)
        if not len(self.h) or not len(h):
            at, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        else:
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            known = self.h[at] == h
        own = np.where(known, self.own[at] if len(self.h) else 0, 0)
        endings = ending_classes(distinct)
        return h, np.where(own > 0, own, endings), np.where(known, self.n[at] if len(self.h) else 0, -1), own > 0


def _sequences(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token with an end after each text: class, class before, class two before (END outside), text."""
    stop = np.cumsum(lengths + 1)
    total = int(stop[-1]) if len(stop) else 0
    seq, is_end = np.zeros(total, np.int64), np.zeros(total, bool)
    is_end[stop - 1] = True
    seq[~is_end] = classes
    one, two = np.concatenate([[END], seq[:-1]])[:total], np.concatenate([[END, END], seq[:-2]])[:total]
    first = stop - lengths - 1
    one[first] = END
    two[first] = END
    later = first + 1
    two[later[later < stop]] = END
    return seq, one, two, np.repeat(np.arange(len(lengths)), lengths + 1)


def train(training: DataFrame, lexicon: Lexicon) -> Model:
    """One pass of all tasks from the same start; the average of their parameters."""
    def task(batches):
        model, state, seen = Model(lexicon.class_counts), {}, 0
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for b in slices(batches):
            distinct, index, lengths = _indexed(b.column("text").to_pylist())
            _, cls, _, _ = lexicon.look_up(distinct)
            seq, one, two, _ = _sequences(cls[index], lengths)
            order = rng.permutation(len(seq))
            model.train(one[order], two[order], seq[order], state, rng)
            seen += len(seq)
        if seen:
            v = model.vector()
            yield pa.record_batch([pa.array(np.arange(len(v))), pa.array(v * seen), pa.array(np.full(len(v), float(seen)))], names=["i", "v", "n"])

    rows = training.mapInArrow(task, "i long, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).collect()
    model = Model(lexicon.class_counts)
    if rows:
        v = np.zeros(len(rows))
        v[[r["i"] for r in rows]] = [r["v"] for r in rows]
        model.set_vector(v)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``."""
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", held_out(F.col("doc_id")))
    training = rows.where(~F.col("held_out")).select("text")
    counts = checkpoint(count_words(training))
    ends = training.count()
    totals = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, types = (totals[0] or 0) + ends, totals[1] + (1 if ends else 0)
    h, n, endings = top_words(counts)
    own = {}
    for k in range(min(FREQUENT, len(h))):
        t, d = own.get(int(endings[k]), (0, 0))
        own[int(endings[k])] = (t + int(n[k]), d + 1)
    ending_totals = {r[0]: (r[1] - own.get(r[0], (0, 0))[0], r[2] - own.get(r[0], (0, 0))[1])
                     for r in counts.groupBy("ending").agg(F.sum("n"), F.count(F.lit(1))).collect()}
    lexicon = Lexicon(h, n, ending_totals, tokens, types, ends)
    model = train(training, lexicon)

    def parts(batches):
        """A row per document with all that is known here, and a row per document and other word."""
        a, b, log_z = model.tables()
        place, ln10 = TaskContext.get().partitionId() << 40, np.log(10)
        for batch in slices(batches):
            distinct, index, lengths = _indexed(batch.column("text").to_pylist())
            h, cls, n, own_class = lexicon.look_up(distinct)
            seq, one, two, doc = _sequences(cls[index], lengths)
            log_p = (a[one, seq] + b[two, seq] - log_z[one, two]) / ln10
            m = len(lengths)
            model_sum = np.bincount(doc, log_p, m)
            of = np.repeat(np.arange(m), lengths)
            shared = ~own_class[index]
            known = n[index] >= 0
            log_c = np.log10(np.where(n >= 0, n, 0) + 0.5)
            base_sum = np.bincount(of[known], log_c[index[known]], m) + np.log10(lexicon.ends + 0.5)
            both = known & shared
            model_sum += np.bincount(of[both], log_c[index[both]], m) - np.bincount(of[shared], lexicon.log_share[cls[index[shared]]], m)
            n_known = np.bincount(of[known], minlength=m) + (1 if lexicon.ends else 0)
            rids = place + np.arange(m)
            place += m
            yield pa.record_batch([pa.array(rids), batch.column("doc_id"), batch.column("held_out"), pa.array(rids), pa.array(np.ones(m, np.int32)), pa.array(np.zeros(m, np.int64)),
                                   pa.array(lengths + 1), pa.array(n_known.astype(np.int64)), pa.array(base_sum), pa.array(model_sum)],
                                  names=["rid", "doc_id", "held_out", "h", "whole", "times", "n_tokens", "n_known", "base", "model"])
            rest = np.flatnonzero(~known)
            if len(rest):
                pair, times = np.unique(of[rest] * len(distinct) + index[rest], return_counts=True)
                k = len(pair)
                nothing = pa.nulls(k, pa.int64())
                yield pa.record_batch([pa.array(rids[pair // len(distinct)]), nothing, pa.nulls(k, pa.bool_()), pa.array(h[pair % len(distinct)]), pa.array(np.zeros(k, np.int32)),
                                       pa.array(times.astype(np.int64)), nothing, nothing, pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())],
                                      names=["rid", "doc_id", "held_out", "h", "whole", "times", "n_tokens", "n_known", "base", "model"])

    seen = rows.mapInArrow(parts, "rid long, doc_id long, held_out boolean, h long, whole int, times long, n_tokens long, n_known long, base double, model double")
    c = counts.select(F.col("h").alias("ch"), F.col("n").alias("c"), F.lit(0).alias("cwhole"))
    joined = seen.join(c, (seen["h"] == c["ch"]) & (seen["whole"] == c["cwhole"]), "left")
    log_c = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    found = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(log_c)).alias("base"), (F.max("model") + F.sum(log_c)).alias("model"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                        (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(tokens + 0.5 * (types + 1))))).alias("base_score"),
                        F.col("model").alias("score"))
