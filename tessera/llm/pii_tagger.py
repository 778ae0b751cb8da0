"""Personal data: base patterns and a character-level bidirectional LSTM with CRF transitions.

Base patterns find emails, IP addresses, card numbers and phone numbers, leftmost and
non-overlapping per kind; a match that fails its check (address parts, Luhn, digits) is dropped.
The tagger, trained in numpy on windows of the corpus labelled by those spans (windows around other
digits are its negatives), reads overlapping windows around every character that any labelled span
needs (a digit or an at sign), takes each character's tag from the window in which it stands most
centrally, and joins tags over window borders into spans of the whole text. A tagged span is added
if it passes its kind's check and touches no base span; this finds, for one, a card number that the
greedy base pattern merged with digits next to it.

Defined cases: a null text is the empty text (no spans; masking leaves the null); without labelled
spans only the base patterns work; repeated rows are tagged one by one; an empty table gives an empty
result; other columns are ignored (masking keeps them).

Scale: narrow. One pass finds training windows, of which at most TRAIN_WINDOWS of each kind, those
with the smallest hash, reach the driver (the documented bound of the training sample); the model is
under 100 kB. Base patterns run in time linear in the text: what can't start or end a match is
skipped, and repeats are possessive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 48, 24
TRAIN_WINDOWS = 200
HIDDEN, STEPS, BATCH, RATE = 16, 300, 64, 0.025
N_TAGS = 1 + 2 * len(KINDS)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[\d@]")
_LOOSE_PHONE = re.compile(r"[+(]?[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    values = [int(x) for x in reversed(digits)]
    return (sum(values[0::2]) + sum(sum(divmod(2 * x, 10)) for x in values[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(x for x in s if "0" <= x <= "9")


def passes(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return True


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_END:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; code points, end exclusive."""
    if not _TRIGGER.search(text):
        return []
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if passes("ip", m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if passes("card", m[0])]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if passes("phone", m[0])]
    return sorted(out)


def text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ---- the tagger

def codes(text: str) -> np.ndarray:
    """Characters as small numbers: ASCII as is, other characters by class."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    out = np.where(points < 128, points, 128).astype(np.int64)
    for i in np.flatnonzero(points >= 128):
        c = text[i]
        out[i] = 129 if c.isdigit() else 130 if c.isspace() else 128
    return out


PAD, N_CODES = 131, 132


def windows_of(text: str) -> list[tuple[int, np.ndarray]]:
    """(start, codes) of overlapping windows that cover every trigger with STRIDE characters of context."""
    places = [m.start() for m in _TRIGGER.finditer(text)]
    if not places:
        return []
    x, out, regions, b = codes(text), [], [], -WINDOW
    for p in places:
        if p - STRIDE > b:
            regions.append([max(p - STRIDE, 0), 0])
        b = regions[-1][1] = p + STRIDE
    for a, b in regions:
        for start in range(a, max(a + 1, min(b, len(x)) - STRIDE), STRIDE):
            part = x[start:start + WINDOW]
            out.append((start, np.concatenate([part, np.full(WINDOW - len(part), PAD)]) if len(part) < WINDOW else part))
    return out


class Tagger:
    """BiLSTM emissions with CRF transitions; parameters in ``p``."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        r, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {"out": r.normal(0, 0.2, (2 * h, N_TAGS)), "out_b": np.zeros(N_TAGS), "move": np.zeros((N_TAGS, N_TAGS)), "first": np.zeros(N_TAGS)}
        for side in "fb":
            self.p[f"{side}x"] = r.normal(0, 0.3, (N_CODES, 4 * h))
            self.p[f"{side}h"] = r.normal(0, 0.8 / np.sqrt(h), (h, 4 * h))
            bias = np.zeros(4 * h)
            bias[h:2 * h] = 1.0
            self.p[f"{side}b"] = bias

    def _lstm(self, side: str, x: np.ndarray):
        h, (t_max, n) = self.h, x.shape
        wx, wh, b = self.p[f"{side}x"], self.p[f"{side}h"], self.p[f"{side}b"]
        hs, cs, gs = np.zeros((t_max + 1, n, h)), np.zeros((t_max + 1, n, h)), np.zeros((t_max, n, 4 * h))
        for t in range(t_max):
            z = wx[x[t]] + hs[t] @ wh + b
            g = gs[t]
            g[:, :3 * h] = 1 / (1 + np.exp(-z[:, :3 * h]))
            g[:, 3 * h:] = np.tanh(z[:, 3 * h:])
            cs[t + 1] = g[:, h:2 * h] * cs[t] + g[:, :h] * g[:, 3 * h:]
            hs[t + 1] = g[:, 2 * h:3 * h] * np.tanh(cs[t + 1])
        return hs, cs, gs

    def _lstm_back(self, side: str, x, cache, dh_out, grads):
        h, (hs, cs, gs) = self.h, cache
        wh = self.p[f"{side}h"]
        dh, dc, dzs = np.zeros_like(hs[0]), np.zeros_like(cs[0]), []
        for t in range(len(x) - 1, -1, -1):
            g, tc = gs[t], np.tanh(cs[t + 1])
            i, f, o, u = g[:, :h], g[:, h:2 * h], g[:, 2 * h:3 * h], g[:, 3 * h:]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc ** 2)
            dz = np.concatenate([dc * u * i * (1 - i), dc * cs[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u ** 2)], 1)
            dzs.append(dz)
            grads[f"{side}h"] += hs[t].T @ dz
            dh, dc = dz @ wh.T, dc * f
        dz = np.concatenate(dzs[::-1])
        grads[f"{side}b"] += dz.sum(0)
        grads[f"{side}x"] += np.eye(N_CODES)[x.reshape(-1)].T @ dz

    def emissions(self, x: np.ndarray):
        """x: time by window. Emissions (time, window, tag) and what the way back needs."""
        fw, bw = self._lstm("f", x), self._lstm("b", x[::-1])
        both = np.concatenate([fw[0][1:], bw[0][1:][::-1]], 2)
        return both @ self.p["out"] + self.p["out_b"], (fw, bw, both)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag paths y and its gradients."""
        e, (fw, bw, both) = self.emissions(x)
        t_max, n, _ = e.shape
        move, first = self.p["move"], self.p["first"]
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = first + e[0]
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        for t in range(1, t_max):
            a[t] = lse(a[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(t_max - 2, -1, -1):
            b[t] = lse(move[None] + (e[t + 1] + b[t + 1])[:, None, :], 2)
        z = lse(a[-1], 1)
        post = np.exp(a + b - z[None, :, None])
        k = np.arange(n)
        gold = first[y[0]] + e[0, k, y[0]]
        de = post.copy()
        g = {name: np.zeros_like(v) for name, v in self.p.items()}
        np.add.at(g["first"], y[0], -1.0)
        g["first"] += post[0].sum(0)
        for t in range(t_max):
            de[t, k, y[t]] -= 1
            if t:
                gold = gold + move[y[t - 1], y[t]] + e[t, k, y[t]]
                pair = np.exp(a[t - 1][:, :, None] + move + (e[t] + b[t])[:, None, :] - z[:, None, None])
                g["move"] += pair.sum(0)
                np.add.at(g["move"], (y[t - 1], y[t]), -1.0)
        g["out"] = np.einsum("tnh,tnk->hk", both, de)
        g["out_b"] = de.sum((0, 1))
        dboth = de @ self.p["out"].T
        self._lstm_back("f", x, fw, dboth[:, :, :self.h], g)
        self._lstm_back("b", x[::-1], bw, dboth[::-1, :, self.h:], g)
        return float((z - gold).mean()), {name: v / n for name, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int | None = None, seed: int = 11) -> list[float]:
        """About ``steps`` (STEPS) Adam steps over windows (rows of x) with tags y; the losses by epoch."""
        epochs = -(-(STEPS if steps is None else steps) // -(-len(x) // BATCH))
        r, mean, var, k, losses = np.random.default_rng(seed), {}, {}, 0, []
        for epoch in range(epochs):
            total, order = 0.0, r.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                part = order[lo:lo + BATCH]
                loss, g = self.step(x[part].T, y[part].T)
                total, k = total + loss * len(part), k + 1
                norm = np.sqrt(sum((v ** 2).sum() for v in g.values()))
                rate = RATE * (1 - epoch / epochs) + 1e-4
                for name, v in g.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    mean[name] = 0.9 * mean.get(name, 0) + 0.1 * v
                    var[name] = 0.999 * var.get(name, 0) + 0.001 * v ** 2
                    self.p[name] -= rate * (mean[name] / (1 - 0.9 ** k)) / (np.sqrt(var[name] / (1 - 0.999 ** k)) + 1e-8)
            losses.append(total / len(x))
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag path of each window (rows of x), by Viterbi."""
        out = np.zeros(x.shape, dtype=np.int8)
        for lo in range(0, len(x), 512):
            e, _ = self.emissions(x[lo:lo + 512].T)
            t_max, n, _ = e.shape
            best, back = self.p["first"] + e[0], np.zeros(e.shape, dtype=np.int8)
            for t in range(1, t_max):
                s = best[:, :, None] + self.p["move"]
                back[t] = s.argmax(1)
                best = s.max(1) + e[t]
            tag = best.argmax(1)
            for t in range(t_max - 1, -1, -1):
                out[lo:lo + n, t] = tag
                tag = back[t][np.arange(n), tag]
        return out


def reconcile(length: int, starts: list[int], tags: np.ndarray) -> dict[int, int]:
    """place -> tag: of all windows that hold a place, the one with its centre nearest decides (the
    earlier one on a tie)."""
    chosen: dict[int, tuple[int, int]] = {}
    for s, row in zip(starts, tags):
        for k in range(min(WINDOW, length - s)):
            away = abs(2 * k + 1 - WINDOW)
            if s + k not in chosen or away < chosen[s + k][0]:
                chosen[s + k] = (away, int(row[k]))
    return {p: tag for p, (_, tag) in chosen.items()}


def tagged_spans(text: str, tags: dict[int, int]) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) that the reconciled tags spell; tags 1 + 2k begin kind k, 2 + 2k go on."""
    out, open_kind, start, last = [], -1, 0, -2
    for p in sorted(x for x, tag in tags.items() if tag):
        kind, begins = (tags[p] - 1) // 2, (tags[p] - 1) % 2 == 0
        if p != last + 1 or kind != open_kind or begins:
            if open_kind >= 0:
                out.append((start, open_kind, last + 1))
            open_kind, start = kind, p
        last = p
    if open_kind >= 0:
        out.append((start, open_kind, last + 1))
    return out


def added_spans(text: str, found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tagged spans that pass their kind's form and check and touch no base span. Tagged spans do not
    overlap each other; of the base spans that start before an end, the furthest end tells: n log n."""
    out, starts = [], sorted(s for s, _, _ in base)
    ends = list(accumulate((e for _, e in sorted((s, e) for s, _, e in base)), max))
    for s, k, e in found:
        piece = text[s:e]
        s, e = s + len(piece) - len(piece.lstrip()), e - (len(piece) - len(piece.rstrip()))
        piece = text[s:e]
        form = {0: lambda: [*_emails(piece)] == [(0, len(piece))], 1: lambda: bool(_IP.fullmatch(piece)),
                2: lambda: bool(_CARD.fullmatch(piece)), 3: lambda: bool(_LOOSE_PHONE.fullmatch(piece)) and not piece.isdigit()}[k]
        before = bisect_left(starts, e)
        if piece and not (before and ends[before - 1] > s) and form() and passes(KINDS[k], piece):
            out.append((s, k, e))
    return out


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list, list]]:
    """(base, base and added) of each text."""
    base, wins = [base_spans(t) for t in texts], [windows_of(t) if tagger else [] for t in texts]
    if tagger is None or not any(wins):
        return [(b, b) for b in base]
    tags = tagger.decode(np.stack([x for w in wins for _, x in w]))
    out, k = [], 0
    for t, b, w in zip(texts, base, wins):
        if w:
            chosen = reconcile(len(t), [s for s, _ in w], tags[k:k + len(w)])
            k += len(w)
            out.append((b, sorted(b + added_spans(t, tagged_spans(t, chosen), b))))
        else:
            out.append((b, b))
    return out


def _training_batches(batches):
    """Windows with tags: one around each base span, one around each trigger away from all spans."""
    for b in slices(batches):
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            places = [m.start() for m in _TRIGGER.finditer(text)]
            if not places:
                continue
            spans = base_spans(text)
            x, tags = codes(text), np.zeros(len(text), dtype=np.int8)
            for s, k, e in sorted(spans, key=lambda v: v[0] - v[2]):
                if not tags[s:e].any():  # of overlapping spans the longest teaches
                    tags[s], tags[s + 1:e] = 1 + 2 * k, 2 + 2 * k
            todo = [(KINDS[k], s, e) for s, k, e in spans] + [("none", p, p + 1) for p, q in zip(places, [-99, *places]) if p - q > WINDOW and not tags[max(0, p - STRIDE):p + STRIDE].any()]
            for kind, s, e in todo:
                jitter = int(hashlib.md5(f"{doc_id}:{s}".encode()).hexdigest()[:6], 16)
                start = max(0, min((s + e) // 2 - WINDOW // 2 + jitter % 21 - 10, len(x) - WINDOW))
                part, tag = x[start:start + WINDOW], tags[start:start + WINDOW].copy()
                pad = WINDOW - len(part)
                rows.append((kind, f"{jitter:06d}:{doc_id}:{s}", bytes(np.concatenate([part, np.full(pad, PAD)]).astype(np.uint8)),
                             bytes(np.concatenate([tag, np.zeros(pad, np.int8)]).astype(np.uint8))))
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["kind", "pick", "x", "y"])


def train(docs: DataFrame, per_kind: int = TRAIN_WINDOWS) -> Tagger | None:
    """A tagger fitted to at most ``per_kind`` windows of each kind; None without any labelled span."""
    w = docs.select("doc_id", "text").mapInArrow(_training_batches, "kind string, pick string, x binary, y binary")
    first = Window.partitionBy("kind").orderBy("pick")
    rows = w.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_kind).drop("r").collect()
    rows.sort(key=lambda r: (r["kind"], r["pick"]))
    if not any(r["kind"] != "none" for r in rows):
        return None
    x = np.stack([np.frombuffer(r["x"], np.uint8) for r in rows]).astype(np.int64)
    y = np.stack([np.frombuffer(r["y"], np.uint8) for r in rows]).astype(np.int64)
    tagger = Tagger()
    tagger.train(x, y)
    return tagger


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, the digest of the base spans, and all spans: one row per row of ``docs``."""
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    tagger = train(rows)

    def tag(batches):
        for b in slices(batches):
            found = all_spans(b.column("text").to_pylist(), tagger)
            counts = [pa.array([sum(1 for s in base if s[1] == k) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            yield pa.record_batch([b.column("doc_id"), *counts,
                                   pa.array([hashlib.sha256(text_of(base).encode()).hexdigest() for base, _ in found]),
                                   pa.array([text_of(full) for _, full in found]),
                                   pa.array([len(full) - len(base) for base, full in found], pa.int64())],
                                  names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
    return rows.mapInArrow(tag, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span (overlapping ones joined) replaced by its kind in angle brackets."""
    out, done = [], 0
    for s, k, e in spans:
        if s >= done:
            out += [text[done:s], f"<{KINDS[k]}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data masked and ``length_col``, where there, counted anew."""
    tagger = train(id_and_text(docs, text_col=text_col))

    def apply(batches):
        for b in slices(batches, text_col):
            texts = b.column(text_col).to_pylist()
            found = all_spans([t or "" for t in texts], tagger)
            new = [None if t is None else masked(t, full) if full else t for t, (_, full) in zip(texts, found)]
            cols = {text_col: pa.array(new, pa.string())}
            if length_col in b.schema.names:
                old = b.column(length_col)
                cols[length_col] = pa.array([n if a == t else len(a) for a, t, n in zip(new, texts, old.to_pylist())], old.type)
            yield pa.record_batch([cols.get(c, b.column(c)) for c in b.schema.names], names=b.schema.names)
    return docs.mapInArrow(apply, docs.schema)
