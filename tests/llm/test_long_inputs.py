"""Inputs on which a careless loop takes hours: long runs, common seeds, texts full of matches."""

import random
import time

import numpy as np
import pytest

from tessera.llm import pii_tagger, string_tiling


def _scan_by_walking(doc, item, dhash, ihash, dfree, ifree, s, power):
    """All maximal matches of free tokens, by comparing every place with every other."""
    out = []
    for i in range(len(doc)):
        for j in range(len(item)):
            if i and j and dfree[i - 1] and ifree[j - 1] and doc[i - 1] == item[j - 1]:
                continue
            n = 0
            while i + n < len(doc) and j + n < len(item) and dfree[i + n] and ifree[j + n] and doc[i + n] == item[j + n]:
                n += 1
            if n >= s:
                out.append((n, i, j))
    return out


def test_tiles_of_repetitive_texts_are_those_of_a_plain_scan(monkeypatch):
    cases = []
    for seed in range(200):
        r = random.Random(seed)
        doc, item = ([r.randrange(-1, 1 + seed % 3) for _ in range(r.randrange(1, n))] for n in (80, 60))
        cases.append((doc, item, string_tiling.tiles(doc, item, 3)))
    monkeypatch.setattr(string_tiling, "_scan", _scan_by_walking)
    for doc, item, got in cases:
        assert got == string_tiling.tiles(doc, item, 3), (doc, item)
        assert all(doc[i:i + n] == item[j:j + n] for i, j, n in got)


@pytest.mark.parametrize("doc, item", [([1] * 60_000, [1] * 6_000), ([1, 2] * 30_000, [2, 1] * 3_000), ([1] * 60_000 + [2], [3] + [1] * 50),
                                       ([1, 1, 1, 1, 1, 2] * 2_000, [1, 1, 1, 1, 1, 3] * 100)])
def test_runs_are_tiled_in_little_time(doc, item):
    began = time.time()
    string_tiling.tiles(doc, item)
    assert time.time() - began < 10


def _opening(n):
    r = random.Random(n)
    return [(k, b"which of the following is the".split() + [b"w%d" % r.randrange(50_000) for _ in range(8)]) for k in range(n)]


def test_a_shared_opening_brings_no_pairs(spark):
    items = _opening(70_000)
    text = lambda words: b" ".join(words).decode()
    opening = " and ".join(f"which of the following is the x{k}" for k in range(400))
    docs = [(d * 3 + n, t) for d in range(4) for n, t in enumerate([opening + " " + text(items[7][1]), text(items[11][1] * 3), "other " * 50])]
    docs += [(100 + d, opening) for d in range(500)]
    bench = spark.createDataFrame([(k, text(w)) for k, w in items], "item_id long, text string").repartition(8)
    began = time.time()
    found = {(r.doc_id, r.item_id) for r in string_tiling.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {(d % 3, i) for d, i in found if d < 100} >= {(0, 7), (1, 11)} and not any(d >= 100 or d % 3 == 2 for d, _ in found)
    assert time.time() - began < 120


def test_selective_seeds_are_those_that_a_contaminated_text_must_hold():
    for seed in range(200):
        r = random.Random(seed)
        words = np.array([r.randrange(1 + seed % 9) for _ in range(r.randrange(3, 40))], np.uint64)
        seeds = string_tiling.seeds_of(words, 3)
        shared_by = {int(x): r.randrange(1, 5) for x in seeds.view(np.int64)}
        chosen = {int(x) for x in string_tiling.selective(seeds, shared_by, 3, 0.5).view(np.int64)}
        gone = [k for k, x in enumerate(seeds.view(np.int64)) if int(x) not in chosen]
        covered = {p for k in gone for p in range(k, k + 3)}
        assert chosen and len(covered) < 0.5 * len(words)
        least_gone = min((shared_by[int(seeds.view(np.int64)[k])] for k in gone), default=9)
        assert all(shared_by[x] <= least_gone for x in chosen)


def test_few_bits_do_not_change_what_matches(spark, monkeypatch):
    items = _opening(60)
    bench = spark.createDataFrame([(k, b" ".join(w).decode()) for k, w in items], "item_id long, text string")
    docs = spark.createDataFrame([(k, b" ".join(sum((w for _, w in items[k:k + 3]), [b"x"])).decode()) for k in range(40)] + [(98, ""), (99, "x")], "doc_id long, text string")
    whole = sorted(map(tuple, string_tiling.contaminated(docs, bench).collect()))
    monkeypatch.setattr(string_tiling, "FILTER_BITS", 1 << 15)
    monkeypatch.setattr(string_tiling, "_holds", lambda bits, h: np.ones(len(h), bool))  # as a full bitmap
    assert sorted(map(tuple, string_tiling.contaminated(docs, bench).collect())) == whole
    assert {(r, r + d) for r in range(40) for d in range(3) if r + d < 60} <= {x[:2] for x in whole}


def test_texts_full_of_addresses_take_linear_time():
    text = "a.b@c.example 10.0.0.1 +1 555 123 4567 " * 25_000
    base = pii_tagger.base_spans(text)
    found = [(s + 1, k, e) for s, k, e in base]
    began = time.time()
    assert pii_tagger.added_spans(text, found, base) == []  # every one touches a base span
    assert time.time() - began < 10


def test_a_tagged_span_that_touches_no_base_span_is_added():
    text = "pay 4111 1111 1111 1111 or call 555-0143-2222 or 10.0.0.1"
    card, ip = text.index("4111"), text.index("10.0")
    spans = [(card - 1, 2, card + 19), (ip, 1, ip + 8)]
    assert pii_tagger.added_spans(text, spans, []) == [(card, 2, card + 19), (ip, 1, ip + 8)]
    assert pii_tagger.added_spans(text, spans, [(ip + 7, 3, ip + 8)]) == [(card, 2, card + 19)]
    assert pii_tagger.added_spans(text, spans, [(0, 0, 5), (card + 2, 1, card + 3), (card + 1, 1, ip - 5)]) == [(ip, 1, ip + 8)]
