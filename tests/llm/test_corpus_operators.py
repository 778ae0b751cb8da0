"""Decontamination, personal data, packing, suffix dedup, scores, Jaccard join: brute force and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import SMALL, near_group, prose
from tessera.llm import graph, jaccard_join, log_bilinear, packing, pii_tagger, string_tiling, suffix_dedup


# ---- string tiling

def _plain_tiling(doc, item, least):
    """Greedy string tiling by its definition: again and again mark the longest free common stretches."""
    dfree, ifree, out = [True] * len(doc), [True] * len(item), []
    while True:
        found = []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and dfree[i + n] and ifree[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n >= least:
                    found.append((n, i, j))
        if not found:
            return sum(n for _, _, n in out)
        longest = max(found)[0]
        for n, i, j in sorted(f for f in found if f[0] == longest):
            if all(dfree[i:i + n]) and all(ifree[j:j + n]):
                dfree[i:i + n] = [False] * n
                ifree[j:j + n] = [False] * n
                out.append((i, j, n))


def test_tiles_cover_what_the_definition_covers():
    r = random.Random(4)
    for _ in range(150):
        item = [r.randrange(6) for _ in range(r.randrange(3, 40))]
        doc = [r.randrange(6) for _ in range(r.randrange(0, 30))] + item[r.randrange(len(item)):] + item[:r.randrange(1, len(item))]
        got = string_tiling.tiles(doc, item, 3)
        used_d, used_i = Counter(), Counter()
        for i, j, n in got:
            assert doc[i:i + n] == item[j:j + n] and n >= 3
            used_d.update(range(i, i + n))
            used_i.update(range(j, j + n))
        assert max(used_d.values(), default=1) == 1 == max(used_i.values(), default=1)
        best = _plain_tiling(doc, item, 3)
        assert abs(sum(n for *_, n in got) - best) <= 0.2 * len(item)  # equal but for ties between stretches


def _bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long")


def test_reordered_passages_are_caught_and_clean_ones_kept(spark, monkeypatch):
    item = prose(60, 77, 3_000).split()
    shuffled = " ".join(item[30:] + ["zz"] + item[:30])
    docs = [(1, prose(200, 5) + " " + " ".join(item), 0), (2, shuffled.upper() + "!", 0), (3, " ".join(item[:20]) + " " + prose(50, 6), 0),
            (4, prose(300, 7), 0), (5, None, 0), (6, "", 0), (2, shuffled.upper() + "!", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, coverage long")
    bench = _bench(spark, [(1, " ".join(item), 9), (2, None, 9), (3, "too short", 9), (4, "", 9)])
    out = sorted((r.doc_id, r.item_id, round(r.coverage, 3), r.n_tiles) for r in string_tiling.contaminated(df, bench).collect())
    assert out == [(1, 1, 1.0, 1), (2, 1, 1.0, 2), (2, 1, 1.0, 2)]
    assert sorted(r.doc_id for r in string_tiling.clean_documents(df, bench).collect()) == [3, 4, 5, 6]
    monkeypatch.setattr(string_tiling, "BROADCAST_KEYS", 0)
    assert sorted(r.doc_id for r in string_tiling.clean_documents(df, bench).collect()) == [3, 4, 5, 6]
    assert string_tiling.contaminated(df, bench.limit(0)).count() == 0
    assert string_tiling.clean_documents(df, bench.limit(0)).count() == len(docs)
    assert string_tiling.contaminated(df.limit(0), bench).count() == 0
    equal = string_tiling.contaminated(df, _bench(spark, [(k, " ".join(item), 9) for k in range(4)]))
    assert equal.count() == 12


def test_contamination_of_the_small_table_against_brute_force(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    bench = [(r.item_id, string_tiling.tokens(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    seeds = defaultdict(set)
    for k, (_, w) in enumerate(bench):
        for j in range(len(w) - 4):
            seeds[tuple(w[j:j + 5])].add((k, j))
    want = set()
    for d, t in docs:
        w, hit = string_tiling.tokens(t), defaultdict(set)
        for i in range(len(w) - 4):
            for k, j in seeds.get(tuple(w[i:i + 5]), ()):
                hit[k].update(range(j, j + 5))
        want |= {(d, bench[k][0]) for k, s in hit.items() if len(s) >= 0.5 * len(bench[k][1])}
    got = {(r.doc_id, r.item_id) for r in string_tiling.contaminated(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert got == want and got  # in this table every shared stretch is one tile


def test_tiling_awkward(spark, awkward, awkward_rows, empty):
    bench = _bench(spark, [(1, awkward_rows[0][1], 0)])
    assert {r.doc_id for r in string_tiling.contaminated(awkward, bench).collect()} == {1, 2, 3, 12, 14}
    kept = string_tiling.clean_documents(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == len(awkward_rows) - 5
    assert string_tiling.clean_documents(empty, bench).count() == 0


# ---- personal data

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _ok(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def _base(text):
    out = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(zip(pii_tagger.KINDS, (_EMAIL, _IP, _CARD, _PHONE))) for m in p.finditer(text) if _ok(kind, m[0])]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(8)
    for n in range(6_000):
        text = "".join(r.choice("0123456789.@+- ()aB%é_\n" if n % 2 else "012.@+- a") for _ in range(r.randrange(45)))
        assert pii_tagger.base_spans(text) == _base(text), text


def test_base_spans_are_linear_in_long_texts():
    for text in ("9" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1 " * 100_000, "a@" * 150_000, "+" + " " * 300_000):
        pii_tagger.base_spans(text)


def test_windows_cover_every_trigger():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("abc é1@" if r.random() < 0.1 else "abc é") for _ in range(r.randrange(400)))
        windows = pii_tagger.windows_of(text)
        for m in re.finditer(r"[\d@]", text):
            assert any(s <= m.start() < s + pii_tagger.WINDOW and (m.start() - s >= 12 or s == 0) for s, _ in windows)


def test_gradients_match_differences():
    tagger, r = pii_tagger.Tagger(seed=1, hidden=3), np.random.default_rng(3)
    x, y = r.integers(0, pii_tagger.N_CODES, (7, 4)), r.integers(0, pii_tagger.N_TAGS, (7, 4))
    _, grads = tagger.step(x, y)
    for name, p in tagger.p.items():
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in p.shape) if name not in ("fx", "bx") else (x[r.integers(7), r.integers(4)], r.integers(p.shape[1]))
            keep = p[at]
            p[at] = keep + 1e-5
            up, _ = tagger.step(x, y)
            p[at] = keep - 1e-5
            down, _ = tagger.step(x, y)
            p[at] = keep
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5, name


def test_viterbi_is_the_best_path():
    import itertools
    tagger = pii_tagger.Tagger(seed=5, hidden=2)
    tagger.p["move"] = np.random.default_rng(1).normal(size=tagger.p["move"].shape)
    x = np.random.default_rng(2).integers(0, 128, (3, 4))
    e, _ = tagger.emissions(x.T)
    for w, got in enumerate(tagger.decode(x)):
        def value(path):
            return tagger.p["first"][path[0]] + sum(e[t, w, k] for t, k in enumerate(path)) + sum(tagger.p["move"][a, b] for a, b in zip(path, path[1:]))
        assert tuple(got) == max(itertools.product(range(pii_tagger.N_TAGS), repeat=4), key=value)


def test_reconcile_and_spans():
    tags = np.zeros((2, pii_tagger.WINDOW), int)
    tags[0, 40:48] = 2
    tags[0, 40] = 1
    tags[1, 16:30] = 2
    tags[1, 16] = 1
    chosen = pii_tagger.reconcile(72, [0, 24], tags)
    assert pii_tagger.tagged_spans("x" * 72, chosen) == [(40, 0, 54)]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return {r.doc_id: r for r in pii_tagger.find(docs).collect()}, {r.doc_id: r.text or "" for r in docs.collect()}


def test_find_keeps_every_base_span(found):
    rows, texts = found
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        base = _base(texts[i])
        spelled = [f"{pii_tagger.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(1 for b in base if b[1] == k) for k in range(4))
        assert set(spelled) <= set(filter(None, r.spans.split(",")))
        assert r.n_added == len([x for x in r.spans.split(",") if x]) - len(base)


def test_tagger_alone_finds_most_spans(spark, found):
    _, texts = found
    tagger = pii_tagger.train(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    hit = total = 0
    for t in texts.values():
        w = pii_tagger.windows_of(t)
        if w:
            tags = pii_tagger.reconcile(len(t), [s for s, _ in w], tagger.decode(np.stack([x for _, x in w])))
            mine, base = set(pii_tagger.tagged_spans(t, tags)), set(_base(t))
            hit, total = hit + len(mine & base), total + len(base)
    assert total > 30 and hit / total > 0.8


def test_mask_and_awkward(spark, awkward, awkward_rows, empty, monkeypatch):
    monkeypatch.setattr(pii_tagger, "STEPS", 20)
    out = pii_tagger.find(awkward).collect()
    assert len(out) == len(awkward_rows)
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out if r.doc_id == 13] == [(1, 1, 1, 1)] * 2
    masked = pii_tagger.mask(awkward)
    assert masked.columns == awkward.columns
    rows = {r.doc_id: r for r in masked.collect()}
    assert rows[13].text == "Call <phone> now or mail <email>, ip <ip>, card <card>." and rows[13].n_chars == len(rows[13].text)
    assert rows[4].text is None and rows[7].text == next(r[1] for r in awkward_rows if r[0] == 7)
    assert pii_tagger.find(empty).count() == 0 and pii_tagger.mask(empty).count() == 0
    assert pii_tagger.masked("abcdef", [(0, 0, 3), (2, 1, 4)]) == "<email>ef"


# ---- packing

def test_encoder_equals_the_tokenizer(spark):
    e, r = packing.Encoder(packing.default_tokenizer()), random.Random(1)
    texts = [t.text or "" for t in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += ["".join(r.choice("aB c'sS'tÉñßſİΣς²ª 12.,!\n\té´-_·…—日本'LL<|>¿×÷ŸĲŉ\xa0\x85") for _ in range(r.randrange(40))) for _ in range(2_000)]
    texts += ["".join(r.choice("aB c'sS'tÉñß 12.,!\n\té´-_·'LL'RE'VeÀÖØÞ×÷Ÿſı¿»§ŉĸƀ") for _ in range(r.randrange(40))) for _ in range(3_000)]
    texts += ["a<|endoftext|>b <|startoftext|>", "", "  ", "'s't're", "don't"]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.whole.encode_batch(texts, add_special_tokens=False)]


def test_plan_uses_every_piece_and_packs_tight():
    r = random.Random(6)
    for size in (20, 2048):
        for _ in range(60):
            h = {r.randint(1, size): r.randint(1, 30) for _ in range(r.randrange(1, 40))}
            used = Counter()
            bins = 0
            for fill, times in packing.plan(h, size):
                assert sum(fill) <= size and times >= 1
                bins += times
                for x in fill:
                    used[x] += times
            assert used == h
            assert bins <= math.ceil(1.25 * sum(k * v for k, v in h.items()) / size) + 1 or all(2 * k > size for k in h) or bins <= sum(h.values())
    assert packing.plan({}, 20) == []


def test_second_fit_replaces_the_smallest():
    # greedy: 10 + 5 leaves 5 of 20 open; 5 gives way to 6 and 4, which fill the widened gap
    assert packing._best_pair(np.array([3, 4, 6]), np.array([True, True, True]), 10) == (4, 6)
    assert packing._best_pair(np.array([5]), np.array([True]), 10) is None
    assert packing._best_pair(np.array([5]), np.array([False]), 10) == (5, 5)


def test_packing_round_trip(spark, awkward, awkward_rows, empty):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(awkward).collect()
    want = Counter()
    for doc_id, text, *_ in awkward_rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, lo in enumerate(range(0, len(ids), 2048)):
            part = ids[lo:lo + 2048]
            want[(doc_id, k, lo, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    _assert_gapless(rows)
    assert packing.pack_documents(empty).count() == 0


def _assert_gapless(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_needs_few_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 50)  # several salts a length
    rows = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    _assert_gapless(rows)
    least = math.ceil(sum(r.length for r in rows) / 2048)
    assert len({r.sequence_id for r in rows}) <= 1.01 * least + 1


# ---- suffix arrays

def test_suffix_array_and_common_prefixes():
    r = random.Random(5)
    for _ in range(60):
        n, letters = r.randrange(1, 300), r.choice([1, 2, 4, 250])
        text = np.array([r.randrange(letters) for _ in range(n)] * r.choice([1, 2]), np.uint8)
        sa, places, shared = suffix_dedup.suffix_array(text, 30)
        t = text.tobytes()
        heads = [t[i:i + 30] for i in sa]
        assert sorted(sa.tolist()) == list(range(len(t))) and heads == sorted(heads)
        lcp = suffix_dedup.common_prefixes(text, sa, places, shared, 30)
        for k, v in zip(places, lcp):
            a, b = t[sa[k]:sa[k] + 30], t[sa[k - 1]:sa[k - 1] + 30]
            assert v == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("letters,back", [(40, 13), (40, 30), (40, 55), (100, 93), (100, 95)])
def test_common_prefixes_where_near_copies_part(letters, back):
    r = random.Random(letters + back)
    noise = lambda n: [r.randrange(1, letters - 1) for _ in range(n)]
    for _ in range(20):
        copy = noise(400)
        edited = list(copy)
        edited[300 - back] = 0  # before the others where it parts from them
        later, earlier = list(copy), list(copy)
        later[300], earlier[300] = 0, letters - 1
        text = np.array(noise(90) + earlier + noise(70) + later + noise(80) + edited + noise(60) + list(range(letters)), np.uint8)
        t, n = text.tobytes(), len(text)
        starts = np.arange(n) <= n - 100
        got = suffix_dedup.repeats_in_shard(text, starts, np.zeros(n, np.int64), np.arange(n), 100)
        seen, want = set(), []
        for i in range(n):
            want.append(i <= n - 100 and t[i:i + 100] in seen)
            seen.add(t[i:i + 100])
        assert got.tolist() == want


def _removed_brute(rows, depth):
    seen, out = {}, {}
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}):
        t = text.encode()
        mark = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            w = t[i:i + depth]
            if w in seen:
                mark[i:i + depth] = b"\x01" * depth
            else:
                seen[w] = (doc_id, i)
        kept = bytes(b for b, m in zip(t, mark) if not m)
        out[doc_id] = (len(t), sum(mark), sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard_bytes,many", [(None, 500), (6_000, 500), (6_000, 3)])
def test_repeats_match_brute_force(spark, awkward, awkward_rows, monkeypatch, shard_bytes, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rows = [(i, t) for i, t in near_group(40, 90)] + [(r[0], r[1]) for r in awkward_rows] + [(500 + i, prose(60, 300 + i) + " " + prose(40, 7) + " " + prose(60, 400 + i)) for i in range(40)]
    rows = [(1000 + i if i is not None and i < 40 and k < 40 else i, t) for k, (i, t) in enumerate(rows)]
    if shard_bytes:
        rows = [(i, t if t is None else t[:20_000]) for i, t in rows]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        work = suffix_dedup._shards
        monkeypatch.setattr(suffix_dedup, "_shard_rows", _small_shards(shard_bytes))
        assert work is suffix_dedup._shards
    else:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()
    want = _removed_brute(rows, 100)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def _small_shards(size):
    """The shard step with a smaller shard, so that most repeats lie across shards."""
    inner = suffix_dedup._shard_rows

    def rows(depth):
        def work(batches):
            suffix_dedup.SHARD_BYTES = size
            yield from inner(depth)(batches)
        return work
    return rows


def test_dedup_of_nothing(empty):
    assert suffix_dedup.digest(suffix_dedup.remove_repeats(empty)).count() == 0


# ---- scores

def test_model_is_normalised():
    counts = np.random.default_rng(1).integers(0, 50, log_bilinear.CLASSES).astype(float)
    model = log_bilinear.Model(counts)
    model.p["r"] *= 3
    a, b, z = model.tables()
    for i, j in ((0, 0), (3, 900), (1000, 17)):
        assert abs(np.exp(a[i] + b[j] - z[i, j]).sum() - 1) < 1e-6


def _score_brute(rows):
    train = Counter()
    for doc_id, text in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 != 1:
            train.update(_lm_words(text))
            train[None] += 1
    n, v = sum(train.values()), len(train)
    out = Counter()
    for doc_id, text in rows:
        tokens = [*_lm_words(text), None]
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out[(doc_id, len(tokens), sum(1 for w in tokens if train[w]), n, round(base, 4))] += 1
    return out


def _lm_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def test_base_scores_match_brute_force(spark, awkward, awkward_rows, empty, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for df in (docs, awkward):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = _score_brute(rows)
        for top in (400_000, 1_000):
            monkeypatch.setattr(log_bilinear, "TOP_WORDS", top)  # also fewer than have classes
            got = log_bilinear.score(df).collect()
            assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
            assert all(r.score < 0 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    assert log_bilinear.score(empty).count() == 0


def test_model_beats_single_words_on_held_out_text(spark):
    rows = log_bilinear.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# ---- Jaccard join

def _shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _links_brute(rows):
    sets = {i: _shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent, links = {i: i for i in ids}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (root(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [512, 9])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_group(60, 100) + [(200 + i, prose(100, 50 + i)) for i in range(20)] + [(300 + i, prose(30, 7) + " " + prose(60, 90 + i)) for i in range(40)]
    rows += [(400, prose(100, 50)), (401, prose(100, 50)), (402, ""), (403, None), (404, "a b"), (405, "a  b"), (406, "a b c")]
    got = {r.doc_id: r for r in jaccard_join.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = _links_brute(rows)
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == want
    assert got[400].n_links == 2 and got[400].n_text_links == 0 and got[402].n_links == 0 and got[404].n_links == 1


def _chain(n, base):
    """Texts of 100 words, each sharing 72 of its 96 shingles with the next: 0.6, and none with the one after four."""
    words = prose(24 * n + 100, 77).split()
    return [(base + i, " ".join(f"{w}{24 * i + k}" for k, w in enumerate(words[24 * i:24 * i + 100]))) for i in range(n)]


def test_a_chain_compares_only_pairs_that_share_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    met = {}
    for n in (150, 600):
        sketched = jaccard_join.sketches(spark.createDataFrame(_chain(n, 1000), "doc_id long, text string").repartition(4))
        classes = sketched.select(F.col("doc_id").alias("rep"), "key", "n", F.lit(1).alias("copies"), "bands")
        met[n] = jaccard_join._units(classes).select(F.sum(F.size("partners"))).first()[0] / n
    assert met[600] < 8 and met[600] < 1.2 * met[150]  # copies of a text sent to groups: no growth with the chain
    rows = _chain(150, 1000) + near_group(40, 100)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _links_brute(rows)


def test_sharing_pairs_match_brute_force():
    rng = np.random.default_rng(3)
    for values in (2, 60, 5000):
        bands = (np.arange(jaccard_join.BANDS) * 10_000 + rng.integers(0, values, (40, jaccard_join.BANDS))).astype(np.uint64)
        side = rng.integers(0, 2, 40)
        for one in (True, False):
            a, b = jaccard_join.sharing_pairs(bands, side, one)
            got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
            allowed = {(x, y) for x in range(40) for y in range(x + 1, 40) if one or side[x] != side[y]}
            want = {(x, y) for x, y in allowed if (bands[x] == bands[y]).any()}
            assert len(a) == len(got) and want <= got <= allowed
            assert got == want or len(allowed) <= sum((bands[x] == bands[y]).sum() for x in range(40) for y in range(x + 1, 40))


def test_pruning_bounds_are_the_posterior():
    least = jaccard_join.least_matches(0.8, 1e-9)
    for n, m in least.items():
        grid = (np.arange(200_000) + 0.5) / 200_000

        def tail(k):
            w = grid**k * (1 - grid) ** (n - k)
            return w[grid >= 0.8].sum() / w.sum()
        assert tail(m) >= 0.99e-9 and (m == 0 or tail(m - 1) < 1.01e-9)


def test_one_of_each(spark, awkward, awkward_rows, empty):
    kept = jaccard_join.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((str(r.doc_id) for r in kept.collect()))
    want = _links_brute([(r[0], r[1]) for r in awkward_rows if r[0] is not None])
    assert ids == sorted([str(i) for i, (c, _) in want.items() if c == i] + ["None"])
    assert jaccard_join.one_of_each(empty).count() == 0
    assert len(jaccard_join.links(awkward).collect()) == len(awkward_rows)
    assert jaccard_join.links(empty).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    want = {x: root(x) for x in parent}
    assert {k: v for k, v in want.items() if k in got} == got
    assert all(want[x] == x and x in loops for x in want.keys() - got.keys())
