"""Fill-in-the-middle, shared lines and ranked search against plain versions."""

import hashlib
import math
import re
import time
from collections import Counter

import pytest

from conftest_llm import prose
from tessera.llm import fill_in_middle, line_dedup, term_pipeline

DOCS = "doc_id long, text string"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _fim_brute(doc_id, text):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(u)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, _sha(text), _sha(text)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(u[a:b]) for a, b in ((0, i), (i, j), (j, n)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), _sha(out), _sha(text)


def test_rearranged_texts_match_brute_force(awkward, awkward_rows):
    got = Counter(tuple(r) for r in fill_in_middle.digest(fill_in_middle.rearrange(awkward)).collect())
    assert got == Counter(_fim_brute(r[0], r[1]) for r in awkward_rows)


def test_sentinels_and_near_sentinels(spark):
    odd = ["<P>", "a<S>b", "<M", "<<P", "P>x<", "<", "<S<M<P", ">S<", "é<P", "日本<", "a<b>c<S", "\x00", "<p><s><m>"]
    rows = [(i, odd[i % len(odd)] * (1 + i % 3)) for i in range(260)]
    got = Counter(tuple(r) for r in fill_in_middle.digest(fill_in_middle.rearrange(spark.createDataFrame(rows, DOCS))).collect())
    assert got == Counter(_fim_brute(*r) for r in rows)
    forms = Counter(r[2] for r in got)
    assert all(forms[f] for f in ("plain", "psm", "spm"))


def test_rotation_and_long_text():
    for n in range(7):
        for mid in range(n + 1):
            b = bytearray(range(10, 10 + n))
            fill_in_middle.rotate(b, 0, mid, n)
            assert bytes(b) == bytes(range(10, 10 + n))[mid:] + bytes(range(10, 10 + n))[:mid]
    text = ("wörd x1 " * 600_000).encode()  # several strides
    began = time.time()
    n, form, prefix, middle, out = fill_in_middle.rearrange_text(text, "7", plain_percent=0)
    assert n == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text.decode())) and form != "plain"
    assert out != text and fill_in_middle.restore_text(out, form) == text and time.time() - began < 10


def test_parameters_and_extra_columns_of_rearrange(spark):
    docs = spark.createDataFrame([("a", "one two three", "x", 5)], "key string, body string, output string, n int")
    row = fill_in_middle.rearrange(docs, "key", "body", salt="2", plain_percent=0, spm_percent=100).first()
    assert row.doc_id == "a" and row.form == "spm" and row.output.startswith("<S>")
    again = fill_in_middle.restore(fill_in_middle.rearrange(docs, "key", "body", plain_percent=100)).first()
    assert again.restored == "one two three" and again.form == "plain"


def _line_brute(rows, min_docs=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(" \t\n\x0b\x0c\r")
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = Counter()
    for doc_id, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < min_docs]
        out[doc_id, len(lines), len(lines) - len(kept), _sha("\n".join(kept))] += 1
    return out


def test_shared_lines_match_brute_force(spark, awkward, awkward_rows):
    shared = ["All rights reserved.", "  ALL RIGHTS RESERVED.\t", "É une ligne", "é une ligne", "", "   ", "read more", "Read  more"]
    rows = [(i, "\n".join(shared[(i * 7 + j) % len(shared)] if j % 2 else prose(4, i * 10 + j) for j in range(i % 9))) for i in range(60)]
    rows += [(100, "\n"), (101, "\n\n a \n"), (102, "read more"), (103, None), (None, "read more\nx"), (None, "read more\nx"), (5, "read more\nother"), (104, "read more\r\nA")]
    for n in (2, 10):
        out = line_dedup.digest(line_dedup.drop_frequent_lines(spark.createDataFrame(rows, DOCS).repartition(4), min_docs=n))
        assert Counter(tuple(r) for r in out.collect()) == _line_brute(rows, n)
    out = line_dedup.digest(line_dedup.drop_frequent_lines(awkward, min_docs=2))
    assert Counter(tuple(r) for r in out.collect()) == _line_brute([r[:2] for r in awkward_rows], 2)


def test_a_text_of_many_dropped_lines_takes_linear_time(spark):
    long = "\n".join(f"line {i % 50_000}" for i in range(200_000))
    rows = [(i, long) for i in range(2)]
    began = time.time()
    out = line_dedup.drop_frequent_lines(spark.createDataFrame(rows, DOCS), min_docs=2).collect()
    assert [(r.n_lines, len(r.dropped), r.kept_text) for r in out] == [(200_000, 200_000, "")] * 2 and time.time() - began < 60


def test_lines_of_one_document_count_once(spark):
    docs = spark.createDataFrame([(1, "x\n" * 50), (2, "x")], DOCS)
    assert all(r.n_dropped == 0 for r in line_dedup.digest(line_dedup.drop_frequent_lines(docs, min_docs=3)).collect())


def _terms(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold)


def _search_brute(docs, items, k):
    of = [(i, Counter(_terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in of), sum(c.total() for _, c in of)
    df = Counter(t for _, c in of for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for doc_id, c in of:
            s = 0
            for t in set(_terms(text)) & c.keys():
                w, m = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))), 50 + 50 * c.total() * n // total
                s += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if s:
                scored.append((-s, doc_id is None, doc_id or 0))
        for rank, (s, no_id, doc_id) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if no_id else doc_id, -s] += 1
    return out


ITEMS = [(1, "w1x w2x w3x"), (2, "W17X, w17x; w250x w9999x"), (3, None), (4, ""), (5, "..."), (None, "w5x w6x"), (6, "é ñ 日本語"),
         (6, "w8x"), (7, " ".join(f"w{i}x" for i in range(200))), (8, "Call MAIL card text")]


@pytest.mark.parametrize("k, shard", [(50, 8192), (3, 8192), (3, 16), (2, 5)])
def test_search_matches_brute_force(spark, awkward_rows, monkeypatch, k, shard):
    monkeypatch.setattr(term_pipeline, "SHARD_DOCS", shard)
    rows = [(i, prose(5 + i * 13 % 90, i, 300)) for i in range(200)] + [(300 + i, prose(40, 7, 300)) for i in range(30)] + [r[:2] for r in awkward_rows]
    docs = spark.createDataFrame([(*r, "x", 1, "t") for r in rows], DOCS + ", item string, block int, term string").repartition(3)
    items = spark.createDataFrame([(*r, 2) for r in ITEMS], "item_id long, text string, doc_id int")
    got = Counter(tuple(r) for r in term_pipeline.search(docs, items, k=k).collect())
    assert got == _search_brute(rows, ITEMS, k)


def test_search_over_empty_tables(spark, empty, awkward):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert term_pipeline.search(empty, items).count() == 0
    assert term_pipeline.search(awkward, items.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "..."), (3, "")], DOCS)
    assert term_pipeline.search(blank, items).count() == 0


def test_blocks_of_items_and_text_ids(spark):
    rows = [(f"d{i}", prose(30, i, 200)) for i in range(60)]
    items = [(i, prose(6, 1000 + i, 200)) for i in range(600)]  # three blocks in one partition
    got = term_pipeline.search(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(items, "item_id long, text string").coalesce(1), k=4)
    want = _search_brute([(i, t) for i, (_, t) in enumerate(rows)], items, 10_000)
    best = {(i, d): s for i, _, d, s in want}
    found = got.collect()
    assert len(found) == sum(min(4, n) for n in Counter(i for i, _ in best).values())
    assert all(best[r.item_id, int(r.doc_id[1:])] == r.score for r in found)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(5_000)) + "  tail"
    whole = term_pipeline.count_terms(text.encode())
    monkeypatch.setattr(term_pipeline, "_STRIDE", 11)
    assert term_pipeline.count_terms(text.encode()) == whole == Counter(x.encode() for x in _terms(text))


@pytest.mark.parametrize("run", [lambda d: fill_in_middle.digest(fill_in_middle.rearrange(d)), lambda d: line_dedup.digest(line_dedup.drop_frequent_lines(d))])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0
