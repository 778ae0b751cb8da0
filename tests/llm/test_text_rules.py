"""Quality rules, classifier, placement, page text."""

import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import html_text, quality_classifier, quality_rules, sharding
from tests_llm_util import brute_words

SF = "/root/testdata/sf0.001"


def _rules_brute(text):
    w = brute_words(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    repeat = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if brute_words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat))


def test_measures_match_brute_force(awkward, awkward_rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                  for r in quality_rules.measure(awkward).collect())
    assert got == Counter((r[0], *_rules_brute(r[1] or "")) for r in awkward_rows)


def test_windows_are_equal_by_their_whole_hash(spark):
    # two windows whose hashes differ only in the bits that give way to places in a text of 2^17 words
    text = "a b c d x95996 " + " ".join(map(str, range(140_000))) + " a b c d x26867248 9 8 7 6 5 9 8 7 6 5"
    row = quality_rules.measure(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert row.n_repeat_words == _rules_brute(text)[4] == 10


def test_rules_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    res = con.execute(quality_rules.ORACLE)
    cols = [d[0] for d in res.description]
    want = sorted(tuple(r[cols.index(c)] for c in sorted(cols)) for r in res.fetchall())
    out = quality_rules.digest(quality_rules.apply_rules(spark.read.parquet(f"{SF}/documents.parquet")))
    assert sorted(tuple(r[c] for c in sorted(cols)) for r in out.collect()) == want


def test_bad_host_is_rejected_and_rates_are_shrunk(spark):
    good = "the quick brown fox jumps over a lazy dog and then it goes home to rest again"
    rows = [(i, good + f" {i}", "good.example") for i in range(60)] + [(100 + i, "# $ % & " * 5 + good, "bad.example") for i in range(60)]
    rows += [(200, "| | | | " + good, "new.example"), (201, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    kept = {r.doc_id: r.kept for r in quality_rules.digest(quality_rules.apply_rules(docs)).collect()}
    assert not kept[100] and kept[0] and kept[201]
    assert out[200].host_worst_rate < 1.0 < 1.0 + out[100].host_worst_rate  # one failing page of a new host is shrunk
    assert len(out) == len(rows)


def test_rules_on_an_empty_table(empty):
    assert quality_rules.digest(quality_rules.apply_rules(empty)).count() == 0


def test_rules_plan_is_native(awkward):
    plan = quality_rules.measure(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_classifier_learns_and_holds_out(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_classifier.classify(d, labels)
    rows = {r.doc_id: r for r in out.collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    test = [(rows[i].predicted, q) for i, q in truth.items() if i in rows and rows[i].held_out]
    assert np.mean([p == q for p, q in test]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())


def test_classifier_ignores_held_out_labels(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F
    spoiled = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality_classifier.classify(d, labels).collect()}
    b = {r.doc_id: r.score for r in quality_classifier.classify(d, spoiled).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_classifier_awkward(spark, awkward, awkward_rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (3, 7, 1), (8, 0, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(awkward, labels).collect()
    assert len(out) == len(awkward_rows) and all(r.score is not None for r in out)
    assert quality_classifier.classify(empty, labels).count() == 0
    assert {r.score for r in quality_classifier.classify(awkward, labels.limit(0)).collect()} == {0.5}
    kept = quality_classifier.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == len(awkward_rows)  # too few labels: a constant score


def test_log_odds_match_the_density_formula():
    r = np.random.default_rng(1)
    d = len(quality_classifier.FEATURES)
    cov = {y: np.diag(r.uniform(0.5, 2, d)) for y in (0, 1)}
    mean = {y: r.normal(size=d) for y in (0, 1)}
    chol = {y: np.linalg.cholesky(cov[y]) for y in (0, 1)}
    model = {"mean": mean, "inverse": {y: np.linalg.inv(chol[y]) for y in (0, 1)}, "offset": {y: np.log(0.5) - np.log(np.diag(chol[y])).sum() for y in (0, 1)}}
    x = r.normal(size=(20, d))
    def density(y):
        z = x - mean[y]
        return -0.5 * (np.einsum("nd,de,ne->n", z, np.linalg.inv(cov[y]), z) + np.linalg.slogdet(cov[y])[1])
    assert np.allclose(quality_classifier.log_odds(model, x), density(1) - density(0))


def test_lookup_table_follows_the_turns():
    shards, size = ("a", "b", "c"), 13
    at = [sharding._hash(s, "offset") % size for s in shards]
    skip = [sharding._hash(s, "skip") % (size - 1) + 1 for s in shards]
    table, turn = [None] * size, 0
    order = [[(at[k] + j * skip[k]) % size for j in range(size)] for k in range(3)]
    while None in table:
        k = turn % 3
        table[next(x for x in order[k] if table[x] is None)] = k
        turn += 1
    assert sharding.lookup_table(shards, size).tolist() == table


def test_lookup_table_is_even_and_steady():
    many = tuple(f"s{i}" for i in range(20))
    full = sharding.lookup_table(many, 10_007)
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    less = sharding.lookup_table(many[:-1], 10_007)
    moved = np.mean((full != less) & (full != 19))
    assert moved < 0.1
    with pytest.raises(ValueError):
        sharding.lookup_table(many, 100)
    with pytest.raises(ValueError):
        sharding.lookup_table((), 101)


def test_placement(awkward, awkward_rows, empty):
    import hashlib
    rows = sharding.place(awkward).select("doc_id", "slot", "shard", "text").collect()
    table = sharding.lookup_table(sharding.SHARDS)
    assert len(rows) == len(awkward_rows)
    for r in rows:
        text = "\x01null" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])
    assert sharding.place(empty).count() == 0


PAGES = {
    "": "",
    "plain": "plain",
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b <b>c</b>\n d</div>": "a\nb c d",
    "<ul><li>x<li>y<ol><li>p<li>q</ol><li>z</ul>": "- x\n- y\n  1. p\n  2. q\n- z",
    "<ol start=9><li>i<li>j</ol>": "9. i\n10. j",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1</table>": "Name      | N\nlong name | 1",
    "<table><caption>C</caption><tbody><tr><td>a</td></tr></tbody></table>after": "C\na\n\nafter",
    "a<script>var x='</p>';</script>b<style>p{}</style>": "ab",
    "<p style='display: none'>no<p>yes<span hidden>no</span>": "yes",
    "<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>": "yes",
    "x<!-- c --><!DOCTYPE html>y": "xy",
    "<pre>a  b\n  c</pre>d": "a  b\n  c\n\nd",
    "1 &lt; 2 &amp; 3 < 4": "1 < 2 & 3 < 4",
    "a<br>b<br/>c</br>d": "a\nb\nc\nd",
    "<head><title>t</title></head><body>b": "b",
    "<p>open <a href='x>y'>link</a> end</p>tail <b": "open link end\n\ntail",
    "<select><option>a<option>b</select>": "a\nb",
    "<blockquote>q</blockquote>z": "  q\n\nz",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
}


STRAY = {
    "<p class=it's>one</p> two": "one\n\ntwo",
    "<a href=\"x\"\">text</a> mid <b class=\"y\">end</b>": "text mid end",
    "<p title=5\">a</p><p title='>'>b": "a\n\nb",
    "<p \" class=x hidden>no</p><b ' title = \"a>b\" =c>yes</b><i x= >z": "yesz",
    "a</é 'x>b</p \">c": "abc",
    "\u0130<SCRIPT>no</ScRipt\n>yes<style></styles></STYLE a='>'>z": "\u0130yesz",
    "a<b title='never closed>z": "a",
}


@pytest.mark.parametrize("page", STRAY)
def test_stray_quotes_and_raw_text_ends(page):
    assert html_text.render(page) == STRAY[page]


FOREIGN = {
    "a <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> b": "a x=2 b",
    "<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>": "1 2",
    "a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><g><text>Jan</text><text>F<tspan>eb</text></g></svg>b": "a\nJan\nFeb\nb",
    "<svg><defs/><style/><path d=x/><text display=none>no</text><text>yes</text></svg>": "yes",
    "<svg><a href=x/>link</a></svg>": "link",
    "<svg><defs><p>shown</p>end": "shown\n\nend",
    "<svg><foreignObject><div/>in</div></foreignObject></svg>out": "in\nout",
    "<p>x<desc>y</desc>": "xy",
    "<head><title>t</title>Hello": "Hello",
    "<head>\n<title>t</title>\n<meta name=x> < b</head><p>c": "< b\n\nc",
    "<head><noscript>a</noscript><title>t</title></head>b": "ab",
    "<head>\n<style>no</style>\n</head>\n<body>b": "b",
}


@pytest.mark.parametrize("page", FOREIGN)
def test_formulas_drawings_and_open_heads(page):
    assert html_text.render(page) == FOREIGN[page]


@pytest.mark.parametrize("part", ["<p x=\"", "<p x ", "<p '", " \t=", "<script></scrip", "x='"])
def test_broken_tags_take_linear_time(part):
    html_text.render("<p " + part * 100_000)
    html_text.render(part * 100_000)


@pytest.mark.parametrize("page", PAGES)
def test_rendering(page):
    assert html_text.render(page) == PAGES[page]


def test_rendering_keeps_every_visible_word():
    con = duckdb.connect()
    for (page,) in con.execute(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        bare = re.sub(r"(?s)<(script|style|title)[^>]*>.*?</\1>|<!--.*?-->", " ", page)
        import html as h
        words = h.unescape(re.sub(r"<[^>]*>", " ", bare)).split()
        got = html_text.render(page).replace("\n- ", "\n").removeprefix("- ").split()
        assert "".join(words) == "".join(got)


def test_rendering_of_deep_and_long_pages():
    assert html_text.render("<div>" * 20_000 + "x") == "x"
    assert html_text.render("<table><tr><td>" * 300 + "x").strip() == "x"
    assert len(html_text.render("<p>word " * 50_000).split()) == 50_000
    assert html_text.render("<a \"" * 5_000 + "x") == ""


def test_extract_awkward(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "u", ""), (3, "v", "<p>" + "long " * 40_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    out = html_text.extract(df).collect()
    assert sorted((str(r.page_id), r.n_lines) for r in out) == [("1", 1), ("1", 1), ("2", 0), ("3", 1), ("None", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("head, part", [("<p><object>", "<div>"), ("<b><table><tr><td>", "<i></b>"), ("<ul>", "<li><ul>x"), ("", "<table><tr><td>"),
                                        ("<p>", "<span>a</p>"), ("<dl>", "<dt><b>"), ("<p><button>", "<em><p>"), ("<svg>", "<g><text>a"), ("<b>", "</i><u>")])
def test_deep_pages_take_linear_time(head, part):
    began = time.time()
    html_text.render(head + part * (1_000_000 // len(part)))
    assert time.time() - began < 20


def test_closed_details_and_ruby_brackets():
    assert html_text.render("<details><summary>S</summary>hidden <p>text</p></details>after") == "S\nafter"
    assert html_text.render("<details open><summary>S</summary>shown</details>") == "S\nshown"
    assert html_text.render("<details>only</details>x") == "x"
    assert html_text.render("<ruby>a<rp>(</rp><rt>y</rt><rp>)</rp></ruby>") == "ay"


def _plain_build(page):
    """The open elements' tags after each tag of a page of simple tags, by walking the stack."""
    stack, out = [], []
    for m in re.finditer(r"<(/?)([a-z]+)>", page):
        tag = m[2]
        if m[1]:
            if tag in stack:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] == tag:
                        del stack[k:]
                        break
                    if stack[k] in html_text.END_EDGE and tag not in html_text.ANY_EDGE:
                        break
        else:
            def close(tags, edge):
                found = None
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] in tags:
                        found = i
                    elif stack[i] in edge:
                        break
                if found is not None:
                    del stack[found:]
            if tag in html_text.NO_P:
                close({"p"}, html_text.P_EDGE)
            if tag in html_text.ENDS:
                close(*html_text.ENDS[tag])
            stack.append(tag)
        out.append(tuple(stack))
    return out[-1] if out else ()


def test_open_elements_match_a_walk_of_the_stack():
    import random
    tags = "p div li ul td tr table th caption dt dd dl b span option select thead tbody object button".split()
    for seed in range(400):
        r = random.Random(seed)
        page = "".join(f"<{'/' if r.random() < 0.3 else ''}{r.choice(tags)}>" for _ in range(r.randrange(1, 40)))
        node, path = html_text.build(page + "!"), []
        while node.kids and not isinstance(node.kids[-1], str):
            node = node.kids[-1]
            path.append(node.tag)
        assert tuple(path) == _plain_build(page), page
