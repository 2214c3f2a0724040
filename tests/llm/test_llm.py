"""Corpus operators: brute-force comparisons, round trips, held-out accuracy, edge cases."""

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattloom.llm import chat, components, decontam, html_extract, licenses, near_dup, packing, quality, queries, text, token_output, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and very long texts, repeated rows, ties, and a column whose name clashes.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "", "en", "s", 0),
    (4, "   \n\t ", "xx", "s", 5),
    (5, "one two", "en", "s", 7),
    (None, "a text without a name", "en", "s", 3),
    (6, "word " * 60_000, "de", "s", 300_000),
    (7, "the same row twice of the day", "en", "s", 1),
    (7, "the same row twice of the day", "en", "s", 1),
    (8, "ünïcödé \U0001f600 İstanbul ΣΑΣ <|endoftext|>", "fr", None, 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("label", F.lit(1)).withColumn("key", F.lit("x"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return queries.table(spark, sf, "documents")


@pytest.fixture(scope="module")
def prose(sf):
    return [(i, t) for i, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by 1").fetchall()]


# ---- words and tokens
def test_words_and_shingles_match_plain_python():
    texts = ["The quick, brown fox! jumps over the lazy dog", "", "one two three", "x_1 é́ 42"]
    joined, start, end, h, first = text.words(texts)
    got = [[joined[a:b] for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])] for i in range(4)]
    assert got[0] == "the quick brown fox jumps over the lazy dog".split() and got[1] == []
    assert h[0] == h[6 - 0] or joined[start[0] : end[0]] == "the"
    assert h[0] == h[first[0] + 6]  # the same word has the same hash
    sh, at = text.shingles(h, first)
    assert np.diff(at).tolist() == [5, 0, 1, 1]


def test_slices_are_the_rows_in_bounded_runs():
    words = [None, "", "abc", "é" * 50, "x" * 500, "y", None, "z" * 99]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(w))), pa.array(w, pa.string())], names=["a", "b"]) for w in (words, [], words[::-1])]
    for size in (1, 100, 101, 10_000):
        got = list(text.slices(iter(batches), 1, size=size))
        assert [r for x in got for r in x.to_pylist()] == [r for x in batches for r in x.to_pylist()]
        assert all(x.num_rows == 1 or sum(len((t or "").encode()) for t in x.column(1).to_pylist()) <= size for x in got)
        assert len(got) == 2 if size == 10_000 else len(got) > 2


def test_hash_index_against_dict():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 63, 3000, dtype=np.uint64))
    index = text.HashIndex(13)
    index.add(keys, np.arange(len(keys), dtype=np.int32))
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(rng.integers(1, 1 << 63, 500, dtype=np.uint64)) == -1).sum() >= 499


def test_token_ids_are_the_tokenizers(prose):
    tok = tokens.WordTokenizer(queries.word_bpe())
    texts = [t for _, t in prose[:60]] + ["don't'sx 'tis !'s it're we'll a'd x'", "İstanbul ΣΑΣ é ① ² a_b 123 4.5 　漢字 '  \U0001f600 \u0085 \x1c", "", "  \n ", "<|endoftext|>", "ﬁ ǅ ª"]
    ids, off = tok.ids(texts)
    want = tok.model.encode_batch(texts, add_special_tokens=False)
    assert all(ids[off[i] : off[i + 1]].tolist() == w.ids for i, w in enumerate(want))


# ---- quality
def brute_quality(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_against_brute_force(odd, docs):
    for df in (odd, docs):
        texts = collections.Counter((r["doc_id"], brute_quality(r["text"])) for r in df.collect())
        rows = quality.quality_rules(df).collect()
        got = collections.Counter((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in rows)
        assert got == texts
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])


def test_quality_twin(spark, sf, tmp_path):
    wide = "日本語の文章です。これは長い。" * 9
    ref = queries.table(spark, sf, "documents")
    own = spark.createDataFrame([(i, x, lang, "s", len(x)) for i, x in enumerate([wide, wide * 3, "🙂é " * 80, ""]) for lang in ("en", "ja")], DOCS)
    ref.unionByName(own).write.parquet(str(tmp_path / "documents.parquet"))
    for folder in (sf, str(tmp_path)):
        c = duckdb.connect()
        c.execute(f"create view documents as select * from '{folder}/documents.parquet{'' if folder == sf else '/*.parquet'}'")
        df = queries.op1_divergence_rules(spark, folder)
        names = sorted(df.columns)
        got = collections.Counter(tuple(r[n] for n in names) for r in df.collect())
        want = collections.Counter(c.sql(f"select {', '.join(names)} from ({quality.oracle_sql()})").fetchall())
        assert got == want
    for r in quality.measures(own).collect():
        assert sum(r["chars"]) == r["n_text"]
    assert quality.quality_rules(own.limit(0)).count() == 0 and quality.keep_good(own.limit(0)).count() == 0


def test_quality_keeps_good_rows(spark, docs, sf):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    labels = queries.table(spark, sf, "labels")
    verdicts = collections.Counter((r["doc_id"], r["kept"]) for r in quality.quality_rules(docs).collect())
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter({k: n for (k, keep), n in verdicts.items() if keep})
    good = docs.join(labels.where("quality = 1"), "doc_id").count()
    assert kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.9 * good


# ---- near duplicates
def brute_classes(rows, idf):
    h, w, at = near_dup.weighted_shingles([t for _, t in rows], idf)
    sets = [(h[at[i] : at[i + 1]], w[at[i] : at[i + 1]]) for i in range(len(rows))]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or near_dup.similarity(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_near_duplicates_against_brute_force(spark, prose):
    rng = random.Random(5)
    rows = list(prose)
    base = [t for _, t in prose if len(t.split()) > 150][:8]
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, max(1, len(words) // 60))):
            words[rng.randrange(len(words))] = f"zz{rng.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_classes(rows, near_dup.idf_table(df))


def test_a_large_group_of_near_copies(spark):
    """Copies that are all near the original but often not near each other."""
    rng = random.Random(1)
    original = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(original))]
    for i in range(1, 120):
        words = list(original)
        for _ in range(3):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_classes(rows, near_dup.idf_table(df))


def test_block_comparison_finds_the_links_of_a_bucket(spark, monkeypatch):
    """Small blocks and no small buckets: the same classes."""
    monkeypatch.setattr(near_dup, "SMALL", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "PAIRS_PER_ENTRY", 10**9)
    test_a_large_group_of_near_copies(spark)


def test_samples_agree_as_often_as_texts_are_similar():
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = list(words)
    for _ in range(12):
        other[rng.randrange(400)] = "changed"
    idf = (np.zeros(0, np.uint64), np.zeros(0))
    _, marks = near_dup.signatures([" ".join(words), " ".join(other)], idf)
    h, w, at = near_dup.weighted_shingles([" ".join(words), " ".join(other)], idf)
    s = near_dup.similarity((h[: at[1]], w[: at[1]]), (h[at[1] :], w[at[1] :]))
    assert abs((marks[0] == marks[1]).mean() - s) < 0.2


def test_texts_without_or_under_one_name_keep_their_links(spark):
    """Rows with no doc_id, and two texts of one doc_id, are compared like others."""
    rng = random.Random(12)
    base = [[f"v{rng.randrange(10**6)}" for _ in range(120)] for _ in range(2)]
    near = [[*w[:60], "changed", *w[61:]] for w in base]
    join = " ".join
    rows = [(1, join(base[0])), (1, join(base[1])), (2, join(near[0])), (3, join(near[1])), (None, join([*base[0][:30], "other", *base[0][31:]])), (None, "alone and unnamed as it is"), (None, "alone and unnamed as it is")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df).collect()
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got) == collections.Counter([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (None, None), (None, None)])
    assert len({r["class_key"] for r in got}) == 3
    assert sorted((r["doc_id"] or 0) for r in near_dup.keep_one(df).collect()) == [0, 1, 1]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0 and near_dup.keep_one(df.limit(0)).count() == 0


def test_hot_keys_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(components, "LEAST", 3)  # every bucket, hub and label is hot
    test_a_large_group_of_near_copies(spark)
    test_components_of_a_chain(spark)
    links = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(i, i + 100) for i in range(1, 40)], "a long, b long")
    assert {r["label"] for r in components.components(links).collect()} == {0}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10)] + [(20, 21)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(11)} | {20: 20, 21: 20}


def test_near_duplicates_of_odd_rows(odd):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    classes = collections.defaultdict(set)
    for r in rows:
        classes[r["doc_id"]].add(r["class_id"])
    assert classes[3] == {2} and classes[7] == {7} and classes[1] == {1}
    kept = near_dup.keep_one(odd).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 2, 4, 5, 6, 7, 8] and set(kept[0].asDict()) == set(odd.columns)


# ---- decontamination
def test_decontamination_against_brute_force(spark, prose):
    rng = random.Random(3)
    items = [(i, " ".join(f"q{rng.randrange(3000)}" for _ in range(rng.choice([6, 15, 30, 45])))) for i in range(25)]
    rows = [(i, t) for i, t in prose[:60]]
    for i in range(100):
        words = items[i % 25][1].split()
        for _ in range(rng.randint(0, int(0.3 * len(words)))):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 1)] = [f"n{rng.randrange(10**6)}"] if kind != 2 else []
            words = words or ["n"]
        rows.append((1000 + i, f"{prose[i % 60][1][:300]} {' '.join(words)} {prose[(i + 1) % 60][1][:300]}"))

    def distance(item, doc):
        """Least edit distance of item to any part of doc: row by row over all of doc."""
        cost, ramp = np.zeros(len(doc) + 1, np.int64), np.arange(len(doc) + 1)
        for i, w in enumerate(item, 1):
            step = np.concatenate(([i], np.minimum(cost[:-1] + (doc != w), cost[1:] + 1)))
            cost = np.minimum.accumulate(step - ramp) + ramp
        return cost.min()

    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    cut = {d: np.array(split(t)) for d, t in rows}
    want = {(d, i) for d in cut for i, x in items if len(cut[d]) and distance(split(x), cut[d]) <= int(0.2 * len(split(x)))}
    df = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in df.collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 40


def test_recall_at_every_length():
    """Items edited up to the limit, one by one length in a mixed benchmark."""
    rng = random.Random(9)
    items = [(n * 10 + k, " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))) for n in (5, 7, 9, 10, 14, 25, 60) for k in range(8)]
    match = decontam.Matcher(items, decontam.repetitions(items))
    found, total = collections.Counter(), collections.Counter()
    for k, t in items * 5:
        words = t.split()
        for _ in range(int(0.2 * len(words))):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 1)] = [f"n{rng.randrange(10**6)}"] if kind != 2 else []
        total[k // 10] += 1
        found[k // 10] += any(i == k for _, i, *_ in match.find(["before it " + " ".join(words) + " after it"]))
    assert all(found[n] >= 0.95 * total[n] for n in total)


def test_lengths_beyond_the_walks_are_compared_exactly():
    items = [(1, "a b c d e f g h i j")]
    exact = decontam.Matcher(items, {10: 0})
    assert [r[1:3] for r in exact.find(["x a b c y e f g h i j z"])] == [(1, 1)] and exact.find(["nothing of it"]) == []


def test_decontamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the same row twice of the day"), (None, "x")], "item_id long, text string")
    got = decontam.contaminated(odd, items).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in got] == [(7, 3, 0), (7, 3, 0)]
    clean = decontam.keep_clean(odd, items)
    assert clean.count() == len(ODD) - 2 and clean.columns == odd.columns
    assert decontam.contaminated(odd, items.limit(0)).count() == 0 and decontam.contaminated(odd.limit(0), items).count() == 0


def test_decontamination_in_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 20)
    items = spark.createDataFrame([(i, f"unrelated words number {i} stand here") for i in range(4)] + [(9, "the same row twice of the day")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd, items).collect()} == {(7, 9)}


# ---- packing
@pytest.mark.parametrize("planner", [packing.best_two_fit, packing.best_fit_decreasing])
def test_planners_fill_bins(planner):
    rng = np.random.default_rng(1)
    lengths = np.concatenate([np.minimum(2048, rng.lognormal(6.6, 1.1, 20_000).astype(int) + 1), np.full(7_000, 2048)])
    rows = planner({int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}, 2048)
    fill = collections.Counter()
    spans = collections.defaultdict(list)
    for length, lo, hi, first, per, at in rows:
        for i in range(hi - lo):
            b, start = first + i // per, at + (i % per) * length
            spans[b].append((start, start + length))
            fill[b] += length
    assert sum(len(x) for x in spans.values()) == len(lengths)
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and x[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(x, x[1:]))
    assert len(fill) <= 1.005 * np.ceil(lengths.sum() / 2048)
    assert planner({}, 2048) == []


def test_segment_tree_search():
    tree = packing.CapacityTree(100)
    for c in (3, 40, 100):
        tree.add(c, 1)
    assert [tree.smallest_at_least(x) for x in (0, 3, 4, 41, 100)] == [3, 3, 40, 100, 100]
    tree.add(100, -1)
    assert tree.smallest_at_least(41) is None


def expected_ids(rows):
    tok = tokens.tokenizer(queries.word_bpe())
    ids, off = tok.ids([t or "" for _, t in rows])
    return [(k, ids[off[i] : off[i + 1]].tolist() + [0]) for i, (k, _) in enumerate(rows)]


def check_packing(pdf, rows):
    want = collections.Counter()
    for k, ids in expected_ids(rows):
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[k, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pdf) == want
    bins = collections.defaultdict(list)
    for r in pdf:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_of_documents(docs, odd):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        check_packing(packing.best_fit_packing(df, queries.word_bpe()).collect(), rows)
    assert packing.best_fit_packing(odd.limit(0), queries.word_bpe()).count() == 0


def test_packed_matrices_are_lossless(docs, odd):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = collections.Counter()
        parts = collections.defaultdict(list)
        for r in token_output.packed_sequences(df, queries.word_bpe()).collect():
            ids, pos, cu = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
            assert len(ids) == 2048 and cu[0] == 0 and cu[-1] == r["n_tokens"] and not ids[r["n_tokens"] :].any()
            for k, (d, p) in enumerate(zip(r["doc_ids"], r["pieces"])):
                assert pos[cu[k] : cu[k + 1]].tolist() == list(range(cu[k + 1] - cu[k]))
                parts[d, p].append(tuple(ids[cu[k] : cu[k + 1]].tolist()))
        assert token_output.packed_sequences(df.limit(0), queries.word_bpe()).count() == 0
        for (d, p), xs in parts.items():
            for x in xs:
                got[d, p, x] += 1
        want = collections.Counter((k, s // 2048, tuple(ids[s : s + 2048])) for k, ids in expected_ids(rows) for s in range(0, len(ids), 2048))
        assert got == want


def test_shards_are_matrices(spark, odd, tmp_path):
    token_output.write_shards(odd, queries.word_bpe(), str(tmp_path / "out"), 64, pad_id=9, end_id=5)
    whole = collections.Counter()
    for s in spark.read.parquet(str(tmp_path / "out")).collect():
        ids, pos = (np.frombuffer(s[c], k).reshape(s["rows"], 64) for c, k in (("ids", s["kind"]), ("positions", "<u2")))
        assert s["rows"] <= token_output.SHARD and len(s["sequences"]) == s["rows"]
        for row, q in enumerate(s["sequences"]):
            cu = q["cu_seqlens"]
            assert (ids[row, cu[-1] :] == 9).all() and not pos[row, cu[-1] :].any()
            assert all(pos[row, a:b].tolist() == list(range(b - a)) for a, b in zip(cu, cu[1:]))
            whole.update(zip(q["doc_ids"], q["pieces"], (tuple(ids[row, a:b].tolist()) for a, b in zip(cu, cu[1:]))))
    want = collections.Counter((k, p, tuple([*ids[:-1], 5][a : a + 64])) for k, ids in expected_ids([(r[0], r[1]) for r in ODD]) for p, a in enumerate(range(0, len(ids), 64)))
    assert whole == want


# ---- pages
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site of the day and the week and more</p></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies and the like for you and for us on this site, as it is.</div>
<article><h1>Big&amp;amp; Title</h1><p>The first of the&nbsp;paragraphs is <b>long</b> enough to be read by the reader, and it has the words that the language has in it.<br>Line two<p>Short.</p>
<form><input><p>Leave the reply in the box and be kind to the others on this page</p></form><div class="comments"><p>I am the reader and this is what I think of the article that is above</p></div></article>
<aside>Other things of the day that are on the side of the page for the reader</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Big&amp; Title\nThe first of the paragraphs is long enough to be read by the reader, and it has the words that the language has in it. Line two\nShort."
    assert html_extract.main_text(None) == "" and html_extract.main_text("<p") == "" and html_extract.main_text("<<<>>>&&") is not None


def test_short_blocks_inherit_without_an_article():
    good = "It is the kind of text that a reader of the page would want to see, as it has many of the words that are in the language, and it is long enough for the rules to be sure of it and to keep it here."
    page = f"<body><div><a href=x>One</a> <a href=y>Two links of a menu</a></div><p>{good}</p><p>And short it is.</p><p>{good}</p><ul><li><a href=z>more and more</a></li></ul></body>"
    assert html_extract.main_text(page).split("\n") == [good, "And short it is.", good]


def test_article_marks_are_a_prior_alone():
    good = "It is the kind of text that a reader of the page would want to see, as it has many of the words that are in the language, and it is long enough for the rules to be sure of it and to keep it here."
    teaser = "<article><p>A teaser of the day that is for the reader of this page and no more than that is.</p></article>"
    assert html_extract.main_text(f"<body>{teaser}<div>{good}</div><div>{good}</div><div>{good}</div></body>").split("\n")[-3:] == [good] * 3
    code = "for (int k = 0; k < n; k++) { total[k] += weight[k] * value[k]; count[k]++; queue.push(k); }"
    assert html_extract.main_text(f"<body><p>{good}</p><pre>{code}</pre><p>{good}</p></body>").split("\n") == [good, code, good]
    assert html_extract.main_text(f"<body><pre>{code}</pre></body>") == code
    shop = "Widget Gadget Gizmo 3000 Super Deluxe Edition Sale Price Discount Offer Shipping Free Returns Guarantee"
    assert html_extract.main_text(f"<body><p>{good}</p><div>{shop}</div><p>{good}</p></body>").split("\n") == [good, good]


def test_furniture_by_whole_names_and_shown_raw_text():
    good = "It is the kind of text that a reader of the page would want to see, as it has many of the words that are in the language, and it is long enough for the rules to be sure of it and to keep it here."
    for name in ("share-price", "related-work", "code-comment", "searching"):
        assert html_extract.main_text(f'<body><p>{good}</p><div class="{name}">{good}</div></body>').split("\n") == [good, good], name
    for name in ("ad", "comment-list", "site-footer", "share-buttons", "x cookie-notice", "main_nav"):
        assert html_extract.main_text(f'<body><p>{good}</p><div class="{name}">{good}</div></body>') == good, name
    page = f"<article><p>{good}</p><p>It is <math><mi>x</mi>+1</math> and <button>more</button> of it</p><xmp>a < b & c</xmp><p>{good}</p></article>"
    assert html_extract.main_text(page).split("\n") == [good, "It is x+1 and more of it", "a < b & c", good]
    deep = "<div>" * 3000 + f"<p>{good}" + "</i>" * 3000 + "</div>" * 3000
    assert html_extract.main_text(f"<nav>{deep}</nav><p>{good}</p>") == good and html_extract.main_text(deep) == good


def test_article_tags_do_not_decide(spark, sf):
    """With <article> renamed to <div> nearly all blocks keep their labels."""
    blocks = wrong = 0
    for r in queries.table(spark, sf, "pages").collect():
        marked, plain = (html_extract.main_text(h).split("\n") for h in (r["html"], re.sub(r"(</?)(?:article|main)\b", r"\1div", r["html"])))
        blocks += len(marked)
        wrong += sum(((collections.Counter(marked) - collections.Counter(plain)) + (collections.Counter(plain) - collections.Counter(marked))).values())
    assert wrong <= 0.02 * blocks


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>x"), (2, "u", "<p>same</p>"), (2, "u", "<p>same</p>"), (3, "u", "word " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    got = collections.Counter((r["page_id"], r["n_chars"]) for r in html_extract.extract(df).collect())
    assert got == collections.Counter([(1, 0), (1, 0), (None, 1), (2, 4), (2, 4), (3, 999_999)]) and html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("body", ["Это длинный абзац обычного русского текста, который читатель страницы хотел бы прочитать целиком и без пропусков.", "這是一個足夠長的段落,讀者希望完整地閱讀它,而不會遺漏任何內容,因為它是頁面的正文。", "Ten akapit jest wystarczająco długi, żeby czytelnik strony chciał przeczytać go w całości, bez żadnych braków."])
def test_languages_without_a_word_list(body):
    page = f"<body><nav><a href=a>One</a></nav><div>{body}</div><div><a href=x>{body}</a></div><div>{body}</div><footer>{body}</footer></body>"
    assert html_extract.main_text(page).split("\n") == [body, body]


def test_pages_of_the_fixture(spark, sf):
    pages = {r["page_id"]: r["html"] for r in queries.table(spark, sf, "pages").collect()}
    import html

    for r in queries.op4_block_rules(spark, sf).collect():
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = re.sub(r"</?[a-z][^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", body))).split("\0")
        assert r["text"] == "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x) and r["n_chars"] == len(r["text"])


# ---- WARC
def test_warc_round_trip(spark):
    rows = [(3, "u%20 x\r\ny", "é" * 80), (1, None, "é" * 80), (2, "u", "é" * 80), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", "é" * 80), (1, None, "é" * 80)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kind = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kind == collections.Counter([(1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (None, "response", None)])
    for r in got:
        payload = {4: b"small", 5: b"small", 6: b""}.get(r["page_id"], ("é" * 80).encode())
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha256(payload).hexdigest()
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    long = spark.createDataFrame([(1, "u", "payload of the page " * 500_000)], "page_id long, url string, html string").withColumns({"archive": F.lit("x"), "gap": F.lit(1), "digest": F.lit(2)})
    assert [(r["payload_bytes"], r["record_type"]) for r in warc.round_trip(long).collect()] == [(10_000_000, "response")]


def archive(pack):
    return b"".join(pack(warc.record(i, f"http://x/{i}?a b%41", f"payload {i} ".encode() * 20, None, False)) for i in range(6))


def gzip_member(raw):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@pytest.mark.parametrize("pack", [gzip_member, lambda raw: raw])
def test_salvage_after_damage(pack):
    whole = archive(pack)
    rows = list(warc.salvage(whole))
    assert [r["page_id"] for r in rows] == list(range(6)) and rows[2]["url"] == "http://x/2?a bA".replace("A", "%41")
    size = len(pack(warc.record(0, "http://x/0?a b%41", b"payload 0 " * 20, None, False)))
    broken = bytearray(whole)
    broken[size + size // 2] ^= 0xFF  # inside record 1
    rows = list(warc.salvage(bytes(broken)))
    assert [r["page_id"] for r in rows if not r["gap"]] == [0, 2, 3, 4, 5]
    gaps = [r for r in rows if r["gap"]]
    assert len(gaps) == 1 and gaps[0]["position"] == size and gaps[0]["position"] + gaps[0]["size"] == [r for r in rows if not r["gap"]][1]["position"]
    rows = list(warc.salvage(b"junk" + whole[: len(whole) - 30]))
    assert [r["page_id"] for r in rows if not r["gap"]] == [0, 1, 2, 3, 4] and len([r for r in rows if r["gap"]]) == 2
    assert list(warc.salvage(b"")) == []


def test_salvage_inside_members():
    one = [warc.record(i, f"http://x/{i}", random.Random(i).randbytes(300).hex().encode(), None, False) for i in range(6)]
    raw = b"".join(one)
    ids = lambda rows: [r["page_id"] for r in rows if not r["gap"]]
    gaps = lambda rows: [(r["position"], r.get("inner"), r.get("inner_size"), r["gap"]) for r in rows if r["gap"]]
    assert ids(warc.salvage(gzip_member(raw))) == list(range(6)) and not gaps(warc.salvage(gzip_member(raw)))
    for k in (0, 2, 5):  # a record damaged before it was packed
        bad = bytearray(raw)
        bad[sum(map(len, one[:k])) + len(one[k]) - 50] ^= 0xFF
        rows = list(warc.salvage(gzip_member(one[0]) + gzip_member(bytes(bad)) + gzip_member(one[5])))
        assert ids(rows) == [0, *(i for i in range(6) if i != k), 5]
        assert gaps(rows) == [(len(gzip_member(one[0])), sum(map(len, one[:k])), len(one[k]), "block digest")]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    plain = stored.compress(raw) + stored.flush()
    for packed in (gzip_member(raw), plain):
        for cut in (packed[: len(packed) * 3 // 4], packed[: len(packed) * 3 // 4] + gzip_member(one[5])):
            rows = list(warc.salvage(cut))
            assert ids(rows)[:4] == [0, 1, 2, 3] and len(gaps(rows)) == 1
            assert ids(rows)[4:] in ([], [4], [5], [4, 5]) and (5 in ids(rows)) == (cut[-20:] == gzip_member(one[5])[-20:])
        torn = packed[:-8] + bytes(8)  # only the check sum is wrong
        rows = list(warc.salvage(torn + gzip_member(one[3])))
        assert ids(rows) == [*range(6), 3] and [g[3] for g in gaps(rows)] == ["member"]


# ---- chat
def test_escape_is_reversible():
    for s in ("<|im_end|>", "<␛|x", "<␛␛|<|", "plain", "<", "|<|"):
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
    for role in ("user", "a\nb%0A", "<|im_end|>"):
        assert list(chat.parse(chat.segment(role, "x\ny")[0] + chat.segment("user", role)[0])) == [(role, "x\ny"), ("user", role)]


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>"), (1, 2, "user", None), (1, 3, "assistant", "bye"), (2, 0, "system", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1))
    got = {r["conv_id"]: r for r in chat.chat_digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == sha("user\nhi\nassistant\n<|im_end|>\nuser\n\nassistant\nbye\n")
    assert got[1]["loss_chars"] == 13 and got[1]["loss_sha256"] == sha("<|im_end|>bye") and got[2]["loss_chars"] == 0
    assert got[-1]["loss_sha256"] == sha("<|im_end|><|im_start|>assistant ok") and got[None]["n_turns"] == 1
    examples = [r for r in chat.expand(df).where("conv_id = 1").orderBy("place").collect() if r["target"]]
    assert sum(len(e["text"]) for e in examples) == got[1]["formatted_chars"] and [e["last"] for e in examples] == [False, True]
    spans = [chat.unescape(e["text"][e["loss_start"] : e["loss_start"] + e["loss_chars"]]) for e in examples]
    assert spans == ["<|im_end|>", "bye"] and examples[1]["text"].startswith(examples[0]["text"])


def brute_chat(rows):
    """Digests of conversations from plain lists: (conv, turn, role, text)."""
    form = lambda role, t: f"<|im_start|>{chat.escape(role)}\n{chat.escape(t)}<|im_end|>\n"
    groups = collections.defaultdict(list)
    for conv, turn, role, t in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", t or ""))
    out = {}
    for conv, turns in groups.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = sum(sum(len(form(*x)) for x in turns[: i + 1]) for i, (r, _) in enumerate(turns) if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), chars)
    return out


def test_chat_digests_against_brute_force(spark, sf, monkeypatch):
    table = queries.table(spark, sf, "conversations")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    # repeated rows, ties of turn, nulls, a long conversation, one without an assistant, a conversation -1
    rows += [(9001, 1, "user", "twice"), (9001, 1, "user", "twice"), (9001, 1, "assistant", "a tie"), (9001, None, "assistant", "first"), (9002, 0, "user", "nobody answers"), (None, 0, "assistant", "no id"), (-1, 0, "assistant", "own")]
    rows += [(9003, i, "assistant" if i % 2 else "user", f"word {i} <|im_start|> " * 40) for i in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(7)).withColumn("last", F.lit("x"))
    text_ = "<|im_end|><|im_start|>assistant ok"
    for size in (chat.BATCH_CHARS, 5000):
        monkeypatch.setattr(chat, "BATCH_CHARS", size)
        got = collections.Counter(tuple(r) for r in chat.chat_digests(df).collect())
        want = collections.Counter((k, *v) for k, v in brute_chat(rows).items())
        want.update((k, *v) for k, v in brute_chat([(-1, 0, "user", text_), (-1, 1, "assistant", text_)]).items())
        assert got == want
    assert [r["conv_id"] for r in chat.chat_digests(df.limit(0)).collect()] == [-1]


# ---- licenses
def test_license_alignment(spark, odd):
    full = licenses.TEMPLATES["MIT"]
    words = full.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 12)
    rows = [(1, f"Prose before. {full} Prose after."), (2, edited), (3, "Released under the MIT license and the like"), (4, "software permission free copy"), (5, None)]
    got = {(r["doc_id"], r["license"]): r["coverage"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "MIT"] == 1.0 and 0.85 < got[2, "MIT"] < 1 and got[3, "MIT-notice"] == 1.0
    assert {k[0] for k in got} == {1, 2, 3}
    assert licenses.scan(odd).count() == 0


def test_licenses_come_out_under_their_own_names():
    found = lambda t: {r[1] for r in licenses.Scanner(licenses.TEMPLATES, licenses.MIN_COVERAGE).find([t])}
    notices = {
        "Released under the BSD License": "BSD-notice",
        "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0-notice",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-notice",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1-notice",
        "Licensed under CC BY-NC-SA 3.0": "CC-BY-NC-SA-3.0-notice",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0-notice",
        "Licensed under the Mozilla Public License, Version 2.0.": "MPL-2.0-notice",
        "SPDX-License-Identifier: MIT": "MIT-tag",
    }
    for notice, name in notices.items():
        assert found(f"Prose before. {notice} and prose after.") == {name}, notice
    assert found("Released under the Foo License. Licensed under CC BY-XX 4.0.") == set()
    assert found("Licensed under CC BY-NC 4.0. Licensed under CC BY-SA 4.0.") == {"CC-BY-NC-4.0-notice", "CC-BY-SA-4.0-notice"}
    whole = "Apache-2.0 CC0-1.0 CC-BY-SA-4.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 MPL-2.0 MIT ISC 0BSD BSD-2-Clause BSD-3-Clause BSD-4-Clause Unlicense"
    for name in whole.split():
        words = licenses.TEMPLATES[name].split()
        assert found("Prose before. " + " ".join(words) + " Prose after.") == {name}, name
    twice = licenses.TEMPLATES["GPL-3.0"] + " And more prose. " * 50 + licenses.TEMPLATES["GPL-3.0-header or-later"]
    assert found(twice) == {"GPL-3.0", "GPL-3.0-header"}


def test_alignment_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randrange(30) for _ in range(rng.randrange(40))]
        b = [rng.randrange(30) for _ in range(rng.randrange(25))]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert licenses.align(list(range(20)), list(range(20))) == [(i, i) for i in range(20)]


# ---- toxicity
def test_maximal_segments_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 40)
        hits = sorted((p, rng.choice([0.15, 0.5, 1.0])) for p in rng.sample(range(n), rng.randrange(0, n)))
        scores = [-0.1] * n
        for p, s in hits:
            scores[p] = s

        def best(lo, hi):
            """All maximal scoring segments by their definition: the best, then both sides."""
            top = max(((sum(scores[a:b]), -(b - a), -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,), key=lambda t: (round(t[0], 9), t[1], t[2]))
            if top[0] <= 1e-9:
                return []
            a, b = -top[2], top[3]
            return best(lo, a) + [(a, b)] + best(b, hi)

        steps = [(p, p + 1, sum(scores[:p]), sum(scores[: p + 1])) for p, _ in hits]
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(steps)]
        assert round(sum(sum(scores[a:b]) for a, b in got), 6) == round(sum(sum(scores[a:b]) for a, b in best(0, n)), 6)


def test_scan_of_texts_is_that_of_their_tokens():
    """Every token has its log-odds: gains, losses, none; the k-th repeat gains 1/k."""
    rng = random.Random(8)
    names = [f"w{i}" for i in range(30)]
    _, _, _, h, _ = text.words([" ".join(names)])
    order = np.argsort(h)
    odds = {n: rng.choice([-1.0, -0.05, 0.05, 0.5, 2.0]) for n in names}
    model = toxicity.Model(h[order], np.array([odds[names[i]] for i in order]))
    texts = [" ".join(rng.choice([*names, "other"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    for t, (n, segs) in zip(texts, model.segments(texts)):
        seen, total, steps = collections.Counter(), 0.0, []
        for i, w in enumerate(t.split()):
            seen[w] += 1
            s = odds.get(w, 0.0)
            s = (s / seen[w] if s > 0 else s) - toxicity.DRIFT
            if s > 0:
                steps.append((i, i + 1, total, total + s))
            total += s
        want = toxicity.maximal_segments(steps)
        assert n == len(t.split()) and [(a, b) for a, b, _ in segs] == [(a, b) for a, b, _ in want]
        assert [x for *_, x in segs] == pytest.approx([x for *_, x in want])


def test_toxicity_on_held_out_documents(spark):
    big = "/root/testdata/sf0.01"
    got = toxicity.toxicity(queries.table(spark, big, "documents"), queries.table(spark, big, "labels"))
    rows = got.join(queries.table(spark, big, "labels"), "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    accuracy = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    assert accuracy >= 0.9 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(2, 1, 0), (5, 1, 1), (7, None, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(odd, labels.limit(0)).count() == len(ODD)
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0
    held = {r["doc_id"]: r["held_out"] for r in rows if r["doc_id"] is not None}
    assert all(v == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in held.items())


# ---- pipeline
def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][2] == "MinHash near-dedup" and len(corpus_pipeline.STAGES) == 5
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, current, sf)
        assert new.columns == docs.columns, name
        ids = {r["doc_id"] for r in new.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in current.select("doc_id").collect()}
        current = spark.createDataFrame(new.collect(), docs.schema)
    rows = [(r["doc_id"], r["text"]) for r in current.collect()]
    packed = corpus_pipeline.run(spark, sf).collect()
    check_packing(packed, rows)
