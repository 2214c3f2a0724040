"""Pages, archives and licenses as they come from elsewhere: broken markup, foreign digests, insertions."""

import base64
import collections
import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from wattloom.llm import html_extract, licenses, warc

BODY = "This is the text of an article that goes on for a while, with the words that are used in it and more of the same for all to see."


# ---- markup
@pytest.mark.parametrize("page", [
    f"<p title=it's>{BODY}</p>", f'<p class="x>{BODY}</p>', f"<p class='x>{BODY}</p>", f'<p title="a > b">{BODY}</p>', f"<P\nTITLE = 'x'\n>{BODY}", f"<p a=1 a='<b>' \"\" =x>{BODY}</p>",
    f"<script src=https://x/lib/>code of it</script><p>{BODY}</p>", f"<title>{BODY}</title><p>{BODY}</p>", f"<!-- <p>{BODY}</p> --><p>{BODY}</p>", f"<!--><p>{BODY}</p>", f"<!doctype html><?x y?></ x><p>{BODY}</p>",
    f"<select><option>one<option>two<p>{BODY}</p>", f"<div><svg><title>{BODY}</title><text>{BODY}</text></svg><p>{BODY}</p></div>", f"<template><p>{BODY}</p></template><p>{BODY}</p>", f"<noscript>{BODY}</noscript><p>{BODY}</p>",
    f"<p>{BODY}<script>var a = '<p>{BODY}</p>';", f"<p>{BODY}</p><a href='cut", f"<style>p {{}}</style ><p>{BODY}</p>",
])
def test_broken_markup(page):
    assert html_extract.main_text(page) == BODY


def test_nothing_is_swallowed_by_an_unclosed_element():
    for tag in ("select", "svg", "object", "template", "noscript", "textarea", "iframe", "title"):
        assert html_extract.main_text(f"<div><p>{BODY}</p><{tag}><p>{BODY} 2</p></div><p>{BODY} 3</p>").split("\n")[-1] == f"{BODY} 3", tag
    assert html_extract.main_text(f"a < b and 1<2 <p>{BODY}").endswith(BODY)


def test_links_with_a_slash_at_their_end_are_links():
    items = "".join(f"<li><a href=http://x/{i}/>Some headline of another story with the words that are in it and so on {i}</a>" for i in range(9))
    assert html_extract.main_text(f"<ul>{items}</ul><p>{BODY}</p>") == BODY


@pytest.mark.parametrize("name", ["user-reviews-comments", "post-comments-v2", "fb-comments", "commentlist", "adsbygoogle", "widget_recent_entries", "commentBodyText", "ad", "cookieNotice"])
def test_furniture_by_its_most_telling_part(name):
    article = f"<article><h1>A title</h1><p>{BODY}</p><p>{BODY} 2</p></article>"
    plain = article.replace("article>", "div>")
    for page in (article, plain):
        got = html_extract.main_text(f"<body>{page}<div class='{name}'><p>I am of the view that {BODY}</p></div></body>")
        assert got.split("\n")[-2:] == [BODY, f"{BODY} 2"]


@pytest.mark.parametrize("name", ["layout-sidebar-left", "has-comments", "code-comment", "no-sidebar", "page-with-sidebar"])
def test_wrappers_are_no_furniture(name):
    assert html_extract.main_text(f"<div class='{name}'><article><p>{BODY}</p><p>{BODY} 2</p></article></div><div class='ad'>{BODY}</div>") == f"{BODY}\n{BODY} 2"


def test_remarks_longer_than_the_article():
    remarks = "".join(f"<article class='comment-body'><p>I am of the view that {BODY} {i}</p></article>" for i in range(5))
    assert html_extract.main_text(f"<main><p>{BODY}</p></main><div class='post-comments-v2'>{remarks}</div>") == BODY


@pytest.mark.parametrize("part", ["<a ", "<p class='x>", "<script", "<b>", "<div><b>", "</b>", "<!--", "<select>", "<![", '<a href="', "<script><style>", "&#", "<p><b>", "<object>", "<li><ul>"])
def test_time_grows_with_the_page(part):
    took = []
    for n in (8_000, 64_000):
        start = time.process_time()
        html_extract.main_text(part * n)
        took.append(time.process_time() - start)
    assert took[1] < 24 * max(took[0], 0.05)


def brute_pages():
    """Pages from parts whose fate is known: text and furniture in random order."""
    rng = random.Random(11)
    for _ in range(60):
        want, html = [], []
        for k in range(rng.randint(2, 6)):
            text = f"{k} {BODY}"
            want.append(text)
            html.append(rng.choice(["<p>{}</p>", "<div><p>{}</div>", "<p id=x{}", "<section><p><b>{}</b></section>"]).replace("x{}", f"x{k}>{{}}").format(text))
            html.append(rng.choice(["", "<nav>{}</nav>", "<div class='ad'>{}</div>", "<!-- {} -->", "<script>{}</script>", "<ul class=share><li>{}</ul>", "<form><p>{}</form>", "<div class='post-comments-2'>{}</div>", "<p hidden>{}</p>"]).format(f"not {BODY}"))
        yield "".join(html), "\n".join(want)


def test_pages_of_known_parts(spark):
    pages = list(brute_pages())
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(pages)}


# ---- archives of other crawlers
def foreign(kind, payload, digest, **more):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" if kind == "response" else b""
    block = http + payload
    fields = {"WARC-Type": kind, "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(payload), "Content-Type": "application/http; msgtype=response" if http else "application/warc-fields", **more}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v != "")
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


DIGESTS = {
    "base32": lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode(),
    "hex": lambda b: "sha1:" + hashlib.sha1(b).hexdigest().upper(),
    "base64": lambda b: "sha-256:" + base64.b64encode(hashlib.sha256(b).digest()).decode(),
    "unknown": lambda b: "blake9:abc",
    "none": lambda b: "",
}


@pytest.mark.parametrize("form", DIGESTS)
@pytest.mark.parametrize("pack", ["gzip", "plain"])
def test_digests_of_other_crawlers(form, pack):
    digest = DIGESTS[form]
    records = [foreign("warcinfo", b"software: x\r\n\r\nmore", digest), *(foreign("response", b"<p>page %d\r\n\r\n second part" % i, digest, **{"X-Page-ID": i}) for i in range(4))]
    z = lambda raw: (lambda c: c.compress(raw) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    whole = b"".join(map(z, records)) if pack == "gzip" else b"".join(records)
    rows = list(warc.salvage(whole))
    assert [r["gap"] for r in rows] == [None] * 5 and [r["page_id"] for r in rows] == [None, 0, 1, 2, 3]
    assert [r["payload_digest"] for r in rows[1:]] == [hashlib.sha256(b"<p>page %d\r\n\r\n second part" % i).hexdigest() for i in range(4)]
    if pack == "plain" and form not in ("unknown", "none"):
        at = len(records[0]) + len(records[1]) + len(records[2]) - 8
        rows = list(warc.salvage(whole[:at] + b"#" + whole[at + 1 :]))
        assert [r["page_id"] for r in rows if not r["gap"]] == [None, 0, 2, 3] and [r["gap"] for r in rows if r["gap"]] == ["block digest"]


def test_chunked_answers_and_long_payloads():
    digest = DIGESTS["base32"]
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    raw = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nWARC-Block-Digest: {digest(block)}\r\nWARC-Payload-Digest: {digest(b'hello')}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    long = foreign("response", b"payload " * 2_000_000, digest, **{"X-Page-ID": 7})
    rows = list(warc.salvage(raw + long))
    assert [(r["gap"], r["page_id"], r["payload_bytes"]) for r in rows] == [(None, None, 15), (None, 7, 16_000_000)]


def test_time_grows_with_the_archive():
    for part in (b"WARC/1.0\r\nx", b"WARC/1.0\r\n\r\n", b"\x1f\x8b\x08", b"WARC/1.0\r\nContent-Length: 9\r\n\r\n", b"\x1f\x8b\x08WARC/1.0\r\n"):
        took = []
        for n in (4_000, 32_000):
            start = time.process_time()
            rows = list(warc.salvage(part * n))
            took.append(time.process_time() - start)
        assert took[1] < 24 * max(took[0], 0.05), part
        assert all(r["gap"] for r in rows if "page_id" not in r)


def test_archives_with_clashing_columns(spark):
    rows = [("a", foreign("response", b"x", DIGESTS["base32"], **{"X-Page-ID": 3})), ("b", None), ("c", b"")]
    df = spark.createDataFrame(rows, "archive string, content binary").withColumns({n: F.lit(1) for n in ("gap", "payload", "position", "inner")})
    assert [(r["archive"], r["page_id"], r["gap"]) for r in warc.read_archives(df).collect()] == [("a", 3, None)]


# ---- licenses
@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES, 0.8)


def names(scanner, text):
    return collections.Counter(r[1] for r in scanner.find([text]))


FILLER = " ".join(["the system of words that is in a text for all"] * 310)


def test_insertions_of_any_length(scanner):
    for name, n in (("MIT", 400), ("MIT", 3000), ("GPL-2.0", 3018), ("BSD-3-Clause", 1000)):
        words = licenses.TEMPLATES[name].split()
        at = len(words) // 2
        got = scanner.find([" ".join(words[:at] + FILLER.split()[:n] + words[at:])])
        assert (name, 1.0) in {(r[1], r[2]) for r in got}, (name, got)


def test_two_copies_are_one_license(scanner):
    mit = licenses.TEMPLATES["MIT"]
    for text in (f"{mit}\n{mit}", f"{mit} and then {mit}", f"{mit} {FILLER} {mit}", f"{mit} {mit} {mit}"):
        assert names(scanner, text) == {"MIT": 1}
    assert names(scanner, f"{mit} {FILLER} {licenses.TEMPLATES['MIT-0']} {mit}") == {"MIT": 1, "MIT-0": 1}
    assert names(scanner, f"{licenses.TEMPLATES['GPL-2.0']}\n{mit}") == {"GPL-2.0": 1, "MIT": 1}


def test_spdx_expressions(scanner):
    for line, want in {
        "SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0-or-later"], "SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "Apache-2.0"], "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause */": ["GPL-2.0-only", "BSD-3-Clause"],
        "SPDX-License-Identifier: mit": ["MIT"], "SPDX-License-Identifier: LicenseRef-own": [], "SPDX-License-Identifier: GPL-2.0.\nMIT": ["GPL-2.0"],
    }.items():
        assert names(scanner, line) == {f"{w}-tag": 1 for w in want}, line


def plain_coverage(text, template):
    """Longest common subsequence: no alignment matches more."""
    a, b = text.lower().split(), template.lower().split()
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / len(b)


def test_scan_equals_brute_force_on_edited_texts(spark):
    rng = random.Random(4)
    own = {f"L{k}": " ".join(f"{c}{k}" for c in rng.sample("abcdefghijklmnopqrstuvwxyz", 24)) for k in range(3)}
    docs, want = [], set()
    for i in range(80):
        k = rng.choice(list(own))
        words = own[k].split()
        for _ in range(rng.randint(0, 9)):
            j = rng.randrange(len(words) + 1)
            words[j : j + rng.randint(0, 1)] = [f"other{rng.randrange(9)}"] * rng.randint(0, 40)
        text = " ".join([*(f"other{rng.randrange(9)}" for _ in range(30)), *words, *(f"other{rng.randrange(9)}" for _ in range(30))])
        docs.append((i, text))
        want |= {(i, n, round(plain_coverage(text, t), 6)) for n, t in own.items() if plain_coverage(text, t) >= 0.8}
    docs += [docs[0], docs[0], (None, docs[0][1]), (900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("license", F.lit(1))
    got = collections.Counter((r["doc_id"], r["license"], r["coverage"]) for r in licenses.scan(df, own).collect())
    assert {g for g in got if g[0] is not None} == want and (not any(w[0] == 0 for w in want) or [n for g, n in got.items() if g[0] == 0] == [3])
