"""HTML extraction, tokenizer alignment and spelling variants against plain brute-force versions, on the smallest tables and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import html
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from recollect.llm import alignment, html_main, queries, spelling
from recollect.llm.common import load
from recollect.llm.queries import tokenizer_path

FILES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")

# minimum cut


def test_min_cut_is_least_by_enumeration():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randrange(1, 9)
        gains = [rng.randrange(-6, 7) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(5)) for _ in range(rng.randrange(14))]

        def cost(s):
            return sum(max(g, 0) if not yes else max(-g, 0) for g, yes in zip(gains, s)) + sum(w for i, j, w in edges if s[i] != s[j])

        best = min(itertools.product([False, True], repeat=n), key=lambda s: (cost(s), sum(s)))
        assert tuple(html_main.min_cut(gains, edges)) == best


def test_long_weak_chain_is_cut_in_time():
    rng = np.random.default_rng(1)
    gains = rng.integers(-900, 900, 40_000).tolist()
    began = time.time()
    side = html_main.min_cut(gains, [(i, i + 1, 1000) for i in range(len(gains) - 1)])
    assert len(side) == len(gains) and time.time() - began < 60


# HTML


def article(source):
    """The blocks of the tables' own pages: what stands in their one article."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return " ".join(b for b in blocks if b)


def test_extraction_of_the_table(spark, sf):
    pages = load(spark, sf, "pages")
    rows = {r.page_id: r for r in html_main.extract(pages, html_main.fit(pages)).collect()}
    assert len(rows) == pages.count()
    for r in pages.collect():
        assert rows[r.page_id].text == article(r.html) and rows[r.page_id].n_chars == len(rows[r.page_id].text) and rows[r.page_id].url == r.url


STORY = ["A title of some news", "First paragraph of the story, with a link in it and some words. More words come here.", "Short one.", "Second long paragraph that tells the rest of the story, as it should be told, in many words.", "Tom & Jerry said so."]
PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{{}}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header class="site-header"><a href="/">Logo</a><p>Site slogan here.</p></header><ul class="nav-menu"><li><a href="/a">Home page</a><li><a href="/b">News</a></ul>
<div id="cookieNotice"><p>We use cookies to improve your experience, please accept them all.</p><button>OK</button></div><!-- <p>no</p> -->
{open}<h1>A title of some news</h1><p>First paragraph of the story, with a <a href="x>y">link</a> in\n it   and some&nbsp;words. More <b>wor</b>ds come here.<p>Short one.
<div class="advert">Buy now! The best shoes, only today, for you.</div><p>Second long paragraph that tells the rest of the story, as it should be told, in many words.</p><p>Tom &amp; Jerry<br>said so.</p>{close}
<aside><h3>Related</h3><p>Other story that you may like, written by others, for readers.</p></aside><noscript>no</noscript>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I really liked this story, thanks for writing it, it was very good. It helped me.</p></div></section>
<form action="/s"><label>Your name, please, and your address.</label><input name=q><select><option>no</select></form><footer>&copy; 2020 All rights reserved, all of them.</footer></body></html>"""


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<section id="main"><div>', "</div></section>")])
def test_pages_of_other_makes(spark, sf, tags):
    weights = html_main.fit(load(spark, sf, "pages"))
    assert html_main.main_text(PAGE.format(open=tags[0], close=tags[1]), weights) == " ".join(STORY)
    framed = PAGE.format(open=tags[0], close=tags[1]).replace("<body>", '<body><form id="aspnetForm">').replace("</body>", "</form></body>")
    assert STORY[3] in html_main.main_text(framed, weights)  # a form around the whole page says nothing


def test_odd_pages(spark):
    prior = np.array([*html_main.FEATURES.values()])
    rows = [(1, None), (2, ""), (3, "plain text, without any tag. It is a sentence of some words, is it not?"), (4, "<p"), (5, "<article><p>cut of"), (6, "<nav>only a menu</nav>"), (7, "<article>&lt;p&gt; &amp;amp; &#x41;&nbsp; x</article>"), (7, "<article>&lt;p&gt; &amp;amp; &#x41;&nbsp; x</article>"), (None, "<script>never ended <p>"), (8, '<article><p class="a>b">one, two.</p></article>'), (9, "</div></p><article><p>é 漢 😀 \0</article>")]
    df = spark.createDataFrame([(i, "u", h, "clash", 5) for i, h in rows], "page_id long, url string, html string, text string, n_chars long")
    got = collections.Counter((r.page_id, r.text) for r in html_main.extract(df, prior).collect())
    want = ["", "", rows[2][1], "", "cut of", "", "<p> &amp; A x", "<p> &amp; A x", "", "one, two.", "é 漢 😀 \0"]
    assert got == collections.Counter((i, w) for (i, _), w in zip(rows, want, strict=True))
    assert (html_main.fit(df.limit(0)) == prior).all() and html_main.extract(df.limit(0), prior).count() == 0


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "x" + "</p>" * 100_000 + "<p>a</div>" * 30_000, "<p>ab</p><div><a>c</a></div>" * 20_000, "<a b=\"c <a b='" * 50_000, "<!-- <script " * 50_000, "<p>" + "x <b>y</b> " * 200_000, "<table><p>" * 20_000 + "<li>" * 20_000])
def test_hostile_pages_end_soon(source):
    began = time.time()
    html_main.main_text(source, np.array([*html_main.FEATURES.values()]))
    assert time.time() - began < 30


# alignment


def plain_alignment(text, tools, tables):
    """n_a, n_b, n_groups, links as a counter, the groups written out; None without tokens."""
    if not text:
        return None
    a, b = tools[0].encode(" " + text, add_special_tokens=False).ids, tools[1].encode(text)
    parts = [[t[i] for i in x] for t, x in zip(tables, (a, b), strict=True)]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    ends = [list(itertools.accumulate(map(len, p))) for p in parts]
    out, i, j = [], 0, 0
    for cut in sorted({*ends[0]} & {*ends[1]}):
        x, y = i, j
        while i < len(a) and ends[0][i] <= cut:
            i += 1
        while j < len(b) and ends[1][j] <= cut:
            j += 1
        out.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
    links = collections.Counter()
    low = 0
    for k, (e, p) in enumerate(zip(ends[0], parts[0], strict=True)):
        while ends[1][low] <= e - len(p):
            low += 1
        m = low
        while m < len(b) and ends[1][m] - len(parts[1][m]) < e:
            links[a[k], b[m]] += 1
            m += 1
    return len(a), len(b), len(out), links, ";".join(out)


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(FILES[0])
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def odd_texts():
    rng = random.Random(1)
    signs = "ab '\n\t .,é 　漢😀▁1_s\r\x85 "
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(600)]
    return [None, "", " ", "  ", "a", " a  b\n c", "\n x", "a▁b c", "<|endoftext|> x", "<s> </s> <0x41> <unk>", "x" * 3000, "\x00 a\x00", "\x1c a", "don't we'll 's", ".  .  ..", "“q” r", "a", "a ", *made]


@pytest.mark.parametrize("head", [0, 3, 1 << 17])
def test_alignment(spark, sf, tools, head):
    df = load(spark, sf, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + i // 2, t) for i, t in enumerate(odd_texts())] + [(None, "a b")], "doc_id long, text string")
    df = df.unionByName(extra).selectExpr("doc_id", "text", "1 AS pair", "2 AS row", "3 AS n", "'x' AS groups_sha256")
    own = alignment.aligner(*FILES)
    want, counts = [], collections.Counter()
    for r in df.collect():
        want.append((r.doc_id, plain_alignment(r.text, tools, (own.a.bytes, own.b.bytes))))
        counts.update([*want[-1][1][3]] if want[-1][1] else [])
    top = collections.Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    rows = collections.Counter()
    for i, x in want:
        if x is None:
            rows[i, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            links = x[3]
            rows[i, *x[:3], sum(links.values()), sum(k for p, k in links.items() if counts[p] == top[p[0]]), sum(k * counts[p] for p, k in links.items()), hashlib.sha256(x[4].encode()).hexdigest()] += 1
    got = alignment.align_tokenizers(df, *FILES, head=head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == rows
    assert alignment.align_tokenizers(df.limit(0), *FILES).count() == 0


def test_alignment_of_a_long_text():
    text = " ".join(f"w{i % 7919}é" for i in range(700_000)) + "y" * 200_000
    out = [c.to_pylist()[0] for c in alignment.aligner(*FILES).texts(pa.array([text]))]
    assert out[2] > 700_000 and out[3] == out[0] + out[1] - out[2] == sum(out[6])


# spelling


def plain_variants(rows):
    counts = collections.Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            counts[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r] += 1
    n = {w: k for w, k in counts.items() if k >= 3 and len(w) >= 5}
    near, cut = collections.defaultdict(set), collections.defaultdict(list)
    for w in n:
        for k in range(len(w)):
            d = w[:k] + w[k + 1 :]
            cut[k, d].append(w)
            if d in n:
                near[w].add(d)
                near[d].add(w)
    for same in cut.values():
        for w in same:
            near[w] |= {x for x in same if x != w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_spelling_variants(spark, sf):
    long = "z" * 30 + "abcdefghij" * 400
    made = [(1, None), (2, ""), (3, "grape grape grape " * 9 + "grapes grapes grapes crape crape crape crapes CRAPES Crapes"), (3, "äpfel×äpfel÷äpfel äpfeln äpfeln äpfeln"), (None, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aabaa aabaa aabaa")]
    made += [(k, f"{long} {long}x {long[:2000]}{long[2001:]} " + "chaina " * 2**k + "chain " + "chainab " * 2 ** (k + 2)) for k in range(4, 8)]
    docs = load(spark, sf, "documents").select("doc_id", "text")
    for df in (docs, spark.createDataFrame([(i, t, "x", 1, 2) for i, t in made], "doc_id long, text string, word string, n int, id int")):
        want = plain_variants([(r.doc_id, r.text) for r in df.collect()])
        out = spelling.group_variants(df)
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and {*got} == want
    assert spelling.group_variants(docs.limit(0)).count() == 0


def test_spelling_broadcasts_nothing(spark, sf, monkeypatch):
    plans = []
    for name in ("materialize", "stage_table"):
        monkeypatch.setattr(spelling, name, lambda df, real=getattr(spelling, name): (plans.append(df), real(df))[1])
    plans.append(queries.op13_spelling_variants(spark, sf))
    assert len(plans) > 4 and not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in plans)


def test_spelling_sql(spark, sf):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = con.execute(queries.oracle_sql()["op13_spelling_variants"]).fetchall()
    assert {tuple(r) for r in queries.op13_spelling_variants(spark, sf).collect()} == {*want}


def test_posts_meet_exactly_for_near_words():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    number, key = spelling.posts(words)
    held = [{int(k) for k in key[number == i]} for i in range(len(words))]
    for i, j in itertools.combinations(range(len(words)), 2):
        own = [{w} | {w[:k] + w[k + 1 :] for k in range(len(w))} for w in (words[i], words[j])]
        assert bool(held[i] & held[j]) == bool(own[0] & own[1])
        assert len(held[i]) == len(own[0])


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(i, i + 1 if i % 40 != 39 else None) for i in range(400)], "id long, form long")
    assert {tuple(r) for r in spelling.roots(forms).select("id", "root").collect()} == {(i, i - i % 40 + 39) for i in range(400)}
