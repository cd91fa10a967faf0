"""Chat formatting, HTML extraction, quality, token shards, language model and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as vocab
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataspan.llm import chat, decontam, html_text, line_dedup, ngram_join, quality, queries, repair_ids

WORDS = vocab.path("word_bpe_49k.json")


def test_chat_query(same):
    same(queries.QUERIES["op7_chat_format"], queries.ORACLES["op7_chat_format"])


def test_snapshots_collapse(spark):
    says = lambda c, *turns: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns)]
    rows = says(1, "a") + says(2, "a", "b") + says(3, "a", "b", "c") + says(4, "a", "x") + says(5, "a", "x") + says(6, "b") + says(None, "a", "b", "c", "d")
    rows += [(7, None, None, None), (8, 0, "user", "r"), (8, 0, "user", "r"), (9, 0, "user", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_i", F.lit(5))
    out = {r.conv_id: r for r in chat.chat_format(df).collect()}
    assert sorted(out) == [3, 4, 6, 7, 8] and (out[4].n_copies, out[3].n_turns) == (2, 3)
    assert out[3].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert chat.chat_format(df.where("false")).count() == 0
    plan = chat.chat_format(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><article>";</script></head><body class="home">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad-box">Buy &amp; sell now</div><div class="cookie-notice">We use cookies on this site, do you agree to that</div>
<article><header><h1>Title &amp; more</h1></header><p><b>First  para<br>goes&nbsp;on<p>Second &lt;para&gt; &#233;<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><form><p>Sign up</p></form>
<aside>Aside</aside><div class="share-buttons"><a href="#">Share</a></div></article><section id="comments"><div class="comment">Nice article, I liked it very much indeed, all of it!</div></section>
<div class="sidebar">Other things to read in a sidebar of this site</div><footer>&copy; 2020 The site and its owners, with a long line of text</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "Title & more\nFirst para goes on\nSecond <para> é\none\ntwo\nc1\nc2"
    for nothing in (None, "", "<html></html>", "<script>x</script>", "<nav>a</nav>", "<!-- only -->", "<"):
        assert html_text.main_text(nothing) in ("", "<")
    assert html_text.main_text("just text") == "just text"
    body = "<p>" + "A sentence of the text that counts. " * 6 + "</p>"
    bare = f"<body><div><a href=1>l1</a><a href=2>l2</a><a href=3>l3</a></div><div>{body * 4}</div><div><a>x</a> <a>y</a></div>"
    assert html_text.main_text(bare) == "\n".join([("A sentence of the text that counts. " * 6).strip()] * 4)
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert html_text.main_text(deep) == "deep"


def test_html_keeps_what_is_the_article():
    text = "A sentence of the text that counts. " * 6
    p, links = f"<p>{text}</p>", "<p><a href=1>First source</a> <a href=2>Second source</a></p>"
    said = text.strip()
    parts = f'<h2 id="Legal_status">Legal</h2>{p}<section id="discussion"><h3 class="toc">Discussion</h3>{p}</section><section id="related-work">{p}</section><p class="search alert">{text}</p><div title="the hidden part">{p}</div>'
    want = ["Legal", said, "Discussion", said, said, said, said]
    assert html_text.main_text(f"<article>{parts}</article>") == "\n".join(want)
    nav = "<div><a href=1>l1</a><a href=2>l2</a></div>"
    assert html_text.main_text(f"{nav}<div>{p * 3}{links}{p}</div>{nav}") == "\n".join([said] * 3 + ["First source Second source", said])
    assert html_text.main_text(f"{nav}<div>{p * 4}<article><p>A card</p></article></div>") == "\n".join([said] * 4 + ["A card"])
    assert html_text.main_text(f"<article>{p}<svg viewBox='0 0 1 1'/>{p}<svg><text>no</text></svg>{p}<math/>{p}</article>") == "\n".join([said] * 4)
    assert html_text.main_text(f'<div class="widget">{p * 2}</div>') == "\n".join([said] * 2)
    assert html_text.main_text(f'<div>{p * 2}</div><div id="comments">{p * 4}</div>') == "\n".join([said] * 2)


SENTENCE = "A sentence of the text that counts. " * 6
PARAGRAPH, SAID = f"<p>{SENTENCE}</p>", SENTENCE.strip()


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="layout with-sidebar"><article>{PARAGRAPH * 3}</article><div class="sidebar">{PARAGRAPH}</div></div>', [SAID] * 3),
        (f'<div id=page class="no-sidebar">{PARAGRAPH * 3}</div>', [SAID] * 3),
        (f'<article>{PARAGRAPH}<p title="a hidden gem">{SENTENCE}</p></article>', [SAID] * 2),
        (f'<main>{PARAGRAPH * 3}<article class="comment">{PARAGRAPH}</article><article class="comment-body">{PARAGRAPH}</article><section id=responses>{PARAGRAPH * 2}</section></main>', [SAID] * 3),
        (f"<div><a href=1>l1</a><a href=2>l2</a></div><div>{PARAGRAPH * 3}<ul><li><a href=1>First source</a><li><a href=2>Second source</a></ul></div>", [SAID] * 3 + ["First source", "Second source"]),
        (f"<form action=x><div><a href=1>l1</a><a href=2>l2</a></div><div>{PARAGRAPH * 3}</div><input name=q></form>", [SAID] * 3),
        (f"<article>{PARAGRAPH}<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so.</p></article>", [SAID, "Let x=1 be so."]),
        (f"<article>{PARAGRAPH * 2}<form><p>Sign up for it</p><input></form></article>", [SAID] * 2),
        (f'<div class="comments">{PARAGRAPH * 3}</div>', [SAID] * 3),
    ],
)
def test_html_whole_names_and_wrappers(page, want):
    assert html_text.main_text(page).split("\n") == want


def test_html_by_density_alone():
    """The core is chosen by density sums; neighbours below the threshold of the body path stay out, whatever they are called."""
    short = "".join(f"<div><span>Tag {i}</span><span>Go</span></div>" for i in range(12))
    page = f"<div><div>{short}</div><div><h1>The title</h1><div>{PARAGRAPH * 5}</div></div><div>{short}</div></div>"
    assert html_text.main_text(page).split("\n") == ["The title"] + [SAID] * 5
    root = html_text.parse(page)
    top, core, threshold = html_text._chosen(root)
    outside = [k for k in root.kids[0].kids if not html_text._inside_node(core, k)]
    assert len(outside) == 2 and all(0 < k.density < threshold for k in outside)
    assert core.total == sum(k.density for k in core.kids)


def test_html_table(spark, sf):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    out = html_text.extract(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in out) == [("1", len(html_text.main_text(PAGE)))] * 2 + [("None", 0)] and html_text.extract(df.where("false")).count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    for r in pages:  # the same article where no element says that it is one
        assert html_text.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", r.html)) == html_text.main_text(r.html)
    out = {r.page_id: r.text for r in html_text.op5_html_text(spark, sf).collect()}
    import html

    for p in pages:  # the article as a plain reading of this generator's markup gives it
        inside = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:h1|p)>", inside)]
        assert out[p.page_id] == "\n".join(b for b in blocks if b)


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert np.allclose(np.interp([1, 2, 3, 4, 5], x, y), [0, 0.5, 0.5, 1, 1]) and (np.diff(y) >= 0).all()


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert spark.read.parquet(f"{sf}/documents.parquet").count() == quality.op6_quality(spark, sf).count()
    held = out[out.held_out]
    assert ((out.score >= 0) & (out.score <= 1)).all() and (held.predicted == held.quality).mean() > 0.95
    assert all(bool(h) == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(out.doc_id, out.held_out, strict=True))
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x" * 50_000, 0), (3, "a b", 0)], "doc_id long, text string, y int")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit(docs, none) is None and docs.select(quality.score_column(None, F.col("text")).alias("s")).agg(F.max("s")).first()[0] == 0.5
    model = quality.fit(docs, spark.createDataFrame([(d, d % 2) for d in (1, 2, 3, 3)], "doc_id long, quality int"))
    assert docs.select(quality.score_column(model, F.col("text")).alias("s")).count() == 4


def test_statistics_are_of_the_text():
    a, b, c = quality.statistics(["Plain words, as they come.", "PLAIN WORDS!! AS!! THEY COME", None])
    assert not np.allclose(a, b) and c[0] == 0 and len(quality.statistics([])) == 0
    texts = ["alpha beta", "beta gamma delta", "", None, "delta", "delta delta", "\n\nx y\nz", "z"]
    alone = [quality.statistics([t])[0] for t in texts]
    assert np.array_equal(quality.statistics(texts), alone) and np.array_equal(quality.statistics(texts[::-1]), alone[::-1])


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_repair_roundtrip(n):
    r = np.random.Generator(np.random.PCG64(n))
    docs = [np.append(r.zipf(1.3, r.integers(0, 200)) % 3000, 2).astype("<u4") for _ in range(n)] + [np.tile(np.array([5, 6], "<u4"), 500)] * (n > 1)
    s = repair_ids.Shard(repair_ids.pack([None, *range(len(docs))][: len(docs)], docs))
    flat = np.concatenate(docs) if docs else np.zeros(0, "<u4")
    assert np.array_equal(s.ids(), flat) and s.n_ids == len(flat) and [int(c) for c in s.counts] == [len(d) for d in docs]
    for start, count in ((0, 1), (len(flat) // 2, 77), (max(0, len(flat) - 5), 5)):
        assert np.array_equal(s.slice(start, min(count, len(flat) - start)), flat[start : start + count])
    if n == 1000:
        assert len(s.rules) > 10 and len(s.seq) < 0.8 * len(flat)
    wide = repair_ids.Shard(repair_ids.pack([1], [np.array([1_000_000, 7] * 300, "<u4")]))
    assert wide.ids().tolist() == [1_000_000, 7] * 300
    with pytest.raises(ValueError):
        repair_ids.Shard(b"something else")


@pytest.mark.parametrize("top, width", [(256, 2), (60_000, 2), (70_000, 4)])
def test_repair_goes_on_while_rules_pay(top, width):
    r = np.random.Generator(np.random.PCG64(top))
    for ids in (np.tile(np.arange(top - 256, top), 100), r.integers(0, top, 30_000), np.concatenate([np.tile(r.integers(0, top, 50), r.integers(1, 30)) for _ in range(300)])):
        ids = ids.astype("<u4")
        first, rules, lengths, seq = repair_ids.compress(ids)
        keys = seq[:-1].astype(np.int64) << 32 | seq[1:].astype(np.int64)
        at, count = np.unique(keys, return_counts=True)
        count = np.where(at >> 32 == at & 0xFFFFFFFF, (count + 1) // 2, count)  # xx overlaps itself
        assert count.max(initial=0) * (2 if first + len(rules) <= 1 << 16 else 4) <= repair_ids.RULE or first + len(rules) == 1 << 16
        assert np.array_equal(repair_ids.Shard(repair_ids.pack([1], [ids])).ids(), ids)
    first, rules, lengths, seq = repair_ids.compress(np.tile(np.arange(256, dtype="<u4"), 100))
    assert lengths.max() > 100 and len(seq) < 20


def test_repair_takes_wider_symbols_where_that_pays():
    r = np.random.Generator(np.random.PCG64(4))
    ids = np.tile(r.permutation(65_500).astype("<u4"), 12)
    first, rules, lengths, seq = repair_ids.compress(ids)
    assert first + len(rules) > 1 << 16 and 4 * len(seq) + repair_ids.RULE * len(rules) < 1.1 * 2 * len(ids)
    assert np.array_equal(repair_ids.Shard(repair_ids.pack([1], [ids])).ids(), ids)


def test_words_as_the_library_gives_them():
    import random

    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(WORDS), random.Random(3)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", "!", " ", "é", "É", "1", "x", "Ω", "\n", "ª", "_", "<|", "endoftext|>", "²", "İ", "ß", "́"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(1500)] + [None, "", "ẞ ŉ Ÿ ſ"]
    assert [x.tolist() for x in repair_ids.encode_texts(texts, WORDS, 2)] == [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_token_shards(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    rows = [(5, "five words of some text"), (None, "none"), (1, None), (3, ""), (5, "five again"), (9, "nine " * 3000)]
    shards = repair_ids.write_shards(spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)), WORDS, 2, shard_ids=1000)
    got, at = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in repair_ids.read_shards(shards).orderBy("start").collect()], 0
    for (d, text), g in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert g == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rows += [(9, "nine " * 3000)]  # repeated
    assert repair_ids.read_shards(repair_ids.write_shards(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_ids", F.lit(1)), WORDS, 2)).count() == len(rows)
    at = 0
    out = {r.doc_id: r for r in repair_ids.op9_token_shards(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert out.keys() == docs.keys()
    for d in sorted(docs):
        ids = np.array(t.encode(docs[d] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert (out[d].start, out[d].n_tokens, out[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert repair_ids.read_shards(repair_ids.write_shards(spark.createDataFrame([], "doc_id long, text string"), WORDS, 2)).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "decontaminate", "byte_bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        rows = after.collect()
        ids, was = {r.doc_id for r in rows}, {r.doc_id: r for r in before.collect()}
        if name != "byte_bpe":
            assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
            assert len(bad & ids) <= 0.15 * len(bad) and len(good - ids) <= 0.02 * len(good)
        elif name == "line_dedup":
            want = {r.doc_id: r.text for r in line_dedup.line_dedup(before).collect()}
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
        elif name == "ngram_join":
            assert ids == {r.component_id for r in ngram_join.similar_classes(before).collect()}
        elif name == "decontaminate":
            gone = {r.doc_id for r in decontam.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert gone and ids == set(was) - gone
        else:
            assert ids == set(was)
        before = spark.createDataFrame(rows, after.schema)
    run = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert run == {r.doc_id: r.ids_sha256 for r in before.collect()}


def test_pipeline_edges(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "same text here for the pair of them now", "en", "s", 5), (3, "same text here for the pair of them now", "en", "s", 5)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0, name
        assert stage(spark, odd, sf).count() >= 3, name
