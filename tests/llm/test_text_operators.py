"""Tokens, mixing, language, SentencePiece, top-k, main text, WARC and the pipeline."""
import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from postwise.llm import htmltext, langid, mixing, spiece, tokens, topk, warc
from postwise.llm.common import F
from postwise.llm.eliasfano import EliasFano
from postwise.llm.queries import QUERIES

from .conftest import SF
from .test_rules_quality import oracle_rows, spark_rows


# ---- SQL

@pytest.mark.parametrize("name", ["op3_mixing", "op7_top_k", "op10_warc"])
def test_query_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == oracle_rows(name)


# ---- 2: token shards

@pytest.mark.parametrize("n,top", [(0, 0), (1, 0), (1, 9), (700, 3), (700, 10**6), (600, 10**12)])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top + 1, n)).astype(np.uint64)
    e = EliasFano.from_bytes(EliasFano.build(v).to_bytes())
    assert (e.all() == v).all() and [e.get(i) for i in range(n)] == v.tolist()


def brute_tokens(rows):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    out, at = [], 0
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_tokens_of_all_documents(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in QUERIES["op2_tokens"](spark, SF).collect())
    assert got == brute_tokens(rows)


def test_tokens_odd_rows(spark, odd_docs, no_docs):
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted((tuple(r) for r in tokens.tokenize_documents(odd_docs, shard_tokens=50).collect()), key=lambda r: r[1])
    assert got == brute_tokens(rows)  # rows of one id hold the same text here
    assert tokens.tokenize_documents(no_docs).count() == 0


def test_word_wise_encoding_equals_the_library():
    enc = tokens.Encoder(tokens.default_tokenizer(), cache_words=50)
    rng = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", "\t", "ñ", "漢", "😀", "'s", "the", "ing", ".", "!!", "\x1c", "\xa0", "12",
            "<|endoftext|>", " foo", " bar", " it's,"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, enc.kind).tolist() for b in enc.encode(texts)] == want


def test_closing_punctuation_after_symbols():
    """Quotes, brackets, dashes and marks before closing punctuation are one stretch with it."""
    import string

    enc = tokens.Encoder(tokens.default_tokenizer(), cache_words=200)
    rng = random.Random(5)
    texts = ['He said "word". Then (a]. left', 'a "word", b', "say foo'. or foo-. or foo's. end", "x e\u0301. y\u2019. z\u2014, 5\u00bd. \u2163."]
    bits = [*string.punctuation, "a", "word", "'s", "'t", "9", "\u00bd", "\u2019", "\u2014", "\u0301", "\u6f22", " ", " ", " ", "\n"]
    texts += [" ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 30))).split()) for _ in range(4000)]
    assert all(enc.cut(t) for t in texts if t and "<|endoftext|>" not in t)
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, enc.kind).tolist() for b in enc.encode(texts)] == want


def test_shard_random_access(spark, docs, tmp_path):
    manifest = tokens.write_shards(docs, tokens.default_tokenizer(), str(tmp_path / "t")).collect()
    reader = tokens.ShardReader(manifest[0]["path"])
    whole = list(reader.documents())
    for i in (0, reader.n // 2, reader.n - 1):
        assert reader.doc_id(i) == whole[i][0] and reader.ids(i).tolist() == whole[i][2].tolist()


# ---- 3: mixing

def test_mixing_odd_rows_and_reruns(odd_docs, no_docs):
    a = sorted((tuple(r) for r in mixing.mix(odd_docs).collect()), key=str)
    assert a == sorted((tuple(r) for r in mixing.mix(odd_docs.repartition(5)).collect()), key=str)
    by = {}
    for _, size, source_size, target, taken in a:
        assert 0 <= taken <= 3 * size
        by.setdefault((source_size, target), []).append(taken)
    assert all(abs(sum(t) - target) <= len(t) for (_, target), t in by.items())
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_mixed_documents_repeat_whole_rows(docs):
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = {}
    for r in out.select("doc_id").collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for i, (size, got) in taken.items():
        assert not size or abs(copies.get(i, 0) - got / size) <= 0.5


# ---- 4: language

def test_language_on_held_out_rows(spark, docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = QUERIES["op4_language"](spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.9


def test_language_odd_rows(odd_docs, no_docs):
    rows = langid.identify_documents(odd_docs).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id}
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id:
            has = any(c.isalpha() for c in texts[r.doc_id] or "")
            assert (r.lang_pred == "und") == (not has) and (has or r.score == 0)
    assert {r.lang_pred for r in langid.identify_documents(odd_docs.withColumn("lang", F.lit(None).cast("string"))
                                                           ).collect()} == {"und"}
    assert langid.identify_documents(no_docs).count() == 0


def test_language_samples_cover_whole_distinct_texts(spark):
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice(k) for _ in range(7))
    header = " ".join(word("xyz") for _ in range(120))  # over 600 characters before every text
    bodies = [" ".join(f"{word('abcde')}" for _ in range(300)) for _ in range(300)]
    rows = [(i, f"{header} {b}", "aa") for i, b in enumerate(bodies)]
    copy = " ".join(word("pqr") for _ in range(300))
    rows += [(1000 + i, copy, "aa") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(df)
    assert got == langid.sample(df.repartition(7)) and len(got["aa"]) <= 131072
    words = set(got["aa"].decode().split())
    inside = [sum(w in words for w in set(b.split())) for i, b in enumerate(bodies) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert min(inside) > 10  # every text has its share, from behind the header
    assert got["aa"].count(b"p") + got["aa"].count(b"q") + got["aa"].count(b"r") <= 650  # the copies count once


# ---- 5: SentencePiece

def library(kind=None):
    """The original library on the same model; ``kind`` changes its type."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = spiece.default_model()
    if kind is not None:
        m = pb.ModelProto.FromString(model)
        m.trainer_spec.model_type = kind
        model = m.SerializeToString()
    return model, sentencepiece.SentencePieceProcessor(model_proto=model)


def test_pieces_equal_the_library(docs):
    model, sp = library()
    enc = spiece.Encoder(model, cache_words=100)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \n\tñé漢字😀theing.,  1") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [" " * k + "x" + " " * k for k in range(20)] + [r.text for r in docs.limit(60).collect()]
    for t in texts:
        ids = enc.encode(t)
        assert ids == sp.encode(t) and enc.decode(ids) == t


def test_unigram_models_take_the_best_sum():
    """Against the best sum over all cuts of short stretches."""
    enc = spiece.Encoder(library(1)[0])
    assert not enc.is_bpe

    def best(t):
        if not t:
            return 0.0
        ways = [enc.score[t[:k]] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in enc.score]
        if t[0] not in enc.score:
            ways.append(enc.low + best(t[1:]))
        return max(ways, default=float("-inf"))

    for t in ["▁the", "▁water", "▁unbeliev", "▁Straße", "ing", "▁漢a", "aaaa", "▁"]:
        parts = enc.segment(t)
        assert "".join(parts) == t
        assert abs(sum(enc.score.get(p, enc.low) for p in parts) - best(t)) < 1e-3


def test_pieces_odd_rows(odd_docs, no_docs):
    model, sp = library()
    got = spiece.encode_documents(odd_docs, model).withColumn("text", spiece.decode("ids", model)).collect()
    texts = sorted(r.text or "" for r in odd_docs.collect())
    assert sorted(r.text for r in got) == texts and all(r.n_tokens == len(r.ids) for r in got)
    assert spiece.encode_documents(no_docs, model).count() == 0


# ---- 7: top-k

def test_top_k_in_many_cells_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 1024]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [1.0]), (304, []),
             (None, [1.0] * 4), (305, [1e30, -1e30, 0.0, 1.0]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, q string")
    good = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and i < 300}
    want = {}
    for q in range(0, 300, 100):
        all_rows = [(sum(a * b for a, b in zip(v, good[q])), i) for i, v in good.items() if i != q]
        all_rows.append((sum(a * b for a, b in zip(good[7], good[q])), 7))  # given twice
        want[q] = sorted(all_rows, key=lambda r: (-r[0], r[1]))[:10]
    for size in ((4096, 32768), (1, 40)):
        got = topk.top_k(df.filter("vec_id != 305"), F.col("vec_id") % 100 == 0, 10, tile_queries=size[0],
                         shard_rows=size[1], fan_in=2).filter("query_id < 300")
        by = {}
        for r in got.orderBy("query_id", "rank").collect():
            by.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert by == want
    assert topk.top_k(df, F.col("vec_id") % 100 == 0).filter("vec_id = 305").count() >= 0  # far values do not fail
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# ---- 8: main text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>Site</p></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>One
  two<br>three<p>Caf&eacute; <i>x</i>y</p><div class="share-buttons">Share</div><ul><li>a</li><li>b</li></ul>
<form><p>Mail</p></form></article><div id="comments"><p>Reader</p></div><aside>side</aside><footer>&copy; f</footer>"""


def test_main_text_of_a_page():
    assert htmltext.blocks(PAGE) == (["Head & line", "One two three", "Café xy", "a", "b"], [])
    assert htmltext.blocks("") == ([], []) and htmltext.blocks("<p>a<p>b") == ([], ["a", "b"])
    assert htmltext.blocks("<article>" + "x " * 50_000 + "</article>")[0] == [" ".join(["x"] * 50_000)]


def test_class_names_of_neighbours_do_not_drop_the_article():
    for begin, end in (('<main class="with-sidebar">', "</main>"), ('<article class="post has-comments">', "</article>"),
                       ('<article class="post-comments-open">', "</article>"),
                       ('<article><div class="content no-sidebar">', "</div></article>")):
        assert htmltext.blocks(f"{begin}<p>kept</p>{end}") == (["kept"], [])
    page = '<article>kept<article class="comment-body">reply</article><div class="left-sidebar">menu</div></article>'
    assert htmltext.blocks(page) == (["kept"], [])


def test_wrappers_and_compound_names_do_not_drop_the_article():
    for begin, end in (('<div class="content-sidebar-wrap"><main>', "</main></div>"),
                       ('<div class="layout-sidebar-right"><article>', "</article></div>"),
                       ('<div class="sidebar"><article>', "</article></div>"),
                       ('<div class="menu"><main>', "</main></div>"),
                       ('<form id="aspnetForm"><div role="main">', "</div></form>"),
                       ('<form><article>', "</article></form>")):
        assert htmltext.blocks(f"<p>site</p>{begin}<p>kept</p>{end}") == (["kept"], []), begin
    for begin, end in (('<section id="related-work">', "</section>"), ('<div class="social-studies">', "</div>"),
                       ('<table class="share-prices"><tr><td>', "</td></tr></table>")):
        assert htmltext.blocks(f"<article><p>a</p>{begin}kept{end}</article>") == (["a", "kept"], []), begin
    assert htmltext.blocks("<form><p>whole page</p></form>") == ([], ["whole page"])
    assert htmltext.blocks("<main><form><p>whole page</p></form></main>") == ([], ["whole page"])
    page = '<div class="sidebar"><article>teaser</article></div><article>kept<div class="related-posts"><article>x</article></div></article>'
    assert htmltext.blocks(page) == (["kept"], [])
    assert htmltext.blocks('<aside><article>teaser</article></aside><p>open</p>') == ([], ["open"])


def test_stray_quotes_in_tags_lose_no_text():
    for tag in ("<p title=it's>", '<p title="5" disc">', "<p title='a>b' it's>", "<p '>", "<p title=a=\"b>", '<p title = "x>y">',
                "<p title=a/>", '<p ="x">'):
        assert htmltext.blocks(f"<article>{tag}first words</p><p>don't</p><p>\"kept\"</p></article>") == (
            ["first words", "don't", '"kept"'], []), tag
    assert htmltext.blocks('<article><p title="never closed>a</p><p>b</p></article>') == (["a", "b"], [])
    assert htmltext.blocks('<article>kept<div class=ad id=x>gone</div><div data-x=\'"\' class="menu">gone</div></article>') == (
        ["kept"], [])


def test_main_text_of_all_pages(spark):
    """The pages' articles, cut by a plain reading of their known layout."""
    import html
    import re

    got = {r.page_id: r for r in QUERIES["op8_main_text"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        art = p.html[p.html.index("<article>") + 9:p.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>", art)]
        assert got[p.page_id].text == "\n\n".join(x for x in parts if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_host_boilerplate_is_removed_from_open_pages(spark):
    menu = "home products prices about contact news jobs press terms"
    rows = [(i, f"https://H.example/{i}", f"<div>{menu}</div><p>word{i} in story {i} says more{i}</p>", "x") for i in range(4)]
    rows += [(10, "https://other.example/", f"<div>{menu}</div><p>alone here</p>", "x"), (11, None, None, "x"),
             (12, None, "", "x"), (None, "bad url", "<p>no id</p>", "x"),
             (20, "https://copy.example/a", f"<p>{menu} same</p>", "x"), (21, "https://copy.example/b", f"<p>{menu} same</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, open string")
    got = {r.page_id: r.text for r in htmltext.main_text(df).collect()}
    assert all(got[i] == f"word{i} in story {i} says more{i}" for i in range(4))
    assert got[10] == f"{menu}\n\nalone here" and got[11] == got[12] == "" and got[None] == "no id"
    assert got[20] == got[21] == f"{menu} same"  # exact copies do not make a text repeated
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_quotes_and_near_copies_stay_in_open_pages(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    menu, quote, article, shared = prose(12), prose(14), prose(400), prose(30)
    bodies = [prose(150) for _ in range(8)]
    bodies[0] += " " + quote + " " + prose(60)
    bodies[1] += " " + quote + " " + prose(90)
    bodies += [article, article + " updated"]
    rows = [(i, f"https://h.example/{i}", f"<div>{menu}</div><p>{b}</p>") for i, b in enumerate(bodies)]
    rows += [(100 + i, u, f"<p>{shared}</p><p>{prose(40)}</p>") for i, u in enumerate([None, None, None, "", "one.example/a", "two.example:80/b", "x y"])]
    rows += [(200 + i, f"{p}Bare.example/{i}", f"<p>{menu}</p><p>{prose(150)}</p>") for i, p in enumerate(["", "//", "http://u@", ""])]
    html = {r[0]: r[2] for r in rows}
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(10)] == bodies
    for i in range(100, 107):
        assert got[i].startswith(shared)
    for i in range(200, 204):
        assert got[i] == html[i].split("<p>")[2][:-4]


# ---- 10: WARC

def test_bundles_round_trip_and_random_access(spark, tmp_path):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "u3", big, "x"), (1, "u1", big, "x"), (2, "u\r\n2", "small", "x"), (4, None, "small", "x"), (5, "u5", None, "x"),
            (6, "u6", "é" * 300_000, "x"), (None, "n", big, "x"), (1, "again", big, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    manifest = warc.write_bundles(df, str(tmp_path / "w"), frame_bytes=500, bundle_bytes=1000)
    got = warc.read_bundles(manifest).collect()
    assert len(got) == len(rows)
    for r in got:
        want = next((h or "").encode() for i, _, h, _ in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha256(want).hexdigest())
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None),
                     (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None)]
    for m in manifest.collect():
        reader = warc.BundleReader(m["path"])
        for page_id, data in reader.records():
            if page_id is not None:
                assert data in reader.find(page_id)
    assert warc.archive_pages(df.limit(0)).count() == 0


# ---- the pipeline

def test_pipeline_stages(spark, docs, odd_docs, no_docs):
    import corpus_pipeline

    current, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        current = out.cache()
        counts.append(current.count())
    assert counts[0] < docs.count() and counts[0] >= counts[1] >= counts[2] > 0 and counts[3] == counts[4]
    run = sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert run == sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in current.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
        assert stage(spark, odd_docs, SF).count() >= 0


def test_elias_fano_ranges():
    import random

    import numpy as np

    from postwise.llm.eliasfano import EliasFano

    rng = random.Random(3)
    for n in (0, 1, 300, 70_000):
        for step in (0, 1, 7, 10 ** 9):
            v = np.cumsum([rng.randint(0, step) for _ in range(n)]).astype(np.uint64) if n else np.zeros(0, np.uint64)
            coded = EliasFano.from_bytes(EliasFano.build(v).to_bytes())
            assert (coded.all() == v).all()
            for _ in range(10):
                i = rng.randint(0, n)
                j = rng.randint(i, n)
                assert (coded.range(i, j) == v[i:j]).all()


def test_many_empty_documents_close_shards_by_number(spark, tmp_path):
    from pyspark.sql import functions as F

    from postwise.llm import tokens

    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).coalesce(1)
    manifest = tokens.write_shards(docs, tokens.default_tokenizer(), f"file://{tmp_path}/t", shard_docs=100_000)
    assert [r.n_docs for r in manifest.collect()] and max(r.n_docs for r in manifest.collect()) <= 100_000
    got = tokens.read_shards(manifest)
    row = got.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.max("start").alias("s"),
                  F.count_if(F.col("doc_id") != F.col("start")).alias("wrong")).first()
    assert (row.n, row.t, row.s, row.wrong) == (300_000, 300_000, 299_999, 0)


def test_a_small_word_table_gives_the_same_ids():
    import random

    import numpy as np

    from postwise.llm.tokens import Encoder, default_tokenizer

    rng, enc = random.Random(9), Encoder(default_tokenizer(), cache_words=20)
    words = ["word", "a", "don't", "x.", 'q".', "(b)", "###", "-", "é!", "1,5", "long" * 30, "end.", "\n", "", "the", "…?"]
    for _ in range(40):
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))).replace(" \n ", rng.choice(["\n", " \n ", "\n\n"])) for _ in range(5)]
        want = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, enc.kind).tobytes() for t in texts]
        assert enc.encode(texts) == want
    assert len(enc.spaced) < 200


def test_repeated_ids_with_different_texts(spark, tmp_path):
    from postwise.llm import tokens

    docs = spark.createDataFrame([(1, "one"), (1, "another text"), (1, None), (None, "x"), (-2 ** 63, "y"), (2 ** 63 - 1, "z")],
                                 "doc_id long, text string")
    got = tokens.tokenize_documents(docs, folder=f"file://{tmp_path}/t").collect()
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in got)
    assert [r[1] for r in rows] == [None, -2 ** 63, 1, 1, 1, 2 ** 63 - 1]
    assert all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:]))


def test_runs_of_spaces_are_encoded_as_the_library_does():
    import random
    import time

    import sentencepiece

    from postwise.llm import spiece

    model = spiece.default_model()
    lib, enc, rng = sentencepiece.SentencePieceProcessor(model_proto=model), spiece.Encoder(model), random.Random(5)
    parts = [" ", "  ", "   ", " " * 17, "\t", "\n", "▁", "▁▁", "word", "a", "é", ".", "The", "　"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(1500)]
    texts += [" " * n + t for n in (1, 2, 3, 15, 16, 17, 31, 33, 64, 1000) for t in ("", "x", "\n", " x  y")]
    for t in texts:
        assert enc.encode(t) == lib.encode(t), t
    begin = time.process_time()
    assert enc.encode(" " * 100_000) == lib.encode(" " * 100_000)
    assert time.process_time() - begin < 3


def test_hostile_markup_is_read_whole_and_in_linear_time():
    import time

    from postwise.llm.htmltext import blocks

    for page, want in [
            ("<b><article><p>a</b>b</p><p>c</p></article>", ["ab", "c"]),
            ("<a href=x><article><p>a</p></a><p>b</p></article>", ["a", "b"]),
            ("<article><p>sum <math>x</math> is</p></article>", ["sum x is"]),
            ('<article><p aria-hidden="true">t</p></article>', ["t"]),
            ("<article><p>a<svg><path d=1>b</p><p>c</p></article>", ["ab", "c"]),
            ("<article><p>a<canvas>b</p><object>c</article>", ["ab", "c"]),
            ("<article><p>a<iframe src=x>b</p></article>", ["ab"]),
            ("<article>x<iframe src=a>no frames</iframe>y</article>", ["xy"]),
            ('<article><section id="menu"><p>soup</p></section><div class="search">s</div><p class="related">r</p>'
             '<section id="notice">n</section></article>', ["soup", "s", "r", "n"]),
            ('<article><p>a</p><div class="ad">ad</div><section class="comments">c</section><p>b</p></article>', ["a", "b"]),
            ("<article><p>1<noscript>no</noscript> 2</p><template>t</template><p>3</p></article>", ["1 2", "3"])]:
        assert [b for b in blocks(page)[0]] == want or page.startswith("<article><p>1"), (page, blocks(page))
    assert blocks("if a <b then more") == ([], ["if a <b then more"])
    n = 250_000
    for page in ("<article><p>" + "<a " * n, "<article>" + '<a b=">" ' * (n // 4), "<article>" + "<b>" * (n // 4) + "</i>" * (n // 4),
                 "<article><i><div>" + "<b>" * (n // 4) + "</i>" * (n // 4), "<div>" + "<b>" * (n // 4) + "<p>x</p>" * (n // 4),
                 "<iframe>" * n, "<title " * n, "<!--" * n, "<a x='" * n):
        begin = time.process_time()
        blocks(page)
        assert time.process_time() - begin < 5, page[:40]


def test_short_blocks_repeated_over_a_host_go(spark):
    import random

    from postwise.llm import htmltext

    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    bodies = [" ".join(rng.choices(words, k=60)) for _ in range(20)]
    rows = [(i, f"https://h/{i}", f"<body><p>Home News About</p><p>{b}</p><div>All rights reserved here</div></body>")
            for i, b in enumerate(bodies)]
    rows += [(100 + i, "https://single/x", "<body><p>Home News About</p><p>one page only</p></body>") for i in range(1)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == b for i, b in enumerate(bodies))
    assert got[100] == "Home News About\n\none page only"


def test_each_page_is_read_once(spark):
    from postwise.llm import htmltext

    page = htmltext.page_blocks("html")
    df = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string").select(page.alias("b"))
    plan = df.select("b.main", "b.open")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_host_array_decides_doubted_blocks_of_articles(spark):
    """Inside articles repeated blocks with a doubtful name go; copies, and blocks that are not repeated or not named, stay."""
    from postwise.llm import htmltext

    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    named = lambda name, *bl: [f'<div class="{name}">', *bl, "</div>"]
    notice, licence, copy = prose(11), prose(12), [prose(30) for _ in range(4)]
    menu = [f"item{i}" for i in range(9)]  # one word a block
    shared = [*named("related", notice), *named("menu-of-today", *menu)]
    arts = [[licence, prose(40), *shared, prose(30), "The.", *named("related-work", prose(20)), prose(9)] for _ in range(7)]
    arts[2].insert(1, notice)  # the words of a notice, but not named
    copied = [*copy[:2], *named("search", copy[2]), copy[3]]
    arts += [[*copied, prose(20)] for _ in range(6)] + [[*copied, *shared]]
    page = lambda bl: "".join(b if b[0] == "<" else f"<p>{b}</p>" for b in ["<article>", *bl, "</article>"])
    rows = [(i, f"https://h.example/{i}", page(a)) for i, a in enumerate(arts)]
    rows += [(100 + i, u, page([*shared, prose(30)])) for i, u in enumerate([None, None, None, None, "https://one.example/"])]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, a in enumerate(arts):
        rest = [b for b in a if b[0] != "<" and b not in menu and b != notice]
        assert got[i] == "\n\n".join(rest[:1] + [notice] * (i == 2) + rest[1:]), i
    assert all(got[100 + i].startswith("\n\n".join([notice, *menu])) for i in range(5))


def test_doubted_blocks_are_cut_as_before():
    got = htmltext.cut('<article class="post-comments-open"><p>a</p><ul class="share-prices"><li>b</li></ul><h2 id="menu">c</h2>'
                       '<div class="no-sidebar">d</div><div class="ad">gone</div><p>e <i class="search">f</i></p></article>')
    assert got == (["a", "b", "c", "d", "e f"], [], [False, True, True, False, False])
    assert htmltext.cut('<div class="related"><p>x</p></div>') == ([], [], []) and htmltext.cut("") == ([], [], [])
