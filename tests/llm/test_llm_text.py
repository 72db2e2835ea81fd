import hashlib
import random
import zlib

import numpy as np
import pytest

from hydroflow.llm import bpe, html_extract, langid

SF = "/root/testdata/sf0.001"


def phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i:i + k + 1] in sample and text[i] in sample:
            k += 1
        n += 1
        i += k
    return n


def test_cross_parsing_counts_longest_phrases():
    rng = random.Random(2)
    sample = " ".join("".join(rng.choice("abc ") for _ in range(300)).split())
    parser = langid.CrossParser({"x": [sample], "y": ["zzz"]})
    for _ in range(30):
        t = "".join(rng.choice("abcq") for _ in range(rng.randint(1, 60)))
        h, letters = parser.entropies([t])
        assert letters[0] == len(t)
        assert h[0, 0] == pytest.approx(phrases(t, sample) * np.log2(len(sample)) / len(t))


def test_large_alphabets_stay_small_and_exact():
    """3,000 distinct letters beside Latin: phrases as defined, tables that follow the sample and not the alphabet."""
    rng = random.Random(4)
    han = "".join(chr(0x4E00 + i) for i in rng.sample(range(3000), 3000)) + "".join(chr(0x4E00 + int(3000 * rng.random() ** 3)) for _ in range(6000))
    latin = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(1500))
    parser = langid.CrossParser({"han": [han], "latin": [latin]})
    assert parser.alphabet > 3000 and sum(t.nbytes for t in parser.tables) < 8 << 20
    for _ in range(20):
        at = rng.randrange(len(han) - 60)
        t = han[at:at + rng.randint(1, 60)] + "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(rng.randint(0, 30)))
        h, letters = parser.entropies([t])
        assert letters[0] == len(t) and parser.predict([t])[0] == ["han"]
        assert h[0, 0] == pytest.approx(phrases(t, han) * np.log2(len(han)) / len(t))
        assert h[0, 1] == pytest.approx(np.log2(len(latin)))


def test_batches_do_not_change_predictions():
    parser = langid.CrossParser({"en": ["the cat and the dog of the house"], "fr": ["le chat et le chien de la maison"]})
    texts = ["the dog", "le chien", "", "12 34", "THE CAT " * 400, "数字"]
    names, scores = parser.predict(texts)
    assert names == ["en", "fr", "und", "und", "en", parser.predict(["数字"])[0][0]]
    for t, n, s in zip(texts, names, scores):
        a, b = parser.predict([t])
        assert (a[0], b[0]) == (n, s) and 0 <= s <= 1


def test_language_edges(edge_docs, no_docs):
    samples = langid.sample_of(edge_docs)
    out = langid.identify(edge_docs, samples)
    assert set(out.columns) == set(edge_docs.columns) | {"lang_pred"}  # score is replaced
    got = {r.text: r.lang_pred for r in out.collect()}
    assert got[None] == got[""] == got[" \t\n"] == got["12 34 !!"] == "und"
    assert set(got.values()) <= {"und", *samples}
    kept = langid.drop_unidentified(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 4
    assert langid.sample_of(no_docs) == {}
    assert {r.lang_pred for r in langid.identify(edge_docs, {}).collect()} == {"und"}
    assert langid.drop_unidentified(no_docs).count() == 0


def test_language_rejections(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pred = {r.doc_id: (r.lang_pred, r.score) for r in langid.op7(spark, SF).collect()}
    for languages, least in ((None, 0.0), (["de", "fr"], 0.0), (None, 0.55), (["en"], 0.6)):
        want = {i for i, (n, s) in pred.items() if n != "und" and (languages is None or n in languages) and s >= least}
        got = langid.drop_unidentified(docs, languages=languages, min_score=least)
        assert {r.doc_id for r in got.collect()} == want and 0 < len(want) < len(pred) + (languages is None and not least)
        counts = {(r.lang_pred, r.kept): r.n for r in langid.rejections(docs, languages=languages, min_score=least).collect()}
        assert sum(n for (_, kept), n in counts.items() if kept) == got.count() and sum(counts.values()) == docs.count()


def test_op7_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op7(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97


TEXTS = ["", None, "a<|endoftext|>b", "  <|endoftext|>  x", "...<|endoftext|><|endoftext|>", "hello world  x　y \n\n z  ",
         "I'll don't 'S 's it's", "数字123４５ ½ x²", "😀 😀😀 ​‍ zero﻿", "tab\t\tx \r\n\r\n y", "\x1c\x1d\x1e\x1f \x85 a b ",
         "naïve é é — “q”", " ", "   ", "\n", "x" * 5000 + " " * 3000, "ĺ̀ אבג هذا ١٢٣", "\x00\x01 \x7f", "'ll'll 'll", "a  'll",
         "wort lang " * 20_000]


def test_bpe_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(bpe.default_path())
    df = spark.createDataFrame([(i, x, "extra", i) for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string, _words int")
    digests = {r.doc_id: r for r in bpe.digests(df).collect()}
    back = {r.doc_id: r for r in bpe.decode(bpe.encode(df)).collect()}
    for i, x in enumerate(TEXTS):
        ids = tok.encode(x or "", add_special_tokens=False).ids
        assert list(back[i].ids) == ids
        assert back[i].decoded == (x or "")
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(df.limit(0)).count() == 0 and bpe.decode(bpe.encode(df.limit(0))).count() == 0


def test_bpe_table_starts_anew(monkeypatch):
    table = bpe.WordTable(bpe.default_path())
    first = table.ids_of([" the", " cat"])
    monkeypatch.setattr(bpe, "MEMO_WORDS", 1)
    assert table.ids_of([" cat", " the"]) == first[::-1]
    assert table.decode_bytes([i for t in first for i in t]) == b" the cat"


def test_op9(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(bpe.default_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op9(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = tok.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><p>Welcome to the best of the site for all of you and it is the one</p></header>
<nav><ul><li><a href="/">Home</a><li><a href="/b">All of the news</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies to give you the best of all on this site, and that is it.</div>
<div id="content"><h2><a href="/x">The Title</a></h2><p>This is the first   paragraph of the article and it is
long enough to be good.</p><p>Short.</p><p>See <a href="/y">this</a> for more of the same in the text that is here.
<script>var a = "<p>no</p>";</script><ul><li>Item one<li>Item two</ul><div class="ad">Buy it now</div>
<p>Another paragraph with 2 &lt; 3 &amp;amp; x&nbsp;y &#233; &copy of the final text in it.</p></div>
<section id="comments"><article class="comment"><p>I think that this is the best of the articles that I have read.</p></article></section>
<aside><p>Related of the and in to the a is it that for on with</p></aside>
<form><label>Name of the person to be in the form and</label></form><footer>Copyright of the site and of all that is in it</footer></body></html>"""


def test_html_rules():
    assert html_extract.main_text(PAGE).split("\n") == [
        "The Title", "This is the first paragraph of the article and it is long enough to be good.", "Short.",
        "See this for more of the same in the text that is here.", "Item one", "Item two",
        "Another paragraph with 2 < 3 &amp; x y é © of the final text in it."]
    assert html_extract.main_text("") == html_extract.main_text(None) == ""
    assert html_extract.main_text("just text &amp; more") == "just text & more"
    assert html_extract.main_text("<article><p>Hm.</p><p>Ja") == "Hm.\nJa"
    assert html_extract.main_text("<div class=sidebar><main><p>Inner text that is the main one of the page and it stays.</main></div>").startswith("Inner")
    assert html_extract.main_text("<p><b>" * 2000 + "x" + "<" * 50) != ""
    assert len(html_extract.main_text("<p>" + "the word of " * 100_000)) == 1_200_000 - 1


def test_html_head_left_open():
    body = "<p>This is the first paragraph of the article and it is long enough to be good."
    want = body[3:]
    for head in ("<head><title>T</title><meta charset=utf-8>", "<head><style>p{}</style>", "<head>", "<head><title>T</title></head>"):
        assert html_extract.main_text(f"<html>{head}<body>{body}") == want
        assert html_extract.main_text(f"<html>{head}{body}") == want
        assert html_extract.main_text(f"<html>{head}<br>{body}") == want


def test_html_other_languages():
    polish = "Wczoraj wieczorem mieszkańcy miasta zebrali się przed ratuszem, żeby porozmawiać o nowym moście."
    chinese = "昨天晚上，市民们聚集在市政厅前讨论新桥的建设，市长回答了许多问题，并承诺在明年春天之前完成所有的工程。"
    for text in (polish, chinese):
        menu = '<nav><a href="/">Start</a><a href="/b">Blog</a></nav>'
        page = f'{menu}<div><h2>Most</h2><p>{text}</p><p>Tak.</p></div><div class="ad">{text}</div><ul><li><a href="/c">{text}</a></li></ul><footer>{text}</footer>'
        assert html_extract.main_text(page) == f"Most\n{text}\nTak."
        assert html_extract.main_text(f"{menu}<article><h1>Most</h1><p>{text}</p></article><footer>{text}</footer>") == f"Most\n{text}"
    assert html_extract.main_text('<nav><a href="/">Start</a></nav><p>Krótki tekst.</p><footer>Stopka</footer>') == "Krótki tekst."


ARTICLE = ("The river is at its highest for ten years and the people of the town have gone to the hills with all that they could carry. "
           "It was not known on Monday when they would be back, or what they are to find.")


@pytest.mark.parametrize("page", [
    "<form id=aspnetForm><input type=hidden><div>{}</div></form>", "<form><article><p>{}</p></article><input><input></form>",
    "<div class='wrapper has-sidebar'><p>{}</p></div>", "<main class='site-main with-sidebar'><p>{}</p></main>",
    "<article class='post category-promotion'><p>{}</p></article>", "<article class='hentry tag-social'><p>{}</p></article>",
    "<div class='discussion-paper'><p>{}</p></div>", "<nav><ul><li><a href=/>Home</a><article><p>{}</p></article>",
    "<div id=sidebar-page class=social><p>{}</p></div>", "<div class=widget><p>{}</p></div><footer>All the rights of the site are with us and with it</footer>",
    "<article class=sponsored><p>{}</p></article>", "<nav>Menu<main><p>{}</p></main>",
])
def test_html_real_markup(page):
    menu = "<nav><a href=/a>One</a> <a href=/b>Two</a></nav>" if "<nav" not in page else ""
    assert html_extract.main_text(f"<html><body>{menu}{page.format(ARTICLE)}</body></html>") == ARTICLE


@pytest.mark.parametrize("side", [
    "<div class='site-footer'>{}</div>", "<div id=cookieNotice>{}</div>", "<section class='ad-box2'>{}</section>", "<ul class='comment-list'><li>{}</li></ul>",
    "<form class=search><label>{}</label><input><select></select></form>", "<div class='sidebar left'><p>{}</p></div>", "<aside><article><p>{}</p></article></aside>",
    "<ol class=comments><li><article class=comment-body><p>{}</p></article></ol>", "<div role=complementary>{}</div>", "<div class='newsletter-signup'>{}</div>",
])
def test_html_side_matter_still_goes(side):
    text = "This is what we say to all of the readers that are on the page."
    for main in ("<article><p>{}</p></article>", "<div><p>{}</p></div>"):
        assert html_extract.main_text(main.format(ARTICLE) + side.format(text)) == ARTICLE


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, "u", "t"), (1, "", None, "t"), (None, "<p>a  b", "u", "t")], "page_id long, html string, url string, text string")
    out = html_extract.extract(df).collect()
    assert sorted((r.text, r.n_chars) for r in out) == [("", 0), ("", 0), ("a b", 3)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_op8_articles(spark):
    import html
    import re
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_extract.op8(spark, SF).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
