"""op2, op4, op5, op6, op7, op8 and op10 against written examples and brute force."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessaly.llm.bpe import BytePairs, decode, encode
from tessaly.llm.chat import final_messages, format_chats, read_back, under_loss
from tessaly.llm.html_text import extract, visible_text
from tessaly.llm.langid import held_out, language_kept, predict, subwords, train
from tessaly.llm.licenses import scan_licenses
from tessaly.llm.q_url_filter import op2_url_filter
from tessaly.llm.quality import measure, quality_kept, quality_verdicts
from tessaly.llm.url_filter import filter_urls

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", " ", "  ", "   a", "a  b", "a \n b", "x\n y", "x \ny", "don't we'll I'M 's", " 's", "a b   c", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|> ", "日本語 テスト 😀😀 x"]
ODD += ["\x1c a\x1c \x1d b", "\x85 a", "tab\t\tb \t c", "a\r\nb  \n\n c ", "x ", "x  ", "ß ²³ ½ 12ab34", "é a\u200bb \ufeff c", "a" * 3000 + " " * 50 + "b" * 300, "\xa0 a \u3000"]


def test_url_filter(spark):
    urls = ["http://a.Example.COM/en/7x?q#f", "https://example.com/en/", "http://notexample.net/de/8", "http://example.net/de/81", "http://x.org/es/", "http://x.org/es", None, "no scheme", "://", "http://", "http://h?x/en/", "http://EN.com/en/é", "http://x.com/en/a\nb"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls * 2)], "page_id long, url string, token string, host string")
    rules = spark.createDataFrame([("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), ("org/*x/", "block"), (None, "block")], "rule string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, rules).collect()}
    want = [
        ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("example.com", "/en/", "com/en/", "block"), ("notexample.net", "/de/8", "net/de/", "allow"), ("example.net", "/de/81", "example.net/de/8", "block"),
        ("x.org", "/es/", "org/es/", "block"), ("x.org", "/es", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"),
        ("en.com", "/en/é", "com/en/", "block"), ("x.com", "/en/a\nb", "com/en/", "block"),
    ]
    assert [got[i] for i in range(len(urls))] == want and [got[i + len(urls)] for i in range(len(urls))] == want
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


#: The contract's rules as it words them.
CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_url_query_follows_the_contract(spark):
    rules = [x.split() for x in CONTRACT.split(", ")]
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    seen = Counter()
    for r in op2_url_filter(spark, "/root/testdata/sf0.01").collect():
        host, path = "", ""
        if "://" in (pages[r["page_id"]] or ""):
            rest = re.split(r"[?#]", pages[r["page_id"]].split("://", 1)[1])[0]
            host, slash, path = rest.partition("/")
            host, path = host.lower(), slash + path
        fit = [(len(rule), rule, verdict) for verdict, rule in rules if f".{host}".endswith("." + rule.split("/")[0]) and path.startswith("/" + rule.split("/", 1)[1])]
        _, rule, verdict = max(fit, default=(0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
        seen[rule] += 1
    assert set(seen) == {x for _, x in rules} | {None}


def test_url_filter_rules_without_literals(spark):
    pages = spark.createDataFrame([(1, "http://a.b/secret/x"), (2, "http://a.b/open")], "page_id long, url string")
    rules = spark.createDataFrame([("/sec*", "block"), ("b", "block"), ("a.b/", "allow")], "rule string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(pages, rules).collect()}
    assert got == {1: ("/sec*", "block"), 2: ("a.b/", "allow")}


def test_chat_log_folds(spark):
    log = [
        (1, 0, "message", "user", "hi \\### </turn>\n", None), (1, 1, "message", "assistant", None, None), (1, 2, "delta", None, "wrong", None), (1, 3, "regenerate", None, None, None),
        (1, 4, "delta", None, "ri", None), (1, 5, "delta", None, "ght", None), (1, 6, "edit", None, "hello", 1), (1, 7, "delta", None, "!", None), (2, 5, "delta", "assistant", "early", None),
        (None, 1, None, "a:\n</turn>", "x", None), (3, 0, "message", "user", "same", None), (3, 0, "message", "user", "same", None), (3, 1, "noise", "user", "zzz", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string, target long").withColumn("formatted", F.lit(1))
    chats = format_chats(df, target="target").withColumns({"turns": read_back(F.col("formatted")), "loss": under_loss(F.col("formatted"), F.col("loss_spans"))})
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in chats.collect()}
    assert got[1] == ([("user", "hello"), ("assistant", "right!")], "right!")
    assert got[2] == ([("assistant", "early")], "early") and got[None] == ([("a:\n</turn>", "x")], "")
    assert got[3][0] == [("user", "same")] * 2
    assert format_chats(df.limit(0)).count() == 0


def test_chat_escapes_are_reversible(spark):
    parts = ["\\", "#", "###", "</turn>", "\n", "\\h", "\\e", "\\\\", "### user:\n", "é😀", "</turn", ">", ""]
    rng = np.random.default_rng(1)
    rows = [(i, k, "assistant" if k % 2 else "user", "".join(rng.choice(parts, 9))) for i in range(60) for k in range(3)]
    log = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string").withColumn("kind", F.lit("message"))
    assert final_messages(log).count() == len(rows)
    chats = format_chats(log).withColumns({"turns": read_back(F.col("formatted")), "loss": under_loss(F.col("formatted"), F.col("loss_spans"))})
    for r in chats.collect():
        mine = [x for x in rows if x[0] == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == [(x[2], x[3]) for x in mine] and r["loss"] == mine[1][3]


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        ("a/LICENSE", gpl), ("a/b/LICENSE", "words first\n" + mit + "\nmore words here"), ("a/b/c/x.py", "code only"), ("a/b2/x.py", None), ("a/b/own.py", "# " + gpl), ("z/x.py", ""), (None, mit),
        ("a/b/c/x.py", "code only"), ("LICENSE.md", mit), ("top.py", "nothing"), ("a/bb/long.txt", "filler " * 20000), ("q/notes.txt", mit),
    ]
    df = spark.createDataFrame([(i, p, t, "clash") for i, (p, t) in enumerate(files)], "file_id long, path string, text string, license string")
    got = {r["file_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in scan_licenses(df, {"MIT": mit, "GPL-3.0": gpl, "empty": "!"}).collect()}
    assert got[0] == ("GPL-3.0", "GPL-3.0", None) and got[1] == ("MIT", "MIT", None) and got[4] == ("GPL-3.0", "GPL-3.0", None)
    assert got[2] == got[7] == (None, "MIT", "a/b") and got[3] == (None, "GPL-3.0", "a") and got[10] == (None, "GPL-3.0", "a")
    assert got[5] == (None, "MIT", "") and got[9] == (None, "MIT", "") and got[6] == ("MIT", "MIT", None) and got[11] == ("MIT", "MIT", None)
    assert scan_licenses(df.limit(0), {"MIT": mit}).count() == 0
    assert {r["license"] for r in scan_licenses(df, {}).collect()} == {None}


def test_licenses_over_several_lines(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    long = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and its documentation files,\n\nto deal in the software without restriction, including\nthe rights to use, copy, modify, merge, publish and sell copies."
    filler = " ".join(f"w{i} stands here" for i in range(80))
    files = [
        ("a/LICENSE", "This work is\nlicensed under the\nGNU General\nPublic License,\nversion 3."), ("a/x.py", "code"), ("b/x.c", "/*\n * Released\n * under the\n * MIT License.\n */\n\n" + filler),
        ("c/x.txt", f"{filler}. {gpl} {filler}"), ("d/LICENSE", long), ("d/x.py", "code"), ("e/x.py", "# " + long.replace("\n", "\n# ") + "\n\n" + filler), ("f/x.txt", filler + "\nthe license is public"),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "file_id long, path string, text string")
    got = {r["file_id"]: (r["own_license"], r["license"], r["own_score"]) for r in scan_licenses(df, {"MIT": mit, "GPL-3.0": gpl, "LONG": long}).collect()}
    assert [got[i][:2] for i in range(8)] == [("GPL-3.0",) * 2, (None, "GPL-3.0"), ("MIT",) * 2, ("GPL-3.0",) * 2, ("LONG",) * 2, (None, "LONG"), ("LONG",) * 2, (None, None)]
    assert all(got[i][2] == 1 for i in (0, 2, 3, 4, 6))
    # a block that isn't a whole template
    part = spark.createDataFrame([(0, "g/x.py", "/* granted free of charge to any person obtaining a copy of this software\n * and documentation to deal in the software without restriction\n * including rights to use copy modify merge publish and sell copies */")], df.schema)
    assert scan_licenses(part, {"LONG": long}).first()["own_license"] == "LONG"


def test_bpe_is_the_library(spark):
    library, own = Tokenizer.from_file(PATH), BytePairs(PATH)
    for t in ODD:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, repr(t)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([own.byte_id[0xE6], own.byte_id[0x41]]) == "\ufffdA"
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, None, 1)], "doc_id long, text string, ids int")
    rows = decode(encode(df, PATH), PATH).collect()
    assert all(r["decoded"] == (r["text"] or "") and r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids for r in rows) and len(rows) == len(df.collect())
    assert decode(encode(df.limit(0), PATH), PATH).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs, ~held_out())
    found = predict(docs, model).withColumn("held_out", held_out()).collect()
    unseen = [r for r in found if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in unseen) >= 0.97 * len(unseen) and all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["rejected"] for r in found) <= 0.02 * len(found)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "the " * 200000, "xx")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3)) and got[4]["lang_pred"] in model.labels
    assert train(odd.limit(0), F.lit(True)) is None and {r["lang_pred"] for r in predict(odd, None).collect()} == {"und"}
    kept = language_kept(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()


UNLEARNT = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "qzxv wkjq pfgh zzkw xqjv hjkq vbnm wqrt xzcv plkj kqwz jxvq gthy wvxz qqkz rtzp mnbx cvkq",
    "x7f3kq-99zt kqz81-wv xj4-pq0 zzq-kd93 vvx_q71 hq-w82kz jx55-qpz kvw-0z9q xzq-71kk",
]


def test_language_id_rejects_what_it_never_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame(list(enumerate(UNLEARNT)), "doc_id long, text string")
    for learnt in (docs, docs.where("lang IN ('de', 'en')"), docs.where("lang = 'en'")):
        model = train(learnt, ~held_out())
        assert {r["doc_id"] for r in predict(odd, model).collect() if r["rejected"]} == set(range(len(UNLEARNT)))
        assert predict(learnt.where(held_out()), model).where("rejected").count() <= 0.02 * learnt.where(held_out()).count()


def test_subwords_depend_on_letters_only():
    assert subwords("Ab, cd!").tolist() == subwords("ab cd").tolist() and subwords("1 2 3").sum() == 0
    assert subwords("ab").sum() == 2 + 3 + 2 + 1  # a b; _a ab b_; _ab ab_; _ab_


def test_html():
    assert visible_text(None) == visible_text("") == "" and visible_text("plain  text\n here") == "plain text here"
    page = "<html><head><title>x</title></head><body><h1>A &amp; B</h1><p>one<p>two <b>bold</b>ly<br>next<ul><li>a<li>b<ol start=3><li>c</ol></ul><table><caption>T</caption><tr><th>n<th>value<tr><td>long name<td>1<tr><td>x<td>22</table><div hidden>no</div><span style='display:none'>no</span><pre> a\n  b</pre>tail<script>if(a<b)</script>"
    assert visible_text(page) == "A & B\n\none\n\ntwo boldly\nnext\n\n* a\n* b\n  3. c\n\nT\nn          value\nlong name  1\nx          22\n\n a\n  b\n\ntail"
    for broken in ("<", "<p", "</p>", "<<a>>b", "<table><td>x</table></table>y", "<li>x", "a<!-- open", "<b><i>x</b></i>y", "<script>never closed", "<div>" * 5000 + "deep", "<table><tr><td>" * 200 + "deep"):
        visible_text(broken)
    assert visible_text("<div>" * 5000 + "deep") == "deep" and visible_text("<table><tr><td>" * 200 + "deep") == "deep"


def test_html_head_and_body_tags_may_be_left_out():
    assert visible_text("<!doctype html><head><title>T</title><p>Hello <b>you</b>") == "Hello you"
    assert visible_text("<head>\n<meta charset=utf-8><link rel=x><script>s</script>\n<style>s</style>Plain text<p>more</p>") == "Plain text\n\nmore"
    assert visible_text("<title>T</title><h1>A</h1>b") == "A\n\nb" and visible_text("<html><head><title>T</title><body>x") == "x"
    assert visible_text("<head><title>T</title></head>a<head>b") == "ab" and visible_text("<p>a<head>b") == "ab"
    assert visible_text("a <span aria-hidden=true>b</span> <math><mi>x</mi><annotation>no</annotation></math> <object data=y><param name=z>fallback</object><i hidden>no</i>") == "a b x fallback"


def test_html_visibility():
    page = "a<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no<table><tr><td>no<td style='visibility:visible'>cell</table></div>"
    assert visible_text(page) == "a\nyes\n\n  cell"
    assert visible_text("<svg><title>t</title><path/><text x=1>drawn <tspan>more</tspan></text><text>two</text><desc>no</desc></svg>z") == "drawn more two z"
    assert visible_text("a<dialog>no</dialog><dialog open>d</dialog><p hidden>no<i style='display : none'>no</i>") == "a\nd"


def test_html_depth_and_size():
    for page, want in (("<div>" * 40000 + "deep", "deep"), ("<p><button>" + "<div>" * 40000 + "deep", "deep"), ("<table><tr><td>" * 3000 + "deep", "deep"), ("<ul><li>" * 20000 + "x", "x"), ("<p>x" * 40000, "x")):
        began = time.process_time()
        assert visible_text(page).split()[-1] == want and time.process_time() - began < 6
    assert len(visible_text("word " * 400000).split()) == 400000


def test_html_through_spark(spark):
    pages = spark.createDataFrame([(1, None, "clash"), (2, "", "clash"), (3, "<p>a<p>b", "clash"), (3, "<p>a<p>b", "clash")], "page_id long, html string, text string")
    assert sorted(tuple(r) for r in extract(pages).drop("html").collect()) == [(1, ""), (2, ""), (3, "a\n\nb"), (3, "a\n\nb")]


def test_html_keeps_every_visible_word(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract(pages).collect():
        plain = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", r["html"])
        import html

        words = html.unescape(re.sub(r"<[^>]*>", " ", plain)).split()
        got = [w for w in r["text"].split() if w not in ("*", "-", "+")]
        words = [w for w in words if w not in ("*", "-", "+")]
        assert Counter("".join(got)) == Counter("".join(words))
        if "<table" not in r["html"] and "<ol" not in r["html"]:  # cells of several lines stand side by side
            assert "".join(got) == "".join(words)
    assert extract(pages.limit(0)).count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 8, 9, 16, 17, 60, 900):
        text = "".join(rng.choice(["a", "b", "é", "#x"]) + rng.choice([" ", "\n", "\t", " \x1c"]) for _ in range(n))
        assert measure(text) == brute_quality(text)
    assert measure(None) == (0, 0, 0, 0, 0) and measure("a b c d e f g h " * 2)[4] == 16


def test_quality_hosts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "bad", "spam") for i in range(60)] + [(100 + i, good, "spam") for i in range(2)] + [(200 + i, good, "fine") for i in range(50)] + [(300, "bad", "fine"), (301, None, None), (302, good, None)]
    rows += [(400 + h * 10 + i, good, f"h{h}") for h in range(5) for i in range(8)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, n_words int")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_verdicts(docs).collect()}
    assert got[100] == (False, False) and got[200] == (False, True) and got[300] == (True, False) and got[301] == (True, False) and got[302] == (False, True)
    kept = quality_kept(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, k) in got.items() if k)
    assert quality_verdicts(docs.limit(0)).count() == 0 and quality_kept(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(i, good, f"s{i}", 0) for i in range(4)], docs.schema)
    assert quality_kept(alone).count() == 4


def test_digests_follow_the_contract(spark):
    from tessaly.llm.q_bpe import op6_bpe

    library = Tokenizer.from_file(PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op6_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a<!-- c --!>b", "ab"),
        ("a<!-->b<!--->c<!-- d", "abc"),
        ("<details>x<summary>s</summary>body</details>z", "s\nz"),
        ("<details open><summary>s</summary>body</details>", "s\nbody"),
        ("<details><p>no summary</details>z", "z"),
        ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
        ("<ol reversed start=10><li>a<li value=4>b<li>c</ol>", "10. a\n4. b\n3. c"),
        ("<ol start=3><li>a<ul><li>x</ul><li>b</ol>", "3. a\n   - x\n4. b"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>a<td rowspan=0>b<td>x<tr><td>c<td>y<tr><td>d</table>", "a  b  x\nc     y\nd"),
        ("<table><tr><td rowspan=2 colspan=2>big<td>1<tr><td>2</table>", "big    1\n       2"),
        ("<table><tr><td rowspan=3>a<tr><td>b<td rowspan=2>c<tr><td>d</table>", "a\n   b  c\n   d"),
        ("x </a y <! z", "x </a y <! z"),
        ("<a title='x > y'>in</a> <b", "in"),
    ],
)
def test_written_renderings(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize("page", ["</a" * 40_000, "<!" * 40_000, "<b>" * 100_000, "<b>x" * 100_000, "<!--" * 40_000, "<" * 100_000, "<a " * 40_000, "<p>a" * 50_000])
def test_time_in_proportion_to_a_page(page):
    began = time.process_time()
    visible_text(page)
    assert time.process_time() - began < 5  # some tenths of a second; quadratic forms took far longer
