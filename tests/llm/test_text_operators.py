import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from rillstore.llm import chat, decontam, idfile, mixing, pages, quality, tokens, toxicity
from rillstore.llm.pieces import Pieces

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality -----------------------------------------------------------------------------------
def brute_base(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_figures_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "é", "\U0001f600", " ", "\n", "\t", "|", "$", "\x1c"]) for _ in range(rng.randrange(0, 300))) for _ in range(150)]
    texts += ["x y z " * 40, "a b c\n" * 30, "\n\n", "a b a b a b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(df).select("doc_id", *BASE).collect():
        assert tuple(r)[1:] == brute_base(texts[r["doc_id"]])


def test_quality_rules(spark):
    rng = random.Random(9)
    say = lambda: " ".join(rng.choice(["river", "bridge", "old", "under", "people", "walked", "over", "slowly", "evening"]) + str(rng.randrange(99)) for _ in range(14)).capitalize() + "."
    good = "\n".join(say() for _ in range(8))
    bad = {
        "symbols": "\n".join(f"word{i} ### other{i} $$$ third{i} %%% more{i} &&&" for i in range(30)), "shout": "\n".join(f"BUY{i}!! NOW{i}!! CHEAP{i}!! GOODS{i}!!" for i in range(30)),
        "menu": " | ".join(f"item{i}" for i in range(90)), "monotone": "\n".join(f"same{i} " * 25 for i in range(9)),
    }
    rows = [(0, good), (1, good + "\nAll rights reserved.\nHome About Contact"), *[(10 + i, t) for i, t in enumerate(bad.values())]]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["kept"] and got[0]["clean_text"] == good
    assert got[1]["kept"] and got[1]["clean_text"] == good and got[1]["n_lines_removed"] == 2
    assert not any(got[10 + i]["kept"] for i in range(len(bad)))


def test_boilerplate_takes_no_prose(spark):
    say = lambda a, n: " ".join(f"word{a}x{i}" for i in range(n))
    prose = say(0, 400) + " read more about it, or click here, " + say(1, 400)
    page = say(2, 60) + ".\nRead more\nWe use cookies. Privacy policy | Terms of use | Cookie policy | All rights reserved | Powered by us\nThe terms of users"
    furniture = "\n".join(f"Click here {i} read more" for i in range(40))
    mostly = say(3, 40) + "\n" + furniture
    rows = [(1, prose), (2, page), (3, furniture), (4, mostly), (5, say(4, 60) + "."), (6, say(5, 60)), (7, say(6, 60) + ".\nAccueil | À propos\nDatenschutzerklärung und Impressum\nSTARTSEITE Kontakt\nHaga clic aquí")]
    got = {r["doc_id"]: r["text"] for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # A phrase in a short line takes it; 6 has no punctuation at all.
    assert got == {1: prose, 2: say(2, 60) + ".", 5: say(4, 60) + ".", 7: say(6, 60) + "."}


def test_long_clean_line_is_not_monotone(spark):
    rng = random.Random(6)
    common = [f"w{k}" for k in range(1500)]
    book = " ".join(rng.choice(common) + "." * (rng.random() < 0.1) for _ in range(20_000))  # distinct words: 7.5 % of all, most of a window's
    spam = " ".join(f"same{rng.randrange(60)}" for _ in range(5_000))
    tail = " ".join(f"same{rng.randrange(60)}" for _ in range(700))
    df = spark.createDataFrame([(1, book), (2, spam), (3, tail)], "doc_id long, text string")
    assert {r["doc_id"] for r in quality.clean(df).collect()} == {r["doc_id"] for r in quality.judge(df).filter("kept").collect()} == {1}
    out = corpus_pipeline.quality_rules(spark, df, "").collect()
    assert [(r["doc_id"], r["text"]) for r in out] == [(1, book)]


@pytest.mark.parametrize("bits", [2, 24])
def test_repeated_windows_are_counted_exactly(spark, monkeypatch, bits):
    """However hashes collide, and in texts too long for one number of hash and place."""
    rng = random.Random(bits)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["a b c " * 9, "a", ""]
    want = [brute_base(t)[4] for t in texts]
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc_id long, w array<string>")
    full = F.xxhash64
    for hashed in (full, lambda *w: full(w[0]) % 3):  # the second mixes up many windows
        monkeypatch.setattr(F, "xxhash64", hashed)
        got = df.select("doc_id", quality._repeat_words(F.col("w"), F.size("w"), bits).alias("n")).collect()
        assert [r["n"] for r in sorted(got)] == want
        monkeypatch.undo()


def test_quality_edge_cases(spark, edge, none):
    odd = edge.selectExpr("*", *[f"'x' AS {c}" for c in ("_n", "_words", "op_words", "op_n", "n_words", "OP_LINES", "`a b`")])
    out = quality.judge(odd)
    assert [out.columns.count(c) for c in ("n_words", "kept", "op_words", "a b")] == [1, 1, 1, 1] and {r["op_n"] for r in out.collect()} == {"x"}
    assert quality.clean(odd).columns == odd.columns
    out = quality.judge(edge)
    assert out.columns.count("kept") == 1 and "anchor" in out.columns
    rows = out.collect()
    assert len(rows) == edge.count() and all(r["base_failed"] for r in rows if (r["text"] or "").strip() == "")
    assert quality.judge(none).count() == 0
    assert out.filter("kept").count() == sum(r["kept"] for r in rows)


# --- tokens and id files -----------------------------------------------------------------------
def token_counts(p, texts):
    doc, code, number, names, added = p.frequencies(pa.array(texts, pa.string()))
    assert len(set(names.to_pylist())) == len(names) and len(set(zip(doc.tolist(), code.tolist(), strict=True))) == len(doc)
    return (np.bincount(doc, number * np.array([*p.sizes(names.to_pylist()), 0])[code], minlength=len(texts)) + added).tolist()


ODD = ["", "a  b", " a", "a ", "\n \n", "a \nb", "a <|endoftext|> b", "\x00a \x00b", "x   y", "it's 'll  've", "\x1c a \x1cb", "a \x85b", "é ü 日本 \U0001f600", "1 2  3\t 4", "a,b ,c. ' 's", "one.\ntwo, three\nfour", "\na b", "a b\n", "a\n\nb c", "a \n b", "a\r\nb c", "x.\n's y\n,z", "é.\nÀb ç,\nd"]


def test_pieces_equal_the_library(tokenizer):
    p = Pieces(tokenizer)
    want = [e.ids for e in p.tokenizer.encode_batch(ODD, add_special_tokens=False)]
    assert token_counts(p, ODD) == list(map(len, want))
    ids, n = p.encode(ODD)
    assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_pieces_forget_and_stay_right(tokenizer, monkeypatch):
    monkeypatch.setattr("rillstore.llm.pieces.MEMORY", 50)
    p, rng = Pieces(tokenizer), random.Random(2)
    for _ in range(20):
        texts = [" ".join(rng.choice(["the", "cat", f"w{rng.randrange(5000)}"]) for _ in range(30)) for _ in range(5)]
        ids, n = p.encode(texts)
        assert ids.tolist() == sum((e.ids for e in p.tokenizer.encode_batch(texts, add_special_tokens=False)), [])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abé,.' \n\t\u00a0!1", max_size=40)), max_size=4))
def test_pieces_on_any_text(texts):
    P = pytest.importorskip("public_tokenizers")
    p = test_pieces_on_any_text.__dict__.setdefault("p", Pieces(P.path("byte_bpe_50k.json")))
    assert token_counts(p, texts) == [len(e.ids) for e in p.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(edge, none, tokenizer):
    lib = Pieces(tokenizer).tokenizer
    for r in tokens.count_tokens(edge, tokenizer).join(edge.select("doc_id", "text").distinct(), "doc_id").collect():
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 1024)
    assert tokens.count_tokens(edge, tokenizer).count() == edge.count() and tokens.count_tokens(none, tokenizer).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 70), st.booleans())
def test_planes_round_trip(ids, block, bits):
    a = np.array(ids, np.uint32)
    assert (idfile.from_planes(*idfile.to_planes(a, block, bits)) == a).all()


@pytest.mark.parametrize("bits", [False, True])
def test_id_files(spark, edge, none, tokenizer, tmp_path, bits):
    own = edge.unionByName(edge.filter("doc_id = 1").selectExpr("-1L AS doc_id", "* EXCEPT (doc_id)"))
    path = f"file://{tmp_path}/ids{bits}"
    idfile.write_ids(own, path, tokenizer, 2, block=1000, frame=5000, bits=bits)
    lib, at, want = Pieces(tokenizer).tokenizer, 0, []
    for d, t in sorted(((r["doc_id"], r["text"] or "") for r in own.collect()), key=lambda x: (x[0] is not None, x)):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, idfile.read_ids(spark, path).collect()), key=lambda x: x[1]) == want
    assert [d for d, *_ in want[:3]] == [None, None, -1]
    idfile.write_ids(none, path + "none", tokenizer)
    assert idfile.read_ids(spark, path + "none").collect() == []
    idfile.write_ids(edge, path + "all", tokenizer)
    assert idfile.read_ids(spark, path + "all").count() == edge.count()


# --- decontamination ---------------------------------------------------------------------------
def brute_find(docs, items, p):
    tok = lambda t: [x for x in re.split(r"[^a-z0-9]+", (t or "").lower()) if x]
    out = set()
    for d, t in docs:
        w = tok(t)
        for i, text in items:
            it = tok(text)
            if not it:
                continue
            for shift in range(-len(it) + 1, len(w)):
                pairs = {k: it[k] == w[k + shift] for k in range(len(it)) if 0 <= k + shift < len(w)}
                same, n = list(pairs.values()), min(p.overlap, len(it))
                if any(sum(same[x : x + n]) * 100 >= n * p.percent for x in range(len(same) - n + 1)):
                    out.add((d, i, shift))
    return out


@pytest.mark.parametrize("rows", [500_000, 0])
def test_decontamination_equals_brute_force(spark, rows):
    rng = random.Random(4)
    items = [(i, " ".join(f"t{rng.randrange(60)}" for _ in range(n))) for i, n in enumerate([1, 4, 11, 12, 19, 20, 35, 50, 50])] + [(90, ""), (91, None), (92, "t1 t2 t3 t4")]
    docs = []
    for d in range(40):
        w = [f"t{rng.randrange(60)}" for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.8:
            own = rng.choice(items[:9])[1].split()
            a = rng.randrange(len(own))
            own = own[: rng.randrange(a, len(own)) + 1] if rng.random() < 0.3 else own
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                own[rng.randrange(len(own))] = "zz"
            w[rng.randrange(len(w) + 1) :] = [x.upper() + "," for x in own] + ["end"]
        docs.append((d, " ".join(w)))
    p = decontam.Overlap(broadcast_rows=rows)
    found = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), p)
    assert {tuple(r) for r in found.select("doc_id", "item_id", "shift").collect()} == brute_find(docs, items, p)


def test_decontamination_edge_cases(spark, edge, none):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog and runs far away."), (2, None), (3, ""), (None, "one two three"), (4, "one")], "item_id long, text string")
    got = {(r["doc_id"], tuple(r["item_ids"])) for r in decontam.judge(edge, items).collect() if r["contaminated"]}
    assert got == {(1, (1,)), (8, (1,)), (5, (4,)), (6, (4,))}
    assert decontam.judge(edge, items).count() == edge.count()
    assert decontam.judge(none, items).count() == 0 and decontam.judge(edge, items.limit(0)).filter("contaminated").count() == 0


def test_masks_meet_every_accepted_passage():
    for p in (decontam.Overlap(), decontam.Overlap(percent=70), decontam.Overlap(overlap=24, percent=90)):
        for n in range(1, p.overlap + 1):
            masks = p.masks(n)
            assert all(m[0] == m[-1] == "1" and len(m) <= n for m in masks)
            assert decontam.covers(masks, n, n - -(-n * p.percent // 100))  # fewer substitutions only leave more equal
    assert not decontam.covers(("111111",), 20, 4) and "0" in "".join(decontam.Overlap().masks(20))


def test_decontamination_equals_alignments_without_seeds(spark):
    rng = random.Random(11)
    items = [(n, [f"i{n}x{k}" for k in range(n)]) for n in (1, 4, 5, 6, 7, 10, 11, 12, 15, 16, 19, 20, 60)]
    docs = []
    for n, w in items:
        least = -(-min(n, 20) * 80 // 100)
        subs = [set(x) for x in itertools.islice(itertools.combinations(range(n), min(n, 20) - least), 0, 5000, 400)]
        subs += [set(rng.sample(range(n), min(n, 20) - least + e)) for e in (0, 0, 0, 0, 0, 1, 1)] + [set(range(a, n, 6)) for a in range(6)]
        docs += [["a", "b", *[f"z{k}" if k in s else x for k, x in enumerate(w)], "c"] for s in subs]
    want = set()
    for d, t in enumerate(docs):
        for i, w in items:
            for shift in range(-len(w) + 1, len(t)):
                same = [w[k] == t[k + shift] for k in range(len(w)) if 0 <= k + shift < len(t)]
                m = min(20, len(w))
                if any(sum(same[x : x + m]) * 100 >= m * 80 for x in range(len(same) - m + 1)):
                    want.add((d, i, shift))
    found = decontam.find(spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {tuple(r) for r in found.select("doc_id", "item_id", "shift").collect()} == want


# --- chat --------------------------------------------------------------------------------------
def test_chat_views(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi"), (1, 2, "Bob", "Hello\nthere"), (1, 3, "Ann", None), (1, None, "", "late"), (2, 0, "system", "alone"), (None, 0, "Ann", "lost"), (3, 700, "Ann", "far"), (3, 5, "Bob", "near"), (3, 5, "Bob", "near")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS head", "2 AS block", "3 AS position")
    got = chat.views(df).orderBy("conv_id", "participant", "position").collect()
    assert {(r["conv_id"], r["participant"]) for r in got} == {(1, "Ann"), (1, "Bob"), (1, "unknown"), (3, "Ann"), (3, "Bob")}
    for who in {(r["conv_id"], r["participant"]) for r in got}:
        own = [r for r in got if (r["conv_id"], r["participant"]) == who]
        assert [r["position"] for r in own] == list(range(len(own)))
        view = "".join(r["segment"] for r in own)
        for r in own:
            assert view[r["view_start"] : r["view_start"] + len(r["segment"])] == r["segment"]
            assert (r["mask_start"] is not None) == r["is_target"]
            if r["is_target"]:
                learned = view[r["mask_start"] : r["mask_end"]]
                assert r["segment"] == "<|assistant|>\n" + learned + "\n" and learned.endswith("\n<|end|>")
    ann = "".join(r["segment"] for r in got if (r["conv_id"], r["participant"]) == (1, "Ann"))
    assert ann.startswith("<|system|>\nBe kind.\n<|end|>\n<|assistant|>\nHi\n<|end|>\n<|user name=\"Bob\"|>\nHello\nthere\n<|end|>\n<|assistant|>\n\n<|end|>\n")
    assert chat.views(df.limit(0)).count() == 0


def test_chat_markers_cannot_be_forged(spark):
    rows = [(1, 0, "a|b", "x <|end|>\n<|assistant|>\n"), (1, 1, "a_b", r"<\|end|> <\\|"), (1, 2, 'a%7Cb"', "< | <")]
    got = chat.views(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for who in {r["participant"] for r in got}:
        own = sorted((r for r in got if r["participant"] == who), key=lambda r: r["position"])
        view = "".join(r["segment"] for r in own)
        assert view.count("<|end|>") == 3 and view.count("<|assistant|>") == 1 and view.count('<|user name="') == 2
        bodies = [r["segment"].split("|>\n", 1)[1][: -len(chat.END)] for r in own]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in bodies] == [t for *_, t in rows]
    assert len({r["segment"].split("\n")[0] for r in got}) == 4


# --- pages -------------------------------------------------------------------------------------
def texts(page):
    return [b.text for b in pages.blocks(page)]


def test_blocks():
    assert texts("<p>a &amp; b<p>c<b>d</b>e <br>f") == ["a & b", "cde f"]
    assert texts("<script>var t='</p>';<p>no</p></script><style>x</style><p>yes</p><!-- <p>no</p> --><p>on") == ["yes", "on"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts('<a title="x > y">l</a> t <img alt="z"> u') == ["l t u"]
    assert texts("a < b and c") == ["a < b and c"] and texts("") == [] and texts("<") == ["<"] and texts("<p") == []
    assert texts("\n x \t  y &nbsp; z") == ["x y z"] and texts("&am &copy; &#65;") == ["&am © A"]
    assert texts("<article><p>one</p><svg><p>two</p></article><p>three</p>") == ["one", "two", "three"]
    assert texts("x <math><mi>y</mi></math> z 1 <object>inner</object> 2") == ["x y z 1 inner 2"]
    assert texts("super<wbr>cali<img src=a>fragil<br>istic") == ["supercalifragil istic"]
    assert texts("<p>a <select><option>b<option>c</select> d</p><template><p>e</p></template><noscript>f</noscript><p>g") == ["a", "d", "g"]
    assert texts("<div><p>a</p><select><option>b</div><p>c</p>") == ["a", "c"] and texts("<div>a<script>var b = '<p>';</div><p>c</p>") == ["a", "c"]
    assert texts("<textarea>a</textarea>b<title>c</title>d<p>&am<b>p;</b>") == ["b", "d", "&amp;"]
    b = pages.blocks('<nav class="top menu"><a href="/">home</a></nav><table><tr><td>1<td>2</table>')
    assert b[0].path == ("nav top menu",) or b[0].path == ("nav top menu", "a") and b[0].linked == 4
    assert [x.text for x in b[1:]] == ["1", "2"]


def test_pages_of_the_driver_give_their_articles(spark):
    """On the driver's pages the article element is the truth."""
    import html
    import os

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no driver tables here")
    df = spark.read.parquet(path)
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    for r in df.collect():
        own = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:h1|p)>", own)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)
    assert len(got) == df.count()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='<>/!-"\'= apdivscript&;\n', max_size=120))
def test_any_page_is_read(page):
    pages.blocks(page)


def test_labeller_on_unseen_layouts():
    w, reader = pages.weights(), pages.Reader()
    held = pages.training_pages(150, seed=4321)
    chances = pages.label([reader.page(b) for b, _ in held], w)
    right = np.concatenate([(c >= 0.5) == y for c, (_, y) in zip(chances, held, strict=True)])
    assert right.mean() > 0.97


def test_labels_do_not_depend_on_the_batch():
    w, reader = pages.weights(), pages.Reader()
    xs = [reader.page(b) for b, _ in pages.training_pages(30, seed=5)]
    both = pages.label(xs, w)
    for x, c in zip(xs, both, strict=True):
        assert np.allclose(pages.label([x], w)[0], c, atol=1e-4)


def test_extract(spark):
    article = "<article><h1>A title here</h1>" + "".join(f"<p>Paragraph {i} tells of the river, the bridge and the people who walked over it.</p>" for i in range(6)) + "</article>"
    html = f'<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now.</div>{article}<footer>&copy; site</footer></body></html>'
    df = spark.createDataFrame([(1, "u", html), (2, "v", None), (3, None, ""), (3, None, ""), (4, "w", "<p>" * 5000 + "x")], "page_id long, url string, html string").selectExpr("*", "'y' AS text")
    got = {r["page_id"]: r for r in pages.extract(df).collect()}
    assert got[1]["text"] == "\n".join(["A title here", *[f"Paragraph {i} tells of the river, the bridge and the people who walked over it." for i in range(6)]])
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == got[3]["text"] == "" and pages.extract(df).count() == 5
    assert pages.extract(df.limit(0)).count() == 0


# --- toxicity ----------------------------------------------------------------------------------
@pytest.mark.parametrize("frequent", [0.0, 0.06, 1.0])
def test_index_is_exact(frequent):
    rng = np.random.default_rng(3)
    x = rng.random((500, 40)) * (rng.random((500, 40)) < rng.random(40) ** 3)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    q = x[rng.permutation(500)[:60]] + 0
    q[::7] = 0
    q[::5] *= 0.5
    index = toxicity.Index.build(*np.nonzero(x), x[x > 0], 500, 40, 16, frequent)
    cos, example = index.nearest(*np.nonzero(q), q[q > 0], 60, 9)
    full = q @ x.T
    for i in range(len(q)):
        want = np.sort(full[i][full[i] > 0])[::-1][:9]
        assert np.allclose(cos[i][: len(want)], want, atol=3e-6) and (example[i][len(want) :] == -1).all()
        got = example[i][: len(want)]
        assert len(set(got.tolist())) == len(want) and np.allclose(full[i][got], cos[i][: len(want)], atol=3e-6)


def test_scores_equal_brute_force_over_all_terms(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)] + ["é" + str(i) for i in range(20)]
    texts = {d: " ".join(rng.choices(vocabulary, k=rng.randrange(8, 60)) + ["bad"] * (d % 4 == 0 and rng.randrange(3))) for d in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1, int(d % 4 == 0)) for d in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, toxicity.Toxic(per_label=40, block=8))
    ids = model.ids.tolist()
    assert {i for i in ids} <= {d for d in range(200) if zlib.crc32(str(d).encode()) % 5} and 40 < len(ids) <= 80
    count = {d: {w: t.split().count(w) for w in set(t.split())} for d, t in texts.items()}
    terms = sorted({w for d in ids for w in count[d]})
    n1, n0 = sum(d % 4 == 0 for d in ids), sum(d % 4 != 0 for d in ids)
    weight = {}
    for w in terms:
        a, b = sum(w in count[d] for d in ids if d % 4 == 0), sum(w in count[d] for d in ids if d % 4)
        df = sum(w in c for c in count.values())
        weight[w] = math.log(301 / (1 + df)) * max(0, abs(a * (n0 - b) - b * (n1 - a)) - (n1 + n0) / 2) ** 2 / ((a + b) * max(1, n1 + n0 - a - b) * n1 * n0)

    def vector(d):
        v = np.array([(1 + math.log(count[d][w])) * weight[w] if w in count[d] else 0 for w in terms])
        return v / max(1e-12, np.sqrt((v * v).sum()))

    assert len(model.vocabulary) == len(terms)
    x = np.array([vector(d) for d in ids])
    cos, example = model.nearest(pa.array([texts[d] for d in range(300)]))
    for d in range(300):
        full = x @ vector(d)
        want = np.sort(full)[::-1][: model.k]
        assert np.allclose(cos[d], np.where(want > 5e-7, want, 0), atol=2e-6)
        assert np.allclose(full[example[d][example[d] >= 0]], cos[d][example[d] >= 0], atol=2e-6)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for d in (0, 7, 250, 299):
        vote = model.votes(cos[d : d + 1], example[d : d + 1])[0]
        want = 1 / (1 + math.exp(-(model.curve[0] * vote + model.curve[1]))) if cos[d][0] > 0 else model.base
        assert abs(rows[d]["score"] - want) < 1e-9 and rows[d]["evidence"] == [ids[j] for j in example[d] if j >= 0]


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(6)
    calm, harsh = [f"calm{i}" for i in range(200)], ["rotten", "vile", "filthy", "awful", "wretch"]
    docs, labels = [], []
    for d in range(600):
        w = [rng.choice(calm) for _ in range(rng.randrange(5, 60))]
        y = int(rng.random() < 0.2)
        if y:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(harsh))
        docs.append((d, " ".join(w)))
        labels.append((d, y))
    df = spark.createDataFrame([*docs, (9000, None), (9001, ""), (None, "vile")], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS term")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (12345, 1)], "doc_id long, toxic int").selectExpr("*", "0 AS quality")
    got = {r["doc_id"]: r for r in toxicity.score(df, toxicity.fit(df, lab)).collect()}
    y = dict(labels)
    held = [d for d in y if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] == (d in set(held)) for d in y) and not got[None]["held_out"]
    assert np.mean([got[d]["predicted"] == y[d] for d in held]) > 0.97
    assert 0 <= got[9000]["score"] == got[9001]["score"] < 0.5 and all(0 <= r["score"] <= 1 for r in got.values())
    assert not any(e in held for d in y for e in got[d]["evidence"])
    empty = toxicity.score(df, toxicity.fit(df, lab.limit(0)))
    assert {r["score"] for r in empty.collect()} == {0.0}
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), lab)).count() == 0


# --- mixing ------------------------------------------------------------------------------------
def blank(*domains):
    return mixing.Classifier(list(domains), np.zeros((1, len(domains))), np.zeros(len(domains)))


def test_mix_meets_targets(spark, none):
    rng = random.Random(8)
    vocabulary = {k: [f"{k}{i}" for i in range(50)] for k in ("en", "fr", "de")}
    docs = [(i, " ".join(rng.choice(vocabulary[k]) for _ in range(rng.randrange(20, 200))), k) for i, k in enumerate(rng.choices(["en", "fr", "de"], [6, 3, 1], k=400))]
    df = spark.createDataFrame([*docs, (900, None, "en"), (901, "", None), (None, "en1 en2", "en")], "doc_id long, text string, lang string").selectExpr("*", "1 AS rate", "2 AS chances", "3 AS _rate", "4 AS domain")
    labels = spark.createDataFrame([(i,) for i in range(0, 400, 2)] + [(None,)], "doc_id long")
    target = {"en": 0.4, "fr": 0.4, "de": 0.2}
    for least in (0.0, 1.0):
        got = mixing.mix(df, labels, target, mixing.Mix(least=least)).collect()
        assert len(got) == 403
        total = sum(r["rate"] * r["n_tokens"] * np.array(r["chances"]) for r in got)
        assert np.allclose(total / total.sum(), [0.2, 0.4, 0.4], atol=2e-3)  # de, en, fr
        assert least or abs(total.sum() / sum(r["n_tokens"] for r in got) - 1) < 1e-3
        assert all(r["rate"] >= least for r in got) and all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in got)
        names = {i: k for i, _, k in docs}
        assert np.mean([r["domain"] == names[r["doc_id"]] for r in got if r["doc_id"] in names]) > 0.98
        rows = mixing.apply(df, labels, target, mixing.Mix(least=least))
        assert rows.columns == df.columns
        n = Counter(r["doc_id"] for r in rows.collect())
        assert n == {r["doc_id"]: r["copies"] for r in got if r["copies"]}
    assert mixing.mix(df, labels.limit(0), target).count() == 403
    assert mixing.mix(none, labels, {"en": 1.0}).count() == 0 and mixing.apply(none, labels, {"en": 1.0}).count() == 0


@pytest.mark.parametrize("shares", [(0.97, 0.01, 0.01, 0.01), (0.001, 0.997, 0.001, 0.001), (0.64, 0.08, 0.14, 0.14)])
@pytest.mark.parametrize("soft", [0.0, 0.1])
def test_mix_reaches_targets_of_scarce_domains(spark, shares, soft):
    domains = ["de", "en", "es", "fr"]
    rng = np.random.default_rng(3)
    rows = [(int(1e6 * s / 5), ((1 - soft) * np.eye(4)[i] + soft * rng.dirichlet([1] * 4)).tolist()) for i, s in enumerate(shares) for _ in range(5)]
    members = spark.createDataFrame(rows, "n_tokens long, chances array<double>")
    for p in (mixing.Mix(), mixing.Mix(least=1.0)):
        steps, now, target = mixing.fit_rates(members, {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}, blank(*domains), p)
        n, own = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        r = mixing.rates(own, steps, p.least)
        assert np.allclose((r * n) @ own, now) and (r >= p.least).all()
        assert np.abs(now - target).max() <= p.close * target.max()


def test_mix_reports_totals_off_their_targets(spark):
    members = spark.createDataFrame([(10, [0.5, 0.5]), (20, [0.5, 0.5])], "n_tokens long, chances array<double>")
    with pytest.warns(UserWarning, match="does not reach"):
        steps, now, _ = mixing.fit_rates(members, {"a": 0.9, "b": 0.1}, blank("a", "b"))
    assert np.isfinite(now).all() and now[0] == pytest.approx(now[1])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("target", [(0.5, 0.2, 0.3), (0.5, 0.0, 0.5), (0.98, 0.01, 0.01), (0.0, 0.0, 1.0)])
def test_totals_equal_plain_least_squares(seed, target):
    """Against projected gradient steps on the rates themselves, reachable targets or not."""
    rng = np.random.default_rng(seed)
    n, own = rng.integers(1, 500, 80).astype(float), rng.dirichlet([0.15 if seed % 2 else 1.0] * 3, 80)
    weight = np.array(target)
    z, now, goal = mixing.solve(lambda z: mixing.sums(n, own, z, 0.0), weight)
    r = mixing.rates(own, [z], 0.0)
    assert np.allclose((r * n) @ own, now) and goal.sum() == pytest.approx(n.sum())
    unit = np.maximum(goal, 1e-3 * goal.sum())
    a, x = (own * n[:, None]).T / np.sqrt(unit)[:, None], np.ones(80)
    step = 1 / np.linalg.norm(a, 2) ** 2
    y, t = x, 1.0
    for _ in range(60_000):
        x2 = np.maximum(0, y - step * a.T @ (a @ y - goal / np.sqrt(unit)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = x2 + (t - 1) / t2 * (x2 - x), x2, t2
    best = (((own * n[:, None]).T @ x - goal) ** 2 / unit).sum()
    assert ((now - goal) ** 2 / unit).sum() <= best + 1e-5 * goal.sum()


def test_mix_of_absent_and_unwanted_domains(spark):
    docs = [(i, ("en%d " % (i % 7)) * 20 if i % 2 else ("de%d " % (i % 5)) * 30, "en" if i % 2 else "de") for i in range(200)]
    df, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    with pytest.warns(UserWarning, match="no labelled document of xx"):
        rows = mixing.mix(df, labels, {"en": 0.25, "de": 0.25, "xx": 0.5}).collect()
    total = sum(r["rate"] * r["n_tokens"] * np.array(r["chances"]) for r in rows)  # de, en, xx
    assert np.allclose(total[:2] / total.sum(), 0.5, atol=0.01)
    rows = mixing.mix(df, labels, {"en": 1.0, "de": 0.0}).collect()
    assert sum(r["rate"] * r["n_tokens"] for r in rows if r["domain"] == "de") < 0.05 * sum(r["rate"] * r["n_tokens"] for r in rows)
    assert max(r["rate"] for r in rows) < 4
    with pytest.warns(UserWarning, match="does not reach"):  # no document goes, so there are "de" tokens left
        rows = mixing.mix(df, labels, {"en": 1.0, "de": 0.0}, mixing.Mix(least=1.0)).collect()
    assert min(r["rate"] for r in rows) == 1 and max(r["rate"] for r in rows) < 1.1


def test_rates_are_projected():
    p = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert mixing.rates(p, [np.array([3.0, -0.5]), np.array([-0.25, 0.0])], 0.0).tolist() == [0.25, 1.5]
