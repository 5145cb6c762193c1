"""Quality rules, toxicity, page text, TIFF files and licence scans."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import html, licenses, media, quality, toxicity

ODD = [None, "", " \n\t", "one", "a b c a b c a b c", "x\nx\n\nx \nx", "!!! ### |", "WORD " * 80, "word " * 5000, "é 你 \U0001f600"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", True, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, kept string, toxic boolean, p_toxic double")


def plain_repeats(words):
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for found in windows.values() if len(found) > 1 for i in found for k in range(3)})


def test_quality(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("the of and tion a".split()) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    rows = {r["doc_id"]: r for r in quality.judge(docs(spark, texts), sample_rows=20).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == plain_repeats(words)
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
        assert r["kept"] == (not r["base_failed"] and not any(rule.rejects(quality.View(text)) for rule in quality.RULES))
    assert quality.judge(docs(spark, texts).limit(0)).count() == 0
    kept = quality.keep_good(docs(spark, texts), min_words=3, sample_rows=5)
    assert kept.columns == ["doc_id", "text", "kept", "toxic", "p_toxic"]


def test_cascade_orders_by_rejections_per_cost():
    figures = [("symbols", 1.0, 0.5), ("upper_case", 0.1, 0.2), ("letters", 1.0, 0.0)]
    assert [r.name for r in quality.ordered(figures)][:2] == ["upper_case", "symbols"]


def labelled(rng, n):
    clean, bad = "the of and tion thing word other ever".split(), ["vile", "loweiant", "loweibru", "awful"]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(10, 60))]
        toxic, junk = rng.random() < 0.15, rng.random() < 0.2
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        if junk:
            words = [w.upper() + " junkmark" for w in words]
        texts.append(" ".join(words))
        labels.append((i, int(junk), int(toxic)))
    return texts, labels


def test_toxicity_on_held_out_texts(spark):
    texts, labels = labelled(random.Random(2), 900)
    table = spark.createDataFrame([(*x, "clash") for x in labels[:600]] + [(3000, None, 1, "x")], "doc_id long, low_quality int, toxic int, text string")
    found = toxicity.toxicity(docs(spark, texts + ODD), table, ("low_quality", "toxic"), train_rows=500)
    assert found.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"]
    rows = {r["doc_id"]: r for r in found.collect()}
    held = labels[600:]
    assert sum(rows[i]["toxic"] == bool(t) for i, _, t in held) >= 0.99 * len(held)
    assert sum((rows[i]["p_low_quality"] > 0.5) == bool(q) for i, q, _ in held) >= 0.99 * len(held)
    assert not rows[900]["toxic"] and not rows[901]["toxic"]
    kept = {r["doc_id"] for r in toxicity.keep_civil(docs(spark, texts), table, train_rows=500).collect()}
    assert kept == {i for i in range(900) if not rows[i]["toxic"]}
    assert toxicity.toxicity(docs(spark, texts).limit(0), table.limit(0)).count() == 0


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(1)
    features = [[int(x)] for x in rng.integers(0, 40, 2000)]
    first = np.array([f[0] < 20 for f in features], float)
    models = toxicity.fit_chain(features, np.column_stack([first, first])).models
    assert len(models[0].chain) == 0 and models[1].chain[0] > 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">Cookies</div><aside>Side</aside>
<article class="post has-sidebar"><h1>The &amp;amp; title</h1><p>One  two<br>three <b>bo<i>ld</i></b>.<p>Unclosed &lt;b&gt; &eacute; &#233;
<ul><li>first<li>second</ul><div class="share-buttons">Share</div><form><input>Ask</form><table><tr><td>a<td>b</table>
<section id="comments"><p>Nice!</p></section><!-- <p>no</p> --></article><footer>&copy; end</footer></body></html>"""


def test_page_text():
    assert html.extract_text(PAGE) == "The &amp; title\nOne two three bold.\nUnclosed <b> é é\nfirst\nsecond\na\nb"
    assert html.extract_text("") == "" and html.extract_text("<article></article>") == ""
    assert html.extract_text("plain &amp text < 3") == "plain & text < 3"
    assert html.extract_text("<p>a<p>b<script>x") == "a\nb"
    assert html.extract_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert html.extract_text('<main><p title="a>b">x</p></main><p>out</p>') == "x"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pab\"'= &;!-\n", max_size=80))
def test_any_text_is_some_page(text):
    html.extract_text(text)
    html.subtrees(text)


def test_templates(spark):
    rows = [(i, f"http://A.example/{i}", f"<div class='x'><p>Welcome to this site</p></div><div><p>Own text {i}</p></div>") for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", "<article><p>Same article</p><div>Box</div></article>") for i in range(20)]
    rows += [(200 + i, f"http://c.example/{i}", f"<article><p>Shared passage</p><div>Box</div><p>Own {i}</p></article>") for i in range(20)]
    rows += [(300, None, None), (301, "", ""), (302, "x", "<p>alone</p>"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert all(got[i]["text"] == f"Own text {i}" for i in range(20))
    # Copies of one article are no evidence; a passage that articles share stays, a box that they share goes.
    assert all(got[100 + i]["text"] == "Same article\nBox" for i in range(20))
    assert all(got[200 + i]["text"] == f"Shared passage\nOwn {i}" for i in range(20))
    assert got[300]["text"] == got[301]["text"] == "" and got[302]["text"] == "alone"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and html.extract(pages).count() == len(rows)
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("compression", [media.PLAIN, media.LZW, media.ADOBE_DEFLATE, media.DEFLATE, media.PACKBITS])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trips(compression, order):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 4, (37, 53), dtype=np.uint8), rng.integers(0, 60_000, (20, 33, 3), dtype=np.uint16), rng.random((9, 17)).astype(np.float32), rng.integers(-9, 9, (5, 4), dtype=np.int32), np.zeros((90, 70), np.uint8)]
    for tile in (None, (16, 32)):
        for predictor in (1, 2, 3):
            pages = [p for p in images if (p.dtype.kind == "f") == (predictor == 3) or predictor == 1]
            data = media.write_pages(pages, compression=compression, predictor=predictor, strip_rows=8, tile=tile, order=order)
            found = list(media.read_pages(data))
            assert len(found) == len(pages)
            for page, image in zip(found, pages, strict=True):
                assert page.compression == compression
                assert (page.pixels.reshape(image.shape) == image).all()


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.text("ab", max_size=3000).map(str.encode)))
def test_codecs(data):
    assert media.lzw_decode(media.lzw_encode(data)) == data
    assert media.packbits_decode(media.packbits_encode(data)) == data


def test_long_lzw():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert media.lzw_decode(media.lzw_encode(data)) == data


def test_text_media(spark):
    texts = ODD + ["x" * 576, "y" * 577, "z" * (576 * 4096 + 1)]
    rows = {r["doc_id"]: r for r in media.text_media(docs(spark, texts)).collect()}
    files = {r["doc_id"]: r for r in media.stored(docs(spark, texts), compression=media.PACKBITS).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert b"".join(p.pixels.tobytes() for p in media.read_pages(bytes(files[i]["media"]))) == payload
    assert rows[0]["feature"] == rows[1]["feature"] and rows[len(texts) - 1]["n_pages"] == 2
    broken = spark.createDataFrame([(1, b"II*\0"), (2, b"no"), (3, None), (4, bytes(files[3]["media"])[:-9])], "doc_id long, media binary")
    found = media.pages(broken).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 4} and all(r["error"] for r in found)
    assert media.pages(media.stored(docs(spark, texts))).count() == len(texts) + 1


def test_licenses(spark):
    notice = licenses.TEMPLATES[2][1]
    files = [
        (1, "LICENSE", notice), (2, "src/a.py", "# nothing\ncode"), (3, "src/b.py", "x\n# Licensed under the Apache License, Version 2.0.\ny"), (4, "lib/COPYING.txt", licenses.TEMPLATES[6][1]), (5, "lib/deep/er/c.py", None),
        (6, "libx/c.py", ""), (7, "lib/deep/LICENSE", "no licence at all, copyright somebody"), (8, "lib/d.py", "Copyright by me, all words unlike"), (9, None, "Released under the MIT License."), (2, "src/a.py", "# nothing\ncode"),
    ]
    table = spark.createDataFrame([(*f, "clash", True) for f in files], "doc_id long, path string, text string, license string, whole boolean")
    rows = licenses.scan(table).collect()
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in rows}
    assert len(rows) == len(files)
    assert got == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", ""), 3: ("Apache-2.0", "own", None), 4: ("GPL-3.0", "own", None), 5: ("GPL-3.0", "inherited", "lib"),
        6: ("MIT", "inherited", ""), 7: ("GPL-3.0", "inherited", "lib"), 8: ("GPL-3.0", "inherited", "lib"), 9: ("MIT", "own", None),
    }
    assert licenses.scan(table.limit(0)).count() == 0


def test_thresholds():
    p, y = np.array([0.05, 0.1, 0.2, 0.4, 0.9]), np.array([0, 0, 0, 1, 1])
    assert 0.2 < toxicity.best_threshold(p, y) <= 0.4
    assert toxicity.best_threshold(p, np.zeros(5)) == 0.5
    assert toxicity.best_threshold(np.array([0.01, 0.02, 0.95, 0.97]), np.array([0, 0, 1, 1])) <= 0.5
