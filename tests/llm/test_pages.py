"""HTML extraction: blocks, the network and whole pages."""

import random

import numpy as np

from millrace.llm import html_text as H


def test_blocks_of_broken_markup():
    page = "<p>a &amp; b<p><b>c<br>d<script>var x='</p>'</script><ul><li>e<li><a href=x>f</a></ul><!-- g --><td>h<div hidden>i</div>&nbsp;j  k<p>l < m"
    blocks = H.blocks_of(page)
    assert [b.text for b in blocks] == ["a & b", "c d", "e", "f", "h", "i", "j k", "l < m"]
    assert blocks[3].link > 0.9 and "hidden" in blocks[5].names
    assert H.blocks_of(None) == [] and H.blocks_of("") == [] and H.blocks_of("<script>x") == []


def test_gradients():
    rng = np.random.default_rng(0)
    w, u, b = (rng.normal(0, 0.3, s).astype(np.float64) for s in ((H.INPUT, 4 * H.HIDDEN), (H.HIDDEN, 4 * H.HIDDEN), (4 * H.HIDDEN,)))
    x, mask = rng.normal(0, 1, (2, 3, H.INPUT)), np.array([[1, 1, 1], [1, 1, 0]], bool)
    loss = lambda: float(H._run(w, u, b, x, mask).astype(np.float64).sum())
    kept: list = []
    out = H._run(w, u, b, x, mask, kept)
    dw, du, db = H._back(w, u, x, mask, kept, np.ones_like(out))
    for a, g, at in ((w, dw, (3, 5)), (u, du, (2, 40)), (b, db, (20,))):
        old, step = a[at], 1e-2
        a[at] = old + step
        high = loss()
        a[at] = old - step
        low = loss()
        a[at] = old
        assert abs((high - low) / (2 * step) - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_network_on_unseen_pages():
    weights, slots = H.train(), H.Slots()
    made = [H.labelled_blocks(H.make_page(random.Random(10**9 + k))) for k in range(120)]
    found = H.probabilities(weights, [H.features(b, slots) for b, _ in made])
    right = [(p >= 0.5) == bool(y) for (_, ys), ps in zip(made, found) for y, p in zip(ys, ps)]
    assert np.mean(right) > 0.97


def test_whole_pages(spark):
    body = "".join(f"<p>Para {k} of the story, with some words in it &amp; more.</p>" for k in range(5))
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad>Buy this now.</div><article><h1>Head line</h1>{body}</article><footer>&copy; x</footer>"
    rows = [(1, "u", page, "clash"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", page, "x"), (1, "u", page, "x")]
    out = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = "Head line\n\n" + "\n\n".join(f"Para {k} of the story, with some words in it & more." for k in range(5))
    assert sorted((str(r.page_id), r.text) for r in out) == sorted([("1", want), ("1", want), ("None", want), ("2", ""), ("3", "")])
    assert all(r.n_chars == len(r.text) for r in out)
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_words_and_marks_of_long_blocks_count():
    block = lambda t: H.Block(t, ("body", "p"), (), 0.0)
    x = H.features([block("one " * 200), block("two " * 200), block("word " * 200 + "one, " * 50 + "end.")], H.Slots())
    words = slice(H.PATH_DIM, H.PATH_DIM + H.WORD_DIM)
    assert np.allclose(x[:, words].sum(1), 1, atol=1e-3) and not np.allclose(x[0, words], x[1, words])
    assert np.isclose(x[2, H.PATH_DIM + H.WORD_DIM + 4], 51 / 251, atol=1e-3)


def test_words_tell_a_plain_notice():
    story = "<p>" + "Berca dorel gifra hon injo kelu mernoor paqui rasenti unver, wo xiyor zacha thest. " * 4 + "</p>"
    notice = "<p>We use cookies on our website: please accept our privacy policy and cookie settings, so that you agree to your browser preferences and our partners.</p>"
    blocks = H.blocks_of(f"<html><body>{notice}<div class=article><h1>Berca dor</h1>{story * 4}</div></body></html>")
    (p,) = H.probabilities(H.train(), [H.features(blocks, H.Slots())])
    assert len(blocks[0].text.split()) > 12 and p[0] < 0.5 and (p[2:] > 0.5).all()


def test_formulas_and_fallbacks_are_kept():
    texts = lambda page: [b.text for b in H.blocks_of(page)]
    assert texts("<p>where <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> holds</p><p>b</p>") == ["where x = 1 2 holds", "b"]
    assert texts('<p>a <svg viewBox="0 0 1 1"/> b</p><p>c <math/> d</p><svg><path d="m"/><style/><title>i</title><text>t</text></svg><p>e') == ["a b", "c d", "t", "e"]
    assert texts("<p>a<noscript>b</noscript></p><object data=x><p>c</p></object><iframe src=y>d</iframe><template><p>e</p></template>") == ["ab", "c", "d", "e"]
    assert texts("<p>a <svg><g><text>b<p>c</p><div>d</div></svg>e") == ["a b", "c", "d", "e"]
    assert texts("<form><textarea>a</textarea><select><option>b</select></form><script>c</script><p>d") == ["d"]


def test_blocks_of_long_pages_take_time_in_proportion():
    made = {
        "unclosed": "<b>x" * 250_000, "nested": "<div>x" * 170_000, "quotes": '<a "' * 250_000, "options": "<option>x" * 110_000, "ends": "<b>" * 90_000 + "</i>" * 90_000 + "</b>y" * 90_000,
        "out of order": "<i class=q>" * 20_000 + "</b><p>x" * 60_000, "own tags": "".join(f"<t{i}>x" for i in range(100_000)), "graphics": "<svg><g>x" * 100_000,
    }
    import time

    for name, page in made.items():
        began = time.perf_counter()
        H.blocks_of(page)
        assert time.perf_counter() - began < 20, name


def test_paths_hold_what_is_open():
    blocks = H.blocks_of("<div class='side box'><ul><li>a<li>b</ul>c<b class=x>d</div><p>e</b>f<section hidden>g")
    seen = [(b.text, set(b.path), b.path[-1:], set(b.names)) for b in blocks]
    assert seen == [
        ("a", {"div", "ul", "li"}, ("li",), {"side", "box"}), ("b", {"div", "ul", "li"}, ("li",), {"side", "box"}), ("cd", {"div"}, ("div",), {"side", "box", "x"}),
        ("ef", {"p"}, ("p",), set()), ("g", {"section"}, ("section",), {"hidden"}),
    ]
