import itertools

import numpy as np
import pytest

from cratewise.llm import crf
from cratewise.llm.dom import blocks
from cratewise.llm.labelled import labelled_pages


@pytest.fixture(scope="module")
def model():
    return crf.train(labelled_pages())


def test_blocks():
    html = "<title>t</title><p>One &amp; <b>two<br>three<p>four<!-- x --><script>'</p>'</script><ul class='Menu-Items'><li><a href=x>five</a><li>6&nbsp;\n 7</ul>eight <"
    got = blocks(html)
    assert [b.text for b in got] == ["One & two three", "four", "five", "6 7", "eight <"]
    assert got[2].linked == 4 and got[2].words == {"menu", "item"} and got[0].tags == ("p", "b")
    assert blocks("") == [] and blocks("plain")[0].text == "plain" and blocks("<p") == [] and blocks("<div><p>a</span></div></p>b")[1].text == "b"


def test_nothing_is_swallowed():
    """Self-closing, unclosed and closed foreign elements leave the page and their own text whole."""
    said = lambda html: " ".join(b.text for b in blocks(html))
    for tag in ("svg", "math"):
        assert said(f"<p>one <{tag}/> two</p><p>three <{tag}></{tag}> four</p>") == "one two three four"
        assert said(f"<p>one</p><{tag} class=x /><p>two</p>") == "one two"
    for tag in ("svg", "math", "template", "noscript", "iframe", "textarea", "xmp", "noembed", "noframes", "script", "style", "title"):
        assert said(f"<p>one</p><{tag}><p>two</p>") == "one two"
    for tag in ("math", "xmp", "noembed", "noscript"):
        assert said(f"<p>one <{tag}>kept</{tag}> two</p>") == "one kept two"
    assert said("<p>one<script>var x = '<p>no</p>'</script><style>p {}</style> two</p>") == "one two"


def test_viterbi_is_the_best_path(model):
    for html, _ in labelled_pages(20, 5):
        page = blocks(html)[:9]
        scores = [[sum(model.weights.get(f, (0.0, 0.0))[s] for f in names) for s in (0, 1)] for names in crf.features(page)]

        def value(path):
            return sum(scores[t][s] for t, s in enumerate(path)) + sum(model.steps[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=len(page)), key=value)
        assert value([int(x) for x in model.decode(page)]) == pytest.approx(value(best))


def test_held_out_pages(model):
    right = wrong = 0
    for html, labels in labelled_pages(150, 77):
        said = model.decode(blocks(html))
        right += sum(a == b for a, b in zip(said, labels))
        wrong += sum(a != b for a, b in zip(said, labels))
    assert wrong < 0.01 * (right + wrong)


def test_pages(spark, shared, model):
    article = "<h1>Head</h1><p>First para of it, long enough to be read. And more.</p><p><b>Open<br><p>Last one here.</p>"
    page = f"<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy this now.</div><article>{article}</article><section id='comments'><p>A reader wrote this.</p></section><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (3, "v", ""), (None, "w", page), (4, "x", f"<article><p>{'long text. ' * 60_000}</p></article>")]
    frame = spark.createDataFrame([(*r, 0, "z") for r in rows], "page_id bigint, url string, html string, n_chars int, text string")
    got = {(r["page_id"], r["url"]): r for r in crf.extract(frame, model).collect()}
    want = "Head\nFirst para of it, long enough to be read. And more.\nOpen\nLast one here."
    assert got[1, "u"]["text"] == want and got[None, "w"]["text"] == want and got[1, "u"]["n_chars"] == len(want)
    assert got[2, None]["text"] == "" and got[3, "v"]["n_chars"] == 0 and len(crf.extract(frame, model).collect()) == 6
    assert got[4, "x"]["text"] == ("long text. " * 60_000).strip()
    assert crf.extract(frame.limit(0), model).collect() == []


def test_gradient_is_exact(monkeypatch):
    """The likelihood of the labels rises to nearly 1 on pages that the features tell apart."""
    monkeypatch.setattr(crf, "STEPS", 60)
    pages = labelled_pages(60, 3)
    model = crf.train(pages)
    assert np.mean([model.decode(blocks(h)) == labels for h, labels in pages]) > 0.9


HEAD, PARTS = "A heading of it", ["The first paragraph says something. It has a second sentence too.", "Another paragraph follows here, of some length. It goes on a bit.", "And the last one ends the text. That was all."]
ARTICLE = f"<h1>{HEAD}</h1>" + "".join(f"<p>{p}</p>" for p in PARTS)
NAV, FOOT = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>", "<footer>&copy; 2024 Someone</footer>"
BY_HAND = {
    "article": NAV + f"<article>{ARTICLE}</article>" + FOOT,
    "generated name": NAV + f'<div class="css-1x2y">{ARTICLE}</div>' + FOOT,
    "div": NAV + f"<div>{ARTICLE}</div>" + FOOT,
    "root": f'<div id="root"><div class="wrap">{NAV}{ARTICLE}{FOOT}</div></div>',
    "body": NAV + ARTICLE + FOOT,
    "heading in a header": NAV + f"<article><header><h1>{HEAD}</h1></header>{ARTICLE[ARTICLE.index('</h1>') + 5 :]}</article>" + FOOT,
    "generated names": f'<div class="x9"><div class="k2"><a href=/>Home</a> <a href=/s>Shop</a></div></div><div class="q7"><div class="r1">{ARTICLE}</div></div><div class="z3"><a href=/t>Terms of use</a></div>',
    "layout table": f"<table><tr><td><a href=/>Home</a></td><td><a href=/b>News</a></td></tr><tr><td colspan=2>{ARTICLE}</td></tr></table>",
}


@pytest.mark.parametrize("name", BY_HAND)
def test_pages_written_by_hand(model, name):
    """No article is lost for want of a telling container; these pages do not come from the maker."""
    assert crf.main_text(f"<html><body>{BY_HAND[name]}</body></html>", model) == "\n".join([HEAD, *PARTS])


def test_text_with_line_breaks(model):
    text = "<br><br>".join(PARTS)
    assert crf.main_text(f"<html><body>{NAV}{text}{FOOT}</body></html>", model) == " ".join(PARTS)
    assert crf.main_text(f"<html><body><div class='hdr-2'><a href=/>Home</a></div><h1>{HEAD}</h1>{text}</body></html>", model) == HEAD + "\n" + " ".join(PARTS)


@pytest.mark.parametrize("piece", ["<div>x", "<font>x<p>y", '<span class="a b c">x<li>y', "</b>x<p>", "<x-1>y<div>"])
def test_deep_pages_take_linear_time(model, piece):
    import time

    begin = time.perf_counter()
    text = crf.main_text(piece * 20_000, model)
    assert time.perf_counter() - begin < 15 and set(text) <= set("xy \n")
