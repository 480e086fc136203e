"""Main text of hand-made pages of ten layouts, and the line measure against a plain loop."""

import math
import random

import pytest

from maskline.llm import html

ONE = "The river had been rising since the early morning, and nobody on the quay believed the forecast any more."
TWO = "By noon the first cellars were full, the ferry was tied up, and the school sent its children home on foot."
THREE = "What remained in the evening was a brown line on every wall, a hand above the windows of the old market."
BODY = f"<h1>Flood in town</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
WANT = f"Flood in town\n{ONE}\n{TWO}\n{THREE}"
MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
FOOT = "<footer><p>Imprint and contact</p></footer>"

LAYOUTS = {
    "state classes": f"{MENU}<div class='site no-sidebar'><div class='page has-sidebar'>{BODY}</div></div>{FOOT}",
    "one class of two words": f"{MENU}<div class='page-with-sidebar'>{BODY}</div>{FOOT}",
    "form around the page": f"<form action='/x'>{MENU}<div>{BODY}</div><input value='q'><button>Go</button>{FOOT}</form>",
    "name of a picture": f"{MENU}<div id='header-image-post'>{BODY}</div>{FOOT}",
    "comments allowed": f"{MENU}<div class='content-with-comments'>{BODY}</div>{FOOT}",
    "comments open": f"{MENU}<main class='comments-open'>{BODY}</main>{FOOT}",
    "header of the article": f"<header><p>The Town Paper</p></header>{MENU}<article><header><h1>Flood in town</h1></header><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></article>{FOOT}",
    "several articles": f"{MENU}<article><h1>Flood in town</h1><p>{ONE}</p></article><article><p>{TWO}</p><p>{THREE}</p></article>{FOOT}",
    "comments below": f"{MENU}<article>{BODY}</article><section class='comments-area'><h2>3 comments</h2><p>I was there and saw the water come over the steps.</p><p>Same here, dreadful.</p></section>{FOOT}",
    "sidebar and advert": f"{MENU}<div id='wrap'><div class='sidebar'><p>Most read: bridges, boats and other things.</p></div><div class='text'>{BODY}</div><div class='advert'>Buy boots today, two for one.</div></div>{FOOT}",
    "search form and newsletter": f"{MENU}<div><form><label>Search</label><p>Find a word</p></form>{BODY}<div class='newsletter-box'>Our letter, each week.</div></div>{FOOT}",
    "header class around all": f"<div class='header'>{MENU}<div>{BODY}</div></div>{FOOT}",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert html.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{LAYOUTS[name]}</body></html>") == WANT


def test_line_measure_equals_a_plain_loop():
    r = random.Random(5)
    for _ in range(200):
        lines = [("x" * r.randint(1, 300), r.randint(0, 9)) for _ in range(r.randint(1, 30))]
        out = [r.random() < 0.2 for _ in lines]
        ratio = [0.0 if o else len(t) / max(n, 1) for (t, n), o in zip(lines, out)]
        weight = {k: math.exp(-0.5 * (k / html.SIGMA) ** 2) for k in range(-html.RADIUS, html.RADIUS + 1)}
        level = [sum(w * ratio[i + k] for k, w in weight.items() if 0 <= i + k < len(ratio)) / sum(weight.values()) for i in range(len(ratio))]
        mean = sum(ratio) / len(ratio)
        bound = min(math.sqrt(sum((x - mean) ** 2 for x in ratio) / len(ratio)), max(level))
        got = html._content([(t, n) for t, n in lines], out)
        assert all(bool(g) == (x >= bound and q > 0) or abs(x - bound) < 1e-9 for g, x, q in zip(got, level, ratio))


def test_long_pages_and_markup():
    many = "".join(f"<p>{ONE} {i}</p>" for i in range(3000))
    assert html.main_text(f"<body>{MENU}<article>{many}</article></body>") == "\n".join(f"{ONE} {i}" for i in range(3000))
    assert html.main_text("<p>a &amp;&nbsp;b\t c<script>x</script></p>") == "a & b c"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == html.main_text("<!-- only -->") == ""
