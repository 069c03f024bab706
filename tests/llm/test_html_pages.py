"""Main-text extraction on pages written and labelled by hand, in layouts that the training grammar does not make."""

import itertools
import time

import pytest

from metaloom.llm import dom, htmlcrf

#: (page, its main text)
PAGES = [
    (
        """<!doctype html><html lang="en"><head><title>River levels | The Valley Post</title><style>.x{color:red}</style></head><body>
<header><div class="brand"><a href="/">The Valley Post</a></div><nav><a href="/news">News</a> <a href="/sport">Sport</a> <a href="/about">About us</a></nav></header>
<main><article><h1>River levels fall after a week of rain</h1><p>The river fell by almost a metre on Tuesday, the council said, and most of the roads along the valley are open again.</p>
<p>Volunteers spent the night moving sandbags from the bridge to the school, where the water had come within a few steps of the door.</p>
<blockquote>We have not seen it this high since my father kept the mill, and I hope not to see it again.</blockquote></article></main>
<aside><h3>Most read</h3><ul><li><a href="/1">Cat returns after nine years</a></li><li><a href="/2">Bakery to close</a></li></ul></aside>
<footer><p>&copy; 2024 The Valley Post. All rights reserved.</p><a href="/privacy">Privacy</a> <a href="/terms">Terms</a></footer></body></html>""",
        """River levels fall after a week of rain
The river fell by almost a metre on Tuesday, the council said, and most of the roads along the valley are open again.
Volunteers spent the night moving sandbags from the bridge to the school, where the water had come within a few steps of the door.
We have not seen it this high since my father kept the mill, and I hope not to see it again.""",
    ),
    (
        """<html><body><div id="nav"><ul><li><a href="/">Start</a></li><li><a href="/b">Beiträge</a></li><li><a href="/k">Kontakt</a></li></ul></div>
<div id="cookie-banner" class="notice">We use cookies. <button>Accept</button></div>
<div id="content"><h2>Wie man einen Apfelbaum schneidet</h2><p>Im späten Winter, wenn der Frost vorbei ist, beginnt die Arbeit mit einer scharfen Säge und viel Geduld.</p>
<p>Zuerst nimmt man die toten Äste heraus, dann die, die sich kreuzen, und zuletzt k&uuml;rzt man die langen Triebe um ein Drittel.</p></div>
<div class="comments"><h4>3 Kommentare</h4><div class="comment"><b>Uwe</b>: Danke, das hat mir sehr geholfen!</div></div>
<div id="footer">Impressum | Datenschutz | <a href="/rss">RSS</a></div></body></html>""",
        """Wie man einen Apfelbaum schneidet
Im späten Winter, wenn der Frost vorbei ist, beginnt die Arbeit mit einer scharfen Säge und viel Geduld.
Zuerst nimmt man die toten Äste heraus, dann die, die sich kreuzen, und zuletzt kürzt man die langen Triebe um ein Drittel.""",
    ),
    (
        """<html><body><script>document.write("<p>not this</p>")</script><nav class="menu"><a href="#">Accueil</a><a href="#">Recettes</a><a href="#">Compte</a></nav>
<article><h1>La soupe au potiron</h1><p>Coupez le potiron en morceaux et faites-le revenir avec un oignon dans un peu de beurre, sans le laisser brunir.</p>
<p>Ajoutez le bouillon, laissez cuire une demi-heure à petit feu,<br>puis mixez le tout avec la crème &amp; une pincée de muscade.</p></article>
<form action="/newsletter"><label>Votre adresse</label><input name="mail"><button>S'abonner</button></form>
<div class="advert">Publicité : -50% sur les casseroles</div><footer>Mentions légales · Contact</footer></body></html>""",
        """La soupe au potiron
Coupez le potiron en morceaux et faites-le revenir avec un oignon dans un peu de beurre, sans le laisser brunir.
Ajoutez le bouillon, laissez cuire une demi-heure à petit feu, puis mixez le tout avec la crème & une pincée de muscade.""",
    ),
    (
        """<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/login">Log in</a></li></ul></nav><footer><p>Copyright 2023</p></footer></body></html>""",
        "",
    ),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_hand_labelled_pages(spark, k):
    page, want = PAGES[k]
    got = htmlcrf.extracted(spark.createDataFrame([(k, "u", page)], "page_id long, url string, html string")).first()
    assert got["text"] == want and got["n_chars"] == len(want)


def test_viterbi_against_all_labellings():
    """The decoded labels have the highest score of all labellings of a page's first blocks."""
    field = htmlcrf.default_field()
    for page, _ in PAGES:
        blocks = dom.blocks(page)[:10]
        scores = field.emissions(blocks)

        def total(labels, blocks=blocks, scores=scores):
            out = field.first * labels[0] + sum(s for s, y in zip(scores, labels, strict=True) if y)
            return out + sum(field.moves[int(b.chain[0] is a.chain[0])][x][y] for a, b, x, y in zip(blocks, blocks[1:], labels, labels[1:], strict=False))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=total)
        assert total([int(x) for x in field.decode(blocks)]) == pytest.approx(total(best))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>x y</p></article>", "x y"),
        ("<p>One plain paragraph, nothing else here.</p>", "One plain paragraph, nothing else here."),
        ("<html><body><p>Short.</p></body></html>", "Short."),
        ('<html><body><nav><a href="/">Home</a></nav><p>Rain fell today.</p></body></html>', "Rain fell today."),
        ('<nav><a href="/">Home</a></nav>', ""),
    ],
)
def test_short_pages_keep_their_text(page, want):
    assert htmlcrf.default_field().extract(page) == want


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "x", "<p><table>" * 100_000 + "z", "<section>" * 100_000 + "</nav>" * 100_000 + "x", "<b>" * 50_000 + "<div>x</div>y" * 50_000, "".join(f"<div class='k{i}'>t" for i in range(50_000))])
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    found = dom.blocks(page)
    htmlcrf.default_field().decode(found)
    assert found and time.process_time() - began < 30
