"""The block labeller on broken, very long and hand-written pages."""

import time

import pytest

from fernwell.llm import html_blocks, html_extract

BROKEN = ["<a" * 10**5, "<" * 10**6, '<a ">"' * 10**5, "<a '>\"<b \">'" * 50_000, '<b "' * 10**5, "<div>x" * 40_000, "<b>" * 30_000 + "<p>x</p>" * 30_000, "<ul><li>" * 40_000, "</x>" * 10**5, "<!-" * 10**5, "<![CDATA[" * 10**5]


@pytest.mark.parametrize("n", range(len(BROKEN)))
def test_broken_pages_take_linear_time(n):
    began = time.time()
    html_blocks.blocks(BROKEN[n])
    assert time.time() - began < 15


def test_five_megabytes_in_slices(monkeypatch):
    labeller, features = html_extract.trained(), html_blocks.BlockFeatures()
    story = "".join(f"<p>Paragraph {i} of the story goes on, as they do, for a while.</p>" for i in range(70_000))
    page = f"<html><body><nav>{'<a href=x>Menu</a> ' * 20}</nav><article>{story}</article><footer>&copy; 2020 Someone</footer></body></html>"
    began = time.time()
    lines = html_extract.main_texts([page, "<p>Short.</p>"], labeller, features)[0].split("\n")
    assert len(lines) == 70_000 and lines[-1].startswith("Paragraph 69999") and time.time() - began < 60
    short = [html_blocks.blocks(f"<nav><a href=x>Menu</a></nav><article>{''.join(f'<p>Line {i}, and more.</p>' for i in range(n))}</article>") for n in (3, 40, 400)]
    whole = labeller.scores(short, features)
    monkeypatch.setattr(html_extract, "CELLS", 7)
    for a, b in zip(whole, labeller.scores(short, features)):
        assert abs(a - b).max() < 1e-4


#: Pages of other make than those that the labeller learns from, and their main text.
WRITTEN = [
    (
        """<!doctype html><html><head><title>Bread</title></head><body class="single"><header class="masthead"><a href="/">The Kitchen Table</a>
        <nav><a href="/a">Recipes</a> <a href="/b">About</a></nav></header><main><article><h1>A plain white loaf</h1>
        <p>Weigh the flour, add the salt and stir. The water should be warm, but not hot.</p><p>Knead for ten minutes; then leave it
        to rise under a cloth until it has doubled.</p></article></main><aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Rye bread</a></li></ul></aside>
        <footer><p>&copy; 2019 The Kitchen Table</p></footer></body></html>""",
        ["A plain white loaf", "Weigh the flour, add the salt and stir. The water should be warm, but not hot.", "Knead for ten minutes; then leave it to rise under a cloth until it has doubled."],
    ),
    (
        """<body><div id="cookie-notice">We use cookies. <button>Accept</button></div><div id="menu"><ul><li><a href=1>Home</a><li><a href=2>World</a><li><a href=3>Sport</a></ul></div>
        <div id="content"><h2>River level falls again</h2><p>The river fell by two feet on Monday, the council said, and the bridge will open later this week.
        <p>Residents were told to keep away from the banks until the engineers have finished their work.</div>
        <div id="comments"><h3>2 comments</h3><div class="comment">Great news!</div><div class="comment">About time.</div></div><form action=/search><input><label>Search</label></form></body>""",
        [
            "River level falls again",
            "The river fell by two feet on Monday, the council said, and the bridge will open later this week.",
            "Residents were told to keep away from the banks until the engineers have finished their work.",
        ],
    ),
]


@pytest.mark.parametrize("n", range(len(WRITTEN)))
def test_hand_written_pages(n):
    page, lines = WRITTEN[n]
    assert html_extract.main_texts([page], html_extract.trained(), html_blocks.BlockFeatures())[0].split("\n") == lines
