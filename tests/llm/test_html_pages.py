"""Pages written by hand, off the layouts that the field is trained on: short items, one paragraph, breaks, no tags, hidden blocks."""

import pytest

from tickforge.llm import html_extract
from tickforge.llm.common import load

SF = "/root/testdata/sf0.01"
LONG = "It was a long day for the people of the town, who had waited since the early morning."
PAGES = [
    ("<article><h1>Soup</h1><ul><li>2 eggs, beaten</li><li>Salt</ul><ol><li>Chop.<li>Stir for ten minutes.</ol></article>", "Soup|2 eggs, beaten|Salt|Chop.|Stir for ten minutes."),
    (f'<article><header><h1>Town</h1><p class="byline">By Ann</p></header><p>{LONG}</p><footer>Filed under news</footer></article>', f"Town|{LONG}"),
    (f"<h3>Hi</h3><div>{LONG}<br><br>{LONG}</div>", f"Hi|{LONG} {LONG}"),
    (LONG, LONG),
    ("Plain words only", "Plain words only"),
    (f"<body>{LONG}<br>{LONG}</body>", f"{LONG} {LONG}"),
    (f'<nav><a href=/>Start</a></nav><main><h1>T</h1><p>{LONG}</p></main><div class="responses"><p>I think that you are wrong about all of it, friend.</p></div>', f"T|{LONG}"),
    (f"<main><h1>T</h1><p>{LONG}</p><div hidden><p>Secret words that nobody can see on this page at all.</p></div><p>{LONG}</p></main>", f"T|{LONG}|{LONG}"),
    (f"<article><p>{LONG}</p></article>", LONG),
    ("<div class=nav><a>A</a><a>B</a></div><article><h2>Times</h2><table><tr><td>Mon</td><td>9-5</td></tr><tr><td>Tue</td><td>10-4</td></tr></table></article><footer>Imprint</footer>", "Times|Mon|9-5|Tue|10-4"),
    (f"<div id=page><div class=header><a>Logo</a></div><div class=entry><h1>T</h1>{LONG}<br><br>{LONG}</div><div class=footer>© me</div></div>", f"T|{LONG} {LONG}"),
    (f"<main><h1>Ask</h1><dl><dt>Why?</dt><dd>{LONG}</dd><dt>How?</dt><dd>So.</dd></dl></main><aside><p>{LONG}</p></aside>", f"Ask|Why?|{LONG}|How?|So."),
    ("<article><h1>Poem</h1><p>Roses<br>Violets</p><p>Sugar</p></article><div class=share-buttons>Tweet this</div>", "Poem|Roses Violets|Sugar"),
]


@pytest.fixture(scope="module")
def field(spark):
    return html_extract.fit(load(spark, SF, "pages"))


@pytest.mark.parametrize("page,want", PAGES)
def test_worked_pages(field, page, want):
    assert html_extract.main_text(page, field) == want.replace("|", "\n\n")


def test_every_composed_layout_is_learnt(field):
    for page in html_extract.composed():
        found = html_extract.blocks(page)
        want = [t.startswith("+") for _, t in found]
        assert [bool(y) for y in field.decode([fs for fs, _ in found])] == want, page
