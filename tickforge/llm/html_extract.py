"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the document tree.

A block is the text between two block-level tags. Its features are its ancestors' tags, the kinds of words in their class, id and
role, its text's length, punctuation and links, those of its neighbours, and the prose around it. The field is trained on labelled pages:
layouts written out below, and a bounded sample of the given pages, which their own <article> or <main> elements label, each with and
without these elements. Viterbi decoding tells main text from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import prepare, sampled

#: Pages of the table, about, that the field is trained on beside the written layouts.
SAMPLE_PAGES = 120
STEPS, RATE, RIDGE = 150, 0.15, 1e-3

# Element names of the HTML standard, by their role here.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is skipped whole; svg and math may be empty.
SKIPPED = frozenset("script style noscript template textarea select svg math iframe object title".split())
#: An element on the left ends at the opening of one on the right.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
#: Words of class, id and role, by what they tell.
WORDS = {
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner",
    "side": "sidebar side aside widget related recommended popular trending complementary",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager",
    "foot": "footer foot copyright legal contentinfo",
    "head": "header masthead topbar logo brand",
    "comment": "comment comments reply replies response responses discussion disqus respond feedback",
    "notice": "cookie cookies consent notice alert modal popup newsletter subscribe signup gdpr",
    "share": "share social follow tags meta byline",
    "main": "article content main post entry story body text",
}
_KIND = {w: kind for kind, words in WORDS.items() for w in words.split()}
#: A start tag from its name on: a quote opens a value only after =, and one that doesn't close is an ordinary character.
_REST = re.compile(r"([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in SKIPPED}
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_BLANK = re.compile(r"\s+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Kind (text, open, close, break), text or tag name, and attributes, in one pass: what was read isn't read again, however broken the page.

    An unclosed comment or skipped element lasts to the end of the page, as in browsers. Where no tag can end by the rule for quotes any more
    (that is found out once), tags end at the next >; a < without any > after it is text.
    """
    at, size, last, strict = 0, len(page), page.rfind(">"), True
    while at < size:
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            yield "text", page[at:], ""
            return
        if begin > at:
            yield "text", page[at:begin], ""
        follows = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
        elif follows == "!" or follows == "?":
            at = page.find(">", begin) + 1
        elif follows == "/":
            at = page.find(">", begin) + 1
            name = page[begin + 2 : at - 1].split(None, 1)
            yield "close", (name[0] if name else "").rstrip("/").lower(), ""
        elif follows.isascii() and follows.isalpha():
            m = _REST.match(page, begin + 1) if strict else None
            if m:
                name, attributes, at = m[1].lower(), m[2], m.end()
            else:
                strict = False
                at = page.find(">", begin) + 1
                name, _, attributes = page[begin + 1 : at - 1].partition(" ")
                name = name.split("/")[0].split()[0].lower()
            if name in SKIPPED:
                if not (name in ("svg", "math") and attributes.endswith("/")):
                    end = _END[name].search(page, at)
                    at = end.end() if end else size
                yield "break", name, ""
            else:
                yield "open", name, attributes
        else:
            yield "text", "<", ""
            at = begin + 1


def blocks(page: str) -> list[tuple[list[str], str]]:
    """Features and text of each leaf block in page order; character references decoded, white space turned to single spaces."""
    stack: list[tuple[str, tuple[str, ...], int]] = []
    found: list[tuple[tuple[str, ...], str, int, int]] = []
    text: list[str] = []
    held: Counter = Counter()  # elements that are open, by tag
    linked = in_link = opened = 0

    def path() -> tuple[str, ...]:
        return stack[-1][1] if stack else ()

    def flush() -> None:
        nonlocal linked
        whole = _BLANK.sub(" ", html.unescape("".join(text))).strip()
        if whole:
            found.append(((f"own:{stack[-1][0] if stack else '-'}", *path()), whole, linked, stack[-2][2] if len(stack) > 1 else 0))
        text.clear()
        linked = 0

    for kind, tag, attributes in tokens(page):
        if kind == "text":
            text.append(tag)
            linked += len(tag) if in_link else 0
        elif kind == "break":
            continue
        elif tag in ("br", "wbr", "img"):
            text.append(" " if tag == "br" else "")
        elif tag in INLINE:
            in_link = int(kind == "open") if tag == "a" else in_link
        elif kind == "close":
            flush()
            while held[tag]:
                gone = stack.pop()[0]
                held[gone] -= 1
                if gone == tag:
                    break
        elif tag not in VOID and tag not in ("html", "body"):
            flush()
            in_link = 0
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                held[stack.pop()[0]] -= 1
            kinds = {f"kind:{_KIND[w]}" for x in _NAMED.findall(attributes) for w in re.split(r"[^a-z]+", x.lower()) if w in _KIND}
            if _HIDDEN.search(attributes):
                kinds.add("kind:hidden")
            opened += 1
            held[tag] += 1
            stack.append((tag, path() + tuple(x for x in (f"tag:{tag}", *sorted(kinds)) if x not in path()), opened))
        else:
            flush()
    flush()
    return [(fs, t) for fs, (_, t, _, _) in zip(features(found), found)]


def features(found: list[tuple[tuple[str, ...], str, int, int]]) -> list[list[str]]:
    """Of each block (path, text, characters in links, parent): its ancestors, its text, what its neighbours' texts are like, and how much prose its parent has."""
    shapes, prose = [], Counter()
    for _, t, linked, parent in found:
        words, links = t.count(" ") + 1, min(3, 4 * linked // max(1, len(t)))
        shapes.append((min(6, words.bit_length()), links, t[-1] in ".!?"))
        prose[parent] += words >= 8 and links == 0 and shapes[-1][2]
    out = []
    for k, (path, t, _, parent) in enumerate(found):
        words, links, stop = shapes[k]
        fs = ["bias", *path, f"blocks:{min(5, len(found).bit_length())}", f"words:{words}", f"links:{links}", f"stop:{stop}", f"sign:{'©' in t or '|' in t}", f"prose:{min(3, prose[parent])}"]
        for name, at in (("before", k - 1), ("after", k + 1)):
            if 0 <= at < len(found):
                fs += [f"{name}:{'long' if shapes[at][0] >= 4 else 'short'}:{shapes[at][1]}", f"{name}:{'same' if found[at][3] == parent else 'other'}"]
            else:
                fs.append(f"{name}:none")
        out.append(fs)
    return out


# The written layouts: blocks that start with "+" are main text, all others aren't.
_P = "+Some sentences of the story follow here, and they go on for quite a while, as a paragraph does."
LAYOUTS = [
    f"<header><h1>-Site name</h1><nav><a>-Home</a> <a>News</a></nav></header><main><article><h1>+Headline of the page</h1><p>{_P}</p><p>{_P}<p>+Short one.</article></main><footer>-© 2024 Site. All rights reserved.</footer>",
    f"<nav><ul><li><a>-One</a></li><li><a>-Two</a></li></ul></nav><div class=ad>-Buy this thing now, it is on sale today.</div><article><h1>+Headline</h1><p>{_P}</p><ul><li>+A point of the list.</li><li>+Another point.</li></ul><p>{_P}</p></article><footer>-© Site · Terms and conditions apply.</footer>",
    f"<div id=header>-Site</div><div class=menu><a>-Home</a></div><div id=content><h2>+A headline</h2><p>{_P}</p><blockquote>+A quotation from someone else.</blockquote><p>{_P}</p></div><div class=sidebar><h3>-Related</h3><p>-See also this other long story that we wrote about before.</p></div><div id=footer>-Copyright Site</div>",
    f"<div class='cookie-notice'>-We use cookies to make this site better for you. Accept them.</div><article class=post><h1>+Title</h1><p>{_P}</p><div class='share'>-Share on</div><p>{_P}</p></article><section class=comments><h2>-Comments</h2><div class=comment><p>-I do not agree with what this story says, not at all.</p></div></section>",
    f"<article><h1>+Title</h1><p>{_P}</p><aside>-A box beside the story, which isn't part of it.</aside><p>{_P}</p><div class='ad'>-An advert in the middle of things.</div><p>{_P}</p><section id=comments><p>-First! What a very nice story that was.</p><p>-A reader says something long here too.</p></section></article>",
    f"<nav>-Menu</nav><div class=breadcrumb><a>-Home</a> / <a>Blog</a></div><section class='entry-content'><p>{_P}</p><h2>+A subheading</h2><p>{_P}</p><table><tr><td>+Cell one</td><td>+Cell two</td></tr></table><pre>+code = here</pre></section><form><label>-Your name</label><p>-Sign up for our newsletter, it is sent weekly.</p><button>-Send</button></form><footer><p>-About us and other matters of this site.</p></footer>",
    f"<main><header><h1>+Title of the text</h1></header><p>{_P}</p><figure><figcaption>+A caption of the picture.</figcaption></figure><p>{_P}</p><footer>-Tags and the like</footer></main><aside><h2>-Popular</h2><ul><li><a>-Another story</a></li></ul></aside>",
    f"<div class=topbar>-Log in</div><div class='post-body'><p>{_P}</p><p>{_P}</p><p>+Yes.</p><p>{_P}</p></div><div class='related'><p>-You may also like what we wrote on this last week.</p></div><div class=disqus><p>-Reader: I liked it very much, thanks for it.</p></div><div class=legal>-Terms</div>",
    f"<div><ul><li><a>-Home</a></li><li><a>-Contact</a></li></ul></div><div class=wrap><h1>+Headline</h1><p>{_P}</p><p>{_P}</p><p>+Short one.</p></div><div><p>-© 2023 A company | All rights reserved</p></div>",
    f"<div><div><a>-Start</a> <a>Blog</a> <a>Shop</a></div><div><div><h1>+Headline</h1><p>{_P}</p><h2>+A part</h2><p>{_P}</p><ul><li>+A point of the list.</li></ul><p>{_P}</p></div><div><h3>-More</h3><ul><li><a>-Another story of ours</a></li><li><a>-A third one</a></li></ul></div></div><div>-© A company</div></div>",
    f"<div class=wrap><h1>+Title</h1><p>{_P}</p></div>",
    f"<div><p>{_P}</p></div>",
    "<div><p>+A page may have a single paragraph only, like this.</p></div>",
    "<nav><a>-Home</a></nav><div class=ad>-Buy now!</div><article><h1>+A title</h1><p>+One line.</p><p>+Two.</p></article><div class=comments><p>-A reader says yes.</p></div><footer>-© us</footer>",
    f"<article><h1>+Title</h1><p>{_P}</p><p>+It ends.</p></article><section id=comments><h3>-3 comments</h3><p>-I liked it.</p><p>-Me too, and I have more to say about all of this today.</p></section><div class='newsletter'><p>-Get our letter each week.</p></div>",
    f"<p>{_P}</p><p>{_P}</p>",
    f"<h1>+Title</h1><p>{_P}</p><p>{_P}</p><hr><p><a>-Imprint</a></p>",
    f"<header><p>-A site about many things, with a slogan.</p></header><div class='promo banner'><p>-Subscribe now and get a month for free, really.</p></div><div id=main><h1>+Heading</h1><p>{_P}</p><dl><dt>+Term</dt><dd>+What it means.</dd></dl><p>{_P}</p></div><div role=complementary>-Side matter of no interest to the text.</div><div role=contentinfo>-Imprint</div>",
]

#: Bodies of articles, what they stand in, and what stands around them; each goes with each (composed()).
BODIES = [
    f"<h1>+Headline</h1><p>{_P}</p><p>+Short one.</p><p>{_P}</p>",
    "<h1>+Pancakes</h1><ul><li>+2 eggs</li><li>+A cup of flour</li><li>+Salt</li></ul><ol><li>+Mix.</li><li>+Let it rest for an hour, then fry it on both sides.</li></ol>",
    f"<header><h1>+A headline</h1><p class=byline>-By a writer</p></header><p>{_P}</p><footer>-Filed under things</footer>",
    f"<h2>+Prices</h2><table><tr><th>+Thing</th><th>+Price</th></tr><tr><td>+Tea</td><td>+2.50</td></tr><tr><td>+Milk</td><td>+1.20</td></tr></table><p>{_P}</p>",
    f"+Some sentences of the story stand here without any tags.<br><br>They go on after a break, for a good while, as text does.<p>{_P}</p>",
    "<h1>+News</h1><div>+It happened today.<br>Nobody was hurt, it was said.<br><br>More is to follow tomorrow.</div>",
    "<dl><dt>+Word</dt><dd>+What it means.</dd><dt>+Another</dt><dd>+It means something else.</dd></dl>",
    f"<h1>+One paragraph</h1><p>{_P}</p>",
    f"<h1>+Title</h1><p>{_P}</p><div hidden><p>-Some words that nobody can see on this page, kept for later use.</p></div><p>{_P}</p><div aria-hidden=true>-An icon</div><p>+End.</p>",
    f"<section><h2>+Part one</h2><p>{_P}</p></section><section><h2>+Part two</h2><p>+Brief.</p><pre>+x = 1</pre><blockquote>+As someone said.</blockquote></section>",
]
PLACES = ["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<div class=post-body>{}</div>", "<div>{}</div>"]
AROUND = [
    "{}",
    "<nav><ul><li><a>-Home</a></li><li><a>-About</a></li></ul></nav>{}<footer><p>-© 2024 A company. All rights reserved.</p></footer>",
    "<div class=menu><a>-Home</a> | <a>News</a></div>{}<div class=sidebar><h3>-Related</h3><p>-See also this other story, which is long and was written before.</p></div><div class=legal>-Terms</div>",
    "<header>-A site</header><div hidden>-This is not to be seen by anyone, it is a template.</div>{}<section class=responses><p>-I read this twice and I still don't agree with it.</p><p>-Nice!</p></section>",
    "{}<aside><p>-Some words of another story stand here, and they go on for quite a while too.</p></aside><footer>-Imprint</footer>",
    "<div style='display:none'>-Preview text for mail readers that nobody sees on the page.</div><div class='cookie banner'>-We use cookies. Accept?</div>{}<form><label>-Mail</label><button>-Send</button></form>",
]


def composed() -> list[str]:
    """Every body in every place with every surrounding; and text without any tags."""
    pages = [around.format(place.format(body)) for body in BODIES for place in PLACES for around in AROUND]
    return [*pages, "+Only text, no tags.", "+Only text, no tags, though it is rather longer than the other one and has two sentences. This is the second one."]


def _by_own_element(fs: list[str]) -> bool:
    """Main text by the page's own account: in <article> or <main>, and in nothing that is set apart within."""
    apart = {"tag:nav", "tag:aside", "tag:footer", "tag:form", "kind:advert", "kind:side", "kind:menu", "kind:comment", "kind:notice", "kind:share", "kind:foot", "kind:hidden"}
    return ("tag:article" in fs or "tag:main" in fs) and not apart & set(fs)


_OWN_ELEMENT = re.compile(r"<(/?)(?:article|main)(?=[\s/>])[^>]*>", re.I)


def bare(page: str) -> str:
    """The page with its <article> and <main> made plain <div>s."""
    return _OWN_ELEMENT.sub(r"<\1div>", page)


def labelled(pages: list[str]) -> list[tuple[list[list[str]], list[int]]]:
    """Sequences of features and labels from the layouts and from pages that have an <article> or <main>; of these each as it is and bare, with the same labels."""
    out = []
    for page in LAYOUTS:
        found = blocks(page)
        out += [([fs for fs, _ in found], [int(t.startswith("+")) for _, t in found])] * 6
    for page in composed():
        found = blocks(page)
        out.append(([fs for fs, _ in found], [int(t.startswith("+")) for _, t in found]))
    for page in pages:
        found = blocks(page)
        labels = [int(_by_own_element(fs)) for fs, _ in found]
        if any(labels):
            out.append(([fs for fs, _ in found], labels))
            plain = blocks(bare(page))
            if len(plain) == len(found):
                out.append(([fs for fs, _ in plain], labels))
    return out


class Field:
    """The conditional random field: weights of (feature, label), of label pairs and of first labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, pairs: np.ndarray, first: np.ndarray):
        self.names, self.weights, self.pairs, self.first = names, weights, pairs, first
        self.rows = {name: tuple(weights[i].tolist()) for name, i in names.items()}

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi; ties go to label 0."""
        (aa, ab), (ba, bb) = self.pairs.tolist()
        a, b = self.first.tolist()
        back: list[tuple[int, int]] = []
        for k, fs in enumerate(sequence):
            ea = eb = 0.0
            for f in fs:
                w = self.rows.get(f)
                if w:
                    ea, eb = ea + w[0], eb + w[1]
            if k:
                back.append((int(b + ba > a + aa), int(b + bb > a + ab)))
                a, b = max(a + aa, b + ba), max(a + ab, b + bb)
            a, b = a + ea, b + eb
        labels = [int(b > a)]
        for x in reversed(back):
            labels.append(x[labels[-1]])
        return labels[::-1] if sequence else []


def train(sequences: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Field:
    """Maximise the penalised conditional likelihood by Adam; sums over label paths by forward and backward recursion."""
    names = {f: i for i, f in enumerate(sorted({f for fs, _ in sequences for x in fs for f in x}))}
    n, most, wide = len(sequences), max(len(y) for _, y in sequences), max(len(x) for fs, _ in sequences for x in fs)
    index = np.full((n, most, wide), len(names))
    gold, live = np.zeros((n, most), int), np.zeros((n, most), bool)
    for s, (fs, y) in enumerate(sequences):
        live[s, : len(y)], gold[s, : len(y)] = True, y
        for t, x in enumerate(fs):
            index[s, t, : len(x)] = [names[f] for f in x]
    params = np.zeros((len(names) + 1) * 2 + 4 + 2)
    moment, square = np.zeros_like(params), np.zeros_like(params)

    def parts(p: np.ndarray):
        k = (len(names) + 1) * 2
        return p[:k].reshape(-1, 2), p[k : k + 4].reshape(2, 2), p[k + 4 :]

    one_hot = np.eye(2)[gold] * live[:, :, None]
    for step in range(1, steps + 1):
        w, pairs, first = parts(params)
        emit = w[index].sum(axis=2)
        ahead, behind = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        ahead[:, 0] = first + emit[:, 0]
        for t in range(1, most):
            x = ahead[:, t - 1, :, None] + pairs
            ahead[:, t] = np.where(live[:, t, None], np.logaddexp(x[:, 0], x[:, 1]) + emit[:, t], ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            x = pairs + (emit[:, t + 1] + behind[:, t + 1])[:, None, :]
            behind[:, t] = np.where(live[:, t + 1, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        single = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
        both = np.exp(ahead[:, :-1, :, None] + pairs + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
        grad = np.zeros_like(params)
        gw, gp, gf = parts(grad)
        for y in (0, 1):
            gw[:, y] = np.bincount(index.reshape(-1), np.repeat((one_hot - single)[:, :, y].reshape(-1), wide), len(names) + 1)
        gw[-1] = 0
        gp += (one_hot[:, :-1, :, None] * one_hot[:, 1:, None, :]).sum(axis=(0, 1)) - both.sum(axis=(0, 1))
        gf += (one_hot[:, 0] - single[:, 0]).sum(axis=0)
        grad = grad / n - ridge * params
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        params = params + rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    w, pairs, first = parts(params)
    return Field(names, w[:-1], pairs, first)


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Field:
    """Train on the layouts and on about `sample` pages (of up to 20,000 characters; twice as many at most)."""
    few = sampled(pages.where("html is not null and length(html) <= 20000"), sample, "page_id", "html").select("html").limit(2 * sample)
    return train(labelled([r[0] for r in few.collect()]))


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    labels = field.decode([fs for fs, _ in found])
    return "\n\n".join(t for (_, t), y in zip(found, labels) if y)


def extract(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row. Null or empty html, or a page without main text, gives empty text.

    Repeated rows, and rows without a page_id, are read each; an empty table gives none. A very long page is read whole, in time in
    proportion to its length. Where both labels are as likely, a block isn't main text. Columns but these are not looked at.
    """
    prepare(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(fit(pages, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            texts = [main_text(x, field) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
