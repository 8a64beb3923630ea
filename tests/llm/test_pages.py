"""Page extraction against pages of known content and a plain second pass."""

from __future__ import annotations

import random
import time

import pytest
from scriptorium.llm import html_text
from scriptorium.llm.html_text import Block

WORDS = "the of and to in a is that for with river stone garden market window letter bridge summer".split()
AROUND = {
    "nav": '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>',
    "header": "<header><div>Site name</div><form><input name=q><button>Go</button></form></header>",
    "side": '<div class="sidebar"><h3>Popular</h3><p>Something that many of the readers of this page have read in the last week.</p></div>',
    "cookie": '<div id="cookie-banner"><p>We use cookies on this site. <button>Accept</button></p></div>',
    "advert": '<div class="advert"><p>Buy the new lamp at once and save a half of the price.</p></div>',
    "script": "<script>if (a < b) { document.write('<p>no</p>'); }</script><style>p > b { color: red }</style>",
}
BELOW = [
    '<section class="comments"><h3>Comments</h3><p>I liked this text that was written by the author of it.</p></section>',
    "<footer><p>&copy; 2024 The makers of the site</p><a href='/legal'>Legal</a></footer>",
]


def _sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def _page(seed: int) -> tuple[str, str]:
    """A page and its main text; odd seeds mark their article."""
    rng = random.Random(seed)
    body, text = [], []

    def say(markup: str, said: str) -> None:
        body.append(markup)
        text.append(said)

    title = _sentence(rng, 5)
    say(f"<h1>{title}</h1>", title)
    for _ in range(rng.randint(2, 8)):
        a, b, c = _sentence(rng, rng.randint(45, 90)), _sentence(rng, 3), _sentence(rng, 4)
        kind = rng.randrange(5)
        if kind == 0:
            say(f"<h2>{b}</h2>\n<p>{a}</p>", f"{b}\n{a}")
        elif kind == 1:
            say(f"<p>{b}</p><p>{a}</p>", f"{b}\n{a}")
        elif kind == 2:
            say(f"<p>{a} <a href='/x'>{b}</a> &amp; <b>{c}</b></p>", f"{a} {b} & {c}")
        elif kind == 3:
            say(f"<ul><li>{b}</li><li>{c}</li></ul><p>{a}</p>", f"{b}\n{c}\n{a}")
        else:
            say(f"<p>{a}\n   {b}<br>{c}</p>", f"{a} {b} {c}")
    above = [AROUND[k] for k in rng.sample(sorted(AROUND), rng.randint(1, len(AROUND)))]
    wrap = ("<article>", "</article>") if seed % 2 else ("<div>", "</div>")
    below = rng.sample(BELOW, rng.randint(0, 2))
    return "<html><body>" + "".join(above) + wrap[0] + "".join(body) + wrap[1] + "".join(below) + "</body></html>", "\n".join(text)


@pytest.mark.parametrize("part", range(4))
def test_generated_pages(part):
    for seed in range(part * 50, part * 50 + 50):
        page, text = _page(seed)
        assert html_text.main_text(page) == text, page


def _plain(blocks: list[Block], has_main: bool) -> list[str]:
    """The second pass by looking for neighbours one by one."""
    first = [html_text.first_label(b, 60, 180, 0.2, 0.3, 0.35) for b in blocks]
    out = []
    for i, b in enumerate(blocks):

        def near(step, i=i, b=b):
            j = i + step
            while 0 <= j < len(blocks) and blocks[j].in_main == b.in_main:
                if first[j] in ("good", "bad"):
                    return first[j]
                j += step
            return "good" if b.in_main else "bad"

        two = [near(-1), near(1)]
        if first[i] in ("good", "bad"):
            good = first[i] == "good"
        elif first[i] == "heading":
            out.append("heading")
            continue
        elif b.in_main:
            good = first[i] == "neargood" or "good" in two
        elif has_main:
            good = "good" in two
        elif first[i] == "neargood":
            good = "good" in two or "good" not in first
        else:
            good = two == ["good", "good"] or "good" in two and b.tag in ("p", "li", "blockquote", "td", "pre")
        out.append("good" if good else "bad")
    for i, b in enumerate(blocks):
        if first[i] == "heading":
            same = lambda j, b=b: 0 <= j < len(blocks) and blocks[j].in_main == b.in_main
            j, k = i + 1, i - 1
            while same(j) and first[j] == "heading":
                j += 1
            while same(k) and first[k] not in ("good", "bad"):
                k -= 1
            below = out[j] if same(j) else "good" if b.in_main else "bad"
            above = first[k] if same(k) else "good"
            good = below == "good" or b.in_main and above == "good" or not has_main and "good" not in first and len(blocks) > 1
            out[i] = "good" if good else "bad"
    return out


def test_second_pass_against_plain_search():
    rng = random.Random(3)
    for _ in range(300):
        blocks, inside = [], False
        for _ in range(rng.randint(0, 25)):
            inside = inside != (rng.random() < 0.2)
            text = rng.choice([_sentence(rng, 3), _sentence(rng, 60), "xyzzy " * 30, _sentence(rng, 20), "\xa9 2024"])
            blocks.append(Block(text, rng.choice(["p", "div", "h2", "li", "td"]), rng.choice([0, 0, 5, len(text)]), inside))
        has_main = any(b.in_main for b in blocks)
        html_text.classify(blocks, has_main)
        assert [b.label for b in blocks] == _plain(blocks, has_main)


def test_links_between_links_inside_an_article_go():
    long = _sentence(random.Random(1), 60)
    menu = "<ul><li><a href='/a'>First page of it</a></li><li>or</li><li><a href='/b'>Second page of it</a></li></ul>"
    assert html_text.main_text(f"<article><p>{long}</p>{menu}<p>{long}</p></article>") == f"{long}\n{long}"


def _took(n: int) -> float:
    page = "<article><p>text</p></article>" + "<div>short bit</div>" * n
    began = time.process_time()
    html_text.main_text(page)
    return time.process_time() - began


def test_time_is_linear_in_blocks():
    _took(1000)
    assert _took(40_000) < 30 * max(_took(4000), 0.02)


def test_clashing_columns_and_a_very_long_page(spark):
    body = "<p>the word of the day and night &lt;x&gt;</p>" * 50_000
    rows = [(1, "u", f"<article>{body}</article>", "a", 5), (1, "u", f"<article>{body}</article>", "a", 5), (2, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string, n_chars int")
    found = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in html_text.extract_pages(pages).collect())
    text = "\n".join(["the word of the day and night <x>"] * 50_000)
    assert found == [(1, "u", text, len(text))] * 2 + [(2, "", "", 0)]
