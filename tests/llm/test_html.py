import random
import re
import time

import pytest

from swingkit.llm.common import table
from swingkit.llm.html import extract, lines_of, main_text, runs_of, sums_of

LONG = "A sentence of the article that is long enough to count as text. " * 2


def test_article_alone_is_kept():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
    <!-- <p>no</p> --><div class="ad">buy</div><article><h1>Title &amp; more</h1><p><b>One &lt;two&gt;<br><p>A&nbsp; &#x42;\n C</p><section class="comments"><p>{LONG}</p></section></article>
    <aside>{LONG}</aside><form>{LONG}<button>Go</button></form><footer>&copy; x</footer></body></html>"""
    assert main_text(page) == "Title & more\nOne <two>\nA B C"


def test_surge_and_dive_without_an_article():
    links = "".join(f"<li><a href=/{i}>A link that goes to some other page {i}</a></li>" for i in range(9))
    page = f"<div id=top-menu>{LONG}</div><ul>{links}</ul><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><ul>{links}</ul><div class='cookie-notice'>{LONG}</div>"
    one = LONG.strip()
    assert main_text(page) == f"{one}\nShort.\n{one}"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p></p>", ""), ("a < b", "a < b"), ("<p class=ad>x<p>Kept", "Kept"), ("<script>x", ""), ("<div hidden>x</div><p>y", "y")])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_extra_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "<p>x y", "old"), (1, "<p>x y", "old"), (2, None, None)], "page_id long, html string, text string")
    assert sorted(r.text for r in extract(pages).collect()) == ["", "x y", "x y"]
    assert extract(pages.limit(0)).count() == 0


def test_very_long_page():
    assert len(main_text("<article>" + "<p>word word</p>" * 50_000)) == 50_000 * 10 - 1


def test_links_in_a_marked_article_are_kept():
    references = "".join(f"<li><a href=/{i}>Reference {i}</a></li>" for i in range(5))
    page = f"<p>{LONG}</p><article><h1><a href=x>Title</a></h1><p>Body.</p><ul>{references}</ul><div class=ad>buy</div><p><a href=y>Last</a></p></article><p>{LONG}</p>"
    assert main_text(page) == "\n".join(["Title", "Body.", *(f"Reference {i}" for i in range(5)), "Last"])


def test_short_lines_before_a_surge_and_links_in_a_run_are_kept():
    one = LONG.strip()
    page = f"<ul><li><a href=/>Home</a></ul><h1>Title</h1><p>By A. Writer</p><p>1 May</p><p>Intro.</p><p>{LONG}</p><p><a href=x>See also</a></p><p>{LONG}</p><ul><li><a href=/1>Next</a></ul>"
    assert main_text(page) == f"Title\nBy A. Writer\n1 May\nIntro.\n{one}\nSee also\n{one}"


def test_a_linked_title_and_a_linked_last_paragraph_are_kept():
    one, menu = LONG.strip(), "".join(f"<li><a href=/{k}>Page {k}</a></li>" for k in range(5))
    page = f"<ul>{menu}</ul><h1><a href=x>Title</a></h1><p>{LONG}</p><p><a href=y>Last line</a></p><ul>{menu}</ul>"
    assert main_text(page) == f"Title\n{one}\nLast line"
    # Rows of links before and after the text are no part of it.
    links = "".join(f"<h3><a href=/{k}>Story {k}</a></h3>" for k in range(5))
    assert main_text(f"{links}<div>{LONG}</div>{links}") == one
    assert main_text(f"<h1><a href=x>Other</a></h1><div class=ad>buy</div><p>{LONG}</p><ul>{menu}</ul><p><a href=y>Home</a></p>") == one


def test_sums_and_runs_against_brute_force():
    """A run is a chain of weighted lines at most SPAN apart that has a surge in it."""
    rng = random.Random(5)
    for _ in range(500):
        weights = [rng.choice((0, 0, 0, 5, 30, 90)) for _ in range(rng.randrange(30))]
        sums = sums_of(weights)
        assert sums == [sum(w for k, w in enumerate(weights) if i <= k < i + 3) for i in range(len(weights))]
        least, chains = rng.choice((1, 30, 80, 100)), []
        for k, w in enumerate(weights):
            if w and chains and k - chains[-1][-1] <= 3:
                chains[-1].append(k)
            elif w:
                chains.append([k])
        assert runs_of(weights, least) == [(c[0], c[-1]) for c in chains if any(sums[k] >= least for k in c)]


def test_the_method_finds_the_article_without_its_mark(spark):
    """With article and nav turned into plain divs the sums alone find the same text on every page, and they leave lines out."""
    pages = [r.html for r in table(spark, "/root/testdata/sf0.001", "pages").collect()]
    plain = [re.sub(r"<(/?)(?:article|main|nav)\b", r"<\1div", x) for x in pages]
    assert [main_text(x) for x in plain] == [main_text(x) for x in pages]
    assert all("\n".join(line.text for line in lines_of(x) if line.text) != main_text(x) for x in plain)


def test_dense_text_outside_a_small_marked_part():
    page = f"<article><p>Teaser.</p></article><div>{'<p>' + LONG + LONG * 20 + '</p>'}</div>"
    assert main_text(page) == f"Teaser.\n{(LONG + LONG * 20).strip()}"


def test_text_near_noise_is_kept():
    one, ads = LONG.strip(), "<div class=ad>buy</div>" * 3
    assert main_text(f"<p>{LONG}</p>{ads}<p>Short end.</p>") == f"{one}\nShort end."
    assert main_text(f"<h1>Title</h1>{ads}<p>{LONG}</p>") == f"Title\n{one}"
    assert main_text(f"<article><p>{LONG}</p><div class='share-price related'>12 points</div><p class=alert>Mind this.</p></article>") == f"{one}\n12 points\nMind this."
    assert main_text(f"<article><p>{LONG}</p><div class=related><a href=x>Other</a></div><div class='comment-list'><p>{LONG}</p></div></article>") == one
    assert main_text(f"<div class='post-comment-count'><p>{LONG}</p></div>") == one
    assert main_text(f"<p>One<br>block {LONG}</p>") == f"One block {one}"
    assert main_text("".join(f"<p>Line {k}</p>" for k in range(30))) == "\n".join(f"Line {k}" for k in range(30))
    assert main_text(f"<p title=don't>{LONG}</p><p>It's</p>") == f"{one}\nIt's"


@pytest.mark.parametrize("part", ['<a " ', "<! ", "<a ", "<a href='", '<a x=">" ', "<head>", "<script>", "<!--", "<p class=ad>", "&lt", '<a x="', "<div class=related>"])
def test_hostile_markup_takes_linear_time(part):
    began = time.perf_counter()
    main_text(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 5
