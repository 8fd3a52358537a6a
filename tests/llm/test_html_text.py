import math
import random
import time

import numpy as np

from vectrine.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make everything better for you and us.</div><!-- <p>gone</p> -->
<article><h2>Head &amp; line</h2><p>First paragraph of <b>some   length</b>, with&nbsp;a link <a href=x>here</a> and more words to read.
<p>Second paragraph, whose tag is not closed, goes on for quite a while too.<br>Next line.<div class="ad">Buy this</div>
<p>End.</p><form><label>Mail</label><input></form></article>
<aside>Side text that is rather long and could look like an article to a careless eye.</aside>
<section id="comments"><p>A reader's comment, rather long and chatty, that is not part of it.</p></section><footer>&copy; someone</footer></body></html>"""


def test_article_only():
    assert html_text.blocks(PAGE) == [
        "Head & line",
        "First paragraph of some length, with a link here and more words to read.",
        "Second paragraph, whose tag is not closed, goes on for quite a while too. Next line.",
        "End.",
    ]


def test_odd_pages():
    assert html_text.blocks("") == html_text.blocks("<nav>x</nav>") == html_text.blocks("<script>a") == []
    assert html_text.blocks("plain text") == ["plain text"]
    assert html_text.blocks("</div></p>a<p>b") == ["a", "b"]
    assert len("".join(html_text.blocks("<div>" * 3000 + "deep " * 9))) > 20


def test_box_that_names_a_sidebar_it_has():
    page = '<div class="page has-sidebar no-comments"><div id="leftSidebar">Links of no interest here</div><p>The text itself, long enough to be read as such.</p></div>'
    assert html_text.blocks(page) == ["The text itself, long enough to be read as such."]


def test_head_without_end_tag():
    for head in ("<title>T</title>", "<meta charset=utf-8><title>T</title><noscript><p>no</p></noscript>\n"):
        for start in ("<body><p>", "<p>", "<article><p>", "<div class=page><div class=ad>Buy</div>", "<b>", "<img src=x>", ""):
            assert html_text.blocks(f"<html><head>{head}{start}The article is here.") == ["The article is here."], start
    assert html_text.blocks("<head><title>T</title><style>p{}</style></head><p>Text.") == ["Text."]


def test_short_part_of_a_long_article():
    part, long = "A short part. " * 21, "Long article text. " * 20
    for tag in ("section", "div"):
        page = f"<body><{tag}>" + f"<p>{long}</p>" * 40 + f"</{tag}><{tag}><p>{part}</p></{tag}><ul><li><a href=/>Home</a><li><a href=/b>Map</a></ul></body>"
        assert html_text.blocks(page) == [long.strip()] * 40 + [part.strip()], tag


def test_without_telling_names():
    para = "Some sentence of an article that goes on for a while, as they do. " * 3
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Entry {k}</a>" for k in range(8)) + "</ul>"
    page = (
        f"<div><div><a href=/>Site</a></div><div>{menu}</div><div><h1>The title</h1><p>{para}</p><p>Short.</p><ul><li>One thing<li>Another</ul><p>{para}</p></div>"
        f"<div><h4>Latest</h4>{menu}</div><table><tr><td><a href=/t>Terms</a></td><td><a href=/p>Privacy</a></td><td>2024</td></tr></table></div>"
    )
    assert html_text.blocks(page) == ["The title", para.strip(), "Short.", "One thing", "Another", para.strip()]


def test_marks_weigh_but_do_not_decide():
    para = "A sentence of the article, which all lies in a form, as some servers have it. " * 3
    page = f'<body><form><nav><a href=/>Home</a> and more</nav><div class="page-header-layout"><p>{para}</p><p>{para}</p></div><footer>Some note</footer></form></body>'
    assert html_text.blocks(page) == [para.strip()] * 2
    comment = f'<div id="comments"><p>{para}</p></div>'
    assert html_text.blocks(f"<article><p>Brief, but the article.</p></article>{comment * 5}") == ["Brief, but the article."]
    assert html_text.blocks(f'<div><p>{para}</p><span class="ad">Buy <b>now</b></span><p>End.</p></div>') == [para.strip(), "End."]


def test_smoothing_keeps_a_level_line():
    assert all(abs(v - 2.0) < 1e-12 for v in html_text.smooth([2.0] * 7, 1.5))


def test_smoothing_and_clustering_equal_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 9, 60):
        v, g, s = rng.gamma(1.0, 2.0, n), rng.integers(0, 2, n), 1.3
        near = lambda i: [j for j in range(n) if abs(i - j) <= math.ceil(3 * s) and g[i] == g[j]]
        w = lambda i, j: math.exp(-((i - j) ** 2) / (2 * s * s))
        want = [sum(w(i, j) * v[j] for j in near(i)) / sum(w(i, j) for j in near(i)) for i in range(n)]
        assert np.allclose(html_text.smooth(v, s, g), want)
        # the partition that nearest centres, one of them the origin, keep; found from the greatest value on
        over = [max(v)]
        while True:
            center = sum(over) / len(over)
            again = [x for x in v if abs(x - center) <= x]
            if sum(again) / len(again) >= center - 1e-12:
                break
            over = again
        assert math.isclose(html_text.threshold(v), center / 2)


def test_time_grows_with_the_page():
    text = "<p>" + "Words of the article. " * 30
    hostile = {
        "nested": "<div>" * 100_000 + text,
        "stray": "<div>" * 50_000 + "</span></b>" * 50_000 + text,
        "paragraphs": "<p><div>" * 50_000 + text,
        "no end": text + "</p>" + "<a href='x " * 30_000,
        "quotes": text + "</p>" + "<a b='> <i c=\"> " * 20_000,
        "comment": text + "</p><!-- " + "<b> -- " * 50_000,
        "titles": text + "</p>" + "<title>" * 100_000,
        "script": text + "</p><script>" + "if (a < b) {} " * 50_000,
        "image": f'<p><img src="data:image/png;base64,{"A" * 3_000_000}">' + text[3:],
    }
    for name, page in hostile.items():
        began = time.process_time()
        got = html_text.blocks(page)
        assert any("Words of the article." in b for b in got), name
        assert time.process_time() - began < 5, name


def test_no_text_is_lost_and_no_markup_let_through():
    quote = "a passage that an article quotes at length, with a = b and more, " * 40
    for q in ("\"", "'"):
        page = f"<article><p>They said: x = {q}{quote}{q} in full.</p><p>And a&lt;b, 1 < 2, a<3, </ p>{quote}</p></article>"
        got = html_text.blocks(page)
        assert got[0] == f"They said: x = {q}{quote}{q} in full." and got[1].startswith("And a<b, 1 < 2, a<3, ") and got[1].endswith(quote.strip())
    for size in (10, 5_000, 100_000):
        props = '{"a": "<p>never</p> > </div>"} ' * (size // 30 + 1)
        page = f"<body><div data-props='{props}' class=story><p>{quote}</p></div><div class='nav' title='{props}'><a href='x'>Menu</a></div></body>"
        assert html_text.blocks(page) == [quote.strip()]


def test_markup_of_all_kinds():
    text = "Words of the article, one after another. " * 5
    for odd in ("<!doctype html>", "<!-- a > b -->", "<!-->", "<![CDATA[ no > text ]]>", "<?php no ?>", "<b\n>", "<b a=1 b='>' c=\">\">", "</b x='>'>", "<br/>", "<script>if (a < b) '</p>'</script >", "<style>p > b {}</STYLE>", "<textarea><p>no</textarea>", "<b don't>"):
        assert html_text.blocks(f"<p>{odd}{text}</p>") == [text.strip()], odd
    assert html_text.blocks(f"<p>{text}<b a='no end> here</p>") == [text.strip() + " here"]
    assert html_text.blocks(f"<p>{text}</p><script>{text}") == [text.strip()]
    assert html_text.blocks(f"<p>{text} <never ended")[0].startswith(text.strip() + " <never ended")


def choice_by_hand(lines, sigma=1.0):
    """The regions of the article, line by line from the docstring."""
    own = [math.log1p(outside / max(tags, 1) * html_text.MARK**marks / html_text.LITTLE) for _, outside, tags, marks, _ in lines]
    level = []
    for i in range(len(lines)):
        near = [j for j in range(len(lines)) if abs(i - j) <= math.ceil(3 * sigma) and lines[i][3] == lines[j][3]]
        w = [math.exp(-((i - j) ** 2) / (2 * sigma * sigma)) for j in near]
        level.append(sum(x * own[j] for x, j in zip(w, near)) / sum(w))
    over = [max(level)]
    while True:
        center = sum(over) / len(over)
        again = [v for v in level if v >= center / 2]
        if sum(again) / len(again) >= center - 1e-12:
            break
        over = again
    regions = {r for r in {line[4] for line in lines} if any(v >= center / 2 and v > 0 and (not line[3] or line[1] >= html_text.MUCH * max(line[2], 1)) for v, line in zip(level, lines) if line[4] == r) and any(o >= center / 4 for o, line in zip(own, lines) if line[4] == r)}
    return [line[0] for line in lines if line[4] in regions]


def test_choice_of_regions_equals_brute_force():
    rng = random.Random(8)
    word = lambda n: " ".join(rng.choice(("alpha", "beta", "of", "gamma")) for _ in range(n))
    for _ in range(200):
        page = "".join(
            f"<{tag}{rng.choice(('', ' class=nav', ' class=story'))}>" + "".join(f"<p>{word(rng.choice((1, 3, 60)))}{rng.choice(('', '<b>x</b>', '<a href=#>y</a>')) * rng.randint(0, 4)}</p>" for _ in range(rng.randint(1, 5))) + f"</{tag}>"
            for tag in rng.choices(("div", "section", "article", "footer", "ul"), k=rng.randint(1, 6))
        )
        parser = html_text.Lines()
        parser.read(page)
        assert html_text.blocks(page) == choice_by_hand(parser.lines)


def test_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (2, None, "<p>é 𝄞</p>", None)], "page_id long, url string, html string, n_chars string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got[1:] == [(2, "", 0), (2, "é 𝄞", 3)] and got[0][2] == len(got[0][1])
    assert html_text.extract(pages.limit(0)).count() == 0
