import math
import random
import time

import numpy as np

from daybook.llm import pages as P


def test_furniture_goes_and_articles_stay():
    html = (
        "<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<div class='cookie-notice'>We use cookies</div><header><h2>Site</h2></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        "<article><header><h1>Head&nbsp;line</h1></header><p>One <b>bold\n word</b>.<br>Next &lt;line&gt;</p><div class='ad'>Buy</div>"
        "<p>X.<p>Unclosed one<ul><li>a<li>b</ul><form><input><p>Mail us</form><aside>See also</aside>"
        "<section id='comments'><p>nice text indeed, a very long comment by a reader of this page</p></section></article>"
        "<footer>&copy; 2020</footer></body></html>"
    )
    assert P.main_text(html) == "Head line\nOne bold word.\nNext <line>\nX.\nUnclosed one\na\nb"


def test_pages_without_article_use_the_clusters():
    body = "".join(f"<p>This is paragraph number {i} of a page with running text that is long enough to count.</p>" for i in range(8))
    links = "<div>" + "".join(f"<span><a href='/{i}'>L{i}</a></span> " for i in range(30)) + "</div>"
    out = P.main_text(f"<body>{links}<hr>{links}<hr>{links}<hr>{body}<hr>{links}<hr>{links}</body>").split("\n")
    assert len(out) == 8 and all(f"number {i} of" in line for i, line in enumerate(out))


def test_short_paragraphs_of_plain_markup_stay():
    for lengths in ([300, 280, 4, 3, 5, 4, 6, 3, 310, 290], [2000, 150, 140, 160, 150, 150, 140, 1800], [900, 3, 8], [5, 700]):
        paragraphs = ["x" * n for n in lengths]
        page = "<nav>Menu</nav><div class='page has-sidebar'><h1>Head</h1>" + "".join(f"<p>{t}</p>" for t in paragraphs) + "</div><footer>f</footer>"
        assert P.main_text(page) == "\n".join(["Head", *paragraphs])


def test_region_is_the_smallest_container_of_clusters_and_half_of_the_text():
    text = "".join(f"<p>{'word ' * 60}{i}</p>" for i in range(4))
    page = f"<body><div><div>Teaser beside</div><div id=body><h2>H</h2>{text}<p>End.</p></div><div>Another teaser</div></div></body>"
    out = P.main_text(page).split("\n")
    assert out[0] == "H" and out[-1] == "End." and len(out) == 6


def test_furniture_words_win_in_compound_names():
    for name in ("post-comments", "entry-share", "content-ad", "main-nav", "story_related", "comments", "article-footer", "comment-content"):
        assert P.main_text(f"<article><p>Body text</p><div class='x {name}'><p>gone</p></div></article>") == "Body text", name
        assert P.main_text(f"<div><p>Body text</p><section id='{name}'>gone</section></div>") == "Body text", name
    for name in ("entry-header", "has-sidebar", "content", "headers", "shadow", "post-body", "no-comments"):
        assert P.main_text(f"<article><div class='{name}'>stays</div><p>Body text</p></article>") == "stays\nBody text", name
    nested = "<article><p>Body</p><article class='comment'><p>nice</p></article></article><article class='related'>teaser</article>"
    assert P.main_text(nested) == "Body"


def plain_lines(lines, sigma=1.0):
    """Ratio, smoothing and threshold by their formulas; then the region as described, by walking up from every line."""
    free = [i for i, x in enumerate(lines.lines) if not x.furniture]
    if not free:
        return []
    own = [len(lines.lines[i].text) / max(1, lines.lines[i].tags) for i in free]
    soft = []
    for i in range(len(own)):
        near = [(j, math.exp(-0.5 * ((i - j) / sigma) ** 2)) for j in range(len(own)) if abs(i - j) <= 3 * sigma]
        soft.append(sum(w * own[j] for j, w in near) / sum(w for _, w in near))
    mean = sum(soft) / len(soft)
    cut = min(math.sqrt(sum((x - mean) ** 2 for x in soft) / len(soft)), max(soft))
    dense = [i for i, x in zip(free, soft, strict=True) if x >= cut]

    def above(i):
        chain = [lines.lines[i].container]
        while chain[-1]:
            chain.append(lines.parents[chain[-1]])
        return chain

    size = lambda group: sum(len(lines.lines[i].text) for i in group)
    fits = [
        c for c in range(len(lines.parents))
        if all(c in above(i) for i in dense) and 2 * size(i for i in free if c in above(i)) >= size(free)
    ]
    kept = [i for i in free if max(fits) in above(i)]
    return [i for i in kept if dense[0] <= i <= dense[-1] or 2 * lines.lines[i].linked <= len(lines.lines[i].text)]


def test_equals_plain_rules_on_random_pages():
    rng = random.Random(5)
    for _ in range(150):
        html, depth = "", 0
        for _ in range(rng.randint(1, 40)):
            what = rng.random()
            if what < 0.2:
                html, depth = html + rng.choice(["<div>", "<section>", "<div class='ad'>"]), depth + 1
            elif what < 0.35 and depth:
                html, depth = html + rng.choice(["</div>", "</section>"]), depth - 1
            elif what < 0.5:
                html += f"<p><a href='/'>{'l' * rng.randint(1, 30)}</a> {'t' * rng.randint(0, 20)}"
            else:
                html += f"<p>{'<b>x</b>' * rng.randint(0, 5)}{'t' * rng.choice([1, 5, 40, 300])}</p>"
        parser = P.Lines()
        parser.feed(html)
        parser.close()
        parser.flush()
        assert P.content_lines(parser.lines, parser.parents) == plain_lines(parser), html


def test_smoothing_keeps_a_constant():
    assert np.allclose(P.smooth(np.full(9, 7.0), 1.0), 7.0)


def test_deep_and_unclosed_markup_takes_linear_time():
    def seconds(n):
        begin = time.perf_counter()
        P.main_text("<div>a" * n + "</span>x" * n)
        P.main_text("<li><ul>" + "<div>" * n + "<li>q</li><b>" * n)
        return time.perf_counter() - begin

    assert seconds(20000) < 12 * max(seconds(4000), 0.05)


def test_defined_results(spark):
    made = [
        (1, "u", None, "x"), (2, None, "", "x"), (3, "u", "no tags at all &eacute;", "x"), (4, "u", "<article><p>a &amp b</article>", "x"),
        (4, "u", "<article><p>a &amp b</article>", "x"), (5, "u", "<p>" + "long text " * 60000, "x"), (6, "u", "<article>open <!-- c --> end", "x"), (None, "u", "<nav>x</nav>", "x"),
    ]
    df = spark.createDataFrame(made, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in P.extract_pages(df).collect()}
    assert [got[i].text for i in (1, 2, 3, 4, 6, None)] == ["", "", "no tags at all é", "a & b", "open end", ""]
    assert got[5].n_chars == 10 * 60000 - 1 == len(got[5].text)
    assert P.extract_pages(df).count() == 8 and P.extract_pages(df.limit(0)).count() == 0
