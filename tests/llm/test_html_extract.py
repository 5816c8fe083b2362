"""HTML extraction: messages against enumeration, held-out accuracy, and pages written out by hand."""

import itertools
import math
import random

import numpy as np
import pytest

from kinweave.llm.html_extract import content_marginals, default_model, extract, extract_pages, labelled_pages, marginals, parse


def test_marginals_equal_enumeration():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randrange(1, 8)
        parents = [-1, *(rng.randrange(k) for k in range(1, n))]
        groups = [rng.randrange(2) for _ in range(n)]
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edge = np.array([[[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)] for _ in range(2)])
        first, joint = marginals(parents, groups, scores, edge.tolist())
        total, one, pairs = 0.0, [0.0] * n, [[0.0] * 4 for _ in range(n)]
        for states in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(s * x for s, x in zip(scores, states)) + sum(edge[groups[k], states[parents[k]], states[k]] for k in range(1, n)))
            total += p
            for k in range(n):
                one[k] += p * states[k]
                if k:
                    pairs[k][2 * states[parents[k]] + states[k]] += p
        assert np.allclose(first, np.array(one) / total)
        assert n == 1 or np.allclose(joint[1:], np.array(pairs[1:]) / total)


def test_accuracy_on_held_out_pages():
    right = n = 0
    for html, labels in labelled_pages(120, seed=1234):
        page = parse(html)
        content = content_marginals(page, default_model())
        for block, _ in page.pieces:
            n += 1
            right += (content[block] >= 0.5) == labels[block]
    assert right / n > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x = "<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<header>Daily paper</header><div class="ad">Buy this now, it is cheap.</div>{}<div class="comments"><p>First! I liked it, thanks.</p></div><aside>More stories</aside><form><label>Mail</label><input></form><footer>&copy; the paper</footer></body></html>"""


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ("<article><h1>Big  news</h1><p>It rained\n today &amp; stopped.<p>Then <b>again</b>.</article>", "Big news It rained today & stopped. Then again."),
        ("<article><h1>News</h1><p><b>Bold start, never closed.<br><p>Next paragraph is here.</p></article>", "News Bold start, never closed. Next paragraph is here."),
        ("<article><p>a&lt;b &#233;t&eacute; &#x4e2d;&nbsp;x, yes it is so.</p><!-- hidden --><p>En<i>d</i> of it.</p></article>", "a<b été 中 x, yes it is so. End of it."),
        ('<article><h1>One</h1><p>Some sentence of the article, long enough.</p><div class="ad">Buy!</div><p>More of the article text here.</p></article>', "One Some sentence of the article, long enough. More of the article text here."),
        ("<article><p title='a>b'>Quoted > sign, \"fine\" & well.</p><ul><li>one thing<li>two things</ul></article>", 'Quoted > sign, "fine" & well. one thing two things'),
        ('<div class="post-content"><h1>Layout</h1><p>Without an article element, but long enough.</p><p>Second one, too.</p></div>', "Layout Without an article element, but long enough. Second one, too."),
    ],
)
def test_pages(inside, text):
    assert extract(PAGE.format(inside), default_model()) == text


def test_odd_input(spark):
    deep = "<div>" * 50_000 + "deep"
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<html><body><article><h1>News</h1><p>It was, as they said, cut off in the mid"), (4, "u", deep), (5, "u", "<" * 2000 + '<p class="x' * 2000), (None, "u", "</p></div>text < 3 and > 2"), (1, "u", None), (6, "u", "<script>never closed")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    out = extract_pages(df).collect()
    assert len(out) == len(pages)
    by = {r.page_id: r for r in out}
    assert by[1].text == by[2].text == by[6].text == "" and by[1].n_chars == 0
    assert by[3].text == "News It was, as they said, cut off in the mid" and by[3].n_chars == 45
    assert extract_pages(df.limit(0)).count() == 0
