"""Pages whose language or layout decides nothing by stop words, and pages that are left open."""

import time

import pytest

from upland.llm import htmltext

CHINESE = ["海边的小镇在清晨格外安静，渔民们已经开始准备一天的工作，孩子们沿着石阶跑向学校。", "老人坐在码头上修补渔网，他说这里的风向每年秋天都会改变，鱼群也会随之南下，所以大家都在等待那一天的到来。"]
POLISH = ["Nad rzeką stał stary młyn, który pamiętał jeszcze czasy dziadków i pradziadków tej okolicy.", "Każdego ranka młynarz otwierał ciężkie drzwi i wpuszczał chłodne powietrze znad wody, a potem uruchamiał drewniane koła."]
RECIPE = ["Tomato soup", "2 tomatoes", "1 onion", "Chop onions finely. Fry gently. Add tomatoes, stir well, simmer twenty minutes, blend, season, serve hot."]

LAYOUTS = [
    '<div class="nav"><ul><li><a href="#">Home</a></li><li><a href="#">News</a></li></ul></div><div id="content">{}</div><div id="footer">Contact us here</div>',
    '<header><a href="/">Site</a></header><div class="post">{}</div><aside><p>Buy now and save today on our offers of the week, only here and only for you</p></aside>',
    '<nav><a href="#">A</a> <a href="#">B</a></nav><main>{}</main><footer>All rights reserved by the owner of the site and the makers of it</footer>',
    '<body><form><p>Search</p><input></form>{}<script>var x = "<p>no</p>";</script></body>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("lines", [CHINESE, POLISH, RECIPE], ids=["chinese", "polish", "recipe"])
def test_pages_that_stop_words_do_not_decide(layout, lines):
    assert htmltext.extract(layout.format("".join(f"<p>{x}</p>" for x in lines))) == "\n\n".join(lines)


def test_pages_without_text_stay_empty():
    for page in ("", "<nav><a href='#'>Home of the site and of all that is in it</a></nav>", '<div class="menu"><p>One of the pages</p></div>', "<p>short</p>", "<p><a href='#'>" + "a link of some length in a paragraph of its own " * 3 + "</a></p>"):
        assert htmltext.extract(page) == ""


@pytest.mark.parametrize("left_open", ["<svg>", "<noscript>", "<template>", "<object>", "<svg><p>x", "<button>", "<script", "<!--", "<svg></svg><video>", "</svg><svg>"])
def test_open_elements_take_linear_time(left_open):
    text = "The man of the sea and the sun is in the town on the hill for a day of rest with his dog."
    took = []
    for n in (4000, 40000):
        began = time.process_time()
        assert text in htmltext.extract(f"<article><p>{text}</p></article>" + left_open * n)
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.01) and took[1] < 10


def test_no_pages(spark):
    rows = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert htmltext.extract_pages(rows).collect() == []
