import time

from panelkit.llm import html


def text(body):
    return html.main_text(body)


LONG = "The river ran quietly past the old mill and nobody in the village spoke of it. " * 3
SECOND = "Later that year the council met twice, and twice it put the question off again. " * 3


def test_article_between_boilerplate():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{a:b}}</style><script>var t="</p><article>no</article>";</script></head>
<body class="page"><header><p>{LONG}</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">{SECOND}</div>
<div id="cookie-notice">We use cookies. {LONG}</div><article><h1>A &amp; B&nbsp;&eacute;</h1><p>{LONG}<p><b>Short.<br>Two</b> lines</p><p>{SECOND}</p>
<form><input><button>Send</button> now</form><aside>{LONG}</aside><div class="share-bar">Share</div><!-- <p>hidden</p> --></article>
<section class="comments"><p>{LONG}</p></section><footer>&copy; {LONG}</footer></body>"""
    assert text(page).split("\n") == ["A & B é", LONG.strip(), "Short. Two lines", SECOND.strip()]


def test_no_article_element():
    page = f"<body><ul><li>Home</li><li>News</li><li>x</li></ul><div>{LONG}</div><div>{SECOND}</div><p></p><ul><li>a</li><li>b</li><li>c</li><li>d</li></ul></body>"
    got = text(page).split("\n")
    assert LONG.strip() in got and SECOND.strip() in got and "News" not in got and "d" not in got


def test_dropped_lines_do_not_split():
    page = f"<body><div><p>{LONG}</p><ul class='menu'><li>Home</li><li>News</li><li>x</li></ul><aside><p>a</p><p>b</p><p>c</p></aside><p>{SECOND}</p></div></body>"
    assert text(page).split("\n") == [LONG.strip(), SECOND.strip()]


def test_huge_paragraph_keeps_the_others():
    page = "<body><div>" + f"<p>{LONG}</p>" * 8 + "<p>" + LONG * 400 + "</p>" + f"<p>{SECOND}</p>" * 8 + "</div></body>"
    got = text(page).split("\n")
    assert got == [LONG.strip()] * 8 + [(LONG * 400).strip()] + [SECOND.strip()] * 8


def test_passages_of_one_container_are_joined():
    short = "<p>So.</p>" * 4
    page = f"<body><ul><li>Home</li><li>News</li><li>x</li><li>y</li><li>z</li></ul><div><p>{LONG * 3}</p>{short}<p>{SECOND * 3}</p>{short}</div><ul><li>a</li><li>b</li><li>c</li><li>d</li></ul><div><p>Unlike it.</p></div></body>"
    got = text(page).split("\n")
    assert [x for x in got if x not in ("z", "a")] == [(LONG * 3).strip(), *["So."] * 4, (SECOND * 3).strip(), *["So."] * 4]


def test_window_sums_choose_against_tags():
    page = f"<body><article><p>A teaser.</p></article><article><p>Another.</p></article><div><p>{LONG * 3}</p><p>{SECOND * 3}</p></div></body>"
    assert text(page).split("\n") == [(LONG * 3).strip(), (SECOND * 3).strip()]


def test_sections_of_main_and_articles_side_by_side():
    page = f"<body><p>{LONG}</p><main><h1>T</h1><article><p>{LONG}</p><ul><li>a</li><li>b</li><li>c</li></ul></article><section><p>{SECOND}</p></section><p>e</p><p>f</p><p>g</p></main></body>"
    assert text(page).split("\n") == ["T", LONG.strip(), "a", "b", "c", SECOND.strip(), "e", "f", "g"]
    page = f"<body><article><p>{LONG}</p></article><article><p>{SECOND}</p></article></body>"
    assert text(page).split("\n") == [LONG.strip(), SECOND.strip()]


def test_layout_wrappers_with_mark_words():
    for name in ("content with-sidebar", "has-sidebar", "no-comments", "nav-layout", "sidebar", "page banner-top"):
        aside = f"<div class='sidebar'><p>{SECOND}</p></div>"
        assert text(f"<body><div class='{name}'><article><p>{LONG}</p></article>{aside}</div></body>") == LONG.strip()
        assert text(f"<body><div class='{name}'><p>{LONG}</p><p>{LONG}</p>{aside}</div></body>").split("\n") == [LONG.strip()] * 2
        assert text(f"<main><h1>T</h1><div id='{name}'><article><p>{LONG}</p></article></div><p>e</p></main>").split("\n") == ["T", LONG.strip(), "e"]


def test_comments_longer_than_the_story():
    comments = f"<section class='comments'>{f'<article><p>{SECOND}</p></article>' * 8}</section>"
    assert text(f"<body><article><p>{LONG}</p>{comments}</article></body>") == LONG.strip()
    assert text(f"<body><main><article><p>{LONG}</p></article>{comments}</main></body>") == LONG.strip()
    assert text(f"<body><div><p>{LONG}</p></div>{comments.replace('article', 'div')}</body>") == LONG.strip()


def test_odd_pages():
    assert text(None) == text("") == text("<p> </p>") == text("<script>a</script>") == ""
    assert text("plain text only") == "plain text only"
    assert text("<article><p>cut off in a tag <b") == "cut off in a tag"
    assert text("<article><p>a &lt;b&gt; &#233; &#x41;  \n c</p></div></article>") == "a <b> é A c"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert text(deep) == "x"
    assert text("<article>" + "<p>word" * 20000).count("\n") == 19999


def test_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "n"), (1, "u", "<article>a</article>", None), (None, None, "<article>a</article>", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html.with_main_text(df).collect()) == ["", "a", "a"]
    assert html.with_main_text(df.limit(0)).count() == 0


def test_deep_and_broken_pages_take_linear_time():
    for part in ("<div>x ", "<b>x ", '<p class="x>y ', "<article>x ", '<div class="nav">x y ', "<li>a "):
        start = time.perf_counter()
        html.main_text(part * 50_000)
        assert time.perf_counter() - start < 10
    assert html.main_text('<p class="x>Hello world of text') == "Hello world of text"
