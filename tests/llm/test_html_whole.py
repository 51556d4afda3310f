"""Pages whose text a class name or one long section must not cost."""

import pytest

from custodia.llm.html_text import main_text

BODY = "<p>One paragraph, with commas, of the text, and more.</p><p>Another, shorter, one.</p>"
TEXT = "One paragraph, with commas, of the text, and more.\nAnother, shorter, one."


@pytest.mark.parametrize("name", ["site has-sidebar", "content no-sidebar", "post social-share-enabled",
                                  "layout with-menu", "content-with-sidebar", "social", "widget page"])
def test_a_name_on_the_container_keeps_the_article(name):
    for attribute in ("class", "id"):
        box = f'<body><div {attribute}="{name}">%s</div><div class="comments"><p>A reader, says.</p></div></body>'
        assert main_text(box % f"<article>{BODY}</article>") == TEXT
        assert main_text(box % f"<div>{BODY}</div>") == TEXT
        assert main_text(f'<article><div {attribute}="{name}">{BODY}</div></article>') == TEXT


def test_boilerplate_still_goes_by_name():
    long_ = "<p>Much, more, said, by, many, readers, here, and, there.</p>" * 9
    for box in ("<article>%s</article>%s", "<main><article>%s</article>%s</main>", "<main>%s</main>%s"):
        page = box % (BODY, f'<div class="comments">{long_}</div>')
        assert main_text(page) == TEXT
    cards = "".join("<article><p>Another, story.</p></article>" for _ in range(2))
    assert main_text(f'<article>{BODY}</article><section class="related">{cards}</section>') == TEXT
    assert main_text(f'<article>{BODY}<p>Say <span class="share">Tweet, this</span>it.</p></article>') == (
        TEXT + "\nSay it.")


def test_short_sections_beside_a_long_one_stay():
    long_ = "".join(f"<p>Paragraph {k}, with commas, of the long, long section, and more.</p>" for k in range(10))
    want = "\n".join(f"Paragraph {k}, with commas, of the long, long section, and more." for k in range(10))
    links = "<ul>" + "".join(f"<li><a href=x>Link {k}</a>" for k in range(5)) + "</ul>"
    page = (f"<body>{links}<div><h1>T</h1><section>{long_}</section><section><p>One short paragraph.</p></section>"
            f"<figure><figcaption>A river</figcaption></figure><ul><li>An item<li>Two</ul>{links}</div></body>")
    assert main_text(page) == f"T\n{want}\nOne short paragraph.\nA river\nAn item\nTwo"
    page = f"<body><div><h1>T</h1><div><div><section>{long_}</section></div></div><div><p>End.</p></div></div></body>"
    assert main_text(page) == f"T\n{want}\nEnd."


@pytest.mark.parametrize("box", ["main", "div"])
def test_headings_and_short_articles_beside_the_article_stay(box):
    page = f"<body><nav><a>x</a></nav><{box}><h1>Title</h1><article>{BODY}</article><h2>More</h2></{box}></body>"
    assert main_text(page) == "Title\n" + TEXT
    short = "<article><p>A short second article.</p></article>"
    assert main_text(f"<body><{box}><h1>Title</h1><article>{BODY}</article>{short}</{box}></body>") == (
        f"Title\n{TEXT}\nA short second article.")


def test_reference_lists_stay_and_menus_go():
    refs = "".join(f"<li>Author {k}, A title of some length, <a href=x>doi {k}</a>, pages {k} to {k + 9}.</li>" for k in range(4))
    menu = "".join(f"<li><a href=x>Link number {k}</a></li>" for k in range(4))
    want = "\n".join(f"Author {k}, A title of some length, doi {k}, pages {k} to {k + 9}." for k in range(4))
    assert main_text(f"<article>{BODY}<h2>References</h2><ol>{refs}</ol><ul>{menu}</ul></article>") == (
        f"{TEXT}\nReferences\n{want}")
    short = "".join(f"<li>No. {k}: <a href=x>a linked title</a>, 2020.</li>" for k in range(4))
    assert "a linked title" in main_text(f"<article>{BODY}<ul>{short}</ul></article>")


@pytest.mark.parametrize("part", ["<b></i>x", "<div>x", "<a ", "<p><b>x", '<a title="', "<!-- <b>", "<script>",
                                  "<ul><li>x", "<span class=share>x", "<td><b>", "</p></div>x", "<p><i><div>x, y"])
def test_hostile_pages_take_seconds(part):
    import time
    source = part * ((1 << 20) // len(part))
    begun = time.monotonic()
    main_text(source)
    main_text(f"<article>{BODY}</article>" + source)
    assert time.monotonic() - begun < 30


def test_deep_and_repeated_pages(spark):
    from custodia.llm.html_text import page_texts
    deep = "<div>" * 3000 + BODY + "</div>" * 3000
    rows = [(1, "u", deep), (1, "u", deep), (2, "u", f"<main>{BODY}</main>")]
    got = page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, TEXT), (1, TEXT), (2, TEXT)]
