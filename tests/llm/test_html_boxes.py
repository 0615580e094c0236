import pytest

from passagebase.llm import html_text

BODY = "<p>" + "The article tells its story at some length here. " * 6 + "</p>"
STORY = ("The article tells its story at some length here. " * 6).strip()


@pytest.mark.parametrize("wrap", ['<div class="layout has-sidebar">{}</div>', '<div class="no-sidebar">{}</div>', '<div class="post with-comments">{}</div>', '<section class="content widget">{}</section>', '<form id="aspnetForm">{}</form>', '<main><div id="page-with-nav">{}</div></main>'])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div>{}</div>"])
def test_boxes_around_the_article_are_not_cut(wrap, inner):
    page = "<html><body><nav>Home News</nav>" + wrap.format('<div class="sidebar">Links to more</div>' + inner.format(BODY)) + '<div class="comments">Nice one</div></body></html>'
    got = html_text.main_text(page, html_text.Weights({}, {"/div": (0, 1), "/nav": (0, 1)}))
    assert STORY in got and "Links" not in got and "Nice" not in got and "Home" not in got


def test_long_comments_beside_an_article_are_cut():
    page = f"<article>{BODY}</article><div class='comments'><article>{BODY * 5}</article></div>"
    assert html_text.main_text(page, html_text.Weights({}, {})) == STORY


def weights(pages):
    total = {}
    for page in pages:
        for what, name, inside in html_text.counted(page):
            total.setdefault((what, name), [0, 0])[0 if inside else 1] += 1
    return html_text.Weights(*({k[1]: tuple(v) for k, v in total.items() if k[0] == what} for what in ("kind", "tag")))


LABELLED = [f'<body><div class="zq">Offer {i}</div><article><h2>Head</h2>{BODY}<div class="related">Part of it</div></article><div id="foot-x">End {i}</div></body>' for i in range(20)]


def test_kinds_are_learned_and_overrule_what_is_known_for_boxes(monkeypatch):
    learned = weights(LABELLED)
    want = f"Head\n{STORY}\nPart of it"
    assert {html_text.main_text(p, learned) for p in LABELLED} == {want}
    for lists in ("NEVER", "BOX_NAMES", "BOX_ROLES", "NEVER_MOST"):
        monkeypatch.setattr(html_text, lists, frozenset())
    assert {html_text.main_text(p, learned) for p in LABELLED} == {want}
    assert all(html_text.main_text(p, html_text.Weights({}, {})) != want for p in LABELLED)


def test_the_scan_leaves_out_text_beside_the_article_that_is_in_no_box():
    learned = weights(LABELLED)
    page = f"<body><b>Some words here</b><article>{BODY}<div class=zq>Offer</div><p>Last.</p></article><div><p>Great post everyone should read</p></div></body>"
    assert html_text.main_text(page, learned) == f"{STORY}\nLast."
    assert "Great" in html_text.main_text(page, html_text.Weights({}, {}))


def test_lists_and_links_in_an_article_stay():
    page = f"<body><nav><ul><li><a>Home</a></li></ul></nav><article>{BODY}<ul><li><a>One</a></li><li>Two</li></ul></article></body>"
    assert html_text.main_text(page, weights(LABELLED)) == f"{STORY}\nOne\nTwo"


def test_paragraphs_of_an_article_stay_whatever_their_class():
    page = f'<body><article>{BODY}<p class="notice">Take notice of this.</p><p class="share-price">It rose.</p>{BODY}</article></body>'
    assert html_text.main_text(page, weights(LABELLED)) == f"{STORY}\nTake notice of this.\nIt rose.\n{STORY}"


def test_every_article_of_a_page_stays():
    page = f"<body><nav>Home</nav><article>{BODY}</article>\n<article>{BODY}</article><div class='ad'>Buy</div><article><p>Short one.</p></article><footer>End</footer></body>"
    assert html_text.main_text(page, weights(LABELLED)) == f"{STORY}\n{STORY}\nShort one."


def test_a_menu_in_no_box_is_left_out_on_pages_that_mark_no_article():
    menu = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(12))
    page = f'<body><div class="top"><ul>{menu}</ul></div><div>{BODY}<p>Read <a href="/x">this page</a> as well.</p></div></body>'
    for learned in (weights(LABELLED), html_text.Weights({}, {})):
        assert html_text.main_text(page, learned) == f"{STORY}\nRead this page as well."


def test_comments_of_readers_within_an_article_are_left_out():
    page = f'<body><article>{BODY}<div class="reactions"><p>Nice one</p></div></article></body>'
    assert html_text.main_text(page, weights(LABELLED)) == STORY


def test_the_first_of_equally_good_stretches_with_its_longest_reach():
    import numpy as np

    best = lambda *scores: html_text.best_stretch(np.array(scores, dtype=float))
    assert best(1, -5, 1) == (0, 1)
    assert best(1, -1, 1, -5, 1) == (0, 3)
    assert best(-1, 2, -2, 0, 2, -3, 2) == (1, 5)
    assert best(0, 0, 3, 0, -9, 3) == (0, 4)
    assert best(-1, 0) == (0, 0)
