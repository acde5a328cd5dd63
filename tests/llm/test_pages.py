"""What counts as main text, and what counted templates alone remove."""

import pytest

from hunkline.llm import pages
from tests.llm.cases import prose

STORY = prose(1, 24)
OTHER = prose(2, 14)
S, O = f"<p>{STORY}</p>", f"<p>{OTHER}</p>"


@pytest.mark.parametrize("source, want", [
    ('<main><h1>Story</h1><p>Long story text.</p><article class="card"><p>Teaser</p></article></main>', "Story\nLong story text.\nTeaser"),
    (f'<article>{S}<section class="comment-list">{O}</section></article>', STORY),
    (f'<article>{S}<div id="disqus_thread">{O}</div></article>', STORY),
    (f'<article>{S}<div class="ad-slot">{O}</div></article>', STORY),
    (f'<article>{S}<div class="ad-container">{O}</div></article>', STORY),
    (f'<article>{S}<div class="share-buttons">{O}</div></article>', STORY),
    (f'<article>{S}<div class="adSlot">{O}</div></article>', STORY),
    (f'<div>{S}</div><div class="related-posts">{O}</div>', STORY),
    (f'<div>{S}</div><div class="sidebar-left">{O}</div>', STORY),
    (f'<div>{S}</div><div class="cookie-notice-bar">{O}</div>', STORY),
    (f'<div class="page-header"><p>name</p></div><div>{S}</div>', STORY),
    # more comments than story
    (f'<article>{S}<div class="comments-area">{O * 30}</div></article>', STORY),
    (f'<article>{S}</article><section class="comments"><article class="comment">{O * 30}</article></section>', STORY),
    (f'<article>{S}</article><article class="comment-body">{O * 30}</article>', STORY),
    # names that only seem to tell
    (f'<div class="content-sidebar-wrap">{S}</div>', STORY),
    (f'<div class="no-sidebar">{S}</div>', STORY),
    (f'<div id="search-results">{S}</div>', STORY),
    (f'<body class="has-comments menu-open">{S}</body>', STORY),
    (f'<form><div>{S}</div></form>', STORY),
    # the story is where the prose is
    (f'<div>{S}</div><article class="teaser"><p>Read me</p></article>', STORY + "\nRead me"),
    (f'<main>{S}' + "<article><p>Read this</p></article>" * 9 + "</main>", STORY + "\nRead this" * 9),
    (f'<main><h1>Blog</h1><article>{S}</article><article>{O}</article></main>', STORY + "\n" + OTHER),
    (f'<div>{O}</div><article>{S}</article>', STORY),
])
def test_main_text(source, want):
    assert pages.Page(source).main_text(set()) == want


def test_stored_pages_are_the_parsed_ones():
    page = pages.Page(f"<nav>{O}</nav><main>{S}<div><p>x</p></div></main>")
    again = pages.Page.load(page.dump(), [x[0] for x in page.subtrees])
    keys = {x[0] for x in page.subtrees}
    assert again.subtrees == page.subtrees and again.level == page.level
    for known in (set(), keys):
        assert again.main_text(known) == page.main_text(known)


def _site(i: int, own: str, menu: str = "<nav>{}</nav>") -> str:
    """A page with a menu, bars and comment boxes, inside and outside its article."""
    bar = f"<div><p>{prose(500, 12)}</p><a href='/x'>{prose(501, 2)}</a></div>"
    box = f"<section><h3>{prose(502, 3)}</h3><p>{prose(503, 9)}</p><span>send</span></section>"
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>{prose(510 + k, 1)}</a></li>" for k in range(6)) + "</ul>"
    foot = f"<div><p>{prose(504, 8)}</p></div>"
    return f"<div>{menu}</div>{bar}<article><div>{bar}</div>{own}{box}</article>{box}{foot}"


def test_counted_templates_alone(spark):
    """Without looking at tags and names that declare themselves."""
    rows, want = [], {}
    for i in range(24):
        own = [prose(1000 + i, 40), prose(2000 + i, 30)]
        body = "".join(f"<p>{t}</p>" for t in own)
        if i < 12:
            rows.append((i, f"https://a.example/{i}", _site(i, body)))
        else:  # no article at all
            rows.append((i, f"https://b.example/{i}", _site(i, body).replace("article>", "div>")))
        want[i] = "\n".join(own)
    quoted = prose(3000, 20)  # on a third of the pages of a host: text of each
    for i in range(4):
        rows[i] = (i, rows[i][1], rows[i][2].replace("</article>", f"<p>{quoted}</p></article>"))
        want[i] += "\n" + quoted
    for i in range(30, 34):  # near copies on a host of their own keep their text
        rows.append((i, f"https://c.example/{i}", f"<article><p>{prose(7, 40)}</p><p>{prose(8, 40)}</p><p>read {i} times</p></article>"))
        want[i] = f"{prose(7, 40)}\n{prose(8, 40)}\nread {i} times"
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in pages.extract(df, declared=False).collect()}
    for i in range(4):  # the quote is the last paragraph of the article, before the comment box goes
        assert set(got[i].split("\n")) == set(want[i].split("\n"))
    assert {i: t for i, t in got.items() if i >= 4} == {i: t for i, t in want.items() if i >= 4}
    plain = {i: pages.Page(h, declared=False).main_text(set()) for i, _, h in rows}
    assert all(plain[i] != got[i] for i in range(24))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "https://a.example", f"<p>{STORY}</p>", "x", 2, b"z")],
                               "page_id bigint, url string, html string, HTML string, trees int, parsed binary")
    assert [tuple(r) for r in pages.extract(df).collect()] == [(1, "https://a.example", STORY, len(STORY))]
