from __future__ import annotations

import pytest

from prosemill.llm import htmlmain


@pytest.mark.parametrize("mark", ["class='content-sidebar-wrap'", "class='layout has-sidebar'", "id='search-page'"])
@pytest.mark.parametrize("tag", ["main", "article", "div"])
def test_a_wrapper_does_not_empty_the_page(mark, tag):
    html = f"<body><p>Top</p><div {mark}><{tag}><p>the text of the page</p><div class='share'>share it</div></{tag}><div class='sidebar'>more</div></div></body>"
    got = htmlmain.main_text(html).split("\n")
    assert "the text of the page" in got and not {"share it", "more"} & set(got)


def test_marked_branches_beside_the_article_go():
    html = "<article><p>short</p></article><div class='related'><article><p>a longer teaser of another page</p></article></div><div class='comments'><p>a much longer remark of some reader</p></div>"
    assert htmlmain.main_text(html) == "short"
