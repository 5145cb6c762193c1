"""Lists within lists, code in lists, and what the formatter leaves alone."""

import pytest

from tessera.operators import site


@pytest.mark.parametrize(
    "text, html",
    [
        ("- a\n- b", "<ul><li>a</li><li>b</li></ul>"),
        ("- a\n  - b\n    - c\n- d", "<ul><li>a\n<ul><li>b\n<ul><li>c</li></ul></li></ul></li><li>d</li></ul>"),
        ("1. a\n   - x\n   - y\n2. b", "<ol><li>a\n<ul><li>x</li><li>y</li></ul></li><li>b</li></ol>"),
        ("3) a\n4) b", '<ol start="3"><li>a</li><li>b</li></ol>'),
        ("- a\n\n  more\n- b", "<ul><li><p>a</p>\n<p>more</p></li><li><p>b</p></li></ul>"),
        ("- a\n  ```py\n  x = 1\n    y\n  ```\n- b", '<ul><li>a\n<pre><code class="language-py">x = 1\n  y</code></pre></li><li>b</li></ul>'),
        ("- a\nlazy\n\nafter", "<ul><li>a lazy</li></ul>\n<p>after</p>"),
        ("- a\n* b", "<ul><li>a</li></ul>\n<ul><li>b</li></ul>"),
        ("> - a\n>   - b", "<blockquote><ul><li>a\n<ul><li>b</li></ul></li></ul></blockquote>"),
        ("- a\n\n---\n- b", "<ul><li>a</li></ul>\n<hr>\n<ul><li>b</li></ul>"),
        ("- > q\n- # h", '<ul><li><blockquote><p>q</p></blockquote></li><li><h1 id="h">h</h1></li></ul>'),
    ],
)
def test_lists(text, html):
    assert site.render(text) == html


def test_query_blocks_keep_their_form():
    block = "<!-- sparql:start -->\n```sparql\nSELECT  ?x\n\n\n```\n|a|b |\n|-|-|\n<!-- sparql:end -->"
    assert site.formatted(f"#  A  #\n\n\n{block}\n\n\n|a|b |\n") == f"# A\n\n{block}\n\n| a | b |\n"


def test_code_is_found_line_by_line():
    from tessera.functions import markdown as md
    from tessera.operators import documents

    text = "a `x` b ``y ` z``\n~~~\n---\n[[w]]\n~~~~\nafter [[q]]\n```\n---\n[[never closed]]"
    assert [text[a:b].rstrip("\n") for a, b in md.code(text)][:3] == ["`x`", "``y ` z``", "~~~"]
    assert documents.wiki_link_lines(text) == [6] and documents.break_lines(text) == []
    assert [m[0] for m in md.mentions("See `Blue Sky` and Blue Sky.\n~~~\nBlue Sky\n~~~\n", {"blue sky": "b"}, "a")] == ["Blue Sky"]
    assert site.inline("``a`b``", "", "pretty") == "<code>a`b</code>"
