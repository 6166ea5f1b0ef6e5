import pytest

from treeledger.llm import html_text

LONG = "The main text goes on for quite a while so that it wins. "
PARAS = [f"{LONG}Paragraph {k}." for k in range(6)]


@pytest.mark.parametrize(
    "body, expected",
    [
        ('<article><p>a</p><section id="related-work"><h2>Related work</h2><p>b</p></section></article>', ["a", "Related work", "b"]),
        ('<main><h2 id="search">Search trees</h2><p class="notice">Note.</p><div id="share-index">c</div></main>', ["Search trees", "Note.", "c"]),
        ('<article><p>a</p><div class="social-history">b</div><div class="share">c</div><p class="ad">d</p></article>', ["a", "b"]),
        (f'<div class="content"><h2 id="comments-on-it">Head</h2><p>{LONG}</p></div>', ["Head", LONG.strip()]),
        (
            '<div class="top">x</div><div class="content"><h1>Head</h1>'
            + "".join(f'<div class="para">{p}</div>' for p in PARAS[:3])
            + "<ul><li>one<li>two</ul>"
            + "".join(f'<div class="para"><p>{p}</p></div>' for p in PARAS[3:])
            + "</div>",
            ["Head", *PARAS[:3], "one", "two", *PARAS[3:]],
        ),
        (
            '<div class="content"><h1>Head</h1>'
            + "".join(f'<section><h2>Part</h2><div class="para">{p}</div><div class="para">{p}</div></section>' for p in PARAS)
            + '</div><div class="extra">x</div>',
            ["Head", *(x for p in PARAS for x in ("Part", p, p))],
        ),
    ],
)
def test_no_text_is_dropped(body, expected):
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"
    for text in (body, page):
        assert html_text.extract(html_text.read_blocks(text), None).split("\n\n") == expected
