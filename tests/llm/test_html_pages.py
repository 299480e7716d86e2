"""Pages as they are on the web: scripts with markup in them, broken tags, media, formulas."""

import time

import pytest

from evidentia.llm import html_extraction as H

FIRST, LAST = "First paragraph of this text, it is long enough.", "Last paragraph, with more words in it."


@pytest.fixture(scope="module")
def model():
    return H.default_model()


def article(inner):
    return f"<html><body><nav><a href=/>Home</a></nav><article><p>{FIRST}</p>{inner}<p>{LAST}</p></article><footer>Copyright</footer></body></html>"


@pytest.mark.parametrize(
    "inner, text",
    [
        ("", None),
        ("<script>for(i=0;i<n;i++){x()}</script>", None),
        ("<script>var s = '</div><p>';</script>", None),
        ("<style>a>b{} </p></style>", None),
        ("<video src=a>", None),
        ("<video src=a><p>no</p></video>", None),
        ("<audio controls>", None),
        ("<svg>", None),
        ("<svg><svg><text>no</text></svg><text>no</text></svg>", None),
        ("<template><p>no</p></template>", None),
        ("<iframe src=x>no <p></iframe>", None),
        ("<p>Let <math><mi>x</mi></math> be <object>some text</object> here.</p>", "Let x be some text here."),
        ("<noscript><p>Shown without scripts, word by word.</p></noscript>", "Shown without scripts, word by word."),
        ("<p>I love x <y's> and more of it.</p>", "I love x and more of it."),
        ('<p title="bad>text of a paragraph.</p>', "text of a paragraph."),
        ('<p title="a > b">a < b and c > d, said he.</p>', "a < b and c > d, said he."),
        ("<p title='it is' class=x'y>an odd class, but text.</p>", "an odd class, but text."),
    ],
)
def test_text_of_the_article_is_whole(model, inner, text):
    assert H.main_text(article(inner), model) == "\n".join(x for x in (FIRST, text, LAST) if x)


def test_a_script_before_the_article(model):
    page = f"<script>for(i=0;i<n;i++){{x()}}</script>{article('')}<script>a<b</script>"
    assert H.main_text(page, model) == f"{FIRST}\n{LAST}"


@pytest.mark.parametrize("odd", ["<video>", "<script ", "<svg><svg></svg>", "</p", "<", '<p title="x', "<a b='>", "<script></scrip>", "&#"])
def test_many_broken_tags_take_linear_time(model, odd):
    began = time.perf_counter()
    H.main_text(odd * 20_000, model)
    assert time.perf_counter() - began < 20


def test_held_out_pages(model):
    right = n = 0
    for source, labels in H.labelled_pages(100, seed=99):
        got = H.marginals(H.parse(source), model)
        right += sum((p >= 0.5) == y for p, y in zip(got, labels))
        n += len(labels)
    assert right > 0.97 * n
