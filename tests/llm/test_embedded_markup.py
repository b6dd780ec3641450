"""Embedded SVG and MathML neither swallow what follows nor lose their text."""

import pytest

from gridloom.llm import html


@pytest.fixture(scope="module")
def model():
    return html.train(html.labelled_pages())


PARA = "All the article text, which goes on for a while. It has more than one sentence."


@pytest.mark.parametrize(
    "tag", ['<svg class="i"/>', "<math/>", "<svg>", '<svg><title/><path d="M0"/></svg>', "<svg><style/></svg>", "<svg viewBox='0 0 1 1'><path d='M0 0'/></svg>", "<select>", "<template>", "<select-x></select-x>"]
)
def test_nothing_is_swallowed(model, tag):
    text = model.extract(f"<html><body><article><h1>Title</h1>{tag}<p>{PARA}</p></article></body></html>")
    assert PARA in text


def test_math_stays_in_its_line(model):
    text = model.extract(f"<article><h1>T</h1><p>{PARA}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be. {PARA}</p></article>")
    assert "Let x=1 be." in text


def test_raw_text_stays_out(model):
    page = f"<article><h1>T</h1><script>var a = '<p>no1</p>';</script><style>no2</style><p>{PARA}</p><select><option>no3</select><template><p>no4</p></template><iframe>no5</iframe></article>"
    text = model.extract(page)
    assert PARA in text and "no" not in text.replace(PARA, "")
