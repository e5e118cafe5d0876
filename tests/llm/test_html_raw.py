"""Elements whose content isn't text: closed by themselves, left open, and many of them."""

import time

import pytest

from acreline.llm.op4_html import main_text

PARAGRAPHS = [f"Paragraph {i} tells, at some length, of how the oaks were planted; it has commas, points and more than a few words." for i in range(3)]


@pytest.mark.parametrize("tag", ["<svg/>", '<svg width="3"/>', "<math/>", "<noscript>", "<video>", "<canvas>", "<object/>", "<audio>", '<iframe src="x">', "<svg><path/></svg>", "<script>a < b</script>", "<select><option>x</select>", "<template>"])
def test_raw_elements_swallow_no_paragraph(tag):
    page = f"<html><body><nav>Home</nav><article><p>{PARAGRAPHS[0]}</p>{tag}<p>{PARAGRAPHS[1]}</p><p>{PARAGRAPHS[2]}</p></article></body></html>"
    assert main_text(page) == "\n".join(PARAGRAPHS)


def test_raw_content_goes():
    page = f"<article><p>{PARAGRAPHS[0]}</p><noscript>Turn it on, please, now.</noscript><svg><text>A label, drawn.</text></svg><p>{PARAGRAPHS[1]}</p><SCRIPT>if (a > b) {{ c() }}</SCRIPT ><p>{PARAGRAPHS[2]}</p><style>p {{ color: red }}"
    assert main_text(page) == "\n".join(PARAGRAPHS)


def test_many_open_elements_take_time_in_proportion():
    began = time.perf_counter()
    main_text("<article>" + "<video>some words, here.<svg/>" * 40_000)
    assert time.perf_counter() - began < 10
