"""The extractor on pages that no generator made."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from pages_by_hand import PAGES  # noqa: E402

from dupscope.llm import html_text  # noqa: E402


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert html_text.texts([page], html_text.trained()) == ["\n".join(want)]


def test_long_and_repeated_pages(spark):
    page, want = PAGES["news with comments"]
    long = page.replace("</article>", "".join(f"<p>{want[1]}</p>" for _ in range(20_000)) + "</article>")
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, long)], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.text) for r in html_text.extract(rows).collect())
    assert got == sorted([("1", "\n".join(want)), ("1", "\n".join(want)), ("None", "\n".join(want + [want[1]] * 20_000))])
