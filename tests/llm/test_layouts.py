"""The block tagger on pages written and labelled by hand, which no template made."""

import pytest

from cinemill.llm import htmlcrf
from cinemill.llm.htmlpages import Maker, labelled_pages
from tests.llm.layouts import LAYOUTS


@pytest.fixture(scope="module")
def field():
    return htmlcrf.tagger(labelled_pages())


def test_hand_labelled_layouts(field):
    found = {name: htmlcrf.main_text(html, field) for name, (html, _) in LAYOUTS.items()}
    wrong = [name for name, (_, wanted) in LAYOUTS.items() if found[name] != "\n".join(wanted)]
    assert len(LAYOUTS) >= 20 and len(wrong) <= 1, wrong
    for name, (_, wanted) in LAYOUTS.items():  # nothing of an article is lost
        assert set(wanted) <= set(found[name].split("\n")), name


def test_layouts_that_were_not_trained_on(field):
    maker = Maker(4321)
    wrong = total = 0
    for html, labels in (maker.wild() for _ in range(150)):
        blocks = htmlcrf.leaf_blocks(html)
        assert [b[0] for b in blocks] == [t for t, _ in labels]
        got = field.decode([htmlcrf.features(blocks, k) for k in range(len(blocks))])
        wrong += sum(a != b for a, (_, b) in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong < 0.03 * total


def test_ties_and_long_pages(field):
    assert htmlcrf.main_text("", field) == "" and htmlcrf.main_text("<nav><a href=/>Home</a></nav>", field) == ""
    html, wanted = LAYOUTS["nav_and_footer"]
    body = "".join(f"<p>{w}</p>" for w in wanted[1:])
    long = html.replace(f"<p>{wanted[1]}</p>", body * 3000, 1)
    text = htmlcrf.main_text(long, field)
    assert text.count(wanted[1]) == 3000 and "Sport" not in text
