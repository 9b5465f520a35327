"""Page tokens and open elements against plain walks over the page and the stack; broken and very long pages."""

from __future__ import annotations

import random
import re
import time

import pytest

from cohortlens.llm import wrappers
from cohortlens.llm.wrappers import BLOCK, CLOSES_P, IMPLIED, VOID

SCOPE = set("html table td th caption button object marquee".split())
CELL_ENDS = set("td th tr tbody thead tfoot table body html".split())


class Walked(list):
    """The stack of open elements by walking it from its top."""

    def start(self, tag):
        if tag in CLOSES_P:
            for k in reversed(range(len(self))):
                if self[k] in SCOPE or self[k] == "p":
                    if self[k] == "p":
                        del self[k:]
                    break
        ends, stops = IMPLIED.get(tag, ((), ()))
        for k in reversed(range(len(self) if ends else 0)):
            if self[k] in ends:
                del self[k:]
                break
            if self[k] in stops or tag in ("li", "dt", "dd") and self[k] in BLOCK - {"address", "div", "p"}:
                break
        if tag not in VOID:
            self.append(tag)

    def end(self, tag):
        for k in reversed(range(len(self))):
            if self[k] == tag:
                del self[k:]
                return
            if tag not in BLOCK and self[k] in BLOCK or self[k] in ("td", "th") and tag not in CELL_ENDS:
                return


def test_open_elements_equal_a_walk_of_the_stack():
    rng = random.Random(8)
    tags = "p div li ul dl dt dd table tr td th tbody b a span button object h1 article select option optgroup br blockquote html".split()
    for _ in range(1500):
        fast, plain = wrappers.Open(), Walked()
        for _ in range(rng.randint(1, 60)):
            what, tag = rng.choice(["start", "start", "end"]), rng.choice(tags)
            getattr(fast, what)(tag)
            getattr(plain, what)(tag)
            assert list(fast) == list(plain)


def test_tag_ends_equal_the_expression_at_each_place():
    rest = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
    rng = random.Random(9)
    for _ in range(3000):
        page = "".join(rng.choice(["<a", "<b ", "</a", "x", '"', "'", ">", "<", " "]) for _ in range(rng.randint(1, 25)))
        at, kinds = 0, []
        while at < len(page):
            m = re.compile(r"</?([a-z]+)").match(page, at)
            end = rest.match(page, m.end()) if m else None
            if end:
                kinds.append("end" if page[at + 1] == "/" else "start")
                at = end.end()
            else:
                text = re.compile(r"[^<]+|<").match(page, at)
                kinds.append(text[0])
                at = text.end()
        assert [text if kind == "text" else kind for kind, _, _, text in wrappers.tokens(page)] == kinds


def test_broken_pages_keep_their_text():
    assert wrappers.main_text("<p>one<a <b <c") == "one<a <b <c"
    assert wrappers.main_text("<body><p>5 < 6 <!-- gone --> and <script>x<y</script>more") == "5 < 6 and more"
    assert wrappers.main_text("<div>" * 20_000 + "deep") == "deep"


N = 1_000_000


@pytest.mark.parametrize(
    "page",
    ["<a " * (N // 3), '<a "' * (N // 4), "<a \"'" * (N // 5) + ">", "<!" * (N // 2), "<script" * (N // 7), "<" * N, "<div>" * 20_000 + "<li>x</li>" * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<article>x" * 20_000, '<a class="' + "class='" * (N // 7) + '">'],
)
def test_long_broken_pages_take_seconds(page):
    at = time.process_time()
    wrappers.main_text(page)
    assert time.process_time() - at < 8
