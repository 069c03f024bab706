"""Scripts and styles whose content looks like the start of markup."""

import pytest

from metaloom.llm import dom

REST = "<article><p class='x'>It doesn't end here.</p><p>Second.</p></article><footer>Foot</footer>"


@pytest.mark.parametrize("raw", ["<script>var a = '<!--';</script>", "<script>for (;i<n; // don't\n i++);</script>", '<style>a<b "</style>', "<script>if (a<!b) x</script>", "<script>'<![CDATA[' </script >"])
def test_raw_elements_end_at_their_end_tag(raw):
    got = [(b.text, b.chain) for b in dom.blocks("<body><h1>Head</h1>" + raw + REST)]
    assert got == [(b.text, b.chain) for b in dom.blocks("<body><h1>Head</h1>" + REST)]
    assert [t for t, _ in got] == ["Head", "It doesn't end here.", "Second.", "Foot"]


def test_raw_element_without_end_takes_the_rest():
    assert [b.text for b in dom.blocks("<p>a</p><script>x <p>b</p>")] == ["a"]
