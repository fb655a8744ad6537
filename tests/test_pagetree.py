"""The page tree: selectors by lists of tags and classes, and tags in every spelling."""

import time

from pawgrid.operators.pagetree import parse


def walked(node):
    out = []
    for c in node.children:
        if not isinstance(c, str):
            out += [c, *walked(c)]
    return out


def test_selectors_equal_a_walk():
    page = ('<DIV class="a b"><p class="num">1<p class=\'num x\'>2<ul><li class="a">3<li>4<br/><img src="u&amp;v"></ul></div>'
            '<script>if (a<b) "</p>"</script><table><tr><th>k:<td class="a">v<tr><td>w</table></p></ul><dl><dt>t<dd>d</dl>')
    root = parse(page)
    for box in [root, *walked(root)]:
        for tag, need in (("p", {"num"}), ("", {"a"}), ("li", set()), ("div", {"a", "b"}), ("td", set()), ("none", set())):
            want = [n for n in walked(box) if tag in ("", n.tag) and need <= n.classes]
            assert box.all(".".join([tag, *sorted(need)])) == want
            assert box.first(".".join([tag, *sorted(need)])) is (want[0] if want else None)
    assert [n.attrs.get("src") for n in root.all("img")] == ["u&v"]
    assert root.all("script")[0].children == ['if (a<b) "</p>"']


def test_a_selector_does_not_walk_the_page():
    root = parse('<div class="x">t</div>' * 30_000 + '<p class="num">1</p>')
    start = time.process_time()
    assert all(root.first("p.num") for _ in range(500))
    assert time.process_time() - start < 1
