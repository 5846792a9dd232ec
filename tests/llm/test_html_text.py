import html
import random
from html.parser import HTMLParser

import pytest

from eventide.llm import html_text as H


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain  text\n here", "plain text here"), ("a<b>b</b> c<i>d</i>", "ab cd"), ("<p>one<p>two", "one\n\ntwo"), ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("<h1>T</h1>a<div>b</div>c", "T\n\na\nb\nc"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<ul><li><p>a</p><p>b</p></ul>", "- a\n\n  b"), ("<pre>\n a\n  b</pre>", " a\n  b"), ("a &amp; b &lt;i&gt; &eacute;", "a & b <i> é"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"), ("<table><td>only</table>", "only"),
        ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", "x  1\n   2"), ("<table><tfoot><tr><td>f</tfoot><tbody><tr><td>b</table>", "b\nf"),
        ("<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>", "日本  x\nabcd  y"), ("<table><tr><td><table><tr><td>p<td>q</table><td>r</table>", "p  q  r"),
        ("<div hidden>n</div><p style='color:red; display : none'>n</p><span style='visibility:hidden'>n</span><i aria-hidden=true>n</i>y", "y"),
        ("<script>if (a < b) '</p>'</script><style>x</style><template>t</template><!-- c --><noscript>n</noscript>y", "y"),
        ("<head><title>t</title></head><body>b</body>", "b"), ("<title>t</title><p>b", "b"), ("<details><summary>s</summary>in</details><details open><summary>s</summary>in</details>", "s\ns\nin"),
        ("<blockquote>q<p>r</blockquote>", "> q\n\n> r"), ("<dl><dt>t<dd>d</dl>", "t\n    d"), ("<img alt='pic'> <input value=v><input type=hidden value=w>", "pic v"), ("a<hr>b", "a\n\n---\n\nb"),
        ("<p title='a > b'>x</p>", "x"), ("</p>a</div> <b>c", "a c"), ("<select><option>o</select>y", "y"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<p>a<!-- never ends", "a"),
        ("<textarea>a &amp; <b></textarea>", "a & <b>"), ("<a>x</a><a>y</a>", "xy"),
    ],
)
def test_layout(page, text):
    assert H.visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tbody><form><tr><td>A</td></tr></form></tbody></table>z", "A\n\nz"), ("<table><tr><form><td>A<td>B</form></table>", "A  B"), ("<table><form><tr><td>A<td>B</form><tr><td>C<td>D</table>", "A  B\nC  D"),
        ("<table><tbody><a name=x><tr><td>A</td></tr></tbody></table>", "A"), ("<table><tr><a name=x><td>A<td>B</table>", "A  B"), ("<table><tbody><div>s</div><tr><td>A</table>", "s\n\nA"),
        ("<table><tbody>stray<tr><td>A</table>z", "stray\n\nA\n\nz"), ("<table><tbody><div>s<tr><td>A</td></tr></div></table>", "s\n\nA"), ("<table><tfoot><b>s</b><tr><td>A</table>", "s\n\nA"),
        ("<table><tr style='display:none'>s<td>A</table>", "s"), ("<table><colgroup><col><tr><td>A</table>", "A"), ("<table><colgroup><col><td>A</table>", "A"), ("<table><colgroup><col>s<tr><td>A</table>", "s\n\nA"),
        ("<table><caption>C<tr><td>A</table>", "C\nA"), ("<table><colgroup><col><caption>C</caption><tbody><tr><td>A</table>", "C\nA"), ("<table><tbody><table><tr><td>A</table>", "A"),
        ("<table><tr><td><template><tr><td>n</template>A</table>z", "A\n\nz"), ("<table><tbody><template><tr><td>n</template><tr><td>A</table>", "A"),
        ("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>n</annotation></math> b", "a x= 1 2 b"), ("<math><mi>x</mi><p>y", "x\n\ny"),
        ("<svg><title>n</title><defs><text>n</text></defs>n<path d='M0'/><g><text>one</text><text>two <tspan>t</tspan></text></g></svg> z", "one two t z"),
        ("<svg/>a<svg><path><p>b", "a\n\nb"), ("<svg><g display=none><text>n</text></g><foreignObject><div>f</div></foreignObject></svg>", "f"), ("<svg><text><![CDATA[a<b]]></text></svg>", "a<b"), ("<svg><style>t{}</style><text>y</svg>z", "y z"),
        ("<dialog>n</dialog><dialog open>y</dialog>", "y"), ("<table><tr><td><svg><path></td><td>B</table>", "  B"),
    ],
)
def test_all_that_browsers_show(page, text):
    assert H.visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<!-->visible<!-- x --> after", "visible after"), ("<!--->a<!-- -- b --!>c", "ac"), ("<p class=it's>Hello there. He said 'hi' ok</p>", "Hello there. He said 'hi' ok"), ('<a href=x"y>z</a> "q"', 'z "q"'),
        ('<p title="unclosed>Hello <b>w</b>', ""), ("a<b", "a"), ("a<img alt='x", "a"), ('<p a="x"b=\'>\'>y', "y"), ("<p/ x = '>' >y</p x='>'>z", "y\n\nz"), ("a<![CDATA[b > c", "a c"),
        ("<div style='visibility:hidden'>n<b style='visibility:visible'>y</b>n<img alt=n></div>z", "y\nz"), ("<ul style='visibility:hidden'><li>n<li style='visibility:visible'>y</ul>", "- y"),
        ("<table><tr style='visibility:collapse'><td>n<tr><td>y</table>", "y"), ("<p style='display:none;display:block'>y<p style='display:none!important;display:block'>n", "y"), ("<p hidden style='display:block'>y", "y"),
        ("<style>.h{display:none} #i, q.x > b { color: red; visibility: hidden }</style><p class='a h'>n</p><p id=i>n<i class=h>n</i><i style='visibility:visible'>y</i></p><q class=x><b>n</b><i><b>z</b></i></q>", "y\n\nz"),
        ("<p class=h>n<p class='h s'>y<style>/* .s{} */ .h{display:none!important} p.h.s{display:block!important} @media print{p{display:none}} @media screen{.n{display:none}} p:hover{display:none}</style><p class=n>n", "y"),
        ("<!-- <style>p{display:none}</style> --><p>y", "y"), ("<style>div span{display:none}</style><div><p><span>n</span>y</p></div><span>z</span>", "y\n\nz"), ("<style>*{display:none</style>n", ""),
        ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"), ("<ol reversed><li>a<li>b<li value=9>c</ol>", "3. a\n2. b\n9. c"), ("<ol reversed start=7><li>a<li>b</ol>", "7. a\n6. b"),
        ("<table><tr><td colspan=20000>a<td>b<tr><td>c<td>d</table>", "a     b\nc  d"), ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>", "a  b\n   c\nd"), ("<table><tr><td rowspan=99999999>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td>d<tr><td colspan=2>e</table>", "a  b  c\n      d\n   e"),
    ],
)
def test_as_browsers_read_it(page, text):
    assert H.visible_text(page) == text


def test_hidden_at_any_depth():
    deep = "<div>" * 600
    assert H.visible_text(f"{deep}<div hidden>n<b>n</b></div>y<i>z</i>") == "yz" and H.visible_text(f"{deep}<p hidden><b>n</p>{'</div>' * 600}y") == "y"
    assert H.visible_text(f"{deep}<b>a<i hidden>n</i>c</b>{'</div>' * 300}d").split() == ["ac", "d"]


def test_spans_take_no_room_of_their_own():
    import tracemalloc

    page = "<table>" + "<tr>" + "<td colspan=1000 rowspan=1000>x" * 1000 + "<tr><td>y" * 1000 + "</table>"
    tracemalloc.start()
    lines = H.visible_text(page).split("\n")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(lines) == 1001 and lines[1].strip() == "y" and most < 50_000_000


def brute_table(rows):
    """Cells by an array of taken places, columns by all lines."""
    taken, put = set(), {}
    for r, row in enumerate(rows):
        k = 0
        for text, across, down in row:
            while (r, k) in taken:
                k += 1
            put[r, k] = text
            taken |= {(r + i, k + j) for i in range(min(down, len(rows) - r)) for j in range(across)}
            k += across
    used = sorted({k for _, k in put})
    wide = {k: max([len(t) for (r, c), t in put.items() if c == k and max((x for q, x in put if q == r)) > used[0]], default=0) for k in used}
    out = []
    for r in range(len(rows)):
        own = {k: t for (q, k), t in put.items() if q == r}
        if own:
            out.append("".join(own.get(k, "").ljust(wide[k] + 2) for k in used if k < max(own)) + own[max(own)])
    return [x.rstrip() for x in out]


@pytest.mark.parametrize("seed", range(40))
def test_cells_in_order_and_aligned(seed):
    rng = random.Random(seed)
    rows = [[("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))), rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 4])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 6))]
    page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}" for t, a, d in row) for row in rows) + "</table>"
    assert H.visible_text(page).split("\n") == brute_table(rows)


def test_blocks_and_lists_in_order():
    """Blocks, items and words come in the order of the page, with the spacing of their kind."""
    for seed in range(40):
        rng, page, want = random.Random(seed), "", []
        for k in range(rng.randint(1, 8)):
            kind = rng.choice(["p", "div", "ul", "ol", "pre"])
            if kind in ("p", "div"):
                page += f"<{kind}>w{k} <b>x</b>\n y{k}</{kind}>"
                block = [f"w{k} x y{k}"]
            elif kind == "pre":
                page += f"<pre>\n  a{k}\n\n b</pre>"
                block = [f"  a{k}", "", " b"]
            else:
                n = rng.randint(1, 3)
                page += f"<{kind}>" + "".join(f"<li>i{k}{j}" for j in range(n)) + f"</{kind}>"
                block = [f"{'-' if kind == 'ul' else f'{j + 1}.'} i{k}{j}" for j in range(n)]
            gap = kind != "div" or (want and want[-1][0] != "div")
            want.append((kind, ([""] if want and gap else []) + block))
        assert H.visible_text(page).split("\n") == [x for _, b in want for x in b]


class Plain(HTMLParser):
    """Visible words by the library's tokenizer, by a count of open hidden elements."""

    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "template") or self.off and tag not in H.VOID or ("hidden", None) in attrs and tag not in H.VOID:
            self.off += 1
        self.out.append(" ") if tag in H.BLOCK or tag == "br" else None

    def handle_endtag(self, tag):
        self.off -= self.off > 0
        self.out.append(" ") if tag in H.BLOCK else None

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def tree(rng, depth=0):
    if depth > 4 or rng.random() < 0.3:
        return html.escape(rng.choice(["alpha ", " be<ta", "ga&mma", " ", "delta"]))
    tag = rng.choice(["div", "p", "b", "i", "ul", "table", "section", "span", "script", "br"])
    hide = " hidden" if rng.random() < 0.15 else ""
    if tag == "br":
        return "<br>"
    if tag == "script":
        return "<script>var x = '<p>';</script>"
    inner = [tree(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if tag in ("p", "b", "i", "span"):
        inner = [html.escape(rng.choice(["one ", "two", " three"])) for _ in range(2)]
    if tag == "ul":
        inner = [f"<li>{x}</li>" for x in inner]
    if tag == "table":
        inner = [f"<tr><td>{x}</td><td>{html.escape('x')}</td></tr>" for x in inner]
    return f"<{tag}{hide}>{''.join(inner)}</{tag}>"


@pytest.mark.parametrize("seed", range(60))
def test_all_visible_words_and_no_others(seed):
    rng = random.Random(seed)
    page = "".join(tree(rng) for _ in range(5))
    plain = Plain()
    plain.feed(page)
    plain.close()
    mine = sorted(w for w in H.visible_text(page).split() if w != "-")
    assert "".join(mine) == "".join(sorted(w for w in "".join(plain.out).split() if w != "-")) or sorted("".join(mine)) == sorted("".join("".join(plain.out).split()))


def test_deep_and_broken_pages():
    assert H.visible_text("<div>" * 20_000 + "x") == "x"
    assert H.visible_text("<ul><li>" * 200 + "x").endswith("- x")
    assert H.visible_text("<" * 10_000) == "<" * 10_000
    assert H.visible_text("<table><tr><td>" * 100 + "x").strip() == "x"


def test_extract_odd(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, "<p>b<p>c"), (2, "v", None), (3, None, ""), (4, "w", "<div hidden>x")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_lines int, text string")
    got = sorted((tuple(r) for r in H.extract_text(df).collect()), key=repr)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "b\n\nc", 3), (2, "v", None, None), (3, None, "", 0), (4, "w", "", 0)], key=repr)
    assert H.extract_text(df.limit(0)).collect() == []
