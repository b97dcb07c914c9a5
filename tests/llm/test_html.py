import random

from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm.html_text import extract, html_text

CASES = [
    ("<p>One<p>Two <b>bold</b>\n text", "One\n\nTwo bold text"),
    ("<title>T</title><style>p{}</style><script>var t=\"</p>\";</script>a<!-- x --> b", "a b"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>", "- x\n- y\n  - z\n- w"),
    ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
    ("<table><tr><th>Name<th>N<tr><td>apple<td>1<tr><td>fig<td>20</table>", "Name   N\napple  1\nfig    20"),
    ("<table><caption>C</caption><tr><td colspan=2>wide cell here<tr><td>a<td>b</table>", "C\nwide cell here\na  b"),
    ("<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>", "日本  x\nabcd  y"),
    ("<p hidden>no</p><p style='display: none'>no</p><span style=\"color:red;visibility:hidden\">no</span>yes", "yes"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<pre>\n x\n  y</pre>z", " x\n  y\n\nz"),
    ("a&amp;b &lt;c&gt; &eacute; &#65; &nosuch;", "a&b <c> é A &nosuch;"),
    ("x </p> y", "x\n\ny"),
    ("<p>a<div>b</div></p>c", "a\n\nb\n\nc"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
    ("<h1>H</h1>text<hr>more", "H\n\ntext\n\nmore"),
    ("<select><option>a<option>b</select>c <img alt='pic'> <input type=hidden value=q>", "a c pic"),
    ("1 < 2 and 3 > 2 <", "1 < 2 and 3 > 2 <"),
    ("<b><i>x</b>y</i>", "xy"),
    ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"),
    ("<noscript>no</noscript><template>no</template><textarea>yes</textarea>", "yes"),
    ("", ""),
]


def test_layout():
    for html, want in CASES:
        assert html_text(html) == want, html
    assert html_text(None) is None


TABLES = [
    ("<table><td>a<td>b</table>", "a  b"),
    ("<table><tbody><td>a<td>b<tr><td>c</table>", "a  b\nc"),
    ("<table><tr><td>a</tr><td>b</td></table>", "a\nb"),
    ("<table><tr><td>a</td>x<td>b</td></tr>y<tbody>z<p>w</p></tbody></table>", "xyz\n\nw\na  b"),
    ("<table><tr><form><td>a</form><td>b<div>c</table>d", "a  b\n   c\n\nd"),
    ("<table><div>o</div><caption>C</caption><b>p</b><tr><td>a</table>", "o\np\nC\na"),
    ("<table><div hidden>n<td>a</div></table>", "a"),
    ("<table><tr>x<table><td>in</table>", "x\n\nin"),
    ("<table><td>a<table><td>in<td>b</table><td>c</table>", "a      c\n\nin  b"),
    ("<table><colgroup><col>x<tr><td>a</table>", "x\na"),
    ("<td>a<td>b", "a\nb"),
]


def test_no_cell_or_text_of_a_table_is_lost():
    for html, want in TABLES:
        assert html_text(html) == want, html
    assert html_text("<table><td>" * 20_000 + "x").strip() == "x"


SEEN = [
    ("a<math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>\\frac</annotation></math>b", "ax= 1 2 b"),
    ("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd></mtr></mtable></math>", "1 2\n3"),
    ("<svg><title>t</title><defs><text>no</text></defs><path d='M0'/>no<g><text>one<tspan> two</tspan></text><text>three</text></g></svg>z", "one two\nthree\nz"),
    ("<svg><defs/><rect x=1 /><text>y</text><foreignObject><p>f</p></foreignObject></svg>", "y\n\nf"),
    ("<svg><g><text>a<p>b", "a\n\nb"),
    ("<dialog open>yes</dialog><dialog>no</dialog>", "yes"),
    ("<map><p>m</p><area></map>", "m"),
    ("<input type=submit value=Go> <input value=v> <input placeholder=p> <input type=password value=no> <input type=image alt=i>", "Go v p i"),
]


def test_formulas_drawings_dialogs_and_inputs_are_seen():
    for html, want in SEEN:
        assert html_text(html) == want, html
    assert html_text("<svg><g>" * 20_000 + "<text>x") is not None


def test_very_deep_and_very_long_pages():
    assert html_text("<div>" * 20_000 + "x") == "x"
    assert html_text("<ul><li>" * 300 + "x").replace("-", "").split() == ["x"]
    assert len(html_text("<p>" + "word " * 300_000)) == 5 * 300_000 - 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b", "</", "<!--", "-->", "x", " y ", "<br>", "&lt", "<div hidden>", "</div>", "<pre>", "\n", "<ol>", "<dd>", "<a href='q>"]), max_size=30))
def test_any_markup_renders(parts):
    text = html_text("".join(parts))
    assert text == text.rstrip("\n")


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.sampled_from(["aa", "bb ", " cc"]), lambda c: st.tuples(st.sampled_from(["p", "div", "b", "ul", "span", "section"]), st.lists(c, max_size=4)), max_leaves=15))
def test_visible_words_keep_their_order(tree):
    def write(t):
        return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(write, t[1]))}</{t[0]}>"

    def words(t):
        return t.strip() if isinstance(t, str) else "".join(map(words, t[1]))

    assert "".join(html_text(write(tree)).split()) == words(tree)


def test_extract(spark):
    rows = [(i, html) for i, (html, _) in enumerate(CASES)] + [(None, "<p>n"), (900, None), (901, "<p>n"), (901, "<p>n")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, html string, text string, n_lines int")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert extract(pages).count() == len(rows) and extract(pages.where("page_id = -1")).count() == 0
    for i, (_, want) in enumerate(CASES):
        assert (got[i].text, got[i].n_chars, got[i].n_lines) == (want, len(want), len(want.split("\n")) if want else 0)
    assert (got[900].text, got[900].n_chars, got[900].n_lines) == (None, 0, 0)


def test_long_numbers_do_not_fail():
    many = "9" * 5000
    assert html_text(f"<ol start={many}><li>a<li value={many}>b<li value={'0' * 5000}7>c</ol>") == "1. a\n2. b\n7. c"
    assert html_text(f"<table><tr><td colspan={many}>a<td>b<tr><td>c</table>") == "a  b\nc"
    assert html_text(f"&#{many};x<p title='&#{many}'>&#{'0' * 5000}65;") == "�x\n\nA"
    assert html_text("<ol start=-3><li>a</ol><ol start=' 4 '><li>b</ol><ol start=²><li>c</ol>") == "1. a\n\n4. b\n\n1. c"


def _words(rng, n=6):
    return " ".join("".join(rng.choices("abcxyzäß", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, n)))


def _inline(rng, words):
    """Markup of words in which blanks, comments and inline elements change nothing."""
    out = []
    for w in words.split(" "):
        out.append(rng.choice(["{}", "<b>{}</b>", "<i><a href='x>y'>{}</a></i>", "<!-- <p>no -->{}", "<span hidden>no</span>{}", "<script>no</script>{}"]).format(w))
    return rng.choice([" ", "\n\t", "&#32;"]).join(out)


def _end(rng, name):
    return rng.choice(["", f"</{name}>"])


def _block(rng, depth):
    """(markup, lines, whether an empty line stands around it), made side by side from one random model."""
    kind = rng.choice(["p", "div", "h2", "ul", "ol", "table", "pre", "blockquote"] if depth else ["p", "div", "h2"])
    if kind in ("p", "div", "h2"):
        words = _words(rng)
        return f"<{kind}>{_inline(rng, words)}" + (_end(rng, kind) if kind == "p" else f"</{kind}>"), [words], kind != "div"
    if kind == "pre":
        lines = [_words(rng).replace(" ", "  ") for _ in range(rng.randrange(1, 4))]
        return "<pre>\n" + "\n".join(lines) + "</pre>", lines, True
    if kind == "blockquote":
        markup, lines = _page(rng, 0)
        return f"<blockquote>{markup}</blockquote>", ["  " + x if x else x for x in lines], True
    if kind == "table":
        rows = [[_words(rng, 4) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 5))]
        widths = [max(len(r[k]) for r in rows if k < len(r)) for k in range(max(map(len, rows)))]
        body = "".join("<tr>" + "".join(f"<{c}>{_inline(rng, x)}{_end(rng, c)}" for x in r for c in [rng.choice(["td", "th"])]) + _end(rng, "tr") for r in rows)
        return f"<table>{rng.choice(['', '<tbody>'])}{body}</table>", ["  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in rows], True
    first, markup, lines = rng.randrange(1, 12), "", []
    for k in range(rng.randrange(1, 4)):
        words, mark = _words(rng), f"{first + k}. " if kind == "ol" else "- "
        inner, below, _ = (_block(rng, 0) if rng.random() < 0.3 else ("", [], False))
        markup += f"<li>{_inline(rng, words)}" + (f"<div>{inner}</div>" if inner.startswith("<div") else "") + _end(rng, "li")
        lines += [mark + words, *([" " * len(mark) + x for x in below] if inner.startswith("<div") else [])]
    return f"<{kind}" + (f" start={first}" if kind == "ol" else "") + f">{markup}</{kind}>", lines, True


def _page(rng, depth=1):
    markup, lines, before = "", [], None
    for _ in range(rng.randrange(1, 6)):
        part, own, spaced = _block(rng, depth)
        lines += [""] * (before is not None and (spaced or before)) + own
        markup, before = markup + rng.choice(["", "\n", " "]) + part, spaced
    return markup, lines


def test_pages_are_those_of_a_model_that_lays_out_itself():
    rng = random.Random(17)
    for _ in range(1500):
        markup, lines = _page(rng)
        assert html_text(markup) == "\n".join(lines), markup


SPANS = [
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
    ("<table><tr><td>a<td rowspan=3>tall<br>cell<br>here<br>now<td>b<tr><td>c<td>d<tr><td>e</table>", "a  tall  b\nc  cell  d\ne  here\n   now"),
    ("<table><tr><td rowspan=0>x<td>1<tr><td>2<tr><td>3<tbody><tr><td>y<td>4</table>", "x  1\n   2\n   3\ny  4"),
    ("<table><thead><tr><td rowspan=9>h<td>i</thead><tbody><tr><td>j<td>k</table>", "h  i\nj  k"),
    ("<table><tr><td rowspan=2 colspan=2>wide<td>r<tr><td>s<tr><td>aa<td>bb<td>t</table>", "wide    r\n        s\naa  bb  t"),
    ("<table><tr><td>a<td rowspan=2>b<td rowspan=2>c<tr><td>d<tr><td>e<td>f<td>g</table>", "a  b  c\nd\ne  f  g"),
    (f"<table><tr><td rowspan={'9' * 40}>a<td>b<tr><td>c</table>", "a  b\nc"),
]
PARTLY = [
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
    ("<ul style='visibility: hidden'><li>no<li style='visibility: visible'>yes<li>no <i style='visibility:visible'>this</i></ul>", "- yes\nthis"),
    ("a<p style='visibility:collapse'>no</p>b", "ab"),
    ("<p style='visibility:hidden; visibility:visible !important'>yes", "yes"),
    ("<p style='visibility:hidden'><img alt=no><input value=no><img alt=yes style='visibility:visible'>", "yes"),
    ("<div style='display:none'>no<b style='display:block;visibility:visible'>no</b></div>yes", "yes"),
    ("<details><summary>more</summary>no<p>no</details>z", "more\nz"),
    ("<details open><summary>more</summary>yes</details>", "more\nyes"),
    ("<details>no</details><details><p>no<summary>s</summary><summary>no</summary></details>", "s"),
    ("<details><summary>a<details open><summary>b</summary>c</details></summary>no</details>", "a\nb\nc"),
]
FIELDS = [
    ("x<select><option>a<option selected>b</select>y", "x b y"),
    ("<select><option disabled>pick<option>b<option>c</select>", "b"),
    ("<select multiple><optgroup label=G><option>a<option label=B>b</optgroup><option>c</select>z", "G\na\nB\nc\nz"),
    ("<select size=2><option>a<option hidden>no<option>c</select>", "a\nc"),
    ("a<textarea>one &amp; two</textarea>b", "a one & two b"),
    ("<textarea>\nfirst\n  second</textarea>z", "first\n  second\nz"),
    ("<select></select>a<textarea></textarea>b", "a b"),
]


def test_spans_visibility_details_and_fields():
    for html, want in SPANS + PARTLY + FIELDS:
        assert html_text(html) == want, html


def test_tables_with_spans_are_those_of_a_grid():
    """Random grids tiled by cells: each cell's word stands in its column, at its first row."""
    rng = random.Random(23)
    for _ in range(400):
        height, columns = rng.randrange(1, 6), rng.randrange(1, 6)
        owner, cells = {}, []
        for r in range(height):
            for c in range(columns):
                if (r, c) in owner:
                    continue
                tall = rng.randrange(1, height - r + 1)
                wide = 1
                while c + wide < columns and (r, c + wide) not in owner and rng.random() < 0.2:
                    wide += 1
                cells.append((r, c, tall, wide, "".join(rng.choices("abcdef", k=rng.randrange(1, 4 + 2 * (wide == 1))))))
                owner |= {(r + i, c + j): len(cells) for i in range(tall) for j in range(wide)}
        markup = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={t} colspan={w}>{x}" for rr, _, t, w, x in cells if rr == r) for r in range(height)) + "</table>"
        widths = [max([len(x) for _, cc, _, w, x in cells if cc == c and w == 1], default=0) for c in range(columns)]
        drawn = []
        for r in range(height):
            line = ""
            for rr, c, _, _, x in cells:
                if rr == r:
                    line += " " * max(sum(w + 2 for w in widths[:c]) - len(line), 2 if line else 0) + x
            drawn.append((any(rr == r for rr, *_ in cells), line))
        assert html_text(markup) == "\n".join(line for there, line in drawn if there), markup
