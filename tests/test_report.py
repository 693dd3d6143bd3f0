import struct
from xml.etree import ElementTree

import numpy as np

from lensaudit.report import charts, drawings
from lensaudit.report.letters import bitmap
from lensaudit.report.markdown import Section, html_body, html_page, report


def test_markdown_to_html():
    source = "# A & B\n\ntext `c<d` **bold** *it*\n- one\n- two\n\n| k | v |\n| --- | --- |\n| a | `1` |\n```\n<raw> **x**\n```\n### end\n#### four"
    assert html_body(source).splitlines() == [
        "<h1>A &amp; B</h1>", "", "<p>text <code>c&lt;d</code> <strong>bold</strong> <em>it</em></p>", "<ul>", "<li>one</li>", "<li>two</li>", "</ul>", "", "<table>", "<thead><tr><th>k</th><th>v</th></tr></thead>",
        "<tbody>", "<tr><td>a</td><td><code>1</code></td></tr>", "</tbody></table>", "<pre><code>", "&lt;raw&gt; **x**", "</code></pre>", "<h3>end</h3>", "<p>#### four</p>",
    ]
    assert html_body("```\nopen") == "<pre><code>\nopen\n</code></pre>" and html_page("").startswith("<!doctype html>")


def test_report():
    text = report("T", {"a": 1}, [Section("S", [("x", 2)], [("by", ("k|", "v"), [("y", 3)])], ["one"]), Section("E", remark="empty")])
    assert text == (
        "# T\n\n- S\n- E\n- Settings\n\n## S\n\n| fact | value |\n| --- | ---: |\n| x | 2 |\n\nby:\n\n| k\u00a6 | v |\n| --- | ---: |\n| y | 3 |\n\n- one\n"
        "\n## E\n\nempty\n\n## Settings\n\n- a: `1`\n"
    )


def test_charts_of_nothing():
    assert charts.montage([None]) is None and "svg" in charts.scatter("t", []) and "svg" in charts.bars("t", []) and "svg" in charts.boxes("t", [])


def dots(canvas, colour):
    """Where a drawing has a colour: first and last row, first and last column."""
    rows, columns = np.nonzero((canvas == [int(colour[i : i + 2], 16) for i in (1, 3, 5)]).all(2))
    return tuple(int(x) for x in (rows.min(), rows.max(), columns.min(), columns.max()))


def test_shapes_as_pixels():
    made = drawings.Drawing("", (drawings.Box(10, 20, 30, 5, "#4c78a8"), drawings.Dot(60, 40, 5, "#f58518"), drawings.Line(5, 50, 25, 50, "#e45756"), drawings.Box(90, 90, 50, 50, "#54a24b")), 100, 100)
    for scale in (1, 2):
        canvas = made.pixels(scale)
        assert canvas.shape == (100 * scale, 100 * scale, 3)
        assert dots(canvas, "#4c78a8") == (20 * scale, 25 * scale - 1, 10 * scale, 40 * scale - 1)
        assert dots(canvas, "#f58518") == (35 * scale, 45 * scale, 55 * scale, 65 * scale)
        assert dots(canvas, "#54a24b")[1::2] == (100 * scale - 1, 100 * scale - 1)  # what is outside is cut off
        top, bottom, left, right = dots(canvas, "#e45756")
        assert bottom - top == scale - 1 and right - left >= 20 * scale
    half = drawings.Drawing("", (drawings.Dot(5, 5, 2, "#000", opacity=0.5),), 10, 10).pixels(1)
    assert (half[5, 5] == 128).all() and (half[0, 0] == 255).all()


def test_letters_as_pixels():
    upright = drawings.Drawing("", (drawings.Text(10, 20, "L", size=10),), 40, 40).pixels(1)
    drawn = (upright == 0).all(2)
    want = np.zeros((7, 5), bool)
    want[:, 0] = want[6] = True
    assert (drawn[13:20, 10:15] == want).all() and drawn.sum() == 11
    down = (drawings.Drawing("", (drawings.Text(10, 20, "L", size=10, turn=90),), 40, 40).pixels(1) == 0).all(2)
    assert (down[20:25, 10:17] == np.rot90(want, -1)).all() and down.sum() == 11
    for anchor, left in (("end", 4), ("middle", 7)):
        assert np.nonzero((drawings.Drawing("", (drawings.Text(10, 20, "L", anchor, 10),), 40, 40).pixels(1) == 0).any(0))[0].min() // 3 == left // 3
    assert bitmap("").shape == (7, 0) and (bitmap("é") == bitmap("€")).all() and len({bitmap(chr(c)).tobytes() for c in range(32, 127)}) == 95


def test_every_chart_in_both_formats():
    rows = [("a", 3), ("b & <c>", 9)]
    made = [
        drawings.bars("Bars", rows), drawings.histogram_panels("Panels", [("x", [(0, 1, 2), (1, 2, 0), (2, 3, 5)]), ("none", [])]), drawings.boxes("Boxes", [("a", 1, 2, 3, 0, 5), ("b", 2, 2, 2, 2, 2)]),
        drawings.scatter("Names", [(0, 0, "a"), (1, 2, "b"), (None, 1, "a")]), drawings.scatter("Numbers", [(0, 0, 1.0, 5), (1, 2, 3.0, 6)]), drawings.heat_map("Map", ["x", "y"], {("x", "x"): 1.0, ("x", "y"): -0.5, ("y", "x"): None}),
    ]
    for d in made:
        root = ElementTree.fromstring(d.svg())
        assert (int(root.get("width")), int(root.get("height"))) == (d.wide, d.high)
        data = d.png()
        assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (2 * d.wide, 2 * d.high) and (d.pixels() != 255).any()
    top, bottom, left, right = dots(made[0].pixels(1), drawings.PALETTE[0])
    assert (top, bottom) == (40, drawings.HIGH - 46) and left == drawings.EDGE + 1  # the larger bar reaches the top
    assert charts.bars("Bars", rows) == made[0].svg() and "b &amp; &lt;c&gt;: 9" in made[0].svg() and "5 rows" in made[4].svg()
    assert all(drawings.Drawing("t", ()).pixels(1).shape == f("t", []).pixels(1).shape for f in (drawings.bars, drawings.boxes, drawings.scatter))
