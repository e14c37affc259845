import pytest

from quire.operators import wrappers as W

PAGE = "page_id long, html string"
LONG = "a text that is long enough to be known by"


def back(spark, source, output):
    made = W.restored(spark.createDataFrame([(1, source), (2, None)], PAGE), spark.createDataFrame([(1, output), (2, None)], PAGE)).collect()
    return (made[0].html, made[0].restored) if made else None


@pytest.mark.parametrize(
    ("source", "output", "made"),
    [
        ('<div class="footnote" id="w"><p class="s">x<a id="n1"></a></p></div>', '<p>other<a id="n1"></a></p><i id="q"/>', ('<div class="footnote" id="w"><p class="s">other<a id="n1"></a></p></div><i id="q"/>', 1)),
        ('<div class="f" id="w"><p><a id="n1"></a></p></div>', '<p id="w"><a id="n1"></a></p>', ('<div class="f"><p id="w"><a id="n1"></a></p></div>', 1)),
        (f'<section class="q"><a id="z"></a><blockquote>{LONG}</blockquote></section>', f"<blockquote>{LONG.upper()}⟦PRE-1: x⟧</blockquote>", (f'<section class="q"><blockquote>{LONG.upper()}⟦PRE-1: x⟧</blockquote></section>', 1)),
        (f'<div class="q"><blockquote>{LONG}</blockquote></div>', f"<blockquote>{LONG} x</blockquote>", (f'<div class="q"><blockquote>{LONG} x</blockquote></div>', 1)),
        (f'<div class="q"><p>{LONG}</p></div>', f"<p>{LONG} x</p>", None),
        (f'<div class="q"><ul><li>{LONG}</li></ul></div>', "<ul><li>a text that isn't long enough, or another one</li></ul>", None),
        ('<div class="q"><p>too short</p></div>', "<p>too short</p>", None),
        (f'<div class="q"><p>{LONG}</p></div>', f'<div class="q"><p>{LONG}</p></div>', None),
        (f'<div class="q"><p>{LONG}</p></div>' * 2, f'<div class="q"><p>{LONG}</p></div><p>{LONG}</p><p>{LONG}</p>', (f'<div class="q"><p>{LONG}</p></div>' * 3, 2)),
        (f'<div class="a"><p>{LONG}</p></div><div class="b"><p>{LONG}</p></div>', f"<p>{LONG}</p>", (f'<div class="a"><div class="b"><p>{LONG}</p></div></div>', 2)),
        (f'<div class="note"><p>{LONG}</p></div><div><p>{LONG}</p></div><div class="x">and<p>{LONG}</p></div>', f"<p>{LONG}</p>", None),
        (f'<div class="x"><p>{LONG}<img/></p></div><div class="y"><p>{LONG}</p><p>{LONG}</p></div><div class="z"><pre>{LONG}</pre></div>', f"<p>{LONG}</p><pre>{LONG}</pre>", None),
        (f'<div class="q"><p>{LONG}</p></div>', f"<td><p>{LONG}</td>x", (f'<td><div class="q"><p>{LONG}</div></td>x', 1)),
        (f'<div class="q"><p>{LONG}</p></div>', f"<p>{LONG}", (f'<div class="q"><p>{LONG}</div>', 1)),
        ('<div class="q"><p><b id="n"></b></p></div><div class="r"><blockquote><i id="n"></i></blockquote></div>', '<blockquote class=""><p><b id="n"></b></p></blockquote>', ('<div class="r"><blockquote class=""><div class="q"><p><b id="n"></b></p></div></blockquote></div>', 2)),
        ("", "", None),
    ],
)
def test_wrappers(spark, source, output, made):
    assert back(spark, source, output) == made


def test_many_wrappers(spark):
    """Each block gets its own wrapper, whatever stands between; repeated and null pages don't matter."""
    source = "".join(f'<div class="f"><p>{LONG} {k}</p></div>' for k in range(200))
    output = "".join(f"<p>{LONG} {k}</p>" for k in reversed(range(200)))
    html, n = back(spark, source, output)
    assert n == 200 and html == "".join(f'<div class="f"><p>{LONG} {k}</p></div>' for k in reversed(range(200)))


def test_a_wrapper_is_looked_into_once(spark):
    pages = spark.createDataFrame([(1, "<body><div class='a'><p>x</p></div></body>")], "page_id long, html string")
    assert W.wrapped(pages)._jdf.queryExecution().optimizedPlan().toString().count(" = img") == 1
