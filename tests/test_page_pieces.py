"""Pages read by their tags against pages that the parser reads as a whole."""

import random

from cairn.sources import dom

PARTS = [
    "<ul>", "</ul>", "<li class='a b'>", "</li>", '<LI id="x" class="lpItem">', "<p>", "</p >", "<div data-x=\"1 &amp; 2\" data-x='3'>", "</div>", "<br>", "<br/>", "<i/>", "<input type=text>", '<input value="a>b">', "<input disabled value=''>",
    "text &lt; &amp;", " \n ", "a &am", "&", "a < b", "<3", "<!-- <p> -->", "<!-- note -->", "<!-->", "<!---->", "<!DOCTYPE html>", "<?php x ?>", "<script>if (a < b) '<p>'</script>", "<script>var a = 1;</script>", "<style>.x{}</style>", "<title>T &amp; t</title>",
    "<title>", "</title>", "<head>", "</head>", "<textarea><p>x</p></textarea>", "</ script>", "</3>", "</p class='x'>", "<a href='x\" y'>", '<a b="c', "<td><tr><th>", "<table>", "</table>", "<noscript>n</noscript>", "<a\nhref=\"u\">", "<a b=\"1\"c=\"2\">", "<x:y z-1='&#x27;'>", "<span>é\xa0ü</span>", "<", ">", "</", "<option>", "<select>",
]


def both(html, monkeypatch):
    got = [x[:7] for x in dom._Page().finish(html)]
    with monkeypatch.context() as m:
        m.setattr(dom._Page, "_read", lambda self, text: False)
        return got, [x[:7] for x in dom._Page().finish(html)]


def test_pieces_and_parser_agree(monkeypatch):
    rng = random.Random(2)
    for n in (1, 2, 3, 5, 8, 13, 30):
        for _ in range(600):
            html = "".join(rng.choices(PARTS, k=n))
            got, want = both(html, monkeypatch)
            assert got == want, html
    for p in PARTS:
        got, want = both(f"<body>{p}x</body>", monkeypatch)
        assert got == want, p


def test_plain_pages_are_read_by_pieces(monkeypatch):
    html = '<!DOCTYPE html><html><head><title>Pack &amp; go</title><style>.x{}</style></head><body><!-- list --><ul><li class="lpItem" id="1"><input value="1,&quot;a&quot;"><b>x</b></li></ul></body></html>'
    fed = []
    real = dom._Page.feed
    monkeypatch.setattr(dom._Page, "feed", lambda self, text: fed.append(text) or real(self, text))
    nodes = dom._Page().finish(html)
    assert not fed and nodes[-3][3] == [("value", '1,"a"')] and nodes[2][5] is None and nodes[3][5] == "Pack & go"
    dom._Page().finish(html + "<script>'<b>'</script>")
    assert len(fed) == 1


def test_pages_dealt_by_their_key_are_not_dealt_again(spark):
    from tests.test_copies import plan

    from cairn.operators.shop_pages import pack_items

    html = '<li class="lpItem"><input type="text" value="cup"><input class="lpNumber" value="1,002 g"><input class="lpNumber" value="3"><i class="lpWorn lpActive"></i></li>'
    pages = spark.createDataFrame([(1, html * 2), (2, html), (3, None), (4, "")], "k long, html string")
    rows = {deal: pack_items(pages, "k", deal=deal) for deal in (True, False)}
    assert plan(rows[True]).count("Exchange") == 1 and "Exchange" not in plan(rows[False])
    for out in rows.values():
        assert sorted(tuple(r) for r in out.collect()) == [(1, 0, "cup", 1002, "3", True, False), (1, 1, "cup", 1002, "3", True, False), (2, 0, "cup", 1002, "3", True, False)]
