"""Main text of hand-made pages whose layouts no given page has."""

import re
import zlib
from collections import Counter

import pytest

from blockalloc.llm import html_text as H

S = [
    "Thheouble heenwh on reti ingeser erster that.",
    "Anha, the of, are haedre anti the a theaatnd or it ing thshst the thsh the erntea.",
    "Re at onwh retien of and ershen for inoning. Ouwh anedinst atention it the ble ofesheen the.",
    "Ing a haenble of, thaterin on es restes onrend erthrest that of. Is innt esennt erorer anlyansh from.",
    "Nicht aulich für sch erüver enau sch der. En laleenéelle la des et. Enmentai.",
]
HEAD, *REST = S
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in REST)
LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact us</a></li></ul>'
LAYOUTS = {
    "bare paragraphs": (f"<p>{S[1]}</p><p>{S[2]}</p>", S[1:3]),
    "one paragraph": (f"<p>{S[3]}</p>", S[3:4]),
    "no markup": ("\n".join(S), S),
    "body only": (f"<body><h1>{HEAD}</h1>{PARAGRAPHS}</body>", S),
    "table": (f"<html><body><table><tr><td>{LINKS}</td><td><h1>{HEAD}</h1>{PARAGRAPHS}</td></tr></table></body></html>", S),
    "german names": (f'<html><body><div class="kopf">{LINKS}</div><div class="inhalt"><h1>{HEAD}</h1>{PARAGRAPHS}</div><div class="fuss">&copy; 2020 <a href=#>Impressum</a></div></body></html>', S),
    "line breaks": (f"<html><body><div>{'<br><br>'.join(S)}</div></body></html>", S),
    "boxes": (f'<html><body><nav>{LINKS}</nav><div id="x1">{"".join(f"<div>{x}</div>" for x in S)}</div></body></html>', S),
    "sections of main": (f"<html><body><header>{LINKS}</header><main><section><h2>{HEAD}</h2><p>{S[1]}</p></section><section><p>{S[2]}</p><p>{S[3]} {S[4]}</p></section></main><footer>All rights reserved</footer></body></html>", S),
    "columns": (f'<html><body><div class="wrap"><div class="col8"><h1>{HEAD}</h1>{PARAGRAPHS}</div><div class="col4">{LINKS}<div class="ad">Buy now and save</div></div></div></body></html>', S),
    "quotes and lists": (f"<html><body><h1>{HEAD}</h1><blockquote>{S[1]}</blockquote><p>{S[2]}</p><ul><li>{S[3]}</li><li>{S[4]}</li></ul></body></html>", S),
    "comments below": (f'<html><body><div id="post"><p>{S[0]} {S[1]}</p><p>{S[2]}</p><p>{S[3]} {S[4]}</p></div><div id="comments"><div class="comment"><b>Joe</b><p>Nice one this is.</p></div></div></body></html>', S),
}


@pytest.fixture(scope="module")
def model(spark, data):
    return H.fit(spark.read.parquet(f"{data}/pages.parquet"))


def likeness(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return 2 * (a & b).total() / max(1, a.total() + b.total())


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_keep_their_text(model, name):
    source, want = LAYOUTS[name]
    got = H.texts_of_pages([source], *model)[0]
    assert likeness(got, " ".join(want)) >= 0.9, got


def test_rebuilt_pages(spark, data, model):
    scores = []
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        source, whole = H.rebuilt(r.html, zlib.crc32(r.html.encode()) + 777)
        page = H.Page(source)
        y = H.labels_of(page, whole)
        want = " ".join(t for b, t in page.segments() if y[b] == 1)
        shown = re.sub(r' data-x class="marked"', "", source).replace('class="marked ', 'class="').replace(' class="marked"', "")
        scores.append(likeness(H.texts_of_pages([shown], *model)[0], want))
    assert sum(x > 0.9 for x in scores) >= 0.9 * len(scores) and scores.count(0.0) <= 0.02 * len(scores)


def test_pages_of_nothing_but_links_are_empty(model):
    assert H.texts_of_pages([f"<html><body><nav>{LINKS}</nav><footer>&copy; 2020</footer></body></html>", "", "<script>x</script>"], *model) == ["", "", ""]
