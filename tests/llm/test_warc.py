import base64
import hashlib
import html
from html.parser import HTMLParser

import pytest

from kinprint.llm import registry, warc


class Shown(HTMLParser):
    """A slow reader of the shown text."""

    BLOCKS = set(
        "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li "
        "main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
    )

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.hidden = [""], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template"):
            self.hidden += 1
        elif tag in self.BLOCKS:
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template"):
            self.hidden = max(0, self.hidden - 1)
            self.lines[-1] += " "
        elif tag in self.BLOCKS:
            self.lines.append("")

    def handle_comment(self, data):
        self.lines[-1] += " "

    def handle_data(self, data):
        if not self.hidden:
            self.lines[-1] += data


def shown(text):
    reader = Shown()
    reader.feed(text)
    reader.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in reader.lines) if x)


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = registry.op3_warc_derivatives(spark, sf).collect()
    assert len(got) == 2 * len(pages) and all(r["intact"] for r in got)
    sources = {k: warc.parse(warc.response(str(k), r["url"], r["html"].encode()))[0] for k, r in pages.items()}
    for r in got:
        page = pages[r["page_id"]]
        assert r["refers_to"] == dict(sources[r["page_id"]])["WARC-Record-ID"] != r["record_id"]
        assert r["target_uri"] == page["url"] and r["source_digest"] == sha1(page["html"].encode())
        if r["kind"] == "conversion":
            assert r["block_sha256"] == hashlib.sha256(shown(page["html"]).encode()).hexdigest()
    assert len({r["record_id"] for r in got}) == len(got)


def test_metadata_keeps_source_headers_and_links():
    body = b'<html lang="de"><title>A &amp; B</title><a class=x href="/q?a=1&amp;b=2">l</a><a href=\'z\'>m</a>text'
    raw = warc.response("1", "http://e.org/", body)
    headers, block = warc.parse(warc.derive(raw)[0][1])
    lines = block.decode().split("\r\n")
    for line in ("http-status: HTTP/1.1 200 OK", "http-content-type: text/html; charset=utf-8", f"payload-digest: {sha1(body)}", "payload-digest-matches: yes", "title: A & B", "language: de", "outlink: /q?a=1&b=2", "outlink: z"):
        assert line in lines
    assert warc.header(headers, "WARC-Date") == warc.DATE


@pytest.mark.parametrize("text", ["", "a<b", "x<p>y</P >z<br/>q", "<script>var a='</p>'</script>ok", "<b>bo</b>ld &lt;p&gt; &nbsp; &eacute;", "<pre>a\n b</pre>", "a<!-- <p> -->b", "<div title=x>1</div><style>p{}</style>2"])
def test_text_against_a_slow_reader(text):
    assert warc.plain_text(text) == shown(text)


def test_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>x"), (2, "u", ""), (4, "u\r\nWARC-Type: evil", "y" * 300_000), (5, "ü", "ok ☃")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, kind string")
    made = warc.derivatives(warc.responses(df))
    got = warc.summaries(made).collect()
    assert len(got) == 12 and all(r["intact"] for r in got)
    assert [r["target_uri"] for r in got if r["key"] == 1] == [None, None]
    assert {r["n_bytes"] for r in got if r["key"] == 4 and r["kind"] == "conversion"} == {300_000}
    assert warc.derivatives(warc.responses(df.filter("false"))).count() == 0
    odd = warc.record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:x>")], b"GET / HTTP/1.1\r\n\r\n")
    assert [k for k, _ in warc.derive(odd)] == ["metadata"]
    binary = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:y>"), ("WARC-Payload-Digest", "sha1:WRONG")], b"HTTP/1.1 404 No\r\nX: y\r\n\r\n\xff\xfe<p>a")
    (_, meta), (_, text) = warc.derive(binary)
    assert b"payload-digest-matches: no" in meta and b"http-x: y" in meta and "��\na".encode() in text
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort")
    assert html.unescape("&amp;") == "&"
