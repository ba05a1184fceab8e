import json

from paperproof.llm import warc as X


def test_links_digests_and_round_trip(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {r.headers["WARC-Record-ID"]: r for r in X.responses(pages).collect()}
    made = X.derivatives(X.responses(pages))
    rows = made.collect()
    assert len(rows) == 2 * len(sources) == 2 * pages.count()
    for r in rows:
        source = sources[r.headers["WARC-Refers-To"]]
        assert all(r.headers[k] == source.headers[k] for k in ("WARC-Date", "WARC-Target-URI"))
        assert r.headers["WARC-Block-Digest"] == X.digest(bytes(r.block))
        if r.warc_type == "metadata":
            about = json.loads(bytes(r.block))
            assert about["payload-digest-agrees"] and about["block-digest-agrees"] and about["warc-headers"] == dict(source.headers)
            assert about["conversion"] in {x.headers["WARC-Record-ID"] for x in rows if x.warc_type == "conversion" and x.headers["WARC-Refers-To"] == about["refers-to"]}
    assert len({r.headers["WARC-Record-ID"] for r in rows}) == len(rows)
    key = lambda r: (r.warc_type, sorted(r.headers.items()), bytes(r.block))
    for compression in ("gzip", "none"):
        X.write_warc(made, str(tmp_path / compression), compression=compression)
        assert sorted(map(key, X.read_warc(spark, str(tmp_path / compression)).collect())) == sorted(map(key, rows))


def test_conversion_text():
    headers, block = {"WARC-Record-ID": "<urn:x>", "WARC-Payload-Digest": "sha1:WRONG"}, b"HTTP/1.0 404 Not Found\r\ncontent-type: text/html; charset=latin-1\r\n\r\n<title>t</title><body><p>caf\xe9 &amp; more<p>two</p><script>no()</script></body>"
    (kind, conv, text), (_, meta, about) = X.derived(headers, block)
    assert kind == "conversion" and text.decode() == "café & more\ntwo" and conv["WARC-Refers-To"] == meta["WARC-Refers-To"] == "<urn:x>"
    got = json.loads(about)
    assert not got["payload-digest-agrees"] and got["http-status"] == "HTTP/1.0 404 Not Found" and got["http-headers"] == [["content-type", "text/html; charset=latin-1"]]


def test_odd_records(spark):
    rows = [("response", None, None), ("response", {}, bytearray(b"no message")), ("request", {"a": "b"}, bytearray(b"x")), ("response", {"WARC-Record-ID": "<i>"}, bytearray(b"HTTP/1.1 200 OK")), ("response", {"WARC-Record-ID": "<i>"}, bytearray(b"HTTP/1.1 200 OK")), (None, None, None)]
    got = X.derivatives(spark.createDataFrame(rows, X.RECORD)).collect()
    assert len(got) == 8 and [bytes(r.block) for r in got if r.warc_type == "conversion"].count(b"no message") == 1
    pages = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x</p>", "t"), (None, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    flat = X.derivative_table(pages).collect()
    assert len(flat) == 6 and len({r.record_id for r in flat}) == 4
    assert X.derivative_table(pages.limit(0)).count() == 0


def test_foreign_files_and_any_bytes(spark, tmp_path):
    """Records written here by hand, a gzip member each, as crawlers write them; then all bytes through our own writer."""
    import gzip

    def record(kind, name, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\ncontent-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    blocks = [b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)), b"", b"WARC/1.0 in a block\r\n\r\n"]
    whole = [record("response", f"r{i}", b) for i, b in enumerate(blocks)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(b"".join(map(gzip.compress, whole)))
    (tmp_path / "in/b.warc").write_bytes(b"".join(whole) + record("response", "cut", b"x" * 99)[:-40])
    got = X.read_warc(spark, str(tmp_path / "in"))
    assert sorted((r.headers["WARC-Record-ID"], bytes(r.block)) for r in got.collect()) == sorted((f"<r{i}>", b) for i, b in enumerate(blocks) for _ in range(2))
    X.write_warc(got, str(tmp_path / "out"))
    key = lambda r: (r.headers["WARC-Record-ID"], bytes(r.block))
    assert sorted(map(key, X.read_warc(spark, str(tmp_path / "out")).collect())) == sorted(map(key, got.collect()))


def test_conversions_against_another_parser(spark):
    """The standard library's HTML parser reads the same words from every page."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            self.out += [] if self.skip else [data]

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.target_uri: r.text for r in X.derivative_table(pages).where("warc_type = 'conversion'").collect()}
    for p in pages.collect():
        parser = Words()
        parser.feed(p.html or "")
        assert "".join(texts[p.url].split()) == "".join("".join(parser.out).split())


def test_odd_charsets_lengths_and_line_breaks():
    for charset in (b"undefined", b"idna", b"punycode", b"a\x00b", b"hex", b"utf-16", b"\xff", b"", b"x" * 999):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=" + charset + b"\r\n\r\n<p>caf\xc3\xa9 \xff x"
        (_, headers, text), _ = X.derived({"WARC-Record-ID": "<i>"}, block)
        assert X.digest(text) == headers["WARC-Block-Digest"]
        if charset not in (b"utf-16", b"punycode"):
            assert text.decode() == "café \ufffd x"
    for length in ("x", "-5", "1e3", "", "٣", "9" * 400):
        assert [r[2] for r in X.parsed(f"WARC/1.1\r\nWARC-Type: a\r\nContent-Length: {length}\r\n\r\nabc\r\n\r\n".encode() + X.serialized("b", {}, b"whole"))] in ([b"", b"whole"], [])
    kind, headers, block = next(X.parsed(X.serialized("response", {"WARC-Target-URI": "http://a/\r\nWARC-Type: x\n\n", "none": None}, b"body\r\n\r\n")))
    assert (kind, headers, block) == ("response", {"WARC-Target-URI": "http://a/%0D%0AWARC-Type: x%0A%0A", "none": ""}, b"body\r\n\r\n")
