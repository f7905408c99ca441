import hashlib

import pytest

from runloom.llm import warc

LONG = "x" * 1200
TRAP = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:runloom:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, None, LONG), (3, "u v\r\nX: y", TRAP * 3), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"),
    (8, "u", "é" * 700 + TRAP), (10, "u", "é" * 700 + TRAP), (None, "u", "no id"), (11, "u", "big" * 40_000), (12, "u", "\r\n\r\nWARC/1.0\r\n\r\n"), (1, "http://a/1", LONG),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")


@pytest.mark.parametrize("split", [1 << 20, 9973, 1999])
def test_round_trip_at_any_split(spark, tmp_path, split):
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark, ROWS).coalesce(2), path)
    got = [tuple(r) for r in warc.read_warc(spark, path, split, with_payload=True).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").collect()]
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        first = max((r[0] for r in ROWS if r[2] == html and r[0] is not None), default=None)
        again = len(data) >= 1000 and i != first
        want.append((i, "revisit" if again else "response", first if again else None, len(data), hashlib.sha1(data).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_payloads_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark, ROWS), path)
    got = {r["page_id"]: r for r in warc.read_warc(spark, path, 300, with_payload=True).where("record_type = 'response'").collect()}
    assert bytes(got[3]["payload"]).decode() == TRAP * 3 and bytes(got[12]["payload"]) == b"\r\n\r\nWARC/1.0\r\n\r\n"
    assert got[9]["url"] is None
    assert b"WARC-Target-URI: u%20v%20%20X:%20y\r\n" in b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))


@pytest.mark.parametrize("url", ["u v\r\nX: y", " lead", "trail ", "50%20+ä\t", "\u00a0nbsp\u2028", "", "http://plain/?a=b%20c+d"])
def test_urls_come_back(spark, tmp_path, url):
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark, [(1, url, "x")]), path)
    assert warc.read_warc(spark, path).first()["url"] == url


def test_equal_digests_are_compared_by_bytes(spark, tmp_path, monkeypatch):
    """With a digest that tells nothing apart, different payloads are noticed."""
    monkeypatch.setattr(warc.F, "sha2", lambda c, n: warc.F.lit("same"))
    with pytest.raises(RuntimeError, match="two different payloads"):
        warc.write_warc(pages(spark, [(1, "u", "a" * 2000), (2, "u", "b" * 2000)]), f"file://{tmp_path}/w")


def test_query(spark, tmp_path):
    pages(spark, ROWS).write.parquet(f"{tmp_path}/pages.parquet")
    out = warc.op8_warc(spark, str(tmp_path))
    assert out.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    assert out.count() == len(ROWS)


def test_a_cut_file_ends_its_chain(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_warc(pages(spark, ROWS).coalesce(1), f"file://{path}")
    part = next(path.glob("part-*"))
    part.write_bytes(part.read_bytes()[:-30])
    (path / f".{part.name}.crc").unlink(missing_ok=True)
    assert warc.read_warc(spark, f"file://{path}", 500).count() == len(ROWS) - 1


def test_headers_of_any_length(spark, tmp_path):
    """A url beyond HEADER_MAX loses neither its own record nor those after it."""
    path, url = f"file://{tmp_path}/w", "http://a/" + "u" * (3 * warc.HEADER_MAX)
    rows = [(1, "u", "one"), (2, url, "two"), (3, url + "b", TRAP), (4, "u", "WARC/1.1\r\n" * 20_000), (5, "u", "five")]
    warc.write_warc(pages(spark, rows).coalesce(1), path)
    got = {r["page_id"]: r for r in warc.read_warc(spark, path, 1 << 19, strict=True).collect()}
    assert {i: (r["url"], r["payload_bytes"]) for i, r in got.items()} == {i: (u, len(h)) for i, u, h in rows}


def test_strict_says_where_a_chain_ends(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_warc(pages(spark, ROWS).coalesce(1), f"file://{path}")
    assert warc.read_warc(spark, f"file://{path}", 500, strict=True).count() == len(ROWS)
    part = next(path.glob("part-*"))
    part.write_bytes(part.read_bytes()[:-30])
    (path / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="before the file's end"):
        warc.read_warc(spark, f"file://{path}", 500, strict=True)


def test_archives_of_any_name(spark, tmp_path):
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:runloom:page:7>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "crawl.warc").write_text(head, newline="")
    for path, names, n in ((tmp_path, None, 1), (tmp_path / "crawl.warc", None, 1), (tmp_path, "part-*", 0)):
        assert warc.read_warc(spark, f"file://{path}", names=names).count() == n


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark, []), path)
    assert warc.read_warc(spark, path).count() == 0


def test_every_cut_finds_the_same_chain():
    """Ranges of any size: followed from the start, their candidates give each record once, and none inside a payload."""
    import io

    one = lambda i, body: f"WARC/1.1\r\nWARC-Record-ID: <urn:runloom:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    data = one(1, b"x") + one(2, TRAP.encode() * 2) + one(3, b"") + one(4, b"WARC/1.WARC/1.")
    size, want = len(data), []
    at = 0
    while at < size:
        want.append(at)
        at = warc._header(io.BytesIO(data), at, size).next
    for step in [*range(1, 40), 97, 300, size]:
        leads = {}
        for start in range(0, size, step):
            leads |= dict(warc._candidates(io.BytesIO(data), start, min(size, start + step), size))
        at, entered = 0, []
        while at < size:
            entered.append(at)
            at = leads[at]
        assert set(entered) <= set(want) and at == size
        walked = [h.at for e in entered for h, *_ in warc._walk(io.BytesIO(data), e, min(size, (e // step + 1) * step), size, False)]
        assert walked == want
