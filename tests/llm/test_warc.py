"""Archives of one or several members, cut ones, large records, and members opened by offset alone."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from assayer.llm import warc

PAGES = [
    (1, "https://a.org/x", b"short"), (2, None, b""), (None, "https://a.org/\r\nline", b"\r\n\r\n" * 50), (3, "https://b.org/%", b"WARC/1.1\r\nx: y\r\n\r\n" * 20),
    (4, "u", b"z" * (3 * warc.READ_BYTES + 17)), (5, "https://c.org", "日本é".encode() * 40),
]


def written(pages=PAGES):
    return [warc.record(i, url, payload, None, False) for i, url, payload in pages]


def read(data: bytes) -> list[bytes]:
    return [bytes(r) for r in warc.records(warc.inflated(io.BytesIO(data)))]


@pytest.mark.parametrize("members", [1, 2, 6])
def test_records_are_the_same_however_they_are_compressed(members):
    whole = written()
    groups = [whole[i::members] for i in range(members)] if members == 6 else [whole[: len(whole) // members], whole[len(whole) // members :]]
    data = b"".join(gzip.compress(b"".join(g)) for g in groups if g)
    assert read(data) == [r for g in groups for r in g]


@pytest.mark.parametrize("lost", [1, 9, 200])
def test_a_cut_archive_is_an_error(lost):
    data = gzip.compress(b"".join(written()))
    with pytest.raises(EOFError):
        read(data[:-lost])


def test_an_archive_that_ends_inside_a_record_is_an_error():
    with pytest.raises(EOFError):
        read(gzip.compress(b"".join(written())[:-3]))


def test_members_are_found_by_offset_alone(spark):
    body = "<p>" + "same " * 40
    rows = [(i, f"https://h.org/{i}", body if i % 3 == 0 else f"page {i} " * (i * 3)) for i in range(40)] + [(None, None, None), (7, "https://h.org/again", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.normalise(warc.write(pages, per_file=9))
    for row in index.collect():
        with open(row.path.removeprefix("file:"), "rb") as file:
            file.seek(row.offset)
            whole = gzip.decompress(file.read(row.length))
        (one,) = read(gzip.compress(whole))
        assert one == whole
        headers = warc.headers_of(whole[: whole.index(b"\r\n\r\n")])
        assert headers["warc-type"] == row.record_type
    order = index.orderBy("path", "offset").collect()
    for before, after in zip(order, order[1:], strict=False):
        assert after.offset == (before.offset + before.length if after.path == before.path else 0)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(index).collect())
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = min((i for i, _, h in rows if h == html and i is not None), default=None) if len(data) >= warc.MIN_REVISIT else page_id
        again = first != page_id
        want.append((page_id is None, page_id or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want)
    assert index.select(F.countDistinct("path")).first()[0] >= 5
