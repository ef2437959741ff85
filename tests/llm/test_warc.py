import base64
import hashlib
import io
import zipfile

import pytest

from panelwright.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long"


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("force64", [False, True])
def test_zip_round_trip(force64):
    out = io.BytesIO()
    packer = warc.ZipWriter(out, force64)
    parts = {"a/ü.bin": [b"", b"x" * 70000, b"PK\x05\x06"], "b": [], "c": [b"PK\x05\x06" + bytes(30)]}
    for name, data in parts.items():
        packer.begin(name)
        for d in data:
            packer.write(d)
        packer.end()
    packer.close()
    # another reader agrees with the writer
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {n: b"".join(d) for n, d in parts.items()}
    reader = warc.ZipReader(Source(out.getvalue()))
    assert {n: reader.member(n) for n in reader.members} == {n: b"".join(d) for n, d in parts.items()}
    with pytest.raises(ValueError):
        warc.ZipReader(Source(out.getvalue()[:-30]))


def test_reads_what_another_writer_packed():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("plain", b"abc" * 50)
        z.writestr("packed", b"abc" * 500, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    reader = warc.ZipReader(Source(out.getvalue()))
    assert reader.member("plain") == b"abc" * 50
    with pytest.raises(ValueError, match="stored"):
        reader.member("packed")


def test_records():
    for payload, to in ((b"", None), ("é\r\n\r\nx".encode(), None), (b"abc", 7)):
        record = warc.read_record(warc.write_record(3, 'http://a/"\n', payload, to))
        assert (record.page(), record.payload_bytes, record.page("warc-refers-to")) == (3, len(payload), to)
        assert record.payload == (payload if to is None else None)


def test_round_trip_of_pages(spark, tmp_path):
    rows = [(i, f"http://h/{i}", html, "x", 1) for i, html in enumerate(["a", "b", "a", None, "", "é\r\n\r\n" * 9, "a", "z" * 300000])]
    rows += [(2, "http://h/2", "a", "x", 1), (None, None, "b", None, None), (None, "u", "lone", None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(map(tuple, warc.op5_warc(spark, str(tmp_path)).collect()), key=str)
    first = {}
    for k, _, html, _, _ in rows:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    want = []
    for k, _, html, _, _ in rows:
        data = (html or "").encode()
        to = first.get(html or "")
        again = to is not None and to != k
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", to if again else None))
    assert found == sorted(want, key=str)


def test_payloads_and_small_archives(spark, tmp_path):
    rows = [(i, "u", str(i) * 5000) for i in range(40)]
    df = warc.with_references(spark.createDataFrame(rows, "page_id long, url string, html string"))
    folder = f"file://{tmp_path}/out"
    written = warc.write_archives(df, folder, archive_bytes=300)
    names = written.collect()
    assert len(names) >= 10 and sum(r.records for r in names) == 40
    listed = spark.createDataFrame(names)
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in warc.read_archives(listed, folder, payloads=True).collect()) == [(i, h) for i, _, h in rows]


def test_least_size_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.with_references(df, least=3).collect()} == {1: None, 2: None, 3: None, 4: 3}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op5_warc(spark, str(tmp_path)).count() == 0
