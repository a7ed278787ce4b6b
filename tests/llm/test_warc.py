from __future__ import annotations

import gzip
import zlib

from retail_engine.llm.warc import archived, digest_of, inflated, normalise, read_back, record, records, write_monolithic

PAGES = "page_id long, url string, html string, payload string"


def pages(spark, tmp_path, rows):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(*r, "p") for r in rows], PAGES).write.parquet(path)
    return spark.read.parquet(path)


def test_round_trip_with_odd_rows(spark, tmp_path):
    rows = [
        (3, "http://a/\r\nX-Bad: 1", "<p>é\r\n\r\nWARC/1.1</p>"),
        (1, None, "<p>é\r\n\r\nWARC/1.1</p>"),
        (2, "http://b/", None),
        (4, "http://c/", ""),
        (5, "http://d/", "x" * 3_000_000),
        (6, "http://e/", "same id"),
        (6, "http://e/", "same id"),
        (None, "http://f/", "no id"),
        (None, "http://f/", "no id"),
    ]
    back = archived(pages(spark, tmp_path, rows)).collect()
    got = sorted(
        (r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0, r.payload_digest) for r in back
    )
    first, no_id, same = rows[0][2].encode(), digest_of(b"no id"), digest_of(b"same id")
    assert got == sorted(
        [
            (1, len(first), "response", 0, digest_of(first)),
            (3, len(first), "revisit", 1, digest_of(first)),
            (2, 0, "response", 0, digest_of(b"")),
            (4, 0, "revisit", 2, digest_of(b"")),
            (5, 3_000_000, "response", 0, digest_of(b"x" * 3_000_000)),
            (6, 7, "response", 0, same),
            (6, 7, "revisit", 6, same),
            (0, 5, "response", 0, no_id),
            (0, 5, "revisit", 0, no_id),
        ]
    )
    assert {bytes(r.payload) for r in back if r.page_id == 1} == {first}


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(i, "u", "ab") for i in range(3)] + [(i, "u", "abcdef") for i in range(3, 6)]
    files = write_monolithic(pages(spark, tmp_path, rows), str(tmp_path / "out"), least_bytes=5)
    back = read_back(normalise(files, str(tmp_path / "members"))).collect()
    assert sorted(r.page_id for r in back if r.record_type == "response") == [0, 1, 2, 3]


def test_every_record_is_a_member_where_the_index_says(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"page {i} " * (1 + i * 50)) for i in range(40)]
    # A file ends after 20 kB of records, so there are several.
    files = write_monolithic(pages(spark, tmp_path, rows), str(tmp_path / "one"), file_bytes=20_000)
    names = [r.file for r in files.collect()]
    assert len(names) > 1
    for name in names:
        stream = zlib.decompressobj(wbits=31)
        stream.decompress(open(name, "rb").read())
        assert stream.eof and not stream.unused_data  # a single member
    index = normalise(files, str(tmp_path / "many")).collect()
    assert len(index) == 40
    for r in index:
        with open(r.file, "rb") as f:
            f.seek(r.offset)
            whole = gzip.decompress(f.read(r.length))
        headers, block, _ = next(records(iter([whole])))
        assert headers["warc-record-id"] == r.record_id and block.endswith(rows[r.page_id][2].encode())


def test_members_and_pieces_of_any_size_are_read(tmp_path):
    bodies = [record({"WARC-Type": "response"}, b"b" * n) for n in (0, 1, 5_000_000, 17)]
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(bodies[0] + bodies[1]) + b"".join(map(gzip.compress, bodies[2:])))
    with open(path, "rb") as f:
        assert [w for _, _, w in records(inflated(f))] == bodies


def test_empty_table(spark, tmp_path):
    assert archived(pages(spark, tmp_path, [])).count() == 0
