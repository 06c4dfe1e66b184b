import gzip
import time

from pyspark.sql import functions as F

from timeloom.llm.warc import boundaries, deduplicate, read_archives, unpack, write_archives

PAGES = "page_id long, url string, html string"


def record(body: bytes, **fields) -> bytes:
    head = b"WARC/1.1\r\n" + b"".join(f"{k.replace('_', '-')}: {v}\r\n".encode() for k, v in fields.items())
    return head + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_round_trip(spark, tmp_path):
    inner = record(b"not a record " * 9, WARC_Type="response", WARC_Record_ID="<urn:page:99>").decode()
    pages = [(1, "http://a/\r\nb", "x" * 120), (2, None, "x" * 120), (3, "u", "é" * 60), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", None), (7, "u", ""), (8, "u", inner), (9, "u", inner), (10, "u", "WARC/1.1\r\n" * 30), (2, None, "x" * 120)]
    frame = spark.createDataFrame(pages, PAGES).repartition(3)
    path = f"{tmp_path}/warc"
    write_archives(deduplicate(frame), path)
    got = read_archives(spark, path, payload=True).collect()
    assert len(got) == len(pages)
    for r in got:
        html = next(h for i, _, h in pages if i == int(r.id)) or ""
        assert r.bytes == len(html.encode())
        if r.record_type == "response":
            assert bytes(r.payload).decode() == html
    kinds = {int(r.id): (r.record_type, r.refers_to) for r in got}
    assert kinds[1] == ("response", None) and kinds[2] == ("revisit", "1") and kinds[3] == ("response", None)
    assert kinds[4][0] == kinds[5][0] == kinds[6][0] == kinds[7][0] == "response"
    assert kinds[9] == ("revisit", "8") and 99 not in kinds
    assert next(r.url for r in got if r.id == "1") == "http://a/%0D%0Ab"


def test_foreign_files_plain_and_packed_by_record(spark, tmp_path):
    parts = [record(f"body {i}".encode(), WARC_Type="response", WARC_Record_ID=f"<urn:page:{i}>") for i in range(300)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes(b"".join(parts))
    (tmp_path / "in/b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[:20]))
    (tmp_path / "in/c.warc").write_bytes(parts[0] + b"WARC/1.1\r\nContent-Length: 999999\r\n\r\ncut off")
    (tmp_path / "in/d.warc").write_bytes(b"junk" + parts[0])
    n = {}
    for r in read_archives(spark, str(tmp_path / "in")).collect():
        n[r.file[-6:]] = n.get(r.file[-6:], 0) + 1
    assert n == {"a.warc": 300, "arc.gz": 20, "c.warc": 1}


def test_empty_table_and_null_ids(spark, tmp_path):
    assert deduplicate(spark.createDataFrame([], PAGES)).count() == 0
    got = deduplicate(spark.createDataFrame([(None, "u", "y" * 200), (None, "u", "y" * 200)], PAGES).drop("url")).collect()
    assert [r.record_type for r in got] == ["response", "response"]


def test_only_closed_records_are_stepped_over_and_only_right_digests_returned(spark, tmp_path):
    make = lambda i, **more: record(f"body {i}".encode(), WARC_Type="response", WARC_Record_ID=f"<urn:page:{i}>", **more)
    (tmp_path / "in").mkdir()
    wrong = make(2, WARC_Payload_Digest="sha256:" + "0" * 64)
    (tmp_path / "in/a.warc").write_bytes(make(1) + wrong + make(3))
    # Its end is not where the second record's length says: what stands there is no record's start.
    (tmp_path / "in/b.warc").write_bytes(make(1) + make(2)[:-4] + make(3))
    (tmp_path / "in/c.warc").write_bytes(b"")
    got = sorted((r.file[-6:], r.id) for r in read_archives(spark, str(tmp_path / "in")).collect())
    assert got == [("a.warc", "1"), ("a.warc", "3"), ("b.warc", "1")]


def test_padded_cut_and_damaged_members():
    one, two = gzip.compress(b"one " * 50_000), gzip.compress(b"two")
    assert unpack(one + two) == b"one " * 50_000 + b"two" == unpack(one + two + bytes(512))
    assert unpack(two + one[: len(one) // 2]).startswith(b"twoone one ")
    assert unpack(two + one[:12] + b"\xff" * 40).startswith(b"two")


def test_files_are_bounded_and_long_payloads_come_back(spark, tmp_path):
    pages = [(i, "u", str(i) * 60) for i in range(1000, 1300)] + [(1, "u", "long " * 400_000)]
    path = f"{tmp_path}/warc"
    rows = spark.createDataFrame(pages, PAGES).withColumn("digest", F.lit("clash")).coalesce(1)
    write_archives(deduplicate(rows), path, mean_bytes=240, file_bytes=6400)
    assert len(list((tmp_path / "warc").glob("*.gz"))) >= 30
    assert {(int(r.id), r.bytes) for r in read_archives(spark, path).collect()} == {(i, len(h)) for i, _, h in pages}


def test_magic_in_payloads_costs_no_more_than_its_length():
    fakes = b"".join(b"WARC/1.1\r\nContent-Length: 19000000\r\n\r\n" for _ in range(2000))
    body = fakes + b"x" * 20_000_000
    data = record(body, WARC_Type="response")
    begun = time.perf_counter()
    found = list(boundaries(data))
    # Magic without any end of a header, and with one end for all.
    open_ended = list(boundaries(b"WARC/1.1\r\n" * 300_000))
    shared = list(boundaries(b"WARC/1.1\r\n" * 300_000 + b"Content-Length: 3\r\n\r\nabc\r\n\r\n"))
    assert time.perf_counter() - begun < 4
    assert found == [(0, len(data))] and not open_ended and len(shared) == 300_000


def test_odd_lengths_are_no_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = record(b"body", WARC_Type="response", WARC_Record_ID="<urn:page:1>")
    for i, length in enumerate((b"9" * 5000, "\u00b2".encode(), b"", b"-4", b"4 4")):
        (tmp_path / f"in/{i}.warc").write_bytes(good + b"WARC/1.1\r\nContent-Length: " + length + b"\r\n\r\nbody\r\n\r\n")
    assert [r.id for r in read_archives(spark, str(tmp_path / "in")).collect()] == ["1"] * 5


def test_columns_of_clashing_names_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "z" * 150), (2, "u", "z" * 150), (2, "u", "z" * 150)], PAGES)
    for c in ("id", "payload", "bytes", "digest", "record_type", "refers_to", "salt", "first"):
        rows = rows.withColumn(c, F.lit("clash"))
    path = f"{tmp_path}/warc"
    write_archives(deduplicate(rows), path)
    got = sorted((r.id, r.record_type, r.refers_to, r.bytes) for r in read_archives(spark, path).collect())
    assert got == [("1", "response", None, 150), ("2", "revisit", "1", 150), ("2", "revisit", "1", 150)]
