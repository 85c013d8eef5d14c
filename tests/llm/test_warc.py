"""WARC archives: round trip, revisits, rolling, same bytes in every run, commit."""

import gzip
import hashlib
import os

import pytest

from lightloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, shard int, mark boolean"


def pages():
    long = "<p>é text " * 200
    rows = [(k, f"http://h/{k}", f"<html>{k}" + "x" * (k * 37 % 4000)) for k in range(60)]
    rows += [(100 + k, "http://copy/", long) for k in range(40)] + [(None, None, long), (7, "http://h/7?again", long), (139, "http://same/", long)]
    rows += [(200 + k, None, "short") for k in range(5)] + [(300, "u\r\nX: 1", None), (301, "", ""), (302, "é", None), (-5, "n", "\r\n\r\nWARC/1.1\r\n\r\n")]
    rows += [(None, "a", "y" * 1000), (None, "b", "y" * 1000), (400, "a", "z" * 1000), (401, "b", "z" * 1000), (402, "a", "w" * 999), (403, "b", "w" * 999)]
    return rows + [rows[20]] * 2


def brute(rows):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "").encode() == payload and i is not None]
        again = len(payload) >= 1000 and bool(ids) and (page_id is None or page_id < max(ids))
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, None) for r in rows], SCHEMA)


def test_report(spark):
    got = warc.warc_report(frame(spark, pages()))
    assert tuple(got.columns) == warc.REPORT and sorted(map(tuple, got.collect()), key=str) == brute(pages())


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    rows = pages()[:n]
    assert sorted(map(tuple, warc.warc_report(frame(spark, rows)).collect()), key=str) == brute(rows)


def _bytes(path):
    folder = f"{path}/data"
    return {n: open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if not n.startswith(".")}


def test_files_roll_and_repeat(spark, tmp_path):
    """Files are whole gzip files of whole records in the order of page_id; another cut of the input gives the same bytes."""
    rows = pages()
    manifest = warc.write_warc(frame(spark, rows), f"file://{tmp_path}/a", shard_bytes=30_000, file_bytes=2000).collect()
    warc.write_warc(frame(spark, rows[::-1]).repartition(7), f"{tmp_path}/b", shard_bytes=30_000, file_bytes=2000)
    first = _bytes(f"{tmp_path}/a")
    assert first == _bytes(f"{tmp_path}/b") and len({r.shard for r in manifest}) > 3 and max(r.roll for r in manifest) > 1
    assert {r.file for r in manifest} == set(first) and sum(r.records for r in manifest) == len(rows)
    ids = []
    for r in sorted(manifest, key=lambda r: r.file):
        data = first[r.file]
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.count(b"WARC-Record-ID: ") == r.records + 1
        ids += [int(x.split(b"\r\n")[0]) for x in text.split(b"\r\nPage-Id: ")[1:]]
    assert ids == sorted(ids)
    back = warc.read_warc(spark, f"{tmp_path}/a", with_payload=True).collect()
    want = {(i, (h or "").encode()) for i, _, h in rows}
    assert {(r.page_id, bytes(r.payload)) for r in back if r.record_type == "response"} <= want
    assert {(r.page_id, r.url) for r in back} == {(i, u if u is None else u.replace("\r\n", "%0D%0A")) for i, u, _ in rows}
    assert sorted(map(tuple, warc.read_warc(spark, f"{tmp_path}/b").select(*warc.REPORT).collect()), key=str) == brute(rows)


def test_revisits_name_their_response(spark, tmp_path):
    warc.write_warc(frame(spark, pages()), f"{tmp_path}/w")
    records = [x for data in _bytes(f"{tmp_path}/w").values() for x in gzip.decompress(data).split(b"WARC/1.1\r\nWARC-Type: ")]
    field = lambda x, name: x.split(name + b": ")[1].split(b"\r\n")[0]
    made = {field(x, b"WARC-Record-ID") for x in records if x.startswith(b"response")}
    again = [x for x in records if x.startswith(b"revisit")]
    assert len(again) == 42 and all(field(x, b"WARC-Refers-To") in made for x in again)


def test_damage_and_missing_manifest(spark, tmp_path):
    path = f"{tmp_path}/d"
    warc.write_warc(frame(spark, pages()), path)
    name = next(iter(_bytes(path)))
    data = bytearray(open(f"{path}/data/{name}", "rb").read())
    data[len(data) // 2] ^= 1
    open(f"{path}/data/{name}", "wb").write(bytes(data))
    with pytest.raises(Exception, match="zlib|manifest|damaged|error"):
        warc.read_warc(spark, path).collect()
    fields, block = warc.parse_record(warc.page_record(1, "u", b"abc"))
    assert fields["page-id"] == "1" and block.endswith(b"\r\n\r\nabc")
    with pytest.raises(ValueError):
        warc.parse_record(warc.page_record(1, "u", b"abc").replace(b"abc", b"abd"))


def test_commit_can_be_repeated(spark, tmp_path):
    """A commit that was cut off between its files is done again; a lost file is an error."""
    folder = f"{tmp_path}/data"
    os.makedirs(f"{folder}/_temporary")
    open(f"{folder}/_temporary/a.1", "w").write("aa")
    open(f"{folder}/b", "w").write("bb")
    rows = [("a", 0, 0, 1, 2, "", 1, 1, f"{folder}/_temporary/a.1"), ("b", 0, 1, 1, 2, "", 1, 1, f"{folder}/_temporary/b.1")]
    files = spark.createDataFrame(rows, f"{warc.MANIFEST}, temporary string")
    for _ in range(2):
        assert warc._committed(files, 2, folder).count() == 2
    assert open(f"{folder}/a").read() == "aa" and open(f"{folder}/b").read() == "bb"
    os.remove(f"{folder}/b")
    with pytest.raises(Exception, match="lost"):
        warc._committed(files, 2, folder).collect()
