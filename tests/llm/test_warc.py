import base64
import hashlib
import time
from pathlib import Path

from helpers import rows_of
from tunelake.llm import warc

SCHEMA = "page_id long, url string, html string, strong string, payload string, bytes int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def brute(rows, least):
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        best = max(groups[html or ""], key=lambda p: (p is not None, p or 0))
        own = page_id == best or len(data) < least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "response" if own else "revisit", None if own else best))
    return sorted(out, key=repr)


ROWS = [(1, "a", "<p>one</p>"), (2, "b\nc", "<p>one</p>"), (3, None, None), (4, "d", ""), (5, "e", "ñ\r\n\r\nWARC/1.1"), (6, "f", "x" * 200_000), (7, "g", "<p>one</p>"), (8, "h", "two"), (None, "i", "two")]


def test_archive_against_brute_force(spark):
    for least in (0, 5):
        assert rows_of(warc.archive_pages(pages(spark, ROWS), least)) == brute(ROWS, least)


def test_header_names_inside_targets(spark, tmp_path):
    ends = ["\x85", "\u2028", "\u2029", "\r", "\n", "\r\n", "\x0b", "\x0c", "\x1c", " "]
    rows = [(n, f"http://a/{end}WARC-Payload-Digest: sha1:AAAA{end}WARC-Refers-To: <urn:page:77>{end}WARC-Type: revisit", f"<p>{n}</p>") for n, end in enumerate(ends)]
    assert rows_of(warc.archive_pages(pages(spark, rows))) == brute(rows, 0)
    warc.write_archive(pages(spark, rows), str(tmp_path / "w"), date="2020-01-02T03:04:05Z")
    for row in warc.read_archive(spark, str(tmp_path / "w")).collect():
        lines = bytes(row["header"]).decode().splitlines()
        assert [line.split(":")[0] for line in lines].count("WARC-Payload-Digest") == 1 and "WARC-Date: 2020-01-02T03:04:05Z" in lines


def test_repeated_rows_keep_their_number(spark):
    rows = [(1, "a", "same")] * 3 + [(0, "b", "same")]
    assert rows_of(warc.archive_pages(pages(spark, rows))) == brute(rows, 0)


def test_payloads_are_stored_once_and_records_are_exact(spark, tmp_path):
    warc.write_archive(pages(spark, ROWS), str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w/payloads"))
    assert stored.count() == len({r[2] or "" for r in ROWS})
    archive = warc.read_archive(spark, str(tmp_path / "w"))
    for row in warc.record_bytes(archive).filter("page_id in (7, 1)").collect():
        head, _, body = bytes(row["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        assert body == (b"<p>one</p>\r\n\r\n" if row["page_id"] == 7 else b"\r\n\r\n")
    warc.export_warc(archive, str(tmp_path / "files"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    assert data.count(b"WARC-Record-ID") == len(ROWS)


def test_damage_is_noticed(spark, tmp_path):
    warc.write_archive(pages(spark, ROWS), str(tmp_path / "w"))
    payloads = spark.read.parquet(str(tmp_path / "w/payloads")).selectExpr("strong", "cast('bad' as binary) as payload")
    payloads.write.parquet(str(tmp_path / "bad/payloads"))
    spark.read.parquet(str(tmp_path / "w/headers")).write.parquet(str(tmp_path / "bad/headers"))
    try:
        warc.read_archive(spark, str(tmp_path / "bad")).collect()
    except Exception as error:
        assert "does not have digest" in str(error)
    else:
        raise AssertionError("a damaged payload was read")


def test_empty_table(spark):
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_writing_leaves_no_shuffle_files(spark, tmp_path):
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {p.name for disk in disks for p in Path(disk.getPath()).glob("*/shuffle_*")}
    rows = [(n, f"u{n}", f"<p>{n % 40}</p>") for n in range(60)]
    frame = pages(spark, rows).repartition(4).localCheckpoint()  # rows in several tasks, so that payloads are shuffled
    before = files()
    warc.write_archive(frame, str(tmp_path / "w"))
    ends = time.time() + 20
    while (left := files() - before) and time.time() < ends:
        time.sleep(0.2)
    assert not left
    assert rows_of(warc.record_facts(warc.read_archive(spark, str(tmp_path / "w")))) == brute(rows, 0)
