"""Archives written and read back; records in payloads, splits of any size, broken chains."""

import base64
import hashlib

import numpy as np
import pytest

from passagebase.llm import warc as A

DDL = "page_id long, url string, html string, offset string, n int, type string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "z") for i, u, h in rows], DDL)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def wanted(rows, least=0):
    out, groups = [], {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i))
        size = len(text.encode())
        for at, i in enumerate(ids):
            last = at == len(ids) - 1 or size < least
            out.append((i, size, digest(text), "response" if last else "revisit", None if last else ids[-1]))
    return sorted(map(repr, out))


TRICKY = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (3, None, None),
    (4, "http://a/WARC/1.1\r\nX: y", ""),
    (5, "u", TRICKY + "tail\r\n\r\n" + TRICKY),
    (6, "u", TRICKY),
    (7, "u", "ends\r\n"),
    (8, "u", "ends\r\n\r\n"),
    (9, "u", "WARC/1."),
    (9, "u", "WARC/1."),
    (9, "u", "another text for nine"),
    (None, "u", "<p>one</p>"),
    (None, "u", "null and alone"),
    (None, "u", "null and alone"),
    (10, "u", "Größe ñ 語 " * 40 + "WARC/1.0\r\n"),
    (11, "u", "long " * 60_000),
]


@pytest.mark.parametrize("split", [128, 777, 1 << 20])
def test_round_trip(spark, split):
    """Splits far smaller than a header, and larger than a file."""
    rows = ROWS if split == 1 << 20 else ROWS[:-1]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = A.round_trip(frame(spark, rows).coalesce(2))
        assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == wanted(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_payloads_and_least_size(spark, tmp_path):
    A.write_archives(frame(spark, ROWS), str(tmp_path / "a"), min_bytes=8)
    got = A.read_archives(spark, str(tmp_path / "a"))
    responses = {(r["id"], r["payload"]) for r in got.where("type = 'response'").collect()}
    assert {("5", ROWS[4][2]), ("9", "WARC/1."), ("4", ""), ("3", ""), ("11", ROWS[-1][2])} <= responses
    assert all(r["url"] == "http://a/WARC%2F1.1%0D%0AX:%20y" for r in got.where("id = '4'").collect())
    assert sorted(repr(tuple(r)) for r in A.round_trip(frame(spark, ROWS), min_bytes=8).collect()) == wanted(ROWS, 8)


def test_empty_table(spark):
    assert A.round_trip(frame(spark, ROWS).where("page_id > 99")).count() == 0


def test_what_was_cut_off_is_an_error(spark, tmp_path):
    A.write_archives(frame(spark, ROWS).coalesce(1), str(tmp_path / "a"))
    (name,) = (tmp_path / "a").glob("part-*")
    whole = name.read_bytes()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part-0.txt").write_bytes(whole[:-9])
    with pytest.raises(ValueError, match="chain"):
        A.read_archives(spark, str(tmp_path / "b"))
    (tmp_path / "b" / "part-0.txt").write_bytes(b"x" + whole)
    with pytest.raises(ValueError, match="chain"):
        A.read_archives(spark, str(tmp_path / "b"))


def test_chains_against_a_walk():
    rng = np.random.default_rng(4)
    for _ in range(50):
        offset = np.unique(rng.integers(0, 400, 60))
        successor = offset + rng.integers(1, 30, len(offset))
        where = {o: s for o, s in zip(offset.tolist(), successor.tolist(), strict=True)}
        entered = rng.random(len(offset)) < 0.1
        seen = set()
        for o, e in zip(offset.tolist(), entered, strict=True):
            while e and o in where and o not in seen:
                seen.add(o)
                o = where[o]
        assert set(offset[A.passed(offset, successor, entered)].tolist()) == seen
        for o, out in zip(offset.tolist(), A.exits(offset, successor, 400).tolist(), strict=True):
            while o in where:
                o = where[o]
            assert out == (o if o >= 400 else -1)
