"""Quoted CSV over many tasks gives the rows of the reader that takes a file in one task."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from eventlake.schemas import ReportSpec
from eventlake.sources.quoted_csv import RANGE_BYTES, SMALL_RANGES, _records, parity, range_size, ranges, read_quoted, states
from eventlake.sources.report_files import _READ, read_report_files

SCHEMA = "id long, text string, other string"
OPTIONS = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in _READ.items() if k != "header"}
TEXTS = ["plain", "", "a,b", 'say "x"', '"', '""', "line\nbreak", "\n", "\r\n", "a\r\nb\n\n\"c\",\n", "ünï ☃", ",", "x" * 300, '\n"\n,"\n']
SPEC = ReportSpec(file_columns={"id": "bigint", "text": "string"}, id_column="id", json_column="text", server_clock="id", device_clock="id", file_fields={}, sort_by=())


def one_task(spark, path):
    return sorted(map(repr, spark.read.options(**_READ).schema(SCHEMA).csv(path).collect()))


def write(path, rows, line_end="\n", quoting=csv.QUOTE_MINIMAL, head=""):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=line_end, quoting=quoting)
    writer.writerow(["id", "text", "other"])
    writer.writerows(rows)
    path.write_bytes((head + out.getvalue()).encode())
    return {str(path): path.stat().st_size}


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(TEXTS), rng.choice(TEXTS)) for i in range(n)]


@pytest.mark.parametrize("line_end, quoting, head", [("\n", csv.QUOTE_MINIMAL, ""), ("\r\n", csv.QUOTE_MINIMAL, ""), ("\n", csv.QUOTE_ALL, ""), ("\n", csv.QUOTE_MINIMAL, "﻿")])
def test_rows_equal_the_one_task_read(spark, tmp_path, line_end, quoting, head):
    file = write(tmp_path / "a.csv", rows(400, 1), line_end, quoting, head)
    want = one_task(spark, *file)
    for size in (64 << 20, 997):
        got, odd = read_quoted(spark, file, ["id", "text", "other"], SCHEMA, OPTIONS, size)
        assert odd == [] and sorted(map(repr, got.collect())) == want and len(want) == 400
        assert got.rdd.getNumPartitions() == -(-sum(file.values()) // size)


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at: at + n]


def test_every_border_and_chunk(monkeypatch):
    """Ranges and chunks of every size, so that a border falls on each byte: quotes, doubled quotes, both bytes of a line end."""
    import eventlake.sources.quoted_csv as q

    for seed in range(4):
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n" if seed % 2 else "\n").writerows(rows(8, seed))
        data = out.getvalue().encode() if seed % 3 else out.getvalue().encode().rstrip(b"\r\n")
        whole = [x for some in _records(Bytes(data), 0, len(data), len(data), False) for x in some]
        assert len(whole) == 8 and [next(csv.reader(io.StringIO(x.decode(), newline=""))) for x in whole] == list(csv.reader(io.StringIO(data.decode(), newline="")))
        for size in range(1, 40):
            for chunk in (1, 7, 10 ** 6):
                monkeypatch.setattr(q, "CHUNK_BYTES", chunk)
                got, quotes = [], 0
                for start in range(0, len(data), size):
                    end = min(len(data), start + size)
                    got += [x for some in _records(Bytes(data), start, end, len(data), quotes % 2 == 1) for x in some]
                    quotes += data[start:end].count(b'"')
                assert got == whole, (seed, size, chunk)


def test_scan_counts_for_both_states(spark, tmp_path):
    file = write(tmp_path / "a.csv", rows(300, 4))
    data = (tmp_path / "a.csv").read_bytes()
    for size in (11, 500, 1 << 20):
        known = {r.start: r for r in states(parity(ranges(spark, file, size))).collect()}
        assert all(r.inside == (data[:at].count(b'"') % 2 == 1) and r.odd == 0 for at, r in known.items()) and len(known) == -(-len(data) // size)


@pytest.mark.parametrize("body", ['1,a"b,c\n2,"x\ny",z\n', '1,"a"b,c\n2,x,z\n', '1, "a",c\n', "1,a,b\r2,c,d\r"])
def test_odd_quotes_go_to_one_task(spark, tmp_path, body):
    good, odd = tmp_path / "good.csv", tmp_path / "odd.csv"
    file = write(good, rows(50, 2))
    odd.write_bytes(("id,text,other\n" if "\n" in body else "id,text,other\r").encode() + body.encode())
    file |= {str(odd): odd.stat().st_size}
    got, left = read_quoted(spark, file, ["id", "text", "other"], SCHEMA, OPTIONS, 100)
    assert left == [str(odd)] and sorted(map(repr, got.collect())) == one_task(spark, str(good))


def test_both_readers_make_one_table(spark, tmp_path):
    write(tmp_path / "a.csv", rows(40, 2))
    (tmp_path / "b.csv").write_text('id,text,other\n7,a"b,c\n')
    files = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    got = read_report_files(spark, files, SPEC, 64)
    assert got.count() == 41 and got.where("id = 7 and text = 'a\"b'").count() == 1
    assert got.where(F.col("text") == "line\nbreak").count() == sum(r[1] == "line\nbreak" for r in rows(40, 2))


def test_other_headers_stop_the_job(spark, tmp_path):
    write(tmp_path / "a.csv", rows(3, 2))
    (tmp_path / "b.csv").write_text("id,other,text\n1,a,b\n")
    with pytest.raises(Exception, match="header"):
        read_report_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], SPEC).collect()


def test_bad_types_stop_the_job(spark, tmp_path):
    write(tmp_path / "a.csv", [("x", "a", "b")])
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_report_files(spark, [str(tmp_path / "a.csv")], SPEC).collect()


def test_nothing_but_a_header(spark, tmp_path):
    write(tmp_path / "a.csv", [])
    assert read_report_files(spark, [str(tmp_path / "a.csv")], SPEC).collect() == []


def test_small_ranges_grow_with_the_files(spark, tmp_path):
    """Ranges of a fixed small size made a task of every 64 KB, whatever the size of the files."""
    for size in (1, 1 << 16, 1 << 24, (1 << 30) + 1, 6 << 30):
        files = {"a": size, "b": size // 3}
        bytes_of = range_size(files, 1 << 16)
        assert sum(-(-n // bytes_of) for n in files.values()) <= SMALL_RANGES + len(files) and bytes_of >= 1 << 16
    assert range_size({"a": 1 << 40}, 1 << 16) == RANGE_BYTES and range_size({"a": 1 << 40}, 2 * RANGE_BYTES) == 2 * RANGE_BYTES
    file = write(tmp_path / "a.csv", rows(2000, 3))
    got, odd = read_quoted(spark, file, ["id", "text", "other"], SCHEMA, OPTIONS, 16)
    assert odd == [] and 200 < got.rdd.getNumPartitions() <= SMALL_RANGES + 1
    assert sorted(map(repr, got.collect())) == one_task(spark, *file)
