"""The tailing source: rotation, truncation, half-written lines and restarts lose and repeat nothing."""

import os

import pytest

from tracewright.sources import tailing
from tracewright.sources.tailing import TailReader, tail_lines
from tracewright.streaming import stateful


def lines(reader, start, end):
    return [v for p in reader.partitions(start, end) for b in reader.read(p) for v in b.column("value").to_pylist()]


def test_a_file_put_in_its_place_is_read_from_its_beginning(tmp_path):
    path = tmp_path / "features.jsonl"
    path.write_text("old-row\n")
    r = TailReader({"path": str(path)})
    first = r.latestOffset()
    assert lines(r, r.initialOffset(), first) == ["old-row"]
    with path.open("a") as f:
        f.write("last words\n")
    path.rename(tmp_path / "features.jsonl.1")
    path.write_text("new-schema\nnew-row\n")
    second = r.latestOffset()
    assert lines(r, first, second) == ["last words", "new-schema", "new-row"]
    # a batch is read again as it was, also when names have changed again
    path.rename(tmp_path / "features.jsonl.2")
    path.write_text("newest\n")
    assert lines(r, first, second) == ["last words", "new-schema", "new-row"] and lines(r, second, r.latestOffset()) == ["newest"]


def test_old_rows_are_skipped_but_a_rotated_file_is_read(tmp_path):
    path = tmp_path / "features.jsonl"
    path.write_text("old-row\n")
    r = TailReader({"path": str(path), "fromStart": "false"})
    start = r.initialOffset()
    os.replace(path, tmp_path / "features.frozen")
    path.write_text("new-row\n")
    assert lines(r, start, r.latestOffset()) == ["new-row"]


def test_a_half_written_line_waits(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"schema":"v1"')
    r = TailReader({"path": str(path)})
    first = r.latestOffset()
    assert first == {} and lines(r, {}, first) == []
    with path.open("a") as f:
        f.write('}\n{"half')
    second = r.latestOffset()
    assert lines(r, first, second) == ['{"schema":"v1"}']
    with path.open("a") as f:
        f.write(' é"}\n')
    assert lines(r, second, r.latestOffset()) == ['{"half é"}']


def test_truncation_begins_anew(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("one\ntwo\n")
    r = TailReader({"path": str(path)})
    first = r.latestOffset()
    with path.open("r+") as f:
        f.truncate(0)
        f.write("three\nfour\nfive\nsix\n")  # longer than before: only the first line tells
    assert lines(r, first, r.latestOffset()) == ["three", "four", "five", "six"]


def test_no_file_no_permission_and_packed_files(tmp_path, monkeypatch):
    r = TailReader({"path": str(tmp_path / "none.jsonl")})
    assert r.latestOffset() == {}
    path = tmp_path / "a.jsonl"
    path.write_text("row\n")
    (tmp_path / "a.jsonl.gz").write_bytes(b"\x1f\x8b\n")
    r = TailReader({"path": str(path)})
    first = r.latestOffset()
    assert len(first) == 1

    def refuse(*a, **b):
        raise PermissionError

    with monkeypatch.context() as m:
        m.setattr(tailing, "open", refuse, raising=False)
        # a reader that has just begun can't tell what it has read of a file that it can't open
        with pytest.raises(PermissionError):
            TailReader({"path": str(path)}).latestOffset()
        assert r.latestOffset() == first
    assert lines(r, first, r.latestOffset()) == []


def test_a_name_that_is_gone_for_a_while_is_not_read_again(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("row\n")
    r = TailReader({"path": str(tmp_path / "*.jsonl")})
    first = r.latestOffset()
    path.rename(tmp_path / "a.jsonl.1")  # and no new file yet
    assert r.latestOffset() == first == TailReader({"path": str(tmp_path / "*.jsonl")}).latestOffset()
    (tmp_path / "a.jsonl.1").rename(tmp_path / "elsewhere")
    second = r.latestOffset()
    (tmp_path / "elsewhere").rename(tmp_path / "a.jsonl.2")
    assert lines(r, second, r.latestOffset()) == []
    # cut to less, with the same first line: begun anew
    path.write_text("same\nmore\nand more\n")
    third = r.latestOffset()
    with path.open("r+") as f:
        f.truncate(0)
        f.write("same\nother\n")
    assert lines(r, third, r.latestOffset()) == ["same", "other"]


def test_parts_meet_at_line_ends(tmp_path):
    rows = [f"{'x' * (i % 17)}{i}" for i in range(500)]
    (tmp_path / "a.log").write_text("".join(f"{x}\n" for x in rows))
    (tmp_path / "b.log").write_text("b\n\n")
    for part in (1, 7, 64, 1 << 20):
        r = TailReader({"path": str(tmp_path / "*.log"), "partBytes": part})
        assert sorted(lines(r, {}, r.latestOffset())) == sorted([*rows, "b", ""])


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    path = tmp_path / "in" / "a.jsonl"
    path.parent.mkdir()
    out = str(tmp_path / "out")
    got = lambda: sorted(r.value for r in stateful.run(tail_lines(spark, str(path), partBytes=40), out).collect())
    path.write_text("1\n2\nhal")
    assert got() == ["1", "2"]
    with path.open("a") as f:
        f.write("f\n3\n")
    path.rename(f"{path}.1")
    path.write_text("4\n")
    assert got() == ["1", "2", "3", "4", "half"]
    assert got() == ["1", "2", "3", "4", "half"]
    os.truncate(path, 0)
    path.write_text("5\n6\n")
    assert got() == ["1", "2", "3", "4", "5", "6", "half"]
