"""Archives are parsed in time that follows their size, whatever lies behind a record."""

import time

from quarry.llm import warc


def archive(n):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    blocks = [b"\r\n" * (i % 3) + b"x" * (i % 500) + b"\r\n\r\n" * (i % 2) for i in range(n)]
    return b"\r\n".join(record % (len(b), b) for b in blocks), blocks


def seconds(data, blocks):
    began = time.process_time()
    assert [block for _, block in warc._parsed(data)] == blocks
    return time.process_time() - began


def test_parsing_does_not_copy_what_lies_behind_a_record():
    small, large = archive(3_000), archive(24_000)
    least = min(seconds(*small) for _ in range(3))
    assert min(seconds(*large) for _ in range(2)) < 24 * least


def test_records_that_lie_across_parts(monkeypatch):
    data, blocks = archive(200)
    for size in (1, 7, 1000):
        monkeypatch.setattr(warc, "_inflated", lambda whole, size=size: (whole[at : at + size] for at in range(0, len(whole), size)))
        assert [block for _, block in warc._parsed(data)] == blocks
