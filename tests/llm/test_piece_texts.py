"""Texts of piece ids, made for a batch at a time."""

import pyarrow as pa
import pytest

from quarry.llm import pieces

CONTENT = [b" ", b" a", b"bc", "é".encode(), b"\xc3", b"\xa9", b""]


def plain(ids):
    return None if ids is None else b"".join(CONTENT[i] for i in ids).decode("utf-8", "replace")[1:]


@pytest.mark.parametrize("lists", [[[1, 2], None, [], [0, 3, 6, 2], [0, 4, 5], [0]], [[0, 4], [1, 5, 4], None, [3, 2]], [None], []])
def test_texts_of_lists(lists):
    content = pa.array(CONTENT, pa.binary())
    every = pa.array(lists, pa.list_(pa.int32()))
    for at in range(len(lists) + 1):
        assert pieces.texts_of(every.slice(at), content).to_pylist() == [plain(x) for x in lists[at:]]
