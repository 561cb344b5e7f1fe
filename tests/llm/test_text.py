import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strophe.llm._text import ALNUM, SOLID, blocks, bytes_of, shingles, words
from tests.llm.brute import alnum_words, solid_words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n|é漢\U0001f600-", max_size=30)), max_size=8))
def test_words_equal_the_patterns(texts):
    buf, offsets = bytes_of(pa.array(texts, pa.string()))
    for kind, plain in ((ALNUM, alnum_words), (SOLID, solid_words)):
        starts, ends, h, at = words(buf, offsets, kind)
        low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
        got = [[low[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == [plain(t) for t in texts]
        assert len({w for x in got for w in x}) == len(set(h.tolist()))


def test_long_words_and_chunks():
    long = "q" * 600_000
    buf, offsets = bytes_of(pa.array([long + " tail", long]))
    _, _, h, at = words(buf, offsets, SOLID)
    assert at.tolist() == [0, 2, 3] and h[0] == h[2] != h[1]
    assert len(shingles(h[:1], 2)) == 0


def test_slices_and_blocks():
    a = pa.array(["ab", None, "c"])[1:]
    buf, offsets = bytes_of(a)
    assert buf.tobytes() == b"c" and offsets.tolist() == [0, 0, 1]
    assert list(blocks(np.array([0, 5, 6, 7, 20, 21]), 4)) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    assert list(blocks(np.array([0]))) == []


def test_null_column():
    buf, offsets = bytes_of(pa.nulls(2, pa.string()))
    assert len(buf) == 0 and offsets.tolist() == [0, 0, 0]
    with pytest.raises(AttributeError):
        bytes_of(None)
