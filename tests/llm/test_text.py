import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiweave.llm import _text

TEXTS = st.lists(st.none() | st.text(alphabet="aB1é日 \t\n\x0b\x0c\r\x1c\x85\xa0.-_", max_size=30), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 3))
def test_words_are_those_of_bytes(texts, skip):
    array = pa.array(texts, pa.string())[skip:]
    for table in (None, _text.LOWER, _text.LOWER_ALNUM):
        flat, ends = _text.split_words(array, table)
        words = flat.cast(pa.binary()).to_pylist()
        want = [(t or "").encode() for t in texts[skip:]]
        want = [(t.translate(table) if table else t).split() for t in want]
        assert [words[a:b] for a, b in zip(ends, ends[1:])] == want
        codes, distinct = _text.coded(flat)
        assert [distinct[c] for c in codes] == words


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_slices_are_all_rows_in_order(texts, limit):
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["i", "t"])
    got = list(_text.pieces_of([batch], 1, limit))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= limit for b in got)
