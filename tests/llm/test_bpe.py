import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_same_as_library_on_odd_rows(docs_of, odd_rows):
    got = sorted(map(tuple, bpe.encode_documents(docs_of(odd_rows), PATH).collect()))
    assert got == sorted((i, *want(t)) for i, t in odd_rows)


def test_empty_table(docs_of):
    assert bpe.encode_documents(docs_of([]), PATH).count() == 0


def test_real_ids(docs_of):
    (row,) = bpe.encode_documents(docs_of([(1, "Some Text, again")]), PATH, keep_ids=True).collect()
    assert row.ids == LIBRARY.encode("Some Text, again", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids(text):
    model = bpe.model(PATH)
    ids = np.frombuffer(model.encode(text), "<u4")
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert model.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)
