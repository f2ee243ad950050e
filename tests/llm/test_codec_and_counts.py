import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm.sentencepiece_codec import MergeModel, encode_decode
from millrace.llm.tokencount import CountingTransducer, count_tokens

MODEL, JSON = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXT = st.text(st.one_of(st.sampled_from(" \n\t'srevltdm▁.,<>|é日"), st.characters(codec="utf-8")), max_size=80)


@pytest.fixture(scope="module")
def merge_model():
    return MergeModel(MODEL)


@pytest.fixture(scope="module")
def transducer():
    return CountingTransducer(JSON)


@settings(max_examples=300, deadline=None)
@given(text=ODD_TEXT)
def test_agenda_encodes_and_decodes_as_the_library(merge_model, text):
    segments = merge_model.segments(text)
    ids = [i for x in segments for i in merge_model.encode_segment(x)]
    assert ids == merge_model.library.encode(text)
    assert merge_model.decode(ids) == merge_model.library.decode(ids)
    assert "".join(merge_model.decode_segment(merge_model.encode_segment(x)) for x in segments)[1:] == merge_model.library.decode(ids)


def test_heap_and_list_agendas_agree(merge_model):
    text = "▁" + "thereforenevertheless" * 4
    assert merge_model.encode_segment(text) == merge_model.library.encode(text[1:])


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ODD_TEXT, max_size=5))
def test_transducer_counts_as_the_library(transducer, texts):
    library = Tokenizer.from_file(JSON)
    assert transducer.counts(texts) == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]


def test_chunks_compose_over_a_long_text(transducer):
    text = "it's  12 o'clock\n\n and 'll'l " * 3000
    assert transducer.counts([text, "x"]) == [len(Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids), 1]


def test_encode_decode_of_odd_rows(odd, odd_rows, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(((r.doc is None, r.doc or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_decode(odd, MODEL).collect()))
    want = []
    for i, text, *_ in odd_rows:
        ids = sp.encode(text or "", add_eos=True)
        want.append((i is None, i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert encode_decode(none, MODEL).count() == 0


def test_count_tokens_of_odd_rows(odd, odd_rows, none):
    library = Tokenizer.from_file(JSON)
    got = sorted((r.doc is None, r.doc or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(odd, JSON).collect())
    want = [(i is None, i or 0, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in odd_rows]
    assert got == sorted(want)
    assert count_tokens(none, JSON).count() == 0
