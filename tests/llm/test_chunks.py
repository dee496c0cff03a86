"""Texts cut into chunks that are learnt once."""

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabloom.llm import tokens
from tabloom.llm.packing import word_vocabulary
from tabloom.llm.token_codes import byte_vocabulary

_TEXTS = ["été, là!! Ça. straße? Ÿ, ÷, ×. ª. à.b c,d é1. 1é, é..", "É, the!!\nÀ.\né", "İ, ſ. é, ö̈. кот, ά!", "", "é,", "<|endoftext|> é!!"]


@pytest.mark.parametrize("path, words", [(word_vocabulary(), True), (byte_vocabulary(), False)])
def test_marks_after_accented_letters_and_runs_of_marks_are_chunks_of_their_own(path, words):
    encoder = tokens.Encoder(path, words)
    chunks = [c.lstrip("\x01") for c in encoder._chunks(pa.array(["été, là!! the."]))[0].as_py()]
    assert chunks == ["été", ",", "là", "!!", "the", "."]
    found = encoder.encode(pa.array(_TEXTS))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(_TEXTS, add_special_tokens=False)]
    ends = found.ends.tolist()
    assert [found.ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == want
