import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glossweave.llm.encode import Encoder

ODD = [chr(i) for i in range(1, 0x3100) if chr(i).isspace()] + list("aZé'sdßΣςİ1٣.-  \n\n\t,%") + ["<|endoftext|>", "'ll", "̈", "​", "한", "ᄒ", "ᅡ", "\U00010400", "ā", "abc", "é, "]
ODD += ["É", "Ünï", " straße", " THE", "ÿ", "ÀÖØ", "×", "÷", "µ", "ª"]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces_give_the_ids_of_the_whole_text(name, kind):
    encode, whole, r = Encoder(public_tokenizers.path(name), kind, memo=500), Tokenizer.from_file(public_tokenizers.path(name)), random.Random(5)
    whole.encode_special_tokens = True
    for _ in range(6000):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 16)))
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert encode(None) == b""
