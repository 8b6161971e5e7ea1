"""A word of ASCII letters gets the vocabulary's letter for its space without a translation of every letter."""

from public_tokenizers import path
from tokenizers import Tokenizer

from inkveil.llm import tokens


def test_ascii_words_are_not_translated():
    file = path("byte_bpe_50k.json")
    enc, whole = tokens.Encoder(file, "leading"), Tokenizer.from_file(file)
    seen = []

    class Watched(dict):
        def __getitem__(self, key):
            seen.append(chr(key))
            return super().__getitem__(key)

    enc.alphabet = Watched(enc.alphabet)
    text = "plain Words of thrindlewyk letters"
    assert enc.encode([text])[0] == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)
    assert seen == []
    text = "café naïve été"
    assert enc.encode([text])[0] == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)
    assert seen
