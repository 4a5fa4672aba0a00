"""New pieces reach the library many in one text, and pieces of any script and white space keep the library's ids."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from areaflow.llm.token_files import JOINED, PieceEncoder


def model():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as text:
        return text.read()


class Counted:
    """The library's tokenizer, counting the texts it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **named):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **named)


def ids(pieces, texts):
    return [list(memoryview(data).cast(pieces.code)) for data in pieces.encode(texts)]


def test_new_pieces_are_encoded_many_in_one_text():
    pieces, library = PieceEncoder(model()), Tokenizer.from_str(model())
    pieces.tokenizer = counted = Counted(library)
    texts = [" ".join(f"word{k}of{j}" for k in range(500)) for j in range(4)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids(pieces, texts) == want
    assert counted.texts <= 2000 / JOINED + 5
    assert ids(pieces, texts) == want and counted.texts <= 2000 / JOINED + 5


def test_pieces_are_encoded_apart_where_bytes_do_not_tell_them_apart():
    pieces, library = PieceEncoder(model()), Tokenizer.from_str(model())
    pieces.n_bytes[:] = 1
    texts = ["these words are not told apart", "by the bytes of their tokens"]
    assert ids(pieces, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_white_space_and_scripts():
    rnd = random.Random(5)
    marks = [*map(chr, (0x85, 0xA0, 0x1680, 0x2003, 0x200A, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0x1C, 0, 0xE9, 0x416, 0x4E2D, 0x1F600)),
             " ", " ", " ", "  ", "\n", "\t", "\r\n", ".", ",", "a", "1", "'s", "<|endoftext|>", "!", "ab", "Foo"]
    texts = ["".join(rnd.choices(marks, k=rnd.randrange(14))) for _ in range(6000)] + ["", chr(0xA0), chr(0x3000) + " a", chr(0x85) + " "]
    library = Tokenizer.from_str(model())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for limit in (50, 450_000):
        pieces = PieceEncoder(model(), limit)
        assert [i for a in range(0, len(texts), 100) for i in ids(pieces, texts[a:a + 100])] == want
