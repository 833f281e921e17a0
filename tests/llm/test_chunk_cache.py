import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from groundwork.llm.chunk_cache import TokenCounter, chunk_ids

ALPHABET = list("aabcdeTHEst  \n\t.,;'!?-_0123²½ªéÉßœŒİıſΣςжЖ中é<|>@#%\x1c\x85\xa0 ​\U0001f600") + ["'s", "'LL", "<|endoftext|>", "<|startoftext|>", "  ", " the", "ing", "12"]


def test_random_texts_match_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    texts += ["".join(rng.choice("abE'. \n,é1") for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    word, byte = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    ids, lib = chunk_ids(word), Tokenizer.from_file(word)
    for t in texts:
        assert np.frombuffer(ids.encode(t.encode()), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    counter, lib = TokenCounter(byte, {}, {}), Tokenizer.from_file(byte)
    for t in texts:
        assert counter.count(t) == len(lib.encode(t, add_special_tokens=False).ids), repr(t)


def test_letters_are_one_piece():
    """A chunk of ASCII letters is one pre-token, looked up without the splitting pattern; a space before a word is no letter."""
    from groundwork.llm import chunk_cache

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = chunk_cache.tokenizer(path)
    ids = chunk_cache.ChunkIds(path, "<u2")
    for text in ("Hello", "HELLO", "x", "abc1def", "naïve", "1234", "a-b", "Zq" * 40):
        assert np.frombuffer(ids.encode(text.encode()), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert "hello" in ids.pieces and ids.pieces.packed[513] == b"\x01\x02"
    bytes_path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = chunk_cache.PieceIds(chunk_cache.tokenizer(bytes_path).model)
    for text in (" hello", "hello", "é"):
        assert np.frombuffer(pieces[text], "<u4").tolist() == chunk_cache.tokenizer(bytes_path).encode(text, add_special_tokens=False).ids[: len(pieces[text]) // 4]
