import base64
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swingkit.llm import bpe

SIGNS = ["a", "B", "'s", "'", "'re", "'ll", "'t", " ", "  ", "\n", "\t", " \n", "é", "ß", "漢字", "1", "23", "!", "...", "<|endoftext|>", "<|", " ", "\x85", "😀", "aaaa", "\x1c", "\r\n", "'S", "’s", "_", "́", "Ⅷ", "½"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.default_path())


def test_same_ids_and_texts_as_the_library(vocabulary):
    rng = random.Random(1)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(30))) for _ in range(1500)] + ["", "a" * 5000, "x\x00y", "the quick brown fox " * 900]
    library, encoder = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(vocabulary, remembered=500)
    for at in range(0, len(texts), 200):
        ids, offsets = encoder.encode(texts[at : at + 200])
        for k, text in enumerate(texts[at : at + 200]):
            own = ids[offsets[k] : offsets[k + 1]]
            assert own.tolist() == library.encode(text, add_special_tokens=False).ids, text
            assert vocabulary.decode(own) == library.decode(own.tolist(), skip_special_tokens=False) == text


def test_long_words(vocabulary):
    """Words around LONG bytes and runs of a million signs: the library's ids, in a time that grows with the length."""
    rng, library = random.Random(2), Tokenizer.from_file(bpe.default_path())
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDE") for _ in range(6000))
    mixed = f"one {letters[:1023]} {letters[:1024]} 'x{letters[:1025]} {letters} " + "ab" * 3001 + " " + "a" * 4097 + " " + "漢字" * 700 + "=" * 2000
    for text in (mixed, base64.b64encode(rng.randbytes(750_000)).decode(), "z" * 1_000_000, "-" * 1_000_000):
        began = time.perf_counter()
        ids, _ = bpe.Encoder(vocabulary).encode([text, "end"])
        assert time.perf_counter() - began < 20
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + library.encode("end", add_special_tokens=False).ids


def test_odd_ids(vocabulary):
    assert vocabulary.decode(np.array([-1, 10**6, 50256])) == "<|endoftext|>"
    assert vocabulary.decode(vocabulary.of_byte[[0xE4, 0xBD]]) == "�"


def test_columns(spark):
    docs = spark.createDataFrame([(1, "two words", 5), (1, "two words", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, decoded int")
    out = bpe.decoded(bpe.encoded(docs, bpe.default_path()), bpe.default_path())
    assert sorted((r.doc_id, len(r.ids), r.decoded) for r in out.collect()) == [(1, 2, "two words"), (1, 2, "two words"), (2, 0, ""), (3, 0, "")]
    assert bpe.decoded(docs.select(F.lit(None).cast("array<int>").alias("ids")), bpe.default_path()).first().decoded == ""
    assert bpe.encoded(docs.limit(0), bpe.default_path()).count() == 0
