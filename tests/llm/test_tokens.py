import random

import numpy as np
from tokenizers import Tokenizer

from sievestone.llm._tokens import Encoder, default_path


def texts():
    yield from ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\nb", "a \nb", "a\n b", "it's 's 'S we'll\n'll", "<|endoftext|> x", "a <|endoftext|> b", "a<|endoftext|>\nb <|endoftext|><|endoftext|> c", " <|endoftext|>", "<|endof text|>", "a b c", "　x y", "a\x1cb c\x85d", "x y z", "tab\tand space", "\r\nwin\r\nlines", "éà ß漢字 かな 12 3.5e7 !? %%% the&&& \U0001f600 ok", "a" * 3000 + " b" * 500]
    rng = random.Random(5)
    for _ in range(3000):
        yield "".join(rng.choice(["a", "<|endoftext|>", "B", "é", "7", "'", "s", ".", " ", " ", " ", "\n", "\t", " ", "​", "漢", "%", "\U0001f468‍\U0001f469", "é", "\x1f", "\x85"]) for _ in range(rng.randrange(40)))


def test_pieces_give_the_whole_texts_ids():
    whole = Tokenizer.from_file(default_path())
    kinds = list(texts())
    for text, ids in zip(kinds, Encoder(default_path()).encode(kinds)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_on_the_small_table(spark):
    whole = Tokenizer.from_file(default_path())
    kinds = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text, ids in zip(kinds, Encoder(default_path()).encode(kinds)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
