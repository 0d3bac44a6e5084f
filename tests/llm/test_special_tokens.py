"""Strings of special tokens have the ids that the plain tokenizer gives them."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from quillon.llm import packing


def test_special_strings_as_the_tokenizer_has_them(spark):
    texts = ["<unk> <s> [PAD] <|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <|EndOfText|>.", "<|startoftext|>,<|endoftext|>. Word. <|x|> A<|B", "<|", "x <|endoftext|><|endoftext|> y\n<|endoftext|>", "<|endoftext|>"]
    plain = Tokenizer.from_file(packing.vocabulary())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(df).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes())), text
