"""Texts that hold an added token of the vocabulary get the ids of its tokenizer."""

import binascii

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from heddle.llm import group_pack


def test_added_tokens_are_recognised_inside_a_text(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n日本 y", "<|endoftext| > c", "<|endoftext|>" + " long words" * 900, "no such token"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in group_pack.pack(docs, path).collect()}
    want = {}
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        at, to = 0, (len(ids) - 1) % 1024 + 1
        while at < len(ids):
            want[i, sum(k == i for k, _ in want)] = (at, to - at, binascii.crc32(np.asarray(ids[at:to], "<u4").tobytes()))
            at, to = to, to + 1024
    assert got == want
