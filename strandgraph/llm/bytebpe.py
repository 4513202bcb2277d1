"""Byte-level BPE ids of whole texts.

The merge ranks are read from the tokenizer's own file and given to the tiktoken engine, which is several times faster
than the tokenizers library and gives the same ids: a vocabulary of this kind has one merge for each token, in id order.
Texts with characters outside the written-out classes (where the two libraries' Unicode tables may differ), or with the
string of a special token, are encoded by the tokenizers library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from strandgraph.llm.charsets import BYTE_OF, OUTSIDE

#: The pre-tokeniser's pattern of this family of vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    _loaded: dict[str, ByteBpe] = {}

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        """One instance for each file and process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content) for t in special.values()) or "(?!)")
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(BYTE_OF[c] for c in token): i for token, i in vocab.items() if i not in special}
        self.engine = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if OUTSIDE.search(text) or self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.engine.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
