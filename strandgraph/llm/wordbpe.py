"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

Encoding. A word is a string of initial symbols (a byte, or a byte that ends a word). An Aho-Corasick automaton over all
tokens gives the longest token that begins at a position. Tokens are taken from left to right; a token may follow another
only if the pair-compatibility test holds, that is, if merging by rank would have left the two side by side. Where no
compatible token fits, the walk goes back and takes the next shorter one, and a position found to be a dead end is never
tried again; so the walk is linear in the word's length, and its result is exactly that of merging by rank.

Decoding. All token strings lie one after another in a byte table, with an offset for each id. Gathering the ranges of a
text's ids gives the decoded text in a few vector operations.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from strandgraph.llm import common
from strandgraph.llm.charsets import BYTE_OF, CHAR_OF, LETTERS, NUMBERS, OUTSIDE, WHITE

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
WORDS = re.compile(f"'(?:[sdmt]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{WHITE}{LETTERS}{NUMBERS}]+")
#: Words whose ids are kept at most, and pairs whose compatibility is kept at most; a full store is emptied.
KEPT_WORDS, KEPT_PAIRS = 400_000, 400_000
#: Words of more symbols than this aren't kept.
LONG_WORD = 64


class BacktrackingBpe:
    """Merges by rank, without merging: tokens are numbered by rank, initial symbols first."""

    def __init__(self, merges: list[tuple[str, str]], symbols: list[str]):
        """symbols: the initial symbols; merges: pairs of token strings in order of rank.

        Inside, each initial symbol is one character, so that a word is a plain string.
        """
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(len(symbols))]
        self.text = [chr(0xE000 + i) for i in range(len(symbols))]
        number = {s: i for i, s in enumerate(symbols)}
        for a, b in merges:
            x, y = number[a], number[b]
            number[a + b] = self.pair_rank[x, y] = len(self.text)
            self.halves.append((x, y))
            self.text.append(self.text[x] + self.text[y])
        self.number, self.symbol = number, {s: self.text[i] for i, s in enumerate(symbols)}
        self.automaton = ahocorasick.Automaton()
        reachable = [self.by_merging(t) == [i] for i, t in enumerate(self.text)]
        for i, t in enumerate(self.text):
            if reachable[i]:
                self.automaton.add_word(t, i)
        self.length = [len(t) for t in self.text]
        known = {t: i for i, t in enumerate(self.text) if reachable[i]}
        #: The longest shorter token that begins a token; -1 if there is none.
        self.shorter = [next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1) for t in self.text]
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}

    def by_merging(self, word: str) -> list[int]:
        """Merging by rank step by step; for short words, when the tables are built."""
        at = [ord(c) - 0xE000 for c in word]
        while len(at) > 1:
            rank, i = min((self.pair_rank.get(p, 1 << 60), i) for i, p in enumerate(zip(at, at[1:], strict=False)))
            if rank == 1 << 60:
                break
            at[i : i + 2] = [rank]
        return at

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the two tokens' text by rank gives just these two tokens.

        Both are taken apart from the border outwards in the reverse order of their merges; a merge across the border
        that would have come first shows that they don't stay side by side.
        """
        found = self.compatible.get((a, b))
        if found is None:
            if len(self.compatible) >= KEPT_PAIRS:
                self.compatible.clear()
            found = self.compatible[a, b] = self._fits(a, b)
        return found

    def _fits(self, a: int, b: int) -> bool:
        limit, halves, rank = 1 << 60, self.halves, self.pair_rank
        while True:
            if rank.get((a, b), 1 << 60) < limit:
                return False
            # The later of the last two merges is undone; of equal ones the right token's came later.
            if a > b:
                limit, a = a, halves[a][1]
                if a == limit:
                    limit, b = b + 1, halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, halves[b][0]
                if b + 1 == limit:
                    limit, a = a, halves[a][1]
                    if a == limit:
                        return True

    def longest_matches(self, word: str) -> list[int]:
        """For each position the longest token that begins there, from one pass of the automaton over the word."""
        out = [-1] * len(word)
        length = self.length
        for end, token in self.automaton.iter(word):
            begin = end + 1 - length[token]
            if out[begin] < 0 or length[out[begin]] < length[token]:
                out[begin] = token
        return out

    def encode(self, word: str) -> list[int]:
        """Token numbers of a word given in inner characters."""
        longest, length, n = self.longest_matches(word), self.length, len(word)
        alive, out, at = bytearray(b"\1") * (n + 1), [], 0
        token = longest[0]
        while True:
            while True:
                end = at + length[token]
                if alive[end] and (not out or self.fits(out[-1], token)):
                    out.append(token)
                    at = end
                    if at == n:
                        return out
                    token = longest[at]
                    break
                token = self.shorter[token]
                if token < 0:
                    alive[at] = 0
                    token = out.pop()
                    at -= length[token]


class OffsetTable:
    """Strings by id, gathered by ranges of one byte table."""

    def __init__(self, strings: list[bytes]):
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)

    def join(self, ids: np.ndarray) -> bytes:
        begin = self.offsets[ids]
        size = self.offsets[ids + 1] - begin
        end = np.cumsum(size)
        return self.bytes[np.repeat(begin - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()


class WordBpe:
    """A tokenizer whose words end in a marked symbol: normaliser, words, ids and back, from the tokenizer's own file."""

    _loaded: dict[str, WordBpe] = {}

    @classmethod
    def load(cls, path: str) -> WordBpe:
        """One instance for each file and process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = suffix = model["end_of_word_suffix"]
        chars = [CHAR_OF[b] for b in range(256)]
        self.bpe = bpe = BacktrackingBpe([tuple(x) for x in model["merges"]], chars + [c + suffix for c in chars])
        self.id_of = np.full(len(bpe.text), -1, np.int64)
        for s, i in bpe.number.items():
            self.id_of[i] = model["vocab"].get(s, -1)
        self.inner = [bpe.symbol[c] for c in chars], [bpe.symbol[c + suffix] for c in chars]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special, self.special_ids = re.compile(f"({'|'.join(map(re.escape, special))})"), special
        token = {i: s for s, i in (model["vocab"] | special).items()}
        count = max(token) + 1
        self.tokens = OffsetTable([(token.get(i, "") + " ").encode() for i in range(count)])
        self.decimals = OffsetTable([b"%d " % i for i in range(count)])
        self.tokenizer = Tokenizer.from_file(path)

        class Store(dict):
            def __missing__(_, word: str) -> bytes:  # noqa: N805
                found = self.word(word.encode())
                if len(word) <= LONG_WORD:
                    if len(_) >= KEPT_WORDS:
                        _.clear()
                    _[word] = found
                return found

        self.store = Store()

    def word(self, utf8: bytes) -> bytes:
        """The ids of one word as 32-bit numbers."""
        plain, last = self.inner
        word = "".join([plain[b] for b in utf8[:-1]]) + last[utf8[-1]]
        ids = self.id_of[self.bpe.encode(word)]
        return ids[ids >= 0].astype("<u4").tobytes()

    def segment(self, text: str) -> bytes:
        if OUTSIDE.search(text):  # the tokenizers library's own tables, for normaliser and word limits only
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
            return b"".join(self.word(bytes(BYTE_OF[c] for c in w)) for w, _ in cut)
        return b"".join(map(self.store.__getitem__, WORDS.findall(text.lower())))

    def encode(self, text: str) -> np.ndarray:
        if "<" in text and self.special.search(text):
            parts = self.special.split(text)
            found = b"".join(np.array([self.special_ids[p]], "<u4").tobytes() if k % 2 else self.segment(p) for k, p in enumerate(parts))
        else:
            found = self.segment(text)
        return np.frombuffer(found, "<u4").astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the token strings with spaces between; a tokenizer without a decoder does no more."""
        return self.tokens.join(ids)[:-1]

    def decimal(self, ids: np.ndarray) -> bytes:
        return self.decimals.join(ids)[:-1]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row; a null text counts as empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(tokenizer)
        for batch in batches:
            ids = [bpe.encode(t) for t in common.strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([bpe.decode(x).decode() for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Number of tokens and SHA-256 of the ids and of the decoded text of every row, without moving ids to the JVM.

    A null text counts as empty; repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(tokenizer)
        for batch in batches:
            n, a, b = [], [], []
            for text in common.strings(batch.column(1)):
                ids = bpe.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(bpe.decimal(ids)).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_batches(docs.select("doc_id", "text"), run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
