"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.bpe import located

#: The pattern that byte-level tokenizers of this family split text by before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Counts of so many different pieces are remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 1 << 20
#: Texts are split in blocks of about so many characters, so that a text's pieces never stand in memory together.
BLOCK_CHARS = 1 << 20


class Counter:
    """Counts the tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, model_file: str):
        with open(model_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        known = model["type"] == "BPE" and before["type"] == "ByteLevel" and not spec["normalizer"] and not before["add_prefix_space"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not (known and plain):
            raise ValueError("only plain byte-level BPE without normaliser is counted")
        vocab = model["vocab"]
        self.symbol = [vocab[c] for c in _byte_letters()]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[left] << 32 | vocab[right]] = (rank, vocab[left + right])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def piece(self, data: bytes) -> int:
        """Tokens of one piece: pop the adjacent pair of lowest rank (the leftmost of equals) until none is left."""
        n = len(data)
        if n < 2:
            return n
        merge = self.merge
        ids = [self.symbol[b] for b in data]
        found = map(merge.get, (a << 32 | b for a, b in zip(ids, ids[1:])))
        heap = [(pair[0], at, pair[1]) for at, pair in enumerate(found) if pair]
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = 0
        want = [0] * n  # rank that the pair starting here has now; -1: none
        for rank, at, _ in heap:
            want[at] = rank + 1
        while heap:
            rank, at, new = heappop(heap)
            if want[at] != rank + 1:
                continue
            gone = after[at]
            right = after[gone]
            ids[at] = new
            merges += 1
            want[gone] = want[at] = 0
            after[at] = right
            if right < n:
                before[right] = at
                pair = merge.get(new << 32 | ids[right])
                if pair:
                    want[at] = pair[0] + 1
                    heappush(heap, (pair[0], at, pair[1]))
            left = before[at]
            if left >= 0:
                pair = merge.get(ids[left] << 32 | new)
                want[left] = pair[0] + 1 if pair else 0
                if pair:
                    heappush(heap, (pair[0], left, pair[1]))
        return n - merges

    def ordinary(self, text: str) -> int:
        known, total = self.known, 0
        for block in _blocks(text):
            for word in self.split.findall(block):
                count = known.get(word)
                if count is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    count = self.piece(word.encode("utf-8", "surrogatepass"))
                    if len(word) <= 64:
                        known[word] = count
                total += count
        return total

    def text(self, text: str | None) -> int:
        """Tokens of a whole text: strings of special tokens count one each, the text between them as its own."""
        if not text:
            return 0
        if self.special is None or not (found := self.special.findall(text)):
            return self.ordinary(text)
        return len(found) + sum(map(self.ordinary, self.special.split(text)))


def _blocks(text: str):
    """Cut at lone spaces between visible characters, where a match of the pattern always starts; without any the text stays whole."""
    start = 0
    while len(text) - start > BLOCK_CHARS:
        cut = _CUT.search(text, start + BLOCK_CHARS)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


_CUT = regex.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in such files: itself where it prints, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]


@lru_cache(maxsize=2)
def counter(model_file: str) -> Counter:
    return Counter(model_file)


def with_token_count(df: DataFrame, model_file: str | Callable[[], str], text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of ``text`` as BIGINT; null and empty texts have 0. Other columns stay as they are."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        of = counter(located(model_file)).text
        return pd.Series([of(t) for t in texts], dtype="int64")

    return df.withColumn(out, count(F.col(f"`{text}`")))
