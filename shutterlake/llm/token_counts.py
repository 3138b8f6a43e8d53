"""Token counts by byte-pair merging with a heap over a linked list of symbols.

Each word's symbols stand in a doubly linked list and its adjacent pairs in a heap by merge rank
(then place); the least pair is popped and merged until none is left. The word's tokens are its
symbols minus its merges; no token identifier is made. Words repeat, so each task keeps the counts
of those it has met, in a table of bounded size.

Edge cases: null and empty texts have 0 bytes and 0 tokens; a text of white space alone has 0
tokens; rows are independent, so repeated rows repeat their result, an empty table gives an empty
one, and columns besides doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, table

#: A document over this many tokens is flagged.
LIMIT = 2048
#: Words whose counts a task keeps.
KEPT_WORDS = 400_000
_END = "</w>"
#: What every special string holds.
_OPENS = "<|"
#: Letters lower-cased by newer character tables than Python's.
_NEW_LOWER = {0xA7CB: 0x264, 0xA7DC: 0x19B}
#: Unassigned code points that the regex module takes for letters.
_NOT_LETTERS = "".join(map(chr, [0x32808, 0x3285C, 0x32988, 0x3D808, 0x3D85C, 0x3D988, 0x3E808, 0x3E85C, 0x3E988, 0x3F808, 0x3F85C, 0x3F988]))


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves; the rest take the letters from 256 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def load_spec(path: str) -> dict[str, Any]:
    """Merge ranks, split pattern and special strings of a tokenizers .json file of the word-end kind."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    split = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    if j["model"].get("end_of_word_suffix") != _END or not split["invert"]:
        raise ValueError("this counter knows word-end BPE vocabularies whose split keeps its matches")
    if not all(_OPENS in t["content"] for t in j["added_tokens"]):
        raise ValueError(f"this counter looks for special strings only in texts that hold {_OPENS}")
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"])
    return {
        "ranks": {p: i for i, p in enumerate(pairs)},
        "pattern": split["pattern"]["Regex"],
        "special": [t["content"] for t in j["added_tokens"]],
    }


class Counter(dict):
    """Word -> number of tokens, filled as words are met."""

    def __init__(self, spec: dict[str, Any], kept: int = KEPT_WORDS):
        super().__init__()
        self.ranks, self.kept, self.letters = spec["ranks"], kept, byte_letters()
        self.words = regex.compile(spec["pattern"]).findall
        strict = spec["pattern"].replace(r"[\p{L}]", rf"[\p{{L}}--[{_NOT_LETTERS}]]").replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{_NOT_LETTERS}]]")
        self.strict_words = regex.compile(strict, regex.V1).findall
        self.odd = regex.compile(f"[{_NOT_LETTERS}]").search
        self.special = regex.compile("|".join(map(regex.escape, sorted(spec["special"], key=len, reverse=True))))

    def __missing__(self, word: str) -> int:
        letters = self.letters
        symbols = [letters[b] for b in word.encode()]
        symbols[-1] += _END
        n = merged(symbols, self.ranks)
        if len(self) >= self.kept:
            self.clear()
        self[word] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text; each special string in it is one token and parts the text."""
        if _OPENS not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if not text.isascii():
            # letters are lower-cased one by one: no final form of sigma
            text = unicodedata.normalize("NFC", text).translate(_NEW_LOWER).replace("Σ", "σ").lower()
            return sum(map(self.__getitem__, (self.strict_words if self.odd(text) else self.words)(text)))
        return sum(map(self.__getitem__, self.words(text.lower())))


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when no adjacent pair has a rank; merges the least rank first, the leftmost of equals."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    get = ranks.get
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue  # one of the two is no longer there
        symbols[i], symbols[j] = a + b, ""
        merges += 1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (r := get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return n - merges


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; no shuffle.

    path: the vocabulary file, read on the driver and broadcast (its size is that of one vocabulary).
    """
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(path))
    own: list[Counter] = []

    def count(batch: pa.RecordBatch):
        if not own:
            own.append(Counter(spec.value))
        c = own[0]
        rows = batch.column("text").to_pylist()
        tokens = [c.count(t) if t else 0 for t in rows]
        yield {
            "doc_id": batch.column("doc_id"),
            "n_bytes": pa.array([len(t.encode()) if t else 0 for t in rows], pa.int64()),
            "n_tokens": pa.array(tokens, pa.int64()),
            "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", count)(docs.select("doc_id", F.col("text").cast("string")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
