"""Byte-pair encoding of a whole corpus with a public vocabulary, by backtracking over longest matches.

A byte-level BPE vocabulary gives each token its rank in the merge order. Two tokens are *compatible* if encoding their
joined bytes gives just these two; a sequence is the BPE encoding of its bytes if and only if all neighbours are
compatible. So a piece is encoded by taking the longest token at each place (found for all places in one pass of an
Aho-Corasick automaton over the vocabulary), going to the next shorter one where a pair is not compatible, and back where
none is left; a place once given up is never tried again, so the work is linear in the piece.

Public decoding goes through one byte string with an offset table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Pieces kept in a worker's memo before it starts anew: a bound on its memory, it changes no result.
MEMO = 500_000
#: Bytes of a piece that are worth a place in the memo.
MEMO_BYTES = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Bpe:
    """Encoder and decoder of one vocabulary: ``ranks`` maps a token's bytes to its id, which is also its merge rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.token: list[bytes] = [b""] * size
        for b, i in ranks.items():
            self.token[i] = b
        self.length = [len(b) for b in self.token]
        self.ranks = ranks
        self.offsets = np.concatenate([[0], np.cumsum(self.length)])
        self.all_bytes = b"".join(self.token)
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [next((ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in ranks), -1) for b in self.token]
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.known: dict[tuple[int, int], bool] = {}
        for i in sorted(ranks.values()):
            b = self.token[i]
            # the merge that makes this token: two tokens of lower rank that are compatible up to this rank
            left = self.shorter[i]
            while left >= 0:
                right = ranks.get(b[self.length[left] :], -1)
                if 0 <= right < i and left < i and self._compatible(left, right):
                    self.joined[left, right] = i
                    self.halves[i] = (left, right)
                    break
                left = self.shorter[left]
        self.known.clear()
        self.memo: dict[str, list[int]] = {}

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge of rank below what made the two sides crosses the border between them."""
        limit = len(self.token)
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            # undo the later of the two last merges and look at the parts at the border
            if left > right:
                limit = left
                left = self.halves[left][1]
                if left == limit:
                    limit, right_was = right + 1, right
                    right = self.halves[right][0]
                    if right == right_was:
                        return True
            else:
                limit, right_was = right + 1, right
                right = self.halves[right][0]
                if right == right_was:
                    limit, left_was = left, left
                    left = self.halves[left][1]
                    if left == left_was:
                        return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.known.get((left, right))
        if known is None:
            if len(self.known) > MEMO:
                self.known.clear()
            known = self.known[left, right] = self._compatible(left, right)
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [-1] * n
        for end, i in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - self.length[i]
            if longest[start] < 0 or self.length[longest[start]] < self.length[i]:
                longest[start] = i
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + self.length[token]
                if open_at[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.length[token]
                token = longest[at] if at < n else -1
            else:
                open_at[at] = 0
                token = out.pop()
                at -= self.length[token]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                data = piece.encode()
                ids = self.encode_bytes(data)
                if len(data) <= MEMO_BYTES:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        o = self.offsets
        return b"".join(self.all_bytes[o[i] : o[i + 1]] for i in ids)


@lru_cache(maxsize=2)
def load(path: str, pattern: str | None = None) -> Bpe:
    """The vocabulary of a .tiktoken file, once in each Python worker."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _mapped(docs: DataFrame, kept: list[str], text_col: str, path: str, lists: bool):
    """The columns ``kept`` of each row and its text's ids, or how many they are."""
    out = "ids" if lists else "n_tokens"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            lengths, flat = [], []
            for t in b.column(len(kept)):
                ids = bpe.encode(t.as_py() or "")
                lengths.append(len(ids))
                if lists:
                    flat += ids
            if lists:
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, dtype=np.int32)))
            else:
                last = pa.array(np.array(lengths, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), last], [*kept, out])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.select(*kept, F.col(text_col).alias("__text")).mapInArrow(run, ", ".join([*kinds, "ids array<int>" if lists else "n_tokens bigint"]))


def encode_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(``id_col``, ids): the ids of each whole text, without special tokens; strings that look like special tokens are text.

    Null and empty texts have an empty list. Rows are kept one for one, repeated rows included; other columns are ignored.
    A row is encoded on its own, so there is no shuffle except to spread a scan that has fewer splits than cores.
    """
    return _mapped(spread(docs.select(id_col, text_col)), [id_col], text_col, path or default_vocabulary(), True)


def count_tokens(docs: DataFrame, kept: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``kept`` of each row and ``n_tokens`` as :func:`encode_ids` finds them (0 for null and empty texts)."""
    return _mapped(spread(docs.select(*kept, text_col)), kept, text_col, path or default_vocabulary(), False)


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(``id_col``, text) back from (``id_col``, ids); bytes that are no UTF-8 come out as U+FFFD, null ids as null."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = [None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, text string")


def id_summary(docs: DataFrame, by: str, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Documents, empty documents and tokens of each value of ``by`` (null is a group of its own); each row counts."""
    sizes = count_tokens(docs, [by], text_col, path)
    return sizes.groupBy(by).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.when(F.col("n_tokens") == 0, 1).otherwise(0)).cast("bigint").alias("empty_docs"), F.sum("n_tokens").alias("tokens"))
