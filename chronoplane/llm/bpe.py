"""Exact byte-pair encoding of whole texts by dynamic programming over prefixes.

For every prefix of a piece of text the last token of its encoding is unique. It is among the vocabulary tokens that end
the prefix (found by one walk of a suffix automaton of the vocabulary: goto and suffix links), and it is the one that
agrees with the last token of what precedes it: two neighbours agree if merging in rank order would keep them apart.
So a table of the last token per prefix is filled from left to right, and following it back from the end gives the ids,
in time linear in the length of the text, however long a piece of text is.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: How the rank file's vocabulary expects a text to be split before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces and pairs remembered by a worker; beyond that the memory starts anew. Bounds memory, not results.
REMEMBERED = 300_000


def default_vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public vocabulary file: in the folder named by ``CHRONOPLANE_TOKENIZERS``, else where the tokenizers are installed."""
    folder = os.environ.get("CHRONOPLANE_TOKENIZERS")
    if not folder and (spec := importlib.util.find_spec("public_tokenizers")) and spec.origin:
        folder = os.path.dirname(spec.origin)
    return os.path.join(folder or "/opt/tokenizers", name)


class Encoder:
    """A vocabulary of ranked byte strings; the rank is the id."""

    def __init__(self, path: str, split: str = SPLIT):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.text = {v: k for k, v in self.rank.items()}
        self.split = regex.compile(split)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self._part()
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            if len(token) > 1 and rank not in self.parts:
                continue  # merging never makes it
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.length = {v: len(k) for k, v in self.rank.items()}
        self.agree: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _part(self) -> None:
        """The two tokens that each token is merged from: what merging its bytes leaves before the last step."""
        for token, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            left = self._merged(token, below=rank)
            if len(left) == 2:
                pair = (self.rank[left[0]], self.rank[left[1]])
                self.parts[rank] = pair
                self.merge[pair] = rank

    def _merged(self, piece: bytes, below: int | None = None) -> list[bytes]:
        """Merging by definition: always the pair of lowest rank, leftmost first. For short strings and for tests."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
            best = min(ranks)
            if best == 1 << 60 or (below is not None and best >= below):
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps the two tokens apart where they stand side by side.

        Both are taken apart again, the later merge first. If at some moment the facing parts could have been merged
        before either of the tokens' own later steps, the pair can't stand.
        """
        known = self.agree.get((left, right))
        if known is not None:
            return known
        a, b, before = left, right, 1 << 60
        answer = True
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < before:
                answer = False
                break
            # undo the later of the two merges; of equal ranks the left one came first, so the right one is undone
            open_a, open_b = self.parts.get(a), self.parts.get(b)
            if open_a is None and open_b is None:
                break
            if open_b is None or (open_a is not None and a > b):
                before, a = a, open_a[1]
            else:
                before, b = b + 1, open_b[0]
        if len(self.agree) >= 4 * REMEMBERED:
            self.agree.clear()
        self.agree[(left, right)] = answer
        return answer

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of split text."""
        whole = self.rank.get(piece)
        if whole is not None and (len(piece) == 1 or whole in self.parts):
            return [whole]
        last: list[int] = [-1] * (len(piece) + 1)
        length, compatible = self.length, self.compatible
        ends: list[tuple[int, list[int]]] = []
        here: list[int] = []
        at = -1
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            if end != at:
                here = []
                ends.append((end, here))
                at = end
            here.append(token)
        for end, tokens in ends:
            for token in tokens:  # longest first
                start = end + 1 - length[token]
                if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                    last[end + 1] = token
                    break
        out = []
        at = len(piece)
        while at > 0:
            token = last[at]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text without special tokens; strings of special tokens are ordinary text."""
        out: list[int] = []
        pieces = self.pieces
        for m in self.split.finditer(text):
            p = m.group()
            ids = pieces.get(p)
            if ids is None:
                ids = tuple(self.piece(p.encode("utf-8")))
                if len(p) <= 64:
                    if len(pieces) >= REMEMBERED:
                        pieces.clear()
                    pieces[p] = ids
            out.extend(ids)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def slices(batch: pd.DataFrame, characters: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Rows of a batch in turn, about so many characters at a time, so that results of long texts don't pile up."""
    start = size = 0
    for i, t in enumerate(batch["text"]):
        size += len(t) if isinstance(t, str) else 0
        if size >= characters:
            yield batch.iloc[start : i + 1]
            start, size = i + 1, 0
    if start < len(batch) or not len(batch):
        yield batch.iloc[start:]


def encode_corpus(documents: DataFrame, key: str, text: str, vocabulary: str | None = None, lengths_only: bool = False) -> DataFrame:
    """Key and ``ids`` (array of int), or ``tokens`` (their number), of every row's whole text.

    A null text and an empty text have no ids: an empty list (0 tokens). Each row is encoded by itself where it lies;
    nothing is shuffled. ``vocabulary`` is the path of a rank file that every executor can read. Other columns are ignored.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode
        for batch in batches:
            for part in slices(batch):
                ids = [encode(t) if isinstance(t, str) else [] for t in part["text"]]
                yield pd.DataFrame({"key": part["key"], "out": [len(x) for x in ids] if lengths_only else ids})

    kind = documents.schema[key].dataType.simpleString()
    out = documents.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInPandas(run, f"key {kind}, out {'int' if lengths_only else 'array<int>'}")
    return out.selectExpr(f"key as `{key}`", f"out as {'tokens' if lengths_only else 'ids'}")
