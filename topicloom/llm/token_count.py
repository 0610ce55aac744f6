"""Token counts by rank-synchronous merging in ragged numpy arrays.

Byte-level BPE.  The pre-tokens of a batch lie one behind the other in flat arrays of
symbols and of the ranks of neighbouring pairs.  In every round each pre-token applies its
lowest-rank pair, all pre-tokens at once, until no pair has a rank; the symbols that
remain are its tokens.  Counts of frequent pre-tokens are remembered, up to a fixed number.

Everything happens where a row is read: no shuffle, and the merge table (as large as the
vocabulary) is all that is sent to tasks.  Null and empty texts have 0 tokens, texts of
any length are counted whole, every row gets a result whatever its id, and extra columns
are ignored.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import bounds, chunks, released
from topicloom.session import ship_package

#: White space, and the pattern that splits text for these vocabularies.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = r"\t-\r \x85\xa0  -     　"

#: Entries of the memo, and bytes of their words.
MEMO, MEMO_BYTES = 300_000, 16 * 2**20
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[list[int], list[tuple[int, int, int, int]], list[str]]:
    """Symbols of the 256 bytes, (left, right, rank, merged) of every merge, special strings.

    ``.tiktoken`` files hold ranks of whole byte strings, so each pair that spells one is a merge.
    """
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        merges = [
            (ids[t[:k]], ids[t[k:]], rank, rank)
            for t, rank in ids.items()
            for k in range(1, len(t))
            if t[:k] in ids and t[k:] in ids
        ]
        return [ids[bytes([b])] for b in range(256)], merges, []
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    vocabulary = whole["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
    merges = [
        (vocabulary[a], vocabulary[b], rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)
    ]
    letters = {b: vocabulary[c] for c, b in byte_letters().items()}
    special = [t["content"] for t in whole.get("added_tokens") or []]
    return [letters[b] for b in range(256)], merges, special


class Merges:
    """The merge table as sorted arrays."""

    def __init__(self, symbols, merges, special):
        table = np.array(sorted((a << 32 | b, r, m) for a, b, r, m in merges), dtype=np.int64)
        table = table.reshape(-1, 3)
        self.pairs, self.ranks, self.merged = table[:, 0], table[:, 1].astype(np.int32), table[:, 2]
        self.symbols = np.array(symbols, dtype=np.int64)
        self.special = special

    def _rank(self, left, right) -> np.ndarray:
        pair = left << 32 | right
        if not len(self.pairs):
            return np.full(len(pair), NO_RANK, np.int32)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], NO_RANK).astype(np.int32)

    def _merge(self, left, right) -> np.ndarray:
        return self.merged[np.searchsorted(self.pairs, left << 32 | right)]

    def merge(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that remain of each ragged row, and their owners, in order.

        ``owner`` is ascending and numbers the rows.
        """
        rank = np.full(len(symbols), NO_RANK, np.int32)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self._rank(symbols[inside], symbols[inside + 1])
        done = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            width = np.diff(np.append(first, len(symbols)))
            active = np.repeat(lowest < NO_RANK, width)
            if not active.all():  # finished rows leave
                done.append((symbols[~active], owner[~active]))
                symbols, owner, rank = symbols[active], owner[active], rank[active]
                lowest, width = lowest[lowest < NO_RANK], width[lowest < NO_RANK]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, width))
            # In a run of equal symbols pairs overlap: every other one is merged.
            new_run = np.concatenate([[True], np.diff(at) > 1])
            start = at[np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))]
            at = at[(at - start) % 2 == 0]
            symbols[at] = self._merge(symbols[at], symbols[at + 1])
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            here = np.cumsum(keep)[at] - 1
            changed = np.zeros(len(symbols) + 1, bool)
            changed[here] = changed[here - 1] = True  # the pair before the first is the spare cell
            touched = np.flatnonzero(changed[:-1])
            rank[touched] = NO_RANK
            touched = touched[touched + 1 < len(symbols)]
            touched = touched[owner[touched] == owner[touched + 1]]
            rank[touched] = self._rank(symbols[touched], symbols[touched + 1])
        if not done:
            return symbols, owner
        symbols, owner = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]

    def count(self, pre_tokens: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        sizes = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        symbols = self.symbols[np.frombuffer(b"".join(pre_tokens), np.uint8)]
        _, owner = self.merge(symbols, np.repeat(np.arange(len(sizes)), sizes))
        return np.bincount(owner, minlength=len(sizes))


class Counter:
    """Counts tokens of texts.

    Texts are cut at white space first, so that the memo has one entry for a word with
    its space and punctuation; the pre-token pattern never matches across such cuts.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.cut = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.split = regex.compile(PRE_TOKEN).findall
        self.special = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}
        self.held = 0

    def _pieces(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not self.special.search(text):
            return self.cut(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.cut(part)], len(parts) - 1

    def _learn(self, new: list[str]) -> None:
        parts = [self.split(piece) for piece in new]
        counts = self.merges.count([p.encode() for part in parts for p in part])
        edges = bounds([len(p) for p in parts])
        self.known.update(zip(new, np.add.reduceat(counts, edges[:-1]).tolist()))

    def count(self, texts: list[str]) -> np.ndarray:
        cut = [self._pieces(t) for t in texts]
        flat = [p for pieces, _ in cut for p in pieces]
        if len(self.known) > MEMO or self.held > MEMO_BYTES:  # what was not used since the last time goes
            self.known, self.before, self.held = {}, self.known, 0
        unknown = set(flat).difference(self.known)
        self.held += sum(map(len, unknown))
        self.known.update((p, self.before[p]) for p in unknown.intersection(self.before))
        new = list(unknown.difference(self.before))
        if new:
            self._learn(new)
        each = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        sums = np.concatenate([[0], np.cumsum(each)])
        edges = bounds([len(pieces) for pieces, _ in cut])
        return sums[edges[1:]] - sums[edges[:-1]] + np.array([s for _, s in cut], np.int64)


def token_counts(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 512,
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    ship_package(docs.sparkSession)
    merges = docs.sparkSession.sparkContext.broadcast(Merges(*read_vocabulary(vocabulary_path)))

    @released
    def count(batches):
        counter = Counter(merges.value)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                n_tokens = counter.count([t.decode() for t in texts])
                n_bytes = np.fromiter(map(len, texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                    ["id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)
