"""The draws of one sweep over a batch of documents, in numpy.

Word-topic counts are frozen while a term block is sampled.  Within a document
the topic counts are refreshed between ``groups`` of neighbouring terms, in the
order of the terms.  Each draw depends only on frozen counts and on uniforms keyed by
(seed, sweep, step, document, position), so neither the batch nor the partition
a document sits in can change the outcome, nor whether it gets all counts or those of its
own terms.

Counts are sparse: memory and the tables of the word proposals take the non-zero ones, and a
Metropolis-Hastings draw takes constant time, or that of a binary search, whatever the
number of topics.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

CHUNK_CELLS = 4_000_000  # cells of the largest token x topic matrix
CHUNK_TOKENS = 400_000  # tokens of the documents that are worked on together

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(seed: int, sweep: int, step: int, doc_key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Counter-based uniforms in [0, 1)."""
    with np.errstate(over="ignore"):
        key = np.zeros(1, np.uint64)
        for part in (seed, sweep, step):
            key = _mix(key + _GOLDEN + np.uint64(part % 2**64))
        bits = _mix(_mix(doc_key.astype(np.uint64) ^ key) + (pos.astype(np.uint64) + 1) * _GOLDEN)
    return (bits >> np.uint64(11)) * 2.0**-53


def md5_uniforms(seed: int, sweep: int, step: int, doc_key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The same from MD5, which SQL can compute: slower, for checks."""
    texts = (f"{seed}:{sweep}:{step}:{k}:{p}" for k, p in zip(doc_key.tolist(), pos.tolist(), strict=True))
    return np.fromiter((int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in texts), float, len(pos)) / 2**32


def alias_tables(starts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alias tables (Walker 1977, Vose 1991) of all rows: (share, other, mass).

    Row r has the positive ``weights[starts[r]:starts[r + 1]]``, which sum to its mass.  A
    uniform position p of the row stands for p itself with probability ``share[p]``, else for
    ``other[p]``.  All rows are built side by side, an entry of each at a time.
    """
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    mass = np.bincount(row, weights, minlength=len(lengths))
    share, other = np.ones(len(weights)), np.arange(len(weights))
    scaled = weights * (lengths / np.where(mass > 0, mass, 1))[row]
    heavy = scaled >= 1
    order = np.argsort(2 * row + heavy, kind="stable")  # the light entries of a row come first
    light = starts[:-1].copy()
    rich = starts[:-1] + np.bincount(row, ~heavy, minlength=len(lengths)).astype(np.int64)
    going = np.flatnonzero((light < rich) & (rich < starts[1:]))
    i, last, j, end = light[going], rich[going], rich[going], starts[1:][going]
    left = scaled[order[j]]
    while len(i):
        gives = left >= 1
        # A rich entry fills a light one, or, fallen below one, is filled by the next rich one.
        taker = order[np.where(gives, i, j)]
        follows = np.minimum(j + 1, end - 1)
        share[taker] = np.where(gives, scaled[taker], left)
        other[taker] = np.where(gives, order[j], order[follows])
        left = np.where(gives, left - (1 - scaled[taker]), scaled[order[follows]] - (1 - left))
        broke = ~gives & (j + 1 >= end)  # only rounding is missing
        share[taker[broke]] = 1
        i, j = i + gives, np.where(gives, j, j + 1)
        on = (i < last) & (j < end)
        # A rich entry that is below one with no light one left still needs its filler.
        on |= (left < 1) & (j < end) & (i >= last)
        if not on.all():
            i, last, j, end, left = i[on], last[on], j[on], end[on], left[on]
    return share, other, mass


@dataclass
class BlockCounts:
    """Word-topic counts of the terms ``first <= term < last``, and topic totals.

    Rows are lists of (topic, count); all terms of the range have one, or those of ``terms``
    only.  Term ids are frequency ranks: terms below ``cutoff`` have a dense row as well.
    """

    first: int
    last: int
    terms: np.ndarray | None  # ascending; None for the whole range
    dense: np.ndarray  # hot terms x topics
    starts: np.ndarray  # offsets of the rows
    topics: np.ndarray
    counts: np.ndarray
    totals: np.ndarray
    keys: np.ndarray  # row * topics + topic, ascending
    word_alias: tuple | None = None
    free_alias: tuple | None = None

    @classmethod
    def build(cls, first, last, k, cutoff, term_id, topic, n, totals, terms=None) -> BlockCounts:
        order = np.lexsort((topic, term_id))
        term, topic, n = term_id[order].astype(np.int64), topic[order], n[order]
        count = last - first if terms is None else len(terms)
        row = term - first if terms is None else np.searchsorted(terms, term)
        hot = max(0, min(cutoff, last) - first) if terms is None else int(np.searchsorted(terms, cutoff))
        dense = np.zeros((hot, k))
        split = np.searchsorted(row, hot)
        dense[row[:split], topic[:split]] = n[:split]
        starts = np.searchsorted(row, np.arange(count + 1))
        return cls(
            first, last, terms, dense, starts, topic.astype(np.int32), n.astype(float), totals,
            row * k + topic,
        )

    def row_of(self, words: np.ndarray) -> np.ndarray:
        return words - self.first if self.terms is None else np.searchsorted(self.terms, words)

    def at(self, row: np.ndarray, topic: np.ndarray) -> np.ndarray:
        """The counts of (row, topic) pairs."""
        k, hot = len(self.totals), len(self.dense)
        if hot == len(self.starts) - 1:
            return self.dense[row, topic]
        key = row * k + topic
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = np.where(self.keys[place] == key, self.counts[place], 0.0)
        if hot:
            is_hot = row < hot
            found[is_hot] = self.dense[row[is_hot], topic[is_hot]]
        return found

    def rows(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dense count rows, and for each term the row that belongs to it."""
        local = self.row_of(terms)
        if len(self.dense) == len(self.starts) - 1:
            return self.dense, local
        unique, row_of = np.unique(local, return_inverse=True)
        table = np.zeros((len(unique), len(self.totals)))
        begin, length = self.starts[unique], self.starts[unique + 1] - self.starts[unique]
        at = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
        table[np.repeat(np.arange(len(unique)), length), self.topics[at]] = self.counts[at]
        return table, row_of

    def prepare(self, s: Settings) -> BlockCounts:
        """With the tables of the word proposals, which are proportional to
        (count + beta) / (total + V beta): a part by the counts, a part all words share."""
        smooth = self.totals + s.vocab_size * s.beta
        self.word_alias = alias_tables(self.starts, self.counts / smooth[self.topics])
        self.free_alias = alias_tables(np.array([0, s.k]), s.beta / smooth)
        return self

    def propose(self, row: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A topic for each row from its word proposal, in constant time, by a uniform each."""
        share, other, mass = self.word_alias
        free_share, free_other, free_mass = self.free_alias
        own = mass[row]
        x = u * (own + free_mass[0])
        found = np.empty(len(row), np.int64)
        by_word = x < own
        for mine, table, alias, start, length, y in (
            (by_word, share, other, self.starts[row], self.starts[row + 1] - self.starts[row], x / np.where(own > 0, own, 1)),
            (~by_word, free_share, free_other, np.zeros(len(row), np.int64),
             np.full(len(row), len(self.totals)), (x - own) / free_mass[0]),
        ):
            spot = y[mine] * length[mine]
            cell = np.clip(spot.astype(np.int64), 0, length[mine] - 1)
            place = start[mine] + cell
            place = np.where(spot - cell < table[place], place, alias[place])
            found[mine] = self.topics[place] if table is share else place
        return found


@dataclass
class Settings:
    k: int
    alpha: float
    beta: float
    vocab_size: int
    seed: int = 42
    mh_steps: int = 2
    groups: int = 8
    uniform: Callable = uniforms


def gibbs_draw(s: Settings, sweep, counts, doc, term, old, doc_key, pos, doc_topic, **_):
    """Topics drawn from the full conditional over all K topics."""
    new = np.empty_like(old)
    u = s.uniform(s.seed, sweep, 0, doc_key, pos)
    smooth = counts.totals + s.vocab_size * s.beta
    size = max(1, CHUNK_CELLS // s.k)
    for lo in range(0, len(old), size):
        part = slice(lo, lo + size)
        z, each = old[part], np.arange(len(old[part]))
        table, row = counts.rows(term[part])
        p, w = doc_topic[doc[part]].astype(float), table[row]
        p[each, z] -= 1
        w[each, z] -= 1
        p = (p + s.alpha) * (w + s.beta) / smooth
        own = (doc_topic[doc[part], z] - 1 + s.alpha) * (w[each, z] + s.beta)
        p[each, z] = own / (counts.totals[z] - 1 + s.vocab_size * s.beta)
        total = np.cumsum(p, axis=1)
        drawn = (total < (u[part] * total[:, -1])[:, None]).sum(axis=1)
        new[part] = np.minimum(drawn, s.k - 1)
    return new


def mh_draw(s: Settings, sweep, counts, doc, term, old, doc_key, pos, doc_topic, z, start, length):
    """Topics after ``mh_steps`` pairs of a word and a document proposal."""
    bb = s.vocab_size * s.beta
    smooth = counts.totals + bb
    row = counts.row_of(term)
    n, begin = length[doc], start[doc]

    def densities(k):
        """The target of topic k, and the word's and the document's proposal density."""
        by_word, by_doc, own = counts.at(row, k), doc_topic[doc, k], k == old
        target = (by_doc - own + s.alpha) * (by_word - own + s.beta) / (counts.totals[k] - own + bb)
        return target, (by_word + s.beta) / smooth[k], by_doc + s.alpha

    def step(current, known, proposal, which, u):
        """Accept or keep; also the densities of the outcome."""
        new = densities(proposal)
        accept = u * known[0] * new[which] < new[0] * known[which]
        kept = tuple(np.where(accept, a, b) for a, b in zip(new, known))
        return np.where(accept, proposal, current), kept

    current, known = old, densities(old)
    for pair in range(s.mh_steps):
        u = [s.uniform(s.seed, sweep, 4 * pair + i, doc_key, pos) for i in range(4)]
        current, known = step(current, known, counts.propose(row, u[0]), 1, u[1])
        spot = u[2] * (n + s.k * s.alpha)
        own = z[begin + np.minimum(spot.astype(np.int64), n - 1)]
        free = np.clip(((spot - n) / s.alpha).astype(np.int64), 0, s.k - 1)
        current, known = step(current, known, np.where(spot < n, own, free), 2, u[3])
    return current


DRAWS = {"naive": gibbs_draw, "mh": mh_draw}


def _documents(draw, s, sweep, counts, words, z, offsets, doc_keys):
    """Resample, in place, the tokens of some documents that fall into the block."""
    start, length = offsets[:-1], np.diff(offsets)
    doc = np.repeat(np.arange(len(length)), length)
    pos = np.arange(len(words)) - start[doc]
    cells = len(length) * s.k
    doc_topic = np.bincount(doc * s.k + z, minlength=cells).reshape(-1, s.k)
    flat = doc_topic.ravel()
    inside = np.flatnonzero((words >= counts.first) & (words < counts.last))
    group = words[inside].astype(np.int64) * s.groups // s.vocab_size
    order = np.argsort(group, kind="stable")
    inside, group = inside[order], group[order]
    for at in np.split(inside, np.flatnonzero(np.diff(group)) + 1):
        if not len(at):
            continue
        d, old = doc[at], z[at]
        new = draw(
            s, sweep, counts, d, words[at], old, doc_keys[d], pos[at], doc_topic,
            z=z, start=start, length=length,
        )
        z[at] = new
        np.add.at(flat, d * s.k + new, 1)
        np.subtract.at(flat, d * s.k + old, 1)


def sweep_documents(method, s: Settings, sweep, counts, words, z, offsets, doc_keys) -> np.ndarray:
    """New topics of a batch of documents given as flat arrays with row offsets."""
    z = z.astype(np.int64)
    if method == "mh" and counts.word_alias is None:
        counts.prepare(s)
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_TOKENS, side="right")) - 1
        last = min(max(last, first + 1), first + max(1, CHUNK_CELLS // s.k))
        lo, hi = offsets[first], offsets[last]
        _documents(
            DRAWS[method], s, sweep, counts, words[lo:hi], z[lo:hi],
            offsets[first : last + 1] - lo, doc_keys[first:last],
        )
        first = last
    return z
