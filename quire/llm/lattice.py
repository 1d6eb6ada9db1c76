"""Probabilities of words under a unigram vocabulary, over all their segmentations.

The vocabulary of a public tokenizer is taken as it is, with its scores as the starting weights; it is never trained. A word
is its bytes behind one space, and every byte is a piece of its own if the vocabulary has no other, so that each word
has a segmentation. Words are handled in batches: pieces are found by hashes of all byte ranges, and the recursions
run in log space over arcs in the order of their ends, one numpy step for each offset.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from quire.llm.textkit import _BASE, _BYTE, mix

BATCH_BYTES = 400_000


class Pieces:
    """Byte strings with the logarithm (base e) of their starting weights."""

    def __init__(self, weights: dict[bytes, float]):
        self.names = sorted(weights)
        self.start = np.array([weights[x] for x in self.names])
        self.start -= np.logaddexp.reduce(self.start)
        self.sizes = sorted({len(x) for x in self.names})
        joined = np.frombuffer(b"".join(self.names), np.uint8)
        size = np.array([len(x) for x in self.names])
        end = np.cumsum(size)
        h = _range_hashes(_Prefix(joined), end - size, size)
        self.order = np.argsort(h)
        self.hash = h[self.order]


@lru_cache(maxsize=2)
def read_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model. Its scores fall with the rank, and weights are those of Zipf's law over them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k):
            continue
        raw = model.id_to_piece(k).replace("▁", " ").encode()
        if b" " not in raw[1:]:
            found[raw] = max(found.get(raw, -np.inf), -np.log(2.0 - max(model.get_score(k), -1e9)))
    least = min(found.values(), default=0.0)
    for b in range(256):
        found.setdefault(bytes([b]), least)
    return Pieces(found)


class _Prefix:
    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            n = len(data) + 1
            up = np.full(n, _BASE, np.uint64)
            down = np.full(n, pow(_BASE, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            self.total = np.zeros(n, np.uint64)
            np.cumsum(_BYTE[data] * up[:-1], out=self.total[1:])


def _range_hashes(p: _Prefix, start: np.ndarray, size) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((p.total[start + size] - p.total[start]) * p.down[start], 17) + np.asarray(size).astype(np.uint64)


class Lattice:
    """All arcs of a batch of words: data and offsets hold the words, each behind a space."""

    def __init__(self, data: np.ndarray, off: np.ndarray, pieces: Pieces):
        size = np.diff(off)
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(off[-1])
        left = off[1:][word] - place  # bytes to the word's end
        p = _Prefix(data)
        starts, sizes, ids = [], [], []
        for n in pieces.sizes:
            at = np.flatnonzero(left >= n)
            if not len(at):
                break
            h = _range_hashes(p, at, n)
            k = np.minimum(np.searchsorted(pieces.hash, h), len(pieces.hash) - 1)
            hit = pieces.hash[k] == h
            starts.append(at[hit])
            sizes.append(np.full(int(hit.sum()), n))
            ids.append(pieces.order[k[hit]])
        start, n, self.piece = np.concatenate(starts), np.concatenate(sizes), np.concatenate(ids)
        self.word = word[start]
        # a word of b bytes has b + 1 nodes
        self.nodes = int(off[-1]) + len(size)
        self.first, self.last = off[:-1] + np.arange(len(size)), off[1:] + np.arange(len(size))
        self.a = start + self.word
        self.b = self.a + n
        self.rise, self.fall = self.b - self.first[self.word], self.last[self.word] - self.a

    def _sum(self, weight: np.ndarray, origin: np.ndarray, step: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
        value = np.full(self.nodes, -np.inf)
        value[origin] = 0.0
        order = np.lexsort((target, step))
        steps = step[order]
        cut = np.flatnonzero(np.append(True, steps[1:] != steps[:-1]))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            arcs = order[lo:hi]
            to = target[arcs]
            group = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            value[to[group]] = np.logaddexp.reduceat(value[source[arcs]] + weight[self.piece[arcs]], group)
        return value

    def forward(self, weight: np.ndarray) -> np.ndarray:
        return self._sum(weight, self.first, self.rise, self.a, self.b)

    def probability(self, weight: np.ndarray) -> np.ndarray:
        """Log probability (base e) of each word, over all segmentations."""
        return self.forward(weight)[self.last]

    def expected(self, weight: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected use of each piece, a word counting ``count`` times."""
        up, down = self.forward(weight), self._sum(weight, self.last, self.fall, self.b, self.a)
        share = np.exp(up[self.a] + weight[self.piece] + down[self.b] - up[self.last][self.word])
        return np.bincount(self.piece, share * count[self.word], minlength=len(weight))


def batches(words: pa.Array, size: int = BATCH_BYTES):
    """(slice, data, offsets) of runs of words of about ``size`` bytes, each word behind a space."""
    from quire.llm.textkit import buffers

    data, off = buffers(words)
    at = 0
    while at < len(words):
        stop = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        own = off[at : stop + 1] - off[at]
        spaced = np.insert(data[off[at] : off[stop]], own[:-1], 0x20)
        yield slice(at, stop), spaced, own + np.arange(len(own))
        at = stop
