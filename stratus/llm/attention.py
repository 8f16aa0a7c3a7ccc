"""A small causal self-attention language model in numpy.

One attention layer over embedded token ids with learned relative positions,
added to a projection of the token itself and squashed by tanh. The next id is
predicted along its path in a Huffman tree of the corpus's id counts: each inner
node is a logistic choice, so the probabilities of all ids sum to one and a
target costs as many choices as its path has nodes. With zero output weights and
the tree's own log odds as biases the model is the corpus's unigram model;
training starts there.

Windows of ``WINDOW`` inputs overlap by ``OVERLAP``; every target is scored once,
in the first window of its document or at the end of a later one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

DIMENSIONS = 12
WINDOW = 24
OVERLAP = 4
#: The largest exponent that is taken.
_MOST = np.float32(60)
#: The heaviest nodes, nearest to the root: training takes them in one product for all targets.
_HEAVY = 4
#: Equal targets that share the rows of their path in one product, in training and in scoring.
_TILE, _SCORED_TILE = 8, 32
#: Tiles that are scored at once.
_TILES_AT_ONCE = 256
_FAR = np.float32(-1e9)


class Tree(NamedTuple):
    """Each id's path: inner nodes and turns (1: to the second child), one id after the other."""
    first: np.ndarray
    nodes: np.ndarray
    turns: np.ndarray
    odds: np.ndarray


def huffman(counts: np.ndarray) -> Tree:
    """The tree of ``counts``, each raised by one so that unseen ids have a path."""
    n = len(counts)
    weights = [int(c) + 1 for c in counts]
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, turn = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
    odds = np.zeros(n - 1)
    for node in range(n, 2 * n - 1):
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        parent[left] = parent[right] = node
        turn[right] = 1
        odds[node - n] = np.log(b / a)
        heapq.heappush(heap, (a + b, node))
    paths, turns = [], []
    at = np.arange(n)
    alive = at != 2 * n - 2
    while alive.any():  # one step up for all ids
        paths.append(np.where(alive, parent[at] - n, -1))
        turns.append(turn[at])
        at = np.where(alive, parent[at], at)
        alive = at != 2 * n - 2
    table = np.array(paths).T.reshape(n, -1)
    used = table >= 0
    first = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    return Tree(first, table[used].astype(np.int32), np.array(turns).T.reshape(n, -1)[used], odds)


def fresh(tree: Tree, dimensions: int = DIMENSIONS, window: int = WINDOW, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters before training. ``out`` has the nodes' biases as last column."""
    rng = np.random.default_rng(seed)
    n, d = len(tree.first) - 1, dimensions
    out = np.zeros((n - 1, d + 1), np.float32)
    out[:, d] = tree.odds
    square = lambda: (rng.standard_normal((d, d)) / np.sqrt(d)).astype(np.float32)
    return {"embed": (0.5 * rng.standard_normal((n, d))).astype(np.float32), "out": out, "query": square(), "key": square(),
            "value": square(), "own": square(), "near": np.zeros((window, 1), np.float32)}


def windows(lengths: np.ndarray, window: int = WINDOW, overlap: int = OVERLAP) -> tuple[np.ndarray, ...]:
    """Per window its document, its first place in it and the first place it scores."""
    stride = window - overlap
    n = 1 + np.maximum(-(-(lengths - window) // stride), 0)
    doc = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, number * stride, np.where(number == 0, 0, number * stride + overlap)


class Model:
    def __init__(self, tree: Tree, params: dict[str, np.ndarray]):
        self.tree, self.p = tree, params
        self.window = len(params["near"])
        i = np.arange(self.window)
        self.back = np.maximum(i[:, None] - i, 0)
        self.ahead = np.where(i[:, None] >= i, np.float32(0), _FAR)
        self.paths = tree.first.astype(np.int32), tree.nodes, np.where(tree.turns == 1, -1, 1).astype(np.float32)
        self.split = self.whole = None

    def tables(self) -> np.ndarray:
        """Per id its query, key, value, a one and its own projection, side by side."""
        return self._projected(self.p["embed"])

    def _projected(self, rows: np.ndarray) -> np.ndarray:
        p, d = self.p, self.p["query"].shape[1]
        scale = np.float32(1 / np.sqrt(d))
        out = rows @ np.concatenate([p["query"] * scale, p["key"], p["value"], np.zeros((d, 1), np.float32), p["own"]], axis=1)
        out[:, 3 * d] = 1
        return out

    def _hidden(self, inputs: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, ...]:
        """The hidden rows, the weighted values, the weights, their sums, and the tables' parts.

        The one beside each value makes the product of weights and values hold the weights' sums too."""
        d = tables.shape[1] // 4
        every = tables.take(inputs, axis=0)
        q, k, v, own = (every[:, :, i:j] for i, j in ((0, d), (d, 2 * d), (2 * d, 3 * d + 1), (3 * d + 1, 4 * d + 1)))
        weights = q @ k.transpose(0, 2, 1)
        weights += self.p["near"][self.back, 0] + self.ahead
        np.minimum(weights, _MOST, out=weights)
        np.exp(weights, out=weights)
        mixed = weights @ v
        total = mixed[:, :, d:]
        mixed = mixed[:, :, :d] / total
        return np.tanh(mixed + own), mixed, weights, total, q, k, v

    def score(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Natural-log probabilities of ``targets[scored]``, in that order."""
        return self.path_scores(self.states(inputs, scored, tables), targets[scored])

    def states(self, inputs: np.ndarray, scored: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The hidden rows of the scored places, each followed by a one for the biases."""
        hidden = self._hidden(inputs, tables)[0]
        return _with_one(hidden.reshape(-1, hidden.shape[2]).take(np.flatnonzero(scored), axis=0))

    def _padded_paths(self, below: int) -> tuple[np.ndarray, ...]:
        """Per id the nodes under ``below`` on its path and half their signs, filled up with zeros; how many they
        are; and the ids' places when those with the most come first."""
        first, nodes, sign = self.paths
        n = len(first) - 1
        at = first[:-1, None] + np.arange(np.diff(first).max(), dtype=np.int32)
        inside = at < first[1:, None]
        padded = nodes.take(at, mode="clip")
        inside &= padded < below
        lengths = inside.sum(axis=1)  # paths begin far from the root
        at, padded, inside = (x[:, :lengths.max()] for x in (at, padded, inside))
        halves = np.zeros(padded.shape, np.float32)
        halves[inside] = np.float32(0.5) * sign[at[inside]]
        padded = np.where(inside, padded, 0)
        place = np.empty(n, np.uint16 if n <= 1 << 16 else np.int32)  # 16 bits are sorted by radix
        place[np.argsort(-lengths, kind="stable")] = np.arange(n)
        return padded, halves, lengths, place

    @staticmethod
    def _tiles(keys: np.ndarray, tile: int) -> tuple[np.ndarray, ...]:
        """Places with equal keys, ascending, in tiles of ``tile`` (the rest of a tile: the place after the last).

        Returns the tiles, the first place of each tile's key, and every place's slot."""
        order, edges = _grouped(keys)
        sizes = np.diff(np.append(edges, len(order)))
        tiles = -(-sizes // tile)
        slot = np.arange(len(order)) + np.repeat((np.cumsum(tiles) - tiles) * tile - edges, sizes)
        filled = np.full(int(tiles.sum()) * tile, len(order))
        filled[slot] = order
        back = np.empty(len(order), np.int64)
        back[order] = slot
        return filled, np.repeat(order[edges], tiles), back

    @staticmethod
    def _alike(lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Runs of descending lengths that differ by less than a fourth, and the longest of each; not the zeros."""
        a = 0
        while a < len(lengths) and lengths[a]:
            most = int(lengths[a])
            b = int(np.searchsorted(-lengths, -(most - most // 4), "right"))
            yield a, b, most
            a = b

    def path_scores(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural-log probabilities; places with the same target take its path in one product."""
        out = self.p["out"]
        if self.whole is None:
            self.whole = self._padded_paths(len(out))
        padded, halves, lengths, place = self.whole
        result = np.empty(len(targets))
        filled, firsts, back = self._tiles(place[targets], _SCORED_TILE)
        owner = targets[firsts]
        loss = np.zeros((len(owner), _SCORED_TILE))
        for a, b, most in self._alike(lengths[owner]):
            for i in range(a, b, _TILES_AT_ONCE):
                j = min(i + _TILES_AT_ONCE, b)
                at, sign = (x.take(owner[i:j], axis=0)[:, :most] for x in (padded, halves))
                rows = out.take(at.ravel(), axis=0).reshape(*at.shape, -1)
                rows *= 2 * sign[:, :, None]
                into = states.take(filled[i * _SCORED_TILE:j * _SCORED_TILE], axis=0, mode="clip").reshape(j - i, _SCORED_TILE, -1)
                # A filled-up node adds the logarithm of two.
                loss[i:j] = _softplus(into @ rows.transpose(0, 2, 1)).sum(axis=2)
                loss[i:j] -= ((sign == 0).sum(axis=1) * np.log(2))[:, None]
        np.negative(loss.ravel().take(back), out=result)
        return result

    def _path_gradient(self, states: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The slopes of the loss of ``targets`` by hidden row and by the touched rows of ``out``.

        A choice's slope is half of its turn plus the tangent of half its log odds. Equal targets lie together in
        tiles, those with the longest paths first; a tile's targets share the rows of their path."""
        out = self.p["out"]
        width, half = out.shape[1], out.dtype.type(0.5)
        signs, (padded, halves, lengths, place) = self._split_paths()
        heavy = len(out) - signs.shape[1]
        filled, firsts, back = self._tiles(place[targets], _TILE)
        owner = targets[firsts]
        source = np.zeros((len(states) + 1, width), out.dtype)  # the last row, of nothing, fills the tiles up
        source[:-1, :-1], source[:-1, -1] = states, 1
        into = source.take(filled, axis=0)
        tiled = into.reshape(len(owner), _TILE, width)
        # The heaviest nodes are taken for all targets.
        of_tile = signs[owner].astype(out.dtype)
        top = out[heavy:] * half
        twice = np.tanh(into @ top.T).reshape(len(owner), _TILE, -1)
        twice *= np.abs(of_tile)[:, None]
        twice += of_tile[:, None]
        twice = twice.reshape(len(into), -1)
        d_into = (twice @ top).reshape(tiled.shape)
        at_heavy = np.flatnonzero(of_tile.any(axis=0))
        touched, parts = [at_heavy + heavy], [half * (twice.T @ into)[at_heavy]]
        # The rest of the paths, tiles with paths of about a length at once.
        for a, b, most in self._alike(lengths[owner]):
            at, sign = (x.take(owner[a:b], axis=0)[:, :most].reshape(-1) for x in (padded, halves))
            used = np.flatnonzero(sign)
            sign = sign[:, None]
            rows = out.take(at, axis=0)
            rows *= sign
            rows = rows.reshape(b - a, most, width)
            twice = tiled[a:b] @ rows.transpose(0, 2, 1)
            np.tanh(twice, out=twice)
            twice += 1
            d_into[a:b] += twice @ rows
            g = (twice.transpose(0, 2, 1) @ tiled[a:b]).reshape(-1, width)
            g *= sign
            touched.append(at.take(used))
            parts.append(g.take(used, axis=0))
        d_states = d_into.reshape(into.shape).take(back, axis=0)[:, :-1]
        return d_states, _summed(np.concatenate(touched), np.concatenate(parts))

    def _split_paths(self) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Per id the signs of its choices at the heaviest nodes (0: not on its path), and the paths below these.

        Nodes are numbered by growing weight, so the heaviest are the last and end each path."""
        if self.split is None:
            first, nodes, sign = self.paths
            n, heavy = len(first) - 1, len(self.p["out"]) - min(_HEAVY, len(self.p["out"]))
            ids, top = np.repeat(np.arange(n), np.diff(first)), nodes >= heavy
            signs = np.zeros((n, len(self.p["out"]) - heavy), np.int8)
            signs[ids[top], nodes[top] - heavy] = sign[top]
            self.split = signs, self._padded_paths(heavy)
        return self.split

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray, with_loss: bool = True) -> tuple[float, dict]:
        """The summed loss (0 if not wanted) and, per parameter, the rows touched and their gradient."""
        p, d = self.p, self.p["query"].shape[0]
        flat_inputs = inputs.ravel()
        order, edges = _grouped(flat_inputs)
        seen = flat_inputs[order[edges]]
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(order))))
        rows = p["embed"][seen]
        hidden, mixed, weights, total, q, k, v = self._hidden(place.reshape(inputs.shape), self._projected(rows))
        at = np.flatnonzero(scored)
        flat, wanted = hidden.reshape(-1, d).take(at, axis=0), targets.ravel()[at]
        loss = -float(self.path_scores(_with_one(flat), wanted).sum()) if with_loss else 0.0
        d_flat, g_out = self._path_gradient(flat, wanted)
        slopes = np.zeros((len(at) + 1, d), hidden.dtype)  # the last row, of nothing, is that of the places not scored
        np.multiply(d_flat, 1 - flat * flat, out=slopes[:-1])
        of_place = np.full(scored.size, len(at))
        of_place[at] = np.arange(len(at))
        d_hidden = slopes.take(of_place, axis=0).reshape(hidden.shape)
        # Beside each slope less its part that goes to the weights' sum, all over that sum.
        shared = np.concatenate([d_hidden, -np.einsum("ijk,ijk->ij", d_hidden, mixed)[:, :, None]], axis=2)
        shared /= total
        d_scores = shared @ v.transpose(0, 2, 1)
        d_scores *= weights
        per_id = np.empty((*inputs.shape, 4 * d), hidden.dtype)
        np.matmul(d_scores, k, out=per_id[:, :, :d])
        np.matmul(d_scores.transpose(0, 2, 1), q, out=per_id[:, :, d:2 * d])
        np.matmul(weights.transpose(0, 2, 1), shared[:, :, :d], out=per_id[:, :, 2 * d:3 * d])
        per_id[:, :, 3 * d:] = d_hidden
        near = np.bincount(self.back.ravel(), d_scores.sum(axis=0).ravel(), self.window)[:, None]
        # The projections first: an id's sum is then as wide as its row.
        scale = np.repeat(np.array([1 / np.sqrt(d), 1, 1, 1], per_id.dtype), d)
        names, every = ("query", "key", "value", "own"), np.arange(d)
        own = rows.take(place, axis=0).reshape(*inputs.shape, d)
        by_name = (own.transpose(0, 2, 1) @ per_id).sum(axis=0) * scale
        grads = {name: (every, by_name[:, i * d:(i + 1) * d]) for i, name in enumerate(names)}
        by_place = per_id.reshape(-1, 4 * d) @ (scale[:, None] * np.concatenate([p[name].T for name in names]))
        grads["embed"] = (seen, np.add.reduceat(by_place.take(order, axis=0), edges, axis=0))
        grads["near"] = (np.arange(self.window), near.astype(np.float32))
        grads["out"] = g_out
        return loss, grads


def _softplus(x: np.ndarray) -> np.ndarray:
    x = np.minimum(x, _MOST)
    np.exp(x, out=x)
    x += 1
    return np.log(x, out=x)


def _with_one(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, np.ones((len(rows), 1), np.float32)], axis=1)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys lie together, ascending, and where each key begins in it."""
    narrow = keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys  # 16 bits are sorted by radix
    order = np.argsort(narrow, kind="stable")
    sorted_keys = keys[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), sorted_keys[1:] != sorted_keys[:-1]]))


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of their rows; ``take`` copies whole rows, which indexing does not."""
    order, first = _grouped(keys)
    return keys[order[first]], np.add.reduceat(rows.take(order, axis=0), first, axis=0)


class Trainer:
    """Adagrad with one step size per row; counts how often each row was touched."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate = model, rate
        self.squares = {name: np.full(len(x), 1e-3, np.float32) for name, x in model.p.items()}
        self.touched = {name: np.zeros(len(x), np.int64) for name, x in model.p.items()}

    def step(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> None:
        _, grads = self.model.gradient(inputs, targets, scored, with_loss=False)
        for name, (rows, g) in grads.items():
            squares = self.squares[name].take(rows)
            squares += np.einsum("ij,ij->i", g, g) / g.shape[1]
            self.squares[name][rows] = squares
            moved = g * (-self.rate / np.sqrt(squares))[:, None]
            moved += self.model.p[name].take(rows, axis=0)
            self.model.p[name][rows] = moved
            self.touched[name][rows] += 1
