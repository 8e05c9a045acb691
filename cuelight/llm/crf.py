"""Linear-chain conditional random field with two labels: training by maximum likelihood, decoding by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    """Label 1 scores ``features @ weight + bias`` at each position, label 0 scores 0; ``move[a, b]`` joins neighbours a, b."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    move: np.ndarray
    first: np.ndarray

    def emit(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weight + self.bias

    def viterbi(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of the concatenated sequences; ties take label 1."""
        score = self.emit(features) if len(features) else np.zeros(0)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        by_length = np.argsort(-lengths, kind="stable")
        by_length = by_length[lengths[by_length] > 0]
        begin, sizes = begin[by_length], lengths[by_length]
        labels = np.zeros(len(features), np.int8)
        if not len(sizes):
            return labels
        # at step t only the sequences longer than t are alive; they stand first
        alive = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes[0]))]
        best = np.stack([np.full(len(sizes), self.first[0]), self.first[1] + score[begin]], 1)
        back = []
        for t in range(1, int(sizes[0])):
            k = alive[t]
            ways = best[:k, :, None] + self.move[None]
            came = np.where(ways[:, 1] >= ways[:, 0], 1, 0).astype(np.int8)
            top = np.maximum(ways[:, 0], ways[:, 1])
            top[:, 1] += score[begin[:k] + t]
            best[:k] = top
            back.append(came)
        state = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t in range(int(sizes[0]) - 1, -1, -1):
            k = alive[t]
            labels[begin[:k] + t] = state[:k]
            if t:
                state[:k] = back[t - 1][np.arange(k), state[:k]]
        return labels


def train(sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
    """Fit by Adam on the mean log-likelihood of the label sequences, by forward-backward over padded sequences.

    Without any sequence the field labels everything 1.
    """
    pairs = [(s, y) for s, y in zip(sequences, labels) if len(s)]
    if not pairs:
        width = sequences[0].shape[1] if sequences else 1
        return Crf(np.zeros(width), np.ones(width), np.zeros(width), 1.0, np.zeros((2, 2)), np.zeros(2))
    width, longest, count = pairs[0][0].shape[1], max(len(s) for s, _ in pairs), len(pairs)
    flat = np.concatenate([s for s, _ in pairs])
    mean, scale = flat.mean(0), flat.std(0)
    scale[scale < 1e-6] = 1.0
    x = np.zeros((count, longest, width))
    y = np.zeros((count, longest), np.int64)
    on = np.zeros((count, longest))
    for i, (s, v) in enumerate(pairs):
        x[i, : len(s)] = (s - mean) / scale
        y[i, : len(s)] = v
        on[i, : len(s)] = 1
    link = on[:, 1:]
    theta = np.zeros(width + 1 + 4 + 2)
    gold_unit = (on * (y == 1))[..., None]
    gold_w = np.einsum("ntk,ntd->d", gold_unit, x)
    gold_b = gold_unit.sum()
    gold_move = np.zeros((2, 2))
    np.add.at(gold_move, (y[:, :-1][link > 0], y[:, 1:][link > 0]), 1)
    gold_first = np.array([(y[:, 0] == 0).sum(), (y[:, 0] == 1).sum()], float)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, b, move, first = theta[:width], theta[width], theta[width + 1 : width + 5].reshape(2, 2), theta[width + 5 :]
        s = np.clip(x @ w + b, -30, 30)
        unit = np.stack([np.ones_like(s), np.exp(s)], -1)
        jump = np.exp(np.clip(move, -15, 15))
        ahead, back = np.zeros((count, longest, 2)), np.ones((count, longest, 2))
        a = np.exp(np.clip(first, -15, 15)) * unit[:, 0]
        ahead[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, longest):
            a = (ahead[:, t - 1] @ jump) * unit[:, t]
            a = a / a.sum(1, keepdims=True)
            ahead[:, t] = np.where(on[:, t, None] > 0, a, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            z = (unit[:, t + 1] * back[:, t + 1]) @ jump.T
            z = z / z.sum(1, keepdims=True)
            back[:, t] = np.where(on[:, t + 1, None] > 0, z, 1.0)
        post = ahead * back
        post /= post.sum(-1, keepdims=True)
        pair = ahead[:, :-1, :, None] * jump * (unit[:, 1:] * back[:, 1:])[:, :, None, :]
        pair /= pair.sum((-1, -2), keepdims=True)
        p1 = post[..., 1] * on
        grad = np.concatenate([
            gold_w - np.einsum("nt,ntd->d", p1, x), [gold_b - p1.sum()],
            (gold_move - (pair * link[..., None, None]).sum((0, 1))).ravel(), gold_first - post[:, 0].sum(0)]) / on.sum() - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(mean, scale, theta[:width], float(theta[width]), theta[width + 1 : width + 5].reshape(2, 2), theta[width + 5 :])
