"""A gated recurrent network over word classes, and over words within a class, in numpy: training by truncated backpropagation, scoring in lanes.

The state is read by two softmax outputs: one over classes, and one within the class over its slots, each with learned weights.
A slot of -1 says that the class has but one word. Without slots, only classes are told.

Documents are laid end to end in lanes of about equal length that advance together. The state of a lane is reset where
a document starts and otherwise carried on, across the windows of the truncated gradient too, so the
probability of a word follows from its whole document before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

NAMES = ("embed", "recur", "bias", "output", "output_bias", "inner", "inner_bias")


def new_network(classes: int, width: int, frequency: np.ndarray, seed: int = 3, inner_bias: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """inner_bias: logits of the slots of each class to start from."""
    rng = np.random.default_rng(seed)
    shape = {"embed": (classes, 3 * width), "recur": (width, 3 * width), "bias": (3 * width,), "output": (width, classes)}
    net = {k: rng.normal(0, 0.3 if k == "embed" else 0.15, s).astype(np.float32) for k, s in shape.items()}
    net["bias"][:width] = 1.0  # keep most of the state at first
    net["output_bias"] = np.log(np.maximum(frequency, 1e-9)).astype(np.float32)
    if inner_bias is not None:
        net["inner"] = np.zeros((classes, width, inner_bias.shape[1]), np.float32)
        net["inner_bias"] = inner_bias.astype(np.float32)
    return net


def flatten(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in NAMES if k in net])


def restore(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in NAMES:
        if k not in like:
            continue
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def lay_out(lengths: np.ndarray, most_lanes: int) -> list[np.ndarray]:
    """Numbers of the documents of each lane, longest lane first: the longest document goes to the shortest lane."""
    total = int(lengths.sum())
    lanes = int(max(1, min(most_lanes, len(lengths), total // max(1, int(lengths.max(initial=1))))))
    heap = [(0, k) for k in range(lanes)]
    members: list[list[int]] = [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable"):
        size, k = heap[0]
        members[k].append(i)
        heapq.heapreplace(heap, (size + int(lengths[i]), k))
    sizes = [int(lengths[m].sum()) for m in members]
    return [np.array(members[k]) for k in np.argsort([-s for s in sizes], kind="stable") if members[k]]


def lane_tokens(classes: np.ndarray, offsets: np.ndarray, lanes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each lane: positions of its tokens in ``classes``, and which of them start a document."""
    for members in lanes:
        spans = [np.arange(offsets[i], offsets[i + 1]) for i in members]
        at = np.concatenate(spans)
        first = np.zeros(len(at), dtype=bool)
        first[np.concatenate([[0], np.cumsum([len(s) for s in spans])[:-1]]).astype(np.int64)] = True
        yield at, first


def _grid(classes: np.ndarray, offsets: np.ndarray, most_lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token position or -1, starts a document, lanes alive) by step and lane."""
    lanes = list(lane_tokens(classes, offsets, lay_out(np.diff(offsets), most_lanes)))
    steps = max((len(a) for a, _ in lanes), default=0)
    place = np.full((steps, len(lanes)), -1, dtype=np.int32)
    fresh = np.zeros((steps, len(lanes)), dtype=bool)
    for k, (at, first) in enumerate(lanes):
        place[: len(at), k] = at
        fresh[: len(at), k] = first
    return place, fresh, (place >= 0).sum(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _by_gate(net: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs by gate and class, and recurrent weights by gate, each gate's in one piece, so that no product or sum of a step is over strips of 16 numbers."""
    width = net["recur"].shape[0]
    split = lambda x: np.ascontiguousarray(x.reshape(len(x), 3, width).transpose(1, 0, 2))
    return split(net["embed"] + net["bias"]), split(net["recur"])


def _step(given: np.ndarray, recur: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """New state from the gates' inputs, by gate, and the state before; also gates and candidate, for the gradient."""
    from_state = np.matmul(h, recur)
    keep, reset = _sigmoid(given[:2] + from_state[:2])
    candidate = reset * from_state[2]
    candidate += given[2]
    np.tanh(candidate, out=candidate)
    new = h - candidate
    new *= keep
    new += candidate
    return new, keep, reset, candidate, from_state[2]


def _by_class(classes: np.ndarray) -> np.ndarray:
    """Their order, in which equal ones stay as they are; numpy sorts 16 bits by counting."""
    return np.argsort(classes.astype(np.uint16) if classes.max(initial=0) < 1 << 16 else classes, kind="stable")


def _bounded(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether exponentials of the logits, and their sums, stay well within the range of a float, so that the largest logit needs no care.

    States lie between -1 and 1, so a logit is no farther from its bias than the sum of its weights.
    """
    reach = float(np.abs(weights).sum(axis=-2).max())
    most = bias.max(axis=-1)
    return reach + float(most.max()) < 60 and float(most.min()) - reach > -60


def _with_one(state: np.ndarray) -> np.ndarray:
    """The states with a one at their end, which meets the bias below the weights: one product gives logits, or the gradients of both."""
    return np.concatenate([state, np.ones((len(state), 1), state.dtype)], axis=1)


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.concatenate([weights, bias[..., None, :]], axis=-2)


def _logits(state: np.ndarray, weights: np.ndarray, bounded: bool) -> np.ndarray:
    """Logits of states with a one, less the largest of each row unless they are bounded."""
    out = state @ weights
    if not bounded:
        out -= out.max(axis=1, keepdims=True)
    return out


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def _within_classes(net: dict[str, np.ndarray], state: np.ndarray, classes: np.ndarray, slots: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, rows of it that have a slot, logits of its slots, less the largest unless they are bounded) for every class that is there. state: with a one."""
    bounded, weights = _bounded(net["inner"], net["inner_bias"]), _with_bias(net["inner"], net["inner_bias"])
    rows = np.flatnonzero(slots >= 0)
    rows = rows[_by_class(classes[rows])]
    sorted_classes = classes[rows]
    edges = [0, *(np.flatnonzero(np.diff(sorted_classes)) + 1).tolist(), len(rows)] if len(rows) else []
    for low, high in zip(edges, edges[1:], strict=False):
        k, own = int(sorted_classes[low]), rows[low:high]
        yield k, own, _logits(state[own], weights[k], bounded)


def log_probabilities(net: dict[str, np.ndarray], classes: np.ndarray, offsets: np.ndarray, start: int, most_lanes: int = 512, window_rows: int = 16384, slots: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the probability of every token's class, with slots also of its slot in the class, given its document before it. ``start``: class that stands before a document."""
    out = np.zeros(len(classes), dtype=np.float32)
    if not len(classes):
        return out
    place, fresh, alive = _grid(classes, offsets, most_lanes)
    width = net["recur"].shape[0]
    table, recur = _by_gate(net)
    h = np.zeros((place.shape[1], width), np.float32)
    before = np.full(place.shape[1], start)
    held, where, rows = [], [], 0
    bounded, output = _bounded(net["output"], net["output_bias"]), _with_bias(net["output"], net["output_bias"])

    def settle() -> None:
        state, at = _with_one(np.concatenate(held)), np.concatenate(where)
        logits = _logits(state, output, bounded)
        own = logits[np.arange(len(at)), classes[at]].copy()
        np.exp(logits, out=logits)
        own -= np.log(_row_sums(logits))
        if slots is not None:
            for _, rows_of, inner in _within_classes(net, state, classes[at], slots[at]):
                chosen = inner[np.arange(len(rows_of)), slots[at[rows_of]]]
                own[rows_of] += chosen - np.log(_row_sums(np.exp(inner, out=inner)))
        out[at] = own

    for t in range(len(place)):
        n = int(alive[t])
        h, before, new = h[:n], before[:n], fresh[t, :n]
        if new.any():
            h = np.where(new[:, None], np.float32(0), h)
            before = np.where(new, start, before)
        h = _step(table[:, before], recur, h)[0]
        at = place[t, :n]
        before = classes[at]
        held.append(h)
        where.append(at)
        rows += n
        if rows >= window_rows:
            settle()
            held, where, rows = [], [], 0
    if rows:
        settle()
    return out


class Trainer:
    """Adam steps over windows of ``length`` tokens of all lanes; the state is carried from window to window."""

    def __init__(self, net: dict[str, np.ndarray], start: int, rate: float = 0.01, length: int = 24):
        self.net = {k: v.copy() for k, v in net.items()}
        self.start, self.rate, self.length = start, rate, length
        self.mean = {k: np.zeros_like(v) for k, v in net.items()}
        self.square = {k: np.zeros_like(v) for k, v in net.items()}
        self.updates = 0

    def learn(self, classes: np.ndarray, offsets: np.ndarray, most_lanes: int = 256, slots: np.ndarray | None = None) -> float:
        """One pass over some documents; returns the mean loss of a token."""
        if not len(classes):
            return 0.0
        place, fresh, alive = _grid(classes, offsets, most_lanes)
        width = self.net["recur"].shape[0]
        h = np.zeros((place.shape[1], width), np.float32)
        before = np.full(place.shape[1], self.start)
        loss = 0.0
        for low in range(0, len(place), self.length):
            high = min(low + self.length, len(place))
            n = int(alive[low])
            h, before, got = self._window(place[low:high, :n], fresh[low:high, :n], h[:n], before[:n], classes, slots)
            loss += got
        return loss / len(classes)

    def _window(self, place: np.ndarray, fresh: np.ndarray, h: np.ndarray, before: np.ndarray, classes: np.ndarray, slots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
        net, width = self.net, h.shape[1]
        table, recur = _by_gate(net)
        trace = []
        for t in range(len(place)):
            new = fresh[t]
            if new.any():
                h = np.where(new[:, None], np.float32(0), h)
                before = np.where(new, self.start, before)
            after, keep, reset, candidate, pulled = _step(table[:, before], recur, h)
            trace.append((h, keep, reset, candidate, pulled, before))
            h = after
            before = np.where(place[t] >= 0, classes[place[t]], self.start)
        states = np.concatenate([x[0] for x in trace[1:]] + [h]) if not fresh[1:].any() else None
        if states is None:  # a reset hides the state that the token before it was read from
            states = np.concatenate([x[3] + x[1] * (x[0] - x[3]) for x in trace])
        mask = (place >= 0).ravel()
        wanted = classes[np.maximum(place, 0)].ravel()
        states = _with_one(states)
        logits = _logits(states, _with_bias(net["output"], net["output_bias"]), _bounded(net["output"], net["output_bias"]))
        np.exp(logits, out=logits)
        total = _row_sums(logits)
        rows = np.arange(len(wanted))
        loss = float(-(np.log(logits[rows, wanted] / total) * mask).sum())
        share = (mask / max(1, mask.sum())).astype(np.float32)
        logits *= (share / total)[:, None]
        logits[rows, wanted] -= share
        both = states.T @ logits
        grad = {"output": both[:-1], "output_bias": both[-1]}
        back = logits @ net["output"].T
        if slots is not None:
            grad |= {k: np.zeros_like(net[k]) for k in ("inner", "inner_bias")}
            taken = np.where(mask, slots[np.maximum(place, 0)].ravel(), -1)
            for k, own, inner in _within_classes(net, states, wanted, taken):
                np.exp(inner, out=inner)
                inner /= _row_sums(inner)[:, None]
                at = np.arange(len(own)), taken[own]
                loss -= float(np.log(np.maximum(inner[at], 1e-30)).sum())
                inner[at] -= 1
                inner /= np.float32(mask.sum())
                both = states[own].T @ inner
                grad["inner"][k], grad["inner_bias"][k] = both[:-1], both[-1]
                back[own] += inner @ net["inner"][k].T
        back = back.reshape(len(place), -1, width)
        flow = np.zeros_like(h)
        # what the gradient of a state is multiplied by on its way to each gate, for all steps at once
        old, keep, reset, candidate, pulled = (np.stack([x[k] for x in trace]) for k in range(5))
        to_keep = (old - candidate) * keep * (1 - keep)
        to_candidate = (1 - keep) * (1 - candidate * candidate)
        to_pulled = to_candidate * reset
        to_reset = to_pulled * (1 - reset) * pulled
        back_recur = np.ascontiguousarray(net["recur"].T)
        into = np.empty((len(place), h.shape[0], 3 * width), np.float32)
        down = np.empty_like(back)
        for t in range(len(place) - 1, -1, -1):
            d = np.add(flow, back[t], out=down[t])
            for k, factor in enumerate((to_keep, to_reset, to_pulled)):
                np.multiply(d, factor[t], out=into[t, :, k * width : (k + 1) * width])
            flow = d * keep[t]
            flow += into[t] @ back_recur
            if fresh[t].any():
                flow[fresh[t]] = 0
        flat = into.reshape(-1, 3 * width)
        recur = old.reshape(-1, width).T @ flat
        np.multiply(down, to_candidate, out=into[:, :, 2 * width :])  # the input of the candidate isn't reset
        ids = np.concatenate([x[5] for x in trace])
        order = _by_class(ids)
        values, starts = np.unique(ids[order], return_index=True)
        grad["embed"] = np.zeros_like(net["embed"])
        grad["embed"][values] = np.add.reduceat(flat[order], starts)
        grad["bias"], grad["recur"] = flat.sum(axis=0), recur
        self._update(grad)
        return h, before, loss

    def _update(self, grad: dict[str, np.ndarray]) -> None:
        self.updates += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grad.values())))
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        rate = self.rate / (1 + self.updates / 1500) * np.sqrt(1 - 0.99**self.updates) / (1 - 0.9**self.updates)
        for k, g in grad.items():
            g = g * scale
            self.mean[k] += np.float32(0.1) * (g - self.mean[k])
            self.square[k] += np.float32(0.01) * (g * g - self.square[k])
            self.net[k] -= np.float32(rate) * self.mean[k] / (np.sqrt(self.square[k]) + np.float32(1e-7))
