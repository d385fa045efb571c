"""Logits that are bounded need no care of the largest one; those that aren't get it."""

import numpy as np

from accordant.llm import gated_network


def _net(scale, seed=4):
    rng = np.random.default_rng(seed)
    bias = np.log(rng.random((4, 3)) * 50 + 0.5)
    bias[3, 1] = -1e4
    net = gated_network.new_network(4, 3, np.full(4, 0.25), inner_bias=bias)
    net["inner"] = rng.normal(0, 0.5, net["inner"].shape).astype(np.float32)
    for k in ("output", "inner"):
        net[k] *= np.float32(scale)
    return net


def _seen(net, monkeypatch, bounded=None):
    if bounded is not None:
        monkeypatch.setattr(gated_network, "_bounded", lambda *_: bounded)
    rng = np.random.default_rng(0)
    classes, offsets = rng.integers(0, 4, 60), np.array([0, 8, 60])
    slots = np.where(classes == 0, -1, np.where(classes == 3, 2, rng.integers(0, 3, 60)))
    trainer, caught = gated_network.Trainer(net, 0, length=14), []
    trainer._update = lambda grad: caught.append({k: np.array(v) for k, v in grad.items()})
    loss = trainer.learn(classes, offsets, most_lanes=2, slots=slots)
    got = gated_network.log_probabilities(net, classes, offsets, 0, slots=slots)
    monkeypatch.undo()
    return loss, caught, got


def test_small_weights_are_bounded(monkeypatch):
    net = _net(1)
    assert gated_network._bounded(net["output"], net["output_bias"]) and gated_network._bounded(net["inner"], net["inner_bias"])
    loss, grads, got = _seen(net, monkeypatch)
    careful_loss, careful, careful_got = _seen(net, monkeypatch, bounded=False)
    assert abs(loss - careful_loss) < 1e-5 and np.abs(got - careful_got).max() < 1e-5
    assert all(np.abs(a[k] - b[k]).max() < 1e-5 for a, b in zip(grads, careful, strict=True) for k in a)


def test_large_weights_are_not(monkeypatch):
    net = _net(4000)
    assert not gated_network._bounded(net["output"], net["output_bias"]) and not gated_network._bounded(net["inner"], net["inner_bias"])
    _, grads, got = _seen(net, monkeypatch)
    assert np.isfinite(got).all() and all(np.isfinite(v).all() for g in grads for v in g.values())
