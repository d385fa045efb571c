"""The gates of a step lie in one piece each, and the gradient through them is that of the loss."""

import numpy as np

from accordant.llm import gated_network


def test_gradient_of_the_gates(monkeypatch):
    rng = np.random.default_rng(4)
    net = {k: v.astype(np.float64) for k, v in gated_network.new_network(5, 4, np.full(5, 0.2)).items()}
    classes, offsets = rng.integers(0, 5, 60), np.array([0, 17, 40, 60])
    caught = []
    monkeypatch.setattr(gated_network.Trainer, "_update", lambda self, grad: caught.append(grad))
    loss = lambda net: gated_network.Trainer(net, 0, length=99).learn(classes, offsets, most_lanes=2)
    loss(net)
    grad = caught[0]
    for name in ("embed", "recur", "bias"):
        way = rng.normal(size=net[name].shape)
        more, less = (loss(net | {name: net[name] + step * way}) for step in (1e-4, -1e-4))
        assert np.isclose((more - less) / 2e-4, (grad[name] * way).sum(), rtol=1e-3, atol=1e-5), name
    table, recur = gated_network._by_gate(net)
    assert all(x.flags.c_contiguous for x in gated_network._step(table[:, np.array([1, 2, 3])], recur, np.zeros((3, 4))))
