"""Operator 8's network against a plain convolution, at odd and even places alike."""

import numpy as np

from tagframe.llm import quality_cnn as Q


def made_net(seed=3):
    rng = np.random.default_rng(seed)
    return {"vector": rng.normal(0, 0.5, (256, Q.DIM)).astype(np.float32),
            "filter": rng.normal(0, 0.3, (Q.WIDTH * Q.DIM, Q.FILTERS)).astype(np.float32),
            "bias": rng.normal(0, 0.1, Q.FILTERS).astype(np.float32), "out": rng.normal(0, 0.2, 2 * Q.FILTERS).astype(np.float32),
            "last": np.array([0.1], np.float32)}


def plain(text: bytes, net) -> float:
    """Chunk by chunk, window by window."""
    parts, at = [], 0
    while True:
        parts.append(text[at:at + Q.CHUNK].ljust(Q.CHUNK, b"\0"))
        if at + Q.CHUNK >= len(text):
            break
        at += Q.HOP
    rows = []
    for part in parts:
        best = np.full(Q.FILTERS, -np.inf)
        for i in range(Q.CHUNK - Q.WIDTH + 1):
            window = np.concatenate([net["vector"][b] for b in part[i:i + Q.WIDTH]])
            best = np.maximum(best, window @ net["filter"])
        rows.append(np.maximum(best + net["bias"], 0))
    z = np.concatenate([np.max(rows, axis=0), np.mean(rows, axis=0)]) @ net["out"] + net["last"][0]
    return 1 / (1 + np.exp(-z))


def test_probability_equals_a_plain_convolution():
    net, rng = made_net(), np.random.default_rng(1)
    texts = [b"", b"a", b"\xc3\xa9" * 300, rng.integers(1, 256, 512).astype(np.uint8).tobytes(),
             rng.integers(1, 256, 513).astype(np.uint8).tobytes(), rng.integers(1, 256, 1500).astype(np.uint8).tobytes()]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    assert np.allclose(Q.probability(buf, offs, net), [plain(t, net) for t in texts], atol=1e-4)


def test_a_pattern_answers_alike_at_every_place():
    net = made_net()
    for k in range(8, 14):
        text = b" " * k + b"pattern!" + b" " * (40 - k)
        best = Q.respond(Q.chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0], net)
        if k == 8:
            first = best
        assert np.allclose(best, first, atol=1e-5)


def test_training_follows_the_gradient():
    """Repeated training on two told-apart kinds of text lowers the loss to nearly nothing."""
    texts = [b"good prose here " * (3 + i % 4) if i % 2 else b"#$%& junk 000 " * (3 + i % 3) for i in range(64)]
    y = np.array([i % 2 for i in range(64)])
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    few, many = (Q.probability(buf, offs, Q.train_network(texts, y, epochs=n)) for n in (1, 30))

    def loss(p):
        return -np.log(np.where(y == 1, p, 1 - p)).mean()
    assert loss(many) < 0.5 * loss(few) and ((many >= 0.5) == y).all()
