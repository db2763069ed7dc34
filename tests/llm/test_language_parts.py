"""Plain versions of op5's parts: FTRL-proximal, temperature, TF-IDF weights."""

import math

import numpy as np
import pytest


def test_op5_follows_plain_ftrl(monkeypatch):
    from gleaner.llm import language_id as N

    monkeypatch.setattr(N, "FEATURES", 40)
    r = np.random.default_rng(5)
    rows = []
    for _ in range(90):
        cells = np.sort(r.choice(40, r.integers(1, 9), replace=False))
        rows.append((cells, r.random(len(cells))))
    label = r.integers(0, 3, 90)
    got, bias = N.fit_ftrl(rows, label, 3, epochs=2, batch=7)
    # the same, number by number
    alpha, beta, l1, l2 = 1.0, 1.0, 0.02, 0.01
    z, n = [[0.0] * 3 for _ in range(40)], [[0.0] * 3 for _ in range(40)]
    zb, nb, b = [0.0] * 3, [0.0] * 3, [0.0] * 3

    def weight(c, k):
        return 0.0 if abs(z[c][k]) <= l1 else -(z[c][k] - math.copysign(l1, z[c][k])) / ((beta + math.sqrt(n[c][k])) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(2):
        turn = order.permutation(90)
        for at in range(0, 90, 7):
            some = turn[at : at + 7]
            g, gb = {}, [0.0] * 3
            for i in some:
                s = [b[k] + sum(v * weight(c, k) for c, v in zip(*rows[i], strict=True)) for k in range(3)]
                e = [math.exp(x - max(s)) for x in s]
                for k in range(3):
                    d = (e[k] / sum(e) - (label[i] == k)) / len(some)
                    gb[k] += d
                    for c, v in zip(*rows[i], strict=True):
                        g[c, k] = g.get((c, k), 0.0) + d * v
            old = {ck: weight(*ck) for ck in g}
            for (c, k), d in g.items():
                z[c][k] += d - (math.sqrt(n[c][k] + d * d) - math.sqrt(n[c][k])) / alpha * old[c, k]
                n[c][k] += d * d
            for k in range(3):
                zb[k] += gb[k] - (math.sqrt(nb[k] + gb[k] ** 2) - math.sqrt(nb[k])) / alpha * b[k]
                nb[k] += gb[k] ** 2
                b[k] = -zb[k] / ((beta + math.sqrt(nb[k])) / alpha)
    assert np.allclose(got, [[weight(c, k) for k in range(3)] for c in range(40)], atol=1e-9) and np.allclose(bias, b, atol=1e-9)
    assert (got == 0).any()  # the net leaves some out


def test_op5_temperature_and_weights():
    from gleaner.llm import language_id as N

    r = np.random.default_rng(7)
    truth = r.normal(size=(4000, 3)) * 2
    label = np.array([r.choice(3, p=p) for p in N.softmax(truth)])
    for factor in (0.5, 1.0, 3.0):
        assert N.choose_temperature(truth * factor, label) == pytest.approx(factor, rel=0.1)
    assert N.choose_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0
    cells, values = N.weighted(np.array([1, 3]), np.array([1, 4]), np.array([0.0, 2.0, 0.0, 0.5]))
    plain = [2.0, (1 + math.log(4)) * 0.5]
    assert np.allclose(values, np.array(plain) / math.hypot(*plain)) and list(cells) == [1, 3]
