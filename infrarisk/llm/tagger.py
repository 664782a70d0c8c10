"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, emissions, batched Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")
N_TAGS = len(TAGS)
HIDDEN = 12
#: Character classes: digits, ASCII letters by case, other letters, blanks, line ends, each ASCII sign, the rest.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PAD, DIGIT, LOWER, UPPER, OTHER_LETTER, BLANK, LINE, REST = range(8)
N_CLASSES = 8 + len(_SIGNS)
_ASCII = np.full(128, REST, np.uint8)
_ASCII[48:58], _ASCII[97:123], _ASCII[65:91] = DIGIT, LOWER, UPPER
_ASCII[[9, 11, 12, 13, 32]], _ASCII[10] = BLANK, LINE
for _k, _c in enumerate(_SIGNS):
    _ASCII[ord(_c)] = 8 + _k


def classes(text: str) -> np.ndarray:
    """The class of every code point."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(a < 128, _ASCII[np.minimum(a, 127)], np.where(a < 0xC0, REST, OTHER_LETTER)).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Per direction: input gates by class, recurrent weights; then the output layer and CRF scores."""

    gates: list[np.ndarray]  # 2 x [classes, 4 * hidden]
    loops: list[np.ndarray]  # 2 x [hidden, 4 * hidden]
    out: np.ndarray  # [2 * hidden, tags]
    bias: np.ndarray
    moves: np.ndarray  # [tags, tags]: from, to
    first: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.gates, *self.loops, self.out, self.bias, self.moves, self.first]


def fresh_model(seed: int = 5) -> Model:
    rng = np.random.Generator(np.random.PCG64(seed))
    w = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
    m = Model([w(N_CLASSES, 4 * HIDDEN) for _ in "ab"], [w(HIDDEN, 4 * HIDDEN) for _ in "ab"], w(2 * HIDDEN, N_TAGS),
              np.zeros(N_TAGS, np.float32), np.zeros((N_TAGS, N_TAGS), np.float32), np.zeros(N_TAGS, np.float32))
    for g in m.gates:
        g[:, HIDDEN : 2 * HIDDEN] += 1  # remember at first
    return m


def _run(gates: np.ndarray, loop: np.ndarray, x: np.ndarray, keep: bool):
    """LSTM over time-major classes x[T, N]; hidden states, and with ``keep`` what the gradient needs."""
    t, n = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    states, tape = np.empty((t, n, HIDDEN), np.float32), []
    for k in range(t):
        z = gates[x[k]] + h @ loop
        ifo = _sigmoid(z[:, : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            tape.append((h, before, i, f, o, g, tc))
        h = o * tc
        states[k] = h
    return states, tape


def emissions(m: Model, x: np.ndarray) -> np.ndarray:
    """Tag scores [N, T, tags] of windows x[N, T]."""
    xt = np.ascontiguousarray(x.T)
    ahead, _ = _run(m.gates[0], m.loops[0], xt, False)
    back, _ = _run(m.gates[1], m.loops[1], xt[::-1], False)
    return (np.concatenate([ahead, back[::-1]], 2) @ m.out + m.bias).transpose(1, 0, 2)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _loss(m: Model, x: np.ndarray, y: np.ndarray):
    """Mean CRF loss of a batch (windows x[N, T], tags y[N, T]) and the gradient of every part."""
    xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    t, n = xt.shape
    runs = [_run(m.gates[0], m.loops[0], xt, True), _run(m.gates[1], m.loops[1], xt[::-1], True)]
    h = np.concatenate([runs[0][0], runs[1][0][::-1]], 2)
    e = h @ m.out + m.bias
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = m.first + e[0]
    for k in range(1, t):
        alpha[k] = _lse(alpha[k - 1][:, :, None] + m.moves, 1) + e[k]
    for k in range(t - 2, -1, -1):
        beta[k] = _lse(m.moves + (e[k + 1] + beta[k + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None])
    dmoves = np.zeros_like(m.moves)
    for k in range(1, t):
        dmoves += np.exp(alpha[k - 1][:, :, None] + m.moves + (e[k] + beta[k])[:, None, :] - z[:, None, None]).sum(0)
    rows = np.arange(n)
    gold = m.first[yt[0]] + e[0, rows, yt[0]]
    for k in range(1, t):
        gold = gold + m.moves[yt[k - 1], yt[k]] + e[k, rows, yt[k]]
        np.add.at(dmoves, (yt[k - 1], yt[k]), -1)
    for k in range(t):
        de[k, rows, yt[k]] -= 1
    dfirst = de[0].sum(0)
    dout, dbias = np.tensordot(h, de, ((0, 1), (0, 1))), de.sum((0, 1))
    dh = de @ m.out.T
    grads = []
    for d, (_, tape) in enumerate(runs):
        own = dh[:, :, :HIDDEN] if d == 0 else dh[::-1, :, HIDDEN:]
        xs = xt if d == 0 else xt[::-1]
        dg, dl = np.zeros_like(m.gates[d]), np.zeros_like(m.loops[d])
        hb, cb = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for k in range(t - 1, -1, -1):
            before_h, before_c, i, f, o, g, tc = tape[k]
            hb = hb + own[k]
            cb = cb + hb * o * (1 - tc * tc)
            dz = np.concatenate([cb * g * i * (1 - i), cb * before_c * f * (1 - f), hb * tc * o * (1 - o), cb * i * (1 - g * g)], 1)
            np.add.at(dg, xs[k], dz)
            dl += before_h.T @ dz
            hb, cb = dz @ m.loops[d].T, cb * f
        grads.append((dg, dl))
    return float((z - gold).mean()), [x / n for x in (grads[0][0], grads[1][0], grads[0][1], grads[1][1], dout, dbias, dmoves, dfirst)]


def train(x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 5) -> Model:
    """Adam over labelled windows x[N, T] (classes) and y[N, T] (tags); the same result for the same input."""
    m = fresh_model(seed)
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    first, second, step = [np.zeros_like(p) for p in m.parts()], [np.zeros_like(p) for p in m.parts()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            _, grads = _loss(m, x[order[i : i + batch]], y[order[i : i + batch]])
            step += 1
            lr = rate * (1 - epoch / epochs * 0.8)
            for p, g, a, b in zip(m.parts(), grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    return m


def allowed() -> np.ndarray:
    """-inf where a tag may not follow another: an inside tag needs a begin or inside tag of its kind before it."""
    a = np.zeros((N_TAGS, N_TAGS), np.float32)
    for k in range(len(KINDS)):
        a[:, 2 + 2 * k] = -1e9
        a[1 + 2 * k, 2 + 2 * k] = a[2 + 2 * k, 2 + 2 * k] = 0
    return a


def viterbi(m: Model, e: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Best tags [N, T] of emission rows e[N, T, tags]; rows are ``lens`` long, what follows is tag O."""
    n, t, _ = e.shape
    moves = m.moves + allowed()
    first = m.first.copy()
    first[2::2] = -1e9
    best, back = first + e[:, 0], np.zeros((n, t, N_TAGS), np.int8)
    back[:, 0] = np.arange(N_TAGS)
    for k in range(1, t):
        s = best[:, :, None] + moves
        choice = s.argmax(1)
        new = np.take_along_axis(s, choice[:, None, :], 1)[:, 0] + e[:, k]
        live = (k < lens)[:, None]
        back[:, k] = np.where(live, choice, np.arange(N_TAGS))
        best = np.where(live, new, best)
    tags, rows = np.zeros((n, t), np.int8), np.arange(n)
    now = best.argmax(1)
    for k in range(t - 1, -1, -1):
        tags[:, k] = np.where(k < lens, now, 0)
        now = back[rows, k, now]
    return tags
