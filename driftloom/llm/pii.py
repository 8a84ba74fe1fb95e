"""Personal data: exact base patterns and a character BiLSTM-CRF that adds spans to them.

Base: emails, IPv4 addresses, card numbers (Luhn) and phone numbers, leftmost and non-overlapping
for each kind, in time linear in the text.

Model: a character-level bidirectional LSTM with CRF transitions over BIO tags, trained here in
numpy on labelled spans that a seeded generator writes (with near misses as negatives). It finds the
forms the base does not have: addresses with (at) and (dot), bracketed dots, cards with other
separators, phones without plus sign. A text is tagged in overlapping windows; their decoded spans
are put together and reconciled over the whole text: pieces of a span cut by a window edge are
joined, and weighted interval scheduling keeps the non-overlapping set of the highest total score.
A span must also have the form of its kind (at and dot, four numbers up to 255, Luhn, nine to
fifteen digits), and any such span holds a digit, @, (at) or [at]; windows without these cannot give
one and are not run.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
HIDDEN, EMBEDDED = 24, 16
TRAINING = {"windows": 3200, "epochs": 8, "batch": 64, "rate": 0.02, "seed": 20240229}
#: Windows that are tagged at once.
BATCH = 256
Span = tuple[int, int, int]  # start, end, kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match runs up to an @ from the first character of the local run before it, so each @ has
    one candidate start."""
    cursor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            cursor = m.end()
        else:
            cursor = at + 1
        at = text.find("@", cursor)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """From each run of digits: a start inside a run matches only if the run's own start does."""
    cursor = 0
    while m := _DIGITS.search(text, cursor):
        if x := _IP.match(text, m.start()):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in x.group().split(".")):
                yield x.span()
            cursor = x.end()
        else:
            cursor = m.end()


def base_spans(text: str | None) -> list[Span]:
    """The base spans by start, then kind; code points, end exclusive."""
    if not text:
        return []
    out = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(s, e, 1) for s, e in _ips(text)]
        out += [(*m.span(), 2) for m in _CARD.finditer(text) if 12 <= len(d := _only_digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


_FORMS = (
    re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}"),
    re.compile(r"[0-9](?:[ ./-]?[0-9]){11,18}"),
    re.compile(r"(?:\+|00|\()?[0-9](?:[ ().-]{0,2}[0-9]){8,14}"),
)


def well_formed(text: str, kind: int) -> bool:
    """Whether a span that the model proposes has the form of its kind."""
    if not _FORMS[kind].fullmatch(text):
        return False
    if kind == 1:
        return all(int(p) <= 255 for p in _DIGITS.findall(text))
    if kind == 2:
        return luhn(_only_digits(text))
    return kind == 0 or len(re.findall(r"[ ().-]+", text)) >= 2 and not re.search(r"\.[0-9]{1,2}(?![0-9])", text)


# --- The tagger ---------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_CHARS = 100
_IDS = np.full(0x110000, 98, np.uint8)
_IDS[32:127] = np.arange(1, 96)
_IDS[[9, 10, 11, 12, 13]] = 96
_IDS[0xC0:0x250] = 97


def allowed() -> np.ndarray:
    """0 where tag j may follow tag i, -1e4 elsewhere: inside follows begin or inside of its kind."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for kind in range(len(KINDS)):
        b, i = 1 + 2 * kind, 2 + 2 * kind
        out[:, i] = -1e4
        out[[b, i], i] = 0
    return out


def char_ids(text: str) -> np.ndarray:
    return _IDS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


class Tagger:
    """BiLSTM-CRF with its own forward and backward passes. Parameters are float32 arrays; the two
    directions are the first axis of the recurrent ones and run together."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        h, e = HIDDEN, EMBEDDED
        w = lambda *s, k: (r.standard_normal(s) / np.sqrt(k)).astype(np.float32)
        bias = np.concatenate((np.zeros(h), np.ones(h), np.zeros(2 * h))).astype(np.float32)
        self.p = {
            "emb": w(_CHARS, e, k=4), "wx": w(2, e, 4 * h, k=e), "wh": w(2, h, 4 * h, k=h), "b": np.stack([bias, bias])[:, None],
            "out": w(2 * h, TAGS, k=2 * h), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32),
        }

    #: Gates in, forget, out (sigmoids, by way of tanh) and candidate (tanh).
    _HALF = np.concatenate((np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN))).astype(np.float32)

    def _lstm(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """x: time, direction, batch, embedded; gives the states and what the backward pass needs."""
        p, n = self.p, x.shape[2]
        gates = x @ p["wx"] + p["b"]
        h = c = np.zeros((2, n, HIDDEN), gates.dtype)
        out, kept = np.empty((len(x), 2, n, HIDDEN), gates.dtype), []
        half = self._HALF.astype(gates.dtype)
        for t in range(len(x)):
            z = np.tanh((gates[t] + h @ p["wh"]) * half)
            z[:, :, : 3 * HIDDEN] += 1
            z *= half
            i, f, o, g = z[:, :, :HIDDEN], z[:, :, HIDDEN : 2 * HIDDEN], z[:, :, 2 * HIDDEN : 3 * HIDDEN], z[:, :, 3 * HIDDEN :]
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            kept.append((z, tc, before))
        return out, kept

    def _lstm_back(self, x: np.ndarray, kept: list, dout: np.ndarray, grads: dict) -> np.ndarray:
        p, n = self.p, x.shape[2]
        dz = np.empty((len(x), 2, n, 4 * HIDDEN), dout.dtype)
        dh = dc = np.zeros((2, n, HIDDEN), dout.dtype)
        back = p["wh"].transpose(0, 2, 1)
        for t in range(len(x) - 1, -1, -1):
            z, tc, (_, c0) = kept[t]
            i, f, o, g = z[:, :, :HIDDEN], z[:, :, HIDDEN : 2 * HIDDEN], z[:, :, 2 * HIDDEN : 3 * HIDDEN], z[:, :, 3 * HIDDEN :]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            d = dz[t]
            d[:, :, :HIDDEN], d[:, :, HIDDEN : 2 * HIDDEN], d[:, :, 2 * HIDDEN : 3 * HIDDEN] = dc * g, dc * c0, dh * tc
            d[:, :, : 3 * HIDDEN] *= z[:, :, : 3 * HIDDEN] * (1 - z[:, :, : 3 * HIDDEN])
            d[:, :, 3 * HIDDEN :] = dc * i * (1 - g * g)
            dh, dc = d @ back, dc * f
        states = np.stack([before[0] for _, _, before in kept])
        rows = lambda y: y.transpose(1, 0, 2, 3).reshape(2, -1, y.shape[-1])
        grads["wh"] = rows(states).transpose(0, 2, 1) @ rows(dz)
        grads["wx"] = rows(x).transpose(0, 2, 1) @ rows(dz)
        grads["b"] = rows(dz).sum(axis=1)[:, None]
        return dz @ p["wx"].transpose(0, 2, 1)

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """Tag scores (time, batch, tags) of windows (batch, time)."""
        x = self.p["emb"][ids.T]
        x = np.stack([x, x[::-1]], axis=1)
        states, kept = self._lstm(x)
        h = np.concatenate((states[:, 0], states[::-1, 1]), axis=2)
        e = h @ self.p["out"] + self.p["out_b"]
        return (e, x, h, kept) if keep else e

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
        e, x, h, kept = self.emissions(ids, keep=True)
        steps, n, _ = e.shape
        trans = self.p["trans"] + allowed()
        y, rows = tags.T, np.arange(n)
        alpha = np.empty_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        total = _logsumexp(alpha[-1], 1)
        beta = np.zeros_like(e[0])
        de, dtrans = np.empty_like(e), np.zeros_like(trans)
        de[-1] = np.exp(alpha[-1] + beta - total[:, None])
        for t in range(steps - 1, 0, -1):
            right = e[t] + beta
            pair = alpha[t - 1][:, :, None] + trans + right[:, None, :] - total[:, None, None]
            dtrans += np.exp(pair).sum(axis=0)
            beta = _logsumexp(trans + right[:, None, :], 2)
            de[t - 1] = np.exp(alpha[t - 1] + beta - total[:, None])
        gold = e[np.arange(steps)[:, None], rows, y].sum() + trans[y[:-1], y[1:]].sum()
        de[np.arange(steps)[:, None], rows, y] -= 1
        np.add.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), -1)
        de, g = de / n, {"trans": dtrans / n}
        g["out"] = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        g["out_b"] = de.sum(axis=(0, 1))
        dh = de @ self.p["out"].T
        dout = np.stack([dh[:, :, :HIDDEN], dh[::-1, :, HIDDEN:]], axis=1)
        dx = self._lstm_back(x, kept, dout, g)
        dx = dx[:, 0] + dx[::-1, 1]
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], ids.T, dx)
        return float((total.sum() - gold) / n), g

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> list[float]:
        """Adam over shuffled batches; gives the mean loss of each epoch."""
        r, m, v, k, out = np.random.default_rng(seed), {}, {}, 0, []
        for epoch in range(epochs):
            order, losses = r.permutation(len(ids)), []
            for at in range(0, len(ids), batch):
                part = order[at : at + batch]
                loss, g = self.loss(ids[part], tags[part])
                losses.append(loss)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                k += 1
                for name, x in g.items():
                    x = x * min(1.0, 5 / (norm + 1e-9))
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * x
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * x * x
                    step = rate * 0.5 ** (epoch / 3) * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)
                    self.p[name] = (self.p[name] - step).astype(np.float32)
            out.append(float(np.mean(losses)))
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (batch, time) and, for each, the lead of its emission over the outside tag."""
        e = self.emissions(ids)
        trans = self.p["trans"] + allowed()
        score, back = e[0], np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            all_ = score[:, :, None] + trans
            back[t] = all_.argmax(axis=1)
            score = all_.max(axis=1) + e[t]
        tags, rows = np.empty(e.shape[:2], np.int64), np.arange(e.shape[1])
        tags[-1] = score.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t][rows, tags[t]]
        lead = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        return tags.T, lead.T


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


# --- Labelled spans -----------------------------------------------------------------------------

_PIECES = "th on er an re in ti ou ed sh en le la de que ción ado mente ung sch heit ein ver é è eau tre pa vi ment os as el".split()


def _card_number(r: Random, valid: bool) -> str:
    head = "".join(r.choices("0123456789", k=r.choice([12, 14, 15, 15, 15, 18])))
    last = next(d for d in "0123456789" if luhn(head + d))
    return head + (last if valid else str((int(last) + 1 + r.randrange(9)) % 10))


def _pii(r: Random, kind: int) -> str:
    word = lambda: "".join(c for c in "".join(r.choices(_PIECES, k=r.randint(1, 3))) if c.isascii()) or "x"
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    if kind == 0:
        at = r.choice(["@", " @ ", "(at)", " (at) ", "[at]", " [at] "])
        dot = "." if at == "@" and r.random() < 0.8 else r.choice([".", "(dot)", " (dot) ", "[dot]"])
        local = word() + r.choice(["", ".", "_"]) + r.choice([word(), digits(2)])
        return f"{local}{at}{word()}{r.choice(['', digits(1)])}{dot}{r.choice(['com', 'org', 'net', 'example', 'de'])}"
    if kind == 1:
        return r.choice([".", ".", "[.]", "(.)"]).join(str(r.randrange(256)) for _ in range(4))
    if kind == 2:
        number, gap = _card_number(r, True), r.choice(["", " ", "-", ".", "/"])
        return gap.join(number[i : i + 4] for i in range(0, len(number), 4))
    gap, area = r.choice([" ", "-", "."]), digits(3)
    head = r.choice(["+", "+", "00", "", "("])
    body = gap.join([digits(3), r.choice([digits(4), digits(2) + gap + digits(2)])])
    if head == "(":
        return f"({area}) {body}"
    return (head + digits(2) + gap if head else "") + area + gap + body


def _other(r: Random) -> str:
    """Near misses: hex tokens, plain and failing numbers, dates, times, prices, versions."""
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    return r.choice((
        lambda: "".join(r.choices("0123456789abcdef", k=40)), lambda: digits(r.randint(1, 11)), lambda: _card_number(r, False),
        lambda: f"20{digits(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randrange(24)}:{digits(2)}", lambda: f"{digits(2)}.{digits(2)}",
        lambda: f"v{r.randrange(9)}.{r.randrange(9)}.{r.randrange(9)}", lambda: f"#{digits(4)}", lambda: "(at) the", lambda: "[1]",
        lambda: ".".join(digits(3) for _ in range(3)), lambda: f"{r.randint(256, 999)}.{digits(3)}.{digits(3)}.{digits(3)}"))()


def labelled(windows: int, seed: int) -> tuple[list[str], list[list[Span]]]:
    """Texts of one window with the spans written into them."""
    r, texts, spans = Random(seed), [], []
    for _ in range(windows):
        style, text, own = r.randrange(4), "", []
        while len(text) < 2 * WINDOW:
            p = r.random()
            if p < 0.2:
                kind = r.randrange(4)
                value = _pii(r, kind)
                own.append((len(text), len(text) + len(value), kind))
                text += value
            elif p < 0.3:
                text += _other(r)
            else:
                w = "".join(r.choices(_PIECES, k=r.randint(1, 3)))
                text += w.upper() + "!!" if style == 1 else w + r.choice(["***", "$$$", "%%%", "###"]) if style == 2 else w
            text += r.choice([" ", " ", " ", ". ", ", ", "\n", " | "])
        cut = r.randint(0, len(text) - WINDOW)
        texts.append(text[cut : cut + WINDOW])
        spans.append([(max(s - cut, 0), min(e - cut, WINDOW), k) for s, e, k in own if e > cut and s < cut + WINDOW])
    return texts, spans


def tag_matrix(texts: list[str], spans: list[list[Span]]) -> tuple[np.ndarray, np.ndarray]:
    ids, tags = np.zeros((len(texts), WINDOW), np.uint8), np.zeros((len(texts), WINDOW), np.int64)
    for row, (text, own) in enumerate(zip(texts, spans, strict=True)):
        ids[row, : len(text)] = char_ids(text)
        for s, e, kind in own:
            tags[row, s:e] = 2 + 2 * kind
            tags[row, s] = 1 + 2 * kind  # also where the window's edge cuts the span
    return ids, tags


_trained: dict[tuple, Tagger] = {}


def trained(windows: int = TRAINING["windows"], epochs: int = TRAINING["epochs"], batch: int = TRAINING["batch"], rate: float = TRAINING["rate"], seed: int = TRAINING["seed"]) -> Tagger:
    """The tagger for these parameters; trained once in a process, always to the same weights."""
    key = (windows, epochs, batch, rate, seed)
    if key not in _trained:
        tagger = Tagger(seed)
        tagger.train(*tag_matrix(*labelled(windows, seed)), epochs, batch, rate, seed)
        _trained[key] = tagger
    return _trained[key]


# --- Spans of a text ----------------------------------------------------------------------------

def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a trigger."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    out: dict[int, None] = {}
    for m in _TRIGGER.finditer(text):
        low = max(0, (m.start() - WINDOW) // STRIDE + 1)
        for w in range(low, min(m.end() // STRIDE, last) + 1):
            out[w] = None
    return [w * STRIDE for w in sorted(out)]


def decoded(tags: np.ndarray, lead: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, score) of the spans in the tags of a window."""
    out, t, n = [], 0, len(tags)
    while t < n:
        if tags[t] == 0:
            t += 1
            continue
        kind, s = (int(tags[t]) - 1) // 2, t
        t += 1
        while t < n and tags[t] == 2 + 2 * kind:
            t += 1
        out.append((s, t, kind, float(lead[s:t].sum())))
    return out


def reconcile(text: str, proposals: list[tuple[int, int, int, float, bool, bool]], base: list[Span]) -> list[Span]:
    """Proposals (start, end, kind, score, cut left, cut right) of all windows of a text to spans.

    Pieces cut at an edge join with overlapping pieces of the same kind; well-formed spans that do
    not overlap a base span compete, and the non-overlapping set of the highest total score stays.
    """
    joined, open_ = [], {}
    for s, e, kind, score, left, right in sorted(proposals):
        held = open_.get(kind)
        if held and s < held[1] and (left or held[3]):
            e, score = max(e, held[1]), max(score, held[2])
            s = held[0]
            right = right and e > held[1] or held[3] and e == held[1]
        open_[kind] = (s, e, score, right)
        joined.append((s, e, kind, score))
    starts, ends = [s for s, _, _ in base], np.maximum.accumulate([e for _, e, _ in base]) if base else []
    best: dict[Span, float] = {}
    for s, e, kind, score in joined:
        piece = text[s:e].strip(" \t\r\n.,;:|")
        if not piece or not _TRIGGER.search(piece) or not well_formed(piece, kind):
            continue
        s = text.index(piece, s)
        e = s + len(piece)
        k = bisect_right(starts, e - 1)
        if k and ends[k - 1] > s or score <= 0:
            continue
        if s and text[s - 1].isalnum() or e < len(text) and text[e].isalnum():
            continue  # part of a longer word or number
        best[(s, e, kind)] = max(score, best.get((s, e, kind), 0.0))
    order = sorted(best, key=lambda x: (x[1], x))
    finish, total, take = [x[1] for x in order], [0.0], []
    for k, x in enumerate(order):
        before = bisect_right(finish, x[0], 0, k)
        gain = total[before] + best[x]
        take.append(gain > total[k])
        total.append(max(total[k], gain))
    out, k = [], len(order)
    while k:
        if take[k - 1]:
            out.append(order[k - 1])
            k = bisect_right(finish, order[k - 1][0], 0, k - 1)
        else:
            k -= 1
    return out


def model_spans(texts: list[str], tagger: Tagger, base: list[list[Span]]) -> list[list[Span]]:
    """The spans that the model adds to the base spans of these texts."""
    where = [(row, w) for row, t in enumerate(texts) for w in windows_of(t)]
    found: list[list] = [[] for _ in texts]
    for at in range(0, len(where), BATCH):
        part = where[at : at + BATCH]
        ids = np.zeros((len(part), WINDOW), np.uint8)
        for k, (row, w) in enumerate(part):
            x = char_ids(texts[row][w : w + WINDOW])
            ids[k, : len(x)] = x
        tags, lead = tagger.decode(ids)
        for k in np.flatnonzero(tags.any(axis=1)):
            row, w = part[k]
            n = len(texts[row])
            for s, e, kind, score in decoded(tags[k], lead[k]):
                s, e = w + s, min(w + e, n)
                if s < e:
                    found[row].append((s, e, kind, score, s == w and w > 0, e == w + WINDOW and e < n))
    return [reconcile(t, p, b) if p else [] for t, p, b in zip(texts, found, base, strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def _finder(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(0)
        tagger.p = weights
        for b in batches:
            out: list[list] = [[] for _ in range(5 + 1)]
            texts: list[str] = []
            held: list[list[Span]] = []

            def flush():
                for own, more in zip(held, model_spans(texts, tagger, held), strict=True):
                    for kind in range(4):
                        out[kind].append(sum(1 for s in own if s[2] == kind))
                    out[4].append(hashlib.sha256(joined(own).encode()).hexdigest())
                    out[5].append(joined(own + more))
                texts.clear()
                held.clear()

            for t in b.column(1):
                texts.append(t.as_py() or "")
                held.append(base_spans(texts[-1]))
                if len(texts) >= 512:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_pii(docs: DataFrame, **training) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs`` (doc_id,
    text, ...).

    The counts and the SHA-256 are of the base spans; ``spans`` also has those the model adds, which
    never overlap base spans. Spans are kind:start:end in code points. Null and empty texts have no
    spans; null doc_ids stay null; repeated rows are searched each; other columns are ignored. An
    empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_finder(trained(**training).p), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
