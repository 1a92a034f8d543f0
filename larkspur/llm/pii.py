"""Personal data by patterns and a character BiLSTM with CRF transitions (operator 9).

Patterns give the base spans.  A bidirectional LSTM over characters, with transitions between tags as in a conditional
random field, is trained in numpy on generated lines whose spans are labelled (``samples``: forms that the patterns
miss, as national phone numbers or disguised addresses, beside keys, dates and versions that are nobody's).  It adds
spans that meet no base span.

A span of any kind must hold a digit or an at sign, plain or in brackets, so only windows around such characters that no
base span covers are decoded; elsewhere the constraint leaves the tag O.  Windows overlap, cover whole texts, and are
reconciled for the whole text: a span cut by a window's edge counts only from a window that shows it whole (wider ones
are decoded until one does), and of those that overlap the set with the largest sum of confidences stays.

Null text counts as empty and has no spans.  Positions are code points, ends exclusive.  An empty table gives an empty
result.  Very long texts are worked on whole.  Repeated rows give repeated results; of overlapping spans with equal
confidence the first stays.  ``find`` ignores extra columns, ``redact`` keeps them, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NON_DIGIT = re.compile(r"[^0-9]+")
TRIGGER = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]", re.I)
WINDOW, LAP, AROUND = 96, 48, 40
#: A window is widened up to this: an address has 254 characters at most, and disguise some more.
LONGEST = 1536
CONFIDENT = 0.5


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(digits))) % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order.  Linear in the text: no run is looked at twice."""
    out = []
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m.groups()))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NON_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NON_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# --- the model ------------------------------------------------------------------------------------------------------

SYMBOLS = "abcdefghijklmnopqrstuvwxyz@.-+()[]{}_%:/\"'=,;#&* "
VOCABULARY = len(SYMBOLS) + 4  # digit, upper-case letter, line break, other


def _codes() -> np.ndarray:
    table = np.full(128, VOCABULARY - 1, "int64")
    for i, c in enumerate(SYMBOLS):
        table[ord(c)] = i
    table[48:58] = len(SYMBOLS)
    table[65:91] = len(SYMBOLS) + 1
    table[[9, 10, 13]] = len(SYMBOLS) + 2
    return table


CODES = _codes()


def symbols(windows: list[str], width: int = 0) -> np.ndarray:
    """Codes of the characters, each window filled up with blanks."""
    width = width or WINDOW
    raw = np.frombuffer("".join(w.ljust(width) for w in windows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(windows), width)
    return np.where(raw < 128, CODES[np.minimum(raw, 127)], VOCABULARY - 1)


def samples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated lines and their labelled spans (start, kind, end)."""
    rng = np.random.default_rng(seed)
    syllables = ("the an er en re ti on ha of in st le de la au ion che ung keit mos ra co do ent ver sch eau men que ci ó é ä ß".split())
    digit = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    one = lambda *x: x[rng.integers(len(x))]
    # words of any letters too: were some letters found in addresses alone, they would give addresses away
    spoken = lambda: one(*"bcdfghjklmnpqrstvwxyz", "st", "tr", "pl", "sch", "") + one(*"aeiouy", "ai", "ou") + one(*"bdfgklmnprstvwxyz", "", "", "nd", "ck")
    word = lambda: "".join(one(*syllables) if rng.random() < 0.5 else spoken() for _ in range(rng.integers(1, 4)))

    def card() -> str:
        d = digit(one(12, 13, 14, 15, 16, 16, 16, 18))
        return d + next(c for c in "0123456789" if luhn(d + c))

    def email() -> str:
        some = "".join(one(*"abcdefghijklmnopqrstuvwxyz") for _ in range(one(5, 9, 14, 22, 40)))
        some = one(str, str.upper, str.capitalize)(some)
        name, host = one(some, str.capitalize(word()), word() + "+" + word(), word() + digit(2), word() + one(".", "_") + word(), word(), one(".", "-", "_", "", "").join(word() for _ in range(rng.integers(3, 12)))), one("mail", "post", word(), word() + "-" + word()) + one("", digit(1))
        opened, closed = one("()", "[]", "{}")
        gap, pad, cased = one(" ", " ", ""), one("", "", " "), one(str, str, str, str.upper)
        aside = lambda x: gap + opened + pad + cased(x) + pad + closed + gap
        at, dot = one((aside("at"), one(aside("dot"), ".")), (aside("at"), one(aside("dot"), aside("."), ".", " . ")), ("@", "."), (" @ ", one(".", " . ")))
        ending = one("com", "org", "net", "de", "fr") if rng.random() < 0.6 else "".join(one(*"abcdefghijklmnopqrstuvwxyz") for _ in range(one(2, 2, 3, 4, 6)))
        return name + at + host + "".join(dot + one("example", word()) for _ in range(one(0, 0, 1, 1, 2))) + dot + ending

    def ip() -> str:
        return one(".", ".", "[.]", "(.)", "{.}", " . ").join(str(rng.integers(0, 256)) for _ in range(4))

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        if rng.random() < 0.45:  # a trunk or country prefix and groups of any size
            parts = [one("0", "00", "0", "1", "") + digit(one(1, 2, 3, 4)), *(digit(one(2, 2, 3, 4, 5, 7)) for _ in range(one(1, 2, 3, 4)))] + [digit(one(1, 2))] * (rng.random() < 0.15)
            sep = one(" ", "-", " ", ".")
            text = one(" / ", "/", " ", "-", ") ", sep).join(parts[:2]) + "".join(sep + x for x in parts[2:])
            text = "(" + text if ")" in text else text
            return text if 9 <= sum(map(str.isdigit, text)) <= 15 else phone()
        return one(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digit(1)} ({a}) {b}-{c}", f"00{digit(2)} {a} {b} {c}", f"({a}) {b} {c}", f"0{digit(2)}/{digit(7)}")

    def dotted_card() -> str:
        d = card()
        return one(d, one(" ", "-", ".", "  ").join(d[i : i + 4] for i in range(0, len(d), 4)))

    def other() -> str:
        hexa = "".join(one(*"0123456789abcdef") for _ in range(one(16, 18, 32, 40)))
        return one(f'token = "{hexa}"', f"password={hexa}", "AKIA" + "".join(one(*"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"Version {digit(1)}.{digit(1)}", f"version {digit(1)}.", f"{digit(4)}-{digit(2)}-{digit(2)}", f"{digit(2)}/{digit(2)}/{digit(4)}", digit(one(1, 2, 3, 4, 5, 6, 7, 8)), f"{digit(1)}.{digit(1)}.{digit(1)}", f"{digit(3)},{digit(3)}", f"{digit(2)}:{digit(2)}", f"@{word()}", f"$ {digit(2)}.{digit(2)}", f"CC BY-NC {digit(1)}.0", f"#{digit(4)}", f"({digit(4)})", f"{digit(2)} %", f"v{digit(1)}.{digit(2)}.{digit(1)}", f"id {digit(9)}", f"sha1:{hexa}")

    makers = (email, ip, dotted_card, phone)
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            text += " ".join(one("{}", "{}", "{}", "{}", "({})", '"{}"', "[{}]").format(one(str.capitalize, str, str, str.upper)(word())) + one("", "", "", "", ",", ".") for _ in range(rng.integers(1, 7))) + one(" ", " ", "\n", ": ")
            if rng.random() < 0.5:
                kind = int(rng.integers(4))
                value = makers[kind]()
                spans.append((len(text), kind, len(text) + len(value)))
                text += value + one(" ", " ", ". ", ", ", "\n")
            elif rng.random() < 0.7:
                text += other() + one(" ", " ", ". ", "\n")
        out.append((text, spans))
    return out


class Tagger:
    """Embedding, two LSTMs, a linear layer to tag scores, and transitions between tags."""

    def __init__(self, embed: int = 12, hidden: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        k, self.hidden = len(TAGS), hidden
        self.p = {"embed": w(VOCABULARY, embed) * 0.5, "out": w(2 * hidden, k), "bias": np.zeros(k), "trans": np.zeros((k, k)), "first": np.zeros(k)}
        for d in "fb":
            self.p |= {f"x{d}": w(embed, 4 * hidden), f"h{d}": w(hidden, 4 * hidden), f"c{d}": np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])}
        self.bar = np.zeros((k, k))  # a tag I follows only B or I of its kind
        self.bar0 = np.zeros(k)
        for j, name in enumerate(TAGS):
            if name[0] == "I":
                self.bar0[j] = -1e4
                for i, prev in enumerate(TAGS):
                    if prev[2:] != name[2:]:
                        self.bar[i, j] = -1e4

    def lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of one direction over (time, row, embed); what the way back needs."""
        n, h = x.shape[1], self.hidden
        state, cell, states, kept = np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype), [], []
        into = x @ self.p[f"x{d}"].astype(x.dtype) + self.p[f"c{d}"].astype(x.dtype)
        back = self.p[f"h{d}"].astype(x.dtype)
        for t in range(len(x)):
            z = into[t] + state @ back
            gates = 1 / (1 + np.exp(-z[:, : 3 * h]))
            new = np.tanh(z[:, 3 * h :])
            f, i, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, cell = cell, f * cell + i * new
            shown = np.tanh(cell)
            kept.append((state, before, f, i, o, new, shown))
            state = o * shown
            states.append(state)
        return np.stack(states), kept

    def lstm_back(self, x: np.ndarray, d: str, kept: list, ds: np.ndarray, grad: dict) -> np.ndarray:
        h = self.hidden
        dz_all = np.zeros((len(x), x.shape[1], 4 * h), x.dtype)
        back = self.p[f"h{d}"].T.astype(x.dtype)
        d_state, d_cell = np.zeros_like(ds[0]), np.zeros_like(ds[0])
        for t in range(len(x) - 1, -1, -1):
            state, before, f, i, o, new, shown = kept[t]
            d_out = ds[t] + d_state
            d_cell = d_cell + d_out * o * (1 - shown**2)
            dz = np.concatenate([d_cell * before * f * (1 - f), d_cell * new * i * (1 - i), d_out * shown * o * (1 - o), d_cell * i * (1 - new**2)], 1)
            grad[f"h{d}"] += state.T @ dz
            d_state, d_cell, dz_all[t] = dz @ back, d_cell * f, dz
        grad[f"x{d}"] += np.tensordot(x, dz_all, ((0, 1), (0, 1)))
        grad[f"c{d}"] += dz_all.sum((0, 1))
        return dz_all @ self.p[f"x{d}"].T.astype(x.dtype)

    def emissions(self, codes: np.ndarray, dtype="float64"):
        x = self.p["embed"].astype(dtype)[codes.T]
        forward, kept_f = self.lstm(x, "f")
        backward, kept_b = self.lstm(x[::-1], "b")
        both = np.concatenate([forward, backward[::-1]], 2)
        return both @ self.p["out"].astype(dtype) + self.p["bias"].astype(dtype), (x, both, kept_f, kept_b)

    def marginals(self, e: np.ndarray, pairs: bool = False):
        """Probability of each tag at each place, (time, row, tag); the log of the sum over all paths; expected transitions."""
        trans, first = self.p["trans"] + self.bar, self.p["first"] + self.bar0
        a, b = np.zeros(e.shape), np.zeros(e.shape)
        expt = np.exp(trans)
        a[0] = first + e[0]
        for t in range(1, len(e)):
            top = a[t - 1].max(1, keepdims=True)
            a[t] = np.log(np.exp(a[t - 1] - top) @ expt + 1e-300) + top + e[t]
        for t in range(len(e) - 2, -1, -1):
            x = b[t + 1] + e[t + 1]
            top = x.max(1, keepdims=True)
            b[t] = np.log(np.exp(x - top) @ expt.T + 1e-300) + top
        total = a[-1].max(1) + np.log(np.exp(a[-1] - a[-1].max(1, keepdims=True)).sum(1))
        m = np.exp(a + b - total[None, :, None])
        if not pairs:
            return m, total, None
        both = sum(np.exp(a[t][:, :, None] + trans[None] + (e[t + 1] + b[t + 1])[:, None, :] - total[:, None, None]).sum(0) for t in range(len(e) - 1))
        return m, total, both

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best path of tags, (row, time)."""
        trans, score = self.p["trans"] + self.bar, self.p["first"] + self.bar0 + e[0]
        came = []
        for t in range(1, len(e)):
            x = score[:, :, None] + trans
            came.append(x.argmax(1))
            score = x.max(1) + e[t]
        path = [score.argmax(1)]
        for back in reversed(came):
            path.append(back[np.arange(len(path[-1])), path[-1]])
        return np.stack(path[::-1], 1)

    def gradient(self, codes: np.ndarray, tags: np.ndarray, dtype="float64") -> tuple[float, dict]:
        """Mean loss (negative log-likelihood of the tags) and its gradient; the layers below the tags in ``dtype``."""
        e, (x, both, kept_f, kept_b) = self.emissions(codes, dtype)
        e = e.astype("float64")
        m, total, pairs = self.marginals(e, True)
        n, rows, steps = len(codes), np.arange(len(codes)), np.arange(codes.shape[1])[:, None]
        y = tags.T
        trans = self.p["trans"] + self.bar
        gold = (self.p["first"] + self.bar0)[y[0]] + e[steps, rows, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = m.copy()
        de[steps, rows, y] -= 1
        seen = np.zeros_like(trans)
        np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
        grad["trans"], grad["first"] = pairs - seen, de[0].sum(0)
        de = de.astype(dtype)
        grad["out"], grad["bias"] = np.tensordot(both, de, ((0, 1), (0, 1))), de.sum((0, 1))
        ds = de @ self.p["out"].T.astype(dtype)
        h = self.hidden
        dx = self.lstm_back(x, "f", kept_f, ds[:, :, :h], grad) + self.lstm_back(x[::-1], "b", kept_b, ds[::-1, :, h:], grad)[::-1]
        np.add.at(grad["embed"], codes.T, dx)
        return float((total - gold).mean()), {k: v / n for k, v in grad.items()}


def tagged(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(WINDOW, int)
    for a, kind, b in spans:
        if a < WINDOW:
            out[a : min(b, WINDOW)] = 2 + 2 * kind
            out[a] = 1 + 2 * kind
    return out


def lesson(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A window of a line: from any place outside its spans, as long as windows are, or to another such place, as at the
    end of a text."""
    free = [0, *(k for k in range(1, len(text)) if not any(a < k < b for a, _, b in spans)), len(text)]
    start = 0 if rng.random() < 0.3 else int(free[rng.integers(len(free) // 2)])
    ends = [k for k in free if start < k <= start + WINDOW]
    end = start + WINDOW if rng.random() < 0.4 or not ends else int(ends[rng.integers(len(ends) // 2, len(ends))])
    return text[start:end], [(a - start, kind, b - start) for a, kind, b in spans if a >= start and a < end]


@lru_cache(maxsize=2)
def trained(n: int = 6000, epochs: int = 7, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Tagger:
    """Trains on ``n`` generated lines with Adam, at a rate that falls to nothing; the same model every time, up to the
    rounding of the machine's matrix library."""
    model, rng = Tagger(), np.random.default_rng(seed)
    lines = [lesson(*line, rng) for line in samples(n, seed)]
    codes, tags = symbols([t[:WINDOW] for t, _ in lines]), np.stack([tagged(*x) for x in lines])
    first, second, k = {x: np.zeros_like(v) for x, v in model.p.items()}, {x: np.zeros_like(v) for x, v in model.p.items()}, 0
    steps = epochs * -(-n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            k += 1
            _, grad = model.gradient(codes[order[at : at + batch]], tags[order[at : at + batch]], "float32")
            norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
            for x, g in grad.items():
                g *= min(1, 5 / norm)
                first[x] = 0.9 * first[x] + 0.1 * g
                second[x] = 0.999 * second[x] + 0.001 * g**2
                model.p[x] -= rate * max(0.02, 1 - k / steps) * first[x] / (1 - 0.9**k) / (np.sqrt(second[x] / (1 - 0.999**k)) + 1e-8)
    return model


# --- windows and their reconciliation -------------------------------------------------------------------------------


def valid(kind: int, value: str) -> bool:
    """What an added span must hold, whatever the model says."""
    d = NON_DIGIT.sub("", value)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|[\[({] ?at ?[\])}]) ?[\w-]+(?: ?(?:\.|[\[({] ?(?:dot|\.) ?[\])}]) ?[\w-]+)+", value, re.I))
    if kind == 1:
        return bool(m := re.fullmatch(r"(\d+)\W+(\d+)\W+(\d+)\W+(\d+)", value, re.A)) and all(map(small, m.groups()))
    if kind == 2:
        return bool(re.fullmatch(r"\d(?:[ .-]{0,2}\d)+", value, re.A)) and 12 <= len(d) <= 19 and luhn(d)
    return bool(re.fullmatch(r"[+(]?\d[\d ()./-]*\d", value, re.A)) and 9 <= len(d) <= 15 and len(d) < len(value)


def places(text: str, covered: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Windows (start, end) around triggers that no base span covers."""
    spans = merged([(a, b) for a, _, b in covered])
    starts = [a for a, _ in spans]
    parts: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        k = bisect.bisect_right(starts, m.start()) - 1
        if k >= 0 and m.start() < spans[k][1]:
            continue
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if parts and a <= parts[-1][1]:
            parts[-1][1] = b
        else:
            parts.append([a, b])
    out = []
    for a, b in parts:
        at = a
        while True:
            out.append((at, min(at + WINDOW, len(text))))
            if at + WINDOW >= b:
                break
            at += LAP
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of spans (start, kind, end, confidence) those without overlaps that have the largest sum; ties to the first."""
    found = sorted(set(found), key=lambda s: (s[2], s[0], s[1]))
    ends, best, take = [s[2] for s in found], [0.0], []
    for i, (a, _, _, c) in enumerate(found):
        before = bisect.bisect_right(ends, a, 0, i)
        use = best[before] + c
        take.append(before if use > best[-1] else -1)
        best.append(max(use, best[-1]))
    out, i = [], len(found)
    while i:
        if take[i - 1] >= 0:
            out.append(found[i - 1][:3])
            i = take[i - 1]
        else:
            i -= 1
    return out[::-1]


def decoded(model: Tagger, texts: list[str], part: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, float]], list[tuple[int, int, int]]]:
    """Spans (text, start, kind, end, confidence) that windows (text, start, end) of about one length show whole, and
    those (text, start, end) that a window's edge cuts."""
    width = max(WINDOW, max(b - a for _, a, b in part))
    e = model.emissions(symbols([texts[i][a:b] for i, a, b in part], width), "float32")[0].astype("float64")
    path, sure = model.decode(e), model.marginals(e)[0]
    out, cut = [], []
    for r, (i, a, b) in enumerate(part):
        tags, at, n = path[r], 0, b - a
        while at < n:
            if (tag := tags[at]) % 2 == 0:
                at += 1
                continue
            end = at + 1
            while end < n and tags[end] == tag + 1:
                end += 1
            if (at > 0 or a == 0) and (end < n or b == len(texts[i])):
                out.append((i, a + at, int(tag) // 2, a + end, float(sure[np.arange(at, end), r, tags[at:end]].mean())))
            else:
                cut.append((i, a + at, a + end))
            at = end
    return out, cut


def added_spans(model: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]], batch: int = 256) -> list[list[tuple[int, int, int]]]:
    """The model's spans of each text that meet no base span.  Where a window cuts a span that no other window shows
    whole, a window twice as wide around it is decoded, and so on, up to LONGEST characters."""
    windows = [(i, a, b) for i, (t, s) in enumerate(zip(texts, base, strict=True)) for a, b in places(t, s)]
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    width = WINDOW
    while windows:
        cut = []
        step = max(1, batch * WINDOW // width)
        for k in range(0, len(windows), step):
            whole, broken = decoded(model, texts, windows[k : k + step])
            cut += broken
            for i, start, kind, stop, c in whole:
                text = texts[i]
                while stop > start and text[stop - 1] in " .,;:\n":
                    stop -= 1
                if start > 0 and text[start - 1].isalnum() or stop < len(text) and text[stop].isalnum():
                    cut.append((i, start, stop))  # something of it lies outside
                elif c >= CONFIDENT and valid(kind, text[start:stop]):
                    found[i].append((start, kind, stop, c))
        cut = [(i, a, b) for i, a, b in cut if not any(x < b and a < y for x, _, y, _ in found[i])]
        width *= 2
        around = {(i, max(0, (a + b) // 2 - width // 2), min(len(texts[i]), (a + b) // 2 + width // 2)) for i, a, b in cut}
        windows = sorted(around) if width <= LONGEST else []
    out = []
    for spans, known in zip(found, base, strict=True):
        known = merged([(a, b) for a, _, b in known])
        meets = lambda s: any(a < s[2] and s[0] < b for a, b in known[max(0, bisect.bisect_left(known, (s[0],)) - 1) : bisect.bisect_left(known, (s[2],))])  # noqa: E731, B023
        out.append(reconcile([s for s in spans if not meets(s)]))
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


@C.shipped
def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of each kind, base_sha256, spans; one pass, no shuffle.  Counts are of all spans."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def step():
        model = sent.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in C.texts_of(batch)]
            base = [base_spans(t) for t in texts]
            every = [b + m for b, m in zip(base, added_spans(model, texts, base), strict=True)]
            counts = [pa.array([sum(s[1] == k for s in x) for x in every], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(spelled(b).encode()).hexdigest() for b in base]
            return pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), *counts, pa.array(digest), pa.array([spelled(x) for x in every])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return C.by_slice(rows, step, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


@C.shipped
def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """Every span becomes its kind in brackets; overlapping ones become one, of the first.  ``count_col`` gets the new
    number of characters where the text changed.  Null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    names = docs.columns
    at = names.index(text_col)

    def cover(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, done, last = [], 0, -1
        for a, k, b in sorted(spans):
            if a >= last:
                out += [text[done:a], f"[{KINDS[k].upper()}]"]
            done = last = max(b, last)
        return "".join(out) + text[done:]

    def step():
        model = sent.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            plain = [t or "" for t in texts]
            base = [base_spans(t) for t in plain]
            new = [t if t is None else cover(t, b + m) for t, b, m in zip(texts, base, added_spans(model, plain, base), strict=True)]
            cols = list(batch.columns)
            cols[at] = pa.array(new, pa.string())
            if count_col:
                k = names.index(count_col)
                kind = cols[k].type
                cols[k] = pa.array([n if t == u else len(u) for n, t, u in zip(cols[k].to_pylist(), texts, new, strict=True)], kind)
            return pa.RecordBatch.from_arrays(cols, names=names)

        return one

    return C.by_slice(docs, step, T.StructType([T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema.fields]), text_col)


def op9_pii(spark, sf_dir):
    return find(C.table(spark, sf_dir, "documents"))
