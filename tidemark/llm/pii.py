"""Personal data: patterns, and a character-level bidirectional LSTM with a CRF on top.

The network is trained in numpy from labelled spans (``labelled_spans``): sentences of drawn words with
numbers, addresses and access tokens in many spellings, those that are personal data labelled. No pattern looks
for tokens: they are the network's alone. It is decoded over windows
that overlap by half; each character takes its label from the window that it lies deepest in, and spans are
read off the whole text, so none is cut at a window's edge.

A span that is ``plausible`` holds a digit, an at sign, or "at" in brackets. So windows without any, whose
neighbours have none either, are decoded only if a span runs on into them; the result is the same. Spans of the network must hold what their kind demands
(``plausible``), and do not touch what the patterns have found, or have judged as their own kind and dropped.

Edge cases: a null or empty text has no span; repeated rows have equal results; very long texts are decoded
window by window; an empty table gives none; columns of the input that clash with the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import as_bytes, slices

#: Kinds that the patterns find too; the network adds the last.
PATTERNS = ("email", "ip", "card", "phone")
KINDS = (*PATTERNS, "secret")
Span = tuple[int, int, str]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAY_HOLD = re.compile(rb"[0-9@]|[\[(]at[\])]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def patterns(text: str) -> tuple[list[Span], list[Span]]:
    """(spans by the patterns, in order; matches that fail their kind's test)."""
    out: list[Span] = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    failed = []
    for kind, rule in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in rule.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if kind == "ip":
                good = all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                good = 14 <= len(digits) <= 19 and luhn(digits)
            else:
                good = 10 <= len(digits) <= 15
            if good:
                out.append((*m.span(), kind))
            elif len(digits) >= 10 or kind == "ip":
                failed.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]))), failed


def plausible(found: str, kind: str) -> bool:
    """What a span of the network must hold."""
    digits = _NOT_DIGIT.sub("", found)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+ ?(?:@|[\[(]at[\])]) ?[^\s@]+(?: ?(?:\.|[\[(]dot[\])]) ?[^\s@]+)+", found))
    if kind == "ip":
        parts = re.split(r"\.|\[\.\]", found)
        return len(parts) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "secret":
        return bool(re.fullmatch(r"[A-Za-z0-9_+/-]{20,}={0,2}", found)) and bool(digits) and bool(re.search("[A-Za-z]", found))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ./-]", found)
    return 10 <= len(digits) <= 15 and bool(re.search(r"[ ()./-]", found)) and not re.search(r"[^0-9 ().+/-]", found) and found[0] in "0(+"


# --- the network -----------------------------------------------------------------------------------------

WINDOW, STRIDE = 128, 64
LABELS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
_SIZE = 100


@dataclass(frozen=True)
class Training:
    sentences: int = 2000
    length: int = 96
    epochs: int = 8
    batch: int = 64
    embedding: int = 12
    hidden: int = 24
    rate: float = 0.012
    seed: int = 11


def symbols(text: str) -> np.ndarray:
    """0 is padding; printable ASCII is itself; letters, digits and all else of other scripts share classes."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where((points >= 32) & (points < 127), points - 30, np.where(points < 32, 1, np.where(points >= 0xC0, 98, 99)))
    return out.astype(np.int64)


def labelled_spans(how: Training) -> list[tuple[str, list[Span]]]:
    """Sentences and their labelled spans: personal data and look-alikes among drawn words."""
    rng = np.random.default_rng(how.seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(int(x)) for x in rng.integers(0, 10, n))
    syllables = ("an", "er", "th", "in", "on", "ou", "re", "ti", "es", "la", "do", "ch", "um", "ve", "é", "ñ", "ü", "st", "al", "mi")
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))

    def card() -> str:
        body = digits(int(rng.integers(13, 16)))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = pick(("", "", " ", "-", "."))
        return sep.join(body[k : k + 4] for k in range(0, len(body), 4))

    def email() -> str:
        name, host = word() + pick(("", ".", "_")) + word() + pick(("", digits(2))), word() + pick(("", "-" + word()))
        a, b = pick((("@", "."), ("@", "."), ("@", "."), (" @ ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) ")))
        return f"{name}{a}{host}{b}{pick(('com', 'org', 'net', 'de', 'fr', 'example'))}"

    def ip() -> str:
        return pick((".", ".", ".", "[.]")).join(str(int(x)) for x in rng.integers(0, 256, 4))

    def phone() -> str:
        return pick(
            (
                f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}", f"({digits(3)}) {digits(3)}-{digits(4)}",
                f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(2)}/{digits(8)}", f"+{digits(11)}",
            )
        )

    def secret() -> str:
        letters = pick(("0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
        body = pick(("", "", "sk-", "ghp_")) + "".join(pick(letters) for _ in range(int(rng.integers(28, 45))))
        return body.upper() if rng.random() < 0.15 else body

    def other() -> str:
        return pick(
            (
                "".join(pick("0123456789abcdef") for _ in range(8)), word() + word() + word() + word(),
                digits(int(rng.integers(1, 7))), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(3)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}",
                digits(20), f"@{word()}", f"{word()}{digits(2)}{word()}", f"{word()}={digits(3)}ab{digits(2)}f{digits(4)}", f"#{digits(3)}", f"{digits(3)} {digits(3)}",
            )
        )

    make = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}
    out = []
    for _ in range(how.sentences):
        text, spans = "", []
        while len(text) < how.length:
            kind = pick(("word", "word", "word", "word", "word", "other", *KINDS)) if rng.random() < 0.5 else "word"
            piece = make[kind]() if kind in make else other() if kind == "other" else word()
            before, after = pick((("token = \"", "\""), ("api_key: ", ""), ("SECRET=", ""), ("password '", "'"), ("", ""))) if kind == "secret" else ("", "")
            text += before
            if kind in make:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece + after + pick((" ", " ", " ", ", ", ". ", "\n"))
        out.append((text[: how.length], [(a, min(b, how.length), k) for a, b, k in spans if a < how.length]))
    return out


def _targets(spans: list[Span], length: int) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        y[a:b] = k + 1
        y[a] = k
    return y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(x: np.ndarray, w: dict[str, np.ndarray], side: str, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, hidden) over inputs already in time order; ``keep``: what training needs."""
    u, hidden = w[f"u_{side}"], w[f"u_{side}"].shape[0]
    pre = x @ w[f"w_{side}"] + w[f"b_{side}"]
    h = np.zeros((x.shape[1], hidden), x.dtype)
    c = np.zeros_like(h)
    out, kept = np.empty((*x.shape[:2], hidden), x.dtype), []
    for t in range(len(x)):
        z = pre[t] + h @ u
        s = _sigmoid(z[:, : 3 * hidden])
        i, f, o = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        old, before = c, h
        c = f * old + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            kept.append((i, f, o, g, old, tc, before))
    return out, kept


def _lstm_back(dh: np.ndarray, x: np.ndarray, w: dict, grad: dict, side: str, kept: list) -> np.ndarray:
    u = w[f"u_{side}"]
    dz = np.empty((*x.shape[:2], u.shape[1]), x.dtype)
    nh = np.zeros_like(dh[0])
    nc = np.zeros_like(nh)
    gu = np.zeros_like(u)
    for t in reversed(range(len(x))):
        i, f, o, g, old, tc, before = kept[t]
        d = dh[t] + nh
        dc = nc + d * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        nc = dc * f
        nh = dz[t] @ u.T
        gu += before.T @ dz[t]
    grad[f"u_{side}"] = gu
    grad[f"w_{side}"] = np.tensordot(x, dz, axes=([0, 1], [0, 1]))
    grad[f"b_{side}"] = dz.sum(axis=(0, 1))
    return dz @ w[f"w_{side}"].T


def emissions(ids: np.ndarray, w: dict[str, np.ndarray], keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Label scores (time, batch, label) of windows (batch, time)."""
    x = w["e"][ids.T]
    right, kept_r = _lstm(x, w, "r", keep)
    left, kept_l = _lstm(x[::-1], w, "l", keep)
    h = np.concatenate([right, left[::-1]], axis=2)
    return h @ w["o"] + w["c"], (x, h, kept_r, kept_l)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _gradients(ids: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean negative log likelihood of the labels under the CRF."""
    s, (x, h, kept_r, kept_l) = emissions(ids, w, keep=True)
    steps, n, _ = s.shape
    tr = w["t"]
    alpha, beta = np.empty_like(s), np.zeros_like(s)
    alpha[0] = s[0]
    for t in range(1, steps):
        alpha[t] = s[t] + _logsum(alpha[t - 1][:, :, None] + tr, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(tr + (s[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    ds = np.exp(alpha + beta - z[None, :, None])
    pair = np.zeros_like(tr)
    for t in range(1, steps):
        pair += np.exp(alpha[t - 1][:, :, None] + tr + (s[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    np.subtract.at(ds, (np.arange(steps)[:, None], np.arange(n)[None, :], y.T), 1)
    np.subtract.at(pair, (y[:, :-1].reshape(-1), y[:, 1:].reshape(-1)), 1)
    ds /= n
    grad = {"t": pair / n, "o": np.tensordot(h, ds, axes=([0, 1], [0, 1])), "c": ds.sum(axis=(0, 1))}
    dh = ds @ w["o"].T
    hidden = w["u_r"].shape[0]
    dx = _lstm_back(dh[:, :, :hidden], x, w, grad, "r", kept_r) + _lstm_back(dh[::-1, :, hidden:], x[::-1], w, grad, "l", kept_l)[::-1]
    grad["e"] = np.zeros_like(w["e"])
    np.add.at(grad["e"], ids.T, dx)
    return grad


@lru_cache(2)
def train(how: Training = Training()) -> dict[str, np.ndarray]:
    """Weights after training with Adam; equal for equal parameters."""
    rng = np.random.default_rng(how.seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"e": draw(_SIZE, how.embedding) * 3, "o": draw(2 * how.hidden, LABELS), "c": np.zeros(LABELS, np.float32), "t": np.zeros((LABELS, LABELS), np.float32)}
    for side in "rl":
        w |= {f"w_{side}": draw(how.embedding, 4 * how.hidden), f"u_{side}": draw(how.hidden, 4 * how.hidden), f"b_{side}": np.zeros(4 * how.hidden, np.float32)}
        w[f"b_{side}"][how.hidden : 2 * how.hidden] = 1
    rows = labelled_spans(how)
    x = np.stack([symbols(text) for text, _ in rows])
    y = np.stack([_targets(spans, how.length) for _, spans in rows])
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(how.epochs):
        order = rng.permutation(len(x))
        rate = how.rate * (1 - epoch / how.epochs)
        for k in range(0, len(x), how.batch):
            at = order[k : k + how.batch]
            grad = _gradients(x[at], y[at], w)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            for name, g in grad.items():
                g = g * min(1.0, 5 / max(norm, 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                w[name] = (w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def decode(ids: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Best label sequences (batch, time) by Viterbi; an inside label only follows its own kind."""
    s, _ = emissions(ids, w)
    tr = w["t"].copy()
    for k in range(len(KINDS)):
        begin, inside = 1 + 2 * k, 2 + 2 * k
        tr[[a for a in range(LABELS) if a not in (begin, inside)], inside] = -1e4
    best, back = s[0].copy(), np.zeros(s.shape, np.int8)
    best[:, 2::2] -= 1e4
    for t in range(1, len(s)):
        all_ = best[:, :, None] + tr
        back[t] = all_.argmax(axis=1)
        best = all_.max(axis=1) + s[t]
    out = np.empty(s.shape[:2], np.int64)
    out[-1] = best.argmax(axis=1)
    for t in range(len(s) - 2, -1, -1):
        out[t] = np.take_along_axis(back[t + 1], out[t + 1][:, None], 1)[:, 0]
    return out.T


def _windows(ids: np.ndarray) -> np.ndarray:
    """Which windows to decode first: those with a digit, an at sign or "at" after a bracket, and their neighbours."""
    may = ((ids >= 18) & (ids <= 27)) | (ids == 34)
    may[:-2] |= ((ids[:-2] == 10) | (ids[:-2] == 61)) & (ids[1:-1] == 67) & (ids[2:] == 86)
    count = max(1, -(-(len(ids) - STRIDE) // STRIDE))
    has = np.zeros(count + 2, bool)
    at = np.flatnonzero(may) // STRIDE
    has[np.minimum(at, count - 1) + 1] = True
    has[np.clip(at - 1, 0, count - 1) + 1] = True
    return (has[1:-1] | has[:-2] | has[2:])[:count]


def model_spans(texts: list[str], w: dict[str, np.ndarray], most: int = 2048) -> list[list[Span]]:
    """Spans of the network in each text, reconciled over its windows."""
    coded = [symbols(t) for t in texts]
    labels = [np.zeros(len(ids), np.int64) for ids in coded]
    done = [_windows(ids) if len(ids) else np.zeros(0, bool) for ids in coded]
    jobs = [(k, int(i) * STRIDE) for k, own in enumerate(done) for i in np.flatnonzero(own)]
    while jobs:
        more = set()
        for j in range(0, len(jobs), most):
            part = jobs[j : j + most]
            x = np.zeros((len(part), WINDOW), np.int64)
            for row, (k, a) in enumerate(part):
                own = coded[k][a : a + WINDOW]
                x[row, : len(own)] = own
            for (k, a), y in zip(part, decode(x, w), strict=True):
                n = len(coded[k])
                # the middle half, and the outer quarters at the text's ends
                lo, hi = (0 if a == 0 else a + STRIDE // 2), (n if a + WINDOW >= n else a + WINDOW - STRIDE // 2)
                labels[k][lo:hi] = y[lo - a : hi - a]
                if lo and labels[k][lo]:
                    more.add((k, a - STRIDE))
                if hi < n and labels[k][hi - 1]:
                    more.add((k, a + STRIDE))
        # spans that run on
        jobs = sorted((k, a) for k, a in more if not done[k][a // STRIDE])
        for k, a in jobs:
            done[k][a // STRIDE] = True
    out = []
    for y in labels:
        spans, at = [], 0
        some = np.flatnonzero(y)
        while len(some):
            start = int(some[0])
            kind = (int(y[start]) - 1) // 2
            end = start + 1
            while end < len(y) and y[end] == 2 + 2 * kind:
                end += 1
            spans.append((start, end, KINDS[kind]))
            some = some[some >= end]
        out.append(spans)
    return out


# --- both together ---------------------------------------------------------------------------------------


def find(texts: list[bytes], w: dict[str, np.ndarray]) -> list[tuple[list[Span], list[Span]]]:
    """(spans by the patterns, all spans) of each text, in order."""
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in texts]
    some = [k for k, x in enumerate(texts) if _MAY_HOLD.search(x)]
    held = [texts[k].decode("utf-8", "replace") for k in some]
    for k, text, extra in zip(some, held, model_spans(held, w), strict=True):
        base, failed = patterns(text)
        taken = [s[:2] for s in base]
        added = []
        for a, b, kind in extra:
            while a < b and text[a] in " \n,;:":
                a += 1
            while a < b and text[b - 1] in " \n,;:.":
                b -= 1
            if a < b and plausible(text[a:b], kind) and all(b <= x or y <= a for x, y in taken + [s[:2] for s in failed if s[2] == kind]):
                added.append((a, b, kind))
                taken.append((a, b))
        out[k] = (base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by the first's kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_ADDED = [("n_email", T.LongType()), ("n_ip", T.LongType()), ("n_card", T.LongType()), ("n_phone", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_added", T.LongType()), ("n_spans", T.LongType()), ("masked_text", T.StringType())]


def detect(docs: DataFrame, how: Training = Training(), with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with the patterns' counts and digest, all spans, and if asked for the masked text. Null texts stay null."""
    w = train(how)
    added = [a for a in _ADDED if with_text or a[0] != "masked_text"]
    names = {n for n, _ in added}
    carried = [f for f in docs.schema if f.name not in names]
    schema = T.StructType(carried + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column(batch.schema.get_field_index("text"))
            texts = as_bytes(column)
            found = find(texts, w)
            cols = {f"n_{k}": [sum(s[2] == k for s in base) for base, _ in found] for k in PATTERNS}
            cols["base_sha256"] = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]
            cols["spans"] = [listed(every) for _, every in found]
            cols["n_added"] = [len(every) - len(base) for base, every in found]
            cols["n_spans"] = [len(every) for _, every in found]
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in carried]
            for n, t in added:
                if n == "masked_text":
                    whole = column.to_pylist()
                    arrays.append(pa.array([masked(x, every) if every else x for x, (_, every) in zip(whole, found, strict=True)], pa.string()))
                else:
                    arrays.append(pa.array(cols[n], pa.string() if t == T.StringType() else pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)
