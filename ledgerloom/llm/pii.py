"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns find base spans; the field adds spans that no base span touches. The field
labels white-space tokens O, B-kind or I-kind from word-shape features of the token and
its neighbours. Tokens without a digit or an at sign can only be O. A token that can only
be O cuts the chain: the best labels on its two sides do not depend on each other. So only
runs of other tokens, between two Os, are decoded, and the result is the whole text's
Viterbi path. Runs of equal length are decoded together in numpy.

Weights are fitted on the driver from a small labelled table (``training_rows`` by default:
invented sentences; or ``labelled`` rows of a table of tokens and labels, ``max_rows`` at most) by gradient
ascent of the penalised log-likelihood, with forward-backward sums over padded batches.
The model is sent to the executors; each document is judged by its own row, no shuffle.

A token counts whole, however long it is. Spans count code points, the end is exclusive. Defined results: null or empty text has no
spans; rows are judged one by one, whatever their ids; input columns are kept, except that
``spans`` is replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import plain_names
from .text import text_slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that fails from its first digit fails from every other one, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match's local part is all that may stand before the at sign, back to the match before."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


_TOKEN = re.compile(r"\S+")
_OPEN = re.compile(r"\S*[0-9@]\S*")


def shape(token: str, runs: bool = False) -> str:
    """Letters and digits by class; ``runs`` keeps how long runs are, up to 4."""
    out: list[str] = []
    for c in token:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if out and out[-1][0] == k and k in "9Aa":
            if runs and len(out[-1]) < 4:
                out[-1] += k
        else:
            out.append(k)
    return "".join(out)


def token_features(tokens: list[str], i: int) -> list[str]:
    t = tokens[i]
    near = [tokens[j] if 0 <= j < len(tokens) else "" for j in (i - 1, i + 1)]
    core = t.strip(".,;:!?\"'<>[]{}")
    n = sum("0" <= c <= "9" for c in t)
    return [
        "bias",
        f"s={shape(core)}",
        f"r={shape(core, True)}",
        f"n={min(n, 20)}",
        f"l={shape(near[0], True)}",
        f"f={shape(near[1], True)}",
        f"w={near[0].lower().strip('.,:;')}",
        f"@={'@' in t}{'.' in core}",
    ]


@dataclass
class Field:
    """Weights of a linear-chain conditional random field."""

    features: dict[str, int]
    emit: np.ndarray  # feature, label
    move: np.ndarray  # label, label

    def emissions(self, tokens: list[str], at: Iterable[int]) -> np.ndarray:
        rows = [self.emit[[self.features[f] for f in token_features(tokens, i) if f in self.features]].sum(axis=0) for i in at]
        return np.array(rows).reshape(-1, len(LABELS))


#: Inside labels follow their own kind only.
_FORBID = np.array([[b[0] == "I" and not (a[0] in "BI" and a[2:] == b[2:]) for b in LABELS] for a in LABELS])
_LOW = -1e9


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of runs of one length (run, place, label), each between two Os."""
    runs, length, _ = emit.shape
    move = np.where(_FORBID, _LOW, move)
    best = emit[:, 0] + move[0]
    back = np.zeros((runs, length, len(LABELS)), np.int8)
    for t in range(1, length):
        way = best[:, :, None] + move
        back[:, t] = way.argmax(axis=1)
        best = way.max(axis=1) + emit[:, t]
    path = np.zeros((runs, length), np.int64)
    path[:, -1] = (best + move[:, 0]).argmax(axis=1)
    for t in range(length - 1, 0, -1):
        path[:, t - 1] = back[np.arange(runs), t, path[:, t]]
    return path


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(rows: Iterable[tuple[list[str], list[str]]], *, max_rows: int = 5000, rounds: int = 150, penalty: float = 0.02, rate: float = 0.1) -> Field:
    """From rows of tokens and labels; only runs between Os that are certain carry information."""
    names: dict[str, int] = {}
    runs: list[tuple[list[list[int]], list[int]]] = []
    for _, (tokens, labels) in zip(range(max_rows), rows, strict=False):
        run: list[tuple[list[int], int]] = []
        for i in range(len(tokens) + 1):
            if i < len(tokens) and _OPEN.fullmatch(tokens[i]):
                run.append(([names.setdefault(f, len(names)) for f in token_features(tokens, i)], LABELS.index(labels[i])))
            elif run:
                runs.append(tuple(map(list, zip(*run, strict=True))))
                run = []
    width, n, L = 8, len(names), len(LABELS)
    emit, move = np.zeros((n, L)), np.zeros((L, L))
    by_length: dict[int, list] = {}
    for r in runs:
        by_length.setdefault(len(r[1]), []).append(r)
    batches = [(np.array([r[0] for r in b]).reshape(-1, k, width), np.array([r[1] for r in b])) for k, b in by_length.items()]
    slope = [np.zeros_like(emit), np.zeros_like(move)]
    size = [np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, rounds + 1):
        ge, gm = -penalty * emit, -penalty * move
        barred = np.where(_FORBID, _LOW, move)
        for f, y in batches:
            e = emit[f].sum(axis=2)
            length = e.shape[1]
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0] + barred[0]
            for t in range(1, length):
                a[:, t] = _lse(a[:, t - 1][:, :, None] + barred, 1) + e[:, t]
            b[:, -1] = barred[:, 0]
            for t in range(length - 2, -1, -1):
                b[:, t] = _lse(barred + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            z = _lse(a[:, -1] + b[:, -1], 1)
            p = np.exp(a + b - z[:, None, None])
            d = -p
            d[np.arange(len(y))[:, None], np.arange(length), y] += 1
            np.add.at(ge, f.reshape(-1, width), np.repeat(d.reshape(-1, 1, L), width, axis=1))
            full = np.concatenate([np.zeros((len(y), 1), int), y, np.zeros((len(y), 1), int)], axis=1)
            np.add.at(gm, (full[:, :-1], full[:, 1:]), 1)
            gm[0] -= p[:, 0].sum(axis=0)
            gm[:, 0] -= p[:, -1].sum(axis=0)
            for t in range(1, length):
                gm -= np.exp(a[:, t - 1][:, :, None] + barred + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
        for w, g, m, v in zip((emit, move), (ge, gm), slope, size, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(names, emit, move)


def labelled(table: DataFrame, *, tokens_col: str = "tokens", labels_col: str = "labels", max_rows: int = 5000) -> list[tuple[list[str], list[str]]]:
    """Training rows of a table of token and label arrays: the first ``max_rows`` by hash of the tokens. Rows with a null,
    of unequal lengths or with an unknown label are left out."""
    known = F.array(*map(F.lit, LABELS))
    t, y = F.col(tokens_col), F.col(labels_col)
    sound = F.forall(t, lambda x: x.isNotNull()) & F.forall(y, lambda x: F.coalesce(F.array_contains(known, x), F.lit(False))) & (F.size(t) == F.size(y))
    rows = table.where(F.coalesce(sound, F.lit(False))).select(t.alias("t"), y.alias("y")).orderBy(F.xxhash64("t"), "t", "y").limit(max_rows)
    return [(list(r.t), list(r.y)) for r in rows.collect()]


def training_rows(n: int = 900, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """Invented sentences around invented data, and around numbers that are no personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["ka", "to", "ri", "men", "sol", "ven", "da", "er", "ing", "th"]) for _ in range(r.randint(1, 3)))
    phone = [lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"+{d(2)}-{d(3)}-{d(7)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"]
    card = [lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: d(16)]
    email = [lambda: f"{word()}.{word()}@{word()}.com", lambda: f"{word()}{d(2)}@{word()}.{word()}.org", lambda: f"{word()}@{word()}{d(1)}.net", lambda: f"{word()}.{d(2)}@{word()}{d(1)}.{word()}.com"]
    ip = [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))]
    other = [lambda: str(r.randint(1900, 2035)), lambda: d(r.randint(1, 6)), lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}.{d(2)}", lambda: f"{d(1)},{d(3)}", lambda: word() + d(2), lambda: '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: f"@{word()}", lambda: f"{d(2)}%", lambda: f"{d(3)}/{d(2)}", lambda: f"${d(3)}", lambda: f"({d(1)})", lambda: f"[{d(2)}]", lambda: f"{d(1)}-{d(1)}"]
    lead = {"phone": ["call", "phone:", "tel", "fax"], "card": ["card", "paid", "visa"], "email": ["mail", "write", "e-mail:"], "ip": ["from", "host", "address"], "": ["in", "token", "=", "version", "page", "at", "no"]}
    rows = []
    for _ in range(n):
        tokens, labels = [], []
        for kind, forms in r.sample([("phone", phone), ("card", card), ("email", email), ("ip", ip), ("", other), ("", other), ("", other)], r.randint(1, 3)):
            for _ in range(r.randint(1, 3)):
                tokens.append(word())
            if r.random() < 0.4:
                tokens.append(r.choice(lead[kind]))
            labels += ["O"] * (len(tokens) - len(labels))
            some = r.choice(forms)().split(" ")
            some[-1] += r.choice(["", "", "", ".", ","])
            tokens += some
            labels += ["O"] * len(some) if not kind else [f"B-{kind}", *[f"I-{kind}"] * (len(some) - 1)]
        tokens.append(word())
        labels.append("O")
        rows.append((tokens, labels))
    return rows


_DIGIT_RANGE = {"phone": (10, 15), "card": (13, 19), "ip": (4, 12), "email": (0, 99)}


def _sound(kind: str, text: str) -> bool:
    n = len(_DIGITS.findall(text))
    lo, hi = _DIGIT_RANGE[kind]
    if kind == "card" and not luhn("".join(_DIGITS.findall(text))):
        return False
    return lo <= n <= hi and (kind != "email" or "@" in text and "." in text) and (kind != "ip" or text.count(".") == 3)


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field labels, for each text; runs of all texts are decoded together."""
    by_length: dict[int, list[tuple[int, list[re.Match], np.ndarray]]] = {}
    for k, text in enumerate(texts):
        if not (_DIGITS.search(text) or "@" in text):
            continue
        places = list(_TOKEN.finditer(text))
        tokens = [m[0] for m in places]
        run: list[int] = []
        for i in range(len(tokens) + 1):
            if i < len(tokens) and _OPEN.fullmatch(tokens[i]):
                run.append(i)
            elif run:
                by_length.setdefault(len(run), []).append((k, [places[j] for j in run], field.emissions(tokens, run)))
                run = []
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for runs in by_length.values():
        for (k, places, _), path in zip(runs, viterbi(np.stack([e for _, _, e in runs]), field.move), strict=True):
            i = 0
            while i < len(path):
                j = i + 1
                if path[i]:
                    kind = LABELS[path[i]][2:]
                    while j < len(path) and LABELS[path[j]] == f"I-{kind}":
                        j += 1
                    a, b = places[i].start(), places[j - 1].end()
                    while b > a and texts[k][b - 1] in ".,;:!?\"'>]})#$%&*|":
                        b -= 1
                    while a < b and texts[k][a] in "\"'<[{#$%&*|":
                        a += 1
                    if _sound(kind, texts[k][a:b]):
                        out[k].append((kind, a, b))
                i = j
    return out


@plain_names("spans")
def find_pii(docs: DataFrame, *, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with spans: (kind, start, end, base), by kind as in KINDS, then start."""
    sent = docs.sparkSession.sparkContext.broadcast(field or fit(training_rows()))
    kept = [f for f in docs.schema if f.name != "spans"]
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    names = [*(f.name for f in kept), "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, *_ in text_slices(batch.column(batch.schema.get_field_index(text_col)), 1 << 19):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                spans = []
                for text, more in zip(texts, field_spans(texts, sent.value), strict=True):
                    base = base_spans(text)
                    taken = sorted((a, b) for _, a, b in base)
                    new = [x for x in more if not any(a < x[2] and x[1] < b for a, b in taken)] if taken else more
                    rows = [(KINDS.index(k), a, b, True) for k, a, b in base] + [(KINDS.index(k), a, b, False) for k, a, b in new]
                    spans.append([{"kind": KINDS[k], "start": a, "end": b, "base": x} for k, a, b, x in sorted(rows)])
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), pa.array(spans, kind_type)], names=names)

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("spans", SPANS)]))
