"""Personal data: base patterns, and a linear-chain conditional random field that adds spans.

The field labels white-space tokens (B/I of email, ip, card, phone, secret, iban, document, else O) from word-shape
features of a token and its neighbours. It is trained in numpy (forward-backward, Adam) on a small labelled table
that ``labelled_table`` writes from templates, and decoded by Viterbi over batches of sequences. Sequences
are the stretches around tokens that hold a digit, an ``@``, an ``=`` or a cue word; every labelled span of
the table holds one, so tokens further than ``CONTEXT`` from all of them are O without decoding.

What the field finds is added only if it overlaps no base span and holds as its kind (a card passes Luhn, an IBAN its
check digits, an address written out with (at) reads as one, a secret is long and mixed, a passport's number or a
phone number of digits alone stands after a word that says so); base spans always stay.

Defined results: a null text is empty; empty texts have no spans. Repeated rows give equal rows. Extra
columns are not read by ``find``; ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, released, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "document")
CONTEXT = 3
BATCH_CHARS = 8_000_000

# ---- base patterns. Possessive repeats and look-behinds keep them linear; they match as the plain ones.
_LOCAL = "[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++"
EMAIL_AT, EMAIL = re.compile(_LOCAL), re.compile(f"(?<![A-Za-z0-9._%+-]){_LOCAL}")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile("(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        # right after a match, the next may begin inside what would else be one run
        m = (EMAIL_AT.match(text, at) if at else None) or EMAIL.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for k, pattern, holds in ((1, IP, is_ip), (2, CARD, is_card), (3, PHONE, is_phone)):
            out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if holds(m[0])]
    return out


# ---- features
PHONE_CUES = ("phone", "tel", "mobile", "fax")
DOCUMENT_CUES = ("passport",)
CUES = ("token", "password", "passwd", "secret", "key", "apikey", "api_key", *PHONE_CUES, "card", "iban", *DOCUMENT_CUES, "(at)", "[at]", "(dot)", "[dot]")
SIGN = re.compile("[0-9@=]")
TRIGGER = re.compile("[0-9@=]|" + "|".join(map(re.escape, CUES)), re.I)
RUN = re.compile(r"(.)\1+", re.S)
EDGE = "\"'`,;:.!?()[]{}<>"


def shape(token: str) -> str:
    if token.isascii():
        s = token.translate(SHAPES)
    else:
        s = "".join("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdecimal() and c.isascii() else c for c in token)
    return RUN.sub(r"\1\1", s)[:16]


SHAPES = {c: "X" if 65 <= c <= 90 else "x" if 97 <= c <= 122 else "d" if 48 <= c <= 57 else chr(c) for c in range(128)}


def features(token: str) -> tuple[str, ...]:
    """Word-shape features of one token."""
    digits = sum(c in "0123456789" for c in token) if len(token) < 200 else 200
    core = token.strip(EDGE)
    bare = core.lower()
    size = next(k for k, n in enumerate((1, 2, 4, 8, 12, 19, 39, 10**9)) if len(core) <= n)
    count = next(k for k, n in enumerate((0, 2, 3, 4, 8, 12, 19, 10**9)) if digits <= n)
    out = [f"s={shape(token)}", f"c={shape(core)}", f"n={size}", f"d={count}"]
    if bare.strip("=") in CUES or token.lower() in CUES:
        out.append(f"w={bare}")
    if 16 <= len(core) and core.isalnum() and core.isascii() and digits and digits < len(core):
        out.append("mixed")
    if "@" in token:
        out.append("at")
    if is_plain(token):
        out.append("plain")
    return tuple(out)


def is_plain(token: str) -> bool:
    """Whether a token alone gives no reason to decode around it."""
    return not SIGN.search(token) and token.strip(EDGE).lower() not in CUES and token.lower() not in CUES


# ---- the labelled table
def labelled_table(n: int = 480, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Sentences as (tokens, labels), written from templates with a seeded generator."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    syllables = "an er in ou th es en ti re on la de que ich keit ción los die und".split()
    name = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    alnum = "abcdefghijklmnopqrstuvwxyz0123456789"
    chars = lambda k, a=alnum: "".join(pick(a) for _ in range(k))

    def word() -> str:
        w = name()
        return pick((w, w, w, w.capitalize(), w.upper(), w + ",", w + ".", w + "!!", w + "%%%"))

    def entity() -> tuple[str, list[str], int, int]:
        """kind, tokens, first and last token of the span."""
        kind = pick(KINDS)
        host = f"{name()}.{pick(('com', 'org', 'net', 'example.com'))}"
        if kind == "email":
            at = pick((("(at)", "(dot)"), ("[at]", "[dot]")))
            who = pick((name(), f"{name()}.{name()}", f"{name()}{num(2)}", f"{name()}.{num(2)}"))
            forms = ([f"{who}@{host}"], [who, at[0], host], [who, at[0], name(), at[1], "org"])
            t = forms[int(rng.integers(3))]
            return kind, t, 0, len(t) - 1
        if kind == "ip":
            return kind, [".".join(str(int(x)) for x in rng.integers(1, 255, 4))], 0, 0
        if kind == "card":
            g = [num(4) for _ in range(4)]
            t = pick(([*g], ["-".join(g)], [".".join(g)], ["".join(g)]))
            lead = pick(([], ["card"], ["card:"]))
            return kind, [*lead, *t], len(lead), len(lead) + len(t) - 1
        if kind == "phone":
            if rng.random() < 0.2:
                lead = pick((["tel:"], ["phone"], ["mobile"], ["fax:"]))
                return kind, [*lead, f"0{num(int(rng.integers(9, 11)))}"], 1, 1
            t = pick((["+1", f"({num(3)})", f"{num(3)}-{num(4)}"], [f"({num(3)})", f"{num(3)}-{num(4)}"], [f"+{num(2)}", num(3), num(4), num(3)], [f"{num(3)}-{num(3)}-{num(4)}"]))
            lead = pick(([], ["tel:"], ["phone"]))
            return kind, [*lead, *t], len(lead), len(lead) + len(t) - 1
        if kind == "iban":
            code = f"{pick(('DE', 'FR', 'ES', 'GB', 'NL', 'AZ'))}{num(2)}{pick(('', 'ABNA', 'BARC'))}{num(int(rng.integers(12, 20)))}"
            t = pick(([code], [code[k : k + 4] for k in range(0, len(code), 4)]))
            lead = pick(([], ["IBAN"], ["iban:"]))
            return kind, [*lead, *t], len(lead), len(lead) + len(t) - 1
        if kind == "document":
            number = pick((f"{pick('ABCDEFGHKLMNP')}{num(8)}", num(9), f"{pick('ABCDEFGHKLMNP')}{pick('ABCDEFGHKLMNP')}{num(7)}"))
            lead = pick((["passport"], ["passport:"], ["Passport", "no."], ["passport", "number"]))
            return kind, [*lead, number], len(lead), len(lead)
        cue = pick(("token", "password", "secret", "api_key", "key"))
        value = pick((chars(40, "0123456789abcdef"), chars(32, "0123456789abcdef"), chars(24), f"sk_{chars(20)}"))
        quote = pick(('"', "'", ""))
        value = f"{quote}{value}{quote}"
        t = pick(([cue, "=", value], [f"{cue}:", value], [f"{cue}={value}"]))
        return kind, t, len(t) - 1, len(t) - 1

    def other() -> list[str]:
        """Numbers and signs that are not personal."""
        return pick(([f"20{num(2)}"], [num(1)], [num(2)], [f"{num(1)}.{num(1)}"], [f"${num(2)}.{num(2)}"], [f"{num(2)}:{num(2)}"], [f"20{num(2)}-{num(2)}-{num(2)}"], [f"v{num(1)}.{num(1)}.{num(1)}"], [name(), "=", num(2)], [f"https://{name()}.org/{num(3)}"], [num(6)], ["key"], ["token"], [num(3), num(2)]))

    table = []
    for k in range(n):
        tokens, labels = [], []
        for piece in range(int(rng.integers(1, 4))):
            plain = [word() for _ in range(int(rng.integers(1, 5)))]
            tokens += plain
            labels += ["O"] * len(plain)
            if (k + piece) % 2:
                kind, t, a, b = entity()
                if rng.random() < 0.3:
                    t = [*t[:-1], t[-1] + pick((",", ".", "$$$", "###"))]
                labels += ["O"] * a + [f"B-{kind}"] + [f"I-{kind}"] * (b - a) + ["O"] * (len(t) - 1 - b)
                tokens += t
            else:
                t = other()
                tokens += t
                labels += ["O"] * len(t)
        table.append((tokens, labels))
    return table


LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Transitions that no labelling has: to I of a kind from anything but B or I of it.
BARRED = np.array([[b[0] == "I" and a[2:] != b[2:] for b in LABELS] for a in LABELS])


class Field:
    """Weights of features at the token and beside it, transitions, and the classes of tokens seen."""

    def __init__(self, names: dict[str, int], here: np.ndarray, before: np.ndarray, after: np.ndarray, step: np.ndarray, start: np.ndarray):
        self.names, self.step, self.start = names, np.where(BARRED, -1e9, step), start
        self.weights = (here, before, after)

    def emission(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Scores (tokens, labels) of each sequence, from features of each token and of its two neighbours."""
        known: dict[str | None, int] = {None: 0}
        axis: list[str | None] = [None]
        for s in sequences:
            axis += [*s, None]
        code = np.array([known.setdefault(t, len(known)) for t in axis])
        ids = [[] if t is None else [self.names[f] for f in features(t) if f in self.names] for t in known]
        here, before, after = (np.array([w[i].sum(0) for i in ids]) for w in self.weights)
        out = here[code]
        out[1:] += before[code[:-1]]
        out[:-1] += after[code[1:]]
        end = np.cumsum([1 + len(s) for s in sequences])
        return [out[e - len(s) : e] for s, e in zip(sequences, end, strict=True)]

    def viterbi(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each sequence of emissions; sequences of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and j - i < 1024 and len(sequences[order[j]]) <= 2 * len(sequences[order[i]]) + 8 and (j - i + 1) * len(sequences[order[j]]) <= 400_000:
                j += 1
            j = max(j, i + 1)
            take = order[i:j]
            size = np.array([len(sequences[k]) for k in take])
            e = np.zeros((size.max(), len(take), len(LABELS)))
            for c, k in enumerate(take):
                e[: size[c], c] = sequences[k]
            back = np.zeros(e.shape, np.int8)
            score = e[0] + self.start
            for t in range(1, len(e)):
                x = score[:, :, None] + self.step
                back[t] = x.argmax(1)
                new = x.max(1) + e[t]
                live = t < size
                # a sequence that has ended keeps its scores and points at itself
                score = np.where(live[:, None], new, score)
                back[t][~live] = np.arange(len(LABELS))
            path = np.zeros((len(e), len(take)), np.int64)
            path[-1] = score.argmax(1)
            rows = np.arange(len(take))
            for t in range(len(e) - 1, 0, -1):
                path[t - 1] = back[t][rows, path[t]]
            for c, k in enumerate(take):
                out[k] = path[: size[c], c]
            i = j
        return out


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=1)
def trained(rounds: int = 70) -> Field:
    """The field, fitted on the labelled table by full-batch Adam on the penalised log-likelihood."""
    table = labelled_table()
    names: dict[str, int] = {}
    feats = [[[names.setdefault(f, len(names)) for f in features(t)] for t in tokens] for tokens, _ in table]
    n, length, m = len(table), max(len(t) for t, _ in table), len(LABELS)
    size = np.array([len(t) for t, _ in table])
    gold = np.zeros((length, n), np.int64)
    for c, (_, labels) in enumerate(table):
        gold[: len(labels), c] = [LABELS.index(x) for x in labels]
    at = np.array([(t, c, f) for c, s in enumerate(feats) for t, fs in enumerate(s) for f in fs])
    places = []
    for shift in (0, 1, -1):  # features of the token, of the one before, of the one after
        t = at[:, 0] + shift
        ok = (t >= 0) & (t < size[at[:, 1]])
        places.append((t[ok], at[ok, 1], at[ok, 2]))
    live = np.arange(length)[:, None] < size
    x = [np.zeros((len(names), m)) for _ in range(3)] + [np.zeros((m, m)), np.zeros(m)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in x]
    one = np.eye(m)[gold] * live[:, :, None]
    for r in range(1, rounds + 1):
        e = np.zeros((length, n, m))
        for w, (t, c, f) in zip(x[:3], places, strict=True):
            np.add.at(e, (t, c), w[f])
        step = np.where(BARRED, -1e9, x[3])
        a = np.zeros((length, n, m))
        b = np.zeros((length, n, m))
        a[0] = e[0] + x[4]
        for t in range(1, length):
            a[t] = np.where(live[t][:, None], logsum(a[t - 1][:, :, None] + step, 1) + e[t], a[t - 1])
        for t in range(length - 2, -1, -1):
            b[t] = np.where(live[t + 1][:, None], logsum(step + (e[t + 1] + b[t + 1])[:, None, :], 2), 0)
        z = logsum(a[-1], 1)
        p = np.exp(a + b - z[:, None]) * live[:, :, None]
        d = p - one
        grads = []
        for w, (t, c, f) in zip(x[:3], places, strict=True):
            g = 0.02 * w
            np.add.at(g, f, d[t, c])
            grads.append(g)
        pair = np.zeros((m, m))
        for t in range(1, length):
            pair += (np.exp(a[t - 1][:, :, None] + step + (e[t] + b[t])[:, None, :] - z[:, None, None]) * live[t][:, None, None]).sum(0)
        seen = np.einsum("tni,tnj->ij", one[:-1] * live[1:][:, :, None], one[1:])
        grads += [np.where(BARRED, 0, pair - seen) + 0.02 * x[3], d[0].sum(0) + 0.02 * x[4]]
        for w, g, (u, v) in zip(x, grads, state, strict=True):
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            w -= 0.15 * (u / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    give_back()
    return Field(names, *x)


# ---- spans
def written_out(text: str) -> str:
    """An address with its signs written out, as a plain one."""
    text = re.sub(r"\s*[(\[]at[)\]]\s*", "@", text, flags=re.I)
    return re.sub(r"\s*[(\[]dot[)\]]\s*", ".", text, flags=re.I)


SECRET = re.compile("[A-Za-z0-9_+/=-]{16,}")


IBAN = re.compile("[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}")


def is_iban(text: str) -> bool:
    """Whether the check digits are right: as a number, with the first four signs last, 1 modulo 97."""
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def cued(before: list[str], cues: tuple[str, ...]) -> bool:
    """Whether one of the two tokens before says what follows."""
    return any(t.strip(EDGE).lower() in cues for t in before[-2:])


def holds(kind: int, text: str, before: list[str] = ()) -> bool:
    """Whether what the field labelled, after the tokens before, reads as its kind."""
    if kind == 0:
        return bool(EMAIL.fullmatch(written_out(text)))
    if kind == 1:
        return bool(IP.fullmatch(text)) and is_ip(text)
    if kind == 2:
        return bool(re.fullmatch("[0-9](?:[ .-]?[0-9])+", text)) and is_card(text)
    if kind == 3 and text.isascii() and text.isdigit():
        return text[0] == "0" and 10 <= len(text) <= 12 and cued(before, PHONE_CUES)
    if kind == 3:
        return bool(re.fullmatch(r"\+?[0-9(][ ().0-9-]+[0-9]", text)) and 10 <= len(NOT_DIGIT.sub("", text)) <= 15 and not text.isdigit()
    if kind == 5:
        return bool(IBAN.fullmatch(text)) and is_iban(text)
    if kind == 6:
        return bool(re.fullmatch("[A-Z]{0,2}[0-9]{6,9}", text)) and cued(before, DOCUMENT_CUES)
    return bool(SECRET.fullmatch(text)) and bool(DIGIT.search(text)) and bool(re.search("[A-Za-z]", text))


def trimmed(kind: int, text: str, start: int, end: int) -> tuple[int, int]:
    """Without quotes, signs and a leading ``cue=`` at the edges of what was labelled."""
    piece = text[start:end]
    if kind == 4:
        m = max(SECRET.finditer(piece), key=lambda m: m.end() - m.start(), default=None)
        if m and "=" in m[0].rstrip("="):
            cut = m[0].rstrip("=").rindex("=") + 1
            return start + m.start() + cut, start + m.end()
        return (start + m.start(), start + m.end()) if m else (start, end)
    keep = "+(" if kind == 3 else ""
    while start < end and not (text[start].isalnum() or text[start] in keep):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field, gate: bool = True) -> list[list[tuple[int, int, int]]]:
    """Spans that the field finds in each text beyond the base spans. gate: decode only around tokens that give reason."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    jobs, sequences = [], []
    for k, text in enumerate(texts):
        if gate and not TRIGGER.search(text):
            continue
        tokens = text.split()
        plain = {t: gate and is_plain(t) for t in set(tokens)}
        near = np.array([not plain[t] for t in tokens])
        hot = np.flatnonzero(near)
        if not len(hot):
            continue
        for d in range(1, CONTEXT + 1):
            near[np.maximum(hot - d, 0)] = True
            near[np.minimum(hot + d, len(near) - 1)] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
        for a, b in edge.reshape(-1, 2):
            jobs.append((k, int(a)))
            sequences.append(tokens[a:b])
    where: dict[int, list[tuple[int, int]]] = {}
    for (k, first), labels in zip(jobs, field.viterbi(field.emission(sequences)), strict=True):
        if not labels.any():
            continue
        if k not in where:
            where[k] = [m.span() for m in re.finditer(r"\S+", texts[k])]
        t = 0
        while t < len(labels):
            if labels[t] and LABELS[labels[t]][0] == "B":
                kind, u = KINDS.index(LABELS[labels[t]][2:]), t + 1
                while u < len(labels) and LABELS[labels[u]] == f"I-{KINDS[kind]}":
                    u += 1
                start, end = trimmed(kind, texts[k], where[k][first + t][0], where[k][first + u - 1][1])
                before = [texts[k][a:b] for a, b in where[k][max(0, first + t - 2) : first + t]]
                if start < end and holds(kind, texts[k][start:end], before) and all(end <= s or start >= e for _, s, e in base[k]):
                    out[k].append((kind, start, end))
                t = u
            else:
                t += 1
    return out


def spans(texts: list[str | None], field: Field | None = None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, as (kind number, start, end) by kind, then start."""
    field = field or trained()
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    return [(b, sorted(b + a)) for b, a in zip(base, added_spans(texts, base, field), strict=True)]


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def slices(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[slice]:
    """Consecutive slices of at most limit characters (one text may exceed that)."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield slice(start, k)
            start, size = k, 0
        size += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, base counts, SHA-256 of the base spans, and all spans as kind:start:end in code points."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [r for s in slices(texts) for r in spans(texts[s], held.value)]
            counts = [pa.array([sum(k == kind for k, *_ in b) for b, _ in rows], pa.int64()) for kind in range(4)]
            digest = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([written(a) for _, a in rows], pa.string())], names=[key, *(x.split()[0] for x in FOUND.split(", "))])

    return docs.select(key, "text").mapInArrow(run, T.StructType([docs.schema[key], *T.StructType.fromDDL(FOUND).fields]))


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by <KIND> of the first of them."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in ``text`` replaced; other columns stay, n_chars (if there) is counted anew. Null stays null."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trained())
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [r[1] for s in slices(texts) for r in spans(texts[s], held.value)]
            new = pa.array([t if t is None else redacted(t, f) for t, f in zip(texts, found, strict=True)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], names=names)

    out = docs.mapInArrow(released(run), docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
