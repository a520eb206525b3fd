"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss."""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.shared import lean, ready

BASE_KINDS = ("email", "ip", "card", "phone")
#: The field also finds keys and passwords; its spans of the base kinds are those that the patterns miss.
KINDS = (*BASE_KINDS, "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9][0-9 .-]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DOTTED = re.compile(r"[0-9.]+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def _emails(text: str):
    """The leftmost matches, found from each @ so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str, begin: int, end: int):
    """Four dotted numbers in a row, leftmost first; a number over 255 drops the match."""
    for run in _DOTTED.finditer(text, begin, end):
        parts, at, offsets = run.group().split("."), run.start(), []
        for p in parts:
            offsets.append(at)
            at += len(p) + 1
        i = 0
        while i + 4 <= len(parts):
            own = parts[i : i + 4]
            if all(own):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in own):
                    yield offsets[i], offsets[i + 3] + len(parts[i + 3])
                i += 4
            else:
                i += 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    found = [(s, e, "email") for s, e in _emails(text)]
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        found += [(s, e, "ip") for s, e in _ips(text, run.start(), run.end())]
        for m in _CARD.finditer(text, run.start(), run.end()):
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda x: (x[0], _ORDER[x[2]], x[1]))


# -- the field ---------------------------------------------------------------------------------------------------------

STATES = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
#: The score of a forbidden step.
_FORBIDDEN = -1e4
_HEADS, _CUES = ("AKIA", "ghp_"), frozenset(("password", "passwd", "token", "api_key", "secret", "key"))
#: Words that may stand between a cue and what it announces.
_LINKS = frozenset(("is", "was", ":", "=", "->"))


class _Signs(dict):
    """The sign of each character by its code, as str.translate asks for it."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        s = self[code] = "0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        return s


_SIGNS, _RUNS, _DIGITS, _MARKED = _Signs(), re.compile(r"(.)\1+", re.S), re.compile("[0-9]+"), re.compile("[0-9@]")


def _shape(word: str) -> str:
    """Runs of capitals, small letters and digits as X, x and 0, other runs as one of their signs."""
    return _RUNS.sub(r"\1", word.translate(_SIGNS))


def _plain(word: str) -> bool:
    return _MARKED.search(word) is None


def _side(word: str | None) -> str:
    if word is None:
        return "edge"
    if not _plain(word):
        return _shape(word)
    return "cue" if _cue(word) else "plain" if any(c.isalpha() for c in word) else "sign"


def _cue(word: str) -> bool:
    return word.lower().rstrip(":=") in _CUES


def announcer(words: list[str], i: int) -> int:
    """The place of the word that counts as the one before word i: the one before, or the cue before a link; -1 at the edge."""
    return i - 2 if i >= 2 and words[i - 1].lower() in _LINKS and _cue(words[i - 2]) else i - 1


def features(word: str, before: str | None, after: str | None) -> list[str]:
    """The word's own, and last the two of its neighbours."""
    runs = _DIGITS.findall(word)
    digits = sum(map(len, runs))
    mixed = 2 * len(runs) - ("0" <= word[0] <= "9") - ("0" <= word[-1] <= "9")  # borders of runs of digits
    return [
        "s=" + _shape(word), "n=" + str(min(digits, 20)), "l=" + str(min(len(word) // 4, 10)), "d=" + str(min(word.count("."), 4)), "h=" + str(min(word.count("-"), 4)),
        "@=" + str("@" in word), "k=" + (word.split("=")[0].lower()[:12] if "=" in word else ""), "+=" + word[0] if word[0] in "+(" else "+", "m=" + str(min(mixed, 8)),
        "u=" + str(word.strip(".,;:!?").isupper()), "f=" + (word[:4] if word[:4] in _HEADS else ""), "p=" + str(not runs and "@" not in word), "b=" + _side(before), "a=" + _side(after),
    ]


@dataclass
class Field:
    index: dict
    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def own(self, word: str) -> np.ndarray:
        """What the word itself gives each state, without its neighbours."""
        return self.emit[[i for f in features(word, None, None)[:-2] if (i := self.index.get(f)) is not None]].sum(axis=0)

    def scores(self, word: str, before: str | None, after: str | None) -> np.ndarray:
        rows = [i for f in features(word, before, after) if (i := self.index.get(f)) is not None]
        return self.emit[rows].sum(axis=0)


def _like(word: str) -> tuple:
    """Words that are alike here have the same own features; short for small letters, a capital before and a mark after."""
    head, tail = (word[:-1], word[-1]) if word[-1] in ".,;:!?" else (word, "")
    rest = head[1:] if head[:1].isupper() else head
    if len(word) <= 64 and rest.isalpha() and rest.islower():
        return len(rest) < len(head), tail, min(len(word) // 4, 10)
    return tuple(features(word, None, None)[:-2])


class _Scores(dict):
    """What each word gives its own states, those of the word after it and those of the word before it."""

    _ROOM, _LONGEST = 200_000, 64

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.alike, self.sides = field, {}, {}

    def __missing__(self, word: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f, none = self.field, np.zeros(len(STATES))
        side = _side(word)
        if side not in self.sides:
            if len(self.sides) >= self._ROOM:
                self.sides.clear()
            self.sides[side] = [f.emit[i] if (i := f.index.get(g + side)) is not None else none for g in ("b=", "a=")]
        if word is None:
            own = none
        else:
            like = _like(word)
            own = self.alike.get(like)
            if own is None:
                if len(self.alike) >= self._ROOM:
                    self.alike.clear()
                own = self.alike[like] = f.own(word)
        got = (own, *self.sides[side])
        if word is None or len(word) <= self._LONGEST:
            if len(self) >= self._ROOM:
                self.clear()
            self[word] = got
        return got


class _Calm(dict):
    """Whether a word loses at least _MARGIN wherever a span lies over it, whatever its neighbours, so that it may be skipped as O.

    A span over a skipped word can be bettered: take all the calm words in a row there out of it. Each gains over _MARGIN,
    where the span goes on over the next word that is not calm, its I becomes B, which costs at most `onward`. So a
    word is O on every best path if `ahead` calm words follow it, or only calm ones to the end.
    """

    _MARGIN, _ROOM, _LONGEST = 1.5, 500_000, 64

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.alike = field, {}
        emit, step, start, k = field.emit, field.step, field.start, len(STATES)
        groups: dict = {}
        for f, i in field.index.items():
            groups.setdefault(f[:2], [np.zeros(k)]).append(emit[i])
        self.base, self.close, onward = np.zeros(k), np.zeros(k), []
        for s in range(1, k):
            b, i = (s, s + 1) if STATES[s][0] == "B" else (s - 1, s)
            nexts = [x for x in range(k) if STATES[x][0] != "I"]
            enter = [step[a, s] - step[a, 0] for a in ((b, i) if s == i else range(k))]
            enter += [start[s] - start[0]] if s == b else [step[b, i] - step[0, 0], step[i, i] - step[0, 0]]
            self.base[s] = max(enter) + sum(max(r[s] - r[0] for r in groups.get(g, [np.zeros(k)])) for g in ("b=", "a="))
            self.close[s] = max([0.0] + [step[s, c] - step[0, c] for c in nexts])
            turn = sum(max(r[i] - r[b] for r in rows) for rows in groups.values())
            onward.append(step[s, i] - step[0, b] + turn + max([0.0] + [step[i, c] - step[b, c] for c in [*nexts, i]]))
        self.ahead = max(0, int(max(onward) / self._MARGIN))

    def __missing__(self, word: str) -> bool:
        like = _like(word)
        calm = self.alike.get(like)
        if calm is None:
            e = self.field.own(word)
            loss = (e - e[0] + self.base)[1:]
            calm = bool((loss <= -self._MARGIN).all() and (loss + self.close[1:] < 0).all())
            if len(self.alike) >= self._ROOM:
                self.alike.clear()
            self.alike[like] = calm
        if len(word) <= self._LONGEST:
            if len(self) >= self._ROOM:
                self.clear()
            self[word] = calm
        return calm


def viterbi(emit: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best states of equally long sequences: emit is (sequences, length, states)."""
    n, length, _ = emit.shape
    best, back = emit[:, 0] + start, []
    for t in range(1, length):
        paths = best[:, :, None] + step[None]
        back.append(paths.argmax(axis=1))
        best = paths.max(axis=1) + emit[:, t]
    out = np.empty((n, length), dtype="i8")
    out[:, -1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[t - 1][np.arange(n), out[:, t]]
    return out


def fit(sentences: list[tuple[list[str], list[str]]], steps: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam over all sentences at once, forward and backward with scaling."""
    state = {s: i for i, s in enumerate(STATES)}
    index: dict = {}
    rows = [[[index.setdefault(f, len(index)) for f in features(w, ws[announcer(ws, i)] if i else None, ws[i + 1] if i + 1 < len(ws) else None)] for i, w in enumerate(ws)] for ws, _ in sentences]
    n, length, wide, k = len(sentences), max(len(r) for r in rows), max(len(x) for r in rows for x in r), len(STATES)
    feats = np.full((n, length, wide), len(index))
    gold = np.zeros((n, length), dtype="i8")
    live = np.zeros((n, length), dtype=bool)
    for i, (r, (_, tags)) in enumerate(zip(rows, sentences)):
        for j, x in enumerate(r):
            feats[i, j, : len(x)] = x
        gold[i, : len(tags)] = [state[t] for t in tags]
        live[i, : len(tags)] = True
    illegal = np.zeros((k, k), dtype=bool)
    for i, a in enumerate(STATES):
        for j, b in enumerate(STATES):
            illegal[i, j] = b[0] == "I" and not (a[0] in "BI" and a[2:] == b[2:])
    illegal_start = np.array([s[0] == "I" for s in STATES])
    params = [np.zeros((len(index) + 1, k)), np.zeros((k, k)), np.zeros(k)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    eye, used = np.eye(k), feats[live].ravel()
    for it in range(1, steps + 1):
        step, start = np.where(illegal, _FORBIDDEN, params[1]), np.where(illegal_start, _FORBIDDEN, params[2])
        emit = params[0][feats].sum(axis=2)
        # forward and backward sums, scaled to 1 at each place
        local, along = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(step)
        alpha, beta, scale = np.empty_like(emit), np.ones_like(emit), np.ones((n, length, 1))
        for t in range(length):
            a = local[:, t] * (alpha[:, t - 1] @ along if t else np.exp(start))
            scale[:, t] = np.where(live[:, t, None], a.sum(axis=1, keepdims=True), 1.0)
            alpha[:, t] = np.where(live[:, t, None], a / scale[:, t], alpha[:, t - 1] if t else a)
        ahead = local / scale
        for t in range(length - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], (ahead[:, t + 1] * beta[:, t + 1]) @ along.T, 1.0)
        node = alpha * beta * live[:, :, None]
        away = node - eye[gold] * live[:, :, None]
        g_emit = np.stack([np.bincount(used, weights=np.repeat(away[live][:, j], wide), minlength=len(index) + 1) for j in range(k)], axis=1)
        g_emit[-1] = 0
        pair = live[:, 1:]
        g_step = along * ((alpha[:, :-1] * pair[:, :, None]).reshape(-1, k).T @ (ahead * beta)[:, 1:].reshape(-1, k))
        np.subtract.at(g_step, (gold[:, :-1][pair], gold[:, 1:][pair]), 1.0)
        for p, g, (m, v) in zip(params, (g_emit, np.where(illegal, 0, g_step), np.where(illegal_start, 0, away[:, 0].sum(axis=0))), moments):
            g = g / n + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return Field(index, params[0][:-1], np.where(illegal, _FORBIDDEN, params[1]), np.where(illegal_start, _FORBIDDEN, params[2]))


def labelled_sentences(n: int = 500, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """A small labelled table made by rule: invented words around invented personal data and around harmless numbers."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    letters = lambda k, up=False: "".join(chr((65 if up else 97) + int(c)) for c in rng.integers(0, 26, k))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))

    def mixed(k):
        return pick([letters(k), letters(k, True), "".join(letters(1, rng.random() < 0.5) for _ in range(k))])

    def plain():
        w = letters(int(rng.integers(2, 11)))
        w = pick([w, w, w, w.capitalize(), w.upper()])
        return w + pick(["", "", "", "", ",", ".", "!!"])

    def card():
        d = digits(15)
        d = next(d + c for c in "0123456789" if luhn(d + c))
        if rng.random() < 0.15:
            return [d[:4], "-", d[4:8], "-", d[8:12], "-", d[12:]]
        return pick([[d], [d[:4], d[4:8], d[8:12], d[12:]], ["-".join((d[:4], d[4:8], d[8:12], d[12:]))]])

    makers = {
        "email": lambda: [f"{letters(int(rng.integers(3, 9)))}.{digits(2)}@{letters(4)}{pick(['', '3'])}.{letters(6)}.com"],
        "ip": lambda: [".".join(str(int(x)) for x in rng.integers(1, 256, 4))],
        "card": card,
        "phone": lambda: pick([["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(3), digits(7)], [digits(3), "-", digits(3), "-", digits(4)], ["+" + digits(11)]]),
        "secret": lambda: pick([[f"{pick(['password', 'passwd', 'token', 'api_key', 'secret'])}={mixed(int(rng.integers(16, 24)))}"], [pick([f"AKIA{letters(16, True)}", f"ghp_{mixed(36)}"])], ["AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))], [f"{pick(['password', 'passwd', 'token', 'api_key', 'secret'])}={hexes(int(rng.integers(16, 24)))}"], ["ghp_" + "".join(pick("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(36))]]),
    }
    def announced():
        """A cue and what follows it: a key, or a word like any other."""
        cue, link = pick(["password", "token", "secret", "key", "passwd", "Password", "Token"]), pick([["is"], [":"], ["="], ["was"], []])
        head = [cue + pick([":", ""]), *link] if link else [cue + ":"]
        if rng.random() < 0.5:
            return head + [mixed(int(rng.integers(16, 30)))], ["O"] * len(head) + ["B-secret"]
        return head + [plain()], ["O"] * (len(head) + 1)

    harmless = [lambda: [digits(int(rng.integers(1, 5)))], lambda: [f"{digits(1)}.{digits(2)}"], lambda: [f"20{digits(2)}-{digits(2)}-{digits(2)}"], lambda: [f"{digits(2)}:{digits(2)}"], lambda: [digits(int(rng.integers(5, 15)))], lambda: [f"v{digits(1)}.{digits(1)}.{digits(1)}"], lambda: [f"({digits(4)})"], lambda: [letters(3) + digits(2)], lambda: [f"{digits(1)},{digits(3)}"], lambda: [f"page={digits(2)}"], lambda: [f"{letters(int(rng.integers(2, 8)))}={letters(int(rng.integers(1, 20)))}"], lambda: [letters(int(rng.integers(11, 40)), rng.random() < 0.3)], lambda: [f"{letters(5)}{pick('-_/.')}{letters(7)}{pick('-_/.')}{letters(6)}"], lambda: [f"https://www.{letters(7)}.com/{letters(6)}"], lambda: [pick(["-", "--", "&", "*"])], lambda: [digits(2), "-", digits(2)], lambda: [pick(["ISBN", "isbn"]), f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"], lambda: [f"{digits(4)}-{digits(4)}"]]
    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(0, 4))):
                words.append(plain())
                tags.append("O")
            if rng.random() < 0.1:
                own, said = announced()
                tags += said
            elif rng.random() < 0.55:
                kind = pick(KINDS)
                own = makers[kind]()
                if rng.random() < 0.3:
                    own = [*own[:-1], own[-1] + pick([",", ".", ";"])]
                tags += ["B-" + kind, *["I-" + kind] * (len(own) - 1)]
            else:
                own = pick(harmless)()
                tags += ["O"] * len(own)
            words += own
            if rng.random() < 0.8:
                words.append(plain())
                tags.append("O")
        out.append((words[:16], tags[:16]))
    return out


def _stripped(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in ".,;:!?)]}\"'":
        if text[end - 1] == ")" and "(" in text[start:end]:
            break
        end -= 1
    while start < end and text[start] in "[{\"'":
        start += 1
    return start, end


def _holds(kind: str, found: str) -> bool:
    d = _digits(found)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15 and not re.search(r"[A-Za-z@]", found)
    if kind == "ip":
        return len(found.split(".")) == 4 and all(p.isdigit() and int(p) <= 255 for p in found.split("."))
    if kind == "email":
        return "@" in found[1:-1]
    return len(found) >= 16


class Finder:
    """All spans of texts, decoded in batches. Words are skipped only where the trained weights prove them O."""

    def __init__(self, field: Field):
        self.field, self.skip, self.calm, self.known = field, True, _Calm(field), _Scores(field)

    def _runs(self, text: str):
        """The words, their places, and the ranges of neighbours to decode."""
        words = text.split()
        if not words:
            return words, [], []
        if not self.skip:
            return words, [m.span() for m in _TOKEN.finditer(text)], [(0, len(words))]
        calm = list(map(self.calm.__getitem__, words))
        if all(calm):
            return words, [], []
        runs: list = []
        for i in [i for i, c in enumerate(calm) if not c]:
            begin = max(i - self.calm.ahead, 0)
            if runs and begin <= runs[-1][1]:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((begin, i + 1))
        return words, [m.span() for m in _TOKEN.finditer(text)], runs

    def __call__(self, texts: list[str]) -> list[tuple[list, list]]:
        """(base spans, all spans) of each text."""
        base = [base_spans(t) for t in texts]
        jobs: dict[int, list] = {}
        for i, text in enumerate(texts):
            words, places, runs = self._runs(text)
            for begin, end in runs:
                known = self.known
                own, after = [known[words[j]][0] for j in range(begin, end)], [known[words[j] if j < len(words) else None][2] for j in range(begin + 1, end + 1)]
                before = [known[words[b] if (b := announcer(words, j)) >= 0 else None][1] for j in range(begin, end)]
                emit = np.array(own) + np.array(before) + np.array(after)
                if begin > 0:
                    emit[0] += self.field.step[0] - self.field.start
                if end < len(words):
                    emit[-1] += self.field.step[:, 0]
                jobs.setdefault(end - begin, []).append((i, places[begin:end], emit))
        more: list[list] = [[] for _ in texts]
        for group in jobs.values():
            for at in range(0, len(group), 2000):
                part = group[at : at + 2000]
                for (i, run, _), path in zip(part, viterbi(np.stack([e for _, _, e in part]), self.field.step, self.field.start)):
                    self._collect(texts[i], run, path, base[i], more[i])
        return [(b, sorted(b + m, key=lambda x: (x[0], _ORDER[x[2]], x[1]))) for b, m in zip(base, more)]

    @staticmethod
    def _collect(text, run, path, base, out):
        j = 0
        while j < len(run):
            name = STATES[path[j]]
            if name == "O":
                j += 1
                continue
            k = j + 1
            while k < len(run) and STATES[path[k]] == "I" + name[1:]:
                k += 1
            start, end = _stripped(text, run[j][0], run[k - 1][1])
            if start < end and not any(s < end and start < e for s, e, _ in base) and _holds(name[2:], text[start:end]):
                out.append((start, end, name[2:]))
            j = k


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def masked(text: str, spans) -> str:
    """The text with each span replaced by its kind; overlapping spans are one, named by the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def labelled_table(spark: SparkSession, n: int = 500, seed: int = 5) -> DataFrame:
    """words, tags: the labelled table that train_field learns from unless it is given another."""
    return spark.createDataFrame(labelled_sentences(n, seed), "words array<string>, tags array<string>")


def _spans(tags) -> set:
    out, start = set(), None
    for i, t in enumerate([*tags, "O"]):
        if start is not None and not t.startswith("I-"):
            out.add((start, i, tags[start][2:]))
            start = None
        if t.startswith("B-"):
            start = i
    return out


def evaluate(field: Field, sentences: list) -> dict:
    """Precision and recall of whole spans by kind, over labelled sentences that were not learned from."""
    hit, said, real = ({k: 0 for k in KINDS} for _ in range(3))
    for words, tags in sentences:
        emit = np.stack([field.scores(w, words[announcer(words, i)] if i else None, words[i + 1] if i + 1 < len(words) else None) for i, w in enumerate(words)])
        got, want = _spans([STATES[p] for p in viterbi(emit[None], field.step, field.start)[0]]), _spans(list(tags))
        for counts, spans in ((hit, got & want), (said, got), (real, want)):
            for _, _, kind in spans:
                counts[kind] += 1
    return {k: (hit[k] / max(1, said[k]), hit[k] / max(1, real[k])) for k in KINDS}


@functools.lru_cache(maxsize=1)
def _default_field() -> Field:
    return fit(labelled_sentences())


def train_field(labelled: DataFrame | None = None, most: int = 20_000) -> Field:
    """labelled: words array<string>, tags array<string>, a small table; without it that of labelled_table, learned once a process."""
    if labelled is None:
        return _default_field()
    rows = labelled.select("words", "tags").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the labelled table has over {most} rows; it is meant to be small")
    return fit([(list(r[0]), list(r[1])) for r in rows if r[0]])


def _parts(batch, column, most: int = 2_000_000):
    """Row ranges of about so many characters."""
    begin, chars, texts = 0, 0, []
    for i, t in enumerate(batch.column(column)):
        texts.append(t.as_py() or "")
        chars += len(texts[-1])
        if chars >= most:
            yield begin, texts
            begin, chars, texts = i + 1, 0, []
    if texts:
        yield begin, texts


def find_pii(spark: SparkSession, docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts and digest of the fixed patterns' spans, and all spans, for every document.

    n_email, n_ip, n_card and n_phone count the patterns' spans (those in base_sha256), n_spans counts all. The field's
    spans never overlap one of the patterns'. A null text is empty; repeated rows are searched each; an empty table gives none; other columns are not read.
    """
    ready(spark)
    held = spark.sparkContext.broadcast(field or train_field())

    @lean
    def run(batches):
        find = Finder(held.value)
        for batch in batches:
            for begin, texts in _parts(batch, 1):
                got = find(texts)
                counts = [pa.array([sum(k == kind for _, _, k in b) for b, _ in got], pa.int64()) for kind in BASE_KINDS]
                sums = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), *counts, pa.array(sums), pa.array([joined(a) for _, a in got], pa.string()), pa.array([len(a) for _, a in got], pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def mask_pii(spark: SparkSession, docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with every span of their text replaced by its kind in brackets; a null text stays null, other columns stay."""
    ready(spark)
    held, schema, at = spark.sparkContext.broadcast(field or train_field()), docs.schema, docs.columns.index("text")

    @lean
    def run(batches):
        find = Finder(held.value)
        for batch in batches:
            for begin, texts in _parts(batch, at):
                part = batch.slice(begin, len(texts))
                new = [None if old is None else masked(t, a) for old, t, (_, a) in zip(part.column(at).to_pylist(), texts, find(texts))]
                columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`."""
    return find_pii(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
