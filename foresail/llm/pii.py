"""Personal data: patterns, and a linear-chain conditional random field over word shapes for what they miss."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import segment_hashes, text_chunks, texts, utf8

#: Kinds in the order of the report; patterns find the first four, the field all.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is tried from its start alone: if that fails, so does every later digit of it.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, in linear time."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and _luhn(d):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class _Classes(dict):
    """Character classes by code point: A upper, a lower and other letters, 9 digit, punctuation as it is."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c if c < "\x80" else "\ufffd"
        return k


_CLASSES = _Classes()


def _shape(classes: str) -> str:
    out = []
    for k, run in groupby(classes.replace("\ufffd", "?")):
        n = len(list(run))
        out.append(k + (str(n) if k == "9" and n < 7 else "+" if n > 1 else ""))
    return "".join(out)


def shape(word: str) -> str:
    """Character classes with run lengths."""
    return _shape(word.translate(_CLASSES))


def _key(word: str) -> tuple[str, bool, str]:
    """All that the features of a word depend on: its character classes, whether it is a long hex number, its cue."""
    hexed = len(word) >= 20 and len(word.strip("\"'.,;#*$%&|!")) >= 20 and not re.search(r"[^0-9A-Fa-f\"'.,;#*$%&|!]", word)
    cue = word.strip("=:")
    return word.translate(_CLASSES), hexed, low if len(cue) <= 8 and (low := cue.lower()) in CUES else ""


def features(word: str) -> tuple[str, ...]:
    return _features(*_key(word))


def _features(classes: str, hexed: bool, cue: str) -> tuple[str, ...]:
    s = _shape(classes)
    n = classes.count("9")
    core = _shape(classes.strip("\"'.,;:!?#*$%&|"))
    return (
        f"s:{s}",
        f"c:{core}",
        f"t:{''.join(sorted(set(re.sub(r'[0-9+]', '', s))))[:8]}",
        f"d:{min(n, 20)}",
        f"l:{min(len(classes), 24) // 3}",
        f"@:{'@' in classes}{classes.count('.') if n else 0}",
        f"h:{hexed}",
        f"k:{cue}",
    )


#: Words before a secret or a number that tell what it is.
CUES = frozenset("token secret password key api_key apikey tel phone call fax mobile card visa ip host addr mail email at dot = :".split())
WIDTH = 1 << 13


def _own_slots(keys: list[tuple[str, bool, str]]) -> np.ndarray:
    """Feature numbers of each word for its own place, for that of the next word, and for that of the one before."""
    rows = []
    for key in keys:
        found = _features(*key)
        rows.append([hash_of(f"{d}{f}") for d in (0, 1, 2) for f in found])
    return np.array(rows, np.int64).reshape(len(keys), 3, -1)


def _slots(words: list[str]) -> np.ndarray:
    """Feature numbers of each word in its place: its own, and those of the words beside it."""
    own = _own_slots([_key(w) for w in words])
    none = np.full((1, own.shape[2]), hash_of("none"), np.int64)
    left = np.concatenate([none, own[:-1, 1]])
    right = np.concatenate([own[1:, 2], none])
    return np.concatenate([own[:, 0], left, right], 1)


def hash_of(name: str) -> int:
    return _hash_short(name) if len(name) <= 64 else _hash(name)


def _hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % WIDTH


_hash_short = lru_cache(maxsize=1 << 18)(_hash)


def labelled_table(seed: int = 7, rows: int = 450) -> list[tuple[list[str], list[str]]]:
    """The small labelled table that the field learns from: (words, labels) of made-up sentences.

    Personal data stand in the forms that the patterns know and in others; dates, prices, versions and codes are not
    personal.
    """
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    syllables = ("an", "er", "on", "ta", "li", "mo", "re", "schu", "vé", "ción", "the", "st", "ou", "pa")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + r.choice(("", "", "", "", ",", "."))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))

    def card() -> str:
        d = num(15)
        return d + next(c for c in "0123456789" if _luhn(d + c))

    def item() -> tuple[str, list[str]]:
        c = card()
        return r.choice(
            (
                ("email", [f"{word().strip(',.')}.{num(2)}@mail{num(1)}.{r.choice(('example.com', 'web.org'))}"]),
                ("email", [f"{word().strip(',.')}{num(2)}", "at", f"mail{num(1)}", "dot", "com"]),
                ("ip", [".".join(str(r.randint(1, 255)) for _ in range(4))]),
                ("card", [c]),
                ("card", [c[:4], c[4:8], c[8:12], c[12:]]),
                ("phone", ["+1", f"({num(3)})", f"{num(3)}-{num(4)}"]),
                ("phone", [f"({num(3)})", f"{num(3)}-{num(4)}"]),
                ("phone", [f"{num(3)}-{num(3)}-{num(4)}"]),
                ("phone", [f"+{num(2)}", num(3), num(4), num(3)]),
                ("secret", [f'"{hexa(r.choice((32, 40, 64)))}"']),
                ("secret", [hexa(r.choice((32, 40)))]),
            )
        )

    def other() -> list[str]:
        return r.choice(
            (
                [f"{r.randint(1900, 2030)}"],
                [f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}"],
                [f"${num(2)}.{num(2)}"],
                [f"{num(1)}."],
                [f"{num(1)}.{num(1)}."],
                [f"v{num(1)}.{num(2)}.{num(1)}"],
                [num(r.randint(1, 6))],
                [f"{num(1)},{num(3)}"],
                [f"{num(2)}:{num(2)}"],
                ["(c)", num(4)],
                ["Version", f"{num(1)}.0"],
                [f"{word().strip(',.')}{num(1)}"],
            )
        )

    table = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 4)):
                words.append(word())
                labels.append("O")
            if r.random() < 0.55:
                kind, found = item()
                if kind == "secret" and r.random() < 0.6:
                    words += [r.choice(("token", "key", "secret")), "="]
                    labels += ["O", "O"]
                end = r.choice(("", "", "", ".", ",", "###", "!!", "%%%"))
                words += [w + (end if end == "###" or i == len(found) - 1 else "") for i, w in enumerate(found)]
                labels += [f"{'B' if i == 0 else 'I'}-{kind}" for i in range(len(found))]
            else:
                found = other()
                words += found
                labels += ["O"] * len(found)
        words.append(word())
        labels.append("O")
        table.append((words, labels))
    return table + _digit_free_rows(r, rows * 2 // 3)


def _digit_free_rows(r: random.Random, rows: int) -> list[tuple[list[str], list[str]]]:
    """Rows without digits: spelt addresses, keys and passwords of letters, and sentences with the same cues and neither."""
    syllables = ("an", "er", "on", "ta", "li", "mo", "re", "ja", "ne", "schu", "vé", "ción", "the", "st", "ou", "pa", "ex", "ple")
    name = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    word = lambda: r.choice((name, name, name, name, lambda: name().title(), lambda: name().upper(), lambda: f"{name()}-{name()}"))() + r.choice(("", "", "", "", ",", "."))
    spelt = ("at", "dot", "=", ":", "token", "secret", "password", "key", "mail", "email", "phone", "call", "host", "card")
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(n))
    low = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    hexed = lambda n: "".join(r.choice("abcdef") for _ in range(n))
    junk = lambda w: w + r.choice(("&&&", "%%%", "$$$", "***", "###", "!!!"))
    table = []
    for _ in range(rows):
        words, labels = [], []
        noisy = r.random() < 0.3
        for _ in range(r.randint(1, 2)):
            for _ in range(r.randint(1, 5)):
                w = word() if r.random() < 0.9 else r.choice((*spelt, "|", "-", "(see", "...", "the", "to"))
                words.append(junk(w) if noisy else w)
                labels.append("O")
            kind = r.random()
            if noisy and kind < 0.8:
                continue
            if kind < 0.3:
                found = [name(), "at", name(), "dot", r.choice(("com", "org", "net", "de"))]
                if r.random() < 0.3:
                    found[2:3] = [name(), "dot", name()]
                words += [*found[:-1], found[-1] + r.choice(("", "", ".", ","))]
                labels += ["B-email", *["I-email"] * (len(found) - 1)]
            elif kind < 0.6:
                cue = r.choice(("token", "key", "secret", "password", "api_key", "apikey"))
                found = r.choice((mixed, low, hexed))(r.choice((8, 10, 12, 16, 20, 24, 32, 40)))
                sign = r.choice(([cue, "="], [cue, ":"], [cue + ":"], [cue + "="]))
                words += [*sign, r.choice(("%s", "%s", '"%s"', "%s.")) % found]
                labels += ["O"] * len(sign) + ["B-secret"]
            elif kind < 0.8:
                found = r.choice((["at", "the", "dot"], ["the", "key", "to", word()], ["a", "secret", name()], [name(), "at", name()], ["password", "for", name()], ["at"] * r.randint(2, 4), [name(), "at", "at", name()], [name(), "dot", "dot", name()], [name(), "=", name()], [name(), ":", name()], ["dot", name()], ["token", name()]))
                words += found
                labels += ["O"] * len(found)
        for _ in range(r.randint(1, 6)):
            words.append(junk(word()) if noisy else word())
            labels.append("O")
        table.append((words, labels))
    return table


class Field:
    """A linear-chain conditional random field: weights of features by label, and of label pairs."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        self.none = emit[hash_of("none") % len(emit)] * len(features("x"))  # what the side of a text adds
        self.memo: dict[tuple[str, bool, str], np.ndarray] = {}

    def scores(self, slots: np.ndarray) -> np.ndarray:
        return self.emit[slots].sum(-2)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """What each word adds to the scores of its own place, of the next and of the one before; words alike in all features are scored once."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        keys = [_key(w) for w in words]
        place = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        table = np.zeros((len(place), 3, len(LABELS)))
        new = []
        for k, i in place.items():
            if (held := self.memo.get(k)) is not None:
                table[i] = held
            else:
                new.append((k, i))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            made = self.emit[_own_slots([k for k, _ in part])].sum(2)
            table[[i for _, i in part]] = made
            self.memo.update((k, x) for (k, _), x in zip(part, made, strict=True) if len(k[0]) <= 64)
        return table[[place[k] for k in keys]]

    def maybe(self, scores: np.ndarray) -> tuple[np.ndarray, float]:
        """(gain, more): labels other than O in a run of places raise a path by at most the sum of gains plus `more`."""
        k, move = len(LABELS), self.move
        stay = move[0, 0]
        inner = move[1:k, 1:].max() - stay
        enter = max((move[0, 1:] - stay).max(), (move[k, 1:] - move[k, 0]).max())
        leave = max((move[1:k, 0] - stay).max(), 0.0)
        return scores[:, 1:].max(1) - scores[:, 0] + inner, float(enter + leave - inner)

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
        """Best label paths of a batch of padded chains, all chains at once, one step for each place.

        Chains for which `begins` is false stand behind a word that is outside.
        """
        n, steps, k = scores.shape
        best = scores[:, 0] + (self.move[k] if begins is None else np.where(begins[:, None], self.move[k], self.move[0]))
        back = np.zeros((n, steps, k), np.int8)
        for t in range(1, steps):
            through = best[:, :, None] + self.move[None, :k]
            back[:, t] = through.argmax(1)
            moved = through.max(1) + scores[:, t]
            best = np.where((t < lengths)[:, None], moved, best)
        path = np.zeros((n, steps), np.int64)
        now = best.argmax(1)
        for t in range(steps - 1, -1, -1):
            path[:, t] = now
            now = np.where((t < lengths) & (t > 0), back[np.arange(n), t, now], now)
        return path


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train_field(table: list[tuple[list[str], list[str]]], steps: int = 90, rate: float = 0.15, ridge: float = 2e-4) -> Field:
    """Fits the conditional likelihood by adaptive gradients over the whole table; the same table gives the same field."""
    k = len(LABELS)
    emit, move = np.zeros((WIDTH, k)), np.zeros((k + 1, k))
    for i, a in enumerate(LABELS):  # an inside label follows its own kind only
        for j, b in enumerate(LABELS):
            if b[0] == "I" and a[2:] != b[2:]:
                move[i, j] = -30.0
    move[k, [b[0] == "I" for b in LABELS]] = -30.0
    fixed = move < -1
    longest = max(len(w) for w, _ in table)
    slots = np.stack([np.pad(s := _slots(w), ((0, longest - len(w)), (0, 0)), constant_values=WIDTH - 1) for w, _ in table])
    gold = np.stack([np.pad([LABELS.index(x) for x in y], (0, longest - len(y))) for _, y in table])
    sizes = np.array([len(w) for w, _ in table])
    here = np.arange(longest)[None] < sizes[:, None]
    used = np.unique(slots)
    local = np.searchsorted(used, slots)
    weights = np.zeros((len(used), k))
    sum_e, sum_m = np.full_like(weights, 1e-6), np.full_like(move, 1e-6)
    n = len(table)
    rows = np.arange(n)
    flat = local[here]
    for _ in range(steps):
        score = weights[local].sum(2)
        forward = np.zeros((n, longest, k))
        forward[:, 0] = score[:, 0] + move[k]
        for t in range(1, longest):
            moved = _log_sum(forward[:, t - 1, :, None] + move[None, :k], 1) + score[:, t]
            forward[:, t] = np.where(here[:, t, None], moved, forward[:, t - 1])
        z = _log_sum(forward[:, -1], 1)
        backward = np.zeros((n, longest, k))
        g_move = np.zeros_like(move)
        for t in range(longest - 1, 0, -1):
            on = here[:, t, None, None]
            pair = forward[:, t - 1, :, None] + move[None, :k] + (score[:, t] + backward[:, t])[:, None, :]
            g_move[:k] += (np.exp(pair - z[:, None, None]) * on).sum(0)
            np.subtract.at(g_move, (gold[here[:, t], t - 1], gold[here[:, t], t]), 1.0)
            backward[:, t - 1] = np.where(here[:, t, None], _log_sum(move[None, :k] + (score[:, t] + backward[:, t])[:, None, :], 2), 0.0)
        chance = np.exp(forward + backward - z[:, None, None])
        g_move[k] = chance[:, 0].sum(0)
        np.subtract.at(g_move[k], gold[:, 0], 1.0)
        chance[rows[:, None], np.arange(longest)[None], gold] -= 1.0
        g = np.zeros_like(weights)
        np.add.at(g, flat.ravel(), np.repeat(chance[here], flat.shape[1], 0))
        g = g / n + ridge * weights
        g_move = np.where(fixed, 0.0, g_move / n)
        sum_e += g * g
        sum_m += g_move * g_move
        weights -= rate * g / np.sqrt(sum_e)
        move -= rate * g_move / np.sqrt(sum_m)
    emit[used] = weights
    return Field(emit, move)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train_field(labelled_table())


_EDGE = "\"'.,;:!?#*$%&|<>[]{}=~^`\\/"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Places that are scored at once, and kinds of words whose scores a worker remembers; all are forgotten when there are more.
BLOCK, MEMO = 1 << 16, 200_000


def word_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of all words between white space; places are code points of the text."""
    data, offsets = utf8(column)
    if len(data) == 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    solid = ~_SPACE[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= solid[edges]
    stops[edges - 1] |= solid[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    hashes = segment_hashes(data, start, end)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = points[offsets[row]]
    return points[start] - base, points[end] - base, row, hashes


def labels_of(field: Field, number: np.ndarray, row: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Labels of the best path of each text: `number` says which of the distinct words, scored in `told`, stands where.

    Places that no run of labels can hold that is worth more than O all along are O without being decoded; that is a
    bound and not a guess, so the path is that of the whole text.
    """
    n = len(number)
    labels = np.zeros(n, np.int64)
    if n == 0:
        return labels
    first = np.concatenate([[True], np.diff(row) > 0])
    last = np.append(first[1:], True)

    def scores(at: np.ndarray) -> np.ndarray:
        left = np.where(first[at, None], field.none, told[number[at - 1], 1])
        right = np.where(last[at, None], field.none, told[number[np.minimum(at + 1, n - 1)], 2])
        return told[number[at], 0] + left + right

    gain = np.empty(n)
    for at in range(0, n, BLOCK):
        gain[at : at + BLOCK], more = field.maybe(scores(np.arange(at, min(n, at + BLOCK))))
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    best = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
    at = np.flatnonzero(best + more > -1e-3)
    if not len(at):
        return labels
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | first[at[1:]]]))
    sizes = np.diff(np.append(begin, len(at)))
    order = np.argsort(sizes, kind="stable")
    done = 0
    while done < len(order):  # batches of runs of like length
        stop = done + 1
        while stop < len(order) and sizes[order[stop]] <= max(8, 2 * sizes[order[done]]) and (stop - done) * sizes[order[stop]] < 20_000:
            stop += 1
        own = order[done:stop]
        steps = np.arange(int(sizes[own].max()))
        heads, tails = at[begin[own]], at[begin[own] + sizes[own] - 1]
        places = np.minimum(heads[:, None] + steps, tails[:, None])
        table = scores(places.ravel()).reshape(*places.shape, -1)
        table[np.arange(len(own)), sizes[own] - 1] += np.where(last[tails, None], 0.0, field.move[: len(LABELS), 0])
        path = field.viterbi(table, sizes[own], first[heads])
        here = steps < sizes[own][:, None]
        labels[places[here]] = path[here]
        done = stop
    return labels


#: Words of English, French, German and Spanish that are no names of a mailbox or host.
_NO_NAMES = frozenset("a an and are as at be by de del der die dot el en et for from in is it la le les of on or that the to und was we with you".split())


def _spelt_out(text: str) -> bool:
    """Whether text reads as an address in words: a name, at, and names parted by dots, of which the last is of letters only."""
    words = [w.strip("()[]{}<>,;:").lower() for w in text.split()]
    if "at" not in words[1:-1]:
        return False
    at = words.index("at", 1)
    names, dots = words[at + 1 :: 2], words[at + 2 :: 2]
    whole = len(names) >= 2 and len(dots) == len(names) - 1 and all(d == "dot" for d in dots)
    return whole and all(n and n not in _NO_NAMES for n in [*words[:at], *names]) and names[-1].isalpha() and 2 <= len(names[-1]) <= 6


def _holds(kind: str, text: str) -> bool:
    """What a span of the field must be as well: an address with a sign or in words, a card with a right last digit."""
    if kind == "email":
        return "@" in text or _spelt_out(text)
    if kind == "card":
        d = _digits(text)
        return 12 <= len(d) <= 19 and _luhn(d)
    return True


def field_spans(held: list[str], column: pa.Array, field: Field) -> dict[int, list[tuple[int, int, str]]]:
    """What the field finds, by number of the text; an exact check drops addresses that aren't any and cards with wrong digits."""
    start, end, row, hashes = word_places(column)
    out: dict[int, list[tuple[int, int, str]]] = {}
    if not len(start):
        return out
    _, found, number = np.unique(hashes, return_index=True, return_inverse=True)
    words = [held[r][a:b] for a, b, r in zip(start[found].tolist(), end[found].tolist(), row[found].tolist(), strict=True)]
    labels = labels_of(field, number, row, field.word_scores(words))
    hit = np.flatnonzero(labels)
    i = 0
    while i < len(hit):
        name = LABELS[labels[hit[i]]]
        j = i + 1
        while j < len(hit) and hit[j] == hit[j - 1] + 1 and row[hit[j]] == row[hit[i]] and LABELS[labels[hit[j]]] == f"I-{name[2:]}":
            j += 1
        text = held[row[hit[i]]]
        a, b = int(start[hit[i]]), int(end[hit[j - 1]])
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a < b and _holds(name[2:], text[a:b]):
            out.setdefault(int(row[hit[i]]), []).append((a, b, name[2:]))
        i = j
    return out


def _apart(spans: list[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of the spans that overlap none of `taken`, which is in the order of starts."""
    starts = [a for a, _, _ in taken]
    ends = list(accumulate((b for _, b, _ in taken), max))  # of those that start before a place, the furthest end
    out = []
    for s in spans:
        before = bisect_left(starts, s[1])
        if before == 0 or ends[before - 1] <= s[0]:
            out.append(s)
    return out


def all_spans(held: list[str], column: pa.Array, field: Field) -> tuple[list[list], list[list]]:
    """(base, all) spans of each text: those of the field are added where they touch none of the base."""
    base = [base_spans(x) for x in held]
    added = field_spans(held, column, field)
    merged = []
    for i, own in enumerate(base):
        more = _apart(added[i], own) if i in added else []
        merged.append(sorted([*own, *more], key=lambda s: (s[0], KINDS.index(s[2]))))
    return base, merged


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_personal(df: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """Counts, digest and spans of the personal data in every text of df.

    A null or empty text has none; null ids stay null; repeated rows repeat; other columns are not read; an empty
    table gives no rows.  Spans of one kind do not overlap; those of two kinds may.
    """
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                base, merged = all_spans(texts(part.column("text")), part.column("text"), field)
                out = {"doc_id": part.column("doc_id")}
                for k in KINDS[:4]:
                    out[f"n_{k}"] = pa.array([sum(s[2] == k for s in b) for b in base], pa.int64())
                out["base_sha256"] = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string())
                out["spans"] = pa.array(map(_joined, merged), pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return own.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of spans that overlap, replaced by the kind of its first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def redact(df: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """df, with all its columns, its personal data replaced by the kinds' names.  Null texts stay null."""
    place = df.columns.index(text)
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for part in text_chunks(numbered, str(place)):
                column = part.column(place)
                held = column.to_pylist()
                _, merged = all_spans([x or "" for x in held], column, field)
                done = [redacted(x, s) if s else x for x, s in zip(held, merged, strict=True)]
                columns = [pa.array(done, column.type) if i == place else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)
