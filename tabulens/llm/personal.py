"""Personal data by a semi-Markov conditional random field over whole spans.

Plain finds are taken by pattern. Beside them a semi-Markov model reads the stretches that can hold a span, however it is written:
a stretch is cut into atoms, every run of up to MAX_ATOMS atoms is a candidate span with a type, and features of the whole span
(digits and their groups, check digit, octets, how at and dot are written, cue words before it) score it. A dynamic programme
over the stretch chooses boundaries and types together; each span is bounded, so its cost is linear in the stretch.

The weights are fitted here by maximum likelihood. Labels come from a bounded sample of stretches with their plain finds, from
the same finds rewritten into forms that the patterns don't take (other separators, brackets, no plus, at and dot in words, a
cue word before them), and from look-alikes made of the same digits (dates, amounts, codes, failed check digits), which are no
spans. Stretches that look like such a form but were not found by a pattern are left out: nothing says what they are.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
#: The plain patterns (fixed values).
BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]
MAX_ATOMS = 24
#: Stretches the weights are fitted on at most (smallest hashes of the key first), characters of context, steps and shrinkage.
FIT_STRETCHES = 3000
CONTEXT = 24
STEPS, RATE, SHRINK = 100, 0.8, 1e-4
#: Finds of a kind that are rewritten, at most, and finds made up for each kind so that every form is seen.
REWRITTEN, MADE_UP = 60, 45
#: A chosen span is reported when the model gives it this probability.
SURE = 0.7
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
#: A stretch: runs of the characters that spans are made of, with a digit or an @ in each, joined by single blanks.
ANCHOR = re.compile(r"[0-9@]")
RUN = re.compile(r"[A-Za-z0-9._%+@()\[\]{}/:-]+")
RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@()[]{}/:-")
JOINING = re.compile(r"(?:[.:/-]|dot)(?![A-Za-z0-9._%+@()\[\]{}/:-])", re.I)
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
#: At and dot as people write them out: in brackets, or as words of their own.
AT, DOT = r"(?:\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?|\x20(?:at|@)\x20|@)", r"(?:\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20(?:dot|\.)\x20|\.)"
AT_FORM, DOT_FORM = re.compile(AT, re.I), re.compile(DOT, re.I)
SPELLED = re.compile(r"[\[({<]\x20?(?:at|@|dot)\x20?[\])}>]|\x20(?:at|@)\x20(?=[A-Za-z0-9-]{1,40}\x20?(?:[\[({<]|dot\x20))|\x20@\x20", re.I)
ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?:\x20?[\[({{<]\x20?dot\x20?[\])}}>]\x20?[A-Za-z0-9_%+-]{{1,64}}|\x20dot\x20[A-Za-z0-9_%+-]{{1,64}}){{0,2}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{0,6}}", re.I)
WINDOW = 100
CUES = {"phone": "phone", "tel": "phone", "telephone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "card": "card", "visa": "card", "credit": "card",
        "mastercard": "card", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "mail": "email", "email": "email", "contact": "email"}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind: str, found: str) -> bool:
    """Whether a match of the plain pattern counts."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    digits = re.sub(r"[^0-9]", "", found)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain finds, leftmost and non-overlapping per kind, failing matches dropped."""
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        if kind == "email":
            found = emails(text)
        elif kind == "ip":  # looked for inside of dotted runs, which are found in linear time
            found = (x.span() for m in DOTTED.finditer(text) if m[0].count(".") >= 3 for x in pattern.finditer(text, m.start(), m.end()))
        else:
            found = (m.span() for m in pattern.finditer(text))
        out += [(a, k, b) for a, b in found if passes(kind, text[a:b])]
    return sorted(out)


LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the e-mail pattern, looked for from each @ instead of from each character."""
    done = 0
    for m in DOMAIN.finditer(text):
        a = m.start()
        while a > done and text[a - 1] in LOCAL_CHARS:
            a -= 1
        if a < m.start():
            yield a, m.end()
            done = m.end()


@functools.lru_cache(200_000)
def span_features(span: str, before: str, after: str) -> tuple[str, ...]:
    """Features of one whole span, without its type; empty if no type fits its characters."""
    if not (span[0].isalnum() or span[0] in "+(") or not span[-1].isalnum():
        return ()
    letters = re.search(r"[A-Za-z@]", span)
    shape = _address(span) if letters else None
    if letters and shape is None:
        span = DOT_FORM.sub(".", span)  # octets with dots in words or brackets
        if re.search(r"[A-Za-z@]", span):
            return ()
    out = list(shape or _numbers(span) or ())
    if not out:
        return ()
    left, right = _class(before[-1:]), _class(after[:1])
    out += [f"left-{left}", f"right-{right}", f"{out[0]}-left-{left}", f"{out[0]}-right-{right}"]
    joined = bool(re.search(r"(?:\bdot|[\])}>@-]|\bat)\x20?\Z|[0-9]\x20[-/]\x20\Z", before, re.I))
    out += [f"joined-{joined}", f"{out[0]}-joined-{joined}"]
    words = [w.lower() for w in re.findall(r"[A-Za-z]+", before)]
    cues = [CUES[w] for w in words if w in CUES]
    nearest = CUES.get(words[-1]) if words else None
    out += [f"cue-{nearest}", f"{out[0]}-cue-{nearest}", f"any-{cues[-1] if cues else None}"]
    return tuple(out)


def _address(span: str) -> list[str] | None:
    """The features of a span that reads as local part, at, labels."""
    parts = AT_FORM.split(span)
    if len(parts) != 2:
        return None
    labels = DOT_FORM.split(parts[1])
    if not re.fullmatch(r"[A-Za-z0-9._%+-]+", DOT_FORM.sub(".", parts[0])) or not all(re.fullmatch(r"[A-Za-z0-9-]+", x) for x in labels) or parts[0][-1] in ".-":
        return None
    at = span[len(parts[0]):len(span) - len(parts[1])]
    kind = "plain" if at == "@" else "bracket" if re.search(r"[\[({<]", at) else "sign" if "@" in at else "word"
    spelled = "spelled" if re.search(r"dot|[\[({<]", parts[1], re.I) or " " in parts[1] else "plain"
    top = "none" if len(labels) == 1 else "word" if labels[-1].isalpha() and 2 <= len(labels[-1]) <= 6 else "other"
    return ["address", f"at-{kind}", f"at-{kind}-{spelled}", f"top-{top}", f"at-{kind}-top-{top}", f"labels-{min(len(labels), 3)}"]


def _numbers(span: str) -> list[str] | None:
    """The features of a span of digit groups and what stands between them."""
    plain = re.sub(r"\x20?[\[({<]\x20?\.\x20?[\])}>]\x20?|\x20\.\x20", ".", span)
    groups = re.findall(r"[0-9]+", plain)
    digits = "".join(groups)
    if not (10 <= len(digits) <= 19 or len(groups) == 4) or re.search(r"[%@<>]", plain):
        return None  # neither phone nor card nor address
    between = re.split(r"[0-9]+", plain)
    inner = [re.sub(r"\x20", "_", x) for x in between[1:-1]]
    same, sizes = len(set(inner)) <= 1, [len(g) for g in groups]
    start = "plus" if between[0].startswith("+") else "paren" if between[0].startswith("(") else "zeros" if digits.startswith("00") else "zero" if digits.startswith("0") else "digit"
    balanced = all(span.count(a) == span.count(b) for a, b in ("()", "[]", "{}"))
    out = ["numbers"]
    if len(groups) == 4 and (same or "." in set(inner)):
        valid = all(s <= 3 and int(g) <= 255 and (s == 1 or g[0] != "0") for g, s in zip(groups, sizes))
        # Four short groups with dots, however the dots are written
        out = ["quad" if same and inner[0] == "." else "four", f"octets-{valid}", f"octets-{valid}-{'dot' if same and inner[0] == '.' else 'other'}"]
    long = 14 <= len(digits) <= 19
    fours = long and all(s == 4 for s in sizes[:-1]) and len(groups) > 2
    if long:
        check = luhn(digits)
        out += [f"luhn-{check}", f"luhn-{check}-fours-{fours}-same-{same}", f"luhn-{check}-one-{len(groups) == 1}"]
    phone = 10 <= len(digits) <= 15
    ends = "-".join(map(str, sizes[-3:])) if len(groups) > 1 else "one"
    date = len(groups) >= 3 and bool(re.match(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}(?![0-9])|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}(?![0-9])", plain))
    clock = bool(re.search(r"[0-9]:[0-9]", plain))
    kinds = "".join(sorted(set("".join(inner)) - set("0123456789")))
    out += [f"phone-{phone}", f"count-{min(len(digits), 20)}", f"phone-{phone}-start-{start}", f"phone-{phone}-ends-{ends}", f"phone-{phone}-groups-{min(len(groups), 6)}", f"groups-{min(len(groups), 6)}",
            f"date-{date}", f"clock-{clock}", f"balanced-{balanced}", f"same-{same}", f"grouping-{len(groups) > 2 and all(s == 3 for s in sizes[1:])}-phone-{phone}",
            f"short-{sum(s == 1 for s in sizes) > len(sizes) / 2}", f"wide-{max(map(len, inner), default=0) > 3}"]
    out += [f"mark-{k}" for k in kinds]
    return out


def _class(ch: str) -> str:
    return "edge" if not ch else "digit" if ch in "0123456789" else "letter" if ch.isalpha() else "blank" if ch.isspace() else "mark" if ch in "+@._%-()/:" else "other"


def stretches(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(start, stretch, characters before, characters after): those that can hold a span, having an @, seven digits, or an at
    that is written out."""
    done = 0
    while m := ANCHOR.search(text, done):
        a = m.start()
        while a > done and text[a - 1] in RUN_CHARS:
            a -= 1
        b = RUN.match(text, m.start()).end()
        while text[b:b + 1] == " ":
            more = RUN.match(text, b + 1)
            if more and ANCHOR.search(text, b + 1, more.end()):
                b = more.end()
            elif more and JOINING.match(text, b + 1) and (then := RUN.match(text, more.end() + 1)) and text[more.end()] == " " and ANCHOR.search(text, more.end() + 1, then.end()):
                b = then.end()
            else:
                break
        done, s = b, text[a:b]
        if "@" in s or sum(c in "0123456789" for c in s) >= 7 or re.search(r"[0-9][^0-9]{1,5}[0-9]{1,3}[^0-9]{1,5}[0-9]{1,3}[^0-9]{1,5}[0-9]", s):
            yield a, s, text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]
    done = 0
    for m in SPELLED.finditer(text):
        if m.start() < done:
            continue
        low = max(done, m.start() - WINDOW)
        found = [x for x in ADDRESS.finditer(text, low, min(len(text), m.end() + WINDOW)) if x.start() <= m.start() < x.end()]
        if found:
            a, done = found[0].span()
            yield a, text[a:done], text[max(0, a - CONTEXT):a], text[done:done + CONTEXT]


def candidates(s: str, before: str, after: str) -> tuple[list[int], list[tuple[int, int, tuple[str, ...]]]]:
    """Atom boundaries and the candidate spans (from atom, to atom, features), at most MAX_ATOMS atoms each."""
    cuts = [0, *(m.end() for m in ATOM.finditer(s))]
    out = []
    for i in range(len(cuts) - 1):
        for j in range(i + 1, min(i + MAX_ATOMS, len(cuts) - 1) + 1):
            left = (before + s[:cuts[i]])[-CONTEXT:]
            f = span_features(s[cuts[i]:cuts[j]], left, (s[cuts[j]:] + after)[:1])
            if f:
                out.append((i, j, f))
    return cuts, out


class Crf:
    """Weights of (feature, kind), one score for atoms outside of spans being 0."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.memo: dict = {}
        self.known: dict = {}

    def __getstate__(self):
        return {"weights": self.weights, "memo": {}, "known": {}}  # what was decoded stays in its process

    def scores(self, features) -> np.ndarray:
        if features not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[features] = sum((self.weights[f] for f in features if f in self.weights), np.zeros(len(KINDS))) + self.weights.get("bias", 0.0)
        return self.known[features]

    def lattice(self, n: int, spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums over all segmentations, and the spans' scores (span x kind)."""
        scores = np.array([self.scores(f) for _, _, f in spans]).reshape(len(spans), len(KINDS))
        sums = np.logaddexp.reduce(scores, axis=1) if len(spans) else scores[:, 0]
        ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = back[n] = 0.0
        to, of = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for k, (i, j, _) in enumerate(spans):
            to[j].append((i, k))
            of[i].append((j, k))
        for e in range(1, n + 1):
            ahead[e] = np.logaddexp.reduce([ahead[e - 1], *(ahead[i] + sums[k] for i, k in to[e])])
        for b in range(n - 1, -1, -1):
            back[b] = np.logaddexp.reduce([back[b + 1], *(back[j] + sums[k] for j, k in of[b])])
        return ahead, back, scores

    def decode(self, s: str, before: str, after: str) -> list[tuple[int, int, int, float]]:
        """Best segmentation: (start, kind, end, probability of that span and kind) within the stretch."""
        cuts, spans = candidates(s, before, after)
        if not spans:
            return []
        n = len(cuts) - 1
        ahead, back, scores = self.lattice(n, spans)
        best, how = [0.0] + [-math.inf] * n, [None] * (n + 1)
        to = [[] for _ in range(n + 1)]
        for k, (i, j, _) in enumerate(spans):
            to[j].append((i, k))
        for e in range(1, n + 1):
            best[e], how[e] = best[e - 1], None
            for i, k in to[e]:
                v = best[i] + scores[k].max()
                if v > best[e]:
                    best[e], how[e] = v, k
        out, e = [], n
        while e:
            k = how[e]
            if k is None:
                e -= 1
                continue
            i, j, _ = spans[k]
            kind = int(scores[k].argmax())
            out.append((cuts[i], kind, cuts[j], float(np.exp(ahead[i] + scores[k][kind] + back[j] - ahead[n]))))
            e = i
        return out[::-1]


# Labels beyond the patterns --------------------------------------------------------------------------------------

def _grouped(digits: str, sizes: list[int], marks: list[str]) -> str:
    out, at = digits[:sizes[0]], sizes[0]
    for n, mark in zip(sizes[1:], marks):
        out, at = out + mark + digits[at:at + n], at + n
    return out


def _local(d: str) -> str:
    return d[-10:] if d[-10] != "0" else "2" + d[-9:]


#: Written forms of a find that the patterns don't take, by kind; HELD_OUT forms are never learned from.
FORMS = {
    "phone": [lambda d: f"({_local(d)[:3]}) {_local(d)[3:6]}-{_local(d)[6:]}", lambda d: _grouped(_local(d), [3, 3, 4], ["-", "-"]), lambda d: _grouped(_local(d), [3, 3, 4], [".", "."]),
              lambda d: _grouped(_local(d), [3, 3, 4], [" ", " "]), lambda d: f"00{d[:2]} {d[2:5]} {d[5:]}", lambda d: f"00{d[:2]} {d[2:5]} {d[5:8]} {d[8:]}", lambda d: f"0{d[-10:-7]} {d[-7:]}", lambda d: f"1 ({_local(d)[:3]}) {_local(d)[3:6]}-{_local(d)[6:]}",
              lambda d: f"0{d[-10:-7]}/{d[-7:]}", lambda d: f"1-{_grouped(_local(d), [3, 3, 4], ['-', '-'])}"],
    "card": [lambda d: _grouped(d, [4] * (len(d) // 4) + ([len(d) % 4] if len(d) % 4 else []), ["."] * 9), lambda d: _grouped(d, [4] * (len(d) // 4) + ([len(d) % 4] if len(d) % 4 else []), ["/"] * 9),
             lambda d: _grouped(d, [4] * (len(d) // 4) + ([len(d) % 4] if len(d) % 4 else []), [" - "] * 9)],
    "ip": [lambda d: d.replace(".", "[.]"), lambda d: d.replace(".", " . "), lambda d: d.replace(".", "(.)"), lambda d: d.replace(".", " dot ")],
    "email": [lambda d: d.replace("@", " at ").replace(".", " dot "), lambda d: d.replace("@", " [at] ").replace(".", " [dot] "), lambda d: d.replace("@", "(at)"), lambda d: d.replace("@", " @ "),
              lambda d: d.split(".")[0] if "@" in d.split(".")[0] else d.replace("@", "[at]"), lambda d: d.replace("@", "[at]").replace(".", "[dot]")],
}
HELD_OUT = {
    "phone": [lambda d: f"({_local(d)[:3]}){_local(d)[3:6]}.{_local(d)[6:]}", lambda d: f"{_local(d)[:3]} {_local(d)[3:6]}-{_local(d)[6:]}", lambda d: f"00{d[:2]}-{d[2:5]}-{d[5:8]}-{d[8:]}"],
    "card": [lambda d: _grouped(d, [4] * (len(d) // 4) + ([len(d) % 4] if len(d) % 4 else []), ["_"] * 9), lambda d: _grouped(d, [4] * (len(d) // 4) + ([len(d) % 4] if len(d) % 4 else []), [" / "] * 9)],
    "ip": [lambda d: d.replace(".", "{.}"), lambda d: d.replace(".", " DOT ")],
    "email": [lambda d: d.replace("@", " {at} ").replace(".", " {dot} "), lambda d: d.replace("@", " AT ").replace(".", " DOT "), lambda d: d.replace("@", "<at>")],
}
CUE_FORMS = ["{} ", "{}: ", "{} is ", "the {} ", "my {}: ", "{} number "]


def _made_up(kind: str, rng: random.Random) -> str:
    """A find of a kind: digits and names by chance, check digits and octets right."""
    number = lambda n: str(rng.randint(2, 9)) + "".join(str(rng.randrange(10)) for _ in range(n - 1))
    name = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    if kind == "phone":
        return number(rng.choice([11, 12]))
    if kind == "card":
        d = number(rng.choice([15, 15, 14]))
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    return f"{name()}{rng.choice(['', '.' + name(), str(rng.randrange(99))])}@{name()}.{rng.choice(['com', 'org', 'net', 'example.com', 'de', 'io'])}"


def _look_alikes(rng: random.Random) -> list[str]:
    """Numbers and words of the same make that are no personal data."""
    n, number = rng.randrange, lambda k: str(rng.randint(1, 9)) + "".join(str(rng.randrange(10)) for _ in range(k - 1))
    bad = number(15)
    bad += next(str(c) for c in range(10) if not luhn(bad + str(c)))
    date = f"{1990 + n(40)}-{1 + n(12):02}-{1 + n(28):02}"
    return [date, f"{date} {n(24):02}:{n(60):02}:{n(60):02}", f"{1 + n(28):02}.{1 + n(12):02}.{1990 + n(40)}", f"{date}/{1990 + n(40)}-{1 + n(12):02}-{1 + n(28):02}",
            f"{1 + n(9)},{n(1000):03},{n(1000):03}.{n(100):02}", f"{1 + n(9)} {n(1000):03} {n(1000):03}", f"{n(90)}.{number(12)}", number(rng.choice([8, 9, 10, 11, 12])), _grouped(bad, [4, 4, 4, 4], ["."] * 3),
            _grouped(bad, [4, 4, 4, 4], ["/"] * 3), _grouped(bad, [4, 4, 4, 4], ["_"] * 3), f"{300 + n(600)}[.]{n(999)}[.]{300 + n(99)}[.]{n(99)}", f"{300 + n(600)} . {n(999)} . {300 + n(99)} . {n(99)}",
            f"{n(20)}.{n(20)}.{n(20)}-{number(4)}", f"{1900 + n(120)}-{1900 + n(120)}", f"{number(3)}-{number(4)}", " ".join(str(n(100)) for _ in range(12)), f"{number(5)}-{number(4)}-{number(3)}-{number(2)}",
            f"978-{n(10)}-{n(90) + 10}-{number(6)}-{n(10)}", f"{n(24)}:{n(60):02}-{n(24)}:{n(60):02} {n(24)}:{n(60):02}", f"{number(4)} {number(4)}", f"{n(9)} {n(9)} {n(9)} {n(9)} {n(9)} {n(9)} {n(9)} {n(9)} {n(9)} {n(9)} {n(9)}"]


def written_samples(finds: list[tuple[str, str]], forms: dict, rng: random.Random) -> list[tuple[str, str, str, list[tuple[int, int, int]]]]:
    """(stretch, before, after, labelled spans) of finds (kind, text) in every one of the given forms, with or without a cue word."""
    out = []
    cues = {k: [w for w, kind in CUES.items() if kind == k] for k in KINDS}
    for kind, found in finds:
        plain = re.sub(r"[^0-9]", "", found) if kind in ("phone", "card") else found
        for form in forms[kind]:
            text = form(plain)
            lead = rng.choice(["", "the ", "see ", "of ", ", ", "ando ", rng.choice(CUE_FORMS).format(rng.choice(cues[kind])), rng.choice(CUE_FORMS).format(rng.choice(cues[kind]))])
            whole = lead + text + rng.choice(["", " ", ". The", ", or", " now", "\n"])
            for at, s, before, after in stretches(whole):
                if at <= len(lead) and len(lead) + len(text) <= at + len(s):
                    a = len(lead) - at
                    out.append((s, before, after, [(a, KINDS.index(kind), a + len(text))]))
                    break
        if kind in ("phone", "card"):  # bare digits are a number like any other, unless a cue says what they are
            cue = rng.choice(CUE_FORMS).format(rng.choice(cues[kind]))
            bare = plain[-10:] if kind == "phone" else plain
            out.append((bare, cue[-CONTEXT:], "", [(0, KINDS.index(kind), len(bare))]))
            if kind == "phone":
                out.append((bare, rng.choice(["order ", "id ", "item ", "the ", ""]), " ", []))
    return out


def unclear(s: str, before: str, after: str) -> bool:
    """Whether a stretch without a plain find could be a span in another form."""
    for _, _, f in candidates(s, before, after)[1]:
        if f[0] == "address" or "octets-True" in f or "luhn-True" in f or "phone-True" in f and "date-False" in f and "clock-False" in f:
            return True
    return False


def training_set(samples: list, rewritten: int = REWRITTEN, made_up: int = MADE_UP) -> list:
    """Labelled stretches, their finds in other forms, made-up finds in all forms, and look-alikes."""
    rng = random.Random(5)
    out = [x for x in samples if x[3] or not unclear(*x[:3])]
    finds = {k: [] for k in KINDS}
    for s, _, _, gold in samples:
        for a, k, b in gold:
            if len(finds[KINDS[k]]) < rewritten:
                finds[KINDS[k]].append(s[a:b])
    for k in KINDS:
        finds[k] += [_made_up(k, rng) for _ in range(made_up)]
    out += written_samples([(k, f) for k in KINDS for f in finds[k]], FORMS, rng)
    for _ in range(2 * made_up):
        for text in _look_alikes(rng):
            lead = rng.choice(["", "the ", "on ", "total ", "code ", "in ", "version ", "from "])
            out += [(s, before, after, []) for _, s, before, after in stretches(lead + text + rng.choice(["", " ", ".", " of"])) if not base_spans(s)]
    # plain forms of what was made up keep the patterns' own spans known
    out += [(f, "", "", [(0, KINDS.index(k), len(f))]) for k in ("email", "ip") for f in finds[k][-made_up:]]
    out += [("+" + f, "", "", [(0, KINDS.index("phone"), len(f) + 1)]) for f in finds["phone"][-made_up:]] + [(f, "", "", [(0, KINDS.index("card"), len(f))]) for f in finds["card"][-made_up:]]
    return out


def fit_weights(samples: list[tuple[str, str, str, list[tuple[int, int, int]]]]) -> Crf:
    """Maximum likelihood by full-batch adaptive gradient steps on `training_set(samples)`: samples are (stretch, before, after,
    labelled spans within). The lattices of all stretches are summed together, place by place."""
    stretch, spans, rows, targets, sizes = 0, [], [], [], []
    for s, before, after, gold in training_set(samples):
        cuts, found = candidates(s, before, after)
        if not found:
            continue
        at = {c: i for i, c in enumerate(cuts)}
        want = {(at[a], at[b]): k for a, k, b in gold if a in at and b in at}
        sizes.append(len(cuts) - 1)
        for i, j, f in found:
            spans.append((stretch, i, j))
            rows.append(f)
            targets.append(want.get((i, j), -1))
        stretch += 1
    names = sorted({f for r in rows for f in r})
    number = {f: i for i, f in enumerate(names)}
    kinds, weights = len(KINDS), np.zeros((len(names) + 1, len(KINDS)))
    weights[-1] = -4.0
    if rows:
        owner, begin, end = np.array(spans).T
        feature = np.array([i for r in rows for i in [*(number[f] for f in r), len(names)]])
        span_of = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
        starts = np.searchsorted(span_of, np.arange(len(rows)))
        target, n = np.array(targets), np.array(sizes)
        gold = np.zeros((len(rows), kinds))
        gold[np.flatnonzero(target >= 0), target[target >= 0]] = 1.0
        ending = [np.flatnonzero(end == e) for e in range(n.max() + 1)]
        opening = [np.flatnonzero(begin == b) for b in range(n.max() + 1)]
        scale, every = np.full_like(weights, 1e-6), np.arange(stretch)
        for _ in range(STEPS):
            scores = np.add.reduceat(weights[feature], starts, axis=0)
            sums = np.logaddexp.reduce(scores, axis=1)
            ahead, back = np.full((2, stretch, n.max() + 1), -np.inf)
            ahead[:, 0] = 0.0
            back[every, n] = 0.0
            for e in range(1, n.max() + 1):
                ahead[:, e] = ahead[:, e - 1]
                k = ending[e]
                np.logaddexp.at(ahead, (owner[k], np.full(len(k), e)), ahead[owner[k], begin[k]] + sums[k])
            for b in range(n.max() - 1, -1, -1):
                inside = b < n
                back[inside, b] = back[inside, b + 1]
                k = opening[b]
                np.logaddexp.at(back, (owner[k], np.full(len(k), b)), back[owner[k], end[k]] + sums[k])
            wrong = gold - np.exp(ahead[owner, begin][:, None] + scores + back[owner, end][:, None] - ahead[owner, n[owner]][:, None])
            grad = np.stack([np.bincount(feature, wrong[span_of, k], len(weights)) for k in range(kinds)], axis=1) - SHRINK * stretch * weights
            scale += grad**2
            weights += RATE * grad / np.sqrt(scale)
    return Crf({f: weights[i] for f, i in number.items()} | {"bias": weights[-1]})


def find(text: str, crf: Crf) -> tuple[list, list]:
    """Plain spans, and the model's further ones: those that no plain span overlaps."""
    base = base_spans(text)
    more = []
    for at, s, before, after in stretches(text):
        for a, k, b, p in _decoded(crf, s, before, after):
            a, b = at + a, at + b
            if p >= SURE and all(b <= x or a >= y for x, _, y in base) and all(b <= x or a >= y for x, _, y in more[-40:]):
                more.append((a, k, b))
    return base, sorted(more)


def _decoded(crf: Crf, s: str, before: str, after: str):
    """Decoded once per model, stretch and context; the memory is bounded."""
    key, memo = (s, before, after[:1]), crf.memo
    if key not in memo:
        if len(memo) > 50_000:
            memo.clear()
        memo[key] = crf.decode(s, before, after)
    return memo[key]


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = FIT_STRETCHES) -> Crf:
    """Fitted on at most `limit` distinct stretches (with context and labels), those with the smallest hashes, labelled by the
    plain patterns. Copies of a stretch count once."""
    d = docs.filter(F.col(f"`{text_col}`").rlike("[0-9@]"))
    d = (d if learn is None else d.filter(learn)).select(F.col(f"`{text_col}`").alias("text"))

    def sample(batches):
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base = base_spans(text)
                for at, s, before, after in stretches(text):
                    gold = [x for a, k, b in base if a >= at and b <= at + len(s) for x in (a - at, k, b - at)]
                    rows.append((s, before, after[:1], gold))
            # Repeats of a batch go here, the others in the grouping.
            yield pd.DataFrame(list({(s, x, y, tuple(g)): (s, x, y, g) for s, x, y, g in rows}.values()), columns=["s", "before", "after", "gold"])

    found = d.mapInPandas(sample, "s string, before string, after string, gold array<int>").distinct()
    rows = found.orderBy(F.xxhash64("s", "before"), "s", "before", "after", "gold").limit(limit).collect()  # bounded by `limit`
    return fit_weights([(r.s, r.before, r.after, [tuple(r.gold[i:i + 3]) for i in range(0, len(r.gold), 3)]) for r in rows])


def find_personal_data(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and found, arrays of (start, kind, end); kind indexes KINDS.

    `base` are the plain finds, `found` the spans that the model adds; positions are code points, end exclusive. Null and
    empty texts have none; a null doc_id stays null; repeated rows give equal results; where spans tie, the shorter path
    of the earlier span wins. Whole texts are read, a row at a time. Other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # features x kinds

    def run(batches):
        for pdf in batches:
            out = [find(t or "", shared.value) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "base": [[list(x) for x in b] for b, _ in out], "found": [[list(x) for x in f] for _, f in out]})

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    raw = d.mapInPandas(run, "doc_id long, base array<array<int>>, found array<array<int>>")
    shaped = lambda c: F.transform(c, lambda x: F.struct(x[0].alias("start"), x[1].alias("kind"), x[2].alias("end"))).alias(c)
    return raw.select("doc_id", shaped("base"), shaped("found"))


def written_spans(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
