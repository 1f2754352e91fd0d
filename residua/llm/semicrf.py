"""A semi-Markov conditional random field over words.

A labelling cuts a run of words into segments: single words that are no
entity, and entities of one type.  An entity has at most ``MAX_WORDS`` words
and, with more than one word, at most ``MAX_CHARS`` characters from its first
to its last; that bounds the segments that end at a word, and so the dynamic
programming.  (A single word may have any length.)  Each
segment is scored by features of its whole span, and neighbouring segments
by a transition weight.  Decoding and training sum or maximise over all
segmentations by dynamic programming over segment ends.
"""

from __future__ import annotations

import bisect
import itertools
import re

import numpy as np

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)                          # label of words outside entities
LABELS = NONE + 1
MAX_WORDS, MAX_CHARS = 8, 80

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_AT = re.compile(r"\s*(?:\(at\)|\[at\])\s*|\s+at\s+", re.I)
_DOT = re.compile(r"\s*(?:\(dot\)|\[dot\]|\[\.\])\s*|\s+dot\s+", re.I)
_IP = re.compile(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})")
_NUMERIC = re.compile(r"\+?[0-9][0-9 ().-]*[0-9]|\([0-9]+\)[0-9 .-]*[0-9]")
_EDGE = "\"'.,;:!?*#$%&|=<>{}`"
# what may join the parts of a host's name: all that _DOT takes, and a point
_JOIN = r"(?:\.|\s*(?:\(dot\)|\[dot\]|\[\.\])\s*|\s+dot\s+)"
#: words that make a stretch of text worth decoding; a bare "at" is one before a dotted host
TRIGGER = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]|\[\.\]|\bdot\b"
                     rf"|(?<=\s)at(?=\s+[A-Za-z0-9-]+{_JOIN}[A-Za-z0-9-])", re.I)
_COMMON = re.compile(r"[0-9@]")
_WRITTEN = re.compile(r"dot|[(\[]at[)\]]|\[\.\]|\sat\s", re.I)
CUES = ("email", "mail", "e-mail", "contact", "ip", "host", "server", "card", "visa", "phone", "tel", "call", "fax",
        "mobile", "version", "license", "token", "key", "id", "page", "no", "year")

_DIGIT_BINS = (0, 4, 7, 9, 10, 13, 16, 17, 20)
FEATURES = ("bias", *(f"digits>={b}" for b in _DIGIT_BINS), "letters", "letters>=12", "one@", "two@", "hidden_at",
            "hidden_dot", "email_shape", "ip_shape", "dotted<4", "numeric", "luhn", "not_luhn", "plus", "opens_zero",
            "groups>=3", "groups=2", "words=2", "words>=3", "mixed", "colon", "date", "trigger", "first_trigger",
            "last_trigger", "phone_length", *(f"cue:{c}" for c in CUES))
_PLACE = {f: i for i, f in enumerate(FEATURES)}
WIDTH = len(FEATURES)


def may_trigger(text: str) -> bool:
    """A quick test that holds for every text with a trigger."""
    return bool(_COMMON.search(text) or _WRITTEN.search(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def trim(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its edges and without unmatched brackets."""
    while start < end:
        a, z, inner = text[start], text[end - 1], text[start:end]
        if a in _EDGE or a in ")]" or (a in "([" and (")" if a == "(" else "]") not in inner):
            start += 1
        elif z in _EDGE or z in "([" or (z in ")]" and ("(" if z == ")" else "[") not in inner):
            end -= 1
        elif a in "([" and z in ")]":
            start, end = start + 1, end - 1
        else:
            break
    return start, end


def features(span: str, n_words: int, before: str, triggers: tuple[bool, bool, bool]) -> list[int]:
    """Places of the features that hold for a trimmed span; ``before`` is the word to its left."""
    on = ["bias"]
    digits = "".join(c for c in span if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in span)
    on += [f"digits>={b}" for b in _DIGIT_BINS if len(digits) >= b]
    if letters:
        on.append("letters")
        if letters >= 12:
            on.append("letters>=12")
    at = span.count("@")
    if at:
        on.append("one@" if at == 1 else "two@")
    plain = span
    if not at and letters:
        plain = _AT.sub("@", span, count=1)
        if plain != span:
            on.append("hidden_at")
    dotted = _DOT.sub(".", plain)
    if dotted != plain:
        on.append("hidden_dot")
    if "@" in dotted and EMAIL.fullmatch(dotted):
        on.append("email_shape")
    ip = _IP.fullmatch(dotted)
    if ip and all(int(p) < 256 for p in ip.groups()):
        on.append("ip_shape")
    elif digits and not letters and 0 < dotted.count(".") < 3 and " " not in dotted:
        on.append("dotted<4")
    if digits and _NUMERIC.fullmatch(span):
        on.append("numeric")
        if 13 <= len(digits) <= 19:
            on.append("luhn" if luhn(digits) else "not_luhn")
        if 9 <= len(digits) <= 15:
            on.append("phone_length")
        if span[0] == "+":
            on.append("plus")
        elif span[0] in "(0":
            on.append("opens_zero")
        groups = len([g for g in re.split(r"[ ().-]+", span) if g])
        if groups >= 3:
            on.append("groups>=3")
        elif groups == 2:
            on.append("groups=2")
        if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}){1,2}", span):
            on.append("date")
    elif digits and letters and not at:
        on.append("mixed")
    if ":" in span or "/" in span:
        on.append("colon")
    if n_words > 1:
        on.append("words=2" if n_words == 2 else "words>=3")
    on += [name for name, yes in zip(("trigger", "first_trigger", "last_trigger"), triggers, strict=True) if yes]
    cue = before.strip("\"'.,;:!?()[]=").lower()
    if cue in CUES:
        on.append(f"cue:{cue}")
    return [_PLACE[f] for f in on]


class Run:
    """A stretch of words: their places in the text and all candidate segments with features.

    Spans of ``taken`` (sorted) are settled: no entity overlaps one, and the
    rest of the stretch is segmented around them.
    """

    def __init__(self, text: str, words: list[tuple[int, int]], taken: list[tuple[int, int]] | None = None):
        taken = taken or []
        reach = list(itertools.accumulate((z for _, z in taken), max, initial=0))
        self.words = words
        hits = [m.start() for m in TRIGGER.finditer(text, words[0][0], words[-1][1])] if words else []
        hot = [bisect.bisect_left(hits, a) < bisect.bisect_left(hits, z) for a, z in words]
        barrier = [i > 0 and "\n" in text[words[i - 1][1]:words[i][0]] for i in range(len(words))]
        self.at: list[list[tuple[int, int, int, list[int]]]] = [[] for _ in range(len(words) + 1)]
        for i in range(len(words)):
            before = text[slice(*words[i - 1])] if i and not barrier[i] else ""
            some = False
            for j in range(i, min(i + MAX_WORDS, len(words))):
                if j > i and (barrier[j] or words[j][1] - words[i][0] > MAX_CHARS):
                    break
                some |= hot[j]
                if j > i and not some:
                    continue
                a, z = trim(text, words[i][0], words[j][1])
                free = reach[bisect.bisect_left(taken, (z, -1))] <= a
                if j > i and not free:
                    continue
                f = features(text[a:z], j - i + 1, before, (some, hot[i], hot[j]))
                # start, trimmed span, features; an entity needs a trigger in it
                self.at[j + 1].append((i, a, z, f) if some and a < z and free else (i, -1, -1, f))

    def __len__(self):
        return len(self.words)


def _segment_scores(w: np.ndarray, run: Run):
    """Per end: (start, label scores) of its segments; impossible labels are -inf."""
    out = []
    for j, found in enumerate(run.at):
        here = []
        for i, a, _, f in found:
            s = w[:, f].sum(axis=1)
            if a < 0:
                s[:NONE] = -np.inf
            if j - i > 1:
                s[NONE] = -np.inf
            here.append((i, s))
        out.append(here)
    return out


def decode(w: np.ndarray, trans: np.ndarray, run: Run) -> list[tuple[int, int, int]]:
    """The best segmentation's entities: (label, start, end) in the text."""
    n = len(run)
    best = [[-np.inf] * LABELS for _ in range(n + 1)]
    best[0][NONE] = 0.0
    back: list[list] = [[None] * LABELS for _ in range(n + 1)]
    move = trans.tolist()
    for j, here in enumerate(_segment_scores(w, run)):
        for k, (i, s) in enumerate(here):
            scores = s.tolist()
            for y in range(LABELS):
                if scores[y] == -np.inf:
                    continue
                for p in range(LABELS):
                    v = best[i][p] + move[p][y] + scores[y]
                    if v > best[j][y]:
                        best[j][y], back[j][y] = v, (i, p, k)
    out, j = [], n
    y = max(range(LABELS), key=lambda q: best[n][q]) if n else NONE
    while j > 0:
        i, p, k = back[j][y]
        if y != NONE:
            out.append((y, *run.at[j][k][1:3]))
        j, y = i, p
    return out[::-1]


def _lse(x, axis=None):
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top
    return out.squeeze(axis) if axis is not None else float(out.reshape(-1)[0])


def expected(w: np.ndarray, trans: np.ndarray, run: Run, gold: dict[tuple[int, int], int]):
    """Log-likelihood of a gold segmentation and its gradient; ``gold``: (start word, end word) -> label."""
    n = len(run)
    scores = _segment_scores(w, run)
    alpha = np.full((n + 1, LABELS), -np.inf)
    alpha[0, NONE] = 0.0
    for j in range(1, n + 1):
        if scores[j]:
            alpha[j] = _lse(np.stack([_lse(alpha[i][:, None] + trans, axis=0) + s for i, s in scores[j]]), axis=0)
    beta = np.full((n + 1, LABELS), -np.inf)
    beta[n] = 0.0
    onward: list[list] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i, s in scores[j]:
            onward[i].append((j, s))
    for i in range(n - 1, -1, -1):
        if onward[i]:
            beta[i] = _lse(np.stack([_lse(trans + (s + beta[j])[None, :], axis=1) for j, s in onward[i]]), axis=0)
    z = _lse(alpha[n])
    gw, gt, like, last = np.zeros_like(w), np.zeros_like(trans), -z, {0: NONE}
    for j in range(1, n + 1):
        for (i, s), (_, _, _, f) in zip(scores[j], run.at[j], strict=True):
            p = np.exp(alpha[i][:, None] + trans + (s + beta[j])[None, :] - z)
            p = np.where(np.isfinite(p), p, 0.0)
            gt -= p
            gw[:, f] -= p.sum(axis=0)[:, None]
            y = gold.get((i, j))
            if y is not None:
                prev = last[i]
                like += float(s[y] + trans[prev, y])
                gw[y, f] += 1
                gt[prev, y] += 1
                last[j] = y
    return like, gw, gt


def fit(examples: list[tuple[Run, dict]], epochs: int = 8, rate: float = 0.15, decay: float = 0.002):
    """Weights by stochastic ascent of the conditional likelihood, with small weight decay."""
    w, trans = np.zeros((LABELS, WIDTH)), np.zeros((LABELS, LABELS))
    sw, st = np.full_like(w, 1e-6), np.full_like(trans, 1e-6)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            _, gw, gt = expected(w, trans, *examples[k])
            for x, g, s in ((w, gw, sw), (trans, gt, st)):
                g -= decay * x
                s += g * g
                x += rate * g / np.sqrt(s)
    return w, trans
