"""Personal data by exact patterns and a semi-Markov conditional random field.

Base spans are the matches of four patterns over whole texts. Around each digit, @ or spelled-out address the text is a
zone of tokens, and the field chooses among all segmentations of a zone: a segment is a candidate entity of a type
(up to MOST_TOKENS tokens) or a single other token, scored by features of the whole span (shape, digit count,
check digit, punctuation, what stands before and after) and by the type of the segment before it. Dynamic programming
over bounded entities and the type of the last one picks boundaries and types together; zones take their steps side by
side in numpy. Base spans are segments that every segmentation has; the other entities are added to them.

The weights are trained in numpy on the driver, by the conditional likelihood of segmentations: base spans of a bounded
sample of documents, and rewritten ones (spelled-out addresses, numbers without a plus, other numbers that are none)
in the same surroundings. Scanning is one Arrow pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import spans as sp
from tracewright.llm.common import id_field, ids_and_texts, map_texts, one_blas_thread, table, utf8

KINDS = ["email", "ip", "card", "phone"]
#: Tokens of an entity; characters around an anchor; documents of the sample, zones trained on, steps of training.
MOST_TOKENS, AROUND, SAMPLE, TRAIN_ZONES, STEPS = 18, 48, 300, 300, 80
#: Zones of one document that are trained on, at most.
ZONES_OF_TEXT, ZONE_OF_TEXT = 3, 600  # zones of a text that are learned from, and characters of each
#: Tokens whose candidates are scored at once, and characters of zones that are segmented together (a longer one alone).
SCORE_TOKENS, ZONE_CHARS = 8_000, 250_000
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: before it the longest run of local characters not used up yet."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the matches that hold, by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\x00-\x7F]+|[^\sA-Za-z0-9]")
_ANCHOR = re.compile(r"[0-9@]|\b[Aa][Tt]\b[^.\n]{1,40}\b[Dd][Oo][Tt]\b|\[at\]|\(at\)")
_TOP_LEVEL = {"com", "org", "net", "edu", "gov", "io", "co", "uk", "de", "fr", "es", "it", "eu", "info"}
_CUES = {"email": 0, "mail": 0, "contact": 0, "write": 0, "ip": 1, "host": 1, "server": 1, "card": 2, "visa": 2, "credit": 2, "payment": 2, "phone": 3, "tel": 3, "call": 3, "fax": 3, "mobile": 3}


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches of text around anchors, each widened to white space; neighbouring ones are one."""
    found: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        if found and m.start() - AROUND <= found[-1][1]:
            found[-1][1] = max(found[-1][1], m.end() + AROUND)
        else:
            found.append([max(0, m.start() - AROUND), m.end() + AROUND])
    return [(a if a == 0 else a + len(text[a : a + AROUND].split(" ")[0]), min(b, len(text))) for a, b in found]


@dataclass
class Tokens:
    """Tokens of many zones, one after another."""

    text: list[str]
    start: np.ndarray
    end: np.ndarray
    zone: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Tokens:
        held = [[(m[0], m.start(), m.end()) for m in _TOKEN.finditer(t)] for t in texts]
        n = [len(h) for h in held]
        each = [x for h in held for x in h]
        return cls([x[0] for x in each], np.array([x[1] for x in each], int), np.array([x[2] for x in each], int), np.repeat(np.arange(len(n)), n), np.concatenate([[0], np.cumsum(n)]).astype(int))


FEATURES = 26
_JOINT = set(".-()+@ _%[]")


def segments(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, length and features (FEATURES columns of 0 or 1) of every candidate entity.

    A candidate has a digit or an address sign, letters, digits and joining signs only, and begins and ends with a
    letter, a digit, or a plus or bracket in front.
    """
    n = len(tokens.text)
    if not n:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, FEATURES), np.float32)
    words = tokens.text
    length = tokens.end - tokens.start
    digit = np.array([w[0].isascii() and w[0].isdigit() for w in words])
    alpha = np.array([w[0].isascii() and w[0].isalpha() for w in words])
    low = [w.lower() for w in words]
    at = np.array([w == "@" or w == "at" for w in low])
    sign = np.array([w == "@" for w in low])
    dot = np.array([w in (".", "dot") for w in low])
    real_dot = np.array([w == "." for w in low])
    plus, bracket = np.array([w == "+" for w in words]), np.array([w in "([" for w in words])
    joint = np.array([w in _JOINT for w in words])
    small = np.array([d and len(w) <= 3 and int(w) <= 255 for w, d in zip(words, digit, strict=True)])
    same = np.append(tokens.zone[1:] == tokens.zone[:-1], False)
    gap = np.append(tokens.start[1:] > tokens.end[:-1], True) | ~same
    wide = np.append(tokens.start[1:] - tokens.end[:-1] > 1, True) | ~same
    cue = np.array([_CUES.get(w, -1) for w in low])
    near = np.full((n, 4), False)
    for back in range(1, 5):
        if n > back:
            hit = (cue[:-back] >= 0) & (tokens.zone[back:] == tokens.zone[:-back])
            near[np.flatnonzero(hit) + back, cue[:-back][hit]] = True
    top_level = np.array([w in _TOP_LEVEL for w in low])
    last_at = np.maximum(np.maximum.accumulate(np.where(at, np.arange(n), -1)), 0)
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    sums = {k: total(v) for k, v in {"digits": np.where(digit, length, 0), "runs": digit, "alpha": alpha, "at": at, "sign": sign, "dot": dot, "real": real_dot, "plus": plus, "odd": ~(digit | alpha | joint), "gap": gap, "wide": wide, "small": small}.items()}
    out_start, out_len, out = [], [], []
    starts = np.flatnonzero(digit | plus | bracket | alpha)
    for size in range(1, MOST_TOKENS + 1):
        i = starts[starts + size <= n]
        last = i + size - 1
        over = lambda k, a=0, b=0, i=i, size=size: sums[k][i + size + b] - sums[k][i + a]
        kept = (tokens.zone[last] == tokens.zone[i]) & (digit[last] | alpha[last]) & (over("odd") == 0) & (over("wide", 0, -1) == 0)
        kept &= (over("digits") >= 4) | (over("at") == 1)
        kept &= ~(plus[i] | bracket[i]) | (over("digits") >= 7)
        i, last = i[kept], last[kept]
        over = lambda k, a=0, b=0, i=i, size=size: sums[k][i + size + b] - sums[k][i + a]
        digits, gaps, letters = over("digits"), over("gap", 0, -1), over("alpha")
        pure = letters == 0
        before = np.where((i > 0) & (tokens.zone[np.maximum(i - 1, 0)] == tokens.zone[i]), ~gap[np.maximum(i - 1, 0)], False)
        after = (last + 1 < n) & ~gap[last]
        touching_digit = (before & (digit | alpha)[np.maximum(i - 1, 0)]) | (after & (digit | alpha)[np.minimum(last + 1, n - 1)])
        joined_after = after & (sign | plus)[np.minimum(last + 1, n - 1)]
        four = pure & (size == 7) & (over("small") == 4) & (over("real") == 3) & (gaps == 0)
        checked = np.zeros(len(i), bool)
        for k in np.flatnonzero(pure & (digits >= 12) & (digits <= 19) & (over("real") == 0) & (over("plus") == 0)):
            checked[k] = luhn("".join(w for w in words[i[k] : last[k] + 1] if w.isdigit()))
        address = (over("sign") == 1) & (gaps == 0) & (over("real") >= 1) & (letters >= 2) & (digit | alpha)[i]
        # words before and after the at: a name and a host, each with spelled dots between single words
        middle, words_in = last_at[last], lambda k, x, y: sums[k][y] - sums[k][x]
        dots = lambda x, y: words_in("dot", x, y) - words_in("real", x, y)
        spelled = top_level[last] & (over("at") == 1) & (over("sign") == 0) & (letters >= 4) & (dots(middle, i + size) >= 1)
        spelled &= (words_in("gap", i, middle) == 1 + 2 * dots(i, middle)) & (words_in("gap", middle, last) == 1 + 2 * dots(middle, i + size))
        phone_like = pure & (digits >= 9) & (digits <= 15) & (over("real") <= 3) & ~four
        dates = pure & (over("runs") == 3) & (digits == 8) & (size == 5)
        f = np.stack(
            [np.ones(len(i), bool), four, pure & (over("real") == 3) & ~four, checked, pure & (digits >= 12) & (digits <= 19) & ~checked, address, spelled, (over("at") == 1) & ~address & ~spelled,
             phone_like & plus[i], phone_like & ~plus[i] & bracket[i], phone_like & ~plus[i] & (over("runs") == 3) & (digits == 10), phone_like & ~plus[i] & (over("runs") == 1), pure & (digits < 9), pure & (digits > 19), dates,
             letters > 0, gaps > 0, (gaps > 0) & (letters > 0) & ~spelled, before, after, touching_digit, joined_after, near[i, 0], near[i, 1], near[i, 2], near[i, 3]], axis=1,
        )
        out_start.append(i)
        out_len.append(np.full(len(i), size))
        out.append(f)
    return np.concatenate(out_start), np.concatenate(out_len), np.concatenate(out).astype(np.float32)


@dataclass
class Field:
    """Weights of a span's features (kinds x features), and of a segment's kind after another's (OTHER for no entity)."""

    features: np.ndarray
    after: np.ndarray

    @classmethod
    def blank(cls) -> Field:
        """A bias against entities and nothing else."""
        features = np.zeros((len(KINDS), FEATURES))
        features[:, 0] = -4.0
        return cls(features, np.zeros((len(KINDS) + 1, len(KINDS) + 1)))


OTHER = len(KINDS)
#: What a base span gains as a segment, so that every segmentation has it.
FIXED = 1e6


def scored(tokens: Tokens, weights: np.ndarray, at_once: int = SCORE_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, length and scores by kind of every candidate, with the features of a stretch of tokens at once.

    A stretch reaches as far beyond its own tokens as a candidate and its features do, so the results are those of all
    tokens together.
    """
    n, parts = len(tokens.text), []
    for a in range(0, n, at_once):
        low, high = max(0, a - 5), min(n, a + at_once + MOST_TOKENS + 1)
        start, size, features = segments(Tokens(tokens.text[low:high], tokens.start[low:high], tokens.end[low:high], tokens.zone[low:high], tokens.bounds))
        start = start + low
        own = (start >= a) & (start < a + at_once)
        parts.append((start[own], size[own].astype(np.int8), (features[own] @ weights.T).astype(np.float32)))
    if not parts:
        return np.zeros(0, int), np.zeros(0, np.int8), np.zeros((0, len(KINDS)), np.float32)
    start, size, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    return start, size, score


def with_base(tokens: Tokens, start: np.ndarray, size: np.ndarray, score: np.ndarray, base: list[list[tuple[int, int, int]]]):
    """Candidates in which the base spans (start, kind, end) of each zone are fixed.

    A base span of whole tokens is a candidate that cannot be passed over; candidates that share a token with any base
    span are no candidates. Of base spans that overlap one another, or are longer than an entity, none is fixed.
    """
    taken = np.zeros(len(tokens.text) + 1, bool)
    fixed = []
    for z, spans in enumerate(base):
        low, high = tokens.bounds[z], tokens.bounds[z + 1]
        for k, (a, kind, b) in enumerate(spans):
            first, last = low + np.searchsorted(tokens.end[low:high], a, "right"), low + np.searchsorted(tokens.start[low:high], b, "left")
            taken[first:last] = True
            alone = (k == 0 or max(e for _, _, e in spans[:k]) <= a) and (k + 1 == len(spans) or spans[k + 1][0] >= b)
            if alone and first < last <= first + MOST_TOKENS and tokens.start[first] == a and tokens.end[last - 1] == b:
                fixed.append((first, last - first, kind))
    before = np.concatenate([[0], np.cumsum(taken)])
    free = before[np.minimum(start + size, len(before) - 1)] == before[start]
    start, size, score = start[free], size[free], score[free]
    if fixed:
        first, n, kind = (np.array(x) for x in zip(*fixed, strict=True))
        own = np.full((len(fixed), len(KINDS)), -np.inf, np.float32)
        own[np.arange(len(fixed)), kind] = FIXED
        start, size, score = np.concatenate([start, first]), np.concatenate([size, n.astype(np.int8)]), np.concatenate([score, own])
    return start, size, score


def lattice(tokens: Tokens, start: np.ndarray, size: np.ndarray, chosen: np.ndarray):
    """Places of segments side by side: zone rows and in-zone first tokens of the chosen zones."""
    row = np.full(len(tokens.bounds) - 1, -1)
    row[chosen] = np.arange(len(chosen))
    zone = tokens.zone[start] if len(start) else np.zeros(0, int)
    kept = np.flatnonzero(row[zone] >= 0)
    return kept, row[zone[kept]], start[kept] - tokens.bounds[zone[kept]], size[kept]


def _dense(shape, row, first, size, scores, kind=np.float64):
    dense = np.full((*shape, MOST_TOKENS, len(KINDS)), -np.inf, kind)
    dense[row, first, size - 1] = scores
    return dense


def decode(tokens: Tokens, start: np.ndarray, size: np.ndarray, score: np.ndarray, after: np.ndarray, cells: int = 60_000) -> list[tuple[int, int, int, int]]:
    """(zone, first token, last token, kind) of the entities of the best segmentation of each zone."""
    n, found, labels = np.diff(tokens.bounds), [], len(KINDS) + 1
    has = np.zeros(len(n), bool)
    has[tokens.zone[start]] = True
    order = [z for z in np.argsort(n, kind="stable").tolist() if has[z]]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * n[order[end]] <= cells // MOST_TOKENS:
            end += 1
        chosen = np.array(order[at:end])
        at = end
        kept, row, first, length = lattice(tokens, start, size, chosen)
        steps = int(n[chosen].max())
        dense = _dense((len(chosen), steps), row, first, length, score[kept], np.float32)
        value = np.full((len(chosen), steps + 1, labels), -np.inf)  # of the best segmentation by the last segment's kind
        value[:, 0, OTHER] = 0
        entry = np.full((len(chosen), steps + 1, labels), -np.inf)  # of the best one before a segment of a kind
        came = np.zeros((len(chosen), steps + 1, labels), np.int8)  # the kind before
        span = np.ones((len(chosen), steps + 1, labels), np.int8)  # the segment's length
        for t in range(steps + 1):
            if t:
                value[:, t, OTHER] = entry[:, t - 1, OTHER]  # a single other token scores 0
                s = np.arange(1, min(t, MOST_TOKENS) + 1)
                own = entry[:, t - s, :OTHER] + dense[:, t - s, s - 1]
                best = own.argmax(axis=1)
                value[:, t, :OTHER] = np.take_along_axis(own, best[:, None], axis=1)[:, 0]
                span[:, t, :OTHER] = best + 1
            both = value[:, t, :, None] + after
            came[:, t] = both.argmax(axis=1)
            entry[:, t] = both.max(axis=1)
        for k, z in enumerate(chosen.tolist()):
            t = int(n[z])
            label = int(value[k, t].argmax())
            while t > 0:
                s = int(span[k, t, label])
                if label != OTHER:
                    found.append((z, int(tokens.bounds[z] + t - s), int(tokens.bounds[z] + t - 1), label))
                t -= s
                label = int(came[k, t, label])
    return found


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = np.maximum(x.max(axis=axis, keepdims=True), -1e30)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - most).sum(axis=axis, keepdims=True)) + most).squeeze(axis)


def expected(dense: np.ndarray, n: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By forward and backward sums: the log-partition of each zone, what stands before and behind each place by kind (in
    logarithms; a segment's log-probability is its score and both, less the partition), and the expected number of
    times that each kind follows each."""
    (count, steps), kind = dense.shape[:2], dense.dtype
    rows, labels, after = np.arange(count), len(KINDS) + 1, after.astype(kind)
    value = np.full((count, steps + 1, labels), -np.inf, kind)
    value[:, 0, OTHER] = 0
    entry = np.full((count, steps + 1, labels), -np.inf, kind)
    for t in range(steps + 1):
        if t:
            value[:, t, OTHER] = entry[:, t - 1, OTHER]
            s = np.arange(1, min(t, MOST_TOKENS) + 1)
            value[:, t, :OTHER] = log_sum(entry[:, t - s, :OTHER] + dense[:, t - s, s - 1], 1)
        entry[:, t] = log_sum(value[:, t, :, None] + after, 1)
    rest = np.full((count, steps + 1, labels), -np.inf, kind)  # of what follows the place, by the last segment's kind
    rest[rows, n] = 0
    ahead = np.full((count, steps, labels), -np.inf, kind)  # of a segment of a kind from the place on, and what follows
    for t in range(steps - 1, -1, -1):
        inside = (t < n)[:, None]
        s = np.arange(1, min(steps - t, MOST_TOKENS) + 1)
        own = np.concatenate([log_sum(dense[:, t, s - 1] + rest[:, t + s, :OTHER], 1), rest[:, t + 1, OTHER:]], axis=1)
        ahead[:, t] = np.where(inside, own, -np.inf)
        rest[:, t] = np.where(inside, log_sum(after[None] + own[:, None, :], 2), rest[:, t])
    total = log_sum(value[rows, n], 1)
    follows = np.exp(value[:, :steps, :, None] + after + ahead[:, :, None, :] - total[:, None, None, None])
    return total, entry[:, :, :OTHER], rest[:, :, :OTHER], follows.sum(axis=(0, 1), dtype=np.float64)


def segment_probabilities(row, first, length, scores, n, after, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Of each candidate and kind, zones of about the same length side by side; and the expected successions."""
    p, follows = np.empty(scores.shape), np.zeros_like(after)
    order = np.argsort(n, kind="stable")
    for zones_of in np.array_split(order, min(8, len(order))):
        place = np.full(len(n), -1)
        place[zones_of] = np.arange(len(zones_of))
        own = np.flatnonzero(place[row] >= 0)
        at, i, j = place[row[own]], first[own], first[own] + length[own]
        dense = _dense((len(zones_of), int(n[zones_of].max())), at, i, length[own], scores[own], kind)
        total, before, behind, f = expected(dense, n[zones_of], after)
        p[own] = np.exp(scores[own] + before[at, i] + behind[at, j] - total[at, None])
        follows += f
    return p, follows


def rewritten(text: str, gold: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A training text in which the gold spans have other forms, or are numbers that are none."""
    out, spans, at = [], [], 0
    size = 0

    def put(s):
        nonlocal size
        out.append(s)
        size += len(s)

    for a, kind, b in gold:
        if a < at:
            continue
        put(text[at:a])
        own, at, pick = text[a:b], b, rng.integers(4)
        if pick == 0:
            new, kind = ["".join(rng.choice(list("0123456789"), rng.integers(12, 17))), "2024-%02d-%02d" % (rng.integers(1, 13), rng.integers(1, 29)), "%d.%d.%d" % tuple(rng.integers(0, 90, 3)), "%d" % rng.integers(1000, 10**7)][rng.integers(4)], -1
            if len(new) >= 12 and "-" not in new and luhn(new):
                kind = 2
        elif kind == 0 and pick <= 2:
            new = own.replace("@", [" at ", " [at] ", " (at) "][rng.integers(3)]).replace(".", [" dot ", " dot "][rng.integers(2)])
        elif kind == 3 and pick <= 2:
            d = "".join(rng.choice(list("23456789"), 10))
            new = [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}"][rng.integers(2)]
            if rng.integers(2):
                put(["call ", "phone ", "tel "][rng.integers(3)])
        else:
            new = own
        if kind >= 0:
            spans.append((size, kind, size + len(new)))
        put(new)
    put(text[at:])
    return "".join(out), spans


def chosen_zones(texts: list[str]) -> list[str]:
    """At most TRAIN_ZONES zones, of all texts and a few of each, that a hash chooses; the same for any order of texts."""
    return first_by_hash([z for text in texts for z in first_by_hash([text[a : min(b, a + ZONE_OF_TEXT)] for a, b in zones(text)], ZONES_OF_TEXT)], TRAIN_ZONES)


def first_by_hash(found: list[str], most: int) -> list[str]:
    return sorted(found, key=lambda piece: hashlib.blake2b(piece.encode("utf-8", "replace")).digest())[:most]


def examples(zones_: list[str], seed: int = 3) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Zones with their base spans, each as it is and rewritten."""
    rng, pieces, golds = np.random.default_rng(seed), [], []
    for piece in zones_:
        gold = base_spans(piece)
        for new, spans in ((piece, gold), rewritten(piece, gold, rng)):
            pieces.append(new)
            golds.append(spans)
    return pieces, golds


def fit(zones_: list[str], seed: int = 3) -> Field:
    """A field learned from zones of texts; the blank one where there are none."""
    field = Field.blank()
    pieces, golds = examples(zones_, seed)
    tokens = Tokens.of(pieces)
    start, size, features = segments(tokens)
    if not len(start):
        return field
    by_place = {(int(tokens.zone[i]), int(tokens.start[i]), int(tokens.end[i + s - 1])): k for k, (i, s) in enumerate(zip(start.tolist(), size.tolist(), strict=True))}
    observed, follows = np.zeros_like(field.features), np.zeros_like(field.after)
    for z, spans in enumerate(golds):
        at, last, end = int(tokens.bounds[z]), OTHER, int(tokens.bounds[z + 1])
        for a, kind, b in sorted(spans, key=lambda x: (x[0], -x[2])):
            k = by_place.get((z, a, b))
            if k is None or start[k] < at:
                continue
            observed[kind] += features[k]
            others = int(start[k]) - at
            if others:
                follows[last, OTHER] += 1
                follows[OTHER, OTHER] += others - 1
                last = OTHER
            follows[last, kind] += 1
            last, at = kind, int(start[k] + size[k])
        if at < end:
            follows[last, OTHER] += 1
            follows[OTHER, OTHER] += end - at - 1
    n = np.diff(tokens.bounds)
    chosen = np.flatnonzero(n)
    kept, row, first, length = lattice(tokens, start, size, chosen)
    f = features[kept].astype(np.float64)
    shape, cut = field.features.shape, field.features.size
    flat = np.concatenate([field.features.ravel(), field.after.ravel()])
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, STEPS + 1):
        weights, after = flat[:cut].reshape(shape), flat[cut:].reshape(field.after.shape)
        p, expected_follows = segment_probabilities(row, first, length, f @ weights.T, n[chosen], after, np.float32)
        g = np.concatenate([(p.T @ f - observed).ravel(), (expected_follows - follows).ravel()]) + 0.05 * flat
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        flat = flat - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(flat[:cut].reshape(shape), flat[cut:].reshape(field.after.shape))


def quality(texts: list[str], field: Field, seed: int = 5) -> tuple[int, int, int]:
    """Right, found and wanted added spans on rewritten zones of texts: of the entities that no base pattern finds."""
    pieces, golds = examples(chosen_zones(texts), seed)
    right = found = wanted = 0
    got = scan_batch(pieces, field, np.ones(len(pieces), bool))
    for k, gold in enumerate(golds):
        base = set(base_spans(pieces[k]))
        want = set(gold) - base
        own = {(a, kind, b) for a, kind, b, is_base in got.get(k, ()) if not is_base}
        right, found, wanted = right + len(want & own), found + len(own), wanted + len(want)
    return right, found, wanted


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on zones of at most SAMPLE documents with an @ or a long number, of ten times as many that a hash of the id chooses.

    Tasks cut the zones out, a few short ones of each text, so texts neither are sorted nor come to the driver, which sees a
    bounded number of bytes at any size.
    """
    own = ids_and_texts(docs, id_col, text_col)
    share = min(1.0, 10 * SAMPLE / max(1, own.count()))
    chosen = own.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).where(F.col("text").rlike(r"@|[0-9]{3}"))
    chosen = chosen.withColumns({"order": F.xxhash64(F.lit("sample"), "id"), "of_text": F.xxhash64("text")})

    def cut_out(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [chosen_zones([t]) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("order"), part.column("of_text"), pa.array(found, pa.list_(pa.string()))], ["order", "of_text", "zones"])

    rows = map_texts(chosen.select("order", "of_text", "text"), cut_out, T.StructType.fromDDL("order long, of_text long, zones array<string>"))
    return fit(first_by_hash([z for r in rows.orderBy("order", "of_text").limit(SAMPLE).collect() for z in r["zones"]], TRAIN_ZONES))


def scan_batch(texts: list[str | None], field: Field, wanted: np.ndarray) -> dict[int, list[tuple[int, int, int, bool]]]:
    """By text: (start, kind number, end, whether a base span), in order; only texts that are wanted are looked at."""
    found, pieces, place, fixed = {}, [], [], []
    for i in np.flatnonzero(wanted).tolist():
        text = texts[i]
        base = base_spans(text)
        if base:
            found[i] = [(a, k, b, True) for a, k, b in base]
        starts = [a for a, _, _ in base]
        longest = max((b - a for a, _, b in base), default=0)
        for a, b in zones(text):
            pieces.append(text[a:b])
            place.append((i, a))
            near = base[bisect_left(starts, a - longest) : bisect_left(starts, b)]
            fixed.append([(x - a, k, y - a) for x, k, y in near if y > a])
    ahead_of = np.cumsum([0, *map(len, pieces)])
    at = 0
    while at < len(pieces):
        end = max(at + 1, int(np.searchsorted(ahead_of, ahead_of[at] + ZONE_CHARS, "right")) - 1)
        tokens = Tokens.of(pieces[at:end])
        for z, first, last, kind in decode(tokens, *with_base(tokens, *scored(tokens, field.features), fixed[at:end]), field.after):
            i, ahead = place[at + z]
            a, b = int(ahead + tokens.start[first]), int(ahead + tokens.end[last])
            if (a - ahead, kind, b - ahead) not in fixed[at + z]:
                found.setdefault(i, []).append((a, kind, b, False))
        at = end
    return {i: sorted(x) for i, x in found.items()}


SCHEMA_SPAN = T.StructType([*sp.SPAN.fields, T.StructField("base", T.BooleanType())])


def find_personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and spans, an array of (kind, start, end, base) in code points, by start, then kind.

    Base spans of different kinds may overlap; those of the field overlap nothing. A null or empty text has no spans.
    Repeated rows repeat; an empty table gives an empty one; further columns are ignored.
    """
    schema = T.StructType([id_field(docs, id_col, "doc_id"), T.StructField("spans", T.ArrayType(SCHEMA_SPAN))])
    anchor = np.zeros(256, bool)
    anchor[48:58] = anchor[64] = True

    def scan(part: pa.RecordBatch) -> pa.RecordBatch:
        one_blas_thread()
        data, offsets = utf8(part.column("text"))
        texts = part.column("text").to_pylist()
        wanted = np.zeros(len(texts), bool)
        wanted[np.searchsorted(offsets, np.flatnonzero(anchor[data]), "right") - 1] = True
        for i in np.flatnonzero(~wanted).tolist():
            wanted[i] = bool(texts[i]) and _ANCHOR.search(texts[i]) is not None
        rows = [[] for _ in texts]
        for i, own in scan_batch(texts, field, wanted).items():
            rows[i] = [{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in own]
        spans = pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))
        return pa.RecordBatch.from_arrays([part.column("id"), spans], ["doc_id", "spans"])

    return map_texts(ids_and_texts(docs, id_col, text_col), scan, schema)


def op4_pii_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, train(docs))
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *(sp.count_of(base, k).alias(f"n_{k}") for k in KINDS), F.sha2(sp.joined(base), 256).alias("base_sha256"), sp.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
