"""Secret scan: fixed patterns, and a battery of randomness tests on every long token.

Base spans are the leftmost non-overlapping matches of each kind that pass its length check:
``assign`` (the whole assignment, value of 8 or more), ``access`` (16 or more), ``hex`` (32 or more).

Other tokens come from runs of at least ``MIN_RUN`` characters of the base64 alphabets and ``=``. A run
is cut at every ``=`` but its last ones, which may be padding. A piece of at least ``MIN_RUN`` characters
is a token, and so are its parts that long between ``/``, between ``-`` and ``_``, and between all three,
since a secret may be joined to a path or a name. Where discoveries overlap, the longest stays. The encoding is the smallest alphabet that holds a token: hex, base32, base36, base64 or base64url; words in one case
have none and are no candidates. Each candidate takes three tests:

* chi-squared uniformity over the alphabet, through the count of equal symbols;
* runs of character classes (lower, upper, digit, other) along the token;
* serial correlation of neighbouring alphabet places.

A random string must not fail any of them (``VETO``). For the discovery each is turned round and set
against ordinary text: how likely a word or identifier is to look as even, as restless and as little
correlated as the token does. Evenness is the likelihood ratio of the alphabet against letters as text
uses them (``LETTERS``), among vowels and among consonants; restlessness that of its class changes and of
its steps between vowels and consonants (``CHANGE``, ``STEPS``). Ratios multiply, and the inverse of their
product bounds the p-value at any length and for any alphabet. Correlation is compared with that of
text whose classes change so rarely, and Fisher's method adds it. The candidates of one document are one
family, and the Benjamini-Hochberg procedure at ``RATE`` picks the discoveries, with p-values weighted by
token length (longer tokens have more power; the weights of a family average one). They become spans of
kind ``random`` unless they touch a base span.

Defined results: a null text is empty and has no spans; positions are code points, ends exclusive;
rows are independent; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from swellcast.llm import common

KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 20
RATE = 0.02
VETO = 1e-4
CHANGE = 0.25
#: Shares of the letters a to z in English text, in per cent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.15, 2.0, 0.07)
#: Part of a text's letters and steps that follows no such rule (names, abbreviations, other languages).
ODD = 0.05
#: How far the correlation of single identifiers lies from that of text at large (camel case has little).
SPREAD = 0.3
#: In text, the share of vowels after a consonant and after a vowel.
STEPS = (0.55, 0.17)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_KEY = re.compile(r"passw|secret|token|api_?key", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_ALPHABETS = (
    ("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789"), ("base36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_PLACES = [(name, {c: i for i, c in enumerate(chars)}) for name, chars in _ALPHABETS]
_RUN_CHARS = np.zeros(128, bool)
_RUN_CHARS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _KEY.search(text):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    return out


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


_VOWELS = "aeiou"
_OF_SORT = {v: sum(x for i, x in enumerate(LETTERS) if (chr(97 + i) in _VOWELS) == v) for v in (False, True)}
#: Share of each letter among the vowels or consonants of text.
_IN_TEXT = {chr(97 + i): (1 - ODD) * v / _OF_SORT[chr(97 + i) in _VOWELS] + ODD / (5 if chr(97 + i) in _VOWELS else 21)
            for i, v in enumerate(LETTERS)}


def _sort(c: str) -> tuple[int, bool]:
    return _kind(c), c.lower() in _VOWELS


def _against_text(token: str, places: dict[str, int]) -> float:
    """Log likelihood ratio of a random string of the alphabet against text: letters, classes and steps."""
    k, of_kind, of_sort = len(places), Counter(map(_kind, places)), Counter(map(_sort, places))
    letter = {c: math.log(1 / of_sort[_sort(c)] / _IN_TEXT[c.lower()]) for c in places if c.isalpha()}
    total = sum(n * letter.get(c, 0.0) for c, n in Counter(token).items())
    rest = 1 - sum((v / k) ** 2 for v in of_kind.values())
    for (a, b), n in Counter(zip(token, token[1:], strict=False)).items():
        kind = _kind(b)
        if rest > 0:
            # Text keeps its class, or goes to another one by its size.
            stay = _kind(a) == kind
            other = of_kind[kind] / max(k - of_kind[_kind(a)], 1)
            total += n * math.log(of_kind[kind] / k / (1 - CHANGE if stay else CHANGE * other))
        if a.isalpha() and b.isalpha():
            vowel = b.lower() in _VOWELS
            random = of_sort[kind, True] / of_kind[kind]
            text = (1 - ODD) * STEPS[a.lower() in _VOWELS] + ODD * random
            total += n * math.log((random if vowel else 1 - random) / (text if vowel else 1 - text))
    return total


def infer(token: str) -> tuple[str, dict[str, int]] | None:
    """The encoding of a token and the places of its alphabet; none for words in one case."""
    if not any(c.isdigit() for c in token):
        letters = [c for c in token if c.isalpha()]
        inner = sum(a.islower() != b.islower() for a, b in zip(letters[1:], letters[2:], strict=False))
        if inner < 2:
            return None
    used = set(token)
    return next(((name, places) for name, places in _PLACES if used <= places.keys()), None)


def discovery_p(token: str) -> float | None:
    """P-value of the token against ordinary text; None where it has no encoding or fails a randomness test."""
    token = token.rstrip("=")
    n, found = len(token), infer(token)
    if found is None or n < MIN_RUN:
        return None
    _, places = found
    k = len(places)
    equal = sum(v * (v - 1) for v in Counter(token).values())
    # Chi-squared = k / n * sum of squared counts - n, so its tests are tests of the equal pairs.
    pairs = n * (n - 1)
    uniform_sd = math.sqrt(2 * pairs * (1 / k) * (1 - 1 / k))
    if 1 - _normal((equal - pairs / k) / uniform_sd) < VETO:
        return None
    kinds = [_kind(c) for c in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    share = Counter(_kind(c) for c in places)
    expect = 1 - sum((v / k) ** 2 for v in share.values())
    runs_sd = math.sqrt((n - 1) * expect * (1 - expect)) or 1.0
    if 2 * _normal(-abs(changes - (n - 1) * expect) / runs_sd) < VETO:
        return None
    at = np.array([places[c] for c in token], float)
    at -= at.mean()
    spread = float(at @ at)
    serial = float(at[:-1] @ at[1:]) / spread if spread else 1.0
    if 2 * _normal(-abs(serial + 1 / n) * math.sqrt(n)) < VETO:
        return None
    p_text = math.exp(-max(0.0, min(_against_text(token, places), 690.0)))
    # Classes that change at the rate CHANGE keep this share of the correlation between neighbours.
    between = sum(((sum(x for c, x in places.items() if _kind(c) == g) / v - (k - 1) / 2) ** 2) * v / k for g, v in share.items())
    kept = (1 - CHANGE / expect) * between / ((k * k - 1) / 12) if expect > CHANGE else 0.0
    p_serial = _normal((serial - kept) / math.sqrt(1 / n + SPREAD * SPREAD))
    log = -math.log(p_text) - math.log(max(p_serial, 1e-300))
    return math.exp(-min(log, 690.0)) * (1 + log)


def discoveries(tokens: list[str]) -> list[int]:
    """Indexes that the length-weighted Benjamini-Hochberg procedure picks out of one family."""
    tested = [(i, p, math.log2(len(tokens[i]) / 10)) for i, p in enumerate(map(discovery_p, tokens)) if p is not None]
    if not tested:
        return []
    mean = sum(w for _, _, w in tested) / len(tested)
    ranked = sorted((p * mean / w, i) for i, p, w in tested)
    last = max((r for r, (p, _) in enumerate(ranked, 1) if p <= RATE * r / len(ranked)), default=0)
    return [i for _, i in ranked[:last]]


def long_runs(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Per text, its maximal runs of at least MIN_RUN base64 characters."""
    char = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    held = np.zeros(len(char) + 1, np.int8)
    low = char < 128
    held[:-1][low] = _RUN_CHARS[char[low]]
    edge = np.diff(np.r_[0, held])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    big = end - begin >= MIN_RUN
    begin, end = begin[big], end[big]
    starts = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]
    owner = np.searchsorted(starts, begin, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for o, a, b in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True):
        out[o].append((a - int(starts[o]), b - int(starts[o])))
    return out


_PIECE = re.compile(r"[^=]+(?:=+\Z)?")
_PARTS = tuple(map(re.compile, (r"[^/]+", r"[^_-]+", r"[^/_-]+")))


def tokens_of(run: str) -> list[tuple[int, int]]:
    """The tokens of a run: its pieces between inner ``=``, and the parts of a piece between separators."""
    out = set()
    for piece in _PIECE.finditer(run):
        a = piece.start()
        spans = [(0, len(piece[0])), *(m.span() for cut in _PARTS for m in cut.finditer(piece[0]))]
        out |= {(a + x, a + y) for x, y in spans if y - x >= MIN_RUN}
    return sorted(out)


def spans_of(text: str, runs: list[tuple[int, int]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and the added ones of one text."""
    base = base_spans(text)
    # Every hex match of 32 or more lies in a long run, so only those are searched.
    base += [(a + m.start(), a + m.end(), "hex") for a, b in runs if b - a >= 32 for m in _HEX.finditer(text[a:b])]
    free = [(a + x, a + y) for a, b in runs for x, y in tokens_of(text[a:b])]
    held = sorted(base)
    # Base spans of different kinds may overlap: the end is the furthest one so far.
    begins, ends = [x for x, *_ in held], list(itertools.accumulate((y for _, y, _ in held), max))
    free = [(a, b) for a, b in free if not (i := bisect.bisect_left(begins, b)) or ends[i - 1] <= a]
    found = sorted((free[i] for i in discoveries([text[a:b] for a, b in free])), key=lambda s: (s[0] - s[1], s))
    taken: list[tuple[int, int]] = []
    for a, b in found:
        i = bisect.bisect_left(taken, (a, b))
        if (not i or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
            taken.insert(i, (a, b))
    return base, [(a, b, "random") for a, b in taken]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.slices(batches):
            found = [spans_of(t, r) for t, r in zip(texts, long_runs(texts), strict=True)]
            counts = [Counter(k for *_, k in base) for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS[:3]),
                 pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([joined(base + more) for base, more in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return common.id_text(docs).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
