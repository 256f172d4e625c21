"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans are the leftmost non-overlapping matches of each kind that pass its check. They are also
the labels: at most ``MAX_TRAIN_DOCS`` documents with an anchor (see below), chosen by a hash of their
id, are cut into windows, in one task of its own. At most ``MAX_TRAIN_WINDOWS`` windows are taken, in rounds: every document
gives one window a round, first those with a span, then by a hash of the window. On them a small network is trained in numpy (embedding,
forward and backward LSTM, CRF with learned transitions, by minibatch gradient descent). Half of the
training windows are altered: the plus of a phone number goes, separators change, an at sign is spelled
out, the label staying, so that the model learns the shape and surroundings and not the one character.

For tagging, every text is cut into windows of ``WIDTH`` characters, ``STRIDE`` apart, over its whole
length. Every span that may be added holds an anchor: a digit, an at sign, or `` at `` before a dotted
name. So windows that hold a part of an anchor are decoded by Viterbi, with the windows beside them, and
from there on as far as tags go: the spans are those of decoding every window. Where windows overlap, a character takes the tag of the window in which it
lies most centrally, and spans are read from the reconciled tags of the whole text, so a span may be
longer than a window. A span is added if it passes its kind's plausibility check and touches no base
span. The model has a fixed size (about 10,000 floats).

Defined results: a null text is empty and has no spans; positions are code points, ends exclusive;
without any base span in the training documents the model adds nothing; rows are independent; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellcast.llm import common

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
WIDTH, STRIDE = 64, 32
EMBED, HIDDEN = 12, 16
SYMBOLS = 160
MAX_TRAIN_DOCS = 1_500
MAX_TRAIN_WINDOWS = 4_000
EPOCHS, BATCH, RATE = 4, 32, 0.02
#: Viterbi score that a window's best tagging must have over the untagged one.
MARGIN = 2.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match ends where its last run of digits ends, so no later one starts inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What every span that the model may add holds, by ``plausible``.
_ANCHOR = re.compile(r"[0-9@]|\x20at\x20(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\x20at\x20[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        match = _DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            out.append((begin, match.end()))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    return out


def _octets(text: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in text.split(".")]
    return all(len(p) < 4 and int(p) < 256 for p in parts)


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if _octets(m[0])]
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def plausible(kind: str, text: str) -> bool:
    """Checks on a span that the model proposes."""
    digits = _digits(text)
    if kind == "email":
        return len(text) >= 6 and ("@" in text and "." in text or bool(_SPELLED.fullmatch(text)))
    if kind == "ip":
        return bool(_IP.fullmatch(text)) and _octets(text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


# -- network ----------------------------------------------------------------------------------------
def symbols(text: str) -> np.ndarray:
    """ASCII by itself; other characters fall into hashed places above."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(code < 128, code, 128 + code % (SYMBOLS - 128 - 1))


PAD = SYMBOLS - 1


def new_model(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
    model = {"embed": scale(SYMBOLS, EMBED) * 4, "out": scale(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32),
             "trans": np.zeros((TAGS, TAGS), np.float32)}
    for side in "fb":
        model |= {f"x{side}": scale(EMBED, 4 * HIDDEN), f"h{side}": scale(HIDDEN, 4 * HIDDEN),
                  f"b{side}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)}
    return model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(model: dict, side: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """x: (time, batch, embed), already reversed for the backward side."""
    steps, batch, _ = x.shape
    inner = x @ model[f"x{side}"] + model[f"b{side}"]
    h = c = np.zeros((batch, HIDDEN), np.float32)
    out, tape = np.empty((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        z = inner[t] + h @ model[f"h{side}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, held = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        tape.append((i, f, o, g, before, held, tc))
    return out, tape


def _lstm_back(model: dict, side: str, x: np.ndarray, tape: list, grad: np.ndarray, sums: dict) -> np.ndarray:
    steps, batch, _ = x.shape
    dz_all = np.empty((steps, batch, 4 * HIDDEN), np.float32)
    dh = dc = np.zeros((batch, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, held, tc = tape[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz_all[t] = dz
        sums[f"h{side}"] += held.T @ dz
        dh, dc = dz @ model[f"h{side}"].T, dc * f
    sums[f"x{side}"] += x.reshape(-1, EMBED).T @ dz_all.reshape(-1, 4 * HIDDEN)
    sums[f"b{side}"] += dz_all.sum((0, 1))
    return dz_all @ model[f"x{side}"].T


def emissions(model: dict, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
    """ids (batch, time) -> scores (time, batch, tags)."""
    x = model["embed"][ids.T]
    forward, tape_f = _lstm(model, "f", x)
    backward, tape_b = _lstm(model, "b", x[::-1])
    hidden = np.concatenate([forward, backward[::-1]], 2)
    return hidden @ model["out"] + model["out_b"], (x, tape_f, tape_b, hidden)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def loss_grad(model: dict, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the tag paths under the CRF, and its gradient."""
    score, (x, tape_f, tape_b, hidden) = emissions(model, ids)
    steps, batch, _ = score.shape
    trans, gold = model["trans"], gold.T
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[0] = score[0]
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + score[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(trans + (score[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _lse(alpha[-1], 1)
    grad = np.exp(alpha + beta - total[None, :, None])
    sums = {k: np.zeros_like(v) for k, v in model.items()}
    for t in range(1, steps):
        both = alpha[t - 1][:, :, None] + trans + (score[t] + beta[t])[:, None, :] - total[:, None, None]
        sums["trans"] += np.exp(both).sum(0)
    rows = np.arange(batch)
    path = sum(score[t][rows, gold[t]] for t in range(steps)) + sum(trans[gold[t - 1], gold[t]] for t in range(1, steps))
    for t in range(steps):
        grad[t][rows, gold[t]] -= 1
        if t:
            np.subtract.at(sums["trans"], (gold[t - 1], gold[t]), 1)
    flat = grad.reshape(-1, TAGS)
    sums["out"] = hidden.reshape(-1, 2 * HIDDEN).T @ flat
    sums["out_b"] = flat.sum(0)
    back = grad @ model["out"].T
    dx = _lstm_back(model, "f", x, tape_f, back[:, :, :HIDDEN], sums)
    dx = dx + _lstm_back(model, "b", x[::-1], tape_b, back[::-1, :, HIDDEN:], sums)[::-1]
    np.add.at(sums["embed"], ids.T, dx)
    return float((total - path).mean()), {k: v / batch for k, v in sums.items()}


def fit_windows(ids: np.ndarray, gold: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over shuffled minibatches."""
    rng, model, step = np.random.default_rng(seed), new_model(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for begin in range(0, len(order), BATCH):
            pick = order[begin : begin + BATCH]
            _, grad = loss_grad(model, ids[pick], gold[pick])
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] = (model[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def viterbi(model: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (batch, time), and the score of each best path over the untagged path."""
    score, _ = emissions(model, ids)
    steps, batch, _ = score.shape
    best, back = score[0], np.empty((steps, batch, TAGS), np.int8)
    for t in range(1, steps):
        full = best[:, :, None] + model["trans"]
        back[t] = full.argmax(1)
        best = full.max(1) + score[t]
    tags = np.empty((batch, steps), np.int8)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t][np.arange(batch), tags[:, t]]
    plain = score[:, :, 0].sum(0) + (steps - 1) * model["trans"][0, 0]
    return tags, best.max(1) - plain


# -- training data -----------------------------------------------------------------------------------
def _altered(text: str, spans: list[tuple[int, int, str]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its spans written another way."""
    parts, out, at, size = [], [], 0, 0
    for a, b, kind in sorted(spans):
        if a < at:
            continue
        own = text[a:b]
        if kind == "phone":
            own = own.lstrip("+") if rng.random() < 0.7 else own
            own = own.translate({32: "-", 45: " "}) if rng.random() < 0.3 else own
        elif kind == "email":
            own = own.replace("@", " at ") if rng.random() < 0.4 else own
        elif kind == "card":
            own = own.translate({32: "-", 45: " "}) if rng.random() < 0.4 else own
        parts += [text[at:a], own]
        size += a - at
        out.append((size, size + len(own), kind))
        size += len(own)
        at = b
    return "".join([*parts, text[at:]]), out


def tagged(size: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        tags[a], tags[a + 1 : b] = k, k + 1
    return tags


def windows_of(size: int) -> list[int]:
    return list(range(0, max(size - WIDTH + STRIDE, 1), STRIDE))


def anchored(text: str) -> set[int]:
    """Begins of the windows that hold a part of an anchor."""
    size, out = len(text), set()
    for m in _ANCHOR.finditer(text):
        low = max(0, -(-(m.start() - WIDTH + 1) // STRIDE))
        out.update(range(low * STRIDE, m.end(), STRIDE))
    return {a for a in out if a == 0 or a < size - WIDTH + STRIDE}


def training_windows(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    made: list[tuple[str, np.ndarray]] = []
    # (rank in its text, hash, text with variant, begin)
    picks: list[tuple[int, int, int, int]] = []
    for text in texts:
        rng = np.random.default_rng([seed, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))])
        spans = base_spans(text)
        own_picks = []
        for own, marks in [(text, spans)] + ([_altered(text, spans, rng)] if spans else []):
            tags, near, v = tagged(len(own), marks), anchored(own), len(made)
            made.append((own, tags))
            for a in windows_of(len(own)):
                if a in near or rng.random() <= 0.01:
                    key = xxhash.xxh64_intdigest(own[a : a + WIDTH].encode("utf-8", "surrogatepass"), seed)
                    own_picks.append((not tags[a : a + WIDTH].any(), key, v, a))
        own_picks.sort()
        picks += [(rank, key, v, a) for rank, (_, key, v, a) in enumerate(own_picks[:MAX_TRAIN_WINDOWS])]
        if len(picks) > 4 * MAX_TRAIN_WINDOWS:
            picks = sorted(picks)[:MAX_TRAIN_WINDOWS]
    ids, gold = [], []
    for _, _, v, a in sorted(picks)[:MAX_TRAIN_WINDOWS]:
        own, tags = made[v]
        code = symbols(own[a : a + WIDTH])
        ids.append(np.pad(code, (0, WIDTH - len(code)), constant_values=PAD))
        gold.append(np.pad(tags[a : a + WIDTH], (0, WIDTH - len(code))))
    return np.array(ids, np.int64).reshape(-1, WIDTH), np.array(gold, np.int64).reshape(-1, WIDTH)


def fit(docs: DataFrame) -> bytes:
    """The pickled model, trained in one task on a bounded sample."""
    rows = common.id_text(docs)
    # The sample is chosen by ids; at most MAX_TRAIN_DOCS of them are broadcast.
    chosen = (rows.where(F.col("doc_id").isNotNull() & F.col("text").rlike(_ANCHOR.pattern)).select("doc_id").distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_DOCS))
    sample = rows.join(F.broadcast(chosen), "doc_id").repartition(1).sortWithinPartitions("doc_id", "text").select("text")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, gold = training_windows([t for frame in batches for t in frame.text])
        model = fit_windows(ids, gold) if len(ids) and gold.any() else None
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    found = sample.mapInPandas(learn, "model binary").collect()
    return bytes(found[0].model) if found else pickle.dumps(None)


# -- tagging -----------------------------------------------------------------------------------------
def model_spans(model: dict | None, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans that the model reads, per text, overlapping windows reconciled."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if model is None:
        return out
    tags_of = {d: (np.zeros(len(t), np.int8), np.full(len(t), -1, np.int16)) for d, t in enumerate(texts)}
    codes: dict[int, np.ndarray] = {}

    def decode(jobs: list[tuple[int, int]]) -> None:
        for begin in range(0, len(jobs), 512):
            part = jobs[begin : begin + 512]
            ids = np.full((len(part), WIDTH), PAD, np.int64)
            for r, (d, a) in enumerate(part):
                if d not in codes:
                    codes[d] = symbols(texts[d])
                own = codes[d][a : a + WIDTH]
                ids[r, : len(own)] = own
            tags, margin = viterbi(model, ids)
            tags[margin < MARGIN] = 0
            for (d, a), own in zip(part, tags, strict=True):
                held, centre = tags_of[d]
                stop = min(a + WIDTH, len(held))
                # Distance to the window's border; the text's own ends count as far away.
                depth = np.minimum(np.arange(WIDTH) + (WIDTH if a == 0 else 0), np.arange(WIDTH)[::-1] + (WIDTH if a + WIDTH >= len(held) else 0))[: stop - a]
                better = depth > centre[a:stop]
                held[a:stop][better], centre[a:stop][better] = own[: stop - a][better], depth[better]

    def beside(d: int, begins: set[int]) -> set[int]:
        return {a for b in begins for a in (b - STRIDE, b, b + STRIDE) if a == 0 or 0 < a < len(texts[d]) - WIDTH + STRIDE}

    done: list[set[int]] = [set() for _ in texts]
    fresh = {d: beside(d, own) for d, t in enumerate(texts) if (own := anchored(t))}
    while fresh:
        decode([(d, a) for d, own in fresh.items() for a in sorted(own)])
        for d, own in fresh.items():
            done[d] |= own
        fresh = {d: more for d, own in fresh.items()
                 if (more := beside(d, {a for a in beside(d, own) & done[d] if tags_of[d][0][a : a + WIDTH].any()}) - done[d])}
    for d, (held, _) in tags_of.items():
        if not held.any():
            continue
        kind = np.where(held > 0, (held + 1) // 2, 0)
        for at in np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]):
            if kind[at]:
                stop = at
                while stop < len(kind) and kind[stop] == kind[at]:
                    stop += 1
                own = texts[d][at:stop]
                a = int(at) + len(own) - len(own.lstrip(" .,;:!?\n"))
                b = int(stop) - (len(own) - len(own.rstrip(" .,;:!?\n")))
                name = KINDS[kind[at] - 1]
                if a < b and plausible(name, texts[d][a:b]):
                    out[d].append((a, b, name))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (KINDS.index(s[2]), s[0], s[1])))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch, texts in common.slices(batches):
            base = [base_spans(t) for t in texts]
            more = [[s for s in extra if not any(s[0] < b and a < s[1] for a, b, _ in own)]
                    for own, extra in zip(base, model_spans(model, texts), strict=True)]
            counts = [Counter(k for *_, k in own) for own in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS),
                 pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in base], pa.string()),
                 pa.array([joined(own + extra) for own, extra in zip(base, more, strict=True)], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return common.id_text(docs).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
