"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads each text in segments of ``SEGMENT`` bytes, one direction from each end, labels every byte with
a distribution over languages, and a text's distribution is the mean over all its bytes. It is trained in numpy by
backpropagation through time, on a bounded sample: about ``SAMPLE`` texts of each language, chosen by a hash of
the id over the whole table, ``SPANS`` spans of each at hashed places. Prediction reads every byte of every text.
Every label that occurs is learned. State begins anew with every segment.

Arrays hold features by rows and segments by columns, so that one step of thousands of segments is one product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import carried, chunks, with_carried

SEGMENT = 64
HIDDEN = 8
SAMPLE = 500
SPANS = 3
#: Counts of so many labels are sent to every task, those of more are joined by a shuffle.
BROADCAST_LABELS = 10_000
STEPS = 260
BATCH = 128
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
_LANES = 2048
_WORDLIKE = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Weights by name, for the languages in order."""

    langs: list[str]
    w: dict[str, np.ndarray]


def start(langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
    w: dict[str, np.ndarray] = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.3, (3 * hidden, 256))
        w[f"u{d}"] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden))
        w[f"c{d}"] = np.zeros((hidden, 1))
    w["o"], w["q"] = rng.normal(0, 0.3, (len(langs), 2 * hidden)), np.zeros((len(langs), 1))
    return Network(langs, {k: v.astype(np.float32) for k, v in w.items()})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gradients(net: Network, seq: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over all positions of ``seq`` (steps x segments) and its gradient, back through time in both directions."""
    w, (steps, lanes) = net.w, seq.shape
    hidden = w["uf"].shape[1]
    tape: dict[str, list] = {"f": [], "b": []}
    states = np.zeros((steps, 2 * hidden, lanes), np.float32)
    for k, d in enumerate("fb"):
        h = np.zeros((hidden, lanes), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, a = w[f"x{d}"][:, seq[t]], w[f"u{d}"] @ h
            r, z = _sigmoid(x[:hidden] + a[:hidden]), _sigmoid(x[hidden : 2 * hidden] + a[hidden : 2 * hidden])
            inner = a[2 * hidden :] + w[f"c{d}"]
            n = np.tanh(x[2 * hidden :] + r * inner)
            tape[d].append((t, h, r, z, inner, n))
            h = n + z * (h - n)
            states[t, k * hidden : (k + 1) * hidden] = h
    logit = w["o"] @ states + w["q"]
    logit -= logit.max(axis=1, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(axis=1, keepdims=True)
    lane = np.arange(lanes)
    loss = -np.log(p[:, label, lane] + 1e-9).mean()
    p[:, label, lane] -= 1
    p /= steps * lanes
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["o"] = np.einsum("tcn,thn->ch", p, states)
    g["q"] = p.sum(axis=(0, 2))[:, None]
    back = w["o"].T @ p
    for k, d in enumerate("fb"):
        dh = np.zeros((hidden, lanes), np.float32)
        flat_x, flat_t = [], []
        for t, h, r, z, inner, n in reversed(tape[d]):
            dh = dh + back[t, k * hidden : (k + 1) * hidden]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            da = np.concatenate([dr, dz, dn * r])
            g[f"u{d}"] += da @ h.T
            g[f"c{d}"] += da[2 * hidden :].sum(axis=1, keepdims=True)
            flat_x.append(np.concatenate([dr, dz, dn]))
            flat_t.append(seq[t])
            dh = dh * z + w[f"u{d}"].T @ da
        where, what = np.concatenate(flat_t), np.concatenate(flat_x, axis=1)
        for row in range(3 * hidden):
            g[f"x{d}"][row] = np.bincount(where, what[row], 256)
    return float(loss), g


def train(spans: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Network | None:
    """A network for the languages of the spans, which are cut or filled with blanks to one segment each; None without spans."""
    spans = sorted(s for s in spans if s[0] is not None and s[1])
    if not spans:
        return None
    langs = sorted({lang for lang, _ in spans})
    number = {lang: k for k, lang in enumerate(langs)}
    label = np.array([number[lang] for lang, _ in spans])
    data = np.stack([np.frombuffer(s[:SEGMENT].ljust(SEGMENT), np.uint8) for _, s in spans])
    rng = np.random.default_rng(seed)
    net = start(langs, hidden, rng)
    one, two = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    of = [np.flatnonzero(label == k) for k in range(len(langs))]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, -(-BATCH // len(langs))) for rows in of])
        _, g = gradients(net, np.ascontiguousarray(data[pick].T), label[pick])
        rate = 0.03 * min(1, 2 * (1 - step / (steps + 1)))
        norm = max(1.0, float(np.sqrt(sum((v * v).sum() for v in g.values()))))
        for k, v in g.items():
            v = v / norm
            one[k] += 0.1 * (v - one[k])
            two[k] += 0.01 * (v * v - two[k])
            net.w[k] -= (rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


class Reader:
    """Forward passes over many segments; the halves of the logistic gates are folded into the weights."""

    def __init__(self, net: Network) -> None:
        self.net, self.hidden = net, net.w["uf"].shape[1]
        half = np.ones((3 * self.hidden, 1), np.float32)
        half[: 2 * self.hidden] = 0.5
        self.x = {d: np.ascontiguousarray(net.w[f"x{d}"] * half) for d in "fb"}
        self.u = {d: np.ascontiguousarray(net.w[f"u{d}"] * half) for d in "fb"}

    def positions(self, seq: np.ndarray) -> np.ndarray:
        """Steps x languages x segments: the distribution at every byte of ``seq`` (steps x segments)."""
        (steps, lanes), hidden, w = seq.shape, self.hidden, self.net.w
        states = np.empty((steps, 2 * hidden, lanes), np.float32)
        x, a, m = np.empty((3 * hidden, lanes), np.float32), np.empty((3 * hidden, lanes), np.float32), np.empty((hidden, lanes), np.float32)
        for k, d in enumerate("fb"):
            h = np.zeros((hidden, lanes), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.take(self.x[d], seq[t], axis=1, out=x, mode="clip")
                np.matmul(self.u[d], h, out=a)
                gate = x[: 2 * hidden]
                gate += a[: 2 * hidden]
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
                inner = a[2 * hidden :]
                inner += w[f"c{d}"]
                inner *= gate[:hidden]
                inner += x[2 * hidden :]
                np.tanh(inner, out=inner)
                np.subtract(h, inner, out=m)
                m *= gate[hidden:]
                h = states[t, k * hidden : (k + 1) * hidden]
                np.add(inner, m, out=h)
        p = np.matmul(w["o"], states)
        p += w["q"]
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def pool(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows x languages: the mean distribution over all bytes of each row; an empty row has zeros."""
        size = np.diff(bounds)
        many = -(-size // SEGMENT)
        row = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        last = nth == many[row] - 1
        # the last segment of a long row ends with it: bytes it shares with the one before count there only
        at = bounds[row] + np.where(last & (size[row] > SEGMENT), size[row] - SEGMENT, nth * SEGMENT)
        skip = np.where(last, np.maximum(nth * SEGMENT - np.maximum(size[row] - SEGMENT, 0), 0), 0)
        upto = np.minimum(size[row], SEGMENT)
        out = np.zeros((len(size), len(self.net.langs)))
        padded = np.concatenate([data, np.full(SEGMENT, 32, np.uint8)])
        step = np.arange(SEGMENT)[:, None]
        for lo in range(0, len(row), _LANES):
            part = slice(lo, lo + _LANES)
            seq = padded[at[part] + step]
            used = (step >= skip[part]) & (step < upto[part])
            if (upto[part] < SEGMENT).any():
                seq[step >= upto[part]] = 32
            p = self.positions(seq)
            p *= used[:, None, :]
            np.add.at(out, row[part], p.sum(axis=0).T)
        return out / np.maximum(size, 1)[:, None]


def fold(id_col: str | Column, folds: int = FOLDS) -> Column:
    """CRC-32 of the id as text, modulo the number of folds; null ids count as -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))


def learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """k, t, l of the rows that may be learned from: those with a text and a language outside the held-out fold."""
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), fold(id_col).alias("f"))
    return rows.filter((F.col("f") != HELD_OUT) & F.col("l").isNotNull() & (F.length("t") > 0)).select("k", "t", "l")


def sample_spans(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> list[tuple[str, bytes]]:
    """About ``sample`` texts of each language outside the held-out fold, a few spans of each, at hashed places of the text."""
    learn = learnable(docs, id_col, text_col, lang_col)
    counts = learn.groupBy("l").agg(F.count("*").alias("n"))
    room = F.greatest(F.length("t") - SEGMENT, F.lit(0)) + 1
    spots = [F.substring(F.col("t"), (F.pmod(F.xxhash64("k", F.lit(i)), room) + 1).cast("int"), F.lit(SEGMENT)) for i in range(SPANS)]
    # only spans, not texts, meet the counts; a label's share of its rows is drawn before anything is collected
    drawn = learn.select("l", F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 20)).alias("draw"), F.array(*spots).alias("s"))
    few = counts.count() <= BROADCAST_LABELS
    rows = drawn.join(F.broadcast(counts) if few else counts, "l").filter(F.coalesce(F.col("draw") < F.lit(float(sample)) / F.col("n") * (1 << 20), F.lit(False))).select("l", "s").collect()
    return [(r["l"], s.encode()[:SEGMENT]) for r in rows for s in r["s"]]


def has_letter(text: str) -> bool:
    m = _WORDLIKE.search(text)
    return m is not None and (m[0].isalpha() or any(map(str.isalpha, text)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row: doc_id, held_out, lang_pred, score, and the columns to carry under ``in_`` names.

    ``und`` with score 0 for a null text, a text without a letter, or if no row has a language to learn from.
    A null id is in no fold (held_out is false, and such rows are learned from); rows with equal ids stay apart. A text
    of any length is read whole, a bounded number of segments at a time.
    """
    net = train(sample_spans(docs, id_col, text_col, lang_col, sample))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        reader = net and Reader(net)
        for batch in batches:
            langs, scores = [], []
            for low, high, data, bounds in chunks(batch.column(1)):
                known = [x is not None and has_letter(x) for x in batch.column(1).slice(low, high - low).to_pylist()]
                p = reader.pool(data, bounds) if reader else np.zeros((high - low, 1))
                best = p.argmax(axis=1)
                langs += [net.langs[b] if net and k else UNKNOWN for b, k in zip(best.tolist(), known)]
                scores += [min(1.0, float(x)) if net and k else 0.0 for x, k in zip(p[np.arange(len(p)), best], known)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *batch.columns[3:]], names=["doc_id", "held_out", "lang_pred", "score", *more])

    held = (fold(id_col) == HELD_OUT).alias("held_out")
    rows = docs.select(F.col(id_col), F.col(text_col), held, *carried(docs, carry))
    more = rows.columns[3:]
    return rows.mapInArrow(run, with_carried("doc_id long, held_out boolean, lang_pred string, score double", rows, more))
