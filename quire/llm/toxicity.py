"""Toxicity by noisy-channel deobfuscation.

A disguised token (figures and signs for letters, letters set apart, letters repeated; see ``readings`` for the signs at
its ends) is a lattice of characters:
each sign stands for some letters, for itself or for nothing, each run of a letter for one or two of it. Viterbi
decoding finds the likeliest path under a character trigram model whose counts come from every byte of every
document. Restored words and the words as they stand are then scored.

Words are scored by what they begin with (4 to 7 bytes) and as a whole: each such feature has the share of toxic
documents among the labelled documents that hold it, learned from a bounded sample of labels (``TOXIC_SAMPLE`` and
``CLEAN_SAMPLE`` documents, chosen by a hash of the id). Equal texts count once, so that copies lend a word no support;
a feature needs ``MIN_DOCS`` distinct toxic texts, and the lower end of its share's interval asks for more, but never
for a part of all toxic documents. A document's score is the noisy-or of its words' best
features and of the rate of toxicity without any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.langid import fold
from quire.llm.text import _POWERS, BLANKS, NON_ALNUM, Words, chunks, mix

TOXIC_SAMPLE, CLEAN_SAMPLE = 4000, 8000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
MIN_DOCS = 3
#: Features of at least the first share are taken first; weaker ones are learned from the documents without any of these.
MIN_SHARES = (0.95, 0.75)
PREFIXES = (4, 5, 6, 7)
#: Characters of decoded tokens that a task keeps, besides the last token's.
_CACHE = 4_000_000
#: Signs after which the best path so far is taken even if several are left; no word has so many.
STRETCH = 4096
#: In longer tokens the signs at either end are read all as letters or all as noise.
LONG = 1024

# What a sign can stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "6": "g", "2": "z",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "aeiou",
}
SEPARATORS = ".-_*~'`^:;,/\\|+=#"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True
_LEAD_OF_TWO = np.zeros(256, bool)
_LEAD_OF_TWO[0xC2:0xE0] = True
#: Every sign that can stand for a letter.
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET]] = True
#: Runs of signs at either end of a token that are tried as letters one after the other; all of them together is tried as well.
EDGE_RUNS = 8
#: A sign that is no letter, or a letter that is repeated.
_ODD = re.compile(r"[^a-z\x80-\U0010ffff]|(.)\1", re.DOTALL)
#: 1 to 26 for a-z, 27 for bytes of other letters, 0 for all else.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27
SYMBOLS = 28


def _symbol(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else 27 if char >= "\x80" else 0


def trigrams(data: np.ndarray) -> np.ndarray:
    """Counts of the symbol triples in lower-case bytes, runs of non-letters being one."""
    s = _SYMBOL[data]
    s = np.concatenate([[0, 0], s, [0]])
    keep = np.ones(len(s), bool)
    keep[2:] = (s[2:] != 0) | (s[1:-1] != 0)
    s = s[keep]
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3) if len(s) > 2 else np.zeros(SYMBOLS**3, np.int64)


class CharacterModel:
    """Costs (negative log probabilities) of a symbol after two others, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).tolist()

    def restore(self, token: str) -> str:
        """The likeliest letters of a disguised token.

        Two letters in a row that stand for themselves leave one state, so what follows them is decided apart from what
        was before: letters are copied up to the next sign or repetition, and back pointers are kept no farther than
        to the last such place, or for ``STRETCH`` steps.
        """
        out: list[str] = []
        states, back = {(0, 0): 0.0}, []
        i = 0
        while i < len(token):
            if len(states) == 1 and not back:
                odd = _ODD.search(token, i)
                stop = odd.start() if odd else len(token)
                if stop > i:
                    out.append(token[i:stop])
                    (last,) = states
                    for c in token[max(i, stop - 2) : stop]:
                        last = (last[1], _symbol(c))
                    states, i = {last: 0.0}, stop
                    continue
            char, run = token[i], 1
            while i + run < len(token) and token[i + run] == char:
                run += 1
            states, came = self._step(states, _options(char, run))
            back.append(came)
            i += run
            if len(states) == 1 or len(back) >= STRETCH:
                best = min(states, key=lambda s: (states[s], s))
                out.append(_path(back, best))
                states, back = {best: 0.0}, []
        if back:
            out.append(_path(back, min(states, key=lambda s: (states[s] + self.cost[s[0]][s[1]][0], s))))
        return "".join(out)

    def _step(self, states: dict[tuple[int, int], float], options: list[tuple[str, float]]) -> tuple[dict, dict]:
        """The states after one sign with their least costs, and for each the state before and the letters chosen."""
        cost, after, came = self.cost, {}, {}
        for (a, b), total in states.items():
            for text, price in options:
                x, y, spent = a, b, total + price
                for c in text:
                    s = _symbol(c)
                    spent += cost[x][y][s]
                    x, y = y, s
                if (x, y) not in after or spent < after[x, y]:
                    after[x, y], came[x, y] = spent, ((a, b), text)
        return after, came


def _options(char: str, run: int) -> list[tuple[str, float]]:
    """What a run of one sign can stand for, with its price."""
    if _symbol(char):
        return [(char, 0.0)] if run == 1 else [(char, 0.4), (char * 2, 0.4)]
    letters = [(x, 1.0) for x in LEET.get(char, "")]
    return [*letters, *((x * 2, 1.2) for x, _ in letters if run > 1), ("", 0.5 if char in SEPARATORS else 9.0)]


def _path(back: list[dict], state: tuple[int, int]) -> str:
    parts = []
    for came in reversed(back):
        state, text = came[state]
        parts.append(text)
    return "".join(reversed(parts))


def disguised(words: Words) -> list[tuple[np.ndarray, str]]:
    """(first bytes, token) of blank-separated tokens that may be disguised, equal ones together, and of letters set apart by blanks."""
    low, starts, ends = words.lower, words.starts, words.ends
    if not len(starts):
        return []
    letter = _LETTER[low]
    after = np.r_[0, np.cumsum(letter)]
    # between the first and the last letter something is no letter, a sign for a letter stands before or behind them, or a letter is repeated
    other = np.r_[0, np.cumsum(~letter)]
    nth = np.flatnonzero(letter)
    has = after[ends] > after[starts]
    first = np.where(has, nth[np.minimum(after[starts], max(len(nth) - 1, 0))] if len(nth) else 0, starts)
    last = np.where(has, nth[np.maximum(after[ends] - 1, 0)] if len(nth) else 0, starts)
    mixed = other[np.maximum(last, first)] - other[first] > 0
    signs = np.r_[0, np.cumsum(_SIGN[low])]
    edge = (signs[first] > signs[starts]) | (signs[ends] > signs[last])
    again = np.zeros(len(low) + 1, np.int64)
    pair = np.zeros(len(low), np.int64)
    pair[1:] = _ASCII[low[1:]] & (low[1:] == low[:-1])
    again[1:] = np.cumsum(pair)
    repeated = again[ends] - again[np.minimum(starts + 1, len(low))] > 0
    if len(low) > 3:
        # the same for letters of two bytes
        wide = np.zeros(len(low) + 1, np.int64)
        wide[4:] = np.cumsum(_LEAD_OF_TWO[low[:-3]] & (low[:-3] == low[2:-1]) & (low[1:-2] == low[3:]))
        repeated |= (ends - starts > 3) & (wide[ends] - wide[np.minimum(starts + 3, len(low))] > 0)
    odd = np.flatnonzero((mixed | edge | repeated) & has)
    _, one, which = np.unique(words.hashes()[odd], return_index=True, return_inverse=True)
    homes = np.split(starts[odd][np.argsort(which, kind="stable")], np.cumsum(np.bincount(which, minlength=len(one)))[:-1]) if len(one) else []
    out = [(home, low[starts[i] : ends[i]].tobytes().decode("utf-8", "ignore")) for home, i in zip(homes, odd[one].tolist())]
    single = (ends - starts == 1) & (letter[starts] | _SIGN[low[starts]])
    row_start = np.zeros(len(starts) + 1, bool)
    row_start[words.rows] = True
    fresh = single & (np.r_[True, ~single[:-1]] | row_start[:-1])
    runs = np.flatnonzero(fresh)
    closing = np.flatnonzero(single & (np.r_[~single[1:], True] | row_start[1:]))
    for a, b in zip(runs.tolist(), closing.tolist()):
        if b - a >= 2:
            out.append((starts[a : a + 1], low[starts[a] : ends[b]].tobytes().decode("latin-1")))
    return out


def readings(token: str) -> list[str]:
    """The token with and without the signs before its first and behind its last letter, which may be letters or noise.

    Letters alone, none of them repeated, are no disguise and are left out.
    """
    at = [i for i, c in enumerate(token) if _symbol(c)]
    if not at:
        return [token]
    first, last = at[0], at[-1] + 1
    heads = [i for i in range(first - 1, -1, -1) if token[i] in LEET and (i == 0 or token[i - 1] != token[i])]
    tails = [i + 1 for i in range(last, len(token)) if token[i] in LEET and (i + 1 == len(token) or token[i + 1] != token[i])]
    near = 0 if len(token) > LONG else EDGE_RUNS
    found = {token[a:b]: None for a in [first, *heads[:near], *heads[near:][-1:]] for b in [last, *tails[:near], *tails[near:][-1:]]}
    return [x for x in found if not all(map(_symbol, x)) or any(c == d for c, d in zip(x, x[1:]))]


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature hash): what each word of at least three bytes begins with, and the word as a whole."""
    up, down = _POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    size, word = ends - starts, np.arange(len(starts))
    which, found = [], []
    for k in (*PREFIXES, 0):
        on = word[size > k] if k else word[size >= 3]
        stop = starts[on] + k if k else ends[on]
        which.append(on)
        found.append(mix((total[stop] - total[starts[on]]) * down[starts[on]] + np.uint64(k + 1)))
    return np.concatenate(which), np.concatenate(found).view(np.int64)


@dataclass
class Model:
    """Sorted feature hashes with their shares, the rate without features, and the character model's counts."""

    keys: np.ndarray
    share: np.ndarray
    base: float
    counts: np.ndarray
    cache: dict[str, list[str]] = field(default_factory=dict)
    held: int = 0
    lm: CharacterModel | None = None

    def restored(self, token: str) -> list[str]:
        if self.lm is None:
            self.lm = CharacterModel(self.counts)
        if token not in self.cache:
            if self.held >= _CACHE:
                self.cache.clear()
                self.held = 0
            self.cache[token] = list({self.lm.restore(x): None for x in readings(token)})
            self.held += len(token) + sum(map(len, self.cache[token]))
        return self.cache[token]

    def share_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.share[at], 0.0)

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        row, _, hashes = document_features(data, bounds, self, known_only=True)
        p = self.share_of(hashes)
        hit = p > 0
        clean = np.zeros(len(bounds) - 1)
        # the best feature of each word counts, once for each word
        order = np.lexsort((p[hit], _[hit], row[hit]))
        r, w, best = row[hit][order], _[hit][order], p[hit][order]
        top = np.r_[(r[1:] != r[:-1]) | (w[1:] != w[:-1]), True] if len(r) else np.zeros(0, bool)
        np.add.at(clean, r[top], np.log1p(-np.minimum(best[top], 0.999)))
        return 1 - (1 - self.base) * np.exp(clean)


def document_features(data: np.ndarray, bounds: np.ndarray, model: Model, known_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word number, feature hash) of the words as they stand and of restored words, of these with ``known_only`` the model's features."""
    plain = Words(data, bounds, NON_ALNUM)
    word, hashes = features(plain.lower, plain.starts, plain.ends)
    row = np.searchsorted(plain.rows, word, side="right") - 1
    odd = disguised(Words(data, bounds, BLANKS))
    if odd:
        texts, token = [], []
        for i, (_, x) in enumerate(odd):
            for text in model.restored(x):
                texts.append(text.encode())
                token.append(i)
        if texts:
            ends = np.cumsum([len(t) for t in texts])
            starts = np.r_[0, ends[:-1]]
            again, more = features(np.frombuffer(b"".join(texts), np.uint8), starts, ends)
            if known_only:
                on = model.share_of(more) > 0
                again, more = again[on], more[on]
            # each feature of a token for each place of the token; readings of one token are one word
            at = np.asarray(token)[again]
            places = np.array([len(h) for h, _ in odd])
            begin = np.cumsum(places) - places
            many = places[at]
            spread = np.repeat(np.arange(len(at)), many)
            nth = begin[at][spread] + np.arange(len(spread)) - np.repeat(np.cumsum(many) - many, many)
            home = np.searchsorted(bounds, np.concatenate([h for h, _ in odd]), side="right") - 1
            word = np.concatenate([word, nth + len(plain.starts)])
            row, hashes = np.concatenate([row, home[nth]]), np.concatenate([hashes, more[spread]])
    return row, word, hashes


def character_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Symbol trigram counts over all bytes of all documents; tasks send their own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                total += trigrams(Words(data, bounds, BLANKS).lower)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    out = np.zeros(SYMBOLS**3, np.int64)
    for r in docs.select(F.col(text_col)).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str) -> Model:
    """Feature shares from a bounded sample of the labels outside the held-out fold."""
    spark = docs.sparkSession
    known = labels.select(F.col(label_id).alias("k"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("k").isNotNull() & (fold(label_id, FOLDS) != HELD_OUT))
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    tally = {bool(r["y"]): r["n"] for r in known.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = tally.get(True, 0), tally.get(False, 0)
    counts = character_counts(docs, text_col)
    empty = Model(np.zeros(0, np.int64), np.zeros(0), 0.0, counts)
    if not toxic:
        return empty
    part = {1: min(1.0, TOXIC_SAMPLE / toxic), 0: min(1.0, CLEAN_SAMPLE / max(clean, 1))}
    chance = F.when(F.col("y") > 0, part[1]).otherwise(part[0])
    # about TOXIC_SAMPLE + CLEAN_SAMPLE rows of two numbers, whatever the size of the table
    drawn = known.filter(F.pmod(F.xxhash64("k", F.lit("label")), F.lit(1 << 20)) < chance * (1 << 20))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(drawn), "k").groupBy("t").agg(F.max("y").alias("y"))
    # the lower end of the share's 90 % interval (Wilson), clean documents counted for those that were not drawn
    n = F.col("toxic") + F.col("clean") * part[1] / part[0]
    p, z = F.col("toxic") / n, 1.64
    share = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    model = empty
    for floor in MIN_SHARES:
        rows = feature_counts(texts, model).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        strong = rows.filter(F.col("toxic") >= MIN_DOCS).select("feature", share.alias("share")).filter(F.col("share") >= floor).collect()
        found = dict(zip(model.keys.tolist(), model.share.tolist())) | {r["feature"]: r["share"] for r in strong}
        keys = sorted(found)
        model = Model(np.array(keys, np.int64), np.array([found[k] for k in keys]), 0.0, counts)
    model.base = 0.02 * toxic / (toxic + clean)
    return model


def feature_counts(texts: DataFrame, model: Model) -> DataFrame:
    """feature, toxic, clean: in how many texts without any of the model's features; tasks send their own sums."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = shared.value, [np.zeros((2, 0), np.int64)]
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for low, high, data, bounds in chunks(batch.column(0)):
                row, _, hashes = document_features(data, bounds, model)
                known = np.zeros(high - low, bool)
                known[row[model.share_of(hashes) > 0]] = True
                pair = np.unique(np.stack([hashes, row])[:, ~known[row]], axis=1)
                held.append(np.stack([pair[0], (label[low:high][pair[1]] > 0).astype(np.int64)]))
        both = np.concatenate(held, axis=1)
        keys, at = np.unique(both[0], return_inverse=True)
        toxic = np.bincount(at, both[1], len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(toxic), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64) - toxic)], names=["feature", "toxic", "clean"])

    return texts.mapInArrow(run, "feature long, toxic long, clean long")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """One row for each row: doc_id, held_out, score, predicted.

    Null and empty texts, and texts without a known word, get the low rate of toxicity that such texts have; without
    any toxic label every score is 0. Texts and tokens of any length are read whole, in time in proportion to their
    length. A null id is in no fold and has no label. Other columns are not read. Rows with equal ids stay apart; of labels with equal
    ids the largest counts, and null labels do not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_id, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.score(data, bounds) for _, _, data, bounds in chunks(batch.column(1))]
            score = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    held = (fold(id_col, FOLDS) == HELD_OUT).alias("held_out")
    return docs.select(F.col(id_col), F.col(text_col), held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
