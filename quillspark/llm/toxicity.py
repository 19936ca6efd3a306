"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words counts their common subsequences of 4 characters (with marks for a word's begin
and end) inside stretches of 7, each weighed by ``DECAY`` for every character it skips; a word is scaled by the root of
the sum of its squared weights, place by place.
ASCII signs that are no letters or digits are passed over and make no gap, so "i-d.i*o.t" is the word that
it spells, and characters put in lose it some subsequences only. Single letters that stand alone in a row
are read as one word beside themselves. A sentence's kernel is the sum over its words.

Landmarks are words of the training sentences: those that toxic and other documents differ in most, and
frequent ones. Sentences are mapped by the kernel to the landmarks times K^-1/2 (Nyström), and a linear
machine with squared hinge loss is trained on them; sentences of toxic documents that it finds harmless
are then left out and it is trained again. As the map is linear in words, the trained machine is one
value for each word: an expansion over the landmarks, kept as weights of hashed subsequences. So a
document's score costs its distinct words. It is a logistic function of the values of all its words:
how many are clearly toxic, their share, the highest, and what exceeds a mark.

Labels are learnt from a bounded sample: of either class the ``most`` labelled documents with the smallest
hashes of their ids and at most ``longest`` characters, and none that are held out; of their sentences at most
``sentences``, drawn by a fixed seed, train the machine, and there are ``landmarks`` landmarks. Scoring reads every
word of every text, of any length. Null texts count as empty; an empty text has the score of a text without
findings. Labels of a doc_id that disagree count as toxic, null ids and other labels than 0 and 1 as none; of rows
of one id the least text is learnt from. Without labels of both classes nothing is toxic. Rows of equal text have equal
scores, repeated rows stay, an empty table gives no rows. A column of df that shares a made column's name gives way.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .quality import sample

MOST, LONGEST, LANDMARKS, SENTENCES = 1_500, 20_000, 256, 40_000
QUANTILE = 0.9995  # of the values of words of documents that are not toxic: those above are clearly toxic
DECAY, SPAN, BITS, CARE = 0.7, 7, 18, 4.0
OFFSETS = [c for c in combinations(range(SPAN), 4) if c[0] == 0]
FACTORS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]
BEGIN, END = "\x02", "\x03"
MARKS = {i: None for i in range(128) if not chr(i).isalnum()}


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of hashed subsequences
    hot: float  # words of this value or more are clearly toxic
    center: np.ndarray  # of the logistic function: means, scales, coefficients and intercept
    scale: np.ndarray
    coefficients: np.ndarray


def subsequences(words: list[str]):
    """(word, bucket, weight) arrays, for each set of offsets in turn."""
    words = [w.translate(MARKS) for w in words]
    joined = "".join([BEGIN + w + END for w in words])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    for at in OFFSETS:
        n = len(code) - at[-1]
        if n <= 0:
            continue
        i = np.flatnonzero(word[:n] == word[at[-1] :])
        key = sum((code[i + k] * f for k, f in zip(at, FACTORS)), np.zeros(len(i), np.uint32))
        key = (key ^ (key >> np.uint32(15))) * np.uint32(2246822519)
        yield word[i], (key >> np.uint32(32 - BITS)).astype(np.int64), DECAY ** (at[-1] - 3)


def values(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The machine's value of each word."""
    total, norm = np.zeros(len(words)), np.zeros(len(words))
    for word, bucket, weight in subsequences(words):
        total += np.bincount(word, weights[bucket], len(words)) * weight
        norm += np.bincount(word, minlength=len(words)) * weight**2
    return total / np.sqrt(np.maximum(norm, 1e-12))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, weight) of all normalised subsequences of the words."""
    found = [(w, b, np.full(len(w), x)) for w, b, x in subsequences(words)]
    word, bucket, weight = (np.concatenate(x) for x in zip(*found))
    norm = np.sqrt(np.maximum(np.bincount(word, weight**2, len(words)), 1e-12))
    return word, bucket, weight / norm[word]


def words_of(text: str) -> list[str]:
    """Words in lower case, and a word for each run of three or more single letters or digits."""
    found = text.lower().split()
    if sum(len(w) == 1 for w in found) >= 3:
        run: list[str] = []
        for w in [*found, ""]:
            if len(w) == 1 and w.isalnum():
                run.append(w)
            else:
                if len(run) >= 3:
                    found.append("".join(run))
                run = []
    return found


def kernel(words: list[str], landmarks: list[str], then: np.ndarray | None = None) -> np.ndarray:
    """Kernel values of words and landmarks, times the matrix ``then``; a part of the words at a time."""
    mark, bucket, weight = features(landmarks)
    known, at = np.unique(bucket, return_inverse=True)
    table = np.zeros((len(known), len(landmarks)), np.float32)
    np.add.at(table, (at, mark), weight)
    then = np.eye(len(landmarks), dtype=np.float32) if then is None else then.astype(np.float32)
    out = np.zeros((len(words), then.shape[1]), np.float32)
    for start in range(0, len(words), 50):
        word, bucket, weight = features(words[start : start + 50])
        place = np.minimum(np.searchsorted(known, bucket), len(known) - 1)
        hit = np.flatnonzero(known[place] == bucket)
        hit = hit[np.argsort(word[hit], kind="stable")]
        if len(hit):
            first = np.flatnonzero(np.diff(word[hit], prepend=-1))
            sums = np.add.reduceat(table[place[hit]] * weight[hit, None].astype(np.float32), first)
            out[start + word[hit[first]]] = sums @ then
    return out


def machine(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, keep: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the intercept) of a linear machine with squared hinge loss, by Newton steps;
    y is +1 or -1, and both classes weigh the same. Rows not to keep count as if they were not there."""
    keep = np.ones(len(y), bool) if keep is None else keep
    each = np.where(y > 0, 0.5 / max(1, (keep & (y > 0)).sum()), 0.5 / max(1, (keep & (y < 0)).sum())) * keep.sum() * keep
    n = x.shape[1] + 1
    w = np.zeros(n)
    for _ in range(25):
        gram, right = penalty * np.eye(n), np.zeros(n)
        for a in range(0, len(x), 2_000):  # a part of the rows at a time
            own = np.hstack([x[a : a + 2_000], np.ones((len(x[a : a + 2_000]), 1))])
            active = np.where(y[a : a + 2_000] * (own @ w) < 1, each[a : a + 2_000], 0)
            gram += (own * active[:, None]).T @ own
            right += own.T @ (active * y[a : a + 2_000])
        new = np.linalg.solve(gram, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, care: float = CARE, penalty: float = 1e-3) -> np.ndarray:
    """Coefficients and intercept; documents that are not toxic weigh care times as much as toxic ones, all together."""
    x = np.hstack([x, np.ones((len(x), 1))])
    each = np.where(y > 0, 1 / max(1, (y > 0).sum()), care / max(1, (y < 1).sum())) / (1 + care) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + penalty * len(y) * np.eye(len(w)), x.T @ (each * (p - y)) + penalty * len(y) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def summary(value: np.ndarray, sizes: np.ndarray, hot: float) -> np.ndarray:
    """A row for each text from the values of its words: of clearly toxic ones the number and the share, the
    highest value, and the sum and the mean of what exceeds half the value of a clearly toxic one."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n = np.maximum(1, sizes)
    count = common.per_row((value >= hot).astype(float), offsets)
    high = np.full(len(sizes), 0.0)
    some = sizes > 0
    if some.any():
        high[some] = np.maximum.reduceat(value, offsets[:-1][some])
    over = common.per_row(np.maximum(0, value - hot / 2), offsets)
    return np.stack([np.log1p(count), np.sqrt(100 * count / n), high, np.log1p(over), np.sqrt(100 * over / (n + 20))], axis=1)


def landmarks_of(words: list[str], docs: list[np.ndarray], label: np.ndarray, most: int) -> list[str]:
    """Three quarters words whose document frequencies differ most between the classes, one quarter frequent ones."""
    seen = np.zeros((2, len(words)))
    for y, codes in zip(label, docs):
        seen[y, np.unique(codes)] += 1
    n = np.maximum(1, [(label == 0).sum(), (label == 1).sum()])
    p = (seen.sum(0) + 1) / (n.sum() + 2)
    z = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
    fit = np.array([len(w) > 2 for w in words])
    toxic = np.flatnonzero(fit & (seen[1] > 1))
    toxic = toxic[np.argsort(-z[toxic], kind="stable")][: 3 * most // 4]
    rest = fit & (seen[0] > 0)
    rest[toxic] = False
    frequent = np.flatnonzero(rest)
    frequent = frequent[np.argsort(-seen[0][frequent], kind="stable")][: most - len(toxic)]
    return [words[i] for i in [*toxic, *frequent]]


def train(docs: list[tuple[int, str]], landmarks: int = LANDMARKS, sentences: int = SENTENCES, rounds: int = 2) -> Model:
    """A model from (label, text)s, which are taken out of the list. Words that occur once in the sentences are left out of them."""
    bare = Model(np.zeros(1 << BITS, np.float32), 1e9, np.zeros(5), np.ones(5), np.array([0.0] * 5 + [-1.0]))
    if {y for y, _ in docs} != {0, 1}:
        return bare  # nothing to learn from
    number: dict[str, int] = {}
    code = lambda s: [number.setdefault(w, len(number)) for w in words_of(s)]
    label = np.array([y for y, _ in docs])
    whole, flat, sizes, signs = [], array("i"), array("i"), array("i")  # flat: the words of all sentences, one after another
    while docs:  # a text is let go once its words are numbered
        y, text = docs.pop(0)
        whole.append(np.array(code(text), np.int32))
        for sentence in re.split(r"[.!?|\n]+\s*", text):
            if sentence.strip():
                flat.extend(own := code(sentence))
                sizes.append(len(own))
                signs.append(1 if y else -1)
    marks = landmarks_of(list(number), whole, label, landmarks)
    if not marks:
        return bare
    codes, sizes, y = np.array(flat, np.int32), np.array(sizes, np.int64), np.array(signs, float)
    if len(y) > sentences:
        some = np.zeros(len(y), bool)
        some[np.random.default_rng(0).choice(len(y), sentences, replace=False)] = True
        codes, sizes, y = codes[np.repeat(some, sizes)], sizes[some], y[some]
    del flat, signs
    often = np.flatnonzero(np.bincount(codes, minlength=len(number)) > 1)
    place = np.full(len(number), -1)
    place[often] = np.arange(len(often))
    base = kernel(marks, marks).astype(float)
    e, v = np.linalg.eigh((base + base.T) / 2)
    half = v[:, e > 1e-6] / np.sqrt(e[e > 1e-6])
    words = list(number)
    x = np.zeros((len(y), half.shape[1]), np.float32)
    row, word = np.repeat(np.arange(len(y)), sizes), place[codes]
    row, word = row[word >= 0], word[word >= 0]
    order = np.argsort(word, kind="stable")
    for a in range(0, len(order), 10_000):  # places of words in sentences, word by word, and a part of them at a time
        at = order[a : a + 10_000]
        low, high = word[at[0]], word[at[-1]]
        near = kernel([words[i] for i in often[low : high + 1]], marks, half)
        at = at[np.argsort(row[at], kind="stable")]
        first = np.flatnonzero(np.diff(row[at], prepend=-1))
        x[row[at[first]]] += np.add.reduceat(near[word[at] - low], first)
    x /= np.sqrt(np.maximum(sizes, 1))[:, None]
    del row, word, order, codes, place
    keep = np.ones(len(y), bool)
    for _ in range(rounds + 1):
        w = machine(x, y, keep=keep)
        found = np.concatenate([x[a : a + 2_000] @ w[:-1] for a in range(0, len(x), 2_000)]) + w[-1]
        keep = (y < 0) | (found > np.quantile(found[y < 0], 0.98))
        if not (keep & (y > 0)).any():
            break
    del x, found
    beta = half @ w[:-1]
    mark, bucket, weight = features(marks)
    weights = np.bincount(bucket, weight * beta[mark], 1 << BITS).astype(np.float32)
    value = np.concatenate([values(words[i : i + 10_000], weights) for i in range(0, len(words), 10_000)])
    sizes = np.array([len(c) for c in whole])
    found = value[np.concatenate(whole)]
    clean = np.repeat(label == 0, sizes)
    hot = float(np.quantile(found[clean], QUANTILE)) if clean.any() else 1e9
    table = summary(found, sizes, hot)
    center, scale = table.mean(0), np.maximum(table.std(0), 1e-6)
    return Model(weights, hot, center, scale, logistic((table - center) / scale, label.astype(float)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST, longest: int = LONGEST, landmarks: int = LANDMARKS, sentences: int = SENTENCES) -> Model:
    """A model from the labelled rows that are not held out; it gathers 2 * most * longest characters at most."""
    known = F.broadcast(sample(labels.where(~held_out(F.col(doc_id))), label, most, doc_id, lowest=False))
    rows = df.select(F.col(f"`{doc_id}`").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.where(F.length("text") <= longest).join(known, "__id").groupBy("__id", "__label").agg(F.min("text").alias("text"))
    return train([(r["__label"], r["text"]) for r in sorted(rows.collect())], landmarks, sentences)  # as many documents at most as ids


def score(df: DataFrame, model: Model, text: str = "text", carry=None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """carried columns with score and predicted, under these names."""
    weights, hot, center, scale, coefficients = model.weights, model.hot, model.center, model.scale, model.coefficients

    def make():
        known: dict[str, int] = {}
        value = np.zeros(0)

        def work(texts: pa.Array) -> list:
            nonlocal value
            lists = [words_of(x) for x in texts.to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            if len(known) > 150_000:  # memory is bounded
                known.clear()
                value = value[:0]
            codes = np.fromiter((known.setdefault(w, len(known)) for x in lists for w in x), np.int64, int(sizes.sum()))
            new = list(known)[len(value) :]
            value = np.concatenate([value, *(values(new[i : i + 50_000], weights) for i in range(0, len(new), 50_000))])
            table = (summary(value[codes], sizes, hot) - center) / scale
            p = 1 / (1 + np.exp(-np.clip(table @ coefficients[:-1] + coefficients[-1], -30, 30)))
            return [p, (p >= 0.5).astype(np.int32)]

        return work

    return common.map_text(df, text, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())], make, carry)


def rate(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, by a model of the same documents and their labels."""
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), held_out(F.col(f"`{doc_id}`")).alias("held_out"))
    return score(rows, fit(df, labels, doc_id, text, **options), "text", ["doc_id", "held_out"])
