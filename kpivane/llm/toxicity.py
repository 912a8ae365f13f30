"""Toxicity by a support vector machine on a gapped subsequence string kernel with Nystrom landmarks.

A text is a string over letters of any script with white space as gaps: case and look-alike digits are
folded, signs are left out. The letters a-z and those with signs have symbols of their own, letters of other
scripts share the symbols by a hash, and signs that stand for syllables or words, such as ideographs, are
two symbols each, so that two of them already make a subsequence. Two strings are alike when they share subsequences of three or four letters; one that spans more
characters counts less. The kernel's landmarks are words of the labelled texts; the machine is trained
on windows of the labelled texts in the landmarks' feature space. Its decision is then a sum over
subsequences, so a text is scored in time linear in its length, and a document by its worst window:
letters set apart by inserted characters or longer words around an insult still match.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows, with_texts
from .words import slices

MOST_ROWS = 2_400
LANDMARKS = 160
SPAN = 6
DECAY = 0.6
STARTS = 6
ROUNDS = 6
#: Bound of the training windows around seeds (evenly thinned beyond), like MOST_ROWS for texts.
SEED_WINDOWS = 10_000
WINDOW = STARTS + SPAN
SPLIT = "\n" * WINDOW
#: Characters that often stand for a letter, and letters with signs that count as their own.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "ß": "s"}
SIGNED = {"a": 27, "e": 28, "i": 29, "o": 30, "u": 31}
#: Offsets of the letters after the first, and the weight of that span; for three and for four letters.
SHAPES = [(rest, DECAY ** (rest[-1] + 1 - len(rest))) for size in (2, 3) for rest in combinations(range(1, SPAN + 1), size)]
#: Subsequences are numbered by five bits a letter; those of three letters come first.
NUMBERS = 1 << 20


DROPPED = 255


#: Code points with an entry of their own; ideographs beyond share those of the basic plane.
PLANES = 1 << 17
IDEOGRAPHS = (0x4E00, 0x5000)


@lru_cache(maxsize=1)
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """First and second symbol of each character: 1 to 31 for letters, 0 for white space, DROPPED for none.

    Only signs that stand for syllables or words have a second one.
    """
    first, second = np.full(PLANES, DROPPED, np.uint8), np.full(PLANES, DROPPED, np.uint8)
    for code in range(PLANES):
        sign = chr(code)
        kind = unicodedata.category(sign)
        if sign.isspace():
            first[code] = 0
        elif sign in LOOK_ALIKE or kind[0] in "LN" or kind == "So":
            parts = LOOK_ALIKE.get(sign) or unicodedata.normalize("NFKD", sign).lower()
            base = parts[0]
            if "a" <= base <= "z" and (len(parts) == 1 or unicodedata.combining(parts[1])):
                first[code] = SIGNED.get(base, ord(base) - 96) if len(parts) > 1 else ord(base) - 96
            elif kind == "Lo" and (0x1100 <= code < 0x1200 or code >= 0x2E80 and not unicodedata.bidirectional(sign) in ("R", "AL")):
                first[code], second[code] = 1 + crc32(sign.encode()) % 31, 1 + crc32(sign.encode()) // 31 % 31
            elif kind[0] == "L" and not "a" <= base <= "z":
                first[code] = 1 + crc32(base.encode("utf-8", "surrogatepass")) % 31
    return first, second


def _points(text: str) -> np.ndarray:
    """Places of the characters in `alphabet`."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    start, many = IDEOGRAPHS
    return np.where(points < PLANES, points, np.where(points < 0x40000, start + points % many, 0xFFFF))


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, where each begins, and where each character went.

    A text begins with WINDOW gaps of its own, so no window that starts in it reaches the next one. Signs are left out, and so is the gap between two letters that stand alone (as in `b a d`).
    """
    points = _points(SPLIT + SPLIT.join(texts) + SPLIT)
    one, two = (table[points] for table in alphabet())
    if (two != DROPPED).any():
        codes, step = np.stack([one, two], axis=1).ravel(), 2
    else:
        codes, step = one, 1
    keep = codes != DROPPED
    place = (np.cumsum(keep, dtype=np.int32) - keep)[::step]
    whole = int(keep.sum())
    codes = codes[keep]
    gap = codes == 0
    lone = np.zeros(len(codes), bool)
    lone[2:-2] = gap[2:-2] & ~gap[1:-3] & ~gap[3:-1] & gap[:-4] & gap[4:]
    after = np.cumsum(~lone, dtype=np.int32) - ~lone
    begin = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + WINDOW for t in texts), np.int64, len(texts)))])
    place = np.append(after, (~lone).sum())[np.append(place, whole)]
    return codes[~lone], place[begin], place


def numbered(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape the number of the subsequence that begins at each position but the last SPAN, and its weight.

    Numbers in which a letter is missing are those of no subsequence of that many letters.
    """
    n = len(codes) - SPAN
    wide = codes.astype(np.int32)
    for rest, weight in SHAPES:
        found = wide[:n]
        for k in rest:
            found = found << 5 | wide[k : n + k]
        yield found, weight


class Judge(NamedTuple):
    """Weights of subsequences by number; a document's worst window goes through a logistic curve."""

    number: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def table(self) -> np.ndarray:
        out = np.zeros(NUMBERS, np.float32)
        out[self.number] = self.weight
        return out


def windows(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The decision, without the bias, for the window at each position but the last WINDOW."""
    each = np.zeros(len(codes) - SPAN, np.float32)
    for found, weight in numbered(codes):
        each += np.float32(weight) * table[found]
    sums = np.concatenate([[0], np.cumsum(each, dtype=np.float64)])
    return sums[STARTS:] - sums[:-STARTS]


def scores(judge: Judge, table: np.ndarray, texts: list[str]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    codes, begin, _ = letters(texts)
    best = np.maximum.reduceat(windows(table, codes), begin[:-1])
    return 1 / (1 + np.exp(-np.clip(judge.slope * best + judge.shift, -30, 30)))


def _lower(text: str) -> str:
    """Lower case, where that leaves every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text


def _placed_words(text: str, known: set[str]) -> list[int]:
    """Places of the words in `known`."""
    low, at, out = _lower(text), 0, []
    for word in low.split():
        at = low.index(word, at)
        out += [at + i for i, piece in _pieces(word) if piece in known]
        at += len(word)
    return out


@lru_cache(maxsize=1 << 18)
def _pieces(word: str) -> tuple[tuple[int, str], ...]:
    """What a word counts as, with the place in it: itself, or every piece of two to four signs in runs of signs that
    stand for syllables or words; nothing if it holds no subsequence."""
    if max(word) < "\u1100":  # no such signs
        return ((0, word),) if sum(c.isalnum() or c in LOOK_ALIKE for c in word) >= 3 else ()
    first, second = alphabet()
    points = _points(word)
    wide = second[points] != DROPPED
    if wide.any():
        return tuple((i, word[i : i + n]) for n in (2, 3, 4) for i in range(len(word) - n + 1) if wide[i : i + n].all())
    return ((0, word),) if (first[points] != DROPPED).sum() >= 3 else ()


def _seeds(texts: list[str], label: np.ndarray) -> tuple[list[str], list[str]]:
    """Words of the toxic texts that others hardly have, by how many texts they tell; and common other words."""
    has = (Counter(), Counter())
    for text, y in zip(texts, label, strict=True):
        has[int(y)].update({piece for word in set(_lower(text).split()) for _, piece in _pieces(word)})
    n = [max(1, int((label == k).sum())) for k in (0, 1)]

    def strength(w: str) -> float:
        p, q = has[1][w] / n[1], (has[0][w] + 0.5) / n[0]
        return (p - q) / np.sqrt(q / n[1] + p / n[1] + 1e-12)

    telling = [w for w, c in has[1].items() if c >= 4 and has[1][w] / n[1] > 10 * (has[0][w] + 0.5) / n[0]]
    telling.sort(key=lambda w: (-strength(w), w))
    plain = [w for w, _ in sorted(has[0].items(), key=lambda x: (-x[1], x[0]))]
    return telling, plain


def _whole(number: np.ndarray, size: int) -> np.ndarray:
    """Which numbers are subsequences of `size` letters with none missing."""
    out = number > 0
    for k in range(size):
        out &= (number >> 5 * k & 31) > 0
    return out


def _landmarks(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all subsequences in the words, and their weights in each word, of length one."""
    rows = []
    for k, word in enumerate(words):
        codes, _, _ = letters([word])
        for (rest, _), (found, weight) in zip(SHAPES, numbered(codes), strict=True):
            own = found[_whole(found, len(rest) + 1)]
            rows.append(np.stack([own, np.full(len(own), k), np.full(len(own), weight)], axis=1))
    rows = np.concatenate(rows)
    number, at = np.unique(rows[:, 0].astype(np.int64), return_inverse=True)
    marks = np.zeros((len(number), len(words)))
    np.add.at(marks, (at, rows[:, 1].astype(np.int64)), rows[:, 2])
    return number, marks / np.maximum(np.linalg.norm(marks, axis=0), 1e-9)


def _cut(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(windows x WINDOW) letters from each start on."""
    return codes[np.minimum(starts[:, None] + np.arange(WINDOW), len(codes) - 1)]


def _kernel(cut: np.ndarray, number: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernel values of windows against the landmarks."""
    place = np.full(NUMBERS, -1, np.int32)
    place[number] = np.arange(len(number))
    out = np.zeros((len(cut), marks.shape[1]), np.float32)
    for i in range(0, len(cut), 1024):
        local = cut[i : i + 1024].astype(np.int32)
        hits = []
        for rest, weight in SHAPES:
            found = local[:, :STARTS]
            for k in rest:
                found = found << 5 | local[:, k : STARTS + k]
            at = place[found]
            row, _ = np.nonzero(at >= 0)
            hits.append((row, at[at >= 0], np.full(len(row), weight)))
        row, at, weight = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.argsort(row, kind="stable")
        row, at, weight = row[order], at[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        if len(first):
            out[i + row[first]] = np.add.reduceat(marks[at] * weight[:, None], first, axis=0)
    return out


def _machine(x: np.ndarray, y: np.ndarray, steps: int = 150, shrink: float = 1e-4) -> np.ndarray:
    """Linear support vector machine (squared hinge, classes balanced) by accelerated gradient; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float32)
    sign = np.where(y > 0, 1, -1).astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    rate = np.float32(1 / (2 * np.linalg.eigvalsh((x * share[:, None]).T @ x)[-1] + shrink))
    w = held = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - sign * (x @ held))
        new = held - rate * (np.float32(shrink) * held - 2 * x.T @ (share * sign * slack))
        held = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small ridge."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
    return float(w[0]), float(w[1])


def fit(texts: list[str], label: np.ndarray, prior: float, seed_windows: int = SEED_WINDOWS) -> Judge:
    """Train on labelled texts; `prior` is the share of toxic ones among all labelled texts, `seed_windows` bounds the
    windows around telling words that are trained on."""
    rng = np.random.default_rng(3)
    telling, plain = _seeds(texts, label)
    if not telling or label.min(initial=1) == 1:
        return Judge(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, float(np.log((prior + 1e-9) / (1 - prior + 1e-9))))
    words = telling[: LANDMARKS * 3 // 4]
    words += plain[: LANDMARKS - len(words)]
    number, marks = _landmarks(words)
    values, vectors = np.linalg.eigh(marks.T @ marks + 1e-3 * np.eye(len(words)))
    root = vectors @ np.diag(values**-0.5) @ vectors.T

    known = set(telling)
    good: list[np.ndarray] = []
    bad: list[np.ndarray] = []
    for text, y in zip(texts, label, strict=True):
        codes, _, place = letters([text])
        if not y:
            starts = rng.integers(WINDOW, max(WINDOW + 1, len(codes) - WINDOW), 6)
            bad.append(_cut(codes, starts))
            continue
        good.append(_cut(codes, np.array([place[WINDOW + at] for at in _placed_words(text, known)], np.int64)))
    found = np.concatenate(good)

    def features(cut: np.ndarray) -> np.ndarray:
        return (_kernel(cut, number, marks) @ root).astype(np.float32)

    ones, zeros = [features(found[:: max(1, -(-len(found) // seed_windows))])], [features(np.concatenate(bad))]
    for _ in range(ROUNDS):
        x = np.concatenate([*ones, *zeros])
        y = np.repeat([1, 0], [sum(map(len, ones)), sum(map(len, zeros))])
        w = _machine(x, y)
        judge = Judge(number, (marks @ (root @ w[:-1])).astype(np.float32), 1.0, float(w[-1]))
        table, best, worst = judge.table(), np.zeros(len(texts)), []
        for i, text in enumerate(texts):
            codes, _, _ = letters([text])
            each = windows(table, codes)
            best[i] = each.max()
            worst.append(_cut(codes, np.array([np.argmax(each)])))
        # Each text's worst window decides about it: those of the other texts are the hard cases.
        hard = features(np.concatenate(worst))
        zeros.append(hard[label == 0])
        ones.append(hard[(label == 1) & (best + w[-1] > -0.5)])
    slope, shift = _logistic(best, label)
    share = np.clip(label.mean(), 1e-6, 1 - 1e-6)
    shift += np.log((prior + 1e-9) / (1 - prior + 1e-9)) - np.log(share / (1 - share))
    return judge._replace(slope=slope, shift=float(shift))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_ROWS) -> Judge:
    """Fit on the texts of at most `most` labelled rows of each class, never on the held-out fifth."""
    rows = with_texts(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), training_rows(labels, label, most))
    got = rows.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")).toArrow().sort_by("doc_id")
    shares = labels.where(~held_out("doc_id")).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return fit(got["text"].to_pylist(), got["label"].to_numpy().astype(np.int64), float(shares or 0))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "toxic", most: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; one row per row of `docs`.

    A null or empty text, or one without letters, has no window that tells anything and gets the score of such a window. A null
    doc_id counts as held out. Without labelled rows of both classes every score is the share of toxic
    labels. Other columns are ignored.
    """
    judge = train(docs, labels, label, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = judge.table()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                found = scores(judge, weights, [t or "" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
