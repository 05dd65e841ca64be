"""Toxicity scores by a subsequence string-kernel SVM with Nystroem landmarks (op2).

Sentences are scored, in stretches of one to three words in a row with the blanks around and between them (up to WIDTH
characters; a longer word is covered by stretches of WIDTH characters). The kernel of two stretches counts their common
subsequences of three characters, gaps allowed and blanks being characters, each weighted by decay ** (characters spanned)
in either of them; it is divided by both stretches' own lengths, so each has kernel 1 with itself. Inserted characters and
blanks lengthen a span and so weaken a match but do not undo it. A sentence counts as its strongest stretch, a text as its
strongest sentence.

Labels are those of texts: a toxic text says that some stretch of its sentences is toxic, a clean one that none is. A
linear SVM is trained on the Nystroem features of witness stretches against clean ones, by alternation. As its feature map
and its weights are linear in the landmarks' subsequences, the trained model is one table subsequence -> weight of 64**3
entries whatever the corpus. The sum of a stretch's weights comes from running sums over the text; its own length is
computed only where a bound on the score does not settle the text's strongest stretch.
"""

from __future__ import annotations

import itertools
import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import common

SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
#: Characters that a subsequence may span, and the weight of each.
SPAN, DECAY = 6, 0.75
#: Characters and words of the longest stretch, and how far apart those of a long word begin.
WIDTH, WORDS, STEP = 24, 3, 8
#: Characters that the kernel tells apart: 0 is any other.
LETTERS = 64
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|[\n\r]+")
_BLANKS = re.compile(r"[^\S\n]+")
_INSIDE = re.compile(r"(?<=\w)[^\w\s]+(?=\w)")
_SPACED = re.compile(r"(?<!\S)\w(?:[\s.*_-]+\w){2,}(?!\S)")
_EDGE = string.punctuation + "«»¡¿…“”„‘’–—"
_OFFSETS = [(i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]
_WEIGHTS = np.array([DECAY ** (j + 1) for _, j in _OFFSETS])


def prepare(text: str | None) -> str:
    """Sentences in lines, each between blanks: lower case, without marks inside words, words spelt out in letters joined."""
    low = _INSIDE.sub("", (text or "").lower())
    low = _SPACED.sub(lambda m: re.sub(r"[\s.*_-]+", "", m[0]), low)
    return " " + _BLANKS.sub(" ", _SENTENCE.sub(" \n ", low)) + " "


def words_of(prepared: str) -> set[str]:
    found = {w.strip(_EDGE) for w in prepared.split()}
    found.discard("")
    return found


class Stretches:
    """The stretches of texts: code[start:end] of one array, and the number of the text of each."""

    def __init__(self, prepared: list[str], codes: np.ndarray):
        chars = np.frombuffer("\n".join(prepared).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.code = codes[chars].astype(np.int32)
        # Words stand between two blanks of one sentence.
        gap = np.flatnonzero((chars == 32) | (chars == 10))
        begin, end = gap[:-1], gap[1:] + 1
        word = (chars[begin] == 32) & (chars[end - 1] == 32) & (end - begin > 2) if len(gap) else np.zeros(0, dtype=bool)
        run = np.cumsum(~word) if len(gap) else word  # words of one sentence in a row have one number
        starts, ends = [], []
        for k in range(WORDS):
            ok = word[: len(word) - k] & word[k:] & (run[: len(run) - k] == run[k:]) if len(word) > k else np.zeros(0, dtype=bool)
            at = np.flatnonzero(ok)
            at = at[end[at + k] - begin[at] <= WIDTH]
            starts.append(begin[at])
            ends.append(end[at + k])
        long = np.flatnonzero(word & (end - begin > WIDTH)) if len(gap) else np.zeros(0, dtype=np.int64)
        n = 1 + -(-(end[long] - begin[long] - WIDTH) // STEP)
        which = np.repeat(long, n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        ends.append(np.minimum(begin[which] + k * STEP + WIDTH, end[which]))
        starts.append(ends[-1] - WIDTH)
        self.start, self.end = np.concatenate(starts).astype(np.int32), np.concatenate(ends).astype(np.int32)
        self.owner = np.searchsorted(np.cumsum([len(x) + 1 for x in prepared]), self.start, side="right").astype(np.int32)

    def string(self, i: int) -> bytes:
        return self.code[self.start[i] : self.end[i]].astype(np.uint8).tobytes()


def subsequences(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, subsequence, weight): the distinct subsequences of each stretch, scaled so that their length is 1."""
    at = start[:, None] + np.arange(WIDTH)
    inside = at < end[:, None]
    c = np.where(inside, code[np.minimum(at, len(code) - 1)], 0)
    keys, weights = [], []
    for (a, b), w in zip(_OFFSETS, _WEIGHTS, strict=True):
        if b < WIDTH:
            key = (c[:, : WIDTH - b] * LETTERS + c[:, a : WIDTH - b + a]) * LETTERS + c[:, b:]
            keys.append(np.where(inside[:, b:], key, -1))
            weights.append(np.full(WIDTH - b, w))
    key, weight = np.concatenate(keys, axis=1, dtype=np.int32), np.concatenate(weights)
    order = np.argsort(key, axis=1)
    key = np.take_along_axis(key, order, axis=1).ravel()
    value = weight[order].ravel()
    row = np.repeat(np.arange(len(start)), len(weight))
    new = np.flatnonzero((np.diff(key, prepend=-2) != 0) | (np.diff(row, prepend=-1) != 0))
    value, key, row = np.add.reduceat(value, new) if len(new) else value, key[new], row[new]
    value, key, row = (x[key >= 0] for x in (value, key, row))
    length = np.sqrt(np.bincount(row, weights=value * value, minlength=len(start)))
    return row, key, value / length[row]


#: Least length of a stretch of n characters: that of n characters no two subsequences of which are equal.
_LEAST = np.array([1.0] * 3 + [math.sqrt(sum(float(w) ** 2 * (n - b) for (_, b), w in zip(_OFFSETS, _WEIGHTS, strict=True) if n > b)) for n in range(3, WIDTH + 1)])


class Model:
    """score = sigmoid(slope * (margin + shift)); margin of a stretch = max(<its subsequences, table>, 0) + bias."""

    def __init__(self, letters: str, table: np.ndarray, bias: float, slope: float = 4.0, shift: float = 0.0):
        self.letters, self.table, self.bias, self.slope, self.shift = letters, table.astype(np.float32), bias, slope, shift
        self.codes = np.zeros(0x110000, dtype=np.uint8)
        for i, c in enumerate(letters, 1):
            self.codes[ord(c)] = i

    def __reduce__(self):
        return Model, (self.letters, self.table, self.bias, self.slope, self.shift)

    def sums(self, s: Stretches) -> np.ndarray:
        """Sum of the weights of all subsequences of each stretch, before its length divides it."""
        out = np.zeros(len(s.start))
        for b in range(2, SPAN):
            if len(s.code) <= b:
                break
            got = np.zeros(len(s.code) - b, dtype=np.float32)
            for a in range(1, b):
                got += self.table[(s.code[: len(got)] * LETTERS + s.code[a : a + len(got)]) * LETTERS + s.code[b:]]
            upto = np.zeros(len(got) + 1)
            np.cumsum(got, dtype=np.float64, out=upto[1:])
            out += DECAY ** (b + 1) * np.where(s.end - s.start > b, upto[np.clip(s.end - b, 0, len(got))] - upto[np.minimum(s.start, len(got))], 0.0)
        return out

    def strongest(self, s: Stretches, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(margin, number of the strongest stretch or -1) of each text; `bias` without any."""
        total = np.maximum(self.sums(s), 0.0)
        bound = total / _LEAST[s.end - s.start] + 1e-9
        best, which = np.zeros(texts), np.full(texts, -1, dtype=np.int64)
        todo = np.flatnonzero(total > 0)
        todo = todo[np.lexsort((-bound[todo], s.owner[todo]))]
        first = True
        while len(todo):
            # The one of each text with the largest bound first, then all whose bounds are still above what was found.
            now = todo[np.diff(s.owner[todo], prepend=-1) != 0] if first else todo[: 1 << 12]
            row, key, value = subsequences(s.code, s.start[now], s.end[now])
            got = np.bincount(row, weights=value * self.table[key], minlength=len(now))
            order = np.argsort(got, kind="stable")
            who, got, at = s.owner[now][order], got[order], now[order]
            better = got > best[who]
            best[who[better]], which[who[better]] = got[better], at[better]  # ascending: the largest is written last
            todo = np.setdiff1d(todo, now, assume_unique=True) if first else todo[1 << 12 :]
            todo = todo[bound[todo] > best[s.owner[todo]]]
            first = False
        return best + self.bias, which

    def margins(self, prepared: list[str]) -> np.ndarray:
        return self.strongest(Stretches(prepared, self.codes), len(prepared))[0] if prepared else np.zeros(0)

    def scores(self, texts: list[str | None]) -> list[float]:
        with np.errstate(over="ignore"):
            return (1 / (1 + np.exp(-np.clip(self.slope * (self.margins([prepare(x) for x in texts]) + self.shift), -30, 30)))).tolist()


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-5, rounds: int = 60) -> tuple[np.ndarray, float]:
    """The optimum of sum(weight * max(0, 1 - y (x w + b)) ** 2) + reg / 2 * |w| ** 2, by Newton steps on the rows that
    lie within the margin; the last column of x is 1 and stands for b, y in -1, 1, weight: of each row, sum 1. Rows within
    the margin are copied a few at a time."""
    ridge = np.full(x.shape[1], reg)
    ridge[-1] = 1e-9

    def loss(u: np.ndarray) -> float:
        return float(weight @ np.maximum(0.0, 1 - y * (x @ u)) ** 2 + 0.5 * ridge @ (u * u))

    u = np.zeros(x.shape[1])
    now = loss(u)
    for _ in range(rounds):
        slack = np.maximum(0.0, 1 - y * (x @ u))
        inside = np.flatnonzero(slack > 0)
        slope = ridge * u - x.T @ (2 * weight * y * slack)
        curve = np.diag(ridge)
        for at in range(0, len(inside), 512):
            held = x[inside[at : at + 512]]
            curve += (held * (2 * weight[inside[at : at + 512], None])).T @ held
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while (new := loss(u - size * step)) > now - 1e-4 * size * float(slope @ step) and size > 1e-6:
            size /= 2
        u = u - size * step
        if now - new < 1e-12 * max(now, 1e-12):
            break
        now = new
    return u[:-1], float(u[-1])


def _evidence(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Log-likelihood ratio of a word's counts of texts against the base rate; 0 unless it marks toxic ones clearly."""
    share = all_toxic / (all_toxic + all_clean)
    n = toxic + clean
    if toxic < 3 or toxic / n < share + 0.6 * (1 - share):
        return 0.0
    rate = toxic / n
    return 2 * (toxic * math.log(rate / share) + (clean * math.log((1 - rate) / (1 - share)) if clean else 0.0))


def _strengths(prepared: list[str], toxic: np.ndarray, least: float) -> tuple[dict[str, float], list[tuple[int, str]], set[str]]:
    """Words whose counts mark toxic texts, with their evidence; the words of toxic texts; and words of clean texts.

    Only words, and beginnings of words, of toxic texts are counted.
    """
    stems = lambda w: [w[:k] for k in range(4, min(len(w), 8))]
    mine = [(i, w) for i in np.flatnonzero(toxic).tolist() for w in words_of(prepared[i])]
    ever, never = int(toxic.sum()), int(len(toxic) - toxic.sum())
    words, begins = Counter(w for _, w in mine), Counter()
    for _, group in itertools.groupby(mine, key=lambda x: x[0]):
        begins.update({s for _, w in group for s in stems(w)})
    clean_words, clean_begins = Counter(), Counter()
    seen: set[str] = set()
    for i in np.flatnonzero(toxic == 0).tolist():
        bag = words_of(prepared[i])
        clean_words.update(bag & words.keys())
        clean_begins.update({s for w in bag for s in stems(w) if s in begins})
        seen |= bag
    found = {s: e for s, n in begins.items() if (e := _evidence(n, clean_begins[s], ever, never)) >= least}
    strength = {}
    for w, n in words.items():
        # A word seen often speaks for itself, a rare one by its first letters.
        e = _evidence(n, clean_words[w], ever, never)
        if n + clean_words[w] < 5:
            e = max([e, *(found.get(s, 0.0) for s in stems(w))])
        if e >= least / 2:
            strength[w] = e
    return strength, mine, seen


def _spread(names: list[str], codes: np.ndarray, most: int, near: float = 0.7) -> list[str]:
    """Names in order without those whose kernel with one before is `near` or more, `most` at most."""
    kept: list[str] = []
    rows: list[dict[int, float]] = []
    for w in names:
        s = Stretches([f" {w[: WIDTH - 2]} "], codes)
        _, key, value = subsequences(s.code, s.start[:1], s.end[:1])
        v = dict(zip(key.tolist(), value.tolist(), strict=True))
        if all(sum(x * u.get(k, 0.0) for k, x in v.items()) < near for u in rows):
            kept.append(w)
            rows.append(v)
        if len(kept) >= most:
            break
    return kept


def _blocks(prepared: list[str], most: int = 400_000) -> Iterator[list[str]]:
    """The texts in parts of about `most` characters, or one longer text."""
    held, size = [], 0
    for text in prepared:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _different(s: Stretches, rows: np.ndarray, most: int) -> list[bytes]:
    """The first `most` different strings of the given stretches."""
    seen: dict[bytes, None] = {}
    for i in rows.tolist():
        if len(seen) >= most:
            break
        seen.setdefault(s.string(i))
    return list(seen)


def _hardest(model: Model, clean: list[str], most: int) -> list[bytes]:
    """The `most` different stretches of clean texts that the model scores highest.

    Of each block of texts the stretches are scored in the order of their bounds, until what is left cannot be among them.
    """
    found: dict[bytes, float] = {}
    least = -np.inf
    for block in _blocks(clean):
        s = Stretches(block, model.codes)
        top = model.sums(s) / _LEAST[s.end - s.start]
        order = np.argsort(-top, kind="stable")
        for at in range(0, len(order), 4096):
            now = order[at : at + 4096]
            now = now[top[now] > max(least, 0.0)]
            if not len(now):
                break
            new = {s.string(i): i for i in now.tolist()}
            rows = np.array([i for x, i in new.items() if x not in found], dtype=np.int64)
            row, key, value = subsequences(s.code, s.start[rows], s.end[rows])
            got = np.bincount(row, weights=value * model.table[key], minlength=len(rows))
            found |= {s.string(i): v for i, v in zip(rows.tolist(), got.tolist(), strict=True) if v > least}
            if len(found) >= most:
                found = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most])
                least = min(found.values())
    return sorted(found, key=lambda x: (-found[x], x))


def _features(strings: list[bytes], place: np.ndarray, whiten: np.ndarray, step: int = 256, few: int = 16) -> np.ndarray:
    """Nystroem features of coded stretches, and a last one of 1. place: subsequence -> row of whiten, or -1.

    Subsequences are found for `step` stretches at a time; their rows of whiten, some 500 kB a stretch, are copied for `few`.
    """
    code = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int32)
    end = np.cumsum([len(x) for x in strings])
    start = end - np.array([len(x) for x in strings])
    out = np.zeros((len(strings), whiten.shape[1] + 1))
    out[:, -1] = 1
    for at in range(0, len(strings), step):
        row, key, value = subsequences(code, start[at : at + step], end[at : at + step])
        known = place[key] >= 0
        row, key, value = row[known], key[known], value[known]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for k in range(0, len(first), few):
            some = first[k : k + few]
            part = slice(some[0], first[k + few] if k + few < len(first) else len(row))
            rows = whiten[place[key[part]]]
            rows *= value[part, None].astype(np.float32)
            out[at + row[some], :-1] = np.add.reduceat(rows, some - some[0], axis=0)
    return out


def disguised(coded: bytes, blank: int, letters: int, n: int) -> list[bytes]:
    """`n` ways of writing a coded word: with a character put in, doubled or replaced, or a blank put in; drawn by its own hash."""
    if len(coded) < 6 or len(coded) > WIDTH - 2:
        return []
    rng = np.random.default_rng(list(coded))
    found: dict[bytes, None] = {}
    for k in range(4 * n):
        at = int(rng.integers(2, len(coded) - 1))  # between two letters
        other = bytes([int(rng.integers(0, letters + 1))])
        form = (coded[:at] + other + coded[at:], coded[:at] + coded[at - 1 : at] + coded[at:], coded[:at] + bytes([blank]) + coded[at:], coded[: at - 1] + other + coded[at:])[k % 4]
        found.setdefault(form)
        if len(found) == n:
            break
    return list(found)


def train(
    rows: list[tuple[str | None, int]], landmarks: int = 800, passes: int = 3, least: float = 16.0, hard: int = 3_000, sample: int = 1_500, disguises: int = 12
) -> Model:
    """rows: (text, toxic). Trains on stretches of their sentences, the text's label being that of a bag of them.

    First witnesses are the stretches around words, or around words by their first letters, whose likelihood ratio for
    toxic texts is `least` or more; toxic texts without any teach nothing. Words of four times that evidence stay witnesses
    in every pass, whatever stands beside them. Each witness also teaches `disguises` ways of writing it. A quarter of the
    landmarks at most are such words and twice as many ways of writing them, the others clean words that come nearest. Each
    pass trains on the witnesses against `sample` clean stretches and the `hard` clean ones that the model so far scores
    highest, and then takes the strongest stretch of each such text as its next witness.
    """
    prepared = [prepare(x) for x, _ in rows]
    toxic = np.array([int(y == 1) for _, y in rows], dtype=np.int64)
    share = toxic.mean() if len(toxic) else 0.0
    prior = Model("", np.zeros(LETTERS**3), math.log((share + 1e-3) / (1 - share + 1e-3)), 1.0)
    if not toxic.any() or toxic.all():
        return prior
    strength, mine, clean_words = _strengths(prepared, toxic, least)
    if not strength:
        return prior
    seen = Counter()
    for text in prepared:
        seen.update(text)
    del seen["\n"]
    letters = "".join(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: LETTERS - 1])
    empty = Model(letters, np.zeros(LETTERS**3), 0.0)
    strong = _spread(sorted(strength, key=lambda w: (-strength[w], w)), empty.codes, landmarks // 4)
    blank, plain = int(empty.codes[32]), "\0" + letters
    for w in list(strong):
        coded = Stretches([f" {w[: WIDTH - 2]} "], empty.codes).string(0)
        forms = [x for x in disguised(coded, blank, len(letters), disguises) if blank not in x[1:-1]]
        strong += ["".join(plain[i] for i in x[1:-1]) for x in forms[:2]]

    def weights(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = Stretches([f" {w[: WIDTH - 2]} " for w in names], empty.codes)
        first = np.flatnonzero(np.diff(s.owner, prepend=-1))
        return subsequences(s.code, s.start[first], s.end[first])

    # Clean words that come nearest to the strong ones.
    ideal = np.zeros(LETTERS**3)
    _, key, value = weights(strong)
    np.maximum.at(ideal, key, value)
    vocabulary = sorted(w for w in clean_words if 3 <= len(w) <= WIDTH - 2 and w not in strength)
    near = []
    for at in range(0, len(vocabulary), 4096):
        part = vocabulary[at : at + 4096]
        row, key, value = weights(part)
        near += np.bincount(row, weights=value * ideal[key], minlength=len(part)).tolist()
    marks = strong + [vocabulary[i] for i in np.argsort(-np.array(near), kind="stable")[: landmarks - len(strong)]]
    del clean_words, vocabulary, near
    row, key, value = weights(marks)
    names = np.unique(key)
    place = np.full(LETTERS**3, -1, dtype=np.int64)
    place[names] = np.arange(len(names))
    base = np.zeros((len(marks), len(names)), dtype=np.float32)
    base[row, place[key]] = value
    gram = np.zeros((len(marks), len(marks)))
    for at in range(0, len(names), 1024):
        part = base[:, at : at + 1024].astype(np.float64)
        gram += part @ part.T
    spectrum, vectors = np.linalg.eigh(gram)
    keep = spectrum > 1e-4
    whiten = base.T @ (vectors[:, keep] / np.sqrt(spectrum[keep])).astype(np.float32)  # subsequences -> Nystroem features
    del base, gram, vectors
    # Witnesses are stretches of one strong word in toxic texts, the strongest evidence of a text first.
    s = Stretches([x for x, y in zip(prepared, toxic, strict=True) if y], empty.codes)
    known = {Stretches([f" {w[: WIDTH - 2]} "], empty.codes).string(0): e for w, e in strength.items()}
    able = np.array([i for i in range(len(s.start)) if s.string(i) in known], dtype=np.int64)
    merit = np.array([known[s.string(i)] for i in able.tolist()])
    clean = [x for x, y in zip(prepared, toxic, strict=True) if not y]
    spaced: dict[bytes, None] = {}
    total = sum(map(len, clean))
    for block in _blocks(clean):
        part = Stretches(block, empty.codes)
        share = -(-sample * sum(map(len, block)) // total)
        at = np.linspace(0, len(part.start) - 1, min(4 * share, len(part.start))).astype(np.int64)
        spaced |= dict.fromkeys(_different(part, at, share))
    model = Model(letters, ideal, 0.0)
    for _ in range(passes):
        order = np.lexsort((-merit, s.owner[able]))
        witness = able[order[np.flatnonzero(np.diff(s.owner[able[order]], prepend=-1))]]
        often = Counter(map(s.string, witness.tolist()))
        for word, e in known.items():
            if e >= 4 * least:
                often[word] = max(often[word], int(e / 8))
        forms = {k: disguised(k, blank, len(letters), disguises) for k in sorted(often)}
        count = {k: math.sqrt(often[k]) for k in forms}
        for k, x in forms.items():
            for form in x:
                count.setdefault(form, math.sqrt(often[k]) / len(x))
        positive = sorted(count)
        negative = sorted({*_hardest(model, clean, hard), *spaced} - count.keys())
        x = _features(positive + negative, place, whiten)
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        n = np.concatenate((np.array([count[k] for k in positive]), np.ones(len(negative))))
        n[: len(positive)] /= 2 * n[: len(positive)].sum()
        n[len(positive) :] /= 2 * n[len(positive) :].sum()
        w, b = _svm(x, y, n)
        table = np.zeros(LETTERS**3)
        del x  # before the next pass makes its own
        for at in range(0, len(names), 1024):
            table[names[at : at + 1024]] = whiten[at : at + 1024] @ w
        model = Model(letters, table, float(b))
        for at in range(0, len(able), 1024):
            now = able[at : at + 1024]
            row, key, value = subsequences(s.code, s.start[now], s.end[now])
            merit[at : at + 1024] = np.bincount(row, weights=value * table[key], minlength=len(now))
    margin = np.concatenate([model.margins(block) for block in _blocks(prepared)])
    model.slope, model.shift = _calibrate(margin, toxic)
    return model


def _calibrate(margin: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope 4; the shift puts 0.5 where training errors are fewest, in the middle of the widest such gap."""
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], truth[order]
    # Errors if everything from position k on is called toxic.
    errors = np.concatenate(([0], np.cumsum(t == 1))) + np.concatenate((np.cumsum((t == 0)[::-1])[::-1], [0]))
    edges = np.concatenate(([m[0] - 1], m, [m[-1] + 1]))
    least = errors.min()
    width = np.where(errors == least, np.diff(edges), -1.0)
    k = int(width.argmax())
    return 4.0, -float((edges[k] + edges[k + 1]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, most_rows: int) -> DataFrame:
    """(doc_id, text, toxic, hash) of at most `most_rows` labelled rows outside the held-out fold, in order of a hash.

    Ids are chosen first, then rows: a repeated doc_id counts as often as it has rows.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % folds != held_out)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.select("doc_id", "text", "toxic", F.xxhash64("doc_id", "text").alias("hash"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most_rows: int = 4_000, most_chars: int = 6_000_000) -> Model:
    """The model of a bounded sample: at most `most_rows` labelled rows and `most_chars` characters, in hash order.

    First only lengths are read, at most `most_rows` of them; then the rows up to the limit of characters.
    """
    rows = training_rows(docs, labels, folds, held_out, most_rows)
    sizes = rows.select("hash", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy("hash", "doc_id").limit(most_rows).collect()
    total, keep = 0, set()
    for h, doc, n in sizes:
        if total + n <= most_chars:
            total += n
            keep.add((doc, h))
    wanted = docs.sparkSession.createDataFrame(sorted(keep), "doc_id long, hash long")
    chosen = rows.join(F.broadcast(wanted), ["doc_id", "hash"]).orderBy("hash", "doc_id").limit(len(sizes))
    return train([(r.text, r.toxic) for r in chosen.collect()])


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) for every row of `docs`.

    held_out: crc32(doc_id as text) mod `folds` is `held_out`; such rows never train (a null doc_id counts as held out,
    it has no label). A null or empty text scores as one without words. Repeated rows each get a row, labels that differ
    for one doc_id count as their larger one, other columns are not read; with no labels of either class each score is
    the share of the toxic. An empty table gives no rows.
    """
    model = model or fit(docs, labels, folds, held_out)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in common.rows(batches):
            s = model.scores(part["text"])
            yield common.table(SCORED, {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": s, "predicted": [int(x >= 0.5) for x in s]})

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(True))
    return docs.select("doc_id", "text", fold.alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows of `docs`, all columns whatever their names, whose text is not predicted toxic.

    Null and empty texts score as texts without words, equal texts alike; repeated rows stay or go together, null doc_ids
    are rows like others, and an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))
    return common.keep_rows(docs, lambda texts: [x < 0.5 for x in held.value.scores(texts)])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labels outside the held-out fold; see `toxicity`."""
    return toxicity(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
