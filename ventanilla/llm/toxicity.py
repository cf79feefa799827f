"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Two words are alike in the kernel when they share subsequences of three
letters, each weighted by the stretch it spans, so letters put in between
lower a match without losing it. One machine is trained on words of labelled
texts. A second one is trained on windows of the labelled texts' sentences,
across word borders: the worst window of a toxic text against windows of
clean texts, found again with the machine just trained. A text's score comes
from its worst words and its worst window.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventanilla.llm.common import id_and_text, schema, staged

#: Labelled rows that training looks at, at most, by label (0, 1); taken by hash of the id.
SAMPLE = (5000, 2500)
#: Words taken from them, at most: telling ones, ordinary ones of the clean rows, and
#: ordinary ones that the machine so far finds worst, in so many rounds.
TELLING, ORDINARY, HARD, HARD_ROUNDS = 300, 6000, 3000, 2
#: A telling word is in so many toxic rows of the sample, so many times likelier there, and for
#: so many rows (nearly) the commonest such word; rare words of a much-copied toxic text are not.
LEAST_ROWS, RATIO, NEARLY = 3, 12.0, 0.5
#: Landmarks of the Nystroem map; decay of a subsequence per letter spanned; letters it may span after its first.
LANDMARKS, DECAY, SPAN = 96, 0.8, 6
#: Letter classes: a subsequence of three is one of CLASSES ** 3 features.
CLASSES = 64
#: Worst words of a text that its score sees, and the margin that stands for a missing one.
WORST, NONE = 3, -2.0
#: Numbers of a text that its score sees: worst words, worst window, log of its number of words.
FEATURES = WORST + 2
#: Words of a window and from one window's start to the next: any two neighbours of a sentence share one.
WINDOW, STRIDE = 4, 3
#: Times that the worst windows of the labelled texts are taken and the window machine is trained.
WINDOW_ROUNDS = 2
#: Words whose margin a task remembers.
CACHE = 150_000
#: Rows of a batch that are handled at a time.
ROWS = 1000

#: Three or more single characters in a row are read as one word.
_SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")

_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")


def windows(text: str) -> list[str]:
    """The windows of a text's sentences, in lower case; none without words."""
    out = []
    for sentence in _SENTENCE.split(text.lower()):
        words = sentence.split()
        out += [" ".join(words[a:a + WINDOW]) for a in range(0, max(len(words) - 1, min(len(words), 1)), STRIDE)]
    return out


def _letter_classes() -> np.ndarray:
    """Class of each code point below 0x250: a-z in either case, other letters; 0 for all else (a gap)."""
    out = np.zeros(0x250, np.int32)
    for cp in range(0x250):
        low = chr(cp).lower()
        if "a" <= low <= "z" and len(low) == 1:
            out[cp] = ord(low) - ord("a") + 1
        elif chr(cp).isalpha():
            out[cp] = 27 + ord(low[0]) % (CLASSES - 27)
    return out


_CLASS = _letter_classes()


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """``(word number, feature, weight)`` of all three-letter subsequences, by their two gaps."""
    points = np.frombuffer(("\n" + "\n".join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.cumsum(points == 10) - 1
    cls = np.where(points < len(_CLASS), _CLASS[np.minimum(points, len(_CLASS) - 1)],
                   27 + (points % (CLASSES - 27)).astype(np.int32))
    for span in range(2, SPAN + 1):
        a, c = cls[:-span], cls[span:]
        ends = np.flatnonzero((a > 0) & (c > 0) & (word[:-span] == word[span:]))
        if not len(ends):
            continue
        outer = a[ends] * CLASSES * CLASSES + c[ends]
        for gap in range(1, span):
            mid = cls[ends + gap]
            ok = mid > 0
            yield word[ends[ok]], outer[ok] + mid[ok] * CLASSES, DECAY ** span


def margins(words: list[str], theta: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for each word; ``NONE`` where a word has no three letters."""
    value, norm = np.zeros(len(words)), np.zeros(len(words))
    for word, feature, weight in subsequences(words):
        value += np.bincount(word, theta[feature], len(words)) * weight
        norm += np.bincount(word, minlength=len(words)) * weight ** 2
    return np.where(norm > 0, value / np.sqrt(np.maximum(norm, 1e-12)) + bias, NONE)


def _gapped(words: list[str], rng) -> list[str]:
    """The words spelled with marks between letters, and with one letter put in."""
    out = []
    for w in words:
        out.append(str(rng.choice([".", "-", "*", "_"])).join(w))
        if len(w) > 3:
            at = int(rng.integers(1, len(w)))
            out.append(w[:at] + chr(97 + int(rng.integers(26))) + w[at:])
    return out


def fit_words(good: list[str], ordinary: list[str], seed: int = 3, gapped: bool = True) -> tuple[np.ndarray, float]:
    """Weights per feature and bias of the machine that tells telling words (or windows) from ordinary ones.

    Landmarks are the first telling words and some ordinary ones. The
    Nystroem features of a word are its kernels with the landmarks times the
    inverse root of their own kernel matrix; the squared hinge is minimised
    by Newton steps. Both maps are linear, so they fold into one weight per
    three-letter feature.
    """
    rng = np.random.default_rng(seed)
    marks = good[:LANDMARKS * 2 // 3] + [str(w) for w in rng.permutation(ordinary)[:LANDMARKS // 3]]
    yes = good + (_gapped(good, rng) if gapped else [])
    no = ordinary + (_gapped([str(w) for w in rng.permutation(ordinary)[:1500]], rng) if gapped else [])
    words = marks + yes + no
    y = np.concatenate((np.where(np.arange(len(marks)) < len(good[:LANDMARKS * 2 // 3]), 1.0, -1.0), np.ones(len(yes)), -np.ones(len(no))))
    m = len(marks)
    # only features of landmarks count; the last row stands for all others
    found = list(subsequences(marks))
    held = np.unique(np.concatenate([f for _, f, _ in found] + [np.zeros(0, np.int32)]))
    slot = np.full(CLASSES ** 3, len(held), np.int32)
    slot[held] = np.arange(len(held))
    table = np.zeros((len(held) + 1, m), np.float32)
    norm = np.zeros(m)
    for word, feature, weight in found:
        np.add.at(table, (slot[feature], word), weight)
        norm += np.bincount(word, minlength=m) * weight ** 2
    table /= np.sqrt(np.maximum(norm, 1e-12)).astype(np.float32)
    k = np.zeros((len(words), m))
    norm = np.zeros(len(words))
    for word, feature, weight in subsequences(words):
        for a in range(0, len(word), 50_000):
            w, part = word[a:a + 50_000], table[slot[feature[a:a + 50_000]]]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            k[w[first]] += weight * np.add.reduceat(part, first)
        norm += np.bincount(word, minlength=len(words)) * weight ** 2
    k /= np.sqrt(np.maximum(norm, 1e-12))[:, None]
    values, vectors = np.linalg.eigh((k[:m] + k[:m].T) / 2)
    root = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    z = np.hstack((k @ root, np.ones((len(words), 1))))
    share = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w = np.zeros(m + 1)
    ridge = np.diag([1.0] * m + [1e-6])
    for _ in range(25):
        active = y * (z @ w) < 1
        za, ca = z[active], share[active]
        new = np.linalg.solve(ridge + 2 * (za * ca[:, None]).T @ za, 2 * (za * ca[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    theta = np.zeros(CLASSES ** 3)
    theta[held] = (table @ (root @ w[:m]))[:-1]
    return theta, float(w[m])


def window_margins(texts: list[str], theta: np.ndarray, bias: float, most: int = 20_000) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """``text number, its windows, their margins`` for every text; a text of many windows comes in parts."""
    part, owners = [], []

    def settle():
        if part:
            m = margins(part, theta, bias)
            at = 0
            for i, n in owners:
                yield i, part[at:at + n], m[at:at + n]
                at += n

    for i, t in enumerate(texts):
        mine = windows(t)
        for a in range(0, len(mine), most):
            some = mine[a:a + most]
            part += some
            owners.append((i, len(some)))
            if len(part) >= most:
                yield from settle()
                part, owners = [], []
    yield from settle()


class WordMargins:
    """Margins of words, each distinct one computed once while it is remembered, and of windows."""

    def __init__(self, theta: np.ndarray, bias: float, window: tuple[np.ndarray, float] | None = None) -> None:
        self.theta, self.bias, self.window, self.known = theta, bias, window, {}

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text what its score sees: its worst words, its worst window, the log of its number of words."""
        words = self.worst(texts)
        top = np.full(len(texts), NONE)
        for i, _, m in window_margins(texts, *self.window):
            top[i] = max(top[i], m.max())
        return np.column_stack((words[:, :WORST], top, words[:, WORST:]))

    def worst(self, texts: list[str]) -> np.ndarray:
        """Per text: its ``WORST`` largest margins of distinct words, and the log of their number."""
        bags = []
        for t in texts:
            bag = set(t.lower().split())
            for m in _SPELLED.finditer(t):
                bag.add("".join(m[0].lower().split()))
            bags.append(bag)
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        new = list(set().union(*bags).difference(known)) if bags else []
        for a in range(0, len(new), 20_000):
            part = new[a:a + 20_000]
            known.update(zip(part, margins(part, self.theta, self.bias).tolist(), strict=True))
        out = np.full((len(texts), WORST + 1), NONE)
        for row, bag in zip(out, bags, strict=True):
            top = sorted(map(known.__getitem__, bag), reverse=True)[:WORST]
            row[:len(top)] = top
            row[WORST] = np.log1p(len(bag))
        return out


def _chunks(texts, most: int = 1 << 21):
    """Texts of an Arrow column in lists of about ``most`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1])
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (last: constant) of a ridge logistic regression by Newton steps, classes balanced."""
    x = np.hstack((x, np.ones((len(x), 1))))
    share = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y == 0).sum(), 1)))
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (share * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(c: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text divisible by 5, or no id."""
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(True))


def no_evidence() -> dict:
    """The model of no evidence: a score of about 0.27 for every text."""
    weights = np.zeros(FEATURES + 1)
    weights[-1] = -1.0
    return {"theta": np.zeros(CLASSES ** 3), "bias": 0.0, "window": (np.zeros(CLASSES ** 3), 0.0), "weights": weights}


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The scores of texts from their worst words."""
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model, from a bounded sample of the labelled rows that are not held out.

    ``docs`` has ``doc_id, text``; ``labels`` has ``doc_id, toxic``. Rows with
    a null label or id are left out. With one class only, or no telling word,
    there is no evidence: every text gets one score below 0.5. Of the texts of
    a repeated id the smallest is taken.
    """
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(rows["toxic"].isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [rows.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in enumerate(SAMPLE)]
    picked = F.broadcast(some[0].unionAll(some[1]))  # at most sum(SAMPLE) rows
    bound = staged(docs.join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    sizes = {r["toxic"]: r["count"] for r in bound.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return no_evidence()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                bag = {w.strip(".,;:!?\"'()") for w in text.as_py().lower().split()}
                bag = [w for w in bag if 3 <= len(w) <= 30]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(bag), pa.int64()), pa.array(bag, pa.string()),
                                                  pa.array([toxic] * len(bag), pa.int32())], names=["doc_id", "word", "toxic"])

    pairs = bound.select("doc_id", "toxic", "text").mapInArrow(words, schema("doc_id bigint, word string, toxic int"))
    counts = staged(pairs.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "words")
    odds = (F.col("t") / sizes[1]) / ((F.col("c") + 0.5) / sizes[0])
    often = counts.where((F.col("t") >= LEAST_ROWS) & (odds >= RATIO)).select("word", "t")
    held = pairs.where("toxic = 1").join(often, "word")
    most = held.groupBy("doc_id").agg(F.max("t").alias("most"))
    telling = (held.join(most, "doc_id").where(F.col("t") >= NEARLY * F.col("most")).groupBy("word", "t")
               .agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= LEAST_ROWS)
               .orderBy(F.col("t").desc(), "word").limit(TELLING).collect())
    common = counts.where("c > 0").where(odds < 2).select("word")
    ordinary = [r["word"] for r in common.orderBy(F.xxhash64("word"), "word").limit(ORDINARY).collect()]
    if not telling or not ordinary:
        return no_evidence()
    good = [r["word"] for r in telling]
    theta, bias = fit_words(good, ordinary)

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(margins(b.column(0).to_pylist(), theta, bias))], names=["word", "m"])

    for _ in range(HARD_ROUNDS):
        hard = common.mapInArrow(worst, schema("word string, m double")).orderBy(F.col("m").desc(), "word").limit(HARD).collect()
        ordinary = list(dict.fromkeys(ordinary + [r["word"] for r in hard]))
        theta, bias = fit_words(good, ordinary)

    rounds = fit_windows(bound, theta, bias)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the window machine that judges a labelled text here has not seen it
        known = [WordMargins(theta, bias, rounds[f]) for f in (0, 1)]
        for b in batches:
            for toxic, fold, text in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = known[fold].features([text])
                yield pa.RecordBatch.from_arrays([pa.array([toxic.as_py()], pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))],
                                                 names=["toxic", "x"])

    found = bound.select("toxic", _fold().alias("fold"), "text").mapInArrow(seen, schema("toxic int, x array<double>")).toPandas()
    x = np.stack([np.asarray(v) for v in found["x"]])
    return {"theta": theta, "bias": bias, "window": rounds[2], "weights": _logistic(x, found["toxic"].to_numpy(np.float64))}


def _fold() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int")


def fit_windows(bound: DataFrame, theta: np.ndarray, bias: float) -> list[tuple[np.ndarray, float]]:
    """Window machines of the labelled texts ``bound(doc_id, toxic, text)``: without fold 0, without fold 1, of all.

    A toxic text gives its worst window, a clean one its worst and one more; at
    first the worst is that of the worst word, then that of the machine before.
    The driver gets two windows a labelled text, a bounded number.
    """
    machine, no = None, set()
    for _ in range(WINDOW_ROUNDS):

        def pick(batches: Iterator[pa.RecordBatch], machine=machine) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for fold, toxic, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    mine = windows(text)
                    if not mine:
                        continue
                    if machine is None:
                        words = sorted(set(" ".join(mine).split()))
                        worst = words[int(np.argmax(margins(words, theta, bias)))]
                        at = next(i for i, w in enumerate(mine) if worst in w.split())
                    else:
                        at = int(np.argmax(margins(mine, *machine)))
                    rows.append((fold, toxic, mine[at], mine[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(mine)]))
                if rows:
                    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                     names=["fold", "toxic", "worst", "any"])

        got = bound.select(_fold().alias("fold"), "toxic", "text").mapInArrow(pick, schema("fold int, toxic int, worst string, any string"))
        got = sorted(got.collect())
        yes = [(r["fold"], r["worst"]) for r in got if r["toxic"]]
        for r in got:
            if not r["toxic"]:
                no.update({(r["fold"], r["any"]), (r["fold"], r["worst"])})
        machine = _fit_part(yes, no, None)
    return [_fit_part(yes, no, 0), _fit_part(yes, no, 1), machine]


def _fit_part(yes: list[tuple[int, str]], no: set[tuple[int, str]], without: int | None) -> tuple[np.ndarray, float]:
    good, plain = [w for f, w in yes if f != without], sorted({w for f, w in no if f != without})
    if not good or not plain:
        return np.zeros(CLASSES ** 3), NONE
    rng = np.random.default_rng(7)
    return fit_words([good[i] for i in rng.permutation(len(good))], plain, gapped=False)


def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score``: 0 to 1, higher for toxic; the text alone decides."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # CLASSES ** 3 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known, w = WordMargins(m["theta"], m["bias"], m["window"]), m["weights"]
        for b in batches:
            x = [known.features(part) for part in _chunks(b.column(1))]
            x = np.concatenate(x) if x else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probability(x, w))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema("doc_id bigint, score double"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Predicted toxic is a score of 0.5 or more; a model that found nothing to
    learn from scores below it. Null text counts as empty; a text without
    words gets the score of no evidence; a null id counts as held out;
    repeated rows score alike; an empty table gives no rows; other columns are
    not read.
    """
    rows = id_and_text(docs)
    scored = score_texts(rows, train(rows, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, columns as they were.

    A model that found nothing to learn from rejects none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(id_and_text(docs), labels))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known, w = WordMargins(m["theta"], m["bias"], m["window"]), m["weights"]
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                rows = b.slice(a, ROWS)
                x = [known.features(part) for part in _chunks(rows.column(at).fill_null(""))]
                yield rows.filter(pa.array(probability(np.concatenate(x), w) < 0.5))

    return docs.mapInArrow(run, docs.schema)
