"""Scores for abusive, hateful or sexual content, learnt from human verdicts.

The model is a bag of subwords: every character n-gram, word and pair of words
of a sentence has a vector, the vectors of a sentence are averaged and a linear
softmax gives the class. Vectors and classifier are trained together in numpy.
A misspelt word shares most n-grams with the right spelling, so it needs no
verdict of its own.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.canonical import canonical_array
from corvane.plans.batches import text_slices
from corvane.plans.spread import spread

#: The classes, first the one that isn't found.
CLASSES = ["clean", "abusive", "hateful", "sexual"]
#: Labelled documents (about) the model is fitted on, picked by a hash of the id: of each bad class, and clean ones. So many
#: clean ones are needed to outweigh the wrong verdicts on a rare kind of harmless sentence.
LABELLED_PER_CLASS, LABELLED_CLEAN = 2500, 12000
#: Clean documents whose sentences all take part in the fit; of the others only those take part that the first fit finds doubtful.
CLEAN_FIRST, DOUBTFUL = 1500, 0.05
BUCKETS, DIMS = 1 << 17, 16
NGRAMS = (3, 4, 5)
#: Passes of the first and the second fit.
EPOCHS = (8, 12)
RATE, BATCH = 0.2, 128
#: A feature marks bad texts if it is so many times as frequent in them as in clean ones.
LIFT = 4
#: Probability from which a text is flagged.
THRESHOLD = 0.35
#: Share of such features from which a sentence stands out however many verdicts there are.
MARKED = 0.15
#: Weight of a bad sentence against a clean one.
BAD_WEIGHT = 3.0

#: Signs written in place of letters.
_STAND_INS = str.maketrans({"@": "a", "$": "s", "€": "e", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "|": "i"})
_MARKS = re.compile("[̀-ͯ]")
_SENTENCE = re.compile(r"(?<=[.!?:;])[ \t]+|\n+")
_SPACED = re.compile(r"(?<![a-z])[a-z]([ ._*/-])[a-z](?:\1[a-z])+(?![a-z])")
_DISGUISED = re.compile(r"(?<![a-z@$€0-9|!])[a-z@$€0-9|]*(?:[a-z][@$€0-9|!]|[@$€|][a-z])[a-z@$€0-9|!]*")
_STRETCHED = re.compile(r"([a-z])\1{2,}")
_NO_LETTER = re.compile(r"[^\x00-\x7f\w]")
_SEP = re.compile(r"[ ._*/-]")
_ROW = "\x01"


def _undisguise(m: re.Match) -> str:
    word = m.group()
    tail = "!" * (len(word) - len(word.rstrip("!")))
    return word[: len(word) - len(tail)].translate(_STAND_INS).replace("!", "i") + tail


def normal_bytes(texts: pa.Array) -> np.ndarray:
    """All texts as one array of bytes: rows end at 1, sentences at 10, the rest is a-z, *, letters of other scripts in UTF-8 and others.

    Look-alikes, accents, spaced-out letters, signs in place of letters and
    stretched letters are brought to the plain spelling. Each pattern runs once
    over the whole batch, not once a row.
    """
    plain = canonical_array(texts.cast(pa.string()).fill_null(""))
    joined = _ROW.join(s.replace(_ROW, " ") for s in plain.to_pylist()) + _ROW
    joined = _MARKS.sub("", unicodedata.normalize("NFD", joined.lower())).replace("ß", "ss").replace("œ", "oe").replace("æ", "ae")
    joined = _SENTENCE.sub("\n", joined)
    joined = _SPACED.sub(lambda m: _SEP.sub("", m.group()), joined)
    joined = _DISGUISED.sub(_undisguise, joined)
    joined = _STRETCHED.sub(r"\1", joined)
    if not joined.isascii():
        joined = _NO_LETTER.sub("?", joined)
    return np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def _bucket(x: np.ndarray) -> np.ndarray:
    return (_scramble(x) % np.uint64(BUCKETS)).astype(np.int32)


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence of each feature, bucket of each feature, row of each sentence)."""
    row_end, line_end = data == 1, (data == 1) | (data == 10)
    sentence = (np.cumsum(line_end) - line_end).astype(np.int32)
    row_of = (np.cumsum(row_end) - row_end)[line_end]
    inside = ((data >= 97) & (data <= 122)) | (data == 42) | (data >= 128)
    code = np.where(inside, data, 0).astype(np.uint64)
    where, bucket = [], []
    with np.errstate(over="ignore"):
        rolled, ok = code, np.ones(len(code), bool)
        for n in range(2, max(NGRAMS) + 1):  # the hash of n signs follows from that of n - 1
            size = len(code) - n + 1
            if size < 1:
                break
            rolled = rolled[:size] * np.uint64(131) + code[n - 1 :]
            ok = ok[:size] & inside[n - 2 : n - 2 + size] if n > 2 else ok[:size]
            if n in NGRAMS:
                at = np.flatnonzero(ok)
                where.append(sentence[at + 1])
                bucket.append(_bucket(rolled[at] + np.uint64(n << 56)))
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if len(starts):
            place = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
            weight = _scramble(np.arange(64, dtype=np.uint64) + np.uint64(977))
            word = np.add.reduceat(np.where(inside, (code + np.uint64(1)) * weight[np.minimum(place, 63)], np.uint64(0)), starts)
            at = sentence[starts]
            where.append(at)
            bucket.append(_bucket(word))
            pair = at[1:] == at[:-1]
            where.append(at[1:][pair])
            bucket.append(_bucket(word[:-1][pair] * np.uint64(0x9E3779B97F4A7C15) + word[1:][pair]))
    if not where:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), row_of
    return np.concatenate(where), np.concatenate(bucket), row_of


@dataclass
class Model:
    """Vectors folded with the classifier: averaging and the linear map commute, so one row of class weights a bucket is enough to score."""

    weights: np.ndarray  # BUCKETS x classes
    bias: np.ndarray
    threshold: float = THRESHOLD

    def sentences(self, where: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Class probabilities of each sentence; one without features is clean."""
        count = np.bincount(where, minlength=n)
        z = np.stack([np.bincount(where, self.weights[bucket, c], n) for c in range(len(CLASSES))], 1) / np.maximum(count, 1)[:, None] + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        p[count == 0] = np.eye(len(CLASSES))[0]
        return p

    def rows(self, texts: pa.Array) -> np.ndarray:
        """Highest probability of each class over the sentences of each text; column 0 is the score 1 - clean."""
        where, bucket, row_of = features(normal_bytes(texts))
        p = self.sentences(where, bucket, len(row_of))
        p[:, 0] = 1 - p[:, 0]
        first = np.searchsorted(row_of, np.arange(len(texts)))
        return np.maximum.reduceat(p, first, axis=0) if len(texts) else np.zeros((0, len(CLASSES)))


def _fit(starts: np.ndarray, bucket: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword vectors and linear softmax, trained jointly by Adagrad on minibatches."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    linear = np.zeros((DIMS, len(CLASSES)), np.float32)
    bias = np.zeros(len(CLASSES), np.float32)
    seen = np.full(BUCKETS, 1e-6, np.float32)
    seen_l, seen_b = np.full(linear.shape, 1e-6, np.float32), np.full(bias.shape, 1e-6, np.float32)
    size = np.diff(starts)
    for epoch in range(epochs):
        order = rng.permutation(len(size))
        rate = RATE * (1 - epoch / epochs)
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            n = size[pick]
            ends = np.cumsum(n)
            ids = bucket[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(starts[pick], n)]
            hidden = np.add.reduceat(vectors[ids], ends - n, axis=0) / n[:, None]
            z = hidden @ linear + bias
            z = np.exp(z - z.max(1, keepdims=True))
            g = z / z.sum(1, keepdims=True)
            g[np.arange(len(pick)), label[pick]] -= 1
            g *= (weight[pick] / weight[pick].sum())[:, None]
            to_linear, to_hidden = hidden.T @ g, (g @ linear.T) / n[:, None]
            seen_l += to_linear**2
            seen_b += g.sum(0) ** 2
            linear -= rate * to_linear / np.sqrt(seen_l)
            bias -= rate * g.sum(0) / np.sqrt(seen_b)
            used, inverse = np.unique(ids, return_inverse=True)
            by = np.argsort(inverse, kind="stable")
            owner = np.repeat(np.arange(len(pick)), n)[by]
            cut = np.concatenate([[0], np.cumsum(np.bincount(inverse))[:-1]])
            step = np.add.reduceat(to_hidden[owner], cut, axis=0)
            seen[used] += (step**2).mean(1)
            vectors[used] -= rate * step / np.sqrt(seen[used])[:, None]
    return (vectors @ linear).astype(np.float64), bias.astype(np.float64)


class _Sentences:
    """Sentences of labelled texts whose features are kept: features, target class, weight and identity of each."""

    def __init__(self):
        self.buckets: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []

    def add(self, bucket: np.ndarray, size: np.ndarray, number: np.ndarray) -> None:
        """Sentences by their ``number``, with features one after the other."""
        self.buckets.append(bucket)
        self.sizes.append(size)
        self.numbers.append(number)

    @property
    def number(self) -> np.ndarray:
        return np.concatenate(self.numbers) if self.numbers else np.zeros(0, int)

    def chosen(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and features of some sentences, by place."""
        bucket, size = np.concatenate(self.buckets), np.concatenate(self.sizes)
        begin, n = (np.cumsum(size) - size)[some], size[some]
        ends = np.cumsum(n)
        flat = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(begin, n)
        return np.concatenate([[0], ends]), bucket[flat]

    def fit(self, target: np.ndarray, weight: np.ndarray, same: np.ndarray, use: np.ndarray, seed: int, epochs: int) -> Model | None:
        """Each distinct sentence once per class, weighted by the square root of its number."""
        _, at, inverse = np.unique((same * len(CLASSES) + target)[use], return_index=True, return_inverse=True)
        pick = np.flatnonzero(use)[at]
        if not (target[pick] != 0).any():
            return None
        mass = np.sqrt(np.bincount(inverse, weight[use])).astype(np.float32)
        mass[target[pick] != 0] *= BAD_WEIGHT
        starts, bucket = self.chosen(pick)
        return Model(*_fit(starts, bucket, target[pick], mass, seed, epochs))

    def bad(self, model: Model | None) -> np.ndarray:
        if model is None:
            return np.zeros(len(self.number))
        starts, bucket = self.chosen(np.arange(len(self.number)))
        n = len(starts) - 1
        return 1 - model.sentences(np.repeat(np.arange(n), np.diff(starts)), bucket, n)[:, 0]


@dataclass
class _Labelled:
    """Normalised labelled texts in pieces; features are made anew for each pass, so memory follows a piece."""

    pieces: list[tuple[int, np.ndarray]]  # first row, bytes
    labels: np.ndarray
    stands_for: np.ndarray

    def passes(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(sentence of each feature, bucket of each feature, row of each sentence), features in order of sentences."""
        for row, data in self.pieces:
            where, bucket, row_of = features(data)
            order = np.argsort(where, kind="stable")
            yield where[order], bucket[order], row_of + row

    def novelty(self) -> tuple[np.ndarray, float]:
        """Share of each sentence's features that mark bad texts, and the share that clean sentences stay below.

        A feature marks bad texts if it is LIFT times as frequent in them as in
        clean ones, and found in more of them. Texts count for as many as they
        were drawn from. The limit is what 99 of 100 sentences of clean texts
        keep under when their own text is counted as a bad one, with some
        distance where many verdicts make that share small.
        """
        labels, stands_for = self.labels, self.stands_for
        of_clean, of_bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for where, bucket, row_of in self.passes():
            pairs = np.sort(row_of[where].astype(np.int64) * BUCKETS + bucket)
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
            text, feature = pairs // BUCKETS, pairs % BUCKETS
            of_clean += np.bincount(feature, stands_for[text] * (labels[text] == 0), BUCKETS)
            of_bad += np.bincount(feature, stands_for[text] * (labels[text] != 0), BUCKETS)
        clean, bad = stands_for[labels == 0].sum(), stands_for[labels != 0].sum()
        own = clean / (labels == 0).sum()
        marks = [((of_bad + more) * clean > LIFT * (of_clean - more * own) * bad) & (of_bad + more > of_clean - more * own) for more in (0, 1)]
        shares, usual = [], []
        for where, bucket, row_of in self.passes():
            size = np.maximum(np.bincount(where, minlength=len(row_of)), 1)
            shares.append(np.bincount(where, marks[0][bucket], len(row_of)) / size)
            usual.append((np.bincount(where, marks[1][bucket], len(row_of)) / size)[labels[row_of] == 0])
        usual = np.concatenate(usual)
        return np.concatenate(shares), max(float(np.quantile(usual, 0.99)), min(2 * float(np.quantile(usual, 0.995)), MARKED))


def train(texts: list[str], labels: np.ndarray, *, totals: dict[int, int] | None = None, epochs: tuple[int, int] = EPOCHS, seed: int = 5) -> Model:
    """Fit on texts with class numbers, at the level of sentences.

    A verdict holds for a whole text of which often one sentence is to blame,
    and some verdicts are wrong. At first those sentences of texts judged bad
    carry the class that hold more features marking bad texts than clean
    sentences ever do; texts judged bad without such a sentence are taken as
    wrong verdicts and left out. The first fit takes the clean sentences of
    ``CLEAN_FIRST`` texts. After it, sentences of bad texts that the model finds
    bad are added, sentences of all other clean texts that it doubts are added
    as clean ones, and those it is sure about that also hold features marking
    bad texts are left out; the second fit gives the model. ``totals`` are the
    numbers of judged texts of each class where the texts are a sample with
    other shares. Without verdicts of both kinds every text scores 0.
    """
    nothing = Model(np.zeros((BUCKETS, len(CLASSES))), np.array([50.0, 0, 0, 0]))
    if not len(labels) or labels.min() == labels.max():
        return nothing
    have = np.bincount(labels, minlength=len(CLASSES))
    stands_for = np.array([(totals or {}).get(c, n) / max(1, n) for c, n in enumerate(have)])[labels]
    array = pa.array(texts, pa.string())
    data = _Labelled([(lo, normal_bytes(array.slice(lo, n))) for lo, n in text_slices(array, limit=1 << 20)], labels, stands_for)
    novelty, limit = data.novelty()
    clean = np.flatnonzero(labels == 0)
    early = np.zeros(len(labels), bool)
    early[clean[np.linspace(0, len(clean) - 1, min(len(clean), CLEAN_FIRST)).astype(int)]] = True
    kept, rows, names, sizes = _Sentences(), [], [], []
    first = 0
    for where, bucket, row_of in data.passes():
        size = np.bincount(where, minlength=len(row_of))
        # equal sentences are known by the sum of their features' hashes
        name, some = np.zeros(len(row_of), np.uint64), np.flatnonzero(size)
        with np.errstate(over="ignore"):
            if len(some):
                name[some] = np.add.reduceat(_scramble(bucket.astype(np.uint64) + np.uint64(1)), (np.cumsum(size) - size)[some])
        wanted = (labels[row_of] != 0) | early[row_of]
        stays = np.flatnonzero(wanted & (size > 0))
        kept.add(bucket[wanted[where]], size[stays], first + stays)
        rows.append(row_of)
        names.append(name)
        sizes.append(size)
        first += len(row_of)
    row, size = np.concatenate(rows), np.concatenate(sizes)
    if not size.any():
        return nothing
    same = np.unique(np.concatenate(names), return_inverse=True)[1]
    label = labels[row]
    n_clean, n_bad = (np.bincount(same, stands_for[row] * at * (size > 0)) for at in (label == 0, label != 0))
    guilty = (label != 0) & (novelty > limit) & (n_bad > n_clean)[same] & (size > 0)

    def fit(seed: int, passes: int, taken: np.ndarray) -> Model | None:
        judged = np.zeros(len(labels), bool)
        judged[row[guilty]] = True
        at = kept.number
        use = np.where(label[at] != 0, judged[row[at]], taken[at])
        return kept.fit(np.where(guilty, label, 0)[at], stands_for[row[at]], same[at], use, seed, passes)

    taken = early[row]
    model = fit(seed, epochs[0], taken)
    bad = np.zeros(len(row))
    bad[kept.number] = kept.bad(model)
    guilty |= (label != 0) & (bad >= 0.5)
    first = 0
    for where, bucket, row_of in data.passes():  # the other clean texts
        n = len(row_of)
        if model is not None:
            p = 1 - model.sentences(where, bucket, n)[:, 0]
            doubt = (p > DOUBTFUL) & (label[first : first + n] == 0) & ~early[row_of]
            kept.add(bucket[doubt[where]], np.bincount(where, minlength=n)[doubt], first + np.flatnonzero(doubt))
            taken[first : first + n] |= doubt
            bad[first : first + n][doubt] = p[doubt]
        first += n
    taken &= ~((label == 0) & (bad > 0.8) & (novelty > limit))
    return fit(seed + 1, epochs[1], taken) or nothing


_MODELS: dict[str, Model] = {}


def trained(texts: list[str], labels: np.ndarray, *, totals: dict[int, int] | None = None, fresh: bool = False) -> Model:
    """``train`` with its defaults; unless ``fresh``, the model last fitted is taken if it is of the same verdicts."""
    digest = hashlib.sha256(repr((labels.tolist(), sorted((totals or {}).items()))).encode())
    for t in texts:
        digest.update(hashlib.sha256(t.encode()).digest())
    name = digest.hexdigest()
    if fresh or name not in _MODELS:
        _MODELS.clear()  # one at a time: a model takes 4 MB
        _MODELS[name] = train(texts, labels, totals=totals)
    return _MODELS[name]


def verdicts(reviews: DataFrame, documents: DataFrame, *, per_class: int = LABELLED_PER_CLASS, clean: int = LABELLED_CLEAN, key: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray, dict[int, int]]:
    """Texts and class numbers of about ``per_class`` reviewed documents of each bad class and ``clean`` clean ones, and all such documents' number.

    The class most reviewers gave wins; documents on which they are split are
    left out, as are unknown and null categories.
    """
    known = reviews.filter(F.col("category").isin(CLASSES) & F.col(key).isNotNull()).groupBy(key, "category").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    top = known.withColumn("most", F.max("n").over(w)).filter(F.col("n") == F.col("most"))
    clear = top.withColumn("ways", F.count(F.lit(1)).over(w)).filter(F.col("ways") == 1).select(key, "category")
    have = {r["category"]: r["count"] for r in clear.groupBy("category").count().collect()}  # one row a class
    span = 1 << 30
    share = F.lit(0)
    for c, n in have.items():
        share = F.when(F.col("category") == c, int(span * min(1.0, (clean if c == CLASSES[0] else per_class) / n))).otherwise(share)
    sample = clear.filter(F.pmod(F.xxhash64(key), F.lit(span)) < share)
    t = documents.select(key, F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(sample), key).select(key, "text", "category").toArrow().sort_by(key)
    return t.column("text").to_pylist(), np.array([CLASSES.index(c) for c in t.column("category").to_pylist()], int), {CLASSES.index(c): n for c, n in have.items()}


def score(documents: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(``key``, *``keep``, ``score``, ``category``, ``flagged``): one row per document, no shuffle.

    The score is the highest probability, over the sentences of the whole text,
    of not being clean; ``category`` the likeliest bad class, null where not
    flagged. Null and empty texts score 0.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x 4 numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            out = np.zeros((b.num_rows, len(CLASSES)))
            for lo, n in text_slices(texts):
                out[lo : lo + n] = m.rows(texts.slice(lo, n))
            flagged = out[:, 0] >= m.threshold
            category = np.where(flagged, np.array(CLASSES, object)[1 + out[:, 1:].argmax(1)], None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out[:, 0]), pa.array(category, pa.string()), pa.array(flagged)], [*b.schema.names[:-1], "score", "category", "flagged"])

    source = spread(documents, key).select(key, *keep, F.col(text).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, f"{kept}, score double, category string, flagged boolean")


def rates(scored: DataFrame, by: str = "source") -> DataFrame:
    """(``by``, ``documents``, ``flagged``, ``rate``, one count per class); a null group is a group."""
    counts = [F.sum(F.when(F.col("category") == c, 1).otherwise(0)).cast("bigint").alias(c) for c in CLASSES[1:]]
    flagged = F.sum(F.when(F.col("flagged"), 1).otherwise(0)).cast("bigint")
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), flagged.alias("flagged"), (flagged / F.count(F.lit(1))).alias("rate"), *counts)
