"""Toxicity by a classifier chain of linear models over hashed words and word beginnings.

The categories are columns of labels, predicted one after another. The model of a category sees how densely words and
word beginnings stand in a text, and the probabilities of the categories before it. While training, those are
out-of-fold predictions, made by models that have not seen the row, so that a later model does not rely on its
predecessors' memory of their training rows.

A feature's value is its share of the text's words times ``DENSE``, one at most: an insult in every fiftieth word counts
fully, a chance hit in a long text hardly. Insults that are built from a common beginning and many endings are known by the beginning.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, checkpointed, kept_rows, keyed_text

#: Labelled rows that models are fitted on at most; the rows with the smallest hashes of their ids are taken.
TRAIN_ROWS = 8_000
#: Words and word beginnings are hashed to so many numbers, of which a model uses the most telling.
HASH_BITS = 20
USED_FEATURES = 4_096
#: Features that leave the executors at most, those of the highest chi-squared over any category and folds.
CANDIDATES = 32_768
#: The least chi-squared of a used feature: words that fall so unevenly by chance are one in twenty; the ridge holds them down.
LEAST_CHI = 4.0
FOLDS = 3
#: Letters of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)
#: A feature of one word in so many has the value one.
DENSE = 50.0
WORD = re.compile(r"\w+")
#: Words whose features a worker keeps.
CACHE_WORDS = 150_000


def features_of(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its shorter beginnings."""
    mask = (1 << HASH_BITS) - 1
    parts = [word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)]
    return tuple({xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) & mask for x in parts})


def text_features(text: str) -> dict[int, float]:
    """The value of each feature that a text has."""
    found: dict[int, int] = {}
    words = Counter(WORD.findall(text.lower()))
    for word, times in words.items():
        for f in features_of(word):
            found[f] = found.get(f, 0) + times
    total = words.total()
    return {f: min(1.0, DENSE * found[f] / total) for f in sorted(found)}


@dataclass
class Linear:
    """Logistic model: weights of some hashed features, of earlier probabilities, and a constant."""

    used: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def chi_squared(mass: np.ndarray, hit: np.ndarray, n: int, share: float) -> np.ndarray:
    """How far the values' mass in labelled rows is from what the label's share lets expect."""
    expected = mass * share
    return (hit - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - mass / max(1, n)), 1e-9)


def telling(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The features with the highest chi-squared against the labels, of those in three rows or more and above LEAST_CHI; ties to the lower number."""
    size = 1 << HASH_BITS
    mass = np.bincount(ids, weights=values, minlength=size)
    hit = np.bincount(ids, weights=values * y[rows], minlength=size)
    chi = chi_squared(mass, hit, len(y), max(float(y.mean()) if len(y) else 0.0, 1e-9))
    chi[np.bincount(ids, minlength=size) < 3] = 0
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(best[chi[best] >= LEAST_CHI])


def fit(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, chain: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 3e-4) -> Linear:
    """Full-batch Adam on the mean log loss with a ridge, rare class and common class weighing alike."""
    n = len(y)
    used = telling(rows, ids, values, y, USED_FEATURES)
    at = np.searchsorted(used, ids)
    ok = (at < len(used)) & (used[np.minimum(at, max(0, len(used) - 1))] == ids) if len(used) else np.zeros(len(ids), bool)
    r, c, x = rows[ok], at[ok], values[ok]
    size = len(used) + chain.shape[1] + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
    weigh = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / max(1, n)
    w[-1] = 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(r, weights=x * w[c], minlength=n) + chain @ w[len(used) : -1] + w[-1]
        d = (sigmoid(z) - y) * weigh
        g = np.concatenate([np.bincount(c, weights=x * d[r], minlength=len(used)), chain.T @ d, [d.sum()]]) + ridge * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Linear(used, w[: len(used)], w[len(used) : -1], float(w[-1]))


def predict(model: Linear, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, chain: np.ndarray, n: int) -> np.ndarray:
    z = np.full(n, model.bias)
    if len(model.used):
        at = np.minimum(np.searchsorted(model.used, ids), len(model.used) - 1)
        ok = model.used[at] == ids
        z += np.bincount(rows[ok], weights=values[ok] * model.weights[at[ok]], minlength=n)
    return sigmoid(z + chain @ model.chain)


def best_threshold(p: np.ndarray, y: np.ndarray, low: float = 0.1, high: float = 0.5) -> float:
    """Where out-of-fold probabilities part best, a false alarm counting three times its share; in the middle of a gap.

    ``high`` where either class is missing.
    """
    if not (y > 0).any() or not (y <= 0).any():
        return high
    marks = np.unique(np.concatenate([p[(p > low) & (p < high)], [low, high]]))
    worth = np.array([(p[y > 0] >= t).mean() - 3 * (p[y <= 0] >= t).mean() for t in marks])
    best = marks[worth >= worth.max() - 1e-12]
    below = p[p < best.max()]
    floor = max(low, float(below.max())) if len(below) else low
    return float((best.max() + floor) / 2) if floor <= best.max() else float(best.max())


@dataclass
class Chain:
    """The models, in order, and from which probability on the last category holds."""

    models: list[Linear]
    threshold: float


Features = dict[int, float] | Sequence[int] | tuple[np.ndarray, np.ndarray]


def arrays_of(features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Features' numbers and values; those without values count as ones."""
    if isinstance(features, tuple):
        return features
    ids = np.fromiter(features, np.int32, len(features))
    return ids, np.fromiter(features.values(), np.float64, len(features)) if isinstance(features, dict) else np.ones(len(features))


def fit_chain(features: Sequence[Features], labels: np.ndarray, folds: int = FOLDS, fold: np.ndarray | None = None) -> Chain:
    """One model per column of ``labels``, each fed with out-of-fold predictions of those before it.

    ``fold`` is each row's fold, by default dealt in turn.
    """
    n = len(features)
    valued = [arrays_of(f) for f in features]
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(ids) for ids, _ in valued])
    ids = np.concatenate([ids for ids, _ in valued]) if n else np.zeros(0, np.int32)
    values = np.concatenate([values for _, values in valued]) if n else np.zeros(0)
    fold = np.arange(n) % folds if fold is None else fold
    chain = np.zeros((n, 0))
    models = []
    for column in range(labels.shape[1]):
        y = labels[:, column].astype(float)
        models.append(fit(rows, ids, values, chain, y))
        out = np.zeros(n)
        for k in range(folds):
            train, test = fold != k, fold == k
            place = np.cumsum(train) - 1
            inside = train[rows]
            model = fit(place[rows[inside]], ids[inside], values[inside], chain[train], y[train])
            where = np.cumsum(test) - 1
            outside = test[rows]
            out[test] = predict(model, where[rows[outside]], ids[outside], values[outside], chain[test], int(test.sum()))
        chain = np.column_stack([chain, out])
    return Chain(models, best_threshold(chain[:, -1], labels[:, -1]))


class Scorer:
    """Applies a chain to texts; keeps, for each word, the features that some model uses."""

    def __init__(self, models: Sequence[Linear]) -> None:
        self.models = models
        self.tables = [dict(zip(m.used.tolist(), m.weights.tolist(), strict=True)) for m in models]
        self.any = set().union(*(t.keys() for t in self.tables))
        self.kept: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        found = self.kept.get(word)
        if found is None:
            found = tuple(f for f in features_of(word) if f in self.any)
            if len(self.kept) >= CACHE_WORDS:
                self.kept.clear()
            if len(word) < 64:
                self.kept[word] = found
        return found

    def score(self, text: str) -> list[float]:
        found: dict[int, int] = {}
        words = Counter(WORD.findall(text.lower()))
        for word, times in words.items():
            for f in self.of(word):
                found[f] = found.get(f, 0) + times
        total = words.total()
        values = [(f, min(1.0, DENSE * found[f] / total)) for f in sorted(found)]
        out: list[float] = []
        for model, table in zip(self.models, self.tables, strict=True):
            z = model.bias + sum(table[f] * v for f, v in values if f in table) + sum(a * b for a, b in zip(model.chain.tolist(), out, strict=True))
            out.append(float(sigmoid(np.array(z))))
        return out


def candidates(rows: DataFrame, n_categories: int, folds: int) -> np.ndarray:
    """The CANDIDATES features that tell most, over some category and all rows or all but one fold; sorted.

    ``rows`` are (features, values, fold, y0, y1...). Partitions add up values per feature, fold and labels first.
    """
    kinds = folds << n_categories
    schema = "feature int, kind int, n int, mass double"
    arrow = arrow_schema(rows.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for features, values, fold, *ys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = fold << n_categories | sum(y << i for i, y in enumerate(ys))
                n, mass = found.setdefault(kind, [np.zeros(1 << HASH_BITS, np.int32), np.zeros(1 << HASH_BITS)])
                at = np.frombuffer(features, "<i4")
                n[at] += 1
                mass[at] += np.frombuffer(values, "<f8")
        for kind, (n, mass) in found.items():
            at = np.flatnonzero(n)
            for a in range(0, len(at), 1 << 16):
                part = at[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(len(part), kind), pa.int32()), pa.array(n[part], pa.int32()), pa.array(mass[part], pa.float64())], schema=arrow)

    labels = [F.col(f"y{i}") for i in range(n_categories)]
    of_kind = sum((y * (1 << i) for i, y in enumerate(labels)), F.col("fold") * (1 << n_categories))
    sizes = np.zeros(kinds)
    for r in rows.groupBy(of_kind.alias("kind")).count().collect():
        sizes[r["kind"]] = r["count"]
    sums = rows.mapInArrow(work, schema).groupBy("feature").agg(*(F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(kinds) for c in ("n", "mass")))
    chis = []
    for category in range(n_categories):
        for left_out in range(-1, folds):
            some = [k for k in range(kinds) if k >> n_categories != left_out]
            marked = [k for k in some if k >> category & 1]
            n = sizes[some].sum()
            share = max(sizes[marked].sum() / n if n else 0.0, 1e-9)
            mass, hit, rows_with = (sum((F.col(f"{c}{k}") for k in of), F.lit(0.0)) for c, of in (("mass", some), ("mass", marked), ("n", some)))
            expected = mass * float(share)
            spread = F.greatest(expected * float(1 - share) * (1 - mass / float(max(1, n))), F.lit(1e-9))
            chis.append(F.when(rows_with >= 3, F.pow(hit - expected, 2) / spread).otherwise(0.0))
    best = sums.select("feature", F.greatest(*chis, F.lit(0.0)).alias("chi")).where(F.col("chi") >= 0.999 * LEAST_CHI).orderBy(F.desc("chi"), "feature").limit(CANDIDATES)
    return np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int32))


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """The chain for 0/1 columns of ``labels``, fitted on ``train_rows`` labelled rows at most.

    Rows with a null id or label are left out. A repeated id is one row, with its greatest labels and its first text in
    order, so ties can't change the outcome. Without labelled rows every probability is a half. The driver gets ``train_rows`` rows
    with the values of at most ``CANDIDATES`` features each.
    """
    columns = [f"y{i}" for i in range(len(categories))]
    chosen = labels.select(F.col(id_col).alias("doc_id"), *(F.col(c).cast("int").alias(y) for c, y in zip(categories, columns, strict=True))).dropna()
    one = chosen.groupBy("doc_id").agg(*(F.max(y).alias(y) for y in columns))
    # Bounded by train_rows, so the broadcast is.
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = keyed_text(docs, id_col, text_col).join(F.broadcast(some), "doc_id").groupBy("doc_id", *columns).agg(F.min("text").alias("text"))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, *ys in rows:
            found = text_features(text)
            yield doc_id, np.fromiter(found, "<i4").tobytes(), np.fromiter(found.values(), "<f8").tobytes(), xxhash.xxh64_intdigest(str(doc_id)) % FOLDS, *(int(y > 0) for y in ys)

    kinds = ", ".join(f"{c} int" for c in columns)
    rows = checkpointed(arrow_rows(texts.select("doc_id", "text", *columns), f"doc_id long, features binary, values binary, fold int, {kinds}", run))
    kept = candidates(rows.select("features", "values", "fold", *columns), len(columns), FOLDS)

    def narrowed(parts: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, features, values, *rest in parts:
            ids = np.frombuffer(features, "<i4")
            ok = np.isin(ids, kept, assume_unique=True)
            yield doc_id, ids[ok].tobytes(), np.frombuffer(values, "<f8")[ok].tobytes(), *rest

    found = arrow_rows(rows, f"doc_id long, features binary, values binary, fold int, {kinds}", narrowed).collect()
    found.sort(key=lambda r: r["doc_id"])
    features = [(np.frombuffer(r["features"], "<i4"), np.frombuffer(r["values"], "<f8")) for r in found]
    return fit_chain(features, np.array([[r[c] for c in columns] for r in found], dtype=float).reshape(len(found), len(columns)), fold=np.array([r["fold"] for r in found], np.int64))


def toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"), *, threshold: float | None = None, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., <last category> boolean) of every whole text, by a chain fitted on ``labels``.

    The last category holds from ``threshold`` on; by default that is where out-of-fold predictions part best. Null
    and empty texts have no words: they get the models' constants and are never toxic.
    Repeated rows give repeated results, an empty table gives none, other columns are left aside.
    """
    chain = train(docs, labels, categories, train_rows=train_rows, id_col=id_col, text_col=text_col)
    least = chain.threshold if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(chain.models)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        scorer = Scorer(shared.value)
        for doc_id, text in rows:
            out = scorer.score(text)
            yield doc_id, *out, bool(text.strip()) and out[-1] >= least

    return arrow_rows(keyed_text(docs, id_col, text_col), f"doc_id long, {', '.join(f'p_{c} double' for c in categories)}, {categories[-1]} boolean", run)


def keep_civil(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"), *, threshold: float | None = None, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``toxicity`` does not call toxic.

    Null, empty and wordless texts stay; repeated rows stay or go together; an empty table gives none; a column of ``docs`` named
    like a category is left as it is.
    """
    chain = train(docs, labels, categories, train_rows=train_rows, id_col=id_col, text_col=text_col)
    least = chain.threshold if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(chain.models)
    scorers: list[Scorer] = []

    def keeps(texts: Iterator[str]) -> Iterator[bool]:
        if not scorers:
            scorers.append(Scorer(shared.value))
        return (not text.strip() or scorers[0].score(text)[-1] < least for text in texts)

    return kept_rows(docs, keeps, text_col)
