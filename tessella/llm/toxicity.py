"""Toxicity by a classifier chain over hashed words.

The categories are predicted one after the other. Each linear model sees the words of a document
and the chances that the models before it gave; for training those chances are out of fold, so
that a later model learns how far an earlier one can be trusted on documents it has not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Production parameters: buckets of hashed words, most labelled rows of either class used for the fit, folds, steps, and the decision.
BUCKETS, MAX_ROWS, FOLDS, STEPS, RATE, RIDGE, THRESHOLD = 1 << 20, 4_000, 3, 120, 0.3, 3e-4, 0.5
#: A bucket counts as a feature if it leans on a category beyond chance: its chi-square is at least this share of the rows, held between two bounds.
CHI2_SHARE, CHI2_BOUNDS = 0.15, (30.0, 60.0)
#: Least documents of the category that hold a feature, most features; lengths of word beginnings.
LEAST_DOCS, MAX_FEATURES, STEMS = 4, 2_000, (4, 5, 6, 7)
#: A language is a category of its own from so many toxic labelled documents on; at most so many languages are.
LEAST_TOXIC, MAX_LANGS = 2, 32
CACHE = 400_000
WORD = regex.compile(r"\p{L}+")


def categories(toxic: np.ndarray, poor: np.ndarray, langs: list[str | None]) -> tuple[tuple[str, ...], np.ndarray]:
    """The chain in order, and a 0/1 label of each row for each category.

    First comes low quality, by the quality labels; then toxicity in each language that has
    labelled examples, whose words a rarer language would otherwise lose to a commoner one;
    last toxicity itself, the label that counts.
    """
    names = np.asarray([regex.sub(r"\W", "_", lang or "") for lang in langs], object)
    found, counts = np.unique(names[(toxic == 1) & (names != "")].astype(str), return_counts=True)
    kept = sorted(found[np.argsort(-counts, kind="stable")][: int(np.sum(np.sort(counts)[::-1][:MAX_LANGS] >= LEAST_TOXIC))].tolist())
    columns = [poor, *[(toxic == 1) & (names == lang) for lang in kept], toxic]
    return ("low_quality", *[f"toxic_{lang}" for lang in kept], "toxic"), np.column_stack(columns).astype(float)


class Buckets(dict):
    """The buckets of a lower-case word: of the whole word, and of its first letters."""

    def __init__(self, buckets: int, slot: np.ndarray | None = None):
        super().__init__()
        self.buckets = buckets
        self.slot = None if slot is None else {int(b): int(slot[b]) for b in np.flatnonzero(slot >= 0)}

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHE:
            self.clear()
        names = [word + " ", *[word[:n] for n in STEMS if len(word) > n]]
        found = [zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.buckets for name in names]
        if self.slot is not None:
            found = [self.slot[k] for k in found if k in self.slot]
        self[word] = found
        return found


def features(text: str, table: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets (or features, if the table has slots) of a text, and log(1 + how often)."""
    found = [k for word in WORD.findall(text.lower()) for k in table[word]]
    keys, counts = np.unique(np.asarray(found, np.int64), return_counts=True)
    return keys, np.log1p(counts)


Rows = list[tuple[np.ndarray, np.ndarray]]


def _stack(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, feature and value of every entry."""
    at = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
    return at, np.concatenate([*(k for k, _ in rows), np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*(v for _, v in rows), np.empty(0)])


def _sigmoid(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -60, 60)))


@dataclass(frozen=True)
class Chain:
    """`slot` maps a bucket to a feature or -1; weights has a row per category: features, earlier chances, bias."""

    names: tuple[str, ...]
    slot: np.ndarray
    weights: tuple[np.ndarray, ...]

    def chances(self, rows: Rows) -> np.ndarray:
        """A row per document, a column per category."""
        n = int(self.slot.max()) + 1
        at, cols, values = _stack(rows)
        out = np.zeros((len(rows), len(self.names)))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(np.bincount(at, w[cols] * values, len(rows)) + out[:, :k] @ w[n : n + k] + w[-1])
        return out


def _linear(rows: Rows, n: int, extra: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by full-batch steps, either class of equal weight; weights of features, of extra columns, bias."""
    at, cols, values = _stack(rows)
    share = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    docs, k = len(y), extra.shape[1]
    w, m, v = np.zeros(n + k + 1), np.zeros(n + k + 1), np.zeros(n + k + 1)
    ridge = np.append(np.full(n + k, RIDGE), 0)
    for t in range(1, STEPS + 1):
        error = (_sigmoid(np.bincount(at, w[cols] * values, docs) + extra @ w[n : n + k] + w[-1]) - y) * share
        grad = np.concatenate([np.bincount(cols, error[at] * values, n), extra.T @ error, [error.sum()]]) + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def train(texts: list[str], labels: np.ndarray, names: tuple[str, ...], buckets: int = BUCKETS, folds: int = FOLDS) -> Chain:
    """Fit the chain on a bounded sample; `labels` has a column per category, in chain order.

    Features are chosen by chi-square on the sample. Without rows, or where a category has a
    single class, its model is a bias alone. Folds deal out the rows of each set of labels in turn.
    """
    table, n = Buckets(buckets), len(texts)
    docs = [features(t, table) for t in texts]
    count = lambda some: np.bincount(_stack([docs[i] for i in np.flatnonzero(some)])[1], minlength=buckets)
    df, chi2 = count(np.ones(n)), np.zeros(buckets)
    for k in range(len(names)):
        yes = float(labels[:, k].sum()) if n else 0.0
        if 0 < yes < n:
            both = count(labels[:, k])
            lean = both * (n - yes - (df - both)) - (df - both) * (yes - both)
            # Only buckets that enough documents of the category hold: few documents share many words by chance.
            chi2 = np.maximum(chi2, (both >= LEAST_DOCS) * n * lean**2.0 / np.maximum(1, df * (n - df) * yes * (n - yes)))
    chosen = np.flatnonzero(chi2 >= np.clip(CHI2_SHARE * n, *CHI2_BOUNDS))
    chosen = np.sort(chosen[np.argsort(-chi2[chosen], kind="stable")][:MAX_FEATURES])
    slot = np.full(buckets, -1, np.int64)
    slot[chosen] = np.arange(len(chosen))
    rows = [(slot[k][slot[k] >= 0], v[slot[k] >= 0]) for k, v in docs]
    fold, out, weights = np.empty(n, np.int64), np.zeros((n, 0)), []
    fold[np.lexsort(labels.T) if n else []] = np.arange(n) % folds
    pick = lambda some: [rows[i] for i in np.flatnonzero(some)]
    for k in range(len(names)):
        y = labels[:, k].astype(float) if n else np.zeros(0)
        if not n or y.min() == y.max():
            weights.append(np.append(np.zeros(len(chosen) + k), 4.0 * (2 * y[0] - 1) if n else -4.0))
            out = np.column_stack([out, y])
            continue
        weights.append(_linear(rows, len(chosen), out, y))
        own = np.zeros(n)
        for f in range(min(folds, n)):
            held = fold == f
            w = _linear(pick(~held), len(chosen), out[~held], y[~held])
            at, cols, values = _stack(pick(held))
            own[held] = _sigmoid(np.bincount(at, w[cols] * values, int(held.sum())) + out[held] @ w[len(chosen) : -1] + w[-1])
        out = np.column_stack([out, own])
    return Chain(tuple(names), slot, tuple(weights))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray, tuple[str, ...]]:
    """Texts, category labels and category names of at most `max_rows` labelled documents of either class, the first by a hash of their ids.

    An id labelled more than once is toxic if any of its labels says so, and of low quality
    likewise. Labels without an id or a toxicity are left out; a text given twice in the sample
    counts once. Without a column `lang` (or `quality`) those categories have no rows.
    """
    quality = F.col("quality") if "quality" in labels.columns else F.lit(None).cast("int")
    marked = labels.select(F.col("doc_id").alias("__id"), (F.col("toxic") == 1).cast("int").alias("__toxic"), (quality == 0).cast("int").alias("__poor"))
    marked = marked.where("__id is not null and __toxic is not null").groupBy("__id").agg(F.max("__toxic").alias("__toxic"), F.coalesce(F.max("__poor"), F.lit(0)).alias("__poor"))
    order = [F.xxhash64("__id"), F.col("__id")]
    some = marked.where("__toxic = 1").orderBy(*order).limit(max_rows).unionByName(marked.where("__toxic = 0").orderBy(*order).limit(max_rows))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), lang.alias("__lang"))
    # The sample's size is bounded by max_rows, so its ids may be broadcast.
    met = base.join(F.broadcast(some), "__id").orderBy(F.xxhash64("__id"), "__id", "__text", "__lang").limit(2 * max_rows)
    got = {r["__text"]: r for r in reversed(met.collect())}
    rows = [got[text] for text in reversed(list(got))]
    names, found = categories(np.asarray([r["__toxic"] for r in rows], float), np.asarray([r["__poor"] for r in rows], float), [r["__lang"] for r in rows])
    return [r["__text"] for r in rows], found, names


def _run(chain: Chain, threshold: float) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Buckets(len(chain.slot), chain.slot)
        for frame in frames:
            rows = [features(text, table) for text in frame["text"]]
            chances = chain.chances(rows)
            out = pd.DataFrame(chances, columns=[f"p_{n}" for n in chain.names])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            out["is_toxic"] = chances[:, -1] >= threshold
            yield out

    return run


def classify(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a chance p_<category> per category, and is_toxic, one row per input row.

    Only doc_id and text are read, whatever other columns are called; an empty table gives no rows. Whole texts are read; features are not scaled by a text's length, so length doesn't dilute them. Null and
    empty texts have no words and get the chain's bias. Nothing is shuffled or gathered.
    """
    kind = docs.schema["doc_id"].dataType
    schema = "doc_id string, " + ", ".join(f"p_{n} double" for n in chain.names) + ", is_toxic boolean"
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.mapInPandas(_run(chain, threshold), schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op7: chances and verdict for every document, from a chain fit on the labelled sample."""
    chain = train(*sample(docs, labels))
    out = classify(docs, chain)
    return out.select("doc_id", *[F.round(f"p_{n}", 6).alias(f"p_{n}") for n in chain.names], "is_toxic")
