"""Document quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most labelled rows that a fit gathers, chosen by the hash of their id.
MAX_FIT_ROWS = 20_000

#: Frequent function words of the languages at hand.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for on with as was by be are this at or from an i you not have he they "
    "de la le les et en un une des du que qui dans pour sur au avec est pas "
    "der die das und zu den von mit ist im für auf nicht ein eine dem als auch "
    "el los las y del se por con una para su al lo como no".split()
)

STATISTICS = (
    "log_chars log_words chars_per_word longest_word word_spread distinct_words top_word function_words capital_words shouted_words "
    "upper digits marks pipes bangs symbols blanks controls wide log_lines chars_per_line repeated_lines longest_line words_per_sentence "
    "repeated_triples packed marked_words doubled_words short_words"
).split()

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 3
_CLASS[ord("|")] = 4
_CLASS[[ord("!"), ord("?")]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 6
_CLASS[[9, 10, 11, 12, 13, 32]] = 7
_CLASS[[*range(9), *range(14, 32), 127]] = 8
_CLASS[128:] = 9
_MARKS = tuple("#$%&*!|?@~^=+<>{}[]\\/_")
PACK_BYTES = 1 << 16


def statistics(text: str | None) -> list[float]:
    """The values named in STATISTICS for a whole text; null, empty and blank texts give zeros throughout where nothing can be divided."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words, lines = text.split(), text.split("\n")
    n, m = max(1, len(data)), max(1, len(words))
    shares = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=10) / n
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    triples = max(1, len(words) - 2)
    lines = [x for x in lines if x]
    line_lengths = list(map(len, lines)) or [0]
    packed = sum(len(zlib.compress(data[i : i + PACK_BYTES], 1)) for i in range(0, len(data), PACK_BYTES))
    ends = sum(text.count(c) for c in ".!?")
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / m, float(lengths.max()), float(lengths.std()),
        len(counts) / m, max(counts.values(), default=0) / m, sum(c for w, c in counts.items() if w.lower().strip(".,") in FUNCTION_WORDS) / m,
        sum(c for w, c in counts.items() if w[0].isupper()) / m, sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / m,
        *shares[1:10].tolist(),
        np.log1p(len(lines)), len(text) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), max(line_lengths) / max(1, len(text)), len(words) / max(1, ends),
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if len(words) > 2 else 0.0, packed / n,
        sum(c for w, c in counts.items() if w.endswith(_MARKS)) / m, sum(map(str.__eq__, words, words[1:])) / m, float((lengths <= 2).mean()),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts])


@dataclass
class Forest:
    """Complete binary trees in flat arrays: node i has children 2i+1 and 2i+2; a value above the threshold goes to the second."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``; all trees descend one level at a time."""
        if not len(x):
            return np.empty(0)
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        margin = self.start + self.leaf[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0, l2: float = 2.0) -> Forest:
    """Boost depth-wise trees on the logistic loss over quantile histograms.

    One class only, or no rows, gives a forest that says the (smoothed) share of label 1 everywhere.
    """
    rows, columns = x.shape
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (rows + 1)
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(share / (1 - share))))
    if rows < 2 or y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(columns)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    offset = np.arange(columns) * bins
    margin = np.full(rows, forest.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            cell = (((node - first) * columns * bins)[:, None] + offset + binned).ravel()
            g = np.bincount(cell, np.repeat(grad, columns), many * columns * bins).reshape(many, columns, bins).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(hess, columns), many * columns * bins).reshape(many, columns, bins).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(h < least) | (all_h - h < least)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for i in range(many):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-9:
                    forest.feature[t, first + i], forest.threshold[t, first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(rows), forest.feature[t, node]] > forest.threshold[t, node])
        g, h = (np.bincount(node - inner, w, inner + 1) for w in (grad, hess))
        forest.leaf[t] = -rate * g / (h + l2)
        margin += forest.leaf[t][node - inner]
    return forest


def held_out(id_column) -> F.Column:
    """Whether a row is kept from fitting: crc32 of the id's decimal text leaves 2 when divided by 4. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_FIT_ROWS, **settings) -> Forest:
    """Fit on labelled documents that are not held out.

    At most ``max_rows`` labelled ids are taken, those with the smallest hash, and only their statistics come to the driver. Null labels and
    ids do not count; an id labelled more than once has the rounded mean of its labels; of documents that share an id one counts. Only the id, text and
    label columns are looked at, so others may have any name. No labelled row gives a forest that says one half.
    """
    given = labels.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{label}`").alias("label_")).where(F.col("label_").isNotNull() & F.col("id_").isNotNull() & ~held_out("id_"))
    known = given.groupBy("id_").agg(F.round(F.avg("label_")).cast("int").alias("label_"))
    taken = known.orderBy(F.xxhash64("id_"), "id_").limit(max_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text}`").alias("text_"))
    rows = texts.join(F.broadcast(taken), "id_").select("id_", "label_", statistics_udf("text_").alias("x_"))
    got = sorted((r["id_"], r["label_"], r["x_"]) for r in rows.groupBy("id_", "label_").agg(F.min("x_").alias("x_")).collect())
    x = np.array([r[2] for r in got], float).reshape(len(got), len(STATISTICS))
    return fit(x, np.array([r[1] for r in got], float), **settings)


def with_score(df: DataFrame, forest: Forest, text: str = "text", out: str = "score") -> DataFrame:
    """Add the forest's probability of label 1 for every whole text. Null and empty texts are scored like any other, from their statistics."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))))

    return df.withColumn(out, score(F.col(f"`{text}`")))
