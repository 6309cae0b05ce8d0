"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .exchange import crc_of_id, give_back, giving_back, prepare, stored

STATISTICS = ["log_bytes", "word_length", "word_length_spread", "distinct_words", "repeated_neighbours", "top_word", "letters", "capitals", "digits",
              "marks", "bars", "shouts", "lines", "repeated_lines", "sentence_ends", "high_bytes", "repeated_triples"]
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not (chr(i).isalnum() or chr(i) in ".,|!'\"-?;:()")]] = True


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text; empty text has defined values."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    share = lambda x: np.log((x + 0.002) / (1.002 - min(x, 1.0)))  # noqa: E731  a logit that is finite at 0 and 1
    letters = hist[_UPPER].sum() + hist[_LOWER].sum() + hist[128:].sum()
    return [np.log1p(n), np.log1p(sizes.mean()), np.log1p(sizes.std()), np.log(len(counts) + 1.0) - 0.8 * np.log(w + 1.0), share(same / w), share(max(counts.values(), default=0) / w),
            share(letters / max(1, n)), share(hist[_UPPER].sum() / max(1, n)), share(hist[_DIGIT].sum() / max(1, n)), share(hist[_MARK].sum() / max(1, n)),
            share(hist[124] / w), share(hist[33] / w), share(len(lines) / w), share(1 - len(set(lines)) / max(1, len(lines))),
            share((hist[46] + hist[63]) / w), share(hist[128:].sum() / max(1, n)), share(1 - triples / max(1, len(words) - 2)) if len(words) > 2 else share(0.0)]


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(doc_id, x) of every document, x the statistics of its whole text."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in giving_back(frames):
            yield pd.DataFrame({"doc_id": f["doc_id"], "x": [statistics(t) for t in f["text"]]})

    return docs.select("doc_id", F.col(text_column).alias("text")).mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Discriminant:
    """Class means and shrunk covariances; their Cholesky factors are kept and used for every score."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = 0.1):
        """moments: for each label the number of rows, the sum of x and the sum of x xT."""
        self.share = None
        rows = {k: m for k, m in moments.items() if m[0] > 1}
        total = sum(m[0] for m in moments.values())
        if set(rows) != {0, 1}:
            self.share = moments[1][0] / total if total and 1 in moments else 0.0 if total else 0.5
            return
        means = {k: s / n for k, (n, s, _) in rows.items()}
        covs = {k: q / n - np.outer(means[k], means[k]) for k, (n, _, q) in rows.items()}
        pooled = sum(rows[k][0] * covs[k] for k in rows) / total
        self.classes = []
        for k in (0, 1):
            target = np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(pooled))
            factor = np.linalg.cholesky((1 - shrinkage) * covs[k] + shrinkage * target)
            inverse = np.linalg.inv(factor)
            self.classes.append((means[k], inverse, np.log(np.diag(factor)).sum(), np.log(rows[k][0] / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if self.share is not None:
            return np.full(len(x), self.share)
        logs = [prior - logdet - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, logdet, prior in self.classes]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(table: DataFrame, labels: DataFrame, label_column: str = "quality", shrinkage: float = 0.1) -> Discriminant:
    """Fit on all labelled rows of `table` (doc_id, x) whose id isn't held out; only class sums reach the driver."""
    known = labels.select("doc_id", F.col(label_column).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").filter(crc_of_id(F.col("doc_id")) % 5 != 0)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for label, part in f.groupby("label"):
                x = np.stack(part["x"].to_numpy())
                yield pd.DataFrame([(int(label), len(x), x.sum(axis=0).tolist(), (x.T @ x).ravel().tolist())], columns=["label", "n", "s", "q"])

    parts = table.join(known, "doc_id").select("label", "x").mapInPandas(sums, "label int, n bigint, s array<double>, q array<double>")
    size = len(STATISTICS)
    flat = parts.select("label", "n", F.posexplode(F.concat("s", "q")).alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    moments: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    for label, i, v, n in sorted(map(tuple, flat.collect())):  # two labels by a fixed number of statistics
        values = moments.setdefault(label, (float(n), np.zeros(size), np.zeros(size * size)))
        (values[1] if i < size else values[2])[i if i < size else i - size] = v
    return Discriminant({k: (n, s, q.reshape(size, size)) for k, (n, s, q) in moments.items()}, shrinkage)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, shrinkage: float = 0.1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Defined results: NULL and empty texts are scored by the statistics of empty text; a NULL doc_id is held out and never
    learnt from; repeated rows are scored each and count each in training; with one label only, the score is that
    label; without labels it is 0.5; an empty table gives no rows. Further columns are neither read nor returned.
    """
    prepare(docs.sparkSession)
    table = stored(with_statistics(docs), "statistics")
    model = fit(table, labels, shrinkage=shrinkage)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())))

    return table.select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), score("x").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns kept and no row moved.

    Defined results are those of `classify`; an empty table gives no rows; further columns may have any name.
    """
    prepare(docs.sparkSession)
    model = fit(stored(with_statistics(docs), "statistics"), labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        give_back()
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))))

    return docs.filter(score("text") >= threshold)
