"""Document quality by hierarchical empirical Bayes.

A logistic classifier over text measures gives each document its own evidence. Hosts and
their paths gather the evidence of their documents by grouped sums (a known label counts as
itself); a host's posterior is shrunk to the global mean and a path's to its host's, each
with a strength taken from the spread between groups, so sparse sites lean on their
parents. A document does not speak for itself, at either level: documents fall into
``PARTS`` parts by hash, and a document's posteriors are those of the other parts. (Taking
out the document alone would still tell its label: what is left of its site's sum would be
lower for a good document than for a bad one.) A second fit weighs text against site.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import common as C

MEASURES = (
    "bias", "log_words", "word_length", "distinct", "top_word", "repeated_lines", "upper", "digits", "stops", "marks", "bars", "high", "line_length", "long_words",
)

#: Parts of the documents, each judged by the sites' sums of the others.
PARTS = 5

#: Marks that running text uses little.
_MARKS = list(b"!#$%&*+<=>?@^_`~")


def measures(text: str | None) -> list[float]:
    """Numbers about one whole text; all zero but the bias for a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [1.0] + [0.0] * (len(MEASURES) - 1)
    n, size = len(words), max(1, len(raw))
    known = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    octets = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters = max(1, int(octets[65:91].sum() + octets[97:123].sum() + octets[128:].sum()))
    return [
        1.0, float(np.log1p(n)), float(sum(map(len, words)) / n), len(known) / n, known.most_common(1)[0][1] / n,
        1 - len(set(lines)) / len(lines), float(octets[65:91].sum()) / letters, float(octets[48:58].sum()) / size,
        float(octets[46]) / n, float(octets[_MARKS].sum()) / n, float(octets[124] + octets[9]) / n,
        float(octets[128:].sum()) / letters, float(np.log1p(size / len(lines))), sum(len(w) > 20 for w in words) / n,
    ]


def _measure(batches):
    for batch in batches:
        rows = [measures(t) for t in batch.column("text").to_pylist()]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "x"])


class Logistic:
    """Ridge logistic regression on standardised columns, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.mean[0], self.scale[0] = 0.0, 1.0
        z = (x - self.mean) / self.scale
        pull = np.full(x.shape[1], ridge)
        pull[0] = 1e-3
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (p - y) + pull * w)
            w = w - np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w / self.scale
        self.weights[0] = w[0] - float((w[1:] * self.mean[1:] / self.scale[1:]).sum())

    def column(self, values: list[Column]) -> Column:
        """Log-odds as an expression over the columns."""
        out = F.lit(float(self.weights[0]))
        for w, v in zip(self.weights[1:].tolist(), values[1:], strict=True):
            out = out + F.lit(w) * v
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), out))


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame) -> float:
    """Prior strength from groups (n, s, parent mean m): how little they differ beyond chance."""
    r = groups.agg(
        F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count(F.lit(1)), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)),
        F.sum("q"), F.sum(F.col("s") * F.col("s") / F.col("n")), F.sum("s"),
    ).first()
    n, n2, j, between, q, within, s = (float(v or 0) for v in r)
    if n <= j or j < 2:
        return 10.0
    noise = max(1e-9, (q - within) / (n - j))
    spread = (between - (j - 1) * noise) / max(1e-9, n - n2 / n)
    return float(np.clip(noise / max(spread, 1e-9), 0.5, 1e6))


def score_documents(docs: DataFrame, labels: DataFrame, host: str, path: str, folds: int = 5, per_class: int = 10_000) -> DataFrame:
    """doc_id, held_out, host, path, text_score, host_posterior, path_posterior, score, predicted of every row.

    ``host`` and ``path`` name the columns of ``docs`` that tell the site and its part; null
    is a site (or part) of its own. Learns from labels whose crc32(doc_id) modulo ``folds``
    is not 0: the two fits from at most ``per_class`` labelled rows of each class (lowest
    hash), the site sums from all rows but those of the row's own part. A doc_id labelled twice is good only if every label
    says so; other labels than 0 and 1 teach nothing. Without labels of both classes the
    text score is 0.5. Null and empty texts are scored by their measures like others; rows
    without doc_id count as held out; repeated rows are scored each; other columns are
    ignored.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text"
    ).withColumn("held_out", C.fold_in(F.col("doc_id"), folds) == 0)
    measured = C.stage(
        base.mapInArrow(_measure, "doc_id long, host string, path string, held_out boolean, x array<double>"), "measures"
    )
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (C.fold_in(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    told = C.stage(measured.join(known, "doc_id", "left"), "told")
    sample = C.hash_sample(told.where("y is not null"), "y", ["doc_id"], per_class)
    rows = sample.select("x", "y").toPandas()  # at most 2 x per_class short rows
    text = _fit(np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(MEASURES)), rows["y"].to_numpy(dtype=float))
    columns = [F.get("x", i) for i in range(len(MEASURES))]
    odds = text.column(columns) if text else F.lit(0.0)
    site = [F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("hn"), F.coalesce("path", F.lit("")).alias("p"), F.col("path").isNull().alias("pn")]
    at_host, at_path = ["h", "hn"], ["h", "hn", "p", "pn"]
    p = 1 / (1 + F.exp(-odds))
    part = F.coalesce(F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("/part"))) % PARTS, F.lit(0)).cast("int").alias("part")
    spoken = told.select("doc_id", "held_out", "host", "path", *site, part, odds.alias("odds"), p.alias("text_score"), "y")
    spoken = C.stage(spoken.withColumn("e", F.coalesce(F.col("y").cast("double"), "text_score")), "spoken")

    cells = C.stage(spoken.groupBy(*at_path, "part").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q")), "cells")

    def sums(*by: str) -> DataFrame:
        return cells.groupBy(*by).agg(*(F.sum(c).alias(c) for c in "nsq"))

    paths, hosts = sums(*at_path), sums(*at_host)
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = float(total[1] / total[0]) if total[0] else 0.5
    k_host = _strength(hosts.withColumn("m", F.lit(mean)))
    whole = hosts.select(*at_host, F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    k_path = _strength(paths.join(whole, at_host).withColumn("m", F.col("host_s") / F.col("host_n")))
    own_host = sums(*at_host, "part").join(whole, at_host).select(
        *at_host, "part", ((F.col("host_s") - F.col("s") + k_host * mean) / (F.col("host_n") - F.col("n") + k_host)).alias("host_posterior")
    )
    all_path = paths.select(*at_path, F.col("n").alias("path_n"), F.col("s").alias("path_s"))
    sites = cells.join(all_path, at_path).join(own_host, [*at_host, "part"]).select(
        *at_path, "part", "host_posterior",
        ((F.col("path_s") - F.col("s") + k_path * F.col("host_posterior")) / (F.col("path_n") - F.col("n") + k_path)).alias("path_posterior"),
    )
    # Both sides of this join are plain shuffles, so Spark splits a site with a third of all rows.
    joined = spoken.join(C.stage(sites, "sites"), [*at_path, "part"]).select(
        "doc_id", "held_out", "host", "path", "odds", "text_score", "y", "host_posterior", "path_posterior"
    )
    lift = (_odds(F.col("path_posterior")) - float(np.log(np.clip(mean, 1e-4, 1 - 1e-4) / (1 - np.clip(mean, 1e-4, 1 - 1e-4))))).alias("lift")
    joined = C.stage(joined.select("*", lift), "joined")
    again = C.hash_sample(joined.where("y is not null"), "y", ["doc_id"], per_class)
    pairs = again.select("odds", "lift", "y").toPandas()  # at most 2 x per_class short rows
    both = _fit(np.stack([np.ones(len(pairs)), pairs["odds"], pairs["lift"]], axis=1).astype(float), pairs["y"].to_numpy(dtype=float))
    final = both.column([F.lit(1.0), F.col("odds"), F.col("lift")]) if both else F.col("odds")
    score = 1 / (1 + F.exp(-final))
    return joined.select("doc_id", "held_out", "host", "path", "text_score", "host_posterior", "path_posterior", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def _fit(x: np.ndarray, y: np.ndarray) -> Logistic | None:
    return Logistic(x, y) if len(set(y.tolist())) == 2 else None
