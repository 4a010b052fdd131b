"""Operator 8: quality classifier with hierarchical empirical Bayes.

A logistic regression over surface statistics of the whole text and the shares of its words, hashed into ``BUCKETS``
buckets, gives each document's evidence. Documents sit on sites:
a host and a path below it. Sums of the documents' posteriors per path and per host (grouped aggregation, a few numbers
a site) give site rates; a path's rate is shrunk toward its host's and the host's toward the global rate, each with a
strength estimated by the method of moments from how much sites really differ. The document's log odds and the site's
log odds against the global rate add up to the final posterior, so a sparse site hardly matters and a site with much
evidence does.

The regression is fitted on at most ``sample_rows`` labelled documents, chosen by a hash of their id: the only bounded
sample. Scores, site sums and decisions cover all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import materialise
from quarry.llm.words import scan

FEATURES = (
    "bars a word", "symbols a word", "exclamation marks a word", "share of capitals", "digits a byte", "repeated neighbours",
    "distinct words", "bytes a word", "line ends a word", "stops a word", "log words", "share of letters",
)
BUCKETS = 128
SITES = 1 << 14  # sites that are broadcast at most
_SYMBOLS = np.frombuffer(b"%&$#*^~<>=@_{}[]\\", dtype=np.uint8)
_STOPS = np.frombuffer(b".,;:?", dtype=np.uint8)


def features(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row for each text: ``FEATURES``, then the root of the share of words in each of ``BUCKETS`` buckets."""
    out = []
    for w in scan(column, histogram=True):
        n = np.maximum(np.diff(w.first), 1).astype(float)
        c = w.counts.astype(float)
        size = np.maximum(c.sum(axis=1), 1)
        lower, upper, other = c[:, 97:123].sum(axis=1), c[:, 65:91].sum(axis=1), c[:, 128:].sum(axis=1)
        same = np.zeros(len(w.hashes) + 1)
        same[1:-1] = np.cumsum(w.hashes[1:] == w.hashes[:-1]) if len(w.hashes) > 1 else 0
        same[-1] = same[-2] if len(same) > 1 else 0
        a, b = w.first[:-1], w.first[1:]
        again = np.where(b - a > 1, same[np.maximum(b - 1, 0)] - same[a], 0)
        distinct = np.array([len(np.unique(w.hashes[i:j])) for i, j in zip(a, b, strict=True)])
        place = np.repeat(np.arange(len(n)) * BUCKETS, b - a) + (w.hashes >> np.uint64(32)).astype(np.int64) % BUCKETS
        words = np.sqrt(np.bincount(place, minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS) / n[:, None])
        out.append(
            np.column_stack(
                [
                    c[:, ord("|")] / n, c[:, _SYMBOLS].sum(axis=1) / n, c[:, ord("!")] / n, upper / np.maximum(upper + lower, 1),
                    c[:, 48:58].sum(axis=1) / size, again / n, distinct / n, size / n, c[:, 10] / n, c[:, _STOPS].sum(axis=1) / n,
                    np.log(n), (lower + upper + other) / size, words,
                ]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES) + BUCKETS))


@dataclass(frozen=True)
class Model:
    """Standardised logistic regression. Without both classes to learn from it says nothing (log odds 0)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights + self.bias, -30, 30)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> Model:
    """Newton's method for a ridge-penalised logistic regression."""
    d = len(FEATURES) + BUCKETS
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.column_stack([z, np.ones(len(z))])
    w, penalty = np.zeros(d + 1), ridge * len(z) * np.append(np.ones(d), 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``sample_rows`` labelled documents, those with the smallest hash of their id. Null ids and labels and
    labels without a document teach nothing; null text is empty; further columns of either table are not read."""
    known = labels.select(F.col(id_col).alias("own"), F.col(label_col).cast("int").alias("y")).dropna()
    sample = known.orderBy(F.xxhash64("own", F.lit(8)), "own", "y").limit(sample_rows)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = picked.join(F.broadcast(sample), F.col("id") == F.col("own")).select("y", "text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = features(b.column("text")).astype("<f4")
                yield pa.RecordBatch.from_pydict({"y": b.column("y"), "x": pa.array([row.tobytes() for row in x], pa.binary())})

    table = rows.mapInArrow(run, "y int, x binary").toArrow()
    x = np.frombuffer(b"".join(table["x"].to_pylist()), "<f4").reshape(-1, len(FEATURES) + BUCKETS).astype(float)
    return fit(x, np.asarray(table["y"].to_pylist(), dtype=float))


def _log_odds(model: Model):
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.log_odds(features(text)), pa.float64())

    return score


def _scored(docs: DataFrame, model: Model, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """``docs`` with the evidence of each text and its site; a text without words has none and is null."""
    text = F.col(text_col).cast("string")
    return docs.withColumns(
        {"_evidence": _log_odds(model)(text), "_blank": ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)),
         "_host": F.col(host_col).cast("string"), "_path": F.col(path_col).cast("string")}
    )


def _strength(rate: float, spread: float | None) -> float:
    """Pseudo-documents of a prior whose sites' rates differ with variance ``spread``."""
    if not spread or spread <= 0:
        return 1e6
    return min(1e6, max(1.0, rate * (1 - rate) / spread - 1))


def site_rates(scored: DataFrame) -> DataFrame:
    """``host, path, n, site_rate, rate`` from ``_host, _path, _evidence, _blank``. Counts and sums are aggregated before
    the shuffle, so a host with a third of the documents costs one row a task."""
    p = F.when(F.col("_blank"), F.lit(0.0)).otherwise(1 / (1 + F.exp(-F.col("_evidence"))))
    paths = scored.groupBy(F.col("_host").alias("host"), F.col("_path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good"))
    paths = materialise(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).head()
    n, good = total["n"] or 0, total["good"] or 0.0
    rate = min(1 - 1e-6, max(1e-6, good / n)) if n else 0.5
    noise = rate * (1 - rate)
    between = hosts.agg(F.sum(F.col("host_n") * F.pow(F.col("host_good") / F.col("host_n") - rate, 2)).alias("v"), F.count(F.lit(1)).alias("k")).head()
    spread = (between["v"] or 0.0) / n - noise * between["k"] / n if n else 0.0
    host_k = _strength(rate, spread)
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + host_k * rate) / (F.col("host_n") + host_k))
    hosts = hosts.withColumnRenamed("host", "_h")
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).select("host", "path", "n", "good", "host_rate")
    within = joined.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("host_rate"), 2)).alias("v"), F.count(F.lit(1)).alias("k")).head()
    spread = (within["v"] or 0.0) / n - noise * within["k"] / n if n else 0.0
    path_k = _strength(rate, spread)
    shrunk = (F.col("good") + path_k * F.col("host_rate")) / (F.col("n") + path_k)
    return materialise(joined.select("host", "path", "n", shrunk.alias("site_rate"), F.lit(rate).alias("rate")), "sites")


def _at_sites(scored: DataFrame, site: DataFrame, few: int) -> DataFrame:
    """``scored`` with the columns of its site. Up to ``few`` sites are broadcast; of more, those that hold more than that share of
    the documents (fewer than ``few``), so that only documents of sites too small to be hot are shuffled."""
    same = F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p"))
    sizes = site.agg(F.count(F.lit(1)).alias("sites"), F.sum("_n").alias("rows")).head()
    if sizes["sites"] <= few:
        return scored.join(F.broadcast(site), same).drop("_n")
    large = F.col("_n") * few > sizes["rows"]
    met = scored.join(F.broadcast(site.filter(large)), same, "left")
    rest = met.filter("_n IS NULL").select(scored.columns).join(site.filter(~large), same)
    return met.filter("_n IS NOT NULL").unionByName(rest).drop("_n")


def _decided(scored: DataFrame, sites: DataFrame, threshold: float, few: int = SITES) -> DataFrame:
    odds = lambda x: F.log(x / (1 - x))
    bound = lambda x: F.least(F.greatest(F.col(x), F.lit(1e-6)), F.lit(1 - 1e-6))
    site = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("site_rate").alias("_site"), F.col("rate").alias("_rate"), F.col("n").alias("_n"))
    joined = _at_sites(scored, site, few)
    total = F.col("_evidence") + odds(bound("_site")) - odds(bound("_rate"))
    joined = joined.withColumn("_good", F.when(F.col("_blank"), F.lit(0.0)).otherwise(1 / (1 + F.exp(-total))))
    return joined.withColumn("_kept", F.col("_good") >= threshold)


def classify(
    docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang"
) -> DataFrame:
    """One row for each input row: ``doc_id, host, path, p_text, site_rate, p_good, kept``.

    Null text and text without words have no evidence of quality: ``p_good`` 0, not kept. Null hosts and paths are
    sites of their own. Repeated rows get equal results. Empty input gives an empty result.
    """
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(host_col).alias("_h0"), F.col(path_col).alias("_p0"))
    scored = _scored(wanted, model, "_text", "_h0", "_p0").select("doc_id", "_evidence", "_blank", "_host", "_path")
    scored = materialise(scored, "evidence")
    out = _decided(scored, site_rates(scored), threshold)
    p_text = F.when(F.col("_blank"), F.lit(0.0)).otherwise(1 / (1 + F.exp(-F.col("_evidence"))))
    return out.select(
        "doc_id", F.col("_host").alias("host"), F.col("_path").alias("path"), p_text.alias("p_text"),
        F.col("_site").alias("site_rate"), F.col("_good").alias("p_good"), F.col("_kept").alias("kept"),
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text", host_col: str = "source", path_col: str = "lang", few: int = SITES) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns. Texts are scored twice, once for the sites and
    once for the decision (thrice where there are more than ``few`` sites). Only texts of small sites are shuffled, and only
    where there are more than ``few``."""
    boxed = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"), F.col(host_col).alias("_h0"), F.col(path_col).alias("_p0"))
    scored = _scored(boxed, model, "_text", "_h0", "_p0")
    sites = site_rates(scored.select("_evidence", "_blank", "_host", "_path"))
    return _decided(scored, sites, threshold, few).filter("_kept").select("_row.*")


