"""Quality rules: an isolation forest on rule statistics.

Each document gets a row of rule statistics. Random trees split a bounded
sample of labelled rows at random values of random statistics; rows that end on
short paths are anomalous. The anomaly score above which a document is rejected
is calibrated on labelled rows: the lowest score that rejects at most
``false_rejects`` of the rows labelled good.

Defined results: a null text counts as empty, and an empty text has all
statistics 0; a null id keeps its row; repeated rows are scored each for itself;
without labelled rows (or with good ones only and none bad) nothing is rejected
but what fails the base rules; other columns of the input are not read, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import textkernel as tk
from fieldloom.llm.shared import bounded_sample, cut, returning, short_batches

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, dtype=bool)  # bytes that begin a code point
_LEAD[0x80:0xC0] = False
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_distinct_words", "n_upper", "n_marks"]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + MORE)


def _per_document(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _distinct(document: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each of n documents; ``document`` is ascending."""
    keys = hashes ^ tk.mix(document.astype(np.uint64) + np.uint64(1))
    _, at = np.unique(keys, return_index=True)
    return np.bincount(document[at], minlength=n)


def statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each document of a slice (see textkernel)."""
    n = len(off) - 1
    w = tk.words(data, off)
    document = np.repeat(np.arange(n), w.counts)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[w.starts] += 1
    np.subtract.at(inside, w.ends, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out = {
        "n_words": w.counts,
        "word_chars": _per_document(inside & _LEAD[data], off),
        "n_symbols": _per_document(_SYMBOL[data], off),
        "n_upper": _per_document(_UPPER[data], off),
        "n_marks": _per_document(_MARK[data], off),
        "n_distinct_words": _distinct(document, w.hashes, n),
    }
    # Lines: a break after each \n and at each document's end; a line without a word doesn't count.
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10), off[1:]]))
    starts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, off[:-1]]))
    starts = starts[starts < len(data)]
    line_end = ends[np.searchsorted(ends, starts)]
    # An empty document's end is a start of the next one; each start's own end is the first at or after it,
    # or past it where an earlier empty document ends at the very same byte.
    owner = np.searchsorted(off, starts, side="right") - 1
    same = (line_end == starts) & (data[starts] != 10)
    line_end[same] = ends[np.minimum(np.searchsorted(ends, starts[same], side="right"), len(ends) - 1)]
    worded = np.searchsorted(w.starts, line_end) > np.searchsorted(w.starts, starts)
    starts, line_end, owner = starts[worded], line_end[worded], owner[worded]
    lines = tk.range_hash(tk.prefix_hash(data), starts, line_end) if len(starts) else np.empty(0, np.uint64)
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - _distinct(owner, lines, n)
    # Words in five-word windows that are found twice or more in the text.
    h, at = tk.windows(w, 5)
    covered = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    if len(h):
        keys = h ^ tk.mix(document[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        equal = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(h), dtype=bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        np.add.at(covered, at[twice], 1)
        np.subtract.at(covered, at[twice] + 5, 1)
    out["n_repeat_words"] = _per_document(np.cumsum(covered)[:-1] > 0, w.first)
    return out


def _batch_statistics(texts: pa.ChunkedArray | pa.Array) -> dict[str, np.ndarray]:
    parts = [statistics(data, off) for _, data, off in tk.slices(texts)]
    return {c: np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64) for c in COUNTS + MORE}


def rule_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = _batch_statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(stats[c]) for c in COUNTS + MORE]], ["doc_id", *COUNTS, *MORE])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return short_batches(rows).mapInArrow(returning(run), STATS_SCHEMA)


def base_failed(s: dict[str, np.ndarray], least_words: int = 10, most_repeat: int = 20) -> np.ndarray:
    return (s["n_words"] < least_words) | (100 * s["n_repeat_words"] > most_repeat * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """The forest's columns, free of scale: symbols a word, variety of words, share of capitals, marks a word.

    Lengths and repeated lines are no columns of it: good text varies widely in them. (The base rules read lengths and repeated words.)
    """
    n = {k: np.asarray(v, dtype=np.float64) for k, v in s.items()}
    words, chars = np.maximum(n["n_words"], 1), np.maximum(n["word_chars"], 1)
    return np.column_stack([n["n_symbols"] / words, np.log1p(n["n_distinct_words"]) / np.log1p(words), n["n_upper"] / chars, n["n_marks"] / words])


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Complete binary trees in arrays: child nodes of i are 2i+1 and 2i+2; a leaf has column -1."""

    column: np.ndarray  # (trees, nodes)
    value: np.ndarray
    path: np.ndarray  # path length credited at a leaf
    depth: int
    norm: float

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        size = min(sample, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (depth + 1) - 1
        column = np.full((trees, nodes), -1, dtype=np.int16)
        value, path = np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, rows[rng.choice(len(rows), size, replace=False)])]
            while todo:
                node, at, part = todo.pop()
                low, high = part.min(0), part.max(0)
                free = np.flatnonzero(high > low)
                if at == depth or len(part) < 2 or not len(free):
                    path[t, node] = at + _mean_path(len(part))
                    continue
                c = int(rng.choice(free))
                column[t, node], value[t, node] = c, rng.uniform(low[c], high[c])
                left = part[:, c] < value[t, node]
                todo += [(2 * node + 1, at + 1, part[left]), (2 * node + 2, at + 1, part[~left])]
        return cls(column, value, path, depth, max(float(_mean_path(size)), 1e-9))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1); 2 ** -(mean path / expected path)."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for column, value, path in zip(self.column, self.value, self.path, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                c = column[node]
                inner = c >= 0
                node = np.where(inner, 2 * node + 1 + (rows[at_row, np.where(inner, c, 0)] >= value[node]), node)
            total += path[node]
        return 2.0 ** (-total / (len(self.column) * self.norm))


@dataclass
class QualityModel:
    forest: IsolationForest | None
    threshold: float

    def verdict(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base_failed, anomaly, kept) of rows of statistics."""
        failed = base_failed(s)
        anomaly = self.forest.score(features(s)) if self.forest is not None and len(failed) else np.zeros(len(failed))
        return failed, anomaly, ~failed & (anomaly <= self.threshold)


def fit_quality_model(stats: DataFrame, labels: DataFrame, most_labelled: int = 20_000, trees: int = 200, sample: int = 256, false_rejects: float = 0.002, seed: int = 7) -> QualityModel:
    """Fit on at most ``most_labelled`` labelled rows, those whose id hashes lowest.

    ``labels`` has doc_id and quality (1 good, 0 bad); null ids or qualities and conflicting
    labels of one id are left out. Of rows that share a labelled id, the one of the least statistics is taken, so that
    reruns agree and the driver gets a row for each picked id at most.
    """
    clean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    picked = bounded_sample(clean, "doc_id", most_labelled)
    least = F.min(F.struct(*COUNTS, *MORE)).alias("s")
    rows = stats.join(picked, "doc_id").groupBy("doc_id", "quality").agg(least).select("doc_id", "quality", "s.*").toPandas().sort_values("doc_id")
    if rows.empty or not (rows.quality == 0).any() or not (rows.quality == 1).any():
        return QualityModel(None, 1.0)
    columns = {c: rows[c].to_numpy() for c in COUNTS + MORE}
    x, good = features(columns), (rows.quality == 1).to_numpy() & ~base_failed(columns)
    forest = IsolationForest.fit(x, trees, sample, seed)
    return QualityModel(forest, float(np.quantile(forest.score(x[good]), 1 - false_rejects, method="higher")) if good.any() else 1.0)


def judge(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, base statistics, base_failed, kept and anomaly for rows of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = {c: b.column(c).to_numpy(zero_copy_only=False) for c in COUNTS + MORE}
            failed, anomaly, kept = model.verdict(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in COUNTS], pa.array(failed), pa.array(kept), pa.array(anomaly)], ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double"
    return stats.mapInArrow(returning(run), schema)


def quality_verdicts(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics and verdict of every document; texts are read once, their statistics stored."""
    stats = cut(rule_statistics(documents))
    return judge(stats, fit_quality_model(stats, labels, **options))


def keep_good(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that the verdict keeps, with their own columns.

    A second pass over the texts takes the place of a join, so no text is shuffled.
    """
    model = fit_quality_model(cut(rule_statistics(documents)), labels, **options)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, kept = model.verdict(_batch_statistics(b.column(names.index("text"))))
            yield b.filter(pa.array(kept))

    return short_batches(documents).mapInArrow(returning(run), documents.schema)
