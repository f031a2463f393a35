"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - t_k): the weights w are shared across the ordered
thresholds t_0 < t_1 < ..., so the grades lie on one scale. x are sparse text
features: log(1 + count) of a word, or of a word's beginning (3 to 8 letters). The
expected severity is the sum of P(grade > k); a text is toxic from the cut on
that parts the training sample best, where a clean text lost weighs ten times a
toxic one missed.

Training takes a bounded sample of labelled rows (``most_toxic`` and
``most_clean``, those with the smallest hash of their id) to the driver. Grades
come from the labels alone, as the expression ``grade`` says: 0 is clean, what
is above is toxic, and there is a threshold below each grade that occurs (0/1
labels give one threshold). Near copies of a sampled text are left out, since
they would make its rare words look telling. Features are selected by what they
cover: each must be found in toxic texts and next to never in clean ones, the
``most_features`` that come first.

Defined cases: a null text counts as empty and has severity of the intercept
alone; a very long text is scored whole; null labels or ids are no examples, of
several labels of one id the highest grade counts; texts that tie at the cut
are toxic; with no toxic or no clean example every severity is 0; repeated rows
stay repeated; of the columns of ``docs`` those named severity, grade or toxic
are replaced, all others are kept; an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinwright.llm.workspace import smallest_hashes

WORD = re.compile(r"[^\W\d_]+")
#: Letters of the beginnings that are features; the mark of one in a feature's name.
STEMS, MARK = (3, 4, 5, 6, 7, 8), "^"


@dataclass
class SeverityModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()
    cut: float = float("inf")

    def __post_init__(self) -> None:
        self.openings = {f[1:4] for f in self.weights if f[0] == MARK}

    def hits(self, text: str) -> Counter:
        weights, found = self.weights, Counter()
        for w in WORD.findall(text.lower()):
            if w in weights:
                found[w] += 1
            if w[:3] in self.openings:
                for k in STEMS:
                    if k <= len(w) and (stem := MARK + w[:k]) in weights:
                        found[stem] += 1
        return found

    def severity(self, text: str) -> tuple[float, int]:
        """Expected severity, and the likeliest grade."""
        if not self.thresholds:
            return 0.0, 0
        score = sum(self.weights[f] * np.log1p(n) for f, n in self.hits(text).items())
        above = 1 / (1 + np.exp(-np.clip(score - np.array(self.thresholds), -500, 500)))
        grade = int(np.argmax(-np.diff(np.concatenate(([1.0], above, [0.0])))))
        return float(above.sum()), grade


def features(text: str) -> Counter:
    words = WORD.findall(text.lower())
    return Counter(words) + Counter(MARK + w[:k] for w in words for k in STEMS if k <= len(w))


def _sketch(text: str) -> list[int]:
    words = text.lower().split()
    h = np.array([zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))], np.uint64)
    return [int(((h ^ np.uint64(s)) * np.uint64(0x9E3779B97F4A7C15)).min()) for s in (1, 22, 333, 4444)]


def without_near_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Leaves out a text that shares two of four smallest shingle hashes with an earlier one."""
    seen, out = set(), []
    for text, label in rows:
        a, b, c, d = _sketch(text)
        keys = {(0, a, b), (1, c, d), (2, a, c), (3, b, d), (4, a, d), (5, b, c)}
        if not keys & seen:
            out.append((text, label))
        seen |= keys
    return out


def select_features(texts: list[str], labels: np.ndarray, most: int) -> list[str]:
    """Features of toxic texts that clean ones next to never have, the most frequent first.

    One is taken if enough toxic texts have it, or if it explains texts that no
    earlier one does and comes more than once in each: rare words of a text
    that meet by chance come once. A text's features are found when they are
    needed and not kept.
    """
    toxic, clean, often = Counter(), Counter(), Counter()
    bad = [t for t, y in zip(texts, labels) if y]
    n = len(bad)
    for text in bad:
        own = features(text)
        toxic.update(own.keys())
        often.update(own)
    toxic = {f: k for f, k in toxic.items() if k >= 2}
    for text, y in zip(texts, labels):
        if not y:
            clean.update(features(text).keys() & toxic.keys())
    some = [f for f, k in toxic.items() if clean[f] <= 0.02 * k]
    some.sort(key=lambda f: (-often[f], f[0] == MARK, -len(f), f))
    where = {f: i for i, f in enumerate(some)}
    has = [[] for _ in some]
    for d, text in enumerate(bad):
        for f in features(text).keys() & where.keys():
            has[where[f]].append(d)
    covered, out = np.zeros(n, bool), []
    for f, docs in zip(some, has):
        text = f.removeprefix(MARK)
        if any(text.startswith(g[1:]) if g[0] == MARK else False for g in out) or any(g.removeprefix(MARK).startswith(text) and often[f] <= 1.2 * often[g] for g in out):
            continue  # it says what a chosen one says
        if len(docs) >= max(8, 0.02 * n) or often[f] >= 1.5 * toxic[f] and np.count_nonzero(~covered[docs]) >= 2:
            out.append(f)
            covered[docs] = True
    return out[:most]


def fit(rows: list[tuple[str, int]], steps: int = 400, ridge: float = 1e-3, most_features: int = 2000) -> SeverityModel:
    """From (text, grade); grade 0 is clean."""
    rows = without_near_copies(rows)
    given = np.array([y for _, y in rows], np.int64)
    labels = np.minimum(given, 1)
    if not len(labels) or labels.min() == labels.max():
        return SeverityModel()
    grades, grade = np.unique(given, return_inverse=True)
    cuts_between = len(grades) - 1
    chosen = select_features([t for t, _ in rows], labels, most_features)
    column = {f: i for i, f in enumerate(chosen)}
    probe = SeverityModel(dict.fromkeys(chosen, 1.0))
    counts = [probe.hits(t) for t, _ in rows]
    row = np.array([i for i, c in enumerate(counts) for _ in c], np.int64)
    col = np.array([column[f] for c in counts for f in c], np.int64)
    x = np.array([np.log1p(n) for c in counts for n in c.values()])
    above = (grade[:, None] > np.arange(cuts_between)).astype(float)
    # parameters: weights, the lowest threshold, logarithms of the gaps
    p = np.concatenate([np.ones(len(chosen)), [1.0], np.zeros(cuts_between - 1)])
    m, v, d = np.zeros_like(p), np.zeros_like(p), len(chosen)
    for k in range(1, steps + 1):
        t = np.cumsum(np.concatenate([[p[d]], np.exp(p[d + 1 :])]))
        score = np.bincount(row, weights=p[:d][col] * x, minlength=len(rows))
        q = 1 / (1 + np.exp(-(score[:, None] - t)))
        cumulative = np.concatenate([np.ones((len(rows), 1)), q, np.zeros((len(rows), 1))], axis=1)
        own = np.maximum(np.take_along_axis(cumulative, grade[:, None], 1) - np.take_along_axis(cumulative, grade[:, None] + 1, 1), 1e-12)
        slope = q * (1 - q)  # of P(grade > k); an own cell is the difference of two of them
        sign = np.zeros_like(above)
        sign[np.arange(len(rows)), np.minimum(grade, cuts_between - 1)] -= grade < cuts_between
        sign[np.arange(len(rows)), np.maximum(grade - 1, 0)] += grade > 0
        by_cut = sign * slope / own  # derivative of the log likelihood by (score - t_k)
        g_t = -by_cut.sum(axis=0)
        gradient = np.concatenate([
            np.bincount(col, weights=by_cut.sum(axis=1)[row] * x, minlength=d) if d else np.empty(0),
            [g_t.sum()],
            np.exp(p[d + 1 :]) * g_t[::-1].cumsum()[::-1][1:],
        ]) / len(rows) - ridge * np.concatenate([p[:d], np.zeros(cuts_between)])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        p = p + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    t = np.cumsum(np.concatenate([[p[d]], np.exp(p[d + 1 :])]))
    model = SeverityModel(dict(zip(chosen, p[:d].tolist())), tuple(t.tolist()))
    found = np.array([model.severity(text)[0] for text, _ in rows])
    values = np.unique(found)
    cuts = np.concatenate([(values[:-1] + values[1:]) / 2, [values[-1] + 1]])
    clean, toxic = np.sort(found[labels == 0]), np.sort(found[labels == 1])
    lost = 1 - np.searchsorted(clean, cuts) / len(clean)
    missed = np.searchsorted(toxic, cuts) / len(toxic)
    model.cut = float(cuts[np.argmin(missed + 10 * lost)])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: str, most_toxic: int, most_clean: int, id_col: str, text_col: str) -> list[tuple[str, int]]:
    one = labels.select("doc_id", F.expr(grade).cast("int").alias("grade")).where("doc_id is not null and grade between 0 and 9").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    picked = smallest_hashes(one.where("grade > 0"), "doc_id", most_toxic).union(smallest_hashes(one.where("grade = 0"), "doc_id", most_clean))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("grade").alias("grade")).collect()  # most_toxic + most_clean ids at most
    return [(r.text, int(r.grade)) for r in sorted(rows, key=lambda r: r.doc_id)]


def score_toxicity(docs: DataFrame, model: SeverityModel, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with severity (expected grade), grade (the likeliest) and toxic (severity of at least ``threshold``, else the model's cut)."""

    threshold = model.cut if threshold is None else threshold
    held = [c for c in docs.columns if c not in ("severity", "grade", "toxic")]
    kept = docs.select(*held)
    at = held.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.severity(t.as_py() or "") for t in batch.column(at)]
            severity = np.array([s for s, _ in found], np.float64)
            own = [pa.array(severity), pa.array([g for _, g in found], pa.int32()), pa.array(severity >= threshold)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "severity", "grade", "toxic"])

    own = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *own.fields]))


def train(docs: DataFrame, labels: DataFrame, grade: str = "toxic", most_toxic: int = 1000, most_clean: int = 3000, most_features: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> SeverityModel:
    """``labels`` has doc_id and what ``grade`` is made of: an SQL expression that is 0 for clean texts and larger the graver a text is."""
    return fit(labelled_sample(docs, labels, grade, most_toxic, most_clean, id_col, text_col), most_features=most_features)


def drop_toxic(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns, whatever these are named."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = score_toxicity(plain, model, id_col=f"c{names.index(id_col)}", text_col=f"c{names.index(text_col)}").where("not toxic")
    return kept.select(*plain.columns).toDF(*names)
