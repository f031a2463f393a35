"""URL filters: rules of host and path, and boosted trees for what no rule fits.

The longest fitting rule decides. Other URLs get the verdict of gradient-boosted
regression trees (logistic loss) over lexical features: length, host length,
depth, digit ratio, character entropy, number of parameters, hyphens, and how
often URLs with the same host suffix are blocked, counted over all labelled
URLs, in training without the URL's own label. The trees alone are trained on
the driver from a bounded sample (``most``) of these, each once with its
suffix's share and once with that of all URLs, which stands for a suffix that
no label has; where no labels are given, those that a rule fits are labelled by
it. A trained model becomes one SQL expression of nested CASEs, so scoring stays
in generated code.

Built-in functions only on the data. Defined cases: a null URL, or one without
"://", has an empty host and path and fits no rule; a very long URL is one like
any other; rules of equal length go in order of their text; with labels of one
class only that class is the verdict, with none it is allow; rows keep their
ids, null or repeated, and repeated rows are judged each; an empty table gives
no row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinwright.llm.workspace import Workspace, smallest_hashes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict and rule.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_blocked")
#: So many suffixes are sent to every task; more are joined by a shuffle.
BROADCAST_SUFFIXES = 100_000
ROUNDS, DEPTH, RATE, LEAVES_LEAST, CUTS = 30, 3, 0.3, 10, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3, F.lit(2147483647))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1, F.lit(2147483647)), "^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    name, verdict = None, None
    for said, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        cut = rule.index("/")
        own, start = rule[:cut], rule[cut:]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, "([^.]*\\.?[^.]*)$", 1)


def lexical_features(url: Column, host: Column, path: Column, suffix_blocked: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    letters = F.filter(F.array_distinct(F.split(u, "")), lambda c: c != "")
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.coalesce(-F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + share(c) * F.log2(share(c))), F.lit(0.0))
    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "digit_ratio": F.when(n > 0, F.regexp_count(u, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": entropy,
        "parameters": F.regexp_count(u, F.lit("[?&][^=&#]+=")).cast("double"),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "suffix_blocked": suffix_blocked,
    }


@dataclass
class BoostedTrees:
    base: float = 0.0
    trees: list = field(default_factory=list)  # (feature, cut, left, right) or a leaf's value

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(x.shape[1])]
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), cuts, np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += self._predict(tree, x)
        return self

    def _grow(self, x, g, h, cuts, rows, depth):
        leaf = round(float(RATE * g[rows].sum() / (h[rows].sum() + 1.0)), 9)
        if not depth or len(rows) < 2 * LEAVES_LEAST:
            return leaf
        whole, best = g[rows].sum() ** 2 / (h[rows].sum() + 1.0), (1e-6, None, None)
        for j, own in enumerate(cuts):
            for cut in own:
                low = x[rows, j] <= cut
                if LEAVES_LEAST <= low.sum() <= len(rows) - LEAVES_LEAST:
                    a, b = rows[low], rows[~low]
                    gain = g[a].sum() ** 2 / (h[a].sum() + 1.0) + g[b].sum() ** 2 / (h[b].sum() + 1.0) - whole
                    if gain > best[0]:
                        best = (gain, j, float(cut))
        if best[1] is None:
            return leaf
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, cuts, rows[low], depth - 1), self._grow(x, g, h, cuts, rows[~low], depth - 1))

    def _predict(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._predict(tree[2], x), self._predict(tree[3], x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum(self._predict(t, x) for t in self.trees))))

    def column(self, columns: list[Column]) -> Column:
        """The probability as an expression."""

        def node(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(columns[tree[0]] <= tree[1], node(tree[2])).otherwise(node(tree[3]))

        score = F.lit(self.base)
        for tree in self.trees:
            score = score + node(tree)
        return 1 / (1 + F.exp(-score))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labels: DataFrame | None = None, most: int = 4000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score). ``labels`` (url, blocked 0 or 1) train the trees."""
    host, path = host_and_path(F.col(url_col))
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    if labels is None:
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        known = read.where(rule.isNotNull()).select("url", "host", "path", (verdict == "block").cast("int").alias("y"))
    else:
        h, p = host_and_path(F.col("url"))
        known = labels.select("url", h.alias("host"), p.alias("path"), F.col("blocked").cast("int").alias("y"))
    known = known.where("y in (0, 1)").select("*", suffix_of(F.col("host")).alias("suffix"))
    suffixes = Workspace(pages.sparkSession, "urls").write(known.groupBy("suffix").agg(F.sum("y").alias("blocked"), F.count("*").alias("n")), "suffixes")
    whole = suffixes.agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n"), F.count("*").alias("suffixes")).first()
    rate = whole.blocked / whole.n if whole.n else 0.0
    share = lambda blocked, n: (blocked + rate) / (n + 1)
    stats = suffixes.select("suffix", "blocked", "n", share(F.col("blocked"), F.col("n")).alias("stat"))
    sample = F.broadcast(smallest_hashes(known, "url", most)).join(stats, "suffix")
    sample = sample.withColumn("stat", F.explode(F.array(share(F.col("blocked") - F.col("y"), F.col("n") - 1), F.lit(rate))))
    plain = lexical_features(F.col("url"), F.col("host"), F.col("path"), F.col("stat"))
    rows = sample.select("y", *[plain[f].alias(f) for f in FEATURES]).orderBy("y", *FEATURES).collect()  # two for each of ``most`` URLs at most
    y = np.array([r.y for r in rows], float)
    model = BoostedTrees(base=-9.0)
    if len(y) and y.min() != y.max():
        model = BoostedTrees().fit(np.array([r[1:] for r in rows], float), y)
    elif len(y):
        model = BoostedTrees(base=9.0 if y[0] else -9.0)
    stats = stats.select("suffix", "stat")
    stats = F.broadcast(stats) if whole.suffixes <= BROADCAST_SUFFIXES else stats
    read = read.withColumn("suffix", suffix_of(F.col("host"))).join(stats, "suffix", "left")
    stat = F.coalesce("stat", F.lit(rate))
    features = lexical_features(F.col("url"), F.col("host"), F.col("path"), stat)
    scored = read.select("id", "host", "path", *[features[f].alias(f) for f in FEATURES])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = scored.withColumn("score", model.column([F.col(f) for f in FEATURES]))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
