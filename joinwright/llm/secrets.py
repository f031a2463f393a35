"""Secret scans: patterns, and character Markov models for what no pattern names.

Two first-order character models are trained, one of random strings and one of
ordinary identifiers, from labelled samples (value, secret 0 or 1). Where none
are given, random strings over the alphabets of keys are the secrets, drawn
with a seed and not taken from what the patterns find, and the ordinary ones are
words of a bounded sample of the texts (``sample_texts``, ``sample_words`` of each
by hash), shorter than what is judged, so that no secret is among them. A run of
``LEAST_LENGTH`` or more characters is a secret where its log-likelihood ratio
exceeds ``LEAST_RATIO`` for each character and ``LEAST_TOTAL`` in all, with labels
also that of all but a thousandth of the long ordinary values. Digits alone are
a number and not judged.

All texts are read once; what is found is written, and only that is scored.
Built-in functions only. Defined cases: a null text counts as empty; rows keep
their ids, null or repeated, and repeated rows are scanned each; offsets count
code points; a very long text is scanned whole in its task, in time that grows
little faster than its matches; of spans that meet, those of the patterns stay;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinwright.llm.workspace import Workspace, smallest_hashes

#: Kind, pattern, group whose length counts, least length.
KINDS = (
    ("assign", "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
)
#: A run; it can only begin where no such run goes on, so each run is looked at once. Shorter ones are not scored.
LEAST_LENGTH = 12
RANDOM, TOKEN = "random", "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST_LENGTH
#: What the patterns need at least, so that other texts are passed over.
LIKELY = "[pP][aA][sS][sS][wW]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
#: The patterns of long runs with their least length written in, which finds the same runs.
RUNS = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "array<struct<start:int,end:int,value:string>>"
#: Least log-likelihood ratio for each character, and of a whole run.
LEAST_RATIO, LEAST_TOTAL = 0.6, 12.0
#: Seeded random strings; matches whose lengths are added up at once.
SEEDED, CHUNK = 400, 128


def _matches(text: Column, name: str, pattern: str, group: int) -> list[Column]:
    """Leftmost matches that do not overlap: what they say, what counts of it, and the lengths of what stands between them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None).cast("array<string>")
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return [F.when(F.size(matches) > 0, F.struct(matches.alias("matches"), values.alias("values"), gaps.alias("gaps"))).alias(name)]


def _spans(found: DataFrame, name: str, least: int) -> DataFrame:
    """Replaces the matches of a kind by (start, end, value) in code points; those with a short value dropped.

    Where a match starts is a sum of lengths: of whole chunks before its own, and inside its chunk.
    """
    x = F.col(name)
    n = F.size(x["matches"])
    lengths = F.zip_with(F.slice(x["gaps"], 1, n), F.transform(x["matches"], F.length), lambda a, b: a + b)
    found = found.withColumn("_lengths", lengths)
    add = lambda items: F.aggregate(items, F.lit(0), lambda acc, v: acc + v)
    count = F.floor((F.size("_lengths") - 1) / CHUNK).cast("int")
    found = found.withColumn("_sums", F.transform(F.sequence(F.lit(0), count), lambda j: add(F.slice("_lengths", j * CHUNK + 1, CHUNK))))
    found = found.withColumn("_before", F.transform(F.sequence(F.lit(0), count), lambda j: add(F.slice("_sums", 1, j))))

    def span(m: Column, i: Column) -> Column:
        chunk = F.floor(i / CHUNK).cast("int")
        start = F.get("_before", chunk) + add(F.slice("_lengths", chunk * CHUNK + 1, i - chunk * CHUNK)) + F.get(x["gaps"], i)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.coalesce(F.get(x["values"], i), m).alias("value"))

    spans = F.filter(F.transform(x["matches"], span), lambda s: F.length(s["value"]) >= least)
    return found.withColumn(name, F.when(x.isNotNull(), spans).otherwise(F.array().cast(SPAN))).drop("_lengths", "_sums", "_before")


class MarkovModel:
    """log P(next | last) over ALPHABET. Pairs fall back on single characters, and these on a small share for each, so what a model never saw stays unlikely."""

    def __init__(self, samples: list[str], back: float = 5.0, share: float = 0.1) -> None:
        pairs, last, single = Counter(), Counter(), Counter()
        for s in samples:
            single.update(c for c in s if c in ALPHABET)
            for a, b in zip(s, s[1:]):
                if a in ALPHABET and b in ALPHABET:
                    pairs[a, b] += 1
                    last[a] += 1
        whole = single.total() + share * len(ALPHABET)
        alone = {c: (single[c] + share) / whole for c in ALPHABET}
        self.table = [log((pairs[a, b] + back * alone[b]) / (last[a] + back)) for a in ALPHABET for b in ALPHABET]


def ratio_table(secret: list[str], ordinary: list[str]) -> list[float]:
    return [round(r - o, 6) for r, o in zip(MarkovModel(secret).table, MarkovModel(ordinary).table)]


def ratio(table: list[float], token: str) -> float:
    n, at = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    known = [at[a] * n + at[b] for a, b in zip(token, token[1:]) if a in at and b in at]
    return sum(table[k] for k in known) / max(len(token) - 1, 1)


#: Ordinary identifiers that are always in the sample, so that its model is never empty.
SEEDED_WORDS = "username first_name last_name created_at updated_at request response connection configuration environment database repository application controller description parameters iterator exception template document paragraph international responsibility understanding characteristics version-2 page-10 utf-8 sha256sum example-text 2024-01-01".split()


def seeded_strings(n: int = SEEDED) -> list[str]:
    """Random strings of the alphabets that keys are made of."""
    draw = random.Random(42)
    kinds = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET, ALPHABET[:52], ALPHABET[26:62])
    return ["".join(draw.choices(kinds[k % len(kinds)], k=32)) for k in range(n)]


def labelled_values(found: DataFrame, most: int) -> tuple[list[str], list[str]]:
    """Secrets and ordinary values that labels (value, secret) name, ``most`` of each at most."""
    rows = found.where("value IS NOT NULL AND secret IN (0, 1)").select("value", F.col("secret").cast("int").alias("secret"))
    one, two = (sorted({r.value for r in smallest_hashes(rows.where(F.col("secret") == s), "value", most).collect()}) for s in (1, 0))
    return one, two


def scan_secrets(docs: DataFrame, labels: DataFrame | None = None, sample_texts: int = 2000, sample_words: int = 40, most_labels: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, assign, access, hex, random): spans of each kind; of random those that meet no other. ``labels`` (value, secret 0 or 1) train the models."""
    work = Workspace(docs.sparkSession, "secrets")
    text, kinds = F.coalesce(F.col(text_col), F.lit("")), [kind for kind, *_ in KINDS]
    part = min(1.0, 2 * sample_texts / max(docs.count(), 1)) if labels is None else 0.0
    read = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("likely", F.col("text").rlike(LIKELY))
    found = [F.when(F.col("likely"), _matches(F.col("text"), kind, RUNS.get(kind, pattern), group)[0]).alias(kind) for kind, pattern, group, _ in KINDS]
    turn = F.xxhash64("text")
    by_hash = F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit("(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{4,%d})(?![A-Za-z0-9+/_=-])" % (LEAST_LENGTH - 1)), F.lit(1))), lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w"))))
    words = F.when(F.pmod(turn, F.lit(1 << 20)) < int(part * (1 << 20)), F.transform(F.slice(by_hash, 1, sample_words), lambda x: x["w"])).alias("words")
    written = work.write(read.select("id", turn.alias("turn"), *found, *_matches(F.col("text"), "tokens", TOKEN, 0), words), "found")
    spans = written
    for kind, _, _, least in KINDS:
        spans = _spans(spans, kind, least)
    spans = _spans(spans, "tokens", LEAST_LENGTH)
    if labels is None:
        plain = smallest_hashes(written.where(F.size("words") > 0).select("turn", "words"), "turn", sample_texts)
        secret, ordinary = [], sorted({w for r in plain.collect() for w in r.words})
    else:
        secret, ordinary = labelled_values(labels, most_labels)
    ordinary = sorted({*ordinary, *SEEDED_WORDS})
    table = ratio_table(secret + seeded_strings(), ordinary)
    known = sorted(ratio(table, w) for w in ordinary if labels is not None and len(w) >= LEAST_LENGTH) or [0.0]
    least = max(LEAST_RATIO, known[int(0.999 * (len(known) - 1))])

    n = len(ALPHABET)
    held = F.array(*map(F.lit, table))
    letter = lambda t, i: F.instr(F.lit(ALPHABET), F.substring(t, i, F.lit(1)))
    value = lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(held, (letter(t, i) - 1) * n + letter(t, i + 1)))
    is_random = lambda s: value(s["value"]) > F.greatest(F.lit(LEAST_TOTAL), least * (F.length(s["value"]) - 1))
    base = F.concat(*map(F.col, kinds))
    spans = spans.withColumn("_base", base)
    clear = lambda s: s["value"].rlike("[^0-9]") & ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return spans.select("id", *kinds, F.filter(F.filter("tokens", clear), is_random).alias(RANDOM))


def secret_report(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = scan_secrets(docs, labels, id_col=id_col, text_col=text_col)
    names = [kind for kind, *_ in KINDS]

    def joined(kinds: list[str]) -> Column:
        def keyed(place: int, kind: str) -> Column:
            return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end")))

        order = [keyed(i, k) for i, k in enumerate(kinds)]
        name = F.array(*map(F.lit, kinds))
        said = F.transform(F.array_sort(F.concat(*order)), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(said, ",")

    return found.select("id", *[F.size(k).cast("long").alias(f"n_{k}") for k in names], F.sha2(joined(names), 256).alias("base_sha256"), joined([*names, RANDOM]).alias("spans"))
