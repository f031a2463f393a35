"""BPE encoding and decoding by speculation and verification.

For each new word, a greedy longest match proposes tokens. A sequence of
tokens is what exact merging gives just where each adjacent pair is what exact
merging gives for the pair's own text, so all adjacent pairs of a chunk are
tested together against memorised verdicts. Only the words with a failing pair
are merged exactly, lowest rank first, leftmost on ties.

The vocabulary file (the JSON of the tokenizers library; word-level BPE with
byte symbols and an end-of-word suffix) is read by the driver and broadcast:
its size does not depend on the corpus.

Defined cases: a null text counts as empty and gives no token; very long words
are merged with a heap; repeated rows stay repeated; other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

#: Entries of a worker's memo of words, of its memo of pairs, and characters of text worked on at once.
WORDS, PAIRS, CHUNK = 300_000, 400_000, 500_000
#: Below this code point composition changes nothing and lower case goes character by character; some capitals below have theirs at or above it.
PLAIN = 0x250
#: Bytes of the longest token with the end-of-word suffix that is sought.
LONGEST_END = 64
#: Stands for a pair without a merge; ranks after all others.
NONE = (1 << 62, -1)
_UNPLAIN = re.compile(f"[{''.join(chr(c) for c in range(PLAIN) if max(chr(c).lower()) >= chr(PLAIN))}{chr(PLAIN)}-\U0010ffff]")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_PATTERN = rf"{_CONTRACTIONS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"


def _plain_split() -> re.Pattern:
    """The same split for plain characters, with the classes spelled out."""
    of = lambda test: "".join(re.escape(chr(c)) for c in range(PLAIN) if test(chr(c)))
    letter, number = of(lambda c: unicodedata.category(c)[0] == "L"), of(lambda c: unicodedata.category(c)[0] == "N")
    space = of(lambda c: regex.match(r"\p{White_Space}", c))
    return re.compile(rf"{_CONTRACTIONS}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


_PLAIN_SPLIT = _plain_split()


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Codec:
    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.inside = [vocab[s] for s in symbols]
        self.at_end = [vocab[s + self.suffix] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.parts: dict[int, list[int]] = {i: [i] for i in (*self.inside, *self.at_end)}
        for (left, right), (_, whole) in self.merges.items():
            if left in self.parts and right in self.parts:
                self.parts.setdefault(whole, self.parts[left] + self.parts[right])
        self.mid: dict[bytes, int] = {}
        self.end: dict[bytes, int] = {}
        for token, i in vocab.items():
            if i in self.parts and self.merge(self.parts[i]) == [i]:
                ends = token.endswith(self.suffix) and len(self.parts[i]) < len(token)
                text = bytes(byte_of[c] for c in (token[: -len(self.suffix)] if ends else token))
                (self.end if ends else self.mid)[text] = i
        self.step: dict[int, int] = {}  # prefix tree of the tokens that end inside a word: node << 8 | byte to node
        self.token = [-1]
        for text, i in self.mid.items():
            node = 0
            for byte in text:
                node = self.step.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        self.normalizer = Tokenizer.from_str(file.decode()).normalizer
        self.splitter = Split(Regex(_PATTERN), "removed", invert=True)
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.speculated = self.failed = 0

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging."""
        if len(ids) > 48:
            return self._merge_long(ids)
        ids, find = list(ids), self.merges.get
        found = [find(pair, NONE) for pair in zip(ids, ids[1:])]
        while found and (best := min(found)) is not NONE:
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = find((ids[k - 1], best[1]), NONE)
            if k < len(found):
                found[k] = find((best[1], ids[k + 1]), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        ids, n, merges = list(ids), len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*found, k, ids[k], ids[k + 1]) for k in range(n - 1) if (found := merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, whole, k, left, right = heapq.heappop(heap)
            j = after[k]
            if ids[k] != left or j >= n or ids[j] != right:
                continue
            ids[k], ids[j], after[k] = whole, -1, after[j]
            if after[k] < n:
                before[after[k]] = k
                if found := merges.get((whole, ids[after[k]])):
                    heapq.heappush(heap, (*found, k, whole, ids[after[k]]))
            if (i := before[k]) >= 0 and (found := merges.get((ids[i], whole))):
                heapq.heappush(heap, (*found, i, ids[i], whole))
        return [i for i in ids if i >= 0]

    def symbols_of(self, word: bytes) -> list[int]:
        return [*map(self.inside.__getitem__, word[:-1]), self.at_end[word[-1]]]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, whole, step, token = [], 0, len(word), self.end.get, self.step.get, self.token
        last = n - 1
        while True:
            if n - at <= LONGEST_END and (i := whole(word[at:])) is not None:
                out.append(i)
                return out
            node, k, i, stop = 0, at, -1, at
            while k < last and (node := step(node << 8 | word[k])) is not None:
                k += 1
                if token[node] >= 0:
                    i, stop = token[node], k
            out.append(i)
            at = stop

    def learn(self, words: list[str]) -> None:
        """Encodes new words into the memo."""
        if len(self.words) + len(words) > WORDS:
            self.words.clear()
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        raw = [w.encode("utf-8", "replace") for w in words]
        guess = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter(chain.from_iterable(guess), np.int64, int(sizes.sum()))
        codes = (flat[:-1] << 32) | flat[1:]
        owner = np.repeat(np.arange(len(guess)), sizes)
        inner = owner[:-1] == owner[1:]
        unique, where = np.unique(codes[inner], return_inverse=True)
        verdicts = np.fromiter(map(self._fits, unique.tolist()), bool, len(unique))
        bad = np.zeros(len(guess), bool)
        bad[owner[:-1][inner][~verdicts[where]]] = True
        self.speculated += len(guess)
        self.failed += int(bad.sum())
        for k in np.nonzero(bad)[0].tolist():
            guess[k] = self.merge(self.symbols_of(raw[k]))
        ends = np.cumsum(np.fromiter(map(len, guess), np.int64, len(guess)) * 4).tolist()
        packed = np.fromiter(chain.from_iterable(guess), "<u4", ends[-1] // 4).tobytes()
        self.words.update(zip(words, [packed[a:b] for a, b in zip([0, *ends], ends)]))

    def _fits(self, code: int) -> bool:
        known = self.pairs.get(code)
        if known is None:
            a, b = code >> 32, code & 0xFFFFFFFF
            known = self.pairs[code] = self.merge(self.parts[a] + self.parts[b]) == [a, b]
        return known

    def split(self, text: str) -> list[str]:
        """Other scripts go through the library's own normalizer and splitter, whose Unicode tables decide."""
        if _UNPLAIN.search(text) is None:
            return _PLAIN_SPLIT.findall(text.lower())
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def pieces(self, text: str) -> list[list[str] | int]:
        """Words of each stretch of ordinary text, and ids of the special tokens between."""
        if self.special_split is None or self.special_split.search(text) is None:
            return [self.split(text)]
        return [self.special[x] if k % 2 else self.split(x) for k, x in enumerate(self.special_split.split(text))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.pieces(t) for t in texts]
        memo = self.words
        new = {w for pieces in cut for p in pieces if isinstance(p, list) for w in p if w not in memo}
        if new:
            before = memo
            held = {w: before[w] for pieces in cut for p in pieces if isinstance(p, list) for w in p if w in before} if len(memo) + len(new) > WORDS else {}
            self.learn(sorted(new))
            memo.update(held)
        take = memo.__getitem__
        return [np.frombuffer(b"".join(b"".join(map(take, p)) if isinstance(p, list) else np.array([p], "<u4").tobytes() for p in pieces), "<u4") for pieces in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings with a space between; the vocabulary names no decoder of its own."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


_CODECS: dict[str, Codec] = {}


def codec(file: bytes) -> Codec:
    key = hashlib.sha256(file).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(file)
    return _CODECS[key]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, token_ids]): one row for each row of ``docs``."""
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value)
        for batch in batches:
            sizes = [len(t.as_buffer() or b"") for t in batch.column(1)]
            start = 0
            while start < batch.num_rows:
                stop, room = start + 1, CHUNK - sizes[start]
                while stop < batch.num_rows and sizes[stop] <= room:
                    room -= sizes[stop]
                    stop += 1
                texts = [t or "" for t in batch.column(1)[start:stop].to_pylist()]
                ids = own.encode(texts)
                columns = [
                    batch.column(0)[start:stop],
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids]),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view(np.int32))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                start = stop

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "id", ids_col: str = "token_ids") -> DataFrame:
    """(id, text): the text of each row's token ids; null ids give a null text."""
    with open(vocabulary, "rb") as f:
        held = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")
