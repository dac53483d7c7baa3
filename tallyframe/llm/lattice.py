"""Language-model scores as marginal likelihoods over subword lattices.

Pieces come from an existing subword vocabulary, whose scores give the first weights.  A word, after
its space mark, is a lattice of all its segmentations into pieces; the forward recursion in log space
sums over all of them.  Expectation-maximisation over the word counts of the training documents fits
the pieces' probabilities.  A text's score is the log of the product over its words and its end.

Beside it stands a plain word model with one added to each count.  Its counts grow with the corpus, so
they are joined, not sent around: only the most frequent words, at most HEAD of them and HEAD_BYTES in
all, go to the workers.

What is summed over rows in no fixed order is summed in whole numbers of small units, so reruns agree.
"""

from __future__ import annotations

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, gathered, text_or_empty

SPACE = "▁"
FOLDS, HELD_OUT = 7, 2
HEAD, HEAD_BYTES = 1 << 17, 16 << 20
ROUNDS = 2
#: Added to each piece's expected count.
SMOOTH = 0.01
#: Words whose scores a worker keeps; distinct words that a worker counts before it passes them on.
KEPT_WORDS, COUNTED = 300_000, 400_000
#: Longer words are scored one by one, and counted in blocks.
LONG, BLOCK = 200, 4096
_CELLS = 1 << 21
#: Units of expected counts and of a word's log probability.
_COUNT_UNIT, _LOG_UNIT = 2.0**-20, 2.0**-32
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces in lower case, then the 256 bytes, then the end; and their first probabilities.  The
    vocabulary's scores are minus the ranks of its merges; by Zipf's law over the ranks, a piece of rank r
    has a weight of 1 / (r + 10).  Of the rest, each byte has 1e-6 and the end 0.002."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weight = [], []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or SPACE in p[1:] or any("A" <= c <= "Z" for c in p):
            continue
        pieces.append(p)
        weight.append(1 / (10 - max(sp.get_score(i), -1e6)))
    p = np.array(weight)
    p = np.concatenate([p / p.sum() * 0.99, np.full(256, 1e-6), [0.002]])
    return pieces, p / p.sum()


class Lattice:
    def __init__(self, pieces: list[str], prob: np.ndarray) -> None:
        self.pieces, self.n = pieces, len(pieces)
        self.logp = np.log(np.append(prob, 1.0))
        self.logp[-1] = -np.inf  # at -1: no such piece
        self.by_text = {p: i for i, p in enumerate(pieces)}
        self.most = max(map(len, pieces))
        self._place()

    def _place(self) -> None:
        """A table with two places for each hash, so that a lookup reads two of them."""
        h = np.zeros(self.n, np.uint64)
        for i, p in enumerate(self.pieces):
            x = 0
            for c in p:
                x = (x * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
            h[i] = x
        h = self._mixed(h)
        self.hash, self.at = np.zeros(1 << 18, np.uint64), np.full(1 << 18, -1, np.int32)
        places = list(zip((h >> np.uint64(46)).tolist(), (h & np.uint64((1 << 18) - 1)).tolist(), strict=True))
        for i in range(self.n):
            slot = places[i][0]
            for _ in range(500):  # what was there goes to its other place
                i, self.at[slot] = int(self.at[slot]), i
                if i < 0:
                    break
                slot = sum(places[i]) - slot
            else:
                raise ValueError("the table is too full")
        filled = self.at >= 0
        self.hash[filled] = h[self.at[filled]]

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))

    def _found(self, h: np.ndarray) -> np.ndarray:
        h = self._mixed(h)
        a, b = (h >> np.uint64(46)).astype(np.int64), (h & np.uint64((1 << 18) - 1)).astype(np.int64)
        return np.where((self.hash[a] == h), self.at[a], np.where(self.hash[b] == h, self.at[b], -1))

    def byte_ids(self, char: str) -> list[int]:
        return [self.n + b for b in char.encode("utf-8", "surrogatepass")]

    def one(self, word: str) -> float:
        """log P(word), by the plain recursion."""
        s = SPACE + word
        alpha = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            terms = []
            for i in range(max(0, j - self.most), j):
                if (k := self.by_text.get(s[i:j], -1)) >= 0:
                    terms.append(alpha[i] + self.logp[k])
                elif j - i == 1:
                    terms.append(alpha[i] + sum(self.logp[b] for b in self.byte_ids(s[i])))
            m = max(terms)
            alpha[j] = m + math.log(sum(math.exp(t - m) for t in terms))
        return alpha[-1]

    def _edges(self, words: list[str]) -> tuple[int, dict, dict]:
        """For words of one length: the pieces at (start, length), and what single characters weigh
        that are no pieces."""
        size = len(words[0]) + 1
        codes = np.array([SPACE + w for w in words], f"U{size}").view(np.uint32).reshape(len(words), size)
        ids, single = {}, {}
        for i in range(size):
            h = np.zeros(len(words), np.uint64)
            for k in range(1, min(self.most, size - i) + 1):
                h = h * _BASE + (codes[:, i + k - 1].astype(np.uint64) + np.uint64(1))
                found = self._found(h)
                if k == 1 and (found < 0).any():
                    w = np.full(len(words), -np.inf)
                    for c in np.unique(codes[found < 0, i]):
                        w[(codes[:, i] == c) & (found < 0)] = sum(self.logp[b] for b in self.byte_ids(chr(c)))
                    single[i] = (w, codes[:, i])
                    ids[i, 1] = found
                elif (found >= 0).any():
                    ids[i, k] = found
        return size, ids, single

    def _forward(self, n: int, size: int, ids: dict, single: dict, back: bool = False) -> np.ndarray:
        """alpha[j]: log of all ways to reach j; back: of all ways from j to the end."""
        out = np.zeros((size + 1, n))
        for j in range(size - 1, -1, -1) if back else range(1, size + 1):
            terms = []
            for k in range(1, self.most + 1):
                i, far = (j, j + k) if back else (j - k, j - k)
                if (i, k) in ids:
                    terms.append(out[far] + self.logp[ids[i, k]])
                if k == 1 and i in single:
                    terms.append(out[far] + single[i][0])
            x = np.array(terms)
            m = x.max(0)
            out[j] = m + np.log(np.exp(x - m).sum(0))
        return out

    def _groups(self, words: list[str]):
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, at in by.items():
            step = 1 if n > LONG else max(1, _CELLS // ((n + 1) * self.most))
            for lo in range(0, len(at), step):
                yield n, at[lo : lo + step]

    def log_prob(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for n, at in self._groups(words):
            if n > LONG:
                out[at[0]] = self.one(words[at[0]])
            else:
                size, ids, single = self._edges([words[i] for i in at])
                out[at] = self._forward(len(at), size, ids, single)[-1]
        return np.round(out / _LOG_UNIT) * _LOG_UNIT

    def expected(self, words: list[str], counts: np.ndarray, unit: float = 0.0) -> np.ndarray:
        """Expected uses of each piece and byte in words that occur so often; if there is a unit, in whole
        numbers of it for each word."""
        total, weights = np.zeros(self.n + 257), counts.astype(float)
        for n, at in self._groups(words):
            if n > LONG:
                self._expected_long(words[at[0]], weights[at[0]], total, unit)
                continue
            size, ids, single = self._edges([words[i] for i in at])
            alpha = self._forward(len(at), size, ids, single)
            beta = self._forward(len(at), size, ids, single, back=True)
            whole = alpha[-1]
            for (i, k), found in ids.items():
                use = _in_units(np.exp(alpha[i] + self.logp[found] + beta[i + k] - whole) * weights[at], unit)
                total[: self.n + 1] += np.bincount(found + 1, use, self.n + 1)[np.r_[1 : self.n + 1, 0]] * np.r_[np.ones(self.n), 0]
            for i, (w, codes) in single.items():
                use = _in_units(np.exp(alpha[i] + w + beta[i + 1] - whole) * weights[at], unit)
                for c in np.unique(codes[use > 0]):
                    for b in self.byte_ids(chr(c)):
                        total[b] += use[codes == c].sum()
        return total

    def _on(self, s: str, before: list[float], lo: int, hi: int) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        """Carries the logs of all ways to reach the places up to lo on to hi; with the pieces
        (start, number or -1, log) that end at lo + 1 to hi."""
        alpha, first, ends = list(before), lo - len(before) + 1, []
        for j in range(lo + 1, hi + 1):
            steps = []
            for i in range(max(0, j - self.most), j):
                if (k := self.by_text.get(s[i:j], -1)) >= 0:
                    steps.append((i, k, float(self.logp[k])))
                elif j - i == 1:
                    steps.append((i, -1, float(sum(self.logp[b] for b in self.byte_ids(s[i])))))
            alpha.append(_log_sum([alpha[i - first] + w for i, _, w in steps]))
            ends.append(steps)
        return alpha, ends

    def _expected_long(self, word: str, count: float, total: np.ndarray, unit: float) -> None:
        """Adds the expected uses in a long word.  Of the places before a block, only the last that a
        piece can reach back to are kept, and the block is run forward again on the way back."""
        s = SPACE + word
        at, kept = [*range(0, len(s), BLOCK), len(s)], [[0.0]]
        for lo, hi in zip(at, at[1:], strict=False):
            kept.append(self._on(s, kept[-1], lo, hi)[0][-self.most :])
        whole, back = kept[-1][-1], {len(s): [0.0]}
        for lo, hi, before in list(zip(at, at[1:], kept, strict=False))[::-1]:
            alpha, ends = self._on(s, before, lo, hi)
            first = lo - len(before) + 1
            for j in range(hi, lo, -1):
                beta = _log_sum(back.pop(j))
                for i, k, w in ends[j - lo - 1]:
                    back.setdefault(i, []).append(w + beta)
                    use = float(_in_units(math.exp(alpha[i - first] + w + beta - whole) * count, unit))
                    for x in [k] if k >= 0 else self.byte_ids(s[i]):
                        total[x] += use


def _in_units(x, unit: float):
    return np.round(x / unit) if unit else x


def _log_sum(x: list[float]) -> float:
    m = max(x)
    return m + math.log(sum(math.exp(t - m) for t in x))


def _text_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _counted(batches):
    """Word counts of a partition, passed on whenever there are many distinct ones."""

    def rows(c: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])

    c: Counter = Counter()
    for batch in batches:
        for t in batch.column(0).to_pylist():
            c.update(_text_words(t))
        if len(c) > COUNTED:
            yield rows(c)
            c = Counter()
    if c:
        yield rows(c)


def _expected(pieces: list[str], prob: np.ndarray):
    def run(batches):
        lattice, total = Lattice(pieces, prob), 0
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            total = total + lattice.expected(words, batch.column(1).to_numpy(zero_copy_only=False), _COUNT_UNIT)
        if not isinstance(total, int):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["piece", "n"])

    return run


def fit(counts: DataFrame, path: str, ends: int, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(word, c) -> pieces and their probabilities.  What comes back to the driver is one number for
    each piece of the vocabulary."""
    pieces, prob = vocabulary(path)
    for _ in range(rounds):
        used = counts.mapInArrow(gathered(_expected(pieces, prob)), "piece int, n long")
        found = used.groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
        total = np.zeros(len(prob))
        for r in sorted(found):
            total[r.piece] = float(r.n) * _COUNT_UNIT
        total += SMOOTH
        total[-1] += ends
        prob = total / total.sum()
    return pieces, prob


class _Scores(dict):
    """word -> number, with what is known of each word."""

    def __init__(self, lattice: Lattice, head: dict[bytes, int]) -> None:
        super().__init__()
        self.lattice, self.head = lattice, head
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.words: list[bytes] = []
        self.logp, self.c = np.zeros(0), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def learn(self) -> None:
        self.logp = np.concatenate([self.logp, self.lattice.log_prob([w.decode("utf-8", "replace") for w in self.new])])
        self.c = np.concatenate([self.c, np.array([self.head.get(w, -1) for w in self.new], np.int64)])
        self.words += self.new
        self.new = []


def _scored(pieces: list[str], prob: np.ndarray, head):
    def run(batches):
        known = _Scores(Lattice(pieces, prob), head.value)
        end = math.log10(prob[-1])
        for batch in batches:
            if len(known) > KEPT_WORDS:
                known.forget()
            number = known.__getitem__
            at = [np.fromiter(map(number, _text_words(t)), np.int64) for t in batch.column(1).to_pylist()]
            if known.new:
                known.learn()
            n = [len(x) for x in at]
            score = [float(known.logp[x].sum()) / math.log(10) + end for x in at]
            head_n, head_sum, tail, tail_n = [], [], [], []
            for x in at:
                c = known.c[x]
                head_n.append(int((c > 0).sum()))
                head_sum.append(float(np.log10(c[c > 0] + 1).sum()))
                rest, k = np.unique(x[c < 0], return_counts=True)
                tail.append([known.words[i] for i in rest.tolist()])
                tail_n.append(k.tolist())
            arrays = [batch.column(0), pa.array([int.from_bytes(os.urandom(8), "little", signed=True)] * len(n), pa.int64()), pa.array(range(len(n)), pa.int32()), batch.column(2), pa.array(n, pa.int64()), pa.array(head_n, pa.int64()),
                      pa.array(head_sum, pa.float64()), pa.array(score, pa.float64()), pa.array(tail, pa.list_(pa.binary())), pa.array(tail_n, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "b", "i", "held_out", "n_words", "head_n", "head_sum", "score", "tail", "tail_n"])

    return run


def frequent(counts: DataFrame, head: int, size: int = HEAD_BYTES) -> dict[bytes, int]:
    """The words of the highest counts, by steps of count, as long as they are at most `head` and have at
    most `size` bytes.  The driver sees these and a table of under 512 steps."""
    step = F.floor(8 * F.log2("c")).cast("int")
    least, n, length = None, 0, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("size")).collect(), reverse=True):
        n, length = n + r.n, length + r.size
        if n > head or length > size:
            break
        least = r.step
    return {} if least is None else {bytes(r.word): r.c for r in counts.where(step >= least).collect()}


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each input
    row; scores are log10 probabilities.

    Null texts are empty and have the end alone.  A null id is the empty text when folds are dealt.
    Repeated rows count as often as they occur.  An empty table gives an empty result; without training
    documents the first weights score.  Other columns are ignored."""
    spark = docs.sparkSession
    held = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == HELD_OUT).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"), held)
    train = rows.where("NOT held_out")
    partial = train.select("text").mapInArrow(bounded(_counted), "word binary, c long")
    counts = cut(partial.groupBy("word").agg(F.sum("c").alias("c")))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    total, distinct = sums.n + ends, sums.v + (ends > 0)
    pieces, prob = fit(counts, path, ends, rounds)
    sent = spark.sparkContext.broadcast(frequent(counts, head))
    kind = "doc_id long, b long, i int, held_out boolean, n_words long, head_n long, head_sum double, score double, tail array<binary>, tail_n array<int>"
    whole = cut(rows.mapInArrow(bounded(_scored(pieces, prob, sent), 500), kind))
    pairs = whole.select("b", "i", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("b", "i", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("n"))
    rest = pairs.join(counts, "word").groupBy("b", "i").agg(F.sum(F.col("n").cast("long")).alias("tail_n"), F.sum(F.round(F.col("n") * F.log10(F.col("c") + 1), 9).cast("decimal(28,9)")).cast("double").alias("tail_sum"))
    out = whole.drop("tail", "tail_n").join(rest, ["b", "i"], "left")
    base = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + math.log10(ends + 1) - (F.col("n_words") + 1) * math.log10(total + distinct + 1)
    return out.select("doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("head_n") + F.coalesce("tail_n", F.lit(0)) + int(ends > 0)).alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
