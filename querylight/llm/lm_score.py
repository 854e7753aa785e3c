"""Scores of texts under a causal self-attention model of subword ids.

The model. A text is its words (between ASCII blanks, A-Z lower-cased), each as subword ids, and an
end. Whether a word ends depends on the last id, the next id's class on that and the context, the id on its
class and the last id:

    p(begins, id | context) = p(begins | last) * p(class | context, begins) * p(id | class, last)
    p(begins | last) = (times that `last` ended a word + 1/2) / (times of `last` + 1)
    class logits = table[last] + attention . U
    p(id | class, last) = (n(last, id) + A * p(id | class)) / (n(last, class) + A)

where `last` in the last two lines is the last id, or `word start` when the next id begins a word (the end
does). Over all ids, beginning a word or not, the probabilities sum to one.

One head of attention over the last `WINDOW` ids, with an embedding each for queries, keys and values
and a learned bias per distance, adds what the table does not know. Windows overlap by `OVERLAP` ids,
so each id is scored once, with at least that many ids before it (or all there are).

What is gathered from the corpus: the counts of all words of all training texts. From them come the
word-level base score, the counts n and the table, each by one pass of Spark over the counted words;
the `PAIRS` most frequent pairs of ids are sent to the tasks. The attention weights start from a fit on about `PASSAGES` passages, one
from a hashed place of each sampled training text, and are then fitted on every id of every training text: each of `ROUNDS`
hashed slices of the texts gives one step, whose gradients are summed in Spark.

Each text is cut into words and ids once. What of its score does not depend on the fitted weights (word ends, ids within
their classes, counts of words) is summed there, and the ids are written, by slices; fitting and scoring read those.

About the `COMMON_WORDS` most frequent words are sent to the tasks with their counts. Each text's other words are
joined with the counts by shuffle, and summed per text. So are pairs of ids beyond the `PAIRS` most frequent.

Results for odd input: null counts as empty text, whose only token is the end. Rows with a null id
are not held out. Rows that agree in id and text get equal rows, one each. Without training texts
all counts are 0 and the model is uniform over classes. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.llm.common import lower_az, text_or_empty, with_row_key
from querylight.llm.language_id import small_batches
from querylight.llm.registry import query, table
from querylight.session import stage

RANKS = "byte_bpe_50k.tiktoken"
IDS = 50257
END = 50256
WORD_START = IDS  # row of the table used when the next id begins a word
CLASSES = 64
OWN_ROWS, SHARED_ROWS = 4096, 512  # embeddings of the most frequent ids; the others share by hash
WIDTH = 8
WINDOW, OVERLAP = 32, 8
PASSAGES, PASSAGE_WORDS, EPOCHS, BATCH, RATE = 12_000, 16, 4, 128, 0.01
ROUNDS, CHUNK = 16, 4096
COMMON_WORDS, COUNT_BINS = 400_000, 1 << 16
PAIRS, PAIR_PRIOR = 500_000, 2.0
TEXT_BYTES, ID_BYTES, WORDS_AT_ONCE = 16 << 20, 8 << 20, 250_000
WINDOWS_AT_ONCE, WINDOWS_SUMMED = 128, 2048  # what a core's cache holds; windows whose gradients are added up by id together
FOLDS, HELD_OUT = 7, 2


@lru_cache(maxsize=2)
def coder(ranks: str):
    """The subword coder, and the bytes of each id."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(IDS, dtype=np.int64)
    for piece, i in merges.items():
        lengths[i] = len(piece)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}), lengths


def word_ids(words: pa.Array, ranks: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all words in a row, a blank before each, and the offsets of the words in it."""
    coding, lengths = coder(ranks)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
    ids = coding.encode_to_numpy(" " + joined).astype(np.int64)
    word_ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
    id_ends = np.cumsum(lengths[ids])
    return ids, np.concatenate([[0], np.searchsorted(id_ends, word_ends, side="left") + 1])


def ids_before(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The id before each id of words, WORD_START for the first of a word."""
    last = np.concatenate([[WORD_START], ids[:-1]]) if len(ids) else ids
    last[offsets[:-1]] = WORD_START
    return last


def ragged(offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the picked runs one after the other, and the length of each."""
    sizes = np.diff(offsets)[picks]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1][picks] - (ends - sizes), sizes), sizes


@dataclass
class AttentionModel:
    class_of: np.ndarray  # class of each id
    in_class: np.ndarray  # p(id | class)
    pairs: np.ndarray  # sorted keys of (last, id), the most frequent
    pair_n: np.ndarray  # their counts
    pair_sums: np.ndarray  # and the sums of all pairs per last id and class
    base: np.ndarray  # (ids + 1, classes) logits by last id
    row_of: np.ndarray  # embedding row of each id
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    u: np.ndarray
    bias: np.ndarray  # by distance
    word_ends: np.ndarray  # p(a word ends | last id)
    _v_one: np.ndarray | None = None
    _border_logs: np.ndarray | None = None

    @classmethod
    def start(
        cls,
        unigrams: np.ndarray,
        class_of: np.ndarray,
        base: np.ndarray,
        pairs: np.ndarray,
        pair_n: np.ndarray,
        seed: int = 1,
        pair_sums: np.ndarray | None = None,
        word_ends: np.ndarray | None = None,
    ) -> AttentionModel:
        """`pair_sums` are given when `pairs` are not all there are."""
        rng = np.random.default_rng(seed)
        in_class = (unigrams + 0.5) / np.bincount(class_of, weights=unigrams + 0.5, minlength=CLASSES)[class_of]
        if pair_sums is None:
            pair_sums = np.zeros((IDS + 1, CLASSES), dtype=np.float32)
            np.add.at(pair_sums, (pairs // IDS, class_of[pairs % IDS]), pair_n)
        row_of = OWN_ROWS + np.arange(IDS) % SHARED_ROWS
        row_of[np.argsort(-unigrams, kind="stable")[:OWN_ROWS]] = np.arange(OWN_ROWS)
        shape = (OWN_ROWS + SHARED_ROWS, WIDTH)
        q, k, v = (rng.normal(0, 0.3, shape).astype(np.float32) for _ in range(3))
        u = rng.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32)
        base, bias = base.astype(np.float32), np.zeros(WINDOW, np.float32)
        # What does not follow an id inside a word is a word's end behind it.
        ends = unigrams - pair_sums[:IDS].sum(axis=1) if word_ends is None else word_ends
        chance = (np.clip(ends, 0, unigrams) + 0.5) / (unigrams + 1)
        return cls(class_of, in_class, pairs, pair_n, pair_sums, base, row_of, q, k, v, u, bias, chance)

    def borders(self, last: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Natural log of the probability that the word ends (`begins`) or goes on behind the last id."""
        return self.border_logs[begins.astype(np.int8), last]

    @property
    def border_logs(self) -> np.ndarray:
        """The logs of both, by last id."""
        if self._border_logs is None:
            self._border_logs = np.log(np.stack([1 - self.word_ends, self.word_ends]))
        return self._border_logs

    def inside(self, last: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of p(id | class, last), as if pairs that the model does not hold had no count."""
        at, held = self.held(last, ids)
        n = np.where(held, self.pair_n[at], 0.0) if len(self.pairs) else np.zeros(len(ids))
        return np.log((n + PAIR_PRIOR * self.in_class[ids]) / (self.pair_sums[last, self.class_of[ids]] + PAIR_PRIOR))

    def held(self, last: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs in the model, and which of them it holds."""
        key = last * IDS + ids
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        return at, self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), dtype=bool)

    def mask(self, t: int, first: int) -> np.ndarray:
        """Bias by distance for queries from place `first` on; what lies ahead gets no weight."""
        apart = np.arange(first, t)[:, None] - np.arange(t)[None, :]
        return np.where(apart >= 0, self.bias[np.clip(apart, 0, WINDOW - 1)], -1e9).astype(np.float32)

    def bounded(self) -> None:
        """Shrink weights whose products could leave the range in which exp needs no shift by the largest."""
        for left, right in ((self.q, self.k), (self.v, self.u.T)):
            most = np.linalg.norm(left, axis=1).max() * np.linalg.norm(right, axis=1).max()
            if most > 30:
                left *= np.float32(30 / most)
        np.clip(self.bias, -30, 30, out=self.bias)

    def window_scores(self, ids: np.ndarray, targets: np.ndarray, starts_word: np.ndarray, first: int) -> np.ndarray:
        """Natural log probabilities (n, t - first) of the classes of the targets of windows (n, t) of ids."""
        rows = self.row_of[ids]
        q = np.take(self.q, rows[:, first:], axis=0) * np.float32(WIDTH**-0.5)
        w = np.matmul(q, np.take(self.k, rows, axis=0).transpose(0, 2, 1))
        w += self.mask(ids.shape[1], first)
        np.exp(w, out=w)
        # A column of ones behind the values sums the weights in the same product.
        mixed = np.matmul(w, np.take(self.v_one, rows, axis=0)).reshape(-1, WIDTH + 1)
        logits = np.take(self.base, np.where(starts_word[:, first:], WORD_START, ids[:, first:]).ravel(), axis=0)
        logits += (mixed[:, :WIDTH] / mixed[:, WIDTH:]) @ self.u
        target = targets[:, first:].ravel()
        own = logits[np.arange(len(target)), self.class_of[target]]
        np.exp(logits, out=logits)
        return (own - np.log(logits @ np.ones(CLASSES, dtype=np.float32))).reshape(len(ids), -1)

    @property
    def v_one(self) -> np.ndarray:
        if self._v_one is None:
            self._v_one = np.concatenate([self.v, np.ones((len(self.v), 1), dtype=np.float32)], axis=1)
        return self._v_one

    def text_scores(self, ids: np.ndarray, begins: np.ndarray, inside: np.ndarray | None, sizes: np.ndarray) -> np.ndarray:
        """Natural log probability of each text: runs of `sizes` ids that start and stop with the end id;
        `begins` marks ids that begin a word, `inside` has each id's log probability in its class (none: classes alone)."""
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(len(sizes))
        steps = sizes - 1  # ids predicted
        hop = WINDOW - OVERLAP
        more = np.maximum(-(-(steps - WINDOW) // hop), 0)
        # First windows score all their places; later ones those behind the overlap.
        for first, owner, start in (
            (0, np.arange(len(sizes)), offsets[:-1]),
            (OVERLAP, np.repeat(np.arange(len(sizes)), more), None),
        ):
            if start is None:
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more)
                start = offsets[:-1][owner] + (nth + 1) * hop
            for a in range(0, len(owner), WINDOWS_AT_ONCE):
                own, s = owner[a : a + WINDOWS_AT_ONCE], start[a : a + WINDOWS_AT_ONCE]
                place = s[:, None] + np.arange(WINDOW)[None, :]
                there = place < (offsets[own] + steps[own])[:, None]
                place = np.minimum(place, len(ids) - 2)
                scores = self.window_scores(ids[place], ids[place + 1], begins[place + 1], first)
                if inside is not None:
                    scores += inside[place + 1][:, first:]
                out += np.bincount(own, weights=np.where(there[:, first:], scores, 0.0).sum(axis=1), minlength=len(sizes))
        return out

    def gradients(self, ids: np.ndarray, starts_word: np.ndarray) -> tuple[int, np.ndarray]:
        """Of passages (n, WINDOW + 1) of ids: how many ids are predicted, and the gradient of the summed cross-entropy of
        their classes, as one row in the order of `FITTED`; ids below 0 are padding."""
        x, y = np.maximum(ids[:, :-1], 0), ids[:, 1:]
        rows, real = self.row_of[x], (y >= 0).astype(np.float32)
        last, kind = np.where(starts_word[:, 1:], WORD_START, x), self.class_of[np.maximum(y, 0)]
        by_place = np.empty((3, *x.shape, WIDTH), dtype=np.float32)
        d_u, by_distance = np.zeros(self.u.shape), np.zeros((WINDOW, WINDOW))
        for a in range(0, len(x), WINDOWS_AT_ONCE):
            own = slice(a, a + WINDOWS_AT_ONCE)
            one_u, one_s, by_place[:, own] = self.window_gradients(rows[own], last[own].ravel(), kind[own].ravel(), real[own].ravel())
            d_u += one_u
            by_distance += one_s
        flat = rows.ravel()
        out = [
            np.stack([np.bincount(flat, weights=c, minlength=len(self.q)) for c in d.reshape(-1, WIDTH).T], axis=1).ravel() for d in by_place
        ]
        apart = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        by_distance = np.where(apart >= 0, by_distance, 0).ravel()
        out += [d_u.ravel(), np.bincount(np.clip(apart, 0, None).ravel(), weights=by_distance, minlength=WINDOW)]
        return int(real.sum()), np.concatenate(out)

    def window_gradients(
        self, rows: np.ndarray, last: np.ndarray, kind: np.ndarray, real: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of windows (n, WINDOW) of embedding rows, the row of the table, target class and weight of each place: the gradients
        for `u`, for the attention logits summed over windows, and per place for its query, key and value."""
        scale = np.float32(WIDTH**-0.5)
        q, k, v = (np.take(x, rows, axis=0) for x in (self.q * scale, self.k, self.v_one))
        w = np.matmul(q, k.transpose(0, 2, 1))
        w += self.mask(WINDOW, 0)
        np.exp(w, out=w)  # `bounded` keeps the logits in range
        mixed = np.matmul(w, v).reshape(-1, WIDTH + 1)
        sums = mixed[:, WIDTH:]
        mixed = mixed[:, :WIDTH] / sums
        p = np.take(self.base, last, axis=0)
        p += mixed @ self.u
        np.exp(p, out=p)
        # A column of ones beside the classes' weights sums the chances in the same product.
        by_class = np.ascontiguousarray(self.u.T)
        back = p @ np.concatenate([by_class, np.ones((CLASSES, 1), dtype=np.float32)], axis=1)
        share = (real / back[:, WIDTH])[:, None]
        d_mixed = back[:, :WIDTH] * share - np.take(by_class, kind, axis=0) * real[:, None]
        p[np.arange(len(p)), kind] -= back[:, WIDTH]
        d_u = (p.T @ (mixed * share)).T
        # The weights are left unscaled: their sums divide what flows back, and the mean over the keys is a last column.
        d_mixed /= sums
        d = np.concatenate([d_mixed, -np.einsum("ij,ij->i", d_mixed, mixed)[:, None]], axis=1).reshape(v.shape)
        d_s = np.matmul(d, v.transpose(0, 2, 1))
        d_s *= w
        d_q = np.matmul(d_s, k)
        d_q *= scale
        return d_u, d_s.sum(axis=0), [d_q, np.matmul(d_s.transpose(0, 2, 1), q), np.matmul(w.transpose(0, 2, 1), d)[:, :, :WIDTH]]

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in FITTED])

    def with_weights(self, flat: np.ndarray) -> AttentionModel:
        at, parts = 0, {}
        for name in FITTED:
            own = getattr(self, name)
            parts[name] = flat[at : at + own.size].reshape(own.shape).astype(np.float32)
            at += own.size
        return replace(self, **parts, _v_one=None)

    def fit(self, ids: np.ndarray, starts_word: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> None:
        """Adam on the cross-entropy of the classes of passages (n, WINDOW + 1) of ids; ids below 0 are padding."""
        rng = np.random.default_rng(seed)
        adam = Adam(self.weights())
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for a in range(0, len(order), BATCH):
                own = order[a : a + BATCH]
                self.take(adam.step(*self.gradients(ids[own], starts_word[own])))
                self.bounded()
                adam.flat[:] = self.weights()

    def take(self, flat: np.ndarray) -> None:
        other = self.with_weights(flat)
        for name in FITTED:
            getattr(self, name)[...] = getattr(other, name)
        self._v_one = None


FITTED = ["q", "k", "v", "u", "bias"]


class Adam:
    """The weights as one row, and the moments of their gradients."""

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, self.steps = flat.astype(np.float64), 0
        self.mean, self.square = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def step(self, n: int, total: np.ndarray) -> np.ndarray:
        """The weights after a step along a gradient summed over `n` predicted ids."""
        d = total / max(n, 1)
        self.steps += 1
        self.mean += 0.1 * (d - self.mean)
        self.square += 0.001 * (d**2 - self.square)
        m, s = self.mean / (1 - 0.9**self.steps), self.square / (1 - 0.999**self.steps)
        self.flat -= RATE * m / (np.sqrt(s) + 1e-8)
        return self.flat


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(text_or_empty(text)), r"[\x09-\x0D\x20]+"), "")


def split_words(texts: pa.Array) -> pa.ListArray:
    """The same words as those of `words_of`, for a batch of texts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(some)])[ends].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), words.filter(pa.array(some)))


def word_counts(keyed: DataFrame) -> DataFrame:
    """(word, c): how often each word occurs in the texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small_batches(whole, "text", TEXT_BYTES)):
            words = split_words(batch.column("text")).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([words.field("values"), words.field("counts")], names=["word", "c"])

    parts = keyed.select("text").mapInArrow(counted, "word string, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """At most `limit` of the counted words: those that occur as often as some bound or more often. A histogram of the counts, of
    `COUNT_BINS` rows at most, gives the bound, so that no task sorts or holds more than its own words."""
    bins = counts.groupBy(F.least("c", F.lit(COUNT_BINS)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.col("c").desc()).toArrow()
    fit = int(np.searchsorted(np.cumsum(bins["n"].to_numpy()), limit, side="right"))
    if fit:
        return counts.filter(F.col("c") >= bins["c"][fit - 1].as_py())
    # Counts beyond the last bin, or more words of the highest count than may go.
    return counts.orderBy(F.col("c").desc(), "word").limit(limit)


def pair_counts(counts: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(last, id, n): how often an id follows another inside the counted words; `last` of a word's first id is WORD_START."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = word_ids(batch.column("word"), ranks)
            weights = np.repeat(batch.column("c").to_numpy(), np.diff(offsets))
            pairs, which = np.unique(ids_before(ids, offsets) * IDS + ids, return_inverse=True)
            n = np.bincount(which, weights=weights).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs // IDS), pa.array(pairs % IDS), pa.array(n)], names=["last", "id", "n"])

    parts = counts.select("word", "c").mapInArrow(paired, "last long, id long, n long")
    return parts.groupBy("last", "id").agg(F.sum("n").alias("n"))


def id_classes(unigrams: np.ndarray, features: np.ndarray, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Classes of ids with alike contexts: the most frequent third of the classes are ids of their own,
    the others are found by spherical k-means over log counts of the ids before."""
    alone = CLASSES // 3
    order = np.argsort(-unigrams, kind="stable")
    out = np.zeros(IDS, dtype=np.int64)
    out[order[:alone]] = np.arange(alone)
    rest = order[alone:]
    x = np.log1p(features[rest])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    groups = CLASSES - alone
    centres = x[: groups * 16 : 16].copy()
    weight = np.sqrt(unigrams[rest])[:, None]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        for g in range(groups):
            own = near == g
            if own.any():
                centre = (x[own] * weight[own]).sum(axis=0)
                centres[g] = centre / max(np.linalg.norm(centre), 1e-6)
    # Ids never seen have no context; they are dealt to the classes in turn.
    near = np.where(unigrams[rest] > 0, near, np.arange(len(rest)) % groups)
    out[rest] = alone + near
    return out


def start_model(counts: DataFrame, docs: int, ranks: str = RANKS) -> tuple[AttentionModel, DataFrame | None]:
    """The model before its weights are fitted, and (pair, gain) of the pairs that it does not hold: what the log of
    p(id | class, last) gains by their counts. `counts` (word, c) are the words of the training texts, `docs` how many these are."""
    pairs = stage(pair_counts(counts, ranks), "id_pairs")
    unigrams = np.zeros(IDS)
    for row in pairs.groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most as many rows as ids
        unigrams[row["id"]] = row["n"]
    unigrams[END] = docs
    context = np.argsort(-unigrams, kind="stable")[:127].tolist()
    column = {i: n for n, i in enumerate([WORD_START, *context])}
    features = np.zeros((IDS, len(column)), dtype=np.float32)
    seen = pairs.filter(F.col("last").isin(list(column))).toArrow()
    at = np.array([column[i] for i in seen["last"].to_pylist()], dtype=np.int64)
    features[seen["id"].to_numpy(), at] = seen["n"].to_numpy()
    class_of = id_classes(unigrams, features)
    sums = np.zeros((IDS + 1, CLASSES))
    shared = counts.sparkSession.sparkContext.broadcast(class_of)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = pa.array(shared.value[batch.column("id").to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column("last"), kind, batch.column("n")], names=["last", "kind", "n"])

    # At most ids x classes rows, whatever the corpus.
    tabled = pairs.mapInArrow(by_class, "last long, kind long, n long").groupBy("last", "kind").agg(F.sum("n").alias("n")).toArrow()
    sums[tabled["last"].to_numpy(), tabled["kind"].to_numpy()] = tabled["n"].to_numpy()
    sums[WORD_START, class_of[END]] += docs
    overall = sums.sum(axis=0) + 1
    prior = overall / overall.sum()
    base = np.log((sums + 4 * prior) / (sums.sum(axis=1, keepdims=True) + 4))
    kept = pairs.orderBy(F.col("n").desc(), "last", "id").limit(PAIRS).toArrow()
    others = None
    if kept.num_rows == PAIRS:
        least = F.lit(kept["n"][-1].as_py())
        last, at = F.lit(kept["last"][-1].as_py()), F.lit(kept["id"][-1].as_py())
        behind = (F.col("last") > last) | ((F.col("last") == last) & (F.col("id") > at))
        others = pairs.filter((F.col("n") < least) | ((F.col("n") == least) & behind))
    keys = np.append(kept["last"].to_numpy() * IDS + kept["id"].to_numpy(), WORD_START * IDS + END)
    order = np.argsort(keys)
    held_n = np.append(kept["n"].to_numpy(), docs)[order].astype(np.float32)
    ends = unigrams - sums[:IDS].sum(axis=1)
    model = AttentionModel.start(unigrams, class_of, base, keys[order], held_n, pair_sums=sums.astype(np.float32), word_ends=ends)
    if others is not None:
        others = pair_gains(others, model.in_class)
    return model, others


def fit_on_passages(keyed: DataFrame, model: AttentionModel, docs: int, passages: int = PASSAGES, ranks: str = RANKS) -> None:
    """Fits the weights on about `passages` passages of the training texts `keyed` (id, h, text), `docs` in number."""
    of = F.greatest(F.size("w") - PASSAGE_WORDS + 1, F.lit(1))
    place = F.pmod(F.xxhash64(F.lit(5), "id", "h"), of)
    chance = F.pmod(F.xxhash64(F.lit(9), "id", "h"), F.lit(1_000_000)) * F.lit(max(docs, 1))
    picked = (
        keyed.filter(chance < F.lit(passages * 1_000_000))
        .select("id", "h", words_of(F.col("text")).alias("w"))
        .select(
            "id",
            "h",
            F.slice("w", (place + 1).cast("int"), PASSAGE_WORDS).alias("w"),
            (place == 0).alias("opens"),
            (place + PASSAGE_WORDS >= F.size("w")).alias("closes"),
        )
        .orderBy("id", "h")
    )
    sample = picked.select("w", "opens", "closes").toArrow()  # bounded by `passages`
    if sample.num_rows:
        model.fit(*passage_ids(sample, ranks))


def pair_gains(pairs: DataFrame, in_class: np.ndarray) -> DataFrame:
    """(pair, gain): the natural log of (n + A p(id | class)) over A p(id | class)."""
    shared = pairs.sparkSession.sparkContext.broadcast(in_class)

    def gained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            gain = np.log1p(batch.column("n").to_numpy() / (PAIR_PRIOR * shared.value[ids]))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("last").to_numpy() * IDS + ids), pa.array(gain)], names=["pair", "gain"])

    return pairs.mapInArrow(gained, "pair long, gain double")


def fit_on_all(keyed: DataFrame, model: AttentionModel, ranks: str = RANKS, rounds: int = ROUNDS) -> None:
    """One step of Adam for each hashed slice of the texts, so that every id of every text is predicted once.
    `keyed` are texts (id, h, text), or what `tokenised` made of them."""
    context = keyed.sparkSession.sparkContext
    fixed = context.broadcast(model)
    adam = Adam(model.weights())
    for i in range(rounds):
        n, total = slice_gradients(keyed, fixed, adam.flat, i, rounds, ranks)
        if n:
            model.take(adam.step(n, total))
            model.bounded()
            adam.flat[:] = model.weights()


def slice_gradients(keyed: DataFrame, fixed, flat: np.ndarray, i: int, rounds: int, ranks: str = RANKS) -> tuple[int, np.ndarray]:
    """How many ids slice `i` of `rounds` of the texts has, ends included, and the gradient summed over them
    for the weights `flat`; `fixed` is the broadcast model."""
    weights = keyed.sparkSession.sparkContext.broadcast(flat.astype(np.float32))
    n_chunks = -(-len(flat) // CHUNK)
    schema = "chunk int, n long, total array<double>"

    def rows(chunks: list[int], n: int, totals: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(chunks) + 1) * CHUNK, pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(totals))
        return pa.RecordBatch.from_arrays(
            [pa.array(chunks, pa.int32()), pa.array([n] * len(chunks), pa.int64()), lists], names=["chunk", "n", "total"]
        )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fixed.value.with_weights(weights.value)
        n, total = 0, np.zeros(n_chunks * CHUNK)
        for batch in batches:
            for part in small_batches(batch, "ids", ID_BYTES):
                for ids, begins in windows(*written_ids(part)):
                    k, d = model.gradients(ids, begins)
                    n += k
                    total[: len(d)] += d
        if n:
            yield rows(list(range(n_chunks)), n, total)

    def together(table: pa.Table) -> pa.Table:
        n, chunk = pc.sum(table.column("n")).as_py(), table.column("chunk")[0].as_py()
        lists = table.column("total").combine_chunks()
        return pa.Table.from_batches([rows([chunk], n, lists.flatten().to_numpy().reshape(-1, CHUNK).sum(axis=0))])

    coded = keyed if "ids" in keyed.columns else tokenised(keyed, fixed.value, ranks=ranks)
    own = coded.filter((F.col("slice") if "slice" in coded.columns else slice_of(rounds)) == i)
    parts = own.select("ids", "begins").mapInArrow(summed, schema)
    # As many rows as chunks of the weights, whatever the corpus.
    got = parts.groupBy("chunk").applyInArrow(together, schema).toArrow().sort_by("chunk")
    weights.unpersist()
    if not got.num_rows:
        return 0, np.zeros(len(flat))
    return got["n"][0].as_py(), got["total"].combine_chunks().flatten().to_numpy()[: len(flat)]


def slice_of(rounds: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), "id", "h"), F.lit(rounds)).cast("int")


def passage_ids(sample: pa.Table, ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW + 1) ids of the passages, -1 where there is none, and which begin a word."""
    lists = sample["w"].combine_chunks()
    ids, offsets = word_ids(lists.flatten(), ranks)
    per = np.diff(lists.offsets.to_numpy())
    ends = np.concatenate([[0], np.cumsum(per)])
    out = np.full((len(lists), WINDOW + 1), -1, dtype=np.int64)
    begins = np.zeros(out.shape, dtype=bool)
    marks = np.zeros(len(ids) + 1, dtype=bool)
    marks[offsets[:-1]] = True
    for i, (opens, closes) in enumerate(zip(sample["opens"].to_pylist(), sample["closes"].to_pylist())):
        a, b = offsets[ends[i]], offsets[ends[i + 1]]
        row, mark = ids[a:b], marks[a:b]
        if opens:
            row, mark = np.concatenate([[END], row]), np.concatenate([[True], mark])
        if closes:
            row, mark = np.concatenate([row, [END]]), np.concatenate([mark, [True]])
        row, mark = row[: WINDOW + 1], mark[: WINDOW + 1]
        out[i, : len(row)], begins[i, : len(row)] = row, mark
    return out, begins


def runs(words: pa.ListArray) -> Iterator[slice]:
    """Runs of texts with about `WORDS_AT_ONCE` words each."""
    ends = np.cumsum(np.diff(words.offsets.to_numpy()))
    start = 0
    while start < len(words):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE, side="right")))
        yield slice(start, stop)
        start = stop


def windows(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n, WINDOW + 1) ids, -1 behind a text's end, and which begin a word; each id but the first ends is predicted in one."""
    ends = np.cumsum(sizes)
    many = -(-(sizes - 1) // WINDOW)
    owner = np.repeat(np.arange(len(many)), many)
    start = (ends - sizes)[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
    for a in range(0, len(owner), WINDOWS_SUMMED):
        place = start[a : a + WINDOWS_SUMMED, None] + np.arange(WINDOW + 1)[None, :]
        there = place < ends[owner[a : a + WINDOWS_SUMMED], None]
        place = np.minimum(place, len(ids) - 1)
        yield np.where(there, ids[place], -1), begins[place] & there


class Texts:
    """Texts given as lists of words, as one line of ids with an end before and behind each text."""

    def __init__(self, words: pa.ListArray, ranks: str = RANKS, known: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """`known` are the `word_ids` of the dictionary of words that have one."""
        n = len(words)
        self.n_words = np.diff(words.offsets.to_numpy())
        coded = words.flatten()
        coded = coded if known else coded.dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.word_ids, self.offsets = known or word_ids(self.words, ranks)
        self.owner = np.repeat(np.arange(n), self.n_words)
        self.place, lengths = ragged(self.offsets, self.codes)
        begin = np.zeros(len(self.place), dtype=bool)
        begin[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        per = np.bincount(self.owner, weights=lengths, minlength=n).astype(np.int64)
        self.sizes = per + 2
        ends = np.cumsum(self.sizes)
        self.ids, self.begins = np.full(ends[-1], END, dtype=np.int64), np.ones(ends[-1], dtype=bool)
        self.inside = np.ones(len(self.ids), dtype=bool)
        self.inside[ends - 1], self.inside[ends - self.sizes] = False, False
        self.ids[self.inside], self.begins[self.inside] = self.word_ids[self.place], begin

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return windows(self.ids, self.begins, self.sizes)

    def written(self) -> list[pa.Array]:
        """`ids` and `begins` of each text as bytes: two of an id, one of a mark."""
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        return [
            pa.Array.from_buffers(pa.binary(), len(self.sizes), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(values)])
            for values, width in ((self.ids.astype("<u2"), 2), (self.begins.astype(np.uint8), 1))
        ]


def written_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, marks and sizes of texts from the bytes that `Texts.written` made of them."""

    def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends)

    (ids, _), (begins, sizes) = flat(batch.column("ids"), "<u2"), flat(batch.column("begins"), "?")
    return ids.astype(np.int64), begins, sizes.astype(np.int64)


TOKENISED = (
    "id {kind}, h long, n_tokens long, n_common long, common_log double, fixed double, rare array<string>, open array<long>, ids binary, begins binary"
)
NO_WORDS = (pa.array([], pa.string()), np.zeros(0))


def word_table(words: pa.Array, model: AttentionModel, whole: bool, ranks: str = RANKS) -> tuple[np.ndarray, ...]:
    """What a text needs of its words: their ids, the offsets of the words in them, the ids before, the log probabilities inside
    their classes, and which pairs the model does not hold (none when it holds all, `whole`)."""
    ids, offsets = word_ids(words, ranks)
    before = ids_before(ids, offsets)
    lacks = np.zeros(len(before), dtype=bool) if whole else ~model.held(before, ids)[1]
    return ids, offsets, before, model.inside(before, ids), lacks


def with_words(table: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two tables of `word_table` as one, the words of the second behind those of the first."""
    ids, offsets, *rest = (np.concatenate([a, b]) for a, b in zip(table, (more[0], more[1][1:] + len(table[0]), *more[2:])))
    return ids, offsets, *rest


def tokenised(
    keyed: DataFrame, model: AttentionModel, common: tuple[pa.Array, np.ndarray] = NO_WORDS, whole: bool = True, ranks: str = RANKS
) -> DataFrame:
    """Per text its ids and what does not depend on the fitted weights: the natural log of its word ends and of its ids in their
    classes (`fixed`), the sums over its common words (given with their counts), its other words, and the pairs of ids inside its
    words that the model does not hold; none when it holds all (`whole`)."""
    schema = TOKENISED.format(kind=keyed.schema["id"].dataType.simpleString())
    common_words, counts = common
    shared = keyed.sparkSession.sparkContext.broadcast((model, common_words, np.log10(counts + 1.0), word_table(common_words, model, whole, ranks)))

    def lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common_words, common_logs, cut_before = shared.value
        for batch in (part for whole in batches for part in small_batches(whole, "text", TEXT_BYTES)):
            words = split_words(batch.column("text"))
            # What depends on the word alone is found once for all texts of the batch, and for common words once for all.
            coded = words.values.dictionary_encode()
            at = pc.fill_null(pc.index_in(coded.dictionary, value_set=common_words), -1).to_numpy().astype(np.int32)
            others = coded.dictionary.filter(pa.array(at < 0))
            at[at < 0] = len(common_words) + np.arange(len(others))
            word_list = pa.concat_arrays([common_words, others])
            words = pa.ListArray.from_arrays(words.offsets, pa.DictionaryArray.from_arrays(at[coded.indices.to_numpy()], word_list))
            known = np.arange(len(word_list)) < len(common_words)
            logs = np.append(common_logs, np.zeros(len(others)))
            word, offsets, before, within, lacks = with_words(cut_before, word_table(others, model, whole, ranks))
            for run in runs(words):
                n, text = run.stop - run.start, Texts(words[run], ranks, (word, offsets))
                own, codes, owner = text.n_words, text.codes, text.owner
                rare = ~known[codes]
                chances = np.full(len(text.ids), model.inside(np.array([WORD_START]), np.array([END]))[0])
                chances[text.inside] = within[text.place]
                chances[1:] += model.borders(text.ids[:-1], text.begins[1:])
                chances[np.cumsum(text.sizes) - text.sizes] = 0
                lacking = lacks[text.place]
                lacking_at = text.place[lacking]
                lacking_keys = before[lacking_at] * IDS + word[lacking_at]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id")[run],
                        batch.column("h")[run],
                        pa.array(own.astype(np.int64) + 1),
                        pa.array(np.bincount(owner, weights=known[codes], minlength=n).astype(np.int64)),
                        pa.array(np.bincount(owner, weights=logs[codes], minlength=n).astype(np.float64)),
                        pa.array(np.bincount(np.repeat(np.arange(n), text.sizes), weights=chances, minlength=n)),
                        lists(np.bincount(owner[rare], minlength=n), text.words.take(pa.array(codes[rare]))),
                        lists(np.bincount(np.repeat(np.arange(n), text.sizes - 2)[lacking], minlength=n), pa.array(lacking_keys)),
                        *text.written(),
                    ],
                    names=["id", "h", "n_tokens", "n_common", "common_log", "fixed", "rare", "open", "ids", "begins"],
                )

    return keyed.select("id", "h", "text").mapInArrow(cut, schema)


def class_scores(rows: DataFrame, model: AttentionModel) -> DataFrame:
    """`rows` (what `tokenised` made) with the log10 probabilities of the texts, but for the pairs that the model does not hold."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = ["id", "h", "n_tokens", "n_common", "common_log"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small_batches(whole, "ids", ID_BYTES)):
            ids, begins, sizes = written_ids(batch)
            score = (shared.value.text_scores(ids, begins, None, sizes) + batch.column("fixed").to_numpy()) / np.log(10)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(score)], names=[*names, "score"])

    return rows.select(*names, "fixed", "ids", "begins").mapInArrow(judged, f"{kinds}, score double")


def scored(
    keyed: DataFrame, model: AttentionModel, common: tuple[pa.Array, np.ndarray], whole: bool = True, ranks: str = RANKS
) -> DataFrame:
    """`class_scores` of texts (id, h, text)."""
    return class_scores(tokenised(keyed, model, common, whole, ranks), model)


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", common_words: int = COMMON_WORDS) -> DataFrame:
    """Per row of `docs`: id, n_tokens, n_known, train_tokens, base_score, score. `held_out` is a condition on `id`."""
    keyed = with_row_key(docs, id_col, text_col)
    training = keyed.filter(~held_out)
    counts = stage(word_counts(training), "word_counts")
    n_docs = training.count()
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train, n_types = totals[0] + n_docs, totals[1] + (1 if n_docs else 0)
    model, others = start_model(counts, n_docs)
    top = most_frequent(counts, common_words).toArrow()
    common = (top["word"].combine_chunks().cast(pa.string()), top["c"].to_numpy().astype(np.float64))
    rows = tokenised(keyed, model, common, others is None)
    rows = stage(rows.withColumn("slice", F.when(~held_out, slice_of(ROUNDS)).otherwise(-1)), "tokenised", by="slice")
    if n_docs:
        fit_on_passages(training, model, n_docs)
        fit_on_all(rows, model, rounds=ROUNDS)
    judged = stage(class_scores(rows, model), "scored")
    rare = rows.select("id", "h", F.explode("rare").alias("word")).withColumn("word", F.xxhash64("word"))
    # Rows that agree in id and text are counted together here, and divided again below.
    same = rows.groupBy(F.col("id").alias("i2"), F.col("h").alias("h2")).agg(F.count("*").alias("rows"))
    met = rare.join(counts.groupBy(F.xxhash64("word").alias("word")).agg(F.sum("c").alias("c")), "word")
    met = met.groupBy("id", "h").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("c") + 1)).alias("rare_log"))
    met = met.join(same, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))).select(
        "i2", "h2", (F.col("n_rare") / F.col("rows")).cast("long").alias("n_rare"), (F.col("rare_log") / F.col("rows")).alias("rare_log")
    )
    met = stage(met, "rare_sums")
    out = judged.join(met, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left").drop("i2", "h2")
    score = F.col("score")
    if others is not None:
        # A pair counts as often as it occurs in the text.
        open_pairs = rows.select("id", "h", F.explode("open").alias("pair"))
        gains = open_pairs.join(others, "pair").groupBy("id", "h").agg(F.sum("gain").alias("gain"))
        gains = gains.join(same, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")))
        gains = stage(gains.select("i2", "h2", (F.col("gain") / F.col("rows")).alias("gain")), "pair_gains")
        out = out.join(gains, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left")
        score = score + F.coalesce("gain", F.lit(0.0)) / float(np.log(10))
    end_log = float(np.log10(n_docs + 1))
    base = F.col("common_log") + F.coalesce("rare_log", F.lit(0.0)) + end_log - F.col("n_tokens") * float(np.log10(n_train + n_types + 1))
    return out.select(
        "id",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + (1 if n_docs else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
    )


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_scores(table(spark, sf_dir, "documents"), is_held_out(F.col("id")))
    return rows.select(
        F.col("id").alias("doc_id"), is_held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
