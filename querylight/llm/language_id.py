"""Language identification by interpolated Kneser-Ney models of the characters of words.

Each language gets a model of the characters inside words (runs of letters and marks, lower-cased,
with a start and an end sign), of order `ORDER`: the highest order counts occurrences, lower orders
count the different signs before a gram, and every order gives its discount to the next lower one.
All languages share one sorted array of gram hashes per order; beside each hash stand the finished
log probabilities and back-off weights of all languages, so a gram is looked up once for all. A
batch looks up its different words only. The language with the lowest cross-entropy per sign wins.

Training takes at most about `SAMPLE_ROWS` documents of each language, chosen by hash from the
training folds; a third fold of as many gives each language's usual cross-entropy and its spread, and
a document whose cross-entropy lies beyond the calibrated bound is marked as rejected.

Results for odd input: a text that is null or has no letter is `und` with score 0 and rejected; so is
every text when nothing can be learned. Ties go to the first language in order. Repeated rows are
judged alike. Only texts are looked at when judging. Rows with a null id or language teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.llm.registry import query, table

ORDER = 5
SAMPLE_ROWS = 1000  # labelled documents per language for the models, and as many for the bounds
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
LEAST_Z, SLACK = 6.0, 2.0  # a rejected text lies beyond both
BATCH_BYTES = 1 << 20  # text judged at once
START, END = 2, 3
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % FOLDS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def letter_words(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Lists of lower-case words per text, and whether a text has a letter."""
    low = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    spaced = pc.utf8_trim(pc.replace_substring_regex(low, r"[^\p{L}\p{M}]+", " "), " ")
    return pc.split_pattern(spaced, " "), pc.match_substring_regex(low, r"\p{L}")


def word_signs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, with start and end signs; the place of each word's start."""
    joined = "".join([f"\x02{w}\x03" for w in words])
    signs = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return signs, np.flatnonzero(signs == START)


def gram_hashes(signs: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the grams of 1..order signs that end at each place (meaningless before a word's start)."""
    out = [mix(signs + GOLD)]
    for _ in range(order - 1):
        longer = np.zeros_like(signs)
        longer[1:] = mix(out[-1][:-1] * GOLD + signs[1:])
        out.append(longer)
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `wanted` in the sorted `keys`, and which are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)


@dataclass
class CharModels:
    """`keys[m]`: sorted hashes of grams of m+1 signs; `prob[m]`, `back[m]`: their log probabilities and the
    log weights that they, as contexts, give to shorter grams, per language."""

    langs: list[str]
    keys: list[np.ndarray]
    prob: list[np.ndarray]
    back: list[np.ndarray]
    floor: np.ndarray
    usual: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = 0.0

    @classmethod
    def train(cls, words: dict[str, tuple[list[str], np.ndarray]], order: int = ORDER) -> CharModels:
        """From the words of each language and how often they occur."""
        langs = sorted(words)
        seen: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(order)]
        alphabet: set[int] = set()
        for lang in langs:
            texts, counts = words[lang]
            signs, starts = word_signs(texts)
            alphabet.update(np.unique(signs).tolist())
            lengths = np.diff(np.append(starts, len(signs)))
            behind = np.arange(len(signs)) - np.repeat(starts, lengths)  # signs of the word before each place
            weight = np.repeat(counts, lengths).astype(np.float64)
            grams = gram_hashes(signs, order)
            for m in range(order):
                at = np.flatnonzero(behind >= m)
                gram, one, which = np.unique(grams[m][at], return_index=True, return_inverse=True)
                context = grams[m - 1][at[one] - 1] if m else None
                suffix = grams[m - 1][at[one]] if m else None
                # Lower orders count the signs on the left; a gram at a word's start has none and counts its
                # occurrences, and the start sign itself is never predicted.
                raw = (behind[at] == m) | (m + 1 == order)
                w = np.where(behind[at] == 0, 0.0, weight[at])
                own = np.bincount(which[raw], weights=w[raw], minlength=len(gram))
                if not raw.all():
                    other = np.flatnonzero(~raw & (w > 0))
                    _, kinds = np.unique(grams[m + 1][at[other]], return_index=True)
                    own += np.bincount(which[other[kinds]], minlength=len(gram))
                seen[m].append((gram, context, suffix, own))
        keys, prob, back, floor = [], [], [], None
        for m in range(order):
            union = np.unique(np.concatenate([s[0] for s in seen[m]])) if langs else np.zeros(0, np.uint64)
            p = np.zeros((len(union), len(langs)))
            # A gram's context and suffix are the same in every language that has it.
            context_at, suffix_at = np.zeros(len(union), np.int64), np.zeros(len(union), np.int64)
            for gram, context, suffix, _ in seen[m] if m else ():
                at = np.searchsorted(union, gram)
                context_at[at], suffix_at[at] = np.searchsorted(keys[-1], context), np.searchsorted(keys[-1], suffix)
            for lang, (gram, _, _, own) in enumerate(seen[m]):
                counts = np.zeros(len(union))
                counts[np.searchsorted(union, gram)] = own
                once, twice = (counts == 1).sum(), (counts == 2).sum()
                discount = np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9)
                where = context_at
                size = len(keys[-1]) if m else 1
                total = np.bincount(where, weights=counts, minlength=size)
                kinds = np.bincount(where, weights=counts > 0, minlength=size)
                give = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
                seen_share = np.maximum(counts - discount, 0) / np.maximum(total, 1e-9)[where]
                lower = prob[-1][suffix_at, lang] if m else 1.0 / (len(alphabet) + 1)
                p[:, lang] = seen_share + give[where] * lower
                if m:
                    back[-1][:, lang] = np.log(give)
                else:
                    floor = np.zeros(len(langs)) if floor is None else floor
                    floor[lang] = np.log(give[0] / (len(alphabet) + 1))
            keys.append(union)
            prob.append(p)
            back.append(np.zeros((len(union), len(langs))))
        logs = [np.log(np.maximum(p, 1e-30)).astype(np.float32) for p in prob]
        return cls(langs, keys, logs, [b.astype(np.float32) for b in back], floor if langs else np.zeros(0))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word under each language."""
        signs, starts = word_signs(words)
        if not len(signs):
            return np.zeros((0, len(self.langs)))
        behind = np.arange(len(signs)) - np.repeat(starts, np.diff(np.append(starts, len(signs))))
        grams = gram_hashes(signs, len(self.keys))
        out = np.zeros((len(signs), len(self.langs)), dtype=np.float64)
        left = np.flatnonzero(behind > 0)
        for m in range(len(self.keys) - 1, -1, -1):
            now = left[behind[left] >= m]
            at, there = find(self.keys[m], grams[m][now])
            out[now[there]] += self.prob[m][at[there]]
            missed = now[~there]
            if m:
                at, there = find(self.keys[m - 1], grams[m - 1][missed - 1])
                out[missed[there]] += self.back[m - 1][at[there]]
                left = np.sort(np.concatenate([left[behind[left] < m], missed]))
            else:
                out[missed] += self.floor
        return np.add.reduceat(out, starts, axis=0)

    def judge(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per text: lang, score, cross_entropy, signs, rejected."""
        lists, lettered = letter_words(texts)
        n, langs = len(texts), len(self.langs)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        vocabulary = coded.dictionary.to_pylist()
        owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        word_scores = self.word_scores(vocabulary)
        sizes = np.array([len(w) + 1 for w in vocabulary], dtype=np.float64)
        signs = np.bincount(owner, weights=sizes[codes], minlength=n).astype(np.float64)
        some = lettered.to_numpy(zero_copy_only=False) & (langs > 0)
        out = {
            "lang": np.full(n, "und", dtype=object),
            "score": np.zeros(n),
            "cross_entropy": np.full(n, np.nan),
            "signs": signs,
            "rejected": np.ones(n, dtype=bool),
        }
        if not some.any():
            return out
        totals = np.stack([np.bincount(owner, weights=word_scores[codes, i], minlength=n) for i in range(langs)], axis=1)
        entropy = -totals / np.maximum(signs, 1)[:, None]
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(n), best]
        sure = 1 / np.exp(-np.minimum((entropy - least[:, None]) * signs[:, None], 700)).sum(axis=1)
        out["lang"][some] = np.array(self.langs, dtype=object)[best[some]]
        out["score"][some] = np.clip(sure[some], 0, 1)
        out["cross_entropy"][some] = least[some]
        if self.usual is None:
            out["rejected"][some] = False
        else:
            far = (least - self.usual[best]) * np.sqrt(signs) / self.spread[best]
            out["rejected"] = ~some | ((far > self.limit) & (least > SLACK * self.usual[best]))
        return out

    def calibrate(self, langs: list[str], entropy: np.ndarray, signs: np.ndarray) -> None:
        """Usual cross-entropy and spread of each language from other labelled texts, and the bound beyond which none lies."""
        own = np.array([self.langs.index(x) for x in langs], dtype=np.int64)
        if not len(own):
            return
        k, pooled = len(self.langs), float(np.mean(entropy))
        n = np.bincount(own, minlength=k)
        self.usual = np.where(n > 0, np.bincount(own, weights=entropy, minlength=k) / np.maximum(n, 1), pooled)
        square = ((entropy - self.usual[own]) ** 2) * signs
        wide = float(np.sqrt(np.mean(square))) or 1.0
        own_spread = np.sqrt(np.bincount(own, weights=square, minlength=k) / np.maximum(n, 1))
        self.spread = np.where((n > 1) & (own_spread > 0), own_spread, wide)
        far = (entropy - self.usual[own]) * np.sqrt(signs) / self.spread[own]
        self.limit = max(LEAST_Z, 1.5 * float(np.quantile(far, 0.999)))


def small_batches(batch: pa.RecordBatch, text_col: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `size` bytes of text, a row at least."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).cast(pa.int64())).to_numpy()
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    if not batch.num_rows:
        yield batch


def sampled(labelled: DataFrame, rows: int) -> DataFrame:
    """About `rows` documents of each language at most, by hash of id and text."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("of"))
    million = 1_000_000
    chance = F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(million)) * F.col("of")
    return labelled.join(F.broadcast(counts), "lang").filter(chance < rows * million).drop("of")


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) of labelled texts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small_batches(whole, "text")):
            lists, _ = letter_words(batch.column("text"))
            parents = pc.list_parent_indices(lists)
            pairs = pa.table({"lang": batch.column("lang").take(parents), "word": lists.flatten().cast(pa.string())})
            counts = pairs.group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from counts.rename_columns(["lang", "word", "n"]).to_batches()

    parts = labelled.select("text", "lang").mapInArrow(split, "lang string, word string, n long")
    return parts.filter("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train_models(docs: DataFrame, rows: int = SAMPLE_ROWS, order: int = ORDER) -> CharModels:
    """Models and bounds from the labelled training folds of `docs` (doc_id, text, lang)."""
    labelled = docs.filter("text is not null and lang is not null and doc_id is not null").select(
        F.col("doc_id").alias("id"), "text", "lang", fold(F.col("doc_id")).alias("fold")
    )
    learn = labelled.filter(~F.col("fold").isin(HELD_OUT, CALIBRATION))
    words: dict[str, tuple[list[str], np.ndarray]] = {}
    # Bounded by `rows` documents per language.
    counted = word_counts(sampled(learn, rows)).toArrow()
    for lang in sorted(set(counted["lang"].to_pylist())):
        part = counted.filter(pc.equal(counted["lang"], lang)).sort_by("word")
        words[lang] = (part["word"].to_pylist(), part["n"].to_numpy())
    models = CharModels.train(words, order)
    known = labelled.filter(F.col("lang").isin(models.langs)) if models.langs else labelled.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    judged = judge_with(sampled(known.filter(F.col("fold") == CALIBRATION), rows), "text", shared)
    right = judged.filter((F.col("lang") == F.col("lang_pred"))).select("lang", "cross_entropy", "signs").toPandas()
    shared.destroy()
    models.calibrate(right["lang"].tolist(), right["cross_entropy"].to_numpy(), right["signs"].to_numpy())
    return models


def judge_texts(docs: DataFrame, text_col: str, models: CharModels) -> DataFrame:
    """`docs` with lang_pred, score, cross_entropy, signs and rejected (replaced where `docs` has such columns)."""
    return judge_with(docs, text_col, docs.sparkSession.sparkContext.broadcast(models))


def judge_with(docs: DataFrame, text_col: str, shared: Broadcast) -> DataFrame:
    added = "lang_pred string, score double, cross_entropy double, signs double, rejected boolean"
    names = [x.split()[0] for x in added.split(", ")]
    rest = [c for c in docs.columns if c not in names or c == text_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small_batches(whole, text_col)):
            out = shared.value.judge(batch.column(text_col))
            arrays = [pa.array(out["lang"], pa.string()), *[pa.array(out[c]) for c in ("score", "cross_entropy", "signs", "rejected")]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])
            pa.default_memory_pool().release_unused()

    return docs.select(*rest).mapInArrow(judged, f"{schema}, {added}")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, …) whose language is recognised.

    Only texts go to Python, and only a flag comes back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train_models(docs))

    @F.arrow_udf("boolean")
    def recognised(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in texts:
            parts = small_batches(pa.RecordBatch.from_arrays([whole], names=["text"]), "text")
            flags = [~shared.value.judge(part.column("text"))["rejected"] for part in parts]
            yield pa.array(np.concatenate(flags))
            pa.default_memory_pool().release_unused()

    return docs.filter(recognised(F.col("text")))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = judge_texts(docs.select("doc_id", "text"), "text", train_models(docs))
    return judged.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "cross_entropy",
        "rejected",
    )
