"""Language identification as inference over a mixture of languages.

Training counts byte trigrams (letters lower-cased, everything else one blank) per language over all training rows: each task sums its own
rows, Spark sums the tasks. A language is a smoothed distribution over ``BUCKETS`` hashed trigrams.

A document is a bag of words; each word comes from one language, with the likelihood of its trigrams in it, or from a background in which
all buckets are equally likely: words that fit no known language. Expectation-maximisation estimates the document's proportions. For the
languages in falling order of proportion, the sets of the first one, two, three and so on, each with the background, are fitted again, and
the set with the largest penalised likelihood ``log L - PENALTY * |set| * log(words)`` is taken. Sets grow until an upper bound of the
likelihood over all languages shows that no larger set can win; there is no other limit. The prediction is the set's language of largest
proportion, the score that proportion; proportions are of all words, so the background's is what the languages leave. Documents of fewer
than ``BACKGROUND_WORDS`` words have no background.

All documents of a slice are fitted at once on arrays; a document's result depends on its own text only.

Defined results: null text or one without a letter is ``und`` with score 0 and no languages; so is every document when no training row
exists. Training rows with null text, language or id are skipped. Long texts are used whole. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm import wordhash as W
from ravelin.llm.registry import query, table

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Share of the probability that is spread over all buckets.
SMOOTHING = 0.02
#: The model is brought to the driver and broadcast: languages x buckets numbers. More languages are an error, not a cut.
MAX_LANGUAGES = 500
ROUNDS = 6
#: A word counts at most so much (natural log) against a language: names and junk decide nothing alone.
ODD_WORD = 14.0
PENALTY = 3.0
#: Proportion of the background before the first round.
BACKGROUND = 0.05
#: Shorter documents have no background: of fewer words (95 % Wilson bound) it can't be told that most fit no language.
BACKGROUND_WORDS = 4
UNKNOWN = "und"

_letters = np.full(256, 32, np.uint8)
_letters[97:123] = np.arange(97, 123)
_letters[65:91] = np.arange(97, 123)
_letters[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams around the words of a slice, the first trigram of each word, and the row of each word.

    Rows are laid out with blanks between them. A word of n bytes has n trigrams: from the blank before it to its last byte.
    """
    n, rows = len(data), len(offsets) - 1
    padded = np.full(n + rows + 3, 32, np.uint8)
    where = np.arange(n) + np.repeat(np.arange(rows), np.diff(offsets)) + 1
    padded[where] = _letters[data]
    inside = padded != 32
    at = np.flatnonzero(inside)
    wide = padded.astype(np.uint32)
    gram = (wide[at - 1] << np.uint32(16)) | (wide[at] << np.uint32(8)) | wide[at + 1]
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    first = np.flatnonzero(~inside[at - 1])
    begins = offsets[:-1] + np.arange(rows) + 1
    return bucket, first, np.searchsorted(begins, at[first], "right") - 1


def trigram_counts(rows: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of (lang, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for start, stop, data, offsets in W.text_slices(batch.column(1)):
                bucket, first, row = trigrams(data, offsets)
                if not len(first):
                    continue
                names, codes = np.unique(batch.column(0).slice(start, stop - start).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                each = np.repeat(codes[row], np.diff(np.append(first, len(bucket))))
                counts = np.bincount(each * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, line in zip(names.tolist(), counts):
                    totals[name] = totals[name] + line if name in totals else line
        for name, line in totals.items():
            used = np.flatnonzero(line)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used.astype(np.int32)), pa.array(line[used].astype(np.int64))], names=["lang", "bucket", "n"])

    seen = rows.select("lang", "text").mapInArrow(scan, "lang string, bucket int, n long")
    return seen.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages (sorted), their shares of the training text, and log probabilities by bucket (BUCKETS x languages)."""

    def __init__(self, counts: DataFrame):
        found = counts.toPandas().sort_values(["lang", "bucket"])
        self.languages = sorted(found["lang"].unique())
        table_ = np.zeros((BUCKETS, len(self.languages)))
        table_[found["bucket"].to_numpy(), np.searchsorted(self.languages, found["lang"])] = found["n"]
        total = table_.sum(0)
        self.log_p = np.log((1 - SMOOTHING) * table_ / np.maximum(total, 1) + SMOOTHING / BUCKETS).astype(np.float32)
        self.share = (total / max(total.sum(), 1) * 0.5 + 0.5 / max(len(self.languages), 1)).astype(np.float32)


def train(docs: DataFrame, text: str, lang: str) -> Model:
    some = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    languages = some.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Model(trigram_counts(some))


def _fit(likely: np.ndarray, share: np.ndarray, rows: np.ndarray, first: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per document after ``rounds`` of EM and their log likelihood (less the words' own scale); a language at 0 stays at 0."""
    for _ in range(rounds):
        part = share[rows] * likely
        part /= part.sum(1, keepdims=True)
        share = (np.add.reduceat(part, first, axis=0) / counts[:, None]).astype(np.float32)
    value = np.log((share[rows] * likely).sum(1).astype(np.float64))
    return share, np.add.reduceat(value, first)


def _most(likely: np.ndarray, share: np.ndarray, value: np.ndarray, rows: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Upper bound of the log likelihood of each document over all proportions (Jensen's inequality at ``share``, whose value is ``value``)."""
    ratio = likely / (share[rows] * likely).sum(1, keepdims=True)
    return value + counts * np.log(np.maximum((np.add.reduceat(ratio, first, axis=0) / counts[:, None]).max(1), 1))


def mixture(model_log_p: np.ndarray, prior: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have words, their proportions) over the languages; languages outside the chosen set have proportion 0, the background has the rest."""
    bucket, first_gram, word_row = trigrams(data, offsets)
    if not len(first_gram):
        return np.zeros(0, np.int64), np.zeros((0, len(prior)), np.float32)
    logs = np.add.reduceat(model_log_p[bucket], first_gram, axis=0)
    uniform = np.diff(np.append(first_gram, len(bucket))) * np.float32(-np.log(BUCKETS))
    docs, first, rows, counts = np.unique(word_row, return_index=True, return_inverse=True, return_counts=True)
    few = counts < BACKGROUND_WORDS
    logs = np.column_stack([logs, np.where(few[rows], -np.inf, uniform)]).astype(np.float32)
    likely = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -ODD_WORD))
    start = np.repeat(np.append(prior * (1 - BACKGROUND), BACKGROUND).astype(np.float32)[None], len(docs), 0)
    start[few] = np.append(prior, 0)
    shares, value = _fit(likely, start, rows, first, counts, ROUNDS)
    most = _most(likely, shares, value, rows, first, counts)
    rank = np.argsort(np.argsort(-shares[:, :-1], axis=1, kind="stable"), axis=1)
    rank = np.column_stack([rank, np.full(len(docs), -1)])
    step = PENALTY * np.log(np.maximum(counts, 2))
    best, chosen = np.full(len(docs), -np.inf), np.zeros_like(shares)
    for size in range(1, len(prior) + 1):
        # larger sets can't be better where even the bound is not
        open_ = np.flatnonzero(most - step * size > best)
        if not len(open_):
            break
        some = np.isin(rows, open_) if len(open_) < len(docs) else np.ones(len(rows), bool)
        n = counts[open_]
        kept = np.where(rank[open_] < size, np.maximum(shares[open_], 1e-4), 0).astype(np.float32)
        kept[few[open_], -1] = 0
        kept /= kept.sum(1, keepdims=True)
        fitted, value = _fit(likely[some], kept, np.repeat(np.arange(len(open_)), n), np.cumsum(n) - n, n, ROUNDS)
        value -= step[open_] * size
        better = value > best[open_]
        best[open_[better]], chosen[open_[better]] = value[better], fitted[better]
    return docs, chosen[:, :-1]


def identify(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` (without its text, if not ``keep_text``) with lang_pred, score and languages (list of (lang, share), largest first)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p, model.share))
    given = docs.withColumn("_letters", F.coalesce(F.regexp_like(F.col(text), F.lit(r"\p{L}")), F.lit(False)))
    names = given.columns
    own = [i for i, c in enumerate(names) if c != "_letters" and (keep_text or c != text)]
    at, flag = names.index(text), names.index("_letters")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, log_p, prior = shared.value
        labels = np.array([*languages, UNKNOWN], dtype=object)
        for batch in batches:
            for start, stop, data, offsets in W.text_slices(batch.column(at)):
                n = stop - start
                part = batch.slice(start, n)
                pred, score, listed = np.full(n, len(languages)), np.zeros(n), [[]] * n
                if languages:
                    rows, shares = mixture(log_p, prior, data, offsets)
                    known = part.column(flag).to_numpy(zero_copy_only=False)[rows]
                    rows, shares = rows[known], shares[known]
                    pred[rows], score[rows] = shares.argmax(1), np.minimum(shares.max(1), 1.0)
                    for r, s in zip(rows.tolist(), shares):
                        listed[r] = [{"lang": languages[i], "share": float(s[i])} for i in np.argsort(-s, kind="stable").tolist() if s[i] > 0]
                out = [pa.array(labels[pred], pa.string()), pa.array(score), pa.array(listed, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in own), *out], names=[*(names[i] for i in own), "_lang", "_score", "_languages"])

    kinds = ", ".join(f"`{names[i]}` {given.schema[i].dataType.simpleString()}" for i in own)
    found = given.mapInArrow(scan, f"{kinds}, _lang string, _score double, _languages array<struct<lang:string,share:double>>")
    return found.withColumns({"lang_pred": F.col("_lang"), "score": F.col("_score"), "languages": F.col("_languages")}).drop("_lang", "_score", "_languages")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2. A null id is neither held out nor trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_documents(docs: DataFrame) -> Model:
    return train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()), "text", "lang")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Documents of which the known languages together hold at least ``min_score`` of the words, all columns as they were."""
    found = identify(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}), train_on_documents(docs), "in_text")
    known = F.aggregate("languages", F.lit(0.0), lambda acc, x: acc + x["share"])
    return found.where((F.col("lang_pred") != UNKNOWN) & (known >= min_score)).select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))


@query("op10_language_mixture")
def op10_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train_on_documents(docs), keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
