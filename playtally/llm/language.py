"""Language identification of code-switched text by a linear-chain CRF over words (10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playtally.llm.crf import Model, Words, fit
from playtally.llm.shared import documents, fitted, keyed_texts, slices, text_bytes

#: Training texts for each language, and their greatest length: the sample that one task holds.
SAMPLE, SAMPLE_CHARS = 150, 10_000
MAX_LANGUAGES = 200
ROUNDS = 14
UNKNOWN = "und"

_SCALE = 1 << 30


def first_of_each(rows: DataFrame, label: str, wanted: dict[str, int], counts: dict, least: int = 1) -> DataFrame:
    """Of each label the first rows in the order of a hash of the other columns: ``least`` times ``wanted``.

    ``counts`` of the labels' rows bound what is put in order to about twice
    as many. Equal rows count once.
    """
    others = [c for c in rows.columns if c != label]
    place = F.pmod(F.xxhash64(*others), F.lit(_SCALE))
    share, most = F.lit(0.0), F.lit(0)
    for value, count in counts.items():
        number = least * wanted.get(str(value), 0)
        # Twice the number and some more: by chance practically never too few.
        share = F.when(F.col(label) == value, F.lit((2 * number + 20) / count)).otherwise(share)
        most = F.when(F.col(label) == value, F.lit(number)).otherwise(most)
    drawn = rows.where(place < share * _SCALE).distinct()
    ranked = drawn.withColumn("_rank", F.row_number().over(W.partitionBy(label).orderBy(place, *others)))
    return ranked.where(F.col("_rank") <= most).select(*rows.columns)


def sample_texts(docs: DataFrame, label: str, per_label: int | dict[str, int], max_chars: int) -> DataFrame:
    """(text, label): the first ``per_label`` texts of each label in the order of a hash.

    ``docs`` has (doc_id, text) and ``label``. Texts above ``max_chars`` are not
    drawn; of more than ``MAX_LANGUAGES`` labels, those with the most texts are.
    """
    docs = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    docs = docs.select("doc_id", "text", label)
    found = docs.groupBy(label).count().sort(F.desc("count"), label).limit(MAX_LANGUAGES).collect()
    counts = {row[label]: row["count"] for row in found}
    wanted = per_label if isinstance(per_label, dict) else {str(x): per_label for x in counts}
    return first_of_each(docs, label, wanted, counts).select("text", label)


def learn(docs: DataFrame, per_label: int = SAMPLE, max_chars: int = SAMPLE_CHARS, rounds: int = ROUNDS) -> Model:
    """A model from (doc_id, text, lang); each word of a training text bears its language.

    Rows without text or language are no training rows, nor are texts above
    ``max_chars``. Of each language ``per_label`` texts are learned from, of at
    most ``MAX_LANGUAGES`` languages: those with the most texts. Without any the
    model has no languages and predicts none.
    """

    def train(texts: list[str], langs: list[str]) -> dict:
        labels = sorted(set(langs))
        words = Words(*text_bytes(pa.array(texts, pa.large_string())))
        target = np.array([labels.index(x) for x in langs], np.int64)
        return vars(fit(words, target[words.doc] if len(words) else target[:0], labels, rounds=rounds))

    return Model(**fitted(sample_texts(docs, "lang", per_label, max_chars), train, "lang"))


def _has_letter(texts: list[str | None], words: Words) -> np.ndarray:
    have = np.zeros(len(texts), bool)
    have[words.doc] = True  # of bytes that can be a letter
    for i in np.flatnonzero(have):
        have[i] = any(map(str.isalpha, texts[i]))
    return have


def _predict(model):
    def predict(batches):
        m = Model(**model.value)
        labels = np.array([*m.labels, UNKNOWN], dtype=object)
        for batch in slices(batches, 1_000_000):
            texts = batch.column("text")
            words = Words(*text_bytes(texts))
            n, k = batch.num_rows, len(m.labels)
            best, score = np.full(n, k), np.zeros(n)
            runs = np.zeros(n, np.int64)
            if k and len(words):
                probs = m.marginals(words)
                mass = np.stack([np.bincount(words.doc, probs[:, j], n) for j in range(k)], axis=1)
                have = _has_letter(texts.to_pylist(), words)
                best[have] = mass[have].argmax(axis=1)
                score[have] = mass[have].max(axis=1) / mass[have].sum(axis=1)
                own = probs.argmax(axis=1)
                turn = words.fresh | np.append(True, own[1:] != own[:-1])
                runs = np.bincount(words.doc[turn], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(labels[best].tolist(), pa.string()),
                    pa.array(np.clip(score, 0.0, 1.0)),
                    pa.array(runs),
                ],
                names=["doc_id", "lang_pred", "score", "n_runs"],
            )

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, n_runs) for every row of ``docs`` (doc_id, text).

    Marginals of all words add up to the text's languages: ``lang_pred`` has
    the largest share and ``score`` is that share. ``n_runs`` counts stretches
    of words of one language. A text that is null, empty or without a letter
    is ``und`` with score 0; of equal shares the first language in order wins.
    """
    held = docs.sparkSession.sparkContext.broadcast(vars(model))
    return keyed_texts(docs).mapInArrow(
        _predict(held), "doc_id bigint, lang_pred string, score double, n_runs bigint"
    )


def remainder(key: str, by: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % by, F.lit(-1))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 5) == 0
    model = learn(docs.where(~held_out & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    found = predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_runs")
