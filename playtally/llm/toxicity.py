"""Toxic spans and document scores by a linear-chain CRF (1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.llm.crf import Model, Words, calibrate, fit
from playtally.llm.language import first_of_each, remainder, sample_texts
from playtally.llm.shared import documents, fitted, keyed_texts, mix, packed, schema_with, slices, text_bytes, unpacked

CLEAN, TOXIC = "0", "1"
#: Training texts of either label, and their greatest length: the sample that one task holds.
SAMPLE, SAMPLE_CHARS = {TOXIC: 800, CLEAN: 2000}, 6000
THRESHOLD = 0.3
ROUNDS, RATE = 14, 1.0
#: A word of toxic texts is toxic if so many of its texts are toxic, and if that
#: tells so much more (in nats) than the share of toxic texts at large.
LEAST_PRECISION, LEAST_GAIN = 0.9, 9.0
#: Value of a gram's feature; that of a whole word is 1.
GRAM_VALUE = 1.0
#: Words whose marginal is reported as a span.
SPAN = 0.5
#: Words whose marginal adds to the document's score.
SUSPECT = 0.2

def token_labels(words: Words, toxic: np.ndarray) -> np.ndarray:
    """1 for the words of toxic texts that toxic texts have in common and clean ones lack.

    Copies of a text count once.
    """
    group = copies(words, len(toxic))
    guilty_doc = toxic[words.doc]
    found, at = np.unique(words.hash, return_inverse=True)
    pairs = np.unique(np.column_stack([at, 2 * group[words.doc] + guilty_doc]), axis=0)
    texts, guilty = np.bincount(pairs[:, 0]), np.bincount(pairs[:, 0], pairs[:, 1] % 2)
    base = min(max(len(np.unique(group[toxic])) / max(1, len(np.unique(group))), 1e-6), 1 - 1e-6)
    share = np.clip(guilty / texts, 1e-6, 1 - 1e-6)
    gain = guilty * np.log(share / base) + (texts - guilty) * np.log((1 - share) / (1 - base))
    gain = np.where(share >= LEAST_PRECISION, gain, 0.0)
    # A small sample tells less of any word.
    toxic_word = found[gain >= max(min(LEAST_GAIN, gain.max() / 2), 1.0)]
    return (np.isin(words.hash, toxic_word) & guilty_doc).astype(np.int64)


def copies(words: Words, texts: int, rounds: int = 4, shingle: int = 5) -> np.ndarray:
    """A number for each text of the sample, equal for near copies: texts that share a smallest shingle."""
    root = np.arange(texts)
    hashes = words.hash.copy()
    for i in range(1, min(shingle, len(words))):
        hashes[:-i] += mix(words.hash[i:] + np.uint64(i))
    for i in range(rounds):
        least = np.full(texts, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, words.doc, mix(hashes + np.uint64(i)))
        _, first, at = np.unique(least, return_index=True, return_inverse=True)
        # Texts that share one now join the groups of the first of them.
        order = np.argsort(root[first])[::-1]
        for k in order:
            mine = np.unique(root[at == k])
            if len(mine) > 1:
                root[np.isin(root, mine)] = mine[0]
    return root


def learn(docs: DataFrame, per_label: dict[str, int] = SAMPLE, max_chars: int = SAMPLE_CHARS, rounds: int = ROUNDS) -> Model:
    """A model from (doc_id, text, toxic).

    The labels are of documents; ``token_labels`` makes them labels of words.
    Rows without text or label are no training rows, nor are texts above
    ``max_chars``; of the others ``per_label`` are learned from. If either label
    is missing every score is 0.
    """

    def train(texts: list[str], labels: list[str]) -> dict:
        words = Words(*text_bytes(pa.array(texts, pa.large_string())))
        toxic = np.array([x == TOXIC for x in labels], bool)
        target = token_labels(words, toxic) if len(words) else np.zeros(0, np.int64)
        if not target.any():
            return vars(Model([], {}, np.empty(0, np.uint64), np.empty(0), np.empty(0), np.empty(0), np.empty(0)))
        model = fit(words, target, [CLEAN, TOXIC], rounds=rounds, rate=RATE, gram_value=GRAM_VALUE)
        model.slope, model.level = calibrate(evidence(model, words, len(texts))[0], toxic.astype(float))
        return vars(model)

    return Model(**fitted(sample_texts(docs, "toxic", per_label, max_chars), train, "toxic"))


def evidence(model: Model, words: Words, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of what speaks against a text being clean, and each word's marginal.

    Suspect words add up as independent chances; where there is none the
    largest marginal counts, so length alone makes no text toxic.
    """
    probs = model.marginals(words)[:, 1] if len(words) else np.zeros(0)
    against = np.where(probs >= SUSPECT, -np.log1p(-np.minimum(probs, 1 - 1e-9)), 0.0)
    most = np.zeros(texts)
    np.maximum.at(most, words.doc, probs)
    return np.log(np.bincount(words.doc, against, texts) + most + 1e-9), probs


def _score(model):
    def score(batches):
        m = Model(**model.value)
        for batch in slices(batches, 1_000_000):
            n = batch.num_rows
            scores = np.zeros(n)
            offsets: list[list[int]] = [[] for _ in range(n)]
            if m.labels:
                words = Words(*text_bytes(batch.column("text")))
                against, probs = evidence(m, words, n)
                scores = 1 / (1 + np.exp(-np.clip(m.slope * against + m.level, -30, 30)))
                for i in np.flatnonzero(probs >= SPAN):
                    begin, end = int(words.offset[i]), int(words.offset[i] + words.stop[i] - words.first[i])
                    own = offsets[words.doc[i]]
                    if own and begin == own[-1] + 1:
                        own[-1] = end
                    else:
                        own += [begin, end]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.clip(scores, 0.0, 1.0)),
                    pa.array(offsets, pa.list_(pa.int64())),
                ],
                names=["doc_id", "score", "offsets"],
            )

    return score


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, offsets) for every row of ``docs`` (doc_id, text).

    The marginals of a text's words give the evidence that some word is toxic
    (see ``evidence``), and ``score`` is its probability by the training labels;
    ``offsets`` has begin and end of the toxic spans in bytes of the
    UTF-8 text. Null, empty and wordless texts have the lowest score and no span.
    """
    held = docs.sparkSession.sparkContext.broadcast(vars(model))
    return keyed_texts(docs).mapInArrow(
        _score(held), "doc_id bigint, score double, offsets array<bigint>"
    )


def _without(model):
    score = _score(model)

    def keep(batches):
        for batch in slices(batches, 1_000_000):
            for judged in score(iter([batch])):
                clean = np.asarray(judged.column("score")) < THRESHOLD
                yield batch.select(["row", "text"]).filter(pa.array(clean))

    return keep


def without_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))
    rows = packed(docs, id_col, text_col)
    kept = rows.mapInArrow(_without(held), schema_with(rows, "text string"))
    return unpacked(kept, docs.columns, text_col)


def labelled(docs: DataFrame, labels: DataFrame, per_label: dict[str, int] = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of a bounded draw of the training labels.

    Training rows are those whose crc32(doc_id) modulo 4 is not 2. A document
    that is labelled several times is toxic if any label says so. Only the ids
    drawn, four for each text that ``learn`` can take (some have no text, or one
    that is too long), are sent to the documents.
    """
    train = labels.where(F.col("doc_id").isNotNull() & (remainder("doc_id", 4) != 2)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    counts = {r["toxic"]: r["count"] for r in train.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    drawn = first_of_each(train, "toxic", per_label, counts, least=4)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scores(docs, model).select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "offsets",
    )
