"""Language-model scores and licence matches against plain Python."""

from __future__ import annotations

import pytest

from check_oracle import compare
from playtally.llm import license_scan, lm_score
from playtally.llm.shared import documents
from tests.llm.cases import EDGE, clashing, ordered, table


@pytest.mark.parametrize("slice_bytes, bucket_words", [(lm_score.SLICE_BYTES, lm_score.BUCKET_WORDS), (20_000, 500)])
def test_scores(spark, sf_dir, slice_bytes, bucket_words):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_dir).limit(60).collect()] + EDGE[:5]
    target = {d for d, _ in docs[:20]} | {None}
    ids = spark.createDataFrame([(d,) for d in target] * 2, "doc_id bigint")
    found = lm_score.cross_entropy_difference(clashing(table(spark, docs)), ids, slice_bytes=slice_bytes, bucket_words=bucket_words).collect()
    texts = [(t or "").encode() for _, t in docs]
    aims = [d in target and d is not None for d, _ in docs]
    want = lm_score.brute_force(texts, aims, lm_score.PRIOR)
    got = ordered(((r.doc_id, r.n_words), tuple(r)[2:]) for r in found)
    for (key, values), (doc, expected) in zip(got, ordered(((d, w[0]), w[1:]) for (d, _), w in zip(docs, want, strict=True)), strict=True):
        assert key == doc and values == pytest.approx(expected, abs=1e-9)


def test_good_texts_score_lower(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    means = lm_score.op9_lm_score(spark, sf_dir).join(labels, "doc_id").groupBy("quality").avg("score").collect()
    means = {r[0]: r[1] for r in means}
    assert means[1] < means[0]


def test_no_target_and_no_rows(spark):
    none = table(spark, [])
    some = table(spark, EDGE)
    assert lm_score.cross_entropy_difference(none, none.select("doc_id")).count() == 0
    assert lm_score.cross_entropy_difference(some, none.select("doc_id")).count() == len(EDGE)


def plain_dice(a: str, b: str) -> float:
    a, b = (license_scan.words(x.encode()) for x in (a, b))
    a, b = set(zip(a, a[1:], strict=False)), set(zip(b, b[1:], strict=False))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_matches(spark, threshold):
    lines = [t for _, t in license_scan.TEMPLATES] + ["released under the mit license", "x y", "Under the MIT License", ""]
    docs = [(i, f"intro words\n{line}\n{line.upper()} tail") for i, line in enumerate(lines)] + [*EDGE, (90, lines[0]), (90, lines[0])]
    templates = license_scan.template_table(spark)
    found = license_scan.scan(clashing(table(spark, docs)), templates, threshold).collect()
    want = []
    for doc, text in docs:
        parts = (text or "").split("\n")
        for number, unit in enumerate([text or "", *(parts if len(parts) > 1 else ())]):
            for i, (name, template) in enumerate(license_scan.TEMPLATES):
                if (dice := plain_dice(unit, template)) >= threshold:
                    want.append((doc, number, name, i, dice))
    assert ordered(map(tuple, found)) == ordered(want) and want


def test_same_as_sql(spark, sf_dir):
    ok, note = compare(spark, "op2_license_scan", sf_dir)
    assert ok, note


def test_no_rows_or_templates(spark):
    templates = license_scan.template_table(spark)
    assert license_scan.scan(table(spark, []), templates).count() == 0
    assert license_scan.scan(table(spark, EDGE), templates.limit(0)).count() == 0
