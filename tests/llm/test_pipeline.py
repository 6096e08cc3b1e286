"""The pipeline's stages, each on what the one before kept."""

import json

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text import EDGES, base_spans, components_by_force

import __spark_entry__ as entry
from domainscope.llm import decontaminate, pii, toxicity
from domainscope.testing import difference


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(top / name))
        out[name] = docs, (docs := spark.read.parquet(str(top / name)))
    return out


def rows(df, column="text"):
    return {r["doc_id"]: r[column] for r in df.collect()}


def test_columns_and_order(stages, spark, sf_dir):
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(stages[n][1].columns == columns for n in list(stages)[:-1])


def test_toxicity_drops_by_score(stages, spark, sf_dir):
    """Scores themselves are held against their definition in test_text."""
    before, after = stages["toxicity"]
    model = toxicity.fitted(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert rows(after) == {i: t for i, t in rows(before).items() if toxicity.score(model, t or "")[0] < 0.3}


def test_near_duplicates_against_all_pairs(stages):
    before, after = stages["near_duplicates"]
    given = list(rows(before).items())
    least = {c for _, n, c in components_by_force(given, 5, 80) if n}
    assert {str(i) for i in rows(after)} == least | {i for i, n, _ in components_by_force(given, 5, 80) if not n}


def test_decontamination_against_full_edit_matrices(stages, spark, sf_dir):
    before, after = stages["decontamination"]
    items = [decontaminate.words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def holds(doc, item):
        row, column = np.zeros(len(doc) + 1, np.int64), np.arange(len(doc) + 1)
        for x in item:
            step = np.minimum(row[1:] + 1, row[:-1] + (doc != x))
            row = np.minimum.accumulate(np.r_[row[0] + 1, step] - column) + column
        return row.min() <= len(item) // 4

    clean = {i: t for i, t in rows(before).items() if not any(holds(doc, x) for doc in [decontaminate.words(t or "")] for x in items)}
    assert rows(after) == clean and len(clean) < before.count()


def test_personal_data_against_patterns(stages):
    """Texts without disclosing terms are rebuilt by hand; the others lose their base spans all the same."""
    before, after = stages["pii"]
    terms = {r["doc_id"]: r["n_terms"] for r in pii.spans(before).collect()}
    new = rows(after)
    assert set(new) == set(rows(before))
    for i, t in rows(before).items():
        out, done = "", 0
        for a, b, k in sorted((a, b, k) for k, a, b in base_spans(t)):
            out += t[done:a] + f"[{k.upper()}]" if a >= done else ""
            done = max(done, b)
        if not terms[i]:
            assert new[i] == (None if t is None else out + t[done:])
    left = pii.spans(after).select(F.sum("n_email"), F.sum("n_ip"), F.sum("n_card"), F.sum("n_phone")).first()
    assert tuple(left) == (0, 0, 0, 0) and sum(len(base_spans(t)) for t in rows(before).values()) > 0
    assert all(len(t) == n for t, n in zip(new.values(), rows(after, "n_chars").values(), strict=True))


def test_token_ids_against_the_library(stages):
    import base64
    from hashlib import sha256

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = stages["byte_bpe"]
    assert rows(after, "ids") == {i: enc.encode_ordinary(t or "") for i, t in rows(before).items()}
    assert rows(after, "decoded_sha256") == {i: sha256((t or "").encode()).hexdigest() for i, t in rows(before).items()}


def odd(spark):
    """Nulls, empty and repeated rows, a very long text, and columns whose names clash with those used within."""
    given = [(i, t, None, None, None) for i, t in EDGES] + [(50, "long words again " * 100_000, "en", "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(7).alias(c) for c in ("t", "n", "c", "root", "component", "key", "row", "h1", "base", "k1", "cuts", "score", "held")))


def test_stages_take_odd_rows(spark, sf_dir):
    df = odd(spark)
    kept = {name: [r.asDict() for r in stage(spark, df, sf_dir).collect()] for name, stage in corpus_pipeline.STAGES}
    for name, rows_ in kept.items():
        if name != "byte_bpe":
            assert rows_ and set(rows_[0]) == set(df.columns) and all(r["t"] == r["cuts"] == 7 for r in rows_)
    count = lambda name, text: sum(r["text"] == text for r in kept[name])
    assert count("near_duplicates", "same words here twice") == 1 and count("near_duplicates", None) == count("pii", None) == 2
    assert len(kept["decontamination"]) == len(kept["pii"]) == len(kept["byte_bpe"]) == df.count()
    assert sorted(str(r["text"]) for r in kept["pii"]) == sorted(str(r["text"]) for r in df.collect())
    assert {r["n_chars"] for r in kept["pii"] if r["text"] is not None} == {len(r["text"]) for r in df.collect() if r["text"] is not None}
    assert sum(r["n_tokens"] == 0 for r in kept["byte_bpe"]) == 3


def test_stages_take_empty_tables(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd(spark).limit(0), sf_dir)
        assert found.count() == 0 and (name == "byte_bpe" or found.columns == odd(spark).columns)


def test_run_is_registered(spark, sf_dir, stages):
    found = entry.queries()["pipeline"](spark, sf_dir)
    key = lambda df: sorted(json.dumps(r.asDict()) for r in df.collect())
    assert key(found) == key(stages["byte_bpe"][1])


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_agrees_with_sql(spark, sf_dir, name):
    assert difference(entry.queries()[name](spark, sf_dir), sf_dir, entry.oracle_sql()[name]) is None


def test_every_operator_is_registered(spark, sf_dir):
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
