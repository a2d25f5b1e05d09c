"""The corpus pipeline: its contract, and each stage's decisions on its own input."""

from __future__ import annotations

import hashlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from contractlake.llm import jaccard, line_dedup, mixing
from contractlake.llm.common import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_contract(spark, stages):
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    for df in stages[:-1]:
        assert df.columns == P.COLUMNS
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, P.run(spark, SF).collect())) == Counter(map(tuple, stages[-1].collect()))


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    toxic = [r["doc_id"] for r in labels.filter("toxic = 1").collect()]
    clean = [r["doc_id"] for r in labels.filter("toxic = 0").collect()]
    assert sum(i in left for i in toxic) <= 0.3 * len(toxic) and sum(i in left for i in clean) >= 0.98 * len(clean)
    before = {r["doc_id"]: r for r in stages[0].collect()}
    assert all(r == before[r["doc_id"]] for r in stages[1].collect())


def test_lines_go_and_the_length_follows(spark, stages):
    want = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated(stages[1]).collect()}
    got = {r["doc_id"]: r for r in stages[2].collect()}
    assert all(r["text"] == want[i] for i, r in got.items())
    assert all(not want[i].split() for i in set(want) - set(got))
    changed = [r for i, r in got.items() if r["n_chars"] != len(r["text"])]
    assert changed == []


def test_one_of_each_class_stays(spark, stages):
    classes = jaccard.jaccard_classes(stages[2]).collect()
    left = Counter(r["doc_id"] for r in stages[3].collect())
    assert set(left) == {r["doc_id"] for r in classes if r["first"]} and set(left.values()) == {1}
    assert {r["class_id"] for r in classes} == set(left)


def test_the_mix_holds_its_copies(spark, stages):
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in stages[4].collect()) == want


def test_all_of_the_mix_is_encoded(spark, stages):
    assert stages[5].count() == stages[4].count()
    assert stages[5].filter("n_tokens > 0").count() == stages[4].filter(F.trim("text") != "").count()


def test_the_tokenized_mix_is_written(spark, stages):
    shared = spark.conf.get("spark.checkpoint.dir")
    found = sorted(Path(shared.removeprefix("file:")).glob("tokenized-mix-*"), key=lambda x: x.stat().st_mtime)
    mix = spark.read.parquet(str(found[-1])).collect()
    assert Counter((r["doc_id"], r["lang"], r["source"]) for r in mix) == Counter((r["doc_id"], r["lang"], r["source"]) for r in stages[4].collect())
    ids = Counter((r["doc_id"], len(r["ids"]), hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in mix)
    assert ids == Counter(map(tuple, stages[5].collect()))


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    """Null and blank texts, null ids, languages and sources, rows given twice, a very long text, columns that clash with the stages' own; and no row at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, o long, th long, pos long, k0 string, body string, score double"
    long = " ".join(f"w{i * i % 7919}" for i in range(40_000))
    whole = [(i, f"{' '.join(f'v{i * 100 + k}' for k in range(60))}\n", "en", "a" if i % 3 else None, 60) for i in range(30)]
    odd = [(100, None, "en", "a", None), (101, "", None, None, 0), (102, " \n\t ", "en", "b", 4), (None, "an id that is null", "en", "b", 18), (103, "given twice", "en", "b", 11), (103, "given twice", "en", "b", 11), (104, long, "en", "c", len(long))]
    for name, rows in (("odd", whole + odd), ("empty", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame([(*r, 1, 2, 3, "k", "b", 0.5) for r in rows], schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(r[0], 0, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        at, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
        for stage, run in P.STAGES[:3]:
            at = written(run(spark, at, sf), f"odd-{stage}")
            kept.append(Counter((r["doc_id"], r["text"]) for r in at.collect()))
            assert at.columns == P.COLUMNS
        want = Counter((r[0], r[1]) for r in rows)
        assert kept[0] == kept[1] == want  # nothing toxic, no run twice
        assert {k for k in kept[2] if (k[1] or "").strip()} == {k for k in want if (k[1] or "").strip()} and kept[2][103, "given twice"] <= 1
        out = P.run(spark, sf).collect()
        assert {r["doc_id"] for r in out} <= {k[0] for k in kept[2]} and (len(out) > 0) == (len(rows) > 0)
