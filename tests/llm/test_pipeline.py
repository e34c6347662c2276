import gc
import re
import time
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline as p
from quillstack.llm import quality
from quillstack.llm.common import Memo, cut, release
from quillstack.llm.simhash import fingerprint

SF = "/root/testdata/sf0.01"


def near_roots(texts):
    fps = sorted({fingerprint(t) for t in texts})
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {x: find(x) for x in fps}


def test_each_stage_on_its_own_input(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    outputs = []
    for name, stage in p.STAGES:
        after = cut(stage(spark, docs, SF), "test-stage")
        outputs.append((name, docs.collect(), after.collect()))
        docs = after
        if name != p.STAGES[-1][0]:
            assert after.columns == columns
    (_, before, good), (_, _, unlike), (_, _, apart), (_, _, mixed), (_, _, coded) = outputs
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    memo = Memo(model.word, 100_000)
    assert {r.doc_id for r in good} == {r.doc_id for r in before if model.scores([r.text], memo)[0] >= 0.7}
    last = {}
    for r in good:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in unlike) == sorted(last.values())
    roots = near_roots([r.text for r in unlike])
    least = {}
    for r in unlike:
        k = roots[fingerprint(r.text)]
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in apart) == sorted(least.values())
    tokens = sum(len(r.text.split()) for r in apart)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in apart} and max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert tokens * 0.9 < sum(len(r.text.split()) for r in mixed) <= tokens
    sp = sentencepiece.SentencePieceProcessor(model_file=p.pieces.MODEL_PATH)
    text = {r.doc_id: r.text for r in mixed}
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in mixed)
    assert all(r.ids == sp.encode(text[r.doc_id]) and r.round_trip for r in coded)


def test_odd_rows_go_through(spark):
    rows = [(None, None, None, None, 1), (1, "", "en", "a", 2), (1, "", "en", "a", 2), (2, "some good words in a row", None, "a", 3), (2, "some good words in a row", None, "a", 3), (3, "long " * 30_000, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long")
    good = p.quality_filter(spark, docs, SF)
    assert good.columns == docs.columns and {str(r) for r in good.collect()} <= {str(r) for r in docs.collect()}
    for first in (0, 1):
        after = docs
        for name, stage in p.STAGES[first:]:
            after = cut(stage(spark, after, SF), "odd")
        assert {r.doc_id for r in after.collect()} <= {None, 1, 2, 3}
    once = cut(p.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long"), SF), "odd")
    assert sorted(str(r.doc_id) for r in once.collect()) == ["1", "2", "3"] and once.columns[-1] == "kept"


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = cut(stage(spark, docs, SF), "empty")
    assert docs.collect() == []


def jvm_mb(spark):
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


@pytest.mark.parametrize("give_back", [release, lambda spark: cut(spark.range(1), "test-trim")])
def test_the_driver_gives_freed_memory_back(spark, give_back):
    jvm = spark.sparkContext._jvm
    # Blocks of the C library's heap, not of Java's; one in fifty stays, so that freeing the others leaves holes.
    held = [jvm.java.nio.ByteBuffer.allocateDirect(100_000) for _ in range(2_000)]
    kept = held[::50]
    del held
    for _ in range(2):
        gc.collect()
        jvm.java.lang.System.gc()
        time.sleep(1)
    before = jvm_mb(spark)
    give_back(spark)
    assert before - jvm_mb(spark) > 80
    assert len(kept) == 40
