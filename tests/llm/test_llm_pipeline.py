"""The pipeline's stages, each against a plain version on what the stage before kept."""

import collections
import os
import re
import sys
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from edge import edge_table, texts  # noqa: E402
from test_llm_neardup import brute as components  # noqa: E402
from test_llm_quality import brute as counts  # noqa: E402

from attest.llm import quality, toxicity  # noqa: E402
from attest.llm.common import table  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def features(text):
    n, chars, symbols, dup, repeat, failed = counts(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda part, whole: part / whole if whole else 0.0
    row = (float(n), share(chars, n), share(symbols, n), share(dup, len(lines)), share(repeat, n),
           share(len(re.findall("[A-Z]", text or "")), chars), share(len(re.findall("[!?]", text or "")), n),
           share(len(re.findall("[0-9]", text or "")), chars))
    return failed, row


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    labels = table(spark, SF_DIR, "labels")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality-rules", "toxicity", "near-duplicates", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}

    rules = quality.fit(docs, labels)
    want = {i for i, t in texts.items() if not features(t)[0] and not any(quality._covers(r, features(t)[1]) for r in rules)}
    good = corpus_pipeline.keep_good(spark, docs, SF_DIR)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == want

    net = toxicity.fit(good, labels)
    calm = {i for i in want if net.scores(*toxicity.buckets(pa.array([texts[i].encode()])))[0] < 0.5}
    clean = corpus_pipeline.keep_clean(spark, good, SF_DIR)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == calm

    single = {i for i, _, c in components([(i, texts[i]) for i in sorted(calm)]) if i == c}
    lone = corpus_pipeline.drop_near_copies(spark, clean, SF_DIR)
    assert lone.columns == docs.columns and {r.doc_id for r in lone.collect()} == single

    size = collections.Counter()
    for r in corpus_pipeline.pack(spark, lone, SF_DIR).collect():
        size[r.doc_id] += r["size"]
    assert size == {i: counts(texts[i])[0] + 1 for i in single}


def test_stages_stand_edge_rows_and_empty_tables(spark):
    """Nulls, blanks, long and repeated rows, clashing names; then no rows at all, stage by stage."""
    rows = texts()
    docs, none = edge_table(spark), edge_table(spark, [])
    rules = quality.fit(docs, table(spark, SF_DIR, "labels"))
    stay = [i for i, t, _ in rows if not features(t)[0] and not any(quality._covers(r, features(t)[1]) for r in rules)]
    good = corpus_pipeline.keep_good(spark, docs, SF_DIR)
    assert good.columns == docs.columns and sorted((r.doc_id for r in good.collect()), key=str) == sorted(stay, key=str)
    net = toxicity.fit(docs, table(spark, SF_DIR, "labels"))
    calm = [i for i, t, _ in rows if net.scores(*toxicity.buckets(pa.array([(t or "").encode()])))[0] < 0.5]
    clean = corpus_pipeline.keep_clean(spark, docs, SF_DIR)
    assert clean.columns == docs.columns and sorted((r.doc_id for r in clean.collect()), key=str) == sorted(calm, key=str)
    single = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    lone = {i for i, _, c in components([(i, t) for i, t, _ in rows]) if i == c}
    assert single.columns == docs.columns
    got = [r.doc_id for r in single.collect()]
    assert {i for i in got if i is not None} == {i for i in lone if i is not None} and got.count(None) == 1 and got.count(3) <= 1
    packed = corpus_pipeline.pack(spark, docs, SF_DIR).collect()
    size = collections.Counter()
    for r in packed:
        size[r.doc_id] += r["size"]
    assert size[1] == counts(texts()[0][1])[0] + 1 and size[9] == 9001
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.keep_clean, corpus_pipeline.drop_near_copies, corpus_pipeline.pack):
        assert stage(spark, none, SF_DIR).count() == 0


def test_run_writes_every_stage(spark):
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert packed.columns == ["doc_id", "piece", "start", "size", "bin", "offset"] and packed.count() > 0
