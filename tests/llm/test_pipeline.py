"""The pipeline's stages against plain Python on small documents."""

import zlib
from collections import Counter

import numpy as np
import pytest
from test_small_cases import brute_components, brute_spans, check_packing

import corpus_pipeline
from tallymark.llm import toxicity
from tallymark.llm.common import stored


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The smallest documents with some odd rows, and their labels."""
    at = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(900001, None, None, None, None), (900002, "", "en", None, 0), (900003, "a token=abcdefghij b c d e f g", "en", "src0", 30), (900004, "a token=abcdefghij b c d e f g", "en", "src1", 30), (None, "no id at all", "en", "src1", 12)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).coalesce(3).write.parquet(str(at / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(at / "labels.parquet"))
    return str(at)


def test_stages_equal_plain_python(spark, folder):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    before = sorted(docs.collect(), key=key)
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, out, folder), name)
        got = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            got.sort(key=key)
        if name == "toxicity":
            want = [r for r in before if model.score(r.text) < 0.3]
            assert [(r.doc_id, r.text) for r in got] == [(r.doc_id, r.text) for r in want]
        elif name == "near_duplicates":
            with_id = [r for r in before if r.doc_id is not None]
            comps = brute_components([r.text for r in with_id], 5, 80)
            smallest = {}
            for r, (_, _, c) in zip(with_id, comps):
                smallest[c] = min(smallest.get(c, r.doc_id), r.doc_id)
            assert [r.doc_id for r in got] == sorted(smallest.values()) + [None] * (len(before) - len(with_id))
        elif name == "secrets":
            for a, b in zip(before, got):
                text, at = "", 0
                for s, _, e in brute_spans(a.text or "")[1]:
                    if s >= at:
                        text += a.text[at:s] + "[SECRET]"
                    at = max(at, e)
                assert b.text == (a.text if a.text is None else text + a.text[at:]) and a.doc_id == b.doc_id
                assert b.n_chars == (None if b.text is None else len(b.text))
        elif name == "mixing":
            times = Counter(r.doc_id for r in got)
            assert set(times) <= {r.doc_id for r in before} and max(times.values()) <= 2
            words = lambda rows: sum(len((r.text or "").split()) for r in rows)
            assert abs(words(got) / (1.5 * words(before)) - 1) < 0.05
        else:
            library = Tokenizer.from_file(p.path("word_bpe_49k.json"))
            check_packing(got, 4096)
            want = Counter()
            for r in before:
                ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
                for i in range(0, len(ids), 4096):
                    want[r.doc_id, i // 4096, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())] += 1
            assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == want
        before = got
    assert corpus_pipeline.run(spark, folder).count() == len(before)


def test_pipeline_of_no_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
