import hashlib

import corpus_pipeline
import pytest
from millrace.llm.bpe import default_path
from millrace.llm.lines import MAX_DOCUMENTS
from millrace.llm.mixing import mix
from millrace.llm.secrets import find, redacted

from .helpers import DOCS, clashing, docs, hard_rows, prose
from .test_lines import boilerplate, verdicts
from .test_simhash import brute_components


def brute(spark, rows):
    """The rows of the pipeline for rows of documents: each stage by its brute force, the drawing by the mixing operator's own table."""
    rows = [r for r, kept in zip(rows, verdicts(rows, MAX_DOCUMENTS, copies_once=True, spare_first=True), strict=True) if kept]
    first = {c for _, _, c in brute_components([r[:2] for r in rows])}
    rows = [r for r in rows if r[0] in first]
    rows = [(r[0], redacted(r[1], [*find(r[1])[0], *find(r[1])[1]]), *r[2:]) for r in rows]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.no_padding()
    t.no_truncation()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r[0]: r[1] for r in rows}
    out = []
    for r in mix(spark.createDataFrame(rows, DOCS)).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        out.append((r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def test_pipeline_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = brute(spark, rows)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "secret scans", "mixing sources", "BPE encoding"]
    rows = [(i, *r[1:]) for i, r in enumerate(hard_rows() + boilerplate())] + [(900 + i, f"{prose(77, 80)} password = hunter2hunter2", "en", "a", 0) for i in range(3)]
    df = docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns
        df = spark.createDataFrame(out.collect(), out.schema)
    texts = [r["text"] for r in df.collect()]
    assert len(texts) > 10 and not any("hunter2" in t for t in texts)
    assert [r["doc_id"] for r in df.where("text like '%[assign]%'").select("doc_id").distinct().collect()] == [900]


@pytest.mark.parametrize("extra", [False, True])
def test_empty_and_clashing(spark, tmp_path, extra):
    df = docs(spark, []) if not extra else clashing(docs(spark))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert (got.count() > 0) == extra
