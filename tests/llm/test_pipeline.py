"""Every stage on what the one before it kept, against a plain reading."""

import corpus_pipeline
from tests.compare import TESTDATA
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_jaccard import brute as components
from tideline.llm import quality, toxicity
from tideline.llm.common import crc_remainder, prepare, stored, table

SF = f"{TESTDATA}/sf0.001"


def test_stages(spark):
    prepare(spark)
    docs = table(spark, SF, "documents")
    labels, benchmark = table(spark, SF, "labels"), [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    columns, given = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, given, SF), "test-stage")
        before, after = given.collect(), out.collect()
        ids = sorted(r.doc_id for r in after)
        if name == "quality":
            model = quality.fit(given, labels, "quality", crc_remainder("doc_id", 3) != 1)
            scores = quality.scored(given, model, ["doc_id"]).collect()
            assert ids == sorted(r.doc_id for r in scores if r.score >= 0.5)
        elif name == "toxicity":
            reader = toxicity.Reader(toxicity.fit(given, labels, crc_remainder("doc_id", 5) != 0))
            assert ids == sorted(r.doc_id for r in before if reader.weigh(reader.counts(r.text)) < 0.5)
        elif name == "near_duplicates":
            assert ids == sorted({c if n else d for d, n, c in components([(r.doc_id, r.text) for r in before])})
        elif name == "decontamination":
            told = {r.doc_id: hits(r.text, benchmark) for r in before}
            assert ids == sorted(d for d, (n, h, _) in told.items() if h * 2 <= n)
            texts = {r.doc_id: r.text for r in before}
            assert all(r.text == texts[r.doc_id] for r in after if not told[r.doc_id][1])
            assert not any(hits(r.text, benchmark)[1] for r in after)
        if name != "mixing":
            assert out.columns == columns
            given = out
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None
