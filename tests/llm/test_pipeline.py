"""The stages of the corpus pipeline, each against a plain version on its own input."""

import re

import pytest
from pyspark.sql import functions as F

from kinetrace.llm import toxicity
from kinetrace.llm.common import written

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]

    clean = written(stages["toxicity"](spark, docs, data), "t")
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{data}/labels.parquet"))
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores.where("predicted = 0").collect()}

    one = written(stages["exact_dedup"](spark, clean, data), "e")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for r in clean.collect():
        best[norm(r.text)] = min(best.get(norm(r.text), (1, 0)), (-len(r.text or ""), r.doc_id))
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {b[1] for b in best.values()}

    from tests.llm.test_llm_operators import plain_components

    near = written(stages["near_dedup"](spark, one, data), "n")
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert near.columns == columns and {r.doc_id for r in near.collect()} == {k[0] for k in plain_components(rows) if k[3]}

    left = written(stages["decontamination"](spark, near, data), "d")
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        k = w(r.text)
        windows |= {tuple(k[i : i + 10]) for i in range(max(1, len(k) - 9) if k else 0)}
    sizes = {len(g) for g in windows}
    hit = lambda t: any(tuple(t[i : i + n]) in windows for n in sizes for i in range(len(t) - n + 1))
    assert left.columns == columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in near.collect() if not hit(w(r.text))}

    tokens = stages["sentencepiece"](spark, left, data)
    import hashlib

    import sentencepiece

    from kinetrace.llm.sentencepiece_bpe import default_model

    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = {}
    for r in left.collect():
        ids = library.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.collect()} == want


def test_clashing_columns_and_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    odd = docs.withColumns({c: F.lit(1) for c in ("score", "kept", "h", "n_words", "contaminated", "keep_id", "group_size")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, data).columns == odd.columns, name
        assert stage(spark, docs.where("false"), data).count() == 0


def test_internal_names_do_not_clash(spark, data):
    """Columns that operators use themselves, with leading and trailing underscores too."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(30)
    odd = docs.withColumns({c: F.lit(1) for c in ("h_", "__h", "id_", "lang_", "__norm", "__sha", "text_", "c0", "digest", "component_id", "toxic_", "__column0", "__text")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, data)
        assert got.columns == odd.columns, name
        got.count()
    from kinetrace.llm import language_id

    assert len(language_id.training_rows(odd)) > 0
