import re

import numpy as np

import corpus_pipeline
from quotemill.llm import decontaminate, language_id, packing, pii


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    extra = [(10_000, None, "en", "s", 0), (10_001, "", "en", "s", 0), (10_002, "12 34", None, "s", 5), (None, "that is the text of the other and for it was with", "en", None, 50)]
    first = source.where("length(text) > 500 and lang = 'en'").orderBy("doc_id").first()
    extra += [(10_003, first.text.upper(), "en", "s", 0), (10_004, "Mail " + "a.b@c.de and more of the text that is here for you", "en", "s", 0)]
    source.unionByName(spark.createDataFrame(extra, source.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.collect()
    model = language_id.fit(docs)
    rejected = model.predict([r.text for r in rows])[2]
    kept = [r for r, out in zip(rows, rejected) if not out]
    assert len(kept) >= len(rows) - 8 and {10_000, 10_001, 10_002}.isdisjoint(r.doc_id for r in kept)
    sets = sorted(((r.doc_id, shingles(r.text)) for r in kept if r.doc_id is not None), key=lambda x: x[0])
    group = {d: d for d, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    kept = [r for r in kept if r.doc_id is None or group[r.doc_id] == r.doc_id]
    assert 10_003 not in {r.doc_id for r in kept}
    items = [decontaminate.normalised(r.text) for r in benchmark.collect()]
    leaks = lambda t: any(decontaminate.myers(x, t, decontaminate.edits_allowed(len(x)))[1] >= 0 for x in items)
    kept = [r for r in kept if r.doc_id is None or not leaks(decontaminate.normalised(r.text))]
    encode = packing._chunks(None).encode
    want = {}
    for r in kept:
        ids = np.frombuffer(encode(pii.masked(r.text)), "<u4").tolist() + [2]
        want[r.doc_id] = ids
    got: dict = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, {})[r.start] = list(r.ids)
    assert {d: [i for _, piece in sorted(pieces.items()) for i in piece] for d, pieces in got.items()} == want


def test_all_but_the_last_stage_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.dtypes == docs.dtypes and found.count() == 0
