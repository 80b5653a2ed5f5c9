"""The pipeline against a brute-force version of each stage on its own input."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from sparkloom.llm import language_id, mixing
from sparkloom.llm._common import held_out, written


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(10**6, None, "en", "src0", 0), (10**6 + 1, "", None, None, 0), (10**6 + 2, "123 !!", "en", "src1", 6)]
    source.unionByName(spark.createDataFrame(odd, source.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    steps = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == columns, name
        steps.append({r["doc_id"]: r["text"] for r in docs.collect()})
    rejected = set(steps[0]) - set(steps[1])
    assert rejected == {10**6, 10**6 + 1, 10**6 + 2}  # clean documents stay
    last = {}
    for i in sorted(steps[1]):
        last[steps[1][i].encode().lower()] = i
    assert set(steps[2]) == set(last.values())
    sets = {i: shingles(t) for i, t in steps[2].items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(steps[3]) == {i for i in ids if find(i) == i}

    mixed = written(corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)), "mixed")
    assert mixed.columns == columns
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == want
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in corpus_pipeline.STAGES[4][1](spark, mixed, str(tmp_path)).dropDuplicates(["doc_id"]).collect():
        ids_ = lib.encode(steps[3][r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids_), sha(",".join(map(str, ids_))), sha(lib.decode(ids_)))


def test_language_stage_learns_from_training_documents_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs.where(~held_out(4)))
    got = language_id.predict(docs.where(held_out(4)), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, repeats, ids with several texts, clashing columns, empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, DOC_ID string"
    good = "the small house stands under the old tree and the people look at it every day"
    rows = [(1, good, "en", "a"), (2, good.upper(), "en", "a"), (2, "another text of the day about people and a tree that is old", "en", None), (3, None, "en", "b"), (None, good + " now", None, "b"), (4, "", "en", "b"), (5, good + " again", "en", "c"), (5, good + " again", "en", "c")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], schema)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = lambda df: sorted((str(r[0]), r[1]) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language ID"](spark, docs, str(tmp_path))
    assert told.columns == docs.columns and texts(told) == sorted((str(i), t) for i, t, *_ in rows if t)
    alone = stages["exact dedup"](spark, told, str(tmp_path))
    assert alone.columns == docs.columns
    assert texts(alone) == sorted((str(i), t) for i, t, *_ in rows if t and i != 1)  # of id 2, each text is judged by itself
    near = stages["n-gram Jaccard join"](spark, alone, str(tmp_path))
    assert texts(near) == sorted((str(i), t) for i, t, *_ in rows if t and i not in (1, 5))
    assert near.columns == docs.columns
    mixed = stages["mixing"](spark, near, str(tmp_path))
    assert mixed.columns == docs.columns and set(texts(mixed)) <= set(texts(near))
    last = stages["SentencePiece"](spark, mixed, str(tmp_path))
    assert last.count() == mixed.count()
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path))
        assert nothing.count() == 0
