import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_over_given_documents(spark):
    """Every stage works on all that the one before kept, and its decisions hold."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns
        before_ids, ids = {r.doc_id for r in kept.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= before_ids and len(ids) > 0.5 * len(before_ids), name
        kept = after
    rows = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id for r in rows} == texts.keys()
    wanted = {r.doc_id: r.h for r in kept.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()}
    assert {r.doc_id: r.decoded_sha256 for r in rows} == wanted


def test_stages_on_odd_rows(spark, odd_documents):
    docs = odd_documents()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 6
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_the_pipeline_equals_a_plain_version(spark, tmp_path):
    """Over documents with planted exact and near copies, passages of the benchmark and toxic texts."""
    import base64
    import hashlib
    import shutil

    import public_tokenizers
    import tiktoken
    from test_decontaminate import brute as windows_of
    from test_jaccard_join import brute as components_of

    from dugout.llm import string_kernel

    given = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in given.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    longest = sorted(rows.values(), key=lambda r: -len(r["text"] or ""))
    passage = max(items, key=lambda i: len(i[1] or ""))[1]
    base = longest[3]["text"].split(" ")
    planted = [longest[2]["text"], " ".join([*base[:50], "altered", *base[51:]]), longest[5]["text"] + " " + passage, "worthless idiot pathetic loser " * 5, None, " "]
    first = max(rows) + 1
    for k, text in enumerate(planted):
        rows[first + k] = rows[0] | {"doc_id": first + k, "text": text}
    folder = str(tmp_path)
    docs = spark.createDataFrame(list(rows.values()), given.schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        (shutil.copytree if (tmp_path.__class__(f"{SF}/{name}.parquet")).is_dir() else shutil.copy)(f"{SF}/{name}.parquet", f"{folder}/{name}.parquet")
    labels = string_kernel.learnable(spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in string_kernel.scored(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()}
    kept = {i: r["text"] for i, r in rows.items() if scores[i] < 0.5}
    kept = {i: kept[i] for i, (_, root) in components_of(kept, 5, 80).items() if i == root}
    kept = {i: kept[i] for i, _, hit, _ in windows_of(kept.items(), items, 10) if not hit}
    assert first not in kept and first + 1 not in kept and first + 2 not in kept and first + 4 in kept and first + 5 in kept
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, text in kept.items():
        ids = encoding.encode_ordinary(text or "")
        expected.append((i, len(ids), b"".join(n.to_bytes(4, "little") for n in ids), hashlib.sha256((text or "").encode()).hexdigest()))
    found = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(found) == sorted(expected)
