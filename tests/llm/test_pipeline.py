import corpus_pipeline
from helpers import table

ITEM = "the quick brown fox jumps over the lazy dog and runs away from it"


def docs_and_folder(spark, folder):
    english = "the house with the thing that would be there from about a time and then some more"
    texts = [f"{english} number {n} " + " ".join(f"{w}{n}" for w in english.split()) for n in range(40)]
    texts += [texts[3], texts[3], None, "", "12 34 --", f"{texts[5]} and then {ITEM} once more", "write to a@b.cd about " + texts[6][::-1] + english]
    frame = table(spark, texts, ["en"] * len(texts))
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_every_stage_and_the_whole(spark, tmp_path):
    texts = docs_and_folder(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/step{number}")
        docs = spark.read.parquet(f"{tmp_path}/step{number}")
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    everything = set(range(len(texts)))
    assert everything - left[0] == {42, 43, 44}
    assert {40, 41} <= left[0] - left[1] and 3 in left[1]
    assert left[1] - left[2] == ({45} & left[1])
    assert left[2] == left[3] == left[4]
    text = spark.read.parquet(f"{tmp_path}/step3").filter("doc_id = 46").first()
    assert text["text"].startswith("write to [EMAIL] about") and text["n_chars"] == len(text["text"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
