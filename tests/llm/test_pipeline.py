"""Each stage against a plain version of it, on the stage's own input; then the pipeline as a whole."""

import pytest

import corpus_pipeline as P
from logsluice.llm import mixing, toxicity
from logsluice.llm.common import labelled_sample, read_table, write_shared
from logsluice.llm.queries import QUERIES
from helpers import removed_words, similar_texts, words


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = read_table(spark, sf, "documents"), []
    for name, stage in P.STAGES:
        result = write_shared(stage(spark, docs, sf), f"test-{name}")
        out.append((docs, result))
        docs = result
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() > 0
        assert after.where("n_chars != char_length(text)").count() == 0


def test_toxic_documents_go(spark, sf, stages):
    before, after = stages[0]
    labels = read_table(spark, sf, "labels", "doc_id", "toxic")
    model = toxicity.fit(labelled_sample(before, labels, "toxic", 5, 0, toxicity.TRAIN_ROWS, toxicity.TRAIN_BYTES))
    assert {r["doc_id"] for r in rows(after)} == {r["doc_id"] for r in rows(before) if model.score(r["text"]) < P.TOXIC}


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    docs = sorted(rows(before), key=lambda r: r["doc_id"])
    component = similar_texts([r["text"] for r in docs])
    assert sorted(rows(after), key=lambda r: r["doc_id"]) == [docs[k] for k in sorted(set(component))]


def test_passages_go(stages):
    before, after = stages[2]
    got = {r["doc_id"]: r for r in rows(after)}
    old = {r["doc_id"]: r for r in rows(before)}
    for i, ws, flags in removed_words([(r["doc_id"], r["text"]) for r in old.values()]):
        if any(flags) and all(flags):
            assert i not in got
            continue
        kept = " ".join(w for w, f in zip(ws, flags) if not f)
        assert got[i]["text"] == (kept if any(flags) else old[i]["text"])
        assert (got[i]["lang"], got[i]["source"]) == (old[i]["lang"], old[i]["source"])


def test_mix_takes_what_the_operator_says(stages):
    before, after = stages[3]
    taken = {r.doc_id: r.taken for r in mixing.mix(mixing.with_size(before)).collect()}
    got = dict.fromkeys(taken, 0)
    old = {r["doc_id"]: words(r["text"]) for r in rows(before)}
    for r in rows(after):
        ws = words(r["text"])
        assert ws == old[r["doc_id"]][:len(ws)]
        got[r["doc_id"]] += len(ws)
    assert got == taken


def test_every_token_is_packed_once(stages):
    before, after = stages[4]
    assert {r["doc_id"] for r in rows(after)} == {r["doc_id"] for r in rows(before)}
    starts = [r for r in rows(after) if r["start"] == 0]
    assert len(starts) == before.count()
    assert sum(r["length"] for r in rows(after)) == sum(r["doc_tokens"] for r in starts)


def test_run_and_odd_documents(spark, sf, stages, tmp_path):
    whole = P.run(spark, sf)
    assert whole.columns == stages[4][1].columns and whole.count() == stages[4][1].count()
    odd = [
        (1, None, "en", "a", 0), (1, None, "en", "a", 0), (None, "", None, None, None), (None, "x y", "en", "a", 3), (2, "w " * 3000, None, "b", 6000),
        (3, "w " * 3000, "de", "b", 6000), (4, " ".join(map(str, range(60))), "de", "b", 170), (5, " ".join(map(str, range(60))) + " z", "de", None, 172),
    ]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    labels = read_table(spark, sf, "labels")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "passages", "mixing", "packing"]
