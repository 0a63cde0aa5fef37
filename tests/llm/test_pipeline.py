"""The stages' decisions, and the registered queries."""

import corpus_pipeline as cp
from lexicade.llm import toxicity
from lexicade.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck
from tests.llm.conftest import FOLDER
from tests.llm.test_dedup import classes
from tests.llm.test_pii import expected
from tests.llm.test_text_queries import words


def labelled(spark, corpus, folder):
    """The corpus with labelled documents, and a folder with their labels and the given benchmark."""
    rows, labels = [], []
    for i in range(2_000_000, 2_000_200):
        toxic = i % 3 == 0
        rows.append((i, " ".join(f"w{(i * k) % 977}" for k in range(1, 60)) + (" you idiot scum" if toxic else "")))
        labels.append((i, int(toxic)))
    more = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return corpus.unionByName(more, allowMissingColumns=True).select(*corpus.columns).persist()


def test_stages_take_effect_on_all_they_get(spark, corpus, tmp_path):
    folder = str(tmp_path)
    docs = labelled(spark, corpus, folder)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.learn(docs, toxicity.training_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    bad = {str(r.doc_id) for r in toxicity.scores(docs.select("doc_id", "text"), model).where("toxicity >= 0.5").collect()}
    assert {str(i) for i in range(2_000_000, 2_000_200) if i % 3 == 0} <= bad
    steps = dict(cp.STAGES)
    assert list(steps) == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]

    clean = steps["toxicity"](spark, docs, folder).persist()
    left = [(r.doc_id, r.text) for r in clean.collect()]
    assert clean.columns == corpus.columns
    assert sorted(map(str, left)) == sorted(str(x) for x in rows if str(x[0]) not in bad)

    single = steps["near_dedup"](spark, clean, folder).persist()
    assert single.columns == corpus.columns and single.count() == len(set(classes(left)))

    free = steps["decontamination"](spark, single, folder).persist()
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k: k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}

    def hit(t):
        w = words(t)
        return any(tuple(w[k: k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))

    assert sorted(str(r.doc_id) for r in free.collect()) == sorted(
        str(r.doc_id) for r in single.collect() if not hit(r.text))

    masked = steps["pii"](spark, free, folder).persist()
    assert masked.columns == corpus.columns and masked.count() == free.count()
    before = {r.doc_id: r.text for r in free.collect()}
    for r in masked.collect():
        if r.text is not None and len(r.text) < 20_000 and r.doc_id is not None:
            assert ("<" in r.text) or r.text == before[r.doc_id] or not expected(before[r.doc_id])
            assert not expected(r.text)

    packed = steps["packing"](spark, masked, folder).collect()
    assert {str(r.doc_id) for r in packed} == {str(r.doc_id) for r in masked.collect()}


def test_run_applies_the_stages(spark):
    out = cp.run(spark, FOLDER)
    assert out.count() > 100 and "sequence_id" in out.columns


def test_queries_are_registered_and_match_their_sql(spark):
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    con = duck(FOLDER)
    for name, sql in ORACLES.items():
        problem, n, _ = compare(spark, con, FOLDER, QUERIES[name], sql)
        assert problem is None and n > 0


def test_queries_return_their_columns(spark):
    columns = {
        1: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 2: "doc_id start n_tokens ids_crc32",
        3: "doc_id held_out n_tokens n_known train_tokens base_score score",
        5: "doc_id size text_crc32 law shard slot grown_shard",
        6: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        7: "doc_id held_out score predicted",
        9: "doc_id piece start length ids_crc32 sequence_id offset",
        10: "doc_id n_words n_hit n_items items_sha256 contaminated", 11: "query_id rank vec_id score",
        12: "doc_id leaf subroot root proof_sha256 folded_root verified", 13: "word form root n n_near form_n"}
    for name, query in QUERIES.items():
        if (n := int(name[2:].split("_")[0])) in columns:
            got = query(spark, FOLDER).schema
            assert [f.name for f in got][: len(columns[n].split())] == columns[n].split()
