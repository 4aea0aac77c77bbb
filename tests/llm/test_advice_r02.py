from corvane.llm import queries as llm

STEM = "A teacher has a rash and fever after a long walk in the woods with many ticks and asks what grows."


def test_answers_to_train_questions_are_held_against_their_stems(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(k, STEM, {"A": "a", "B": "b"}) for k in ("train-1", "dev-1", "test-9")], "question_id string, question string, options map<string,string>").write.parquet(f"{d}/questions.parquet")
    sound = "The rash and fever follow the bite, so a spirochete is the cause of this."
    spark.createDataFrame([(1, "train-1", STEM), (2, "dev-1", STEM), (3, "train-1", sound), (4, "train-0", sound), (5, None, None)], "record_id long, question_id string, explanation string").write.parquet(f"{d}/predictions.parquet")
    assert {r[0]: r[1] for r in llm.p1_found(spark, d).collect()} == {1: "copied", 2: "copied", 5: "empty"}
    assert {r[0] for r in llm.p1_flags(spark, d).collect()} == {1, 2, 5}
