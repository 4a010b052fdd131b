from quarry.operators.counting import first_letter_count
from quarry.streaming.letters import letter_stream, run_available


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Apple banana\n9x Ant\n")
    (folder / "b.txt").write_text("apple\n")
    run_available(letter_stream(spark, str(folder)), str(tmp_path / "c"), "letters").awaitTermination(60)
    want = sorted(map(tuple, first_letter_count(spark.read.text(str(folder))).collect()))
    assert sorted(map(tuple, spark.table("letters").collect())) == want == [("A", 2), ("a", 1), ("b", 1)]
