"""What one task holds does not grow with a table."""

from pyspark.sql import functions as F

from lumenlog.functions import similarity as sim
from lumenlog.operators import fulltext, multiline


def test_numbered_lines_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(multiline, "TASK_LINES", 50)
    i = F.col("id")
    lines = spark.range(2000).select(i.alias("seq"), F.concat(F.lit("h"), i % 2).alias("host"), F.concat(F.lit("p"), i % 4).alias("program"), i.cast("timestamp").alias("timestamp"), (i % 1000).alias("batch"), F.concat(F.lit("[5-"), (i / 1000 + 1).cast("int"), F.lit("] x"), i).alias("message"))
    found = multiline.by_header(lines.drop("timestamp"))[0]
    assert found.rdd.getNumPartitions() >= 40
    assert {(r["batch"], r["message"]) for r in found.collect()} == {(k, f"x{k}\nx{k + 1000}") for k in range(1000)}

def test_an_index_needs_no_shuffle(spark):
    texts = spark.createDataFrame([(1, "Errors, the error at user 7"), (2, None), (3, "!"), (4, "The users errored")], "id long, message string")
    index = fulltext.postings(texts)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["lexeme"], r["id"], r["positions"]) for r in index.collect()) == [("7", 1, [5]), ("error", 1, [0, 2]), ("error", 4, [2]), ("user", 1, [4]), ("user", 4, [1])]


def test_tokens_without_their_normal_form(spark):
    texts = ["", None, "  ", "!a--b [12] (events [1, 2]) 10.0.0.1:80 naïve été x_y <ID>\t-> ab", "deadbeefdeadbeef 550e8400-e29b-41d4-a716-446655440000.", "İstanbul ǅ ſ K 12a the THE"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(sim.tokens(sim.normal_form(F.col("text"))).alias("old"), sim.tokens_of(F.col("text")).alias("new")).collect()
    assert [r["new"] for r in rows] == [r["old"] for r in rows] and rows[3]["new"][0] == "a--b"
    # Ranges in a class cost Java a call each at every character.
    assert "a-z" not in sim.BETWEEN
