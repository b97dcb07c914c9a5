"""One pass for all keywords against ``in`` and ``find``; keyed state of a stream against the batch."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evidentia.functions.keywords import first_word, found_words, keyword_hits
from evidentia.streaming import first_seen


def test_hits_are_those_of_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        words = ["".join(rng.choices("abé", k=rng.randrange(4))) for _ in range(rng.randrange(8))]
        text = "".join(rng.choices("abcé ", k=rng.randrange(40)))
        want = []
        for n, w in enumerate(words):
            if w and w not in words[:n] and w in text:
                want.append((n, text.find(w), sum(text.startswith(w, i) for i in range(len(text)))))
        assert found_words(text, tuple(words)) == want


def test_columns(spark):
    df = spark.createDataFrame([("total due", 1), (None, 2), ("", 3), ("DUE total total", 4)], "t string, i int")
    got = {r.i: (r.h and [tuple(x) for x in r.h], r.f) for r in df.select("i", keyword_hits(F.col("t"), ["due", "total", "due"]).alias("h"), first_word(F.col("t"), ["due", "total"]).alias("f")).collect()}
    assert got[1] == ([(0, 6, 1), (1, 0, 1)], 0) and got[2] == (None, None) and got[3] == ([], None) and got[4] == ([(1, 4, 2)], 1)


def test_already_seen_in_a_stream_that_is_restarted(spark, tmp_path):
    """Three batches of files, the query restarted before each: the result is what the batch gives."""
    rng, start, rows = random.Random(4), datetime(2025, 1, 1), []
    schema = "query_id long, source string, at timestamp"
    for batch in range(3):
        part = [(rng.randrange(4), f"s{rng.randrange(5)}", start + timedelta(minutes=10 * batch + rng.randrange(10))) for _ in range(40)]
        rows += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        seen = first_seen(stream, ["query_id", "source"], "at", "1 day")
        query = seen.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = [(r.query_id, r.source) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == {r[:2] for r in rows}
