import base64
import json
import random

import numpy as np
from pyspark.sql import functions as F

from evidentia.functions.mail import flat_text, mime_parts
from evidentia.functions.similarity import partial_ratio_of
from evidentia.operators import imaging, search
from evidentia.sources.files import as_json


def _ratio(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return 200.0 * table[-1, -1] / (len(a) + len(b))


def _stretches(short, long):
    n = len(short)
    return max(_ratio(short, long[max(0, s) : s + n]) for s in range(1 - n, len(long)))


def test_partial_ratio_is_the_better_of_both_directions():
    rng = random.Random(1)
    assert partial_ratio_of("aaa", "aba") == partial_ratio_of("aba", "aaa") == 80.0
    for _ in range(400):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        want = max(_stretches(a, b), _stretches(b, a)) if len(a) == len(b) else _stretches(short, long)
        assert partial_ratio_of(a, b) == partial_ratio_of(b, a) == want, (a, b)


def test_odd_payloads_have_the_parts_that_can_be_read():
    data = base64.urlsafe_b64encode(b"hi").decode()
    good = {"mimeType": "text/plain", "body": {"data": data}}
    for payload in ['{"parts": ["x"]}', '{"parts": {"a": 1}}', '{"parts": [null, 5, {"body": "x"}, {"mimeType": 3}]}', "[" * 100_000, "nonsense", "[]", "null", None, '{"body": {"data": 5}}']:
        assert list(mime_parts(payload)) == []
    assert flat_text(json.dumps({"parts": [good, "x", {"parts": [[], good]}]})) == "hi\nhi\n"
    assert len(list(mime_parts(json.dumps({"parts": [good] * 12_000})))) == 12_000


def test_json_has_no_odd_numbers_at_any_depth(spark):
    df = spark.sql("select 1 id, double('nan') x, array(double('inf'), 1.5d) a, named_struct('f', float('-inf'), 's', array(named_struct('d', double('nan')))) s, map('k', double('nan')) m, cast(null as struct<d:double>) n")
    assert json.loads(as_json(df).first().response) == {"id": 1, "x": None, "a": [None, 1.5], "s": {"f": None, "s": [{"d": None}]}, "m": {"k": None}, "n": None}


def test_images_that_cannot_be_read(spark):
    pixels = bytearray(range(48))
    rows = [(1, 4, 4, 3, pixels, "otsu"), (2, 4, 4, 3, bytearray(b"short"), "otsu"), (3, None, 4, 3, None, "minimal")]
    images = spark.createDataFrame(rows, "path long, height int, width int, channels int, data binary, method string")
    assert {r.path: r.height for r in imaging.transformed(images).collect()} == {1: 4, 2: None, 3: None}
    assert {r.path for r in imaging.with_variants(images).collect()} == {r.path for r in imaging.with_histogram(images).collect()} == {r.path for r in imaging.with_perturbation(images).collect()} == {1}
    assert imaging.with_variants(images.where("path = 0")).count() == 0


def test_cells_by_category_find_what_an_exact_search_finds(spark):
    rng = np.random.default_rng(2)
    vector = lambda n=6: [float(x) for x in rng.normal(size=n)]
    rows = [(f"f{i}", None if i % 11 == 0 else "big" if i % 3 else "small", vector()) for i in range(900)] + [("odd", "small", vector(5)), ("none", "small", None), ("lone", "own", vector())]
    items = spark.createDataFrame(rows, "filename string, category string, clip array<float>")
    asked = spark.createDataFrame([r for r in rows if r[0] != "odd"], "query_id string, category string, clip array<float>")
    cells = search.category_cells(items, flat_below=50)
    assert {r.category: len(r.centres) for r in cells.collect()} == {"big": 100, "small": 100, None: 41, "own": 1}
    for probes in (1, 10):
        got = search.probed_by_category(asked, items, cells, 4, probes).select("query_id", "filename", "rank_no").collect()
        want = search.nearest(asked.withColumn("grp", F.col("category")), items.withColumn("grp", F.col("category")), 4, {"clip": 1.0}).select("query_id", "filename", "rank_no").collect()
        assert sorted(got) == sorted(want)
