"""Search, labels, catalogue, metrics and images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2, norm, percent, unit
from ..operators import catalog, evaluate, imaging, keypoints, pq, quality, search
from ..sources import derived, files

#: A confidence below this is no label: the vocabulary here has 30 templates, so chance is 0.033.
THRESHOLD = 0.05
# The colours that a query can have.
COLORS = ["red", "blue", "black", "white", "green", "yellow", "pink", "purple", "orange", "gray", "beige", "brown", "navy", "gold", "silver", "teal", "maroon"]

ITEMS = """
i as (
    select vec_id, vec_id::varchar || '.jpg' as filename, 's' || (vec_id // 3)::varchar as source_file, 'cat' || label::varchar as category,
        embedding::double[] as clip, list_reverse(embedding)::double[] as visual
    from embeddings
), q as (select vec_id as query_id, clip, visual, category from i where vec_id % 20 = 0)"""


def _topk_sql(score: str, k: int, where: str = "true", extra: str = "") -> str:
    return f"""with {ITEMS}, s as (
    select q.query_id, i.filename, i.source_file, i.category, round(list_dot_product(q.clip, i.clip), 6) as clip_sim, round(list_dot_product(q.visual, i.visual), 6) as visual_sim from q, i where {where}
), r as (select *, round({score}, 6) as score from s),
t as (select *, row_number() over (partition by query_id order by score desc, filename) as rank_no from r)
select query_id, filename, rank_no::int as rank_no, score{extra} from t where rank_no <= {k}"""


def _weighted(spark: SparkSession, d: str, k: int, weights: dict[str, float], by_category: bool) -> DataFrame:
    q, i = derived.queries(spark, d), derived.inventory(spark, d)
    if by_category:
        q, i = q.withColumn("grp", F.col("category")), i.withColumn("grp", F.col("category"))
    found = search.nearest(q, i, k, weights)
    return found.select("query_id", "filename", "rank_no", "score")


def topk_global(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d, 5, {"clip": 1.0}, False)


def topk_category(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d, 3, {"clip": 1.0}, True)


def topk_color_weighted(spark: SparkSession, d: str) -> DataFrame:
    found = _weighted(spark, d, 5, {"clip": 0.7, "visual": 0.3}, False)
    return found.withColumn("match_confidence", percent(F.col("score"), clamped=True))


def topk_weighted_category(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d, 5, {"clip": 0.4, "visual": 0.6}, True)


HITS = f"""{ITEMS}, s as (
    select q.query_id, i.filename, i.source_file, i.category, round(list_dot_product(q.clip, i.clip), 6) as clip_sim, list_dot_product(q.visual, i.visual) as v from q join i using (category)
), recalled as (
    select *, round(v, 6) as visual_sim from (select *, row_number() over (partition by query_id order by clip_sim desc, filename) as n from s) where n <= 20
), fused as (select *, round(0.5 * clip_sim + 0.5 * visual_sim, 6) as score from recalled),
one as (select * from (select *, row_number() over (partition by query_id, source_file order by score desc, filename) as m from fused) where m = 1),
hits as (
    select query_id, row_number() over (partition by query_id order by score desc, source_file) as rank_no, source_file as filename, score, clip_sim, visual_sim, category from one
)"""


def topk_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(derived.queries(spark, d), derived.inventory(spark, d), 5)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return search.zero_shot(derived.queries(spark, d), derived.templates(spark, d), THRESHOLD)


def zero_shot_category(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).withColumn("confidence", F.round("confidence", 6))


SHOTS = f"""{ITEMS}, tp as (select category as label, category || '-' || n::varchar as template, clip as e from (select *, row_number() over (partition by category order by vec_id) as n from i) where n <= 3),
z as (
    select q.query_id, label, template, round(list_dot_product(q.clip, tp.e), 6) as sim from q, tp
), y as (
    select query_id, label, exp(sim) / sum(exp(sim)) over (partition by query_id) as conf, row_number() over (partition by query_id order by sim desc, template) as n from z
), lab as (select query_id, case when conf < {THRESHOLD} then 'unknown' else label end as label, round(conf, 6) as confidence from y where n = 1)"""


def zero_shot_color(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(f"a photo of {c} clothing") for c in COLORS])
    words = derived.inventory(spark, d).where(F.col("vec_id") < len(COLORS)).select(F.get(names, F.col("vec_id").cast("int")).alias("template"), F.col("clip").alias("embedding"))
    clean = F.regexp_replace("template", "a photo of (a )?", "")
    return search.zero_shot(derived.queries(spark, d), words.select(clean.alias("label"), "template", "embedding"), 0.0).select("query_id", F.col("label").alias("predicted_color"), F.round("confidence", 6).alias("confidence"))


COLOR_SQL = f"""with {ITEMS}, tp as (select list_extract({COLORS}, (vec_id + 1)::int) || ' clothing' as label, clip as e from i where vec_id < {len(COLORS)}),
z as (select q.query_id, label, round(list_dot_product(q.clip, tp.e), 6) as sim from q, tp),
y as (select query_id, label, exp(sim) / sum(exp(sim)) over (partition by query_id) as conf, row_number() over (partition by query_id order by sim desc, 'a photo of ' || label) as n from z)
select query_id, label as predicted_color, round(conf, 6) as confidence from y where n = 1"""


def _routed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = (F.col("query_id") / 20).cast("bigint") % 5
    user = F.when(n == 0, F.concat(F.lit("  "), F.initcap("category"), F.lit(" "))).when(n == 1, "kimono")
    asked = derived.queries(spark, d).join(_labelled(spark, d), "query_id").select("query_id", "clip", "visual", user.alias("user_category"), F.when(n == 4, "cat99").otherwise(F.col("label")).alias("predicted"), "confidence")
    return search.routed(asked, derived.inventory(spark, d), 5)


def hybrid_search_routed(spark: SparkSession, d: str) -> DataFrame:
    hits, _ = _routed(spark, d)
    return hits.select("query_id", "rank_no", "filename", "score", "clip_sim", "visual_sim", "category", "reason")


ROUTED = f"""with {SHOTS}, sent as (
    select q.query_id, q.clip, q.visual, (q.query_id // 20) % 5 in (0, 1) as by_user,
        case (q.query_id // 20) % 5 when 0 then q.category when 1 then 'kimono' when 4 then 'cat99' else lab.label end as cat, lab.label, lab.confidence
    from q join lab using (query_id)
), way as (select *, case when cat in (select category from i) then 'category' when by_user then 'none' else 'everywhere' end as way from sent),
s as (
    select w.query_id, i.filename, i.source_file, i.category, round(list_dot_product(w.clip, i.clip), 6) as clip_sim, list_dot_product(w.visual, i.visual) as v from way w join i on i.category = w.cat where w.way = 'category'
), recalled as (select *, round(v, 6) as visual_sim from (select *, row_number() over (partition by query_id order by clip_sim desc, filename) as n from s) where n <= 20),
fused as (select *, round(0.5 * clip_sim + 0.5 * visual_sim, 6) as score from recalled),
one as (select * from (select *, row_number() over (partition by query_id, source_file order by score desc, filename) as m from fused) where m = 1),
near as (select query_id, row_number() over (partition by query_id order by score desc, source_file) as rank_no, source_file as filename, score, clip_sim, visual_sim, category, null as reason from one),
g as (select w.query_id, i.filename, i.source_file, i.category, round(list_dot_product(w.clip, i.clip), 6) as clip_sim from way w, i where w.way = 'everywhere'),
g5 as (select * from (select *, row_number() over (partition by query_id order by clip_sim desc, filename) as n from g) where n <= 5),
g1 as (select * from (select *, row_number() over (partition by query_id, source_file order by n) as m from g5) where m = 1),
far as (select query_id, row_number() over (partition by query_id order by n) as rank_no, source_file as filename, clip_sim as score, clip_sim, null::double as visual_sim, category, 'smart_fallback_clip' as reason from g1)"""


def search_status(spark: SparkSession, d: str) -> DataFrame:
    _, status = _routed(spark, d)
    return status.withColumn("confidence", F.round("confidence", 6))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    q, i = derived.queries(spark, d), derived.inventory(spark, d)
    cross = q.withColumn("clip", F.reverse("clip"))
    return search.rank_fusion([search.nearest(q, i, 10, {"clip": 1.0}), search.nearest(cross, i, 10, {"clip": 1.0})])


RRF = f"""with {ITEMS}, a as (select q.query_id, i.filename, round(list_dot_product(q.clip, i.clip), 6) as s from q, i),
b as (select q.query_id, i.filename, round(list_dot_product(q.visual, i.clip), 6) as s from q, i),
r as (select query_id, filename, row_number() over (partition by query_id order by s desc, filename) as n from a union all select query_id, filename, row_number() over (partition by query_id order by s desc, filename) as n from b)
select query_id, filename, round(sum(1.0::double / (60 + n)), 8) as score from r where n <= 10 group by 1, 2"""


def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    placed, centres = search.with_cells(derived.inventory(spark, d))
    return search.probed(derived.queries(spark, d), placed, centres, 5).select("query_id", "filename", "rank_no", "score")


def ivfpq_search(spark: SparkSession, d: str) -> DataFrame:
    """The compressed index written and read again; all that its error bounds leave open is scored from the vectors."""
    items = derived.inventory(spark, d)
    index, quantiser = pq.build(items)
    return pq.search(derived.queries(spark, d), items, files.settled(index, "codes"), quantiser, 5)


def ratio_test_matches(spark: SparkSession, d: str) -> DataFrame:
    asked = derived.queries(spark, d).select(F.floor(F.col("query_id") / 100).alias("query_id"), F.col("query_id").alias("descriptor"), "clip")
    held = derived.inventory(spark, d).select((F.col("vec_id") % 10).alias("image"), F.col("vec_id").alias("descriptor"), "clip")
    return search.good_matches(asked, held, k=3)


RATIO = f"""with {ITEMS}, s as (select q.query_id // 100 as query_id, q.query_id as dsc, i.vec_id % 10 as image, round(list_dot_product(q.clip, i.clip), 6) as sim from q, i),
r as (select *, row_number() over (partition by dsc, image order by sim desc) as n from s),
p as (select query_id, dsc, image, max(case when n = 1 then sqrt(greatest(0, 2 - 2 * sim)) end) as d1, max(case when n = 2 then sqrt(greatest(0, 2 - 2 * sim)) end) as d2 from r where n <= 2 group by all),
g as (select query_id, image, count(*) filter (d1 < 0.7 * d2) as good from p group by 1, 2)
select query_id, image, good, rank_no::int as rank_no from (select *, row_number() over (partition by query_id order by good desc, image) as rank_no from g) where rank_no <= 3"""


def keypoint_matches(spark: SparkSession, d: str) -> DataFrame:
    """Images turned by a quarter and brightened, against all images by their keypoints' descriptors: the three with most good
    matches. Descriptors are found once."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [imaging.byte(np.rot90(imaging.decode(r.data, r.height, r.width, r.channels)) * 0.9 + 12) for r in batch.itertuples(index=False)]
            yield batch.assign(data=[m.tobytes() for m in made])

    images = _images(spark, d, 32)
    held = files.settled(keypoints.with_keypoints(images, "vec_id").select(F.col("vec_id").alias("image"), "descriptor", "clip"), "keypoints")
    turned = images.where("vec_id % 20 = 0").mapInPandas(turn, images.schema)
    asked = files.settled(keypoints.with_keypoints(turned, "vec_id").select(F.col("vec_id").alias("query_id"), "descriptor", "clip"), "asked")
    return search.good_matches(asked, held, k=3)


def vector_math(spark: SparkSession, d: str) -> DataFrame:
    i = derived.inventory(spark, d)
    return i.select("vec_id", F.round(dot(F.col("clip"), F.col("visual")), 6).alias("dot"), F.round(norm(F.col("clip")), 6).alias("norm"), F.round(l2(F.col("clip"), F.col("visual")), 6).alias("l2"), F.round(F.get(unit(F.transform("clip", lambda x: x * 3)), F.lit(0)), 6).alias("unit_first"))


def category_availability(spark: SparkSession, d: str) -> DataFrame:
    wanted = derived.table(spark, d, "part").select(F.concat(F.lit("cat"), (F.col("p_size") % 15).cast("string")).alias("category")).distinct()
    stock = derived.inventory(spark, d).select("category").distinct()
    there = wanted.join(stock, "category", "left_semi").withColumn("in_stock", F.lit(True))
    return there.unionByName(wanted.join(stock, "category", "left_anti").withColumn("in_stock", F.lit(False)))


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return derived.inventory(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_file").alias("sources"))


def category_distinct(spark: SparkSession, d: str) -> DataFrame:
    return derived.table(spark, d, "part").select("p_brand", "p_type").distinct()


def inventory_metadata_join(spark: SparkSession, d: str) -> DataFrame:
    meta = derived.table(spark, d, "part").where(F.col("p_size") > 5).select(F.col("p_partkey").alias("id"), "p_brand", "p_size")
    return catalog.with_metadata(derived.inventory(spark, d), meta, ["p_brand", "p_size"]).select("filename", "p_brand", "p_size")


def weak_labels(spark: SparkSession, d: str) -> DataFrame:
    c = derived.cases(spark, d)
    words = F.array(F.lit("CITY"), F.col("day"), F.col("amount"), F.lit("none"))
    raw = c.select(F.col("case_id").alias("doc"), F.posexplode(words).alias("line_no", "word")).select("doc", "line_no", F.concat_ws(",", F.lit("1,2,3,4"), (F.col("line_no") + 5).cast("string"), F.lit("6,7,8"), "word").alias("value"))
    named = F.create_map(F.lit("company"), F.lit("CITY SHOP"), F.lit("date"), F.col("day"), F.lit("total"), F.col("amount"), F.lit("address"), F.lit("1 CITY ROAD"))
    entities = c.select(F.col("case_id").alias("doc"), F.posexplode(F.map_entries(named)).alias("place", "e")).select("doc", "place", F.col("e.key").alias("name"), F.col("e.value").alias("value"))
    return catalog.weak_labels(catalog.box_lines(raw), entities)


def sample_inventory(spark: SparkSession, d: str) -> DataFrame:
    return catalog.sample(derived.inventory(spark, d), "vec_id", 100).select("vec_id", "filename", "category")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Searches with the vector reversed: where does the query's own item come?"""
    q, i = derived.queries(spark, d), derived.inventory(spark, d)
    found = search.nearest(q.withColumn("clip", F.reverse("clip")), i, 10, {"clip": 1.0})
    own = found.where(F.col("filename") == F.concat(F.col("query_id").cast("string"), F.lit(".jpg"))).select("query_id", "rank_no")
    said = _labelled(spark, d).select("query_id", F.col("label").alias("pred_label"))
    return q.join(own, "query_id", "left").join(said, "query_id", "left").select("query_id", "rank_no", F.col("category").alias("true_label"), "pred_label", ((F.col("query_id") % 7) * 1.5).alias("latency_ms"))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.hit_rates(_runs(spark, d))


METRICS_SQL = f"""with {SHOTS}, a as (select q.query_id, i.filename, round(list_dot_product(q.visual, i.clip), 6) as s from q, i),
r as (select query_id, filename, row_number() over (partition by query_id order by s desc, filename) as n from a),
w as (select query_id, n from r where n <= 10 and filename = query_id::varchar || '.jpg'),
runs as (select q.query_id, w.n, q.category as t, lab.label as p, (q.query_id % 7) * 1.5 as ms from q left join w using (query_id) left join lab using (query_id))
select count(*) as n, round(avg(case when n <= 1 then 1.0 else 0 end), 6) as top1, round(avg(case when n <= 5 then 1.0 else 0 end), 6) as top5, round(avg(case when n <= 10 then 1.0 else 0 end), 6) as top10,
    round(count(*) filter (t = p) / count(*) filter (t is not null and p is not null), 6) as label_accuracy, round(avg(ms)::double, 6) as mean_latency_ms from runs"""


def classification_report(spark: SparkSession, d: str) -> DataFrame:
    i = derived.inventory(spark, d)
    said = search.zero_shot(i.select(F.col("vec_id").alias("query_id"), "clip"), derived.templates(spark, d), 0.0)
    return evaluate.classification_report(i.join(said, F.col("vec_id") == F.col("query_id")), "category", "label")


REPORT = f"""with {ITEMS}, tp as (select category as label, category || '-' || n::varchar as template, clip as e from (select *, row_number() over (partition by category order by vec_id) as n from i) where n <= 3),
z as (select i.vec_id, i.category as t, label, row_number() over (partition by i.vec_id order by round(list_dot_product(i.clip, tp.e), 6) desc, template) as n from i, tp),
p as (select t, label as p from z where n = 1),
l as (select t as label from p union select p from p),
c as (select label, (select count(*) from p where t = label) as support, (select count(*) from p where p.p = label) as said, (select count(*) from p where t = label and p.p = label) as hit from l),
m as (select label, case when said = 0 then 0 else hit / said end as precision, case when support = 0 then 0 else hit / support end as recall, support, hit from c),
f as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from m),
u as (
    select label, precision, recall, f1, support from f
    union all select 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) from f
    union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from f
    union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from f
) select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from u"""


def _quality(spark: SparkSession, d: str) -> DataFrame:
    m = derived.metrics(spark, d).withColumn("resolution", quality.resolution_score(F.col("pixels")))
    return m.withColumn("overall", quality.overall_quality(*[F.col(c) for c in ("noise", "contrast", "brightness", "blur", "resolution", "density")]))


def quality_overall(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).select("order_id", "line_no", F.round("resolution", 6).alias("resolution"), F.round("overall", 6).alias("overall"))


def preprocess_choice(spark: SparkSession, d: str) -> DataFrame:
    q = _quality(spark, d).withColumn("overall", F.round("overall", 6))
    chosen = quality.preprocessing(*[F.col(c) for c in ("noise", "contrast", "blur", "resolution", "overall")])
    asked = F.when(F.col("line_no") == 1, "auto").when(F.col("line_no") == 2, "old").when(F.col("line_no") == 3, "sharpest")
    return q.select("order_id", "line_no", chosen.alias("method"), quality.dispatch(asked, chosen).alias("dispatched"))


QUALITY = """a as (
    select l_orderkey as order_id, l_linenumber as line_no, ((l_orderkey * 7 + l_linenumber * 13) % 101)::double as noise, ((l_orderkey * 11 + l_linenumber * 29) % 101)::double as contrast,
        ((l_orderkey * 3 + l_linenumber * 17) % 101)::double as brightness, ((l_orderkey * 19 + l_linenumber * 5) % 101)::double as blur,
        ((l_orderkey * 7919 + l_linenumber * 104729) % 3000000)::double as pixels, ((l_orderkey * 23 + l_linenumber * 31) % 101)::double as density
    from lineitem
), b as (select *, case when pixels > 1000000 then 100.0 else pixels / 1e4 end::double as resolution from a),
m as (select *, round(0.25 * contrast + 0.2 * (100 - noise) + 0.15 * blur + 0.2 * resolution + 0.1 * density + 0.1 * (100 - abs(brightness - 50)), 6) as overall from b)"""
CHOICE = f"""with {QUALITY}, k as (select order_id, line_no, case
    when resolution < 20 then 'scale_aware'
    when overall > 75 and noise < 15 and contrast > 65 and blur > 40 then 'minimal'
    when noise > 70 then 'advanced'
    when blur < 15 and noise > 40 then 'morphology'
    when blur < 15 and noise < 20 then 'advanced'
    when noise > 40 then if(blur < 30, 'morphology', 'medium')
    when contrast < 35 then if(noise < 25, 'light', 'medium')
    when resolution < 35 and overall < 60 then 'scale_aware'
    when overall > 70 then if(contrast > 55, 'minimal', 'light')
    when overall > 60 then 'light'
    when overall > 50 then if(noise > 25, 'medium', 'light')
    when noise > 50 or blur < 20 then 'medium'
    else 'minimal' end as method from m)
select order_id, line_no, method, case line_no when 2 then 'default' when 3 then 'minimal' else method end as dispatched from k"""


def _images(spark: SparkSession, d: str, size: int = 24) -> DataFrame:
    """Small images painted from the vectors: three channels, eight by eight tiles."""

    def paint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for vec_id, v in zip(batch["vec_id"], batch["embedding"], strict=True):
                tile = np.clip((np.asarray(v, float).reshape(8, 8) + 0.4) * 320, 0, 255)
                big = np.kron(tile, np.ones((size // 8, size // 8))).astype(np.uint8)
                out.append((vec_id, size, size, 3, np.stack([big, big[::-1], big[:, ::-1]], axis=2).tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "height", "width", "channels", "data"])

    # painting and what follows is work of the processor: a small table is dealt to all cores
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return derived.table(spark, d, "embeddings").select("vec_id", "embedding").repartition(parts, "vec_id").mapInPandas(paint, "vec_id long, height int, width int, channels int, data binary")


def image_quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    return imaging.with_metrics(_images(spark, d), "vec_id")


def image_preprocess(spark: SparkSession, d: str) -> DataFrame:
    """A row for each image and transform."""
    each = _images(spark, d).withColumn("method", F.explode(F.array(*map(F.lit, imaging.TRANSFORMS))))
    return imaging.transformed(each, "vec_id").select("vec_id", "method", "height", "width", F.md5("data").alias("digest"))


def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The inventory saved by category and read again, from the folder that driver and executors share."""
    path = files.shared_folder(spark, "index")
    built = files.load_or_build(spark, path, lambda: derived.inventory(spark, d))
    files.save_index(derived.inventory(spark, d), f"{path}-fresh")
    fresh = files.load_index(spark, f"{path}-fresh")
    return fresh.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids")).join(built.select("category").distinct(), "category", "left").select("category", "n", "ids")


def search_saved_index(spark: SparkSession, d: str) -> DataFrame:
    """Searches in the categories that are asked for, over the index as it was saved."""
    path = files.shared_folder(spark, "index")
    files.save_index(derived.inventory(spark, d), path)
    asked = derived.queries(spark, d).where(F.col("category").isin("cat1", "cat2", "cat99"))
    return search.from_index(asked, files.load_index(spark, path), 5)


QUERIES = {
    "topk_global": (topk_global, _topk_sql("clip_sim", 5)),
    "topk_category": (topk_category, _topk_sql("clip_sim", 3, "q.category = i.category")),
    "topk_color_weighted": (topk_color_weighted, _topk_sql("0.7 * clip_sim + 0.3 * visual_sim", 5, extra=", greatest(0, least(100, trunc(score * 100)))::int as match_confidence")),
    "topk_weighted_category": (topk_weighted_category, _topk_sql("0.4 * clip_sim + 0.6 * visual_sim", 5, "q.category = i.category")),
    "topk_hybrid": (topk_hybrid, f"with {HITS} select query_id, rank_no::int as rank_no, filename, score, clip_sim, visual_sim, category, trunc(score * 100)::int as match_confidence from hits where rank_no <= 5"),
    "search_saved_index": (search_saved_index, f"with {HITS} select query_id, rank_no::int as rank_no, filename, score, clip_sim, visual_sim, category, trunc(score * 100)::int as match_confidence from hits where rank_no <= 5 and category in ('cat1', 'cat2', 'cat99')"),
    "zero_shot_category": (zero_shot_category, f"with {SHOTS} select query_id, label, confidence from lab"),
    "zero_shot_color": (zero_shot_color, COLOR_SQL),
    "hybrid_search_routed": (hybrid_search_routed, ROUTED + " select query_id, rank_no::int as rank_no, filename, score, clip_sim, visual_sim, category, reason from near where rank_no <= 5 union all select query_id, rank_no::int, filename, score, clip_sim, visual_sim, category, reason from far"),
    "search_status": (search_status, ROUTED + " select query_id, case when way = 'none' then 'no_matches' when not by_user and cat = 'unknown' then 'needs_confirmation' else 'success' end as status, cat as category_used, confidence, way from way"),
    "rrf_fusion": (rrf_fusion, RRF),
    "ivf_search": (ivf_search, _topk_sql("clip_sim", 5)),
    "ivfpq_search": (ivfpq_search, _topk_sql("clip_sim", 5)),
    "ratio_test_matches": (ratio_test_matches, RATIO),
    "keypoint_matches": (keypoint_matches, None),
    "vector_math": (vector_math, f"with {ITEMS} select vec_id, round(list_dot_product(clip, visual), 6) as dot, round(sqrt(list_dot_product(clip, clip)), 6) as norm, round(list_distance(clip, visual), 6) as l2, round(clip[1] / sqrt(list_dot_product(clip, clip)), 6) as unit_first from i"),
    "category_availability": (category_availability, "with w as (select distinct 'cat' || (p_size % 15)::varchar as category from part) select category, category in (select 'cat' || label::varchar from embeddings) as in_stock from w"),
    "category_counts": (category_counts, f"with {ITEMS} select category, count(*) as n, count(distinct source_file) as sources from i group by 1"),
    "category_distinct": (category_distinct, "select distinct p_brand, p_type from part"),
    "inventory_metadata_join": (inventory_metadata_join, "select vec_id::varchar || '.jpg' as filename, coalesce(p_brand, 'unknown') as p_brand, coalesce(p_size::varchar, 'unknown') as p_size from embeddings left join (select * from part where p_size > 5) on vec_id = p_partkey"),
    "weak_labels": (weak_labels, "select o_orderkey as doc, i::int as line_no, case i when 0 then 'CITY' when 1 then strftime(o_orderdate, '%d/%m/%Y') else o_totalprice::decimal(18,2)::varchar end as word, 1::int as x1, 2::int as y1, (i + 5)::int as x2, 6::int as y2, i::int as class_id from orders, range(3) r(i)"),
    "sample_inventory": (sample_inventory, f"with {ITEMS} select vec_id, filename, category from i order by md5(vec_id::varchar), vec_id limit 100"),
    "retrieval_metrics": (retrieval_metrics, METRICS_SQL),
    "classification_report": (classification_report, REPORT),
    "quality_overall": (quality_overall, f"with {QUALITY} select order_id, line_no, round(resolution, 6) as resolution, overall from m"),
    "preprocess_choice": (preprocess_choice, CHOICE),
    "image_quality_metrics": (image_quality_metrics, None),
    "image_preprocess": (image_preprocess, None),
    "index_roundtrip": (index_roundtrip, f"with {ITEMS} select category, count(*) as n, sum(vec_id)::bigint as ids from i group by 1"),
}
