"""Evidence views over the driver's tables, which hold no receipts, priced chats or bank e-mails of their own.

Every case is an order. What a case's texts look like follows from its key by small remainders, so each branch of the
extraction and of the decision occurs; the values are the order's own. Nothing is filtered: all orders are cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENDER, MERCHANT = "payments@bank.example", "Orchard Lane Traders"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, key (7 digits), amount (two decimals), rupees (whole), day, paid_at (a minute of that day)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    paid = F.date_trunc("day", F.col("o_orderdate")) + F.make_dt_interval(mins=(k % 1300).cast("int"))
    return o.select(k.alias("case_id"), F.lpad(k.cast("string"), 7, "0").alias("key"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"), F.floor("o_totalprice").cast("bigint").alias("rupees"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), paid.alias("paid_at"))


def _pick(n: Column, *choices: Column) -> Column:
    out = F.when(F.lit(False), choices[0])
    for i, c in enumerate(choices):
        out = out.when(n == i, c)
    return out


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, text: ten layouts by the key's last digit."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    key, day, amount = F.col("key"), F.col("day"), F.col("amount")
    layouts = [
        text("Invoice No: TD", key, "\nDate: ", day, "\nTotal: ", amount),
        text("Invoice No: INV-", key, "\nDate: ", day, "\nTotal: ", amount),
        text("CITY SHOP\nDocument\nAB", key, "\n", day, "\nAmount Paid: $", amount),
        text("CITY SHOP\nRef no. is AB-", key, "\nDate: ", day, "\nTotal: ", amount),
        text("CITY SHOP\r\nReference\r\nXY", key, "\r\n", day, "\r\nGrand Total: ", amount),
        text("CITY SHOP\nQZ", key, "\n", day, "\nTotal: ", amount),
        text("CITY SHOP\nSlip no\n", F.substring(key, 3, 5), "\n", day, "\nTotal: ", amount),
        text("CITY SHOP\nThanks\n", day),
        text("Thank you\nCome again"),
        text("CITY SHOP\nGrand Total: ", amount),
    ]
    return cases(spark, sf_dir).select("case_id", _pick(F.col("case_id") % 10, *layouts).alias("text"))


def bank_id(case_id: Column) -> Column:
    return F.substring(F.md5(case_id.cast("string")), 1, 24)


def digital_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, text: whole; id misread; label misspelt and no time; id cut to 20; no amount; no receiver."""
    c = cases(spark, sf_dir)
    tid = bank_id(F.col("case_id"))
    j = F.col("case_id") % 6
    shown = _pick(j, tid, F.translate(tid, "015", "olS"), tid, F.substring(tid, 1, 20), tid, tid)
    label = F.when(j == 2, "Tranction1D ").otherwise("TransactionID ")
    amount = F.when(j == 4, "Paid").otherwise(F.concat(F.lit("Rs. "), F.format_number("rupees", 0)))
    time = F.when(j == 2, "no time").otherwise(F.date_format("paid_at", "ddMMMyyyyhhmma"))
    receiver = _pick(F.col("case_id") % 3, F.lit(MERCHANT), F.lit("ZZZ"), F.lit(f"To {MERCHANT} Ltd"))
    last = F.when(j == 5, "bye").otherwise(F.concat(F.lit("Destination Acc Title "), receiver))
    return c.select("case_id", F.concat_ws("\n", amount, F.concat(label, shown), time, last).alias("text"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, text: five phrasings of the amount (none where the key ends in 77) and six ways to write the time."""
    c = cases(spark, sf_dir)
    k = F.col("case_id")
    grouped, plain = F.format_number("rupees", 0), F.col("rupees").cast("string")
    said = F.when(k % 100 == 77, "hello").otherwise(_pick(k % 5, F.concat(F.lit("final: "), grouped, F.lit(" then 12")), F.concat(F.lit("Total bill "), grouped), F.concat(plain, F.lit(" PKR please")), F.concat(F.lit("banega "), grouped), F.concat(plain, F.lit(" rupees"))))
    at = F.col("paid_at") - F.make_dt_interval(mins=F.when(k % 7 == 0, -20).when(k % 7 == 1, -10).otherwise(30))
    written = lambda f: F.date_format(at, f)
    time = _pick(k % 6, written("'['dd/MM/yyyy, hh:mm a']'"), written("'['dd/MM/yyyy, HH:mm']'"), written("'['MM/dd/yyyy, hh:mm a']'"), written("'['yyyy-MM-dd HH:mm']'"), written("'['yyyy/MM/dd hh:mm a']'"), written("'['yyyy-MM-dd HH:mm 'hello]'"))
    return c.select("case_id", F.concat(F.lit("[01/02/1990, 01:02 PM] hi\n"), time, F.lit(" "), said).alias("text"), at.alias("said_at"))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, sender, received, timestamp, transaction_id, amount, by the key's last digit but one: none; another amount; 3
    and 6 wrong characters; 10 and 40 minutes off; no time; another sender; two characters lost and two too many; the
    last as paid, two minutes later."""
    c = cases(spark, sf_dir).withColumn("e", F.floor(F.col("case_id") / 10) % 10).where("e <> 0").withColumn("tid", bank_id(F.col("case_id")))
    tid, e = F.col("tid"), F.col("e")
    wrong = lambda places: F.concat(*[F.lit("x") if i in places else F.substring(tid, i + 1, 1) for i in range(24)])
    mixed = F.concat(F.substring(tid, 1, 4), F.substring(tid, 6, 4), F.lit("x"), F.substring(tid, 10, 7), F.substring(tid, 18, 4), F.lit("z"), F.substring(tid, 22, 3))
    seen = F.when(e == 2, wrong({1, 8, 15})).when(e == 3, wrong({1, 5, 9, 13, 17, 21})).when(e == 8, mixed).otherwise(tid)
    at = F.col("paid_at") + F.make_dt_interval(mins=F.when(e == 4, 10).when(e == 5, 40).otherwise(2))
    return c.select(F.concat(F.lit("m"), F.col("key")).alias("id"), F.when(e == 7, "news@shop.example").otherwise(SENDER).alias("sender"), (F.col("paid_at") + F.expr("interval 3 minutes")).alias("received"), F.when(e != 6, at).alias("timestamp"), seen.alias("transaction_id"), (F.col("rupees") + F.when(e == 1, 10).otherwise(0)).alias("amount"), "case_id")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filename, source_file (of three items each), category, clip and visual (the same vector backwards)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.col("vec_id").cast("string"), F.lit(".jpg")).alias("filename"), F.concat(F.lit("s"), F.floor(F.col("vec_id") / 3).cast("string")).alias("source_file"), F.concat(F.lit("cat"), F.col("label").cast("string")).alias("category"), F.col("embedding").alias("clip"), F.reverse("embedding").alias("visual"), "vec_id")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every item whose id is divisible by 20."""
    return inventory(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "clip", "visual", "category")


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, template, embedding: the three first items of each category, as a vocabulary of prompts would be."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("category").orderBy("vec_id"))
    return inventory(spark, sf_dir).withColumn("n", n).where("n <= 3").select(F.col("category").alias("label"), F.concat_ws("-", F.col("category"), F.col("n").cast("string")).alias("template"), F.col("clip").alias("embedding"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image metrics by remainders of line items' keys, covering all outcomes of the choice of preprocessing."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    m = lambda a, b: ((k * a + n * b) % 101).cast("double")
    return table(spark, sf_dir, "lineitem").select(k.alias("order_id"), n.alias("line_no"), m(7, 13).alias("noise"), m(11, 29).alias("contrast"), m(3, 17).alias("brightness"), m(19, 5).alias("blur"), ((k * 7919 + n * 104729) % 3_000_000).cast("double").alias("pixels"), m(23, 31).alias("density"))
