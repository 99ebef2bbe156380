from pyspark.sql import functions as F

from lectern.functions import intents as I
from lectern.functions import text as X


def test_predicates(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(I.correction_reason(F.lit("你再搜索一下"))) == "重新检索" and one(I.is_correction(F.lit("不，有的"))) is True
    assert one(I.is_correction(F.lit("错了"))) is False and one(I.is_correction(F.lit(None).cast("string"))) is False
    assert one(I.claims_absence(F.lit("书里没有这个词"), F.lit("q"))) is True and one(I.claims_absence(F.lit(None).cast("string"), F.lit("q"))) is False
    assert one(I.compares_books(F.lit("这两本书有何不同"))) is True
    no = F.lit(False)
    assert one(I.is_small_talk(F.lit("Hello!"), no, no)) is True and one(I.is_small_talk(F.lit("what is this about"), no, no)) is False
    assert one(I.asked_concept(F.lit("书中有没有提到量子纠缠？"))) == "量子纠缠"
    assert len(X.STOP_WORDS) == len(set(X.STOP_WORDS)) == 47
