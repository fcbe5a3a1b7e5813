from heronry import policy as P
from heronry.plans import kb


def test_texts_are_classified_once(spark, sf_dir):
    plan = kb.labels(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"regexp_replace(prompt") == 1 and P.FILE_PATTERN in plan


def test_equal_texts_share_a_classification_and_all_items_stay(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    found = kb.classified(spark, sf_dir)
    assert found.count() == part.count() == found.select("item_id").distinct().count()
    assert kb.queries(spark, sf_dir).count() == part.where("p_partkey % 100 = 0").count()
