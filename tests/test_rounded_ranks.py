"""Scores on a rounding half don't hang on the order in which ranks were summed."""

from lodestack.operators import features


def test_ranks_alike_but_for_noise_give_one_score(spark):
    noise = [1.0, 1 - 2**-53, 1 - 2**-52, 1 - 3 * 2**-52, 1 - 2**-50]
    names = [f"f{i}" for i in range(len(noise))]
    own = spark.createDataFrame([(n, 23, 4, 13, 20) for n in names], "qname string, loc int, cc int, struct_pairs int, struct_size int")
    ranks = spark.createDataFrame(list(zip(names, noise)), "qname string, rank double")
    tfidf = spark.createDataFrame([(n, 2.3) for n in names], "qname string, tfidf double")
    api = spark.createDataFrame([(n, 0.4) for n in names], "qname string, api double")
    # 0.05 + 0.01725 + 0.25 + 0.15 + 0.15 + 0.04 lies on a half of the fourth digit
    found = features.features(own, ranks, tfidf, api).withColumn("base", features.base_score()).collect()
    assert {r["base"] for r in found} == {0.6573} and {r["pr"] for r in found} == {1.0}
