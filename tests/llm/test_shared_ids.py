"""Ids that an empty text shares with another."""

from hashlib import blake2b

from lodestack.llm import ngramjoin
from lodestack.llm.common import word_gram_hashes


def test_empty_text_with_the_id_of_a_near_copy(spark):
    digest = lambda t: blake2b(word_gram_hashes(t, ngramjoin.GRAM).tobytes(), digest_size=16).digest()
    # near copies whose sets come after the empty one by hash
    made = (" ".join(f"w{i}" for i in range(200)) + f" end{k}" for k in range(1000))
    a, b = [t for t in made if digest(t) > digest("")][:2]
    for rows in ([(1, a), (2, b), (1, "")], [(1, a), (2, b), (1, None), (2, " ")]):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert [(r["doc_a"], r["doc_b"]) for r in ngramjoin.jaccard_pairs(docs)[0].collect()] == [(1, 2)]
        assert {tuple(r) for r in ngramjoin.classes(docs).collect()} == {(1, 1, 1, 1), (2, 1, 1, 1)}
