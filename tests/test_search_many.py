"""A table of questions in one plan against each question alone."""

import random

from pyspark.sql import functions as F

from sediment.operators import retrieval

CHUNKS = "chunk_id long, source_id long, content string, owner string, duplicate_of long, embedding array<float>"


def test_each_question_gets_what_it_gets_alone(spark):
    rng = random.Random(2)
    vector = lambda: [round(rng.gauss(0, 1), 3) for _ in range(5)]
    rows = []
    for i in range(260):
        words = " ".join(rng.choice(["alpha", "beta"] if rng.random() < 0.04 else [f"w{rng.randrange(60)}"]) for _ in range(12))
        rows.append((i, i % 90, words, rng.choice(["public", "public", "ann"]), 1 if i % 31 == 5 else None, vector() if i % 3 else None))
    rows[10] = (*rows[10][:5], [0.0] * 5)
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = [(1, "alpha beta w7", vector()), (2, "alpha w3", None), (3, "the and", vector()), (4, "of", None), (5, "w1 w2 w3 w4 alpha alpha", vector()), (6, None, vector())]
    questions = spark.createDataFrame(asked, "qid long, question string, vector array<float>")
    columns = ["marker", "chunk_id", "source_id", "matched_terms", "score", "similarity", "lexical_rank", "vector_rank", "rrf", "found_by"]
    many = retrieval.search_many(chunks, questions, 4, user="ann")
    got: dict[int, list[tuple]] = {}
    for r in many.orderBy("qid", "marker").collect():
        got.setdefault(r.qid, []).append(tuple(r[c] for c in columns))
    for qid, question, held in questions.collect():
        alone = retrieval.search(chunks, question or "", held, 4, user="ann").select(*columns).orderBy("marker").collect()
        assert got.get(qid, []) == [tuple(r) for r in alone], qid
    # In blocks of two vectors the same.
    near = [tuple(r) for r in retrieval.semantic_many(retrieval.visible(chunks, "ann"), questions, 4, block=2).orderBy("qid", "vector_rank").collect()]
    assert near == [tuple(r) for r in retrieval.semantic_many(retrieval.visible(chunks, "ann"), questions, 4).orderBy("qid", "vector_rank").collect()] and near
    judged = {r.qid: (r.hits, r.abstained) for r in retrieval.abstains_many(questions, many).collect()}
    assert judged[4] == (0, True) and len(judged) == 6 and judged[1][0] == 4
    assert retrieval.search_many(chunks, questions.where(F.lit(False)), 4).count() == 0
