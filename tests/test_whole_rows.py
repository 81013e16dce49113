"""Queries that return all rows of their input."""

from auditloom.plans import registry


def test_copies_keep_their_rows_and_links(spark, tmp_path):
    near = lambda i, flipped: [1.0 if (i >> (b % 8)) & 1 ^ (b in flipped) else -1.0 for b in range(64)]
    rows = [(1, 0, near(5, ())), (2, 0, near(5, ())), (3, 1, near(5, (63,))), (4, 1, near(5, (0, 20, 40, 63))), (5, 1, near(5, (1, 2, 3, 4, 5))), (6, 0, near(250, ()))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: (r["class"], r["links"]) for r in registry.queries()["d12_near_members"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (4, 2), 5: (5, 0), 6: (6, 0)}


def test_word_sets_of_all_languages(spark, tmp_path):
    rows = [(1, "Two moths, two", "en"), (2, "dos polillas Dos 3", "es"), (3, "a b", None), (4, "虫 x1", "ZH "), (5, None, "en"), (6, "", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(map(tuple, registry.queries()["h11_all_word_sets"](spark, str(tmp_path)).collect())) == {1: 2, 2: 3, 3: 2, 4: 1, 6: 0}
