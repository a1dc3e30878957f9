from collections import Counter

from test_training_operators import brute_components

from ledgerlake.llm import jaccard_join

WORDS = [f"v{i}" for i in range(60)]


def changed(*at):
    return " ".join(f"x{i}" if i in at else w for i, w in enumerate(WORDS))


def test_rows_without_ids_link_and_bridge(spark):
    # 0 and 2 changed words differ too much; the row without an id links with both
    rows = [(1, changed(0, 1)), (None, changed(0)), (2, changed()), (None, changed(0)), (None, "only words of a row without an id"), (None, "Only words of a row without an id"), (7, ""), (None, None), (3, "two words"), (3, "two words")]
    df = spark.createDataFrame([(*r, "a", 5) for r in rows], "doc_id long, text string, key string, row int")
    got = jaccard_join.join(df, 3, 90).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_components(rows, 3, 90)
    assert Counter(map(tuple, got)) == want
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}


def test_ids_of_another_type(spark):
    df = spark.createDataFrame([("b", changed()), ("a", changed(59)), ("c", "other words")], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(df, 3, 90).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_size_bands_of_a_large_cluster(spark):
    """A chain of sets of 60 to 140 shingles, each a twentieth longer than the one before, cut into tiles of 4."""
    words = [f"w{i}" for i in range(150)]
    rows = [(1000 * size + k, " ".join(words[:size] + [f"y{k}"])) for size in (60, 63, 66, 69, 73, 77, 81, 86, 91, 96, 101, 107, 113, 119, 125, 132, 140) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"tile_rows": 4}, {"tile_elements": 500}, {}):
        got = jaccard_join.join(df, 3, 90, **options).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(map(tuple, got)) == brute_components(rows, 3, 90)
