from lodestone.operators import directory as d

LISTINGS = [(1, "app", "games", 1), (2, "app", "games", 2), (3, "app", "tools", 3), (4, "app", "tools", 4), (5, "app", "tools", 5), (6, "app", "art", 6), (7, "block", "sdk", 7), (8, "org", None, 8)]


def plans(spark, questions, scored, cap=4):
    q = spark.createDataFrame(questions, "question_id long, topics array<string>, kinds array<string>, category string")
    listings = spark.createDataFrame(LISTINGS, "item long, kind string, category string, pos long")
    found = d.planned(q, listings, spark.createDataFrame(scored, "question_id long, item long, score double"), cap).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.question_id, r.place)):
        out.setdefault((r.question_id, r.mode), []).append(r.item)
    return out


def test_each_question_has_one_plan(spark):
    questions = [
        (1, [], ["app"], "games"),
        (2, None, ["app"], None),
        (3, [], ["app"], "nowhere"),
        (4, [], ["org"], "games"),
        (5, ["wallet"], ["app"], "games"),
        (6, ["wallet"], ["app"], "art"),
        (7, ["wallet"], ["block"], "games"),
        (8, ["nothing"], ["app"], None),
    ]
    scored = [(q, i, s) for q in (5, 6, 7) for i, s in ((1, 5.0), (3, 5.0), (4, 9.0), (2, 3.0), (7, 4.0), (8, 9.0))]
    assert plans(spark, questions, scored) == {
        (1, "browse"): [1, 2],
        (2, "spread"): [3, 1, 6, 4],  # the largest category first, one of each, then a second of the largest
        (3, "spread"): [3, 1, 6, 4],
        (4, "spread"): [8],  # the category has nothing of that kind
        (5, "search"): [1],  # 2 is below the floor of 0.35 times the best
        (6, "search_any"): [4, 1, 3],
        (7, "search"): [7],  # only apps have categories
    }


def test_empty_tables(spark):
    assert plans(spark, [], []) == {}
    assert plans(spark, [(1, [], ["app"], "games")], [], cap=1) == {(1, "browse"): [1]}
