"""Lists with levels beyond the format's nine, against a fold."""

import random

from vellum.operators import lists, numbering


def test_deep_levels(spark):
    rng = random.Random(3)
    levels = [rng.choice([0, 3, 7, 8, 9, 10, 12, 200]) for _ in range(80)]
    counters, indexes, parents, depths = {}, [], [], []
    for pos, k in enumerate(levels):
        counters = {j: n for j, n in counters.items() if j <= k}
        counters[k] = counters.get(k, 0) + 1
        indexes.append(counters[k])
        above = [p for p in range(pos) if levels[p] < k]
        parents.append(above[-1] if above else None)
        depths.append(0 if not above else depths[above[-1]] + 1)
    items = spark.createDataFrame([(1, p, 1, k, 1, "decimal") for p, k in enumerate(levels)], "doc_id long, pos int, num_id int, ilvl int, start int, list_type string")
    got = numbering.list_indexes(items, ["doc_id"], ["pos"]).orderBy("pos").collect()
    assert [r.display_index for r in got] == indexes
    elements = spark.createDataFrame([(1, p, "list_item", "t", k, "decimal", 1) for p, k in enumerate(levels)], "doc_id long, pos int, kind string, text string, level int, list_type string, display_index long")
    got = lists.nested_lists(elements).orderBy("pos").collect()
    assert [r.parent_pos for r in got] == parents and [r.depth for r in got] == depths
