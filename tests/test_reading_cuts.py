"""Reading order by recursive cuts, against a recursion on small pages."""

import random

import pytest

from glossweave.operators.layout import reading_order, reading_order_cuts

SCHEMA = "page long, panel_no long, id long, x0 long, y0 long, x1 long, y1 long"


def parts(boxes, axis):
    low, high = (1, 3) if axis == "x" else (2, 4)
    out, reach = [], None
    for b in sorted(boxes, key=lambda b: (b[low], b[high], b[0])):
        if reach is not None and b[low] >= reach:
            out.append([b])
        elif out:
            out[-1].append(b)
        else:
            out.append([b])
        reach = b[high] if reach is None else max(reach, b[high])
    return out


def brute(boxes, direction):
    """Ids in order; boxes are (id, x0, y0, x1, y1)."""
    first, second = ("x", "y") if direction == "vertical" else ("y", "x")

    def ordered(groups, axis):
        return groups[::-1] if axis == "x" and direction != "ltr" else groups

    outer = parts(boxes, first)
    inner = [(g, parts(g, second)) for g in outer]
    if len(outer) == 1 and len(inner[0][1]) == 1:
        across = (lambda b: b[1]) if direction == "ltr" else (lambda b: -b[3])
        by = (lambda b: (across(b), b[2], b[0])) if direction == "vertical" else (lambda b: (b[2], across(b), b[0]))
        return [b[0] for b in sorted(boxes, key=by)]
    order = []
    for group in ordered(outer, first):
        for part in ordered(parts(group, second), second):
            order += brute(part, direction)
    return order


@pytest.mark.parametrize("direction", ["rtl", "ltr", "vertical"])
@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_equals_a_recursion(spark, direction, limit):
    rng = random.Random(7)
    rows, want = [], {}
    for page in range(12):
        boxes = []
        for i in range(rng.randrange(1, 30)):
            x, y = rng.randrange(0, 400), rng.randrange(0, 600)
            boxes.append((i, x, y, x + rng.randrange(5, 60), y + rng.randrange(5, 60)))
        rows += [(page, page % 3 or None, *b) for b in boxes]
        want[page] = brute(boxes, direction)
    found = reading_order_cuts(spark.createDataFrame(rows, SCHEMA), direction, limit).collect()
    got = {page: [r.id for r in sorted((r for r in found if r.page == page), key=lambda r: r.ord)] for page in want}
    assert got == want
    assert {r.panel_no for r in found} == {-1, 1, 2}


def test_staggered_panels_keep_together(spark):
    # two columns; the right one starts 40 lower, so bands of 60 mix its rows with the left one's
    boxes = [(i, 0, 100 * i, 90, 100 * i + 70) for i in range(4)] + [(10 + i, 110, 100 * i + 40, 200, 100 * i + 110) for i in range(4)]
    df = spark.createDataFrame([(0, 0, *b) for b in boxes], SCHEMA)

    def ids(found):
        return [r.id for r in sorted(found.collect(), key=lambda r: r.ord)]

    assert ids(reading_order_cuts(df)) == [10, 11, 12, 13, 0, 1, 2, 3]
    assert ids(reading_order(df)) != [10, 11, 12, 13, 0, 1, 2, 3]


def test_null_edges_and_no_boxes(spark):
    df = spark.createDataFrame([(0, 0, 1, None, None, None, None), (0, 0, 2, 0, 0, 5, 5), (0, 0, 3, 9, 9, 12, 12)], SCHEMA)
    assert [r.id for r in sorted(reading_order_cuts(df, "ltr").collect(), key=lambda r: r.ord)] == [1, 2, 3]
    assert reading_order_cuts(df.filter("1 = 0")).collect() == []


def test_nested_deeper_than_one_pass(spark):
    # each level is a bar over the whole width, a post over the height that is left, and the next level
    boxes = []
    for i in range(8):
        at, end = 10 * i, 200
        boxes += [(2 * i, at, at, end, at + 5), (2 * i + 1, at, at + 10, at + 5, end)]
    df = spark.createDataFrame([(0, 0, *b) for b in boxes], SCHEMA)
    got = [r.id for r in sorted(reading_order_cuts(df, "rtl").collect(), key=lambda r: r.ord)]
    assert got == brute(boxes, "rtl")


def test_computes_its_input_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def seen(row):
        computed.add(1)
        return row

    rows = [(i % 3, 0, i, 10 * i, 0, 10 * i + 5, 5) for i in range(30)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), SCHEMA)
    assert len(reading_order_cuts(df).collect()) == 30
    assert computed.value == 30
