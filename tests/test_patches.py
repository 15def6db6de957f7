"""Patches within one tile are linked with nothing; those over a tile's border still are."""

from floodspark.operators import components


def _looked_at(spark, monkeypatch, rows, tile):
    seen = []

    def counted(px, *more):
        seen.append(px.count())
        return neighbours(px, *more)

    neighbours = components.neighbours
    monkeypatch.setattr(components, "neighbours", counted)
    px = spark.createDataFrame([(0, y, x, 1) for y, x in rows], "scene_id long, y int, x int, m int")
    sizes = {(r["y"], r["x"]): r["size"] for r in components.patch_sizes(px, "m").collect()} if tile is None else None
    labels = {(r["y"], r["x"]): r["label"] for r in (components.patches(px, "m") if tile is None else components.patches(px, "m", tile)).collect()}
    return seen, labels, sizes


def test_no_pixel_of_a_scene_of_one_tile_is_linked(spark, monkeypatch):
    rows = [(0, 0), (0, 1), (1, 0), (5, 0), (0, 9), (24, 24)]
    seen, labels, sizes = _looked_at(spark, monkeypatch, rows, None)
    assert seen == [0, 0]
    assert sizes == {(0, 0): 3, (0, 1): 3, (1, 0): 3, (5, 0): 1, (0, 9): 1, (24, 24): 1}


def test_patches_over_a_border_are_one(spark, monkeypatch):
    rows = [(0, 3), (0, 4), (3, 0), (4, 1), (7, 7), (8, 8), (2, 2)]
    seen, labels, _ = _looked_at(spark, monkeypatch, rows, 4)
    assert seen[0] > 0
    assert labels[0, 3] == labels[0, 4] and labels[3, 0] == labels[4, 1] and labels[7, 7] == labels[8, 8]
    assert len(set(labels.values())) == 4
