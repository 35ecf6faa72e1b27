"""Orders, cells, trees, alignment and coverage against known values."""

import math

import pytest
from pyspark.sql import functions as F

from celestile.functions import healpix as hp
from celestile.operators import align as A
from celestile.operators import cells as C
from celestile.operators import margins as G
from celestile.operators import moc as M
from celestile.operators import partition as T
from celestile.operators import regions as R

MIXED = [(2, 128), (2, 130), (2, 131), (1, 33), (1, 35), (0, 10), (1, 44), (1, 45), (1, 46)]
OTHER = [(0, 8), (1, 36), (1, 37), (1, 40), (1, 42), (1, 43), (1, 44), (1, 46), (1, 47)]
BOTH = {(1, 33), (1, 35), (1, 40), (1, 42), (1, 43), (1, 44), (1, 46), (2, 128), (2, 130), (2, 131)}
ORDER1 = [(1, 44), (1, 45), (1, 46), (1, 47)]
DEEP = [(6, 30), (7, 124), (7, 5000)]


def pairs(df):
    return sorted((r["Norder"], r["Npix"]) for r in df.collect())


def test_orders_and_sizes():
    assert [hp.margin2order(x) for x in (1 / 60, 10 / 60, 1, 5, 60)] == [17, 13, 11, 8, 5]
    assert hp.npix2order(hp.order2npix(7)) == 7 and hp.nside2order(8) == 3
    assert math.isclose(hp.nside2pixarea(1), 4 * math.pi / 12) and hp.avgsize2mindist(1.6) == 1.0
    for bad in (30, -1):
        with pytest.raises(ValueError):
            hp.order2npix(bad)
    with pytest.raises(ValueError):
        hp.npix2order(13)


def test_positions_at_order_0_and_centres(spark):
    df = spark.createDataFrame([(282.5, -58.5), (299.5, -48.5)], "ra double, dec double")
    assert {tuple(r) for r in T.histogram(df, 0).collect()} == {(11, 2)}
    dense = sorted(tuple(r) for r in T.dense(T.histogram(df, 0), 0).collect())
    assert dense == [(p, 2 * (p == 11)) for p in range(12)]
    with pytest.raises(ValueError):
        T.histogram(df.drop("ra"), 0)
    for order in (0, 3, 12, 29):
        cells = spark.range(0, hp.order2npix(order), max(1, hp.order2npix(order) // 500)).withColumnRenamed("id", "pix")
        back = hp.with_pixel(hp.with_centre(cells, "pix", order, "ra", "dec"), "ra", "dec", order, "again")
        if order < 20:  # centres of deeper cells are closer than the precision of a double in degrees
            assert back.where("pix <> again").count() == 0
    v = hp.with_vector(df)
    got = v.select(hp.vector_ra(F.col("x"), F.col("y")), hp.vector_dec(F.col("x"), F.col("y"), F.col("z"))).first()
    assert math.isclose(got[0], 282.5) and math.isclose(got[1], -58.5)


def test_order_changes(spark):
    one = C.from_pixels(spark, [(3, 5)])
    assert pairs(C.lower(one, 2)) == [(1, 0)] and pairs(C.descendants(one, 1)) == [(4, p) for p in range(20, 24)]
    assert pairs(C.descendants(C.from_pixels(spark, [(-1, 0)]), 1)) == [(0, p) for p in range(12)]
    for bad in (lambda: C.lower(one, 4).collect(), lambda: C.descendants(one, 27).collect()):
        with pytest.raises(Exception, match="no cell|orders end"):
            bad()
    for f in (C.lower, C.descendants):
        with pytest.raises(ValueError):
            f(one, -1)
    x = spark.createDataFrame([(16, 32), (4**25, 2 * 4**25)], "lo long, hi long")
    assert [r[0] for r in x.select(hp.interval_order(F.col("lo"), F.col("hi"), 29)).collect()] == [27, 4]


def test_nested_order_and_overlaps(spark):
    c = C.from_pixels(spark, sorted(MIXED))
    assert [tuple(r) for r in C.nested_order(c).collect()] == MIXED
    rank = {(r["Norder"], r["Npix"]): r["rank"] for r in C.nested_rank(c).collect()}
    assert sorted(rank, key=rank.get) == MIXED and sorted(rank.values()) == list(range(9))
    assert C.tree(c).count() == 9
    for bad in ([(0, 11), (1, 44)], [(1, 3), (1, 3)]):
        with pytest.raises(ValueError):
            C.tree(C.from_pixels(spark, bad))
    assert math.isclose(C.coverage(C.from_pixels(spark, ORDER1)).first()[0], 3437.75 / 41253, rel_tol=1e-3)
    nothing = C.from_pixels(spark, [])
    assert C.highest_order(nothing).first()[0] is None and C.coverage(nothing).first()[0] == 0


@pytest.mark.parametrize("how, more", [("inner", set()), ("left", {(1, 41), (1, 45)}), ("right", {(1, 34), (1, 36), (1, 37), (1, 47), (2, 129)}), ("outer", {(1, 34), (1, 36), (1, 37), (1, 41), (1, 45), (1, 47), (2, 129)})])
def test_alignment_of_trees(spark, how, more):
    out = A.align(C.from_pixels(spark, MIXED), C.from_pixels(spark, OTHER), how).collect()
    assert sorted((r["aligned_Norder"], r["aligned_Npix"]) for r in out) == sorted(BOTH | more)
    for r in out:
        sides = [(r["primary_Norder"], r["primary_Npix"]), (r["join_Norder"], r["join_Npix"])]
        assert ((None, None) in sides) == ((r["aligned_Norder"], r["aligned_Npix"]) in more)
    with pytest.raises(ValueError):
        A.align(C.from_pixels(spark, MIXED), C.from_pixels(spark, OTHER), "sideways")


def test_gaps_down_to_the_last_order(spark):
    last = 4**25 - 1
    out = A.align(C.from_pixels(spark, [(0, 0)]), C.from_pixels(spark, [(25, last)]), "outer").collect()
    assert len(out) == 1 + 3 * 25
    assert sum(4 ** (29 - r["aligned_Norder"]) for r in out) == 4**29


def test_negative_tree(spark):
    base = [(0, p) for p in range(11)]
    assert pairs(C.negative(C.from_pixels(spark, ORDER1))) == base
    assert pairs(C.negative(C.from_pixels(spark, ORDER1[1:]))) == [*base, (1, 44)]
    assert pairs(C.negative(C.from_pixels(spark, []))) == [(0, p) for p in range(12)]


def test_coverage_algebra(spark):
    a, b = M.from_cells(C.from_pixels(spark, [(1, 0), (1, 1), (2, 8)])), M.from_cells(C.from_pixels(spark, [(0, 0), (3, 70)]))
    span = lambda df: sorted(tuple(r) for r in df.collect())
    s = 4**27
    assert span(a) == [(0, 9 * s)]
    assert span(M.intersection(a, b)) == [(0, 9 * s)]
    assert span(M.union(a, b)) == [(0, 16 * s), (70 * s // 4, 71 * s // 4)]
    assert pairs(M.to_cells(a)) == [(1, 0), (1, 1), (2, 8)]
    assert pairs(M.flatten(M.from_cells(C.from_pixels(spark, [(1, 44)])), 2)) == [(2, p) for p in range(176, 180)]
    whole = M.from_cells(C.base_cells(spark))
    assert span(whole) == [(0, 12 * 4**29)]
    assert pairs(M.to_cells(whole)) == [(0, p) for p in range(12)]


# Published margin cells of three cells.
@pytest.mark.parametrize("order, pix, want", [
    (2, 2, [1141, 1143, 1149, 1151, 1237, 128, 129, 132, 133, 144, 48, 50, 56, 58, 26, 10, 11, 14, 15, 1119]),
    (2, 5, [69, 71, 77, 79, 101, 112, 113, 116, 117, 442, 426, 427, 430, 431, 1530, 1531, 1534, 1535, 1519]),
    (1, 35, [549, 551, 557, 559, 261, 272, 273, 276, 277, 0, 352, 354, 360, 362, 330, 538, 539, 542, 543, 527]),
])
def test_margin_cells(spark, order, pix, want):
    m = G.margin_cells(C.from_pixels(spark, [(order, pix)]), order, 2)
    assert [r["margin_pix"] for r in m.orderBy("side", "margin_pix").collect()] == want
    with pytest.raises(ValueError):
        G.margin_cells(C.from_pixels(spark, [(order, pix)]), order, 0)
    with pytest.raises(ValueError):
        G.edge(1, 0, 8)


def test_margins_touch_their_cells(spark):
    """Every cell beside a cell, found from the far side: a finer cell is in the margin if one of its own neighbours is in the cell."""
    order, steps = 1, 2
    fine = spark.range(12 << 2 * (order + steps)).withColumnRenamed("id", "p")
    near = {r["p"]: [x for x in r["neighbours"] if x is not None] for r in hp.with_neighbours(fine, "p", order + steps).collect()}
    want = {(x >> 2 * steps, p) for p, xs in near.items() for x in xs if x >> 2 * steps != p >> 2 * steps}
    got = {(r["cell"], r["margin_pix"]) for r in G.margin_cells(C.from_pixels(spark, [(order, p) for p in range(48)]), order, steps).collect()}
    assert got <= want
    # Diagonal steps from within a side lead to cells that a straight step reaches as well.
    assert got == want


@pytest.mark.parametrize("order, pix, points, want", [
    (3, 4, [(42.4704538, 1.4593925), (56.25, 9.6), (56.25, 10.0), (50.61225197, 14.4767556)], [False, True, False, True]),
    (0, 4, [(142.4704538, 1.4593925), (45.09, 0.0), (45.2, 0.0), (37.31343956517391, 6.566326903165274), (42.649354753311535, 2.005185097251452)], [False, True, False, True, True]),
    (0, 1, [(89.0, 89.9), (-179.0, 89.9), (-45.0, 85.0)], [True, True, False]),
    (0, 9, [(89.0, -89.9), (-179.0, -89.9), (-45.0, -85.0)], [True, True, False]),
])
def test_near_boundary(spark, order, pix, points, want):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, ra double, dec double")
    got = G.near_boundary(df, order, pix, 360.0).orderBy("i")
    assert [r["in_margin"] for r in got.collect()] == want


def test_few_samples_of_a_boundary_are_measured(spark):
    """All that are nearest, but hardly more than one for each point; points without a position stay."""
    b = hp.with_boundary(spark.createDataFrame([(3,)], "cell long"), "cell", 1, 100).orderBy("sample").select("ra", "dec").collect()
    places = [(i * 137 % 36000 / 100.0, i * 89 % 17999 / 100.0 - 89.99) for i in range(300)] + [(405.0, 60.0), (-315.0, 60.0), (45.0, -90.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, ra double, dec double")
    got = {r["i"]: r["c"] for r in df.select("i", G._nearest([tuple(r) for r in b])("ra", "dec").alias("c")).collect()}
    unit = lambda ra, dec: (math.cos(math.radians(dec)) * math.cos(math.radians(ra)), math.cos(math.radians(dec)) * math.sin(math.radians(ra)), math.sin(math.radians(dec)))
    for i, p in enumerate(places):
        apart = [math.dist(unit(*p), unit(*s)) for s in b]
        assert {k for k, x in enumerate(apart) if x <= min(apart) + 1e-13} <= set(got[i]) and got[i] == sorted(got[i])
    assert sum(map(len, got.values())) < 1.2 * len(places)
    odd = spark.createDataFrame([(0, None, 1.0), (1, 1.0, None), (2, float("nan"), 3.0), (3, 405.0, 60.0), (4, 45.0, 60.0)], "i int, ra double, dec double")
    flags = [r["in_margin"] for r in G.near_boundary(odd, 1, 3, 7200.0).orderBy("i").collect()]
    assert flags[:3] == [None, None, False] and flags[3] == flags[4] and G.near_boundary(odd.limit(0), 1, 3, 7200.0).count() == 0


def test_margins_of_cells_as_fine_as_the_margin(spark):
    """A margin of 3600 arcsec is one of cells of order 5: rows of the eight around a leaf of that order are in it."""
    assert hp.margin2order(60.0) == 5
    near = {r[0] for r in hp.with_neighbours(spark.createDataFrame([(1000,)], "p long"), "p", 5).selectExpr("explode(neighbours)").collect()}
    rows = spark.range(hp.order2npix(5)).select("id", hp.to_index(F.col("id"), 5).alias(hp.INDEX_COLUMN))
    got = G.margin_cache(rows, C.from_pixels(spark, [(5, 1000)]), 3600.0)
    assert {(r["id"], r["margin_Norder"], r["margin_Npix"]) for r in got.collect()} == {(p, 5, 1000) for p in near} and len(near) == 8
    with pytest.raises(ValueError):
        G.margin_cache(rows, C.from_pixels(spark, [(6, 4000)]), 3600.0)


def test_margin_filter(spark):
    own = C.from_pixels(spark, [(0, 4), *ORDER1])
    moc = M.from_cells(C.from_pixels(spark, [(1, 44)]))
    assert pairs(G.filter_margin(own, moc, 1, 7200)) == ORDER1
    with pytest.raises(ValueError):
        G.filter_margin(own, moc, 1, 10**6)


COUNTS2 = [4, 11, 14, 13, 5, 7, 8, 9, 11, 23, 4, 4, 17, 0, 1, 0]


@pytest.mark.parametrize("drop", [False, True])
def test_partitions_by_density(spark, drop):
    frame = lambda rows: spark.createDataFrame(rows, "pix long, n long")
    plan = lambda rows, *a: {r["pix"]: (r["Norder"], r["Npix"], r["total"]) for r in T.alignment(frame(rows), *a, drop_empty_siblings=drop).collect()}
    assert plan([(11, 131)], 0, 0, 250) == {11: (0, 11, 131)}
    assert plan(list(zip(range(44, 48), (42, 29, 42, 18))), 1, 0, 250) == {p: (0, 11, 131) for p in range(44, 48)}
    filled = [(p, n) for p, n in zip(range(176, 192), COUNTS2) if n]
    assert plan(filled, 2, 0, 250) == {p: (0, 11, 131) for p, _ in filled}
    assert plan([(44, 100)], 1, 0, 250) == {44: (1, 44, 100) if drop else (0, 11, 100)}
    even = spark.range(hp.order2npix(7)).select(F.col("id").alias("pix"), F.lit(40).cast("long").alias("n"))
    for lowest, want in ((0, 5), (7, 7)):
        got = T.alignment(even, 7, lowest, 1000, drop_empty_siblings=drop)
        assert got.where(F.col("Norder") != want).count() == 0 and got.count() == hp.order2npix(7)
    for rows, a in (([(11, 131)], (0, 0, 20)), ([(12, 1)], (0, 0, 20)), ([], (1, 2, 20))):
        with pytest.raises(ValueError):
            plan(rows, *a)


@pytest.mark.parametrize("drop", [False, True])
def test_overfull_cells_stay_whole(spark, drop):
    counts = spark.createDataFrame([(176, 30), (177, 5), (180, 4), (181, 3)], "pix long, n long")
    got = T.alignment(counts, 2, 0, 20, drop, keep_overfull=True)
    assert {tuple(r) for r in got.collect()} == {(176, 2, 176, 30), (177, 2, 177, 5), (180, 1, 45, 7), (181, 1, 45, 7)}


CASES = [
    (R.Cone(315, -66.443, 0.1), [(1, 44)]), (R.Cone(315, -66.443, 30 * 3600), ORDER1), (R.Cone(0, 0, 0.1), []),
    (R.Polygon(((282, -58), (282, -55), (272, -55), (272, -58))), [(1, 46)]), (R.Polygon(((281, -69), (281, -25), (350, -25), (350, -69))), ORDER1), (R.Polygon(((0, 0), (1, 1), (0, 2))), []),
    (R.Box(ra=(280, 290)), [(1, 44), (1, 46)]), (R.Box(ra=(-10, 10)), [(1, 44), (1, 45)]), (R.Box(dec=(10, 20)), []), (R.Box(dec=(-10, 10)), [(1, 47)]),
    (R.Box(dec=(-30, -20)), ORDER1[1:]), (R.Box(ra=(280, 300), dec=(-30, -20)), [(1, 46), (1, 47)]), (R.Box(ra=(40, 50), dec=(10, 20)), []),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_regions_keep_known_leaves(spark, i):
    region, want = CASES[i]
    assert pairs(R.filter_leaves(C.from_pixels(spark, ORDER1), region, 6)) == want


@pytest.mark.parametrize("region", [R.Cone(47.1, 6, 30 * 3600), R.Polygon(((47.1, 6), (64.5, 6), (64.5, 6.27), (47.1, 6.27)))])
def test_regions_over_cells_of_mixed_orders(spark, region):
    assert pairs(R.filter_leaves(C.from_pixels(spark, DEEP), region, 7)) == DEEP[:2]


@pytest.mark.parametrize("a, b", [((0, 180), (180, 0)), ((10, 50), (50, 10)), ((10, 220), (220, 10)), ((350, 200), (200, 350)), ((50, 200), (200, 50))])
def test_boxes_and_their_complements(spark, a, b):
    small, large = (set(pairs(R.filter_leaves(C.from_pixels(spark, ORDER1), R.Box(ra=x), 6))) for x in (a, b))
    assert small < large


@pytest.mark.parametrize("make", [
    lambda: R.Cone(0, -100, 1), lambda: R.Cone(0, 10, -1), lambda: R.Box(ra=(0, 30), dec=(-100, -70)), lambda: R.Box(dec=(0, -10)), lambda: R.Box(ra=(0, 30), dec=(-30, -40, 10)),
    lambda: R.Box(ra=(0, 30, 40), dec=(-40, 10)), lambda: R.Box(ra=(100, 100)), lambda: R.Box(ra=(0, 360)), lambda: R.Box(dec=(50, 50)), lambda: R.Box(),
    lambda: R.Polygon(((47.1, -100), (64.5, -100), (64.5, 6))), lambda: R.Polygon(((100.1, -20.3), (100.1, 40.3))), lambda: R.Polygon(((100.1, -20.3), (100.1, -20.3), (280.1, -20.3), (280.1, 40.3))),
    lambda: R.Polygon(((100.1, 40.3), (100.1, -20.3), (280.1, -20.3), (280.1, 40.3))), lambda: R.Polygon(((50.1, 0), (100.1, 0), (150.1, 0), (200.1, 0))),
])
def test_bad_regions(make):
    with pytest.raises(ValueError):
        make()


def test_covers_hold_every_row(spark, small):
    from celestile.plans.queries import REGIONS
    from celestile.plans.sky import view

    rows = hp.with_index(view(spark, small, "lineitem", "l_orderkey"))
    for region in REGIONS.values():
        direct = rows.where(R.row_predicate(region))
        assert R.search(rows, region, order=5).count() == direct.count() > 0
        leaf = R.cover(spark, region, 5).select(F.col("Npix").alias("c"))
        assert direct.withColumn("c", hp.to_order(F.col(hp.INDEX_COLUMN), 5)).join(leaf, "c", "left_anti").count() == 0


def test_cross_match_refuses_radii_beyond_the_ring(spark):
    from celestile.operators import joins

    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 39.9, 0.0), (3, 50.0, 0.0)], "i int, ra double, dec double")
    got = joins.cross_match(df, df.withColumnRenamed("i", "j"), 40 * 3600.0, "i", "j")
    assert {(r["i"], r["j"]) for r in got.collect()} == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1), (2, 3), (3, 2)}
    with pytest.raises(ValueError):
        joins.cross_match(df, df, 41 * 3600.0, "i", "i")


def test_cells_as_values():
    from celestile.functions.pixel import Pixel, as_pixel

    p = as_pixel((3, 25))
    assert str(p) == repr(p) == "Order: 3, Pixel: 25" and p[0] == 3 and p[1] == 25 and p == (3, 25) and as_pixel(p) == p
    assert p.lower(1) == (2, 6) and p.lower(3) == (0, 0) and p.higher(1) == [Pixel(4, k) for k in range(100, 104)] and as_pixel((8, 123456)).directory == 120000
    with pytest.raises(ValueError):
        as_pixel((1, 2, 3))
    with pytest.raises(ValueError):
        as_pixel((30, 0))
    for bad in ([1, 2], "12", 7):
        with pytest.raises(TypeError):
            as_pixel(bad)
    for steps in (-1, 4):
        with pytest.raises(ValueError):
            p.lower(steps)
    with pytest.raises(ValueError):
        p.higher(27)


@pytest.mark.parametrize("order", [0, 1, 3])
def test_ring_numbers_run_from_the_north(spark, order):
    n = hp.order2npix(order)
    got = [r["pix"] for r in hp.with_nested(spark.range(n).withColumnRenamed("id", "ring"), "ring", order, "pix").orderBy("ring").collect()]
    centres = {r["pix"]: (-round(r["dec"], 8), round(r["ra"], 8)) for r in hp.with_centre(spark.range(n).withColumnRenamed("id", "pix"), "pix", order).collect()}
    assert got == sorted(centres, key=centres.get)


def test_ring_numbers_of_high_orders(spark):
    """The first cells of each pole, of the border rings and of the equator, by the cells their centres are in."""
    n = 1 << 13
    cap, last = 2 * n * (n - 1), 12 * n * n
    some = [0, 1, 3, 4, 11, 12, cap - 1, cap, cap + 4 * n, last // 2, last - cap, last - 5, last - 1]
    got = hp.with_nested(spark.createDataFrame([(x,) for x in some], "ring long"), "ring", 13, "pix")
    c = hp.with_centre(got, "pix", 13).orderBy("ring").collect()
    assert len({r["pix"] for r in c}) == len(some) and [round(r["dec"], 6) for r in c] == sorted((round(r["dec"], 6) for r in c), reverse=True)
    assert [round(r["ra"]) for r in c[:4]] == [45, 135, 315, 22] and [round(r["ra"]) for r in c[-2:]] == [338, 315]
