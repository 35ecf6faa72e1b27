"""Catalogs on disk: writing, opening, searching, metadata files and their checks."""

import warnings

import pytest
from pyspark.sql import functions as F

import celestile
from celestile.catalog import in_memory, open_catalog
from celestile.functions import healpix as hp
from celestile.operators import cells as C
from celestile.operators import regions as R
from celestile.plans.sky import view
from celestile.sources import files, metadata, paths, registry, stores, validation
from celestile.sources.properties import Properties, as_list, parse

OBJECT = {"catalog_name": "t", "catalog_type": "object", "total_rows": 10, "ra_column": "ra", "dec_column": "dec"}
ORDER1 = [(1, 44), (1, 45), (1, 46), (1, 47)]


@pytest.fixture(scope="module")
def rows(spark, small):
    return view(spark, small, "orders", "o_orderkey", "o_custkey")


@pytest.fixture(scope="module")
def base(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("cat") / "orders")
    celestile.write_catalog(rows, d, "orders", highest=5, threshold=200, default_columns=["o_orderkey", "ra", "dec"])
    return d


def cells(cat):
    return sorted((r["Norder"], r["Npix"]) for r in cat.partitions.collect())


def test_written_catalog_is_whole_and_valid(spark, rows, base, capsys):
    cat = open_catalog(spark, base)
    assert cat.properties.total_rows == rows.count() == cat.rows().count()
    assert cat.rows().columns == ["o_orderkey", "ra", "dec"] and "o_custkey" in cat.schema.names
    assert validation.is_valid(spark, base) and validation.is_valid(spark, base, strict=True, fail_fast=True)
    assert "partitions" in capsys.readouterr().out
    placed = cat.rows([hp.INDEX_COLUMN, "Norder", "Npix"])
    assert placed.where(F.call_function("shiftright", hp.INDEX_COLUMN, ((29 - F.col("Norder")) * 2).cast("int")) != F.col("Npix")).count() == 0
    assert max(r["count"] for r in placed.groupBy("Norder", "Npix").count().collect()) <= 200
    assert cat.max_coverage_order() == 5 and 0 < cat.coverage() <= 1.001
    footer = metadata.read_footer(paths.pointer(base, paths.METADATA))
    order = [(o, p) for o, p in metadata.partitions_from_metadata(paths.pointer(base, paths.METADATA), strict=True)]
    assert footer.num_rows == rows.count() and order == sorted(order, key=lambda c: c[1] << 2 * (29 - c[0]))


def test_searches_agree_with_a_plain_filter(spark, rows, base):
    cat = open_catalog(spark, base)
    for region in (R.Cone(120, 10, 30 * 3600), R.Box(ra=(350, 80), dec=(-40, 20)), R.Polygon(((0, 0), (60, 0), (30, 40)))):
        assert cat.search(region).count() == rows.where(R.row_predicate(region)).count()
    kept = cat.filter_by_cone(120, 10, 3600)
    assert kept.properties.total_rows == 0 and not kept.on_disk and set(cells(kept)) < set(cells(cat))
    assert cat.filter_by_box(ra=(0, 90)).partitions.count() and cat.filter_by_polygon([(0, 0), (60, 0), (30, 40)]).partitions.count()
    assert cat.filter_pixels([]).partitions.count() == 0
    again = cat.filter_pixels([]).filter_by_cone(0, 0, 1)
    assert again.partitions.count() == 0
    assert cat.align(cat).count() == cat.partitions.count() and cat.align(kept).count() <= kept.partitions.count()


def test_filters_open_only_their_leaf_files(spark, base):
    cat = open_catalog(spark, base)
    one = cells(cat)[3]
    kept = cat.filter_pixels([one])
    (file,) = kept.rows([]).inputFiles()
    assert paths.cell_of_path(file) == one and kept.rows([]).where(F.col("Npix") == one[1]).count() == kept.rows([]).count() > 0
    assert kept.filter_pixels([]).rows([]).count() == 0 and kept.all_columns() == cat.all_columns()
    found = cat.search(R.Cone(120, 10, 3600))
    assert len(found.inputFiles()) < len(cells(cat)) / 4
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan or "PushedFilters: [IsNotNull" in plan


def test_a_task_lists_many_named_files(spark, tmp_path):
    celestile.write_catalog(spark.range(480).selectExpr("id", "id * 137 % 360 + 0.5 AS ra", "id * 89 % 179 - 89.0 AS dec"), str(tmp_path / "a"), "a", highest=3, threshold=8)
    cat = open_catalog(spark, str(tmp_path / "a"))
    setting, tracker = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext.statusTracker()
    assert len(cells(cat)) > 32  # fewer are listed by the driver
    held = spark.conf.get(setting)
    spark.sparkContext.setJobGroup("named", "")
    try:
        df = cat.rows([])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in tracker.getJobIdsForGroup("named") for s in tracker.getJobInfo(j).stageIds]
    assert max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 and spark.conf.get(setting) == held
    assert df.count() == 480 and len(df.inputFiles()) == len(cells(cat))


def test_more_leaves_than_are_named(spark, rows, base, monkeypatch):
    monkeypatch.setattr("celestile.catalog.MOST_FILES", 2)
    cat = open_catalog(spark, base)
    some = cells(cat)[:3]
    kept = cat.filter_pixels(some)
    assert kept.rows([]).count() == sum(open_catalog(spark, base).filter_pixels([c]).rows([]).count() for c in some) and cat.rows().count() == rows.count()


def test_partitions_held_or_joined_alike(spark, rows, monkeypatch):
    from celestile.operators import partition as T

    placed = hp.with_index(rows)
    aligned = T.alignment(T.histogram_by_index(placed, 5), 5, 0, 300)
    held = T.assign(placed, aligned, 5).select("o_orderkey", "Norder", "Npix")
    assert "Exchange hashpartitioning(pix" not in held._jdf.queryExecution().toString()
    monkeypatch.setattr(T, "MOST_HELD", 1)
    assert held.exceptAll(T.assign(placed, aligned, 5).select(*held.columns)).isEmpty() and held.count() == rows.count()
    assert T.assign(placed, aligned.where("false"), 5).isEmpty()


def test_sky_maps(spark, tmp_path):
    import numpy as np

    from celestile.sources import skymap

    counts = spark.createDataFrame([(0, 5), (700, 2), (767, 1)], "pix long, n long")
    at = str(tmp_path / "map.fits")
    skymap.write_map(counts, 3, at)
    back, order = skymap.read_counts(spark, at)
    assert order == 3 and back.exceptAll(counts).isEmpty() and back.count() == 3
    raw = open(at, "rb").read()
    assert len(raw) % 2880 == 0 and np.frombuffer(raw[5760 : 5760 + 768 * 4], ">i4")[[0, 700, 767, 1]].tolist() == [5, 2, 1, 0]
    ring = raw.replace(b"'NESTED  '", b"'RING    '")
    (tmp_path / "ring.fits").write_bytes(ring)
    want = {(r[0], 5 if r[1] == 0 else 2 if r[1] == 700 else 1) for r in hp.with_nested(spark.createDataFrame([(0,), (700,), (767,)], "ring long"), "ring", 3, "pix").select("pix", "ring").collect()}
    assert {(r["pix"], r["n"]) for r in skymap.read_counts(spark, str(tmp_path / "ring.fits"))[0].collect()} == want
    # Numbered cells of two columns, one of them not observed.
    cards = skymap._cards(
        ("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 12), ("NAXIS2", 3), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 2), ("TFORM1", "1K"), ("TFORM2", "1E"),
        ("ORDERING", "NESTED"), ("NSIDE", 8), ("INDXSCHM", "EXPLICIT"),
    )
    body = np.array([(5, 2.5), (6, skymap.UNSEEN), (9, 1.0)], dtype=[("k", ">i8"), ("v", ">f4")]).tobytes()
    (tmp_path / "keyed.fits").write_bytes(raw[:2880] + cards + body.ljust(2880, b"\0"))
    assert sorted(map(tuple, skymap.read_map(spark, str(tmp_path / "keyed.fits")).collect())) == [(5, 2.5), (9, 1.0)]
    (tmp_path / "none.fits").write_bytes(raw[:2880])
    with pytest.raises(ValueError, match="no sky map"):
        skymap.layout(str(tmp_path / "none.fits"))
    with pytest.raises(ValueError):
        skymap.write_map(counts, 13, at)


def test_coverage_from_a_sky_map_file(spark, base, tmp_path):
    import shutil

    from celestile.sources import skymap

    other = str(tmp_path / "cat")
    shutil.copytree(base, other)
    skymap.write_map(spark.read.parquet(f"{base}/{paths.POINT_MAP}"), 5, f"{other}/{paths.SKY_MAP}")
    shutil.rmtree(f"{other}/{paths.POINT_MAP}")
    a, b = open_catalog(spark, base), open_catalog(spark, other)
    assert b.moc_order == 5 and a.moc.exceptAll(b.moc).isEmpty() and a.moc.count() == b.moc.count()


def test_overfull_cells_are_written_whole(spark, tmp_path):
    df = spark.range(60).selectExpr("id", "if(id < 50, 10.0, id * 5.0) AS ra", "20.0 AS dec")
    with pytest.raises(ValueError):
        celestile.write_catalog(df, str(tmp_path / "a"), "t", highest=3, threshold=20)
    celestile.write_catalog(df, str(tmp_path / "b"), "t", highest=3, threshold=20, keep_overfull=True)
    cat = open_catalog(spark, str(tmp_path / "b"))
    assert sorted(r["id"] for r in cat.rows([]).collect()) == list(range(60)) and cat.properties.total_rows == 60
    assert [r["count"] for r in cat.rows([]).groupBy("Norder", "Npix").count().where("count > 20").collect()] == [50]


def test_many_pairs_are_written_as_rows(spark, base, tmp_path, monkeypatch):
    cat = open_catalog(spark, base)
    few = stores.write_association(cat, cat, [("o_custkey", "o_custkey")], str(tmp_path / "few"), "few")
    monkeypatch.setattr(stores, "MOST_PAIRS", len(few) - 1)
    many = stores.write_association(cat, cat, [("o_custkey", "o_custkey")], str(tmp_path / "many"), "many")
    a, b = (open_catalog(spark, str(tmp_path / x)) for x in ("few", "many"))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, b.pairs.collect())) == sorted(few)
    assert a.properties.total_rows == b.properties.total_rows and cells(a) == cells(b)


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        open_catalog(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError, match="properties"):
        open_catalog(spark, str(tmp_path))
    Properties(**OBJECT).write(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        open_catalog(spark, str(tmp_path))
    assert not validation.is_valid(spark, str(tmp_path))
    with pytest.raises(ValueError):
        validation.is_valid(spark, str(tmp_path), strict=True, fail_fast=True, verbose=False)
    with pytest.warns(UserWarning):
        assert not validation.is_valid(spark, str(tmp_path), strict=True, verbose=False)
    metadata.write_cells_metadata(str(tmp_path), [(0, 11)])
    with pytest.warns(UserWarning, match="slow"):
        assert cells(open_catalog(spark, str(tmp_path))) == [(0, 11)]
    with pytest.raises(NotImplementedError):
        open_catalog(spark, str(tmp_path), "puzzle")


def test_memory_catalogs(spark):
    cat = in_memory(spark, Properties(**OBJECT), ORDER1)
    assert cells(cat.filter_by_cone(315, -66.443, 30 * 3600)) == ORDER1
    assert sorted(map(tuple, cat.negative_cells().collect())) == [(0, p) for p in range(11)]
    with pytest.raises(TypeError):
        in_memory(spark, Properties(**OBJECT), "cells")
    with pytest.raises(ValueError):
        in_memory(spark, Properties(**OBJECT), [(0, 11), (1, 44)])
    assoc = Properties(catalog_name="a", catalog_type="association", total_rows=4, primary_catalog="p", primary_column="id", join_catalog="j", join_column="id", contains_leaf_files=False)
    with pytest.raises(TypeError):
        in_memory(spark, assoc, [(0, 11)])
    pairs = spark.createDataFrame([(0, 11, *p) for p in ORDER1], "Norder int, Npix long, join_Norder int, join_Npix long")
    a = in_memory(spark, assoc, [(0, 11)], pairs=pairs)
    assert [tuple(j) for j in a.join_map().first()["joins"]] == ORDER1
    assert a.filter_pixels([(1, 45)]).pairs.count() == 4 and a.filter_pixels([(0, 3)]).pairs.count() == 0
    with pytest.raises(TypeError):
        cat.join_map()
    margin = Properties(catalog_name="m", catalog_type="margin", total_rows=4, primary_catalog="p", margin_threshold=7200.0)
    m = in_memory(spark, margin, [(0, 4), *ORDER1])
    from celestile.operators import moc as M

    assert cells(m.filter_moc(M.from_cells(C.from_pixels(spark, [(1, 44)])))) == ORDER1


def test_association_index_and_margin_on_disk(spark, rows, base, tmp_path):
    cat = open_catalog(spark, base)
    other = str(tmp_path / "assoc")
    pairs = stores.write_association(cat, cat, [("o_custkey", "o_custkey")], other, "self")
    a = open_catalog(spark, other)
    assert a.pairs.count() == len(pairs) and a.join_map().count() == cat.partitions.count()
    index = str(tmp_path / "index")
    stores.write_index(cat, "o_custkey", index, "by_customer")
    i = open_catalog(spark, index)
    some = rows.select("o_custkey").first()[0]
    want = {tuple(r) for r in cat.rows(["Norder", "Npix", "o_custkey"]).where(F.col("o_custkey") == some).select("Norder", "Npix").collect()}
    assert {tuple(r) for r in i.loc_partitions([some]).collect()} == want and i.loc_partitions([-1]).count() == 0
    margin = str(tmp_path / "margin")
    stores.write_margin(cat, 3600.0, margin, "around")
    m = open_catalog(spark, margin)
    got = m.rows(["o_orderkey", "Norder", "Npix", hp.INDEX_COLUMN])
    assert got.count() == m.properties.total_rows > 0
    own = F.call_function("shiftright", hp.INDEX_COLUMN, ((29 - F.col("Norder")) * 2).cast("int"))
    assert got.where(own == F.col("Npix")).count() == 0


def test_single_values_and_statistics(spark, base):
    meta = paths.pointer(base, paths.METADATA)
    groups = list(metadata.row_groups(base))
    assert metadata.single_value(groups[0], "Norder") in range(6)
    for bad in ("o_orderkey", "nothing"):
        with pytest.raises(ValueError):
            metadata.single_value(groups[0], bad)
    stats = {r["column_names"]: r for r in metadata.footer_statistics(spark, meta).collect()}
    assert int(stats["o_orderkey"]["min_value"]) <= int(stats["o_orderkey"]["max_value"]) and stats["ra"]["null_count"] == 0
    leaf = metadata.leaf_list(base)[0]
    assert metadata.cell_of_footer(metadata.read_footer(leaf)) == paths.cell_of_path(leaf)
    with pytest.raises(FileNotFoundError):
        metadata.read_footer(f"{base}/nothing.parquet")
    assert metadata.write_metadata(base, out=f"{base}-copy") == sum(g.num_rows for g in groups)


def test_partition_lists(tmp_path):
    d = str(tmp_path)
    metadata.write_partitions(d, ORDER1)
    assert metadata.read_partitions(d) == ORDER1
    with pytest.raises(ValueError):
        metadata.write_partitions(None, ORDER1)
    pairs = [(0, 11, *p) for p in ORDER1]
    metadata.write_pairs(d, pairs)
    assert metadata.read_pairs(d) == pairs and metadata.read_partitions(d) == [(0, 11)]
    assert metadata.write_cells_metadata(d, pairs, metadata.PAIR) == 4
    assert metadata.pairs_from_metadata(paths.pointer(d, paths.METADATA), strict=True) == pairs
    paths.write_text(f"{d}/{paths.JOIN_INFO}", "Norder,Npix\n0,11\n")
    with pytest.raises(ValueError, match="join_Norder, join_Npix"):
        metadata.read_pairs(d)


def test_paths(spark):
    assert paths.pixel_directory("foo", 0, 5) == "foo/dataset/Norder=0/Dir=0"
    assert paths.pixel_directory("foo", 5, 10_006) == "foo/dataset/Norder=5/Dir=10000"
    assert paths.pixel_directory("foo", 1, number=20_000) == "foo/dataset/Norder=1/Dir=20000"
    with pytest.raises(ValueError):
        paths.pixel_directory("foo", 1)
    assert paths.leaf_files("/foo", [(0, 5), (1, 16)]) == ["/foo/dataset/Norder=0/Dir=0/Npix=5.parquet", "/foo/dataset/Norder=1/Dir=0/Npix=16.parquet"]
    assert paths.query_params({"cols": ["ra", "dec"], "filters": ["r_auto<13", " ra < 3"], "": "x", "no": None}) == "?cols=ra%2Cdec&filters=r_auto%3C13%2Cra%3C3"
    assert paths.leaf_file("http://x/c", 0, 5, {"a": "b"}).endswith("Npix=5.parquet?a=b") and not paths.leaf_file("/c", 0, 5, {"a": "b"}).endswith("a=b")
    assert paths.cell_of_path("/c/dataset/Norder=5/Dir=0/Npix=34.parquet") == (5, 34)
    assert paths.cell_of_path("/c/Norder=5/Npix=34/part0.parquet") == (5, 34) and paths.cell_of_path("no cell here") == paths.INVALID


def test_properties(tmp_path):
    p = Properties.of({"obs_collection": "t", "dataproduct_type": "object", "any_nrows": "10", "any_col_ra": "ra", "any_col_dec": "dec", "any_cols_default": "a, b;c d", "t_min": "1"})
    assert p.default_columns == ["a", "b", "c", "d"] and p.total_rows == 10 and p.extra == {"t_min": "1"}
    p.write(str(tmp_path))
    assert Properties.read(str(tmp_path)) == p
    assert p.updated(total_rows=3).total_rows == 3 and as_list("") is None
    assert parse("# no\na=b\nc : d\\:e\nf g\\\n  h\n") == {"a": "b", "c": "d:e", "f": "gh"}
    for bad in ({**OBJECT, "primary_column": "x"}, {k: v for k, v in OBJECT.items() if k != "ra_column"}, {**OBJECT, "catalog_type": "puzzle"}, {**OBJECT, "extra": {"typo_here": 1}}):
        with pytest.raises(ValueError):
            Properties(**bad)


def test_registry(spark, base, tmp_path, monkeypatch):
    monkeypatch.setenv("HERE", str(tmp_path))
    d = tmp_path / "reg"
    d.mkdir()
    registry.Entry.from_catalog(base).write(str(d))
    with pytest.raises(ValueError, match="exists"):
        registry.Entry.from_catalog(base).write(str(d))
    entry = lambda name, kind, **more: registry.Entry(catalog_name=name, catalog_type=kind, catalog_path=f"$HERE/{name}", **more)
    entry("visits", "source", primary="orders").write(str(d))
    entry("near", "margin", primary="orders").write(str(d))
    entry("ids", "index", catalog_info={"primary_catalog": "$HERE/visits"}).write(str(d))
    entry("pairs", "association", primary="orders", join="visits", deprecated="yes").write(str(d))
    r = registry.Registry(str(d))
    assert sorted(r.names()) == ["ids", "near", "orders", "visits"] and len(r.names(include_deprecated=True)) == 5
    assert r.names(types=["object", "source"]) == ["orders", "visits"] and r.names(types=["foo"]) == []
    assert [e.catalog_name for e in r["orders"].linked("sources")] == ["visits"] and r["visits"].linked("objects") == [r["orders"]]
    assert r["visits"].linked("indexes") == [r["ids"]] and r["pairs"].linked("join") == [r["visits"]] and r["orders"].linked("margins") == [r["near"]]
    assert r["near"].catalog_path == f"{tmp_path}/near" and r.open(spark, "orders").name == "orders"
    assert r.frame(spark).count() == 5 and r.links(spark).where("role = 'associations'").count() == 1
    two = registry.Registry({"a": str(d), "b": [str(d)]})
    assert len(two.names()) == 8 and two["b:visits"].linked("objects") == [two["b:orders"]]
    with pytest.warns(UserWarning, match="Duplicate"):
        registry.Registry([str(d), str(d / "visits.yml")])
    monkeypatch.setenv(registry.ENVIRONMENT, "$HERE/reg")
    assert len(registry.Registry().names()) == 4 and registry.Registry(use_default=False).names() == []
    lone = tmp_path / "lone"
    lone.mkdir()
    entry("near", "margin", primary="nowhere").write(str(lone))
    entry("odd", "puzzle").write(str(lone))
    with pytest.warns(UserWarning) as seen:
        registry.Registry(str(lone), use_default=False)
    assert {"missing", "unknown"} <= {w for s in seen for w in str(s.message).split()}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        entry("alone", "source").write(str(tmp_path))
        registry.Registry(str(tmp_path / "alone.yml"), use_default=False)
    with pytest.raises(ValueError):
        registry.Entry.from_file("x.json")
    monkeypatch.delenv(registry.ENVIRONMENT)
    with pytest.raises(ValueError):
        entry("x", "object").write()


def test_plain_files(spark, tmp_path):
    df = spark.range(25).withColumn("b", F.col("id") * 2)
    files.write_csv(df, str(tmp_path / "c"))
    files.write_parquet(df, str(tmp_path / "p"))
    assert files.read_csv(spark, str(tmp_path / "c")).agg(F.sum("b")).first()[0] == 600
    assert [len(x) for x in files.csv_chunks(spark, str(tmp_path / "c"), 10, "id long, b long")] == [10, 10, 5]
    assert files.read_parquet(spark, str(tmp_path / "p"), str(tmp_path / "p")).count() == 50
    assert files.read_lines(spark, str(tmp_path / "c")).count() >= 26
    paths.make_directory(str(tmp_path / "d"))
    with pytest.raises(FileExistsError):
        paths.make_directory(str(tmp_path / "d"))
    paths.write_text(str(tmp_path / "d/x.txt"), "text")
    assert paths.has_contents(str(tmp_path / "d")) and paths.find_files(str(tmp_path), "d/*.txt") == [str(tmp_path / "d/x.txt")]
    paths.delete_file(str(tmp_path / "d/x.txt"))
    paths.remove_directory(str(tmp_path / "d"))
    assert not paths.exists(str(tmp_path / "d"))
    paths.remove_directory(str(tmp_path / "d"), ignore_errors=True)


def test_streams(spark, small, tmp_path):
    from celestile.streaming import sky

    df = view(spark, small, "events", "CAST(ts AS TIMESTAMP) AS ts")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    region = R.Box(dec=(-30, 60))
    q = sky.counts(sky.inside(sky.indexed(stream), region), 2, "ts", "30 days", "1 day").writeStream.format("memory").queryName("sky").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sky").agg(F.sum("n")).first()[0] == df.where(R.row_predicate(region)).count()
