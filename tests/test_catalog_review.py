"""Catalogue upkeep, review edits, harvest and the persistent tables."""

import random

from pyspark.sql import functions as F

from stockcount.operators import absorb, catalog, harvest, identify, review, runs, video, votes
from stockcount.sources import catalog_text, stores

PRODUCT = "ean string, descripcion string, packaging_type_id string, brand string, size string, n_imagenes int, embeddings_calculados boolean, activo boolean"


def test_catalog_file_round(spark, tmp_path):
    path = tmp_path / "eans.txt"
    path.write_text("# head\n\n1\tUno\tlata\n2  Dos  bolsa\n1\tOtro\n3\tTres\tlata\tMarca\t \tVar\n", encoding="utf-8")
    lines = catalog_text.read_lines(spark, str(path))
    assert {(r.ean, r.categoria) for r in catalog_text.parse_catalog(lines).collect()} == {("1", "lata"), ("1", None), ("3", "lata")}
    lenient = {r.ean: (r.descripcion, r.categoria) for r in catalog_text.parse_catalog_lenient(lines).collect()}
    assert lenient == {"1": ("Otro", ""), "2": ("Dos", "bolsa"), "3": ("Tres", "lata")}
    full = {(r.ean, r.valida, r.brand, r["size"], r.variant) for r in catalog_text.parse_catalog_full(lines).collect()}
    assert ("3", True, "Marca", None, "Var") in full and ("1", False, None, None, None) in full
    assert {r.ean for r in catalog_text.validation_list(lines).collect()} == {"1", "2  Dos  bolsa", "3"}
    assert catalog_text.validation_list(None) is None and catalog_text.validation_list(lines.filter("value like '#%'")) is None


def test_sync_applies_lines_one_by_one_and_is_idempotent(spark):
    products = spark.createDataFrame(
        [("1", "Uno", "lata", None, "1L", 4, True, True), ("9", "Nueve", "lata", None, None, 0, False, False)], PRODUCT
    )
    packaging = spark.createDataFrame([("lata",), ("bolsa",)], "id string")
    lines = [
        (1, "1", "Uno", "lata", "", "1L"),  # blank brand equals null
        (2, "2", "Dos", "lata", None, None),
        (3, "2", "Dos", "lata", None, None),
        (4, "2", "Dos", "bolsa", "M", None),
        (5, "3", "Tres", "nada", None, None),
        (6, "1", "Uno!", "lata", None, "1L"),
    ]
    incoming = spark.createDataFrame(lines, "line long, ean string, descripcion string, packaging_type_id string, brand string, size string")
    incoming = incoming.withColumn("brand", F.nullif("brand", F.lit("")))
    log = {r.line: (r.accion, r.cambios) for r in catalog.sync_log(products, incoming, packaging, "line").collect()}
    assert log == {
        1: ("igual", ""), 2: ("agregado", ""), 3: ("igual", ""), 4: ("actualizado", "packaging_type_id,brand"),
        5: ("error", ""), 6: ("actualizado", "descripcion"),
    }
    after = catalog.sync_catalog(products, incoming, packaging, "line")
    rows = {r.ean: r for r in after.collect()}
    assert set(rows) == {"1", "2", "9"} and rows["1"].n_imagenes == 4 and rows["1"].descripcion == "Uno!"
    assert rows["2"].brand == "M" and rows["2"].activo and rows["9"].activo is False
    last = incoming.filter("line in (4, 6)")
    again = catalog.sync_counts(catalog.sync_log(after, last, packaging, "line")).first()
    assert (again.agregados, again.actualizados, again.errores) == (0, 0, 0)


def test_small_catalogue_helpers(spark):
    seed = catalog.packaging_seed(spark)
    assert seed.count() == 7 and catalog.class_bridge(spark).count() == 12
    merged = catalog.insert_missing(seed.filter("id <> 'lata'"), seed, ["id"])
    assert [r.id for r in merged.filter("insertado").collect()] == ["lata"]
    text = spark.createDataFrame([("a", '["x","y"]'), ("b", None)], "id string, prompts_clip string")
    assert {r.id: r.prompts_clip for r in catalog.parse_prompts(text).collect()} == {"a": ["x", "y"], "b": []}
    named = spark.createDataFrame([("7",), ("LATA",), ("otro",), (None,), ("8",)], "detectada string")
    packaging = spark.createDataFrame([("7", "Bolsa")], "id string, nombre string")
    got = {r.detectada: r.categoria for r in identify.category_name(named, packaging).collect()}
    assert got == {"7": "bolsa", "LATA": "lata", "otro": None, None: None, "8": None}
    files = spark.createDataFrame([("1", "i/1/a.JPG"), ("1", "i/1/b.txt"), ("1", "i.jpg/1/c")], "ean string, path string")
    assert catalog.image_files(files).count() == 1


def test_review_status_words(spark):
    rows = [("reviewed", "1"), ("reviewed", "DESCARTED"), (None, None), ("skipped", None)]
    df = spark.createDataFrame(rows, "s string, e string")
    got = [r[0] for r in df.select(review.canonical_status(F.col("s"), F.col("e"))).collect()]
    assert got == ["labeled", "discarded", "pending", "skipped"]
    labelled = spark.createDataFrame(
        [("reviewed", "1"), ("labeled", "2"), ("labeled", "DESCARTED"), ("skipped", "1"), ("labeled", None)], "status string, assigned_ean string"
    )
    assert absorb.candidates(labelled).count() == 2 and absorb.candidates(labelled, only="2").count() == 1


def test_next_pending_wraps(spark):
    rows = [(1, 0, "pending"), (1, 5, "pending"), (1, 7, "labeled"), (2, 3, "skipped"), (2, 1, "pending"), (3, 1, "labeled")]
    records = spark.createDataFrame(rows, "run_id long, idx long, status string")
    pos = spark.createDataFrame([(1, 5), (2, 0), (3, 0)], "run_id long, actual long")
    got = {r.run_id: (r.siguiente, r.desde_inicio) for r in review.next_pending(records, pos).collect()}
    assert got == {1: (0, True), 2: (1, False)}


def test_review_log_survives_corruption(spark, tmp_path):
    identified = spark.createDataFrame(
        [("c1", "unknown", "otro", 0.1, [("E", 0.1)]), ("c2", "matched", "lata", 0.9, [("E", 0.9)])],
        "crop_id string, status string, detectada string, confianza double, top_matches array<struct<ean: string, similitud: double>>",
    )
    records = identify.review_records(identified, F.lit("run-1"), F.lit("2024-01-01T00:00:00"))
    path = str(tmp_path / "log")
    stores.append_review_log(records, path)
    stores.append_review_log(records, path)
    (tmp_path / "log" / "extra.json").write_text('{"crop_id": "x", \n\n{"crop_id": "ok"}\nnull-ish\n')
    back = stores.read_review_log(spark, path)
    assert sorted(r.crop_id for r in back.collect()) == ["c1", "c1", "ok"]
    row = back.filter("crop_id = 'c1'").first()
    assert row.review.status == "pending" and row.sku_identification.top_matches[0].ean == "E"
    assert row.paths.crop == "learning/unknown/c1.jpg"


def test_review_item_paths(spark):
    rows = [("c1", "ambiguous", "a/x.jpg"), ("c2", None, None)]
    records = spark.createDataFrame(rows, "crop_id string, decision string, crop_path string").select(
        F.monotonically_increasing_id().alias("idx"), "crop_id", F.lit(None).cast("string").alias("id"), "decision", "crop_path",
        F.lit(None).cast("string").alias("predicted_ean"),
        F.from_json(F.lit('{"top1": {"ean": "9"}, "top2": {"ean": "8"}}'), "top_matches array<struct<ean: string>>, top1 struct<ean: string>, top2 struct<ean: string>, top3 struct<ean: string>").alias("sku_identification"),
        F.struct(F.lit(None).cast("string").alias("crop")).alias("paths"),
        F.struct(F.lit(None).cast("string").alias("status")).alias("review"),
    )
    none = spark.createDataFrame([], "crop_path string")
    got = {r.crop_id: (r.status, r.predicted_ean, len(r.top_matches), r.crop_path) for r in review.review_items(records, none).collect()}
    assert got == {"c1": ("ambiguous", "9", 2, "learning/ambiguous/c1.jpg"), "c2": ("unknown", "9", 2, "learning/unknown/c2.jpg")}
    assert review.review_items(records).filter("crop_id = 'c1'").first().crop_path == "a/x.jpg"


def test_stores_round_trip(spark, tmp_path):
    refs = spark.createDataFrame([("A", 1, "lata", [1.0]), ("B", 2, "bolsa", [2.0])], "ean string, ref_id long, categoria string, embedding array<float>")
    path = str(tmp_path / "refs")
    stores.write_refs(refs, path)
    stores.write_refs(refs.filter("ean = 'A'").withColumn("ref_id", F.lit(7).cast("long")), path, replace_all=False)
    assert {(r.ean, r.ref_id) for r in stores.read_refs(spark, path).collect()} == {("A", 7), ("B", 2)}
    pruned = stores.read_refs(spark, path, ["lata"])
    assert [r.ean for r in pruned.collect()] == ["A"]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = stores.read_refs(spark, path, ["lata"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(categoria" in plan and "categoria" not in plan.split("ReadSchema")[1]
    inv = spark.createDataFrame([("A", 3)], "ean string, cantidad long")
    stores.write_inventory(inv, str(tmp_path / "inv"), "2024-01-01")
    assert stores.read_inventory(spark, str(tmp_path / "inv")).first().asDict() == {"ean": "A", "cantidad": 3, "fecha": "2024-01-01"}
    metrics = spark.createDataFrame([("t", "r1", "v", {"unknown_pct": 12.5})], stores.METRICS_SCHEMA)
    stores.append_metrics(metrics, str(tmp_path / "hist"), str(tmp_path / "runs"))
    stores.append_metrics(metrics, str(tmp_path / "hist"))
    assert stores.read_metrics(spark, str(tmp_path / "hist")).count() == 2
    v = spark.createDataFrame([(1, "A", 0.9, 1), (1, "B", 0.9, 2), (1, "A", 0.9, 3)], "track_id long, sku string, sim double, frame_idx long")
    docs = votes.track_summary_documents(v, votes.track_decisions(v))
    stores.write_track_summary(docs, str(tmp_path / "tracks"))
    row = spark.read.json(str(tmp_path / "tracks")).first()
    assert row.final_sku == "A" and row.votes.A == 2 and [m.sku for m in row.top_matches] == ["A", "B"]
    debug = spark.createDataFrame([(1, 0, "ACTIVE")], "video_id long, frame_idx long, track_state string")
    stores.append_track_debug(debug, str(tmp_path / "debug"))
    stores.append_track_debug(debug, str(tmp_path / "debug"))
    assert spark.read.csv(str(tmp_path / "debug"), header=True).count() == 2


def test_search_equals_looking_into_every_text(spark):
    schema = "ean long, descripcion string, packaging_type_id string"
    rows = [(i, f"Product {i:03d} {'Red' if i % 3 else 'blue'} ÄÖ", "t") for i in range(60)] + [(777, None, "a"), (778, "", None), (61, "İstanbul ab", "t")] * 2
    terms = [" RED", "blue", "", "no such", "7", "77", "r", "ct 0", "äö", "stanbul", "aaaa", " ", *[f"{i:03d}" for i in range(60)]]
    frame = spark.createDataFrame([(t,) for t in [*terms, None, "blue"]], "busqueda string")
    got = {}
    for r in catalog.search_products(spark.createDataFrame(rows, schema), frame, limit=5).orderBy("busqueda", "rank").collect():
        got.setdefault(r.busqueda, []).append((r.ean, r.descripcion))
    place = lambda r: ((r[2] is not None, r[2] or ""), (r[1] is not None, r[1] or ""), r[0])
    for t in terms:
        low = t.strip(" ").lower()
        found = sorted([r for r in rows if low in str(r[0]) or low in (r[1] or "").lower()], key=place)
        assert got.get(t, []) == [(r[0], r[1]) for r in found[:5]], t


def test_search_has_no_cross_join(spark):
    products = spark.createDataFrame([(1, "abc def", "t")], "ean long, descripcion string, packaging_type_id string")
    plan = catalog.search_products(products, spark.createDataFrame([("abcd",), ("a",), ("",)], "busqueda string"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_updating_a_product_leaves_the_others(spark, tmp_path):
    schema = "ean string, ref_id long, categoria string, embedding array<float>"
    rows = [("A", 1, "lata", [1.0]), ("B", 2, "lata", [2.0]), ("C", 3, "bolsa", [3.0]), ("D", 4, "caja", [4.0])]
    path = str(tmp_path / "refs")
    stores.write_refs(spark.createDataFrame(rows, schema), path)
    stored = lambda: {(r.ean, r.ref_id, r.categoria) for r in stores.read_refs(spark, path).collect()}
    stores.update_refs(spark.createDataFrame([("A", 7, "lata", [9.0]), ("A", 8, "lata", [9.0])], schema), path)
    assert stored() == {("A", 7, "lata"), ("A", 8, "lata"), ("B", 2, "lata"), ("C", 3, "bolsa"), ("D", 4, "caja")}
    # The only product of a category moves to another one, and a new one comes.
    stores.update_refs(spark.createDataFrame([("C", 5, "lata", [1.0]), ("E", 6, "tubo", [1.0])], schema), path)
    assert stored() == {("A", 7, "lata"), ("A", 8, "lata"), ("B", 2, "lata"), ("C", 5, "lata"), ("D", 4, "caja"), ("E", 6, "tubo")}
    assert stores.read_refs(spark, path, ["bolsa"]).count() == 0


def sequential_harvest(rows, per_ean):
    seen, saved, tried = set(), [], {}
    for ean in sorted({r[1] for r in rows}):
        n = 0
        tried[ean] = 0
        for seq, _, sha, ok in sorted(r for r in rows if r[1] == ean):
            if n >= per_ean:
                break
            tried[ean] += 1
            if not ok or sha in seen:
                continue
            seen.add(sha)
            n += 1
            saved.append((ean, seq, f"{ean}__{n:03d}.png"))
    return set(saved), tried


def test_harvest_equals_serving_products_in_order(spark):
    rnd = random.Random(4)
    rows = [(i, i % 7, f"h{rnd.randrange(30)}", rnd.random() < 0.8) for i in range(160)]
    images = spark.createDataFrame(rows, "seq long, ean long, sha256 string, ok boolean").select(
        "seq", "ean", "sha256", F.lit("http://x").alias("url"), F.lit(60_000).alias("bytes"),
        F.when(F.col("ok"), "image/png").otherwise("text/html").alias("content_type"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
    )
    saved, rejected, counters = harvest.harvest(images, per_ean=4)
    want, tried = sequential_harvest(rows, 4)
    assert {(r.ean, r.seq, r.archivo) for r in saved.collect()} == want
    assert {r.ean: r.intentadas for r in counters.collect()} == tried
    assert rejected.count() == sum(1 for r in rows if not r[3] and sum(1 for q in rows if q[1] == r[1] and q[0] <= r[0]) <= tried[r[1]])


def test_harvest_in_shuffled_order_is_repeatable(spark):
    images = spark.range(40).selectExpr(
        "id as seq", "id % 2 as ean", "cast(id as string) as sha256", "concat('http://x/', id) as url", "60000 as bytes",
        "'image/png' as content_type", "cast(null as int) as width", "cast(null as int) as height",
    )
    take = lambda seed: {r.url for r in harvest.harvest(images, per_ean=5, seed=seed)[0].collect()}
    assert len(take(1)) == 10 and take(1) == take(1) != take(2)
    assert harvest.harvest(images, per_ean=5, dedupe=False)[0].count() == 10


def test_image_checks_at_the_limits(spark):
    rows = [("image/png", 49_999, 300, 300), ("IMAGE/PNG", 50_000, 300, 300), ("image/png", 50_000, 299, 300), ("image/png", 50_000, None, 300), (None, 60_000, 300, 300)]
    df = spark.createDataFrame(rows, "content_type string, bytes long, width int, height int")
    got = [r.motivo for r in harvest.validated(df).collect()]
    assert got == ["too_small_bytes", "ok", "too_small_resolution", "ok_no_dims", "content_type_not_image"]


def test_candidate_urls(spark):
    tile = lambda u: f"<a class=\"iusc\" href=\"#\" m=\"{{&quot;murl&quot;:&quot;{u}&quot;,&quot;t&quot;:1}}\">x</a>"
    html = tile("http://a/1?x=1&amp;y=2") + tile("ftp://no") + tile("http://a/1?x=1&amp;y=2") + '<img class="m" src="http://b/2"><img data-src="http://b/3">'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    urls = lambda n: [r.url for r in harvest.candidate_urls(pages, limit=n).orderBy("pos").collect()]
    assert urls(80) == ["http://a/1?x=1&y=2", "http://b/2", "http://b/3"]
    assert urls(3) == ["http://a/1?x=1&y=2", "http://b/2"]
    assert urls(2) == ["http://a/1?x=1&y=2"] * 2


def test_image_source_attributes(spark):
    """src before data-src wherever they stand, an empty src counts as none, both quote styles, any case."""
    cases = {
        "<img src='http://a/1.jpg'>": ["http://a/1.jpg"],
        '<img data-src="http://b/1" src="http://c/1">': ["http://c/1"],
        '<img src="http://d/1" data-src="http://e/1">': ["http://d/1"],
        "<IMG DATA-SRC='http://f/1' alt=x>": ["http://f/1"],
        '<img src="" data-src="http://g/1">': ["http://g/1"],
        "<img alt='src' class=\"x\" src = 'http://h/1'><img src='ftp://i'><img>": ["http://h/1"],
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")
    got = {}
    for r in harvest.candidate_urls(pages).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.url)
    assert [got.get(i, []) for i in range(len(cases))] == list(cases.values())


def test_target_names_chain(spark):
    rows = [(1, "A", "f_1"), (2, "A", "f_1"), (3, "A", "f_1"), (4, "B", "f_1")]
    got = {r.seq: r.destino for r in absorb.target_names(spark.createDataFrame(rows, "seq long, ean string, crop_id string")).collect()}
    assert got == {1: "f-1.jpg", 2: "f-1_abs1.jpg", 3: "f-1_abs1_abs2.jpg", 4: "f-1.jpg"}


def test_frame_rules(spark):
    frames = spark.createDataFrame([(1, i, 2.5) for i in range(6)] + [(2, i, 0.0) for i in range(31)], "video_id long, frame_idx long, fps double")
    got = {(r.video_id, r.frame_idx): (r.out_idx, r.t_sec) for r in video.sample_frames(frames, 1.0).collect()}
    assert got == {(1, 0): (0, 0.0), (1, 2): (1, 0.8), (1, 4): (2, 1.6), (2, 0): (0, 0.0), (2, 30): (1, 1.0)}
    rows = [(1, i, 25.0, 99.9 if i == 25 else 100.0) for i in range(0, 76, 25)]
    listed = video.export_list(spark.createDataFrame(rows, "video_id long, idx long, fps double, sharpness double"), 1.0)
    assert [r.archivo for r in listed.orderBy("idx").collect()] == ["frame_0000_t0.00s.jpg", "frame_0001_t2.00s.jpg", "frame_0002_t3.00s.jpg"]


def test_run_detail_is_nested_and_ordered(spark):
    r = spark.createDataFrame([(1, "V"), (2, "W")], "id long, video_nombre string")
    items = spark.createDataFrame([(1, "A", 1, 2, 0.5, None), (1, "B", 9, 9, 0.5, 3)], "ejecucion_id long, ean string, cantidad_dedup int, cantidad_raw int, confianza_promedio double, tracking_id int")
    products = spark.createDataFrame([("A", "a", "lata"), ("B", "b", "lata")], "ean string, descripcion string, packaging_type_id string")
    one = runs.run_detail(1, r, items, products).first()
    assert [d.ean for d in one.detecciones] == ["B", "A"] and runs.run_detail(2, r, items, products).first().detecciones is None


def test_search_ranks_few_products_in_a_task(spark, monkeypatch):
    from stockcount.operators import catalog

    monkeypatch.setattr(catalog, "TASK_PRODUCTS", 10)
    products = spark.createDataFrame([("t", f"thing {i:02d}", i) for i in range(45)], "packaging_type_id string, descripcion string, ean long").coalesce(1)
    terms = spark.createDataFrame([("thing",), ("",), ("4",)], "busqueda string")
    out = catalog.search_products(products, terms, 3)
    got = sorted((r.busqueda, r["rank"], r.ean) for r in out.collect())
    assert got == [("", 1, 0), ("", 2, 1), ("", 3, 2), ("4", 1, 4), ("4", 2, 14), ("4", 3, 24), ("thing", 1, 0), ("thing", 2, 1), ("thing", 3, 2)]
    # One task held all products before.
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()


def test_a_delivery_is_combined_in_tasks_of_few_rows(spark, monkeypatch):
    from stockcount.operators import running

    items = spark.createDataFrame([(i % 7, i % 5, 0.5) for i in range(45)], "ean long, cantidad_dedup int, confianza_promedio double").coalesce(1)
    whole = sorted(tuple(r) for r in running.partials(items).collect())
    monkeypatch.setattr(running, "TASK_ROWS", 10)
    out = running.partials(items)
    assert sorted(tuple(r) for r in out.collect()) == whole and len(whole) == 7
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()


def test_absorbing_leaves_the_product_table_in_place(spark, tmp_path, capsys):
    """Only products of the crops are joined: the table may be small as files and still too large to broadcast."""
    place = str(tmp_path / "catalogo")
    rows = [(str(n), "lata", f"Producto {n}") for n in range(50)] + [("3", "bolsa", "Otro 3")]
    spark.createDataFrame(rows, "ean string, categoria string, descripcion string").write.parquet(place)
    products = spark.read.parquet(place)
    crops = [(1, "3", 1, True, [1.0, 0.0]), (2, "3", 2, True, [1.0, 0.01]), (3, "4", 3, True, None), (4, "99", 4, True, [0.0, 1.0]), (5, "5", 5, False, [0.0, 1.0])]
    crops = spark.createDataFrame(crops, "crop_id long, ean string, seq long, existe boolean, embedding array<float>")
    refs = [("r1", "3", [0.0, 1.0], "sin"), ("r2", "5", [1.0, 0.0], "sin"), ("r3", None, [1.0, 0.0], "sin")]
    refs = spark.createDataFrame(refs, "ref_id string, ean string, embedding array<float>, categoria string")
    result = absorb.outcomes(crops, refs, products.select("ean"))
    grown, applied = absorb.apply(crops, refs, products, products.select("ean"))
    capsys.readouterr()
    result.explain()
    grown.explain()
    assert "FileScan" not in capsys.readouterr().out
    expected = {(1, absorb.COPIED), (2, absorb.DUPLICATE), (3, absorb.COPIED), (4, absorb.INVALID), (5, absorb.MISSING)}
    assert {(r.crop_id, r.resultado) for r in result.collect()} == {(r.crop_id, r.resultado) for r in applied.collect()} == expected
    assert sorted((r.ref_id, r.ean, r.categoria, r.descripcion) for r in grown.fillna("-").collect()) == [
        ("crop-1", "3", "bolsa", "Otro 3"), ("crop-1", "3", "lata", "Producto 3"), ("r1", "3", "bolsa", "Otro 3"),
        ("r1", "3", "lata", "Producto 3"), ("r2", "5", "sin", "-"), ("r3", "-", "sin", "-"),
    ]
