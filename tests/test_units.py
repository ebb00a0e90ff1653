"""Decoders, pixel functions and splits on small cases, against NumPy."""

import gzip
import io
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicework.functions import names as n
from slicework.functions import pixels as px
from slicework.functions.kernels import _linear
from slicework.operators import pairs, segmentation, splits, summaries
from slicework.operators.quantiles import quantiles
from slicework.sources import files, sinks, tables
from slicework.streaming.ingest import keep_recent, live_metrics


def png(path, a):
    h, w = a.shape
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def nifti(data, zooms, code=16):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<h", head, 70, code)
    struct.pack_into("<8f", head, 76, 1, *zooms, 1, 1, 1, 1)
    struct.pack_into("<f", head, 108, 352)
    return gzip.compress(bytes(head) + data.astype("<f4").tobytes(order="F"))


def test_volumes(spark, tmp_path):
    a = np.arange(24.0).reshape(2, 3, 4)
    (tmp_path / "a.nii.gz").write_bytes(nifti(a, (1, 2, 3)))
    (tmp_path / "b.nii.gz").write_bytes(nifti(np.stack([a, a + 2], -1), (1, 2, 3)))
    (tmp_path / "c.nii.gz").write_bytes(b"broken")
    (tmp_path / "rgb.nii.gz").write_bytes(nifti(a, (1, 1, 1), code=128))
    rows = {r.path.split("/")[-1]: r for r in files.read_volumes(spark, str(tmp_path)).collect()}
    assert rows["a.nii.gz"].voxels == a.ravel().tolist() and rows["a.nii.gz"].dz == 3
    assert rows["b.nii.gz"].voxels == (a + 1).ravel().tolist()
    assert rows["c.nii.gz"].error and rows["c.nii.gz"].nx is None
    assert sum(bool(r.error) for r in rows.values()) == 2
    head = files.read_volumes(spark, str(tmp_path), header_only=True).where("path like '%/a.nii.gz'").first()
    assert (head.nx, head.ny, head.nz, head.voxels) == (2, 3, 4, None)
    assert tables.scan_volumes(spark, str(tmp_path)).count() == 4
    v = files.read_volumes(spark, str(tmp_path)).where("path like '%/a.nii.gz'").withColumn("plane", F.lit("isotropic"))
    got = {(r.slice_plane, r.slice_idx): r.px for r in px.plane_slice(v).collect()}
    assert got["axial", 1] == a[:, :, 1].T.ravel().tolist() and got["sagittal", 1] == a[1].T.ravel().tolist()


def test_bundles_and_images(spark, tmp_path):
    b = io.BytesIO()
    np.savez(b, slice=np.ones((2, 3), "f4"), mask=np.eye(2, dtype="u1"))
    (tmp_path / "x.npz").write_bytes(b.getvalue())
    (tmp_path / "y.npz").write_bytes(b"no")
    rows = {r.path[-5:]: r for r in files.read_array_bundles(spark, str(tmp_path), ["slice", "tokens"]).collect()}
    assert rows["x.npz"].slice_shape == [2, 3] and rows["x.npz"].tokens is None and rows["y.npz"].error
    image = np.arange(12, dtype="u1").reshape(3, 4) * 20
    (tmp_path / "i").mkdir()
    png(tmp_path / "i" / "p.png", image)
    (tmp_path / "i" / "q.png").write_bytes(b"broken")
    r = files.read_images(spark, str(tmp_path / "i")).orderBy("path").collect()
    assert (r[0].h, r[0].w, r[0].px, r[0].error) == (3, 4, image.ravel().tolist(), None) and r[1].error and r[1].px is None and len(r) == 2


def one(spark, column, **values):
    kinds = {k: "array<double>" if isinstance(v, list) else "int" for k, v in values.items()}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return df.select(column.alias("x")).first().x


def test_pixels(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=40)
    lo, hi = np.percentile(a, [0.5, 99.5])
    want = np.floor(255 * np.clip((a - lo) / (hi - lo), 0, 1) + 0.5).astype(int).tolist()
    assert one(spark, px.to_uint8(F.col("a")), a=a.tolist()) == want
    assert one(spark, px.to_uint8(F.col("a")), a=[3.0] * 4) == [0] * 4
    assert one(spark, px.to_uint8(F.col("a")), a=[1.0, float("nan"), 2.0])[0] == 0
    assert one(spark, px.labels_to_uint8(F.col("a")), a=[0.5, 1.5, -3.0, 300.0, float("nan"), float("inf")]) == [0, 2, 0, 255, 0, 0]
    assert one(spark, px.argmax(F.col("a")), a=[1.0, 3.0, 3.0]) == 1
    assert np.allclose(one(spark, px.zscore(F.col("a"), ddof=1), a=a.tolist()), (a - a.mean()) / (a.std(ddof=1) + 1e-6))
    assert one(spark, px.sliding_positions(F.col("n"), 4, 1), n=8) == [0, 3, 4] and one(spark, px.sliding_positions(F.col("n"), 4, 1), n=4) == [0]
    with pytest.raises(ValueError):
        px.overlap_px(10, 100)
    image = np.arange(12.0)
    got = one(spark, px.pad_centred(F.col("a"), F.lit(3), F.lit(4), 5, 5), a=image.tolist())
    assert got == np.pad(image.reshape(3, 4), ((1, 1), (0, 1))).ravel().tolist()
    assert _linear(np.zeros((4, 4)), 2).sum() == 0 and _linear(np.eye(8), 2).any()


def test_tiles_round_trip(spark):
    image = np.arange(70.0)
    df = spark.createDataFrame([(1, 7, 10, image.tolist())], "id int, h int, w int, px array<double>")
    tiles = px.tile_explode(df, tile=4, overlap_pct=25, threshold=6)
    assert {len(r.px) for r in tiles.collect()} == {16}
    size = df.select("id", F.col("h").alias("height"), F.col("w").alias("width"))
    assert segmentation.stitch(tiles, "id", size).first().px == image.tolist()
    assert px.tile_explode(df, tile=4, threshold=100).first().px == image.tolist()


def test_empty_masks(spark):
    df = spark.createDataFrame([(0, [0] * 9, [0] * 9), (1, [0] * 9, [1] + [0] * 8), (2, [1] * 9, [1] * 9)], "image_id int, gt_px array<int>, pred_px array<int>")
    df = df.withColumns({"h": F.lit(3), "w": F.lit(3)})
    got = {r.image_id: r.hd95 for r in segmentation.hausdorff95(df).collect()}
    assert got == {0: 0.0, 1: None, 2: 0.0}
    assert segmentation.seg_metrics(df).where("image_id = 0").first().dice == 1.0


def test_names(spark):
    names = ["a__b__axial__s0003__t001__sp0500x1200.png", "é+x", "a__SAGITTAL__s00003__t0001__sp500x500__2.tif", "a__axial__s0003__sp0500x0500.png", "a__axial__s0003__t001__sp0500x12000.png"]
    df = spark.createDataFrame([(x,) for x in names], "s string")
    rows = df.select(n.parse_slice_name(F.col("s")).alias("p"), n.parse_spacing(F.col("s")).alias("m"), n.sanitize_token(F.col("s")).alias("t")).collect()
    assert tuple(rows[0].p) == ("axial", 3, 1, 500, 1200, None) and rows[0].m.w == 1.2 and rows[1].t == "é-x"
    assert tuple(rows[2].p) == ("SAGITTAL", 3, 1, 500, 500, 2) and [rows[i].p.plane for i in (1, 3, 4)] == [None] * 3
    assert df.select(n.hash_split(F.col("s"), 1, 0.5, "exact")).distinct().count() >= 1


def test_logs(spark):
    line = "2024-01-15 14:23:45 Total Loss: -2.5E+1\tLR: 1.5e-05\tval/top-1 acc: 3\tLR: 2e-6\tMemory: 1/2\tITERATION: 7 / 100"
    df = spark.createDataFrame([("r", 1, line)], "run string, line_no int, line string")
    rows = n.parse_log_kv(df).collect()
    assert {r.key: r.value for r in rows} == {"Total Loss": -25.0, "LR": 2e-6, "val/top-1 acc": 3.0, "ITERATION": 7.0} and len(rows) == 4
    assert {(r.iter, str(r.ts)) for r in rows} == {(7, "2024-01-15 14:23:45")}


def test_splits_and_joins(spark):
    ids = spark.range(103).withColumn("k", F.col("id") % 3)
    assert splits.stratified_split(ids, "k", "id").where("side = 'val'").groupBy("k").count().collect()[0]["count"] == 5
    m = splits.epoch_manifest(ids, "id", 206, 0, 1, 4)
    assert m.groupBy("id").count().where("count <> 2").count() == 0 and m.count() == 206
    assert splits.weighted_sample(ids, "id", "k", 500).where("id % 3 = 0").count() == 0
    assert splits.weighted_sample(ids, "id", "k", 500).count() == 500
    with pytest.raises(KeyError):
        pairs.lookup_features(ids.withColumn("path", F.col("id")), ids.where("id > 5").select(F.col("id").alias("path")))
    with pytest.raises(Exception, match="duplicate keys"):
        summaries.assert_unique(ids, ["k"]).collect()
    assert summaries.assert_unique(ids, ["id"]).count() == 103
    with pytest.raises(ValueError, match="no fold column"):
        tables.folds(spark.createDataFrame([("a", "0")], "subject_id string, is_test string"), "x")


def test_file_tables(spark, tmp_path):
    for f in ("b/1.png", "a/2.png", "a/tmp3.png", "a/x.txt"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    got = {r.path: r.target for r in tables.read_class_folder(spark, str(tmp_path)).collect()}
    assert got == {"a/2.png": 0, "b/1.png": 1}
    (tmp_path / "folds.json").write_text('[{"train":["a","b"],"val":["c"]},{"train":[],"val":["a"]}]')
    rows = sorted((r.fold, r.split, r.id) for r in tables.read_fold_list(spark, str(tmp_path / "folds.json")).collect())
    assert rows == [(0, "train", "a"), (0, "train", "b"), (0, "val", "c"), (1, "val", "a")]
    (tmp_path / "x_label.json").write_text('{"PathologySeverity":"Severe"}')
    assert tables.read_sidecars(spark, str(tmp_path)).first().path.endswith("x_label.nii.gz")
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "h.json").write_text('{"mode":"a","v":1}\n{bad\n{"mode":"b","v":2}')
    assert [r.v for r in tables.read_result_history(spark, str(tmp_path / "r"), "a", "mode string, v int").collect()] == [1]


def test_named_files(spark, tmp_path):
    from slicework.sources.named import write_files

    root = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"d{i % 3}/n{i}.txt", f"text {i}".encode()) for i in range(40)], "path string, content binary").repartition(4)
    write_files(rows, root)
    assert (tmp_path / "out/_SUCCESS").read_text() == "40" and not list((tmp_path / "out/_temporary").glob("*"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").glob("d*/*")} == {f"n{i}.txt": f"text {i}".encode() for i in range(40)}
    write_files(rows, root)  # the same bytes are no error, as when a task runs again
    other = spark.createDataFrame([("d0/n0.txt", b"other"), ("new.txt", b"new")], "path string, content binary").coalesce(1)
    with pytest.raises(Exception, match="exists with other bytes"):
        write_files(other, root)
    assert (tmp_path / "out/d0/n0.txt").read_bytes() == b"text 0" and not (tmp_path / "out/new.txt").exists()
    write_files(other, root, overwrite=True)
    assert (tmp_path / "out/d0/n0.txt").read_bytes() == b"other" and (tmp_path / "out/new.txt").exists()
    for bad in ("../x", "/x", "a//b", "_x", None, ".hidden/x"):
        with pytest.raises(Exception, match="not a name"):
            write_files(spark.createDataFrame([("fine", b"1"), (bad, b"2")], "path string, content binary").coalesce(1), root + "2")
    assert not (tmp_path / "out2/fine").exists()


def test_class_folder_errors(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"1")
    with pytest.raises(ValueError, match="no class folders"):
        tables.read_class_folder(spark, str(tmp_path))
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.txt").write_bytes(b"1")
    with pytest.raises(ValueError, match="no images"):
        tables.read_class_folder(spark, str(tmp_path))
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.WebP").write_bytes(b"1")
    assert [(r.class_name, r.target) for r in tables.read_class_folder(spark, str(tmp_path)).collect()] == [("c", 1)]


def test_history_csv(spark, tmp_path):
    (tmp_path / "h.csv").write_text("mode,step,value\nrun,1,0.5\nother,2,1\nrun,x,3\nrun,4,2\n")
    rows = tables.read_result_history(spark, str(tmp_path), "run", "mode string, step int, value double", "csv").collect()
    assert [(r.step, r.value) for r in rows] == [(1, 0.5), (4, 2.0)]


def test_pending_rows_only(spark):
    from slicework.operators.learn import batch_infer, mean_and_max

    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(100).selectExpr("id", "array(cast(id as float), 2F, 3F, 4F) as x", "if(id % 10 = 0, null, array(9F, 9F)) as tokens", "if(id % 10 = 5, null, array(9F)) as cls")
    outputs = {"tokens": "array<float>", "cls": "array<float>"}
    got = {r.id: (r.tokens, r.cls) for r in batch_infer(rows, mean_and_max(seen), "x", [4], outputs).collect()}
    assert seen.value == 20
    assert got[1] == ([9.0, 9.0], [9.0]) and got[10] == ([6.0, 3.5], [10.0]) and got[5] == ([3.5, 3.5], [5.0]) and len(got) == 100
    assert batch_infer(rows, mean_and_max(seen), "x", [4], outputs, pending_only=False).where("id = 1").first().cls == [4.0]
    assert batch_infer(rows.drop("cls"), mean_and_max(), "x", [4], outputs).where("cls[0] >= 4").count() == 100


def test_feature_transform():
    from slicework.functions.kernels import _edge, feature_transform

    draw = np.random.default_rng(3)
    for h, w, share in [(1, 1, 1.0), (1, 9, 0.3), (9, 1, 0.4), (12, 17, 0.05), (30, 20, 0.3), (40, 40, 0.9), (25, 31, 0.01)]:
        a, b = draw.random((h, w)) < max(share, 0.2), draw.random((h, w)) < share
        b[draw.integers(h), draw.integers(w)] = True
        y, x, ny, nx = feature_transform(_edge(a), b)
        on = np.argwhere(b)
        want = ((np.stack([y, x], 1)[:, None] - on[None]) ** 2).sum(-1).min(1)
        assert b[ny, nx].all() and ((y - ny) ** 2 + (x - nx) ** 2 == want).all()


def test_resize_mask_large(spark):
    draw = np.random.default_rng(1)
    masks = [draw.random((512, 512)) < 0.4, np.zeros((3, 5)), np.ones((2, 2))]
    rows = spark.createDataFrame([(i, m.astype(int).ravel().tolist(), *m.shape) for i, m in enumerate(masks)] + [(3, None, 2, 2)], "i int, m array<int>, h int, w int")
    got = {r.i: r.g for r in rows.select("i", px.resize_mask(F.col("m"), F.col("h"), F.col("w"), 224).alias("g")).collect()}
    for i, m in enumerate(masks):
        want = np.zeros((224, 224), int)
        for y, x in np.argwhere(m):
            want[min(int(y * 224 / m.shape[0]), 223), min(int(x * 224 / m.shape[1]), 223)] = 1
        assert got[i] == want.ravel().tolist()
    assert got[3] is None


def test_auc_in_ranges(spark):
    from slicework.operators import evaluation as ev

    draw = np.random.default_rng(2)
    z = np.round(draw.normal(size=(3000, 3)), 1) * np.array([1, 1e-6, 5])
    rows = spark.createDataFrame([(int(i % 2), int(draw.integers(3)), v.tolist()) for i, v in enumerate(z)], "g int, y int, logits array<double>")
    tied = rows.select("g", "y", F.posexplode("logits").alias("class", "s")).groupBy("g", "class", "s").agg(F.sum((F.col("y") == F.col("class")).cast("long")).alias("pos"), F.count("*").alias("n"))
    one, many = ({r.g: (r.auc_macro, r.auc_weighted) for r in ev._auc_of_weighted(tied, ["g"], k).collect()} for k in (1, 16))
    assert len(one) == 2 and all(one[g] == pytest.approx(many[g]) for g in one)


def test_heads(spark):
    from slicework.operators import learn

    draw = np.random.default_rng(4)
    centres = np.array([[2, 0, 0], [0, 2, 0], [0, 0, 2.0]])
    rows = [(int(y), (centres[y] + draw.normal(size=3)).tolist()) for y in draw.integers(0, 3, 900)]
    df = spark.createDataFrame(rows, "target int, features array<double>").repartition(3)
    train, val = df.where("features[0] * 1000 % 1 < 0.7"), df.where("features[0] * 1000 % 1 >= 0.7")
    trials = [{"lr": 0.2, "reg": 0.0}, {"lr": 0.2, "reg": 50.0}, {"lr": 1e-6, "reg": 0.0}]
    heads = learn.fit_heads(train, val, trials, steps=40)
    assert len(heads) == 3 and heads[0].params["loss"] < 0.65 < heads[1].params["loss"] and heads[2].params["loss"] == pytest.approx(np.log(3), abs=1e-3)
    assert learn.fit_heads(train, val, trials[:1], steps=40)[0].params["loss"] == pytest.approx(heads[0].params["loss"])
    best, table = learn.random_search(train, val, trials=3, metric="accuracy", steps=20)
    assert max(r["accuracy"] for r in table) > 0.75
    accuracy = learn.ev.evaluate(best.predict(val).withColumn("g", F.lit(1)), ["g"]).first().accuracy
    assert accuracy > 0.75 and best.weights.shape == (3, 3)
    reference = learn.ev.evaluate(learn.predict(learn.fit_linear_head(train, 0.0), val).withColumn("g", F.lit(1)), ["g"]).first()
    assert abs(reference.cross_entropy - heads[0].params["loss"]) < 0.03


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    groups = {
        "a": rng.normal(size=3001), "b": np.array([5.0]), "c": np.repeat([1.5, -2.5, 7.0], [700, 300, 2]), None: np.array([-1e300, 1e-300, -0.0, 0.0, 3.0, -1e-9]),
        "d": 1.0 + np.arange(1000) * 2.0**-52, "e": np.array([-np.inf, 1.0, 2.0, np.inf]),
    }
    rows = [(g, 1, float(v)) for g, vs in groups.items() for v in vs] + [("a", 1, None), ("none", 1, None), ("nan", 1, math.nan), ("nan", 1, 1.0)]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g string, n int, v double")
    got = {r.g: r for r in quantiles(df.withColumn("size", F.lit("x")).repartition(5), ["g", "n"], "v", probs).collect()}
    assert set(got) == {*groups, "nan"} and got["nan"].q[0] == 1.0 and got["nan"].q[-1] is None
    for g, vs in groups.items():
        if g != "e":
            assert np.allclose(got[g].q, np.quantile(vs, probs), rtol=1e-15, atol=0) and got[g].q[0] == min(vs) and got[g].q[-1] == max(vs)
    assert got["e"].q[0] == -math.inf and got["e"].q[2] == 1.5
    assert quantiles(df, [], "v", [0.5]).count() == 1 and quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    plan = segmentation.summarise(df, ["v"], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_summary_keeps_rows_without_subject(spark):
    df = spark.createDataFrame([(None, 1.0, True), (1, 3.0, False), (1, 5.0, True)], "subject long, dice double, has_fg boolean")
    rows = [(r.subset, r.subject, r.n, r.median) for r in segmentation.summary_by(df, "subject", ["dice"]).collect()]
    assert sorted(rows, key=str) == sorted([("all", None, 3, 3.0), ("all", None, 1, 1.0), ("all", 1, 2, 4.0), ("foreground", None, 2, 3.0), ("foreground", None, 1, 1.0), ("foreground", 1, 1, 5.0)], key=str)


def test_stitch_large(spark):
    rng = np.random.default_rng(5)
    total, count = np.zeros((512, 500)), np.zeros((512, 500))
    tiles = []
    for y in range(-16, 512, 96):
        for x in range(0, 500, 120):
            px = rng.integers(0, 9, (128, 160)).astype(float)
            tiles.append((1, y, x, 160, px.ravel().tolist()))
            inside = px[max(0, -y) : 512 - y, : 500 - x]
            total[max(0, y) : y + 128, x : x + 160] += inside
            count[max(0, y) : y + 128, x : x + 160] += 1
    tiles.append((2, 1, 1, 2, [4.0, 6.0]))
    df = spark.createDataFrame(tiles, "id int, y0 int, x0 int, w int, px array<double>").repartition(6)
    size = spark.createDataFrame([(1, 512, 500), (2, 2, 3)], "id int, height int, width int")
    for block in (64, 200):
        got = {r.id: r.px for r in segmentation.stitch(df, "id", size, block).collect()}
        assert count.min() > 0 and np.allclose(np.array(got[1]).reshape(512, 500), total / count)
        assert got[2] == [None, None, None, None, 4.0, 6.0]


def test_predictions_of_a_tree(spark, tmp_path):
    one = spark.createDataFrame([("a", 1, [0.5]), ("b", 0, [0.1])], "sample string, y int, logits array<double>")
    for folder, rows in (("a/b/x", one), ("c/x", one.withColumn("split", F.lit("val"))), ("d/run=3/task=s%20s", one.limit(1))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/tree/{folder}")
    got = tables.read_predictions(spark, f"{tmp_path}/tree")
    assert sorted((r.run_dir, r.run, r.task, r.split, r.sample) for r in got.collect() if r.sample == "a") == [("a/b/x", None, None, None, "a"), ("c/x", None, None, "val", "a"), ("d/run=3/task=s%20s", 3, "s s", None, "a")]
    assert got.count() == 5 and tables.read_predictions(spark, f"{tmp_path}/tree/", "val").count() == 2
    sinks.write_predictions(one.withColumns({"task": F.lit("t+ :%/u"), "run": F.lit(7), "split": F.lit("test")}), f"{tmp_path}/out")
    assert {(r.task, r.run, r.split) for r in tables.read_predictions(spark, f"{tmp_path}/out", "test").collect()} == {("t+ :%/u", 7, "test")}
    (tmp_path / "none").mkdir()
    for path in ("none", "missing"):
        with pytest.raises(FileNotFoundError):
            tables.read_predictions(spark, f"{tmp_path}/{path}")


def test_recent_hours(spark, tmp_path):
    """Old hours leave the snapshot as new ones close, over two runs of the stream; a run without news changes nothing."""
    import datetime

    at = lambda h: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(hours=h)
    schema = "ts timestamp, run string, value double"

    def run(hours):
        if hours:
            spark.createDataFrame([(at(h), r, float(h)) for h in hours for r in ("x", "y")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live_metrics(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        keep_recent(stream, f"{tmp_path}/out", f"{tmp_path}/mark", 3).awaitTermination()
        rows = sinks.read_snapshot(spark, f"{tmp_path}/out").collect()
        assert len({(r.start, r.run) for r in rows}) == len(rows)
        return sorted({r["mean"] for r in rows}), len(rows)

    # an hour is closed ten minutes after its end: with rows of 6:00 the newest one is that of 4:00
    assert run([0, 1, 2, 3, 4, 5, 6]) == ([1.0, 2.0, 3.0, 4.0], 8)
    assert run([7, 9]) == ([4.0, 5.0, 6.0, 7.0], 8)
    assert run([]) == ([4.0, 5.0, 6.0, 7.0], 8)
    assert run([14]) == ([6.0, 7.0, 9.0], 6)


def test_list_files_by_tasks(spark, tmp_path):
    """Every depth, empty files, hidden names, odd characters and globs; and no list of files in the plan of the driver."""
    names = ["a.png", "b/c.png", "b/d e%.txt", "b/c/d/e.png", "b/x=1/y.png", "_x=1/z.png", "b/empty.png"]
    for f in [*names, "_hidden/a.png", ".b/a.png", "b/_no.png", "b/.no.png"]:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"" if "empty" in f else b"xy")
    (tmp_path / "b/folder").mkdir()
    (tmp_path / "b/nothing").symlink_to("gone")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        listed = tables.list_files(spark, root)
        assert {(r.path, r.size) for r in listed.collect()} == {(n, 0 if "empty" in n else 2) for n in names} and listed.count() == len(names)
        assert not listed.inputFiles()
    assert {r.path for r in tables.list_files(spark, str(tmp_path), "{a,c}.p?g").collect()} == {"a.png", "b/c.png"}
    assert [r.path for r in tables.list_files(spark, str(tmp_path / "a.png")).collect()] == [""]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.list_files(spark, str(tmp_path / "none"))


def test_stream_files_in_order_of_time(spark, tmp_path):
    """Files of earlier hours are older, whatever the order in which tasks end; few times and no rows are no error."""
    import os
    import time

    from slicework.plans import storage

    class T:
        pass

    t = T()
    t.spark = spark
    slow = F.udf(lambda day: time.sleep(3 if day == 0 else 0) or day, "int")  # the task of the first range ends last
    times = spark.range(0, 800, 1, 1).select(F.timestamp_seconds(F.col("id") * 900).alias("ts"), F.col("id").cast("int").alias("day"))
    for rows, n in ((times, 800), (times.where("day < 2"), 2), (times.where("day < 0"), 0)):
        t.events = rows
        write = storage._as_stream(t, rows.schema) if n < 800 else None
        if write is None:
            ranged = rows.repartitionByRange
            rows.repartitionByRange = lambda *a: ranged(*a).withColumn("day", slow(F.when(F.col("day") == 0, 0).otherwise(1)))
            write = storage._as_stream(t, rows.schema)
        files = spark.read.schema(rows.schema).parquet(write._jdf.queryExecution().analyzed().collectLeaves().head().dataSource().options().apply("path"))
        assert files.count() == n
        spans = sorted((os.stat(r.f.removeprefix("file://")).st_mtime_ns, r.a, r.b) for r in files.groupBy(F.input_file_name().alias("f")).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect())
        assert all(x[2] <= y[1] for x, y in zip(spans, spans[1:]))


def test_small_files_share_batches(spark):
    """Decoded files come in few batches, in their order, with errors between them; a large one comes alone."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<h", head, 70, 16)
    struct.pack_into("<8f", head, 76, 1, 1, 1, 1, 1, 1, 1, 1)
    struct.pack_into("<f", head, 108, 352)

    def volume(*shape):
        own = bytearray(head)
        struct.pack_into("<8h", own, 40, 3, *shape, 1, 1, 1, 1)
        return bytes(own) + np.arange(np.prod(shape), dtype="<f4").tobytes()

    made = [(f"v{i:03}", b"broken" if i % 50 == 7 else volume(1 + i % 3, 2, 2)) for i in range(300)] + [("w0", volume(80, 80, 80)), ("w1", volume(1, 1, 2))]
    src = spark.createDataFrame(made, "path string, content binary").coalesce(1)
    out = files.decode_volumes(src)
    count = lambda df: df.mapInArrow(lambda bs: (__import__("pyarrow").RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").count()
    rows = out.collect()
    assert [r.path for r in rows] == [p for p, _ in made] and [bool(r.error) for r in rows] == [c == b"broken" for _, c in made]
    assert all(r.voxels == np.arange(r.nx * r.ny * r.nz).reshape((r.nx, r.ny, r.nz), order="F").ravel().tolist() for r in rows if not r.error) and rows[-2].nx == 80
    assert len(list(files._gathered(({"n": x} for x in [1] * 300 + [1 << 20, 1]), lambda r: r["n"]))) == 2
    assert count(out) < 20


def test_names_are_dealt_before_they_are_made(spark):
    from slicework.operators.volumes import predict_manifest

    v = spark.range(0, 100, 1, 1).selectExpr("concat('d/v', id, '.nii.gz') path", "2 nx", "2 ny", "3 nz", "1D dx", "1D dy", "1D dz", "'axial' plane")
    plan = predict_manifest(v)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")
    assert predict_manifest(v).count() == 300


def test_class_folder_lists_once(spark, tmp_path):
    for f in ("b/1.png", "a/2.png", "c/3.txt"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    found = tables.read_class_folder(spark, str(tmp_path))
    (tmp_path / "a0").mkdir()
    (tmp_path / "a0/4.png").write_bytes(b"x")  # too late to be seen, in part or whole
    assert {r.path: r.target for r in found.collect()} == {"a/2.png": 0, "b/1.png": 1}
    assert not [f for f in found.inputFiles() if str(tmp_path / "a") in f]
