from spotlake.operators import runs
from spotlake.plans.studies import full_sample_card
from spotlake.sources import listing, tables


def put(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_artifacts_are_files_or_folders(spark, tmp_path):
    root = tmp_path / "runs"
    put(root / "run_a" / "S1_epoch_2.png", "abc")
    put(root / "run_a" / "S1_epoch_x.png")
    put(root / "run_a" / "notes.txt")
    put(root / "run_a" / ".hidden_epoch_1.png")
    put(root / "deep" / "run_name=run_b" / "artifact=S2_epoch_10.png" / "part-0", "12345")
    put(root / "deep" / "run_name=run_b" / "artifact=S2_epoch_10.png" / "part-1", "678")
    kept = listing.commit_listing(spark, str(root), str(tmp_path / "listing"))
    put(root / "run_c" / "S9_epoch_9.png")  # later than the listing
    found = listing.listed_artifacts(kept)
    assert sorted((r.run_name, r.path, r["size"]) for r in found.collect()) == [
        ("run_a", "run_a/S1_epoch_2.png", 3), ("run_a", "run_a/S1_epoch_x.png", 1), ("run_b", "run_b/S2_epoch_10.png", 8)]
    parsed = runs.sort_artifacts(runs.parse_artifacts(found)).collect()
    assert [(r.run_name, r["sample"], r.epoch) for r in parsed] == [("run_b", "S2", 10), ("run_a", "S1", 2)]
    assert all(r.mtime is not None for r in parsed)


def test_card_shows_all_that_is_stored(spark, tmp_path):
    root = str(tmp_path / "data")
    tables.write_by_sample(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "sample_id STRING, v INT"), f"{root}/spots")
    tables.write_by_sample(spark.createDataFrame([("b", 1)], "sample_id STRING, v INT"), f"{root}/features")
    files = listing.sample_files(listing.list_files(spark, root))
    card = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id STRING")
    images = spark.createDataFrame([("a", "low", 1, 2), ("a", "high", 3, 4), (None, "lost", 0, 0)], "sample_id STRING, image_key STRING, h INT, w INT")
    factors = spark.createDataFrame([("b", "k", 0.5)], "sample_id STRING, key STRING, value DOUBLE")
    out = {r.sample_id: r for r in full_sample_card(card, images, factors, files).collect()}
    assert [tuple(i) for i in out["a"].images] == [("high", 3, 4), ("low", 1, 2)] and out["b"].images == [] == out["c"].images
    assert [tuple(f) for f in out["b"].scalefactors] == [("k", 0.5)] and out["a"].scalefactors == []
    assert [f.kind for f in out["a"].files] == ["spots"] and [f.kind for f in out["b"].files] == ["features", "spots"] and out["c"].files == []
    assert all(f["size"] > 0 and f.n_files > 0 for r in out.values() for f in r.files)
