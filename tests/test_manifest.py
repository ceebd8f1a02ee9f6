from tessera.sources.lake import image_manifest, label_manifest, pair_masks


def test_image_manifest_and_pairs(spark, tmp_path):
    for cls in ("cat", "dog"):
        (tmp_path / "imgs" / cls).mkdir(parents=True)
        for i in range(2):
            (tmp_path / "imgs" / cls / f"{cls}{i}.png").write_bytes(b"\x89PNG")
    (tmp_path / "masks" / "m").mkdir(parents=True)
    (tmp_path / "masks" / "m" / "cat0.png").write_bytes(b"\x89PNG")
    m = image_manifest(spark, str(tmp_path / "imgs"))
    got = sorted((r["filename"], r["label"]) for r in m.collect())
    assert got == [("cat0.png", "cat"), ("cat1.png", "cat"), ("dog0.png", "dog"), ("dog1.png", "dog")]
    labels = spark.createDataFrame([("dog1.png", "puppy")], "filename string, label string")
    assert [r["label"] for r in label_manifest(m, labels).collect()] == ["puppy"]
    pairs = pair_masks(m, image_manifest(spark, str(tmp_path / "masks")))
    assert [r["stem"] for r in pairs.collect()] == ["cat0"]
