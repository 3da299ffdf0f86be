"""Annotation and audio files, bundles and artefacts, and a corpus from end to end."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom import api, cli
from voxloom.operators.manifests import load
from voxloom.sources import annotations, audio, stores
from voxloom.streaming import windows
from voxloom.streaming.kmeans import IncrementalKMeans

GRID = '''File type = "ooTextFile"
Object class = "TextGrid"

xmin = 0
xmax = 2
tiers? <exists>
size = 2
item []:
    item [1]:
        class = "IntervalTier"
        name = "phones"
        xmin = 0
        xmax = 2
        intervals: size = 3
        intervals [1]:
            xmin = 0
            xmax = 0.5 
            text = "AA" 
        intervals [2]:
            xmin = 0.5
            xmax = 1.25
            text = "say ""s"""
        intervals [3]:
            xmin = 1.25
            xmax = 2
            text = "IY"
    item [2]:
        class = "IntervalTier"
        name = "syllables"
        xmin = 0
        xmax = 2
        intervals: size = 1
        intervals [1]:
            xmin = 0
            xmax = 2
            text = "sil"
'''


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "wav").mkdir()
    (root / "tg").mkdir()
    t = np.arange(32000) / 16000
    for k, name in enumerate(("one", "two")):
        x = np.sin(2 * np.pi * 300 * t) * (0.5 - 0.5 * np.cos(2 * np.pi * (3 + k) * t))
        with wave.open(str(root / "wav" / f"{name}.wav"), "wb") as w:
            w.setparams((1, 2, 16000, 0, "NONE", ""))
            w.writeframes((x * 30000).astype("<i2").tobytes())
        (root / "tg" / f"{name.upper()}.TextGrid").write_text(GRID)
    (root / "wav" / "bad.wav").write_bytes(b"nothing")
    return root


def test_tiers(spark, corpus):
    rows = annotations.read_tiers(spark, f"{corpus}/tg").filter(F.col("path").contains("ONE"))
    got = [tuple(r)[1:] for r in rows.orderBy("tier_idx", "interval_idx").collect()]
    assert got == [(0, "phones", 0, 0.0, 0.5, "AA"), (0, "phones", 1, 0.5, 1.25, 'say "s"'), (0, "phones", 2, 1.25, 2.0, "IY"), (1, "syllables", 0, 0.0, 2.0, "sil")]
    assert annotations.read_intervals(spark, f"{corpus}/tg", -1).count() == 2
    annotations.register(spark)
    assert spark.read.format("textgrid").load(f"{corpus}/tg/*.TextGrid").count() == 8
    assert annotations.generated_syllables(spark).count() == 0


def test_wav(spark, corpus):
    waves = audio.read_audio(spark, f"{corpus}/wav").cache()
    assert waves.filter("success").count() == 2 and waves.filter("NOT success").count() == 1
    assert waves.filter("success").select(F.max(F.size("samples"))).first()[0] == 32000
    half = audio.read_audio(spark, f"{corpus}/wav", 8000).filter("success")
    assert half.select(F.max(F.size("samples"))).first()[0] == 16000
    assert audio.find_audio(spark, f"{corpus}").count() == 3


def test_corpus_end_to_end(spark, corpus):
    rows = api.run_evaluation(spark, f"{corpus}/wav", f"{corpus}/tg", {"phone": 0, "syllable": 1}, delta=0.01).collect()
    assert {(r["file_id"], r["eval_method"]) for r in rows} == {(f, m) for f in ("one", "two") for m in ("nuclei", "syllable_boundaries", "syllable_spans")}
    waves = audio.read_audio(spark, f"{corpus}/wav").filter("success").cache()
    segments, vectors = api.embed_corpus(waves, segmentation_method="peakdetect", features="mfcc", segmentation_kwargs={"envelope": "sbs", "delta": 0.01})
    assert segments.count() == vectors.count() > 4
    found, pipeline = api.discover_corpus(waves, discovery_kwargs={"n_clusters": 2}, segmentation_method="mincut", features="mfcc")
    assert found.filter("cluster_label IS NULL OR audio_path IS NULL").count() == 0 and found.count() > 4


def test_corpus_to_storage(spark, corpus, tmp_path):
    waves = audio.read_audio(spark, f"{corpus}/wav").cache()
    found, _ = api.discover_corpus(waves.filter("success"), discovery_kwargs={"n_clusters": 2}, segmentation_method="mincut", features="mfcc", output_dir=str(tmp_path / "out"))
    assert found.count() > 4 and found.filter("cluster_label IS NULL").count() == 0
    manifest = stores.load_embedding_manifest(spark, str(tmp_path / "out/manifest")).collect()
    assert len(manifest) == 2 and all(r["success"] and r["embedding_dim"] == 13 and r["num_rows"] > 0 for r in manifest)
    got = api.embed_corpus_to_storage(waves, str(tmp_path / "all"), segmentation_method="mincut", features="mfcc").collect()
    assert sorted(r["success"] for r in got) == [False, True, True]


def test_public_names():
    import voxloom
    from voxloom import plotting

    assert all(getattr(voxloom, n) is not None for n in voxloom.__all__)
    with pytest.raises(AttributeError):
        voxloom.nothing
    assert plotting.parse_list("[np.float64(1.5), (2, 3)]") == [1.5, (2, 3)] and plotting.parse_list("?") == []


def test_cli(spark, corpus, tmp_path):
    assert cli.main(["segment", f"{corpus}/wav", "--out", str(tmp_path / "seg")]) == 0
    assert spark.read.json(str(tmp_path / "seg")).count() == 2
    assert cli.main(["evaluate", f"{corpus}/wav", f"{corpus}/tg", "--phone-tier", "0", "--out", str(tmp_path / "ev"), "--aggregate", str(tmp_path / "agg")]) == 0
    assert spark.read.csv(str(tmp_path / "agg"), header=True).count() == 1
    with pytest.raises(SystemExit):
        cli.build_parser().parse_args(["evaluate", "a", "b", "--tolerance", "-1", "--out", "c"])


def test_array_archives(spark, tmp_path):
    rows = [(k, f"a/{k}.wav", [[float(k), 1.5], [2.0, 3.0]], {"k": "v"}, True, None) for k in range(5)] + [(9, "b.wav", [], {}, False, "broken")]
    df = spark.createDataFrame(rows, "file_id long, audio_path string, embeddings array<array<double>>, metadata map<string,string>, success boolean, error string")
    assert stores.save_archives(df.coalesce(1), f"{tmp_path}/npz", files=4) == 2
    assert stores.save_archives(df.coalesce(1), f"{tmp_path}/npz", files=4) == 2  # again, in place
    back = stores.load_archives(spark, f"{tmp_path}/npz", filter_failed=False).orderBy("file_id")
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.orderBy("file_id").collect()]
    assert stores.load_archives(spark, f"{tmp_path}/npz").count() == 5
    assert sorted(np.load(next((tmp_path / "npz").glob("part-*-00000.npz")))["embeddings_1"].ravel()) == [1.0, 1.5, 2.0, 3.0]
    assert stores.save_archives(df.limit(0), f"{tmp_path}/none") == 0
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="h5py"):
            stores.save_archives(df, f"{tmp_path}/h5", "h5")
    else:
        stores.save_archives(df, f"{tmp_path}/h5", "h5")
        assert stores.load_archives(spark, f"{tmp_path}/h5", "h5").count() == 5


def test_bundles_and_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", [[1.0, 2.0], [3.0, 4.0]], {"k": "v"}, True, None), (1, "b", [], {}, False, "broken")], "file_id long, audio_path string, embeddings array<array<double>>, metadata map<string,string>, success boolean, error string")
    for kind in ("parquet", "json"):
        path = str(tmp_path / f"b.{kind}")
        stores.save_embeddings(rows, path)
        assert stores.load_embeddings(spark, path).count() == 1 and stores.load_embeddings(spark, path, filter_failed=False, file_ids=[1]).first()["error"] == "broken"
        assert stores.embedding_rows(stores.load_embeddings(spark, path)).count() == 2
    with pytest.raises(ValueError):
        stores.save_embeddings(rows, str(tmp_path / "b.xyz"))
    man = spark.createDataFrame([(0, "a", 2, 2, "True"), (1, "b", 0, 0, "FALSE")], "file_id long, audio_path string, num_rows int, embedding_dim int, success string")
    stores.write_embedding_manifest(man, str(tmp_path / "m"))
    assert [r["success"] for r in stores.load_embedding_manifest(spark, str(tmp_path / "m")).orderBy("file_id").collect()] == [True, False]
    lab = spark.createDataFrame([("a", 0.0, 0, "x"), ("a", 1.0, 1, "y")], "audio_path string, start double, cluster_label int, primary_label string")
    stores.export_label_artifacts(lab, str(tmp_path / "art"))
    got = stores.load_label_artifacts(spark, str(tmp_path / "art"))
    assert got["segments"].count() == 2 and {"precision", "recall", "f1", "purity"} <= set(got["clusters"].columns)
    assert all(d.count() == 0 for d in stores.load_label_artifacts(spark, str(tmp_path / "none")).values())
    assert [len(c) for c in stores.chunks(spark.range(25), 10)] == [10, 10, 5]
    nested = lab.groupBy("audio_path").agg(F.array_sort(F.collect_list("primary_label")).alias("l"))
    stores.write_flat(nested, str(tmp_path / "flat.tsv"))
    assert load(spark, str(tmp_path / "flat.tsv")).first()["l"] == '["x","y"]'
    with pytest.raises(ValueError):
        load(spark, "x.doc")


def test_streams(spark, tmp_path):
    spark.createDataFrame([(0, [float(i % 2 * 10), 1.0]) for i in range(30)], "file_id long, embedding array<double>").write.parquet(str(tmp_path / "in"))
    model = IncrementalKMeans(2)
    stream = spark.readStream.schema("file_id long, embedding array<double>").parquet(str(tmp_path / "in"))
    model.learn_from(stream, str(tmp_path / "ck")).awaitTermination()
    assert sorted(c[0] for c in model.centres.tolist()) == [0.0, 10.0] and model.weights.sum() == 30
    ev = spark.createDataFrame([(0, f"2024-01-01 00:00:{s:02d}", 1.0) for s in (1, 2, 40)], "file_id long, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in windows.sessions(ev, "10 seconds", late="1 minute").collect()) == [1, 2]
    assert windows.windowed_levels(ev, "1 minute").first()["rms"] == 1.0
