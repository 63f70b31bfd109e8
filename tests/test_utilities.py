import tarfile

import pytest

from sparkloom import config
from sparkloom.operators import contamination, sandbox, skills
from sparkloom.sources import archive


def test_config_is_closed():
    assert config.load(config.DataConfig, {"seed": 7, "ratios": [0.8, 0.1, 0.1]}).ratios == (0.8, 0.1, 0.1)
    for kind, values in ((config.DataConfig, {"sed": 1}), (config.TrainingConfig, {"steps": 1}), (config.DataConfig, {"near_duplicate_threshold": 0}), (config.TokenizerConfig, {"vocabulary": 100})):
        with pytest.raises(ValueError):
            config.load(kind, values)


def test_archives(tmp_path):
    src = tmp_path / "src"
    (src / "a").mkdir(parents=True)
    (src / "a" / "x.txt").write_text("x")
    sha = archive.pack(src, tmp_path / "one.zip")
    assert sha == archive.pack(src, tmp_path / "two.zip")
    assert "a/x.txt" in archive.restore(tmp_path / "one.zip", tmp_path / "out", sha) and (tmp_path / "out" / "COMPLETE").exists()
    with tarfile.open(tmp_path / "bad.tar", "w") as t:
        t.add(src / "a" / "x.txt", arcname="../escape")
    with pytest.raises(ValueError):
        archive.restore(tmp_path / "bad.tar", tmp_path / "out2")
    store = archive.CheckpointStore(tmp_path / "ck", keep=2)
    for k in range(4):
        store.save(k, {"w": bytes([k])})
    assert [p.name for p in store.complete()] == ["step-00000002", "step-00000003"] and store.latest().name == "step-00000003"


def test_skills(spark):
    got = skills.splits(spark, 300, 40, 40)
    assert got.count() == 380 and got.select("instruction").distinct().count() == 380
    assert contamination.overlap(got.where("split = 'train'"), got.where("split = 'challenge'"), "instruction").first()[0] == 0
    import json

    for r in got.limit(3).collect():
        assert sandbox.run_tests(r.response, "solve", json.loads(r.test_cases), 20.0) == "functional_pass"
