import pytest
from plumbline.plans import jobs, versions


def snapshot(tmp_path, name, *places):
    (tmp_path / name).write_text("71;001;000;000;;1;Район;\n" + "".join(f"71;001;001;{i:03d};;2;село {p};\n" for i, p in enumerate(places, 1)))
    return str(tmp_path / name)


def names(spark, folder):
    registry, index = jobs.published(spark, folder)
    assert index.count() == registry.count()
    return {r.name for r in registry.collect()} - {"Район"}


def test_a_version_counts_when_it_is_whole(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "published")
    with pytest.raises(ValueError, match="nothing"):
        jobs.published(spark, folder)
    jobs.publish_registry(spark, snapshot(tmp_path, "data-20260101T0000.csv", "Мирный"), folder)
    assert names(spark, folder) == {"село Мирный"}
    new = snapshot(tmp_path, "data-20260201T0000.csv", "Лесной", "Новый")

    def stop(*_):
        raise KeyboardInterrupt

    # between the version and the pointer
    with monkeypatch.context() as m:
        m.setattr(versions, "point", stop)
        with pytest.raises(KeyboardInterrupt):
            jobs.publish_registry(spark, new, folder)
    assert names(spark, folder) == {"село Мирный"}
    # between the pointer and the removal of old versions
    with monkeypatch.context() as m:
        m.setattr(versions, "prune", stop)
        with pytest.raises(KeyboardInterrupt):
            jobs.publish_registry(spark, new, folder)
    assert names(spark, folder) == {"село Лесной", "село Новый"}
    # the same snapshot again, and what stopped publishers left goes
    jobs.publish_registry(spark, new, folder, keep=1)
    assert names(spark, folder) == {"село Лесной", "село Новый"}
    assert len([p for p in (tmp_path / "published").iterdir() if p.is_dir()]) == 2


def test_a_bad_snapshot_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "published")
    jobs.publish_registry(spark, snapshot(tmp_path, "data-20260101T0000.csv", "Мирный"), folder)
    for name, text in (("data-20260301T0000.csv", "<html>"), ("data-20260302T0000.csv", "71;001;001;001;;9;x;\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match="snapshot|rows"):
            jobs.publish_registry(spark, str(tmp_path / name), folder)
    assert names(spark, folder) == {"село Мирный"}


def test_one_of_two_publishers_fails(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "published")
    jobs.publish_registry(spark, snapshot(tmp_path, "data-20260101T0000.csv", "Мирный"), folder)
    monkeypatch.setattr(versions, "_numbers", lambda *_: [])
    with pytest.raises(RuntimeError, match="another"):
        versions.point(spark, folder, "x")
