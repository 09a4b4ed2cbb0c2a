"""The verbs over folders of generated pictures, through the command line."""

import os
import shutil

import pytest

from pyspark.sql import functions as F

from nearfold import cli
from nearfold.operators.matches import range_search
from nearfold.plans import apply, dedup
from nearfold.sources.images import list_files, scan_folder, scan_list
from nearfold.streaming.copies import start
from tests.pictures import png, scene, touched


@pytest.fixture
def assets(tmp_path):
    """pair/: two sizes of one picture. mixed/: three pictures, one twice."""
    pair, mixed = tmp_path / "pair", tmp_path / "mixed"
    pair.mkdir()
    mixed.mkdir()
    png(pair / "p1.png", scene(1, 64))
    png(pair / "p2.png", scene(1, 128))
    for i in (1, 2):
        png(mixed / f"x{i}.png", scene(20 + i))
    png(mixed / "x3.png", scene(23, 120))
    png(mixed / "x3c.png", touched(scene(23, 60)))
    return tmp_path


def names(folder):
    return sorted(os.listdir(folder))


@pytest.fixture(autouse=True)
def _session(spark):
    return spark


@pytest.mark.parametrize(("argv", "code"), [(["--help"], 0), (["--version"], 0), (["--wrong"], 1), ([], 1), (["dedup"], 1), (["compare", "-i", "one.png"], 1)])
def test_exit_codes(argv, code, capsys):
    assert cli.main(argv) == code
    capsys.readouterr()


def test_compare(assets, capsys):
    p1, p2, x1 = str(assets / "pair/p1.png"), str(assets / "pair/p2.png"), str(assets / "mixed/x1.png")
    assert cli.main(["compare", "-i", p1, "-i", p2, "-i", x1, "-v"]) == 0
    out = capsys.readouterr().out
    line = next(x for x in out.splitlines() if x.startswith(f"Similarity of {p1} and {p2}"))
    assert float(line.rsplit(" ", 1)[1].rstrip("%")) >= 90
    assert f"Similarity of {p2} and {x1}" in out and "hash " in out
    assert cli.main(["compare", "-i", p1, "-i", str(assets / "none.png")]) == 1


def test_dedup_moves_the_worse_one_to_the_trash(assets):
    folder = assets / "pair"
    assert cli.main(["dedup", "-p", str(folder), "-ds", "90", "-y"]) == 0
    assert names(folder) == [".trash", "p2.png"]
    assert names(folder / ".trash") == [".duplicateReasons.txt", "p1.png"]
    note = (folder / ".trash/.duplicateReasons.txt").read_text()
    assert "p1.png" in note and "p2.png" in note


def test_dedup_of_several_groups_and_keep(assets):
    folder = assets / "mixed"
    assert cli.main(["dedup", "--path", str(folder), "--duplicate-similar", "90", "--yes", "-k", "LowestResolution"]) == 0
    assert names(folder) == [".trash", "x1.png", "x2.png", "x3c.png"]


def test_strict_bar_finds_nothing(assets):
    assert cli.main(["dedup", "-p", str(assets / "mixed"), "-ds", "101", "-y"]) == 0
    assert names(assets / "mixed") == ["x1.png", "x2.png", "x3.png", "x3c.png"]


@pytest.mark.parametrize(("action", "left"), [("Nothing", ["p1.png", "p2.png"]), ("Delete", ["p2.png"]), ("DeleteAndCreateLink", ["p1.png", "p2.png"]), ("MoveToTrashAndCreateLink", [".trash", "p1.png", "p2.png"])])
def test_actions(assets, action, left):
    folder = assets / "pair"
    assert cli.main(["dedup", "-p", str(folder), "-ds", "90", "-y", "-a", action]) == 0
    assert names(folder) == left
    if "Link" in action:
        assert os.readlink(folder / "p1.png") == "p2.png"
    assert cli.main(["dedup", "-p", str(folder), "-ds", "90", "-y", "-a", "Nonsense"]) == 1


def test_dedup_waits_for_confirmation(assets, monkeypatch):
    asked = []
    monkeypatch.setattr("builtins.input", lambda text: asked.append(text))
    assert cli.main(["dedup", "-p", str(assets / "pair"), "-ds", "90"]) == 0
    assert len(asked) == 1 and "p1.png" in asked[0]


def test_copy_is_idempotent(assets):
    source, destination = assets / "mixed", assets / "pair"
    os.symlink(source / "x1.png", source / "link.png")
    for _ in range(2):
        assert cli.main(["dedup-copy", "-s", str(source), "-d", str(destination), "-ds", "90", "-y"]) == 0
        assert names(destination) == ["p1.png", "p2.png", "x1.png", "x2.png", "x3.png"]
        assert not any(os.path.islink(destination / n) for n in names(destination))


def test_copy_keeps_folders_and_renames_on_collision(assets):
    source, destination = assets / "mixed", assets / "pair"
    (source / "sub").mkdir()
    png(source / "sub/y.png", scene(55))
    png(destination / "x1.png", scene(77))
    assert cli.main(["dedup-copy", "-s", str(source), "-d", str(destination), "-r", "-y"]) == 0
    copied = names(destination)
    assert "sub" in copied and names(destination / "sub") == ["y.png"]
    assert len([n for n in copied if n.startswith("x1")]) == 2


def test_patch_overwrites_worse_destination_images(assets):
    source, destination = assets / "source", assets / "destination"
    source.mkdir()
    destination.mkdir()
    png(source / "good.png", scene(5, 160))
    png(destination / "bad.png", scene(5, 60))
    png(source / "worse.png", scene(6, 60))
    png(destination / "better.png", scene(6, 160))
    for i in range(4):
        png(destination / f"other{i}.png", scene(40 + i))
    before = {n: (destination / n).read_bytes() for n in names(destination)}
    assert cli.main(["dedup-patch", "-s", str(source), "-d", str(destination), "-ds", "90"]) == 0
    after = {n: (destination / n).read_bytes() for n in names(destination)}
    assert after.pop("bad.png") == (source / "good.png").read_bytes() and before.pop("bad.png")
    assert after == before


def test_top(assets, capsys):
    shutil.copy(assets / "pair/p1.png", assets / "mixed/copy.png")
    assert cli.main(["dup-top", "-i", str(assets / "pair/p2.png"), "-s", str(assets / "mixed"), "--top", "2"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 2 and lines[0].startswith(str(assets / "mixed/copy.png"))
    (assets / "bad.png").write_bytes(b"no picture")
    assert cli.main(["dup-top", "-i", str(assets / "bad.png"), "-s", str(assets / "mixed")]) == 1


def test_listing(tmp_path):
    for name in ("a.PNG", "b.gif", "none", "_x.png", ".x.png", "a b.png", "é.jpg", ".trash/t.png", "foo.trash/t.png", ".trash/sub/t.png", "sub/s.jfif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    os.symlink(tmp_path / "a.PNG", tmp_path / "l.png")
    os.symlink(tmp_path / "gone.png", tmp_path / "broken.png")
    flat = [os.path.relpath(p, tmp_path) for p in list_files(str(tmp_path))]
    assert flat == sorted([".x.png", "_x.png", "a b.png", "a.PNG", "é.jpg"])
    deep = [os.path.relpath(p, tmp_path) for p in list_files(str(tmp_path), recursive=True)]
    assert deep == sorted([*flat, ".trash/sub/t.png", "sub/s.jfif"])
    assert len(list_files(str(tmp_path), links=True)) == 6
    assert [os.path.basename(p) for p in list_files(str(tmp_path), extensions=[".GIF"])] == ["b.gif"]
    with pytest.raises(ValueError):
        list_files(str(tmp_path), extensions=[])
    with pytest.raises(NotADirectoryError):
        list_files(str(tmp_path / "nowhere"))


def test_reading(spark, tmp_path):
    png(tmp_path / "_a b%20+é[1].png", scene(1, 40))
    png(tmp_path / "gray.png", scene(2, 40, colour=False)[:, :, 0])
    png(tmp_path / "alpha.png", __import__("numpy").dstack([scene(3, 40), scene(3, 40)[:, :, :1]]))
    (tmp_path / "bad.jpg").write_bytes(b"no picture")
    rows = {os.path.basename(r["physical_path"]): r for r in scan_folder(spark, str(tmp_path), first_id=10).collect()}
    assert sorted(rows) == ["_a b%20+é[1].png", "alpha.png", "gray.png"]
    assert all(r["resolution"] == 1600 and r["size"] == os.path.getsize(r["physical_path"]) and r["id"] >= 10 for r in rows.values())
    assert rows["gray.png"]["is_grayscale"] and not rows["alpha.png"]["is_grayscale"]
    constant = scan_list(spark, [str(tmp_path / "gray.png")], hash_fn=lambda image: image.shape[0]).first()
    assert constant["hash"] == 40
    with pytest.raises(FileNotFoundError):
        scan_list(spark, [str(tmp_path / "none.png")])
    assert scan_folder(spark, str(tmp_path), extensions=["xyz"]).count() == 0


def test_free_path(tmp_path):
    (tmp_path / "a.png").write_bytes(b"")
    assert apply.free_path(str(tmp_path / "a.png"), 7) == str(tmp_path / "a-7.png")
    (tmp_path / "a-7.png").write_bytes(b"")
    assert apply.free_path(str(tmp_path / "a.png"), 7) == str(tmp_path / "a-7-1.png")


def test_lists_of_any_length_are_compared(spark):
    images = spark.range(300).selectExpr("id", "concat('/', id) AS physical_path", "id AS hash")
    assert dedup.compare(images).count() == 300 * 299 // 2
    one = dedup.compare(images.where("id < 2"), distance=lambda a, b: F.abs(a - b).cast("int")).first()
    assert one["similarity"] == 63 / 64


def test_range_search_and_its_metric(spark):
    images = spark.createDataFrame([(1, 0b1111), (2, 0b0111), (3, 0b0000), (4, -1)], "id long, hash long")
    assert sorted((r["id"], r["distance"]) for r in range_search(images, 0b1111, 1).collect()) == [(1, 0), (2, 1)]
    assert sorted(r["id"] for r in range_search(images, 15, 8, lambda a, b: F.abs(a - b)).collect()) == [1, 2]
    assert range_search(images.limit(0), 1, 64).count() == 0


def test_questions_say_what_is_compared(assets, monkeypatch, capsys):
    asked, shown = [], []
    monkeypatch.setattr("builtins.input", lambda text: asked.append(text))
    monkeypatch.setattr("nearfold.cli.subprocess.Popen", lambda argv, **_: shown.append(argv))
    assert cli.main(["dedup", "-p", str(assets / "pair"), "-ds", "90", "-a", "Nothing", "--viewer", "show -x", "-v"]) == 0
    text = capsys.readouterr()
    assert len(asked) == 1 and asked[0].count("resolution") == 2 and "resolution 16384" in asked[0].split("Nothing")[0]
    assert [(a[:2], os.path.basename(a[2])) for a in shown] == [(["show", "-x"], "p2.png"), (["show", "-x"], "p1.png")]
    assert "2 files" in text.out and "grayscale" in text.out and "nothing was done" in text.err and "100% read" in text.err


def test_patch_tells_its_totals(assets, capsys):
    assert cli.main(["dedup-patch", "-s", str(assets / "pair"), "-d", str(assets / "mixed"), "-ds", "90"]) == 0
    assert capsys.readouterr().out.splitlines()[-1].startswith("6 images, 4 of them in 2 groups: 0 images")


def test_stream_takes_every_image_once(spark, assets, tmp_path):
    incoming, known = tmp_path / "incoming", tmp_path / "known"
    for folder in ("mixed", "pair", "mixed"):
        scan_folder(spark, str(assets / folder)).write.mode("append").parquet(str(incoming))
        stream = spark.readStream.schema(spark.read.parquet(str(incoming)).schema).parquet(str(incoming))
        start(stream, str(known), str(tmp_path / "state"), bar=90, once=True).awaitTermination()
    taken = sorted(os.path.basename(r["physical_path"]) for r in spark.read.parquet(str(known)).collect())
    assert taken == ["p2.png", "x1.png", "x2.png", "x3.png"]
