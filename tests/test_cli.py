import pytest

from thicket import cli


def test_flags():
    files, options = cli.parse("-c m.tsv -p 3 -o ./elsewhere/ -ifh names.txt".split())
    assert files["input"] == "m.tsv" and files["save"] == "./elsewhere/" and files["input_header"] == "names.txt"
    assert options["unsupervised"] is True
    files, options = cli.parse("-ic a -oc b -reduce_output -t 5 -sfr 0.5 -dm mad".split())
    assert files["output"] == "b" and options["reduce_output"] is True and options["sfr"] == "0.5"
    with pytest.raises(TypeError):
        cli.parse(["-nonsense", "3"])


def test_run(spark, tmp_path):
    from thicket.model import Forest

    (tmp_path / "m.txt").write_text("".join(f"{i % 7} {(i * 3) % 11} {i % 2 * 9}\n" for i in range(60)))
    (tmp_path / "h.txt").write_text("a\nb\nc\n")
    (tmp_path / "s.txt").write_text("".join(f"cell{i // 2}\n" for i in range(60)))
    cli.main(["-s", str(tmp_path / "s.txt"), "-c", str(tmp_path / "m.txt"), "-h", str(tmp_path / "h.txt"), "-o", str(tmp_path / "out"), "-t", "2", "-depth", "2", "-leaves", "5", "-ss", "30", "-ifs", "2", "-ofs", "2"])
    forest = Forest.load(spark, str(tmp_path / "out"))
    assert forest.names == ["a", "b", "c"]
    assert {r.sample_id: r.name for r in forest.named_samples().where("sample_id < 4").collect()} == {0: "cell0", 1: "cell01", 2: "cell1", 3: "cell11"}
    assert forest.named_samples(forest.roots()).count() == 60 * len(forest.trees)
