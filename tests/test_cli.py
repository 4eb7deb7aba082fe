"""The command line."""

from factloom.__main__ import main


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.sv").write_text("module m (input a, output b);\n assign b = a;\nendmodule\n")
    (tmp_path / "m.lef").write_text("MACRO m\n PIN a\n  DIRECTION OUTPUT ;\n END a\n PIN b\n  DIRECTION OUTPUT ;\n END b\nEND m\n")
    config = tmp_path / "p.toml"
    config.write_text('[[sources]]\nview = "rtl.x"\npaths = ["a.sv"]\n[[sources]]\nview = "lef.x"\npaths = ["m.lef"]\n')
    assert main(["check", str(config), "--format", "json", "--output", str(tmp_path / "r.json"), "--save", str(tmp_path / "r")], spark) == 1
    assert "OC4001" in (tmp_path / "r.json").read_text()
    assert main(["report-diff", str(tmp_path / "r"), str(tmp_path / "r")], spark) == 0
    assert main(["contract-build", str(config), str(tmp_path / "c")], spark) == 0 and main(["contract-diff", str(tmp_path / "c"), str(tmp_path / "c")], spark) == 0
    config.write_text("[nope]\n")
    assert main(["check", str(config)], spark) == 2 and main(["explain", "OC4001"]) == 0 and main(["explain", "X"]) == 2 and main(["capabilities"]) == 0
    assert "direction-mismatch error" in capsys.readouterr().out
    assert main(["init", str(tmp_path / "new.toml")]) == 0 and "sources" in (tmp_path / "new.toml").read_text()
