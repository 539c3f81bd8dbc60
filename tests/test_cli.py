import io

from quillstore import cli


def test_tools(spark, tmp_path, capsys, monkeypatch):
    source = tmp_path / "in"
    source.write_bytes(b"1.k=v\x1e1.k=w\x1e2.l=5\x1ek=z")
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("kv_scan", source) == 0
    assert "keys=4" in capsys.readouterr().out
    assert run("kv_scan", "--dedup", source) == 0
    out = capsys.readouterr().out
    assert "keys=3" in out and "query ids: 0 1 2" in out
    assert run("kv_split", source, "--output", tmp_path / "split") == 0
    assert spark.read.text(str(tmp_path / "split")).count() == 4
    typed = tmp_path / "typed"
    typed.write_text("1=String|2=Int64\n1.k=v\n2.l=5\n")
    where = ("--root", tmp_path / "store", "--name", "t")
    assert run("create", typed, *where) == 0
    assert run("get", *where, "2.l") == 0 and run("get", *where, "none") == 1
    assert capsys.readouterr().out.splitlines()[-2:] == ["5", "not found"]
    assert run("comparo", source, *where) == 0
    assert capsys.readouterr().out.split() == ["equal=2", "missing=1"]
    monkeypatch.setattr("sys.stdin", io.StringIO("GET 1.k\nGETLONG 2.l\nGETVECTOR 1.k\n"))
    assert run("commands", *where) == 0
    assert capsys.readouterr().out.splitlines() == ["1.k: v", "2.l: 5", "1.k: "]
    assert run("dump", *where, "--json") == 0
    assert '"1.k":{"type":"String", "value":"v"}' in capsys.readouterr().out
    assert run("wait_local", *where, "--after", 1) == 0 and run("wait_local", *where, "--after", 10**15, "--limit", 0) == 1
    settings = tmp_path / "s.properties"
    settings.write_text(f"cache.names=a\ncache.input_dir={tmp_path}\ncache.input_files=in\ncache.output_dir={tmp_path}/out\n")
    assert run("create", "--settings", settings) == 0
