import io

from rillstore import __main__ as cli
from tests.test_schema_codec import USER
from tests.test_store import posts, users


def test_query_stats_and_export(spark, tmp_path, capsys):
    (tmp_path / "s.fbs").write_text(USER)
    (tmp_path / "in.bin").write_bytes(users(5) + posts(2, 2))
    base = ["--schema", str(tmp_path / "s.fbs"), "--map", "USER=User", "--map", "POST=Post"]
    assert cli.main([*base, "--load", str(tmp_path / "in.bin"), "--query", "SELECT id, name, _data FROM User WHERE id = 3", "--stats", "--export", str(tmp_path / "out")]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "id\tname\t_data" and out[1].startswith("3\tUser3\t[") and out[1].endswith("bytes]")
    assert any(line.startswith("User\tUSER\t5\t") for line in out)
    assert cli.main([*base, "--load", str(tmp_path / "out") + "/part-*", "--query", "SELECT count(*) AS n FROM Post"]) == 0
    assert capsys.readouterr().out.splitlines()[:2] == ["n", "4"]


def test_standard_input(spark, tmp_path, capsys, monkeypatch):
    class In:
        buffer = io.BytesIO(users(2) + b"\x10\0\0\0xx")

        def isatty(self):
            return False

    (tmp_path / "s.fbs").write_text(USER)
    monkeypatch.setattr("sys.stdin", In())
    assert cli.main(["--schema", str(tmp_path / "s.fbs"), "--map", "USER=User", "--query", "SELECT id, email FROM User ORDER BY id LIMIT 1"]) == 0
    got = capsys.readouterr()
    assert got.out.splitlines() == ["id\temail", "0\tuser0@test.com"] and "6 bytes" in got.err


def test_cells():
    assert [cli.cell(x) for x in (None, b"abc", 1.5, "a\tb")] == ["NULL", "[3 bytes]", "1.5", "a b"]
