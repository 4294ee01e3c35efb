from docgraph import cli
from docgraph.options import redacted


def test_literals_values_and_logins():
    assert redacted("cannot cast 'secret' of \"x y\" to int") == "cannot cast '***' of '***' to int"
    assert redacted("no such host s3://me:pw@bucket/a, value 4711", ["4711"]) == "no such host s3://***@bucket/a, value ***"
    assert redacted("it''s fine") == "it'***'s fine" or redacted("plain text") == "plain text"


def test_a_failing_query_does_not_show_its_literals(spark, tmp_path, capsys):
    code = cli.main(["--catalog", str(tmp_path), "export", str(tmp_path / "out"), "--query", "SELECT CAST('hunter2' AS INT) + nothing FROM nowhere WHERE k = :k", "--bind", "k=token99"])
    out = capsys.readouterr()
    assert code == 2 and "hunter2" not in out.out + out.err and "token99" not in out.out + out.err
    code = cli.main(["--catalog", str(tmp_path), "export", str(tmp_path / "out"), "--query", "SELECT raise_error(concat('shown ', :k)) AS doc", "--bind", "k=token99"])
    out = capsys.readouterr()
    assert code == 2 and "token99" not in out.out + "".join(x for x in out.err.splitlines() if x.startswith("{"))
