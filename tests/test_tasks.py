import pytest

from contamgraph.plans import tasks as T


def test_failures_stop_dependants_only(tmp_path):
    ran = []
    fail = lambda: 1 / 0
    todo = [T.Task("a", fail), T.Task("b", lambda: ran.append("b"), needs=("a",)), T.Task("c", lambda: ran.append("c")), T.Task("d", lambda: ran.append("d"), needs=("b",))]
    out = T.run_all(todo, tmp_path)
    assert {k: v.status for k, v in out.items()} == {"a": "failed", "b": "skipped", "c": "ok", "d": "skipped"} and ran == ["c"]
    assert "ZeroDivisionError" in out["a"].error


def test_cache(tmp_path):
    target, ran = tmp_path / "out", []

    def make():
        ran.append(1)
        target.write_text("x")

    t = T.Task("make", make, outputs=(str(target),), modules=("contamgraph.schema",))
    assert [T.run_all([t], tmp_path / "s")["make"].status for _ in range(2)] == ["ok", "cached"]
    target.unlink()
    assert T.run_all([t], tmp_path / "s")["make"].status == "ok"
    (tmp_path / "s/make.json").write_text('{"code": "old"}')
    assert T.run_all([t], tmp_path / "s")["make"].status == "ok"
    assert T.run_all([t], tmp_path / "s", force=True)["make"].status == "ok" and len(ran) == 4


def test_code_key_follows_declared_modules(monkeypatch):
    t = T.Task("x", test_cache, modules=("contamgraph.schema",), libraries=("pyspark", "not_there"))
    before = T.code_key(t)
    monkeypatch.setattr(T.inspect, "getsource", lambda o: "changed")
    assert T.code_key(t) != before


def test_roots(monkeypatch):
    monkeypatch.delenv("CONTAMGRAPH_DATA", raising=False)
    with pytest.raises(FileNotFoundError):
        T.Roots().require()
    monkeypatch.setenv("CONTAMGRAPH_DATA", "/x")
    assert T.Roots().require() == "/x"
