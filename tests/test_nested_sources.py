"""JSON files of unknown shape."""

import json

from glossweave.sources import nested
from glossweave.sources.nested import read_json_leaves, read_nested_catalogs, unknown_manifest_keys


def write(folder, files):
    for name, text in files.items():
        (folder / name).write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")
    return str(folder)


def test_leaves_of_nested_and_broken_files(spark, tmp_path):
    path = write(tmp_path, {
        "de.json": {"menu": {"open": "Öffnen", "more": {"a.b": "x", "n": 3}}, "list": ["one", {"two": True}], "none": None},
        "fr.json": {"plain": "oui", "empty": {}, "nothing": []},
        "ja.json": '{"cut": "off',
        "ko.json": " ",
        "en.json": '"just text"',
    })
    got = {(r.lang, r.key, r.value) for r in read_nested_catalogs(spark, path).collect() if r.corrupt is None}
    assert got == {
        ("de", "menu.open", "Öffnen"), ("de", r"menu.more.a\.b", "x"), ("de", "menu.more.n", "3"),
        ("de", "list.0", "one"), ("de", "list.1.two", "true"), ("de", "none", None),
        ("fr", "plain", "oui"), ("fr", "empty", None), ("fr", "nothing", None), ("en", "", "just text"),
    }
    broken = [r for r in read_json_leaves(spark, path).collect() if r.corrupt is not None]
    assert [(r.file.rsplit("/", 1)[1], r.corrupt, r.key) for r in broken] == [("ja.json", '{"cut": "off', None)]


def test_unknown_manifest_keys(spark, tmp_path):
    path = write(tmp_path, {
        "a.json": {"name": "n", "icons": {"16": "i.png"}, "update_url": "u", "browser": {"min": 3}},
        "b.json": "{",
    })
    got = sorted((r.key or "", r.value or "", r.kind or "") for r in unknown_manifest_keys(spark, path).collect())
    assert got == [("", "", ""), ("browser.min", "3", "BIGINT"), ("update_url", "u", "STRING")]


def test_lines_and_no_lines(spark, tmp_path):
    write(tmp_path, {"x.json": '{"a": 1}\n{"a": [2]}\nnot json\n'})
    rows = read_json_leaves(spark, str(tmp_path), whole_file=False).collect()
    assert sorted((r.key or "", r.value or "") for r in rows) == [("", ""), ("a", "1"), ("a.0", "2")]
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "y.json").write_text("")
    assert read_json_leaves(spark, str(empty), whole_file=False).collect() == []


def test_levels_share_a_pass(spark, tmp_path, monkeypatch):
    written, store = [], nested.stored
    monkeypatch.setattr(nested, "stored", lambda *args: written.append(args[1]) or store(*args))
    path = write(tmp_path, {"de.json": {"a": {"b": {"c": ["x", "{}", None, {}]}}}, "fr.json": "{", "ja.json": "null"})

    def rows():
        return {(r.lang, r.key, r.value, r.corrupt) for r in read_nested_catalogs(spark, path).collect()}

    flat = {("de", "a.b.c.0", "x", None), ("de", "a.b.c.1", "{}", None), ("de", "a.b.c.2", None, None), ("de", "a.b.c.3", None, None),
            ("fr", None, None, "{"), ("ja", "", None, None)}
    assert rows() == flat and len(written) == 1
    write(tmp_path, {"ko.json": {"a": [[[[[{"b": "deep"}, []]]]]]}})
    assert rows() == flat | {("ko", "a.0.0.0.0.0.b", "deep", None), ("ko", "a.0.0.0.0.1", None, None)} and len(written) == 3
