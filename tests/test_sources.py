import hashlib
import json

from glossweave.operators import privacy
from glossweave.sources import read_assets, read_catalogs, read_manifests, write_cache


def full_manifest():
    return {
        "manifest_version": 3,
        "name": "full",
        "version": "1.0.0",
        "permissions": ["activeTab", "storage", "alarms"],
        "optional_permissions": [],
        "host_permissions": ["<all_urls>"],
        "background": {"service_worker": "core/worker.js", "type": "module"},
        "content_scripts": [{"matches": ["<all_urls>"], "js": ["core/scan.js"], "css": ["ui/shared/styles.css"]}],
        "web_accessible_resources": [{"resources": ["fonts/*", "data/*.bin", "*.map"], "matches": ["<all_urls>"]}],
        "content_security_policy": {"extension_pages": "script-src 'self'"},
        "action": {"default_popup": "ui/popup.html", "default_icon": {"16": "icons/16.png", "48": "icons/48.png"}},
        "icons": {"16": "icons/16.png"},
        "options_page": "ui/options.html",
        "sandbox": {"pages": ["core/off.html"]},
    }


def test_manifests_one_file_each(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(full_manifest(), indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"name": "small", "manifest_version": 2}, indent=2))
    df = read_manifests(spark, str(tmp_path))
    rows = {r.name: r for r in df.collect()}
    assert rows["full"].action.default_icon == {"16": "icons/16.png", "48": "icons/48.png"}
    assert rows["full"].optional_permissions == [] and rows["small"].permissions is None
    assert rows["full"].manifest_path.endswith("a.json")

    audit = privacy.permission_audit(df, ["activeTab", "storage"]).collect()
    assert sorted((r.name, r.kind, r.permission) for r in audit) == [
        ("full", "host", "<all_urls>"), ("full", "required", "alarms"),
    ]

    files = spark.createDataFrame(
        [("core/worker.js",), ("core/scan.js",), ("build/fonts/a.woff",), ("data/x/y.bin",), ("icons/16.png",),
         ("ui/popup.html",), ("ui/options.html",), ("core/off.html",), ("deep/a.map",)],
        "path string",
    )
    missing = privacy.manifest_path_audit(df, files).collect()
    assert sorted((r.kind, r.path) for r in missing) == [
        ("icon", "icons/48.png"), ("resource", "fonts/*"), ("style", "ui/shared/styles.css"),
    ]
    none = privacy.manifest_path_audit(df, files.limit(0)).collect()
    assert len(none) == 11


def test_catalogs_language_from_file_name(spark, tmp_path):
    (tmp_path / "en.json").write_text(json.dumps({"a": "A", "b": "B"}, indent=2))
    (tmp_path / "ja.json").write_text(json.dumps({"a": "あ"}, ensure_ascii=False))
    got = {(r.lang, r.key): r.value for r in read_catalogs(spark, str(tmp_path)).collect()}
    assert got == {("en", "a"): "A", ("en", "b"): "B", ("ja", "a"): "あ"}


def test_assets_size_and_hash(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.png").write_bytes(b"\x00\xff\x10")
    (tmp_path / "skip.txt").write_bytes(b"no")
    rows = read_assets(spark, str(tmp_path), "*.png").collect()
    assert [(r.size, r.sha256) for r in rows] == [(3, hashlib.sha256(b"\x00\xff\x10").hexdigest())]


def test_write_cache_replaces_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "cache")
    write_cache(spark.createDataFrame([("en", 1), ("fr", 2)], "lang string, v int"), path, "lang")
    update = spark.createDataFrame([("fr", 3), ("fr", 4)], "lang string, v int")
    for _ in range(2):
        write_cache(update, path, "lang")
    assert sorted((r.lang, r.v) for r in spark.read.parquet(path).collect()) == [("en", 1), ("fr", 3), ("fr", 4)]
