"""Byte ranges of files and the hash trees over them."""

import hashlib
import random

from glossweave.sources.ranges import changed_ranges, file_ranges, hash_ranges, hash_tree


def sha(data):
    return hashlib.sha256(data).hexdigest()


def root(data, size, fanout):
    level = [sha(data[i : i + size]) for i in range(0, max(1, len(data)), size)]
    while len(level) > 1:
        level = [sha("".join(level[i : i + fanout]).encode()) for i in range(0, len(level), fanout)]
    return level[0]


def test_roots_equal_one_pass(spark, tmp_path):
    rng = random.Random(1)
    files = {f"f{n}.bin": rng.randbytes(n) for n in (1, 99, 100, 101, 5000, 12345)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    hashed = hash_ranges(file_ranges(spark, str(tmp_path), "*.bin", 100), tasks=3)
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.n_ranges, r.root) for r in hash_tree(hashed, 3).collect()}
    assert got == {n: (len(d), max(1, -(-len(d) // 100)), root(d, 100, 3)) for n, d in files.items()}


def test_a_changed_range_is_named(spark, tmp_path):
    data = bytearray(random.Random(2).randbytes(1050))
    file = tmp_path / "a.bin"
    file.write_bytes(data)
    before = hash_ranges(file_ranges(spark, str(tmp_path), size=100)).collect()
    before = spark.createDataFrame(before)
    data[777] ^= 1
    file.write_bytes(data + b"more" * 30)
    got = changed_ranges(before, hash_ranges(file_ranges(spark, str(tmp_path), size=100))).collect()
    assert sorted((r.no, r.start, r.length, r.status) for r in got) == [
        (7, 700, 100, "changed"), (10, 1000, 100, "changed"), (11, 1100, 70, "extra"),
    ]
