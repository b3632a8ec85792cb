"""Listings with ignore files."""

import re

import pytest

from quern.sources import listing


@pytest.mark.parametrize(
    ("line", "fits", "fails"),
    [
        ("*.tmp", ["a.tmp", "x/y.tmp", ".tmp"], ["a.tmpx", "tmp"]),
        ("/a", ["a"], ["x/a", "ab"]),
        ("a/b", ["a/b"], ["x/a/b", "a/b/c"]),
        ("**/a", ["a", "x/a", "x/y/a"], ["xa"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "xa/b"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]),
        ("a**b", ["ab", "axxb", "x/axb"], ["a/b"]),
        ("[ab]?.x", ["a1.x", "q/bc.x"], ["c1.x", "a/.x", "a.x"]),
        ("[!a-c]", ["d", "x/z"], ["a", "/"]),
        ("a\\*", ["a*"], ["ab"]),
        ("\\#x", ["#x"], ["x"]),
        ("\\!x", ["!x"], ["x"]),
        ("a.b+(c)", ["a.b+(c)"], ["aXb+(c)"]),
        ("tail  ", ["tail"], ["tail  "]),
        ("a[", ["a["], ["a"]),
    ],
)
def test_patterns(line, fits, fails):
    regex, negated, folders = listing.compiled(line)
    assert not negated and not folders
    assert all(re.search(regex, x) for x in fits) and not any(re.search(regex, x) for x in fails)


def test_marks_of_patterns():
    assert listing.compiled("") is None and listing.compiled("# no") is None and listing.compiled("/") is None and listing.compiled("  ") is None
    assert listing.compiled("!a/")[1:] == (True, True) and listing.compiled("a/\r") == listing.compiled("a/")


def test_the_last_match_decides(spark, tmp_path):
    tree = {
        "a.log": "", "keep.log": "", "b.txt": "", "out/b.txt": "", "out/keep.log": "", "src/out": "", "src/deep/x.log": "", "src/deep/y.log": "", "src/deep/z.txt": "", "src/only.md": "", ".hid/x": "", "odd [1]/é.txt": "",
        ".gitignore": "*.log\n!keep.log\nout/\n", "src/deep/.gitignore": "!x.log\n", ".ignore": "z.txt\n", "src/deep/.rgignore": "!z.txt\n", "src/.ignore": "/only.md\n/deep.md", "out/.gitignore": "!*\n",
    }
    for name, content in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content or "x")
    paths = lambda **k: sorted(r.path for r in listing.listed(spark, f"file://{tmp_path}", **k).collect())
    assert paths() == sorted(["keep.log", "b.txt", "src/out", "src/deep/x.log", "src/deep/z.txt", "odd [1]/é.txt"])
    assert paths(glob="*.txt") == sorted(["b.txt", "src/deep/z.txt", "odd [1]/é.txt"]) and paths(depth=1) == ["b.txt", "keep.log"]
    assert ".hid/x" in paths(hidden=True) and ".ignore" in paths(hidden=True)
    assert "src/only.md" in paths(ignore_files=(".gitignore",)) and paths(ignore_files=(".none",)) == sorted(n for n in tree if not n.startswith(".") and "/." not in n)
    (tmp_path / "src/ring").symlink_to(tmp_path / "src")
    (tmp_path / "elsewhere").symlink_to(tmp_path / "src/deep")
    (tmp_path / "src/deep/back").symlink_to(tmp_path / "odd [1]")
    (tmp_path / "odd [1]/forth").symlink_to(tmp_path / "src/deep")
    assert paths() == sorted(["keep.log", "b.txt", "src/out", "src/deep/x.log", "src/deep/z.txt", "odd [1]/é.txt"])
    more = ["src/deep/back/é.txt", "odd [1]/forth/x.log", "odd [1]/forth/z.txt", "elsewhere/x.log", "elsewhere/z.txt", "elsewhere/back/é.txt"]
    assert paths(follow=True) == sorted(["keep.log", "b.txt", "src/out", "src/deep/x.log", "src/deep/z.txt", "odd [1]/é.txt", *more])
    (tmp_path / "empty").mkdir()
    assert listing.listed(spark, f"file://{tmp_path}/empty").count() == 0
