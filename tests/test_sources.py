import os

import pytest

from passagelake import cli
from passagelake.plans import federation
from passagelake.sources.config import Config, models_to_fetch, portable
from passagelake.sources.discover import Discovery, discovered, matches_spec, normalize_extension, read_files, walk
from passagelake.sources.store import FORMAT_VERSION, Meta


def tree(root, *paths):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"\xff\xfe bad" if "bad" in p else f"text of {p}".encode())


def test_walk_and_column_rules_agree(spark, tmp_path):
    paths = ["a/b.md", "a-b.md", ".notes.md", ".gitignore", "_draft.md", ".env", "prod.env", "README", "UP.MD", "main.rs", "x.json", "x.yaml", ".hid/h.md", "dist/d.md", "a/vendor/v.md", "dist/node_modules/n.md", "bad.md", "x.mdx"]
    tree(tmp_path, *paths)
    for d in (Discovery(), Discovery(include=("dist",)), Discovery(include=("dist/",)), Discovery(("..mdx",), ("a",)), Discovery(exclude=("a/b.md", "README"), include=("a/b.md",))):
        found = walk(str(tmp_path), d)
        table = spark.createDataFrame([(p,) for p in paths], "path string")
        assert sorted(found) == sorted(r.path for r in table.filter(discovered(table.path, d)).collect())
    assert walk(str(tmp_path)).index("a/b.md") < walk(str(tmp_path)).index("a-b.md")
    assert "dist/node_modules/n.md" not in walk(str(tmp_path), Discovery(include=("dist",))) and "dist/node_modules/n.md" in walk(str(tmp_path), Discovery(include=("dist/",)))
    os.symlink(tmp_path / "a", tmp_path / "linked")
    os.symlink(tmp_path / "a/b.md", tmp_path / "again.md")
    assert {"a/b.md", "linked/b.md", "again.md"} <= set(walk(str(tmp_path)))
    rows = {r.path: r for r in read_files(spark, str(tmp_path)).collect()}
    assert rows["bad.md"].text is None and rows["bad.md"].hash and rows[".notes.md"].text == "text of .notes.md"


def test_broken_and_circular_links_are_errors(tmp_path):
    tree(tmp_path, "a/b/c.md")
    os.symlink(tmp_path / "a", tmp_path / "a/b/up")
    with pytest.raises(OSError, match="a/b/up"):
        walk(str(tmp_path))
    (tmp_path / "a/b/up").unlink()
    os.symlink(tmp_path / "nothing", tmp_path / "a/gone.md")
    with pytest.raises(FileNotFoundError, match="a/gone.md"):
        walk(str(tmp_path))


def test_only_some_files_are_read(spark, tmp_path):
    tree(tmp_path, *(f"d{i}.md" for i in range(9)))
    only = spark.createDataFrame([("d3.md",), ("d5.md",), ("x.md",)], "path string")
    assert sorted(r.path for r in read_files(spark, str(tmp_path), only=only).collect()) == ["d3.md", "d5.md"]


def test_download_verifies(tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["download", "-m", "hashing-8", "--verify"]) == 0 and "8 dimensions" in capsys.readouterr().out
    assert cli.main(["download", "-m", "no/model", "--verify"]) == 1
    for vectors in ([], [[]], [[1.0]], [[1.0, 0.0]] * 2):
        broken = type("Broken", (), {"dim": 2, "embed": lambda self, texts, v=vectors: v})()
        with pytest.raises(ValueError, match="damaged"):
            cli.verified(broken)


@pytest.mark.parametrize("raw, expected", [(".MDX", "mdx"), ("  md ", "md"), ("mdx", "mdx"), ("", None), ("  ", None), (".", None), ("..mdx", "mdx")])
def test_extensions(raw, expected):
    assert normalize_extension(raw) == expected


@pytest.mark.parametrize("spec, path, name, hit", [("deprecated", "reference/deprecated", "deprecated", True), ("dist", "dist", "dist", True), ("src/content/changelog", "src/content/changelog", "changelog", True), ("src/content/changelog", "src/content/changelog/2024.md", "2024.md", True), ("/partials/", "partials", "partials", True), ("dist", "src/content", "content", False), ("src/content/changelog", "src/content/other", "other", False)])
def test_specs(spec, path, name, hit):
    assert matches_spec(spec, path, name) is hit


@pytest.mark.parametrize("path, expected", [("./docs/content", "docs/content"), ("../shared/docs", "../shared/docs"), (".", "."), ("/abs/docs", "/abs/docs")])
def test_portable_paths(path, expected):
    assert portable(path) == expected


def test_config(tmp_path):
    file = tmp_path / "rag.toml"
    file.write_text('model = "global/model"\nchunk_size = 100\n[[index]]\nname = "one"\npath = "docs"\nchunk_size = 50\n[[index]]\nname = "two"\npath = "x"\nmodel = "other/model"\noutput = "indexes/x"\n')
    c = Config.load(file)
    one, two = c.indexes
    assert c.settings_of(one) == ("global/model", 50, 64) and c.settings_of(two) == ("other/model", 100, 64)
    assert c.output_of(one) == tmp_path / ".rag/one" and c.output_of(two) == tmp_path / "indexes/x"
    assert models_to_fetch(None, c) == ["global/model", "other/model"] and models_to_fetch(None, c, ["two"]) == ["other/model"] and models_to_fetch("m", c) == ["m"] and len(models_to_fetch()) == 1
    with pytest.raises(ValueError, match="unknown index"):
        c.selected(["three"])
    for bad in ("", "other = 1\n[[index]]\nname='a'\npath='b'", "[[index]]\nname='a'\npath='b'\nextra=1", "[[index]]\nname='a'\npath='b'\n[[index]]\nname='a'\npath='c'"):
        file.write_text(bad)
        with pytest.raises(ValueError):
            Config.load(file)


def test_resolution(tmp_path):
    for name, own in (("rag.toml", "regular"), (".rag.toml", "dotfile")):
        (tmp_path / name).write_text(f"[[index]]\nname = '{own}'\npath = 'd'\n")
    folder = str(tmp_path)
    names = lambda **k: [s.name for s in federation.resolve(folder=folder, **k)]
    assert [s.path for s in federation.resolve(["x"], folder=folder)] == ["x"]
    assert names() == ["regular"] and names(config=str(tmp_path / ".rag.toml")) == ["dotfile"]
    (tmp_path / "rag.toml").unlink()
    assert names() == ["dotfile"]
    (tmp_path / ".rag.toml").unlink()
    assert federation.resolve(folder=folder)[0].path.endswith(".rag")


def test_meta():
    m = Meta("m", 2, ".", 512, 64, "b", format_version=FORMAT_VERSION)
    assert m.reusable_for("m", "b", 512, 64)
    assert not any(m.reusable_for(*x) for x in (("o", "b", 512, 64), ("m", "c", 512, 64), ("m", "b", 256, 64), ("m", "b", 512, 32)))
    legacy = Meta.parse('{"model_id": "m", "hidden_size": 2, "num_chunks": 1, "root_dir": ".", "created_at": "x", "chunk_size": 512, "chunk_overlap": 64}')
    assert legacy.format_version == 0 and legacy.embedding_backend == "" and not legacy.reusable_for("m", "", 512, 64)


@pytest.mark.parametrize("line", ["index docs --config x", "index docs --only x", "search q --index x --only y", "info --index x --only y", "download --model m --only y"])
def test_flag_conflicts(line):
    with pytest.raises(SystemExit):
        cli.parse(line.split())


def test_flags():
    a = cli.parse("index docs --ext a,b --ext c --chunk-size 9".split())
    assert a.ext == ["a", "b", "c"] and a.chunk_size == 9
    assert cli.ignored_flags(cli.parse("index -m x --chunk-size 3".split())) == ["model", "chunk_size"]
