"""Packed files, git and incremental indexing of a folder."""

import io
import os
import subprocess
import zipfile

import pytest

from loomgrain.operators import search
from loomgrain.operators.embedding import HashEmbedder, query_vector
from loomgrain.plans.indexing import Indexer
from loomgrain.sources import connectors


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_packed_files(spark):
    rows = [("a.docx", docx("one", "two"), 1.0, 9), ("b.DOCX", b"broken", 1.0, 9), ("c.pdf", b"%PDF", 1.0, 9), ("d.txt", b"no", 1.0, 9), ("e.docx", docx(" "), 1.0, 9), ("f.docx", None, 1.0, 9)]
    got = connectors.extracted(spark.createDataFrame(rows, "file_path string, content binary, mtime double, size long")).collect()
    assert [(r.file_path, r.content) for r in got] == [("a.docx", "one\ntwo")]


def test_git(spark, tmp_path):
    assert connectors.git_context(spark, str(tmp_path)).count() == 0
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}
    git = lambda *x: subprocess.run(["git", "-C", str(tmp_path), *x], check=True, capture_output=True, env=env)
    git("init", "-b", "trunk")
    for k in range(6):
        (tmp_path / "f").write_text(str(k))
        git("add", "f")
        git("commit", "-m", f"step {k}")
    (tmp_path / "new").write_text("x")
    row = connectors.git_context(spark, str(tmp_path)).first()
    assert (row.branch, row.uncommitted_files, row.recent_commits) == ("trunk", ["new"], [f"a - step {k}" for k in (5, 4, 3, 2, 1)])


def test_services_refuse(spark):
    with pytest.raises(ValueError):
        connectors.web_search(spark, "none", "q", "k")
    assert not connectors.is_online("http://127.0.0.1:9", timeout=0.5)


def test_incremental_indexing(spark, tmp_path):
    folder = tmp_path / "work"
    (folder / "src").mkdir(parents=True)
    (folder / "src/a.py").write_text("def alpha():\n    x = 1\n    y = 2\n    return beta(x)\n\n\ndef beta(x):\n    z = x\n    z += 1\n    return z\n")
    (folder / "notes.md").write_text("# Notes\nabout things\n")
    indexer = Indexer(spark, str(folder), str(tmp_path / "index"), HashEmbedder(16), "hash")
    assert indexer.run() == {"indexed": 2, "removed": 0}
    assert indexer.run() == {"indexed": 0, "removed": 0}
    store = indexer.store
    assert sorted((r.filePath, r.name, r.lineRangeStart, r.lineRangeEnd) for r in store.chunks().collect()) == [("notes.md", None, 0, 2), ("src/a.py", "alpha", 0, 3), ("src/a.py", "beta", 6, 9)]
    assert [(r.fromName, r.toName) for r in store.edges().collect()] == [("alpha", "beta")]
    hits = search.vector_topk(store.chunks(), query_vector(HashEmbedder(16), "# notes about things"), 1).collect()
    assert hits[0].filePath == "notes.md"
    (folder / "src/a.py").unlink()
    (folder / "notes.md").write_text("changed\n")
    os.utime(folder / "notes.md", (2_000_000_000, 2_000_000_000))
    assert indexer.run() == {"indexed": 1, "removed": 1}
    assert [(r.filePath, r.document) for r in store.chunks().collect()] == [("notes.md", "changed")]
    assert store.edges().count() == 0
    assert indexer.manifest().select("file_path", "chunk_count").collect() == [("notes.md", 1)]
    other = Indexer(spark, str(folder), str(tmp_path / "index"), HashEmbedder(16), "another model")
    assert other.run() == {"indexed": 1, "removed": 0}
    assert store.count() == 1


def test_index_honours_ignore_file_and_packed_files(spark, tmp_path):
    folder = tmp_path / "work dir"
    for sub in ("src/deep", "node_modules/x", ".hidden", "logs"):
        (folder / sub).mkdir(parents=True)
    (folder / ".gitignore").write_text("logs/\n*.secret.md\n")
    (folder / "src/__init__.py").write_text("x = 1\n")
    (folder / "src/deep/a b.md").write_text("deep notes\n")
    (folder / "src/key.secret.md").write_text("key\n")
    (folder / "logs/l.txt").write_text("log\n")
    (folder / "node_modules/x/m.js").write_text("m\n")
    (folder / ".hidden/h.md").write_text("h\n")
    (folder / "bad.txt").write_bytes(b"\xff\xfe")
    (folder / "blank.txt").write_text(" \n")
    (folder / "r.docx").write_bytes(docx("report text"))
    (folder / "p.pdf").write_bytes(b"PDF words")
    told = []
    indexer = Indexer(spark, str(folder), str(tmp_path / "index"), HashEmbedder(16), "hash", extractors={"docx": connectors.docx_text, "pdf": lambda b: b.decode()})
    assert indexer.run(told.append, every=0.01) == {"indexed": 6, "removed": 0}
    assert {r.filePath: r.document for r in indexer.store.chunks().collect()} == {"src/__init__.py": "x = 1", "src/deep/a b.md": "deep notes", "r.docx": "report text", "p.pdf": "PDF words"}
    assert told[-1] == {"status": "completed", "processedFiles": 6, "totalChunks": 4} and all(x["status"] == "running" for x in told[:-1])
    assert indexer.run(told.append) == {"indexed": 0, "removed": 0}
    (folder / ".gitignore").unlink()
    assert indexer.run() == {"indexed": 2, "removed": 0}


def test_only_changed_files_are_read(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.md").write_text(f"text {k}\n")
    indexer = Indexer(spark, str(folder), str(tmp_path / "index"), HashEmbedder(16), "hash")
    indexer.run()
    for k in range(3):
        os.chmod(folder / f"{k}.md", 0)
    (folder / "3.md").write_text("new\n")
    os.utime(folder / "3.md", (2_000_000_000, 2_000_000_000))
    assert indexer.run() == {"indexed": 1, "removed": 0}
    assert {r.filePath: r.document for r in indexer.store.chunks().collect()} == {"0.md": "text 0", "1.md": "text 1", "2.md": "text 2", "3.md": "new"}
