import json
import os
import subprocess
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelantern.config import EmbeddingSettings
from codelantern.engine import Engine
from codelantern.operators.embedding import (
    HashingEmbedder,
    ModelEmbedder,
    ServiceEmbedder,
    embed_chunks,
    embed_questions,
    embedder_for,
    pooled_windows,
    suggested_delay,
)
from codelantern.operators.lexical import LexicalIndex, bm25_search
from codelantern.operators.models import ServiceError
from codelantern.plans.ingest import ingest_as_json, ingest_repositories
from codelantern.plans.retrieve import hybrid_retrieve
from codelantern.schema import CHUNKS
from codelantern.sources import repos as repo_source
from codelantern.sources.listing import directory_size, list_files, read_files
from codelantern.sources.store import ChunkStore
from codelantern.streaming import ingest_stream


SUMMARY = (
    "repo_id string, status string, error string, file_count long, chunk_count long, languages array<string>, functions long, "
    "classes long, methods long, modules long, docs long, finished_at timestamp"
)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, data in {
        "src/app.py": b"def load_config(path):\n    return path\n\nclass App:\n    def run(self):\n        return 1\n",
        "_private/util.js": b"const add = (a, b) => a + b;\n", ".eslintrc.json": b"{}", "README.md": b"# App\nIt loads config.\n",
        "docs/skip.md": b"# no\n", ".git/config": b"x" * 40, "bad.txt": b"caf\xe9 \xff", "empty.py": b"  \n", "pic.png": b"\x89",
    }.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    (root / "link.py").symlink_to(root / "src/app.py")
    return root


def repo_rows(spark, *pairs):
    return spark.createDataFrame([(r, str(p)) for r, p in pairs], "repo_id string, root string")


def test_listing(spark, tree):
    repos = repo_rows(spark, ("o/r", tree))
    listed = {r.path: r.size_bytes for r in list_files(repos, ("docs", ".git")).collect()}
    assert set(listed) == {"src/app.py", "_private/util.js", ".eslintrc.json", "README.md", "bad.txt", "empty.py", "pic.png"}
    assert directory_size(repos).first().total_bytes == repo_source.tree_size(tree)
    text = {r.path: r.content for r in read_files(list_files(repos)).collect()}
    assert text["bad.txt"] == "caf� �"


def test_ingest_and_retrieve(spark, tree, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    other = tmp_path / "other"
    other.mkdir()
    (other / "main.go").write_text("func main() {}\n")
    embedder = HashingEmbedder(32)
    repos = repo_rows(spark, ("o/r", tree), ("o/two", other))
    summary = {r.repo_id: r for r in ingest_repositories(repos, store, embedder).collect()}
    one = summary["o/r"]
    assert (one.file_count, one.chunk_count, one.languages) == (6, 7, ["javascript", "markdown", "python", "text"])
    assert (one.functions, one.classes, one.methods, one.modules, one.docs) == (2, 1, 1, 2, 1)
    assert store.count("o/two") == 1

    (tree / "src/app.py").write_text("def renamed(): pass\n")
    ingest_repositories(repo_rows(spark, ("o/r", tree)), store, embedder)
    names = {r.symbol_name for r in store.scan(["o/r"]).collect()}
    assert "renamed" in names and "load_config" not in names and store.count("o/two") == 1

    chunks = store.scan()
    asked = embed_questions(spark.createDataFrame([(1, "o/r", "renamed function")], "query_id bigint, repo_id string, text string"), embedder)
    top = hybrid_retrieve(asked, chunks, LexicalIndex.over(chunks)).hits.orderBy("rank").first()
    assert (top.symbol_name, top.source) == ("renamed", "hybrid")

    assert store.clear("o/r") == 5 and store.clear("o/r") == 0
    assert store.count("o/r") == 0 and store.count("o/two") == 1


def test_one_bad_repository_does_not_stop_the_others(spark, tree, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    blank, none = tmp_path / "blank", tmp_path / "none"
    for folder in (blank, none):
        folder.mkdir()
    (blank / "a.py").write_text(" \n")
    (none / "a.bin").write_text("x")
    (tmp_path / "huge").mkdir()
    (tmp_path / "huge" / "a.py").write_text("def f(): pass\n" * 100)
    repos = repo_rows(spark, ("o/r", tree), ("o/blank", blank), ("o/none", none), ("o/huge", tmp_path / "huge"))
    rows = {r.repo_id: r for r in ingest_repositories(repos, store, HashingEmbedder(8), max_repo_bytes=1000).collect()}
    assert {i: (r.status, bool(r.error)) for i, r in rows.items()} == {
        "o/r": ("ingested", False), "o/blank": ("no_chunks", True), "o/none": ("no_files", True), "o/huge": ("too_large", True)}
    assert store.count("o/r") == rows["o/r"].chunk_count > 0 == store.count("o/blank")
    bodies = {r.repo_id: json.loads(r.body) for r in ingest_as_json(spark.createDataFrame(list(rows.values()), SUMMARY)).collect()}
    assert bodies["o/r"]["success"] and bodies["o/r"]["result"]["chunkSummary"]["functions"] == 2
    assert not bodies["o/none"]["success"] and "no eligible file" in bodies["o/none"]["error"]


def test_blank_files_leave_no_old_rows(spark, tree, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    root = tmp_path / "one"
    root.mkdir()
    (root / "a.py").write_text("def f(): pass\n")
    repos = repo_rows(spark, ("o/one", root))
    assert ingest_repositories(repos, store, HashingEmbedder(8)).first().functions == 1
    (root / "a.py").write_text("  \n")
    again = ingest_repositories(repos, store, HashingEmbedder(8)).first()
    assert (again.status, again.chunk_count, store.count("o/one")) == ("no_chunks", 0, 0)


@pytest.mark.skipif(os.geteuid() == 0, reason="everything is readable for root")
def test_unreadable_paths_fail(spark, tree):
    (tree / "src").chmod(0)
    with pytest.raises(Exception, match="Permission"):
        list_files(repo_rows(spark, ("o/r", tree))).collect()
    (tree / "src").chmod(0o700)
    (tree / "src/app.py").chmod(0)
    with pytest.raises(Exception, match="Permission"):
        read_files(list_files(repo_rows(spark, ("o/r", tree)))).collect()


def test_a_folder_that_is_no_folder_fails(spark, tmp_path):
    with pytest.raises(Exception, match="No such file"):
        list_files(repo_rows(spark, ("o/r", tmp_path / "missing"))).collect()


def test_stored_index(spark, tree, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    engine = Engine(spark, str(tmp_path / "store"), HashingEmbedder(16))
    engine.ingest(repo_rows(spark, ("o/r", tree)))
    index = store.index()
    assert index.chunks is None and index.rows.count() == store.count("o/r")
    asked = engine.questions([(1, "o/r", "load config")])
    stored, derived = (bm25_search(i, asked).orderBy("bm25_rank").collect() for i in (index, LexicalIndex.over(store.scan())))
    assert stored == derived and stored
    # Ranking reads neither texts nor vectors of the chunks: only the stored tokens.
    plan = bm25_search(index, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "embedding" not in plan

    (tree / "src/app.py").write_text("def renamed(): pass\n")
    engine.ingest(repo_rows(spark, ("o/r", tree)))
    assert not bm25_search(store.index(), engine.questions([(1, "o/r", "load_config")])).where("id like '%app.py%'").count()
    assert bm25_search(store.index(), engine.questions([(1, "o/r", "renamed")])).count() == 1
    store.clear("o/r")
    assert bm25_search(store.index(), engine.questions([(1, "o/r", "renamed")])).count() == 0


def chunk(spark, *rows):
    full = [(f"{r}:{i}", r, f"{i}.py", "python", text, 1, 1, None, "module", vector, i) for r, i, text, vector in rows]
    return spark.createDataFrame(full, CHUNKS)


def test_upsert(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    v = [1.0, 2.0]
    assert store.upsert(chunk(spark, ("a/x", "1", "old", v), ("a/x", "2", "keep", v), ("b/y", "1", "b", v))) == 3
    update = chunk(spark, ("a/x", "1", "new", v), ("a/x", "3", "added", v))
    for _ in range(2):
        assert store.upsert(update) == 2
        assert sorted((r.id, r.content) for r in store.scan().collect()) == [
            ("a/x:1", "new"), ("a/x:2", "keep"), ("a/x:3", "added"), ("b/y:1", "b")]
    assert store.upsert(update.limit(0)) == 0
    with pytest.raises(ValueError, match="repeat an id"):
        store.upsert(update.unionByName(update))
    with pytest.raises(Exception, match="no embedding vector"):
        store.upsert(chunk(spark, ("a/x", "9", "bad", None)))
    assert store.scan().count() == 4
    # Failed changes leave no segment behind: three upserts have one each.
    assert len(os.listdir(tmp_path / "store" / "segments")) == 3


def test_embedders(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "beta alpha"), (3, ""), (4, None)], "query_id int, text string")
    rows = {r.query_id: r.vector for r in embed_questions(texts, HashingEmbedder(16)).collect()}
    assert rows[1] == rows[2] and abs(np.linalg.norm(rows[1]) - 1) < 1e-6
    assert rows[3] == rows[4] == [0.0] * 16

    def load():
        return lambda batch: np.array([[len(t), 1.0] for t in batch])

    model = ModelEmbedder(load, 2, batch_size=1)
    found = embed_chunks(chunk(spark, ("a/x", "1", "hello", None)), model).first()
    assert found.embedding == [len("File: 1.py \n\nhello"), 1.0]


def test_service_embedder(spark):
    def send(model, texts):
        if model == "first":
            raise ServiceError("quota", limited=True)
        return [[float(len(t)), 2.0] for t in texts]

    texts = spark.createDataFrame([(1, "abc")], "query_id int, text string")
    embedder = ServiceEmbedder(send, "first", "second", dimension=2, first_delay=0.0)
    assert embed_questions(texts, embedder).first().vector == [3.0, 2.0]
    assert suggested_delay('{"retryDelay": "7s"}', 2.0) == 7.5
    assert suggested_delay("please retry in 120.2s", 2.0) == 60.0
    assert suggested_delay("broken", 2.0) == 2.0


def test_engine(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), HashingEmbedder(32))
    assert engine.health()["status"] == "healthy"
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    engine.ingest(repo_rows(spark, ("o/r", tree)))
    assert engine.files("o/r").count() == 5
    answer = engine.ask("o/r", "where is load_config?")
    assert answer["success"] and any(c["filePath"] == "src/app.py" for c in answer["answer"]["citations"])
    before = sorted(shared.glob("tables-*/*"))
    assert engine.ask("o/none", "what?")["answer"]["lowConfidence"]
    assert sorted(shared.glob("tables-*/*")) == before
    assert engine.ask("o/r", "  ") == {"success": False, "error": "question must be a non-empty string"}
    hits = engine.search(engine.questions([(5, "o/r", "load_config")])).hits
    assert hits.orderBy("rank").first().symbol_name == "load_config"


def test_stream(spark, tmp_path):
    source, schema = tmp_path / "in", "repo_id string, path string, size_bytes bigint, content string"
    rows = [("o/r", "a.py", 5, "def f(): pass"), ("o/r", "x/test/b.py", 5, "x"), ("o/r", "b.md", 5, "# T\nb")]
    spark.createDataFrame(rows, schema).write.parquet(str(source))
    store = ChunkStore(spark, str(tmp_path / "store"))
    stream = ingest_stream(spark.readStream.schema(schema).parquet(str(source)), store, HashingEmbedder(8))
    stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.symbol_name for r in store.scan().collect()} == {"f", "T"}
    again = [("o/r", "a.py", 9, "\n\ndef g(): pass"), ("o/r", "b.md", 5, "  ")]
    spark.createDataFrame(again, schema).write.mode("append").parquet(str(source))
    stream = ingest_stream(spark.readStream.schema(schema).parquet(str(source)), store, HashingEmbedder(8))
    stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.symbol_name for r in store.scan().collect()} == {"g"}


def test_clone_and_cleanup(tmp_path, monkeypatch, tree):
    def fake(command, check, capture_output):
        if command[1] == "clone":
            subprocess.Popen(["cp", "-r", str(tree), command[-1]]).wait()

    monkeypatch.setattr(repo_source.subprocess, "run", fake)
    repo_id, root = repo_source.shallow_clone("https://github.com/o/r", tmp_path)
    assert repo_id == "o/r" and (root / "README.md").exists()
    (root / "src").chmod(0o500)
    repo_source.remove_tree(root.parent)
    assert not root.parent.exists()
    with pytest.raises(repo_source.RepoTooLarge):
        repo_source.shallow_clone("o/r", tmp_path, max_bytes=5)
    assert [p for p in tmp_path.iterdir() if p.name.startswith("o_r-")] == []


def test_chunks_keep_their_order(spark, tree):
    from codelantern.operators.chunking import chunk_files

    rows = chunk_files(read_files(list_files(repo_rows(spark, ("o/r", tree))))).orderBy(F.col("ord")).collect()
    assert [r.file_path for r in rows] == sorted(r.file_path for r in rows)
    assert [r.symbol_name for r in rows if r.file_path == "src/app.py"] == ["load_config", "run", "App"]


def test_embedding_settings(spark, tmp_path):
    assert EmbeddingSettings.from_env({}) == EmbeddingSettings.from_env({"EMBEDDING_PROVIDER": "onnx"}) == EmbeddingSettings()
    cloud = EmbeddingSettings.from_env({"EMBEDDING_PROVIDER": " Google "})
    assert (cloud.provider, cloud.model, cloud.fallback, cloud.dimension, cloud.batch_size) == (
        "cloud", "models/gemini-embedding-001", "models/gemini-embedding-2", 768, 20)
    old = EmbeddingSettings.from_env({"EMBEDDING_PROVIDER": "gemini", "EMBEDDING_MODEL": "text-embedding-004"})
    new = EmbeddingSettings.from_env({"EMBEDDING_PROVIDER": "gemini", "EMBEDDING_MODEL": "gemini-embedding-2-preview"})
    assert old == cloud and (new.model, new.fallback) == ("models/gemini-embedding-2-preview", "models/gemini-embedding-001")
    with pytest.raises(ValueError, match="needs a function"):
        embedder_for(cloud)
    assert embedder_for(cloud, lambda model, texts: [[1.0]] * len(texts)).dimension == 768


def test_engine_from_env(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("EMBEDDING_PROVIDER", "your_choice")
    (tmp_path / ".env").write_text("EMBEDDING_PROVIDER=google\n")
    with pytest.raises(ValueError):
        Engine.from_env(spark, str(tmp_path / "store"), tmp_path)
    assert Engine.from_env(spark, str(tmp_path / "store"), tmp_path, send=lambda m, t: []).embedder.batch_size == 20


def test_texts_beyond_a_window_count():
    def hidden(ids, mask, types):
        return np.stack([ids, ids * 0 + 1], axis=2).astype(float)

    one, two, none = [([4, 4], [0, 0])], [([4, 4], [0, 0]), ([9], [0])], [([], [])]
    found = pooled_windows([one, two, none], hidden)
    assert np.allclose(found[0], np.array([8, 2]) / np.hypot(8, 2)) and np.allclose(found[1], np.array([17, 3]) / np.hypot(17, 3))
    assert np.allclose(found[2], 0)
