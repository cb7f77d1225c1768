"""One object for the everyday calls: ingest a repository, search it, ask about it."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelantern import fixed_values as fv
from codelantern.config import EmbeddingSettings, FilterConfig, GenerationOptions, SearchOptions, load_env, require_text
from codelantern.operators.chunking import symbol_chunks
from codelantern.operators.embedding import Embedder, HashingEmbedder, embed_questions, embedder_for
from codelantern.operators.models import AnswerModel, ExtractiveModel
from codelantern.operators.sizing import durable, scratch
from codelantern.operators.summaries import file_inventory
from codelantern.plans.answer import Answers, answer_questions, answers_as_json
from codelantern.plans.ingest import ingest_as_json, ingest_repositories
from codelantern.plans.retrieve import Retrieval, hybrid_retrieve
from codelantern.sources.repos import parse_repo_url, remove_tree, shallow_clone
from codelantern.sources.store import ChunkStore

QUESTION = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("repo_id", T.StringType()),
    T.StructField("text", T.StringType()),
])


class Engine:
    """``path`` must be a folder that every executor reaches."""

    def __init__(
        self, spark: SparkSession, path: str, embedder: Embedder | None = None, model: AnswerModel | None = None
    ):
        self.spark = spark
        self.store = ChunkStore(spark, path)
        self.embedder = embedder or HashingEmbedder()
        self.model = model or ExtractiveModel()

    @classmethod
    def from_env(
        cls, spark: SparkSession, path: str, directory: str | Path = ".", model: AnswerModel | None = None, send=None
    ) -> Engine:
        """An engine with the embedding that the environment and the ``.env`` files of ``directory`` name."""
        load_env(directory)
        return cls(spark, path, embedder_for(EmbeddingSettings.from_env(), send), model)

    def ingest(self, repos: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
        """Trees the executors can read, as ``repos(repo_id, root)``."""
        return ingest_repositories(repos, self.store, self.embedder, config)

    def ingest_address(self, address: str, shared_folder: str, config: FilterConfig = FilterConfig()) -> dict:
        """Clone one public repository into ``shared_folder`` and ingest it: the response envelope."""
        root = None
        try:
            parse_repo_url(require_text("url", address))
            repo_id, root = shallow_clone(address, Path(shared_folder))
            repos = self.spark.createDataFrame([(repo_id, str(root))], "repo_id string, root string")
            with scratch(self.spark):
                return json.loads(ingest_as_json(self.ingest(repos, config)).first().body)
        except Exception as error:
            return {"success": False, "error": str(error) or "the repository could not be ingested"}
        finally:
            if root is not None:
                remove_tree(root.parent)

    def questions(self, rows: list[tuple[int, str, str]]) -> DataFrame:
        """Embedded once and stored: every search measures and reads its questions several times."""
        return durable(embed_questions(self.spark.createDataFrame(rows, QUESTION), self.embedder))

    def search(self, questions: DataFrame, options: SearchOptions = SearchOptions()) -> Retrieval:
        """Both rankings read one version of the store, whatever is written meanwhile."""
        return hybrid_retrieve(questions, *self.store.snapshot().of(questions), options)

    def answer(self, questions: DataFrame, options: GenerationOptions = GenerationOptions()) -> Answers:
        chunks, index, vectors = self.store.snapshot().of(questions)
        return answer_questions(questions, chunks, index, self.model, vectors, generation=options)

    def ask(self, repo_id: str, question: str) -> dict:
        """The response envelope for one question; errors come back in it."""
        try:
            rows = [(0, require_text("repo_id", repo_id), require_text("question", question))]
            with scratch(self.spark):
                return json.loads(answers_as_json(self.answer(self.questions(rows))).first().body)
        except Exception as error:
            return {"success": False, "error": str(error) or "the question could not be answered"}

    def files(self, repo_id: str) -> DataFrame:
        return file_inventory(self.store.scan([repo_id]))

    def health(self) -> dict:
        """Embed a text and extract a symbol in real tasks; report each check and the overall state."""
        checks: dict[str, dict] = {}
        try:
            vector = self.questions([(0, "-", "hello world")]).first().vector
            checks["embedding"] = {"ok": True, "dimension": len(vector)}
        except Exception as error:
            checks["embedding"] = {"ok": False, "error": str(error)}
        sample = [("-", "a.js", "function greet(name) {\n  return 'hi ' + name;\n}")]
        found = symbol_chunks(self.spark.createDataFrame(sample, "repo_id string, path string, content string")).count()
        checks["parser"] = {"ok": found == 1, "languages": list(fv.PARSED_LANGUAGES), "symbols": found}
        spark_ok = self.spark.range(1).agg(F.count(F.lit(1))).first()[0] == 1
        checks["spark"] = {"ok": spark_ok}
        states = [c["ok"] for c in checks.values()]
        return {"status": "healthy" if all(states) else "degraded" if any(states) else "unhealthy", "checks": checks}
